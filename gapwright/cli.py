"""Command line: generate or convert a corpus, predict packages, train the network or simple heads, draw curves."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .functions.scalar import r6
from .operators.preprocess import preprocess
from .plans import curves, flows
from .operators import history
from .scoring import network, training
from .sources import images, paths, records
from .sources import samples as corpus


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gapwright", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="raw JSON splits to Parquet")
    c.add_argument("--source", required=True)
    c.add_argument("--dataset", help="name of the corpus under the source")
    c.add_argument("--target", required=True)
    c.add_argument("--splits", nargs="+", default=["train", "val", "test"])
    c.add_argument("--max-samples", type=int)
    c.add_argument("--replace", action="store_true")
    q = sub.add_parser("predict", help="evidence packages of converted samples")
    q.add_argument("--samples", required=True)
    q.add_argument("--images", required=True)
    q.add_argument("--weights", required=True)
    q.add_argument("--output", required=True)
    q.add_argument("--sample-id")
    q.add_argument("--splits", nargs="+")
    t = sub.add_parser("train", help="fit the network")
    t.add_argument("--images", required=True)
    t.add_argument("--workers", type=int, default=8)
    t.add_argument("--set", nargs=2, action="append", default=[], metavar=("SECTION.KEY", "VALUE"), help="a setting instead of the config's, as JSON")
    h = sub.add_parser("heads", help="fit and evaluate heads on single points")
    for s in (t, h):
        s.add_argument("--samples", required=True)
        s.add_argument("--output", required=True)
    m = sub.add_parser("generate", help="write a labelled corpus of generated series and their images")
    m.add_argument("--target", required=True)
    m.add_argument("--train", type=int, default=16)
    m.add_argument("--val", type=int, default=4)
    m.add_argument("--length", type=int, default=256)
    m.add_argument("--seed", type=int, default=2026)
    g = sub.add_parser("curves", help="draw a history")
    g.add_argument("--history", required=True)
    g.add_argument("--output", required=True)
    bc = g.add_mutually_exclusive_group()
    bc.add_argument("--with-bc", dest="bc", action="store_true", default=None)
    bc.add_argument("--without-bc", dest="bc", action="store_false")
    for s in (q, t, h):
        s.add_argument("--config")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("gapwright").getOrCreate()
    if a.command == "convert":
        counts = flows.convert(spark, paths.corpus_root(a.source, a.dataset), a.target, tuple(a.splits), a.max_samples, a.replace)
        settings.write_json({r["split"]: r.asDict() for r in counts.collect()}, f"{a.target}.summary.json")
        return
    if a.command == "generate":
        flows.generate(spark, a.target, {"train": a.train, "val": a.val}, a.length, seed=a.seed)
        return
    if a.command == "curves":
        curves.save_curves(records.read_history(spark, a.history), a.output, include_bc=a.bc)
        return
    cfg = settings.load(a.config, {k: json.loads(v) for k, v in getattr(a, "set", [])})
    settings.set_seed(cfg["run"]["seed"])
    rows = corpus.read_samples(spark, a.samples, getattr(a, "splits", None))
    if a.command == "predict":
        size = training.from_config(cfg).size
        weights, _ = network.load_weights(a.weights)
        rows = flows.with_image_paths(rows, cfg["data"]["raw_dataset_root"] or a.images)
        # one sample's images are read alone; it has one in each split at most
        wanted = a.images if a.sample_id is None else [r.image_path for r in rows.where(F.col("sample_id") == a.sample_id).select("image_path").distinct().collect()]
        packages = flows.predict(rows, images.load_views(spark, wanted, size), weights, size, cfg["data"]["local_window"], a.sample_id)
        records.write_predictions(packages, a.output)
        return
    if a.command == "train":
        train(rows, a, cfg)
        return
    ready = preprocess(rows.withColumn("series", F.transform("series", lambda x: x.cast("double"))), window=cfg["data"]["local_window"])
    models = flows.train_heads(ready.where("split = 'train'"))
    for name, model in models.items():
        model.write().overwrite().save(f"{a.output}/{name}")
    scores = flows.evaluate_heads(models, ready.where("split = 'val'"))
    settings.write_json(scores.select(*(r6(F.col(c)).alias(c) for c in scores.columns)).head().asDict(), f"{a.output}/scores.json")


def train(rows: DataFrame, a: argparse.Namespace, cfg: settings.Config) -> None:
    """Fits the network on the split "train", measured on "val"; writes checkpoints, settings, history, curves and a summary."""
    made, model, run = training.from_config(cfg, a.workers), cfg["model"], cfg["run"]
    views = images.load_views(rows.sparkSession, a.images, made.size)
    seen = images.with_views(flows.with_image_paths(rows, cfg["data"]["raw_dataset_root"] or a.images), views)
    settings.write_yaml(cfg, f"{a.output}/resolved_config.yaml")
    weights = network.init_weights(model["hidden_dim"], model["input_dim"], model["num_types"], model["text_layers"], run["seed"])
    done = flows.train_network(seen.where("split = 'train'"), seen.where("split = 'val'"), weights, made, a.output)
    best = history.best_epoch(done).head()
    summary = records.run_summary(cfg, best.epoch, best.val_event_f1, made.epochs)
    try:
        curves.save_curves(done, f"{a.output}/training_curves.png", include_bc=made.augments)
    except ImportError as e:  # matplotlib is optional
        summary["training_curves_error"] = str(e)
    settings.write_json(summary, f"{a.output}/summary.json")


if __name__ == "__main__":
    main()
