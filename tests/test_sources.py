"""Readers, writers, images, the generator, settings and the stream."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapwright import cli
from gapwright import config as settings
from gapwright.plans import curves, flows
from gapwright.scoring import network
from gapwright.sources import generator, images, paths, records
from gapwright.sources import samples as corpus
from gapwright.streaming import ingest


def raw(i, kind="freq", events=None, **more):
    mask = [0.0] * 10 + [1.0] * 5 + [0.5] * 3 + [1.0] * 2
    return {"sample_id": f"s{i}", "series": [float(t % 7) for t in range(20)], "point_labels": mask, "parameters": {"anomaly_type": kind}, **({"events": events} if events else {}), **more}


@pytest.fixture
def root(tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/train.json").write_text(json.dumps([raw(1), raw(2, events=[{"type": "level"}, {"type": "odd"}]), raw(0, image_path="a/b.png")]))
    (tmp_path / "raw/val.json").write_text(json.dumps([raw(3, "point") | {"point_labels": [0.0] * 20}]))
    return tmp_path


def test_convert(spark, root):
    counts = flows.convert(spark, str(root / "raw"), str(root / "out"), ("train", "val"))
    assert {r["split"]: (r.num_samples, r.num_anomalous) for r in counts.collect()} == {"train": (3, 3), "val": (1, 0)}
    rows = {r.sample_id: r for r in corpus.read_samples(spark, str(root / "out")).collect()}
    assert [tuple(s) for s in rows["s1"].segments] == [(10, 14), (18, 19)] and rows["s1"].types == [1, 1]
    assert rows["s2"].types == [3, 1] and rows["s3"].segments == [] and rows["s3"].types == []
    assert rows["s0"].image_path == "a/b.png" and rows["s1"].image_path == ""
    # what is there stays
    flows.convert(spark, str(root / "raw"), str(root / "out"), ("val",))
    assert corpus.read_samples(spark, str(root / "out")).count() == 4
    assert corpus.read_samples(spark, str(root / "out"), ["val"]).count() == 1


def test_convert_again_where_a_split_lacks(spark, root):
    target = str(root / "again")
    flows.convert(spark, str(root / "raw"), target, ("val",))
    assert not corpus.has_samples(spark, target, "train") and corpus.has_samples(spark, target, "val")
    flows.convert(spark, str(root / "raw"), target, ("train", "val"))
    assert corpus.read_samples(spark, target).count() == 4


def test_generated_corpus(spark, tmp_path):
    written = flows.generate(spark, str(tmp_path), {"train": 5, "val": 2}, length=128, seed=3)
    assert {(r.split, r["count"]) for r in written.groupBy("split").count().collect()} == {("train", 5), ("val", 2)}
    rows = corpus.read_npz(spark, str(tmp_path / "npz")).collect()
    assert len(rows) == 7 and all(len(r.series) == 128 and len(r.segments) == 1 for r in rows)
    for r in rows:
        assert r.image_path.endswith(f"{r.split}/{r.sample_id}.png") and [i for i, m in enumerate(r.mask) if m] == list(range(r.segments[0].start, r.segments[0].end + 1))
    # one image can be read alone
    views = images.load_views(spark, [rows[0].image_path], (8, 4)).collect()
    assert [v.image_path for v in views] == [rows[0].image_path] and len(views[0].pixels) == 32


def test_augmented_views(spark):
    rows = spark.createDataFrame([(1, [0.5] * 64, ("style",)), (2, [0.5] * 64, ("scale",))], "sample_id long, pixels array<float>, transform struct<kind:string>")
    got = {r.sample_id: r for r in images.augmented_views(rows, seed=4).collect()}
    assert got[2].aug_pixels == got[2].pixels and got[1].aug_pixels != got[1].pixels
    assert got[1].aug_pixels == {r.sample_id: r for r in images.augmented_views(rows, seed=4).collect()}[1].aug_pixels
    assert 0.3 < np.mean(got[1].aug_pixels) < 0.7


def test_first_rows_of_a_split(spark, root):
    assert [r.sample_id for r in corpus.read_split(spark, str(root / "raw"), "train", 2).collect()] == ["s1", "s2"]
    assert sorted(r.sample_id for r in corpus.head(corpus.convert(corpus.read_split(spark, str(root / "raw"), "train")), 2).collect()) == ["s0", "s1"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        corpus.read_split(spark, str(root / "raw"), "test").count()


def test_npz(spark, root):
    rows = corpus.convert(corpus.read_split(spark, str(root / "raw"), "train").unionByName(corpus.read_split(spark, str(root / "raw"), "val")))
    assert corpus.write_npz(rows, f"file://{root}/npz").where("bytes > 0").count() == 4
    with np.load(root / "npz/val/s3.npz", allow_pickle=False) as f:
        assert f["segments"].shape == (0, 2) and f["series"].dtype == np.float32
    back = corpus.read_npz(spark, f"file://{root}/npz")
    key = lambda df: sorted(df.select(*sorted(df.columns)).collect(), key=lambda r: r.sample_id)
    assert key(back) == key(rows)


def test_paths(spark, root):
    p = lambda g: spark.range(1).select(paths.image_path(F.lit(g).cast("string"), F.lit("/r"), F.lit("val"), F.lit("s9")).alias("p")).head().p
    assert [p("/x.png"), p("d/x.png"), p(""), p(None)] == ["/x.png", "/r/d/x.png", "/r/images_plain_768x384/val/s9.png", "/r/images_plain_768x384/val/s9.png"]
    assert paths.corpus_root(str(root), "raw") == paths.corpus_root(str(root / "raw")) == paths.corpus_root(str(root)) == str(root / "raw")
    with pytest.raises(FileNotFoundError):
        paths.corpus_root(str(root), "none")


def test_long_series_are_drawn_whole():
    size, spike = (192, 96), np.zeros(10_000)
    for at, x in ((5003, 96), (0, 0), (9999, 191)):
        spike[:] = 0
        spike[at] = 9
        drawn = images.draw(spike, size, grid=False)
        assert drawn[:10, x].min() == 90 and drawn[85:, x].min() == 90
    ramp = images.draw(np.arange(10_000.0), size, grid=False) == 90
    assert ramp.any(axis=0).all() and ramp.sum() < 5 * 192


def test_queries_draw_and_view_in_full_size(spark):
    from gapwright.plans import io_queries

    views = io_queries.image_view(spark, "/root/testdata/sf0.001")
    assert {r.n_pixels for r in views.collect()} == {224 * 224} and io_queries.HIDDEN == 128


def test_images(spark, tmp_path):
    picture = np.random.default_rng(1).integers(0, 256, (20, 30), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(images.png(picture))
    view = images.load_views(spark, str(tmp_path), (30, 20)).head()
    assert np.allclose(np.array(view.pixels).reshape(20, 30), picture / 255.0, atol=1e-6)
    assert (images.resize(np.full((40, 60), 77, np.uint8), 13, 9) == 77).all() and images.resize(picture, 15, 10).shape == (10, 15)
    bgr = np.zeros((1, 1, 3), np.uint8)
    bgr[..., 2] = 255
    assert images.gray(bgr)[0, 0] == 76
    styled = images.restyle(np.full(1000, 0.5), 3)
    assert (styled == images.restyle(np.full(1000, 0.5), 3)).all() and 0 <= styled.min() and styled.max() <= 1
    frame = spark.createDataFrame([("s", "/none.png")], "sample_id string, image_path string")
    with pytest.raises(Exception, match="no image"):
        images.with_views(frame, images.load_views(spark, str(tmp_path))).select("pixels").collect()


def test_generator(spark):
    ids = spark.range(40).withColumnRenamed("id", "sample_id")
    for r in generator.labelled_samples(ids, 256, noise=0.08).collect():
        s = r.segments[0]
        assert sum(r.mask) == s.end - s.start + 1 and 40 <= s.start <= s.end < 256 and r.types == [r.type]
    values = np.array(generator.base_series(ids, 256, noise=0.08).head().series)
    clean = np.array(generator.base_series(ids, 256).head().series)
    assert 0.05 < (values - clean).std() < 0.11
    with pytest.raises(ValueError, match="more than 120"):
        generator.labelled_samples(ids, 120)


def test_network(spark, tmp_path):
    w = network.init_weights()
    assert network.count_parameters(w) == 682_098
    assert network.gelu(np.array([0.0, 1.0])) == pytest.approx([0.0, 0.8413447])
    small = network.init_weights(hidden=8)
    net = network.Network(small)
    out = net.forward(np.random.default_rng(0).normal(size=(31, 4)), np.zeros((1, 24, 48)))
    assert out["fused"].shape == (31, 8) and out["point_logits"].shape == (31,) and out["image_evidence"].shape == (8,)
    # a convolution by hand
    x = np.random.default_rng(1).normal(size=(9, 8))
    k = small["time.0.a.w"]
    at = lambda t: x[t] if 0 <= t < 9 else np.zeros(8)
    assert net.along_time("time.0.a", x)[0] == pytest.approx(sum(k[:, :, i] @ at(i - 2) for i in range(5)) + small["time.0.a.b"])
    logits = np.array([-9.0, 9, 9, -9, 9])
    found = net.decode({"point_logits": logits, "start_logits": np.array([0, 1, 3, 0, 0.0]), "end_logits": np.array([0, 2, 1, 0, 0.0]), "fused": np.ones((5, 8))})
    assert [f[:2] for f in found] == [(1, 2), (4, 4)]
    network.save_weights(small, f"file://{tmp_path}/w.npz", epoch=3)
    back, meta = network.load_weights(f"file://{tmp_path}/w.npz")
    assert meta == {"epoch": 3.0} and all((back[n] == small[n]).all() for n in small)


def test_heads_learn(spark):
    from gapwright.operators.preprocess import preprocess

    made = generator.labelled_samples(spark.range(24).withColumnRenamed("id", "sample_id"), 160, noise=0.05)
    ready = preprocess(made.where("type IN (0, 3)")).withColumn("segments", F.col("segments"))
    models = flows.train_heads(ready)
    scores = flows.evaluate_heads(models, ready).head()
    assert scores.point_f1 > 0.5 and scores.event_recall > 0.5


def test_history(spark, tmp_path):
    from gapwright.operators.history import best_epoch
    from gapwright.schema import HISTORY

    rows = [tuple(e if f == "epoch" else v if f == "val_event_f1" else 0.0 for f in HISTORY.names) for e, v in ((1, 0.2), (2, 0.5), (3, 0.5))]
    records.write_history(spark.createDataFrame(rows, HISTORY), str(tmp_path / "h"))
    h = records.read_history(spark, str(tmp_path / "h"))
    assert h.count() == 3 and best_epoch(h).head().epoch == 2
    assert "train_bc" not in curves.curve_panels(h)["parts"] and "train_bc" in curves.curve_panels(h, True)["parts"]
    records.write_history(h.limit(0), str(tmp_path / "none"))
    with pytest.raises(Exception, match="empty"):
        records.read_history(spark, str(tmp_path / "none")).collect()


def test_settings(tmp_path):
    settings.write_yaml({"train": {"epochs": 3}, "loss_weights": {"bc": 0.0}}, str(tmp_path / "c.yaml"))
    c = settings.load(str(tmp_path / "c.yaml"), {"train.lr": 0.1, "train.epochs": None})
    assert (c["train"]["epochs"], c["train"]["lr"], c["model"]["hidden_dim"]) == (3, 0.1, 128)
    assert not settings.uses_augmentation(c) and settings.uses_augmentation(settings.load()) and not settings.uses_augmentation(settings.load(), training=False)
    assert settings.loss_weights(c).evidence == 0.5


def test_stream(spark, root):
    stream = ingest.arriving(spark, str(root / "raw"), "train")
    ingest.keep(stream, str(root / "live"), str(root / "state")).awaitTermination(60)
    assert corpus.read_samples(spark, str(root / "live")).count() == 4


def test_command_line(spark, root):
    cli.main(["convert", "--source", str(root), "--target", str(root / "cli"), "--splits", "train"])
    assert json.loads((root / "cli.summary.json").read_text())["train"]["num_samples"] == 3
    with pytest.raises(SystemExit):
        cli.main(["curves", "--history", "x", "--output", "y", "--with-bc", "--without-bc"])


def test_predict(spark, root):
    rows = corpus.convert(corpus.read_split(spark, str(root / "raw"), "train"))
    (root / "pics").mkdir()
    for i in range(3):
        (root / f"pics/s{i}.png").write_bytes(images.png(images.draw(np.arange(20.0), (48, 24))))
    placed = rows.withColumn("image_path", F.concat(F.lit(f"{root}/pics/"), "sample_id", F.lit(".png")))
    views = images.load_views(spark, str(root / "pics"), (48, 24))
    found = flows.predict(placed, views, network.init_weights(hidden=8), (48, 24))
    assert {r.id for r in found.collect()} == {"s0", "s1", "s2"}
    assert [r.id for r in flows.predict(placed, views, network.init_weights(hidden=8), (48, 24), only="s1").collect()] == ["s1"]
