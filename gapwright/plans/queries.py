"""The engine's operators over the star-schema tables, one query each.

Results are scalar columns, rounded to 6 decimals, so that SQL can check them row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scalar as C
from ..functions import taxonomy
from ..operators import decode, evidence, history, losses, metrics, scaling, segments, targets
from ..operators.preprocess import augmented, augmented_features, preprocess
from ..sources import generator, paths
from ..sources.testdata import embedding_pairs, hidden_states, points, samples, table
from ..storage import stored

BATCH = 8
SPLITS = ("train", "val", "test")


def split_of(sample_id: Column) -> Column:
    return F.get(F.array(*map(F.lit, SPLITS)), (sample_id % 3).cast("int"))


def by_point(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Parallel arrays as rows: keys, t, and each array's element, rounded."""
    at = F.posexplode(F.arrays_zip(*columns)).alias("t", "_x")
    return df.select(*keys, at).select(*keys, F.col("t").cast("bigint").alias("t"), *(C.r6(F.col(f"_x.{c}").cast("double")).alias(c) for c in columns))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with closed-form scores: arrays z, pl, sl, el (logits), pp, sp, ep; true segments and types."""
    s = samples(spark, sf_dir)
    s = s.withColumns({"mean": A.mean(F.col("series")), "sd": A.deviation(F.col("series"))})
    v = F.col("series")
    s = s.withColumns({"z": A.standardize(v, F.col("mean"), F.col("sd")), "segments": segments.mask_segments(F.col("mask"))})
    step = lambda o: C.let_all((v, F.col("sd")), lambda a, d: F.transform(a, lambda x, t: 1.5 * (x - F.coalesce(F.get(a, t + o), x)) / (d + C.EPS)))
    s = s.withColumns({"pl": F.transform("z", lambda z: 2.0 * z - 1.0), "sl": step(-1), "el": step(1)})
    s = s.withColumns({p: decode.probabilities(F.col(logit)) for p, logit in (("pp", "pl"), ("sp", "sl"), ("ep", "el"))})
    return s.withColumn("types", F.transform("segments", lambda g: g["start"] % 4))


# --- scans, filters and labels ------------------------------------------------


def series_index(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum("mask").cast("bigint").alias("n_anomalous"), C.r6(F.min("v")).alias("lowest"), C.r6(F.max("v")).alias("highest"))


def taxonomy_canonical(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.concat(F.lit("\t "), F.when(F.col("event_id") % 5 == 0, F.lit("Frequency")).when(F.col("event_id") % 5 == 1, F.lit("LEVEL")).when(F.col("event_id") % 5 == 2, F.lit("Trend")).otherwise(F.upper("event_type")), F.lit(" \n"))
    return e.select("event_id", taxonomy.canonical_name(raw).alias("name"))


def type_name(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7 - 2).alias("type_id"))
    return e.select("event_id", "type_id", taxonomy.type_name(F.col("type_id")).alias("type_name"))


def type_resolve(spark, sf_dir):
    s = samples(spark, sf_dir).select("sample_id", segments.mask_segments(F.col("mask")).alias("segments")).where(F.size("segments") > 0)
    names = F.array(*map(F.lit, ("point", "Frequency", "trend", "level", "unknown", " RANGE")))
    k = F.size("segments").cast("bigint")
    events = F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1 + F.col("sample_id") % 2), lambda i: F.get(names, ((F.col("sample_id") + i) % 6).cast("int")))
    default = F.get(F.array(*map(F.lit, ("point", "freq", "trend", "level"))), (F.col("sample_id") % 4).cast("int"))
    ids = taxonomy.resolve_types(events, k, default)
    return s.select("sample_id", F.posexplode(ids).alias("k", "type")).select("sample_id", F.col("k").cast("bigint").alias("k"), F.col("type").cast("bigint").alias("type"))


def image_path_resolve(spark, sf_dir):
    s = samples(spark, sf_dir).select("sample_id")
    given = F.when(F.col("sample_id") % 4 == 0, F.concat(F.lit("/abs/"), "sample_id", F.lit(".png"))).when(F.col("sample_id") % 4 == 1, F.concat(F.lit("img/"), "sample_id", F.lit(".png"))).when(F.col("sample_id") % 4 == 2, F.lit(""))
    return s.select("sample_id", paths.image_path(given, F.lit("/data/raw"), split_of(F.col("sample_id")), F.col("sample_id").cast("string")).alias("path"))


def head_per_split(spark, sf_dir):
    s = points(spark, sf_dir).groupBy("sample_id").agg(F.count("*").alias("n")).withColumn("split", split_of(F.col("sample_id")))
    ranked = s.withColumn("place", F.row_number().over(Window.partitionBy("split").orderBy("sample_id")).cast("bigint"))
    return ranked.where("place <= 3").select("split", "place", "sample_id", "n")


def split_summary(spark, sf_dir):
    s = points(spark, sf_dir).groupBy("sample_id").agg(F.max("mask").alias("any"), F.count("*").alias("n")).withColumn("split", split_of(F.col("sample_id")))
    return s.groupBy("split").agg(F.count("*").alias("num_samples"), F.sum("any").cast("bigint").alias("num_anomalous"), F.sum("n").alias("num_points"))


def split_filter(spark, sf_dir):
    s = points(spark, sf_dir).groupBy("sample_id").agg(F.count("*").alias("n")).withColumn("split", split_of(F.col("sample_id")))
    return s.where(F.col("split").isin("train", "val"))


def id_filter(spark, sf_dir):
    return points(spark, sf_dir).where("sample_id = 7").select("sample_id", "t", C.r6(F.col("v")).alias("v"))


# --- windows ------------------------------------------------------------------


def zscore(spark, sf_dir):
    z = scaling.zscore(points(spark, sf_dir))
    return z.select("sample_id", "t", *(C.r6(F.col(c)).alias(c) for c in ("mean", "sd", "z")))


def zscore_anchored(spark, sf_dir):
    """Half of the series on the scale of the sample before them."""
    p = points(spark, sf_dir)
    anchors = p.where("sample_id % 2 = 0").groupBy((F.col("sample_id") + 1).alias("sample_id")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    return scaling.zscore(p, anchors).select("sample_id", "t", C.r6(F.col("z")).alias("z"))


def tnorm(spark, sf_dir):
    return scaling.normalized_index(points(spark, sf_dir)).select("sample_id", "t", C.r6(F.col("t_norm")).alias("t_norm"))


def first_diff(spark, sf_dir):
    return scaling.first_difference(points(spark, sf_dir)).select("sample_id", "t", C.r6(F.col("delta")).alias("delta"))


def local_z(spark, sf_dir):
    return scaling.local_zscore(points(spark, sf_dir)).select("sample_id", "t", C.r6(F.col("local_z")).alias("local_z"))


# --- segments -----------------------------------------------------------------


def mask_segments(spark, sf_dir):
    return segments.islands(points(spark, sf_dir), segments.labelled(F.col("mask")))


def conversation_segments(spark, sf_dir):
    """The turns of the assistant as a mask: a second source of runs."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")) - 1).cast("bigint").alias("t"), "role")
    return segments.islands(turns, F.col("role") == "assistant")


def binary_segments(spark, sf_dir):
    s = scored(spark, sf_dir).select("sample_id", segments.binary_segments(F.col("pp"), min_length=2).alias("segments"))
    return segments.exploded(s)


def segments_to_mask(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("segments", segments.mask_segments(F.col("mask")))
    return by_point(s.withColumn("rebuilt", segments.segments_to_mask(F.col("segments"), F.col("n"))), "rebuilt")


def boundary_targets(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("segments", segments.mask_segments(F.col("mask")))
    a, b = segments.boundary_targets(F.col("segments"), F.col("n"))
    return by_point(s.withColumns({"start_target": a, "end_target": b}), "start_target", "end_target")


def boundary_window(spark, sf_dir):
    s = segments.exploded(samples(spark, sf_dir).select("sample_id", "n", segments.mask_segments(F.col("mask")).alias("segments")))
    s = s.withColumn("radius", C.window_radius(F.col("start"), F.col("end") * 3 + 7))
    left, right = C.window_bounds(F.col("start"), F.col("radius"), F.col("n"))
    return s.select("sample_id", "k", "radius", left.alias("left"), right.alias("right"))


# --- time series --------------------------------------------------------------


def acf_period(spark, sf_dir):
    return samples(spark, sf_dir).select("sample_id", A.acf_period(F.col("series")).cast("bigint").alias("period"))


def period_project(spark, sf_dir):
    a = augmented(samples(spark, sf_dir)).select("sample_id", "n", (F.col("sample_id") % 20 + 2).alias("period"), C.half_even(F.col("n") * 0.9).alias("target"))
    return a.select("sample_id", "period", A.project_period(F.col("period"), F.col("n"), F.col("target")).cast("bigint").alias("projected"))


def decompose(spark, sf_dir):
    p = preprocess(samples(spark, sf_dir))
    p = p.withColumn("trend", A.trend(F.col("z"), F.col("period"))).withColumn("seasonal", F.zip_with("z", "deseason", lambda z, d: z - d))
    return by_point(p, "trend", "seasonal", "deseason")


def temporal_features(spark, sf_dir):
    p = preprocess(samples(spark, sf_dir)).select("sample_id", "period", F.posexplode("features").alias("t", "f"))
    return p.select("sample_id", F.col("t").cast("bigint").alias("t"), F.col("period").cast("bigint").alias("period"), *(C.r6(F.col(f"f.{c}")).alias(c) for c in ("t_norm", "deseason", "delta", "local_z")))


def resample_linear(spark, sf_dir):
    s = samples(spark, sf_dir)
    return by_point(s.withColumn("v", A.resample(F.col("series"), F.greatest(F.lit(8).cast("bigint"), C.half_even(F.col("n") * 1.07)))), "v")


def smooth_edge(spark, sf_dir):
    return by_point(samples(spark, sf_dir).withColumn("v", A.smooth(F.col("series"))), "v")


def coord_map(spark, sf_dir):
    m = C.half_even(F.col("n") * 0.93)
    p = points(spark, sf_dir).withColumn("m", m)
    there = C.map_coordinate(F.col("t"), F.col("n"), F.col("m"))
    return p.select("sample_id", "t", C.r6(there).alias("there"), C.r6(C.map_coordinate(there, F.col("m"), F.col("n"))).alias("back"))


def warp_back(spark, sf_dir):
    a = augmented(samples(spark, sf_dir))
    return by_point(a.withColumn("v", losses.warp_to_source(F.col("aug_series"), F.col("transform.kind"), F.col("transform.source_length"))), "v")


def augment_series(spark, sf_dir):
    a = augmented(samples(spark, sf_dir)).withColumn("kind", F.col("transform.kind"))
    return by_point(a, "aug_series", keys=("sample_id", "kind"))


def augment_branch(spark, sf_dir):
    a = augmented_features(samples(spark, sf_dir)).select("sample_id", "aug_period", F.posexplode("aug_features").alias("t", "f"))
    return a.select("sample_id", F.col("t").cast("bigint").alias("t"), F.col("aug_period").cast("bigint").alias("period"), *(C.r6(F.col(f"f.{c}")).alias(c) for c in ("t_norm", "deseason", "delta", "local_z")))


def toy_series(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id")).distinct()
    return by_point(generator.base_series(users, 256), "series")


def toy_inject(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id")).distinct()
    g = generator.labelled_samples(users, 256)
    return by_point(g, "series", "mask", keys=("sample_id", "type"))


# --- targets, batches and decoding -------------------------------------------


def segment_targets(spark, sf_dir):
    p = preprocess(samples(spark, sf_dir)).withColumn("segments", segments.mask_segments(F.col("mask")))
    s = segments.exploded(p.select("sample_id", "deseason", "segments"))
    t = s.withColumn("e", targets.evidence_targets(F.col("deseason"), F.col("start"), F.col("end")))
    return t.select("sample_id", "k", "start", "end", *(C.r6(F.col(f"e.{c}")).alias(c) for c in ("peak", "meandev", "conf")))


def batch_assign(spark, sf_dir):
    return targets.assign_batches(samples(spark, sf_dir).select("sample_id", "n"), BATCH).select("sample_id", "n", "batch_id")


def batch_shuffle(spark, sf_dir):
    return targets.shuffled_batches(samples(spark, sf_dir).select("sample_id", "n"), BATCH, seed=17, epoch=1).select("sample_id", "n", "batch_id")


def _collated(spark, sf_dir):
    s = scored(spark, sf_dir).select("sample_id", "n", "series", "mask", "segments", "types")
    return targets.collate(targets.assign_batches(s, BATCH))


def pad_summary(spark, sf_dir):
    c = _collated(spark, sf_dir)
    return c.select(
        "sample_id", "batch_id", F.size("series").cast("bigint").alias("padded_length"), A.total(F.col("valid")).cast("bigint").alias("valid_length"), F.size("segments").cast("bigint").alias("padded_segments"),
        A.total(F.col("segment_valid")).cast("bigint").alias("valid_segments"), C.r6(A.total(F.col("series"))).alias("series_sum"), F.aggregate("types", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("type_sum"),
    )


def valid_logits(spark, sf_dir):
    c = _collated(spark, sf_dir)
    masked = decode.masked_logits(F.col("series"), F.col("valid"))
    return by_point(c.withColumn("logit", masked), "logit")


def decode_refined(spark, sf_dir):
    s = scored(spark, sf_dir)
    return segments.exploded(s.select("sample_id", decode.refined_segments(F.col("pp"), F.col("sp"), F.col("ep")).alias("segments")))


def predicted_intervals(spark, sf_dir):
    s = scored(spark, sf_dir)
    e = segments.exploded(s.select("sample_id", decode.predicted_intervals(F.col("pp"), F.col("sp"), F.col("ep")).alias("segments")))
    return e.select("sample_id", "k", C.r6(F.col("start")).alias("start"), C.r6(F.col("end")).alias("end"))


def _dims(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("h").alias("d", "x")).select(*keys, F.col("d").cast("bigint").alias("d"), C.r6(F.col("x")).alias("x"))


def masked_mean(spark, sf_dir):
    return _dims(decode.masked_mean(hidden_states(spark, sf_dir), F.col("t") < F.col("n") - 3), "sample_id")


def hidden_segments(h: DataFrame) -> DataFrame:
    """Three overlapping runs of every sequence of hidden states."""
    n = h.groupBy("sample_id").agg(F.max("n").alias("n"))
    k = n.select("sample_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("k"))
    return k.select("sample_id", "k", (F.col("k") * 2).alias("start"), F.least(F.col("n") - 1, F.col("k") * 3 + 4).alias("end"))


def pool_segments(spark, sf_dir):
    h = hidden_states(spark, sf_dir)
    return _dims(decode.pool_segments(h.select("sample_id", "t", "h"), hidden_segments(h)), "sample_id", "k")


def argmax_type(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x.cast("double"), 1))
    return e.select("vec_id", decode.argmax(logits).alias("type"))


def evidence_activation(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double") * 20)
    conf, attributes = decode.evidence_activations(F.get(x, 0), F.slice(x, 2, 2))
    return e.select("vec_id", C.r6(conf).alias("confidence"), C.r6(F.get(attributes, 0)).alias("peak_amplitude"), C.r6(F.get(attributes, 1)).alias("mean_deviation"))


# --- losses -------------------------------------------------------------------


def bce_masked(spark, sf_dir):
    p = scored(spark, sf_dir).select(F.explode(F.arrays_zip("pl", "mask")).alias("x"))
    return p.agg(C.r6(losses.masked_bce(F.col("x.pl"), F.col("x.mask"), F.lit(1.0))).alias("loss"))


def expected_coord(spark, sf_dir):
    s = scored(spark, sf_dir)
    n = F.col("n")
    whole = A.expected_coordinate(F.col("pp"), F.lit(0).cast("bigint"), n - 1)
    part = A.expected_coordinate(F.col("pp"), F.floor(n / 4), F.floor(n / 2))
    return s.select("sample_id", C.r6(whole).alias("whole"), C.r6(part).alias("part"))


def segment_interval_loss(spark, sf_dir):
    s = scored(spark, sf_dir)
    terms = losses.segment_interval_terms(F.col("sp"), F.col("ep"), F.col("segments"), F.col("n"))
    return s.select(F.explode(terms).alias("x")).agg(C.r6(F.coalesce(F.avg("x"), F.lit(0.0))).alias("loss"))


def _augmented_scores(s: DataFrame) -> DataFrame:
    """Scored samples with the scores of their augmented branch, on the original's scale: aug_pp, aug_sp, aug_ep."""
    a = augmented(s)
    v = F.col("aug_series")
    z = A.standardize(v, F.col("mean"), F.col("sd"))
    step = lambda o: C.let_all((v, F.col("sd")), lambda b, d: F.transform(b, lambda x, t: C.sigmoid(1.5 * (x - F.coalesce(F.get(b, t + o), x)) / (d + C.EPS))))
    return a.withColumns({"aug_pp": F.transform(z, lambda x: C.sigmoid(2.0 * x - 1.0)), "aug_sp": step(-1), "aug_ep": step(1)})


def _paired(s: DataFrame) -> DataFrame:
    """Predicted intervals of both branches on the source axis: origin, warped."""
    a = _augmented_scores(s)
    a = a.withColumn("origin", decode.predicted_intervals(F.col("pp"), F.col("sp"), F.col("ep")))
    aug = decode.predicted_intervals(F.col("aug_pp"), F.col("aug_sp"), F.col("aug_ep"))
    return a.withColumn("warped", losses.intervals_to_source(aug, F.col("transform.target_length"), F.col("transform.source_length")))


def interval_map(spark, sf_dir):
    w = segments.exploded(_paired(scored(spark, sf_dir)).select("sample_id", F.col("warped").alias("segments")))
    return w.select("sample_id", "k", C.r6(F.col("start")).alias("start"), C.r6(F.col("end")).alias("end"))


def interval_iou(spark, sf_dir):
    p = _paired(scored(spark, sf_dir)).select("sample_id", F.explode(F.zip_with(F.slice("origin", 1, F.least(F.size("origin"), F.size("warped"))), F.slice("warped", 1, F.least(F.size("origin"), F.size("warped"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("x"))
    ends = [F.col(f"x.{c}") for c in ("a.start", "a.end", "b.start", "b.end")]
    return p.select("sample_id", C.r6(F.col("x.a.start")).alias("start"), C.r6(C.interval_iou(*ends)).alias("iou"), C.r6(C.center_gap(*ends)).alias("gap"))


def match_pairs(spark, sf_dir):
    m = _paired(scored(spark, sf_dir)).select("sample_id", F.explode(losses.match_intervals(F.col("origin"), F.col("warped"))).alias("p"))
    return m.select("sample_id", F.col("p.origin").cast("bigint").alias("origin"), F.col("p.warped").cast("bigint").alias("warped"))


def _anchored(a: DataFrame) -> Column:
    kind, n = F.col("transform.kind"), F.col("n")
    start, end = (losses.warp_to_source(F.col(c), kind, n) for c in ("aug_sp", "aug_ep"))
    return losses.anchored_terms(F.col("sp"), F.col("ep"), start, end, F.col("segments"), n)


def gt_anchored(spark, sf_dir):
    a = _augmented_scores(scored(spark, sf_dir))
    t = a.select("sample_id", F.posexplode(_anchored(a)).alias("k", "x"))
    return t.select("sample_id", F.col("k").cast("bigint").alias("k"), C.r6(F.col("x")).alias("term"))


def _consistency(s: DataFrame) -> DataFrame:
    """Adds bc_mask and bc_int to scored samples; bc_int is null where there is no term."""
    p = _paired(s)
    p = p.withColumn("pairs", losses.match_intervals(F.col("origin"), F.col("warped")))
    warped_mask = losses.warp_to_source(F.col("aug_pp"), F.col("transform.kind"), F.col("n"))
    anchored = _anchored(p)
    term = F.when(F.size("pairs") > 0, losses.pair_distance(F.col("origin"), F.col("warped"), F.col("pairs"))).when(F.size("segments") > 0, A.total(anchored))
    return p.withColumns({"bc_mask": losses.mask_distance(F.col("pp"), warped_mask), "bc_int": term})


def boundary_consistency(spark, sf_dir):
    c = _consistency(scored(spark, sf_dir)).select("bc_mask", "bc_int")
    m, i = F.coalesce(F.avg("bc_mask"), F.lit(0.0)), F.coalesce(F.avg("bc_int"), F.lit(0.0))
    return c.agg(C.r6(m + i).alias("bc"), C.r6(m).alias("bc_mask"), C.r6(i).alias("bc_int"))


def _segment_rows(s: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """True segments with closed-form head outputs: type_logits, conf_logit, attributes, and their targets."""
    e = segments.exploded(s.select("sample_id", "z", "segments", *(keys or [])))
    m = A.mean(A.cut(F.col("z"), F.col("start"), F.col("end")))
    e = e.withColumns({"m": m, "type": F.col("start") % 4, "target": targets.evidence_targets(F.col("z"), F.col("start"), F.col("end"))})
    logits = F.array(*(F.col("m") * (j - 1.5) + 0.1 * (F.col("k") % (j + 2)) for j in range(4)))
    conf, attributes = decode.evidence_activations(F.col("m"), F.array(F.col("m") + 0.5, F.col("m")))
    return e.withColumns({"type_logits": logits, "conf_logit": F.col("m"), "confidence": conf, "attributes": attributes})


def type_ce(spark, sf_dir):
    e = _segment_rows(scored(spark, sf_dir))
    return e.agg(C.r6(losses.masked_mean(losses.cross_entropy(F.col("type_logits"), F.col("type")), F.lit(1.0))).alias("loss"))


def _evidence_losses() -> tuple[Column, Column]:
    conf = losses.masked_bce(F.col("conf_logit"), F.col("target.conf"), F.lit(1.0))
    attr = losses.masked_mean(losses.attribute_loss(F.col("attributes"), F.array("target.peak", "target.meandev")), F.lit(1.0))
    return conf, attr


def evidence_reg(spark, sf_dir):
    conf, attr = _evidence_losses()
    return _segment_rows(scored(spark, sf_dir)).agg(C.r6(conf + attr).alias("evidence"), C.r6(conf).alias("evidence_conf"), C.r6(attr).alias("evidence_attr"))


def cross_modal_mse(spark, sf_dir):
    e = embedding_pairs(spark, sf_dir)
    return e.agg(C.r6(F.avg(losses.mean_squared(F.col("text"), F.col("image")))).alias("loss"))


def temporal_tv(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.agg(C.r6(F.sum(losses.variation(F.col("pp"))) / F.greatest(F.sum(F.col("n") - 1).cast("double"), F.lit(1.0))).alias("loss"))


def _batch_losses(s: DataFrame, keys: list[str]) -> DataFrame:
    """All losses but the cross-modal one, of each group of samples. ``s`` should be stored: it is read for the samples and for their segments."""
    a, b = segments.boundary_targets(F.col("segments"), F.col("n"))
    per = _consistency(s).withColumns({"start_target": a, "end_target": b}).select(
        *keys, "n", losses.bce_sum(F.col("pl"), F.col("mask")).alias("point"), losses.bce_sum(F.col("sl"), F.col("start_target")).alias("start"), losses.bce_sum(F.col("el"), F.col("end_target")).alias("end"),
        losses.variation(F.col("pp")).alias("tv"), A.total(losses.segment_interval_terms(F.col("sp"), F.col("ep"), F.col("segments"), F.col("n"))).alias("interval"), F.size("segments").alias("k"), "bc_mask", "bc_int",
    )
    n, k = F.greatest(F.sum("n").cast("double"), F.lit(1.0)), F.greatest(F.sum("k").cast("double"), F.lit(1.0))
    both = F.coalesce(F.avg("bc_mask"), F.lit(0.0)).alias("bc_mask"), F.coalesce(F.avg("bc_int"), F.lit(0.0)).alias("bc_int")
    main = per.groupBy(*keys).agg((F.sum("point") / n).alias("point"), ((F.sum("start") + F.sum("end")) / n).alias("seg_boundary"), (F.sum("interval") / k).alias("seg_interval"), (F.sum("tv") / F.greatest(F.sum(F.col("n") - 1).cast("double"), F.lit(1.0))).alias("tv"), *both)
    rows = _segment_rows(s, keys)
    conf, attr = _evidence_losses()
    heads = rows.groupBy(*keys).agg(losses.masked_mean(losses.cross_entropy(F.col("type_logits"), F.col("type")), F.lit(1.0)).alias("type"), conf.alias("evidence_conf"), attr.alias("evidence_attr"))
    joined = main.join(heads, keys, "left") if keys else main.crossJoin(heads)  # one row each
    return joined.fillna(0.0, ["type", "evidence_conf", "evidence_attr"])


LOSSES = ("point", "seg", "seg_boundary", "seg_interval", "type", "evidence", "evidence_conf", "evidence_attr", "bc", "bc_mask", "bc_int", "cons", "tv")


def _totals(rows: DataFrame) -> DataFrame:
    """Adds the losses that are sums of others, and the weighted total."""
    col = F.col
    rows = rows.withColumns({"seg": col("seg_boundary") + col("seg_interval"), "evidence": col("evidence_conf") + col("evidence_attr"), "bc": col("bc_mask") + col("bc_int")})
    return rows.withColumn("loss", losses.weighted_total(losses.LossWeights(), *(col(x) for x in ("point", "seg", "type", "evidence", "bc", "cons", "tv"))))


def _divergences(spark, sf_dir) -> DataFrame:
    return embedding_pairs(spark, sf_dir).select("sample_id", losses.mean_squared(F.col("text"), F.col("image")).alias("mse"))


def total_loss(spark, sf_dir):
    s = stored(scored(spark, sf_dir), "scored")
    cons = _divergences(spark, sf_dir).agg(F.avg("mse").alias("cons"))
    # each side is one row of aggregates
    rows = _totals(_batch_losses(s, []).crossJoin(cons))
    return rows.select(C.r6(F.col("loss")).alias("loss"), *(C.r6(F.col(x)).alias(x) for x in LOSSES))


# --- metrics and evidence -----------------------------------------------------


def point_f1(spark, sf_dir):
    c = scored(spark, sf_dir).select(metrics.point_counts(F.col("pp"), F.col("mask")).alias("c"))
    p, r, f = C.f1_scores(F.sum("c.tp"), F.sum("c.fp"), F.sum("c.fn"))
    return c.agg(C.r6(p).alias("precision"), C.r6(r).alias("recall"), C.r6(f).alias("f1"))


def segment_iou(spark, sf_dir):
    s = scored(spark, sf_dir)
    a = segments.exploded(s.select("sample_id", segments.binary_segments(F.col("pp")).alias("segments")))
    b = segments.exploded(s.select("sample_id", "segments")).select("sample_id", F.col("k").alias("g"), F.col("start").alias("gs"), F.col("end").alias("ge"))
    both = a.join(b, "sample_id").where("start <= ge AND gs <= end")
    return both.select("sample_id", "k", "g", C.r6(C.segment_iou(F.col("start"), F.col("end"), F.col("gs"), F.col("ge"))).alias("iou"))


def _event_counts(s: DataFrame) -> DataFrame:
    refined = decode.refined_segments(F.col("pp"), F.col("sp"), F.col("ep"))
    return s.withColumn("e", metrics.event_counts(refined, F.col("segments")))


def event_f1(spark, sf_dir):
    c = _event_counts(scored(spark, sf_dir))
    p, r, f = C.f1_scores(F.sum("e.tp"), F.sum("e.fp"), F.sum("e.fn"))
    return c.agg(F.sum("e.tp").alias("tp"), F.sum("e.fp").alias("fp"), F.sum("e.fn").alias("fn"), C.r6(p).alias("precision"), C.r6(r).alias("recall"), C.r6(f).alias("f1"))


def _validated(spark, sf_dir) -> DataFrame:
    """Metrics and losses of each batch."""
    s = scored(spark, sf_dir)
    batched = stored(s.join(targets.assign_batches(s.select("sample_id"), BATCH), "sample_id"), "scored-batches")
    c = _event_counts(batched).withColumn("c", metrics.point_counts(F.col("pp"), F.col("mask"))).join(_divergences(spark, sf_dir), "sample_id", "left")
    point, event = ([f"{kind}_{x}" for x in ("precision", "recall", "f1")] for kind in ("point", "event"))
    scores = [x.alias(n) for n, x in zip(point + event, (*C.f1_scores(*(F.sum(f"c.{k}") for k in ("tp", "fp", "fn"))), *C.f1_scores(*(F.sum(f"e.{k}") for k in ("tp", "fp", "fn")))), strict=True)]
    # a batch without an embedding pair has no divergence
    measured = c.groupBy("batch_id").agg(*scores, F.coalesce(F.avg("mse"), F.lit(0.0)).alias("cons"))
    return _totals(measured.join(_batch_losses(batched, ["batch_id"]), "batch_id"))


VALIDATED = ("point_precision", "point_recall", "point_f1", "event_precision", "event_recall", "event_f1", "loss", *LOSSES)


def validate_batches(spark, sf_dir):
    """The mean of each metric and loss over the batches."""
    return _validated(spark, sf_dir).agg(F.count("*").alias("steps"), *(C.r6(F.avg(c)).alias(c) for c in VALIDATED))


def _evidences(s: DataFrame) -> DataFrame:
    """EvidenceFrame from closed-form heads on the refined segments."""
    refined = segments.exploded(s.select("sample_id", "z", decode.refined_segments(F.col("pp"), F.col("sp"), F.col("ep")).alias("segments")))
    m = A.mean(A.cut(F.col("z"), F.col("start"), F.col("end")))
    r = refined.withColumn("m", m)
    return r.select(
        "sample_id", "k", "start", "end", F.when(F.col("start") % 5 == 4, F.lit(9).cast("bigint")).otherwise(F.col("start") % 5).alias("type"), C.sigmoid(F.col("m")).alias("confidence"),
        (F.col("end") - F.col("start") + 1).alias("length"), C.softplus(F.col("m") + 0.5).alias("peak_amplitude"), C.softplus(F.col("m")).alias("mean_deviation"),
    )


def evidence_records(spark, sf_dir):
    e = _evidences(scored(spark, sf_dir))
    return e.select("sample_id", "k", "start", "end", "type", taxonomy.type_name(F.col("type")).alias("type_name"), "length", *(C.r6(F.col(c)).alias(c) for c in ("confidence", "peak_amplitude", "mean_deviation")))


def _summaries(spark, sf_dir) -> DataFrame:
    s = scored(spark, sf_dir)
    e = _divergences(spark, sf_dir)
    base = s.select("sample_id").join(e, "sample_id", "left")
    return evidence.complete(base, evidence.summarize(_evidences(s)), F.col("mse"))


def continuity(spark, sf_dir):
    return _summaries(spark, sf_dir).select("sample_id", C.r6(F.col("continuity_degree")).alias("continuity_degree"), C.r6(F.col("fragmentation_degree")).alias("fragmentation_degree"))


def type_distribution(spark, sf_dir):
    return _summaries(spark, sf_dir).select("sample_id", *(F.col(f"count_{t}") for t in taxonomy.TYPES), *(C.r6(F.col(f"ratio_{t}")).alias(f"ratio_{t}") for t in taxonomy.TYPES))


def embedding_divergence(spark, sf_dir):
    return embedding_pairs(spark, sf_dir).select("sample_id", C.r6(losses.mean_squared(F.col("text"), F.col("image"))).alias("divergence"))


def summary_q(spark, sf_dir):
    return _summaries(spark, sf_dir).select("sample_id", *(C.r6(F.col(c).cast("double")).alias(f"q_{c}") for c in evidence.Q))


def epochs(spark, sf_dir) -> DataFrame:
    """A history from the order months: epoch, val_event_f1 (quarter steps, so that there are ties) and train_bc."""
    o = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    e = o.withColumn("epoch", F.row_number().over(Window.orderBy("month")).cast("bigint"))  # some 80 months
    return e.select("epoch", ((F.col("n") % 5) * 0.25).alias("val_event_f1"), ((F.col("n") % 3) * 0.1).alias("train_bc"))


def best_epoch(spark, sf_dir):
    h = epochs(spark, sf_dir)
    return history.best_epoch(h).select("epoch", C.r6(F.col("val_event_f1")).alias("val_event_f1")).crossJoin(history.bc_visible(h))  # one row each


def lr_schedule(spark, sf_dir):
    return epochs(spark, sf_dir).select("epoch", F.round(history.cosine_rate(F.col("epoch"), 200, 3e-4, 1e-5), 12).alias("lr"))


def epoch_merge(spark, sf_dir):
    h = epochs(spark, sf_dir)
    m = history.merge_epochs(h.select("epoch", F.col("train_bc").alias("bc")), h.select("epoch", F.col("val_event_f1").alias("event_f1")))
    return m.select("epoch", C.r6(F.col("train_bc")).alias("train_bc"), C.r6(F.col("val_event_f1")).alias("val_event_f1"))


def package(spark, sf_dir) -> DataFrame:
    """Nested evidence packages of every series: the flagship result."""
    return evidence.packages(_summaries(spark, sf_dir))


def package_evidence(spark, sf_dir):
    """The evidence lists of the packages as rows, each with the length of its package's summary vector."""
    p = package(spark, sf_dir).select("id", F.size("q").cast("bigint").alias("n_q"), F.posexplode("evidence").alias("k", "e"))
    numbers = (C.r6(F.col(c)).alias(n) for c, n in (("e.confidence", "confidence"), ("e.attributes.peak_amplitude", "peak_amplitude"), ("e.attributes.mean_deviation", "mean_deviation")))
    return p.select("id", "n_q", F.col("k").cast("bigint").alias("k"), *(F.col(f"e.{c}").cast("bigint").alias(c) for c in ("start", "end", "type")), "e.type_name", F.col("e.attributes.length").cast("bigint").alias("length"), *numbers)


def package_summary(spark, sf_dir):
    """The summaries of the packages: what stands in the nested summary and in the vector."""
    p = package(spark, sf_dir)
    kinds = (F.col(f"summary.type_distribution.{t}.count").cast("bigint").alias(f"count_{t}") for t in taxonomy.TYPES)
    return p.select("id", F.size("evidence").cast("bigint").alias("n_evidence"), F.col("summary.anomaly_count").cast("bigint").alias("anomaly_count"), *kinds, *(C.r6(F.get("q", i)).alias(f"q_{c}") for i, c in enumerate(evidence.Q)))
