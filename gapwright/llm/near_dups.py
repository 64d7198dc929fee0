"""Operator 9: near duplicates by SetSketch registers.

A text's set is its distinct k-word shingles (words between ASCII white space, A-Z lower-cased; a
shorter text has its whole word sequence as its one shingle). Each of ``REGISTERS`` registers is
the least of independent exponential hashes of the set, on an exponential scale and truncated to
16 bits; registers of a union are their maxima, and two sets agree in a register with a probability
near their Jaccard similarity. Bands of ``ROWS`` registers propose candidates, the joint likelihood
of two sketches estimates their similarity, and full sets confirm each link.

Copies (equal sets) are one vertex. Links wanted are those that join components, so groups of near
copies are not expanded into all pairs: first each vertex meets the least vertex of its buckets,
then vertices still apart meet one vertex of the bucket's largest component a round. What is left
forms families: the members of all buckets with the same largest component. The guests of a family
(those outside of that component) meet all its members in blocks of bounded size, compared inside a
task: sketches first, then the full sets of those with a likely partner; only links come out. So
each pair that shares a bucket is linked, already in one component, or refused on its own figures.

Keys and buckets that hold a large share of the rows are met through ``skew.meet``: their few
partners are broadcast, a bounded number of rows, and no task gets them all. What is left of a
family costs guests times members comparisons; it is dealt over the cluster block by block, and no
pair is shuffled.

Defined results: a null or empty text has an empty set and is linked with nothing; rows equal in key
are one vertex, also where their texts differ, so they share a component; rows with a null key are
linked with nothing and kept, their component null; repeated rows give repeated results; an empty
table gives no rows; other columns are ignored. ``one_of_each`` tells rows by key and text instead:
of a component it keeps one row, the first by key and text hash, null keys last; equal rows count as
copies, empty texts stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import meet, small
from .storage import discard, stored, table
from .textkernel import buffers, mix, shingles, slices, word_hashes

REGISTERS, ROWS = 160, 5
BANDS = REGISTERS // ROWS
#: base of the register scale, rate of the exponential hashes, and the largest register
SCALE, RATE, TOP = 1.001, 20.0, 65_535
#: candidates whose estimate is lower by this much than the similarity asked for are refused; five standard errors
MARGIN = 0.16
#: rounds in which vertices meet the largest component of a bucket before families meet in blocks
MEETINGS = 2
#: members and guests of a family that a task compares at once, about
BLOCK = 512
#: numbers from here on stand for sets whose least key another set has too, and for null keys
SURROGATE = 2**62

_RNG = np.random.default_rng(90125)
_A = _RNG.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_LN = np.log(SCALE)


def unique_sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of each text, and n + 1 offsets."""
    every, at = shingles(*word_hashes(raw, off), k)
    sets = [np.unique(every[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return (np.concatenate(sets) if sets else every), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)])


def registers_of(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers (texts by REGISTERS, 16 bits) of sets that are not empty."""
    h = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, REGISTERS), np.uint32)
    work = np.empty_like(h)
    for i in range(REGISTERS):
        np.multiply(h, _A[i], out=work)
        np.add(work, _B[i], out=work)
        out[:, i] = np.minimum.reduceat(work, at[:-1])
    least = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / _LN), 0, TOP).astype("<u2")


def band_keys(registers: np.ndarray) -> np.ndarray:
    """64-bit keys (texts by BANDS) of the register bands."""
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(registers), BANDS)).copy()
    for r in range(ROWS):
        acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + registers[:, r::ROWS].astype(np.uint64))
    return acc.view(np.int64)


def estimate_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum joint likelihood of the Jaccard similarity, the set sizes being known."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    p = lambda x: -np.log1p(-x * (SCALE - 1) / SCALE) / _LN

    def likelihood(j: np.ndarray) -> np.ndarray:
        x, y = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        log = lambda z: np.log(np.maximum(z, 1e-300))
        return more * log(x) + less * log(y) + same * log(1 - x - y)

    lo, hi = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(40):
        c, d = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = likelihood(c) < likelihood(d)
        lo, hi = np.where(up, c, lo), np.where(up, hi, d)
    return (lo + hi) / 2


def sketches(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """A row per text: doc_id, th (hash of the text), n_shingles, two sums that tell its set, registers and band keys (null for an empty set)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            for i, j in slices(off, 1 << 19):
                sets, at = unique_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                size = np.diff(at)
                full = np.flatnonzero(size)
                # empty sets take no room, so the offsets of the others serve reduceat
                starts = np.concatenate([at[:-1][full], at[-1:]])
                n = j - i
                one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                regs, bands = [None] * n, [None] * n
                if len(full):
                    one[full], two[full] = np.add.reduceat(mix(sets), starts[:-1]), np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), starts[:-1])
                    r = registers_of(sets, starts)
                    for x, y, z in zip(full.tolist(), r, band_keys(r).tolist(), strict=True):
                        regs[x], bands[x] = y.tobytes(), z
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), batch.column("th").slice(i, n), pa.array(size, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "th", "n_shingles", "s1", "s2", "registers", "bands"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, th long, n_shingles long, s1 long, s2 long, registers binary, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """The full sets of the texts named in ``wanted`` (vertex, doc_id, th), by vertex."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    rows = rows.join(small(wanted), ["doc_id", "th"]).select("vertex", "text")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            for i, j in slices(off):
                sets, at = unique_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                blobs = [sets[a:b].astype("<u8").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("vertex").slice(i, j - i), pa.array(blobs, pa.binary())], ["doc_id", "set"])

    # rows equal in key and text have equal sets
    return rows.mapInArrow(collect, "doc_id long, set binary").dropDuplicates(["doc_id"])


def _likely(pairs: DataFrame, vertices: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose estimate reaches the similarity less the margin."""
    side = lambda c: vertices.select(F.col("doc_id").alias(c), F.col("registers").alias(f"r{c}"), F.col("n_shingles").alias(f"n{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("ra", "rb")]
            sizes = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb")]
            yield batch.select(["a", "b"]).filter(pa.array(estimate_similarity(*regs, *sizes) >= similarity - MARGIN))

    return joined.mapInArrow(keep, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union, on full sets."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("set").alias(f"s{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    continue
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                out[i] = 100 * common >= percent * (len(both) - common)
            yield batch.select(["a", "b"]).filter(pa.array(out))

    return joined.mapInArrow(keep, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """vertex and label (the least vertex reachable) of every vertex of ``edges`` (a, b).

    Least labels spread along edges and are then followed to their own labels, until nothing changes;
    each round is written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.col("vertex"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(small(labels.select(F.col("vertex").alias("b"), "label")), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("label").alias("near"))
        lower = stored(labels.join(near, "vertex").select("vertex", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        met = stored(lower.groupBy("label").agg(F.count("*").alias("n")).join(lower.select(F.col("vertex").alias("label"), F.col("label").alias("further")), "label"), "labels")
        new = stored(meet(lower, met, ["label"], "n").select("vertex", "old", F.least("label", "further").alias("label")), "labels")
        discard(lower, met, labels)
        if new.where("old <> label").isEmpty():
            discard(both)
            return new.select("vertex", "label")
        labels = new


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (doc_id, label) after the components that ``edges`` join are made one."""
    of = lambda c: labels.select(F.col("doc_id").alias(c), F.col("label").alias(f"l{c}"))
    between = edges.join(of("a"), "a").join(of("b"), "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    between = stored(between, "component-edges")
    if between.isEmpty():
        return labels
    found = connected(between).select(F.col("vertex").alias("label"), F.col("label").alias("least"))
    sizes = stored(labels.groupBy("label").agg(F.count("*").alias("n")).join(found, "label"), "component-sizes")
    joined = meet(labels, sizes, ["label"], "n", "left")
    out = stored(joined.select("doc_id", F.coalesce("least", "label").alias("label")), "components")
    discard(between, sizes, labels)
    return out


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with labels, of the buckets that hold two components or more."""
    labelled = stored(members.join(labels, "doc_id"), "labelled")
    apart = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x < y").select("bucket", "n")
    out = stored(meet(labelled, stored(apart, "apart"), ["bucket"], "n"), "open-buckets")
    discard(labelled)
    return out


def _hosts(apart: DataFrame, meeting: int = 0) -> DataFrame:
    """Of each bucket: how many rows, the label of its largest component, and a member of that (``a``)."""
    size = apart.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("doc_id", F.lit(meeting)).alias("h"), "doc_id")).alias("pick"))
    host = size.groupBy("bucket").agg(F.max(F.struct("n", "label", "pick.doc_id")).alias("m"), F.sum("n").alias("n"))
    return stored(host.select("bucket", "n", F.col("m.label").alias("host"), F.col("m.doc_id").alias("a")), "hosts")


def _families(rest: DataFrame) -> DataFrame:
    """Members (family, doc_id, label) of the open buckets by their largest component; guests have another label."""
    return meet(rest, _hosts(rest), ["bucket"], "n").select(F.col("host").alias("family"), "doc_id", "label").distinct()


def _in_blocks(families: DataFrame, data: DataFrame, compare, schema: str) -> DataFrame:
    """``compare`` of (guests, members) of every pair of blocks of a family, rows with the columns of ``data`` (by doc_id).

    A guest goes to each member block and a member to each guest block, so a group has about
    2 * BLOCK rows however large its family is.
    """
    counts = families.groupBy("family").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).alias("m"), F.ceil(F.count_if(F.col("label") != F.col("family")) / BLOCK).alias("g")).where("g > 0")
    rows = meet(families, stored(counts, "family-sizes"), ["family"], "n")
    place = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = rows.select("family", "doc_id", "label", F.lit(False).alias("guest"), every("g").alias("i"), place("m").alias("j"))
    guests = rows.where(F.col("label") != F.col("family")).select("family", "doc_id", "label", F.lit(True).alias("guest"), place("g").alias("i"), every("m").alias("j"))
    return members.unionByName(guests).join(data, "doc_id").groupBy("family", "i", "j").applyInArrow(compare, schema)


def _pairs_apart(block: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """Guests, members, and which of them (guests by members) have different labels."""
    guest = block.column("guest")
    g, m = block.filter(guest), block.filter(pa.compute.invert(guest))
    label = lambda t: t.column("label").to_numpy()
    return g, m, label(g)[:, None] != label(m)[None, :]


def _likely_in_blocks(families: DataFrame, vertices: DataFrame, similarity: float) -> DataFrame:
    """Members (family, doc_id) with a partner in another component whose estimate reaches the similarity less the margin."""

    def compare(block: pa.Table) -> pa.Table:
        g, m, apart = _pairs_apart(block)
        regs = [np.frombuffer(b"".join(t.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS) for t in (g, m)]
        sizes = [t.column("n_shingles").to_numpy().astype(float) for t in (g, m)]
        hit_g, hit_m = np.zeros(g.num_rows, bool), np.zeros(m.num_rows, bool)
        for i in range(g.num_rows):
            fits = np.flatnonzero(apart[i] & (np.minimum(sizes[1], sizes[0][i]) >= (similarity - MARGIN) * np.maximum(sizes[1], sizes[0][i])))
            if len(fits):
                near = fits[estimate_similarity(np.broadcast_to(regs[0][i], (len(fits), REGISTERS)), regs[1][fits], np.full(len(fits), sizes[0][i]), sizes[1][fits]) >= similarity - MARGIN]
                hit_g[i] = len(near) > 0
                hit_m[near] = True
        out = pa.concat_tables([g.select(["family", "doc_id"]).filter(pa.array(hit_g)), m.select(["family", "doc_id"]).filter(pa.array(hit_m))])
        return out

    return _in_blocks(families, vertices.select("doc_id", "n_shingles", "registers"), compare, "family long, doc_id long").distinct()


def _links_in_blocks(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A confirmed link (a, b) of each guest to each component it is linked with."""

    def compare(block: pa.Table) -> pa.Table:
        g, m, apart = _pairs_apart(block)
        of = lambda t: [np.frombuffer(x, "<u8") for x in t.column("set").to_pylist()]
        own, other = of(g), of(m)
        if not own or not other:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        size = np.array([len(x) for x in other])
        start = np.cumsum(size) - size
        # tokens as places in a table of marks: a guest marks its own, and the marks under each member are counted
        known, place = np.unique(np.concatenate(other), return_inverse=True)
        mark = np.zeros(len(known) + 1, np.int32)
        ids_g, ids_m, labels = g.column("doc_id").to_pylist(), m.column("doc_id").to_pylist(), m.column("label").to_numpy()
        a, b = [], []
        for i, x in enumerate(own):
            at = np.searchsorted(known, x)
            at = at[known[np.minimum(at, len(known) - 1)] == x]
            mark[at] = 1
            common = np.add.reduceat(mark[place], start)
            mark[at] = 0
            linked = np.flatnonzero(apart[i] & (100 * common >= percent * (size + len(x) - common)))
            for k in linked[np.unique(labels[linked], return_index=True)[1]]:
                a.append(ids_g[i])
                b.append(ids_m[k])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _in_blocks(families, sets, compare, "a long, b long")


CLASS = ["n_shingles", "s1", "s2"]


def _keys_of_several_sets(every: DataFrame) -> DataFrame:
    """doc_id of rows that are equal in key and not in set."""
    sets = F.struct(*CLASS)
    return stored(every.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(sets).alias("x"), F.max(sets).alias("y"), F.count("*").alias("n")).where("x <> y").select("doc_id", "n"), "mixed-keys")


def _vertices(every: DataFrame, mixed: DataFrame) -> DataFrame:
    """One row a set that is not empty: vertex (unique), doc_id (least key) and th of one of its texts, set sums, registers and bands."""
    sketched = every.where(F.col("registers").isNotNull() & F.col("doc_id").isNotNull())
    one = F.min_by(F.struct("doc_id", "th", "registers", "bands"), F.struct("doc_id", "th")).alias("s")
    vertices = stored(sketched.groupBy(*CLASS).agg(one).select("s.*", *CLASS), "vertices")
    if mixed.isEmpty():
        return vertices.withColumn("vertex", F.col("doc_id"))
    # sets with the same least key get numbers of their own, but for the first
    first = stored(vertices.groupBy("doc_id").agg(F.min(F.struct(*CLASS)).alias("first"), F.count("*").alias("n")).where("n > 1"), "first-sets")
    named = meet(vertices, first, ["doc_id"], "n", "left")
    own = F.lit(SURROGATE) + F.xxhash64("doc_id", *CLASS).bitwiseAND(2**61 - 1)
    return stored(named.withColumn("vertex", F.when(F.col("first").isNull() | (F.col("first") == F.struct(*CLASS)), F.col("doc_id")).otherwise(own)).drop("first"), "vertices")


def _components(docs: DataFrame, k: int, percent: int, key: str, text: str, one_key_one_vertex: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of ``sketches`` with the label of their component (null for empty sets and null keys), and the keys of several sets."""
    every = stored(sketches(docs, k, key, text), "sketches")
    mixed = _keys_of_several_sets(every)
    known = _vertices(every, mixed)
    vertices = known.select(F.col("vertex").alias("doc_id"), "n_shingles", "registers")

    bands = known.select(F.col("vertex").alias("doc_id"), F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").select("bucket", "least", "n")
    members = stored(meet(bands, stored(shared, "shared-buckets"), ["bucket"], "n"), "bucket-members")
    wanted = stored(members.select(F.col("doc_id").alias("vertex")).distinct().join(known.select("vertex", "doc_id", "th"), "vertex"), "members")
    sets = stored(sets_of(docs, wanted, k, key, text), "sets")
    similarity = percent / 100

    def linked(pairs: DataFrame) -> DataFrame:
        return stored(_confirmed(_likely(pairs, vertices, similarity), sets, percent), "links")

    labels = stored(members.select("doc_id", F.col("doc_id").alias("label")).distinct(), "components")
    first = members.where("least < doc_id").groupBy(F.col("doc_id").alias("b")).agg(F.min("least").alias("a")).select("a", "b")
    labels = _merged(labels, linked(first))
    apart = _open_buckets(members.drop("least"), labels)
    for meeting in range(MEETINGS):
        if apart.isEmpty():
            break
        guests = meet(apart, _hosts(apart, meeting), ["bucket"], "n").where("label <> host").groupBy(F.col("doc_id").alias("b")).agg(F.min_by("a", F.xxhash64("a", F.lit(meeting))).alias("a")).select("a", "b")
        labels = _merged(labels, linked(guests))
        met = apart
        apart = _open_buckets(met.drop("label"), labels)
        discard(met)
    if not apart.isEmpty():
        families = stored(_families(apart), "families")
        likely = stored(_likely_in_blocks(families, vertices, similarity), "likely")
        labels = _merged(labels, stored(_links_in_blocks(stored(families.join(likely, ["family", "doc_id"], "left_semi"), "likely-families"), sets, percent), "links"))
    if one_key_one_vertex and not mixed.isEmpty():
        labels = _merged(*_joined_by_key(every, mixed, known, labels))

    vertex = known.join(labels.select(F.col("doc_id").alias("vertex"), "label"), "vertex", "left").select(*CLASS, F.coalesce("label", "vertex").alias("label"))
    sizes = every.groupBy(*CLASS).agg(F.count("*").alias("n")).join(vertex, CLASS)
    return meet(every.drop("registers", "bands"), stored(sizes, "labelled-sets"), CLASS, "n", "left"), mixed


def _joined_by_key(every: DataFrame, mixed: DataFrame, known: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels that also name the sets of the keys of several sets, and edges between those of one key."""
    of_key = meet(every.where("n_shingles > 0").select("doc_id", *CLASS), mixed, ["doc_id"], "n").distinct()
    of_key = stored(of_key.join(known.select("vertex", *CLASS), CLASS).select(F.col("doc_id").alias("key"), "vertex"), "sets-of-keys")
    least = stored(of_key.groupBy("key").agg(F.min("vertex").alias("a"), F.count("*").alias("n")), "least-sets")
    edges = meet(of_key, least, ["key"], "n").where("a < vertex").select("a", F.col("vertex").alias("b"))
    more = of_key.select(F.col("vertex").alias("doc_id")).distinct().join(labels, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("label"))
    return stored(labels.unionByName(more), "components"), stored(edges.distinct(), "links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id (least key of the component) and kept."""
    rows, mixed = _components(docs, k, percent, key, text, True)
    rows = rows.where("doc_id IS NOT NULL").unionByName(rows.where("doc_id IS NULL").withColumn("label", F.lit(None).cast("long")))
    if not mixed.isEmpty():
        # an empty text whose key has another text too belongs to the key's component
        rows = stored(rows, "labelled")
        of_key = meet(rows, mixed, ["doc_id"], "n").groupBy("doc_id").agg(F.min("label").alias("of_key"), F.count("*").alias("n"))
        rows = meet(rows, stored(of_key, "components-of-keys"), ["doc_id"], "n", "left").withColumn("label", F.coalesce("label", "of_key"))
    out = rows.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one of each component is kept; all columns, whatever their names."""
    # a null key is a key of its own for each text, after all others
    own = F.coalesce(F.col(key).cast("long"), F.lit(SURROGATE) + F.xxhash64(text).bitwiseAND(2**61 - 1))
    rows = docs.select(F.struct("*").alias("row"), own.alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    labelled = _components(rows.select("doc_id", "text"), k, percent, "doc_id", "text", False)[0]
    labelled = stored(labelled.where("label IS NOT NULL").select("doc_id", "th", "label"), "labelled")
    place = F.struct("doc_id", "th")
    groups = stored(labelled.groupBy("label").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1"), "groups")
    grouped = meet(labelled, groups, ["label"], "n")
    first = F.col("least") == place
    dropped = stored(grouped.where(~first).select("doc_id", "th").distinct(), "dropped")
    kept = rows.join(small(dropped), ["doc_id", "th"], "left_anti")
    # equal rows are at one place; one of them stays
    again = stored(grouped.where(first).groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th"), "repeated")
    if not again.isEmpty():
        once = kept.join(small(again), ["doc_id", "th"], "left_semi").groupBy("doc_id", "th").agg(F.any_value("row").alias("row"))
        kept = kept.join(small(again), ["doc_id", "th"], "left_anti").select("row").unionByName(once.select("row"))
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
