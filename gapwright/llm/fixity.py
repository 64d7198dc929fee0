"""Operator 5: Merkle fixity audit of WARC records.

``write_warc`` writes pages as WARC/1.0 resource records, a file a partition, and ``read_warc`` reads
such files: the offset, length and SHA-256 digest of each record, also where bytes are damaged.

An audit compares two replicas, each a table of records (key, length, digest). Records in order of
key and digest, laid end to end, have offset ranges. A tree stands over each replica: its nodes are
ranges of keys, the same in both trees, halved by bits of the key and, where many records share a
key, by bits of their digests. A node's hash covers its children in order: what range each is of, how
many records and bytes it holds, and its hash; so it covers their offset ranges from the node's own
start on. A record that is lost, added or longer moves the others but changes no hash beside its
own path. The audit compares the roots and descends from each mismatching node to its children
only; records of the last ranges that differ are compared one by one.

Defined results: a null url or html counts as empty; line ends in a url are written percent-encoded;
rows with equal keys stay separate records, ordered by digest; equal records are matched by their
number; null keys come first; an empty table has no records and an intact audit; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .skew import small
from .storage import discard, remove, shared_dir, stored, table

#: children of a node as a power of two, and the most records of a last range (but for equal ones)
FAN_OUT_LOG2, MOST_RECORDS = 6, 4096
#: fixed values of the record layout
VERSION, TYPE, MEDIA, CRLF = "WARC/1.0", "resource", "text/html", "\r\n"
#: capture date of pages that have none
DATE = "2024-01-01T00:00:00Z"
_DIGEST_BITS = 60
_BLOCK = 1 << 20


def warc_record(key: Column, url: Column, payload: Column, date: str = DATE) -> Column:
    """The text of one record: version line, named fields, empty line, payload, two line ends."""
    body = F.coalesce(payload, F.lit(""))
    uri = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = [
        F.lit(f"{VERSION}{CRLF}WARC-Type: {TYPE}{CRLF}WARC-Record-ID: <urn:record:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(f">{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), uri,
        F.lit(f"{CRLF}Content-Type: {MEDIA}{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF),
    ]
    return F.concat(*head, body, F.lit(CRLF + CRLF))


def write_warc(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes the records of each partition to a file under ``root``; returns path, n_records and n_bytes of each."""
    records = pages.select(warc_record(F.col(key), F.col(url), F.col(payload)).alias("record"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        path = f"{base}/part-{TaskContext.get().partitionId():06d}.warc"
        # written under another name first: a task that is run again or twice leaves whole files only
        tmp, n, size = f"{path}.{uuid.uuid4().hex}", 0, 0
        with fs.open_output_stream(tmp) as out:
            for batch in batches:
                for record in batch.column("record"):
                    out.write(record.as_buffer())
                    n, size = n + 1, size + len(record.as_buffer())
        fs.move(tmp, path)
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    return stored(records.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-files")


_START = f"{VERSION}{CRLF}".encode()
_END = (CRLF + CRLF).encode()
_KEY = re.compile(rb"\r\nWARC-Record-ID: <urn:record:(-?[0-9]+)>\r\n")
_URL = re.compile(rb"\r\nWARC-Target-URI: ([^\r]*)\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length: ([0-9]{1,18})\r\n\r\n\Z")


def parse_warc(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record. One whose length or end is damaged goes on to the start of the next that can be told."""
    data, at, done = b"", 0, False

    def more(n: int) -> None:
        nonlocal data, done
        while len(data) < n and not done:
            block = stream.read(max(_BLOCK, n - len(data)))
            done = not block
            data += block

    while True:
        more(_BLOCK)
        if not data:
            return
        head = data.find(_END)
        length = _LENGTH.search(data[: head + 4]) if head >= 0 else None
        size = head + 4 + int(length[1]) + 4 if length and data.startswith(_START) else 0
        if size:
            more(size + len(_START))
        if not size or data[size - 4 : size] != _END or not (len(data) == size or data.startswith(_START, size)):
            place, found = 1, -1
            while found < 0:
                found = data.find(_END + _START, place)
                if found < 0:
                    if done:
                        break
                    place = max(1, len(data) - len(_END + _START))
                    more(len(data) + _BLOCK)
            size = found + 4 if found >= 0 else len(data)
        yield at, data[:size]
        data, at = data[size:], at + size


def read_warc(files: DataFrame, root: str) -> DataFrame:
    """A row a record of the files named in ``files`` (path): key, url, path, at (offset in the file), length and digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(root)
        names = ["key", "url", "path", "at", "length", "digest"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with fs.open_input_stream(path) as f:
                    for at, record in parse_warc(f):
                        head = record[: record.find(_END) + 2]
                        key, url = _KEY.search(head), _URL.search(head)
                        key = int(key[1]) if key else None
                        rows.append((key if key is not None and -(2**63) <= key < 2**63 else None, url[1].decode("utf-8", "replace") if url else None, path, at, len(record), hashlib.sha256(record).hexdigest()))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    some = files.where("n_records > 0").select("path")
    return some.repartition(max(1, some.count())).mapInArrow(read, "key long, url string, path string, at long, length long, digest string")


def digests(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """key, length and digest of each record without writing any."""
    record = warc_record(F.col(key), F.col(url), F.col(payload))
    return pages.select(F.col(key).cast("long").alias("key"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))


def entries(records: DataFrame) -> DataFrame:
    """Distinct records with their number ``n``, and ``k`` and ``d``: key and digest as bits that order them."""
    one = records.groupBy("key", "digest", "length").agg(F.count("*").alias("n"))
    bits = F.coalesce("key", F.lit(-(2**63)).cast("long")).bitwiseXOR(F.lit(-(2**63)).cast("long"))
    return stored(one.select("*", bits.alias("k"), F.conv(F.left("digest", F.lit(_DIGEST_BITS // 4)), 16, 10).cast("long").alias("d")), "fixity-entries")


def laid_out(entry: DataFrame) -> DataFrame:
    """Adds ``ordinal`` and ``offset`` of the first of each: running sums within range partitions plus the sums of those before."""
    dealt = stored(entry.repartitionByRange("key", "digest").withColumn("part", F.spark_partition_id()), "fixity-dealt")
    inner = Window.partitionBy("part").orderBy("key", "digest").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("n") * F.col("length")
    # one row a partition
    bases = dealt.groupBy("part").agg(F.sum("n").alias("n_here"), F.sum(size).alias("bytes")).select(
        "part", F.coalesce(F.sum("n_here").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0")
    )
    local = dealt.withColumns({"n1": F.coalesce(F.sum("n").over(inner), F.lit(0)), "b1": F.coalesce(F.sum(size).over(inner), F.lit(0))})
    return local.join(F.broadcast(bases), "part").select("key", "digest", "length", "n", (F.col("n0") + F.col("n1")).alias("ordinal"), (F.col("b0") + F.col("b1")).alias("offset"))


def _node(k: Column, d: Column, shifts: tuple[int, int]) -> list[Column]:
    """The range that bits fall in when the lowest ``shifts`` of key and digest are left out."""
    left = lambda c, s, of: F.shiftrightunsigned(c, s) if s < of else F.lit(0).cast("long")
    return [left(k, shifts[0], 64).alias("k"), left(d, shifts[1], _DIGEST_BITS).alias("d")]


def levels_of(*replicas: DataFrame) -> list[tuple[int, int]]:
    """Shifts of the tree's levels, the lowest first: ranges of some 2 ** FAN_OUT_LOG2 records, of MOST_RECORDS at most."""
    spans = [e.agg(F.min("key"), F.max("key"), F.count("*"), F.count_if(F.col("key").isNull())).head() for e in replicas]
    ends = [(x if x is not None else -(2**63)) + 2**63 for low, high, n, nulls in spans if n for x in (low, high, *([None] if nulls else []))]
    most = max(s[2] for s in spans)
    bits = (min(ends) ^ max(ends)).bit_length() if ends else 0
    s, t = min(bits, max(0, bits - max(0, (most - 1).bit_length() - FAN_OUT_LOG2))), _DIGEST_BITS
    while s or t:
        fullest = [e.groupBy(*_node(F.col("k"), F.col("d"), (s, t))).count().agg(F.max("count")).head()[0] or 0 for e in replicas]
        if max(fullest) <= MOST_RECORDS:
            break
        s, t = (max(0, s - FAN_OUT_LOG2), t) if s else (0, max(0, t - FAN_OUT_LOG2))
    out = [(s, t)]
    while out[-1] != (bits, _DIGEST_BITS):
        s, t = out[-1]
        out.append((s, min(_DIGEST_BITS, t + FAN_OUT_LOG2)) if t < _DIGEST_BITS else (min(bits, s + FAN_OUT_LOG2), t))
    return out


def build_tree(entry: DataFrame, levels: list[tuple[int, int]]) -> list[DataFrame]:
    """Levels from the last ranges to the root: range (k, d), number of records, bytes and hash."""
    child = F.struct("k", "d", F.col("n").alias("records"), (F.col("n") * F.col("length")).alias("bytes"), F.concat_ws("/", "digest", "n", F.col("key").cast("string")).alias("hash"))
    nodes, out, below = entry.select(child.alias("c")), [], (0, 0)
    for shifts in levels:
        up = _node(F.col("c.k"), F.col("c.d"), (shifts[0] - below[0], shifts[1] - below[1]))
        inside = F.array_sort(F.collect_list("c"))
        told = F.transform(inside, lambda c: F.concat_ws(":", c["k"], c["d"], c["records"], c["bytes"], c["hash"]))
        level = nodes.groupBy(*up).agg(F.sum("c.records").alias("records"), F.sum("c.bytes").alias("bytes"), F.sha2(F.concat_ws(",", told), 256).alias("hash"))
        out.append(stored(level, "fixity-level"))
        nodes, below = out[-1].select(F.struct("k", "d", "records", "bytes", "hash").alias("c")), shifts
    return out


def differing_ranges(ours: list[DataFrame], theirs: list[DataFrame], levels: list[tuple[int, int]]) -> DataFrame:
    """Last ranges (k, d) that differ, found by descending from differing nodes only."""
    suspects = None
    for i in range(len(levels) - 1, -1, -1):
        a, b = ours[i], theirs[i]
        if suspects is not None:
            step = levels[i + 1][0] - levels[i][0], levels[i + 1][1] - levels[i][1]
            above = small(suspects.select(F.col("k").alias("pk"), F.col("d").alias("pd")))
            under = lambda x: x.join(above, F.struct(*_node(F.col("k"), F.col("d"), step)) == F.struct(F.col("pk").alias("k"), F.col("pd").alias("d")), "left_semi")  # noqa: B023, E731
            a, b = under(a), under(b)
        both = a.select("k", "d", F.col("hash").alias("a")).join(b.select("k", "d", F.col("hash").alias("b")), ["k", "d"], "full")
        suspects = stored(both.where(~F.col("a").eqNullSafe(F.col("b"))).select("k", "d"), "fixity-suspects")
    return suspects


def differences(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Entries (key, digest, length) of which the replicas hold unequal numbers: ``lost`` of ours, ``added`` by theirs."""
    levels = levels_of(ours, theirs)
    trees = build_tree(ours, levels), build_tree(theirs, levels)
    suspects = differing_ranges(*trees, levels)
    at = F.struct(*_node(F.col("k"), F.col("d"), levels[0]))
    ranges = small(suspects.select(F.struct("k", "d").alias("at")))
    side = lambda e, name: e.withColumn("at", at).join(ranges, "at", "left_semi").select(F.struct("key", "digest", "length").alias("one"), F.col("n").alias(name))
    both = side(ours, "a").join(side(theirs, "b"), "one", "full").select("one.*", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")).where("a <> b")
    out = stored(both.select("key", "digest", "length", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("lost"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("added")), "fixity-differences")
    discard(*trees[0], *trees[1], suspects)
    return out


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Each record of ``ours`` (key, length, digest rows) with its range and whether ``theirs`` has it intact; and, with ordinal and offset -1, each record that only ``theirs`` has.

    Of equal records those in front are taken to be the intact ones.
    """
    return audit_entries(entries(ours), entries(theirs))


def audit_entries(a: DataFrame, b: DataFrame) -> DataFrame:
    """``audit`` of two tables of ``entries``."""
    found = differences(a, b)
    same = F.struct("key", "digest", "length")
    lost = found.where("lost > 0").select(same.alias("one"), "lost")
    each = laid_out(a).withColumn("one", same).join(lost, "one", "left").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    own = each.select((F.col("ordinal") + F.col("i")).alias("ordinal"), "key", (F.col("offset") + F.col("i") * F.col("length")).alias("offset"), "length", "digest", (F.col("i") < F.col("n") - F.coalesce("lost", F.lit(0))).alias("intact"), F.lit("original").alias("side"))
    none = F.lit(-1).cast("long")
    more = found.where("added > 0").select(none.alias("ordinal"), "key", none.alias("offset"), "length", "digest", F.lit(False).alias("intact"), F.lit("replica").alias("side"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("added"))).alias("i")).drop("i")
    return own.unionByName(more)


#: the query's replica is damaged in the records whose key leaves this remainder; how, goes by the quotient
DAMAGE_EVERY, DAMAGE_AT = 101, 7


def damaged(pages: DataFrame) -> DataFrame:
    """``pages`` with known damage: of damaged records, in turn, one letter is changed, the text is longer, the record is lost, or another is added."""
    hit = F.coalesce(F.col("page_id") % DAMAGE_EVERY == DAMAGE_AT, F.lit(False))
    turn = F.floor(F.col("page_id") / DAMAGE_EVERY) % 4
    html = F.when(hit & (turn == 0), F.concat(F.lit("X"), F.substring("html", 2, 2**31 - 1))).when(hit & (turn == 1), F.concat(F.col("html"), F.lit("longer"))).otherwise(F.col("html"))
    rows = pages.select("page_id", "url", "html", F.when(hit & (turn == 2), F.array().cast("array<string>")).when(hit & (turn == 3), F.array(html, F.lit("added"))).otherwise(F.array(html)).alias("all"))
    return rows.select("page_id", "url", F.explode("all").alias("html"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages and a replica with known damage as WARC files, reads each and audits. The files go once they are hashed."""
    pages = table(spark, sf_dir, "pages")

    def hashed(rows: DataFrame) -> DataFrame:
        root = shared_dir(spark, "warc")
        out = entries(read_warc(write_warc(rows, root), root))
        remove(spark, root)
        return out

    found = audit_entries(hashed(pages), hashed(damaged(pages)))
    return found.select(F.col("key").alias("page_id"), F.col("ordinal").alias("record_no"), F.col("offset").alias("warc_offset"), F.col("length").alias("record_bytes"), F.col("digest").alias("record_sha256"), "intact", "side")


_RECORD = f"""'{VERSION}' || chr(13) || chr(10) || 'WARC-Type: {TYPE}' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:record:' || coalesce(page_id::varchar, '') || '>' || chr(13) || chr(10)
    || 'WARC-Date: {DATE}' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10)
    || 'Content-Type: {MEDIA}' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"""

ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, url, html, CASE WHEN page_id % {DAMAGE_EVERY} = {DAMAGE_AT} THEN page_id // {DAMAGE_EVERY} % 4 ELSE -1 END AS turn FROM pages),
q AS (
  SELECT page_id, url, CASE turn WHEN 0 THEN 'X' || substr(html, 2) WHEN 1 THEN html || 'longer' ELSE html END AS html FROM p WHERE turn <> 2
  UNION ALL SELECT page_id, url, 'added' FROM p WHERE turn = 3),
a AS (SELECT page_id, {_RECORD} AS rec FROM p),
b AS (SELECT page_id, {_RECORD} AS rec FROM q),
x AS (SELECT page_id, rec, sha256(rec) AS h, row_number() OVER (PARTITION BY page_id, rec) AS i FROM a),
y AS (SELECT page_id, rec, sha256(rec) AS h, row_number() OVER (PARTITION BY page_id, rec) AS i FROM b),
n AS (SELECT page_id, h, max(i) AS n FROM x GROUP BY ALL),
m AS (SELECT page_id, h, max(i) AS n FROM y GROUP BY ALL)
SELECT x.page_id, (row_number() OVER (ORDER BY x.page_id NULLS FIRST, x.h, x.i) - 1)::BIGINT AS record_no,
  coalesce(sum(strlen(x.rec)) OVER (ORDER BY x.page_id NULLS FIRST, x.h, x.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS warc_offset,
  strlen(x.rec)::BIGINT AS record_bytes, x.h AS record_sha256, coalesce(x.i <= m.n, false) AS intact, 'original' AS side
FROM x LEFT JOIN m ON m.page_id IS NOT DISTINCT FROM x.page_id AND m.h = x.h
UNION ALL
SELECT y.page_id, -1, -1, strlen(y.rec)::BIGINT, y.h, false, 'replica'
FROM y LEFT JOIN n ON n.page_id IS NOT DISTINCT FROM y.page_id AND n.h = y.h WHERE n.n IS NULL OR y.i > n.n"""
