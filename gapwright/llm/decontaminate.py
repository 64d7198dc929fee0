"""Operator 8: benchmark decontamination by greedy string tiling.

Tokens are ASCII case-folded runs of letters, digits and non-ASCII characters. Rolling hashes of
``SEED`` tokens of a text are looked up among those of the test items (Karp-Rabin, on 64-bit token
hashes); a shared seed joins a text to an item. For each such pair the longest common run of
unmarked tokens is found by rolling hashes of falling lengths, compared token by token and marked,
again and again, until none of ``SEED`` tokens is left. Time is near linear in both texts for each
length found, memory linear, however often tokens repeat. The share of an item's tokens that tiles
cover tells a leak, in whatever order its passages stand. An item whose shared seeds together cover
too little can't reach the share and isn't tiled.

The test items are the stated query set. They go to the executors in blocks of at most
``BLOCK_TOKENS`` tokens, one broadcast at a time. Where there are several blocks, one pass over the
texts first leaves those with a seed of any item (by a bitmap of at most 2 ** ``MOST_BITS`` bits; a
full one lets more texts through and loses none), and the blocks go over these only.

Defined results: a null or empty text matches nothing; an item of fewer than ``SEED`` tokens matches
where a text has all of it in one run; an item without tokens matches nothing; items with equal
text each give a row; equal items (id and text) count once; repeated texts give repeated rows; without
texts or items there are no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored, table
from .textkernel import NON_ALNUM, buffers, shingles, slices, word_hashes

#: tokens in a seed and in the shortest tile
SEED = 5
#: share of an item's tokens that tiles must cover
COVERAGE = 0.5
#: tokens of test items that an executor holds at once
BLOCK_TOKENS = 2_000_000
#: fewest and most bits, as powers of two, in the bitmaps of seeds
FEWEST_BITS, MOST_BITS = 20, 27
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)

SCHEMA = "doc_id long, item_id long, coverage double, n_tiles long, covered_tokens long, item_tokens long"


class _Runs:
    """Rolling hashes of the unmarked runs of a token sequence."""

    _down = np.ones(1, np.uint64)

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        if len(_Runs._down) <= n:
            powers = np.full(2 * n + 1, _INVERSE, np.uint64)
            powers[0] = 1
            _Runs._down = np.multiply.accumulate(powers)
        up = np.full(n, _BASE, np.uint64)
        up[:1] = 1
        self.tokens = tokens
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * np.multiply.accumulate(up), dtype=np.uint64)])
        self.used = np.zeros(n, bool)

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts, ascending, and hashes of all unmarked runs of this length."""
        marks = np.concatenate([[0], np.cumsum(self.used)])
        at = np.flatnonzero(marks[length:] == marks[: len(marks) - length])
        return at, (self.total[at + length] - self.total[at]) * _Runs._down[at]

    def free(self, at: int, length: int) -> bool:
        return not self.used[at : at + length].any()


def greedy_tiles(item: np.ndarray, doc: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, length): longest first, ties by item then doc position."""
    a, b = _Runs(item), _Runs(doc)
    tiles, most = [], min(len(item), len(doc))
    common = lambda n: np.isin(a.of(n)[1], b.of(n)[1]).any()
    while most >= seed and common(seed):
        # runs of a length exist where longer ones do, so the longest is found by halving
        least = seed
        while least < most:
            middle = (least + most + 1) // 2
            least, most = (middle, most) if common(middle) else (least, middle - 1)
        (at_a, hash_a), (at_b, hash_b) = a.of(most), b.of(most)
        order = np.argsort(hash_b, kind="stable")
        at_b, hash_b = at_b[order], hash_b[order]
        lo, hi = np.searchsorted(hash_b, hash_a, "left"), np.searchsorted(hash_b, hash_a, "right")
        # a run once marked stays so: each place of the text is passed over once
        passed: dict[int, int] = {}
        for k in np.flatnonzero(lo < hi).tolist():
            i = int(at_a[k])
            if not a.free(i, most):
                continue
            first, last = int(lo[k]), int(hi[k])
            p = passed.get(first, first)
            while p < last and not b.free(int(at_b[p]), most):
                p += 1
            passed[first] = p
            if p < last and np.array_equal(item[i : i + most], doc[at_b[p] : at_b[p] + most]):
                j = int(at_b[p])
                tiles.append((i, j, most))
                a.used[i : i + most] = b.used[j : j + most] = True
        most -= 1
    return tiles


def seeds_of(tokens: np.ndarray) -> np.ndarray:
    """Hashes of an item's runs of SEED tokens; of a shorter item the hash of all of it."""
    return shingles(tokens, np.array([0, len(tokens)]), SEED)[0]


def seeds_in(words: np.ndarray, off: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of the given lengths in each text, and the text of each."""
    size, hashes, texts = np.diff(off), [], []
    for n in lengths:
        every, at = shingles(words, off, n)
        text = np.repeat(np.arange(len(size)), np.diff(at))
        # shorter texts have no run of this length
        whole = size[text] >= n
        hashes.append(every[whole])
        texts.append(text[whole])
    return np.concatenate(hashes), np.concatenate(texts)


class ItemBlock:
    """Seeds and tokens of some test items, as an executor holds them."""

    def __init__(self, ids: list[int], texts: list[str]):
        words, off = word_hashes(*buffers(pa.array(texts, pa.string())), separator=NON_ALNUM)
        some = [k for k in range(len(ids)) if off[k + 1] > off[k]]
        self.ids = [ids[k] for k in some]
        self.tokens = [words[off[k] : off[k + 1]] for k in some]
        self.seeds = [seeds_of(t) for t in self.tokens]
        self.lengths = sorted({min(SEED, len(t)) for t in self.tokens})
        every = np.concatenate(self.seeds) if some else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(some)), [len(s) for s in self.seeds]) if some else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], owner[order]
        self.shift = np.uint64(64 - FEWEST_BITS)
        self.bits = np.zeros(1 << FEWEST_BITS, bool)
        self.bits[self.every >> self.shift] = True

    def tile(self, words: np.ndarray, off: np.ndarray, coverage: float) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(text, item id, coverage, tiles, covered, tokens) of each text and item with at least this coverage."""
        if not self.lengths:
            return
        seeds, text = seeds_in(words, off, self.lengths)
        maybe = np.flatnonzero(self.bits[seeds >> self.shift])
        hits = maybe[np.isin(seeds[maybe], self.every)]
        hits = hits[np.argsort(text[hits], kind="stable")]
        bounds = np.searchsorted(text[hits], np.arange(len(off)))
        for d in np.unique(text[hits]):
            tokens, own = words[off[d] : off[d + 1]], np.unique(seeds[hits[bounds[d] : bounds[d + 1]]])
            lo, hi = np.searchsorted(self.every, own, "left"), np.searchsorted(self.every, own, "right")
            for k in np.unique(np.concatenate([self.owner[a:b] for a, b in zip(lo, hi, strict=True)])):
                item = self.tokens[k]
                n, seed = len(item), min(SEED, len(item))
                # tokens in shared seeds; tiles can't cover others
                edge = np.zeros(n + 1, np.int64)
                there = np.flatnonzero(np.isin(self.seeds[k], own))
                np.add.at(edge, there, 1)
                np.add.at(edge, there + seed, -1)
                if np.count_nonzero(np.cumsum(edge[:n])) < coverage * n:
                    continue
                tiles = greedy_tiles(item, tokens, seed)
                covered = sum(t for _, _, t in tiles)
                if covered >= coverage * n:
                    yield int(d), self.ids[k], covered / n, len(tiles), covered, n


def _blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks of bounded size, one at a time on the driver."""
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text) // 2 + 1
        if size >= BLOCK_TOKENS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The first text, token hashes and offsets of slices of a batch."""
    raw, off = buffers(batch.column("text"))
    for a, b in slices(off):
        yield a, *word_hashes(raw[off[a] : off[b]], off[a : b + 1] - off[a], separator=NON_ALNUM)


def _with_a_seed(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The texts that share a seed with any item, stored; some others may be among them."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, off in _words(batch):
                tokens = [words[a:b] for a, b in zip(off[:-1], off[1:], strict=True) if b > a]
                for t in tokens:
                    own = seeds_of(t)
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), min(SEED, len(t))), pa.int32())], ["seed", "length"])

    every = stored(items.select("text").mapInArrow(seeds, "seed long, length int"), "item-seeds")
    bits = min(max(FEWEST_BITS, (10 * every.count()).bit_length()), MOST_BITS)
    # bitmaps of 32768 places, numbered from 1 for places from 1 on
    place, size = F.shiftrightunsigned("seed", 64 - bits) + 1, 4096
    chunks = every.groupBy(F.bitmap_bucket_number(place).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    lengths = sorted(r.length for r in every.select("length").distinct().collect())
    bitmap = bytearray((1 << bits) // 8)
    for r in chunks:
        bitmap[(r.chunk - 1) * size : r.chunk * size] = r.bits
    shipped = items.sparkSession.sparkContext.broadcast((bytes(bitmap), bits, lengths))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, bits, lengths = shipped.value
        known = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for a, words, off in _words(batch):
                found, text = seeds_in(words, off, lengths)
                hit[a + text[known[(found >> np.uint64(64 - bits)).astype(np.int64)]]] = True
            yield batch.filter(pa.array(hit))

    out = stored(rows.mapInArrow(keep, rows.schema), "texts-with-seeds")
    shipped.destroy()
    return out


def find_leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """A row per text and test item with at least ``coverage`` of the item's tokens in tiles."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    several = items.agg(F.sum(F.length("text") / 2 + 1)).head()[0] or 0
    if several >= BLOCK_TOKENS:
        items = stored(items, "items")
        rows = _with_a_seed(rows, items)
    out = spark.createDataFrame([], SCHEMA)
    for n, (ids, texts) in enumerate(_blocks(items)):
        block = spark.sparkContext.broadcast((ids, texts))

        def tile(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = ItemBlock(*block.value)
            for batch in batches:
                found = [(a + d, *rest) for a, words, off in _words(batch) for d, *rest in index.tile(words, off, coverage)]
                if found:
                    d, *columns = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d, pa.int64())), *map(pa.array, columns)], ["doc_id", "item_id", "coverage", "n_tiles", "covered_tokens", "item_tokens"])

        part = rows.mapInArrow(tile, SCHEMA)
        if several >= BLOCK_TOKENS:
            # written before the next block is sent, so that one is held at a time
            part = stored(part, "leaks")
            block.destroy()
        out = part if not n else out.unionByName(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
