"""Operator 1: token ids as flat unsigned integer files with 64-bit document offsets.

A part is three files: ``ids`` (unsigned 16- or 32-bit little-endian, by vocabulary size),
``offsets`` (n + 1 unsigned 64-bit positions within the part) and ``docs`` (signed 64-bit keys).
Parts follow each other in ascending key order; the base of a part is the prefix sum of the
token counts of the parts before it, so ``base + offsets[i]`` is a document's global start.

Defined results: a null or empty text is a document of the end id alone; rows with equal keys
stay separate documents, ordered by text; a null key sorts first and is kept as null; an empty
table gives no parts; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_dir, table
from .textkernel import LOWER, buffers, slices

#: distinct words whose ids a worker keeps in each of two generations; a full one replaces the older
WORD_CACHE = 250_000
NULL_KEY = np.iinfo(np.int64).min

_encoders: dict[str, "WordEncoder"] = {}


#: words of a-z and the precomposed small letters of Latin-1, which no normalization changes
_SMALL_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_ALNUM, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123)]] = True
_STOP[[44, 46]] = True


def byte_alphabet() -> dict[int, str]:
    """Characters that byte-level tokenizers write for bytes: itself where visible in Latin-1, else from U+0100 on in order."""
    visible = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Encodes texts word by word and remembers the ids of each word.

    A tokenizer that folds case, drops white space and splits letters from other characters gives a
    text the ids of its words between ASCII white space, in whatever case, and of a word and a stop
    after it the ids of both. Words of small letters then go to its model directly. Other
    tokenizers, and texts with one of its special strings, are encoded in the plain way.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        kind = json.loads(self.tokenizer.to_str())
        steps = [(n["type"], n.get("content")) for n in (kind["normalizer"] or {}).get("normalizers", [])]
        parts = (kind["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = [p["pattern"].get("Regex", "") for p in parts if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]]
        self.by_word = steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and len(split) == 1 and split[0].endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and [p["type"] for p in parts] == ["Split", "ByteLevel"] and not parts[1]["add_prefix_space"]
        self.special = [t["content"].lower().encode() for t in kind["added_tokens"]]
        self.alphabet = byte_alphabet()
        self.words = _Words(self, {})

    @classmethod
    def for_file(cls, path: str) -> "WordEncoder":
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]

    def encode_many(self, raw: np.ndarray, off: np.ndarray) -> list[bytes]:
        """The ids of each text as the bytes of an array of ``dtype``."""
        lower = LOWER[raw]
        whole = lower.tobytes()
        if not self.by_word or any(s in whole for s in self.special):
            data = raw.tobytes()
            return self._plain([data[a:b] for a, b in zip(off[:-1], off[1:], strict=True)])
        stops = np.flatnonzero(_STOP[lower[1:]] & _ALNUM[lower[:-1]]) + 1
        data, at = np.insert(lower, stops, 32).tobytes(), (off + np.searchsorted(stops, off)).tolist()
        if len(self.words) > WORD_CACHE:
            self.words = _Words(self, self.words)
        get = self.words.__getitem__
        return [b"".join(map(get, data[a:b].split())) for a, b in zip(at[:-1], at[1:], strict=True)]


class _Words(dict):
    """Ids of words, encoded when first met; a generation takes over from the one before what is met again."""

    def __init__(self, encoder: WordEncoder, before: dict[bytes, bytes]):
        self.code = "H" if encoder.dtype.itemsize == 2 else "I"
        self.encoder, self.tokenize, self.before = encoder, encoder.tokenizer.model.tokenize, dict(before)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            if _SMALL_LETTERS(word):
                ids = array(self.code, [t.id for t in self.tokenize(word.decode("latin-1").translate(self.encoder.alphabet))]).tobytes()
            else:
                ids = self.encoder._plain([word])[0]
        self[word] = ids
        return ids


def _put(fs: pafs.FileSystem, path: str, parts: list) -> None:
    """Written under another name first: a task that is run again or twice leaves whole files only."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as f:
        for p in parts:
            f.write(p)
    fs.move(tmp, path)


def write_token_files(docs: DataFrame, root: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the parts under ``root`` and returns the manifest: part, path, n_docs, n_tokens, base."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(root)
        encoder = WordEncoder.for_file(tokenizer_path)
        end = np.array([end_id], encoder.dtype).tobytes()
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        stem = f"{base}/part-{part:06d}"
        tmp = f"{stem}.ids.{uuid.uuid4().hex}"
        keys, counts = [], []
        with fs.open_output_stream(tmp) as out:
            for batch in batches:
                raw, off = buffers(batch.column("text"))
                for i, j in slices(off):
                    ids = encoder.encode_many(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                    out.write(end.join([*ids, b""]))
                    counts += [len(x) // encoder.dtype.itemsize + 1 for x in ids]
                keys.append(batch.column("key").fill_null(int(NULL_KEY)).to_numpy(zero_copy_only=False))
        fs.move(tmp, f"{stem}.ids")
        offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]) if counts else np.zeros(1, np.int64)
        _put(fs, f"{stem}.offsets", [offsets.astype("<u8").tobytes()])
        _put(fs, f"{stem}.docs", [np.concatenate(keys).astype("<i8").tobytes() if keys else b""])
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": [stem], "n_docs": pa.array([len(counts)], pa.int64()), "n_tokens": pa.array([int(offsets[-1])], pa.int64()), "width": pa.array([encoder.dtype.itemsize], pa.int64())})

    # one row a part: a table of file names, not of documents
    parts = sorted(r for r in ordered.mapInArrow(write, "part long, path string, n_docs long, n_tokens long, width long").collect() if r.n_docs)
    bases = np.concatenate([[0], np.cumsum([r.n_tokens for r in parts], dtype=np.int64)]) if parts else [0]
    return spark.createDataFrame([(*r, int(b)) for r, b in zip(parts, bases, strict=False)], "part long, path string, n_docs long, n_tokens long, width long, base long")


def read_token_files(manifest: DataFrame, root: str) -> DataFrame:
    """A row per document from the memory-mapped parts: key, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(root)

        def mapped(path: str, dtype: str) -> np.ndarray:
            if not fs.get_file_info(path).size:
                return np.zeros(0, dtype)
            if isinstance(fs, pafs.LocalFileSystem):
                return np.memmap(path, dtype, "r")
            with fs.open_input_file(path) as f:
                return np.frombuffer(f.read(), dtype)

        for batch in batches:
            for row in batch.to_pylist():
                ids, off, keys = mapped(f"{row['path']}.ids", f"<u{row['width']}"), mapped(f"{row['path']}.offsets", "<u8").astype(np.int64), mapped(f"{row['path']}.docs", "<i8")
                crc = np.fromiter((zlib.crc32(ids[off[i] : off[i + 1]].astype("<u4")) for i in range(len(keys))), np.int64, len(keys))
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, mask=keys == NULL_KEY), "start": off[:-1] + row["base"], "n_tokens": np.diff(off), "ids_crc32": crc})

    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = shared_dir(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), root, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(manifest, root).withColumnRenamed("key", "doc_id")
