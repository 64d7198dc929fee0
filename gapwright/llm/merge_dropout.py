"""Operator 6: SentencePiece encoding with seeded merge-dropout, and decoding.

Merges are taken from an agenda ordered by the model's scores, then by place. A candidate merge
that comes up is skipped when a keyed hash of the seed, the text's key, the word's number in the
text, the place and the two pieces falls below the dropout rate; a skipped candidate doesn't come
up again. So each occurrence of a word is drawn anew, and a run can be repeated exactly. With a
rate of 0 the ids are the library's own.

What is remembered of a word are agendas, not draws: the candidates that come up after given
skips, and the ids if none of them is skipped. All occurrences are tried against these at once, and
the agendas of many new words are made at once too, one candidate of each word a step.

No piece of a model used here has a space mark after another character, and none holds a
character outside the vocabulary, so merges stay within words and words are segmented apart.
Characters outside the vocabulary become byte pieces, as does a space mark that stands in the text
itself; so decoding gives back every text exactly.

Defined results: a null or empty text has no ids; a null key counts as variant 0; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

MARK = "▁"
#: stands for a space mark of the text; a lone surrogate, which no text can hold
OWN_MARK = "\ud800"
RATE, SEED = 0.1, 17
#: agendas a worker remembers before it starts afresh
AGENDAS = 600_000
#: words that are tried at once, and characters of texts that are held as lists of words at once (or one text)
BLOCK, SLICE = 1 << 16, 1 << 20
#: characters of a word up to which its agenda is a plain list, and below which it is remembered
SHORT, REMEMBERED = 48, 24
#: candidates of a word that can be told as skipped (bits of a number); occurrences with later skips are drawn alone
MOST_TOLD = 64
#: agendas from which they are made together, and the most pieces of the words made together
TOGETHER, WIDTHS = 24, (6, 8, 10, 13, 17, REMEMBERED + 1)
_CHUNKS = re.compile(r"\n[^ \n]*| ( *[^ \n]*)").finditer

_segmenters: dict[tuple, "Segmenter"] = {}


class Segmenter:
    def __init__(self, model_file: str, rate: float = RATE, seed: int = SEED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        plain = {p: i for i, p in enumerate(pieces) if not special[i] and not model.is_byte(i)}
        if len(self.byte) < 256 or any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("the model must fall back to bytes and keep space marks in front of words")
        if "\n" in plain:
            raise ValueError("the model must not hold a line end in its pieces")
        self.id = plain
        #: the place in merge order: higher scores first
        self.none = float("inf")
        self.rank = {p: -model.get_score(i) for p, i in plain.items() if len(p) > 1}
        self.salt = {p: i * 0xC2B2AE35 & 0xFFFFFFFF for p, i in plain.items()}
        self.size = n
        self.pairs = _Pairs(plain, self.rank, n)
        self.bytes = np.array([bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)], object)
        self.threshold = int(rate * 2**32)
        self.seed = seed
        self.code = "H" if n <= 1 << 16 else "I"
        self.words = _Words(self)

    @classmethod
    def shared(cls, *args) -> "Segmenter":
        if args not in _segmenters:
            _segmenters[args] = cls(*args)
        return _segmenters[args]

    def symbols(self, chunk: str) -> list[str]:
        return [MARK if c == " " else OWN_MARK if c == MARK else c for c in (chunk if chunk[:1] == "\n" else " " + chunk)]

    def segment(self, chunk: str, key: int) -> bytes:
        """Ids of one word and the space before it, or of a line end and the word after it; ``key`` is of the occurrence."""
        sym = self.symbols(chunk)
        return self.coded(self._merge_short(sym, key) if len(sym) <= SHORT else self._merge_long(sym, key))

    def coded(self, sym: list[str]) -> bytes:
        out, ids = array(self.code), self.id
        for s in sym:
            if (x := ids.get(s)) is not None:
                out.append(x)
            else:
                out.extend(self.byte[b] for b in s.replace(OWN_MARK, MARK).encode())
        return out.tobytes()

    def keys(self, variants: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """32-bit keys of runs of occurrences: ``sizes`` words from number ``first`` on in the text of each variant."""
        base = _mix(variants.view(np.uint64) ^ np.uint64(self.seed * _GOLDEN & _ALL))
        number = np.arange(1, sizes.sum() + 1) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)
        return (_mix(np.repeat(base, sizes) + number.astype(np.uint64) * np.uint64(_GOLDEN)) >> np.uint64(32)).astype(np.uint32)

    def _skips(self, key: int, place: int, merged: str) -> bool:
        """The keyed hash of a candidate against the rate; ``place`` is where its left piece begins."""
        h = key ^ (place * 0x9E3779B1 + self.salt[merged]) & 0xFFFFFFFF
        return (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF < self.threshold

    def _merge_short(self, sym: list[str], key: int, skipped: tuple[int, ...] = (), tried: list[int] | None = None) -> list[str]:
        """The agenda as a list of scores beside the pieces: its first minimum is the next candidate.

        With ``tried``, candidates are skipped by their numbers instead of by ``key``, and what each
        brings to the hash is put there.
        """
        get, none = self.rank.get, self.none
        agenda = [get(a + b, none) for a, b in zip(sym, sym[1:], strict=False)]
        place = list(range(len(sym)))
        salt, threshold = self.salt, self.threshold
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            merged = sym[i] + sym[i + 1]
            if tried is not None:
                tried.append(place[i] * 0x9E3779B1 + salt[merged] & 0xFFFFFFFF)
                if len(tried) - 1 in skipped:
                    agenda[i] = none
                    continue
            elif threshold:
                # as in _skips, without the call
                h = key ^ (place[i] * 0x9E3779B1 + salt[merged]) & 0xFFFFFFFF
                if (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF < threshold:
                    agenda[i] = none
                    continue
            sym[i] = merged
            del sym[i + 1]
            del place[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = get(merged + sym[i + 1], none)
            if i:
                agenda[i - 1] = get(sym[i - 1] + merged, none)
        return sym

    def _merge_long(self, sym: list[str], key: int) -> list[str]:
        """The same with a heap and links between pieces, for words of any length."""
        n, rank = len(sym), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, i + 1, len(sym[i]) + len(sym[i + 1])) for i in range(n - 1) if (r := rank.get(sym[i] + sym[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, i, j, size = heappop(agenda)
            a, b = sym[i], sym[j]
            if not a or not b or len(a) + len(b) != size:
                continue
            if self.threshold and self._skips(key, i, a + b):
                continue
            a += b
            sym[i], sym[j] = a, ""
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank.get(a + sym[k])) is not None:
                    heappush(agenda, (r, i, k, len(a) + len(sym[k])))
            k = before[i]
            if k >= 0 and (r := rank.get(sym[k] + a)) is not None:
                heappush(agenda, (r, k, i, len(sym[k]) + len(a)))
        return [s for s in sym if s]

    def encode(self, text: str, variant: int = 0) -> np.ndarray:
        return self.encode_many([text], [variant])[0]

    def encode_many(self, texts: list[str], variants: list[int]) -> list[np.ndarray]:
        """Ids of each text; words of several texts are drawn together."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        chunks, runs, room = [], [], BLOCK

        def draw() -> None:
            which, first, size = (np.array(x, np.int64) for x in zip(*runs, strict=True))
            own = np.array([variants[i] for i in which], np.int64)
            ids, count = self._draw(chunks, self.keys(own, first, size))
            ends = np.cumsum(count)[np.cumsum(size) - 1]
            for i, a, b in zip(which.tolist(), (0, *ends[:-1].tolist()), ends.tolist(), strict=True):
                parts[i].append(ids[a:b])

        for i, text in enumerate(texts):
            if not text:
                continue
            if "  " in text or text[0] == " " or text[-1] == " ":
                words = [m[0] if m[1] is None else m[1] for m in _CHUNKS(" " + text)]
            else:
                words = text.replace("\n", " \n").split(" ")
            at = 0
            while at < len(words):
                n = min(room, len(words) - at)
                chunks += words[at : at + n]
                runs.append((i, at, n))
                at, room = at + n, room - n
                if not room:
                    draw()
                    chunks, runs, room = [], [], BLOCK
        if runs:
            draw()
        none = np.zeros(0, self.code)
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else none for p in parts]

    def _draw(self, chunks: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each by its key, and how many of each. The first candidate skipped leads to the agenda after that skip, which is tried in turn."""
        if len(self.words.count) > AGENDAS:
            self.words = _Words(self)
        words = self.words
        at = words.numbers(chunks)
        left = np.arange(len(chunks) if self.threshold else 0)
        while len(left):
            which, number = words.first_skips(at[left], keys[left], self.threshold)
            left = left[which]
            at[left] = words.after(at[left], number, chunks, left)
        ids, count = words.written(at)
        long = np.flatnonzero(at == 0).tolist()
        if not long:
            return ids, count
        # words that aren't remembered stand between the others
        own = [np.frombuffer(self.segment(chunks[i], int(keys[i])), self.code) for i in long]
        places = np.cumsum(count)[long].tolist()
        pieces = [x for a, b, o in zip((0, *places[:-1]), places, own, strict=True) for x in (ids[a:b], o)]
        count[long] = [len(o) for o in own]
        return np.concatenate([*pieces, ids[places[-1] :]]), count

    def decode(self, ids) -> str:
        """The text; the space that encoding puts in front is taken off."""
        return b"".join(self.bytes[np.asarray(ids, np.int64)].tolist()).decode()[1:]


_ALL, _GOLDEN = 2**64 - 1, 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class _Pairs:
    """The pieces that two neighbours merge to, for arrays of neighbours; symbols as ids, those outside the vocabulary from ``size`` on."""

    NONE, BITS = np.int32(2**31 - 1), 20

    def __init__(self, plain: dict[str, int], rank: dict[str, float], size: int):
        self.size = size
        self.of_char = np.arange(size, size + 0x110000, dtype=np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        # merge order as whole numbers; equal scores stay equal
        place = {r: k for k, r in enumerate(sorted(set(rank.values())))}
        self.order = np.full(size + 1, self.NONE, np.int32)
        for p, r in rank.items():
            self.order[plain[p]] = place[r]
        every = {plain[p[:c]] << 32 | plain[p[c:]]: plain[p] for p in rank for c in range(1, len(p)) if p[:c] in plain and p[c:] in plain}
        # open addressing; a slot that is free has no key
        self.keys, self.merged = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, size, np.int32)
        keys, merged = np.fromiter(every, np.int64, len(every)), np.fromiter(every.values(), np.int32, len(every))
        if len(every) > 1 << self.BITS - 1:
            raise ValueError("the model has too many merges")
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.merged[slot[free]] = keys[free], merged[free]
            left = self.keys[slot] != keys
            keys, merged, slot = keys[left], merged[left], (slot[left] + 1) & (1 << self.BITS) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(_GOLDEN) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids of the merged pieces; ``size`` where there is none. A negative id is no neighbour."""
        keys = a.astype(np.int64) << 32 | b
        keys[(a < 0) | (b < 0)] = -2
        slot = self._slot(keys)
        out, found = self.merged[slot], self.keys[slot]
        out[found != keys] = self.size
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (1 << self.BITS) - 1
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.merged[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class _Words(dict):
    """Numbers of words' agendas, made when first met. Number 0 stands for words that aren't remembered."""

    def __init__(self, segmenter: Segmenter):
        self.segmenter = segmenter
        #: by agenda: which candidates were skipped before, as bits, and the number of the next; where its candidates, its ids if nothing more is skipped and its ways on begin; counts of candidates and ids
        self.told, self.next = array("Q", [0]), array("q", [0])
        self.start, self.count, self.id_start, self.id_count, self.way = (array("q", [0]) for _ in range(5))
        self.candidates, self.ids = array("I"), array(segmenter.code)
        #: the agenda after each candidate is skipped, or -1
        self.ways = array("q")

    def numbers(self, chunks: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.get, chunks, repeat(-1)), np.int64, len(chunks))
        miss = np.flatnonzero(at < 0).tolist()
        if miss:
            new = [c for c in dict.fromkeys(map(chunks.__getitem__, miss)) if len(c) < REMEMBERED]
            self.update(zip(new, self._add(new, np.zeros(len(new), np.uint64), np.zeros(len(new), np.int64)).tolist(), strict=True))
            at[miss] = [self.get(chunks[i], 0) for i in miss]
        return at

    def _add(self, chunks: list[str], told: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Numbers of new agendas of ``chunks`` after the skips ``told``; candidates from number ``following`` on are new."""
        n = len(chunks)
        if not n:
            return np.zeros(0, np.int64)
        tried, n_tried, ids, n_ids = (self._one_by_one if n < TOGETHER else self._together)(chunks, told)
        # candidates before the last skip belong to agendas before this one
        first = np.cumsum(n_tried) - n_tried
        count = n_tried - following
        new = tried[np.repeat(first + following, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        number = len(self.count)
        for to, values in (
            (self.told, told.astype(np.uint64)), (self.next, following), (self.start, len(self.candidates) + np.cumsum(count) - count), (self.count, count),
            (self.id_start, len(self.ids) + np.cumsum(n_ids) - n_ids), (self.id_count, n_ids), (self.way, len(self.ways) + np.cumsum(count) - count),
            (self.candidates, new.astype(np.uint32)), (self.ids, ids.astype(self.segmenter.code)), (self.ways, np.full(count.sum(), -1)),
        ):
            to.frombytes(np.ascontiguousarray(values).tobytes())
        return np.arange(number, number + n)

    def _one_by_one(self, chunks: list[str], told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        s, every, ids = self.segmenter, [], []
        for chunk, bits in zip(chunks, told.tolist(), strict=True):
            tried: list[int] = []
            ids.append(np.frombuffer(s.coded(s._merge_short(s.symbols(chunk), 0, tuple(k for k in range(MOST_TOLD) if bits >> k & 1), tried)), s.code))
            every.append(np.array(tried, np.int64))
        return np.concatenate(every), np.array([len(x) for x in every]), np.concatenate(ids), np.array([len(x) for x in ids])

    def _together(self, chunks: list[str], told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Candidates (what they bring to the hash) and ids of all chunks, and how many of each."""
        s = self.segmenter
        whole = "".join([c if c[:1] == "\n" else " " + c for c in chunks])
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32).copy()
        own = codes == ord(MARK)
        codes[codes == 0x20], codes[own] = ord(MARK), ord(OWN_MARK)
        symbols = s.pairs.of_char[codes]
        size = np.array([len(c) + (c[:1] != "\n") for c in chunks])
        first = np.cumsum(size) - size
        parts: list[tuple[np.ndarray, ...]] = []
        low = 0
        for high in WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            if len(rows):
                at = first[rows][:, None] + np.arange(high)
                grid = np.where(np.arange(high) < size[rows][:, None], symbols[np.minimum(at, len(symbols) - 1)], -1)
                parts.append((rows, *self._merge_rows(grid.astype(np.int32), told[rows])))
        rows = np.concatenate([p[0] for p in parts])
        back = np.argsort(rows, kind="stable")
        return *_gathered([(p[1], p[2]) for p in parts], back), *self._coded(*_gathered([(p[3], p[4]) for p in parts], back))

    def _merge_rows(self, piece: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Agendas of rows of symbols (-1 after the last): candidates and their counts, pieces left and their counts. As in _merge_short.

        A piece stays in the column of its first symbol and is linked to its neighbours; the column behind the last is what both ends link to.
        """
        pairs = self.segmenter.pairs
        n, width = piece.shape
        done = np.full((n, width + 1), -1, np.int32)
        tried, n_tried = np.zeros((n, 2 * width + MOST_TOLD), np.uint32), np.zeros(n, np.int64)
        row, piece = np.arange(n), np.pad(piece, ((0, 0), (0, 1)), constant_values=-1)
        after = np.tile(np.minimum(np.arange(1, width + 2), width), (n, 1))
        before = np.tile(np.roll(np.arange(width + 1), 1), (n, 1))
        merged = np.full((n, width + 1), pairs.size, np.int32)
        merged[:, :-1] = pairs.of(piece[:, :-1].ravel(), piece[:, 1:].ravel()).reshape(n, width)
        order, step = pairs.order[merged], 0
        while True:
            i = order.argmin(axis=1)
            g = np.flatnonzero(order[np.arange(len(row)), i] < pairs.NONE)
            if 4 * len(g) <= 3 * len(row):
                ended = np.ones(len(row), bool)
                ended[g] = False
                done[row[ended]] = piece[ended]
                if not len(g):
                    break
                row, piece, after, before, merged, order, told, i = (x[g] for x in (row, piece, after, before, merged, order, told, i))
                g = np.arange(len(row))
            k = i[g]
            new = merged[g, k]
            tried[row[g], step] = k.astype(np.uint32) * np.uint32(0x9E3779B1) + new.astype(np.uint32) * np.uint32(0xC2B2AE35)
            n_tried[row[g]] = step = step + 1
            if step <= MOST_TOLD:
                skip = (told[g] >> np.uint64(step - 1) & np.uint64(1)).astype(bool)
                order[g[skip], k[skip]] = pairs.NONE
                g, k, new = g[~skip], k[~skip], new[~skip]
            gone, left = after[g, k], before[g, k]
            right = after[g, gone]
            piece[g, k], piece[g, gone], order[g, gone] = new, -1, pairs.NONE
            after[g, k], before[g, right] = right, k
            # the merged piece with the next one, and the one before with it
            found = pairs.of(np.concatenate([new, piece[g, left]]), np.concatenate([piece[g, right], new]))
            at = np.concatenate([g, g]), np.concatenate([k, left])
            merged[at], order[at] = found, pairs.order[found]
        there = done >= 0
        return tried[np.arange(tried.shape[1]) < n_tried[:, None]], n_tried, done[there], there.sum(axis=1)

    def _coded(self, pieces: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces; those outside the vocabulary as bytes."""
        s = self.segmenter
        other = np.flatnonzero(pieces >= s.size)
        if not len(other):
            return pieces, count
        text = [chr(c - s.size).replace(OWN_MARK, MARK).encode() for c in pieces[other].tolist()]
        size = np.ones(len(pieces), np.int64)
        size[other] = [len(t) for t in text]
        out, at = np.repeat(pieces, size), np.cumsum(size) - size
        for a, t in zip(at[other].tolist(), text, strict=True):
            out[a : a + len(t)] = [s.byte[b] for b in t]
        return out, np.add.reduceat(size, np.cumsum(count) - count)

    def after(self, agendas: np.ndarray, numbers: np.ndarray, chunks: list[str], which: np.ndarray) -> np.ndarray:
        """The agendas of the same words once these candidates are skipped; 0 where the skips can't be told."""
        if not len(agendas):
            return agendas
        ways = np.frombuffer(self.way, np.int64)[agendas] + numbers
        out = np.frombuffer(self.ways, np.int64)[ways]
        number = np.frombuffer(self.next, np.int64)[agendas] + numbers
        out[number >= MOST_TOLD] = 0
        way, one = np.unique(ways[out < 0], return_index=True)
        if len(way):
            one = np.flatnonzero(out < 0)[one]
            told = np.frombuffer(self.told, np.uint64)[agendas[one]] | np.uint64(1) << number[one].astype(np.uint64)
            new = self._add([chunks[i] for i in which[one].tolist()], told, number[one] + 1)
            np.frombuffer(self.ways, np.int64)[way] = new
            left = out < 0
            out[left] = np.frombuffer(self.ways, np.int64)[ways[left]]
        return out

    def written(self, agendas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of agendas, one after the other, and how many of each."""
        count = np.frombuffer(self.id_count, np.int64)[agendas]
        first = np.frombuffer(self.id_start, np.int64)[agendas] - (np.cumsum(count) - count)
        if not len(self.ids):
            return np.zeros(0, self.segmenter.code), count
        return np.frombuffer(self.ids, self.segmenter.code)[np.repeat(first, count) + np.arange(count.sum())], count

    def first_skips(self, agendas: np.ndarray, keys: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of the occurrences that skip a candidate, ascending, and the number of the first."""
        count = np.frombuffer(self.count, np.int64)[agendas]
        if not count.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who = np.repeat(np.arange(len(agendas)), count)
        number = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
        h = keys[who] ^ np.frombuffer(self.candidates, np.uint32)[np.frombuffer(self.start, np.int64)[agendas][who] + number]
        # as in _skips
        hit = np.flatnonzero((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) < np.uint64(threshold))
        first = np.ones(len(hit), bool)
        first[1:] = who[hit[1:]] != who[hit[:-1]]
        hit = hit[first]
        return who[hit], number[hit]


def _gathered(parts: list[tuple[np.ndarray, np.ndarray]], back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts of parts (values, counts) in the order of their rows."""
    values, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = (np.cumsum(count) - count)[back]
    count = count[back]
    return values[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())], count


def encode_texts(docs: DataFrame, model_file: str, rate: float = RATE, seed: int = SEED, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """key, variant, n_tokens, ids_crc32 (ids as little-endian 32-bit integers), lossless, and with ``ids`` the ids."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), F.lit(seed)).alias("variant"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("variant", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("variant")).cast("long"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of some SLICE characters, so that what is made of them stays small."""
        for batch in batches:
            size = np.cumsum(pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + SLICE, "right")))
                yield batch.slice(first, last - first)
                first = last

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter.shared(model_file, rate, seed)
        for batch in some(batches):
            size, crc, same, every = [], [], [], []
            texts = batch.column("text").to_pylist()
            for text, own in zip(texts, segmenter.encode_many(texts, batch.column("variant").to_pylist()), strict=True):
                wide = own.astype("<u4")
                size.append(len(own))
                crc.append(zlib.crc32(wide))
                same.append(segmenter.decode(own) == text)
                if ids:
                    every.append(wide.view("<i4"))
            columns = [batch.column("doc_id"), batch.column("variant"), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            if ids:
                columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), np.concatenate(every) if every else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "variant", "n_tokens", "ids_crc32", "lossless", "ids"][: 5 + ids])

    return rows.mapInArrow(encode, "doc_id long, variant long, n_tokens long, ids_crc32 long, lossless boolean" + ", ids array<int>" * ids)


def decode_ids(rows: DataFrame, model_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of rows of ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter.shared(model_file, 0.0, 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([segmenter.decode(x or ()) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(decode, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ids=False)
