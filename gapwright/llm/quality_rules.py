"""Operator 3: quality rules as learned decision lists.

Text statistics are Spark expressions over one scan. Sequential covering learns, from labelled
statistics, an ordered list of conjunctions of thresholds: each rule is grown by information
gain, pruned on held-out rows, and the rows it covers are taken away before the next. The list
becomes one ordered conditional expression, so scoring adds no shuffle and no Python.

Defined results: a null or empty text has no words, all its statistics are 0 and the base test
fails it; a null label is no label; of several labels of a document the lowest counts; without
labels of both kinds the list is empty and only the base test decides; repeated rows give
repeated results; other columns pass through, but those named as the results (``stats``,
``base_failed``, ``kept``) are replaced by them; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import lowest_hashes
from .storage import table

#: white space between words, and the characters counted as symbols; fixed by the query's contract
SPACE = r"[ \t\n\x0B\f\r]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: labelled documents from which the list is learned, at most; the lowest hashes of their ids
MAX_LABELLED = 20_000
#: features of the learned list; ratios, so that long texts are judged as short ones
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "digit_ratio", "stop_ratio")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that are found twice or more, the first one included."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(starts) - 1), lambda k: F.least(F.lit(WINDOW), F.get(starts, k) - F.get(starts, k - 1)))
        return F.when(F.size(starts) < 2, F.lit(0)).otherwise(WINDOW + F.aggregate(gaps, F.lit(0), lambda a, g: a + g))

    def twice(pairs: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(pairs, k)["h"] == F.get(pairs, j)["h"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return let(F.sort_array(F.transform(at, lambda k: F.get(pairs, k)["i"])), covered)

    def windows(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, twice))

    def hashed(h: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW))), windows)

    return F.when(F.size(words) < 2 * 1 + WINDOW - 1, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), hashed))


def statistics(text: Column) -> Column:
    """A struct of counts of one text, its words split once."""
    text = F.coalesce(text, F.lit(""))
    removed = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            removed(SYMBOLS + "+").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
            removed("[A-Z]+").alias("n_upper"),
            removed("[0-9]+").alias("n_digits"),
            F.size(F.filter(w, lambda x: F.length(x) <= 3)).cast("long").alias("n_short"),
        )

    return let(words_of(text), of_words)


def features(s: str = "stats") -> dict[str, Column]:
    c = lambda name: F.col(f"{s}.{name}").cast("double")
    words, chars = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("word_chars"), F.lit(1.0))
    values = (c("n_words"), c("word_chars") / words, c("n_symbols") / words, c("n_dup_lines") / words, c("n_repeat_words") / words, c("n_distinct_words") / words, c("n_upper") / chars, c("n_digits") / chars, c("n_short") / words)
    return dict(zip(FEATURES, values, strict=True))


def base_failed(s: str = "stats") -> Column:
    return (F.col(f"{s}.n_words") < 20) | (100 * F.col(f"{s}.n_repeat_words") > 30 * F.col(f"{s}.n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        return columns[self.feature] > self.threshold if self.above else columns[self.feature] <= self.threshold

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] > self.threshold if self.above else values[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


class DecisionList:
    """Rules for rejection, in order; what none of them covers is kept."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules

    @classmethod
    def learn(cls, columns: dict[str, np.ndarray], bad: np.ndarray, *, most_rules: int = 8, most_conditions: int = 3, least_cover: int = 8, least_precision: float = 0.9, cuts: int = 24) -> "DecisionList":
        """Sequential covering: two thirds of the rows grow a rule, the other third prunes it and accepts or ends the list."""
        rules: list[Rule] = []
        left = np.ones(len(bad), bool)
        for _ in range(most_rules):
            fold = np.arange(len(bad)) % 3 == 2
            rule = cls._grow(columns, bad, left & ~fold, most_conditions, least_cover, cuts)
            rule = cls._prune(rule, columns, bad, left & fold)
            covered = cls._covers(rule, columns, left) if rule else np.zeros(len(bad), bool)
            held = covered & fold
            # the worth of a rule is judged where it wasn't grown, shrunk towards doubt
            if covered.sum() < least_cover or (bad[held].sum() + 1) / (held.sum() + 2) < least_precision - 1 / (held.sum() + 2) or bad[covered].mean() < least_precision:
                break
            rules.append(rule)
            left &= ~covered
        return cls(rules)

    @staticmethod
    def _covers(rule: Rule, columns: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
        out = rows.copy()
        for c in rule:
            out &= c.holds(columns)
        return out

    @staticmethod
    def _centred(c: Condition, columns: dict[str, np.ndarray], outside: np.ndarray, inside: np.ndarray) -> Condition:
        """The same split with its threshold halfway between the values on either side, so that what lies between isn't judged by a hair."""
        v = columns[c.feature]
        near = (v[outside].max(), v[inside].min()) if c.above else (v[inside].max(), v[outside].min())
        return Condition(c.feature, c.above, float(sum(near) / 2))

    @classmethod
    def _grow(cls, columns: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, most: int, least: int, cuts: int) -> Rule:
        rule: list[Condition] = []
        while len(rule) < most and bad[rows].any() and not bad[rows].all():
            p0, n0 = bad[rows].sum(), (~bad[rows]).sum()
            best = (0.0, None)
            for name, values in columns.items():
                for t in np.unique(np.quantile(values[rows], np.linspace(0, 1, cuts + 1)[1:-1])):
                    for above in (True, False):
                        hit = rows & ((values > t) if above else (values <= t))
                        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
                        if p + n >= least and p and (gain := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > best[0] + 1e-12:
                            best = (gain, Condition(name, above, float(t)))
            if best[1] is None:
                break
            # the gain is positive, so rows lie on both sides
            inside = rows & best[1].holds(columns)
            rule.append(cls._centred(best[1], columns, rows & ~inside, inside))
            rows = inside
        return tuple(rule)

    @classmethod
    def _prune(cls, rule: Rule, columns: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
        def worth(r: Rule) -> float:
            hit = cls._covers(r, columns, rows)
            p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())

    def rejects(self, values: dict[str, Column]) -> Column:
        """The ordered conditional expression of the list."""
        out = None
        for rule in self.rules:
            test = F.lit(True)
            for c in rule:
                test = test & c.column(values)
            out = F.when(test, F.lit(True)) if out is None else out.when(test, F.lit(True))
        return F.lit(False) if out is None else out.otherwise(F.lit(False))


def labelled_statistics(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """Features, label and base test of at most ``most`` documents; that many ids at most are broadcast.

    The base test stays a column: as a filter it would be pushed below the join, and with it the
    statistics of every text.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    chosen = lowest_hashes(chosen, most, "doc_id")
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.select("doc_id", "bad", statistics(F.col("text")).alias("stats")).select("doc_id", "bad", base_failed().alias("base_failed"), *(v.alias(k) for k, v in features().items()))


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DecisionList:
    rows = labelled_statistics(docs, labels, most).orderBy(F.xxhash64("doc_id", *FEATURES)).limit(most).collect()
    rows = [r for r in rows if not r.base_failed]
    columns = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    return DecisionList.learn(columns, np.array([r.bad for r in rows], bool))


def apply_rules(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the struct ``stats``, ``base_failed`` and ``kept``; columns of these names are replaced."""
    # the rows in a struct, so that no name of theirs meets one of ours
    scored = docs.select(F.struct("*").alias("row"), statistics(F.col(text)).alias("stats"))
    results = {"stats": F.col("stats"), "base_failed": base_failed(), "kept": ~base_failed() & ~rules.rejects(features())}
    return scored.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in results), *(v.alias(k) for k, v in results.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = apply_rules(docs, learn(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *(F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")
