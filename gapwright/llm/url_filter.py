"""Operator 10: URL rules, then host word segmentation and a naive Bayes verdict.

A host's labels are split into words by unigram Viterbi, with counts of the words in all pages'
paths and texts. A multinomial naive Bayes model over host words and path words gives the verdict
where no rule fits. It is learned from all pages that a rule decides: each distinct host and verdict
is one labelled text, of the host's words and its distinct path words, so that a host of very many
pages counts once. The labelled lines below, a small sample of words that rules may not cover, are
further texts.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
is allowed or blocked by the prior alone; repeated rows give repeated results; without pages that a
rule decides the labelled lines decide; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored, table

#: (rule, verdict); a rule is a host and a path from its first slash
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Labelled lines of words that are learned from beside the pages: (text, verdict). None is a host or path of the tables.
TRAINING = (
    ("adult video hot xxx", "block"), ("replica watches cheap sale", "block"), ("payday loan fast cash", "block"),
    ("porn free adult", "block"), ("poker bet casino jackpot", "block"), ("viagra pharmacy cheap pills", "block"),
    ("click win prize free", "block"), ("seo backlinks farm traffic", "block"), ("malware crack keygen warez", "block"),
    ("scam lottery winner cash", "block"), ("best deals cheap click", "block"), ("torrent warez crack free", "block"),
    ("daily news world report", "allow"), ("university library research", "allow"), ("open science journal paper", "allow"),
    ("city museum history art", "allow"), ("blog travel food recipes", "allow"), ("docs developer guide reference", "allow"),
    ("health hospital care info", "allow"), ("school education learning course", "allow"), ("weather report daily", "allow"),
    ("music concert review", "allow"), ("sports league news", "allow"), ("book review writer", "allow"),
    ("government public service", "allow"), ("garden home ideas", "allow"), ("software project wiki help", "allow"),
)

#: host labels that say where a page is served, not what it is about
PLUMBING = frozenset("www m blog com net org example".split())
#: a word of pages, and how many of the most frequent ones the segmentation and the verdicts know
WORD, VOCABULARY = "[a-z0-9]{2,32}", 200_000
#: bytes of hosts and their words that a worker remembers before it starts afresh
REMEMBERED = 32 << 20


class HostModel:
    """Unigram word costs for the segmentation, and naive Bayes word weights.

    ``counted`` are words of pages; ``judged`` are counts by (word, verdict) and ``texts`` the
    numbers of labelled texts by verdict, both beside the labelled lines.
    """

    #: cost in nats of one character in a word never seen; a word's own start costs as much again
    UNKNOWN = math.log(26.0)

    def __init__(self, labelled: Iterable[tuple[str, str]] = TRAINING, smoothing: float = 0.5, counted: Mapping[str, int] | None = None, judged: Mapping[tuple[str, str], int] | None = None, texts: Mapping[str, int] | None = None):
        counts: dict[str, Counter[str]] = {"allow": Counter(), "block": Counter()}
        docs = Counter(texts or {})
        for text, verdict in labelled:
            docs[verdict] += 1
            counts[verdict].update(w for w in re.split(r"[^a-z0-9]+", text.lower()) if w and w not in PLUMBING)
        known = counts["allow"] + counts["block"] + Counter(counted or {})
        n = sum(known.values())
        self.cost = {w: math.log(n / c) for w, c in known.items()}
        self.longest = max(map(len, known), default=1)
        for (word, verdict), c in (judged or {}).items():
            counts[verdict][word] += c
        total = counts["allow"] + counts["block"]
        self.prior = math.log((docs["block"] + 1) / (docs["allow"] + 1))
        size = {v: sum(c.values()) + smoothing * (len(total) + 1) for v, c in counts.items()}
        self.weight = {w: math.log((counts["block"][w] + smoothing) / size["block"]) - math.log((counts["allow"][w] + smoothing) / size["allow"]) for w in total}
        self.hosts: dict[str, list[str]] = {}
        self.remembered = 0

    def segment(self, name: str) -> list[str]:
        """The cheapest split into known words and unknown stretches; of equal costs the longest last word, then a known one."""
        # by place: cost of the best split up to there, and where its last part begins, if that is a known word; and if it is an unknown stretch
        known, unknown = [(0.0, 0)], [(math.inf, 0)]
        for i in range(1, len(name) + 1):
            here = (math.inf, 0)
            for j in range(max(0, i - self.longest), i):
                if (c := self.cost.get(name[j:i])) is not None and (c := c + min(known[j][0], unknown[j][0])) < here[0]:
                    here = (c, j)
            # one more unknown character, in the stretch that ends here or as a new one
            longer, new = unknown[i - 1][0] + self.UNKNOWN, known[i - 1][0] + 2 * self.UNKNOWN
            known.append(here)
            unknown.append((longer, unknown[i - 1][1]) if longer <= new else (new, i - 1))
        out, i, stretch = [], len(name), False
        while i:
            # a stretch is followed by a known word only
            last = known[i] if stretch or known[i][0] <= unknown[i][0] else unknown[i]
            stretch = last is unknown[i]
            out.append(name[last[1] : i])
            i = last[1]
        return out[::-1]

    def host_words(self, host: str) -> list[str]:
        if (words := self.hosts.get(host)) is None:
            words = [w for label in re.split(r"[.\-_:]+", host) if label and label not in PLUMBING for w in self.segment(label)]
            # a word costs some 60 bytes beside its characters
            self.remembered += 2 * len(host) + 60 * (len(words) + 2)
            if self.remembered > REMEMBERED:
                self.hosts, self.remembered = {}, 0
            self.hosts[host] = words
        return words

    def score(self, host: str, path: str) -> float:
        """Log odds of block; words never seen in training say nothing."""
        return self.prior + sum(self.weight.get(t, 0.0) for t in (*self.host_words(host), *path_words(path)))


def path_words(path: str) -> list[str]:
    """The path's words; numbers tell pages apart, not verdicts."""
    return [t for t in re.split(r"[^a-z0-9]+", path.lower()) if t.strip("0123456789")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, by literal positions; no percent-decoding, ports stay."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of stored ``counts`` (word, n) with the highest n, some ``most`` at most; of those with the last n a part by hash."""
    # the driver gets sizes of words of one count, not words: a sort with a limit would send it the first of every partition
    least, room, share = 1, most, 1.0
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.n):
        least, share, room = r.n, min(1.0, room / r.words), room - r.words
        if room <= 0:
            break
    return counts.where((F.col("n") > least) | ((F.col("n") == least) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)))))


def count_words(pages: DataFrame, url: str = "url", html: str = "html", most: int = VOCABULARY) -> dict[str, int]:
    """Counts of the most frequent words of all paths and page texts. Hosts aren't counted: their labels are what is to be split."""
    shown = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", split_url(F.col(url))[1], shown)), F.lit(rf"(?<![\p{{L}}0-9]){WORD}(?![\p{{L}}0-9])"), F.lit(0))
    counts = pages.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {r.word: r.n for r in most_frequent(stored(counts, "page-words"), most).collect()}


def matching_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. The rules are a parameter of the plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, slash, below = name.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + below)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def parted(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, the rule that fits and its verdict (``ruled``)."""
    host, path = split_url(F.col(url))
    parts = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return parts.select("*", rule.alias("rule"), verdict.alias("ruled"))


def learn(pages: DataFrame, url: str = "url", html: str = "html", rules: Iterable[tuple[str, str]] = RULES, labelled: Iterable[tuple[str, str]] = TRAINING, most: int = VOCABULARY) -> HostModel:
    """Word counts of all pages, and verdicts of the hosts that rules decide. The driver gets ``most`` words of either kind."""
    counted = count_words(pages, url, html, most)
    splitter = pages.sparkSession.sparkContext.broadcast(HostModel(labelled, counted=counted))
    ruled = parted(pages.select(F.lit(0).alias("page_id"), F.col(url).alias("url")), rules=rules).where("ruled IS NOT NULL")
    said = F.explode(F.array_distinct(F.split(F.lower("path"), "[^a-z0-9]+"))).alias("word")
    of_paths = ruled.select("host", "ruled", said).where(F.col("word").rlike("[a-z]")).distinct().select("ruled", "word")
    hosts = stored(ruled.select("host", "ruled").distinct(), "ruled-hosts")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(v, w) for h, v in zip(batch.column("host").to_pylist(), batch.column("ruled").to_pylist(), strict=True) for w in splitter.value.host_words(h)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], ["ruled", "word"])

    words = hosts.mapInArrow(split, "ruled string, word string").unionByName(of_paths)
    by_verdict = words.groupBy("word").agg(F.count("*").alias("n"), *(F.count_if(F.col("ruled") == v).alias(v) for v in ("allow", "block")))
    judged = {(r.word, v): r[v] for r in most_frequent(stored(by_verdict, "judged-words"), most).collect() for v in ("allow", "block") if r[v]}
    return HostModel(labelled, counted=counted, judged=judged, texts={r.ruled: r["count"] for r in hosts.groupBy("ruled").count().collect()})


def judge_urls(pages: DataFrame, model: HostModel, key: str = "page_id", url: str = "url", rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    parts = parted(pages, key, url, rules)
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            scores = [model.score(h, p) for h, p in zip(hosts, paths, strict=True)]
            words = [" ".join(model.host_words(h)) for h in hosts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(words, pa.string())], [*batch.schema.names, "score", "host_words"])

    kind = dict(parts.dtypes)["page_id"]
    scored = parts.mapInArrow(score, f"page_id {kind}, host string, path string, rule string, ruled string, score double, host_words string")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score", "host_words")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, learn(pages))


def rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of ``query``: host, path, rule and the rule's verdict."""
    return parted(table(spark, sf_dir, "pages")).select("page_id", "host", "path", F.coalesce("rule", F.lit("")).alias("rule"), F.coalesce("ruled", F.lit("")).alias("ruled"))


RULES_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (
  SELECT page_id, any_value(s.host) AS host, any_value(s.path) AS path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled
  FROM s LEFT JOIN (VALUES """ + ", ".join(f"('{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for r, v in RULES) + """) t(rule, verdict, h, p)
    ON (s.host = t.h OR ends_with(s.host, '.' || t.h)) AND starts_with(s.path, t.p)
  GROUP BY page_id)
SELECT page_id, host, path, coalesce(rule, '') AS rule, coalesce(ruled, '') AS ruled FROM f"""
