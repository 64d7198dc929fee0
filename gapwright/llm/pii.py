"""Operator 4: personal data by candidate gradient boosting.

Base patterns give spans of four kinds. High-recall generators then propose further spans, which
may overlap: of a run of numbers every stretch from one separator to another with a usable count of
digits. Boosted trees over format and context features score each proposal of a span and a kind; a
threshold calibrated on held-out examples selects. Everything over texts is a Spark
expression: patterns, offsets, features, and the trees as conditional sums.

The trees are learned from the table: base spans of a bounded sample of its texts, with what
stands around them, are the positives, as they are and rewritten in the formats that base patterns
miss (other separators and groups, a digit changed, spelled-out marks). Numbers of no person (dates,
versions, order numbers, pieces of codes) are written into the same surroundings as negatives. For
kinds of which a sample holds no span the values are written by a seeded generator. The features are
computed by the same expressions as those of the texts.

Secrets (keys and tokens) are proposed and scored by trees of their own, and kept apart from the
personal data.

Defined results: a null or empty text has no spans; overlapping base spans of different kinds all
stay; an accepted proposal that overlaps a base span, or an accepted one of a higher score, is
dropped; seven or eight digits are proposed only in the form of a local phone with a cue before them;
repeated rows give repeated results; an empty table gives no rows; other columns pass through, but those
named as the results ``base``, ``found`` and ``secrets`` are replaced by them.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import let
from .storage import stored, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns in forms that take no backtracking: a match starts where a run of its first
#: characters starts, or where the match before ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: what a text must contain for a pattern to be tried
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
#: a run of numbers, and one number in it
RUN, NUMBER = r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9])++", r"\+?\(?[0-9]++"
#: fewest digits of a local phone, fewest and most of other numbers
LOCAL, FEWEST, MOST = 7, 9, 19
#: generators of proposals: (pattern, needed, kinds proposed, whether stretches of a match are proposed too)
GENERATORS = (
    (RUN, r"[0-9](?:[ ().-]{0,2}[0-9]){6}", ("card", "phone"), True),
    (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|@) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++", r"\[at\]|\(at\)|@", ("email",), False),
    (r"(?:\G|(?<![0-9]))[0-9]++(?: ?(?:\[dot\]|\(dot\)|\[\.\]|\(\.\)|\.) ?[0-9]++){3}", r"[0-9] ?(?:[\[(](?:dot|\.)[\])]|\.) ?[0-9]", ("ip",), False),
)
CONTEXT = 24
#: context words of a kind, and of numbers that are no personal data
CUES = {"phone_cue": "tel|phone|call|mobile|fax|cell|whatsapp", "card_cue": "card|visa|master|credit|debit|amex|pay", "code_cue": "order|isbn|invoice|ref|serial|version|sku|ticket|part|build|timestamp|total"}
FEATURES = ("for_card", "for_phone", "for_email", "for_ip", "n_digits", "n_marks", "n_dots", "plus", "paren", "luhn", "left_joined", "right_joined", "fours", "spelled", "octets", "date", "phone_form", "local_form", "more_left", "more_right", *CUES)
MAX_EXAMPLES, ROUNDS, RATE, TARGET_PRECISION = 6_000, 60, 0.3, 0.998
#: texts in which base spans to learn from are looked for, about, and base spans of a kind, at most
MAX_TEXTS, MAX_SPANS = 20_000, 400
#: candidates for secrets, their cues, and their features
SECRET, SECRET_CUE = r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/=.-]{16,}+", r"(token|secret|passw(or)?d|pwd|api.?key|access.?key|private.?key|credential|bearer|auth)\W{0,6}$"
SECRET_FEATURES = ("length", "n_digits", "n_upper", "n_lower", "n_marks", "hex", "changes", "quoted", "cue", "prefix", "path")
#: numbers in a chunk when running sums are taken; sums cost some CHUNK steps a number
CHUNK = 128


def running(steps: Column) -> Column:
    """The sums of all numbers before each, in chunks: an array is not copied once for each of its numbers."""
    kind = "struct<at:bigint,out:array<bigint>>"
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")).cast(kind)
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(steps) / CHUNK).cast("int") - 1), lambda k: F.aggregate(F.slice(steps, k * CHUNK + 1, CHUNK), zero, add))

    def joined(parts: Column) -> Column:
        bases = F.aggregate(parts, zero, lambda acc, p: add(acc, p["at"]), lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, bases, lambda p, b: F.transform(p["out"], lambda x: x + b)))

    return F.when(F.size(steps) == 0, F.array().cast("array<bigint>")).otherwise(let(chunks, joined))


def found(text: Column, pattern: str, need: str) -> Column:
    """Matches of ``pattern`` as an array of (start, end, value, left, right); offsets in code points, contexts from the gaps between matches."""
    kind = "array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>"

    def locate(gaps: Column) -> Column:
        def all_of(values: Column) -> Column:
            def placed(steps: Column) -> Column:
                def put(at: Column) -> Column:
                    return F.transform(
                        values,
                        lambda v, i: F.struct(
                            (F.get(at, i) + F.length(F.get(gaps, i))).alias("start"), (F.get(at, i) + F.get(steps, i)).alias("end"), v.alias("value"),
                            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("right"),
                        ),
                    )

                return let(running(steps), put)

            return let(F.transform(values, lambda v, i: (F.length(F.get(gaps, i)) + F.length(v)).cast("bigint")), placed)

        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), all_of)

    return F.when(text.rlike(need), let(F.split(text, pattern, -1), locate).cast(kind)).otherwise(F.array().cast(kind))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(number))

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.when(F.length(number) == 0, F.lit(False)).otherwise(F.aggregate(places, F.lit(0), add) % 10 == 0)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 2) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return let(digits(value), lambda d: F.length(d).between(14, 19) & F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Ascending (start, kind, end) of the base patterns; kind as its place in KINDS."""

    def of(kind: str) -> Column:
        good = F.filter(found(text, BASE[kind], NEEDS[kind]), lambda m: valid(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))

    return F.sort_array(F.concat(*map(of, KINDS)))


def stretches(run: Column) -> Column:
    """All stretches of whole numbers in a run of numbers with a usable count of digits, as matches."""

    def of(numbers: Column) -> Column:
        # each number with the separators before it
        parts = F.transform(numbers, lambda m: F.concat(m["left"], m["value"]))
        return let(F.struct(numbers.alias("m"), parts.alias("parts"), F.transform(numbers, lambda m: F.length(digits(m["value"])).cast("bigint")).alias("n")), counted)

    def counted(x: Column) -> Column:
        return let(running(x["n"]), lambda before: all_of(x["m"], x["parts"], x["n"], before))

    def all_of(numbers: Column, parts: Column, n: Column, before: Column) -> Column:
        size = F.size(numbers)
        joined = lambda first, length: F.array_join(F.slice(parts, first + 1, F.greatest(length, F.lit(0))), "")
        upto = lambda j: F.get(before, j) + F.get(n, j)

        def cut(i: Column, j: Column) -> Column:
            a = F.get(numbers, i)
            # CONTEXT characters hold no more numbers than that
            first = F.greatest(i - CONTEXT, F.lit(0))
            left = F.concat(F.when(first == 0, run["left"]).otherwise(F.lit("")), joined(first, i - first), a["left"])
            last = F.least(j + CONTEXT, size - 1)
            right = F.concat(joined(j + 1, last - j), F.when(last == size - 1, run["right"]).otherwise(F.lit("")))
            return F.struct(
                (run["start"] + a["start"]).alias("start"), (run["start"] + F.get(numbers, j)["end"]).alias("end"), F.concat(a["value"], joined(i + 1, j - i)).alias("value"),
                F.right(left, F.lit(CONTEXT)).alias("left"), F.left(right, F.lit(CONTEXT)).alias("right"),
                F.get(before, i).alias("more_left"), (upto(size - 1) - upto(j)).alias("more_right"),
            )

        # each number has a digit, so no stretch of more than MOST numbers is usable
        ends = lambda i: F.filter(F.sequence(i, F.least(i + MOST, size) - 1), lambda j: (upto(j) - F.get(before, i)).between(LOCAL, MOST))
        return F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.transform(ends(i), lambda j: cut(i, j))))

    return F.filter(let(found(run["value"], NUMBER, "[0-9]"), of), _usable)


#: a local phone; its cue must stand before it
LOCAL_FORM = r"^[0-9]{3}[ .-][0-9]{4}$|^[0-9]{4}[ .-][0-9]{4}$"
PHONE_FORM = r"^(\+?[0-9]{1,3}[ .-])?(\([0-9]{3}\) ?[0-9]{3}[ .-]|[0-9]{3}([ .-])[0-9]{3}\3)[0-9]{4}$"


def _usable(m: Column) -> Column:
    n = F.length(digits(m["value"]))
    return n.between(FEWEST, MOST) | (n.between(LOCAL, FEWEST - 1) & m["value"].rlike(LOCAL_FORM) & F.lower(m["left"]).rlike(CUES["phone_cue"]))


def proposals(text: Column) -> Column:
    """Every proposed span and kind with its features."""

    def of(pattern: str, need: str, kinds: tuple[str, ...], inner: bool) -> Column:
        whole = found(text, pattern, need)
        if inner:
            usable = F.flatten(F.transform(F.filter(whole, lambda m: F.length(digits(m["value"])) >= LOCAL), stretches))
        else:
            usable = F.transform(whole, lambda m: F.struct(*(m[f].alias(f) for f in ("start", "end", "value", "left", "right")), F.lit(0).cast("bigint").alias("more_left"), F.lit(0).cast("bigint").alias("more_right")))
        return F.flatten(F.transform(usable, lambda m: let(digits(m["value"]), lambda d: F.array(*(_described(m, d, kind) for kind in kinds)))))

    return F.concat(*(of(*form) for form in GENERATORS))


def _described(m: Column, number: Column, kind: str) -> Column:
    v, left = m["value"], F.lower(m["left"])
    one = lambda c: c.cast("double")
    values = {
        "for_card": F.lit(float(kind == "card")), "for_phone": F.lit(float(kind == "phone")), "for_email": F.lit(float(kind == "email")), "for_ip": F.lit(float(kind == "ip")),
        "n_digits": one(F.length(number)), "n_marks": one(F.length(v) - F.length(number)), "n_dots": one(F.length(v) - F.length(F.replace(v, F.lit("."), F.lit("")))),
        "plus": one(v.startswith("+")), "paren": one(F.contains(v, F.lit("("))), "luhn": one(luhn(F.left(number, F.lit(19)))),
        "left_joined": one(m["left"].rlike(r"[A-Za-z0-9_.#/@-]$")), "right_joined": one(m["right"].rlike(r"^[A-Za-z0-9_/@]")),
        "fours": one(v.rlike(r"^[0-9]{4}([ -]?[0-9]{4}){3}$|^[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}$")), "spelled": one(v.rlike(r"[\[(](at|dot|\.)[\])]")), "octets": one(v.rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([^0-9]+|$)){4}$")), "date": one(v.rlike(r"^(19|20)[0-9]{2}[-./ ][0-9]{2}[-./ ][0-9]{2}")),
        "phone_form": one(v.rlike(PHONE_FORM)), "local_form": one(v.rlike(LOCAL_FORM)), "more_left": one(F.least(m["more_left"], F.lit(MOST))), "more_right": one(F.least(m["more_right"], F.lit(MOST))),
    } | {name: one(left.rlike(words)) for name, words in CUES.items()}
    return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), *(values[f].alias(f) for f in FEATURES))


@dataclass(frozen=True)
class Split:
    feature: str
    threshold: float


@dataclass(frozen=True)
class Tree:
    """Depth two: a split, then one on either side; four leaves."""

    top: Split
    low: Split
    high: Split
    leaves: tuple[float, float, float, float]

    def column(self, c: Column) -> Column:
        def side(s: Split, a: float, b: float) -> Column:
            return F.when(c[s.feature] <= s.threshold, F.lit(a)).otherwise(F.lit(b))

        return F.when(c[self.top.feature] <= self.top.threshold, side(self.low, *self.leaves[:2])).otherwise(side(self.high, *self.leaves[2:]))


class Booster:
    """Boosted trees with logistic loss, and the score from which a proposal is accepted."""

    def __init__(self, bias: float, trees: list[Tree], threshold: float, names: tuple[str, ...] = FEATURES):
        self.bias, self.trees, self.threshold, self.names = bias, trees, threshold, names

    @classmethod
    def learn(cls, x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES) -> "Booster":
        """Rows are (examples, names); every fourth is held out for the threshold."""
        held = np.arange(len(y)) % 4 == 3
        fit_x, fit_y = x[~held], y[~held].astype(float)
        rate = np.clip(fit_y.mean(), 1e-3, 1 - 1e-3)
        bias, trees = float(np.log(rate / (1 - rate))), []
        score = np.full(len(fit_y), bias)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            g, h = fit_y - p, p * (1 - p)
            top = cls._best(fit_x, g, h, np.ones(len(g), bool), names)
            left = fit_x[:, names.index(top.feature)] <= top.threshold
            sides = [cls._best(fit_x, g, h, left, names), cls._best(fit_x, g, h, ~left, names)]
            leaves, step = [], np.zeros(len(g))
            for rows, s in zip((left, ~left), sides, strict=True):
                under = fit_x[:, names.index(s.feature)] <= s.threshold
                for leaf in (rows & under, rows & ~under):
                    leaves.append(float(np.clip(RATE * g[leaf].sum() / (h[leaf].sum() + 1.0), -2, 2)))
                    step[leaf] = leaves[-1]
            trees.append(Tree(top, *sides, tuple(leaves)))
            score += step
        model = cls(bias, trees, 0.0, names)
        s, right = model.score(x[held]), y[held]
        # the lowest threshold from which every higher one is precise enough, halfway to the next score below
        order = np.argsort(-s, kind="stable")
        precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= TARGET_PRECISION
        last = int(np.flatnonzero(precise)[-1]) if precise.any() else -1
        scores = s[order]
        below = scores[scores < scores[last]] if last >= 0 else scores[:0]
        model.threshold = float("inf") if last < 0 else float((scores[last] + (below[0] if len(below) else scores[last] - 2)) / 2)
        return model

    @staticmethod
    def _best(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, names: tuple[str, ...]) -> Split:
        best, split = -1.0, Split(names[0], 0.5)
        worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1.0)
        for i, name in enumerate(names):
            values = np.unique(x[rows, i])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[:, i] <= t
                if (w := worth(rows & low) + worth(rows & ~low)) > best + 1e-9:
                    best, split = w, Split(name, float(t))
        return split

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for t in self.trees:
            at = lambda s: x[:, self.names.index(s.feature)] <= s.threshold
            out += np.where(at(t.top), np.where(at(t.low), *t.leaves[:2]), np.where(at(t.high), *t.leaves[2:]))
        return out

    def scored(self, c: Column) -> Column:
        total = F.lit(self.bias)
        for t in self.trees:
            total = total + t.column(c)
        return total


@dataclass(frozen=True)
class Seen:
    """A base span of the table: its kind, value, and what stands before and after."""

    kind: str
    value: str
    left: str
    right: str


def seen_spans(docs: DataFrame, text: str = "text") -> list[Seen]:
    """At most MAX_SPANS distinct base spans of each kind, from some MAX_TEXTS texts: those with hashes below a bound."""
    n = max(1, docs.count())
    h = F.xxhash64(text)
    some = docs.select(F.col(text).alias("text")).where(F.col("text").isNotNull() & (h <= min(2**63 - 1, -(2**63) + 2**64 * MAX_TEXTS // n)))

    def of(kind: str) -> Column:
        good = F.filter(found(F.col("text"), BASE[kind], NEEDS[kind]), lambda m: valid(kind, m["value"]) & (F.length(m["value"]) <= 80))
        return F.transform(good, lambda m: F.struct(F.lit(kind).alias("kind"), m["value"].alias("value"), m["left"].alias("left"), m["right"].alias("right")))

    spans = stored(some.select(F.explode(F.concat(*map(of, KINDS))).alias("m")).select("m.*").distinct(), "pii-spans")
    lowest = lambda kind: spans.where(F.col("kind") == kind).orderBy(F.xxhash64("value", "left", "right"), "value", "left", "right").limit(MAX_SPANS).collect()
    return [Seen(*r) for kind in KINDS for r in lowest(kind)]


def rewritten(kind: str, value: str, r: random.Random) -> tuple[str, str]:
    """A value of the table in a format that the base patterns may miss, and which kind of format it is."""
    number = "".join(c for c in value if c.isdigit())
    if kind == "card":
        form = r.randrange(4)
        # a mistyped digit: the check fails, the format stays
        number = number if form == 0 else number[:-1] + r.choice("0123456789")
        return (value, f"{number}", *(d.join(number[i : i + 4] for i in range(0, len(number), 4)) for d in (" ", "-")))[form], "card"
    if kind == "phone":
        local = number[-10:]
        a, b, c = local[:3], local[3:6], local[6:]
        return r.choice((value, value, f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{number[:2]} {number[2:5]} {number[5:]}")) if len(local) == 10 else value, "phone"
    if kind == "email":
        name, _, host = value.partition("@")
        at, dot = r.choice((("[at]", "[dot]"), (" (at) ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("@", ".")))
        return name + at + host.replace(".", dot), "email"
    return r.choice(("[.]", "(.)", "[dot]", " (dot) ", ".")).join(value.split(".")), "ip"


def examples(n: int = MAX_EXAMPLES // 3, seed: int = 11, seen: list[Seen] = ()) -> list[tuple[str, str]]:
    """Texts, and what is personal data in each: kind:start:end, joined by commas."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    make = {
        "card": (lambda: num(16), lambda: num(16), lambda: " ".join(num(4) for _ in range(4)), lambda: "-".join(num(4) for _ in range(4)), lambda: f"{num(4)} {num(6)} {num(5)}", lambda: num(15)),
        "phone": (lambda: f"+{num(2)} {num(3)} {num(6)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"+1 ({num(3)}) {num(3)}-{num(4)}"),
        "local": (lambda: f"{num(3)}-{num(4)}", lambda: f"{num(3)} {num(4)}", lambda: f"{num(4)} {num(4)}"),
        "ip": tuple(lambda d=d: d.join(str(r.randint(0, 255)) for _ in range(4)) for d in ("[.]", "(.)", "[dot]", " (dot) ", ".")),
        "email": (lambda: f"{word()}[at]{word()}[dot]com", lambda: f"{word()} (at) {word()}.org", lambda: f"{word()}{num(2)}@ {word()} .net"),
        "none": (lambda: f"20{num(2)}-0{num(1)}-1{num(1)} 1{num(1)}", lambda: f"19{num(2)}.1{num(1)}.2{num(1)} 1{num(1)}.{num(2)}", lambda: f"{num(3)}.{num(3)}.{num(2)}.{num(3)}", lambda: num(r.randint(9, 12)), lambda: num(r.randint(21, 40)), lambda: f"{num(1)}.{num(1)}.{num(2)}.{num(3)}.{num(4)}", lambda: f"{word()}{num(16)}{word()}", lambda: f"{r.choice('abcdef')}{num(12)}{r.choice('abcdef')}{num(2)}", lambda: " ".join(num(2) for _ in range(7)), lambda: f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"{num(1)} {num(3)} {num(3)} {num(3)}", lambda: r.choice((".", "[.]", "(dot)")).join((num(2), num(1), num(2), str(r.randint(256, 999))))),
    }
    cue = {"card": ("card", "visa", "pay"), "phone": ("call", "tel", "phone"), "local": ("call", "tel", "phone"), "email": ("write", "mail"), "ip": ("host", "from"), "none": ("order", "isbn", "ref", "version", "total")}
    by_kind = {k: [s for s in seen if s.kind == k] for k in KINDS}
    # two of a kind, or a date and a phone, side by side
    beside = (("phone", "phone"), ("card", "card"), ("date", "phone"), ("phone", "card"))
    out = []
    for i in range(n):
        kinds = (("card",), ("phone",), ("email",), ("none",), ("none",), ("ip",), ("local",), beside[i // 10 % 4], beside[i // 10 % 4], ("phone",))[i % 10]
        place = r.choice(seen) if seen else None
        # words only, so that the surroundings hold no other span
        around = lambda t: " ".join(w for w in t.split() if w.isalpha()) or word()
        before, after = (around(place.left), around(place.right)) if place else (word(), word())
        lead = r.choice(cue[kinds[-1]]) if kinds == ("local",) else r.choice((before.rsplit(" ", 1)[-1], r.choice(cue[kinds[-1]])))
        text, spans, form = f"{before} {lead}", [], r.choice(make["phone"])
        for kind in kinds:
            if by_kind.get(kind) and len(kinds) == 1 and r.random() < 0.7:
                value = rewritten(kind, r.choice(by_kind[kind]).value, r)[0]
            else:
                value = f"20{num(2)}-0{num(1)}-1{num(1)}" if kind == "date" else form() if kinds == ("phone", "phone") else r.choice(make[kind])()
            spans += [f"{'phone' if kind == 'local' else kind}:{len(text) + 1}:{len(text) + 1 + len(value)}"] if kind not in ("none", "date") else []
            text += f" {value}"
        out.append((f"{text} {after}", ",".join(spans)))
    return out


def secret_examples(n: int = 1_200, seed: int = 12) -> list[tuple[str, str]]:
    """Texts with a candidate each, and whether it is a secret."""
    r = random.Random(seed)
    draw = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    small_hex, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: draw("etaoinshrdlu", r.randint(2, 9))
    secret = (
        lambda: f'token = "{draw(small_hex, r.choice((32, 40, 64)))}"', lambda: f"{r.choice(('api_key', 'secret', 'access-key', 'password', 'TOKEN'))}{r.choice((': ', '=', ' = ', '="'))}{draw(mixed, r.randint(16, 48))}",
        lambda: f"AKIA{draw(mixed[:26] + '0123456789', 16)}", lambda: f"sk-{draw(mixed, 40)}", lambda: f"ghp_{draw(mixed, 36)}", lambda: f"Bearer eyJ{draw(mixed, 30)}.eyJ{draw(mixed, 60)}.{draw(mixed + '-_', 43)}", lambda: f"TOKEN = {draw(small_hex.upper(), 40)}",
    )
    plain = (
        lambda: draw("etaoinshrdlu", r.randint(16, 30)), lambda: f"/{word()}/{word()}-{word()}/{word()}.html", lambda: f"{word()}-{word()}-{word()}-{word()}", lambda: f"www.{word()}{word()}.example.com", lambda: f"{word()}.{draw('0123456789', 2)}.{word()}.example.com",
        lambda: draw("0123456789", r.randint(16, 30)), lambda: "=" * r.randint(16, 40), lambda: "_" * r.randint(16, 40), lambda: f"token of {draw('etaoinshrdlu', 18)}", lambda: f"{word().title()}{word().title()}{word().title()}Factory", lambda: f"20{draw('0123456789', 2)}-0{draw('0123456789', 1)}-1{draw('0123456789', 1)}T1{draw('0123456789', 1)}.00.00.000", lambda: draw("ETAOINSHRDLU", r.randint(16, 24)),
    )
    return [(f"{word()} {r.choice(kind)()} {word()}", "1" if kind is secret else "0") for i in range(n) for kind in ((secret, plain)[i % 2],)]


def secret_candidates(text: Column) -> Column:
    """Every proposed secret with its features."""

    def described(m: Column) -> Column:
        v = m["value"]
        count = lambda pattern: (F.length(v) - F.length(F.regexp_replace(v, pattern, ""))).cast("double")
        values = {
            "length": F.least(F.length(v), F.lit(200)).cast("double"), "n_digits": count("[0-9]"), "n_upper": count("[A-Z]"), "n_lower": count("[a-z]"), "n_marks": count("[^A-Za-z0-9]"), "hex": v.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
            # places where letters and digits meet
            "changes": F.size(F.regexp_extract_all(F.left(v, F.lit(200)), F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"), F.lit(0))).cast("double"),
            "quoted": m["left"].rlike("[\"']$").cast("double"), "cue": F.lower(m["left"]).rlike(SECRET_CUE).cast("double"), "prefix": v.rlike("^(AKIA|ASIA|sk-|pk-|gh[pousr]_|xox[bap]-|eyJ|AIza)").cast("double"), "path": F.contains(v, F.lit("/")).cast("double"),
        }
        return F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), m["end"].alias("end"), *(values[f].alias(f) for f in SECRET_FEATURES))

    return F.transform(found(text, SECRET, "[A-Za-z0-9_+/=.-]{16}"), described)


@dataclass(frozen=True)
class Model:
    personal: Booster
    secret: Booster


def _features(spark: SparkSession, rows: list[tuple[str, str]], proposed, names: tuple[str, ...]) -> tuple[list, np.ndarray]:
    df = spark.createDataFrame(rows, "text string, label string")
    every = df.select("text", "label", F.explode(proposed(F.col("text"))).alias("p")).select("text", "label", "p.*").orderBy(F.xxhash64("text"), "kind", "start", "end").limit(MAX_EXAMPLES).collect()
    return every, np.array([[r[f] for f in names] for r in every], float)


def learn(spark: SparkSession, docs: DataFrame | None = None, text: str = "text") -> Model:
    """Trees from base spans of ``docs`` and written formats; at most MAX_EXAMPLES proposals and 4 * MAX_SPANS spans come to the driver."""
    rows, x = _features(spark, examples(seen=seen_spans(docs, text) if docs is not None else ()), proposals, FEATURES)
    personal = Booster.learn(x, np.array([f"{KINDS[r.kind]}:{r.start}:{r.end}" in r.label.split(",") for r in rows]))
    rows, x = _features(spark, secret_examples(), secret_candidates, SECRET_FEATURES)
    return Model(personal, Booster.learn(x, np.array([r.label == "1" for r in rows]), SECRET_FEATURES))


def _meets(spans: Column, c: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


#: spans up to which each is compared with all others, and blocks of the text in which spans are kept beyond
FEW, BLOCKS = 64, 256
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _chosen(base: Column, best: Column) -> Column:
    """``base`` and those of ``best``, in order, that overlap none chosen before."""

    def one_by_one() -> Column:
        add = lambda acc, c: F.when(_meets(acc, c), acc).otherwise(F.concat(acc, F.array(c)))
        return F.aggregate(best, base, add)

    def by_blocks(width: Column) -> Column:
        # spans longer than a block are kept apart, so others reach into the next block at most
        long = lambda c: c["end"] - c["start"] > width
        block = lambda at: F.floor(at / width).cast("int")
        zero = F.struct(F.filter(base, long).alias("long"), F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda i: F.filter(base, lambda c: ~long(c) & (block(c["start"]) == i))).alias("blocks"))

        def step(acc: Column, c: Column) -> Column:
            first = F.greatest(block(c["start"]) - 1, F.lit(0))
            near = F.flatten(F.slice(acc["blocks"], first + 1, block(c["end"]) - first + 1))
            more = F.struct(
                F.when(long(c), F.concat(acc["long"], F.array(c))).otherwise(acc["long"]).alias("long"),
                F.when(long(c), acc["blocks"]).otherwise(F.transform(acc["blocks"], lambda x, i: F.when(i == block(c["start"]), F.concat(x, F.array(c))).otherwise(x))).alias("blocks"),
            )
            return F.when(_meets(near, c) | _meets(acc["long"], c), acc).otherwise(more)

        return F.aggregate(best, zero, step, lambda acc: F.concat(acc["long"], F.flatten(acc["blocks"])))

    end = F.greatest(F.array_max(F.transform(best, lambda c: c["end"])), F.array_max(F.transform(base, lambda c: c["end"])), F.lit(0).cast("bigint"))
    wide = let(F.greatest(F.lit(64).cast("bigint"), F.floor(end / BLOCKS) + 1), by_blocks)
    return F.sort_array(F.when(F.size(base) + F.size(best) <= FEW, one_by_one()).otherwise(wide))


def accepted(base: Column, proposed: Column, model: Booster) -> Column:
    """Accepted proposals, the highest score first; of few base spans those that overlap one are left out."""

    def of(x: Column) -> Column:
        free = F.filter(x["proposed"], lambda c: (F.size(x["base"]) > FEW) | ~_meets(x["base"], c))
        scored = F.transform(free, lambda c: F.struct((-model.scored(c)).alias("cost"), c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
        best = F.sort_array(F.filter(scored, lambda c: c["cost"] < -model.threshold))
        return F.transform(best, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))

    return let(F.struct(base.alias("base"), proposed.alias("proposed")), of).cast(_SPANS)


def all_spans(base: Column, best: Column) -> Column:
    """Base spans and the accepted proposals that overlap none of them nor an accepted one of a higher score, ascending."""
    return let(F.struct(base.cast(_SPANS).alias("base"), best.alias("best")), lambda x: _chosen(x["base"], x["best"]))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, "secret")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(text: Column, model: Booster) -> Column:
    """Accepted secrets, ascending (start, kind, end)."""
    good = F.filter(secret_candidates(text), lambda c: model.scored(c) > model.threshold)
    return F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))


def find_personal_data(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns, and arrays of (start, kind, end): ``base``, ``found`` and ``secrets``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # names longer than any of the table
    own = "_" * max(map(len, ("", *docs.columns)))
    name = lambda c: F.col(own + c)
    # a step each, as nested lambdas take the analyzer many passes
    seen = docs.select("*", base_spans(whole).alias(f"{own}base"), proposals(whole).alias(f"{own}proposed"), secret_spans(whole, model.secret).alias(f"{own}secrets"))
    seen = seen.withColumn(f"{own}best", accepted(name("base"), name("proposed"), model.personal)).withColumn(f"{own}found", all_spans(name("base"), name("best")))
    results = ("base", "found", "secrets")
    return seen.select(*(c for c in docs.columns if c not in results), *(name(c).alias(c) for c in results))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span as its kind in angle brackets; of overlapping spans the first stands."""
    names = F.array(*map(F.lit, (*KINDS, "secret")))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("<"), F.get(names, s["kind"]), F.lit(">")).alias("out"), s["end"].alias("at")))
    return F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))))


def _counted(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; ``n_private`` counts ``spans`` and ``secrets`` together."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = find_personal_data(docs, learn(spark, docs))
    secrets = F.size("secrets").cast("long").alias("n_secret"), joined(F.col("secrets")).alias("secrets"), (F.size("found") + F.size("secrets")).cast("long").alias("n_private")
    return seen.select("doc_id", *map(_counted, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), *secrets)


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of ``query``: counts and digest of the base spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", base_spans(F.coalesce("text", F.lit(""))).alias("base"))
    return docs.select("doc_id", *map(_counted, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"))


#: the contract's patterns as they stand
_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_VALID = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) < 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') <= '255')))",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_DIGITS}[-i]::INT WHEN {_DIGITS}[-i]::INT > 4 THEN 2 * {_DIGITS}[-i]::INT - 9 ELSE 2 * {_DIGITS}[-i]::INT END)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}
_MATCHES = " UNION ALL ".join(f"SELECT doc_id, {i} AS kind, '{k}' AS name, string_split_regex(text, '{_PLAIN[k]}') AS gaps, regexp_extract_all(text, '{_PLAIN[k]}') AS vs FROM documents WHERE text IS NOT NULL" for i, k in enumerate(KINDS))
BASE_SQL = f"""
WITH m AS ({_MATCHES}),
p AS (
  SELECT doc_id, kind, name, vs[i] AS v, (list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(vs[:i - 1], lambda x: length(x))), 0))::BIGINT AS first
  FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM m)),
g AS (
  SELECT * FROM p WHERE CASE kind {" ".join(f"WHEN {i} THEN {_VALID[k]}" for i, k in enumerate(KINDS))} END)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = {i})::BIGINT AS n_{k}" for i, k in enumerate(KINDS))},
  sha256(coalesce(string_agg(name || ':' || first || ':' || (first + length(v)), ',' ORDER BY first, kind), '')) AS base_sha256
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id"""
