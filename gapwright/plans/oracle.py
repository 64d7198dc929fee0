"""SQL that gives the same rows as :mod:`gapwright.plans.queries`, written relationally for DuckDB.

Common table expressions are kept by name; :func:`sql` takes those a query needs, in order.
"""

from __future__ import annotations

TYPES = ("point", "freq", "trend", "range")


def _r(x: str, name: str) -> str:
    return f"(round({x}, 6) + 0.0) AS {name}"


def _islands(flag: str, source: str, least: int = 1) -> str:
    return f"""SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY s) - 1 AS k, s, e FROM (
      SELECT sample_id, min(t) AS s, max(t) AS e FROM (
        SELECT sample_id, t, t - row_number() OVER (PARTITION BY sample_id ORDER BY t) AS g FROM {source} WHERE {flag}) GROUP BY sample_id, g
      HAVING max(t) - min(t) + 1 >= {least})"""


def _expected(prob: str, source: str, segments: str, start: str = "s", end: str = "e") -> str:
    """Expected ends near the runs of ``segments``: sample_id, k, a, b."""
    radius = f"greatest(2, round_even(({end} - {start} + 1) * 0.25, 0)::BIGINT)"
    near = lambda c: f"p.t BETWEEN greatest(0, g.{c} - r) AND least(p.n - 1, g.{c} + r)"
    mass = lambda c, x: f"coalesce(sum({x} * (p.t - greatest(0, g.{c} - r))) FILTER (WHERE {near(c)}), 0) / greatest(coalesce(sum({x}) FILTER (WHERE {near(c)}), 0), 1e-6) + greatest(0, g.{c} - r)"
    a, b = prob.split(",")
    return f"""SELECT g.sample_id, g.k, any_value(g.{start}) AS s, any_value(g.{end}) AS e, {mass(start, f"p.{a}").replace("sum(", "sum(")} AS a, {mass(end, f"p.{b}")} AS b
      FROM (SELECT *, {radius} AS r FROM {segments}) g JOIN {source} p ON p.sample_id = g.sample_id GROUP BY g.sample_id, g.k, g.{start}, g.{end}, g.r"""


def _decompose(p: str, source: str) -> list[tuple[str, str]]:
    """CTEs that end in ``{p}d``: sample_id, t, n, period, z, trend, seasonal, d of ``source`` (sample_id, t, n, period, z)."""
    return [
        (f"{p}x", f"SELECT *, period // 2 AS h FROM {source}"),
        (f"{p}m", f"""SELECT a.sample_id, a.t, any_value(a.h) AS h, any_value(a.n) AS n, any_value(a.period) AS period,
          sum(CASE WHEN a.period % 2 = 0 AND abs(b.t - a.t) = a.h THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * b.z) / any_value(a.period) AS trend
          FROM {p}x a JOIN {p}x b ON a.sample_id = b.sample_id AND b.t BETWEEN a.t - a.h AND a.t + a.h WHERE a.t >= a.h AND a.t <= a.n - 1 - a.h GROUP BY a.sample_id, a.t"""),
        (f"{p}f", f"""SELECT sample_id, regr_slope(trend, t) FILTER (WHERE t < least(h + period, n - 1 - h)) AS fs, regr_intercept(trend, t) FILTER (WHERE t < least(h + period, n - 1 - h)) AS fi,
          regr_slope(trend, t) FILTER (WHERE t >= greatest(h, n - 1 - h - period) AND t < n - 1 - h) AS bs, regr_intercept(trend, t) FILTER (WHERE t >= greatest(h, n - 1 - h - period) AND t < n - 1 - h) AS bi
          FROM {p}m GROUP BY sample_id"""),
        (f"{p}t", f"""SELECT x.*, CASE WHEN x.t < x.h THEN fs * x.t + fi WHEN x.t > x.n - 1 - x.h THEN bs * x.t + bi ELSE m.trend END AS trend
          FROM {p}x x JOIN {p}f f USING (sample_id) LEFT JOIN {p}m m ON m.sample_id = x.sample_id AND m.t = x.t"""),
        (f"{p}p", f"SELECT sample_id, j, a - avg(a) OVER (PARTITION BY sample_id) AS seasonal FROM (SELECT sample_id, t % period AS j, avg(z - trend) AS a FROM {p}t GROUP BY ALL)"),
        (f"{p}d", f"SELECT t.*, p.seasonal, t.z - p.seasonal AS d FROM {p}t t JOIN {p}p p ON p.sample_id = t.sample_id AND p.j = t.t % t.period"),
    ]


W = "(PARTITION BY sample_id ORDER BY t)"
LOCAL = "(PARTITION BY sample_id ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)"
U = "((sample_id * 7919 % 1000) / 1000.0::DOUBLE)"


def _features(source: str) -> str:
    return f"""SELECT sample_id, t, period::BIGINT AS period, {_r("t / greatest(n - 1, 1)::DOUBLE", "t_norm")}, {_r("d", "deseason")}, {_r(f"d - coalesce(lag(d) OVER {W}, d)", "delta")},
      {_r(f"(d - avg(d) OVER {LOCAL}) / (stddev_pop(d) OVER {LOCAL} + 1e-6)", "local_z")} FROM {source}"""


def _sigmoid(x: str) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({x}))))"


def _softplus(x: str) -> str:
    return f"(greatest({x}, 0.0::DOUBLE) + ln(1 + exp(-abs({x}))))"


def _bce(x: str, y: str) -> str:
    return f"(greatest({x}, 0.0::DOUBLE) - {x} * {y} + ln(1 + exp(-abs({x}))))"


def _iou(a0: str, a1: str, b0: str, b1: str) -> str:
    return f"(CASE WHEN greatest({a1}, {b1}) - least({a0}, {b0}) <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least({a1}, {b1}) - greatest({a0}, {b0})) / (greatest({a1}, {b1}) - least({a0}, {b0})) END)"


def _seg_iou(a0: str, a1: str, b0: str, b1: str) -> str:
    inter = f"greatest(0, least({a1}, {b1}) - greatest({a0}, {b0}) + 1)"
    return f"({inter}::DOUBLE / greatest(({a1} - {a0} + 1) + ({b1} - {b0} + 1) - {inter}, 1))"


def _back(x: str) -> str:
    return f"(CASE WHEN m <= 1 OR n <= 1 THEN 0.0::DOUBLE WHEN m = n THEN ({x})::DOUBLE ELSE least(greatest(({x}) * ((n - 1)::DOUBLE / (m - 1)), 0.0::DOUBLE), (n - 1)::DOUBLE) END)"


def _lerp(value: str, source: str, target: str, grid: str) -> str:
    """``value`` of ``source`` at evenly spaced places; ``grid`` gives sample_id, n (points there), m (points wanted)."""
    return f"""SELECT g.sample_id, g.t, lo.{value} + (g.x - floor(g.x)) * (hi.{value} - lo.{value}) AS {target} FROM (
      SELECT sample_id, n, unnest(range(m)) AS t, unnest(range(m)) * (n - 1)::DOUBLE / greatest(m - 1, 1) AS x FROM {grid}) g
      JOIN {source} lo ON lo.sample_id = g.sample_id AND lo.t = floor(g.x)::BIGINT JOIN {source} hi ON hi.sample_id = g.sample_id AND hi.t = least(floor(g.x)::BIGINT + 1, g.n - 1)"""


SMOOTH = "(" + " + ".join(f"v{o}" for o in range(5)) + ") / 5.0::DOUBLE"


def _smooth(source: str) -> str:
    edge = lambda o: f"coalesce({'lag' if o < 0 else 'lead'}(v, {abs(o)}) OVER {W}, {'first_value' if o < 0 else 'last_value'}(v) OVER (PARTITION BY sample_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))" if o else "v"
    return f"SELECT sample_id, t, n, {SMOOTH} AS v FROM (SELECT sample_id, t, n, {', '.join(f'{edge(o)} AS v{o + 2}' for o in range(-2, 3))} FROM {source})"


PIECES: dict[str, str] = dict(
    [
        ("s", "SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n, value AS v, (event_type = 'error')::INT::DOUBLE AS mask FROM events"),
        ("ids", "SELECT sample_id, any_value(n) AS n FROM s GROUP BY sample_id"),
        ("z", "SELECT *, avg(v) OVER p AS mean, stddev_pop(v) OVER p AS sd, (v - avg(v) OVER p) / (stddev_pop(v) OVER p + 1e-6) AS z FROM s WINDOW p AS (PARTITION BY sample_id)"),
        ("sc", f"SELECT *, {_sigmoid('pl')} AS pp, {_sigmoid('sl')} AS sp, {_sigmoid('el')} AS ep FROM (SELECT *, 2.0::DOUBLE * z - 1.0::DOUBLE AS pl, 1.5::DOUBLE * (v - coalesce(lag(v) OVER {W}, v)) / (sd + 1e-6) AS sl, 1.5::DOUBLE * (v - coalesce(lead(v) OVER {W}, v)) / (sd + 1e-6) AS el FROM z)"),
        ("gt", _islands("mask > 0.5", "s")),
        ("pr", _islands("pp >= 0.5", "sc")),
        ("rf", """SELECT sample_id, k, least(a, b) AS s, greatest(a, b) AS e FROM (
          SELECT pr.sample_id, k, arg_max(t, (sp, -t)) AS a, arg_max(t, (ep, -t)) AS b FROM pr JOIN sc ON sc.sample_id = pr.sample_id AND sc.t BETWEEN pr.s AND pr.e GROUP BY ALL)"""),
        ("acx", "SELECT sample_id, t, n, z - avg(z) OVER (PARTITION BY sample_id) AS x FROM z"),
        ("acp", "SELECT sample_id, sum(x * x) AS p FROM acx GROUP BY sample_id"),
        ("acf", "SELECT a.sample_id, b.t - a.t AS lag, round(sum(a.x * b.x) / any_value(p), 10) AS r FROM acx a JOIN acx b ON a.sample_id = b.sample_id AND b.t - a.t BETWEEN 2 AND greatest(least(a.n // 2, 256), 3) JOIN acp ON acp.sample_id = a.sample_id GROUP BY ALL"),
        ("per", "SELECT sample_id, lag AS period FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY r DESC, lag) AS i FROM acf) WHERE i = 1"),
        ("pz", "SELECT sample_id, t, n, period, z FROM z JOIN per USING (sample_id)"),
        *_decompose("q", "pz"),
        # the augmented branch: kinds by sample id
        ("ag", f"SELECT sample_id, n, CASE sample_id % 5 WHEN 0 THEN 'scale' WHEN 1 THEN 'shift' WHEN 2 THEN 'resample' WHEN 3 THEN 'style' ELSE 'smooth' END AS kind, CASE WHEN sample_id % 5 = 2 THEN greatest(8, round_even(n * (0.9::DOUBLE + 0.2::DOUBLE * {U}), 0)::BIGINT) ELSE n END AS m FROM ids"),
        ("agr", _lerp("v", "s", "v", "(SELECT * FROM ag WHERE kind = 'resample')")),
        ("ags", _smooth("s")),
        ("av", f"""SELECT s.sample_id, s.t, ag.kind, ag.n, ag.m, CASE ag.kind WHEN 'scale' THEN s.v * (0.85::DOUBLE + 0.3::DOUBLE * u) WHEN 'shift' THEN s.v + (-0.25::DOUBLE + 0.5::DOUBLE * u) WHEN 'smooth' THEN ags.v ELSE s.v END AS v
          FROM (SELECT *, {U} AS u FROM s) s JOIN ag USING (sample_id) JOIN ags ON ags.sample_id = s.sample_id AND ags.t = s.t WHERE ag.kind <> 'resample'
          UNION ALL SELECT agr.sample_id, agr.t, kind, n, m, v FROM agr JOIN ag USING (sample_id)"""),
        ("anchor", "SELECT DISTINCT sample_id, mean, sd FROM z"),
        ("ap", "SELECT per.sample_id, CASE WHEN kind = 'resample' THEN least(greatest(round_even(period * m / n::DOUBLE, 0)::BIGINT, 2), greatest(m // 2, 2)) ELSE period END AS period FROM per JOIN ag USING (sample_id)"),
        ("apz", "SELECT av.sample_id, t, m AS n, period, (v - mean) / (sd + 1e-6) AS z FROM av JOIN ap USING (sample_id) JOIN anchor USING (sample_id)"),
        *_decompose("y", "apz"),
        ("asr", f"""SELECT sample_id, t, kind, n AS n0, m, m AS n, {_sigmoid("2.0::DOUBLE * (v - mean) / (sd + 1e-6) - 1.0::DOUBLE")} AS pp, {_sigmoid(f"1.5::DOUBLE * (v - coalesce(lag(v) OVER {W}, v)) / (sd + 1e-6)")} AS sp,
          {_sigmoid(f"1.5::DOUBLE * (v - coalesce(lead(v) OVER {W}, v)) / (sd + 1e-6)")} AS ep FROM av JOIN anchor USING (sample_id)"""),
        ("apr", _islands("pp >= 0.5", "asr")),
        ("og", "SELECT sample_id, k, least(a, b) AS a, greatest(a, b) AS b FROM (" + _expected("sp,ep", "sc", "pr") + ")"),
        ("ax", "SELECT sample_id, k, least(a, b) AS a, greatest(a, b) AS b FROM (" + _expected("sp,ep", "asr", "apr") + ")"),
        ("wp", f"SELECT sample_id, k, {_back('a')} AS a, {_back('b')} AS b FROM ax JOIN ag USING (sample_id)"),
        ("wb", "SELECT sample_id, t, pp, sp, ep FROM asr WHERE kind <> 'resample' UNION ALL SELECT p.sample_id, p.t, p.pp, s.sp, e.ep FROM ("
            + _lerp("pp", "asr", "pp", "(SELECT sample_id, m AS n, n AS m FROM ag WHERE kind = 'resample')") + ") p JOIN ("
            + _lerp("sp", "asr", "sp", "(SELECT sample_id, m AS n, n AS m FROM ag WHERE kind = 'resample')") + ") s USING (sample_id, t) JOIN ("
            + _lerp("ep", "asr", "ep", "(SELECT sample_id, m AS n, n AS m FROM ag WHERE kind = 'resample')") + ") e USING (sample_id, t)"),
        ("wbn", "SELECT wb.*, ids.n FROM wb JOIN ids USING (sample_id)"),
        ("gi", _expected("sp,ep", "sc", "gt")),
        ("gw", _expected("sp,ep", "wbn", "gt")),
        ("ga", "SELECT gi.sample_id, gi.k, abs(gi.a - gw.a) + abs(gi.b - gw.b) AS term FROM gi JOIN gw USING (sample_id, k)"),
        # monotone matching: one origin interval a step
        ("ol", "SELECT sample_id, count(*) AS n FROM og GROUP BY sample_id"),
        ("mp", f"""SELECT sample_id, origin, warped FROM mt WHERE warped IS NOT NULL"""),
        ("et", "SELECT g.sample_id, k, s, e, max(abs(z)) AS peak, avg(abs(z)) AS meandev, avg(z) AS m FROM gt g JOIN z ON z.sample_id = g.sample_id AND z.t BETWEEN g.s AND g.e GROUP BY ALL"),
        ("hd", f"""SELECT *, s % 4 AS type, 1 - exp(-(0.5::DOUBLE * peak + 0.5::DOUBLE * meandev)) AS conf, {', '.join(f"m * ({j} - 1.5::DOUBLE) + 0.1::DOUBLE * (k % {j + 2}) AS l{j}" for j in range(4))}, {_softplus("(m + 0.5)")} AS a0, {_softplus("m")} AS a1 FROM et"""),
        ("hl", f"""SELECT *, ln({' + '.join(f'exp(l{j} - mx)' for j in range(4))}) + mx - CASE type {' '.join(f'WHEN {j} THEN l{j}' for j in range(4))} END AS ce, {_bce('m', 'conf')} AS cl,
          ((CASE WHEN abs(a0 - peak) < 1 THEN 0.5::DOUBLE * (a0 - peak) * (a0 - peak) ELSE abs(a0 - peak) - 0.5::DOUBLE END) + (CASE WHEN abs(a1 - meandev) < 1 THEN 0.5::DOUBLE * (a1 - meandev) * (a1 - meandev) ELSE abs(a1 - meandev) - 0.5::DOUBLE END)) / 2 AS al
          FROM (SELECT *, greatest(l0, l1, l2, l3) AS mx FROM hd)"""),
        ("bt", "SELECT sc.*, EXISTS (SELECT 1 FROM gt WHERE gt.sample_id = sc.sample_id AND gt.s = sc.t)::INT::DOUBLE AS st, EXISTS (SELECT 1 FROM gt WHERE gt.sample_id = sc.sample_id AND gt.e = sc.t)::INT::DOUBLE AS et, abs(pp - lag(pp) OVER (PARTITION BY sc.sample_id ORDER BY t)) AS tv FROM sc"),
        ("bi", "SELECT sample_id, (row_number() OVER (ORDER BY sample_id) - 1) // 8 AS batch_id, n FROM ids"),
        ("em", "SELECT t.vec_id // 2 AS sample_id, sum((a.x - b.x) * (a.x - b.x)) / count(*) AS mse FROM embeddings t, LATERAL (SELECT 1) q, LATERAL (SELECT unnest(t.embedding)::DOUBLE AS x, generate_subscripts(t.embedding, 1) AS d) a JOIN (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) b ON b.vec_id = t.vec_id + 1 AND b.d = a.d WHERE t.vec_id % 2 = 0 GROUP BY 1"),
        ("evm", "SELECT rf.sample_id, k, s, e, avg(z) AS m FROM rf JOIN z ON z.sample_id = rf.sample_id AND z.t BETWEEN rf.s AND rf.e GROUP BY ALL"),
        ("ev", f"SELECT *, CASE WHEN s % 5 = 4 THEN 9 ELSE s % 5 END AS type, {_sigmoid('m')} AS confidence, e - s + 1 AS length, {_softplus('(m + 0.5)')} AS peak_amplitude, {_softplus('m')} AS mean_deviation FROM evm"),
        ("sm", f"""SELECT ids.sample_id, coalesce(c, 0) AS anomaly_count, coalesce(al, 0)::DOUBLE AS average_segment_length, {', '.join(f"coalesce(c{i}, 0)::BIGINT AS count_{t}, coalesce(c{i}, 0) / greatest(coalesce(c, 0), 1)::DOUBLE AS ratio_{t}" for i, t in enumerate(TYPES))},
          coalesce(cont, 0) AS continuity_degree, CASE WHEN c > 0 THEN 1 - cont ELSE 0.0::DOUBLE END AS fragmentation_degree, coalesce(mc, 0) AS max_confidence, coalesce(mse, 0) AS text_image_divergence
          FROM ids LEFT JOIN (SELECT sample_id, count(*) AS c, avg(length) AS al, {', '.join(f"count(*) FILTER (WHERE type = {i}) AS c{i}" for i in range(4))}, sum(length)::DOUBLE / greatest(arg_max(e, (s, e)) - min(s) + 1, 1) AS cont, max(confidence) AS mc FROM ev GROUP BY sample_id) x USING (sample_id) LEFT JOIN em USING (sample_id)"""),
        ("ep", "SELECT row_number() OVER (ORDER BY month) AS epoch, (n % 5) * 0.25::DOUBLE AS val_event_f1, (n % 3) * 0.1::DOUBLE AS train_bc FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1)"),
    ]
)
del PIECES["ol"]

#: recursive steps over the intervals of a sample, one an iteration
RECURSIVE = {
    "mt": f"""SELECT sample_id, -1::BIGINT AS origin, NULL::BIGINT AS warped, 0::BIGINT AS nxt FROM ids
      UNION ALL SELECT m.sample_id, m.origin + 1, b.k, coalesce(b.k + 1, m.nxt) FROM mt m JOIN og ON og.sample_id = m.sample_id AND og.k = m.origin + 1
      LEFT JOIN LATERAL (SELECT w.k FROM wp w WHERE w.sample_id = og.sample_id AND w.k >= m.nxt
        ORDER BY round({_iou("og.a", "og.b", "w.a", "w.b")}, 7) DESC, abs((og.a + og.b) / 2 - (w.a + w.b) / 2), w.k LIMIT 1) b ON true""",
    "em_": "",
    "mx": f"""SELECT sample_id, -1::BIGINT AS k, NULL::BIGINT AS hit, []::BIGINT[] AS taken FROM ids
      UNION ALL SELECT m.sample_id, m.k + 1, b.g, CASE WHEN b.g IS NULL THEN m.taken ELSE list_append(m.taken, b.g) END FROM mx m JOIN rf ON rf.sample_id = m.sample_id AND rf.k = m.k + 1
      LEFT JOIN LATERAL (SELECT min(g.k) AS g FROM gt g WHERE g.sample_id = rf.sample_id AND NOT list_contains(m.taken, g.k) AND {_seg_iou("rf.s", "rf.e", "g.s", "g.e")} >= 0.1) b ON true""",
}
del RECURSIVE["em_"]


def sql(final: str) -> str:
    """``final`` with the expressions that it needs, found by name."""
    import re

    every = PIECES | RECURSIVE
    named = lambda text: [n for n in every if re.search(rf"\b(FROM|JOIN)\s+{n}\b", text)]
    need, todo = set(), named(final)
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += named(every[n])
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for m in named(every[n]):
                if m != n:
                    visit(m)
            order.append(n)

    for n in sorted(need):
        visit(n)
    if not order:
        return final
    recursive = "RECURSIVE " if need & set(RECURSIVE) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({every[n]})" for n in order) + f"\n{final}"


def _f1(tp: str, fp: str, fn: str) -> tuple[str, str, str]:
    p, r = f"({tp} / greatest({tp} + {fp}, 1e-8))", f"({tp} / greatest({tp} + {fn}, 1e-8))"
    return p, r, f"(2 * {p} * {r} / greatest({p} + {r}, 1e-8))"


SPLIT = "CASE sample_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END"
SEG = "SELECT sample_id, k::BIGINT AS k, s::BIGINT AS start, e::BIGINT AS \"end\" FROM"
PTP, PFP, PFN = (f"sum({x})::DOUBLE" for x in ("(pp >= 0.5)::INT * mask", "(pp >= 0.5)::INT * (1 - mask)", "(1 - (pp >= 0.5)::INT) * mask"))
NAMES = "CASE (sample_id + i) % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 5 THEN 3 ELSE NULL END"

_point, _event = _f1(PTP, PFP, PFN), _f1("tp::DOUBLE", "fp::DOUBLE", "fn::DOUBLE")
EVENTS = """SELECT sample_id, count(hit) AS tp, count(*) FILTER (WHERE k >= 0 AND hit IS NULL) AS fp, (SELECT count(*) FROM gt WHERE gt.sample_id = mx.sample_id) - count(hit) AS fn FROM mx GROUP BY sample_id"""
LOSS = """SELECT {k} avg({pb}) AS point, avg({sb}) + avg({eb}) AS seg_boundary, sum(tv) / greatest(count(tv), 1) AS tv FROM bt {j} {g}""".replace("{pb}", _bce("pl", "mask")).replace("{sb}", _bce("sl", "st")).replace("{eb}", _bce("el", "et"))
HEADS = "SELECT {k} avg(ce) AS type, avg(cl) AS evidence_conf, avg(al) AS evidence_attr FROM hl {j} {g}"
ENDS = "SELECT {k} avg(abs(a - s) + abs(b - e)) AS seg_interval FROM gi {j} {g}"
BC = """SELECT {k} avg(bm) AS bc_mask, coalesce(avg(bn), 0) AS bc_int FROM (
  SELECT ids.sample_id, bm, coalesce(pd, gs) AS bn FROM ids
  JOIN (SELECT sc.sample_id, avg(abs(sc.pp - wb.pp)) AS bm FROM sc JOIN wb USING (sample_id, t) GROUP BY 1) m USING (sample_id)
  LEFT JOIN (SELECT mp.sample_id, sum(abs(og.a - wp.a) + abs(og.b - wp.b)) AS pd FROM mp JOIN og ON og.sample_id = mp.sample_id AND og.k = mp.origin JOIN wp ON wp.sample_id = mp.sample_id AND wp.k = mp.warped GROUP BY 1) p USING (sample_id)
  LEFT JOIN (SELECT sample_id, sum(term) AS gs FROM ga GROUP BY 1) g USING (sample_id)) {j} {g}"""
_sum = lambda *terms: " + ".join(f"coalesce({t}, 0)" for t in terms)
_toy_clean = "sin(2.0::DOUBLE * pi() * t / 48.0::DOUBLE) + 0.002::DOUBLE * t"
_hidden = "(SELECT label::BIGINT AS sample_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, count(*) OVER (PARTITION BY label) AS n, embedding FROM embeddings)"
_dim = "(SELECT sample_id, t, n, generate_subscripts(embedding, 1) - 1 AS d, unnest(embedding)::DOUBLE AS x FROM " + _hidden + ")"

FINAL: dict[str, str] = {
    "series_index": f"SELECT sample_id, count(*) AS n, sum(mask)::BIGINT AS n_anomalous, {_r('min(v)', 'lowest')}, {_r('max(v)', 'highest')} FROM s GROUP BY sample_id",
    "taxonomy_canonical": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'freq' WHEN event_id % 5 = 1 THEN 'range' WHEN event_id % 5 = 2 THEN 'trend' ELSE lower(event_type) END AS name FROM events",
    "type_name": "SELECT event_id, i AS type_id, CASE i WHEN 0 THEN 'point' WHEN 1 THEN 'freq' WHEN 2 THEN 'trend' WHEN 3 THEN 'range' ELSE i::VARCHAR END AS type_name FROM (SELECT event_id, event_id % 7 - 2 AS i FROM events)",
    "type_resolve": f"SELECT sample_id, i AS k, (CASE WHEN sample_id % 2 = 0 THEN coalesce({NAMES}, sample_id % 4) ELSE sample_id % 4 END)::BIGINT AS type FROM (SELECT sample_id, k AS i FROM gt)",
    "image_path_resolve": f"SELECT sample_id, CASE sample_id % 4 WHEN 0 THEN '/abs/' || sample_id || '.png' WHEN 1 THEN '/data/raw/img/' || sample_id || '.png' ELSE '/data/raw/images_plain_768x384/' || {SPLIT} || '/' || sample_id || '.png' END AS path FROM ids",
    "head_per_split": f"SELECT * FROM (SELECT {SPLIT} AS split, row_number() OVER (PARTITION BY {SPLIT} ORDER BY sample_id) AS place, sample_id, n FROM ids) WHERE place <= 3",
    "split_summary": f"SELECT {SPLIT} AS split, count(*) AS num_samples, sum(a)::BIGINT AS num_anomalous, sum(n)::BIGINT AS num_points FROM (SELECT sample_id, max(mask) AS a, any_value(n) AS n FROM s GROUP BY 1) GROUP BY 1",
    "split_filter": f"SELECT sample_id, n, {SPLIT} AS split FROM ids WHERE sample_id % 3 < 2",
    "id_filter": f"SELECT sample_id, t, {_r('v', 'v')} FROM s WHERE sample_id = 7",
    "zscore": f"SELECT sample_id, t, {_r('mean', 'mean')}, {_r('sd', 'sd')}, {_r('z', 'z')} FROM z",
    "zscore_anchored": f"SELECT z.sample_id, z.t, {_r('(z.v - coalesce(a.mean, z.mean)) / (coalesce(a.sd, z.sd) + 1e-6)', 'z')} FROM z LEFT JOIN (SELECT sample_id + 1 AS sample_id, avg(v) AS mean, stddev_pop(v) AS sd FROM s WHERE sample_id % 2 = 0 GROUP BY 1) a ON a.sample_id = z.sample_id",
    "tnorm": f"SELECT sample_id, t, {_r('t / greatest(n - 1, 1)::DOUBLE', 't_norm')} FROM s",
    "first_diff": f"SELECT sample_id, t, {_r(f'v - coalesce(lag(v) OVER {W}, v)', 'delta')} FROM s",
    "local_z": f"SELECT sample_id, t, {_r(f'(v - avg(v) OVER {LOCAL}) / (stddev_pop(v) OVER {LOCAL} + 1e-6)', 'local_z')} FROM s",
    "mask_segments": f"{SEG} gt",
    "conversation_segments": f"{SEG} ({_islands('''role = 'assistant' ''', '(SELECT conv_id AS sample_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS t, role FROM conversations)')})",
    "binary_segments": f"{SEG} ({_islands('pp >= 0.5', 'sc', 2)})",
    "segments_to_mask": f"SELECT s.sample_id, t, {_r('EXISTS (SELECT 1 FROM gt WHERE gt.sample_id = s.sample_id AND s.t BETWEEN gt.s AND gt.e)::INT::DOUBLE', 'rebuilt')} FROM s",
    "boundary_targets": "SELECT sample_id, t, st AS start_target, et AS end_target FROM bt",
    "boundary_window": "SELECT sample_id, k, r AS radius, greatest(0, s - r) AS \"left\", least(n - 1, s + r) AS \"right\" FROM (SELECT *, greatest(2, round_even((e * 3 + 7 - s + 1) * 0.25, 0)::BIGINT) AS r FROM gt JOIN ids USING (sample_id))",
    "acf_period": "SELECT sample_id, period FROM per",
    "period_project": "SELECT sample_id, p AS period, least(greatest(round_even(p * m / n::DOUBLE, 0)::BIGINT, 2), greatest(m // 2, 2)) AS projected FROM (SELECT sample_id, n, sample_id % 20 + 2 AS p, round_even(n * 0.9::DOUBLE, 0)::BIGINT AS m FROM ids)",
    "decompose": f"SELECT sample_id, t, {_r('trend', 'trend')}, {_r('seasonal', 'seasonal')}, {_r('d', 'deseason')} FROM qd",
    "temporal_features": _features("qd"),
    "resample_linear": f"SELECT sample_id, t, {_r('v', 'v')} FROM ({_lerp('v', 's', 'v', '(SELECT sample_id, n, greatest(8, round_even(n * 1.07::DOUBLE, 0)::BIGINT) AS m FROM ids)')})",
    "smooth_edge": f"SELECT sample_id, t, {_r('v', 'v')} FROM ags",
    "coord_map": f"SELECT sample_id, t, {_r('c', 'there')}, {_r(_back('c'), 'back')} FROM (SELECT sample_id, t, n, m, CASE WHEN m <= 1 OR n <= 1 THEN 0.0::DOUBLE WHEN m = n THEN t::DOUBLE ELSE least(greatest(t * ((m - 1)::DOUBLE / (n - 1)), 0.0::DOUBLE), (m - 1)::DOUBLE) END AS c FROM (SELECT *, round_even(n * 0.93::DOUBLE, 0)::BIGINT AS m FROM s))",
    "warp_back": f"SELECT sample_id, t, {_r('v', 'v')} FROM (SELECT sample_id, t, v FROM av WHERE kind <> 'resample' UNION ALL {_lerp('v', 'av', 'v', '''(SELECT sample_id, m AS n, n AS m FROM ag WHERE kind = 'resample')''')})",
    "augment_series": f"SELECT sample_id, kind, t, {_r('v', 'aug_series')} FROM av",
    "augment_branch": _features("yd"),
    "toy_series": f"SELECT sample_id, t, {_r(_toy_clean, 'series')} FROM (SELECT sample_id, unnest(range(256)) AS t FROM ids)",
    "toy_inject": f"""SELECT sample_id, type, t, {_r(f"{_toy_clean} + CASE WHEN t BETWEEN f AND l THEN CASE type WHEN 0 THEN 2.5::DOUBLE + u WHEN 1 THEN 0.8::DOUBLE * sin(2.0::DOUBLE * pi() * (t - b) / 8.0::DOUBLE) WHEN 2 THEN (1.5::DOUBLE + 1.5::DOUBLE * u) * (t - b) / greatest(e - b, 1) ELSE 1.5::DOUBLE + 0.7::DOUBLE * u END ELSE 0 END", "series")},
      (t BETWEEN f AND l)::INT::DOUBLE AS mask FROM (SELECT *, CASE WHEN type = 0 THEN b + d // 2 ELSE b END AS f, CASE WHEN type = 0 THEN b + d // 2 ELSE e END AS l, unnest(range(256)) AS t FROM (
        SELECT *, least(255, b + d - 1) AS e FROM (SELECT sample_id, sample_id * 31 % 4 AS type, 40 + sample_id * 7919 % 136 AS b, 8 + sample_id * 104729 % 24 AS d, (sample_id * 1299709 % 1000) / 1000.0::DOUBLE AS u FROM ids)))""",
    "segment_targets": f"SELECT sample_id, k, s AS start, e AS \"end\", {_r('p', 'peak')}, {_r('m', 'meandev')}, {_r('1 - exp(-(0.5::DOUBLE * p + 0.5::DOUBLE * m))', 'conf')} FROM (SELECT g.sample_id, k, s, e, max(abs(d)) AS p, avg(abs(d)) AS m FROM gt g JOIN qd ON qd.sample_id = g.sample_id AND qd.t BETWEEN g.s AND g.e GROUP BY ALL)",
    "batch_assign": "SELECT sample_id, n, batch_id FROM bi",
    "batch_shuffle": "SELECT sample_id, n, (row_number() OVER (ORDER BY md5(sample_id || ':17:1')) - 1) // 8 AS batch_id FROM ids",
    "pad_summary": f"SELECT sample_id, batch_id, max(n) OVER b AS padded_length, n AS valid_length, greatest(max(c) OVER b, 1) AS padded_segments, c AS valid_segments, {_r('x', 'series_sum')}, y AS type_sum FROM (SELECT sample_id, batch_id, n, (SELECT count(*) FROM gt WHERE gt.sample_id = bi.sample_id) AS c, (SELECT sum(v) FROM s WHERE s.sample_id = bi.sample_id) AS x, coalesce((SELECT sum(gt.s % 4) FROM gt WHERE gt.sample_id = bi.sample_id), 0)::BIGINT AS y FROM bi) WINDOW b AS (PARTITION BY batch_id)",
    "valid_logits": f"SELECT b.sample_id, b.t, {_r('coalesce(s.v, -1e4)', 'logit')} FROM (SELECT sample_id, unnest(range(m)) AS t FROM (SELECT sample_id, max(n) OVER (PARTITION BY batch_id) AS m FROM bi)) b LEFT JOIN s ON s.sample_id = b.sample_id AND s.t = b.t",
    "decode_refined": f"{SEG} rf",
    "predicted_intervals": f"SELECT sample_id, k, {_r('a', 'start')}, {_r('b', '\"end\"')} FROM og",
    "masked_mean": f"SELECT sample_id, d, {_r('avg(x)', 'x')} FROM {_dim} WHERE t < n - 3 GROUP BY ALL",
    "pool_segments": f"SELECT h.sample_id, k, d, {_r('avg(x)', 'x')} FROM {_dim} h JOIN (SELECT unnest(range(3)) AS k) ON h.t BETWEEN k * 2 AND least(n - 1, k * 3 + 4) GROUP BY ALL",
    "argmax_type": "SELECT vec_id, (list_position(l, list_max(l)) - 1)::BIGINT AS type FROM (SELECT vec_id, list_transform(embedding[1:4], lambda x: round(x::DOUBLE, 1)) AS l FROM embeddings)",
    "evidence_activation": f"SELECT vec_id, {_r(_sigmoid('a'), 'confidence')}, {_r(_softplus('b'), 'peak_amplitude')}, {_r(_softplus('c'), 'mean_deviation')} FROM (SELECT vec_id, embedding[1]::DOUBLE * 20 AS a, embedding[2]::DOUBLE * 20 AS b, embedding[3]::DOUBLE * 20 AS c FROM embeddings)",
    "bce_masked": f"SELECT {_r(f'avg({_bce('pl', 'mask')})', 'loss')} FROM sc",
    "expected_coord": f"SELECT sample_id, {_r('sum(pp * t) / greatest(sum(pp), 1e-6)', 'whole')}, {_r('sum(pp * (t - n // 4)) FILTER (WHERE t BETWEEN n // 4 AND n // 2) / greatest(sum(pp) FILTER (WHERE t BETWEEN n // 4 AND n // 2), 1e-6) + any_value(n // 4)', 'part')} FROM sc GROUP BY sample_id",
    "segment_interval_loss": f"SELECT {_r('coalesce(avg(abs(a - s) + abs(b - e)), 0)', 'loss')} FROM gi",
    "interval_map": f"SELECT sample_id, k, {_r('a', 'start')}, {_r('b', '\"end\"')} FROM wp",
    "interval_iou": f"SELECT og.sample_id, {_r('og.a', 'start')}, {_r(_iou('og.a', 'og.b', 'wp.a', 'wp.b'), 'iou')}, {_r('abs((og.a + og.b) / 2 - (wp.a + wp.b) / 2)', 'gap')} FROM og JOIN wp USING (sample_id, k)",
    "match_pairs": "SELECT sample_id, origin, warped FROM mp",
    "gt_anchored": f"SELECT sample_id, k, {_r('term', 'term')} FROM ga",
    "boundary_consistency": f"SELECT {_r('bc_mask + bc_int', 'bc')}, {_r('bc_mask', 'bc_mask')}, {_r('bc_int', 'bc_int')} FROM ({BC.format(k='', j='', g='')})",
    "type_ce": f"SELECT {_r('avg(ce)', 'loss')} FROM hl",
    "evidence_reg": f"SELECT {_r('avg(cl) + avg(al)', 'evidence')}, {_r('avg(cl)', 'evidence_conf')}, {_r('avg(al)', 'evidence_attr')} FROM hl",
    "cross_modal_mse": f"SELECT {_r('avg(mse)', 'loss')} FROM em",
    "temporal_tv": f"SELECT {_r('sum(tv) / greatest(count(tv), 1)', 'loss')} FROM bt",
    "total_loss": f"""SELECT {_r("point + seg_boundary + seg_interval + type + 0.5 * (evidence_conf + evidence_attr) + bc_mask + bc_int + 0.2 * cons + 0.05 * tv", "loss")}, {_r("point", "point")}, {_r("seg_boundary + seg_interval", "seg")}, {_r("seg_boundary", "seg_boundary")},
      {_r("seg_interval", "seg_interval")}, {_r("type", "type")}, {_r("evidence_conf + evidence_attr", "evidence")}, {_r("evidence_conf", "evidence_conf")}, {_r("evidence_attr", "evidence_attr")}, {_r("bc_mask + bc_int", "bc")}, {_r("bc_mask", "bc_mask")}, {_r("bc_int", "bc_int")}, {_r("cons", "cons")}, {_r("tv", "tv")}
      FROM ({LOSS.format(k="", j="", g="")}), ({HEADS.format(k="", j="", g="")}), ({ENDS.format(k="", j="", g="")}), ({BC.format(k="", j="", g="")}), (SELECT avg(mse) AS cons FROM em)""",
    "point_f1": f"SELECT {_r(_point[0], 'precision')}, {_r(_point[1], 'recall')}, {_r(_point[2], 'f1')} FROM sc",
    "segment_iou": f"SELECT a.sample_id, a.k, b.k AS g, {_r(_seg_iou('a.s', 'a.e', 'b.s', 'b.e'), 'iou')} FROM pr a JOIN gt b ON a.sample_id = b.sample_id AND a.s <= b.e AND b.s <= a.e",
    "event_f1": f"SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, {_r(_event[0], 'precision')}, {_r(_event[1], 'recall')}, {_r(_event[2], 'f1')} FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ({EVENTS}))",
    "validate_batches": f"""SELECT count(*) AS steps, {', '.join(_r(f"avg(coalesce({c}, 0))", c) for c in ("point_precision", "point_recall", "point_f1", "event_precision", "event_recall", "event_f1", "point", "seg_boundary", "seg_interval", "type", "evidence_conf", "evidence_attr", "bc_mask", "bc_int", "cons", "tv"))},
      {', '.join(_r(f"avg({e})", c) for c, e in {"seg": _sum("seg_boundary", "seg_interval"), "evidence": _sum("evidence_conf", "evidence_attr"), "bc": _sum("bc_mask", "bc_int"), "loss": _sum("point", "seg_boundary", "seg_interval", "type", "0.5 * evidence_conf", "0.5 * evidence_attr", "bc_mask", "bc_int", "0.2 * cons", "0.05 * tv")}.items())} FROM (
      SELECT batch_id, {_point[0]} AS point_precision, {_point[1]} AS point_recall, {_point[2]} AS point_f1 FROM sc JOIN bi USING (sample_id) GROUP BY 1) JOIN (
      SELECT batch_id, {_event[0]} AS event_precision, {_event[1]} AS event_recall, {_event[2]} AS event_f1 FROM (SELECT batch_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ({EVENTS}) JOIN bi USING (sample_id) GROUP BY 1)) USING (batch_id)
      JOIN ({LOSS.format(k="batch_id,", j="JOIN bi USING (sample_id)", g="GROUP BY 1")}) USING (batch_id) LEFT JOIN ({HEADS.format(k="batch_id,", j="JOIN bi USING (sample_id)", g="GROUP BY 1")}) USING (batch_id) LEFT JOIN ({ENDS.format(k="batch_id,", j="JOIN bi USING (sample_id)", g="GROUP BY 1")}) USING (batch_id)
      LEFT JOIN ({BC.format(k="batch_id,", j="JOIN bi USING (sample_id)", g="GROUP BY 1")}) USING (batch_id) LEFT JOIN (SELECT batch_id, avg(mse) AS cons FROM em JOIN bi USING (sample_id) GROUP BY 1) USING (batch_id)""",
    "evidence_records": f"SELECT sample_id, k, s AS start, e AS \"end\", type, CASE type WHEN 0 THEN 'point' WHEN 1 THEN 'freq' WHEN 2 THEN 'trend' WHEN 3 THEN 'range' ELSE type::VARCHAR END AS type_name, length, {_r('confidence', 'confidence')}, {_r('peak_amplitude', 'peak_amplitude')}, {_r('mean_deviation', 'mean_deviation')} FROM ev",
    "continuity": f"SELECT sample_id, {_r('continuity_degree', 'continuity_degree')}, {_r('fragmentation_degree', 'fragmentation_degree')} FROM sm",
    "type_distribution": f"SELECT sample_id, {', '.join(f'count_{t}' for t in TYPES)}, {', '.join(_r(f'ratio_{t}', f'ratio_{t}') for t in TYPES)} FROM sm",
    "embedding_divergence": f"SELECT sample_id, {_r('mse', 'divergence')} FROM em",
    "summary_q": f"""SELECT sample_id, {', '.join(_r(f"{c}::DOUBLE", f"q_{c}") for c in ("anomaly_count", "average_segment_length", *(f"ratio_{t}" for t in TYPES), "continuity_degree", "fragmentation_degree", "max_confidence", "text_image_divergence"))} FROM sm""",
    "package_evidence": f"SELECT sample_id::VARCHAR AS id, 10::BIGINT AS n_q, (row_number() OVER (PARTITION BY sample_id ORDER BY s, e) - 1)::BIGINT AS k, s::BIGINT AS start, e::BIGINT AS \"end\", type::BIGINT AS type, CASE type WHEN 0 THEN 'point' WHEN 1 THEN 'freq' WHEN 2 THEN 'trend' WHEN 3 THEN 'range' ELSE type::VARCHAR END AS type_name, length::BIGINT AS length, {_r('confidence', 'confidence')}, {_r('peak_amplitude', 'peak_amplitude')}, {_r('mean_deviation', 'mean_deviation')} FROM ev",
    "package_summary": f"SELECT sample_id::VARCHAR AS id, anomaly_count::BIGINT AS n_evidence, anomaly_count::BIGINT AS anomaly_count, {', '.join(f'count_{t}::BIGINT AS count_{t}' for t in TYPES)}, {', '.join(_r(f'{c}::DOUBLE', f'q_{c}') for c in ('anomaly_count', 'average_segment_length', *(f'ratio_{t}' for t in TYPES), 'continuity_degree', 'fragmentation_degree', 'max_confidence', 'text_image_divergence'))} FROM sm",
    "best_epoch": f"SELECT epoch, {_r('val_event_f1', 'val_event_f1')}, (SELECT bool_or(abs(train_bc) > 1e-12) FROM ep) AS include_bc FROM ep ORDER BY val_event_f1 DESC, epoch LIMIT 1",
    "lr_schedule": "SELECT epoch, round(1e-5 + (3e-4 - 1e-5) * (1 + cos(pi() * epoch / 200)) / 2, 12) AS lr FROM ep",
    "epoch_merge": f"SELECT epoch, {_r('train_bc', 'train_bc')}, {_r('val_event_f1', 'val_event_f1')} FROM ep",
}

_typed = f"SELECT {SPLIT} AS split, sample_id, k, s AS start, e AS \"end\", sample_id % 4 AS type FROM gt"
#: of round trips through files
FILES: dict[str, str] = {
    "json_split_scan": _typed,
    "npz_roundtrip": _typed,
    "parquet_roundtrip": f"SELECT {SPLIT} AS split, count(*) AS num_samples, count(*) FILTER (WHERE a > 0) AS num_anomalous FROM (SELECT sample_id, max(mask) AS a FROM s GROUP BY 1) WHERE sample_id % 3 < 2 GROUP BY 1",
    "history_io": f"SELECT epoch, {_r('val_event_f1', 'val_event_f1')}, {_r('train_bc', 'train_bc')} FROM ep",
    # rows of pixels of the line in each of 768 columns, from the lowest and highest of the values at their places
    "render_series": """SELECT sample_id::VARCHAR AS sample_id, x, least(r, p)::BIGINT AS top, least(greatest(r, p) + 1, 383)::BIGINT AS bottom FROM (
      SELECT sample_id, x, r, coalesce(lag(r) OVER (PARTITION BY sample_id ORDER BY x), r) AS p FROM (
      SELECT sample_id, x, round_even(383 * (0.95::DOUBLE - 0.9::DOUBLE * CASE WHEN hi > lo THEN (y - lo) / (hi - lo) ELSE 0.5 END), 0) AS r FROM (
      SELECT *, min(y) OVER (PARTITION BY sample_id) AS lo, max(y) OVER (PARTITION BY sample_id) AS hi FROM (
      SELECT c.sample_id, x, a.v + (place - floor(place)) * (coalesce(b.v, a.v) - a.v) AS y FROM (SELECT sample_id, x, x * ((n - 1) / 767::DOUBLE) AS place FROM ids, (SELECT unnest(range(768)) AS x)) c
      JOIN s a ON a.sample_id = c.sample_id AND a.t = floor(place)::BIGINT LEFT JOIN s b ON b.sample_id = c.sample_id AND b.t = floor(place)::BIGINT + 1))))""",
}

ORACLE_SQL: dict[str, str] = {name: sql(text) for name, text in (FINAL | FILES).items()}
