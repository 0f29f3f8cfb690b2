"""Pieces of the catalogue's SQL: chains of common table expressions that DuckDB runs.

Each function returns the text of one or more CTEs, without a leading comma.  They
read ``dy`` (days), ``v`` (subject_id, w, x: the features of a day), ``d2`` (squared
distances of days) and ``gm`` (kernel widths) where they need them.
"""

from __future__ import annotations


def r(expression: str, name: str) -> str:
    """A double to six places, never minus zero."""
    return f"round(CAST({expression} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {name}"


def cuts(tag: str, penalties: list[float], min_size: int, jump: int = 1, cost: str = "rbf") -> str:
    """``bt<tag>`` (subject_id, penalty, cp, days): the cheapest segmentation's inner boundaries, cp < days.

    Costs: rbf, l2 or l1 of all features; cosine and weighted of ``dq`` (distances of rows of
    length one, and weighted ones); normal, linear, ar and rank of ``ab`` (two features
    by day, the first one's value of the day before, and its centred rank over its variance's root).
    """
    allowed = f"e0 - s0 >= {min_size} AND s0 % {jump} = 0 AND (e0 % {jump} = 0 OR e0 = days)"
    sums = {
        "rbf": "SELECT d2.subject_id, s0, e0, (e0 - s0) - ((e0 - s0) + 2 * sum(exp(-gamma * d2))) / (e0 - s0) AS c FROM {iv} JOIN d2 ON i >= s0 AND j < e0 JOIN gm USING (subject_id) GROUP BY 1, 2, 3",
        "l2": "SELECT d2.subject_id, s0, e0, sum(d2) / (e0 - s0) AS c FROM {iv} JOIN d2 ON i >= s0 AND j < e0 GROUP BY 1, 2, 3",
        "cosine": "SELECT subject_id, s0, e0, sum(unit) / (e0 - s0) AS c FROM {iv} JOIN dq ON i >= s0 AND j < e0 GROUP BY 1, 2, 3",
        "weighted": "SELECT subject_id, s0, e0, sum(heavy) / (e0 - s0) AS c FROM {iv} JOIN dq ON i >= s0 AND j < e0 GROUP BY 1, 2, 3",
        "normal": "SELECT subject_id, s0, e0, count(*) * ln(var_pop(a) + 1e-6) AS c FROM {iv} JOIN ab ON w >= s0 AND w < e0 GROUP BY 1, 2, 3",
        "linear": "SELECT subject_id, s0, e0, greatest(sum(a * a) - CASE WHEN sum(b * b) > 0 THEN power(sum(a * b), 2) / sum(b * b) ELSE 0 END, 0) AS c FROM {iv} JOIN ab ON w >= s0 AND w < e0 GROUP BY 1, 2, 3",
        "ar": "SELECT subject_id, s0, e0, greatest(count(*) * (var_pop(a) - CASE WHEN var_pop(p) > 1e-12 THEN power(covar_pop(a, p), 2) / var_pop(p) ELSE 0 END), 0) AS c FROM {iv} JOIN ab ON w > s0 AND w < e0 GROUP BY 1, 2, 3",
        "rank": "SELECT subject_id, s0, e0, -power(sum(k), 2) / count(*) AS c FROM {iv} JOIN ab ON w >= s0 AND w < e0 GROUP BY 1, 2, 3",
        "l1": "SELECT subject_id, s0, e0, sum(list_sum(list_transform(l, lambda y: abs(y - mid)))) AS c FROM (SELECT subject_id, s0, e0, l[s0 + 1 : e0] AS l, list_aggregate(l[s0 + 1 : e0], 'median') AS mid FROM {iv} CROSS JOIN (SELECT subject_id, feature, list(norm ORDER BY w) AS l FROM n GROUP BY 1, 2)) GROUP BY 1, 2, 3",
    }[cost].format(iv=f"iv{tag}")
    return f"""iv{tag} AS (SELECT s0, e0 FROM (SELECT unnest(range(0, days)) AS s0, days FROM dy) CROSS JOIN (SELECT unnest(range(1, days + 1)) AS e0 FROM dy) WHERE {allowed}),
cs{tag} AS ({sums}),
cl{tag} AS (SELECT subject_id, e0, list(c ORDER BY s0) AS c FROM cs{tag} GROUP BY 1, 2),
dp{tag} AS (SELECT subject_id, penalty, 0 AS e, [0::DOUBLE] AS tot, [NULL::BIGINT] AS prv FROM (SELECT DISTINCT subject_id FROM u) CROSS JOIN (SELECT unnest([{', '.join(f'{p}::DOUBLE' for p in penalties)}]) AS penalty)
  UNION ALL
  SELECT subject_id, penalty, e + 1, list_append(tot, list_min(cand)), list_append(prv, list_position(list_transform(cand, lambda y: y <= list_min(cand) + 1e-9), true) - 1) FROM (
    SELECT dp.subject_id, dp.penalty, dp.e, tot, prv, list_transform(range(0, dp.e + 2), lambda k: CASE WHEN dp.e + 1 - k >= {min_size} AND k % {jump} = 0 THEN tot[k + 1] + cl.c[k // {jump} + 1] + dp.penalty END) AS cand
    FROM dp{tag} dp CROSS JOIN dy LEFT JOIN cl{tag} cl ON cl.subject_id = dp.subject_id AND cl.e0 = dp.e + 1 WHERE dp.e < days)),
bt{tag} AS (SELECT subject_id, penalty, days AS cp, prv, days FROM dp{tag} CROSS JOIN dy WHERE e = days UNION ALL SELECT subject_id, penalty, prv[cp + 1], prv, days FROM bt{tag} WHERE prv[cp + 1] > 0)"""


def segments_from(tag: str) -> str:
    """``sg`` (subject_id, seg, s0, s1): the segments between the boundaries of ``bt<tag>``."""
    return f"""sg AS (SELECT subject_id, row_number() OVER w - 1 AS seg, s0, coalesce(lead(s0) OVER w, days) AS s1
  FROM (SELECT DISTINCT subject_id, 0::BIGINT AS s0 FROM u UNION ALL SELECT subject_id, cp FROM bt{tag} WHERE cp < days) CROSS JOIN dy WINDOW w AS (PARTITION BY subject_id ORDER BY s0))"""


def warped(metric: str = "euclidean", band: int | None = None, slope: float = 1.0) -> str:
    """``dw`` (subject_id, i, j, n, m, p, t): the totals t of the warping of every pair of segments of ``sg``, whole where p = n * m."""
    local = {"euclidean": "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))", "cityblock": "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))"}[metric]
    cost = local.format(a="a.xs[k // len(b.xs) + 1]", b="b.xs[k % len(b.xs) + 1]")
    step = f"list_min([CASE WHEN p >= m AND p % m > 0 THEN t[p - m] END, {slope} * CASE WHEN p >= m THEN t[p - m + 1] END, {slope} * CASE WHEN p % m > 0 THEN t[p] END])"
    total = f"c[p + 1] + CASE WHEN p = 0 THEN 0 ELSE {step} END"
    if band is not None:
        total = f"CASE WHEN abs(p // m - p % m) <= greatest({band}, abs(n - m)) THEN {total} END"
    return f"""sd AS (SELECT sg.subject_id, sg.seg, list(v.x ORDER BY v.w) AS xs FROM sg JOIN v ON v.subject_id = sg.subject_id AND v.w >= s0 AND v.w < s1 GROUP BY 1, 2),
lc AS (SELECT a.subject_id, a.seg AS i, b.seg AS j, len(a.xs) AS n, len(b.xs) AS m, list_transform(range(0, len(a.xs) * len(b.xs)), lambda k: {cost}) AS c FROM sd a JOIN sd b ON a.subject_id = b.subject_id AND a.seg < b.seg),
dw AS (SELECT subject_id, i, j, n, m, c, 0 AS p, CAST([] AS DOUBLE[]) AS t FROM lc UNION ALL SELECT subject_id, i, j, n, m, c, p + 1, list_append(t, {total}) FROM dw WHERE p < n * m)"""


#: Steps back over ``dw``: of equal totals (to nine places) the diagonal, then the one above.
PATHS = """pt AS (SELECT subject_id, i, j, m, t, n - 1 AS a, m - 1 AS b, CAST(n - 1 AS VARCHAR) || '-' || CAST(m - 1 AS VARCHAR) AS path FROM dw WHERE p = n * m
  UNION ALL SELECT subject_id, i, j, m, t, a - da, b - db, CAST(a - da AS VARCHAR) || '-' || CAST(b - db AS VARCHAR) || ' ' || path FROM (
    SELECT *, CASE WHEN a > 0 AND (b = 0 OR dg <= least(up, lf) OR up <= lf) THEN 1 ELSE 0 END AS da, CASE WHEN b > 0 AND (a = 0 OR dg <= least(up, lf) OR up > lf) THEN 1 ELSE 0 END AS db FROM (
      SELECT *, CASE WHEN a > 0 AND b > 0 THEN round(t[(a - 1) * m + b], 9) END AS dg, CASE WHEN a > 0 THEN round(t[(a - 1) * m + b + 1], 9) END AS up, CASE WHEN b > 0 THEN round(t[a * m + b], 9) END AS lf FROM pt WHERE a > 0 OR b > 0)))"""


def ratios(source: str, ids: str, alpha: float = 0.5, ridge: float = 0.1) -> str:
    """``rs`` (ids, pe): relative Pearson divergence of the test rows of ``source`` (ids, test, k, x) from its reference rows, all test rows being kernel centres.

    The weights solve a linear system, by Gauss-Jordan steps over its augmented matrix.
    """
    same = " AND ".join(f"a.{i.strip()} = b.{i.strip()}" for i in ids.split(","))
    own = ", ".join(f"a.{i.strip()}" for i in ids.split(","))
    return f"""rk0 AS (SELECT {own}, a.test AS ta, a.k AS ka, b.test AS tb, b.k AS kb, greatest(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0) AS q FROM {source} a JOIN {source} b ON {same}),
rw AS (SELECT {ids}, coalesce(quantile_cont(q, 0.5) FILTER (WHERE q > 1e-15), 1) AS width FROM rk0 WHERE (ta, ka) < (tb, kb) GROUP BY {ids}),
rk AS (SELECT {ids}, ka AS c, tb AS test, kb AS k, exp(-q / width) AS g FROM rk0 JOIN rw USING ({ids}) WHERE ta),
rn AS (SELECT {ids}, count(*) FILTER (WHERE test) AS nt, count(*) FILTER (WHERE NOT test) AS nr FROM {source} GROUP BY {ids}),
rh AS (SELECT {own}, a.c, b.c AS c2, sum(a.g * b.g * CASE WHEN a.test THEN {alpha} / nt ELSE (1 - {alpha}) / nr END) + CASE WHEN any_value(a.c) = any_value(b.c) THEN {ridge} ELSE 0 END AS h FROM rk a JOIN rk b ON {same} AND a.test = b.test AND a.k = b.k JOIN rn ON {same.replace('b.', 'rn.')} GROUP BY ALL),
ri AS (SELECT {ids}, c, avg(g) AS h FROM rk WHERE test GROUP BY ALL),
rm AS (SELECT {ids}, list(row_ ORDER BY c) AS m, count(*) AS n FROM (SELECT {ids}, c, list_append(list(rh.h ORDER BY c2), any_value(ri.h)) AS row_ FROM rh JOIN ri USING ({ids}, c) GROUP BY ALL) GROUP BY {ids}),
rj AS (SELECT {ids}, m, n, 1 AS p FROM rm UNION ALL
  SELECT {ids}, list_transform(range(1, n + 1), lambda a: CASE WHEN a = p THEN list_transform(m[p], lambda y: y / m[p][p]) ELSE list_transform(range(1, n + 2), lambda b: m[a][b] - m[a][p] * m[p][b] / m[p][p]) END), n, p + 1 FROM rj WHERE p <= n),
rx AS (SELECT {ids}, unnest(list_transform(m, lambda y: y[n + 1])) AS wt, unnest(range(1, n + 1)) AS place FROM rj WHERE p = n + 1),
ro AS (SELECT {ids}, c, row_number() OVER (PARTITION BY {ids} ORDER BY c) AS place FROM ri),
rg AS (SELECT {ids}, test, k, sum(wt * g) AS g FROM rk JOIN ro USING ({ids}, c) JOIN rx USING ({ids}, place) GROUP BY ALL),
rs AS (SELECT {ids}, avg(g) FILTER (WHERE test) - 0.5 * ({alpha} * avg(g * g) FILTER (WHERE test) + (1 - {alpha}) * avg(g * g) FILTER (WHERE NOT test)) - 0.5 AS pe FROM rg GROUP BY {ids})"""


#: Rows of every pair of segments of ``sg`` with five rows each: the earlier is the reference, the later the test side.
PAIR_ROWS = """sn AS (SELECT sg.subject_id, sg.seg, v.w, v.x, count(*) OVER (PARTITION BY sg.subject_id, sg.seg) AS n FROM sg JOIN v ON v.subject_id = sg.subject_id AND v.w >= s0 AND v.w < s1),
sp AS (SELECT DISTINCT a.subject_id, a.seg AS i, b.seg AS j FROM sn a JOIN sn b ON a.subject_id = b.subject_id AND a.seg < b.seg WHERE a.n >= 5 AND b.n >= 5),
pr AS (SELECT sp.subject_id, i, j, sn.seg = j AS test, w AS k, x FROM sp JOIN sn ON sn.subject_id = sp.subject_id AND sn.seg IN (i, j))"""


def normal_p(z: str) -> str:
    """Two-sided p of a standard normal ``z``, by Simpson's rule."""
    z = f"least(abs({z}), 10)"
    return f"greatest(0, 1 - 2 * list_sum(list_transform(range(0, 801), lambda q: (CASE WHEN q IN (0, 800) THEN 1 WHEN q % 2 = 1 THEN 4 ELSE 2 END) * exp(-power({z} * q / 800, 2) / 2))) * {z} / 2400 / sqrt(2 * pi()))"


def student_p(t: str, df: str) -> str:
    """Two-sided p of Student's ``t``, by Simpson's rule over the angle atan(t / sqrt(df))."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    return f"greatest(0, 1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * list_sum(list_transform(range(0, 801), lambda q: (CASE WHEN q IN (0, 800) THEN 1 WHEN q % 2 = 1 THEN 4 ELSE 2 END) * power(cos({angle} * q / 800), {df} - 1))) * {angle} / 2400)"


def signed_ranks(source: str, key: str, least: int, error: str | None = None) -> str:
    """``wx`` (key, n, w_plus, w, p): Wilcoxon's test of the non-zero d of ``source`` (key, d).

    ``error`` names the column of what rounding may have made of a d: one that is no larger
    is none, and neighbouring sizes that are no farther apart share a rank.
    """
    sizes = f"""w0 AS (SELECT {key}, abs(d) AS a, count(*) AS c, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS up FROM {source} WHERE d <> 0 GROUP BY ALL),"""
    if error:
        sizes = f"""wa AS (SELECT {key}, abs(d) AS a, max({error}) AS e, count(*) AS c, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS up FROM {source} WHERE abs(d) > {error} GROUP BY {key}, abs(d)),
wb AS (SELECT *, CASE WHEN a - lag(a) OVER o <= greatest(e, lag(e) OVER o) THEN 0 ELSE 1 END AS apart FROM wa WINDOW o AS (PARTITION BY {key} ORDER BY a)),
wc AS (SELECT *, sum(apart) OVER (PARTITION BY {key} ORDER BY a ROWS UNBOUNDED PRECEDING) AS size FROM wb),
w0 AS (SELECT {key}, min(a) AS a, CAST(sum(c) AS BIGINT) AS c, CAST(sum(up) AS BIGINT) AS up FROM wc GROUP BY {key}, size),"""
    z = "(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)"
    return f"""{sizes}
w1 AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY {key} ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2 AS rk FROM w0),
w2 AS (SELECT {key}, CAST(sum(c) AS BIGINT) AS n, sum(up * rk) AS w_plus, sum(c * c * c - c) AS ties FROM w1 GROUP BY ALL),
w3 AS (SELECT *, least(w_plus, n * (n + 1) / 2 - w_plus) AS w FROM w2),
ex AS (SELECT {key}, n, 0 AS k, list_transform(range(0, n * (n + 1) // 2 + 1), lambda y: CASE WHEN y = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS ways FROM w3 WHERE n <= 50 AND ties = 0
  UNION ALL SELECT {key}, n, k + 1, list_transform(range(0, n * (n + 1) // 2 + 1), lambda y: ways[y + 1] + CASE WHEN y > k THEN ways[y - k] ELSE 0 END) FROM ex WHERE k < n),
wx AS (SELECT w3.{key}, w3.n, w_plus, w, CASE WHEN w3.n < {least} THEN 1 WHEN ways IS NOT NULL THEN least(1, 2 * list_sum(ways[1 : CAST(floor(w) AS BIGINT) + 1]) / power(2, w3.n)) ELSE {normal_p(z)} END AS p
  FROM w3 LEFT JOIN (SELECT {key}, ways FROM ex WHERE k = n) e ON e.{key} = w3.{key})"""


def zero_phase(source: str, fs: float, order: int, pad: int, low: float | None = None, high: float | None = None) -> str:
    """``zp`` (subject_id, idx, value): the spectrum of ``source`` (subject_id, idx, value), extended by odd reflection, times the squared Butterworth gain."""
    warp = lambda f: f"tan(pi() * least({f}, 0.499999 * {fs}) / {fs})"
    w = warp(f"k * {fs} / size")
    if low and high:
        gain = f"CASE WHEN k = 0 THEN 0 ELSE 1 / (1 + power((power({w}, 2) - {warp(low)} * {warp(high)}) / ({w} * ({warp(high)} - {warp(low)})), {2 * order})) END"
    else:
        gain = f"1 / (1 + power({w} / {warp(high)}, {2 * order}))"
    return f"""zx AS (SELECT subject_id, list(value ORDER BY idx) AS x, count(*) AS n, least(count(*) - 1, {pad}) AS pad, CAST(power(2, ceil(log2(count(*) + 2 * least(count(*) - 1, {pad})))) AS BIGINT) AS size FROM {source} GROUP BY 1),
zw AS (SELECT subject_id, n, pad, size, j, CASE WHEN j < pad THEN 2 * x[1] - x[pad - j + 1] WHEN j < pad + n THEN x[j - pad + 1] WHEN j < n + 2 * pad THEN 2 * x[n] - x[2 * n + pad - j - 1] ELSE 2 * x[n] - x[n - pad] END AS y FROM (SELECT *, unnest(range(0, size)) AS j FROM zx)),
zf AS (SELECT subject_id, n, pad, size, k, sum(y * cos(2 * pi() * ((j * k) % size) / size)) AS re, -sum(y * sin(2 * pi() * ((j * k) % size) / size)) AS im FROM zw CROSS JOIN (SELECT unnest(range(0, 2049)) AS k) WHERE k <= size // 2 GROUP BY ALL),
zg AS (SELECT *, {gain} AS gain FROM zf),
zp AS (SELECT subject_id, idx, sum(gain * CASE WHEN k = 0 THEN re WHEN k = size // 2 THEN re * cos(pi() * (idx + pad)) ELSE 2 * (re * cos(2 * pi() * ((k * (idx + pad)) % size) / size) - im * sin(2 * pi() * ((k * (idx + pad)) % size) / size)) END) / any_value(size) AS value
  FROM zg JOIN (SELECT subject_id, idx FROM {source}) USING (subject_id) GROUP BY 1, 2)"""


def recursive(source: str, sections, pad: int) -> str:
    """``rf`` (subject_id, idx, value): ``source`` (subject_id, idx, value) filtered there and back, sample by sample.

    The series is continued by its odd reflection; each section keeps two numbers.
    """
    sections = [[float(v) for v in section] for section in sections]
    names = [f"s{k}{j}" for k in range(len(sections)) for j in (1, 2)]
    steady = []
    gain = 1.0
    for b0, b1, b2, _, a1, a2 in sections:  # what a constant input of 1 leaves in each section, whose input is then the gain so far
        y = gain * (b0 + b1 + b2) / (1 + a1 + a2)
        steady += [f"({y - b0 * gain!r})", f"({b2 * gain - a2 * y!r})"]
        gain = y

    def sweep(name: str, rows: str) -> str:
        inner, x = f"SELECT r.subject_id, r.p, r.x AS x0, {', '.join(f'f.{n}' for n in names)} FROM {name} f JOIN {rows} r ON r.subject_id = f.subject_id AND r.p = f.p + 1", "x0"
        first = f"SELECT subject_id, p, x AS x0, {', '.join(f'{z} * x AS {n}' for z, n in zip(steady, names, strict=True))} FROM {rows} WHERE p = 0"
        for k, (b0, *_) in enumerate(sections):
            inner = f"SELECT *, {b0!r} * {x} + s{k}1 AS x{k + 1} FROM ({inner})"
            first = f"SELECT *, {b0!r} * {x} + s{k}1 AS x{k + 1} FROM ({first})"
            x = f"x{k + 1}"
        state = ", ".join(
            f"{b1!r} * x{k} - ({a1!r}) * x{k + 1} + s{k}2 AS s{k}1, {b2!r} * x{k} - ({a2!r}) * x{k + 1} AS s{k}2" for k, (_, b1, b2, _, a1, a2) in enumerate(sections)
        )
        return f"{name} AS (SELECT subject_id, p, {x} AS y, {state} FROM ({first}) UNION ALL SELECT subject_id, p, {x}, {state} FROM ({inner}))"

    return f"""re AS (SELECT *, count(*) OVER w AS n, first_value(value) OVER (PARTITION BY subject_id ORDER BY idx) AS a, first_value(value) OVER (PARTITION BY subject_id ORDER BY idx DESC) AS z FROM {source} WINDOW w AS (PARTITION BY subject_id)),
rp AS (SELECT *, least({pad}, n - 1) AS k FROM re),
rx AS MATERIALIZED (SELECT subject_id, k + idx AS p, value AS x, n, k FROM rp UNION ALL SELECT subject_id, k - idx, 2 * a - value, n, k FROM rp WHERE idx BETWEEN 1 AND k UNION ALL SELECT subject_id, k + 2 * (n - 1) - idx, 2 * z - value, n, k FROM rp WHERE idx BETWEEN n - 1 - k AND n - 2),
{sweep('rg', 'rx')}, rb AS MATERIALIZED (SELECT g.subject_id, n + 2 * k - 1 - g.p AS p, g.y AS x FROM rg g JOIN rx USING (subject_id, p)), {sweep('rh', 'rb')},
rf AS (SELECT h.subject_id, n + 2 * k - 1 - h.p - k AS idx, y AS value FROM rh h JOIN (SELECT DISTINCT subject_id, n, k FROM rx) USING (subject_id) WHERE n + 2 * k - 1 - h.p - k BETWEEN 0 AND n - 1)"""
