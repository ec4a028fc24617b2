"""Shared SQL for the checks: the panel and what follows from it, as common table expressions.

The SQL is written independently of the Spark plans (range frames and joins where Spark uses
single-row offsets, ``product`` where Spark multiplies columns, and so on).
"""

from __future__ import annotations

from ..functions import scalars as _s

_CR = ",\n".join(
    f"CASE WHEN count(ret) OVER f{k} = {k} THEN product(1 + ret) OVER f{k} - 1 END AS cr{k}" for k in range(1, 13)
)
_CR_FRAMES = ", ".join(
    f"f{k} AS (PARTITION BY id ORDER BY mi RANGE BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in range(1, 13)
)


def cr_oldest() -> str:
    parts = []
    for k in range(1, 13):
        frame = f"(PARTITION BY id ORDER BY mi RANGE BETWEEN 11 PRECEDING AND {12 - k} PRECEDING)"
        parts.append(f"CASE WHEN count(ret) OVER {frame} = {k} THEN product(1 + ret) OVER {frame} - 1 END AS cr{k}")
    return ",\n".join(parts)


def _poly(x: str, coefficients) -> str:
    out = repr(float(coefficients[0]))
    for c in coefficients[1:]:
        out = f"({out} * {x} + {float(c)!r})"
    return out


def ppf(p: str) -> str:
    q = f"(({p}) - 0.5)"
    r = f"(0.180625 - {q} * {q})"
    s = f"sqrt(-ln(CASE WHEN {q} < 0 THEN ({p}) ELSE 1 - ({p}) END))"
    near, far = f"({s} - 1.6)", f"({s} - 5.0)"
    centre = f"{q} * {_poly(r, _s._CENTRE_NUM)} / {_poly(r, _s._CENTRE_DEN)}"
    tail = (
        f"(CASE WHEN {q} < 0 THEN -1 ELSE 1 END) * CASE WHEN {s} <= 5.0 THEN {_poly(near, _s._MIDDLE_NUM)} / {_poly(near, _s._MIDDLE_DEN)} "
        f"ELSE {_poly(far, _s._TAIL_NUM)} / {_poly(far, _s._TAIL_DEN)} END"
    )
    return f"CASE WHEN abs({q}) <= 0.425 THEN {centre} ELSE {tail} END"


def significant(x: str, digits: int = 9) -> str:
    k = f"least({digits} - ceil(log10(abs({x}))), 22)"
    return (
        f"CASE WHEN {x} = 0 THEN 0.0 WHEN {k} >= 0 THEN round({x} * pow(10.0::DOUBLE, {k})) / pow(10.0::DOUBLE, {k}) "
        f"ELSE round({x} / pow(10.0::DOUBLE, -{k})) * pow(10.0::DOUBLE, -{k}) END"
    )


def avg_rank(over: str, value: str) -> str:
    by = f"PARTITION BY {over}" if over else ""
    comma = "," if over else ""
    return (
        f"(rank() OVER ({by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {over}{comma} {value}) - 1) / 2.0)"
    )


def _excess_samples(universe: str) -> str:
    """Samples of features, target and return in excess of the rate."""
    return f"""SELECT f.*, q.date, {ppf('r / (n + 1)')} AS target, q.ret AS excess_ret, CASE WHEN c.mcap > 0 THEN c.mcap END AS cap_prev
        FROM xfeat f JOIN (SELECT *, {avg_rank('mi', 'ret')} AS r, count(*) OVER (PARTITION BY mi) AS n
                           FROM expanel WHERE ret IS NOT NULL{universe}) q USING (id, mi)
        LEFT JOIN panel c ON c.id = f.id AND c.mi = f.mi - 1"""


PARTS: dict[str, tuple[str, str]] = {
    "monthly": (
        "",
        """SELECT l_suppkey AS id, last_day(l_shipdate::DATE)::DATE AS date,
             avg(l_extendedprice / l_quantity) AS price, sum(l_extendedprice) AS mcap
           FROM lineitem GROUP BY 1, 2""",
    ),
    "listed": (
        "",
        """SELECT s_suppkey AS id, n_nationkey AS nation, n_regionkey AS region
           FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""",
    ),
    "prices": (
        "monthly listed",
        """SELECT m.id, (year(date) * 12 + month(date) - 1)::INTEGER AS mi, date, price, mcap,
             CASE WHEN region <= 2 THEN 'N' WHEN region = 3 THEN 'A' ELSE 'Q' END AS exch
           FROM monthly m LEFT JOIN listed l ON l.id = m.id""",
    ),
    "panel": (
        "prices",
        """SELECT a.*, a.price / b.price - 1 AS ret
           FROM prices a LEFT JOIN prices b ON b.id = a.id AND b.mi = a.mi - 1""",
    ),
    "rf": ("panel", "SELECT DISTINCT mi, date, 0.002 + (mi % 12 + 1) * 0.0001::DOUBLE AS rate FROM panel"),
    "expanel": ("panel rf", "SELECT p.* REPLACE (p.ret - coalesce(rate, 0) AS ret) FROM panel p LEFT JOIN rf USING (mi)"),
    "cr": ("panel", f"SELECT id, mi, {_CR} FROM panel WINDOW {_CR_FRAMES}"),
    "feat": ("cr", "SELECT * REPLACE ((mi + 1)::INTEGER AS mi) FROM cr WHERE cr12 IS NOT NULL"),
    "elig": (
        "panel",
        """SELECT m.mi, p.id FROM (SELECT DISTINCT mi FROM panel) m
           JOIN panel p ON p.mi BETWEEN m.mi - 12 AND m.mi - 1 AND p.ret IS NOT NULL
           GROUP BY 1, 2 HAVING count(*) = 12""",
    ),
    "elig_any": (
        "panel",
        """SELECT m.mi, p.id FROM (SELECT DISTINCT mi + 1 AS mi FROM panel) m
           JOIN panel p ON p.mi BETWEEN m.mi - 12 AND m.mi - 1 AND p.ret IS NOT NULL
           GROUP BY 1, 2 HAVING count(*) = 12""",
    ),
    "cand": (
        "panel elig_any",
        """SELECT a.id, (a.mi + 1)::INTEGER AS mi, CASE WHEN a.mcap > 0 THEN a.mcap END AS cap_prev,
             e.id IS NOT NULL AS eligible, b.ret, b.exch, b.id IS NOT NULL AS listed
           FROM panel a LEFT JOIN panel b ON b.id = a.id AND b.mi = a.mi + 1
           LEFT JOIN elig_any e ON e.id = a.id AND e.mi = a.mi + 1""",
    ),
    "scores": (
        "feat",
        """SELECT 'momentum' AS model, mi, id, cr12 AS score FROM feat
           UNION ALL SELECT 'reversal', mi, id, -cr1 FROM feat""",
    ),
    "pool": (
        "cand scores",
        """SELECT s.model, s.mi, s.id, s.score, c.cap_prev, c.ret, c.exch
           FROM scores s JOIN cand c USING (mi, id)
           WHERE c.eligible AND c.cap_prev IS NOT NULL AND c.ret IS NOT NULL""",
    ),
    "bps": (
        "pool",
        """SELECT model, mi, count(*) AS n_pool, count(*) FILTER (WHERE exch = 'N') AS n_bp,
             quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FILTER (WHERE exch = 'N') AS b
           FROM pool GROUP BY 1, 2""",
    ),
    "uni": (
        "cand",
        """SELECT mi, count(*) AS n_universe FROM cand
           WHERE eligible AND cap_prev IS NOT NULL GROUP BY 1 HAVING count(*) >= 10 AND count(ret) > 0""",
    ),
    "months": (
        "scores uni bps",
        """SELECT s.model, s.mi, n_universe, coalesce(n_pool, 0) AS n_pool, coalesce(n_bp, 0) AS n_bp, b,
             NOT (coalesce(n_pool, 0) >= 10 AND coalesce(n_bp, 0) >= 10) AS empty
           FROM (SELECT DISTINCT model, mi FROM scores) s JOIN uni USING (mi) LEFT JOIN bps USING (model, mi)""",
    ),
    "assigned": (
        "pool months",
        """SELECT p.model, p.mi, id, 1 + len(list_filter(b, lambda x: score > x)) AS q, score, cap_prev, ret
           FROM pool p JOIN months m ON m.model = p.model AND m.mi = p.mi AND NOT m.empty""",
    ),
    "deciles": (
        "assigned months",
        """SELECT m.model, g.q::VARCHAR AS portfolio, m.mi, sum(ret * cap_prev) / sum(cap_prev) AS ret, count(a.id) AS n_names
           FROM months m CROSS JOIN (SELECT unnest(range(1, 11)) AS q) g
           LEFT JOIN assigned a ON a.model = m.model AND a.mi = m.mi AND a.q = g.q
           GROUP BY 1, 2, 3""",
    ),
    "series": (
        "deciles",
        """SELECT * FROM deciles UNION ALL
           SELECT h.model, 'long_short', h.mi, h.ret - l.ret, h.n_names + l.n_names
           FROM deciles h JOIN deciles l ON l.model = h.model AND l.mi = h.mi AND h.portfolio = '10' AND l.portfolio = '1'""",
    ),
    "held": ("series", "SELECT * FROM series WHERE ret IS NOT NULL"),
    "market": (
        "cand",
        """SELECT mi, sum(ret * cap_prev) / sum(cap_prev) AS ret FROM cand
           WHERE ret IS NOT NULL AND cap_prev IS NOT NULL GROUP BY 1""",
    ),
    "pairs": ("scores panel", "SELECT s.model, s.mi, s.id, score, ret FROM scores s JOIN panel USING (mi, id) WHERE ret IS NOT NULL"),
    "ics": (
        "pairs",
        f"""SELECT model, mi, corr(a, b) AS correlation, count(*) AS n FROM (
              SELECT model, mi, {avg_rank('model, mi', 'score')} AS a, {avg_rank('model, mi', 'ret')} AS b FROM pairs)
            GROUP BY 1, 2 HAVING count(*) >= 10""",
    ),
    "samples": (
        "feat panel",
        f"""SELECT f.*, p.date, {ppf('r / (n + 1)')} AS target, p.ret AS excess_ret,
              CASE WHEN c.mcap > 0 THEN c.mcap END AS cap_prev
            FROM feat f JOIN (SELECT *, {avg_rank('mi', 'ret')} AS r, count(*) OVER (PARTITION BY mi) AS n
                              FROM panel WHERE ret IS NOT NULL) p USING (id, mi)
            LEFT JOIN panel c ON c.id = f.id AND c.mi = f.mi - 1""",
    ),
    "xcr": ("expanel", f"SELECT id, mi, {_CR} FROM expanel WINDOW {_CR_FRAMES}"),
    "xfeat": ("xcr", "SELECT * REPLACE ((mi + 1)::INTEGER AS mi) FROM xcr WHERE cr12 IS NOT NULL"),
    "xsamples": ("xfeat expanel panel", _excess_samples("")),
    "xsamples_elig": ("xfeat expanel panel elig", _excess_samples(" AND (mi, id) IN (SELECT (mi, id) FROM elig)")),
    "s": ("samples", "SELECT id, mi, CASE WHEN (id + mi) % 9 <> 0 AND mi % 20 <> 7 THEN cap_prev END AS cap FROM samples"),
    "g": ("prices", "SELECT id, mi, price FROM prices WHERE id % 3 <> 0 OR mi % 4 <> 0"),
    "raw": (
        "panel listed",
        """SELECT p.id AS PERMNO, (p.mi // 12 * 100 + p.mi % 12 + 1)::INTEGER AS YYYYMM, p.date AS MthCalDt, p.mi,
             CASE WHEN (p.id + p.mi) % 7 = 0 THEN -price ELSE price END AS MthPrc,
             CASE WHEN (p.id * 13 + p.mi) % 17 <> 0 THEN ret END AS MthRet,
             CASE WHEN (p.id + p.mi) % 29 = 0 THEN 0.0 ELSE mcap / 1000 END AS MthCap,
             CASE WHEN region <= 1 THEN 'N' WHEN region = 2 THEN 'A' WHEN region = 3 THEN 'Q'
                  WHEN p.id % 2 = 0 THEN 'P' ELSE 'Z' END AS PrimaryExch,
             CASE WHEN p.id % 10 = 9 THEN 'N' ELSE 'Y' END AS USIncFlg,
             CASE WHEN p.id % 13 = 12 THEN 'FUND' ELSE 'EQTY' END AS SecurityType,
             ['NS', 'AD', 'SB', 'NS'][p.id % 4 + 1] AS ShareType,
             ['COM', 'ETF', 'COMAD'][p.id % 3 + 1] AS SecuritySubType,
             CASE WHEN (p.id * 13 + p.mi) % 17 = 0 THEN 'Y' ELSE 'N' END AS MthDelFlg,
             CASE WHEN (p.id * 13 + p.mi) % 17 = 0 AND p.mi % 3 = 0 THEN '552'
                  WHEN (p.id * 13 + p.mi) % 17 = 0 AND p.mi % 3 = 1 THEN '231' END AS DelReasonType
           FROM panel p LEFT JOIN listed l ON l.id = p.id""",
    ),
    "rawdup": (
        "raw",
        "SELECT * FROM raw UNION ALL SELECT * REPLACE (MthCap / 2 AS MthCap) FROM raw WHERE (PERMNO + mi) % 31 = 0",
    ),
    "loaded": (
        "raw",
        """SELECT PERMNO AS id, mi, MthCalDt AS date, abs(MthPrc) AS price,
             CASE WHEN MthRet IS NULL AND DelReasonType LIKE '5%' THEN -0.30 ELSE MthRet END AS ret,
             MthCap AS mcap, PrimaryExch AS exch
           FROM raw WHERE USIncFlg = 'Y' AND SecurityType = 'EQTY'
             AND (ShareType IN ('NS', 'AD') OR SecuritySubType IN ('COM', 'COMAD'))
             AND PrimaryExch IN ('N', 'A', 'Q', 'P')""",
    ),
    "daily": (
        "",
        """SELECT l_shipdate::DATE AS date, 'S' || l_suppkey AS id,
             arg_max(l_extendedprice / l_quantity, (l_orderkey * 100 + l_linenumber) * 1000000000 + l_partkey) AS close
           FROM lineitem GROUP BY 1, 2""",
    ),
    "weekly": (
        "",
        """SELECT date_trunc('week', l_shipdate)::DATE + 4 AS date, 'S' || l_suppkey AS id,
             arg_max(l_extendedprice / l_quantity, ((date_diff('day', DATE '1990-01-01', l_shipdate::DATE)::HUGEINT * 1000000000000 + l_orderkey) * 100 + l_linenumber) * 1000000000 + l_partkey) AS close
           FROM lineitem GROUP BY 1, 2""",
    ),
    "mc": (
        "weekly",
        """SELECT id, (year(date) * 12 + month(date) - 1)::INTEGER AS mi, arg_max(close, date) AS price
           FROM weekly WHERE date <= '2001-10-31' GROUP BY 1, 2""",
    ),
    "month_close": (
        "daily",
        """SELECT id, (year(date) * 12 + month(date) - 1)::INTEGER AS mi, last_day(date)::DATE AS date2,
             max(date) AS last_trade, arg_max(close, date) AS price
           FROM daily GROUP BY 1, 2, 3""",
    ),
}


#: Marks SQL that needs WITH RECURSIVE.
RECURSION = "/* recursive */"
#: Marks the last SELECT of SQL that begins with further expressions.
FINAL = "/* final */ "


def split_value(member: str) -> str:
    """Uniform number of a row and member, by the first 32 bits of an MD5."""
    return f"('0x' || substr(md5(concat_ws(':', id, mi, 42 + {member})), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


_Z = "[1.0, " + ", ".join(f"cr{k}" for k in range(1, 13)) + "]"


def eliminated(system: str, keys: str, name: str = "elim", unknowns: int = 13) -> str:
    """Lists (keys, b) that solve ``system`` (keys, i, j, v), whose right side stands behind the last unknown."""
    return f"""{name} AS (SELECT 0 AS p, {keys}, i, j, v FROM {system}
        UNION ALL
        SELECT p + 1, {keys}, i, j, CASE WHEN i = p + 1 THEN v / diag ELSE v - col * line / diag END FROM (
          SELECT *, max(v) FILTER (WHERE j = p + 1) OVER (PARTITION BY {keys}, i) AS col, max(v) FILTER (WHERE i = p + 1) OVER (PARTITION BY {keys}, j) AS line,
            max(v) FILTER (WHERE i = p + 1 AND j = p + 1) OVER (PARTITION BY {keys}) AS diag FROM {name} WHERE p < {unknowns}) q),
        {name}_coef AS (SELECT {keys}, list(v ORDER BY i) AS b FROM {name} WHERE p = {unknowns} AND j = {unknowns + 1} GROUP BY {keys})"""


def system(rows: str, keys: str, target: str = "target", weight: str = "w") -> str:
    """Normal equations of ``rows`` with the intercept among the unknowns, per unit of weight, with the penalty on the slopes."""
    return f"""SELECT {keys}, i, j, sum({weight} * z[i] * z[j]) / sum({weight}) + CASE WHEN i = j AND i > 1 THEN 1e-6 ELSE 0 END AS v
        FROM (SELECT *, list_append({_Z}, {target}) AS z FROM {rows}), (SELECT unnest(range(1, 14)) AS i), (SELECT unnest(range(1, 15)) AS j) GROUP BY {keys}, i, j"""


def predicted(b: str = "b") -> str:
    return f"{b}[1] + " + " + ".join(f"{b}[{k + 1}] * cr{k}" for k in range(1, 13))


WEIGHT = {
    "ew": "1.0",
    "ewpm": "1.0 / count(*) OVER (PARTITION BY mi)",
    "ewpmvw": """CASE WHEN count(cap_prev) OVER (PARTITION BY mi) > 0 THEN coalesce(cap_prev / sum(cap_prev) OVER (PARTITION BY mi), 0)
                 ELSE 1.0 / count(*) OVER (PARTITION BY mi) END""",
}


def fits(periods, fitting: bool = True, weighting: str = "ewpm", source: str = "samples", members: int = 30) -> str:
    """Expressions up to ``coefs`` (model, member, b): every model straight from the rows of its own period."""
    values = ", ".join(f"('{n}', {a}, {b})" for n, a, b in periods)
    where = "WHERE year(date) % 2 = month(date) % 2" if fitting else ""
    return f""", {RECURSION} fit_periods(model, lo, hi) AS (VALUES {values}),
      fit_pool AS (SELECT *, {WEIGHT[weighting]} AS w FROM {source} {where}),
      fit_rows AS (SELECT * FROM fit_pool, (SELECT unnest(range({members})) AS member) WHERE NOT ({split_value('member')} < 0.3)),
      fit_system AS ({system('(SELECT r.*, model FROM fit_rows r JOIN fit_periods ON mi BETWEEN lo AND hi)', 'model, member')}),
      {eliminated('fit_system', 'model, member')},
      coefs AS (SELECT * FROM elim_coef)"""


def ensemble_scores(feats: str, condition: str = "true", carry: str = "") -> str:
    """Mean over members of their forecasts of every row and model: model, mi, id, score, uncertainty."""
    extra = f", {carry}" if carry else ""
    return f"""SELECT model, mi, id{extra}, avg(p) AS score, stddev_pop(p) AS uncertainty
        FROM (SELECT f.*, model, member, {predicted()} AS p FROM {feats} f, coefs WHERE {condition}) GROUP BY model, mi, id{extra}"""


def with_parts(names: str, body: str) -> str:
    """``body`` preceded by the named expressions and everything they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in PARTS[n][0].split():
            add(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    if not order:
        return body
    recursive = "RECURSIVE " if RECURSION in body else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" + body


def rounded(body: str, columns: str, digits: int) -> str:
    if not columns:
        return body
    rep = ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())
    head, mark, body = body.rpartition(FINAL)
    return f"{head}{mark}SELECT * REPLACE ({rep}) FROM ({body})" if mark else f"SELECT * REPLACE ({rep}) FROM ({body})"
