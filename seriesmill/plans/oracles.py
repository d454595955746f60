"""DuckDB twins of the registered queries, where SQL can express them."""

from __future__ import annotations

from ..kernels import numbers
from ..kernels.panel import SHORT_NAMES
from ..params import PERIODIC, StlOptions
from .inputs import SQL as SERIES
from .inputs import TYPES

ORACLES: dict[str, str] = {}


def r(x: str, places: int = 8) -> str:
    return f"(round({x}, {places}) + 0.0)"


def add(name: str, series: str, select: str, more: str = "", recursive: bool = False) -> None:
    ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{SERIES[series]}{', ' + more if more else ''} {select}"


# --- transforms --------------------------------------------------------------------------

add("center", "om", f"SELECT t, {r('y - avg(y) OVER ()')} AS centered FROM om")
add("z_score", "om", f"SELECT t, {r('(y - avg(y) OVER ()) / stddev_samp(y) OVER ()')} AS z FROM om")
add("min_max", "om", f"SELECT t, {r('(y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ())')} AS scaled FROM om")
add("z_score_panel", "op", f"SELECT p, t, {r('(y - avg(y) OVER (PARTITION BY p)) / stddev_samp(y) OVER (PARTITION BY p)')} AS z FROM op")
add("standard_scaler_train_test", "om", f"SELECT t, {r('(y - m) / s')} AS z, {r('(y - m) / s * s + m')} AS y_back FROM om, (SELECT avg(y) AS m, stddev_samp(y) AS s FROM om WHERE t < 60) WHERE t >= 60")
add("min_max_scaler_inverse", "om", f"SELECT t, {r('(y - lo) / (hi - lo)')} AS scaled, {r('y')} AS y_back FROM om, (SELECT min(y) AS lo, max(y) AS hi FROM om WHERE t < 60) WHERE t >= 60")
add("box_cox_l0", "om", f"SELECT t, {r('ln(y)')} AS transformed FROM om")
add("box_cox_l05", "om", f"SELECT t, {r('(power(y, 0.5) - 1) / 0.5')} AS transformed FROM om")
add("inv_box_cox_roundtrip", "om", f"SELECT t, {r('power(1 + 0.3 * ((power(y, 0.3) - 1) / 0.3), 1 / 0.3::DOUBLE)')} AS y_back FROM om")

# --- decomposition -----------------------------------------------------------------------

_FILLED = """g AS (SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y0,
  last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t0,
  first_value(y IGNORE NULLS) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y1,
  first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER (PARTITION BY p ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM op),
f AS (SELECT p, t, y, CASE WHEN y IS NOT NULL THEN y WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (t - t0) / (t1 - t0) END AS x FROM g)"""

add("interpolate_missing", "op", f"SELECT p, t, {r('x', 5)} AS filled FROM f", _FILLED)


def _decomposed(source: str, key: str, period: int, times: bool) -> str:
    """CTEs up to ``dec`` (key, t, trend, seasonal, residual) of rows (key, t, x, y)."""
    by, only = (f"PARTITION BY {key}", f"{key}, ") if key else ("", "")
    h = period // 2
    whole = f"sum(x) OVER ({by} ORDER BY t ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    inner = f"sum(x) OVER ({by} ORDER BY t ROWS BETWEEN {h - 1} PRECEDING AND {h - 1} FOLLOWING)"
    full = f"count(*) OVER ({by} ORDER BY t ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) = {2 * h + 1}"
    mean = f"{whole} / {period}" if period % 2 else f"({whole} + {inner}) / {2 * period}"
    op = "/" if times else "-"
    return f"""d1 AS (SELECT *, CASE WHEN {full} THEN {mean} END AS trend FROM {source}),
d2 AS (SELECT *, t % {period} AS phase, x {op} trend AS rest FROM d1),
d3 AS (SELECT {only}phase, avg(rest) AS pat FROM d2 GROUP BY ALL),
d4 AS (SELECT {only}phase, pat {op} avg(pat) OVER ({by}) AS seasonal FROM d3),
dec AS (SELECT d2.*, d4.seasonal, CASE WHEN y IS NOT NULL THEN {'x / (trend * seasonal)' if times else 'x - trend - seasonal'} END AS residual
  FROM d2 JOIN d4 ON d2.phase = d4.phase {f'AND d2.{key} = d4.{key}' if key else ''})"""


_DEC = f"t, {r('trend', 5)} AS trend, {r('seasonal', 5)} AS seasonal, {r('residual', 5)} AS residual FROM dec"
_OMX = "omx AS (SELECT t, y, y AS x FROM om), "
add("sd_additive", "om", f"SELECT {_DEC}", _OMX + _decomposed("omx", "", 12, False))
add("sd_multiplicative", "om", f"SELECT {_DEC}", _OMX + _decomposed("omx", "", 12, True))
add("sd_odd_period", "om", f"SELECT {_DEC}", _OMX + _decomposed("omx", "", 5, False))
add("sd_interpolate", "op", f"SELECT p, {_DEC}", _FILLED + ", " + _decomposed("f", "p", 12, False))
_NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_PIVOT = ", ".join(f"{r(f'max(CASE WHEN p = {chr(39)}{p}{chr(39)} THEN trend END)', 5)} AS p{k + 1}" for k, p in enumerate(_NAMES))
add("sd_batch_wide", "op", f"SELECT t, {_PIVOT} FROM dec GROUP BY t", _FILLED + ", " + _decomposed("f", "p", 12, False))

# --- LOESS -------------------------------------------------------------------------------


def _loess(source: str, points: str, span: float, degree: int) -> str:
    """CTE ``fit`` (x, smoothed): weighted sums of powers and closed forms."""
    sums = ", ".join(f"sum(w * power(d, {p})) AS s{p}" for p in range(5)) + ", " + ", ".join(f"sum(w * power(d, {p}) * y) AS b{p}" for p in range(3))
    det = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))"
    value = ["b0 / s0", "(s2 * b0 - s1 * b1) / (s0 * s2 - s1 * s1)", f"(b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - s3 * b2) + s2 * (b1 * s3 - s2 * b2)) / {det}"][degree]
    return f"""size AS (SELECT count(*) AS n, least(count(*), greatest(ceil({span} * count(*))::BIGINT, {degree + 2})) AS k FROM {source}),
pt AS (SELECT x::DOUBLE AS x, n, k, least(greatest(floor(least(greatest(x, 0), n - 1) - k // 2), 0), n - k) AS lo FROM ({points}), size),
win AS (SELECT x, (s.t - x)::DOUBLE AS d, y, abs(s.t - x) / (greatest(x - lo, lo + k - 1 - x, 1) + 1) AS u FROM pt JOIN {source} s ON s.t >= lo AND s.t < lo + k),
acc AS (SELECT x, {sums} FROM (SELECT *, power(1 - u * u * u, 3) AS w FROM win WHERE u < 1) GROUP BY x),
fit AS (SELECT x, {value} AS smoothed FROM acc)"""


for _d in (0, 1, 2):
    add(f"loess_d{_d}", "eh", f"SELECT x::BIGINT AS t, {r('smoothed', 6)} AS smoothed FROM fit", _loess("eh", "SELECT t AS x FROM eh", 0.3, _d))
add("loess_at", "om", f"SELECT x, {r('smoothed', 6)} AS smoothed FROM fit", _loess("om", "SELECT unnest([-2.0, 0.5, 10.25, 39.5, 79.0, 83.0])::DOUBLE AS x", 0.4, 1))

_WIDE = ", ".join(f"max(CASE WHEN k = '{k}' THEN v END) AS {k}" for k in TYPES)


_EVERY = "every AS MATERIALIZED (SELECT k, t, coalesce(y, 0.0) AS y FROM (SELECT DISTINCT t FROM et) CROSS JOIN (SELECT DISTINCT k FROM et) LEFT JOIN et USING (k, t))"


def _each_type(select: str, more: str) -> str:
    """``select`` (columns) over the CTEs ``more`` of every type's series ``eh``, one after the other."""
    return " UNION ALL ".join(f"SELECT '{k}' AS k, * FROM (WITH eh AS (SELECT t, y FROM every WHERE k = '{k}'), {more} {select})" for k in TYPES)


add(
    "loess_batch_wide", "et", "SELECT t, " + _WIDE + " FROM (" + _each_type(f"SELECT x::BIGINT AS t, {r('smoothed', 6)} AS v FROM fit", _loess("eh", "SELECT t AS x FROM eh", 0.2, 1)) + ") GROUP BY t",
    _EVERY,
)

# --- exponential smoothing ---------------------------------------------------------------


def _holt_winters(a: float, b: float, g: float, m: int, times: bool) -> str:
    """Recursive CTE ``hw`` over time: fitted, level, trend and the season as a list."""
    op, back = ("*", "/") if times else ("+", "-")
    if g:
        trend = f"((SELECT avg(y) FROM s WHERE t >= {m} AND t < {2 * m}) - (SELECT avg(y) FROM s WHERE t < {m})) / {m}" if b else "0.0"
        start = f"SELECT -1::BIGINT AS t, NULL::DOUBLE AS fitted, l::DOUBLE AS l, b::DOUBLE AS b, (SELECT list(y {back} l ORDER BY t) FROM s WHERE t < {m}) AS z FROM (SELECT (SELECT avg(y) FROM s WHERE t < {m}) AS l, {trend} AS b)"
        season = f"z[(s.t % {m} + 1)::INT]"
        told, seen = f"(l + b) {op} {season}", f"y {back} {season}"
        after = f"list_concat(list_concat(z[1:(s.t % {m})::INT], [{g} * (y {back} nl) + (1 - {g}) * {season}]), z[(s.t % {m} + 2)::INT:])"
    else:
        trend = "(SELECT y FROM s WHERE t = 1) - (SELECT y FROM s WHERE t = 0)" if b else "0.0"
        start = f"SELECT -1::BIGINT AS t, NULL::DOUBLE AS fitted, (SELECT y FROM s WHERE t = 0)::DOUBLE AS l, ({trend})::DOUBLE AS b, []::DOUBLE[] AS z"
        told, seen, after = "l + b", "y", "z"
    return f"""s AS (SELECT t, y FROM om),
hw AS ({start} UNION ALL
  SELECT t, fitted, nl, {f'{b} * (nl - l) + (1 - {b}) * b' if b else 'b'}, {after.replace('s.t', 't')} FROM
   (SELECT s.t AS t, y, {told} AS fitted, l, b, z, {a} * ({seen}) + (1 - {a}) * (l + b) AS nl FROM hw JOIN s ON s.t = hw.t + 1))"""


for _name, _args in {
    "hw_ses": (0.4, 0.0, 0.0, 0, False),
    "hw_holt": (0.4, 0.2, 0.0, 0, False),
    "hw_additive": (0.3, 0.1, 0.2, 12, False),
    "hw_multiplicative": (0.3, 0.1, 0.2, 12, True),
    "hw_seasonal_only": (0.3, 0.0, 0.2, 12, False),
}.items():
    add(_name, "om", f"SELECT t, {r('fitted')} AS fitted FROM hw WHERE t >= 0", _holt_winters(*_args), True)
add("hw_forecast", "om", f"SELECT h::INT AS h, {r('l + h * b + z[((t + h) % 12 + 1)::INT]')} AS forecast FROM hw, (SELECT unnest(range(1, 19)) AS h) WHERE t = (SELECT max(t) FROM om)", _holt_winters(0.3, 0.1, 0.2, 12, False), True)

# --- tests -------------------------------------------------------------------------------


def _kpss(source: str, trend: bool, name: str = "k") -> str:
    """CTE ``{name}`` (statistic, lags) of rows (t, y)."""
    base = f"SELECT t, y - regr_slope(y, t) OVER () * t - regr_intercept(y, t) OVER () AS e FROM {source}" if trend else f"SELECT t, y - avg(y) OVER () AS e FROM {source}"
    return f"""{name}0 AS ({base}),
{name}1 AS (SELECT count(*)::DOUBLE AS n, least(greatest(1, floor(12 * power(count(*) / 100.0, 0.25))::INT), count(*) - 1)::INT AS lags, sum(e * e) AS ss FROM {name}0),
{name}2 AS (SELECT k, sum(a.e * b.e) AS c FROM (SELECT unnest(range(1, lags + 1)) AS k FROM {name}1) JOIN {name}0 a ON true JOIN {name}0 b ON b.t = a.t - k GROUP BY k),
{name}3 AS (SELECT sum(c * c) AS q FROM (SELECT sum(e) OVER (ORDER BY t) AS c FROM {name}0)),
{name} AS (SELECT q / (n * n * (ss / n + (SELECT sum(2 * (1 - k / (lags + 1.0)) * c / n) FROM {name}2))) AS statistic, lags FROM {name}1, {name}3)"""


def _p_value(c: tuple[float, ...]) -> str:
    levels = (0.01, 0.025, 0.05, 0.10)
    cases = " ".join(f"WHEN statistic >= {c[i + 1]} THEN {levels[i]} + ({c[i]} - statistic) / ({c[i]} - {c[i + 1]}) * ({levels[i + 1]} - {levels[i]})" for i in range(3))
    return f"CASE WHEN statistic >= {c[0]} THEN 0.01 {cases} ELSE 0.10 END"


for _name, _trend, _c in (("kpss_c", False, (0.739, 0.574, 0.463, 0.347)), ("kpss_ct", True, (0.216, 0.176, 0.146, 0.119))):
    add(_name, "eh", f"SELECT {r('statistic')} AS statistic, lags, {_c[2]}::DOUBLE AS critical_5pct, {r(f'({_p_value(_c)})::DOUBLE')} AS p_value, statistic > {_c[2]} AS reject FROM k", _kpss("eh", _trend))

add(
    "ljung_box", "eh",
    f"""SELECT {r('statistic', 6)} AS statistic, 10 AS df, {r('1 - 0.5 * (1 + sign(z) * (1 - u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429)))) * exp(-x * x)))', 6)} AS p_value, 12 AS lags
    FROM (SELECT *, abs(z) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS u FROM (SELECT statistic, (cbrt(statistic / 10) - (1 - 2 / 90.0)) / sqrt(2 / 90.0) AS z FROM q))""",
    """e AS (SELECT t, y - avg(y) OVER () AS e FROM eh), v AS (SELECT count(*)::DOUBLE AS n, sum(e * e) AS s FROM e),
    a AS (SELECT k, sum(x.e * z.e) AS c FROM (SELECT unnest(range(1, 13)) AS k) JOIN e x ON true JOIN e z ON z.t = x.t - k GROUP BY k),
    q AS (SELECT n * (n + 2) * (SELECT sum(power(c / s, 2) / (n - k)) FROM a) AS statistic FROM v)""",
)

_STRENGTH = "strength AS (SELECT coalesce(least(greatest(1 - var_pop(residual) / var_pop(residual + seasonal), 0), 1), 0) AS strength FROM dec WHERE residual IS NOT NULL)"
add("seasonal_strength", "om", f"SELECT {r('strength')} AS strength FROM strength", _OMX + _decomposed("omx", "", 12, False) + ", " + _STRENGTH)
add("nsdiffs", "om", "SELECT (strength > 0.64)::INT AS seasonal_d FROM strength", _OMX + _decomposed("omx", "", 12, False) + ", " + _STRENGTH)
add(
    "ndiffs", "om", "SELECT CASE WHEN k.statistic <= 0.463 THEN 0 WHEN j.statistic <= 0.463 THEN 1 ELSE 2 END AS d FROM k, j",
    _kpss("om", False) + ", om1 AS (SELECT t, y FROM (SELECT t, y - lag(y) OVER (ORDER BY t) AS y FROM om) WHERE y IS NOT NULL), " + _kpss("om1", False, "j"),
)

# --- STL ---------------------------------------------------------------------------------


def _line(name: str, source: str, window: str, before: int = 0, after: int = 0, jump: int = 1) -> str:
    """CTE ``name`` (g, t, y): straight lines fitted to ``source`` (g, t, y, w) around every
    place from ``before`` its first to ``after`` its last; with ``jump`` every so many
    places and the last, and lines between."""
    out = f"""{name}_n AS (SELECT g, count(*) AS n FROM {source} GROUP BY g),
{name}_p AS (SELECT g, n, k, x, least(greatest(least(greatest(x, 0), n - 1) - k // 2, 0), n - k) AS lo FROM (SELECT g, n, least({window}, n) AS k, unnest(range(-{before}, n + {after})) AS x FROM {name}_n)),
{name}_w AS (SELECT p.g, x, (s.t - x)::DOUBLE AS d, y, w * power(1 - power(abs(s.t - x) / (greatest(x - lo, lo + k - 1 - x, 1) + 1.0::DOUBLE), 3), 3) AS v FROM (SELECT *, unnest(range(lo, lo + k)) AS place FROM {name}_p) p JOIN {source} s ON s.g = p.g AND s.t = p.place),
{name}_a AS (SELECT g, x, sum(v) AS s0, sum(v * d) AS s1, sum(v * d * d) AS s2, sum(v * y) AS b0, sum(v * d * y) AS b1 FROM {name}_w GROUP BY g, x),
{name}_f AS (SELECT g, x AS t, (s2 * b0 - s1 * b1) / (s0 * s2 - s1 * s1) AS y FROM {name}_a)"""
    if jump == 1:
        return out + f", {name} AS MATERIALIZED (SELECT * FROM {name}_f)"
    return out + f""", {name}_k AS (SELECT f.g, t, y, t % {jump} = 0 OR t = n - 1 AS kept, t BETWEEN 0 AND n - 1 AS inner_ FROM {name}_f f JOIN {name}_n USING (g)),
{name}_b AS (SELECT *, max(CASE WHEN kept THEN t END) OVER up AS t0, min(CASE WHEN kept THEN t END) OVER down AS t1, last_value(CASE WHEN kept THEN y END IGNORE NULLS) OVER up AS y0, first_value(CASE WHEN kept THEN y END IGNORE NULLS) OVER down AS y1
  FROM {name}_k WHERE inner_ WINDOW up AS (PARTITION BY g ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), down AS (PARTITION BY g ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS MATERIALIZED (SELECT g, t, CASE WHEN t0 = t1 THEN y ELSE y0 + (y1 - y0) * (t - t0) / (t1 - t0)::DOUBLE END AS y FROM {name}_b UNION ALL SELECT g, t, y FROM {name}_k WHERE NOT inner_)"""


def _stl(source: str, o: StlOptions) -> str:
    """CTE ``stl`` (k, t, trend, seasonal, residual) of rows (k, t, x), step by step."""
    p = o.period
    out = [f"x0 AS MATERIALIZED (SELECT k, t, {'ln(x)' if o.mode == 'multiplicative' else 'x'} AS x, 1.0::DOUBLE AS w, 0.0::DOUBLE AS trend FROM {source})"]
    state = "x0"
    for outer in range(o.outer + 1):
        for inner in range(o.inner):
            v = f"v{outer}_{inner}"
            out.append(f"{v}c AS (SELECT k || '/' || t % {p} AS g, t // {p} AS t, x - trend AS y, w FROM {state})")
            if o.seasonal == PERIODIC:
                out.append(f"{v}s AS (SELECT g, unnest(range(-1, count(*) + 1)) AS t, sum(w * y) / sum(w) AS y FROM {v}c GROUP BY g)")
            else:
                out.append(_line(f"{v}s", f"{v}c", str(max(o.seasonal, 3)), 1, 1, o.seasonal_jump))
            out.append(f"{v}l0 AS MATERIALIZED (SELECT split_part(g, '/', 1) AS k, (t + 1) * {p} + split_part(g, '/', 2)::BIGINT AS t, y FROM {v}s)")
            for step, width in enumerate((p, p, 3)):
                out.append(f"{v}l{step + 1} AS (SELECT k, t, y FROM (SELECT k, t, avg(y) OVER ahead AS y, count(*) OVER ahead AS c FROM {v}l{step} WINDOW ahead AS (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)) WHERE c = {width})")
            out.append(f"{v}m AS MATERIALIZED (SELECT k AS g, t, y, 1.0::DOUBLE AS w FROM {v}l3)")
            out.append(_line(f"{v}q", f"{v}m", str(max(o.low_pass_window, 3)), jump=o.low_pass_jump))
            out.append(f"{v}z AS MATERIALIZED (SELECT s.k, s.t, s.x, s.w, c.y - q.y AS seasonal FROM {state} s JOIN {v}l0 c ON c.k = s.k AND c.t = s.t + {p} JOIN {v}q q ON q.g = s.k AND q.t = s.t)")
            out.append(f"{v}d AS (SELECT k AS g, t, x - seasonal AS y, w FROM {v}z)")
            out.append(_line(f"{v}t", f"{v}d", str(max(o.trend_window, 3)), jump=o.trend_jump))
            out.append(f"{v} AS MATERIALIZED (SELECT z.k, z.t, x, w, seasonal, r.y AS trend FROM {v}z z JOIN {v}t r ON r.g = z.k AND r.t = z.t)")
            state = v
        if outer < o.outer:
            out.append(f"h{outer} AS (SELECT k, 6 * median(abs(x - trend - seasonal)) AS h FROM {state} GROUP BY k)")
            out.append(f"x{outer + 1} AS MATERIALIZED (SELECT k, t, x, CASE WHEN abs(x - trend - seasonal) < h THEN power(1 - power((x - trend - seasonal) / h, 2), 2) ELSE 0.0 END AS w, 0.0::DOUBLE AS trend FROM {state} JOIN h{outer} USING (k))")
            state = f"x{outer + 1}"
    value = "exp({0})" if o.mode == "multiplicative" else "{0}"
    parts = ", ".join(f"{value.format(e)} AS {c}" for c, e in (("trend", "trend"), ("seasonal", "seasonal"), ("residual", "x - trend - seasonal")))
    return ",\n".join([*out, f"stl AS (SELECT k, t, {parts} FROM {state})"])


_PARTS = ", ".join(f"{r(c, 6)} AS {c}" for c in ("trend", "seasonal", "residual"))
for _name, _o in {
    "stl_additive": StlOptions(12),
    "stl_multiplicative": StlOptions(12, mode="multiplicative"),
    "stl_robust": StlOptions(12, outer=5),
    "stl_periodic": StlOptions(12, seasonal=PERIODIC),
    "stl_jump": StlOptions(12, seasonal_jump=2, trend_jump=3, low_pass_jump=2),
}.items():
    add(_name, "om", f"SELECT t, {_PARTS} FROM stl", "kx AS (SELECT '' AS k, t, y AS x FROM om), " + _stl("kx", _o))
add(
    "stl_interpolate", "op",
    f"SELECT p, stl.t AS t, {r('trend', 6)} AS trend, {r('seasonal', 6)} AS seasonal, CASE WHEN y IS NOT NULL THEN {r('residual', 6)} END AS residual FROM stl JOIN f ON f.p = stl.k AND f.t = stl.t",
    _FILLED + ", kx AS (SELECT p AS k, t, x FROM f), " + _stl("kx", StlOptions(12)),
)
add("stl_events_panel", "et", f"SELECT k, t, {_PARTS} FROM stl", "kx AS (SELECT k, t, y AS x FROM et), " + _stl("kx", StlOptions(24)))
add("stl_batch_wide", "et", f"SELECT t, {_WIDE.replace('THEN v', 'THEN ' + r('seasonal', 6))} FROM stl GROUP BY t", _EVERY + ", kx AS (SELECT k, t, y AS x FROM every), " + _stl("kx", StlOptions(24)))

# --- choosing exponents ------------------------------------------------------------------


def _least(low: float, high: float, source: str, loss: str, levels: int = 8) -> str:
    """CTE ``best`` (k, lam): the least ``loss`` (an aggregate over ``source`` with lam) by
    grids of 21 places, each ten times as fine as the one before and around its best."""
    step = (high - low) / 20
    out = f"g0 AS (SELECT k, {low} + i * {step}::DOUBLE AS lam FROM (SELECT DISTINCT k FROM {source}), (SELECT unnest(range(0, 21)) AS i))"
    for n in range(levels):
        out += f", o{n} AS (SELECT k, lam, {loss} AS v FROM g{n} JOIN {source} USING (k) GROUP BY k, lam), b{n} AS (SELECT k, arg_min(lam, v) AS lam FROM o{n} GROUP BY k)"
        step /= 10
        out += f", g{n + 1} AS (SELECT DISTINCT k, least(greatest(lam + (i - 10) * {step:.3e}, {low}), {high}) AS lam FROM b{n}, (SELECT unnest(range(0, 21)) AS i))"
    return out + f", best AS (SELECT * FROM b{levels - 1})"


_BC = "CASE WHEN lam = 0 THEN ln(y) ELSE (power(y, lam) - 1) / lam END"
_LAM = f"SELECT k, {r('lam', 4)} AS lam FROM best"
add("box_cox_mle", "lm", _LAM, _least(-2, 2, "lm", f"0.5 * count(*) * ln(var_pop({_BC})) - (lam - 1) * sum(ln(y))"))


def _polynomial(c: tuple[float, ...], x: str) -> str:
    out = repr(c[0]) + "::DOUBLE"
    for v in c[1:]:
        out = f"({out} * {x} + {v!r}::DOUBLE)"
    return out


_TAIL = f"{_polynomial(numbers._C, 's')} / {_polynomial((*numbers._D, 1.0), 's')}"
add(
    "box_cox_pearsonr", "lm", _LAM,
    f"""lq AS MATERIALIZED (SELECT k, y, CASE WHEN p < 0.02425 THEN {_TAIL} WHEN p > 1 - 0.02425 THEN -({_TAIL}) ELSE {_polynomial(numbers._A, 'power(p - 0.5, 2)')} * (p - 0.5) / {_polynomial((*numbers._B, 1.0), 'power(p - 0.5, 2)')} END AS q
    FROM (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS s FROM (SELECT k, y, (row_number() OVER (PARTITION BY k ORDER BY y) - 0.375) / (count(*) OVER (PARTITION BY k) + 0.25)::DOUBLE AS p FROM lm))), """
    + _least(-2, 2, "lq", f"-corr({_BC}, q)"),
)
add(
    "box_cox_guerrero", "lm", _LAM,
    "cl AS MATERIALIZED (SELECT k, avg(y) AS m, stddev_samp(y) AS s FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM lm) WHERE t < n // 12 * 12 GROUP BY k, t // 12), "
    + _least(-1, 2, "cl", "stddev_samp(s / power(m, 1 - lam)) / abs(avg(s / power(m, 1 - lam)))"),
)
add("box_cox_fitted_roundtrip", "lm", f"SELECT k, t, {r('y', 6)} AS y_back FROM lm")

# --- features ----------------------------------------------------------------------------

_Z = "z AS (SELECT t, (y - avg(y) OVER ()) / stddev_samp(y) OVER () AS x, count(*) OVER () AS n FROM eh)"


FEATURES: dict[str, tuple[str, str]] = {}


def feature(name: str, value: str, more: str = "") -> None:
    """``value`` is a SELECT of one column ``v``."""
    FEATURES[name] = value, more
    add(f"c22_{name}", "eh", f"SELECT {r('v', 6)} AS value FROM ({value})", _Z + (", " + more if more else ""))


for _bins in (5, 10):
    feature(
        f"mode_{_bins}", "SELECT avg(lo + w * (b + 0.5)) AS v FROM c, lim WHERE c = (SELECT max(c) FROM c)",
        f"lim AS (SELECT min(x) AS lo, (max(x) - min(x)) / {_bins} AS w FROM z), c AS (SELECT least(floor((x - lo) / w), {_bins - 1}) AS b, count(*) AS c FROM z, lim GROUP BY 1)",
    )
feature(
    "ami2", "SELECT sum(p * ln(p / (px * py))) AS v FROM (SELECT p, sum(p) OVER (PARTITION BY a) AS px, sum(p) OVER (PARTITION BY b) AS py FROM j)",
    """lim AS (SELECT min(x) - 0.1 AS lo, (max(x) - min(x) + 0.2) / 5 AS w FROM z), c AS (SELECT t, least(greatest(floor((x - lo) / w), 0), 4) AS b FROM z, lim),
    j AS (SELECT f.b AS a, g.b AS b, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM c f JOIN c g ON g.t = f.t + 2 GROUP BY 1, 2)""",
)
_STEP = "s AS (SELECT t, x - lag(x) OVER (ORDER BY t) AS d FROM z)"
feature("trev", "SELECT avg(power(d, 3)) AS v FROM s", _STEP)
feature("high_fluctuation", "SELECT avg((abs(d) > 0.04)::INT) AS v FROM s WHERE d IS NOT NULL", _STEP)
_GAPS = "SELECT max(t - coalesce(before, 0)) AS v FROM (SELECT t, lag(t) OVER (ORDER BY t) AS before FROM stop)"
feature("stretch_high", _GAPS, "stop AS (SELECT t FROM z WHERE t < n - 1 AND (x <= (SELECT avg(x) FROM z) OR t = n - 2))")
feature("stretch_decreasing", _GAPS, _STEP + ", stop AS (SELECT t - 1 AS t FROM s WHERE d IS NOT NULL AND (d >= 0 OR t = (SELECT max(t) FROM s)))")
feature(
    "entropy_pairs", "SELECT -sum(p * ln(p)) AS v FROM (SELECT count(*)::DOUBLE / (SELECT count(*) - 1 FROM z) AS p FROM l f JOIN l g ON g.t = f.t + 1 GROUP BY f.b, g.b)",
    """o AS (SELECT list(x ORDER BY x) AS a, count(*) AS n FROM z), q AS (SELECT unnest([1, 2]) AS i, a, n * unnest([1, 2]) / 3.0::DOUBLE - 0.5 AS pos FROM o),
    cut AS (SELECT i, a[floor(pos)::INT + 1] + (pos - floor(pos)) * (a[ceil(pos)::INT + 1] - a[floor(pos)::INT + 1]) AS c FROM q),
    l AS (SELECT t, (x > (SELECT c FROM cut WHERE i = 1))::INT + (x > (SELECT c FROM cut WHERE i = 2))::INT AS b FROM z)""",
)
feature("forecast_error", "SELECT stddev_samp(x - m) AS v FROM (SELECT t, x, avg(x) OVER (ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM z) WHERE t >= 3")
_ACF = "acf AS (SELECT k, c / max(c) FILTER (k = 0) OVER () AS a FROM (SELECT b.t - f.t AS k, sum(f.x * b.x) AS c FROM z f JOIN z b ON b.t >= f.t GROUP BY 1))"
_NEXT = _ACF + ", nx AS (SELECT k, a, lag(a) OVER (ORDER BY k) AS p, lead(a) OVER (ORDER BY k) AS q FROM acf)"
feature("acf_timescale", "SELECT coalesce(arg_min(k - 1 + (p - exp(-1)) / (p - a), k), (SELECT any_value(n) FROM z)) AS v FROM nx WHERE p >= exp(-1) AND a < exp(-1)", _NEXT)
feature("acf_first_min", "SELECT coalesce(min(k), (SELECT any_value(n) FROM z))::DOUBLE AS v FROM nx WHERE a < p AND a < q", _NEXT)
feature(
    "whiten_timescale", "SELECT (SELECT coalesce(min(k), (SELECT any_value(n) - 1 FROM z)) FROM racf WHERE k > 0 AND a <= 0)::DOUBLE / (SELECT coalesce(min(k), (SELECT any_value(n) FROM z)) FROM acf WHERE k > 0 AND a <= 0) AS v",
    _ACF + ", " + _STEP + ", e AS (SELECT t, d - avg(d) OVER () AS x FROM s WHERE d IS NOT NULL), racf AS (SELECT b.t - f.t AS k, sum(f.x * b.x) AS a FROM e f JOIN e b ON b.t >= f.t GROUP BY 1)",
)
feature(
    "ami_timescale", "SELECT coalesce(min(k - 1), 40)::DOUBLE AS v FROM (SELECT k, i, lag(i) OVER (ORDER BY k) AS p, lead(i) OVER (ORDER BY k) AS q FROM c) WHERE i < p AND i < q",
    "c AS (SELECT k, -0.5 * ln(1 - power(corr(f.x, b.x), 2)) AS i FROM (SELECT unnest(range(1, 41)) AS k) JOIN z f ON true JOIN z b ON b.t = f.t + k GROUP BY k)",
)
_DFT = """size AS (SELECT any_value(n) AS n, power(2, ceil(log2(any_value(n))))::BIGINT AS m, avg(x) AS mu FROM z),
    f AS (SELECT unnest(range(0, m // 2 + 1)) AS j, n, m, mu FROM size),
    sp AS (SELECT j, any_value(m) AS m, (power(sum((x - mu) * cos(2 * pi() * j * t / m)), 2) + power(sum((x - mu) * sin(2 * pi() * j * t / m)), 2)) / any_value(f.n) * CASE WHEN j = 0 OR j = any_value(m) // 2 THEN 1 ELSE 2 END / (2 * pi()) AS p
      FROM f JOIN z ON true GROUP BY j)"""
feature("centroid_freq", "SELECT sum(p) * 2 * pi() / any_value(m) AS v FROM sp WHERE j < (m // 2 + 1) // 5", _DFT)
feature("low_freq_power", "SELECT 2 * pi() * min(j) / any_value(m) AS v FROM (SELECT j, m, sum(p) OVER (ORDER BY j) AS c, sum(p) OVER () AS s FROM sp) WHERE c > s / 2", _DFT)
_ZERO = _ACF + ", zero AS (SELECT coalesce(min(k), (SELECT any_value(n) FROM z))::BIGINT AS tau FROM acf WHERE k > 0 AND a <= 0)"
feature(
    "transition_matrix", "SELECT sum(s) AS v FROM (SELECT var_samp(c) AS s FROM g GROUP BY b)",
    _ZERO + """, dn AS (SELECT t // tau AS t, x FROM z, zero WHERE t % tau = 0),
    o AS (SELECT list(x ORDER BY x) AS a, count(*) AS n FROM dn), q AS (SELECT unnest([1, 2]) AS i, a, n * unnest([1, 2]) / 3.0::DOUBLE - 0.5 AS pos FROM o),
    cut AS (SELECT i, a[floor(pos)::INT + 1] + (pos - floor(pos)) * (a[ceil(pos)::INT + 1] - a[floor(pos)::INT + 1]) AS c FROM q),
    l AS (SELECT t, (x > (SELECT c FROM cut WHERE i = 1))::INT + (x > (SELECT c FROM cut WHERE i = 2))::INT AS b FROM dn),
    g AS (SELECT a, b, (SELECT count(*) FROM l f JOIN l h ON h.t = f.t + 1 WHERE f.b = a AND h.b = g0.b)::DOUBLE / (SELECT count(*) - 1 FROM l) AS c FROM (SELECT unnest([0, 1, 2]) AS a) CROSS JOIN (SELECT unnest([0, 1, 2]) AS b) g0)""",
)
feature(
    "embedding_dist", "SELECT avg(abs(coalesce(c, 0) / m - exp(-(lo + w * (b + 0.5)) / l) / l)) AS v FROM bins LEFT JOIN h USING (b)",
    _ZERO + """, tau AS (SELECT CASE WHEN tau > n / 10.0 THEN n // 10 ELSE tau END AS tau FROM zero, (SELECT any_value(n) AS n FROM z)),
    st AS (SELECT t, lead(x) OVER (ORDER BY t) - x AS d FROM z), e AS (SELECT sqrt(f.d * f.d + g.d * g.d) AS d FROM tau, st f JOIN st g ON g.t = f.t + tau.tau WHERE g.d IS NOT NULL),
    par AS (SELECT min(d) AS lo, avg(d) AS l, count(*)::DOUBLE AS m, ceil((max(d) - min(d)) / (3.5 * stddev_samp(d) / power(count(*), 1 / 3.0::DOUBLE)))::INT AS nb, max(d) - min(d) AS span FROM e),
    bins AS (SELECT unnest(range(0, nb)) AS b, lo, l, m, span / nb AS w FROM par),
    h AS (SELECT least(floor((d - lo) / (span / nb)), nb - 1)::BIGINT AS b, count(*) AS c FROM e, par GROUP BY 1)""",
)
for _name, _sign in (("pos", ""), ("neg", "-")):
    feature(
        f"outlier_timing_{_name}",
        """SELECT coalesce(median(c), 0.0) AS v FROM al, (SELECT least(coalesce(max(j) FILTER ((alive - 1) * 100.0 / tot > 2), 0), coalesce(min(j) FILTER (alive = 1), max(j))) AS last FROM al, tot) WHERE j <= last""",
        f"""u AS (SELECT t, {_sign}x AS y, n FROM z), tot AS (SELECT count(*) AS tot FROM u WHERE y >= 0),
        th AS (SELECT unnest(range(0, floor(max(y) / 0.01::DOUBLE)::BIGINT + 1)) AS j FROM u),
        al AS (SELECT j, count(*) AS alive, (median(t) + 1) / (any_value(n) / 2.0::DOUBLE) - 1 AS c FROM th JOIN u ON y >= j * 0.01::DOUBLE GROUP BY j)""",
    )


def _fluctuation(stride: int, ranges: bool) -> tuple[str, str]:
    size = "sqrt(avg(power(hi - lo, 2)))" if ranges else "sqrt(sum(ss) / sum(c))"
    left, right = (f"(SELECT sqrt(greatest(sum(power(y, 2)) - 2 * sl * sum(x * y) - 2 * ic * sum(y) + sl * sl * sum(x * x) + 2 * sl * ic * sum(x) + ic * ic * count(*), 0)) FROM lg, (SELECT regr_slope(y, x) AS sl, regr_intercept(y, x) AS ic FROM lg WHERE {w}) WHERE {w} GROUP BY sl, ic)" for w in ("i < s", "i >= s - 1"))
    return (
        "SELECT arg_min(s, e1 + e2)::DOUBLE / (SELECT count(*) FROM lg) AS v FROM two",
        f"""size AS (SELECT any_value(n) AS n FROM z), tau AS (SELECT DISTINCT floor(exp(ln(5) + i * (ln(n // 2) - ln(5)) / 49) + 0.5)::BIGINT AS tau FROM size, (SELECT unnest(range(0, 50)) AS i)),
        path AS (SELECT t // {stride} AS i, sum(x) OVER (ORDER BY t) AS p FROM z WHERE t % {stride} = 0 AND t // {stride} < n // {stride}), len AS (SELECT count(*) AS m FROM path),
        wnd AS (SELECT tau, i // tau AS w, i, p FROM tau, len, path WHERE i < m // tau * tau),
        ln AS (SELECT tau, w, regr_slope(p, i) AS sl, regr_intercept(p, i) AS ic FROM wnd GROUP BY 1, 2),
        rs AS (SELECT tau, w, max(p - sl * i - ic) AS hi, min(p - sl * i - ic) AS lo, sum(power(p - sl * i - ic, 2)) AS ss, count(*) AS c FROM wnd JOIN ln USING (tau, w) GROUP BY 1, 2),
        lg AS MATERIALIZED (SELECT row_number() OVER (ORDER BY tau) - 1 AS i, ln(tau) AS x, ln(f) AS y FROM (SELECT tau, {size} AS f FROM rs GROUP BY tau)),
        two AS (SELECT s, {left} AS e1, {right} AS e2 FROM (SELECT unnest(range(6, (SELECT count(*) FROM lg) - 5)) AS s))""",
    )


feature("rs_range", *_fluctuation(1, True))
feature("dfa", *_fluctuation(2, False))


def _without_spline() -> str:
    """CTEs up to ``g5`` (t, r): what a cubic spline with a knot in the middle leaves of x,
    its five columns made orthogonal one after the other."""
    out = "g0 AS (SELECT t, 1.0::DOUBLE AS e0, u AS e1, u * u AS e2, u * u * u AS e3, power(greatest(u - (n // 2 - 1) / (n - 1.0::DOUBLE), 0), 3) AS e4, x AS r FROM (SELECT t, n, x, t / (n - 1.0::DOUBLE) AS u FROM z))"
    for k in range(5):
        rest = [*(f"e{j}" for j in range(k + 1, 5)), "r"]
        out += f", g{k + 1} AS (SELECT t, " + ", ".join(f"{c} - e{k} * sum(e{k} * {c}) OVER () / sum(e{k} * e{k}) OVER () AS {c}" for c in rest) + f" FROM g{k})"
    return out


feature(
    "periodicity", "SELECT coalesce(min(k) FILTER (a - low >= 0.01 AND a >= 0), 0)::DOUBLE AS v FROM (SELECT *, last_value(CASE WHEN a < p AND a < q THEN a END IGNORE NULLS) OVER (ORDER BY k) AS low FROM nb) WHERE a > p AND a > q",
    _without_spline() + """, lim AS (SELECT count(*) AS n, ceil(count(*) / 3.0::DOUBLE)::BIGINT AS lags FROM g5), res AS MATERIALIZED (SELECT t, r FROM g5),
    cv AS (SELECT f.tau - 1 AS k, sum(a.r * b.r) / (any_value(n) - f.tau) AS a FROM (SELECT unnest(range(1, lags + 1)) AS tau, n FROM lim) f JOIN res a ON true JOIN res b ON b.t = a.t + f.tau GROUP BY f.tau),
    nb AS (SELECT k, a, lag(a) OVER (ORDER BY k) AS p, lead(a) OVER (ORDER BY k) AS q FROM cv)""",
)
feature("mean", "SELECT avg(y) AS v FROM eh")
feature("SD", "SELECT stddev_samp(y) AS v FROM eh")
_LONG = " UNION ALL ".join(
    f"SELECT '{k}' AS k, {n}::INT AS idx, '{name}' AS feature, (WITH eh AS (SELECT t, y FROM et WHERE k = '{k}'), {_Z}{', ' + FEATURES[name][1] if FEATURES[name][1] else ''} {FEATURES[name][0]}) AS v"
    for k in TYPES
    for n, name in enumerate(SHORT_NAMES)
)
add("catch24_long", "et", f"SELECT k, idx, feature, {r('v', 6)} AS value FROM ({_LONG})")
add("catch22_panel", "et", "SELECT k, " + ", ".join(f"max(CASE WHEN idx = {n} THEN {r('v', 6)} END) AS f{n:02d}" for n in range(22)) + f" FROM ({_LONG}) GROUP BY k")
add("acf_first_zero", "eh", f"SELECT k::INT AS lag, {r('a')} AS acf, (SELECT min(k) FROM acf WHERE k > 0 AND a <= 0)::INT AS first_zero FROM acf", _Z + ", " + _ACF)

# --- ARIMA -------------------------------------------------------------------------------

add("diff_seasonal", "om", f"SELECT t, {r('y - lag(y) OVER w - lag(y, 12) OVER w + lag(y, 13) OVER w')} AS diff FROM om WINDOW w AS (ORDER BY t)")
add(
    "arima_010_drift", "om", f"SELECT h::INT AS h, {r('last + h * m', 6)} AS mean, {r('s * h', 6)} AS variance FROM p, (SELECT unnest(range(1, 13)) AS h)",
    "w AS (SELECT t, y, y - lag(y) OVER (ORDER BY t) AS w FROM om), p AS (SELECT arg_max(y, t) AS last, avg(w) AS m, var_pop(w) AS s FROM w)",
)
_AR1 = """w AS (SELECT t, y, y - avg(y) OVER () AS w FROM om), l AS (SELECT t, y, w, lag(w) OVER (ORDER BY t) AS p FROM w),
    a AS (SELECT sum(w * p) / sum(p * p) AS phi, avg(y) AS mu, arg_max(w, t) AS last FROM l),
    v AS (SELECT phi, (SELECT avg(y) FROM w) AS mu, last, (SELECT sum(power(w - phi * p, 2)) / count(p) FROM l) AS s2, (SELECT count(p)::DOUBLE FROM l) AS n FROM a),
    m AS (SELECT *, -n / 2 * (ln(2 * pi() * s2) + 1) AS ll FROM v)"""
add(
    "arima_100_css", "om",
    f"SELECT {r('phi', 5)} AS phi, {r('mu', 5)} AS intercept, {r('s2', 5)} AS sigma2, {r('ll', 5)} AS log_likelihood, {r('6 - 2 * ll', 5)} AS aic, {r('6 - 2 * ll + 24 / (n - 4)', 5)} AS aicc, {r('ln(n) * 3 - 2 * ll', 5)} AS bic, n::INT AS n_obs FROM m",
    _AR1,
)
add("arima_forecast", "om", f"SELECT h::INT AS h, {r('mu + power(phi, h) * last', 5)} AS mean FROM m, (SELECT unnest(range(1, 13)) AS h)", _AR1)
_VAR = "s2 * (1 - power(phi, 2 * h)) / (1 - phi * phi)"
add(
    "arima_intervals", "om",
    f"SELECT h::INT AS h, {r(_VAR, 5)} AS variance, {r(f'mu + power(phi, h) * last - 1.6448536269514722 * sqrt({_VAR})', 5)} AS lower, {r(f'mu + power(phi, h) * last + 1.6448536269514722 * sqrt({_VAR})', 5)} AS upper FROM m, (SELECT unnest(range(1, 13)) AS h)",
    _AR1,
)

_AR1_EACH = """w AS (SELECT k, t, y - avg(y) OVER (PARTITION BY k) AS w, avg(y) OVER (PARTITION BY k) AS mu FROM lm), l AS (SELECT *, lag(w) OVER (PARTITION BY k ORDER BY t) AS p FROM w),
    m AS (SELECT k, sum(w * p) / sum(p * p) AS phi, any_value(mu) AS mu, arg_max(w, t) AS last FROM l GROUP BY k)"""
add("sql_forecast_table", "lm", f"SELECT k, h::INT AS h, {r('mu + power(phi, h) * last', 3)} AS mean FROM m, (SELECT unnest(range(1, 7)) AS h)", _AR1_EACH)
add(
    "arima_ljung_box", "om",
    f"""SELECT {r('statistic', 4)} AS statistic, 9 AS df, {r('1 - 0.5 * (1 + sign(z) * (1 - u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429)))) * exp(-x * x)))', 4)} AS p_value, 10 AS lags
    FROM (SELECT *, abs(z) / sqrt(2.0) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS u FROM (SELECT statistic, (cbrt(statistic / 9) - (1 - 2 / 81.0)) / sqrt(2 / 81.0) AS z FROM q))""",
    _AR1 + """, r0 AS (SELECT l.t, l.w - m.phi * l.p AS r FROM l, m WHERE l.p IS NOT NULL), e AS (SELECT t, r - avg(r) OVER () AS e FROM r0), g AS (SELECT count(*)::DOUBLE AS n, sum(e * e) AS s FROM e),
    c AS (SELECT k, sum(x.e * z.e) AS c FROM (SELECT unnest(range(1, 11)) AS k) JOIN e x ON true JOIN e z ON z.t = x.t - k GROUP BY k),
    q AS (SELECT n * (n + 2) * (SELECT sum(power(c / s, 2) / (n - k)) FROM c) AS statistic FROM g)""",
)



def _grid(step: str, levels: int, source: str) -> str:
    """CTE ``best`` (k, a, b, v): the least v of ``step``, which makes CTEs up to its name
    (k, a, b, v) from a grid's, by finer and finer grids of two parameters within 1."""
    width = 0.099
    out = f"g0 AS (SELECT k, i * {width} AS a, j * {width} AS b FROM (SELECT DISTINCT k FROM {source}), (SELECT unnest(range(-10, 11)) AS i), (SELECT unnest(range(-10, 11)) AS j))"
    for n in range(levels):
        out += ", " + step.format(out=f"o{n}", grid=f"g{n}") + f", b{n} AS MATERIALIZED (SELECT k, arg_min({{'a': a, 'b': b, 'v': v}}, v) AS best FROM o{n} GROUP BY k)"
        width /= 5
        near = "least(greatest(best.{0} + {1} * {2:.4e}, -0.9999), 0.9999) AS {0}"
        out += f", g{n + 1} AS MATERIALIZED (SELECT DISTINCT k, {near.format('a', 'i', width)}, {near.format('b', 'j', width)} FROM b{n}, (SELECT unnest(range(-10, 11)) AS i), (SELECT unnest(range(-10, 11)) AS j))"
    return out + f", best AS (SELECT k, best.a AS a, best.b AS b, best.v AS v FROM b{levels - 1})"


def _fit(columns: str, level: str, sigma2: str, n: str, k: int) -> str:
    ll = f"(-0.5 * {n} * (ln(2 * pi() * {sigma2}) + 1))"
    return f"SELECT k, {columns}, {r(level, 3)} AS intercept, {r(sigma2, 3)} AS sigma2, {r(f'2 * {k} - 2 * {ll} + 2.0 * {k} * ({k} + 1) / ({n} - {k} - 1)', 3)} AS aicc, {n}::INT AS n_obs FROM best JOIN size USING (k)"


_TWO = f"{r('a', 3)} AS {{0}}, {r('b', 3)} AS {{1}}"
_RECURSION = """{{out}}r AS (SELECT k, a, b, {start} FROM {{grid}} UNION ALL SELECT r.k, a, b, {step} FROM {{out}}r r JOIN cw ON cw.k = r.k AND cw.t = r.t + 1),
  {{out}} AS (SELECT x.k, a, b, {value} AS v FROM {{out}}r x JOIN size USING (k) WHERE t = n - 1)"""
_SIZE = "size AS MATERIALIZED (SELECT k, count(*) AS n, any_value(mu) AS mu FROM cw GROUP BY k)"
add(
    "arima_111_css", "lm", _fit(_TWO.format("ar1", "ma1"), "mu", "(v / (n - 1))", "(n - 1)", 4),
    """dw AS (SELECT k, t - 1 AS t, y - lag(y) OVER (PARTITION BY k ORDER BY t) AS d FROM lm), c0 AS (SELECT k, t, d - avg(d) OVER (PARTITION BY k) AS w, avg(d) OVER (PARTITION BY k) AS mu FROM dw WHERE d IS NOT NULL),
    cw AS MATERIALIZED (SELECT *, lag(w) OVER (PARTITION BY k ORDER BY t) AS w1 FROM c0), """ + _SIZE + ", "
    + _grid(_RECURSION.format(start="0::BIGINT AS t, 0.0::DOUBLE AS e, 0.0::DOUBLE AS s", step="r.t + 1, w - a * w1 - b * e, s + power(w - a * w1 - b * e, 2)", value="s"), 9, "cw"),
    True,
)
add(
    "sarima_airline", "lm", _fit(_TWO.format("ma1", "ma2"), "0.0::DOUBLE", "(v / (n - 13))", "(n - 13)", 3),
    """cw AS MATERIALIZED (SELECT k, t - 13 AS t, w, 0.0 AS mu FROM (SELECT k, t, y - lag(y) OVER o - lag(y, 12) OVER o + lag(y, 13) OVER o AS w FROM lm WINDOW o AS (PARTITION BY k ORDER BY t)) WHERE w IS NOT NULL), """ + _SIZE + ", "
    + _grid(
        _RECURSION.format(
            start="12::BIGINT AS t, list_resize([]::DOUBLE[], 13, 0.0) AS z, 0.0::DOUBLE AS s",
            step="r.t + 1, list_prepend(w - a * z[1] - b * z[12] - a * b * z[13], z[1:12]), s + power(w - a * z[1] - b * z[12] - a * b * z[13], 2)",
            value="s",
        ), 9, "cw"),
    True,
)
_CENTRED = """c0 AS (SELECT k, t, y - avg(y) OVER (PARTITION BY k) AS w, avg(y) OVER (PARTITION BY k) AS mu FROM lm),
    cw AS MATERIALIZED (SELECT *, lag(w) OVER (PARTITION BY k ORDER BY t) AS w1, lag(w, 2) OVER (PARTITION BY k ORDER BY t) AS w2 FROM c0), """ + _SIZE + ", "
_AR2 = "sum(CASE t WHEN 0 THEN w * w * f1 WHEN 1 THEN power(w - a / (1 - b) * w1, 2) * (1 - b * b) ELSE power(w - a * w1 - b * w2, 2) END)"
add(
    "arima_cssml", "lm", _fit(_TWO.format("ar1", "ar2"), "mu", "(SELECT s FROM last WHERE last.k = best.k) / n", "(n - 2)", 4),
    _CENTRED + _grid(
        "{out}s AS (SELECT *, (1 + b) * (power(1 - b, 2) - a * a) / (1 - b) AS f1 FROM {grid} WHERE abs(a) < 1 - b), {out}t AS (SELECT k, a, b, f1, count(*) AS n, " + _AR2 + " AS s FROM {out}s JOIN cw USING (k) GROUP BY ALL), "
        "{out} AS (SELECT *, n * ln(s / n) - ln(f1) - ln(1 - b * b) AS v FROM {out}t)", 9, "cw") + ", last AS (SELECT o8.k, s FROM o8 JOIN best USING (k, a, b))",
)

_EX = """ex AS MATERIALIZED (SELECT '' AS k, row_number() OVER (ORDER BY m) - 1 AS t, y, x1, row_number() OVER (ORDER BY m) - 1.0::DOUBLE AS x2 FROM
      (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) / 1e6 AS y, count(*)::DOUBLE AS x1 FROM orders GROUP BY 1))"""


def _arimax(rows: str) -> str:
    """CTE ``fx`` (phi, b0, b1, b2, s2, n): a regression with AR(1) errors on ``rows``; for a
    given phi it is one of differences by phi."""
    y, u, v = "y - lam * py", "x1 - lam * p1", "x2 - lam * p2"
    uu, vv, uv, uy, vy = (f"covar_pop({f}, {g})" for f, g in ((u, u), (v, v), (u, v), (u, y), (v, y)))
    det = f"({uu} * {vv} - {uv} * {uv})"
    b1, b2 = f"({uy} * {vv} - {vy} * {uv}) / {det}", f"({vy} * {uu} - {uy} * {uv}) / {det}"
    loss = f"covar_pop({y}, {y}) - {b1} * {uy} - {b2} * {vy}"
    lags = ", ".join(f"lag({c}) OVER (ORDER BY t) AS {n}" for c, n in (("y", "py"), ("x1", "p1"), ("x2", "p2")))
    return f"""{_EX}, axx AS (SELECT *, {lags} FROM ex WHERE {rows}), ax AS MATERIALIZED (SELECT * FROM axx WHERE py IS NOT NULL), {_least(-0.99, 0.99, 'ax', loss)},
    fx AS (SELECT lam AS phi, (avg({y}) - ({b1}) * avg({u}) - ({b2}) * avg({v})) / (1 - lam) AS b0, {b1} AS b1, {b2} AS b2, {loss} AS s2, count(*) AS n FROM ax JOIN best USING (k) GROUP BY lam)"""


add("arimax", "om", f"SELECT {r('b1', 3)} AS beta1, {r('b2', 3)} AS beta2, {r('b0', 3)} AS intercept, {r('phi', 3)} AS phi, {r('s2', 3)} AS sigma2, n::INT AS n_obs FROM fx", _arimax("true"))
add(
    "arimax_forecast", "om",
    f"SELECT h, {r('m', 3)} AS mean, {r('v', 3)} AS variance, {r('m - 1.959963984540054 * sqrt(v)', 3)} AS lower, {r('m + 1.959963984540054 * sqrt(v)', 3)} AS upper FROM fc",
    _arimax("t < 68") + """, lx AS (SELECT y - b0 - b1 * x1 - b2 * x2 AS rest FROM ex, fx WHERE t = 67),
    fc AS (SELECT (t - 67)::INT AS h, b0 + b1 * x1 + b2 * x2 + power(phi, t - 67) * rest AS m, s2 * (1 - power(phi, 2 * (t - 67))) / (1 - phi * phi) AS v FROM ex, fx, lx WHERE t >= 68)""",
)

# --- SQL functions -----------------------------------------------------------------------


def _of_type(k: str, ctes: str, value: str, recursive: bool = False) -> str:
    return f"(WITH {'RECURSIVE ' if recursive else ''}eh AS (SELECT t, y FROM et WHERE k = '{k}'), om AS (SELECT t, y FROM eh), {ctes} {value})"


add(
    "sql_functions", "et",
    f"SELECT k, {', '.join(f'{r(c, 6)} AS {c}' for c in ('trev', 'first_smooth', 'third', 'kpss'))} FROM (" + " UNION ALL ".join(
        f"SELECT '{k}' AS k, {_of_type(k, _Z + ', ' + FEATURES['trev'][1], FEATURES['trev'][0])} AS trev, {_of_type(k, _loess('eh', 'SELECT t AS x FROM eh', 0.3, 1), 'SELECT smoothed FROM fit WHERE x = 0')} AS first_smooth, "
        f"{_of_type(k, _holt_winters(0.4, 0.1, 0.0, 0, False), 'SELECT fitted FROM hw WHERE t = 2', True)} AS third, {_of_type(k, _kpss('eh', False, 'kp'), 'SELECT statistic FROM kp')} AS kpss"
        for k in TYPES
    ) + ")",
)
