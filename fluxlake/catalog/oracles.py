"""The same results in DuckDB SQL, written independently of the Spark plans.

Common tables are named once; ``_sql`` puts the ones a query needs in front of it. They follow the plain
definition of each operator (whole-table windows, unbounded look-back, a recursive average) rather than
the way the Spark side distributes it.
"""

from __future__ import annotations

import re

from fluxlake import schemas as s
from fluxlake.catalog.derived import ARCHIVE_EVENTS, FOLDER_EVENTS

D = s.DRIVERS
GRID = s.GRID_COLUMNS
CTES: dict[str, str] = {}


def q(name: str) -> str:
    """``By`` is a keyword."""
    return '"By"' if name == "By" else name


def _r(expression: str, name: str | None = None) -> str:
    return f"round(CAST({q(expression)} AS DOUBLE), 6) + 0 AS {q(name or expression)}"


def _rs(names) -> str:
    return ", ".join(_r(n) for n in names)


CTES["cfg"] = """
SELECT cad, cad * 1000000 AS w, 1200000000 AS fw, CAST(12 AS BIGINT) AS len, 1.5e6 * (CAST(cad AS DOUBLE) / 60) / 5 AS dx
FROM (SELECT CAST(7200 AS BIGINT) AS cad)
"""
CTES["rec"] = """
SELECT epoch_us(ts) AS us, user_id % 6 = 0 AS is_target,
       CASE WHEN user_id % 6 = 0 AND value > 0 THEN value END AS goes_electron_flux,
       CASE WHEN user_id % 6 = 1 THEN value - 50 END AS Bx,
       CASE WHEN user_id % 6 = 2 THEN value - 50 END AS "By",
       CASE WHEN user_id % 6 = 3 THEN value - 50 END AS Bz,
       CASE WHEN user_id % 6 = 4 THEN value + 300 END AS solar_wind_speed,
       CASE WHEN user_id % 6 = 5 AND value > 0 THEN value / 10 END AS plasma_density
FROM events WHERE NOT (user_id % 6 = 0 AND event_type = 'signup')
"""


CTES["usr"] = """
SELECT user_id, bin, v AS value, ts, row_number() OVER (PARTITION BY user_id ORDER BY bin) - 1 AS i
FROM (SELECT s.user_id, s.bin, m.v, make_timestamp(s.bin * 7200000000) AS ts
      FROM (SELECT user_id, unnest(generate_series(min(epoch_us(ts) // 7200000000), max(epoch_us(ts) // 7200000000))) AS bin FROM events GROUP BY user_id) s
      LEFT JOIN (SELECT user_id, epoch_us(ts) // 7200000000 AS bin, avg(value) AS v FROM events GROUP BY 1, 2) m
             ON m.user_id = s.user_id AND m.bin = s.bin)
"""
CTES["usrgap"] = """
SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS pi,
       min(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni
FROM usr
"""


def _cols(names) -> str:
    return ", ".join(q(n) for n in names)


def _grid(width: str) -> str:
    means = ", ".join(f"avg({q(c)}) AS {q(c)}" for c in GRID)
    return f"""
SELECT make_timestamp(spine.n * {width}) AS ts, {_cols(GRID)}
FROM (SELECT unnest(generate_series(
        (SELECT greatest(min(us // {width}) FILTER (WHERE is_target), min(us // {width}) FILTER (WHERE NOT is_target)) FROM rec, cfg),
        (SELECT least(max(us // {width}) FILTER (WHERE is_target), max(us // {width}) FILTER (WHERE NOT is_target)) FROM rec, cfg))) AS n) spine
CROSS JOIN cfg
LEFT JOIN (SELECT us // {width} AS n, {means} FROM rec, cfg GROUP BY 1) m ON m.n = spine.n
"""


CTES["grid"] = _grid("w")
CTES["fine0"] = _grid("fw")
CTES["fine"] = "SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i FROM fine0"
CTES["truth"] = """
SELECT ts, CASE WHEN value > 0 THEN value END AS electron_flux FROM events WHERE user_id % 6 = 0 AND event_type = 'signup'
"""
CTES["tgt"] = "SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i FROM grid WHERE goes_electron_flux IS NOT NULL"


def _spikes(source: str, column: str, key: str = "", order: str = "i") -> tuple[str, str]:
    part = f"PARTITION BY {key} " if key else ""
    frame = f"OVER ({part}ORDER BY {order} ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)"
    first = f"""
SELECT *, abs({column} - med) AS dev FROM (
  SELECT *, CASE WHEN count({column}) {frame} >= 6 THEN quantile_cont({column}, 0.5) {frame} END AS med FROM {source})
"""
    second = f"""
SELECT *, coalesce(dev > CAST(5 AS DOUBLE) * (mad * CAST(1.4826 AS DOUBLE)), false) AS spike FROM (
  SELECT *, CASE WHEN count(dev) {frame} >= 6 THEN quantile_cont(dev, 0.5) {frame} END AS mad FROM {{first}})
"""
    return first, second


CTES["dev"], _second = _spikes("tgt", "goes_electron_flux")
CTES["spk"] = _second.format(first="dev")
CTES["nul"] = "SELECT * REPLACE (CASE WHEN NOT spike THEN goes_electron_flux END AS goes_electron_flux) FROM spk"


def _filled(source: str) -> str:
    """Gap filling by the unbounded rule: run length from the nearest known rows on either side."""
    inner, outer = [], []
    up = "OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    down = "OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    for c in GRID:
        known = f"CASE WHEN {q(c)} IS NOT NULL THEN i END"
        inner.append(
            f"max({known}) {up} AS p_{c}, min({known}) {down} AS n_{c}, "
            f"last_value({q(c)} IGNORE NULLS) {up} AS pv_{c}, first_value({q(c)} IGNORE NULLS) {down} AS nv_{c}"
        )
        outer.append(
            f"CASE WHEN {q(c)} IS NOT NULL THEN {q(c)} "
            f"WHEN p_{c} IS NOT NULL AND n_{c} IS NOT NULL AND n_{c} - p_{c} - 1 <= 6 "
            f"THEN pv_{c} + (nv_{c} - pv_{c}) * (i - p_{c}) / (n_{c} - p_{c}) "
            f"WHEN p_{c} IS NULL AND n_{c} <= 6 THEN nv_{c} "
            f"WHEN n_{c} IS NULL AND total - 1 - p_{c} <= 6 THEN pv_{c} END AS {q(c)}"
        )
    return f"SELECT ts, {', '.join(outer)} FROM (SELECT *, count(*) OVER () AS total, {', '.join(inner)} FROM {source})"


CTES["ser"] = f"""
SELECT *, log10(goes_electron_flux + CAST(1e-10 AS DOUBLE)) AS log_electron_flux FROM ({_filled('nul')})
WHERE {' AND '.join(f'{q(c)} IS NOT NULL' for c in GRID)}
"""
CTES["scl"] = " UNION ALL ".join(
    f"SELECT '{c}' AS name, m AS center, CASE WHEN h - l < 2.220446049250313e-15 THEN 1 ELSE h - l END AS scale FROM "
    f"(SELECT quantile_cont({q(c)}, 0.5) AS m, quantile_cont({q(c)}, 0.25) AS l, quantile_cont({q(c)}, 0.75) AS h FROM ser)"
    for c in D
)
CTES["pre"] = (
    "SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i, "
    + ", ".join(
        f"({q(c)} - (SELECT center FROM scl WHERE name = '{c}')) / (SELECT scale FROM scl WHERE name = '{c}') AS {c}_scaled" for c in D
    )
    + " FROM ser"
)
_STEPS = "CAST(greatest(coalesce(round_even(dx / (solar_wind_speed * 60) / (CAST(cad AS DOUBLE) / 60), 0), 0), 0) AS BIGINT)"
CTES["stp"] = f"SELECT ts, i, solar_wind_speed, {_STEPS} AS steps FROM pre, cfg"
CTES["lag"] = (
    "SELECT pre.ts, pre.i, pre.goes_electron_flux, pre.log_electron_flux, "
    + ", ".join(f"src.{q(c)} AS {c}_lag" for c in s.DRIVERS + s.SCALED_DRIVERS)
    + " FROM pre JOIN stp ON stp.i = pre.i LEFT JOIN pre src ON src.i = pre.i - stp.steps"
)


def _rolling(column: str, prefix: str, part: str = "", order: str = "i") -> str:
    items = []
    for k in s.ROLLING_WINDOWS:
        frame = f"OVER ({part} ORDER BY {order} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        for stat, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")):
            items.append(f"CASE WHEN count({column}) {frame} = {k} THEN {fn}({column}) {frame} END AS {prefix}_roll_{stat}_{k}")
    return ", ".join(items)


_LAGS = ", ".join(f"lag(log_electron_flux, {k}) OVER (ORDER BY i) AS log_flux_lag_{k}" for k in s.LAG_STEPS)
_DELTAS = (
    "Bz_lag - lag(Bz_lag) OVER (ORDER BY i) AS delta_Bz, "
    "solar_wind_speed_lag - lag(solar_wind_speed_lag) OVER (ORDER BY i) AS delta_speed, "
    "log_electron_flux - lag(log_electron_flux) OVER (ORDER BY i) AS delta_flux"
)


def _ema(source: str, column: str, prefix: str, key: str = "") -> str:
    k, on = (f"{key}, ", f" AND p.{key} = e.{key}") if key else ("", "")
    start = ", ".join(f"CAST({column} AS DOUBLE) AS {prefix}_ema_{n}" for n in s.ROLLING_WINDOWS)
    step = ", ".join(
        f"(CAST(2 AS DOUBLE) / {n + 1}) * p.{column} + (1 - CAST(2 AS DOUBLE) / {n + 1}) * e.{prefix}_ema_{n}" for n in s.ROLLING_WINDOWS
    )
    return f"""
SELECT {k}i, ts, {start} FROM {source} WHERE i = 0
UNION ALL SELECT {'p.' + k if key else ''}p.i, p.ts, {step} FROM rec_ e JOIN {source} p ON p.i = e.i + 1{on}
"""


CTES["ema"] = _ema("pre", "log_electron_flux", "log_flux").replace("rec_", "ema")
CTES["feat0"] = f"SELECT lag.*, {_LAGS}, {_rolling('log_electron_flux', 'log_flux')}, {_DELTAS} FROM lag"
_ALL = ", ".join(s.FEATURE_COLUMNS)
CTES["feat"] = f"""
SELECT f.ts, row_number() OVER (ORDER BY f.ts) - 1 AS i, count(*) OVER () AS n, {_ALL.replace('log_flux_ema', 'ema.log_flux_ema')}
FROM feat0 f JOIN ema ON ema.i = f.i WHERE {' AND '.join(f'{c} IS NOT NULL' for c in s.FEATURE_COLUMNS)}
"""
CTES["hor"] = "SELECT * FROM (VALUES ('A', 9, '30-45 min', 0.2), ('B', 72, '6 hours', 0.5), ('C', 144, '12 hours', 0.8)) h(horizon, steps, label, weight)"
CTES["dst0"] = """
SELECT f.*, hor.horizon, CAST(hor.steps AS BIGINT) AS steps, hor.label, CAST(hor.weight AS DOUBLE) AS weight, g.log_electron_flux AS y, f.n - hor.steps AS m
FROM feat f CROSS JOIN hor JOIN feat g ON g.i = f.i + hor.steps
"""
CTES["dst"] = """
SELECT *, i - CASE split WHEN 'train' THEN 0 WHEN 'val' THEN a ELSE z END AS si,
       log_flux_lag_1 AS tree_pred, log_flux_roll_mean_6 AS sequence_pred, log_electron_flux AS persistence_pred
FROM (SELECT *, CASE WHEN i < a THEN 'train' WHEN i < z THEN 'val' ELSE 'test' END AS split
      FROM (SELECT *, CAST(floor(m * CAST(0.8 AS DOUBLE)) AS BIGINT) AS a, CAST(floor(m * CAST(0.9 AS DOUBLE)) AS BIGINT) AS z FROM dst0))
"""


def _metrics(y: str, p: str, prefix: str = "", rounding: int = 6) -> str:
    e = f"({y} - {p})"
    return (
        f"round(avg(abs{e}), {rounding}) + 0 AS {prefix}mae, round(sqrt(avg({e} * {e})), {rounding}) + 0 AS {prefix}rmse, "
        f"round(CASE WHEN min({y}) < max({y}) THEN 1 - sum({e} * {e}) / (var_pop({y}) * count(*)) "
        f"WHEN sum({e} * {e}) = 0 THEN 1 ELSE 0 END, {rounding}) + 0 AS {prefix}r2"
    )


CTES["alp0"] = " UNION ALL ".join(
    f"SELECT horizon, CAST({a} AS DOUBLE) AS alpha, sqrt(avg(power(y - (CAST({a} AS DOUBLE) * sequence_pred + (1 - CAST({a} AS DOUBLE)) * tree_pred), 2))) AS rmse "
    "FROM dst WHERE split = 'val' GROUP BY horizon"
    for a in s.ALPHAS
)
CTES["alp"] = "SELECT horizon, alpha, rmse FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY rmse, alpha) AS k FROM alp0) WHERE k = 1"
CTES["ens"] = "SELECT dst.*, alpha, rmse, alpha * sequence_pred + (1 - alpha) * tree_pred AS ensemble FROM dst JOIN alp USING (horizon) WHERE split = 'test'"
CTES["val"] = """
SELECT horizon, ts + to_microseconds(steps * w) AS valid_ts, persistence_pred, weight * sequence_pred + (1 - weight) * tree_pred AS model_pred FROM dst, cfg
"""

# Boosted stumps on the place in the day: round by round the split of the training rows that explains most, on residuals from the second on.
CTES["sd0"] = "SELECT horizon, split, si, y, (epoch_us(ts) // w) % 12 AS slot, CAST(0 AS DOUBLE) AS f FROM dst, cfg"
for _k in range(1, 4):
    _target, _weight = ("y", 1) if _k == 1 else ("2 * (y - f)", 0.3)
    CTES[f"sg{_k}"] = f"""
    SELECT horizon, slot, lead(slot) OVER byslot AS after, sum(n) OVER byslot AS nl, sum(t) OVER byslot AS tl, sum(n) OVER (PARTITION BY horizon) AS n, sum(t) OVER (PARTITION BY horizon) AS t
    FROM (SELECT horizon, slot, count(*) AS n, sum({_target}) AS t FROM sd{_k - 1} WHERE split = 'train' GROUP BY 1, 2) WINDOW byslot AS (PARTITION BY horizon ORDER BY slot)
    """
    CTES[f"st{_k}"] = f"""
    SELECT horizon, (slot + after) / 2 AS cut, tl / nl AS low, (t - tl) / (n - nl) AS high FROM sg{_k} WHERE after IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY tl * tl / nl + (t - tl) * (t - tl) / (n - nl) DESC, slot) = 1
    """
    CTES[f"sd{_k}"] = f"""
    SELECT d.* EXCLUDE (f), f + CAST({_weight} AS DOUBLE) * CASE WHEN slot <= cut THEN low ELSE high END AS f FROM sd{_k - 1} d JOIN st{_k} USING (horizon)
    """
# Ridge regression on two rows of one input, in closed form.
CTES["pz"] = "SELECT horizon, avg(log_electron_flux) AS mu, stddev_pop(log_electron_flux) AS sigma FROM dst WHERE split = 'train' GROUP BY horizon"
CTES["pw"] = """
SELECT horizon, split, ts, y, z1, z2 FROM (SELECT horizon, split, ts, y, (log_electron_flux - mu) / sigma AS z1,
    lag((log_electron_flux - mu) / sigma) OVER (PARTITION BY horizon, split ORDER BY si) AS z2 FROM dst JOIN pz USING (horizon)) WHERE z2 IS NOT NULL
"""
CTES["pc"] = """
SELECT *, (s22 * b1 - s12 * b2) / (s11 * s22 - s12 * s12) AS w1, (s11 * b2 - s12 * b1) / (s11 * s22 - s12 * s12) AS w2
FROM (SELECT horizon, avg(z1) AS m1, avg(z2) AS m2, avg(y) AS my, var_pop(z1) + CAST(0.01 AS DOUBLE) AS s11, var_pop(z2) + CAST(0.01 AS DOUBLE) AS s22,
             covar_pop(z1, z2) AS s12, covar_pop(z1, y) AS b1, covar_pop(z2, y) AS b2 FROM pw WHERE split = 'train' GROUP BY horizon)
"""
# Values by input, lags and rows with a whole window, of horizon A's training part.
CTES["gmv"] = """
SELECT si, name, value FROM (SELECT si, log_electron_flux, delta_flux FROM dst WHERE horizon = 'A' AND split = 'train') UNPIVOT (value FOR name IN (log_electron_flux, delta_flux))
"""
CTES["gml"] = "SELECT unnest(generate_series(0, (SELECT len - 1 FROM cfg))) AS lag"
CTES["gmt"] = "SELECT si AS t FROM dst, cfg WHERE horizon = 'A' AND split = 'train' AND si >= len - 1"
# Horizons whose validation part has a row.
CTES["hv"] = "SELECT DISTINCT horizon, steps FROM dst WHERE split = 'val'"
CTES["fhv"] = """
SELECT f.ts, f.i, f.n, h.horizon, f.ts + to_microseconds(h.steps * w) AS valid_ts, f.log_electron_flux AS persistence_pred,
       CAST(0.3 AS DOUBLE) * (my + w1 * ((f.log_electron_flux - mu) / sigma - m1) + w2 * ((f.before - mu) / sigma - m2))
       + CAST(0.7 AS DOUBLE) * (CASE WHEN slot <= st1.cut THEN st1.low ELSE st1.high END + CAST(0.3 AS DOUBLE) * (CASE WHEN slot <= st2.cut THEN st2.low ELSE st2.high END
       + CASE WHEN slot <= st3.cut THEN st3.low ELSE st3.high END)) AS model_pred
FROM (SELECT ts, i, n, log_electron_flux, lag(log_electron_flux) OVER (ORDER BY i) AS before, (epoch_us(ts) // w) % 12 AS slot, w FROM feat, cfg) f CROSS JOIN hv h
JOIN pz USING (horizon) JOIN pc USING (horizon) JOIN st1 USING (horizon) JOIN st2 USING (horizon) JOIN st3 USING (horizon) WHERE f.i >= 1
"""


# What a stream has seen: in its last third a record of the first one may come at most six hours after the latest of that. A bin closes six hours after its end.
CTES["sin"] = """
SELECT ts, round(value * 100) AS value FROM events UNION ALL SELECT ts, round(value * 100) + 1000 FROM events, (SELECT max(event_id) // 3 AS third FROM events)
WHERE event_id <= third AND event_id % 50 = 1 AND epoch_ms(ts) * 1000 + 0 > (SELECT epoch_ms(max(ts)) - 21600000 FROM events WHERE event_id <= (SELECT max(event_id) // 3 FROM events)) * 1000
"""
CTES["sbin"] = """
SELECT epoch_us(ts) // w AS n, avg(value) AS v FROM sin, cfg GROUP BY 1
HAVING (epoch_us(min(ts)) // any_value(w) + 1) * any_value(w) <= (SELECT (epoch_ms(max(ts)) - 21600000) * 1000 FROM events)
"""


def _nearest(left: str, ts: str) -> str:
    """A backward and a forward as-of join; the closer one wins, the earlier on a tie."""
    return f"""
SELECT *, CASE WHEN fwd_us IS NULL OR (bwd_us IS NOT NULL AND us - bwd_us <= fwd_us - us) THEN bwd_us ELSE fwd_us END AS best_us
FROM (SELECT l.*, epoch_us(l.{ts}) AS us, epoch_us(b.ts) AS bwd_us, epoch_us(f.ts) AS fwd_us
      FROM {left} l ASOF LEFT JOIN truth b ON l.{ts} >= b.ts ASOF LEFT JOIN truth f ON l.{ts} <= f.ts)
"""


CTES["near"] = _nearest("(SELECT ts, log_electron_flux FROM feat)", "ts")
CTES["vnear"] = _nearest("(SELECT * FROM val)", "valid_ts")
CTES["vmat"] = """
SELECT horizon, model_pred, persistence_pred, log10(truth.electron_flux + CAST(1e-10 AS DOUBLE)) AS truth
FROM vnear CROSS JOIN cfg JOIN truth ON epoch_us(truth.ts) = best_us
WHERE abs(best_us - us) <= w // 2 AND truth.electron_flux IS NOT NULL
"""
CTES["ord"] = """
SELECT o_orderpriority, date_trunc('day', o_orderdate) AS ts, log10(sum(o_totalprice)) AS total FROM orders GROUP BY 1, 2
"""
CTES["ordi"] = "SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts) - 1 AS i FROM ord"
CTES["odev"], _osecond = _spikes("ordi", "total", "o_orderpriority")
CTES["ospk"] = _osecond.format(first="odev")
CTES["oema"] = _ema("ordi", "total", "total", "o_orderpriority").replace("rec_", "oema")
CTES["dmg"] = """
SELECT *, 'f' || (user_id % 3) AS source_file,
       CASE WHEN event_id % 97 = 0 THEN CAST(-1e31 AS DOUBLE) WHEN event_id % 89 = 0 THEN 0 ELSE value END AS raw FROM events
"""
CTES["flx"] = "SELECT ts, CASE WHEN raw > 0 THEN raw END AS electron_flux, source_file, event_id AS ordinal, user_id FROM dmg"
CTES["fld"] = """
SELECT ts, CASE WHEN event_id % 97 <> 0 THEN value - 50 END AS Bx, CASE WHEN event_id % 97 <> 0 THEN value / 2 END AS "By",
       CASE WHEN event_id % 97 <> 0 THEN CAST(event_id % 7 AS DOUBLE) END AS Bz, source_file, event_id AS ordinal FROM dmg
"""
CTES["hfl"] = """
SELECT ts, electron_flux, source_file, ordinal FROM (
  SELECT date_trunc('hour', ts) AS ts, electron_flux, source_file, ordinal,
         row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY source_file, ordinal) AS k FROM flx) WHERE k = 1
"""
CTES["mis"] = """
SELECT event_id, CASE event_id % 500 WHEN 0 THEN ts - INTERVAL 26 YEAR WHEN 1 THEN ts + INTERVAL 31 YEAR ELSE ts END AS ts, value,
       'f' || (user_id % 3) AS source_file FROM events
"""
CTES["okts"] = "SELECT *, ts BETWEEN TIMESTAMP '1994-11-01' AND TIMESTAMP '2024-02-02' AS inside FROM mis"
CTES["runs"] = """
SELECT min(i) AS first_idx, max(i) AS last_idx, count(*) AS run_length
FROM (SELECT i, i - row_number() OVER (ORDER BY i) AS g FROM fine WHERE goes_electron_flux IS NULL) GROUP BY g
"""
RECURSIVE = {"ema", "oema"}
_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def _needs(text: str, done: list[str]) -> None:
    for word in _WORD.findall(text):
        if word in CTES and word not in done and not (word in RECURSIVE and text is CTES[word]):
            done.append(word)
            _needs(CTES[word], done)


def _sql(final: str) -> str:
    """``final`` with the common tables it needs, in definition order."""
    wanted: list[str] = []
    _needs(final, wanted)
    heads = [f"{name} AS {'' if name in RECURSIVE else 'MATERIALIZED '}({CTES[name].strip()})" for name in CTES if name in wanted]
    return f"WITH RECURSIVE {', '.join(heads)} {final.strip()}" if heads else final.strip()


_TS_FIELDS = "event_id, ts, round(value, 6) + 0 AS electron_flux"
_SEQ = "OVER (PARTITION BY horizon, split ORDER BY i ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"

_FINAL = {
    "scan_flux": f"SELECT ts, {_r('electron_flux')}, source_file, ordinal FROM flx",
    "scan_vector": f"SELECT ts, {_r('Bx')}, {_r('By')}, {_r('Bz')}, source_file, ordinal FROM fld",
    "scan_plasma": f"""
        SELECT ts, {_r("CASE WHEN event_id % 97 <> 0 THEN sqrt((value - 50) * (value - 50) + value / 2 * (value / 2) + power(event_id % 7, 2)) END", "solar_wind_speed")},
               {_r("CASE WHEN raw > 0 THEN raw / 10 END", "plasma_density")}, source_file, event_id AS ordinal FROM dmg""",
    "scan_directory": f"SELECT ts, {_r('electron_flux')}, source_file, ordinal FROM hfl",
    "skipped_files": "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) % 5 = 0",
    "stream_bins": f"""SELECT make_timestamp(spine.n * w) AS ts, {_r('v', 'value')} FROM
        (SELECT unnest(generate_series((SELECT min(n) FROM sbin), (SELECT max(n) FROM sbin))) AS n) spine CROSS JOIN cfg LEFT JOIN sbin ON sbin.n = spine.n""",
    "resolve_column": f"""SELECT ts, {_r('electron_flux')}, source_file, ordinal,
        CASE WHEN user_id % 2 = 0 THEN 'E2W_COR_FLUX' ELSE 'e2_flux' END AS resolved FROM flx""",
    "scan_archive": f"SELECT ts, {_r('CASE WHEN value > 0 THEN value END', 'electron_flux')} FROM events",
    "xml_flatten": """
        WITH a AS (SELECT 'a' || lpad(CAST(event_id // 2000 AS VARCHAR), 9, '0') AS name, min(event_id) AS lo, count(*) AS n FROM events GROUP BY 1)
        SELECT name || '.zip' AS archive, path, value FROM (
          SELECT name, 'product@id' AS path, name AS value FROM a
          UNION ALL SELECT name, 'product/instrument/name', 'counter' FROM a
          UNION ALL SELECT name, 'product/instrument/unit', 'flux' FROM a
          UNION ALL SELECT name, 'product/instrument/unit@scale', 'log' FROM a
          UNION ALL SELECT name, 'product/first', CAST(lo AS VARCHAR) FROM a
          UNION ALL SELECT name, 'product/records', CAST(n AS VARCHAR) FROM a)""",
    "parse_layout_a": f"SELECT {_TS_FIELDS} FROM events",
    "parse_layout_b": f"SELECT {_TS_FIELDS} FROM events WHERE event_id % 50 <> 0",
    "parse_text_auto": f"""
        SELECT 'events' AS archive, 'm' || (user_id % 3) || '.txt' AS member, event_id AS line_no,
               CASE WHEN user_id % 3 = 1 THEN 'B' ELSE 'A' END AS layout, ts, {_r('value', 'electron_flux')}
        FROM events WHERE event_id % 50 <> 0 AND (user_id % 3 < 2 OR event_id % 2 = 0)""",
    "metadata_maps": f"""SELECT archive || '.zip' AS archive, CAST(6 AS BIGINT) AS n_fields, CAST(min(event_id) AS VARCHAR) AS first
        FROM (SELECT event_id, 'a' || lpad(CAST(event_id // {ARCHIVE_EVENTS} AS VARCHAR), 9, '0') AS archive FROM events) GROUP BY archive""",
    "archives_with_damage": f"SELECT ts, {_r('CASE WHEN value > 0 THEN value END', 'electron_flux')} FROM events WHERE event_id // {ARCHIVE_EVENTS} % 7 <> 0",
    "skipped_archives": f"""SELECT DISTINCT 'a' || lpad(CAST(event_id // {ARCHIVE_EVENTS} AS VARCHAR), 9, '0') || '.zip' AS archive, 'BadZipFile' AS reason
        FROM events WHERE event_id // {ARCHIVE_EVENTS} % 7 = 0""",
    "archive_folder": f"SELECT ts, {_r('CASE WHEN value > 0 THEN value END', 'electron_flux')} FROM events WHERE event_id // {FOLDER_EVENTS} % 7 <> 0",
    "ingest_folders": f"""
        SELECT g.ts, {', '.join(_r(f'g.{q(c)}', c) for c in GRID)}, {_r('truth_flux')} FROM grid g LEFT JOIN (
          SELECT make_timestamp(epoch_us(ts) // w * w) AS ts, avg(CASE WHEN value > 0 THEN value END) AS truth_flux
          FROM events, cfg WHERE event_id // {FOLDER_EVENTS} % 7 <> 0 GROUP BY 1) t ON t.ts = g.ts""",
    "archive_folder_report": f"""
        WITH a AS (SELECT event_id // {FOLDER_EVENTS} AS k, count(*) AS n FROM events GROUP BY 1)
        SELECT 'a' || lpad(CAST(k AS VARCHAR), 9, '0') || '.zip' AS archive, CASE WHEN k % 7 = 0 THEN 0 ELSE n + 1 END AS n_lines,
               CASE WHEN k % 7 = 0 THEN 'BadZipFile' END AS reason FROM a
        UNION ALL SELECT 'x' || k || '.zip', 0, 'BadZipFile' FROM a WHERE k % 5 = 0""",
    "rejected_lines": """SELECT 'events' AS archive, 'odd.txt' AS member, event_id AS line_no, 'value ' || event_id AS line
        FROM events WHERE event_id % 3 = 1 AND event_id < (SELECT min(event_id) FROM events WHERE event_id % 3 = 1) + 5""",
    "optional_source": f"SELECT ts, {_r('electron_flux')} FROM truth",
    "csv_roundtrip": f"SELECT ts, {_rs(GRID)} FROM grid",
    "align_grid": f"SELECT ts, {_rs(GRID)} FROM grid",
    "dataset_sink": f"""SELECT horizon, split, count(*) AS n_rows, CAST({len(s.MODEL_INPUTS)} AS BIGINT) AS n_features,
        '{",".join(s.MODEL_INPUTS)}' AS features FROM dst GROUP BY 1, 2""",
    "dataset_scan": f"SELECT ts, i AS row_idx, {_rs(s.MODEL_INPUTS)}, {_r('y')} FROM dst WHERE horizon = 'A' AND split = 'val'",
    "metrics_json": f"""SELECT horizon, {_r('any_value(alpha)', 'alpha')}, {_r('any_value(rmse)', 'val_rmse')},
        (SELECT len FROM cfg) AS sequence_length, {_metrics('y', 'ensemble')} FROM ens GROUP BY horizon""",
    "scaler_apply": f"SELECT ts, {_rs(s.SCALED_DRIVERS)} FROM pre",
    "profile_source": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS n_rows, count(*) - count({c}) AS n_nulls,
            CAST(min({e}) AS VARCHAR) AS min_value, CAST(max({e}) AS VARCHAR) AS max_value,
            (SELECT string_agg(CAST({c} AS VARCHAR), ', ' ORDER BY event_id) FROM (SELECT * FROM events ORDER BY event_id LIMIT 3)) AS sample
            FROM events"""
        for c, e, t in [("event_id", "event_id", "bigint"), ("ts", "ts", "timestamp_ntz"), ("user_id", "user_id", "bigint"),
                        ("event_type", "event_type", "string"), ("value", "value + 0", "double"), ("props", "props", "string")]
    ),
    "time_coverage": "SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, CAST(7 AS BIGINT) AS n_columns FROM grid",
    "null_fill_values": f"""SELECT event_id, {_r('CASE WHEN raw >= -1e20 THEN raw END', 'one_sided')},
        {_r('CASE WHEN abs(raw) <= 1e20 THEN -raw END', 'two_sided')} FROM dmg""",
    "null_nonpositive": f"SELECT event_id, {_r('CASE WHEN raw > 0 THEN raw END', 'electron_flux')} FROM dmg",
    "drop_corrupt_ts": f"""
        SELECT event_id, ts, {_r('value')}, source_file FROM okts JOIN
          (SELECT source_file, quantile_cont(epoch_us(ts), 0.5) AS m FROM okts WHERE inside GROUP BY 1) USING (source_file)
        WHERE inside AND abs(epoch_us(ts) - m) <= CAST(60 AS BIGINT) * 86400000000""",
    "drop_missing_target": f"SELECT ts, {_rs(GRID)} FROM grid WHERE goes_electron_flux IS NOT NULL",
    "interpolate_gaps": f"SELECT ts, {_rs(GRID)} FROM ({_filled('fine')})",
    "feature_table": f"SELECT ts, {_rs(s.FEATURE_COLUMNS)} FROM feat",
    "dynamic_lag": f"SELECT ts, i AS row_idx, {_rs([s.TARGET, s.LOG_TARGET, *s.LAGGED])} FROM lag",
    "select_features": f"SELECT ts, {_rs(s.MODEL_INPUTS)} FROM feat",
    "log_transform": f"SELECT ts, {_r('log10(goes_electron_flux + CAST(1e-10 AS DOUBLE))', 'log_electron_flux')} FROM grid",
    "valid_time": "SELECT horizon, ts, ts + to_microseconds(steps * w) AS valid_ts FROM dst, cfg",
    "align_predictions": f"SELECT horizon, split, ts, {_rs(['y', 'tree_pred', 'sequence_pred'])} FROM dst, cfg WHERE si >= len - 1",
    "merge_signals": f"""
        SELECT make_timestamp(spine.n * w) AS ts, {_rs(D)}
        FROM (SELECT unnest(generate_series((SELECT min(us // w) FROM rec, cfg WHERE NOT is_target), (SELECT max(us // w) FROM rec, cfg WHERE NOT is_target))) AS n) spine
        CROSS JOIN cfg LEFT JOIN (SELECT us // w AS n, {", ".join(f"avg({q(c)}) AS {q(c)}" for c in D)} FROM rec, cfg GROUP BY 1) m ON m.n = spine.n""",
    "asof_nearest": f"""SELECT near.ts, {_r('log_electron_flux')}, truth.ts AS matched_ts, {_r('truth.electron_flux', 'truth')}
        FROM near CROSS JOIN cfg JOIN truth ON epoch_us(truth.ts) = best_us WHERE abs(best_us - us) <= w // 2""",
    "horizon_lookup": f"SELECT ts, horizon, steps, label AS horizon_label, {_r('weight', 'alpha')} FROM dst",
    "resample_mean": f"""
        SELECT make_timestamp(spine.n * fw) AS ts, {_r('value')}
        FROM (SELECT unnest(generate_series((SELECT min(epoch_us(ts) // fw) FROM events, cfg), (SELECT max(epoch_us(ts) // fw) FROM events, cfg))) AS n) spine
        CROSS JOIN cfg LEFT JOIN (SELECT epoch_us(ts) // fw AS n, avg(value) AS value FROM events, cfg GROUP BY 1) m ON m.n = spine.n""",
    "dedup_keep_first": f"SELECT ts, {_r('electron_flux')}, source_file, ordinal FROM hfl",
    "union_signals": f"""
        SELECT ts, {_r('electron_flux')}, source_file, ordinal, CAST(NULL AS DOUBLE) AS Bx, CAST(NULL AS DOUBLE) AS "By", CAST(NULL AS DOUBLE) AS Bz FROM flx
        UNION ALL SELECT ts, NULL, source_file, ordinal, round(Bx, 6) + 0, round("By", 6) + 0, round(Bz, 6) + 0 FROM fld""",
    "null_rates": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(CAST(100 AS DOUBLE) * (count(*) - count({q(c)})) / count(*), 6) + 0 AS null_pct FROM grid" for c in GRID
    ),
    "robust_scale": f"SELECT name, {_r('center')}, {_r('scale')} FROM scl",
    "regression_metrics": f"SELECT horizon, split, count(*) AS n, {_metrics('y', 'tree_pred')} FROM dst GROUP BY 1, 2",
    "skill_score": f"""SELECT horizon, split,
        {_r('1 - avg(power(y - sequence_pred, 2)) / nullif(avg(power(y - persistence_pred, 2)), 0)', 'skill_score')} FROM dst GROUP BY 1, 2""",
    "best_alpha": f"SELECT horizon, {_r('alpha')}, {_r('rmse', 'val_rmse')} FROM alp",
    "step_counts": f"""
        SELECT 'missing_target' AS step, (SELECT count(*) FROM grid) AS rows_in, (SELECT count(*) FROM grid) - (SELECT count(*) FROM tgt) AS rows_dropped, CAST(0 AS BIGINT) AS values_nulled
        UNION ALL SELECT 'spikes', (SELECT count(*) FROM tgt), 0, (SELECT count(*) FROM spk WHERE spike)
        UNION ALL SELECT 'long_gaps', (SELECT count(*) FROM tgt), (SELECT count(*) FROM tgt) - (SELECT count(*) FROM ser), 0
        UNION ALL SELECT 'features', (SELECT count(*) FROM ser), (SELECT count(*) FROM ser) - (SELECT count(*) FROM feat), 0""",
    "lag_step_stats": f"SELECT {_r('avg(steps)', 'mean_steps')}, max(steps) AS max_steps FROM stp",
    "split_counts": "SELECT horizon, split, count(*) AS n_rows FROM dst GROUP BY 1, 2",
    "rolling_median": f"SELECT ts, {_r('goes_electron_flux')}, {_r('med', 'rolling_median')} FROM dev",
    "despike_mad": f"""SELECT ts, {_r('goes_electron_flux')}, {_r('med', 'rolling_median')}, {_r('dev', 'abs_dev')}, {_r('mad', 'rolling_mad')},
        spike AS is_spike FROM spk""",
    "lag_features": f"SELECT ts, {', '.join(_r(c) for c in s.LAG_COLUMNS)} FROM (SELECT ts, {_LAGS} FROM pre)",
    "rolling_stats": f"SELECT ts, {_rs(s.ROLLING_COLUMNS)} FROM (SELECT ts, {_rolling('log_electron_flux', 'log_flux')} FROM pre)",
    "ema": f"SELECT ts, {_rs(s.EMA_COLUMNS)} FROM ema",
    "delta_features": f"SELECT ts, {_rs(s.DELTA_COLUMNS)} FROM (SELECT ts, {_DELTAS} FROM lag)",
    "horizon_target": "SELECT ts, "
        + ", ".join(f"round(lead(log_electron_flux, {k}) OVER (ORDER BY i), 6) + 0 AS y_{h}" for h, k in s.HORIZON_STEPS.items())
        + " FROM feat",
    "null_runs": "SELECT first_idx, last_idx, run_length FROM runs",
    "row_index": "SELECT ts, i AS row_idx FROM tgt",
    "sequence_windows": f"""
        SELECT d.horizon, d.split, d.ts, {_r('any_value(d.y)', 'y')}, count(*) AS length, CAST({len(s.MODEL_INPUTS)} AS BIGINT) AS width,
               {_r('arg_min(CAST(p.log_electron_flux AS FLOAT), p.si)', 'oldest_flux')}, {_r('arg_max(CAST(p.log_electron_flux AS FLOAT), p.si)', 'newest_flux')},
               {', '.join(_r(f'sum(CAST(CAST(p.{c} AS FLOAT) AS DOUBLE))', f'sum_{c}') for c in s.MODEL_INPUTS)}
        FROM dst d CROSS JOIN cfg JOIN dst p ON p.horizon = d.horizon AND p.split = d.split AND p.si BETWEEN d.si - len + 1 AND d.si
        WHERE d.si >= len - 1 GROUP BY 1, 2, 3""",
    "sequence_chunks": f"""
        SELECT i AS row_idx, n_known, {_r('weighted - (i - 287) * first_sum', 'moment')}, {', '.join(_r(f'sum_{c}') for c in GRID)} FROM (
          SELECT i, count(*) OVER w AS n, CAST({' + '.join(f'count({q(c)}) OVER w' for c in GRID)} AS BIGINT) AS n_known,
                 coalesce(sum(i * CAST(CAST(goes_electron_flux AS FLOAT) AS DOUBLE)) OVER w, 0) AS weighted,
                 coalesce(sum(CAST(CAST(goes_electron_flux AS FLOAT) AS DOUBLE)) OVER w, 0) AS first_sum,
                 {', '.join(f'coalesce(sum(CAST(CAST({q(c)} AS FLOAT) AS DOUBLE)) OVER w, 0) AS sum_{c}' for c in GRID)}
          FROM fine WINDOW w AS (ORDER BY i ROWS BETWEEN 287 PRECEDING AND CURRENT ROW)) WHERE n = 288""",
    "chrono_split": f"SELECT horizon, ts, i AS row_idx, {_r('y')}, split, si AS split_idx FROM dst",
    "persistence": f"SELECT horizon, valid_ts, {_r('persistence_pred')} FROM val",
    "sorted_sink": f"SELECT ts, {_r('goes_electron_flux')} FROM feat",
    "latest_conditions": "SELECT ts, "
        + ", ".join(f"printf('{f}', {c}) AS {c}" for c, f in {"Bx_lag": "%.2f", "By_lag": "%.2f", "Bz_lag": "%.2f", "solar_wind_speed_lag": "%.1f", "plasma_density_lag": "%.2f"}.items())
        + " FROM feat WHERE ts = (SELECT max(ts) FROM feat)",
    "latest_window": f"SELECT ts, {_rs(s.MODEL_INPUTS)} FROM feat, cfg WHERE i >= n - len",
    "multi_horizon": f"SELECT horizon, steps, ts, {_r('y')} FROM dst",
    "scalar_math": f"""SELECT event_id, {_r('abs(value - 50)', 'abs_value')}, {_r('log10(value + CAST(1e-10 AS DOUBLE))', 'log_value')},
        {_r('sqrt(value)', 'root_value')}, {_r('power(CAST(10 AS DOUBLE), value / 100)', 'power_value')},
        {_r('round(value / 7, 4)', 'rounded_value')}, {_r('round_even(value / 2, 0)', 'even_value')} FROM events""",
    "lag_steps": """SELECT event_id, CAST(greatest(coalesce(round_even(CAST(1.5e6 AS DOUBLE) / (nullif(speed, 0) * 60) / 5, 0), 0), 0) AS BIGINT) AS steps
        FROM (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 0 WHEN event_id % 89 = 0 THEN NULL ELSE value * 2 - 20 END AS speed FROM events)""",
    "scalar_time": f"""SELECT event_id, make_timestamp(epoch_us(ts) // w * w) AS bin_ts, ts + to_microseconds(9 * w) AS later_ts,
        {_r('CAST(epoch_us(ts) % w AS DOUBLE) / 1000000', 'seconds_into_bin')}, dayofyear(ts) AS doy FROM events, cfg""",
    "vector_norm": f"""SELECT event_id,
        {_r('CASE WHEN event_id % 97 <> 0 THEN sqrt((value - 50) * (value - 50) + value / 2 * (value / 2) + power(event_id % 7, 2)) END', 'length')},
        {_r('CASE WHEN event_id % 97 <> 0 THEN value - 50 END', 'first_part')} FROM events""",
    "confidence_label": f"""
        SELECT horizon, r2, CASE WHEN r2 >= 0.5 THEN 'High' WHEN r2 >= 0 THEN 'Moderate' ELSE '{s.CONFIDENCE_TEXT["low"]}' END AS confidence
        FROM (SELECT horizon, {_metrics('y', 'ensemble')} FROM ens GROUP BY horizon)""",
    "ensemble_blend": f"SELECT horizon, ts, {_r('weight * sequence_pred + (1 - weight) * tree_pred', 'ensemble')} FROM dst",
    "model_comparison": " UNION ALL ".join(
        f"SELECT horizon, '{m}' AS model, count(*) AS n, {_metrics('y', p)} FROM dst WHERE split = 'test' GROUP BY horizon"
        for m, p in (("ensemble", "(weight * sequence_pred + (1 - weight) * tree_pred)"), ("tree_only", "tree_pred"), ("sequence_only", "sequence_pred"))
    ),
    "validate_truth": f"""SELECT horizon, count(*) AS n_matched, {_metrics('truth', 'model_pred', 'model_')}, {_metrics('truth', 'persistence_pred', 'persistence_')},
        {_r('1 - avg(power(truth - model_pred, 2)) / nullif(avg(power(truth - persistence_pred, 2)), 0)', 'skill_score_vs_persistence')} FROM vmat GROUP BY horizon""",
    "history_series": f"""
        SELECT make_timestamp(spine.n * w * 4) AS ts, {_r('v', 'goes_electron_flux')}
        FROM (SELECT unnest(generate_series((SELECT min(epoch_us(ts) // (w * 4)) FROM feat, cfg), (SELECT max(epoch_us(ts) // (w * 4)) FROM feat, cfg))) AS n) spine
        CROSS JOIN cfg LEFT JOIN (SELECT epoch_us(ts) // (w * 4) AS n, avg(goes_electron_flux) AS v FROM feat, cfg GROUP BY 1) m ON m.n = spine.n""",
    "metric_report": f"""SELECT horizon, any_value(label) AS horizon_label, {_r('any_value(alpha)', 'alpha')}, {_metrics('y', 'ensemble', rounding=4)}
        FROM ens GROUP BY horizon""",
    "rolling_stats_by_key": f"""SELECT o_orderpriority, ts, i AS row_idx, {_rs(c.replace('log_flux', 'total') for c in s.ROLLING_COLUMNS)}
        FROM (SELECT *, {_rolling('total', 'total', 'PARTITION BY o_orderpriority')} FROM ordi)""",
    "despike_by_key": f"""SELECT o_orderpriority, ts, {_r('total')}, i AS row_idx, {_r('med', 'rolling_median')}, {_r('dev', 'abs_dev')},
        {_r('mad', 'rolling_mad')}, spike AS is_spike FROM ospk""",
    "ema_by_key": f"SELECT o_orderpriority, ts, i AS row_idx, {_rs(c.replace('log_flux', 'total') for c in s.EMA_COLUMNS)} FROM oema",
    "resample_by_key": f"""
        SELECT b.o_orderpriority, b.o_orderstatus, b.o_orderdate, {_r('m.o_totalprice', 'o_totalprice')}
        FROM (SELECT o_orderpriority, o_orderstatus, unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS o_orderdate FROM orders GROUP BY 1, 2) b
        LEFT JOIN (SELECT o_orderpriority, o_orderstatus, o_orderdate, avg(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2, 3) m
        USING (o_orderpriority, o_orderstatus, o_orderdate)""",
    "robust_scale_by_key": f"""
        SELECT o_orderkey, o_orderpriority, {_r('(o_totalprice - m) / (h - l)', 'o_totalprice_scaled')} FROM orders JOIN
        (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.25) AS l, quantile_cont(o_totalprice, 0.75) AS h
         FROM orders GROUP BY 1) USING (o_orderpriority)""",
    "interpolate_gaps_by_key": f"""SELECT g.user_id, g.ts, g.i AS row_idx,
        {_r('CASE WHEN g.value IS NOT NULL THEN g.value WHEN g.ni - g.pi - 1 <= ' + str(s.MAX_GAP) + ' THEN p.value + (n.value - p.value) / (g.ni - g.pi) * (g.i - g.pi) END', 'value')}
        FROM usrgap g LEFT JOIN usr p ON p.user_id = g.user_id AND p.i = g.pi LEFT JOIN usr n ON n.user_id = g.user_id AND n.i = g.ni""",
    "null_runs_by_key": """SELECT user_id, min(i) AS first_idx, max(i) AS last_idx, count(*) AS run_length FROM usrgap WHERE value IS NULL GROUP BY user_id, pi""",
    "lag_features_by_key": f"""SELECT user_id, ts, i AS row_idx, {', '.join(_r(f'lag(value, {k}) OVER (PARTITION BY user_id ORDER BY i)', f'value_lag_{k}') for k in s.LAG_STEPS)},
        {_r('value - lag(value) OVER (PARTITION BY user_id ORDER BY i)', 'delta_value')} FROM usr""",
    "asof_by_key": f"""SELECT event_id, user_id, ts, matched_ts, {_r('viewed')} FROM (
        SELECT l.event_id, l.user_id, l.ts, r.ts AS matched_ts, r.value AS viewed,
               row_number() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.ts) AS place
        FROM events l JOIN events r ON r.user_id = l.user_id AND r.event_type = 'view' AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 86400000000
        WHERE l.event_type = 'purchase') WHERE place = 1""",
    "gbt_search_rule": "SELECT DISTINCT horizon, CAST(16 AS BIGINT) AS n_trials, CAST(1 AS BIGINT) AS n_best, TRUE AS first_smallest FROM dst WHERE split = 'val'",
    "gbt_saved_rows": f"SELECT horizon, ts, {_r('y')}, TRUE AS same FROM dst WHERE split = 'test' AND horizon IN (SELECT horizon FROM dst WHERE split = 'val')",
    "seq_rows": f"SELECT horizon, split, ts, {_r('y')}, TRUE AS forecast FROM dst, cfg WHERE si >= len - 1 AND horizon IN (SELECT horizon FROM dst WHERE split = 'val')",
    "full_history_rows": f"""SELECT f.ts + to_microseconds(h.steps * w) AS valid_ts, h.horizon, {_r('f.log_electron_flux', 'persistence_pred')}, TRUE AS forecast
        FROM feat f CROSS JOIN cfg CROSS JOIN (SELECT DISTINCT horizon, steps FROM dst, cfg WHERE split = 'val' AND si >= len - 1) h WHERE f.i >= len - 1""",
    "gbt_rounds": " UNION ALL ".join(
        f"SELECT horizon, CAST({k} AS BIGINT) AS round, {_r('sqrt(avg((y - f) * (y - f)))', 'val_rmse')} FROM sd{k} WHERE split = 'val' GROUP BY horizon" for k in (1, 2, 3)
    ),
    "seq_pairs": f"""SELECT horizon, split, ts, {_r('y')}, {_r('my + w1 * (z1 - m1) + w2 * (z2 - m2)', 'sequence_pred')}
        FROM pw JOIN pc USING (horizon) WHERE horizon IN (SELECT horizon FROM hv)""",
    "window_gram": f"""SELECT CAST(la.lag AS BIGINT) AS lag_a, a.name AS input_a, CAST(lb.lag AS BIGINT) AS lag_b, b.name AS input_b, {_r('sum(a.value * b.value)', 'total')}
        FROM gmt CROSS JOIN gml la CROSS JOIN gml lb JOIN gmv a ON a.si = gmt.t - la.lag JOIN gmv b ON b.si = gmt.t - lb.lag GROUP BY 1, 2, 3, 4""",
    "full_history_values": f"SELECT valid_ts, horizon, {_r('model_pred')}, {_r('persistence_pred')} FROM fhv",
    "latest_forecast_values": f"""
        SELECT fhv.horizon, valid_ts, {_r('model_pred', 'log_pred')}, {_r('power(CAST(10 AS DOUBLE), model_pred)', 'flux_pred')}, r2,
               CASE WHEN r2 >= 0.5 THEN 'High' WHEN r2 >= 0 THEN 'Moderate' ELSE '{s.CONFIDENCE_TEXT["low"]}' END AS confidence
        FROM fhv JOIN (SELECT horizon, {_metrics('y', 'ensemble')} FROM ens GROUP BY horizon) USING (horizon) WHERE i = n - 1""",
    "latest_forecast_rows": """SELECT h.horizon, f.ts + to_microseconds(h.steps * w) AS valid_ts, TRUE AS text_fits, TRUE AS rated
        FROM feat f CROSS JOIN cfg CROSS JOIN (SELECT DISTINCT horizon, steps FROM dst, cfg WHERE split = 'val' AND si >= len - 1) h
        WHERE f.i = f.n - 1 AND f.n >= len""",
}

ORACLES = {name: _sql(final) for name, final in _FINAL.items()}
