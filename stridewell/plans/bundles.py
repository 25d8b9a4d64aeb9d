"""Queries of the bundles, with the same statistics in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bundles as B
from ..operators import segments as G
from ..operators.statistics import half_away
from ..sources.shared import staged
from .frames import PATH, RECORDING, path, recording
from .motion import NEST, ORDERED, RUNS, SPAN, STEP3, rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ["pid"]
M2 = "nullif(var_pop(x), 0)"
#: The thirteen statistics of x over idx; third and fourth moments from power sums, so that short groups have them too.
THIRTEEN = {
    "cv": "stddev_pop(x) / nullif(avg(x), 0)",
    "slope": "regr_slope(x, idx)",
    "mean": "avg(x)",
    "median": "median(x)",
    "std": "stddev_pop(x)",
    "var": "var_pop(x)",
    "skew": f"(avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * pow(avg(x), 3)) / pow({M2}, 1.5)",
    "kurtosis": f"(avg(x * x * x * x) - 4 * avg(x) * avg(x * x * x) + 6 * pow(avg(x), 2) * avg(x * x) - 3 * pow(avg(x), 4)) / pow({M2}, 2) - 3",
    "iqr": "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)",
    "range": "max(x) - min(x)",
    "min": "min(x)",
    "max": "max(x)",
    "sum": "sum(x)",
}


#: Third and fourth moments where a source has the distances from the mean: lists of nearly equal numbers lose no digits.
CENTRED = {"skew": f"avg(d * d * d) / pow({M2}, 1.5)", "kurtosis": f"avg(d * d * d * d) / pow({M2}, 2) - 3"}


def thirteen(source: str, keys: str, part: str | None = None, centred: bool = False) -> str:
    """SQL of the statistics of a source with x and idx, and d if it is centred; ``part`` is an SQL expression."""
    named = f"{part} AS part, " if part else ""
    group = f"{keys}, {part}" if part and "'" not in part else keys
    return " UNION ALL ".join(f"SELECT {keys}, {named}'{s}' AS stat, round({q}, 5) AS value FROM {source} WHERE x IS NOT NULL GROUP BY {group}" for s, q in (THIRTEEN | (CENTRED if centred else {})).items())


def halved(df, digits: int = 5):
    """Doubles rounded as in the SQL, where means and middles of short decimals lie between two places."""
    return df.select(*(half_away(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def rec(name: str, body, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: halved(body(recording(spark, d)))
    if sql:
        ORACLE_SQL[name] = f"WITH {RECORDING}{sql}"


def pts(name: str, body, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: rounded(body(path(spark, d)), 5)
    if sql:
        ORACLE_SQL[name] = f"WITH {PATH}{sql}"


# -- extremes -----------------------------------------------------------------------------------------------------------
SEEN = ", seen AS (SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS q, avg(x) OVER (PARTITION BY pid) AS m, stddev_pop(x) OVER (PARTITION BY pid) AS s FROM rec WINDOW w AS (PARTITION BY pid ORDER BY idx))"
TOP, LOW = "x > p AND x > q AND x > m + factor * s", "x < p AND x < q AND x < m - factor * s"
PEAKS = f"""{SEEN}, pk AS (SELECT pid, side, factor, count(*) FILTER (CASE WHEN side = 'max' THEN {TOP} ELSE {LOW} END) AS n_peaks, max(t) - min(t) AS span
  FROM seen, (VALUES (1.0::DOUBLE), (1.5), (2.0), (3.0)) a(factor), (VALUES ('max'), ('min')) b(side) GROUP BY ALL)"""
GAPS = f"""sided AS (SELECT pid, idx, t, CASE WHEN {TOP} THEN 'max' WHEN {LOW} THEN 'min' END AS side FROM seen, (SELECT 1.0 AS factor)),
gaps AS (SELECT pid, side, t - lag(t) OVER w AS x, row_number() OVER w AS idx FROM sided WHERE side IS NOT NULL WINDOW w AS (PARTITION BY pid, side ORDER BY idx))"""
rec("agg_peaks", lambda r: B.peak_table(r, KEY), f"{PEAKS} SELECT pid, side, factor, n_peaks, round(n_peaks / nullif(span, 0), 5) AS per_second FROM pk")
rec("agg_peak_gaps", lambda r: B.gap_table(r, KEY), f"{SEEN}, {GAPS} {thirteen('gaps', 'pid, side')}")
BANDS = """, md AS (SELECT pid, median(x) AS med, avg(x) AS mean, stddev_pop(x) AS sd FROM {source} GROUP BY pid),
ma AS (SELECT pid, any_value(med) AS med, any_value(mean) AS mean, any_value(sd) AS sd, median(abs(x - med)) AS mad FROM {source} JOIN md USING (pid) GROUP BY pid),
bz AS (SELECT r.*, form, factor, (CASE WHEN form = 'mad' THEN abs(x - med) <= factor * mad ELSE abs(x - mean) <= factor * sd END)::INT AS on_
  FROM {source} r JOIN ma USING (pid), (VALUES (1.25::DOUBLE), (1.0), (0.75), (0.5)) a(factor), (VALUES ('mad'), ('sd')) b(form)),
bc AS (SELECT *, (on_ <> coalesce(lag(on_) OVER w, -1))::INT AS c FROM bz WINDOW w AS (PARTITION BY pid, form, factor ORDER BY idx)),
bi AS (SELECT *, sum(c) OVER (PARTITION BY pid, form, factor ORDER BY idx) AS run FROM bc),
bd AS (SELECT pid, form, factor, max(t) - min(t) AS d FROM bi WHERE on_ = 1 GROUP BY pid, form, factor, run),
bands AS (SELECT pid, form, factor, count(*) AS n_runs, sum(d) AS total FROM bd GROUP BY ALL)"""
rec("agg_band_runs", lambda r: B.band_table(r, KEY), f"{BANDS.format(source='rec')} SELECT pid, form, factor, n_runs, round(total, 5) AS total FROM bands")
DECAY = """, ends AS (SELECT pid, arg_max(struct_pack(i := idx, t := t), struct_pack(x := x, k := -idx)) AS top, arg_max(struct_pack(i := idx, t := t), struct_pack(x := -x, k := -idx)) AS low, avg(x) AS m, stddev_pop(x) AS s FROM rec GROUP BY pid),
dec AS (SELECT pid, 'max' AS side, min(CASE WHEN idx >= top.i AND x < m + s THEN t END) - any_value(top.t) AS value FROM rec JOIN ends USING (pid) GROUP BY pid
  UNION ALL SELECT pid, 'min', min(CASE WHEN idx >= low.i AND x > m - s THEN t END) - any_value(low.t) FROM rec JOIN ends USING (pid) GROUP BY pid)"""
rec("agg_decay", lambda r: B.decay_table(r, KEY), f"{DECAY} SELECT pid, side, round(value, 5) AS value FROM dec")

# -- runs -----------------------------------------------------------------------------------------------------------------
#: Hands and the kinds of event that act as a press of their trigger.
HANDS = {"LeftHand": "click", "RightHand": "view"}
_islands = " UNION ALL ".join(
    f"SELECT pid, idx, t, on_, run, '{hand}' AS hand FROM (WITH {RUNS.replace(chr(39) + 'click' + chr(39), chr(39) + kind + chr(39))} SELECT * FROM isl)" for hand, kind in HANDS.items()
)
TABLE = f""", islands AS ({_islands}), sp AS (SELECT pid, min(t) AS t0, max(t) - min(t) AS span FROM rec GROUP BY pid),
d AS (SELECT pid, hand, on_, min(t) AS s, max(t) - min(t) AS d FROM islands GROUP BY pid, hand, on_, run),
tb AS (SELECT pid, hand || CASE WHEN on_ = 1 THEN ' active' ELSE ' inactive' END AS side, count(*) AS n_runs, round(count(*) / nullif(any_value(span), 0), 5) AS per_second, round(sum(d), 5) AS total, round(avg(d), 5) AS mean,
  round(stddev_pop(d), 5) AS std, round(min(d), 5) AS shortest, round(max(d), 5) AS longest, round(arg_min(s - t0, struct_pack(d := d, s := s)), 5) AS shortest_start,
  round(arg_max(s - t0, struct_pack(d := d, s := -s)), 5) AS longest_start FROM d JOIN sp USING (pid) GROUP BY pid, hand, on_)"""


def sides(*names: str) -> dict:
    """Masks of the runs of both hands: active where the trigger is pressed, inactive where it is not."""
    masks = {f"{hand} active": F.col("kind") == kind for hand, kind in HANDS.items()}
    masks |= {f"{hand} inactive": F.col("kind") != kind for hand, kind in HANDS.items()}
    return {k: v for k, v in masks.items() if not names or k in names}


rec("agg_trigger", lambda r: B.run_table(r, KEY, sides()), f"{TABLE} SELECT * FROM tb")
for _name, _side in (("agg_trigger_on", "LeftHand active"), ("agg_trigger_off", "LeftHand inactive"), ("agg_interval", "RightHand active")):
    rec(_name, lambda r, s=_side: B.run_table(r, KEY, sides(s)), f"{TABLE} SELECT * FROM tb WHERE side = '{_side}'")

# -- sessions, steps, substeps ----------------------------------------------------------------------------------------------
#: Samples in their step and substep, the steps but the last, times and thirteen statistics of each segment.
LEVELS = f"""{NEST}, st AS (SELECT DISTINCT pid, step AS segment, step_start AS a, step_end AS b FROM nest), ls AS (SELECT pid, max(segment) AS last FROM st GROUP BY pid),
sg AS (SELECT 'step' AS level, st.* FROM st UNION ALL SELECT 'substep', pid, sub_id, start_idx, end_idx FROM nest),
inn AS (SELECT sg.level, sg.pid, sg.segment, sm.idx, sm.t, sm.x FROM sg JOIN sm ON sm.pid = sg.pid AND sm.idx >= a AND sm.idx < b),
du AS (SELECT level, pid, segment, max(t) - min(t) AS x FROM inn GROUP BY ALL), dw AS (SELECT du.* FROM du JOIN ls USING (pid) WHERE level = 'substep' OR segment < last),
fe AS (SELECT level, pid, segment, stat AS feature, value AS x FROM ({thirteen('inn', 'level, pid, segment')}) WHERE value IS NOT NULL AND NOT isnan(value)),
fw AS (SELECT fe.* FROM fe JOIN ls USING (pid) WHERE level = 'substep' OR segment < last)"""
#: A table of values by segment, with their places in the list and their distances from the list's mean; and the segments of the ends.
PLACED = "{name} AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY segment) - 1 AS idx, x - avg(x) OVER (PARTITION BY {keys}) AS d FROM {source})"
ENDS = "SELECT {keys}, '{most}' AS stat, arg_max(segment, struct_pack(x := x, k := -segment))::DOUBLE AS value FROM {source} GROUP BY {keys} UNION ALL SELECT {keys}, '{least}', arg_min(segment, struct_pack(x := x, k := segment))::DOUBLE FROM {source} GROUP BY {keys}"
levels = lambda r: (staged(G.substep_log(r), "log"), staged(G.stream(r), "stream"), KEY, SPAN)
DURATION = f"""{LEVELS}, {PLACED.format(name='dp', keys='pid, level', source='dw')}, dk AS (SELECT pid, 'kind ' || kind AS part, segment, x FROM dw JOIN nest USING (pid) WHERE level = 'substep' AND sub_id = segment),
{PLACED.format(name='kp', keys='pid, part', source='dk')}, la AS (SELECT pid, max(t) AS t FROM l0 GROUP BY pid), lk AS (SELECT sm.pid, sm.idx, row_number() OVER (PARTITION BY sm.pid ORDER BY abs(sm.t - la.t), sm.idx) AS k FROM la JOIN sm USING (pid))
SELECT pid, 'session' AS part, 'duration' AS stat, round(max(t) - min(t), 5) AS value FROM sm GROUP BY pid
UNION ALL SELECT sm.pid, 'tail', 'duration', round(max(t) - min(t), 5) FROM sm JOIN lk ON lk.pid = sm.pid AND lk.k = 1 AND sm.idx >= lk.idx GROUP BY sm.pid
UNION ALL SELECT pid, level, stat, value FROM ({thirteen('dp', 'pid, level', centred=True)}) UNION ALL SELECT pid, level, stat, value FROM ({ENDS.format(keys='pid, level', source='dw', most='longest', least='shortest')})
UNION ALL {thirteen('kp', 'pid, part', centred=True)}"""
rec("agg_duration", lambda r: B.duration_table(*levels(r)), DURATION)
rec("agg_cross_step", lambda r: B.across_segments(*levels(r)), f"{LEVELS}, {PLACED.format(name='fp', keys='pid, level, feature', source='fw')} {thirteen('fp', 'pid, level, feature', centred=True)} UNION ALL {ENDS.format(keys='pid, level, feature', source='fw', most='largest', least='smallest')}")
rec("agg_by_type", lambda r: B.by_type(*levels(r)), f"{LEVELS}, fk AS (SELECT pid, kind, feature, segment, x FROM fe JOIN nest USING (pid) WHERE level = 'substep' AND sub_id = segment), {PLACED.format(name='fp', keys='pid, kind, feature', source='fk')} {thirteen('fp', 'pid, kind, feature', centred=True)}")

# -- positions, rotations, movement --------------------------------------------------------------------------------------------
AXES = ", ax AS (SELECT pid, idx, part, x FROM (SELECT pid, idx, {columns} FROM {source}) UNPIVOT (x FOR part IN ({columns})))"
WALK = f"""{STEP3}, wk AS (SELECT pid, sum(s) AS total, sqrt((arg_max(px, idx) - arg_min(px, idx)) ** 2 + (arg_max(py, idx) - arg_min(py, idx)) ** 2 + (arg_max(pz, idx) - arg_min(pz, idx)) ** 2) AS net,
  (max(px) - min(px)) * (max(py) - min(py)) * (max(pz) - min(pz)) AS box FROM ln GROUP BY pid),
wl AS (SELECT pid, 'path' AS part, stat, round(value, 5) AS value FROM (SELECT pid, total, net, net / total AS efficiency, box FROM wk) UNPIVOT (value FOR stat IN (total, net, efficiency, box)))"""
pts("agg_position", lambda p: B.position(p, KEY, hull=False), f"{WALK}{AXES.format(columns='px, py, pz', source='pt')} SELECT * FROM wl UNION ALL {thirteen('ax', 'pid, part')}")
SIX = ["px", "py", "pz", "qx", "qy", "qz"]
pts("agg_sixd", lambda p: B.described(p, KEY, SIX), f"{AXES.format(columns=', '.join(SIX), source='pt')} {thirteen('ax', 'pid, part')}")
TURNED = """, aq AS (SELECT pid, idx, qx, qy, qz, qw, qx / s AS axis_x, qy / s AS axis_y, qz / s AS axis_z, 2 * atan2(s, qw) AS angle FROM (SELECT *, sqrt(qx * qx + qy * qy + qz * qz) AS s FROM pt)),
pq AS (SELECT pid, qx, qy, qz, qw, lag(qx) OVER w AS bx, lag(qy) OVER w AS by_, lag(qz) OVER w AS bz, lag(qw) OVER w AS bw FROM pt WINDOW w AS (PARTITION BY pid ORDER BY idx))"""
pts(
    "agg_quat",
    lambda p: B.rotation(p, KEY),
    f"{TURNED}{AXES.format(columns='qx, qy, qz, qw, axis_x, axis_y, axis_z, angle', source='aq')} SELECT pid, 'total' AS part, 'value' AS stat, round(sum(2 * acos(least(1.0, abs(qx * bx + qy * by_ + qz * bz + qw * bw)))), 5) AS value FROM pq GROUP BY pid UNION ALL {thirteen('ax', 'pid, part')}",
)
_speed = ", ".join(f"CASE WHEN idx < 2 THEN (lead(p{c}, 2) OVER w - p{c}) / (lead(t, 2) OVER w - t) WHEN idx >= n - 2 THEN (p{c} - lag(p{c}, 2) OVER w) / (t - lag(t, 2) OVER w) ELSE (lead(p{c}, 2) OVER w - lag(p{c}, 2) OVER w) / (lead(t, 2) OVER w - lag(t, 2) OVER w) END AS v{c}" for c in "xyz")
MOVED = f""", cn AS (SELECT *, count(*) OVER (PARTITION BY pid) AS n FROM pt), vv AS (SELECT pid, idx, t, n, {_speed} FROM cn {ORDERED}),
mv AS (SELECT pid, idx, t, vx, vy, vz, sqrt(vx * vx + vy * vy + vz * vz) AS magnitude FROM vv WHERE n >= 4), mx AS (SELECT pid, idx, t, magnitude AS x FROM mv)"""
OPPOSED = f"""{STEP3}, nx AS (SELECT *, lead(dx) OVER w AS nx, lead(dy) OVER w AS ny, lead(dz) OVER w AS nz, dx * lag(dx) OVER w + dy * lag(dy) OVER w + dz * lag(dz) OVER w AS k FROM ln {ORDERED}),
tp AS (SELECT pid, arg_max(struct_pack(i := idx, x := px, y := py, z := pz), struct_pack(s := coalesce(s, -1), k := -idx)) AS top, arg_min(struct_pack(x := px, y := py, z := pz), idx) AS a FROM ln GROUP BY pid),
wy AS (SELECT pid, top.i AS i, top.x - a.x AS ax, top.y - a.y AS ay, top.z - a.z AS az FROM tp),
al AS (SELECT pid, idx, i, (nx * ax + ny * ay + nz * az) / sqrt(ax * ax + ay * ay + az * az) AS a FROM nx JOIN wy USING (pid))"""
pts(
    "agg_motion",
    lambda p: B.movement(p, KEY),
    f"""{MOVED}{BANDS.format(source='mx')}{OPPOSED}{AXES.format(columns='vx, vy, vz, magnitude', source='mv')}
SELECT pid, 'reversals' AS part, 'n' AS stat, count(*) FILTER (k < 0)::DOUBLE AS value FROM nx GROUP BY pid UNION ALL SELECT pid, 'reversals', 'per_second', round(count(*) FILTER (k < 0) / (max(t) - min(t)), 5) FROM nx GROUP BY pid
UNION ALL SELECT pid, 'opposing', 'value', round(coalesce(sum(CASE WHEN idx >= i AND a < 0 THEN -a END), 0), 5) FROM al GROUP BY pid
UNION ALL SELECT pid, 'pause ' || form || ' ' || factor, 'n_runs', n_runs::DOUBLE FROM bands UNION ALL SELECT pid, 'pause ' || form || ' ' || factor, 'total', round(total, 5) FROM bands UNION ALL {thirteen('ax', 'pid, part')}""",
)
EXTREMES = """, ex AS (SELECT pid, max(x) AS max_x, min(x) AS min_x, arg_max(t, struct_pack(x := x, k := -idx)) - min(t) AS to_max, arg_max(t, struct_pack(x := -x, k := -idx)) - min(t) AS to_min, max(t) - min(t) AS span FROM rec GROUP BY pid),
el AS (SELECT pid, stat, value FROM (SELECT pid, max_x, min_x, to_max, to_min, to_max / span AS max_share, to_min / span AS min_share FROM ex) UNPIVOT (value FOR stat IN (max_x, min_x, to_max, to_min, max_share, min_share)))"""
BEYOND = """, bf AS (SELECT *, avg(x) OVER (PARTITION BY pid) AS m, stddev_pop(x) OVER (PARTITION BY pid) AS s FROM rec),
bs AS (SELECT bf.*, factor, side, (CASE WHEN side = 'above' THEN x > m + factor * s ELSE x < m - factor * s END)::INT AS on_ FROM bf, (VALUES (1.0::DOUBLE), (1.5), (2.0), (3.0)) a(factor), (VALUES ('above'), ('below')) b(side)),
bk AS (SELECT *, (on_ <> coalesce(lag(on_) OVER w, -1))::INT AS c FROM bs WINDOW w AS (PARTITION BY pid, factor, side ORDER BY idx)), br AS (SELECT *, sum(c) OVER (PARTITION BY pid, factor, side ORDER BY idx) AS run FROM bk),
bt AS (SELECT pid, side, factor, max(t) - min(t) AS d FROM br WHERE on_ = 1 GROUP BY pid, side, factor, run)"""
rec(
    "agg_custom",
    lambda r: B.custom(r, KEY),
    f"""{EXTREMES}{BEYOND}{PEAKS}, {GAPS}{DECAY}
SELECT pid, 'signal' AS part, 'cv' AS stat, round({THIRTEEN['cv']}, 5) AS value FROM rec GROUP BY pid UNION ALL SELECT pid, 'signal', 'slope', round(regr_slope(x, idx), 5) FROM rec GROUP BY pid
UNION ALL SELECT pid, 'extremes', stat, round(value, 5) FROM el UNION ALL SELECT pid, 'beyond ' || side || ' ' || factor, 'time', round(sum(d), 5) FROM bt GROUP BY pid, side, factor
UNION ALL SELECT pid, 'peaks ' || side || ' ' || factor, 'n_peaks', n_peaks::DOUBLE FROM pk UNION ALL SELECT pid, 'peaks ' || side || ' ' || factor, 'per_second', round(n_peaks / nullif(span, 0), 5) FROM pk
UNION ALL SELECT pid, 'decay', side, round(value, 5) FROM dec WHERE value IS NOT NULL UNION ALL SELECT pid, 'gaps ' || side, stat, value FROM ({thirteen('gaps', 'pid, side')})""",
)
rec(
    "agg_ts_domain",
    lambda r: B.time_domain(r, KEY),
    """, c AS (SELECT pid, x, avg(x) OVER p AS m, min(x) OVER p AS lo, max(x) OVER p AS hi, lag(x) OVER (PARTITION BY pid ORDER BY idx) AS b FROM rec WINDOW p AS (PARTITION BY pid)),
s AS (SELECT pid, sum(x * x) AS energy, count(*) FILTER ((x - m) * (b - m) < 0) AS zero_crossings, sum((x - m) * (b - m)) / nullif(sum((x - m) * (x - m)), 0) AS autocorrelation FROM c GROUP BY pid),
n AS (SELECT pid, CASE WHEN hi > lo THEN least(9, floor((x - lo) / (hi - lo) * 10)) ELSE 0 END AS bin, count(*) AS k FROM c GROUP BY ALL),
e AS (SELECT pid, -sum(k / t * ln(k / t)) AS entropy FROM (SELECT *, sum(k) OVER (PARTITION BY pid) AS t FROM n) GROUP BY pid)
SELECT pid, round(energy, 5) AS energy, zero_crossings, round(autocorrelation, 5) AS autocorrelation, round(entropy, 5) AS entropy FROM s JOIN e USING (pid)""",
)
