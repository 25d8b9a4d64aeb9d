"""Queries over recordings: cleaning, resampling, segments, derivatives and segment statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quaternion as Q
from ..operators import motion as M
from ..operators import resample as R
from ..operators import segments as G
from ..operators import statistics as S
from .frames import OBJECT_ROWS, PATH, RECORDING, objects, path, recording

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
KEY = ["pid"]


def rounded(df, digits: int = 6):
    """Doubles to a number of digits, so that two engines' last bits agree."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def rec(name: str, body, sql: str | None = None, digits: int = 6) -> None:
    add(name, lambda spark, d: rounded(body(recording(spark, d)), digits), f"WITH {RECORDING} {sql}" if sql else None)


def pts(name: str, body, sql: str | None = None, digits: int = 6) -> None:
    add(name, lambda spark, d: rounded(body(path(spark, d)), digits), f"WITH {PATH} {sql}" if sql else None)


# -- statistics of a session ------------------------------------------------------------------------------------
STAT_SQL = {
    "cv": "stddev_pop(x) / avg(x)",
    "slope": "regr_slope(x, idx)",
    "mean": "avg(x)",
    "median": "median(x)",
    "std": "stddev_pop(x)",
    "var": "var_pop(x)",
    "skew": "skewness(x) * (count(x) - 2) / sqrt(count(x) * (count(x) - 1.0))",
    "kurtosis": "kurtosis_pop(x)",
    "iqr": "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)",
    "range": "max(x) - min(x)",
    "min": "min(x)",
    "max": "max(x)",
    "sum": "sum(x)",
}
for _stat, _sql in STAT_SQL.items():
    rec(f"agg_{_stat}", lambda r, s=_stat: S.describe(r, KEY, names=[s]).select("pid", "value"), f"SELECT pid, round({_sql}, 6) AS value FROM rec GROUP BY pid")
_all = " UNION ALL ".join(f"SELECT pid, '{s}' AS stat, round({q}, 6) AS value FROM rec GROUP BY pid" for s, q in STAT_SQL.items())
rec("agg_basic", lambda r: S.describe(r, KEY), _all)
rec("seg_session", lambda r: r.groupBy("pid").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("n")), "SELECT pid, round(min(t), 6) AS start_t, round(max(t), 6) AS end_t, count(*) AS n FROM rec GROUP BY pid")

# -- cleaning -----------------------------------------------------------------------------------------------------
HANDS = "tr AS (SELECT *, least(min(CASE WHEN kind = 'error' THEN idx END) OVER (PARTITION BY pid), min(CASE WHEN kind = 'signup' AND pid % 3 > 0 THEN idx END) OVER (PARTITION BY pid)) AS s FROM rec)"
rec("flt_truncate_start", lambda r: R.truncate_start(r, KEY, F.col("kind") == "error", (F.col("kind") == "signup") & (F.col("pid") % 3 > 0)).select("pid", "idx", "t"), f", {HANDS} SELECT pid, idx - s AS idx, round(t, 6) AS t FROM tr WHERE idx >= s")
rec("flt_dedup_ts", lambda r: R.dedup_time(r.withColumn("t", F.floor(F.col("t") / 3600).cast("double")), KEY).select("pid", "idx", "t"), ", h AS (SELECT pid, idx, floor(t / 3600) AS t FROM rec) SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY min(idx)) - 1 AS idx, t FROM h GROUP BY pid, t")
rec("rsm_round", lambda r: r.select("pid", "idx", F.round("x", 1).alias("x")), "SELECT pid, idx, round(x, 1) AS x FROM rec")
rec("flt_drop_nulls", lambda r: r.withColumn("x", F.when(F.col("x") > 5, F.col("x"))).na.drop().groupBy("pid").agg(F.count("*").alias("n")), "SELECT pid, count(*) AS n FROM rec WHERE x > 5 GROUP BY pid")
pts("prj_drop_pattern", lambda p: R.drop_columns(p, "q").groupBy("pid").agg(F.sum("px").alias("sx")), "SELECT pid, round(sum(px), 6) AS sx FROM pt GROUP BY pid")
pts("prj_keep_pattern", lambda p: R.keep_columns(p, ["py", "pz", "qw"], ("pid", "t")), "SELECT pid, round(t, 6) AS t, round(py, 6) AS py, round(pz, 6) AS pz, round(qw, 6) AS qw FROM pt")
LAST_PLACE = "ceil((t1 - t0) / {step} - 1e-9)::BIGINT"
GRID = f", g AS (SELECT pid, min(t) AS t0, max(t) AS t1 FROM rec GROUP BY pid), grid AS (SELECT pid, t0, unnest(range(0, {LAST_PLACE.format(step=600)} + 1)) AS k FROM g)"
rec("rsm_grid", lambda r: R.grid(r, KEY, 600.0).select("pid", "k", "t"), f"{GRID} SELECT pid, k, round(t0 + k * 600.0, 6) AS t FROM grid")
JOINED = f"{GRID}, j AS (SELECT grid.pid, k, round((t0 + k * 600.0) / 600)::BIGINT * 600.0 AS t, idx, x FROM grid LEFT JOIN rec ON rec.pid = grid.pid AND round((t0 + k * 600.0) / 600)::BIGINT = round(rec.t / 600)::BIGINT)"
rec("rsm_left_join", lambda r: R.left_join_grid(r.drop("kind"), KEY, 600.0, 600).withColumn("idx", F.coalesce("idx", F.lit(-1))), f"{JOINED} SELECT pid, k, t, coalesce(idx, -1) AS idx, round(x, 6) AS x FROM j")
#: Gaps of x in {source}, in rows numbered r, on the straight line between the rows around.
FILLED = """f{n} AS (SELECT *, max(CASE WHEN {x} IS NOT NULL THEN r END) OVER (PARTITION BY pid ORDER BY r) AS r0, min(CASE WHEN {x} IS NOT NULL THEN r END) OVER (PARTITION BY pid ORDER BY r DESC) AS r1 FROM {source}),
i{n} AS (SELECT f.* REPLACE (CASE WHEN f.{x} IS NOT NULL THEN f.{x} ELSE a.{x} + (c.{x} - a.{x}) * (f.r - f.r0) / (f.r1 - f.r0) END AS {x})
  FROM f{n} f LEFT JOIN {source} a ON a.pid = f.pid AND a.r = f.r0 LEFT JOIN {source} c ON c.pid = f.pid AND c.r = f.r1)"""
NUMBERED = "jr AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY k, idx NULLS FIRST) AS r FROM j)"
rec("rsm_interpolate", lambda r: R.filled_grid(r.drop("kind"), KEY, 600.0, 600, ("x",), ("idx",)).select("pid", "k", F.coalesce("idx", F.lit(-1)).alias("idx"), "x"), f"{JOINED}, {NUMBERED}, {FILLED.format(n=1, x='x', source='jr')} SELECT pid, k, coalesce(idx, -1) AS idx, round(x, 6) AS x FROM i1")


def chain(r):
    """The way of a recording from its raw rows to a derivative: truncated, one row a time, resampled, sessions that are too short
    or repeat a time left out, velocity."""
    started = R.truncate_start(r, KEY, F.col("kind") == "error", F.col("kind") == "signup")
    whole = R.dedup_time(started.withColumn("t", F.floor(F.col("t") / 60) * 60.0), KEY)
    kept, _ = M.checked(R.resampled(whole, KEY, 600.0, ("x",), 60), KEY, 2)
    return M.velocity(kept, KEY, "x", 2)


CHAIN = f""", h0 AS (SELECT *, least(min(CASE WHEN kind = 'error' THEN idx END) OVER (PARTITION BY pid), min(CASE WHEN kind = 'signup' THEN idx END) OVER (PARTITION BY pid)) AS s FROM rec),
h1 AS (SELECT pid, idx, floor(t / 60) * 60.0 AS t, x FROM h0 WHERE idx >= s), h2 AS (SELECT pid, t, min(idx) AS idx, arg_min(x, idx) AS x FROM h1 GROUP BY pid, t),
g AS (SELECT pid, min(t) AS t0, max(t) AS t1 FROM h2 GROUP BY pid), grid AS (SELECT pid, t0 + k * 600.0 AS gt, k FROM (SELECT pid, t0, unnest(range(0, {LAST_PLACE.format(step=600)} + 1)) AS k FROM g)),
j AS (SELECT grid.pid, k, round(gt / 60)::BIGINT * 60.0 AS t, idx, x FROM grid LEFT JOIN h2 ON h2.pid = grid.pid AND round(gt / 60)::BIGINT = round(h2.t / 60)::BIGINT), {NUMBERED}, {FILLED.format(n=1, x='x', source='jr')},
c0 AS (SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY k, idx NULLS FIRST) - 1 AS idx, t, round(x, 6) AS x FROM i1 WHERE x IS NOT NULL), c1 AS (SELECT *, count(*) OVER (PARTITION BY pid) AS n FROM c0),
cv AS (SELECT pid, idx, t, x, n, CASE WHEN idx < 2 THEN (lead(x, 2) OVER w - x) / (lead(t, 2) OVER w - t) WHEN idx >= n - 2 THEN (x - lag(x, 2) OVER w) / (t - lag(t, 2) OVER w) ELSE (lead(x, 2) OVER w - lag(x, 2) OVER w) / (lead(t, 2) OVER w - lag(t, 2) OVER w) END AS v
  FROM c1 WINDOW w AS (PARTITION BY pid ORDER BY idx))"""
rec("rsm_chain", chain, f"{CHAIN} SELECT pid, idx, t, round(x, 6) AS x, round(v, 6) AS v FROM cv WHERE n >= 4")
rec(
    "kin_rejected",
    lambda r: M.checked(r.withColumn("t", F.floor(F.col("t") / 3600) * 3600.0).filter("pid % 2 = 0 OR idx < 20"), KEY, 12)[1].unionByName(M.checked(r.filter("idx < 30"), KEY, 15)[1]),
    """, q AS (SELECT pid, idx, floor(t / 3600) * 3600.0 AS t FROM rec WHERE pid % 2 = 0 OR idx < 20), b AS (SELECT pid, t <= lag(t) OVER (PARTITION BY pid ORDER BY idx) AS still FROM q),
s AS (SELECT pid, count(*) AS n, coalesce(bool_or(still), false) AS still FROM b GROUP BY pid), b2 AS (SELECT pid, t <= lag(t) OVER (PARTITION BY pid ORDER BY idx) AS still FROM rec WHERE idx < 30),
s2 AS (SELECT pid, count(*) AS n, coalesce(bool_or(still), false) AS still FROM b2 GROUP BY pid)
SELECT pid, CASE WHEN n < 24 THEN 'too short' ELSE 'repeated time' END AS reason, n FROM s WHERE n < 24 OR still UNION ALL SELECT pid, CASE WHEN n < 30 THEN 'too short' ELSE 'repeated time' END, n FROM s2 WHERE n < 30 OR still""",
)

# -- segments and nearest joins -----------------------------------------------------------------------------------
#: Seconds of a chunk of the event table, whose rows lie hours apart.
SPAN = 86_400.0
LOG = ", lg AS (SELECT pid, idx AS event_idx, t AS event_t, row_number() OVER (PARTITION BY pid ORDER BY idx) - 1 AS step FROM rec WHERE kind = 'purchase'), smp AS (SELECT * FROM rec WHERE kind <> 'purchase')"
NEAREST = f"""{LOG}, c AS (SELECT lg.pid, step, event_t, smp.idx, abs(smp.t - event_t) AS gap,
  row_number() OVER (PARTITION BY lg.pid, step ORDER BY abs(smp.t - event_t), smp.idx) AS rn FROM lg JOIN smp USING (pid)), near AS (SELECT pid, step, event_t, idx FROM c WHERE rn = 1)"""
rec("jn_asof_nearest", lambda r: G.nearest(G.event_log(r), G.samples(r), KEY, SPAN).select("pid", "step", "idx"), f"{NEAREST} SELECT pid, step, idx FROM near")
STEPS = f"{NEAREST}, seg AS (SELECT pid, step, coalesce(lag(idx) OVER (PARTITION BY pid ORDER BY step), (SELECT min(idx) FROM smp WHERE smp.pid = near.pid)) AS start_idx, idx AS end_idx FROM near)"
rec("seg_step", lambda r: G.steps(r, SPAN).select("pid", "step", "start_idx", "end_idx"), f"{STEPS} SELECT pid, step, start_idx, end_idx FROM seg")
rec("jn_interval", lambda r: G.interval(G.samples(r), G.steps(r, SPAN), KEY).groupBy("pid", "step").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x")), f"{STEPS} SELECT pid, step, count(*) AS n, round(sum(x), 6) AS sum_x FROM seg JOIN smp USING (pid) WHERE idx >= start_idx AND idx < end_idx GROUP BY pid, step")
NEST = """, l0 AS (SELECT pid, idx, t, kind, coalesce(sum((kind = 'purchase')::INT) OVER (PARTITION BY pid ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS step FROM rec WHERE kind IN ('purchase', 'error')),
l1 AS (SELECT *, row_number() OVER (PARTITION BY pid, step ORDER BY idx) - 1 AS sub, row_number() OVER (PARTITION BY pid ORDER BY idx) - 1 AS r, count(*) OVER (PARTITION BY pid, step) AS m FROM l0),
sm AS (SELECT pid, row_number() OVER (PARTITION BY pid ORDER BY idx) - 1 AS idx, t, x FROM rec WHERE kind NOT IN ('purchase', 'error')),
nr AS (SELECT l1.pid, l1.r, sm.idx AS near, row_number() OVER (PARTITION BY l1.pid, l1.r ORDER BY abs(sm.t - l1.t), sm.idx) AS k FROM l1 JOIN sm USING (pid)),
l2 AS (SELECT l1.*, near FROM l1 JOIN nr ON nr.pid = l1.pid AND nr.r = l1.r AND nr.k = 1),
se AS (SELECT pid, step, arg_max(near, struct_pack(t := t, k := -r)) AS e FROM l2 GROUP BY pid, step),
sp AS (SELECT pid, step, coalesce(lag(e) OVER (PARTITION BY pid ORDER BY step), 0) AS s, e FROM se),
ns AS (SELECT l2.pid, l2.step, sub, r AS sub_id, m * l2.step + sub AS ref_id, kind, s, e, coalesce(lag(near) OVER (PARTITION BY l2.pid, l2.step ORDER BY r), s) AS f, near FROM l2 JOIN sp USING (pid, step)),
nest AS (SELECT pid, step, sub, sub_id, ref_id, kind, s AS step_start, e AS step_end, CASE WHEN s >= e THEN s ELSE least(greatest(f, s), e - 1) END AS start_idx, CASE WHEN s >= e THEN s ELSE least(greatest(near, s), e - 1) END AS end_idx FROM ns)"""


def two_levels(r):
    return G.nested(G.substep_log(r), G.stream(r), KEY, SPAN)


rec("seg_substep", lambda r: two_levels(r).drop("event_t"), f"{NEST} SELECT * FROM nest")
TYPES = ("purchase", "error")
NEAR_EVENT = """, ex AS (SELECT pid, 'max' AS side, arg_max(t, struct_pack(x := x, k := -idx)) AS extreme_t FROM rec GROUP BY pid UNION ALL SELECT pid, 'min', arg_max(t, struct_pack(x := -x, k := -idx)) FROM rec GROUP BY pid),
cn AS (SELECT pid, side, extreme_t, step, r, kind, row_number() OVER (PARTITION BY pid, side ORDER BY abs(t - extreme_t), r) AS k FROM ex JOIN l1 USING (pid))"""
rec(
    "seg_nearest_event",
    lambda r: G.event_at_extremum(r, G.substep_log(r)).withColumn("code", G.type_code(F.col("kind"), TYPES)),
    f"{NEST}{NEAR_EVENT} SELECT pid, side, round(extreme_t, 6) AS extreme_t, step, r AS substep, kind, (kind = 'error')::INT AS code FROM cn WHERE k = 1",
)
rec("seg_type_code", lambda r: r.select("pid", "idx", G.type_code(F.col("kind"), ("click", "view", "purchase", "error", "signup")).alias("code")), "SELECT pid, idx, list_position(['click', 'view', 'purchase', 'error', 'signup'], kind) - 1 AS code FROM rec")
RUNS = "m AS (SELECT *, (kind = 'click')::INT AS on_ FROM rec), ch AS (SELECT *, (on_ <> coalesce(lag(on_) OVER w, -1))::INT AS c FROM m WINDOW w AS (PARTITION BY pid ORDER BY idx)), isl AS (SELECT *, sum(c) OVER (PARTITION BY pid ORDER BY idx) AS run FROM ch)"
rec("seg_runs", lambda r: S.runs(r, KEY, F.col("kind") == "click").select("pid", "start_idx", "n"), f", {RUNS} SELECT pid, min(idx) AS start_idx, count(*) AS n FROM isl WHERE on_ = 1 GROUP BY pid, run")
# -- extrema, peaks, pauses --------------------------------------------------------------------------------------------
EXT = "e AS (SELECT pid, max(x) AS max_x, arg_max(t, struct_pack(x := x, k := -idx)) AS max_t, arg_max(idx, struct_pack(x := x, k := -idx)) AS max_idx, min(x) AS min_x, arg_max(t, struct_pack(x := -x, k := -idx)) AS min_t, min(t) AS start_t, max(t) AS end_t, avg(x) + stddev_pop(x) AS thr FROM rec GROUP BY pid)"
rec("agg_extremum", lambda r: S.extremum(r, KEY).select("pid", "max_x", "max_t", "min_x", "min_t", F.try_divide(F.col("max_t") - F.col("start_t"), F.col("end_t") - F.col("start_t")).alias("max_share")), f", {EXT} SELECT pid, round(max_x, 6) AS max_x, round(max_t, 6) AS max_t, round(min_x, 6) AS min_x, round(min_t, 6) AS min_t, round((max_t - start_t) / (end_t - start_t), 6) AS max_share FROM e")
rec("agg_time_to_ext", lambda r: S.extremum(r, KEY).select("pid", (F.col("max_t") - F.col("start_t")).alias("to_max"), (F.col("min_t") - F.col("start_t")).alias("to_min")), f", {EXT} SELECT pid, round(max_t - start_t, 6) AS to_max, round(min_t - start_t, 6) AS to_min FROM e")
BEYOND = """, f AS (SELECT *, avg(x) OVER (PARTITION BY pid) AS m, stddev_pop(x) OVER (PARTITION BY pid) AS s FROM rec),
z AS (SELECT f.*, factor, side, (CASE WHEN side = 'above' THEN x > m + factor * s ELSE x < m - factor * s END)::INT AS on_ FROM f, (VALUES (1.0::DOUBLE), (1.5), (2.0), (3.0)) a(factor), (VALUES ('above'), ('below')) b(side)),
ch AS (SELECT *, (on_ <> coalesce(lag(on_) OVER w, -1))::INT AS c FROM z WINDOW w AS (PARTITION BY pid, factor, side ORDER BY idx)), isl AS (SELECT *, sum(c) OVER (PARTITION BY pid, factor, side ORDER BY idx) AS run FROM ch),
d AS (SELECT pid, side, factor, max(t) - min(t) AS d FROM isl WHERE on_ = 1 GROUP BY pid, side, factor, run)
SELECT pid, side, factor, round(sum(d), 6) AS value FROM d GROUP BY pid, side, factor"""
rec("agg_dur_beyond", lambda r: S.time_beyond(r, KEY), BEYOND)
rec("agg_dist_1d", lambda r: r.withColumn("d", F.abs(F.col("x") - S.previous("x", KEY))).groupBy("pid").agg(F.sum("d").alias("value")), ", d AS (SELECT pid, abs(x - lag(x) OVER (PARTITION BY pid ORDER BY idx)) AS d FROM rec) SELECT pid, round(sum(d), 6) AS value FROM d GROUP BY pid")

# -- derivatives -----------------------------------------------------------------------------------------------------
W = "WINDOW w AS (PARTITION BY pid ORDER BY idx)"
rec("kin_lag_diff", lambda r: r.select("pid", "idx", M.lag_difference("x", KEY).alias("v")), f"SELECT pid, idx, round((x - lag(x) OVER w) / nullif(t - lag(t) OVER w, 0), 6) AS v FROM rec {W}")
VEL = """, v AS (SELECT pid, idx, px, t, count(*) OVER (PARTITION BY pid) AS n, lag(px, 2) OVER w AS xb, lead(px, 2) OVER w AS xf, lag(t, 2) OVER w AS tb, lead(t, 2) OVER w AS tf FROM pt WINDOW w AS (PARTITION BY pid ORDER BY idx)),
vel AS (SELECT *, CASE WHEN idx < 2 THEN (xf - px) / (tf - t) WHEN idx >= n - 2 THEN (px - xb) / (t - tb) ELSE (xf - xb) / (tf - tb) END AS v FROM v WHERE n >= 4)"""
pts("kin_lin_vel", lambda p: M.velocity(p, KEY, "px", 2, stride=3).select("pid", "idx", "v"), f"{VEL}, an AS (SELECT *, CASE WHEN idx < 2 THEN 0 WHEN idx >= n - 2 THEN n - 2 ELSE 2 END AS s0 FROM vel), hd AS (SELECT *, s0 + ((idx - s0) // 3) * 3 AS a FROM an) SELECT pid, idx, round(first_value(v) OVER (PARTITION BY pid, a ORDER BY idx), 6) AS v FROM hd")
ACC = """, s AS (SELECT pid, idx, t, count(*) OVER (PARTITION BY pid) AS n, lag(px, 2) OVER w AS b2, lag(px, 1) OVER w AS b1, px AS c, lead(px, 1) OVER w AS f1, lead(px, 2) OVER w AS f2 FROM pt WINDOW w AS (PARTITION BY pid ORDER BY idx)),
acc AS (SELECT pid, idx, t, n, CASE WHEN idx < 1 THEN (c - 2 * f1 + f2) ELSE CASE WHEN idx >= n - 1 THEN (b2 - 2 * b1 + c) ELSE (b1 - 2 * c + f1) END END * 100 AS a FROM s WHERE n > 2)"""
_held = "first_value({c}) OVER (PARTITION BY pid, s0 + ((idx - s0) // 3) * 3 ORDER BY idx)"
_start = "CASE WHEN idx < 1 THEN 0 WHEN idx >= n - 1 THEN n - 1 ELSE 1 END AS s0"
pts("kin_lin_acc", lambda p: M.acceleration(p, KEY, "px", 1, stride=3).select("pid", "idx", "a"), f"{ACC}, hd AS (SELECT *, {_start} FROM acc) SELECT pid, idx, round({_held.format(c='a')}, 5) AS a FROM hd", 5)
JERK = f"{ACC}, jj AS (SELECT *, lag(a) OVER w AS ab, lead(a) OVER w AS af FROM acc WINDOW w AS (PARTITION BY pid ORDER BY idx)), jk AS (SELECT pid, idx, {_start}, CASE WHEN idx < 1 THEN (af - a) * 10 WHEN idx >= n - 1 THEN (a - ab) * 10 ELSE (af - ab) * 5 END AS j FROM jj)"
pts("kin_lin_jerk", lambda p: M.jerk(p, KEY, "px", 1, stride=3).select("pid", "idx", "j"), f"{JERK} SELECT pid, idx, round({_held.format(c='j')}, 4) AS j FROM jk", 4)
pts("kin_magnitude", lambda p: p.select("pid", "idx", F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2).alias("m")), "SELECT pid, idx, round(sqrt(px * px + py * py + pz * pz), 6) AS m FROM pt")
#: Slope and curve of the quadratic through five samples, at the row or the nearest row with a whole window.
SG_U = """u AS (SELECT pid, idx, count(*) OVER (PARTITION BY pid) AS n, t, lag(t) OVER w AS t0, lead(t) OVER w AS t1,
  (-2 * lag({x}, 2) OVER w - lag({x}, 1) OVER w + lead({x}, 1) OVER w + 2 * lead({x}, 2) OVER w) / 10.0 AS b,
  (5 * (4 * lag({x}, 2) OVER w + lag({x}, 1) OVER w + lead({x}, 1) OVER w + 4 * lead({x}, 2) OVER w)
    - 10 * (lag({x}, 2) OVER w + lag({x}, 1) OVER w + {x} + lead({x}, 1) OVER w + lead({x}, 2) OVER w)) / 70.0 AS c
  FROM {source} WINDOW w AS (PARTITION BY pid ORDER BY idx)),
sg AS (SELECT a.pid, a.idx, m.b + 2 * m.c * (a.idx - m.idx) AS sg,
  (coalesce(a.t1, a.t) - coalesce(a.t0, a.t)) / CASE WHEN a.t0 IS NULL OR a.t1 IS NULL THEN 1.0 ELSE 2.0 END AS dt
  FROM u a JOIN u m ON m.pid = a.pid AND m.idx = least(greatest(a.idx, 2), a.n - 3) WHERE a.n >= 5)"""
pts(
    "kin_sg_linear",
    lambda p: M.savitzky_golay(p, KEY, "px").select("pid", "idx", "sg"),
    f", {SG_U.format(x='px', source='pt')} SELECT pid, idx, round(sg / dt, 6) AS sg FROM sg",
)
pts("kin_ang_vel", lambda p: M.angular_velocity(p, KEY).select("pid", "idx", F.sqrt(F.col("wx") ** 2 + F.col("wy") ** 2 + F.col("wz") ** 2).alias("rate")), """, z AS (SELECT *, count(*) OVER (PARTITION BY pid) AS n FROM pt),
e AS (SELECT a.pid, a.idx, b.t - c.t AS dt, abs(b.qx * c.qx + b.qy * c.qy + b.qz * c.qz + b.qw * c.qw) AS d FROM z a JOIN z b ON b.pid = a.pid AND b.idx = least(a.idx + 1, a.n - 1) JOIN z c ON c.pid = a.pid AND c.idx = greatest(a.idx - 1, 0))
SELECT pid, idx, round(2 * acos(least(1.0, d)) / dt, 5) AS rate FROM e""", 5)
#: Rotation vectors from row c to row b over their time, the quaternion of the shorter way.
TURN = """d AS (SELECT pid, idx, n, t, dt, cw * bw + cx * bx + cy * by_ + cz * bz AS w,
  cw * bx - cx * bw - cy * bz + cz * by_ AS x, cw * by_ - cy * bw - cz * bx + cx * bz AS y, cw * bz - cz * bw - cx * by_ + cy * bx AS z FROM e),
g AS (SELECT *, sqrt(x * x + y * y + z * z) AS s FROM d),
wv AS (SELECT pid, idx, n, t, CASE WHEN s < 1e-12 THEN 2 ELSE sign(w + 1e-300) * 2 * atan2(s, abs(w)) / s END / dt * x AS wx,
  CASE WHEN s < 1e-12 THEN 2 ELSE sign(w + 1e-300) * 2 * atan2(s, abs(w)) / s END / dt * y AS wy,
  CASE WHEN s < 1e-12 THEN 2 ELSE sign(w + 1e-300) * 2 * atan2(s, abs(w)) / s END / dt * z AS wz FROM g)"""
SIDES = "b.qx AS bx, b.qy AS by_, b.qz AS bz, b.qw AS bw, c.qx AS cx, c.qy AS cy, c.qz AS cz, c.qw AS cw"
ANGULAR = f""", z AS (SELECT *, count(*) OVER (PARTITION BY pid) AS n FROM pt),
e AS (SELECT a.pid, a.idx, a.n, a.t, b.t - c.t AS dt, {SIDES} FROM z a JOIN z b ON b.pid = a.pid AND b.idx = least(a.idx + 1, a.n - 1) JOIN z c ON c.pid = a.pid AND c.idx = greatest(a.idx - 1, 0)),
{TURN}"""
#: Three-point second differences and one-step slopes at 0.1 seconds a sample.
ACC3 = "CASE WHEN idx < 1 THEN {c} - 2 * lead({c}) OVER w + lead({c}, 2) OVER w WHEN idx >= n - 1 THEN lag({c}, 2) OVER w - 2 * lag({c}) OVER w + {c} ELSE lag({c}) OVER w - 2 * {c} + lead({c}) OVER w END * 100"
SLOPE = "CASE WHEN idx < 1 THEN (lead({c}) OVER w - {c}) * 10 WHEN idx >= n - 1 THEN ({c} - lag({c}) OVER w) * 10 ELSE (lead({c}) OVER w - lag({c}) OVER w) * 5 END"
ORDERED = "WINDOW w AS (PARTITION BY pid ORDER BY idx)"
ANGULAR_ACC = f"{ANGULAR}, aa AS (SELECT pid, idx, n, {', '.join(ACC3.format(c=f'w{c}') + f' AS a{c}' for c in 'xyz')} FROM wv {ORDERED})"


def angular(p, derive, name: str):
    """``derive`` applied to the three components of the angular velocity."""
    out = M.angular_velocity(p, KEY)
    for c in "xyz":
        out = derive(out, KEY, f"w{c}", out=f"{name}{c}")
    return out.select("pid", "idx", *(f"{name}{c}" for c in "xyz"))


pts("kin_ang_acc", lambda p: angular(p, M.acceleration, "a"), f"{ANGULAR_ACC} SELECT pid, idx, {', '.join(f'round(a{c}, 4) AS a{c}' for c in 'xyz')} FROM aa", 4)
pts("kin_ang_jerk", lambda p: angular(p, M.jerk, "j"), f"{ANGULAR_ACC} SELECT pid, idx, {', '.join(f'round({SLOPE.format(c=f'a{c}')}, 3) AS j{c}' for c in 'xyz')} FROM aa {ORDERED}", 3)
RATE = f""", e AS (SELECT b.pid, b.idx - 1 AS idx, 0 AS n, b.t, b.t - c.t AS dt, {SIDES} FROM pt b JOIN pt c ON c.pid = b.pid AND c.idx = b.idx - 1), {TURN}"""
pts(
    "kin_sg_angular",
    lambda p: M.smoothed_rate(p, KEY).select("pid", "idx", F.col("sx").alias("sg")),
    f"{RATE}, {SG_U.format(x='wx', source='wv')} SELECT pid, idx + 1 AS idx, round(sg, 5) AS sg FROM sg UNION ALL SELECT pid, 0, round(sg, 5) FROM sg WHERE idx = 0",
    5,
)
own_q = lambda p: M.quaternion(p).withColumn("b", S.previous("q", KEY))
PAIRQ = ", z AS (SELECT *, lag(qx) OVER w AS bx, lag(qy) OVER w AS by_, lag(qz) OVER w AS bz, lag(qw) OVER w AS bw FROM pt WINDOW w AS (PARTITION BY pid ORDER BY idx)), g AS (SELECT pid, idx, CASE WHEN bw IS NOT NULL THEN 2 * acos(least(1.0, abs(qx * bx + qy * by_ + qz * bz + qw * bw))) END AS g FROM z)"
pts("kin_geodesic", lambda p: own_q(p).select("pid", "idx", Q.geodesic(F.col("q"), F.col("b")).alias("g")), f"{PAIRQ} SELECT pid, idx, round(g, 6) AS g FROM g")
pts("kin_rel_angle", lambda p: own_q(p).select("pid", "idx", Q.relative_angle(F.col("b"), F.col("q")).alias("g")), f"{PAIRQ} SELECT pid, idx, round(g, 5) AS g FROM g", 5)
pts("kin_axis_angle", lambda p: M.quaternion(p).select("pid", "idx", Q.axis_angle(F.col("q")).alias("a")).select("pid", "idx", "a.angle", "a.x"), "SELECT pid, idx, round(2 * atan2(sqrt(qx * qx + qy * qy + qz * qz), qw), 6) AS angle, round(qx / sqrt(qx * qx + qy * qy + qz * qz), 6) AS x FROM pt")
pts("kin_euler", lambda p: M.quaternion(p).select("pid", "idx", Q.euler(F.col("q")).alias("e")).select("pid", "idx", "e.x", "e.y", "e.z"), "SELECT pid, idx, round(degrees(atan2(2 * (qw * qx + qy * qz), 1 - 2 * (qx * qx + qy * qy))), 5) AS x, round(degrees(asin(greatest(-1.0, least(1.0, 2 * (qw * qy - qz * qx))))), 5) AS y, round(degrees(atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))), 5) AS z FROM pt", 5)
pts("kin_slerp", lambda p: own_q(p).filter("b IS NOT NULL").select("pid", "idx", Q.slerp(F.col("b"), F.col("q"), F.lit(0.5)).alias("s")).select("pid", "idx", "s.x", "s.w"), ", z AS (SELECT *, lag(qx) OVER w AS bx, lag(qy) OVER w AS by_, lag(qz) OVER w AS bz, lag(qw) OVER w AS bw FROM pt WINDOW w AS (PARTITION BY pid ORDER BY idx)), s AS (SELECT *, CASE WHEN qx * bx + qy * by_ + qz * bz + qw * bw < 0 THEN -1 ELSE 1 END AS g FROM z WHERE bw IS NOT NULL), m AS (SELECT pid, idx, bx + g * qx AS x, by_ + g * qy AS y, bz + g * qz AS z, bw + g * qw AS w FROM s) SELECT pid, idx, round(x / sqrt(x * x + y * y + z * z + w * w), 6) AS x, round(w / sqrt(x * x + y * y + z * z + w * w), 6) AS w FROM m")
pts("kin_adaptive_filter", lambda p: M.adaptive_filter(p, KEY))

# -- paths and rotations -----------------------------------------------------------------------------------------------
STEP3 = ", st AS (SELECT *, px - lag(px) OVER w AS dx, py - lag(py) OVER w AS dy, pz - lag(pz) OVER w AS dz FROM pt WINDOW w AS (PARTITION BY pid ORDER BY idx)), ln AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS s FROM st)"
pts("agg_dist_3d", lambda p: M.path_summary(p, KEY).select("pid", "total"), f"{STEP3} SELECT pid, round(sum(s), 6) AS total FROM ln GROUP BY pid")
pts("agg_bbox", lambda p: M.path_summary(p, KEY).select("pid", "box"), "SELECT pid, round((max(px) - min(px)) * (max(py) - min(py)) * (max(pz) - min(pz)), 6) AS box FROM pt GROUP BY pid")
pts("agg_path_eff", lambda p: M.path_summary(p, KEY).select("pid", "net", "total", "efficiency"), f"{STEP3}, q AS (SELECT pid, sum(s) AS total, sqrt((arg_max(px, idx) - arg_min(px, idx)) ** 2 + (arg_max(py, idx) - arg_min(py, idx)) ** 2 + (arg_max(pz, idx) - arg_min(pz, idx)) ** 2) AS net FROM ln GROUP BY pid) SELECT pid, round(net, 6) AS net, round(total, 6) AS total, round(net / total, 6) AS efficiency FROM q")
pts("agg_hull", lambda p: M.hull_volume(p, KEY))
TURNS = "tn AS (SELECT pid, idx, t, min(t) OVER (PARTITION BY pid) AS t0, dx * lag(dx) OVER w + dy * lag(dy) OVER w + dz * lag(dz) OVER w AS k FROM st WINDOW w AS (PARTITION BY pid ORDER BY idx))"
_turned = "SELECT pid, {window} AS seconds, count(*) FILTER (k < 0) AS n, round(count(*) FILTER (k < 0) / nullif(max(t) - min(t), 0), 6) AS per_second FROM tn {where} GROUP BY pid"
pts(
    "agg_reversals",
    lambda p: M.reversals(p, KEY).withColumn("seconds", F.lit(None).cast("double")).unionByName(M.reversals(p, KEY, 2.0).withColumn("seconds", F.lit(2.0))),
    f"{STEP3}, {TURNS} {_turned.format(window='NULL::DOUBLE', where='')} UNION ALL {_turned.format(window='2.0::DOUBLE', where='WHERE t <= t0 + 2.0')}",
)
pts("agg_opposing", lambda p: M.opposing(p, KEY), f"""{STEP3}, nx AS (SELECT *, lead(dx) OVER w AS nx, lead(dy) OVER w AS ny, lead(dz) OVER w AS nz FROM ln WINDOW w AS (PARTITION BY pid ORDER BY idx)),
tp AS (SELECT pid, arg_max(idx, struct_pack(s := coalesce(s, -1), k := -idx)) AS top, arg_max(px, struct_pack(s := coalesce(s, -1), k := -idx)) - arg_min(px, idx) AS ax, arg_max(py, struct_pack(s := coalesce(s, -1), k := -idx)) - arg_min(py, idx) AS ay, arg_max(pz, struct_pack(s := coalesce(s, -1), k := -idx)) - arg_min(pz, idx) AS az FROM ln GROUP BY pid),
al AS (SELECT pid, idx, top, (nx * ax + ny * ay + nz * az) / sqrt(ax * ax + ay * ay + az * az) AS a FROM nx JOIN tp USING (pid))
SELECT pid, round(coalesce(sum(CASE WHEN idx >= top AND a < 0 THEN -a END), 0), 6) AS value FROM al GROUP BY pid""")
pts("agg_rotation", lambda p: M.rotation_total(p, KEY), f"{PAIRQ} SELECT pid, round(sum(g), 6) AS value FROM g GROUP BY pid")
ALL_PAIRS = ", ps AS (SELECT a.pid, a.idx AS i, b.idx AS j, 2 * acos(least(1.0, abs(a.qx * b.qx + a.qy * b.qy + a.qz * b.qz + a.qw * b.qw))) AS angle FROM pt a JOIN pt b ON a.pid = b.pid AND a.idx < b.idx)"
pts("agg_quat_disp", lambda p: M.pair_dispersion(p, KEY), f"{ALL_PAIRS} SELECT pid, round(avg(angle), 6) AS value, count(*) AS n_pairs FROM ps GROUP BY pid")
pts("jn_pairs_self", lambda p: M.sample_pairs(p, KEY), f"{ALL_PAIRS} SELECT pid, i, j, round(angle, 6) AS angle FROM ps")
PAIRS = [("Head", "LeftHand"), ("Head", "RightHand"), ("LeftHand", "RightHand")]
_named = " OR ".join(f"(a.object = '{a}' AND b.object = '{b}')" for a, b in PAIRS)
_flat = ", ".join(f"struct_pack(axes := '{c}', x := abs(a.p{c[0]} - b.p{c[1]}))" for c in M.AXIS_PAIRS)
DISTANCES = f"""WITH {OBJECT_ROWS}, op AS (SELECT a.pid, a.idx, a.object || '-' || b.object AS pair, unnest([struct_pack(axes := 'xyz', x := sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2 + (a.pz - b.pz) ** 2)), {_flat}], recursive := true)
  FROM ob a JOIN ob b ON a.pid = b.pid AND a.idx = b.idx AND ({_named}))"""
_stats = lambda where: " UNION ALL ".join(f"SELECT pid, pair, axes, '{s}' AS stat, round({q}, 6) AS value FROM op WHERE axes {where} 'xyz' GROUP BY pid, pair, axes" for s, q in STAT_SQL.items())
distances = lambda spark, d: S.describe(M.object_pairs(objects(spark, d), KEY, PAIRS), ["pid", "pair", "axes"])
add("agg_pair_dist_3d", lambda spark, d: rounded(distances(spark, d).filter("axes = 'xyz'")), f"{DISTANCES} {_stats('=')}")
add("agg_pair_dist_1d", lambda spark, d: rounded(distances(spark, d).filter("axes != 'xyz'")), f"{DISTANCES} {_stats('<>')}")
