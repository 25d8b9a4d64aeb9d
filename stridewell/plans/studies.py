"""Queries over feature tables, predictions and designs: reshaping, screening, evaluation and tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import redundancy as V
from .frames import DESIGN, FEATURE_ROWS, FEATURES, PREDICTIONS, design, features, predictions, table
from .motion import rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TF = ["task", "feature"]


def add(name, frame, body, with_sql=None, sql=None, digits=6) -> None:
    QUERIES[name] = lambda spark, d: rounded(body(frame(spark, d)), digits)
    if sql:
        ORACLE_SQL[name] = f"WITH {with_sql} {sql}"


def feat(name, body, sql=None, digits=6):
    add(name, features, body, FEATURE_ROWS, sql, digits)


def pred(name, body, sql=None, digits=6):
    add(name, predictions, body, PREDICTIONS, sql, digits)


def dsg(name, body, sql=None, digits=6):
    add(name, design, body, DESIGN, sql, digits)


# -- cleaning and reshaping ------------------------------------------------------------------------------------------------
feat("jn_a_b_features", lambda f: f.filter("task = 'O'").select("pid", "feature", F.col("value").alias("a")).join(f.filter("task = 'F'").select("pid", "feature", F.col("value").alias("b")), ["pid", "feature"]), "SELECT o.pid, o.feature, round(o.value, 4) AS a, round(f.value, 4) AS b FROM feat o JOIN feat f USING (pid, feature) WHERE o.task = 'O' AND f.task = 'F'", 4)
feat("jn_semi_pid", lambda f: f.join(f.filter("y = 1").select("pid"), "pid", "left_semi").groupBy("feature").agg(F.count("*").alias("n")), "SELECT feature, count(*) AS n FROM feat WHERE pid IN (SELECT pid FROM feat WHERE y = 1) GROUP BY feature")
QUERIES["jn_left_label"] = lambda spark, d: table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
ORACLE_SQL["jn_left_label"] = "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels USING (doc_id)"
feat("rsh_pivot", lambda f: f.groupBy("pid", "task").pivot("feature", list(FEATURES)).agg(F.avg("value")), "SELECT pid, task, round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice, round(l_discount, 4) AS l_discount, round(l_tax, 4) AS l_tax FROM wide", 4)
feat("rsh_melt", lambda f: f.select("pid", "task", "feature", "value"), "SELECT pid, task, feature, round(value, 4) AS value FROM feat", 4)
feat("rsh_split_suffix", lambda f: f.select("pid", F.concat_ws("_", "feature", "task").alias("s")).select("pid", F.regexp_extract("s", "^(.*)_([^_]*)$", 1).alias("base"), F.regexp_extract("s", "^(.*)_([^_]*)$", 2).alias("suffix")), "SELECT pid, feature AS base, task AS suffix FROM feat")
pred("rsh_indicators", lambda p: p.select("label").distinct().select("label", F.col("label").contains("Head").cast("int").alias("has_head"), F.col("label").contains("linear").cast("int").alias("has_linear")), "SELECT DISTINCT label, contains(label, 'Head')::INT AS has_head, contains(label, 'linear')::INT AS has_linear FROM pred")

# -- screening (more in screens.py) ---------------------------------------------------------------------------------------------
feat("scr_rank_pair", lambda f: E.rank_pair(E.correlation(f, TF, "value", "y", "r"), "r"), ", r AS (SELECT task, feature, abs(covar_pop(value, y) / nullif(stddev_pop(value) * stddev_pop(y), 0)) AS r FROM feat GROUP BY ALL) SELECT o.feature, round(CASE WHEN o.r <= 0 OR f.r <= 0 THEN 0 ELSE 2 * o.r * f.r / (o.r + f.r) END, 5) AS score FROM r o JOIN r f USING (feature) WHERE o.task = 'O' AND f.task = 'F' AND o.r IS NOT NULL AND f.r IS NOT NULL", 5)
feat("jn_signif_intersect", lambda f: E.correlation(f, TF, "value", "y", "r").filter("task = 'O' AND abs(r) >= 0.01").select("feature").intersect(E.correlation(f, TF, "value", "y", "r").filter("task = 'F' AND abs(r) >= 0.01").select("feature")), ", r AS (SELECT task, feature, abs(covar_pop(value, y) / nullif(stddev_pop(value) * stddev_pop(y), 0)) AS r FROM feat GROUP BY ALL) SELECT feature FROM r WHERE task = 'O' AND r >= 0.01 INTERSECT SELECT feature FROM r WHERE task = 'F' AND r >= 0.01")
#: Columns of the feature table in their order.
PLACES = {c: k for k, c in enumerate(FEATURES)}


def redundancy(spark, d, folds: int = 0):
    f = features(spark, d)
    columns = spark.createDataFrame(list(PLACES.items()), "feature string, place int")  # as many rows as features
    dealt = f.select("pid", F.pmod("pid", F.lit(folds)).cast("int").alias("fold")).distinct() if folds else None
    return V.relevance_redundancy(f, 0.005, 0.05, 0.05, columns, dealt)


#: Pairs of relevant features, high by values or by average ranks, in the order of columns; then the rule pair by pair.
REDUNDANT = f"""WITH RECURSIVE {FEATURE_ROWS}, sc AS ({{scopes}}), pl AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {k})" for c, k in PLACES.items())}) t(feature, place)),
rk AS (SELECT scope, pid, task, y, feature, place, value, rank() OVER (PARTITION BY scope, feature ORDER BY value) + (count(*) OVER (PARTITION BY scope, feature, value) - 1) / 2 AS r FROM sc JOIN pl USING (feature)),
rl AS (SELECT scope, feature, place FROM rk GROUP BY ALL HAVING abs(covar_pop(value, y) / nullif(stddev_pop(value) * stddev_pop(y), 0)) >= 0.005),
rr AS (SELECT rk.* FROM rk JOIN rl USING (scope, feature, place)),
hp AS (SELECT a.scope, a.place AS i, b.place AS j FROM rr a JOIN rr b USING (scope, pid, task) WHERE a.place < b.place GROUP BY ALL
  HAVING abs(covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0)) > 0.05 OR abs(covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0)) > 0.05),
np AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY i, j) AS k FROM hp),
st AS (SELECT DISTINCT scope, 0::BIGINT AS k, []::INT[] AS dropped, []::INT[] AS chosen FROM rl UNION ALL
  SELECT st.scope, np.k, CASE WHEN list_contains(dropped, j) OR list_contains(chosen, i) THEN list_append(dropped, j) WHEN list_contains(dropped, i) OR list_contains(chosen, j) THEN list_append(dropped, i) ELSE list_append(dropped, j) END,
    CASE WHEN list_contains(dropped, j) OR list_contains(chosen, i) OR list_contains(dropped, i) OR list_contains(chosen, j) THEN chosen ELSE list_append(chosen, i) END
  FROM st JOIN np ON np.scope = st.scope AND np.k = st.k + 1)
SELECT scope, feature FROM rl WHERE NOT list_contains((SELECT arg_max(dropped, k) FROM st WHERE st.scope = rl.scope), place)"""
QUERIES["scr_rel_red"] = lambda spark, d: redundancy(spark, d)
ORACLE_SQL["scr_rel_red"] = REDUNDANT.format(scopes="SELECT -1 AS scope, * FROM feat")
QUERIES["scr_rel_red_folds"] = lambda spark, d: redundancy(spark, d, 4)
ORACLE_SQL["scr_rel_red_folds"] = REDUNDANT.format(scopes="SELECT s.scope, feat.* FROM feat JOIN (SELECT unnest(range(4))::INT AS scope) s ON pid % 4 <> s.scope")

# -- evaluation ---------------------------------------------------------------------------------------------------------------
PK = ["label", "fold", "task"]
CONF = ", cm AS (SELECT label, fold, task, count(*) FILTER (y = 0 AND yhat = 0) AS tn, count(*) FILTER (y = 0 AND yhat = 1) AS fp, count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 1 AND yhat = 1) AS tp FROM pred GROUP BY ALL)"
pred("met_confusion", lambda p: E.confusion(p, PK), f"{CONF} SELECT * FROM cm")
SENS, SPEC = "coalesce(tp / nullif(tp + fn, 0), 0)", "coalesce(tn / nullif(tn + fp, 0), 0)"
P1, P0 = "coalesce(tp / nullif(tp + fp, 0), 0)", "coalesce(tn / nullif(tn + fn, 0), 0)"
F1, F0 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", "coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)"
WEIGHED = lambda a, b: f"(({a}) * (tp + fn) + ({b}) * (tn + fp)) / (tp + tn + fp + fn)"
MCC = "coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0)"
METRIC_SQL = {"accuracy": "(tp + tn) / (tp + tn + fp + fn)", "balanced_accuracy": f"({SENS} + {SPEC}) / 2", "f1": WEIGHED(F1, F0), "precision": WEIGHED(P1, P0), "recall": WEIGHED(SENS, SPEC), "sensitivity": SENS, "specificity": SPEC, "mcc": MCC}
for _m, _q in METRIC_SQL.items():
    pred(f"met_{_m}", lambda p, m=_m: E.metrics(E.confusion(p, PK), PK).select(*PK, m), f'{CONF} SELECT label, fold, task, round({_q}, 6) AS "{_m}" FROM cm')
AB = f"{CONF}, s AS (SELECT label, fold, task, {MCC} AS mcc FROM cm), w AS (SELECT label, fold, max(CASE WHEN task = 'A' THEN mcc END) AS a, max(CASE WHEN task = 'B' THEN mcc END) AS b FROM s GROUP BY ALL), h AS (SELECT label, fold, CASE WHEN a <= 0 OR b <= 0 THEN least(a, b) ELSE 2 * a * b / (a + b) END AS mcc FROM w)"
crossed = lambda p: E.cross_task(E.metrics(E.confusion(p, PK), PK), ["label", "fold"], "mcc")
pred("mdl_objective", lambda p: crossed(p).groupBy("label").agg((F.avg("mcc") - 0.5 * F.stddev_pop("mcc")).alias("objective")), f"{AB} SELECT label, round(avg(mcc) - 0.5 * stddev_pop(mcc), 6) AS objective FROM h GROUP BY label")
pred("res_best_run", lambda p: crossed(p).groupBy("label").agg(F.max_by("fold", F.struct("mcc", -F.col("fold"))).alias("fold")), f"{AB} SELECT label, arg_max(fold, struct_pack(m := mcc, k := -fold)) AS fold FROM h GROUP BY label")
pred("res_drop_token", lambda p: p.filter(~F.col("label").contains("Head")).groupBy("label").agg(F.count("*").alias("n")), "SELECT label, count(*) AS n FROM pred WHERE NOT contains(label, 'Head') GROUP BY label")
pred("res_class_weight", lambda p: p.groupBy("task", "y").agg(F.count("*").alias("n")).select("task", "y", (F.sum("n").over(Window.partitionBy("task")) / (2 * F.col("n"))).alias("w")), ", n AS (SELECT task, y, count(*) AS n FROM pred GROUP BY ALL) SELECT task, y, round(sum(n) OVER (PARTITION BY task) / (2 * n), 6) AS w FROM n")
pred("res_participant_mean", lambda p: p.groupBy("pid", "label").agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("m")), "SELECT pid, label, round(avg((y = yhat)::INT), 6) AS m FROM pred GROUP BY ALL")
BIN = ", bn AS (SELECT pid AS subject, label || task AS condition, (avg((y = yhat)::INT) >= 0.5)::INT AS x FROM pred GROUP BY ALL)"
binary = lambda p: p.groupBy(F.col("pid").alias("subject"), F.concat("label", "task").alias("condition")).agg((F.avg((F.col("y") == F.col("yhat")).cast("double")) >= 0.5).cast("int").alias("x"))
DELTA = f", o AS (SELECT label, pid, count(*) FILTER (y = 0 AND yhat = 0) AS tn, count(*) FILTER (y = 0 AND yhat = 1) AS fp, count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 1 AND yhat = 1) AS tp FROM pred GROUP BY ALL), a AS (SELECT label, sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tp)::BIGINT AS tp FROM o GROUP BY label), w AS (SELECT label, {MCC} AS m FROM a), r AS (SELECT o.label, o.pid, a.tn - o.tn AS tn, a.fp - o.fp AS fp, a.fn - o.fn AS fn, a.tp - o.tp AS tp FROM o JOIN a USING (label)), z AS (SELECT label, pid, {MCC} AS m FROM r) SELECT label, pid, round(w.m - z.m, 6) AS delta FROM z JOIN w USING (label)"
pred("res_delta_mcc", lambda p: E.delta_mcc(p, ["label"]), DELTA)

# -- designs --------------------------------------------------------------------------------------------------------------------
RM = """, q AS (SELECT sum(value * value) AS q, sum(value) ** 2 / count(*) AS t, count(DISTINCT subject) AS ns, count(DISTINCT a) AS na, count(DISTINCT b) AS nb FROM dsg),
k AS (SELECT (SELECT sum(k) FROM (SELECT sum(value) ** 2 / count(*) AS k FROM dsg GROUP BY subject)) AS s, (SELECT sum(k) FROM (SELECT sum(value) ** 2 / count(*) AS k FROM dsg GROUP BY a)) AS a, (SELECT sum(k) FROM (SELECT sum(value) ** 2 / count(*) AS k FROM dsg GROUP BY b)) AS b,
  (SELECT sum(k) FROM (SELECT sum(value) ** 2 / count(*) AS k FROM dsg GROUP BY a, b)) AS ab, (SELECT sum(k) FROM (SELECT sum(value) ** 2 / count(*) AS k FROM dsg GROUP BY a, subject)) AS as_, (SELECT sum(k) FROM (SELECT sum(value) ** 2 / count(*) AS k FROM dsg GROUP BY b, subject)) AS bs),
e AS (SELECT 'a' AS source, a - t AS ss, as_ - a - s + t AS er, na - 1 AS df1, (na - 1) * (ns - 1) AS df2 FROM q, k UNION ALL SELECT 'b', b - t, bs - b - s + t, nb - 1, (nb - 1) * (ns - 1) FROM q, k
  UNION ALL SELECT 'a * b', ab - a - b + t, q - ab - as_ - bs + a + b + s - t, (na - 1) * (nb - 1), (na - 1) * (nb - 1) * (ns - 1) FROM q, k)
SELECT source, df1, df2, round((ss / df1) / (er / df2), 3) AS f, round(ss / (ss + er), 3) AS np2 FROM e"""
PT = ", m AS (SELECT subject, a, avg(value) AS v FROM dsg GROUP BY ALL), p AS (SELECT x.a AS x, y.a AS y, avg(x.v - y.v) / (stddev_samp(x.v - y.v) / sqrt(count(*))) AS t, count(*) - 1 AS df, (avg(x.v) - avg(y.v)) / sqrt((var_samp(x.v) + var_samp(y.v)) / 2) AS cohen FROM m x JOIN m y USING (subject) WHERE x.a < y.a GROUP BY ALL)"

# -- the rest of reshaping and summaries ----------------------------------------------------------------------------------------------
feat("rsh_strip_suffix", lambda f: f.filter("task = 'O'").select(F.regexp_replace(F.concat_ws("_", "feature", "task"), "_[^_]*$", "").alias("base")).intersect(f.filter("task = 'F'").select(F.regexp_replace(F.concat_ws("_", "feature", "task"), "_[^_]*$", "").alias("base"))), "SELECT DISTINCT feature AS base FROM feat")


