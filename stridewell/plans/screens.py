"""Queries of the screens, with p values in SQL by numerical integration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import models as L
from ..operators import screening as C
from ..sources.shared import staged
from .frames import FEATURE_ROWS, features, table
from .motion import rounded

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

BOTH = f"""WITH RECURSIVE {FEATURE_ROWS}, lab AS (SELECT DISTINCT pid, task, y FROM feat),
scr AS (SELECT 'within' AS variant, pid, task, feature, value, y FROM feat
  UNION ALL SELECT 'cross', f.pid, f.task, f.feature, f.value, l.y FROM feat f JOIN lab l ON f.pid = l.pid AND f.task <> l.task)"""


def t_tail(t: str, v: str) -> str:
    """SQL of the two-sided tail of Student's t: one less twice the integral of the density, by Simpson's rule."""
    density = f"pow(1 + pow({t} * i / 2000.0, 2) / {v}, -({v} + 1) / 2.0)"
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"greatest(0, 1 - 2 * exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi()) * abs({t}) / 6000 * (SELECT sum(({weight}) * {density}) FROM range(2001) r(i)))"


def chi2_tail(x: str, d: str) -> str:
    """SQL of the tail of chi-square for two degrees of freedom or more, by Simpson's rule."""
    at = f"({x} * i / 4000.0)"
    density = f"CASE WHEN i = 0 THEN CASE WHEN {d} = 2 THEN 0.5 ELSE 0 END ELSE exp(({d} / 2.0 - 1) * ln({at}) - {at} / 2 - {d} / 2.0 * ln(2.0) - lgamma({d} / 2.0)) END"
    weight = "CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"greatest(0, 1 - {x} / 12000 * (SELECT sum(({weight}) * ({density})) FROM range(4001) r(i)))"


KEYS = "variant, task, feature"
#: SQL of each screen: rows of variant, task, feature, value and, where there is one, p.
R_SQL = f"SELECT {KEYS}, count(*)::DOUBLE AS n, covar_pop(value, y) / nullif(stddev_pop(value) * stddev_pop(y), 0) AS value FROM scr GROUP BY ALL"
SCREEN_SQL = {
    "scr_anova_f": f"""g AS (SELECT {KEYS}, y, count(value) AS n, sum(value) AS s, sum(value * value) AS q FROM scr GROUP BY ALL),
t AS (SELECT {KEYS}, sum(n)::DOUBLE AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b, count(*) AS k FROM g GROUP BY ALL),
f AS (SELECT {KEYS}, n, CASE WHEN k = 2 THEN (b - s * s / n) / nullif((q - b) / (n - 2), 0) END AS value FROM t),
v AS (SELECT {KEYS}, value, {t_tail("sqrt(value)", "(n - 2)")} AS p FROM f)""",
    "scr_pearson": f"v AS (SELECT {KEYS}, value FROM ({R_SQL}))",
    "scr_point_biserial": f"""c AS ({R_SQL}), w AS (SELECT *, value * sqrt((n - 2) / nullif(1 - value * value, 0)) AS t FROM c),
v AS (SELECT {KEYS}, value, t, {t_tail("t", "(n - 2)")} AS p FROM w)""",
    "scr_spearman": f"""k AS (SELECT {KEYS}, rank() OVER (PARTITION BY {KEYS} ORDER BY value) + (count(*) OVER (PARTITION BY {KEYS}, value) - 1) / 2 AS a,
  rank() OVER (PARTITION BY {KEYS} ORDER BY y) + (count(*) OVER (PARTITION BY {KEYS}, y) - 1) / 2 AS b FROM scr),
v AS (SELECT {KEYS}, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS value FROM k GROUP BY ALL)""",
    "scr_ks2": f"""c AS (SELECT {KEYS}, sum((y = 0)::INT) OVER p AS n, sum((y = 1)::INT) OVER p AS m,
  abs(sum((y = 1)::INT) OVER u / nullif(sum((y = 1)::INT) OVER p, 0) - sum((y = 0)::INT) OVER u / nullif(sum((y = 0)::INT) OVER p, 0)) AS g
  FROM scr WINDOW u AS (PARTITION BY {KEYS} ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), p AS (PARTITION BY {KEYS})),
d AS (SELECT {KEYS}, max(g) AS value, any_value(n)::DOUBLE AS n, any_value(m)::DOUBLE AS m FROM c GROUP BY ALL),
w AS (SELECT {KEYS}, value, least(n, m)::BIGINT AS n, greatest(n, m)::BIGINT AS m, round(value * n * m)::BIGINT AS far FROM d WHERE value IS NOT NULL),
ks AS (SELECT {KEYS}, n, m, far, 0::BIGINT AS s, list_transform(range(n + 1), lambda i: 0.0::DOUBLE) AS o FROM w UNION ALL
  SELECT {KEYS}, n, m, far, s + 1, list_transform(range(n + 1), lambda i: CASE WHEN i > s + 1 OR s + 1 - i > m THEN 0 WHEN abs(i * m - (s + 1 - i) * n) >= far THEN 1
    ELSE (o[i + 1] * (s + 1 - i) + CASE WHEN i > 0 THEN o[i] * i ELSE 0 END) / (s + 1) END::DOUBLE) FROM ks WHERE s < n + m),
v AS (SELECT {KEYS}, d.value, CASE WHEN far = 0 THEN 1 ELSE least(1, o[ks.n + 1]) END AS p FROM d LEFT JOIN ks USING (variant, task, feature) WHERE ks.s IS NULL OR ks.s = ks.n + ks.m)""",
    "scr_mutual_info": f"""o AS (SELECT *, row_number() OVER (PARTITION BY {KEYS}, y ORDER BY value, pid) AS i, count(*) OVER (PARTITION BY {KEYS}, y) AS c FROM scr),
e AS (SELECT a.variant, a.task, a.feature, a.y, a.i, a.c, a.value, abs(a.value - b.value) AS gap,
  row_number() OVER (PARTITION BY a.variant, a.task, a.feature, a.y, a.i ORDER BY abs(a.value - b.value)) AS k
  FROM o a JOIN o b ON a.variant = b.variant AND a.task = b.task AND a.feature = b.feature AND a.y = b.y AND a.i <> b.i AND abs(a.i - b.i) <= 3),
r AS (SELECT * FROM e WHERE k = least(3, c - 1)),
m AS (SELECT r.variant, r.task, r.feature, r.y, r.i, r.c, r.k, count(*) FILTER (CASE WHEN r.gap = 0 THEN x.value = r.value ELSE abs(x.value - r.value) < r.gap END) AS m
  FROM r JOIN r x ON r.variant = x.variant AND r.task = x.task AND r.feature = x.feature GROUP BY ALL),
psi AS (SELECT n, -0.5772156649015329 + coalesce(sum(1.0 / (n - 1)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS d FROM range(2, 20001) a(n) UNION ALL SELECT 1, -0.5772156649015329),
u AS (SELECT {KEYS}, count(*) AS n, avg(pc.d) AS dc, avg(pm.d) AS dm, avg(pk.d) AS dk FROM m JOIN psi pc ON pc.n = m.c JOIN psi pm ON pm.n = m.m JOIN psi pk ON pk.n = m.k GROUP BY ALL),
v AS (SELECT {KEYS}, greatest(0, pn.d + dk - dc - dm) AS value FROM u JOIN psi pn ON pn.n = u.n)""",
}
SCREENS = {
    "scr_anova_f": (C.screen_f, "p"),
    "scr_pearson": (C.screen_pearson, "r"),
    "scr_point_biserial": (C.screen_point_biserial, "p"),
    "scr_spearman": (C.screen_spearman, "r"),
    "scr_ks2": (C.screen_ks, "p"),
    "scr_mutual_info": (C.screen_mutual_information, "mi"),
}
KEEP_SQL = {"p": "p <= 0.05", "r": "abs(value) >= 0.2", "mi": "value >= 0.05"}
#: Digits that p values and the statistics are compared with.
DIGITS = 5


def kept_in_both(found, rule: str):
    """The screen's rows, with whether their feature passes in both tasks and the score of those that do."""
    return rounded(C.with_scores(found, rule), DIGITS)


def both(spark, d):
    """The features with either label, written once: a screen reads them as often as it likes."""
    return staged(C.both_ways(staged(features(spark, d), "features")), "both-ways")


def kept_sql(name: str, source: str = BOTH) -> str:
    rule = SCREENS[name][1]
    x, y = ("abs(a)", "abs(b)") if rule == "r" else ("a", "b")
    columns = ["value", *(["t"] if name == "scr_point_biserial" else []), *(["p"] if rule == "p" else [])]
    return f"""{source}, {SCREEN_SQL[name]},
good AS (SELECT variant, feature, max(CASE WHEN task = 'O' THEN value END) AS a, max(CASE WHEN task = 'F' THEN value END) AS b FROM v WHERE {KEEP_SQL[rule]} GROUP BY ALL),
best AS (SELECT variant, feature, CASE WHEN {x} <= 0 OR {y} <= 0 THEN 0 ELSE 2 * {x} * {y} / ({x} + {y}) END AS score FROM good WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT {KEYS}, {", ".join(f"round({c}, {DIGITS}) AS {c}" for c in columns)}, round(score, {DIGITS}) AS score, score IS NOT NULL AS kept FROM v LEFT JOIN best USING (variant, feature)"""


for _name, (_screen, _rule) in SCREENS.items():
    QUERIES[_name] = lambda spark, d, s=_screen, r=_rule: kept_in_both(s(both(spark, d)), r)
    ORACLE_SQL[_name] = kept_sql(_name)


def metadata(spark, d):
    """Numbers known of a person besides the recording, in the shape of features: balance, nation and order counts of the
    customer with the person's number."""
    label = features(spark, d).select("pid", "task", "y").distinct()
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return label.join(own, "pid").unpivot(["pid", "task", "y"], ["balance", "nation"], "feature", "value").select("pid", "task", "feature", "value", "y")


META_SQL = BOTH.replace("lab AS (", """meta AS (SELECT pid, task, feature, value, y FROM (SELECT DISTINCT pid, task, y, c_acctbal::DOUBLE AS balance, c_nationkey::DOUBLE AS nation FROM feat JOIN customer ON c_custkey = pid)
  UNPIVOT (value FOR feature IN (balance, nation))),
lab AS (""").replace("FROM feat f JOIN lab", "FROM meta f JOIN lab").replace("value, y FROM feat\n", "value, y FROM meta\n")


def screened_metadata(spark, d):
    """F, r, rho and D of numeric metadata in one long table."""
    rows, found = staged(C.both_ways(staged(metadata(spark, d), "metadata")), "both-ways"), None
    for name in ("scr_anova_f", "scr_pearson", "scr_spearman", "scr_ks2", "scr_point_biserial"):
        one = kept_in_both(SCREENS[name][0](rows), SCREENS[name][1]).select(F.lit(name).alias("screen"), *C.KEYS, "value", "kept")
        found = one if found is None else found.unionByName(one)
    return found


QUERIES["scr_meta_numeric"] = screened_metadata
ORACLE_SQL["scr_meta_numeric"] = " UNION ALL ".join(f"SELECT '{n}' AS screen, {KEYS}, value, kept FROM ({kept_sql(n, META_SQL)})" for n in ("scr_anova_f", "scr_pearson", "scr_spearman", "scr_ks2", "scr_point_biserial"))


def p_of_f(spark, d):
    """Tails of F, t, chi-square and KS over aggregated rows."""
    rows = both(spark, d)
    f, t, k = C.screen_f(rows), C.screen_point_biserial(rows), C.screen_ks(rows)
    one = lambda frame, name: frame.select(F.lit(name).alias("tail"), *C.KEYS, "p")
    return rounded(one(f, "f").unionByName(one(t, "t")).unionByName(one(k, "ks")), DIGITS)


QUERIES["scr_pvalue"] = p_of_f
ORACLE_SQL["scr_pvalue"] = " UNION ALL ".join(f"SELECT '{tail}' AS tail, {KEYS}, p FROM ({kept_sql(n)})" for tail, n in (("f", "scr_anova_f"), ("t", "scr_point_biserial"), ("ks", "scr_ks2")))


#: Categories known of a person: market segment and nation's region, each level one column of 0 and 1, and the nation itself.
REGIONS = ("0", "1", "2", "3", "4")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def categories(spark, d):
    """Categorical metadata in the shape of features: the customer with the person's number."""
    label = features(spark, d).select("pid", "task", "y").distinct()
    own = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    hot = [(f"segment {v}", F.col("c_mktsegment") == v) for v in SEGMENTS] + [(f"region {v}", F.col("n_regionkey") == int(v)) for v in REGIONS]
    cells = F.array(*(F.struct(F.lit(k).alias("feature"), c.cast("long").alias("value")) for k, c in hot), F.struct(F.lit("nation").alias("feature"), F.col("c_nationkey").cast("long").alias("value")))
    own = own.select(F.col("c_custkey").alias("pid"), F.explode(cells).alias("c"))
    return label.join(own, "pid").select("pid", "task", "c.feature", "c.value", "y")


QUERIES["scr_chi2"] = lambda spark, d: kept_in_both(C.screen_chi2(staged(C.both_ways(staged(categories(spark, d), "categories")), "both-ways")), "p")
_hot = ", ".join([f"struct_pack(feature := 'segment {v}', value := (c_mktsegment = '{v}')::BIGINT)" for v in SEGMENTS] + [f"struct_pack(feature := 'region {v}', value := (n_regionkey = {v})::BIGINT)" for v in REGIONS] + ["struct_pack(feature := 'nation', value := c_nationkey::BIGINT)"])
CHI2_SQL = BOTH.replace("lab AS (", f"cat AS (SELECT l.pid, task, c.feature AS feature, c.value AS value, y FROM (SELECT c_custkey AS pid, unnest([{_hot}]) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey) JOIN (SELECT DISTINCT pid, task, y FROM feat) l USING (pid)),\nlab AS (").replace("FROM feat f JOIN lab", "FROM cat f JOIN lab").replace("value, y FROM feat\n", "value, y FROM cat\n")
ORACLE_SQL["scr_chi2"] = f"""{CHI2_SQL}, n AS (SELECT {KEYS}, value, y, count(*) AS n FROM scr GROUP BY ALL), r AS (SELECT {KEYS}, value, sum(n) AS r FROM n GROUP BY ALL), c AS (SELECT {KEYS}, y, sum(n) AS c FROM n GROUP BY ALL),
t AS (SELECT {KEYS}, sum(r) AS t, count(*) AS k FROM r GROUP BY ALL), e AS (SELECT variant, task, feature, k, r * c / t AS e, coalesce(n, 0) AS o FROM r JOIN c USING (variant, task, feature) JOIN t USING (variant, task, feature) LEFT JOIN n USING (variant, task, feature, value, y)),
s AS (SELECT {KEYS}, sum(pow(CASE WHEN k = 2 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE abs(o - e) END, 2) / e) AS value, max(k - 1) AS df, count(*) AS cells, max(k) AS k FROM e GROUP BY ALL),
v AS (SELECT {KEYS}, value, df, CASE WHEN df = 1 THEN {t_tail("sqrt(value)", "1e7")} ELSE {chi2_tail("value", "df")} END AS p FROM s WHERE k > 1 AND cells = 2 * k),
good AS (SELECT variant, feature, max(CASE WHEN task = 'O' THEN value END) AS a, max(CASE WHEN task = 'F' THEN value END) AS b FROM v WHERE p <= 0.05 GROUP BY ALL),
best AS (SELECT variant, feature, CASE WHEN a <= 0 OR b <= 0 THEN 0 ELSE 2 * a * b / (a + b) END AS score FROM good WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT {KEYS}, round(value, {DIGITS}) AS value, df, round(p, {DIGITS}) AS p, round(score, {DIGITS}) AS score, score IS NOT NULL AS kept FROM v LEFT JOIN best USING (variant, feature)"""


def ranked(spark, d):
    """ranking, feature, place, score: each screen's features of the own task, best first."""
    rows, union = both(spark, d).filter("variant = 'within'"), None
    for name in ("scr_anova_f", "scr_spearman", "scr_pearson", "scr_ks2", "scr_mutual_info"):
        found = SCREENS[name][0](rows).filter("value IS NOT NULL")
        one = E.rank_pair(found, "value").select(F.lit(name).alias("ranking"), "feature", F.round("score", 9).alias("score"))
        union = one if union is None else union.unionByName(one)
    return E.placed(staged(union, "rankings"), ["ranking"], "score")


RANKED_SQL = f"""r AS ({" UNION ALL ".join(f"SELECT '{n}' AS ranking, task, feature, abs(value) AS value FROM (" + BOTH + ", " + SCREEN_SQL[n] + " SELECT * FROM v WHERE variant = 'within')" for n in ("scr_anova_f", "scr_spearman", "scr_pearson", "scr_ks2", "scr_mutual_info"))}),
w AS (SELECT ranking, feature, max(CASE WHEN task = 'O' THEN value END) AS a, max(CASE WHEN task = 'F' THEN value END) AS b FROM r GROUP BY ALL),
s AS (SELECT ranking, feature, round(CASE WHEN a <= 0 OR b <= 0 THEN 0 ELSE 2 * a * b / (a + b) END, 9) AS score FROM w WHERE a IS NOT NULL AND b IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY ranking ORDER BY score DESC, feature) AS place FROM s)"""
QUERIES["scr_rank_merge"] = lambda spark, d: ranked(spark, d).groupBy("feature").agg(F.count("*").alias("appearances"), F.round(F.avg("place"), 6).alias("mean_place")).orderBy(F.desc("appearances"), "mean_place", "feature").limit(100)
ORACLE_SQL["scr_rank_merge"] = f"WITH {RANKED_SQL} SELECT feature, count(*) AS appearances, round(avg(place), 6) AS mean_place FROM k GROUP BY feature ORDER BY appearances DESC, mean_place, feature LIMIT 100"
QUERIES["scr_token_topk"] = lambda spark, d: ranked(spark, d).filter("place <= 100").select("ranking", F.explode(F.split("feature", "_")).alias("token")).groupBy("ranking", "token").agg(F.count("*").alias("n"))
ORACLE_SQL["scr_token_topk"] = f"WITH {RANKED_SQL}, e AS (SELECT ranking, unnest(string_split(feature, '_')) AS token FROM k WHERE place <= 100) SELECT ranking, token, count(*) AS n FROM e GROUP BY ALL"
QUERIES["scr_token_dist"] = lambda spark, d: ranked(spark, d).select("place", F.explode(F.split("feature", "_")).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.round(F.avg("place"), 6).alias("mean_place"))
ORACLE_SQL["scr_token_dist"] = f"WITH {RANKED_SQL}, e AS (SELECT place, unnest(string_split(feature, '_')) AS token FROM k) SELECT token, count(*) AS n, round(avg(place), 6) AS mean_place FROM e GROUP BY token"
