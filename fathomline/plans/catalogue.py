"""Named queries over the star schema's panels, each with its SQL for DuckDB.

Parameters of densities are literal here, equal in query and SQL, so that results can be held against each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions.normal import norm_cdf_sql, radical_inverse
from fathomline.functions.special import ndtri_sql
from fathomline.operators import density as D
from fathomline.operators import colombi, formula, inference, kmeans, mixture
from fathomline.operators import frontier as FR
from fathomline.operators import panel as P
from fathomline.operators import regression as R
from fathomline.sources.panels import CUSTOMER_YEAR_SQL, SUPPLIER_YEAR_SQL, customer_year, supplier_year
from fathomline.sources.readers import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Frontier at which densities are evaluated: intercept, slope, log variances of inefficiency and noise.
B0, B1, GU, GV = 9.4, 0.78, -5.5, -5.2
S2U, S2V = math.exp(GU), math.exp(GV)
S2 = S2U + S2V
SIGMA, LAMBDA = math.sqrt(S2), math.sqrt(S2U / S2V)
SU, SV = math.sqrt(S2U), math.sqrt(S2V)
MU = 0.05


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, and never minus zero."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def r(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0"


SY, CY = f"WITH {SUPPLIER_YEAR_SQL}", f"WITH {CUSTOMER_YEAR_SQL}"
E_SQL = f"(y - {B0!r} - {B1!r} * x1)"
SYE = f"{SY}, e AS (SELECT *, {E_SQL} AS e FROM sy)"


def sy_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = supplier_year(spark, sf_dir)
    return df.withColumn("e", D.residual(F.col("y"), [(B0, F.lit(1.0)), (B1, F.col("x1"))]))


def u2() -> Column:
    return F.lit(S2U)


def v2() -> Column:
    return F.lit(S2V)


@query("panel_build_sy", f"{SY} SELECT id, time::BIGINT AS time, {r('y')} AS y, {r('x1')} AS x1, {r('x2')} AS x2, {r('z1')} AS z1, {r('w1')} AS w1 FROM sy")
def _(spark, sf_dir):
    return rounded(supplier_year(spark, sf_dir, sizes=True))


@query("panel_build_cy", f"{CY} SELECT id, time::BIGINT AS time, {r('y')} AS y, {r('x1')} AS x1 FROM cy")
def _(spark, sf_dir):
    return rounded(customer_year(spark, sf_dir))


ODD_SQL = f"""{SY}, odd AS (SELECT id, time::BIGINT AS time, CASE WHEN time = 1996 THEN NULL WHEN time = 1997 THEN 'nan'::DOUBLE ELSE y END AS y,
  CASE WHEN time = 1998 THEN 'inf'::DOUBLE WHEN time = 1999 THEN '-inf'::DOUBLE ELSE x1 END AS x1 FROM sy)"""


def odd(spark, sf_dir):
    df = supplier_year(spark, sf_dir).select("id", F.col("time").cast("long").alias("time"), "y", "x1")
    y = F.when(F.col("time") == 1996, F.lit(None)).when(F.col("time") == 1997, F.lit(float("nan"))).otherwise(F.col("y"))
    x = F.when(F.col("time") == 1998, F.lit(float("inf"))).when(F.col("time") == 1999, F.lit(float("-inf"))).otherwise(F.col("x1"))
    return df.withColumns({"y": y, "x1": x})


@query("complete_cases", f"{ODD_SQL} SELECT id, time, {r('y')} AS y, {r('x1')} AS x1 FROM odd WHERE y IS NOT NULL AND isfinite(y) AND x1 IS NOT NULL AND isfinite(x1)")
def _(spark, sf_dir):
    return rounded(P.complete_cases(odd(spark, sf_dir), ["y", "x1"]))


@query("omitted_rows", f"{ODD_SQL} SELECT id, time FROM odd WHERE NOT coalesce(isfinite(y) AND isfinite(x1), false)")
def _(spark, sf_dir):
    return P.omitted_rows(odd(spark, sf_dir), ["y", "x1"]).select("id", "time")


@query("factorize_ids", "SELECT s_name, dense_rank() OVER (ORDER BY s_name) AS code FROM supplier")
def _(spark, sf_dir):
    return P.factorize(read_table(spark, sf_dir, "supplier").select("s_name"), "s_name", "code")


@query("original_order", f"{CY} SELECT id, time::BIGINT AS time, row_number() OVER (PARTITION BY id ORDER BY time) - 1 AS orig_order FROM cy")
def _(spark, sf_dir):
    return P.original_order(customer_year(spark, sf_dir).select("id", F.col("time").cast("long").alias("time")), ["id", "time"])


@query("dummy_coding", "SELECT n_nationkey::BIGINT AS n_nationkey, " + ", ".join(f"CASE WHEN n_regionkey = {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS region_{k}" for k in range(1, 5)) + " FROM nation")
def _(spark, sf_dir):
    df = P.dummies(read_table(spark, sf_dir, "nation"), "n_regionkey", range(5), "region_")
    return df.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), *[f"region_{k}" for k in range(1, 5)])


@query("panel_balance", f"{CY}, p AS (SELECT id, count(*) AS t FROM cy GROUP BY id) SELECT count(*) AS n_firms, sum(t)::BIGINT AS n_obs, min(t) AS min_t, max(t) AS max_t, min(t) = max(t) AS balanced FROM p")
def _(spark, sf_dir):
    return P.balance(customer_year(spark, sf_dir))


@query("time_invariance", f"{SY}, d AS (SELECT id, greatest(max(x1) - avg(x1), avg(x1) - min(x1)) AS deviation FROM sy GROUP BY id) SELECT id, {r('deviation')} AS deviation FROM d WHERE deviation > 1e-8")
def _(spark, sf_dir):
    return rounded(P.varying_firms(supplier_year(spark, sf_dir), "x1"))


@query("log_variance_bounds", f"{SY} SELECT {r('min(-3.0 + 10.0 * z1)')} AS low, {r('max(-3.0 + 10.0 * z1)')} AS high, min(-3.0 + 10.0 * z1) > -10 AND max(-3.0 + 10.0 * z1) < 10 AS inside FROM sy")
def _(spark, sf_dir):
    g = -3.0 + 10.0 * F.col("z1")
    return rounded(supplier_year(spark, sf_dir).agg(F.min(g).alias("low"), F.max(g).alias("high"), ((F.min(g) > -10) & (F.max(g) < 10)).alias("inside")))


@query("ols_pooled", f"{SY} SELECT count(*) AS n, {r('regr_slope(y, x1)')} AS slope, {r('regr_intercept(y, x1)')} AS intercept FROM sy")
def _(spark, sf_dir):
    return rounded(R.ols_single(supplier_year(spark, sf_dir), "y", "x1"))


@query("within_transform", f"{SY} SELECT id, time::BIGINT AS time, {r('y - avg(y) OVER (PARTITION BY id)')} AS y_w, {r('x1 - avg(x1) OVER (PARTITION BY id)')} AS x1_w FROM sy")
def _(spark, sf_dir):
    return rounded(P.within(supplier_year(spark, sf_dir), ["y", "x1"]).select("id", "time", "y_w", "x1_w"))


@query("fixed_effects", f"{SY}, w AS (SELECT *, y - avg(y) OVER (PARTITION BY id) AS yw, x1 - avg(x1) OVER (PARTITION BY id) AS xw FROM sy), s AS (SELECT sum(xw * yw) / sum(xw * xw) AS slope, avg(y) AS my, avg(x1) AS mx FROM w) SELECT {r('slope')} AS slope, {r('my - slope * mx')} AS intercept FROM s")
def _(spark, sf_dir):
    return rounded(R.fixed_effects(supplier_year(spark, sf_dir), "y", "x1"))


@query("between_means", f"{CY} SELECT id, count(*) AS t, {r('avg(y)')} AS y_mean, {r('avg(x1)')} AS x1_mean FROM cy GROUP BY id")
def _(spark, sf_dir):
    return rounded(P.firm_means(customer_year(spark, sf_dir), ["y", "x1"]))


RE_SQL = """, p AS (SELECT id, count(*) AS t, avg(y) AS my, avg(x1) AS mx FROM {v} GROUP BY id),
w AS (SELECT y - my AS yw, x1 - mx AS xw FROM {v} JOIN p USING (id)),
sw AS (SELECT sum(yw * yw) - sum(xw * yw) ^ 2 / sum(xw * xw) AS rss FROM w),
sb AS (SELECT count(*) AS nf, sum(t) AS n, count(*) * (var_pop(my) - covar_pop(mx, my) ^ 2 / var_pop(mx)) AS rss, avg(1.0 / t) AS ti FROM p),
s AS (SELECT sw.rss / (n - nf - 1) AS s2e, greatest(0.0, sb.rss / (nf - 2) - sw.rss / (n - nf - 1) * ti) AS s2v FROM sw, sb),
q AS (SELECT y - th * my AS yq, 1 - th AS cq, x1 - th * mx AS xq, s2e, s2v FROM (SELECT *, 1 - sqrt(s2e / (t * s2v + s2e)) AS th FROM {v} JOIN p USING (id), s)),
f AS (SELECT first(s2e) AS sigma2_e, first(s2v) AS sigma2_v, sum(cq * cq) AS s11, sum(cq * xq) AS s1x, sum(cq * yq) AS s1y, sum(xq * xq) AS sxx, sum(xq * yq) AS sxy FROM q),
g AS (SELECT *, (s11 * sxy - s1x * s1y) / (s11 * sxx - s1x * s1x) AS slope FROM f)
SELECT round(sigma2_e, 6) + 0.0 AS sigma2_e, round(sigma2_v, 6) + 0.0 AS sigma2_v, round(slope, 6) + 0.0 AS slope, round((s1y - slope * s1x) / s11, 6) + 0.0 AS intercept FROM g"""


@query("random_effects_gls", CY + RE_SQL.format(v="cy"))
def _(spark, sf_dir):
    return rounded(R.random_effects(customer_year(spark, sf_dir), "y", "x1"))


@query("predicted_random_effects", CY + RE_SQL.format(v="cy").split("SELECT round(sigma2_e")[0] + """ SELECT id, round(t * sigma2_v / (sigma2_e + t * sigma2_v) * (my - (s1y - slope * s1x) / s11 - slope * mx), 6) + 0.0 AS effect FROM p, g""")
def _(spark, sf_dir):
    return rounded(R.predicted_random_effects(customer_year(spark, sf_dir), "y", "x1"))


#: Two regressors from variances and covariances; {v} the rows, {df} the degrees of freedom.
TWO_SQL = """, s AS (SELECT count(*) AS n, count(DISTINCT id) AS nf, var_pop(x) AS a, var_pop(z) AS b, covar_pop(x, z) AS c, covar_pop(x, v) AS d, covar_pop(z, v) AS e, var_pop(v) AS f, avg(x1) AS mx, avg(z1) AS mz, avg(y) AS my FROM {v}),
b AS (SELECT *, a * b - c * c AS det, (d * b - e * c) / (a * b - c * c) AS b1, (e * a - d * c) / (a * b - c * c) AS b2 FROM s),
w AS (SELECT *, n * (f - b1 * d - b2 * e) / ({df}) AS s2 FROM b)
SELECT '_cons' AS term, round(my - b1 * mx - b2 * mz, 5) + 0.0 AS estimate, {se} AS std_error FROM w
UNION ALL SELECT 'x1', round(b1, 5) + 0.0, round(sqrt(s2 * b / (n * det)), 5) + 0.0 FROM w UNION ALL SELECT 'z1', round(b2, 5) + 0.0, round(sqrt(s2 * a / (n * det)), 5) + 0.0 FROM w"""


@query("regression_pooled", f"{SY}, o AS (SELECT *, x1 AS x, z1 AS z, y AS v FROM sy)" + TWO_SQL.format(v="o", df="n - 3", se="round(sqrt(s2 * (1 / n + (mx * mx * b - 2 * mx * mz * c + mz * mz * a) / (n * det))), 5) + 0.0"))
def _(spark, sf_dir):
    return rounded(R.regression(supplier_year(spark, sf_dir), "y", ["x1", "z1"]), 5)


@query("regression_fixed", f"{SY}, o AS (SELECT *, x1 - avg(x1) OVER (PARTITION BY id) AS x, z1 - avg(z1) OVER (PARTITION BY id) AS z, y - avg(y) OVER (PARTITION BY id) AS v FROM sy)" + TWO_SQL.format(v="o", df="n - nf - 2", se="NULL::DOUBLE"))
def _(spark, sf_dir):
    return rounded(R.regression(supplier_year(spark, sf_dir), "y", ["x1", "z1"], "fixed"), 5)


@query("regression_random", f"{CY}, f AS ({(CY + RE_SQL).format(v='cy').split('SELECT round(sigma2_e')[0]} SELECT * FROM g) SELECT '_cons' AS term, round((s1y - slope * s1x) / s11, 5) + 0.0 AS estimate FROM f UNION ALL SELECT 'x1', round(slope, 5) + 0.0 FROM f")
def _(spark, sf_dir):
    return rounded(R.regression(customer_year(spark, sf_dir), "y", ["x1"], "random").select("term", "estimate"), 5)


@query("mom_split", f"""{SYE}, m AS (SELECT avg(e) AS m1 FROM e), c AS (SELECT avg((e - m1) ^ 2) AS m2, avg((e - m1) ^ 3) AS m3 FROM e, m),
d AS (SELECT m2, CASE WHEN m3 >= 0 THEN -1e-4 ELSE m3 END AS m3 FROM c), u AS (SELECT *, ((m3 / (sqrt(2 / pi()) * (1 - 4 / pi()))) ^ 2) ^ (1.0 / 3.0) AS su FROM d)
SELECT {r('m2', 7)} AS m2, {r('m3', 7)} AS m3, {r('CASE WHEN su > 0 THEN su ELSE 0.1 END')} AS sigma2_u, {r('CASE WHEN m2 - (1 - 2 / pi()) * su > 0 THEN m2 - (1 - 2 / pi()) * su ELSE 0.1 END')} AS sigma2_v FROM u""")
def _(spark, sf_dir):
    out = R.moment_split(sy_e(spark, sf_dir), "e")
    return out.select((F.round("m2", 7) + 0.0).alias("m2"), (F.round("m3", 7) + 0.0).alias("m3"), (F.round("sigma2_u", 6) + 0.0).alias("sigma2_u"), (F.round("sigma2_v", 6) + 0.0).alias("sigma2_v"))


@query("residual_decomposition", f"{SYE} SELECT id, time::BIGINT AS time, {r('avg(e) OVER (PARTITION BY id)')} AS persistent, {r('e - avg(e) OVER (PARTITION BY id)')} AS transient FROM e")
def _(spark, sf_dir):
    return rounded(P.within(sy_e(spark, sf_dir), ["e"]).select("id", "time", (F.col("e") - F.col("e_w")).alias("persistent"), F.col("e_w").alias("transient")))


FEATURES_SQL = """, m AS (SELECT id, avg(e) AS m FROM e GROUP BY id), f AS (SELECT e.id, any_value(m) AS f_mean, var_samp(e) AS f_var,
  avg((e - m) ^ 3) / stddev_samp(e) ^ 3 AS f_skew FROM e JOIN m USING (id) GROUP BY e.id)"""


def firm_features(df: DataFrame) -> DataFrame:
    """Mean, variance and skewness of each id's residuals; the deviations' third power over the sample deviation's."""
    sums = df.groupBy("id").agg(F.count("*").alias("n"), F.avg("e").alias("f_mean"), F.var_samp("e").alias("f_var"), F.avg(F.pow("e", F.lit(2))).alias("a2"), F.avg(F.pow("e", F.lit(3))).alias("a3"))
    third = F.col("a3") - 3 * F.col("f_mean") * F.col("a2") + 2 * F.pow("f_mean", F.lit(3))
    return sums.select("id", "f_mean", "f_var", (third / F.pow(F.sqrt("f_var"), F.lit(3))).alias("f_skew"))


def standardized(df: DataFrame, columns: list[str]) -> DataFrame:
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    return df.join(F.broadcast(ends)).select("id", *[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in columns])


FEATURES = ("f_mean", "f_var", "f_skew")


@query("firm_features_z", SYE + FEATURES_SQL + " SELECT id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 4) + 0.0 AS {c}" for c in FEATURES) + " FROM f")
def _(spark, sf_dir):
    return rounded(standardized(firm_features(sy_e(spark, sf_dir)), list(FEATURES)), 4)


CENTROIDS = ((-0.5, 0.2, 0.0), (0.6, -0.3, 0.4))


@query("kmeans_assign", SYE + FEATURES_SQL + ", z AS (SELECT id, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in FEATURES) + " FROM f) SELECT id, CASE WHEN " + " <= ".join("(" + " + ".join(f"({c} - ({v})) ^ 2" for c, v in zip(FEATURES, cs)) + ")" for cs in CENTROIDS) + " THEN 0 ELSE 1 END::BIGINT AS cluster FROM z")
def _(spark, sf_dir):
    z = standardized(firm_features(sy_e(spark, sf_dir)), list(FEATURES))
    near = [sum((F.col(c) - v) * (F.col(c) - v) for c, v in zip(FEATURES, cs)) for cs in CENTROIDS]
    return z.select("id", F.when(near[0] <= near[1], 0).otherwise(1).cast("long").alias("cluster"))


@query("variance_link", f"{SY} SELECT id, time::BIGINT AS time, {r('exp(-3.0 + 4.0 * z1 - 2.0 * w1)')} AS s2 FROM sy")
def _(spark, sf_dir):
    return rounded(supplier_year(spark, sf_dir).select("id", "time", P.variance([F.lit(1.0), "z1", "w1"], [-3.0, 4.0, -2.0]).alias("s2")))


def _halton_sql(base: int) -> str:
    return f"""WITH RECURSIVE h AS (SELECT s_suppkey AS id, s_suppkey AS rest, 0.0::DOUBLE AS u, 1.0::DOUBLE / {base} AS scale FROM supplier
UNION ALL SELECT id, rest // {base}, u + (rest % {base}) * scale, scale / {base} FROM h WHERE rest > 0) SELECT id, round(max(u), 9) + 0.0 AS u FROM h GROUP BY id"""


for _base in (2, 3):

    @query(f"halton_base{_base}", _halton_sql(_base))
    def _(spark, sf_dir, base=_base):
        return read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.round(radical_inverse(F.col("s_suppkey"), base), 9) + 0.0).alias("u"))


HN_SQL = f"ln(2.0) - ln({SIGMA!r}) - 0.5 * ln(2 * pi()) - 0.5 * e * e / {S2!r} + ln({norm_cdf_sql(f'(-e * {LAMBDA!r} / {SIGMA!r})')})"
TN_SQL = f"-0.5 * ln(2 * pi()) - 0.5 * ((e + {MU}) / {SIGMA!r}) ^ 2 - ln({SIGMA!r}) + ln({norm_cdf_sql(f'(({MU} * {S2V!r} - e * {S2U!r}) / {S2!r} / sqrt({S2U * S2V / S2!r}))')}) - ln({norm_cdf_sql(f'({MU} / {SU!r})')})"


@query("cross_density_hn", f"{SYE} SELECT id, time::BIGINT AS time, {r(HN_SQL)} AS log_f FROM e")
def _(spark, sf_dir):
    return rounded(sy_e(spark, sf_dir).select("id", "time", D.log_density_hn(F.col("e"), u2(), v2()).alias("log_f")))


@query("cross_loglik_hn", f"{SYE} SELECT count(*) AS n, {r(f'sum({HN_SQL})', 4)} AS loglik FROM e")
def _(spark, sf_dir):
    return rounded(sy_e(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(D.log_density_hn(F.col("e"), u2(), v2())).alias("loglik")), 4)


@query("cross_density_tn", f"{SYE} SELECT id, time::BIGINT AS time, {r(TN_SQL)} AS log_f FROM e")
def _(spark, sf_dir):
    return rounded(sy_e(spark, sf_dir).select("id", "time", D.log_density_tn(F.col("e"), F.lit(MU), u2(), v2()).alias("log_f")))


@query("tfe_loglik_hn", f"{SYE}, w AS (SELECT e - avg(e) OVER (PARTITION BY id) - {math.sqrt(2 / math.pi) * SU!r} AS e FROM e) SELECT {r(f'sum({HN_SQL})', 4)} AS loglik FROM w")
def _(spark, sf_dir):
    # Each id's effect set so that its mean error is the expected one.
    e = F.col("e_w") - math.sqrt(2 / math.pi) * SU
    return rounded(P.within(sy_e(spark, sf_dir), ["e"]).agg(F.sum(D.log_density_hn(e, u2(), v2())).alias("loglik")), 4)


A_SQL = f"(-e * {LAMBDA!r} / {SIGMA!r})"
SCORE_SQL = f"""{SYE}, a AS (SELECT *, {A_SQL} AS a FROM e), m AS (SELECT *, exp(-0.5 * a * a) / sqrt(2 * pi()) / ({norm_cdf_sql('a')}) AS m FROM a),
g AS (SELECT id, time, x1, e / {S2!r} + m * {LAMBDA!r} / {SIGMA!r} AS g_b,
  0.5 * {LAMBDA!r} * (-m * e / {SIGMA!r}) + 0.5 * {S2U / SIGMA!r} * (((e / {SIGMA!r}) ^ 2 - m * a - 1) / {SIGMA!r}) AS g_u,
  -0.5 * {LAMBDA!r} * (-m * e / {SIGMA!r}) + 0.5 * {S2V / SIGMA!r} * (((e / {SIGMA!r}) ^ 2 - m * a - 1) / {SIGMA!r}) AS g_v FROM m)"""


def scores(spark, sf_dir):
    b, u, v = D.score_hn(F.col("e"), u2(), v2())
    return sy_e(spark, sf_dir).select("id", "time", "x1", b.alias("g_b"), u.alias("g_u"), v.alias("g_v"))


@query("cross_score_hn", f"{SCORE_SQL} SELECT id, time::BIGINT AS time, {r('g_b', 4)} AS g_b0, {r('g_b * x1', 3)} AS g_b1, {r('g_u', 5)} AS g_u, {r('g_v', 5)} AS g_v FROM g")
def _(spark, sf_dir):
    g = scores(spark, sf_dir)
    return g.select("id", F.col("time").cast("long").alias("time"), *[(F.round(c, k) + 0.0).alias(n) for c, k, n in ((F.col("g_b"), 4, "g_b0"), (F.col("g_b") * F.col("x1"), 3, "g_b1"), (F.col("g_u"), 5, "g_u"), (F.col("g_v"), 5, "g_v"))])


PAIRS = [(a, b) for i, a in enumerate(("g_b", "g_x", "g_u", "g_v")) for b in ("g_b", "g_x", "g_u", "g_v")[i:]]


@query("bhhh_matrix", f"{SCORE_SQL}, h AS (SELECT g_b, g_b * x1 AS g_x, g_u, g_v FROM g) SELECT " + ", ".join(f"{r(f'-sum({a} * {b})', 2)} AS {a}_{b}" for a, b in PAIRS) + " FROM h")
def _(spark, sf_dir):
    g = scores(spark, sf_dir).withColumn("g_x", F.col("g_b") * F.col("x1"))
    return rounded(g.agg(*[(-F.sum(F.col(a) * F.col(b))).alias(f"{a}_{b}") for a, b in PAIRS]), 2)


@query("cluster_meat", f"{SCORE_SQL}, h AS (SELECT id, sum(g_b) AS g_b, sum(g_b * x1) AS g_x, sum(g_u) AS g_u, sum(g_v) AS g_v FROM g GROUP BY id) SELECT " + ", ".join(f"{r(f'sum({a} * {b})', 2)} AS {a}_{b}" for a, b in PAIRS) + " FROM h")
def _(spark, sf_dir):
    g = scores(spark, sf_dir).withColumn("g_x", F.col("g_b") * F.col("x1"))
    by = g.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("g_b", "g_x", "g_u", "g_v")])
    return rounded(by.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in PAIRS]), 2)


#: Standard normal draws for simulated likelihoods: quantiles of the first unscrambled Halton points, fixed values.
DRAWS = (0.0, -0.6744897501960817, 0.6744897501960817, -1.1503493803760079, 0.31863936396437514, -0.31863936396437514, 1.1503493803760079, -1.5341205443525463)
DRAWS_U = (0.43072729929545756, -0.43072729929545756, 1.2206403488473496, -0.1397102989154464, 0.7647096737863871, -0.7647096737863871, 0.1397102989154464, -1.2206403488473496)
SV0, SU0 = 0.04, 0.05


def _simulated(spark, sf_dir, persistent: bool) -> DataFrame:
    """(id, r, e): residuals at each draw; the draws are a short array, exploded in the row."""
    effect = [SV0 * w - (SU0 * abs(u) if persistent else 0.0) for w, u in zip(DRAWS, DRAWS_U)]
    draws = F.posexplode(F.array(*map(F.lit, effect))).alias("r", "w")
    return sy_e(spark, sf_dir).select("id", "e", draws).select("id", "r", (F.col("e") - F.col("w")).alias("e"))


def _simulated_loglik(df: DataFrame) -> DataFrame:
    paths = df.groupBy("id", "r").agg(F.sum(D.log_density_hn(F.col("e"), u2(), v2())).alias("l"))
    return D.log_sum_exp(paths, ["id"], "l", "l").select("id", (F.col("l") - math.log(len(DRAWS))).alias("loglik"))


def _simulated_sql(persistent: bool) -> str:
    rows = ", ".join(f"({k}, {SV0 * w - (SU0 * abs(u) if persistent else 0.0)!r})" for k, (w, u) in enumerate(zip(DRAWS, DRAWS_U)))
    return f"""{SYE}, d(r, w) AS (VALUES {rows}), p AS (SELECT id, r, e.e - w AS e FROM e, d), l AS (SELECT id, r, sum({HN_SQL}) AS l FROM p GROUP BY id, r)"""


@query("tre_sim_loglik", f"{_simulated_sql(False)}, m AS (SELECT id, max(l) AS m FROM l GROUP BY id) SELECT id, {r(f'any_value(m) + ln(sum(exp(l - m))) - ln({len(DRAWS)})', 5)} AS loglik FROM l JOIN m USING (id) GROUP BY id")
def _(spark, sf_dir):
    return rounded(_simulated_loglik(_simulated(spark, sf_dir, False)), 5)


@query("gtre_sim_loglik", f"{_simulated_sql(True)}, m AS (SELECT id, max(l) AS m FROM l GROUP BY id) SELECT id, {r(f'any_value(m) + ln(sum(exp(l - m))) - ln({len(DRAWS)})', 5)} AS loglik FROM l JOIN m USING (id) GROUP BY id")
def _(spark, sf_dir):
    return rounded(_simulated_loglik(_simulated(spark, sf_dir, True)), 5)


@query("simulation_weights", f"{_simulated_sql(False)} SELECT id, r::BIGINT AS r, {r('exp(l - max(l) OVER (PARTITION BY id)) / sum(exp(l)) OVER (PARTITION BY id) * exp(max(l) OVER (PARTITION BY id))', 5)} AS q FROM l")
def _(spark, sf_dir):
    paths = _simulated(spark, sf_dir, False).groupBy("id", "r").agg(F.sum(D.log_density_hn(F.col("e"), u2(), v2())).alias("l"))
    over = Window.partitionBy("id")
    shifted = paths.withColumn("w", F.exp(F.col("l") - F.max("l").over(over)))
    return rounded(shifted.select("id", F.col("r").cast("long").alias("r"), (F.col("w") / F.sum("w").over(over)).alias("q")), 5)


#: Two classes: class 0 has the frontier above, class 1 another; alpha are class 0's prior coefficients on 1 and w1.
ALPHA, SECOND = (0.3, -2.0), (9.2, 0.8, -4.8, -5.6)
S2U1, S2V1 = math.exp(SECOND[2]), math.exp(SECOND[3])
S21 = S2U1 + S2V1
HN1_SQL = f"ln(2.0) - ln({math.sqrt(S21)!r}) - 0.5 * ln(2 * pi()) - 0.5 * e1 * e1 / {S21!r} + ln({norm_cdf_sql(f'(-e1 * {math.sqrt(S2U1 / S2V1)!r} / {math.sqrt(S21)!r})')})"
LC_SQL = f"""{SY}, e AS (SELECT *, {E_SQL} AS e, y - {SECOND[0]} - {SECOND[1]} * x1 AS e1 FROM sy),
c AS (SELECT *, 1 / (1 + exp(-({ALPHA[0]} + {ALPHA[1]} * w1))) AS p0, {HN_SQL} AS l0, {HN1_SQL} AS l1 FROM e),
j AS (SELECT *, ln(p0) + l0 AS j0, ln(1 - p0) + l1 AS j1 FROM c)"""


def classes(spark, sf_dir) -> DataFrame:
    df = sy_e(spark, sf_dir).withColumn("e1", D.residual(F.col("y"), [(SECOND[0], F.lit(1.0)), (SECOND[1], F.col("x1"))]))
    prior = D.softmax([ALPHA[0] + ALPHA[1] * F.col("w1"), F.lit(0.0)])
    l0, l1 = D.log_density_hn(F.col("e"), u2(), v2()), D.log_density_hn(F.col("e1"), F.lit(S2U1), F.lit(S2V1))
    df = df.withColumns({"p0": prior[0], "l0": l0, "l1": l1})
    return df.withColumns({"j0": F.log("p0") + F.col("l0"), "j1": F.log(1 - F.col("p0")) + F.col("l1")})


@query("class_prior", f"{LC_SQL} SELECT id, time::BIGINT AS time, {r('p0')} AS p0, {r('1 - p0')} AS p1 FROM c")
def _(spark, sf_dir):
    return rounded(classes(spark, sf_dir).select("id", "time", "p0", (1 - F.col("p0")).alias("p1")))


@query("class_transitions", f"""{SY}, s AS (SELECT id, time::BIGINT AS time, exp(-1.0 + 2.0 * z1) AS a, exp(-1.5 - w1) AS b FROM sy)
SELECT id, time, {r('1 / (1 + a)')} AS p11, {r('a / (1 + a)')} AS p12, {r('b / (1 + b)')} AS p21, {r('1 / (1 + b)')} AS p22 FROM s""")
def _(spark, sf_dir):
    p = D.transitions([[-1.0 + 2.0 * F.col("z1")], [-1.5 - F.col("w1")]])
    return rounded(supplier_year(spark, sf_dir).select("id", F.col("time").cast("long").alias("time"), *[p[i][j].alias(f"p{i + 1}{j + 1}") for i in (0, 1) for j in (0, 1)]))


@query("lc_posterior", f"{LC_SQL} SELECT id, time::BIGINT AS time, {r('1 / (1 + exp(j1 - j0))', 5)} AS tau0, {r('1 / (1 + exp(j0 - j1))', 5)} AS tau1 FROM j")
def _(spark, sf_dir):
    tau = D.softmax([F.col("j0"), F.col("j1")])
    return rounded(classes(spark, sf_dir).select("id", "time", tau[0].alias("tau0"), tau[1].alias("tau1")), 5)


@query("lc_cross_loglik", f"{LC_SQL} SELECT {r('sum(greatest(j0, j1) + ln(exp(j0 - greatest(j0, j1)) + exp(j1 - greatest(j0, j1))))', 4)} AS loglik FROM j")
def _(spark, sf_dir):
    return rounded(classes(spark, sf_dir).agg(F.sum(D.log_add([F.col("j0"), F.col("j1")])).alias("loglik")), 4)


@query("segmentation_gradient", f"{LC_SQL} SELECT {r('sum(1 / (1 + exp(j1 - j0)) - p0)', 4)} AS g_0, {r('sum((1 / (1 + exp(j1 - j0)) - p0) * w1)', 5)} AS g_w1 FROM j")
def _(spark, sf_dir):
    gap = D.softmax([F.col("j0"), F.col("j1")])[0] - F.col("p0")
    g = classes(spark, sf_dir).agg(F.sum(gap).alias("g_0"), F.sum(gap * F.col("w1")).alias("g_w1"))
    return g.select((F.round("g_0", 4) + 0.0).alias("g_0"), (F.round("g_w1", 5) + 0.0).alias("g_w1"))


M_SQL, SD = f"(-e * {S2U / S2!r})", math.sqrt(S2U * S2V / S2)
JLMS_SQL = f"({M_SQL} + {SD!r} * exp(-0.5 * ({M_SQL} / {SD!r}) ^ 2) / sqrt(2 * pi()) / ({norm_cdf_sql(f'({M_SQL} / {SD!r})')}))"
BC_SQL = f"(exp(-{M_SQL} + {0.5 * SD * SD!r}) * ({norm_cdf_sql(f'({M_SQL} / {SD!r} - {SD!r})')}) / ({norm_cdf_sql(f'({M_SQL} / {SD!r})')}))"


@query("jlms_inefficiency", f"{SYE} SELECT id, time::BIGINT AS time, {r(JLMS_SQL)} AS u FROM e")
def _(spark, sf_dir):
    return rounded(sy_e(spark, sf_dir).select("id", "time", D.jlms(F.col("e"), u2(), v2()).alias("u")))


@query("bc_efficiency", f"{SYE} SELECT id, time::BIGINT AS time, {r(BC_SQL)} AS efficiency FROM e")
def bc_efficiency(spark, sf_dir):
    return rounded(sy_e(spark, sf_dir).select("id", "time", D.battese_coelli(F.col("e"), u2(), v2()).alias("efficiency")))


M1_SQL, SD1 = f"(-e1 * {S2U1 / S21!r})", math.sqrt(S2U1 * S2V1 / S21)
BC1_SQL = f"(exp(-{M1_SQL} + {0.5 * SD1 * SD1!r}) * ({norm_cdf_sql(f'({M1_SQL} / {SD1!r} - {SD1!r})')}) / ({norm_cdf_sql(f'({M1_SQL} / {SD1!r})')}))"


@query("lc_weighted_efficiency", f"{LC_SQL} SELECT id, time::BIGINT AS time, {r(f'{BC_SQL} / (1 + exp(j1 - j0)) + {BC1_SQL} / (1 + exp(j0 - j1))', 5)} AS efficiency FROM j")
def _(spark, sf_dir):
    tau = D.softmax([F.col("j0"), F.col("j1")])
    e = tau[0] * D.battese_coelli(F.col("e"), u2(), v2()) + tau[1] * D.battese_coelli(F.col("e1"), F.lit(S2U1), F.lit(S2V1))
    return rounded(classes(spark, sf_dir).select("id", "time", e.alias("efficiency")), 5)


@query("modal_class", f"{LC_SQL}, f AS (SELECT id, sum(j0) AS a, sum(j1) AS b FROM j GROUP BY id) SELECT id, time::BIGINT AS time, CASE WHEN a >= b THEN 0 ELSE 1 END::BIGINT AS modal FROM j JOIN f USING (id)")
def _(spark, sf_dir):
    df = classes(spark, sf_dir)
    firm = df.groupBy("id").agg(F.when(F.sum("j0") >= F.sum("j1"), 0).otherwise(1).cast("long").alias("modal"))
    return df.select("id", F.col("time").cast("long").alias("time")).join(firm, "id")


@query("overall_efficiency_join", f"""{SYE}, t AS (SELECT id, time, {BC_SQL} AS transient FROM e), m AS (SELECT id, time, avg(e) OVER (PARTITION BY id) AS e FROM e WHERE time < 2001), p AS (SELECT id, time, {BC_SQL} AS persistent FROM m)
SELECT id, t.time::BIGINT AS time, {r('transient')} AS transient, {r('persistent')} AS persistent, {r('transient * persistent')} AS overall FROM t LEFT JOIN p USING (id, time)""")
def _(spark, sf_dir):
    """The persistent part in two steps: the firms' mean residuals are composed errors of their own."""
    e = sy_e(spark, sf_dir)
    transient = e.select("id", "time", D.battese_coelli(F.col("e"), u2(), v2()).alias("transient"))
    means = e.filter("time < 2001").select("id", "time", F.avg("e").over(Window.partitionBy("id")).alias("e"))
    persistent = means.select("id", "time", D.battese_coelli(F.col("e"), u2(), v2()).alias("persistent"))
    return rounded(transient.join(persistent, ["id", "time"], "left").withColumn("overall", F.col("transient") * F.col("persistent")))


SIGMAS_SQL = f"{SY}, s AS (SELECT exp({GU} + 2.0 * z1) AS su2, exp({GV} - 1.0 * w1) AS sv2 FROM sy)"


@query("sigma_summary", f"{SIGMAS_SQL} SELECT {r('avg(sqrt(su2))')} AS sigma_u, {r('avg(sqrt(sv2))')} AS sigma_v, {r('avg(sqrt(su2 / sv2))')} AS lambda FROM s")
def _(spark, sf_dir):
    df = supplier_year(spark, sf_dir).select(P.variance([F.lit(1.0), "z1"], [GU, 2.0]).alias("su2"), P.variance([F.lit(1.0), "w1"], [GV, -1.0]).alias("sv2"))
    return rounded(df.agg(F.avg(F.sqrt("su2")).alias("sigma_u"), F.avg(F.sqrt("sv2")).alias("sigma_v"), F.avg(F.sqrt(F.col("su2") / F.col("sv2"))).alias("lambda")))


@query("marginal_effects_wang_hn", f"{SIGMAS_SQL.replace('SELECT exp', 'SELECT id, time, exp', 1)} SELECT id, time::BIGINT AS time, {r('2.0 * sqrt(su2) / 2 * sqrt(2 / pi())')} AS zuit_z1 FROM s")
def _(spark, sf_dir):
    df = supplier_year(spark, sf_dir)
    return rounded(df.select("id", "time", D.wang_hn(2.0, P.variance([F.lit(1.0), "z1"], [GU, 2.0])).alias("zuit_z1")))


@query("marginal_effects_wang_tn", f"""{SY}, m AS (SELECT id, time, 0.05 + 0.5 * z1 AS mu, exp({GU} + 2.0 * z1) AS su2 FROM sy), l AS (SELECT *, mu / sqrt(su2) AS l FROM m),
a AS (SELECT *, exp(-0.5 * l * l) / sqrt(2 * pi()) / ({norm_cdf_sql('l')}) AS a FROM l)
SELECT id, time::BIGINT AS time, {r('0.5 * (1 - l * a - a * a) + 2.0 * sqrt(su2) / 2 * ((1 + l * l) * a + l * a * a)')} AS zuit_z1 FROM a""")
def _(spark, sf_dir):
    mu = 0.05 + 0.5 * F.col("z1")
    return rounded(supplier_year(spark, sf_dir).select("id", "time", D.wang_tn(0.5, 2.0, mu, P.variance([F.lit(1.0), "z1"], [GU, 2.0])).alias("zuit_z1")))


@query("bootstrap_percentile_index", f"{CY}, s AS (SELECT id, list_sort(list(y)) AS v, count(*) AS n FROM cy GROUP BY id) SELECT id, {r('v[1 + floor(0.025 * n)::INTEGER]')} AS low, {r('v[1 + least(floor(0.975 * n)::INTEGER, n - 1)]')} AS high FROM s")
def _(spark, sf_dir):
    lists = customer_year(spark, sf_dir).groupBy("id").agg(F.sort_array(F.collect_list("y")).alias("v"))
    at = lambda p: F.get("v", F.least(F.floor(p * F.size("v")), F.size("v") - 1).cast("int"))
    return rounded(lists.select("id", at(0.025).alias("low"), at(0.975).alias("high")))


@query("lr_test_df2", f"""{SYE}, a AS (SELECT sum({HN_SQL}) AS big FROM e), b AS (SELECT sum(-0.5 * ln(2 * pi() * 0.0075) - 0.5 * e * e / 0.0075) AS small FROM e)
SELECT {r('greatest(0.0, 2 * (big - small))', 4)} AS d, {r('exp(-greatest(0.0, 2 * (big - small)) / 2)')} AS p FROM a, b""")
def _(spark, sf_dir):
    big = F.sum(D.log_density_hn(F.col("e"), u2(), v2()))
    small = F.sum(-0.5 * math.log(2 * math.pi * 0.0075) - 0.5 * F.col("e") * F.col("e") / 0.0075)
    d = F.greatest(F.lit(0.0), 2 * (big - small))
    return sy_e(spark, sf_dir).agg((F.round(d, 4) + 0.0).alias("d"), (F.round(F.exp(-d / 2), 6) + 0.0).alias("p"))


@query("aic_bic", f"{SYE}, l AS (SELECT sum({HN_SQL}) AS l, count(*) AS n FROM e) SELECT {r('-2 * l + 2 * 4', 4)} AS aic, {r('-2 * l + 4 * ln(n)', 4)} AS bic FROM l")
def _(spark, sf_dir):
    ll = sy_e(spark, sf_dir).agg(F.sum(D.log_density_hn(F.col("e"), u2(), v2())).alias("l"), F.count("*").alias("n"))
    return rounded(ll.select((-2 * F.col("l") + 2 * 4).alias("aic"), (-2 * F.col("l") + 4 * F.log("n")).alias("bic")), 4)


@query("search_top_k", f"{SY}, s AS (SELECT id * 10000 + time AS seed, CASE WHEN id % 7 = 0 THEN 'nan'::DOUBLE ELSE y END AS ll FROM sy) SELECT seed::BIGINT AS seed, {r('ll')} AS ll FROM s WHERE isfinite(ll) ORDER BY ll DESC, seed LIMIT 30")
def _(spark, sf_dir):
    ll = F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("y"))
    df = supplier_year(spark, sf_dir).select((F.col("id") * 10000 + F.col("time")).cast("long").alias("seed"), ll.alias("ll"))
    return rounded(df.filter(~F.isnan("ll")).orderBy(F.desc("ll"), "seed").limit(30))


@query("mc_metrics", f"""{CY} SELECT time::BIGINT AS parameter, {r('avg(y) - 12.0')} AS bias, {r('sqrt(avg((y - 12.0) ^ 2))')} AS rmse, {r('stddev_samp(y)')} AS sd, {r('avg(abs(y - 12.0))')} AS mae,
{r('median(y) - 12.0')} AS median_bias, {r('avg(CASE WHEN abs(y - 12.0) <= 1.96 * 0.5 THEN 1.0 ELSE 0.0 END)')} AS coverage, {r('(avg(y) - 12.0) / 12.0')} AS relative_bias FROM cy GROUP BY time""")
def _(spark, sf_dir):
    return rounded(estimate_metrics(customer_year(spark, sf_dir), ["time"], F.col("y"), F.lit(12.0), F.lit(0.5)).withColumnRenamed("time", "parameter"))


def estimate_metrics(df: DataFrame, keys: list[str], estimate: Column, truth: Column, se: Column) -> DataFrame:
    """Bias, RMSE, sd, MAE, median bias, coverage of 95 % intervals and relative bias of replicated estimates."""
    error = estimate - truth
    mean, first = F.avg(error), F.first(truth)
    return df.groupBy(*keys).agg(
        mean.alias("bias"), F.sqrt(F.avg(error * error)).alias("rmse"), F.stddev_samp(estimate).alias("sd"), F.avg(F.abs(error)).alias("mae"), F.percentile(error, F.lit(0.5)).alias("median_bias"),
        F.avg((F.abs(error) <= 1.96 * se).cast("double")).alias("coverage"), (mean / first).alias("relative_bias"),
    )


@query("concavity_minors", f"""{SY}, h AS (SELECT id, time, -0.3 + x2 * 0.01 AS a, 0.05 * x1 AS b, -0.2 - z1 AS c, -0.4 + w1 AS d, 0.1 * z1 AS e, 0.02 * x2 AS f FROM sy)
SELECT id, time::BIGINT AS time, a <= 1e-8 AND a * d - b * b >= -1e-8 AND a * (d * c - e * e) - b * (b * c - e * f) + f * (b * e - d * f) <= 1e-8 AS concave FROM h""")
def _(spark, sf_dir):
    x1, x2, z1, w1 = map(F.col, ("x1", "x2", "z1", "w1"))
    return supplier_year(spark, sf_dir, sizes=True).select("id", F.col("time").cast("long").alias("time"), concave(-0.3 + x2 * 0.01, 0.05 * x1, 0.02 * x2, -0.4 + w1, 0.1 * z1, -0.2 - z1).alias("concave"))


def concave(h11: Column, h12: Column, h13: Column, h22: Column, h23: Column, h33: Column, tolerance: float = 1e-8) -> Column:
    """Whether a symmetric 3 x 3 matrix is negative semidefinite by its leading minors."""
    second = h11 * h22 - h12 * h12
    third = h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13)
    return (h11 <= tolerance) & (second >= -tolerance) & (third <= tolerance)


@query("summary_unpivot", f"{SY}, s AS (SELECT avg(y) AS y, avg(x1) AS x1, avg(x2) AS x2 FROM sy) SELECT term, {r('value')} AS value FROM s UNPIVOT (value FOR term IN (y, x1, x2))")
def _(spark, sf_dir):
    means = supplier_year(spark, sf_dir, sizes=True).agg(*[F.avg(c).alias(c) for c in ("y", "x1", "x2")])
    return rounded(means.unpivot([], ["y", "x1", "x2"], "term", "value"))


@query("rescaled", f"{SY} SELECT id, time::BIGINT AS time, {r('(x1 - min(x1) OVER ()) / (max(x1) OVER () - min(x1) OVER ())')} AS x1 FROM sy")
def _(spark, sf_dir):
    return rounded(P.rescaled(supplier_year(spark, sf_dir), "x1").select("id", "time", "x1"))


@query("swept_columns", f"{SY} SELECT id, time::BIGINT AS time, {r('y - avg(y) OVER ()')} AS y, {r('x1 - avg(x1) OVER ()')} AS x1 FROM sy")
def _(spark, sf_dir):
    return rounded(P.swept(supplier_year(spark, sf_dir).select("id", "time", "y", "x1"), ["y", "x1"]))


@query("swept_rows", f"{SY} SELECT id, time::BIGINT AS time, {r('y - (y + x1) / 2')} AS y, {r('x1 - (y + x1) / 2')} AS x1 FROM sy")
def _(spark, sf_dir):
    return rounded(P.swept(supplier_year(spark, sf_dir).select("id", "time", "y", "x1"), ["y", "x1"], rows=True))


@query("repeated_rows", f"{CY}, p AS (SELECT id, count(*) AS t FROM cy GROUP BY id) SELECT id, unnest(range(1, t + 1)) AS place FROM p")
def _(spark, sf_dir):
    sizes = customer_year(spark, sf_dir).groupBy("id").agg(F.count("*").alias("t"))
    return P.repeated(sizes, F.col("t")).select("id", "place")


@query("segment_first_row", f"{CY} SELECT id, arg_min(x1, time) AS seg FROM cy GROUP BY id")
def _(spark, sf_dir):
    return customer_year(spark, sf_dir).groupBy("id").agg(F.min_by("x1", "time").alias("seg"))


@query("kumbhakar_sun_effects", f"""{SYE}, m AS (SELECT id, time, {M_SQL} / {SD!r} AS m, {M_SQL} AS mu FROM e), h AS (SELECT *, exp(-0.5 * m * m) / sqrt(2 * pi()) / ({norm_cdf_sql('m')}) AS h FROM m),
d AS (SELECT *, mu * {S2V / S2!r} * 2.0 AS dm, {0.5 * SD * S2V / S2!r} * 2.0 AS ds FROM h) SELECT id, time::BIGINT AS time, {r(f'dm + ds * h - {SD!r} * h * (m + h) * (dm - m * ds) / {SD!r}')} AS zuit_z1 FROM d""")
def _(spark, sf_dir):
    return rounded(sy_e(spark, sf_dir).select("id", "time", D.kumbhakar_sun_hn(2.0, F.col("e"), u2(), v2()).alias("zuit_z1")))


#: True random effects and four components on the suppliers' panel, with the default number of draws.
TRE = FR.Frontier("y", ["x1"])
GTRE = FR.Frontier("y", ["x1"], persistent=True)


def table(found: FR.Fit, spark: SparkSession) -> DataFrame:
    """Estimates, the log-likelihood, whether the search converged, why it ended, and the terms on the boundary."""
    return found.table(spark).withColumn("loglik", F.lit(found.loglik)).withColumn("converged", F.lit(found.converged)).withColumn("ended", F.lit(found.reason)).withColumn("boundary", F.lit(", ".join(found.boundary())))


@query("fit_tre", None)
def _(spark, sf_dir):
    """term, estimate, std_error (clustered by firm), t, p_value and interval, and whether the fit converged."""
    return table(FR.fit(supplier_year(spark, sf_dir), TRE), spark)


def _scrambled_sql(model: FR.Frontier, base: int, n: str) -> str:
    """The scrambled number at place n, digit by digit as far as doubles tell."""
    digits = [int(d) for d in FR.scrambled_digits(model, base)]
    places = sum(base ** -(k + 1) > 1e-16 for k in range(60))
    return f"list_sum(list_transform(range({places}), lambda k: {digits}[1 + ({n} // pow({base}, k)::BIGINT) % {base}] * pow({1 / base!r}, k + 1)))"


@query("gtre_scores", f"""{SYE}, i AS (SELECT id, r, (row_number() OVER (ORDER BY id) - 1) * {GTRE.draws} + r + {GTRE.burn_in + 1} AS n FROM (SELECT DISTINCT id FROM sy), (SELECT 0 AS r)),
d AS (SELECT id, g.r AS r, n + g.r AS n FROM i, range({GTRE.draws}) g(r)), h AS (SELECT id, r, {_scrambled_sql(GTRE, 2, 'n')} AS p, {_scrambled_sql(GTRE, 3, 'n')} AS q FROM d),
w AS (SELECT id, r, {ndtri_sql('p')} AS v, abs({ndtri_sql('q')}) AS u FROM (SELECT id, r, greatest(1e-12, least(1 - 1e-12, p)) AS p, greatest(1e-12, least(1 - 1e-12, q)) AS q FROM h)),
l AS (SELECT id, time, r, {HN_SQL} AS l, {JLMS_SQL} AS u, {BC_SQL} AS b FROM (SELECT e.id, time, r, e - {SV!r} * v + {SU!r} * u AS e FROM e JOIN w ON e.id = w.id)),
s AS (SELECT id, r, sum(l) AS s FROM l GROUP BY id, r), z AS (SELECT id, r, exp(s - max(s) OVER (PARTITION BY id)) AS z FROM s), t AS (SELECT id, sum(z) AS t FROM z GROUP BY id)
SELECT l.id, l.time::BIGINT AS time, {r('sum(z / t * u)', 5)} AS inefficiency, {r('sum(z / t * b)', 5)} AS efficiency FROM l JOIN z ON l.id = z.id AND l.r = z.r JOIN t ON l.id = t.id GROUP BY l.id, l.time""")
def _(spark, sf_dir):
    """Inefficiency and efficiency of each supplier and year at fixed four-component parameters."""
    return rounded(FR.efficiencies(supplier_year(spark, sf_dir), np.array([B0, B1, GU, GV, GV, GU]), GTRE), 5)


#: A firm's likelihood in SQL as a dense sum over its effect v, and in the operators by adaptive quadrature.
QUADRATURE = FR.Frontier("y", ["x1"], effect="quadrature")
LOG_S2V0 = 2 * math.log(SV0)
LC_PANEL = mixture.Mixture(QUADRATURE, 2)
LC_THETA = np.array([ALPHA[0], B0, B1, GU, GV, LOG_S2V0, *SECOND, LOG_S2V0])
CROSS = FR.Frontier("y", ["x1"], zuit=["z1"], effect="none")
LC_CROSS = mixture.Mixture(FR.Frontier("y", ["x1"], effect="none"), 2, ["w1"])


def _dense_sql(e: str, density: str, name: str) -> str:
    """(id, l): log-likelihood of each firm, over 801 values of v."""
    return f"""{name}v AS (SELECT id, i * 0.02 AS v, {e} - {SV0!r} * i * 0.02 AS {e} FROM e, range(-400, 401) g(i)), {name}p AS (SELECT id, v, sum({density}) - 0.5 * v * v AS l FROM {name}v GROUP BY id, v),
{name} AS (SELECT id, max(l) + ln(sum(exp(l - m))) + ln(0.02) - 0.5 * ln(2 * pi()) AS l FROM (SELECT *, max(l) OVER (PARTITION BY id) AS m FROM {name}p) GROUP BY id)"""


LC_PANEL_SQL = f"""{SY}, e AS (SELECT *, {E_SQL} AS e, y - {SECOND[0]} - {SECOND[1]} * x1 AS e1 FROM sy), {_dense_sql('e', HN_SQL, 'a')}, {_dense_sql('e1', HN1_SQL, 'b')},
j AS (SELECT id, a.l + ln(1 / (1 + exp(-({ALPHA[0]})))) AS j0, b.l + ln(1 - 1 / (1 + exp(-({ALPHA[0]})))) AS j1 FROM a JOIN b USING (id))"""


@query("tre_quadrature_loglik", f"{SYE}, {_dense_sql('e', HN_SQL, 'a')} SELECT {r('sum(l)', 3)} AS loglik FROM a")
def _(spark, sf_dir):
    """Log-likelihood of a true-random-effects panel by adaptive Gauss-Hermite quadrature, at fixed parameters."""
    rows = FR.prepared(supplier_year(spark, sf_dir), QUADRATURE)
    found = FR.evaluate(rows, [np.array([B0, B1, GU, GV, LOG_S2V0])], QUADRATURE)[0]
    return spark.createDataFrame([(round(found.loglik, 3),)], "loglik double")


@query("lc_panel_loglik", f"{LC_PANEL_SQL} SELECT {r('sum(greatest(j0, j1) + ln(exp(j0 - greatest(j0, j1)) + exp(j1 - greatest(j0, j1))))', 3)} AS loglik FROM j")
def _(spark, sf_dir):
    """Log-likelihood of a panel with two latent classes of firms, at fixed parameters."""
    rows = FR.prepared(supplier_year(spark, sf_dir), LC_PANEL)
    return spark.createDataFrame([(round(FR.evaluate(rows, [LC_THETA], LC_PANEL)[0].loglik, 3),)], "loglik double")


@query("lc_panel_posterior", f"{LC_PANEL_SQL} SELECT id, time::BIGINT AS time, {r('1 / (1 + exp(j1 - j0))', 5)} AS tau0, {r('1 / (1 + exp(j0 - j1))', 5)} AS tau1 FROM j JOIN sy USING (id)")
def _(spark, sf_dir):
    """Posterior class of each firm, by its whole series."""
    found = mixture.posteriors(supplier_year(spark, sf_dir), LC_THETA, LC_PANEL)
    tau = [F.sum(F.when(F.col("class") == c, F.col("posterior")).otherwise(0.0)).alias(f"tau{c - 1}") for c in (1, 2)]
    return rounded(found.groupBy("id", "time").agg(*tau), 5)


@query("design_matrix", f"""{SY} SELECT id, time::BIGINT AS time, {r('y')} AS y, 1.0::DOUBLE AS _cons, {r('x1')} AS x1, {r('z1')} AS z1, {r('x1 * z1')} AS x1_z1, {r('ln(w1 + 1)')} AS log_w1,
CASE WHEN time = 1996 THEN 1.0 ELSE 0.0 END::DOUBLE AS time_1996, {r('CASE WHEN time = 1996 THEN x1 ELSE 0.0 END')} AS time_1996_x1 FROM sy""")
def _(spark, sf_dir):
    """Columns of y ~ x1 * z1 + log(w1 + 1) + C(time) + C(time):x1, some of them."""
    made = formula.design(supplier_year(spark, sf_dir), "y ~ x1 * z1 + log(w1 + 1) + C(time) + C(time):x1", ["id", "time"])
    picked = {"x1:z1": "x1_z1", "log(w1 + 1)": "log_w1", "time[1996]": "time_1996", "time[1996]:x1": "time_1996_x1"}
    return rounded(made.select("id", "time", "y", "_cons", "x1", "z1", *[F.col(f"`{a}`").alias(b) for a, b in picked.items()]))


_CHI_SQL = {1: "2 * (1 - (" + norm_cdf_sql("sqrt(d1)") + "))", 3: "2 * (1 - (" + norm_cdf_sql("sqrt(d3)") + ")) + sqrt(2 * d3 / pi()) * exp(-d3 / 2)"}


@query("lr_tests", f"""{SY}, d AS (SELECT time, -count(*) * ln(1 - corr(y, z1) ^ 2) AS d1, -count(*) * (ln(1 - corr(y, z1) ^ 2) + ln(1 - corr(y, w1) ^ 2) + ln(1 - corr(z1, w1) ^ 2)) AS d3 FROM sy GROUP BY time)
SELECT time::BIGINT AS time, {r('d1', 5)} AS d1, {r(_CHI_SQL[1], 5)} AS p1, {r('d3', 5)} AS d3, {r(_CHI_SQL[3], 5)} AS p3 FROM d""")
def _(spark, sf_dir):
    """Likelihood-ratio tests by year that revenue, discount and tax are uncorrelated: the first pair alone, and all three in turn; a row a year."""
    fall = lambda a, b: -F.count("*") / 2 * F.log(1 - F.pow(F.corr(a, b), 2.0))
    by_year = supplier_year(spark, sf_dir).groupBy("time").agg(fall("y", "z1").alias("a"), (fall("y", "z1") + fall("y", "w1") + fall("z1", "w1")).alias("b"))
    out = []
    for row in by_year.collect():
        (d1, _, p1), (d3, _, p3) = inference.likelihood_ratio((0.0, 2), (row["a"], 3)), inference.likelihood_ratio((row["b"], 5), (0.0, 2))
        out.append((int(row["time"]), d1, p1, d3, p3))
    return rounded(spark.createDataFrame(out, "time long, d1 double, p1 double, d3 double, p3 double"), 5)


@query("fit_cross", None)
def _(spark, sf_dir):
    """A cross-section frontier over all rows, with a determinant of inefficiency."""
    return table(FR.fit(supplier_year(spark, sf_dir), CROSS), spark)


@query("fit_truncated", None)
def _(spark, sf_dir):
    """A cross-section frontier over all rows with truncated-normal inefficiency."""
    return table(FR.fit(supplier_year(spark, sf_dir), FR.Frontier("y", ["x1"], effect="none", distribution="truncated")), spark)


TFE = FR.Frontier("y", ["x1"], effect="fixed")


@query("fit_tfe", None)
def _(spark, sf_dir):
    """True fixed effects: each supplier has an effect of its own."""
    return table(FR.fit(supplier_year(spark, sf_dir), TFE), spark)


@query("fit_lc_cross", None)
def _(spark, sf_dir):
    """Two latent classes of rows."""
    return table(mixture.fit(supplier_year(spark, sf_dir), LC_CROSS), spark)


@query("fit_lctre", None)
def _(spark, sf_dir):
    """Two latent classes of firms with random effects, by adaptive quadrature."""
    return table(mixture.fit(supplier_year(spark, sf_dir), LC_PANEL), spark)


@query("efficiency_colombi", None)
def _(spark, sf_dir):
    """Persistent, transient and overall efficiency of each supplier and year at fixed four-component parameters."""
    return colombi.efficiencies(supplier_year(spark, sf_dir), np.array([B0, B1, GU, GV, GV, GU]), GTRE)


@query("search_starts", None)
def _(spark, sf_dir):
    """Fifty start values of a cross-section frontier, each fitted: its log-likelihood, its fit's, and whether that converged."""
    return inference.search(supplier_year(spark, sf_dir), CROSS).table


@query("bootstrap_effects", None)
def _(spark, sf_dir):
    """Mean marginal effect of discounts on inefficiency, with a parametric bootstrap interval of fifty refits."""
    panel = supplier_year(spark, sf_dir)
    return inference.bootstrap_effects(panel, FR.fit(panel, CROSS), CROSS)


@query("table_order", f"{CY} SELECT id, time::BIGINT AS time, row_number() OVER (ORDER BY id, time) - 1 AS place FROM cy")
def _(spark, sf_dir):
    """Place of each row in the order of the whole table."""
    return P.numbered(customer_year(spark, sf_dir).select("id", F.col("time").cast("long").alias("time")), ["id", "time"], "place")


KMEANS_STEPS = 60
_Z_SQL = SYE + FEATURES_SQL + ", z AS (SELECT id, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in FEATURES) + " FROM f)"
_NEAR_SQL = " <= ".join("(" + " + ".join(f"({c} - {c}{k}) ^ 2" for c in FEATURES) + ")" for k in (0, 1))
_MEANS_SQL = ", ".join(f"coalesce(avg({c}) FILTER (near), any_value({c}0)) AS {c}0, coalesce(avg({c}) FILTER (NOT near), any_value({c}1)) AS {c}1" for c in FEATURES)
_CENTRES_SQL = ", ".join(f"{c}{k}" for c in FEATURES for k in (0, 1))


@query("kmeans_fixed_point", f"""{_Z_SQL.replace('WITH', 'WITH RECURSIVE', 1)}, k AS (
  SELECT 0 AS step, {', '.join(f"{cs[i]}::DOUBLE AS {c}{k}" for i, c in enumerate(FEATURES) for k, cs in enumerate(CENTROIDS))}
  UNION ALL SELECT step + 1, {_CENTRES_SQL} FROM (SELECT any_value(step) AS step, {_MEANS_SQL} FROM (SELECT *, {_NEAR_SQL} AS near FROM z, k WHERE step < {KMEANS_STEPS})) WHERE step IS NOT NULL)
SELECT id, CASE WHEN {_NEAR_SQL} THEN 0 ELSE 1 END::BIGINT AS cluster FROM z, k WHERE step = {KMEANS_STEPS}""")
def _(spark, sf_dir):
    """Two clusters of the firms' features: means and assignments in turn until none moves."""
    z = standardized(firm_features(sy_e(spark, sf_dir)), list(FEATURES)).select("id", F.array(*FEATURES).alias("features"))
    centres, _ = kmeans.lloyd(z, np.array(CENTROIDS), KMEANS_STEPS, 0.0)
    return kmeans.assigned(z, centres).select("id", F.col("cluster").cast("long").alias("cluster"))


#: Digits of base 3 in the order that a seed gives them, as a fixed list for SQL.
SCRAMBLED = FR.Frontier("y", ["x1"], draws=4)
DIGITS = [int(d) for d in np.random.default_rng([SCRAMBLED.seed, 3]).permutation(3)]


@query("halton_scrambled", f"""WITH i AS (SELECT s_suppkey AS id, (dense_rank() OVER (ORDER BY s_suppkey) - 1) * 4 + r + 1001 AS n, r FROM supplier, range(4) g(r))
SELECT id, r::BIGINT AS r, round(sum([{', '.join(map(str, DIGITS))}][1 + (n // pow(3, k)::BIGINT) % 3] * (1.0::DOUBLE / 3) ** (k + 1)), 9) + 0.0 AS u FROM i, range(33) d(k) GROUP BY id, r""")
def _(spark, sf_dir):
    """Four scrambled numbers of base 3 for each supplier, by its place among them."""
    ids = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return FR.uniform_rows(P.factorize(ids, "id", "rank"), SCRAMBLED, 3).select("id", "r", (F.round("u", 9) + 0.0).alias("u"))


def hn_sql(e: str, s2u: str, s2v: str) -> str:
    """Half-normal log density with variances as expressions."""
    return f"ln(2.0) - 0.5 * ln({s2u} + {s2v}) - 0.5 * ln(2 * pi()) - 0.5 * {e} * {e} / ({s2u} + {s2v}) + ln({norm_cdf_sql(f'(-{e} * sqrt({s2u} / ({s2v} * ({s2u} + {s2v}))))')})"


#: Effects of a firm at fixed slope and variances: where the sum of its rows' scores is zero, by halving.
@query("tfe_effects", f"""{SY.replace('WITH', 'WITH RECURSIVE', 1)}, e AS (SELECT id, y - {B1!r} * x1 AS e FROM sy), b AS (
  SELECT id, 0 AS k, min(e) - 2.0 AS lo, max(e) + 2.0 AS hi FROM e GROUP BY id
  UNION ALL SELECT id, k + 1, CASE WHEN g > 0 THEN mid ELSE lo END, CASE WHEN g > 0 THEN hi ELSE mid END FROM (
    SELECT id, any_value(k) AS k, any_value(lo) AS lo, any_value(hi) AS hi, any_value(mid) AS mid, sum(d / {S2!r} + exp(-0.5 * a * a) / sqrt(2 * pi()) / ({norm_cdf_sql('a')}) * {LAMBDA / SIGMA!r}) AS g
    FROM (SELECT id, k, lo, hi, mid, d, -d * {LAMBDA / SIGMA!r} AS a FROM (SELECT b.id, k, lo, hi, (lo + hi) / 2 AS mid, e - (lo + hi) / 2 AS d FROM b JOIN e ON b.id = e.id WHERE k < 60)) GROUP BY id)
) SELECT id, {r('(lo + hi) / 2', 5)} AS effect FROM b WHERE k = 60""")
def _(spark, sf_dir):
    """Fixed effect of each supplier at given slope and variances."""
    return rounded(FR.fixed_effects(supplier_year(spark, sf_dir), np.array([B1, GU, GV]), TFE), 5)


@query("score_rows", f"{SCORE_SQL} SELECT id, time::BIGINT AS time, {r('g_b', 3)} AS b0, {r('g_b * x1', 3)} AS b1, {r('g_u', 5)} AS u, {r('g_v', 5)} AS v FROM g")
def _(spark, sf_dir):
    """The score of each row at fixed parameters, from the fit's own kernel."""
    model = FR.Frontier("y", ["x1"], effect="none")
    found = FR.score_rows(supplier_year(spark, sf_dir), np.array([B0, B1, GU, GV]), model)
    named = zip(model.terms(), ("b0", "b1", "u", "v"), (3, 3, 5, 5))
    return found.select("id", F.col("time").cast("long").alias("time"), *[(F.round(F.col(t), k) + 0.0).alias(n) for t, n, k in named])


@query("model_matrix", f"{SY} SELECT id, time::BIGINT AS time, {r('y')} AS y, 1.0::DOUBLE AS _cons, {r('x1')} AS x1, 1.0::DOUBLE AS zuit_cons_, {r('z1')} AS zuit_z1_, 1.0::DOUBLE AS zvit_cons_ FROM sy")
def _(spark, sf_dir):
    """Response and design of a frontier, a column for each term."""
    found = FR.model_matrix(supplier_year(spark, sf_dir), CROSS)
    return rounded(found.select("id", "time", "y", "_cons", "x1", *[F.col(c).alias(f"{c.lower()}_") for c in ("Zuit_cons", "Zuit_z1", "Zvit_cons")]))


#: Two classes of rows whose inefficiency depends on discounts.
LC_Z = mixture.Mixture(FR.Frontier("y", ["x1"], zuit=["z1"], effect="none"), 2)
LC_Z_THETA = np.array([ALPHA[0], B0, B1, GU, 2.0, GV, *SECOND[:3], 1.0, SECOND[3]])
LC_Z_SQL = f"""{SY}, e AS (SELECT *, {E_SQL} AS e, y - {SECOND[0]} - {SECOND[1]} * x1 AS e1, exp({GU} + 2.0 * z1) AS s0, exp({SECOND[2]} + z1) AS s1 FROM sy),
j AS (SELECT *, {hn_sql('e', 's0', repr(S2V))} + {ALPHA[0]} AS j0, {hn_sql('e1', 's1', repr(S2V1))} AS j1 FROM e),
m AS (SELECT *, 1 / (1 + exp(j1 - j0)) AS tau, 2.0 * sqrt(s0) / 2 * sqrt(2 / pi()) AS m0, 1.0 * sqrt(s1) / 2 * sqrt(2 / pi()) AS m1 FROM j)"""


@query("lc_marginal_effects", f"{LC_Z_SQL} SELECT id, time::BIGINT AS time, {r('tau * m0 + (1 - tau) * m1', 5)} AS zuit_z1, {r('m0', 5)} AS class1, {r('m1', 5)} AS class2 FROM m")
def _(spark, sf_dir):
    """Slope of expected inefficiency in discounts, weighted by posteriors and in each class."""
    found = inference.class_effects(supplier_year(spark, sf_dir), LC_Z_THETA, LC_Z)
    return rounded(found.select("id", F.col("time").cast("long").alias("time"), F.col("Zuit_z1").alias("zuit_z1"), F.col("Class1_Zuit_z1").alias("class1"), F.col("Class2_Zuit_z1").alias("class2")), 5)


@query("lc_sigmas", f"""{LC_Z_SQL}, t AS (SELECT avg(sqrt(s0)) AS a, {SV!r} AS b, avg(sqrt(s0 / {S2V!r})) AS c, avg(sqrt(s1)) AS d, {math.sqrt(S2V1)!r} AS e, avg(sqrt(s1 / {S2V1!r})) AS f FROM m)
SELECT unnest([1, 1, 1, 2, 2, 2]::BIGINT[]) AS class, unnest(['sigma_u', 'sigma_v', 'lambda', 'sigma_u', 'sigma_v', 'lambda']) AS term, round(unnest([a, b, c, d, e, f]), 5) + 0.0 AS value FROM t""")
def _(spark, sf_dir):
    """Mean standard deviations and their ratios in each class."""
    return rounded(inference.sigma_table(supplier_year(spark, sf_dir), LC_Z_THETA, LC_Z), 5)


#: With one period the firm effect is noise like the other, so classes' efficiencies have a closed form; LC_PANEL at LC_THETA, year 1996.
def _bc_sql(e: str, s2u: float, s2v: float) -> str:
    s2 = s2u + s2v
    m, sd = f"(-{e} * {s2u / s2!r})", math.sqrt(s2u * s2v / s2)
    return f"(exp(-{m} + {0.5 * sd * sd!r}) * ({norm_cdf_sql(f'({m} / {sd!r} - {sd!r})')}) / ({norm_cdf_sql(f'({m} / {sd!r})')}))"


@query("lc_colombi_efficiency", f"""{SY}, j AS (SELECT *, {hn_sql('e', repr(S2U), repr(S2V + SV0**2))} + {ALPHA[0]} AS j0, {hn_sql('e1', repr(S2U1), repr(S2V1 + SV0**2))} AS j1
  FROM (SELECT *, {E_SQL} AS e, y - {SECOND[0]} - {SECOND[1]} * x1 AS e1 FROM sy WHERE time = 1996))
SELECT id, round({_bc_sql('e', S2U, S2V + SV0**2)} / (1 + exp(j1 - j0)) + {_bc_sql('e1', S2U1, S2V1 + SV0**2)} / (1 + exp(j0 - j1)), 3) + 0.0 AS transient FROM j""")
def _(spark, sf_dir):
    """Transient efficiency of one year by orthant probabilities in each class, weighted by the posteriors."""
    found = colombi.class_efficiencies(supplier_year(spark, sf_dir).filter("time = 1996"), LC_THETA, LC_PANEL, draws=10_000)
    return found.select("id", (F.round("transient", 3) + 0.0).alias("transient"))


def _newton_sql(steps: int = 30) -> str:
    """Newton steps to the maximum of the half-normal likelihood of y on x1, as a recursive query: sums of scores and curvatures, then a
    4 x 4 system solved by elimination, column by column."""
    sums = {
        "g0": "-fe", "g1": "-fe * x1", "g2": "fa", "g3": "fb", "h00": "-ee", "h01": "-ee * x1", "h11": "-ee * x1 * x1", "h02": "ea", "h12": "ea * x1", "h03": "eb", "h13": "eb * x1",
        "h22": "-aa", "h23": "-ab", "h33": "-bb",
    }
    inner = f"""SELECT *, -(m * (w + m)) AS bend FROM (SELECT *, exp(-0.5 * w * w) / sqrt(2 * pi()) / ({norm_cdf_sql('w')}) AS m FROM (
      SELECT *, -e * k AS w FROM (SELECT *, sqrt(su / (sv * s2)) AS k, su / s2 AS pu, sv / s2 AS pv, 0.5 * sv / s2 AS ka, -0.5 * (1 + sv / s2) AS kb, e * e / s2 AS sq, su * sv / (s2 * s2) AS cr FROM (
        SELECT *, su + sv AS s2 FROM (SELECT n, t0, t1, t2, t3, x1, y - t0 - t1 * x1 AS e, exp(t2) AS su, exp(t3) AS sv FROM sy, it WHERE n < {steps})))))"""
    curves = f"""SELECT *, -e / s2 - k * m AS fe, (0.5 * sq - 0.5) * pu + m * w * ka AS fa, (0.5 * sq - 0.5) * pv + m * w * kb AS fb, -1 / s2 + bend * k * k AS ee,
      e * pu / s2 - k * ka * mx AS ea, e * pv / s2 - k * kb * mx AS eb, -0.5 * cr + 0.5 * sq * (cr - pu * pu) + w * (ka * ka * mx - 0.5 * m * cr) AS aa,
      0.5 * cr - sq * cr + w * (ka * kb * mx + 0.5 * m * cr) AS ab, -0.5 * cr + 0.5 * sq * (cr - pv * pv) + w * (kb * kb * mx - 0.5 * m * cr) AS bb FROM (SELECT *, m + bend * w AS mx FROM ({inner}))"""
    system = f"SELECT any_value(n) AS n, {', '.join(f'any_value(t{i}) AS t{i}' for i in range(4))}, {', '.join(f'sum({v}) AS {k}' for k, v in sums.items())} FROM ({curves})"
    for i in range(3):  # column i of the rows below
        rows = range(i + 1, 4)
        new = [f"h{a}{b} - h{i}{a} * h{i}{b} / h{i}{i} AS h{a}{b}" for a in rows for b in range(a, 4)] + [f"g{a} - h{i}{a} * g{i} / h{i}{i} AS g{a}" for a in rows]
        system = f"SELECT * REPLACE ({', '.join(new)}) FROM ({system})"
    for i in range(3, -1, -1):
        known = "".join(f" - h{i}{b} * d{b}" for b in range(i + 1, 4))
        system = f"SELECT *, (g{i}{known}) / h{i}{i} AS d{i} FROM ({system})"
    step = "least(1.0, 0.5 / greatest(abs(d0), abs(d1), abs(d2), abs(d3)))"
    return f"""{SY.replace('WITH', 'WITH RECURSIVE', 1)}, it AS (SELECT 0 AS n, {B0}::DOUBLE AS t0, {B1}::DOUBLE AS t1, {GU}::DOUBLE AS t2, {GV}::DOUBLE AS t3
    UNION ALL SELECT n + 1, {', '.join(f't{i} + d{i} * {step}' for i in range(4))} FROM ({system}) WHERE n IS NOT NULL)
    SELECT unnest(['_cons', 'x1', 'Zuit_cons', 'Zvit_cons']) AS term, round(unnest([t0, t1, t2, t3]), 4) + 0.0 AS estimate FROM it WHERE n = {steps}"""


@query("fit_cross_estimates", _newton_sql())
def _(spark, sf_dir):
    """Estimates of a half-normal cross-section frontier."""
    found = FR.fit(supplier_year(spark, sf_dir), FR.Frontier("y", ["x1"], effect="none"), options={"grad_err_tol": 1e-6})
    return rounded(found.table(spark).select("term", "estimate"), 4)


@query("firm_loglik", f"{SYE}, {_dense_sql('e', HN_SQL, 'a')} SELECT id, {r('l', 4)} AS loglik FROM a")
def _(spark, sf_dir):
    """Log-likelihood of each supplier with a random effect, by adaptive quadrature at fixed parameters."""
    found = FR.firm_logliks(supplier_year(spark, sf_dir), np.array([B0, B1, GU, GV, LOG_S2V0]), QUADRATURE)
    return rounded(found, 4)


@query("monte_carlo", None)
def _(spark, sf_dir):
    """Bias, spread and coverage of twenty fits to responses drawn from a cross-section frontier on the suppliers' inputs."""
    model = FR.Frontier("y", ["x1"], effect="none")
    found = inference.replicated_fits(supplier_year(spark, sf_dir), np.array([B0, B1, GU, GV]), model, 20).filter("converged")
    return rounded(estimate_metrics(found, ["term"], F.col("estimate"), F.col("truth"), F.col("std_error")))
