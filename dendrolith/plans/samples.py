"""Queries over posterior samples and regressions, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dendrolith.operators import samples as O
from dendrolith.plans import standins as S
from dendrolith.plans.standins import SAMPLES_SQL, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}
BASE = f"WITH {SAMPLES_SQL}"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"{BASE} SELECT chain, round(max(ll) + ln(sum(exp(ll - m))) - ln(count(*)), 6) AS lme FROM (SELECT *, max(ll) OVER (PARTITION BY chain) AS m FROM samples) GROUP BY chain")
def lse_mean(spark, sf):
    return rounded(O.log_mean_exp(S.samples(spark, sf), F.col("ll"), ["chain"]))


@query(f"{BASE} SELECT chain, round(ln(count(*)) + min(ll) - ln(sum(exp(m - ll))), 6) AS lhm FROM (SELECT *, min(ll) OVER (PARTITION BY chain) AS m FROM samples) GROUP BY chain")
def harmonic_mean(spark, sf):
    return rounded(O.log_harmonic_mean(S.samples(spark, sf), F.col("ll"), ["chain"]))


#: The fixed point by recursion over a chain's list of values, with the same stop.
SMOOTHED_SQL = f"""WITH RECURSIVE {SAMPLES_SQL}, v AS (SELECT chain, list(ll) AS v, count(*) AS n, max(ll) + ln(avg(exp(ll - m))) AS g FROM (SELECT *, max(ll) OVER (PARTITION BY chain) AS m FROM samples) GROUP BY chain),
step(chain, v, n, g, moved, k) AS (SELECT chain, v, n, g, 1.0::DOUBLE, 0 FROM v UNION ALL SELECT chain, v, n, new, abs(new - g), k + 1 FROM (
  SELECT *, g + ln((n * 0.01 / 0.99 + list_sum(list_transform(v, lambda x: exp(x - g) / (0.01 + 0.99 * exp(x - g))))) / (n * 0.01 / 0.99 + list_sum(list_transform(v, lambda x: 1 / (0.01 + 0.99 * exp(x - g)))))) AS new FROM step WHERE moved >= 1e-7 AND k < 10000))
SELECT chain, round(arg_max(g, k), 4) AS lml FROM step GROUP BY chain"""


@query(SMOOTHED_SQL)
def smoothed_harmonic_mean(spark, sf):
    """Iterated up to the usual stop, a chain at a time; ``smoothed_harmonic_root`` has no such limit."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chain": [pdf["chain"].iloc[0]], "lml": [O.smoothed_harmonic_mean(pdf["ll"].to_numpy())]})

    return rounded(S.samples(spark, sf).select("chain", "ll").groupBy("chain").applyInPandas(run, "chain string, lml double"), 4)


@query(f"""WITH RECURSIVE {SAMPLES_SQL}, v AS (SELECT chain, list(ll - m) AS v, count(*) AS n, any_value(m) AS m FROM (SELECT *, max(ll) OVER (PARTITION BY chain) AS m FROM samples) GROUP BY chain),
step(chain, v, n, m, low, high, k) AS (SELECT chain, v, n, m, list_min(v) - 1, 1.0::DOUBLE, 0 FROM v UNION ALL SELECT chain, v, n, m, CASE WHEN up > down THEN g ELSE low END, CASE WHEN up > down THEN high ELSE g END, k + 1 FROM (
  SELECT *, list_sum(list_transform(v, lambda x: exp(x - g) / (0.01 + 0.99 * exp(x - g)))) AS up, list_sum(list_transform(v, lambda x: 1 / (0.01 + 0.99 * exp(x - g)))) AS down FROM (SELECT *, (low + high) / 2 AS g FROM step WHERE k < 60)))
SELECT chain, round(m + (low + high) / 2, 4) AS lml FROM step WHERE k = 60""")
def smoothed_harmonic_root(spark, sf):
    """The fixed point itself, by sums over all chains at once."""
    return rounded(O.smoothed_harmonic_means(S.samples(spark, sf), "chain", "ll"), 4)


RUNGS_SQL = f"""{BASE}, r AS (SELECT beta, count(*) AS n, avg(ll) AS mean, var_samp(ll) AS var, max(ll) AS top FROM samples GROUP BY beta),
k AS (SELECT *, lead(beta) OVER (ORDER BY beta) AS nxt, lead(mean) OVER (ORDER BY beta) AS mean1, lead(var) OVER (ORDER BY beta) AS var1 FROM r)"""


@query(f"{RUNGS_SQL}, e AS (SELECT k.beta, max((nxt - k.beta) * top) + ln(avg(exp((nxt - k.beta) * (ll - top)))) AS r FROM k JOIN samples s ON s.beta = k.beta WHERE nxt IS NOT NULL GROUP BY k.beta) SELECT round(sum(r), 6) AS lml FROM e")
def stepping_stone(spark, sf):
    return rounded(O.stepping_stone(S.samples(spark, sf)))


@query(f"{RUNGS_SQL} SELECT round(sum((nxt - beta) * (mean + mean1) / 2), 6) AS lml FROM k WHERE nxt IS NOT NULL")
def path_sampling(spark, sf):
    return rounded(O.path_sampling(S.samples(spark, sf)))


@query(f"{RUNGS_SQL} SELECT round(sum((nxt - beta) * (mean + mean1) / 2 - (nxt - beta) * (nxt - beta) / 12 * (var1 - var)), 6) AS lml FROM k WHERE nxt IS NOT NULL")
def modified_path_sampling(spark, sf):
    return rounded(O.path_sampling(S.samples(spark, sf), modified=True))


def _difference(spark, sf):
    return S.samples(spark, sf).withColumn("ll", F.col("ll") - F.lit(0.5) * F.pmod("user_id", F.lit(7)))


BF_SQL = RUNGS_SQL.replace("-value AS ll", "-value - 0.5 * (user_id % 7) AS ll")


@query(f"{BF_SQL}, e AS (SELECT k.beta, max((nxt - k.beta) * top) + ln(avg(exp((nxt - k.beta) * (ll - top)))) AS r FROM k JOIN samples s ON s.beta = k.beta WHERE nxt IS NOT NULL GROUP BY k.beta) SELECT round(sum(r), 6) AS lml FROM e")
def bayes_factor_stepping_stone(spark, sf):
    return rounded(O.stepping_stone(_difference(spark, sf)))


@query(f"{BF_SQL} SELECT round(sum((nxt - beta) * (mean + mean1) / 2), 6) AS lml FROM k WHERE nxt IS NOT NULL")
def bayes_factor_path_sampling(spark, sf):
    return rounded(O.path_sampling(_difference(spark, sf)))


@query(f"{BASE}, p AS (SELECT user_id, ln(count(*)) + min(ll) - ln(sum(exp(m - ll))) AS h FROM (SELECT *, min(ll) OVER (PARTITION BY user_id) AS m FROM samples) GROUP BY user_id) SELECT round(sum(h), 6) AS lpml FROM p")
def cpo(spark, sf):
    return rounded(O.cpo(S.samples(spark, sf), "user_id", "ll"))


@query(f"""{BASE}, p AS (SELECT user_id, max(ll) + ln(sum(exp(ll - m))) - ln(count(*)) AS l, var_samp(ll) AS v FROM (SELECT *, max(ll) OVER (PARTITION BY user_id) AS m FROM samples) GROUP BY user_id)
SELECT round(sum(l), 6) AS lppd, round(sum(v), 6) AS p_waic, round(sum(l) - sum(v), 6) AS elpd FROM p""")
def waic(spark, sf):
    return rounded(O.waic(S.samples(spark, sf), "user_id", "ll"))


@query(f"{BASE} SELECT chain, event_id, ll, CAST(iter AS INTEGER) AS iter FROM samples WHERE iter > 100")
def burnin(spark, sf):
    return O.drop_burnin(S.samples(spark, sf), "chain", ["ts", "event_id"], 100).select("chain", "event_id", "ll", F.col("iter").cast("int").alias("iter"))


@query(f"""{BASE}, c AS (SELECT chain, iter, ll - avg(ll) OVER (PARTITION BY chain) AS c FROM samples),
l AS (SELECT chain, unnest([0, 1, 2, 3, 4]) AS lag, iter, c FROM c)
SELECT a.chain, CAST(a.lag AS INTEGER) AS lag, round(avg(a.c * b.c), 6) AS gamma FROM l a JOIN c b ON a.chain = b.chain AND b.iter = a.iter + a.lag GROUP BY 1, 2""")
def autocovariance(spark, sf):
    return rounded(O.autocovariance(S.samples(spark, sf), "chain", ["ts", "event_id"], "ll", 4))


#: Autocovariances to lag 60, summed in pairs up to the first that is not positive.
ESS_SQL = f"""{BASE}, c AS (SELECT chain, iter, ll - avg(ll) OVER (PARTITION BY chain) AS c, count(*) OVER (PARTITION BY chain) AS n FROM samples),
l AS (SELECT chain, iter, c, n, unnest(range(0, 61)) AS lag FROM c),
g AS (SELECT a.chain, a.lag, a.n, sum(a.c * b.c) / (a.n - a.lag) AS gamma FROM l a JOIN c b ON a.chain = b.chain AND b.iter = a.iter + a.lag GROUP BY 1, 2, 3),
p AS (SELECT chain, (lag + 1) // 2 AS pair, sum(gamma) AS two FROM g WHERE lag > 0 GROUP BY 1, 2),
f AS (SELECT chain, min(pair) FILTER (WHERE two <= 0) AS stop FROM p GROUP BY 1)
SELECT g.chain, g.n::BIGINT AS n, round(g.n * gamma / (gamma + 2 * coalesce((SELECT sum(two) FROM p WHERE p.chain = g.chain AND p.pair < f.stop), 0)), 4) AS ess FROM g JOIN f ON f.chain = g.chain WHERE lag = 0"""


@query(ESS_SQL)
def effective_sample_size(spark, sf):
    return rounded(O.ess(S.samples(spark, sf), "chain", ["ts", "event_id"], "ll"), 4)


@query("SELECT event_type AS chain, quantile_disc(value, 0.95) AS q FROM events GROUP BY 1")
def percentile(spark, sf):
    return O.nearest_rank(S.table(spark, sf, "events").withColumnRenamed("event_type", "chain"), ["chain"], "value", 0.95)


@query("SELECT event_type AS chain, round(median(value), 6) AS m FROM events GROUP BY 1")
def median(spark, sf):
    return rounded(S.table(spark, sf, "events").groupBy(F.col("event_type").alias("chain")).agg(F.expr("percentile(value, 0.5)").alias("m")))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(sum(l_extendedprice * l_discount), 2) AS weighted FROM lineitem GROUP BY 1")
def mean_and_weighted_sum(spark, sf):
    g = S.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("weighted"))
    return g.select("l_returnflag", F.round("mean", 4).alias("mean"), F.round("weighted", 2).alias("weighted"))


@query("SELECT l_returnflag, round(var_samp(l_quantity), 6) AS var, round(stddev_samp(l_quantity), 6) AS sd, round(covar_samp(l_quantity, l_extendedprice), 2) AS cov, round(corr(l_quantity, l_extendedprice), 6) AS cor FROM lineitem GROUP BY 1")
def var_cov_corr(spark, sf):
    g = S.table(spark, sf, "lineitem").groupBy("l_returnflag")
    return g.agg(F.round(F.var_samp("l_quantity"), 6).alias("var"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.covar_samp("l_quantity", "l_extendedprice"), 2).alias("cov"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("cor"))


COV = ["l_quantity", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round(covar_samp({a}, {b}), 6) AS cov, round(covar_samp({a}, {b}) / sqrt(var_samp({a}) * var_samp({b})), 6) AS cor FROM lineitem" for a in COV for b in COV))
def cov2cor(spark, sf):
    return rounded(O.cov2cor(O.correlation_matrix(S.table(spark, sf, "lineitem"), COV)))


OLS_SQL = """WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, covar_samp(l_quantity, l_extendedprice) AS c, var_samp(l_quantity) AS vx, var_samp(l_extendedprice) AS vy FROM lineitem GROUP BY 1),
t AS (SELECT *, c / vx AS slope, (n - 1) * (vy - c * c / vx) AS sse FROM s)"""


@query(f"""{OLS_SQL} SELECT l_returnflag, n, round(slope, 4) AS slope, round(my - slope * mx, 2) AS intercept, round(log10(sse), 6) AS sse, round(log10(sse / (n - 2)), 6) AS mse,
round(sqrt(sse / (n - 2) / ((n - 1) * vx)), 4) AS se_slope, round(sqrt(sse / (n - 2) * (1 / n + mx * mx / ((n - 1) * vx))), 4) AS se_intercept, round(c / sqrt(vx * vy), 6) AS r FROM t""")
def least_squares(spark, sf):
    r = O.regression(S.table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").drop("mean_x")
    digits = {"slope": 4, "intercept": 2, "se_slope": 4, "se_intercept": 4, "r": 6}
    return r.withColumns({c: F.round(c, d) for c, d in digits.items()}).withColumns({"sse": F.round(F.log10("sse"), 6), "mse": F.round(F.log10("mse"), 6)})


MODELS_SQL = """WITH m AS (SELECT p_brand, p_type, -sum(p_retailprice) / 100 AS lnl, count(DISTINCT p_size) AS k, count(*) AS n FROM part GROUP BY 1, 2),
ic AS (SELECT *, -2 * lnl + 2 * k AS aic, -2 * lnl + k * ln(n) AS bic, -2 * lnl + 2 * k * ln(ln(n)) AS hq FROM m WHERE n > 1)"""


def _models(spark, sf):
    m = S.table(spark, sf, "part").groupBy("p_brand", "p_type").agg((-F.sum("p_retailprice") / 100).alias("lnl"), F.count_distinct("p_size").alias("k"), F.count("*").alias("n"))
    return m.where("n > 1").withColumns(O.information_criteria(F.col("lnl"), F.col("k"), F.col("n")))


@query(f"{MODELS_SQL} SELECT p_brand, p_type, round(aic, 6) AS aic, round(bic, 6) AS bic, round(hq, 6) AS hq FROM ic")
def aic_bic_hq(spark, sf):
    return rounded(_models(spark, sf).select("p_brand", "p_type", "aic", "bic", "hq"))


WEIGHTS_SQL = f"""{MODELS_SQL}, r AS (SELECT p_brand, p_type, aic, exp(-0.5 * (aic - min(aic) OVER (PARTITION BY p_brand))) AS r FROM ic),
w AS (SELECT p_brand, p_type, aic, r / sum(r) OVER (PARTITION BY p_brand) AS weight FROM r),
c AS (SELECT *, sum(weight) OVER (PARTITION BY p_brand ORDER BY weight DESC, p_type ROWS UNBOUNDED PRECEDING) AS cumulative FROM w)"""


@query(f"{WEIGHTS_SQL} SELECT p_brand, p_type, round(weight, 6) AS weight, round(cumulative, 6) AS cumulative FROM c")
def ic_weights(spark, sf):
    return rounded(O.ic_weights(_models(spark, sf), "p_type", "aic", ["p_brand"]).select("p_brand", "p_type", "weight", "cumulative"))


@query(f"{WEIGHTS_SQL} SELECT p_brand, count(*) AS n_models, round(sum(weight * aic) / sum(weight), 6) AS mean, round(min(aic), 6) AS least, round(max(aic), 6) AS greatest FROM c WHERE cumulative - weight <= 0.95 GROUP BY 1")
def model_average(spark, sf):
    return rounded(O.averaged(O.ic_weights(_models(spark, sf), "p_type", "aic", ["p_brand"]), "aic", 0.95, ["p_brand"]))


@query(f"{MODELS_SQL}, l AS (SELECT p_brand, p_type, greatest(2 * (max(lnl) OVER (PARTITION BY p_brand) - lnl), 0) AS d FROM ic) SELECT p_brand, p_type, round(d, 6) AS statistic, round(exp(-d / 2), 6) AS p_value FROM l")
def likelihood_ratio(spark, sf):
    d = F.greatest(2 * (F.max("lnl").over(Window.partitionBy("p_brand")) - F.col("lnl")), F.lit(0.0))
    return rounded(_models(spark, sf).select("p_brand", "p_type", d.alias("statistic"), F.exp(-d / 2).alias("p_value")))


AT = (1.0, 10.0, 50.0, 100.0)


@query(f"SELECT event_type, x, round(avg(exp(-0.5 * ((value - x) / 5) ** 2)) / (5 * sqrt(2 * pi())), 6) AS density FROM events, (SELECT unnest({list(AT)}::DOUBLE[]) AS x) GROUP BY 1, 2")
def kernel_density(spark, sf):
    return rounded(O.kernel_density(S.table(spark, sf, "events"), ["event_type"], "value", AT, 5.0))


@query("SELECT event_type, round(avg(value), 6) AS m, round(avg(value) - 1.959963984540054 * stddev_samp(value), 6) AS low, round(avg(value) + 1.959963984540054 * stddev_samp(value), 6) AS high FROM events GROUP BY 1")
def normal_interval(spark, sf):
    return rounded(O.normal_interval(S.table(spark, sf, "events"), ["event_type"], "value"))


@query("""WITH d AS (SELECT user_id, ts, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
s AS (SELECT user_id, count(b) AS n, sum((value - b) * (value - b)) AS ss FROM d GROUP BY 1)
SELECT user_id, round(ln(0.5) * n / 2.0 - 0.5 * ss / 2 - n / 2.0 * ln(2 * pi()), 6) AS lp FROM s""")
def gmrf(spark, sf):
    from dendrolith.operators.density import gmrf as density

    return rounded(density(S.table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 0.5), 6)


@query("""WITH d AS (SELECT user_id, value, epoch_us(ts) / 1e6 AS t, event_id, ts FROM events),
g AS (SELECT user_id, ts, event_id, value, t - lag(t, 1, t - 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM d),
l AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dx, gap + lag(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS both FROM g)
SELECT user_id, round(ln(2.0) * count(dx) / 2 - sum(dx * dx * 2 / both) * 2.0 / 2 - count(dx) / 2 * ln(2 * pi()), 4) AS lp FROM l GROUP BY 1""".replace(" AS both", " AS pair").replace("/ both)", "/ pair)"))
def gmrf_time_aware(spark, sf):
    from dendrolith.operators.density import gmrf_time_aware as density

    timed = S.table(spark, sf, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return rounded(density(timed, "user_id", ["ts", "event_id"], "value", "t", 2.0), 4)


@query("SELECT event_type, round(avg(value) * avg(value) / var_samp(value), 6) AS shape, round(avg(value) / var_samp(value), 6) AS rate, round(avg(ln(value)), 6) AS mu, round(stddev_samp(ln(value)), 6) AS sigma FROM events GROUP BY 1")
def moment_fits(spark, sf):
    return rounded(O.moment_fits(S.table(spark, sf, "events"), ["event_type"], "value"))


@query(f"{BASE}, r AS (SELECT chain, ll - ln(1.0 / 50) + (-ll) / 50 AS r FROM samples) SELECT chain, round(max(r) + ln(sum(exp(r - m))) - ln(count(*)), 6) AS lme FROM (SELECT *, max(r) OVER (PARTITION BY chain) AS m FROM r) GROUP BY chain")
def importance_sampling(spark, sf):
    own = S.samples(spark, sf).withColumn("lq", F.log(F.lit(1.0 / 50)) - (-F.col("ll")) / 50)
    return rounded(O.log_evidence_by_importance(own, "ll", "lq", ["chain"]))
