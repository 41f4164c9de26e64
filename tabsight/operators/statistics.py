"""Statistical tests. Sums and ranks are worked out in Spark; what is left is closed formulas on a few numbers, or
kernels on bounded, seeded samples (the test itself is defined for few values)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import number
from ..functions.ranges import range_id
from ..settings import DEFAULT, Settings
from .columns import numeric_columns

# --- special functions -------------------------------------------------------


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function: series below a + 1, continued fraction beyond."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def chi2_tail(x: float, k: float) -> float:
    return gamma_q(k / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 2000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d)
            c = 1 + top / c
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_quantile(p: float, df: float) -> float:
    """Student's t by bisection of its distribution function; p above a half."""
    lo, hi = 0.0, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        below = 1 - 0.5 * beta_i(df / 2, 0.5, df / (df + mid * mid))
        lo, hi = (mid, hi) if below < p else (lo, mid)
    return (lo + hi) / 2


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


# --- kernels -----------------------------------------------------------------


def medcouple(x: np.ndarray) -> float:
    """Robust skewness: the median of the kernel over all pairs around the median (Brys, Hubert, Struyf 2004)."""
    x = np.sort(x)
    m = np.median(x)
    up, down = x[x >= m], x[x <= m]
    if not len(x):
        return 0.0
    a, b = up[:, None], down[None, :]
    gap = a - b
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.where(gap > 0, ((a - m) - (m - b)) / gap, 0.0)
    k = int((x == m).sum())
    if k > 1:  # values at the median pair as signs of their places
        h[:k, len(down) - k :] = np.sign(np.add.outer(np.arange(k), np.arange(k)) - (k - 1))
    return float(np.median(h))


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """W and its p-value by Royston's approximation (AS R94, 1995); 12 to 5,000 values."""
    n = len(x)
    x = np.sort(x)
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    c = m / math.sqrt(float(m @ m))
    u = 1 / math.sqrt(n)
    a = np.empty(n)
    an = c[-1] + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
    an1 = c[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
    phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
    a[2:-2] = m[2:-2] / math.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = an, an1, -an, -an1
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    ln = math.log(n)
    mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
    sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, normal_tail((math.log(max(1 - w, 1e-300)) - mu) / sigma)


def adf(y: np.ndarray) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller with a constant: (statistic, p-value, lag by AIC). MacKinnon's response surface (1994)."""
    n = len(y)
    most = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    dy = np.diff(y)

    def fit(lag: int, start: int) -> tuple[float, float]:
        rows = range(start, len(dy))
        x = np.array([[1.0, y[t], *(dy[t - k] for k in range(1, lag + 1))] for t in rows])
        z = dy[start:]
        beta, *_ = np.linalg.lstsq(x, z, rcond=None)
        rss = float(((z - x @ beta) ** 2).sum())
        s2 = rss / max(1, len(z) - x.shape[1])
        se = math.sqrt(max(s2 * np.linalg.pinv(x.T @ x)[1, 1], 1e-300))
        return len(z) * math.log(max(rss, 1e-300) / len(z)) + 2 * x.shape[1], float(beta[1]) / se

    lag = min(range(most + 1), key=lambda k: fit(k, most)[0])
    t = fit(lag, lag)[1]
    if t > 2.74:
        return t, 1.0, lag
    if t < -18.83:
        return t, 0.0, lag
    z = np.polyval([0.038269, 1.4412, 2.1659], t) if t <= -1.61 else np.polyval([-0.010368, -0.12745, 0.93202, 1.7339], t)
    return t, 1 - normal_tail(float(z)), lag


def ljung_box(y: np.ndarray) -> tuple[float, float, int]:
    n = len(y)
    lags = max(1, min(10, n // 5))
    d = y - y.mean()
    total = float(d @ d)
    q = n * (n + 2) * sum((float(d[k:] @ d[:-k]) / total) ** 2 / (n - k) for k in range(1, lags + 1)) if total else 0.0
    return q, chi2_tail(q, lags), lags


# --- operators ---------------------------------------------------------------


def kernel_sample(df: DataFrame, column: str, n: int) -> np.ndarray:
    """At most n values, those of the least hashes of value and copy, whatever the rows' layout; for kernels that take no more."""
    x = number(df, column)
    rows = df.select(x.alias("x")).where("x IS NOT NULL")
    total = rows.count()
    if total > n:
        copies = rows.groupBy("x").agg(F.count("*").alias("c"))
        each = copies.select("x", F.explode(F.sequence(F.lit(1).cast("long"), "c")).alias("k"))
        rows = each.withColumn("h", F.xxhash64("x", "k")).orderBy("h", "x", "k").limit(n)
    return np.array([r["x"] for r in rows.select("x").collect()], float)


def mean_ci(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, mean, lo, hi): 95 % confidence interval of the mean; a point where there is no spread."""
    columns = columns or numeric_columns(df)
    row = df.agg(*(F.struct(F.count(number(df, c)).alias("n"), F.avg(number(df, c)).alias("m"), F.stddev_samp(number(df, c)).alias("s")).alias(f"x{i}") for i, c in enumerate(columns))).first()
    out = []
    for i, c in enumerate(columns):
        n, m, s = row[i]
        half = t_quantile(0.975, n - 1) * s / math.sqrt(n) if n > 1 and s else 0.0
        out.append((c, n, m, m - half if m is not None else None, m + half if m is not None else None))
    return df.sparkSession.createDataFrame(out, "column string, n long, mean double, lo double, hi double")


def chi2_uniformity(df: DataFrame, columns: list[str], s: Settings = DEFAULT) -> DataFrame:
    """(column, n, k, statistic, cramers_v) of equal shares: 2 to 50 categories, five expected in each."""
    from .columns import value_counts

    by = value_counts(df, columns).groupBy("column").agg(F.sum("cnt").alias("n"), F.count("*").alias("k"), F.sum(F.col("cnt") * F.col("cnt")).alias("sq"))
    by = by.where((F.col("k").between(2, s.max_levels)) & (F.col("n") >= 5 * F.col("k")))
    x = F.col("sq") * F.col("k") / F.col("n") - F.col("n")
    four = lambda c: F.floor(c * 10000 + 0.5) / 10000.0
    return by.select("column", "n", "k", four(x).alias("statistic"), four(F.sqrt(x / (F.col("n") * (F.col("k") - 1)))).alias("cramers_v"))


def chi2_p_values(result: DataFrame) -> DataFrame:
    """Adds p_value to the rows of chi2_uniformity (a row a column)."""
    rows = [(*r, chi2_tail(r["statistic"], r["k"] - 1)) for r in result.collect()]
    return result.sparkSession.createDataFrame(rows, result.schema.add("p_value", "double"))


def shapiro_test(df: DataFrame, columns: list[str], s: Settings = DEFAULT) -> DataFrame:
    """(column, n, w, p_value, normal): on at most 5,000 values; constant and short columns are left out."""
    out = []
    for c in columns:
        x = kernel_sample(df, c, s.kernel_rows)
        if len(x) >= 20 and x.min() < x.max():
            w, p = shapiro(x)
            out.append((c, len(x), w, p, p > s.alpha))
    return df.sparkSession.createDataFrame(out, "column string, n long, w double, p_value double, normal boolean")


def medcouple_outliers(df: DataFrame, columns: list[str], s: Settings = DEFAULT) -> DataFrame:
    """(column, medcouple, lower, upper, n_outliers): fences that lean with the skewness (Hubert and Vandervieren 2008).

    The medcouple is that of a bounded sample; quartiles and counts are those of all rows."""
    from .columns import _quartiles, long_form

    q = _quartiles(df, columns)
    mc = {c: medcouple(kernel_sample(df, c, s.kernel_rows)) for c in q}

    def fields(c):
        a, b = q[c]
        m, span = mc[c], b - a
        down, up = (-4, 3) if m >= 0 else (-3, 4)
        lo, hi = a - s.fence * math.exp(down * m) * span, b + s.fence * math.exp(up * m) * span
        x = number(df, c)
        return {"medcouple": F.lit(m), "lower": F.lit(lo), "upper": F.lit(hi), "n_outliers": F.count_if((x < lo) | (x > hi))}

    return long_form(df, list(q), fields)


def _digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def best_distribution(df: DataFrame, column: str) -> DataFrame:
    """(distribution, aic, delta, ks): normal; uniform and exponential if no value is negative; log-normal and gamma if
    all are positive. Fits come from sums over all rows; the distance from the ranks of the different values."""
    x = number(df, column)
    r = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(F.when(x > 0, F.ln(x))).alias("ml"), F.var_pop(F.when(x > 0, F.ln(x))).alias("vl")).first()
    kind = "distribution string, aic double, delta double, ks double"
    if r["n"] < 20 or not r["v"]:
        return df.sparkSession.createDataFrame([], kind)
    n, m, v, lo, hi = r["n"], r["m"], r["v"], r["lo"], r["hi"]
    z = F.col("x")
    phi = lambda t: 0.5 * _erfc_neg(t)
    fits = [("normal", 4 + n * (math.log(2 * math.pi * v) + 1), phi((z - m) / math.sqrt(v)))]
    if lo >= 0:
        fits.append(("uniform", 4 + 2 * n * math.log(hi - lo), (z - lo) / (hi - lo)))
        fits.append(("exponential", 2 + 2 * n * (math.log(m) + 1), 1 - F.exp(-z / m)))
    if lo > 0 and r["vl"]:
        fits.append(("lognormal", 4 + 2 * n * r["ml"] + n * (math.log(2 * math.pi * r["vl"]) + 1), phi((F.ln(z) - r["ml"]) / math.sqrt(r["vl"]))))
        d = math.log(m) - r["ml"]
        a = (3 - d + math.sqrt((d - 3) ** 2 + 24 * d)) / (12 * d)
        for _ in range(50):
            h = 1e-5 * a
            slope = 1 / a - (_digamma(a + h) - _digamma(a - h)) / (2 * h)
            a = max(1e-6, a - (math.log(a) - _digamma(a) - d) / slope)
        ll = n * ((a - 1) * r["ml"] - m * a / m - a * math.log(m / a) - math.lgamma(a))
        fits.append(("gamma", 4 - 2 * ll, None))
    counts = df.select(x.alias("x")).where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("c"))
    from pyspark.sql import Window as W

    ranged = counts.withColumn("p", range_id(df.select(x.alias("x")), "x")).withColumn("run", F.sum("c").over(W.partitionBy("p").orderBy("x")))
    base = ranged.groupBy("p").agg(F.sum("c").alias("t")).select("p", F.coalesce(F.sum("t").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    at = ranged.join(F.broadcast(base), "p").select("x", ((F.col("b") + F.col("run")) / n).alias("up"), ((F.col("b") + F.col("run") - F.col("c")) / n).alias("down"))
    far = [F.max(F.greatest(F.col("up") - f, f - F.col("down"))).alias(k) for k, _, f in fits if f is not None]
    ks = at.agg(*far).first().asDict()
    least = min(a for _, a, _ in fits)
    return df.sparkSession.createDataFrame([(k, float(a), float(a - least), ks.get(k)) for k, a, _ in sorted(fits, key=lambda f: f[1])], kind)


def _erfc_neg(t):
    """erfc(-t / sqrt 2) as a column (Abramowitz and Stegun 7.1.26, error below 2e-7)."""
    y = F.abs(t) / math.sqrt(2)
    k = 1 / (1 + 0.3275911 * y)
    erf = 1 - ((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * F.exp(-y * y)
    return F.when(t >= 0, 1 + erf).otherwise(1 - erf)


def series_tests(series: DataFrame, columns: list[str], s: Settings = DEFAULT, most: int = 50_000) -> DataFrame:
    """(column, n, adf, adf_p, stationary, q, q_p, autocorrelated) of a series (period, columns...) of at most ``most`` periods;
    more are an error, and ask for a wider grain."""
    rows = series.orderBy("period").limit(most + 1).collect()  # bounded
    if len(rows) > most:
        raise ValueError(f"a series of over {most} periods: choose a wider grain")
    out = []
    for c in columns:
        y = np.array([float(r[c]) for r in rows if r[c] is not None])
        if len(y) >= s.adf_rows and y.min() < y.max():
            t, p, _ = adf(y)
            q, pq, _ = ljung_box(y)
            out.append((c, len(y), t, p, p < s.alpha, q, pq, pq < s.alpha))
    return series.sparkSession.createDataFrame(out, "column string, n long, adf double, adf_p double, stationary boolean, q double, q_p double, autocorrelated boolean")


def ljung_box_sql(series: DataFrame, column: str, lags: int) -> DataFrame:
    """(n, lags, q): the statistic from window functions over the periods (a row each)."""
    from pyspark.sql import Window as W

    w = W.orderBy("period")
    everything = W.partitionBy()
    d = series.select("period", (F.col(column) - F.avg(column).over(everything)).alias("d"))
    d = d.select("d", *(F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)))
    n, total = F.count("*"), F.sum(F.col("d") * F.col("d"))
    q = sum((F.pow(F.sum(F.col("d") * F.col(f"l{k}")) / total, 2) / (n - k) for k in range(1, lags + 1)), F.lit(0.0))
    return d.agg(n.alias("n"), F.lit(lags).alias("lags"), (F.floor(n * (n + 2) * q * 10000 + 0.5) / 10000.0).alias("q"))


def sampling_uncertainty(spark, n: int, total: int) -> DataFrame:
    """(n, total, coverage, rare_event): the share seen, and the rate below which an event may have been missed."""
    return spark.createDataFrame([(n, total, n / total if total else 1.0, 3.0 / n if n else 1.0)], "n long, total long, coverage double, rare_event double")


