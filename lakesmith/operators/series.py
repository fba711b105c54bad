"""Time-series diagnostics and forecasting.

Series arrive long: ``(series_key, ts, y)``. Autocorrelation is computed
with DataFrame joins (lags exploded, so even a long series spreads over
tasks). The per-series numerical routines (unit-root tests, ARIMA, Holt,
VAR) run as ``applyInPandas`` grouped maps: Spark shuffles by series and
runs one small numpy routine per series; series are bounded (aggregated
first, e.g. monthly totals), which is what makes a per-series task sound.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ------------------------------------------------------------------ TS-01/03


def n_lags_for(n: int) -> int:
    """min(40, n // 2 - 1), at least 5."""
    return max(5, min(40, n // 2 - 1))


def acf(df: DataFrame, key: str, order: str, col: str) -> DataFrame:
    """Autocorrelation per series for lags 0..min(40, n//2-1) (>= 5):
    r_k = sum (y_t - m)(y_{t-k} - m) / sum (y_t - m)^2. Lag products come
    from a join of the indexed series with itself shifted by k."""
    w = Window.partitionBy(key).orderBy(order)
    x = (df.where(F.col(col).isNotNull())
         .select(key, F.row_number().over(w).alias("i"), F.col(col).cast("double").alias("y")))
    st = x.groupBy(key).agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n"))
    d = x.join(st, key).select(key, "i", (F.col("y") - F.col("m")).alias("e"), "n")
    nl = F.greatest(F.lit(5), F.least(F.lit(40), F.floor(F.col("n") / 2) - 1))
    lagged = d.select(key, "i", "e", F.explode(F.sequence(F.lit(0), nl)).alias("lag"))
    prev = d.select(key, F.col("i").alias("j"), F.col("e").alias("e_prev"))
    prod = (lagged.join(prev, (lagged[key] == prev[key]) & (prev["j"] == lagged["i"] - lagged["lag"]), "left")
            .select(lagged[key].alias(key), "lag", (F.col("e") * F.col("e_prev")).alias("p")))
    num = prod.groupBy(key, "lag").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("num"))
    den = d.groupBy(key).agg(F.sum(F.col("e") * F.col("e")).alias("den"), F.first("n").alias("n_obs"))
    return (num.join(den, key).select(key, "lag", (F.col("num") / F.col("den")).alias("acf"), "n_obs"))


def significant_lags(acf_df: DataFrame, key: str, band: str = "n_obs") -> DataFrame:
    """Lags (> 0) whose |acf| exceeds the 95% band: 1.96 / sqrt(n_obs)
    (standard) or 1.96 / sqrt(n_lags + 1) (``band='n_lags'``)."""
    g = acf_df.groupBy(key).agg(F.max("lag").alias("n_lags"), F.first("n_obs").alias("n_obs"))
    bw = (F.lit(1.96) / F.sqrt(F.col("n_obs"))) if band == "n_obs" else (F.lit(1.96) / F.sqrt(F.col("n_lags") + 1))
    j = acf_df.join(g.withColumn("band", bw).select(key, "band", "n_lags"), key)
    return j.groupBy(key, "band", "n_lags").agg(
        F.count_if((F.col("lag") > 0) & (F.abs("acf") > F.col("band"))).alias("significant_lags"))


# ------------------------------------------------------------------ numerics

def _ols(y: np.ndarray, X: np.ndarray):
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    n, k = X.shape
    ssr = float(resid @ resid)
    sigma2 = ssr / max(n - k, 1)
    cov = sigma2 * np.linalg.pinv(X.T @ X)
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1) if ssr > 0 else float("inf")
    return beta, np.sqrt(np.maximum(np.diag(cov), 0)), llf, resid


def _norm_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


# MacKinnon (1994) response surface for the constant-only
# Dickey-Fuller p-value, one series (tau_max, tau_min, tau_star, small-p
# and large-p polynomial coefficients, lowest power first), and MacKinnon
# (2010) critical value coefficients b0 + b1/T + b2/T^2 + b3/T^3.
ADF_C_TAU_MAX = 2.74
ADF_C_TAU_MIN = -18.83
ADF_C_TAU_STAR = -1.61
ADF_C_SMALLP = [2.1659, 1.4412, 0.038269]
ADF_C_LARGEP = [1.7339, 0.93202, -0.12745, -0.010368]
ADF_C_CRIT = {"1%": [-3.43035, -6.5393, -16.786, -79.433],
              "5%": [-2.86154, -2.8903, -4.234, -40.040],
              "10%": [-2.56677, -1.5384, -2.809, 0.0]}
# KPSS level-stationarity critical values (Kwiatkowski et al.
# 1992) for significance 10%, 5%, 2.5%, 1%.
KPSS_C_CRIT = [0.347, 0.463, 0.574, 0.739]
KPSS_PVALS = [0.10, 0.05, 0.025, 0.01]


def adf_pvalue(tau: float) -> float:
    if tau > ADF_C_TAU_MAX:
        return 1.0
    if tau < ADF_C_TAU_MIN:
        return 0.0
    c = ADF_C_SMALLP if tau <= ADF_C_TAU_STAR else ADF_C_LARGEP
    return _norm_cdf(sum(b * tau ** i for i, b in enumerate(c)))


def adf_critical(nobs: int) -> dict[str, float]:
    return {k: b[0] + b[1] / nobs + b[2] / nobs ** 2 + b[3] / nobs ** 3 for k, b in ADF_C_CRIT.items()}


def adf_numpy(y: np.ndarray) -> dict:
    """ADF with constant, lag chosen by AIC over 0..maxlag on a common
    sample, then refit on all available rows."""
    y = np.asarray(y, float)
    n = len(y)
    maxlag = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    maxlag = max(maxlag, 0)
    dy = np.diff(y)

    def design(p, start):
        rows = range(start, len(dy))
        X = [[1.0, y[t]] + [dy[t - i] for i in range(1, p + 1)] for t in rows]
        return dy[start:], np.array(X)

    best, best_aic = 0, float("inf")
    for p in range(maxlag + 1):
        yy, X = design(p, maxlag)
        _b, _se, llf, _r = _ols(yy, X)
        aic = -2 * llf + 2 * X.shape[1]
        if aic < best_aic:
            best, best_aic = p, aic
    yy, X = design(best, best)
    b, se, _llf, _r = _ols(yy, X)
    tau = float(b[1] / se[1]) if se[1] > 0 else float("nan")
    p = adf_pvalue(tau)
    crit = adf_critical(len(yy))
    return {"adf_stat": tau, "adf_pvalue": p, "adf_lags": best, "adf_nobs": len(yy),
            "crit_1": crit["1%"], "crit_5": crit["5%"], "crit_10": crit["10%"], "adf_stationary": p < 0.05}


def kpss_numpy(y: np.ndarray) -> dict:
    """KPSS level test, automatic bandwidth (Hobijn et al.), Bartlett
    long-run variance, p-value interpolated in the table and clipped."""
    y = np.asarray(y, float)
    n = len(y)
    e = y - y.mean()
    cov_lags = int(n ** (2.0 / 9.0))
    s0 = float(e @ e) / n
    s1 = 0.0
    for i in range(1, cov_lags + 1):
        rp = float(e[i:] @ e[:n - i]) / n
        s0 += 2 * rp
        s1 += i * rp
    s_hat = s1 / s0 if s0 else 0.0
    gamma = 1.1447 * (s_hat * s_hat) ** (1 / 3)
    lags = min(int(gamma * n ** (1 / 3)), n - 1)
    s = np.cumsum(e)
    lrv = float(e @ e)
    for k in range(1, lags + 1):
        lrv += 2 * (1 - k / (lags + 1)) * float(e[k:] @ e[:n - k])
    lrv /= n
    stat = float(s @ s) / (n * n * lrv) if lrv > 0 else float("nan")
    p = float(np.interp(stat, KPSS_C_CRIT, KPSS_PVALS))
    return {"kpss_stat": stat, "kpss_pvalue": p, "kpss_lags": lags, "kpss_stationary": p > 0.05}


def pacf_numpy(y: np.ndarray, nlags: int) -> np.ndarray:
    """Partial autocorrelation by Durbin-Levinson on the adjusted
    autocovariances (Yule-Walker, denominator n - k)."""
    y = np.asarray(y, float)
    n = len(y)
    e = y - y.mean()
    r = np.array([float(e[k:] @ e[:n - k]) / (n - k) for k in range(nlags + 1)])
    r = r / r[0]
    out = np.zeros(nlags + 1)
    out[0] = 1.0
    phi = np.zeros(nlags + 1)
    for k in range(1, nlags + 1):
        num = r[k] - sum(phi[j] * r[k - j] for j in range(1, k))
        den = 1 - sum(phi[j] * r[j] for j in range(1, k))
        pk = num / den if den else 0.0
        new = phi.copy()
        new[k] = pk
        for j in range(1, k):
            new[j] = phi[j] - pk * phi[k - j]
        phi = new
        out[k] = pk
    return out


def _refine(f, grid_axes, rounds: int = 3):
    """Grid search, then successively finer grids around the best point."""
    best = None
    axes = [np.asarray(a, float) for a in grid_axes]
    for _ in range(rounds):
        mesh = np.array(np.meshgrid(*axes, indexing="ij")).reshape(len(axes), -1).T
        vals = [f(p) for p in mesh]
        i = int(np.nanargmin(vals))
        best = (mesh[i], vals[i])
        axes = [np.linspace(max(a.min(), best[0][j] - (a[1] - a[0])), min(a.max(), best[0][j] + (a[1] - a[0])),
                            len(a)) for j, a in enumerate(axes)]
    return best


def arima111_numpy(y: np.ndarray, h: int):
    """ARIMA(1,1,1) with drift by conditional sum of squares on the
    differenced series; returns params, sigma2, aic, bic and h forecasts."""
    y = np.asarray(y, float)
    w = np.diff(y)
    n = len(w)

    def css(p):
        phi, theta = p
        c = w.mean() * (1 - phi)
        eps = np.zeros(n)
        for t in range(1, n):
            eps[t] = w[t] - c - phi * w[t - 1] - theta * eps[t - 1]
        return float(eps[1:] @ eps[1:])

    (phi, theta), ssr = _refine(css, [np.linspace(-0.95, 0.95, 39), np.linspace(-0.95, 0.95, 39)])
    c = w.mean() * (1 - phi)
    eps = np.zeros(n)
    for t in range(1, n):
        eps[t] = w[t] - c - phi * w[t - 1] - theta * eps[t - 1]
    m = n - 1
    sigma2 = ssr / m
    llf = -m / 2 * (math.log(2 * math.pi * sigma2) + 1)
    k = 4
    fc, last_w, last_e, level = [], w[-1], eps[-1], y[-1]
    for i in range(h):
        nw = c + phi * last_w + (theta * last_e if i == 0 else 0.0)
        level += nw
        fc.append(level)
        last_w = nw
    return {"phi": phi, "theta": theta, "const": c, "sigma2": sigma2,
            "aic": -2 * llf + 2 * k, "bic": -2 * llf + k * math.log(m)}, fc


def holt_numpy(y: np.ndarray, h: int):
    """Additive-trend exponential smoothing; (alpha, beta) minimise the
    one-step squared error by grid and local refinement."""
    y = np.asarray(y, float)
    n = len(y)

    def run(p):
        a, b = p
        lvl, tr = y[0], y[1] - y[0] if n > 1 else 0.0
        sse = 0.0
        for t in range(1, n):
            f = lvl + tr
            sse += (y[t] - f) ** 2
            nl = a * y[t] + (1 - a) * (lvl + tr)
            tr = b * (nl - lvl) + (1 - b) * tr
            lvl = nl
        return sse, lvl, tr

    (a, b), sse = _refine(lambda p: run(p)[0], [np.linspace(0.01, 0.99, 25), np.linspace(0.01, 0.99, 25)])
    _, lvl, tr = run((a, b))
    m = n - 1
    sigma2 = sse / m
    llf = -m / 2 * (math.log(2 * math.pi * sigma2) + 1) if sigma2 > 0 else float("inf")
    return {"alpha": a, "beta": b, "sigma2": sigma2, "aic": -2 * llf + 2 * 4,
            "bic": -2 * llf + 4 * math.log(m)}, [lvl + (i + 1) * tr for i in range(h)]


def var_numpy(Y: np.ndarray, h: int):
    """VAR with lag order by AIC up to min(12, n // 5); OLS per equation;
    iterated forecasts."""
    Y = np.asarray(Y, float)[:, :8]
    n, k = Y.shape
    maxp = max(1, min(12, n // 5))

    def fit(p, start):
        rows = range(start, n)
        X = np.array([[1.0] + [Y[t - i, j] for i in range(1, p + 1) for j in range(k)] for t in rows])
        T = Y[start:]
        B, *_ = np.linalg.lstsq(X, T, rcond=None)
        E = T - X @ B
        S = E.T @ E / len(rows)
        return B, S, len(rows)

    best, best_aic = 1, float("inf")
    for p in range(1, maxp + 1):
        B, S, m = fit(p, maxp)
        sign, logdet = np.linalg.slogdet(S)
        aic = logdet + 2 * (k * (k * p + 1)) / m if sign > 0 else float("inf")
        if aic < best_aic:
            best, best_aic = p, aic
    B, S, m = fit(best, best)
    hist = [Y[t] for t in range(n)]
    fc = []
    for _ in range(h):
        x = np.array([1.0] + [hist[-i][j] for i in range(1, best + 1) for j in range(k)])
        nxt = x @ B
        fc.append(nxt)
        hist.append(nxt)
    return {"lags": best, "aic": best_aic}, np.array(fc), B


# ------------------------------------------------------------------ grouped maps

DIAG_SCHEMA = ("series string, n long, adf_stat double, adf_pvalue double, adf_lags long, adf_nobs long, "
               "crit_1 double, crit_5 double, crit_10 double, adf_stationary boolean, kpss_stat double, "
               "kpss_pvalue double, kpss_lags long, kpss_stationary boolean, verdict string")


def stationarity_label(adf_ok: bool, kpss_ok: bool) -> str:
    """TS-06: 2x2 verdict of the two tests."""
    if adf_ok and kpss_ok:
        return "stationary"
    if not adf_ok and not kpss_ok:
        return "non-stationary"
    return "difference-stationary" if adf_ok else "trend-stationary"


def diagnostics(df: DataFrame, key: str, order: str, col: str, min_n: int = 20) -> DataFrame:
    """TS-04..06 per series (series with fewer than ``min_n`` points are
    skipped, as the tests need them)."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        y = pdf[col].dropna().to_numpy(float)
        if len(y) < min_n:
            return pd.DataFrame(columns=[c.split()[0] for c in DIAG_SCHEMA.split(", ")])
        a, k = adf_numpy(y), kpss_numpy(y)
        row = {"series": str(pdf[key].iloc[0]), "n": len(y), **a, **k,
               "verdict": stationarity_label(a["adf_stationary"], k["kpss_stationary"])}
        return pd.DataFrame([row])
    return df.select(key, order, col).groupBy(key).applyInPandas(fn, DIAG_SCHEMA)


def pacf(df: DataFrame, key: str, order: str, col: str) -> DataFrame:
    """TS-02 per series: lags 0..min(40, n//2-1) (>= 5)."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[col].dropna().to_numpy(float)
        nl = min(n_lags_for(len(y)), len(y) - 1)
        v = pacf_numpy(y, nl)
        return pd.DataFrame({"series": str(pdf[key].iloc[0]), "lag": np.arange(nl + 1), "pacf": v})
    return df.select(key, order, col).groupBy(key).applyInPandas(fn, "series string, lag long, pacf double")


FC_SCHEMA = "series string, model string, step long, forecast double, aic double, bic double, params string"


def forecast(df: DataFrame, key: str, order: str, col: str, h: int = 6, models=("arima111", "holt")) -> DataFrame:
    """TS-07/08/11: per-series fits with AIC/BIC and h-step forecasts."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[col].dropna().to_numpy(float)
        out = []
        if len(y) < 4:
            return pd.DataFrame(columns=[c.split()[0] for c in FC_SCHEMA.split(", ")])
        for m in models:
            p, fc = arima111_numpy(y, h) if m == "arima111" else holt_numpy(y, h)
            params = ",".join(f"{k}={v:.6g}" for k, v in p.items() if k not in ("aic", "bic"))
            for i, v in enumerate(fc, start=1):
                out.append((str(pdf[key].iloc[0]), m, i, float(v), float(p["aic"]), float(p["bic"]), params))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FC_SCHEMA.split(", ")])
    return df.select(key, order, col).groupBy(key).applyInPandas(fn, FC_SCHEMA)


def var_forecast(df: DataFrame, key: str, order: str, cols: list[str], h: int = 6) -> DataFrame:
    """TS-09 per group of series: VAR on up to 8 columns, iterated forecast."""
    schema = "series string, step long, " + ", ".join(f"{c} double" for c in cols) + ", lags long, aic double"

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        Y = pdf.sort_values(order)[cols].dropna().to_numpy(float)
        info, fc, _B = var_numpy(Y, h)
        d = pd.DataFrame(fc, columns=cols)
        d.insert(0, "step", np.arange(1, h + 1))
        d.insert(0, "series", str(pdf[key].iloc[0]))
        d["lags"] = info["lags"]
        d["aic"] = info["aic"]
        return d
    return df.select(key, order, *cols).groupBy(key).applyInPandas(fn, schema)
