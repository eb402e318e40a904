"""Support series of itemsets: baselines, residuals, forecasts and trends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ItemsetConfig


def series(metrics: DataFrame, tx: DataFrame) -> DataFrame:
    """items, size, year, z = log1p(support) for every itemset and every year with transactions; 0 in the
    years in which it isn't strong."""
    years = tx.agg(F.sort_array(F.collect_set("year")).alias("ys")).scalar()  # one array of years
    grid = metrics.select("items", "size").distinct().select("items", "size", F.explode(years).alias("year"))
    return grid.join(metrics.select("items", "year", "supp"), ["items", "year"], "left").select("items", "size", "year", F.log1p(F.coalesce("supp", F.lit(0.0))).alias("z"))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _ar1(h: Column) -> Column:
    """Least squares of each value on the one before, carried on by one step. Sums are centred."""
    n = F.size(h)
    x, y = F.slice(h, F.lit(1), n - 1), F.slice(h, F.lit(2), n - 1)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mx, my = _mean(x), _mean(y)
    sxx = total(F.transform(x, lambda v: (v - mx) * (v - mx)))
    sxy = total(F.zip_with(x, y, lambda v, w: (v - mx) * (w - my)))
    slope = F.when(sxx > 1e-12, sxy / sxx).otherwise(0.0)
    return F.when(n == 1, F.element_at(h, -1)).otherwise(slope * F.element_at(h, -1) + my - slope * F.when(sxx > 1e-12, mx).otherwise(0.0))


def residuals(z: DataFrame, baseline: str = "drift", window: int = 5, key: str = "items") -> DataFrame:
    """z with z_hat from the `window` entries before, and residual. History is by position in the list of years."""
    past = Window.partitionBy(key).orderBy("year").rowsBetween(-window, -1)
    n, mean = F.count("z").over(past), F.avg("z").over(past)
    if baseline == "drift":
        drift = F.when(n > 1, (F.last("z").over(past) - F.first("z").over(past)) / (n - 1)).otherwise(0.0)
        hat = mean + drift
    elif baseline == "ar1":
        hat = _ar1(F.collect_list("z").over(past))
    elif baseline == "mean":
        hat = mean
    else:
        raise ValueError("baseline is drift, ar1 or mean")
    return z.withColumn("_n", n).withColumn("_hat", hat).withColumn("z_hat", F.when(F.col("_n") == 0, F.col("z")).otherwise(F.col("_hat"))).drop("_n", "_hat").withColumn("residual", F.col("z") - F.col("z_hat"))


def residual_forecast(found: DataFrame, forecast_year: int, window: int = 5, first_year: int = 2005) -> DataFrame:
    """items, size, predicted_residual: the mean residual of the last `window` years; 0 without any."""
    recent = F.col("year") >= max(first_year, forecast_year - window)
    return found.groupBy("items", "size").agg(F.coalesce(F.avg(F.when(recent, F.col("residual"))), F.lit(0.0)).alias("predicted_residual"))


def rank_by_residual(forecasts: DataFrame, top_m: int) -> DataFrame:
    return forecasts.orderBy(F.desc(F.round("predicted_residual", 9)), "size", "items").limit(top_m)


def linear_trend(z: DataFrame) -> DataFrame:
    """items, size, n, zs (in order), recent (whether the last change is upward), linear_slope, linear_r2."""
    at = F.row_number().over(Window.partitionBy("items").orderBy("year")) - 1
    grouped = z.withColumn("t", at.cast("double")).groupBy("items", "size").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("year", "z"))).alias("p"), F.regr_slope("z", "t").alias("slope"), F.regr_r2("z", "t").alias("r2"), F.sum(F.abs("z")).alias("mass"))
    zs = F.transform("p", lambda x: x["z"])
    flat = (F.col("n") < 2) | (F.col("mass") < 1e-10)
    recent = F.when(F.col("n") < 3, True).otherwise(F.element_at(zs, -1) > F.get(zs, F.size(zs) - 3))
    return grouped.select("items", "size", "n", zs.alias("zs"), recent.alias("recent"), F.when(flat, 0.0).otherwise(F.coalesce("slope", F.lit(0.0))).alias("linear_slope"), F.when(flat, 0.0).otherwise(F.coalesce("r2", F.lit(0.0))).alias("linear_r2"))


# ---- curves: the one place here that needs Python


def levenberg(model, start: list[float], x: np.ndarray, y: np.ndarray, most: int = 5000) -> np.ndarray | None:
    """Least squares by Levenberg and Marquardt with numeric derivatives; None if it fails."""
    p, lam, calls = np.array(start, dtype=float), 1e-3, 0
    with np.errstate(all="ignore"):
        r = model(x, *p) - y
        cost = float(r @ r)
        while calls < most and np.isfinite(cost):
            steps = 1e-7 * np.maximum(np.abs(p), 1e-3)
            jac = np.stack([(model(x, *(p + np.eye(len(p))[k] * steps[k])) - model(x, *p)) / steps[k] for k in range(len(p))], axis=1)
            calls += len(p) + 1
            if not np.isfinite(jac).all():
                return None
            grad, square = jac.T @ r, jac.T @ jac
            for _ in range(40):
                try:
                    step = np.linalg.solve(square + lam * np.diag(np.maximum(np.diag(square), 1e-12)), -grad)
                except np.linalg.LinAlgError:
                    return None
                new_r = model(x, *(p + step)) - y
                calls += 1
                new_cost = float(new_r @ new_r)
                if np.isfinite(new_cost) and new_cost <= cost:
                    break
                lam *= 4
            else:
                return p
            done = cost - new_cost <= 1e-14 * max(cost, 1e-30) or float(np.abs(step).max()) < 1e-12
            p, r, cost, lam = p + step, new_r, new_cost, max(lam / 6, 1e-12)
            if done:
                return p
    return None


def exponential(t, y0, k):
    return y0 * np.exp(k * t)


def logistic(t, top, k, mid):
    return top / (1 + np.exp(-k * (t - mid)))


def fit_curves(zs: np.ndarray, models: tuple[str, ...]) -> tuple[float, float, str]:
    """(growth of the exponential, growth of the logistic, the model that fits), 0 for a fit that fails."""
    n, t = len(zs), np.arange(len(zs), dtype=float)
    exp_k = logistic_k = 0.0
    fits = "none"
    if n < 2 or np.abs(zs).sum() < 1e-10:
        return 0.0, 0.0, "constant"
    if "exponential" in models and (zs > 0).all():
        p = levenberg(exponential, [float(zs[0]), 0.1], t, zs)
        if p is not None and np.isfinite(p).all():
            exp_k = float(p[1])
            fits = "exponential" if np.mean((exponential(t, *p) - zs) ** 2) < 1e-6 else fits
    if "logistic" in models:
        p = levenberg(logistic, [1.5 * float(zs.max()), 1.0, n / 2], t, zs)
        if p is not None and np.isfinite(p).all():
            logistic_k = float(p[1])
            if fits == "none" and np.mean((logistic(t, *p) - zs) ** 2) < 1e-6:
                fits = "logistic"
    return exp_k, logistic_k, fits


def trend_curves(trend: DataFrame, models: tuple[str, ...] = ("linear",)) -> DataFrame:
    """trend with exp_k, logistic_k, model_fit and trend_score. Linear trends alone stay inside the JVM."""
    flat = (F.col("n") < 2) | (F.aggregate("zs", F.lit(0.0), lambda s, x: s + F.abs(x)) < 1e-10)
    if set(models) <= {"linear"}:
        fitted = trend.withColumn("exp_k", F.lit(0.0)).withColumn("logistic_k", F.lit(0.0)).withColumn("model_fit", F.when(flat, "constant").otherwise("none"))
    else:

        def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                found = [fit_curves(np.asarray(z, dtype=float), models) for z in f["zs"]]
                yield f.assign(exp_k=[x[0] for x in found], logistic_k=[x[1] for x in found], model_fit=[x[2] for x in found])

        schema = ", ".join(f"{c} {t}" for c, t in trend.dtypes) + ", exp_k double, logistic_k double, model_fit string"
        fitted = trend.mapInPandas(fit, schema)
    return fitted.withColumn("trend_score", 0.5 * F.col("linear_slope") + 0.25 * F.col("exp_k") + 0.25 * F.col("logistic_k"))


def rank_by_trend(z: DataFrame, p: ItemsetConfig) -> DataFrame:
    """rank, items, size, ... of the itemsets whose last change is upward and whose score is positive."""
    scored = trend_curves(linear_trend(z).filter("recent"), p.trend_models).filter("trend_score > 0")
    top = scored.orderBy(F.desc(F.round("trend_score", 9)), "size", "items").limit(p.top_m)
    order = Window.orderBy(F.desc(F.round("trend_score", 9)), "size", "items")  # top_m rows
    return top.withColumn("rank", F.row_number().over(order)).select("rank", "items", "size", "trend_score", "exp_k", "logistic_k", "linear_slope", "linear_r2", "model_fit")


def rank_itemsets(z: DataFrame, found: DataFrame, p: ItemsetConfig) -> tuple[str, DataFrame]:
    """("trend", ranking), or ("residual", ranking) where no trend is positive."""
    by_trend = rank_by_trend(z, p)
    if not by_trend.isEmpty():
        return "trend", by_trend
    return "residual", rank_by_residual(residual_forecast(found, p.forecast_year, p.window), p.top_m)
