"""Lifetime value: repeat-purchase summary, BG/NBD and Gamma-Gamma fits, forecast and report.

The likelihoods are those of Fader, Hardie and Lee (2005) and Fader and Hardie (2013). Each evaluation is one Spark
job that sums over the customers; only the sums reach the driver. A Newton step sums the analytic first and second
derivatives beside the likelihood.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import days_between, safe_div
from ..operators.ordered import exact_medians, exact_quantiles
from ..operators.shared_storage import materialize, spread
from .special import Slopes, digamma, hyp2f1, lgamma, minimize, newton, trigamma

PENALTY = 0.001
FORECAST_DAYS, DISCOUNT, STEP_DAYS = 90, 0.01, 30


def purchase_summary(orders: DataFrame) -> DataFrame:
    """Per customer: repeat purchase days, days from first to last, days since the first, mean repeat-day value.

    Purchases of one day count once, and the first day is left out of the mean. Orders without a customer are nobody's
    and stay out. Orders are rolled up to (customer,
    day) first, so a very active customer is spread over tasks before the second aggregation.
    """
    days = orders.filter("customer_id is not null").groupBy("customer_id", "ordered_at").agg(F.sum("order_total").alias("value"))
    end = orders.agg(F.max("ordered_at")).scalar()
    per_customer = days.groupBy("customer_id").agg(
        (F.count("*") - 1).alias("frequency"), F.min("ordered_at").alias("_first"),
        F.max("ordered_at").alias("_last"), F.sum("value").alias("_all"),
        F.min_by("value", "ordered_at").alias("_first_value"))
    repeat_value = safe_div(F.col("_all") - F.col("_first_value"), "frequency")
    return per_customer.select(
        "customer_id", "frequency", days_between("_first", "_last").alias("recency"),
        days_between("_first", end).alias("T"), F.coalesce(repeat_value, F.lit(0.0)).alias("monetary_value"))


def repeat_correlation(summary: DataFrame) -> DataFrame:
    """Customers, repeat customers, and the correlation of frequency and value among the latter."""
    repeat = F.col("frequency") > 0
    return summary.agg(
        F.count("*").alias("customers"), F.count_if(repeat).alias("repeat_customers"),
        F.count_if(~repeat).alias("one_time_customers"),
        F.corr(F.when(repeat, F.col("frequency").cast("double")), F.when(repeat, F.col("monetary_value")))
        .alias("freq_monetary_corr"))


Loglik = Callable[[np.ndarray, pd.DataFrame], np.ndarray]


def bg_nbd_loglik(params: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    r, alpha, a, b = params
    x, recency, age = (rows[c].to_numpy(float) for c in ("frequency", "recency", "T"))
    common = (lgamma(r + x) - lgamma(r) + r * np.log(alpha)
              + lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x))
    alive = -(r + x) * np.log(alpha + age)
    gone = np.log(a) - np.log(b + np.maximum(x, 1) - 1) - (r + x) * np.log(alpha + recency)
    return common + np.logaddexp(alive, np.where(x > 0, gone, -np.inf))


def gamma_gamma_loglik(params: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    p, q, v = params
    x, m = rows["frequency"].to_numpy(float), rows["monetary_value"].to_numpy(float)
    return (lgamma(p * x + q) - lgamma(p * x) - lgamma(q) + q * np.log(v)
            + (p * x - 1) * np.log(m) + p * x * np.log(x) - (p * x + q) * np.log(x * m + v))


def bg_nbd_slopes(params: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    """First derivatives of ``bg_nbd_loglik`` by (r, alpha, a, b), then the second ones, lower triangle by rows."""
    r, alpha, a, b = params
    x, recency, age = (rows[c].to_numpy(float) for c in ("frequency", "recency", "T"))
    last = b + np.maximum(x, 1) - 1
    alive = -(r + x) * np.log(alpha + age)
    gone = np.where(x > 0, np.log(a) - np.log(last) - (r + x) * np.log(alpha + recency), -np.inf)
    left = np.exp(gone - np.logaddexp(alive, gone))  # the chance that the customer left after the last purchase
    none = np.zeros(len(x))
    up_alive = np.array([-np.log(alpha + age), -(r + x) / (alpha + age), none, none])
    up_gone = np.array([-np.log(alpha + recency), -(r + x) / (alpha + recency), none + 1 / a, -1 / last])
    apart, both = trigamma(a + b) - trigamma(a + b + x), digamma(a + b) - digamma(a + b + x)
    first = (1 - left) * up_alive + left * up_gone + np.array([
        digamma(r + x) - digamma(r) + np.log(alpha), none + r / alpha, both, both + digamma(b + x) - digamma(b)])
    mixed = [(i, j) for i in range(4) for j in range(i + 1)]
    second = {(i, j): left * (1 - left) * (up_gone[i] - up_alive[i]) * (up_gone[j] - up_alive[j]) for i, j in mixed}
    second[0, 0] += trigamma(r + x) - trigamma(r)
    second[1, 0] += 1 / alpha - (1 - left) / (alpha + age) - left / (alpha + recency)
    second[1, 1] += (r + x) * ((1 - left) / (alpha + age) ** 2 + left / (alpha + recency) ** 2) - r / alpha ** 2
    second[2, 2] += apart - left / a ** 2
    second[3, 2] += apart
    second[3, 3] += apart + trigamma(b + x) - trigamma(b) + left / last ** 2
    return np.array([*first, *[second[k] for k in mixed]])


def gamma_gamma_slopes(params: np.ndarray, rows: pd.DataFrame) -> np.ndarray:
    """First derivatives of ``gamma_gamma_loglik`` by (p, q, v), then the second ones, lower triangle by rows."""
    p, q, v = params
    x, m = rows["frequency"].to_numpy(float), rows["monetary_value"].to_numpy(float)
    shape, whole = p * x + q, x * m + v
    return np.array([
        x * (digamma(shape) - digamma(p * x) + np.log(m) + np.log(x) - np.log(whole)),
        digamma(shape) - digamma(q) + np.log(v) - np.log(whole), q / v - shape / whole,
        x ** 2 * (trigamma(shape) - trigamma(p * x)),
        x * trigamma(shape), trigamma(shape) - trigamma(q),
        -x / whole, 1 / v - 1 / whole, shape / whole ** 2 - q / v ** 2])


def fit_loglik(rows: DataFrame, loglik: Loglik, n_params: int, penalty: float = PENALTY, slopes: Loglik | None = None
               ) -> np.ndarray:
    """Positive parameters that maximize the mean log-likelihood minus ``penalty`` times their squared sum.

    ``rows`` carries a ``weight`` column and should be stored, since every step reads it. With ``slopes``, the derivatives by
    the parameters, a step is one job that sums values and derivatives; without, it takes differences of many points.
    """
    total = rows.agg(F.sum("weight")).first()[0]

    def losses(points: np.ndarray) -> np.ndarray:
        params = np.exp(points)
        value = np.full(len(params), np.nan)
        for point, s in loglik_sums(rows, loglik, params).collect():
            value[point] = s
        return -value / total + penalty * (params ** 2).sum(axis=1)

    def derivatives(point: np.ndarray) -> Slopes:
        """By the logarithms of the parameters."""
        params = np.exp(point)
        sums = np.zeros(1 + n_params + n_params * (n_params + 1) // 2)
        for place, s in slope_sums(rows, loglik, slopes, params).collect():
            sums[place] = s
        means = -sums / total
        first, second = means[1:n_params + 1] * params, np.zeros((n_params, n_params))
        second[np.tril_indices(n_params)] = means[n_params + 1:]
        second = (second + np.tril(second, -1).T) * np.outer(params, params)
        square = penalty * params ** 2
        return means[0] + square.sum(), first + 2 * square, second + np.diag(first + 4 * square)

    start = np.zeros(n_params)
    return np.exp(minimize(losses, start) if slopes is None else newton(derivatives, losses, start))


def slope_sums(rows: DataFrame, loglik: Loglik, slopes: Loglik, params: np.ndarray) -> DataFrame:
    """(place, total): the weighted log-likelihood of the rows at place 0, then its derivatives in the order of ``slopes``."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = 0.0
        for batch in batches:
            every = np.vstack([loglik(params, batch), slopes(params, batch)])
            sums = sums + every @ batch["weight"].to_numpy(float)
        if np.ndim(sums):
            yield pd.DataFrame({"place": range(len(sums)), "total": sums})

    return rows.mapInPandas(partial, "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))


def loglik_sums(rows: DataFrame, loglik: Loglik, params: np.ndarray) -> DataFrame:
    """(point, loglik): the weighted log-likelihood of the rows under each row of ``params``."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(len(params))
        for batch in batches:
            w = batch["weight"].to_numpy(float)
            sums += [float(w @ loglik(p, batch)) for p in params]
        yield pd.DataFrame({"point": range(len(params)), "loglik": sums})

    return rows.mapInPandas(partial, "point int, loglik double").groupBy("point").agg(F.sum("loglik").alias("loglik"))


@dataclass(frozen=True)
class LtvModel:
    r: float
    alpha: float
    a: float
    b: float
    p: float
    q: float
    v: float

    def expected_value(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Expected value of a purchase: the customer's mean shrunk to the population mean."""
        own = self.p * x / (self.p * x + self.q - 1)
        return (1 - own) * (self.v * self.p / (self.q - 1)) + own * m

    def expected_purchases(self, t: float, x: np.ndarray, recency: np.ndarray, age: np.ndarray) -> np.ndarray:
        r, alpha, a, b = self.r, self.alpha, self.a, self.b
        if abs(a - 1) < 1e-6:  # the formula has a removable pole there
            a += 1e-6
        hyper = hyp2f1(r + x, b + x, a + b + x - 1, t / (alpha + age + t))
        grown = 1 - hyper * np.exp((r + x) * np.log((alpha + age) / (alpha + age + t)))
        odds_gone = np.where(x > 0, a / (b + np.maximum(x, 1) - 1)
                             * np.exp((r + x) * np.log((alpha + age) / (alpha + recency))), 0.0)
        return (a + b + x - 1) / (a - 1) * grown / (1 + odds_gone)


def fit(summary: DataFrame, penalty: float = PENALTY) -> LtvModel:
    """Fit both models; reads the summary three times, so pass a stored one.

    Ages are scaled to at most 10 for the fit, so that the penalty sees parameters of one size.
    """
    oldest = summary.agg(F.max("T")).first()[0] or 1
    scale = 10.0 / max(oldest, 1)
    ages = summary.groupBy("frequency", "recency", "T").agg(F.count("*").alias("weight")).select(
        "frequency", (F.col("recency") * scale).alias("recency"), (F.col("T") * scale).alias("T"), "weight")
    counted = materialize(spread(ages, "frequency", "recency", "T"))
    r, alpha, a, b = fit_loglik(counted, bg_nbd_loglik, 4, penalty, bg_nbd_slopes)
    worthless = summary.filter("frequency > 0 and not coalesce(monetary_value > 0, false)").count()
    if worthless:
        raise ValueError(f"{worthless} repeat customers have no positive purchase value; the value model needs one")
    values = summary.filter("frequency > 0").groupBy("frequency", "monetary_value").agg(
        F.count("*").alias("weight"))
    repeat = materialize(spread(values, "frequency", "monetary_value"))
    p, q, v = fit_loglik(repeat, gamma_gamma_loglik, 3, penalty, gamma_gamma_slopes)
    return LtvModel(r, alpha / scale, a, b, p, q, v)


def forecast(summary: DataFrame, model: LtvModel, days: int = FORECAST_DAYS, discount: float = DISCOUNT) -> DataFrame:
    """Repeat customers with expected purchases in the period, expected value of one, and discounted value.

    Value is discounted month by month; a month that has begun counts as a whole one, so 20 days are valued as 30 and 75
    as 90.
    """
    steps = [STEP_DAYS * i for i in range(1, -(-days // STEP_DAYS) + 1)]

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x, recency, age, m = (rows[c].to_numpy(float) for c in ("frequency", "recency", "T", "monetary_value"))
            value = model.expected_value(x, m)
            clv, before = np.zeros(len(rows)), np.zeros(len(rows))
            for i, t in enumerate(steps, 1):
                until = model.expected_purchases(t, x, recency, age)
                clv += value * (until - before) / (1 + discount) ** i
                before = until
            yield rows.assign(predicted_avg_order_value=value, clv_forecast=clv,
                              expected_purchases=model.expected_purchases(days, x, recency, age))

    fields = ", ".join(f"{n} {t}" for n, t in summary.dtypes)
    return summary.filter("frequency > 0").mapInPandas(
        predict, f"{fields}, predicted_avg_order_value double, clv_forecast double, expected_purchases double")


REPORT_COLUMNS = ["predicted_avg_order_value", "expected_purchases", "clv_forecast"]


def describe(forecasts: DataFrame, columns: Sequence[str] = REPORT_COLUMNS) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per column."""
    forecasts = materialize(forecasts.select(*columns))  # read twice
    quartiles = exact_quantiles(forecasts, columns, [0.25, 0.5, 0.75]).select(F.struct("*")).scalar()
    one = forecasts.agg(*[F.struct(
        F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in columns])
    with_quartiles = one.select(*[F.struct(
        f"{c}.*", *[quartiles.getField(f"{c}_q{j}").alias(n) for j, n in enumerate(("p25", "p50", "p75"))]).alias(c)
        for c in columns])
    return with_quartiles.select(F.explode(F.array(*columns)).alias("r")).select("r.*")


def report(forecasts: DataFrame) -> DataFrame:
    """Customers modelled, total and median forecast value."""
    forecasts = materialize(forecasts.select("clv_forecast"))  # read twice
    median = exact_medians(forecasts, ["clv_forecast"]).select("clv_forecast").scalar()
    return forecasts.agg(F.count("*").alias("repeat_customers"), F.sum("clv_forecast").alias("total_clv")).withColumn(
        "median_clv", median)


def top_customers(forecasts: DataFrame, k: int = 10) -> DataFrame:
    return forecasts.orderBy(F.col("clv_forecast").desc(), "customer_id").limit(k)
