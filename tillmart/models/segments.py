"""K-means customer segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import round_half_even
from ..operators.aggregates import minmax_profile
from ..operators.shared_storage import materialize, spread
from . import lloyd
from .scaling import scale_parameters, standardize

# The features, the seed and the number of restarts.
DIMS = ["recency", "frequency", "monetary", "food_item_pct"]
K, SEED, RESTARTS = 4, 42, 10
SCORES = [f"{c}_z" for c in DIMS]
ELBOW_RANGE = range(2, 9)


def segment_features(features: DataFrame) -> DataFrame:
    """Customers with positive spend and their four standard scores; a missing food share counts as 0."""
    rows = materialize(features.filter("count_lifetime_orders is not null and lifetime_spend > 0").select(
        "customer_id", F.col("days_since_last_order").cast("double").alias("recency"),
        F.col("count_lifetime_orders").cast("double").alias("frequency"),
        F.col("lifetime_spend").cast("double").alias("monetary"), "food_item_pct"))
    filled = rows.withColumn("food_known", F.col("food_item_pct")).fillna(0.0, ["food_item_pct"])
    return standardize(filled, DIMS, scale_parameters(filled, DIMS))


def _points(features: DataFrame) -> DataFrame:
    return materialize(spread(segment_features(features), "customer_id"))


def _nearest(centres: Sequence[Sequence[float]]) -> Column:
    """The place of the nearest centre, from 0; the first one on ties."""
    far = [sum((F.col(c) - F.lit(float(x))) ** 2 for c, x in zip(SCORES, centre)) for centre in centres]
    return F.array_position(F.array(*far), F.array_min(F.array(*far))) - 1


def _named(rows: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    return rows.select("customer_id", "recency", "frequency", "monetary", F.col("food_known").alias("food_item_pct"),
                       F.concat(F.lit("Cluster "), _nearest(centres).cast("string")).alias("cluster"))


def kmeans_segments(features: DataFrame, k: int = K, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """Customers with their cluster. Clusters are named by descending size, so that names do not depend on seeds."""
    rows = _points(features)
    fit = lloyd.best_fits(rows, SCORES, "customer_id", [k], restarts, seed)[0]
    by_size = sorted(range(k), key=lambda c: (-fit.sizes[c], *fit.centres[c]))
    return _named(rows, [fit.centres[c] for c in by_size])


def assign_clusters(features: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """Customers with the nearest of given centres (in standard scores); the first one on ties."""
    return _named(segment_features(features), centres)


def cluster_step(features: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """What one step from given centres makes of them: customers, cost before it and the new centre per cluster."""
    sums = lloyd.step(segment_features(features), SCORES, [centres])
    return sums.select("cluster", F.col("n").alias("customers"), "cost",
                       *[(F.col(f"s{j}") / F.nullif("n", F.lit(0))).alias(c) for j, c in enumerate(DIMS)])


def given_silhouette(features: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """The mean silhouette, by squared distances, of customers at the nearest of given centres."""
    return lloyd.silhouettes(segment_features(features), SCORES, [centres]).select("silhouette_squared")


def elbow(features: DataFrame, ks: Sequence[int] = ELBOW_RANGE, restarts: int = RESTARTS, seed: int = SEED
          ) -> DataFrame:
    """Inertia and silhouette for each k. The silhouette uses squared distances, which takes linear time; the one of
    plain distances needs all pairs."""
    rows = _points(features)
    fits = lloyd.best_fits(rows, SCORES, "customer_id", list(ks), restarts, seed)
    judged = {r["model"]: r["silhouette_squared"] for r in lloyd.silhouettes(rows, SCORES, [f.centres for f in fits]).collect()}
    out = [(k, f.cost, round(judged[i], 3)) for i, (k, f) in enumerate(zip(ks, fits))]
    return features.sparkSession.createDataFrame(out, "k int, inertia double, silhouette_squared double")


def cluster_profiles(segments: DataFrame) -> DataFrame:
    return segments.groupBy("cluster").agg(
        F.count("customer_id").alias("customers"), *[round_half_even(F.avg(c), 1).alias(name) for c, name in (
            ("recency", "avg_recency"), ("frequency", "avg_frequency"), ("monetary", "avg_spend"),
            ("food_item_pct", "avg_food_pct"))])


def cluster_radar(profiles: DataFrame) -> DataFrame:
    """Profile values scaled to 0..1 over the clusters, recency turned so that more is better."""
    dims = ["avg_recency", "avg_frequency", "avg_spend", "avg_food_pct"]
    return minmax_profile(profiles.select("cluster", *dims), dims, constant=None).withColumn(
        "avg_recency", 1 - F.col("avg_recency"))
