"""Churn model: imputation, stratified split, two balanced classifiers, metrics, attributions and scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..deploy import ship
from ..functions import safe_div
from ..operators.ordered import exact_medians, number_rows_within, prefix_sum
from ..operators.shared_storage import materialize, new_folder, spread
from .scaling import assemble, scale_parameters, standardize
from .shapley import TREES as TREE_ROWS
from .shapley import as_nodes, as_rows, attributions, leaves_of_trees, tree_arrays, tree_scores

# The model inputs. Recency-window features are left out because they restate the label.
FEATURES = ["count_lifetime_orders", "lifetime_spend", "avg_order_value", "avg_days_between_orders",
            "stddev_days_between_orders", "food_item_pct", "drink_item_pct"]
LABEL = "is_churned"
TREES, DEPTH, SEED, TEST_SHARE = 300, 6, 42, 0.25
EXPLAINED = 50_000  # rows that are attributed at a time


def impute_medians(features: DataFrame) -> DataFrame:
    """The model columns as doubles, NULLs replaced by the median of the column."""
    base = materialize(features.select("customer_id", "customer_name", LABEL,
                                       *[F.col(c).cast("double").alias(c) for c in FEATURES]))
    medians = exact_medians(base, FEATURES).select(F.struct(*FEATURES)).scalar()
    return base.select("customer_id", "customer_name", LABEL,
                       *[F.coalesce(F.col(c), medians.getField(c), F.lit(0.0)).alias(c) for c in FEATURES])


def stratified_split(df: DataFrame, label: str = LABEL, key: str = "customer_id", test_share: float = TEST_SHARE,
                     seed: int = SEED) -> DataFrame:
    """Add ``is_test``: a share of each class, chosen by a seeded hash of the key, so that every run agrees.

    The test size is the share of all rows, rounded up. Each class gets its part rounded down; rows left over go to
    the classes with the largest remainders.
    """
    shuffled = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    numbered = number_rows_within(df, [label], [shuffled.asc(), F.col(key).asc()], "_n")
    classes = df.groupBy(label).agg(F.count("*").alias("_size"))
    everything = W.partitionBy(F.lit(1))  # one row per class
    n = F.sum("_size").over(everything)
    sized = (classes.withColumn("_test", F.ceil(n * test_share).cast("bigint")).withColumn("_total", n)
             .withColumn("_product", F.col("_test").cast("decimal(19,0)") * F.col("_size").cast("decimal(19,0)"))
             .withColumn("_floor", F.expr("_product div _total"))
             .withColumn("_left", F.col("_product") - F.col("_floor") * F.col("_total"))
             .withColumn("_spare", F.col("_test") - F.sum("_floor").over(everything))
             .withColumn("_turn", F.row_number().over(everything.orderBy(F.col("_left").desc(), F.col(label).desc())))
             .select(label, (F.col("_floor") + (F.col("_turn") <= F.col("_spare")).cast("int")).alias("_quota")))
    return numbered.join(F.broadcast(sized), label).withColumn("is_test", F.col("_n") <= F.col("_quota")).select(
        *df.columns, "is_test")


def split_sizes(split: DataFrame, label: str = LABEL) -> DataFrame:
    """Training and test rows, and the share of churned customers among all."""
    return split.agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"),
                     F.avg(F.col(label).cast("double")).alias("churn_rate"))


def with_class_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """Add ``weight`` = rows / (2 * rows of the class), and a numeric label."""
    sizes = train.agg(F.struct(F.count_if(label).alias("yes"), F.count_if(~F.col(label)).alias("no"))).scalar()
    yes, no = sizes.getField("yes"), sizes.getField("no")
    own = F.when(F.col(label), yes).otherwise(no)
    return train.withColumn("weight", safe_div(yes + no, own * 2)).withColumn("label", F.col(label).cast("double"))


def fit_logistic(train: DataFrame, max_iter: int = 1000) -> LogisticRegressionModel:
    """L2 logistic regression with unit inverse strength: the penalty is one per row of weighted loss.

    Expects the standardized features in ``scaled``.
    """
    n = train.count()
    return LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", maxIter=max_iter, tol=1e-8,
                              regParam=1.0 / n, elasticNetParam=0.0, standardization=False).fit(train)


def logistic_scores(rows: DataFrame, intercept: float, weights: dict[str, float]) -> DataFrame:
    """Rows with the churn probability under given weights of their columns."""
    logit = sum((F.col(c).cast("double") * F.lit(float(w)) for c, w in weights.items()), F.lit(float(intercept)))
    return rows.withColumn("churn_probability", 1 / (1 + F.exp(-logit)))


def fit_forest(train: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED
               ) -> RandomForestClassificationModel:
    """Node ids are cached: each level moves a row by one node in every tree instead of walking the trees from their roots."""
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=trees,
                                  maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True).fit(train)


def _forest_nodes(forest: RandomForestClassificationModel) -> pd.DataFrame:
    """Nodes of a fitted forest: at most trees * 2^(depth + 1) rows, a bound that the parameters set."""
    spark = SparkSession.active()
    folder = new_folder(spark, "forest")
    forest.write().save(folder)
    return spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").toPandas()


def forest_rows(forest: RandomForestClassificationModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """A fitted forest as rows that can be stored, compared and scored without the model (``shapley.TREES``)."""
    return SparkSession.active().createDataFrame(as_rows(_forest_nodes(forest), features), TREE_ROWS)


def forest_scores(rows: DataFrame, trees: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Rows with the churn probability under given trees: the mean share of churned weight in the leaves they reach.

    Every tree is walked in columns, level by level, over the trees as one array. A null goes right, as a value above the
    threshold does. Without trees the probability is null.
    """
    at = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")).cast("int") - 1
    node = F.struct("node", "level", at.alias("at"), "threshold", "left", "right",
                    safe_div("churned", "weight").alias("share"))
    levels = F.sequence(F.lit(0), F.max("level"))  # one step more than needed, so that a lone root has a step, too
    forest = trees.groupBy("tree").agg(F.struct(F.array_sort(F.collect_list(node)).alias("nodes"), levels.alias("levels")).alias(
        "tree_nodes")).agg(F.collect_list("tree_nodes")).scalar()  # as many nodes as the forest has
    return (rows.withColumn("_x", F.array(*[F.col(f).cast("double") for f in features])).withColumn("_forest", forest)
            .withColumn("_leaves", F.transform("_forest", _leaf_share))
            .withColumn("churn_probability", F.aggregate("_leaves", F.lit(0.0), lambda total, s: total + s)
                        / F.nullif(F.size("_leaves"), F.lit(0)))
            .drop("_x", "_forest", "_leaves"))


def fitted_forest_scores(rows: DataFrame, nodes: pd.DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Rows with the churn probability under the nodes of a fitted forest; the features must not be null.

    Only numbers travel to the tasks: a fitted model in the closure of a task would take its training summary along.
    """
    names, kept = list(features), rows.select(*[c for c, t in rows.dtypes if t != "vector"])
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(tree_arrays(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in names]).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree_scores(shared.value, x))],
                                             names=[*batch.schema.names, "churn_probability"])

    return kept.mapInArrow(run, StructType(list(kept.schema.fields)).add("churn_probability", "double"))


def _leaf_share(tree: Column) -> Column:
    """The share at the leaf of ``tree``, an array of nodes, that the features in ``_x`` lead to."""
    def below(place: Column) -> Column:
        node = F.get(tree["nodes"], place)
        left = F.coalesce(F.get(F.col("_x"), node["at"]) <= node["threshold"], F.lit(False))
        return F.when(node["at"].isNull(), place).when(left, node["left"]).otherwise(node["right"])

    return F.get(tree["nodes"], F.aggregate(tree["levels"], F.lit(0), lambda place, _: below(place)))["share"]


def explain(rows: DataFrame, nodes: pd.DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Shapley values of the churn probability of each row, with the base value."""
    names = list(features)
    shared = rows.sparkSession.sparkContext.broadcast(leaves_of_trees(nodes, len(names)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _blocks(batches):
            base, phi = attributions(shared.value, batch[names].to_numpy(float))
            yield pd.DataFrame({"customer_id": batch["customer_id"], "base_value": np.full(len(batch), base),
                                **{f: phi[:, j] for j, f in enumerate(names)}})

    key_type = dict(rows.dtypes)["customer_id"]
    schema = f"customer_id {key_type}, base_value double, " + ", ".join(f"{f} double" for f in names)
    return spread(rows.select("customer_id", *names), "customer_id").mapInPandas(run, schema)


def given_attributions(rows: DataFrame, trees: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """``explain`` for trees given as rows; the features must not be null."""
    ship(rows.sparkSession)
    return explain(rows, as_nodes(trees.toPandas(), features), features)


def score_metrics(scored: DataFrame, label: str = LABEL, score: str = "churn_probability", threshold: float = 0.5
                  ) -> DataFrame:
    """Precision, recall, F1 (0 where undefined) and the area under the ROC curve (ties count half)."""
    yes = F.col(label).cast("boolean")
    by_score = scored.groupBy(F.col(score).alias("_score")).agg(
        F.count_if(yes).alias("_yes"), F.count_if(~yes).alias("_no"))
    running = prefix_sum(by_score, [F.col("_score").asc()], "_no", "_no_to")
    picked = F.col("_score") > threshold
    counts = running.agg(
        F.sum(F.when(picked, F.col("_yes")).otherwise(0)).alias("tp"),
        F.sum(F.when(picked, F.col("_no")).otherwise(0)).alias("fp"),
        F.sum("_yes").alias("yes"), F.sum("_no").alias("no"),
        F.sum(F.col("_yes").cast("double") * (F.col("_no_to") * 2 - F.col("_no"))).alias("_twice_above"))
    zero = F.lit(0.0)
    return (counts.withColumn("precision", F.coalesce(safe_div("tp", F.col("tp") + F.col("fp")), zero))
            .withColumn("recall", F.coalesce(safe_div("tp", "yes"), zero))
            .withColumn("f1", F.coalesce(safe_div(F.col("tp") * 2, F.col("tp") + F.col("fp") + F.col("yes")), zero))
            .withColumn("roc_auc", safe_div("_twice_above", F.col("yes").cast("double") * F.col("no") * 2))
            .select("precision", "recall", "f1", "roc_auc"))


def at_risk(scored: DataFrame, threshold: float = 0.5, score: str = "churn_probability") -> DataFrame:
    """Customers at or above the threshold, most at risk first."""
    return scored.filter(F.col(score) >= threshold).orderBy(F.col(score).desc(), "customer_id")


def _blocks(batches: Iterator[pd.DataFrame], rows: int = EXPLAINED) -> Iterator[pd.DataFrame]:
    """Batches put together up to about ``rows`` rows, so tables that cost the same for any number are built rarely."""
    waiting: list[pd.DataFrame] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= rows:
            yield pd.concat(waiting)
            waiting = []
    if waiting:
        yield pd.concat(waiting)


class ChurnModel:
    """Everything fitted by :func:`train`: the prepared rows, both classifiers and the results drawn from them."""

    def __init__(self, rows: DataFrame, logistic: LogisticRegressionModel, forest: RandomForestClassificationModel):
        self.rows, self.logistic, self.forest = rows, logistic, forest

    def _by_logistic(self, rows: DataFrame) -> DataFrame:
        weights = dict(zip([f"{c}_z" for c in FEATURES], self.logistic.coefficients.toArray()))
        return logistic_scores(rows, self.logistic.intercept, weights)

    def _by_forest(self, rows: DataFrame) -> DataFrame:
        return fitted_forest_scores(rows, _forest_nodes(self.forest))

    def metrics(self) -> DataFrame:
        test = self.rows.filter("is_test")
        parts = [score_metrics(scored(test)).withColumn("model", F.lit(name)) for name, scored in
                 (("logistic_regression", self._by_logistic), ("random_forest", self._by_forest))]
        return parts[0].unionByName(parts[1]).select("model", "precision", "recall", "f1", "roc_auc")

    def sizes(self) -> DataFrame:
        return split_sizes(self.rows)

    def scores(self) -> DataFrame:
        """Forest probability for every customer."""
        return self._by_forest(self.rows).select("customer_id", "customer_name", LABEL, "churn_probability")

    def attributions(self) -> DataFrame:
        """Shapley values of the forest's churn probability for each test row, with the base value."""
        return explain(self.rows.filter("is_test"), _forest_nodes(self.forest))

    def feature_importance(self) -> DataFrame:
        means = self.attributions().agg(*[F.avg(F.abs(f)).alias(f) for f in FEATURES])
        return means.unpivot([], FEATURES, "feature", "mean_abs_shap").orderBy(F.col("mean_abs_shap").desc())


def train(features: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> ChurnModel:
    """Impute, split, scale on the training rows, and fit both classifiers. Rows are stored once and read per pass."""
    rows = materialize(stratified_split(impute_medians(features), seed=seed))
    scale = scale_parameters(rows.filter(~F.col("is_test")), FEATURES)
    scaled = assemble(standardize(rows, FEATURES, scale), [f"{c}_z" for c in FEATURES], "scaled")
    ready = materialize(assemble(scaled, FEATURES, "features"))
    training = materialize(with_class_weights(spread(ready.filter(~F.col("is_test")), "customer_id")))
    return ChurnModel(ready, fit_logistic(training), fit_forest(training, trees, depth, seed))
