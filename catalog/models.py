"""Registered model jobs. Fits have no SQL form; the steps around them do."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillmart.functions import round_half_away
from tillmart.models import anomaly, churn, ltv, segments, shapley
from tillmart.operators.shared_storage import materialize
from tillmart.plans import facts

from .oracles import div, even, rnd, with_ctes

_MEDIANS = ", ".join(f"median({c}::DOUBLE) AS m_{c}" for c in churn.FEATURES)
_IMPUTED = ", ".join(f"coalesce({c}::DOUBLE, m_{c}) AS {c}" for c in churn.FEATURES)

# One score per customer that SQL can also compute.
_SCORE_SQL = "1.0::DOUBLE / (1 + count_lifetime_orders)"
_THRESHOLD = 0.1


def register(query, features, marts) -> None:
    def scored(spark, d) -> DataFrame:
        return features(spark, d).select(
            "customer_id", "customer_name", "is_churned",
            (1.0 / (1 + F.col("count_lifetime_orders"))).alias("churn_probability"))

    def summary(spark, d) -> DataFrame:
        return ltv.purchase_summary(marts(spark, d)["orders"])

    def series(spark, d, key: str | None = None, fill: bool = False) -> DataFrame:
        m = marts(spark, d)
        return anomaly.daily_series(facts.daily_revenue(m["orders"], m["locations"]), key, fill=fill)

    @query("churn_imputed", with_ctes(f"""SELECT customer_id, customer_name, is_churned, {_IMPUTED}
        FROM fct_customer_churn_features, (SELECT {_MEDIANS} FROM fct_customer_churn_features)"""))
    def _(spark, d):
        return churn.impute_medians(features(spark, d))

    @query("churn_split", with_ctes("""
      WITH n AS (SELECT is_churned, customer_id, count(*) OVER () AS total, count(*) OVER (PARTITION BY is_churned)
                          AS size, row_number() OVER (PARTITION BY is_churned ORDER BY md5('42-' || customer_id),
                          customer_id) AS r FROM fct_customer_churn_features),
      q AS (SELECT DISTINCT is_churned, ceil(total * 0.25)::BIGINT AS test, total, size FROM n),
      f AS (SELECT *, test * size // total AS base,
                   row_number() OVER (ORDER BY test * size % total DESC, is_churned DESC) AS turn FROM q),
      g AS (SELECT is_churned, base + CASE WHEN turn <= test - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS quota
            FROM f)
      SELECT customer_id, is_churned, r <= quota AS is_test FROM n JOIN g USING (is_churned)"""))
    def _(spark, d):
        return churn.stratified_split(features(spark, d).select("customer_id", "is_churned"))

    @query("churn_split_sizes", with_ctes("""SELECT count(*) - ceil(count(*) * 0.25)::BIGINT AS n_train,
        ceil(count(*) * 0.25)::BIGINT AS n_test, avg(is_churned::INT) AS churn_rate
        FROM fct_customer_churn_features"""))
    def _(spark, d):
        return churn.split_sizes(churn.stratified_split(features(spark, d).select("customer_id", "is_churned")))

    @query("churn_score_metrics", with_ctes(f"""
      WITH s AS (SELECT is_churned AS y, {_SCORE_SQL} AS p FROM fct_customer_churn_features),
      c AS (SELECT count(*) FILTER (y AND p > {_THRESHOLD}) AS tp, count(*) FILTER (NOT y AND p > {_THRESHOLD}) AS fp,
                   count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM s),
      u AS (SELECT sum(CASE WHEN a.p > b.p THEN 2 WHEN a.p = b.p THEN 1 ELSE 0 END) AS twice
            FROM s a, s b WHERE a.y AND NOT b.y)
      SELECT coalesce({div('tp', 'tp + fp')}, 0) AS precision, coalesce({div('tp', 'pos')}, 0) AS recall,
             coalesce({div('2 * tp', 'tp + fp + pos')}, 0) AS f1, {div('twice', '2 * pos * neg')} AS roc_auc
      FROM c, u"""))
    def _(spark, d):
        return churn.score_metrics(scored(spark, d), threshold=_THRESHOLD)

    @query("churn_at_risk", with_ctes(f"""SELECT * FROM (SELECT customer_id, customer_name, is_churned,
        {_SCORE_SQL} AS churn_probability FROM fct_customer_churn_features) WHERE churn_probability >= {_THRESHOLD}"""))
    def _(spark, d):
        return churn.at_risk(scored(spark, d), _THRESHOLD)

    given_trees = [  # of two trees
        (0, 0, 0, "count_lifetime_orders", 9.5, 1, 2, 100.0, 52.0), (0, 1, 1, "avg_order_value", 250_000.0, 3, 4, 55.0, 40.0),
        (0, 2, 1, None, None, -1, -1, 45.0, 12.0), (0, 3, 2, None, None, -1, -1, 30.0, 18.0),
        (0, 4, 2, None, None, -1, -1, 25.0, 22.0),
        (1, 0, 0, "lifetime_spend", 2_400_000.0, 1, 2, 100.0, 49.0), (1, 1, 1, "count_lifetime_orders", 6.5, 3, 4, 60.0, 41.0),
        (1, 2, 1, None, None, -1, -1, 40.0, 8.0), (1, 3, 2, None, None, -1, -1, 24.0, 20.0),
        (1, 4, 2, None, None, -1, -1, 36.0, 21.0)]
    node = {(t[0], t[1]): t for t in given_trees}
    split_on = ["count_lifetime_orders", "lifetime_spend", "avg_order_value"]
    imputed_sql = f"""WITH x AS (SELECT customer_id, is_churned, {_IMPUTED} FROM fct_customer_churn_features,
        (SELECT {_MEDIANS} FROM fct_customer_churn_features))"""

    def expected(tree: int, at: int, known) -> str:
        """SQL of a tree's value when only some features are known: the others follow both branches by weight."""
        _, _, _, feature, threshold, left, right, weight, yes = node[tree, at]
        if feature is None:
            return f"{yes / weight!r}::DOUBLE"
        low, high = expected(tree, left, known), expected(tree, right, known)
        if feature in known:
            return f"CASE WHEN {feature} <= {threshold} THEN {low} ELSE {high} END"
        return f"({node[tree, left][7]} * {low} + {node[tree, right][7]} * {high}) / {weight}::DOUBLE"

    def game(known) -> str:
        return f"(({expected(0, 0, known)}) + ({expected(1, 0, known)})) / 2"

    def shapley_value(feature: str) -> str:
        others = [f for f in split_on if f != feature]
        terms = [f"{('1.0/3', '1.0/6', '1.0/3')[len(s)]} * ({game([*s, feature])} - {game(s)})"
                 for n in range(3) for s in itertools.combinations(others, n)]
        return " + ".join(terms)

    def trees(spark) -> DataFrame:
        return spark.createDataFrame(given_trees, shapley.TREES)

    @query("churn_given_trees", with_ctes(f"""{imputed_sql} SELECT customer_id, {rnd(game(split_on), 9)}
        AS churn_probability FROM x"""))
    def _(spark, d):
        return churn.forest_scores(churn.impute_medians(features(spark, d)), trees(spark)).select(
            "customer_id", round_half_away("churn_probability", 9).alias("churn_probability"))

    @query("churn_given_attributions", with_ctes(f"""{imputed_sql} SELECT customer_id, {rnd(game([]), 9)} AS base_value,
        {", ".join((rnd(shapley_value(f), 9) + " + 0.0::DOUBLE" if f in split_on else "0.0::DOUBLE") + f" AS {f}"
                   for f in churn.FEATURES)} FROM x"""))
    def _(spark, d):
        found = churn.given_attributions(churn.impute_medians(features(spark, d)), trees(spark))
        return found.select("customer_id", *[(round_half_away(c, 9) + 0.0).alias(c) for c in ["base_value", *churn.FEATURES]])

    @query("churn_model_metrics")
    def _(spark, d):
        return churn.train(features(spark, d)).metrics()

    @query("churn_feature_importance")
    def _(spark, d):
        return churn.train(features(spark, d)).feature_importance()

    @query("churn_top_risk")
    def _(spark, d):
        return churn.at_risk(churn.train(features(spark, d)).scores(), 0.0).limit(10)

    @query("kmeans_features", with_ctes(f"""
      WITH x AS (SELECT customer_id, days_since_last_order::DOUBLE AS recency,
                        count_lifetime_orders::DOUBLE AS frequency, lifetime_spend::DOUBLE AS monetary,
                        coalesce(food_item_pct, 0) AS food_item_pct
                 FROM fct_customer_churn_features WHERE lifetime_spend > 0)
      SELECT customer_id, {", ".join(
          rnd(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", 6) + f" AS {c}_z" for c in segments.DIMS)}
      FROM x"""))
    def _(spark, d):
        return segments.segment_features(features(spark, d)).select(
            "customer_id", *[round_half_away(f"{c}_z", 6).alias(f"{c}_z") for c in segments.DIMS])

    @query("kmeans_segments")
    def _(spark, d):
        return segments.kmeans_segments(features(spark, d))

    @query("kmeans_elbow")
    def _(spark, d):
        return segments.elbow(features(spark, d))

    centres = [[-0.8, 1.2, 1.1, 0.0], [1.5, -1.0, -1.1, 0.2], [0.0, 0.1, 0.0, 1.0], [0.2, -0.2, 0.1, -1.0]]
    assigned_sql = f"""
      WITH x AS (SELECT customer_id, days_since_last_order::DOUBLE AS recency, count_lifetime_orders::DOUBLE AS frequency,
                        lifetime_spend::DOUBLE AS monetary, food_item_pct, coalesce(food_item_pct, 0) AS food
                 FROM fct_customer_churn_features WHERE lifetime_spend > 0),
      z AS (SELECT *, {", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{i}" for i, c in enumerate(
          ["recency", "frequency", "monetary", "food"]))} FROM x),
      far AS (SELECT *, [{", ".join(" + ".join(f"(z{i} - ({v})) ** 2" for i, v in enumerate(c)) for c in centres)}] AS d
              FROM z),
      assigned AS (SELECT customer_id, recency, frequency, monetary, food_item_pct,
                          'Cluster ' || (list_position(d, list_min(d)) - 1) AS cluster FROM far)"""

    def assigned(spark, d) -> DataFrame:
        return segments.assign_clusters(features(spark, d), centres)

    query("cluster_assignment", with_ctes(assigned_sql + " SELECT * FROM assigned"))(assigned)

    @query("cluster_step", with_ctes(assigned_sql + f""" SELECT (list_position(d, list_min(d)) - 1)::INT AS cluster,
        count(*) AS customers, {rnd('sum(list_min(d))', 6)} AS cost, {", ".join(
            rnd(f"avg(z{i})", 6) + f" AS {c}" for i, c in enumerate(segments.DIMS))} FROM far GROUP BY 1"""))
    def _(spark, d):
        moved = segments.cluster_step(features(spark, d), centres).filter("customers > 0")
        return moved.select("cluster", "customers", *[round_half_away(c, 6).alias(c) for c in ["cost", *segments.DIMS]])

    norm, inner = " + ".join(f"z{i} * z{i}" for i in range(4)), " + ".join(f"z{i} * m{i}" for i in range(4))

    @query("cluster_silhouette", with_ctes(assigned_sql + f""",
      p AS (SELECT *, list_position(d, list_min(d)) AS c, {norm} AS q, row_number() OVER () AS i FROM far),
      s AS (SELECT c AS oc, count(*) AS n, avg(q) AS mq, {", ".join(f"avg(z{i}) AS m{i}" for i in range(4))} FROM p GROUP BY c),
      e AS (SELECT i, c, oc, n, (q + mq - 2 * ({inner})) * CASE WHEN c = oc THEN n / nullif(n - 1.0, 0) ELSE 1 END AS far
            FROM p, s),
      v AS (SELECT i, max(far) FILTER (c = oc) AS a, min(far) FILTER (c <> oc) AS b FROM e GROUP BY i)
      SELECT {rnd('avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)', 6)} AS silhouette_squared
      FROM v"""))
    def _(spark, d):
        return segments.given_silhouette(features(spark, d), centres).select(
            round_half_away("silhouette_squared", 6).alias("silhouette_squared"))

    profiles_sql = assigned_sql + f""", profiles AS (SELECT cluster, count(*) AS customers,
        {even('avg(recency)', 1)} AS avg_recency, {even('avg(frequency)', 1)} AS avg_frequency,
        {even('avg(monetary)', 1)} AS avg_spend, {even('avg(food_item_pct)', 1)} AS avg_food_pct FROM assigned GROUP BY 1)"""

    @query("cluster_assigned_profiles", with_ctes(profiles_sql + " SELECT * FROM profiles"))
    def _(spark, d):
        return segments.cluster_profiles(assigned(spark, d))

    @query("cluster_assigned_radar", with_ctes(profiles_sql + " SELECT cluster, " + ", ".join(
        ("1 - " if c == "avg_recency" else "") + div(f"{c} - min({c}) OVER ()", f"max({c}) OVER () - min({c}) OVER ()")
        + f" AS {c}" for c in ("avg_recency", "avg_frequency", "avg_spend", "avg_food_pct")) + " FROM profiles"))
    def _(spark, d):
        return segments.cluster_radar(segments.cluster_profiles(assigned(spark, d)))

    weights = {"days_since_last_order": 0.004, "count_lifetime_orders": -0.3, "avg_order_value": 0.0001}

    @query("churn_logistic_scores", with_ctes("""SELECT customer_id, round(1 / (1 + exp(-(-0.5 + 0.004
        * days_since_last_order - 0.3 * count_lifetime_orders + 0.0001 * avg_order_value))), 9) AS churn_probability
        FROM fct_customer_churn_features"""))
    def _(spark, d):
        return churn.logistic_scores(features(spark, d), -0.5, weights).select(
            "customer_id", F.round("churn_probability", 9).alias("churn_probability"))

    @query("cluster_profiles")
    def _(spark, d):
        return segments.cluster_profiles(segments.kmeans_segments(features(spark, d)))

    @query("cluster_radar")
    def _(spark, d):
        return segments.cluster_radar(segments.cluster_profiles(segments.kmeans_segments(features(spark, d))))

    summary_sql = f"""
      SELECT customer_id, count(*) - 1 AS frequency, datediff('day', min(t), max(t)) AS recency,
             datediff('day', min(t), (SELECT max(ordered_at) FROM stg_orders)) AS T,
             coalesce({div('sum(v) FILTER (i > 1)', 'count(*) FILTER (i > 1)')}, 0) AS monetary_value
      FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY t) AS i FROM (
              SELECT customer_id, ordered_at AS t, sum(order_total) AS v FROM stg_orders
              WHERE customer_id IS NOT NULL GROUP BY 1, 2))
      GROUP BY 1"""

    query("ltv_summary", with_ctes(summary_sql))(summary)

    @query("ltv_correlation", with_ctes(f"""
      SELECT count(*) AS customers, count(*) FILTER (frequency > 0) AS repeat_customers,
             count(*) FILTER (frequency = 0) AS one_time_customers,
             {rnd('corr(frequency, monetary_value) FILTER (frequency > 0)', 6)} AS freq_monetary_corr
      FROM ({summary_sql})"""))
    def _(spark, d):
        return ltv.repeat_correlation(summary(spark, d)).withColumn(
            "freq_monetary_corr", round_half_away("freq_monetary_corr", 6))

    def forecasts(spark, d) -> DataFrame:
        rows = materialize(summary(spark, d))
        return ltv.forecast(rows, ltv.fit(rows))

    query("ltv_forecast")(forecasts)

    given = ltv.LtvModel(r=0.9, alpha=180.0, a=0.7, b=2.5, p=6.0, q=4.0, v=1500.0)
    given_sql = f"""
      WITH s AS ({summary_sql}),
      g AS (SELECT *, frequency::DOUBLE AS x, [30, 60, 90] AS steps FROM s WHERE frequency > 0),
      h AS (SELECT *, list_transform(steps, lambda u: list_sum(list_transform(range(0, 600), lambda n: exp(
                lgamma(0.9 + x + n) - lgamma(0.9 + x) + lgamma(2.5 + x + n) - lgamma(2.5 + x) - lgamma(2.2 + x + n)
                + lgamma(2.2 + x) - lgamma(n + 1) + n * ln(u / (180.0 + T + u)))))) AS hyper FROM g),
      e AS (SELECT *, list_transform([1, 2, 3], lambda i: (2.2 + x) / (-0.3)
                * (1 - hyper[i] * ((180.0 + T) / (180.0 + T + steps[i])) ** (0.9 + x))
                / (1 + 0.7 / (1.5 + x) * ((180.0 + T) / (180.0 + recency)) ** (0.9 + x))) AS grown,
                (3.0 / (6.0 * x + 3.0)) * (1500.0 * 6.0 / 3.0) + 6.0 * x / (6.0 * x + 3.0) * monetary_value AS worth FROM h),
      f AS (SELECT customer_id, frequency, recency, T, monetary_value, worth AS predicted_avg_order_value,
                   worth * (grown[1] / 1.01 + (grown[2] - grown[1]) / 1.01 ** 2 + (grown[3] - grown[2]) / 1.01 ** 3)
                     AS clv_forecast, grown[3] AS expected_purchases FROM e)"""

    def given_forecast(spark, d) -> DataFrame:
        return ltv.forecast(summary(spark, d), given)

    def rounded(df: DataFrame, columns) -> DataFrame:
        return df.select(*[round_half_away(c, 1 if c == "clv_forecast" else 4).alias(c) if c in columns else F.col(c)
                           for c in df.columns])

    @query("ltv_given_forecast", with_ctes(given_sql + f""" SELECT customer_id, frequency, recency, T, monetary_value,
        {", ".join(rnd(c, 1 if c == "clv_forecast" else 4) + f" AS {c}" for c in ltv.REPORT_COLUMNS)} FROM f"""))
    def _(spark, d):
        return rounded(given_forecast(spark, d), ltv.REPORT_COLUMNS)

    @query("ltv_given_report", with_ctes(given_sql + f""" SELECT count(*) AS repeat_customers,
        {rnd('sum(clv_forecast)', 2)} AS total_clv, {rnd('median(clv_forecast)', 4)} AS median_clv FROM f"""))
    def _(spark, d):
        return ltv.report(given_forecast(spark, d)).select(
            "repeat_customers", round_half_away("total_clv", 2).alias("total_clv"),
            round_half_away("median_clv", 4).alias("median_clv"))

    numbers = ["mean", "std", "min", "max", "p25", "p50", "p75"]

    @query("ltv_given_describe", with_ctes(given_sql + " UNION ALL ".join(
        f" SELECT '{c}' AS \"column\", count({c}) AS count, " + ", ".join(rnd(f.format(c), 3) + f" AS {n}" for n, f in zip(
            numbers, ["avg({})", "stddev_samp({})", "min({})", "max({})", "quantile_cont({}, 0.25)",
                      "quantile_cont({}, 0.5)", "quantile_cont({}, 0.75)"])) + " FROM f" for c in ltv.REPORT_COLUMNS)))
    def _(spark, d):
        return ltv.describe(given_forecast(spark, d)).select(
            "column", "count", *[round_half_away(n, 3).alias(n) for n in numbers])

    @query("ltv_given_top_customers", with_ctes(given_sql + f""" SELECT customer_id, {rnd('clv_forecast', 1)} AS clv_forecast
        FROM f ORDER BY clv_forecast DESC, customer_id LIMIT 10"""))
    def _(spark, d):
        return rounded(ltv.top_customers(given_forecast(spark, d)).select("customer_id", "clv_forecast"), ["clv_forecast"])

    points = [[0.9, 180.0, 0.7, 2.5], [1.5, 90.0, 1.2, 3.0]]

    def loglik_sql(r: float, al: float, a: float, b: float) -> str:
        return (f"sum(lgamma({r} + frequency) - lgamma({r}) + {r} * ln({al}) + lgamma({a} + {b}) + lgamma({b} + frequency)"
                f" - lgamma({b}) - lgamma({a} + {b} + frequency) + ln(({al} + T) ** (-({r} + frequency)) + CASE WHEN"
                f" frequency > 0 THEN {a} / ({b} + frequency - 1) * ({al} + recency) ** (-({r} + frequency)) ELSE 0 END))")

    @query("ltv_likelihood", with_ctes(f"WITH s AS ({summary_sql}) " + " UNION ALL ".join(
        f"SELECT {i} AS point, {rnd(loglik_sql(*p), 4)} AS loglik FROM s" for i, p in enumerate(points))))
    def _(spark, d):
        rows = summary(spark, d).withColumn("weight", F.lit(1))
        return ltv.loglik_sums(rows, ltv.bg_nbd_loglik, np.array(points)).select(
            "point", round_half_away("loglik", 4).alias("loglik"))

    value_points = [[6.0, 4.0, 1500.0], [2.5, 3.5, 90_000.0]]

    def value_loglik_sql(p: float, q: float, v: float) -> str:
        return (f"sum(lgamma({p} * x + {q}) - lgamma({p} * x) - lgamma({q}) + {q} * ln({v}) + ({p} * x - 1) * ln(m)"
                f" + {p} * x * ln(x) - ({p} * x + {q}) * ln(x * m + {v}))")

    @query("ltv_value_likelihood", with_ctes(f"""WITH s AS (SELECT frequency::DOUBLE AS x, monetary_value::DOUBLE AS m
        FROM ({summary_sql}) WHERE frequency > 0 AND monetary_value > 0) """ + " UNION ALL ".join(
        f"SELECT {i} AS point, {rnd(value_loglik_sql(*p), 4)} AS loglik FROM s" for i, p in enumerate(value_points))))
    def _(spark, d):
        rows = summary(spark, d).filter("frequency > 0 and monetary_value > 0").withColumn("weight", F.lit(1))
        return ltv.loglik_sums(rows, ltv.gamma_gamma_loglik, np.array(value_points)).select(
            "point", round_half_away("loglik", 4).alias("loglik"))

    @query("ltv_report")
    def _(spark, d):
        return ltv.report(forecasts(spark, d))

    @query("ltv_describe")
    def _(spark, d):
        return ltv.describe(forecasts(spark, d))

    @query("ltv_top_customers")
    def _(spark, d):
        return ltv.top_customers(forecasts(spark, d))

    @query("daily_series", with_ctes("""SELECT location_id::VARCHAR AS series, ordered_at AS date_day,
        sum(order_total)::DOUBLE AS revenue FROM stg_orders GROUP BY 1, 2"""))
    def _(spark, d):
        return series(spark, d, "location_id").withColumn("date_day", F.col("date_day").cast("timestamp_ntz"))

    @query("daily_series_filled", with_ctes("""
      WITH r AS (SELECT location_id, ordered_at AS t, sum(order_total) AS v FROM stg_orders GROUP BY 1, 2),
      s AS (SELECT location_id, unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) AS t FROM r GROUP BY 1)
      SELECT location_id::VARCHAR AS series, s.t AS date_day, coalesce(v, 0)::DOUBLE AS revenue
      FROM s LEFT JOIN r USING (location_id, t)"""))
    def _(spark, d):
        return series(spark, d, "location_id", fill=True).withColumn(
            "date_day", F.col("date_day").cast("timestamp_ntz"))

    @query("revenue_anomalies")
    def _(spark, d):
        return anomaly.revenue_anomalies(series(spark, d))

    @query("revenue_anomalies_by_location")
    def _(spark, d):
        return anomaly.revenue_anomalies(series(spark, d, "location_id"))

    # Scores of residuals against a given trend (the mean) and season (the weekday's mean beside it).
    parts_sql = """
      WITH r AS (SELECT location_id::VARCHAR AS series, ordered_at AS date_day, sum(order_total)::DOUBLE AS revenue
                 FROM stg_orders GROUP BY 1, 2),
      p AS (SELECT *, avg(revenue) OVER (PARTITION BY series) AS trend,
                   avg(revenue) OVER (PARTITION BY series, dayofweek(date_day)) - avg(revenue) OVER (PARTITION BY series)
                     AS seasonal FROM r),
      q AS (SELECT *, revenue - trend - seasonal AS resid FROM p),
      scored AS (SELECT *, (resid - avg(resid) OVER w) / nullif(stddev_samp(resid) OVER w, 0) AS z_score FROM q
                 WINDOW w AS (PARTITION BY series))"""

    def given_scores(spark, d) -> DataFrame:
        by, day = W.partitionBy("series"), W.partitionBy("series", F.dayofweek("date_day"))
        parts = series(spark, d, "location_id").withColumn("trend", F.avg("revenue").over(by)).withColumn(
            "seasonal", F.avg("revenue").over(day) - F.col("trend"))
        return anomaly.residual_scores(parts, 2.0)

    @query("anomaly_given_scores", with_ctes(parts_sql + f""" SELECT series, date_day,
        {rnd('z_score', 6)} AS z_score, coalesce(abs(z_score) > 2.0, false) AS is_anomaly FROM scored"""))
    def _(spark, d):
        return given_scores(spark, d).select("series", F.col("date_day").cast("timestamp_ntz").alias("date_day"),
                                             round_half_away("z_score", 6).alias("z_score"), "is_anomaly")

    @query("anomaly_given_top_days", with_ctes(parts_sql + f""" SELECT series, date_day, {rnd('z_score', 6)} AS z_score
        FROM scored WHERE abs(z_score) > 2.0 ORDER BY abs(z_score) DESC, series, date_day LIMIT 15"""))
    def _(spark, d):
        return anomaly.top_anomalies(given_scores(spark, d)).select(
            "series", F.col("date_day").cast("timestamp_ntz").alias("date_day"), round_half_away("z_score", 6).alias("z_score"))

    @query("anomaly_given_summary", with_ctes(parts_sql + f""" SELECT series, min(date_day) AS first_day,
        max(date_day) AS last_day, count(*) AS days, count(*) FILTER (abs(z_score) > 2.0) AS anomalies,
        count(*) FILTER (z_score > 2.0) AS spikes, count(*) FILTER (z_score < -2.0) AS drops,
        {div('count(*) FILTER (abs(z_score) > 2.0)', 'count(*)')} AS anomaly_share FROM scored GROUP BY 1"""))
    def _(spark, d):
        return anomaly.anomaly_summary(given_scores(spark, d))

    @query("anomaly_top_days")
    def _(spark, d):
        return anomaly.top_anomalies(anomaly.revenue_anomalies(series(spark, d)))

    @query("anomaly_summary")
    def _(spark, d):
        return anomaly.anomaly_summary(anomaly.revenue_anomalies(series(spark, d, "location_id")))
