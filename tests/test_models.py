"""Model jobs against brute force on small inputs."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from catalog.queries import _features, _marts
from tillmart.models import anomaly, churn, decompose, lloyd, ltv, scaling, segments, shapley, special


@pytest.fixture(scope="module")
def features(spark):
    return _features(spark, SF, 365).persist()


@pytest.fixture(scope="module")
def model(features):
    return churn.train(features, trees=8, depth=4)


def test_split_sizes_and_repeatability(features):
    split = churn.stratified_split(features.select("customer_id", "is_churned"))
    again = churn.stratified_split(features.repartition(13).select("customer_id", "is_churned"))
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, again.collect()))
    sizes = {(r.is_churned, r.is_test): r["count"] for r in split.groupBy("is_churned", "is_test").count().collect()}
    n = sum(sizes.values())
    assert sizes[True, True] + sizes[False, True] == math.ceil(n * 0.25)
    for label in (True, False):
        share = sizes[label, True] / (sizes[label, True] + sizes[label, False])
        assert abs(share - 0.25) < 0.02


def test_logistic_regression_is_the_penalized_optimum(model):
    rows = churn.with_class_weights(model.rows.filter("not is_test")).select(
        "label", "weight", *[f"{c}_z" for c in churn.FEATURES]).toPandas()
    x = np.c_[np.ones(len(rows)), rows[[f"{c}_z" for c in churn.FEATURES]]]
    y, w, ridge = rows["label"].to_numpy(), rows["weight"].to_numpy(), np.diag([0.0] + [1.0] * len(churn.FEATURES))
    beta = np.zeros(x.shape[1])
    for _ in range(50):  # Newton on the weighted log-loss plus half the squared norm
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge, x.T @ (w * (p - y)) + ridge @ beta)
    got = np.r_[model.logistic.intercept, model.logistic.coefficients.toArray()]
    assert np.allclose(got, beta, atol=2e-3)


def test_metrics_against_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(bool(a), float(b)) for a, b in zip(rng.random(300) < 0.3, np.round(rng.random(300), 1))]
    got = churn.score_metrics(spark.createDataFrame(rows, "y boolean, p double"), "y", "p").first()
    tp = sum(y and p > 0.5 for y, p in rows)
    fp = sum((not y) and p > 0.5 for y, p in rows)
    yes, no = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no))
    assert np.allclose(list(got), [tp / (tp + fp), tp / len(yes), 2 * tp / (tp + fp + len(yes)), auc])
    empty = churn.score_metrics(spark.createDataFrame([(True, 0.1), (False, 0.2)], "y boolean, p double"), "y", "p")
    assert list(empty.first()) == [0.0, 0.0, 0.0, 0.0]


def test_attributions_add_up_to_the_forest_probability(model):
    scores = {r.customer_id: r.churn_probability for r in model.scores().collect()}
    rows = model.attributions().collect()
    assert len(rows) == model.rows.filter("is_test").count()
    for r in rows:
        assert math.isclose(r.base_value + sum(r[f] for f in churn.FEATURES), scores[r.customer_id], abs_tol=1e-9)
    assert model.feature_importance().count() == len(churn.FEATURES)
    assert model.metrics().count() == 2 and model.sizes().first().n_test == len(rows)


def test_shapley_against_all_subsets():
    def node(i, stats, left=-1, right=-1, feature=-1, threshold=None):
        return (0, i, np.array(stats, float), left, right,
                {"featureIndex": feature, "leftCategoriesOrThreshold": [threshold] if threshold is not None else []})

    tree = pd.DataFrame([
        node(0, [6, 4], 1, 4, 0, 0.5), node(1, [5, 1], 2, 3, 1, 0.3), node(2, [4, 0]), node(3, [1, 1]),
        node(4, [1, 3], 5, 6, 0, 0.8), node(5, [1, 1]), node(6, [0, 2])],
        columns=["treeID", "id", "impurityStats", "leftChild", "rightChild", "split"])
    nodes = {r.id: r for r in tree.itertuples()}

    def value(i, x, known):
        r = nodes[i]
        if r.leftChild < 0:
            return r.impurityStats[1] / r.impurityStats.sum()
        f, t = r.split["featureIndex"], r.split["leftCategoriesOrThreshold"][0]
        if f in known:
            return value(r.leftChild if x[f] <= t else r.rightChild, x, known)
        return sum(nodes[c].impurityStats.sum() / r.impurityStats.sum() * value(c, x, known)
                   for c in (r.leftChild, r.rightChild))

    rows = np.array([[0.1, 0.2, 9], [0.4, 0.9, 9], [0.6, 0.1, 9], [0.9, 0.5, 9]])
    base, phi = shapley.attributions(shapley.leaves_of_trees(tree, 3), rows)
    for x, got in zip(rows, phi):
        for j in range(3):
            others = [k for k in range(3) if k != j]
            want = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value(0, x, {*s, j}) - value(0, x, set(s)))
                       for n in range(3) for s in itertools.combinations(others, n))
            assert math.isclose(got[j], want, abs_tol=1e-12)
    assert math.isclose(base, value(0, rows[0], set()))


def test_forest_rows_score_like_the_forest(spark, model):
    trees = churn.forest_rows(model.forest)
    assert trees.select("tree").distinct().count() == model.forest.getNumTrees
    wanted = {r.customer_id: r.churn_probability for r in model.scores().collect()}
    got = {r.customer_id: r.churn_probability for r in churn.forest_scores(model.rows, trees).collect()}
    assert set(got) == set(wanted) and all(math.isclose(got[c], p, abs_tol=1e-9) for c, p in wanted.items())
    own = {r.customer_id: tuple(r) for r in model.attributions().collect()}
    given = {r.customer_id: tuple(r) for r in churn.given_attributions(model.rows.filter("is_test"), trees).collect()}
    assert set(given) == set(own) and all(np.allclose(given[c][1:], own[c][1:], atol=1e-9) for c in own)


def test_forest_scores_of_odd_rows_and_trees(spark):
    rows = spark.createDataFrame([(1, 0.5, None), (2, 3.0, 1.0), (3, None, 9.0), (4, 1.0, 2.0)], "customer_id long, a double, b double")
    trees = spark.createDataFrame([(0, 0, 0, "a", 1.0, 1, 2, 10.0, 6.0), (0, 1, 1, None, None, -1, -1, 4.0, 1.0),
                                   (0, 2, 1, "b", 1.0, 3, 4, 6.0, 5.0), (0, 3, 2, None, None, -1, -1, 2.0, 2.0),
                                   (0, 4, 2, None, None, -1, -1, 4.0, 3.0), (1, 0, 0, None, None, -1, -1, 8.0, 4.0)], shapley.TREES)
    got = {r.customer_id: r.churn_probability for r in churn.forest_scores(rows, trees, ["a", "b"]).collect()}
    assert got == {1: 0.375, 2: 0.75, 3: 0.625, 4: 0.375}  # a null goes right
    assert churn.forest_scores(rows.limit(0), trees, ["a", "b"]).count() == 0
    assert [r.churn_probability for r in churn.forest_scores(rows, trees.limit(0), ["a", "b"]).collect()] == [None] * 4


def test_kmeans(features):
    labelled = segments.kmeans_segments(features, k=3, restarts=1).collect()
    sizes = [sum(r.cluster == f"Cluster {i}" for r in labelled) for i in range(3)]
    assert sizes == sorted(sizes, reverse=True) and sum(sizes) == len(labelled)
    out = segments.elbow(features, [2, 3]).collect()
    assert [r.k for r in out] == [2, 3] and out[0].inertia > out[1].inertia > 0
    profiles = segments.cluster_profiles(segments.kmeans_segments(features, k=3, restarts=1))
    radar = segments.cluster_radar(profiles).collect()
    best = min(profiles.collect(), key=lambda r: r.avg_recency).cluster
    assert [r.avg_recency for r in radar if r.cluster == best] == [1.0]


def test_kmeans_passes_equal_plain_versions(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.6, (80, 2)) for c in ((0, 0), (4, 0), (0, 5))] + [np.zeros((40, 2))])
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, a double, b double")
    models = [[[0.0, 0.0], [3.0, 1.0]], [[1.0, 1.0], [1.0, 1.0], [9.0, 9.0]]]
    got = {(r.model, r.cluster): r for r in lloyd.step(rows.repartition(5), ["a", "b"], models).collect()}
    for m, centres in enumerate(models):
        far = ((x[:, None] - np.array(centres)[None]) ** 2).sum(-1)
        for c in range(len(centres)):
            mine = x[far.argmin(1) == c]
            r = got[m, c]
            assert r.n == len(mine) and np.allclose([r.s0, r.s1], mine.sum(0)) and np.isclose(r.squares, (mine ** 2).sum())
            assert np.isclose(r.cost, far.min(1)[far.argmin(1) == c].sum())
    chains = [lloyd.starts(rows.repartition(n), ["a", "b"], "id", 4, [1, 2]) for n in (1, 6)]
    assert all(np.array_equal(p, q) for p, q in zip(*chains)) and not np.array_equal(*chains[0])
    fits = lloyd.best_fits(rows, ["a", "b"], "id", [2, 3], 5, 42)
    vectors = scaling.assemble(rows, ["a", "b"])
    for k, fit in zip((2, 3), fits):
        apart = min(KMeans(k=k, seed=i, maxIter=300).fit(vectors).summary.trainingCost for i in range(5))
        assert fit.cost <= apart * 1.001 and fit.sizes.sum() == len(x)
    few = spark.createDataFrame([(i, 1.0, 1.0) for i in range(9)] + [(9, 2.0, 2.0)], "id long, a double, b double")
    assert lloyd.best_fits(few, ["a", "b"], "id", [4], 2, 1)[0].cost == 0
    with pytest.raises(ValueError):
        lloyd.starts(few.limit(0), ["a", "b"], "id", 2, [1])


def test_silhouettes_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (60, 2))
    rows = spark.createDataFrame([tuple(map(float, p)) for p in x], "a double, b double").repartition(4)
    models = [[[-1.0, 0.0], [1.0, 0.0], [50.0, 50.0]], [[0.0, 0.0]], [[0.0, 0.0], list(map(float, x[0] * 1.0001))]]
    got = {r.model: r.silhouette_squared for r in lloyd.silhouettes(rows, ["a", "b"], models).collect()}
    pairs = ((x[:, None] - x[None]) ** 2).sum(-1)
    for m, centres in enumerate(models):
        own = ((x[:, None] - np.array(centres)[None]) ** 2).sum(-1).argmin(1)
        values = []
        for i in range(len(x)):
            means = {c: pairs[i][(own == c) & (np.arange(len(x)) != i)] for c in set(own)}
            others = [v.mean() for c, v in means.items() if c != own[i]]
            inside = means[own[i]]
            values.append((min(others) - inside.mean()) / max(min(others), inside.mean()) if others and len(inside) else 0.0)
        assert math.isclose(got[m], np.mean(values), abs_tol=1e-9)


def test_special_functions():
    x = np.array([1e-3, 0.5, 1.0, 2.5, 10.0, 171.3, 1e5])
    assert np.allclose(special.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)

    def series(a, b, c, z):
        term = total = 1.0
        for n in range(5000):
            term *= (a + n) * (b + n) / ((c + n) * (n + 1)) * z
            total += term
        return total

    for a, b, c, z in [(1.2, 3.4, 5.0, 0.3), (8.0, 7.5, 8.2, 0.6), (0.3, 1.1, 2.7, 0.9)]:
        assert math.isclose(float(special.hyp2f1(a, b, c, z)), series(a, b, c, z), rel_tol=1e-9)


def test_purchase_summary_rules(spark):
    rows = [(1, "2024-01-01", 10.0), (1, "2024-01-01", 5.0), (1, "2024-01-11", 20.0), (1, "2024-01-31", 40.0),
            (2, "2024-01-21", 7.0), (None, "2024-01-02", 9.0), (None, "2024-01-31", 9.0)]
    orders = spark.createDataFrame(rows, "customer_id int, d string, order_total double").select(
        "customer_id", F.col("d").cast("timestamp_ntz").alias("ordered_at"),
        F.col("order_total").cast("decimal(16,2)"))
    got = {r.customer_id: tuple(r)[1:] for r in ltv.purchase_summary(orders).collect()}
    assert got == {1: (2, 30, 30, 30.0), 2: (0, 0, 10, 0.0)}


def test_slopes_equal_differences():
    x = np.array([1e-2, 0.5, 1.0, 2.5, 10.0, 171.3, 1e4])
    h = 1e-5 * x
    assert np.allclose(special.digamma(x), (special.lgamma(x + h) - special.lgamma(x - h)) / (2 * h), rtol=1e-6, atol=1e-6)
    assert np.allclose(special.trigamma(x), (special.digamma(x + h) - special.digamma(x - h)) / (2 * h), rtol=1e-6, atol=1e-9)
    rows = pd.DataFrame({"frequency": [0, 1, 3, 40], "recency": [0.0, 2.0, 7.5, 9.0], "T": [4.0, 9.0, 7.5, 10.0],
                         "monetary_value": [0.0, 12.5, 3.0, 90.0]})
    for loglik, slopes, params, part in ((ltv.bg_nbd_loglik, ltv.bg_nbd_slopes, [0.7, 3.1, 0.6, 2.4], rows),
                                         (ltv.gamma_gamma_loglik, ltv.gamma_gamma_slopes, [2.2, 3.4, 15.0], rows[1:])):
        at, d = np.array(params), len(params)
        got, pairs = slopes(at, part), [(i, j) for i in range(len(params)) for j in range(i + 1)]
        for i in range(d):
            step = np.eye(d)[i] * 1e-5 * at[i]
            assert np.allclose(got[i], (loglik(at + step, part) - loglik(at - step, part)) / (2 * step[i]), rtol=1e-5, atol=1e-6)
            change = (slopes(at + step, part) - slopes(at - step, part)) / (2 * step[i])
            for k, (a, b) in enumerate(pairs):
                if i in (a, b):
                    assert np.allclose(got[d + k], change[a if b == i else b], rtol=1e-5, atol=1e-6), (a, b)


def test_newton_finds_the_minimum_of_the_stencil(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(int(x), float(x > 0) * 3.0 + 0.1 * float(x), 9.0, float(m), 1) for x, m in zip(
        rng.poisson(2.0, 300), rng.gamma(4.0, 5.0, 300))], "frequency long, recency double, T double, monetary_value double, weight int")
    repeat = rows.filter("frequency > 0").persist()
    for part, loglik, slopes, n in ((rows, ltv.bg_nbd_loglik, ltv.bg_nbd_slopes, 4),
                                    (repeat, ltv.gamma_gamma_loglik, ltv.gamma_gamma_slopes, 3)):
        quick, plain = ltv.fit_loglik(part, loglik, n, slopes=slopes), ltv.fit_loglik(part, loglik, n)
        assert np.allclose(quick, plain, rtol=2e-3)
    with pytest.raises(ArithmeticError):
        special.newton(lambda p: (float((p ** 4).sum()), 4 * p ** 3, np.diag(12 * p ** 2)), None, np.array([9.0]), max_iter=1)


def test_ltv_fit_is_a_minimum_and_forecast_is_sane(spark):
    summary = ltv.purchase_summary(_marts(spark, SF)["orders"]).persist()
    model = ltv.fit(summary)
    pdf = summary.toPandas()
    scale = 10.0 / pdf["T"].max()
    scaled = pdf.assign(recency=pdf["recency"] * scale, T=pdf["T"] * scale)
    repeat = pdf[pdf["frequency"] > 0]

    def bg(p):
        return -ltv.bg_nbd_loglik(np.array(p), scaled).mean() + 0.001 * np.square(p).sum()

    def gg(p):
        return -ltv.gamma_gamma_loglik(np.array(p), repeat).mean() + 0.001 * np.square(p).sum()

    for loss, point in ((bg, [model.r, model.alpha * scale, model.a, model.b]), (gg, [model.p, model.q, model.v])):
        best = loss(point)
        for i in range(len(point)):
            for factor in (0.9, 0.99, 1.01, 1.1):
                moved = list(point)
                moved[i] *= factor
                assert loss(moved) >= best - 1e-9
    out = ltv.forecast(summary, model).toPandas()
    assert len(out) == len(repeat) and (out["expected_purchases"] >= 0).all() and out["clv_forecast"].notna().all()
    # Purchases expected in a period grow with the period, and start at none.
    x, r, t = (out[c].to_numpy(float) for c in ("frequency", "recency", "T"))
    assert np.allclose(model.expected_purchases(1e-9, x, r, t), 0, atol=1e-6)
    assert (model.expected_purchases(180, x, r, t) >= out["expected_purchases"]).all()


def test_bg_nbd_likelihood_by_integration():
    """The closed form against integrating the purchase process over its two mixing distributions."""
    r, alpha, a, b = 1.4, 3.0, 1.7, 2.2
    lam = (np.arange(4000) + 0.5) * 0.002
    p = (np.arange(2000) + 0.5) / 2000
    f_lam = np.exp((r - 1) * np.log(lam) - alpha * lam + r * math.log(alpha) - math.lgamma(r)) * 0.002
    f_p = np.exp((a - 1) * np.log(p) + (b - 1) * np.log(1 - p) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / 2000
    for x, tx, t in [(0, 0.0, 5.0), (2, 3.0, 6.0), (4, 6.0, 6.5)]:
        alive = (f_p @ (1 - p) ** x) * (f_lam @ (lam ** x * np.exp(-lam * t)))
        gone = (f_p @ (p * (1 - p) ** (x - 1))) * (f_lam @ (lam ** x * np.exp(-lam * tx))) if x else 0.0
        row = pd.DataFrame({"frequency": [x], "recency": [tx], "T": [t]})
        got = ltv.bg_nbd_loglik(np.array([r, alpha, a, b]), row)[0]
        assert math.isclose(got, math.log(alive + gone), rel_tol=2e-3)


def test_loess_against_a_plain_loop():
    rng = np.random.default_rng(5)
    y, robust = rng.random(40), rng.random(40)
    at = np.array([-1.0, 0, 1, 17, 38, 39, 40])
    for span in (7, 15, 55):
        got = decompose.loess(y, span, at, robust)
        for value, x in zip(got, at):
            width = min(span, 40)
            left = min(max(int(x) - (span + 1) // 2 + 1, 0), 40 - width)
            js = range(left, left + width)
            h = max(x - left, left + width - 1 - x) + max(0, (span - 40) // 2)
            w = np.array([max(0, 1 - (abs(j - x) / h) ** 3) ** 3 * robust[j] if abs(j - x) <= 0.999 * h else 0
                          for j in js])
            design = np.c_[np.ones(width), np.array(js) - x]
            coef = np.linalg.lstsq(design * np.sqrt(w)[:, None], y[list(js)] * np.sqrt(w), rcond=None)[0]
            assert math.isclose(value, coef[0], rel_tol=1e-6, abs_tol=1e-9)


def test_anomalies_find_injected_days(spark):
    days = pd.date_range("2024-01-01", periods=210)
    rng = np.random.default_rng(1)
    value = 100 + np.arange(210) * 0.2 + 15 * np.sin(2 * np.pi * np.arange(210) / 7) + rng.normal(0, 1, 210)
    value[[60, 150]] += [80, -80]
    df = spark.createDataFrame(pd.DataFrame({"date_day": days, "total_revenue": value, "location_id": "s"}))
    gap = df.filter("date_day <> '2024-03-10'")
    scored = anomaly.revenue_anomalies(anomaly.daily_series(gap, "location_id", fill=True))
    assert scored.count() == 210
    top = anomaly.top_anomalies(scored).collect()
    found = {r.date_day.isoformat() for r in top}
    assert {days[60].date().isoformat(), days[150].date().isoformat(), "2024-03-10"} <= found
    kept = scored.filter("not is_anomaly").toPandas()
    assert abs(kept["resid"]).max() < 10
    assert np.allclose(kept["trend"] + kept["seasonal"] + kept["resid"], kept["revenue"])
    total = anomaly.anomaly_summary(scored).first()
    assert total.anomalies == total.spikes + total.drops == len(top) and total.days == 210
    assert anomaly.daily_series(gap, "location_id").count() == 209  # only days with sales, unless asked


def test_forecast_of_any_horizon_equals_a_plain_sum(spark):
    model = ltv.LtvModel(0.8, 20.0, 0.9, 2.1, 6.0, 4.0, 30.0)
    rows = [(1, 3, 40, 60, 12.0), (2, 1, 5, 90, 30.0), (3, 8, 100, 101, 5.5), (4, 0, 0, 10, 0.0)]
    summary = spark.createDataFrame(rows, "customer_id int, frequency long, recency int, T int, monetary_value double")
    for days, months in ((20, 1), (30, 1), (75, 3), (90, 3)):
        got = {r.customer_id: r for r in ltv.forecast(summary, model, days).collect()}
        assert sorted(got) == [1, 2, 3]
        for who, x, recency, age, m in rows[:3]:
            grown = lambda t: float(model.expected_purchases(t, np.array([x]), np.array([recency]), np.array([age]))[0])  # noqa: B023, E731
            value = float(model.expected_value(np.array([x]), np.array([m]))[0])
            want = sum(value * (grown(30 * i) - grown(30 * (i - 1) or 1e-12)) / 1.01 ** i for i in range(1, months + 1))
            assert math.isclose(got[who].clv_forecast, want, rel_tol=1e-6)
            assert math.isclose(got[who].expected_purchases, grown(days), rel_tol=1e-9)


def test_fits_refuse_what_they_cannot_do(spark):
    summary = spark.createDataFrame([(1, 3, 40, 60, 12.0), (2, 1, 5, 90, 0.0), (3, 2, 5, 80, 4.0)],
                                    "customer_id int, frequency long, recency int, T int, monetary_value double")
    with pytest.raises(ValueError, match="1 repeat customers"):
        ltv.fit(summary)
    with pytest.raises(ArithmeticError):
        special.hyp2f1(1.0, 2.0, 3.5, 0.99, max_terms=5)
    with pytest.raises(ArithmeticError):
        special.minimize(lambda p: (p ** 4).sum(axis=1), np.array([9.0]), max_iter=1)


def test_scores_carry_no_model_into_tasks(model):
    """A fitted model in a task's closure brings its training summary, which need not be serializable."""
    for scored in (model.scores(), model.metrics()):
        assert "UDF(" not in scored._jdf.queryExecution().optimizedPlan().toString()
    wanted = {r.customer_id: float(r.probability[1]) for r in model.forest.transform(model.rows).collect()}
    got = {r.customer_id: r.churn_probability for r in model.scores().collect()}
    assert got.keys() == wanted.keys() and all(math.isclose(got[c], wanted[c], abs_tol=1e-12) for c in got)
    wanted = {r.customer_id: float(r.probability[1]) for r in model.logistic.transform(model.rows).collect()}
    got = {r.customer_id: r.churn_probability for r in model._by_logistic(model.rows).collect()}
    assert got.keys() == wanted.keys() and all(math.isclose(got[c], wanted[c], abs_tol=1e-12) for c in got)


def test_forest_with_cached_node_ids_is_the_same(model):
    rows = churn.with_class_weights(churn.spread(model.rows.filter("not is_test"), "customer_id")).persist()
    walked = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=8, maxDepth=4,
                                    featureSubsetStrategy="sqrt", seed=42).fit(rows)
    cached = churn.fit_forest(rows, 8, 4, 42)
    assert cached.getCacheNodeIds() and churn.forest_rows(cached).collect() == churn.forest_rows(walked).collect()
