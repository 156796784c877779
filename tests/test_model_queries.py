"""The model queries that SQL can't express, run on the smallest tables with small settings, against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerlark.operators import clustering, evaluate, history, models
from ledgerlark.plans import score_queries as q


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(models, "BEST", {"maxDepth": 2, "stepSize": 0.1, "maxIter": 3, "subsamplingRate": 1.0})
    monkeypatch.setattr(models, "GRID", models.GRID[:1] and ({"maxDepth": 2, "stepSize": 0.1, "maxIter": 2, "subsamplingRate": 1.0}, {"maxDepth": 3, "stepSize": 0.1, "maxIter": 2, "subsamplingRate": 1.0}))
    monkeypatch.setattr(models, "TREES", 10)


def run(spark, data, name):
    return __spark_entry__.queries()[name](spark, data).toPandas()


def average_precision(prob, y):
    found, hit, seen = 0.0, 0, 0
    for p in sorted(set(prob), reverse=True):
        now = [b for a, b in zip(prob, y) if a == p]
        hit, seen = hit + sum(now), seen + len(now)
        found += sum(now) / sum(y) * hit / seen
    return found


def test_boosted_trees(spark, data):
    got = run(spark, data, "m02_m13_boosted_trees")
    assert len(got) and got["prob"].between(0, 1).all() and (got["flag"] == (got["prob"] >= 0.5)).all()
    want = average_precision(got["prob"].tolist(), got["final_label"].tolist())
    assert evaluate.average_precision(spark.createDataFrame(got)).first()[0] == pytest.approx(want, abs=2e-6)


def test_grid_search(spark, data):
    got = run(spark, data, "m02_grid_search")
    assert got["maxDepth"].tolist() == [2, 3] and got["average_precision"].between(0, 1).all()


def test_a_shorter_fit_is_the_start_of_a_longer_one(spark, data):
    train, val, _ = (x.persist() for x in q.splits(q_tables(spark, data)))
    features = ("log_shares", "log_total_value", "txn_month")
    fits = {n: models.fit_boosted(train.withColumn("final_label", (F.col("txn_month") > 6).cast("int")), val.withColumn("final_label", (F.col("txn_month") > 6).cast("int")), features, maxIter=n) for n in (3, 5)}
    start = models.first_trees(fits[5], 3)
    assert fits[5].getNumTrees == 5 and start.getNumTrees == 3
    probs = [[r.prob for r in models.score(m, val, features).orderBy("row_id").select("prob").collect()] for m in (start, fits[3], fits[5])]
    assert probs[0] == pytest.approx(probs[1], abs=1e-12) and probs[0] != pytest.approx(probs[2], abs=1e-6)


def test_paths_of_the_forest_equal_a_plain_walk(spark, data):
    """Scores of the forest's own trees, walked row by row."""
    train, _, test = q.splits(q_tables(spark, data))
    forest = models.isolation_trees(train, q.MODEL_FEATURES).persist()
    trees = {}
    for r in forest.collect():
        trees.setdefault(r.tree, {})[r.node] = r
    size = max(t[0].size for t in trees.values())
    c = lambda n: 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    some = test.orderBy("row_id").limit(40).persist()
    got = {r.row_id: r.prob for r in models.isolation_scores(some, forest, q.MODEL_FEATURES).collect()}
    for row in some.collect():
        total = 0.0
        for tree in trees.values():
            at, depth = tree[0], 0
            while at.feature >= 0:
                at, depth = tree[at.left if row[q.MODEL_FEATURES[at.feature]] < at.split else at.right], depth + 1
            total += depth + c(at.size)
        assert got[row.row_id] == pytest.approx(2 ** (-total / len(trees) / c(size)))


def test_isolation_forest(spark, data):
    got = run(spark, data, "m04_isolation_forest")
    assert len(got) and got["prob"].between(0, 1).all() and got["prob"].nunique() > 5
    surrogate = run(spark, data, "m05_surrogate_importance")
    assert set(surrogate["feature"]) == set(q.MODEL_FEATURES) and surrogate["importance"].sum() == pytest.approx(1)


def test_contamination_and_scaling_of_scores(spark):
    """Against numpy, with ties, and validation scores outside the range of the training rows."""
    rng = np.random.default_rng(4)
    train = np.round(rng.uniform(0.3, 0.7, 501), 2)
    val, y = np.round(rng.uniform(0.2, 0.8, 200), 2), rng.integers(0, 2, 200)
    kept = spark.createDataFrame([(k, 0, float(p)) for k, p in enumerate(train)], "row_id long, final_label int, prob double")
    other = spark.createDataFrame([(k, int(b), float(p)) for k, (p, b) in enumerate(zip(val, y))], kept.schema)
    scaled = np.clip((val - train.min()) / (train.max() - train.min()), 0, 1)
    got = {r.row_id: r for r in models.scaled_anomalies(other, kept).collect()}
    for k, p in enumerate(scaled):
        assert got[k].prob_scaled == pytest.approx(p) and got[k].flag == (got[k].prob_scaled >= 0.1)
    ap = average_precision([got[k].prob_scaled for k in range(200)], y.tolist())
    grid = models.contamination_grid(kept, other).collect()
    assert [r.contamination for r in grid] == list(models.CONTAMINATION) and [r.chosen for r in grid] == [True] + [False] * 7
    for r in grid:
        assert r.offset == pytest.approx(-np.percentile(-train, 100 * r.contamination)) and r.average_precision == pytest.approx(ap, abs=2e-6)
        assert r.train_outliers == (train > r.offset).sum()
    assert models.contamination_grid(kept.limit(0), other).collect() == []
    assert all(r.prob_scaled == 0 for r in models.scaled_anomalies(other, kept.filter("row_id = 0")).collect())


def test_scaled_anomalies_of_the_trades(spark, data):
    got = run(spark, data, "m04_p41_scaled_scores")
    assert len(got) and got["prob_scaled"].between(0, 1).all() and got["prob_scaled"].nunique() > 5
    assert (got["flag"] == (got["prob_scaled"] >= 0.1)).all()


def lloyd(x, centres, iterations=clustering.MAX_ITERATIONS):
    """Plain Lloyd: centres and cost."""
    for _ in range(iterations):
        own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[own == k].mean(0) if (own == k).any() else c for k, c in enumerate(centres)])
        moved = ((new - centres) ** 2).sum()
        centres = new
        if moved <= clustering.TOLERANCE:
            break
    return centres, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def test_all_fits_equal_plain_ones(spark):
    """Every fit of several k and restarts, from its seeds; rows dealt otherwise give the same."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.4, (40, 3)) for c in ([0, 0, 0], [3, 0, 1], [0, 4, -2], [5, 5, 5])])
    rows = spark.createDataFrame([(int(h), [float(v) for v in r]) for h, r in zip(rng.integers(-(2**62), 2**62, len(x)), x)], "h long, x array<double>")
    drawn = clustering.seeds(rows, 5, 4)
    assert all(any(np.allclose(s, r) for r in x) for s in drawn.reshape(-1, 3))
    assert all(len(np.unique(d, axis=0)) == 5 for d in drawn)
    found = clustering.fits(rows.repartition(7), (2, 3, 4, 5), 4)
    assert len(found) == 16
    for fit in found:
        centres, cost = lloyd(x, drawn[fit.restart, : fit.k])
        assert np.allclose(fit.centres, centres) and fit.cost == pytest.approx(cost)
    best = clustering.best(found)
    assert clustering.elbow({2: 100.0, 3: 60.0, 4: 12.0, 5: 10.0}) == 4 and clustering.elbow({2: 3.0, 3: 3.0}) == 2
    got = clustering.with_cluster(rows, best[4].centres).toPandas()
    at = np.stack(got["x"].to_numpy())
    assert got["cluster"].tolist() == ((at[:, None] - best[4].centres[None]) ** 2).sum(2).argmin(1).tolist()


def test_fits_of_few_rows(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "h long, x array<double>")
    assert [f.cost for f in clustering.fits(same, (2, 3), 2)] == [0.0] * 4
    assert clustering.fits(same.limit(0), (2,), 2) == []


def test_clusters(spark, data):
    """k of 2 to 10 with 20 restarts, as registered; costs and elbow against plain numpy, rates by cluster."""
    got = run(spark, data, "m06_a18_j14_clusters")
    own = q.profiles(q_tables(spark, data))
    clustered, costs = models.clustered_profiles(own, q.MODEL_FEATURES)
    rows = clustered.select("insider_cik", "h", "x", "cluster", "informed_rate").toPandas()
    x = np.stack(rows["x"].to_numpy())
    drawn = clustering.seeds(clustered.select("h", "x"), 10, 20)
    want = {k: min(lloyd(x, drawn[r, :k])[1] for r in range(20)) for k in range(2, 11)}
    assert costs == pytest.approx(want)
    (x0, y0), (x1, y1) = (2, want[2]), (10, want[10])
    chord = {k: abs((y1 - y0) * k - (x1 - x0) * c + x1 * y0 - y1 * x0) for k, c in want.items()}
    assert rows["cluster"].nunique() == max(chord, key=chord.get)
    rates = rows.groupby("cluster")["informed_rate"].mean()
    known = dict(zip(rows["insider_cik"], rows["cluster"]))
    for r in got.itertuples():
        assert r.prob == pytest.approx(rates[known[r.insider_cik]], abs=1e-6)


def test_principal_components(spark, data):
    got = run(spark, data, "m07_principal_components")
    x = spark.createDataFrame([], "a int")  # session only
    own = q.profiles(__import__("ledgerlark.plans.tables", fromlist=["Tables"]).Tables(x.sparkSession, data)).na.fill(0.0).toPandas().set_index("insider_cik")
    values = own[list(q.MODEL_FEATURES)].to_numpy(float)
    spread = values.std(0)
    z = np.where(spread > 0, (values - values.mean(0)) / np.where(spread > 0, spread, 1), 0.0)
    _, vectors = np.linalg.eigh(np.cov(z.T))
    want = z @ vectors[:, ::-1][:, :2]
    at = own.index.get_indexer(got["insider_cik"])
    for k, c in enumerate(("pc1", "pc2")):  # up to sign
        assert min(np.abs(got[c] - want[at, k]).max(), np.abs(got[c] + want[at, k]).max()) < 1e-6


def test_ablation_walk_forward_and_permutation(spark, data):
    ablated = run(spark, data, "m10_ablation").set_index("without")
    assert ablated["features"].to_dict() == {"trade": 35, "temporal": 28, "insider_profile": 34, "network": 39, "timing": 39, "text": 42, "market_context": 40, "trade_only": 8}
    train, val, test = q.splits(q_tables(spark, data))
    used = [c for c in q.MODEL_FEATURES if c not in history.FEATURE_GROUPS["network"]]
    scored = models.score(models.fit_boosted(train, val, used), test, used).select("prob", "final_label").toPandas()
    want = average_precision(scored["prob"].tolist(), scored["final_label"].tolist())
    assert ablated.loc["network", "average_precision"] == pytest.approx(want, abs=2e-6) and ablated.loc["network", "drop"] == pytest.approx(0.69 - want, abs=2e-6)
    walked = models.walk_forward(q.model_table(q_tables(spark, data)), q.MODEL_FEATURES, (1996, 1997), least=10)
    assert walked.count() == 2
    r = models.walk_forward_summary(walked).first()
    aps = [x.average_precision for x in walked.collect()]
    assert r.mean_average_precision == pytest.approx(np.mean(aps)) and r.std_average_precision == pytest.approx(np.std(aps))
    assert set(run(spark, data, "m12_permutation_importance")["feature"]) == set(q.MODEL_FEATURES)


def q_tables(spark, data):
    from ledgerlark.plans.tables import Tables

    return Tables(spark, data)


def test_labels_to_metrics(spark, data):
    r = run(spark, data, "c07_labels_to_metrics").iloc[0]
    assert 0 <= r["precision"] <= 1 and r["f1"] == pytest.approx(2 * r["tp"] / max(2 * r["tp"] + r["fp"] + r["fn"], 1), abs=1e-5)


def test_student_p(spark):
    from pyspark.sql import functions as F

    rows = [(2.0, 10.0, 0.073388), (0.0, 5.0, 1.0), (1.0, 1.0, 0.5), (-2.5758293, 1e7, 0.01), (12.0, 3.0, 0.001246), (60.0, 400.0, 0.0)]
    got = spark.createDataFrame([(t, d) for t, d, _ in rows], "t double, dof double").select(evaluate.student_p(F.col("t"), F.col("dof")).alias("p")).collect()
    for (_, _, want), r in zip(rows, got):
        assert math.isclose(r.p, want, abs_tol=2e-6)


def test_fits_over_many_rows_run_one_after_the_other():
    """MLlib keeps the rows of each fit, beside each other no more than so many."""
    assert [models.beside(n) for n in (0, 1_000_000, 3_000_000, 20_000_000)] == [8, 8, 2, 1]


def test_permuted_rows_are_exchanged_once_for_all_features(spark, data, monkeypatch):
    """each feature's values are dealt to other rows, whole and in several buckets; the losses are those of plain scoring."""
    monkeypatch.setattr(models, "DEALT_ROWS", 100)
    train, val, test = q.splits(q_tables(spark, data))
    features = ("log_shares", "txn_month", "log_total_value")
    y = (F.col("txn_month") > 6).cast("int")
    train, val, test = (x.withColumn("final_label", y) for x in (train, val, test))
    model, n = models.fit_boosted(train, val, features), test.count()
    assert n > 300
    pairs = models.dealt(test, features).collect()
    assert len(pairs) == n and sorted(r["_x"] for r in pairs) == sorted(r["_other"] for r in pairs) and sum(r["_x"] != r["_other"] for r in pairs) > 0.9 * n
    ap = lambda rows: average_precision(*zip(*[(r.prob, r.final_label) for r in models.score(model, spark.createDataFrame(rows, (*features, "final_label")), features).collect()]))
    base = ap([(*r["_x"], r.final_label) for r in pairs])
    want = {c: base - ap([(*r["_x"][:k], r["_other"][k], *r["_x"][k + 1 :], r.final_label) for r in pairs]) for k, c in enumerate(features)}
    context = spark.sparkContext
    jobs = []
    for of in (features[:1], features):
        context.setJobGroup(f"dealt-{len(of)}", "")
        got = models.permutation_importance(model, test, features, of=of)
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"dealt-{len(of)}")))
        context.setLocalProperty("spark.jobGroup.id", None)
        assert {r.feature: r.importance for r in got.collect()} == pytest.approx({c: want[c] for c in of}, abs=3e-6)
    assert want["txn_month"] > 0.3 and jobs[0] == jobs[1] > 0
    single = models.permutation_importance(model, test.withColumn("final_label", F.lit(0)), features).collect()
    assert [r.importance for r in single] == [None] * 3
