"""Scoring models as Spark jobs, on MLlib where it has them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import functions as MF
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.fpm import FPGrowth
from pyspark import SparkContext, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions.trade import finite_or_zero
from ledgerlark.operators import clustering, evaluate, quantiles
from ledgerlark.sources.shared import written

SEED = 42
#: Rows of a bucket in which values are dealt anew, about.
DEALT_ROWS = 10_000
#: Fits that run beside each other, and training rows of all of them, as MLlib keeps those of each.
PARALLEL, BESIDE_ROWS = 8, 8_000_000
# Parameters of the reference grid and of the forest.
GRID = tuple({"maxDepth": d, "stepSize": r, "maxIter": n, "subsamplingRate": s} for d in (3, 5, 7) for r in (0.05, 0.1) for n in (100, 200) for s in (0.8, 1.0))
BEST = {"maxDepth": 7, "stepSize": 0.05, "maxIter": 100, "subsamplingRate": 0.8}
TREES, SAMPLE = 200, 256
SUPPORT, CONFIDENCE = 0.03, 0.5
MEMBERSHIP = "opportunistic"


def guard_leaks(features, leaks) -> None:
    """Names that would leak the label are no features."""
    if bad := set(features) & set(leaks):
        raise ValueError(f"leaking features: {sorted(bad)}")


def numeric(df: DataFrame, features, *keep: str) -> DataFrame:
    """P25: features as finite doubles; a missing column is an error."""
    if missing := [c for c in features if c not in df.columns]:
        raise ValueError(f"missing features: {missing}")
    kinds = dict(df.dtypes)
    whole = lambda c: kinds[c] in ("boolean", "tinyint", "smallint", "int", "bigint")
    # Whole numbers are finite; what is not asked for keeps the code of the plan's last stage below the length that is compiled.
    return df.select(*keep, *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if whole(c) else finite_or_zero(F.col(c))).alias(c) for c in features])


def standard_scale(df: DataFrame, train: DataFrame, features) -> DataFrame:
    """M1: z-scores by mean and population deviation of ``train``; a constant column is 0."""
    fit = train.agg(*[x for c in features for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in features}
    return df.crossJoin(F.broadcast(fit)).withColumns(scaled).drop(*fit.columns)  # one row


def assemble(df: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def beside(rows: int) -> int:
    """How many fits over so many rows run beside each other."""
    return max(1, min(PARALLEL, BESIDE_ROWS // max(1, rows)))


def at_once(spark, calls: list, at_a_time: int = PARALLEL) -> list:
    """Results of ``calls``, of which a few run as Spark jobs beside each other, as MLlib's own tuning does."""
    with ThreadPool(at_a_time) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda f: f()), calls)


def fit_boosted(train: DataFrame, val: DataFrame, features, label: str = "final_label", **params):
    """M2: boosted trees with weighted positives; rows of ``val`` stop the boosting early."""
    both = train.withColumn("_val", F.lit(False)).unionByName(val.withColumn("_val", F.lit(True)))
    weights = evaluate.class_weights(train, label)
    rows = both.crossJoin(F.broadcast(weights.select("scale_pos_weight")))
    rows = rows.withColumn("_w", F.when(F.col(label) == 1, F.coalesce("scale_pos_weight", F.lit(1.0))).otherwise(1.0))
    model = GBTClassifier(labelCol=label, weightCol="_w", validationIndicatorCol="_val", seed=SEED, **(BEST | params))
    return model.fit(assemble(rows.drop("scale_pos_weight"), features))


def score(model, df: DataFrame, features) -> DataFrame:
    """``df`` with prob and flag."""
    out = model.transform(assemble(df, features))
    return out.withColumn("prob", MF.vector_to_array("probability")[1]).withColumn("flag", (F.col("prob") >= evaluate.FLAG_FROM).cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model after its first ``n`` iterations: boosting adds trees one by one, so a shorter fit is the start of a longer one."""
    trees, weights = model._call_java("trees"), model.treeWeights[:n]
    if len(weights) == model.getNumTrees:
        return model
    context = SparkContext._active_spark_context
    kept = context._gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(weights))
    own = context._gateway.new_array(context._jvm.double, len(weights))
    for k, w in enumerate(weights):
        kept[k], own[k] = trees[k], float(w)
    return GBTClassificationModel(context._jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{model.uid}_{n}", kept, own))


def grid_search(train: DataFrame, val: DataFrame, features, grid=None):
    """M2: (best model, table of parameters and average precision on ``val``); the first best counts.

    Settings that differ in the number of iterations alone share one fit, the longest.
    """
    grid, train, val = grid or GRID, train.persist(), val.persist()
    rest = lambda params: tuple(v for k, v in params.items() if k != "maxIter")
    longest = {}
    for params in grid:
        if params["maxIter"] >= longest.get(rest(params), params)["maxIter"]:
            longest[rest(params)] = params

    def one(params):
        whole = fit_boosted(train, val, features, **params)
        shorter = sorted({p["maxIter"] for p in grid if rest(p) == rest(params)})
        models = {n: first_trees(whole, n) for n in shorter}
        return {n: (m, evaluate.average_precision(score(m, val, features)).first()[0]) for n, m in models.items()}

    made = dict(zip(longest, at_once(train.sparkSession, [partial(one, params) for params in longest.values()], beside(train.count() + val.count()))))
    fits = [made[rest(params)][params["maxIter"]] for params in grid]
    best = max(fits, key=lambda x: x[1] or 0)[0]
    found = [(k, *params.values(), ap) for k, (params, (_, ap)) in enumerate(zip(grid, fits))]
    train.unpersist()
    val.unpersist()
    return best, train.sparkSession.createDataFrame(found, "place int, maxDepth int, stepSize double, maxIter int, subsamplingRate double, average_precision double")


def dealt(df: DataFrame, features, label: str = "final_label") -> DataFrame:
    """The label, _x, the features of a row, and _other, those of the row beside it in a random order of its bucket, the first beside the last.

    Each row's values go to one other row, so every feature is a permutation
    of its own.  Buckets follow the rows alone and no window spans the table.
    """
    buckets = max(1, math.ceil(df.count() / DEALT_ROWS))
    rows = df.select(label, "row_id", F.array(*[F.col(c).cast("double") for c in features]).alias("_x"), F.pmod(F.xxhash64("row_id"), F.lit(buckets)).alias("_b"))
    rows = rows.repartition(buckets, "_b")
    order = Window.partitionBy("_b").orderBy(F.xxhash64("row_id", F.lit(SEED)), "row_id")
    last = F.last("_x").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select(label, "_x", F.coalesce(F.lag("_x").over(order), last).alias("_other"))


def permutation_importance(model, df: DataFrame, features, of=None, label: str = "final_label") -> DataFrame:
    """Loss of average precision when a feature's values are dealt anew among the rows, for each feature or those in ``of``.

    The rows are exchanged once for all features.  A row is scored as it is
    (place 0) and with each feature of the row beside it, where both lie; what
    is exchanged then are counts by feature and distinct score.
    """
    features = list(features)
    places = [features.index(c) + 1 for c in of or features]
    n, k = len(features), F.col("_k")
    spread_out = dealt(df, features, label).withColumn("_k", F.explode(F.array(*[F.lit(i) for i in (0, *places)])))
    mixed = F.when(k == 0, F.col("_x")).otherwise(F.concat(F.slice("_x", F.lit(1), k - 1), F.slice("_other", F.greatest(k, F.lit(1)), F.lit(1)), F.slice("_x", k + 1, F.lit(n))))
    scored = model.transform(spread_out.select(label, "_k", MF.array_to_vector(mixed).alias("features")))
    counted = written(scored.groupBy("_k", MF.vector_to_array("probability")[1].alias("prob"), label).agg(F.count("*").alias("_n")), "dealt_scores")
    found = {r["_k"]: r["average_precision"] for r in evaluate.average_precision(counted, by=("_k",), label=label, times="_n").collect()}  # one row a feature
    loss = lambda i: None if found.get(0) is None or found.get(i) is None else found[0] - found[i]
    return df.sparkSession.createDataFrame([(features[i - 1], loss(i)) for i in places], "feature string, importance double")


def naive_bayes(train: DataFrame, df: DataFrame, features, label: str = "final_label", smoothing: float = 1e-9) -> DataFrame:
    """M3: Gaussian naive Bayes with the priors of ``train``, in closed form: ``df`` with prob.

    Variances gain ``smoothing`` times the largest variance of a feature.
    """
    side = lambda c, y: F.when(F.col(label) == y, F.col(c))
    fit = train.agg(
        F.greatest(F.lit(0.0), *[F.var_pop(c) for c in features]).alias("_big"),
        *[F.log(F.count_if(F.col(label) == y) / F.count("*")).alias(f"_p{y}") for y in (0, 1)],
        *[f(side(c, y)).alias(f"_{n}{y}_{c}") for c in features for y in (0, 1) for n, f in (("m", F.avg), ("v", F.var_pop))],
    )

    def log_likelihood(y: int):
        parts = []
        for c in features:
            v = F.col(f"_v{y}_{c}") + smoothing * F.col("_big")
            parts.append(-0.5 * F.log(2 * math.pi * v) - (F.col(c) - F.col(f"_m{y}_{c}")) ** 2 / (2 * v))
        return reduce(lambda a, b: a + b, parts, F.col(f"_p{y}"))

    joined = df.crossJoin(F.broadcast(fit))  # one row
    odds = log_likelihood(1) - log_likelihood(0)
    return joined.withColumn("prob", 1 / (1 + F.exp(F.least(-odds, F.lit(700.0))))).drop(*fit.columns)


def association_rules(baskets: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, consequent: str = MEMBERSHIP) -> DataFrame:
    """M8: rules that lead to ``consequent`` alone, the greatest lift first."""
    rules = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets.select("items")).associationRules
    found = rules.filter(F.col("consequent") == F.array(F.lit(consequent)))
    return found.select(F.array_sort("antecedent").alias("antecedent"), "consequent", "confidence", "lift", "support").orderBy(F.desc("lift"), F.array_join("antecedent", ","))


def rule_scores(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """M9: row_id and the confidence of the surest rule that fires, else 0.

    There are at most as many rules as subsets of the few items, so they go
    with each row.
    """
    fired = F.size(F.array_except("antecedent", "items")) == 0
    per = baskets.select("row_id", "items", "final_label").join(F.broadcast(rules.select("antecedent", "confidence")), fired, "left")
    return per.groupBy("row_id", "final_label").agg(F.coalesce(F.max("confidence"), F.lit(0.0)).alias("prob"))


def scaled_profiles(profiles: DataFrame, features) -> DataFrame:
    """M6: insiders' profiles with h, a hash of the insider, and x, their scaled features, missing values being the mean."""
    means = profiles.agg(*[F.avg(c).alias(f"_{c}") for c in features])
    filled = profiles.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(c, f"_{c}", F.lit(0.0)) for c in features}).drop(*means.columns)  # one row
    scaled = standard_scale(filled, filled, features)
    return scaled.withColumns({"h": F.xxhash64("insider_cik"), "x": F.array(*[F.col(c).cast("double") for c in features])})


def clustered_profiles(profiles: DataFrame, features, ks=clustering.CLUSTERS, restarts: int = clustering.RESTARTS) -> tuple[DataFrame, dict[int, float]]:
    """M6: scaled profiles with their cluster at the elbow of the costs, and the least cost of each k."""
    rows = scaled_profiles(profiles, features).select("insider_cik", "informed_rate", "h", "x")
    found = clustering.best(clustering.fits(rows.select("h", "x"), ks, restarts))
    costs = {k: fit.cost for k, fit in found.items()}
    if not costs:
        return rows.withColumn("cluster", F.lit(None).cast("int")), costs
    return clustering.with_cluster(rows, found[clustering.elbow(costs)].centres), costs


def cluster_rates(clustered: DataFrame, rate: str = "informed_rate") -> DataFrame:
    """Insiders and mean informed rate of each cluster."""
    return clustered.groupBy("cluster").agg(F.count("*").alias("insiders"), F.round(F.avg(rate), 6).alias("informed_rate"))


def map_back(trades: DataFrame, clustered: DataFrame, rates: DataFrame) -> DataFrame:
    """Each trade's cluster rate; insiders without cluster get the mean of the rates."""
    default = rates.agg(F.avg("informed_rate").alias("_default"))
    keyed = clustered.join(F.broadcast(rates.select("cluster", F.col("informed_rate").alias("cluster_rate"))), "cluster").select("insider_cik", "cluster", "cluster_rate")
    return trades.join(keyed, "insider_cik", "left").crossJoin(F.broadcast(default)).withColumn("prob", F.coalesce("cluster_rate", "_default")).drop("_default", "cluster_rate")


def principal_components(df: DataFrame, features, k: int = 2) -> DataFrame:
    """M7: ``df`` with pc1 .. pck of scaled features."""
    rows = assemble(standard_scale(df, df, features), features)
    out = PCA(k=k, inputCol="features", outputCol="_pc").fit(rows).transform(rows).withColumn("_pc", MF.vector_to_array("_pc"))
    return out.withColumns({f"pc{i + 1}": F.col("_pc")[i] for i in range(k)}).drop("_pc", "features")


# Shares of outliers that are tried, and the scaled score from which a trade is anomalous.
CONTAMINATION, ANOMALY_FROM = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4), 0.1


def path_norm(n) -> np.ndarray:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_trees(train: DataFrame, features, trees: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """M4: trees as rows (tree, node, feature, split, left, right, size), each from about ``sample`` random rows.

    Each row draws the trees it belongs to, so only the samples are shuffled.
    """
    trees = trees or TREES
    rate = min(1.0, 1.5 * sample / max(1, train.count()))
    draw = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("row_id", t, F.lit(SEED)), F.lit(1_000_003)) < rate * 1_000_003)
    drawn = train.select("row_id", F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.explode(draw).alias("tree"))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree, rows = int(rows["tree"].iloc[0]), rows.sort_values("row_id")
        rng = np.random.default_rng((SEED, tree))
        x = np.stack(rows["x"].to_numpy())
        x = x[rng.permutation(len(x))[:sample]]
        limit, out = math.ceil(math.log2(max(2, len(x)))), []

        def node(own: np.ndarray, depth: int) -> int:
            at = len(out)
            out.append([tree, at, -1, 0.0, -1, -1, len(own)])
            spread = np.flatnonzero(own.max(0) > own.min(0)) if len(own) > 1 and depth < limit else []
            if len(spread):
                f = int(rng.choice(spread))
                cut = float(rng.uniform(own[:, f].min(), own[:, f].max()))
                low = own[:, f] < cut
                out[at][2:4] = [f, cut]
                out[at][4], out[at][5] = node(own[low], depth + 1), node(own[~low], depth + 1)
            return at

        node(x, 0)
        return pd.DataFrame(out, columns=["tree", "node", "feature", "split", "left", "right", "size"])

    return drawn.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, split double, left int, right int, size int")


def isolation_scores(df: DataFrame, forest: DataFrame, features, keep=("row_id", "final_label")) -> DataFrame:
    """M4: ``keep`` columns and prob = 2^(-mean path / norm).  The forest has at most trees x 2 x sample rows."""
    rows = forest.orderBy("tree", "node").toPandas()
    sent = df.sparkSession.sparkContext.broadcast([g.reset_index(drop=True) for _, g in rows.groupby("tree")])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown = [{c: g[c].to_numpy() for c in g} for g in sent.value]
        norm = path_norm(np.array([max(g["size"][0] for g in grown)]))[0] or 1.0
        for part in parts:
            x = part[list(features)].to_numpy(float)
            total = np.zeros(len(x))
            for g in grown:
                at, depth = np.zeros(len(x), int), np.zeros(len(x))
                while (inner := g["feature"][at] >= 0).any():
                    k = np.flatnonzero(inner)
                    low = x[k, g["feature"][at[k]]] < g["split"][at[k]]
                    at[k] = np.where(low, g["left"][at[k]], g["right"][at[k]])
                    depth[k] += 1
                total += depth + path_norm(g["size"][at])
            yield part[list(keep)].assign(prob=2 ** (-total / max(1, len(grown)) / norm))

    kinds = dict(df.dtypes)
    return df.select(*dict.fromkeys([*keep, *features])).mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", prob double")


def scaled_anomalies(scored: DataFrame, train_scored: DataFrame, threshold: float = ANOMALY_FROM) -> DataFrame:
    """``scored`` with prob_scaled, prob by the range of the training rows' scores, and flag where it reaches ``threshold``."""
    return evaluate.min_max(scored, train_scored, "prob").withColumn("flag", F.col("prob_scaled") >= threshold)


def contamination_grid(train_scored: DataFrame, val_scored: DataFrame, grid=CONTAMINATION) -> DataFrame:
    """M4: (contamination, offset, train_outliers, average_precision, chosen) for each share of outliers among the training rows.

    The offset is the training score that this share exceeds.  It shifts all
    scores alike and scaling by the training range takes the shift out again,
    so one forest and one average precision on the validation rows serve the
    grid; of equal ones the first is chosen.  No training scores give no rows.
    """
    spark = train_scored.sparkSession
    offsets = quantiles.selected(train_scored, {"prob": F.col("prob")}, [1 - c for c in grid])["prob"]
    ap = evaluate.average_precision(scaled_anomalies(val_scored, train_scored), "prob_scaled").first()
    ap = ap[0] if ap else None
    rows = [(c, o, ap, c == grid[0]) for c, o in zip(grid, offsets) if o is not None]
    above = train_scored.agg(*[F.count_if(F.col("prob") > o).alias(f"n{k}") for k, (_, o, _, _) in enumerate(rows)]).first() if rows else ()
    return spark.createDataFrame([(c, o, n, p, best) for (c, o, p, best), n in zip(rows, above)], "contamination double, offset double, train_outliers long, average_precision double, chosen boolean")


def surrogate_importance(scored: DataFrame, features, column: str = "prob") -> DataFrame:
    """M5: importances of a random forest that learns whether a score is above 0.5, or above its median if all or none are."""
    med = evaluate.median_of(scored, column).first()[0]
    n = scored.agg(F.count_if(F.col(column) > 0.5), F.count("*")).first()
    cut = 0.5 if 0 < n[0] < n[1] else med
    rows = assemble(scored.withColumn("_y", (F.col(column) > cut).cast("double")), features)
    model = RandomForestClassifier(labelCol="_y", numTrees=100, seed=SEED).fit(rows)
    return scored.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(features, model.featureImportances.toArray())], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def ablation(train: DataFrame, val: DataFrame, test: DataFrame, groups: dict, features, baseline: float = 0.69, **params) -> DataFrame:
    """Average precision on ``test`` without each group of features and with the trade group alone.

    The parts are read anew by each fit, which keeps its own rows.
    """
    sets = {name: [c for c in features if c not in group] for name, group in groups.items()} | {"trade_only": [c for c in features if c in groups["trade"]]}

    def one(used):
        return evaluate.average_precision(score(fit_boosted(train, val, used, **params), test, used)).first()[0]

    aps = at_once(train.sparkSession, [partial(one, used) for used in sets.values()], beside(train.count() + val.count()))
    found = [(name, len(used), ap, None if ap is None else baseline - ap) for (name, used), ap in zip(sets.items(), aps)]
    return train.sparkSession.createDataFrame(found, "without string, features int, average_precision double, drop double").orderBy(F.desc("drop"))


def walk_forward(df: DataFrame, features, first_train_to, least: int = 100, **params) -> DataFrame:
    """For each last training year, metrics of the year after next; windows with a short side are skipped.

    The rows are read anew by each fit, which keeps its own.
    """
    year, rows = F.year("transaction_date"), df

    def one(y):
        train, val, test = rows.filter(year <= y), rows.filter(year == y + 1), rows.filter(year == y + 2)
        if min(train.count(), val.count(), test.count()) < least:
            return None
        scored = score(fit_boosted(train, val, features, **params), test, features).persist()
        ap, f1 = evaluate.average_precision(scored).first()[0], evaluate.confusion(scored, F.col("flag") == 1).first()["f1"]
        scored.unpersist()
        return y + 2, ap, f1

    found = [x for x in at_once(df.sparkSession, [partial(one, y) for y in first_train_to], beside(rows.count())) if x]
    return df.sparkSession.createDataFrame(found, "test_year int, average_precision double, f1 double")


def walk_forward_summary(windows: DataFrame) -> DataFrame:
    """Mean and population deviation over windows."""
    return windows.agg(*[f(c).alias(f"{n}_{c}") for c in ("average_precision", "f1") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
