"""Exact percentiles against numpy, with ties, nulls, skew and brackets that are narrowed again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import evaluate, quantiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def columns():
    rng = np.random.default_rng(1)
    skewed = np.concatenate([np.full(3000, 7.0), rng.normal(0, 1e6, 900), [1e300, -1e300]])
    return {
        "skewed": skewed, "ties": rng.integers(0, 3, 3902).astype(float), "even": np.arange(3902) / 7, "one": np.array([5.0]), "two": np.array([1.0, 2.0]),
        "signs": np.array([-0.5, 0.0, 0.25, -3.0]), "none": np.array([]),
    }


def frame(spark):
    own = columns()
    n = max(map(len, own.values()))
    rows = [tuple(float(c[i]) if i < len(c) else None for c in own.values()) for i in np.random.default_rng(2).permutation(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in own)).repartition(5)


@pytest.mark.parametrize("accuracy, few", [(10_000, 1 << 20), (40, 20), (20, 1)])
def test_selected_equals_numpy(spark, monkeypatch, accuracy, few):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "FEW", few)
    got = quantiles.selected(frame(spark), {c: F.col(c) for c in columns()}, SHARES)
    for c, own in columns().items():
        assert got[c] == ([None] * len(SHARES) if not len(own) else pytest.approx(np.quantile(own, SHARES).tolist(), rel=1e-12)), c


def test_selected_equals_the_built_in(spark):
    df = frame(spark)
    got = quantiles.selected(df, {c: F.col(c) for c in df.columns}, SHARES)
    want = df.agg(*[F.percentile(F.col(c), SHARES).alias(c) for c in df.columns]).first()
    assert {c: got[c] for c in df.columns} == {c: [None] * len(SHARES) if want[c] is None else want[c] for c in df.columns}


def test_percentiles_by_group(spark):
    own = columns()
    rows = [(g, k, float(v)) for k, (g, values) in enumerate(own.items()) for v in values] + [(None, None, 1.0), (None, None, 4.0), ("even", 2, None), ("empty", 9, None)]
    got = {(r.g, r.k): r.q for r in quantiles.by_group(spark.createDataFrame(rows, "g string, k int, v double").repartition(6), "v", ["g", "k"], SHARES).collect()}
    want = {(g, k): np.quantile(v, SHARES).tolist() for k, (g, v) in enumerate(own.items()) if len(v)} | {(None, None): np.quantile([1.0, 4.0], SHARES).tolist()}
    assert got.keys() == want.keys()
    for key, q in want.items():
        assert got[key] == pytest.approx(q, rel=1e-12), key


def test_sweep_with_edges(spark):
    rows = [(0.1, 1), (0.2, 0), (0.2, 1), (None, 1), (float("nan"), 1), (0.3, None), (float("inf"), 0)]
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in evaluate.threshold_sweep(spark.createDataFrame(rows, "prob double, final_label int"), [0.2, 0.05, 0.5, 0.2]).collect()}
    assert got == {0.05: (3, 3, 1), 0.2: (2, 3, 2), 0.5: (1, 1, 3)}
    empty = evaluate.threshold_sweep(spark.createDataFrame([], "prob double, final_label int"), [0.5]).collect()
    assert [(r.tp, r.fp, r.fn) for r in empty] == [(0, 0, 0)]
