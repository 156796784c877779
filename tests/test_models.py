"""The model queries run the operators' whole settings."""

from types import SimpleNamespace

from ledgerlark.operators import clustering, models
from ledgerlark.plans import score_queries as q


def test_model_queries_use_production_settings(monkeypatch):
    calls = []

    def fake(name, result):
        monkeypatch.setattr(models, name, lambda *a, **k: calls.append((name, a, k)) or result)

    monkeypatch.setattr(q, "splits", lambda tables: ("train", "val", "test"))
    monkeypatch.setattr(q, "model_table", lambda tables: "table")
    monkeypatch.setattr(q, "profiles", lambda tables: "profiles")
    monkeypatch.setattr(q, "written", lambda df, label: df)
    monkeypatch.setattr(q.evaluate, "insider_profiles", lambda *a: "profiles")
    frame = SimpleNamespace(select=lambda *a: "out")
    for name, result in {"fit_boosted": "model", "score": frame, "grid_search": ("best", "table"), "isolation_trees": "forest", "isolation_scores": frame, "surrogate_importance": "out",
                         "clustered_profiles": ("clustered", {}), "cluster_rates": "rates", "map_back": frame, "ablation": "out", "walk_forward": "out", "permutation_importance": "out"}.items():
        fake(name, result)
    for query in (q.m02_m13_boosted_trees, q.m02_grid_search, q.m05_surrogate_importance, q.m06_a18_j14_clusters, q.m10_ablation, q.m11_walk_forward, q.m12_permutation_importance):
        query(None)
    for name, args, given in calls:
        if name in ("fit_boosted", "grid_search", "isolation_trees", "clustered_profiles", "ablation", "walk_forward", "permutation_importance"):
            assert not given, (name, given)
    assert (clustering.CLUSTERS, clustering.RESTARTS) == (tuple(range(2, 11)), 20)
    assert next(a for name, a, _ in calls if name == "walk_forward")[2] == (1996, 1997, 1998)
    groups = next(a for name, a, _ in calls if name == "ablation")[3]
    assert {c for g in groups.values() for c in g} == set(q.MODEL_FEATURES)
