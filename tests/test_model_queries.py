"""Model queries fit with the operators' defaults, over all tabular features and the whole grid."""

import pytest

from workloads import report_queries as Q


@pytest.mark.parametrize(
    ("name", "fits"),
    [
        ("tree_scores", ["fit_trees"]),
        ("network_scores", ["fit_network"]),
        ("model_comparison", ["fit_logistic", "fit_trees"]),
        ("model_search", ["search_trees"]),
        ("tree_importance", ["fit_trees"]),
        ("single_feature_models", ["audit_single_features"]),
    ],
)
def test_defaults(monkeypatch, name, fits):
    class Anything:
        def __getattr__(self, _):
            return lambda *args, **kwargs: self

        def __iter__(self):
            return iter([self] * 3)

    calls = []

    def record(function):
        def fit(*args, **kwargs):
            calls.append((function, [a for a in args if isinstance(a, list)], kwargs))
            return Anything()

        return fit

    monkeypatch.setattr(Q, "_modelling_rows", lambda t: (Anything(), Anything()))
    for function in ("fit_trees", "fit_network", "fit_logistic", "search_trees", "audit_single_features"):
        monkeypatch.setattr(Q.M, function, record(function))
    for function in ("score", "compare_models", "feature_importance"):
        monkeypatch.setattr(Q.M, function, lambda *args, **kwargs: Anything())
    getattr(Q, name)(None)
    assert len(Q._MODEL_FEATURES) == 31
    assert calls == [(function, [Q._MODEL_FEATURES], {}) for function in fits]
