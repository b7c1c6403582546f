"""The estimator queries run with the study's parameters."""

import inspect

import pytest

import __spark_entry__ as entry
from tallyspark.estimators import kernel, ml
from tallyspark.operators import sequences

DATA = "/root/testdata/sf0.001"


class Called(Exception):
    pass


@pytest.mark.parametrize("query, module, function, want", [
    ("es14_kernel_bootstrap_band", kernel, "weighted_kreg", {"nboot": 200}),
    ("es16_pca_explained_variance", ml, "pca", {"n_ratio": 30}),
    ("es17_es18_boosted_trees_vs_linear", ml, "boosted_trees", {"n_trees": 500, "depth": 6, "rate": 0.05, "subsample": 0.8, "colsample": 0.8}),
    ("ag27_feature_importance_groups", ml, "boosted_trees", {"n_trees": 500, "depth": 6, "rate": 0.05, "subsample": 0.8, "colsample": 0.8}),
    ("wn22_prior_category_mean_kernel", sequences, "kernel_prior_category_means", {"tolerance": 1e-4, "half_life_hours": 3.0}),
])
def test_parameters_of_the_study(spark, monkeypatch, query, module, function, want):
    signature = inspect.signature(getattr(module, function))

    def called(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        raise Called({k: bound.arguments[k] for k in want})

    monkeypatch.setattr(module, function, called)
    with pytest.raises(Called) as e:
        entry.queries()[query](spark, DATA)
    assert e.value.args[0] == want
