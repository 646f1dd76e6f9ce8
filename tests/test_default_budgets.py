"""Registered queries run their operators with the default budgets."""

import inspect

import pytest

from kohorta.plans import queries_models as Q
from kohorta.plans.registry import QUERIES

RUNS = {
    "FS1_rfe": (Q.select, "rfe_path"), "FS2_rfe_stability": (Q.select, "rfe_stability"), "FS3_PD8_rfe_curve": (Q.select, "rfe_curve"),
    "FS5_rf_importance": (Q.select, "rf_importance"), "FS9_select_features": (Q.select, "select_features"),
    "HP1_random_search": (Q.search, "random_search"), "HP2_swarm_search": (Q.search, "swarm_search"),
    "EV1_train_all": (Q.evaluate, "train_all"), "EV4_repeat_executions": (Q.evaluate, "repeat_executions"),
    "EV5_cv_roc": (Q.evaluate, "cv_roc"), "WF_run_study": (Q, "run_study"),
}
BUDGETS = ("trees", "depth", "n", "k", "swarm", "iterations", "n_executions", "params", "leave_one_out_folds", "with_loo", "selection", "training")


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", RUNS)
def test_default_budgets(monkeypatch, name):
    module, operator = RUNS[name]
    sign = inspect.signature(getattr(module, operator))

    def ask(*args, **kwargs):
        raise Asked(sign.bind(*args, **kwargs).arguments)

    monkeypatch.setattr(module, operator, ask)
    for at, part in ((Q, "_xy"), (Q, "_complete"), (Q.models, "training_table"), (Q.B, "cohort"), (Q.B, "wide_vectors")):
        monkeypatch.setattr(at, part, lambda *a: None)
    with pytest.raises(Asked) as asked:
        QUERIES[name](None, "")
    given = asked.value.args[0]
    assert [b for b in BUDGETS if b in given or b in given.get("options", {})] == []
    assert len(given.get("seeds", range(10))) == 10
