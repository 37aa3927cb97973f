"""Folds, out-of-fold scores, calibration and the challenger's guardrails."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import modelling


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(6)
    out = []
    for k in range(700):
        x, z = r.gauss(0, 1), r.gauss(0, 1)
        label = int(r.random() < 1 / (1 + math.exp(-(1.6 * x - 0.3))))
        graph = label * 1.5 + r.gauss(0, 1)
        out.append((k, f"g{k % 60}" if k % 50 else None, 2010 + k % 8, x if k % 11 else None, z if k % 13 else float("nan"), graph, None, label))
    return spark.createDataFrame(out, "id int, g string, year int, x double, z double, graph double, never double, label int").persist()


def test_no_group_is_in_two_folds(rows):
    prepared = modelling.matrix(rows, ["x"], "label", "g", folds=4, seed=17)
    groups = {}
    for r in prepared.select("g", "fold").collect():
        assert groups.setdefault(r.g, r.fold) == r.fold
    audit = {r.fold: r for r in modelling.fold_audit(prepared, "g", "_label", 4).collect()}
    for fold, a in audit.items():
        own = [g for g, f in groups.items() if f == fold]
        assert a.group_overlap == 0 and a.validation_groups == len(own) and a.train_groups == len(groups) - len(own) and a.train_rows + a.validation_rows == 700
    torn = prepared.withColumn("fold", F.col("id") % 4)
    with pytest.raises(modelling.NotTrainable):
        modelling.out_of_fold(torn, ["x"], "g", folds=4, rounds=1)
    with pytest.raises(modelling.NotTrainable):
        modelling.out_of_fold(prepared.withColumn("_label", F.lit(1.0)), ["x"], "g", folds=4, rounds=1)


def test_calibration_is_the_likeliest_curve(spark):
    r = random.Random(3)
    pairs = [(s, int(r.random() < 1 / (1 + math.exp(-(3 * s - 2))))) for s in (round(r.random(), 2) for _ in range(900))]
    a, b = modelling.platt(spark.createDataFrame(pairs, "s double, y int"), "s", "y")
    s, y = np.array(pairs).T
    w = np.zeros(2)
    x = np.stack([np.ones_like(s), s], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    assert abs(a - w[0]) < 1e-4 and abs(b - w[1]) < 1e-4
    brier = lambda q: float(np.mean((q - y) ** 2))
    assert brier(1 / (1 + np.exp(-(a + b * s)))) < brier(s)
    for bad in ([(0.5, 1), (0.2, 1)], [], [(0.5, 1), (0.5, 0)]):
        try:
            curve = modelling.platt(spark.createDataFrame(bad, "s double, y int"), "s", "y")
            assert abs(sum(c * v for c, v in zip(curve, (1, 0.5)))) < 1e-6  # equal scores: even odds
        except modelling.NotTrainable:
            pass


def test_challenger_gains_by_what_it_adds(rows):
    early = rows.filter("year < 2016")
    champion = modelling.train_candidate(early, ["x", "z", "never"], "label", "g", folds=3, rounds=2)
    assert champion.threshold <= 1 and champion.coefficients()["x"] > 0.3 and abs(champion.coefficients()["z"]) < champion.coefficients()["x"] and champion.coefficients()["never"] == 0
    out = modelling.challenge(rows, champion, ["graph"], "label", "g", "year", 2016, folds=3, rounds=2)
    m = out["metrics"]
    assert out["challenger"].features == ("x", "z", "never", "graph") and m["challenger"]["average_precision"] > m["champion"]["average_precision"] + 0.02
    assert abs(m["ablation"]["average_precision"] - m["champion"]["average_precision"]) < 0.05 and out["decision"]["checks"]["ablation_gain"] and out["decision"]["checks"]["brier_guardrail"]
    assert out["unseen"]["champion"]["average_precision"] is None and not out["decision"]["eligible"] and "failed:unseen_groups_not_worse" in out["decision"]["reasons"]


def test_guardrails():
    base = {"average_precision": 0.5, "false_positive_rate": 0.02, "brier": 0.2}
    good = {"average_precision": 0.6, "false_positive_rate": 0.03, "brier": 0.205}
    assert modelling.promotion(base, good, base, base, good)["eligible"]
    assert modelling.promotion(base, good, base, base, good, synthetic=True)["reasons"] == ["blocked:synthetic"]
    assert modelling.promotion(base, good | {"false_positive_rate": 0.031}, base, base, good)["reasons"] == ["failed:false_alert_guardrail"]
    assert modelling.promotion(base, good, good, base, good)["reasons"] == ["failed:ablation_gain"]
    none = dict.fromkeys(base)
    assert modelling.promotion(base, none, base, base, none)["reasons"] == [f"failed:{n}" for n in ("temporal_ap_gain", "ablation_gain", "false_alert_guardrail", "brier_guardrail", "unseen_groups_not_worse")]
