"""Grouped out-of-fold scores, calibration, and a challenger held against the champion.

One design matrix is prepared and cached; every fold is a filter on it, so a group's rows are all in one fold and
no fold is written twice. Fits are ``pyspark.ml`` estimators over the executors; the driver holds
coefficients, thresholds and one row of sums per step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import checkpoints, cut
from .statistics import ranking_metrics, threshold_at

#: Share of L1 and inverse strength of the linear model; depth, rounds and step of the boosted one.
L1_SHARE, INVERSE_STRENGTH, DEPTH, ROUNDS, STEP = 0.25, 0.5, 3, 160, 0.05
#: Folds that are fitted at the same time.
FITS = 4
#: What a challenger must gain, and what it may lose.
GUARDRAILS = {"target_fpr": 0.05, "min_ap_gain": 0.02, "min_ablation_gain": 0.01, "max_fpr_increase": 0.01, "max_brier_increase": 0.01}


class NotTrainable(ValueError):
    """Too few groups, a fold or table with one class only, or a calibration that doesn't settle."""


def fold_of(group: Column, folds: int, seed: int) -> Column:
    """The fold of a group, from 0: a hash, so that it needs no table of groups; null groups are one group."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(group.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def fold_audit(df: DataFrame, group: str, label: str, folds: int) -> DataFrame:
    """Rows and groups on either side of each fold, and its labels; ``df`` has the fold. Groups in several folds count as overlap."""
    per = df.groupBy(group, "fold").agg(F.count(F.lit(1)).alias("rows"), F.sum(label).cast("long").alias("pos"))
    several = per.groupBy(group).agg(F.count(F.lit(1)).alias("in_folds"))
    own = per.join(several, per[group].eqNullSafe(several[group])).groupBy("fold").agg(F.sum("rows").alias("validation_rows"), F.count(F.lit(1)).alias("validation_groups"), F.sum("pos").alias("validation_positives"), F.count_if(F.col("in_folds") > 1).alias("group_overlap"))
    total = per.agg(F.sum("rows").alias("all_rows"), F.count(F.lit(1)).alias("all_groups"))
    return own.crossJoin(F.broadcast(total)).select(  # one row of totals
        "fold", (F.col("all_rows") - F.col("validation_rows")).alias("train_rows"), "validation_rows", (F.col("all_groups") - F.col("validation_groups")).alias("train_groups"), "validation_groups", "group_overlap",
        "validation_positives", (F.col("validation_rows") - F.col("validation_positives")).alias("validation_negatives"))


def _stages(features: Sequence[str], rows: int, rounds: int, seed: int) -> tuple[Pipeline, Pipeline]:
    filled, missing = [f"_{f}_filled" for f in features], [f"_{f}_missing" for f in features]
    common = [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=[*filled, *missing], outputCol="_raw")]
    linear = LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_weight", elasticNetParam=L1_SHARE, regParam=1 / (INVERSE_STRENGTH * max(rows, 1)), maxIter=200, tol=1e-9, standardization=False, probabilityCol="_p", rawPredictionCol="_q", predictionCol="_y")
    boosted = GBTClassifier(featuresCol="_raw", labelCol="_label", weightCol="_weight", maxDepth=DEPTH, maxIter=rounds, stepSize=STEP, seed=seed, predictionCol="_y").setProbabilityCol("_p").setRawPredictionCol("_q")
    return Pipeline(stages=[*common, StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), linear]), Pipeline(stages=[*common, boosted])


def matrix(df: DataFrame, features: Sequence[str], label: str, group: str, *, folds: int, seed: int) -> DataFrame:
    """``df`` with its fold, finite features or nulls, and a column per feature that says whether it is missing."""
    finite = lambda f: F.when(~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) < float("inf")), F.col(f).cast("double"))
    out = df.withColumns({f: finite(f) for f in features}).withColumns({f"_{f}_missing": F.col(f).isNull().cast("double") for f in features})
    return out.withColumns({"_label": F.col(label).cast("double"), "fold": fold_of(F.col(group), folds, seed)})


def _fit(rows: DataFrame, features: Sequence[str], rounds: int, seed: int) -> tuple[PipelineModel, PipelineModel]:
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_label").alias("pos"), *(F.count(f).alias(f) for f in features)).first()
    if not counts.n or not 0 < counts.pos < counts.n:
        raise NotTrainable("both classes are needed to train")
    empty = [f for f in features if not counts[f]]
    weight = F.when(F.col("_label") == 1, counts.n / (2 * counts.pos)).otherwise(counts.n / (2 * (counts.n - counts.pos)))
    given = rows.withColumns({"_weight": weight, **{f: F.lit(0.0) for f in empty}})
    linear, boosted = _stages(features, counts.n, rounds, seed)
    return linear.fit(given), boosted.fit(given)


def _blend(rows: DataFrame, models: tuple[PipelineModel, PipelineModel]) -> DataFrame:
    """``rows`` with elastic, boosted and their mean, raw."""
    kept = rows.columns
    one = models[0].transform(rows).select(*kept, vector_to_array("_p")[1].alias("elastic"))
    two = models[1].transform(one).select(*kept, "elastic", vector_to_array("_p")[1].alias("boosted"))
    return two.withColumn("raw", (F.col("elastic") + F.col("boosted")) / 2)


def out_of_fold(prepared: DataFrame, features: Sequence[str], group: str, *, folds: int, seed: int = 17, rounds: int = ROUNDS) -> DataFrame:
    """Each row scored by models that saw no row of its group; ``prepared`` comes from ``matrix``."""
    audit = fold_audit(prepared, group, "_label", folds).collect()  # one row per fold
    if len(audit) < 2:
        raise NotTrainable("at least two folds with rows are needed")
    for a in audit:
        if a.group_overlap:
            raise NotTrainable(f"groups of fold {a.fold} are in other folds too")
        if not 0 < a.validation_positives < a.validation_rows:
            raise NotTrainable(f"fold {a.fold} lacks a class")
    checkpoints(prepared.sparkSession)  # boosting writes every tenth round there, else each round carries the plans of all before
    fits = [inheritable_thread_target(prepared.sparkSession)(lambda a=a: _fit(prepared.filter(F.col("fold") != a.fold), features, rounds, seed + 1 + a.fold)) for a in audit]
    with ThreadPool(min(FITS, len(fits))) as pool:  # a fit is many short jobs, one after the other
        models = pool.map(lambda fit: fit(), fits, chunksize=1)
    scored = [_blend(prepared.filter(F.col("fold") == a.fold), m) for a, m in zip(audit, models)]
    out = scored[0]
    for more in scored[1:]:
        out = out.unionByName(more)
    return out


def platt(scored: DataFrame, score: str, label: str, *, ridge: float = 1e-6, steps: int = 50) -> tuple[float, float]:
    """Intercept and slope of a logistic curve through the scores, by Newton's method over sums per distinct score."""
    counts = cut(scored.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count(F.lit(1)).alias("n")))
    totals = counts.agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).first()
    if not totals.n or not 0 < totals.pos < totals.n:
        raise NotTrainable("both classes are needed to calibrate")
    a = b = 0.0
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("s"))))
        gap, spread = F.col("pos") - F.col("n") * p, F.col("n") * p * (1 - p)
        g0, g1, h00, h01, h11 = counts.agg(*(F.sum(x) for x in (gap, gap * F.col("s"), spread, spread * F.col("s"), spread * F.col("s") * F.col("s")))).first()
        g1, h11 = g1 - ridge * b, h11 + ridge
        det = h00 * h11 - h01 * h01
        if not det > 0 or not math.isfinite(det):
            raise NotTrainable("the scores don't determine a curve")
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < 1e-10 * (1 + abs(a) + abs(b)):
            return a, b
    raise NotTrainable(f"calibration didn't settle in {steps} steps")


def calibrated(score: Column, curve: tuple[float, float]) -> Column:
    return 1 / (1 + F.exp(-(F.lit(curve[0]) + F.lit(curve[1]) * score)))


@dataclass(frozen=True)
class Candidate:
    """A trained pair of models with their calibration and threshold."""

    features: tuple[str, ...]
    models: tuple[PipelineModel, PipelineModel]
    curve: tuple[float, float]
    threshold: float

    def score(self, prepared: DataFrame) -> DataFrame:
        return _blend(prepared, self.models).withColumn("score", calibrated(F.col("raw"), self.curve))

    def coefficients(self) -> dict[str, float]:
        names = [*self.features, *(f"{f} missing" for f in self.features)]
        return dict(zip(names, self.models[0].stages[-1].coefficients.toArray().tolist(), strict=True))


def train_candidate(df: DataFrame, features: Sequence[str], label: str, group: str, *, folds: int = 4, seed: int = 17, most_fpr: float = 0.05, rounds: int = ROUNDS) -> Candidate:
    """Calibrated and thresholded on out-of-fold scores, then fitted on all rows."""
    prepared = matrix(df, features, label, group, folds=folds, seed=seed).persist()
    try:
        oof = out_of_fold(prepared, features, group, folds=folds, seed=seed, rounds=rounds).select("raw", "_label").persist()
        curve = platt(oof, "raw", "_label")
        scored = oof.select(calibrated(F.col("raw"), curve).alias("score"), F.col("_label").cast("long").alias("label"))
        best = threshold_at(scored, most_fpr).first()
        oof.unpersist()
        return Candidate(tuple(features), _fit(prepared, features, rounds, seed + 1000), curve, best.score if best else math.inf)
    finally:
        prepared.unpersist()


def held_out(candidate: Candidate, df: DataFrame, label: str, group: str, *, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, the group, label and score of rows that the candidate wasn't trained on."""
    prepared = matrix(df, candidate.features, label, group, folds=1, seed=0)
    return candidate.score(prepared).select(*keep, F.col(group).alias("group"), F.col("_label").cast("long").alias("label"), "score")


def evaluated(scored: DataFrame, threshold: float) -> dict[str, float | None]:
    """Ranking metrics, Brier score and the false positive rate at a threshold; None where a class is missing."""
    flags = scored.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"), F.count_if((F.col("score") >= threshold) & (F.col("label") == 0)).alias("fp"), F.count_if((F.col("score") >= threshold) & (F.col("label") == 1)).alias("tp")).first()
    empty = {"n": flags.n, "average_precision": None, "auc": None, "brier": None, "false_positive_rate": None, "recall": None}
    if not flags.n or not 0 < flags.pos < flags.n:
        return empty
    m = ranking_metrics(scored.select("score", "label")).first()
    return empty | {"average_precision": m.average_precision, "auc": m.auc, "brier": m.brier, "false_positive_rate": flags.fp / (flags.n - flags.pos), "recall": flags.tp / flags.pos}


def promotion(champion: dict, challenger: dict, ablation: dict, champion_unseen: dict, challenger_unseen: dict, *, synthetic: bool = False, guardrails: dict[str, float] | None = None) -> dict:
    """Which of the five guardrails hold, and whether a person may be asked to promote; nothing is promoted here."""
    g = GUARDRAILS | (guardrails or {})
    above = lambda a, b, gain: a is not None and b is not None and a >= b + gain
    most_fpr = min(g["target_fpr"], (champion["false_positive_rate"] or 0.0) + g["max_fpr_increase"])
    checks = {
        "temporal_ap_gain": above(challenger["average_precision"], champion["average_precision"], g["min_ap_gain"]),
        "ablation_gain": above(challenger["average_precision"], ablation["average_precision"], g["min_ablation_gain"]),
        "false_alert_guardrail": challenger["false_positive_rate"] is not None and challenger["false_positive_rate"] <= most_fpr + 1e-12,
        "brier_guardrail": challenger["brier"] is not None and champion["brier"] is not None and challenger["brier"] <= champion["brier"] + g["max_brier_increase"],
        "unseen_groups_not_worse": above(challenger_unseen["average_precision"], champion_unseen["average_precision"], -1e-12),
    }
    reasons = [f"failed:{name}" for name, ok in checks.items() if not ok] + (["blocked:synthetic"] if synthetic else [])
    return {"eligible": not reasons, "checks": checks, "most_fpr": most_fpr, "reasons": reasons or ["eligible_for_human_review_only"]}


def challenge(df: DataFrame, champion: Candidate, more: Sequence[str], label: str, group: str, time: str, since, *, folds: int = 4, seed: int = 29, most_fpr: float = 0.05, rounds: int = ROUNDS, synthetic: bool = False) -> dict:
    """Train a challenger on the champion's features and ``more``, and one on the champion's alone, before ``since``; judge all three on the rest."""
    early, late = df.filter(F.col(time) < F.lit(since)), df.filter(F.col(time) >= F.lit(since)).persist()
    fitted = lambda features, s: train_candidate(early, features, label, group, folds=folds, seed=s, most_fpr=most_fpr, rounds=rounds)
    challenger, ablation = fitted([*champion.features, *more], seed), fitted(champion.features, seed + 77)
    seen = early.select(F.col(group).alias("group")).distinct()
    held = {name: held_out(c, late, label, group).persist() for name, c in (("champion", champion), ("challenger", challenger), ("ablation", ablation))}
    of = {"champion": champion, "challenger": challenger, "ablation": ablation}
    metrics = {name: evaluated(scored, of[name].threshold) for name, scored in held.items()}
    unseen = {name: evaluated(held[name].join(seen, "group", "left_anti"), of[name].threshold) for name in ("champion", "challenger")}
    decision = promotion(metrics["champion"], metrics["challenger"], metrics["ablation"], unseen["champion"], unseen["challenger"], synthetic=synthetic, guardrails={"target_fpr": most_fpr})
    for scored in (late, *held.values()):
        scored.unpersist()
    return {"challenger": challenger, "ablation": ablation, "metrics": metrics, "unseen": unseen, "decision": decision}
