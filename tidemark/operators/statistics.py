"""Score evaluation, balance of matched samples and other grouped statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .primitives import asof_join


def _numbered_by_bucket(df: DataFrame, order: list[Column], bucket: Column) -> DataFrame:
    """Global ranks in ``order`` without one global sort: positions within buckets plus counts of earlier ones."""
    b = df.withColumn("_b", bucket)
    counts = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return b.withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy(*order))).join(F.broadcast(starts), "_b").withColumn("position", F.col("_start") + F.col("_rn")).drop("_b", "_rn", "_start")


def by_score(scored: DataFrame) -> DataFrame:
    """Labels per distinct score with totals at and above it; ``scored`` has score in [0, 1] and label 0/1."""
    per = scored.groupBy("score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    cell = per.withColumn("cell", F.floor(F.col("score") * 1000))
    sums = cell.groupBy("cell").agg(F.sum("pos").alias("cp"), F.sum("neg").alias("cn"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("cell", F.coalesce(F.sum("cp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("cn").over(above), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return cell.join(F.broadcast(starts), "cell").select("score", "pos", "neg", (F.col("p0") + F.sum("pos").over(inside)).alias("tp"), (F.col("n0") + F.sum("neg").over(inside)).alias("fp"))


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """AUC with ties at one half, average precision over distinct scores, Brier score and log loss."""
    curve = by_score(scored)
    total = scored.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"), F.avg((F.col("score") - F.col("label")) ** 2).alias("brier"), F.avg(-F.log(F.greatest(F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score")), F.lit(1e-15)))).alias("log_loss"))
    joined = curve.crossJoin(F.broadcast(total))  # one row of totals
    out = joined.groupBy("p", "n", "brier", "log_loss").agg(F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("wins"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precisions"))
    return out.select((F.col("wins") / (F.col("p") * F.col("n"))).alias("auc"), (F.col("precisions") / F.col("p")).alias("average_precision"), "brier", "log_loss", F.col("p").alias("positives"), F.col("n").alias("negatives"))


def threshold_at(scored: DataFrame, most_fpr: float) -> DataFrame:
    """The lowest threshold of highest recall whose false positive rate stays within ``most_fpr``."""
    total = scored.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    rates = by_score(scored).crossJoin(F.broadcast(total)).select("score", (F.col("tp") / F.col("p")).alias("recall"), (F.col("fp") / F.col("n")).alias("fpr"))
    return rates.filter(F.col("fpr") <= most_fpr).orderBy(F.desc("recall"), "score").limit(1)


def equal_count_bins(df: DataFrame, value: str, key: str, bins: int) -> DataFrame:
    """Rank-based bins ``floor(r * bins / n) + 1`` in order of value and key."""
    n = df.count()
    cuts = df.stat.approxQuantile(value, [i / 64 for i in range(1, 64)], 0.001)
    bucket = sum((F.col(value) > c).cast("int") for c in dict.fromkeys(cuts)) if cuts else F.lit(0)
    ranked = _numbered_by_bucket(df, [F.col(value), F.col(key)], bucket)
    return ranked.withColumn("bin", F.floor((F.col("position") - 1) * bins / F.lit(n)).cast("int") + 1)


def standardized_difference(df: DataFrame, group: str, covariates: list[str]) -> DataFrame:
    """Per covariate the difference of group means over the pooled deviation; ``group`` is 0 or 1."""
    long = df.select(group, F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in covariates))).alias("e")).select(group, "e.*")
    one, zero = (F.when(F.col(group) == g, F.col("x")) for g in (1, 0))
    out = long.groupBy("covariate").agg(F.avg(one).alias("treated_mean"), F.avg(zero).alias("control_mean"), F.var_samp(one).alias("v1"), F.var_samp(zero).alias("v0"))
    return out.select("covariate", "treated_mean", "control_mean", ((F.col("treated_mean") - F.col("control_mean")) / F.nullif(F.sqrt((F.col("v1") + F.col("v0")) / 2), F.lit(0.0))).alias("smd"))


def within_caliper(treated: DataFrame, controls: DataFrame, keys: list[str], x: str, y: str, caliper: float) -> DataFrame:
    """Pairs of the same ``keys`` whose ``x`` and ``y`` lie at most ``caliper`` apart, with their ``distance``.

    Sides meet in bands as wide as the caliper, a treated row in its own and both beside it, so a key's rows only meet those near them.
    """
    band = lambda c: F.floor(F.col(c) / caliper)
    t = treated.withColumn("_band", F.explode(F.sequence(band(x) - 1, band(x) + 1)))
    return t.join(controls.withColumn("_band", band(y)), [*keys, "_band"]).withColumn("distance", F.abs(F.col(x) - F.col(y))).filter(F.col("distance") <= caliper).drop("_band")


def nearest_within(treated: DataFrame, controls: DataFrame, keys: list[str], x: str, y: str, caliper: float, control: str, k: int, digits: int = 9) -> DataFrame:
    """The ``k`` nearest controls of the same ``keys`` at most ``caliper`` away: rank_in_group, ``control``, distance, and ``pool``, how many there are.

    Distances count as rounded to ``digits``, ties go to the smaller ``control``. No pair is made: controls of one value are one row with
    their first ``k``, each value knows its neighbours and how many controls lie up to it, and a treated value finds its place among
    them by as-of joins. Different values on one side must differ by more than the rounding.
    """
    near = Window.partitionBy(*keys, "_y")
    c = controls.select(*keys, F.col(y).cast("double").alias("_y"), F.col(control).alias("_id")).filter("_y IS NOT NULL AND NOT isnan(_y)")
    c = c.withColumns({"_n": F.count(F.lit(1)).over(near), "_rn": F.row_number().over(near.orderBy("_id"))}).filter(F.col("_rn") <= k)
    c = c.groupBy(*keys, "_y", "_n").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))
    line = Window.partitionBy(*keys).orderBy("_y")  # a row per value
    side = F.struct("_y", "_ids")
    c = c.withColumns({"_below": F.collect_list(side).over(line.rowsBetween(1 - k, 0)), "_above": F.collect_list(side).over(line.rowsBetween(0, k - 1)), "_upto": F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, 0))})
    c = c.withColumn("_before", F.col("_upto") - F.col("_n"))
    known = treated.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    t = known.select(*keys, F.col(x).cast("double").alias("_x")).distinct().withColumns({"_lo": F.col("_x") - caliper, "_hi": F.col("_x") + caliper})
    for at, column, forward in (("_x", "_below", False), ("_x", "_above", True), ("_hi", "_upto", False), ("_lo", "_before", True)):
        t = asof_join(t, c, keys, at, "_y", [column], forward=forward).drop("matched_ts")
    none = F.array().cast(c.schema["_below"].dataType)
    around = F.concat(F.coalesce("_below", none), F.coalesce("_above", none))
    gap = lambda v: F.abs(F.col("_x") - v["_y"])
    found = F.flatten(F.transform(F.filter(around, lambda v: gap(v) <= caliper), lambda v: F.transform(v["_ids"], lambda i: F.struct(F.round(gap(v), digits).alias("r"), i.alias("id"), gap(v).alias("d")))))
    t = t.select(*keys, "_x", (F.col("_upto") - F.col("_before")).alias("pool"), F.slice(F.sort_array(F.array_distinct(found)), 1, k).alias("_found")).filter(F.size("_found") > 0)
    met = known.withColumn("_x", F.col(x).cast("double")).join(t, [*keys, "_x"]).select(*treated.columns, "pool", F.posexplode("_found").alias("_p", "_f"))
    return met.select(*treated.columns, "pool", (F.col("_p") + 1).alias("rank_in_group"), F.col("_f.id").alias(control), F.col("_f.d").alias("distance"))


def robust_scale(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and 1.4826 MAD per group, else the sample deviation where the MAD is zero."""
    mid = df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"), F.stddev_samp(value).alias("std"))
    gaps = df.join(mid, keys).withColumn("gap", F.abs(F.col(value) - F.col("median")))
    mad = gaps.groupBy(*keys).agg(F.percentile("gap", 0.5).alias("mad"), F.first("median").alias("median"), F.first("std").alias("std"))
    return mad.select(*keys, "median", F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("std") > 0, F.col("std")).alias("scale"))


def tiered_cost(df: DataFrame, n: str, tiers: list[tuple[float, float | None, float]]) -> Column:
    """Progressive price: each tier's rate for the part of ``n`` inside it."""
    parts = [F.greatest(F.least(F.col(n), F.lit(hi) if hi is not None else F.col(n)) - lo, F.lit(0.0)) * rate for lo, hi, rate in tiers]
    return sum(parts[1:], parts[0])


def time_split_logistic(df: DataFrame, ts: str, cut: str, features: list[str], keys: list[str]) -> DataFrame:
    """Scores of rows at or after ``cut`` by a standardised, regularised logistic regression on rows before."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    early = F.col(ts) < F.lit(cut).cast("timestamp_ntz")
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), LogisticRegression(featuresCol="_x", labelCol="label", regParam=0.01)]).fit(df.filter(early))
    return model.transform(df.filter(~early)).select(*keys, "label", vector_to_array("probability")[1].alias("score"))
