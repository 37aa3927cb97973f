"""Row rules over sources: reasons in order, rejected rows beside kept ones, issues counted in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: dict[str, Column]) -> Column:
    """Name of the first rule that a row breaks, null if none; a rule that is null counts as kept."""
    if not rules:
        return F.lit(None).cast("string")
    return reduce(lambda c, r: c.when(F.coalesce(r[1], F.lit(False)), r[0]), list(rules.items())[1:], F.when(F.coalesce(next(iter(rules.values())), F.lit(False)), next(iter(rules))))


def typed(df: DataFrame, columns: dict[str, Column], rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Parsed rows that break no rule, and the others as they came with their reason."""
    marked = df.withColumns(columns).withColumn("reason", first_reason(rules))
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL").select(*df.columns, "reason")


def issues(df: DataFrame, source: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """source, code, severity, n: all rules counted in one aggregation, a row for each rule."""
    counts = df.groupBy(F.col(source).alias("source")).agg(*(F.count_if(c).alias(code) for code, (_, c) in rules.items()))
    listed = F.array(*(F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(code).alias("n")) for code, (severity, _) in rules.items()))
    return counts.select("source", F.explode(listed).alias("x")).select("source", "x.*")


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| by the larger size, which counts as 1 at least."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key how many claims and different values there are, and what that makes of them."""
    held = df.groupBy(*keys).agg(F.count(value).alias("claims"), F.count_distinct(value).alias("kinds"), F.min(value).alias("low"), F.max(value).alias("high"))
    state = F.when(F.col("claims") == 0, "missing").when(F.col("kinds") > 1, "conflict").when(F.col("claims") > 1, "corroborated").otherwise("single")
    return held.withColumn("state", state)
