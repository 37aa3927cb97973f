"""Texts cut into prefix, middle and suffix at random units, and put together so that the middle comes last.

A unit is a match of a pattern, from left to right; by default one code point. Units are rows: each text's
matches of up to ``block`` units are exploded with their place, a window sums the units and characters
before them, and the requests for cuts meet the block that holds the unit of their number. The same is done
once more for the units of those blocks alone, so a text makes about ``n / block + 2 * block`` rows. The
offsets are gathered per document and the text is cut by ``substring``. All of this shares one shuffle of
the rows, by a number that each row gets; no step gathers more than a text.

Defined cases: null texts count as empty; empty texts and texts that hold a marker stay plain. A pattern whose
matches don't cover a text from end to end raises. Rows that share an id are cut alike and apart; a null id
is drawn as an empty one. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = "(?s)."
#: Units in a block: rows of a text are fewest near the root of half its units.
BLOCK = 64


def draws(id_column: Column, seed: str = "1") -> list[Column]:
    """Four whole numbers of 32 bits that depend on the id and the seed alone."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(F.concat(parts[1], parts[3], parts[2]))


def _sums(units: DataFrame, keys: list[str]) -> DataFrame:
    """Characters and units before each row of a run, in order of its place."""
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("chars_before", F.coalesce(F.sum("chars").over(before), F.lit(0))).withColumn("units_before", F.coalesce(F.sum("units").over(before), F.lit(0)))


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, plain_share: int = 10, spm_share: int = 20, seed: str = "1", block: int = BLOCK) -> DataFrame:
    """``id_col``, text, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output: a row per row.

    ``plain_share`` of a hundred documents stay plain, ``spm_share`` of a hundred others put the suffix first.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartition("row")
    flags, body = unit[: unit.index(")") + 1] if unit.startswith("(?s)") else "", unit.removeprefix("(?s)")
    # every branch below reads the id as well, so that all of them share the one shuffle
    blocks = rows.select("row", "id", F.posexplode(F.regexp_extract_all("text", F.lit(f"{flags}(?:(?>{body})){{1,{block}}}+"), F.lit(0))).alias("pos", "held"))
    more = F.lead("pos").over(Window.partitionBy("row").orderBy("pos")).isNotNull()  # all but the last are full
    blocks = blocks.select("*", F.length("held").cast("long").alias("chars"), F.when(more, F.lit(block)).otherwise(F.regexp_count("held", F.lit(unit))).cast("long").alias("units"))
    blocks = _sums(blocks, ["row"])
    totals = blocks.groupBy("row", "id").agg(F.sum("units").alias("n"), F.sum("chars").alias("covered"))
    h = draws(F.col("id"), seed)
    cuts = [F.pmod(x, F.col("n") + 1) for x in h[:2]]
    asked = totals.select("row", "n", "covered", F.posexplode(F.array(F.least(*cuts), F.greatest(*cuts))).alias("which", "cut"))
    # a cut behind the last unit belongs to no unit: its offset is the length of the text
    met = asked.alias("a").join(blocks.alias("b"), F.expr("a.row = b.row AND a.cut >= b.units_before AND a.cut < b.units_before + b.units"), "left")
    met = met.select("a.row", "b.id", "a.n", "a.covered", "a.which", F.expr("a.cut - b.units_before").alias("ordinal"), F.col("b.chars_before").alias("start"), "b.held")
    one = F.posexplode_outer(F.regexp_extract_all("held", F.lit(unit), F.lit(0))).alias("pos", "match")
    units = met.select("row", "id", "n", "covered", "which", "ordinal", "start", one).select("*", F.length("match").cast("long").alias("chars"), F.lit(1).cast("long").alias("units"))
    units = _sums(units, ["row", "which"]).filter("ordinal IS NULL OR units_before = ordinal")
    offset = F.coalesce(F.col("start") + F.col("chars_before"), F.col("covered"))
    offsets = units.groupBy("row").agg(F.max("id").alias("_id"), F.max("n").alias("n"), F.max("covered").alias("covered"), *(F.max(F.when(F.col("which") == k, offset)).alias(name) for k, name in enumerate("ab")))
    found = rows.join(offsets, "row", "left").withColumns({"id": F.coalesce("_id", "id"), "n": F.coalesce("n", F.lit(0))})
    whole = F.coalesce(F.col("covered"), F.lit(0)) == F.length("text")
    text = F.when(whole, F.col("text")).otherwise(F.raise_error(F.lit("the pattern's matches don't cover a text")).cast("string"))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("n") == 0) | marked | (h[2] % 100 >= 100 - plain_share), "plain").when(h[3] % 100 < spm_share, "spm").otherwise("psm")
    cut = found.select("id", text.alias("text"), "n", "a", "b", form.alias("form"))
    prefix, middle, suffix = F.expr("substring(text, 1, int(a))"), F.expr("substring(text, int(a) + 1, int(b - a))"), F.expr("substring(text, int(b) + 1)")
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", spm).otherwise(psm)
    kept = lambda c: F.when(F.col("form") != "plain", c)
    return cut.select(F.col("id").alias(id_col), "text", "n", "form", kept(F.col("a")).alias("prefix_chars"), kept(F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))
