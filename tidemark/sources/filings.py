"""Filings and exchange references: nested JSON, parallel arrays, positional lines and archives, with quarantine."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import RejectedInput

#: Where a facts file keeps share counts, and the form of their day.
SHARES = "$.facts.dei.EntityCommonStockSharesOutstanding.units.shares"
DAY = r"^\d{4}-\d{2}-\d{2}$"
#: Characters (from 1, with their number) of a listing line, its least length, and the exchange's own code.
MASTER = {"symbol": (27, 15), "exchange": (157, 2), "shares": (178, 10)}
MASTER_LENGTH, OWN_EXCHANGE = 187, "00"
#: Places (from 0) in a headerless fundamentals row, and how many it has at least.
FUNDAMENTAL, FUNDAMENTAL_FIELDS = {"effective": 0, "symbol": 2, "shares": 16, "shares_date": 17}, 18


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, BOOLEAN, ... of a variant, VOID for JSON's null; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def share_facts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Share counts in facts files (path, text), with ``reason`` null for those that count.

    ``symbols`` has cik, historical_symbol, effective_from, effective_to (null or blank ends are open); of several
    that hold the fact's day the one that began last is taken. Reasons: container (a level that isn't what it should be; one row for the
    file), observation (no object), value (not a positive whole number), dates (no calendar days, or filed before the fact),
    no_symbol. A missing concept gives no rows. Facts count from the end of their filing day in New York.
    """
    v = F.try_parse_json("text")
    steps = SHARES.split(".")
    at = lambda k: F.try_variant_get("v", ".".join(steps[: k + 1]), "variant")
    levels = [_kind(F.col("v")), *(_kind(at(k)) for k in range(1, len(steps)))]
    wrong = F.lit(False) | F.col("v").isNull() | (levels[0] != "OBJECT")
    for kind in levels[1:-1]:
        wrong = wrong | F.coalesce(kind != "OBJECT", F.lit(False))
    wrong = wrong | F.coalesce(levels[-1] != "ARRAY", F.lit(False))
    # where the list can be read, all levels above it are objects; kinds are asked for only where it can't
    listed = files.select("path", v.alias("v")).select("path", "v", F.try_variant_get("v", SHARES, "array<variant>").alias("rows"))
    held = listed.select("path", "v", "rows", F.when(F.col("rows").isNotNull(), False).otherwise(F.coalesce(wrong, F.lit(True))).alias("bad"))
    digits = F.regexp_replace(F.coalesce(F.try_variant_get("v", "$.cik", "string"), F.lit("")), r"\D", "")
    cik = F.when(digits != "", F.lpad(digits, 10, "0"))
    rows = F.when(F.col("bad"), F.array(F.lit(None).cast("variant"))).otherwise(F.col("rows"))
    one = held.select("path", "bad", cik.alias("cik"), F.explode(rows).alias("o"))
    get = lambda name: F.coalesce(F.try_variant_get("o", f"$.{name}", "string"), F.lit(""))
    valued = one.select("path", "bad", "cik", "o", F.try_variant_get("o", "$.val", "variant").alias("val_v"))
    kind = F.when(F.col("val_v").isNotNull(), "OBJECT").otherwise(_kind(F.col("o")))
    o = valued.select("path", "bad", "cik", kind.alias("kind"), _kind(F.col("val_v")).alias("val_kind"), get("val").alias("val"), get("end").alias("end"), get("filed").alias("filed"), get("form").alias("form"), get("accn").alias("accession"))
    number = F.col("val").try_cast("decimal(38,9)")
    day = lambda c: F.when(F.col(c).rlike(DAY), F.try_to_date(F.col(c), "yyyy-MM-dd"))
    fact, filed = day("end"), day("filed")
    ok_value = (F.col("val_kind") != "BOOLEAN") & (number > 0) & (number == F.floor(number))
    ok_dates = fact.isNotNull() & filed.isNotNull() & (filed >= fact)
    reason = F.when(F.col("bad"), "container").when(F.coalesce(F.col("kind") != "OBJECT", F.lit(True)), "observation").when(~F.coalesce(ok_value, F.lit(False)), "value").when(~F.coalesce(ok_dates, F.lit(False)), "dates")
    o = o.select("path", "cik", fact.alias("fact_date"), filed.alias("filed"), F.col("val").alias("shares_outstanding"), "form", "accession", reason.alias("reason")).withColumn("_n", F.monotonically_increasing_id())
    blank = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other)).try_cast("date")
    m = symbols.select(F.lpad(F.regexp_replace("cik", r"\D", ""), 10, "0").alias("_cik"), blank("effective_from", "0001-01-01").alias("_from"), blank("effective_to", "9999-12-31").alias("_to"), F.nullif(F.trim("historical_symbol"), F.lit("")).alias("_symbol")).filter("_symbol IS NOT NULL")
    spans = m.groupBy("_cik").agg(F.collect_list(F.struct("_from", "_to", "_symbol")).alias("_spans"))  # one company's names
    inside = F.filter("_spans", lambda s: F.col("reason").isNull() & F.col("fact_date").between(s["_from"], s["_to"]))
    named = o.join(spans, F.col("cik") == F.col("_cik"), "left").withColumn("_s", F.array_max(F.transform(inside, lambda s: F.struct(s["_from"], s["_symbol"]))))
    available = F.to_utc_timestamp(F.concat_ws(" ", F.col("filed").cast("string"), F.lit("23:59:59")).try_cast("timestamp"), "America/New_York")
    out = named.select("path", "cik", F.col("_s._symbol").alias("historical_symbol"), "fact_date", F.when(F.col("reason").isNull(), available).alias("available_at"), "shares_outstanding", "form", "accession", F.coalesce("reason", F.when(F.col("_s._symbol").isNull(), "no_symbol")).alias("reason"), "_n")
    # exact repeats are one fact; amendments differ in their accession or in when they were filed; rejects keep their number, so that each stays
    numbered = out.withColumn("_n", F.when(F.col("reason").isNotNull(), F.col("_n")))
    return numbered.dropDuplicates(["historical_symbol", "fact_date", "available_at", "shares_outstanding", "accession", "reason", "_n"]).drop("_n")


def recent_filings(files: DataFrame) -> DataFrame:
    """path, accession_number, filing_date, form: parallel arrays of a submissions file as rows.

    Arrays stand under filings.recent, or at the top where there are no filings; the shortest one
    ends the rows, and those without an accession number are left out.
    """
    v = files.select("path", F.try_parse_json("text").alias("v"))
    nested = F.try_variant_get("v", "$.filings", "variant").isNotNull()
    array = lambda name: F.coalesce(F.try_variant_get("v", f"$.filings.recent.{name}", "array<string>"), F.when(~nested, F.try_variant_get("v", f"$.{name}", "array<string>")), F.array().cast("array<string>")).alias(name)
    a = v.select("path", *(array(n) for n in ("accessionNumber", "filingDate", "form")))
    n = F.least(F.size("accessionNumber"), F.size("filingDate"), F.size("form"))
    rows = a.select("path", F.explode(F.arrays_zip(*(F.slice(c, F.lit(1), n).alias(c) for c in ("accessionNumber", "filingDate", "form")))).alias("r"))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return rows.select("path", text("r.accessionNumber").alias("accession_number"), F.substring(text("r.filingDate"), 1, 10).alias("filing_date"), F.upper(text("r.form")).alias("form")).filter("accession_number <> ''")


def holdings(positions: DataFrame, submissions: DataFrame, forms: tuple[str, ...] = ("13F-HR",)) -> DataFrame:
    """accession, cusip, shares: whole shares held by filing and security, of filings with one of ``forms``.

    ``positions`` are texts ACCESSION_NUMBER, CUSIP, SSHPRNAMT, SSHPRNAMTTYPE, PUTCALL; only shares count (type SH, no option).
    """
    filed = submissions.filter(F.upper(F.trim("SUBMISSIONTYPE")).isin(*forms)).select(F.trim("ACCESSION_NUMBER").alias("accession")).distinct()
    own = positions.filter((F.upper(F.trim("SSHPRNAMTTYPE")) == "SH") & (F.coalesce(F.trim("PUTCALL"), F.lit("")) == ""))
    rows = own.select(F.trim("ACCESSION_NUMBER").alias("accession"), F.upper(F.trim("CUSIP")).alias("cusip"), F.trim("SSHPRNAMT").try_cast("long").alias("n")).filter("n IS NOT NULL AND cusip <> ''")
    return rows.join(filed, "accession", "left_semi").groupBy("accession", "cusip").agg(F.sum("n").alias("shares"))


def master_lines(spark: SparkSession, path: str) -> DataFrame:
    """symbol, shares, reason: positional listing lines. Shorter lines are no listings; reasons: exchange, shares, several."""
    line = spark.read.text(path).filter(F.length("value") >= MASTER_LENGTH)
    part = {n: F.trim(F.substring("value", *at)) for n, at in MASTER.items()}
    rows = line.select(F.upper(part["symbol"]).alias("symbol"), part["exchange"].alias("exchange"), F.regexp_replace(part["shares"], ",", "").alias("shares")).filter("symbol <> ''")
    several = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    number = F.when(F.col("shares").rlike(r"^\d+$"), F.col("shares").try_cast("long"))
    reason = F.when(F.col("exchange") != OWN_EXCHANGE, "exchange").when(~F.coalesce(number > 0, F.lit(False)), "shares").when(F.col("n") > 1, "several")
    return rows.join(several, "symbol").select("symbol", F.when(reason.isNull(), number).alias("shares"), reason.alias("reason"))


def fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """symbol, shares, fact_date, available_at, reason: headerless rows by place. Reasons: effective, shares, shares_date, several."""
    fields = F.transform(F.split(F.col("value"), r"\|", -1), lambda x: F.trim(x))
    rows = spark.read.text(path).select(fields.alias("f")).filter((F.size("f") >= FUNDAMENTAL_FIELDS) & (F.lower(F.col("f")[0]) != "effective date"))
    f = rows.select(*(F.col("f")[k].alias(n) for n, k in FUNDAMENTAL.items())).withColumns({"symbol": F.upper("symbol"), "shares": F.regexp_replace("shares", ",", "")})
    several = f.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    effective = F.coalesce(*(F.when(F.col("effective").rlike(shape), F.try_to_timestamp("effective", F.lit(form))) for shape, form in ((r"^\d+/\d+/\d{4} \d+:\d{2}$", "M/d/yyyy H:mm"), (r"^\d+/\d+/\d{4} \d+:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"))))
    number = F.when(F.col("shares").rlike(r"^\d+$"), F.col("shares").try_cast("long"))
    dated = F.when(F.col("shares_date").rlike(r"^\d+/\d+/\d{4}$"), F.try_to_date(F.col("shares_date"), "M/d/yyyy"))
    reason = F.when(effective.isNull(), "effective").when(~F.coalesce(number > 0, F.lit(False)), "shares").when(dated.isNull(), "shares_date").when(F.col("n") > 1, "several")
    ok = lambda c: F.when(reason.isNull(), c)
    return f.join(several, "symbol").select("symbol", ok(number).alias("shares"), ok(dated).alias("fact_date"), ok(F.to_utc_timestamp(effective, "America/New_York")).alias("available_at"), reason.alias("reason"))


def archived_rows(spark: SparkSession, folder: str) -> DataFrame:
    """observed_minute, symbol and row (JSON): the rows of a folder of chunks that manifest.json names with their SHA-256.

    Raises when a chunk is missing or has another digest, or when one minute and symbol has different rows; equal ones are one.
    """
    manifest = spark.read.text(f"{folder}/manifest.json", wholetext=True).select(F.from_json("value", "chunks map<string, struct<sha256: string>>").alias("m"))
    named = manifest.select(F.explode("m.chunks").alias("name", "item")).select("name", "item.sha256")
    names = [r.name for r in named.collect()]  # one per file
    chunks = spark.read.format("binaryFile").load([f"{folder}/{n}" for n in names]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content") if names else spark.createDataFrame([], "name string, content binary")
    met = named.join(chunks.select("name", F.sha2("content", 256).alias("found")), "name", "left")
    bad = [r.name for r in met.filter("found IS NULL OR found <> sha256").limit(20).collect()]
    if bad:
        raise RejectedInput(f"chunks missing or changed: {bad}")
    shape = "extracts array<struct<result: struct<result: array<struct<results: array<string>>>>>>"
    e = chunks.select(F.explode(F.from_json(F.decode("content", "utf-8"), shape)["extracts"]).alias("e")).select(F.explode("e.result.result").alias("q")).select(F.explode("q.results").alias("row"))
    keyed = e.select(F.get_json_object("row", "$.observed_minute").alias("observed_minute"), F.get_json_object("row", "$.symbol").alias("symbol"), "row")
    out = keyed.groupBy("observed_minute", "symbol").agg(F.min("row").alias("row"), F.max("row").alias("_other"))
    clash = out.filter("row <> _other").limit(1).collect()
    if clash:
        raise RejectedInput(f"different rows for {clash[0].symbol} at {clash[0].observed_minute}")
    return out.drop("_other")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, bytes, crc32, reason: what ZIP files hold. Reasons: unreadable (no archive), corrupt (a member's bytes differ from its checksum).

    Members are read in pieces, so memory holds one archive and a piece of a member.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content")), strict=True):
                rows: list[tuple] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for item in (i for i in z.infolist() if not i.is_dir()):
                            reason = None
                            try:
                                with z.open(item) as f:
                                    while f.read(1 << 20):
                                        pass
                            except (zipfile.BadZipFile, zlib.error, EOFError):
                                reason = "corrupt"
                            rows.append((name, item.filename, item.file_size, item.CRC, reason))
                except zipfile.BadZipFile:
                    rows.append((name, None, None, None, "unreadable"))
                yield pa.RecordBatch.from_pylist([dict(zip(("archive", "member", "bytes", "crc32", "reason"), r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("bytes", pa.int64()), ("crc32", pa.int64()), ("reason", pa.string())])
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    return files.mapInArrow(listed, "archive string, member string, bytes long, crc32 long, reason string")
