"""A Merkle manifest of a table: a digest per row, a tree per group, one root, and a proof for every row.

Rows take their places in their group by a range sort, so a group of any size is spread over many tasks;
equal rows are dealt out by a random tail of the sort key. Blocks of ``fanout ** levels`` consecutive
leaves are whole subtrees. Executors hand tiles of whole blocks to DuckDB as Arrow tables, where
``string_agg(... ORDER BY ...)`` and ``sha256`` make one level after the other. What is above the blocks
(a root per block, then a root per group) is combined by Spark, level by level, and comes back to the
blocks as outer proofs, so that a second pass folds every leaf up to the root.

Defined cases: leaves ascend by the order column, null first; leaves of equal order ascend by digest. A null
field is ``-``, an empty one ``0:``. A group of one leaf has that leaf as its root, and so does a table of
one group. The proof of a table of one row is the digest of nothing. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Children of a node, levels inside a block, and leaves that DuckDB is given at once (a whole number of blocks).
FANOUT, LEVELS, TILE = 16, 2, 4096
#: What DuckDB may hold in one worker.
MEMORY = "256MB"
#: Characters of a digest.
_HEX = 64


def field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*columns), 256)


def _duckdb(**tables: pa.Table):
    import duckdb

    connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY})
    for name, table in tables.items():
        connection.register(name, table)
    return connection


def _level_sql(fanout: int, levels: int) -> str:
    """Common table expressions n0 to n<levels> (nodes) and r1 to r<levels> (the joined digests of each run)."""
    parts = ["n0 AS (SELECT group_no, total, pos, leaf AS node FROM leaves)"]
    for k in range(1, levels + 1):
        parts.append(f"r{k} AS (SELECT group_no, total, pos // {fanout} AS pos, string_agg(node, '' ORDER BY pos, node) AS run FROM n{k - 1} GROUP BY ALL)")
        parts.append(f"n{k} AS (SELECT group_no, total, pos, CASE WHEN total > {fanout ** (k - 1)} THEN sha256(run) ELSE run END AS node FROM r{k})")
    return ",\n".join(parts)


def _block_roots(fanout: int, levels: int):
    sql = f"WITH {_level_sql(fanout, levels)} SELECT group_no, pos AS block, node FROM n{levels}"

    def roots(leaves: pa.Table) -> pa.Table:
        with _duckdb(leaves=leaves) as connection:
            return connection.sql(sql).to_arrow_table().cast(pa.schema([("group_no", pa.int64()), ("block", pa.int64()), ("node", pa.string())]))

    return roots


def _proof_sql(fanout: int, levels: int, outer: int) -> str:
    """Fold each leaf (the changed one, where there is one) through its block, then through ``outer`` levels above."""
    steps, folded, proof = [], "coalesce(l.changed, l.leaf)", []
    joins = "".join(f" JOIN r{k} ON r{k}.group_no = l.group_no AND r{k}.pos = l.pos // {fanout ** k}" for k in range(1, levels + 1))
    inner = []
    for k in range(1, levels + 1):
        at = f"{_HEX} * (l.pos // {fanout ** (k - 1)} % {fanout})"
        applies = f"l.total > {fanout ** (k - 1)}"
        inner += [f"CASE WHEN {applies} THEN substr(r{k}.run, 1, {at}) END AS a{k}", f"CASE WHEN {applies} THEN substr(r{k}.run, {at} + {_HEX + 1}) END AS b{k}"]
        steps.append((f"a{k}", f"b{k}"))
    inner += [f"o.lefts[{k}] AS c{k}, o.rights[{k}] AS d{k}" for k in range(1, outer + 1)]
    steps += [(f"c{k}", f"d{k}") for k in range(1, outer + 1)]
    folds = []
    for k, (a, b) in enumerate(steps):
        folds.append(f"f{k + 1} AS (SELECT *, CASE WHEN {a} IS NULL THEN x{k} ELSE sha256({a} || x{k} || {b}) END AS x{k + 1} FROM f{k})")
        proof += [f"coalesce({a}, '')", f"coalesce({b}, '')"]
    chosen = ", ".join(["l.id", "l.leaf", "o.subroot", f"{folded} AS x0", *inner])
    return (
        f"WITH {_level_sql(fanout, levels)},\n"
        f"f0 AS (SELECT {chosen} FROM leaves l{joins} JOIN outer_proofs o ON o.group_no = l.group_no AND o.block = l.pos // {fanout**levels})"
        + "".join(f",\n{f}" for f in folds)
        + f"\nSELECT id, leaf, subroot, sha256({' || '.join(proof) or chr(39) * 2}) AS proof_sha256, x{len(steps)} AS folded_root FROM f{len(steps)}"
    )


def _prove(fanout: int, levels: int, kind: pa.DataType):
    schema = pa.schema([("id", kind), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])

    def prove(leaves: pa.Table, outer: pa.Table) -> pa.Table:
        if not leaves.num_rows:
            return schema.empty_table()
        most = max((len(x) for x in outer.column("lefts").to_pylist()), default=0)
        with _duckdb(leaves=leaves, outer_proofs=outer) as connection:
            return connection.sql(_proof_sql(fanout, levels, most)).to_arrow_table().cast(schema)

    return prove


def _placed(scratch: Scratch, leaves: DataFrame) -> tuple[DataFrame, int]:
    """Leaves with the number of their group, its size, and their place in it; and how many leaves there are."""
    order = ["group", "order", "leaf", "salt"]
    held = scratch.keep(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("row", 33)
    # one row for each group and partition that holds some of it
    runs = held.groupBy("group", part.alias("part")).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = scratch.keep(runs, "runs")
    groups = runs.groupBy("group").agg(F.min("first").alias("start"), F.sum("n").alias("total")).withColumn("part", F.shiftright("start", 33))
    # groups are numbered in order: those that begin in earlier partitions, then by their place in their own
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the sort
    begun = groups.groupBy("part").agg(F.count(F.lit(1)).alias("c")).select("part", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c"))
    numbered = groups.join(begun, "part").select(F.col("group").alias("g"), "total", (F.col("c") + F.row_number().over(Window.partitionBy("part").orderBy("start")) - 1).alias("group_no"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    runs = scratch.keep(runs.join(numbered, F.col("group").eqNullSafe(F.col("g"))).drop("g"), "places")
    joined = held.withColumn("part", part).alias("l").join(runs.alias("r"), F.expr("l.part = r.part AND l.`group` <=> r.`group`"))
    return joined.select("group_no", "total", (F.col("offset") + F.col("row") - F.col("first")).alias("pos"), "id", "leaf", "changed"), held.count()


def _paths(scratch: Scratch, nodes: DataFrame, fanout: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Roots (key, root) and paths (key, pos, lefts, rights from the bottom up) of trees over ``nodes`` (key, pos, node, n)."""
    levels = []
    level = scratch.keep(nodes, f"{name}-0")
    while (level.agg(F.max("n")).first()[0] or 0) > 1:
        run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]), "")
        runs = level.groupBy("key", "n", F.expr(f"pos div {fanout}").alias("up")).agg(run.alias("run"))
        runs = scratch.keep(runs, f"{name}-runs-{len(levels)}")
        levels.append((level, runs))
        level = runs.select("key", F.col("up").alias("pos"), F.when(F.col("n") > 1, F.sha2("run", 256)).otherwise(F.col("run")).alias("node"), F.ceil(F.col("n") / fanout).cast("long").alias("n"))
        level = scratch.keep(level, f"{name}-{len(levels)}")
    roots, none = level.select("key", F.col("node").alias("root")), F.array().cast("array<string>")
    paths = level.select("key", "pos", none.alias("lefts"), none.alias("rights"))
    for k, (below, runs) in reversed(list(enumerate(levels))):
        at = F.col("pos") % fanout * _HEX
        own = lambda x: F.when(F.col("n") > 1, F.array(x)).otherwise(none)
        above = paths.select("key", F.col("pos").alias("up"), F.col("lefts").alias("l"), F.col("rights").alias("r"))
        found = below.withColumn("up", F.expr(f"pos div {fanout}")).join(runs.drop("n"), ["key", "up"]).join(above, ["key", "up"])
        left, right = F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + _HEX + 1).cast("int"), F.lit(_HEX * fanout))
        paths = found.select("key", "pos", F.concat(own(left), "l").alias("lefts"), F.concat(own(right), "r").alias("rights"))
        paths = scratch.keep(paths, f"{name}-paths-{k}")
    return roots, paths


def merkle_manifest(df: DataFrame, leaf: Column, *, changed: Column | None = None, id_col: str = "doc_id", group_col: str = "source", fanout: int = FANOUT, levels: int = LEVELS, tile: int = TILE) -> DataFrame:
    """``id_col``, leaf, subroot, root, proof_sha256, folded_root, verified: a row for each row of ``df``.

    ``leaf`` is the digest of a row, as hexadecimal text; ``changed`` the digest of what is found in its place
    now (null: the same). ``folded_root`` folds what is found through the proof; ``verified`` says whether
    that gives the root.
    """
    scratch = Scratch(df.sparkSession, "merkle")
    kind = df.schema[id_col].dataType.simpleString()
    leaves = df.select(
        F.col(group_col).cast("string").alias("group"), F.col(id_col).alias("order"), F.col(id_col).alias("id"), leaf.alias("leaf"), (F.lit(None).cast("string") if changed is None else changed).alias("changed")
    ).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    placed, rows = _placed(scratch, scratch.keep(leaves, "leaves"))
    block = F.expr(f"pos div {fanout**levels}")
    tiles = max(1, -(-rows // tile))
    dealt = F.pmod(F.xxhash64("group_no", "block"), F.lit(tiles)).alias("tile")
    held = scratch.keep(placed.withColumn("block", block).select("group_no", "total", "pos", "id", "leaf", "changed", dealt), "placed")
    roots = held.select("tile", "group_no", "total", "pos", "leaf").groupBy("tile").applyInArrow(_block_roots(fanout, levels), "group_no long, block long, node string")
    totals = df.sparkSession.read.parquet(f"{scratch.root}/places").select("group_no", "total").distinct()
    blocks = roots.join(totals, "group_no").select(F.col("group_no").alias("key"), F.col("block").alias("pos"), "node", F.ceil(F.col("total") / fanout**levels).cast("long").alias("n"))
    subroots, inside = _paths(scratch, blocks, fanout, "blocks")
    subroots = scratch.keep(subroots, "subroots")
    tops = subroots.select(F.lit(0).cast("long").alias("key"), F.col("key").alias("pos"), F.col("root").alias("node"), F.lit(subroots.count()).cast("long").alias("n"))
    root, above = _paths(scratch, tops, fanout, "groups")
    found = root.first()  # one row, or none for an empty table
    outer = inside.join(subroots.withColumnRenamed("root", "subroot"), "key").join(above.select(F.col("pos").alias("key"), F.col("lefts").alias("l"), F.col("rights").alias("r")), "key")
    outer = outer.select(F.col("key").alias("group_no"), F.col("pos").alias("block"), "subroot", F.concat("lefts", "l").alias("lefts"), F.concat("rights", "r").alias("rights"))
    outer = outer.select(dealt, "*")
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    if id_type is None:
        raise TypeError(f"{id_col} must be a whole number or a string, not {kind}")
    proved = held.groupBy("tile").cogroup(outer.groupBy("tile")).applyInArrow(_prove(fanout, levels, id_type), f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    top = F.lit(found.root if found else None).cast("string")
    return proved.select(F.col("id").alias(id_col), "leaf", "subroot", top.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == top).alias("verified"))


def row_digest(*columns: Column) -> Column:
    """The digest of a row's fields, each as ``field`` writes it."""
    return digest(*reduce(lambda got, c: [*got, field(c)], columns, []))
