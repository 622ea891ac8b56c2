"""Operator 12: a Merkle manifest of a table, with a proof for every row, by a DuckDB block engine.

Rows of one group (a language) are ranked by id and dealt to aligned buckets of 2^`LEVELS` leaves. A task passes whole
buckets as Arrow tables to DuckDB, which computes one level after the other by an ordered string_agg and sha256, and
each leaf's siblings below its bucket's node. As buckets are aligned, the buckets' nodes are the leaves of a smaller
tree of the same kind: the same step again makes its outer proofs, until one node of each group, and then of the table,
remains. Spark joins the outer proofs to the rows of a bucket, top down, and carries the fold on. A hot group is shared
by many buckets; no task sees more than some buckets at a time.

Ranks come from sorted ranges: a row's place within its range, plus the rows of its group in earlier ranges.

Cases: a null group is a group of its own, the first; null ids come first in a group; rows that repeat an id are leaves
of their own, in the order of their digests, and equal rows have equal digests; a null value is `-` in a leaf; an empty
table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .common import checkpointed, small_batches

#: A bucket holds 2^LEVELS nodes.
LEVELS = 10
#: Buckets that one set of level queries computes, some 32,000 rows at most.
TOGETHER = 32
#: Rows with a checksum that this divides are tampered with.
TAMPERED = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = ("node", "path", "sides", "fold")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest of a row; `changed` columns stand in for those of the table."""
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in COLUMNS]).cast("binary"), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with i, the place from 0 within `key` in the given order, and total, the rows of the key. Shuffles by ranges, so that a hot key has many tasks."""
    at = checkpointed(rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumns({"_part": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    ranges = at.groupBy("key", "_part").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("key", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("key")).alias("total"))
    return at.join(ranges, ["key", "_part"]).withColumn("i", F.col("_before") + F.col("_m") - F.col("_first")).drop("_part", "_m", "_first", "_before")


def _hashed(con, table: pa.Table, levels: int) -> pa.Table:
    """(g, i, node, path, sides, fold) of the leaves (g, i, h, t, depth) of whole buckets: the bucket's node, the siblings from the leaf up, on which side each is ('<' left, '>' right, '.' none), and what t folds to with them."""
    con.register("leaves", table)
    con.execute("CREATE OR REPLACE TEMP TABLE l0 AS SELECT g, i, h, depth FROM leaves")
    con.execute("CREATE OR REPLACE TEMP TABLE p0 AS SELECT g, i, depth, '' AS path, '' AS sides, t AS fold FROM leaves")
    for k in range(levels):
        con.execute(f"CREATE OR REPLACE TEMP TABLE l{k + 1} AS SELECT g, i // 2 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, any_value(depth) AS depth FROM l{k} WHERE depth > {k} GROUP BY g, i // 2")
        con.execute(f"""CREATE OR REPLACE TEMP TABLE p{k + 1} AS SELECT p.g, p.i, p.depth, p.path || coalesce(s.h, '') AS path,
            p.sides || CASE WHEN s.h IS NULL THEN '.' WHEN (p.i >> {k}) & 1 = 1 THEN '<' ELSE '>' END AS sides,
            sha256(CASE WHEN (p.i >> {k}) & 1 = 1 THEN coalesce(s.h, '') || p.fold ELSE p.fold || coalesce(s.h, '') END) AS fold
            FROM p{k} p LEFT JOIN l{k} s ON s.g = p.g AND s.i = xor(p.i >> {k}, 1) WHERE p.depth > {k}""")
    tops = " UNION ALL ".join(f"SELECT g, h FROM l{k} WHERE depth = {k}" for k in range(levels + 1))
    ends = " UNION ALL ".join(f"SELECT * FROM p{k} WHERE depth = {k}" for k in range(levels + 1))
    return con.sql(f"SELECT e.g, e.i, t.h AS node, e.path, e.sides, e.fold FROM ({ends}) e JOIN ({tops}) t ON t.g = e.g").to_arrow_table()


def blocks(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """`leaves` (key, i, total, h, t, ...) with bucket, node, path, sides and fold; t is what is folded."""
    name = "key bucket i total h t".split()
    others = [c for c in leaves.columns if c not in name]
    dealt = leaves.withColumn("bucket", F.shiftright("i", levels)).repartition("key", "bucket").sortWithinPartitions("key", "bucket", "i").select(*name, *others)
    schema = T.StructType([*dealt.schema.fields, *(T.StructField(c, T.StringType()) for c in PROOF)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        C.release()
        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})

        def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            keys, buckets, at, totals = (table[c].to_pylist() for c in ("key", "bucket", "i", "total"))
            g, seen = [], -1
            for k in range(len(keys)):
                seen += not k or keys[k] != keys[k - 1] or buckets[k] != buckets[k - 1]
                g.append(seen)
            depth = [levels if n > 1 << levels else (n - 1).bit_length() for n in totals]
            inner = [i & ((1 << levels) - 1) for i in at]
            out = _hashed(con, pa.table({"g": pa.array(g, pa.int32()), "i": pa.array(inner, pa.int32()), "h": table["h"], "t": table["t"], "depth": pa.array(depth, pa.int32())}), levels)
            out = out.sort_by([("g", "ascending"), ("i", "ascending")])  # the order in which they came
            yield from pa.table([*table.columns, *(out[c] for c in PROOF)], names=schema.names).to_batches(4000)

        held: list[pa.RecordBatch] = []
        buckets = 0
        for batch in small_batches(batches):
            key, bucket = batch["key"].to_pylist(), batch["bucket"].to_pylist()
            last = (held[-1]["key"][-1].as_py(), held[-1]["bucket"][-1].as_py()) if held else None
            begin = 0
            for k in range(len(key)):
                if (key[k], bucket[k]) != last:
                    last = (key[k], bucket[k])
                    if buckets == TOGETHER:
                        if k > begin:
                            held.append(batch.slice(begin, k - begin))
                        yield from told(held)
                        held, buckets, begin = [], 0, k
                    buckets += 1
            held.append(batch.slice(begin))
        if held:
            yield from told(held)
        con.close()

    return dealt.mapInArrow(run, schema)


def _above(nodes: DataFrame, levels: int) -> DataFrame:
    """(key, bucket, root, path, sides) for nodes (key, bucket, node, total): the one node above all of a key's, and the siblings on the way to it."""
    outer = nodes.select("key", "bucket", F.col("bucket").alias("root_bucket"), F.col("node").alias("root"), F.lit("").alias("path"), F.lit("").alias("sides"), "total")
    if nodes.where("total > 1").isEmpty():
        return outer.select("key", "bucket", "root", "path", "sides")
    made = checkpointed(blocks(nodes.select("key", F.col("bucket").alias("i"), "total", F.col("node").alias("h"), F.col("node").alias("t")), levels))
    next_total = F.shiftright(F.col("total") + (1 << levels) - 1, levels)
    tops = made.where(F.col("i") % (1 << levels) == 0).select("key", "bucket", "node", next_total.alias("total"))
    up = _above(tops, levels).withColumnsRenamed({"path": "_path", "sides": "_sides"})
    joined = made.join(up, ["key", "bucket"])
    return joined.select("key", F.col("i").alias("bucket"), "root", F.concat("path", "_path").alias("path"), F.concat("sides", "_sides").alias("sides"))


def _folded(fold: Column, path: Column, sides: Column) -> Column:
    """The fold carried on along a path of 64 hexadecimal digits a sibling."""
    steps = F.transform(F.sequence(F.lit(1), F.length(sides)), lambda k: F.struct(F.substr(sides, k, F.lit(1)).alias("side"), F.length(F.regexp_replace(F.left(sides, k - 1), r"\.", "")).alias("before")))
    sibling = lambda s: F.when(s["side"] == ".", "").otherwise(F.substr(path, s["before"] * 64 + 1, F.lit(64)))
    one = lambda h, s: F.sha2(F.when(s["side"] == "<", F.concat(sibling(s), h)).otherwise(F.concat(h, sibling(s))).cast("binary"), 256)
    return F.when(F.length(sides) == 0, fold).otherwise(F.aggregate(steps, fold, one))


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    C.lean_batches(docs.sparkSession)
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0, F.lit(False))
    changed = leaf(n_chars=(F.col("n_chars").cast("decimal(20,0)") + 1))
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    rows = checkpointed(docs.select("doc_id", key.alias("key"), leaf().alias("h"), F.when(touched, changed).alias("t")))
    rows = ranked(rows, ["doc_id", "h"]).withColumn("t", F.coalesce("t", "h"))
    inner = checkpointed(blocks(rows, levels))
    nodes = inner.where(F.col("i") % (1 << levels) == 0).select("key", "bucket", "node", F.shiftright(F.col("total") + (1 << levels) - 1, levels).alias("total"))
    within = checkpointed(_above(nodes, levels))
    groups = within.where("bucket = 0").select("key", F.col("root").alias("subroot"))
    listed = ranked(groups.select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("subroot").alias("h"), F.col("subroot").alias("t")), ["name"])
    last = _above(listed.select("key", F.col("i").alias("bucket"), F.col("h").alias("node"), "total"), levels)
    tops = listed.select(F.col("name").alias("key"), "i").join(last.select(F.col("bucket").alias("i"), F.col("root").alias("top"), F.col("path").alias("_path"), F.col("sides").alias("_sides")), "i").drop("i")
    outer = within.join(tops, "key").select("key", "bucket", F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("path", "_path").alias("outer"), F.concat("sides", "_sides").alias("outer_sides"))
    found = inner.join(outer, ["key", "bucket"])
    proof = F.sha2(F.concat("path", "outer").cast("binary"), 256)
    folded = _folded(F.col("fold"), F.col("outer"), F.col("outer_sides"))
    return found.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
