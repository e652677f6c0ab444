"""Merkle manifest of a dataset: a tree for each source, and one over the sources' roots.

A level of a tree is pivoted by slot: conditional aggregates put the children of each parent in
`FANOUT` columns. All of them put together, hashed, are the parent; all but a child's own are its
siblings. Levels are written as tables, so the trees of all sources grow at once, each by as many
levels as it needs, and no task holds more than one run of children.

Positions within a source come from one sort by ranges of (source, id, leaf): each task's part of
a source is told how many nodes lie before it, so a source with a third of all rows is many tasks' work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions

FANOUT = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "array<struct<l:string,r:string>>"


def hashed(*inputs: Column) -> Column:
    """Lowercase hex sha256 of the inputs, one after the other."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def leaf_of(*values: Column) -> Column:
    """Each value as its bytes' count, a colon and itself, or `-` for null."""
    texts = [v.cast("string") for v in values]
    return hashed(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def _positions(nodes: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """nodes (g, ...) with i, their place within g by `order`, nulls first, and n, g's nodes."""
    keys = [F.col(c).asc_nulls_first() for c in ["g", *order]]
    # equal rows are as good as one another: a number spreads them over ranges
    dealt = nodes.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(partitions(nodes.sparkSession), *keys, F.col("copy"))
    held = scratch.keep(dealt.sortWithinPartitions(*keys, "copy").drop("copy").withColumn("at", F.monotonically_increasing_id()))
    held = held.withColumn("part", F.shiftright("at", 33))
    runs = held.groupBy("g", "part").agg(F.min("at").alias("least"), F.count("*").alias("held"))
    over = Window.partitionBy("g")
    before = F.coalesce(F.sum("held").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("g").alias("rg"), F.col("part").alias("rpart"), (before - F.col("least")).alias("shift"), F.sum("held").over(over).alias("n"))
    met = held.join(runs, F.col("g").eqNullSafe(F.col("rg")) & (F.col("part") == F.col("rpart")))
    return met.withColumn("i", F.col("at") + F.col("shift")).drop("rg", "rpart", "shift", "part", "at")


def _slots(held: str | Column) -> list[Column]:
    return [F.max(F.when(F.col("i") % FANOUT == k, held)).alias(f"c{k}") for k in range(FANOUT)]


def _parents(nodes: DataFrame, held: Column) -> DataFrame:
    """(g, i, n, h, c0, c1, ...): each parent, its level's nodes of g, its hash and its children by slot."""
    wide = nodes.filter("n > 1").groupBy("g", "n", F.expr(f"i div {FANOUT}").alias("p")).agg(*_slots(held))
    kind = nodes.select(held.alias("x")).schema["x"].dataType.simpleString()
    digests = [F.col(f"c{k}") if kind == "string" else F.col(f"c{k}.h") for k in range(FANOUT)]
    return wide.select("g", F.col("p").alias("i"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), F.sha2(F.concat_ws("", *digests), 256).alias("h"), *[f"c{k}" for k in range(FANOUT)])


def _children(parents: DataFrame, nested: bool) -> DataFrame:
    """Each child of parents that have `path`: g, i, the held slot, and the path with this level's siblings in front."""
    every = F.array(*[f"c{k}" for k in range(FANOUT)])
    digests = F.array(*[F.col(f"c{k}.h") if nested else F.col(f"c{k}") for k in range(FANOUT)])
    rows = parents.select("g", "i", "subroot", "path", digests.alias("hs"), F.posexplode(every).alias("k", "c")).filter("c is not null")
    own = F.col("k")
    left, right = F.array_join(F.slice("hs", F.lit(1), own), ""), F.array_join(F.slice("hs", own + 2, F.lit(FANOUT)), "")
    step = F.array(F.struct(left.alias("l"), right.alias("r")))
    return rows.select("g", (F.col("i") * FANOUT + own).alias("i"), "c", "subroot", F.concat(step, "path").alias("path"))


class Forest:
    """Trees over nodes (g, i, n, h and payload columns); `tops` are their roots."""

    def __init__(self, nodes: DataFrame, payload: list[str], scratch: Scratch):
        self.payload, self.leaves = payload, nodes
        held = F.struct("h", *payload)
        self.levels: list[DataFrame] = []
        most = nodes.agg(F.max("n")).first()[0] or 0
        while most > 1:
            self.levels.append(scratch.keep(_parents(self.levels[-1] if self.levels else nodes, F.col("h") if self.levels else held)))
            most = -(-most // FANOUT)
        self.tops = reduce(DataFrame.unionByName, [x.filter("n = 1").select("g", "h") for x in [nodes, *self.levels]])

    def paths(self, above: DataFrame) -> DataFrame:
        """(g, h, payload, subroot, path) of every leaf; above (g, subroot, path) says how each top goes on."""
        above = above.select(F.col("g").alias("ag"), "subroot", "path")
        same = F.col("g").eqNullSafe(F.col("ag"))
        told = None
        for k in range(len(self.levels) - 1, -1, -1):
            parents = self.levels[k]
            tops = parents.filter("n = 1").join(above, same).drop("ag")
            if told is not None:
                known = told.select(F.col("g").alias("ag"), F.col("i").alias("ai"), "subroot", "path")
                tops = tops.unionByName(parents.filter("n > 1").join(known, same & (F.col("i") == F.col("ai"))).drop("ag", "ai"))
            told = _children(tops, nested=k == 0)
        lone = self.leaves.filter("n = 1").join(above, same).select("g", "h", *self.payload, "subroot", "path")
        if told is None:
            return lone
        return told.select("g", *[F.col(f"c.{c}").alias(c) for c in ["h", *self.payload]], "subroot", "path").unionByName(lone)


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", value_cols: tuple[str, ...] = ("source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    A leaf hashes the id and the values of a row. Leaves of a source ascend by id, a null id
    first, equal ids by their leaves; every FANOUT consecutive nodes become one until one is left,
    the subroot. Subroots by source (null first, by their bytes) likewise give the root. The proof
    hashes a leaf's siblings of all levels; folding takes the leaf that `tampered` replacements of
    columns give, else the original, up along its siblings. Equal rows are leaves of their own. An
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    found = leaf_of(docs[id_col], *(docs[c] for c in value_cols))
    other = leaf_of(docs[id_col], *((tampered or {}).get(c, docs[c]) for c in value_cols))
    rows = docs.select(docs[source_col].alias("g"), docs[id_col].alias("doc_id"), found.alias("h"), F.nullif(other, found).alias("other"))
    leaves = Forest(_positions(rows, ["doc_id", "h"], scratch), ["doc_id", "other"], scratch)
    tops = leaves.tops.select(F.lit(0).alias("g"), F.col("g").alias("source"), "h")
    sources = Forest(_positions(tops, ["source"], scratch), ["source"], scratch)
    (root,) = sources.tops.select("h").collect() or [(None,)]
    start = spark.createDataFrame([(0, None, [])], f"g int, subroot string, path {_STEP}")
    above = sources.paths(start).select(F.col("source").alias("g"), F.col("h").alias("subroot"), "path")
    told = leaves.paths(above)
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), "")
    folded = F.aggregate("path", F.coalesce("other", "h"), lambda h, x: F.sha2(F.concat(x["l"], h, x["r"]), 256))
    out = told.select("doc_id", F.col("h").alias("leaf"), "subroot", F.lit(root[0]).cast("string").alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_fifth(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, A-Z lower-cased where 5 divides crc32 of the id's decimal; a null id stays as it is."""
    hit = F.coalesce(F.crc32(docs[id_col].cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return F.when(hit, F.translate(docs[text_col], _UPPER, _LOWER)).otherwise(docs[text_col])
