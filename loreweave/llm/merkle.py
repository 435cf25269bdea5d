"""Merkle manifest of a table: a hash tree per partition value (language), one tree over their roots, and a proof for each row.

A leaf is H of the row's fields, H being the lower-case hex SHA-256 of its inputs in a row. Every FAN neighbours become their H, level by
level, until one node is left. The tree is never in one place: leaves are put in order by a range sort, ordered arrays of BLOCK leaves are
collapsed by array functions alone, and the blocks' roots are leaves of the next round.

Rows of one language ascend by doc_id (null first), rows of one doc_id by their leaf; rows alike in all fields have equal leaves, so their
order changes nothing. A null field is `-`, an empty text `0:`, so that the two differ. A null language is a partition of its own, before all
others. A null doc_id is never altered by `audit`. An empty table has no rows and no root. Columns besides the five fields are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, cut, discard

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes under one parent, levels that a block collapses, and nodes of a block.
FAN, STEPS = 8, 2
BLOCK = FAN**STEPS


def digest(*parts: Column) -> Column:
    """H of strings one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(**changed: Column) -> Column:
    """The leaf of a row; changed fields are taken in place of the stored ones."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(*parts)


def _ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with pos, their gapless place in their group by `order`, and n, the rows of the group. The second frame is the table behind it.
    Sorted ranges are numbered where they lie; only counts for each range and group meet. Equal rows may lie in several ranges."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    by = [F.col("group"), *(F.col(c).asc_nulls_first() for c in order), F.col("tie")]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn("at", F.monotonically_increasing_id())
    placed, _ = cut(placed, "ranked")
    runs = placed.groupBy("group", F.shiftright("at", 33).alias("range")).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("rows"))
    sums = runs.selectExpr("group", "range", "low - (sum(rows) OVER (PARTITION BY group ORDER BY range) - rows) AS low", "sum(rows) OVER (PARTITION BY group) AS n")
    joined = placed.withColumn("range", F.shiftright("at", 33)).join(sums, ["group", "range"])
    return joined.withColumn("pos", F.col("at") - F.col("low")).drop("at", "low", "range"), placed


def _parents(nodes: Column) -> Column:
    """H of each run of FAN neighbours."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * FAN + 1, FAN), ""), 256))


def _counters(n: Column) -> Column:
    """The levels that a block collapses, as 0, 1, ...: all STEPS, or as many as bring a group of n nodes down to one."""
    steps = sum((F.when(n > FAN**k, 1).otherwise(0) for k in range(STEPS)), F.lit(0))
    return F.slice(F.array(*[F.lit(k) for k in range(STEPS)]), 1, steps)


def _blocks(nodes: DataFrame, keep: list[str]) -> tuple[DataFrame, dict]:
    """Nodes (group, pos, n, hash and what is to keep) in blocks: ordered items, the levels over them, and the root."""
    grouped = nodes.groupBy("group", "n", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash", *keep))).alias("items"))
    levels = F.aggregate(_counters(F.col("n")), F.array(F.col("items.hash")), lambda seen, _: F.concat(seen, F.array(_parents(F.element_at(seen, -1)))))
    grouped = grouped.withColumn("levels", levels).withColumn("root", F.element_at(F.element_at("levels", -1), 1))
    return cut(grouped, "blocks", most=F.max("n"))


def _grow(nodes: DataFrame, keep: list[str]) -> list[DataFrame]:
    """Tables of blocks from the leaves up to the groups' roots. A group is in as many of them as it needs; the rest go on with their roots."""
    tables = []
    while True:
        table, seen = _blocks(nodes, keep)
        tables.append(table)
        if (seen["most"] or 0) <= BLOCK:
            return tables
        nodes = table.where(F.col("n") > BLOCK).select("group", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("hash"))
        keep = []


def _group_roots(tables: list[DataFrame]) -> DataFrame:
    """The root of each group, its leaves, and the table where it ended."""
    ends = [t.where(F.col("n") <= BLOCK).select("group", F.col("root").alias("hash"), F.lit(k).alias("depth")) for k, t in enumerate(tables)]
    out = ends[0]
    for more in ends[1:]:
        out = out.unionByName(more)
    return out


def _siblings(levels: Column, at: Column, counters: Column) -> Column:
    """For item `at` of a block and each level: the hashes left and right of it in its run."""

    def beside(k: Column) -> Column:
        own = F.floor(at / F.pow(F.lit(FAN), k)).cast("int")
        run = F.slice(F.element_at(levels, k + 1), own - own % FAN + 1, FAN)
        return F.struct(F.array_join(F.slice(run, 1, own % FAN), "").alias("left"), F.array_join(F.slice(run, own % FAN + 2, FAN), "").alias("right"))

    return F.transform(counters, beside)


def _unfold(tables: list[DataFrame], above: DataFrame, keep: list[str]) -> DataFrame:
    """From the groups' own paths (group, depth, path and more) down to the paths of all leaves."""
    more = [c for c in above.columns if c not in ("group", "depth", "path")]
    found = None
    for k in range(len(tables) - 1, -1, -1):
        ends = above.where(F.col("depth") == k).select("group", F.lit(0).cast("long").alias("block"), F.col("path").alias("rest"), *more)
        ends = ends if found is None else ends.unionByName(found.select("group", F.col("pos").alias("block"), F.col("path").alias("rest"), *more))
        items = tables[k].drop("root").join(ends, ["group", "block"]).select("group", "n", "levels", "rest", *more, F.posexplode("items").alias("at", "item"))
        path = F.concat(_siblings(F.col("levels"), F.col("at"), _counters(F.col("n"))), F.col("rest"))
        found = items.select("group", F.col("item.pos").alias("pos"), F.col("item.hash").alias("hash"), *[F.col(f"item.{c}").alias(c) for c in (keep if k == 0 else [])], path.alias("path"), *more)
    return found


def _forest(docs: DataFrame, **extra: Column) -> tuple[list[DataFrame], list[DataFrame], str | None]:
    """Tables of blocks of all groups, those of the tree over the groups' roots, and the root (None for an empty table)."""
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # bytewise, and null first
    leaves = docs.select(group.alias("group"), "doc_id", leaf_hash().alias("hash"), *[c.alias(k) for k, c in extra.items()])
    ranked, placed = _ranked(leaves, ["doc_id", "hash"])
    trees = _grow(ranked, ["doc_id", *extra])
    tops, numbered = _ranked(_group_roots(trees).select(F.lit("").alias("group"), F.col("group").alias("name"), "hash", "depth"), ["name"])
    crown = _grow(tops, ["name", "depth"])
    root = crown[-1].where(F.col("n") <= BLOCK).select("root").head()
    discard(placed, numbered)
    return trees, crown, root and root["root"]


def _above(crown: list[DataFrame], root: str | None) -> DataFrame:
    """The path from each group's root to the root of all."""
    spark = crown[0].sparkSession
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    start = spark.range(1).select(F.lit("").alias("group"), F.lit(len(crown) - 1).alias("depth"), nothing.alias("path"), F.lit(root).alias("root"))
    paths = _unfold(crown, start, ["name", "depth"])
    return paths.select(F.col("name").alias("group"), "depth", "path", F.col("hash").alias("subroot"), "root")


def manifest(docs: DataFrame) -> DataFrame:
    """One row per language: lang, n_rows, subroot, and the root of all."""
    trees, crown, root = _forest(docs)
    rows = trees[0].groupBy("group").agg(F.max("n").alias("n_rows"))
    tops = _above(crown, root).join(rows, "group")
    return tops.select(F.when(F.col("group") != "", F.expr("substring(group, 2)")).alias("lang"), "n_rows", "subroot", "root")


def proofs(docs: DataFrame, **extra: Column) -> DataFrame:
    """Each row's leaf, subroot, root, and its path: the hashes left and right of the way up, level by level. extra: columns to carry along."""
    trees, crown, root = _forest(docs, **extra)
    return _unfold(trees, _above(crown, root), ["doc_id", *extra]).select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", "path", *extra)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the hashes beside its way lead to."""
    return F.aggregate(path, leaf, lambda h, p: digest(p["left"], h, p["right"]))


def audit(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, checked after texts of every third row (by crc32 of doc_id) lost their capitals: verified is false where a text changed."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    text = F.when(hit, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    found = proofs(docs, tampered=F.when(hit, leaf_hash(text=text)).otherwise(leaf_hash()))
    shown = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    out = found.select("doc_id", "leaf", "subroot", "root", shown.alias("proof_sha256"), fold(F.col("tampered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
