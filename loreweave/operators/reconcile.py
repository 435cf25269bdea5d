"""Incremental maintenance: change detection, upserts, renames, dismissals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def diff_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed by content hash; equal files are left out."""
    n, b = now.select("path", F.col("content_hash").alias("n")), before.select("path", F.col("content_hash").alias("b"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("n") != F.col("b"), "changed")
    return n.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def reconcile(disk: DataFrame, index: DataFrame) -> DataFrame:
    """(id, action): adopt what only the disk has, remove what only the index has, reindex where hashes differ."""
    d, i = disk.select("id", F.col("body_hash").alias("d")), index.select("id", F.col("body_hash").alias("i"))
    action = F.when(F.col("i").isNull(), "adopt").when(F.col("d").isNull(), "phantom").when(F.col("d") != F.col("i"), "reindex")
    return d.join(i, "id", "full_outer").select("id", action.alias("action")).where("action is not null")


def rename_relink(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(new_path, old_path) of added files with the content of a removed one; the last removed path of a hash."""
    old = removed.groupBy("content_hash").agg(F.max("path").alias("old_path"))
    return added.join(old, "content_hash").select(F.col("path").alias("new_path"), "old_path")


def relink_annotations(annotations: DataFrame, moved: DataFrame, key: str = "doc_id") -> DataFrame:
    """annotations (doc_id, ...) after renames (old_path, new_path): one of a renamed document goes to its new id, unless that has one of its
    own, which wins; the old one then goes. Of several that come to one id the smallest old id's stays."""
    m = moved.select(F.col("old_path").alias(key), "new_path").distinct()
    stay = annotations.join(m.select(key), key, "left_anti").select(annotations.columns)
    come = annotations.join(m, key).join(stay.select(F.col(key).alias("new_path")), "new_path", "left_anti")
    come = come.groupBy("new_path").agg(F.min_by(F.struct(*annotations.columns), key).alias("a"))
    return stay.unionByName(come.select(*(F.col("new_path").alias(key) if c == key else F.col(f"a.{c}").alias(c) for c in annotations.columns)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old, and of new what it doesn't have, one row for each key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti").select(old.columns))


def changed_names(*sets: DataFrame) -> DataFrame:
    """Distinct paths of several change sets."""
    out = sets[0].select("path")
    for s in sets[1:]:
        out = out.union(s.select("path"))
    return out.distinct()


def reindex(rows: DataFrame, fresh: DataFrame, changes: DataFrame, imports: DataFrame) -> DataFrame:
    """Structural rows (path, ...) after a change: those of touched files and of their importers are replaced by fresh ones, those of removed files go."""
    touched = changes.select("path").union(imports.join(changes.select(F.col("path").alias("to_path")), "to_path", "left_semi").select(F.col("from_path"))).distinct()
    kept = rows.join(touched, "path", "left_anti").select(rows.columns)
    removed = changes.where("change = 'removed'").select("path")
    return kept.unionByName(fresh.join(touched, "path", "left_semi").join(removed, "path", "left_anti").select(rows.columns))


def reuse_vectors(items: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (id, content_hash) whose vector of the same hash exists, and those to be embedded."""
    have = items.join(vectors, ["id", "content_hash"])
    return have, items.join(vectors.select("id", "content_hash"), ["id", "content_hash"], "left_anti")


def backfill(calls: DataFrame, derived: DataFrame) -> DataFrame:
    """Live calls, with all synthetic ones replaced by derived ones."""
    return calls.where("synthetic = 0").unionByName(derived.withColumn("synthetic", F.lit(1)).select(calls.columns))


def freshness(meta: DataFrame) -> DataFrame:
    """Adds decision: reindexed where there is no index or it changed under a dirty tree, stale where the fingerprint moved, else fresh."""
    same = F.col("fingerprint") == F.col("head")
    return meta.withColumn("decision", F.when(F.col("fingerprint").isNull(), "reindexed").when(~same, "stale").when(F.col("dirty") | F.col("dirty_reverted"), "reindexed").otherwise("fresh"))


def dismissals(surface: DataFrame, gets: DataFrame, versions: DataFrame, marks: DataFrame, now_ms: int, grace_ms: int = 600_000) -> DataFrame:
    """(memory_id, file, count, version): surfacings without a later get, counted once for each record and file per session delta.

    surface (ts, ordinal, session_id, memory_id, file), gets (ts, session_id, memory_id), versions (memory_id, version), marks (session_id,
    watermark). Only sessions idle past the grace count, only events after their mark; a get at or after the surfacing cancels it. Of a
    delta's surfacings of one record and file the first in log order decides. Records without version are dropped.
    """
    s = surface.where("session_id is not null")
    last = s.select("session_id", "ts").unionByName(gets.where("session_id is not null").select("session_id", "ts")).groupBy("session_id").agg(F.max("ts").alias("last")).where(F.col("last") + grace_ms <= now_ms)
    due = s.join(last, "session_id").join(marks, "session_id", "left").where(F.col("ts") > F.coalesce("watermark", F.lit(-1)))
    w = Window.partitionBy("session_id", "memory_id", "file").orderBy("ordinal")
    first = due.withColumn("n", F.row_number().over(w)).where("n = 1")
    got = gets.groupBy("session_id", "memory_id").agg(F.max("ts").alias("got"))
    left = first.join(got, ["session_id", "memory_id"], "left").where("got is null or got < ts")
    return left.join(versions, "memory_id").groupBy("memory_id", "file", "version").agg(F.count(F.lit(1)).alias("count"))


def merge_dismissals(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored counts with new ones added; a new version starts anew."""
    s = stored.select("memory_id", "file", F.col("count").alias("s"), F.col("version").alias("sv"))
    out = found.join(s, ["memory_id", "file"], "full_outer")
    keep = F.coalesce(F.col("sv") == F.col("version"), F.lit(False))
    return out.select("memory_id", "file", F.when(F.col("version").isNull(), F.col("s")).when(keep, F.col("s") + F.col("count")).otherwise(F.col("count")).alias("count"), F.coalesce("version", "sv").alias("version"))


def unsuppressed(candidates: DataFrame, stored: DataFrame, most: int = 2) -> DataFrame:
    """Surfacings (memory_id, file, version) not dismissed `most` times at their version."""
    return candidates.join(stored.where(F.col("count") >= most).select("memory_id", "file", "version"), ["memory_id", "file", "version"], "left_anti")


def ledger_fresh(events: DataFrame, keep_ms: int = 604_800_000) -> DataFrame:
    """The first surfacing of each (session_id, file, memory_id) within seven days of the last one shown."""
    w = Window.partitionBy("session_id", "file", "memory_id").orderBy("ts", "ordinal")
    return events.withColumn("before", F.lag("ts").over(w)).where(F.col("before").isNull() | (F.col("ts") - F.col("before") > keep_ms)).drop("before")


def retained(events: DataFrame, now_ms: int, days: int = 90) -> DataFrame:
    """Events of the last days."""
    return events.where(F.col("ts") >= now_ms - days * 86_400_000)
