"""Intake of captures: prompts of sessions in order, each rejected, discarded, appended as evidence to a record much like it, or made a new one.

A capture is compared with the records that are there and with those that earlier captures of the same run have made, so the run is a
sequence. It is resolved in rounds instead: a capture without an earlier neighbour is new whatever happens, its neighbours are not, and both leave
the next round. Neighbours share a tag and have a cosine of `least` or more; they are found part by part within each tag, and a part
gives at most one row for each of its captures, never its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as t
from ..sources.spread import safe_unions
from . import history, library, memory, pairs
from .graph import cut

#: Captures of one tag in a part; all others of the tag stream past it.
BLOCK = pairs.PART
EXCERPT = 280
#: Places of records that were there before, so that they come before all captures.
_BEFORE = -(1 << 62)


@dataclass(frozen=True)
class Intake:
    """outcomes: session, turn, route (reject, discard, append, create), reason, id (of the record that was made or got the evidence).
    created: id, title, body, tags, tier, session, turn. discarded: the same, born trashed. evidence: id, session, turn, kind, excerpt."""

    outcomes: DataFrame
    created: DataFrame
    discarded: DataFrame
    evidence: DataFrame


def _placed(df: DataFrame, *by: str, start: int = 0) -> DataFrame:
    """df with `place`, a number that grows in the order of `by`, as a table."""
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return cut(rows.withColumn("place", F.monotonically_increasing_id() + F.lit(start)), "placed")


def nearest_before(points: DataFrame, base: DataFrame, least: float) -> DataFrame:
    """(place, to, cosine): for each point (place, tags, vec) the most similar row of base (place, tags, vec) at an earlier place with a common
    tag; none below `least`. Of equal ones the earliest."""
    tagged = lambda df: df.select(F.explode(F.array_distinct("tags")).alias("g"), F.col("place").alias("id"), "vec")
    near = pairs.best(tagged(points), tagged(base), 1, least - 1e-12, cosine=True, earlier=True, digits=12, part=BLOCK)
    return near.select(F.col("source").alias("place"), F.col("target").alias("to"), F.round("sim", 12).alias("cosine")).where(F.col("cosine") >= least)


def leaders(points: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(place, to, cosine): to and cosine are null for points that are leaders. In the order of places a point follows the most similar leader
    before it, or the most similar known row, that shares a tag and has a cosine of `least`; else it is a leader. Points (place, tags, vec,
    copy): copy is the same for points with equal tags and vec. Places of known rows are below those of points. Points without tags are leaders."""
    safe_unions(points.sparkSession)
    tagged = points.where(F.size("tags") > 0)
    first = tagged.groupBy("copy").agg(F.min("place").alias("place")).select("place")
    left = tagged.join(first, "place", "left_semi")
    left = cut(left.join(nearest_before(left, known, least), "place", "left_anti").select("place", "tags", "vec"), "undecided")
    chosen = None
    while not left.isEmpty():
        new = cut(left.join(nearest_before(left, left, least), "place", "left_anti"), "leaders")
        rest = left.join(new, "place", "left_anti")
        left = cut(rest.join(nearest_before(rest, new, least), "place", "left_anti"), "undecided")
        chosen = new if chosen is None else chosen.unionByName(new)
    base = known.select("place", "tags", "vec")
    base = base if chosen is None else base.unionByName(chosen)
    others = tagged.select("place", "tags", "vec") if chosen is None else tagged.select("place", "tags", "vec").join(chosen, "place", "left_anti")
    return points.select("place").join(nearest_before(others, base, least), "place", "left")


def intake(turns: DataFrame, memories: DataFrame, vectors: DataFrame, least: float = memory.DEDUP_COSINE, route_low: bool = True) -> Intake:
    """One run over all sessions (turns: session, turn, role, text), by session and turn, into a store of memories (id, type, status, tags) with vectors
    (id, vec). route_low: captures without signal are discarded. Every prompt has one outcome. Prompts of harnesses are no prompts."""
    p = history.prompts(turns)
    body = F.when(F.col("snippet").isNotNull(), F.concat("text", F.lit("\n\n_Acknowledged:_ "), "snippet")).otherwise(F.col("text"))
    p = p.withColumns({"rule": rules.structural_reject("text"), "tier": rules.capture_tier("text"), "body": body})
    p = p.withColumn("title", t.capture_title("text", "body"))
    p = p.withColumn("id", F.concat(F.lit("mem-"), t.short_hash(F.col("session").cast("string"), F.col("turn").cast("string"))))
    placed = _placed(p, "session", "turn")
    low = (F.col("tier") == "low") & F.lit(route_low)
    kept = placed.where(F.col("rule").isNull())
    tags = memory.extract_tags(kept.select(F.col("place").alias("id"), F.col("text").alias("body"))).groupBy(F.col("id").alias("place")).agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    kept = kept.join(tags, "place", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    points = library.embed(kept.where(~low).withColumn("text", F.concat("title", F.lit("\n\n"), "body"))).withColumn("copy", F.sha2(F.concat("text", F.lit("\0"), F.array_join("tags", " ")), 256))
    points = cut(points.select("place", "id", "session", "turn", "title", "body", "tags", "tier", "vec", "copy"), "captures")
    old = memories.where("type = 'capture' and status in ('active', 'candidate')").join(vectors, "id").select(F.col("id").cast("string").alias("id"), "tags", "vec")
    old = _placed(old, "id", start=_BEFORE)
    found = cut(leaders(points, old, least), "intake")
    names = old.select(F.col("place").alias("to"), F.col("id").alias("target")).unionByName(points.select(F.col("place").alias("to"), F.col("id").alias("target")))
    found = found.join(names, "to", "left").select("place", "target", "cosine")
    out = placed.select("place", "session", "turn", "id", "rule", low.alias("low")).join(found, "place", "left")
    route = F.when(F.col("rule").isNotNull(), "reject").when(F.col("low"), "discard").when(F.col("target").isNotNull(), "append").otherwise("create")
    reason = F.when(F.col("rule").isNotNull(), F.col("rule")).when(F.col("low"), "no signal").when(F.col("target").isNotNull(), "like another").otherwise("new")
    whose = F.when(F.col("rule").isNull(), F.coalesce("target", "id"))
    outcomes = out.select("session", "turn", route.alias("route"), reason.alias("reason"), whose.alias("id"), "cosine")
    columns = ["id", "title", "body", "tags", "tier", "session", "turn"]
    created = points.join(found.where("target is null"), "place", "left_semi").select(*columns)
    dropped = kept.where(low).select(*columns)
    kind = F.when(F.col("correction"), "user_correction").otherwise("user_prompt")
    said = placed.select("session", "turn", kind.alias("kind"), F.substring("text", 1, EXCERPT).alias("excerpt"))
    evidence = outcomes.where("id is not null").select("id", "session", "turn").join(said, ["session", "turn"]).select("id", "session", "turn", "kind", "excerpt")
    return Intake(outcomes, created, dropped, evidence)
