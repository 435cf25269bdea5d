"""The record life cycle as event sourcing: a table of commands meets the current state, and gives new state, audit and rejections.

A batch may hold many commands for a record. They are folded in order, each judged over the state that the one before it left; what is refused
comes back with its reason and changes nothing. What depends on other records (a merge's target, the cap on pins) is decided before the fold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as t
from ..sources.spread import safe_unions
from .graph import cut

PIN_CAP = 20
RELATIONS = ("supports", "contradicts", "refines", "depends_on")
#: Types whose audit keeps the former body.
PRESERVED = ("decision", "constraint")
STATE = "id string, type string, status string, title string, body string, version int, confidence double, pinned boolean, source string, supersedes array<string>, updated_ms long, rewritten_ms long, get_count long, last_accessed_ms long"
COMMANDS = "id string, action string, ts long, arg string, body string, type string, source string, reason string, force boolean"
AUDIT = ("id", "version", "ts", "change_type", "prev_body_hash", "prev_body", "reason")


@dataclass(frozen=True)
class Applied:
    state: DataFrame
    audit: DataFrame
    rejected: DataFrame


LIVE = ("active", "candidate")
#: Pin commands judged by one task at a time: each needs the count that the one before it left.
PIN_CHUNK = 200_000
#: Commands are taken in this order, through all records; equal ones one after the other.
ORDER = ("ts", "own", "action", "arg", "body", "new_type", "source", "reason", "force", "key")
#: Actions that decide whether a record is live, or depend on it.
_STATUS = ("deprecate", "restore", "retype", "merge", "trash", "untrash", "redact", "confirm", "rewrite", "promote")


def _refusal(r: dict, c: dict, types: frozenset[str]) -> str | None:
    """Why record r refuses command c; None if it doesn't. What other records have to say (merge, pin) is not asked here."""
    action, status = c["action"], r["status"]
    live, known = status in LIVE, c["new_type"] is None or c["new_type"] in types
    needs = {
        "update": (live, "not active or candidate"),
        "scope": (live, "not active or candidate"),
        "deprecate": (live, "not active or candidate"),
        "evidence": (live, "not active or candidate"),
        "bump": (live, "not active or candidate"),
        "restore": (status == "deprecated", "not deprecated"),
        "retype": (status == "candidate" and known, "not a candidate, or unknown type"),
        "merge": (live and c["arg"] is not None and c["arg"] != r["id"], "both must be active or candidate"),
        "trash": (status not in ("trashed", "purged_redacted"), "already trashed"),
        "untrash": (status == "trashed", "not trashed"),
        "purge": (status == "trashed", "not trashed"),
        "redact": (status != "purged_redacted", "already redacted"),
        "confirm": (status == "candidate" and r["type"] != "capture", "not a candidate, or a capture"),
        "rewrite": (status not in ("merged_into", "trashed", "purged_redacted") and known, "not open to rewriting, or unknown type"),
        "promote": (status == "active", "not active"),
        "pin": (True, ""),
        "unpin": (True, ""),
    }
    ok, why = needs.get(action, (False, "unknown action"))
    return None if ok else why


def _turn(r: dict, c: dict) -> None:
    """What an accepted command does to a record's status and type."""
    action, status = c["action"], r["status"]
    if action in ("retype", "rewrite") and c["new_type"] is not None:
        r["type"] = c["new_type"]
    if action == "rewrite":
        r["status"] = "active" if status == "candidate" else status
    elif action == "untrash":
        r["status"] = "candidate" if r["type"] == "capture" else "active"
    else:
        r["status"] = {"deprecate": "deprecated", "restore": "active", "confirm": "active", "merge": "merged_into", "promote": "merged_into", "trash": "trashed", "redact": "purged_redacted"}.get(action, status)


def _surer(r: dict, c: dict) -> float:
    """The confidence after a step, within its bounds."""
    try:
        step = float(c["arg"] or 0)
    except ValueError:
        step = 0.0
    return min(0.95, max(0.0, r["confidence"] + step)) if math.isfinite(step) else r["confidence"]


def _rest(r: dict, c: dict) -> None:
    """What an accepted command does to the other fields. Called before _turn, which changes the status that it looks at."""
    action = c["action"]
    if action in ("update", "rewrite"):
        r["title"], r["body"] = (r["title"] if c["arg"] is None else c["arg"]), (r["body"] if c["body"] is None else c["body"])
    if action == "confirm" or action == "rewrite" and r["status"] == "candidate":
        r["confidence"] = 1.0
    elif action == "bump":
        r["confidence"] = _surer(r, c)
    elif action in ("pin", "unpin"):
        r["pinned"] = action == "pin"
    elif action == "purge":
        r["body"] = "<purged>"
    elif action == "redact":
        r["title"] = r["body"] = "<redacted>"
    elif action == "absorb":
        r["supersedes"] = r["supersedes"] + ([] if c["own"] in r["supersedes"] else [c["own"]])
        r["body"] = r["body"] if c["body"] is None else c["body"]
    if action == "rewrite":
        r["rewritten_ms"] = c["ts"]
    if action not in ("purge", "redact"):
        r["version"] += 1
        r["updated_ms"] = c["ts"]


def _sorted_streams(rows: DataFrame) -> DataFrame:
    """Rows of a record together and in order, its state first. A record's commands depend on one another, so they are one task's; it reads
    them as they come and holds one record."""
    return rows.repartition("stream").sortWithinPartitions("stream", "kind", *ORDER)


_FACT = "key long, src boolean, dst boolean"
_NAMES = [f.strip().split(" ")[0] for f in STATE.split(",")]
_OUTCOME = f"part string, {STATE}, action string, ts long, reason string, prev_title string, prev_body string, kept boolean, audit_version int, seq long, why string, key long"


def _facts(types: frozenset[str]):
    """Streams to facts on merges: whether the source was live, and whether the target was. A stream ends at a merge that is not decided yet."""

    def run(batches):
        stream, record, open_ = None, None, True
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                if c["stream"] != stream:
                    stream, record, open_ = c["stream"], None, True
                if c["kind"] == 0:
                    record = {"id": stream, "status": c["status"], "type": c["type"]}
                elif not open_:
                    continue
                elif c["asks"]:
                    out.append((c["key"], None, record is not None and record["status"] in LIVE))
                elif record is not None:
                    refused = _refusal(record, c, types)
                    if c["action"] == "merge":
                        out.append((c["key"], refused is None, None))
                        open_ = refused is not None or c["known"] is not None
                    if open_ and refused is None and c["known"] is not False:
                        _turn(record, c)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.bool_()))], ["key", "src", "dst"])

    return run


def _merges(state: DataFrame, c: DataFrame, types: frozenset[str]) -> DataFrame:
    """(key, known) of all merges: whether both records were live when it was their turn. A merge waits for the earlier merges of both; the
    earliest one never waits, and each round decides all whose turn can be told, so rounds are as many as the longest chain of merges."""
    merges = c.where("action = 'merge'")
    decided = c.sparkSession.createDataFrame([], "key long, known boolean")
    left = merges.count()
    if not left:
        return decided
    own = merges.select("stream").union(merges.select("arg")).distinct()
    start = state.join(own.withColumnRenamed("stream", "id"), "id", "left_semi").select(F.col("id").alias("stream"), F.lit(0).alias("kind"), "status", "type")
    moves = c.where(F.col("action").isin(*_STATUS)).join(own, "stream", "left_semi")
    while left:
        told = moves.join(decided, "key", "left").withColumn("asks", F.lit(False))
        asks = merges.where("arg is not null").join(decided, "key", "left_anti").withColumns({"stream": F.col("arg"), "asks": F.lit(True), "known": F.lit(None).cast("boolean")})
        rows = start.unionByName(told.unionByName(asks).withColumn("kind", F.lit(1)), allowMissingColumns=True)
        facts = _sorted_streams(rows).mapInArrow(_facts(types), _FACT).groupBy("key").agg(F.max("src").alias("src"), F.max("dst").alias("dst"))
        new = facts.where("src = false or src and dst is not null").select("key", (F.col("src") & F.coalesce("dst", F.lit(False))).alias("known"))
        decided = cut(decided.unionByName(new.join(decided, "key", "left_anti")), "merges")
        left = merges.count() - decided.count()
    return decided


def _pins(state: DataFrame, c: DataFrame, cap: int) -> DataFrame:
    """(key, known) of all pins and unpins: a pin needs less than cap pinned records when it is its turn, or force. Their turn goes through all
    records, so they are judged chunk after chunk, each by one task that holds its records' flags and the count."""
    rows = c.where("action in ('pin', 'unpin')")
    total, pinned = rows.count(), state.where("pinned").count()
    flags = state.join(rows.select(F.col("stream").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("stream"), "pinned")
    decided = c.sparkSession.createDataFrame([], "key long, known boolean")
    if not total:
        return decided
    chunks = -(-total // PIN_CHUNK)
    placed = cut(rows.repartitionByRange(chunks, *ORDER).withColumn("chunk", F.spark_partition_id()), "pins")

    def judged(count: int):
        def run(batches):
            now, n = {}, count
            for batch in batches:
                out = []
                for x in batch.to_pylist():
                    before = now.get(x["stream"], x["pinned"])
                    after = False if x["action"] == "unpin" else n < cap or bool(x["force"]) or before
                    ok = x["action"] == "unpin" or n < cap or bool(x["force"])
                    n += int(after) - int(before)
                    now[x["stream"]] = after
                    out.append((x["key"], ok, x["stream"], after, int(after) - int(before), len(now)))
                kinds = (pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["key", "known", "stream", "after", "step"])

        return run

    for k in range(chunks):
        own = placed.where(F.col("chunk") == k).join(flags, "stream").repartition(1).sortWithinPartitions(*ORDER)
        found = cut(own.mapInArrow(judged(pinned), "key long, known boolean, stream string, after boolean, step long"), "pinned")
        decided = decided.unionByName(found.select("key", "known"))
        if k + 1 < chunks:
            pinned += found.agg(F.sum("step")).head()[0] or 0
            last = placed.join(found, ["key", "stream"]).groupBy("stream").agg(F.max_by("after", F.struct(*ORDER)).alias("pinned"))
            flags = cut(flags.join(last, "stream", "left_anti").unionByName(last), "flags")
    return decided


def _outcomes(types: frozenset[str]):
    """Streams with all decisions made to outcomes: the record's last state, an audit row for what it accepted, a reason for what it refused."""
    kinds = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(_OUTCOME))}

    def outcome(part: str, **fields) -> dict:
        return {"part": part, **fields}

    def run(batches):
        record, seq = None, 0
        for batch in batches:
            out = []
            for c in batch.to_pylist():
                seq += 1
                if c["kind"] == 0:
                    if record is not None:
                        out.append(outcome("state", **record))
                    record = {n: c[n] for n in _NAMES if n != "id"} | {"id": c["stream"]}
                    continue
                refused = None if c["action"] == "absorb" else _refusal(record, c, types)
                if refused is None and c["known"] is False:
                    refused = "too many pinned" if c["action"] == "pin" else "both must be active or candidate"
                if refused is None and c["action"] == "bump" and _surer(record, c) == record["confidence"]:
                    refused = "confidence stays"
                if refused is not None:
                    out.append(outcome("rejected", id=record["id"], action=c["action"], why=refused, key=c["key"]))
                    continue
                keeps = record["type"] in PRESERVED and c["action"] in ("update", "rewrite", "absorb")
                said = f"merged from {c['own']}" if c["action"] == "absorb" else c["reason"]
                name = "merge" if c["action"] == "absorb" else c["action"]
                out.append(outcome("audit", id=record["id"], action=name, ts=c["ts"], reason=said, prev_title=record["title"], prev_body=record["body"], kept=keeps, audit_version=record["version"] + 1, seq=seq, key=c["key"]))
                _rest(record, c)
                if c["action"] != "absorb":
                    _turn(record, c)
            yield pa.RecordBatch.from_arrays([pa.array([x.get(n) for x in out], t) for n, t in kinds.items()], list(kinds))
        if record is not None:
            yield pa.RecordBatch.from_arrays([pa.array([outcome("state", **record).get(n)], t) for n, t in kinds.items()], list(kinds))

    return run


def create(commands: DataFrame, state: DataFrame) -> Applied:
    """New records: extracted ones are candidates of confidence .5, explicit ones active of 1; action 'discard' is born trashed. Of several for
    one id the first counts; the others, and those whose id is known, are refused."""
    new = cut(commands.where("action in ('create', 'discard')").withColumn("key", F.monotonically_increasing_id()), "created")
    first = new.groupBy("id").agg(F.min(F.struct("ts", "action", "arg", "body", "type", "source", "reason", "force", "key")).alias("c")).select(F.col("c.key").alias("key"))
    own = new.where("id is not null").join(first, "key", "left_semi").join(state.select("id"), "id", "left_anti")
    extracted = F.col("source") == "extracted"
    born = F.when(F.col("action") == "discard", "trashed").when(extracted, "candidate").otherwise("active")
    null = lambda k: F.lit(None).cast(k)
    rows = own.select(
        "id", "type", born.alias("status"), F.col("arg").alias("title"), "body", F.lit(1).alias("version"), F.when(extracted, 0.5).otherwise(1.0).alias("confidence"), F.lit(False).alias("pinned"), "source",
        F.array().cast("array<string>").alias("supersedes"), F.col("ts").alias("updated_ms"), null("long").alias("rewritten_ms"), F.lit(0).cast("long").alias("get_count"), null("long").alias("last_accessed_ms"),
    )
    audit = own.select("id", F.lit(1).alias("version"), "ts", F.lit("create").alias("change_type"), null("string").alias("prev_body_hash"), null("string").alias("prev_body"), "reason")
    refused = new.join(own.select("key"), "key", "left_anti").select("id", "action", F.lit("id exists").alias("why"))
    return Applied(state.unionByName(rows), audit, refused)


def apply(state: DataFrame, commands: DataFrame, types: list[str], cap: int = PIN_CAP) -> Applied:
    """Applies commands on existing records, many to a record, one after the other in ORDER: each is judged by the state that those before it left.
    Every command is in the audit or among the rejected. types are the registered ones; a record merged into another leaves its id there, and a row
    in the other's audit. Unknown ids and actions are rejected, a null ts comes first. ids of the state are taken to be unique."""
    safe_unions(state.sparkSession)
    known_types = frozenset(types)
    mine = commands.where("action is null or action not in ('create', 'discard')")
    c = mine.select(F.col("id").alias("stream"), F.col("id").alias("own"), "action", "ts", "arg", "body", F.col("type").alias("new_type"), "source", "reason", "force")
    c = cut(c.withColumn("key", F.monotonically_increasing_id()), "commands")
    unknown = c.join(state.select(F.col("id").alias("stream")), "stream", "left_anti").select(F.col("stream").alias("id"), "action", F.lit("unknown id").alias("why"))
    c = c.join(state.select(F.col("id").alias("stream")), "stream", "left_semi")
    decided = _merges(state, c, known_types).unionByName(_pins(state, c, cap))
    c = c.join(decided, "key", "left")
    c = cut(c, "decided")
    absorbed = c.where("action = 'merge' and known").withColumns({"stream": F.col("arg"), "action": F.lit("absorb"), "known": F.lit(None).cast("boolean")})
    moves = c.unionByName(absorbed).withColumn("kind", F.lit(1))
    touched = moves.select(F.col("stream").alias("id")).distinct()
    start = state.join(touched, "id", "left_semi").withColumn("kind", F.lit(0)).withColumnRenamed("id", "stream")
    # Fields that both have keep the state's name; a command's own go by another.
    rows = start.withColumnRenamed("body", "state_body").withColumnRenamed("source", "state_source").unionByName(moves, allowMissingColumns=True)
    rows = _sorted_streams(rows).select("*").withColumns({"body": F.coalesce("state_body", "body"), "source": F.coalesce("state_source", "source")}).drop("state_body", "state_source")
    out = cut(rows.mapInArrow(_outcomes(known_types), _OUTCOME), "outcomes")
    new = state.select(*_NAMES).join(touched, "id", "left_anti").unionByName(out.where("part = 'state'").select(*_NAMES))
    # A redaction also takes the bodies and reasons that this batch had kept before it.
    done = out.where("part = 'audit'")
    done = done.join(done.where("action = 'redact'").groupBy("id").agg(F.max("seq").alias("gone")), "id", "left")
    hidden = F.coalesce(F.col("seq") <= F.col("gone"), F.lit(False))
    audit = done.select(
        "id",
        F.col("audit_version").alias("version"),
        "ts",
        F.col("action").alias("change_type"),
        F.when(F.col("action") != "redact", t.body_hash("prev_title", "prev_body")).alias("prev_body_hash"),
        F.when(F.col("kept") & ~hidden, F.col("prev_body")).alias("prev_body"),
        F.when(hidden, "<redacted>").otherwise(F.col("reason")).alias("reason"),
    )
    rejected = out.where("part = 'rejected'").select("id", "action", "why").unionByName(unknown)
    return Applied(new, audit, rejected)


def redact_audit(audit: DataFrame, ids: DataFrame) -> DataFrame:
    """The audit without former bodies of redacted records (id)."""
    out = audit.join(ids.select("id", F.lit(True).alias("gone")).distinct(), "id", "left")
    return out.withColumn("prev_body", F.when(F.col("gone").isNull(), F.col("prev_body"))).drop("gone")


def promote(state: DataFrame, ids: DataFrame, repo: str) -> DataFrame:
    """Copies of records (id) for the global tier, under ids of their own."""
    return state.join(ids.select("id"), "id", "left_semi").withColumn("id", F.concat(F.lit("mem-global-"), t.short_hash(F.lit(repo), "id")))


def link(links: DataFrame, new: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with new ones (src, dst, rel_type) added once, and the refused: unknown relations, links to oneself or to what isn't there."""
    there = state.select("id")
    ok = new.where(F.col("rel_type").isin(*RELATIONS) & (F.col("src") != F.col("dst"))).join(there.withColumnRenamed("id", "src"), "src", "left_semi").join(there.withColumnRenamed("id", "dst"), "dst", "left_semi")
    keys = ["src", "dst", "rel_type"]
    ok = ok.select(*keys).distinct()
    return links.select(*keys).union(ok.join(links, keys, "left_anti").select(*keys)), new.select(*keys).join(ok, keys, "left_anti")


def unlink(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Links without those given."""
    return links.join(gone, ["src", "dst", "rel_type"], "left_anti")


def use(state: DataFrame, gets: DataFrame) -> DataFrame:
    """State with get events (id, ts) counted; recall itself counts nothing."""
    g = gets.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    out = state.join(g, "id", "left")
    return out.withColumn("get_count", F.col("get_count") + F.coalesce("n", F.lit(0))).withColumn("last_accessed_ms", F.greatest("last_accessed_ms", "last")).drop("n", "last")


def latest_version(audit: DataFrame) -> DataFrame:
    """(id, version): the highest version in the audit."""
    return audit.groupBy("id").agg(F.max("version").alias("version"))


def sweep(state: DataFrame, actions: DataFrame, now_ms: int, types: list[str]) -> Applied:
    """Applies aging actions (id, new_status, reason) as commands."""
    null = lambda k: F.lit(None).cast(k)
    c = actions.select("id", F.when(F.col("new_status") == "purged", "purge").otherwise("trash").alias("action"), F.lit(now_ms).cast("long").alias("ts"), null("string").alias("arg"), null("string").alias("body"), null("string").alias("type"), null("string").alias("source"), "reason", F.lit(False).alias("force"))
    return apply(state, c, types)


def sweep_due(now_ms: int, last_ms: int | None) -> bool:
    """Whether a day has passed since the last attempt."""
    return last_ms is None or now_ms - last_ms >= 86_400_000
