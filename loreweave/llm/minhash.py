"""Near-duplicate detection by b-bit MinHash, confirmed on whole shingle sets.

1. Every text gives its distinct shingle hashes, their digest, PERMS minima and from these a packed signature of
   BITS low bits each and BANDS band keys of ROWS whole minima.
2. Texts with one digest are one class; its smallest doc_id stands for it, so copies are never compared.
3. Classes that share a band key are a bucket. Each is compared with the smallest of its bucket: by size, by bit counts of the packed
   signatures corrected for chance collisions, and if these can reach the threshold on whole sets. Two sets of similarity
   0.85 share no band once in 2.5 million times.
4. Components of the links found so far. A bucket within one component needs nothing more, and in the others pairs of one component
   don't: only members of the smaller components are compared with the rest, first by signatures, then, if these can reach the
   threshold, on whole sets. Large buckets and groups are cut into blocks of bounded weight, and each pair of blocks is a task of its own.
5. Components of all links give the answer.

Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, small_batches
from .components import apart, connected_components
from .words import mix, shingles, slices, split_words, tidied

PERMS, BITS, BANDS, ROWS = 128, 4, 20, 4
#: A group holds at most two blocks of so many members or shingles (one longer set is a block of its own), and of so many signatures.
BLOCK_MEMBERS, BLOCK_SHINGLES, BLOCK_SIGNATURES = 1000, 500_000, 1000
#: Estimates below the threshold by more than so many standard deviations are not confirmed: 6 in 10^9.
SIGMAS = 5.7

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 32, PERMS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint32)


def minima(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(sets, PERMS) uint32: the minimum of each permutation over each set; no set may be empty."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, PERMS), np.uint32)
    v = np.empty_like(x)
    for p in range(PERMS):
        np.multiply(x, _A[p], out=v)
        v += _B[p]
        v ^= v >> np.uint32(15)
        out[:, p] = np.minimum.reduceat(v, first[:-1])
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """Signatures of BITS low bits of each minimum, two to a byte; the minima are scrambled first, as a minimum is a small number."""
    bits = (mix(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return bits[:, ::2] | (bits[:, 1::2] << 4)


def band_keys(low: np.ndarray) -> np.ndarray:
    """(sets, BANDS) int64: ROWS whole minima and the band's number, hashed."""
    rows = low[:, : BANDS * ROWS].reshape(len(low), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
    return key.view(np.int64)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of one packed signature to many, from counts of differing BITS-bit values, corrected for chance
    agreement: of unequal minima one in 2**BITS agrees all the same."""
    x = many ^ one
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    x &= np.uint64(0x1111111111111111)
    agree = 1 - np.bitwise_count(x).sum(axis=1, dtype=np.int64) / PERMS
    chance = 1 / (1 << BITS)
    return (agree - chance) / (1 - chance)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield part, *shingles(split_words(part.column("text"), "space"), width)


def _signatures(width: int):
    def run(batches):
        for part, hashes, first in _sets(batches, width):
            counts, digests = [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                own = np.unique(hashes[a:b])
                counts.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if b > a else None)
            full = np.diff(first) > 0
            low = minima(hashes, np.concatenate([first[:-1][full], first[-1:]])) if full.any() else np.zeros((0, PERMS), np.uint32)
            sigs, bands = iter(pack(low)), iter(band_keys(low))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array([next(sigs).tobytes() if x else None for x in full], pa.binary()),
                    pa.array([next(bands) if x else None for x in full], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "sig", "bands"],
            )

    return tidied(run)


def _whole_sets(width: int):
    def run(batches):
        for part, hashes, first in _sets(batches, width):
            keep = [i for i, c in enumerate(part.schema.names) if c != "text"]
            own = [np.unique(hashes[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(i) for i in keep] + [pa.array(own, pa.binary())], [part.schema.names[i] for i in keep] + ["shingles"])

    return tidied(run)


def _least(percent: int) -> float:
    """Estimates below this are not confirmed."""
    t = percent / 100
    return t - SIGMAS * np.sqrt(t * (1 - t) / PERMS) * 1.05


def _enough(one: int, many: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sizes allow the similarity."""
    return 100 * np.minimum(many, one) >= percent * np.maximum(many, one)


def _likely(percent: int):
    """Pairs (node, hub) whose signatures can reach the threshold."""

    def run(batches):
        for batch in batches:
            one, many = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, PERMS * BITS // 64) for c in ("sig", "hub_sig"))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("hub")], ["node", "hub"]).filter(pa.array(estimate(one, many) >= _least(percent)))

    return tidied(run)


def _confirm_stars(width: int, percent: int):
    """Pairs (node, hub) whose whole sets reach the threshold; rows have the node's text and the hub's set."""

    def run(batches):
        for part, hashes, first in _sets(batches, width):
            yes = []
            for a, b, raw in zip(first[:-1], first[1:], part.column("shingles").to_pylist(), strict=True):
                own, hub = np.unique(hashes[a:b]), np.frombuffer(raw, np.uint64)
                both = int((hub[np.minimum(np.searchsorted(hub, own), len(hub) - 1)] == own).sum())
                yes.append(100 * both >= percent * (len(own) + len(hub) - both))
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("hub")], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return tidied(run)


def _partners(labels: np.ndarray, blocks: np.ndarray, i: int, j: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of block i, with the members of block j (or the later ones of its own) that have another label."""
    one, two = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    for k, a in enumerate(one):
        rest = one[k + 1 :] if i == j else two
        rest = rest[labels[rest] != labels[a]]
        if len(rest):
            yield a, rest


def _smallest(nodes: np.ndarray, root: np.ndarray) -> np.ndarray:
    """(node, smallest node of its root) for each that isn't that itself."""
    small = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(small, root, nodes)
    out = np.stack([nodes, small[root]], axis=1)
    return out[out[:, 0] != out[:, 1]]


def _groups(compare, columns: tuple[str, ...]):
    """compare over the rows of each group (key, i, j), which come one after another; its pairs as (a, b)."""

    def run(batches):
        key, held = None, []

        def flush():
            if len({r[4] for r in held}) < 2:
                return None
            rows = list({(r[3], r[4]): r for r in held}.values())  # a document may stand there twice
            found = compare([np.array(x) if k < 4 else x for k, x in enumerate(zip(*(r[3:] for r in rows), strict=True))], key[1], key[2])
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"]) if len(found) else None

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("group", "i", "j", "block", "node", "label", "n_shingles", *columns)), strict=True):
                if row[:3] != key:
                    if out := flush():
                        yield out
                    key, held = row[:3], []
                held.append(row)
        if out := flush():
            yield out

    return tidied(run)


def _likely_groups(percent: int):
    """Ties between members of a bucket whose signatures can reach the threshold, as (node, smallest node tied)."""

    def compare(rows, i, j):
        blocks, nodes, labels, size, sigs = rows
        sigs = np.stack([np.frombuffer(x, np.uint64) for x in sigs])
        root = np.arange(len(nodes))
        for a, rest in _partners(labels, blocks, i, j):
            rest = rest[root[rest] != root[a]]  # one tie is enough
            rest = rest[_enough(size[a], size[rest], percent)]
            rest = rest[estimate(sigs[a], sigs[rest]) >= _least(percent)] if len(rest) else rest
            if len(rest):
                root[np.isin(root, root[rest])] = root[a]
        return _smallest(nodes, root)

    return _groups(compare, ("sig",))


def _confirm_groups(percent: int):
    """Links between members of a group, as (node, smallest node joined); labels are joined already."""

    def compare(rows, i, j):
        blocks, nodes, labels, _, sigs, sets = rows
        sigs, sets = np.stack([np.frombuffer(x, np.uint64) for x in sigs]), [np.frombuffer(x, np.uint64) for x in sets]
        size = np.array([len(x) for x in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.concatenate([[0], np.cumsum(size)])
        seen = np.zeros(flat.max() + 1, bool)
        root = np.unique(labels, return_index=True)[1][np.unique(labels, return_inverse=True)[1]]
        for a, rest in _partners(labels, blocks, i, j):
            rest = rest[root[rest] != root[a]]
            rest = rest[_enough(size[a], size[rest], percent)]
            rest = rest[estimate(sigs[a], sigs[rest]) >= _least(percent)] if len(rest) else rest
            if not len(rest):
                continue
            own = flat[first[a] : first[a + 1]]
            seen[own] = True
            for at in range(0, len(rest), 1024):
                some = rest[at : at + 1024]
                n = size[some]
                where = np.arange(n.sum()) + np.repeat(first[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                both = np.add.reduceat(seen[flat[where]].astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
                for b in some[100 * both >= percent * (n + size[a] - both)]:
                    if root[b] != root[a]:
                        root[root == root[b]] = root[a]
            seen[own] = False
        return _smallest(nodes, root)

    return _groups(compare, ("sig", "shingles"))


def _dealt(members: DataFrame, weights: list[tuple[str, int]]) -> DataFrame:
    """members (group, node, label, ...) of groups with more than one label, once for each pair of blocks (i, j) that they take part in.

    The commonest label of a group has blocks 0 to p - 1, all others together p to p + q - 1, each with a bounded sum of every
    weight. Pairs within the commonest label are not made, so a group costs its size times the blocks of its smaller part.
    """
    sums = [F.sum(w).alias(f"w{k}") for k, (w, _) in enumerate(weights)]
    labels = members.groupBy("group", "label").agg(*sums)
    parts = ["top.label AS top"]
    for name, part in (("p", "top.w{0}"), ("q", "all{0} - top.w{0}")):
        parts.append("cast(greatest(" + ", ".join(f"ceil(({part.format(k)}) / {most})" for k, (_, most) in enumerate(weights)) + f", 1) AS int) AS {name}")
    whole = labels.groupBy("group").agg(F.max(F.struct(*(f"w{k}" for k in range(len(weights))), "label")).alias("top"), F.count(F.lit(1)).alias("n"), *(F.sum(f"w{k}").alias(f"all{k}") for k in range(len(weights))))
    whole = whole.where("n > 1").selectExpr("group", *parts)
    out = members.join(apart(whole, "group", "top"), "group").withColumn("major", F.col("label") == F.col("top"))
    out = out.withColumn("block", F.when(F.col("major"), F.pmod(F.xxhash64("node"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("node"), F.col("q"))).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.when(F.col("major"), F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1)))
    return out.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("top", "p", "q", "major", "other")


def _by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")


def _some(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    df, got = cut(df, name, n=F.count(F.lit(1)))
    return df, got["n"]


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 3) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than ASCII white space, A-Z taken as a-z; a set holds the distinct `width`-word shingles,
    or the whole sequence of a shorter text. Documents with 100 * intersection >= percent * union are linked;
    component_id is the smallest doc_id reachable, kept says whether it is the row's own. Null, empty and wordless texts
    have no shingles and no links; a row without doc_id is linked with nothing and has no component. Repeated rows stay, each with the same
    answer; rows of one doc_id with different texts are judged by their texts. Other columns are ignored; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets, _ = cut(docs.mapInArrow(_signatures(width), "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"), "signatures")
    classes = sets.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "bands")).alias("r"))
    classes, _ = cut(classes.select("digest", F.col("r.doc_id").alias("node"), "r.n_shingles", "r.sig", "r.bands"), "classes")
    keys = classes.select("node", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    shared, _ = cut(keys.join(apart(hubs, "key", "hub"), "key"), "buckets")

    own = classes.select("node", "n_shingles", "sig")
    hub = classes.select(F.col("node").alias("hub"), F.col("n_shingles").alias("hub_n"), F.col("sig").alias("hub_sig"))
    stars = shared.where("node != hub").select("node", "hub").distinct().join(own, "node").join(hub, "hub")
    stars = stars.where(f"100 * least(n_shingles, hub_n) >= {percent} * greatest(n_shingles, hub_n)").select("node", "hub", "sig", "hub_sig")
    stars, _ = cut(stars.mapInArrow(_likely(percent), "node long, hub long"), "stars")
    hub_sets = _sets_of(docs, stars.select(F.col("hub").alias("node")).distinct(), width).select(F.col("node").alias("hub"), "shingles")
    pairs = stars.join(docs.withColumnRenamed("doc_id", "node"), "node").join(hub_sets, "hub").select("node", "hub", "text", "shingles")
    links, found = _some(pairs.mapInArrow(_confirm_stars(width, percent), "a long, b long"), "links")

    joined = connected_components(links) if found else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = F.coalesce("component", "node").alias("label")
    members = shared.select(F.col("key").alias("group"), "node").join(joined, "node", "left").select("group", "node", label)
    members = _dealt(members.withColumn("one", F.lit(1)), [("one", BLOCK_SIGNATURES)]).join(own, "node")
    ties, n = _some(_by_group(members).mapInArrow(_likely_groups(percent), "a long, b long"), "ties")
    discard(shared, stars)
    if n:
        groups = connected_components(ties)
        members = groups.join(joined.withColumnRenamed("component", "own"), "node", "left").join(own, "node")
        members = members.select(F.col("component").alias("group"), "node", F.coalesce("own", "node").alias("label"), "n_shingles", "sig", F.lit(1).alias("one"))
        members, _ = cut(_dealt(members, [("one", BLOCK_MEMBERS), ("n_shingles", BLOCK_SHINGLES)]), "candidates")
        whole = _sets_of(docs, members.select("node").distinct(), width)
        more, n = _some(_by_group(members.join(whole, "node")).mapInArrow(_confirm_groups(percent), "a long, b long"), "more-links")
        discard(ties, members)
        if n:  # the links found late join what is joined already
            of = lambda end: joined.select(F.col("node").alias(end), F.col("component").alias(f"{end}_own"))
            late = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_own", "a").alias("a"), F.coalesce("b_own", "b").alias("b"))
            late = connected_components(late).select(F.col("node").alias("component"), F.col("component").alias("whole"))
            ends = more.select(F.col("a").alias("node")).unionByName(more.select(F.col("b").alias("node"))).distinct().join(joined, "node", "left_anti")
            joined = joined.unionByName(ends.select("node", F.col("node").alias("component"))).join(late, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    answer = classes.select("digest", "node").join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = sets.select("doc_id", "n_shingles", "digest").join(answer, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of docs that stand for their class, with all their columns: those of the smallest doc_id reachable, all of them where a row
    repeats with its doc_id. Documents without shingles or doc_id stay. Cases as in `near_duplicates`."""
    gone = near_duplicates(docs, percent, width).where("not kept").select(F.col("doc_id").alias("lw_gone")).distinct()
    kept = docs.join(gone, docs.doc_id.eqNullSafe(F.col("lw_gone")), "left_anti")
    return kept


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles): whole sets of some documents, from their texts: they are needed for few, so they aren't kept for all."""
    texts = docs.join(nodes, docs.doc_id == nodes.node).select("node", "text")
    return texts.mapInArrow(_whole_sets(width), "node long, shingles binary")
