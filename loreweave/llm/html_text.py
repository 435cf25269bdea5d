"""Main text of web pages by wrapper induction.

Pages of one host share a template. The host's commonest skeleton is its wrapper; every page's tree is aligned with it by simple
tree matching, which gives each text block a slot. Over all pages of the host each slot has counts: characters, those in links,
blocks, and the texts that stand there again and again. They decide, for the host as a whole:

* a text that stands in one slot on most pages is a constant of the template and goes;
* the content region is the element that holds most of the varying text outside links: from the page's root the search goes on
  into a child as long as one holds most of it. Slots beside the region (menus, adverts, notices, footers, which vary from page to page
  too) go, wherever they stand;
* inside the region, slots that are mostly links go.

What tags and names say (nav, footer, "sidebar", article) only weighs: a slot that calls itself furniture counts a tenth, one in an
article ten times. It decides where the counts are close, and whether a smaller part of the region, such as comments, belongs to it.
A page of a host with few pages, or without the region, is its own wrapper: the same decision over its own counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom
from .common import cut, small_batches
from .words import tidied

#: A text is a constant of its slot if it stands there on so many pages of the host at least, and on this share of them; pages that
#: read the same are one.
LEAST_PAGES, LEAST_SHARE = 4, 0.6
#: A slot with this share of its text in links is a menu.
LINK_SHARE = 0.8
#: The search for the region goes on into a child that holds this share of the text, weighed by names with this factor.
REGION_SHARE, NAME_WEIGHT = 0.7, 10
#: Slots with less than this share of the heaviest one's weight don't tell one page from another.
MINOR_SHARE = 0.1
#: Templates of all hosts together go to every task up to so many bytes; beyond, pages are joined with them by host.
BROADCAST_BYTES = 32 << 20

_HOST = "lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)', 1))"


def _tag(label: str) -> str:
    return re.split("[.#]", label, maxsplit=1)[0]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _dumps(s: dom.Skeleton) -> str:
    return json.dumps([s.labels, s.parents, s.flags], separators=(",", ":"))


@lru_cache(5_000)
def _loads(text: str) -> dom.Skeleton:
    return dom.Skeleton(*json.loads(text))


def _weights(s: dom.Skeleton, own: list[int]) -> list[float]:
    """own numbers of the slots, weighed by what their path is called."""
    factor, out = [1.0] * len(own), [float(own[0])]
    for k in range(1, len(own)):
        up = factor[s.parents[k]]
        if s.flags[k] == dom.NAMED and up >= 1:
            up = 1 / NAME_WEIGHT
        elif s.flags[k] == dom.MAINLY and up == 1:
            up = NAME_WEIGHT
        factor[k] = up
        out.append(own[k] * up)
    return out


def _sums(s: dom.Skeleton, own: list) -> list:
    out = list(own)
    for k in range(len(out) - 1, 0, -1):
        out[s.parents[k]] += out[k]
    return out


def content_slots(s: dom.Skeleton, chars: list[int], linked: list[int], blocks: list[int], pages: int, names: bool = True) -> list[bool]:
    """Which slots of a wrapper are content, from counts over `pages` pages of what varies: characters, those in links, blocks."""
    n, children = len(s.labels), s.children
    free = [max(0, c - x) for c, x in zip(chars, linked, strict=True)]
    if not sum(free):
        return [False] * n
    weight, mass = _sums(s, _weights(s, free) if names else [float(x) for x in free]), _sums(s, free)
    at = 0
    while children[at]:
        best = max(children[at], key=lambda k: weight[k])
        if weight[best] < REGION_SHARE * weight[at] or s.labels[best] == "#text":
            break
        direct = [k for k in children[best] if s.labels[k] == "#text"]
        if sum(free[k] for k in direct) > mass[best] / 2 and s.flags[best] != dom.MAINLY:
            if _tag(s.labels[best]) in dom.PARAGRAPH or sum(blocks[k] for k in direct) > 1.5 * pages:
                break  # a paragraph, or one of several like it
        at = best
    # State of each slot: None outside the region, else whether it stays.
    state: list[bool | None] = [None] * n
    state[at] = True
    article = names and any(s.flags[k] == dom.MAINLY for k in _path(s, at))
    for k in range(1, n):
        up = state[s.parents[k]]
        if up is not None and k != at:
            named = names and s.flags[k] == dom.NAMED and 2 * mass[k] <= mass[at]
            menu = not article and chars[k] > 0 and linked[k] >= LINK_SHARE * chars[k]
            state[k] = up and not named and not menu
    out = [x is True for x in state]
    headings = [k for k in range(n) if _tag(s.labels[k]) == "h1"]
    if not any(out[k] for k in headings):  # the page's own headline may stand before the region
        for k in headings:
            if k < at and not (names and any(s.flags[x] == dom.NAMED for x in _path(s, k))):
                for x in children[k]:
                    out[x] = free[x] > 0
    return out


def _path(s: dom.Skeleton, k: int) -> list[int]:
    out = []
    while k >= 0:
        out.append(k)
        k = s.parents[k]
    return out


def _counts(s: dom.Skeleton, found: list[dom.Block]) -> tuple[list[int], list[int], list[int]]:
    chars, linked, blocks = ([0] * len(s.labels) for _ in range(3))
    for b in found:
        chars[b.slot] += len(b.text)
        linked[b.slot] += min(b.linked, len(b.text))
        blocks[b.slot] += 1
    return chars, linked, blocks


def _reading(s: dom.Skeleton, found: list[dom.Block]) -> int:
    """What tells a page from copies of it: the texts of its heavy slots. Copies may differ in menus, adverts and dates."""
    chars, linked, _ = _counts(s, found)
    weight = _weights(s, [c - x for c, x in zip(chars, linked, strict=True)])
    least = MINOR_SHARE * max(weight)
    return _hash("\n\n".join(b.text for b in found if weight[b.slot] >= least))


def _survey(batches):
    """For each page what tells it from others, its skeleton, and for each slot and text the characters, those in links, and blocks."""
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64()), ("blocks", pa.int32())]))
    for batch in batches:
        rows: list[tuple] = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            s, found = dom.read(page)
            shape, own = _dumps(s), {}
            for b in found:
                x = own.setdefault((b.slot, _hash(b.text)), [0, 0, 0])
                x[0], x[1], x[2] = x[0] + len(b.text), x[1] + min(b.linked, len(b.text)), x[2] + 1
            rows.append((host, _reading(s, found), _hash(shape), shape, [{"slot": k, "text": t, "chars": c, "linked": x, "blocks": n} for (k, t), (c, x, n) in sorted(own.items())]))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), kind]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "page", "shape", "skeleton", "blocks"])


@lru_cache(5_000)
def _aligned(wrapper: str, shape: str) -> tuple[list[int], list[str]]:
    """For each slot of a page the wrapper's slot that it is or is inside, and a name that is the same on all pages of the host."""
    w, s = _loads(wrapper), _loads(shape)
    near, names = dom.align(w, s), []
    for k, at in enumerate(near):
        if at >= 0:
            names.append(str(at))
        else:
            near[k] = near[s.parents[k]]
            names.append(f"{near[k]}+{_hash(names[s.parents[k]] + '/' + s.labels[k])}")
    return near, names


def _slots(batches):
    """The slots of each skeleton of a host, renamed to those of its wrapper."""
    for batch in batches:
        for host, shape, skeleton, wrapper in zip(*(batch.column(c).to_pylist() for c in ("host", "shape", "skeleton", "wrapper")), strict=True):
            near, names = _aligned(wrapper, skeleton)
            n = len(near)
            yield pa.RecordBatch.from_arrays([pa.array([host] * n, pa.string()), pa.array([shape] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(near, pa.int32()), pa.array(names, pa.string())], ["host", "shape", "slot", "near", "name"])


def _decide(batches):
    """The template of each host: its wrapper, which of its slots are content, and its constants."""
    for batch in batches:
        out = []
        for host, wrapper, pages, stats, constants in zip(*(batch.column(c).to_pylist() for c in ("host", "wrapper", "pages", "stats", "constants")), strict=True):
            s = _loads(wrapper)
            chars, linked, blocks = ([0] * len(s.labels) for _ in range(3))
            for x in stats or ():
                chars[x["near"]], linked[x["near"]], blocks[x["near"]] = x["chars"], x["linked"], x["blocks"]
            kept = content_slots(s, chars, linked, blocks, pages)
            out.append((host, wrapper, json.dumps([[k for k, yes in enumerate(kept) if yes], sorted(constants or ())], separators=(",", ":"))))
        columns = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["host", "wrapper", "template"])


def main_text(page: str, wrapper: str | None = None, template: str | None = None) -> str:
    """Content blocks of a page, joined by blank lines; without a template by the page's own counts."""
    s, found = dom.read(page)
    if wrapper and template:
        content, constants = _template(template)
        near, names = _aligned(wrapper, _dumps(s))
        # Content that nothing in the wrapper pairs with stays with the slot around it.
        out = [b.text for b in found if near[b.slot] in content and f"{names[b.slot]} {_hash(b.text)}" not in constants]
        if out or any(near[b.slot] in content for b in found):
            return "\n\n".join(out)
    kept = content_slots(s, *_counts(s, found), 1)
    return "\n\n".join(b.text for b in found if kept[b.slot])


@lru_cache(5_000)
def _template(text: str) -> tuple[frozenset[int], frozenset[str]]:
    content, constants = json.loads(text)
    return frozenset(content), frozenset(constants)


def _extract(batches):
    for batch in batches:
        texts = [main_text(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("html", "wrapper", "template")), strict=True)]
        keep = [batch.column(c) for c in ("page_id", "url")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _small(rows: DataFrame, hosts: DataFrame, on: list[str], kind: str) -> DataFrame:
    """rows joined with a table of hosts, broadcast only if its measured size allows."""
    size = hosts.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(*hosts.columns)))), F.lit(0))).first()[0]
    return rows.join(F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts, on, kind)


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper, template) of each host with LEAST_PAGES pages or more, from pages (host, html)."""
    votes = pages.select("host", "html").mapInArrow(tidied(_survey), "host string, page long, shape long, skeleton string, blocks array<struct<slot int, text long, chars long, linked long, blocks int>>")
    # Copies of a page have one vote, however many they are: else they would make their own text a constant.
    votes = votes.groupBy("host", "page").agg(F.min(F.struct("shape", "skeleton", "blocks")).alias("vote")).select("host", "vote.*")
    votes, _ = cut(votes, "page-votes")
    shapes = votes.groupBy("host", "shape").agg(F.min("skeleton").alias("skeleton"), F.count(F.lit(1)).alias("n"))
    shapes, _ = cut(shapes, "shapes")
    wrappers = shapes.groupBy("host").agg(F.max(F.struct("n", "skeleton")).alias("most"), F.sum("n").alias("pages")).where(f"pages >= {LEAST_PAGES}")
    wrappers, _ = cut(wrappers.select("host", F.col("most.skeleton").alias("wrapper"), "pages"), "wrappers")
    # A skeleton is aligned with its host's wrapper once, not once a page.
    slots, _ = cut(shapes.join(wrappers, "host").select("host", "shape", "skeleton", "wrapper").mapInArrow(tidied(_slots), "host string, shape long, slot int, near int, name string"), "slots")
    blocks = votes.select("host", "shape", F.inline("blocks"))
    by_slot = blocks.groupBy("host", "shape", "slot").agg(*(F.sum(c).alias(c) for c in ("chars", "linked", "blocks")))
    by_text = blocks.groupBy("host", "shape", "slot", "text").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in ("chars", "linked", "blocks")))
    by_text = _small(by_text, slots, ["host", "shape", "slot"], "inner").groupBy("host", "near", "name", "text").agg(*(F.sum(c).alias(c) for c in ("n", "chars", "linked", "blocks"))).where(f"n >= {LEAST_PAGES}")
    constant, _ = cut(by_text.join(wrappers.select("host", "pages"), "host").where(f"n >= {LEAST_SHARE} * pages"), "constants")
    # What varies is all text but the constants.
    less = constant.select("host", "near", *((-F.col(c)).alias(c) for c in ("chars", "linked", "blocks")))
    stats = by_slot.join(slots, ["host", "shape", "slot"]).select("host", "near", "chars", "linked", "blocks").unionByName(less)
    stats = stats.groupBy("host", "near").agg(*(F.sum(c).alias(c) for c in ("chars", "linked", "blocks")))
    # As many entries as a wrapper has slots; and as a page has so many blocks, constants are fewer than a page's blocks / LEAST_SHARE.
    stats = stats.groupBy("host").agg(F.collect_list(F.struct("near", "chars", "linked", "blocks")).alias("stats"))
    constants = constant.groupBy("host").agg(F.collect_list(F.concat_ws(" ", "name", "text")).alias("constants"))
    templates = wrappers.join(stats, "host", "left").join(constants, "host", "left")
    return cut(templates.mapInArrow(tidied(_decide), "host string, wrapper string, template string"), "templates")[0]


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars (code points).

    Blocks of the main text in page order, white space inside each taken as one space, joined by a blank line. Null and empty
    html give an empty text. Pages without a usable url form one host of their own. Every page gets its row, but pages
    that read the same count once among their host's pages; with few such pages nothing is constant. Markup may be broken,
    unfinished or nested to any depth. Repeated rows give equal texts. Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.expr(_HOST).alias("host"))
    rows = _small(pages, induce(pages), ["host"], "left").select("page_id", "url", "html", "wrapper", "template")
    kind, url = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return rows.mapInArrow(tidied(_extract), f"page_id {kind}, url {url}, text string, n_chars long")
