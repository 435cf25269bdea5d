"""How graph nodes look: category, size, brightness and colour, as columns over kind and a record's fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import colour_hash

#: Colours of clusters in order of their hash, of records by type, and of other nodes by kind.
PALETTE, GLOBAL, OTHER = ("#33ff66", "#2ee6e6", "#ff5fcf", "#5f9fff", "#ff7a4d", "#cba6f7"), "#ffcc33", "#8aa0b6"
TYPE_COLOURS = {"decision": "#39d0ff", "gotcha": "#ff3b5c", "pattern": "#33ff77", "how-to": "#ffd11a", "capture": "#4f7a66"}
KIND_COLOURS = {"project": "#ffd11a", "dir": "#2ee6e6", "file": "#39d0ff", "symbol": "#c77dff"}
KIND_SIZES = {"project": 12.0, "dir": 8.0, "file": 5.0}


def _is_memory() -> Column:
    return F.col("kind") == "memory"


def _one_of(of: Column, values: dict, other) -> Column:
    out = F.lit(other)
    for k, x in values.items():
        out = F.when(of == k, F.lit(x)).otherwise(out)
    return out


def cluster_colour(cluster: Column | str) -> Column:
    c = F.col(cluster) if isinstance(cluster, str) else cluster
    at = (F.pmod(colour_hash(c), F.lit(len(PALETTE))) + 1).cast("int")
    return F.when(c == "global", GLOBAL).otherwise(F.element_at(F.array(*map(F.lit, PALETTE)), at))


def node_category() -> Column:
    """A record's type, else the node's kind."""
    return F.when(_is_memory(), F.coalesce("type", F.lit("other"))).otherwise(F.col("kind"))


def node_colour() -> Column:
    return F.when(_is_memory(), _one_of(F.col("type"), TYPE_COLOURS, OTHER)).otherwise(_one_of(F.col("kind"), KIND_COLOURS, OTHER))


def node_alpha() -> Column:
    """Records shine by confidence, captures hardly, other nodes alike."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5))))
    return F.when(~_is_memory(), 0.95).when(F.col("type") == "capture", 0.16).otherwise(F.lit(0.4) + F.lit(0.6) * sure)


def node_size() -> Column:
    """Records by pin, use and confidence, from 2.5 to 18; captures are small, other nodes go by kind."""
    own = F.lit(2.0) + F.coalesce(F.col("pinned").cast("int"), F.lit(0)) * 7 + F.log2(F.coalesce("get_count", F.lit(0)) + 1) * 2.2 + F.coalesce("confidence", F.lit(0.5)) * 6
    return F.when(~_is_memory(), _one_of(F.col("kind"), KIND_SIZES, 4.0)).when(F.col("type") == "capture", 2.5).otherwise(F.least(F.lit(18.0), F.greatest(F.lit(2.5), own)))
