"""Quality rules as a short-circuit cascade, in SQL functions alone.

A rule is a predicate over measures of a text. Each rule's cost (seconds a row) and selectivity (share of rows it rejects) are
measured on a bounded sample; rules then run in order of rejections per second, and a measure is taken only of rows that no earlier
rule has rejected. The order changes the cost alone: a row is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows of the sample that costs and selectivities are measured on.
SAMPLE_ROWS = 1000
WINDOW = 8
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    name: str
    measures: tuple[str, ...]
    rejects: str  # SQL over the measures


#: The first two are the base rules; the others reject junk that clean prose is far from.
RULES = (
    Rule("few_words", ("words",), "n_words < 20"),
    Rule("repeats", ("words", "repeats"), "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", ("words", "symbols"), "10 * n_symbols > word_chars"),
    Rule("duplicate_lines", ("lines",), "n_lines >= 4 and 10 * n_dup_lines > 5 * n_lines"),
    Rule("word_length", ("words",), "n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words)"),
    Rule("capitals", ("capitals",), "n_letters >= 100 and 10 * n_capitals > 7 * n_letters"),
)
BASE = ("few_words", "repeats")


def _fence() -> Column:
    """Always true, but not deterministic: a filter moves below a projection only if all of that is deterministic, and moved
    below the measures it would repeat them within itself, once for each use of each step."""
    return F.monotonically_increasing_id() >= 0


def _measure_words(df: DataFrame) -> DataFrame:
    # Words are held in a column of their own, so they are split once however often they are used.
    df = df.withColumn("q_words", F.when(_fence(), F.array_remove(F.split("q_text", _SPACE), "")))
    chars = F.aggregate("q_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w))
    return df.withColumns({"n_words": F.size("q_words").cast("long"), "word_chars": chars})


def _shifted(name: str, by: int) -> tuple[Column, Column]:
    n = F.greatest(F.size(name) - by, F.lit(0))
    return F.slice(name, 1, n), F.slice(name, by + 1, n)


def _measure_repeats(df: DataFrame) -> DataFrame:
    """Words inside windows found twice or more: windows are hashed by doubling, sorted, and neighbours compared."""
    df = df.withColumn("q_hash", F.when(F.col("n_words") > WINDOW, F.transform("q_words", lambda w: F.xxhash64(w))))
    by = 1
    while by < WINDOW:
        df = df.withColumn("q_hash", F.zip_with(*_shifted("q_hash", by), lambda a, b: F.xxhash64(a, b)))
        by *= 2
    df = df.withColumn("q_sorted", F.when((F.size(F.array_distinct("q_hash")) < F.size("q_hash")) & _fence(), F.array_sort(F.transform("q_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # Whether a window equals the next in order of hashes, then whether it equals the next or the one before.
    df = df.withColumn("q_next", F.zip_with(*_shifted("q_sorted", 1), lambda a, b: a["h"] == b["h"]))
    again = F.zip_with("q_next", F.concat(F.array(F.lit(False)), "q_next"), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    df = df.withColumn("q_at", F.filter(F.zip_with("q_sorted", again, lambda s, yes: F.when(yes, s["i"])), lambda i: i.isNotNull()))
    df = df.withColumn("q_at", F.when(_fence(), F.array_sort("q_at")))
    covered = F.zip_with("q_at", F.slice("q_at", 2, F.greatest(F.size("q_at") - 1, F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    total = F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, n: a + n), F.lit(0).cast("long"))
    return df.withColumn("n_repeat_words", total)


def _measure_symbols(df: DataFrame) -> DataFrame:
    return df.withColumn("n_symbols", F.regexp_count("q_text", F.lit("[#*$%&|<>]")).cast("long"))


def _measure_lines(df: DataFrame) -> DataFrame:
    df = df.withColumn("q_lines", F.filter(F.split("q_text", "\n"), lambda x: x.rlike(_WORD)))
    n = F.size("q_lines").cast("long")
    return df.withColumns({"n_lines": n, "n_dup_lines": n - F.size(F.array_distinct("q_lines"))})


def _measure_capitals(df: DataFrame) -> DataFrame:
    # q_in is null where a rule has rejected the row: nothing is counted there.
    count = lambda pattern: F.regexp_count("q_in", F.lit(pattern)).cast("long")
    return df.withColumns({"n_letters": count(r"\p{L}"), "n_capitals": count(r"\p{Lu}")})


MEASURES = {"words": _measure_words, "repeats": _measure_repeats, "symbols": _measure_symbols, "lines": _measure_lines, "capitals": _measure_capitals}


def measure(df: DataFrame, names: list[str]) -> DataFrame:
    """df (with q_text, and q_in, which is q_text while no rule has rejected the row) with the named measures, in columns of their own."""
    for name in names:
        df = MEASURES[name](df)
    return df


def _texts(docs: DataFrame) -> DataFrame:
    df = docs.withColumn("q_text", F.coalesce("text", F.lit("")))
    return df.withColumn("q_in", F.col("q_text"))


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, given: tuple[str, ...] = (), where: str | None = None) -> dict[str, tuple[float, float]]:
    """For each rule the seconds a row and the share of rows rejected, on a sample of `rows` rows at most; (0, 0) for an empty one.
    Measures that are given cost a rule nothing; where: a condition over them that the sample's rows have to meet."""
    total = docs.count()
    sample = _texts(docs).select("q_text", "q_in").sample(min(1.0, 2 * rows / max(total, 1)), seed=3).limit(rows)
    sample = measure(sample, list(given)).where(where or "true")
    sample, got = cut(sample.drop(*(c for c in sample.columns if c.startswith("q_") and c not in ("q_text", "q_in"))), "quality-sample", n=F.count(F.lit(1)))
    n = got["n"]
    if not n:
        return {r.name: (0.0, 0.0) for r in rules}

    def timed(df: DataFrame, rejects: str) -> tuple[float, int]:
        began = time.perf_counter()
        hits = df.agg(F.count_if(F.expr(rejects))).first()[0]
        return time.perf_counter() - began, hits

    timed(sample, "q_text = ''")
    floor = timed(sample, "q_text = ''")[0]
    out = {}
    for rule in rules:
        seconds, hits = timed(measure(sample, [m for m in rule.measures if m not in given]), rule.rejects)
        out[rule.name] = (max(seconds - floor, 1e-4) / n, hits / n)
    return out


def ordered(estimates: dict[str, tuple[float, float]], rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by rejections per second, most first; ties by name."""
    return sorted(rules, key=lambda r: (-(estimates[r.name][1] / (estimates[r.name][0] or 1.0)), estimates[r.name][0], r.name))


def cascade(docs: DataFrame, order: list[Rule]) -> DataFrame:
    """docs (with text) without the rows that a rule rejects; q_text and the measures of the rules stay beside docs' columns.

    Each rule is a filter of its own, and what it measures is measured of the rows that are still in.
    """
    df, done = _texts(docs), set()
    for k, rule in enumerate(order):
        df = measure(df, [m for m in rule.measures if m not in done]).withColumn(f"q_in{k}", _fence())
        done |= set(rule.measures)
        df = df.where(f"not coalesce({rule.rejects}, false) and q_in{k}")
    return df


def judge(df: DataFrame, order: list[Rule], given: tuple[str, ...]) -> DataFrame:
    """df (with given measures, q_text and q_in) with q_kept, whether no rule rejects the row. All rows stay; a rule measures those that
    no earlier rule has rejected, and of the others nothing."""
    done = set(given)
    df = df.withColumn("q_kept", F.col("q_in").isNotNull())
    for rule in order:
        df = measure(df, [m for m in rule.measures if m not in done])
        done |= set(rule.measures)
        df = df.withColumn("q_kept", F.col("q_kept") & ~F.coalesce(F.expr(rule.rejects), F.lit(False)) & _fence())
        df = df.withColumn("q_in", F.when(F.col("q_kept") & _fence(), F.col("q_in")))
    return df


#: Measures that the report gives of every row, and the base rules over them.
REPORTED = ("words", "repeats", "symbols", "lines")
OWN_RULES = tuple(r for r in RULES if r.name not in BASE)
BASE_FAILED = " or ".join(f"({r.rejects})" for r in RULES if r.name in BASE)


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    The reported measures are taken of every row. The method's own rules go in the order that a sample of rows that pass the base rules
    gives, and what else they measure is measured of rows that are still in. Null and empty texts have no words and fail the base
    rules. Repeated rows are judged each time; texts may be of any length; other columns are ignored, an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    order = ordered(estimate(docs, OWN_RULES, given=REPORTED, where=f"not ({BASE_FAILED})"), OWN_RULES)
    df = measure(_texts(docs), list(REPORTED)).withColumn("base_failed", F.expr(f"({BASE_FAILED}) and monotonically_increasing_id() >= 0"))
    df = judge(df.withColumn("q_in", F.when(~F.col("base_failed") & _fence(), F.col("q_text"))), order, REPORTED)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("q_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns; cases as in `report`."""
    names = docs.columns
    bare = docs.select(F.struct(*names).alias("q_row"), F.col("text"))  # no column of docs can clash with a measure
    return cascade(bare, ordered(estimate(docs))).select("q_row.*")
