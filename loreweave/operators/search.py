"""Full text by phrases: words with their places, folded and stemmed, in texts read once or in a stored index.

A query is split at white space; each part with a letter or digit is a phrase of its words, so `foo-bar` finds foo followed by bar, and a
text has to hold all phrases. Words are runs of letters and digits in lower case, without accents and stemmed (Porter). Letters with one
accent over a basic Latin letter lose it, combining accents go, letters with several stay as they are.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import once

POOL = 50
K1, B = 1.2, 0.75
#: Folders of a stored index; a term is in one of them.
BUCKETS = 64
#: The folder of the sizes of texts, and words of texts that a task works on at once.
SIZES, HELD = -1, 1 << 20
WORD, SEPARATOR = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]+"


# -- words --------------------------------------------------------------------------------------------------------------
@functools.cache
def _accents() -> tuple[str, str]:
    """Letters of one basic Latin letter and one mark, then the marks themselves; and what they become (marks: nothing)."""
    marked = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2000)]
    pairs = [(x, y[0]) for x, y in marked if len(y) == 2 and y[0].isascii() and unicodedata.category(y[1]) == "Mn"]
    return "".join(x for x, _ in pairs) + "".join(map(chr, range(0x300, 0x332))), "".join(y for _, y in pairs)


def folded(text: Column | str) -> Column:
    """Text in lower case without accents; ASCII alone is told by its bytes and left as it is."""
    lower = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.when(F.octet_length(lower) == F.length(lower), lower).otherwise(F.translate(lower, *_accents()))


@functools.lru_cache(1 << 16)
def porter(word: str) -> str:
    """Stem of a word by the published Porter algorithm; letters other than a to z count as consonants, words of more than 64 bytes are left."""
    if len(word) <= 2 or len(word.encode()) > 64:
        return word
    vowel = lambda w, i: w[i] in "aeiou" or w[i] == "y" and i > 0 and not vowel(w, i - 1)
    shape = lambda w: "".join("v" if vowel(w, i) else "c" for i in range(len(w)))

    def measure(w):
        s = shape(w)
        return sum(a == "v" and b == "c" for a, b in zip(s, s[1:], strict=False))

    def cvc(w):
        return len(w) >= 3 and shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    def swap(w, pairs, least):
        for end, new in pairs:
            if w.endswith(end):
                stem = w[: len(w) - len(end)]
                return (stem + new, True) if measure(stem) > least else (w, True)
        return w, False

    w = word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            stem = w[: len(w) - len(end)]
            if w.endswith(end) and "v" in shape(stem):
                w = stem
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    two = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
    three = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
    for table in (two, three):
        w, _ = swap(w, [p.split(":") for p in table.split()], 0)
    for end in "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic ou".split():
        if w.endswith(end):
            stem = w[: len(w) - len(end)]
            if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


def _stem():
    """Stems of words or runs of words (joined by a space)."""

    @F.pandas_udf("string")
    def stem(w: pd.Series) -> pd.Series:
        return w.map(lambda x: " ".join(map(porter, x.split(" "))))

    return stem


def phrases(spark: SparkSession, query: str) -> list[tuple[str, ...]]:
    """The stems of each distinct phrase of a query, in order: a plan's parameter. Parts without a letter or digit are passed over."""
    parts = F.filter(F.split(folded(F.lit(query)), r"\s+"), lambda p: p.rlike(WORD))
    words = F.transform(parts, lambda p: F.filter(F.split(p, SEPARATOR), lambda w: w != ""))
    found = spark.range(1).select(words.alias("p")).head()["p"]
    return list(dict.fromkeys(tuple(porter(w) for w in p) for p in found))


# -- postings -----------------------------------------------------------------------------------------------------------
def _words_of_texts():
    """For texts (source, id, words) a row for each distinct word of a text with its places, and one without a word that has their number."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            first = 0
            ends = batch.column("words").offsets.to_numpy() if batch.num_rows else []
            while first < batch.num_rows:
                # Texts of at most HELD words, or one.
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + HELD, side="right")) - 1)
                part = batch.slice(first, last - first)
                sizes = np.diff(ends[first : last + 1])
                words = part.column("words").flatten().dictionary_encode()
                codes, known = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
                text = np.repeat(np.arange(len(sizes)), sizes)
                places = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                key = text * max(1, len(known)) + codes
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.diff(key[order], prepend=-1))
                at, word = text[order][starts], codes[order][starts]
                some = np.flatnonzero(sizes)
                stems = pa.array([porter(w) for w in known.to_pylist()], pa.string())
                rows = pa.array(np.concatenate([at, some]))
                of = pa.array(np.concatenate([word, np.zeros(len(some), np.int64)]), mask=np.concatenate([np.zeros(len(word), bool), np.ones(len(some), bool)]))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([starts, len(codes) + np.arange(len(some) + 1)]).astype(np.int32)), pa.array(np.concatenate([places[order], sizes[some]]).astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays([part.column("source").take(rows), part.column("id").take(rows), stems.take(of), known.take(of), lists], ["source", "id", "term", "word", "places"])
                first = last

    return run


def _stemmed(texts: DataFrame) -> DataFrame:
    """(source, id, term, word, places): a row for each distinct word of a text; and one with null for term and word, whose only place is the number of
    all words. Texts are read once, and nothing is shuffled."""
    words = texts.select("source", "id", F.filter(F.split(F.coalesce(folded("text"), F.lit("")), SEPARATOR), lambda w: w != "").alias("words"))
    source, key = (texts.schema[c].dataType.simpleString() for c in ("source", "id"))
    return words.mapInArrow(_words_of_texts(), f"source {source}, id {key}, term string, word string, places array<int>")


def postings(texts: DataFrame) -> DataFrame:
    """(source, id, term, pos) of texts (source, id, text): a row for each word, with its place. A null text has none."""
    return _stemmed(texts).where("term is not null").select("source", "id", "term", F.explode("places").alias("pos"))


def write_index(texts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Stores the distinct words of each text as they stand, with their places, by a hash of their term, sorted by it; in the folder of SIZES the
    number of words of each text. A search reads its terms' folders."""
    rows = _stemmed(texts).withColumn("bucket", F.when(F.col("term").isNull(), SIZES).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")))
    spot = F.pmod(F.xxhash64("source", "id"), F.lit(8))  # a frequent term is several files
    rows.repartition("bucket", spot).sortWithinPartitions("bucket", "term", "source", "id").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str, query: str, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Postings of the query's terms, from their folders alone, and the sizes of all texts."""
    terms = sorted({t for p in phrases(spark, query) for t in p})
    hashes = spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int").alias("b"))
    own = sorted({r["b"] for r in hashes.collect()})
    stored = spark.read.parquet(f"{path}/postings")
    rows = stored.where(F.col("bucket").isin(own) & F.col("term").isin(terms)).select("source", "id", "term", "word", "bucket", F.explode("places").alias("pos"))
    return rows, stored.where(F.col("bucket") == SIZES).select("source", "id", F.col("places")[0].cast("long").alias("len"))


def occurrences(rows: DataFrame, wanted: list[tuple[str, ...]]) -> DataFrame:
    """(source, id, phrase, tf): how often each phrase, known by its number, stands in a text. Words of a phrase meet at the place where it
    would begin; a phrase of one word needs no meeting."""
    one = {p[0]: i for i, p in enumerate(wanted) if len(p) == 1}
    long = [(t, i, k) for i, p in enumerate(wanted) if len(p) > 1 for k, t in enumerate(p)]
    out = None
    if one:
        number = F.coalesce(*[F.when(F.col("term") == t, i) for t, i in one.items()])
        out = rows.where(F.col("term").isin(*one)).groupBy("source", "id", number.alias("phrase")).agg(F.count(F.lit(1)).alias("tf"))
    if long:
        places = F.array_compact(F.array(*[F.when(F.col("term") == t, F.struct(F.lit(i).alias("phrase"), F.lit(k).alias("k"))) for t, i, k in long]))
        spread = rows.where(F.col("term").isin(*{t for t, _, _ in long})).select("source", "id", "pos", F.explode(places).alias("p"))
        begun = spread.groupBy("source", "id", F.col("p.phrase").alias("phrase"), (F.col("pos") - F.col("p.k")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
        size = F.element_at(F.array(*[F.lit(len(p)) for p in wanted]), F.col("phrase") + 1)
        met = begun.where(F.col("n") == size).groupBy("source", "id", "phrase").agg(F.count(F.lit(1)).alias("tf"))
        out = met if out is None else out.unionByName(met)
    return out


def _root(stem: str) -> str:
    """What every word with this stem begins with: rules take endings off, and put back no more than an e, an i for a y, or ble for bility."""
    return stem[:-2] if stem.endswith("ble") else stem[:-1] if stem.endswith(("i", "e", "bl")) else stem


def _in_form(rows: DataFrame, forms: dict[str, str]) -> DataFrame:
    """Postings (term, word) whose word has one of its term's forms; terms without any given stay."""
    for term, form in forms.items():
        rows = rows.where((F.col("term") != term) | F.col("word").rlike(f"^(?:{form})$"))
    return rows


def _found(texts: DataFrame, wanted: list[tuple[str, ...]], forms: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """occurrences and sizes from texts themselves: runs of words that begin like a phrase's are cut out by a pattern and counted within their
    text, and only the distinct ones of a text are stemmed."""
    sizes = texts.select("source", "id", F.regexp_count(folded("text"), F.lit(f"{WORD}+")).cast("long").alias("len")).where("len > 0")
    pattern = lambda p: rf"(?<!{WORD})(?=(" + SEPARATOR.join(re.escape(_root(t)) + f"{WORD}*" for t in p) + "))"
    runs = [F.when(F.col("t").contains(_root(p[0])), F.regexp_extract_all("t", F.lit(pattern(p)), 1)).otherwise(F.array().cast("array<string>")) for p in wanted]
    runs = [F.array_sort(F.transform(r, lambda x: F.regexp_replace(x, SEPARATOR, " "))) for r in runs]
    # Generators, so that texts are folded and searched once: filters that Spark puts below an explode would do it again.
    rows = texts.select("source", "id", once(folded("text")).alias("t"))
    rows = rows.select("source", "id", F.explode(F.array(*[F.struct(F.lit(i).alias("phrase"), r.alias("w")) for i, r in enumerate(runs)])).alias("e"))
    # Sorted, a run's count is the way from its first place to the next run's. No filter on stems comes to stand below a count, as it would with a
    # grouping by run: every occurrence would wait for Python with all runs of its text.
    rows = rows.select("source", "id", "e.phrase", F.col("e.w").alias("w")).where("size(w) > 0")
    starts = F.filter(F.transform("w", lambda x, i: F.when((i == 0) | (x != F.get("w", i - 1)), F.struct(x.alias("word"), i.alias("i")))), lambda x: x.isNotNull())
    rows = rows.select("source", "id", "phrase", F.size("w").alias("size"), once(starts).alias("s"))
    counts = F.transform("s", lambda x, k: F.struct(x["word"].alias("word"), (F.coalesce(F.get("s", k + 1)["i"], F.col("size")) - x["i"]).cast("long").alias("n")))
    n = rows.select("source", "id", "phrase", F.explode(counts).alias("c")).select("source", "id", "phrase", "c.word", "c.n")
    by_phrase = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("phrase") + 1)
    if forms:
        formed = [" ".join(f"(?:{forms.get(t, '[^ ]+')})" for t in p) for p in wanted]
        n = n.where(F.coalesce(*[F.when(F.col("phrase") == i, F.col("word").rlike(f"^{f}$")) for i, f in enumerate(formed)]))
    found = n.withColumn("stem", _stem()("word")).where(F.col("stem") == by_phrase([" ".join(p) for p in wanted]))
    return found.groupBy("source", "id", "phrase").agg(F.sum("n").alias("tf")), sizes


# -- ranking ------------------------------------------------------------------------------------------------------------
def top(scored: DataFrame, limit: int) -> DataFrame:
    """The best `limit` of each source, ranks from 0. The bound on the row number is one that Spark applies before the shuffle too."""
    w = Window.partitionBy("source").orderBy(F.desc("score"), "id")
    best = scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return best.select("source", "id", (F.col("n") - 1).alias("rank"), "score")


def _ranked(hits: DataFrame, sizes: DataFrame, count: int, limit: int) -> DataFrame:
    """Texts with all `count` phrases, by BM25. sizes: (source, id, len) of all texts with a word."""
    stats = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("avg"))
    df = hits.groupBy("source", "phrase").agg(F.count(F.lit(1)).alias("df"))
    x = hits.join(df, ["source", "phrase"]).join(sizes, ["source", "id"]).join(stats, "source")
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + F.lit(K1) * (1 - B + F.lit(B) * F.col("len") / F.col("avg")))
    scored = x.groupBy("source", "id").agg(F.sum(weight).alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == count)
    return top(scored, limit)


def _nothing(rows: DataFrame) -> DataFrame:
    return rows.select("source", "id", F.lit(0).alias("rank"), F.lit(0.0).alias("score")).limit(0)


def full_text(index: DataFrame, query: str, limit: int = POOL, sizes: DataFrame | None = None) -> DataFrame:
    """(source, id, rank, score): texts with all phrases of the query, best BM25 first within each source, `limit` of each. index: postings;
    sizes: (source, id, len), needed where index has the query's terms alone. A query without words finds nothing."""
    wanted = phrases(index.sparkSession, query)
    if not wanted:
        return _nothing(index)
    sizes = index.groupBy("source", "id").agg(F.count(F.lit(1)).alias("len")) if sizes is None else sizes
    return _ranked(occurrences(index, wanted), sizes, len(wanted), limit)


def search_index(spark: SparkSession, path: str, query: str, limit: int = POOL, buckets: int = BUCKETS, forms: dict[str, str] | None = None) -> DataFrame:
    """What full_text gives, from an index that write_index has stored at path. forms: stem to a pattern of the words that count as it, in place of all
    words with that stem."""
    rows, sizes = read_index(spark, path, query, buckets)
    return full_text(_in_form(rows, forms or {}), query, limit, sizes)


def search_texts(texts: DataFrame, query: str, limit: int = POOL, forms: dict[str, str] | None = None) -> DataFrame:
    """What full_text gives, from texts (source, id, text) without an index: texts are read once. forms: as in search_index."""
    wanted = phrases(texts.sparkSession, query)
    if not wanted:
        return _nothing(texts)
    hits, sizes = _found(texts, wanted, forms or {})
    return _ranked(hits, sizes, len(wanted), limit)
