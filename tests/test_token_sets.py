"""Tokens of long texts against those of tokenize, and the work that they take."""

import time

from pyspark.sql import functions as F

from loreweave.functions import text as t
from loreweave.operators import ranking

VALUES = [
    *["store", "XMLStore_parser", "my-store/other", "red_bolt", "RedBolt redbolts", "boxes/partyHTTP", "parties", "glass", "a_b", "is_store_", "stores\nreds", "HTTPServer2Stores", "", " ", "a", "7", "a b 7 A", "/", "\\", "__", "_-a"],
    *["my_stores\n/x", "my\n_stores", "my_store\r\n", "a_b\x85", "a_b /c_d ", "a_b\x0b", "my_\n", "my__stores-", "-x-ies/y_zes\\boxes_s", "foo-bar baz/a-b", "é_b", "Éa bÉcd", "Kelvin İs", "naïveStores", "ABCd ABcD aBCDe", "A1b2C3", "classes buses asses", "i̇os_as"],
    *["The Stores of XMLs, likes IDs; gasses/fizzes-fuzzes tiesS SSs iOSes", "x" * 50 + "S", "two\n\nlines_of\ntext", "a_b/" * 3 + "C_D", None],
]


def test_token_sets_are_those_of_tokenize(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("int").alias("i"), F.substring("text", 1, 4000).alias("v"))
    for r in df.unionByName(docs).select("v", t.tokenize("v").alias("a"), t.token_set("v").alias("b")).collect():
        assert (r.a is None) == (r.b is None), r
        assert r.a is None or len(r.b) == len(set(r.b)) and set(r.a) == set(r.b), (r.v, set(r.a) ^ set(r.b))


def test_an_index_looks_at_each_word_once(spark):
    """Three million words, most of them alike, in less than half of the time that their tokens one by one take."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(15_000)), lambda k: F.concat(F.lit("words"), (k * k % 97).cast("string"), F.lit(" likes"))))
    docs = spark.createDataFrame(spark.range(100).select(F.col("id").cast("string").alias("path"), F.lit("a title").alias("title"), words.alias("body")).toPandas())

    def seconds(df):
        df.count()
        start = time.monotonic()
        df.write.format("noop").mode("overwrite").save()
        return time.monotonic() - start

    index = ranking.token_index(docs)
    assert index.where("field = 'body'").groupBy("path").count().select("count").distinct().count() == 1
    assert seconds(index) < seconds(docs.select(t.tokenize("body"))) / 2
