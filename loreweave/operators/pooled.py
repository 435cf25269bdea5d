"""Embeddings by a model of choice: vectors of a text's tokens, mean-pooled and scaled to length 1.

A model is a table of tokens with a vector each, stored under its name; its length is the model's own. It goes to each worker once, in a broadcast
whose size is checked, and texts are pooled in batches of bounded size. There is no model file here, so `fit_tokens` makes one from a corpus:
each token's vector is a sum of fixed random directions, one for each word that stands near it, weighed by how rare that word is.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Most numbers of a model (tokens times length): what a broadcast and a worker hold, in four bytes each.
MOST_NUMBERS = 64_000_000
#: Texts that a worker pools at once.
BATCH = 256
TOKEN = r"[\p{L}\p{N}]+"
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _TOKEN.findall((text or "").lower())


def fit_tokens(texts: DataFrame, dim: int = 64, near: int = 2, least: int = 2, seed: int = 1) -> DataFrame:
    """(token, vec) of the tokens that stand `least` times or more in texts (text). A token's context is the words up to `near` places away; each
    place adds the word's own direction of dim signs, taken from its hash, so that counting is all that is shuffled."""
    lists = texts.select(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)).alias("w"))
    counts = lists.select(F.explode("w").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.where(F.col("n") >= least)
    steps = [k for k in range(-near, near + 1) if k]
    around = F.array_compact(F.array(*[F.when((F.col("i") + k >= 0), F.get("w", F.col("i") + k)) for k in steps]))
    placed = lists.select("w", F.posexplode("w").alias("i", "token")).select("token", F.explode(around).alias("beside"))
    pairs = placed.groupBy("token", "beside").agg(F.count(F.lit(1)).alias("c"))
    weighed = pairs.join(counts.withColumnRenamed("token", "beside"), "beside").select("token", "beside", (F.col("c") / F.sqrt(F.col("n").cast("double"))).alias("w"))
    bits = [F.when(F.pmod(F.xxhash64("beside", F.lit(seed), F.lit(d)), F.lit(2)) == 0, F.col("w")).otherwise(-F.col("w")) for d in range(dim)]
    sums = weighed.groupBy("token").agg(*[F.sum(b).alias(f"v{d}") for d, b in enumerate(bits)]).join(kept.select("token"), "token")
    size = F.sqrt(sum((F.col(f"v{d}") * F.col(f"v{d}") for d in range(dim)), F.lit(0.0)))
    return sums.withColumn("size", size).where("size > 0").select("token", F.array(*[(F.col(f"v{d}") / F.col("size")).cast("float") for d in range(dim)]).alias("vec"))


def write_model(model: DataFrame, path: str) -> None:
    """Stores a model (token, vec)."""
    model.select("token", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)


def _load(spark: SparkSession, path: str) -> tuple[list[str], np.ndarray]:
    model = spark.read.parquet(path)
    shape = model.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high")).head()
    if not shape["n"] or shape["low"] != shape["high"]:
        raise ValueError("a model needs tokens, and vectors of one length")
    if shape["n"] * shape["high"] > MOST_NUMBERS:
        raise ValueError(f"the model has {shape['n']} x {shape['high']} numbers, more than the {MOST_NUMBERS} that a worker is given")
    rows = model.orderBy("token").collect()
    return [r["token"] for r in rows], np.array([r["vec"] for r in rows], np.float32)


def embed(texts: DataFrame, path: str, column: str = "text", batch: int = BATCH) -> DataFrame:
    """texts with vec by the model stored at path: the mean of the vectors of a text's known tokens, repeats counted, scaled to length 1; the zero vector
    for a text without any, null texts too."""
    spark = texts.sparkSession
    names, matrix = _load(spark, path)
    shared = spark.sparkContext.broadcast((names, matrix))

    def load():
        known, vectors = shared.value
        place = {token: k for k, token in enumerate(known)}

        def predict(column: np.ndarray) -> np.ndarray:
            if len(column) > batch:
                raise ValueError("a batch is larger than asked for")
            out = np.zeros((len(column), vectors.shape[1]), np.float32)
            for k, text in enumerate(column):
                own = [place[w] for w in tokens(text) if w in place]
                if own:
                    v = vectors[own].astype(np.float64).mean(0)
                    out[k] = v / (np.sqrt(v @ v) or 1.0)
            return out

        return predict

    pool = predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=batch)
    return texts.withColumn("vec", pool(F.coalesce(F.col(column), F.lit(""))))

