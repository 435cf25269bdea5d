"""Corrections against their twins on texts that the small tables lack: letters outside ASCII behind a word, rare white space, prompts of a harness, turns given twice."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loreweave.functions import rules
from loreweave.plans import QUERIES, SQL

WORDS = ["no", "No", "NO", "stop", "ſtop", "Don't", "dont", "wait", "actually", "inſtead", "INSTEAD", "but", "now", "not"]
FRONT = ["", " ", "\n\t", "\x0b", "\x0c", " ", "﻿", " ", "\x1c", "\u0085", "ñ", "x ", "<system-reminder>", "\n<command-name>", "\x0b<bash-input>", "# Update Config Skill\n", "﻿# Big Skill\n"]
BEHIND = ["", " th", "ñ", "ésth", "́", "_", "9", "-th", "’", "\n", "é, the", "人", "🧠", "ſ"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    d, c = tmp_path_factory.mktemp("odd"), duckdb.connect()
    texts = [f + w + b for f in FRONT for w in WORDS for b in BEHIND] + [None, "", "\x0b", "# Config Skill", "text with th"]
    pick = random.Random(4)
    rows = [(i % 97 if i % 31 else None, i // 97 if i % 37 else None, pick.choice(["user", "user", "user", "assistant", "system", None]), x) for i, x in enumerate(texts)]
    c.execute("create table conversations (conv_id bigint, turn int, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", rows + rows[::50])
    c.execute(f"copy conversations to '{d}/conversations.parquet' (format parquet)")
    return str(d), c


@pytest.mark.parametrize("name", ["corrections", "evidence_counts", "history_search", "prompt_corrections", "prompt_counts", "prompt_search"])
def test_as_in_the_twin(spark, odd, name):
    d, c = odd
    got, want = QUERIES[name](spark, d), c.execute(SQL[name])
    names = sorted(x[0] for x in want.description)
    assert sorted(got.columns) == names
    want = [dict(zip((x[0] for x in want.description), r, strict=True)) for r in want.fetchall()]
    rows = lambda rs: sorted(tuple(str(r[n]) for n in names) for r in rs)
    assert rows(got.collect()) == rows(want) and want


def test_prompts_of_a_harness_are_no_corrections(spark, odd):
    d, _ = odd
    n = lambda q: QUERIES[q](spark, d).count()
    assert 0 < n("prompt_corrections") < n("corrections") and 0 < n("prompt_search") < n("history_search")


def test_a_letter_outside_ascii_ends_a_word(spark):
    given = [("Noñ que", True), (" no", True), ("ſtop", False), ("now", False), ("no_", False), ("no", True)]
    found = spark.createDataFrame(given, "text string, want boolean").select("want", rules.is_correction(F.col("text")).alias("is")).collect()
    assert all(r["is"] == r["want"] for r in found)
