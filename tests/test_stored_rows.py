"""What a stored index of texts moves: rows for the distinct words of a text, not for its words."""

from loreweave.operators import search

from .test_pairs import shuffled


def test_repeated_words_are_one_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "HELD", 1000)
    texts = [("s", i, "the cat of the the nights-night " * 100) for i in range(40)] + [("s", 100, None), ("s", 101, "?!"), ("s", 102, "ï" * 70 + " café")]
    frame = spark.createDataFrame(texts, "source string, id long, text string")

    def stored():
        search.write_index(frame, str(tmp_path / "i"))
        return search.read_index(spark, str(tmp_path / "i"), "the cat")[1]

    sizes, moved = shuffled(spark, stored)
    assert {r.id: r.len for r in sizes} == {**{i: 700 for i in range(40)}, 102: 2} and moved < 43 * 8
    rows, _ = search.read_index(spark, str(tmp_path / "i"), "the")
    assert rows.groupBy("id").count().where("count = 300").count() == 40
    assert [r.pos for r in rows.where("id = 7").orderBy("pos").limit(4).collect()] == [0, 3, 4, 7]
