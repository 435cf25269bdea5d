"""What a drain asks of bodies, and what it moves of them."""

from loreweave.operators import memory


def test_bodies_are_not_shuffled(spark):
    rows = [(k, "capture", "candidate", f"we always use tabs {k} " * 200) for k in range(50)]
    frame = spark.createDataFrame(rows, "id long, type string, status string, body string")
    got = memory.drain_actions(frame, frame.where("id % 4 = 0").select("body"))
    assert sum(r.reason == "keeper" for r in got.collect()) == 13
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "trimmed" not in plan and "digest" in plan


def test_branches_at_words_are_tried_together():
    import re

    from loreweave.functions import rules

    said = ["x because y", "xbecause y", "sync plan", "resync plan", "a b = c", "  if I recall", "I'm more with it", "that is a [x] pattern", "that is a x pattern", "Let's brainstorm", "diagnosis: z", "none", "we don't go, we", "as much more"]
    for p in (rules.RATIONALE, rules.CONTROL):
        new = rules.at_words(p)
        assert new.count("|\\b") < p.count("|\\b") and [bool(re.search(p, x)) for x in said] == [bool(re.search(new, x)) for x in said]
    assert rules.at_words(r"(?i)^\s*[|(]a\|b|\bc(d|\be)|\bf") == r"(?i)\b(?:c(d|\be)|f)|^\s*[|(]a\|b"
