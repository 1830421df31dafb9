from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from inkgauge.llm import ending

PIECES = ["All is well", ".", "!”", " ", "\n", "�", "```", "\\begin{a}", "\\end{a}", "\\[", "\\]", "$$", "{", "}", "(", "*" * 30, "\\u00", "&amp", "<b", "</b>", "- item", "a | b", "…", "\t", " ", " ", "x" * 70, "%4", "”", "„", "Ã"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), min_size=40, max_size=40))
def test_what_the_automaton_does_not_pass_is_suspect(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "pair_id bigint, output string")
    read = {r.pair_id for r in ending.suspects(rows).collect()}
    for shape in (None, "list", "table"):
        assert {i for i, t in enumerate(texts) if ending.ending(t, shape)[0] != "whole"} <= read


def test_a_broken_character_before_the_terminator(spark):
    text = "We saw the br�ken bridge."
    assert ending.ending(text, None)[0] == "cut"
    assert ending.suspects(spark.createDataFrame([(1, text)], "pair_id bigint, output string")).count() == 1
