import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxweave.llm import chat
from tests.compare import difference, duck
from tests.conftest import SMOKE

PIECES = st.lists(st.sampled_from(["[INST]", "[ESCI]", "[/INST]", "</s>", "\\", "\\0", "\\1", "<", "[", "ok", "\n", " ", "😀", ""]), max_size=6).map("".join)
TURNS = "conv_id long, turn long, role string, text string"


def back(spark, rows):
    out = chat.format_turns(spark.createDataFrame(rows, TURNS))
    return out.select("conv_id", "formatted", "loss", chat.parse(F.col("formatted")).alias("turns"), chat.loss_texts(F.col("formatted"), F.col("loss")).alias("texts")).collect()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "[/INST]", "</s>", "a\\0[", ""]), PIECES), min_size=30, max_size=60))
def test_round_trip(spark, turns):
    rows = [(i % 4, i, r, t) for i, (r, t) in enumerate(turns)]
    for got in back(spark, rows):
        want = [(r, t) for c, _, r, t in rows if c == got.conv_id]
        assert [(t.role, t.text) for t in got.turns] == want
        assert got.texts == [t for r, t in want if r == "assistant"]


def test_plain_text_is_not_escaped(spark):
    got = back(spark, [(1, 0, "user", "a < b [c]"), (1, 1, "assistant", "x [/INST] \\ y"), (1, 2, "user", "</s>")])[0]
    assert got.formatted == "[INST]user[/INST]a < b [c]</s>[INST]assistant[/INST]x [/INST] \\ y</s>[ESCI]user[/INST]\\1/s></s>"
    assert [got.formatted[s.start : s.start + s.chars] for s in got.loss] == ["x [/INST] \\ y"]


def test_edges(spark):
    rows = [(None, 0, "user", "n"), (2, None, None, None), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (3, 0, "assistant", "y" * 300_000)]
    got = {r.conv_id: r for r in back(spark, rows)}
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    assert got[None].texts == [] and len(got[3].texts[0]) == 300_000
    assert chat.format_turns(spark.createDataFrame([], TURNS + ", formatted string")).count() == 0


def test_query_equals_sql_and_source(spark):
    assert difference(chat.op5_chat_format(spark, SMOKE), duck(SMOKE), chat.OP5_SQL) is None
    clash = "</s>[INST] ok [/INST]"
    row = chat.op5_chat_format(spark, SMOKE).filter("conv_id = -7").first()
    assert row.n_turns == 2 and row.loss_sha256 == hashlib.sha256(clash.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{clash}\nassistant\n{clash}\n".encode()).hexdigest()


def test_native(spark):
    plan = chat.op5_chat_format(spark, SMOKE)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


@pytest.mark.parametrize("text", ["\\", "\\0", "\\\\1[", "<[\\2"])
def test_escape_is_reversible(spark, text):
    got = spark.range(1).select(chat.escape(F.lit(text)).alias("e"), chat.unescape(chat.escape(F.lit(text))).alias("b")).first()
    assert got.b == text and "<" not in got.e and "[" not in got.e
