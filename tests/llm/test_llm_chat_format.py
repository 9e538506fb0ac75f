"""Formatted conversations: exact round trip, spans, masks, templates that rewrite history, long conversations, SQL."""

import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streetlens.llm.chat_format import InstTemplate, Template, common_prefix, format_conversations, format_turns, read_back
from streetlens.llm.queries import ORACLES, op11_chat_format

INST = InstTemplate()
PIECES = st.lists(st.sampled_from([*InstTemplate.CONTROLS, "\\", "]", "[", "<", ">", " ", "\n", "0", "1", "s", "é", "𝔸", ""]), max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), PIECES), PIECES), max_size=7)


@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_round_trip_and_mask(turns):
    made = format_turns(INST, turns, ["assistant"])
    assert made.text == INST.render(turns) and INST.read(made.text) == [tuple(t) for t in turns]
    assert [INST.unescape(made.text[a:b]) for a, b in made.loss] == [t for r, t in turns if r == "assistant"]
    assert len(made.ends) == len(turns) and made.rewritten is None
    starts = [0, *made.ends[:-1]] if turns else []
    assert [INST.read(made.text[a:b]) for a, b in zip(starts, made.ends)] == [[tuple(t)] for t in turns]


@given(st.text("ab", max_size=9), st.text("ab", max_size=9))
def test_common_prefix(a, b):
    n = common_prefix(a, b)
    assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def closing(turns):
    """Adds an end to the whole, so that every turn moves it."""
    return "".join(f"<{r}>{t}" for r, t in turns) + "<end>"


def forgetful(turns):
    """Leaves the thoughts of all assistant turns but the last out."""
    last = len(turns) - 1
    return "".join(f"<{r}>{t if i == last else t.split('</think>')[-1]}\n" for i, (r, t) in enumerate(turns))


def test_rewritten_history():
    turns = [("user", "q"), ("assistant", "<think>a</think>b"), ("user", "r"), ("assistant", "c")]
    made = format_turns(Template(closing), turns, ["assistant"])
    assert made.text == closing(turns) and made.rewritten == 1 and made.loss == []
    made = format_turns(Template(forgetful), turns, ["assistant"])
    assert made.text == forgetful(turns) and made.rewritten == 2 and made.loss == []
    assert made.ends == sorted(made.ends) and made.ends[-1] == len(made.text)
    assert format_turns(Template(forgetful), turns[:2], ["assistant"]).rewritten is None


SCHEMA = "conv_id bigint, turn bigint, role string, text string, part string, position string, `meta.x` string, formatted string"


@pytest.fixture(scope="module")
def chats(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"</s> turn {t} of {c}" * (t % 3)) for c in range(5) for t in range(c)]
    rows += [(100, t, "assistant" if t % 3 else "user", f"[INST] long {t}") for t in range(57)]
    rows += [(101, 0, None, None), (101, None, "user", "no number"), (101, 0, "assistant", "x"), (101, 0, "assistant", "x"), (None, 3, "tool", "no id")]
    rows += [(102, 0, "user", "y" * 300_000), (102, 1, "assistant", "</s>" * 100_000)]
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(4), rows


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        said = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(text for _, role, text in said if role == "assistant")
        text = "".join(f"{role}\n{text}\n" for _, role, text in said)
        whole = INST.render([(role, text) for _, role, text in said])
        out[conv] = (len(said), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole))
    return out


@pytest.mark.parametrize("part_turns", [512, 10, 1])
def test_conversations_of_any_length(chats, part_turns):
    df, rows = chats
    got = read_back(format_conversations(df, INST, part_turns=part_turns), INST).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == expected(rows) and len(got) == len(expected(rows))


def test_parts_know_the_turns_before(chats):
    def first_of_each(turns):
        """A template that needs the turn before: a role is named only where it changes."""
        return "".join(("" if i and turns[i - 1][0] == r else f"<{r}>") + t + "\n" for i, (r, t) in enumerate(turns))

    df, rows = chats
    for size in (512, 7):
        parts = format_conversations(df.filter("conv_id = 100"), Template(first_of_each), part_turns=size).orderBy("part").collect()
        assert len(parts) == -(-57 // size) and all(p.rewritten_turn is None for p in parts)
        assert "".join(p.formatted for p in parts) == first_of_each([r[2:] for r in rows if r[0] == 100])
        masked = [p.formatted[s.start:s.stop] for p in parts for s in p.loss]
        assert masked == [r[3] for r in rows if r[0] == 100 and r[2] == "assistant"]
        assert sum(len(p.turn_ends) for p in parts) == 57


def test_a_hot_conversation_is_dealt_over_tasks(spark):
    """One conversation holds most rows: no task renders more than a part at a time, and parts go to several tasks."""
    from pyspark.sql import functions as F

    hot = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = format_conversations(hot.repartition(4), INST, part_turns=50).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 60 and {p.n_turns for p in parts} == {50} and len({p.task for p in parts}) > 1
    text = "".join(p.formatted for p in sorted(parts, key=lambda p: p.part))
    assert INST.read(text) == [("assistant", f"t{i}") for i in range(3000)]


def test_no_conversations(chats):
    df, _ = chats
    assert read_back(format_conversations(df.limit(0), INST), INST).collect() == []


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001"
    got = op11_chat_format(spark, path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    want = con.execute(ORACLES["op11_chat_format"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
