from __future__ import annotations

import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docspark.llm import chat_format as C, queries

MARKS = ["<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|im_turn|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\\\\", "<", "|", "[", "/", ">", "\n", "é", "a b", "$1", ""]


def read_back(spark, turns: list[tuple]):
    rows = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, formatted string, turns int")
    made = C.format_chats(rows).withColumn("turns", C.read_turns(F.col("formatted"))).withColumn("loss", C.read_loss(F.col("formatted"), F.col("loss_spans")))
    return {r.conv_id: r for r in made.collect()}


def test_round_trip_of_control_strings(spark):
    import itertools
    import random

    rng = random.Random(1)
    turns, want = [], {}
    for conv in range(300):
        own = []
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "assistant", "system", "o<|im_sep|>dd\\", ""])
            own.append((role, "".join(rng.choice(MARKS) for _ in range(rng.randint(0, 8)))))
            turns.append((conv, t, *own[-1], "x", 1))
        want[conv] = own
    rng.shuffle(turns)
    for conv, r in read_back(spark, turns).items():
        own = want[conv]
        assert [(x.role, x.text) for x in r.turns] == own
        assert r.loss == "".join(t for role, t in own if role == "assistant")
        spans = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert len(spans) == sum(role == "assistant" for role, _ in own)
        blocks = len(list(itertools.groupby(own, key=lambda x: x[0])))
        assert r.formatted.count(C.START) == r.formatted.count(C.END) == blocks
        assert r.formatted.count(C.TURN) == len(own) - blocks
        assert "</s>" not in r.formatted and "[INST]" not in r.formatted


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(max_size=40)), min_size=1, max_size=5))
def test_round_trip_of_any_text(spark, own):
    own = [(r, t.encode("utf-8", "ignore").decode()) for r, t in own]
    got = read_back(spark, [(1, k, r, t, None, None) for k, (r, t) in enumerate(own)])[1]
    assert [(x.role, x.text) for x in got.turns] == own
    assert got.loss == "".join(t for r, t in own if r == "assistant")


def test_odd_rows(spark):
    rows = [(1, 0, "user", None, "", 0), (1, 0, "user", None, "", 0), (1, None, None, "first", "", 0), (None, 3, "assistant", "x" * 200_000, "", 0)]
    got = read_back(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [("", "first"), ("user", ""), ("user", "")]
    assert got[None].loss == "x" * 200_000
    assert read_back(spark, []) == {}


def test_query_has_the_probe(spark, sf_dir):
    got = {r.conv_id: r for r in queries.op5_chat_formatting(spark, sf_dir).collect()}[-7]
    say = "</s>[INST] ok [/INST]"
    assert got.n_turns == 2 and got.loss_chars == len(say) and got.loss_sha256 == hashlib.sha256(say.encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256(f"user\n{say}\nassistant\n{say}\n".encode()).hexdigest()


def test_plan_has_no_python(spark, sf_dir):
    plan = queries.op5_chat_formatting(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
