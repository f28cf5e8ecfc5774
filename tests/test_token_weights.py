import random

from toolframe.operators import convo, tokens


def test_offsets_cut_the_text(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["a", "é", " ", "\n", "\t", "𝒳", " ", "\x1c", "日"]) for _ in range(rnd.randint(0, 40))) for _ in range(80)] + [None, "", "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {}
    for r in tokens.token_offsets(df, "k").collect():
        assert texts[r.k][r.start: r.end] == r.token
        got.setdefault(r.k, {})[r.i] = r.token
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {i: t.split() for i, t in enumerate(texts) if t and t.split()}


def test_weights_follow_the_last_assistant_turn(spark):
    turns = [(1, 0, "system", "be good"), (1, 1, "user", "hi  there"), (1, 2, "assistant", "first answer"), (1, 3, "assistant", "last\n answer."), (1, 4, "user", "bye"),
             (2, 0, "user", "only me"), (2, 1, None, None), (None, 0, "user", "x"), (None, 1, "assistant", "y z"), (3, 0, "assistant", ""), (4, 0, "tool user", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    got = {}
    for r in convo.token_weights(df).orderBy("i").collect():
        got.setdefault(r.conv_id, []).append((r.token, r.weight))
    assert [t for t, w in got[1] if w] == ["last", "answer."] and len(got[1]) == 14
    assert got[2] == [("user:", 0), ("only", 1), ("me", 1), (":", 0)]
    assert got[None] == [("user:", 0), ("x", 0), ("assistant:", 0), ("y", 1), ("z", 1)]
    assert got[3] == [("assistant:", 0)] and got[4] == [("tool", 0), ("user:", 0), ("a", 1)]
    arrays = {r.conv_id: r.loss_weights for r in convo.loss_weights(df, 6).collect()}
    assert arrays[2] == [0, 1, 1, 0, 0, 0] and arrays[None] == [0, 0, 0, 1, 1, 0] and arrays[1] == [0] * 6 and arrays[3] == [0] * 6
    text = convo.render_turns(df)
    ids = tokens.encode(text, tokens.build_vocabulary(text), "conv_id", max_length=20)
    assert {r.conv_id: sum(r.attention_mask) for r in ids.collect()} == {k: len(v) for k, v in got.items()}


def test_tokens_that_cross_spans_take_the_span_of_their_first_character(spark):
    toks = spark.createDataFrame([(1, 0, 3), (1, 3, 6), (1, 6, 7), (2, 0, 1)], "k int, start long, end long")
    spans = spark.createDataFrame([(1, 2, 5, 1), (1, 5, 5, 9), (1, 6, 9, 3), (3, 0, 9, 1)], "k int, start long, end long, weight int")
    assert sorted(map(tuple, tokens.span_weights(toks, spans, "k").collect())) == [(1, 0, 3, 0), (1, 3, 6, 1), (1, 6, 7, 3), (2, 0, 1, 0)]


def test_no_token_is_shuffled_or_sorted(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "assistant", "c d")], "conv_id long, turn long, role string, text string")
    plan = tokens.token_offsets(convo.render_turns(turns), "conv_id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") <= 1  # the turns' own
    plan = convo.token_weights(turns)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Generate" in above and not any(step in above for step in ("Window", "Sort", "Join", "Aggregate"))


def test_encoding_shuffles_a_block_s_distinct_tokens(spark):
    df = spark.createDataFrame([(i, "a b a " * (i % 4) + (f"w{i}" if i % 2 else "")) for i in range(40)] + [(None, None), (7, "b")], "k int, text string").repartition(3)
    vocab = spark.createDataFrame([("a", 5, 1), ("b", 6, 1), ("w3", 7, 1)], "token string, id int, count long")
    enc = tokens.encode(df, vocab, "k", max_length=6)
    plan = enc._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "posexplode" not in plan
    got = {r.k: (r.input_ids, sum(r.attention_mask)) for r in enc.collect()}
    assert len(got) == 41 and got[None] == ([2] * 6, 0) and got[3] == ([5, 6, 5, 5, 6, 5], 6) and got[4] == ([2] * 6, 0)
    assert got[1] == ([5, 6, 5, 1, 2, 2], 4) and got[7][0][:3] == [5, 6, 6]  # rows of one key are merged, place by place
