"""G1-G10, J4, J5, J10, L7, P14, X4 (FIXTURES F5 checks)."""

import json

import pytest
from pyspark.sql import functions as F

from toolframe.operators import synth, synth_catalog as cat

N = 6000


@pytest.fixture(scope="module")
def gen(spark):
    base = spark.range(N).withColumnRenamed("id", "row_id")
    return synth.generate(base).cache()


def test_template_shares_within_tolerance(gen):
    total = sum(t.weight for t in cat.TEMPLATES)
    got = {r["template"]: r["count"] for r in gen.groupBy("template").count().collect()}
    for t in cat.TEMPLATES:
        p = t.weight / total
        sd = (p * (1 - p) / N) ** 0.5
        assert abs(got.get(t.name, 0) / N - p) < 5 * sd, t.name


def test_multi_share_near_24_8_percent(gen):
    share = gen.filter(F.col("num_steps") > 1).count() / N
    assert abs(share - 30 / 121) < 0.03


def test_same_rows_for_1_and_64_partitions(spark):
    a = synth.generate(spark.range(300).withColumnRenamed("id", "row_id").repartition(1))
    b = synth.generate(spark.range(300).withColumnRenamed("id", "row_id").repartition(64))
    cols = ["row_id", "template", "instruction", F.to_json("tool_calls").alias("c"), F.to_json("tools").alias("t")]
    ra = sorted(tuple(r) for r in a.select(*cols).collect())
    rb = sorted(tuple(r) for r in b.select(*cols).collect())
    assert ra == rb


def test_every_row_exposes_all_tools_and_steps_match(gen):
    rows = gen.select(F.to_json("tools").alias("t"), F.to_json("tool_calls").alias("c"), "num_steps", "text",
                      "instruction", "category").collect()
    all_names = {json.loads(t)["name"] for t in cat.TOOLS_JSON}
    orders = set()
    for r in rows:
        tools = json.loads(r["t"])
        calls = json.loads(r["c"])
        assert {t["name"] for t in tools} == all_names and len(tools) == 25
        assert r["num_steps"] == len(calls)
        assert r["text"].startswith(f"[{r['category']}] USER: {r['instruction']}\nASSISTANT: <tool_call>\n")
        assert r["text"].count("<tool_call>") == len(calls)
        orders.add(tuple(t["name"] for t in tools))
    assert len(orders) > N // 2  # shuffled per row


def test_pair_and_other_are_distinct(gen):
    rows = gen.filter(F.col("template").isin("directions", "calendar_email_reminder", "exchange_rate")) \
        .select("template", F.to_json("tool_calls").alias("c")).collect()
    assert rows
    for r in rows:
        calls = json.loads(r["c"])
        a = calls[0]["arguments"]
        if r["template"] == "directions":
            assert a["origin"] != a["destination"]
        elif r["template"] == "exchange_rate":
            assert a["from_currency"] != a["to_currency"]
        else:
            assert a["attendees"][0] != calls[1]["arguments"]["to"]


def test_optional_arguments_omitted(gen):
    rows = gen.filter(F.col("template") == "book_flight").select(F.to_json("tool_calls").alias("c")).collect()
    keys = [set(json.loads(r["c"])[0]["arguments"]) for r in rows]
    assert any("return_date" in k for k in keys) and any("return_date" not in k for k in keys)
    flights = [json.loads(r["c"])[0]["arguments"] for r in rows]
    assert all(f.get("cabin_class") != "economy" for f in flights)


def test_get_restaurant_info_never_called(gen):
    called = {r[0] for r in gen.select(F.explode(F.transform("tool_calls", lambda c: F.try_variant_get(
        c, "$.name", "string")))).distinct().collect()}
    assert len(called) == 24 and "get_restaurant_info" not in called


def test_undersample_majority_tool(gen):
    out = synth.undersample_majority_tool(gen, 0.25)
    first = F.get_json_object(F.to_json(F.col("tool_calls")[0]), "$.name")
    before = {r[0]: r[1] for r in gen.groupBy(first).count().collect()}
    after = {r[0]: r[1] for r in out.groupBy(first).count().collect()}
    top = max(before, key=lambda k: (before[k], k))
    assert after[top] < before[top] * 0.4
    assert all(after[k] == before[k] for k in before if k != top)


def test_text_form_equals_to_json_and_prints_no_definition_per_row(spark):
    base = spark.range(400).withColumnRenamed("id", "row_id")
    texts = synth.generate(base, as_text=True)
    want = synth.generate(base).withColumns({c: F.to_json(c) for c in ("tools", "tool_calls")})
    assert texts.columns == want.columns and sorted(texts.collect()) == sorted(want.collect())
    plan = texts.select("tools")._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and "parse_json" not in plan  # 25 definitions, printed when the query is planned


def test_a_phrase_is_drawn_once(spark):
    plan = synth.generate(spark.range(5).withColumnRenamed("id", "row_id")).select("instruction")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", __phrase)") == 1  # not in each branch of each template's choice
