"""SURVEY 3.1 lifecycle end to end on a small JSON-lines corpus."""

import json
import os

from pyspark.sql import functions as F

from toolframe.plans.prepare import PrepareConfig, prepare
from toolframe.sources import readers


def _corpus(d, n, source_tag):
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "part.jsonl"), "w") as f:
        for i in range(n):
            j = i % (n // 2)  # every row appears twice
            calls = [{"name": f"tool_{j % 3}", "arguments": {"k": j}}]
            f.write(json.dumps({"instruction": f"{source_tag} thing {j}", "tool_calls": json.dumps(calls),
                                "text": f"{source_tag}   text\n {j}", "category": source_tag,
                                "num_steps": 1}) + "\n")
            if i % 7 == 0:
                f.write("\n")


def test_prepare_end_to_end(spark, tmp_dir):
    a, b = os.path.join(tmp_dir, "a"), os.path.join(tmp_dir, "b")
    _corpus(a, 40, "x")
    _corpus(b, 12, "y")
    cfg = PrepareConfig(sources=(readers.SourceSpec("a", a), readers.SourceSpec("b", b)),
                        out_dir=os.path.join(tmp_dir, "out"), max_length=16, max_vocab=100)
    out = prepare(spark, cfg)
    split = out["split"]
    # dedup on (instruction, tool_calls) leaves 20 + 6 rows; balance target = max((6 + 20) // 2, min(500, 20)) = 20
    counts = {r["source"]: r["count"] for r in split.groupBy("source").count().collect()}
    assert counts == {"a": 20, "b": 20}
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {
        "train": 32, "validation": 4, "test": 4}
    assert split.filter(F.col("text").contains("  ") | F.col("text").contains("\n")).count() == 0  # P3 applied
    test_raw = spark.read.json(os.path.join(tmp_dir, "out", "test_raw"))
    assert test_raw.count() == 4 and "tool_calls" in test_raw.columns           # K2 keeps structure
    tok = spark.read.parquet(os.path.join(tmp_dir, "out", "tokenized"))
    assert tok.count() == 40
    r = tok.first()
    assert len(r["input_ids"]) == len(r["attention_mask"]) == len(r["labels"]) == 16
    # Prepared test file first; S7: SFT conversations from raw files
    ev = readers.load_eval_examples(spark, os.path.join(tmp_dir, "out", "test_raw"), a, max_samples=3)
    assert ev.count() == 3 and ev.filter(F.col("expected_tool").startswith("tool_")).count() == 3
    conv = readers.load_sft_conversations(spark, a)
    assert conv.count() == 40
    m = conv.first()["messages"]
    assert [x["role"] for x in m] == ["system", "user", "assistant"]
    assert m[2]["content"].startswith("<tool_call>\n{")


def test_clashing_and_missing_ids_lose_no_row(spark):
    from toolframe.plans.prepare import PrepareConfig, prepare_rows
    from toolframe.operators import tokens
    a = spark.createDataFrame([(i, f"a {i} x", "a") for i in range(30)], "row_id long, text string, source string")
    b = spark.createDataFrame([(i, f"b {i} y", "b") for i in range(30)] + [(0, "b 0 y", "b")], "row_id long, text string, source string")
    c = spark.createDataFrame([(f"c {i} z", "c") for i in range(10)] + [("c 0 z", "c")], "text string, source string")
    rows = a.unionByName(b).unionByName(c, allowMissingColumns=True)
    for dupes, want in ((False, 72), (True, 70)):
        cfg = PrepareConfig(sources=(), out_dir="", balance_sources=False, remove_duplicates=dupes, dedup_key=("source", "text"))
        split = prepare_rows(rows, cfg)
        assert split.count() == want == split.select("row_id").distinct().count()
        assert split.where("split = 'train'").count() == int(0.8 * want)
        enc = tokens.encode(split, tokens.build_vocabulary(split), ["row_id", "source"], max_length=8)
        got = enc.collect()
        assert len(got) == want and all(len(r["input_ids"]) == 8 and sum(r["attention_mask"]) == 3 for r in got)
