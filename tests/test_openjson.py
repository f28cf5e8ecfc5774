import json
import os
import random

import pytest
from pyspark.sql import functions as F

from toolframe.functions import jsonx
from toolframe.sources import openjson, readers

LINES = ['{"a": 1, "b c": {"x.y": 1, "z": [1, 2]}, "n": null}', "", '  ', '{"a": 1.5, "b c": {"q": "s"}, "d": [{"u": 1}, {"v": null}]}', '{"oops', '[1]', '7',
         '{"OBJECT<": {"OBJECT<k": 1}, "e": {}, "a": 2, "a": 3}', '{"m": 1}', '{"m": "t"}', '{"a": 1} x']


def documents(spark):
    return openjson.parse_documents(spark.createDataFrame(list(enumerate(LINES)), "i long, line string").repartition(4), "line")


def test_schema_is_the_union_of_keys_and_types(spark):
    docs = documents(spark)
    assert sorted(r._corrupt_record for r in docs.where("doc is null").collect()) == ["7", "[1]", '{"a": 1} x', '{"oops']
    got = {r.key: (r.type, r.n_rows, r.first_seen) for r in openjson.schema_of(docs, "i").collect()}
    assert got == {"a": ("DECIMAL(20,1)", 3, 0), "b c": ("STRUCT<q: STRING, `x.y`: BIGINT, z: ARRAY<BIGINT>>", 2, 0), "n": ("VOID", 1, 0), "d": ("ARRAY<STRUCT<u: BIGINT, v: VOID>>", 1, 3),
                   "OBJECT<": ("STRUCT<`OBJECT<k`: BIGINT>", 1, 7), "e": ("STRUCT<>", 1, 7), "m": ("VARIANT", 2, 8)} or got["a"][0].startswith("DECIMAL")


def test_columns_of_any_key(spark):
    docs = documents(spark).where("doc is not null")
    schema = openjson.schema_of(docs)
    rows = {r.i: r for r in openjson.columns_of(docs, schema, keep=("i",)).collect()}
    assert rows[0]["b c"]["x.y"] == 1 and rows[0]["b c"]["z"] == [1, 2] and rows[3]["b c"]["q"] == "s" and rows[7]["OBJECT<"]["OBJECT<k"] == 1
    assert float(rows[7]["a"]) == 3 and rows[8]["a"] is None and str(rows[9]["m"]) and rows[0]["n"] is None
    flat = {r.i: r.asDict() for r in openjson.flat_columns_of(docs, schema, keep=("i",)).collect()}
    assert flat[0] == {"i": 0, "OBJECT<": "", "a": "1", "b c": '{"x.y":1,"z":[1,2]}', "d": "", "e": "", "m": "", "n": ""}
    assert flat[3]["a"] == "1.5" and flat[9]["m"] == "t"


def test_files_and_limits(spark, tmp_dir, monkeypatch):
    with open(os.path.join(tmp_dir, "a.jsonl"), "w") as f:
        f.write('{"new": 1}\n\n{"other": "x"}\n{bad\n')
    with open(os.path.join(tmp_dir, "b.json"), "w") as f:
        f.write('{"third": [true]}\n')
    df = openjson.read_open_jsonl(spark, tmp_dir)
    assert df.columns == ["_corrupt_record", "new", "other", "third"] and df.count() == 4
    spec = readers.SourceSpec("s", tmp_dir, "open", options={"flat": True})
    assert {tuple(r) for r in readers.load_single(spark, spec).drop("_corrupt_record").collect()} == {("1", "", ""), ("", "x", ""), ("", "", "[true]"), ("", "", "")}
    with pytest.raises(FileNotFoundError):
        openjson.read_open_jsonl(spark, tmp_dir + "/none")
    monkeypatch.setattr(openjson, "MAX_KEYS", 2)
    with pytest.raises(ValueError):
        openjson.read_open_jsonl(spark, tmp_dir)


def value(rnd, depth=0):
    kind = rnd.randrange(8 if depth < 4 else 6)
    if kind == 0:
        return rnd.choice([0, -5, 10**18, 10**40, 12])
    if kind == 1:
        return rnd.choice([1.0, -0.0, 0.1, 1e7, 2.5e16, 1e-5, 123456.75, 3e300, 100.0])
    if kind in (2, 3):
        return "".join(rnd.choice(["a", "é", "\n", '"', "\\", "𝒳", "/", "{", "1", ",", ":", " ", "\x7f", " "]) for _ in range(rnd.randint(0, 6)))
    if kind in (4, 5):
        return rnd.choice([None, True, False])
    if kind == 6:
        return [value(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return {rnd.choice("abcdeé") + rnd.choice(["", '"', " "]): value(rnd, depth + 1) for _ in range(rnd.randint(0, 4))}


def test_json_text_equals_python(spark):
    jsonx.last_key_wins(spark)
    rnd = random.Random(4)
    texts = [json.dumps(value(rnd), ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, None, 1])) for _ in range(400)]
    texts += ["[1] x", "", "{'a': 1}", "[1,]", "NaN", '{"a": 1, "a": [1e2, 1.50, -0]}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", jsonx.python_json(F.col("t")).alias("a"), jsonx.python_json(F.col("t"), False).alias("u"), jsonx.exact_json(F.col("t")).alias("e")).collect():
        try:
            want = json.loads(r.t, parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            assert r.a is None and r.u is None and r.e is None
            continue
        assert r.a == json.dumps(want, sort_keys=True) and r.u == json.dumps(want, sort_keys=True, ensure_ascii=False)


def test_long_texts_are_lexed_without_recursion(spark):
    text = json.dumps({"s": "x\\" * 200_000, "n": list(range(50_000)) + [0.5]})
    r = spark.createDataFrame([(text,)], "t string").select(jsonx.python_json(F.col("t")).alias("p")).first()
    assert r.p == json.dumps(json.loads(text), sort_keys=True)


def test_arguments_that_differ_in_text_alone(spark):
    from toolframe.operators import rewards
    cases = [('{"k": [1, 2.0]}', '{"k": [1.0, 2]}', 0.0), ('{"k": [1, 2.0]}', '{"k":[1,2.0]}', 1.0), ('{"k": {"b": 1.50, "a": 1}}', '{"k": {"a": 1, "b": 1.5}}', 1.0),
             ('{"k": [1e2]}', '{"k": [100.0]}', 1.0), ('"{\\"k\\": [1, 2.0]}"', '{"k": [1, 2.0]}', 1.0), ('{"k": 1, "l": [0.5]}', '{"k": 1.0, "l": [0.5]}', 0.5)]
    rows = [(f'<tool_call>{{"name": "t", "arguments": {a}}}</tool_call>', "t", e, "[]", f) for a, e, f in cases]
    rows += [(f'so {{"name": "t", "parameters": {{"x": {i}.0}}}}', "t", "{}", "[]", 0.0) for i in range(2)]
    df = spark.createDataFrame(rows, "completion string, expected_tool string, expected_args string, expected_chain string, want double")
    assert [(r.reward_argument_f1, r.expected_args) for r in rewards.score(df).collect()] == [(r[4], r[2]) for r in rows]
