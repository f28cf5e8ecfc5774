"""The corpus pipeline stage by stage against plain restatements, and run() as their chain."""

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.rows import base_spans
from tests.llm.test_table_ops import brute_components
from tests.llm.test_text_ops import brute_lines
from toolframe.llm import langid, packing
from toolframe.llm.common import written
from toolframe.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    odd = spark.createDataFrame([(9000, None, "en", "s", None), (9001, "", None, None, 0), (9002, "1234 !!", "en", "s", 7), (9003, "Of the and is", None, "s", 13)], docs.schema)
    docs = written(docs.unionByName(odd), "docs")
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_names_and_columns(stages, spark):
    assert [n for n, _, _ in stages] == ["language ID", "line dedup", "MinHash near-dedup", "PII", "packing"]
    want = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == want for _, _, after in stages[:-1])


def test_language_stage_drops_what_speaks_for_no_language(stages):
    _, before, after = stages[0]
    kept, prototypes = rows(after), langid.train(before)
    for d, r in rows(before).items():
        vector, some = langid.bundles([r["text"] or ""], langid.DIMENSIONS)
        best = max((float(vector[0] @ p) / ((vector[0] @ vector[0]) ** 0.5 * (p @ p) ** 0.5) for p in prototypes.values()), default=0) if some[0] else -1
        k = len(set(langid.trigrams(r["text"] or "").tolist()))
        bound = min(math.sqrt(2 * math.log(len(prototypes) / 1e-4) / 512), 0.036 * math.sqrt(k) - 3 / math.sqrt(512))
        assert (d in kept) == (bool(some[0]) and best >= bound)
        assert d not in kept or kept[d] == r
    assert not {9000, 9001, 9002} & kept.keys() and 9003 in kept


def test_short_noise_goes_too(spark):
    """Ten words of five random letters, and runs of 60 Chinese characters: all but a few of a hundred go; short clean documents stay (above)."""
    rnd = random.Random(11)
    latin = [" ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(10)) for _ in range(200)]
    chinese = ["".join(chr(0x4E00 + rnd.randrange(2000)) for _ in range(60)) for _ in range(200)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = spark.createDataFrame([(9000 + i, t, None, None, len(t)) for i, t in enumerate(latin + chinese)], docs.schema)
    extra = docs.unionByName(noise).selectExpr("*", "'x' as __lang_pred", "1 as __lang_score")
    kept = corpus_pipeline.keep_known_languages(spark, extra, SF)
    assert kept.columns == extra.columns
    left = [d for d in rows(kept) if d >= 9000]
    assert len([d for d in left if d < 9200]) <= 12 and len([d for d in left if d >= 9200]) <= 4


def test_language_stage_drops_noise_and_keeps_clean_texts(spark):
    rnd = random.Random(7)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", [chr(0x4E00 + i) for i in range(2000)]]
    noise = [" ".join("".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(words)) for letters in alphabets for words in (30, 60, 200) for _ in range(10)]
    noise += ["".join(rnd.choices(alphabets[0], k=400)) for _ in range(20)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows_ = [(9000 + i, t, None, None, len(t)) for i, t in enumerate(noise)]
    short = [(8000, "Avec.", "fr", "s", 5), (8001, "Von.", "de", "s", 4), (8002, "Reouti anatha.", "en", "s", 14)]
    kept = rows(corpus_pipeline.keep_known_languages(spark, docs.unionByName(spark.createDataFrame(rows_ + short, docs.schema)), SF))
    clean = {d for d, r in rows(docs).items() if any(c.isalpha() for c in r["text"] or "")}
    assert kept.keys() == clean | {8000, 8001, 8002}


def test_line_stage(stages):
    _, before, after = stages[1]
    want = brute_lines([(d, r["text"]) for d, r in rows(before).items()])
    got = rows(after)
    assert {d: r["text"] for d, r in got.items()} == {d: t for d, (t, _) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and any(n for _, n in want.values())


def test_near_duplicate_stage(stages):
    _, before, after = stages[2]
    want, _ = brute_components([(d, r["text"]) for d, r in rows(before).items()], 0.8)
    assert rows(after) == {d: r for d, r in rows(before).items() if want[d] == d}


def test_near_duplicate_stage_tells_rows_apart(spark):
    """Unrelated texts that share a doc_id, rows without one and repeated rows: one row of each text stays, nothing else goes."""
    say = lambda k, n=40: " ".join(f"{k}w{i}" for i in range(n))
    texts = [(5, say("a")), (5, say("b")), (6, say("b")), (7, say("a") + " tail"), (None, say("c")), (None, say("c")), (8, say("c")), (None, say("d")), (9, None), (9, ""), (5, say("a"))]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts], schema).repartition(3).selectExpr("*", "1 as __n", "2 as component_id")
    out = corpus_pipeline.keep_one_of_each(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(5, say("a")), (5, say("b")), (8, say("c")), (None, say("d")), (9, None), (9, "")], key=str)


def test_personal_data_stage(stages):
    _, before, after = stages[3]
    got, changed = rows(after), 0
    assert got.keys() == rows(before).keys()
    for d, r in rows(before).items():
        spans = [x.split(":") for x in base_spans(r["text"]).split(",") if x]
        assert base_spans(got[d]["text"]) == "" and got[d]["n_chars"] == len(got[d]["text"])
        for kind, a, b in spans:
            assert r["text"][int(a): int(b)] not in got[d]["text"]
            changed += 1
        if not spans and "token" not in r["text"]:
            assert got[d]["text"] == r["text"]
    assert changed


def test_packing_stage_and_run(stages, spark):
    _, before, after = stages[4]
    own = packing.Tokens(tokenizer("byte_bpe_50k.json"))
    want = {d: len(own.encode(r["text"])) // 4 + 1 for d, r in rows(before).items()}
    got = {r["doc_id"]: r["n"] for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want
    plain = corpus_pipeline.run(spark, SF)
    assert set(plain.columns) == set(after.columns) and plain.agg(F.sum("length")).first()[0] > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "empty")
        assert docs.count() == 0
