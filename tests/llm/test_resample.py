import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tests.llm.rows import documents
from toolframe.llm import resample


def features(text, orders=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i: i + m]) for m in range(1, orders + 1) for i in range(len(words) - m + 1)]


def bucket(gram, buckets=10_000):
    return zlib.crc32(gram.encode()) % buckets


def plain(docs, target, percent=5, min_words=20, buckets=10_000, seed=42):
    """The contract restated: (doc_id, text) -> (n_features, weight, score), and the drawn in order."""
    source, wanted = Counter(), Counter()
    for _, t in docs:
        source.update(bucket(g, buckets) for g in features(t)[1])
    for t in target:
        wanted.update(bucket(g, buckets) for g in features(t)[1])
    s, t = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets))))
    out, able = [], []
    for i, text in docs:
        n, grams = features(text)
        weight = sum(gain(bucket(g, buckets)) for g in grams)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(grams), weight, score))
        if n >= min_words:
            able.append((-score, -math.inf if i is None else i))
    return out, [None if i == -math.inf else i for _, i in sorted(able)[: percent * len(able) // 100]]


def test_crcs_of_all_runs_of_words():
    rnd = random.Random(3)
    alphabet = ["a", "Z", "é", "日本", " ", "  ", ".", "\n", "0", "𝒳", "\x7f", "q" * 300, "w" * 70_000]
    texts = [None, "", " ", *["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(60)]]
    n, crcs, sizes = zip(*map(resample.running, texts), strict=True)
    got = [Counter() for _ in texts]
    for doc, crc in resample.gram_crcs(np.array(n), list(crcs), list(sizes), 4):
        for d, c in zip(doc.tolist(), crc.tolist(), strict=True):
            got[d][c] += 1
    for t, g in zip(texts, got, strict=True):
        assert g == Counter(zlib.crc32(x.encode()) for x in features(t, 4)[1])


def test_equals_the_contract(spark):
    docs = documents(spark).unionByName(spark.createDataFrame([(None, "alpha beta gamma delta " * 9), (7, "x"), (7, "x"), (7, "the and of " * 10)], "doc_id long, text string"), allowMissingColumns=True)
    target = spark.createDataFrame([("the and of the",), (None,), ("delta gamma Épsilon",)], "text string")
    for percent, words, buckets in ((5, 20, 10_000), (100, 1, 50), (40, 20, 997)):
        rows, drawn = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], percent, words, buckets)
        got = resample.score(docs, target, percent=percent, min_words=words, buckets=buckets).collect()
        assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(rows)
        ranked = sorted((r.rank, r.doc_id) for r in got if r["rank"] is not None)
        assert [i for _, i in ranked] == drawn and [k for k, _ in ranked] == list(range(1, len(drawn) + 1))


def test_whole_rows_and_empty_tables(spark):
    docs = documents(spark).selectExpr("*", "'w' as weight", "9 as rank")
    target = spark.createDataFrame([("alpha beta",)], "text string")
    drawn = resample.resample(docs, target, percent=50)
    want = {r.doc_id for r in resample.score(docs, target, percent=50).where("rank is not null").collect()}
    rows = drawn.collect()
    assert {r.doc_id for r in rows} == want and all(r.row == 1 and isinstance(r.weight, int) for r in rows)
    assert resample.score(docs.where("false"), target).count() == 0
    assert resample.score(docs, target.where("false")).count() == docs.count()


def test_shifts_of_any_length():
    x = np.array([0, 1, 0xDEADBEEF, 0xFFFFFFFF], np.uint32)
    for n in (0, 1, 255, 256, 257, 70_001, (1 << 20) + 3):
        got = resample.shifts().apply(x, np.full(4, n))
        for v, g in zip(x.tolist(), got.tolist(), strict=True):
            assert g == zlib.crc32(b"\0" * n, v) ^ zlib.crc32(b"\0" * n, 0)
