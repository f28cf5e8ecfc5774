import collections
import datetime
import gzip
import hashlib
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.rows import contract_words, documents
from toolframe.llm import chat, graph, minhash, topk, warc
from toolframe.llm.common import scratch_path, written

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# --- op1

def brute_top(rows, ask, k):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in good:
        if ask(q):
            scores = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(b) == len(a)))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_top_k_against_brute_force(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(0, 0.2, 8)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(12)]  # ties
    rows += [(300, None), (301, [None] + [0.0] * 7), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, []), (None, [0.5] * 8), (305, [0.0] * 8), (310, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("vec_id", "embedding", "1 as id", "2 as v", "3 as rb")
    for block_rows, query_rows in ((10**6, 10**6), (40, 3)):
        got = collections.defaultdict(dict)
        for r in topk.search(df, F.col("vec_id") % 5 == 0, k=5, block_rows=block_rows, query_rows=query_rows).collect():
            got[r.query_id][r.rank] = (r.vec_id, r.score)
        want = brute_top(rows, lambda q: q % 5 == 0, 5)
        want = {q: v for q, v in want.items() if v}
        assert {q: [v[r] for r in sorted(v)] for q, v in got.items()} == want
    assert topk.search(df.where("false"), F.col("vec_id") % 5 == 0).count() == 0
    few = topk.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_index_with_wide_and_constant_components():
    rnd = np.random.default_rng(2)
    values = np.stack([rnd.integers(-10**9, 10**9, 300), np.full(300, 7), rnd.integers(0, 2, 300)], axis=1)
    ids = rnd.permutation(300)
    index = topk.Index(ids, values)
    for q in ([3, -5, 1], [0, 0, 0], [-123456, 2, -1]):
        s = values @ np.array(q)
        order = np.lexsort((ids, -s))[:9]
        assert sorted(index.top(-1, q, 9)) == sorted((int(ids[i]), int(s[i])) for i in order)


# --- op4

def pages(spark):
    long = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(5, "http://a/1", long), (3, "http://a/2", long), (9, None, long), (None, "http://a/n", long), (1, "http://b c\r\nd", "small"), (2, "http://b", "small"),
            (4, "u", None), (6, "u", ""), (7, "u", "é" * 50), (8, "u", "é" * 50), (10, "u", "é" * 49), (11, "u", "é" * 49), (12, "u", long + "!"), (12, "u", long + "!")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "html", "1 as digest", "2 as size", "3 as first")


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(df, path, date=datetime.datetime(2026, 1, 2, tzinfo=datetime.UTC))
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None)
                              for r in warc.read_archives(spark, path, payloads=True).collect())
    want = collections.Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if j is not None and (h or "") == (html or "")]
        again = len(data) >= 100 and i != min(same)
        want[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None, None if again else data] += 1
    assert got == want


def test_archives_are_plain_warc(spark, tmp_path):
    import glob
    _, df = pages(spark)
    path = str(tmp_path / "archives")
    warc.write_archives(df, path)
    heads = [h for f in glob.glob(path + "/part-*") for h, _ in warc.records(warc.inflated(open(f, "rb").read()))]
    assert len(heads) == df.count() and all({"warc-type", "warc-record-id", "warc-date", "content-length"} <= h.keys() for h in heads)
    assert all("warc-refers-to" in h and "warc-profile" in h for h in heads if h["warc-type"] == "revisit")
    empty = str(tmp_path / "empty")
    warc.write_archives(df.where("false"), empty)
    assert warc.read_archives(spark, empty).count() == 0


# --- op7

def brute_components(rows, threshold):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = contract_words(t)
        sets[i].append(frozenset(tuple(w[j: j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = list(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if any(s and t and 100 * len(s & t) >= round(100 * threshold) * len(s | t) for s in sets[a] for t in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, {i: {len(s) for s in v} for i, v in sets.items()}


def family(rnd, size, copies, edits):
    """Copies of copies, each with a few words changed: chains whose ends are unlike."""
    text = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
    out = [text]
    for _ in range(copies):
        t = list(rnd.choice(out))
        for _ in range(rnd.randint(0, edits)):
            t[rnd.randrange(size)] = f"e{rnd.randrange(10**6)}"
        out.append(t)
    return [" ".join(t) for t in out]


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(9)
    texts = [t for size, copies, edits in ((200, 40, 2), (120, 60, 3), (90, 20, 1), (7, 10, 1), (60, 15, 2)) for t in family(rnd, size, copies, edits)]
    shared = " ".join(f"s{i}" for i in range(60))
    texts += [" ".join(f"v{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 60))) + " " + shared for _ in range(60)]
    texts += ["one two", "One  two", "one", "a b c d e", "A B C D E"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts)) + [(5000, None), (5001, ""), (5002, " \n "), (5003, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as id", "2 as n", "3 as value", "4 as root")
    for threshold, close, block in ((0.85, 0.5, 512), (0.85, 0.5, 16), (0.8, 0.42, 512)):
        want, sizes = brute_components(rows, threshold)
        got = {r.doc_id: r for r in minhash.near_duplicates(df, threshold=threshold, close=close, block=block).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.n_shingles in sizes[i] and r.kept == (want[i] == i) for i, r in got.items())


def test_near_duplicates_edges(spark):
    docs = documents(spark)
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (0, "a b c d e f"), (7, "u v w x y z"), (7, "u v w x y z"), (None, "a b c d e f")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, None, True), (0, 0, True), (1, 0, False), (1, 0, False), (7, 0, False), (7, 0, False)]


def test_components(spark):
    rnd = random.Random(10)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(50)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == root
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_forest_looks_at_trees_not_at_pairs():
    """All pairs of a family are good: calls grow with its members, not with their square."""
    def run(ids, labels, good):
        calls = [0]

        def count(frame, event, arg):
            calls[0] += event in ("call", "c_call")
        sys.setprofile(count)
        try:
            out = minhash._forest(ids, labels, good)
        finally:
            sys.setprofile(None)
        return out, calls[0]

    n = 400
    family, used = run(np.arange(n), np.arange(n), np.ones((n, n), bool))
    assert family == [(i, 0) for i in range(1, n)] and used < 30 * n
    rng = np.random.default_rng(3)
    for share in (0.02, 0.1, 0.9):
        for labels in (np.arange(40), rng.integers(0, 15, 40)):
            good = rng.random((40, 40)) < share
            good |= good.T
            ids = rng.permutation(1000)[:40]
            root = labels.tolist()
            for a, b in ((ids.tolist().index(x), ids.tolist().index(y)) for x, y in minhash._forest(ids, labels, good)):
                assert good[a, b] and root[a] != root[b]  # a good pair between two trees: no edge closes a circle
                root = [root[a] if r == root[b] else r for r in root]
            assert all(root[a] == root[b] for a, b in np.argwhere(good).tolist())


def test_star_steps_follow_the_edges_not_the_partitions(spark, monkeypatch):
    from toolframe.operators import components as module
    files, write = [], module.written

    def counted(df, name):
        out = write(df, name)
        files.append(len(out.inputFiles()))
        return out
    monkeypatch.setattr(module, "written", counted)
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = [(i, i + 1) for i in range(300) if i % 10] + [(1000, i) for i in range(1001, 1400)]
        got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    nodes = {x for e in edges for x in e}
    assert got == {x: 1000 if x >= 1000 else (x - 1) // 10 * 10 + 1 for x in nodes}
    assert len(files) > 1 and max(files[1:]) <= spark.sparkContext.defaultParallelism


# --- op10

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "[\\\\INST]", "<|image|>", "<<s>>", "[[INST]]", "\\", "<", "[", "text", " ", "\n", "é𝒳", "<\\", "</s", ">"]


def turns(spark):
    rnd = random.Random(11)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "odd[/INST]</s>"]), "".join(rnd.choice(CONTROL) for _ in range(rnd.randint(0, 9))))
            for c in range(30) for t in range(rnd.randint(1, 6))]
    rows += [(100, 0, "assistant", None), (101, None, "user", "a"), (101, 1, "assistant", "b"), (101, 1, "assistant", "b"), (None, 0, "user", "x"), (102, 0, "assistant", "y" * 200000)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    rows, df = turns(spark)
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    chats = chat.format_conversations(df.withColumn("parts", chat.text_part(F.col("text"))).withColumn("i", F.lit(1)).withColumn("head", F.lit(2)))
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    full = {r.conv_id: r for r in chats.collect()}
    assert got.keys() == by.keys()
    for c, v in by.items():
        v.sort()
        loss = "".join(x for *_, r, x in v if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(v), sha("".join(f"{r}\n{x}\n" for *_, r, x in v)))
        assert (got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(loss), sha(loss), len(full[c].formatted))
        assert full[c].formatted.count("</s>") == len(v) and full[c].formatted.count("[INST]") == len(v) and full[c].formatted.count("<s>") == 1
    assert chat.format_conversations(df.where("false").withColumn("parts", chat.text_part(F.col("text")))).count() == 0


def test_chat_parts_become_placeholders(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = [(1, 0, "user", [("text", "see <|image|> ", None, None, None, None, None), ("image", None, "s3://x.png", 28, 15, None, None), ("audio", None, "a.wav", None, None, 2.5, None), None]),
            (1, 1, "assistant", [("document", None, "d.pdf", None, None, None, 3), ("image", None, None, None, None, None, None), ("odd", "ok", None, None, None, None, None)]),
            (2, 0, "user", None)]
    out = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")).collect()}
    assert out[1].formatted == "<s>[INST]user[/INST]see <\\|image|> <|image|><|audio|></s>[INST]assistant[/INST]<|document|><|image|>ok</s>"
    assert [(a.turn_index, a.part_index, a.type, a.ref, a.tokens) for a in out[1].attachments] == [
        (0, 1, "image", "s3://x.png", 4), (0, 2, "audio", "a.wav", 63), (1, 0, "document", "d.pdf", 768), (1, 1, "image", None, 1)]
    assert out[1].attachment_tokens == 836 and out[2].formatted == "<s>[INST]user[/INST]</s>" and out[2].attachments == []
    s = out[1].loss_spans[0]
    assert out[1].formatted[s.start: s.start + s.length] == "<|document|><|image|>ok"


def test_archives_with_a_member_per_record(spark, tmp_path):
    """As others write them: every record a gzip member of its own, long and empty payloads, padding behind; read in small runs."""
    def record(i, payload):
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: u{i}\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"
    payloads = [b"one", b"", b"x\r\n\r\n" * 50_000, "é".encode() * 10, b"two"]
    whole = [record(i, p) for i, p in enumerate(payloads)]
    (tmp_path / "part-0.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in whole[:3]) + gzip.compress(b"".join(whole[3:])) + b"\0" * 7)
    (tmp_path / "part-1.warc").write_bytes(record(9, b"plain"))
    got = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path), payloads=True).collect()}
    assert got == dict(enumerate(payloads)) | {9: b"plain"}
    cut = gzip.compress(whole[0]) + gzip.compress(whole[2])
    assert [b for _, b in warc.records(warc.inflated(cut, 7))] == [b for _, b in warc.records([whole[0] + whole[2]])]
    for bad in (cut[:-9], gzip.compress(whole[0][:-2]), gzip.compress(b"WARC/1.1\r\nno end")):
        with pytest.raises(ValueError):
            list(warc.records(warc.inflated(bad)))


def test_one_very_long_conversation_is_read_back_in_order(spark):
    """40,000 turns in one row: whatever cuts each span out of the whole string doesn't end here."""
    n = 40_000
    turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 1 THEN 'assistant' ELSE 'user' END AS role", "concat('é</s> ', id) AS text").repartition(4)
    chats = written(chat.format_conversations(turns.withColumn("parts", chat.text_part(F.col("text")))), "long-chat")
    r = chat.digests(chats).first()
    loss = "".join(f"é</s> {i}" for i in range(1, n, 2))
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256("".join(f"{'assistant' if i % 2 else 'user'}\né</s> {i}\n" for i in range(n)).encode()).hexdigest()
