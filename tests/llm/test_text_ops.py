import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.rows import LONG, base_spans, documents
from toolframe.llm import langid, linededup, packing, pieces, pii, simhash
from toolframe.llm.queries import tokenizer

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
HOSTILE = ["aeitnrs", " ", "  ", "\n", "\t", "\r", ".", ",", "!", "'s", "'ll", "é", "ß", "日本", " ", "\u0085", "\x1c", "𝒳", "́", "\x00", "<s>", "</s>",
           "<|endoftext|>", "▁", "the", "ing", "a", "e", "s", "0", "12", "_", "<0x41>", "\n\n", " \n "]


def hostile(seed, n, size=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(HOSTILE) for _ in range(rnd.randint(0, size))) for _ in range(n)]


# --- op2

def test_pieces_equal_the_library():
    table = pieces.PieceTable(tokenizer("piece_bpe_32k.model"))
    for t in [*hostile(1, 4000), LONG, "x" * 5000, "ab" * 3000]:
        assert table.encode(t)[0] == table.sp.encode(t), repr(t[:60])
        assert table.encode(t)[1] == ",".join(map(str, table.sp.encode(t)))


def test_pieces_cache_turns_over(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 3)
    table = pieces.PieceTable(tokenizer("piece_bpe_32k.model"))
    for t in hostile(2, 300):
        assert table.encode(t)[0] == table.sp.encode(t)
    assert len(table.new) <= 3 and len(table.old) <= 3


def test_pieces_query_rows(spark):
    import sentencepiece
    model = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = documents(spark)
    want = {(r.doc_id, r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in pieces.digests(docs, model).collect()}
    for i, t in want:
        ids = sp.encode(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    assert pieces.digests(docs.where("false"), model).count() == 0
    both = pieces.decode(pieces.encode(docs, model), model)
    assert all(r.decoded == (r.text or "") and r.row == 1 for r in both.collect())


# --- op3

def test_simhash_rows_and_next_document(spark):
    docs = documents(spark).unionByName(spark.createDataFrame([(None, "no id here")], "doc_id long, text string"), allowMissingColumns=True)
    order = sorted(((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()), key=lambda x: -x[0])
    for buckets in (1, 7, 700):  # more ranges than documents, too
        got = {r.doc_id if r.doc_id is not None else -1: r for r in simhash.fingerprints(docs, buckets).collect()}
        assert len(got) == len(order)
        for i, (d, t) in enumerate(order):
            following = order[(i + 1) % len(order)][1]
            half = len(t) // 2
            changed = t[: len(t) - half] + following[:half]
            fp, other, nxt = (simhash.fingerprint(x) for x in (t, changed, following))
            assert (got[d].n_chars, got[d].edited_sha256, got[d].fingerprint, got[d].edited_fingerprint) == (len(t), sha(changed), f"{fp:016x}", f"{other:016x}")
            assert got[d].near_edited == simhash.likeness(fp, other) and got[d].near_next == simhash.likeness(fp, nxt)
    assert simhash.fingerprints(docs.where("false")).count() == 0
    one = simhash.fingerprints(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@pytest.mark.parametrize("radius,blocks", [(3, 5), (3, 4), (2, 6), (0, 1)])
def test_block_tables_find_all_within_the_radius(spark, radius, blocks):
    rnd = random.Random(radius)
    prints = [rnd.getrandbits(64) for _ in range(60)]
    for p in prints[:40]:
        for b in rnd.sample(range(64), rnd.randint(1, 5)):
            p ^= 1 << b
        prints.append(p)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    df = spark.createDataFrame([(p,) for p in [*signed, *signed[:5], None]], "fp long")
    want = {(a, b) for a in signed for b in signed if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    got = [tuple(r) for r in simhash.near(df, df, radius, blocks).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_search_counts_other_documents(spark):
    docs = documents(spark, n=250)
    got = simhash.evaluate(docs).collect()
    prints = [int(r.fingerprint, 16) for r in got]
    for r in got:
        want = sum((p ^ int(r.fingerprint, 16)).bit_count() <= 3 for p in prints) - 1 if r.doc_id % 100 == 0 else None
        assert r.n_near == want


# --- op5

def brute_lines(docs):
    first, gone = {}, {}
    for d, t in sorted(docs):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p: p + 3])
            if any(x.strip(" ") for x in w):
                first.setdefault(w, (d, p))
    for d, t in docs:
        lines, out = t.split("\n"), set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p: p + 3])
            if w in first and first[w] != (d, p):
                out |= {q for q in (p, p + 1, p + 2) if first[w][0] != d or not first[w][1] <= q <= first[w][1] + 2}
        gone[d] = "\n".join(x for i, x in enumerate(lines) if i not in out), len(out)
    return gone


def test_line_dedup_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(i, "\n".join(rnd.choice(["a", "b", "c", "", "long line"]) for _ in range(rnd.randint(1, 12)))) for i in range(40)]
    rows += [(100, "a\nb\nc"), (101, "a\nb\nc"), (102, "A\nA\nA\nA\nA"), (103, "\n\n\n\n"), (104, "only\ntwo"), (105, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(df).collect()}
    assert got == brute_lines(rows) and got[102] == ("A\nA\nA", 2) and got[103] == ("\n\n\n\n", 0)


def test_line_dedup_edges(spark):
    docs = documents(spark)
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count() and rows[1000].text is None and rows[1000].n_lines == 0 and rows[1002].text == LONG and rows[0].row == 1
    assert linededup.dedup_lines(docs.where("false")).count() == 0
    twin = spark.createDataFrame([(7, "x\ny\nz"), (7, "x\ny\nz"), (None, "x\ny\nz")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.text) for r in linededup.dedup_lines(twin).collect())
    assert got == [(False, ""), (False, ""), (True, "x\ny\nz")]


# --- op6

def test_bundles_equal_the_sum_of_bound_letters():
    rnd = random.Random(5)
    for t in ["a", "Das ist", "日本語のテキスト " * 30, "".join(chr(rnd.randint(32, 0x2FFF)) for _ in range(3000)), "x" * 300000, "", "12 34", ".ab. c1"]:
        codes = langid.trigrams(t)
        want = sum((langid.trigram_vectors(codes[i: i + 5000], 64).astype(float).sum(0) for i in range(0, len(codes), 5000)), np.zeros(64))
        vectors, some = langid.bundles([t], 64)
        assert np.allclose(vectors[0], want) and some[0] == any(c.isalpha() for c in t)
    text = lambda c: [chr(int(x) >> 42) + chr(int(x) >> 21 & 0x1FFFFF) + chr(int(x) & 0x1FFFFF) for x in c]
    assert text(langid.trigrams(".Ab. c1")) == [" ab", "ab ", "b c", " c "]


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.evaluate(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_id_edges(spark):
    docs = documents(spark)
    rows = {r.doc_id: r for r in langid.evaluate(docs).collect()}
    assert len(rows) == docs.count()
    for i in (1000, 1001, 1003):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert {r.lang_pred for r in langid.evaluate(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.evaluate(docs.where("false")).count() == 0


# --- op8

def test_hilbert_is_a_walk():
    import itertools
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = packing.hilbert(points, bits)
        assert sorted(keys.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer
    own, library = packing.Tokens(tokenizer("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    for t in [*hostile(6, 6000), LONG, "y" * 3000, "end of line.\nNext, line", "a<|endoftext|> b <|endoftext|>"]:
        assert own.encode(t) == np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t[:60])


def test_cells_read_whole_words(monkeypatch):
    import pyarrow as pa
    from toolframe.llm.common import text_words
    rnd = random.Random(5)
    ends = ["ation", "ing", "ed", "ово", "的人"]
    texts = [" ".join("pref" + rnd.choice(ends) for _ in range(rnd.choice([0, 1, 5, 300]))) for _ in range(100)] + [None, "", "prefix", "preface", " a", "b "]
    want = []
    for t in texts:
        hashes, counts = np.unique(text_words(t or "", lower=False), return_counts=True)
        weights = 1 + np.log(counts)
        signs = np.array([(weights * (2.0 * (hashes >> np.uint64(d) & np.uint64(1)) - 1)).sum() for d in range(4)])
        want.append((signs / max((weights ** 2).sum() ** 0.5, 1) + 4) / 8 * 256)
    near = lambda got, some: np.abs(got + 0.5 - np.array(some)).max() <= 0.5 + 1e-6
    for array in (pa.array(texts), pa.array(texts, pa.large_string())):
        assert near(packing.word_cells(array), want) and near(packing.word_cells(array.slice(40, 66)), want[40:])
    plain = packing.word_cells(pa.array(texts)).tolist()
    monkeypatch.setattr(packing, "MAX_CHARS", 100)  # the path of long texts
    assert packing.word_cells(pa.array(texts)).tolist() == plain
    assert len({tuple(c) for c in packing.word_cells(pa.array([f"pref{i}" for i in range(64)])).tolist()}) > 8


def test_long_texts_do_not_land_on_the_faces():
    import pyarrow as pa
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{min(x, 20000)}" for x in rng.zipf(1.3, n)) for n in (50, 3000, 20000) for _ in range(40)]
    got = packing.word_cells(pa.array(texts))
    assert ((got == 0) | (got == 255)).any(axis=1).reshape(3, 40).mean(axis=1).max() < 0.05


def test_pack_sorts_by_whole_words(spark):
    # words that differ after the fourth byte alone lie in several cells: ids of one cell would follow one order
    import pyarrow as pa
    texts = [f"pref{i} " * 4 for i in range(64)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    rows = sorted(packing.pack(df, tokenizer("byte_bpe_50k.json"), 16).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = list(dict.fromkeys(r.doc_id for r in rows if r.start == 0))
    keys = packing.hilbert(packing.word_cells(pa.array(texts)), packing.BITS)
    assert len(set(keys.tolist())) > 8 and [int(keys[d]) for d in order] == sorted(keys.tolist())


@pytest.mark.parametrize("length", [16, 2048])
def test_packing_covers_every_id_once(spark, length):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    docs = documents(spark)
    ids = {r.doc_id: np.asarray([*own.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    rows = packing.pack(docs, tokenizer("byte_bpe_50k.json"), length).collect()
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert by.keys() == ids.keys()
    for d, parts in by.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d]) and r.ids_crc32 == zlib.crc32(ids[d][at: at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d])
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or at & (at - 1) == 0
    assert packing.pack(docs.where("false"), tokenizer("byte_bpe_50k.json")).count() == 0
    twice = packing.pack(docs.where("doc_id = 0").union(docs.where("doc_id = 0")), tokenizer("byte_bpe_50k.json"))
    assert twice.agg(F.sum("length")).first()[0] == 2 * len(ids[0])


# --- op9

PERSONAL = ["a.b+c@mail-1.example.com", "x@y", "u@v.w_x@y.z", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "0001.002.3.255", "4111 1111-1111 1111", "4111111111111112",
            "+1 (555) 555-7713", "+12", "+1 22 333 4444 55555 666666", "token = \"0123456789abcdef0123456789abcdef01234567\"", "DE89 3704 0044 0532 0130 00",
            "call (212) 555-0187", "9" * 40, "0" * 400, "é𝒳", "@", "+", "...", "5500005555555559", " ", "\n", "word", "-", "a" * 200]


def personal(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PERSONAL) + rnd.choice(["", " ", "", ", "]) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_base_spans_equal_the_rules(spark):
    rows = [(i, t) for i, t in enumerate([*personal(7, 300), LONG, "7" * 20000, "." * 20000, "a" * 20000, "1-" * 5000])] + [(5000, None), (5001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1))
    got = {r.doc_id: r for r in pii.digests(pii.find_spans(df)).collect()}
    for i, t in rows:
        want = base_spans(t or "")
        assert got[i].base_sha256 == sha(want), t
        kinds = [x.split(":")[0] for x in want.split(",") if x]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
        assert set(want.split(",")) - {""} <= set(got[i].spans.split(","))
    assert pii.find_spans(df.where("false")).count() == 0


def test_method_adds_spans_and_redaction_removes_them(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pii.find_spans(docs.select("doc_id", "text")).collect()
    added = [(r.text[s.start: s.end]) for r in found for s in r.pii if not s.base]
    assert any(a.startswith("token") for a in added)
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for r in found:
        want, at = "", 0
        for s in sorted(r.pii, key=lambda s: (s.start, s.end)):
            if s.start >= at:
                want += r.text[at: s.start] + f"[{s.kind.upper()}]"
            at = max(at, s.end)
        assert clean[r.doc_id] == want + r.text[at:]
    twice = docs.where("doc_id = 0").union(docs.where("doc_id = 0")).withColumn("text", F.lit("mail a@b.de, a@b.de"))
    assert [r.text for r in pii.redact(twice).collect()] == ["mail [EMAIL], [EMAIL]"] * 2
    assert pii.redact(documents(spark)).where("doc_id = 1000").first().text is None


def test_em_finds_the_good_labelers():
    rnd, counts = random.Random(8), {}
    for _ in range(4000):
        truth = rnd.random() < 0.4
        votes = tuple(int(truth if rnd.random() < p else not truth) if rnd.random() < 0.9 else -1 for p in (0.95, 0.8, 0.7))
        counts[votes] = counts.get(votes, 0) + 1
    model = pii.reliabilities([dict(zip(pii.VOTES, v, strict=True), kind="card", n=n) for v, n in counts.items()])["card"]
    hit = [c[1][1] / (c[1][1] + c[1][0]) for c in model["chance"]]
    assert abs(model["share"] - 0.4) < 0.05 and hit[0] > hit[1] > hit[2] and abs(hit[0] - 0.95) < 0.04
    assert pii.posterior(model, (1, 1, 1)) > 0.9 > 0.1 > pii.posterior(model, (0, 0, 0))


IBANS = {"DE": "DE89370400440532013000", "FR": "FR1420041010050500013M02606", "ES": "ES9121000418450200051332", "GB": "GB29NWBK60161331926819",
         "IT": "IT60X0542811101000000123456", "NL": "NL91ABNA0417164300", "BE": "BE68539007547034", "CH": "CH9300762011623852957", "AT": "AT611904300234573201", "NO": "NO9386011117947"}


def _ibans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.candidates(df.select(F.col("doc_id").alias("row"), "text"), "row", "text").where("kind = 'iban'").collect()
    return {r.row: (texts[r.row][r.start: r.end], r.regex_vote) for r in found}


def test_ibans_of_every_country(spark):
    spaced = {c: " ".join(x[i: i + 4] for i in range(0, len(x), 4)) for c, x in IBANS.items()}
    whole = [*IBANS.values(), *spaced.values()]
    texts = [f"iban {x}{after}" for x in whole for after in (".", " EUR 12", " THEN PAID", "")]
    assert _ibans(spark, texts) == {4 * i + j: (x, 1) for i, x in enumerate(whole) for j in range(4)}
    wrong = [f"iban {x[:-1]}{(int(x[-1]) + 1) % 10}" for x in whole]
    assert {vote for _, vote in _ibans(spark, wrong).values()} == {0}
    df = spark.createDataFrame([(i, f"my iban {x}, and {i}") for i, x in enumerate(whole)], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    cards = {i for i, x in enumerate(whole) if base_spans(x)}  # a base span inside one wins
    assert len(cards) < 4 and {clean[i] for i in clean if i not in cards} == {f"my iban [IBAN], and {i}" for i in clean if i not in cards}


def test_secrets_of_any_length(spark):
    value = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    said = [f'AWS_SECRET_ACCESS_KEY="{value}"', f'key2 = "{value}"', f'token="{value * 50}"', f'S3_TOKEN_FOR_THE_LONGEST_OF_NAMES: "{value}"', f'password="{value}"']
    df = spark.createDataFrame([(i, f"login {x} end") for i, x in enumerate(said)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {i: "login [SECRET] end" for i in range(len(said))}
