import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.rows import documents
from toolframe.llm import fim

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(doc_id, text, rate=100, spm_rate=50, seed=7, marks=("<P>", "<S>", "<M>")):
    """The contract restated on strings."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[i: i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), out


def hostile(spark):
    rnd = random.Random(5)
    bits = ["a", "é", "日本", "\n", "\n\n", "𝒳", "<P", "P>", "<", "<S>", "\r", " ", " ", "<M", ">"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "\n"), (903, "a<M>b"), (None, "x\ny\n"), (904, "<"), (905, "ab\n<"), (905, "ab\n<"), (905, "other\n")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_equals_the_contract_on_strings(spark):
    docs = documents(spark).unionByName(hostile(spark), allowMissingColumns=True)
    for rate, spm in ((100, 50), (40, 0), (100, 100)):
        got = fim.restore(fim.transform(docs, rate, spm)).collect()
        assert len(got) == docs.count()
        for r in got:
            want = plain(r.doc_id, r.text, rate, spm)
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
            assert r.output_sha256 == sha(want[-1]) and r.restored == (r.text or "") and r.restored_sha256 == sha(r.text or "")
    assert {r.form for r in got} == {"plain", "spm"}


def test_query_rows_and_awkward_tables(spark):
    docs = hostile(spark).selectExpr("*", "'mine' as form", "1 as n", "'o' as output", "2 as restored")
    got = fim.digests(fim.transform(docs))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    assert fim.digests(fim.transform(docs.where("false"))).count() == 0
    many = fim.transform(docs.repartition(7)).select("doc_id", "output").exceptAll(fim.transform(docs.coalesce(1)).select("doc_id", "output"))
    assert many.count() == 0


def test_long_text_is_cut_by_descriptors(spark):
    text = "ligne é\n" * 200_000 + "end"
    df = spark.createDataFrame([(3, text)], "doc_id long, text string")
    r = fim.restore(fim.transform(df)).select("n", "output", F.col("restored") == F.col("text")).first()
    assert r[0] == 200_001 and r[1] == plain(3, text)[-1] and r[2]


def test_piece_table_moves_no_bytes():
    table = fim.PieceTable(b"abcdef", b"|")
    table.cut(0, 2)
    table.cut(1, 0)
    assert table.pieces == [(0, 0, 2), (0, 2, 0), (0, 2, 4)]
    table.arrange([2, (1, 0, 1), 0])
    assert table.text() == "cdef|ab" and table.sha256() == sha("cdef|ab")


def test_sentinels_that_could_be_read_twice_raise(spark):
    for bad in (("aa", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "x<P>y", "<M>")):
        with pytest.raises(ValueError):
            fim.check_sentinels(bad)
    with pytest.raises(ValueError):
        fim.restored(b"no marks", "psm", (b"<P>", b"<S>", b"<M>"))
