import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from toolframe.llm import decontam

LONG = "common filler words go on " * 20_000


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items, width=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(len(w), width)
        for s in range(len(w) - k + 1) if k else ():
            windows[tuple(w[s: s + k])].add(i)
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                found = windows.get(tuple(w[s: s + k]))
                if found:
                    hit.update(range(s, s + k))
                    ids |= {str(i) for i in found if i is not None}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def corpus(seed=0, n=120):
    """Documents over few words, so that windows nearly occur everywhere, with whole, cut and overlapping passages of the items."""
    rnd = random.Random(seed)
    letters = ["the", "of", "a", "Über", "x1", "日本", "rare"]
    say = lambda k, p=letters: [rnd.choice(p) for _ in range(k)]
    items = [(i, " ".join(say(rnd.randint(1, 30), letters + [f"w{j}" for j in range(30)]))) for i in range(25)]
    items += [(100, " ".join(["the"] * 25)), (101, "Short One"), (102, ""), (103, None), (104, " .,! "), (None, "no id but seven words in all"),
              (105, "rare " + "the " * 30), (3, "Second text of item three which has more than ten words in it")]
    docs = []
    for i in range(n):
        t = say(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 2)):
            w = (rnd.choice(items)[1] or "").split()
            a = rnd.randint(0, max(0, len(w) - 9))
            at = rnd.randint(0, len(t))
            t[at:at] = w[a: a + rnd.randint(8, 14)] if rnd.random() < 0.5 else w
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(t).replace("the", rnd.choice(["the", "THE", "The"]))))
    docs += [(900, None), (901, ""), (902, "..."), (None, items[0][1]), (903, LONG + items[1][1]), (904, "THE " * 40), (905, "short one"), (905, "short one"), (905, "other")]
    return docs, items


def tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as q", "2 as h", "'t' as term", "3 as pos", "4 as item_id")
    return d.repartition(5), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 as doc_id", "6 as off", "7 as n")


def rows(df):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(r) for r in df.collect()), key=key), key


def test_equals_brute_force(spark, monkeypatch):
    for seed, width, small in ((0, 10, 200_000), (1, 4, 0), (2, 1, 200_000)):
        monkeypatch.setattr(decontam, "SMALL", small)  # 0: every join by shuffle
        docs, items = corpus(seed)
        got, key = rows(decontam.contamination(*tables(spark, docs, items), width=width))
        assert got == sorted(plain(docs, items, width), key=key)


def test_hot_passage_and_repeated_items(spark):
    """A third of all rows holds the same passage, which several items share."""
    passage = " ".join(f"p{i}" for i in range(15))
    docs = [(i, f"{passage} tail{i}" if i % 3 == 0 else f"nothing here {i}") for i in range(300)]
    items = [(i, passage) for i in range(5)] + [(0, passage), (9, " ".join(["nothing"] * 12))]
    got, key = rows(decontam.contamination(*tables(spark, docs, items)))
    assert got == sorted(plain(docs, items), key=key) and sum(r[2] for r in got) == 1500


def test_empty_tables(spark):
    d, b = tables(spark, *corpus(3, 10))
    assert decontam.contamination(d.where("false"), b).count() == 0
    none = decontam.contamination(d, b.where("false"))
    assert none.count() == d.count() and none.where("contaminated or n_hit > 0 or n_items > 0").count() == 0


def test_native(spark):
    d, b = tables(spark, *corpus(4, 10))
    plan = decontam.contamination(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_near_equals_brute_force(spark):
    rnd = random.Random(8)
    docs = [(i, " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 60)))) for i in range(60)] + [(70, None), (71, "a b")]
    items = [(0, "a b c"), (1, "f F e"), (2, "d"), (3, "a zz"), (4, None)]
    d, b = tables(spark, docs, items)
    asked = decontam.phrases(b)
    terms = decontam.vocabulary(asked)
    postings = decontam.index(d, terms)
    for span in (3, 5):
        want = set()
        for i, t in items:
            need = set(words(t))
            for doc, text in docs:
                w, best = words(text), None
                for end in range(len(w) if need else 0):
                    starts = [s for s in range(max(0, end - span + 1), end + 1) if need <= set(w[s: end + 1])]
                    if starts and (best is None or starts[-1] > best):
                        best = starts[-1]
                        want.add((i, doc, best, end))
        got = decontam.find_near(postings, asked, terms, span).where(F.col("doc_id").isNotNull()).select("item_id", "doc_id", "start", "end")
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
