"""Small tables with every awkward case, and plain restatements of the contracts."""

from __future__ import annotations

import random
import re

LONG = "palabra larga " * 20000


def documents(spark, seed: int = 0, n: int = 60, extra: bool = True):
    """Documents with nulls, empties, one long text, copies, near copies and repeated rows, and extra columns with clashing names."""
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "the", "of", "and", "and,", "x1", "日本", "fin."]
    texts = []
    for i in range(n):
        if i % 5 == 1 and texts:
            t = rnd.choice(texts) or ""
            parts = t.split(" ")
            if i % 10 == 1 and len(parts) > 30:
                parts[rnd.randrange(len(parts))] = "changed"
            texts.append(" ".join(parts))
        else:
            texts.append("\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 6))))
    rows = [(i * 3, t, ["en", "fr", None][i % 3]) for i, t in enumerate(texts)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, LONG, "es"), (1003, " \n\t ", "en"), (1004, "one", "fr"), (1005, "One", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    if extra:
        df = df.selectExpr("doc_id", "text", "lang", "'s' as source", "length(text) as n_chars", "1 as row", "2 as d", "3 as h", "'p' as pii", "4 as id", "5 as k", "6 as value")
    return df


def contract_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base_spans(text: str) -> str:
    digits = lambda x: [int(c) for c in x if c.isdigit()]
    luhn = lambda x: sum(v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2) for i, v in enumerate(digits(x)[::-1])) % 10 == 0
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and luhn(x)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0]))
