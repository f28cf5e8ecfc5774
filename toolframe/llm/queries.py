"""Registered queries of the training-data operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolframe.llm import chat, decontam, fim, langid, linededup, minhash, packing, pieces, pii, resample, simhash, topk, warc
from toolframe.llm.common import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """A public tokenizer's file; the same path on every executor."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_topk_bit_sliced", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op1(spark, sf_dir):
    """The five highest integer inner products of every fiftieth vector with all others."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op2_sentencepiece")
def op2(spark, sf_dir):
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op3_simhash")
def op3(spark, sf_dir):
    """Fingerprints of all texts and of their edited texts; n_near for every hundredth document."""
    return simhash.evaluate(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_warc_revisits", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100""")
def op4(spark, sf_dir):
    """Write all pages as archives into the shared folder, then read the archives back."""
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).drop("url")


@query("op5_line_dedup", r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, p, ls[p + 1] AS a, ls[p + 2] AS b, ls[p + 3] AS c FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS p FROM l WHERE len(ls) >= 3)),
v AS (SELECT * FROM w WHERE trim(a, ' ') <> '' OR trim(b, ' ') <> '' OR trim(c, ' ') <> ''),
r AS (SELECT *, first_value(doc_id) OVER o AS fd, first_value(p) OVER o AS fp FROM v WINDOW o AS (PARTITION BY a, b, c ORDER BY doc_id, p)),
k AS (SELECT doc_id, p + unnest([0, 1, 2]) AS q, doc_id = fd AS own, fp FROM r WHERE NOT (doc_id = fd AND p = fp)),
g AS (SELECT DISTINCT doc_id, q FROM k WHERE NOT (own AND q BETWEEN fp AND fp + 2)),
x AS (SELECT doc_id, unnest(ls) AS s, unnest(range(0, len(ls))) AS q FROM l)
SELECT x.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.q) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(x.s, chr(10) ORDER BY x.q) FILTER (WHERE g.q IS NULL), '')) AS text_sha256
FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.q = g.q GROUP BY x.doc_id""")
def op5(spark, sf_dir):
    """Per document: lines, lines removed and the digest of the text that is left."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query("op6_language_id")
def op6(spark, sf_dir):
    return langid.evaluate(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op7_bottom_k_dedup", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                                 ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram FROM w WHERE len(ws) > 0),
x AS (SELECT DISTINCT doc_id, gram FROM g),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
i AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM x p JOIN x q ON p.gram = q.gram AND p.doc_id < q.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
l AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
r AS (SELECT x, x AS y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.x = w.doc_id""")
def op7(spark, sf_dir):
    """Components of documents whose sets of five-word shingles are alike to 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_curve_packing")
def op8(spark, sf_dir):
    """All documents in sequences of 2048 ids along the curve."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), length=2048)


@query("op9_pii_spans")
def op9(spark, sf_dir):
    return pii.digests(pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op10_chat_format", r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(17 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|\|(?:image|audio|document)\|>)', '\1\2\\\3', 'g'))
                    + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|\|(?:image|audio|document)\|>)', '\1\2\\\3', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""")
def op10(spark, sf_dir):
    """All conversations and conversation -7, whose texts are control strings of the template."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT cast(-7 as bigint) conv_id, turn, role, cast(:s as string) text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)", args={"s": said})
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(turns.withColumn("parts", chat.text_part(F.coalesce("text", F.lit(""))))))


@query("op11_decontamination", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT item_id, ws, least(len(ws), 10) AS k FROM b WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS gram FROM v),
s AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS i, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS gram
      FROM d, (SELECT DISTINCT k FROM g) WHERE len(ws) >= k),
m AS (SELECT doc_id, item_id, i, s.k FROM s JOIN g ON s.k = g.k AND s.gram = g.gram),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id""")
def op11(spark, sf_dir):
    """Words of every document inside ten-word windows of benchmark items."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_fill_in_middle", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || g[1:8] AS BIGINT) AS h1, CAST('0x' || g[9:16] AS BIGINT) AS h2, CAST('0x' || g[17:24] AS BIGINT) AS h3, CAST('0x' || g[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM p""")
def op13(spark, sf_dir):
    """All texts in fill-in-middle form, and rebuilt from it."""
    return fim.digests(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op12_importance_resampling")
def op12(spark, sf_dir):
    """Every document's weight towards the benchmark's n-grams, and the twentieth of the documents that is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.digests(resample.score(docs, table(spark, sf_dir, "benchmark").select("text")))
