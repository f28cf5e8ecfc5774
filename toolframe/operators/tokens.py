"""Token-array columns (T1-T3), re-aimed as Spark jobs.

The reference calls an external BPE tokenizer; here the vocabulary is itself
a job over the corpus: whitespace tokens are counted with a partial
aggregation and get dense ids after the special tokens, by count, ties by
token, from an exact range rank (no window over one partition). Encoding looks
at blocks of rows: a block's distinct tokens are joined to the vocabulary (a hot
token is one row per block) and come back to it as a small dictionary, so no
token occurrence is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolframe.functions.text import py_split_join
from toolframe.operators.rank import range_rank
from toolframe.session import written

PAD, UNK, EOS = "<pad>", "<unk>", "<eos>"
SPECIALS = [PAD, UNK, EOS]
CHUNK_BITS = 10  # up to 2 ** 10 rows share a dictionary while they are encoded


def words(text: Column) -> Column:
    """Whitespace tokens of a text (Python ``str.split()`` semantics); [] for blank."""
    norm = py_split_join(text)
    return F.when(norm == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def _placed(df: DataFrame, keys: list[str], text: str, spans: str | None = None, weight: str = "int") -> DataFrame:
    """keys and ``_tokens``: a text's tokens in order, with start, end and, under ``spans`` (sorted by start), the span's weight.

    One pass over each text where it stands: no token is shuffled or sorted.
    """
    def place(batches):  # nested: executors need pyarrow, not this package
        import re

        import pyarrow as pa
        word = re.compile(r"\S+")
        for batch in batches:
            kind = batch.schema.field("_spans").type.value_type.field("weight").type
            types = {"token": pa.string(), "start": pa.int64(), "end": pa.int64(), "weight": kind}
            offsets, parts, n, held = [0], [], 0, {c: [] for c in types}
            for t, spans in zip(batch.column("_text"), batch.column("_spans"), strict=True):
                at, spans = -1, spans.as_py() or []
                for m in word.finditer(t.as_py() or ""):
                    first, last = m.span()
                    while at + 1 < len(spans) and spans[at + 1]["start"] <= first:
                        at += 1
                    held["token"].append(m.group())
                    held["start"].append(first)
                    held["end"].append(last)
                    held["weight"].append(spans[at]["weight"] if at >= 0 and first < spans[at]["end"] else 0)
                offsets.append(n + len(held["token"]))
                if len(held["token"]) > 100_000:
                    parts.append(pa.StructArray.from_arrays([pa.array(held[c], types[c]) for c in types], list(types)))
                    n, held = offsets[-1], {c: [] for c in types}
            parts.append(pa.StructArray.from_arrays([pa.array(held[c], types[c]) for c in types], list(types)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(parts))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], lists], [*keys, "_tokens"])

    marks = F.col(spans) if spans else F.lit(None).cast(f"array<struct<start:bigint,end:bigint,weight:{weight}>>")
    slim = df.select(*keys, F.col(text).alias("_text"), marks.alias("_spans"))
    named = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys)
    return slim.mapInArrow(place, f"{named}, _tokens array<struct<token:string,start:bigint,end:bigint,weight:{weight}>>")


def token_offsets(df: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    """A row per whitespace token: keys, ``i`` (place among the row's tokens, from 0), token, start and end (code points, end exclusive).

    Texts without tokens give no rows. ``key`` must identify a row; a null key
    is one key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rows = _placed(df, keys, text).select(*keys, F.posexplode("_tokens").alias("i", "_token"))
    return rows.select(*keys, F.col("i").cast("long").alias("i"), "_token.token", "_token.start", "_token.end")


def weighted_tokens(df: DataFrame, spans: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    """(keys, tokens): each text's tokens with start, end and weight as ``span_weights`` gives them, as one array per text.

    The spans of a text come to it as an array, so its tokens never travel.
    """
    keys = [key] if isinstance(key, str) else list(key)
    kind = spans.schema["weight"].dataType.simpleString()
    mark = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "weight")
    lists = spans.where("end > start").groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.array_sort(F.collect_list(mark)).alias("_marks"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return _placed(df.join(lists, same, "left"), keys, text, "_marks", kind).withColumnRenamed("_tokens", "tokens")


def span_weights(tokens: DataFrame, spans: DataFrame, key: str | list[str]) -> DataFrame:
    """tokens (keys, start, end, ...) with ``weight``: that of the span (keys, start, end, weight) which holds the token's first character, else 0.

    A sweep over both in order of their starts: each token looks back to the
    last span that began. Spans of a key may touch but not overlap. Tokens of
    any tokenizer will do, as long as their offsets count what the spans count.
    """
    keys = [key] if isinstance(key, str) else list(key)
    names = [c for c in tokens.columns if c not in keys]
    marks = spans.where("end > start").select(*keys, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct("end", "weight").alias("_span"))
    both = tokens.select(*keys, F.col("start").alias("_at"), F.lit(1).alias("_kind"), F.struct(*names).alias("_token")).unionByName(marks, allowMissingColumns=True)
    back = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("_span", F.last("_span", ignorenulls=True).over(back)).where("_token is not null")
    weight = F.when(F.col("_at") < F.col("_span.end"), F.col("_span.weight")).otherwise(F.lit(0))
    return swept.select(*keys, *[F.col("_token")[c].alias(c) for c in names if c != "weight"], weight.alias("weight"))


def build_vocabulary(df: DataFrame, text: str = "text", max_vocab: int | None = None, min_count: int = 1) -> DataFrame:
    """T1 vocabulary: ``(token, id, count)``; ids 0..2 are ``<pad> <unk> <eos>``.

    Every token of the corpus gets an id; ``max_vocab`` keeps only the most
    frequent ones, where a caller wants that.
    """
    counts = (df.select(F.explode(words(F.col(text))).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("count"))
              .filter(F.col("count") >= min_count))
    ranked = range_rank(counts, [F.desc("count"), F.asc("token")], "_r")
    if max_vocab is not None:
        ranked = ranked.where(F.col("_r") <= max_vocab)
    specials = df.sparkSession.createDataFrame([(t, i, 0) for i, t in enumerate(SPECIALS)], "token string, id int, count long")
    return specials.unionByName(ranked.select("token", (F.col("_r") + len(SPECIALS) - 1).cast("int").alias("id"), "count"))


def encode(df: DataFrame, vocab: DataFrame, key: str | list[str], text: str = "text", max_length: int = 2048,
           pad_id: int | None = None, unk_id: int = 1) -> DataFrame:
    """T1 + T2 + T3: truncate to ``max_length``, pad to ``max_length``, attention mask, labels.

    ``pad_id`` defaults to the eos id (T3). Labels copy the ids with every pad
    id replaced by -100, real tokens equal to the pad id included (T2).
    ``key``: one or more columns that together identify a row (tokens are
    regrouped by them, so equal keys would merge rows); they come out with the
    arrays. ``prepare`` numbers its rows for that.
    """
    keys = [key] if isinstance(key, str) else list(key)
    pad = SPECIALS.index(EOS) if pad_id is None else pad_id  # ids of the specials are fixed by build_vocabulary
    texts = F.array_join(F.slice(words(F.col(text)), 1, max_length), " ")  # tokens hold no spaces
    staged = written(df.select(*keys, F.coalesce(texts, F.lit("")).alias("_text"), F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS).alias("_chunk")), "to-encode")
    found = staged.where("_text <> ''").select(F.col("_chunk").alias("_of"), F.explode(F.split("_text", " ")).alias("token")).distinct()
    ids = found.join(vocab.select("token", F.col("id").cast("int").alias("id")), "token").select("_of", "token", "id")

    def look_up(rows, known):  # nested: executors need pyarrow, not this package
        import pyarrow as pa
        of = dict(zip(known["token"].to_pylist(), known["id"].to_pylist(), strict=True))
        out = [[of.get(t, unk_id) for t in x.split(" ")] if x else [] for x in rows["_text"].to_pylist()]
        return rows.select(keys).append_column("_ids", pa.array(out, pa.list_(pa.int32())))

    named = ", ".join(f"`{k}` {staged.schema[k].dataType.simpleString()}" for k in keys)
    coded = staged.groupBy("_chunk").cogroup(ids.groupBy("_of")).applyInArrow(look_up, f"{named}, _ids array<int>")
    placed = F.flatten(F.transform("_l", lambda one: F.transform(one, lambda x, i: F.struct(i.alias("pos"), x.alias("id")))))
    merged = F.transform(F.array_sort(placed), lambda s: s["id"])
    base = coded.groupBy(*keys).agg(F.collect_list("_ids").alias("_l")).withColumn("_ids", F.when(F.size("_l") == 1, F.col("_l")[0]).otherwise(merged))
    n = F.size("_ids")
    input_ids = F.concat("_ids", F.array_repeat(F.lit(pad), F.lit(max_length) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))
    return (base.withColumn("input_ids", input_ids)
            .withColumn("attention_mask", mask)
            .withColumn("labels", F.transform("input_ids", lambda t: F.when(t == pad, F.lit(-100)).otherwise(t)))
            .drop("_l", "_ids"))
