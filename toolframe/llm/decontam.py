"""Benchmark decontamination with a positional inverted index. Only DataFrame functions.

The index holds a row per posting (term's number, document, position). Lists of terms
that no query asks for are never read, so they aren't stored: ``index`` takes
the asked terms. An exact phrase is found by intersecting lists moved by the
term's offset in the phrase: postings of one occurrence agree in
``position - offset``. The lists of each window's rarest terms are
intersected first; only where they meet are the other lists read.

Exact matching works on the words themselves, so no hash decides a match.
Nothing is collected. Groups are at most the matches of one item at one place
of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolframe.llm.common import written
from toolframe.operators.rank import range_rank

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates words once A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH = 10  # words of a window
RAREST = 2  # lists of a window that are intersected first
SMALL = 200_000  # rows up to which a counted table is broadcast; larger ones are joined by shuffle
END = -1  # the term of the posting behind a document's last word: its position is the number of words
NO_ID = -(1 << 63)  # stands for a null doc_id in joins, beside the text's hash


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case and all other letters as they are, and an empty string behind the last; null has no words."""
    plain = F.octet_length(text) == F.char_length(text)
    lower = F.regexp_replace(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), "^" + GAPS, "")
    return F.when(F.coalesce(lower, F.lit("")) == "", F.array(F.lit(""))).otherwise(F.split(F.concat(lower, F.lit(" ")), GAPS))


def _small(df: DataFrame) -> DataFrame:
    """A written table as the broadcast side of a join where its counted rows are few, else as it is."""
    return F.broadcast(df) if df.count() <= SMALL else df


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (doc_id, h, t, pos) of the given terms (see ``vocabulary``), and one of term END per document.

    docs: doc_id, text. h: hash of the text, which tells rows that repeat an id
    apart. Narrow where the terms are few enough to be broadcast.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.posexplode(words(F.col("text"))).alias("pos", "word"))
    asked = terms.select("term", "t").unionByName(terms.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(END).cast("long").alias("t")))
    asked = asked.withColumn("x", F.xxhash64("term"))
    same = F.startswith("word", "term") & F.startswith("term", "word")  # the hash says where to look, the words decide
    found = rows.withColumn("x", F.xxhash64("word")).join(F.broadcast(asked) if terms.count() <= SMALL else asked, "x")
    return found.where(same).select("doc_id", "h", "t", "pos")


def phrases(items: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(q, item_id, n, off, term) of every word of every item, written. q numbers the different (id, text); texts without words are left out."""
    own = items.select(F.col(id_col).alias("item_id"), "text").distinct()
    numbered = range_rank(own, [F.col("item_id"), F.col("text")], "q").withColumn("w", words(F.col("text")))
    exploded = numbered.select("q", "item_id", (F.size("w") - 1).alias("n"), F.posexplode("w").alias("off", "term"))
    return written(exploded.where("term <> ''"), "phrases")


def vocabulary(asked: DataFrame) -> DataFrame:
    """(term, t): the distinct terms of phrases and a number for each, written."""
    return written(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "terms")


def _key() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(NO_ID)).alias("o"), F.col("h")]


def _rarest(asked: DataFrame, counts: DataFrame, width: int, rarest: int) -> DataFrame:
    """(q, off, t, need): the terms of each window that have the shortest lists. Windows with a term that no document has can't occur."""
    need = F.least(F.lit(rarest), F.lit(width), F.col("n"))
    sized = asked.join(counts, "t", "left")
    starts = F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - width + 1), F.greatest(F.lit(0), F.least(F.col("off"), F.col("n") - width))))
    rows = sized.select("q", "n", "off", "t", "cf", starts.alias("w"))
    window = Window.partitionBy("q", "w")
    ranked = rows.withColumn("r", F.row_number().over(window.orderBy(F.col("cf").asc_nulls_first(), "off"))).withColumn("least", F.min(F.coalesce("cf", F.lit(0))).over(window))
    return ranked.where((F.col("r") <= need) & (F.col("least") > 0)).select("q", "off", "t", "n", need.alias("need")).distinct()


def find_phrases(postings: DataFrame, asked: DataFrame, terms: DataFrame, width: int = WIDTH, rarest: int = RAREST) -> DataFrame:
    """(q, item_id, o, h, pos): every word of a document inside an occurrence of a window.

    postings: a written ``index`` over ``terms``, which hold at least those of
    ``asked`` (see ``phrases``). A window: ``width`` consecutive words of an item; an item of
    fewer is one window. (o, h) identify the document: o is its doc_id, or
    NO_ID for null. Repeated documents have the same (o, h).
    """
    asked = asked.join(terms, "term").drop("term")
    counts = postings.groupBy("t").agg(F.count(F.lit(1)).alias("cf"))
    first = written(_rarest(asked, counts, width, rarest), "rarest")
    lists = postings.join(_small(first), "t")
    delta = (F.col("pos") - F.col("off")).alias("delta")
    met = lists.select("q", *_key(), delta, "off", "n", "need").groupBy("q", "o", "h", "delta", "n", "need").agg(F.sort_array(F.collect_set("off")).alias("offs"))
    near = lambda i: F.col("offs")[i + F.col("need") - 1] - F.col("offs")[i] < width
    met = met.where((F.size("offs") >= F.col("need")) & (F.col("delta") >= 1 - F.col("n")))
    met = met.where(F.exists(F.sequence(F.lit(0), F.size("offs") - F.col("need")), near))
    met = written(met.select("q", "o", "h", "delta", "n", "offs"), "met")

    around = F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - width + 1), F.least(F.col("n") - 1, F.col("off") + width - 1)))
    open_ = met.select("q", "o", "h", "delta", "n", F.explode("offs").alias("off")).select("q", "o", "h", "delta", "n", around.alias("off")).distinct()
    table = asked.select("q", "off", "t", "item_id")
    wanted = open_.join(_small(table), ["q", "off"]).withColumn("pos", F.col("delta") + F.col("off"))
    docs = written(met.select("o", "h").distinct(), "met-documents")
    rest = postings.select(*_key(), "t", "pos").join(_small(docs), ["o", "h"], "left_semi").distinct()
    found = wanted.join(rest, ["o", "h", "t", "pos"]).select("q", "item_id", "o", "h", "delta", "n", "off", "pos")
    place = Window.partitionBy("q", "o", "h", "delta")
    runs = found.withColumn("run", F.col("off") - F.row_number().over(place.orderBy("off")))
    sized = runs.withColumn("long", F.count(F.lit(1)).over(Window.partitionBy("q", "o", "h", "delta", "run")))
    return sized.where(F.col("long") >= F.least(F.lit(width), F.col("n"))).select("q", "item_id", "o", "h", "pos")


def find_near(postings: DataFrame, asked: DataFrame, terms: DataFrame, span: int) -> DataFrame:
    """(q, item_id, doc_id, h, start, end): the shortest stretches of at most ``span`` words that hold all terms of an item, in any order.

    Repeated terms count once. The rarest term's list says where to look: other
    lists are read only in the blocks of ``span`` positions around its
    postings. A stretch that contains a shorter one is left out; end is
    inclusive.
    """
    own = asked.join(terms, "term").select("q", "item_id", "t").distinct()
    counts = postings.groupBy("t").agg(F.count(F.lit(1)).alias("cf"))
    whole = Window.partitionBy("q")
    sized = own.join(counts, "t", "left").withColumn("r", F.row_number().over(whole.orderBy(F.col("cf").asc_nulls_first(), "t"))).withColumn("size", F.count(F.lit(1)).over(whole))
    sized = written(sized, "near-terms")
    rows = postings.select(*_key(), "doc_id", "t", "pos", F.floor(F.col("pos") / span).alias("b"))
    rare = rows.join(sized.where("r = 1 and cf is not null").select("t", "q"), "t")
    blocks = rare.select("q", "o", "h", F.explode(F.sequence(F.col("b") - 1, F.col("b") + 1)).alias("b")).distinct()
    near = rows.join(sized.select("t", "q", "item_id", "size"), "t").join(blocks, ["q", "o", "h", "b"]).dropDuplicates(["q", "o", "h", "pos"])
    here = Window.partitionBy("q", "o", "h").orderBy("pos")
    seen = F.collect_list(F.struct("t", "pos")).over(here.rangeBetween(-(span - 1), 0))
    full = near.withColumn("seen", seen).withColumn("names", F.array_distinct(F.col("seen.t"))).where(F.size("names") == F.col("size"))
    last = F.transform("names", lambda t: F.array_max(F.transform(F.filter("seen", lambda s: s["t"] == t), lambda s: s["pos"])))
    ends = full.withColumn("start", F.array_min(last)).withColumn("before", F.lag("start").over(here))
    return ends.where(F.col("before").isNull() | (F.col("start") > F.col("before"))).select("q", "item_id", "doc_id", "h", "start", F.col("pos").alias("end"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    docs: doc_id, text; benchmark: item_id, text; other columns aren't read.
    n_hit: words inside an occurrence of a window of any item. n_items counts
    the different item_ids with an occurring window, items_sha256 is the digest
    of those ids, sorted as strings and comma-joined; an item without an id
    marks words but isn't counted. Rows that repeat an item_id with other texts
    are more windows of that item. Null and empty texts have no words. Rows
    that repeat doc_id and text stay, each with the same result; a null doc_id
    stays null. No documents give no rows, no items give no hits.
    """
    asked = phrases(benchmark)
    terms = vocabulary(asked)
    postings = written(index(docs, terms), "postings")
    hits = find_phrases(postings, asked, terms, width)
    items = hits.select("o", "h", F.col("item_id").cast("string").alias("i")).distinct().groupBy("o", "h").agg(F.array_sort(F.collect_set("i")).alias("items"))
    places = hits.select("o", "h", "pos").distinct().groupBy("o", "h").agg(F.count(F.lit(1)).alias("n_hit"))
    ends = postings.where(F.col("t") == END).select("doc_id", F.col("pos").cast("long").alias("n_words"), *_key())
    n_hit = F.coalesce("n_hit", F.lit(0))
    return (ends.join(places.join(items, ["o", "h"]), ["o", "h"], "left")
                .select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")))
