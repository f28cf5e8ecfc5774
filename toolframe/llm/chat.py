"""Chat formatting: typed content parts flattened into one string per conversation.

Only DataFrame functions. A turn's content is an array of typed parts; the
visitor turns each part into text in order: text parts are escaped, image,
audio and document parts become placeholders. Every attachment is recorded
with its reference, its place and the number of tokens its placeholder will
be expanded to. The template is

    <s>[INST]role[/INST]body</s>[INST]role[/INST]body</s>...

Control strings inside texts and roles are escaped by a backslash after their
first character; one that already holds backslashes there gets one more, so
unescaping (take one away) restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOS, ROLE_BEGIN, ROLE_END, EOS = "<s>", "[INST]", "[/INST]", "</s>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
_CONTROL = r"/?s>|/?INST\]|\|(?:image|audio|document)\|>"
ESCAPE_PATTERN = rf"([<\[])(\\*)({_CONTROL})"
UNESCAPE_PATTERN = rf"([<\[])(\\*)\\({_CONTROL})"

PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """Make every control string in a text harmless; reversible by :func:`unescape`."""
    return F.regexp_replace(text, ESCAPE_PATTERN, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE_PATTERN, "$1$2$3")


def text_part(text: Column) -> Column:
    """A content array that holds one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"),
                            null.cast("int").alias("width"), null.cast("int").alias("height"),
                            null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def expanded_tokens(part: Column, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 256) -> Column:
    """Tokens a placeholder stands for: image patches, audio frames, document pages; 0 for text, 1 where sizes are null."""
    image = F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch)
    sized = (F.when(part["type"] == "image", image)
             .when(part["type"] == "audio", F.ceil(part["seconds"] * audio_rate))
             .when(part["type"] == "document", part["pages"].cast("long") * page_tokens))
    return F.when(part["type"].isin(*PLACEHOLDER), F.greatest(F.coalesce(sized, F.lit(1)), F.lit(1))).otherwise(0).cast("long")


def _visit(part: Column) -> Column:
    """One part as text of the output."""
    out = F.when(part["type"] == "image", PLACEHOLDER["image"])
    for kind in ("audio", "document"):
        out = out.when(part["type"] == kind, PLACEHOLDER[kind])
    return out.otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def format_conversations(turns: DataFrame, parts: str = "parts") -> DataFrame:
    """One formatted row per conversation.

    turns: conv_id, turn, role and an array of typed parts. Returns conv_id,
    n_turns, formatted, loss_spans (array of start, length: the assistant
    bodies, in code points of ``formatted``, from 0), attachments (array of
    turn_index, part_index, type, ref, tokens) and attachment_tokens.

    Null roles, contents, parts and texts count as empty; a part of unknown
    type is its text. Turns are ordered by turn (null first), ties by role,
    then body; repeated rows are repeated turns. A null conv_id is one
    conversation. Other columns are ignored. No rows give no rows. One
    conversation is one value of the output and must fit in a row; the running
    offset is a window, so a long one costs no more than its sort.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce(F.col(parts), F.expr(f"cast(array() as array<{PART_TYPE}>)")).alias("parts"))
    t = t.withColumn("body", F.array_join(F.transform("parts", _visit), ""))
    files = F.filter(F.transform("parts", lambda p, i: F.struct(
        i.alias("part_index"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))),
        lambda a: a["type"].isin(*PLACEHOLDER))
    t = t.select("conv_id", "turn", "role", "body", files.alias("files"),
                 F.concat(F.lit(ROLE_BEGIN), escape(F.col("role")), F.lit(ROLE_END)).alias("head"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    size = F.length("head") + F.length("body") + len(EOS)
    t = (t.withColumn("i", F.row_number().over(w) - 1)
          .withColumn("end", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long") + len(BOS)))
    start = F.col("end") - len(EOS) - F.length("body")
    loss = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), F.length("body").cast("long").alias("length")))
    rows = F.array_sort(F.collect_list(F.struct(
        "i", F.concat("head", "body", F.lit(EOS)).alias("s"), loss.alias("loss"),
        F.transform("files", lambda a: F.struct(F.col("i").alias("turn_index"), a["part_index"].alias("part_index"),
                                                a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("files"))))
    g = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), rows.alias("r"))
    g = g.select("conv_id", "n_turns",
                 F.concat(F.lit(BOS), F.array_join(F.transform("r", lambda x: x["s"]), "")).alias("formatted"),
                 F.filter(F.transform("r", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss_spans"),
                 F.flatten(F.transform("r", lambda x: x["files"])).alias("attachments"))
    return g.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped; placeholders stay in the text."""
    whole = F.split(F.substring(formatted, len(BOS) + 1, 2**31 - 1), EOS, -1)
    turns = F.slice(whole, 1, F.size(whole) - 1)
    inner = F.transform(turns, lambda t: F.split(F.substring(t, len(ROLE_BEGIN) + 1, 2**31 - 1), r"\[/INST\]", 2))
    return F.transform(inner, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def read_loss(chats: DataFrame) -> DataFrame:
    """(conv_id, start, text): what stands under the loss mask of each conversation, unescaped, a row per span.

    chats: conv_id, formatted, loss_spans. The string is cut once, behind its
    turns; a sweep over cuts and spans in order of their places hands each span
    the piece that it lies in, so the time grows with the string and the spans,
    not with their product. A span that leaves its turn ends with it.
    """
    before = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    pieces = chats.select("conv_id", F.posexplode(F.split("formatted", EOS, -1)).alias("i", "piece"))
    pieces = pieces.withColumn("at", F.coalesce(F.sum(F.length("piece") + len(EOS)).over(before), F.lit(0)).cast("long"))
    marks = pieces.select("conv_id", "at", F.lit(0).alias("kind"), F.struct("piece", "at").alias("turn"), F.lit(None).cast("long").alias("length"))
    spans = chats.select("conv_id", F.explode("loss_spans").alias("s")).select("conv_id", F.col("s.start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["turn"].dataType).alias("turn"), F.col("s.length").alias("length"))
    back = Window.partitionBy("conv_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = marks.unionByName(spans).withColumn("turn", F.last("turn", ignorenulls=True).over(back)).where("kind = 1")
    text = F.substr("turn.piece", (F.col("at") - F.col("turn.at") + 1).cast("int"), F.col("length").cast("int"))
    return swept.select("conv_id", F.col("at").alias("start"), unescape(text).alias("text"))


def digests(chats: DataFrame) -> DataFrame:
    """The contract's row per conversation, read back from ``formatted`` and the loss mask."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "")
    loss = read_loss(chats).groupBy(F.col("conv_id").alias("c")).agg(said.alias("loss"))
    turns = chats.select("conv_id", read_turns(F.col("formatted")).alias("t"), F.length("formatted").cast("long").alias("formatted_chars"))
    joined = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = turns.join(loss, F.col("conv_id").eqNullSafe(F.col("c")), "left").withColumn("loss", F.coalesce("loss", F.lit("")))
    return back.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
