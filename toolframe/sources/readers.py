"""Sources and sinks (S1-S11, K1-K7, K10 writer side).

Readers return lazy DataFrames with explicit schemas; sinks write through the
DataFrame writer (partitioned where the reference writes one file per
split / kind). Nothing is read into the driver except tiny control values.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StringType, StructField, StructType

from toolframe.functions import jsonx

MESSAGE = StructType([StructField("role", StringType()), StructField("content", StringType())])

#: Every name that a raw example may carry (objects and lists as JSON text): what the loader unifies and the evaluation looks at.
TEXT_FIELDS = ["source", "instruction", "user_instruction", "query", "question", "text", "tools", "api_list", "function", "tool_calls",
               "expected_calls", "api_calls", "api_call", "category", "domain", "id", "conversations"]
RAW_SCHEMA = StructType([
    StructField("row_id", LongType()), *[StructField(n, StringType()) for n in TEXT_FIELDS],
    StructField("messages", ArrayType(MESSAGE)), StructField("num_steps", IntegerType()),
])


class SourceError(RuntimeError):
    pass


class MalformedLine(SourceError):
    """A line that isn't JSON, with its file and its number from 1."""

    def __init__(self, file: str, line: int, text: str):
        super().__init__(f"{file}, line {line} isn't JSON: {text[:200]}")
        self.file, self.line, self.text = file, line, text


def read_jsonl(spark: SparkSession, path: str, schema: StructType = RAW_SCHEMA,
               mode: str = "PERMISSIVE") -> DataFrame:
    """JSON-lines scan of a file or a directory of ``*.jsonl`` / ``*.json`` files, on any file system.

    Blank lines are skipped by the reader. ``mode="FAILFAST"`` reads the input
    once to look for malformed lines and raises MalformedLine with the first
    one's file and line number (reference parity); the default keeps them in
    ``_corrupt_record``. A missing path raises; an empty input raises. Names
    outside the schema are not read: pass a schema to read others, or read
    every key that occurs with ``openjson.read_open_jsonl``.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(f"no such input: {path}")
    if mode == "FAILFAST":
        refuse_malformed(spark, path)
    reader = spark.read.option("mode", mode)
    if mode != "FAILFAST":
        schema = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt_record")
    if _status(spark, path).isDirectory():
        reader = reader.option("pathGlobFilter", "*.{jsonl,json}")
    df = reader.schema(schema).json(path)
    if not df.take(1):
        raise ValueError(f"{path} holds no rows")
    return df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines (``value``) of a file or of a directory's ``*.jsonl`` / ``*.json`` files; a missing path raises."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no such input: {path}")
    reader = spark.read
    if _status(spark, path).isDirectory():
        reader = reader.option("pathGlobFilter", "*.{jsonl,json}")
    return reader.text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of ``read_lines`` with exact numbers from 1, blank ones counted.

    Splits are read in parallel: a line's number is its place in its split plus
    the lines of the file's earlier splits, a table of one row per split.
    """
    rows = read_lines(spark, path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("id"), "value")
    before = Window.partitionBy("file").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "b").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    splits = splits.select("file", "b", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines"))
    return rows.join(splits, ["file", "b"]).select("file", (F.col("lines") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def refuse_malformed(spark: SparkSession, path: str) -> None:
    """Raise MalformedLine for the first line (by file, then place) that holds no JSON document. Lines are numbered only if there is one."""
    from toolframe.functions.text import py_strip
    line = py_strip(F.col("value"))
    bad = (line != "") & jsonx.parse_strict(line).isNull()
    jsonx.last_key_wins(spark)
    if not read_lines(spark, path).where(bad).take(1):
        return
    first = numbered_lines(spark, path).where(bad).orderBy("file", "line").first()
    raise MalformedLine(first["file"], first["line"], first["value"])


def parse_lines(lines: DataFrame, text: str, schema: StructType = RAW_SCHEMA) -> DataFrame:
    """S1 / S5 on a table of lines: the other columns of ``lines`` and the parsed fields.

    Blank lines give no row; a malformed line keeps its text in ``_corrupt_record``.
    """
    from toolframe.functions.text import py_strip
    line = py_strip(F.col(text))
    full = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = lines.where(line != "").withColumn("_p", F.from_json(line, full, options))
    return parsed.select(*[F.col(c) for c in lines.columns if c != text], "_p.*")


def _file_system(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def _exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _file_system(spark, path)
    return bool(fs.exists(hpath))


def _status(spark: SparkSession, path: str):
    fs, hpath = _file_system(spark, path)
    return fs.getFileStatus(hpath)


@dataclass(frozen=True)
class SourceSpec:
    """One configured source (``type`` is local / parquet / table)."""

    name: str
    path: str
    type: str = "local"
    enabled: bool = True
    samples: int | None = None
    options: dict = field(default_factory=dict)


def _read_parquet(spark, spec):
    return spark.read.parquet(spec.path)


def _read_table(spark, spec):
    return spark.table(spec.path)


def _read_local(spark, spec):
    return read_jsonl(spark, spec.path, **spec.options)


def _read_open(spark, spec):
    from toolframe.sources.openjson import read_open_jsonl
    return read_open_jsonl(spark, spec.path, **spec.options)


# S3: source-type dispatch.
READERS: dict[str, Callable[[SparkSession, SourceSpec], DataFrame]] = {
    "local": _read_local, "json": _read_local, "open": _read_open, "parquet": _read_parquet, "table": _read_table,
}


def load_single(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """S3: read one source by type; unknown types raise ValueError."""
    if spec.type not in READERS:
        raise ValueError(f"no reader for sources of type {spec.type!r}")
    df = READERS[spec.type](spark, spec)
    if spec.samples:
        from toolframe.operators.prep import cap_rows, with_row_ids
        df = cap_rows(with_row_ids(df), spec.samples, key="row_key", tie="row_id").select(*df.columns)
    return df


#: What a source that can't be read raises; anything else is a fault of the program and goes on.
SOURCE_FAILURES = (SourceError, OSError, ValueError, PySparkException, Py4JJavaError)


def load_all(spark: SparkSession, specs: list[SourceSpec], errors: dict[str, str] | None = None) -> DataFrame:
    """S2 + P1 + U1: read every enabled source, tag it, union by name.

    A source that can't be read is skipped and told in ``errors`` (the caller's
    own dict: name to message); no loadable source raises.
    """
    frames, errors = [], {} if errors is None else errors
    for spec in specs:
        if not spec.enabled:
            continue
        try:
            frames.append(load_single(spark, spec).withColumn("source", F.lit(spec.name)))
        except SOURCE_FAILURES as exc:  # skip and report, like the reference
            errors[spec.name] = f"{type(exc).__name__}: {exc}"
    if not frames:
        raise SourceError(f"no source could be read: {errors}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def flatten_to_strings(df: DataFrame) -> DataFrame:
    """S4 (compat): sorted columns, nested values as JSON strings, NULL -> ``""``."""
    cols = []
    for f in sorted(df.schema.fields, key=lambda x: x.name):
        c = F.col(f.name)
        if isinstance(f.dataType, (StructType, ArrayType, MapType)):
            c = F.to_json(c)
        cols.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*cols)


def read_stage_results(spark: SparkSession, path: str, stage: str | None = None) -> DataFrame:
    """``{stage: {metric: value}}`` JSON documents -> ``(stage, metric, value)``.

    BOM-tolerant; see ``stage_results_of``.
    """
    text = spark.read.option("wholetext", True).text(path)
    return stage_results_of(text, "value", stage)


def stage_results_of(docs: DataFrame, text: str, stage: str | None = None) -> DataFrame:
    """S8 on a table of JSON documents: ``{stage: {metric: value}}`` -> ``(stage, metric, value)``.

    Numbers are read one by one: a value that isn't a number leaves out that
    metric alone, a stage that isn't an object that stage alone. Asked for one
    stage whose entry isn't an object, the job raises.
    """
    jsonx.last_key_wins(docs.sparkSession)
    doc = jsonx.as_object(jsonx.parse_strict(F.regexp_replace(F.col(text), "^\ufeff", "")))
    entries = docs.select(F.explode(doc).alias("stage", "entry"))
    metrics = jsonx.as_object(F.col("entry"))
    if stage:
        entries = entries.filter(F.col("stage") == stage)
        metrics = F.when(metrics.isNull(), F.raise_error(F.lit(f"the results of stage {stage} are no object"))).otherwise(metrics)
    out = entries.select("stage", F.explode(metrics).alias("metric", "v"))
    number = F.schema_of_variant("v").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return out.select("stage", "metric", F.when(number, F.try_variant_get("v", "$", "double")).alias("value")).where(F.col("value").isNotNull())


def last_sampler_path(spark: SparkSession, path: str) -> DataFrame:
    """Last non-empty ``sampler_path`` of an append-only JSON-lines log.

    Line order is explicit: (file, start offset of the split, position in
    the task), and rows of one split are read in line order. Malformed or blank
    lines are ignored. A directory's files are read from the last by name, one
    at a time, until one has a value: the older ones aren't opened. One row
    (``sampler_path``), NULL when none.
    """
    if _exists(spark, path) and _status(spark, path).isDirectory():
        fs, hpath = _file_system(spark, path)
        files = sorted((str(s.getPath()) for s in fs.listStatus(hpath) if s.isFile() and not s.getPath().getName().startswith(("_", "."))), reverse=True)
        for f in files[:-1]:
            found = last_sampler_path(spark, f).first()["sampler_path"]
            if found is not None:
                return spark.range(1).select(F.lit(found).alias("sampler_path"))
        path = files[-1] if files else path
    lines = (spark.read.text(path)
             .select(F.col("value"), F.col("_metadata.file_path").alias("_f"),
                     F.col("_metadata.file_block_start").alias("_b"),
                     F.monotonically_increasing_id().alias("_seq")))
    return last_sampler_path_of(lines, "value", ["_f", "_b", "_seq"])


def last_sampler_path_of(lines: DataFrame, text: str, order: list[str], group: list[str] | None = None) -> DataFrame:
    """S9 on a line table: the ``sampler_path`` of the last line (by ``order``) that is a
    JSON object with a non-empty ``sampler_path``; blank and malformed lines are ignored.
    With ``group`` one result per log (e.g. per run)."""
    v = jsonx.parse_strict(F.col(text))
    sp = jsonx.as_string(jsonx.key(v, "sampler_path"))
    valid = lines.filter(F.trim(F.col(text)) != "").withColumn("_sp", sp).filter(F.col("_sp") != "")
    last = F.max_by("_sp", F.struct(*[F.col(c) for c in order])).alias("sampler_path")
    return valid.groupBy(*group).agg(last) if group else valid.agg(last)


def metrics_from_run_summary(summary: DataFrame, stage: str) -> DataFrame:
    """S10 (re-aimed at a run-summary table ``(key, value string)``):
    keys ``"{stage}/x"`` with numeric values -> ``(stage, metric, value)``."""
    prefix = f"{stage}/"
    return (summary.filter(F.col("key").startswith(prefix))
            .select(F.lit(stage).alias("stage"), F.substr(F.col("key"), F.lit(len(prefix) + 1)).alias("metric"),
                    F.col("value").try_cast("double").alias("value"))
            .filter(F.col("value").isNotNull()))


def compare_saved(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Load saved stage documents, need at least two stages."""
    frames = [read_stage_results(spark, p, s) for s, p in paths.items() if p and _exists(spark, p)]
    return compare_documents(frames)


def compare_documents(frames: list[DataFrame]) -> DataFrame:
    """S11 on parsed results: their union, of two stages at least."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    if out is None or out.select("stage").distinct().limit(2).count() < 2:
        raise SourceError("a comparison needs saved results of two or more stages")
    return out


# --------------------------------------------------------------------------
# Sinks
# --------------------------------------------------------------------------

def write_by_kind(df: DataFrame, path: str, steps_col: str = "num_steps") -> None:
    """K1: JSON lines split into ``kind=single`` / ``kind=multistep`` by step count."""
    kind = F.when(F.col(steps_col) == 1, "single").otherwise("multistep")
    df.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").json(path)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    """K2 / K4: JSON lines sink; K6 with ``append``: a log that grows by new files."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    """K3: one parquet directory per split."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def upsert_table(old_path: str | None, new: DataFrame, out_path: str, keys=("stage", "metric")) -> DataFrame:
    """K5: keyed upsert written to a NEW path (atomic swap is the caller's rename)."""
    spark = new.sparkSession
    from toolframe.operators.evals import upsert_metrics
    merged = new
    if old_path and _exists(spark, old_path):
        try:
            merged = upsert_metrics(spark.read.parquet(old_path), new, keys)
        except AnalysisException as exc:  # no readable table there: start empty; any other error is the caller's
            if exc.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "UNRESOLVED_COLUMN.WITH_SUGGESTION"):
                raise
        except Py4JJavaError as exc:
            if "is not a Parquet file" not in str(exc.java_exception):
                raise
    merged.write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """K7: data files (``*.jsonl`` then ``*.json``) with size in KB and row count."""
    df = spark.read.option("pathGlobFilter", "*.{jsonl,json}").text(path)
    meta = df.select(F.col("_metadata.file_name").alias("file_name"),
                     F.col("_metadata.file_size").alias("file_size"))
    return (meta.groupBy("file_name").agg(F.first("file_size").alias("file_size"),
                                          F.count(F.lit(1)).alias("rows"))
            .withColumn("size_kb", F.round(F.col("file_size") / 1024.0, 1))
            .withColumn("_ext_order", F.when(F.col("file_name").endswith(".jsonl"), 0).otherwise(1))
            .orderBy("_ext_order", "file_name").drop("_ext_order"))


def load_eval_examples(spark: SparkSession, test_raw: str | None, synth_dir: str | None,
                       max_samples: int = 1000, seed: int = 42) -> DataFrame:
    """Evaluation rows with priority fallback, then a seeded cap (L3).

    The prepared raw test split is used when it yields rows; otherwise a
    stable 10% md5 hold-out of the raw synthetic files (H9). Rows get a
    ``row_id`` from their content hash so the cap is partition independent.
    """
    from toolframe.operators.prep import cap_rows, with_row_ids

    chosen = None
    if test_raw and _exists(spark, test_raw):
        ex = eval_examples_of(read_jsonl(spark, test_raw), "prepared")
        chosen = ex if ex.take(1) else None
    if chosen is None and synth_dir and _exists(spark, synth_dir):
        chosen = eval_examples_of(held_out_rows(read_jsonl(spark, synth_dir)), "synthetic", keep_source=False)
    if chosen is None:
        raise SourceError("neither the prepared split nor the raw files give an evaluation example")
    numbered = with_row_ids(chosen.withColumn("expected_args", F.to_json("expected_args")))
    capped = cap_rows(numbered, max_samples, key="row_key", tie="row_id", seed=seed).drop("row_key")
    return capped.withColumn("expected_args", F.parse_json("expected_args"))


def held_out_rows(rows: DataFrame, ratio: float = 0.1) -> DataFrame:
    """H9 on raw rows: the stable share whose content hash falls below the ratio."""
    from toolframe.operators.prep import holdout
    return holdout(rows, F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns) if c != "_corrupt_record"])), ratio)


def eval_examples_of(rows: DataFrame, default_source: str, keep_source: bool = True) -> DataFrame:
    """S6 on raw rows: evaluation examples; a row's own ``source`` wins over the default."""
    from toolframe.operators.evals import normalize_examples
    own = F.coalesce(F.col("source"), F.lit(default_source)) if keep_source and "source" in rows.columns else F.lit(default_source)
    return normalize_examples(rows, own)


def load_sft_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON-lines examples -> ``messages`` (P11), rows that do not convert dropped."""
    return conversations_of(read_jsonl(spark, path)).select("messages")


def conversations_of(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """S7 on raw rows: the kept columns and ``messages``; rows that do not convert are dropped."""
    from toolframe.operators.convo import example_to_conversation
    return rows.select(*keep, example_to_conversation(rows).alias("messages")).filter(F.col("messages").isNotNull())
