"""File sources and sinks: JSONL cases (with a quarantine for bad lines),
CSV, whole-file JSON, file inventory, and JSONL / CSV / report writers.

Case files are read as text and parsed per line (never with an inferred JSON
schema: the fields are free-form and presence is what gets measured)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class BadLinesError(ValueError):
    pass


def parse_json_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Trim, drop blank lines, parse. Adds ``raw`` (trimmed text), ``doc``
    (variant) and ``ok``."""
    t = F.regexp_replace(F.col(text_col), r"^\s+|\s+$", "")
    out = lines.withColumn("raw", t).filter(F.col("raw") != "")
    return out.withColumn("doc", F.try_parse_json("raw")).withColumn("ok", F.col("doc").isNotNull())


def read_case_lines(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Read JSONL case files into ``(source, seq, raw, doc)`` rows and a
    quarantine frame of unparsable lines ``(source, seq, raw)``.

    ``seq`` follows file order (monotonically increasing within a file, no
    per-file sort, so a huge file is never pulled into one task). In strict
    mode the first bad line raises with its file and its ordinal among the
    non-blank lines (one top-1 and one filtered count)."""
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), "value",
                                      F.monotonically_increasing_id().alias("seq"))
    parsed = parse_json_lines(df).drop("value")
    good = parsed.filter("ok").select("source", "seq", "raw", "doc")
    bad = parsed.filter(~F.col("ok")).select("source", "seq", "raw")
    if strict:
        first = bad.orderBy("source", "seq").limit(1).collect()
        if first:
            src, pos = first[0]["source"], first[0]["seq"]
            ordinal = parsed.filter((F.col("source") == src) & (F.col("seq") <= pos)).count()
            raise BadLinesError(f"{src}: invalid JSON on non-blank line {ordinal}")
    return good, bad


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, quoted fields with doubled-quote escape, all columns as
    strings, one record per line; short rows padded (Spark fills NULL, here
    turned into '')."""
    df = (spark.read.option("header", True).option("escape", '"').option("quote", '"')
          .option("multiLine", False).option("mode", "PERMISSIVE").option("inferSchema", False).csv(path))
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON (one document per file)."""
    return spark.read.option("multiLine", True).json(path)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing: ``(path, type, size_kb)`` sorted by path; only
    the listing columns are selected, so file contents are never read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
             .select("path", "length"))
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    return files.select(
        "path", F.when(ext != "", ext).otherwise(F.lit("file")).alias("type"),
        F.greatest(F.lit(1), F.round(F.col("length") / 1024).cast("long")).alias("size_kb"),
    ).orderBy("path")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; absent (NULL) fields are omitted."""
    df.write.mode(mode).option("ignoreNullFields", True).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, NULL written as empty, quoting only when needed."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("nullValue", "")
     .option("emptyValue", "").csv(path))


def report_json(df: DataFrame) -> Column:
    """JSON text of a one-row report frame's row."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]))


def read_macro_csv(spark: SparkSession, path: str, indicator_id: str) -> DataFrame:
    """Macro series CSV: the date column is ``DATE`` or ``observation_date``;
    ``.`` or an empty cell is a missing value; non-finite values are
    dropped. Adds ``pos`` (file order) for last-N selection."""
    raw = read_csv(spark, path).withColumn("pos", F.monotonically_increasing_id())
    cols = set(raw.columns)
    date = F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in ("DATE", "observation_date") if c in cols]) \
        if cols & {"DATE", "observation_date"} else F.lit(None).cast("string")
    v = F.col(f"`{indicator_id}`") if indicator_id in cols else F.lit("")
    value = F.when(v.isin(".", ""), F.lit(None)).otherwise(v.try_cast("double"))
    out = raw.select("pos", date.alias("date"), value.alias("value"))
    return out.filter(F.col("date").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")
                      & (F.abs("value") != float("inf")))
