"""Incremental pack profiles over a stream of landed JSONL case files.

``readStream.text`` → per-line parse and per-case flags (built-in column
expressions, same rules as ``operators.profile``) → a custom stateful
operator (``applyInPandasWithState``) that keeps, per pack, the case count,
the OR of field-presence flags and the OR of pattern flags over all cases it
has seen → completeness per pack in update mode.

A pack is the landed file's name without its extension.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import dims
from ..functions.text import flag

KEYS = [s[0] for s in dims.SIGNALS]
FIELD_KEYS = [k for k, _w, f, _p in dims.SIGNALS if f]
TEXT_KEYS = [k for k, _w, _f, p in dims.SIGNALS if p]
STATE_SCHEMA = "n long, " + ", ".join(f"f_{k} boolean" for k in FIELD_KEYS) + ", " + \
    ", ".join(f"t_{k} boolean" for k in TEXT_KEYS)
OUT_SCHEMA = "pack string, case_count long, present string, completeness double"


def case_flags(lines: DataFrame) -> DataFrame:
    """``(pack, raw)`` lines to per-case boolean flags (blank lines and
    unparsable lines dropped)."""
    raw = F.regexp_replace(F.col("raw"), r"^\s+|\s+$", "")
    parsed = lines.withColumn("raw", raw).filter((F.col("raw") != "") & F.try_parse_json("raw").isNotNull())
    keys = F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>"))
    text = F.lower(F.col("raw"))
    fields = [F.arrays_overlap(keys, F.array(*[F.lit(x) for x in f])).alias(f"f_{k}")
              for k, _w, f, _p in dims.SIGNALS if f]
    texts = [flag(text, p).alias(f"t_{k}") for k, _w, _f, p in dims.SIGNALS if p]
    return parsed.select("pack", *fields, *texts)


def _completeness(present: set[str]) -> float:
    conf = Decimal(dims.CONFIDENCE_WITH_CASES)
    total = sum((Decimal(w) * conf for k, w, _f, _p in dims.SIGNALS if k in present), Decimal(0))
    return float(min(Decimal(1), total.quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP)))


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.exists:
        st = dict(zip(["n", *[f"f_{k}" for k in FIELD_KEYS], *[f"t_{k}" for k in TEXT_KEYS]], state.get))
    else:
        st = {"n": 0, **{f"f_{k}": False for k in FIELD_KEYS}, **{f"t_{k}": False for k in TEXT_KEYS}}
    for pdf in batches:
        for k in FIELD_KEYS:
            st[f"f_{k}"] = bool(st[f"f_{k}"] or pdf[f"f_{k}"].any())
        for k in TEXT_KEYS:
            st[f"t_{k}"] = bool(st[f"t_{k}"] or pdf[f"t_{k}"].any())
        st["n"] = int(st["n"]) + len(pdf)
    state.update(tuple(st.values()))
    present = set()
    for k, _w, fields, pattern in dims.SIGNALS:
        if (fields and st[f"f_{k}"]) or (pattern and st[f"t_{k}"]):
            present.add(k)
    ordered = [k for k in KEYS if k in present]
    yield pd.DataFrame({"pack": [key[0]], "case_count": [st["n"]], "present": [",".join(ordered)],
                        "completeness": [_completeness(present)]})


def pack_signals_stream(spark: SparkSession, input_dir: str, files_per_trigger: int = 100) -> DataFrame:
    """Streaming DataFrame of per-pack profiles (update mode)."""
    lines = (spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(input_dir)
             .select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("pack"),
                     F.col("value").alias("raw")))
    flags = case_flags(lines)
    return flags.groupBy("pack").applyInPandasWithState(
        _update, outputStructType=OUT_SCHEMA, stateStructType=STATE_SCHEMA,
        outputMode="update", timeoutConf=GroupStateTimeout.NoTimeout)


def run_once(spark: SparkSession, input_dir: str, checkpoint_location: str, table_name: str):
    """Process everything landed so far (availableNow) into an in-process
    memory table; returns the finished query."""
    q = (pack_signals_stream(spark, input_dir).writeStream.outputMode("update").format("memory")
         .queryName(table_name).option("checkpointLocation", checkpoint_location)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
