"""Schema-signal profile per pack (distributed aggregate).

A *pack* is a group key, a *case* a row ``(pack, seq, raw[, license])`` where
``raw`` is the case as JSON text (or any text) and ``seq`` its position.

Plan shape (see ``tests/test_plans.py``): one projection of the key and pattern
flags of every case, and one hash aggregate over all cases with map-side partial
aggregation. A pack that holds a third of all rows costs one partial row per
map task, never one big task, and every case counts, however many a pack has.

Because no pattern can span two JSON records, "pattern over the concatenated
cases" equals ``bool_or(pattern per case)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import flag

SIGNAL_KEYS = [s[0] for s in dims.SIGNALS]
_DEC = "decimal(10,4)"


def _dec(value: str) -> Column:
    return F.lit(value).cast(_DEC)


def case_license(raw: Column) -> Column:
    """First non-null of licenseName, license, metadata.licenseName,
    metadata.license; used only when it is a non-blank string (trimmed).
    JSON null counts as absent here; a non-string value disqualifies the row."""
    v = F.try_parse_json(raw)

    def path(p: str) -> Column:
        x = F.try_variant_get(v, p, "variant")
        return F.when(~F.is_variant_null(x), x)

    meta = F.try_variant_get(v, "$.metadata", "variant")
    meta_is_obj = F.schema_of_variant(meta).startswith("OBJECT")
    first = F.coalesce(
        path("$.licenseName"),
        path("$.license"),
        F.when(meta_is_obj, path("$.metadata.licenseName")),
        F.when(meta_is_obj, path("$.metadata.license")),
    )
    as_str = F.when(F.schema_of_variant(first) == "STRING", F.trim(F.variant_get(first, "$", "string")))
    return F.when(as_str != "", as_str)


def _text_flag_exprs(text: Column) -> list[Column]:
    out = []
    for key, _w, _fields, pattern in dims.SIGNALS:
        if pattern is not None:
            out.append(flag(text, pattern).alias(f"t_{key}"))
    for ttype, pattern in dims.TASK_TYPE_RULES:
        out.append(flag(text, pattern).alias(f"tt_{ttype}"))
    return out


def _text_flag_names() -> list[str]:
    return [f"t_{k}" for k, _w, _f, p in dims.SIGNALS if p is not None] + \
        [f"tt_{t}" for t, _p in dims.TASK_TYPE_RULES]


def case_facts(cases: DataFrame) -> DataFrame:
    """All that the rules read of each case, in narrow columns: key presence and pattern flags per signal, license,
    explicit task type, any ``messages`` array. Stored once, it spares every other step the text; where a step takes
    ``cases`` it takes their facts as well."""
    if "_msgs" in cases.columns:
        return cases
    keys = F.json_object_keys(F.col("raw"))
    lic = F.col("license") if "license" in cases.columns else case_license(F.col("raw"))
    ttype = F.get_json_object(F.col("raw"), "$.taskType")
    is_msgs = F.json_array_length(F.get_json_object(F.col("raw"), "$.messages")).isNotNull()
    proj = [F.col("pack"), F.col("seq")]
    for key, _w, fields, _p in dims.SIGNALS:
        if fields:
            present = F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(f) for f in fields])), F.lit(False))
            proj.append(present.alias(f"f_{key}"))
    proj += [lic.alias("_lic"), ttype.alias("_tt"), is_msgs.alias("_msgs")]
    return cases.select(*proj, *_text_flag_exprs(F.lower(F.col("raw"))))


def case_field_aggregates(cases: DataFrame) -> DataFrame:
    """Per pack over all cases: row count, key presence and pattern flags per
    signal, first usable license, first explicit task type, any ``messages`` array."""
    rows = case_facts(cases)
    aggs = [F.count(F.lit(1)).alias("case_count")]
    for key, _w, fields, _p in dims.SIGNALS:
        if fields:
            aggs.append(F.bool_or(f"f_{key}").alias(f"f_{key}"))
    aggs += [F.bool_or(c).alias(c) for c in _text_flag_names()]
    aggs += [
        F.min_by("_lic", F.when(F.col("_lic").isNotNull(), F.col("seq"))).alias("case_license"),
        F.min_by("_tt", F.when(F.col("_tt").isNotNull() & (F.col("_tt") != ""), F.col("seq"))).alias("explicit_type"),
        F.bool_or("_msgs").alias("has_messages"),
    ]
    return rows.groupBy("pack").agg(*aggs)


def profile(cases: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """One row per pack with the full schema profile.

    ``cases``: ``(pack, seq, raw[, license])`` or their ``case_facts``.
    ``candidates``: ``(pack, cand_text, cand_license, cand_task_tags)`` where
    ``cand_text`` is the lower-cased JSON of the candidate and
    ``cand_license`` its license name (may be NULL).
    """
    if cases is None and candidates is None:
        raise ValueError("profile needs cases or candidates")
    parts = []
    if cases is not None:
        parts.append(case_field_aggregates(cases))
    if candidates is not None:
        ct = F.col("cand_text")
        cand = candidates.select(
            "pack", F.lit(True).alias("has_candidate"), "cand_license",
            F.array_contains(F.coalesce(F.col("cand_task_tags"), F.array().cast("array<string>")),
                             dims.RAG_TASK_TAG).alias("cand_qa_tag"),
            *[flag(ct, p).alias(f"c_{k}") for k, _w, _f, p in dims.SIGNALS if p is not None],
            *[flag(ct, p).alias(f"ct_{t}") for t, p in dims.TASK_TYPE_RULES],
        )
        parts.append(cand)
    base = parts[0] if len(parts) == 1 else parts[0].join(parts[1], "pack", "full")
    cols = set(base.columns)

    def col_or(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in cols else F.lit(default)

    n_cases = col_or("case_count", 0)
    has_cand = col_or("has_candidate", False)
    present: dict[str, Column] = {}
    for key, _w, fields, pattern in dims.SIGNALS:
        terms = []
        if fields:
            terms.append(col_or(f"f_{key}", False))
        if pattern is not None:
            terms += [col_or(f"t_{key}", False), col_or(f"c_{key}", False)]
        if key == "metadata":
            terms.append(has_cand)
        if key == "license":
            cand_lic = F.col("cand_license") if "cand_license" in cols else F.lit(None).cast("string")
            lic_name = F.coalesce(cand_lic, col_or("case_license", None).cast("string"))
            terms = [F.coalesce(lic_name != "", F.lit(False))]
        expr = terms[0]
        for t in terms[1:]:
            expr = expr | t
        present[key] = expr

    conf = F.when(n_cases > 0, _dec(dims.CONFIDENCE_WITH_CASES)).otherwise(_dec(dims.CONFIDENCE_METADATA_ONLY))
    total = None
    for key, weight, _f, _p in dims.SIGNALS:
        term = F.when(F.col(f"s_{key}"), _dec(weight) * F.col("confidence")).otherwise(_dec("0"))
        total = term if total is None else total + term
    completeness = F.least(F.greatest(F.round(total, 4), _dec("0")), _dec("1")).cast(_DEC)

    def tflag(t: str) -> Column:
        return col_or(f"tt_{t}", False) | col_or(f"ct_{t}", False)

    cascade = F.when(col_or("cand_qa_tag", False) | tflag("rag_qa"), F.lit("rag_qa"))
    for t, _p in dims.TASK_TYPE_RULES[1:]:
        cascade = cascade.when(tflag(t), F.lit(t))
    cascade = cascade.when(col_or("has_messages", False), F.lit("dialogue")).otherwise(F.lit("custom"))
    task_type = F.coalesce(col_or("explicit_type", None).cast("string"), cascade)

    out = base.select(
        "pack",
        n_cases.cast("long").alias("case_count"),
        *[present[k].alias(f"s_{k}") for k in SIGNAL_KEYS],
        conf.alias("confidence"),
        task_type.alias("task_type"),
        (F.col("cand_license") if "cand_license" in cols else F.lit(None).cast("string")).alias("cand_license"),
        col_or("case_license", None).cast("string").alias("case_license"),
        col_or("explicit_type", None).cast("string").alias("explicit_type"),
    )
    out = out.withColumn("completeness", completeness)
    out = out.withColumn("readiness_level", readiness_level(F.col("completeness")))
    out = out.withColumn("present", F.array_compact(F.array(*[F.when(F.col(f"s_{k}"), F.lit(k)) for k in SIGNAL_KEYS])))
    out = out.withColumn("missing", F.array_compact(F.array(*[F.when(~F.col(f"s_{k}"), F.lit(k)) for k in SIGNAL_KEYS])))
    out = out.withColumn("missing_critical", F.array_compact(F.array(
        *[F.when(~F.col(f"s_{k}"), F.lit(k)) for k in SIGNAL_KEYS if k in dims.CRITICAL_SIGNALS])))
    out = out.withColumn("license_name", F.coalesce(F.col("cand_license"), F.col("case_license")))
    out = out.withColumn("evaluators", evaluator_candidates())
    out = out.withColumn("notes", profile_notes())
    return out


def readiness_level(completeness: Column) -> Column:
    expr = None
    for level, minimum, required in dims.READINESS_RULES:
        cond = completeness >= _dec(minimum)
        for r in required:
            cond = cond & F.col(f"s_{r}")
        expr = F.when(cond, F.lit(level)) if expr is None else expr.when(cond, F.lit(level))
    return expr.otherwise(F.lit(1))


def evaluator_candidates() -> Column:
    """Base list with rule items put in front, later rules first; distinct."""
    arr = F.array(*[F.lit(x) for x in dims.EVALUATOR_BASE])
    for key, items in dims.EVALUATOR_RULES:
        if key == "@extraction_or_classification":
            cond = F.col("task_type").isin("data_extraction", "classification")
        else:
            cond = F.col(f"s_{key}")
        arr = F.when(cond, F.concat(F.array(*[F.lit(x) for x in items]), arr)).otherwise(arr)
    return F.array_distinct(arr)


def profile_notes() -> Column:
    pct = F.round(F.col("completeness") * 100, 0).cast("int")
    missing_txt = F.array_join(F.col("missing"), ", ")
    return F.array_compact(F.array(
        F.format_string("Inferred task type: %s.", F.col("task_type")),
        F.format_string("Schema completeness: %d%%.", pct),
        F.when(F.size("missing") > 0, F.format_string("Missing fields: %s.", missing_txt)),
        F.when(~F.col("s_checker"), F.lit(dims.NOTE_MISSING_CHECKER)),
        F.when(~F.col("s_license"), F.lit(dims.NOTE_MISSING_LICENSE)),
    ))


def signals_long(prof: DataFrame) -> DataFrame:
    """Unpivot the per-pack signal booleans into ``(pack, ordinal, signal,
    present, confidence)`` rows."""
    stacked = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("ordinal"), F.lit(k).alias("signal"), F.col(f"s_{k}").alias("present"))
        for i, k in enumerate(SIGNAL_KEYS)]))
    out = prof.select("pack", "confidence", stacked.alias("s")).select("pack", "s.*", "confidence")
    return out.withColumn("confidence", F.when(F.col("present"), F.col("confidence")).otherwise(_dec("0")))


EVIDENCE = 3


def first_cases(cases: DataFrame, k: int = EVIDENCE) -> DataFrame:
    """(pack, signal, first_cases): the first ``k`` (seq, kind) of each signal's hits in a pack, kinds in alphabetical
    order within a case (field, license, text). The ranked window keeps ``k`` rows of a group in each task before
    the shuffle, so a pack or a signal that holds a third of all hits costs ``k`` rows a task."""
    facts, found = case_facts(cases), []  # the tests are columns: inside the array each would parse the case anew
    for key, _w, fields, pattern in dims.SIGNALS:
        tests = [("field", F.col(f"f_{key}"))] if fields else []
        tests += [("text", F.col(f"t_{key}"))] if pattern is not None else []
        tests += [("license", F.col("_lic").isNotNull())] if key == "license" else []
        found += [F.when(test, F.struct(F.lit(key).alias("signal"), F.lit(kind).alias("kind"))) for kind, test in tests]
    hits = facts.select("pack", "seq", F.explode(F.array_compact(F.array(*found))).alias("h")).select("pack", "seq", "h.*")
    order = Window.partitionBy("pack", "signal").orderBy("seq", "kind")
    hits = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return hits.groupBy("pack", "signal").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("r", "seq", "kind"))), lambda x: F.struct(x["seq"].alias("seq"), x["kind"].alias("kind"))).alias("first_cases"))


def signal_evidence(prof: DataFrame, cases: DataFrame) -> DataFrame:
    """Per pack and signal: ``evidence`` (at most three entries, the candidate's license first) and the first cases
    that show the signal; both empty where it is absent or only the candidate shows it."""
    lic = F.concat(F.lit("license="), F.col("cand_license"))
    named = F.when((F.col("signal") == "license") & (F.coalesce("cand_license", F.lit("")) != ""), lic)
    entries = F.slice(F.array_compact(F.array(named, F.concat(F.lit("matched "), F.col("signal")))), 1, EVIDENCE)
    none = F.array().cast("array<string>")
    long = signals_long(prof).join(prof.select("pack", "cand_license"), "pack").join(first_cases(cases), ["pack", "signal"], "left")
    return long.select("pack", "ordinal", "signal", "present", "confidence", F.when(F.col("present"), entries).otherwise(none).alias("evidence"),
                       F.coalesce("first_cases", F.array().cast("array<struct<seq: bigint, kind: string>>")).alias("first_cases"))


def case_type_lists(cases: DataFrame) -> DataFrame:
    """Per pack: explicit case task types in first-seen order, distinct.
    Grouped by (pack, type) first, so a list is bounded by the number of
    distinct types, never by the number of cases."""
    ttype = F.col("_tt") if "_tt" in cases.columns else F.get_json_object(F.col("raw"), "$.taskType")
    firsts = (cases.select("pack", "seq", ttype.alias("t"))
              .filter(F.col("t").isNotNull() & (F.col("t") != ""))
              .groupBy("pack", "t").agg(F.min("seq").alias("first_seq")))
    return firsts.groupBy("pack").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "t"))), lambda s: s["t"]).alias("case_types"))


def ordered_task_types(task_type: Column, case_types: Column) -> Column:
    """Pack task type first, then the case types, distinct."""
    return F.array_distinct(F.concat(F.array(task_type), F.coalesce(case_types, F.array().cast("array<string>"))))


def task_types_ordered(cases: DataFrame, prof: DataFrame) -> DataFrame:
    """``(pack, task_types)``: the pack's task type, then explicit case types."""
    return (prof.select("pack", "task_type").join(case_type_lists(cases), "pack", "left")
            .select("pack", ordered_task_types(F.col("task_type"), F.col("case_types")).alias("task_types")))
