"""Governance inventory and capability rubric: field presence and coverage,
asset summaries, portfolio totals, facets, previews, slugs, search, workflow
labels, coverage matrix and rubric scores. All of it is grouped aggregates
(map-side combined) and column expressions; "first-seen order" lists are
built from ``(group, value) -> min(seq)`` so a list is bounded by the number
of distinct values, never by the number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims

# FIXED VALUES — the eight case fields counted for coverage, in order.
COVERAGE_FIELDS = ["input", "context", "expected", "rubric", "checker", "trace", "environment", "metadata"]
PREVIEW_ROWS = 5
PREVIEW_COLUMNS = 8
PREVIEW_CHARS = 120
# FIXED VALUES — file-name substring -> workflow labels, in rule order, and
# the default.
FILE_WORKFLOW_RULES = [
    ("company_metrics", ["financial QA", "metric extraction", "fundamental analysis"]),
    ("company_snapshots", ["financial QA", "company research"]),
    ("latest_sec_filings", ["filing monitoring", "risk analysis"]),
    ("macro", ["macro context", "risk analysis"]),
    ("prices", ["market context", "price review"]),
    ("pm_research_cards", ["product research", "buyer-facing data cards"]),
]
FILE_WORKFLOW_DEFAULT = ["finance research"]


def present_fields(raw: Column, fields=COVERAGE_FIELDS) -> Column:
    """Listed top-level keys present in a JSON object (JSON null counts)."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.array_intersect(F.array(*[F.lit(f) for f in fields]), keys)


def field_coverage(cases: DataFrame, fields=COVERAGE_FIELDS) -> DataFrame:
    """Per pack: fields present in any case and ``round(n / len * 100)``."""
    keys = F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>"))
    flags = cases.select("pack", *[F.array_contains(keys, f).alias(f"_f{i}") for i, f in enumerate(fields)])
    agg = flags.groupBy("pack").agg(*[F.bool_or(f"_f{i}").alias(f"_f{i}") for i in range(len(fields))])
    present = F.array_compact(F.array(*[F.when(F.col(f"_f{i}"), F.lit(f)) for i, f in enumerate(fields)]))
    return agg.select("pack", present.alias("fields"),
                      F.round(F.size(present) * 100.0 / len(fields)).cast("int").alias("coverage"))


def first_seen_lists(values: DataFrame, key: str, value: str, seq: str, out: str) -> DataFrame:
    """Per ``key``: distinct non-null ``value`` in order of first appearance."""
    firsts = values.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(seq).alias("_s"))
    return firsts.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_s", value))), lambda x: x[value]).alias(out))


def joined_or(values: Column, default: str) -> Column:
    return F.when(F.size(F.coalesce(values, F.array())) > 0, F.array_join(values, ", ")).otherwise(F.lit(default))


def preview(rows: DataFrame, key: str, seq: str, columns: list[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows per key (partial top-n before the shuffle), first 8
    columns, strings longer than 120 characters cut with ``...``."""
    w = Window.partitionBy(key).orderBy(seq)
    top = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    cols = columns[:PREVIEW_COLUMNS]
    dtypes = dict(rows.dtypes)

    def cut(c: str) -> Column:
        if dtypes.get(c) != "string":
            return F.col(c)
        return F.when(F.length(c) > PREVIEW_CHARS, F.concat(F.substring(c, 1, PREVIEW_CHARS), F.lit("..."))) \
            .otherwise(F.col(c)).alias(c)

    return top.select(key, "rank", *[cut(c) for c in cols])


def slugify(value: Column) -> Column:
    """Runs of non-word characters to ``-``; one trailing ``-`` dropped."""
    return F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9_]+", "-"), "-$", "")


def humanize(name: Column) -> Column:
    """File stem split on ``-``/``_``, each part capitalised, joined by blanks."""
    stem = F.regexp_replace(name, r"\.[^./]*$", "")
    parts = F.split(stem, "[-_]")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2), F.length(p)))), " ")


def workflow_labels(name: Column, rules=FILE_WORKFLOW_RULES, default=FILE_WORKFLOW_DEFAULT) -> Column:
    expr = None
    for sub, labels in rules:
        arr = F.array(*[F.lit(x) for x in labels])
        expr = F.when(name.contains(sub), arr) if expr is None else expr.when(name.contains(sub), arr)
    return expr.otherwise(F.array(*[F.lit(x) for x in default]))


def facet_search(rows: DataFrame, term: str, filters: dict[str, str] | None = None) -> DataFrame:
    """Equality filters plus a case-insensitive substring over the row as JSON."""
    out = rows
    for c, v in (filters or {}).items():
        out = out.filter(F.col(c) == v)
    if term.strip():
        out = out.filter(F.lower(F.to_json(F.struct(*[F.col(c) for c in rows.columns]))).contains(term.strip().lower()))
    return out


def rubric_scores(verdicts: DataFrame, key: str) -> DataFrame:
    """``verdicts``: ``(key, capability, verdict, weight)`` with verdict in
    YES / PARTIAL / NO -> weighted mean and tier per key."""
    vmap = F.create_map(*[x for v, s in dims.VERDICT_VALUES for x in (F.lit(v), F.lit(float(s)))])
    scored = verdicts.withColumn("_v", F.element_at(vmap, F.upper("verdict")))
    agg = scored.groupBy(key).agg((F.sum(F.col("weight") * F.col("_v")) / F.sum("weight")).alias("score"))
    return agg.withColumn("tier", score_tier(F.col("score")))


def score_tier(score: Column) -> Column:
    expr = None
    for tier, minimum in dims.SCORE_TIERS:
        cond = score >= float(minimum)
        expr = F.when(cond, F.lit(tier)) if expr is None else expr.when(cond, F.lit(tier))
    return expr.otherwise(F.lit(dims.SCORE_TIER_DEFAULT))


def flatten_contracts(tasks: DataFrame) -> DataFrame:
    """Task contracts ``(id, capabilities map<id, struct<name, definition,
    pass_criteria, evidence, weight>>)`` to one row per capability."""
    return tasks.select(F.col("id").alias("task_id"), F.explode("capabilities").alias("capability_id", "c")) \
        .select("task_id", "capability_id", "c.*")


def capability_grid(capabilities: DataFrame, tasks: DataFrame, contracts: DataFrame, strong: int = 1) -> DataFrame:
    """Every capability against every task: (task, capability, family, cell, evidence) and, per row, the task's and the
    whole grid's count of covered capabilities.

    ``capabilities``: (capability, family, cross_cutting); ``tasks``: (task); ``contracts``: (task, capability, evidence),
    repeated entries add up. A cell is cross-cutting if the capability is judged across tasks, else strong from
    ``strong`` on, weak below it, none without an entry; strong and weak ones are covered. Entries of a capability or a
    task that is not listed are left out.

    The grid is completed from the capability dimension, which is a list of the rules' own size: it is carried to each
    task as one array (a scalar subquery), so no table is joined without a key. Contracts are summed before they meet it."""
    listed = capabilities.select("capability", "family", "cross_cutting").distinct().agg(
        F.array_sort(F.collect_list(F.struct("capability", "family", "cross_cutting"))).alias("all"))
    cells = tasks.select("task").distinct().select("task", F.explode(listed.select("all").scalar()).alias("c")).select("task", "c.*")
    marked = contracts.groupBy("task", "capability").agg(F.sum("evidence").alias("evidence"))
    cell = (F.when(F.col("cross_cutting"), "cross-cutting").when(F.col("evidence") >= strong, "strong")
            .when(F.col("evidence") > 0, "weak").otherwise("none"))
    grid = cells.join(marked, ["task", "capability"], "left").select(
        "task", "capability", "family", cell.alias("cell"), F.coalesce("evidence", F.lit(0)).alias("evidence"))
    hit = F.col("cell").isin("strong", "weak")
    of_task = F.count_if(hit).over(Window.partitionBy("task"))
    covered = grid.where(hit).select("capability").distinct().agg(F.count("*")).scalar()
    return grid.select("*", of_task.alias("task_covered"), covered.alias("grid_covered"))
