"""Inventory, rubric and source jobs over the driver tables.

Stand-in: a case is a document with its whole text, rendered as a case JSON
object whose optional fields appear by its data and by its pack's number
(``documents.source`` without its letters), so that each field is there in
some packs and not in others: see ``case_json``. The texts of every twentieth
pack are replaced by their digests, as prose nearly always holds the words of
some signals. An asset is a pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import industry as ind
from ..operators import inventory as inv
from ..sources.files import parse_json_lines
from ..sources.tables import documents_as_cases, license_from_text, table

# Stand-in workflow rules over page URLs (the stock rule table is
# ``inventory.FILE_WORKFLOW_RULES``, keyed by landed file names).
URL_WORKFLOW_RULES = [("/en/", ["english qa", "retrieval"]), ("/fr/", ["french qa"]),
                      ("?page=", ["pagination review"]), (".org", ["open data"])]
URL_WORKFLOW_DEFAULT = ["web research"]


DIGESTED = "p % 20 = 9"
#: Field -> when a case has it; p is the number of its pack.
CASE_FIELDS = {
    "instruction": "p % 5 = 4", "input": "p % 5 != 1", "messages": "p % 6 = 2", "context": "lang != 'en' AND p % 3 = 0",
    "expected": "n_chars > 2000 AND p % 4 != 2", "acceptanceCriteria": "n_chars > 500 AND p % 3 = 2", "rubric": "lic IS NOT NULL AND p % 2 = 0",
    "checker": "lang IN ('de', 'fr') AND p % 5 != 3", "trace": "n_chars < 300 AND p % 3 != 1", "environment": "n_chars > 15000 AND p % 4 = 3",
    "license": "p % 7 = 3 AND lic IS NOT NULL", "metadata": "p % 7 != 3", "taskType": "lang = 'en' AND p % 4 = 0", "split": "p % 4 != 1",
}


def case_json() -> F.Column:
    """The case JSON of a row (doc_id, text, lang, n_chars, lic, p); fields that a case lacks are left out."""
    def there(field: str) -> F.Column:
        return F.coalesce(F.expr(CASE_FIELDS[field]), F.lit(False))

    def has(field: str, value) -> F.Column:
        return F.when(there(field), value)

    lang, text = F.col("lang"), F.when(F.expr(DIGESTED), F.sha2("text", 256)).otherwise(F.col("text"))
    obj = F.struct(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("caseId"),
        has("taskType", F.when(F.col("n_chars") > 1000, "rag_qa").otherwise("planning")).alias("taskType"),
        has("instruction", F.lit("Answer.")).alias("instruction"),
        has("input", text).alias("input"),
        F.when(~there("input"), text).alias("body"),
        has("messages", F.array(F.struct(F.lit("user").alias("role")))).alias("messages"),
        has("context", F.array(lang)).alias("context"),
        has("expected", F.struct(F.col("n_chars").alias("answer"))).alias("expected"),
        has("acceptanceCriteria", F.array(F.lit("short"))).alias("acceptanceCriteria"),
        has("rubric", F.struct(F.col("lic").alias("pass"))).alias("rubric"),
        has("checker", F.struct(F.when(lang == "de", "regex_match").otherwise("json_subset").alias("type"))).alias("checker"),
        has("trace", F.array(F.lit("search"))).alias("trace"),
        has("environment", F.struct(F.lit(True).alias("big"))).alias("environment"),
        has("license", F.col("lic")).alias("license"),
        has("metadata", F.struct(
            lang.alias("workflow"), F.col("lic").alias("licenseName"), F.lit("landed").alias("provenance"),
            has("split", F.when(F.col("n_chars") > 1000, "test").otherwise("train")).alias("split"))).alias("metadata"),
    )
    return F.to_json(obj)


def json_cases(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "text", "lang", "n_chars", license_from_text("text").alias("lic"),
                                             F.regexp_extract("source", r"(\d+)$", 1).try_cast("int").alias("p"))
    return d.select(F.col("source").alias("pack"), F.col("doc_id").alias("seq"), case_json().alias("raw"),
                    F.col("lang"), F.col("lic").alias("license"))


def field_presence(spark, sf):
    c = json_cases(spark, sf)
    return c.select(F.col("seq").alias("doc_id"), F.array_join(inv.present_fields(F.col("raw")), ",").alias("fields"))


def field_coverage(spark, sf):
    fc = inv.field_coverage(json_cases(spark, sf))
    return fc.select("pack", F.array_join("fields", ",").alias("fields"), "coverage")


def _assets(spark, sf) -> DataFrame:
    c = json_cases(spark, sf)
    meta = c.select("pack", "seq", F.get_json_object("raw", "$.metadata.workflow").alias("workflow"),
                    F.get_json_object("raw", "$.metadata.licenseName").alias("lic"),
                    F.get_json_object("raw", "$.metadata.provenance").alias("prov"))
    counts = c.groupBy("pack").agg(F.count(F.lit(1)).alias("records"), F.min("seq").alias("position"),
                                   F.min_by("lang", "seq").alias("domain"))
    wf = inv.first_seen_lists(meta, "pack", "workflow", "seq", "workflows")
    lic = inv.first_seen_lists(meta, "pack", "lic", "seq", "licenses")
    prov = inv.first_seen_lists(meta, "pack", "prov", "seq", "provenances")
    fc = inv.field_coverage(c)
    return (counts.join(fc, "pack").join(wf, "pack", "left").join(lic, "pack", "left").join(prov, "pack", "left")
            .withColumn("type", F.when(F.col("coverage") >= 50, "Benchmark JSONL").otherwise("JSONL")))


def asset_summary(spark, sf):
    a = _assets(spark, sf)
    return a.select("pack", "records", F.array_join("fields", ",").alias("fields"),
                    inv.joined_or(F.col("workflows"), "unknown").alias("workflows"),
                    inv.joined_or(F.col("licenses"), "unknown").alias("license"),
                    inv.joined_or(F.col("provenances"), "unknown").alias("provenance"), "coverage", "type")


def portfolio_totals(spark, sf):
    a = _assets(spark, sf)
    wf = a.select(F.explode("workflows").alias("w"))
    totals = a.agg(F.sum("records").alias("records"), F.count_distinct("domain").alias("active_domains"),
                   F.coalesce(F.round(F.avg("coverage")).cast("int"), F.lit(0)).alias("avg_coverage"),
                   F.count(F.lit(1)).alias("assets"))
    w = wf.agg(F.count_distinct("w").alias("workflows"))
    from .curate import fold_rows
    return fold_rows(totals, w).select("records", "active_domains", "workflows", "avg_coverage", "assets")


def facet_counts(spark, sf):
    a = _assets(spark, sf)
    dom = a.groupBy("domain").agg(F.min("position").alias("first_position"), F.count(F.lit(1)).alias("assets")) \
        .select(F.lit("domain").alias("facet"), F.col("domain").alias("value"), "first_position", "assets")
    typ = a.groupBy("type").agg(F.min("position").alias("first_position"), F.count(F.lit(1)).alias("assets")) \
        .select(F.lit("type").alias("facet"), F.col("type").alias("value"), "first_position", "assets")
    return dom.unionByName(typ)


def preview_top5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", F.col("source").alias("pack"), "n_chars")
    p = inv.preview(d, "pack", "doc_id", ["doc_id", "text", "lang", "n_chars"])
    return p.select("pack", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("text").alias("text_preview"),
                    "lang", "n_chars")


def json_field_or_default(spark, sf):
    c = json_cases(spark, sf)
    return c.select(F.col("seq").alias("doc_id"),
                    F.coalesce(F.get_json_object("raw", "$.checker.type"), F.lit("unknown")).alias("checker_type"))


def slugify(spark, sf):
    p = table(spark, sf, "pages")
    last = F.regexp_extract("url", r"/([^/?#]*)(?:[?#].*)?$", 1)
    return p.select("page_id", inv.slugify(F.col("url")).alias("slug"), inv.humanize(last).alias("name"))


def facet_search(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return inv.facet_search(d, "License", {"lang": "en"}).select("doc_id")


def workflow_labels(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.array_join(inv.workflow_labels(F.col("url"), URL_WORKFLOW_RULES, URL_WORKFLOW_DEFAULT),
                                            ",").alias("labels"))


def token_sets(spark, sf):
    from ..functions.text import token_set
    d = table(spark, sf, "documents")
    t = token_set(F.col("text"))
    return d.select("doc_id", F.size(t).alias("n_tokens"), F.array_join(F.array_sort(t), " ").alias("tokens"))


def live_domains(spark, sf):
    """Taxonomy slugs flagged live when some pack's primary industry is that
    slug (stand-in taxonomy)."""
    from .packs import TAXONOMY
    cases = documents_as_cases(spark, sf)
    scores = ind.industry_scores(ind.keyword_matches(cases, TAXONOMY), TAXONOMY)
    prim = ind.industry_top(scores, cases, TAXONOMY).filter(F.col("rank") == 1).select(F.col("slug")).distinct() \
        .withColumn("live", F.lit(True))
    tax = ind.taxonomy_dim(spark, TAXONOMY).select("slug", "label")
    return tax.join(prim, "slug", "left").select("slug", "label", F.coalesce("live", F.lit(False)).alias("live"))


def coverage_matrix(spark, sf):
    """One row per pack and language that has documents: strong (>= 15) or
    weak; a pair without a row is none. covered = languages of the pack."""
    cells = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"))
    covered = F.count("lang").over(Window.partitionBy("source"))
    return cells.select("source", "lang", "documents", F.when(F.col("documents") >= 15, "strong").otherwise("weak")
                        .alias("strength"), covered.alias("covered"))


#: Stand-in capability dimension: capability, family, whether it is judged across tasks.
CAPABILITIES = [("lang-de", "language", False), ("lang-en", "language", False), ("lang-es", "language", False), ("lang-fr", "language", False),
                ("lang-it", "language", False), ("license-notice", "law", False), ("long-text", "size", False), ("very-short", "size", False),
                ("self-correction", "trace", True), ("unasked", "trace", False)]
STRONG_FROM = 15


def capability_grid(spark, sf):
    """Capabilities against packs as tasks: a document is evidence for its language, for a license notice, and for long
    or very short texts; one capability is judged across tasks, two have no evidence anywhere."""
    caps = spark.createDataFrame(CAPABILITIES, "capability string, family string, cross_cutting boolean")
    d = table(spark, sf, "documents").select(F.col("source").alias("task"), "lang", "n_chars", license_from_text("text").alias("lic"))
    named = F.array_compact(F.array(F.concat(F.lit("lang-"), F.col("lang")), F.when(F.col("lic").isNotNull(), "license-notice"),
                                    F.when(F.col("n_chars") > 5000, "long-text"), F.when(F.col("n_chars") < 20, "very-short"),
                                    F.lit("self-correction"), F.lit("not listed")))
    contracts = d.select("task", F.explode(named).alias("capability")).groupBy("task", "capability").agg(F.count("*").alias("evidence"))
    return inv.capability_grid(caps, d.select("task"), contracts, STRONG_FROM)


def _rubric(spark, sf) -> DataFrame:
    lab = table(spark, sf, "labels")
    rows = lab.select("doc_id", F.explode(F.array(
        F.struct(F.lit("quality").alias("capability"), F.when(F.col("quality") == 1, "YES").otherwise("NO").alias("verdict"),
                 F.lit(2.0).alias("weight")),
        F.struct(F.lit("safety").alias("capability"), F.when(F.col("toxic") == 0, "YES").otherwise("PARTIAL").alias("verdict"),
                 F.lit(1.0).alias("weight")))).alias("v")).select("doc_id", "v.*")
    return inv.rubric_scores(rows, "doc_id")


def rubric_score(spark, sf):
    return _rubric(spark, sf).select("doc_id", "score")


def rubric_tier(spark, sf):
    return _rubric(spark, sf).select("doc_id", "score", "tier")


def scan_json_lines(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("props").alias("value"))
    p = parse_json_lines(ev)
    return p.select("event_id", "ok", F.get_json_object("raw", "$.k").cast("long").alias("k"))

