"""Catalog jobs over the driver tables.

Stand-ins: a hub dump row is a page (id = host + path, description = the
page's whole text without its markup, language/license/format tags from the
markup, gated when the URL has a query string, disabled without a title,
downloads = markup length, likes = links); a repository dump row is a document
(name = source/doc-id, description = its whole text, topics = language and
source, license = the license line, private when Spanish); a search query is a
``benchmark`` text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog as ct
from ..operators import profile as pf
from ..sources.tables import license_from_text, table

HUB_LICENSE = r"(?:Licensed|licensed|Released) under (?:the )?([^<.,]+)"
REPO_HOST = "https://code.example/"
TOP_N = 10


def hub_items(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    lic = F.regexp_extract("html", HUB_LICENSE, 1)
    lang = F.regexp_extract("html", r'<html lang="([^"]*)"', 1)
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    words = F.trim(F.regexp_replace("html", r"<[^>]*>", " "))
    tags = F.array_compact(F.array(
        F.concat(F.lit("language:"), lang), F.lit("format:html"), F.lit("modality:text"),
        F.when(lic != "", F.concat(F.lit("license:"), lic)),
        F.when(F.col("url").contains("/en/"), F.lit("task_categories:question-answering")),
        F.when(F.col("url").contains("#"), F.lit("benchmark"))))
    return p.select(F.col("page_id").alias("seq"), F.concat(host, path).alias("id"),
                    F.regexp_extract(host, r"^([^.]+)", 1).alias("author"),
                    F.col("url").contains("?").alias("gated"), (title == "").alias("disabled"),
                    F.when(words != "", words).alias("description"),
                    F.length("html").cast("long").alias("downloads"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("likes"),
                    F.lit(None).cast("string").alias("created_at"), F.lit(None).cast("string").alias("last_modified"), tags.alias("tags"))


def repo_items(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("id"),
                    F.concat(F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string")).alias("full_name"),
                    F.concat(F.lit(REPO_HOST), F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string")).alias("html_url"),
                    F.col("text").alias("description"),
                    F.array(F.col("lang"), F.col("source")).alias("topics"), F.col("lang").alias("language"),
                    (F.col("lang") == "es").alias("private"), F.when(F.col("lang") == "es", "private").otherwise("public").alias("visibility"),
                    license_from_text("text").alias("spdx_id"), F.col("n_chars").cast("long").alias("stars"))


def _hub(spark, sf):
    return ct.normalize_hub(hub_items(spark, sf))


def _repo(spark, sf):
    return ct.normalize_repo(repo_items(spark, sf))


def catalog_normalize_hub(spark, sf):
    h = _hub(spark, sf)
    return h.select(F.col("seq").alias("page_id"), "id", "record_kind", "license_name", "risk",
                    F.array_join("languages", ",").alias("languages"), F.array_join("task_types", ",").alias("task_types"),
                    F.array_join("modalities", ",").alias("modalities"), F.array_join("file_formats", ",").alias("file_formats"),
                    "has_download", "has_samples")


def catalog_normalize_repo(spark, sf):
    r = _repo(spark, sf)
    return r.select(F.col("seq").alias("doc_id"), "id", "title", "record_kind", "license_name", "risk",
                    F.array_join("languages", ",").alias("languages"), F.array_join("task_types", ",").alias("task_types"),
                    F.array_join("modalities", ",").alias("modalities"), "has_samples")


def license_risk_hub(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", license_from_text("text").alias("license_name"),
                                             (F.col("lang") == "es").alias("gated"))
    return d.select("doc_id", "license_name", ct.license_risk(F.col("license_name"), F.col("gated"), "hub").alias("risk"))


def license_risk_repo(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", license_from_text("text").alias("license_name"),
                                             (F.col("lang") == "es").alias("private"))
    return d.select("doc_id", "license_name", ct.license_risk(F.col("license_name"), F.col("private"), "repo").alias("risk"))


def record_kind(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ct.repo_record_kind(F.col("text")).alias("record_kind"))


def task_tags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(ct.task_tags(F.col("text")), ",").alias("tags"))


def modality_tags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(ct.modality_tags(F.col("text")), ",").alias("modalities"))


def prefixed_tags(spark, sf):
    h = hub_items(spark, sf)
    return h.select(F.col("seq").alias("page_id"), F.array_join(ct.tag_values(F.col("tags"), "language:"), ",").alias("languages"),
                    F.array_join(ct.tag_values(F.col("tags"), "format:"), ",").alias("formats"),
                    ct.first_tag_value(F.col("tags"), "license:").alias("license_name"))


def query_variants(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.posexplode(ct.query_variants(F.col("text"))).alias("pos", "variant")) \
        .select("item_id", F.col("pos").cast("int").alias("pos"), "variant")


def union_sources(spark, sf):
    u = _hub(spark, sf).unionByName(_repo(spark, sf))
    return u.select("source", F.col("seq").alias("seq"), "id", "record_kind", "license_name", "risk")


def catalog_dedupe(spark, sf):
    """Repository candidates keyed by ``source:language/source`` (many rows
    per key): last value, first position."""
    r = _repo(spark, sf).withColumn("key", F.concat(F.col("source"), F.lit(":"), F.element_at("languages", 1),
                                                     F.lit("/"), F.element_at("tags", 2)))
    d = ct.dedupe_by_key(r.select("key", "seq", "title", "record_kind"), ["key"])
    return d.select("key", "position", "last_seq", "title", "record_kind")


def _cand_text():
    return F.lower(F.concat_ws(" ", F.col("id"), F.col("title"), F.coalesce(F.col("summary"), F.lit("")),
                               F.coalesce(F.col("license_name"), F.lit("")), F.array_join("tags", " ")))


def catalog_topk(spark, sf):
    """Hub candidates scored with the metadata-only profile and ranked by
    readiness level, then completeness, then position; top 10."""
    h = _hub(spark, sf)
    cands = h.select(F.col("seq").cast("string").alias("pack"), _cand_text().alias("cand_text"),
                     F.col("license_name").alias("cand_license"), F.col("task_types").alias("cand_task_tags"))
    prof = pf.profile(candidates=cands).select(F.col("pack").cast("long").alias("page_id"), "readiness_level",
                                              "completeness")
    top = prof.orderBy(F.col("readiness_level").desc(), F.col("completeness").desc(), F.col("page_id")).limit(TOP_N)
    return top.select("page_id", F.col("readiness_level").cast("int").alias("readiness_level"),
                      F.col("completeness").cast("double").alias("completeness"))


def source_quota(spark, sf):
    u = _hub(spark, sf).unionByName(_repo(spark, sf))
    q = ct.source_quota(u, TOP_N, n_sources=2)
    return q.select("source", F.col("rank").cast("int").alias("rank"), "seq", "id")


SEARCH_LIMIT = 5


def fallback_search(spark, sf):
    """Each benchmark text is a query; its variants search the documents."""
    b = table(spark, sf, "benchmark")
    v = b.select(F.col("item_id").alias("qid"), F.posexplode(ct.query_variants(F.col("text"))).alias("pos", "variant")) \
        .select("qid", (F.col("pos") + 1).alias("k"), "variant")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    r = ct.fallback_search(v, docs, SEARCH_LIMIT)
    return r.select(F.col("qid").alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id",
                    F.col("first_k").cast("int").alias("variant_k"))


def candidate_domains(spark, sf):
    """Industry slugs inferred from each hub and repository candidate's text
    (stand-in taxonomy)."""
    from .packs import TAXONOMY
    h = hub_items(spark, sf).select(F.concat(F.lit("hub:"), F.col("seq").cast("string")).alias("pack"),
                                    F.concat_ws(" ", "id", F.coalesce("description", F.lit("")),
                                                F.array_join("tags", " ")).alias("cand_industry_text"))
    r = repo_items(spark, sf).select(F.concat(F.lit("repo:"), F.col("seq").cast("string")).alias("pack"),
                                     F.concat_ws(" ", "full_name", F.coalesce("description", F.lit("")),
                                                 F.array_join(F.transform("topics", lambda t: F.lower(t)), " "))
                                     .alias("cand_industry_text"))
    d = ct.candidate_domains(h.unionByName(r), TAXONOMY)
    return d.select("pack", F.array_join("domains", ",").alias("domains"))


def catalog_industry(spark, sf):
    """Industry profile of each hub candidate, two passes: domains are
    inferred from the raw item text, then the candidate is scored from its
    searchable text (title, summary, domains, task types, modalities,
    metadata JSON) with +0.45 for every slug among its domains."""
    from ..operators import industry as ind
    from .packs import TAXONOMY
    items = hub_items(spark, sf)
    first = items.select(F.col("seq").cast("string").alias("pack"),
                         F.concat_ws(" ", "id", F.coalesce("description", F.lit("")), F.array_join("tags", " "))
                         .alias("cand_industry_text"))
    dom = ct.candidate_domains(first, TAXONOMY)
    h = ct.normalize_hub(items).select(F.col("seq").cast("string").alias("pack"), "title", "summary", "task_types",
                                       "modalities", "seq")
    meta = items.select(F.col("seq").cast("string").alias("pack"),
                        F.to_json(F.struct("author", "downloads")).alias("meta"))
    cand = (h.join(dom, "pack").join(meta, "pack")
            .select("pack", "seq", "domains", F.concat_ws(
                " ", "title", F.coalesce("summary", F.lit("")), F.array_join("domains", " "),
                F.array_join("task_types", " "), F.array_join("modalities", " "), "meta").alias("cand_industry_text")))
    explicit = cand.select("pack", F.explode("domains").alias("slug"))
    m = ind.keyword_matches(None, TAXONOMY, candidates=cand.select("pack", "cand_industry_text"))
    top = ind.industry_top(ind.industry_scores(m, TAXONOMY, explicit=explicit), cand.select("pack"), TAXONOMY)
    prof = ind.industry_profile(top, TAXONOMY)
    conf = top.filter(F.col("rank") == 1).select("pack", F.col("confidence").cast("double").alias("confidence"))
    return (cand.join(prof, "pack").join(conf, "pack")
            .select(F.col("seq").alias("page_id"), F.array_join("domains", ",").alias("domains"), "primary_industry",
                    "confidence", "is_industry_specific"))


DISCOVER_LIMIT = 6


def discover(spark, sf):
    """The best candidates of both dumps for each benchmark text: found by its variants, profiled over the whole
    candidate, segmented with the query's words, planned and ranked."""
    from ..operators import discovery
    from .packs import TAXONOMY
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    found = discovery.discover(queries, [_hub(spark, sf), _repo(spark, sf)], DISCOVER_LIMIT, TAXONOMY)
    first = F.get("industry_matches", F.lit(0))
    return found.select(
        F.col("qid").alias("item_id"), F.col("rank").cast("int").alias("rank"), "source", "id",
        F.try_variant_get("candidate", "$.title", "string").alias("title"), F.try_variant_get("candidate", "$.sourceUrl", "string").alias("source_url"),
        F.try_variant_get("candidate", "$.commercialRisk", "string").alias("risk"), F.array_join("domains", ",").alias("domains"),
        F.col("completeness").cast("double").alias("completeness"), F.col("readiness_level").cast("int").alias("readiness_level"), "task_type",
        F.array_join("missing", ",").alias("missing"), "primary_industry", first["confidence"].cast("double").alias("confidence"),
        F.array_join(first["matched_keywords"], ",").alias("matched_keywords"), "is_industry_specific",
        F.array_join(F.transform("industry_matches", lambda m: m["slug"]), ",").alias("industries"),
        F.col("plan.current_tier").alias("current_tier"), F.col("plan.target_tier").alias("target_tier"),
        F.col("plan.estimated_readiness_lift").cast("double").alias("lift"), F.array_join("plan.workflow_focus", ",").alias("workflow_focus"),
        F.array_join(F.transform("plan.steps", lambda s: F.concat(
            s["step_id"], F.lit(":"), F.array_join(s["inputs"], "+"), F.lit(">"), F.array_join(s["outputs"], "+"))), ",").alias("steps"),
        F.array_join("plan.packaging_risks", " | ").alias("risks"))
