"""Dataset catalog: normalise landed hub / repository dumps into one
candidate table, apply license-risk and tagging rules, dedupe by
``source:id``, rank and apply per-source quotas.

All rules are column expressions; dedupe is ``max_by``/``min`` (map-side
combined), ranking is ``orderBy().limit()`` (``TakeOrderedAndProject``) and
per-source quotas are ``row_number() <= quota`` (partial ``WindowGroupLimit``
before the shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import flag


def license_risk(license_name: Column, restricted_flag: Column, variant: str) -> Column:
    """Risk level from a license name; ``variant`` is ``hub`` or ``repo``
    (the repo rule does not treat cc-by as low and adds lgpl to medium)."""
    low = dims.RISK_LOW_HUB if variant == "hub" else dims.RISK_LOW_REPO
    med = dims.RISK_MEDIUM_HUB if variant == "hub" else dims.RISK_MEDIUM_REPO
    name = F.coalesce(license_name, F.lit(""))
    return (F.when(F.coalesce(restricted_flag, F.lit(False)), F.lit("restricted"))
            .when(name == "", F.lit("unknown"))
            .when(name.rlike(f"(?i){dims.RISK_RESTRICTED}"), F.lit("restricted"))
            .when(name.rlike(f"(?i){low}"), F.lit("low"))
            .when(name.rlike(f"(?i){med}"), F.lit("medium"))
            .otherwise(F.lit("medium")))


def repo_record_kind(text: Column) -> Column:
    """benchmark / dataset / repository. The dataset pattern is an
    alternation: ``\\bdataset`` or ``corpus\\b``. Word boundaries are
    written as ASCII classes so every engine agrees (``\\b`` in Java also
    treats accented letters as word characters)."""
    t = F.lower(text)
    # a substring search first: the expressions are tried only on texts that hold the word
    return (F.when(t.contains("benchmark") & t.rlike(r"(^|[^a-z0-9_])benchmark([^a-z0-9_]|$)"), F.lit("benchmark"))
            .when((t.contains("dataset") & t.rlike(r"(^|[^a-z0-9_])dataset"))
                  | (t.contains("corpus") & t.rlike(r"corpus([^a-z0-9_]|$)")), F.lit("dataset"))
            .otherwise(F.lit("repository")))


def task_tags(text: Column) -> Column:
    t = F.lower(text)
    tags = F.array_compact(F.array(*[F.when(flag(t, p), F.lit(tag)) for tag, p in dims.REPO_TASK_RULES]))
    return F.when(F.size(tags) == 0, F.array(F.lit(dims.REPO_TASK_DEFAULT))).otherwise(tags)


def modality_tags(text: Column) -> Column:
    t = F.lower(text)
    return F.array_compact(F.array(F.lit("text"), *[F.when(flag(t, p), F.lit(m)) for m, p in dims.MODALITY_RULES]))


def tag_values(tags: Column, prefix: str) -> Column:
    """Tags with ``prefix``, prefix stripped, empties dropped (order kept)."""
    n = len(prefix)
    vals = F.transform(F.filter(tags, lambda t: t.startswith(prefix)), lambda t: F.substr(t, F.lit(n + 1), F.length(t)))
    return F.filter(vals, lambda v: v != "")


def first_tag_value(tags: Column, prefix: str) -> Column:
    return F.try_element_at(tag_values(tags, prefix), F.lit(1))


def normalize_hub(items: DataFrame) -> DataFrame:
    """Hub dump rows ``(seq, id, author, gated, disabled, description,
    downloads, likes, created_at, last_modified, tags)`` to candidate rows;
    rows without id or disabled are dropped. ``metadata`` and ``raw`` (the
    whole item) are VARIANTs, as their fields differ between sources."""
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    lic = first_tag_value(tags, "license:")
    kept = items.filter(F.col("id").isNotNull() & (F.col("id") != "") & ~F.coalesce(F.col("disabled"), F.lit(False)))
    return kept.select(
        "seq", F.col("id"), F.lit("hub").alias("source"),
        F.when(F.array_contains(tags, "benchmark"), "benchmark").otherwise("dataset").alias("record_kind"),
        F.col("id").alias("title"), F.col("description").alias("summary"),
        lic.alias("license_name"),
        tag_values(tags, "language:").alias("languages"),
        F.concat(tag_values(tags, "task_categories:"),
                 F.when(F.array_contains(tags, "benchmark"), F.array(F.lit("benchmark")))
                 .otherwise(F.array().cast("array<string>"))).alias("task_types"),
        tag_values(tags, "modality:").alias("modalities"),
        tag_values(tags, "format:").alias("file_formats"),
        (F.coalesce(F.col("downloads"), F.lit(0)) > 0).alias("has_download"),
        (F.coalesce(F.col("description"), F.lit("")) != "").alias("has_samples"),
        license_risk(lic, F.col("gated"), "hub").alias("risk"),
        tags.alias("tags"),
        F.concat(F.lit(dims.HUB_PAGE), F.col("id")).alias("source_url"),
        F.concat(F.lit(dims.HUB_PAGE), F.col("id"), F.lit(dims.HUB_CARD)).alias("download_url"),
        F.to_variant_object(F.struct(
            "author", F.coalesce("likes", F.lit(0)).alias("likes"), F.coalesce("downloads", F.lit(0)).alias("downloads"),
            F.col("created_at").alias("createdAt"), F.col("last_modified").alias("lastModified"))).alias("metadata"),
        F.to_variant_object(F.struct(*[c for c in items.columns if c != "seq"])).alias("raw"),
        F.col("downloads").cast("long").alias("popularity"), _hub_text("id", tags).alias("search_text"), _hub_text("id", tags).alias("domain_text"),
    )


def _hub_text(name: str, tags: Column) -> Column:
    return F.concat_ws(" ", F.col(name), F.coalesce("description", F.lit("")), F.array_join(tags, " "))


def normalize_repo(repos: DataFrame) -> DataFrame:
    """Repository dump rows ``(seq, id, full_name, html_url, description, topics,
    language, private, visibility, spdx_id, stars)`` to candidate rows, as ``normalize_hub``."""
    topics = F.transform(F.coalesce(F.col("topics"), F.array().cast("array<string>")), lambda t: F.lower(t))
    text = F.concat_ws(" ", F.col("full_name"), F.coalesce(F.col("description"), F.lit("")), F.array_join(topics, " "))
    lic = F.when(F.trim(F.coalesce(F.col("spdx_id"), F.lit(""))) != "", F.trim(F.col("spdx_id")))
    return repos.select(
        "seq", F.col("id").cast("string").alias("id"), F.lit("repo").alias("source"),
        repo_record_kind(text).alias("record_kind"),
        F.col("full_name").alias("title"), F.col("description").alias("summary"),
        lic.alias("license_name"),
        F.when(F.col("language").isNotNull(), F.array(F.lower("language"))).otherwise(F.array().cast("array<string>"))
        .alias("languages"),
        task_tags(text).alias("task_types"),
        modality_tags(text).alias("modalities"),
        F.array().cast("array<string>").alias("file_formats"),
        F.lit(True).alias("has_download"),
        (F.coalesce(F.col("description"), F.lit("")) != "").alias("has_samples"),
        license_risk(lic, F.col("private"), "repo").alias("risk"),
        topics.alias("tags"),
        F.col("html_url").alias("source_url"), F.concat(F.col("html_url"), F.lit(dims.REPO_ARCHIVE)).alias("download_url"),
        F.to_variant_object(F.struct(topics.alias("topics"), F.coalesce("stars", F.lit(0)).alias("stars"), "visibility")).alias("metadata"),
        F.to_variant_object(F.struct(*[c for c in repos.columns if c != "seq"])).alias("raw"),
        F.col("stars").cast("long").alias("popularity"), text.alias("search_text"), text.alias("domain_text"),
    )


def dedupe_by_key(cands: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Last value wins, first position kept (``Map.set`` semantics)."""
    payload = [c for c in cands.columns if c not in keys and c != seq]
    return cands.groupBy(*keys).agg(F.min(seq).alias("position"),
                                    F.max_by(F.struct(F.col(seq).alias("last_seq"), *payload), F.col(seq)).alias("_v")
                                    ).select(*keys, "position", "_v.*")


def source_quota(cands: DataFrame, limit: int, n_sources: int, seq: str = "seq") -> DataFrame:
    """First ``quota`` candidates per source, quota = ceil(limit/2) (at
    least 1) when several sources were asked for, else ``limit``."""
    quota = max(1, -(-limit // 2)) if n_sources > 1 else limit
    w = Window.partitionBy("source").orderBy(seq)
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= quota)


def query_variants(query: Column) -> Column:
    """[full, minus stop words, first two tokens]: whitespace collapsed,
    trimmed, empty dropped, distinct in order."""
    norm = F.regexp_replace(F.regexp_replace(query, r"\s+", " "), r"^ | $", "")
    toks = F.filter(F.split(norm, " "), lambda t: t != "")
    stop = F.array(*[F.lit(w) for w in dims.QUERY_STOPWORDS])
    stripped = F.array_join(F.filter(toks, lambda t: ~F.array_contains(stop, F.lower(t))), " ")
    first2 = F.array_join(F.slice(toks, 1, 2), " ")
    return F.array_distinct(F.filter(F.array(norm, stripped, first2), lambda v: F.trim(v) != ""))


def fallback_search(variants: DataFrame, docs: DataFrame, limit: int) -> DataFrame:
    """Cascading search over a landed catalog.

    ``variants``: ``(qid, k, variant)`` with ``k`` = 1, 2, ... in order;
    ``docs``: ``(doc_id, text)``. A variant matches a document when every
    token of the variant is a token of the document; each variant returns
    its first ``limit`` matches by ``doc_id``. Variant ``k`` only runs while
    the distinct hits of variants before it are fewer than ``limit``; hits
    keep their first position and the result is cut to ``limit``. See
    ``operators.search`` for the index that is probed."""
    from . import search
    scope = F.lit(0).alias("scope")
    index = search.build_index(docs.select(scope, F.col("doc_id").alias("doc"), F.col("doc_id").alias("place"), "text"))
    found = search.cascade(variants.select("qid", scope, "k", "variant"), index, limit)
    return found.select("qid", F.col("doc").alias("doc_id"), F.col("k").alias("first_k"), "rank")


def candidate_domains(cands: DataFrame, taxonomy=dims.STOCK_TAXONOMY) -> DataFrame:
    """Industry slugs for candidates ``(pack, cand_industry_text)``: the top
    three matches of the candidate text, without the fallback slug unless it
    is the only one. Returns ``(pack, domains array<string>)``."""
    from . import industry as ind
    m = ind.keyword_matches(None, taxonomy, candidates=cands)
    top = ind.industry_top(ind.industry_scores(m, taxonomy), cands.select("pack"), taxonomy)
    lists = top.groupBy("pack").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "slug"))),
                                                lambda x: x["slug"]).alias("slugs"))
    specific = F.filter("slugs", lambda s: s != dims.INDUSTRY_FALLBACK_SLUG)
    return lists.select("pack", F.when(F.size(specific) > 0, specific).otherwise(F.col("slugs")).alias("domains"))
