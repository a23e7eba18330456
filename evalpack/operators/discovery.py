"""Discovery: queries against the landed catalogs of all sources, profiled, planned and ranked.

A candidate is one row (source, id, position, popularity, license, tags, texts for
search and domains, and the whole candidate as one VARIANT), whatever its source's own
fields are: those lie in ``rawPayload`` and ``metadata``. All sources go through the
same profile over the candidate's whole JSON.

For each query and source the variants of the query search the source's candidates,
most popular first (``search.cascade``); the candidates found are profiled once each,
scored against the taxonomy once for each query that found them, as the query's own
words count, planned, and cut to the best ``limit`` of each query by a ranked window,
which keeps at most ``limit`` rows a query in each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from . import catalog as ct
from . import industry as ind
from . import plan as pl
from . import profile as pf
from . import search

FIELDS = [("id", "id"), ("source", "source"), ("recordKind", "record_kind"), ("title", "title"), ("summary", "summary"),
          ("sourceUrl", "source_url"), ("downloadUrl", "download_url"), ("licenseName", "license_name"),
          ("languages", "languages"), ("taskTypes", "task_types"), ("modalities", "modalities"), ("domains", "domains"),
          ("fileFormats", "file_formats"), ("hasDownload", "has_download"), ("hasSamples", "has_samples"),
          ("commercialRisk", "risk"), ("redistributionRisk", "risk"), ("rawPayload", "raw"), ("metadata", "metadata")]


def candidates(sources: list[DataFrame]) -> DataFrame:
    """Normalised rows of all sources (``ct.normalize_hub``, ``ct.normalize_repo``) in one table, keyed by source and
    id: the last row of a key wins and keeps the first position; source_order is that of the list."""
    return with_texts(_candidates(sources))


def _candidates(sources: list[DataFrame]) -> DataFrame:
    rows = None
    for i, more in enumerate(sources):
        more = more.withColumn("source_order", F.lit(i))
        rows = more if rows is None else rows.unionByName(more)
    return ct.dedupe_by_key(texts_once(rows), ["source", "id"]).drop("last_seq")


TEXTS = ("search_text", "domain_text")


def texts_once(rows: DataFrame) -> DataFrame:
    """``rows`` with each text held once: a summary that is the raw item's description is left to that, and the texts
    for search and domains are cut into what stands before and behind the summary they hold. ``with_texts`` undoes it."""
    said = F.col("summary") == F.try_variant_get("raw", "$.description", "string")
    rows = rows.withColumn("said", F.coalesce(said, F.lit(False)))
    for c in TEXTS:
        at = F.when(F.length("summary") > 0, F.position("summary", c))
        around = F.struct(F.substr(c, F.lit(1), at - 1).alias("before"), F.substr(c, at + F.length("summary")).alias("behind"))
        rows = rows.withColumn(f"{c}_around", F.when(at > 0, around))
        rows = rows.withColumn(c, F.when(F.col(f"{c}_around").isNull(), F.col(c)))
    return rows.withColumn("summary", F.when(~F.col("said"), F.col("summary")))


def with_texts(rows: DataFrame) -> DataFrame:
    """The texts of ``texts_once`` as they were."""
    rows = rows.withColumn("summary", F.when(F.col("said"), F.try_variant_get("raw", "$.description", "string")).otherwise(F.col("summary")))
    for c in TEXTS:
        around = F.col(f"{c}_around")
        rows = rows.withColumn(c, F.when(around.isNotNull(), F.concat(around["before"], "summary", around["behind"])).otherwise(F.col(c)))
    return rows.drop("said", *[f"{c}_around" for c in TEXTS])


def whole(rows: DataFrame) -> DataFrame:
    """``rows`` with ``candidate``, the whole candidate as one VARIANT; needs ``domains``."""
    return rows.withColumn("candidate", F.to_variant_object(F.struct(*[F.col(c).alias(n) for n, c in FIELDS])))


def industry_text(query: Column | None = None) -> Column:
    """The texts that name an industry: query, title, summary, URL, domains, tasks, modalities, metadata."""
    words = [F.col("title"), F.col("summary"), F.col("source_url"),
             *[F.array_join(c, " ") for c in ("domains", "task_types", "modalities")], F.to_json("metadata")]
    return F.concat_ws(" ", *([] if query is None else [query]), *[F.nullif(w, F.lit("")) for w in words])


def matched_words(matches: DataFrame, taxonomy) -> DataFrame:
    """(pack, slug, words): distinct matched keywords, then workflows, in the taxonomy's order; a list is at most as
    long as the taxonomy's."""
    firsts = matches.groupBy("pack", "slug", "keyword").agg(F.min("kw_id").alias("kw_id"))
    return firsts.groupBy("pack", "slug").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("kw_id", "keyword"))), lambda x: x["keyword"]).alias("words"))


def _profiled(found: DataFrame) -> DataFrame:
    """The profile of each candidate, by ``pack`` (source:id)."""
    text = F.lower(F.to_json("candidate"))
    return pf.profile(candidates=found.select("pack", text.alias("cand_text"), F.col("license_name").alias("cand_license"),
                                              F.col("task_types").alias("cand_task_tags")))


def _segmented(pairs: DataFrame, taxonomy) -> DataFrame:
    """Industry profile of each (query, candidate) pair: primary industry, and its matches with words and workflows."""
    text = pairs.select("pack", industry_text(F.col("query")).alias("cand_industry_text"))
    matches = search.stored(ind.keyword_matches(None, taxonomy, candidates=text), "discovery-matches")
    explicit = pairs.select("pack", F.explode("domains").alias("slug"))
    top = ind.industry_top(ind.industry_scores(matches, taxonomy, explicit=explicit), pairs.select("pack"), taxonomy)
    hints = ind.taxonomy_dim(pairs.sparkSession, taxonomy).select("slug", "workflows")
    full = top.join(matched_words(matches, taxonomy), ["pack", "slug"], "left").join(hints, "slug", "left")
    full = full.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "slug", "label", F.col("confidence").alias("confidence"),
        F.coalesce("words", F.array().cast("array<string>")).alias("matched_keywords"),
        F.col("workflows").alias("workflow_hints")))).alias("industry_matches"))
    return ind.industry_profile(top, taxonomy).drop("matches").join(full, "pack")


def plan_struct() -> Column:
    return F.struct("current_tier", "target_tier", F.col("lift").alias("estimated_readiness_lift"),
                    F.col("primary_industry").alias("industry"),
                    F.coalesce("workflow_focus", F.array().cast("array<string>")).alias("workflow_focus"),
                    F.transform("steps", lambda s: F.struct(*[s[n].alias(n) for n in (
                        "step_id", "title", "priority", "automatable", "inputs", "outputs")])).alias("steps"),
                    "packaging_risks").alias("plan")


def discover(queries: DataFrame, sources: list[DataFrame], limit: int, taxonomy=dims.STOCK_TAXONOMY) -> DataFrame:
    """The best ``limit`` candidates of each query (qid, query), by readiness, completeness and the order found.

    ``sources``: normalised rows, a table a source; with several each source gives up to half of ``limit`` (rounded
    up, at least one). Returns qid, rank, source, id, candidate (VARIANT), completeness, readiness_level,
    primary_industry, is_industry_specific, industry_matches, plan, and the profile's task_type and missing signals."""
    per_source = max(1, -(-limit // 2)) if len(sources) > 1 else limit
    scratch = search.Scratch(queries.sparkSession)
    # numbered in the order in which they are found: a posting holds the number, no id and no popularity
    ordered = _candidates(sources).orderBy(-F.coalesce("popularity", F.lit(0)), "position")
    known = with_texts(scratch.stored(ordered.withColumn("place", F.monotonically_increasing_id()), "discovery-candidates"))
    known = known.withColumn("doc", F.when(F.col("id").isNotNull(), F.col("place")))  # one without an id is never met
    built = search.Scratch(queries.sparkSession)
    index = search.build_index(known.select(F.col("source_order").alias("scope"), "doc", "place", F.col("search_text").alias("text")), built.stored)
    variants = queries.select("qid", F.posexplode(ct.query_variants(F.col("query"))).alias("pos", "variant"))
    variants = variants.withColumn("scope", F.explode(F.array(*map(F.lit, range(len(sources))))))
    hits = search.cascade(variants.select("qid", "scope", (F.col("pos") + 1).alias("k"), "variant"), index, per_source)
    hits = search.stored(hits.select("qid", "doc", F.col("rank").alias("found_rank")), "discovery-hits")
    built.drop()
    met = known.join(hits.select("doc").distinct(), "doc").withColumn("pack", F.concat_ws(":", "source", "id"))
    met = scratch.stored(met, "discovery-found")
    domains = ct.candidate_domains(met.select("pack", F.col("domain_text").alias("cand_industry_text")), taxonomy)
    met = search.stored(whole(met.join(domains, "pack")), "discovery-met")
    scratch.drop()
    prof = _profiled(met)
    pairs = hits.join(met, "doc").join(queries.select("qid", "query"), "qid").withColumnRenamed("pack", "candidate_pack")
    pairs = search.stored(pairs.withColumn("pack", F.concat_ws("\x1f", F.col("qid").cast("string"), "candidate_pack")), "discovery-pairs")
    planned = pl.plan(pairs.select("pack", "candidate_pack").join(prof.withColumnRenamed("pack", "candidate_pack"), "candidate_pack")
                      .join(_segmented(pairs, taxonomy), "pack"))
    best = Window.partitionBy("qid").orderBy(F.desc("readiness_level"), F.desc("completeness"), "source_order", "found_rank")
    rows = pairs.select("pack", "qid", "source", "id", "candidate", "domains", "source_order", "found_rank").join(
        planned.select("pack", "completeness", "readiness_level", "task_type", "missing", "primary_industry",
                       "is_industry_specific", "industry_matches", plan_struct()), "pack")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).drop("pack", "source_order", "found_rank")
