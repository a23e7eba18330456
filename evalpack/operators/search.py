"""Token search over an index of postings, and the cascade of query variants on it.

``build_index`` explodes the texts' tokens once into a table of postings (token, scope,
doc, place), partitioned by buckets of the token's hash, with the document frequency of
each token beside it; it can be kept and probed by any number of query batches. A probe
reads the buckets of its tokens only and never explodes a document:

* a variant's rarest token gives its candidates (a join on the token);
* the candidates are joined on (token, document) with the postings of the variant's
  other tokens, and those that have all of them stay. The key holds the document, so a
  token that a third of all documents share is not a hot key.

Equal variants of several queries are probed once. ``cascade`` probes variant by
variant; a variant runs only for the queries that earlier ones left short of ``limit``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_set
from ..sources.scratch import Scratch, stored

BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    """``postings`` (token, scope, doc, place, bucket), ``frequency`` (token, scope, df) and ``places`` (scope, doc, place)."""
    postings: DataFrame
    frequency: DataFrame
    places: DataFrame


def build_index(docs: DataFrame, save: Callable[..., DataFrame] = stored) -> Index:
    """Index of ``docs`` (scope, doc, place, text): a document is found in the order of ``place`` in its scope.
    ``save`` writes a table (as ``stored``); a posting is as wide as its ``doc`` and ``place``."""
    postings = save(docs.select(F.explode(token_set(F.col("text"))).alias("token"), "scope", "doc", "place")
                    .repartitionByRange(_bucket(), "token", "doc").withColumn("bucket", _bucket()), "search-postings", ("bucket",))
    frequency = save(postings.groupBy("token", "scope").agg(F.count("*").alias("df")), "search-frequency")
    return Index(postings, frequency, docs.select("scope", "doc", "place"))


def _first(hits: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The first ``limit`` of each key by place, numbered r."""
    order = Window.partitionBy(*keys).orderBy("place")
    return hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit)


def probe(variants: DataFrame, index: Index, limit: int, scratch: Scratch | None = None) -> DataFrame:
    """The first ``limit`` documents by place that hold all tokens of each variant: scope, variant key, doc, r.

    ``variants``: (scope, tokens array, key) without repeats. One without tokens is held by all documents.

    Only postings that can count are dealt: those of the variants' tokens and, beside the rarest ones, of documents
    that hold a rarest token. Tables that are as small as the variants are stored (in
    ``scratch``, to be dropped when the result is read), so that Spark knows their size."""
    scratch = scratch or Scratch(index.postings.sparkSession)
    words = scratch.stored(variants.where(F.size("tokens") > 0).select(
        "scope", "key", F.size("tokens").alias("n"), F.explode("tokens").alias("token")), "search-words")
    asked = scratch.stored(words.select("scope", "token").distinct(), "search-tokens")
    known = words.join(index.frequency.join(asked, ["scope", "token"], "left_semi"), ["scope", "token"])
    rarest = known.groupBy("scope", "key", "n").agg(
        F.count("*").alias("found"), F.min(F.struct("df", "token")).alias("rare")).where("found = n")
    rarest = scratch.stored(rarest.select("scope", "key", "n", F.col("rare.token").alias("token")), "search-rarest")
    buckets = [r[0] for r in words.select(_bucket().alias("b")).distinct().collect()]  # at most BUCKETS numbers
    postings = index.postings.where(F.col("bucket").isin(buckets)) if buckets else index.postings.limit(0)
    candidates = scratch.stored(postings.select("scope", "token", "doc", "place").join(rarest, ["scope", "token"]), "search-candidates")
    others = candidates.where("n > 1").withColumnRenamed("token", "rare")
    near = scratch.stored(others.select("scope", "doc").distinct(), "search-near")
    others = others.join(words.select("scope", "key", "token"), ["scope", "key"]).where("token != rare")
    postings = postings.select("scope", "token", "doc").join(asked, ["scope", "token"], "left_semi").join(near, ["scope", "doc"], "left_semi")
    held = others.join(postings, ["scope", "token", "doc"]).groupBy(
        "scope", "key", "doc", "n").agg(F.count("*").alias("found"), F.any_value("place").alias("place")).where("found = n - 1")
    hits = candidates.where("n = 1").select("scope", "key", "doc", "place").union(held.select("scope", "key", "doc", "place"))
    heads = _first(index.places, ["scope"], limit).drop("r")
    every = variants.where(F.size("tokens") == 0).select("scope", "key").join(heads, "scope").select("scope", "key", "doc", "place")
    return _first(hits.union(every), ["scope", "key"], limit).select("scope", "key", "doc", "r")


def cascade(variants: DataFrame, index: Index, limit: int) -> DataFrame:
    """``variants``: (qid, scope, k, variant), k = 1, 2, ... in order. Each variant returns its first ``limit``
    documents; it runs only while the documents of those before it are fewer than ``limit``. Documents keep the
    first place they were found at; the first ``limit`` stay: qid, scope, doc, k, rank."""
    asked = variants.withColumn("tokens", F.array_sort(token_set(F.col("variant")))).withColumn("key", F.array_join("tokens", " "))
    asked = stored(asked.select("qid", "scope", "k", "tokens", "key"), "search-asked")
    scratch, found = Scratch(asked.sparkSession), None
    for k in range(1, (asked.agg(F.max("k")).first()[0] or 0) + 1):
        now = asked.where(F.col("k") == k)
        if found is not None:
            done = found.groupBy("qid", "scope").count().where(F.col("count") >= limit)
            now = now.join(done, ["qid", "scope"], "left_anti")
        hits = probe(now.select("scope", "tokens", "key").distinct(), index, limit, scratch)
        new = now.select("qid", "scope", "k", "key").join(hits, ["scope", "key"]).select("qid", "scope", "doc", "k", "r")
        if found is not None:
            new = found.union(new.join(found, ["qid", "scope", "doc"], "left_anti"))
        found = stored(new, "search-found")
        scratch.drop()
    if found is None:
        return asked.join(index.places, "scope").limit(0).select("qid", "scope", "doc", "k", F.lit(0).alias("rank"))
    order = Window.partitionBy("qid", "scope").orderBy("k", "r")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("r")
