"""Near-duplicate groups by an inverted join over MinHash signature coordinates.

Each distinct shingle set has one signature of ``COORDS`` minima. It is posted
under each (coordinate, value) pair. Two sets that agree on at least
``MATCHES`` coordinates share one of the ``COORDS - MATCHES + 1`` rarest pairs
of either, so only that prefix is joined; pairs that occur once fill the
prefix first and are skipped, as are the frequent ones behind it. The agreeing
coordinates of a candidate are counted on the whole signatures, and every
remaining pair is confirmed on the full shingle sets.

Groups of copies do not become all pairs: equal sets are one class, and a
posting is first compared with one pivot. The confirmed links are merged; what
a posting holds outside its main component (strays) is then compared with the
rest of the postings' nodes by the rarest shingles of the sets themselves,
which rules out nearly all pairs that cannot be similar. A pair above the match
threshold in a posting is thus connected already, compared, or shown to be too
different.

A pair of similarity 0.75 agrees on a binomial number of coordinates, so it has
fewer than ``MATCHES`` = 22 of 48 with a probability below 1e-5.

Defined results: null or blank texts have no shingles, link with nothing and
are kept; one to four words are one shingle; repeated rows and rows that share
a doc_id are separate texts; a null doc_id is never the smallest (a component
with null ids alone has a null component_id and its rows are kept); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import textvec as tv
from .common import by_batch, columns, read, stored
from .components import components

WORDS, PERCENT, COORDS, MATCHES = 5, 75, 48, 22
_STEP = 8192


def shingles(col: pa.Array, n: int):
    """Yields (row, sorted distinct shingle hashes) of each text."""
    for lo, hi, h, ptr in tv.words(col, lower=True):
        runs = tv.chain(h, n)
        for i in range(hi - lo):
            a, b = ptr[i], ptr[i + 1]
            yield lo + i, np.unique(runs[a : b - n + 1] if b - a >= n else tv.chain(h[a:b], b - a) if b > a else runs[:0])


def signatures(docs: DataFrame, words: int = WORDS, coords: int = COORDS) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), sig array<int> of minima."""
    seeds = tv.mix(np.arange(1, 2 * coords + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    mul, add = (seeds[:coords] | np.uint64(1))[:, None], seeds[coords:][:, None]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digest, sig = [], [], []
        for _, s in shingles(batch.column(1), words):
            n.append(len(s))
            digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            low = np.full(coords, ~np.uint64(0))
            for k in range(0, len(s), _STEP):
                low = np.minimum(low, (mul * s[None, k : k + _STEP] + add).min(axis=1))
            sig.append((low >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(s) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int32()))],
            ["doc_id", "n_shingles", "digest", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(columns(docs, "doc_id", "text"), work,
                    f"doc_id {kind}, n_shingles long, digest binary, sig array<int>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """digest, shingle set of each text."""
    def work(batch: pa.RecordBatch):
        for k in range(0, batch.num_rows, 500):
            digest, sets = [], []
            for _, s in shingles(batch.column(0).slice(k, 500), words):
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["digest", "shingles"])

    return by_batch(docs.select("text"), work, "digest binary, shingles array<long>").dropDuplicates(["digest"])


def _rarest(posted: DataFrame) -> DataFrame:
    """(key, node, n, at) of the (key, node, n) postings that several nodes have, where ``at``
    is the key's place among the node's ``n`` keys, rarest first. Keys of one node alone come
    first, so they only move the others back and are never joined or sorted."""
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("times", "key"))
    size = F.count(F.lit(1)).over(Window.partitionBy("node"))
    return posted.join(shared, "key").select("key", "node", "n", (F.col("n") - size + rank - 1).alias("at"))


def _prefixes(classes: DataFrame, coords: int, matches: int) -> DataFrame:
    """(key, node): the postings among a signature's rarest pairs that others share."""
    posted = classes.select(F.col("digest").alias("node"), F.posexplode("sig").alias("at", "value")).select(
        (F.col("at").cast("long") * (1 << 32) + F.col("value").cast("long")).alias("key"), "node", F.lit(coords).alias("n"))
    return _rarest(posted).where(F.col("at") <= coords - matches).select("key", "node")


def _strays(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a stray and a node of another component that can still be similar.

    Strays are compared by their rarest shingles: of two similar sets the larger
    has a common shingle among its rarest n - 0.75 n + 1, the smaller one among
    its rarest n - 1.5 / 1.75 n + 1, and behind the first common one enough
    must be left on both sides for the overlap that the percentage needs.
    """
    nodes = mixed.groupBy("node").agg(F.first("label").alias("label"), F.max(F.col("label") != F.col("main")).alias("stray"))
    posted = sets.join(nodes, F.col("digest") == F.col("node"), "left_semi").select(
        F.col("digest").alias("node"), F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    rare = _rarest(posted).where(F.col("n") * percent <= (F.col("n") - F.col("at")) * 100)
    rare = stored(rare.join(nodes, "node"), "rare")
    small = rare.where((F.col("n") - F.col("at")) * (100 + percent) >= F.col("n") * 2 * percent)

    def side(part: DataFrame, x: str) -> DataFrame:
        return part.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "at", "label")))

    fits = (F.expr("label_x <> label_y AND (n_y < n_x OR n_y = n_x AND node_y < node_x)")
            & (F.col("n_y") * 100 >= F.col("n_x") * percent)
            & (F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) * (100 + percent)
               >= (F.col("n_x") + F.col("n_y")) * percent))
    found = [side(x, "x").join(side(y, "y"), "key").where(fits).select("node_x", "node_y")
             for x, y in ((rare.where("stray"), small), (rare.where("NOT stray"), small.where("stray")))]
    return found[0].union(found[1]).select(
        F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs (a, b) that agree on enough coordinates and whose full sets are similar enough."""
    def side(x: str) -> DataFrame:
        return classes.select(F.col("digest").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))

    met = (pairs.join(side("a"), "a").join(side("b"), "b")
           .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
           .where(F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x)) >= matches)
           .select("a", "b", "n_a", "n_b"))
    both = (met.join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("set_b")), "b")
            .join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("set_a")), "a"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (both.withColumn("common", common)
            .where(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent).select("a", "b"))


def _mixed(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, label, main of the postings that hold more than one component; main: the largest there."""
    tagged = posts.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    parts = tagged.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = (parts.groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count(F.lit(1)).alias("parts"))
            .where("parts > 1").select("key", "main"))
    return stored(tagged.join(main, "key"), "mixed")


def _unseen(pairs: DataFrame, done: list[DataFrame]) -> DataFrame:
    """The distinct pairs (a, b) that were not compared before."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for one in done:
        pairs = pairs.join(one.select("a", "b"), ["a", "b"], "left_anti")
    return stored(pairs, "pairs")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, coords: int = COORDS,
                    matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text)."""
    docs = columns(docs, "doc_id", "text")
    rows = stored(signatures(docs, words, coords), "signatures")
    classes = stored(rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    posts = stored(_prefixes(classes, coords, matches), "postings")
    ids = classes.join(posts.select(F.col("node").alias("digest")).distinct(), "digest", "left_semi").select(
        F.col("doc_id").alias("id"))
    wanted = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = stored(_sets(wanted, words), "sets")

    pivot = posts.groupBy("key").agg(F.min("node").alias("a"))
    stars = _unseen(posts.join(pivot, "key").where("node <> a").select("a", F.col("node").alias("b")), [])
    links = _confirmed(stars, classes, sets, matches, percent)
    merged, done = components(links), [stars]

    # Once more with other pivots: a member of the main component, a different one for each posting.
    mixed = _mixed(posts, merged)
    pivot = mixed.where("label = main").groupBy("key").agg(
        F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node"))["node"].alias("a"))
    stars = _unseen(mixed.where("label <> main").join(pivot, "key").select("a", F.col("node").alias("b")), done)
    merged = _joined(merged, _confirmed(stars, classes, sets, matches, percent))

    rest = _unseen(_strays(_mixed(posts, merged), sets, percent), [*done, stars])
    merged = _joined(merged, _confirmed(rest, classes, sets, matches, percent))

    named = rows.join(merged, F.col("digest") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "digest").alias("part"))
    least = named.where("part IS NOT NULL").groupBy("part").agg(F.min("doc_id").alias("least"))
    component = F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return named.join(least, "part", "left").select("doc_id", "n_shingles", component.alias("component_id")).select(
        "*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))
