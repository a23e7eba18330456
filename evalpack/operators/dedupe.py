"""Near-duplicate removal: similarity pairs and greedy keep-first selection.

Semantics: a row is kept unless it is at least ``t`` similar to an *earlier
kept* row (not transitive closure: with a~b, b~c, a!~c both a and c stay).

Distributed plan
----------------
1. **Exact copies first.** Rows whose token set (or vector) is identical are
   grouped on a SHA-256 of the sorted set (vectors: on the vector itself)
   with a map-side combined ``groupBy``; the
   earliest row of each group is its representative. Every later copy is
   dropped whatever happens (it is similar 1.0 to the representative, and
   similar to anything the representative is similar to), so a group of
   copies holding a third of all rows never produces k^2 pairs.
2. **Candidate pairs among representatives** (Jaccard): tokens are ordered
   globally, rare ones first, by a frequency table of fixed size; a pair with
   Jaccard >= t must share a token in the first tokens of both sets (prefix
   filter, with the places where they meet as a bound). The equi-join on prefix
   tokens only sees rare tokens; 512-bit sketches rule out most other pairs, and
   the rest are verified on the whole sets, in rounds; where only the first of
   near copies is asked for, crowds are thinned before. (Cosine): every pair is
   tested, tile by tile, as matrix products (``cosine_candidates``).
3. **Keep-first fixed point** over the verified pair graph: rows with no
   earlier live neighbour are kept; neighbours of a newly kept row are dropped;
   repeat with the pairs that are left. Each round is written to the shared
   folder, so plans stay short and a lost executor repeats one round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_set
from ..sources.scratch import Scratch, settings, shared_folder, stored, written


def exact_groups(rows: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``(id, rep)`` for every row: ``rep`` is the smallest id with the same
    key. The group minimum is a map-side combined aggregate."""
    keyed = rows.select(F.col(id_col).alias("id"), key.alias("_k"))
    reps = keyed.groupBy("_k").agg(F.min("id").alias("rep"))
    return keyed.join(reps, "_k").select("id", "rep")


def token_table(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``(id, tokens array<string>, n, key)`` with distinct sorted tokens;
    ``key`` is the SHA-256 of the sorted tokens joined by a blank (tokens
    have no blanks, so the key identifies the set)."""
    toks = F.sort_array(token_set(text))  # no comparator that is called for each two tokens
    return (rows.select(F.col(id_col).alias("id"), toks.alias("tokens"))
            .withColumn("n", F.size("tokens"))
            .withColumn("key", F.sha2(F.array_join("tokens", " "), 256)))


BUCKETS, SKETCH = 1 << 20, 512  # of token frequencies; bits of a set's sketch at least


def _frequencies(sets: DataFrame):
    """How often tokens fall into each of ``BUCKETS`` buckets (a table of fixed size), as a broadcast."""
    seen = sets.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(BUCKETS - 1).alias("bucket")).count().toArrow()
    times = np.zeros(BUCKETS, dtype=np.int64)
    times[seen["bucket"].to_numpy()] = seen["count"].to_numpy()
    return sets.sparkSession.sparkContext.broadcast(times)


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``(id, key, n, prefix, sketch)`` of each set that has tokens: its first tokens in one order for all sets (rare buckets first),
    as many as a similar set may lack and one more; and per bit the parity of the tokens that fall on it, of as many
    bits as the next power of two has."""
    sets = sets.where(F.size("tokens") > 0)
    frequencies = _frequencies(sets)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = frequencies.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                tokens = part.column(2).flatten().to_numpy()
                n = np.diff(part.column(2).offsets.to_numpy())
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((tokens, times[tokens & (BUCKETS - 1)], row))
                at = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
                first = at <= (n - threshold * n + SLACK)[row]
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(n)))]).astype(np.int32)
                size = np.maximum(SKETCH, 1 << np.ceil(np.log2(n)).astype(np.int64))
                start = np.concatenate([[0], np.cumsum(size)])
                odd = np.bincount(start[row] + ((tokens >> 32) & (size[row] - 1)), minlength=start[-1]) & 1
                sketch = pa.ListArray.from_arrays((start // 64).astype(np.int32), np.packbits(odd.astype(np.uint8)).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(
                    ends, tokens[order][first]), sketch], ["id", "key", "n", "prefix", "sketch"])

    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "key", "tokens").mapInArrow(work, f"id {kind}, key string, n int, prefix array<long>, sketch array<long>")


SLACK = 1e-6  # float error can only lengthen a prefix


def _met(prefixes: DataFrame, threshold: float, one: DataFrame | None = None) -> DataFrame:
    """``(a, b, home)`` of the sets that may reach ``threshold``; ``home`` is one of the tokens where both meet. With
    ``one``, some of the prefixes, at least one set of a pair is of these.

    If the first common token stands at place i of x and j of y, not more than ``min(|x| - i, |y| - j)`` tokens are common;
    the smaller set (y) is therefore only entered under a shorter prefix."""
    def side(x: str, of: DataFrame) -> DataFrame:
        return of.select(F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.posexplode("prefix").alias(f"at_{x}", "token"))

    t, n_x, n_y = F.lit(threshold), F.col("n_x"), F.col("n_y")
    short = (n_y - F.col("at_y")) * (1 + t) >= 2 * t * n_y - SLACK
    fits = (((n_y < n_x) | (n_y == n_x) & (F.col("id_y") < F.col("id_x"))) & (n_y >= t * n_x - SLACK)
            & (F.least(n_x - F.col("at_x"), n_y - F.col("at_y")) * (1 + t) >= t * (n_x + n_y) - SLACK))
    sides = [(prefixes, prefixes)] if one is None else [(prefixes, one), (one, prefixes)]
    met = [side("x", x).join(side("y", y).where(short), "token").where(fits).where("id_x != id_y") for x, y in sides]
    met = met[0] if one is None else met[0].unionByName(met[1])
    return met.groupBy(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).agg(F.min("token").alias("home"))


def _sketched(met: DataFrame, prefixes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sketches allow ``threshold``: each bit in which two sketches differ stands for at least one
    token that only one of the sets has. The longer sketch is folded onto the other's size (they are at most one
    power of two apart)."""
    def folded(one: str, other: str) -> Column:
        half = F.size(one) / 2
        halves = F.zip_with(F.slice(one, 1, half.cast("int")), F.slice(one, half.cast("int") + 1, half.cast("int")), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(one) > F.size(other), halves).otherwise(F.col(one))

    for x in "ab":
        met = met.join(prefixes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")), x)
    unlike = F.aggregate(F.zip_with(folded("sketch_a", "sketch_b"), folded("sketch_b", "sketch_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most = (F.col("n_a") + F.col("n_b")) * ((1 - threshold) / (1 + threshold))
    return met.where(unlike <= most + SLACK).select("a", "b", "home").distinct()


def _needed(pairs: DataFrame) -> DataFrame:
    """``(home, id)``: the sets that the pairs' homes compare. Near copies meet at few tokens, so a set goes to a few
    homes, not to one for each of its pairs."""
    return pairs.select("home", F.col("a").alias("id")).union(pairs.select("home", F.col("b").alias("id"))).distinct()


def _verified(pairs: DataFrame, needed: DataFrame, toks: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, home) with their similarity, if it reaches ``threshold``, compared on the whole sets."""
    sets = needed.join(toks, ["id", "key"]).repartition("home")
    out = pairs.repartition("home")
    for x in "ab":
        side = sets.select("home", F.col("id").alias(x), F.col("tokens").alias(f"t{x}"))
        out = out.join(side.hint("shuffle_hash"), ["home", x])
    out = out.withColumn("inter", F.size(F.array_intersect("ta", "tb")))
    out = out.withColumn("jaccard", F.col("inter") / (F.size("ta") + F.size("tb") - F.col("inter")))
    return out.where(F.col("jaccard") >= threshold).select("a", "b", "jaccard")


#: Joins on (home, id) take tables that are dealt by home alone as they are.
BY_HOME = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def _repeated(pairs: DataFrame, groups: DataFrame, power: int) -> DataFrame:
    """``pairs`` as often as ids that come several times ask for: ``times ** power`` for each end."""
    times = stored(groups.where("id = rep").groupBy("id").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "times")
    if not times.limit(1).count():
        return pairs
    names = pairs.columns
    for x in "ab":
        pairs = pairs.join(times.select(F.col("id").alias(x), F.col("times").alias(f"times_{x}")), x, "left")
    n = F.pow(F.coalesce("times_a", F.lit(1)) * F.coalesce("times_b", F.lit(1)), F.lit(power)).cast("int")
    return pairs.select(*names, F.explode(F.array_repeat(F.lit(0), n)).alias("_")).drop("_")


CROWD = 100  # sets that share a token of their prefixes, from which they are thinned
THINNED = 100  # a round of thinning that drops less than one set in so many is the last


def _compared(prefixes: DataFrame, toks: DataFrame, threshold: float, folder: str, one: DataFrame | None = None) -> DataFrame:
    """The pairs that reach ``threshold`` (with ``one``: that have one of these sets), written to ``folder``."""
    spark = toks.sparkSession
    scratch = Scratch(spark)
    met = scratch.stored(_sketched(_met(prefixes, threshold, one), prefixes, threshold), "met")
    needed = scratch.stored(_needed(met).join(prefixes.select("id", "key", "n"), "id"), "needed")
    # in rounds that send about as much as the sets hold; a round's shuffle files go when it ends
    sent, held = (df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (needed, prefixes))
    rounds = max(1, math.ceil(sent / max(1, held)))
    with settings(spark, BY_HOME):
        for k in range(rounds):
            mine = F.pmod("home", F.lit(rounds)) == k
            verified = _verified(met.where(mine), needed.where(mine).drop("n"), toks, threshold)
            written(verified, folder, mode="append")
    scratch.drop()
    return spark.read.schema(verified.schema).parquet(folder)


def _thinned(prefixes: DataFrame, toks: DataFrame, threshold: float, folder: str, scratch: Scratch) -> DataFrame:
    """``prefixes`` without sets that are certainly dropped; a pair of each with an earlier set that is certainly kept is
    written to ``folder``.

    In each round the first set of every token that a crowd shares is compared with all others. If no earlier set is
    similar to it, it is kept, and all later ones that are similar to it are dropped: as dropped sets decide nothing,
    their other pairs are not needed. So a group of near copies costs a row for each copy, not for each two."""
    spark, tried = toks.sparkSession, None
    while True:
        new = prefixes.where("id IS NOT NULL")
        posts = new.select("id", F.explode("prefix").alias("token"))
        fresh = new if tried is None else new.join(tried, "id", "left_anti")
        lead = posts.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("token").join(
            fresh.select("id", F.explode("prefix").alias("token")), "token").groupBy("token").agg(F.min("id").alias("id"))
        leaders = scratch.stored(lead.select("id").distinct(), "leaders")
        if not leaders.limit(1).count():
            return prefixes
        tried = leaders if tried is None else tried.unionByName(leaders)
        found = _compared(prefixes, toks, threshold, shared_folder(spark, "near"), prefixes.join(leaders, "id", "left_semi"))
        sure = leaders.join(found.select(F.col("b").alias("id")), "id", "left_anti")
        drop = scratch.stored(found.join(sure.withColumnRenamed("id", "a"), "a", "left_semi"), "drop")
        gone, all_ = drop.select(F.col("b").alias("id")).distinct(), prefixes.count()
        dropped = gone.count()
        if dropped:
            written(drop.select("a", "b", "jaccard"), folder, mode="append")
            left = scratch.stored(prefixes.join(gone, "id", "left_anti"), "thinned")
            scratch.drop(prefixes)
            prefixes = left
        if dropped * THINNED < all_:
            return prefixes


def jaccard_pairs(rows: DataFrame, id_col: str, text: Column, threshold: float, first_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Returns ``(pairs, groups)``.

    ``pairs``: ``(a, b, jaccard)`` with ``a < b`` and Jaccard >= threshold,
    between representatives, plus ``(rep, copy)`` rows with Jaccard 1.0 for
    exact copies. ``groups``: ``(id, rep)``. Tokens are compared by 64-bit hashes.

    With ``first_only`` the pairs are those that ``keep_first`` needs: of a row that an earlier kept row
    drops for certain, one pair may be all (see ``_thinned``)."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    # a condition on the key would make it, and so the tokens, once more
    toks = scratch.stored(token_table(rows.where(text.isNotNull()), id_col, text).select(
        "id", "key", F.transform("tokens", lambda x: F.xxhash64(x)).alias("tokens")), "tokens")
    groups = stored(exact_groups(toks.withColumnRenamed("id", id_col), id_col, F.col("key")), "groups")
    # one row of each set, that of the representative
    first = F.min(F.struct("id", "n", "prefix", "sketch")).alias("first")
    prefixes = scratch.stored(_prefixes(toks, threshold).groupBy("key").agg(first).select("key", "first.*"), "prefixes")
    folder = shared_folder(spark, "similar")
    # rows that share an id are decided together: only where each id is one row can a row be dropped for itself
    if first_only and not groups.where("id IS NOT NULL").groupBy("id").count().where("count > 1").limit(1).count():
        prefixes = _thinned(prefixes, toks, threshold, folder, scratch)
    verified = _compared(prefixes, toks, threshold, folder)
    scratch.drop()
    copies = groups.filter(F.col("id") != F.col("rep")).select(
        F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    return _repeated(verified, groups, 1).unionByName(copies), groups


def _unit(vec: Column) -> Column:
    """Unit vector (double) of a vector with a non-zero norm, else NULL."""
    v = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def dot(u: Column, v: Column) -> Column:
    """Dot product in double; 0 when lengths differ (cosine rule)."""
    prod = F.zip_with(u, v, lambda x, y: x * y)
    return F.when(F.size(u) == F.size(v), F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)).otherwise(F.lit(0.0))


BLOCK = 1 << 14  # vectors of one side of a tile


def cosine_candidates(reps: DataFrame, threshold: float, tasks: int | None = None) -> DataFrame:
    """(a, b, cosine) of the pairs of unit vectors (id, u) of one length that reach ``threshold`` but for rounding.

    Every pair is tested: the vectors are dealt into blocks, each two blocks (and each with itself) are a tile, and a
    tile's products are one matrix product, some rows at a time. Tiles are bounded in size, there are at least
    ``tasks`` of them, and a vector is sent to as many as there are blocks. The cosine of a pair that passes
    is summed again coordinate by coordinate, as ``dot`` does."""
    tasks = tasks or 2 * reps.sparkSession.sparkContext.defaultParallelism
    blocks = max(math.ceil(reps.count() / BLOCK), math.ceil(math.sqrt(2 * tasks)))
    kind = reps.schema["id"].dataType.simpleString()

    def tile(table: pa.Table) -> pa.Table:
        left, right = (table.filter(pc.equal(table["side"], x)) for x in (0, 1))
        same = right.num_rows == 0  # a block with itself
        right = left if same else right
        u, v = (np.concatenate([c.flatten().to_numpy() for c in t["u"].chunks] or [np.empty(0)]).reshape(t.num_rows, -1)
                if t.num_rows else np.empty((0, 0)) for t in (left, right))
        found = []
        step = max(1, (1 << 23) // max(1, len(v)))
        for lo in range(0, len(u) if len(v) else 0, step):
            near = ~(u[lo:lo + step] @ v.T < threshold - 1e-9)  # what is no number counts as near, as in SQL
            i, j = np.nonzero(near)
            i += lo
            if same:
                i, j = i[i < j], j[i < j]
            found.append((i, j))
        i, j = (np.concatenate([f[k] for f in found] or [np.empty(0, dtype=np.int64)]) for k in (0, 1))
        cosine = np.zeros(len(i))
        for k in range(u.shape[1] if len(i) else 0):
            cosine += u[i, k] * v[j, k]
        x, y = left["id"].take(pa.array(i)), right["id"].take(pa.array(j))
        return pa.table({"x": x, "y": y, "cosine": cosine})

    own = F.pmod(F.xxhash64("id"), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    dealt = reps.select("id", "u", F.size("u").alias("len"), own.alias("own"), every.alias("other"))
    tiles = dealt.select("id", "u", "len", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                         (F.col("own") > F.col("other")).cast("int").alias("side"))
    pairs = tiles.groupBy("len", "i", "j").applyInArrow(tile, f"x {kind}, y {kind}, cosine double")
    return pairs.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")


def cosine_pairs(rows: DataFrame, id_col: str, vec_col: str, threshold: float,
                 tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(pairs (a, b, cosine), groups (id, rep))`` with cosine >= threshold.
    Vectors of any length; those of unlike lengths and zero vectors are never
    similar."""
    units = rows.select(F.col(id_col).alias("id"), _unit(F.col(vec_col)).alias("u")).filter(
        F.col("u").isNotNull())
    grouped = stored(units.join(units.groupBy("u").agg(F.min("id").alias("rep")), "u").select("id", "rep", F.when(
        F.col("id") == F.col("rep"), F.col("u")).alias("u")), "units")
    groups = grouped.select("id", "rep")
    # rows whose vector is zero or missing stay alone
    groups = groups.unionByName(rows.select(F.col(id_col).alias("id")).join(units, "id", "left_anti")
                                .select("id", F.col("id").alias("rep")))
    reps = grouped.where("id = rep").select("id", "u")
    pairs = cosine_candidates(reps, threshold, tasks).filter(F.col("cosine") >= F.lit(threshold) - 1e-12)
    copies = groups.filter(F.col("id") != F.col("rep")).select(
        F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    return _repeated(pairs, groups, 3).unionByName(copies), groups


def keep_first(ids: DataFrame, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Greedy keep-first over the pair graph. ``ids``: ``(id)`` of all rows;
    ``pairs``: ``(a, b)`` with ``a < b``; ``groups``: ``(id, rep)``.
    Returns ``(id, kept boolean)`` for every row.

    A round keeps the rows that are no later end of a live pair and drops those
    they are paired with; the pairs that are left go into the next round. What
    a round drops and leaves is written to the shared folder, so no plan holds
    more than one round, and the last round's pairs are deleted."""
    spark = ids.sparkSession
    edges = stored(pairs.join(groups.filter(F.col("id") != F.col("rep")).select(F.col("id").alias("b")), "b",
                              "left_anti").select("a", "b").distinct(), "edges")
    scratch, folder, live, rounds = Scratch(spark), shared_folder(spark, "dropped"), edges, 0
    kind = edges.schema["b"].dataType.simpleString()
    while rounds == 0 or live.limit(1).count():  # the first row of the live pairs is decided in each round, so this ends
        rounds += 1
        first = live.join(live.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        written(first.select("b").distinct(), f"{folder}/round-{rounds}")
        drop = spark.read.schema(f"b {kind}").parquet(f"{folder}/round-{rounds}")
        left = scratch.stored(live.join(drop, "b", "left_anti").join(drop.withColumnRenamed("b", "a"), "a", "left_anti"), "live")
        if live is not edges:
            scratch.drop(live)
        live = left
    scratch.drop()
    dropped = spark.read.schema(f"b {kind}").parquet(f"{folder}/round-*").select(F.col("b").alias("id"), F.lit("D").alias("state"))
    nodes = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    status = nodes.join(dropped, "id", "left").select("id", F.coalesce("state", F.lit("K")).alias("state"))
    copies = groups.filter(F.col("id") != F.col("rep")).select("id", F.lit("D").alias("state"))
    decided = status.unionByName(copies)
    return (ids.select("id").join(decided, "id", "left")
            .select("id", (F.coalesce(F.col("state"), F.lit("K")) == "K").alias("kept")))


class VectorCountMismatch(ValueError):
    pass


def attach_vectors(cases: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Join cases to their vectors 1:1 on ``key``; raise when any case has
    no vector or any vector has no case (two small anti-join checks)."""
    missing = cases.select(key).join(vectors.select(key), key, "left_anti").limit(1).count()
    extra = vectors.select(key).join(cases.select(key), key, "left_anti").limit(1).count()
    if missing or extra:
        raise VectorCountMismatch(f"embedding/vector mismatch on {key}: cases without vector={bool(missing)}, "
                                  f"vectors without case={bool(extra)}")
    return cases.join(vectors, key)


def dedupe_counters(kept: DataFrame) -> DataFrame:
    """Rows before, after and removed by a dedupe (one aggregate)."""
    return kept.agg(F.count(F.lit(1)).alias("before"), F.count(F.when(F.col("kept"), 1)).alias("after")) \
        .withColumn("removed", F.col("before") - F.col("after"))
