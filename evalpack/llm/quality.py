"""Quality by the perplexity of an interpolated modified Kneser-Ney model.

The model is an n-gram model over white-space words, trained on a share of
``TRAIN`` of all documents labelled as good quality, chosen by a hash of their
id: it grows with the input. Counts and continuation counts are aggregations by the hashes of an n-gram's words, in ``SLICES``
rounds by the hash of the second word, which an n-gram of the highest order shares with its context and its suffix: n-grams are dealt
once by their context for their counts and its sums, and once by their suffix for the probability below, both keyed by Spark's
``xxhash64`` of the words. Because the suffix of a seen n-gram is seen, a log probability
is a sum over the n-grams and contexts of a text, and each n-gram of the model
has one value and, as a context, one back-off weight:

    log P(text) = words * log P(unknown) + sum of value(n-gram) + sum of weight(context)

Scoring is therefore a join of all documents' n-grams with the model's rows by
hash and a sum for each document, in ``ROUNDS`` rounds for the highest order (by its slices) and
as many for all others (by the hash), so that the shuffle files of one are gone when the next begins. The ``HEAD``
most frequent n-grams of a round and a bit table that excludes unseen ones (of at
most 2^``BITS`` bits, sized by the round's model) are applied while texts are read
(both bounded by a constant and broadcast), so no n-gram that a large share of
all documents holds is shuffled.

The threshold of a language is quantile-based, over the trusted documents that
the model has not seen: the upper quantile of their mean negative log
probability plus its distance to the median times ``SLACK``. All means are
drawn to the language's median by ``PRIOR_WORDS`` words, which matters for
short texts only.

Defined results: an empty or null text has the median and is kept; a language
without trusted documents (or a null one) has the threshold of all; without any
trusted document everything is kept with a null perplexity; rows that share a
doc_id are scored as one text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import Scratch, by_batch, columns, fuller_tasks, read, short_shuffles, stored

ORDER, TRAIN, HEAD, BITS = 3, 0.5, 1 << 19, 28
QUANTILE, SLACK, PRIOR_WORDS, SLICES, ROUNDS = 0.995, 0.25, 20, 4, 2
#: Parts in which the lower orders are put together: a multiple of ``ROUNDS``.
PARTS = 4
#: Bytes of text worked through at a time: scoring, and counting, which shuffles an n-gram once for each.
_CHUNK, _COUNTED = 1 << 19, 1 << 22


#: Fixed values of the 64-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _xxhash(h: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``xxhash64`` of one long each, as Spark computes it; of several columns, one's hash is the next one's seed."""
    x = (seed + (_P5 + np.uint64(8))) ^ (_turn(h * _P2, 31) * _P1)
    x = _turn(x, 27) * _P1 + _P4
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def _grams(h: np.ndarray, ptr: np.ndarray, k: int, of: np.ndarray | None = None):
    """(keys, row of each, whether it ends its text) of the n-grams of order ``k``; ``of``: only those whose second word it marks."""
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    left = ptr[1:][row] - np.arange(len(h))
    at = np.flatnonzero(left >= k)
    if of is not None:
        at = at[of[at + 1]]
    keys = np.full(len(at), 42, np.uint64)
    for i in range(k):
        keys = _xxhash(h[at + i], keys)
    return keys.view(np.int64), row[at], left[at] == k


def _slice_of(h: np.ndarray) -> np.ndarray:
    """The slice of the n-grams that have these second words."""
    return _xxhash(h, np.uint64(42)).view(np.int64) % SLICES


def _words(k: int, first: int = 1) -> list[str]:
    """Column names of ``k`` words of an n-gram, from word ``first`` on."""
    return [f"w{i}" for i in range(first, first + k)]


def _counted(docs: DataFrame, order: int, only: int | None = None) -> DataFrame:
    """Counts of the n-grams of the highest order (of one slice), a column of word hashes for each place, and of each one's
    context the sum of all counts and the n-grams seen once, twice and more often; ``lead`` marks one n-gram of a context.

    Words repeat where hashes of whole n-grams do not, so shuffles and tables compress."""
    names = _words(order)

    def work(batch: pa.RecordBatch):
        for _, _, h, ptr in tv.words(batch.column(0), lower=False, limit=_COUNTED):
            top = len(h) - order + 1
            if top <= 0:
                continue
            row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))[:top]
            inside = ptr[1:][row] - np.arange(top) >= order
            if only is not None:
                inside &= _slice_of(h[1 : top + 1]) == only
            start = np.flatnonzero(inside)
            _, first, n = np.unique(tv.chain(h, order)[start], return_index=True, return_counts=True)
            cols = [h[start[first] + i].view(np.int64) for i in range(order)]
            sort = np.lexsort(cols[::-1])
            yield pa.RecordBatch.from_arrays([pa.array(c[sort]) for c in [*cols, n]], [*names, "n"])

    rows = by_batch(docs.select("text"), work, ", ".join(f"{x} long" for x in [*names, "n"]))
    if order == 1:
        return rows.groupBy(*names).agg(F.sum("n").alias("n"))
    context, n = Window.partitionBy(*names[:-1]), F.col("n")
    counts = rows.repartition(*names[:-1]).groupBy(*names).agg(F.sum("n").alias("n"))
    sums = {"all": n, "ones": (n == 1).cast("long"), "twos": (n == 2).cast("long"), "more": (n > 2).cast("long")}
    return counts.select("*", *[F.sum(x).over(context).alias(k) for k, x in sums.items()],
                         (F.col(names[-1]) == F.min(names[-1]).over(context)).alias("lead"))


def _keyed(rows: DataFrame, value, weight, n) -> DataFrame:
    """(key, value, weight, n) of rows with a key. Single precision is enough for a term of a text's
    sum, which is taken in double."""
    return rows.select("key", value.cast("float").alias("value"), weight.cast("float").alias("weight"), n.cast("long").alias("n"))


def _discounts(counts: DataFrame) -> tuple[list[float], int, int]:
    """The three discounts, the sum of the counts and the number of n-grams."""
    r = counts.agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)],
                   F.sum("n").alias("total"), F.count(F.lit(1)).alias("types")).first()
    n = [0] + [r[f"n{k}"] or 0 for k in (1, 2, 3, 4)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    d = [min(k, max(0.1, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 * min(k, 2) for k in (1, 2, 3)]
    return d, r["total"] or 0, r["types"]


def _discount(d: list[float]):
    n = F.col("n")
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


class Model(NamedTuple):
    """Stored tables (key, value, weight, n) of the n-grams of the highest order, by slices if there are ``SLICES``,
    and of all others, by ``PARTS`` of the hash."""
    top: list[DataFrame]
    low: list[DataFrame]
    scratch: Scratch


def train(docs: DataFrame, order: int = ORDER) -> tuple[Model, float]:
    """The model and log P(unknown)."""
    scratch, kept_for = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    text = scratch.stored(docs.select("text"), "text")
    cuts = range(SLICES) if order > 2 else [None]
    counts = {order: [scratch.stored(_counted(text, order, i), "counts") for i in cuts]}
    scratch.drop(text)
    for k in range(order - 1, 0, -1):  # continuation counts: distinct words before
        last = [F.col(w).alias(x) for w, x in zip(_words(k, 2), _words(k))]
        # An n-gram's slice is that of its suffix, too, whose first word is its second one.
        above = counts[k + 1] if k == order - 1 > 1 else [reduce(DataFrame.union, counts[k + 1])]
        counts[k] = [scratch.stored(rows.groupBy(*_words(k, 2)).agg(F.count(F.lit(1)).alias("n")).select(*last, "n"), "counts")
                     for rows in above]

    none = F.lit(0.0)
    value, weight, p, n = F.col("value"), F.log(F.col("gamma").cast("double")), F.col("p"), F.col("n")
    words, = counts[1]
    d, total, types = _discounts(words)
    if not total:
        empty = [kept_for.stored(_keyed(words.select(F.col("w1").alias("key"), "n"), none, none, n), "model")]
        scratch.drop()
        return Model(empty, [], kept_for), 0.0
    spread = words.agg(F.sum(_discount(d))).first()[0] / total / (types + 1)

    def level(rows: DataFrame, value) -> DataFrame:
        """(key, n, value, p) of n-grams, stored by parts."""
        return scratch.stored(_by_part(rows.select("key", "n", value.cast("float").alias("value"), p.cast("float").alias("p"))), "level", "part")

    first = words.select(F.xxhash64("w1").alias("key"), "n", ((n - _discount(d)) / total + spread).alias("p"))
    if order == 1:
        tops = [kept_for.stored(_keyed(first, F.log(p) - math.log(spread), none, n), "model")]
        scratch.drop()
        return Model(tops, [], kept_for), math.log(spread)
    lower = [level(first, F.log(p) - math.log(spread))]
    levels, contexts, tops = [*lower], [], []
    for k in range(2, order + 1):
        d, _, _ = _discounts(reduce(DataFrame.union, counts[k]))
        made = []
        for i, grams in enumerate(counts[k]):
            # Words become hashes before they are dealt; of the words of a context only its hash is needed.
            key, before, after = (F.xxhash64(*w).alias(x) for w, x in (
                (_words(k), "key"), (_words(k - 1), "before"), (_words(k - 1, 2), "after")))
            if k == order:
                freed = d[0] * F.col("ones") + d[1] * F.col("twos") + d[2] * F.col("more")
                held = grams.select(key, before, after, "n", "all", (freed / F.col("all")).cast("float").alias("gamma"), "lead")
                sums = held.where("lead").select(F.col("before").alias("key"), "gamma")
                contexts.append(scratch.stored(_by_part(sums), "contexts", "part"))
            else:
                sums = grams.groupBy(*_words(k - 1)).agg(F.sum("n").alias("all"), F.sum(_discount(d)).alias("freed"))
                sums = sums.select(before.alias("key"), "all", (F.col("freed") / F.col("all")).cast("float").alias("gamma"))
                contexts.append(scratch.stored(_by_part(sums), "contexts", "part"))
                # The side that is looked up has each key once: its share of a task is small, and no row of the other is sorted.
                sums = contexts[-1].select(F.col("key").alias("before"), "all", "gamma").hint("shuffle_hash")
                held = grams.select(key, before, after, "n").join(sums, "before")
            below = lower[i] if len(lower) == len(counts[k]) else reduce(DataFrame.union, lower)
            below = below.select(F.col("key").alias("after"), p.cast("double").alias("below")).hint("shuffle_hash")
            gamma = F.col("gamma").cast("double")
            kept = held.select("key", "after", "n", "all", "gamma").join(below, "after").withColumn(
                "p", (n - _discount(d)) / F.col("all") + gamma * F.col("below"))
            grown = F.log(p) - F.log(gamma) - F.log("below")
            if k == order:
                tops.append(kept_for.stored(_keyed(kept, grown, none, n), "top"))
            else:
                made.append(level(kept, grown))
            scratch.drop(grams)
        lower = made
        levels += made
    low = []
    for i in range(PARTS):  # the highest order is no context: its n-grams need no second row
        rows = [_keyed(t.where(F.col("part") == i), value, none, n) for t in levels]
        rows += [_keyed(t.where(F.col("part") == i), none, weight, F.lit(0)) for t in contexts]
        low.append(kept_for.stored(reduce(DataFrame.union, rows).groupBy("key").agg(
            F.sum("value").cast("float").alias("value"), F.sum("weight").cast("float").alias("weight"), F.max("n").alias("n")), "model"))
        scratch.drop(*levels, *contexts, part=f"part={i}")
    scratch.drop()
    return Model(tops, low, kept_for), math.log(spread)


def _by_part(rows: DataFrame) -> DataFrame:
    """Adds the part of each key."""
    return rows.withColumn("part", _round_of(F.col("key"), PARTS).cast("int"))


def _round_of(key, rounds: int = ROUNDS):
    """The round in which n-grams are looked up, by bits of the hash."""
    if isinstance(key, np.ndarray):
        return (key.view(np.uint64) >> np.uint64(32)) % np.uint64(rounds)
    return F.pmod(F.shiftrightunsigned(key, 32), F.lit(rounds))


def _maybe(seen: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """The places of the keys that a bit table does not exclude."""
    at, k = np.arange(len(keys)), keys.view(np.uint64)
    for s in (0, 19, 64 - bits):
        p = (k[at] >> np.uint64(s)) & np.uint64((1 << bits) - 1)
        at = at[(seen[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
    return at


def _seen_bits(model: DataFrame, bits: int) -> np.ndarray:
    """Bit table of the model's keys: 2^bits bits, whatever the model's size."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy().view(np.uint64))
            size += len(held[-1])
            if size >= 1 << 20:
                yield words(np.concatenate(held))
                held, size = [], 0
        if size:
            yield words(np.concatenate(held))

    def words(keys: np.ndarray) -> pa.RecordBatch:
        bit = np.sort(np.concatenate([(keys >> np.uint64(s)) & np.uint64((1 << bits) - 1) for s in (0, 19, 64 - bits)]))
        at = bit >> np.uint64(6)
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        word = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), start)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (at[start], word)], ["at", "word"])

    made = model.select("key").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
    out[made["at"].to_numpy()] = made["word"].to_numpy().view(np.uint64)
    return out


def _most_frequent(model: DataFrame, sizes: list, head: int) -> DataFrame:
    """About ``head`` of the most frequent n-grams, found by a histogram of the counts (n, count): no row is
    sorted or shuffled. Of those of the last count a share by their keys; all others are joined."""
    cut, room = None, head
    for r in sorted(sizes, key=lambda r: -r["n"]):
        cut, share = r["n"], min(1.0, room / r["count"])
        room -= r["count"]
        if room <= 0:
            break
    if cut is None:
        return model.limit(0)
    part = F.pmod("key", F.lit(1 << 20)) < int(share * (1 << 20))
    return model.where((F.least("n", F.lit(1 << 16)) > cut) | ((F.least("n", F.lit(1 << 16)) == cut) & part))


def _round(docs: DataFrame, model: DataFrame, orders: list[int], at_round: int, sliced: bool, unknown: float, head: int,
           bits: int) -> DataFrame:
    """doc_id, words, part: the words of each text and the sum of its terms of some orders in one of the rounds, which
    are those of the slices, or else of the hash. ``model``: the rows of that round."""
    with short_shuffles(docs.sparkSession):
        sizes = model.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().collect()  # 65,537 rows at most
        # Four to eight bits a key, as far as the bound allows: of the unseen n-grams one in ten to thirty passes.
        bits = min(bits, max(20, (4 * sum(r["count"] for r in sizes)).bit_length()))
        most = _most_frequent(model, sizes, head).select("key", "value", "weight").toArrow().sort_by("key")
        seen_bits = _seen_bits(model, bits)
    shared = docs.sparkSession.sparkContext.broadcast((
        *[most[c].to_numpy() for c in ("key", "value", "weight")], seen_bits))
    del most, seen_bits
    kind = docs.schema["doc_id"].dataType.simpleString()
    salt = np.uint64(0x9E3779B97F4A7C15)

    def run(batches):
        keys, value, weight, seen = shared.value
        made = 0
        for batch in batches:
            for lo, hi, h, ptr in tv.words(batch.column(1), lower=False, limit=_CHUNK):
                base = np.diff(ptr) * unknown
                rows, rest, lasts = [], [], []
                of = _slice_of(h) % ROUNDS == at_round if sliced else None
                for k in orders:
                    g, row, last = _grams(h, ptr, k, of)
                    may = np.arange(len(g)) if sliced else np.flatnonzero(_round_of(g) == at_round)
                    may = may[_maybe(seen, g[may], bits)]
                    may = may[np.argsort(g[may])]  # a search in order stays in the processor's cache
                    g, row, last = g[may], row[may], last[may]
                    spot = np.searchsorted(keys, g)
                    spot[spot == len(keys)] = 0
                    known = keys[spot] == g if len(keys) else np.zeros(len(g), bool)
                    at = spot[known]
                    base += np.bincount(row[known], value[at].astype(np.float64) + weight[at] * ~last[known], len(base))
                    rows.append(row[~known])
                    rest.append(g[~known])
                    lasts.append(last[~known])
                n, ids = hi - lo, batch.column(0)
                row = np.concatenate([np.arange(n), *rows])
                made += n
                # The key of a document's own row only spreads these rows; it is never used as an n-gram.
                own = tv.mix(np.arange(made, made + n, dtype=np.uint64) * salt).view(np.int64)
                size, blank = len(row), len(row) - n
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(lo + row)), pa.array(np.concatenate([own, *rest])),
                     pa.array(np.concatenate([np.zeros(n, bool), *lasts])),
                     pa.array(np.concatenate([np.diff(ptr), np.zeros(blank, np.int64)]), mask=np.arange(size) >= n),
                     pa.array(np.concatenate([base, np.zeros(blank)]))],
                    ["doc_id", "key", "last", "words", "base"])

    rows = columns(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, key long, last boolean, words long, base double")
    value, weight = F.col("value").cast("double"), F.col("weight").cast("double")
    found = F.coalesce(value + F.when(F.col("last"), 0.0).otherwise(weight), F.lit(0.0))
    # A key of the model is there once, so its share of a task is small.
    made = (rows.join(model.select("key", "value", "weight").hint("shuffle_hash"), "key", "left")
            .select("doc_id", "words", F.when(F.col("words").isNotNull(), F.col("base")).otherwise(found).alias("part"))
            .groupBy("doc_id").agg(F.sum("words").alias("words"), F.sum("part").alias("part")))
    made = stored(made, "part")
    shared.destroy()  # the round is on disk: nothing computes it again
    return made


def log_likelihood(docs: DataFrame, model: Model, unknown: float, order: int = ORDER,
                   head: int = HEAD, bits: int = BITS, last: bool = False) -> DataFrame:
    """doc_id, words, loglik: the natural log of each text's probability. ``last``: the model's tables are
    deleted once they have been used."""
    parts = []
    for tables, orders in ((model.top, [order]), (model.low, list(range(1, order)))):
        sliced = tables is model.top and len(tables) == SLICES
        for i in range(ROUNDS if tables else 0):
            if len(tables) > 1:
                rows = reduce(DataFrame.union, tables[i::ROUNDS])
            else:
                rows = tables[0].where(_round_of(F.col("key")) == i)
            part = _round(docs, rows, orders, i, sliced, 0.0 if parts else unknown, head, bits)
            parts.append(part.withColumn("words", F.lit(0).cast("long")) if parts else part)
        if last and tables:
            model.scratch.drop(*tables)
    return reduce(DataFrame.union, parts).groupBy("doc_id").agg(F.sum("words").alias("words"), F.sum("part").alias("loglik"))


def _train_hash():
    return F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30))


def quality(docs: DataFrame, labels: DataFrame, order: int = ORDER, train_docs: int | None = None,
            quantile: float = QUANTILE, slack: float = SLACK, prior: int = PRIOR_WORDS) -> DataFrame:
    """doc_id, lang, words, perplexity, threshold, kept of each doc_id of ``docs`` (doc_id, text, lang).

    ``labels`` (doc_id, quality): documents with quality 1 (and no other) are trusted.
    ``train_docs``: a bound for the documents of the model, if one is wanted.
    """
    docs = columns(docs, "doc_id", "text", "lang")
    trusted = (columns(labels, "doc_id", "quality").groupBy("doc_id")
               .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
               .where("low = 1 AND high = 1 AND doc_id IS NOT NULL").select("doc_id"))
    ids = stored(columns(docs, "doc_id").join(trusted, "doc_id", "left_semi").distinct().select(
        "doc_id", _train_hash().alias("h")), "trusted")
    share = TRAIN if train_docs is None else min(TRAIN, train_docs / max(1, ids.count()))
    cut = int((1 << 30) * share)
    taught = ids.where(F.col("h") < cut).select("doc_id")
    likely = docs.where(_train_hash() < cut)  # the join moves no text that the hash alone rules out
    with fuller_tasks(docs.sparkSession):
        model, unknown = train(likely.join(taught, "doc_id", "left_semi"), order)
        scored = log_likelihood(docs, model, unknown, order, last=True)
    lang = docs.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    held = ids.select(F.col("doc_id").alias("held_id"), (F.col("h") >= cut).alias("held"))
    scored = scored.withColumnRenamed("doc_id", "id").join(lang, F.col("id").eqNullSafe(F.col("doc_id"))).drop("id")
    scored = stored(scored.join(held, F.col("doc_id") == F.col("held_id"), "left").withColumn(
        "nll", F.when(F.col("words") > 0, -F.col("loglik") / F.col("words"))), "scored")

    def per_lang(rows: DataFrame, value: str, q: float, name: str) -> DataFrame:
        """Adds the quantile of ``value`` over a language's held-out trusted rows (else over all of them)."""
        known = rows.where("held AND words > 0")
        every = known.agg(F.percentile_approx(value, q, 10000)).first()[0]
        own = known.where("lang IS NOT NULL").groupBy(F.col("lang").alias("of")).agg(
            F.percentile_approx(value, q, 10000).alias("own"))
        return rows.join(own, F.col("lang") == F.col("of"), "left").withColumn(
            name, F.coalesce("own", F.lit(every).cast("double"))).drop("of", "own")

    scored = per_lang(scored, "nll", 0.5, "mid")
    scored = scored.withColumn("mean", (-F.col("loglik") + prior * F.col("mid")) / (F.col("words") + prior))
    scored = per_lang(scored, "mean", quantile, "high")
    limit = F.col("high") + slack * (F.col("high") - F.col("mid"))
    return scored.select("doc_id", "lang", "words", F.exp("mean").alias("perplexity"), F.exp(limit).alias("threshold"),
                         F.coalesce(F.col("mean") <= limit, F.lit(True)).alias("kept"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and decision of every document."""
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
