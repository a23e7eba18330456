"""Toxicity by the nearest labelled examples.

At most ``EXAMPLES`` labelled documents of each class (chosen by a hash of
their id among the rows that may be learnt from) are the examples. A text is the
TF-IDF vector, of length one, of all its words and word beginnings that any
example has, document frequencies counted over all documents; no such term is
left out, and a term counts up to ``LIFT`` times as much, the more its presence
among the examples depends on the label (square root of 1 + chi-square).

The inverted index has a posting list for each term. The lists of the terms of
more than one in ``SELDOM`` examples (``FREQUENT`` at most) are kept as
block-max blocks: examples lie in blocks of ``BLOCK``, those with like terms side
by side, and for each (term, block) the largest weight is kept. A query's sums
over the other lists are made first; with its inner product with a block's
largest weights they bound its cosine with every example in it, so a block is
opened only for texts whose ``NEIGHBOURS``-th best cosine so far is not above the
bound: the neighbours are exact (ties: the smaller doc_id). Neighbours vote with
``exp((cosine - 1) / WIDTH)``, weighted so that the classes count as in all
labelled rows; the votes are calibrated by a logistic curve fitted on the
examples' own votes, each without itself.

Examples are bounded by the parameters; index and examples are broadcast.

Defined results: a text without any term (empty or null ones too) gets the
share of toxic among the labelled examples without a term of chi-square ``CHI2``; repeated rows are
scored alike; without labels of both classes every score is the share of toxic
labels (0 without labels); a row with contradicting labels is not learnt from;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import by_batch, columns, read, stored

EXAMPLES, CHI2, NEIGHBOURS, BLOCK, WIDTH, EVIDENCE = 4000, 30.0, 25, 64, 0.1, 5
PREFIX, LIFT, SELDOM, FREQUENT = 5, 8.0, 32, 512


def held_out(doc_id: Column | None = None) -> Column:
    """Rows that labels are never learnt from."""
    return F.pmod(F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def _terms(col: pa.Array):
    """Yields (first row, end row, term hashes, row of each): words and the first PREFIX bytes of longer ones."""
    data, offsets = tv.utf8(col)
    for lo, hi in tv.slices(offsets, 1 << 20):
        part = data[offsets[lo] : offsets[hi]]
        starts, ends, ptr = tv.word_spans(part, offsets[lo : hi + 1] - offsets[lo], tv.PUNCT)
        row = np.repeat(np.arange(hi - lo), np.diff(ptr))
        long = ends - starts > PREFIX
        head = tv.mix(tv.word_hashes(part, starts[long], starts[long] + PREFIX, True))
        yield lo, hi, np.concatenate([tv.word_hashes(part, starts, ends, True), head]), np.concatenate([row, row[long]])


class Vectors:
    """Sparse rows: the cells (row, term, value), by row and term."""

    def __init__(self, n: int, width: int, row: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.n, self.width, self.value = n, width, value
        self.row, self.term = row.astype(np.int32), term.astype(np.int32)

    @staticmethod
    def of(rows) -> Vectors:
        if isinstance(rows, Vectors):
            return rows
        row, term = np.nonzero(rows)
        return Vectors(*rows.shape, row, term, rows[row, term])

    def take(self, rows: np.ndarray) -> Vectors:
        """Some of the rows, in the given order."""
        first, size = np.searchsorted(self.row, rows), np.bincount(self.row, minlength=self.n)[rows]
        at = _runs(first, size)
        return Vectors(len(rows), self.width, np.repeat(np.arange(len(rows)), size), self.term[at], self.value[at])

    def __matmul__(self, other: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * other[self.term], self.n)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each run."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _counted(col: pa.Array):
    """Yields (first row, end row, row of each cell, its term hash, its count), by row and hash."""
    for lo, hi, h, row in _terms(col):
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)])
        yield lo, hi, row[at], h[at], np.diff(np.append(at, len(h)))


def _known(terms: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the hashes that are terms, and which these are."""
    at = np.searchsorted(terms, h)
    at[at == len(terms)] = 0
    hit = terms[at] == h if len(terms) else np.zeros(len(h), bool)
    return at[hit], hit


def _vectors(col: pa.Array, terms: np.ndarray):
    """Yields (first row, end row, term counts) in pieces of at most 256 texts."""
    for lo, hi, row, h, n in _counted(col):
        at, hit = _known(terms, h)
        row, n = row[hit], n[hit]
        for a in range(lo, hi, 256):
            b = min(hi, a + 256)
            own = slice(*np.searchsorted(row, [a - lo, b - lo]))
            yield a, b, Vectors(b - a, len(terms), row[own] - (a - lo), at[own], n[own])


def _weighted(counts, idf: np.ndarray):
    """TF-IDF vectors of length one, as a matrix if the counts are one."""
    c = Vectors.of(counts)
    w = (1 + np.log(c.value)) * idf[c.term]
    norm = np.sqrt(np.maximum(np.bincount(c.row, w * w, c.n), 1e-18))
    if isinstance(counts, Vectors):
        return Vectors(c.n, c.width, c.row, c.term, (w / norm[c.row]).astype(np.float32))
    out = np.zeros((c.n, c.width))
    out[c.row, c.term] = w / norm[c.row]
    return out


class Index:
    """Block-max index of the examples and their votes."""

    def __init__(self, ids, labels, counts, idf, prior: float, k: int, telling: np.ndarray | None = None):
        """``telling``: the terms without which an example counts as one without terms (all)."""
        self.idf, self.k, self.prior = idf, k, prior
        counts = Vectors.of(counts)
        vectors = _weighted(counts, idf)
        size = np.bincount(vectors.row, minlength=vectors.n)
        some = size > 0
        none = np.bincount(counts.row[np.ones(len(counts.row), bool) if telling is None else telling[counts.term]], minlength=counts.n) == 0
        n = np.bincount(labels, minlength=2)
        share = np.array([1 - prior, prior]) / np.maximum(n, 1) * max(1, n.sum())
        weight = share[labels]
        self.none = float((weight * labels)[none].sum() + prior) / float(weight[none].sum() + 1)
        self.none = min(max(self.none, 0.0), 1.0)
        # Like examples side by side: by their heaviest term, then the next.
        heavy = np.lexsort((-vectors.value, vectors.row))
        rank = np.full((vectors.n, 3), -1)
        for j in range(3):
            own = size > j
            rank[own, j] = vectors.term[heavy[(np.cumsum(size) - size)[own] + j]]
        order = np.lexsort((ids, rank[:, 2], rank[:, 1], rank[:, 0]))
        order = order[some[order]]
        self.ids, self.labels, self.weight, self.vectors = ids[order], labels[order], weight[order], vectors.take(order)
        del vectors, heavy
        # Ties go to the smaller doc_id: a cosine is rounded and followed by the rank of the id.
        self.tie = np.empty(len(order), np.int64)
        self.tie[np.argsort(self.ids, kind="stable")] = np.arange(len(order))[::-1]
        self.starts = np.arange(0, len(order), BLOCK)
        v = self.vectors
        df = np.bincount(v.term, minlength=v.width)
        often = np.argsort(-df, kind="stable")[:FREQUENT]
        often = often[df[often] * SELDOM > len(order)]
        self.column = np.full(v.width, -1)
        self.column[often] = np.arange(len(often))
        dense = self.column[v.term] >= 0
        self.frequent = np.zeros((len(order), len(often)), np.float32)
        self.frequent[v.row[dense], self.column[v.term[dense]]] = v.value[dense]
        self.most = np.maximum.reduceat(self.frequent, self.starts, axis=0) if len(order) else self.frequent
        by_term = np.flatnonzero(~dense)
        by_term = by_term[np.argsort(v.term[by_term], kind="stable")]
        self.listed, self.listed_value = v.row[by_term], v.value[by_term]
        self.ptr = np.searchsorted(v.term[by_term], np.arange(v.width + 1))
        self.a, self.b = 1.0, 0.0
        if len(order):
            self._calibrate()

    def _listed(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """The sums over the posting lists, of each query and example; about a million postings at a time."""
        size = max(1, len(self.ids))
        out = np.zeros((n, size))
        first, length = self.ptr[term], self.ptr[term + 1] - self.ptr[term]
        ends = np.searchsorted(row, np.arange(n + 1))
        upto = np.append(0, np.cumsum(length))[ends]
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + (1 << 20), side="right")) - 1)
            own = slice(ends[a], ends[b])
            at, many = _runs(first[own], length[own]), length[own]
            cell = np.repeat((row[own] - a).astype(np.int64) * size, many) + self.listed[at]
            out[a:b] = np.bincount(cell, np.repeat(value[own], many) * self.listed_value[at], (b - a) * size).reshape(b - a, size)
            a = b
        return out

    def nearest(self, queries, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosines, example numbers; -1: none) of the k nearest examples of each query."""
        q = Vectors.of(queries)
        n, size = q.n, max(1, len(self.ids))
        best = np.full((n, self.k), -1, np.int64)
        by_tie = np.argsort(self.tie)
        often = self.column[q.term] >= 0
        frequent = np.zeros((n, self.frequent.shape[1]))
        frequent[q.row[often], self.column[q.term[often]]] = q.value[often]
        listed = self._listed(q.row[~often], q.term[~often], q.value[~often].astype(float), n)
        bound = frequent @ self.most.T + np.maximum.reduceat(listed, self.starts, axis=1)
        bound = np.floor((bound + 1e-5) * 1e6).astype(np.int64) * size + size
        for block in np.argsort(-bound.max(axis=0, initial=0), kind="stable"):
            need = np.flatnonzero((bound[:, block] > best[:, 0]) & (bound[:, block] > 10 * size))
            if not len(need):
                continue
            at = slice(block * BLOCK, (block + 1) * BLOCK)
            cos = np.rint((frequent[need] @ self.frequent[at].T.astype(float) + listed[need, at]) * 1e6).astype(np.int64)
            key = np.where(cos > 0, cos * size + self.tie[at], -1)
            if skip is not None:
                key[skip[need][:, None] == np.arange(len(self.ids))[at]] = -1
            both = np.concatenate([best[need], key], axis=1)
            best[need] = np.sort(np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k:], axis=1)
        best = best[:, ::-1]
        return np.where(best >= 0, best // size / 1e6, 0.0), np.where(best >= 0, by_tie[best % size], -1)

    def _votes(self, cos: np.ndarray, who: np.ndarray) -> np.ndarray:
        w = np.where(who >= 0, np.exp((cos - 1) / WIDTH), 0.0) * self.weight[who]
        return ((w * self.labels[who]).sum(axis=1) + 0.01 * self.prior) / (w.sum(axis=1) + 0.01)

    def _calibrate(self) -> None:
        """Logistic curve from vote log-odds to labels, by Newton steps."""
        votes = np.concatenate([self._votes(*self.nearest(self.vectors.take(x), x))
                                for x in np.split(np.arange(len(self.ids)), range(256, len(self.ids), 256))])
        x = np.stack([self._odds(votes), np.ones(len(votes))], axis=1)
        y = np.where(self.labels == 1, (self.labels.sum() + 1) / (self.labels.sum() + 2), 1 / (len(votes) - self.labels.sum() + 2))
        theta = np.array([1.0, 0.0])

        def loss(t):
            z = x @ t
            return (self.weight * (np.logaddexp(0, z) - y * z)).sum() + 5e-4 * ((t - [1, 0]) ** 2).sum()

        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            h = (x * (self.weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.clip(np.linalg.solve(h, x.T @ (self.weight * (p - y)) + 1e-3 * (theta - [1, 0])), -2, 2)
            for _ in range(30):  # a whole step may overshoot where votes are near 0 and 1
                if loss(theta - step) <= loss(theta):
                    theta = theta - step
                    break
                step = step / 2
        self.a, self.b = max(0.1, float(theta[0])), float(theta[1])

    @staticmethod
    def _odds(v: np.ndarray) -> np.ndarray:
        v = np.clip(v, 1e-4, 1 - 1e-4)
        return np.log(v / (1 - v))

    def score(self, counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, cosines, example numbers) of texts given as term counts."""
        counts = Vectors.of(counts)
        out = np.full(counts.n, self.none)
        cos, who = np.zeros((counts.n, self.k)), np.full((counts.n, self.k), -1, np.int64)
        some = np.flatnonzero(np.bincount(counts.row, minlength=counts.n))
        if len(some) and len(self.ids):
            cos[some], who[some] = self.nearest(_weighted(counts, self.idf).take(some))
            out[some] = 1 / (1 + np.exp(-(self.a * self._odds(self._votes(cos[some], who[some])) + self.b)))
        return out, cos, who


def _chi2(term: np.ndarray, toxic: np.ndarray, width: int, n: float, t: float) -> np.ndarray:
    """Chi-square of each term's presence and the label; ``toxic``: the label of each (example, term)."""
    df, a = np.bincount(term, minlength=width).astype(float), np.bincount(term, toxic, width)
    whole = df * (n - df) * t * (n - t)
    return np.where(whole > 0, (a * n - df * t) ** 2 * n / np.maximum(whole, 1), 0.0)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> tuple[np.ndarray, Index]:
    """The terms and the index, learnt from rows that are not held out."""
    given = (columns(labels, "doc_id", "toxic").where(~held_out()).groupBy("doc_id")
             .agg(F.min("toxic").alias("label"), F.max("toxic").alias("high")).where("label = high AND label IN (0, 1)")
             .select("doc_id", "label"))
    given = stored(given.join(columns(docs, "doc_id").distinct(), "doc_id", "left_semi"), "labels")
    sizes = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    picked = [given.where(F.col("label") == k).orderBy(order, "doc_id").limit(examples) for k in (0, 1)]
    picked = stored(picked[0].union(picked[1]), "picked")
    chosen = stored(docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(
        F.first("label").alias("label"), F.min("text").alias("text")), "examples")

    def count(batch: pa.RecordBatch):
        for a, b, row, h, n in _counted(batch.column(2)):
            ends = pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(a, b - a) for i in (0, 1)),
                 *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h.view(np.int64), n.astype(np.int32)))],
                ["doc_id", "label", "terms", "counts"])

    rows = by_batch(chosen.select("doc_id", F.col("label").cast("int").alias("label"), "text"), count,
                    f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, terms array<long>, counts array<int>").toArrow()
    ids = rows["doc_id"].to_numpy().astype(np.int64)
    label, size = rows["label"].to_numpy().astype(np.int64), pa.compute.list_value_length(rows["terms"]).to_numpy().astype(np.int64)
    names, term = np.unique(pa.compute.list_flatten(rows["terms"]).to_numpy().view(np.uint64), return_inverse=True)
    counted = pa.compute.list_flatten(rows["counts"]).to_numpy()
    term = term.astype(np.int32)
    del rows
    held = docs.sparkSession.sparkContext.broadcast(names)

    def frequency(batches):
        total, n = np.zeros(len(held.value), np.int64), 0
        for batch in batches:
            for lo, hi, _, h, _ in _counted(batch.column(0)):
                total += np.bincount(_known(held.value, h)[0], minlength=len(total))
                n += hi - lo
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["at", "n"])

    made = docs.select("text").mapInArrow(frequency, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = made["at"].to_numpy(), made["n"].to_numpy()
    df = np.zeros(len(names))
    df[at[at >= 0]] = n[at >= 0]
    chi2 = _chi2(term, label.repeat(size), len(names), len(label), label.sum())
    idf = (np.log((n[at < 0].sum() + 1) / (df + 1)) + 0.1) * np.minimum(LIFT, np.sqrt(1 + chi2))
    row = np.repeat(np.arange(len(label)), size)
    counts = Vectors(len(label), len(names), row, term, counted)
    return names, Index(ids, label, counts, idf, prior, neighbours, chi2 >= CHI2)


def toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, held_out, score, neighbour_ids and neighbour_cosines (the EVIDENCE nearest) of each row.

    ``docs``: doc_id (a whole number), text; ``labels``: doc_id, toxic.
    """
    docs = columns(docs, "doc_id", "text")
    names, index = fit(docs, labels, **params)
    index.vectors = None  # the lists and blocks have them
    held = docs.sparkSession.sparkContext.broadcast((names, index))

    def work(batch: pa.RecordBatch):
        names, index = held.value
        for a, b, m in _vectors(batch.column(1), names):
            score, cos, who = index.score(m)
            near = [[int(index.ids[j]) for j in row if j >= 0] for row in who[:, :EVIDENCE]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(score), pa.array(near, pa.list_(pa.int64())),
                 pa.array([list(c[: len(x)]) for c, x in zip(cos, near)], pa.list_(pa.float64()))],
                ["doc_id", "score", "neighbour_ids", "neighbour_cosines"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = by_batch(docs, work, f"doc_id {kind}, score double, neighbour_ids array<long>, neighbour_cosines array<double>")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "neighbour_ids", "neighbour_cosines")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    scored = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
