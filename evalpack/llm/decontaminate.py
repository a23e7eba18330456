"""Benchmark passages in documents, paraphrases included, by latent semantic retrieval.

Benchmark items are cut into passages of ``WINDOW`` words with TF-IDF weights,
the inverse document frequencies counted over all documents. A randomised SVD
(power iterations on row blocks, summed over tasks) gives the latent space of
each ``RANK`` passages: as many dimensions as passages, so it keeps all of every
passage, however many items there are. Every window of ``SPAN`` words of every
document, one each ``STRIDE`` words, is folded into the spaces; a passage lies
whole in one of them, wherever it starts. A pair is a candidate unless its inner
product shows that the window lacks ``PARAPHRASE`` of the passage: it is then
smaller than that of the passage's lightest words that make up that much. A
candidate is checked by the longest common subsequence of the item's words and
the words around the window, weighted by inverse document frequency: it is a leak if that covers
``COVERAGE`` of the item, or ``PARAPHRASE`` of it and ``ANSWER`` of its answer
(the item's answer where the table has one, its last sentence otherwise).

Words are hashed to 2^18 features, a table of fixed size that is broadcast. Items
are worked off in blocks of ``BLOCK``, each with spaces of its own, so what is
broadcast does not grow with the benchmark.

Defined results: null and empty texts and items match nothing; repeated
documents are each reported; items of equal text are each reported; several
windows of a document that match an item give one row, that of the largest
coverage (ties: the first place); empty tables give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import by_batch, columns, read, stored

FEATURES, WINDOW, STRIDE, RANK, BLOCK = 18, 64, 32, 160, 4096
SPAN = WINDOW + STRIDE
COVERAGE, PARAPHRASE, ANSWER = 0.6, 0.45, 0.8
_CHUNK = 1 << 17


def _feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FEATURES)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and their number: 2^FEATURES counts, whatever the input."""
    def run(batches):
        total, n = np.zeros(1 << FEATURES, np.int64), 0
        for batch in batches:
            for lo, hi, h, ptr in tv.words(batch.column(0), lower=True, sep=tv.PUNCT):
                row = np.repeat(np.arange(hi - lo), np.diff(ptr))
                pairs = np.unique((row << FEATURES) | _feature(h))
                total += np.bincount(pairs & ((1 << FEATURES) - 1), minlength=1 << FEATURES)
                n += hi - lo
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["at", "n"])

    made = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = made["at"].to_numpy(), made["n"].to_numpy()
    out = np.zeros(1 << FEATURES, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def randomised_svd(rows: DataFrame, idf: np.ndarray, vocabulary: np.ndarray, rank: int, iterations: int = 2,
                   seed: int = 7) -> np.ndarray:
    """Right singular vectors (vocabulary x rank) of the TF-IDF passages ``rows`` (features array<long>).

    Each step multiplies the thin basis by A'A: tasks sum their passages'
    contributions, and Spark adds the sums of the tasks by matrix row.
    """
    spark = rows.sparkSession
    width = min(rank + 16, len(vocabulary))
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(vocabulary), width)))
    for _ in range(iterations + 1):
        held = spark.sparkContext.broadcast((basis.astype(np.float32), idf, vocabulary))

        def work(batches):
            b, weights, vocab = held.value
            total = np.zeros((len(vocab), b.shape[1]))
            for batch in batches:
                for features in batch.column(0).to_pylist():
                    f, n = np.unique(np.array(features, np.int64), return_counts=True)
                    at, w = np.searchsorted(vocab, f), n * weights[f]
                    w = w / max(np.linalg.norm(w), 1e-12)
                    total[at] += np.outer(w, w @ b[at])
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at]), pa.list_(pa.float64()))], ["at", "row"])

        parts = rows.select("features").mapInArrow(work, "at long, row array<double>")
        cells = parts.select("at", F.posexplode("row").alias("j", "v")).groupBy("at", "j").agg(F.sum("v").alias("v")).toArrow()
        image = np.zeros_like(basis)
        image[cells["at"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
        basis, r = np.linalg.qr(image)
    u, _, _ = np.linalg.svd(r)
    return (basis @ u)[:, :rank]


def weighted_lcs(item: np.ndarray, text: np.ndarray, weight: np.ndarray, answer: int) -> tuple[float, float, int, int]:
    """The heaviest common subsequence of two word lists: its weight, the weight in the
    item's words from ``answer`` on, and the first and last place in the text."""
    n, m = len(item), len(text)
    best = np.zeros((n + 1, m + 1))
    same = item[:, None] == text[None, :]
    for i in range(n):
        gain = np.where(same[i], best[i, :-1] + weight[i], best[i, 1:])
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(gain, best[i, 1:]))
    i, j, tail, first, last = n, m, 0.0, -1, -1
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            first, last = j, last if last >= 0 else j
            tail += weight[i] if i >= answer else 0.0
    return float(best[n, m]), tail, first, last


def _answer_start(text: str) -> int:
    """Number of words before the last sentence."""
    head = text.rstrip().rstrip(".!?").rstrip()
    cut = max(head.rfind(c) for c in ".!?\n")
    return len(tv.hash_words([head[: cut + 1]], True, tv.PUNCT)[0]) if cut >= 0 else 0


class _Items:
    """The words, weights and answers of a block of items, and its passages in the latent space."""

    def __init__(self, items, idf: np.ndarray):
        self.ids = [i for i, _, _ in items]
        self.words = tv.hash_words([t or "" for _, t, _ in items], True, tv.PUNCT)
        self.words = [h if a is None else np.concatenate([h, *tv.hash_words([a], True, tv.PUNCT)])
                      for h, (_, _, a) in zip(self.words, items)]
        self.answer = [_answer_start(t or "") if a is None else len(tv.hash_words([t or ""], True, tv.PUNCT)[0])
                       for _, t, a in items]
        self.weight = [idf[_feature(h)].astype(float) for h in self.words]
        self.distinct = [np.unique(h, return_inverse=True) for h in self.words]
        self.distinct = [(u, np.bincount(at, w, len(u))) for (u, at), w in zip(self.distinct, self.weight)]
        self.item, self.features = [], []
        for k, h in enumerate(self.words):
            # Every other passage from the first on: a partition, one part of which holds its share of any match.
            for a in sorted({*range(0, max(1, len(h) - STRIDE), STRIDE), *range(0, len(h), WINDOW)}):
                if len(h):
                    self.item.append(k)
                    self.features.append(_feature(h[a : a + WINDOW]))


def _least(weights: np.ndarray) -> float:
    """The smallest sum of squares of some of the weights that make up PARAPHRASE of their sum."""
    w = np.sort(weights.astype(float))
    before = np.cumsum(w) - w
    part = np.clip(PARAPHRASE * w.sum() - before, 0, w)
    return float((part * w).sum())


def _present(item: tuple[np.ndarray, np.ndarray], text: np.ndarray) -> float:
    """The weight of an item's words that the text has, in whatever order."""
    words, weight = item
    at = np.minimum(np.searchsorted(words, text), len(words) - 1)
    seen = np.zeros(len(words), bool)
    seen[at[words[at] == text]] = True
    return float(weight @ seen)


def _candidates(h: np.ndarray, ptr: np.ndarray, idf: np.ndarray, spaces: list
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, text, passage, cosine) of the windows that may hold enough of a passage, by their first word."""
    f = _feature(h)
    sizes = -(-np.diff(ptr) // STRIDE)
    text = np.repeat(np.arange(len(ptr) - 1), sizes)
    block = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = ptr[:-1][text] + block * STRIDE
    if not len(start):
        return start, text, start, start.astype(float)
    follows = (text[1:] == text[:-1])[:, None]

    def spans(parts: np.ndarray) -> np.ndarray:
        """Sums of three blocks from sums of one."""
        two = parts.copy()
        two[:-1] += parts[1:] * follows
        parts[:-1] += two[1:] * follows
        return parts

    norm = np.sqrt(np.maximum(spans(np.add.reduceat(idf[f] ** 2, start)[:, None])[:, 0], 1e-12))
    found, first = [], 0
    for row_of, table, passages, least in spaces:
        row = row_of[f]
        hit = np.flatnonzero(row)
        edge = np.searchsorted(hit, start)
        some = edge < np.append(edge[1:], len(hit))
        latent = np.zeros((len(start), table.shape[1]), np.float32)
        if len(hit):
            latent[some] = np.add.reduceat(table[row[hit]], edge[some], axis=0)
        inner = spans(latent) @ passages.T
        at, p = np.nonzero(inner >= least)
        found.append((at, p + first, inner[at, p] / norm[at]))
        first += len(passages)
    at, p, cosine = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((p, at))
    return start[at[order]], text[at[order]], p[order], cosine[order]


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """doc_id, item_id, cosine, coverage, answer_coverage, first_word, last_word of each leak.

    ``benchmark``: item_id, text and, if there is one, answer.
    """
    docs = columns(docs, "doc_id", "text")
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select("item_id", "text", answer.alias("answer")).where("text IS NOT NULL")
    n, blocks = items.count(), None
    frequency, total = document_frequencies(docs)
    idf = np.log((total + 1) / (frequency + 1)).astype(np.float32) + np.float32(0.01)
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(-(-n // BLOCK) or 1)))
    for k in range(-(-n // BLOCK)):
        block = [tuple(r) for r in numbered.where(F.col("block") == k).drop("block").orderBy("item_id", "text").collect()]
        found = _block_leaks(docs, block, idf, rank, items.schema["item_id"].dataType.simpleString())
        blocks = found if blocks is None else blocks.union(found)
    if blocks is None:
        kinds = [f"{c} {t.schema[c].dataType.simpleString()}" for c, t in (("doc_id", docs), ("item_id", items))]
        return docs.sparkSession.createDataFrame([], ", ".join(kinds) + _SCHEMA)
    return blocks


_SCHEMA = ", cosine double, coverage double, answer_coverage double, first_word long, last_word long"


def _space(spark: SparkSession, features: list, idf: np.ndarray) -> tuple:
    """The latent space of some passages: the row of each feature, the rows, the passages in it, their least inner products."""
    vocabulary = np.unique(np.concatenate(features))
    loadings = randomised_svd(spark.createDataFrame([(f.tolist(),) for f in features], "features array<long>"),
                              idf, vocabulary, len(features))
    row_of = np.zeros(1 << FEATURES, np.int32)
    row_of[vocabulary] = np.arange(1, len(vocabulary) + 1)
    table = np.vstack([np.zeros((1, loadings.shape[1])), loadings * idf[vocabulary][:, None]]).astype(np.float32)
    passages = np.stack([table[row_of[f]].sum(axis=0) for f in features])
    norm = np.maximum(np.linalg.norm(passages, axis=1, keepdims=True), 1e-6)
    least = np.array([_least(idf[f]) for f in features]) / norm[:, 0]
    return row_of, table, passages / norm, (0.999 * least).astype(np.float32)


def _block_leaks(docs: DataFrame, block: list, idf: np.ndarray, rank: int, item_kind: str) -> DataFrame:
    spark = docs.sparkSession
    items = _Items(block, idf)
    spaces = [_space(spark, items.features[a : a + rank], idf) for a in range(0, len(items.features), rank)]
    held = spark.sparkContext.broadcast((items, idf, spaces))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch):
        own, weights, near = held.value
        out = []
        for lo, _, h, ptr in tv.words(batch.column(1), lower=True, sep=tv.PUNCT, limit=_CHUNK):
            best = {}
            for start, text, p, cos in zip(*_candidates(h, ptr, weights, near)):
                k = own.item[p]
                if best.get((text, k), (0.0,))[0] >= 1 - 1e-9:
                    continue  # found whole further ahead
                size = len(own.words[k])
                a, b = max(ptr[text], start - size), min(ptr[text + 1], start + SPAN + size)
                whole = own.weight[k].sum()
                if not whole or _present(own.distinct[k], h[a:b]) < (PARAPHRASE - 1e-9) * whole:
                    continue  # not even the words are there, in whatever order
                got, tail, first, last = weighted_lcs(own.words[k], h[a:b], own.weight[k], own.answer[k])
                answer_whole = own.weight[k][own.answer[k] :].sum()
                cover, answered = got / whole, tail / answer_whole if answer_whole else 0.0
                if cover >= COVERAGE or cover >= PARAPHRASE and answered >= ANSWER:
                    row = (cover, -int(a + first - ptr[text]), float(cos), answered, int(a + last - ptr[text]))
                    best[text, k] = max(best.get((text, k), row), row)
            out += [(lo + t, own.ids[k], c, v, w, -f, e) for (t, k), (v, f, c, w, e) in best.items()]
        if not out:
            return None
        rows, ids, *rest = map(list, zip(*out))
        names = ["doc_id", "item_id", "cosine", "coverage", "answer_coverage", "first_word", "last_word"]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(ids), *map(pa.array, rest)], names)

    return by_batch(docs, work, f"doc_id {kind}, item_id {item_kind}" + _SCHEMA)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
