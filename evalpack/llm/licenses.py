"""License texts in documents, by winnowed fingerprints and banded alignment.

Templates are fingerprinted by winnowing: of every ``WINDOW`` consecutive hashes
of ``K`` letters or digits (case folded, all else skipped) the smallest is
kept, so any common run of K + WINDOW - 1 characters has a common fingerprint.
The index from fingerprint to (template, place) holds the templates only, and
is broadcast; it is limited to ``MAX_CHARS`` characters of templates, a
parameter that is checked. Documents are winnowed alike; a fingerprint in the
index names a candidate and its diagonal. Around each cluster of diagonals the
template's words are aligned with the document's in a band (matches +2,
differences and gaps -1), and an alignment that matches at least ``COVERAGE`` of
the template is reported with its span in code points. Where reported spans
overlap, the one with more matched words is kept (ties: the larger coverage,
then the name).

The work is a map over documents; nothing is shuffled.

Defined results: a null or empty text has no matches; a license that occurs
several times in a text is reported each time; repeated rows are each reported;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textvec as tv
from .common import by_batch, columns, read
from .license_templates import TEMPLATES

K, WINDOW, BAND, COVERAGE, MAX_CHARS = 12, 4, 12, 0.75, 4_000_000
_POWERS = tuple(np.uint64(pow(0x9E3779B97F4A7C15, e, 1 << 64)) for e in (1, 2, 4))
_KEPT = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
_WORD = re.compile(r"[^\W_]+")


def winnow(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, byte places of their first characters) of texts that lie between ``bounds``."""
    at = np.flatnonzero(_KEPT[data])
    n = len(at) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64), at[:0]
    one = tv._BYTE_LOWER[data[at]]
    b, b2, b4 = _POWERS
    two = one[:-1] * b + one[1:]
    four = two[:-2] * b2 + two[2:]
    eight = four[:-4] * b4 + four[4:]
    h = tv.mix(eight[:n] * b4 + four[8 : 8 + n])  # K = 12
    text = np.searchsorted(bounds, at, side="right")
    h = np.where(text[:n] == text[K - 1 :], h, ~np.uint64(0))  # never across texts
    if n < WINDOW:
        chosen = np.array([n - 1 - int(np.argmin(h[::-1]))])
    else:
        low = np.minimum(h[:-1], h[1:])
        low = np.minimum(low[:-2], low[2:])
        take = np.zeros(n, bool)
        left = np.ones(len(low), bool)
        for j in range(WINDOW - 1, -1, -1):  # the last of equal ones
            here = left & (h[j : j + len(low)] == low)
            take[np.flatnonzero(here) + j] = True
            left &= ~here
        chosen = np.flatnonzero(take)
    # Texts shorter than a window, or its rest at an edge, keep their smallest too.
    chosen = chosen[h[chosen] != ~np.uint64(0)]
    return h[chosen], at[chosen]


def align(template: list[str], words: list[str], band: int = BAND) -> tuple[int, int, int]:
    """Matched words, first and last matched word of the best local alignment of a template
    with ``words`` whose diagonal is 0, give or take ``band``."""
    n, m = len(template), len(words)
    before: dict[int, tuple[int, int, int, int]] = {}
    best = (0, 0, -1, -1)  # score, matched, first, last
    for i in range(n):
        row: dict[int, tuple[int, int, int, int]] = {}
        for j in range(max(0, i - band), min(m, i + band + 1)):
            s, k, first, last = before.get(j - 1, (0, 0, -1, -1))
            cell = (s + 2, k + 1, j if first < 0 else first, j) if template[i] == words[j] else (s - 1, k, first, last)
            for other in (before.get(j), row.get(j - 1)):
                if other and other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            if cell[0] > 0:
                row[j] = cell
                if cell[:2] > best[:2]:
                    best = cell
        before = row
    return best[1:]


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]):
        if sum(map(len, templates.values())) > MAX_CHARS:
            raise ValueError(f"templates of more than {MAX_CHARS} characters are not broadcast")
        self.names = sorted(templates)
        self.words = [[w.lower() for w in _WORD.findall(templates[n])] for n in self.names]
        self.posts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, name in enumerate(self.names):
            raw = templates[name].encode()
            h, at = winnow(np.frombuffer(raw, np.uint8), np.array([0]))
            starts = [len(raw.decode()[: m.start()].encode()) for m in _WORD.finditer(templates[name])]
            for x, p in zip(h.tolist(), at.tolist()):
                self.posts[x].append((t, bisect_right(starts, p) - 1))
        self.keys = np.sort(np.fromiter(self.posts, np.uint64, len(self.posts)))
        self.some = np.zeros(1 << 16, bool)
        self.some[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in the index and their places."""
        h, at = winnow(data, bounds)
        may = self.some[(h >> np.uint64(48)).astype(np.int64)]
        h, at = h[may], at[may]
        spot = np.searchsorted(self.keys, h)
        spot[spot == len(self.keys)] = 0
        found = self.keys[spot] == h if len(self.keys) else np.zeros(len(h), bool)
        return h[found], at[found]

    def matches(self, text: str, h: list[int], places: list[int]) -> list[tuple]:
        """(name, coverage, matched, start, end) of the templates in a text, from its hits (byte places)."""
        spans = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
        begins = [a for _, a, _ in spans]
        starts = np.cumsum([len(text[a:b].encode()) for a, b in zip([0, *begins[:-1]], begins)])
        diagonals: dict[int, set[int]] = defaultdict(set)
        for x, p in zip(h, places):
            word = bisect_right(starts, p) - 1
            for t, offset in self.posts[x]:
                diagonals[t].add(word - offset)
        found = []
        for t, ds in diagonals.items():
            template = self.words[t]
            last, band = None, min(BAND, max(1, len(template) // 2))
            for d in sorted(ds):
                if last is not None and d - last < band:
                    continue  # this diagonal lies in the band of the last one
                last = d
                lead, a = max(0, -d), max(0, d)
                words = [""] * lead + [w for w, _, _ in spans[a : d + len(template) + 2 * band]]
                matched, first, end = align(template, words, 2 * band)
                if matched >= COVERAGE * len(template) and first >= lead:
                    found.append((self.names[t], matched / len(template), matched, spans[a + first - lead][1], spans[a + end - lead][2]))
        kept: list[tuple] = []
        for x in sorted(set(found), key=lambda x: (-x[2], -x[1], x[0], x[3])):
            if all(x[4] <= y[3] or x[3] >= y[4] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: x[3])


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, coverage, matched_words, start, end (code points) of each license text found."""
    held = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))

    def work(batch: pa.RecordBatch):
        index, out = held.value, []
        data, offsets = tv.utf8(batch.column(1))
        for lo, hi in tv.slices(offsets, 1 << 20):
            part, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            h, at = index.hits(part, bounds)
            row = np.searchsorted(bounds, at, side="right") - 1
            for i in np.unique(row):
                own = row == i
                text = batch.column(1)[int(lo + i)].as_py()
                out += [(int(lo + i), *x) for x in index.matches(text, h[own].tolist(), (at[own] - bounds[i]).tolist())]
        if not out:
            return None
        rows, *rest = map(list, zip(*out))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *map(pa.array, rest)],
                                          ["doc_id", "license", "coverage", "matched_words", "start", "end"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(columns(docs, "doc_id", "text"), work,
                    f"doc_id {kind}, license string, coverage double, matched_words long, start long, end long")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts found in every document."""
    return license_spans(read(spark, sf_dir, "documents"))
