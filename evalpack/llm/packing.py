"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

A document becomes its token ids and an end id. A document longer than a
sequence is cut into full pieces; its first piece holds the rest, so only that
one and short documents are packed. Shards of ``SHARD`` pieces are dealt by a
hash of the document and packed independently: longest first, each into the
open bin with the least room that still holds it. A bin's room is a whole
number up to the capacity, so the open bins hang below the leaves of a segment
tree over the rooms, and the tightest bin is found in log2(capacity) steps.

Token ids are made once for each distinct pre-token of a slice of text and
gathered for the rest; texts for which that is not plain (contractions, special
token strings) go through the tokenizer whole.

Defined results: a null or empty text is the end id alone; repeated rows and
rows that share a doc_id are documents of their own; a null doc_id is carried;
ties in length go by doc_id; an empty table gives an empty result; other
columns are ignored. No text is cut off and no piece dropped.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import by_batch, columns, read, stored

CAPACITY, END_ID, SHARD = 1024, 2, 65536
_SLICE = 1 << 20
_LETTER, _NUMBER, _BLANK, _OTHER = 1, 2, 3, 4
_PLAIN_NOT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|<\|")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@cache
def _classes() -> np.ndarray:
    """The pre-tokenizer's class of each code point: letter, number, white space, other."""
    import regex
    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
        for m in regex.finditer(pattern, points):
            for a, b in ((m.start(), min(m.end(), 0xD800)), (max(m.start(), 0xD800) + 0x800, m.end() + 0x800)):
                if a < b:
                    out[a:b] = kind
    return out


def pre_tokens(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Start of each pre-token of texts without contractions. ``bounds``: where texts start and end."""
    kind = _classes()[points]
    edge = np.zeros(len(points) + 1, bool)
    edge[bounds] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    blank = kind == _BLANK
    last = blank.copy()  # the last blank of a run that something follows
    last[:-1] &= ~blank[1:] & ~edge[1:-1]
    last[-1:] = False
    start |= last
    joined = np.flatnonzero(last & (points == 32)) + 1  # one space goes with what follows it
    start[joined] = False
    return np.flatnonzero(start)


class Ids:
    """Token ids of texts. Keeps the ids of at most ``keep`` pre-tokens between slices."""

    def __init__(self, path: str, keep: int = 400_000):
        self.tok, self.keep = _tokenizer(path), keep
        self._clear()

    def _clear(self) -> None:
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Adds pre-tokens, in the order of their hashes."""
        made = [e.ids for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.array([len(x) for x in made], np.int64)
        at = len(self.flat) + np.cumsum(size) - size
        spot = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, spot, hashes)
        self.at, self.size = np.insert(self.at, spot, at), np.insert(self.size, spot, size)
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(made), np.uint32, int(size.sum()))])

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts = pre_tokens(points, bounds[:-1] if len(points) else bounds[:0])
        ends = np.append(starts[1:], len(points))
        up, down = tv._powers(len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(tv.mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
        hashes = tv.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.keep:
            self._clear()
        new = np.flatnonzero(~np.isin(distinct, self.known, assume_unique=True))
        if len(new):
            self._learn(distinct[new], [joined[starts[k] : ends[k]] for k in first[new]])
        spot = np.searchsorted(self.known, distinct)[inverse]
        size = self.size[spot]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[spot] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        cut = np.concatenate([[0], stop])[np.searchsorted(starts, bounds)]
        return [ids[cut[i] : cut[i + 1]] for i in range(len(texts))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [not _PLAIN_NOT.search(t) for t in texts]
        out = iter(self._plain([t for t, p in zip(texts, plain) if p]) if any(plain) else [])
        return [next(out) if p else self._whole(t) for t, p in zip(texts, plain)]


def pieces(docs: DataFrame, capacity: int, end_id: int, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of each document."""
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        ids = Ids(path)
        for batch in batches:
            _, offsets = tv.utf8(batch.column(1))
            for lo, hi in tv.slices(offsets, _SLICE):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, one in enumerate(ids.encode(texts)):
                    one = np.append(one, np.uint32(end_id)).astype("<u4")
                    first = (len(one) - 1) % capacity + 1
                    for k, a in enumerate([0, *range(first, len(one), capacity)]):
                        part = one[a : first if not k else a + capacity]
                        row.append(lo + i)
                        piece.append(k)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            kept.append(part.astype(np.int32))
                cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, fields)

    return columns(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, taken in the order given (longest first for best-fit decreasing).

    Leaf r of the tree counts the open bins with room r; an inner node sums its
    leaves. The tightest bin for a length is the first leaf at or after it that
    is not empty: up until a right neighbour has one, then down to the left.
    """
    width = 1 << capacity.bit_length()
    tree, open_bins = [0] * (2 * width), [[] for _ in range(capacity + 1)]
    bins, offsets, made = [], [], 0
    for length in lengths:
        node = width + length
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < width:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
        if node > 1:
            room = node - width
            chosen = open_bins[room].pop()
            while node:
                tree[node] -= 1
                node >>= 1
        else:
            room, chosen = capacity, made
            made += 1
        bins.append(chosen)
        offsets.append(capacity - room)
        if room > length:
            open_bins[room - length].append(chosen)
            node = width + room - length
            while node:
                tree[node] += 1
                node >>= 1
    return bins, offsets


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None,
         shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    ``sequence_id`` is the shard and the bin within it; full pieces have a
    sequence of their own, numbered below zero. A shard holds its pieces' ids
    while it is packed if ``with_ids``, so choose a smaller ``shard`` then.
    """
    cut = stored(pieces(docs, capacity, end_id, path or tokenizer_path(), with_ids), "pieces")
    short = cut.where(F.col("length") < capacity)
    shards = max(1, -(-short.count() // shard))

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "ids_crc32"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit(part["length"].tolist(), capacity)
        part["sequence_id"] = np.array(bins, np.int64) * shards + part["shard"].to_numpy()
        part["offset"] = np.array(offsets, np.int64)
        return part.drop(columns="shard")

    # A row's own key: its document and contents; the shards are of about equal size whatever the rows.
    dealt = short.withColumn("shard", F.pmod(F.xxhash64("doc_id", "length", "ids_crc32"), F.lit(shards)))
    placed = dealt.groupBy("shard").applyInPandas(
        place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long")
    full = cut.where(F.col("length") == capacity).withColumn(
        "sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return full.unionByName(placed)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(read(spark, sf_dir, "documents"))
