"""Deduplication, packing and decontamination against brute force and on edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalpack.llm import decontaminate, exact_dedup, near_dedup, packing

DOCS = "doc_id long, text string, lang string, digest string, node string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def family(rng, size, edits, base_words=120):
    base = [f"w{rng.randrange(5000)}" for _ in range(base_words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_match_all_pairs(spark):
    rng = random.Random(5)
    texts = family(rng, 60, 6) + family(rng, 40, 3, 60) + family(rng, 30, 1, 20)
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    texts += ["", None, " \t\n", "one two", "One  TWO", "one two three", texts[0], texts[0].upper()]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    want = brute_components(rows)
    assert got == want
    assert 1 < sum(k for _, _, k in want.values()) < len(rows)


def test_near_duplicates_edge_rows(spark):
    same = "a b c d e f g h"
    got = near_dedup.near_duplicates(docs(spark, [(None, same), (None, "q r s"), (4, same), (4, same), (4, None)])).collect()
    rows = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)
    assert rows == Counter({(None, 4, 4, False): 1, (None, 1, None, True): 1, (4, 4, 4, True): 2, (4, 0, 4, True): 1})
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def weak(column):
    """A digest with collisions between different texts."""
    return F.unhex(F.sha2(F.encode(F.substring(column, 1, 1), "UTF-8"), 256))


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for body, ids in groups.items():
        sha = hashlib.sha256(body.encode()).hexdigest()
        low = min((i for i in ids if i is not None), default=None)
        out += [(i, low, len(ids), i == low, sha) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_exact_dedup_over_several_batches(spark, digest):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a b", "a  b", "a\tb\n", "a c", "b", "", None, " ", "é x", "é  x"])) for i in range(80)]
    rows += [(7, "a b"), (7, "a b"), (None, "b"), (None, "only null")]
    data = docs(spark, rows).repartition(5)
    got = exact_dedup.exact_dedup(data, digest=digest, files_per_batch=1)
    assert Counter(tuple(r) for r in got.collect()) == brute_exact(rows)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def tokens(text):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.tokenizer_path())
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


ODD = ["", "it's a 'test'\n\n x", "a  b\t\tc \n d   ", "<|endoftext|> x", "é　ü x", "   ", "\n", "99a!b 1½ ٣",
       "😀😀 a  b", "' s 'x", "''", " ' ", "don't 'S", "x y  z", "a" * 3000, "﻿ab"]


def test_ids_are_the_tokenizers(spark):
    ids = packing.Ids(packing.tokenizer_path(), keep=5)
    for texts in ([t] for t in ODD):
        assert ids.encode(texts)[0].tolist() == tokens(texts[0])[:-1].tolist()
    assert [x.tolist() for x in ids.encode(ODD)] == [tokens(t)[:-1].tolist() for t in ODD]


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(2)
    for capacity in (1, 7, 1024):
        lengths = sorted((rng.randint(1, capacity) for _ in range(500)), reverse=True)
        bins, offsets = packing.best_fit(lengths, capacity)
        rooms = []
        for length, b, o in zip(lengths, bins, offsets):
            fits = [r for r in rooms if r >= length]
            room = min(fits) if fits else capacity
            if b == len(rooms):
                rooms.append(capacity)
            assert (rooms[b], o) == (room, capacity - room)
            rooms[b] -= length


def test_packing_round_trip(spark):
    rows = [(1, None), (1, ""), (None, "x y z"), (3, "hello " * 3000), (3, "hello " * 3000), (4, "hi " * 1023), (5, "hi " * 1024)]
    rows += [(10 + i, t) for i, t in enumerate(ODD)]
    out = packing.pack(docs(spark, rows), with_ids=True, shard=8).toPandas()
    assert Counter(out["ids_crc32"]) == Counter(
        zlib.crc32(ids[a:b].tobytes()) for _, t in rows for ids in [tokens(t)]
        for first in [(len(ids) - 1) % 1024 + 1] for a, b in [(0, first), *((k, k + 1024) for k in range(first, len(ids), 1024))])
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(out["ids"], out["ids_crc32"]))
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        ends = (part["offset"] + part["length"]).tolist()
        assert part["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= 1024
    assert packing.pack(docs(spark, [])).count() == 0


def invented(rng, n):
    return " ".join(rng.choice("th er on an re he in ed nd ha at en es of or".split()) + rng.choice(
        "ing tion ble ly st wh".split()) + rng.choice("a e i o u".split()) for _ in range(n))


def test_leaks_found_and_others_left(spark):
    rng = random.Random(8)
    items = [(k, invented(rng, 30) + ". " + invented(rng, 8) + ".") for k in range(40)]
    rows, want = [], set()
    for i in range(120):
        body = [invented(rng, rng.randrange(5, 250)), invented(rng, rng.randrange(5, 250))]
        if i % 3 == 0:
            k = rng.randrange(40)
            leak = items[k][1].split()
            if i % 2:  # a paraphrase: every sixth word differs
                leak = [w if j % 6 else "other" for j, w in enumerate(leak)]
            body.insert(1, " ".join(leak).upper() if i % 4 == 0 else " ".join(leak))
            want.add((i, k))
        rows.append((i, " ".join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(0.4 < r.coverage <= 1.0 + 1e-6 for r in got)


def test_every_planted_item_is_found(spark, n=1000):
    rng = random.Random(12)
    stems = [f"{a}{b}{c}" for a in "badefogu" for b in "nrstlmkp" for c in "iaeouy"]
    word = lambda: rng.choice(stems) + rng.choice(stems[::7]) * rng.randrange(2)
    items = [(k, " ".join(word() for _ in range(rng.randrange(3, 90)))) for k in range(n)]
    rows = []
    for k, text in items:  # at every place of the grid of windows, every third one paraphrased
        leak = [w if k % 3 or j % 4 else "other" for j, w in enumerate(text.split())]
        rows.append((k, " ".join([*(word() for _ in range(k % 32 + 32 * rng.randrange(4))), *leak, *(word() for _ in range(rng.randrange(150)))])))
    got = decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r.doc_id for r in got if r.doc_id == r.item_id}
    idf = decontaminate.document_frequencies(docs(spark, rows).select("doc_id", "text"))
    weight = np.log((idf[1] + 1) / (idf[0] + 1)).astype(np.float32) + np.float32(0.01)
    want = set()
    for (k, item), (_, text) in zip(items, rows):
        a, b = decontaminate.tv.hash_words([item, text], True, decontaminate.tv.PUNCT)
        w = weight[decontaminate._feature(a)].astype(float)
        if decontaminate.weighted_lcs(a, b[: k % 32 + 96 + 90], w, 0)[0] >= decontaminate.COVERAGE * w.sum():
            want.add(k)
    assert len(want) > n // 3 and want - found == set()


def test_leaks_edge_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, "alpha beta gamma delta epsilon zeta")],
                                  "item_id long, text string")
    rows = [(1, None), (2, ""), (None, "alpha beta gamma delta epsilon zeta"), (5, "x Alpha, beta; gamma delta epsilon zeta y")] * 2
    rows += [(k, f"f{k} g{k} h{k}") for k in range(100, 160)]
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, rows), bench).collect())
    assert got == Counter({(None, 1): 2, (None, 4): 2, (5, 1): 2, (5, 4): 2})
    assert decontaminate.leaks(docs(spark, []), bench).count() == 0
    assert decontaminate.leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_weighted_lcs():
    a, b = np.array([1, 2, 3, 4]), np.array([9, 1, 9, 3, 4, 2])
    got, tail, first, last = decontaminate.weighted_lcs(a, b, np.array([1.0, 5.0, 1.0, 1.0]), 2)
    assert (got, first, last) == (6.0, 1, 5) and tail == 0.0


def test_svd_spans_the_passages(spark):
    rng = np.random.default_rng(1)
    rows = [sorted(rng.choice(50, 12, replace=False).tolist()) for _ in range(30)]
    idf = np.ones(1 << decontaminate.FEATURES, np.float32)
    vocabulary = np.unique(np.concatenate(rows))
    v = decontaminate.randomised_svd(spark.createDataFrame([(r,) for r in rows], "features array<long>"), idf, vocabulary, 10, 4)
    dense = np.zeros((30, len(vocabulary)))
    for i, r in enumerate(rows):
        dense[i, np.searchsorted(vocabulary, r)] = 1 / np.sqrt(12)
    exact = np.linalg.svd(dense)[1][:10]
    assert np.allclose(np.linalg.norm(dense @ v, axis=0), exact, rtol=0.05)
