"""Near-duplicate removal: the greedy keep-first rule, exact copies, empty
token sets, cosine; checked against a brute-force loop."""

import random

from pyspark.sql import functions as F

from evalpack.operators import dedupe as dd


def greedy_jaccard(texts, t):
    import re
    kept, sets, out = [], [], []
    for i, x in enumerate(texts):
        s = set(re.findall(r"[a-z0-9]+", x.lower()))
        dup = any((1.0 if not s and not k else len(s & k) / len(s | k)) >= t for k in sets)
        out.append(not dup)
        if not dup:
            sets.append(s)
    return out


def run_jaccard(spark, texts, t):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs, groups = dd.jaccard_pairs(df, "id", F.col("text"), t)
    kept = dd.keep_first(df.select("id"), pairs, groups)
    return [r["kept"] for r in kept.orderBy("id").collect()]


def test_chain_keeps_a_and_c(spark):
    texts = ["x1 x2 x3 x4", "x1 x2 x3 x4 x5 x6", "x3 x4 x5 x6 x7 x8"]
    assert run_jaccard(spark, texts, 0.5) == [True, False, True]


def test_copies_and_empty_sets(spark):
    texts = ["alpha beta gamma", "日本語", "alpha beta gamma", "中文 汉字", "alpha beta gamma delta", "alpha beta gamma"]
    assert run_jaccard(spark, texts, 0.85) == greedy_jaccard(texts, 0.85)
    assert run_jaccard(spark, texts, 0.85) == [True, True, False, False, True, False]


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(14)]
    texts = [" ".join(rng.sample(vocab, rng.randint(3, 8))) for _ in range(120)]
    for t in (0.5, 0.7, 0.85):
        assert run_jaccard(spark, texts, t) == greedy_jaccard(texts, t)


def test_cosine(spark):
    vecs = [[1.0, 0.0, 0.0], [0.99, 0.01, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0], [2.0, 0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(vecs)), "id long, v array<double>")
    pairs, groups = dd.cosine_pairs(df, "id", "v", 0.92)
    kept = dd.keep_first(df.select("id"), pairs, groups)
    assert [r["kept"] for r in kept.orderBy("id").collect()] == [True, False, True, True, False]


def test_cosine_random_against_brute_force(spark):
    import math
    rng = random.Random(5)
    vecs = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(80)]

    def cos(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / (na * nb)
    for t in (0.6, 0.9):
        kept, want = [], []
        for i, v in enumerate(vecs):
            dup = any(cos(v, vecs[k]) >= t for k in kept)
            want.append(not dup)
            if not dup:
                kept.append(i)
        df = spark.createDataFrame(list(enumerate(vecs)), "id long, v array<double>")
        pairs, groups = dd.cosine_pairs(df, "id", "v", t)
        got = dd.keep_first(df.select("id"), pairs, groups).orderBy("id").collect()
        assert [r["kept"] for r in got] == want


def test_vectors_must_align(spark):
    import pytest
    cases = spark.createDataFrame([(1,), (2,)], "id long")
    vecs = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    with pytest.raises(dd.VectorCountMismatch):
        dd.attach_vectors(cases, vecs, "id")
    ok = dd.attach_vectors(cases.limit(1), vecs, "id")
    assert ok.count() == 1


def test_cosine_of_any_length(spark):
    vecs = [[1.0, 0.0], [1.0, 0.0, 0.0], [0.99, 0.01], [0.99, 0.0, 0.02], None, []]
    df = spark.createDataFrame(list(enumerate(vecs)), "id long, v array<double>")
    pairs, groups = dd.cosine_pairs(df, "id", "v", 0.92, tasks=9)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(0, 2), (1, 3)]
    assert groups.count() == 6


def test_pairs_and_groups_are_all_pairs(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(9)]
    texts = [" ".join(rng.sample(vocab, rng.randint(4, 7))) for _ in range(90)]
    texts += texts[:20]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs, groups = dd.jaccard_pairs(df, "id", F.col("text"), 0.7)
    of = {}
    rep = {r["id"]: r["rep"] for r in groups.collect()}
    for i, r in rep.items():
        of.setdefault(r, []).append(i)
    got = {(i, j) for m in of.values() for i in m for j in m if i < j}
    for r in pairs.collect():
        if rep[r["a"]] != rep[r["b"]]:
            got |= {(min(i, j), max(i, j)) for i in of[r["a"]] for j in of[r["b"]]}
    sets = [set(t.split()) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7}
    assert got == want


def test_cosine_candidates_are_few_and_complete(spark):
    """At the stock similarity under 5 % of all pairs of the given vectors become rows, and none that is similar is lost."""
    import numpy as np
    from evalpack import dims
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    units = emb.select(F.col("vec_id").alias("id"), dd._unit(F.col("embedding")).alias("u"))
    n = units.count()
    assert dd.cosine_candidates(units, dims.DEDUPE_COSINE_THRESHOLD).count() < 0.05 * n * n
    rng = np.random.default_rng(10)
    base = rng.normal(size=(40, 24))
    vectors = [base[i % 40] + rng.normal(size=24) * s for i, s in enumerate([0.0, 0.1, 0.3, 0.6] * 40)] + [np.eye(24)[i % 3] for i in range(5)]
    vectors += [rng.normal(size=k) for k in (1, 1, 2, 3, 3)] + [np.zeros(24)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, v array<double>")
    for t in (0.4, 0.8, 0.92, 0.999):
        pairs, groups = dd.cosine_pairs(df, "id", "v", t)
        rep = {r.id: r.rep for r in groups.collect()}
        got = {(r.a, r.b) for r in pairs.collect()}
        cos = lambda a, b: float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) if len(a) == len(b) and a.any() and b.any() else 0.0
        firsts = [i for i in range(len(vectors)) if rep[i] == i]
        want = {(i, j) for i in firsts for j in firsts if i < j and cos(vectors[i], vectors[j]) >= t}
        assert {p for p in got if rep[p[1]] == p[1]} == want


def test_keep_first_of_a_long_chain(spark):
    """Each round's plan is that of one round: twelve rounds used to be nested plans of 9**4 copies of the first."""
    pairs = spark.createDataFrame([(i, i + 1) for i in range(24)], "a long, b long")
    ids = spark.range(26)
    kept = dd.keep_first(ids, pairs, ids.select("id", F.col("id").alias("rep")))
    assert len(kept._jdf.queryExecution().analyzed().toString()) < 20_000
    assert [r.kept for r in kept.orderBy("id").collect()] == [i % 2 == 0 or i == 25 for i in range(26)]


def test_jaccard_candidates_are_few(spark):
    """Unlike texts of shared frequent words are ruled out before their sets are compared; a row that comes twice pairs four times, as it did."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(120)]
    texts = [" ".join(rng.sample(vocab, 40)) for _ in range(200)]
    texts += [t.rsplit(" ", 2)[0] + f" z{i}" for i, t in enumerate(texts[:30])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = dd.token_table(df, "id", F.col("text")).select("id", "key", F.transform("tokens", lambda x: F.xxhash64(x)).alias("tokens"))
    prefixes = dd._prefixes(sets, 0.85)
    left = {(r.a, r.b) for r in dd._sketched(dd._met(prefixes, 0.85), prefixes, 0.85).collect()}
    assert {(i, 200 + i) for i in range(30)} <= left and len(left) < 100
    pairs, _ = dd.jaccard_pairs(df.where("id IN (0, 1, 200)").union(df.where("id = 0")), "id", F.col("text"), 0.85)
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 200)] * 4


def test_cosine_in_few_numbers_per_pair(spark):
    """Tiles compare blocks; a pair's cosine is the one that ``dot`` sums, whatever the number of tiles."""
    rng = random.Random(8)
    vecs = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(70)] + [[rng.gauss(0, 1) for _ in range(3)] for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(vecs)), "id long, v array<double>")
    units = df.select("id", dd._unit(F.col("v")).alias("u"))
    a, b = units.select(F.col("id").alias("a"), F.col("u").alias("ua")), units.select(F.col("id").alias("b"), F.col("u").alias("ub"))
    every = a.join(b, (F.col("a") < F.col("b")) & (F.size("ua") == F.size("ub"))).select("a", "b", dd.dot(F.col("ua"), F.col("ub")).alias("cosine"))
    want = {(r.a, r.b, r.cosine) for r in every.where("cosine >= 0.3").collect()}
    for tasks in (1, 40):
        assert {(r.a, r.b, r.cosine) for r in dd.cosine_pairs(df, "id", "v", 0.3, tasks)[0].collect()} == want
