"""Steps whose size grows with the tables: what is broadcast, stored and moved."""

import os
import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as e
from evalpack.operators import catalog as ct
from evalpack.operators import curate as cu
from evalpack.operators import dedupe as dd
from evalpack.operators import discovery, search
from evalpack.operators import synthesis as sy
from evalpack.plans import facts
from evalpack.session import ensure_checkpoint_dir

SMOKE = "/root/testdata/sf0.001"
HUB = ("seq long, id string, author string, gated boolean, disabled boolean, description string, downloads long, likes long, "
       "created_at string, last_modified string, tags array<string>")


def folder(spark) -> str:
    return ensure_checkpoint_dir(spark).removeprefix("file:")


def started(df) -> str:
    """The physical plan as it is before any stage has run."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_completions_are_not_broadcast(spark, monkeypatch):
    cases = spark.range(300).select(F.lit("p").alias("pack"), F.col("id").alias("slot"), F.format_string('{"caseId": "c%d"}', "id").alias("raw"))
    packs = spark.createDataFrame([("p", ["input"], "custom", "general")], "pack string, fields array<string>, task_type string, primary_industry string")
    answers = spark.range(300).select(F.col("id").alias("slot"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt")).select(
        "slot", "attempt", F.when((F.col("slot") % 2 == 0) & (F.col("attempt") == 1), "no").otherwise('{"caseId": "x", "input": "i"}').alias("text"),
        F.lit(1).cast("long").alias("prompt_tokens"), F.lit(1).cast("long").alias("completion_tokens"))
    plans, stored, written = {}, sy.stored, sy.written

    def seen(save):
        def run(df, name, *a, **k):
            plans[name.rsplit("/", 1)[-1]] = started(df)
            return save(df, name, *a, **k)
        return run

    monkeypatch.setattr(sy, "stored", seen(stored))
    monkeypatch.setattr(sy, "written", seen(written))
    out = sy.fill_gaps(sy.fill_prompts(cases, F.broadcast(packs), lambda f: F.array_join(f, ",")), sy.landed(answers), ["input"])
    assert out.cases.where("enriched AND get_json_object(raw, '$.input') = 'i'").count() == 300
    assert {"attempt-1", "attempt-2", "gap-filled"} <= set(plans)
    assert "SortMergeJoin [slot" in plans["gap-filled"] and "BroadcastHashJoin [slot" not in plans["gap-filled"]
    assert not re.search("BroadcastHashJoin.*LeftAnti", plans["attempt-2"])


def test_candidates_hold_a_text_once(spark):
    rows = spark.sql("""SELECT * FROM VALUES
        (0, 'bank loans', parse_json('{"description": "bank loans"}'), 'id bank loans tag', 'bank loans'),
        (1, 'other', parse_json('{"description": "bank loans"}'), 'id é other', 'nothing of it'),
        (2, '', parse_json('{"description": ""}'), 'id', ''), (3, NULL, parse_json('{"description": 5}'), 'id', NULL),
        (4, '5', parse_json('{"description": 5}'), '5', '55'), (5, 'x', NULL, NULL, 'x') AS t(seq, summary, raw, search_text, domain_text)""")
    once = discovery.texts_once(rows)
    first = once.where("seq = 0").first()
    assert (first.summary, first.search_text, first.domain_text) == (None, None, None) and first.search_text_around == ("id ", " tag")
    told = [tuple(r) for r in rows.select("seq", "summary", "search_text", "domain_text").orderBy("seq").collect()]
    assert [tuple(r) for r in discovery.with_texts(once).select("seq", "summary", "search_text", "domain_text").orderBy("seq").collect()] == told


def test_a_search_deals_only_postings_that_can_count(spark):
    # w1 to w200 are in one document each, "a" and "b" in all: the probe asks for "a w7" and must not deal the postings of "b"
    docs = spark.range(200).select(F.lit(0).alias("scope"), F.col("id").alias("doc"), F.col("id").alias("place"), F.format_string("a b w%d", "id").alias("text"))
    index = search.build_index(docs)
    hits = search.probe(spark.createDataFrame([(0, ["a", "w7"], "a w7")], "scope int, tokens array<string>, key string"), index, 5)
    assert [r.doc for r in hits.collect()] == [7]
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2


def test_discovery_leaves_no_index_behind(spark):
    hub = ct.normalize_hub(spark.createDataFrame([(0, "acme/loans", "acme", False, False, "bank loan questions", 10, 1, None, None, ["license:mit"]),
                                                  (1, "acme/more", "acme", False, False, "a bank loan", 10, 1, None, None, [])], HUB))
    before = set(os.listdir(folder(spark)))
    found = discovery.discover(spark.createDataFrame([(1, "bank loan")], "qid int, query string"), [hub], 2)
    assert [r.id for r in found.orderBy("rank").collect()] == ["acme/loans", "acme/more"]
    left = {re.sub("-[0-9a-f]{32}$", "", x) for x in set(os.listdir(folder(spark))) - before}
    assert "discovery-pairs" in left and not left & {"search-postings", "search-frequency", "search-candidates", "discovery-candidates"}


def test_fenced_blocks_are_found_without_a_pattern_of_the_body(spark):
    rng, parts = random.Random(5), ["```", "`", "json", "JSON", "js", " ", "\n", "{", "}", '{"caseId": "c"}', "é", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(600)] + ["```json\n" + "y" * 100_000 + "\n```", None]

    def plain(text):
        text = text.strip(" \t\n\x0b\f\r")
        if block := re.search(r"```(?:json)?\s*([\s\S]*?)```", text, re.I | re.A):
            text = block[1].strip(" \t\n\x0b\f\r")
        first, last = text.find("{"), text.rfind("}")
        return text[first:last + 1] if 0 <= first < last else text

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    want = [(i, None if t is None else plain(t)) for i, t in enumerate(texts)]
    for body in (cu._with_body(rows, "text").select("id", "_body"), rows.select("id", cu.extract_json_object(F.col("text")))):
        assert [tuple(r) for r in body.orderBy("id").collect()] == want
        assert "[\\s\\S]" not in started(body)


def test_thinning_keeps_the_first_of_near_copies(spark, monkeypatch):
    rng, words = random.Random(11), [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(6):
        base = rng.sample(words, 40)
        for _ in range(25):
            # copies at distances around the threshold, so that not all are similar to the first
            texts.append(" ".join(rng.sample(words, (k := rng.randrange(5))) + base[k // 2:] + (base[:1] if rng.random() < 0.2 else [])))
    texts += ["", "", texts[3], texts[40], "w1", "w2 w1"]
    rng.shuffle(texts)
    sets, kept = [set(t.split()) for t in texts], []
    for i, x in enumerate(sets):
        if not any(len(x & sets[j]) / len(x | sets[j]) >= 0.85 if x | sets[j] else True for j in kept):
            kept.append(i)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rounds, thinned = [], dd._thinned
    monkeypatch.setattr(dd, "CROWD", 3)
    monkeypatch.setattr(dd, "THINNED", 10 ** 9)
    monkeypatch.setattr(dd, "_thinned", lambda p, *a: rounds.append((p.count(), (left := thinned(p, *a)).count())) or left)
    every, _ = dd.jaccard_pairs(rows, "id", F.col("text"), 0.85)
    assert not rounds
    pairs, groups = dd.jaccard_pairs(rows, "id", F.col("text"), 0.85, first_only=True)
    got = dd.keep_first(rows.select("id"), pairs, groups)
    assert sorted(r.id for r in got.where("kept").collect()) == kept
    assert rounds[0][1] < rounds[0][0] and pairs.count() < every.count() / 3
    # ids that come twice are left to all pairs
    twice = rows.union(rows.where("id < 5"))
    assert dd.jaccard_pairs(twice, "id", F.col("text"), 0.85, first_only=True)[0].count() == dd.jaccard_pairs(twice, "id", F.col("text"), 0.85)[0].count()
    assert len(rounds) == 1


def test_tokens_are_made_once(spark, monkeypatch):
    plans, stored = [], dd.Scratch.stored
    monkeypatch.setattr(dd.Scratch, "stored", lambda self, df, name, *a: plans.append((name, started(df))) or stored(self, df, name, *a))
    rows = spark.createDataFrame([(1, "a b"), (2, "b a a"), (3, None)], "id long, text string")
    pairs, groups = dd.jaccard_pairs(rows, "id", F.col("text"), 0.85)
    assert dict(plans)["tokens"].count("regexp_extract_all") == 1
    assert [tuple(r) for r in pairs.collect()] == [(1, 2, 1.0)] and groups.count() == 2


def test_snapshots_move_lines_not_their_words(spark):
    def plan(key: str) -> str:
        return e.queries()[key](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()

    documents, snapshot = plan("company_metrics"), plan("company_snapshot")
    assert "date_format" in documents and "date_format" not in documents[documents.rindex("Aggregate [l_orderkey"):].split("\n", 1)[1]
    assert 0 < snapshot.index("sec.gov") < snapshot.rindex("Join Inner, (l_orderkey")


def test_lines_without_a_part_are_written_under_the_last_concept(spark, tmp_path):
    spark.sql("""SELECT * FROM VALUES (1L, 1, CAST(NULL AS BIGINT), 'N', 'F', 2.5D, DATE'2020-01-02')
        AS t(l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, l_extendedprice, l_shipdate)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT * FROM VALUES (1L, 7L) AS t(o_orderkey, o_custkey)").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.doc for r in facts.company_documents(spark, str(tmp_path)).collect()] == [
        '{"facts":{"us-gaap":{"EarningsPerShareDiluted":{"units":{"USD/shares":[{"val":2.5,"fy":2020,"fp":"Q1","form":"10-K","filed":"2020-01-02",'
        '"end":"2019-12-03"}]}}}}}']
