"""The stages of corpus_pipeline.py on edge rows, against brute force, and the whole run."""

import random
import re

import pytest

import corpus_pipeline
from evalpack.llm import quality
from evalpack.llm.common import stored

#: Columns whose names the stages use inside, and a repeated column name of the operators.
EXTRA = ["lang", "__dropped", "__sha", "dropped", "dropped_", "dropped_sha", "kept", "digest", "key", "n", "keep_id"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)


def prose(rng, n):
    stems = "th er on an re he in ed nd ha at en es of or".split()
    return " ".join(rng.choice(stems) + rng.choice(["", "ing", "tion", "ble", "ly"]) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", *"abcdefghij") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """Texts, the leaked item's place and a folder with labels and benchmark."""
    rng = random.Random(3)
    rows = [(i, prose(rng, 60)) for i in range(60)]
    item = prose(rng, 40)
    rows += [(60, rows[5][1].replace(" ", "  ")), (61, rows[5][1] + " more"), (62, f"{rows[6][1]} {item} {rows[7][1]}"),
             (63, "zq xv " * 60), (64, None), (65, ""), (66, " "), (None, prose(rng, 60)), (8, rows[8][1]), (67, rows[5][1])]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(None, None, None)], "doc_id long, quality int, toxic int"
                          ).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, folder


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_quality_stage_keeps_what_the_operator_keeps(spark, given):
    rows, folder = given
    docs = table(spark, rows)
    out = corpus_pipeline.keep_quality(spark, docs, folder)
    gone = {r.doc_id for r in quality.quality(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("NOT kept").collect()}
    assert out.columns == docs.columns and 63 in gone
    assert ids(out) == ids(docs.where(f"doc_id IS NULL OR doc_id NOT IN ({', '.join(map(str, gone))})"))


def test_exact_stage(spark, given):
    rows, folder = given
    out = corpus_pipeline.keep_first_copies(spark, table(spark, rows), folder)
    first = {}
    for i, t in rows:
        text = re.sub("[\x20\x09-\x0D]+", " ", t or "")
        first[text] = min((x for x in (first.get(text), i) if x is not None), default=None)
    want = sorted([i for i, t in rows if i in first.values()], key=lambda x: (x is None, x))
    assert out.columns == table(spark, []).columns and ids(out) == want
    assert {60, 65, 67}.isdisjoint(want) and want.count(8) == 2  # repeated rows share their id


def test_near_and_leak_stages(spark, given):
    rows, folder = given
    near = corpus_pipeline.keep_one_of_near_copies(spark, table(spark, rows), folder)
    assert near.columns == table(spark, []).columns
    assert ids(near) == [i for i in ids(table(spark, rows)) if i not in (60, 61, 67)]
    clean = corpus_pipeline.drop_leaks(spark, table(spark, rows), folder)
    assert clean.columns == near.columns and ids(clean) == [i for i in ids(table(spark, rows)) if i != 62]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, given, stage):
    assert stage(spark, table(spark, []), given[1]).count() == 0


def test_run_applies_each_stage_to_what_the_last_one_kept(spark, given, tmp_path):
    rows, folder = given
    sf = str(tmp_path)
    table(spark, rows).write.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    docs = table(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), "stage")
    out = corpus_pipeline.run(spark, sf)
    left = set(ids(docs))
    assert {r.doc_id for r in out.collect()} == left and left.isdisjoint({60, 61, 62, 63, 67})
    assert left >= set(range(60))
