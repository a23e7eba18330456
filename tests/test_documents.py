"""The JSON document sink and the nested manifest it is made for."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evalpack import dims
from evalpack.operators.manifest import nested_manifest
from evalpack.sources.documents import write_documents

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_manifest_documents_read_back(spark, tmp_path):
    rows = [("a/b", i, json.dumps({"caseId": str(i), "taskType": t, "input": "bank loan é", "expected": 1, "metadata": {"license": "MIT"}}))
            for i, t in enumerate(["code", "planning", "code", ""])] + [("c", 0, "plain"), ("c", 1, None)]
    m = nested_manifest(spark.createDataFrame(rows, "pack string, seq long, raw string"), dims.STOCK_TAXONOMY, "2024-01-01")
    path = str(tmp_path / "out")
    write_documents(m.select(F.col("pack").alias("name"), F.to_json("manifest").alias("document")), path)
    assert sorted(os.listdir(path)) == ["_SUCCESS", "a%2Fb.json", "c.json"]
    text = open(f"{path}/a%2Fb.json", encoding="utf8").read()
    back = json.loads(text)
    assert text.startswith('{\n  "schemaVersion"') and text.endswith("}\n")
    want = {r.pack: r.manifest.asDict(recursive=True) for r in m.collect()}
    drop = lambda x: {k: drop(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [drop(v) for v in x] if isinstance(x, list) else x
    assert back == drop(want["a/b"]) and json.load(open(f"{path}/c.json")) == drop(want["c"])
    assert back["source"] == {"name": "a/b", "licenseName": "MIT"} and back["generatedAt"] == "2024-01-01"
    assert back["summary"]["taskTypes"] == ["code", "planning"] and back["summary"]["caseCount"] == 4
    assert back["industryProfile"]["primaryIndustry"] == "finance" and back["industryProfile"]["matches"][0]["matchedKeywords"] == ["bank", "loan"]
    assert len(back["schemaProfile"]["signals"]) == 12 and back["schemaProfile"]["signals"][0]["key"] == "taskInstruction"
    assert back["enrichmentPlan"]["steps"][-1]["inputs"] == ["industry taxonomy", "workflow focus", "readiness profile"]


def test_manifest_reads_its_cases_twice(spark, tmp_path):
    """Once for the facts and once for keywords, however many steps need them (F19)."""
    rows = [("p", i, json.dumps({"input": "bank loan", "taskType": "code"})) for i in range(6)] + [("q", 0, "plain"), ("q", 1, None)]
    path = str(tmp_path / "cases")
    spark.createDataFrame(rows, "pack string, seq long, raw string").coalesce(1).write.parquet(path)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    cases = spark.read.parquet(path)
    m = nested_manifest(cases.mapInArrow(counted, cases.schema), dims.STOCK_TAXONOMY).collect()
    assert {r.pack: r.manifest.summary.caseCount for r in m} == {"p": 6, "q": 2}
    assert read.value == 2 * len(rows)


def test_failed_task_leaves_no_document(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("name"),
                                           F.when(F.col("id") == 35, "broken {").otherwise('{"a": 1}').alias("document"), "id")
    with pytest.raises(Exception):
        write_documents(rows, path)
    assert os.listdir(tmp_path) == []
    write_documents(rows.where("id < 20"), path)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception):
            write_documents(rows.where("id > 30"), path, mode)
        assert os.listdir(tmp_path) == ["out"] and len(os.listdir(path)) == 21  # as it was


def test_modes_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "out")
    one = spark.createDataFrame([("x", '{"b": [1, {"c": "é"}]}')], "name string, document string")
    write_documents(one, path)
    write_documents(one.withColumn("name", F.lit("y")), path, "append")
    assert sorted(os.listdir(path)) == ["_SUCCESS", "x.json", "y.json"]
    assert open(f"{path}/x.json", encoding="utf8").read() == '{\n  "b": [\n    1,\n    {\n      "c": "é"\n    }\n  ]\n}\n'
    write_documents(one.limit(0), path)
    assert os.listdir(path) == ["_SUCCESS"]
