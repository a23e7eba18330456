"""Sources and sinks on small landed fixtures (files under pytest's tmp_path)."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalpack.operators import curate as cu
from evalpack.operators import facts as fx
from evalpack.operators import inventory as inv
from evalpack.sources import files as fs


def test_case_lines_and_quarantine(spark, tmp_path):
    p = tmp_path / "cases.jsonl"
    p.write_text('{"caseId": "a"}\n\n   \n{"caseId": "b", "input": 1}\r\n{bad json}\n{"caseId": "c"}\n')
    good, bad = fs.read_case_lines(spark, str(p), strict=False)
    assert [r["raw"] for r in good.orderBy("seq").collect()] == ['{"caseId": "a"}', '{"caseId": "b", "input": 1}',
                                                                '{"caseId": "c"}']
    assert [r["raw"] for r in bad.collect()] == ["{bad json}"]
    with pytest.raises(fs.BadLinesError, match="non-blank line 3"):
        fs.read_case_lines(spark, str(p), strict=True)


def test_csv_scan_and_round_trip(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('a,b,c\n1,"x, ""y""",z\n2,short\n')
    df = fs.read_csv(spark, str(p))
    rows = [tuple(r) for r in df.orderBy("a").collect()]
    assert rows == [("1", 'x, "y"', "z"), ("2", "short", "")]
    out = tmp_path / "out"
    fs.write_csv(df.coalesce(1), str(out))
    back = fs.read_csv(spark, str(out))
    assert sorted(tuple(r) for r in back.collect()) == rows


def test_jsonl_sink_omits_nulls(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 2)], "caseId string, n int")
    out = tmp_path / "o"
    fs.write_jsonl(df.coalesce(1), str(out))
    lines = [json.loads(x) for f in out.glob("part-*") for x in f.read_text().splitlines()]
    assert sorted(lines, key=lambda d: d["caseId"]) == [{"caseId": "a"}, {"caseId": "b", "n": 2}]


def test_json_document_and_contracts(spark, tmp_path):
    doc = {"id": "t1", "capabilities": {"c1": {"name": "A", "definition": "d", "pass_criteria": ["p"],
                                               "evidence": ["e"], "weight": 2.0},
                                        "c2": {"name": "B", "definition": "d2", "pass_criteria": [],
                                               "evidence": [], "weight": 1.0}}}
    p = tmp_path / "task.json"
    p.write_text(json.dumps(doc, indent=2))
    schema = ("id string, capabilities map<string, struct<name string, definition string, "
              "pass_criteria array<string>, evidence array<string>, weight double>>")
    df = spark.read.schema(schema).option("multiLine", True).json(str(p))
    flat = inv.flatten_contracts(df).orderBy("capability_id").collect()
    assert [(r["task_id"], r["capability_id"], r["weight"]) for r in flat] == [("t1", "c1", 2.0), ("t1", "c2", 1.0)]


def test_file_inventory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text("x" * 3000)
    (tmp_path / "b").write_text("y")
    got = [(r["path"].rsplit("/", 1)[-1], r["type"], r["size_kb"]) for r in fs.file_inventory(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("a.csv", "csv", 3), ("b", "file", 1)]


def test_macro_csv_last_n(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("observation_date,X\n2024-01-01,1.5\n2024-02-01,.\n2024-03-01,\n2024-04-01,2.5\n2024-05-01,abc\n")
    got = fs.read_macro_csv(spark, str(p), "X")
    top = fx.first_n_per_key(got.withColumn("k", F.lit("X")), ["k"], [F.col("pos").desc()], 24)
    assert [(r["date"], r["value"]) for r in top.orderBy("pos").collect()] == [("2024-01-01", 1.5), ("2024-04-01", 2.5)]


def test_batch_inference_stub(spark):
    prompts = spark.createDataFrame([(i, f"case {i}") for i in range(6)], "slot long, user_prompt string")

    def stub(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slot": pdf["slot"], "attempt": 1,
                             "text": [json.dumps({"caseId": f"c{s}"}) for s in pdf["slot"]],
                             "prompt_tokens": 10, "completion_tokens": 20})
    out = cu.batch_inference(prompts, stub, "slot long, attempt int, text string, prompt_tokens long, "
                             "completion_tokens long", partitions=2)
    parsed = out.withColumn("parsed", cu.parse_completion(F.col("text")))
    sel = cu.select_attempts(parsed, ["slot"]).orderBy("slot").collect()
    assert [r["case_id"] for r in sel] == [f"c{i}" for i in range(6)]


def test_report_json(spark, tmp_path):
    df = spark.createDataFrame([(3, 1, "a:json_parse_failed")], "requested long, failed long, failures string")
    out = tmp_path / "report"
    df.select(fs.report_json(df).alias("value")).coalesce(1).write.text(str(out))
    text = next(out.glob("part-*")).read_text()
    assert json.loads(text) == {"requested": 3, "failed": 1, "failures": "a:json_parse_failed"}


def test_capability_grid(spark):
    from evalpack.operators import inventory as inv
    caps = spark.createDataFrame([("A", "x", False), ("B", "x", False), ("C", "y", False), ("D", "y", True), ("A", "x", False)],
                                 "capability string, family string, cross_cutting boolean")
    tasks = spark.createDataFrame([("t1",), ("t2",), ("t2",), ("t3",)], "task string")
    contracts = spark.createDataFrame([("t1", "A", 2), ("t1", "B", 1), ("t2", "A", 1), ("t2", "A", 1), ("t2", "D", 9), ("t1", "Z", 5), ("t9", "A", 5)],
                                      "task string, capability string, evidence long")
    rows = inv.capability_grid(caps, tasks, contracts, strong=2).collect()
    assert len(rows) == 12 and {r.grid_covered for r in rows} == {2}
    cells = {(r.task, r.capability): r.cell for r in rows}
    assert [cells[t, c] for t in ("t1", "t2", "t3") for c in "ABCD"] == [
        "strong", "weak", "none", "cross-cutting", "strong", "none", "none", "cross-cutting", "none", "none", "none", "cross-cutting"]
    assert {r.task: r.task_covered for r in rows} == {"t1": 2, "t2": 1, "t3": 0}
    assert inv.capability_grid(caps, tasks.limit(0), contracts).count() == 0
