"""Incremental pack profile over landed JSONL files (availableNow trigger,
memory sink, checkpoint under pytest's tmp_path)."""

import json

from evalpack.streaming import signals


def test_incremental_profile(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "thin.jsonl").write_text(json.dumps({"caseId": "thin-1", "input": "hello"}) + "\n\n")
    rows = [{"caseId": f"c{i}", "note": "plain"} for i in range(20)] + [{"caseId": "late", "rubric": {"x": 1}, "note": "checker"}]
    (land / "late.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n{bad\n")
    signals.run_once(spark, str(land), str(tmp_path / "ckpt"), "pack_signals_t1")
    got = {r["pack"]: r for r in spark.sql("SELECT * FROM pack_signals_t1").collect()}
    assert got["thin"]["case_count"] == 1 and got["thin"]["completeness"] == 0.1892
    assert got["late"]["case_count"] == 21
    assert "rubric" in got["late"]["present"].split(",")           # field branch: all rows
    assert "checker" in got["late"]["present"].split(",")          # pattern branch: all rows as well
