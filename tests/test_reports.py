"""Preflight and agreement on a command line, with their exit status."""

from __future__ import annotations

import json

from shardlake import preflight, reports
from test_describe import box


def test_preflight(spark, tmp_path, capsys):
    for name, dims in (("a", (40, 30, 20)), ("b", (40, 30, 20)), ("c", (5, 4, 3))):
        (tmp_path / name).mkdir()
        box(tmp_path / name / f"{name}.obj", dims)
    stored = tmp_path / "records"
    stored.mkdir()
    (stored / "a_geometry.json").write_text(json.dumps({"fragment_id": "a", "bounding": {"obb_dims_mm": [60.0, 30.0, 20.0]}}))
    assert preflight.main([str(tmp_path), "--records", str(stored)], spark) == 1
    lines = [line.split(None, 2) for line in capsys.readouterr().out.splitlines()]
    assert lines[0][:2] == ["level", "fragment"] and [x[0] for x in lines[1:]] == sorted((x[0] for x in lines[1:]), key=("fail", "warn", "ok").index)
    said = {(x[0], x[1], " ".join(x[2].split())) for x in lines[1:]}
    assert {("fail", "a", "duplicate mesh same as b"), ("fail", "c", "UV coordinates missing"), ("ok", "a", "volume mesh"), ("warn", "a", "identity drift 33 % off"), ("warn", "c", "texel density unknown")} <= said
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "note.txt").write_text("x")
    assert preflight.main([str(empty)], spark) == 1 and "no meshes" in capsys.readouterr().err


def test_agreement_report(spark, tmp_path, capsys):
    for run, features in enumerate((["rust", "paint"], ["rust"], ["rust", "crack"])):
        (tmp_path / f"reg_x_run{run}_1.json").write_text(json.dumps({"1": {"features": features}, "2": {"features": [{"id": "rust"}]}, "3": {"features": ["paint"] if run == 0 else []}}))
    (tmp_path / "reg_y_run0_1.json").write_text(json.dumps({"1": {"features": ["rust"]}}))
    assert reports.main([str(tmp_path), "--markdown"], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[:4] == ["| feature | 3/3 | 2/3 | 1/3 | unanimous |", "| --- | --- | --- | --- | --- |", "| paint | 0 | 0 | 2 | 0% |", "| rust | 2 | 0 | 0 | 100% |"]
    assert "| all | 2 | 0 | 3 | 40% |" in out and "| rust | 2 | 67% |" in out and "| (none) | 1 | 33% |" in out and out[-1].startswith("1 batch")
    assert reports.main([str(tmp_path)], spark) == 0 and capsys.readouterr().out.startswith("feature  3/3")
    lone = tmp_path / "lone"
    lone.mkdir()
    (lone / "reg_y_run0_1.json").write_text(json.dumps({"1": {"features": ["rust"]}}))
    assert reports.main([str(lone)], spark) == 1
