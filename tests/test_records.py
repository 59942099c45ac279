"""Rules, regions, findings and sources of records on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from shardlake.operators import design, findings, query, regions
from shardlake.sources import records as source

FACTORS = {
    "handling_class": {"rules": [{"max_mass_kg": 25, "class": "manual"}, {"max_mass_kg": 50, "class": "two_person"}, {"max_mass_kg": None, "class": "excavator"}], "max_manual_dim_mm": 800},
    "connection_strategy": {"rules": [{"if_scan_reliable": False, "strategy": "gravity_only"}, {"max_fit_rms_mm": 5.0, "min_area_m2": 0.1, "strategy": "direct_bolt"}, {"strategy": "gravity_only"}]},
    "design_assignment": {"rules": [{"if_label": ["cast", "tile"], "assignment": "show_face"}, {"assignment": "unassigned"}]},
    "use_suggestions": {"rules": [
        {"id": "bench", "label": "Bench", "requires_face": {"min_area_m2": 0.2, "max_fit_rms_mm": 8.0}, "requires_fragment": {"height_band_mm": [380, 520]}},
        {"id": "cut", "label": "Cut", "requires_no_face": {"min_area_m2": 0.2}, "requires_fragment": {"min_mass_kg": 10}},
        {"id": "show", "label": "Show", "requires_face": {"labels": ["cast"]}},
    ]},
}


@pytest.fixture
def records(spark, tmp_path):
    pieces = [
        {"fragment_id": "P1", "bounding": {"obb_dims_mm": [700, 600, 400], "mass_kg_est": 25.0, "obb_axes_xyz": [[1, 0, 0], [0, 1, 0], [0, 0, 1]]}, "scan_coverage": {"unscanned_avg_normal": [0, 0, 2]},
         "planarity": [{"area_m2_est": 9.0, "contiguous_area_m2": 0.3, "fit_rms_mm": 0, "normal_xyz": [0, 0, 1]}, {"area_m2_est": 0.05, "surface_label": "cast", "normal_xyz": [1, 0, 0]}]},
        {"fragment_id": "P2", "bounding": {"obb_dims_mm": [801, 60, 40], "mass_kg_est": 11.5}, "planarity": [{"contiguous_area_m2": 0.0, "area_m2_est": 5.0, "fit_rms_mm": 1.0}],
         "vision": {"regions": [{"region_id": 4, "features": [{"id": "cast", "votes": 3}]}, {"region_id": 5, "features": []}]}},
        {"fragment_id": "P3"},
    ]
    for k, p in enumerate(pieces):
        (tmp_path / f"{k}.json").write_text(json.dumps(p))
    return source.read_records(spark, str(tmp_path))


def test_rules(records):
    got = {r.fragment_id: r for r in design.derive(records, FACTORS).collect()}
    ids = lambda k: [(u.id, u.faces, u.regions) for u in got[k].procedural.use_suggestions]
    assert ids("P1") == [("bench", [0], None), ("show", [1], None)]
    assert ids("P2") == [("cut", [], None), ("show", [], [4])] and ids("P3") == []
    assert [got[k].procedural.handling_class.value for k in ("P1", "P2", "P3")] == ["manual", "excavator", None]
    assert got["P2"].procedural.handling_class.rule == "handling_class#0" and got["P3"].procedural.handling_class.rule is None
    one, two = (f.procedural for f in got["P1"].planarity)
    assert (one.connection_strategy.value, one.connection_strategy.rule, two.connection_strategy.value) == ("direct_bolt", "connection_strategy#2", "gravity_only")
    assert (one.design_assignment.value, two.design_assignment.value) == ("unassigned", "show_face")


def test_traces_and_withheld_outcomes(records):
    got = {r.fragment_id: r for r in design.derive(records, FACTORS, withheld="not safe").collect()}
    one, two = (f.procedural for f in got["P1"].planarity)
    assert (one.connection_strategy.reason, two.connection_strategy.reason) == ("area 0.300 m2 >= 0.1; RMS 0.00 mm <= 5.0", "default rule, no condition tested")
    assert two.design_assignment.reason == "feature cast" and one.design_assignment.note == ""
    assert (one.finishing_requirement.value, one.finishing_requirement.reason, one.finishing_requirement.data_status, one.data_status) == (None, "not safe", "withheld", "proposed")
    assert [got[k].procedural.handling_class.reason for k in ("P1", "P2", "P3")] == ["mass 25.0 kg <= 25", "longest dimension 801 mm exceeds 800 mm", "mass not available"]
    assert [got[k].procedural.faces_evaluated for k in ("P1", "P2", "P3")] == [2, 1, 0]
    again = design.derive(design.derive(records, FACTORS, withheld="not safe"), FACTORS, withheld="not safe").collect()
    assert {r.fragment_id: r for r in again} == got
    rules = {**FACTORS, "drill_zone": {"rules": [{"zone": "any", "note": "n"}]}, "finishing_requirement": {"rules": [{"if_label": "cast", "if_anomaly": "cast", "if_assignment": "show_face", "requirement": "seal", "note": "why"}]}}
    open_ = {r.fragment_id: r for r in design.derive(records, rules, publish=True).collect()}
    assert [f.procedural.finishing_requirement.value for f in open_["P1"].planarity] == [None, "seal"] and open_["P3"].procedural.drill_zone.value == "any"


def test_the_ablation_derives_anew(records):
    whole = design.derive(records, FACTORS)
    bare = {r.fragment_id: r for r in design.geometry_only(whole, FACTORS).collect()}
    assert [[u.id for u in bare[k].procedural.use_suggestions] for k in ("P1", "P2")] == [["bench"], ["cut"]]
    assert bare["P2"].vision is None and bare["P1"].planarity[1].surface_label is None
    assert bare["P1"].planarity[1].procedural.design_assignment.value == "unassigned"


def test_derived_records_answer_queries(records):
    d = design.derive(records, FACTORS)
    assert [(r.fragment_id, r.why) for r in query.select(d, use="bench", min_mass=1).collect()] == [("P1", "use bench via region 1; 25 kg")]
    assert [r.fragment_id for r in query.select(d, connection="direct_bolt", assignment="show_face").collect()] == ["P1"]
    assert [r.fragment_id for r in query.select(d, rank_by="faces").collect()] == ["P1", "P2", "P3"]
    assert [r.fragment_id for r in query.select(d, rank_by="area", top_k=1).collect()] == ["P1"]
    assert [r.uses for r in query.list_uses(d).collect()] == ["Bench, Show", "Cut, Show", "(none)"]
    with pytest.raises(query.UnsupportedQuery):
        query.require_use(d, "boat")
    assert {r.fragment_id: (r.added, r.removed) for r in design.use_changes(records, d).collect()}["P1"] == (["bench", "show"], [])


def test_unscanned_and_edges(records):
    got = {r.fragment_id: r for r in design.flag_unscanned(records).collect()}
    assert [(round(f.angle_to_unscanned_deg), f.scan_reliable) for f in got["P1"].planarity] == [(0, False), (90, True)]
    assert got["P2"].planarity[0].scan_reliable is None
    turned = design.flag_unscanned(records, frame="gltf").filter("fragment_id = 'P1'").first()
    assert [f.scan_reliable for f in turned.planarity] == [True, True]
    assert records.filter("fragment_id = 'P1'").select(design.edge_faces()).first()[0] == [1]
    zone = {"cover_mm_assumed": 20, "bar_dia_mm_assumed": 12, "rules": [{"if_any_face_label": "rebar", "zone": "a"}, {"min_clear_core_mm": 60, "zone": "b"}, {"zone": "c"}]}
    assert [r[0].value for r in records.orderBy("fragment_id").select(design.drill_zone(zone)).collect()] == ["b", "c", "c"]
    edge = {"cover_mm_assumed": 20, "bar_dia_mm_assumed": 12, "rules": [{"min_clear_core_mm": 300, "zone": "edge_mid_depth", "note": "into the edge"}]}
    got = records.orderBy("fragment_id").select(design.drill_zone(edge).alias("z")).collect()
    assert tuple(got[0].z) == ("edge_mid_depth", "into the edge", 336.0, 20.0, [1]) and got[1].z.value is None


def test_sources_round_trip(spark, records, tmp_path):
    out = str(tmp_path / "out")
    source.write_records(records, out)
    assert sorted(r.fragment_id for r in source.read_records(spark, f"{out}/*").collect()) == ["P1", "P2", "P3"]
    assert source.faces(records).count() == 3 and source.regions(records).count() == 2
    (tmp_path / "labels.csv").write_bytes("﻿tile,fragment,true_features\n1,f,\"a， b,a\"\n2,f,none\n3,f,unusable\n4,f,\n".encode())
    assert {r.tile: r.features for r in source.read_labels(spark, str(tmp_path / "labels.csv")).collect()} == {"1": ["a", "b"], "2": []}
    votes = tmp_path / "votes"
    votes.mkdir()
    (votes / "reg_k_run1_x.json").write_text('{"1": {"features": ["a", {"id": "b"}]}, "2": {"label": "x"}}')
    (votes / "reg_k_run2_x.json").write_text("{")
    assert sorted(map(tuple, source.read_votes(spark, str(votes)).collect())) == [("k", 1, 1, "a"), ("k", 1, 1, "b")]


def test_gates(spark):
    rows = [(True, 0.4, 0.1, 0.9), (True, 0.5, 0.1, 0.9), (True, 0.9, 0.2, 0.5), (True, 0.9, 0.3, 0.4), (False, None, None, None), (None, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "p boolean, c double, f double, s double")
    assert [r[0] for r in df.select(regions.skipped(*map(F.col, "pcfs"))).collect()] == ["fragmented_uv", "sparse_uv", "unreliable_texture", None, "no_uv_footprint", "no_uv_footprint"]


def test_region_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (6, 7)], "a long, b long")
    cells = spark.createDataFrame([(1, "r", 1.0, 0), (2, "r", 2.0, 0), (3, "s", 1.0, None), (4, "t", 4.0, 1), (5, "t", None, 1), (6, "r", 9.0, None), (7, "u", 1.0, None)], "cell long, region string, area double, face int")
    assert {tuple(r) for r in regions.patches(cells, edges).collect()} == {("r", 1, 3.0), ("s", 0, 0.0), ("t", 1, 4.0), ("u", 0, 0.0)}
    assert [tuple(r) for r in regions.adjacent(cells, edges).collect()] == [("s", 0, 0.5)]
    lab = spark.createDataFrame([(1, 7), (2, None), (3, None), (4, None), (5, 3), (6, None)], "cell long, label int")
    assert {tuple(r) for r in regions.propagate(lab, edges).collect()} == {(1, 7, False), (2, 7, True), (3, 3, True), (4, 3, True), (5, 3, False), (6, None, False)}
    px = spark.createDataFrame([(1, 5, False), (1, 4, False), (2, 5, True), (2, 5, False), (3, None, None)], "cell int, region int, masked boolean")
    assert {tuple(r) for r in regions.cell_winner(px).collect()} == {(1, 4, False), (2, None, True), (3, None, False)}


def test_findings(spark):
    m = spark.createDataFrame([("a", 10, 1.00001, 0.4), ("b", 10, 1.0, 2.0), ("c", 9, 1.0, None)], "fragment_id string, faces int, volume double, density double")
    dims = lambda x: spark.createDataFrame([("a", x)], "fragment_id string, dims array<double>")
    got = findings.collect(findings.texel_density(m), findings.duplicates(m), findings.drift(dims([10.0, 5.0]), dims([10.0, 4.0]))).collect()
    assert [(r.level, r.fragment_id, r.detail) for r in got] == [("fail", "a", "same as b"), ("fail", "a", "0.40 px/mm"), ("fail", "b", "same as a"), ("warn", "a", "25 % off"), ("warn", "c", "unknown"), ("ok", "b", "2.00 px/mm")]
    r = lambda *x: spark.createDataFrame(list(x), "fragment_id string, region_id int, kind string, area_frac double")
    bad = findings.backfill_violations(r(("a", 0, "plane", 0.5), ("a", 1, "plane", 0.2)), r(("a", 0, "plane", 0.504), ("a", 1, "cluster", 0.2), ("a", 2, "plane", 0.1)))
    assert sorted((x.region_id, x.violation) for x in bad.collect()) == [(1, "kind"), (2, "missing")]
    t = spark.createDataFrame([(0, "a", "rule", None), (1, "b", "", False), (2, "c", "rule", True)], "feature_id int, id string, decision_rule string, retired boolean")
    assert {tuple(x) for x in findings.taxonomy(t, ["a", "c"]).collect()} == {("b", "no decision rule"), ("b", "not in precedence"), ("c", "unknown in precedence")}
