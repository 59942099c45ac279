"""Registered queries against their SQL, and the record operators on a small fixture."""

import glob
import json
import os
import random
from collections import Counter

import duckdb
import pandas as pd
import pytest

from shardlake.operators import graph, query
from shardlake.plans import analytics, outcomes, records, surfaces, tables  # noqa: F401 - they register their queries
from shardlake.sources.records import read_records as load

SF = "/root/testdata/sf0.001"


def rows(frame):
    cols = sorted(frame.columns)
    show = lambda v: "null" if v is None or v is pd.NA or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", list(analytics.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got, want = rows(analytics.QUERIES[name](spark, SF).toPandas()), rows(con.execute(analytics.SQL[name]).df())
    assert got == want and got


@pytest.fixture
def records(spark, tmp_path):
    face = lambda **x: x
    pieces = [
        {"fragment_id": "P1", "bounding": {"obb_dims_mm": [900, 600, 550], "mass_kg_est": 100.0}, "planarity": [face(features=["a"], fit_rms_mm=1.0, contiguous_area_m2=0.5), face(fit_rms_mm=0, area_m2_est=9.0, adjacent_features=["b"])]},
        {"fragment_id": "P2", "bounding": {"obb_dims_mm": [900, 600, 300], "mass_kg_est": 200.0}, "planarity": [face(surface_label="b", scan_reliable=False)]},
        {"fragment_id": "P3", "bounding": {"obb_dims_mm": [1, 1, 1]}},
    ]
    for k, p in enumerate(pieces):
        (tmp_path / f"{k}.json").write_text(json.dumps(p))
    (tmp_path / "bad.json").write_text("{")
    return load(spark, str(tmp_path))


def ids(df):
    return [r.fragment_id for r in df.collect()]


def test_record_queries(records):
    assert sorted(ids(records)) == ["P1", "P2", "P3"]
    assert ids(query.select(records, min_thickness=500, rank_by="mass")) == ["P1"]
    assert ids(query.select(records, min_mass=0, rank_by="mass")) == ["P2", "P1"]
    assert sorted(ids(query.select(records, label="b"))) == ["P1", "P2"]
    assert ids(query.select(records, label="b", reliable_only=True)) == ["P1"]
    assert ids(query.select(records, max_face_rms=2)) == ["P1"]
    assert sorted(ids(query.select(records, min_face_area=0))) == ["P1", "P2", "P3"]
    assert ids(query.select(query.without_surface(records), label="b")) == []
    assert ids(query.select(query.without_surface(records, strip_adjacent=False), label="b")) == ["P1"]
    with pytest.raises(query.UnsupportedQuery):
        query.select(records, rank_by="colour")


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1)], "a long, b long")
    assert {tuple(r) for r in graph.connected_components(e).collect()} == {(1, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)}


def test_components_of_all_edges(spark, tmp_path):
    rng = random.Random(3)
    lines = [(o, rng.randrange(60), float(rng.choice((1, 2, 50))), rng.choice("ARN")) for o in range(80) for _ in range(rng.choice((1, 1, 2)))]
    lines += [(1000 + k, 7, 2.0, "N") for k in range(300)] + [(2000 + k // 2, 2000 + (k + 1) // 2, 2.0, "A") for k in range(60)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for o, p, *_ in lines:
        x, y = find(o * 2), find(p * 2 + 1)
        root[max(x, y)] = min(x, y)
    got = [tuple(r) for r in analytics.QUERIES["connected_components"](spark, str(tmp_path)).collect()]
    assert len(got) == len(root) and set(got) == {(x, find(x)) for x in root}


def test_null_model_answers_two_labels(spark, tmp_path):
    """Against the counting of the reference; rows that tie, lack a label or lack both."""
    cases = [
        [(1, 1, 0), (2, 1, 0), (3, 0, 0), (4, 0, 1), (5, None, 1), (6, None, None), (7, 1, None)],
        [(3, 1, 1), (1, 0, 0), (2, 1, 0), (4, 0, 1)],
        [(1, 1, None), (2, None, None)],
        [],
    ]
    for k, data in enumerate(cases):
        spark.createDataFrame(data, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        truth = [[f"{n}_{v}" for n, v in (("quality", q), ("toxic", x)) if v is not None] for _, q, x in sorted(data)]
        truth = [x for x in truth if x]
        g = {f for f, _ in Counter(f for x in truth for f in x).most_common(2)}
        tp, fp, fn = (sum(len(f(set(x))) for x in truth) for f in (lambda x: g & x, lambda x: g - x, lambda x: x - g))
        want = (tp, fp, fn, tp / (tp + fn) if tp + fn else 0.0, tp / (tp + fp) if tp + fp else 0.0)
        assert [tuple(r) for r in analytics.QUERIES["null_model"](spark, f"{tmp_path}/{k}").collect()] == [want]
        con = duckdb.connect()
        con.execute(f"create view labels as select * from read_parquet('{tmp_path}/{k}/labels.parquet/*.parquet')")
        assert con.execute(analytics.SQL["null_model"]).fetchall() == [want]
