"""Registered queries of the record operators, over records built from the star schema: an order is a record, its lines are its faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shardlake.operators import design, views
from shardlake.operators import query as ask
from shardlake.plans.analytics import query
from shardlake.sources.records import SCHEMA

#: Order of an order's lines: all columns, as line numbers repeat; that of their structs below.
LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

RULES = {
    "_status": "example",
    "handling_class": {"rules": [{"max_mass_kg": 2500, "class": "manual", "note": "one person"}, {"max_mass_kg": 9000, "class": "two_person", "note": "a team"}, {"max_mass_kg": None, "class": "excavator", "note": "a machine"}], "max_manual_dim_mm": 1400, "max_dim_note": "too long"},
    "connection_strategy": {"rules": [{"if_scan_reliable": False, "strategy": "gravity_only", "note": "not seen"}, {"max_fit_rms_mm": 3.0, "min_area_m2": 20, "strategy": "direct_bolt", "note": "flat"}, {"max_fit_rms_mm": 7.0, "strategy": "bracket", "note": "fair"}, {"strategy": "gravity_only", "note": "rough"}]},
    "design_assignment": {"rules": [{"if_scan_reliable": False, "assignment": "buried", "note": "not seen"}, {"if_label": ["A", "brick"], "assignment": "show_face", "note": "seen"}, {"if_label": ["F"], "min_area_m2": 25, "max_fit_rms_mm": 6.0, "assignment": "seat_face", "note": "flat"}, {"assignment": "unassigned", "note": "none"}]},
    "use_suggestions": {"rules": [
        {"id": "bench", "label": "Bench", "requires_face": {"min_area_m2": 45, "max_fit_rms_mm": 4.0}, "requires_fragment": {"height_band_mm": [300, 520]}},
        {"id": "show", "label": "Show", "requires_face": {"labels": ["brick"], "exclude_labels": ["N"]}, "requires_fragment": {"min_mass_kg": 1000, "max_aspect_ratio": 30}},
        {"id": "rust", "label": "Rust", "requires_face": {"requires_anomaly": "rust", "scan_reliable": True, "min_area_m2": 30}},
        {"id": "cut", "label": "Cut", "requires_no_face": {"min_area_m2": 40}, "requires_fragment": {"max_mass_kg": 20000}},
    ]},
}


def typed(kind, /, **fields: Column) -> Column:
    """A struct of a type: the given fields, the others null."""
    return F.struct(*[(fields[f.name] if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])


#: Columns of a line in its order's array.
_HELD = {"number": "l_linenumber", "part": "l_partkey", "supplier": "l_suppkey", "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "flag": "l_returnflag", "status": "l_linestatus", "date": "l_shipdate"}


def _orders(t) -> DataFrame:
    """Orders with their lines in order, as slim structs: faces and regions are built from them after the shuffle, with all their empty fields.

    They are grouped and joined by fragment_id, so that what is joined by it later does not move them again. Lines are dealt out before they are
    grouped: before the shuffle an order's name on every line would only fill the memory of its sort.
    """
    named = lambda key: F.format_string("%012d", key)
    dealt = t("lineitem").filter("l_orderkey is not null").select("l_orderkey", *_HELD.values()).repartition(named("l_orderkey"))
    held = F.struct(*[F.col(c).alias(n) for n, c in _HELD.items()])
    lines = dealt.groupBy(named("l_orderkey").alias("_of")).agg(F.array_sort(F.collect_list(held)).alias("lines"))
    orders = t("orders").select(named("o_orderkey").alias("fragment_id"), "o_custkey", "o_totalprice")
    return orders.join(lines, F.col("fragment_id") == F.col("_of"), "left")


def _records(orders: DataFrame, vision=None) -> DataFrame:
    kind = StructType.fromDDL(SCHEMA)
    face = kind["planarity"].dataType.elementType
    line = lambda x: typed(
        face, area_m2_est=F.floor(x["price"]) / 100, contiguous_area_m2=F.when(x["tax"] > 0.02, x["quantity"]), fit_rms_mm=F.round(x["discount"] * 100) + 0.0,
        scan_reliable=F.when(x["tax"] >= 0.01, x["tax"] < 0.07), surface_label=x["flag"],
        features=F.when(x["part"] % 11 == 0, F.array(x["status"], F.lit("brick"))).otherwise(F.array(x["status"])),
        adjacent_features=F.when(x["part"] % 7 == 0, F.array(F.lit("brick"))), anomalies=F.when(x["supplier"] % 3 == 0, F.array(F.struct(F.lit("rust").alias("label")))))
    dims = F.array(F.floor(F.col("o_totalprice") / 100).cast("double"), F.lit(500.0), (F.col("o_custkey") % 97 + 1).cast("double"))
    made = {"bounding": typed(kind["bounding"].dataType, obb_dims_mm=dims, mass_kg_est=F.floor("o_totalprice") / 10), "planarity": F.transform("lines", line)}
    if vision is not None:
        made["vision"] = vision(kind["vision"].dataType)
    # a generator of one row: what later steps ask of the faces does not build them again
    once = orders.select("fragment_id", F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("_r"))
    return once.select("fragment_id", *[(F.col(f"_r.{f.name}") if f.name in made else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields[1:]])


def records(t) -> DataFrame:
    return _records(_orders(t))


_BASE = f"""WITH f AS (SELECT printf('%012d', l_orderkey) AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE)}) AS i,
    coalesce(CASE WHEN l_tax > 0.02 THEN l_quantity END, floor(l_extendedprice) / 100) AS area, round(l_discount * 100) AS rms, coalesce(CASE WHEN l_tax >= 0.01 THEN l_tax < 0.07 END, true) AS rel,
    l_returnflag AS flag, l_linestatus AS status, l_partkey % 11 = 0 AS brick, l_partkey % 7 = 0 AS near, l_suppkey % 3 = 0 AS rust FROM lineitem),
o AS (SELECT printf('%012d', o_orderkey) AS id, floor(o_totalprice) / 10 AS mass, floor(o_totalprice / 100) AS long, (o_custkey % 97 + 1)::DOUBLE AS thin FROM orders),
g AS (SELECT *, least(long, 500, thin) AS thick, greatest(long, 500, thin) AS longest FROM o),
c AS (SELECT *, CASE WHEN NOT rel THEN 1 WHEN rms <= 3 AND area >= 20 THEN 2 WHEN rms <= 7 THEN 3 ELSE 4 END AS con, CASE WHEN NOT rel THEN 1 WHEN flag = 'A' OR brick THEN 2 WHEN status = 'F' AND area >= 25 AND rms <= 6 THEN 3 ELSE 4 END AS asg FROM f)
"""
_IDX = "string_agg('region ' || i, ', ' ORDER BY i)"


def _why(df: DataFrame) -> DataFrame:
    return df.select("fragment_id", "why")


@query(_BASE + f""", m AS (SELECT id, {_IDX} AS places FROM f WHERE (flag = 'R' OR status = 'R') AND area >= 40 AND rel GROUP BY id)
    SELECT id AS fragment_id, mass, places || '; ' || round_even(mass, 0)::BIGINT || ' kg' AS why FROM g JOIN m USING (id) WHERE mass >= 1000 ORDER BY mass DESC, id LIMIT 10""")
def select_conjunction_topk(t):
    got = ask.select(records(t), label="R", min_face_area=40, reliable_only=True, min_mass=1000, rank_by="mass", top_k=10)
    return got.select("fragment_id", F.col("bounding.mass_kg_est").alias("mass"), "why")


@query(_BASE + "SELECT id AS fragment_id FROM g WHERE EXISTS (SELECT 1 FROM c WHERE c.id = g.id AND con = 2) AND EXISTS (SELECT 1 FROM c WHERE c.id = g.id AND asg = 3)")
def independent_any_faces(t):
    return ask.select(design.derive(records(t), RULES, only=("connection_strategy", "design_assignment"), reasons=False), connection="direct_bolt", assignment="seat_face").select("fragment_id")


@query(_BASE + f"SELECT id AS fragment_id, {_IDX} AS why FROM f WHERE flag = 'A' GROUP BY id")
def face_index_list(t):
    return _why(ask.select(records(t), label="A"))


@query(_BASE + f""", h AS (SELECT id, {_IDX} FILTER (brick) AS own, {_IDX} FILTER (near) AS adj FROM f WHERE rms <> 0 AND rms <= 6 GROUP BY id)
    SELECT id AS fragment_id, coalesce(own, 'on a surface meeting ' || adj) AS why FROM h JOIN g USING (id) WHERE own IS NOT NULL OR adj IS NOT NULL""")
def own_then_fallback(t):
    return _why(ask.select(records(t), label="brick", max_face_rms=6))


@query(_BASE + f""", m AS (SELECT id, {_IDX} AS places FROM f WHERE rust AND rel GROUP BY id), a AS (SELECT id, max(area) AS area FROM f GROUP BY id)
    SELECT id AS fragment_id, places AS why FROM m JOIN g USING (id) JOIN a USING (id) WHERE thick BETWEEN 20 AND 80 ORDER BY area DESC, id LIMIT 25""")
def anomaly_rank_area(t):
    return _why(ask.select(records(t), anomaly="rust", reliable_only=True, min_thickness=20, max_thickness=80, rank_by="area", top_k=25))


@query(_BASE + "SELECT id AS fragment_id, thick AS thickness FROM g WHERE mass <= 12000 AND (longest > 1400 OR mass > 9000) ORDER BY thickness DESC, id LIMIT 40")
def handling_rank_thickness(t):
    got = ask.select(design.derive(records(t), RULES, only=("handling_class",)), handling="excavator", max_mass=12000, rank_by="thickness", top_k=40)
    return got.select("fragment_id", F.array_min("bounding.obb_dims_mm").alias("thickness"))


@query(_BASE + "SELECT id AS fragment_id, count(f.i) AS faces FROM g LEFT JOIN f USING (id) GROUP BY id ORDER BY faces DESC, id LIMIT 15")
def rank_faces(t):
    got = ask.select(records(t), rank_by="faces", top_k=15)
    return got.select("fragment_id", F.greatest(F.size("planarity"), F.lit(0)).cast("long").alias("faces"))


@query(_BASE + """SELECT id AS fragment_id, CASE WHEN longest > 1400 OR mass > 9000 THEN 'excavator' WHEN mass <= 2500 THEN 'manual' ELSE 'two_person' END AS value,
    'handling_class#' || CASE WHEN longest > 1400 THEN 0 WHEN mass <= 2500 THEN 1 WHEN mass <= 9000 THEN 2 ELSE 3 END AS rule,
    CASE WHEN longest > 1400 THEN 'longest dimension ' || longest::BIGINT || ' mm exceeds 1400 mm' WHEN mass <= 2500 THEN printf('mass %.1f kg <= 2500', mass) WHEN mass <= 9000 THEN printf('mass %.1f kg <= 9000', mass)
    ELSE printf('estimated mass %.1f kg, above every band', mass) END AS reason FROM g""")
def banded_override(t):
    h = F.col("procedural.handling_class")
    return design.derive(records(t), RULES, only=("handling_class",)).select("fragment_id", h["value"].alias("value"), h["rule"].alias("rule"), h["reason"].alias("reason"))


def _outcomes(t, name: str) -> DataFrame:
    """Outcomes of faces in their stored form: (fragment_id, face, value, rule, note, reason)."""
    one = F.posexplode("planarity").alias("face", "f")
    return design.derive(records(t), RULES, only=(name,)).select("fragment_id", one).select("fragment_id", (F.col("face") + 1).cast("long").alias("face"), *[F.col(f"f.procedural.{name}.{c}").alias(c) for c in ("value", "rule", "note", "reason")])


@query(_BASE + """SELECT id AS fragment_id, i AS face, ['gravity_only', 'direct_bolt', 'bracket', 'gravity_only'][con] AS value, 'connection_strategy#' || con AS rule, ['not seen', 'flat', 'fair', 'rough'][con] AS note,
    CASE con WHEN 1 THEN 'face scan_reliable = False' WHEN 2 THEN printf('area %.3f m2 >= 20; RMS %.2f mm <= 3.0', area, abs(rms)) WHEN 3 THEN printf('RMS %.2f mm <= 7.0', abs(rms)) ELSE 'default rule, no condition tested' END AS reason FROM c JOIN g USING (id)""")
def connection_outcomes(t):
    return _outcomes(t, "connection_strategy")


@query(_BASE + """, l AS (SELECT *, array_to_string(list_sort(list_filter([flag, status, CASE WHEN brick THEN 'brick' END], lambda x: x IS NOT NULL)), ', ') AS labels FROM c)
    SELECT id AS fragment_id, i AS face, ['buried', 'show_face', 'seat_face', 'unassigned'][asg] AS value, 'design_assignment#' || asg AS rule, ['not seen', 'seen', 'flat', 'none'][asg] AS note,
    CASE asg WHEN 1 THEN 'face scan_reliable = False' WHEN 2 THEN 'feature ' || labels WHEN 3 THEN printf('area %.3f m2 >= 25; RMS %.2f mm <= 6.0; feature ', area, abs(rms)) || labels ELSE 'default rule, no condition tested' END AS reason FROM l JOIN g USING (id)""")
def first_match_label_sets(t):
    return _outcomes(t, "design_assignment")


_USES = """, u AS (SELECT g.id, 1 AS k, 'bench' AS use, string_agg((i - 1)::VARCHAR, ',' ORDER BY i) AS faces FROM g JOIN f USING (id) WHERE area >= 45 AND rms <= 4 AND (long BETWEEN 300 AND 520 OR 500 BETWEEN 300 AND 520 OR thin BETWEEN 300 AND 520) GROUP BY g.id
    UNION ALL SELECT g.id, 2, 'show', string_agg((i - 1)::VARCHAR, ',' ORDER BY i) FROM g JOIN f USING (id) WHERE brick AND flag <> 'N' AND mass >= 1000 AND longest / thick <= 30 GROUP BY g.id
    UNION ALL SELECT g.id, 3, 'rust', string_agg((i - 1)::VARCHAR, ',' ORDER BY i) FROM g JOIN f USING (id) WHERE rust AND rel AND area >= 30 GROUP BY g.id
    UNION ALL SELECT g.id, 4, 'cut', '' FROM g WHERE mass <= 20000 AND NOT EXISTS (SELECT 1 FROM f WHERE f.id = g.id AND area >= 40))
"""


@query(_BASE + _USES + "SELECT id AS fragment_id, k AS rank, use, faces FROM u")
def use_rules_exists_notexists(t):
    u = design.derive(records(t), RULES, only=("use_suggestions",)).select("fragment_id", F.explode("procedural.use_suggestions").alias("u"))
    rank = F.array_position(F.array(*[F.lit(r["id"]) for r in RULES["use_suggestions"]["rules"]]), F.col("u.id")).cast("int")
    return u.select("fragment_id", rank.alias("rank"), F.col("u.id").alias("use"), F.array_join(F.transform("u.faces", lambda i: i.cast("string")), ",").alias("faces"))


@query(_BASE + _USES + "SELECT id AS fragment_id, '' AS added, string_agg(use, ',' ORDER BY k) AS removed FROM u WHERE use IN ('show', 'rust') GROUP BY id")
def ablation_rederive_diff(t):
    """Uses that go when what was seen on surfaces is withheld: those whose rules ask for labels or anomalies."""
    whole = design.derive(records(t), RULES, only=("use_suggestions",))
    both = design.use_changes(whole, design.geometry_only(whole, RULES, only=("use_suggestions",))).filter("size(added) + size(removed) > 0")
    return both.select("fragment_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query(_BASE + _USES + """, l AS (SELECT id, string_agg(['Bench', 'Show', 'Rust', 'Cut'][k], ', ' ORDER BY k) AS uses FROM u GROUP BY id) SELECT id AS fragment_id, coalesce(uses, '(none)') AS uses FROM g LEFT JOIN l USING (id)""")
def list_uses(t):
    return ask.list_uses(design.derive(records(t), RULES, only=("use_suggestions",)))


@query(_BASE + _USES + "SELECT use, min(['Bench', 'Show', 'Rust', 'Cut'][k]) AS label, count(DISTINCT id) AS records FROM u GROUP BY use")
def use_options(t):
    return ask.use_options(design.derive(records(t), RULES, only=("use_suggestions",)))


@query(_BASE + f""", x AS (SELECT id, {_IDX} AS places FROM u_show GROUP BY id) SELECT id AS fragment_id, 'use show via ' || places AS why FROM x""".replace("x AS", "u_show AS (SELECT g.id, i FROM g JOIN f USING (id) WHERE brick AND flag <> 'N' AND mass >= 1000 AND longest / thick <= 30), x AS"))
def select_use(t):
    return _why(ask.select(design.derive(records(t), RULES, only=("use_suggestions",)), use="show"))


@query(_BASE + "SELECT c.id AS fragment_id, count(*) AS faces, count(DISTINCT asg) AS kinds, count(*) FILTER (asg = 2) AS shown FROM c JOIN g USING (id) GROUP BY 1")
def assignment_counts(t):
    a = F.transform("planarity", lambda f: f["procedural"]["design_assignment"]["value"])
    d = design.derive(records(t), RULES, only=("design_assignment",)).filter(F.size("planarity") > 0)
    return d.select("fragment_id", F.size(a).cast("long").alias("faces"), F.size(F.array_distinct(a)).cast("long").alias("kinds"), F.size(F.filter(a, lambda x: x == "show_face")).cast("long").alias("shown"))


# ---- regions of records: every line is a region too, of the plane kind on its own face, or off all faces

_REGIONS = _BASE + """, r AS (SELECT printf('%012d', l_orderkey) AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {line}) - 1 AS i, l_tax > 0.03 AS plane, l_returnflag AS flag, l_linestatus AS status, l_quantity AS q, l_partkey % 11 = 0 AS brick, l_discount AS d, l_tax AS tax FROM lineitem),
l AS (SELECT id, i, (i + 1) % count(*) OVER (PARTITION BY id) AS face, plane, flag FROM r)
""".replace("{line}", ", ".join(LINE))


def with_regions(t) -> DataFrame:
    """Faces and regions from one grouping of the lines."""

    def vision(kind: StructType) -> Column:
        region = kind["regions"].dataType.elementType
        plane = lambda x: x["tax"] > 0.03
        one = lambda x, i: typed(
            region, region_id=i, kind=F.when(plane(x), "plane").otherwise("cluster"), plane_index=F.when(plane(x), i), area_frac=x["quantity"] / 100, smear_frac=F.when(x["discount"] > 0.05, x["discount"]),
            features=F.when(x["quantity"] > 10, F.array(F.struct(F.concat(F.lit("seen "), x["flag"]).alias("id"), F.lit(3).alias("votes")))).otherwise(F.array().cast("array<struct<id:string,votes:int>>")), skipped=F.when(x["quantity"] < 5, "sparse_uv"))
        n = lambda flag: F.size(F.filter("lines", lambda x: x["flag"] == flag))
        cover = F.map_from_entries(F.array(*[F.struct(F.lit(f), n(f)) for f in "ARN"]))
        return F.when(F.col("lines").isNotNull(), typed(kind, regions=F.transform("lines", one), label_coverage=cover))

    return _records(_orders(t), vision)


@query(_BASE + """SELECT id AS fragment_id, i AS face, printf('%.3f', area) AS surface, abs(rms) AS rms, ['gravity_only', 'direct_bolt', 'bracket', 'gravity_only'][con] AS connection, ['buried', 'show_face', 'seat_face', 'unassigned'][asg] AS assignment FROM c JOIN g USING (id)""")
def face_table(t):
    f = views.face_table(design.derive(records(t), RULES, only=("connection_strategy", "design_assignment"), reasons=False))
    return f.select("fragment_id", F.col("face").cast("long").alias("face"), "surface", F.abs("rms").alias("rms"), "connection", "assignment")


@query(_REGIONS + """SELECT id AS fragment_id, i AS region_id, CASE WHEN plane THEN 'plane' ELSE 'cluster' END AS kind, round(q / 100 * 100, 1) AS area_pct, CASE WHEN q > 10 THEN 'seen ' || flag WHEN q < 5 THEN 'sparse_uv' ELSE '-' END AS text, CASE WHEN d > 0.05 THEN d ELSE 0 END AS masked FROM r JOIN g USING (id)""")
def region_table(t):
    return views.region_table(with_regions(t)).withColumn("region_id", F.col("region_id").cast("long"))


@query(_REGIONS + "SELECT id AS fragment_id, i AS face, CASE WHEN plane AND q > 10 THEN 'seen ' || flag ELSE flag END AS text FROM r JOIN g USING (id)")
def region_hover(t):
    return views.hover(with_regions(t)).withColumn("face", F.col("face").cast("long"))


@query(_REGIONS + "SELECT id AS fragment_id, flag AS label, (CASE flag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 999 END)::BIGINT AS place, count(*) / sum(count(*)) OVER (PARTITION BY id) AS share FROM r JOIN g USING (id) GROUP BY 1, 2")
def coverage_bar(t):
    return views.coverage_bar(with_regions(t), ["N", "A"])


@query(_BASE + _USES + """, n AS (SELECT id, count(*) AS n FROM f GROUP BY 1), m AS (SELECT id, count(*) AS n FROM u GROUP BY 1) SELECT id AS fragment_id, mass, long::BIGINT || ' x 500 x ' || thin::BIGINT AS dims, coalesce(n.n, 0) AS faces,
    CASE WHEN longest > 1400 OR mass > 9000 THEN 'excavator' WHEN mass <= 2500 THEN 'manual' ELSE 'two_person' END AS handling, coalesce(m.n, 0) AS uses FROM g LEFT JOIN n USING (id) LEFT JOIN m USING (id)""")
def inventory(t):
    return views.inventory(design.derive(records(t), RULES, only=("handling_class", "use_suggestions")))


@query(_REGIONS + """SELECT id AS fragment_id, i AS face, CASE WHEN plane THEN CASE WHEN q > 10 THEN 'seen ' || flag ELSE '' END ELSE status || CASE WHEN brick THEN ',brick' ELSE '' END END AS features FROM r JOIN g USING (id)""")
def regions_to_faces(t):
    f = views.write_back(with_regions(t)).select("fragment_id", F.posexplode("planarity").alias("i", "f"))
    return f.select("fragment_id", F.col("i").cast("long").alias("face"), F.array_join("f.features", ",").alias("features"))


@query(_REGIONS + """, k AS (SELECT id, face, array_to_string(list_sort(list_distinct(list('seen ' || r.flag) FILTER (NOT r.plane AND r.q > 10))), ',') AS adjacent FROM r JOIN l USING (id, i) GROUP BY 1, 2) SELECT id AS fragment_id, face, coalesce(adjacent, '') AS adjacent FROM k JOIN g USING (id)""")
def link_adjacent(t):
    """Each region meets the next face of its record, the last one the first."""
    rec = with_regions(t)
    n = F.size("planarity")
    links = rec.select("fragment_id", F.explode(F.transform("planarity", lambda f, i: F.struct(i.alias("region_id"), ((i + 1) % n).alias("face")))).alias("x")).select("fragment_id", "x.region_id", "x.face")
    f = views.link_adjacent(rec, links).select("fragment_id", F.posexplode("planarity").alias("i", "f"))
    return f.select("fragment_id", F.col("i").cast("long").alias("face"), F.array_join(F.array_sort("f.adjacent_features"), ",").alias("adjacent"))


@query("SELECT printf('%012d', o_orderkey) AS fragment_id, coalesce(CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 4 = 0 END::VARCHAR, 'none') AS has FROM orders")
def sidecar_join(t):
    rec = records(t)
    kind = rec.schema["scan_coverage"].dataType
    side = t("orders").filter("o_custkey % 2 = 0").select(F.format_string("%012d", "o_orderkey").alias("fragment_id"), typed(kind, has_unscanned_face=F.col("o_custkey") % 4 == 0).alias("scan_coverage"))
    return views.with_sidecar(rec, side).select("fragment_id", F.coalesce(F.col("scan_coverage.has_unscanned_face").cast("string"), F.lit("none")).alias("has"))


@query("SELECT p_type AS fragment_id, p_partkey AS region_id, CASE WHEN p_size % 3 = 0 THEN p_brand END AS label, CASE WHEN p_size % 3 <> 0 THEN CASE WHEN p_size % 3 = 1 THEN 'sparse_uv' ELSE 'not classified' END END AS skipped FROM part")
def region_alignment(t):
    s = F.col("p_size") % 3
    r = t("part").select(F.col("p_type").alias("fragment_id"), F.col("p_partkey").alias("region_id"), F.when(s == 1, "sparse_uv").alias("skipped"))
    return views.aligned(r, t("part").filter(s == 0).select(F.col("p_type").alias("fragment_id"), F.col("p_partkey").alias("region_id"), F.col("p_brand").alias("label")))


@query("""WITH p AS (SELECT p_partkey, p_type AS image, p_partkey * 37 % 1000 AS x, p_size * 13 AS y FROM part) SELECT p_partkey FROM p n WHERE p_partkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM p u WHERE u.p_partkey % 3 = 1 AND u.image = n.image AND abs(u.x - n.x) < 60 AND abs(u.y - n.y) < 60)""")
def tiles_apart(t):
    p = t("part").select("p_partkey", F.col("p_type").alias("image"), (F.col("p_partkey") * 37 % 1000).alias("x"), (F.col("p_size") * 13).alias("y"))
    return views.apart(p.filter("p_partkey % 3 = 0"), p.filter("p_partkey % 3 = 1"), 60).select("p_partkey")
