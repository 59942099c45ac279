"""Registered queries of withheld outcomes, region rules, unscanned sides, kept fields and refreshes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardlake.operators import design, geometry, views
from shardlake.operators.graph import own
from shardlake.plans.analytics import query
from shardlake.plans.records import _BASE, _REGIONS, _USES, RULES, records, with_regions
from shardlake.sources.refresh import refresh

WITHHELD = RULES | {
    "finishing_requirement": {"rules": [{"if_anomaly": "rust", "requirement": "clean", "note": "rusty"}, {"if_assignment": "show_face", "max_fit_rms_mm": 5.0, "requirement": "polish", "note": "seen"}, {"requirement": "none", "note": "rest"}]},
    "drill_zone": {"cover_mm_assumed": 20, "bar_dia_mm_assumed": 12, "edge_normal_tol_deg": 35, "rules": [{"if_any_face_label": "rust", "zone": "avoid", "note": "rusty"}, {"min_clear_core_mm": 10, "zone": "edge_mid_depth", "note": "thick"}, {"zone": "none", "note": "thin"}]},
}
_AXES = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]


def turned(t) -> DataFrame:
    """Records whose faces look along the three axes in turn; records of even ids have an unscanned side below."""
    axes = F.array(*[F.array(*map(F.lit, a)) for a in _AXES])
    faces = F.transform("planarity", lambda f, i: f.withField("normal_xyz", F.get(axes, i % 3)))
    r = records(t).withColumn("planarity", faces).withColumn("bounding", F.col("bounding").withField("obb_axes_xyz", axes))
    side = F.when(F.col("fragment_id").cast("long") % 2 == 0, F.array(*map(F.lit, _AXES[2])))
    return r.withColumn("scan_coverage", F.struct(F.lit(True).alias("has_unscanned_face"), side.alias("unscanned_avg_normal")))


@query(_BASE + """SELECT id AS fragment_id, i AS face, CASE WHEN rust THEN 'clean' WHEN asg = 2 AND rms <= 5 THEN 'polish' ELSE 'none' END AS requirement, CASE WHEN rust THEN 'rusty' WHEN asg = 2 AND rms <= 5 THEN 'seen' ELSE 'rest' END AS rule FROM c JOIN g USING (id)""")
def treatments(t):
    done = design.derive(records(t), WITHHELD, publish=True, only=("design_assignment", "finishing_requirement"), reasons=False)
    f = done.select("fragment_id", F.posexplode("planarity").alias("i", "f"))
    return f.select("fragment_id", (F.col("i") + 1).cast("long").alias("face"), F.col("f.procedural.finishing_requirement.value").alias("requirement"), F.col("f.procedural.finishing_requirement.rule").alias("rule"))


@query(_BASE + """, r AS (SELECT id, bool_or(rust) AS rust, string_agg((i - 1)::VARCHAR, ',' ORDER BY i) FILTER ((i - 1) % 3 <> 2) AS edge FROM f GROUP BY 1),
    z AS (SELECT g.id, thick - 64 AS core, edge, CASE WHEN coalesce(rust, false) THEN 'avoid' WHEN thick - 64 >= 10 THEN 'edge_mid_depth' ELSE 'none' END AS zone FROM g LEFT JOIN r USING (id))
    SELECT id AS fragment_id, zone, CASE zone WHEN 'avoid' THEN 'rusty' WHEN 'none' THEN 'thin' ELSE 'thick' END AS rule, round(core, 1) AS core, CASE WHEN zone = 'edge_mid_depth' THEN edge END AS entry FROM z""")
def drill_zones(t):
    z = F.col("procedural.drill_zone")
    done = design.derive(turned(t), WITHHELD, publish=True, only=("drill_zone",))
    return done.select("fragment_id", z["value"].alias("zone"), z["rule"].alias("rule"), z["clear_core_mm_est"].alias("core"), F.array_join(F.transform(z["entry_faces"], lambda i: i.cast("string")), ",").alias("entry"))


@query(_BASE + """SELECT id AS fragment_id, i AS face, CASE WHEN id::BIGINT % 2 = 0 THEN CASE WHEN (i - 1) % 3 = 2 THEN 0.0::DOUBLE ELSE 90.0::DOUBLE END END AS angle, CASE WHEN id::BIGINT % 2 = 0 THEN (i - 1) % 3 <> 2 ELSE rel END AS reliable FROM f JOIN g USING (id)""")
def unscanned_angles(t):
    f = design.flag_unscanned(turned(t)).select("fragment_id", F.posexplode("planarity").alias("i", "f"))
    return f.select("fragment_id", (F.col("i") + 1).cast("long").alias("face"), F.round("f.angle_to_unscanned_deg", 6).alias("angle"), F.coalesce("f.scan_reliable", F.lit(True)).alias("reliable"))


@query(_REGIONS + """SELECT id AS fragment_id, 'lit' AS use, string_agg(i::VARCHAR, ',' ORDER BY i) AS regions FROM r JOIN g USING (id) WHERE q > 10 AND flag = 'A' GROUP BY id""")
def region_rules(t):
    """A rule without an RMS bound is met by regions too; the same with a bound by faces alone, and no face has the label."""
    rule = {"labels": ["seen A"]}
    rules = {"_status": "example", "use_suggestions": {"rules": [{"id": "lit", "requires_face": rule}, {"id": "flat", "requires_face": rule | {"max_fit_rms_mm": 9.0}}]}}
    u = design.derive(with_regions(t), rules, only=("use_suggestions",)).select("fragment_id", F.explode("procedural.use_suggestions").alias("u"))
    return u.select("fragment_id", F.col("u.id").alias("use"), F.array_join(F.transform("u.regions", lambda i: i.cast("string")), ",").alias("regions"))


@query("""SELECT printf('%012d', l_orderkey) AS fragment_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_extendedprice) DESC) AS place, floor(l_extendedprice) / 100 AS hull FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def planes_by_area(t):
    p = records(t).select("fragment_id", F.posexplode(geometry.sorted_planes(F.col("planarity"))).alias("i", "p"))
    return p.select("fragment_id", (F.col("i") + 1).cast("long").alias("place"), F.col("p.area_m2_est").alias("hull"))


@query(_REGIONS + """SELECT id AS fragment_id, i AS region_id, CASE WHEN plane THEN 'plane' ELSE 'cluster' END AS kind, q / 100 AS area_frac, CASE WHEN q > 10 THEN 1 ELSE 0 END::BIGINT AS n_features, 16::BIGINT AS fields FROM r JOIN g USING (id)""")
def kept_regions(t):
    r = with_regions(t).select("fragment_id", F.explode(F.transform("vision.regions", lambda x: views.kept_region(x))).alias("r"))
    return r.select("fragment_id", F.col("r.region_id").cast("long").alias("region_id"), "r.kind", "r.area_frac", F.col("r.n_features").cast("long").alias("n_features"), F.lit(len(r.schema["r"].dataType.fields)).cast("long").alias("fields"))


@query(_BASE + _USES + """, n AS (SELECT g.id, g.id::BIGINT % 97 = 0 AS gone, coalesce(string_agg(use, ',' ORDER BY k), '') AS had, bool_or(use = 'show') AS shown, bool_or(use = 'cut') AS cut FROM g LEFT JOIN u USING (id) WHERE g.id::BIGINT % 97 = 0 OR g.id::BIGINT % 50 = 0 GROUP BY 1)
    SELECT id AS fragment_id, CASE WHEN gone THEN 'removed' ELSE 'changed' END AS state, CASE WHEN NOT gone AND NOT coalesce(cut, false) AND NOT EXISTS (SELECT 1 FROM f WHERE f.id = n.id AND area >= 40) THEN 'cut' ELSE '' END AS added,
    CASE WHEN gone THEN had WHEN coalesce(shown, false) THEN 'show' ELSE '' END AS gone, CASE WHEN NOT gone THEN CASE WHEN longest > 1400 THEN 'excavator' ELSE 'manual' END END AS handling FROM n JOIN g USING (id)""")
def refresh_changed(t):
    """A store of all records, brought up to records of which some have lost their mass and others are gone."""
    r = records(t)
    store = own(r.sparkSession, "store")
    derive = lambda rows, rules: design.derive(rows, rules, only=("handling_class", "use_suggestions"))
    refresh(r, store, RULES, derive)
    number = F.col("fragment_id").cast("long")
    mass = F.when(number % 50 == 0, 0.0).otherwise(F.col("bounding.mass_kg_est"))
    later = r.filter(number % 97 != 0).withColumn("bounding", F.col("bounding").withField("mass_kg_est", mass))
    got = refresh(later, store, RULES, derive)
    return got.select("fragment_id", "state", F.array_join("added", ",").alias("added"), F.array_join("gone", ",").alias("gone"), "handling")
