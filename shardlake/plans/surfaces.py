"""Registered queries of hulls, boxes, nearest triangles, sampling, pixel rows, loops and spacing, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardlake.operators import describe, geometry, hulls, nearest, planesearch, surface, tiles
from shardlake.plans.analytics import query


@query("""SELECT l_suppkey, round(4 / 3 * pow(max(abs(l_quantity - 25) + abs(round(l_discount * 100)) + abs(round(l_tax * 100) - 4)) + 1, 3), 3) AS hull_volume, 6::BIGINT AS hull_points FROM lineitem GROUP BY 1""")
def hull_volume(t):
    """Clouds of lines within an octahedron around them: its six corners are the hull."""
    p = t("lineitem").select("l_suppkey", (F.col("l_quantity") - 25).cast("double").alias("x"), F.round(F.col("l_discount") * 100).alias("y"), (F.round(F.col("l_tax") * 100) - 4).alias("z"))
    r = p.groupBy("l_suppkey").agg((F.max(F.abs("x") + F.abs("y") + F.abs("z")) + 1).alias("r"))
    ends = F.explode(F.array(*[F.struct(*[F.lit(float(s if c == a else 0)).alias(c) for c in "xyz"]) for a in "xyz" for s in (1, -1)]))
    tips = r.select("l_suppkey", "r", ends.alias("e")).select("l_suppkey", *[(F.col("r") * F.col(f"e.{c}")).alias(c) for c in "xyz"])
    return hulls.bounding_boxes(p.unionByName(tips), "l_suppkey").select("l_suppkey", F.round("hull_volume", 3).alias("hull_volume"), "hull_points")


def _turned(x, y, z, angle):
    """A point turned around the axis (1, 2, 2) / 3."""
    k, v = (1 / 3, 2 / 3, 2 / 3), (x, y, z)
    along = sum(a * b for a, b in zip(v, k))
    side = (v[2] * k[1] - v[1] * k[2], v[0] * k[2] - v[2] * k[0], v[1] * k[0] - v[0] * k[1])
    return [v[i] * F.cos(angle) + side[i] * F.sin(angle) + along * k[i] * (1 - F.cos(angle)) for i in range(3)]


@query("""SELECT p_partkey, (60 + p_size)::DOUBLE AS long, (30 + p_partkey % 20)::DOUBLE AS wide, (5 + p_partkey % 7)::DOUBLE AS thin, ((60 + p_size) * (30 + p_partkey % 20) * (5 + p_partkey % 7))::DOUBLE AS hull_volume, 8::BIGINT AS hull_points FROM part""")
def oriented_box(t):
    """A box a part, turned by an angle of its own, with the part's lines as points inside."""
    side = t("part").select("p_partkey", *[c.cast("double").alias(n) for n, c in (("a", 60 + F.col("p_size")), ("b", 30 + F.col("p_partkey") % 20), ("c", 5 + F.col("p_partkey") % 7), ("angle", F.col("p_partkey") / 10))])
    unit = F.explode(F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("uvw", (i, j, k))]) for i in (0, 1) for j in (0, 1) for k in (0, 1)]))
    corner = side.select("*", unit.alias("e")).select(*side.columns, "e.u", "e.v", "e.w")
    lines = t("lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_quantity") / 51).alias("u"), (F.col("l_discount") * 9 + 0.01).alias("v"), (F.col("l_tax") * 11 + 0.01).alias("w"))
    both = corner.unionByName(side.join(lines, "p_partkey"))
    x = _turned(F.col("u") * F.col("a"), F.col("v") * F.col("b"), F.col("w") * F.col("c"), F.col("angle"))
    got = hulls.bounding_boxes(both.select("p_partkey", *[v.alias(c) for v, c in zip(x, "xyz")]), "p_partkey")
    dim = lambda k: F.round(F.col("obb_dims_mm")[k], 5)
    return got.select("p_partkey", dim(0).alias("long"), dim(1).alias("wide"), dim(2).alias("thin"), F.round("hull_volume", 4).alias("hull_volume"), "hull_points")


_NEAR = """WITH e AS (SELECT vec_id AS id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
t AS (SELECT id AS tri, v[1:3] AS a, v[4:6] AS b, v[7:9] AS c FROM e), p AS (SELECT id, v[10:12] AS p, v[13:15] AS n FROM e),
m AS (SELECT *, [(a[k] + b[k] + c[k]) / 3 FOR k IN [1, 2, 3]] AS m, [b[k] - a[k] FOR k IN [1, 2, 3]] AS ab, [c[k] - a[k] FOR k IN [1, 2, 3]] AS ac, [c[k] - b[k] FOR k IN [1, 2, 3]] AS bc FROM t),
g AS (SELECT *, [ab[2] * ac[3] - ab[3] * ac[2], ab[3] * ac[1] - ab[1] * ac[3], ab[1] * ac[2] - ab[2] * ac[1]] AS w FROM m),
r AS (SELECT p.id, p.p, p.n, g.*, row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.p[1] - m[1]) ** 2 + (p.p[2] - m[2]) ** 2 + (p.p[3] - m[3]) ** 2), tri) AS rank FROM p, g QUALIFY rank <= 12),
s AS (SELECT *, [p[k] - a[k] FOR k IN [1, 2, 3]] AS ap, [p[k] - b[k] FOR k IN [1, 2, 3]] AS bp FROM r),
f AS (SELECT *, list_dot_product(w, n) > 0 AS facing, list_dot_product(ap, w) / list_dot_product(w, w) AS h,
    greatest(0, least(1, list_dot_product(ap, ab) / list_dot_product(ab, ab))) AS s1, greatest(0, least(1, list_dot_product(ap, ac) / list_dot_product(ac, ac))) AS s2, greatest(0, least(1, list_dot_product(bp, bc) / list_dot_product(bc, bc))) AS s3 FROM s),
q AS (SELECT *, [p[k] - h * w[k] - a[k] FOR k IN [1, 2, 3]] AS x, sqrt(list_sum([(ap[k] - s1 * ab[k]) ** 2 FOR k IN [1, 2, 3]])) AS d1, sqrt(list_sum([(ap[k] - s2 * ac[k]) ** 2 FOR k IN [1, 2, 3]])) AS d2, sqrt(list_sum([(bp[k] - s3 * bc[k]) ** 2 FOR k IN [1, 2, 3]])) AS d3 FROM f),
y AS (SELECT *, (list_dot_product(ac, ac) * list_dot_product(x, ab) - list_dot_product(ab, ac) * list_dot_product(x, ac)) / list_dot_product(w, w) AS v1, (list_dot_product(ab, ab) * list_dot_product(x, ac) - list_dot_product(ab, ac) * list_dot_product(x, ab)) / list_dot_product(w, w) AS w1 FROM q),
z AS (SELECT *, CASE WHEN v1 >= 0 AND w1 >= 0 AND v1 + w1 <= 1 THEN abs(h) * sqrt(list_dot_product(w, w)) ELSE least(d1, d2, d3) END AS d FROM y)
SELECT id, round(d, 6) AS distance, facing FROM z QUALIFY row_number() OVER (PARTITION BY id ORDER BY facing DESC, d, rank) = 1"""


@query(_NEAR)
def nearest_triangle(t):
    """Each vector gives a triangle and a point with a normal; every point meets the triangles nearest to it."""
    v = lambda a: F.transform(F.slice("embedding", a, 3), lambda x: x.cast("double"))
    e = t("embeddings")
    tri = e.select(F.col("vec_id").alias("triangle"), v(1).alias("a"), v(4).alias("b"), v(7).alias("c"))
    got = nearest.nearest_triangle(e.select(F.col("vec_id").alias("id"), v(10).alias("p"), v(13).alias("normal")), tri)
    return got.select("id", F.round("distance", 6).alias("distance"), "facing")


_UV = """WITH t AS (SELECT l_orderkey AS image, l_quantity / 50 AS u1, l_discount * 10 AS v1, l_tax * 12 AS u2, (l_partkey % 101) / 100 AS v2, (l_partkey % 67) / 66 AS u3, (l_suppkey % 13) / 12 AS v3 FROM lineitem)"""


def _uv(t):
    c = {"u1": F.col("l_quantity") / 50, "v1": F.col("l_discount") * 10, "u2": F.col("l_tax") * 12, "v2": F.col("l_partkey") % 101 / 100, "u3": F.col("l_partkey") % 67 / 66, "v3": F.col("l_suppkey") % 13 / 12}
    return t("lineitem").select(F.col("l_orderkey").alias("image"), *[x.cast("double").alias(n) for n, x in c.items()])


@query(_UV + """, k AS (SELECT image, {corners} FROM t), g AS (SELECT unnest(range(24)) AS x), y AS (SELECT unnest(range(24)) AS y),
    s AS (SELECT k.*, y.y, {sides} FROM k JOIN y ON y.y BETWEEN least(y1, y2, y3) AND greatest(y1, y2, y3))
    SELECT image, count(DISTINCT y * 24 + x) AS pixels, count(DISTINCT y) AS rows, min(x) AS x_min FROM s, g WHERE x BETWEEN floor(least({low}) + 0.5) AND ceil(greatest({low}) - 0.5) GROUP BY image""".format(
    corners=", ".join(f"floor(greatest(0, least(1, u{k})) * 24)::INT AS x{k}, floor((1 - greatest(0, least(1, v{k}))) * 24)::INT AS y{k}" for k in (1, 2, 3)),
    sides=", ".join(f"CASE WHEN y BETWEEN least(y{p}, y{q}) AND greatest(y{p}, y{q}) THEN CASE WHEN y{p} = y{q} THEN x{e} ELSE x{p} + (y - y{p}) * ((x{q} - x{p})::DOUBLE / (y{q} - y{p})) END END AS c{p}{q}{e}" for p, q in ((1, 2), (2, 3), (3, 1)) for e in (p, q)),
    low=", ".join(f"c{p}{q}{e}" for p, q in ((1, 2), (2, 3), (3, 1)) for e in (p, q))))
def uv_mask(t):
    """Each order an image of 24 by 24 pixels, each line a triangle on it."""
    spans = surface.texture_mask(_uv(t), "image", 24, 24)
    rows = F.bit_count(F.bit_or(F.expr("shiftleft(1L, y)"))).cast("long")  # 24 rows at most, a bit each: tasks send one row an image
    return spans.groupBy("image").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("pixels"), rows.alias("rows"), F.min("x0").cast("long").alias("x_min"))


@query(_UV + """, a AS (SELECT image, sum(abs((u2 - u1) * (v3 - v1) - (u3 - u1) * (v2 - v1)) / 2) AS a FROM t GROUP BY 1)
    SELECT image, round(a, 6) AS uv_area, round(sqrt(a * 1024 * 1024 / o_totalprice), 5) AS density FROM a JOIN orders ON o_orderkey = image""")
def uv_density(t):
    a = surface.uv_area(_uv(t), "image").join(t("orders").select(F.col("o_orderkey").alias("image"), F.col("o_totalprice").alias("area_mm2")), "image")
    return geometry.texel_density(a.withColumn("atlas_px", F.lit(1024))).select("image", F.round("uv_area", 6).alias("uv_area"), F.round("density", 5).alias("density"))


_LOOPS = """WITH RECURSIVE c AS (SELECT p_partkey // 400 AS mesh, p_partkey % 20 AS x, p_partkey % 400 // 20 AS y FROM part WHERE p_size > 12),
q AS (SELECT mesh, y * 21 + x AS a, y * 21 + x + 1 AS b, (y + 1) * 21 + x + 1 AS c, (y + 1) * 21 + x AS d FROM c),
h AS (SELECT mesh, a AS p, b AS q FROM q UNION ALL SELECT mesh, b, c FROM q UNION ALL SELECT mesh, c, d FROM q UNION ALL SELECT mesh, d, a FROM q),
o AS (SELECT mesh, p, q FROM h WHERE NOT EXISTS (SELECT 1 FROM h r WHERE r.mesh = h.mesh AND r.p = h.q AND r.q = h.p)),
n AS (SELECT *, row_number() OVER (PARTITION BY mesh, p ORDER BY q) AS go, row_number() OVER (PARTITION BY mesh, q ORDER BY p) AS come FROM o),
s AS (SELECT i.mesh, i.p * 1000 + i.q AS edge, u.p * 1000 + u.q AS next FROM n i JOIN n u ON u.mesh = i.mesh AND u.p = i.q AND u.go = i.come),
w AS (SELECT mesh, edge AS start, edge, next, 0 AS place FROM s UNION ALL SELECT w.mesh, w.start, s.edge, s.next, w.place + 1 FROM w JOIN s ON s.mesh = w.mesh AND s.edge = w.next WHERE w.next <> w.start),
l AS (SELECT mesh, start, dense_rank() OVER (PARTITION BY mesh ORDER BY start) - 1 AS loop FROM w GROUP BY 1, 2 HAVING min(edge) = start),
z AS (SELECT w.mesh, l.loop, w.place::BIGINT AS place, w.edge // 1000 AS vertex FROM w JOIN l USING (mesh, start))
"""


def _loops(t):
    """A mesh of square cells for every 400 parts; small parts are holes."""
    x, y = F.col("p_partkey") % 20, F.floor(F.col("p_partkey") % 400 / 20)
    at = lambda i, j: (y + j) * 21 + x + i
    two = F.explode(F.array(*[F.struct(*[at(*v).alias(n) for n, v in zip("ijk", c)]) for c in (((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1)))]))
    tri = t("part").filter("p_size > 12").select(F.floor(F.col("p_partkey") / 400).alias("mesh"), two.alias("e")).select("mesh", "e.i", "e.j", "e.k")
    return surface.boundary_loops(tri, "mesh")


@query(_LOOPS + "SELECT mesh, loop, place, vertex FROM z")
def boundary_loops(t):
    return _loops(t)


@query(_LOOPS + """, e AS (SELECT mesh, loop, vertex % 21 AS x, vertex // 21 AS y, coalesce(lead(vertex) OVER o, first(vertex) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS v FROM z WINDOW o AS (PARTITION BY mesh, loop ORDER BY place))
    SELECT mesh || '/' || loop AS ring, sum((x - v % 21) * (y + v // 21))::DOUBLE AS up FROM e GROUP BY 1""")
def loop_normals(t):
    """The normal of each loop around a hole or the rim: twice its signed area, upwards."""
    r = _loops(t).select(F.concat_ws("/", "mesh", "loop").alias("ring"), "place", (F.col("vertex") % 21).cast("double").alias("x"), F.floor(F.col("vertex") / 21).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return geometry.newell(r, "ring", "place").select("ring", F.col("normal")[2].alias("up"))


@query("""WITH a AS (SELECT p_partkey % 20 AS mesh, p_partkey AS face, p_size * (p_size % 7 + 1) * 500000::HUGEINT AS w FROM part),
    c AS (SELECT *, sum(w) OVER (PARTITION BY mesh) AS total, sum(w) OVER (PARTITION BY mesh ORDER BY face) AS top FROM a),
    n AS (SELECT mesh, face, (1000 * top + total - 1) // (2 * total) - (1000 * (top - w) + total - 1) // (2 * total) AS points FROM c) SELECT mesh, face, points::BIGINT AS points, points::BIGINT AS inside FROM n WHERE points > 0""")
def surface_sample(t):
    """500 points on each mesh of flat right triangles; those inside their triangle are counted too."""
    corner = lambda x, y: F.array(*[c.cast("double") for c in (F.lit(0) + x, F.lit(0) + y, F.lit(0))])
    wide, high = F.col("p_size"), F.col("p_size") % 7 + 1
    tri = t("part").select((F.col("p_partkey") % 20).alias("mesh"), F.col("p_partkey").alias("face"), corner(F.lit(0), F.lit(0)).alias("a"), corner(wide, F.lit(0)).alias("b"), corner(F.lit(0), high).alias("c"))
    got = surface.sample(tri, "mesh", 500).join(t("part").select(F.col("p_partkey").alias("face"), "p_size"), "face")
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") / wide + F.col("y") / high <= 1 + 1e-9)
    return got.groupBy("mesh", "face").agg(F.count(F.lit(1)).alias("points"), F.count_if(inside).alias("inside"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey, p_type AS image, p_partkey * 37 % 1000 AS x, p_size * 13 AS y, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS n FROM part),
    g AS (SELECT image, 0::BIGINT AS n, []::STRUCT(k BIGINT, x BIGINT, y BIGINT)[] AS taken FROM p GROUP BY 1
        UNION ALL SELECT p.image, p.n, CASE WHEN len(list_filter(g.taken, lambda s: abs(s.x - p.x) < 150 AND abs(s.y - p.y) < 150)) = 0 THEN list_append(g.taken, {'k': p.p_partkey, 'x': p.x, 'y': p.y}) ELSE g.taken END FROM g JOIN p ON p.image = g.image AND p.n = g.n + 1),
    e AS (SELECT image, unnest(taken, recursive := true) FROM (SELECT image, taken FROM g QUALIFY row_number() OVER (PARTITION BY image ORDER BY n DESC) = 1))
    SELECT image, k AS p_partkey FROM e""")
def tiles_spaced(t):
    p = t("part").select("p_partkey", F.col("p_type").alias("image"), (F.col("p_partkey") * 37 % 1000).alias("x"), (F.col("p_size") * 13).alias("y"), "p_size")
    return surface.spaced(p, "p_partkey", ["p_size"], 150).select("image", "p_partkey")


def _square(source: str, target: str, k: int, every: bool, size: int) -> str:
    """SQL of one pass of a k by k window over cells (image, x, y, on): all of them on (outside is nothing), or any."""
    h = k // 2
    test = f"count(*) FILTER (n.\"on\") = {k * k}" if every else "coalesce(bool_or(n.\"on\"), false)"
    return f"{target} AS (SELECT c.image, c.x, c.y, {test} AS \"on\" FROM {source} c JOIN {source} n ON n.image = c.image AND abs(n.x - c.x) <= {h} AND abs(n.y - c.y) <= {h} GROUP BY ALL)"


_TEXTURE = """WITH RECURSIVE g AS (SELECT i.image, x.x, y.y FROM (SELECT DISTINCT p_partkey // 400 AS image FROM part) i, (SELECT unnest(range(20)) AS x) x, (SELECT unnest(range(20)) AS y) y),
p AS (SELECT g.image, g.x, g.y, CASE WHEN p_partkey IS NULL THEN 0 WHEN g.x < 10 THEN CASE WHEN g.x BETWEEN 3 AND 5 AND g.y BETWEEN 8 AND 11 THEN p_size * 5 ELSE g.x * 20 END WHEN g.y < 12 THEN 100 + p_size % 3 ELSE p_size * 5 END AS v, coalesce(p_size % 17 <> 0, false) AS ok
    FROM g LEFT JOIN part ON p_partkey = g.image * 400 + g.y * 20 + g.x),
d AS (SELECT unnest(range(-1, 2)) AS d),
n AS (SELECT p.image, p.x, p.y, i.d AS dx, j.d AS dy, p.x + i.d AS nx, p.y + j.d AS ny FROM p, d i, d j),
m AS (SELECT image, x, y, dx, dy, CASE WHEN nx < 0 THEN -1 - nx WHEN nx > 19 THEN 39 - nx ELSE nx END AS nx, CASE WHEN ny < 0 THEN -1 - ny WHEN ny > 19 THEN 39 - ny ELSE ny END AS ny FROM n),
e AS (SELECT m.image, m.x, m.y, sum(q.v * m.dx * (2 - abs(m.dy))) AS gx, sum(q.v * m.dy * (2 - abs(m.dx))) AS gy, 9 * sum(q.v * q.v) - sum(q.v) ** 2 AS spread FROM m JOIN p q ON q.image = m.image AND q.x = m.nx AND q.y = m.ny GROUP BY ALL),
t AS (SELECT m.image, m.x, m.y, sum(e.gx * e.gx) AS a, sum(e.gy * e.gy) AS b, sum(e.gx * e.gy) AS c FROM m JOIN e ON e.image = m.image AND e.x = m.nx AND e.y = m.ny GROUP BY ALL),
s0 AS (SELECT t.image, t.x, t.y, a + b > 0 AND sqrt((a - b) ** 2 + 4 * c * c) > 0.65 * (a + b) AND ok AS "on" FROM t JOIN p USING (image, x, y)),
f0 AS (SELECT e.image, e.x, e.y, spread < 9 * 81 AND ok AS "on" FROM e JOIN p USING (image, x, y)),
""" + ",\n".join(_square(f"{m}{i}", f"{m}{i + 1}", 3, every, 20) for m in "sf" for i, every in enumerate((True, False, False, True))) + """,
r AS (SELECT image, x, y FROM s4 WHERE NOT "on" AND (x IN (0, 19) OR y IN (0, 19)) UNION SELECT s4.image, s4.x, s4.y FROM r JOIN s4 ON s4.image = r.image AND abs(s4.x - r.x) + abs(s4.y - r.y) = 1 WHERE NOT s4."on"),
c AS (SELECT 'smear' AS metric, image, x, y FROM s4 WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.image = s4.image AND r.x = s4.x AND r.y = s4.y) UNION ALL SELECT 'flat', image, x, y FROM f4 WHERE "on"),
w AS (SELECT metric, image, x, y, y * 20 + x AS start FROM c UNION SELECT c.metric, c.image, c.x, c.y, w.start FROM w JOIN c ON c.metric = w.metric AND c.image = w.image AND abs(c.x - w.x) + abs(c.y - w.y) = 1),
b AS (SELECT metric, image, x, y, min(start) AS blob FROM w GROUP BY ALL),
z AS (SELECT b.metric, b.image, blob, count(*) AS n, count(*) FILTER (ok) AS nv FROM b JOIN p USING (image, x, y) GROUP BY ALL),
o AS (SELECT image, count(*) FILTER (ok) AS valid FROM p GROUP BY 1)
SELECT o.image, valid, coalesce(sum(nv) FILTER (metric = 'smear'), 0) / valid AS smear, coalesce(sum(nv) FILTER (metric = 'flat'), 0) / valid AS flat FROM o LEFT JOIN z ON z.image = o.image AND n > 0.02 * valid GROUP BY o.image, valid"""


@query(_TEXTURE)
def tiled_textures(t):
    """An image of 20 by 20 pixels for every 400 parts, cut into tiles of 8: a smeared side with a noisy hole, a flat corner, noise; some pixels are not valid."""
    n = 400
    at = F.col("p_partkey") % n
    x, y, noise = at % 20, F.floor(at / 20), F.col("p_size") * 5
    value = F.when(x < 10, F.when(x.between(3, 5) & y.between(8, 11), noise).otherwise(x * 20)).when(y < 12, 100 + F.col("p_size") % 3).otherwise(noise)
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    px = t("part").select(F.floor(F.col("p_partkey") / n).alias("image"), at.alias("at"), F.concat(byte(value), byte((F.col("p_size") % 17 != 0).cast("int"))).alias("px"))
    whole = px.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("at", "px"))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at("m", k.cast("long")), F.lit("0000")))
    whole = whole.select("image", cells.alias("c"))
    plane = lambda a: F.unhex(F.array_join(F.transform("c", lambda v: F.substring(v, a, 2)), ""))
    images = whole.select("image", F.lit(20).alias("width"), F.lit(20).alias("height"), plane(1).alias("grey"), plane(3).alias("mask"))
    return tiles.shares(tiles.tiled(images, "image", 8), "image", 8, (3, 3, 3), (3, 3, 3))


_CORNERS = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
_SIDES = [(0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5)]


@query("""SELECT p_partkey::VARCHAR AS fragment_id, CASE WHEN p_partkey % 3 = 0 THEN 'convex_hull' ELSE 'mesh' END AS source, (60 + p_size)::DOUBLE AS long, (30 + p_partkey % 20)::DOUBLE AS wide, (5 + p_partkey % 7)::DOUBLE AS thin,
    ((60 + p_size) * (30 + p_partkey % 20) * (5 + p_partkey % 7))::DOUBLE AS volume, CASE WHEN p_partkey % 3 <> 0 THEN 1.0::DOUBLE END AS convexity FROM part""")
def described_meshes(t):
    """A turned box a part, from its twelve triangles to a record; every third one lacks a triangle and runs another the wrong way round."""
    side = t("part").select("p_partkey", *[c.cast("double").alias(n) for n, c in (("a", 60 + F.col("p_size")), ("b", 30 + F.col("p_partkey") % 20), ("c", 5 + F.col("p_partkey") % 7), ("angle", F.col("p_partkey") / 10))])
    place = lambda v: F.array(*_turned(*[F.col(n) * v[k] for k, n in enumerate("abc")], F.col("angle")))
    faces = F.explode(F.array(*[F.struct(F.lit(n).alias("face"), *[F.lit(v).alias(c) for c, v in zip("ijk", s)]) for n, s in enumerate(_SIDES)]))
    corners = side.select("p_partkey", F.explode(F.array(F.array(*[place(v) for v in _CORNERS]))).alias("p"))  # one row, made once
    tri = corners.select("p_partkey", "p", faces.alias("f")).select("p_partkey", "p", "f.*")
    broken = F.col("p_partkey") % 3 == 0
    turn = broken & (F.col("face") == 4)
    tri = tri.filter(~(broken & (F.col("face") == 6))).select("p_partkey", "p", "face", "i", F.when(turn, F.col("k")).otherwise(F.col("j")).alias("j"), F.when(turn, F.col("j")).otherwise(F.col("k")).alias("k"))
    tri = tri.select("p_partkey", "face", *[F.get("p", F.col(n)).alias(c) for c, n in zip("abc", "ijk")], "i", "j", "k")
    got = describe.records(describe.mesh_bounds(tri, "p_partkey"), key="p_partkey")
    dims = [F.col("bounding.obb_dims_mm")[k].alias(n) for k, n in enumerate(("long", "wide", "thin"))]
    return got.select("fragment_id", F.col("bounding.volume_source").alias("source"), *dims, F.col("bounding.volume_mm3").alias("volume"), F.col("bounding.convexity").alias("convexity"))


@query("""WITH RECURSIVE i AS (SELECT DISTINCT p_partkey // 400 AS image FROM part), k AS (SELECT unnest(range(60)) AS no),
    c AS (SELECT image, no, ('0x' || substr(md5(image || ':' || no || ':0x'), 1, 8))::BIGINT % 14 AS x, ('0x' || substr(md5(image || ':' || no || ':0y'), 1, 8))::BIGINT % 14 AS y FROM i, k),
    d AS (SELECT c.image, no, x, y, count(*) FILTER (p_size > 6) / 36 AS share FROM c LEFT JOIN part ON p_partkey // 400 = c.image AND p_partkey % 20 BETWEEN x AND x + 5 AND p_partkey % 400 // 20 BETWEEN y AND y + 5 GROUP BY ALL),
    u AS (SELECT s_suppkey % 5 AS image, s_suppkey * 7 % 20 AS x, s_suppkey * 3 % 20 AS y FROM supplier WHERE s_suppkey % 20 = 1),
    f AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY no) AS n FROM d WHERE share >= 0.8 AND NOT EXISTS (SELECT 1 FROM u WHERE u.image = d.image AND abs(u.x - d.x) < 6 AND abs(u.y - d.y) < 6)),
    g AS (SELECT image, 0::BIGINT AS n, []::STRUCT(a BIGINT, x BIGINT, y BIGINT)[] AS taken FROM f GROUP BY 1
        UNION ALL SELECT f.image, f.n, CASE WHEN len(g.taken) < 5 AND len(list_filter(g.taken, lambda s: abs(s.x - f.x) < 3 AND abs(s.y - f.y) < 3)) = 0 THEN list_append(g.taken, {'a': f.no, 'x': f.x, 'y': f.y}) ELSE g.taken END FROM g JOIN f ON f.image = g.image AND f.n = g.n + 1),
    e AS (SELECT image, unnest(taken, recursive := true) FROM (SELECT image, taken FROM g QUALIFY row_number() OVER (PARTITION BY image ORDER BY n DESC) = 1))
    SELECT image, a AS tile, x, y FROM e""")
def label_tiles(t):
    """Sixty squares of six pixels on images of 20 by 20, 400 parts each; the first five that are lit, unused and apart. Used places are suppliers."""
    at = F.col("p_partkey") % 400
    px = t("part").select(F.floor(F.col("p_partkey") / 400).alias("image"), at.alias("at"), F.when(F.col("p_size") > 6, "ff").otherwise("00").alias("px"))
    m = px.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("at", "px"))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda k: F.coalesce(F.try_element_at("m", k.cast("long")), F.lit("00")))
    images = m.select("image", F.lit(20).alias("width"), F.lit(20).alias("height"), F.lit(0.5).alias("density"), F.unhex(F.array_join(cells, "")).alias("bright"))
    k = F.col("s_suppkey")
    used = t("supplier").filter(k % 20 == 1).select((k % 5).alias("image"), (k * 7 % 20).alias("x"), (k * 3 % 20).alias("y"))
    got = surface.label_tiles(surface.candidates(images, 60, 12.0, 4, 10), 5, used, 0.8)
    return got.select("image", *[F.col(c).cast("long").alias(n) for c, n in (("at", "tile"), ("x", "x"), ("y", "y"))])


@query("""WITH p AS (SELECT l_suppkey, CASE WHEN l_quantity <= 25 THEN 50 WHEN l_quantity <= 40 THEN 150 ELSE 300 END AS level FROM lineitem)
    SELECT l_suppkey, level, inliers, round(inliers / sum(inliers) OVER (PARTITION BY l_suppkey), 6) AS fraction FROM (SELECT l_suppkey, level, count(*) AS inliers FROM p GROUP BY 1, 2)""")
def planes_of_clouds(t):
    """A cloud a supplier, its lines on three levels."""
    q = F.col("l_quantity")
    p = t("lineitem").select("l_suppkey", F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 200 * 10).alias("x"), (F.col("l_orderkey") % 300 * 10).alias("y"), F.when(q <= 25, 50).when(q <= 40, 150).otherwise(300).alias("z"))
    got = planesearch.search(p, "l_suppkey", 60)
    shown = F.round(F.col("fraction") * 1e6) / 1e6  # of the product, as SQL rounds: 323 / 640 is 0.504687 there, by its digits it would be 0.504688
    return got.select("l_suppkey", F.round(F.abs("d")).cast("int").alias("level"), "inliers", shown.alias("fraction"))
