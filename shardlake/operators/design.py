"""Design rules over records: first-match rules on faces, and use suggestions on fragments, compiled to columns.

Rules are data: a dict read from JSON (`sources.config.read_rules`). Every function is one projection without a shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardlake.operators.query import own_labels, usable_area, without_surface


def _labels(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value or [])


def _both(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(True))


def face_test(face: Column, rule: dict, *, exact_label: bool = False, fine: Column | None = None, own: Column | None = None) -> Column:
    """Whether a face meets the bounds a rule states. Null area, RMS or curvature fails its bound; absent reliability is true.

    With exact_label the surface label alone is compared, else the face's whole label set (own, if the caller has it already).
    """
    tests = []
    any_label = lambda names: F.arrays_overlap(own_labels(face) if own is None else own, F.array(*map(F.lit, names)))
    if rule.get("if_scan_reliable", rule.get("scan_reliable")) is not None:
        tests.append(F.coalesce(face["scan_reliable"], F.lit(True)) == rule.get("if_scan_reliable", rule.get("scan_reliable")))
    names = _labels(rule.get("if_label", rule.get("labels")))
    if names:
        tests.append(face["surface_label"].isin(names) if exact_label else any_label(names))
    if rule.get("exclude_labels"):
        tests.append(~any_label(_labels(rule["exclude_labels"])))
    if rule.get("requires_anomaly", rule.get("if_anomaly")):
        wanted = rule.get("requires_anomaly", rule.get("if_anomaly"))
        tests.append(F.exists(face["anomalies"], lambda a: a["label"] == wanted))
    if rule.get("min_area_m2") is not None:
        tests.append(usable_area(face) >= rule["min_area_m2"])
    if rule.get("max_fit_rms_mm") is not None:
        tests.append(face["fit_rms_mm"] <= rule["max_fit_rms_mm"])
    if rule.get("min_fine_curvature_rad") is not None:
        tests.append(fine >= rule["min_fine_curvature_rad"])
    if rule.get("if_assignment"):
        tests.append(face["procedural"]["design_assignment"]["value"] == rule["if_assignment"])
    return _both(tests)


#: What is said of an outcome.
_OUTCOME = ("value", "rule", "note", "reason", "data_status")
#: Outcomes that derive can make.
OUTCOMES = ("connection_strategy", "design_assignment", "finishing_requirement", "handling_class", "use_suggestions", "drill_zone")

#: Bounds whose measured value a trace states, in the order of the trace, with the value's name and format.
_TRACED = (
    ("min_area_m2", "area", "area %.3f m2 >= {}"),
    ("max_fit_rms_mm", "rms", "RMS %.2f mm <= {}"),
    ("min_fine_curvature_rad", "fine", "fine curvature %.3f rad >= {}"),
    ("max_mass_kg", "mass", "mass %.1f kg <= {}"),
    ("if_scan_reliable", None, "face scan_reliable = {}"),
    ("if_assignment", None, "assignment = {}"),
)


def trace(name: str, index: int, rule: dict, values: dict[str, Column], label: Column | None = None) -> tuple[Column, Column, Column]:
    """(rule, note, reason) of a rule that holds: the bounds it tested with the measured values, then the labels if it asked for one.

    A bound whose value is null is stated as it is; a rule that tested nothing says so. Halves round up in decimals.
    """
    parts = []
    for key, value, form in _TRACED:
        if rule.get(key) is not None:
            said = F.lit(form.format(rule[key]).replace("%%", "%"))
            if value in values:
                said = F.when(values[value].isNull(), F.lit(f"{key} = {rule[key]}")).otherwise(F.format_string(form.format(rule[key]), values[value]))
            elif value:
                said = F.lit(f"{key} = {rule[key]}")
            parts.append(said)
    if "if_label" in rule and label is not None:
        parts.append(F.concat(F.lit("feature "), label))
    text = F.concat_ws("; ", *parts) if parts else F.lit("")
    return F.lit(f"{name}#{index}"), F.lit(rule.get("note", "")), F.coalesce(F.nullif(text, F.lit("")), F.lit("default rule, no condition tested"))


def _traced(tests: list[tuple[Column, str, tuple[Column, Column, Column]]]) -> Column:
    """(value, rule, note, reason, data_status) of the first test that holds: one branch a rule, so a row formats the reason of that rule alone."""
    said = lambda *x: F.struct(*[(c if isinstance(c, Column) else F.lit(c)).cast("string").alias(n) for n, c in zip(_OUTCOME, (*x, None))])
    none = said(None, None, "", "no rule matched")
    return reduce(lambda later, x: F.when(x[0], said(x[1], *x[2])).otherwise(later), reversed(tests), none)


def outcome(face: Column, rules: list[dict], key: str, name: str, exact_label: bool = False, reasons: bool = True) -> Column:
    """(value, rule, note, reason) of the first rule that holds for a face; rule reads `name#index` and is null where none holds. Without reasons they are null."""
    values = {"area": usable_area(face), "rms": face["fit_rms_mm"]}

    def first(own: Column | None) -> Column:
        labels = face["surface_label"] if own is None else F.nullif(F.array_join(F.array_sort(own), ", "), F.lit(""))
        said = [trace(name, i, r, values, labels) if reasons else (F.lit(f"{name}#{i}"), F.lit(r.get("note", "")), F.lit(None).cast("string")) for i, r in enumerate(rules, 1)]
        return _traced([(face_test(face, r, exact_label=exact_label, own=own), r[key], x) for r, x in zip(rules, said)])

    # the label set as the variable of a function: it is made once a face
    return first(None) if exact_label else F.get(F.transform(F.array(own_labels(face)), lambda own: first(own)), F.lit(0))


def handling(factor: dict) -> Column:
    """(value, rule, note, reason): the band of the mass, or the dimension override as rule 0; without a mass null."""
    mass, longest, most = F.col("bounding.mass_kg_est"), F.array_max("bounding.obb_dims_mm"), factor["max_manual_dim_mm"]
    tests = [(F.coalesce(longest > most, F.lit(False)), factor["rules"][-1]["class"], (F.lit("handling_class#0"), F.lit(factor.get("max_dim_note", "")), F.format_string(f"longest dimension %.0f mm exceeds {most} mm", F.bround(longest))))]
    for i, r in enumerate(factor["rules"], 1):
        top = r["max_mass_kg"]
        rule, note, reason = trace("handling_class", i, r, {"mass": mass})
        tests.append((F.lit(True) if top is None else mass <= top, r["class"], (rule, note, F.format_string("estimated mass %.1f kg, above every band", mass) if top is None else reason)))
    none = F.struct(*[F.lit(x).cast("string").alias(n) for n, x in (("value", None), ("rule", None), ("note", ""), ("reason", "mass not available"), ("data_status", None))])
    return F.when(mass.isNull(), none).otherwise(_traced(tests))


def _labelled(name: str):
    return lambda anomaly: anomaly["label"] == name


def _shows(name: str):
    return lambda f: F.coalesce(f["surface_label"] == name, F.lit(False)) | F.coalesce(F.exists(f["anomalies"], _labelled(name)), F.lit(False))


def finishing(face: Column, rules: list[dict], fine: Column) -> Column:
    """(value, rule): the first treatment rule that holds for a face; labels count as anomalies too, and the rule's note stands for the rule."""
    tests = []
    for r in rules:
        rest = {k: v for k, v in r.items() if k not in ("if_anomaly", "if_assignment")}
        t = [face_test(face, rest, fine=fine)]
        if "if_anomaly" in r:
            t.append(F.coalesce(F.exists(face["anomalies"], _labelled(r["if_anomaly"])), F.lit(False)) | F.array_contains(own_labels(face), r["if_anomaly"]))
        if "if_assignment" in r:
            t.append(F.coalesce(face["procedural"]["design_assignment"]["value"] == r["if_assignment"], F.lit(False)))
        tests.append((_both(t), r["requirement"], (F.lit(r.get("note")), F.lit(None).cast("string"), F.lit(None).cast("string"))))
    out = _traced(tests)
    return F.struct(out["value"].alias("value"), out["rule"].alias("rule"))


def fragment_test(rule: dict) -> Column:
    """Bounds on mass, thickness, aspect, curvature and convexity, and a height band that any dimension may meet; nulls fail, unknown keys count for nothing."""
    thick, longest = F.array_min("bounding.obb_dims_mm"), F.array_max("bounding.obb_dims_mm")
    value = {
        "mass_kg": F.col("bounding.mass_kg_est"), "thickness_mm": thick, "longest_mm": longest, "convexity": F.col("bounding.convexity"),
        "aspect_ratio": F.when(thick > 0, longest / thick), "fine_curvature_rad": F.col("curvature.fine_mm.mean_rad"), "coarse_curvature_rad": F.col("curvature.coarse_mm.mean_rad"),
    }
    tests = []
    for key, bound in rule.items():
        side, _, field = key.partition("_")
        if key == "height_band_mm":
            low, high = map(float, bound)
            tests.append(F.exists("bounding.obb_dims_mm", lambda d: d.between(low, high)))
        elif side in ("min", "max") and field in value:
            tests.append(value[field] >= bound if side == "min" else value[field] <= bound)
    return _both(tests)


def _matching_faces(rule: dict) -> Column:
    at = F.transform("planarity", lambda f, i: F.struct(i.alias("i"), f.alias("f"), own_labels(f).alias("own")))
    return F.coalesce(F.transform(F.filter(at, lambda x: face_test(x["f"], rule, own=x["own"])), lambda x: x["i"]), F.array().cast("array<int>"))


def _matching_regions(rule: dict) -> Column:
    """Ids of regions with features that meet the rule's area and labels; only rules without an RMS bound look at regions."""
    none = F.array().cast("array<int>")
    if rule.get("max_fit_rms_mm") is not None:
        return none

    def ok(r: Column) -> Column:
        ids = F.transform(r["features"], lambda x: x["id"])
        tests = [F.size(ids) > 0]
        if rule.get("labels"):
            tests.append(F.arrays_overlap(ids, F.array(*map(F.lit, _labels(rule["labels"])))))
        if rule.get("min_area_m2") is not None:
            tests.append(r["area_m2"] >= rule["min_area_m2"])
        return _both(tests)

    return F.coalesce(F.transform(F.filter("vision.regions", ok), lambda r: r["region_id"]), none)


def uses(rules: list[dict]) -> Column:
    """Suggestions in the order of the rules: the fragment's bounds, a face or region that meets requires_face, none that meets requires_no_face."""
    out = []
    for r in rules:
        need, never = r.get("requires_face"), r.get("requires_no_face")
        hit = _matching_faces(need) if need else F.array().cast("array<int>")
        near = _matching_regions(need) if need else F.array().cast("array<int>")
        ok = fragment_test(r.get("requires_fragment") or {})
        if need:
            ok &= (F.size(hit) > 0) | (F.size(near) > 0)
        if never:
            ok &= F.size(_matching_faces(never)) == 0
        one = F.struct(F.lit(r["id"]).alias("id"), F.lit(r.get("label", r["id"])).alias("label"), hit.alias("faces"), F.when(F.size(near) > 0, near).alias("regions"), F.lit(r.get("note", "")).alias("note"), F.lit(r.get("caveat")).cast("string").alias("caveat"))
        out.append(F.when(ok, one))
    return F.filter(F.array(*out), lambda u: u.isNotNull())


def derive(records: DataFrame, factors: dict, withheld: str = "not published", publish: bool = False, only: tuple[str, ...] = OUTCOMES, reasons: bool = True) -> DataFrame:
    """Derive outcomes anew, with rule, note and reason: of every face and of the record. Fields that no rule makes stay as they are.

    Treatment and drill zone are withheld (null, status `withheld`, the given reason) unless publish is set. `only` names the outcomes to make; the
    others stay as they were. Reasons of faces cost most, as they are put into words; who reads none leaves them null. Each record is derived once: what later steps ask of the outcomes is not pushed below.
    """
    kind = records.schema["procedural"].dataType
    face_kind = records.schema["planarity"].dataType.elementType["procedural"].dataType
    closed = F.struct(*[F.lit(x).cast("string").alias(n) for n, x in (("value", None), ("rule", None), ("note", None), ("reason", withheld), ("data_status", "withheld"))])

    def put(block: Column, fields: dict[str, tuple], to) -> Column:
        """The block with the given fields, in the type `to`; the others as they were."""
        said = {f.name: f.dataType for f in to.fields}
        return F.struct(*[_as(fields[n][0], t, *fields[n][1:]).alias(n) if n in fields else block[n].alias(n) for n, t in said.items()])

    def side(f: Column) -> Column:
        done = {"data_status": (F.lit("proposed"),)}
        if "connection_strategy" in only:
            done["connection_strategy"] = outcome(f, factors["connection_strategy"]["rules"], "strategy", "connection_strategy", exact_label=True, reasons=reasons), _OUTCOME
        if "design_assignment" in only:
            done["design_assignment"] = outcome(f, factors["design_assignment"]["rules"], "assignment", "design_assignment", reasons=reasons), _OUTCOME
        if "finishing_requirement" in only:
            done["finishing_requirement"] = closed, _OUTCOME
        return f.withField("procedural", put(f["procedural"], done, face_kind))

    made = {}
    if set(only) & {"connection_strategy", "design_assignment", "finishing_requirement"}:
        made["planarity"] = F.transform("planarity", side)
    if publish and "finishing_requirement" in only:
        rules = (factors.get("finishing_requirement") or {}).get("rules", [])
        made["planarity"] = F.transform(made["planarity"], lambda f: f.withField("procedural", put(f["procedural"], {"finishing_requirement": (finishing(f, rules, F.col("curvature.fine_mm.mean_rad")), _OUTCOME[:2])}, face_kind)))
    whole = {"data_status": (F.lit("proposed"),), "faces_evaluated": (F.coalesce(F.nullif(F.size("planarity"), F.lit(-1)), F.lit(0)),), "basis": (F.lit(factors.get("_status")),)}
    if "handling_class" in only:
        whole["handling_class"] = handling(factors["handling_class"]), _OUTCOME
    if "use_suggestions" in only:
        whole["use_suggestions"] = (uses(factors["use_suggestions"]["rules"]),)
    if "drill_zone" in only:
        whole["drill_zone"] = (drill_zone(factors["drill_zone"]), _DRILL) if publish else (closed, _OUTCOME)
    made["procedural"] = put(F.col("procedural"), whole, kind)
    # a generator of one row is a border that filters and projections are not moved across
    once = records.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("_made"))
    return once.select(*[F.col(f"_made.{n}").alias(n) if n in made else F.col(n) for n in records.columns])


_DRILL = ("value", "rule", "clear_core_mm_est", "cover_mm_assumed", "entry_faces")


def _as(value: Column, kind, names: tuple = ()) -> Column:
    """A value in a type; a struct by the names it has, other fields null."""
    if not names:
        return value.cast(kind)
    return F.struct(*[(value[f.name].cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields])


def geometry_only(records: DataFrame, factors: dict, strip_adjacent: bool = True, only: tuple[str, ...] = OUTCOMES) -> DataFrame:
    """The ablation: what was seen on surfaces is withheld, and all outcomes (or those of `only`) are derived again from geometry alone."""
    return derive(without_surface(records, strip_adjacent), factors, only=only)


def use_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """fragment_id, added and removed uses between two states of the records."""
    ids = lambda df, name: df.select("fragment_id", F.transform("procedural.use_suggestions", lambda u: u["id"]).alias(name))
    none = F.array().cast("array<string>")
    both = ids(before, "b").join(ids(after, "a"), "fragment_id", "full_outer").select("fragment_id", F.coalesce("b", none).alias("b"), F.coalesce("a", none).alias("a"))
    return both.select("fragment_id", F.array_except("a", "b").alias("added"), F.array_except("b", "a").alias("removed"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def flag_unscanned(records: DataFrame, limit_deg: float = 25.0, frame: str = "raw") -> DataFrame:
    """Set angle_to_unscanned_deg and scan_reliable of every face against the unscanned side's normal.

    frame `raw` compares the two normals as stored; `gltf` turns the sidecar's axes (x, z, -y) first. Without a
    normal nothing changes.
    """
    if frame not in ("raw", "gltf"):
        raise ValueError(f"unknown frame {frame}")
    u = F.col("scan_coverage.unscanned_avg_normal")
    u = u if frame == "raw" else F.array(u[0], u[2], -u[1])
    size = F.sqrt(_dot(u, u))

    def mark(f: Column) -> Column:
        raw = F.abs(_dot(f["normal_xyz"], u)) / F.nullif(size * F.sqrt(_dot(f["normal_xyz"], f["normal_xyz"])), F.lit(0.0))
        cos = F.when(raw > 1, 1.0).otherwise(raw)
        return f.withField("angle_to_unscanned_deg", F.coalesce(F.degrees(F.acos(cos)), f["angle_to_unscanned_deg"])).withField("scan_reliable", F.coalesce(cos < math.cos(math.radians(limit_deg)), f["scan_reliable"]))

    return records.withColumn("planarity", F.transform("planarity", mark))


def edge_faces(tolerance_deg: float = 35.0) -> Column:
    """Places of faces whose normals lie within the tolerance of perpendicular to the thinnest axis (the last one)."""
    thin = F.element_at("bounding.obb_axes_xyz", -1)
    at = F.transform("planarity", lambda f, i: F.struct(i.alias("i"), F.abs(_dot(f["normal_xyz"], thin)).alias("c")))
    return F.transform(F.filter(at, lambda x: x["c"] <= math.sin(math.radians(tolerance_deg))), lambda x: x["i"])


def drill_zone(factor: dict) -> Column:
    """(value, rule, clear_core_mm_est, cover_mm_assumed, entry_faces): the first drill rule, its note standing for the rule.

    It reads surface labels and anomalies only, and the core left between two covers and bars; entry faces (see edge_faces) are
    given where holes go into an edge.
    """
    cover = factor.get("cover_mm_assumed", 20)
    core = F.array_min("bounding.obb_dims_mm") - 2 * (cover + factor.get("bar_dia_mm_assumed", 12))
    tests = []
    for r in factor["rules"]:
        t = []
        if r.get("if_any_face_label"):
            wanted = r["if_any_face_label"]
            t.append(F.exists("planarity", _shows(wanted)))
        if r.get("min_clear_core_mm") is not None:
            t.append(core >= r["min_clear_core_mm"])
        tests.append((_both(t), r["zone"], (F.lit(r.get("note")), F.lit(None).cast("string"), F.lit(None).cast("string"))))
    out = _traced(tests)
    into = F.when(out["value"] == "edge_mid_depth", edge_faces(factor.get("edge_normal_tol_deg", 35)))
    return F.struct(out["value"].alias("value"), out["rule"].alias("rule"), F.round(core, 1).alias("clear_core_mm_est"), F.lit(float(cover)).alias("cover_mm_assumed"), into.alias("entry_faces"))
