"""Registered queries of the other operators: evaluation, findings, regions, geometry, pixels, vocabularies, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardlake.operators import evaluation, findings, geometry, governance, raster, regions
from shardlake.plans.analytics import query
from shardlake.sources.records import label_set

# ---- evaluation: documents that have labels are items; rules on length and language say what they are

_ITEMS = """WITH i AS (SELECT doc_id, list_filter(['q' || quality, 't' || toxic], lambda x: x IS NOT NULL) AS truth, CASE WHEN n_chars >= 800 THEN ['q1', 't0'] WHEN n_chars >= 200 THEN ['q1'] ELSE ['q0', 'x'] END AS said, doc_id % 3 AS vote
    FROM documents JOIN labels USING (doc_id)),
t AS (SELECT doc_id, vote, unnest(truth) AS f FROM i), p AS (SELECT doc_id, vote, unnest(said) AS f FROM i)
"""


def _items(t):
    n = F.col("n_chars")
    truth = F.array_compact(F.array(F.concat(F.lit("q"), "quality"), F.concat(F.lit("t"), "toxic")))
    said = F.when(n >= 800, F.array(F.lit("q1"), F.lit("t0"))).when(n >= 200, F.array(F.lit("q1"))).otherwise(F.array(F.lit("q0"), F.lit("x")))
    return t("documents").select("doc_id", "n_chars", "lang").join(t("labels"), "doc_id").select("doc_id", "lang", truth.alias("truth"), said.alias("said"), (F.col("doc_id") % 3).alias("vote"))


_MICRO = """, c AS (SELECT {by} count(*) FILTER (t.f IS NOT NULL AND p.f IS NOT NULL) AS tp, count(*) FILTER (t.f IS NULL) AS fp, count(*) FILTER (p.f IS NULL) AS fn FROM t FULL JOIN p ON t.doc_id = p.doc_id AND t.f = p.f {group}),
e AS (SELECT {by2} count(*) FILTER (list_sort(truth) = list_sort(said)) AS exact, count(*) AS items FROM i {group2})
SELECT {out} tp, fp, fn, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, exact, items FROM c {join}"""


@query(_ITEMS + _MICRO.format(by="", group="", by2="", group2="", out="", join=", e"))
def micro_average(t):
    return evaluation.micro(_items(t))


@query(_ITEMS + _MICRO.format(by="coalesce(t.vote, p.vote) AS vote,", group="GROUP BY 1", by2="vote,", group2="GROUP BY 1", out="vote,", join="JOIN e USING (vote)"))
def per_vote_scores(t):
    return evaluation.micro(_items(t), by=("vote",))


@query(_ITEMS + """SELECT coalesce(t.f, p.f) AS feature, count(*) FILTER (t.f IS NOT NULL AND p.f IS NOT NULL) AS tp, count(*) FILTER (t.f IS NULL) AS fp, count(*) FILTER (p.f IS NULL) AS fn,
    tp / nullif(tp + fn, 0) AS recall, tp / nullif(tp + fp, 0) AS precision FROM t FULL JOIN p ON t.doc_id = p.doc_id AND t.f = p.f GROUP BY 1""")
def scores_by_feature(t):
    return evaluation.by_feature(_items(t))


@query(_ITEMS + """, a AS (SELECT doc_id, truth, f, doc_id % 2 = 0 AND f <> 'q0' AND doc_id % 5 <> 0 AS yes FROM i, (VALUES ('q0'), ('q1'), ('t1'), ('never')) x(f))
    SELECT f AS feature, count(*) FILTER (list_contains(truth, f)) AS truth, count(*) FILTER (list_contains(truth, f) AND yes) AS tp, count(*) FILTER (NOT list_contains(truth, f) AND yes) AS fp, count(*) FILTER (list_contains(truth, f) AND NOT yes) AS fn FROM a GROUP BY 1""")
def binary_probe(t):
    """Features that no item has are asked too; items whose number divides by five have no answers."""
    names = ["q0", "q1", "t1", "never"]
    i = _items(t)
    said = i.filter("doc_id % 5 <> 0").select("doc_id", F.explode(F.array(*map(F.lit, names))).alias("feature")).withColumn("yes", (F.col("doc_id") % 2 == 0) & (F.col("feature") != "q0"))
    return evaluation.probe(i, names, said, "doc_id")


@query(_ITEMS + """, d AS (SELECT coalesce(t.doc_id, p.doc_id) AS doc_id, coalesce(t.f, p.f) AS feature, CASE WHEN t.f IS NULL THEN 'FP' ELSE 'FN' END AS kind FROM t FULL JOIN p ON t.doc_id = p.doc_id AND t.f = p.f WHERE t.f IS NULL OR p.f IS NULL)
    SELECT doc_id, feature, kind, array_to_string(list_sort(truth), ', ') AS truth FROM d JOIN i USING (doc_id)""")
def disagreements(t):
    return evaluation.disagreements(_items(t), "doc_id")


@query(_ITEMS + "SELECT f AS filed, count(*) AS items, count(*) FILTER (list_contains(said, f)) AS found, avg(list_contains(said, f)::INTEGER) AS rate FROM (SELECT said, truth[1] AS f FROM i) WHERE f IS NOT NULL GROUP BY 1")
def exemplar_recovery(t):
    return evaluation.recovery(_items(t).select(F.get("truth", F.lit(0)).alias("f"), "said"), "f", "said")


_VOTES = "WITH e AS (SELECT user_id % 10 AS batch, user_id AS item, event_type AS feature, dayofyear(ts) % 3 AS run FROM events), b AS (SELECT batch, count(DISTINCT run) AS runs FROM e GROUP BY 1 HAVING runs >= 3), v AS (SELECT batch, item, feature, count(DISTINCT run) AS votes FROM e GROUP BY ALL)"


def _votes(t):
    return t("events").select((F.col("user_id") % 10).alias("batch"), F.col("user_id").alias("item"), F.col("event_type").alias("feature"), (F.dayofyear("ts") % 3).alias("run"))


@query(_VOTES + """, c AS (SELECT feature, count(*) FILTER (votes = 3) AS all3, count(*) FILTER (votes = 2) AS two, count(*) FILTER (votes = 1) AS one FROM v JOIN b USING (batch) GROUP BY 1)
    SELECT *, all3 / nullif(all3 + two + one, 0) AS all3_share, two / nullif(all3 + two + one, 0) AS two_share, one / nullif(all3 + two + one, 0) AS one_share FROM c""")
def agreement_histogram(t):
    return evaluation.agreement(_votes(t), "batch", "item", "feature", "run")


@query(_VOTES + """, s AS (SELECT batch, item, coalesce(string_agg(feature, ', ' ORDER BY feature) FILTER (votes > runs // 2), '') AS combination FROM v JOIN b USING (batch) GROUP BY 1, 2)
    SELECT combination, count(*) AS items, count(*) / sum(count(*)) OVER () AS share FROM s GROUP BY 1""")
def feature_combinations(t):
    return evaluation.combinations(_votes(t), "batch", "item", "feature", "run")


@query("""WITH e AS (SELECT user_id AS item, event_type AS feature, dayofyear(ts) % 3 AS run FROM events), r AS (SELECT item, count(DISTINCT run) AS n FROM e GROUP BY 1),
    v AS (SELECT item, feature, count(DISTINCT run) AS k FROM e WHERE feature IN ('view', 'click', 'error', 'signup') GROUP BY 1, 2),
    m AS (SELECT item, string_agg(feature, ', ' ORDER BY CASE feature WHEN 'error' THEN 1 WHEN 'click' THEN 2 ELSE 999 END, feature) AS f FROM v JOIN r USING (item) WHERE k >= n // 2 + 1 GROUP BY 1)
    SELECT c_custkey AS item, coalesce(f, '') AS features, coalesce(n, 0) AS n_runs FROM customer LEFT JOIN r ON c_custkey = r.item LEFT JOIN m ON c_custkey = m.item""")
def merged_votes(t):
    """Items without any vote have no features; retired ones (here `purchase`) are not counted."""
    v = t("events").select(F.col("user_id").alias("item"), F.col("event_type").alias("feature"), (F.dayofyear("ts") % 3).alias("run"))
    got = evaluation.merged(v, t("customer").select(F.col("c_custkey").alias("item")), "item", "feature", "run", ["view", "click", "error", "signup"], ["error", "click"])
    return got.select("item", F.array_join("features", ", ").alias("features"), "n_runs")


@query("""WITH a AS (SELECT user_id AS item, event_id AS run, event_type = 'error' AS bad, event_type AS label, value, CASE WHEN value > 60 THEN 'yes' ELSE 'no' END AS crack, CASE WHEN value < 90 THEN floor(value)::INTEGER END AS pct FROM events),
    g AS (SELECT * FROM a WHERE NOT bad), l AS (SELECT item, label, count(*) AS n, min(run) AS f FROM g GROUP BY 1, 2),
    s AS (SELECT item, arg_min(label, n * -1000000000 + f) AS label, array_to_string(list_sort(list(label)), ',') AS labels FROM l GROUP BY 1),
    c AS (SELECT item, string_agg(label || '=' || p, ',' ORDER BY label) AS coverage FROM (SELECT item, label, round_even(avg(floor(value)), 0)::INTEGER AS p FROM g GROUP BY 1, 2) GROUP BY 1)
    SELECT x.item, x.n_total, x.n_runs, x.crack_pct, s.label, s.labels, c.coverage FROM (SELECT item, count(*) AS n_total, nullif(count(*) FILTER (NOT bad), 0) AS n_runs, round_even(avg(pct) FILTER (NOT bad AND crack = 'yes'), 0)::INTEGER AS crack_pct FROM a GROUP BY 1) x LEFT JOIN s USING (item) LEFT JOIN c USING (item)""")
def run_merge(t):
    one = F.array("event_type")
    maps = F.create_map(F.col("event_type"), F.lit("plain"))
    a = t("events").select(F.col("user_id").alias("item"), F.col("event_id").alias("run"), (F.col("event_type") == "error").alias("parse_error"), F.col("event_type").alias("label"), one.alias("labels"),
        F.create_map(F.col("event_type"), F.floor("value")).alias("coverage"), F.when(F.col("value") > 60, "yes").otherwise("no").alias("crack"), F.when(F.col("value") < 90, F.floor("value").cast("int")).alias("crack_pct"), maps.alias("subtypes"), maps.alias("notes"))
    m = evaluation.merge_answers(a, "item")
    cover = F.array_join(F.transform(F.array_sort(F.map_entries("coverage")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return m.select("item", "n_total", "n_runs", "crack_pct", "label", F.array_join("labels", ",").alias("labels"), cover.alias("coverage"))


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events WHERE event_type IN ('view', 'click', 'signup') GROUP BY 1, 2), w AS (SELECT user_id, event_type FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1)
    SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 <> 0 THEN event_type END AS event_type FROM customer LEFT JOIN w ON c_custkey = user_id""")
def cell_majority(t):
    cells = t("customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 4 == 0).alias("excluded"))
    return evaluation.cell_majority(t("events"), cells, ["user_id"], "event_type", "event_id", ["view", "click", "signup"])


@query("SELECT l_orderkey AS record, count(*) FILTER (l_tax > 0.02 AND l_quantity < 30) AS classified, count(*) FILTER (l_tax > 0.02 AND l_quantity >= 30) AS inferred, count(*) FILTER (NOT l_tax > 0.02) AS unlabelled FROM lineitem GROUP BY 1")
def face_census(t):
    f = t("lineitem").select(F.col("l_orderkey").alias("record"), F.when(F.col("l_tax") > 0.02, F.col("l_returnflag")).alias("label"), (F.col("l_quantity") >= 30).alias("inferred"))
    return evaluation.census(f, "record")


@query("""WITH x AS (SELECT p_partkey AS tile, CASE WHEN p_size % 10 = 0 THEN p_name || '、unusable' WHEN p_size % 7 = 0 THEN 'none' WHEN p_size % 3 = 0 THEN replace(p_name, ' ', '， ') || ';' || p_name ELSE replace(p_name, ' ', ',,') END AS c FROM part),
    y AS (SELECT tile, list_distinct(list_filter(list_transform(regexp_split_to_array(c, '[,;，、]'), lambda s: trim(s)), lambda s: s <> '')) AS l FROM x)
    SELECT tile, array_to_string(list_sort(list_filter(l, lambda s: s <> 'none')), ';') AS labels FROM y WHERE len(l) > 0 AND NOT list_contains(l, 'unusable')""")
def label_parse(t):
    s = F.col("p_size")
    spaced = lambda by: F.replace("p_name", F.lit(" "), F.lit(by))
    cell = F.when(s % 10 == 0, F.concat("p_name", F.lit("、unusable"))).when(s % 7 == 0, "none").when(s % 3 == 0, F.concat(spaced("， "), F.lit(";"), "p_name")).otherwise(spaced(",,"))
    got = t("part").select(F.col("p_partkey").alias("tile"), label_set(cell).alias("l")).filter("l is not null")
    return got.select("tile", F.array_join(F.array_sort("l"), ";").alias("labels"))


# ---- findings

@query("""SELECT doc_id::VARCHAR AS fragment_id, 'fail' AS level, 'same as ' || CASE WHEN doc_id = a THEN b ELSE a END AS detail FROM
    (SELECT doc_id, min(doc_id) OVER w AS a, list_sort(list(doc_id) OVER w)[2] AS b, count(*) OVER w AS n FROM documents WHERE n_chars IS NOT NULL AND text IS NOT NULL WINDOW w AS (PARTITION BY n_chars, length(text) // 3 ORDER BY 1 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE n > 1""")
def duplicate_signature(t):
    m = t("documents").select(F.col("doc_id").alias("fragment_id"), F.col("n_chars").alias("faces"), F.floor(F.length("text") / 3).cast("double").alias("volume"))
    return findings.duplicates(m).select(F.col("fragment_id").cast("string").alias("fragment_id"), "level", "detail")


@query("""WITH m AS (SELECT p_partkey AS id, p_size, p_retailprice AS r FROM part), s AS (SELECT id, 'texel density' AS title, CASE WHEN p_size / 25.0 < 0.5 THEN 'fail' WHEN p_size / 25.0 < 1 THEN 'warn' ELSE 'ok' END AS level FROM m
    UNION ALL SELECT id, 'remesh resolution', CASE WHEN p_size * 20000 / greatest(3.0 * (r / 2) ** 2, 1) < 0.2 THEN 'fail' ELSE 'ok' END FROM m
    UNION ALL SELECT id, 'UV coordinates', CASE WHEN p_size % 9 <> 0 THEN 'ok' ELSE 'fail' END FROM m
    UNION ALL SELECT id, 'volume', CASE WHEN p_size % 4 <> 0 AND p_size / 30.0 BETWEEN 0.2 AND 1 THEN 'ok' ELSE 'warn' END FROM m
    UNION ALL SELECT id, 'texture', CASE WHEN p_size < 12 THEN 'fail' WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN 'warn' ELSE 'ok' END FROM m
    UNION ALL SELECT id, 'sidecar', CASE WHEN p_size % 6 = 0 OR p_size % 5 = 0 THEN 'warn' WHEN p_size % 7 = 0 THEN 'fail' WHEN p_size < 10 THEN 'fail' WHEN p_size % 11 = 0 THEN 'fail' WHEN NOT p_size / 60.0 BETWEEN 0.02 AND 0.6 THEN 'warn' WHEN p_size < 25 THEN 'warn' ELSE 'ok' END FROM m)
    SELECT title, level, count(*) AS n, min(id)::VARCHAR AS first FROM s GROUP BY 1, 2""")
def quality_findings(t):
    s = F.col("p_size")
    m = t("part").select(
        F.col("p_partkey").alias("fragment_id"), (s / 25).alias("density"), (s * 20000).alias("faces"), F.col("p_retailprice").alias("longest_mm"), (s % 9 != 0).alias("has_uv"), (s % 4 != 0).alias("consistent"), (s / 30.0).alias("volume"),
        F.lit(1.0).alias("hull"), s.cast("double").alias("mean"), F.when(s % 5 == 0, 0.04).otherwise(0.01).alias("margin"), F.when(s % 7 == 0, 0.03).otherwise(0.0).alias("flat"), (s % 6 != 0).alias("has_sidecar"), (s % 5 != 0).alias("has_unscanned_face"),
        F.when(s % 7 == 0, 0).otherwise(s).alias("face_count"), F.when(s < 10, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).when(s < 25, F.array(F.lit(0.0), F.lit(-2.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.1))).alias("normal"),
        F.when(s % 11 == 0, 0).otherwise(s).alias("matched"), (s / 60.0).alias("share"))
    every = findings.collect(*[check(m) for check in (findings.texel_density, findings.remesh, findings.uv, findings.volume, findings.texture, findings.sidecar)])
    return every.groupBy("title", "level").agg(F.count(F.lit(1)).alias("n"), F.min("fragment_id").cast("string").alias("first"))


@query("""SELECT p_partkey AS fragment_id, printf('%.0f %% off', round_even(far * 100, 0)) AS detail FROM (SELECT p_partkey, greatest(abs(p_size - 25) / 25.0, abs(p_partkey % 40 - 20) / 20.0) AS far FROM part) WHERE far > 0.15""")
def identity_drift(t):
    now = t("part").select(F.col("p_partkey").alias("fragment_id"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 40).cast("double")).alias("dims"))
    old = t("part").select(F.col("p_partkey").alias("fragment_id"), F.array(F.lit(25.0), F.lit(20.0)).alias("dims"))
    return findings.drift(now, old).select("fragment_id", "detail")


@query("""SELECT p_partkey % 20 AS fragment_id, p_partkey AS region_id, CASE WHEN p_size > 45 THEN 'missing' WHEN p_type = 'PROMO' THEN 'kind' WHEN abs(p_size / 100.0 - (p_size + p_partkey % 2) / 100.0) > 0.005 THEN 'area' END AS violation FROM part WHERE violation IS NOT NULL""")
def backfill_violations(t):
    base = t("part").select((F.col("p_partkey") % 20).alias("fragment_id"), F.col("p_partkey").alias("region_id"), F.col("p_type").alias("kind"), (F.col("p_size") / 100.0).alias("area_frac"), "p_size")
    fresh = base.filter("p_size <= 45").withColumn("kind", F.when(F.col("kind") == "PROMO", "plane").otherwise(F.col("kind"))).withColumn("area_frac", (F.col("p_size") + F.col("region_id") % 2) / 100.0)
    return findings.backfill_violations(fresh, base)


@query("""WITH f AS (SELECT p_partkey, p_name AS id, CASE WHEN p_size >= 5 THEN p_brand END AS rule, p_size > 40 AS retired FROM part), o AS (SELECT unnest(['cold widget', 'small widget', 'ghost']) AS id)
    SELECT id, problem, count(*) AS n FROM (SELECT id, 'repeated id' AS problem FROM f GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'no decision rule' FROM f WHERE NOT retired AND rule IS NULL
    UNION ALL SELECT id, 'not in precedence' FROM f WHERE NOT retired AND id NOT IN (SELECT id FROM o) UNION ALL SELECT id, 'unknown in precedence' FROM o WHERE id NOT IN (SELECT id FROM f WHERE NOT retired)) GROUP BY ALL""")
def taxonomy_check(t):
    f = t("part").select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("id"), F.when(F.col("p_size") >= 5, F.col("p_brand")).alias("decision_rule"), (F.col("p_size") > 40).alias("retired"))
    return findings.taxonomy(f, ["cold widget", "small widget", "ghost"]).groupBy("id", "problem").agg(F.count(F.lit(1)).alias("n"))


# ---- vocabularies, caches, queues: a part is a label

_TAX = "WITH x AS (SELECT p_partkey::INTEGER AS feature_id, 'label ' || p_partkey AS id, p_type AS \"group\", p_brand AS decision_rule, p_size > 40 AS retired FROM part)"


def _tax(t):
    return t("part").select(F.col("p_partkey").cast("int").alias("feature_id"), F.concat(F.lit("label "), "p_partkey").alias("id"), F.col("p_type").alias("group"), F.col("p_brand").alias("decision_rule"), (F.col("p_size") > 40).alias("retired"))


@query(_TAX + "SELECT feature_id, id, \"group\", CASE WHEN retired THEN 'retired' ELSE 'active' END AS state FROM x WHERE \"group\" IN ('ECONOMY', 'PROMO')")
def taxonomy_list(t):
    return governance.listing(_tax(t), ("ECONOMY", "PROMO"))


@query(_TAX + "SELECT \"group\", string_agg(id, ', ' ORDER BY feature_id) AS ids FROM x WHERE NOT retired GROUP BY 1")
def taxonomy_groups(t):
    return governance.groups(_tax(t))


@query(_TAX + "SELECT id, CASE id WHEN 'label 7' THEN 1 WHEN 'label 3' THEN 2 WHEN 'label 12' THEN 3 ELSE feature_id::BIGINT + 4 END AS place FROM x WHERE NOT retired")
def taxonomy_precedence(t):
    return governance.precedence(_tax(t), ["label 7", "label 3", "label 12"])


@query(_TAX + """, y AS (SELECT feature_id, id, \"group\", decision_rule, retired OR id = 'label 5' AS retired FROM x UNION ALL SELECT max(feature_id) + 1, 'new', 'ECONOMY', 'a rule', false FROM x)
    SELECT feature_id, id, \"group\", decision_rule, retired FROM y""")
def taxonomy_retire_add(t):
    return governance.add(governance.retire(_tax(t), "label 5"), ["label 1"], "new", "ECONOMY", "a rule", before="label 1")[0]


@query(_TAX + "SELECT feature_id, id FROM x WHERE feature_id <> (SELECT max(feature_id) FROM x)")
def taxonomy_remove(t):
    """The last label goes, as nothing refers to it: used are those of the parts that orders have."""
    tax = _tax(t)
    last = tax.orderBy(F.desc("feature_id")).first()["id"]
    used = t("lineitem").select(F.concat(F.lit("label "), F.col("l_partkey") % 5).alias("label"))
    return governance.remove(tax, last, used).select("feature_id", "id")


@query("""SELECT label, string_agg(place, ', ' ORDER BY place) AS places FROM (SELECT DISTINCT lang AS label, 'documents' AS place FROM documents WHERE lang IS NOT NULL UNION SELECT DISTINCT source, 'documents' FROM documents WHERE source IS NOT NULL UNION SELECT DISTINCT event_type, 'events' FROM events
    UNION SELECT DISTINCT split_part(split_part(url, '/', 4), '/', 1), 'pages' FROM pages WHERE url IS NOT NULL) GROUP BY 1""")
def vocabulary_usage(t):
    d = t("documents")
    pages = t("pages").filter("url is not null").select(F.split("url", "/")[3].alias("label"))
    return governance.usage({"documents": d.select(F.explode(F.array("lang", "source")).alias("label")), "events": t("events").select(F.col("event_type").alias("label")), "pages": pages})


_KEY = "md5(text) || '_' || substr(md5('Say what you see.'), 1, 6) || '_run' || doc_id % 3 || '_3_local_stub'"


@query(f"WITH k AS (SELECT doc_id, {_KEY} AS key FROM documents WHERE text IS NOT NULL) SELECT doc_id, key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 4 = 0)")
def cache_misses(t):
    k = t("documents").filter("text is not null").select("doc_id", governance.cache_key(F.col("text"), "Say what you see.", F.col("doc_id") % 3, "3", "local", "stub").alias("key"))
    return governance.misses(k, k.filter("doc_id % 4 = 0")).select("doc_id", "key")


@query("SELECT conv_id, turn, turn + 1 + 3 * (conv_id // 3) AS number FROM conversations")
def batch_renumber(t):
    return t("conversations").select("conv_id", "turn", governance.renumbered(F.col("turn") + 1, F.floor(F.col("conv_id") / 3), 3).alias("number"))


@query("SELECT conv_id, bool_and(turn + 1 BETWEEN 1 AND conv_id % 6) AS valid FROM conversations GROUP BY 1")
def cache_guard(t):
    c = t("conversations").groupBy("conv_id").agg(F.collect_list((F.col("turn") + 1).cast("long")).alias("n"))
    return c.select("conv_id", governance.valid_numbers(F.col("n"), F.col("conv_id") % 6).alias("valid"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 1 THEN (regexp_extract(props, '[0-9]+'))::BIGINT END AS k, event_id % 5 = 1 AS parse_error FROM events")
def answer_json(t):
    fence = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    text = F.when(F.col("event_id") % 5 == 0, fence).when(F.col("event_id") % 5 == 1, "no answer").when(F.col("event_id") % 5 == 2, F.concat(F.lit("Sure! "), "props")).otherwise(F.col("props"))
    return t("events").select("event_id", governance.answer_json(text, "k long").alias("a")).select("event_id", "a.value.k", "a.parse_error")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey NOT IN (3, 10, 11)")
def queue_antijoin(t):
    done = t("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return governance.queue(t("customer").select("c_custkey"), done, "c_custkey", exclude=["3", "10", "11"])


@query("""SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN ['FS', 'WL', 'XX'][p_size % 3 + 1] END AS code, CASE WHEN p_size % 3 > 0 THEN ['Floor Slab', 'Wall', 'XX'][p_size % 3 + 1] END AS label FROM part""")
def archetype(t):
    ident = F.when(F.col("p_size") % 3 == 0, F.lit("FRAG-FS-1")).otherwise(F.concat(F.lit("FRAG-S1-"), F.element_at(F.array(F.lit("FS"), F.lit("WL"), F.lit("XX")), F.col("p_size") % 3 + 1), F.lit("-007")))
    return t("part").select("p_partkey", governance.archetype(ident, {"FS": "Floor Slab", "WL": "Wall"}).alias("a")).select("p_partkey", "a.code", "a.label")


@query("""WITH x AS (SELECT l_orderkey AS k, 'f' || l_partkey || ['.obj', '.PLY', '.glb', '.txt'][l_suppkey % 4 + 1] AS path, [3, 1, 2, 0][l_suppkey % 4 + 1] AS r FROM lineitem) SELECT k, path FROM x WHERE r > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY r, path) = 1""")
def source_priority(t):
    ext = F.element_at(F.array(*map(F.lit, (".obj", ".PLY", ".glb", ".txt"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return governance.first_source(t("lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("f"), "l_partkey", ext).alias("path")), "k", "path")


# ---- regions: parts are surface cells, joined by lineitem's pairs of parts and suppliers

_CELLS = """WITH c AS (SELECT p_partkey AS cell, CASE WHEN p_size % 3 = 0 THEN 'face ' || p_size % 5 ELSE p_type END AS region, CASE WHEN p_size % 3 = 0 THEN (p_size % 5)::BIGINT END AS face, p_size / 2.0 AS area FROM part),
n AS (SELECT count(*) AS n FROM part), e AS (SELECT l_partkey AS a, (l_partkey + l_suppkey) % n AS b FROM lineitem, n)
"""


def _cells(t):
    s = F.col("p_size")
    return t("part").select(F.col("p_partkey").alias("cell"), F.when(s % 3 == 0, F.concat(F.lit("face "), s % 5)).otherwise(F.col("p_type")).alias("region"), F.when(s % 3 == 0, (s % 5).cast("long")).alias("face"), (s / 2.0).alias("area"))


@query(_CELLS + """, p AS (SELECT x.region AS rx, x.face AS fx, y.region AS ry, y.face AS fy FROM e JOIN c x ON a = x.cell JOIN c y ON b = y.cell WHERE x.region <> y.region),
    v AS (SELECT rx AS region, fy AS face FROM p WHERE fx IS NULL AND fy IS NOT NULL UNION ALL SELECT ry, fx FROM p WHERE fy IS NULL AND fx IS NOT NULL), k AS (SELECT region, face, count(*) AS n FROM v GROUP BY 1, 2)
    SELECT region, face, n / t AS boundary_share FROM (SELECT *, sum(n) OVER (PARTITION BY region) AS t FROM k) WHERE n / t >= 0.15 QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, face) = 1""")
def boundary_share_argmax(t):
    """The operator with a bound of 0.15, as no part type here has half of its boundary at one face (the default)."""
    n = t("part").count()
    e = t("lineitem").select(F.col("l_partkey").alias("a"), ((F.col("l_partkey") + F.col("l_suppkey")) % n).alias("b"))
    return regions.adjacent(_cells(t), e, 0.15)


@query("""WITH c AS (SELECT p_partkey AS cell, p_type AS region, p_size AS area FROM part), r AS (SELECT *, cell - row_number() OVER (PARTITION BY region ORDER BY cell) AS g FROM c),
    k AS (SELECT region, g, count(*) AS n, sum(area)::DOUBLE AS s FROM r GROUP BY 1, 2), m AS (SELECT region, count(*) FILTER (n > 1) AS n_patches, coalesce(max(s) FILTER (n > 1), 0) AS contiguous_area FROM k GROUP BY 1) SELECT * FROM m""")
def patches(t):
    """Cells lie in a row; a patch is a stretch of two or more cells of one region."""
    c = t("part").select(F.col("p_partkey").alias("cell"), F.col("p_type").alias("region"), F.col("p_size").cast("double").alias("area"))
    return regions.patches(c, t("part").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b")))


_STEP = """, {w} AS (SELECT a, l FROM (SELECT s.a, n.l, count(*) AS k FROM s JOIN {n} n ON s.b = n.cell JOIN {n} m ON s.a = m.cell WHERE n.l IS NOT NULL AND m.l IS NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY a ORDER BY k DESC, l) = 1),
{o} AS (SELECT n.cell, coalesce(n.l, w.l) AS l FROM {n} n LEFT JOIN {w} w ON n.cell = w.a)"""


@query("WITH e AS (SELECT p_partkey AS a, p_partkey + 1 AS b FROM part UNION SELECT p_partkey, p_partkey + 7 FROM part), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n0 AS (SELECT p_partkey AS cell, CASE WHEN p_size % 9 = 0 THEN p_size END AS l FROM part)"
    + "".join(_STEP.format(w=f"w{k}", n=f"n{k}", o=f"n{k + 1}") for k in range(3)) + " SELECT n3.cell, n3.l::BIGINT AS label, n0.l IS NULL AND n3.l IS NOT NULL AS inferred FROM n3 JOIN n0 USING (cell)")
def label_propagation(t):
    """Three rounds, which the SQL unrolls; the operator's default is twelve."""
    k = F.col("p_partkey")
    e = t("part").select(k.alias("a"), F.explode(F.array(k + 1, k + 7)).alias("b"))
    lab = t("part").select(k.alias("cell"), F.when(F.col("p_size") % 9 == 0, F.col("p_size")).alias("label"))
    return regions.propagate(lab, e, rounds=3).withColumn("label", F.col("label").cast("long"))


@query("""SELECT doc_id, CASE WHEN text IS NULL OR doc_id % 13 = 0 THEN 'no_uv_footprint' WHEN n_chars % 100 / 100.0 < 0.5 THEN 'fragmented_uv' WHEN doc_id % 50 / 100.0 < 0.2 THEN 'sparse_uv' WHEN doc_id % 97 / 97.0 >= 0.5 THEN 'unreliable_texture' END AS skipped FROM documents""")
def gate_cascade(t):
    d = F.col("doc_id")
    return t("documents").select("doc_id", regions.skipped(F.col("text").isNotNull() & (d % 13 != 0), F.col("n_chars") % 100 / 100.0, d % 50 / 100.0, d % 97 / 97.0).alias("skipped"))


@query("""WITH k AS (SELECT user_id AS cell, event_type AS region, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT cell, region FROM k QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n DESC, region) = 1),
    x AS (SELECT user_id AS cell, avg((value > 70)::INTEGER) >= 0.3 AS excluded FROM events GROUP BY 1) SELECT cell, CASE WHEN NOT excluded THEN region END AS region, excluded FROM x LEFT JOIN b USING (cell)""")
def cell_winner(t):
    return regions.cell_winner(t("events").select(F.col("user_id").alias("cell"), F.col("event_type").alias("region"), (F.col("value") > 70).alias("masked")))


@query("SELECT p_type AS fragment_id, p_partkey, (row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) - 1)::INTEGER AS region_id FROM part")
def region_renumber(t):
    r = t("part").select(F.col("p_type").alias("fragment_id"), F.col("p_partkey").alias("region_id"), "p_partkey", (F.col("p_size") / 100.0).alias("area_frac"))
    return regions.renumber(r).select("fragment_id", "p_partkey", "region_id")


# ---- geometry: parts of embedding vectors are points and normals

_VEC = "WITH v AS (SELECT vec_id, label, list_transform(embedding[1:9], lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL)"


def _vec(t):
    return t("embeddings").filter("embedding is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


PLANES = [(0, [1.0, 0.0, 0.0], 0.0), (1, [0.0, 1.0, 0.0], 0.02), (2, [0.0, 0.0, 1.0], -0.05), (3, [0.6, 0.8, 0.0], 0.1)]


@query(_VEC + """, n AS (SELECT vec_id, e, sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6]) AS s FROM v),
    p AS (SELECT * FROM (VALUES (0, 1.0, 0.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0, 0.02), (2, 0.0, 0.0, 1.0, -0.05), (3, 0.6, 0.8, 0.0, 0.1)) x(plane, x, y, z, d)),
    h AS (SELECT vec_id, plane, abs(e[1] * x + e[2] * y + e[3] * z + d) AS dist FROM n, p WHERE dist < 0.15 AND abs(e[4] / s * x + e[5] / s * y + e[6] / s * z) >= cos(radians(30))),
    b AS (SELECT vec_id, plane, dist FROM h QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, plane) = 1)
    SELECT vec_id, plane::BIGINT AS plane, round(dist, 6) AS distance FROM v LEFT JOIN b USING (vec_id)""")
def nearest_qualifying(t):
    e = F.col("e")
    s = geometry.norm(F.slice(e, 4, 3))
    f = _vec(t).select("vec_id", F.slice(e, 1, 3).alias("centre"), F.transform(F.slice(e, 4, 3), lambda x: x / s).alias("normal"))
    got = geometry.nearest_plane(f, PLANES, limit=0.15)
    return got.select("vec_id", F.col("plane").cast("long").alias("plane"), F.round("distance", 6).alias("distance"))


@query(_VEC + """, p AS (SELECT vec_id, label, e, sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6]) AS s FROM v), q AS (SELECT vec_id, label, e[1] AS x, e[2] AS y, e[3] AS z, e[4] / s AS a, e[5] / s AS b, e[6] / s AS c FROM p),
    j AS (SELECT l.label, l.vec_id, r.a, r.b, r.c FROM q l JOIN q r ON l.label = r.label AND (l.x - r.x) ** 2 + (l.y - r.y) ** 2 + (l.z - r.z) ** 2 <= 0.01),
    m AS (SELECT label, vec_id, count(*) AS n, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM j GROUP BY 1, 2), u AS (SELECT label, vec_id, sqrt(a * a + b * b + c * c) AS s, a, b, c FROM m WHERE n >= 3),
    w AS (SELECT j.label, j.vec_id, stddev_pop(acos(least(greatest((j.a * u.a + j.b * u.b + j.c * u.c) / s, -1), 1))) AS r FROM j JOIN u USING (label, vec_id) GROUP BY 1, 2)
    SELECT label, vec_id AS id, n AS neighbours, round(r, 6) AS roughness FROM m LEFT JOIN w USING (label, vec_id)""")
def radius_neighbourhood(t):
    e = F.col("e")
    s = geometry.norm(F.slice(e, 4, 3))
    p = _vec(t).select("label", F.col("vec_id").alias("id"), *[e[k].alias(c) for k, c in enumerate("xyz")], *[(e[k + 3] / s).alias("n" + c) for k, c in enumerate("xyz")])
    return geometry.roughness(p, "label", 0.1).withColumn("roughness", F.round("roughness", 6))


_TRI = _VEC + """, d AS (SELECT vec_id, label, e, e[4] - e[1] AS ux, e[5] - e[2] AS uy, e[6] - e[3] AS uz, e[7] - e[1] AS vx, e[8] - e[2] AS vy, e[9] - e[3] AS vz FROM v),
    x AS (SELECT *, sqrt((uy * vz - uz * vy) ** 2 + (uz * vx - ux * vz) ** 2 + (ux * vy - uy * vx) ** 2) / 2 AS area,
    (e[1] * (e[5] * e[9] - e[6] * e[8]) + e[2] * (e[6] * e[7] - e[4] * e[9]) + e[3] * (e[4] * e[8] - e[5] * e[7])) / 6 AS vol FROM d)"""


def _tri(t):
    e = F.col("e")
    return _vec(t).select("vec_id", "label", F.slice(e, 1, 3).alias("a"), F.slice(e, 4, 3).alias("b"), F.slice(e, 7, 3).alias("c"))


@query(_TRI + "SELECT label, count(*) AS faces, round(sum(area), 6) AS area, round(abs(sum(vol)), 8) AS volume, round(sum(area * (e[1] + e[4] + e[7]) / 3) / sum(area), 6) AS centre_x FROM x GROUP BY 1")
def mesh_totals(t):
    m = geometry.totals(_tri(t), "label")
    return m.select("label", "faces", F.round("area", 6).alias("area"), F.round("volume", 8).alias("volume"), F.round(F.col("centroid")[0], 6).alias("centre_x"))


@query("""WITH t AS (SELECT l_returnflag AS k, l_partkey % 20 AS i, l_suppkey % 10 + 20 AS j, l_linenumber % 7 + 30 AS m FROM lineitem), e AS (SELECT k, i AS p, j AS q FROM t UNION ALL SELECT k, j, m FROM t UNION ALL SELECT k, m, i FROM t)
    SELECT k, least(p, q) AS u, greatest(p, q) AS v, count(*) AS n, sum(CASE WHEN p < q THEN 1 ELSE -1 END)::BIGINT AS balance FROM e GROUP BY ALL""")
def mesh_edges(t):
    return geometry.edges(t("lineitem").select(F.col("l_returnflag").alias("k"), (F.col("l_partkey") % 20).alias("i"), (F.col("l_suppkey") % 10 + 20).alias("j"), (F.col("l_linenumber") % 7 + 30).cast("long").alias("k2")).withColumnRenamed("k", "mesh").withColumnRenamed("k2", "k"), "mesh").withColumnRenamed("mesh", "k")


@query("""WITH b AS (SELECT p_partkey, p_size % 5 = 0 AS w, p_size % 2 = 0 AS c, p_size * 1e7 AS vol, p_retailprice * 5e5 AS hull FROM part), s AS (SELECT *, CASE WHEN w THEN 'mesh' WHEN c AND vol / hull BETWEEN 0.2 AND 1 THEN 'mesh_nearly_closed' ELSE 'convex_hull' END AS src FROM b)
    SELECT p_partkey, src AS volume_source, CASE WHEN src <> 'convex_hull' THEN round(vol / hull, 6) END AS convexity, round(CASE WHEN src = 'convex_hull' THEN hull ELSE vol END * 1e-9 * 2500, 6) AS mass_kg_est FROM s""")
def volume_source(t):
    s = F.col("p_size")
    b = geometry.bounding(t("part"), s * 1e7, F.col("p_retailprice") * 5e5, s % 5 == 0, s % 2 == 0)
    return b.select("p_partkey", "volume_source", F.round("convexity", 6).alias("convexity"), F.round("mass_kg_est", 6).alias("mass_kg_est"))


@query("""WITH v AS (SELECT p_partkey AS id, round(p_size / 5)::BIGINT AS x, round(p_retailprice / 5)::BIGINT AS y FROM part), f AS (SELECT id, min(id) OVER (PARTITION BY x, y) AS r FROM v), n AS (SELECT count(*) AS n FROM part),
    t AS (SELECT row_number() OVER () AS w, l_partkey AS i, (l_partkey + 1) % n AS j, (l_partkey + l_suppkey) % n AS k FROM lineitem, n)
    SELECT a.r AS i, b.r AS j, c.r AS k, count(*) AS n FROM t JOIN f a ON i = a.id JOIN f b ON j = b.id JOIN f c ON k = c.id WHERE a.r <> b.r AND b.r <> c.r AND a.r <> c.r GROUP BY ALL""")
def weld(t):
    n = t("part").count()
    v = t("part").select(F.lit(0).alias("mesh"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.lit(0.0).alias("z"))
    p = F.col("l_partkey")
    tri = t("lineitem").select(F.lit(0).alias("mesh"), p.alias("i"), ((p + 1) % n).alias("j"), ((p + F.col("l_suppkey")) % n).alias("k"))
    return geometry.weld(v, tri, "mesh", 5.0).groupBy("i", "j", "k").agg(F.count(F.lit(1)).alias("n"))


@query(_TRI + """, c AS (SELECT unnest([vec_id % 40, vec_id % 40 + 1, vec_id % 40 + 2]) AS id, label, uy * vz - uz * vy AS x, uz * vx - ux * vz AS y, ux * vy - uy * vx AS z FROM x), s AS (SELECT label, id, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM c GROUP BY 1, 2)
    SELECT label, id, round(x / sqrt(x * x + y * y + z * z), 6) AS nx, round(z / sqrt(x * x + y * y + z * z), 6) AS nz FROM s""")
def vertex_normals(t):
    k = F.col("vec_id") % 40
    n = geometry.vertex_normals(_tri(t).withColumns({"i": k, "j": k + 1, "k": k + 2}), "label")
    return n.select("label", "id", F.round(F.col("normal")[0], 6).alias("nx"), F.round(F.col("normal")[2], 6).alias("nz"))


@query(_VEC + """, r AS (SELECT label, e[1] AS x, e[2] AS y, e[3] AS z, coalesce(lead(e[1]) OVER w, first(e[1]) OVER a) AS p, coalesce(lead(e[2]) OVER w, first(e[2]) OVER a) AS q, coalesce(lead(e[3]) OVER w, first(e[3]) OVER a) AS s FROM v
    WINDOW w AS (PARTITION BY label ORDER BY vec_id), a AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT label, round(sum((y - q) * (z + s)), 6) AS nx, round(sum((z - s) * (x + p)), 6) AS ny, round(sum((x - p) * (y + q)), 6) AS nz FROM r GROUP BY 1""")
def newell_normal(t):
    n = geometry.newell(_vec(t).select("label", "vec_id", *[F.col("e")[k].alias(c) for k, c in enumerate("xyz")]), "label", "vec_id")
    return n.select("label", *[F.round(F.col("normal")[k], 6).alias("n" + c) for k, c in enumerate("xyz")])


@query(_VEC + """, f AS (SELECT vec_id, label, e[2] * 1000 AS y, abs(e[4] * 0.1 + e[5] * 0.9 + e[6] * -0.2) / sqrt(0.86) >= cos(radians(20)) * 0.1 AS near FROM v), m AS (SELECT label, min(y) AS low FROM f WHERE near GROUP BY 1)
    SELECT vec_id, CASE WHEN low IS NOT NULL THEN near AND y < low + 80 END AS unscanned FROM f LEFT JOIN m USING (label)""")
def unscanned_faces(t):
    """Normals are scaled by ten, so that some come near the side's direction."""
    e = F.col("e")
    f = _vec(t).select("vec_id", "label", F.transform(F.slice(e, 4, 3), lambda x: x * 10).alias("normal"), F.transform(F.slice(e, 1, 3), lambda x: x * 1000).alias("centre"))
    return geometry.unscanned(f, "label", F.array(F.lit(0.1), F.lit(0.2), F.lit(0.9))).select("vec_id", "unscanned")


@query("""WITH f AS (SELECT p_brand AS mesh, CASE WHEN p_size % 4 = 0 THEN p_size % 8 END AS plane, CASE WHEN p_size % 3 = 0 THEN p_size % 5 END AS cluster, p_retailprice AS area, p_size % 10 <> 7 AS open FROM part),
    s AS (SELECT mesh, count(*) AS every, sum(area) FILTER (open) AS total FROM f GROUP BY 1), n AS (SELECT mesh, CASE WHEN plane IS NOT NULL THEN 'plane ' || lpad(plane::VARCHAR, 12, '0') WHEN cluster IS NOT NULL THEN 'rough ' || lpad(cluster::VARCHAR, 12, '0') ELSE 'residual' END AS part, count(*) AS n, sum(area) AS area FROM f WHERE open GROUP BY 1, 2),
    p AS (SELECT mesh, CASE WHEN part LIKE 'rough%' AND n < greatest(every * 0.01, 50) THEN 'residual' ELSE part END AS part, sum(area) AS area, any_value(total) AS total FROM n JOIN s USING (mesh) GROUP BY 1, 2),
    q AS (SELECT mesh, CASE WHEN round(area / total, 4) < 0.02 THEN 'residual' ELSE part END AS part, sum(area) AS area, any_value(total) AS total FROM p GROUP BY 1, 2)
    SELECT mesh, part, CASE WHEN part LIKE 'plane%' THEN 'plane' WHEN part = 'residual' THEN 'residual' ELSE 'cluster' END AS kind, round(area, 4) AS area, round(area / total, 4) AS area_frac, (row_number() OVER (PARTITION BY mesh ORDER BY round(area / total, 4) DESC, part) - 1)::INTEGER AS region_id FROM q""")
def region_assembly(t):
    s = F.col("p_size")
    f = t("part").select(F.col("p_brand").alias("mesh"), F.when(s % 4 == 0, s % 8).alias("plane"), F.when(s % 3 == 0, s % 5).alias("cluster"), F.col("p_retailprice").alias("area"), (s % 10 == 7).alias("unscanned"))
    return geometry.assemble(f, "mesh").withColumn("area", F.round("area", 4))


@query("SELECT p_partkey, round(sqrt(p_size / 100.0 * 4096 * 4096 / nullif(p_retailprice * (p_size % 3), 0)), 6) AS density FROM part")
def texel_density(t):
    m = t("part").select("p_partkey", (F.col("p_size") / 100.0).alias("uv_area"), F.lit(4096.0).alias("atlas_px"), (F.col("p_retailprice") * (F.col("p_size") % 3)).alias("area_mm2"))
    return geometry.texel_density(m).select("p_partkey", F.round("density", 6).alias("density"))


@query("""WITH d AS (SELECT p_partkey, unnest([p_size % 7, p_partkey % 5, 3]) AS dim, generate_subscripts([1, 2, 3], 1) AS i FROM part) SELECT p_partkey, string_agg(dim || ':' || i, ' ' ORDER BY dim DESC, i) AS dims FROM d GROUP BY 1""")
def sorted_dims(t):
    d = geometry.sorted_dims(F.array((F.col("p_size") % 7).cast("long"), F.col("p_partkey") % 5, F.lit(3).cast("long")), F.array(F.lit(1), F.lit(2), F.lit(3)))
    return t("part").select("p_partkey", F.array_join(F.transform(d, lambda x: F.concat(x["dim"].cast("string"), F.lit(":"), x["axis"].cast("string"))), " ").alias("dims"))


@query(_VEC + """, s AS (SELECT label, greatest(max(e[1]) - min(e[1]), max(e[2]) - min(e[2]), max(e[3]) - min(e[3])) * CASE WHEN label % 2 = 0 THEN 1 ELSE 500 END AS x FROM v GROUP BY 1)
    SELECT vec_id, round(e[1] * CASE WHEN label % 2 = 0 THEN 1 ELSE 500 END * CASE WHEN x < 10 THEN 1000 ELSE 1 END, 6) AS x, CASE WHEN s.x < 10 THEN 1000.0::DOUBLE ELSE 1 END AS scale, s.x * CASE WHEN s.x < 10 THEN 1000 ELSE 1 END BETWEEN 50 AND 5000 AS plausible FROM v JOIN s USING (label)""".replace("CASE WHEN x < 10", "CASE WHEN s.x < 10"))
def autoscale(t):
    by = F.when(F.col("label") % 2 == 0, 1).otherwise(500)
    p = _vec(t).select("vec_id", "label", *[(F.col("e")[k] * by).alias(c) for k, c in enumerate("xyz")])
    return geometry.autoscaled(p, "label").select("vec_id", F.round("x", 6).alias("x"), "scale", "plausible")


@query(_VEC + "SELECT vec_id, round(e[1] - avg(e[1]) OVER (PARTITION BY label), 6) AS x, round(e[3] - avg(e[3]) OVER (PARTITION BY label), 6) AS z FROM v")
def centred(t):
    p = _vec(t).select("vec_id", "label", *[F.col("e")[k].alias(c) for k, c in enumerate("xyz")])
    return geometry.centred(p, "label").select("vec_id", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))


# ---- pixels

@query("""WITH RECURSIVE p AS (SELECT DISTINCT l_suppkey AS mask, l_partkey % 40 AS x, (l_orderkey + l_linenumber) % 40 AS y FROM lineitem),
    r AS (SELECT mask, x, y, x AS u, y AS v FROM p UNION SELECT r.mask, r.x, r.y, p.x, p.y FROM r JOIN p ON r.mask = p.mask AND abs(r.u - p.x) + abs(r.v - p.y) = 1), c AS (SELECT mask, x, y, min(v * 40 + u) AS blob FROM r GROUP BY 1, 2, 3),
    k AS (SELECT mask, blob, count(*) AS n FROM c GROUP BY 1, 2) SELECT mask, sum(n)::BIGINT AS pixels, max(n) / sum(n) AS coherence FROM k GROUP BY 1""")
def uv_coherence(t):
    p = t("lineitem").select(F.col("l_suppkey").alias("mask"), (F.col("l_partkey") % 40).alias("x"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 40).alias("y"))
    return raster.coherence(p, "mask")


@query("""WITH b AS (SELECT user_id, (event_id * 37 % 256 >> 6) * 16 + (event_id * 91 % 256 >> 6) * 4 + (event_id * 13 % 256 >> 6) AS bin FROM events), k AS (SELECT user_id, bin, count(*) AS n FROM b GROUP BY 1, 2), s AS (SELECT user_id, sum(n)::BIGINT AS pixels, -sum(n / t * log2(n / t)) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY user_id) AS t FROM k) GROUP BY 1)
    SELECT user_id, pixels, CASE WHEN pixels >= 64 THEN round(h, 3) END AS entropy FROM s""")
def colour_entropy(t):
    e = F.col("event_id")
    return raster.colour_entropy(t("events").select("user_id", *[(e * k % 256).alias(c) for k, c in ((37, "r"), (91, "g"), (13, "b"))]), "user_id")


@query("SELECT user_id, avg((value < 40)::INTEGER) >= 0.5 AS empty FROM events GROUP BY 1")
def empty_cells(t):
    return raster.empty_cells(t("events"), ["user_id"], "value", 40, 0.5)


_BOX = "SELECT p_partkey, p_size / 100.0 AS x1, p_partkey % 30 / 40.0 AS y1, p_size / 100.0 + p_partkey % 9 / 20.0 AS x2, 0.9 AS y2, p_size % 10 / 10.0 AS m FROM part"


def _box(t):
    s, k = F.col("p_size"), F.col("p_partkey")
    return t("part").select("p_partkey", F.struct((s / 100.0).alias("x1"), (k % 30 / 40.0).alias("y1"), (s / 100.0 + k % 9 / 20.0).alias("x2"), F.lit(0.9).alias("y2")).alias("b"), (s % 10 / 10.0).alias("m"))


@query(f"""WITH b AS ({_BOX}) SELECT p_partkey, CASE WHEN NOT (x1 BETWEEN 0 AND 1 AND y1 BETWEEN 0 AND 1 AND x2 BETWEEN 0 AND 1 AND x1 < x2 AND y1 < y2) THEN 'malformed'
    WHEN abs(x1 * 20 - round(x1 * 20)) < 1e-6 AND abs(y1 * 20 - round(y1 * 20)) < 1e-6 AND abs(x2 * 20 - round(x2 * 20)) < 1e-6 THEN 'stock' WHEN m < 0.5 THEN 'off the mask' END AS fault FROM b""")
def box_validation(t):
    return _box(t).select("p_partkey", raster.box_fault(F.col("b"), F.col("m")).alias("fault"))


@query(f"""WITH b AS ({_BOX}), i AS (SELECT *, greatest(least(x2, 0.7) - greatest(x1, 0.1), 0) * greatest(least(y2, 0.6) - greatest(y1, 0.2), 0) AS s FROM b) SELECT p_partkey, round(s / (greatest(x2 - x1, 0) * greatest(y2 - y1, 0) + 0.6 * 0.4 - s), 6) AS iou FROM i""")
def box_iou(t):
    fixed = F.struct(*[F.lit(v).alias(n) for n, v in (("x1", 0.1), ("y1", 0.2), ("x2", 0.7), ("y2", 0.6))])
    return _box(t).select("p_partkey", F.round(raster.iou(F.col("b"), fixed), 6).alias("iou"))


@query("""WITH p AS (SELECT l_partkey % 40 AS x, l_suppkey % 25 AS y, l_returnflag AS label FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey % 40, l_suppkey % 25 ORDER BY l_orderkey DESC, l_returnflag DESC) = 1)
    SELECT label, count(*) AS pixels, count(*) / sum(count(*)) OVER () AS share FROM p GROUP BY 1""")
def painted_labels(t):
    m = t("lineitem").select((F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 25).alias("y"), "l_orderkey", F.col("l_returnflag").alias("label"))
    return raster.labels_in(raster.painted(m, "l_orderkey", "label"), "label")


@query("""WITH w AS (SELECT c_custkey AS cell, c_nationkey AS region, c_custkey % 6 = 0 AS excluded FROM customer), a AS (SELECT user_id AS cell, event_type AS label, max(value) / 100 AS cover FROM events GROUP BY 1, 2), b AS (SELECT cell, label FROM a WHERE cover >= 0.9 QUALIFY row_number() OVER (PARTITION BY cell ORDER BY cover DESC, label DESC) = 1)
    SELECT w.cell, CASE WHEN NOT excluded THEN coalesce(b.label, n_name) END AS label, CASE WHEN NOT excluded THEN CASE WHEN b.label IS NOT NULL THEN 'anomaly' WHEN n_name IS NOT NULL THEN 'region' END END AS source FROM w LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 3 > 0) ON region = n_nationkey LEFT JOIN b USING (cell)""")
def region_cells(t):
    w = t("customer").select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("region"), (F.col("c_custkey") % 6 == 0).alias("excluded"))
    r = t("nation").filter("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("region"), F.col("n_name").alias("label"))
    a = t("events").groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("label")).agg((F.max("value") / 100).alias("cover"))
    return raster.cells(w, r, a, 0.9)


@query("""WITH i AS (SELECT p_type AS label, p_name || p_partkey AS image, 90 + p_size * 9 AS w, 500 - p_size AS h, p_size % 8 / 50.0 AS filler, p_size % 11 AS detail, p_size % 13 = 0 AS transparent FROM part), n AS (SELECT label, count(*) AS n FROM i GROUP BY 1)
    SELECT label, image, unnest(list_filter([CASE WHEN NOT (w BETWEEN 100 AND 512 AND h BETWEEN 100 AND 512) THEN 'size' END, CASE WHEN filler > 0.1 THEN 'filler' END, CASE WHEN detail < 4 THEN 'detail' END, CASE WHEN transparent THEN 'transparent' END], lambda x: x IS NOT NULL)) AS fault FROM i
    UNION ALL SELECT label, NULL, 'too many' FROM n WHERE n > 4 UNION ALL SELECT label, NULL, 'imbalance' FROM n WHERE (SELECT max(n) FROM n) >= 2 * n AND (SELECT max(n) FROM n) - n >= 2""")
def exemplar_faults(t):
    s = F.col("p_size")
    i = t("part").select(F.col("p_type").alias("label"), F.concat("p_name", "p_partkey").alias("image"), (90 + s * 9).alias("width"), (500 - s).alias("height"), (s % 8 / 50.0).alias("filler"), (s % 11).alias("detail"), (s % 13 == 0).alias("transparent"))
    return raster.exemplar_faults(i)


@query(_VEC + """, q AS (SELECT vec_id, label, e[1] AS x, e[2] AS y, e[3] AS z, vec_id % 17 = 0 AS un FROM v), p AS (SELECT * FROM (VALUES (0, 1.0, 0.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0, 0.02), (2, 0.0, 0.0, 1.0, -0.05), (3, 0.6, 0.8, 0.0, 0.1)) t(plane, a, b, c, d)),
    h AS (SELECT vec_id, plane FROM q, p WHERE abs(x * a + y * b + z * c + d) < 0.03 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(x * a + y * b + z * c + d), plane) = 1),
    m AS (SELECT label, (max(x) + min(x)) / 2 AS mx, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2 AS h FROM q GROUP BY 1)
    SELECT vec_id AS id, CASE WHEN un THEN 100 ELSE coalesce(plane, -1) END AS code, round((x - mx) / h, 6) AS x FROM q JOIN m USING (label) LEFT JOIN h USING (vec_id)""")
def viewer_sample(t):
    p = _vec(t).select("label", F.col("vec_id").alias("id"), *[F.col("e")[k].alias(c) for k, c in enumerate("xyz")], (F.col("vec_id") % 17 == 0).alias("unscanned"))
    return geometry.viewer(p, "label", PLANES, 0.03).select("id", "code", F.round("x", 6).alias("x"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN floor(event_id % 256 * (1 - 0.72) + 200 * 0.72) ELSE floor(event_id % 256 * 0.18) END::INTEGER AS red FROM events")
def overlay(t):
    return t("events").select("event_id", raster.overlay(F.col("event_id") % 256, F.lit(200), F.col("event_type") == "error", dim=0.18).alias("red"))
