"""Registered queries of the analytics engine over the star-schema tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shardlake.operators import geometry, graph, rules, votes

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT CASE WHEN l_quantity >= 40 AND l_returnflag = 'R' THEN 'heavy_return' WHEN l_quantity >= 40 THEN 'heavy' WHEN l_discount >= 0.05 THEN 'discounted' ELSE 'plain' END AS outcome,
    CASE WHEN l_quantity >= 40 AND l_returnflag = 'R' THEN 1 WHEN l_quantity >= 40 THEN 2 WHEN l_discount >= 0.05 THEN 3 ELSE 4 END AS rule, count(*) AS n FROM lineitem GROUP BY ALL""")
def first_match_rules(t):
    heavy = F.col("l_quantity") >= 40
    outcome, index = rules.first_match([(heavy & (F.col("l_returnflag") == "R"), "heavy_return"), (heavy, "heavy"), (F.col("l_discount") >= 0.05, "discounted")], "plain")
    return t("lineitem").groupBy(outcome.alias("outcome"), index.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, 'band#' || CASE WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 25 THEN 2 ELSE 3 END || ': flag=' || l_returnflag || ', line=' || l_linenumber AS reason FROM lineitem""")
def rule_trace_reason(t):
    _, index = rules.first_match([(F.col("l_quantity") <= 10, "a"), (F.col("l_quantity") <= 25, "b")], "c")
    return t("lineitem").select("l_orderkey", "l_linenumber", rules.reason("band", index, ("flag", F.col("l_returnflag")), ("line", F.col("l_linenumber"))).alias("reason"))


_RUNS = "WITH e AS (SELECT user_id, event_type, dayofyear(ts) % 3 AS run, event_id FROM events)"


@query(_RUNS + """, r AS (SELECT user_id, count(DISTINCT run) AS runs FROM e GROUP BY 1), v AS (SELECT user_id, event_type, count(DISTINCT run) AS votes FROM e GROUP BY 1, 2)
    SELECT user_id, event_type, votes FROM v JOIN r USING (user_id) WHERE votes >= runs // 2 + 1""")
def majority_vote(t):
    return votes.majority(t("events").withColumn("run", F.dayofyear("ts") % 3), "user_id", "event_type", "run").select("user_id", "event_type", "votes")


@query("""SELECT user_id, event_type, n AS votes FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def plurality_first_seen(t):
    return votes.plurality(t("events"), "user_id", "event_type", "event_id")


@query("""WITH p AS (SELECT lang AS feature, quality = 1 AS a, n_chars >= 500 AS b FROM documents JOIN labels USING (doc_id)), c AS (SELECT feature, count(*) FILTER (a AND b) AS tp,
    count(*) FILTER (NOT a AND b) AS fp, count(*) FILTER (a AND NOT b) AS fn FROM p GROUP BY 1) SELECT feature, tp, fp, fn, tp / nullif(tp + fn, 0) AS recall, tp / nullif(tp + fp, 0) AS precision FROM c""")
def set_precision_recall(t):
    p = t("documents").select("doc_id", "lang", "n_chars").join(t("labels"), "doc_id").select(F.col("lang").alias("feature"), (F.col("quality") == 1).alias("a"), (F.col("n_chars") >= 500).alias("b"))
    return votes.scores(p, "feature", "a", "b")


@query("""SELECT l_returnflag, sum(l_quantity) AS area, sum(l_quantity) / sum(sum(l_quantity)) OVER () AS share FROM lineitem GROUP BY 1""")
def coverage_share(t):
    by = t("lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("area"))
    return by.withColumn("share", F.col("area") / F.sum("area").over(Window.partitionBy()))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), p AS (SELECT user_id, c / sum(c) OVER (PARTITION BY user_id) AS p FROM n)
    SELECT user_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1""")
def entropy(t):
    n = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    p = n.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("user_id")))
    return p.groupBy("user_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


@query("""SELECT event_type, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
    round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY 1""")
def percentile_summary(t):
    return geometry.summary(t("events"), "event_type", "value").select("event_type", "p25", "p75", *[F.round(c, 6).alias(c) for c in ("mean", "std", "rms")])


@query("""SELECT event_id, CASE WHEN value < 25 THEN 'smooth' WHEN value < 45 THEN 'medium' WHEN value < 65 THEN 'rough' ELSE 'very_rough' END AS bucket FROM events WHERE value IS NOT NULL""")
def roughness_bucket(t):
    v = F.col("value")
    return t("events").filter(v.isNotNull()).select("event_id", rules.first_match([(v < 25, "smooth"), (v < 45, "medium"), (v < 65, "rough")], "very_rough")[0].alias("bucket"))


@query(None)
def connected_components(t):
    """Components over every lineitem edge; a recursive CTE is quadratic in them, so it has no SQL."""
    return graph.connected_components(t("lineitem").select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")))


@query("""WITH i AS (SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL),
    t AS (SELECT doc_id, 'quality_' || quality AS label, 0 AS pos FROM i WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 'toxic_' || toxic, 1 FROM i WHERE toxic IS NOT NULL),
    n AS (SELECT label, count(*) AS n, min(doc_id) AS first_doc, min(pos) AS pos FROM t GROUP BY 1), g AS (SELECT * FROM n ORDER BY n DESC, first_doc NULLS LAST, pos, label LIMIT 2),
    c AS (SELECT coalesce((SELECT sum(n) FROM g), 0)::BIGINT AS tp, (SELECT count(*) FROM g) * (SELECT count(*) FROM i) AS said, (SELECT count(*) FROM t) AS truth)
    SELECT tp, (said - tp)::BIGINT AS fp, (truth - tp)::BIGINT AS fn, CASE WHEN truth > 0 THEN tp / truth ELSE 0.0::DOUBLE END AS recall, CASE WHEN said > 0 THEN tp / said ELSE 0.0::DOUBLE END AS precision FROM c""")
def null_model(t):
    """The two commonest labels, of equals the one of the smallest doc_id (quality before toxic), answered for every labelled row."""
    label = lambda c: F.concat(F.lit(f"{c}_"), F.col(c).cast("string"))
    items = t("labels").select("doc_id", F.array_compact(F.array(label("quality"), label("toxic"))).alias("truth")).filter(F.size("truth") > 0)
    return votes.null_model(items, "truth", "doc_id")
