"""License scan by diagonal voting: k-gram hashes joined to template positions, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER

K = 3
#: Phrases that a contract fixes: each place counts.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that the method adds: a merged diagonal must cover the stated share of their k-grams.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache-2",
    "this work is licensed under a creative commons attribution noncommercial license": "cc-by-nc",
    "licensed under the gnu general public license version 3": "gpl-3",
    "redistribution and use in source and binary forms with or without modification are permitted provided that": "bsd",
    "you should have received a copy of the gnu general public license along with this program": "gpl",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "this program and the accompanying materials are made available under the terms of the eclipse public license": "epl",
}
#: A span takes the votes of the diagonals from its own to BAND further: so many words may be added in all.
COVER, BAND = 0.8, 4


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def _templates(spark: SparkSession, base: dict, extra: dict, k: int) -> DataFrame:
    rows = []
    for t, (phrase, label) in enumerate([*base.items(), *extra.items()]):
        w = phrase.split()
        rows += [(t, p, " ".join(w[p : p + k]), len(w) - k + 1, label, t < len(base)) for p in range(len(w) - k + 1)]
    return spark.createDataFrame(rows, "t int, p int, gram string, grams int, label string, is_base boolean").withColumn("hash", F.xxhash64(*[F.split("gram", " ")[j] for j in range(k)]))


def scan(docs: DataFrame, base: dict = BASE, extra: dict = TEMPLATES, k: int = K) -> DataFrame:
    """One row per document: words, places of the base phrases, labels, score and the verified spans.

    Every rolling k-gram's hash is compared with those of the templates (a fixed list of some hundred positions) and those that match
    are joined to the positions by hash and text; only hits and one marker a document are shuffled. Hits vote for diagonals (document
    position minus template position). From each diagonal, those up to BAND further merge into a span, so every counted position
    lies where the template puts it, but for BAND words. A base span is verified as all k-grams on one diagonal, the others as
    COVER of them. Null texts are empty; rows with equal doc_id and text are told apart by count and come back as often
    as they came; texts under k words give no hit. A text's words are held in one row, however many. score: the largest share of a
    template covered. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_x"))
    d = d.select("doc_id", F.xxhash64("_x").alias("_key"), words(F.col("_x")).alias("_w"))
    n = F.size("_w")
    templates = _templates(spark, base, extra, k)
    wanted = [r[0] for r in templates.select("hash").distinct().collect()]
    gram = lambda i: F.array_join(F.slice("_w", i + 1, k), " ")
    starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    rolling = lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(k)])
    grams = F.transform(F.filter(starts, lambda i: rolling(i).isin(wanted)), lambda i: F.struct(i.alias("i"), gram(i).alias("g")))
    mark = F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("g")))
    long = d.select("doc_id", "_key", n.cast("long").alias("n_words"), F.explode(F.concat(mark, grams)).alias("_g"))
    long = long.select("doc_id", "_key", "n_words", F.col("_g.i").alias("i"), F.col("_g.g").alias("g"))
    hits = long.join(F.broadcast(templates.drop("hash")), F.col("g") == F.col("gram"), "left").filter(F.col("t").isNotNull() | (F.col("i") < 0))
    who = ["doc_id", "_key", "n_words"]
    # Repeated rows double every hit: distinct positions are counted, the marker's count brings the rows back.
    votes = hits.groupBy(*who, "t", (F.col("i") - F.col("p")).alias("start")).agg(
        F.count(F.lit(1)).alias("_n"), F.collect_set("p").alias("ps"), F.first("grams").alias("grams"), F.first("label").alias("label"), F.first("is_base").alias("is_base"))
    band = Window.partitionBy(*who, "t").orderBy("start").rangeBetween(0, BAND)
    merged = F.size(F.array_distinct(F.flatten(F.collect_list("ps").over(band))))
    spans = votes.withColumn("cover", F.when(F.col("is_base"), F.size("ps")).otherwise(merged))
    share = F.col("cover") / F.col("grams")
    ok_base = F.col("is_base") & (F.col("cover") == F.col("grams"))
    ok = ok_base | (share >= COVER)
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy(*who).agg(
        F.max(F.when(F.col("t").isNull(), F.col("_n"))).alias("_copies"),
        F.count(F.when(ok_base, 1)).cast("long").alias("n_base"),
        F.min(F.when(ok_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(ok_base, F.col("start"))).cast("long").alias("last_word"),
        names(ok_base).alias("base_labels"), names(ok).alias("labels"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("score"))
    return out.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9(documents: DataFrame) -> DataFrame:
    return scan(documents)


_PHRASES = ", ".join(f"({t}, '{phrase}', '{label}', {t < len(BASE)})" for t, (phrase, label) in enumerate([*BASE.items(), *TEMPLATES.items()]))
_GRAM = " || ' ' || ".join(f"w[{{0}} + {j + 1}]" for j in range(K))
_SAY = lambda c: f"coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER ({c})), ','), '')"
SQL = f"""
WITH tp AS (SELECT t, string_split(phrase, ' ') AS w, label, is_base FROM (VALUES {_PHRASES}) x(t, phrase, label, is_base)),
tg AS (SELECT t, label, is_base, len(w) - {K - 1} AS grams, p, {_GRAM.format("p")} AS gram FROM (SELECT *, unnest(range(len(w) - {K - 1})) AS p FROM tp)),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, i, {_GRAM.format("i")} AS gram FROM (SELECT r, w, unnest(range(len(w) - {K - 1})) AS i FROM d WHERE len(w) >= {K})),
v AS (SELECT r, t, i - p AS diagonal, list(DISTINCT p) AS ps, any_value(grams) AS grams, any_value(label) AS label, any_value(is_base) AS is_base FROM g JOIN tg USING (gram) GROUP BY r, t, i - p),
u AS (SELECT r, label, is_base, diagonal AS start, grams, len(CASE WHEN is_base THEN ps ELSE list_distinct(flatten(list(ps) OVER (PARTITION BY r, t ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {BAND} FOLLOWING))) END) AS cover FROM v),
s AS (SELECT r, label, start, cover / grams AS share, is_base FROM u),
o AS (SELECT r, count(*) FILTER (is_base AND share = 1) AS n_base, min(start) FILTER (is_base AND share = 1) AS first_word, max(start) FILTER (is_base AND share = 1) AS last_word,
    {_SAY("is_base AND share = 1")} AS base_labels, {_SAY(f"(is_base AND share = 1) OR share >= {COVER}")} AS labels, max(share) AS score FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN o USING (r)
"""
