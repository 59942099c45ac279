"""Training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shardlake.llm import chat, decontam, html, langid, license, mixing, quality, simhash, substring, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7), (None, "one two", "fr", None, 7), (4, "x " * 30000, "en", "a", 60000)]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def test_empty_tables(spark):
    d = docs(spark, [])
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (mixing.op5(d), langid.op3(d), quality.op6(d, lab), substring.op7(d), simhash.op8(d), license.op9(d), decontam.op10(d, bench),
                html.op2(spark.createDataFrame([], "page_id long, url string, html string")),
                topk.op4(spark.createDataFrame([], "vec_id long, embedding array<float>")),
                chat.op1(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))):
        assert out.count() == 0


def test_odd_rows_all_come_back(spark):
    d = docs(spark).withColumn("score", F.lit("clash")).withColumn("n_items", F.lit("clash"))
    lab = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two")], "item_id long, text string")
    for out in (mixing.op5(d), langid.op3(d), quality.op6(d, lab), substring.op7(d), simhash.op8(d), license.op9(d), decontam.op10(d, bench)):
        assert out.count() == len(ODD)


def test_common_prefix_and_masks(spark):
    rows = [([("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")]), (None, [("user", "q")]), ([("user", None)], [("user", None)])]
    got = chat.format_preferences(spark.createDataFrame(rows, "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")).collect()
    assert [r.prefix_turns for r in got] == [1, 0, 1]
    assert got[0].prompt == "<|user|>\nq\n" and got[0].chosen_completion == "<|assistant|>\na\n" and got[0].rejected_mask == "16:1"


@pytest.mark.parametrize("seed", range(5))
def test_minimum_cut_is_minimal(seed):
    r = np.random.default_rng(seed)
    n = 8
    unary = [tuple(map(float, x)) for x in r.integers(0, 6, (n, 2))]
    edges = [(i, j, float(r.integers(0, 4))) for i in range(n) for j in range(i) if r.random() < 0.4]
    cost = lambda s: sum(b if x else a for x, (a, b) in zip(s, unary)) + sum(c for i, j, c in edges if s[i] != s[j])
    best = min(cost([m >> k & 1 for k in range(n)]) for m in range(1 << n))
    assert cost(html.minimum_cut(unary, edges)) == pytest.approx(best)


def test_main_text():
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a href=x>Home</a></nav><div class=cookie-notice>We use cookies</div><article><h1>Head &amp; line</h1><p>Some  <b>bold</b>\ntext.<p>More.<div class=ad>Buy</div></article><section id=comments><p>Nice post!</p></section><footer>&copy; x</footer></body></html>"
    assert html.main_text(page) == "Head & line\nSome bold text.\nMore."
    assert html.main_text(None) == html.main_text("") == ""


PARAGRAPHS = ["The harbour town was quiet that morning, and the boats had not yet come home from the northern banks.", "And with.", "Nobody could say, when asked about it later, who had been the first to see the smoke over the lighthouse."]


@pytest.mark.parametrize("page", [
    "<body class='has-sidebar'><article>{}</article></body>", "<div class='layout with-sidebar'><main>{}</main><div class='sidebar-left'>Side text</div></div>",
    "<div class='page-with-header no-comments'><article>{}</article></div>", "<form><input name=x><nav><a href=/>Home</a></nav><article>{}</article><footer>End</footer></form>",
    "<html><head><title>T</title><meta charset=utf-8><body><article>{}</article>", "<html><head><title>T</title><article>{}</article>",
    "<div class='widget banner'><article>{}</article></div>", "<article>{}<footer>By someone</footer></article>",
    "<aside class=related><article><p>Another article is here to be read, with many words of its own to be found in it.</p></article></aside><article>{}</article><section id=comments><article><p>A comment that is quite long and says many things, all of them off the point. It goes on and on, and it never stops going on.</p></article></section>",
    "<div><ul class=breadcrumbs><li><a href=/>Start</a></ul><div class=story>{}</div></div><div class='cookieNotice'>We use cookies. Click to accept them all.</div>",
    "<article><div class=article-header><h1>Title line</h1></div>{}</article>",
])
def test_wrappers_do_not_hide_the_article(page):
    want = "\n".join((["Title line"] if "Title line" in page else []) + PARAGRAPHS)
    assert html.main_text(page.format("".join(f"<p>{p}</p>" for p in PARAGRAPHS))) == want


def test_the_cut_beats_the_choice_by_block():
    """Without an article element a short block looks like boilerplate, but for its neighbours."""
    page = f"<div class=x><p>{PARAGRAPHS[0]}</p><div>And with</div><p>{PARAGRAPHS[2]}</p></div><ul><li><a href=/a>Imprint</a><li><a href=/b>Contact us</a></ul>"
    blocks, article = html.parse(page)
    html.surroundings(blocks, article)
    alone = [t for (t, *_), (a, b) in zip(blocks, html.costs(blocks, html.PRIOR)) if a > b]
    assert alone == [PARAGRAPHS[0], PARAGRAPHS[2]] and html.main_text(page) == "\n".join([PARAGRAPHS[0], "And with", PARAGRAPHS[2]])


def test_long_pages_take_linear_time():
    import time

    for page in ("<article>" + "<p>Some words of text.<b>" * 100000 + "</article><footer>x</footer>", "<div>" * 3000 + "<p>Some words of text.</p>" + "<a href=x>link</a><li>" * 50000):
        start = time.time()
        html.main_text(page)
        assert time.time() - start < 8


def test_pages_against_a_plain_reading(spark):
    """All pages of sf0.01: the text of their article element, read without a parser; adverts inside it do not occur there."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    import html as codec

    for r in html.op2(pages).join(pages.select(F.col("page_id").alias("p"), "html"), F.col("page_id") == F.col("p")).collect():
        inside = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(codec.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split("</?(?:p|h1|div|ul|li)[^>]*>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain"), (3, "u", "plain"), (None, None, "<p>a<p>b"), (4, "u", "</div></p><article><p>One &amp; two</article>"), (5, "u", "<nav>x</nav>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("main_text", F.lit("clash"))
    got = [tuple(x) for x in html.extract(frame).select("page_id", "main_text", "n_chars").collect()]
    assert len(got) == 7 and {(1, "", 0), (2, "", 0), (4, "One & two", 9), (5, "", 0)} <= set(got) and len({x for x in got if x[0] == 3}) == 1


def test_top_k_matches_brute_force(spark):
    r = np.random.default_rng(1)
    v = r.normal(0, 1, (120, 8)).astype(np.float32)
    v[5] = v[7] = v[9]
    rows = [(i, [float(x) for x in v[i]]) for i in range(120)] + [(200, None), (250, [1.0, float("nan")]), (300, [1.0, None]), (None, [1.0])]
    got = topk.op4(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    w = np.floor(256 * v.astype(float)).astype(int)
    want = set()
    for q in (0, 50, 100):
        s = sorted((-int(w[q] @ w[j]), j) for j in range(120) if j != q)[:5]
        want |= {(q, k + 1, j, -x) for k, (x, j) in enumerate(s)}
    assert {tuple(x) for x in got} == want


def test_repeated_query_ids_match_sql(spark):
    r = np.random.default_rng(4)
    v = r.normal(0, 1, (60, 6)).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]]) for i in range(55)] + [(0, [float(x) for x in v[k]]) for k in (55, 56, 55)] + [(50, [float(x) for x in v[50]]), (7, [float(x) for x in v[57]])]
    vectors = pd.DataFrame(rows, columns=["vec_id", "embedding"])  # noqa: F841
    con = duckdb.connect()
    con.execute("create view embeddings as select vec_id, embedding::float[] as embedding from vectors")
    want = sorted(con.execute(topk.SQL).fetchall())
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for parts in (1, 5):
        assert sorted(map(tuple, topk.op4(frame.repartition(parts)).collect())) == want


def test_scores_beyond_64_bits_are_kept_in_range(spark):
    rows = [(0, [1e16, 1.0]), (1, [1e16, 0.0]), (2, [-1e300, 3.0]), (3, [0.5, 0.5]), (50, [0.0])]
    got = [tuple(x) for x in topk.op4(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    big = 256 * 10**16
    assert [x[2:] for x in sorted(got) if x[0] == 0] == [(1, topk.MOST), (3, 128 * big + 256 * 128 if 128 * big + 256 * 128 < topk.MOST else topk.MOST), (50, 0), (2, topk.LEAST)]


def test_targets_fill_by_weight(spark):
    s = spark.createDataFrame([("a", 100), ("b", 100), ("c", 10), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(s).collect()}
    assert sum(got.values()) == pytest.approx(390) and all(got[k] <= 2 * v for k, v in {"a": 100, "b": 100, "c": 10, None: 50}.items())
    assert got["c"] == 20 and got["a"] == 200 and got[None] == 100 and got["b"] == pytest.approx(70)


def test_mix_comes_near(spark):
    rows = [(i, "w " * (i % 40 + 1), "en", "abc"[min(i % 7, 2)], 0) for i in range(3000)]
    out = mixing.op5(docs(spark, rows)).withColumn("s", F.col("source_size")).groupBy("s").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) < 45 for r in out)
    one = sorted(map(tuple, mixing.op5(docs(spark, rows)).collect()))
    assert one == sorted(map(tuple, mixing.op5(docs(spark, rows)).repartition(3).collect()))


def test_equal_rows_are_counted_out(spark):
    rows = [(1, "w w w", "en", "a", 0)] * 1000 + [(k, "w", "en", "b", 0) for k in range(10, 310)] + [(2, None, "en", "c", 0)] * 3
    got = mixing.op5(docs(spark, rows)).groupBy("source_size").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in got) == 1303 and all(abs(r.t - r.g) <= 1.5 for r in got) and max(r.g for r in got) == 4350


def test_targets_of_many_sources(spark):
    r = np.random.default_rng(9)
    names = [None, *(f"s{k:04d}" for k in range(400))]
    sizes = [(n, int(r.integers(0, 5000))) for n in names]
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {n: (3, 1, 2)[k % 3] for k, (n, _) in enumerate(order)}
    want, free, left = {}, dict(sizes), 1.5 * sum(x for _, x in sizes)
    while free:  # cap all that the level overflows, again and again
        level = left / sum(weight[n] for n in free)
        over = [n for n in free if 2 * free[n] < level * weight[n]]
        if not over:
            want |= {n: level * weight[n] for n in free}
            break
        for n in over:
            want[n] = 2 * free.pop(n)
            left -= want[n]
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long").repartition(7)).collect()}
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n]) for n in got)


def test_mix_repeats_up_to_the_cap(spark):
    rows = [(i, "w " * 10, "en", "ab"[i < 10], 0) for i in range(200)]
    for cap, most in ((3, 3), (1.5, 2), (2, 2)):
        out = mixing.mix(docs(spark, rows), weights=(1, 100), cap=cap).filter("source = 'b'").agg(F.sum(F.col("size") * F.col("repeats")).alias("t"), F.first("target").alias("g"), F.max("repeats").alias("m")).collect()[0]
        assert out.g == pytest.approx(100 * cap) and abs(out.t - out.g) <= 10 and out.m == most


def test_sum_of_squares_identity():
    m = quality.Machine(3)
    m.w = np.random.default_rng(0).normal(size=quality.FIELDS)
    idx, val = quality.features("some words in a text", 20)
    pairs = sum(m.v[i] @ m.v[j] * x * y for a, (i, x) in enumerate(zip(idx, val)) for j, y in list(zip(idx, val))[a + 1 :])
    assert m.margin(idx, val)[0] == pytest.approx(m.w[idx] @ val + pairs)


def test_quality_of_held_out_documents(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    text_ids = quality.op6(d.withColumn("doc_id", F.concat(F.lit("doc "), "doc_id")), lab.withColumn("doc_id", F.concat(F.lit("doc "), "doc_id")))
    for got, truth in ((quality.op6(d, lab), lab), (text_ids, lab.withColumn("doc_id", F.concat(F.lit("doc "), "doc_id")))):
        rows = got.join(truth, "doc_id").filter("held_out and quality is not null").collect()
        assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows) > 30
        assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_repeated_spans_leave_the_first(spark):
    p = "".join(f"The repeated sentence number {i} has some words. " for i in range(9))
    rows = [(1, "Alpha starts here. " + p + "Alpha ends.", "en", "a", 0), (2, "Beta is another. " + p + "Beta ends.", "en", "a", 0), (3, "Clean text stays as it is. It is fine.", "en", "a", 0)]
    got = {r.doc_id: r for r in substring.op7(docs(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert got[2].text == "Beta is another. Beta ends." and got[2].n_removed == 9
    assert "".join(substring.sentences(p)) == p


def test_repeats_in_odd_rows(spark):
    """Of rows with equal ids or none, the one with the smaller text hash counts as the first; equal rows are one document."""
    p = "".join(f"The repeated sentence number {i} has some words. " for i in range(9))
    rows = [(None, p + "A null id.", "en", "a", 0), (4, p, "en", "a", 0), (4, p, "en", "b", 0), (4, "Other. " + p, "en", "a", 0), (5, p.upper(), "en", "a", 0), (6, None, "en", "a", 0), (7, "", "en", "a", 0)]
    got = sorted(map(tuple, substring.dedup(docs(spark, rows).withColumn("n_removed", F.lit("clash"))).select("doc_id", "text", "source", "n_removed").collect()), key=repr)
    kept = [r for r in got if r[1] and p in r[1]]
    assert {r[0] for r in kept} == {4} and len({r[1] for r in kept}) == 1 and len(got) == 7
    assert (6, None, "a", 0) in got and (7, "", "a", 0) in got and (5, "", "a", 9) in got and (None, "A null id.", "a", 9) in got


def test_whole_repeated_passages_go(spark):
    def passage(name, *lengths):
        return "".join(" ".join(f"{name}{k}w{i}" for i in range(n)) + ". " for k, n in enumerate(lengths))

    shapes = [(25, 25, 10), (45, 39), (20, 21, 1, 2), (5, 5, 5), (38, 1, 1), (14, 25), (7, 7)]
    rows, want = [], {}
    for k, shape in enumerate(shapes):
        p = passage(f"p{k}", *shape)
        for copy in (0, 1):
            head, tail = passage(f"h{k}{copy}", 3, 30), passage(f"t{k}{copy}", 30, 3)
            whole = sum(shape) >= 40 or (len(shape) >= 3 and sum(shape) >= 15)
            rows.append((10 * k + copy, head + p + tail, "en", "a", 0))
            want[10 * k + copy] = head + tail if copy and whole else head + p + tail
    assert {r.doc_id: r.text for r in substring.op7(docs(spark, rows)).collect()} == want


def test_repeats_match_all_runs(spark):
    """All runs of any length, not the shortest ones: of each, every place but the first goes."""
    r = np.random.default_rng(11)
    pool = [" ".join(f"s{k}w{i}" for i in range(int(r.choice([1, 4, 9, 16, 26, 41])))) + ". " for k in range(60)]
    texts = []
    for d in range(40):
        k = [int(x) for a in r.integers(0, 55, 3) for x in range(a, a + r.integers(1, 6))]
        texts.append([pool[x] for x in k] + [f"only {d}. "])
    first: dict = {}
    want = {}
    for d, t in enumerate(texts):
        dead: set[int] = set()
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                words = " ".join(t[i:j]).split()
                if len(words) >= 40 or (j - i >= 3 and len(words) >= 15):
                    if first.setdefault(tuple(words), (d, i)) != (d, i):
                        dead.update(range(i, j))
        want[d] = "".join(x for i, x in enumerate(t) if i not in dead)
    rows = [(d, "".join(t), "en", "a", 0) for d, t in enumerate(texts)]
    assert {x.doc_id: x.text for x in substring.op7(docs(spark, rows)).collect()} == want


@pytest.mark.parametrize("small, levels", [(512, 3), (3, 1), (3, 0)])
def test_components_match_brute_force(spark, monkeypatch, small, levels):
    """Also with buckets that are split, and with midpoints."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "LEVELS", levels)
    r = np.random.default_rng(5)
    fps = []
    for _ in range(30):
        x = int(r.integers(0, 1 << 62)) * 4
        for _ in range(12):
            fps.append(x)
            for b in r.integers(0, 64, r.integers(0, 4)):
                x ^= 1 << int(b)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps} | {0})
    got = {x.fp: x.c for x in simhash.link(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    par = {f: f for f in fps}

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
                x, y = root(a), root(b)
                par[max(x, y)] = min(x, y)
    assert got == {f: root(f) for f in fps}


def test_one_of_each_component(spark):
    t = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(5, t, "en", "a", 0), (3, t, "en", "b", 0), (3, t, "en", "b", 0), (3, t.upper(), "en", "b", 0), (None, t, "en", "c", 0), (7, None, "en", "a", 0), (6, "", None, "a", None), (None, "quite another text is here to stay for good", None, None, 0)]
    got = [tuple(x) for x in simhash.one_of_each(docs(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([next(x for x in rows[1:4] if x[1] == min((t, t.upper()), key=lambda u: spark.createDataFrame([(u,)], "s string").select(F.xxhash64("s")).first()[0])), rows[6], rows[7]], key=repr)
    assert simhash.one_of_each(docs(spark, [])).count() == 0


def test_fingerprint_by_spark_hash(spark):
    t = "The quick\tbrown fox jumps over"
    h = [r[0] & ((1 << 64) - 1) for r in spark.createDataFrame([("the quick brown fox",), ("quick brown fox jumps",), ("brown fox jumps over",)], "s string").select(F.xxhash64("s")).collect()]
    assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert simhash.fingerprint("") == simhash.fingerprint(None) == 0


def test_license_places(spark):
    text = "Released under the MIT License. Under-the MIT license! Apache License, Version 2.0; CC BY NC cc by"
    rows = [(1, text, None, None, 0), (1, text, None, None, 0), (2, "no licence", None, None, 0), (3, None, None, None, None)]
    got = sorted(license.op9(docs(spark, rows)).collect())
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
    at = [i for i in range(len(w)) for p in license.BASE if w[i : i + len(p.split())] == p.split()]
    assert got[0] == got[1] and (got[0].n_base, got[0].first_word, got[0].last_word) == (len(at), min(at), max(at))
    assert got[0].base_labels == "apache-2,cc-by-nc,mit" and got[2].labels == "" and got[3].n_words == 0


def test_license_spans_keep_to_a_band(spark):
    """A notice with two words put in is found; the same words with long gaps are not; places may overlap and texts be very long."""
    notice = next(iter(license.TEMPLATES)).split()
    near = " ".join([*notice[:9], "please", "note", *notice[9:]])
    far = " ".join(w + (" filler" * 30 if i % 6 == 5 else "") for i, w in enumerate(notice))
    long = "word " * 200000 + "under the mit license under the mit license"
    got = {r.doc_id: r for r in license.op9(docs(spark, [(1, near, None, None, 0), (2, far, None, None, 0), (3, long, None, None, 0), (4, "cc by nc by nc cc by nc", None, None, 0)])).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and got[1].score >= license.COVER
    assert got[2].labels == "" and got[2].score < license.COVER
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].last_word) == (200008, 2, 200000, 200004)
    assert (got[4].n_base, got[4].labels) == (2, "cc-by-nc")


def test_benchmark_copies_are_found(spark):
    item = "What is the colour of the sky over the old harbour at noon in summer? It is a very deep blue."
    rows = [(1, "word " * 300 + item + " other" * 50, None, None, 0), (2, "the colour of the sky " * 20, None, None, 0)]
    got = {r.doc_id: r for r in decontam.op10(docs(spark, rows), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got[1].contaminated and got[1].items == "7" and not got[2].contaminated


def test_short_answers_count(spark):
    question = "Which of the old harbour towns on the northern coast of the island was first to build a stone lighthouse for the fishing boats that came home late at night?"
    edited = question.replace("first to", "the earliest to").replace("Which of", "Say which of")
    bench = spark.createDataFrame([(7, question + " Port Ellen.")], "item_id long, text string")
    rows = [(1, "filler " * 40 + edited + " It is said to be Port Ellen. " + "other " * 40, None, None, 0), (2, "filler " * 40 + edited + " It is said to be Port Askaig. " + "other " * 40, None, None, 0)]
    got = {r.doc_id: r for r in decontam.op10(docs(spark, rows), bench).collect()}
    assert got[1].items == "7" and got[1].overlap < decontam.SIMILARITY and not got[2].contaminated


def test_language_held_out(spark):
    a = [(i, " ".join(["the", "house", "with", "that"][(i + k) % 4] for k in range(9)), "en", None, 0) for i in range(40)]
    b = [(i + 40, " ".join(["le", "chat", "avec", "une"][(i + k) % 4] for k in range(9)), "fr", None, 0) for i in range(40)]
    got = langid.op3(docs(spark, a + b + [(90, "123 !", "en", None, 0)])).collect()
    assert all(r.lang_pred == ("en" if r.doc_id < 40 else "fr") for r in got if r.doc_id < 80)
    assert [r.lang_pred for r in got if r.doc_id == 90] == ["und"]


def test_bitmasks_hold_many_languages(spark):
    """More languages than a machine word has bits; ties go to the language that sorts first; null and wordless texts have none."""
    r = np.random.default_rng(6)
    words = {f"l{k:03d}": ["".join(r.choice(list("abcdefghijklmnop"), 6)) for _ in range(12)] for k in range(140)}
    rows = [(1000 * j + i, " ".join(r.choice(w, 30)), lang, None, 0) for j, (lang, w) in enumerate(words.items()) for i in range(5)]
    tie = [(k, "zzzz yyyy", lang, None, 0) for k, lang in ((900001, "t2"), (900002, "t1"), (900003, "t2"), (900006, "t1"))]
    odd = [(900010, "zzzz yyyy", None, None, 0), (900011, None, "l001", None, 0), (900012, "", None, None, 0), (900013, "12 34", "l001", None, 0), (None, rows[0][1], None, None, 0)]
    got = [tuple(x) for x in langid.op3(docs(spark, rows + tie + odd)).collect()]
    pred = {x[0]: x[2] for x in got}
    assert len(got) == len(rows + tie + odd) and all(pred[d] == lang for d, _, lang, *_ in rows)
    assert pred[900010] in ("t1", "t2") and pred[None] == "l000" and [pred[k] for k in (900011, 900012, 900013)] == ["und"] * 3
    with_both = [x for x in tie if not spark.sql(f"select crc32('{x[0]}') % 5 = 0").first()[0]]
    if {x[2] for x in with_both} == {"t1", "t2"}:
        assert pred[900010] == "t1"


def test_language_of_held_out_documents(spark):
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op3(known).join(known.select(F.col("doc_id").alias("d"), "lang", "text"), F.col("doc_id") == F.col("d")).filter("held_out and lang is not null").filter(F.col("text").rlike("\\p{L}")).collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)


def test_language_stage_rejects_by_coverage(spark):
    known = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    clean = {r.doc_id for r in known.filter("lang is not null").collect() if r.text and any(map(str.isalpha, r.text))}
    r = np.random.default_rng(2)
    noise = " ".join("".join(r.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(60))
    junk = [(9001, noise, None, None, 0), (9002, "Это просто другой язык, которого никто не учил.", None, None, 0), (9003, "123 !", None, None, 0)]
    got = {x.doc_id for x in corpus_pipeline.language(spark, known.union(docs(spark, junk)), "").collect()}
    assert clean <= got and not got & {9001, 9002, 9003}


def test_language_stage_keeps_what_it_cannot_tell(spark):
    odd = [(1, "Это просто другой язык", None, None, 0), (2, "one two", None, None, 0), (3, "123 !", None, None, 0), (4, None, None, None, None)]
    assert {x.doc_id for x in corpus_pipeline.language(spark, docs(spark, odd), "").collect()} == {1, 2}
    thin = [(k, "the house with that", "en", None, 0) for k in range(10, 30)]
    assert {x.doc_id for x in corpus_pipeline.language(spark, docs(spark, odd + thin), "").collect()} == {1, 2, *range(10, 30)}
