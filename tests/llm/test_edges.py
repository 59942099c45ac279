"""Nulls, empty and very long texts, ties, repeated rows, clashing and extra columns: the results that docstrings state."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shardlake.llm import chat, decontam, html, langid, license, mixing, quality, simhash, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over the lazy dog and then runs away from the old farm house"
ROWS = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, WORDS, "en", "a", 7), (3, WORDS, "en", "a", 7), (None, WORDS, "fr", None, 7), (4, "x " * 100000, "en", "a", 200000), (None, None, None, None, None)]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS)


def by_id(frame, *names):
    return sorted(((r["doc_id"], *(r[n] for n in names)) for r in frame.collect()), key=repr)


def test_values_of_odd_rows(spark):
    d = docs(spark).withColumns({n: F.lit("clash") for n in ("score", "n_items", "fingerprint", "size", "repeats", "lang_pred", "quality_score", "n_removed", "labels", "fp")})
    zero = "0" * 16
    fp = f"{simhash.fingerprint(WORDS):016x}"
    x = f"{simhash.fingerprint('x ' * 10):016x}"
    assert by_id(simhash.op8(d), "fingerprint", "component_id") == sorted([(1, zero, 1), (2, zero, 1), (3, fp, 3), (3, fp, 3), (None, fp, 3), (4, x, 4), (None, zero, 1)], key=repr)
    lic = {r[0]: r[1:] for r in by_id(license.op9(d), "n_words", "n_base", "first_word", "labels", "score") if r[0]}
    assert lic == {1: (0, 0, None, "", 0.0), 2: (0, 0, None, "", 0.0), 3: (18, 0, None, "", 0.0), 4: (100000, 0, None, "", 0.0)}
    bench = spark.createDataFrame([(None, WORDS), (9, None), (8, "")], "item_id long, text string")
    assert by_id(decontam.op10(d, bench), "contaminated", "items") == sorted([(1, False, ""), (2, False, ""), (3, True, "null"), (3, True, "null"), (None, True, "null"), (4, False, ""), (None, False, "")], key=repr)
    mix = mixing.op5(d).collect()
    assert {r.doc_id: r.size for r in mix if r.doc_id} == {1: 0, 2: 0, 3: 18, 4: 100000} and {r.source_size for r in mix} == {100036, 18} and all(r.taken <= 2 * r.size for r in mix)
    lang = {r[:3] for r in by_id(langid.op3(d), "lang_pred", "score")}
    assert {(1, "und", 0.0), (2, "und", 0.0), (None, "und", 0.0)} <= lang
    assert by_id(substring.op7(d), "text") == sorted([(r[0], r[1]) for r in ROWS], key=repr)
    assert mixing.mix(d).columns.count("size") == 1 and decontam.find(d, bench).columns.count("n_items") == 1 and "score" in substring.dedup(d).columns


def test_quality_ties_and_odd_rows(spark):
    lab = spark.createDataFrame([(2, 1, 0), (3, 0, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (lab, lab.limit(0)):
        got = quality.op6(docs(spark), labels).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        assert len({r.score for r in got if r.doc_id == 3}) == 1


def test_preferences_of_odd_turns(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", None), (1, 0, "user", None), (1, 1, "assistant", "b"), (None, 0, None, "alone"), (2, 0, None, None), (0, 1, "assistant", None), (5, None, "assistant", "only")]
    t = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("prompt", F.lit("clash"))
    got = {r.conv_id: r for r in chat.op1(t).collect()}
    assert len(got) == 5 and got[0].prefix_turns == 2 and got[0].chosen_completion == "<|assistant|>\n\n" and got[0].rejected_completion == "<|assistant|>\nb\n"
    assert got[1].prompt == "<|user|>\n\n" and got[1].rejected_mask == "15:1"
    assert got[None].prompt == "" and got[None].chosen_completion == "<|unknown|>\nalone\n" and got[2].rejected_completion == ""
    assert (got[5].chosen_mask, got[5].rejected_mask) == ("19:1", "")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, tmp_path, name, stage):
    spark.createDataFrame([(1, WORDS), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wide = docs(spark).withColumns({n: F.lit("mine") for n in ("score", "coverage", "fingerprint", "n_items", "size", "extra")})
    got = stage(spark, wide, str(tmp_path))
    rows = by_id(got, "text")
    want = {
        "language_id": [(3, WORDS), (3, WORDS), (None, WORDS), (4, "x " * 100000)],  # too few n-grams are known to tell by coverage
        "near_dedup": [(1, None), (3, WORDS), (4, "x " * 100000)],
        "substring_dedup": [(r[0], r[1]) for r in ROWS],
        "decontamination": [(1, None), (2, ""), (4, "x " * 100000), (None, None)],
    }
    if name in want:
        assert rows == sorted(want[name], key=repr) and set(wide.columns) <= set(got.columns) and {r.extra for r in got.collect()} == {"mine"}
    else:
        assert {r.doc_id for r in got.collect()} <= {1, 2, 3, 4, None} and got.columns.count("size") == 1
    assert stage(spark, docs(spark, []), str(tmp_path)).count() == 0


def test_a_large_group_of_near_copies_makes_no_pairs(spark):
    """5000 fingerprints around one value: linked as all pairs would, with links in proportion to members."""
    import numpy as np

    r = np.random.default_rng(12)
    fps = {0x0123456789ABCDEF}
    while len(fps) < 5000:
        x = 0x0123456789ABCDEF
        for b in r.choice(64, int(r.integers(1, 7)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    v = np.array(sorted(fps), dtype=np.uint64)
    got = {np.uint64(x.fp & (1 << 64) - 1): x.c for x in simhash.link(spark.createDataFrame([(simhash._signed(int(x)),) for x in v], "fp long")).collect()}
    parent = list(range(len(v)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[:i] ^ v[i]) <= 4):
            parent[root(i)] = root(int(j))
    groups: dict = {}
    for i, x in enumerate(v):
        groups.setdefault(root(i), []).append(x)
    assert len(got) == 5000 and all(len({got[x] for x in g}) == 1 for g in groups.values()) and len(set(got.values())) == len(groups)


PRIVATE = ("_key", "_row", "_d", "_k", "_r", "_cover", "_hits", "_s", "_size", "_h", "_carried", "fp", "group", "_of", "_base", "doc")


def test_stages_carry_every_name(spark, tmp_path):
    """Columns that bear names which operators use inside come through, whatever they hold."""
    rows = [(k, f"{WORDS} number {k} of {k * k} and more about {k * 7}. " * 3, "en", "ab"[k % 2], 9) for k in range(20)]
    spark.createDataFrame([(1, "nothing of this is in any text at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = docs(spark, rows).withColumns({n: F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")) for n in PRIVATE})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, d, str(tmp_path))
        assert set(d.columns) <= set(got.columns), name
        seen = got.select("doc_id", *[F.col(f"`{n}`") for n in PRIVATE]).collect()
        assert seen and all(r[n] == f"{n} {r.doc_id}" for r in seen for n in PRIVATE), name


def test_a_rare_language_changes_no_other(spark):
    """Junk goes with and without three rows of a language that was not there; documents of the others stay or go as before; the rare ones stay."""
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    r = __import__("random").Random(3)
    junk = [(10**6 + k, " ".join("".join(r.choices("qxzwvkjy", k=r.randint(3, 9))) for _ in range(60)), None, "a") for k in range(5)]
    latin = ["gallia est omnis divisa in partes tres quarum unam incolunt belgae", "gallia est divisa et omnis pars quarum incolunt belgae tres", "omnis gallia in partes divisa est quarum tres incolunt belgae"]
    rare = [(2 * 10**6 + 7 * k, t, "la", "a") for k, t in enumerate(latin)]
    kind = "doc_id long, text string, lang string, source string"
    one = {x.doc_id for x in corpus_pipeline.language(spark, base.union(spark.createDataFrame(junk, kind)), "").select("doc_id").collect()}
    two = {x.doc_id for x in corpus_pipeline.language(spark, base.union(spark.createDataFrame(junk + rare, kind)), "").select("doc_id").collect()}
    assert not one & {j[0] for j in junk} and len(one) > 800
    assert two - {x[0] for x in rare} == one and {x[0] for x in rare} <= two


def test_benchmark_shards_are_stages_of_their_own(spark, monkeypatch, tmp_path):
    """However many shards: one Python step of an index a job, and the same answer."""
    items = [(k, f"which {k} of the {k * k} things is number {k * 31} here? it is {k} and {k * 5}.") for k in range(40)]
    rows = [(k, f"intro {items[k % 40][1]} and {items[(k * 7) % 40][1]} {WORDS}" if k % 2 else WORDS, "en", "a", 1) for k in range(80)]
    bench, d = spark.createDataFrame(items, "item_id long, text string"), docs(spark, rows + ROWS)
    want = by_id(decontam.op10(d, bench), "items")
    monkeypatch.setattr(decontam, "INDEX", 60)
    got = decontam.op10(d, bench)
    assert by_id(got, "items") == want and sum(bool(x[1]) for x in want) >= 40
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0


@pytest.mark.parametrize("inner", ["<script>var x = '<p>';</script>", "<svg><g><text>no</text></g></svg>", "<button>Buy <b>now</b></button>", "<select><option>a<option>b</select>", "<input name=q>", "<noscript><p>no</p></noscript>", "<style>p {}</style>", "<img src=a><wbr>"])
def test_elements_without_text_cut_no_block(inner):
    blocks, _ = html.parse(f"<article><p>First words {inner}second words</p><p>Then</p></article>")
    assert [b[0] for b in blocks] == ["First words second words", "Then"]


def test_open_elements_end_with_their_block():
    blocks, _ = html.parse("<article><p>one <button>never shut<p>two<hr>three</article><div>four <svg><g></div>five")
    assert [b[0] for b in blocks] == ["one", "two", "three", "four", "five"]
