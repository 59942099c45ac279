"""Periodic runs, BPE and the conversation trie: brute force, the library, odd rows, hot groups."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shardlake.llm import bpe, periodic, queries, trie

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def runs_of(w):
    """All runs: for every period, the stretches of words that equal the word a period later."""
    best = {}
    code: dict = {}
    w = np.array([code.setdefault(x, len(code)) for x in w], np.int32)
    for p in range(1, len(w) // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], w[:-p] == w[p:], [0]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s + p >= max(6, 4 * p):
                best.setdefault((s, e - s + p), p)
    return sorted((s, n, p) for (s, n), p in best.items())


def periodic_row(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_of(w)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_random_words():
    r = random.Random(5)
    for _ in range(60):
        texts = []
        for _ in range(r.randint(1, 12)):
            w = [r.choice("abcdef"[: r.choice([1, 2, 3, 5])]) for _ in range(r.randint(0, 90))]
            if w and r.random() < 0.5:
                a = r.randrange(len(w))
                q = 1 + (len(w) - a) // r.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % q] for i in range(len(w))]
            texts.append(w)
        found, _ = periodic.search([" ".join(w).encode() for w in texts])
        assert [[tuple(x[1:]) for x in found.tolist() if x[0] == k] for k in range(len(texts))] == [runs_of(w) for w in texts]


def test_grid_in_parts(monkeypatch):
    """Long texts whose places are compared in many parts."""
    words = [*np.random.default_rng(2).integers(0, 3, 700), *([7, 8, 9] * 400), *np.random.default_rng(3).integers(0, 3, 700)]
    text = " ".join(map(str, words)).encode()
    want = periodic.search([text, b"a " * 900])[0].tolist()
    monkeypatch.setattr(periodic, "GRID", 37)
    assert periodic.search([text, b"a " * 900])[0].tolist() == want
    assert [tuple(x[1:]) for x in want if x[0] == 0] == runs_of(words)


def test_op11_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["op11_periodic_grid"](spark, SF).select(COLUMNS).collect())
    want = sorted(periodic_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert got == want and sum(r[1] > 0 for r in want) > 10


ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "x " * 30000), (4, "x " * 30000), (None, "a b a b a b a b a b"), (5, " a  a  a  a  a  a"), (6, "ab<|endoftext|>'s  \n\n é😀\r\n" * 3), (7, "z" * 50000)]


def test_odd_documents(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({n: F.lit("clash") for n in ("runs", "collapsed", "ids", "decoded", "start", "n_runs", "best")})
    got = sorted((tuple(r) for r in periodic.op11(docs).select(COLUMNS).collect()), key=repr)
    assert got == sorted((periodic_row(*r) for r in ROWS), key=repr)
    whole = periodic.periodic_runs(docs).filter("doc_id = 4").first()
    assert [tuple(r) for r in whole.runs] == [(0, 30000, 1)] and whole.collapsed == "x" and whole.ids == "clash"
    library = Tokenizer.from_file(PATH)
    ids = [library.encode(t or "", add_special_tokens=False).ids for _, t in ROWS]
    want = [(d, len(i), sha(np.array(i, "<u4").tobytes()), sha(library.decode(i, skip_special_tokens=False))) for (d, _), i in zip(ROWS, ids)]
    assert sorted((tuple(r) for r in bpe.op12(docs, PATH).collect()), key=repr) == sorted(want, key=repr)
    both = bpe.decode(bpe.encode(docs, PATH), PATH).filter("doc_id = 6").first()
    assert both.decoded == both.text == ROWS[7][1] and both.runs == "clash" and docs.columns == sorted(both.asDict(), key=[*docs.columns].index)
    empty = docs.limit(0)
    assert periodic.op11(empty).count() == 0 and bpe.op12(empty, PATH).count() == 0


def test_op12_whole_table(spark):
    library = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = [e.ids for e in library.encode_batch([r.text or "" for r in docs], add_special_tokens=False)]
    want = sorted((r.doc_id, len(i), sha(np.array(i, "<u4").tobytes()), sha(r.text or "")) for r, i in zip(docs, ids))
    assert sorted(tuple(r) for r in queries.QUERIES["op12_bpe_boundaries"](spark, SF).collect()) == want


@pytest.mark.parametrize("memory", [1 << 25, 0])
def test_bpe_against_the_library(monkeypatch, memory):
    """Random mixes of classes, and every 7th code point among letters, digits, spaces and itself; with and without remembered pieces."""
    monkeypatch.setattr(bpe, "MEMORY", memory)
    text = open(PATH, encoding="utf-8").read()
    v, tokens, library, r = bpe.Vocabulary(text), bpe.Tokens(text), Tokenizer.from_file(PATH), random.Random(9)
    alphabet = [*"ab sS t'\"!?$0123\n\t\r　 ’éß中あ😀́\x1c\x85​llrevemd", "'s", "'re", "<|endoftext|>", "  ", "\n\n", "'ll", "the ", " of"]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(4000)] + ["a" * 20000, "ab" * 9000, "中文" * 3000]
    texts += [f"a{c}{c} {c}1{c} b" for c in map(chr, [*range(0, 0xD800, 7), *range(0xE000, 0x30000, 7)])]
    raw = [t.encode() for t in texts]
    for k in range(0, len(raw), 5000):
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw[k : k + 5000]])]).astype(np.int64)
        ids, at = v.encode(b"".join(raw[k : k + 5000]), bounds)
        for j, e in enumerate(library.encode_batch(texts[k : k + 5000], add_special_tokens=False)):
            assert ids[at[j] : at[j + 1]].tolist() == e.ids, texts[k + j]
            assert tokens.decode(ids[at[j] : at[j + 1]]) == raw[k + j]


def test_forced_boundaries():
    """Certain pairs stand in no token; pieces between them encode alone as they do together."""
    v = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
    assert not any(v.certain[x, y] for t in v.ids for x, y in zip(t, t[1:])) 
    at = lambda t: np.flatnonzero(bpe.outright(np.frombuffer(t.encode(), np.uint8), v.certain)).tolist()
    assert at("be at.'s") == [1, 4] and at("é a\nb") == [1, 3, 4] and at("a\n\nb 中 \u3000 a") == [0, 3, 7]
    r = random.Random(4)
    for _ in range(300):
        b = bytes(r.randrange(256) for _ in range(40))
        cuts = [0, *(k for k in range(1, 40) if v.certain[b[k - 1], b[k]]), 40]
        assert v.merge(b) == [i for s, e in zip(cuts, cuts[1:]) for i in v.merge(b[s:e])]


def nodes_of(whole):
    """Nodes of {conv_id: turns} by all prefixes."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
        ends[s].append(c)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k]))))) for k, m in members.items()), key=repr)


def rebuilt_of(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1] or 0))] for c, v in own.items()}
    out = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + s[h:])
    return out


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_op13_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collected(queries.QUERIES["op13_prefix_trie"](spark, SF)) == nodes_of(rebuilt_of(rows))


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("blocks, waiting", [(1, 20000), (7, 20000), (40, 20000), (7, 2), (1, 1)])
def test_trie_over_blocks(spark, monkeypatch, blocks, waiting):
    """Short alphabets, long shared heads, one common conversation, prefixes of others; however many blocks, however few rows wait."""
    monkeypatch.setattr(trie, "WAITING", waiting)
    r = random.Random(11)
    rows = []
    for c in range(0, 400):
        kind = r.random()
        say = [("user", r.choice(["a", "bé", ""])) for _ in range(r.randint(1, 6))] if kind < 0.5 else [("user", "hot")] * 9 if kind < 0.8 else [("user", "hot")] * r.randint(1, 90) + [("assistant", str(c % 7))]
        rows += [(c, t, *x) for t, x in enumerate(say)]
    table = spark.createDataFrame(rows, CONV)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", blocks)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert collected(trie.op13(table)) == nodes_of(rebuilt_of(rows))
        own = defaultdict(list)
        for c, t, *x in rows:
            own[c].append(tuple(x))
        assert collected(trie.trie(trie.sequences(table))) == nodes_of({c: tuple(s) for c, s in own.items()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_trie_of_odd_rows(spark):
    rows = [(0, 0, None, None), (0, None, "user", "first"), (1, 0, "user", "x"), (None, 0, "user", "y"), (7, 3, "user", "z"), (7, 3, "user", "z"), (-3, 1, "user", "w"), (12, 0, None, ""), (3000000000, 0, "user", "x")]
    table = spark.createDataFrame(rows, CONV).withColumns({n: F.lit("clash") for n in ("base", "keys", "sizes", "block", "items", "item", "of", "head", "depth")})
    assert collected(trie.op13(table)) == nodes_of(rebuilt_of(rows))
    assert collected(trie.op13(table.limit(0))) == [] and collected(trie.op13(table.filter("conv_id is null"))) == []
    turnless = spark.createDataFrame([(16, 0, "user", "x")], CONV)  # its base is absent and its only turn is replaced
    assert collected(trie.op13(turnless)) == nodes_of(rebuilt_of([(16, 0, "user", "x")]))
