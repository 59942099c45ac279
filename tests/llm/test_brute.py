"""Substring dedup, decontamination and the whole pipeline against brute force over small whole tables."""

from __future__ import annotations

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from shardlake.llm import decontam, mixing, simhash, substring

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect())


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]


def without_repeats(docs):
    """Texts by doc_id: all runs of sentences of any length, as texts; each loses every place but its first. Splits sentences by itself."""
    pieces, first, out = {}, {}, {}
    for d, text, _ in docs:
        pieces[d] = []
        for p in re.findall(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+", text or ""):
            if pieces[d] and not re.search(r"[^\W_]", p):
                pieces[d][-1] += p
            else:
                pieces[d].append(p)
    for d, text, _ in docs:
        words = [p.lower().split() for p in pieces[d]]
        dead: set[int] = set()
        for i in range(len(words)):
            run: list = []
            for j in range(i, len(words)):
                run += words[j]
                if len(run) >= 40 or (j - i >= 2 and len(run) >= 15):
                    if first.setdefault(" ".join(run), (d, i)) != (d, i):
                        dead.update(range(i, j + 1))
                if len(run) >= 400:  # longer runs repeat only where these do: all their parts have been seen
                    break
        out[d] = text if text is None else "".join(s for i, s in enumerate(pieces[d]) if i not in dead)
    return out


def leaked(docs, items):
    """Ids of the items of which each text holds a passage, by all passages of all items, without an index."""
    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    known = [(i, cut(t), t) for i, t in items if t and cut(t)]
    mean = sum(len(w) for _, w, _ in known) / len(known)
    df = Counter(x for _, w, _ in known for x in set(w))
    grams = lambda w, n: {" ".join(w[k : k + n]) for k in range(len(w) - n + 1)}
    out = {d: set() for d, *_ in docs}
    texts = [(d, cut(t or "")) for d, t, *_ in docs]
    for i, w, t in known:
        weight = {x: math.log(1 + (len(known) - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, f in Counter(w).items()}
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", t.strip()) if cut(s)]
        tail = len(cut(sentences[-1])) if len(sentences) > 1 else 0
        parts = [w[: len(w) - tail], w[len(w) - tail :]] if tail else []
        enough = lambda part, p: len(grams(part, min(5, len(part))) & grams(p, min(5, len(part)))) >= 0.8 * len(grams(part, min(5, len(part))))
        for d, words in texts:
            for a in range(0, max(len(words) - len(w), 1), len(w)):
                p = words[a : a + 2 * len(w)]
                if sum(weight[x] for x in set(p) & weight.keys()) >= (0.5 - 1e-9) * sum(weight.values()) and (enough(w, p) or (parts and all(enough(x, p) for x in parts))):
                    out[d].add(i)
    return out


def groups(docs):
    """Smallest doc_id of each document's group, by all pairs of fingerprints."""
    fp = {d: simhash.fingerprint(t) for d, t, _ in docs}
    root = {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= simhash.DISTANCE:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in fp}


def test_substring_dedup(spark, documents):
    got = {r.doc_id: r.text for r in substring.op7(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    want = without_repeats(documents)
    assert got == want
    assert any(want[d] != t for d, t, _ in documents)


def test_decontamination(spark, documents, items):
    got = {r.doc_id: r["items"] for r in decontam.op10(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    want = {d: ",".join(map(str, sorted(x))) for d, x in leaked(documents, items).items()}
    assert got == want
    assert any(want.values())


def test_decontamination_of_many_items(spark, monkeypatch):
    """Thousands of items of all lengths, repeated, null and wordless; the same answer for any size of index and block."""
    r = np.random.default_rng(8)
    vocab = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(vocab[int(k)] for k in np.minimum(r.zipf(1.3, n) - 1, 399))
    items = [(k, say(int(r.choice([2, 4, 9, 20, 40]))) + ". " + say(int(r.integers(1, 8))) + ".") for k in range(1500)] + [(2000, say(400)), (2001, None), (2002, "..."), (7, say(30)), (None, say(25))]
    docs = []
    for d in range(60):
        t = say(int(r.choice([3, 60, 700])))
        for k in r.integers(0, len(items), 2):
            t += f" {items[k][1]} {say(20)}"
        docs.append((d, t.replace(" w3 ", " changed ") if d % 3 else t, "a"))
    docs += [(60, None, "a"), (61, "", "a"), (62, items[-1][1], "a"), (63, "intro " * 50 + items[-2][1], "a")]
    show = lambda x: ",".join(map(str, sorted(i for i in x if i is not None))) + ("" if None not in x else ",null" if len(x) > 1 else "null")
    want = {d: show(x) for d, x in leaked(docs, items).items()}
    assert want[62].endswith("null") and sum(map(bool, want.values())) > 40
    table, bench = spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(items, "item_id long, text string")
    for size, block, stride in ((1 << 20, 4, 128), (9000, 1, 17)):
        for name, x in (("INDEX", size), ("BLOCK", block), ("STRIDE", stride)):
            monkeypatch.setattr(decontam, name, x)
        assert {x.doc_id: x["items"] for x in decontam.op10(table, bench).collect()} == want


def test_pipeline(spark, documents, items):
    kept = [r for r in documents if r[1] and any(map(str.isalpha, r[1]))]
    component = groups(kept)
    kept = [r for r in kept if component[r[0]] == r[0]]
    texts = without_repeats(kept)
    found = leaked([(d, texts[d]) for d, *_ in kept], items)
    kept = [(d, texts[d], s) for d, _, s in kept if not found[d]]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(kept, columns=["doc_id", "text", "source"]))
    want = {r[0]: r[4] for r in con.execute(mixing.SQL).fetchall()}
    got = {r.doc_id: (r.text, r.repeats * r.size) for r in corpus_pipeline.run(spark, SF).collect()}
    assert {d: t for d, (_, t) in got.items() if t} == {d: t for d, t in want.items() if t}
    assert all(text == texts[d] for d, (text, _) in got.items())
