"""Byte-level BPE by forced boundaries: what lies between two certain cuts is encoded by itself, and the pieces are concatenated."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import ship

#: The pattern that splits text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are encoded together, and bytes of pieces that a task remembers at most when it begins with the next ones.
SLICE, MEMORY = 1 << 20, 64 << 20
#: Pieces of more bytes merge by a heap; above all ranks.
SHORT, NEVER = 64, 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 for itself, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and certain cuts of a byte-level BPE file of the tokenizers library (no normalizer, prefix space or post-processor)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or spec["post_processor"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        self.ids = {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items()}
        self.special = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"]):
            raise ValueError("added tokens that depend on their neighbours are not supported")
        self.ranks = {}
        for k, pair in enumerate(model["merges"]):
            a, b = (bytes(map(letters.__getitem__, x)) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks[self.ids[a], self.ids[b]] = k << 32 | self.ids[a + b]  # by rank, and what the pair becomes
        self.singles = [self.ids[bytes([b])] for b in range(256)]
        #: certain[x, y]: no token holds byte y after byte x, so no merge ever crosses that place.
        self.certain = np.ones((256, 256), bool)
        for token in self.ids:
            for x, y in zip(token, token[1:]):
                self.certain[x, y] = False
        self.rows = [row.tobytes() for row in self.certain]
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile(b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.found: list[list[int]] = []
        self.held = 0

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that no cut divides: the pair of lowest rank first, the leftmost of equal ones."""
        ids = [self.singles[b] for b in piece]
        if len(ids) > SHORT:
            return self.merge_long(ids)
        rank = self.ranks.get
        order = [rank(pair, NEVER) for pair in zip(ids, ids[1:])]
        while order and (low := min(order)) < NEVER:
            k = order.index(low)
            ids[k] = new = low & 0xFFFFFFFF
            del ids[k + 1], order[k]
            if k:
                order[k - 1] = rank((ids[k - 1], new), NEVER)
            if k < len(order):
                order[k] = rank((new, ids[k + 1]), NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same by a linked list and a heap, so that long pieces take n log n steps."""
        n, rank = len(ids), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k, *ids[k : k + 2]) for k in range(n - 1) if (r := rank((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            low, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = low & 0xFFFFFFFF, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := rank((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def pieces(self, fragment: bytes) -> list[bytes]:
        """A fragment cut at the pattern's matches and at the certain cuts inside them. Letters behind one space at most are one match, and short ones merge as they are."""
        if len(fragment) <= SHORT and fragment[fragment[:1] == b" " :].isalpha():
            return [fragment]
        out = []
        for raw in map(str.encode, self.words.findall(fragment.decode())):
            if len(raw) <= SHORT:
                cuts = [k for k in range(1, len(raw)) if self.rows[raw[k - 1]][raw[k]]]
            else:
                b = np.frombuffer(raw, np.uint8)
                cuts = (np.flatnonzero(self.certain[b[:-1], b[1:]]) + 1).tolist()
            out += [raw[s:e] for s, e in zip([0, *cuts], [*cuts, len(raw)])]
        return out

    def piece(self, fragment: bytes) -> int:
        """The number of a fragment's list of ids; those met before are known."""
        at = self.known.get(fragment)
        if at is None:
            parts = self.pieces(fragment)
            ids = self.merge(parts[0]) if len(parts) == 1 else [i for p in parts for i in self.merge(p)]
            at = self.known[fragment] = len(self.found)
            self.found.append(ids)
            self.held += len(fragment) + 8 * len(ids) + 200
        return at

    def encode(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of ids) of texts that lie behind each other in data. Cuts: ends of texts, special tokens, and the certain places between."""
        cuts = np.zeros(len(data) + 1, bool)
        cuts[1:-1] = outright(np.frombuffer(data, np.uint8), self.certain)
        special = []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if self.specials and self.specials.search(data) else ():
            special += [(m.start(), m.end()) for m in self.specials.finditer(data, s, e)]
        for s, e in special:
            cuts[s + 1 : e] = False
            cuts[[s, e]] = True
        cuts[bounds] = True
        at = np.flatnonzero(cuts)
        places = at.tolist()
        if self.held > MEMORY:
            self.forget()
        fragments = [data[s:e] for s, e in zip(places, places[1:])]
        which = list(map(self.known.get, fragments))
        for k in [k for k, x in enumerate(which) if x is None]:
            which[k] = self.piece(fragments[k])
        which = np.array(which, np.int64)
        if special:
            which[np.searchsorted(at, [s for s, _ in special])] = [-1 - self.special[data[s:e]] for s, e in special]
        return self.gather(which, at, bounds)

    def gather(self, which: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lists of ids by number (special tokens: -1 - id), laid behind each other, and where each text's begin."""
        used, back = np.unique(which, return_inverse=True)
        lists = [self.found[k] if k >= 0 else [-1 - k] for k in used.tolist()]
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.array([i for x in lists for i in x], np.uint32)
        take = ragged(np.concatenate([[0], np.cumsum(sizes)])[:-1][back], sizes[back]) if len(which) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(sizes[back])]) if len(which) else np.zeros(1, np.int64)
        return flat[take], total[np.searchsorted(at, bounds)] if len(at) else np.zeros(len(bounds), np.int64)


class Tokens:
    """The bytes of all tokens of a vocabulary file, for decoding."""

    def __init__(self, text: str):
        spec, letters = json.loads(text), byte_letters()
        names = {i: bytes(map(letters.__getitem__, t)) for t, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"].encode() for a in spec["added_tokens"]}
        words = [names.get(i, b"") for i in range(max(names) + 1)]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])].tobytes()


def outright(b: np.ndarray, certain: np.ndarray) -> np.ndarray:
    """Places between two bytes of valid UTF-8 at which a whole text may be cut before the pattern sees it: the pattern then splits both sides as it would the whole.

    These are certain pairs behind a character that is no white space, before any but an apostrophe: nothing but white space looks ahead, so the left side ends
    as it would; the right side begins a match of its own or goes on with a run of its own class (contractions begin at apostrophes). Behind a
    single line feed between two such characters, too. Characters are told by their bytes: printable ASCII but the apostrophe, and those from U+00C0 on but for the
    blocks that hold white space (U+1000 to U+3FFF).
    """
    if len(b) < 2:
        return np.zeros(max(len(b) - 1, 0), bool)
    lead = (b >= 0xC3) & ~((b >= 0xE1) & (b <= 0xE3))
    solid = (b > 0x20) & (b < 0x7F) & (b != 0x27)  # the last byte of a character that is no white space
    for width, low, high in ((2, 0xC3, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF7)):
        solid[width - 1 :] |= lead[: len(b) - width + 1] & (b[: len(b) - width + 1] >= low) & (b[: len(b) - width + 1] <= high)
    starts = (b < 0x80) | (b >= 0xC0)  # the first byte of a character
    pair = certain[b[:-1], b[1:]] & starts[1:]
    cut = pair & solid[:-1] & (b[1:] != 0x27)
    after = (b[1:] > 0x20) & (b[1:] < 0x7F) | lead[1:]
    cut[1:] |= pair[1:] & solid[:-2] & (b[1:-1] == 0x0A) & after[1:]
    return cut


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[k], starts[k] + 1, ... of each k, sizes[k] of them."""
    total = np.cumsum(sizes)
    return np.repeat(starts - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)


def vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read by the driver and broadcast (its size is the file's: a few MB, whatever the table)."""
    ship(df)
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


@lru_cache(maxsize=2)
def _loaded(kind: type, text: str):
    """One vocabulary of a kind for each Python worker."""
    return kind(text)


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[bytes, np.ndarray]]:
    """(bytes, bounds) of consecutive rows with about `most` bytes together; a longer row comes alone. Nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    k = 0
    while k < len(column):
        j = max(k + 1, int(np.searchsorted(offsets, offsets[k] + most, "right")) - 1)
        j = min(j, len(column))
        yield (data.slice(int(offsets[k]), int(offsets[j] - offsets[k])).to_pybytes() if data else b""), offsets[k : j + 1] - offsets[k]
        k = j


def _added(docs: DataFrame, path: str, text: str, added: dict, kinds: tuple, make) -> DataFrame:
    """The rows with columns that `make` gives for the bytes of each slice of a column, slice by slice: what a task holds is a slice's, not a batch's."""
    shared = vocabulary(docs, path)
    kept = [f for f in docs.schema.fields if f.name not in added]

    def run(batches):
        loaded = [_loaded(k, shared.value) for k in kinds]
        for batch in batches:
            done = 0
            for data, bounds in slices(batch.column(batch.schema.get_field_index(text))):
                part = batch.slice(done, len(bounds) - 1)
                done += len(bounds) - 1
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *make(*loaded, data, bounds)], [*(f.name for f in kept), *added])

    return docs.mapInArrow(run, StructType([*kept, *(StructField(n, t) for n, t in added.items())]))


def _tokens(v: Vocabulary, data: bytes, bounds: np.ndarray) -> list[pa.Array]:
    got, at = v.encode(data, bounds)
    raw = got.astype("<u4").tobytes()
    return [pa.array([raw[4 * s : 4 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())]


def _texts(t: Tokens, raw: list[bytes]) -> pa.Array:
    return pa.array([t.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in raw], pa.string())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the tokens of a text as little-endian unsigned 32-bit integers in a binary column; the other columns stay.

    As the tokenizers library encodes with the vocabulary at `path`, without adding special tokens: the strings of special tokens in
    a text become their ids. A null or empty text has no tokens. A column of the name `ids` is replaced. Rows are independent:
    nothing is shuffled, repeated rows stay. A text is held whole; a piece that no cut divides takes n log n steps.
    """
    return _added(docs, path, text, {ids: BinaryType()}, (Vocabulary,), _tokens)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of a binary column of tokens (see `encode`), special tokens included; bytes that are no UTF-8 become U+FFFD. Null: empty."""
    return _added(docs, path, ids, {text: StringType()}, (Tokens,), lambda t, data, at: [_texts(t, [data[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())])])


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`encode`, and `decode` of what it gives, in one pass and one Python worker a task."""

    def both(v: Vocabulary, t: Tokens, data: bytes, bounds: np.ndarray) -> list[pa.Array]:
        raw = _tokens(v, data, bounds)[0]
        return [raw, _texts(t, raw.to_pylist())]

    return _added(docs, path, text, {ids: BinaryType(), decoded: StringType()}, (Vocabulary, Tokens), both)


def op12(documents: DataFrame, path: str) -> DataFrame:
    """Digests of each document's tokens and of the text that they decode to. A null doc_id stays null."""
    got = round_trip(documents.select("doc_id", "text"), path)
    return got.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
