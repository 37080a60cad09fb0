"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Texts stream through the automaton word by word; the longest piece of any item that ends at
each word is tracked. A piece of ``window`` words or more makes its words hit, and the items
it lies in are counted. An item of fewer words is one window of its own.

The items are dealt into blocks of a bounded number of words, each with an automaton of its own.
Two blocks at most are with the executors at once: every text meets every block, in as many
passes as that takes, so what is broadcast never grows with the test items.

Defined results: null and empty texts have no words and are clean; null item texts, items
without a word and items without an id have no window; an item_id given twice counts once;
repeated rows stay repeated; very long texts are walked whole. Other columns pass through
:func:`clean` and are ignored elsewhere.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import dropped, written
from .common import id_and_text, map_text

WINDOW = 8
#: Words of test items in one automaton: about 0.5 kB each on the driver and each executor.
BLOCK_WORDS = 200_000
#: Blocks that are with the executors at once.
AT_ONCE = 2
#: Every byte that is no word becomes a space; A-Z become lower case.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return data.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.names = [name for name, _ in items]
        self.shortest = min([window, *(len(w) for _, w in items if w)])
        for n, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
        # the states are final now: walk each item again
        for n, (_, words) in enumerate(items):
            state = 0
            for at, w in enumerate(words, 1):
                state = self.next[state][self.vocabulary[w]]
                if at >= window:
                    owners.setdefault(self._holding(state, window), set()).add(n)
            if 0 < len(words) < window:
                self.short.setdefault(self._holding(state, len(words)), []).append((len(words), n))
        self.owners = {s: tuple(x) for s, x in owners.items()}
        #: the state that holds the window-long end of a state's words, or -1
        self.at_window = [self._holding(s, window) if self.length[s] >= window else -1 for s in range(len(self.link))]
        #: the nearest state on the way to the root, itself included, where a short item ends
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.ends = [-1] * len(self.link)
        for s in order:
            self.ends[s] = s if s in self.short else self.ends[self.link[s]] if s else -1

    def _holding(self, state: int, length: int) -> int:
        """The state for the last ``length`` words of what ``state`` stands for."""
        while state and self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length), self.link.append(link), self.next.append(moves)
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words (first, one past the last; disjoint, in order) and the numbers of the items hit."""
        ids = list(map(self.vocabulary.get, words))
        known = np.array([x is not None for x in ids], dtype=np.int8)
        edges = np.flatnonzero(np.diff(known, prepend=0, append=0))
        first, past = edges[::2], edges[1::2]
        long = past - first >= self.shortest
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        moves, link, length, window = self.next, self.link, self.length, self.window

        def add(a: int, b: int) -> None:
            while spans and a <= spans[-1][1]:
                a, b = min(a, spans[-1][0]), max(b, spans[-1][1])
                spans.pop()
            spans.append((a, b))

        for lo, hi in zip(first[long].tolist(), past[long].tolist()):
            state = run = 0
            for at in range(lo, hi):
                c = ids[at]
                while c not in moves[state]:
                    state = link[state]
                    if state < 0:
                        break
                    run = length[state]
                if state < 0:
                    state = run = 0
                    continue
                state, run = moves[state][c], run + 1
                if run >= window:
                    add(at - window + 1, at + 1)
                    found.update(self.owners[self.at_window[state]])
                end = self.ends[state]
                while end >= 0:
                    for k, n in self.short[end]:
                        if k <= run:
                            add(at - k + 1, at + 1)
                            found.add(n)
                    end = self.ends[link[end]]
        return spans, found


def windowed(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(id, text) of the items that can have a window, each once."""
    rows = items.select(F.col(item_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.where("id is not null and text is not null").distinct()


def n_blocks(rows: DataFrame, block_words: int = BLOCK_WORDS) -> int:
    size = F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    return max(1, -(-rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] // block_words))


def block(rows: DataFrame, k: int, n: int, window: int = WINDOW) -> Automaton:
    """The automaton of block ``k`` of ``n``; only its texts are on the driver."""
    part = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k) if n > 1 else rows
    return Automaton([(r.id, words_of(r.text.encode())) for r in sorted(part.collect())], window)


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("past", T.IntegerType())]))
_SPANS_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))


def _spans_column(rows) -> pa.Array:
    return pa.array([[{"first": x, "past": y} for x, y in s] for s in rows], _SPANS_ARROW)


def _walk(docs: DataFrame, items: DataFrame, finish, schema, window: int, block_words: int, at_once: int = AT_ONCE) -> DataFrame:
    """Take ``docs`` (its last column the text) through the automatons of all blocks.

    ``at_once`` blocks are sent out together; between such passes the spans and items found so
    far are written with the rows. ``finish(batch, texts, words, spans, names)`` makes the last
    pass's rows.
    """
    rows = windowed(items)
    n = n_blocks(rows, block_words)
    place = len(docs.columns) - 1
    between = T.StructType([*docs.schema.fields, T.StructField("spans_", _SPANS), T.StructField("names_", T.ArrayType(T.StringType()))])
    state = docs
    for lo in range(0, n, at_once):
        held = [docs.sparkSession.sparkContext.broadcast(block(rows, k, n, window)) for k in range(lo, min(n, lo + at_once))]
        opened, last = lo > 0, lo + at_once >= n

        def run(batches, held=held, opened=opened, last=last):
            for b in batches:
                texts = b.column(place).cast(pa.binary()).to_pylist()
                words = [words_of(x or b"") for x in texts]
                spans = [[(x["first"], x["past"]) for x in s] for s in b.column(place + 1).to_pylist()] if opened else [[] for _ in texts]
                names = [set(x) for x in b.column(place + 2).to_pylist()] if opened else [set() for _ in texts]
                for h in held:  # a batch meets one block after the other
                    machine = h.value
                    for own, s, found in zip(words, spans, names):
                        new, hit = machine.scan(own)
                        s.extend(new)
                        found.update(machine.names[i] for i in hit)
                spans = [merged(s) for s in spans]
                if last:
                    yield finish(b, texts, words, spans, names)
                else:
                    columns = [*b.columns[: place + 1], _spans_column(spans), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[: place + 1], "spans_", "names_"])

        out = map_text(state, run, schema if last else between)
        if last:
            return out
        done, state = state, written(out, "walked")
        dropped(done)
        for h in held:
            h.destroy()


def scan(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, items): for each row the hit spans of words and the ids of the items hit, sorted."""

    def finish(b, texts, words, spans, names):
        columns = [b.column(0), pa.array(map(len, words), pa.int64()), _spans_column(spans), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
        return pa.record_batch(columns, names=["doc_id", "n_words", "spans", "items"])

    return _walk(id_and_text(docs, doc_id, text), items, finish, f"doc_id long, n_words long, spans {_SPANS.simpleString()}, items array<string>", window, block_words)


def digest(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row, from :func:`scan`."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.past - x.first)
    n = F.size("items").cast("long")
    return scan(docs, items, **options).select("doc_id", "n_words", hits.alias("n_hit"), n.alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, disjoint and in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans of words, and without the white space before each."""
    at = [m.span() for m in _WORD.finditer(data)]
    out, done = [], 0
    for a, b in spans:
        out.append(data[done : at[a][0]].rstrip(b" \t\r"))
        done = at[b - 1][1]
    return b"".join([*out, data[done:]])


def clean(docs: DataFrame, items: DataFrame, text: str = "text", n_chars: str = "n_chars", window: int = WINDOW, max_span: int = WINDOW - 1, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without leaked test items.

    A hit span longer than ``max_span`` words goes from its text, as does every span of a short
    item; a document with more than ``max_coverage`` of its words hit goes as a whole. All other
    texts stay as they are to the byte. ``n_chars``, where there is such a column, follows the text.
    """
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(F.lit(0).alias("any_"), *[F.col(f"`{c}`") for c in rest]).alias("doc_"), F.col(f"`{text}`").cast("string").alias("text_"))

    def finish(b, texts, words, spans, names):
        keep, out = [], []
        for data, own, found in zip(texts, words, spans):
            keep.append(data is None or sum(y - x for x, y in found) <= max_coverage * len(own))
            gone = [(x, y) for x, y in found if y - x > max_span or y - x < window]
            out.append(without(data, gone) if keep[-1] and gone else data)
        both = pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_", "text_"])
        return both.filter(pa.array(keep, pa.bool_()))

    out = _walk(rows, items, finish, rows.schema, window, block_words)
    own = lambda c: F.col("doc_").getField(c)
    changed = {text: F.col("text_")}
    if n_chars in rest and isinstance(docs.schema[n_chars].dataType, (T.LongType, T.IntegerType)):
        changed[n_chars] = F.when(own(n_chars).isNotNull(), F.length("text_").cast(docs.schema[n_chars].dataType))
    return out.select(*[changed.get(c, own(c)).alias(c) for c in docs.columns])
