"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from venuemill.llm.blocks import frugal, held, small_batches

WINDOW = 10
#: Words of test items in one automaton; more items are scanned for in further passes.
AUTOMATON_WORDS = 1_000_000
#: Documents with a greater share of hit words are dropped whole.
COVERAGE = 0.5
SPANS = ArrayType(ArrayType(IntegerType()))

_WORDY = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(body: bytes | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (body or b"").translate(_WORDY).split()


class Automaton:
    """Recognises every run of words of the items, and tells how long the current match is."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.number = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        items = [(name, [self.number.setdefault(w, len(self.number)) for w in words]) for name, words in items if words]
        for _, ids in items:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        size = len(self.next)
        order = sorted(range(1, size), key=self.length.__getitem__)
        # the state of a match's last ``window`` words, and the items that hold them
        self.cut = [0] * size
        for s in order:
            up = self.link[s]
            self.cut[s] = self.cut[up] if self.length[up] >= window else s if self.length[s] >= window else 0
        self.holders: dict[int, set[str]] = {}
        # items shorter than a window: their own state, and all of them on the way to the root
        own: dict[int, list] = {}
        for name, ids in items:
            state = 0
            for k, w in enumerate(ids):
                state = self.next[state][w]
                if k + 1 >= window:
                    self.holders.setdefault(self._state_of(state, window), set()).add(name)
            if len(ids) < window:
                own.setdefault(self._state_of(state, len(ids)), []).append((len(ids), name))
        self.own, self.above = own, {}
        if own:
            for s in order:
                up = self.link[s]
                marks = self.above.get(up, []) + own.get(up, [])
                if marks:
                    self.above[s] = marks
        self.shortest = min((min(len(ids), window) for _, ids in items), default=window)

    def _state_of(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal runs of hit words, as (start, end), and the items whose windows occur."""
        get = self.number.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= self.shortest:
                self._run(a, ids[a:b].tolist(), spans, items)
        return spans, items

    def _run(self, at: int, ids: list[int], spans: list, items: set) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        short = bool(self.own)
        state = n = 0
        for w in ids:
            at += 1
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w not in nxt[state]:
                continue
            state = nxt[state][w]
            n += 1
            found = 0
            if n >= window:
                items |= self.holders.get(self.cut[state], set())
                found = window
            if short:
                for k, name in self.above.get(state, []):
                    items.add(name)
                    found = max(found, k)
                for k, name in self.own.get(state, []):
                    if k <= n:
                        items.add(name)
                        found = max(found, k)
            if found:
                start = at - found
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, at))


def _automata(benchmark: DataFrame, window: int, most_words: int):
    """Functions that give an automaton in a task, each of at most ``most_words`` words (or one longer item)."""
    small_batches(benchmark)
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    total = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / 2 / most_words))  # a word and its gap have two bytes at least
    out = []
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()
        shared = benchmark.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in rows])
        name = uuid.uuid4().hex

        def automaton(shared=shared, name=name) -> Automaton:
            return held(f"automaton {name}", lambda: Automaton([(i, words_of(t.encode())) for i, t in shared.value], window))

        out.append(automaton)
    return out


def _hits(shaped: DataFrame, automata) -> DataFrame:
    """(row, body) with the number of words, the spans of hit words and the items, over all automata."""
    spans_type, items_type = pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())
    for automaton in automata:
        more = "n_words" in shaped.columns

        def run(batches: Iterator[pa.RecordBatch], automaton=automaton, more=more) -> Iterator[pa.RecordBatch]:
            machine = automaton()
            for batch in batches:
                counts, spans, items = [], [], []
                old = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()) if more else ((None, None) for _ in range(batch.num_rows))
                for body, (before, names) in zip(batch.column(1).to_pylist(), old):
                    words = words_of(body)
                    found, own = machine.scan(words)
                    counts.append(len(words))
                    spans.append(_union(found, before) if before else found)
                    items.append(sorted(own.union(names or ())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, spans_type), pa.array(items, items_type)],
                    ["row", "body", "n_words", "spans", "items"],
                )

        schema = shaped.select("row", "body").schema.add("n_words", "long").add("spans", SPANS).add("items", ArrayType(StringType()))
        shaped = shaped.mapInArrow(frugal(run, holds=True), schema)
    return shaped


def _union(a: list, b: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([*map(tuple, a), *map(tuple, b)]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", most_words: int = AUTOMATON_WORDS
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) of every row.

    ``spans`` are maximal runs of hit words, as [start, end).  ``benchmark`` has (item_id, text); an
    item below ``window`` words counts as one window, one without words as none, a null id as "".
    Null and empty texts have no words; repeated rows each have their row.
    """
    shaped = docs.select(F.col(doc_id).cast("long").alias("row"), F.col(text).cast("string").cast("binary").alias("body"))
    hits = _hits(shaped, _automata(benchmark, window, most_words))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s[1] - s[0]).cast("long"))
    return hits.select(F.col("row").alias("doc_id"), "n_words", n_hit.alias("n_hit"), "spans", "items")


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, text: str = "text"
) -> DataFrame:
    """The documents without the hit spans, all columns as they were; those hit over ``coverage`` of their words are dropped.

    A span goes from the first byte of its first word to the last of its last
    word; untouched texts stay byte for byte.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    hits = _hits(docs.select(row, F.col(text).cast("string").cast("binary").alias("body")), _automata(benchmark, window, AUTOMATON_WORDS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, cleaned = [], []
            for i, (body, n, spans) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                if sum(b - a for a, b in spans) > coverage * n:
                    continue
                kept.append(i)
                if spans:
                    places = [m.span() for m in _WORD.finditer(body.translate(_WORDY))]
                    ends = [0, *(places[b - 1][1] for _, b in spans)]
                    starts = [*(places[a][0] for a, _ in spans), len(body)]
                    body = b"".join(body[a:b] for a, b in zip(ends, starts))
                cleaned.append(None if body is None else body.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(cleaned, pa.string())], ["row", "clean"])

    out = hits.mapInArrow(frugal(cut), hits.select("row").schema.add("clean", "string"))
    return out.select(*[F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
