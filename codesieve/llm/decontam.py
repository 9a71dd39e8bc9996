"""Benchmark decontamination by pigeonhole edit matching.

Each test item (lower-cased, white space runs made one space) may occur in a document with up to e = floor(rate * its
length) edits. Cut into e + 1 pieces, at least one piece must then occur unedited: all pieces of a block of items are
searched in one pass of an Aho-Corasick automaton, and each hit is verified by Myers' bit-parallel distance over the
stretch of the document that the piece's place in the item allows. The test items are a stated query set: they are
held in memory in blocks of at most block_chars characters, and every block sees every document.

Nulls and odd rows: null or empty documents match nothing, null or empty items are no items; items that repeat are
reported each by its own id; rows that repeat are matched each on their own; empty tables give no rows; further columns
pass through drop_contaminated() and are ignored by find_contamination().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, workspace

BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(length: int, rate: float) -> int:
    """Edits that an item of so many characters may have."""
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of nearly equal length that together are the item."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place in text where pattern occurs with at most ``most`` edits, else None.

    The bit-parallel scan of a pattern against a text: a Python integer holds the column of vertical differences.
    """
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    up, down, score = mask, 0, m
    best: tuple[int, int] | None = None
    for j, c in enumerate(text):
        e = eq.get(c, 0)
        xv = e | down
        xh = (((e & up) + up) ^ up) | e
        ph, mh = down | ~(xh | up) & mask, up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        up, down = mh | ~(xv | ph) & mask, ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, budget(len(t), rate)) for i, t in ((i, normal(t)) for i, t in items) if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            for offset, piece in pieces(t, e):
                places.setdefault(piece, []).append((k, offset))
        self.machine = ahocorasick.Automaton() if places else None
        for piece, where in places.items():
            self.machine.add_word(piece, (len(piece), tuple(where)))
        if self.machine is not None:
            self.machine.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, distance) of each item that occurs in the text within its budget, at its least distance."""
        if self.machine is None or not text:
            return []
        doc = normal(text)
        found: dict[int, int] = {}
        tried: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.machine.iter(doc):
            for k, offset in where:
                if found.get(k) == 0:
                    continue
                _, item, e = self.items[k]
                start = end - size + 1 - offset
                if start >= 0 and doc.startswith(item, start):
                    found[k] = 0
                elif e:
                    lo, hi = max(0, start - e), start + len(item) + e
                    if any(a <= lo and hi <= b for a, b in tried.get(k, ())):
                        continue
                    wide = (max(0, lo - e), hi + e)  # one scan serves the neighbouring pieces too
                    tried.setdefault(k, []).append(wide)
                    best = myers(item, doc[wide[0] : wide[1]], e)
                    if best is not None and best[0] < found.get(k, e + 1):
                        found[k] = best[0]
        return [(self.items[k][0], d) for k, d in found.items()]


@lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[int, str], ...], rate: float) -> Matcher:
    return Matcher(list(items), rate)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[tuple[int, str], ...]]:
    """The test items in blocks of at most block_chars characters (or one item), streamed to the driver."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r["text"]) > block_chars:
            yield tuple(block)
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield tuple(block)


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance) for each item found in a document; one pass over docs for each block, no shuffle."""
    out = None
    for block in item_blocks(benchmark, block_chars):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            workspace("decontam")
            matcher = _matcher(held.value, rate)
            for batch in slices(batches):
                rows = [(d, i, n) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for i, n in matcher.find(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], names=["doc_id", "item_id", "distance"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_id bigint, distance int")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, distance int")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs in which no test item occurs, with all their columns; the texts are not shuffled."""
    rows = docs
    for block in item_blocks(benchmark, block_chars):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            workspace("decontam")
            matcher = _matcher(held.value, rate)
            for batch in slices(batches):
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
    return rows


def contamination_report(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05) -> DataFrame:
    """find_contamination() with its rows made distinct where documents repeat."""
    return find_contamination(docs, benchmark, rate).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))
