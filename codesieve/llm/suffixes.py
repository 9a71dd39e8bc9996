"""Repeated byte strings by enhanced suffix arrays.

In memory, maximal_repeats() sorts all suffixes of a set of texts, computes the common prefixes of neighbours, walks the
tree of common-prefix intervals with a stack and returns each interval whose occurrences differ in the byte before
(left-diverse): the maximal repeats, each with all occurrences.

Over a corpus, repeat_spans() finds each byte that is covered by a MIN-byte string which also starts in a document of a
smaller doc_id. A suffix array of everything would move each byte MIN times, so suffixes are first thinned without loss:

1. Equal texts are one text: a copy of a smaller doc_id's text is covered wholly.
2. In every MIN-byte window the K-byte string of the least hash is an anchor (about one position in 14); equal windows
   have equal anchors. Each part of the corpus sends the hashes of its distinct anchors, 5 bytes each, to buckets, which
   send back a bit for each: does it occur in two documents or parts?
3. Only for such anchors do contexts (the up to MIN bytes from the anchor on, and the up to MIN - K before it) go to the
   bucket of the anchor, once for each part and distinct context. There extents() builds the enhanced suffix array of the
   suffixes at the anchors, scans its common prefixes with a stack, and extends each interval of the tree to the left, by
   the order of the bytes before: where these differ the repeat is maximal. Each context gets the extent, left and right,
   of the maximal repeats of MIN bytes and more that it shares with a smaller document: all occurrences count, not only
   neighbours in the array.
   An anchor with very many contexts (the edges of a passage that is in a third of all documents) is split: its windows
   go to buckets by their own hash, so no bucket gathers the occurrences of one anchor; there the intervals at depth MIN
   are the windows that are equal.
4. Each part adds up what these extents cover.

So what is shuffled is the texts (for steps 2 and 3, and those with something to remove once more), 5 bytes an anchor, and
the contexts of repeated regions. No task holds more than a part of the texts or a bucket. Their size grows with the square
root of the input up to a fixed one, so that the messages between parts and buckets do not grow with its square before.

Nulls and odd rows: a null text is empty; nothing is removed from documents shorter than MIN bytes, from those with a
null doc_id (which count for nobody else either), or between rows of one doc_id; rows that repeat are judged once and
reported each; extra columns are ignored by repeat_report() and kept by remove_repeats(); an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, mix64, only_wanted, release, sliding, window_hash, workspace

MIN, K = 50, 24
W = MIN - K + 1  # grams in a window; windows that may hold an anchor
LEFT, WIDE = MIN - K, 2 * MIN - K  # context bytes before the anchor; of the whole context
MOST = U64(0xFFFFFFFFFFFFFFFF)
#: Occurrences of an anchor from which on its windows are dealt out by themselves.
HEAVY = 3000


# In memory ------------------------------------------------------------------------------------------------------------


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Order of the suffixes of an integer array, by prefix doubling."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    k = 1
    while n:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        order = np.lexsort((after, rank))
        new = np.ones(n, bool)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]])
        rank[order] = np.cumsum(new) - 1
        if new.all() or k >= n:
            return order
        k *= 2
    return np.zeros(0, np.int64)


def common_prefixes(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order (the first: 0)."""
    n = len(x)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    out, h = np.zeros(n, np.int64), 0
    for i in range(n):
        if place[i]:
            j = order[place[i] - 1]
            while i + h < n and j + h < n and x[i + h] == x[j + h]:
                h += 1
            out[place[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def intervals(prefixes: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, from, to) of each common-prefix interval of at least ``least``: a scan with a stack of open intervals."""
    stack: list[tuple[int, int]] = []
    for i, p in enumerate([*prefixes.tolist()[1:], 0], 1):
        begin = i - 1
        while stack and stack[-1][0] > p:
            length, begin = stack.pop()
            yield length, begin, i
        if p >= least and (not stack or stack[-1][0] < p):
            stack.append((p, begin))


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """(string, [(text, offset), ...]) of every maximal repeat of at least ``least`` bytes, with all its occurrences."""
    x = np.concatenate([np.concatenate((np.frombuffer(t, np.uint8).astype(np.int64), [256 + i])) for i, t in enumerate(texts)] or [np.zeros(0, np.int64)])
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    order = suffix_array(x)
    prefixes = common_prefixes(x, order)
    out = []
    for length, a, b in intervals(prefixes, least):
        at = order[a:b]
        before = {int(x[p - 1]) if p else -1 for p in at}
        if len(before) > 1 or before & {-1} or any(v >= 256 for v in before):  # left-diverse: the repeat can't grow to the left
            text = np.searchsorted(starts, at, side="right") - 1
            first = int(at[0])
            out.append((x[first : first + length].astype(np.uint8).tobytes(), sorted(zip(text.tolist(), (at - starts[text]).tolist()))))
    return out


# Over a corpus --------------------------------------------------------------------------------------------------------


class _Part:
    """The documents of one part as one byte array, with its anchors, found in slabs of whole documents."""

    def __init__(self, doc_ids: np.ndarray, texts: list[bytes]):
        self.ids = doc_ids
        self.size = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, document, hash) of each anchor."""
        found, at = [], 0
        while at < len(self.size):
            to = int(np.searchsorted(self.end, self.begin[at] + (1 << 19), side="left")) + 1
            to = min(max(to, at + 1), len(self.size))
            a, b = int(self.begin[at]), int(self.end[to - 1])
            if b - a >= MIN:
                found.append(self._slab(a, b, at, to))
            at = to
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def _slab(self, a: int, b: int, at: int, to: int):
        n = b - a
        doc = np.repeat(np.arange(at, to), self.size[at:to])
        room = self.end[doc] - a - np.arange(n)  # bytes from here to the document's end
        h = mix64(window_hash(self.data[a:b], K))
        inside = room[: len(h)] >= K
        h[~inside] = MOST
        least = sliding(np.minimum, h, W)
        least[room[: len(least)] < MIN] = 0
        pad = np.zeros(W - 1, U64)
        chosen = (sliding(np.maximum, np.concatenate((pad, least, pad)), W) == h) & inside
        p = np.flatnonzero(chosen)
        return p + a, doc[p], mix64(h[p] + U64(1))


def _by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U64(40)) % U64(buckets)).astype(np.int64)


def _distinct(h: np.ndarray, doc: np.ndarray, ids: np.ndarray, buckets: int):
    """Distinct hashes in order of bucket and hash: (order of the anchors, first of each, index of each anchor, bucket)."""
    order = np.lexsort((doc, h, _by_bucket(h, buckets)))
    s = h[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first = np.flatnonzero(new)
    index = np.empty(len(s), np.int64)
    index[order] = np.cumsum(new) - 1
    return order, first, index, _by_bucket(s[first], buckets)


def _cut(bucket: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket, np.arange(buckets + 1))


def _texts(table: pa.Table, copies: pa.Table) -> tuple[_Part, list[bytes]]:
    """The part's distinct rows that are no copies, in a fixed order, and their keys."""
    gone = set(zip(copies.column("doc_id").to_pylist(), copies.column("key").to_pylist()))
    rows = {(d, k): t for d, k, t in zip(table.column("doc_id").to_pylist(), table.column("key").to_pylist(), table.column("text").to_pylist()) if (d, k) not in gone}
    order = sorted(rows)
    return _Part(np.array([d for d, _ in order], np.int64), [rows[r].encode("utf-8", "surrogatepass") for r in order]), [k for _, k in order]


def _blobs(rows: list[tuple], names: str, kinds: list) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names.split())


def _send_anchors(buckets: int):
    def run(table: pa.Table, copies: pa.Table) -> pa.Table:
        names, kinds = "part bucket hashes notes", [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        if not len(table):
            return _blobs([], names, kinds)
        part = table.column("part")[0].as_py()
        p, _ = _texts(table, copies)
        _, doc, h = p.anchors()
        order, first, _, bucket = _distinct(h, doc, p.ids, buckets)
        n = np.diff(np.append(first, len(h)))
        own = p.ids[doc[order]]
        several = (np.maximum.reduceat(own, first) != np.minimum.reduceat(own, first)) if len(first) else np.zeros(0, bool)
        short = (h[order[first]] & U64(0xFFFFFFFF)).astype("<u4")
        note = (np.minimum(n, 127) | (several << 7)).astype(np.uint8)
        cut = _cut(bucket, buckets)
        rows = [(part, b, short[i:j].tobytes(), note[i:j].tobytes()) for b, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
        return _blobs(rows, names, kinds)

    return run


def _judge_anchors(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "bucket", "hashes", "notes"))), key=lambda r: r[0])
    short = np.concatenate([np.frombuffer(r[2], "<u4") for r in rows])
    note = np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows])
    order = np.argsort(short, kind="stable")
    s = short[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    many = np.diff(np.append(first, len(s)))
    n = np.add.reduceat((note[order] & 127).astype(np.int64), first)
    several = (many > 1) | (np.bitwise_or.reduceat(note[order] >> 7, first) > 0)
    level = np.where(several, np.where(n > HEAVY, 2, 1), 0).astype(np.uint8)
    answer = np.empty(len(s), np.uint8)
    answer[order] = np.repeat(level, many)
    out, at = [], 0
    for part, bucket, hashes, _ in rows:
        k = len(hashes) // 4
        a = answer[at : at + k]
        out.append((part, bucket, k, np.packbits(a > 0).tobytes(), np.packbits(a > 1).tobytes()))
        at += k
    return _blobs(out, "part bucket n several heavy", [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])


def _contexts(p: _Part, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(n, WIDE + 2): the bytes around each anchor, 0 beyond the document, then how many there are before and from it."""
    out = np.zeros((len(at), WIDE + 2), np.uint8)
    before = np.minimum(at - p.begin[doc], LEFT)
    after = np.minimum(p.end[doc] - at, MIN)
    data = np.concatenate((np.zeros(LEFT, np.uint8), p.data, np.zeros(MIN, np.uint8)))
    view = np.lib.stride_tricks.sliding_window_view(data, WIDE)
    k = np.arange(WIDE)[None, :] - LEFT
    for i in range(0, len(at), 50_000):
        own = slice(i, i + 50_000)
        out[own, :WIDE] = np.where((k >= -before[own, None]) & (k < after[own, None]), view[at[own]], 0)
    out[:, WIDE], out[:, WIDE + 1] = before, after
    return out


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of bytes."""
    h = np.zeros(len(rows), U64)
    for c in range(rows.shape[1]):
        h = h * U64(0x9E3779B97F4A7C15) + rows[:, c].astype(U64) + U64(1)
    return mix64(h)


def _group(key: np.ndarray, ids: np.ndarray, bucket_key: np.ndarray, buckets: int):
    """Distinct keys by bucket: (first occurrence, index of each row, smallest id of each, bucket of each)."""
    order = np.lexsort((ids, key, _by_bucket(bucket_key, buckets)))
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first = order[new]
    index = np.empty(len(s), np.int64)
    index[order] = np.cumsum(new) - 1
    return first, index, ids[first], _by_bucket(bucket_key[first], buckets)


#: kind 1: a document with candidates and their places; 2: contexts of a bucket; 3: windows of a bucket.
STEP = "kind int, part bigint, bucket bigint, blob binary, smallest binary, doc_id bigint, key binary, n_bytes bigint, places binary, wplaces binary"
STEP_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
STEP_NAMES = "kind part bucket blob smallest doc_id key n_bytes places wplaces"
#: What is sent back to a part: the bits of a bucket, or a document that is a copy.
BACK = "part bigint, bucket bigint, n bigint, several binary, heavy binary, doc_id bigint, key binary"


def _send_contexts(buckets: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not len(docs):
            return _blobs([], STEP_NAMES, STEP_TYPES)
        part = docs.column("part")[0].as_py()
        is_copy = back.column("bucket").is_null()
        answers = back.filter(pa.compute.invert(is_copy))
        p, keys = _texts(docs, back.filter(is_copy))
        at, doc, h = p.anchors()
        _, first, index, bucket = _distinct(h, doc, p.ids, buckets)
        level = np.zeros(len(first), np.uint8)
        cut = _cut(bucket, buckets)
        for b, n, several, heavy in zip(*(answers.column(c).to_pylist() for c in ("bucket", "n", "several", "heavy"))):
            if cut[b + 1] - cut[b] != n:
                raise ValueError("a part has changed between two reads")
            bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x in (several, heavy)]
            level[cut[b] : cut[b + 1]] = bits[0] + bits[1]
        own = level[index] if len(index) else np.zeros(0, np.uint8)
        rows: list[tuple] = []
        nothing = (None,) * 5
        # Contexts of ordinary anchors.
        i = np.flatnonzero(own == 1)
        context = _contexts(p, at[i], doc[i])
        f, context_of, smallest, bk = _group(_row_hash(context), p.ids[doc[i]], h[i], buckets)
        c = _cut(bk, buckets)
        rows += [(2, part, b, context[f[x:y]].tobytes(), smallest[x:y].astype("<i8").tobytes(), *nothing) for b, (x, y) in enumerate(zip(c, c[1:])) if y > x]
        del context
        # Windows around heavy anchors, by themselves.
        j = np.flatnonzero(own == 2)
        starts = np.unique((at[j][:, None] - np.arange(W)[None, :])[_valid(p, at[j], doc[j])])
        wdoc = np.searchsorted(p.end, starts, side="right")
        windows = np.lib.stride_tricks.sliding_window_view(p.data, MIN)[starts] if len(starts) else np.zeros((0, MIN), np.uint8)
        wh = _row_hash(windows)
        g, window_of, wsmallest, wb = _group(wh, p.ids[wdoc], wh, buckets)
        c = _cut(wb, buckets)
        rows += [(3, part, b, windows[g[x:y]].tobytes(), wsmallest[x:y].astype("<i8").tobytes(), *nothing) for b, (x, y) in enumerate(zip(c, c[1:])) if y > x]
        # Documents with candidates go on with the places of these.
        a, z = np.searchsorted(doc[i], [np.arange(len(p.ids)), np.arange(len(p.ids)) + 1], side="left")
        wa, wz = np.searchsorted(wdoc, [np.arange(len(p.ids)), np.arange(len(p.ids)) + 1], side="left")
        for d in np.flatnonzero((a < z) | (wa < wz)).tolist():
            places = np.stack((at[i[a[d] : z[d]]] - p.begin[d], context_of[a[d] : z[d]])).astype("<u4").tobytes()
            wplaces = np.stack((starts[wa[d] : wz[d]] - p.begin[d], window_of[wa[d] : wz[d]])).astype("<u4").tobytes()
            rows.append((1, part, None, None, None, int(p.ids[d]), keys[d], int(p.size[d]), places, wplaces))
        release()
        return _blobs(rows, STEP_NAMES, STEP_TYPES)

    return run


def _valid(p: _Part, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(n, W): is the window that begins so many bytes before the anchor within the document?"""
    k = np.arange(W)[None, :]
    return (k <= (at - p.begin[doc])[:, None]) & (MIN - k <= (p.end[doc] - at)[:, None])


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """The byte rows as big-endian 64-bit words, a column each."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return list(padded.view(">u8").astype(U64).T)


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the byte rows of a and b, at most ``most``."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), most)


def _smallest(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each byte row the smallest id among the rows equal to it: the intervals of the sorted rows at their full depth."""
    words = _words(rows)
    order = np.lexsort(words[::-1])
    new = np.ones(len(rows), bool)
    new[1:] = np.any([w[order[1:]] != w[order[:-1]] for w in words], axis=0)
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(ids[order], first) if len(first) else ids[:0]
    out = np.empty(len(rows), np.int64)
    out[order] = np.repeat(low, np.diff(np.append(first, len(rows))))
    return out


def _left_extents(members: list[int], rank: list[int], number: list[int], before: list[int], ids: list[int]) -> list[tuple[int, int]]:
    """(member, most bytes before the anchor that it shares with a member of a smaller id) of an interval of the tree.

    In the order of the bytes before, read backwards, the nearest member of a smaller id on either side shares the most:
    two scans with a stack. Where all share all bytes, the interval is not left-diverse here and one id decides.
    """
    by = sorted(members, key=rank.__getitem__)
    x, y = by[0], by[-1]
    if number[x] == number[y] and before[x] == before[y] == LEFT:
        least = min(map(ids.__getitem__, by))
        return [(i, LEFT) for i in by if ids[i] > least]
    best = dict.fromkeys(by, -1)
    for way in (by, by[::-1]):
        stack: list[int] = []
        for i in way:
            while stack and ids[stack[-1]] >= ids[i]:
                stack.pop()
            if stack:
                j = stack[-1]
                shared = min(LEFT - (((number[i] ^ number[j]).bit_length() + 7) >> 3), before[i], before[j])
                if shared > best[i]:
                    best[i] = shared
            stack.append(i)
    return [(i, k) for i, k in best.items() if k >= 0]


def extents(data: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes before the anchor, bytes from it) that each context shares, in repeats of MIN bytes and more, with one of a smaller id.

    data: as _contexts() makes it. 0 and 0 where there is no such repeat; else the two reach over the union of all of them,
    which is one piece, as each holds the anchor.
    """
    n = len(ids)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return left, right
    ahead, behind = data[:, LEFT:WIDE], data[:, LEFT - 1 :: -1][:, :LEFT]
    before, after = data[:, WIDE].astype(np.int64), data[:, WIDE + 1].astype(np.int64)
    # The suffix array of the contexts (an end is less than any byte), equal contexts in order of their ids.
    order = np.lexsort([ids, before, *_words(behind)[::-1], after, *_words(ahead)[::-1]])
    o, p = order[1:], order[:-1]
    same = (data[o] == data[p]).all(axis=1)
    # Of equal contexts all but those of the smallest id are covered as far as they reach; one of them goes on.
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    run = np.repeat(first, np.diff(np.append(first, n)))
    full = (ids[order] > ids[order[run]]) & (before[order] + after[order] >= MIN)
    left[order[full]], right[order[full]] = before[order[full]], after[order[full]]
    u = order[first]
    prefix = np.zeros(len(u), np.int64)  # common prefix of each distinct context and the one before it
    prefix[1:] = _common(ahead[u[1:]], ahead[u[:-1]], np.minimum(after[u[1:]], after[u[:-1]]))
    begin = np.flatnonzero(prefix < K)  # an anchor's contexts lie together
    size = np.diff(np.append(begin, len(u)))
    found_left, found_right = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
    # Anchors with two contexts: one interval each.
    two = begin[size == 2]
    if len(two):
        x, y = u[two], u[two + 1]
        reach = _common(behind[x], behind[y], np.minimum(before[x], before[y]))
        good = (reach + prefix[two + 1] >= MIN) & (ids[x] != ids[y])
        later = np.where(ids[x] > ids[y], two, two + 1)[good]
        found_left[later], found_right[later] = reach[good], prefix[two + 1][good]
    # The others: the tree of common-prefix intervals, each extended to the left.
    for a, m in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
        own = u[a : a + m]
        number = [int.from_bytes(r, "big") for r in map(bytes, behind[own])]
        many_before, many_ids = before[own].tolist(), ids[own].tolist()
        rank = list(range(m))
        for k, i in enumerate(sorted(range(m), key=lambda i: (number[i], many_before[i]))):
            rank[i] = k
        for depth, x, y in intervals(np.concatenate(([0], prefix[a + 1 : a + m])), K):
            for i, k in _left_extents(list(range(x, y)), rank, number, many_before, many_ids):
                if k + depth >= MIN:
                    found_left[a + i] = max(found_left[a + i], k)
                    found_right[a + i] = max(found_right[a + i], depth)
    # What a context shares holds for its occurrences in the smallest document; the others are covered wholly, or as far.
    spread = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    left[order] = np.maximum(left[order], found_left[spread])
    right[order] = np.maximum(right[order], found_right[spread])
    return left, right


def _judge_contexts(table: pa.Table) -> pa.Table:
    """For each context its extents, a byte each; for each window a byte: does a smaller document have it?"""
    out = []
    bucket = table.column("bucket")[0].as_py()
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "part", "blob", "smallest"))), key=lambda r: r[:2])
    for kind, width in ((2, WIDE + 2), (3, MIN)):
        own = [r for r in rows if r[0] == kind]
        if not own:
            continue
        data = np.concatenate([np.frombuffer(r[2], np.uint8).reshape(-1, width) for r in own])
        ids = np.concatenate([np.frombuffer(r[3], "<i8") for r in own])
        marks = (_smallest(data, ids) < ids).astype(np.uint8)[:, None] if kind == 3 else np.stack(extents(data, ids), axis=1).astype(np.uint8)
        at = 0
        for _, part, blob, _ in own:
            n = len(blob) // width
            out.append((part, bucket, kind, marks[at : at + n].tobytes()))
            at += n
    release()
    return _blobs(out, "part bucket kind marks", [pa.int64(), pa.int64(), pa.int32(), pa.binary()])


SPANS = "doc_id bigint, key binary, n_removed bigint, n_spans bigint, spans binary"


def _find_spans(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents that lose something, with (begin, end) of each span as 32-bit integers."""
    names, kinds = "doc_id key n_removed n_spans spans", [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    rows = list(zip(*(docs.column(c).to_pylist() for c in ("doc_id", "key", "n_bytes", "places", "wplaces"))))
    got = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "marks"))), key=lambda r: r[:2])
    told, seen = (np.concatenate([np.frombuffer(m, np.uint8) for k, _, m in got if k == kind] or [np.zeros(0, np.uint8)]).astype(np.int64) for kind in (2, 3))
    told = told.reshape(-1, 2)
    places = [[np.frombuffer(b, "<u4").reshape(2, -1).astype(np.int64) for b in r[3:]] for r in rows]
    low = [np.full(len(x), np.iinfo(np.int64).max) for x in (told, seen)]  # smallest id of the part with this context, or window
    for r, own in zip(rows, places):
        for k in (0, 1):
            np.minimum.at(low[k], own[k][1], r[0])
    out = []
    for (doc_id, key, size, _, _), ((at, context), (starts, window)) in zip(rows, places):
        before, after = np.minimum(at, LEFT), np.minimum(size - at, MIN)
        left, right = told[context].T
        own = low[0][context] < doc_id
        here = own & (before + after >= MIN)
        left, right = np.where(here, before, left), np.where(here, after, right)
        on = left + right >= MIN
        hit = starts[(seen[window] > 0) | (low[1][window] < doc_id)]
        begin, end = np.concatenate(((at - left)[on], hit)), np.concatenate(((at + right)[on], hit + MIN))
        if len(begin):
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], np.maximum.accumulate(end[order])
            new = np.concatenate(([True], begin[1:] > end[:-1]))
            spans = np.stack((begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]), axis=1)
            out.append((doc_id, key, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), spans.astype("<u4").tobytes()))
    release()
    return _blobs(out, names, kinds)


def cut_spans(text: str, spans: bytes, whole: bool) -> bytes:
    """The bytes of a text outside the spans; whole: a character of which some bytes stay, stays whole."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    gone = np.zeros(len(b), bool)
    for x, y in np.frombuffer(spans, "<u4").reshape(-1, 2).tolist():
        gone[x:y] = True
    if whole:
        char = np.cumsum((b & 0xC0) != 0x80) - 1
        stays = np.zeros(int(char[-1]) + 1 if len(b) else 0, bool)
        np.logical_or.at(stays, char[~gone], True)
        return b[stays[char]].tobytes()
    return b[~gone].tobytes()


def _release(df: DataFrame) -> None:
    """Lets Spark drop the shuffle files of finished steps now, not when the driver happens to collect its garbage."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without rows that the task has passed on before, so that one that repeats is no heavier than the number of tasks."""
    workspace("suffixes")
    seen: set[tuple] = set()
    for batch in batches:
        keep = []
        for row in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()):
            keep.append(row not in seen)
            seen.add(row)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and key, the MD5 of the text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))


def _size(total: int, most: int) -> int:
    """Bytes of a part or bucket: the square root of 16 KiB times the input, from 4 MiB to ``most``."""
    return min(most, max(4 << 20, math.isqrt(total << 14)))


def repeat_spans(docs: DataFrame, scratch: Scratch, part_bytes: int | None = None, bucket_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_bytes and sha256 of each row; doc_id, key, n_removed, n_spans and spans of each that loses something).

    Both are tables of files; a copy of a smaller doc_id's text has null spans and loses all.
    """
    rows = _keyed(docs)
    keys = scratch.put(rows.select("doc_id", "key", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")), "keys")
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    parts, buckets = max(1, -(-total // (part_bytes or _size(total, 32 << 20)))), max(1, -(-total // (bucket_bytes or 2 * _size(total, 16 << 20))))
    part_of = F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).alias("part")
    long = keys.filter("doc_id is not null").filter(F.col("n_bytes") >= MIN)
    first = long.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").select("key", "first_id")
    copies = scratch.put(long.join(first, "key").filter("first_id < doc_id").select("doc_id", "key", "n_bytes").distinct().select("*", part_of), "copies")  # no texts
    texts = rows.filter("doc_id is not null").filter(F.octet_length("text") >= MIN).mapInArrow(_once, rows.schema).select("doc_id", "key", "text", part_of)
    sent = texts.groupBy("part").cogroup(copies.select("doc_id", "key", "part").groupBy("part")).applyInArrow(_send_anchors(buckets), "part bigint, bucket bigint, hashes binary, notes binary")
    judged = scratch.put(sent.groupBy("bucket").applyInArrow(_judge_anchors, "part bigint, bucket bigint, n bigint, several binary, heavy binary"), "anchors")
    _release(docs)
    none = F.lit(None)
    back = judged.select("*", none.cast("bigint").alias("doc_id"), none.cast("binary").alias("key")).unionByName(
        copies.select("part", none.cast("bigint").alias("bucket"), none.cast("bigint").alias("n"), none.cast("binary").alias("several"), none.cast("binary").alias("heavy"), "doc_id", "key")
    )
    step = scratch.put(texts.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(_send_contexts(buckets), STEP), "contexts")
    _release(docs)
    marks = step.filter("kind >= 2").select("kind", "part", "bucket", "blob", "smallest").groupBy("bucket").applyInArrow(_judge_contexts, "part bigint, bucket bigint, kind int, marks binary")
    marks = scratch.put(marks, "marks")
    _release(docs)
    pending = step.filter("kind = 1").select("part", "doc_id", "key", "n_bytes", "places", "wplaces")
    spans = pending.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(_find_spans, SPANS)
    copies = copies.select("doc_id", "key", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), none.cast("binary").alias("spans"))
    lost = scratch.put(spans.unionByName(copies), "spans")
    scratch.drop(keys, lost)
    return keys, lost


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [hashlib.sha256(cut_spans(t, s, False)).hexdigest() for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sums, pa.string())], names=["doc_id", "key", "kept_sha256"])


def repeat_report(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs."""
    scratch = Scratch()
    keys, lost = repeat_spans(docs, scratch, **sizes)
    some = lost.filter("spans is not null")
    row = F.xxhash64("doc_id", "key").alias("row")
    thin = only_wanted(_keyed(docs).select("*", row), "row", scratch.put(some.select(row).distinct(), "changed"), _once, "doc_id bigint, text string, key binary, row bigint")
    left = thin.join(some.select("doc_id", "key", "spans"), ["doc_id", "key"]).mapInArrow(_digests, "doc_id bigint, key binary, kept_sha256 string").dropDuplicates(["doc_id", "key"])
    told = lost.drop("spans").join(scratch.put(left, "digests"), ["doc_id", "key"], "left").withColumn("kept_sha256", F.coalesce("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    out = keys.join(told, ["doc_id", "key"], "left")
    none = F.lit(0).cast("bigint")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, **sizes: int) -> DataFrame:
    """docs without repeated strings; all its columns, n_chars (if there) made right; rows of which only white space is left go.

    Rows that repeat stay once.
    """

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.where(spans.isna(), [None if s is None or t is None else cut_spans(t, bytes(s), True).decode("utf-8", "replace") for t, s in zip(text, spans)])

    _, lost = repeat_spans(docs, Scratch(), **sizes)
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("spans").alias("_spans"), F.lit(True).alias("_lost"))
    own = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    out = docs.dropDuplicates(["doc_id", "text"]).withColumn("_own", own).join(lost, (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_key")), "left")
    out = out.filter("_lost is null or _spans is not null").withColumn("text", cut("text", "_spans")).filter(F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
