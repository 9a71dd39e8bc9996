"""Best-fit packing with certified bounds.

Documents are tokenised, an end id is added, and only those longer than a sequence are cut. Pieces that fill a sequence
are done. The others are dealt to partitions of a bounded size by a hash of their row (no key decides), and each
partition is packed by best-fit decreasing. Dual-feasible functions give a lower bound on the number of sequences that
the partition's lengths need; where the packing meets it, it is certified optimal and stays. Partitions with a gap keep
their full sequences and give up the pieces of the others, which are dealt anew, together, to fewer partitions and
packed again, for a fixed number of rounds.

Nulls and odd rows: a null or empty text is one end id; documents with a null doc_id and repeated rows are packed each;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, tokenizer_path, word_cache, workspace

PIECES = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = "uid bigint, length bigint, sequence_id bigint, offset bigint, bins bigint, bound bigint"


def tokenised_pieces(docs: DataFrame, size: int, path: str, end_id: int = 1) -> DataFrame:
    """The pieces of each row of docs, with a uid for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workspace("tokens")
        cache = word_cache(path)
        uid = TaskContext.get().partitionId() << 36
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), cache.encode(batch.column("text")), strict=True):
                ids = np.frombuffer(own, cache.dtype).astype("<u4").tobytes() + end
                for k in range(0, len(ids) // 4, size):
                    part = ids[4 * k : 4 * (k + size)]
                    rows.append((uid, doc_id, k // size, k, len(part) // 4, zlib.crc32(part)))
                    uid += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each piece and the fill of each bin: each piece, longest first, goes where the least room is left.

    A bit mask of the rooms that are left finds the tightest bin in a few integer operations.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    mask, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            own = rooms[room]
            b = own.pop()
            if not own:
                mask ^= 1 << room
        else:
            b, room = len(fill), size
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        left = room - n
        if left:
            if not rooms[left]:
                mask |= 1 << left
            rooms[left].append(b)
    return bins, offsets, fill


def lower_bound(lengths: np.ndarray, size: int, most_k: int = 100) -> int:
    """Sequences that these lengths need at least: the best of several families of dual-feasible functions.

    The identity; u_k, which rounds (k + 1) x / size down to multiples of 1 / k; and the functions that drop what is
    shorter than eps and count what is longer than size - eps as a whole sequence.
    """
    if not len(lengths):
        return 0
    x, n = np.unique(lengths, return_counts=True)
    x, n = x.astype(np.int64), n.astype(np.int64)
    best = -(-int((x * n).sum()) // size)
    for k in range(1, most_k + 1):
        whole = (k + 1) * x % size == 0
        value = np.where(whole, k * x, (k + 1) * x // size * size)  # times 1 / (k * size)
        best = max(best, -(-int((value * n).sum()) // (k * size)))
    for eps in x[x <= size // 2].tolist():
        long = x > size - eps
        value = np.where(long, size, np.where(x < eps, 0, x))
        best = max(best, -(-int((value * n).sum()) // size))
    return best


def _packer(k: int, last: bool, size: int):
    """Packs a partition; unless it is certified or the round is the last, its emptiest sequences give up their pieces."""

    def run(group: pa.Table) -> pa.Table:
        lengths, uids = group.column("length").to_numpy(), group.column("uid").to_numpy()
        part = group.column("part")[0].as_py()
        order = np.lexsort((uids, lengths))
        lengths, uids = lengths[order], uids[order]
        bins, offsets, fill = best_fit_decreasing(lengths, size)
        bound, full = lower_bound(lengths, size), np.array(fill, np.int64)
        keep = np.ones(len(full), bool)
        if len(full) > bound and not last:  # the emptiest sequences hold the gap
            spare = min(len(full), max(8 * (len(full) - bound), len(full) // 20))
            keep[np.argsort(full, kind="stable")[:spare]] = False
        ids = np.where(keep[bins], (k << 56) + (part << 28) + bins, -1)
        columns = (uids, lengths, ids, offsets, np.full(len(ids), len(full)), np.full(len(ids), bound))
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["uid", "length", "sequence_id", "offset", "bins", "bound"])

    return run


def pack(pieces: DataFrame, size: int, rows_a_partition: int = 40_000, rounds: int = 3) -> DataFrame:
    """pieces with sequence_id and offset; pieces must be a table of files, as each round reads it or a part of it."""
    columns = [c for c in pieces.columns]
    whole = pieces.filter(F.col("length") == size).withColumns({"sequence_id": -1 - F.col("uid"), "offset": F.lit(0).cast("bigint")})
    done = [whole.select(*columns, "sequence_id", "offset")]
    left = pieces.filter(F.col("length") < size).select("uid", "length")
    n = left.count()
    placed = []
    for k in range(rounds):
        parts = max(1, -(-n // rows_a_partition))
        last = k == rounds - 1 or parts == 1  # nobody to exchange with

        dealt = left.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(parts)))
        out = materialise(dealt.groupBy("part").applyInArrow(_packer(k, last, size), PLACED), f"packed-{k}")
        placed.append(out.filter("sequence_id >= 0").select("uid", "sequence_id", "offset"))
        left = out.filter("sequence_id < 0").select("uid", "length")
        n = left.count() if not last else 0
        if not n:
            break
    where = placed[0]
    for p in placed[1:]:
        where = where.unionByName(p)
    done.append(pieces.join(where, "uid").select(*columns, "sequence_id", "offset"))
    return done[0].unionByName(done[1])


def pack_documents(docs: DataFrame, size: int = 4096, path: str | None = None, rows_a_partition: int = 40_000, rounds: int = 3) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece; texts are read once, never shuffled."""
    pieces = materialise(tokenised_pieces(docs, size, path or tokenizer_path()), "pieces")
    return pack(pieces, size, rows_a_partition, rounds).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
