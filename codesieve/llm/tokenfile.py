"""Token-id files coded by an adaptive context-mixing range coder.

A file is a row of blocks of up to BLOCK ids. A block is coded on its own, from a model that starts anew, and carries a
checksum of its ids and one of its bytes, so any block can be read alone. Within a block the ids are cut into lanes of
equal length that are coded side by side as numpy vectors, each with its own range coder, all with the block's one model:

* order 2: the id that last followed the two ids before (a hashed table), with a confidence from 0 to 7;
* order 1: the id that last followed the id before, with a confidence;
* order 0: adaptive frequencies of all ids, renewed whenever the ids that the two others missed have grown by an eighth
  (by REFRESH[0] ids at least, after REFRESH[1] in any case).

The three are mixed into one distribution: the weights of the order-2 and order-1 predictions, and what is left to
order 0, are adaptive counts of their successes by both confidences and whether the two predictions agree. An id is
coded by its interval in that mixture. The model learns after every CHUNK steps, by the same code in both directions; the
weights are renewed each time at first, then every WEIGH times.

Nulls and odd rows: a null text has no ids but the end id; repeated rows and ids are written each; documents with a null
doc_id come first; extra columns are ignored; an empty table gives no files.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, open_store, shared_path, slice_coder, slices, tokenizer_path, workspace
from .ranges import deal, range_bounds, shard_column

MAGIC = b"CMRC0003"
BLOCK, LANES, CHUNK = 3 << 20, 2048, 4
M_BITS = 24
M = 1 << M_BITS
BOTTOM = U64(1 << 32)
SHIFT, WORD, FULL = U64(M_BITS), U64(32), U64((1 << 64) - 1)
SLICE = 16 << 20  # bytes of texts that are tokenised at once: the larger, the fewer words are met again
HEAD = struct.Struct("<IHIII")  # ids, lanes, payload bytes, crc32 of the ids, crc32 of the payload


class Model:
    """The mixed predictions of one block."""

    HASH_BITS, STEP, REFRESH, WEIGH = 18, 16, (1 << 13, 1 << 16), 8

    def __init__(self, vocabulary: int):
        self.t1 = np.zeros(vocabulary + 1, np.int32)  # prediction << 3 | confidence; the last row: no id before
        self.t2 = np.zeros(1 << self.HASH_BITS, np.int32)
        self.freq = np.ones(vocabulary, np.int64)
        self._ids = np.arange(vocabulary, dtype=np.uint16 if vocabulary <= 1 << 16 else np.uint32)
        self.stats = np.tile(np.array([1, 1, 4], np.int64), (128, 1))
        self.waiting: list[np.ndarray] = []
        self.missed = self.held = self.turns = 0  # ids in the frequencies, ids that wait, times it has learnt
        self.cum = np.zeros(vocabulary + 1, np.int64)  # scaled to M parts
        self._count()
        self._weigh()

    def _count(self) -> None:
        if self.waiting:
            self.freq += self.STEP * np.bincount(np.concatenate(self.waiting), minlength=len(self.freq))
            self.missed, self.held, self.waiting = self.missed + self.held, 0, []
        np.cumsum(self.freq, out=self.cum[1:])
        if self.cum[-1] > M >> 4:  # so that no id's part of a rest of M / 16 is empty
            self.freq = (self.freq + 1) >> 1
            np.cumsum(self.freq, out=self.cum[1:])
        self.total = int(self.cum[-1])
        self.cum <<= M_BITS
        self.cum //= self.total
        self._owner = None

    def _weigh(self) -> None:
        n = self.stats.sum(axis=1)
        self.w2 = np.clip(self.stats[:, 0] * M // n, 64, M * 9 // 10)
        self.w1 = np.minimum(np.clip(self.stats[:, 1] * M // n, 64, None), M * 15 // 16 - self.w2)
        self.w1[1::2] = 0  # both predict the same id
        self.base = self.w2 + self.w1
        self.rest = M - self.base
        self.rest_float = self.rest.astype(float)

    def look(self, before2: np.ndarray, before1: np.ndarray):
        """(place in t2, what t2 and t1 hold, their predictions, mixing context)."""
        place = ((before2 * 0x9E3779B1 + before1 * 0x85EBCA6B) >> 7) & ((1 << self.HASH_BITS) - 1)
        a, b = self.t2.take(place), self.t1.take(before1)
        p2, p1 = a >> 3, b >> 3
        return place, a, b, p2, p1, ((a & 7) << 4) | ((b & 7) << 1) | (p1 == p2)

    def intervals(self, ids: np.ndarray, p2: np.ndarray, p1: np.ndarray, context: np.ndarray):
        """(start, size) of the ids in the mixture of M parts."""
        rest = self.rest.take(context)
        start = rest * self.cum.take(ids) >> M_BITS
        size = (rest * self.cum.take(ids + 1) >> M_BITS) - start
        start += self.base.take(context)
        for hit, begin, part in ((ids == p1, self.w2, self.w1), (ids == p2, None, self.w2)):  # order 2 goes first
            at = hit.nonzero()[0]
            own = context[at]
            start[at] = 0 if begin is None else begin[own]
            size[at] = part[own]
        return start, size

    def find(self, v: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The ids whose order-0 parts of ``rest`` hold the values v; rest: as floats.

        An id has as many places in a list as it has counts. The last count that begins at or before v is found without
        a search. Floats are exact here: all numbers are below 2**48, no quotient is nearer to a whole number than 2**-24.
        """
        if self._owner is None:
            self._owner = np.repeat(self._ids, self.freq)
        end = np.ceil((v * float(M) + float(M)) / rest)
        return self._owner.take(((end * self.total - 1) * (1 / M)).astype(np.int64)).astype(np.int64)

    def learn(self, before1, ids, place, a, b, p2, p1, context) -> None:
        """Takes in ids in order of time; of several ids with one context the last counts."""
        hit2, hit1 = ids == p2, ids == p1
        self.stats += np.bincount(context * 3 + np.where(hit2, 0, 2 - hit1), minlength=384).reshape(128, 3)
        self.waiting.append(ids[(~(hit2 | hit1)).nonzero()[0]])
        self.held += len(self.waiting[-1])
        self.turns += 1
        fresh = (ids << 3 | 1).astype(np.int32)
        for table, at, old, hit in ((self.t2, place, a, hit2), (self.t1, before1, b, hit1)):
            kept = np.where((old & 7) >= 2, old - 2, fresh)
            sure = hit.nonzero()[0]
            was = old[sure]
            kept[sure] = np.minimum(was + 1, was | 7)
            table[at] = kept
        least, most = self.REFRESH
        if self.held >= min(most, max(least, self.missed >> 3)):
            self._count()
        if self.turns <= 4 * self.WEIGH or self.turns % self.WEIGH == 0:
            self._weigh()


def _lanes(n: int) -> int:
    return int(min(LANES, max(1, n // 256)))


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """One block with its header; ids: at most BLOCK values below vocabulary.

    A lane's coder holds the low end of its interval modulo 2**64 and the interval's width. Below 2**32 a word leaves; a
    carry is added to the word that left last, and travels further once all words are there.
    """
    n = len(ids)
    lanes = _lanes(n)
    steps = -(-n // lanes)
    own = np.zeros(lanes * steps, np.int32)
    own[:n] = ids
    x = np.full((steps + 2, lanes), vocabulary, np.int64)  # a row for each step, after two without ids
    x[2:] = own.reshape(lanes, steps).T
    model = Model(vocabulary)
    low, width = np.zeros(lanes, U64), np.full(lanes, FULL, U64)
    out = np.zeros((steps + 1) * lanes, U64)  # a row for each lane's next word
    pos = np.arange(lanes)
    for t in range(0, steps, CHUNK):
        to = min(t + CHUNK, steps)
        before2, before1, own = (x[t + k : to + k].ravel() for k in range(3))
        place, a, b, p2, p1, context = model.look(before2, before1)
        start, size = model.intervals(own, p2, p1, context)
        for begin, part in zip(start.view(U64).reshape(-1, lanes), size.view(U64).reshape(-1, lanes), strict=True):
            width >>= SHIFT
            begin *= width
            low += begin
            width *= part
            over = (low < begin).nonzero()[0]
            if len(over):
                out[pos[over] - lanes] += U64(1)
            at = (width < BOTTOM).nonzero()[0]
            if len(at):
                now, end = low[at], pos[at]
                out[end] = now >> WORD
                pos[at] = end + lanes
                low[at] = now << WORD
                width[at] <<= WORD
        model.learn(before1, own, place, a, b, p2, p1, context)
    end = low + (BOTTOM - U64(1))
    over = (end < low).nonzero()[0]
    out[pos[over] - lanes] += U64(1)
    out[pos] = end >> WORD
    lengths = pos // lanes + 1
    words = out.reshape(-1, lanes)[: lengths.max()].T
    carry = words >> WORD
    while carry.any():
        words &= BOTTOM - U64(1)
        words[:, :-1] += carry[:, 1:]
        carry = words >> WORD
    payload = lengths.astype("<u2").tobytes() + words[np.arange(words.shape[1])[None, :] < lengths[:, None]].astype("<u4").tobytes()
    return HEAD.pack(n, lanes, len(payload), zlib.crc32(np.asarray(ids, "<u4").tobytes()), zlib.crc32(payload)) + payload


def decode_block(data: memoryview, vocabulary: int) -> tuple[np.ndarray, int]:
    """(ids, bytes taken) of the block at the start of data; raises ValueError where a checksum is wrong."""
    n, lanes, size, crc_ids, crc_payload = HEAD.unpack_from(data)
    payload = data[HEAD.size : HEAD.size + size]
    if len(payload) != size or zlib.crc32(payload) != crc_payload:
        raise ValueError("a block is damaged")
    lengths = np.frombuffer(payload, "<u2", lanes).astype(np.int64)
    steps = -(-n // lanes)
    flow = np.zeros((lanes, int(lengths.max()) + 2), np.uint32)
    flow[np.arange(flow.shape[1])[None, :] < lengths[:, None]] = np.frombuffer(payload, "<u4", offset=2 * lanes)
    flow = flow.T.ravel()  # a row for each lane's next word
    code = flow[:lanes].astype(U64) << WORD | flow[lanes : 2 * lanes]  # less the low end of the interval
    pos = np.arange(lanes) + 2 * lanes
    width = np.full(lanes, FULL, U64)
    x = np.zeros((steps, lanes), "<u4")
    model = Model(vocabulary)
    b1 = np.full(lanes, vocabulary, np.int64)
    b2 = b1
    for t in range(0, steps, CHUNK):
        kept = []
        for k in range(t, min(t + CHUNK, steps)):
            place, a, b, p2, p1, context = model.look(b2, b1)
            base, rest = model.base.take(context), model.rest.take(context)
            width >>= SHIFT
            v = np.minimum(code // width, U64(M - 1)).view(np.int64)
            near = (v < base).nonzero()[0]
            hit = v[near]
            v -= base
            v[near] = 0
            ids = model.find(v, model.rest_float.take(context))
            start = rest * model.cum.take(ids) >> M_BITS
            part = (rest * model.cum.take(ids + 1) >> M_BITS) - start
            start += base
            if len(near):
                own = context[near]
                w2, w1 = model.w2[own], model.w1[own]
                second = hit < w2
                ids[near] = np.where(second, p2[near], p1[near])
                start[near] = np.where(second, 0, w2)
                part[near] = np.where(second, w2, w1)
            code -= start.view(U64) * width
            width *= part.view(U64)
            low = width < BOTTOM  # a word comes in there
            bits = low * WORD
            code <<= bits
            code |= flow.take(pos) * low
            width <<= bits
            pos += low * lanes
            x[k] = ids
            kept.append((b1, ids, place, a, b, p2, p1, context))
            b2, b1 = b1, ids
        model.learn(*map(np.concatenate, zip(*kept, strict=True)))
    out = np.ascontiguousarray(x.T).ravel()[:n]
    if zlib.crc32(out.tobytes()) != crc_ids:
        raise ValueError("a block's ids are not those that were written")
    return out, HEAD.size + size


def encode_file(ids: np.ndarray, vocabulary: int, block: int = BLOCK) -> bytes:
    """A whole file: header, blocks of like size, and an index of the blocks' places for random access."""
    parts, index, at = [MAGIC + struct.pack("<I", vocabulary)], [], 12
    block = max(1, -(-len(ids) // max(1, -(-len(ids) // block))))
    for i in range(0, len(ids), block):
        parts.append(encode_block(ids[i : i + block], vocabulary))
        index.append((i, at))
        at += len(parts[-1])
    tail = np.array(index, "<u8").tobytes()
    return b"".join([*parts, tail, struct.pack("<QI", at, len(index)), MAGIC])


def decode_file(data: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """The ids of a file, or ``count`` of them from ``first``: only the blocks that hold them are decoded."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a token file")
    vocabulary = struct.unpack_from("<I", data, 8)[0]
    at, blocks = struct.unpack_from("<QI", data, len(data) - 20)
    index = np.frombuffer(data, "<u8", 2 * blocks, at).reshape(-1, 2).astype(np.int64)
    last = None if count is None else first + count
    view, out = memoryview(data), []
    for k, (begin, place) in enumerate(index):
        after = index[k + 1][0] if k + 1 < blocks else None
        if (after is not None and after <= first) or (last is not None and begin >= last):
            continue
        ids = decode_block(view[place:], vocabulary)[0]
        out.append(ids[max(0, first - begin) : None if last is None else max(0, last - begin)])
    return np.concatenate(out) if out else np.zeros(0, "<u4")


FILES = "shard int, file string, n_docs bigint, n_tokens bigint, n_bytes bigint, sha256 string"


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 1, shard_bytes: int = 12 << 20, dtype: str = "<u2") -> DataFrame:
    """Tokenises docs (doc_id, text), in ascending doc_id order, into token files below ``out``; returns their manifest.

    One shuffle of the texts, by ranges of doc_id. A shard is one token file and one index of its documents (doc_id,
    number of ids); both are written under temporary names and renamed.
    """
    rows = docs.select("doc_id", "text")
    bounds = range_bounds(rows.withColumn("n", F.octet_length("text")), "doc_id", F.coalesce("n", F.lit(0)) + 8, shard_bytes)
    dealt = deal(shard_column(rows, "doc_id", bounds), len(bounds) + 1).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    end = np.asarray([end_id], dtype).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import _tokenizer

        workspace("tokens")
        coder = slice_coder(path, dtype)
        vocabulary = _tokenizer(path).get_vocab_size()
        width = np.dtype(dtype).itemsize
        done, now, ids, known = [], None, [], []

        def close() -> None:
            if now is None:
                return
            fs, base = open_store(out)
            fs.create_dir(f"{base}/_temporary", recursive=True)
            flat = np.frombuffer(b"".join(ids), dtype)
            index = b"".join(struct.pack("<?qI", d is None, d or 0, n) for d, n in known)
            name = f"tokens-{now:06d}"
            files = {f"{name}.cmrc": encode_file(flat, vocabulary), f"{name}.idx": index + struct.pack("<I", zlib.crc32(index))}
            for file, data in files.items():
                temp = f"{base}/_temporary/{uuid.uuid4().hex}"
                with fs.open_output_stream(temp, compression=None) as f:
                    f.write(data)
                fs.move(temp, f"{base}/{file}")
            data = files[f"{name}.cmrc"]
            done.append((now, name, len(known), len(flat), len(data), hashlib.sha256(data).hexdigest()))

        for batch in slices(batches, size=SLICE):
            shards = batch.column("shard").to_pylist()
            coded = coder.encode(batch.column("text"))
            for shard, doc_id, own in zip(shards, batch.column("doc_id").to_pylist(), coded, strict=True):
                if shard != now:
                    close()
                    now, ids, known = shard, [], []
                ids.append(own + end)
                known.append((doc_id, len(own) // width + 1))
        close()
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], names=["shard", "file", "n_docs", "n_tokens", "n_bytes", "sha256"])

    dealt.mapInArrow(run, FILES).write.parquet(f"{out}/_manifest")
    return docs.sparkSession.read.schema(FILES).parquet(f"{out}/_manifest")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files below ``out``."""
    manifest = spark.read.schema(FILES).parquet(f"{out}/_manifest")
    starts, at = {}, 0
    for r in sorted(manifest.select("shard", "n_tokens").collect()):  # one row for each file: range_bounds() bounds their number
        starts[r["shard"]] = at
        at += r["n_tokens"]
    begin = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(out)

        def read(name: str) -> bytes:
            with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                return f.read()

        for batch in batches:
            for shard, name, sha in zip(*(batch.column(c).to_pylist() for c in ("shard", "file", "sha256")), strict=True):
                data, index = read(f"{name}.cmrc"), read(f"{name}.idx")
                if hashlib.sha256(data).hexdigest() != sha or struct.pack("<I", zlib.crc32(index[:-4])) != index[-4:]:
                    raise ValueError(f"{name} is not what was written")
                ids = memoryview(decode_file(data).tobytes())
                rows, start, place = [], begin.value[shard], 0
                for null, doc_id, n in struct.iter_unpack("<?qI", index[:-4]):
                    rows.append((None if null else doc_id, start + place, n, zlib.crc32(ids[4 * place : 4 * (place + n)])))
                    place += n
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(spark.sparkContext.defaultParallelism, min(len(starts), 20_000))
    return manifest.select("shard", "file", "sha256").repartition(tasks).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def coded_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes docs as token files in the shared folder and reads them back."""
    out = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, out, path or tokenizer_path())
    return read_tokens(docs.sparkSession, out)
