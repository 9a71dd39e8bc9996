"""What the training-data operators share: the shared folder, tokenising with a word cache, byte hashing.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import ctypes
import gc
import json
import re
import struct
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Unsigned 64-bit arithmetic wraps on purpose in the hashes below.
U64 = np.uint64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ASCII_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a folder of this machine
    if driver and executors are one process; on a cluster that is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("codesieve.shared.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="codesieve-shared-")
        spark.conf.set("codesieve.shared.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below shared_root()."""
    return f"{shared_root(spark)}/codesieve/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back, so that a lost executor costs nothing.

    While it writes, Spark drops the shuffle files of finished queries in this session.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # what is written needs its shuffle files no longer
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._codesieve_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialise() wrote, once all that was made of it is itself written."""
    for t in tables:
        fs, p = hadoop_path(t.sparkSession, t._codesieve_path)
        fs.delete(p, True)


class Scratch:
    """The tables of one run: put() is materialise(), drop() discards all but those named."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(materialise(df, name))
        return self.tables[-1]

    def drop(self, *keep: DataFrame) -> None:
        discard(*(t for t in self.tables if not any(t is k for k in keep)))
        self.tables = list(keep)


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of the JVM for a path in any store that Spark knows."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole rows with about ``size`` bytes of a text column, so that Python objects are made of a
    slice at a time; at the end what the task's allocators hold unused goes back to the system, as workers live on."""
    for batch in batches:
        if len(batch):
            ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            at = 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
                yield batch.slice(at, to - at)
                at = to
    release()


_owner = ""


def workspace(owner: str) -> None:
    """Called where an operator's work begins in a Python worker: workers live on from stage to stage, so what another
    operator has cached there (words, a tokenizer) is dropped."""
    global _owner
    if owner != _owner:
        _owner = owner
        for cache in (word_cache, slice_coder, _merges, _model, _tokenizer):
            cache.cache_clear()
        gc.collect()
        release()


def release() -> None:
    """Gives free memory of Arrow's pool and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def open_store(uri: str):
    """(pyarrow file system, path within it), for executors that write files of a format that Spark's writers lack."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path or uri
    return fs.FileSystem.from_uri(uri)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _model(path: str):
    model = _tokenizer(path).model
    model._resize_cache(0)  # words are asked for once
    return model


#: The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on.
BYTE_LETTERS, _next = [], 256
for _b in range(256):
    if 33 <= _b <= 126 or 161 <= _b <= 172 or _b >= 174:
        BYTE_LETTERS.append(chr(_b))
    else:
        BYTE_LETTERS.append(chr(_next))
        _next += 1


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCache:
    """Whole texts to ids by a tokenizer of which words between white space never interact.

    That holds where white space is dropped before the merges, as in the word-end vocabularies: the ids of a text are
    those of its white-space-delimited chunks, one after the other, so each distinct chunk is encoded once and then
    looked up. Memory is bounded: beyond half of ``limit`` chunks a new generation begins; chunks of the one before move
    over when they are met again, those of the one before that are forgotten. Ids are kept as little-endian bytes of
    ``dtype``.
    """

    #: Letters, then one run of ASCII marks: the tokenizer parts such a chunk between the two.
    WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-^`{-~]+)")

    def __init__(self, path: str, limit: int = 600_000, dtype: str = "<u2"):
        self.path, self.limit, self.dtype = path, limit, dtype
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pack = struct.Struct(("<H", "<I")[np.dtype(dtype).itemsize == 4]).pack
        self.of_id: dict[int, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        try:
            return b"".join([self.of_id[i] for i in ids])
        except KeyError:
            self.of_id.update((i, self.pack(i)) for i in ids)
            return b"".join([self.of_id[i] for i in ids])

    def _add(self, chunks: list[str]) -> None:
        """Encodes chunks (none with white space), many in one text: the offsets of the ids tell them apart."""
        known, tokenizer = self.known, _tokenizer(self.path)
        for i in range(0, len(chunks), 64):
            part = chunks[i : i + 64]
            e = tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([len(c) + 1 for c in part])
            ids = np.asarray(e.ids, dtype=self.dtype)
            cuts = np.searchsorted(np.array([x[0] for x in e.offsets], np.int64), starts)
            at = 0
            for c, to in zip(part, cuts.tolist(), strict=True):
                known[c] = ids[at:to].tobytes()
                at = to

    def _word(self, word: str) -> bytes:
        """A lower-case Latin-1 word, which is in the form that the vocabulary's normaliser and pre-tokenizer give it but
        for the letters that stand for its bytes: it goes to the library's model itself."""
        own = self.known.get(word) or self.old.get(word)
        if own is None:
            spelt = word if word.isascii() else "".join([BYTE_LETTERS[b] for b in word.encode()])
            own = self._bytes([t.id for t in _model(self.path).tokenize(spelt)])
        self.known[word] = own
        return own

    def _learn(self, new: set[str]) -> None:
        """Adds chunks: a word with marks after it by its two parts, a Latin-1 word by its lower case, all else by the library as a whole."""
        known, old, match, latin = self.known, self.old, self.WORD_AND_MARKS.fullmatch, lambda c: c.isascii() or max(c) < "\u0100"
        later: list[str] = []
        plain: set[str] = set()
        for c in new:
            own = old.get(c)
            if own is not None:
                known[c] = own
            elif c.isalpha():
                if latin(c):
                    known[c] = self._word(c.lower())
                else:
                    plain.add(c)
            else:
                m = match(c)
                if m is None:
                    plain.add(c)
                    continue
                word, marks = m.groups()
                if word.isalpha() and latin(word):
                    head, tail = self._word(word.lower()), known.get(marks)
                    if tail is not None:
                        known[c] = head + tail
                        continue
                    word = word.lower()
                plain.update([x for x in (word, marks) if x not in known])
                later.append(c)
        self._add(list(plain))
        for c in later:
            word, marks = match(c).groups()
            lower = word.lower()
            known[c] = (known[word] if word in known else known[lower]) + known[marks]

    def _lookup(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        if len(self.known) > self.limit // 2:
            self.known, self.old = {}, self.known
        known = self.known
        found = list(map(known.get, chunks))
        missing = [i for i, own in enumerate(found) if own is None]
        if missing:
            self._learn({chunks[i] for i in missing})
            for i in missing:
                found[i] = known[chunks[i]]
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's ids end) of texts (null: none), without special tokens.

        Arrow parts the texts at ASCII white space and numbers their chunks, so Python sees a distinct chunk once a call.
        """
        lists = pc.ascii_split_whitespace(texts)
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, lengths = self._spelt(coded.dictionary)
        starts = np.cumsum(lengths) - lengths
        chunk = coded.indices.to_numpy(zero_copy_only=False)
        n = lengths[chunk]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        place = np.repeat(starts[chunk] - ends[:-1], n)
        place += np.arange(len(place))
        return words[place], ends[np.cumsum(sizes)]

    def _spelt(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of distinct chunks, one chunk after the other; how many each has)."""
        parts = self._lookup(chunks.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(self.dtype).itemsize
        return np.frombuffer(b"".join(parts), self.dtype), lengths

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text (null: none), without special tokens, as bytes."""
        flat, ends = self.ids(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        view, width = flat.tobytes(), np.dtype(self.dtype).itemsize
        stops = (ends * width).tolist()
        return [view[a:b] for a, b in zip([0, *stops], stops)]


@lru_cache(maxsize=2)
def word_cache(path: str, dtype: str = "<u2", limit: int = 600_000) -> WordCache:
    """One cache for each Python worker, vocabulary, width and limit."""
    return WordCache(path, limit, dtype)


class Merges:
    """The merges of a byte-level vocabulary with word ends, of many words side by side in numpy.

    Each step merges one pair in every word that has one: the pair of the least rank, and of equal ones the first, as the
    library does. A pair's rank lies at ``place[left] + right`` in a table of (left, rank), where no two pairs meet.
    """

    NONE, FREE, NEVER, BITS = 0xFFFF, 0xFFFE, 1 << 30, 6  # no symbol, no left symbol
    LONGEST, COLUMNS = (1 << BITS) - 2, 1 << 14  # longer words are left to the library; columns at once, for the CPU's caches

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.inner = np.array([vocab[c] for c in BYTE_LETTERS], np.uint16)
        self.last = np.array([vocab[c + suffix] for c in BYTE_LETTERS], np.uint16)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.uint16)
        by_left: dict[int, list[tuple[int, int]]] = {}
        for rank, (x, y) in enumerate(pairs):
            by_left.setdefault(vocab[x], []).append((vocab[y], rank))
        size, rng = 4 * len(pairs) + 1024, np.random.default_rng(0)
        owner = np.full(size + self.NONE + 1, self.FREE, np.uint32)
        ranks = np.zeros(len(owner), np.uint32)
        self.place = np.zeros(self.NONE + 1, np.int32)
        for left, own in sorted(by_left.items(), key=lambda x: -len(x[1])):
            rights, at = np.array([y for y, _ in own]), 0
            while (owner[at + rights] != self.FREE).any():
                at = int(rng.integers(size))
            self.place[left] = at
            owner[at + rights] = left
            ranks[at + rights] = [r for _, r in own]
        self.table = owner << 16 | ranks

    @classmethod
    def of(cls, path: str) -> Merges | None:
        """None where the vocabulary is of another kind."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        off = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        if model.get("type") != "BPE" or any(model.get(k) for k in off) or not model.get("end_of_word_suffix"):
            return None
        known = model["vocab"].keys() >= {c + end for c in BYTE_LETTERS for end in ("", model["end_of_word_suffix"])}
        return cls(model) if known and max(model["vocab"].values()) < cls.FREE and len(model["merges"]) <= cls.NONE else None

    def _ranks(self, left: np.ndarray, right: np.ndarray, at) -> np.ndarray:
        """Rank and place of the pairs in one number; NEVER or nearly that for what is no pair."""
        found = self.table.take(self.place.take(left) + right)
        return np.where(found >> 16 == left, (found & 0xFFFF) << self.BITS, self.NEVER).astype(np.int32) + at

    def _block(self, s: np.ndarray) -> np.ndarray:
        """Merges the words in the columns of s, whose first and last row are NONE."""
        out, own = np.full((len(s) - 2, s.shape[1]), self.NONE, np.uint16), np.arange(s.shape[1])
        r = np.stack([self._ranks(s[j], s[j + 1], np.int32(j)) for j in range(len(s) - 1)])
        while True:
            best = r.min(axis=0)
            on = best < self.NEVER >> 1
            if not on.all():
                done = (~on).nonzero()[0]
                out[: len(s) - 2, own[done]] = s[1:-1, done]
                left = on.nonzero()[0]
                if not len(left):
                    return out
                s, r, best, own = s.take(left, axis=1), r.take(left, axis=1), best[left], own[left]
            n = len(own)
            at = best & ((1 << self.BITS) - 1)
            made = self.made.take(best >> self.BITS)
            for j in range(2, len(s) - 1):  # what comes after the pair moves up; the words are shorter by one row now
                later = at < j
                s[j] = np.where(later, s[j + 1], s[j])
                if j < len(r) - 1:
                    r[j] = np.where(later, r[j + 1] - 1, r[j])
            s, r = s[:-1], r[:-1]
            flat, ranks, place = s.reshape(-1), r.reshape(-1), at * n + np.arange(n)
            flat[place] = made
            s[-1] = self.NONE
            ranks[place] = self._ranks(made, flat.take(place + n), at)
            ranks[place - n] = self._ranks(flat.take(place - n), made, at - 1)

    def words(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many it has) of words of 1 to LONGEST bytes in data."""
        flat, begin, counts, have = [], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), 0
        rows = (sizes + 3) >> 2
        for g in np.unique(rows).tolist():
            group = (rows == g).nonzero()[0]
            for k in range(0, len(group), self.COLUMNS):
                own = group[k : k + self.COLUMNS]
                s = np.full((4 * g + 2, len(own)), self.NONE, np.uint16)
                start, size = starts[own], sizes[own]
                for j in range(4 * g):
                    byte = data.take(start + j, mode="clip")
                    s[j + 1] = np.where(j < size - 1, self.inner.take(byte), np.where(j == size - 1, self.last.take(byte), self.NONE))
                out = np.ascontiguousarray(self._block(s).T)
                full = out != self.NONE
                counts[own] = n = full.sum(axis=1)
                begin[own] = have + np.cumsum(n) - n
                flat.append(out[full])
                have += len(flat[-1])
        return np.concatenate(flat) if flat else np.zeros(0, np.uint16), begin, counts


@lru_cache(maxsize=4)
def _merges(path: str) -> Merges | None:
    return Merges.of(path)


class SliceCoder(WordCache):
    """A WordCache that merges the plain chunks of a slice (letters of Latin-1, then at most a run of marks; the normaliser
    only makes them lower case) side by side, without a Python object for each, and remembers the other chunks only.

    It pays where slices are large, as each merges its distinct words anew.
    """

    def __init__(self, path: str, limit: int = 600_000, dtype: str = "<u2"):
        super().__init__(path, limit, dtype)
        self.kind, self.lower = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
        for b in range(128):
            c = chr(b)
            self.kind[b] = 1 if c.isalpha() else 2 if self.WORD_AND_MARKS.fullmatch("a" + c) else 0
            self.lower[b] = ord(c.lower())

    def _kinds(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(1 for a letter, 2 for a mark, 0 for all else; the lower case) of each byte of UTF-8."""
        kind, lower = self.kind.take(data), self.lower.take(data)
        at = (data[:-1] == 0xC3).nonzero()[0] + 1  # U+00C0 to U+00FF: letters but for two, capitals up to U+00DE
        second = data[at]
        letter = (second >= 0x80) & (second != 0x97) & (second != 0xB7)
        at, second = at[letter], second[letter]
        kind[at - 1] = kind[at] = 1
        lower[at] = np.where(second < 0x9F, second + 0x20, second)
        return kind, lower

    def _spelt(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        merges = _merges(self.path)
        if merges is None or not len(chunks):
            return super()._spelt(chunks)
        stops, data = _bytes_of(chunks)
        kind, lower = self._kinds(data)
        size = np.diff(stops)
        marks = _sums(kind == 2, stops)
        letters = _sums(kind == 1, stops)
        # A letter after a mark; the first byte of a chunk counts for none.
        back = np.zeros(len(data), bool)
        back[1:] = (kind[1:] == 1) & (kind[:-1] == 2)
        back[stops[:-1][size > 0]] = False
        plain = (letters > 0) & (letters + marks == size) & (_sums(back, stops) == 0) & (np.maximum(letters, marks) <= merges.LONGEST)
        at = plain.nonzero()[0]
        marked = (marks[at] > 0).nonzero()[0]
        begin = stops[at]
        words, n_marks = letters[at], marks[at[marked]]
        starts, sizes = np.concatenate((begin, begin[marked] + words[marked])), np.concatenate((words, n_marks))
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        parts = pa.Array.from_buffers(
            pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(lower.take(_runs(starts, sizes)))]
        ).dictionary_encode()
        cuts, spelling = _bytes_of(parts.dictionary)
        ids, first, n = merges.words(spelling, cuts[:-1], np.diff(cuts))
        part = parts.indices.to_numpy(zero_copy_only=False)
        # The others come after the plain chunks' ids.
        other = (~plain).nonzero()[0]
        more, own = super()._spelt(chunks.take(pa.array(other)))
        lengths = np.zeros(len(chunks), np.int64)
        lengths[at] = n[part[: len(at)]]
        lengths[at[marked]] += n[part[len(at) :]]
        lengths[other] = own
        # Each chunk has two runs of ids: its word, its marks.
        runs_start, runs_size = np.zeros((len(chunks), 2), np.int64), np.zeros((len(chunks), 2), np.int64)
        runs_start[at, 0], runs_size[at, 0] = first[part[: len(at)]], n[part[: len(at)]]
        runs_start[at[marked], 1], runs_size[at[marked], 1] = first[part[len(at) :]], n[part[len(at) :]]
        runs_start[other, 0], runs_size[other, 0] = len(ids) + np.cumsum(own) - own, own
        both = np.concatenate((ids.astype(self.dtype), more))
        return both[_runs(runs_start.ravel(), runs_size.ravel())], lengths


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where the texts begin and end, their bytes) of an array of texts or bytes without nulls."""
    stops = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[stops[0] : stops[-1]]
    return stops - stops[0], data


def _sums(hit: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """How many hits each run between stops has."""
    total = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(hit, out=total[1:])
    return np.diff(total[stops])


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    place = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    place += np.arange(len(place))
    return place


@lru_cache(maxsize=2)
def slice_coder(path: str, dtype: str = "<u2") -> SliceCoder:
    """One coder for each Python worker, vocabulary and width."""
    return SliceCoder(path, dtype=dtype)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads 64-bit values evenly."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def window_hash(a: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hash, mod 2**64, of each run of ``width`` values of a (by doubling: log(width) passes)."""
    n = len(a) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    power = lambda k: U64(pow(base, k, 1 << 64))
    part, have = a.astype(U64), 1
    out, got = None, 0
    w = width
    while True:
        if w & 1:
            if out is None:
                out, got = part, have
            else:
                m = min(len(out), len(part) - got)
                out, got = out[:m] * power(have) + part[got : got + m], got + have
        w >>= 1
        if not w:
            return out[:n]
        part, have = part[:-have] * power(have) + part[have:], 2 * have


def sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over each run of ``width`` values."""
    n = len(a) - width + 1
    if n <= 0:
        return a[:0]
    have = 1
    while 2 * have <= width:
        a, have = op(a[:-have], a[have:]), 2 * have
    return op(a[:n], a[width - have : width - have + n]) if have < width else a[:n]


def _bloom_places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix64(ids.astype(np.int64).view(U64))
    return [((h >> U64(s)) ^ (h << U64(64 - s))) % U64(bits) for s in (1, 17, 33, 49)]


def only_wanted(rows: DataFrame, key: str, wanted: DataFrame, then, schema: str, most_bytes: int = 16 << 20) -> DataFrame:
    """What ``then`` (batches to batches of ``schema``) makes of the rows whose ``key`` (bigint) is in ``wanted`` (a table of
    distinct keys) and of few others, in the same Python worker.

    Where a Bloom filter of the keys (10 bits each) fits into most_bytes, it is broadcast: no shuffle, and about one other
    row in a hundred stays. With more keys than that, a semi-join leaves exactly the rows that are wanted.
    """
    n = wanted.count()
    if 10 * n > 8 * most_bytes:
        return rows.join(wanted, key, "left_semi").mapInArrow(then, schema)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    bits = 8 * (-(-10 * n // 8))

    def build(batches):
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _bloom_places(batch.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(table, (at >> U64(3)).astype(np.int64), np.uint8(128) >> (at & U64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["bits"])

    parts = wanted.select(key).coalesce(1).mapInArrow(build, "bits binary").collect()  # most_bytes at most
    held = rows.sparkSession.sparkContext.broadcast(parts[0]["bits"])

    def thin(batches):
        table = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(key))
            keep = ids.is_valid().to_numpy(zero_copy_only=False)
            for at in _bloom_places(ids.fill_null(0).to_numpy(zero_copy_only=False), bits):
                keep &= (table[(at >> U64(3)).astype(np.int64)] >> (U64(7) - (at & U64(7))).astype(np.uint8) & 1).astype(bool)
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(lambda batches: then(thin(batches)), schema)
