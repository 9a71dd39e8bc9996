"""Language identification by bit-sliced Bloom filters of character n-grams.

The model is one table of 2**bits cells. A cell holds a bit for each language (bit-sliced: the Bloom filters of all
languages lie side by side), so ANDing the cells of an n-gram's two hashes gives at once the mask of all languages that
contain it. A text's popcount per language, corrected for the rate at which that language's filter answers falsely,
is its share of n-grams in that language; the largest share decides and its part of all shares is the score.

Training reads a bounded sample (max_train_docs a language, the smallest hashes of doc_id and text), everything else
every row. Nulls and odd rows: a null text, or one without a letter, is "und" with score 0; a null doc_id is kept (it is
held out only if its remainder says so: null is not, and such rows are not learned from); rows that repeat are
predicted each on their own; a corpus without labelled training rows predicts "und" everywhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, slices, window_hash

SIZE = 4  # bytes of an n-gram of lower-cased UTF-8, with blanks for whatever is no letter
NO_LETTERS = re.compile(r"[\W\d_]+")


@dataclass
class BloomModel:
    """languages in order, cells (slices of 64 languages by column), false positive rate by language."""

    languages: list[str]
    cells: np.ndarray
    false_rate: np.ndarray
    prior: int


def _grams(text: str) -> np.ndarray:
    """Hashes of the n-grams of a text."""
    plain = f" {NO_LETTERS.sub(' ', text.lower())}  ".encode("utf-8", "replace")
    return mix64(window_hash(np.frombuffer(plain, np.uint8), SIZE))


def train(samples: list[tuple[str, str]], bits: int = 20, at_least: int = 3) -> BloomModel:
    """A model from (language, text) rows: n-grams that occur at_least times in a language enter its filter."""
    languages = sorted({x for x, _ in samples})
    cells = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), U64)
    false = np.zeros(len(languages))
    sizes = Counter(x for x, _ in samples)
    for i, lang in enumerate(languages):
        own = [_grams(t) for x, t in samples if x == lang]
        grams, n = np.unique(np.concatenate(own) if own else np.zeros(0, U64), return_counts=True)
        if (n >= at_least).any():
            grams = grams[n >= at_least]
        for at in _cells(grams, bits):
            np.bitwise_or.at(cells[:, i // 64], at, U64(1 << (i % 64)))
        fill = float(((cells[:, i // 64] >> U64(i % 64)) & U64(1)).mean())
        false[i] = fill**2
    return BloomModel(languages, cells, false, max(range(len(languages)), key=lambda i: sizes[languages[i]], default=0))


def _cells(grams: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each n-gram."""
    return (grams >> U64(64 - bits)).astype(np.int64), (grams & U64((1 << bits) - 1)).astype(np.int64)


def predict(model: BloomModel, text: str | None) -> tuple[str, float]:
    """(language, score) of one text."""
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return "und", 0.0
    a, b = _cells(_grams(text), model.cells.shape[0].bit_length() - 1)
    counts = np.zeros(len(model.languages))
    for s in range(model.cells.shape[1]):
        masks = model.cells[a, s] & model.cells[b, s]
        part = min(64, len(model.languages) - 64 * s)
        if part <= 8:  # one table look-up for all languages
            seen = np.bincount(masks.astype(np.uint8), minlength=256)
            counts[64 * s : 64 * s + part] = [seen[(np.arange(256) >> j) & 1 == 1].sum() for j in range(part)]
        else:
            counts[64 * s : 64 * s + part] = [int(((masks >> U64(j)) & U64(1)).sum()) for j in range(part)]
    share = np.maximum(0, (counts / max(1, len(a)) - model.false_rate) / np.maximum(1 - model.false_rate, 1e-9))
    if not share.any():
        return model.languages[model.prior], 0.0
    best = int(np.argmax(share))
    return model.languages[best], float(min(1.0, share[best] / share.sum()))


def held_out():
    """crc32 of doc_id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, max_train_docs: int = 400) -> list[tuple[str, str]]:
    """Up to max_train_docs rows of each language that are not held out, the same ones on every run.

    Which ones: the smallest hashes of doc_id, by a top-k for each language, so no language is gathered in one task.
    """
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    hashed = rows.withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    out: list[tuple[str, str]] = []
    wanted = None
    for lang, n in sorted(sizes.items()):  # the hash bound leaves about max_train_docs rows (and 5 deviations more)
        share = min(1.0, (max_train_docs + 5 * max_train_docs**0.5) / n)
        bound = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
        own = (F.col("lang") == lang) & (F.col("h") <= bound)
        wanted = own if wanted is None else wanted | own
    if wanted is None:
        return out
    taken = Counter()
    for r in sorted(hashed.filter(wanted).select("lang", "text", "h", "doc_id").collect(), key=lambda r: (r["lang"], r["h"], r["doc_id"])):
        if taken[r["lang"]] < max_train_docs:
            taken[r["lang"]] += 1
            out.append((r["lang"], r["text"]))
    return out


def identify(docs: DataFrame, max_train_docs: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(train(training_sample(docs.select("doc_id", "text", "lang"), max_train_docs)))  # at most 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [predict(model.value, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
