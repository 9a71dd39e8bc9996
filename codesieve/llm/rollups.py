"""Delta-maintained token counts by source, language and tokenizer version.

A TokenRollup is a folder of committed batches in a shared store. A batch is a set of signed deltas: an insert adds a
document and its tokens, a delete takes them away, a revision adds the difference between the new and the old count. A
batch is summed by (source, lang, tokenizer) and written as an attempt below its id; Spark's mark of success commits it. Of
several attempts of an id (a resend, or two drivers at once) the one of the smallest name counts, so a batch counts once
however often it is sent, and nothing is renamed. Totals are the sum of the committed batches: additive, never recomputed
from documents; compact() folds the batches that it has seen into one.

Nulls and odd rows: a null source or lang is a group of its own; a null text has no tokens but is a document; rows that
repeat count each; empty batches commit and add nothing; groups whose documents and tokens are both 0 are not reported;
further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hadoop_path, materialise, slices, shared_path, tokenizer_path, word_cache, workspace

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def token_counts(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, tokenizer and n_tokens of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workspace("tokens")
        cache = word_cache(path)
        width = np.dtype(cache.dtype).itemsize
        for batch in slices(batches):
            n = [len(x) // width for x in cache.encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint")


def inserts(counts: DataFrame) -> DataFrame:
    """Deltas that add these documents."""
    return counts.select(*KEYS, F.lit(1).cast("bigint").alias("n_docs"), "n_tokens")


def deletes(counts: DataFrame) -> DataFrame:
    """Deltas that take these documents away."""
    return counts.select(*KEYS, F.lit(-1).cast("bigint").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(counts: DataFrame, old: str = "old_n_tokens", new: str = "n_tokens") -> DataFrame:
    """Deltas that change the counts of documents which stay."""
    return counts.select(*KEYS, F.lit(0).cast("bigint").alias("n_docs"), (F.col(new) - F.col(old)).alias("n_tokens"))


class TokenRollup:
    """Totals in a folder of a shared store."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "rollup")

    def _dir(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _names(self, path: str) -> list[str]:
        fs, p = hadoop_path(self.spark, path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _attempts(self) -> dict[str, str]:
        """The attempt that counts of each batch that is complete."""
        out = {}
        for batch in self._names(self._dir("batches")):
            for attempt in self._names(self._dir(f"batches/{batch}")):
                fs, mark = hadoop_path(self.spark, self._dir(f"batches/{batch}/{attempt}/_SUCCESS"))
                if fs.exists(mark):
                    out[batch] = f"batches/{batch}/{attempt}"
                    break
        return out

    def _folded(self, attempts: dict[str, str]) -> set[str]:
        """Ids that a compacted batch has taken in."""
        return {x for b, path in attempts.items() if b.startswith("compact-") for x in self._names(self._dir(f"{path}/_folded"))}

    def committed(self) -> list[str]:
        """Batches that count now."""
        attempts = self._attempts()
        return sorted(set(attempts) - self._folded(attempts))

    def _write(self, path: str, sums: DataFrame) -> None:
        sums.coalesce(1).write.mode("append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)  # a few rows, summed in the tasks first

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds a batch; False, and no change, if a batch of that id is there already."""
        if not batch_id.replace("-", "").replace("_", "").isalnum() or batch_id.startswith("compact-"):
            raise ValueError("a batch id has letters, digits, - and _ only, and does not begin with compact-")
        attempts = self._attempts()
        if batch_id in attempts or batch_id in self._folded(attempts):
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        self._write(self._dir(f"batches/{batch_id}/{uuid.uuid4().hex}"), sums)
        return True

    def compact(self) -> None:
        """Folds all batches into one; the ids inside it stay known, so a late resend still counts once."""
        attempts = self._attempts()
        folded = self._folded(attempts)
        batches = sorted(set(attempts) - folded)
        if len(batches) < 2:
            return
        path = self._dir(f"batches/compact-{uuid.uuid4().hex[:12]}/{uuid.uuid4().hex}")
        sums = self._sum(batches, attempts)
        for b in {*batches, *folded}:  # before the mark of success, which switches over at once
            fs, place = hadoop_path(self.spark, f"{path}/_folded/{b}")
            fs.mkdirs(place)
        self._write(path, sums)
        for b in batches:
            fs, place = hadoop_path(self.spark, self._dir(f"batches/{b}"))
            fs.delete(place, True)

    def _sum(self, batches: list[str], attempts: dict[str, str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(self._dir(attempts[b]) for b in batches))
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens after all committed batches."""
        attempts = self._attempts()
        return self._sum(sorted(set(attempts) - self._folded(attempts)), attempts).filter("n_docs <> 0 or n_tokens <> 0")


def rollup_documents(docs: DataFrame, withdrawn: DataFrame, revised: DataFrame, tokenizer: str = "word_bpe_49k", path: str | None = None) -> DataFrame:
    """Totals of two tokenizer versions (ids alone, and with an end id) after batches that come in over time.

    About half of docs (by a hash of the id) are inserted; the state is opened anew; the rest is inserted, ``withdrawn`` are
    deleted, ``revised`` (doc_ids) get an end id in the first version too, which changes their counts but not their number,
    and the first batch is sent again. Texts are read and tokenised once; the counts (a few bytes a document) feed every batch.
    """
    counts = materialise(token_counts(docs, path or tokenizer_path(f"{tokenizer}.json"), tokenizer), "token-counts")
    ended = counts.withColumns({"tokenizer": F.lit(f"{tokenizer}+end"), "n_tokens": F.col("n_tokens") + 1})
    both = counts.unionByName(ended)
    early = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(True))
    gone = withdrawn.select("doc_id").distinct()
    changed = revised.select("doc_id").distinct().join(gone, "doc_id", "left_anti")
    rollup = TokenRollup(docs.sparkSession)
    rollup.commit("first", inserts(both.filter(early)))
    rollup = TokenRollup(docs.sparkSession, rollup.path)  # as a later run does
    rollup.commit("second", inserts(both.filter(~early)))
    rollup.commit("withdraw", deletes(both.join(gone, "doc_id", "left_semi")))
    rollup.commit("revise", revisions(counts.join(changed, "doc_id", "left_semi").withColumns({"old_n_tokens": F.col("n_tokens"), "n_tokens": F.col("n_tokens") + 1})))
    rollup.commit("first", inserts(both.filter(early)))  # a resend: no effect
    return rollup.totals()
