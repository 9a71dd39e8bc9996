"""Quality rules by weak supervision: rules vote or abstain, EM estimates how reliable each is, the posterior decides.

Per document the counts of contract are taken over the whole text. Each rule of RULES looks at the counts and votes
+1 (good), -1 (bad) or abstains (0). A naive Bayes model with two hidden classes, in which each rule has its own
distribution over the three outcomes in either class, is fitted by expectation-maximisation to the numbers of documents
by vote pattern: at most 3**len(RULES) rows, whatever the size of the corpus, from a partial aggregation of all
documents. The posterior probability of the good class then decides.

Nulls and odd rows: a null or empty text has no words, so base_failed is true and kept false. A null doc_id is kept as
it is. Rows that repeat are judged each on their own. An empty table gives no rows. Further columns are passed through
by quality_filter() and ignored by quality_report().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, materialise, slices, window_hash, workspace

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_distinct", "n_upper", "n_ends", "n_marks", "n_symbol_ends")
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SCHEMA = ", ".join(f"{c} bigint" for c in COUNTS + EXTRA)


def count_text(text: str | None) -> tuple[int, ...]:
    """COUNTS + EXTRA of one text.

    Words are runs of anything but ASCII white space; bytes.split() has the same white space. Repeated 8-word windows
    are found by 64-bit hashes.
    """
    if not text:
        return (0,) * len(COUNTS + EXTRA)
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS + EXTRA)
    chars = len(text) - sum(map(b.count, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")))
    symbols = sum(map(b.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    lines = [x for x in b.split(b"\n") if x.strip()]
    repeated = 0
    if n > 8:
        h = window_hash(np.fromiter(map(hash, words), np.int64, n).astype(U64), 8)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        if same.any():
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int32)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 8, -1)
            repeated = int((np.cumsum(edge[:n]) > 0).sum())
    upper = sum(map(bytes.isupper, words))
    ends = sum(x.endswith((b".", b"!", b"?")) for x in words)
    marks = n - sum(map(bool, [x.strip(MARKS) for x in words]))
    symbol_ends = sum(x.endswith(SYMBOLS) for x in words) if symbols else 0
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(set(words)), upper, ends, marks, symbol_ends


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    workspace("quality")
    for batch in slices(batches):
        rows = np.array([count_text(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(COUNTS + EXTRA))
        keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        names = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*keep, *(pa.array(rows[:, i]) for i in range(rows.shape[1]))], names=[*names, *COUNTS, *EXTRA])


def quality_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each document."""
    return docs.select("doc_id", "text").mapInArrow(_count_batches, f"doc_id bigint, {SCHEMA}")


def _band(value, bad, good):
    """-1 where bad holds, +1 where good holds, else 0 (abstains)."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes():
    """The rules, as columns over the counts. Each abstains where it has little to go by."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.col(c) / n
    enough = F.col("n_words") >= 20
    return {
        "length": _band(n, F.col("n_words") < 20, F.col("n_words") >= 50),
        "word_length": _band(n, enough & ((share("word_chars") < 2.5) | (share("word_chars") > 12)), enough & share("word_chars").between(3.5, 9)),
        "symbols": _band(n, enough & (share("n_symbols") > 0.2), enough & (share("n_symbols") <= 0.02)),
        "symbol_words": _band(n, enough & (share("n_symbol_ends") > 0.2), enough & (share("n_symbol_ends") <= 0.05)),
        "marks": _band(n, enough & (share("n_marks") > 0.2), enough & (share("n_marks") <= 0.05)),
        "dup_lines": _band(n, (F.col("n_lines") >= 4) & (F.col("n_dup_lines") > 0.4 * F.col("n_lines")), (F.col("n_lines") >= 2) & (F.col("n_dup_lines") == 0)),
        "repeats": _band(n, 100 * F.col("n_repeat_words") > 30 * F.col("n_words"), enough & (share("n_repeat_words") <= 0.1)),
        "upper": _band(n, enough & (share("n_upper") > 0.4), enough & (share("n_upper") <= 0.1)),
        "sentences": _band(n, enough & (share("n_ends") > 0.5), enough & share("n_ends").between(0.03, 0.35)),
        "variety": _band(n, enough & (F.col("n_words") < 2000) & (share("n_distinct") < 0.25), enough & (share("n_distinct") >= 0.4)),
    }


RULES = ("length", "word_length", "symbols", "symbol_words", "marks", "dup_lines", "repeats", "upper", "sentences", "variety")
#: What EM starts from: rows by class (bad, good), columns by outcome (bad, abstain, good). Bad votes are rare but telling.
START = np.array([[0.30, 0.10, 0.60], [0.005, 0.095, 0.90]])


def fit_em(patterns: np.ndarray, weights: np.ndarray, steps: int = 200, prior: float = 0.8):
    """(prior of good, table[class, rule, outcome]) by expectation-maximisation over vote patterns (values -1, 0, 1).

    START only says which class is which: a prior as strong as one document, so that no rate is 0.
    """
    table = np.repeat(START[:, None, :], patterns.shape[1], axis=1)
    total = weights.sum()
    if not total:
        return prior, table
    hold = START[:, None, :]
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(steps):
        post = posterior(patterns, prior, table)
        for k, r in enumerate((1 - post, post)):
            s = np.einsum("p,prv->rv", r * weights, onehot) + hold[k]
            table[k] = s / s.sum(axis=1, keepdims=True)
        new = float(np.clip((post * weights).sum() / total, 0.05, 0.99))
        if abs(new - prior) < 1e-9:
            break
        prior = new
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """Probability of the good class by vote pattern."""
    pick = table[:, np.arange(patterns.shape[1])[None, :], patterns + 1]
    log = np.log(np.maximum(pick, 1e-12)).sum(axis=2) + np.log([1 - prior, prior])[:, None]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def vote_pattern():
    """The votes as one number: base 3, a digit a rule."""
    return sum((v + 1) * 3**i for i, v in enumerate(votes().values())).cast("int")


def fit_model(counted: DataFrame) -> DataFrame:
    """(pattern, p_good) from counts of all documents with their vote_pattern(): at most 3**len(RULES) rows."""
    seen = counted.groupBy("pattern").count().collect()  # at most 3**10 rows
    codes = np.array([r["pattern"] for r in seen], np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(len(RULES))[None, :]) % 3 - 1
    prior, table = fit_em(patterns, np.array([r["count"] for r in seen], float))
    post = posterior(patterns, prior, table) if len(codes) else np.zeros(0)
    rows = [(int(c), float(p)) for c, p in zip(codes, post, strict=True)]
    return counted.sparkSession.createDataFrame(rows, "pattern int, p_good double")


def _judged(counted: DataFrame, model: DataFrame, threshold: float) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        counted.join(F.broadcast(model), "pattern", "left")  # 59,049 rows at most
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("p_good") >= threshold))
    )


def quality_report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, p_good (the posterior) and kept, for every row of docs.

    The counts go to the shared folder once (a few dozen bytes a document), as EM and the result both read them.
    """
    counted = materialise(quality_counts(docs).withColumn("pattern", vote_pattern()), "quality")
    return _judged(counted, fit_model(counted), threshold).select("doc_id", *COUNTS, "base_failed", "p_good", "kept")


def quality_filter(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the report keeps, with all their columns (own columns of the same names included).

    Texts are read twice and never shuffled: once to fit the model, once to judge.
    """
    model = fit_model(quality_counts(docs).withColumn("pattern", vote_pattern()))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    row_type = rows.schema["row"].dataType.simpleString()
    counted = rows.mapInArrow(_count_batches, f"row {row_type}, {SCHEMA}").withColumn("pattern", vote_pattern())
    return _judged(counted, model, threshold).filter("kept").select("row.*")
