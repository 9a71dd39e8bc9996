"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Shingles are runs of five lower-cased words (all words of a shorter text). ProbMinHash: each shingle is a Poisson process
whose rate is its weight; each arrival, in order of time, bids for one random component of the signature, and the
earliest bid holds it. Arrivals beyond the time by which every component is taken cannot matter, so the processes stop
there: a number of arrivals that depends on the signature's size, not on the text's. Two signatures agree in a component
with the probability Jaccard similarity of the two texts. The weights are 1 here, whatever a shingle's number in the text:
then that similarity is the Jaccard similarity of the shingle sets, by which a pair counts.

Bands of the signature make buckets. In a bucket nobody is paired with all others: each text is paired with the bucket's
hub, the text that meets most texts over all buckets (the origin of a family of copies), so pairs are linear in the
bucket's size. Texts that fail against the hub go on, among themselves, to further rounds. What may still be linked is a
text far from a hub and one near it (in the last round also two far ones) in different classes; across() finds these
without pairing them all (see there). A pair counts if the exact Jaccard similarity of its shingle sets is at least the
threshold; pairs whose signatures rule that out, by over five standard deviations, are dropped first. Classes are the
connected components, found by label propagation with pointer jumping over tables in the shared folder.

Equal texts are one text to all of this, known by a 64-bit hash, so a group of thousands of copies costs one row a copy;
the class is named by the smallest doc_id of all its rows.

Nulls and odd rows: a null, empty or blank text is alone in its class, named by its own doc_id; rows of one doc_id and
different texts are each in the class of their text; a null doc_id gets the class of its text (null if no row of the class
has a doc_id); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, mix64, only_wanted, slices, workspace

WORDS, SIZE, BANDS = 5, 125, 25
ROWS = SIZE // BANDS
BASE = 0x9E3779B97F4A7C15
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, mod 2**64."""
    up, down = np.full(n, BASE, U64), np.full(n, pow(BASE, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all word shingles of all texts, number of shingles of each text).

    All texts are hashed as one array: a word's hash is a difference of two prefix sums of a polynomial.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = b"\n" + b"\n".join(raw) + b"\n"
    b = np.frombuffer(data, np.uint8)
    size = 1 << max(16, len(b).bit_length())
    up, down = _powers(size)
    gap = SPACES[b]
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    sums = np.zeros(len(b) + 1, U64)
    np.cumsum((b.astype(U64) + U64(1)) * up[: len(b)], out=sums[1:])
    word = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))
    edges = np.cumsum([1] + [len(r) + 1 for r in raw])
    first = np.searchsorted(start, edges)
    n = np.diff(first)
    many = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    begin = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    length = np.repeat(np.minimum(n, words), many)
    h = np.zeros(len(begin), U64)
    for k in range(words):
        on = k < length
        h[on] = mix64(h[on] * U64(BASE) + word[begin[on] + k])
    return h, many


def _sets(h: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes of each text in turn, text of each)."""
    text = np.repeat(np.arange(len(many)), many)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def prob_minhash(h: np.ndarray, weight: np.ndarray, text: np.ndarray, n_texts: int, size: int = SIZE) -> np.ndarray:
    """Signatures (n_texts, size) of weighted sets given as flat arrays; texts without elements have zeros."""
    total = np.bincount(text, weights=weight, minlength=n_texts)
    signature = np.zeros((n_texts, size), U64)
    todo, factor = np.flatnonzero(total > 0), 1.0
    while len(todo):
        stop = np.zeros(n_texts)
        stop[todo] = factor * size * (np.log(size) + 5) / total[todo]  # by then each component is taken, but for 1 text in 150
        on = stop[text] > 0
        key, rate, own = h[on], weight[on], text[on]
        time = np.zeros(len(key))
        best = np.full(n_texts * size, np.inf)
        seen = []
        k = 0
        while len(key):
            r = mix64(key + U64((k * 0xD1B54A32D192ED03 + 1) & (2**64 - 1)))
            time = time - np.log(((r >> U64(12)).astype(float) + 1) * 2.0**-52) / rate
            live = time < stop[own]
            key, rate, own, time = key[live], rate[live], own[live], time[live]
            place = own * size + ((mix64(r[live]) >> U64(32)) * U64(size) >> U64(32)).astype(np.int64)
            np.minimum.at(best, place, time)
            seen.append((place, time, key))
            k += 1
        place, when, key = (np.concatenate([s[i] for s in seen]) for i in range(3))
        win = when == best[place]
        signature.reshape(-1)[place[win]] = key[win]
        taken = np.isfinite(best.reshape(n_texts, size)).all(axis=1)
        todo = todo[~taken[todo]]
        factor *= 2
    return signature


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches, and which of their rows hold a text that the task has not met before."""
    workspace("neardup")
    seen: set[int] = set()
    for batch in slices(batches):
        fresh = np.zeros(len(batch), bool)
        for i, node in enumerate(batch.column("node").to_pylist()):
            if node is not None and node not in seen:
                seen.add(node)
                fresh[i] = True
        yield batch, fresh


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures and buckets; those of a text that the task has met before are null, and node where there is no word."""
    for batch, fresh in _fresh(batches):
        at = np.flatnonzero(fresh)
        texts = batch.column("text").take(pa.array(at)).to_pylist()
        h, many = shingles(texts)
        distinct, text = _sets(h, many)
        signature = prob_minhash(distinct, np.ones(len(distinct)), text, len(texts))
        bands = np.zeros((len(texts), BANDS), U64)
        for k in range(ROWS):
            bands = mix64(bands * U64(BASE) + signature[:, k::ROWS])
        bands = mix64(bands + np.arange(BANDS, dtype=U64) * U64(BASE)).view(np.int64)
        small = (signature & U64(0xFFFF)).astype("<u2")
        buckets: list = [None] * len(batch)
        signatures: list = [None] * len(batch)
        nodes = batch.column("node").to_pylist()
        for i, k in enumerate(at.tolist()):
            if many[i]:
                buckets[k], signatures[k] = bands[i], small[i].tobytes()
            else:
                nodes[k] = None
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), pa.array(signatures, pa.binary())], names=["doc_id", "node", "bands", "signature"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted shingle set of each text, once a task."""
    for batch, fresh in _fresh(batches):
        at = pa.array(np.flatnonzero(fresh))
        texts = batch.column("text").take(at).to_pylist()
        distinct, text = _sets(*shingles(texts))
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        yield pa.RecordBatch.from_arrays([batch.column("node").take(at), pa.array([distinct[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], names=["node", "shingles"])


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sorted sets of 64-bit hashes."""
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _similar(name_a: str, name_b: str, test):
    """The pairs (a, b) that pass a test of two of their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [test(x, y) for x, y in zip(batch.column(name_a).to_pylist(), batch.column(name_b).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label): the smallest id of each connected component of edges (a, b), for the ids that occur in them.

    Each round takes the smallest label among the neighbours, then the label of that label; tables, no driver data.
    """
    both = scratch.put(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    while True:  # labels only fall
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        new = scratch.put(lower.join(up, "label", "left").select("id", "old", F.least("label", F.coalesce("jump", "label")).alias("label")), "labels")
        labels = new.select("id", "label")
        if new.filter("label <> old").isEmpty():
            return labels


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row: how many shingles the hub has, which the text has besides (added) and which it lacks (removed)."""
    names = ["round", "hub", "node", "far", "label"]
    for batch in batches:
        n, added, removed = [], [], []
        for own, base in zip(batch.column("shingles").to_pylist(), batch.column("base").to_pylist(), strict=True):
            x, h = np.frombuffer(own, np.int64), np.frombuffer(base, np.int64)
            n.append(len(h))
            added.append(np.setdiff1d(x, h, assume_unique=True))
            removed.append(np.setdiff1d(h, x, assume_unique=True))
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(added, lists), pa.array(removed, lists)], names=[*names, "n", "added", "removed"])


def across(members: DataFrame, sets: DataFrame, threshold: float, last: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of texts that may be similar among members (round, hub, node, far, label): a far text with one that
    is near the hub or, in the last round, far as well, where their labels differ. No similar pair is missed.

    Not the texts but their differences from a common reference are joined. The reference of a hub is the set of shingles
    that more than half of its members have. With n shingles in it, r and a that a text lacks and has besides, and s
    differences that x and y share, similarity t needs exactly (1 + t) s >= c(x) + c(y) - (1 - t) n, where c = r + t a. So

    * texts with c(x) <= (1 - t) n - c(m), m being the near (or, in the last round, far) text of the least c, are similar to
      m and paired with it, so that those of which this holds need not be paired with each other;
    * all other pairs share a difference. If it is none of the added shingles, s is at most r(y), and then
      t (r(y) - a(y)) >= c(x) - (1 - t) n: y must be the shorter by that much. Such texts are joined by what they lack, y without the
      most frequent of it: it shares at least (c(y) + c(x) - (1 - t) n) / (1 + t), so as many less one stay out;
    * else they are joined by an added shingle. Of these x needs not join its most frequent ones: it shares at least
      (c(x) - (1 - t) n - t d) / (1 + t) of them, where d is the largest r - a of the group, so as many less one stay out.

    Changes made in a copy alone are shared by nobody, so the rows are as many as shared changes, not as pairs of members.
    """
    t = threshold
    group = ["round", "hub"]
    held = members.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("base")), "hub")
    apart = scratch.put(held.mapInArrow(_difference, "round int, hub bigint, node bigint, far boolean, label bigint, n bigint, added array<bigint>, removed array<bigint>"), "differences")
    size = apart.groupBy(*group).agg(F.count(F.lit(1)).alias("m"))
    common = None
    for c in ("added", "removed"):  # what more than half of the members differ in is turned round
        seen = apart.select(*group, F.explode(c).alias("token")).groupBy(*group, "token").agg(F.count(F.lit(1)).alias("k"))
        often = seen.join(size, group).filter("2 * k > m").groupBy(*group).agg(F.collect_list("token").alias(f"often_{c}"))
        common = often if common is None else common.join(often, group, "full")
    told = apart.join(scratch.put(common, "turned"), group, "left")
    for c in ("added", "removed"):
        told = told.withColumn(f"often_{c}", F.coalesce(f"often_{c}", F.array().cast("array<bigint>")))
    told = told.select(
        *group, "node", "far", "label", (F.col("n") + F.size("often_added") - F.size("often_removed")).alias("n"),
        F.concat(F.array_except("added", "often_added"), F.array_except("often_removed", "removed")).alias("added"),
        F.concat(F.array_except("removed", "often_removed"), F.array_except("often_added", "added")).alias("removed"),
    )
    told = told.withColumns({"r": F.size("removed"), "over": F.size("removed") - F.size("added"), "c": F.size("removed") + t * F.size("added")})
    told = scratch.put(told.withColumn("e", F.col("c") - (1 - t) * F.col("n")), "told")
    least = lambda on: F.min(F.when(on, F.struct("c", "node", "label")))
    extent = told.groupBy(*group).agg(least(~F.col("far")).alias("nearest"), least(F.col("far") & (F.col("round") == last)).alias("nearest_far"), F.max("over").alias("d"))
    far = told.filter("far").join(scratch.put(extent, "extent"), group)
    sure = None
    for c in ("nearest", "nearest_far"):
        one = far.filter((F.col("e") + F.col(c)["c"] <= 1e-6) & (F.col(c)["label"] != F.col("label"))).select(F.col("node").alias("a"), F.col(c)["node"].alias("b"))
        sure = one if sure is None else sure.unionByName(one)
    # By an added shingle that several texts have.
    token = told.select(*group, "node", "far", F.explode("added").alias("token"))
    shared = scratch.put(token.groupBy(*group, "token").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "shared-tokens")
    token = token.join(shared, [*group, "token"])
    spare = F.greatest(F.ceil((F.col("e") - t * F.col("d")) / (1 + t) - 1e-6) - 1, F.lit(0)).cast("int")
    frequent = token.filter("far").groupBy(*group, "node").agg(F.sort_array(F.collect_list(F.struct("k", "token")), asc=False).alias("tokens"))
    x = far.join(frequent, [*group, "node"]).withColumn("spare", spare)
    x = x.select(*group, F.col("node").alias("a"), F.col("label").alias("of_a"), F.col("e").alias("e_a"), F.col("r").alias("r_a"), "spare", F.explode(F.slice("tokens", F.col("spare") + 1, F.greatest(F.size("tokens") - F.col("spare"), F.lit(0)))).alias("kt"))
    x = x.withColumn("token", F.col("kt.token")).drop("kt")
    other = told.select(*group, F.col("node").alias("b"), F.col("label").alias("of_b"), F.col("c").alias("c_b"), F.col("r").alias("r_b"), F.col("over").alias("over_b"), F.col("far").alias("far_b"), "added", "removed")
    y = other.select(*group, "b", "of_b", "c_b", "r_b", "far_b", F.explode("added").alias("token")).join(shared.select(*group, "token"), [*group, "token"])
    different = (F.col("a") != F.col("b")) & (F.col("of_a") != F.col("of_b")) & (~F.col("far_b") | (F.col("round") == last))
    near = x.join(y, [*group, "token"]).filter(different).groupBy(*group, "a", "b").agg(F.count(F.lit(1)).alias("s"), *(F.first(c).alias(c) for c in ("e_a", "r_a", "spare", "c_b", "r_b")))
    near = near.filter((1 + t) * (F.col("s") + F.col("spare") + F.least("r_a", "r_b")) >= F.col("e_a") + F.col("c_b") - 1e-6).select("a", "b")
    # By what both lack, where one is so much the shorter.
    x = far.filter(t * F.col("d") >= F.col("e") - 1e-6)
    short = x.groupBy(*group).agg(F.min("e").alias("least_e"))
    x = x.select(*group, F.col("node").alias("a"), F.col("label").alias("of_a"), F.col("e").alias("e_a"), F.explode("removed").alias("token"))
    x = scratch.put(x, "far-lacks")
    known = x.groupBy(*group, "token").agg(F.count(F.lit(1)).alias("k"))
    spare = F.greatest(F.ceil((F.col("least_e") + F.col("c_b")) / (1 + t) - 1e-6) - 1, F.lit(0)).cast("int")
    y = other.join(short, group).filter(t * F.col("over_b") >= F.col("least_e") - 1e-6).withColumn("spare", spare)
    y = y.select(*group, "b", "of_b", "c_b", "over_b", "far_b", "spare", F.explode("removed").alias("token")).join(known, [*group, "token"])
    y = y.groupBy(*group, "b", "of_b", "c_b", "over_b", "far_b", "spare").agg(F.sort_array(F.collect_list(F.struct("k", "token")), asc=False).alias("tokens")).filter("size(tokens) > spare")
    y = y.withColumn("kt", F.explode(F.expr("slice(tokens, spare + 1, size(tokens) - spare)"))).withColumn("token", F.col("kt.token")).drop("kt", "tokens")
    lack = x.join(y, [*group, "token"]).filter(different & (t * F.col("over_b") >= F.col("e_a") - 1e-6)).groupBy(*group, "a", "b").agg(F.count(F.lit(1)).alias("s"), *(F.first(c).alias(c) for c in ("e_a", "c_b", "spare")))
    lack = lack.filter((1 + t) * (F.col("s") + F.col("spare")) >= F.col("e_a") + F.col("c_b") - 1e-6).select("a", "b")
    return scratch.put(sure.unionByName(near).unionByName(lack).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "across")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, rounds: int = 3) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of its class) of every row of docs."""
    scratch = Scratch()
    rows = docs.select("doc_id", "text", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("node"))
    signed = scratch.put(rows.mapInArrow(_sign, "doc_id bigint, node bigint, bands array<bigint>, signature binary"), "signatures")
    texts = scratch.put(signed.filter("node is not null and signature is not null").groupBy("node").agg(F.first("bands").alias("bands"), F.first("signature").alias("signature")), "representatives")
    met = texts.select("node", F.explode("bands").alias("bucket"))
    shared = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = scratch.put(met.join(shared, "bucket"), "buckets")
    left = met.select("node", "bucket").join(met.groupBy("node").agg(F.sum("n").alias("degree")), "node")
    least = (2 * threshold - 1) * SIZE  # agreement that no pair over the threshold falls short of, by over 5 deviations

    def alike(a: bytes, b: bytes) -> bool:
        return int((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).sum()) >= least

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = scratch.put(nodes.distinct(), "wanted")
        return scratch.put(only_wanted(rows.select("node", "text"), "node", wanted, _set_rows, "node bigint, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")

    def verify(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose sets are similar."""
        ends = lambda x: x.select(F.col("a").alias("node")).union(x.select(F.col("b").alias("node")))
        sig = scratch.put(texts.select("node", "signature").join(ends(pairs).distinct(), "node", "left_semi"), "pair-signatures")
        pairs = pairs.join(sig.select(F.col("node").alias("a"), F.col("signature").alias("s")), "a").join(sig.select(F.col("node").alias("b"), F.col("signature").alias("t")), "b")
        pairs = scratch.put(pairs.mapInArrow(_similar("s", "t", alike), "a bigint, b bigint"), "candidates")
        sets = sets_of(ends(pairs))
        full = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
        return scratch.put(full.mapInArrow(_similar("s", "t", lambda x, y: jaccard(x, y) >= threshold), "a bigint, b bigint"), "links")

    edges = near = far = None
    for k in range(rounds):
        leaders = left.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("h"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("bucket", F.col("h.node").alias("hub"))
        tried = scratch.put(left.join(leaders, "bucket").filter("node <> hub"), "tried")
        links = verify(scratch.put(tried.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "pairs"))
        # What is not linked to the hub of a bucket goes on in that bucket, without the hub.
        rest = tried.join(links.select(F.col("a").alias("node"), F.col("b").alias("hub")), ["node", "hub"], "left_anti")
        rest = scratch.put(rest, "left")
        at = F.lit(k).alias("round")
        close = links.select(at, F.col("b").alias("hub"), F.col("a").alias("node"))
        away = rest.select(at, "hub", "node").distinct()
        edges, near, far = (links, close, away) if edges is None else (edges.unionByName(links), near.unionByName(close), far.unionByName(away))
        left = rest.select("node", "bucket", "degree")
        if left.isEmpty():
            break
    label = components(edges, scratch)
    named = lambda df, c, to: df.join(label.select(F.col("id").alias(c), F.col("label").alias("_l")), c, "left").withColumn(to, F.coalesce("_l", c)).drop("_l")
    far = scratch.put(named(named(far, "node", "label"), "hub", "of_hub").filter("label <> of_hub").drop("of_hub"), "far")
    near = named(near.unionByName(far.select("round", "hub", F.col("hub").alias("node")).distinct()).distinct(), "node", "label")
    open_ = far.groupBy("round", "hub").agg(F.count(F.lit(1)).alias("n_far")).join(near.groupBy("round", "hub").agg(F.count(F.lit(1)).alias("n_near")), ["round", "hub"])
    open_ = open_.filter((F.col("n_near") > 1) | ((F.col("round") == k) & (F.col("n_far") > 1))).select("round", "hub")
    members = near.withColumn("far", F.lit(False)).unionByName(far.withColumn("far", F.lit(True))).join(open_, ["round", "hub"])
    members = scratch.put(members.select("round", "hub", "node", "far", "label"), "members")
    if not members.isEmpty():
        sets = sets_of(members.select("node").union(members.select("hub")))
        pairs = across(members, sets, threshold, k, scratch)
        if not pairs.isEmpty():
            label = components(edges.unionByName(verify(pairs)), scratch)
    lowest = signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    named_texts = scratch.put(lowest.join(label, lowest["node"] == label["id"], "left").select("node", "first_id", F.coalesce("label", "node").alias("label")), "texts")
    classes = scratch.put(named_texts.join(named_texts.groupBy("label").agg(F.min("first_id").alias("class_id")), "label").select("node", "class_id"), "classes")
    scratch.drop(signed, classes)
    return signed.select("doc_id", "node").join(classes, "node", "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that stay: of each class the one whose doc_id names it (one of them, if rows repeat).

    Rows with a null doc_id stay, one of each text; further columns are kept.
    """
    stay = near_duplicates(docs, threshold).filter("doc_id = class_id or doc_id is null").select("doc_id").distinct()
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
