"""Each operator against a brute-force version, a round trip or held-out accuracy, and on odd rows and empty tables."""

import base64
import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from codesieve.llm import common, decontam, htmltext, langid, neardup, packing, quality, rollups, suffixes, tokenfile, warc

SF = "/root/testdata/sf0.001"


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(r):
    return tuple((x is None, x) for x in r)


# 1 -----------------------------------------------------------------------------------------------------------------------


def brute_warc(rows):
    first = {}
    for i, h in rows:
        b = (h or "").encode()
        if i is not None:
            first[b] = min(first.get(b, i), i)
    return Counter((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, h in rows), first


def test_warc_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    extra = spark.createDataFrame([(900, None, None), (901, "http://a b/ü\r\n", ""), (902, "u", "same"), (903, "u", "same"), (904, "u", "same"), (None, "u", "same"), (905, "u", "z" * 400_000), (902, "u", "same")], "page_id bigint, url string, html string")
    both = pages.select("page_id", "url", "html").unionByName(extra).withColumn("digest", F.lit(1)).withColumn("shard", F.lit("s"))
    got = warc.archive_digests(both).collect()
    want, first = brute_warc([(r["page_id"], r["html"]) for r in both.collect()])
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    by_digest = {base64.b32encode(hashlib.sha1(b).digest()).decode(): i for b, i in first.items()}
    seen = Counter()
    for r in got:
        if r["record_type"] == "response":
            assert r["refers_to"] is None and r["page_id"] == by_digest[r["payload_digest"]]
            seen[r["payload_digest"]] += 1
        else:
            assert r["refers_to"] == by_digest[r["payload_digest"]]
    assert set(seen.values()) == {1} and set(seen) == set(by_digest)


def test_warc_is_deterministic_and_rolls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    runs = []
    for n in (1, 5):
        out = common.shared_path(spark, "warc-test")
        m = warc.write_archive(pages.repartition(n), out, shard_bytes=60_000, roll_bytes=20_000)
        runs.append(sorted(map(tuple, m.collect())))
        assert warc.read_archive(spark, out).count() == 50
    assert runs[0] == runs[1] and len(runs[0]) > 3


def test_range_bounds_split_all_heavy_cells(spark):
    from codesieve.llm.ranges import deal, range_bounds, shard_column

    even = spark.range(300_000).select((F.col("id") * 7).alias("k"))
    far = even.unionByName(spark.createDataFrame([(-(2**63),), (2**63 - 1,), (None,)], "k bigint")).unionByName(spark.range(500).select(F.lit(35).cast("bigint").alias("k")))
    for df, most in ((even, 400), (far, 700)):
        bounds = range_bounds(df, "k", F.lit(1), 200)
        sizes = shard_column(df, "k", bounds).groupBy("shard").count().collect()
        assert bounds == sorted(set(bounds)) and max(r["count"] for r in sizes) <= most and len(sizes) > 700
    own = deal(shard_column(even, "k", bounds), len(bounds) + 1).select("shard", F.spark_partition_id().alias("p")).distinct()
    assert own.filter("shard <> p").count() == 0
    assert range_bounds(even.filter("false"), "k", F.lit(1), 200) == []


def test_archive_query_rolls_and_reader_is_linear(spark):
    rng = np.random.default_rng(12)
    rows = [(i, "u", rng.bytes(150_000).hex()) for i in range(60)]  # 18 MB that hardly compress below a half
    out = common.shared_path(spark, "roll")
    names = [r["file"] for r in warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"), out).collect()]
    assert len(names) > 1 and any(n.endswith("-0001.warc.gz") for n in names)
    record = warc.write_record(1, "u", b"x" * 1500, None, False, warc.base32_sha1(b"x" * 1500), 4)
    took = []
    for n in (2000, 16_000):
        began = time.process_time()
        assert sum(1 for _ in warc.read_records(record * n)) == n
        took.append(time.process_time() - began)
    assert took[1] < 20 * took[0]


def test_warc_of_nothing(spark):
    assert warc.archive_digests(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_warc_reader_refuses_damage():
    record = warc.write_record(1, "u", b"payload", None, False, warc.base32_sha1(b"payload"), 6)
    assert next(warc.read_records(record))[1] == b"payload"
    with pytest.raises((ValueError, zlib.error)):
        list(warc.read_records(record[:-9]))


# 2 -----------------------------------------------------------------------------------------------------------------------


def test_main_text():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>"
        "<div class='cookie-notice'>We use cookies</div><div id=main><h1>Head &amp; line</h1><p>First  <b>bold</b>\n text<p>Second &lt;x&gt;<script>var a='</p>';</script></div>"
        "<aside>Side</aside><div class=comments><p>Reader says a lot of words here</p></div><form>Search</form><footer>Foot</footer></body></html>"
    )
    assert htmltext.main_text(page) == "Head & line First bold text Second <x>"
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p></p>") == ""
    assert htmltext.main_text("plain words only") == "plain words only"
    assert htmltext.main_text("<body><ul><li><a href=a>one</a><li><a href=b>two</a></ul><div><p>" + "Long text of the story. " * 20 + "</p></div></body>").startswith("Long text")


def test_unclosed_cut_elements_end_where_their_parents_do():
    for ad in ("<p class=ad>Buy", "<div class=ad>Buy</p>", "<aside>Buy", "<nav><a href=x>Buy</a>", "<ul><li class=share>Buy<li class=share>Buy</ul>"):
        page = f"<body><article><div>{ad}</div><p>Real text<p>More</p></article></body>"
        assert htmltext.main_text(page) == "Real text More"
    assert htmltext.main_text("<article><p class=ad>Buy<p>Real text</p><p>More</p></article>") == "Real text More"
    assert htmltext.main_text("<ul><li class=share>Buy<li>Real text<li>More</ul>") == "Real text More"
    assert htmltext.main_text("<article><nav><nav>In</nav>Out</nav><p>Real text</article>") == "Real text"


def test_cuts_are_by_whole_names_and_attributes():
    story = "<p>Long text of the story.</p>" * 9
    want = " ".join(["Long text of the story."] * 9)
    for name in ("layout with-sidebar", "site-content no-sidebar", "share-price", "left-side", "search-results", "sidebar"):
        assert htmltext.main_text(f"<body><div class='{name}'>{story}</div></body>") == want
        assert htmltext.main_text(f"<body><div class='{name}'><h1>Head</h1>{story}</div><footer>Foot</footer></body>") == "Head " + want
    assert htmltext.main_text(f"<body><form id=aspnet><article>{story}</article><div class=comments><p>Reader</p></div></form></body>") == want
    assert htmltext.main_text(f"<body><article>{story}</article><div class='comments-list'>{story * 3}</div></body>") == want
    assert htmltext.main_text("<p><a title='A hidden gem' href=x>link</a> and <b data-t='the hidden valley'>text</b> here") == "link and text here"
    for hidden in ("hidden", "hidden=''", "aria-hidden=true", "style='color:red; display: none'"):
        assert htmltext.main_text(f"<article><p>Seen</p><p {hidden}>Not seen</p></article>") == "Seen"
    assert htmltext.main_text("<div class=ad><p>One</p></div><div class=share><p>Two</p></div>") == "One Two"


def test_pages_are_their_articles(spark):
    import html

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>|</?a[^>]*>", "", body))
        assert htmltext.main_text(r["html"]) == " ".join(" ".join(html.unescape(p).split()) for p in parts if p.strip())


def plain_density(root):
    """Composite density and density sums straight from their definition, by recursion."""
    def chars(n):
        return sum(len(re.sub(r"\s+", " ", p).strip()) if isinstance(p, str) else chars(p) for p in n.parts if p is not None)

    def tags(n):
        return sum(1 + tags(c) for c in n.children)

    def link_chars(n):
        return chars(n) if n.tag == "a" else sum(map(link_chars, n.children))

    def link_tags(n):
        return tags(n) + 1 if n.tag == "a" else sum(map(link_tags, n.children))

    def all_nodes(n):
        return [n] + [x for c in n.children for x in all_nodes(c)]

    nodes = all_nodes(root)
    body = next((n for n in nodes if n.tag == "body"), root)

    def density(n):
        c, t, lc, lt = chars(n), max(1, tags(n)), link_chars(n), link_tags(n)
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + link_chars(body) / chars(body) * c + math.e)
        return c / t * max(0.0, math.log(max(1 + 1e-9, c / max(1, lc) * t / max(1, lt))) / math.log(max(1 + 1e-9, base)))

    return {id(n): (density(n), sum(map(density, n.children))) for n in nodes}


def test_density_is_as_defined(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").limit(12).collect()] + ["<body><p>a<a href=x>bc</a> d</p><ul><li><a>x</a><li><a>y z</a></ul>"]
    for page in pages:
        root = htmltext.parse(page)
        want = plain_density(root)
        for n in htmltext._measure(root):
            assert want[id(n)] == pytest.approx((n.density, n.total))


def test_density_decides_where_names_say_nothing():
    story = "".join(f"<p>Sentence {i} of a long story that goes on for a while, as stories do, with many words in it.</p>" for i in range(12))
    links = "<ul>" + "".join(f"<li><a href=/{i}>Another page {i}</a></li>" for i in range(40)) + "</ul>"
    for page in (f"<body><div>{links}</div><div class=x>{story}</div><div>{links}</div></body>", f"<body><table><tr><td>{links}</td><td>{story}</td></tr></table></body>"):
        got = htmltext.main_text(page)
        assert "Sentence 0" in got and "Sentence 11" in got and "Another page" not in got
        root = htmltext.parse(page)  # the whole body would hold the links
        assert "Another page" in " ".join(htmltext._blocks(root))


def test_hostile_pages_take_linear_time():
    for page in ('<a "x ' * 170_000, '<a "x ' * 85_000 + '">' + "<p>end</p>", "<!" * 500_000, "<b>" * 300_000 + "<li>x" * 1000, "<div title='a < b'>text</div>" * 20_000, "&" * 1_000_000, "<p" * 400_000):
        began = time.process_time()
        htmltext.main_text(page)
        assert time.process_time() - began < 12, page[:20]
    assert htmltext.main_text("<div title='a < b > c'>some text</div>") == "some text"


def test_pages_of_nothing(spark):
    assert htmltext.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string, text string")).count() == 0


def test_extract_pages_keeps_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a", "y")], "page_id bigint, url string, html string, text string")
    assert sorted(map(tuple, htmltext.extract_pages(df).collect()), key=key) == [(1, "u", "", 0), (1, "u", "", 0), (None, None, "a", 1)]


# 3 -----------------------------------------------------------------------------------------------------------------------


def edit_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(150):
        item = "".join(rng.choice(list("abc"), rng.integers(1, 14)))
        text = "".join(rng.choice(list("abc"), rng.integers(1, 30)))
        best = decontam.myers(item, text, len(item))
        assert best[0] == edit_in(item, text)


def test_matcher_finds_all_within_budget():
    rng = np.random.default_rng(2)
    items = [(i, " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(8))) for i in range(12)]
    m = decontam.Matcher(items, 0.06)
    for i, t in items:
        for edits in range(6):
            s = list(t)
            for p in rng.choice(len(s), edits, replace=False):
                s[p] = "z"
            doc = "words before " + "".join(s).upper() + "  after"
            want = [(k, d) for k, x in items if (d := edit_in(x, decontam.normal(doc))) <= decontam.budget(len(x), 0.06)]
            assert sorted(m.find(doc)) == sorted(want)


def test_contamination_of_documents(spark, small, odd, nothing):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contamination_report(small, bench).collect()}
    exact = {(d, r["item_id"]) for d, t in texts(small) for r in bench.collect() if decontam.normal(r["text"]) in decontam.normal(t)}
    assert exact <= got and exact
    left = {d for d, _ in texts(decontam.drop_contaminated(small, bench, block_chars=2000))}
    assert left == {d for d, _ in texts(small)} - {d for d, _ in got}
    none = spark.createDataFrame([(1, None), (2, "")], "item_id bigint, text string")
    assert decontam.contamination_report(odd, none).count() == 0
    assert decontam.drop_contaminated(odd, bench).count() == odd.count()
    assert decontam.contamination_report(nothing, bench).count() == 0


# 4 -----------------------------------------------------------------------------------------------------------------------


def bpe(text):
    return common._tokenizer(common.tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def test_word_cache_is_the_tokenizer(small, odd):
    cache = common.WordCache(common.tokenizer_path(), limit=50)
    own = [t for _, t in texts(small)[:60] + texts(odd) if t is None or len(t) < 100_000] + ["ΑΣ. İs'TAN'll ́x ﬁ don't", "a\x1fb \x1d", "a\u00a0b \u2003c\u3000 d\u0085 \u2028e\u00a0 \u00a0", " \u0301a e \u0301", "\x0b\x0ca\r\n"]
    for t, ids in zip(own, cache.encode(own), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == bpe(t)


def test_slice_coder_is_the_tokenizer(small, odd, monkeypatch):
    """Plain chunks are merged side by side, as the library does it, and without asking it."""
    path, rng = common.tokenizer_path(), np.random.default_rng(7)
    letters = list("etaoinshrdlucmfwypvbgkqjxzETAOINaaaeee") + ["\u00e4", "\u00d6", "\u00df", "\u00ff", "\u00c0", "\u00de"]
    words = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 70, 3000)]
    plain = [w + str(rng.choice(["", "", ".", "!?)", "###"])) for w in words if len(w.encode()) <= 62]
    other = ["\u00d7a", "a\u00f7", "a\u00aa", "\u00b5", "it's", "x'", "a.b", ".a", "a1", "a" + "-" * 80, "J\u030c", "\u0130I", "<|endoftext|>", "<|ENDOFTEXT|>.", "", " ", "\u0395\u03bb\u03ac\u03c2.", "\ud55c\uae00"]
    own = [*plain, *words, *other, None, " ".join(plain[:500] + other), *[t for _, t in texts(small)[:60] + texts(odd) if t is None or len(t) < 100_000]]
    want = [bpe(t) for t in own]
    for dtype, kind in (("<u2", pa.string()), ("<u4", pa.large_string())):
        coder = common.SliceCoder(path, dtype=dtype)
        assert [np.frombuffer(x, dtype).tolist() for x in coder.encode(pa.array(own, kind))] == want
    assert [np.frombuffer(x, "<u2").tolist() for x in common.SliceCoder(path).encode(pa.array([None, ""], pa.string()))] == [[], []]
    with monkeypatch.context() as m:
        m.setattr(common, "_tokenizer", None)
        m.setattr(common, "_model", None)
        assert [np.frombuffer(x, "<u2").tolist() for x in common.SliceCoder(path).encode(plain)] == want[: len(plain)]
        m.undo()
        m.setattr(common, "_merges", lambda _: None)  # a vocabulary of another kind
        assert [np.frombuffer(x, "<u2").tolist() for x in common.SliceCoder(path).encode(own)] == want


def test_word_cache_forgets_and_learns_again():
    cache, plain = common.WordCache(common.tokenizer_path(), limit=40), common._tokenizer(common.tokenizer_path())
    text = " ".join(f"Stra\u00dfe{k}, \u0395\u03bb\u03bb\u03ac\u03c2. WORD{chr(97 + k % 26)}!? it's na\u00efve... \u00bd, x\u00b2; I\u0307x, end." for k in range(60))
    for _ in range(5):
        for piece in (text, text.upper(), text.title(), "", None):
            own = np.frombuffer(cache.encode([piece])[0], "<u2").tolist()
            assert own == plain.encode(piece or "", add_special_tokens=False).ids
    assert cache.old


def test_rollups(spark, small, odd, nothing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic, poor = labels.filter("toxic = 1"), labels.filter("quality = 0")
    gone, changed = {r["doc_id"] for r in toxic.collect()}, {r["doc_id"] for r in poor.collect()}
    assert changed - gone
    want = defaultdict(lambda: [0, 0])
    for r in small.collect():
        if r["doc_id"] not in gone:
            n = len(bpe(r["text"]))
            for version, more in (("word_bpe_49k", int(r["doc_id"] in changed)), ("word_bpe_49k+end", 1)):
                want[r["source"], r["lang"], version][0] += 1
                want[r["source"], r["lang"], version][1] += n + more
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in rollups.rollup_documents(small, toxic, poor).collect()}
    assert got == dict(want)
    none = labels.filter("false")
    assert rollups.rollup_documents(odd, none, none).agg(F.sum("n_docs")).first()[0] == 2 * odd.count()
    assert rollups.rollup_documents(nothing, toxic, poor).count() == 0


def test_of_two_attempts_of_a_batch_one_counts(spark):
    c = spark.createDataFrame([("a", "en", "v1", 5)], "source string, lang string, tokenizer string, n_tokens bigint")
    r = rollups.TokenRollup(spark)
    sums = rollups.inserts(c)
    for attempt in ("b", "a", "c"):  # as drivers that race would leave them
        r._write(r._dir(f"batches/same/{attempt}"), sums)
    fs, half = common.hadoop_path(spark, r._dir("batches/half/x"))
    fs.mkdirs(half)  # a batch that was never finished
    assert r.committed() == ["same"] and [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 1, 5)]
    assert r.commit("half", sums) and rollups.TokenRollup(spark, r.path).committed() == ["half", "same"]


def test_rollup_batches_count_once(spark):
    c = spark.createDataFrame([("a", "en", "v1", 5, 3), ("a", "en", "v1", 7, 7), (None, None, "v1", 1, 1)], "source string, lang string, tokenizer string, n_tokens bigint, old_n_tokens bigint")
    r = rollups.TokenRollup(spark)
    assert r.commit("b1", rollups.inserts(c)) and not r.commit("b1", rollups.inserts(c))
    assert r.commit("b2", rollups.revisions(c)) and r.commit("b3", rollups.deletes(c.filter("source is null")))
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 2, 14)]
    r.compact()
    assert not r.commit("b2", rollups.revisions(c))
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 2, 14)] and len(r.committed()) == 1


# 5 -----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 513, 3000, 40_000])
def test_codec_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49_408, n), np.zeros(n, int), (rng.zipf(1.3, n) % 1000)):
        data = tokenfile.encode_file(ids, 49_408, block=7000)
        assert (tokenfile.decode_file(data) == ids).all()
        assert (tokenfile.decode_file(data, n // 3, n // 5) == ids[n // 3 : n // 3 + n // 5]).all()


def test_codec_finds_ids_as_a_search_does():
    rng = np.random.default_rng(9)
    for vocabulary in (1, 3, 49_408, 70_000):
        model = tokenfile.Model(vocabulary)
        for _ in range(6):
            model.waiting = [rng.zipf(1.2, 20_000) % vocabulary]
            model._count()
            rest = rng.integers(tokenfile.M // 16, tokenfile.M + 1, 5000)
            v = np.concatenate((np.zeros(500, int), rest[500:1000] - 1, (rng.random(4000) * rest[1000:]).astype(int)))
            want = (((v + 1) << tokenfile.M_BITS) - 1) // rest
            assert (model.find(v, rest.astype(float)) == np.searchsorted(model.cum, want, side="right") - 1).all()


def test_codec_blocks_are_alike_and_refresh_less_often():
    """No short last block, which would cost as many steps as a long one, and frequencies that are renewed as they age."""
    ids = np.random.default_rng(11).integers(0, 49_408, 400_000)
    data = tokenfile.encode_file(ids[:8001], 49_408, block=4000)
    index = np.frombuffer(data, "<u8", 6, len(data) - 20 - 48).reshape(-1, 2)
    assert index[:, 0].tolist() == [0, 2667, 5334] and (tokenfile.decode_file(data) == ids[:8001]).all()
    renewals = []

    class Counted(tokenfile.Model):
        def _count(self):
            renewals.append(self.held)
            super()._count()

    model, none = Counted(49_408), np.zeros(8192, np.int64)
    for own in ids[: 48 * 8192].reshape(-1, 8192):
        model.learn(none, own, none, none.astype(np.int32), none.astype(np.int32), none - 1, none - 1, none)
    assert len(renewals) < 26 and renewals[-1] > renewals[1] >= 8192


def test_codec_carries():
    """Runs that are predicted with near certainty leave narrow intervals, rare ids after them wide steps and carries."""
    rng = np.random.default_rng(5)
    for rare in (1, 0.1, 0.003):
        for top in (49_407, 3):
            ids = np.where(rng.random(60_000) < rare, top, 0)
            assert (tokenfile.decode_file(tokenfile.encode_file(ids, 49_408, block=30_000)) == ids).all()


def test_codec_beats_static_order_0():
    """On real documents the contexts earn more than a static order-0 code, which would be given its table for nothing."""
    rows = [t for (t,) in zip(*pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pydict().values(), strict=True)]
    ids = np.frombuffer(b"".join(common.word_cache(common.tokenizer_path()).encode(rows)), "<u2")
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum() / 8
    size = len(tokenfile.encode_file(ids, 49_408)) / len(ids)
    assert size < entropy - 0.03


def test_codec_compresses_and_checks():
    ids = np.tile(np.arange(50), 4000)
    data = tokenfile.encode_file(ids, 49_408)
    assert len(data) < len(ids)
    with pytest.raises(ValueError):
        tokenfile.decode_file(data[:2000] + bytes([data[2000] ^ 1]) + data[2001:])


def documents_as_ids(rows):
    at, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*bpe(t), 1]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(small, odd, nothing):
    for df in (small, odd):
        assert sorted(map(tuple, tokenfile.coded_documents(df).collect()), key=key) == sorted(documents_as_ids(texts(df)), key=key)
    assert tokenfile.coded_documents(nothing).count() == 0


# 6 -----------------------------------------------------------------------------------------------------------------------


def brute_repeats(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if d is not None:
                w = b[i : i + 50]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


def passages(spark, n=160):
    """A hot passage in every third document, near copies, and long passages over edges of documents."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(2, 8)))
    shared = [" ".join(word() for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(n):
        t = [word() for _ in range(rng.integers(5, 60))]
        if i % 3 == 0:
            t.insert(int(rng.integers(0, len(t))), shared[0])
        if i % 11 == 0:
            t = [shared[1], *t]
        if i % 13 == 0:
            t = [*t, shared[2][: int(rng.integers(40, 60))]]
        if i % 17 == 0 and rows:
            t = rows[i // 2][1].split()
            t[len(t) // 2] = "changed"
        rows.append((i, " ".join(t)))
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.mark.parametrize("heavy", [3000, 4])
def test_repeats(spark, small, odd, nothing, heavy, monkeypatch):
    monkeypatch.setattr(suffixes, "HEAVY", heavy)
    for df in (small.select("doc_id", "text"), passages(spark), odd.filter("length(text) < 9000 or text is null")):
        rows = texts(df)
        got = suffixes.repeat_report(df, part_bytes=20_000, bucket_bytes=50_000)
        assert sorted(map(tuple, got.collect()), key=key) == brute_repeats(rows)
    assert suffixes.repeat_report(nothing).count() == 0


def test_long_run_of_one_byte(odd):
    got = {r["doc_id"]: r for r in suffixes.repeat_report(odd).collect()}
    assert got[7]["n_removed"] == 0 and got[7]["n_bytes"] == 300_000 and got[2]["n_removed"] == got[2]["n_bytes"]


def test_removed_text_stays_utf8(spark):
    df = passages(spark)
    want = {r[0]: r[2] for r in brute_repeats(texts(df))}
    out = suffixes.remove_repeats(df.withColumn("n_chars", F.length("text").cast("long")).withColumn("key", F.lit("k")))
    assert out.columns == ["doc_id", "text", "n_chars", "key"]
    size = {d: len(t.encode()) for d, t in texts(df)}
    for r in out.collect():
        assert len(r["text"]) == r["n_chars"] and 0 <= len(r["text"].encode()) - (size[r["doc_id"]] - want[r["doc_id"]]) <= 4


def test_extents_are_the_union_of_shared_windows():
    """extents() of contexts of a few letters, with cut edges and equal contexts, against all pairs and windows."""
    rng = np.random.default_rng(31)
    for size in (2, 3, 40, 120):
        anchor = b"ANCHOR-OF-24-BYTES------"
        rows, ids = [], []
        for _ in range(size):
            grow = lambda most: bytes(rng.choice(list(b"ab"), int(rng.integers(0, most + 1)), p=(0.95, 0.05)).tolist())
            before, after = grow(26) if rng.random() < 0.3 else grow(0) + bytes([97] * 26), grow(26) if rng.random() < 0.3 else bytes([97] * 26)
            if rng.random() < 0.4 and before:
                k = int(rng.integers(0, len(before)))
                before = before[:k] + b"z" + before[k + 1 :]
            if rng.random() < 0.4 and after:
                k = int(rng.integers(0, len(after)))
                after = after[:k] + b"y" + after[k + 1 :]
            rows.append((before[-26:], (anchor + after)[:50]))
            ids.append(int(rng.integers(0, size // 2 + 1)))
        data = np.zeros((size, suffixes.WIDE + 2), np.uint8)
        for r, (before, after) in zip(data, rows):
            r[26 - len(before) : 26], r[26 : 26 + len(after)] = np.frombuffer(before, np.uint8), np.frombuffer(after, np.uint8)
            r[76], r[77] = len(before), len(after)
        left, right = suffixes.extents(data, np.array(ids, np.int64))
        for i, (before, after) in enumerate(rows):
            want = set()
            for k in range(27):
                if k <= len(before) and 50 - k <= len(after):
                    w = before[len(before) - k :] + after[: 50 - k]
                    if any(d < ids[i] and k <= len(b) and 50 - k <= len(a) and b[len(b) - k :] + a[: 50 - k] == w for (b, a), d in zip(rows, ids)):
                        want |= set(range(-k, 50 - k))
            assert want == (set(range(-int(left[i]), int(right[i]))) if left[i] + right[i] else set())


def test_repeats_without_ids_or_rows(spark, nothing):
    long = "a passage that is more than fifty bytes long and that several rows of the table hold " * 2
    df = spark.createDataFrame([(None, long), (None, long), (4, long), (4, long), (4, long + "x"), (9, "y" + long), (2, None), (3, "  ")], "doc_id bigint, text string").withColumn("key", F.lit(1)).withColumn("spans", F.lit("s"))
    rows = texts(df)
    assert sorted(map(tuple, suffixes.repeat_report(df).collect()), key=key) == brute_repeats(rows)
    kept = suffixes.remove_repeats(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key) == sorted([(None, long), (4, long), (4, long + "x"), (9, "y")], key=key)
    assert suffixes.remove_repeats(nothing).count() == 0


def test_maximal_repeats():
    rng = np.random.default_rng(3)
    for _ in range(25):
        ts = ["".join(rng.choice(list("ab"), rng.integers(0, 25))).encode() for _ in range(3)]
        least = 3
        want = {}
        for s in {t[i:j] for t in ts for i in range(len(t)) for j in range(i + least, len(t) + 1)}:
            at = [(k, i) for k, t in enumerate(ts) for i in range(len(t) - len(s) + 1) if t[i : i + len(s)] == s]
            left = {(ts[k][i - 1],) if i else (k, "edge") for k, i in at}
            right = {(ts[k][i + len(s)],) if i + len(s) < len(ts[k]) else (k, "edge") for k, i in at}
            edge_left = any(i == 0 for _, i in at)
            if len(at) > 1 and (len(left) > 1 or edge_left) and len(right) > 1:
                want[s] = sorted(at)
        got = dict(suffixes.maximal_repeats(ts, least))
        assert got == want


# 7 -----------------------------------------------------------------------------------------------------------------------


def test_languages(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    assert len(rows) == 1000 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd).collect()}
    assert {got[i] for i in (3, 4, 5, 9)} == {"und"} and got[1] == "en"
    assert langid.identify(nothing).count() == 0


def test_bloom_filters_hold_every_gram():
    m = langid.train([("a", "abcd efgh " * 5), ("b", "ijkl mnop " * 5)], bits=12)
    assert langid.predict(m, "abcd efgh")[0] == "a" and langid.predict(m, "mnop ijkl")[0] == "b"
    many = langid.train([(f"l{i:03d}", (f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x ") * 9) for i in range(70)], bits=16)
    assert langid.predict(many, "wacx wacx")[0] == "l052"


# 8 -----------------------------------------------------------------------------------------------------------------------


def brute_classes(rows, threshold=0.8):
    sets = {}
    for d, t in rows:
        w = (t or "").lower().encode().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else None
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = [d for d in sets if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x & y) >= threshold * len(x | y):
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {d: find(d) for d in sets}


def copies(spark):
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for _ in range(12):
        base = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(int(rng.integers(30, 250)))]
        for k in range(int(rng.integers(1, 9))):
            t = list(base)
            for _ in range(k // 2):
                t[int(rng.integers(0, len(t)))] = "edited"
            rows.append((n, " ".join(t)))
            n += 1
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_near_duplicates(spark, small, odd, nothing):
    for df in (small, copies(spark)):
        got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
        assert got == brute_classes(texts(df))
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert by[2] == 1 and by[3] == 3 and by[4] == 4 and by[5] == 5 and by[8] == 8 and by[None] is None
    assert neardup.near_duplicates(nothing).count() == 0
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, i) for i in (1, 3, 4, 5, 6, 7, 8, 9, 10, 11)] + [(True, None)]


def test_chains_of_copies_are_one_class(spark):
    rng = np.random.default_rng(80)
    rows = []
    for _ in range(6):  # each text is near the next, few are near the first; some are near none
        t = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(150)]
        for _ in range(25):
            rows.append((len(rows), " ".join(t)))
            for _ in range(int(rng.choice([1, 3, 5]))):
                t[int(rng.integers(0, 150))] = "".join(rng.choice(list("abcdefgh"), 6))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for rounds in (1, 2):
        assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df, rounds=rounds).collect()} == brute_classes(rows)


def family(rng, kind, members, length):
    """Copies of one text with changes of a kind, many of them alike by about the threshold."""
    words = lambda k: ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(k)]
    base, rows = words(length), []
    for _ in range(members):
        t = list(base)
        for _ in range(int(rng.integers(0, 9))):
            at = int(rng.integers(0, len(t)))
            if kind == "replaced" or (kind == "mixed" and rng.random() < 0.5):
                t[at] = words(1)[0]
            elif kind == "cut" or (kind == "mixed" and rng.random() < 0.5):
                del t[at : at + 3]
            elif kind == "grown":
                t[at:at] = words(2)
            else:  # one of a few changes that others make as well
                t[at // 7 * 7 % len(t)] = "edited"
        rows.append(" ".join(t))
    return rows


@pytest.mark.parametrize("kind", ["replaced", "cut", "grown", "shared", "mixed"])
def test_pairs_across_classes_are_all_found(spark, kind):
    """across() against all pairs: no similar pair of a far text and a near one, or in the last round of two far ones, is missed."""
    rng = np.random.default_rng(81)
    rows = family(rng, kind, 90, 120)
    sets = [set(neardup.shingles([t])[0].tolist()) for t in rows]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    hub = 7
    members = [(0, hub, i, not (i == hub or alike(i, hub)), hub if i == hub or alike(i, hub) else 1000 + i) for i in range(len(rows))]
    table = spark.createDataFrame(members, "round int, hub bigint, node bigint, far boolean, label bigint")
    packed = spark.createDataFrame([(i, bytearray(np.sort(np.array(sorted(s), np.uint64)).tobytes())) for i, s in enumerate(sets)], "node bigint, shingles binary")
    for last in (0, 1):
        scratch = neardup.Scratch()
        got = {(r["a"], r["b"]) for r in neardup.across(table, packed, 0.8, last, scratch).collect()}
        # Pairs count as found where the pairs found connect the two, as those of texts near the reference do.
        label = {i: m[4] for i, m in enumerate(members)}

        def find(x):
            while label.get(x, x) != x:
                x = label[x]
            return x

        for i, j in got:
            if alike(i, j):
                label[find(i)] = find(j)
        far = [m[3] for m in members]
        for i in range(len(rows)):
            for j in range(i):
                if (far[i] != far[j] or (last == 0 and far[i])) and alike(i, j):
                    assert find(i) == find(j), (i, j)
        assert len(got) < len(rows) * len(rows) / 4


def test_large_families_are_whole(spark):
    rng = np.random.default_rng(83)
    rows = [(n, t) for n, t in enumerate(x for kind in ("replaced", "cut", "grown", "shared", "mixed") for x in family(rng, kind, 80, 130))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()} == brute_classes(rows)


def test_two_texts_under_one_id(spark):
    words = lambda s: " ".join(f"{s}{i}" for i in range(60))
    rows = [(5, words("a")), (5, words("b")), (7, words("a")), (8, words("b")), (3, words("b"))]
    got = sorted((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(3, 3), (5, 3), (5, 5), (7, 5), (8, 3)]


def test_copies_that_differ_by_a_repeated_line(spark):
    rng = np.random.default_rng(82)
    rows = []
    for n, line, times in [(60, 8, 50), (100, 15, 1000)] * 6:  # sets alike by 0.82 and 0.83, by numbers far less
        base, more = (["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(k)] for k in (n, line))
        for t in (base, base + more * times):
            rows.append((len(rows), " ".join(t)))
    want = brute_classes(rows)
    assert want == {d: d // 2 * 2 for d in range(24)}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()} == want


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    w = rng.random((2, 400)) * (rng.random((2, 400)) < 0.8)
    p = w / w.sum(axis=1, keepdims=True)
    on = (w > 0).all(axis=0)
    want = sum(1 / sum(max(p[0, k] / p[0, d], p[1, k] / p[1, d]) for k in range(400)) for d in np.flatnonzero(on))
    keys, weights, text = np.concatenate([h[w[i] > 0] for i in (0, 1)]), np.concatenate([w[i][w[i] > 0] for i in (0, 1)]), np.repeat([0, 1], (w > 0).sum(axis=1))
    s = neardup.prob_minhash(keys, weights, text, 2, size=4000)
    assert abs((s[0] == s[1]).mean() - want) < 0.04


# 9 -----------------------------------------------------------------------------------------------------------------------


def check_packing(rows, docs, size):
    want = {}
    for d, t in docs:
        ids = [*bpe(t), 1]
        for k in range(0, len(ids), size):
            want.setdefault((d, k // size), []).append((k, len(ids[k : k + size]), zlib.crc32(np.array(ids[k : k + size], "<u4").tobytes())))
    got, places = {}, defaultdict(list)
    for r in rows:
        got.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= size
    return len(places), sum(n for own in places.values() for _, n in own)


@pytest.mark.parametrize("rows_a_partition", [40_000, 30])
def test_packing(small, odd, nothing, rows_a_partition):
    n, total = check_packing(packing.pack_documents(small, rows_a_partition=rows_a_partition).collect(), texts(small), 4096)
    assert n <= -(-total // 4096) + (1 if rows_a_partition > 100 else 8)
    check_packing(packing.pack_documents(odd, size=64).collect(), texts(odd), 64)
    assert packing.pack_documents(nothing).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(6)
    for _ in range(60):
        x = rng.integers(1, 101, rng.integers(1, 40))
        bins, offsets, fill = packing.best_fit_decreasing(x, 100)
        assert packing.lower_bound(x, 100) <= len(fill) and max(fill) <= 100
        assert (np.bincount(bins, weights=x) == fill).all()
    assert packing.lower_bound(np.array([51] * 9), 100) == 9 and packing.lower_bound(np.array([34] * 9), 100) == 5


# 10 ----------------------------------------------------------------------------------------------------------------------


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if win[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")) if w else 0, len(lines) - len(set(lines)), len(cover)


def test_quality_counts_and_verdicts(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (docs, odd):
        want = Counter((d, *brute_counts(t)) for d, t in texts(df))
        got = quality.quality_report(df).collect()
        assert Counter(tuple(r[:6]) for r in got) == want
        for r in got:
            failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
            assert r["base_failed"] == failed and r["kept"] == (not failed and r["p_good"] >= 0.5)
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_report(docs).collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    base = {d: brute_counts(t)[0] >= 20 and 100 * brute_counts(t)[4] <= 30 * brute_counts(t)[0] for d, t in texts(docs)}
    good = [r["doc_id"] for r in labels if r["quality"] == 1 and base[r["doc_id"]]]
    bad = [r["doc_id"] for r in labels if r["quality"] == 0]
    assert sum(kept[d] for d in good) >= 0.99 * len(good) and sum(kept[d] for d in bad) <= 0.1 * len(bad)
    left = quality.quality_filter(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} <= {1, 2, 6, 10}
    assert quality.quality_report(nothing).count() == 0 and quality.quality_filter(nothing).count() == 0


# Pipeline ----------------------------------------------------------------------------------------------------------------


def plain_em(rows, steps=200):
    """EM of two classes and independent rules, document by document, without tables of patterns."""
    good, rate = 0.8, [[[0.3, 0.1, 0.6] for _ in rows[0]], [[0.005, 0.095, 0.9] for _ in rows[0]]]
    for _ in range(steps):
        post = []
        for r in rows:
            p = [1 - good, good]
            for i, v in enumerate(r):
                p = [p[k] * rate[k][i][v + 1] for k in (0, 1)]
            post.append(p[1] / (p[0] + p[1]))
        for k in (0, 1):
            for i in range(len(rows[0])):
                s = [(0.3, 0.1, 0.6)[v] if k == 0 else (0.005, 0.095, 0.9)[v] for v in range(3)]
                for r, p in zip(rows, post):
                    s[r[i] + 1] += p if k else 1 - p
                rate[k][i] = [x / sum(s) for x in s]
        good = min(0.99, max(0.05, sum(post) / len(post)))
    return good, rate


def test_em_against_a_plain_one_and_known_rates():
    rng = np.random.default_rng(10)
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6])  # how often a rule votes as it should; it abstains one time in five
    truth = rng.random(600) < 0.7
    votes = np.where(rng.random((600, 5)) < 0.2, 0, np.where((rng.random((600, 5)) < right) == truth[:, None], 1, -1))
    patterns, at, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, table = quality.fit_em(patterns, n.astype(float))
    good, rate = plain_em(votes.tolist())
    assert prior == pytest.approx(good, abs=1e-4) and np.allclose(table, np.array(rate), atol=1e-3)
    verdict = quality.posterior(patterns, prior, table)[at.ravel()] >= 0.5
    every = (votes >= 0).all(axis=1)  # all must pass
    assert abs(prior - truth.mean()) < 0.08 and (verdict == truth).mean() > 0.9 > (every == truth).mean()


def test_verdicts_on_labels_beside_all_must_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality.quality_report(docs).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good, bad = [r for r in rows if labels[r["doc_id"]] == 1], [r for r in rows if labels[r["doc_id"]] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good) and sum(r["kept"] for r in bad) <= 0.02 * len(bad)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, SF), name)
        rows = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and rows and {r["doc_id"] for r in rows} <= set(before)
        if name == "near_dedup":
            assert {d: c for d, c in brute_classes([(r["doc_id"], r["text"]) for r in rows]).items() if d != c} == {}
        before = {r["doc_id"]: r for r in rows}
    check_packing(corpus_pipeline.run(spark, SF).collect(), texts(docs), 4096)
