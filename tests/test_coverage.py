"""What SQL does not state: archives, resources and sinks, releases and locales on odd rows, raw texts."""

import struct
import zlib

from pyspark.sql import functions as F

from codesieve.functions import catalog
from codesieve.operators import analyze, archive, detect, normalize


def test_resource_and_script():
    assert analyze.resource(b"") is None and analyze.resource(b"MZ" + b"\0" * 100) is None
    assert analyze.py2exe_script(b"\0" * 20) is None
    script = struct.pack("<4i", analyze.PY2EXE_MAGIC, 1, 0, 3) + b"lib.zip\0abcmore"
    assert analyze.py2exe_script(script) == (1, 0, "lib.zip", b"abc")


def test_compiled_code_headers():
    assert analyze.parse_pyc(struct.pack("<H2sIII", 3413, b"\r\n", 1, 7, 9)) == (3413, "3.8", 16, True, None, None)
    assert analyze.parse_pyc(struct.pack("<H2sI", 62211, b"\r\n", 5)) == (62211, "2.7", 8, False, 5, None)
    assert analyze.parse_pyc(b"\x55\x0d\r\n") is None and analyze.parse_pyc(b"#!/bin/sh") is None
    assert analyze.python_of(3000) is None and analyze.python_of(3400) == "3.7"


def test_module_bodies():
    bodies = [b"first", b"second" * 100]
    data = b"PYZ\0" + b"\x55\x0d\r\n" + struct.pack("!i", 12 + sum(len(zlib.compress(b)) for b in bodies)) + b"".join(map(zlib.compress, bodies)) + b"table"
    assert analyze.module_names(data) == ("550d0d0a", bodies)
    assert analyze.module_names(b"none") is None


def test_a_large_entry_comes_whole_and_a_cut_one_not():
    body = b"x" * (3 << 20)
    assert archive.member(zlib.compress(body), 0, len(zlib.compress(body)), 1) == body
    assert archive.member(body, 0, len(body), 0) == body
    assert archive.member(body[:-1], 0, len(body), 0) is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d/a.py", "x = 1"), ("../b", None)], "path string, cleaned string")
    for beside, want in ((False, ["a-cleaned.py", "b-cleaned.py"]), (True, ["../b-cleaned.py", "d/a-cleaned.py"])):
        out = f"file://{tmp_path}/cleaned-{beside}"
        analyze.write_cleaned(df, out, beside=beside)
        assert sorted(r["file"] for r in spark.read.parquet(out).collect()) == want
    analyze.write_checksums(spark.createDataFrame([("b", "2"), ("a", "1")], "rel_path string, sha256 string"), f"file://{tmp_path}/sums")
    assert [r["rel_path"] for r in spark.read.json(f"file://{tmp_path}/sums").collect()] == ["a", "b"]
    analyze.write_entries(spark.createDataFrame([("p", bytearray(b"no archive")), ("q", None)], "path string, content binary"), f"file://{tmp_path}/entries")
    assert spark.read.parquet(f"file://{tmp_path}/entries").count() == 0


def test_releases_and_locales_on_odd_rows(spark):
    r = spark.createDataFrame([("a", "v2", True, 1), ("a", "v1", False, 2), ("b", "v9", False, 1)], "repo string, tag string, prerelease boolean, position int")
    pick = lambda c: {x["repo"]: x["tag"] for x in catalog.release_for(r, c, "repo").collect()}
    assert pick("stable") == {"a": "v1", "b": "v9"} and pick("beta") == {"a": "v2", "b": "v9"} and pick("dev") == {"a": "v2", "b": "v9"}
    assert catalog.release_for(r.filter("false"), "stable", "repo").count() == 0
    rows = catalog.json_rows(spark.createDataFrame([('{"a": 1}',), ("broken",), (None,)], "j string"), "j", "a int").collect()
    assert [x["a"] for x in rows] == [1, None, None]


def test_contents_of_updates_are_made_once_a_size(spark, tmp_path):
    """100,000 contents of up to 25 MB are 689 GB if each row makes its own; jobs are cancelled after a minute."""
    import threading

    import duckdb

    from __spark_entry__ import oracle_sql, queries

    db = duckdb.connect()
    db.sql("create view part as select range as p_partkey, [50, 1, 20, 21, 0, -3, null][range % 7 + 1]::int as p_size from range(100000)")
    db.sql(f"copy part to '{tmp_path}/part.parquet'")
    sized = lambda r: r if r[0] % 7 < 6 else (r[0], *r[3:])  # noqa: E731  SQL decides without a size, the operators do not
    limit = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    limit.start()
    try:
        got = queries()["q52_updates"](spark, str(tmp_path)).collect()
    finally:
        limit.cancel()
    assert sorted(map(sized, map(tuple, got))) == sorted(map(sized, db.sql(oracle_sql()["q52_updates"]).fetchall()))


def test_predicates_on_odd_texts(spark):
    df = spark.createDataFrame([("def f(a): return a", "x = 1"), ("def (", "x ="), (None, None)], "s string, t string")
    got = df.select(normalize.accepts_udf("s", "s").alias("a"), normalize.safe_block_udf("t").alias("b"), normalize.machine_classes_udf("s").alias("m"), normalize.decode_text_udf("t").alias("d"), detect.detect_by(F.col("s")).alias("e")).collect()
    assert [tuple(r) for r in got] == [(True, True, [], "x = 1", None), (False, False, [], "x =", None), (None, None, None, None, None)]


def test_analysis_of_odd_samples(spark):
    df = spark.createDataFrame([("a.pyc", bytearray(b"")), ("b", None), ("c", bytearray(b"\xff\xfe http://a.bc token"))], "path string, content binary")
    out = {r["path"]: r for r in analyze.analyze(df).collect()}
    assert out["a.pyc"]["is_pyc"] and out["a.pyc"]["n_entries"] == 0 and out["b"]["n_entries"] is None and not out["b"]["is_pyc"]
    assert "http://a.bc" in out["c"]["indicators"] and out["c"]["hashes"]["md5"]


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(o) >= 100; print('listed')"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/", 2)[0])
    assert "listed" in done.stdout, done.stderr[-500:]
