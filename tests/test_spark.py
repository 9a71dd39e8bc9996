"""Expressions, UDFs, sources and the stream, on small inputs; queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from codesieve.functions import native as N
from codesieve.operators import archive, detect, normalize
from codesieve.plans.reference_queries import ORACLE, QUERIES
from codesieve.sources import files
from codesieve.streaming import behaviour

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def one(row):
    return tuple(None if x is None or x != x else int(x) if isinstance(x, float) and x == int(x) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_is_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = [one(r[c] for c in order) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted((one(r) for r in db.sql(f"select {', '.join(order)} from ({ORACLE[name]})").fetchall()), key=repr)


def test_native(spark):
    assert value(spark, N.version(F.lit("v1.2.x"))) == [0, 0, 0] and value(spark, N.version(F.lit("V3.1-rc"))) == [3, 1]
    assert value(spark, N.release_sha256(F.lit("notes\nSHA256: ab12\n"))) == "ab12" and value(spark, N.human_size(F.lit(5 << 20))) == "5.0 MB"
    assert [value(spark, N.safe_member(F.lit(x))) for x in ("a/b", "../b", "/etc", "C:\\x", "a/..b")] == [True, False, False, False, True]
    assert value(spark, N.latin(F.lit("раss"))) == "pass" and value(spark, N.code_fence(F.lit("x ```python\na\n``` y"))) == "a"
    assert value(spark, N.from_base64(F.lit("?"))) is None and value(spark, detect.eval_depth(F.lit("eval(exec(eval(1)))"))) == 3


def test_packer(spark):
    assert value(spark, detect.packer(F.lit(bytearray(b"..NUITKA_ONEFILE_PARENT")))) == "nuitka" and value(spark, detect.packer(F.lit(bytearray(b"")))) == "unsupported packer"


def test_normalize(spark):
    rows = [(1, "a1 = chr(72) + chr(105)\nexec('print(a1)')\nif 1 == 1:\n    x = eval(marshal.loads(y))"), (2, None), (3, "not python ("), (4, "")]
    got = {r["id"]: r for r in normalize.normalize(spark.createDataFrame(rows, "id int, source string")).collect()}
    assert got[1]["result"]["cleaned"].startswith("number = 'Hi'") or "'Hi'" in got[1]["result"]["cleaned"]
    assert got[1]["triage"]["route"] == "llm_rename" and got[2]["result"] is None and got[3]["result"]["cleaned"] == "not python (" and got[4]["result"]["validation"]["valid"]


def test_archive_table(spark):
    from tests.test_rewrite import packed

    spark.udtf.register("archive_toc", archive.ArchiveToc)
    spark.createDataFrame([(1, bytearray(packed(True))), (2, None), (3, bytearray(b"x"))], "id int, content binary").createOrReplaceTempView("samples")
    got = spark.sql("SELECT s.id, t.name, t.python_version FROM samples s, LATERAL archive_toc(s.content) t").collect()
    assert [tuple(r) for r in got] == [(1, "script", "3.11")]


def test_sources_and_manifest(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = 1 \xff")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.txt").write_bytes(b"y")
    got = files.samples(spark, f"file://{tmp_path}", glob="*.py").collect()
    assert len(got) == 1 and got[0]["text"] == "x = 1 �"
    m = files.manifest(files.samples(spark, f"file://{tmp_path}"))
    assert {r["status"] for r in files.check_manifest(m, m).collect()} == {"ok"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.txt").write_text('File Created: C:\\x\nThe Process sent "12" bytes of data to: 1.2.3.4\n???\n')
    q = behaviour.stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("behaviour").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["kind"], r["argument"], r["n_bytes"]) for r in spark.table("behaviour").collect()) == [("data_moved", "1.2.3.4", 12), ("file_created", "C:\\x", None), ("other", None, None)]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql()) and e.entry(spark).count() == 200
