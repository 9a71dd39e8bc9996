"""Queries over the driver's tables, and what DuckDB says they return.

Programs are made from columns, so that SQL can state what the rewritten program must be.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import native as N
from ..operators import detect, normalize
from ..streaming import behaviour

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _spread(df):
    """Deals rows out evenly before work that costs far more than moving them: a small file is one task otherwise."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def q01_file_hashes(spark, d):
    return _t(spark, d, "documents").select("doc_id", *(c.alias(k) for k, c in N.hashes(F.col("text")).items()))


@query("SELECT page_id, len(x) AS n_runs, md5(array_to_string(x, chr(10))) AS runs_md5 FROM (SELECT page_id, regexp_extract_all(html, '[\\x20-\\x7E]{4,}') AS x FROM pages)")
def q02_printable_strings(spark, d):
    runs = N.printable_runs(F.col("html"))
    return _t(spark, d, "pages").select("page_id", F.size(runs).cast("bigint").alias("n_runs"), F.md5(F.array_join(runs, "\n").cast("binary")).alias("runs_md5"))


_SQL = lambda p: p.replace("'", "''")


@query(
    f"SELECT page_id, array_to_string(regexp_extract_all(t, '{_SQL(N.URLS)}'), ' ') AS urls, array_to_string(regexp_extract_all(t, '{_SQL(N.IPS)}'), ' ') AS ips, "
    f"array_to_string(regexp_extract_all(t, '{_SQL(N.WORDS)}'), ' ') AS words FROM (SELECT page_id, concat('steal ', url, ' from 10.0.', page_id % 256, '.7 ', html) AS t FROM pages)"
)
def q03_indicators(spark, d):
    text = F.concat(F.lit("steal "), F.col("url"), F.lit(" from 10.0."), (F.col("page_id") % 256).cast("string"), F.lit(".7 "), F.col("html"))
    i = N.indicators(text)
    join = lambda x: F.array_join(x, " ")
    return _t(spark, d, "pages").select("page_id", join(i["urls"]).alias("urls"), join(i["ips"]).alias("ips"), join(i["sus words"]).alias("words"))


@query("SELECT doc_id, CAST(list_max(list_transform(x, lambda s: length(s))) AS INT) AS longest, CAST(len(x) AS INT) AS n_lines FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS x FROM documents)")
def q04_line_metrics(spark, d):
    return _t(spark, d, "documents").select("doc_id", N.max_line_length(F.col("text")).alias("longest"), F.size(N.lines(F.col("text"))).alias("n_lines"))


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM documents")
def q05_manifest(spark, d):
    from ..sources.files import check_manifest

    docs = _t(spark, d, "documents")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    expected = docs.select(F.col("doc_id").alias("rel_path"), F.upper(sha(F.col("text"))).alias("sha256"))
    there = docs.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("rel_path"), sha(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("sha256"))
    return check_manifest(expected, there).withColumnRenamed("rel_path", "doc_id")


@query("SELECT p_partkey, (p_size > 25 OR (p_size = 25 AND p_partkey % 10 > 5)) AS newer FROM part")
def q06_versions(spark, d):
    remote = F.format_string("v1.%d.%d-beta", F.col("p_size"), F.col("p_partkey") % 10)
    return _t(spark, d, "part").select("p_partkey", N.is_newer(F.lit("V1.25.5"), remote).alias("newer"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN n = 0 THEN 'zero' WHEN n = 1 THEN 'one' WHEN n = 2 THEN 'two' WHEN n % 100 BETWEEN 3 AND 10 THEN 'few' WHEN n % 100 BETWEEN 11 AND 99 THEN 'many' ELSE 'other' END AS arabic, "
    "CASE WHEN n = 1 THEN 'one' ELSE 'other' END AS english FROM (SELECT l_orderkey, l_linenumber, l_partkey % 210 AS n FROM lineitem)"
)
def q07_plurals(spark, d):
    n = F.col("l_partkey") % 210
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.plural_form(F.lit("ar"), n).alias("arabic"), N.plural_form(F.lit("en"), n).alias("english"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN upper(n_name) WHEN n_nationkey % 3 = 1 THEN n_name ELSE 'nation.' || n_nationkey END AS label FROM nation")
def q08_locale_fallback(spark, d):
    nation = _t(spark, d, "nation")
    keyed = nation.withColumn("key", F.concat(F.lit("nation."), F.col("n_nationkey").cast("string")))
    current = keyed.select("key", F.when(F.col("n_nationkey") % 3 == 0, F.upper("n_name")).otherwise("").alias("v"))
    english = keyed.filter("n_nationkey % 3 <> 2").select("key", F.col("n_name").alias("w"))
    return keyed.join(current, "key", "left").join(english, "key", "left").select("n_nationkey", F.coalesce(F.nullif("v", F.lit("")), "w", "key").alias("label"))


_MARKERS = ["# pyobfuscate", 'exec("".join([chr(len(i)) for i in d]))', "__NO_NO" * 23, "import base64,lzma;exec(compile(lzma.decompress(base64.b64decode(b'QUJD')),\"<string>\",\"exec\"))", "__obfuscator__ = 'Hyperion'", "abcd = 1;", "_ = lambda __ : __import__('zlib').decompress(__import__('base64').b64decode(__[::-1]));exec((_)", "trust", "-"]
_NAMES = [n for n, _ in detect.DETECTORS] + [None]


@query("SELECT doc_id, CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN {repr(n) if n else 'NULL'}" for i, n in enumerate(_NAMES)) + " END AS engine FROM documents")
def q09_detectors(spark, d):
    text = F.element_at(F.array(*map(F.lit, _MARKERS)), (F.col("doc_id") % 9 + 1).cast("int"))
    return _t(spark, d, "documents").select("doc_id", detect.detect(text).alias("engine"))


_SAMPLE = "concat('import os\\nvalue = ', {k}, '\\n', CASE {k} % 6 WHEN 0 THEN 'exec(base64.b64decode(data))' WHEN 1 THEN 'x1 = chr(65) + chr(66)' WHEN 2 THEN 'while True:\\n    _state = 1' WHEN 3 THEN 'time.time() < 5' WHEN 4 THEN '__import__(name)' ELSE 'print(value)' END)"
_SCORE = " + ".join(f"CASE WHEN regexp_matches(t, '{_SQL(p)}', 's') THEN {w} ELSE 0 END" for w, p in detect.SIGNATURES.values())
_DUCK = _SAMPLE.replace("\\n", "' || chr(10) || '")


@query(f"SELECT l_orderkey, l_linenumber, round(s, 2) AS score, CASE WHEN s < 4 THEN 'static_only' WHEN s < 7 THEN 'rule_rename' ELSE 'llm_rename' END AS route FROM (SELECT l_orderkey, l_linenumber, least(10.0, CAST({_SCORE} AS DOUBLE)) AS s FROM (SELECT l_orderkey, l_linenumber, {_DUCK.format(k='l_partkey')} AS t FROM lineitem))")
def q10_triage(spark, d):
    t = _spread(_t(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", F.expr(_SAMPLE.format(k="l_partkey")).alias("t"))
    t = t.withColumn("s", detect.signature_score(F.col("t")))  # once, for score and route
    return t.select("l_orderkey", "l_linenumber", F.round("s", 2).alias("score"), detect.route(F.col("s")).alias("route"))


@query("SELECT p_partkey, p_name AS b64, p_name AS hex, p_name AS rot, p_name AS back, p_name AS codes, p_name AS xored, CAST(p_size AS BIGINT) AS number FROM part")
def q11_decode_kernels(spark, d):
    name = F.col("p_name")
    codes = F.transform(F.split(name, ""), F.ascii)
    key = F.transform(codes, lambda _: F.lit(42))
    return _t(spark, d, "part").select(
        "p_partkey", N.from_base64(F.base64(name.cast("binary"))).alias("b64"), N.from_hex(F.hex(name.cast("binary"))).alias("hex"), N.rot13(N.rot13(name)).alias("rot"), F.reverse(F.reverse(name)).alias("back"),
        N.from_codes(codes).alias("codes"), N.from_codes(N.xor_codes(N.xor_codes(codes, key), key)).alias("xored"), F.conv(F.conv("p_size", 10, 16), 16, 10).cast("bigint").alias("number"),
    )


def _program(name: str, table: str, keys: str, program: str, expected: str):
    """A query that rewrites a program made by a Spark expression, and SQL for what must come out."""

    def run(spark, d):
        return _spread(_t(spark, d, table)).select(*keys.split(", "), normalize.clean_udf(F.expr(program)).alias("cleaned"))

    run.__name__ = name
    query(f"SELECT {keys}, {expected} AS cleaned FROM {table}")(run)


_NL = " || chr(10) || "
_program("q18_base64_in_place", "nation", "n_nationkey", "concat('x = base64.b64decode(''', base64(cast(n_name as binary)), ''')')", "'x = ''' || n_name || ''''")
_program("q19_fold", "lineitem", "l_orderkey, l_linenumber", "concat('x = ', l_linenumber, ' * ', cast(l_quantity as int))", "'x = ' || (l_linenumber * CAST(l_quantity AS INT))")
_program("q20_dead_branch", "part", "p_partkey", "concat('if False:\\n    x = ', p_size, '\\nprint(', p_partkey, ')')", "'print(' || p_partkey || ')'")
_program("q21_assert_and_while", "part", "p_partkey", "concat('assert 1 < 2\\nwhile False:\\n    y = 1\\nprint(', p_size, ')')", "'print(' || p_size || ')'")
_program("q22_self_assignment", "part", "p_partkey", "concat('v = ', p_size, '\\nprint(v)\\nw = w\\nfor a in b:\\n    break\\n    c()')", f"'v = ' || p_size{_NL}'print(' || p_size || ')'{_NL}'for a in b:'{_NL}'    break'")
_program("q23_getattr", "part", "p_partkey", "concat('getattr(obj, \\'m', p_partkey, '\\')(', p_size, ')')", "'obj.m' || p_partkey || '(' || p_size || ')'")
_program("q24_lambda_call", "part", "p_partkey", "concat('r = (lambda: ', p_size, ')()\\ns = (lambda q: q)(t)\\nu = (lambda q: q + 1)(', p_size, ')')", f"'r = ' || p_size{_NL}'s = t'{_NL}'u = ' || (p_size + 1)")
_program("q25_walrus", "part", "p_partkey", "concat('(k := ', p_size, ')\\nshow(k)')", f"'k = ' || p_size{_NL}'show(' || p_size || ')'")
_program("q26_exec_literal", "part", "p_partkey", "concat('exec(\\'a = eval(\"', p_size, ' + 1\")\\')')", "'a = ' || (p_size + 1)")
_program(
    "q27_state_machine", "part", "p_partkey",
    "concat('s = 3\\nwhile s != 0:\\n    match s:\\n        case 1:\\n            b(', p_partkey, ')\\n            s = 0\\n        case 3:\\n            a(', p_size, ')\\n            s -= 2\\nt = 7\\nwhile True:\\n    if t == 9:\\n        d()\\n        break\\n    elif t == 7:\\n        c()\\n        t += 2')",
    f"'a(' || p_size || ')'{_NL}'b(' || p_partkey || ')'{_NL}'c()'{_NL}'d()'",
)
_program("q32_chr_join_xor", "part", "p_partkey", "concat('s = \\'\\'.join([chr(c ^ 1) for c in [', p_size + 64, ', 64]])\\nt = chr(65) + chr(', 64 + p_size % 26, ')')", f"'s = ''' || CASE WHEN xor(p_size + 64, 1) = 92 THEN chr(92) || chr(92) ELSE chr(xor(p_size + 64, 1)) END || 'A'''{_NL}'t = ''A' || chr(64 + p_size % 26) || ''''")
_program("q33_proxy_alias", "part", "p_partkey", "concat('p = print\\np(', p_partkey, ')\\ndef f():\\n    return ', p_size, '\\np(f())')", f"'p = print'{_NL}'print(' || p_partkey || ')'{_NL}''{_NL}'def f():'{_NL}'    return ' || p_size{_NL}'print(' || p_size || ')'")


@query("SELECT p_partkey, 'number = ' || p_size || chr(10) || 'text = ''a''' || chr(10) || 'print(number, text)' AS renamed FROM part")
def q28_rename(spark, d):
    program = F.concat(F.lit("a1 = "), F.col("p_size").cast("string"), F.lit("\nOIl1 = 'a'\nprint(a1, OIl1)"))
    return _t(spark, d, "part").select("p_partkey", normalize.rename_udf(program)["text"].alias("renamed"))


@query("SELECT p_partkey, CAST(p_size % 5 AS INT) AS functions, 1 AS imports, CAST(p_size % 5 AS INT) AS returns, 0 AS loops FROM part")
def q29_stats(spark, d):
    program = F.concat(F.lit("import os\n"), F.array_join(F.transform(F.slice(F.sequence(F.lit(0), F.lit(5)), F.lit(1), (F.col("p_size") % 5).cast("int")), lambda i: F.concat(F.lit("def f"), i.cast("string"), F.lit("():\n    return 1\n"))), ""))
    s = normalize.stats_udf(program)
    return _t(spark, d, "part").select("p_partkey", *(s[c].alias(c) for c in ("functions", "imports", "returns", "loops")))


@query()
def q30_normalize(spark, d):
    """The whole treatment; its parts are compared with SQL above, the whole with tests."""
    t = _spread(_t(spark, d, "part")).select("p_partkey", F.expr(_SAMPLE.format(k="p_partkey")).alias("source"))
    out = normalize.normalize(t)
    return out.select("p_partkey", "engine", "triage.score", "triage.route", "result.cleaned", "result.validation.valid")


@query("SELECT event_id, 'process_opened' AS kind, CAST(user_id AS VARCHAR) AS argument, CAST(NULL AS BIGINT) AS n_bytes FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'data_moved', '10.0.0.' || (user_id % 256), user_id FROM events WHERE event_id % 2 = 1")
def q31_behaviour(spark, d):
    u = F.col("user_id").cast("string")
    message = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Process handle opened to pid: "), u)).otherwise(F.concat(F.lit('The Process sent "'), u, F.lit('" bytes of data to: 10.0.0.'), (F.col("user_id") % 256).cast("string")))
    e = behaviour.parse(message)
    return _t(spark, d, "events").select("event_id", e["kind"].alias("kind"), e["argument"].alias("argument"), e["n_bytes"].alias("n_bytes"))


@query("SELECT p_partkey, CASE WHEN p_size * 100 < 1024 THEN (p_size * 100) || ' B' ELSE printf('%.1f KB', p_size * 100 / 1024.0) END AS size, 'part ' || p_partkey AS label, CAST(p_size AS DOUBLE) AS progress FROM part")
def q34_formatting(spark, d):
    return _t(spark, d, "part").select("p_partkey", N.human_size(F.col("p_size") * 100).alias("size"), N.fill(F.lit("part {k}"), k=F.col("p_partkey")).alias("label"), N.percent(F.lit(None).cast("string"), F.concat(F.col("p_size").cast("string"), F.lit("%"))).alias("progress"))


