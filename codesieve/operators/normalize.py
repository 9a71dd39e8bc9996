"""The whole treatment of a sample as one Arrow UDF: a row in, a struct out, no shuffle; errors are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import detect
from .formats import decode
from .fragments import decode_text
from .rename import accepts, apply_candidates, is_safe_block, machine_classes, mangling, rename, stats, validate
from .rewrite import clean

VALIDATION = T.StructType([*(T.StructField(c, T.BooleanType()) for c in ("valid", "syntax_ok", "structure_ok")), T.StructField("error", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType()))])
NAMES = T.MapType(T.StringType(), T.StringType())
RESULT = T.StructType([T.StructField("cleaned", T.StringType()), T.StructField("log", T.ArrayType(T.StringType())), T.StructField("names", NAMES), T.StructField("validation", VALIDATION)])
STATS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("functions", "classes", "loops", "branches", "imports", "returns")])
RENAMED = T.StructType([T.StructField("text", T.StringType()), T.StructField("names", NAMES)])
DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("status", T.StringType())])


@F.udf(returnType=T.StringType(), useArrow=True)
def clean_udf(source):
    return None if source is None else clean(source)[0]


@F.udf(returnType=RENAMED, useArrow=True)
def rename_udf(source):
    return None if source is None else dict(zip(("text", "names"), rename(source)))


@F.udf(returnType=STATS, useArrow=True)
def stats_udf(source):
    return None if source is None else stats(source)


@F.udf(returnType=T.DoubleType(), useArrow=True)
def mangling_udf(source):
    return None if source is None else mangling(source)


@F.udf(returnType=DECODED, useArrow=True)
def decode_udf(engine, source):
    return None if source is None else dict(zip(("text", "status"), decode(engine, source)))


@F.udf(returnType=T.StringType(), useArrow=True)
def decode_text_udf(source):
    return None if source is None else decode_text(source)


@F.udf(returnType=RENAMED, useArrow=True)
def candidates_udf(source, candidates):
    return None if source is None else dict(zip(("text", "names"), apply_candidates(source, dict(candidates or {}))))


@F.udf(returnType=T.BooleanType(), useArrow=True)
def accepts_udf(original, candidate):
    return None if original is None or candidate is None else accepts(original, candidate)


@F.udf(returnType=T.BooleanType(), useArrow=True)
def safe_block_udf(source):
    return None if source is None else is_safe_block(source)


@F.udf(returnType=T.ArrayType(T.StringType()), useArrow=True)
def machine_classes_udf(source):
    return None if source is None else machine_classes(source)


@F.udf(returnType=VALIDATION, useArrow=True)
def validate_udf(original, cleaned):
    return None if original is None or cleaned is None else validate(original, cleaned)


@F.udf(returnType=RESULT, useArrow=True)
def normalize_udf(source, route, engine=None):
    if source is None:
        return None
    unwrapped, status = decode(engine, source) if engine else (None, "no_engine")
    text, log = clean(unwrapped if unwrapped else source)
    if status != "no_engine":
        log.insert(0, f"{engine}: {status}")
    names = {}
    if route in ("rule_rename", "llm_rename"):
        text, names = rename(text)
        log.append(f"renamed {len(names)}")
    return {"cleaned": text, "log": log, "names": names, "validation": validate(unwrapped if unwrapped else source, text)}


def triage(samples: DataFrame, column: str = "source") -> DataFrame:
    """samples with triage, a struct of score, flags and route: native signatures and bonuses, and the share of mangled names
    from a UDF. Each pattern is looked for once: the score is a sum over the flags."""
    text = F.col(column)
    out = samples.withColumns({"_flags": detect.flags(text), "_bonus": detect.bonuses(text), "_mangled": mangling_udf(text)})
    out = out.withColumn("_score", F.least(F.lit(10.0), detect.score_of(F.col("_flags")) + F.col("_bonus") + F.col("_mangled")))
    named = F.when(F.col("_mangled") > 0.5, F.array(F.lit("identifier_entropy"))).otherwise(F.array().cast("array<string>"))
    told = F.struct(F.round("_score", 2).alias("score"), F.concat("_flags", named).alias("flags"), detect.route(F.col("_score")).alias("route"))
    return out.withColumn("triage", told).drop("_flags", "_bonus", "_mangled", "_score")


def normalize(samples: DataFrame, column: str = "source") -> DataFrame:
    """samples with engine, triage and result (cleaned text, log, renamed identifiers, validation).

    The wrapper of a detected engine is taken off first; the two detectors that match ordinary code are left out.
    """
    text = F.col(column)
    out = triage(samples, column).withColumn("engine", detect.detect(text, strict=True))
    return out.withColumn("result", normalize_udf(text, F.col("triage.route"), F.col("engine"))).select(*samples.columns, "engine", "triage", "result")
