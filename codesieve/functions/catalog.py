"""Native expressions over releases, locales, uploads and test results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import is_newer, version

UPLOAD_LIMIT = 10 * 1024 * 1024
# Languages written from right to left put a currency's sign last.
RIGHT_TO_LEFT = ("ar", "he", "fa", "ur")
# What an answer of the decompiling service means.
HTTP_ERRORS = {400: "bad request", 401: "not authorized", 403: "forbidden", 404: "not found", 413: "file too large", 429: "too many requests", 500: "server error", 502: "bad gateway", 503: "service unavailable", 504: "gateway timeout"}


def accepted_size(content: Column) -> Column:
    """Is a file small enough to be uploaded?"""
    return F.octet_length(content) <= UPLOAD_LIMIT


def http_error(status: Column) -> Column:
    out = F.when(status.between(200, 299), "ok")
    for code, what in HTTP_ERRORS.items():
        out = out.when(status == code, what)
    return out.otherwise(F.concat(F.lit("error "), status.cast("string")))


def release_for(releases: DataFrame, channel: str, *keys: str) -> DataFrame:
    """One release (tag, prerelease, position, ...) for each group of ``keys``: stable takes the first that is no
    prerelease, beta the first prerelease, dev the first; beta takes the first of all where there is no prerelease.

    A partial aggregation: one row a group and task is shuffled.
    """
    rest = [c for c in releases.columns if c not in keys]
    row = F.struct(*rest)
    wanted = {"stable": ~F.col("prerelease"), "beta": F.col("prerelease"), "dev": F.lit(True)}[channel]
    best = F.min_by(F.when(wanted, row), F.when(wanted, F.col("position")))
    if channel == "beta":
        best = F.coalesce(best, F.min_by(row, "position"))
    return releases.groupBy(*keys).agg(best.alias("r")).filter("r is not null").select(*keys, *(F.col("r")[c].alias(c) for c in rest))


def update_decision(local: Column, remote: Column, enabled: Column) -> Column:
    """off, unknown, update or current."""
    return F.when(~enabled, "off").when(remote.isNull(), "unknown").when(is_newer(local, remote), "update").otherwise("current")


def legacy_update(local: Column, remote: Column) -> Column:
    """The older check: any other version than one's own is an update; an empty answer is none."""
    plain = lambda c: F.regexp_replace(F.trim(c), "^[vV]+", "")
    return (F.coalesce(F.trim(remote), F.lit("")) != "") & (plain(local) != plain(remote))


def version_text(text: Column) -> Column:
    return F.array_join(F.transform(version(text), lambda x: x.cast("string")), ".")


def available_languages(locale: DataFrame) -> DataFrame:
    """Languages of a locale table (lang, key, value) with their number of entries that are not empty."""
    return locale.groupBy("lang").agg(F.count_if(F.coalesce("value", F.lit("")) != "").alias("n_entries"))


def translate(keys: DataFrame, locale: DataFrame, lang: str, fallback: str = "en") -> DataFrame:
    """keys (key, ...) with text: the entry of the language, else that of the fallback, else the key; empty entries count as missing."""
    own = locale.filter(F.col("lang") == lang).select("key", F.nullif("value", F.lit("")).alias("own"))
    other = locale.filter(F.col("lang") == fallback).select("key", F.nullif("value", F.lit("")).alias("other"))
    return keys.join(own, "key", "left").join(other, "key", "left").select(*keys.columns, F.coalesce("own", "other", "key").alias("text"))


def localized_number(lang: Column, value: Column, digits: int = 2) -> Column:
    """A number with its language's group and decimal marks."""
    plain = F.format_number(value, digits)
    swapped = F.translate(plain, ",.", ".,")
    spaced = F.translate(plain, ",.", " ,")
    return F.when(lang.isin("de", "es", "it", "pt", "tr", "id"), swapped).when(lang.isin("fr", "ru", "uk", "pl", "cs"), spaced).otherwise(plain)


def localized_date(lang: Column, day: Column) -> Column:
    text = lambda f: F.date_format(day, f)
    return F.when(lang == "en", text("M/d/yyyy")).when(lang.isin("de", "ru", "pl", "tr"), text("dd.MM.yyyy")).when(lang.isin("fr", "es", "it", "pt", "ar"), text("dd/MM/yyyy")).otherwise(text("yyyy-MM-dd"))


def localized_currency(lang: Column, value: Column, sign: Column) -> Column:
    """The sign comes first, but last in languages written from right to left."""
    number = localized_number(lang, value)
    return F.when(lang.isin(*RIGHT_TO_LEFT), F.concat_ws(" ", number, sign)).otherwise(F.concat(sign, number))


def json_rows(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with the fields of a JSON text column (settings, locales, changelogs); a text that is no JSON gives nulls."""
    return df.withColumn("_j", F.from_json(column, schema)).select(*df.columns, "_j.*")


def tally(results: DataFrame, *keys: str) -> DataFrame:
    """Numbers of passed and failed rows (ok) by keys; a null counts as failed."""
    ok = F.coalesce("ok", F.lit(False))
    return results.groupBy(*keys).agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))
