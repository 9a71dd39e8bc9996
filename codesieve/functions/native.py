"""Column expressions: everything here stays in the JVM (whole-stage code generation), nothing shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that define what counts as an indicator or a printable run.
PRINTABLE = r"[\x20-\x7E]{4,}"
WORDS = r"(\btoken\b|grabber|stealer|steal|webhook|passwords|chrome|\bopera\b|opera gx|\bedge\b|brave|firefox|ipify|leveldb|appdata|localappdata|local storage|index.js|desktop-core|discord|discordcanary|discordptb|logger)"
URLS = r"(http|https|ftp)\://([a-zA-Z0-9\-\.]+\.+[a-zA-Z]{2,3})(:[a-zA-Z0-9]*)?/?([a-zA-Z0-9\-\._\?\,\'/\\\+&amp;%\$#\=~@]*)"
IPS = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
# Letters that look like ASCII ones, and those.
LOOKALIKES = "АВСЕНІКМОРЅТХҮасеіјорѕхуΑΒΕΖΗΙΚΜΝΟΡΤΥΧονα"
LATIN = "ABCEHIKMOPSTXYaceijopsxyABEZHIKMNOPTYXova"


def hashes(content: Column) -> dict[str, Column]:
    """md5, sha1 and sha256 of bytes or text."""
    b = content.cast("binary")
    return {"md5": F.md5(b), "sha1": F.sha1(b), "sha256": F.sha2(b, 256)}


def printable_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRINTABLE), F.lit(0))


def indicators(text: Column) -> Column:
    """Suspicious words, URLs and addresses, each in order with repeats."""
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    return F.struct(found("(?U)" + WORDS).alias("sus words"), found(URLS).alias("urls"), found("(?U)" + IPS).alias("ips"))


def lines(text: Column) -> Column:
    """Lines as a Python reader splits them; a final line break adds none."""
    return F.split(F.regexp_replace(text, r"(\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ])\z", ""), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]")


def max_line_length(text: Column) -> Column:
    return F.array_max(F.transform(lines(text), F.length))


def import_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: x.rlike(r"(?U)^\s*(import|from)\s+\w")))


def low_import_bonus(text: Column) -> Column:
    """1.0 or 0.5 for files of 300 lines and more with at most one or three imports."""
    n = import_lines(text)
    return F.when(F.size(lines(text)) < 300, 0.0).when(n <= 1, 1.0).when(n <= 3, 0.5).otherwise(0.0)


def version(text: Column) -> Column:
    """Numbers of a version as an array, comparable with <; (0, 0, 0) if any part is no number."""
    plain = F.regexp_replace(F.trim(text), "^[vV]+", "")
    parts = F.transform(F.split(F.element_at(F.split(plain, "-"), 1), r"\."), lambda x: x.try_cast("int"))
    bad = F.exists(parts, lambda x: x.isNull())
    return F.when(text.isNull() | bad, F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(parts)


def is_newer(local: Column, remote: Column) -> Column:
    return version(remote) > version(local)


def human_size(n: Column) -> Column:
    unit = lambda d, u: F.format_string(f"%.1f{u}", n / d)
    return F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1024, " KB")).when(n < 1024**3, unit(1024**2, " MB")).otherwise(unit(1024**3, " GB"))


def release_sha256(body: Column) -> Column:
    """The digest on the first line of release notes that begins with sha256:, or null."""
    return F.nullif(F.trim(F.regexp_extract(body, r"(?im)^\s*sha256:([^\r\n]*)$", 1)), F.lit(""))


def integrity(expected: Column, actual: Column) -> Column:
    """ok, mismatch or missing; an empty expectation is ok; letter case does not matter."""
    return F.when(F.coalesce(expected, F.lit("")) == "", "ok").when(actual.isNull(), "missing").when(F.lower(expected) == F.lower(actual), "ok").otherwise("mismatch")


def plural_form(lang: Column, n: Column) -> Column:
    """The form of a counted phrase: six in Arabic, two elsewhere."""
    r = F.pmod(n, F.lit(100))
    arabic = F.when(n == 0, "zero").when(n == 1, "one").when(n == 2, "two").when(r.between(3, 10), "few").when(r.between(11, 99), "many").otherwise("other")
    return F.when(lang == "ar", arabic).otherwise(F.when(n == 1, "one").otherwise("other"))


def fill(template: Column, **values: Column) -> Column:
    """Puts values in place of {name}."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def latin(text: Column) -> Column:
    return F.translate(text, LOOKALIKES, LATIN)


def percent(*texts: Column) -> Column:
    """The first value that is there, without %, as a number; 0 if it is none."""
    return F.coalesce(F.replace(F.coalesce(*texts), F.lit("%"), F.lit("")).try_cast("double"), F.lit(0.0))


def safe_member(name: Column) -> Column:
    """Does an archive member's name stay below its folder?"""
    return ~(name.rlike(r"^[/\\]|^[A-Za-z]:") | F.exists(F.split(name, r"[/\\]"), lambda x: x == ".."))


def code_fence(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?s)```(?:python)?\s*(.*?)\s*```", 1)), F.lit(""))


# Decoding kernels: what a decoder does to the literal that it finds.
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rot13(text: Column) -> Column:
    turn = lambda s: s[13:] + s[:13]
    return F.translate(text, LOWER + UPPER, turn(LOWER) + turn(UPPER))


def from_base64(text: Column) -> Column:
    return F.try_to_binary(text, F.lit("base64")).cast("string")


def from_hex(text: Column) -> Column:
    return F.unhex(text).cast("string")


def from_codes(codes: Column) -> Column:
    """Text of an array of character codes up to 255; null beyond."""
    return F.when(F.forall(codes, lambda x: x.between(0, 255)), F.array_join(F.transform(codes, F.chr), ""))


def xor_codes(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
