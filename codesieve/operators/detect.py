"""Which obfuscator made a text, how obfuscated it is, and which packer made a binary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import native

# Markers of obfuscators; the first that matches names the tool.
DETECTORS = [
    ("pyobfuscate", r"\s*pyobfuscate\s*"),
    ("PlusOBF", r"exec\(\"\"\.join\(\[chr\(len\(i\)\) for i in d\]\)\)"),
    ("wodx", r"(?:__NO_NO){23}"),
    ("BlankOBF", r"import\s*base64,\s*lzma;\s*exec\(compile\(lzma\.decompress\(base64\.b64decode\(b'([A-Za-z0-9+/=]+)'\)\)\s*,\s*\"<string>\"\s*,\s*\"exec\"\)\)"),
    ("Hyperion", r"__obfuscator__\s*=\s*[\'\"]\s*Hyperion\s*[\'\"]"),
    ("jawbreaker", r"([a-zA-Z_]\w{3})\s*=\s*([^;]+);"),
    ("freecodingtools", r"^_\s*=\s*lambda\s+__\s*:\s*__import__\('zlib'\)\.decompress\(__import__\('base64'\)\.b64decode\(__\[::-1]\)\);exec\(\(\_\)"),
    ("devtool", r"\b(magic|love|god|destiny|joy|trust)\b"),
]
# Weight and pattern of each sign of obfuscation.
SIGNATURES = {
    "eval_exec": (3.0, r"\b(eval|exec)\s*\("),
    "base64_decode": (2.0, r"base64\.b(?:64|32|85|16)decode|__import__\s*\(\s*['\"]base64"),
    "hex_strings": (1.5, r"\\x[0-9a-fA-F]{2}"),
    "chr_chains": (2.5, r"chr\s*\(\s*\d+\s*\)\s*\+\s*chr"),
    "chr_join": (2.0, r"[\"'][\"']\.join\s*\(\s*(?:map\s*\(\s*chr|chr\s*\(|\[?\s*chr)"),
    "rotated_str": (1.5, r"codecs\.decode.*rot|\.encode\(.*rot_13"),
    "compressed": (3.0, r"zlib\.decompress|lzma\.decompress|bz2\.decompress"),
    "marshal_load": (3.5, r"marshal\.loads?\s*\("),
    "bytes_fromhex": (1.5, r"bytes\.fromhex\s*\("),
    "bytearray_decode": (1.5, r"bytearray\s*\(\s*(?:b[\"']|\[)"),
    "xor_decode": (2.0, r"\bfor\s+\w+\s+in\s+\w+\s*\]\s*\)|\^\s*\d+"),
    "reversed_string": (1.0, r"[\"'].*[\"']\[::-1\]|reversed\s*\(\s*[\"']"),
    "unicode_escape": (1.5, r"\\u[0-9a-fA-F]{4}"),
    "encode_decode": (1.0, r"\.encode\s*\([^)]*\)\.decode\s*\("),
    "mangled_vars": (2.0, r"\b[OIl1]{4,}\b"),
    "short_vars": (1.5, r"\b[a-z]{1,2}\d{0,2}\s*="),
    "underscore_prefix": (1.0, r"\b_{3,}\w+\b"),
    "mixed_case_mangling": (1.0, r"\b[A-Z][a-z][A-Z][a-z][A-Z]"),
    "flow_flatten": (3.0, r"while\s+(True|1)\s*:"),
    "state_machine": (2.5, r"__state\s*=|_state\s*=\s*\d"),
    "lambda_abuse": (1.5, r"lambda\s+\w+\s*:\s*lambda"),
    "getattr_chain": (2.0, r"getattr\s*\(.*getattr"),
    "getattr_string": (1.5, r"getattr\s*\(\s*\w+\s*,\s*[\"']"),
    "dispatch_table": (2.0, r"\{\s*\d+\s*:\s*(?:lambda|\w+)\s*(?:,|\})"),
    "opaque_predicates": (1.5, r"if\s+(?:True|False|1\s*==\s*1|0\s*==\s*0|not\s+False)\s*:"),
    "bogus_try_except": (1.0, r"try\s*:[\s\S]{0,200}?except\s*:\s*pass"),
    "dynamic_import": (2.0, r"__import__\s*\(|importlib\.import_module"),
    "compile_exec": (3.0, r"compile\s*\(.*exec"),
    "code_type": (3.5, r"types\.CodeType\s*\(|code\.co_"),
    "sys_modules_hijack": (3.0, r"sys\.modules\["),
    "builtins_override": (2.5, r"__builtins__\s*=\s*\{|builtins\.__dict__"),
    "dunder_import": (2.0, r"__builtins__\[[\"']__import__"),
    "debugger_detect": (2.0, r"gettrace\s*\(\)|settrace\s*\(|ptrace"),
    "vm_detect": (1.5, r"VirtualBox|VMware|QEMU|HyperV"),
    "time_based_check": (1.5, r"time\s*\.\s*(?:time|monotonic|perf_counter)\s*\(\).*?<\s*\d"),
    "random_sleep": (1.0, r"sleep\s*\(\s*random"),
    "environment_check": (1.0, r"os\.environ\.get\s*\(\s*[\"'](?:VIRTUAL|SANDBOX|ANALYSIS)"),
    "string_split_join": (2.0, r"\"[^\"]{1,3}\"\s*\.\s*join\s*\(\s*\"[^\"]+\"\s*\.\s*split"),
    "string_format_obf": (1.5, r"\"%[sd]\"\s*%\s*(?:chr\s*\(|\w+\s*\+)"),
}
# What the read-only data of a packed binary holds.
PACKERS = [
    ("pyinstaller", [b"PyInstaller: FormatMessageW failed."]),
    ("nuitka", [b"__nuitka_version__", b"NUITKA_ONEFILE_PARENT"]),
    ("py2exe", [b"PY2EXE_VERBOSE", b"py2exe failed to activate the activation context before loading a DLL", b"py2exe failed to de-activate the activation context"]),
]


def detect(text: Column, strict: bool = False) -> Column:
    """Name of the first detector that matches, else null. strict leaves out the two that match ordinary code and words."""
    out = None
    for name, pattern in DETECTORS:
        if strict and name in ("jawbreaker", "devtool"):
            continue
        hit = text.rlike("(?U)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def _pattern(p: str) -> str:
    """With Unicode classes only where the pattern has a class that they change."""
    return ("(?msU)" if any(c in p for c in (r"\w", r"\s", r"\b", r"\d", r"\W")) else "(?ms)") + p


def flags(text: Column) -> Column:
    """Names of the signatures that occur, in the order of the table."""
    return F.array_compact(F.array(*(F.when(text.rlike(_pattern(p)), F.lit(name)) for name, (_, p) in SIGNATURES.items())))


def score_of(flags: Column) -> Column:
    """The sum of the weights of flags, up to 10."""
    weights = F.create_map(*(F.lit(x) for name, (w, _) in SIGNATURES.items() for x in (name, w)))
    return F.least(F.lit(10.0), F.aggregate(flags, F.lit(0.0), lambda s, f: s + F.coalesce(weights[f], F.lit(0.0))))


def signature_score(text: Column) -> Column:
    return score_of(flags(text))


def eval_depth(text: Column) -> Column:
    """Deepest nesting of eval/exec; each closing bracket ends one."""
    marks = F.regexp_extract_all(text, F.lit(r"eval|exec|[)\]]"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(s, m):
        now = F.when(m.isin(")", "]"), F.greatest(s["now"] - 1, F.lit(0))).otherwise(s["now"] + 1)
        return F.struct(now.alias("now"), F.greatest(s["top"], now).alias("top"))

    return F.aggregate(marks, start, step, lambda s: s["top"])


def bonuses(text: Column) -> Column:
    """For nested evaluation, long lines and few imports."""
    depth, longest = eval_depth(text), native.max_line_length(text)
    nested = F.when(depth >= 2, F.least(F.lit(2.0), depth * 0.5)).otherwise(0.0)
    wide = F.when(longest > 1000, F.least(F.lit(2.0), (longest - 1000) / 1000)).otherwise(0.0)
    return nested + wide + native.low_import_bonus(text)


def static_score(text: Column) -> Column:
    """Signatures and bonuses, up to 10."""
    return F.least(F.lit(10.0), signature_score(text) + bonuses(text))


def detect_by(name: Column) -> Column:
    """The registered spelling of an engine's name, whatever its letter case; null if there is none."""
    out = None
    for known, _ in DETECTORS:
        out = F.when(F.lower(name) == known.lower(), known) if out is None else out.when(F.lower(name) == known.lower(), known)
    return out


def route(score: Column) -> Column:
    return F.when(score < 4, "static_only").when(score < 7, "rule_rename").otherwise("llm_rename")


def packer(rdata: Column) -> Column:
    """Packer by the markers in the .rdata bytes (see archive.rdata), or "unsupported packer"."""
    out = None
    for name, markers in PACKERS:
        hit = F.lit(False)
        for m in markers:
            hit = hit | F.contains(rdata, F.lit(bytearray(m)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unsupported packer")
