"""Decoding of texts that do not parse: old dialects, fragments, half-broken samples.

The text is scanned once for brackets and string literals. Where an expression may begin that spells out a coded literal,
its extent is found by the brackets, the piece alone is parsed, and the constant evaluator gives its value; what it cannot
evaluate stays as it is. Nothing is executed.
"""

from __future__ import annotations

import ast
import re

from .evaluate import literal

PASSES = 10  # limit of decode passes
STRING = r"(?:[bBrRuU]{0,2})(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
TOKEN = re.compile(rf"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|{STRING}|[()\[\]{{}}]|#[^\n]*")
CALLS = r"(?:__import__\s*\(\s*['\"]\w+['\"]\s*\)|base64|binascii|zlib|lzma|bz2|codecs|bytes|bytearray|chr|int|eval|exec)\s*[.(]"
HEAD = re.compile(rf"(?<![\w.])(?:{CALLS}|{STRING}\s*(?:\.\s*(?:join|encode|decode)\s*\(|\[|(?=[ \t]*(?:\+[ \t]*)?['\"])))")
ESCAPED = re.compile(r"(?<![\w\\])(\"|')((?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4})+)\1")
NAME = re.compile(r"\s*\.?\s*[A-Za-z_]\w*")
TRAILER = re.compile(r"\s*\.\s*[A-Za-z_]\w*|[ \t]+(?=[(\[])")
PLUS = re.compile(r"[ \t]*(?:\+[ \t]*)?(?=['\"]|chr\s*\()")


def _brackets(text: str) -> tuple[dict[int, int], dict[int, int]]:
    """(end of each bracket by its place, end of each string literal by its place)."""
    close, strings, stack = {}, {}, []
    for m in TOKEN.finditer(text):
        t = m[0]
        if t in "([{":
            stack.append((t, m.start()))
        elif t in ")]}":
            if stack and stack[-1][0] + t in ("()", "[]", "{}"):
                close[stack.pop()[1]] = m.end()
            else:
                stack.clear()
        elif not t.startswith("#"):
            strings[m.start()] = m.end()
    return close, strings


def _primary(text: str, at: int, close: dict, strings: dict) -> int | None:
    """Where the name or literal at ``at`` ends, with its attributes, calls and subscripts."""
    if at in strings:
        at = strings[at]
    else:
        m = NAME.match(text, at)
        if m is None:
            return None
        at = m.end()
    while at < len(text):
        if text[at] in "([":
            if at not in close:
                return None
            at = close[at]
            continue
        m = TRAILER.match(text, at)
        if m is None:
            return at
        at = m.end()
    return at


def _value(piece: str) -> str | None:
    """What a piece of text is replaced by, or None."""
    try:
        node = ast.parse(piece.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    if isinstance(node, ast.Constant):  # literals side by side are one
        return repr(node.value) if isinstance(node.value, str) and len(re.findall(STRING, piece)) > 1 else None
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("eval", "exec"):
        inner = node.args[0] if len(node.args) == 1 and not node.keywords else None
        value = inner.value if isinstance(inner, ast.Constant) else None
        return value if isinstance(value, str) else value.decode("utf-8", "replace") if isinstance(value, bytes) else None
    got = literal(node)
    if got is None or not isinstance(got.value, (str, bytes, int)):
        return None
    value = got.value
    if isinstance(value, bytes):
        value = value.decode("utf-8", "replace")
    return repr(value) if not isinstance(value, str) or value.isprintable() or value.isascii() else None


def _pass(text: str) -> str:
    close, strings = _brackets(text)
    inside = sorted(strings.items())
    out, done, k = [], 0, 0
    for m in HEAD.finditer(text):
        at = m.start()
        if at < done:
            continue
        while k < len(inside) and inside[k][1] <= at:
            k += 1
        if k < len(inside) and inside[k][0] < at:  # within a literal
            continue
        ends, end = [], _primary(text, at, close, strings)
        while end is not None:
            ends.append(end)
            more = PLUS.match(text, end)
            end = _primary(text, more.end(), close, strings) if more and len(ends) < 100 else None  # longer chains take further passes
        for end in (ends[-1], ends[0]) if len(ends) > 1 else ends:
            new = _value(text[at:end])
            if new is not None:
                out += [text[done:at], new]
                done = end
                break
    text = "".join([*out, text[done:]])

    def plain(m: re.Match) -> str:
        value = ast.literal_eval(m[0])
        return repr(value) if value.isascii() else m[0]

    return ESCAPED.sub(plain, text)


def decode_text(text: str, passes: int = PASSES) -> str:
    """The text with its coded literals spelled out, until nothing changes."""
    for _ in range(passes):
        new = _pass(text)
        if new == text:
            break
        text = new
    return text
