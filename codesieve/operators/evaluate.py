"""A pure, budgeted evaluator of constant expressions. Nothing of a sample is ever executed: only the nodes, functions
and methods listed here are interpreted, over values that the expression itself spells out."""

from __future__ import annotations

import ast
import base64
import binascii
import bz2
import codecs
import lzma
import operator
import zlib

MOST = 1 << 20  # characters, bytes or elements of any value
STEPS = 20_000


class Unknown(Exception):
    """The expression is not constant, or costs more than its budget."""


class TooLarge(Unknown):
    """A value beyond the limit of its size."""


def inflate(data: bytes, machine, most: int = MOST) -> bytes:
    """All that the data holds; TooLarge beyond ``most`` bytes."""
    out = machine.decompress(data, most + 1)
    if len(out) > most:
        raise TooLarge("too large")
    return out


def _power(a, b):
    if isinstance(a, int) and isinstance(b, int) and (abs(b) > 4096 or a.bit_length() * abs(b) > 8192):
        raise Unknown("too large")
    return a**b


def _shift(a, b):
    if b > 4096:
        raise Unknown("too large")
    return a << b


def _times(a, b):
    for x, n in ((a, b), (b, a)):
        if isinstance(x, (str, bytes, list, tuple)) and isinstance(n, int) and len(x) * max(n, 0) > 4096:
            raise Unknown("too large")
    return a * b


BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: _times, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod,
    ast.Pow: _power, ast.LShift: _shift, ast.RShift: operator.rshift, ast.BitOr: operator.or_, ast.BitXor: operator.xor, ast.BitAnd: operator.and_,
}
COMPARE = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
    ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b, ast.Is: lambda a, b: a is b, ast.IsNot: lambda a, b: a is not b,
}
UNARY = {ast.USub: operator.neg, ast.UAdd: operator.pos, ast.Invert: operator.invert, ast.Not: operator.not_}


def _range(*a):
    r = range(*a)
    if len(r) > STEPS:
        raise Unknown("too long")
    return list(r)


def _decode(data, codec="utf-8", errors="strict"):
    name = codec.lower().replace("-", "_")
    if name in ("rot13", "rot_13"):
        return codecs.decode(data, "rot13")
    if name in ("hex", "hex_codec"):
        return binascii.unhexlify(data)
    if name in ("utf_8", "utf8", "ascii", "latin_1", "latin1", "unicode_escape", "utf_16", "utf_32", "cp1252"):
        return codecs.decode(data, name, errors)
    raise Unknown(codec)


FUNCTIONS = {
    "chr": chr, "ord": ord, "len": len, "int": int, "str": str, "bytes": bytes, "bytearray": lambda *a: bytes(*a), "bool": bool, "float": float, "abs": abs, "list": list, "tuple": tuple,
    "min": min, "max": max, "sum": sum, "sorted": sorted, "hex": hex, "oct": oct, "bin": bin, "repr": repr, "range": _range, "reversed": lambda x: list(x)[::-1], "zip": lambda *a: list(zip(*a)), "enumerate": lambda *a: list(enumerate(*a)),
    "base64.b64decode": base64.b64decode, "base64.b32decode": base64.b32decode, "base64.b16decode": base64.b16decode, "base64.b85decode": base64.b85decode, "base64.a85decode": base64.a85decode,
    "base64.urlsafe_b64decode": base64.urlsafe_b64decode, "binascii.unhexlify": binascii.unhexlify, "bytes.fromhex": bytes.fromhex, "bytearray.fromhex": bytes.fromhex, "codecs.decode": _decode,
    "zlib.decompress": lambda b: inflate(b, zlib.decompressobj()), "bz2.decompress": lambda b: inflate(b, bz2.BZ2Decompressor()), "lzma.decompress": lambda b: inflate(b, lzma.LZMADecompressor()),
}
METHODS = {
    str: {"join", "lower", "upper", "strip", "lstrip", "rstrip", "replace", "split", "encode", "title", "swapcase", "startswith", "endswith", "find", "count", "isdigit", "isalpha", "capitalize"},
    bytes: {"decode", "hex", "join", "replace", "split", "strip", "lower", "upper"},
}
#: Calls whose bytes result stands for text.
TEXTUAL = {n for n in FUNCTIONS if "." in n} | {"bytes", "bytearray"}


def dotted(node: ast.AST) -> str | None:
    """a.b.c of a chain of names; __import__('a').b counts as a.b."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = dotted(node.value)
        return f"{base}.{node.attr}" if base else None
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "__import__" and len(node.args) == 1 and isinstance(node.args[0], ast.Constant):
        return str(node.args[0].value)
    return None


class Evaluator:
    def __init__(self):
        self.steps = 0

    def run(self, n: ast.AST, names: dict | None = None):
        """The value of n, or Unknown."""
        names = names or {}
        self.steps += 1
        if self.steps > STEPS:
            raise Unknown("too many steps")
        go = lambda x: self.run(x, names)
        match n:
            case ast.Constant():
                out = n.value
            case ast.Name() if n.id in names:
                out = names[n.id]
            case ast.List() | ast.Tuple():
                out = [go(x) for x in n.elts]
                out = tuple(out) if isinstance(n, ast.Tuple) else out
            case ast.Dict() if None not in n.keys:
                out = {go(k): go(v) for k, v in zip(n.keys, n.values)}
            case ast.BinOp() if type(n.op) in BINARY:
                left, right = go(n.left), go(n.right)
                if isinstance(n.op, ast.Mod) and isinstance(left, (str, bytes)) and any(ch.isdigit() or ch == "*" for ch in str(left)):
                    raise Unknown("a width could be large")
                out = BINARY[type(n.op)](left, right)
            case ast.UnaryOp():
                out = UNARY[type(n.op)](go(n.operand))
            case ast.BoolOp():
                out = go(n.values[0])
                for x in n.values[1:]:
                    if bool(out) is not isinstance(n.op, ast.And):
                        break
                    out = go(x)
            case ast.Compare():
                out, left = True, go(n.left)
                for op, x in zip(n.ops, n.comparators):
                    right = go(x)
                    out = COMPARE[type(op)](left, right)
                    left = right
                    if not out:
                        break
            case ast.IfExp():
                out = go(n.body) if go(n.test) else go(n.orelse)
            case ast.Subscript():
                out = go(n.value)[go(n.slice)]
            case ast.Slice():
                out = slice(*(None if x is None else go(x) for x in (n.lower, n.upper, n.step)))
            case ast.ListComp() | ast.GeneratorExp():
                out = list(self._comprehend(n.elt, n.generators, names))
            case ast.Call() if not n.keywords and not any(isinstance(a, ast.Starred) for a in n.args):
                out = self._call(n, names)
            case _:
                raise Unknown(type(n).__name__)
        if isinstance(out, (str, bytes, list, tuple, dict)) and len(out) > MOST:
            raise Unknown("too large")
        return out

    def _comprehend(self, element, generators, names):
        first, rest = generators[0], generators[1:]
        for value in self.run(first.iter, names):
            own = dict(names)
            if isinstance(first.target, ast.Name):
                own[first.target.id] = value
            elif isinstance(first.target, ast.Tuple) and all(isinstance(t, ast.Name) for t in first.target.elts):
                own.update(zip((t.id for t in first.target.elts), value, strict=True))
            else:
                raise Unknown("target")
            if all(self.run(c, own) for c in first.ifs):
                if rest:
                    yield from self._comprehend(element, rest, own)
                else:
                    yield self.run(element, own)

    def _call(self, n: ast.Call, names):
        name = dotted(n.func)
        if name == "map" and len(n.args) == 2 and dotted(n.args[0]) in FUNCTIONS:
            return [FUNCTIONS[dotted(n.args[0])](x) for x in self.run(n.args[1], names)]
        if name in ("bytes", "bytearray") and len(n.args) == 1 and isinstance(self.run(n.args[0], names), int):
            raise Unknown("a size")
        if name in FUNCTIONS and name not in names:
            return FUNCTIONS[name](*(self.run(a, names) for a in n.args))
        if isinstance(n.func, ast.Attribute):
            base = self.run(n.func.value, names)
            args = [self.run(a, names) for a in n.args]
            if isinstance(base, bytes) and n.func.attr == "decode":
                return _decode(base, *args)
            if n.func.attr in METHODS.get(type(base), ()):
                if n.func.attr == "encode" and args and args[0].lower().replace("-", "_") in ("rot13", "rot_13"):
                    return codecs.encode(base, "rot13")
                return getattr(base, n.func.attr)(*args)
        raise Unknown(name)


def constant(node: ast.AST):
    """The value of a constant expression, or Unknown."""
    try:
        return Evaluator().run(node)
    except Unknown:
        raise
    except Exception as e:  # any error that the sample's expression would raise
        raise Unknown(str(e)) from None


def literal(node: ast.expr) -> ast.Constant | None:
    """The node that spells the value of a constant expression, if it is a plain scalar. Bytes of decoders become text."""
    try:
        value = constant(node)
    except Unknown:
        return None
    if isinstance(value, bytes) and isinstance(node, ast.Call) and dotted(node.func) in TEXTUAL:
        try:
            value = value.decode()
        except UnicodeDecodeError:
            pass
    if value is None or isinstance(value, (str, bytes, int, float, bool)):
        return ast.copy_location(ast.Constant(value), node)
    return None
