"""Rewrites, names and static decoders: plain functions."""

import ast
import base64
import codecs
import lzma
import random
import struct
import time
import zlib

import pytest

from codesieve.operators import archive, formats
from codesieve.operators.evaluate import Evaluator, Unknown, constant
from codesieve.operators.rename import is_mangled, mangling, rename, stats, validate
from codesieve.operators.rewrite import clean


def out(source):
    return clean(source)[0]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("if False:\n    a = 1\nelse:\n    b = 2", "b = 2"),
        ("x = 7 * 6", "x = 42"),
        ("x = not not True", "x = True"),
        ("x = 'a' 'b' + 'c'", "x = 'abc'"),
        ("x = base64.b64decode('aGVsbG8=').decode()", "x = 'hello'"),
        ("x = __import__('base64').b64decode('aGVsbG8=')", "x = 'hello'"),
        ("x = bytes.fromhex('6869').decode()", "x = 'hi'"),
        ("x = ''.join(map(chr, [104, 105]))", "x = 'hi'"),
        ("x = ''.join(map(chr, range(97, 100)))", "x = 'abc'"),
        ("x = bytes([c ^ 3 for c in [107, 106]])", "x = 'hi'"),
        ("x = ''.join(chr(a ^ b) for a, b in zip([105, 107], [1, 2]))", "x = 'hi'"),
        ("x = codecs.decode('uryyb', 'rot13')", "x = 'hello'"),
        ("x = 'olleh'[::-1]", "x = 'hello'"),
        ("x = int('ff', 16)", "x = 255"),
        ("x = 'abc'.encode('utf-8').decode('utf-8')", "x = 'abc'"),
        ("x = zlib.decompress(%r)" % zlib.compress(b"deep"), "x = 'deep'"),
        ("import os as q\nq.getcwd()", "import os\nos.getcwd()"),
        ("try:\n    a = 1\nexcept:\n    pass", "a = 1"),
        ("x = y or 'default'", "x = y or 'default'"),
        ("while x:\n    break\n    y()", "while x:\n    break"),
        ("def f(:\n", "def f(:\n"),
        ("", ""),
        ("x = 2 ** 99999999", "x = 2 ** 99999999"),
        ("x = 'a' * 99999999", "x = 'a' * 99999999"),
        ("x = '%999999999d' % 1", "x = '%999999999d' % 1"),
        ("x = __import__('os').system('true')", "x = __import__('os').system('true')"),
        ("u = open('f').read()", "u = open('f').read()"),
    ],
)
def test_clean(source, want):
    assert out(source) == want
    assert out(out(source)) == out(source)


def test_state_that_depends_on_data_stays():
    source = "s = 1\nwhile s != 0:\n    if s == 1:\n        s = f()"
    assert "while" in out(source)


def test_nothing_is_run(tmp_path):
    import sys

    bad = []
    sys.addaudithook(lambda e, a: bad.append(e) if e in ("os.system", "socket.connect", "subprocess.Popen") else None)
    for s in ("__import__('os').system('id')", "eval('__import__(\"os\").system(\"id\")')", "().__class__.__bases__[0].__subclasses__()", "exec('import socket')"):
        out(s)
    assert not bad
    with pytest.raises(Unknown):
        constant(__import__("ast").parse("().__class__", mode="eval").body)


def test_rename():
    assert all(map(is_mangled, ["a1", "OIl1", "___x", "AbCd", "z", "qq"])) and not any(map(is_mangled, ["x", "self", "print", "__init__", "value"]))
    text, names = rename("def q1(a9):\n    b7 = [a9]\n    for c3 in range(3):\n        b7.append(c3)\n    return b7\n")
    assert text == "def function(arg):\n    items = [arg]\n    for index in range(3):\n        items.append(index)\n    return items" and len(names) == 4
    assert rename("f(a1=2)\na1 = 3")[0] == "f(a1=2)\na1 = 3" and mangling("OIl1 = lI11") > mangling("value = other")


def test_validate():
    assert stats("def f():\n    return 1\nimport os") == {"functions": 1, "classes": 0, "loops": 0, "branches": 0, "imports": 1, "returns": 1}
    assert not validate("def f(): pass\ndef g(): pass\ndef h(): pass", "x = 1")["structure_ok"]
    assert validate("x = 1", "x = 1")["valid"] and not validate("x = 1", "x =")["syntax_ok"]


def test_formats():
    items = ["x" * ord(c) for c in "hi"]
    assert formats.decode("PlusOBF", f"d = {items}") == ("hi", "ok")
    inner = "print(1)"
    layer = lambda s: "_(b'%s')" % base64.b64encode(zlib.compress(s.encode()))[::-1].decode()
    assert formats.decode("freecodingtools", layer(layer(inner))) == (inner, "ok")
    data = zlib.compress(b"print(2)")
    assert formats.decode("Hyperion", f"a = {data[:9]!r}\nb = {data[9:]!r}") == ("print(2)", "ok")
    code = base64.b64encode(lzma.compress(lzma.compress(b"print(3)"))).decode()
    assert formats.decode("BlankOBF", f"b64decode(b'{code}')") == ("print(3)", "ok")
    assert formats.decode("devtool", "magic = 'pri'\ntrust = 'pri' + 'nt'") == ("print", "ok")
    assert formats.decode("wodx", "exec(x)") == ("input(x)", "ok")
    assert formats.decode("pyobfuscate", "x")[1] == "error: Unknown" and formats.decode(None, "x")[1] == "no_engine" and formats.decode("PlusOBF", "x")[1].startswith("error")
    three = lambda b: base64.b16encode(base64.b32encode(base64.b64encode(b)))
    secret = "".join(f"'{c}';" for c in three(b"url").decode())
    assert formats.decode("jawbreaker", f'x("{three(secret.encode()).decode()}")')[0] == "url"
    assert codecs.decode("a", "rot13") == "n"


def packed(new):
    body = zlib.compress(b"print('hi')")
    name = b"script\0\0"
    toc = struct.pack("!iIIIBc", 18 + len(name), 0, len(body), 11, 1, b"s") + name
    tail = len(body) + len(toc)
    head = struct.pack("!8sIIii64s", archive.MAGIC, tail + 88, len(body), len(toc), 311, b"libpython3.11.so") if new else struct.pack("!8siiii", archive.MAGIC, tail + 24, len(body), len(toc), 27)
    return b"MZ stub" + body + toc + head


@pytest.mark.parametrize("new", [True, False])
def test_archive(new):
    data = packed(new)
    (e,) = archive.entries(data)
    assert e[5:] == ("s", "script") and archive.member(data, e[1], e[2], e[4]) == b"print('hi')"
    assert archive.cookie(data)["python"] == ("3.11" if new else "2.7") and archive.cookie(b"nothing") is None and list(archive.entries(b"")) == []
    assert [len(archive.pyc_header(1, v)) for v in ((2, 7), (3, 3), (3, 11))] == [8, 12, 16]


def test_rdata():
    head = bytearray(400)
    head[:2] = b"MZ"
    struct.pack_into("<I", head, 60, 64)
    head[64:68] = b"PE\0\0"
    struct.pack_into("<H12xH", head, 70, 1, 0)
    struct.pack_into("<8s8xII", head, 88, b".rdata\0\0", 10, 300)
    head[300:310] = b"0123456789"
    assert archive.rdata(bytes(head)) == b"0123456789" and archive.rdata(b"x") is None


def test_long_texts_and_entries_are_whole():
    from codesieve.operators import archive, formats

    source = "x = 1\n" * 300_000
    assert formats.decode("wodx", source) == (source, "ok")
    data = source.encode()
    assert archive.member(b"head" + data, 4, len(data), 0) == data


def test_names_that_are_bound_again_are_not_inlined():
    assert "print(f())" in clean("def f():\n    return 3\nf = other\nprint(f())")[0]
    assert "return q.x" in clean("import os as q\ndef g(q):\n    return q.x")[0]
    assert clean("import os as q\nq.x()")[0] == "import os\nos.x()"
    text = clean("for i in r:\n    z = 1\n    while z != 0:\n        if z == 1:\n            a()\n            z = 0\nprint(z)")[0]
    assert "z = 0" in text and "while" not in text
    shared = "def see():\n    return z\nz = 1\nwhile z != 0:\n    if z == 1:\n        a(see())\n        z = 0"
    assert "while z != 0" in clean(shared)[0]  # another scope reads the state while the machine runs
    assert "z = 0" in clean("z = 1\nwhile z != 0:\n    if z == 1:\n        a()\n        z = 0\nprint(locals())")[0]


def test_methods_keep_their_names():
    text, names = rename("class Thing:\n    v1 = 2\n    def m1(self):\n        return self.v1\nq1 = Thing()\nq1.m1()")
    assert "def m1" in text and ".m1()" in text and "m1" not in names and "v1" not in names and "q1" in names


#: A closed grammar of small programs that print numbers, and what an interpreter of its own makes of them.
def _small_program(rng, depth=0):
    lines = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["assign", "print", "if", "while", "assert", "machine"] if depth < 2 else ["assign", "print"])
        name, other = rng.choice("uvw"), rng.choice("uvw")
        e = rng.choice([str(rng.randint(0, 9)), f"{rng.randint(1, 9)} * {rng.randint(0, 9)}", f"len('{'x' * rng.randint(0, 4)}')", other, f"{other} + {rng.randint(0, 3)}", f"(lambda: {rng.randint(0, 9)})()"])
        inner = ["    " + x for x in _small_program(rng, depth + 1)] if kind in ("if", "while") else []
        if kind == "assign":
            lines.append(f"{name} = {e}")
        elif kind == "print":
            lines.append(f"print({e})")
        elif kind == "if":
            lines += [f"if {rng.choice(['True', 'False', f'{other} > 3', '1 == 1 and 2 > 3'])}:", *inner]
        elif kind == "while":
            lines += ["while False:", *inner]
        elif kind == "assert":
            lines.append("assert 1 < 2")
        else:
            a, b = rng.sample(range(1, 9), 2)
            lines += [f"{name} = {a}", f"while {name} != 0:", f"    if {name} == {a}:", f"        print({rng.randint(0, 99)})", f"        {name} = {b}", f"    elif {name} == {b}:", "        print(7)", f"        {name} = 0"]
    return lines


def _interpret(source):
    """What a program of the grammar prints, by walking its tree with the constant evaluator; nothing is executed."""
    out, env = [], dict.fromkeys("uvw", 0)

    def value(n):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Lambda):
            return value(n.func.body)
        return Evaluator().run(n, env)

    def run(body):
        for s in body:
            if isinstance(s, ast.Assign):
                env[s.targets[0].id] = value(s.value)
            elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Call):
                out.append(value(s.value.args[0]))
            elif isinstance(s, ast.If):
                run(s.body if value(s.test) else s.orelse)
            elif isinstance(s, ast.While):
                for _ in range(50):
                    if not value(s.test):
                        break
                    run(s.body)
    run(ast.parse(source).body)
    return out, env


def test_cleaned_programs_do_the_same():
    rng = random.Random(4)
    for _ in range(400):
        source = "\n".join(["u = 0\nv = 0\nw = 0", *_small_program(rng), "print(u)", "print(v)", "print(w)"])
        assert _interpret(clean(source)[0])[0] == _interpret(source)[0], source


def test_texts_that_do_not_parse_are_decoded():
    assert clean('print base64.b64decode("SGk=")')[0] == "print 'Hi'"
    assert clean("print 'a' 'b', chr(72) + chr(105) + x")[0] == "print 'ab', 'Hi' + x"
    assert clean('exec "x" ; eval("1 + 1") ; print codecs.decode("Uv", "rot13")')[0] == 'exec "x" ; 1 + 1 ; print \'Hi\''
    broken = "print 'unclosed"
    assert clean(broken)[0] == broken
    began = time.process_time()
    clean("print " + "chr(" * 50_000)
    clean("print " + "base64.b64decode('" * 20_000)
    clean("print " + "'a' + " * 20_000)
    assert time.process_time() - began < 20


def test_cipher_and_keyed_format():
    from codesieve.operators import cipher

    key, start = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytes(range(16))
    assert cipher.encrypt_block(bytes.fromhex("6bc1bee22e409f96e93d7e117393172a"), cipher.round_keys(key)).hex() == "3ad77bb40d7a3660a89ecaf32466ef97"  # SP 800-38A, F.1.1
    assert cipher.encrypt_cfb8(bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d"), key, start).hex() == "3b79424c9c0dd436bace9e0ed4586a4f32b9"  # F.3.7
    plain, salt = b"print('hello')", b"12345678"
    data = base64.b85encode(salt + cipher.encrypt_cfb8(plain, *cipher.derived(b"secret", salt))).decode()
    table = {"'secret'": data}
    for text in (f"# pyobfuscate\nobfuscate = {table!r}\nrun(obfuscate)", f"obfuscate = str({str(table)!r})", f"obfuscate = {repr(repr(str(table)))}"):
        assert formats.decode("PYOBFUSCATE", text) == (plain.decode(), "ok")


def test_statuses_of_formats(monkeypatch):
    layer = b"print(1)"
    for _ in range(formats.LAYERS + 3):
        layer = f"exec((_)(b'{base64.b64encode(zlib.compress(layer))[::-1].decode()}'))".encode()
    assert formats.decode("freecodingtools", layer.decode())[1] == "truncated"
    big = zlib.compress(b"a" * 3_000_000)
    assert len(formats.decode("Hyperion", f"x({big!r})")[0]) == 3_000_000
    monkeypatch.setattr(formats, "LARGEST", 1000)
    assert formats.decode("Hyperion", f"x({big!r})") == (None, "too_large")
    formats.register("mine", str.upper)
    assert formats.decode("MINE", "a") == ("A", "ok")
