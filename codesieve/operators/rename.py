"""Names for mangled identifiers by what they are bound to, and validation of a rewritten program."""

from __future__ import annotations

import ast
import builtins
import re

# Shapes of mangled names, and names that are never changed (builtins and __dunder__ names aside).
MANGLED = [r"[a-zA-Z]\d{1,3}", r"[a-zA-Z]{1,2}", r"[OIl1]{3,}", r"_{3,}\w+", r"[A-Z][a-z][A-Z][a-z]", r"l[0-9O]+", r"[a-z]{1,2}\d{2,}"]
KEPT = "self cls args kwargs main run start stop init setup teardown parse format encode decode read write get set add remove update delete create load save open close connect disconnect i j k n x y e f fp ok err ex exc msg buf tmp ret res val idx key kw".split()
SHAPE = re.compile("|".join(f"(?:{p})" for p in MANGLED))
NEVER = frozenset(KEPT) | frozenset(dir(builtins))
KINDS = {str: "text", bytes: "data", bool: "flag", int: "number", float: "ratio"}


def is_mangled(name: str) -> bool:
    """z counts as mangled, x and y as conventional."""
    return name not in NEVER and not (name.startswith("__") and name.endswith("__")) and bool(SHAPE.fullmatch(name) or re.match(r"_{3,}\w+", name))


def _base(value: ast.AST | None) -> str:
    """A name for a value by its form."""
    match value:
        case ast.Constant():
            return KINDS.get(type(value.value), "value")
        case ast.List() | ast.ListComp():
            return "items"
        case ast.Dict() | ast.DictComp():
            return "mapping"
        case ast.Set() | ast.SetComp():
            return "unique"
        case ast.Tuple():
            return "pair"
        case ast.Lambda():
            return "func"
        case ast.JoinedStr():
            return "text"
        case ast.Compare() | ast.BoolOp():
            return "flag"
        case ast.BinOp():
            return "total"
        case ast.Call(func=ast.Name(id=n)) if n.isidentifier() and len(n) > 2:
            return f"{n.lower()}_result"
        case ast.Call(func=ast.Attribute(attr=n)) if len(n) > 2:
            return f"{n.lower()}_result"
    return "value"


class _Collect(ast.NodeVisitor):
    def __init__(self, used: set[str]):
        self.names: dict[str, str] = {}
        self.used, self.count = used, {}

    def add(self, name: str, base: str) -> None:
        if name in self.names or not is_mangled(name):
            return
        k = self.count.get(base, -1)
        while True:
            k += 1
            new = base if not k else f"{base}_{k}"
            if new not in self.used and new not in NEVER:
                break
        self.count[base] = k
        self.names[name] = new

    def target(self, t: ast.AST, base: str) -> None:
        if isinstance(t, ast.Name):
            self.add(t.id, base)
        elif isinstance(t, (ast.Tuple, ast.List)):
            for x in t.elts:
                self.target(x, "item")

    def visit_FunctionDef(self, n):
        self.add(n.name, "function")
        for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs, *filter(None, (n.args.vararg, n.args.kwarg))]:
            self.add(a.arg, a.annotation.id.lower() + "_arg" if isinstance(a.annotation, ast.Name) else "arg")
        self.generic_visit(n)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, n):
        self.add(n.name, "Class")
        self.generic_visit(n)

    def visit_Assign(self, n):
        for t in n.targets:
            self.target(t, _base(n.value))
        self.generic_visit(n)

    def visit_AnnAssign(self, n):
        self.target(n.target, n.annotation.id.lower() + "_value" if isinstance(n.annotation, ast.Name) else _base(n.value))
        self.generic_visit(n)

    def visit_NamedExpr(self, n):
        self.target(n.target, _base(n.value))
        self.generic_visit(n)

    def visit_For(self, n):
        self.target(n.target, "index" if isinstance(n.iter, ast.Call) and getattr(n.iter.func, "id", "") == "range" else "item")
        self.generic_visit(n)

    def visit_With(self, n):
        for w in n.items:
            if w.optional_vars is not None:
                self.target(w.optional_vars, "handle")
        self.generic_visit(n)

    def visit_ExceptHandler(self, n):
        if n.name:
            self.add(n.name, "error")
        self.generic_visit(n)

    def visit_comprehension(self, n):
        self.target(n.target, "item")
        self.generic_visit(n)


def _bound(s: ast.AST) -> set[str]:
    """Names that a statement of a class body binds there."""
    if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        return {s.name}
    return {n.id for n in ast.walk(s) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} | {n.name for n in ast.walk(s) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}


def rename(source: str) -> tuple[str, dict[str, str]]:
    """(program, old name to new): one map for the whole program; attributes, names bound in a class body (they are reached
    as attributes), keyword names and names that are looked up as text stay."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return source, {}
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | {a.arg for a in ast.walk(tree) if isinstance(a, ast.arg)}
    imported = {(a.asname or a.name).split(".")[0] for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}
    keywords = {k.arg for n in ast.walk(tree) if isinstance(n, ast.Call) for k in n.keywords}
    fields = {n for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for s in c.body for n in _bound(s)}
    texts = {n.value for n in ast.walk(tree) if isinstance(n, ast.Constant) and isinstance(n.value, str)}
    c = _Collect(used)
    c.visit(tree)
    names = {a: b for a, b in c.names.items() if a not in imported and a not in keywords and a not in fields and a not in texts}
    if not names:
        return source, {}
    for n in ast.walk(tree):
        for field in ("id", "arg", "name"):
            if not isinstance(n, (ast.keyword, ast.alias)) and isinstance(getattr(n, field, None), str):
                setattr(n, field, names.get(getattr(n, field), getattr(n, field)))
        if isinstance(n, (ast.Global, ast.Nonlocal)):
            n.names = [names.get(x, x) for x in n.names]
    return ast.unparse(tree), names


COUNTED = {
    "functions": (ast.FunctionDef, ast.AsyncFunctionDef), "classes": ast.ClassDef, "loops": (ast.For, ast.While, ast.AsyncFor), "branches": (ast.If, ast.IfExp, ast.Match), "imports": (ast.Import, ast.ImportFrom), "returns": ast.Return,
}


def stats(source: str) -> dict[str, int] | None:
    """Numbers of functions, classes, loops, branches, imports and returns; None if the text does not parse."""
    try:
        nodes = list(ast.walk(ast.parse(source)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    return {k: sum(isinstance(n, t) for n in nodes) for k, t in COUNTED.items()}


def validate(original: str, cleaned: str) -> dict:
    """Does the result parse, and has it kept its structure? A count below half warns, functions below 40 % fail."""
    new, old = stats(cleaned), stats(original)
    if new is None:
        return {"valid": False, "syntax_ok": False, "structure_ok": False, "error": "syntax", "warnings": []}
    if old is None:
        return {"valid": True, "syntax_ok": True, "structure_ok": True, "error": None, "warnings": ["original does not parse"]}
    warnings = [f"{k}: {old[k]} to {new[k]}" for k in COUNTED if new[k] < 0.5 * old[k]]
    ok = new["functions"] >= 0.4 * old["functions"]
    return {"valid": ok, "syntax_ok": True, "structure_ok": ok, "error": None, "warnings": warnings}


def mangling(source: str) -> float:
    """0 to 2: share of mangled identifiers, more where names are short; 1 if the text has no tokens."""
    import io
    import keyword
    import tokenize

    try:
        names = [t.string for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.NAME and not keyword.iskeyword(t.string)]
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return 1.0
    if not names:
        return 0.0
    share, mean = sum(map(is_mangled, names)) / len(names), sum(map(len, names)) / len(names)
    return round(min(2.0, 2 * share + max(0.0, (4 - mean) * 0.2)), 2)


# Predicates over programs -----------------------------------------------------------------------------------------------

RISKY = frozenset("eval exec compile open input exit quit __import__".split())


def _tree(source: str | None) -> ast.Module | None:
    try:
        return None if source is None else ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def machine_classes(source: str, least: int = 6) -> list[str]:
    """Names of the classes that hold a match statement with at least so many integer cases: interpreters of some code."""
    tree = _tree(source)
    numbers = lambda m: sum(isinstance(c.pattern, ast.MatchValue) and isinstance(c.pattern.value, ast.Constant) and type(c.pattern.value.value) is int for c in m.cases)
    return [] if tree is None else [c.name for c in ast.walk(tree) if isinstance(c, ast.ClassDef) and any(isinstance(m, ast.Match) and numbers(m) >= least for m in ast.walk(c))]


def is_safe_block(source: str) -> bool:
    """Statements without a raise, an assert or a call of what reaches outside; False if the text does not parse."""
    tree = _tree(source)
    return tree is not None and not any(isinstance(n, (ast.Raise, ast.Assert)) or (isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in RISKY) for n in ast.walk(tree))


def accepts(original: str, candidate: str) -> bool:
    """May a proposed function stand for the original? One function, as many parameters, and not all returns lost."""
    old, new = _tree(original), _tree(candidate)
    if old is None or new is None:
        return False
    functions = [[n for n in t.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))] for t in (old, new)]
    if len(functions[1]) != 1 or not functions[0]:
        return False
    (a, b), returns = (functions[0][0], functions[1][0]), lambda f: sum(isinstance(n, ast.Return) for n in ast.walk(f))
    size = lambda f: len(f.args.args) + len(f.args.posonlyargs) + len(f.args.kwonlyargs)
    return size(a) == size(b) and (returns(b) > 0 or returns(a) == 0)


def apply_candidates(source: str, candidates: dict[str, str] | None) -> tuple[str, dict[str, str]]:
    """Renames by proposals (old name to new) from elsewhere: those that are identifiers, new to the program and not taken twice."""
    tree = _tree(source)
    if tree is None or not candidates:
        return source, {}
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | {a.arg for a in ast.walk(tree) if isinstance(a, ast.arg)} | {n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.ClassDef))}
    taken, names = set(used) | NEVER, {}
    for old, new in sorted(candidates.items()):
        if old in used and old not in NEVER and new.isidentifier() and new not in taken:
            names[old] = new
            taken.add(new)
    if not names:
        return source, {}
    for n in ast.walk(tree):
        for field in ("id", "arg", "name"):
            if not isinstance(n, (ast.keyword, ast.alias)) and isinstance(getattr(n, field, None), str):
                setattr(n, field, names.get(getattr(n, field), getattr(n, field)))
    return ast.unparse(tree), names
