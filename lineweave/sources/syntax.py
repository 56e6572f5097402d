"""Source text to a small common syntax: functions, statements with blocks, and what each statement reads, writes and calls.

Python goes through the interpreter's own parser. The languages with braces go through one tokenizer and one statement
parser, told apart by a row of LANGUAGES. Nothing here knows Spark; sources/code.py turns the result into relations.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field


@dataclass
class Call:
    line: int
    callee: str
    qualifier: str | None
    args: list[str]


@dataclass
class Statement:
    """kind: assign, expr, return, if, loop, switch, try, throw, break, continue, goto, label, defer, with, declare, match."""

    kind: str
    line: int
    end: int
    defs: list[str] = field(default_factory=list)
    uses: list[tuple[int, str]] = field(default_factory=list)  # (line, path)
    calls: list[Call] = field(default_factory=list)
    tests: list[tuple[int, str]] = field(default_factory=list)  # identifiers of its condition
    declares: list[str] = field(default_factory=list)
    alias: list[tuple[str, str]] = field(default_factory=list)
    text: str = ""  # returned value, label, condition
    blocks: list[Block] = field(default_factory=list)


@dataclass
class Block:
    """role: then, else, body, case, default, catch, finally."""

    role: str
    line: int
    end: int
    body: list[Statement] = field(default_factory=list)


@dataclass
class Function:
    name: str
    line: int
    end: int
    params: list[str]
    body: list[Statement] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    owner: str | None = None
    decorator: str | None = None
    static: bool = False
    variadic: bool = False
    is_async: bool = False


@dataclass
class Type:
    name: str
    line: int
    end: int
    kind: str
    bases: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)


@dataclass
class Unit:
    functions: list[Function] = field(default_factory=list)
    types: list[Type] = field(default_factory=list)
    imports: list[tuple[str, str, str]] = field(default_factory=list)  # local name, module, name there
    body: list[Statement] = field(default_factory=list)
    names: list[tuple[int, str]] = field(default_factory=list)  # identifiers
    made: list[str] = field(default_factory=list)  # classes that are instantiated
    code: list[str] = field(default_factory=list)  # lines without comments and strings
    errors: list[int] = field(default_factory=list)


# ---- Python ----------------------------------------------------------------------------------------------------------


def dotted(node: ast.AST) -> str | None:
    """The access path of a name, attribute or subscript chain; [] stands for any index."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = dotted(node.value)
        return base and f"{base}.{node.attr}"
    if isinstance(node, ast.Subscript):
        base = dotted(node.value)
        return base and f"{base}.[]"
    return None


class PythonReader:
    def __init__(self, source: str):
        self.source, self.unit = source, Unit()

    def text(self, node: ast.AST) -> str:
        return ast.get_source_segment(self.source, node) or ""

    def reads(self, node: ast.AST | None, into: Statement) -> None:
        """The uses and calls of an expression, outermost paths only."""
        if node is None:
            return
        if isinstance(node, ast.Call):
            name = dotted(node.func)
            if name:
                qualifier, _, callee = name.rpartition(".")
                into.calls.append(Call(node.lineno, callee, qualifier or None, [self.text(a) for a in (*node.args, *node.keywords)]))
                if qualifier:
                    into.uses.append((node.lineno, qualifier))
                elif callee[:1].isupper():
                    self.unit.made.append(callee)
            else:
                self.reads(node.func, into)
            for a in (*node.args, *(k.value for k in node.keywords)):
                self.reads(a, into)
            return
        path = dotted(node)
        if path is not None:
            into.uses.append((node.lineno, path))
            while isinstance(node, (ast.Attribute, ast.Subscript)):
                if isinstance(node, ast.Subscript):
                    self.reads(node.slice, into)
                node = node.value
            return
        if isinstance(node, ast.NamedExpr):
            into.defs.append(node.target.id)
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.expr, ast.comprehension, ast.keyword, ast.FormattedValue)):
                self.reads(child.iter if isinstance(child, ast.comprehension) else child.value if isinstance(child, ast.keyword) else child, into)

    def writes(self, target: ast.AST, into: Statement) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.writes(t, into)
        elif isinstance(target, ast.Starred):
            self.writes(target.value, into)
        elif path := dotted(target):
            into.defs.append(path)
            while isinstance(target, (ast.Attribute, ast.Subscript)):
                if isinstance(target, ast.Subscript):
                    self.reads(target.slice, into)
                target = target.value

    def block(self, role: str, body: list[ast.stmt]) -> Block:
        return Block(role, body[0].lineno, body[-1].end_lineno, self.statements(body))

    def test(self, node: ast.AST, into: Statement) -> None:
        self.reads(node, into)
        into.text = self.text(node)
        into.tests += [(n.lineno, n.id) for n in ast.walk(node) if isinstance(n, ast.Name)]

    def statements(self, body: list[ast.stmt], owner: str | None = None) -> list[Statement]:
        return [s for node in body for s in self.statement(node, owner)]

    def statement(self, node: ast.stmt, owner: str | None) -> list[Statement]:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            args = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
            mark = self.text(node.decorator_list[-1]) if node.decorator_list else None
            f = Function(node.name, node.lineno, node.end_lineno, [x.arg for x in args], types=[self.text(x.annotation) if x.annotation else "" for x in args], owner=owner, decorator=mark and "@" + mark, variadic=a.vararg is not None, is_async=isinstance(node, ast.AsyncFunctionDef))
            self.unit.functions.append(f)
            f.body = self.statements(node.body)
            return []
        if isinstance(node, ast.ClassDef):
            own = [t.id for s in node.body for t in (s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []) if isinstance(t, ast.Name)]
            self.unit.types.append(Type(node.name, node.lineno, node.end_lineno, "class", [b for b in map(dotted, node.bases) if b], own))
            return self.statements(node.body, node.name)
        s = Statement("expr", node.lineno, node.end_lineno)
        if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            s.kind = "assign"
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            for t in targets:
                self.writes(t, s)
            if isinstance(node, ast.AugAssign):
                self.reads(node.target, s)
            self.reads(node.value, s)
            if isinstance(node.value, ast.Name):
                s.alias = [(t.id, node.value.id) for t in targets if isinstance(t, ast.Name) and not isinstance(node, ast.AugAssign)]
            if isinstance(node, ast.AnnAssign) and node.value is None:
                s.kind, s.defs = "declare", []
        elif isinstance(node, ast.Return):
            s.kind, s.text = "return", self.text(node.value) if node.value else ""
            self.reads(node.value, s)
        elif isinstance(node, (ast.If, ast.While)):
            s.kind = "if" if isinstance(node, ast.If) else "loop"
            self.test(node.test, s)
            s.blocks = [self.block("then" if s.kind == "if" else "body", node.body)] + ([self.block("else", node.orelse)] if node.orelse else [])
        elif isinstance(node, (ast.For, ast.AsyncFor)):
            s.kind = "loop"
            self.writes(node.target, s)
            self.test(node.iter, s)
            s.blocks = [self.block("body", node.body)] + ([self.block("else", node.orelse)] if node.orelse else [])
        elif isinstance(node, ast.Try):
            s.kind = "try"
            s.blocks = [self.block("body", node.body)]
            for h in node.handlers:
                b = self.block("catch", h.body)
                s.blocks.append(Block("catch", h.lineno, b.end, b.body))
            s.blocks += [self.block(r, x) for r, x in (("else", node.orelse), ("finally", node.finalbody)) if x]
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            s.kind = "with"
            for item in node.items:
                self.reads(item.context_expr, s)
                if item.optional_vars:
                    self.writes(item.optional_vars, s)
            s.blocks = [self.block("body", node.body)]
        elif isinstance(node, ast.Match):
            s.kind = "switch"
            self.test(node.subject, s)
            s.blocks = [self.block("case", c.body) for c in node.cases]
        elif isinstance(node, ast.Raise):
            s.kind = "throw"
            self.reads(node.exc, s)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for a in node.names:
                module = a.name if isinstance(node, ast.Import) else f"{'.' * node.level}{node.module or ''}"
                self.unit.imports.append((a.asname or (a.name.split(".")[0] if isinstance(node, ast.Import) else a.name), module, a.name))
            return []
        elif isinstance(node, (ast.Break, ast.Continue)):
            s.kind = "break" if isinstance(node, ast.Break) else "continue"
        else:
            for child in ast.iter_child_nodes(node):
                self.reads(child, s)
        return [s]

    def read(self) -> Unit:
        self.unit.code = blanked(self.source, ("#",), None, "\"'")
        try:
            tree = ast.parse(self.source)
        except (SyntaxError, ValueError, RecursionError) as e:
            self.unit.errors = [getattr(e, "lineno", None) or 1]
            return self.unit
        self.unit.body = self.statements(tree.body)
        for n in ast.walk(tree):
            name = n.id if isinstance(n, ast.Name) else n.arg if isinstance(n, ast.arg) else n.attr if isinstance(n, ast.Attribute) else n.name if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None
            if name:
                self.unit.names.append((n.end_lineno if isinstance(n, ast.Attribute) else n.lineno, name))
        return self.unit


# ---- languages with braces -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Language:
    """What the common reader must know of a language."""

    newline_ends: bool = False  # a statement ends where a line does
    parens: bool = True  # conditions stand in parentheses
    quotes: str = "\"'"
    function: str | None = None  # keyword that begins a function
    lets: tuple[str, ...] = ()  # keywords that begin a declaration
    typed: bool = False  # declarations are a type, then a name
    type_words: tuple[str, ...] = ("class", "struct", "interface", "enum", "union")


LANGUAGES = {
    "c": Language(typed=True, type_words=("struct", "union", "enum")),
    "cpp": Language(typed=True, type_words=("class", "struct", "union", "enum", "namespace")),
    "java": Language(typed=True, type_words=("class", "interface", "enum", "record")),
    "javascript": Language(newline_ends=True, quotes="\"'`", function="function", lets=("let", "const", "var"), type_words=("class",)),
    "typescript": Language(newline_ends=True, quotes="\"'`", function="function", lets=("let", "const", "var"), type_words=("class", "interface")),
    "tsx": Language(newline_ends=True, quotes="\"'`", function="function", lets=("let", "const", "var"), type_words=("class", "interface")),
    "go": Language(newline_ends=True, parens=False, quotes="\"'`", function="func", lets=("var", "const"), type_words=("type",)),
    "rust": Language(parens=False, quotes='"', function="fn", lets=("let",), type_words=("struct", "trait", "impl", "enum", "mod")),
}

TOKEN = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*!?(?=\()|[A-Za-z_$][A-Za-z0-9_$]*|\d[\w.]*|->|=>|::|\?\.|:=|<<=|>>=|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|<-|\S")
ID = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*$")
ASSIGN = {"=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="}
JOINS = {".", "->", "::", "?."}
# Words that are no identifiers, in all the languages and in some.
COMMON = set("if else for while do switch case default return break continue goto try catch finally throw new delete const true false null static struct enum".split())
OWN = {
    "c": "void int char long short unsigned signed float double bool sizeof union typedef extern inline volatile register NULL auto",
    "cpp": "void int char long short unsigned signed float double bool sizeof union typedef extern inline volatile register NULL nullptr auto class public private protected virtual namespace using template typename override",
    "java": "void int char long short float double boolean byte final abstract class interface public private protected extends implements throws import package instanceof record synchronized",
    "javascript": "as let var function class extends async await yield import export from in of typeof instanceof undefined void",
    "go": "var func type map chan range defer go select interface package import nil string int error byte bool",
    "rust": "let mut fn impl trait pub use mod loop match as in where async await unsafe move",
}
OWN |= {"typescript": OWN["javascript"] + " interface implements readonly number string boolean any private public protected type", "tsx": OWN["javascript"] + " interface implements readonly number string boolean any private public protected type"}


def blanked(source: str, line_marks: tuple[str, ...], block: tuple[str, str] | None, quotes: str) -> list[str]:
    """The lines with comments and the inside of strings replaced by blanks."""
    out, i, n = list(source), 0, len(source)

    def wipe(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        mark = next((m for m in line_marks if source.startswith(m, i)), None)
        if mark:
            end = source.find("\n", i)
            end = n if end < 0 else end
            wipe(i, end)
            i = end
        elif block and source.startswith(block[0], i):
            end = source.find(block[1], i + 2)
            end = n if end < 0 else end + len(block[1])
            wipe(i, end)
            i = end
        elif source[i] in quotes:
            q, many = source[i], source[i] * 3
            if q in "\"'" and source.startswith(many, i):
                end = source.find(many, i + 3)
                end = n if end < 0 else end
                wipe(i + 3, end)
                i = end + 3
                continue
            k = i + 1
            while k < n and source[k] != q and (source[k] != "\n" or q == "`"):
                k += 2 if source[k] == "\\" else 1
            wipe(i + 1, k)
            i = k + 1
        else:
            i += 1
    return "".join(out).split("\n")


class BraceReader:
    """One pass over the tokens; positions are indices into self.t."""

    def __init__(self, source: str, lang: str):
        self.lang, self.rules, self.unit = lang, LANGUAGES[lang], Unit()
        self.words = COMMON | set(OWN[lang].split())
        self.lines = source.split("\n")
        self.unit.code = blanked(source, ("//",), ("/*", "*/"), self.rules.quotes)
        self.t: list[tuple[str, int, int]] = []  # text, line, column
        for k, code in enumerate(self.unit.code, 1):
            if self.lang in ("c", "cpp") and code.lstrip().startswith("#"):
                continue  # the preprocessor's lines
            self.t += [(m[0], k, m.start()) for m in TOKEN.finditer(code)]
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for i, (x, line, _) in enumerate(self.t):
            if x in "([{":
                stack.append(i)
            elif x in ")]}":
                if stack and "([{".index(self.t[stack[-1]][0]) == ")]}".index(x):
                    self.pair[stack.pop()] = i
                else:
                    self.unit.errors.append(line)
        self.unit.errors += [self.t[i][1] for i in stack]

    def close(self, i: int, stop: int) -> int:
        return min(self.pair.get(i, stop - 1), stop - 1)

    def raw(self, a: int, b: int) -> str:
        """The source text of tokens a to b."""
        if a >= b:
            return ""
        (_, l1, c1), (last, l2, c2) = self.t[a], self.t[b - 1]
        if l1 == l2:
            return self.lines[l1 - 1][c1 : c2 + len(last)]
        return "\n".join([self.lines[l1 - 1][c1:], *self.lines[l1 : l2 - 1], self.lines[l2 - 1][: c2 + len(last)]])

    def split(self, a: int, b: int, mark: str = ",") -> list[tuple[int, int]]:
        """The stretches between marks outside brackets."""
        out, start, i = [], a, a
        while i < b:
            if self.t[i][0] == mark:
                out.append((start, i))
                start = i + 1
            i = self.close(i, b) + 1 if self.t[i][0] in "([{" else i + 1
        return [(x, y) for x, y in [*out, (start, b)] if x < y]

    def path(self, i: int, stop: int) -> tuple[str, int]:
        """The access path that begins at i, and the token after it."""
        parts, i = [self.t[i][0]], i + 1
        while i < stop:
            x = self.t[i][0]
            if x in JOINS and i + 1 < stop and ID.match(self.t[i + 1][0].rstrip("!")):
                parts.append(self.t[i + 1][0])
                i += 2
            elif x == "[" and i in self.pair:
                parts.append("[]")
                i = self.pair[i] + 1
            else:
                break
        return ".".join(parts), i

    def expression(self, a: int, b: int, s: Statement) -> None:
        """The uses and calls between two tokens."""
        i = a
        while i < b:
            x, line, _ = self.t[i]
            if x == "{" and i in self.pair and i > a and (self.t[i - 1][0] in (")", "=>") or self.rules.function == "func" and self.opens_literal(i, a)):
                end = self.close(i, b)
                s.blocks.append(Block("body", line, self.t[end][1], self.statements(i + 1, end)))
                i = end + 1
            elif x in ("new",) and i + 1 < b:
                self.unit.made.append(self.t[i + 1][0])
                i += 1
            elif ID.match(x.rstrip("!")) and x.rstrip("!") not in self.words:
                start = i
                name, i = self.path(i, b)
                for k in range(start, i):
                    if self.t[k][0] == "[":
                        self.expression(k + 1, self.close(k, b), s)
                if i < b and self.t[i][0] == "(":
                    end = self.close(i, b)
                    qualifier, _, callee = name.rpartition(".")
                    s.calls.append(Call(line, callee, qualifier or None, [self.raw(p, q) for p, q in self.split(i + 1, end)]))
                    if qualifier and qualifier != "[]":
                        s.uses.append((line, qualifier))
                elif not (i < b and self.t[i][0] == ":" and self.in_object(start)):
                    s.uses.append((line, name))
                    if self.lang in ("go", "rust") and i < b and self.t[i][0] == "{" and name[:1].isupper():
                        self.unit.made.append(name)
            else:
                i += 1

    def opens_literal(self, i: int, a: int) -> bool:
        """Whether a function literal's body opens at i."""
        k = i - 1
        while k > a and self.t[k][0] not in ("func", "{", "}", ";"):
            k -= 1
        return self.t[k][0] == "func"

    def in_object(self, i: int) -> bool:
        return i > 0 and self.t[i - 1][0] in ("{", ",") and self.lang in ("javascript", "typescript", "tsx", "go")

    def targets(self, a: int, b: int, s: Statement, declared: bool) -> None:
        """The paths that the left side of an assignment writes."""
        for x, y in self.split(a, b):
            if self.t[x][0] in "{[(" and self.pair.get(x) == y - 1:  # destructuring: the name after a colon, if any
                for p, q in self.split(x + 1, y - 1):
                    colon = [k for k in range(p, q) if self.t[k][0] == ":"]
                    self.targets(colon[0] + 1 if colon else p, q, s, declared)
                continue
            ids = [k for k in range(x, y) if ID.match(self.t[k][0]) and self.t[k][0] not in self.words]
            if declared and self.lang in ("typescript", "tsx", "rust", "go") and ids:
                ids = ids[:1]  # what follows is the type
            elif not self.rules.typed or not declared:
                ids = ids[:1]
            else:
                depth = [k for k in ids if not any(self.t[o][0] in "[<" and o < k for o in range(x, k))] or ids
                ids = depth[-1:]
            for k in ids:
                name, end = self.path(k, y)
                s.defs.append(name)
                if declared:
                    s.declares.append(name.split(".")[0])
                for o in range(k, end):
                    if self.t[o][0] == "[":
                        self.expression(o + 1, self.close(o, y), s)

    def simple(self, a: int, b: int, kind: str = "expr") -> Statement:
        """A statement without a keyword of its own: an assignment, declaration or expression."""
        s = Statement(kind, self.t[a][1], self.t[b - 1][1])
        declared = False
        while a < b and self.t[a][0] in ("export", "static", "final", "const", "mut", *self.rules.lets):
            declared |= self.t[a][0] in self.rules.lets or self.rules.typed
            a += 1
        i, at = a, None
        while i < b and at is None:
            if self.t[i][0] in ASSIGN or self.t[i][0] == "<-" and self.lang == "go" and i > a:
                at = i
            i = self.close(i, b) + 1 if self.t[i][0] in "([{" else i + 1
        if at is not None and at > a:
            op = self.t[at][0]
            if self.rules.typed:
                words = [k for k in range(a, at) if ID.match(self.t[k][0])]
                declared |= len(words) > 1 and not any(self.t[k][0] in JOINS or self.t[k][0] == "[" and k < words[-1] for k in range(a, at))
            if kind == "expr":
                s.kind = "assign"
            self.targets(a, at, s, declared or op == ":=")
            if op not in ("=", ":="):
                self.expression(a, at, s)
            self.expression(at + 1, b, s)
            right = [self.t[k][0] for k in range(at + 1, b)]
            if op in ("=", ":=") and len(right) == 1 and ID.match(right[0]) and right[0] not in self.words and len(s.defs) == 1:
                s.alias = [(s.defs[0], right[0])]
            elif op == "=" and len(right) == 1 and ID.match(right[0]) and s.defs and self.t[a][0] == "{":
                parts = [[self.t[k][0] for k in range(p, q) if ID.match(self.t[k][0])] for p, q in self.split(a + 1, self.close(a, b))]
                s.alias = [(x[1] if len(x) > 1 else x[0], f"{right[0]}.{x[0]}") for x in parts if x]
        elif declared or self.rules.typed and b - a > 1 and all(ID.match(self.t[k][0]) or self.t[k][0] in "*&,[]<>" for k in range(a, b)) and ID.match(self.t[a][0]):
            s.kind = "declare"
            own = Statement("declare", s.line, s.end)
            self.targets(a, b, own, True)
            s.declares = own.declares
        else:
            for k in range(a, b):
                if self.t[k][0] in ("++", "--"):
                    near = k - 1 if k > a and ID.match(self.t[k - 1][0]) else k + 1
                    if near < b and ID.match(self.t[near][0]):
                        s.defs.append(self.t[near][0])
                        s.kind = "assign"
            self.expression(a, b, s)
        return s

    def end_of(self, i: int, stop: int) -> int:
        """The token after the simple statement that begins at i."""
        k = i
        while k < stop:
            x = self.t[k][0]
            if x == ";":
                return k
            if x == "}":
                return k
            nxt = self.close(k, stop) + 1 if x in "([{" else k + 1
            if self.rules.newline_ends and nxt < stop and self.t[nxt][1] > self.t[nxt - 1][1]:
                last, first = self.t[nxt - 1][0], self.t[nxt][0]
                if (last in (")", "]", "}", "++", "--", "'", '"', "`") or last[-1].isalnum() or last[-1] in "_$") and first not in JOINS and first not in ("?", ":", "&&", "||", "+", "=", "{"):
                    return nxt
            if not self.rules.newline_ends and x == "{" and nxt < stop and self.t[nxt][0] not in (";", ",", ")", ".", "=") and k > i and self.t[k - 1][0] not in ("=", "(", ",", "return"):
                return nxt
            k = nxt
        return stop

    def body(self, i: int, stop: int, role: str) -> tuple[Block, int]:
        """The block or single statement at i, and the token after it."""
        if i < stop and self.t[i][0] == "{":
            end = self.close(i, stop)
            inner = self.statements(i + 1, end)
            return Block(role, inner[0].line if inner else self.t[i][1], inner[-1].end if inner else self.t[end][1], inner), end + 1
        if i >= stop:  # the text ends here
            at = self.t[-1][1] if self.t else 1
            return Block(role, at, at), i
        before = i
        got, i = self.statement(i, stop)
        i += i < stop and self.t[i][0] == ";"
        last = self.t[min(max(before, i - 1), len(self.t) - 1)][1] if self.t else 1
        return Block(role, got[0].line if got else last, got[-1].end if got else last, got), i

    def condition(self, i: int, stop: int, s: Statement) -> int:
        """Reads a condition after its keyword; returns the token where the block begins."""
        if self.rules.parens and i < stop and self.t[i][0] == "(":
            a, b, after = i + 1, self.close(i, stop), self.close(i, stop) + 1
        else:
            a = b = i
            while b < stop and self.t[b][0] != "{":
                b = self.close(b, stop) + 1 if self.t[b][0] in "([" else b + 1
            after = b
        s.text = self.raw(a, b)
        each = next((k for k in range(a, b) if self.t[k][0] in ("of", "in") and self.rules.newline_ends), None)
        if each is not None:  # for (const x of y)
            own = Statement("expr", s.line, s.line)
            self.targets(a + (self.t[a][0] in self.rules.lets), each, own, self.t[a][0] in self.rules.lets)
            s.defs, s.declares = own.defs, own.declares
            self.expression(each + 1, b, s)
        for x, y in self.split(a, b, ";") if each is None else []:
            part = self.simple(x, y) if self.rules.parens or any(self.t[k][0] in ASSIGN for k in range(x, y)) else Statement("expr", s.line, s.line)
            if part.kind == "expr":
                part = Statement("expr", s.line, s.line)
                self.expression(x, y, part)
            s.defs += part.defs
            s.uses += part.uses
            s.calls += part.calls
            s.declares += part.declares
            s.alias += part.alias
        head = [self.t[k][0] for k in range(a, b)]
        if self.rules.typed and ":" in head and head.index(":") and s.kind == "loop" and not s.defs:
            s.defs = [head[head.index(":") - 1]]
        s.tests = [(self.t[k][1], self.t[k][0]) for k in range(a, b) if ID.match(self.t[k][0]) and self.t[k][0] not in self.words and (k == a or self.t[k - 1][0] not in JOINS)]
        return after

    def statement(self, i: int, stop: int) -> tuple[list[Statement], int]:
        """The statements that begin at i (none for an empty one), and the token after them."""
        x, line, _ = self.t[i]
        if x in (";", ",", "}", ")", "]"):
            return [], i + 1
        if x == "{":
            end = self.close(i, stop)
            return self.statements(i + 1, end), end + 1
        if (f := self.function_at(i, stop)) is not None:
            return [], f
        s = Statement("expr", line, line)
        if x in ("if", "while", "for", "switch", "match", "select", "loop") and (x != "match" or self.lang == "rust") and (x not in ("select", "loop") or self.lang in ("go", "rust")):
            s.kind = {"if": "if", "switch": "switch", "match": "match", "select": "switch"}.get(x, "loop")
            i = self.condition(i + 1, stop, s)
            if s.kind in ("switch", "match"):
                end = self.close(i, stop) if i < stop and self.t[i][0] == "{" else i
                s.blocks = self.arms(i + 1, end) if s.kind == "match" else self.cases(i + 1, end)
                s.end = self.t[min(end, len(self.t) - 1)][1]
                return [s], end + 1
            first, i = self.body(i, stop, "then" if s.kind == "if" else "body")
            s.blocks.append(first)
            if s.kind == "if" and i < stop and self.t[i][0] == "else":
                other, i = self.body(i + 1, stop, "else")
                s.blocks.append(other)
            s.end = self.t[min(i, len(self.t)) - 1][1]
            return [s], i
        if x == "do":
            s.kind = "loop"
            first, i = self.body(i + 1, stop, "body")
            s.blocks.append(first)
            if i < stop and self.t[i][0] == "while":
                i = self.condition(i + 1, stop, s)
            s.end = self.t[min(i, len(self.t)) - 1][1]
            return [s], i
        if x == "try":
            s.kind = "try"
            first, i = self.body(i + 1, stop, "body")
            s.blocks.append(first)
            while i < stop and self.t[i][0] in ("catch", "finally"):
                role = self.t[i][0]
                i += 1
                if i < stop and self.t[i][0] == "(":
                    i = self.close(i, stop) + 1
                more, i = self.body(i, stop, role)
                s.blocks.append(more)
            s.end = self.t[min(i, len(self.t)) - 1][1]
            return [s], i
        end = self.end_of(i, stop)
        if x in ("return", "throw", "goto", "break", "continue", "defer", "go") and (x != "go" or self.lang == "go"):
            s.kind = {"go": "expr"}.get(x, x)
            s.end = self.t[max(i, end - 1)][1]
            s.text = self.raw(i + 1, end)
            if x not in ("goto", "break", "continue"):
                self.expression(i + 1, end, s)
            return [s], end
        if x in ("import", "use", "package", "export", "#") and self.imports(i, end):
            return [], end
        if self.lang in ("c", "cpp", "go") and ID.match(x) and x not in self.words and i + 1 < stop and self.t[i + 1][0] == ":" and (i + 2 >= stop or self.t[i + 2][0] != ":"):
            s.kind, s.text = "label", x
            return [s], i + 2
        if end <= i:
            return [], i + 1
        got = self.simple(i, end)
        if (m := re.search(r"\brequire\(\s*['\"]([^'\"]+)", self.raw(i, end))) and got.defs:
            self.unit.imports += [(d, m[1], d) for d in got.defs]
        if self.lang in ("javascript", "typescript", "tsx") and len(got.defs) == 1 and (f := self.assigned_function(i, end, got)):
            return [f], end
        return [got], end

    def statements(self, a: int, stop: int) -> list[Statement]:
        out, i = [], a
        while i < stop:
            got, nxt = self.statement(i, stop)
            out += got
            i = max(nxt, i + 1)
        return out

    def cases(self, a: int, stop: int) -> list[Block]:
        """The cases of a switch or select."""
        marks, i = [], a
        while i < stop:
            if self.t[i][0] in ("case", "default"):
                marks.append(i)
            i = self.close(i, stop) + 1 if self.t[i][0] in "([{" else i + 1
        out = []
        for k, m in enumerate(marks):
            end = marks[k + 1] if k + 1 < len(marks) else stop
            colon = next((j for j in range(m, end) if self.t[j][0] == ":"), m)
            inner = self.statements(colon + 1, end)
            out.append(Block("default" if self.t[m][0] == "default" else "case", inner[0].line if inner else self.t[m][1], inner[-1].end if inner else self.t[m][1], inner))
        return out

    def arms(self, a: int, stop: int) -> list[Block]:
        """The arms of a match."""
        out, i = [], a
        while i < stop:
            arrow = i
            while arrow < stop and self.t[arrow][0] != "=>":
                arrow = self.close(arrow, stop) + 1 if self.t[arrow][0] in "([{" else arrow + 1
            if arrow + 1 >= stop:
                break
            if self.t[arrow + 1][0] == "{":
                b, i = self.body(arrow + 1, stop, "case")
            else:
                end = arrow + 1
                while end < stop and self.t[end][0] != ",":
                    end = self.close(end, stop) + 1 if self.t[end][0] in "([{" else end + 1
                inner = self.statements(arrow + 1, end)
                b, i = Block("case", inner[0].line if inner else self.t[arrow][1], inner[-1].end if inner else self.t[arrow][1], inner), end
            out.append(b)
            i += i < stop and self.t[i][0] == ","
        return out

    def imports(self, i: int, end: int) -> bool:
        """Records the imports of a statement; whether it is one."""
        text = self.raw(i, end)
        if self.lang in ("javascript", "typescript", "tsx") and (m := re.match(r"import\s+(.*?)\s+from\s+['\"]([^'\"]+)", text, re.S)):
            for part in re.sub(r"[{}]", ",", m[1]).split(","):
                there, _, name = part.strip().partition(" as ")
                if there and (name or there != "*"):
                    self.unit.imports.append((name.strip() or there, m[2], there))
            return True
        if self.lang == "go" and self.t[i][0] in ("import", "package"):
            for alias, module in re.findall(r"([A-Za-z_.][\w.]*)?[ \t]*\"([^\"]+)\"", text.removeprefix("import")):
                if alias not in ("_", "."):
                    self.unit.imports.append((alias or module.rsplit("/", 1)[-1], module, module.rsplit("/", 1)[-1]))
            return True
        if self.lang == "java" and self.t[i][0] in ("import", "package"):
            module = re.sub(r"^import\s+(static\s+)?", "", text).strip()
            if self.t[i][0] == "import":
                self.unit.imports.append((module.rsplit(".", 1)[-1], module, module.rsplit(".", 1)[-1]))
            return True
        if self.lang == "rust" and self.t[i][0] == "use":
            module = text.removeprefix("use").strip()
            self.unit.imports.append((module.rsplit("::", 1)[-1], module, module.rsplit("::", 1)[-1]))
            return True
        return False

    # ---- functions and types ----

    def parameters(self, a: int, b: int) -> tuple[list[str], list[str], bool]:
        """Names and types between the parentheses, and whether the list is open."""
        names, types, variadic = [], [], False
        for x, y in self.split(a, b):
            words = [self.t[k][0] for k in range(x, y)]
            variadic |= "..." in words
            ids = [k for k in range(x, y) if ID.match(self.t[k][0])]
            stop = next((k for k in range(x, y) if self.t[k][0] == "="), y)
            colon = next((k for k in range(x, stop) if self.t[k][0] == ":"), None)
            if self.rules.typed:
                ids = [k for k in ids if k < stop and self.t[k][0] not in ("void",)]
                ids, kind = ids[-1:], self.raw(x, ids[-1]) if ids else ""
            elif self.lang == "rust":
                ids, kind = [k for k in ids if colon is not None and k < colon and self.t[k][0] != "mut"][:1], self.raw(colon + 1, y) if colon else ""
            elif words and words[0] in "{[":
                ids, kind = [k for k in ids if k < stop], ""
            else:
                ids, kind = ids[:1], self.raw(colon + 1, stop) if colon is not None else self.raw(x + 1, y) if self.lang == "go" else ""
            names += [self.t[k][0] for k in ids]
            types += [kind.strip()] * len(ids)
        return names, types, variadic

    def add(self, name: str, first: int, open_: int, close: int, brace: int, stop: int, **more) -> int:
        """Records the function whose parameters lie between open_ and close and whose body opens at brace."""
        end = self.close(brace, stop)
        names, types, variadic = self.parameters(open_ + 1, close)
        f = Function(name, self.t[first][1], self.t[end][1], names, types=types, variadic=variadic, **more)
        above = self.lines[f.line - 2].strip() if f.line > 1 else ""
        f.decorator = above if above.startswith(("@", "#[")) else None
        self.unit.functions.append(f)
        f.body = self.statements(brace + 1, end)
        return end + 1

    def function_at(self, i: int, stop: int, owner: str | None = None) -> int | None:
        """If a function definition begins at i: records it and returns the token after it."""
        k, words = i, []
        while k < stop and (self.t[k][0] in ("export", "default", "async", "static", "pub", "public", "private", "protected", "final", "abstract", "inline", "virtual", "unsafe", "extern", "const", "synchronized", "override", "get", "set") or self.t[k][0] == "@"):
            if self.t[k][0] == "@":
                k += 2
                k = self.close(k, stop) + 1 if k < stop and self.t[k][0] == "(" else k
                i = k
                continue
            words.append(self.t[k][0])
            k += 1
        more = {"owner": owner, "static": "static" in words, "is_async": "async" in words}
        if self.rules.function and k < stop and self.t[k][0] == self.rules.function:
            k += 1
            if self.lang == "go" and k < stop and self.t[k][0] == "(":  # a receiver
                end = self.close(k, stop)
                if end + 1 >= stop or not ID.match(self.t[end + 1][0]):
                    return None
                more["owner"] = next((self.t[j][0] for j in range(end, k, -1) if ID.match(self.t[j][0])), None)
                k = end + 1
            k += k < stop and self.t[k][0] == "*"
            if k >= stop or not ID.match(self.t[k][0]) or self.t[k][0] in self.words:
                return None
            name, k = self.t[k][0], k + 1
        elif self.rules.typed or owner is not None:
            start = k
            while k < stop and (ID.match(self.t[k][0]) or self.t[k][0] in ("*", "&", "::", "<", ">", "[", "]", ",", "~", ".")) and self.t[k][0] not in ("return", "else", "new", "throw", "goto", "case", "if", "for", "while", "switch"):
                if self.t[k][0] == "," and owner is None:
                    return None
                k += 1
            if k >= stop or self.t[k][0] != "(" or k == start or not ID.match(self.t[k - 1][0]) or self.t[k - 1][0] in self.words:
                return None
            if self.rules.typed and k - start < 2 and owner is None:
                return None  # a call
            name = self.t[k - 1][0]
            if k - start > 2 and self.t[k - 2][0] == "::":
                more["owner"] = self.t[k - 3][0]
        else:
            return None
        if k < stop and self.t[k][0] == "<":
            while k < stop and self.t[k][0] != "(":
                k += 1
        if k >= stop or self.t[k][0] != "(":
            return None
        open_, close = k, self.close(k, stop)
        brace = close + 1
        while brace < stop and self.t[brace][0] not in ("{", ";", "="):
            if not (self.rules.newline_ends or self.lang == "rust") and not (ID.match(self.t[brace][0]) or self.t[brace][0] in (",", ".", ":", "->", "::")):
                return None
            if self.rules.newline_ends and self.t[brace][1] > self.t[close][1]:
                return None
            brace = self.close(brace, stop) + 1 if self.t[brace][0] in "([" else brace + 1
        if brace >= stop or self.t[brace][0] != "{":
            return None
        return self.add(name, i, open_, close, brace, stop, **more)

    def assigned_function(self, i: int, end: int, got: Statement) -> Statement | None:
        """name = (a, b) => {...} or name = function (a, b) {...}: a function of that name."""
        at = next((k for k in range(i, end) if self.t[k][0] == "="), None)
        if at is None:
            return None
        k, is_async = at + 1, False
        if k < end and self.t[k][0] == "async":
            k, is_async = k + 1, True
        plain = k < end and self.t[k][0] == "function"
        k += plain
        if k >= end or self.t[k][0] != "(":
            return None
        close = self.close(k, end)
        brace = next((j for j in range(close + 1, end) if self.t[j][0] == "{"), None)
        if brace is None or not plain and "=>" not in [self.t[j][0] for j in range(close, brace)]:
            return None
        self.add(got.defs[0].split(".")[-1], i, k, close, brace, end, is_async=is_async)
        return Statement("assign", got.line, got.end, defs=got.defs, declares=got.declares)

    def members(self, a: int, stop: int, owner: str | None) -> list[Statement]:
        """Definitions at the top of a file or within a type."""
        out, i = [], a
        while i < stop:
            x = self.t[i][0]
            if (f := self.function_at(i, stop, owner)) is not None:
                i = f
                continue
            k = i
            while k < stop and self.t[k][0] in ("export", "default", "public", "private", "abstract", "final", "static", "pub", "typedef", "declare"):
                k += 1
            if k < stop and self.t[k][0] in self.rules.type_words and (t := self.type_at(i, k, stop)):
                i = t
                continue
            if owner is not None:  # a field
                end = self.end_of(i, stop)
                names = [self.t[j][0] for j in range(i, max(end, i + 1)) if ID.match(self.t[j][0]) and self.t[j][0] not in self.words]
                if names:
                    self.unit.types[-1].fields.append(names[-1] if self.rules.typed else names[0])
                i = max(end, i + 1)
                continue
            if x == "extern" and i + 2 < stop and self.t[i + 2][0] == "{":
                out += self.members(i + 3, self.close(i + 2, stop), None)
                i = self.close(i + 2, stop) + 1
                continue
            got, nxt = self.statement(i, stop)
            out += got
            i = max(nxt, i + 1)
        return out

    def type_at(self, first: int, k: int, stop: int) -> int | None:
        kind, j = self.t[k][0], k + 1
        brace = j
        while brace < stop and self.t[brace][0] not in ("{", ";", "(", "="):
            brace += 1
        if brace >= stop or self.t[brace][0] != "{":
            return None
        words = [self.t[m][0] for m in range(j, brace)]
        names = [w for w in words if ID.match(w) and w not in self.words]
        if kind == "type":  # Go: type T struct or interface
            kind = next((w for w in words if w in ("struct", "interface")), "type")
        if kind == "impl":
            owner, bases = (names[-1], names[:-1]) if "for" in words else (names[0] if names else "", [])
        else:
            owner, bases = (names[0] if names else ""), names[1:]
        end = self.close(brace, stop)
        self.unit.types.append(Type(owner, self.t[first][1], self.t[end][1], kind, bases))
        if kind in ("namespace", "mod"):
            self.members(brace + 1, end, None)
        elif kind == "interface" or kind == "trait":
            self.unit.types[-1].fields += [self.t[m][0] for m in range(brace + 1, end) if ID.match(self.t[m][0]) and m + 1 < end and self.t[m + 1][0] == "(" and self.t[m][0] not in self.words]
        elif kind == "enum":
            pass
        else:
            self.members(brace + 1, end, owner)
        return end + 1

    def read(self) -> Unit:
        self.unit.body = self.members(0, len(self.t), None)
        self.unit.names = [(line, x.rstrip("!")) for x, line, _ in self.t if ID.match(x.rstrip("!")) and x not in self.words]
        return self.unit


def read(source: str | None, lang: str | None) -> Unit | None:
    """The syntax of a source text; None for a language that has no reader. Text that does not parse gives errors, never an exception."""
    if lang == "python":
        return PythonReader(source or "").read()
    if lang in LANGUAGES:
        reader = BraceReader(source or "", lang)
        try:
            return reader.read()
        except RecursionError:  # blocks nested too deep: what was read so far, and the first line as an error
            reader.unit.errors.append(1)
            return reader.unit
    return None
