"""Source files as graph tables: a front end for C# by syntax alone, one file at a time in Arrow batches.

Files are cut into tokens and the tokens into a tree of brackets; declarations, statements and expressions are read
from that. There is no compiler behind it, so types of expressions are known only where a declaration in the same method
or type names them: a call is resolved by the receiver's type, its bases, or a name that only one type has. What cannot
be resolved gives no call. A file that cannot be read gives a row with an error and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callatlas.functions.text import collapse_space, lines_of_code, semantic_payload
from callatlas.sources.scratch import materialize
from callatlas.sources.tables import GraphTables, first_wins

_LEX = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|^\s*\#[^\n]*)
    |(?P<str>\$*\"\"\"+.*?\"\"\"+|(?:\$@|@\$)"(?:[^"]|"")*"|@"(?:[^"]|"")*"|\$"(?:\\.|\{\{|\{[^{}"]*(?:"[^"]*"[^{}"]*)*\}|[^"\\])*"|"(?:\\.|[^"\\\n])*")
    |(?P<char>'(?:\\[^']+|[^'\\])')
    |(?P<num>(?:0[xXbB][0-9A-Fa-f_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)[A-Za-z]*)
    |(?P<name>@?[^\W\d]\w*)
    |(?P<op>=>|\?\?=|\?\?|\?\.|\?(?=\[)|&&|\|\||::|->|\+\+|--|[-+*/%&|^=!<>]=|[-+*/%&|^=!<>?:.,;~\#\\$`@]|[()\[\]{}])""",
    re.X | re.S | re.M,
)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_TYPES = {"class", "struct", "interface", "enum", "record"}
_MODIFIERS = {"public", "private", "protected", "internal", "static", "abstract", "sealed", "partial", "readonly", "virtual", "override", "async", "extern", "unsafe", "new", "ref", "file", "required", "volatile", "const", "fixed"}
_NOT_CALLED = {"if", "for", "foreach", "while", "switch", "catch", "using", "lock", "return", "nameof", "typeof", "sizeof", "default", "checked", "unchecked", "when", "await", "in", "is", "as", "out", "ref", "throw", "fixed", "stackalloc", "and", "or", "not", "base", "this", "new", "yield", "case", "else", "do", "where", "var", "params", "delegate"}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "??="}
_LITERALS = {"true": "LIT_BOOL", "false": "LIT_BOOL", "null": "LIT_NULL"}


@dataclass
class Node:
    """A token, or a bracketed group with the nodes inside it."""

    kind: str  # str, char, num, name, op, or group
    text: str
    at: int
    end: int
    inside: list[Node] = field(default_factory=list)

    def is_(self, *texts: str) -> bool:
        return self.kind in ("op", "name") and self.text in texts

    def opens(self, bracket: str) -> bool:
        return self.kind == "group" and self.text == bracket


def tree(source: str) -> list[Node]:
    """The nodes of a source text; brackets that don't match are an error."""
    out: list[Node] = []
    open_: list[tuple[Node, list[Node]]] = []
    at = 0
    while at < len(source):
        m = _LEX.match(source, at)
        if m is None:
            raise ValueError(f"no token at {at}")
        kind, text = m.lastgroup, m.group()
        at = m.end()
        if kind == "space":
            continue
        if text in _CLOSE and kind == "op":
            open_.append((Node("group", text, m.start(), at), out))
            out = open_[-1][0].inside
        elif kind == "op" and text in _CLOSE.values():
            if not open_ or _CLOSE[open_[-1][0].text] != text:
                raise ValueError(f"unmatched {text} at {m.start()}")
            group, out = open_.pop()
            group.end = at
            out.append(group)
        else:
            node = Node(kind, text, m.start(), at)
            if kind == "str" and text.startswith("$"):
                node.inside = [Node("group", "(", 0, 0, tree(h)) for h in re.findall(r"(?<!\{)\{([^{}]+)\}(?!\})", text)]
            out.append(node)
    if open_:
        raise ValueError(f"{open_[-1][0].text} at {open_[-1][0].at} is not closed")
    return out


def split(nodes: list[Node], *marks: str) -> list[list[Node]]:
    """Nodes between marks, generic argument lists kept whole."""
    out: list[list[Node]] = [[]]
    i = 0
    while i < len(nodes):
        over = generic_end(nodes, i)
        if over > i:
            out[-1] += nodes[i:over]
            i = over
            continue
        if nodes[i].is_(*marks):
            out.append([])
        else:
            out[-1].append(nodes[i])
        i += 1
    return out


def generic_end(nodes: list[Node], i: int) -> int:
    """The place after the generic argument list that begins at i; i if none does."""
    if not nodes[i].is_("<") or i == 0 or nodes[i - 1].kind != "name":
        return i
    depth, k = 0, i
    while k < len(nodes):
        n = nodes[k]
        if n.is_("<"):
            depth += 1
        elif n.is_(">"):
            depth -= 1
            if not depth:
                after = nodes[k + 1] if k + 1 < len(nodes) else None
                return k + 1 if after is None or after.kind in ("name", "group") or after.is_(",", ";", ".", "=>", "=", ">", "?", ":", "::") else i
        elif not (n.kind == "name" or n.is_(".", ",", "?", "::") or n.opens("[") or n.opens("(")):
            return i
        k += 1
    return i


def text_of(nodes: list[Node]) -> str:
    """Source of a type: names and marks without space, but for commas."""
    out = []
    for n in nodes:
        if n.kind == "group":
            out.append(n.text + text_of(n.inside) + _CLOSE[n.text])
        else:
            out.append(", " if n.is_(",") else n.text)
    return "".join(out)


class Body:
    """Measures of a method's body, its calls, string literals, declared names and local functions."""

    def __init__(self) -> None:
        self.complexity = self.depth = 0
        self.calls: list[tuple[str, str, str, int]] = []  # kind, receiver, name, arguments
        self.literals: list[str] = []
        self.locals: list[tuple[str, list[Node], list[Node], list[Node]]] = []
        self.types: dict[str, str] = {}

    def cost(self, nest: int, depth: int | None = None) -> None:
        self.complexity += 1 + nest
        if depth is not None:
            self.depth = max(self.depth, depth)

    def block(self, nodes: list[Node], nest: int, depth: int) -> None:
        i = 0
        while i < len(nodes):
            i = self.statement(nodes, i, nest, depth)

    def statement(self, nodes: list[Node], i: int, nest: int, depth: int) -> int:
        """Read one statement from place i; returns the place after it. `nest` is the nesting that complexity counts,
        `depth` the one that nesting depth does."""
        n = nodes[i]
        group = lambda k, b: k < len(nodes) and nodes[k].opens(b)
        if n.opens("{"):
            self.block(n.inside, nest, depth)
            return i + 1
        if n.is_(";"):
            return i + 1
        if n.is_("if") and group(i + 1, "("):
            return self.conditional(nodes, i, nest, depth, False)
        if n.is_("await") and i + 1 < len(nodes) and nodes[i + 1].is_("foreach", "using"):
            return self.statement(nodes, i + 1, nest, depth)
        if n.is_("for", "foreach", "while") and group(i + 1, "("):
            self.cost(nest, depth + 1)
            self.header(nodes[i + 1], nest + 1, depth + 1)
            return self.statement(nodes, i + 2, nest + 1, depth + 1) if i + 2 < len(nodes) else i + 2
        if n.is_("do"):
            self.cost(nest, depth + 1)
            k = self.statement(nodes, i + 1, nest + 1, depth + 1)
            if group(k + 1, "("):
                self.expression(nodes[k + 1].inside, nest + 1, depth + 1)
                k += 2
            return k
        if n.is_("switch") and group(i + 1, "(") and group(i + 2, "{"):
            self.cost(nest, depth + 1)
            self.expression(nodes[i + 1].inside, nest + 1, depth + 1)
            self.block(nodes[i + 2].inside, nest + 1, depth + 1)
            return i + 3
        if n.is_("case", "default") and not (n.text == "default" and (group(i + 1, "(") or (i + 1 < len(nodes) and nodes[i + 1].is_(";", ",", ".")))):
            k = i + 1
            while k < len(nodes) and not nodes[k].is_(":"):
                k += 1
            self.expression(nodes[i + 1 : k], nest, depth)
            return k + 1
        if n.is_("try"):
            self.depth = max(self.depth, depth + 1)
            k = self.statement(nodes, i + 1, nest, depth + 1)
            while k < len(nodes) and nodes[k].is_("catch", "finally"):
                caught = nodes[k].text == "catch"
                if caught:
                    self.cost(nest)
                k += 1
                while k < len(nodes) and not nodes[k].opens("{"):
                    if nodes[k].kind == "group":
                        self.expression(nodes[k].inside, nest + 1, depth + 1)
                    k += 1
                k = self.statement(nodes, k, nest + caught, depth + 1) if k < len(nodes) else k
            return k
        if n.is_("using", "lock", "fixed", "checked", "unchecked", "unsafe") and (group(i + 1, "(") or group(i + 1, "{")):
            inner = depth + n.is_("using", "lock")
            self.depth = max(self.depth, inner)
            if group(i + 1, "{"):
                return self.statement(nodes, i + 1, nest, inner)
            self.header(nodes[i + 1], nest, inner)
            return self.statement(nodes, i + 2, nest, inner) if i + 2 < len(nodes) else i + 2
        if n.is_("goto"):
            self.complexity += 1
        local = self.local_function(nodes, i, nest, depth)
        if local > i:
            return local
        k = i
        while k < len(nodes) and not nodes[k].is_(";"):
            k += 1
        part = nodes[i:k]
        while part and part[0].is_("return", "throw", "yield", "goto", "else", "using", "const", "static", "break", "continue", "await", "ref", "in"):
            part = part[1:]
        self.declared(part)
        self.expression(part, nest, depth)
        return k + 1

    def conditional(self, nodes: list[Node], i: int, nest: int, depth: int, chained: bool) -> int:
        """An if statement with its else branches; `chained` for one that follows an else, which costs 1 at any
        nesting. In nesting depth what follows an else lies inside the if before it."""
        self.cost(0 if chained else nest, depth + 1)
        self.expression(nodes[i + 1].inside, nest + (not chained), depth + 1)
        k = self.statement(nodes, i + 2, nest + 1, depth + 1) if i + 2 < len(nodes) else i + 2
        if k < len(nodes) and nodes[k].is_("else"):
            if k + 2 < len(nodes) and nodes[k + 1].is_("if") and nodes[k + 2].opens("("):
                return self.conditional(nodes, k + 1, nest, depth + 1, True)
            self.complexity += 1
            return self.statement(nodes, k + 1, nest, depth + 1) if k + 1 < len(nodes) else k + 1
        return k

    def header(self, group: Node, nest: int, depth: int) -> None:
        for part in split(group.inside, ";"):
            self.declared(part)
            self.expression(part, nest, depth)

    def declared(self, nodes: list[Node]) -> None:
        """Remember the type that a declaration `Type name`, or `var name = new Type(...)`, gives a name."""
        t = type_end(nodes, 0)
        if t and t < len(nodes) and nodes[t].kind == "name" and (t + 1 == len(nodes) or nodes[t + 1].is_("=", ",", "in")):
            kind = simple_name(text_of(nodes[:t]))
            if kind == "var" and t + 2 < len(nodes) and nodes[t + 1].is_("=") and nodes[t + 2].is_("new"):
                end = type_end(nodes, t + 3)
                kind = simple_name(text_of(nodes[t + 3 : end])) if end else "var"
            self.types[nodes[t].text] = kind

    def local_function(self, nodes: list[Node], i: int, nest: int, depth: int) -> int:
        k = i
        while k < len(nodes) and nodes[k].is_("static", "async", "unsafe", "extern"):
            k += 1
        t = type_end(nodes, k)
        if not t or t >= len(nodes) or nodes[t].kind != "name" or nodes[t].text in _NOT_CALLED or (nodes[k].kind == "name" and nodes[k].text in _NOT_CALLED):
            return i
        p = t + 1
        p = generic_end(nodes, p) if p < len(nodes) else p
        if p >= len(nodes) or not nodes[p].opens("("):
            return i
        b = p + 1
        while b < len(nodes) and not nodes[b].opens("{") and not nodes[b].is_("=>", ";", ".", "?.", "=", "+"):
            b += 1
        if b >= len(nodes) or not (nodes[b].opens("{") or nodes[b].is_("=>")):
            return i
        if nodes[b].opens("{"):
            body, end = [nodes[b]], b + 1
            self.block(nodes[b].inside, nest + 1, depth)
        else:
            end = b + 1
            while end < len(nodes) and not nodes[end].is_(";"):
                end += 1
            body = nodes[b + 1 : end]
            self.expression(body, nest + 1, depth)
            end += 1
        self.locals.append((nodes[t].text, nodes[k:t], nodes[p].inside, body))
        return end

    def expression(self, nodes: list[Node], nest: int, depth: int) -> None:
        for part in split(nodes, ","):
            self.value(part, nest, depth)

    def value(self, nodes: list[Node], nest: int, depth: int) -> None:
        """Costs of one expression, from the operators that bind least inwards."""
        if not nodes:
            return
        for k, n in enumerate(nodes):
            if n.is_(*_ASSIGN):
                self.value(nodes[:k], nest, depth)
                self.value(nodes[k + 1 :], nest, depth)
                return
            if n.is_("=>"):
                at = k - 1 - (k > 1 and nodes[k - 2].is_("async", "static"))
                self.value(nodes[: max(0, at)], nest, depth)
                self.depth = max(self.depth, depth + 1)
                rest = nodes[k + 1 :]
                if rest and rest[0].opens("{"):
                    self.block(rest[0].inside, nest + 1, depth + 1)
                    rest = rest[1:]
                self.value(rest, nest + 1, depth + 1)
                return
        for k, n in enumerate(nodes):
            if n.is_("?") and (end := self.ternary_end(nodes, k)):
                self.cost(nest)
                self.value(nodes[:k], nest + 1, depth)
                self.value(nodes[k + 1 : end], nest + 1, depth)
                self.value(nodes[end + 1 :], nest + 1, depth)
                return
        for k, n in enumerate(nodes):
            if n.is_("switch") and k + 1 < len(nodes) and nodes[k + 1].opens("{"):
                self.cost(nest)
                self.value(nodes[:k], nest + 1, depth)
                for arm in split(nodes[k + 1].inside, ","):
                    for side in split(arm, "=>"):
                        self.value(side, nest + 1, depth)
                self.value(nodes[k + 2 :], nest, depth)
                return
        for operand in self.operands(nodes):
            self.calls_in(operand)
            for k, n in enumerate(operand):
                if n.kind == "str":
                    self.literals.append(n.text.strip('$@"'))
                    for hole in n.inside:
                        self.expression(hole.inside, nest, depth)
                elif n.opens("{") and any(x.is_("delegate") for x in operand[max(0, k - 2) : k]):
                    self.block(n.inside, nest, depth)
                elif n.kind == "group":
                    self.expression(n.inside, nest, depth)

    def operands(self, nodes: list[Node]) -> list[list[Node]]:
        """Parts between ??, || and &&: each ?? costs 1, so does each unbroken run of && or of ||."""
        out = []
        for part in (parts := split(nodes, "??")):
            either = split(part, "||")
            self.complexity += len(either) > 1
            for p in either:
                both = split(p, "&&")
                self.complexity += len(both) > 1
                out += both
        self.complexity += len(parts) - 1
        return out

    @staticmethod
    def ternary_end(nodes: list[Node], k: int) -> int:
        """Place of the colon of a conditional whose ? is at k; 0 if that ? is no conditional."""
        open_ = 0
        for i in range(k + 1, len(nodes)):
            if nodes[i].is_("?"):
                open_ += 1
            elif nodes[i].is_(":"):
                if not open_:
                    return i if i > k + 1 else 0
                open_ -= 1
        return 0

    def calls_in(self, nodes: list[Node]) -> None:
        for k, n in enumerate(nodes):
            if not n.opens("(") or not k:
                continue
            arguments = 0 if not n.inside else len(split(n.inside, ","))
            j = k - 1
            if nodes[j].is_("new"):
                self.calls.append(("new", "", "", arguments))
                continue
            if nodes[j].is_(">"):  # generic arguments
                opened = [i for i in range(1, j) if generic_end(nodes, i) == k]
                if not opened:
                    continue
                j = opened[0] - 1
            if nodes[j].kind != "name" or nodes[j].text in _NOT_CALLED:
                continue
            start = j
            while start >= 2 and nodes[start - 1].is_(".", "?.", "::"):
                start -= 2
            if start and nodes[start - 1].is_("new"):
                self.calls.append(("new", nodes[j].text, ".ctor", arguments))
                continue
            dotted = j >= 2 and nodes[j - 1].is_(".", "?.")
            receiver = ""
            if dotted:
                left = nodes[j - 2]
                receiver = left.text if left.kind == "name" and left.text != "this" and (j < 4 or not nodes[j - 3].is_(".") or nodes[j - 4].is_("this")) else "" if left.is_("this") and j == 2 else "?"
            self.calls.append(("call", receiver, nodes[j].text, arguments))


def simple_name(name: str) -> str:
    """Last part of a type's name without arguments, marks and namespace."""
    return re.sub(r"<.*|[\[?(].*", "", name).split(".")[-1]


def type_end(nodes: list[Node], i: int) -> int:
    """The place after the type that begins at i; 0 if none does."""
    k = i
    if k < len(nodes) and nodes[k].opens("("):  # a tuple
        k += 1
    else:
        while True:
            if k >= len(nodes) or nodes[k].kind != "name" or nodes[k].text in _NOT_CALLED - {"var"}:
                return 0
            k += 1
            if k < len(nodes):
                k = generic_end(nodes, k)
            if k < len(nodes) and nodes[k].is_(".", "::"):
                k += 1
                continue
            break
    while k < len(nodes) and (nodes[k].is_("?") or (nodes[k].opens("[") and not [x for x in nodes[k].inside if not x.is_(",")]) or nodes[k].is_("*")):
        k += 1
    return k


def parameters(nodes: list[Node]) -> list[tuple[str, str, bool]]:
    """Type, name and whether `this` marks it, of each parameter."""
    out = []
    for part in split(nodes, ","):
        part = [n for n in part if not n.opens("[") or n.inside == []]
        extends = any(n.is_("this") for n in part[:2])
        while part and part[0].is_("this", "ref", "out", "in", "params", "scoped", "readonly"):
            part = part[1:]
        t = type_end(part, 0)
        if t and t < len(part):
            out.append((text_of(part[:t]), part[t].text, extends))
    return out


def signature(source: str, nodes: list[Node], lo: int, hi: int) -> str:
    """The body's text with literals and local variables under common names: LIT_*, and v0, v1, ... as declared."""
    flat: list[Node] = []

    def walk(ns: list[Node]) -> None:
        for n in ns:
            if n.kind == "group":
                walk(n.inside)
                flat.append(Node("op", _CLOSE[n.text], n.end - 1, n.end))
            else:
                flat.append(n)
            if n.kind == "group":
                continue

    def declare(ns: list[Node]) -> None:
        for part in split(ns, ";"):
            while part and part[0].is_("using", "const", "await", "static", "else"):
                part = part[1:]
            for n in part:
                if n.kind == "group":
                    declare(n.inside)
            t = type_end(part, 0)
            starts = [k for k, n in enumerate(part) if n.opens("{")]
            if t and t < len(part) and part[t].kind == "name" and (t + 1 == len(part) or part[t + 1].is_("=", ",")):
                names.setdefault(part[t].text, (part[t].at, len(names)))
                for more in split(part[t + 1 :], ",")[1:]:
                    if more and more[0].kind == "name" and (len(more) == 1 or more[1].is_("=")):
                        names.setdefault(more[0].text, (more[0].at, len(names)))
            elif starts and starts[-1] + 1 < len(part):
                declare(part[starts[-1] + 1 :])

    names: dict[str, tuple[int, int]] = {}
    declare(nodes)
    order = {name: k for k, (name, _) in enumerate(sorted(names.items(), key=lambda x: x[1][0]))}
    walk(nodes)
    kinds = {"str": "LIT_STR", "num": "LIT_NUM", "char": "LIT_CHAR"}
    out, at, before = [], lo, None
    for n in sorted(flat, key=lambda x: x.at):
        new = None
        if n.kind in kinds and not n.text.startswith("$"):
            new = kinds[n.kind]
        elif n.kind == "name" and n.text in _LITERALS:
            new = _LITERALS[n.text]
        elif n.kind == "name" and n.text in order and n.at >= names[n.text][0] and not (before is not None and before.is_(".", "?.")):
            new = f"v{order[n.text]}"
        if new is not None:
            out += [source[at : n.at], new]
            at = n.end
        before = n
    return "".join([*out, source[at:hi]])


class File:
    """Everything declared in one file."""

    def __init__(self, path: str, source: str):
        self.path, self.source = path, source
        self.types: list[dict] = []
        self.methods: list[dict] = []
        self.calls: list[dict] = []
        nodes = tree(source)
        self.members(nodes, "", None, {})

    def line(self, at: int) -> int:
        return self.source.count("\n", 0, at) + 1

    def members(self, nodes: list[Node], space: str, owner: dict | None, fields: dict[str, str]) -> None:
        """Namespaces, types and methods among the nodes of a file, a namespace or a type."""
        i = 0
        loose: list[Node] = []
        while i < len(nodes):
            k = i
            while k < len(nodes) and nodes[k].opens("["):  # attributes
                k += 1
            words: list[str] = []
            while k < len(nodes) and nodes[k].kind == "name" and nodes[k].text in _MODIFIERS:
                words.append(nodes[k].text)
                k += 1
            if k >= len(nodes):
                break
            n = nodes[k]
            if n.is_("namespace"):
                e = k + 1
                while e < len(nodes) and not nodes[e].opens("{") and not nodes[e].is_(";"):
                    e += 1
                name = ".".join(x for x in (space, text_of(nodes[k + 1 : e])) if x)
                if e < len(nodes) and nodes[e].opens("{"):
                    self.members(nodes[e].inside, name, None, {})
                else:
                    space = name
                i = e + 1
                continue
            if n.kind == "name" and n.text in _TYPES and k + 1 < len(nodes) and nodes[k + 1].kind == "name":
                i = self.type_(nodes, k, words, space, owner)
                continue
            if n.is_("using", "extern") and owner is None and not (k + 1 < len(nodes) and nodes[k + 1].opens("(")) and not any(x.is_("=") and type_end(nodes, k + 1) for x in nodes[k + 2 : k + 4] if nodes[k + 1].is_("var")):
                while i < len(nodes) and not nodes[i].is_(";"):
                    i += 1
                i += 1
                continue
            if n.is_("delegate") and owner is None or n.is_("delegate") and not (k + 1 < len(nodes) and nodes[k + 1].opens("(")):
                e = k
                while e < len(nodes) and not nodes[e].is_(";"):
                    e += 1
                name = next((nodes[x - 1].text for x in range(k, e) if nodes[x].opens("(")), "")
                self.add_type(name, "Delegate", words, space, owner, [])
                i = e + 1
                continue
            if owner is None:  # a top-level statement
                e = Body().statement(nodes, i, 0, 0)
                loose += nodes[i:e]
                i = max(e, i + 1)
                continue
            i = self.member(nodes, k, words, space, owner, fields)
        if owner is None and loose:
            body = Body()
            body.block(loose, 0, 0)
            self.finish("<top-level>", "", body, fields, {})

    def add_type(self, name: str, kind: str, words: list[str], space: str, owner: dict | None, bases: list[str]) -> dict:
        full = f"{owner['full_name']}.{name}" if owner else ".".join(x for x in (space, name) if x)
        made = {"id": full, "name": name, "full_name": full, "kind": kind, "namespace": space, "is_static": "static" in words, "is_abstract": "abstract" in words or kind == "Interface", "is_sealed": "sealed" in words, "bases": bases}
        self.types.append(made)
        return made

    def type_(self, nodes: list[Node], k: int, words: list[str], space: str, owner: dict | None) -> int:
        kind = nodes[k].text
        k += 1
        if kind == "record" and nodes[k].is_("class", "struct"):
            k += 1
        name = nodes[k].text
        k += 1
        if k < len(nodes):
            e = generic_end(nodes, k)
            name += text_of(nodes[k:e])
            k = e
        if k < len(nodes) and nodes[k].opens("("):  # a primary constructor
            k += 1
        bases: list[str] = []
        if k < len(nodes) and nodes[k].is_(":"):
            e = k + 1
            while e < len(nodes) and not nodes[e].opens("{") and not nodes[e].is_(";", "where"):
                e += 1
            bases = [text_of([x for x in b if not x.opens("(")]) for b in split(nodes[k + 1 : e], ",") if b]
            k = e
        while k < len(nodes) and not nodes[k].opens("{") and not nodes[k].is_(";"):
            k += 1
        made = self.add_type(name, {"record": "Record"}.get(kind, kind.capitalize()), words, space, owner, bases)
        if k < len(nodes) and nodes[k].opens("{") and kind != "enum":
            fields: dict[str, str] = {}
            self.fields(nodes[k].inside, fields)
            self.members(nodes[k].inside, space, made, fields)
        return k + 1

    @staticmethod
    def fields(nodes: list[Node], out: dict[str, str]) -> None:
        """Types of fields and properties by name."""
        for k in range(len(nodes)):
            if k and not (nodes[k - 1].is_(";") or nodes[k - 1].kind == "group" or nodes[k - 1].text in _MODIFIERS):
                continue
            t = type_end(nodes, k)
            if t and t < len(nodes) and nodes[t].kind == "name" and (t + 1 == len(nodes) or nodes[t + 1].is_(";", "=", ",", "=>") or nodes[t + 1].opens("{")):
                out.setdefault(nodes[t].text, simple_name(text_of(nodes[k:t])))

    def member(self, nodes: list[Node], k: int, words: list[str], space: str, owner: dict, fields: dict[str, str]) -> int:
        """A field, property, event, method, constructor or operator of a type; only methods and constructors count."""
        start, constructor = k, nodes[k].kind == "name" and nodes[k].text == re.sub("<.*", "", owner["name"]) and k + 1 < len(nodes) and nodes[k + 1].opens("(")
        returns, t = "void", k
        if not constructor:
            t = type_end(nodes, k)
            returns = text_of(nodes[k:t]) if t else ""
        p = 0
        if t and t < len(nodes) and nodes[t].kind == "name" and not nodes[t].is_("operator", "this"):
            p = t + 1
            while p + 1 < len(nodes) and nodes[p].is_("."):  # explicitly implemented
                t, p = p + 1, p + 2
            p = generic_end(nodes, p) if p < len(nodes) else p
        end = k
        while end < len(nodes) and not nodes[end].is_(";", "=>", "=") and not nodes[end].opens("{"):
            end += 1
        if not p or p >= len(nodes) or not nodes[p].opens("(") or (end < len(nodes) and nodes[end].is_("=")):
            if end < len(nodes) and nodes[end].opens("{") and not (end + 1 < len(nodes) and nodes[end + 1].is_("=")):
                return end + 1
            while end < len(nodes) and not nodes[end].is_(";"):
                end += 1
            return end + 1
        takes = parameters(nodes[p].inside)
        body: list[Node] = []
        last = end
        if end < len(nodes) and nodes[end].opens("{"):
            body = [nodes[end]]
        elif end < len(nodes) and nodes[end].is_("=>"):
            last = end
            while last < len(nodes) and not nodes[last].is_(";"):
                last += 1
            body = nodes[end + 1 : last]
        name = ".ctor" if constructor else nodes[t].text + (text_of(nodes[t + 1 : p]) if p > t + 1 else "")
        inside = owner["kind"] == "Interface"
        chain = nodes[p + 1 : end] if constructor else []
        if any(n.is_("base", "this") for n in chain):
            at = next(n for n, x in enumerate(chain) if x.is_("base", "this"))
            words = [*words, f"chain:{chain[at].text}:{len(split(chain[at + 1].inside, ',')) if at + 1 < len(chain) and chain[at + 1].inside else 0}"]
        self.method(name, returns, takes, words, owner, nodes[start].at, nodes[min(last, len(nodes) - 1)].end, body, nodes[end].end if nodes[end : end + 1] and nodes[end].is_("=>") else None, inside, fields)
        return last + 1

    def method(self, name: str, returns: str, takes: list[tuple[str, str, bool]], words: list[str], owner: dict, lo: int, hi: int, body: list[Node], arrow: int | None, in_interface: bool, fields: dict[str, str], container: str | None = None) -> None:
        place = container or owner["full_name"]
        shown = "" if name == ".ctor" else f"{returns} "
        made = {
            "id": f"{place}.{name}({', '.join(t for t, _, _ in takes)})",
            "name": name,
            "full_name": f"{shown}{place}.{name}({', '.join(f'{t} {n}' for t, n, _ in takes)})",
            "return_type": returns,
            "type_id": owner["id"],
            "start_line": self.line(lo),
            "end_line": self.line(hi),
            "file_path": self.path,
            "is_static": "static" in words,
            "is_async": "async" in words,
            "is_virtual": "virtual" in words,
            "is_override": "override" in words,
            "is_abstract": "abstract" in words or (in_interface and not body),
            "accessibility": "Public" if "public" in words or (in_interface and not {"private", "protected", "internal"} & set(words)) else "Protected" if "protected" in words else "Internal" if "internal" in words else "Private",
            "is_extension": any(x for _, _, x in takes),
            "parameters": [t for t, _, _ in takes],
            "is_local": container is not None,
        }
        measured = Body()
        if body:
            if body[0].opens("{"):
                measured.block(body[0].inside, 0, 0)
            else:
                measured.value(body, 0, 0)
            at, end = body[0].at, body[-1].end
            made |= {"complexity": measured.complexity, "depth": measured.depth, "body": self.source[(arrow if arrow is not None else at) : end], "signature": signature(self.source, body[0].inside if body[0].opens("{") else body, at, end)}
        else:
            made |= {"complexity": None, "depth": None, "body": None, "signature": ""}
        made |= {"called": [n for _, _, n, _ in measured.calls if n and n != ".ctor"], "literals": measured.literals}
        self.methods.append(made)
        known = fields | {n: simple_name(t) for t, n, _ in takes} | measured.types
        for w in words:
            if w.startswith("chain:"):
                _, which, n = w.split(":")
                measured.calls.append((which, "", ".ctor", int(n)))
        self.finish(made["id"], re.sub("<.*", "", owner["name"]), measured, known, {b: simple_name(b) for b in owner["bases"]})
        for inner, of, takes_, inner_body in measured.locals:
            self.method(inner, text_of(of), parameters(takes_), [], owner, inner_body[0].at if inner_body else lo, inner_body[-1].end if inner_body else lo, inner_body, None, False, known, made["id"].split("(")[0])

    def finish(self, caller: str, owner: str, body: Body, known: dict[str, str], bases: dict[str, str]) -> None:
        """The calls of a body, with the type that each one's receiver is known to have; empty if it is not known."""
        own = {n for n, *_ in body.locals}
        for kind, receiver, name, n in body.calls:
            if kind == "new":
                target = receiver
            elif kind in ("base", "this"):
                target = owner if kind == "this" else next(iter(bases.values()), "")
            elif receiver == "":
                target = owner
            elif receiver == "?":
                target = ""
            elif receiver == "base":
                target = next(iter(bases.values()), "")
            else:
                target = known.get(receiver, receiver if receiver[:1].isupper() else "")
            if name and target != "var":
                self.calls.append({"caller_id": caller, "kind": kind, "target": target, "name": name, "n": n, "is_local": name in own, "on_receiver": receiver not in ("", "base")})


_TYPE = "struct<id:string,name:string,full_name:string,kind:string,namespace:string,is_static:boolean,is_abstract:boolean,is_sealed:boolean,bases:array<string>>"
_METHOD = "struct<id:string,name:string,full_name:string,return_type:string,type_id:string,start_line:int,end_line:int,file_path:string,is_static:boolean,is_async:boolean,is_virtual:boolean,is_override:boolean,is_abstract:boolean,accessibility:string,is_extension:boolean,parameters:array<string>,is_local:boolean,complexity:int,depth:int,body:string,signature:string,called:array<string>,literals:array<string>>"
_CALL = "struct<caller_id:string,kind:string,target:string,name:string,n:int,is_local:boolean,on_receiver:boolean>"
SCHEMA = f"path string, error string, types array<{_TYPE}>, methods array<{_METHOD}>, calls array<{_CALL}>"
#: Kinds of calls, the first that applies.
CALL_KINDS = ["Constructor", "Extension", "Interface", "Virtual", "Direct"]


def parse(files: DataFrame) -> DataFrame:
    """path, error, types, methods and calls of source files (path, text). Null texts are empty files."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    f = File(path, (text or "").lstrip("﻿"))
                    rows.append({"path": path, "error": None, "types": f.types, "methods": f.methods, "calls": f.calls})
                except (ValueError, RecursionError, IndexError) as e:  # the file's row says so; others go on
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}", "types": [], "methods": [], "calls": []})
            yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    return files.select("path", F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """path and text of all *.cs files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.cs").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.decode("content", "UTF-8").alias("text"))


def resolve(methods: DataFrame, types: DataFrame, calls: DataFrame) -> DataFrame:
    """caller_id, callee_id and kind of the calls whose target is known: a method of that name of the receiver's type,
    else of one of its bases, else of the only type that has one; by number of arguments, then the first by id."""
    short = lambda c: F.regexp_replace(F.element_at(F.split(c, r"\."), -1), "<.*", "")
    m = methods.select(F.col("id").alias("callee_id"), F.regexp_replace("name", "<.*", "").alias("name"), F.size("parameters").alias("takes"), "type_id", "is_extension", "is_virtual", "is_override", "is_abstract", "is_local")
    m = m.join(types.select(F.col("id").alias("type_id"), short(F.col("id")).alias("target"), F.col("kind").alias("type_kind")), "type_id")
    sites = materialize(calls.withColumn("site", F.monotonically_increasing_id()), "call-sites")
    direct = types.select(short(F.col("id")).alias("src"), F.explode("bases").alias("b")).select("src", short(F.col("b")).alias("dst"))
    from callatlas.operators.graph import closure

    up = closure(direct).select(F.col("src").alias("receiver"), F.col("dst").alias("target"), F.col("d").alias("far"))
    wide = sites.withColumnRenamed("target", "receiver")
    same = wide.select("*", F.col("receiver").alias("target"), F.lit(0).alias("far")).unionByName(wide.join(up, "receiver"))
    typed = same.where("target <> ''").join(m.where("not is_local"), ["target", "name"])
    one = m.where("not is_local").groupBy("name").agg(F.count_distinct("type_id").alias("n_types")).where("n_types = 1").select("name")
    loose = wide.where("name <> '.ctor'").withColumn("far", F.lit(1000)).join(m.where("not is_local").join(one, "name", "left_semi"), "name")
    local = wide.where("is_local").withColumn("far", F.lit(-1)).withColumn("prefix", F.concat(F.substring_index("caller_id", "(", 1), F.lit("."), "name"))
    inner = m.where("is_local").withColumn("prefix", F.substring_index("callee_id", "(", 1)).drop("name")
    own = local.drop("is_local").join(inner, "prefix")
    columns = ["site", "caller_id", "far", "n", "kind", "on_receiver", "callee_id", "name", "takes", "is_extension", "is_virtual", "is_override", "is_abstract", "type_kind"]
    drop = lambda d: d.select(*columns)
    found = drop(typed.drop("is_local")).unionByName(drop(loose.drop("is_local"))).unionByName(drop(own))
    misfit = F.abs(F.col("takes") - F.col("n") - F.when(F.col("is_extension") & F.col("on_receiver"), 1).otherwise(0))
    first = W.partitionBy("site").orderBy("far", misfit, "callee_id")  # the overloads of one call
    best = found.withColumn("rn", F.row_number().over(first)).where("rn = 1 and caller_id <> callee_id")
    kind = F.when(F.col("name") == ".ctor", CALL_KINDS[0]).when(F.col("is_extension"), CALL_KINDS[1]).when(F.col("type_kind") == "Interface", CALL_KINDS[2]).when(F.col("is_virtual") | F.col("is_abstract") | F.col("is_override"), CALL_KINDS[3]).otherwise(CALL_KINDS[4])
    return best.groupBy("caller_id", "callee_id").agg(F.min_by(kind, F.array_position(F.array(*map(F.lit, CALL_KINDS)), kind)).alias("kind"))


def ingest(spark: SparkSession, files: DataFrame, project: str = "project", project_path: str = "") -> tuple[GraphTables, DataFrame, DataFrame]:
    """Graph tables of source files (path, text); calls with their kinds; and files that could not be read, with why."""
    parsed = materialize(parse(files), "parsed")
    types = first_wins(parsed.select(F.explode("types").alias("t")).select("t.*"), ["id"])
    bases = parsed.select(F.explode("types").alias("t")).select(F.col("t.id").alias("type_id"), F.explode("t.bases").alias("base"))
    methods = parsed.select(F.explode("methods").alias("m")).select("m.*")
    methods = materialize(first_wins(methods, ["id"], ["file_path", "start_line"]), "methods")
    calls = materialize(resolve(methods, types, parsed.select(F.explode("calls").alias("c")).select("c.*")), "calls")
    known = types.where("kind = 'Interface'").select(F.col("full_name").alias("interface_id"), F.col("name").alias("base"))
    spaces = types.select(F.col("namespace").alias("full_name")).distinct()
    measured = methods.where("body is not null")
    tables = GraphTables(spark).with_tables(
        projects=spark.createDataFrame([(f"project:{project}", project, project_path)], "id string, name string, file_path string"),
        namespaces=spaces.select(F.concat(F.lit("ns:"), "full_name").alias("id"), "full_name", F.lit(f"project:{project}").alias("project_id")),
        types=types.withColumn("namespace_id", F.concat(F.lit("ns:"), "namespace")),
        methods=methods.where("not is_local"),
        method_calls=calls.select("caller_id", "callee_id"),
        type_implements=bases.withColumn("base", F.element_at(F.split(F.regexp_replace("base", "<.*", ""), r"\."), -1)).join(known.withColumn("base", F.regexp_replace("base", "<.*", "")), "base").select("type_id", "interface_id"),
        metrics=measured.select(F.col("id").alias("method_id"), F.col("complexity").alias("cognitive_complexity"), lines_of_code(F.col("body")).alias("lines_of_code"), F.col("depth").alias("nesting_depth")),
        normalized_methods=measured.where("not is_local").select(F.col("id").alias("method_id"), collapse_space(F.col("signature")).alias("structural_signature"), semantic_payload(F.col("name"), F.col("parameters"), F.col("return_type"), F.col("called"), F.col("literals")).alias("semantic_payload")),
    )
    return tables, calls, parsed.where("error is not null").select("path", "error")
