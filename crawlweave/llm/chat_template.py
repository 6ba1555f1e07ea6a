"""A small template language for chats, compiled to closures.

Text with ``{{ value }}``, ``{% for x in xs %} .. {% endfor %}``, ``{% if a %} ..
{% elif b %} .. {% else %} .. {% endif %}`` and ``{% generation %} ..
{% endgeneration %}``. Values are strings, whole numbers, names, fields
(``m.role``), ``+``, ``==``, ``!=``, ``not``, ``and``, ``or``, brackets, and
filters (``m.text | escape``).

The language is sandboxed by what it lacks: no calls, no attributes of Python
objects (a field is a key of a dictionary), no loops but over given lists, no
assignment. A template is parsed to a tree once, parts without names are
computed then, neighbouring texts are joined, and every node becomes one closure.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:('[^']*'|"[^"]*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+().|]))""")


class TemplateError(ValueError):
    """The template does not follow the language."""


def escape(text: str) -> str:
    """No ``<|`` is left: ``<``, any backslashes, ``|`` get one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_name(text: str) -> str:
    """As ``escape``, on one line."""
    return escape(text.replace("%", "%25").replace("\n", "%0A"))


def unescape_name(text: str) -> str:
    return unescape(text).replace("%0A", "\n").replace("%25", "%")


FILTERS: Mapping[str, Callable[[str], str]] = {
    "escape": escape,
    "escape_name": escape_name,
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
}


class _Values:
    """Recursive descent over one expression; the tree is made of tuples."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = ("text", "number", "name", "sign")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if kind != "text" and value in wanted:
                self.at += 1
                return value
        return None

    def whole(self):
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self):
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        left = self.added()
        sign = self.take("==", "!=")
        return (sign, left, self.added()) if sign else left

    def added(self):
        left = self.filtered()
        while self.take("+"):
            left = ("+", left, self.filtered())
        return left

    def filtered(self):
        tree = self.single()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind != "name":
            raise TemplateError(f"a name is wanted, not {value!r}")
        self.at += 1
        return value

    def single(self):
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] in ("text", "number"):
            kind, value = self.tokens[self.at]
            self.at += 1
            tree = ("const", value[1:-1] if kind == "text" else int(value))
        else:
            tree = ("name", self.name())
        while self.take("."):
            tree = ("field", tree, self.name())
        return tree


def parse(source: str):
    """The template's tree."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PARTS.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("value", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    place = 0

    def block(*ends: str):
        nonlocal place
        body = []
        while place < len(parts):
            kind, value = parts[place]
            place += 1
            if kind == "text":
                body.append(("print", ("const", value)))
            elif kind == "value":
                body.append(("print", _Values(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return ("block", body), word, rest
                body.append(tag(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", body), "", ""

    def tag(word: str, rest: str):
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read for {rest!r}")
            return ("for", m[1], _Values(m[2]).whole(), block("endfor")[0])
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        if word == "if":
            test = _Values(rest).whole()
            body, end, more = block("elif", "else", "endif")
            if end == "elif":
                return ("if", test, body, tag("if", more))
            other = block("endif")[0] if end == "else" else ("block", [])
            return ("if", test, body, other)
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


def _show(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _plus(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, int) and isinstance(b, int) else _show(a) + _show(b)


_TWO: Mapping[str, Callable[[Any, Any], Any]] = {
    "+": _plus,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def fold(tree):
    """Compute what has no names, drop branches that cannot be taken, join texts."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "field":
        return ("field", fold(tree[1]), tree[2])
    if kind == "filter":
        value = fold(tree[2])
        if value[0] == "const":
            return ("const", FILTERS[tree[1]](_show(value[1])))
        return ("filter", tree[1], value)
    if kind == "not":
        value = fold(tree[1])
        return ("const", not value[1]) if value[0] == "const" else ("not", value)
    if kind in ("and", "or"):
        left, right = fold(tree[1]), fold(tree[2])
        if left[0] == "const":
            return right if bool(left[1]) == (kind == "and") else left
        return (kind, left, right)
    if kind in _TWO:
        left, right = fold(tree[1]), fold(tree[2])
        if left[0] == right[0] == "const":
            return ("const", _TWO[kind](left[1], right[1]))
        return (kind, left, right)
    if kind == "print":
        value = fold(tree[1])
        return ("print", ("const", _show(value[1])) if value[0] == "const" else value)
    if kind == "for":
        return ("for", tree[1], fold(tree[2]), fold(tree[3]))
    if kind == "generation":
        return ("generation", fold(tree[1]))
    if kind == "if":
        test, yes, no = (fold(t) for t in tree[1:])
        if test[0] == "const":
            return yes if test[1] else no
        return ("if", test, yes, no)
    body = []
    for node in map(fold, tree[1]):
        for part in node[1] if node[0] == "block" else [node]:
            if part[0] == "print" and part[1][0] == "const":
                if not part[1][1]:
                    continue
                if body and body[-1][0] == "print" and body[-1][1][0] == "const":
                    body[-1] = ("print", ("const", body[-1][1][1] + part[1][1]))
                    continue
            body.append(part)
    return ("block", body)


def _value(tree) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "const":
        constant = tree[1]
        return lambda env: constant
    if kind == "name":
        name = tree[1]
        return lambda env: env.get(name)
    if kind == "field":
        inner, key = _value(tree[1]), tree[2]

        def field(env):
            holder = inner(env)
            return holder.get(key) if isinstance(holder, dict) else None

        return field
    if kind == "filter":
        change, inner = FILTERS[tree[1]], _value(tree[2])
        return lambda env: change(_show(inner(env)))
    if kind == "not":
        inner = _value(tree[1])
        return lambda env: not inner(env)
    left, right = _value(tree[1]), _value(tree[2])
    if kind == "and":
        return lambda env: left(env) and right(env)
    if kind == "or":
        return lambda env: left(env) or right(env)
    two = _TWO[kind]
    return lambda env: two(left(env), right(env))


class _Page:
    """What has been written, its length, and the spans inside generation marks."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _writer(tree) -> Callable[[dict, _Page], None]:
    kind = tree[0]
    if kind == "print":
        if tree[1][0] == "const":
            text = tree[1][1]
            return lambda env, page: page.write(text)
        value = _value(tree[1])
        return lambda env, page: page.write(_show(value(env)))
    if kind == "for":
        name, items, body = tree[1], _value(tree[2]), _writer(tree[3])

        def loop(env, page):
            inner = dict(env)
            for item in items(env) or ():
                inner[name] = item
                body(inner, page)

        return loop
    if kind == "if":
        test, yes, no = _value(tree[1]), _writer(tree[2]), _writer(tree[3])
        return lambda env, page: (yes if test(env) else no)(env, page)
    if kind == "generation":
        body = _writer(tree[1])

        def generation(env, page):
            start = page.length
            body(env, page)
            page.spans.append((start, page.length))

        return generation
    steps = [_writer(node) for node in tree[1]]

    def block(env, page):
        for step in steps:
            step(env, page)

    return block


def compile_template(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages to the text and its generation spans (code points)."""
    write = _writer(fold(parse(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        page = _Page()
        write({"messages": messages}, page)
        return "".join(page.parts), page.spans

    return render
