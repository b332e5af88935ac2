"""A lexer of TypeScript, Python, Rust and Go-like texts, and what they declare and call.

Comments and white space are dropped. Texts in quotes, templates with what is
nested in them, and regular expressions are told from code, so names in them are
neither declared nor called. The parser follows brackets or, in Python, indents:
it knows which class a function is in, not what a name refers to.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

_NUMBER = r"(?P<number>\d(?:[\w.]|(?<=[eE])[+-])*)"
_WORD = r"(?P<word>[^\W\d]\w*|\$[\w$]*)"
_MARK = r"(?P<mark>=>|->|::|\.\.\.|[=!<>]==?|&&|\|\||.)"
_SLASHES = r"\s+|//[^\n]*|/\*(?:.|\n)*?(?:\*/|\Z)"


def _scanner(skip: str, string: str, word: str = _WORD) -> re.Pattern:
    return re.compile(f"(?P<skip>{skip})|(?P<string>{string})|{_NUMBER}|{word}|{_MARK}", re.S)


_QUOTED = r'"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?'
TOKENS = {
    "py": _scanner(r"\s+|\#[^\n]*|\\\r?\n", r"""(?i:[rbfut]{0,2})(?:\"{3}(?:\\.|.)*?(?:\"{3}|\Z)|'{3}(?:\\.|.)*?(?:'{3}|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)"""),
    "rs": _scanner(_SLASHES, r"""b?r(?P<hash>\#*)".*?"(?P=hash)|b?"(?:\\.|[^"\\])*"|b?'(?:\\[^\n]+?|[^'\\\n])'""", r"(?P<word>r\#\w+|'?[^\W\d]\w*)"),
    "go": _scanner(_SLASHES, rf"{_QUOTED}|`[^`]*`?"),
    "ts": _scanner(_SLASHES, _QUOTED),
}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(?P<end>`|\$\{|\Z)", re.S)
#: Words after which a slash begins an expression.
_BEFORE_VALUE = frozenset("return typeof case in of do else void delete instanceof new throw await yield".split())


def tokens(text: str, language: str) -> Iterator[tuple[str, str, int]]:
    """kind (word, number, string, regex, mark), text and line of each token; a template is a string for each part between what is nested in it."""
    scanner = TOKENS.get(language, TOKENS["go"])
    at, line, depth, nested, last = 0, 1, 0, [], ("", "")
    while at < len(text):
        kind, m = None, None
        if language == "ts":
            c = text[at]
            resumed = c == "}" and nested and nested[-1] == depth
            if c == "`" or resumed:
                if resumed:
                    nested.pop()
                m = _TEMPLATE.match(text, at + 1)
                kind, end = "string", m.end()
                if m["end"] == "${":
                    nested.append(depth)
            elif c == "/" and not text.startswith(("//", "/*"), at):
                value = last[0] in ("number", "string", "regex") or (last[0] == "word" and last[1] not in _BEFORE_VALUE) or last[1] in (")", "]", "}")
                m = None if value else _REGEX.match(text, at)
                kind, end = ("regex", m.end()) if m else (None, at)
        if kind is None:
            m = scanner.match(text, at)
            kind, end = next(k for k in ("skip", "string", "number", "word", "mark") if m[k] is not None), m.end()
        if kind != "skip":
            token = text[at:end]
            yield kind, token, line
            last = (kind, token)
            depth += (token == "{") - (token == "}") if kind == "mark" else 0
        line += text.count("\n", at, end)
        at = max(end, at + 1)


@dataclass
class _Scope:
    """A class or function, and where it ends: at a bracket depth, or at an indent."""

    name: str
    kind: str
    level: int


KEYWORDS = frozenset("if for while switch return function def class match catch fn func impl elif else with assert await yield not and or in is lambda super typeof async loop use struct enum trait interface type".split())
_TYPES = {"class": "class", "interface": "type", "type": "type", "enum": "type", "struct": "type", "trait": "type", "union": "type"}
_FUNCTIONS = frozenset(("function", "def", "fn", "func"))


def declarations(text: str, language: str) -> Iterator[tuple[str, str, int]]:
    """What a text declares (function, method, class, type) and calls, with the name and line; methods as Class.name."""
    t = list(tokens(text, language))
    indent = [len(x) - len(x.lstrip()) for x in text.expandtabs(8).split("\n")] if language == "py" else []
    scopes: list[_Scope] = []
    waiting: _Scope | None = None  # declared, its bracket not yet open
    depth = parens = 0
    word = lambda i: t[i][1] if 0 <= i < len(t) else ""
    for i, (kind, name, line) in enumerate(t):
        if language == "py" and (i == 0 or t[i - 1][2] != line) and not parens:
            while scopes and indent[line - 1] <= scopes[-1].level:
                scopes.pop()
        if kind == "mark":
            parens += (name in "([") - (name in ")]")
            if name == "{":
                depth += 1
                if waiting and not parens:
                    scopes.append(_Scope(waiting.name, waiting.kind, depth))
                    waiting = None
            elif name == "}":
                if scopes and scopes[-1].level == depth and language != "py":
                    scopes.pop()
                depth -= 1
            elif name == ";" and not parens:
                waiting = None
            continue
        if kind != "word":
            continue
        before, after = word(i - 1), word(i + 1)
        inside = scopes[-1] if scopes and scopes[-1].kind == "class" and (language == "py" or scopes[-1].level == depth) else None

        def declared(what: str, own: str = name, line: int = line, inside: _Scope | None = inside, opens: bool = True) -> tuple[str, str, int]:
            nonlocal waiting
            full = f"{inside.name}.{own}" if inside and what == "method" else own
            if opens:
                scope = _Scope(full, "class" if what in ("class", "type") else "function", indent[line - 1] if language == "py" else 0)
                if language == "py":
                    scopes.append(scope)
                else:
                    waiting = scope
            return what, full, line

        if before in _FUNCTIONS or (before == "*" and word(i - 2) == "function"):
            yield declared("method" if inside else "function")
        elif language == "go" and before == ")" and after == "(" and _receiver(t, i):
            yield "method", f"{_receiver(t, i)}.{name}", line
            waiting = _Scope(name, "function", 0)
        elif before == "class" or (before in _TYPES and after not in ("(", "=", ".", ",", ")")) or (before == "type" and after in ("=", "struct", "interface", "<")):
            yield declared(_TYPES[before])
        elif language == "rs" and before in ("impl", ">") and (head := _implemented(t, i)):
            waiting = _Scope(head, "class", 0)
        elif language == "ts" and inside and after == "(" and before in ("{", "}", ";", "async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", ")", "*"):
            yield declared("method", opens=_has_body(t, i + 1))
        elif language == "ts" and before in ("const", "let", "var") and after == "=" and (word(i + 2) in ("function", "async") or _arrow(t, i + 2)):
            yield declared("function", opens=False)
        elif after == "(" or (language == "rs" and after == "!" and word(i + 2) == "("):
            if name not in KEYWORDS and before not in ("class", "func"):
                chain, k = [name], i
                while word(k - 1) in (".", "::") and k >= 2 and t[k - 2][0] == "word":
                    chain.insert(0, t[k - 2][1])
                    k -= 2
                yield "calls", ".".join(chain), line


def _closing(t: list, i: int) -> int:
    """The place of the bracket that closes the one at ``i``."""
    depth = 0
    for k in range(i, len(t)):
        if t[k][0] == "mark":
            depth += (t[k][1] in "([{") - (t[k][1] in ")]}")
            if depth == 0:
                return k
    return len(t)


def _has_body(t: list, i: int) -> bool:
    """Whether what follows the parameters that open at ``i`` is a body, after a type perhaps."""
    for k in range(_closing(t, i) + 1, min(len(t), _closing(t, i) + 40)):
        if t[k][1] == "{":
            return True
        if t[k][1] in (";", "=", "}", ")") or t[k][0] == "number":
            return False
    return False


def _arrow(t: list, i: int) -> bool:
    end = _closing(t, i) if i < len(t) and t[i][1] == "(" else i
    return any(x[1] == "=>" for x in t[end + 1 : end + 8])


def _receiver(t: list, i: int) -> str:
    """The type of a Go method's receiver, whose parameters end before its name."""
    k = i - 2
    names = []
    while k >= 0 and t[k][1] != "(":
        if t[k][0] == "word":
            names.append(t[k][1])
        k -= 1
    return names[0] if names and k >= 1 and t[k - 1][1] == "func" else ""


def _implemented(t: list, i: int) -> str:
    """The type that an impl block is for, if the word at ``i`` begins its head."""
    k = i - 1
    while k >= 0 and t[k][1] != "impl":
        if t[k][1] in ("{", "}", ";", "(", "fn"):
            return ""
        k -= 1
    head = [x[1] for x in t[i : i + 40]]
    if "{" not in head or k < 0:
        return ""
    head = head[: head.index("{")]
    return head[head.index("for") + 1] if "for" in head[:-1] else head[0]


def parse(texts: DataFrame, what: Callable, language: str) -> DataFrame:
    """(id, a, b, line) of ``tokens`` or ``declarations`` of each text; a null one is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *r) for i, t in zip(b["id"], b["text"], strict=True) for r in what(t or "", language)], columns=["id", "a", "b", "line"])

    return texts.select("id", "text").mapInPandas(run, "id string, a string, b string, line long")
