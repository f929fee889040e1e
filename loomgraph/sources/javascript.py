"""Imports, exports and dynamic imports of module sources: one row in, one row for each dependency out.

Catalyst has no parser for the language, so this is the one place where rows go through
Python (in Arrow batches). A lexer knows strings, templates, comments, regular expressions
and nesting; declarations are read at the top level only. Uses of imported names are found
by token, without scopes: a local name that shadows an imported one counts as a use.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = (
    "module_id long, dep_index int, dep_type string, request string, ids array<string>, name string, "
    "source_order int, in_block boolean, start int, end int, error string"
)
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (x.split(" ") for x in schema.split(", "))])


class Token(NamedTuple):
    kind: str  # name, string, template, punct, number, regex
    text: str
    start: int
    end: int
    depth: int


_LEX = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<number>\d[\w.]*)
    |(?P<name>[\w$\#@]+)
    |(?P<punct>=>|\.\.\.|\?\.|&&|\|\||[=!]==?|.)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "=>", "return", "typeof", "case", "in", "of", "void", "delete", "==", "===", "!=", "!=="}


def _template(source: str, at: int) -> tuple[int, bool]:
    """End of a template that starts at a backtick, and whether it has holes."""
    holes, i = False, at + 1
    while i < len(source):
        if source[i] == "\\":
            i += 2
        elif source[i] == "`":
            return i + 1, holes
        elif source.startswith("${", i):
            holes, depth, i = True, 1, i + 2
            while i < len(source) and depth:
                if source[i] == "`":
                    i, _ = _template(source, i)
                    continue
                depth += {"{": 1, "}": -1}.get(source[i], 0)
                i += 1
        else:
            i += 1
    raise SyntaxError("template has no end")


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    at = depth = 0
    while at < len(source):
        if source[at] == "`":
            end, holes = _template(source, at)
            out.append(Token("holes" if holes else "template", source[at:end], at, end, depth))
            at = end
            continue
        if source[at] == "/" and not source.startswith(("//", "/*"), at) and (not out or out[-1].text in _BEFORE_REGEX):
            if m := _REGEX.match(source, at):
                out.append(Token("regex", m[0], at, m.end(), depth))
                at = m.end()
                continue
        m = _LEX.match(source, at)
        kind, text = m.lastgroup, m[0]
        at = m.end()
        if kind == "space":
            continue
        if text in "\"'" or text == "/" and source.startswith("/*", m.start()):
            raise SyntaxError(f"string or comment has no end at {m.start()}")
        if text in ("}", ")", "]"):
            depth -= 1
        out.append(Token(kind, text, m.start(), m.end(), depth))
        if text in ("{", "(", "["):
            depth += 1
        if depth < 0:
            raise SyntaxError(f"{text} without a start at {m.start()}")
    if depth:
        raise SyntaxError("brackets have no end")
    return out


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


def literal(token: Token) -> str:
    """Value of a string or of a template without holes."""

    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "ux" and len(x) > 1:
            return chr(int(x[1:].strip("{}"), 16))
        return _ESCAPES.get(x, x)

    return re.sub(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.|\n)", one, token.text[1:-1], flags=re.S)


def _closing(ts: list[Token], at: int) -> int:
    return next(i for i in range(at + 1, len(ts)) if ts[i].depth == ts[at].depth and ts[i].text in ("}", ")", "]"))


def _specifiers(ts: list[Token]) -> Iterator[tuple[str, str]]:
    """(imported or local, alias) of a list in braces; type-only ones are left out."""
    part: list[Token] = []
    for t in [*ts, Token("punct", ",", 0, 0, 0)]:
        if t.text != ",":
            part.append(t)
            continue
        if part and not (part[0].text == "type" and len(part) > 1 and part[1].text != "as"):
            names = [literal(x) if x.kind == "string" else x.text for x in part if x.text != "as" or x.kind == "string"]
            if names:
                yield names[0], names[-1]
        part = []


class Extraction:
    """Dependencies of one source, in order."""

    def __init__(self, source: str):
        self.source, self.ts = source, tokens(source)
        self.rows: list[dict] = []
        self.bindings: dict[str, tuple[str, list[str], int]] = {}
        self.order = 0
        self.harmony = False
        self.skip: set[int] = set()
        self._declarations()
        self._uses()

    def _byte(self, at: int) -> int:
        return len(self.source[:at].encode())

    def _add(self, kind: str, first: Token, last: Token, request=None, ids=(), name=None, order=None, block=False, error=None) -> None:
        self.rows.append(
            {"dep_type": kind, "request": request, "ids": list(ids), "name": name, "source_order": order, "in_block": block,
             "start": self._byte(first.start), "end": self._byte(last.end), "error": error}
        )

    def _module(self, at: int) -> tuple[int, int]:
        """Of a declaration that names a module: indices of that string and of the last token (attributes may follow)."""
        ts = self.ts
        for i in range(at + 1, len(ts)):
            if ts[i].kind == "string" and ts[i].depth == ts[at].depth and ts[i - 1].text in ("from", "import"):
                with_attributes = i + 2 < len(ts) and ts[i + 1].text == "with" and ts[i + 2].text == "{"
                return i, _closing(ts, i + 2) if with_attributes else i
        raise SyntaxError("module name expected")

    def _declarations(self) -> None:
        i, ts = 0, self.ts
        while i < len(ts):
            t = ts[i]
            starts = i == 0 or ts[i - 1].text in (";", "}") or "\n" in self.source[ts[i - 1].end : t.start] or i in self.skip
            if t.depth == 0 and t.kind == "name" and t.text == "import" and starts and ts[i + 1].text not in ("(", "."):
                i = self._import(i)
            elif t.depth == 0 and t.kind == "name" and t.text == "export" and starts:
                i = self._export(i)
            else:
                i += 1

    def _import(self, at: int) -> int:
        ts, self.harmony = self.ts, True
        source, end = self._module(at)
        self.skip.update(range(at, end + 1))
        if ts[at + 1].text == "type" and ts[at + 2].text not in ("from", ","):
            return end + 1
        request = literal(ts[source])
        self.order += 1
        self._add("import_side_effect", ts[at], ts[end], request, order=self.order)
        i = at + 1
        while i < source:
            if ts[i].text == "{":
                close = _closing(ts, i)
                for name, local in _specifiers(ts[i + 1 : close]):
                    self.bindings[local] = (request, [name], self.order)
                i = close + 1
            elif ts[i].text == "*":
                self.bindings[ts[i + 2].text] = (request, [], self.order)
                i += 3
            else:
                if ts[i].kind == "name" and ts[i].text != "from":
                    self.bindings[ts[i].text] = (request, ["default"], self.order)
                i += 1
        return end + 1

    def _export(self, at: int) -> int:
        ts, self.harmony = self.ts, True
        nxt = ts[at + 1]
        if nxt.text == "type" and ts[at + 2].text in ("{", "*"):
            end = _closing(ts, at + 2) if ts[at + 2].text == "{" else at + 2
            if end + 1 < len(ts) and ts[end + 1].text == "from":
                end += 2
            self.skip.update(range(at, end + 1))
            return end + 1
        if nxt.text == "*":
            source, end = self._module(at)
            alias = ts[at + 3] if ts[at + 2].text == "as" else None
            name = (literal(alias) if alias.kind == "string" else alias.text) if alias else None
            request = literal(ts[source])
            self.order += 1
            self._add("import_side_effect", ts[at], ts[end], request, order=self.order)
            self._add("export_imported" if name else "export_star", ts[at], ts[end], request, [], name, self.order)
            self.skip.update(range(at, end + 1))
            return end + 1
        if nxt.text == "{":
            close = _closing(ts, at + 1)
            pairs = list(_specifiers(ts[at + 2 : close]))
            if close + 1 < len(ts) and ts[close + 1].text == "from":
                source, end = self._module(at)
                request = literal(ts[source])
                self.order += 1
                self._add("import_side_effect", ts[at], ts[end], request, order=self.order)
                for local, name in pairs:
                    self._add("export_imported", ts[at], ts[end], request, [local], name, self.order)
            else:
                end = close
                for local, name in pairs:
                    self._add("export_specifier", ts[at], ts[close], None, [local], name)
            self.skip.update(range(at, end + 1))
            return end + 1
        if nxt.text == "default":
            self._add("export_expression", ts[at], nxt, name="default")
            return at + 2
        i = at + 1
        while ts[i].text in ("async", "function", "*", "class"):
            i += 1
        if ts[i].text in ("const", "let", "var"):
            for name in self._pattern_names(i + 1):
                self._add("export_specifier", ts[at], ts[i], None, [name], name)
        else:
            self._add("export_specifier", ts[at], ts[i], None, [ts[i].text], ts[i].text)
        self.skip.update(range(at, i + 1))
        return i + 1

    def _pattern_names(self, at: int) -> list[str]:
        """Names that a declaration list binds: plain, or in array and object patterns with defaults and rests."""
        ts, out, i = self.ts, [], at
        while i < len(ts):
            if ts[i].text in ("{", "["):
                close = _closing(ts, i)
                out += self._inner(i, close)
                i = close + 1
            else:
                out.append(ts[i].text)
                i += 1
            while i < len(ts) and not (ts[i].depth == ts[at].depth and ts[i].text in (",", ";")):
                here = ts[i]
                if here.depth == ts[at].depth and i > at and "\n" in self.source[ts[i - 1].end : here.start] and here.kind == "name" and ts[i - 1].text not in ("=", ",", "=>"):
                    return out
                i += 1
            if i >= len(ts) or ts[i].text == ";":
                break
            i += 1
        return out

    def _inner(self, open_: int, close: int) -> list[str]:
        ts, out, part = self.ts, [], []
        depth = ts[open_].depth + 1
        for t_i in [*range(open_ + 1, close), close]:
            t = ts[t_i]
            if t_i != close and not (t.text == "," and t.depth == depth):
                part.append(t_i)
                continue
            if part:
                colon = next((k for k in part if ts[k].text == ":" and ts[k].depth == depth), None)
                target = [k for k in part if colon is None or k > colon]
                target = [k for k in target if ts[k].text != "..."]
                if target and ts[target[0]].text in ("{", "["):
                    out += self._inner(target[0], _closing(ts, target[0]))
                elif target:
                    out.append(ts[target[0]].text)
            part = []
        return out

    def _uses(self) -> None:
        ts = self.ts
        for i, t in enumerate(ts):
            if i in self.skip or t.kind != "name":
                continue
            if t.text == "import" and i + 2 < len(ts) and ts[i + 1].text == "(":
                arg = ts[i + 2]
                if arg.kind in ("string", "template") and ts[i + 3].text in (")", ","):
                    self._add("import", t, ts[_closing(ts, i + 1)], literal(arg), block=True)
                else:
                    self._add("import", t, arg, block=True, error="only literal requests can be imported")
            if t.text in self.bindings and not (i and ts[i - 1].text in (".", "?.")):
                if i + 1 < len(ts) and ts[i + 1].text == ":" and i and ts[i - 1].text in ("{", ","):
                    continue
                request, ids, order = self.bindings[t.text]
                member = []
                if not ids and i + 2 < len(ts) and ts[i + 1].text == "." and ts[i + 2].kind == "name":
                    member = [ts[i + 2].text]
                self._add("import_specifier", t, t, request, [*ids, *member], t.text, order)

    def resolved(self) -> list[dict]:
        """The rows in source order; exports of imported bindings become edges to their module."""
        out = []
        for r in self.rows:
            if r["dep_type"] == "export_specifier" and r["ids"] and r["ids"][0] in self.bindings:
                request, ids, order = self.bindings[r["ids"][0]]
                r = r | {"dep_type": "export_imported", "request": request, "ids": ids, "source_order": order}
            out.append(r)
        return sorted(out, key=lambda r: (r["start"], r["source_order"] or 0))

    def facts(self) -> dict:
        names = sorted({t.text for t in self.ts if t.kind == "name" and not t.text[0].isdigit()})
        calls = any(t.text == "eval" and t.kind == "name" and self.ts[i + 1 : i + 2] and self.ts[i + 1].text == "(" and (i == 0 or self.ts[i - 1].text != ".") for i, t in enumerate(self.ts))
        return {"harmony": self.harmony, "identifiers": names, "uses_eval": calls}


def extract(source: str | None) -> list[dict]:
    """Dependencies of a source; one error row where it can't be read."""
    try:
        return Extraction(source or "").resolved()
    except (SyntaxError, StopIteration, IndexError, RecursionError) as e:
        return [{"dep_type": "error", "ids": [], "error": str(e) or "unexpected end"}]


def dependencies(modules: DataFrame) -> DataFrame:
    """modules(module_id, source): a row for each dependency, offsets in UTF-8 bytes."""
    schema = _arrow(SCHEMA)

    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            for module, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [{"module_id": module, "dep_index": i, **r} for i, r in enumerate(extract(source))]
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return modules.select("module_id", "source").mapInArrow(run, SCHEMA)


FACTS = "module_id long, harmony boolean, identifiers array<string>, uses_eval boolean"


def module_facts(modules: DataFrame) -> DataFrame:
    """(module_id, harmony, identifiers, uses_eval); nulls where a source can't be read."""
    schema = _arrow(FACTS)

    def facts(source: str | None) -> dict:
        try:
            return Extraction(source or "").facts()
        except (SyntaxError, StopIteration, IndexError, RecursionError):
            return {}

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_pylist([{"module_id": m, **facts(s)} for m, s in pairs], schema=schema)

    return modules.select("module_id", "source").mapInArrow(run, FACTS)


def json_module(source: str) -> list[str]:
    """Names that a JSON module provides: default and an object's keys."""
    value = json.loads(source.removeprefix("﻿"))
    return ["default", *(k for k in value if k != "default")] if isinstance(value, dict) else ["default"]
