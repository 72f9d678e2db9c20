"""Rust, TypeScript and JavaScript sources: functions, calls, control flow, data flow and symbols.

Files are cut into tokens, brackets are paired, and statements are read by their first words: that is enough for
functions and branches, without types or name resolution. A file whose brackets do not pair gives nothing, as a file
with a syntax error would. One Arrow pass reads a file at a time; a null text is empty.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.operators.repo import language
from prosemill.session import ship

LANGUAGES = ("rust", "typescript", "javascript")
_SKIP = r"\s+|//[^\n]*|/\*.*?\*/"
_OPS = r"=>|->|::|&&|\|\||\.\.=|\.\.\.|\.\.|[-+*/%^&|]=|[=!<>]=+|\?\.|\?\?|."
_NAME = r"(?:r#)?[^\W\d][\w$]*|[$#][\w$]+"
_RUST = re.compile(rf"(?P<skip>{_SKIP})|(?P<text>b?r(?P<h>#*)\".*?\"(?P=h)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\.[^']*|[^'\\])')|(?P<life>'\w+)|(?P<id>{_NAME})|(?P<number>\d\w*(?:\.\d\w*)?)|(?P<op>{_OPS})", re.S)
_SCRIPT = re.compile(rf"(?P<skip>{_SKIP})|(?P<text>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<id>{_NAME})|(?P<number>\d[\w.]*)|(?P<op>{_OPS})", re.S)
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])*/\w*")
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_NO_CALL = {"if", "for", "while", "switch", "match", "return", "catch", "function", "fn", "in", "of", "await", "typeof", "super", "new", "throw", "as", "move", "else", "let", "const", "mut", "ref", "use", "impl", "where", "loop", "constructor", "import", "async"}
_PANICS, _EXITS, _ASSERTS = {"panic", "unreachable", "todo", "unimplemented"}, {"exit", "abort"}, {"assert", "assert_eq", "assert_ne", "debug_assert", "debug_assert_eq", "debug_assert_ne"}
_MODIFIERS = {"public", "private", "protected", "static", "async", "get", "set", "readonly", "abstract", "override", "declare", "*"}
_PLAIN_TYPES = {"string", "number", "boolean", "any", "void", "unknown", "never", "null", "undefined", "object", "symbol", "bigint", "this"}


@dataclass
class Function:
    name: str
    kind: str
    params: list[str]
    start: int
    open: int
    close: int
    group: tuple[int, int]
    expression: bool = False


@dataclass
class Statement:
    """``kind``: plain, return, panic, exit, break, continue, if, loop, match or try; ``parts``: (label, statements)."""

    kind: str
    lo: int
    hi: int
    test: tuple[int, int] | None = None
    parts: list[tuple[str | None, list[Statement]]] = field(default_factory=list)
    last: list[Statement] | None = None
    endless: bool = False


class Source:
    """The tokens of a file, where brackets close, and what can be read off them."""

    def __init__(self, text: str, rust: bool):
        self.raw, self.rust = text, rust
        self.text, self.kind, self.line, self.at, self.to = [], [], [], [], []
        place, line, pattern, previous = 0, 1, _RUST if rust else _SCRIPT, ""
        while place < len(text):
            m = pattern.match(text, place)
            kind = m.lastgroup if m.lastgroup != "h" else "text"
            if not rust and m[0] in ("/", "/=") and (previous in ("", "return", "(", "[", "{", "}", ",", ";", ":", "?", "!", "=", "=>", "&&", "||")) and (own := _PATTERN.match(text, place)):
                m, kind = own, "text"
            if kind != "skip":
                self.text.append(m[0])
                self.kind.append(kind)
                self.line.append(line)
                self.at.append(m.start())
                self.to.append(m.end())
                previous = m[0]
            line += m[0].count("\n")
            place = m.end()
        self.close, open_ = {}, []
        for i, (t, k) in enumerate(zip(self.text, self.kind)):
            if k == "op" and t in _CLOSE:
                open_.append(i)
            elif k == "op" and t in ")]}":
                if not open_ or _CLOSE[self.text[open_[-1]]] != t:
                    raise ValueError("brackets do not pair")
                self.close[open_.pop()] = i
        if open_:
            raise ValueError("a bracket stays open")
        self.n = len(self.text)
        self.types: list[tuple[str, str, int]] = []  # (name, kind, line) of traits, interfaces and classes
        self.implemented: list[tuple[str, str, int]] = []  # (name, of, line)

    def get(self, i: int) -> str:
        return self.text[i] if 0 <= i < self.n and self.kind[i] != "text" else ""

    def source(self, lo: int, hi: int) -> str:
        return self.raw[self.at[lo] : self.to[hi - 1]] if lo < hi else ""

    def find(self, lo: int, hi: int, *wanted: str) -> int:
        """The first of some tokens outside brackets, or ``hi``."""
        while lo < hi:
            if self.get(lo) in wanted:
                return lo
            lo = self.close.get(lo, lo) + 1
        return hi

    def angles(self, i: int) -> int:
        """Behind the type parameters that begin here, if any do."""
        if self.get(i) != "<":
            return i
        depth = 0
        while i < self.n:
            depth += {"<": 1, ">": -1}.get(self.get(i), 0)
            i += 1
            if not depth:
                return i
        return i

    def split(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """What commas outside brackets and type parameters part."""
        out, start, depth, i = [], lo, 0, lo
        while i < hi:
            t = self.get(i)
            depth = max(0, depth + {"<": 1, ">": -1}.get(t, 0))
            if t == "," and not depth:
                out.append((start, i))
                start = i + 1
            i = self.close.get(i, i) + 1
        return [x for x in [*out, (start, hi)] if x[0] < x[1]]

    def names(self, lo: int, hi: int) -> list[str]:
        """Names that a pattern binds: lower-case ones before a type."""
        return [t for i in range(lo, hi) if self.kind[i] == "id" and (t := self.text[i]) not in ("mut", "ref", "box") and not t[0].isupper() and self.get(i + 1) not in ("::", "(", "{") and self.get(i - 1) != "::"]

    def params(self, lo: int, hi: int) -> list[str]:
        out = []
        for a, b in self.split(lo, hi):
            if self.rust:
                out += self.names(a, self.find(a, b, ":")) or ["_"]
            else:
                while self.get(a) in _MODIFIERS or self.get(a) == "...":
                    a += 1
                out.append(self.text[a])
        return out

    def functions(self) -> list[Function]:
        out: list[Function] = []
        self._walk(0, self.n, "", out)
        return out

    def _add(self, out: list[Function], name: str, prefix: str, start: int, group: int) -> int:
        """A function whose parameters stand in brackets at ``group``; the place behind it."""
        end, i = self.close[group], self.close[group] + 1
        if not self.rust and self.get(i) == ":":
            # braces behind these are part of the type
            while i < self.n and (self.get(i) not in ("{", ";", "=>", "=") or (self.get(i) == "{" and self.get(i - 1) in (":", "|", "&", "<", ","))):
                i = self.close.get(i, i) + 1
        else:
            i = self.find(i, self.n, "{", ";") if self.rust else i
        arrow = self.get(i) == "=>"
        i += arrow
        params, kind = self.params(group + 1, end), "method" if prefix else "function"
        if self.get(i) == "{":
            out.append(Function(prefix + name, kind, params, start, i + 1, self.close[i], (group + 1, end)))
            return self.close[i] + 1
        if arrow:
            stop = self._end(i, self.n)
            out.append(Function(prefix + name, kind, params, start, i, stop, (group + 1, end), True))
            return stop
        return i + 1

    def _walk(self, lo: int, hi: int, prefix: str, out: list[Function]) -> None:
        i = lo
        while i < hi:
            t, word = self.get(i), self.kind[i] == "id"
            if self.rust and t == "fn" and i + 1 < hi and self.kind[i + 1] == "id":
                group = self.angles(i + 2)
                i = self._add(out, self.text[i + 1], prefix, i, group) if self.get(group) == "(" else i + 1
            elif self.rust and t in ("impl", "trait", "mod") and word:
                body = self.find(i, hi, "{", ";")
                head = [k for k in range(self.angles(i + 1), body) if self.kind[k] == "id"]
                if self.get(body) == "{" and head:
                    own = prefix
                    if t == "trait":
                        own = f"{self.text[head[0]]}::"
                        self.types.append((self.text[head[0]], "trait", self.line[i]))
                    elif t == "impl":
                        for_ = next((k for k in head if self.text[k] == "for"), None)
                        of = self._last_name(for_ + 1 if for_ else self.angles(i + 1), body)
                        own = f"{of}::"
                        if for_:
                            self.implemented.append((self._last_name(self.angles(i + 1), for_), of, self.line[i]))
                    self._walk(body + 1, self.close[body], own, out)
                i = self.close.get(body, body) + 1
            elif not self.rust and t == "function" and word:
                named = i + 1 + (self.get(i + 1) == "*")
                name = self.text[named] if named < hi and self.kind[named] == "id" else "default"
                group = self.angles(named + (name != "default" or self.get(named) == "default"))
                i = self._add(out, name, prefix, i, group) if self.get(group) == "(" else i + 1
            elif not self.rust and t in ("class", "interface") and word and self.get(i - 1) != "." and i + 1 < hi and self.kind[i + 1] == "id":
                body, name = self.find(i, hi, "{", ";"), self.text[i + 1]
                self.types.append((name, t, self.line[i]))
                said = next((k for k in range(i, body) if self.get(k) == "implements"), body)
                for a, b in self.split(said + 1, body):
                    self.implemented.append((self._last_name(a, b), name, self.line[i]))
                if self.get(body) == "{" and t == "class":
                    self._members(body + 1, self.close[body], f"{name}::", out)
                i = self.close.get(body, body) + 1
            elif not self.rust and t in ("const", "let", "var") and word and i + 1 < hi and self.kind[i + 1] == "id":
                i = self._bound(i, i + 1, hi, prefix, out)
            elif not self.rust and t in ("namespace", "module") and word and self.get(i + 2) == "{":
                self._walk(i + 3, self.close[i + 2], prefix, out)
                i = self.close[i + 2] + 1
            else:
                i = self.close.get(i, i) + 1

    def _last_name(self, lo: int, hi: int) -> str:
        """The last part of the path that a type begins with."""
        i, out = lo, ""
        while i < hi and (self.kind[i] in ("id", "life") or self.get(i) in ("::", "&", ".")):
            out = self.text[i] if self.kind[i] == "id" and self.text[i] not in ("dyn", "mut") else out
            i += 1
        return out

    def _bound(self, start: int, name: int, hi: int, prefix: str, out: list[Function]) -> int:
        """A name that is given a function; the place behind it."""
        i = name + 1
        if self.get(i) == ":":
            i = self.find(i, hi, "=", ";")
        if self.get(i) != "=":
            return name + 1
        i += 1 + (self.get(i + 1) == "async")
        if self.get(i) == "function":
            group = self.find(i, hi, "(")
            return self._add(out, self.text[name], prefix, start, group) if group < hi else i
        group = self.angles(i)
        if self.get(group) == "(":
            after = self.close[group] + 1
            if self.get(after) == ":":
                after = self.find(after, min(hi, after + 60), "=>", ";")
            if self.get(after) == "=>":
                return self._add(out, self.text[name], prefix, start, group)
        elif i + 1 < hi and self.kind[i] == "id" and self.get(i + 1) == "=>":
            body = i + 2
            end = self.close[body] if self.get(body) == "{" else self._end(body, hi)
            out.append(Function(prefix + self.text[name], "method" if prefix else "function", [self.text[i]], start, body + (self.get(body) == "{"), end, (i, i + 1), self.get(body) != "{"))
            return end + 1
        return i

    def _members(self, lo: int, hi: int, prefix: str, out: list[Function]) -> None:
        i = lo
        while i < hi:
            start = i
            while self.get(i) in _MODIFIERS and self.get(i + 1) not in ("(", "=", ":", ";"):
                i += 1
            if i < hi and self.kind[i] == "id":
                group = self.angles(i + 1)
                i = self._add(out, self.text[i], prefix, start, group) if self.get(group) == "(" else max(i + 1, self._bound(start, i, hi, prefix, out))
            else:
                i = self.close.get(i, i) + 1

    def _end(self, lo: int, hi: int) -> int:
        """The end of a statement: a semicolon, or in scripts a line that nothing carries on."""
        i = lo
        while i < hi and self.get(i) not in (";", "}"):
            if not self.rust and i > lo and self.line[i] > self.line[i - 1] and self.text[i - 1] not in ("=", "=>", "+", "-", "*", "&&", "||", "?", ":", ",", ".", "(", "??") and self.text[i] not in (".", "?.", "+", "-", "*", "/", "&&", "||", "?", ":", "=", "??", ")", "]", ",", "(", "["):
                return i
            if not self.rust and self.get(i) == ",":
                return i
            i = self.close.get(i, i) + 1
        return i

    def block(self, lo: int, hi: int) -> list[Statement]:
        out: list[Statement] = []
        i = lo
        while i < hi:
            i = max(i + 1, self._statement(i, hi, out))
        return out

    def _body(self, i: int, hi: int) -> tuple[list[Statement], int]:
        """A block in braces, or one statement, and the place behind it."""
        if self.get(i) == "{":
            return self.block(i + 1, self.close[i]), self.close[i] + 1
        own: list[Statement] = []
        return own, self._statement(i, hi, own) if i < hi else i

    def _test(self, i: int, hi: int) -> tuple[tuple[int, int], int]:
        """A condition, without its brackets, and the place behind it."""
        if not self.rust and self.get(i) == "(":
            return (i + 1, self.close[i]), self.close[i] + 1
        end = self.find(i, hi, "{")
        return (i, end), end

    def _statement(self, i: int, hi: int, out: list[Statement]) -> int:
        """Reads one statement into ``out``; the place behind it."""
        t, start = self.get(i), i
        if t in (";", ","):
            return i + 1
        if (self.kind[i] == "life" or (not self.rust and self.kind[i] == "id")) and self.get(i + 1) == ":" and self.get(i + 2) in ("for", "while", "do", "loop", "{"):
            return self._statement(i + 2, hi, out)
        if t == "{" or (t == "unsafe" and self.get(i + 1) == "{"):
            i += t == "unsafe"
            out += self.block(i + 1, self.close[i])
            return self.close[i] + 1
        if t == "if":
            test, i = self._test(i + 1, hi)
            then, i = self._body(i, hi)
            parts = [("true", then)]
            if self.get(i) == "else":
                other, i = self._body(i + 1, hi)
                parts.append(("false", other))
            out.append(Statement("if", start, i, test, parts))
            return i
        if t in ("while", "for", "loop"):
            test = None
            i += 1 + (self.get(i + 1) == "await")
            if t != "loop":
                test, i = self._test(i, hi)
            own, i = self._body(i, hi)
            out.append(Statement("loop", start, i, test, [("true", own)], endless=t == "loop"))
            return i
        if t == "do" and not self.rust:
            own, i = self._body(i + 1, hi)
            test, i = self._test(i + 1, hi) if self.get(i) == "while" else (None, i)
            out.append(Statement("loop", start, i, test, [("true", own)]))
            return i
        if (t == "match" and self.rust) or (t == "switch" and not self.rust and self.get(i + 1) == "("):
            test, i = self._test(i + 1, hi)
            if self.get(i) == "{":
                parts = self._arms(i + 1, self.close[i]) if self.rust else self._cases(i + 1, self.close[i])
                out.append(Statement("match", start, self.close[i] + 1, test, parts, endless=self.rust or any(p[0] is None for p in parts)))
                return self.close[i] + 1
            return i
        if t == "try" and not self.rust and self.get(i + 1) == "{":
            own, i = self._body(i + 1, hi)
            parts, last = [(None, own)], None
            if self.get(i) == "catch":
                i += 1
                i = self.close[i] + 1 if self.get(i) == "(" else i
                handler, i = self._body(i, hi)
                parts.append(("catch", handler))
            if self.get(i) == "finally":
                last, i = self._body(i + 1, hi)
            out.append(Statement("try", start, i, None, parts, last))
            return i
        if t in ("fn", "function", "struct", "enum", "impl", "trait", "mod", "class", "interface") and self.kind[i] == "id" and i + 1 < hi and self.kind[i + 1] == "id":
            body = self.find(i, hi, "{", ";")
            return self.close.get(body, body) + 1
        end = self._end(i, hi)
        if self.rust and t == "let":  # what is bound may branch
            given = self.find(i, end, "=")
            if self.get(given + 1) in ("if", "match", "loop", "unsafe"):
                self._statement(given + 1, end, out)
        kind = {"return": "return", "throw": "panic", "break": "break", "continue": "continue"}.get(t, "plain")
        called = next((k for k in range(i, end) if self.get(k) in ("(", "!")), end)
        name = self.get(called - 1) if called > i else ""
        if kind == "plain" and self.rust and self.get(called) == "!" and name in _PANICS:
            kind = "panic"
        elif kind == "plain" and self.get(called) == "(" and name in _EXITS and (self.get(called - 3) == "process" or (called - 1 == i and self.rust)):
            kind = "exit"
        out.append(Statement(kind, start, end))
        return end

    def _arms(self, lo: int, hi: int) -> list[tuple[str | None, list[Statement]]]:
        out, i = [], lo
        while i < hi:
            arrow = self.find(i, hi, "=>")
            if arrow == hi:
                break
            body = arrow + 1
            if self.get(body) == "{":
                own, end = self.block(body + 1, self.close[body]), self.close[body] + 1
            else:
                end = self.find(body, hi, ",")
                own = self.block(body, end)
            out.append((self.source(i, arrow), own))
            i = end + (self.get(end) == ",")
        return out

    def _cases(self, lo: int, hi: int) -> list[tuple[str | None, list[Statement]]]:
        out, i = [], lo
        while i < hi:
            colon = self.find(i, hi, ":")
            end = colon + 1
            while end < hi and self.get(end) not in ("case", "default"):
                end = self.close.get(end, end) + 1
            out.append((self.source(i + 1, colon) if self.get(i) == "case" else None, self.block(colon + 1, end)))
            i = end
        return out

    def calls(self, lo: int, hi: int) -> list[tuple[str, int, int, bool]]:
        """(callee with its path, line, arguments, whether it is a member) of each call."""
        out = []
        for i in range(lo, hi):
            if self.kind[i] != "id" or self.text[i] in _NO_CALL or self.get(i - 1) in ("fn", "function"):
                continue
            group = self.angles(i + 2) if self.get(i + 1) == "::" and self.get(i + 2) == "<" else i + 1
            if self.get(group) != "(":
                continue
            first = i
            while self.get(first - 1) in ("::", ".", "?.") and first >= 2 and self.kind[first - 2] == "id":
                first -= 2
            out.append(("".join(self.text[first : i + 1]), self.line[first], len(self.split(group + 1, self.close[group])), self.get(i - 1) in (".", "?.")))
        return out

    def forwards(self, f: Function) -> str | None:
        """What a function of one call passes its own parameters to, in their order."""
        lo, hi = f.open, f.close
        while lo < hi and self.get(hi - 1) == ";":
            hi -= 1
        plain = f.expression or self.rust
        if self.get(lo) == "return":
            lo, plain = lo + 1, True
        while lo < hi:  # unwrapped: await, ?, brackets
            if self.get(lo) == "await":
                lo += 1
            elif self.get(hi - 1) == "?":
                hi -= 1
            elif self.get(hi - 1) == "await" and self.get(hi - 2) == ".":
                hi -= 2
            elif self.get(lo) == "(" and self.close[lo] == hi - 1:
                lo, hi = lo + 1, hi - 1
            else:
                break
        if not plain or hi - lo < 3 or self.get(hi - 1) != ")":
            return None
        group = next((k for k in range(lo, hi) if self.get(k) == "("), hi)
        path = self.text[lo:group]
        if self.close.get(group) != hi - 1 or not path or any(self.kind[k] != "id" if (k - lo) % 2 == 0 else self.get(k) not in ("::", ".") for k in range(lo, group)):
            return None
        args = []
        for a, b in self.split(group + 1, hi - 1):
            while self.get(a) in ("&", "mut"):
                a += 1
            if b - a == 5 and self.text[a + 1 : a + 3] == [".", "clone"]:
                b = a + 1
            args.append(self.text[a] if b - a == 1 else None)
        own = [p for p in f.params if p not in ("self", "this")]
        if args != own or not own or (len(path) > 1 and "." in path and self.rust and path[0] != "self"):
            return None
        owner = f.name.rsplit("::", 1)[0]
        return f"{owner}::{path[-1]}" if f.kind == "method" and path[0] in ("Self", "self", "this") else path[-1] if self.rust else "::".join(path[::2])


class Flow:
    """Nodes and edges of one function."""

    def __init__(self, source: Source, f: Function):
        self.s, self.nodes, self.edges = source, [], []
        entry = self.node("entry", source.line[f.start])
        last = self.run([Statement("return", f.open, f.close)] if f.expression else source.block(f.open, f.close), entry, [])
        if last is not None:
            self.edge(last, self.node("return", source.line[min(f.close, source.n - 1)]), "next")

    def node(self, kind: str, line: int, n: int = 0) -> int:
        self.nodes.append([kind, line, n])
        return len(self.nodes) - 1

    def edge(self, a: int, b: int, kind: str, condition: str | None = None) -> None:
        self.edges.append((a, b, kind, condition))

    def part(self, statements: list[Statement], top: int, line: int, kind: str, condition: str | None, loops: list, to: int, back: str = "next") -> None:
        start = self.node("block", self.s.line[statements[0].lo] if statements else line)
        self.edge(top, start, kind, condition)
        end = self.run(statements, start, loops)
        if end is not None:
            self.edge(end, to, back)

    def run(self, statements: list[Statement], at: int | None, loops: list[tuple[int, int]]) -> int | None:
        """The node after some statements, or None if none of them falls through."""
        s = self.s
        for x in statements:
            line = s.line[x.lo]
            if at is None:
                at = self.node("block", line)  # nothing leads here
            test = s.source(*x.test) if x.test else None
            if x.kind in ("return", "panic", "exit"):
                self.edge(at, self.node(x.kind, line, 1), "next")
                at = None
            elif x.kind in ("break", "continue") and loops:
                self.edge(at, loops[-1][x.kind == "break"], x.kind)
                at = None
            elif x.kind in ("if", "loop", "match", "try"):
                top = self.node({"if": "branch"}.get(x.kind, x.kind), line)
                self.edge(at, top, "next")
                after = self.node("block", s.line[min(x.hi, s.n) - 1])
                if x.kind == "loop":
                    self.part(x.parts[0][1], top, line, "next" if x.endless else "true-branch", test, [*loops, (top, after)], top, "back")
                    if not x.endless:
                        self.edge(top, after, "false-branch", test)
                elif x.kind == "if":
                    self.part(x.parts[0][1], top, line, "true-branch", test, loops, after)
                    if len(x.parts) > 1:
                        self.part(x.parts[1][1], top, line, "false-branch", test, loops, after)
                    else:
                        self.edge(top, after, "false-branch", test)
                elif x.kind == "match":
                    own = loops if s.rust else [*loops, (loops[-1][0] if loops else top, after)]  # break leaves a switch
                    for label, body in x.parts:
                        self.part(body, top, line, "arm", label, own, after)
                    if not x.endless:
                        self.edge(top, after, "false-branch", None)
                else:
                    for label, body in x.parts:
                        self.part(body, top, line, "exception" if label else "next", None, loops, after)
                at = self.run(x.last, after, loops) if x.last else after
            else:
                if self.nodes[at][0] != "block":
                    new = self.node("block", line)
                    self.edge(at, new, "next")
                    at = new
                self.nodes[at][2] += 1
        return at


def _parsed(path: str, text: str | None) -> tuple[Source, list[Function]] | None:
    try:
        s = Source(text or "", path.lower().endswith(".rs"))
        return s, s.functions()
    except (ValueError, RecursionError):
        return None


def _each_file(rows, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            out = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                if parsed := _parsed(path, text):
                    out += rows(path, *parsed)
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _read(files: DataFrame, rows, schema: pa.Schema, ddl: str, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    ship(files.sparkSession)
    return files.filter(language(F.col("path")).isin(*languages)).select("path", "text").mapInArrow(_each_file(rows, schema), ddl)


_CALLS = pa.list_(pa.struct([("raw", pa.string()), ("line", pa.int32())]))
_INDEX = pa.schema([("path", pa.string()), ("target", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("sha256", pa.string()), ("kind", pa.string()), ("calls", _CALLS), ("placeholder", pa.bool_()), ("forwards", pa.string()), ("bases", pa.list_(pa.string()))])
_INDEX_DDL = "path string, target string, start_line int, end_line int, signature string, sha256 string, kind string, calls array<struct<raw:string,line:int>>, placeholder boolean, forwards string, bases array<string>"


def source_index(files: DataFrame, calls_per_function: int = 200) -> DataFrame:
    """Functions and methods with their calls, and traits, interfaces and classes; ``bases``: what a type implements."""

    def rows(path, s, functions):
        lines = s.raw.split("\n")
        for f in functions:
            lo, hi = s.line[f.start], s.line[min(f.close, s.n - 1)]
            body = s.source(f.open, f.close)
            unfinished = bool(re.search(r"\b(?:todo|unimplemented)!|\b(?:panic|unreachable)!.*(?i:todo)" if s.rust else r"(?i)\bthrow\b[^;]*(?:todo|not implemented)", body))
            calls = sorted(((n.replace(".", "::").replace("?::", "::"), line) for n, line, _, _ in s.calls(f.open, f.close)), key=lambda c: c[1])[:calls_per_function]
            yield {"path": path, "target": f.name, "start_line": lo, "end_line": hi, "signature": lines[lo - 1].strip(), "sha256": hashlib.sha256("\n".join(lines[lo - 1 : hi]).encode("utf-8", "replace")).hexdigest(), "kind": f.kind, "calls": [{"raw": n, "line": k} for n, k in calls], "placeholder": unfinished, "forwards": s.forwards(f), "bases": []}
        plain = {"end_line": None, "signature": None, "sha256": None, "calls": [], "placeholder": False, "forwards": None}
        for name, kind, line in s.types:
            yield {"path": path, "target": name, "start_line": line, "kind": kind, "bases": [], **plain}
        for name, of, line in s.implemented:
            yield {"path": path, "target": of, "start_line": line, "kind": "implements", "bases": [name], **plain}

    return _read(files, rows, _INDEX, _INDEX_DDL)


def source_cfg(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the control flow of every function: the same columns as for Python."""
    edge = pa.list_(pa.struct([("to", pa.int32()), ("kind", pa.string()), ("condition", pa.string())]))
    schema = pa.schema([("path", pa.string()), ("function", pa.string()), ("node", pa.int32()), ("kind", pa.string()), ("line", pa.int32()), ("n_statements", pa.int32()), ("edges", edge)])

    def rows(path, s, functions):
        for f in functions:
            flow = Flow(s, f)
            for i, (kind, line, n) in enumerate(flow.nodes):
                yield {"path": path, "function": f.name, "node": i, "kind": kind, "line": line, "n_statements": n, "edges": [{"to": t, "kind": k, "condition": c} for a, t, k, c in flow.edges if a == i]}

    whole = _read(files, rows, schema, "path string, function string, node int, kind string, line int, n_statements int, edges array<struct<`to`:int,kind:string,condition:string>>")
    edges = whole.select("path", "function", F.col("node").alias("from"), F.explode("edges").alias("x")).select("path", "function", "from", "x.*")
    return whole.drop("edges"), edges


def _events(s: Source, f: Function):
    """(variable, line, kind, context) of definitions and uses in a Rust function, in order."""
    known = set(f.params) - {"_"}
    first = s.line[f.start]
    for p in f.params:
        if p != "_":
            yield p, first, "param", ""

    def uses(lo, hi, kind):
        context = " ".join(s.source(lo, hi).split())
        for i in range(lo, hi):
            t = s.text[i]
            if s.kind[i] == "id" and t in known and s.get(i - 1) not in (".", "::") and s.get(i + 1) not in ("::", "!") and not (s.get(i + 1) == ":" and s.get(i + 2) != ":"):
                yield t, s.line[i], "index" if kind == "read" and s.get(i - 1) == "[" and s.get(i + 1) == "]" and s.kind[i - 2] == "id" else kind, context
                if s.get(i + 1) == "." and s.get(i + 2) in ("unwrap", "expect") and s.get(i + 3) == "(":
                    yield t, s.line[i], s.get(i + 2), context

    def walk(statements):
        for x in statements:
            t = s.get(x.lo)
            if x.kind in ("if", "loop", "match"):
                if x.test:
                    lo, hi = x.test
                    bound = s.find(lo, hi, "in") if t == "for" else s.find(lo, hi, "=") if s.get(lo) == "let" else lo
                    yield from uses(bound, hi, "read" if t == "for" else "condition")
                    if bound > lo and bound < hi:
                        for n in s.names(lo, bound):
                            if n not in ("let", "in"):
                                known.add(n)
                                yield n, s.line[x.lo], "loop" if t == "for" else "let", ""
                for _, body in x.parts:
                    yield from walk(body)
            elif t == "let":
                given = s.find(x.lo, x.hi, "=")
                yield from uses(given, x.hi, "read")
                for n in s.names(x.lo + 1, min(given, s.find(x.lo, given, ":"))):
                    known.add(n)
                    yield n, s.line[x.lo], "let", ""
            elif s.kind[x.lo] == "id" and s.get(x.lo + 1) in ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="):
                yield from uses(x.lo + 2 if s.get(x.lo + 1) == "=" else x.lo, x.hi, "read")
                known.add(t)
                yield t, s.line[x.lo], "assign", ""
            else:
                macro = t if s.get(x.lo + 1) == "!" else ""
                yield from uses(x.lo, x.hi, "assertion" if macro in _ASSERTS else "return" if x.kind == "return" else "read")

    yield from walk(s.block(f.open, f.close))


def rust_flow(files: DataFrame) -> DataFrame:
    """(path, function, variable, line, ord, kind, context) of what Rust functions define (param, let, assign, loop), use (read, condition, index, assertion, return) and unwrap (unwrap, expect)."""
    schema = pa.schema([("path", pa.string()), ("function", pa.string()), ("variable", pa.string()), ("line", pa.int32()), ("ord", pa.int64()), ("kind", pa.string()), ("context", pa.string())])

    def rows(path, s, functions):
        for f in functions:
            for k, (variable, line, kind, context) in enumerate(_events(s, f)):
                yield {"path": path, "function": f.name, "variable": variable, "line": line, "ord": k, "kind": kind, "context": context}

    return _read(files, rows, schema, "path string, function string, variable string, line int, ord long, kind string, context string", ("rust",))


def ts_symbols(files: DataFrame) -> DataFrame:
    """(path, symbol, usage_kind, line, detail, arg_count) of TypeScript files: exports, default imports, types in annotations, implemented types and calls.

    ``detail``: what is exported (function, class, ...) or the module imported from; ``arg_count``: the separators
    between arguments, as the surveyed heuristic counts.
    """
    schema = pa.schema([("path", pa.string()), ("symbol", pa.string()), ("usage_kind", pa.string()), ("line", pa.int32()), ("detail", pa.string()), ("arg_count", pa.int32())])

    def rows(path, s, functions):
        row = lambda symbol, kind, line, detail=None, n=None: {"path": path, "symbol": symbol, "usage_kind": kind, "line": line, "detail": detail, "arg_count": n}
        for i in range(s.n):
            t = s.get(i)
            if t == "export":
                k = i + 1
                while s.get(k) in ("default", "async", "declare", "abstract"):
                    k += 1
                if s.get(k) in ("function", "class", "interface", "type", "enum") and k + 1 < s.n and s.kind[k + 1] == "id":
                    yield row(s.text[k + 1], "export", s.line[i], s.text[k])
            elif t == "import" and i + 2 < s.n and s.kind[i + 1] == "id" and s.get(i + 2) in ("from", ","):
                end = next((k for k in range(i, min(s.n, i + 400)) if s.kind[k] == "text"), None)
                yield row(s.text[i + 1], "import", s.line[i], s.text[end].strip("'\"") if end else None)
            elif t == ":" and i + 1 < s.n and s.kind[i + 1] == "id" and s.text[i + 1] not in _PLAIN_TYPES and s.get(i + 2) not in ("<", ".", "[", "|", "&", "("):
                before = s.get(i - 1 - (s.get(i - 1) == "?"))
                inside = any(a <= i < b for f in functions for a, b in [f.group]) or before == ")" or s.get(i - 2) in ("const", "let", "var", "readonly", "private", "public", "protected")
                if inside and s.get(i - 1) not in ("case",):
                    yield row(s.text[i + 1], "type-annotation", s.line[i + 1])
        for name, of, line in s.implemented:
            yield row(name, "implements", line, of)
        for name, line, n, _ in s.calls(0, s.n):
            if not any(s.line[f.start] == line and name == f.name.rsplit("::", 1)[-1] for f in functions):
                yield row(name, "call", line, None, max(n - 1, 0))

    return _read(files, rows, schema, "path string, symbol string, usage_kind string, line int, detail string, arg_count int", ("typescript",))
