"""Rust and TypeScript sources, by tokens and matching brackets.

These are tolerant readers, not parsers: they find declarations, references and the shape of blocks, and skip what they
don't know.
"""

from __future__ import annotations

import re
from collections.abc import Generator
from dataclasses import dataclass

from .rows import Rows

#: A reading step that may ask for another one and gets its result; see `run_deep`.
Step = Generator["Step", int, int]

_TOKEN = re.compile(
    rb"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>r(?P<raw>\#*)".*?"(?P=raw)|b?"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`)
    |(?P<char>b?'(?:\\.[^']*|[^'\\\n])')
    |(?P<life>'[A-Za-z_]\w*)
    |(?P<word>[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)
    |(?P<number>\d[\w.]*)
    |(?P<mark>=>|->|::|\.\.=|\.\.\.|\.\.|[=!<>]=|&&|\|\||\?\.|.)""",
    re.X | re.S,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
RUST_WORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())
TS_WORDS = frozenset(
    "abstract any as async await boolean break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in instanceof interface keyof let namespace new null number of private protected public readonly return set static string super switch this throw true try type typeof undefined unknown var void while with yield".split()
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    mate: int = -1


def tokens(source: bytes, single_quoted: bool) -> list[Token]:
    """Tokens with the number of the matching bracket; `single_quoted` reads '...' as a string of any length."""
    out: list[Token] = []
    stack: list[int] = []
    at = 0
    quoted = re.compile(rb"'(?:\\.|[^'\\\n])*'")
    while at < len(source):
        if single_quoted and source[at : at + 1] == b"'" and (q := quoted.match(source, at)):
            out.append(Token("string", "", at, q.end()))
            at = q.end()
            continue
        m = _TOKEN.match(source, at)
        kind = m.lastgroup if m.lastgroup != "raw" else "string"
        if kind != "skip":
            text = m.group().decode("utf-8", "replace") if kind != "string" else ""
            t = Token(kind, text, m.start(), m.end())
            if text in _OPEN and kind == "mark":
                stack.append(len(out))
            elif text in _CLOSE and kind == "mark":
                while stack and _OPEN[out[stack[-1]].text] != text:
                    stack.pop()
                if stack:
                    t.mate = stack.pop()
                    out[t.mate].mate = len(out)
            out.append(t)
        at = m.end()
    return out


def run_deep(step: Step) -> int:
    """Run a step and all it asks for on a list of its own, so that nesting is bounded by memory alone."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


class Reader:
    def __init__(self, rows: Rows, single_quoted: bool):
        self.rows = rows
        self.t = tokens(rows.source, single_quoted)
        self.n = len(self.t)

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < self.n else ""

    def word(self, i: int) -> bool:
        return 0 <= i < self.n and self.t[i].kind == "word"

    def skip(self, i: int) -> int:
        """The token behind i, over a whole bracket."""
        return self.t[i].mate + 1 if self.t[i].mate > i else i + 1

    def find(self, i: int, stop: int, *marks: str) -> int:
        """First of the marks at this level, or stop."""
        while i < stop and self.t[i].text not in marks:
            i = self.skip(i)
        return min(i, stop)

    def span(self, a: int, z: int) -> tuple[int, int]:
        """Bytes from token a to before token z."""
        return self.t[a].start, self.t[max(a, min(z, self.n) - 1)].end


class Rust(Reader):
    _SYNTAX = {"fn": "function_item", "struct": "struct_item", "enum": "enum_item", "trait": "trait_item", "mod": "mod_item", "impl": "impl_item", "use": "use_declaration"}
    _KIND = {"fn": "Function", "struct": "Struct", "enum": "Enum", "trait": "Trait", "mod": "Module", "impl": "Impl", "use": "Import"}

    def __init__(self, rows: Rows):
        super().__init__(rows, False)

    def run(self) -> None:
        run_deep(self.items(0, self.n, True))

    def item_end(self, i: int, stop: int) -> int:
        end = self.find(i, stop, ";", "{")
        return self.skip(end) if end < stop else stop

    def items(self, i: int, stop: int, top: bool) -> Step:
        """Declarations at this level and in blocks below it, in source order."""
        tested = False
        start: int | None = None
        while i < stop:
            word = self.text(i)
            if word == "#" and self.text(i + 1) in ("[", "!"):
                b = i + 1 if self.text(i + 1) == "[" else i + 2
                z = self.skip(b)
                tested |= any(self.text(k) == "test" or "test" in self.text(k) for k in range(b, z))
                i, start = z, None
                continue
            if word == "pub":
                start, i = i, i + 1
                if self.text(i) == "(":
                    i = self.skip(i)
                continue
            if word in ("async", "unsafe", "const", "extern") and self.text(i + 1) in ("fn", "unsafe", "async", "extern", "impl", "trait") or word == "unsafe" and self.text(i + 1) in ("impl", "trait"):
                start = i if start is None else start
                i += 1
                continue
            if word in self._SYNTAX and self.t[i].kind == "word" and not (word == "use" and self.text(i - 1) == "."):
                i = yield self.declaration(word, i, stop, i if start is None else start, top, tested)
                tested, start = False, None
                continue
            start = None
            if self.t[i].kind == "mark" and self.t[i].mate > i:
                yield self.items(i + 1, self.t[i].mate, False)
                i = self.t[i].mate + 1
                tested = tested and not top
                continue
            i += 1

    def declaration(self, word: str, i: int, stop: int, start: int, top: bool, tested: bool) -> Step:
        named = self.word(i + 1) and word not in ("impl", "use")
        end = self.item_end(i + 1, stop) if word != "fn" or named else i + 1
        if not named and word not in ("impl", "use"):
            return i + 1
        name = self.text(i + 1) if named else self._SYNTAX[word]
        self.rows.add("symbol", name, *self.span(start, end), self._KIND[word], self._SYNTAX[word])
        body = self.find(i + 1, end, "{")
        has_body = body < end and self.text(body) == "{"
        if word == "use":
            last = [k for k in range(i + 1, end) if self.word(k) and self.text(k) not in RUST_WORDS]
            if last:
                self.rows.add("import", self.text(last[-1]), *self.span(start, end))
            return end
        if word == "impl":
            self.implementation(i, body, start, end)
        if word == "fn" and has_body:
            here = self.span(start, end)
            close = self.t[body].mate
            self.calls(body + 1, close, here)
            if top:
                if name == "main" or tested or self.text(start) == "pub":
                    self.rows.add("entry", name, *here)
                yield self.block(body, here[0])
                self.names(body + 1, close, here[0])
        if has_body:
            yield self.items(body + 1, self.t[body].mate, False)
        return end

    def implementation(self, i: int, body: int, start: int, end: int) -> None:
        k = i + 1
        if self.text(k) == "<":
            k = self.angle(k)
        parts: list[list[str]] = [[]]
        while k < body and self.text(k) != "where":
            if self.text(k) == "for":
                parts.append([])
            elif self.text(k) == "<":
                k = self.angle(k)
                continue
            elif self.word(k) and self.text(k) not in RUST_WORDS - {"Self"}:
                parts[-1].append(self.text(k))
            k += 1
        if parts[-1]:
            trait = parts[0][-1] if len(parts) > 1 and parts[0] else None
            self.rows.add("impl", parts[-1][-1], *self.span(start, end), trait)

    def angle(self, k: int) -> int:
        depth = 0
        while k < self.n:
            depth += {"<": 1, ">": -1}.get(self.text(k), 0)
            k += 1
            if not depth:
                break
        return k

    def calls(self, i: int, stop: int, caller: tuple[int, int]) -> None:
        """Calls of a function's own body; nested functions own theirs."""
        while i < stop:
            if self.text(i) == "fn" and self.word(i + 1):
                i = self.item_end(i + 1, stop)
                continue
            if self.text(i) == "(" and self.word(i - 1) and self.text(i - 1) not in RUST_WORDS and self.text(i - 2) not in ("fn", "struct"):
                a = i - 1
                name: str | None = self.text(a)
                if self.text(a - 1) == ".":  # a method: the receiver stands for it, where it is a plain name
                    while self.text(a - 1) in (".", "?") and a >= 2:
                        a -= 2 if self.text(a - 1) == "." else 1
                    name = self.text(a) if self.word(a) and self.text(a) not in RUST_WORDS else None
                if name:
                    self.rows.add("call", name, *self.span(a, self.skip(i)), other=caller)
            i += 1

    def statements(self, body: int) -> list[tuple[int, int]]:
        """Token ranges of a block's statements."""
        out, i, stop = [], body + 1, self.t[body].mate
        while i < stop:
            start = i
            blocky = self.text(i) in ("if", "match", "loop", "while", "for", "unsafe", "{", "fn", "impl", "struct", "enum", "trait", "mod") or self.t[i].kind == "life"
            while i < stop:
                if self.text(i) == ";":
                    i += 1
                    break
                was = i
                i = self.skip(i)
                if blocky and self.text(was) == "{" and self.text(i) not in ("else", ".", "?"):
                    break
            out.append((start, i))
        return out

    def block(self, body: int, scope: int) -> Step:
        found = self.statements(body)
        for a, b in zip(found, found[1:]):
            self.rows.add("control", None, *self.span(*a), "Sequential", other=self.span(*b), scope=scope)
        for a, z in found:
            yield self.structure(a, z, scope)

    def structure(self, a: int, z: int, scope: int) -> Step:
        word = self.text(a)
        if self.t[a].kind == "life":
            yield self.structure(a + 2, z, scope)
            return
        if word == "return":
            self.rows.add("control", None, *self.span(a, z), "Return", other=self.span(a, z), scope=scope)
        elif word == "if":
            yield self.branch(a, z, scope)
        elif word in ("loop", "while", "for"):
            body = self.find(a + 1, z, "{")
            if body < z:
                self.rows.add("control", None, *self.span(body, self.skip(body)), "BackEdge", other=self.span(a, self.skip(body)), scope=scope)
                yield self.block(body, scope)
        elif word == "match":
            body = self.find(a + 1, z, "{")
            if body < z:
                for arm in self.arms(body):
                    self.rows.add("control", None, *self.span(a, self.skip(body)), "Branch", other=arm, scope=scope)

    def branch(self, a: int, z: int, scope: int, last: int = 0) -> Step:
        """An if with what follows it; `last` is the end of the chain of elses that it is in."""
        body = self.find(a + 1, z, "{")
        if body >= z:
            return
        end = self.skip(body)
        if not last:
            last = end
            while self.text(last) == "else" and last < z:
                last = self.skip(self.find(last + 1, z, "{"))
        here = self.span(a, last)
        self.rows.add("control", None, *here, "Branch", other=self.span(body, end), scope=scope)
        yield self.block(body, scope)
        if self.text(end) == "else" and end < z:
            self.rows.add("control", None, *here, "Branch", other=self.span(end, last), scope=scope)
            if self.text(end + 1) == "if":
                yield self.branch(end + 1, z, scope, last)
            elif self.text(end + 1) == "{":
                yield self.block(end + 1, scope)

    def arms(self, body: int) -> list[tuple[int, int]]:
        out, i, stop = [], body + 1, self.t[body].mate
        while i < stop:
            start = i
            i = self.find(i, stop, "=>")
            if i >= stop:
                break
            i += 1
            if self.text(i) == "{":
                i = self.skip(i)
            else:
                i = self.find(i, stop, ",")
            out.append(self.span(start, i))
            if self.text(i) == ",":
                i += 1
        return out

    def names(self, i: int, stop: int, scope: int) -> None:
        """Definitions by let, and uses of names, within a function."""
        defined: set[int] = set()
        for k in range(i, stop):
            if self.text(k) == "let":
                a = k + 1
                z = self.find(a, stop, "=", ";", ":")
                if z > a:
                    self.rows.add("def", self.rows.source[slice(*self.span(a, z))].decode("utf-8", "replace"), *self.span(a, z), scope=scope)
                    if z == a + 1:
                        defined.add(a)
        for k in range(i, stop):
            if self.word(k) and self.text(k) not in RUST_WORDS and k not in defined and self.text(k - 1) != "." and self.text(k + 1) != "!":
                self.rows.add("use", self.text(k), *self.span(k, k + 1), scope=scope)


class TypeScript(Reader):
    _DECLARE = {"function": ("Function", "function_declaration"), "class": ("Class", "class_declaration"), "interface": ("Trait", "interface_declaration"), "enum": ("Enum", "enum_declaration"), "type": ("Type", "type_alias_declaration")}

    def __init__(self, rows: Rows):
        super().__init__(rows, True)

    def run(self) -> None:
        self.imports()
        self.functions: list[tuple[int, int]] = []
        self.members: list[tuple[int, int]] = []  # brackets around the members of enums
        self.ends: dict[int, int] = {}  # of statements that were read already
        for i in range(self.n):
            if self.t[i].kind != "word" or self.text(i - 1) == ".":
                if self.text(i) == "=>":
                    self.arrow(i)
                continue
            word = self.text(i)
            if word in self._DECLARE and self.word(i + 1) and (word != "type" or self.text(i + 2) in ("=", "<")):
                self.declaration(word, i)
            elif self.text(i + 1) == "(" and self.in_class(i):
                z = self.skip(i + 1)
                brace = self.find(z, min(self.n, z + 40), "{", ";", "}") if self.text(z) in ("{", ":") else self.n
                if self.text(brace) == "{" and word not in TS_WORDS - {"get", "set", "constructor"}:
                    self.functions.append(self.span(i, self.skip(brace)))
            self.flow(word, i)
        self.references()

    def in_class(self, i: int) -> bool:
        return self.text(i - 1) in ("{", "}", ";", "async", "public", "private", "protected", "static", "get", "set", "readonly") and self.text(i) not in ("if", "for", "while", "switch", "catch", "function", "return")

    def imports(self) -> None:
        i = 0
        while i < self.n:
            if self.text(i) == "import" and self.text(i + 1) != "(":
                z = i + 1
                while z < self.n and self.t[z].kind != "string" and self.text(z) != ";":
                    z += 1
                k = i + 1
                while k < z:
                    if self.word(k) and self.text(k) not in ("from", "type", "as"):
                        if self.text(k + 1) == "as":
                            k += 2  # the alias is the local name
                        self.rows.add("import", self.text(k), *self.span(k, k + 1))
                    k += 1
                i = z
            i = self.skip(i) if i < self.n else i

    def declaration(self, word: str, i: int) -> None:
        name = self.text(i + 1)
        if word == "type":
            end = self.find(i, self.n, ";")
            end = min(end + 1, self.n)
        else:
            brace = self.find(i + 1, self.n, "{")
            end = self.skip(brace) if brace < self.n else self.n
        kind, syntax = self._DECLARE[word]
        here = self.span(i, end)
        self.rows.add("symbol", name, *here, kind, syntax)
        if word == "function":
            self.functions.append(here)
        if word == "enum" and self.text(end - 1) == "}":
            self.members.append((self.t[end - 1].mate, end - 1))
        if word == "class":
            k = i + 2
            while k < end and self.text(k) != "{":
                if self.text(k) in ("extends", "implements") and self.word(k + 1):
                    self.rows.add("impl", name, *here, self.text(k + 1))
                k = self.skip(k) if self.text(k) != "{" else k

    def arrow(self, i: int) -> None:
        start = self.t[i - 1].mate if self.text(i - 1) == ")" and self.t[i - 1].mate >= 0 else i - 1
        end = self.skip(i + 1) if self.text(i + 1) == "{" else self.find(i + 1, self.n, ",", ";", ")", "}", "]")
        self.functions.append(self.span(start, max(end, i + 1)))

    def statement_end(self, i: int) -> int:
        """Behind the statement that starts at i: a block, or up to its semicolon."""
        return run_deep(self._behind(i))

    def _behind(self, i: int) -> Step:
        if i in self.ends:
            return self.ends[i]
        if self.text(i) == "{":
            z = self.skip(i)
        elif self.text(i) in ("if", "for", "while", "switch"):
            z = self.skip(i + 1) if self.text(i + 1) == "(" else i + 1
            z = yield self._behind(z)
            while self.text(i) == "if" and self.text(z) == "else":
                z = yield self._behind(z + 1)
        else:
            z = self.find(i, self.n, ";", "}")
            z += self.text(z) == ";"
        self.ends[i] = z
        return z

    def flow(self, word: str, i: int) -> None:
        add = self.rows.add
        if word == "if" and self.text(i + 1) == "(":
            a = self.skip(i + 1)
            z = self.statement_end(a)
            end = self.statement_end(i)
            add("control", None, *self.span(i, end), "Branch", other=self.span(a, z))
            if self.text(z) == "else":
                add("control", None, *self.span(i, end), "Branch", other=self.span(z, end))
        elif word in ("for", "while") and self.text(i + 1) == "(":
            a = self.skip(i + 1)
            z = self.statement_end(a)
            add("control", None, *self.span(a, z), "BackEdge", other=self.span(i, z))
        elif word == "switch" and self.text(i + 1) == "(":
            body = self.skip(i + 1)
            if self.text(body) == "{":
                cases = []
                k, stop = body + 1, self.t[body].mate
                while k < stop:
                    if self.text(k) in ("case", "default"):
                        cases.append(k)
                    k = self.skip(k)
                for a, z in zip(cases, [*cases[1:], stop]):
                    add("control", None, *self.span(i, stop + 1), "Branch", other=self.span(a, z))
        elif word == "return":
            z = self.find(i, self.n, ";", "}")
            z = z + 1 if self.text(z) == ";" else z
            add("control", None, *self.span(i, z), "Return", other=self.span(i, z))

    def references(self) -> None:
        begins, spans = {a for a, _ in self.functions}, sorted(self.functions, reverse=True)
        declared = {k for a, z in self.members for k in range(a + 1, z) if self.text(k - 1) in ("{", ",")}
        around: list[tuple[int, int]] = []  # functions that have begun; the last one that goes on is the innermost

        def caller(at: int) -> tuple[int, int]:
            while spans and spans[-1][0] <= at:
                around.append(spans.pop())
            while around and around[-1][1] <= at:
                around.pop()
            return around[-1] if around else (0, 0)

        for i in range(self.n):
            if not self.word(i) or self.text(i) in TS_WORDS:
                continue
            start = self.t[i].start
            if self.text(i + 1) == "(" and self.text(i - 1) != "function" and start not in begins:
                a = i
                while self.text(a - 1) in (".", "?.") and a >= 2 and self.word(a - 2):
                    a -= 2
                self.rows.add("call", self.text(i), *self.span(a, self.skip(i + 1)), other=caller(start))
            if self.text(i - 1) in ("const", "let", "var"):
                self.rows.add("def", self.text(i), *self.span(i, i + 1))
            elif i not in declared and self.text(i - 1) not in (".", "?.", "class", "interface", "type") and not (self.text(i + 1) == ":" and self.text(i - 1) in ("{", ",")):
                self.rows.add("use", self.text(i), *self.span(i, i + 1))


def rust(path: str, source: bytes) -> Rows:
    rows = Rows(path, "rust", source)
    Rust(rows).run()
    return rows


def typescript(path: str, source: bytes, lang: str = "typescript") -> Rows:
    rows = Rows(path, lang, source)
    TypeScript(rows).run()
    return rows


def typescript_tsx(path: str, source: bytes) -> Rows:
    return typescript(path, source, "typescript-tsx")
