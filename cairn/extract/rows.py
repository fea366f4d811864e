"""The rows that extractors give, and the place they are gathered in."""

from __future__ import annotations

import bisect
import hashlib
import re

IR = (
    "path string, lang string, kind string, name string, extra string, syntax_kind string, start_byte bigint, end_byte bigint, start_line bigint, end_line bigint, "
    "other_start bigint, other_end bigint, scope bigint, ordinal bigint, content_hash string"
)
IR_NAMES = [c.split()[0] for c in IR.split(", ")]


class Rows:
    """Rows of one file.  Kinds: symbol, import, call, impl, control, def, use, entry and failed."""

    def __init__(self, path: str, lang: str, source: bytes):
        self.path, self.lang, self.source, self.out = path, lang, source, []
        self.lines = [0, *(m.end() for m in re.finditer(b"\n", source))]

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.lines, at)

    def add(self, kind: str, name: str | None, start: int, end: int, extra: str | None = None, syntax: str | None = None, other: tuple[int, int] | None = None, scope: int = 0) -> None:
        digest = hashlib.sha256(self.source[start:end]).hexdigest() if kind == "symbol" else None
        a, z = other or (None, None)
        self.out.append((self.path, self.lang, kind, name, extra, syntax, start, end, self.line(start), self.line(max(start, end - 1)), a, z, scope, len(self.out), digest))
