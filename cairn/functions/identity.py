"""Addresses, names and formats."""

from __future__ import annotations

import hashlib
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def address_of(preimage: Column | str) -> Column:
    """64 hex digits of the SHA-256 of a string or binary column."""
    return F.sha2(_col(preimage).cast("binary"), 256)


def address(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def short_address(addr: Column | str) -> Column:
    return F.substring(_col(addr), 1, 8)


def file_address(path: Column | str) -> Column:
    return address_of(F.concat(F.lit("file:"), _col(path)))


def symbol_address(path: Column | str, syntax_kind: Column | str, name: Column | str) -> Column:
    return address_of(F.concat_ws(":", F.lit("sym"), _col(path), _col(syntax_kind), _col(name)))


def statement_address(path: Column | str, start: Column | str, end: Column | str) -> Column:
    return address_of(F.concat_ws(":", F.lit("stmt"), _col(path), _col(start), _col(end)))


def process_address(entrypoint: Column | str) -> Column:
    return address_of(F.concat(F.lit("process:"), _col(entrypoint)))


def belief_address(claim: Column | str) -> Column:
    return address_of(F.concat(F.lit("belief:"), _col(claim)))


# Syntax kinds and the language-neutral kind of each.
CANONICAL = {
    "function_item": "Function", "function_declaration": "Function", "function_definition": "Function",
    "struct_item": "Type", "class_declaration": "Type", "class_definition": "Type",
    "trait_item": "Interface", "interface_declaration": "Interface",
    "enum_item": "Enum", "enum_declaration": "Enum",
    "mod_item": "Module",
}
CANONICAL_FALLBACK = {"Function": "Function", "Struct": "Type", "Class": "Type", "Trait": "Interface", "Enum": "Enum", "Module": "Module", "Import": "Import"}


def canonical_kind(symbol_kind: Column | str, syntax_kind: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CANONICAL.items() for x in kv])
    rest = F.create_map(*[F.lit(x) for kv in CANONICAL_FALLBACK.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _col(syntax_kind)), F.try_element_at(rest, _col(symbol_kind)), F.lit("Other"))


def canonical_address(canonical: Column | str, name: Column | str) -> Column:
    return address_of(F.concat_ws(":", F.lit("canonical"), _col(canonical), _col(name)))


# File extensions and their language.
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript-tsx", "py": "python"}


def detect_language(path: Column | str) -> Column:
    """Language of a path by its extension; null where there is no support."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.regexp_extract(_col(path), r"\.([A-Za-z0-9]+)$", 1))


# Folders that indexing leaves out.
EXCLUDED_FOLDERS = ("target", "node_modules", "__pycache__", "venv", "vendor")


def is_excluded(path: Column | str) -> Column:
    """True where a folder of the path is hidden or excluded."""
    return _col(path).rlike(r"(^|/)(\.[^./][^/]*|" + "|".join(EXCLUDED_FOLDERS) + r")/")


def normalize_path(path: Column | str) -> Column:
    """Forward slashes, one leading ./ and trailing slashes removed."""
    p = F.translate(_col(path), "\\", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^\./", ""), r"/+$", "")


def path_matches_suffix(path: Column | str, suffix: Column | str) -> Column:
    return F.endswith(normalize_path(path), normalize_path(suffix))


class Direction(Enum):
    DOWNSTREAM = "downstream"
    UPSTREAM = "upstream"
    BOTH = "both"

    @classmethod
    def parse(cls, text: str, strict: bool = True) -> Direction:
        """Strict parsing raises on unknown words; lenient parsing reads them as downstream."""
        for d in cls:
            if d.value == text.strip().lower():
                return d
        if strict:
            raise ValueError(f"unknown direction {text!r}; use downstream, upstream or both")
        return cls.DOWNSTREAM


def overlay_name(kind: str, custom: bool = False) -> str:
    return f"custom_{kind}" if custom else kind


def overlay_kind(name: str) -> tuple[str, bool]:
    """(kind, custom) of a stored overlay's name."""
    return (name.removeprefix("custom_"), True) if name.startswith("custom_") else (name, False)


def params_json(params: Column | str) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(_col(params)))))


def format_params(params: Column | str) -> Column:
    """k=0.123 pairs in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(_col(params))), lambda e: F.format_string("%s=%.3f", e["key"], e["value"])), ", ")


def node_label(kind: Column | str, span: Column | str) -> Column:
    s = _col(span)
    return F.when(s.isNull(), _col(kind)).otherwise(F.format_string("%s L%d:%d", _col(kind), s["start_line"], s["end_line"]))


def entrypoint_parts(location: Column | str) -> Column:
    """struct<file, line> of file:line, null where the text has another form."""
    c, pattern = _col(location), r"^(.*):([0-9]{1,18})$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).alias("file"), F.regexp_extract(c, pattern, 2).cast("bigint").alias("line")))


def param_or(params: Column | str, key: str, default: float) -> Column:
    return F.coalesce(F.try_element_at(_col(params), F.lit(key)), F.lit(float(default)))
