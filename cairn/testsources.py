"""Source files made from the suppliers, and what reading them must give, for queries that are compared with SQL.

A template is source text in which `@` stands for the supplier's number.  Tags mark places: [[x]] opens and [[/x]] closes
place x.  `FACTS` states by hand what a reader must find there.  From both come the files and the SQL of the
expected rows, whose offsets are the lengths of the text before each tag.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATES = {
    "rust": """[[u]]use std::fmt::Shown@;[[/u]]
[[main]]pub fn main() { [[ms]][[mc]][[mu]]alpha@[[/mu]]()[[/mc]];[[/ms]] }[[/main]]
[[alpha]]fn alpha@() {
    [[s1]]let [[dx]]x[[/dx]] = 1;[[/s1]]
    [[s2]]let [[dy]]y[[/dy]] = [[ux]]x[[/ux]];[[/s2]]
    [[s3]]if [[uy]]y[[/uy]] > 0 [[b1]]{ [[c1]][[uc1]]beta@[[/uc1]]()[[/c1]]; }[[/b1]] [[b2]]else { [[c2]][[uc2]]common[[/uc2]]()[[/c2]]; }[[/b2]][[/s3]]
    [[s4]]while [[uy2]]y[[/uy2]] > 0 [[w]]{ [[c3]][[uc3]]beta@[[/uc3]]()[[/c3]]; }[[/w]][[/s4]]
    [[s5]]return;[[/s5]]
}[[/alpha]]
[[beta]]fn beta@() { }[[/beta]]
[[common]]fn common() { }[[/common]]
[[own]]struct Own@ { a: u8 }[[/own]]
[[kind]]enum Kind@ { A, B }[[/kind]]
[[can]]trait Can@ { }[[/can]]
[[imp]]impl Can@ for Own@ { [[meth]]fn meth@(&self) { }[[/meth]] }[[/imp]]
[[mod]]mod inner@ { }[[/mod]]
""",
    "typescript": """import { [[i1]][[ui]]Thing@[[/ui]][[/i1]] } from "./thing";
[[base]]class Base@ { }[[/base]]
[[sub]]class Sub@ extends [[ubase]]Base@[[/ubase]] { }[[/sub]]
[[face]]interface Face@ { }[[/face]]
[[en]]enum [[ue]]Color@[[/ue]] { Red }[[/en]]
[[run]]function [[ur]]run@[[/ur]]() {
    const [[da]]a[[/da]] = 1;
    const [[db]]b[[/db]] = [[ua]]a[[/ua]];
    [[if]]if ([[ub]]b[[/ub]]) [[b1]]{ [[c1]][[us]]stop@[[/us]]()[[/c1]]; }[[/b1]][[/if]]
    [[ret]]return;[[/ret]]
}[[/run]]
[[stop]]function [[ut]]stop@[[/ut]]() { }[[/stop]]
""",
    "python": """import [[i1]]os[[/i1]]
[[i2]]from package@ import [[i3]]Given@[[/i3]][[/i2]]
[[base]]class Base@:
    pass[[/base]]
[[sub]]class Sub@([[ubase]]Base@[[/ubase]]):
    pass[[/sub]]
[[one]]def one@():
    [[da]]a[[/da]] = 1
    [[db]]b[[/db]] = [[ua]]a[[/ua]]
    [[if]]if [[ub]]b[[/ub]]:
        [[b1]][[c1]][[u2]]two@[[/u2]]()[[/c1]][[/b1]][[/if]]
    [[ret]]return[[/ret]][[/one]]
[[two]]def two@():
    pass[[/two]]
""",
}
ENDINGS = {"rust": "rs", "typescript": "ts", "python": "py"}

#: (language, kind, name, extra, syntax kind, place, other place)
FACTS = [
    ("rust", "symbol", "use_declaration", "Import", "use_declaration", "u", None),
    ("rust", "import", "Shown@", None, None, "u", None),
    ("rust", "symbol", "main", "Function", "function_item", "main", None),
    ("rust", "symbol", "alpha@", "Function", "function_item", "alpha", None),
    ("rust", "symbol", "beta@", "Function", "function_item", "beta", None),
    ("rust", "symbol", "common", "Function", "function_item", "common", None),
    ("rust", "symbol", "Own@", "Struct", "struct_item", "own", None),
    ("rust", "symbol", "Kind@", "Enum", "enum_item", "kind", None),
    ("rust", "symbol", "Can@", "Trait", "trait_item", "can", None),
    ("rust", "symbol", "impl_item", "Impl", "impl_item", "imp", None),
    ("rust", "symbol", "meth@", "Function", "function_item", "meth", None),
    ("rust", "symbol", "inner@", "Module", "mod_item", "mod", None),
    ("rust", "impl", "Own@", "Can@", None, "imp", None),
    ("rust", "entry", "main", None, None, "main", None),
    ("rust", "call", "alpha@", None, None, "mc", "main"),
    ("rust", "call", "beta@", None, None, "c1", "alpha"),
    ("rust", "call", "common", None, None, "c2", "alpha"),
    ("rust", "call", "beta@", None, None, "c3", "alpha"),
    ("rust", "control", None, "Sequential", None, "s1", "s2"),
    ("rust", "control", None, "Sequential", None, "s2", "s3"),
    ("rust", "control", None, "Sequential", None, "s3", "s4"),
    ("rust", "control", None, "Sequential", None, "s4", "s5"),
    ("rust", "control", None, "Branch", None, "s3", "b1"),
    ("rust", "control", None, "Branch", None, "s3", "b2"),
    ("rust", "control", None, "BackEdge", None, "w", "s4"),
    ("rust", "control", None, "Return", None, "s5", "s5"),
    ("rust", "def", "x", None, None, "dx", None),
    ("rust", "def", "y", None, None, "dy", None),
    ("rust", "use", "x", None, None, "ux", None),
    ("rust", "use", "y", None, None, "uy", None),
    ("rust", "use", "y", None, None, "uy2", None),
    ("rust", "use", "alpha@", None, None, "mu", None),
    ("rust", "use", "beta@", None, None, "uc1", None),
    ("rust", "use", "common", None, None, "uc2", None),
    ("rust", "use", "beta@", None, None, "uc3", None),
    ("typescript", "import", "Thing@", None, None, "i1", None),
    ("typescript", "symbol", "Base@", "Class", "class_declaration", "base", None),
    ("typescript", "symbol", "Sub@", "Class", "class_declaration", "sub", None),
    ("typescript", "symbol", "Face@", "Trait", "interface_declaration", "face", None),
    ("typescript", "symbol", "Color@", "Enum", "enum_declaration", "en", None),
    ("typescript", "symbol", "run@", "Function", "function_declaration", "run", None),
    ("typescript", "symbol", "stop@", "Function", "function_declaration", "stop", None),
    ("typescript", "impl", "Sub@", "Base@", None, "sub", None),
    ("typescript", "call", "stop@", None, None, "c1", "run"),
    ("typescript", "control", None, "Branch", None, "if", "b1"),
    ("typescript", "control", None, "Return", None, "ret", "ret"),
    ("typescript", "def", "a", None, None, "da", None),
    ("typescript", "def", "b", None, None, "db", None),
    ("typescript", "use", "Thing@", None, None, "ui", None),
    ("typescript", "use", "Base@", None, None, "ubase", None),
    ("typescript", "use", "Color@", None, None, "ue", None),
    ("typescript", "use", "run@", None, None, "ur", None),
    ("typescript", "use", "stop@", None, None, "ut", None),
    ("typescript", "use", "stop@", None, None, "us", None),
    ("typescript", "use", "a", None, None, "ua", None),
    ("typescript", "use", "b", None, None, "ub", None),
    ("python", "import", "os", None, None, "i1", None),
    ("python", "import", "package@", None, None, "i2", None),
    ("python", "import", "Given@", None, None, "i3", None),
    ("python", "symbol", "Base@", "Class", "class_definition", "base", None),
    ("python", "symbol", "Sub@", "Class", "class_definition", "sub", None),
    ("python", "symbol", "one@", "Function", "function_definition", "one", None),
    ("python", "symbol", "two@", "Function", "function_definition", "two", None),
    ("python", "impl", "Sub@", "Base@", None, "sub", None),
    ("python", "call", "two@", None, None, "c1", "one"),
    ("python", "control", None, "Branch", None, "if", "b1"),
    ("python", "control", None, "Return", None, "ret", "ret"),
    ("python", "def", "a", None, None, "da", None),
    ("python", "def", "b", None, None, "db", None),
    ("python", "use", "Base@", None, None, "ubase", None),
    ("python", "use", "a", None, None, "ua", None),
    ("python", "use", "b", None, None, "ub", None),
    ("python", "use", "two@", None, None, "u2", None),
]

_TAG = re.compile(r"\[\[/?\w+\]\]")


def plain(template: str) -> str:
    return _TAG.sub("", template)


def files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content, lang): a file of each language for every supplier."""
    n = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("n"))
    each = F.array(*[F.struct(F.lit(lang).alias("lang"), F.lit(ENDINGS[lang]).alias("ending"), F.lit(plain(t)).alias("text")) for lang, t in TEMPLATES.items()])
    rows = n.select("n", F.explode(each).alias("f"))
    return rows.select(F.concat(F.lit("src/"), "f.lang", F.lit("/m"), "n", F.lit("."), "f.ending").alias("path"), F.replace("f.text", F.lit("@"), "n").cast("binary").alias("content"), F.col("f.lang").alias("lang"))


def _offset(lang: str, tag: str) -> tuple[str, int, int]:
    """The text before a tag: its length in SQL, with the number's length as `k`."""
    before = plain(TEMPLATES[lang][: TEMPLATES[lang].index(tag)])
    return f"{len(before) - before.count('@')} + {before.count('@')} * k", before.count("\n") + 1, len(before)


def _literal(x: str | None) -> str:
    return "NULL" if x is None else "replace('" + x + "', '@', n)"


def facts_sql() -> str:
    """A CTE `ir` (path, lang, kind, name, extra, syntax_kind, start_byte, end_byte, start_line, end_line, other_start, other_end)."""
    out = []
    for lang, kind, name, extra, syntax, place, other in FACTS:
        (a, line, _), (z, _, _) = _offset(lang, f"[[{place}]]"), _offset(lang, f"[[/{place}]]")
        last = plain(TEMPLATES[lang][: TEMPLATES[lang].index(f"[[/{place}]]")]).rstrip("\n").count("\n") + 1
        (oa, _, _), (oz, _, _) = (_offset(lang, f"[[{other}]]"), _offset(lang, f"[[/{other}]]")) if other else (("NULL", 0, 0), ("NULL", 0, 0))
        out.append(
            f"SELECT 'src/{lang}/m' || n || '.{ENDINGS[lang]}' AS path, '{lang}' AS lang, '{kind}' AS kind, {_literal(name)} AS name, {_literal(extra)} AS extra, {_literal(syntax)} AS syntax_kind, "
            f"({a})::BIGINT AS start_byte, ({z})::BIGINT AS end_byte, {line}::BIGINT AS start_line, {last}::BIGINT AS end_line, ({oa})::BIGINT AS other_start, ({oz})::BIGINT AS other_end FROM s"
        )
    return "s AS (SELECT s_suppkey::VARCHAR AS n, length(s_suppkey::VARCHAR) AS k FROM supplier), ir AS (" + " UNION ALL ".join(out) + ")"


def files_sql() -> str:
    """A CTE `src` (path, lang, content)."""
    each = " UNION ALL ".join("SELECT 'src/" + lang + "/m' || s_suppkey || '." + ENDINGS[lang] + "' AS path, '" + lang + "' AS lang, replace('" + plain(t).replace("'", "''") + "', '@', s_suppkey::VARCHAR) AS content FROM supplier" for lang, t in TEMPLATES.items())
    return f"src AS ({each})"
