"""Python sources, by the standard parser."""

from __future__ import annotations

import ast

from .rows import Rows


class _Walker:
    def __init__(self, rows: Rows):
        self.rows = rows
        text = rows.source
        self.starts = rows.lines
        self.text = text

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset

    def body_span(self, body: list[ast.stmt]) -> tuple[int, int]:
        return self.span(body[0])[0], self.span(body[-1])[1]

    def walk(self, root: ast.AST, caller: tuple[int, int]) -> None:
        """All nodes in source order, on a list of its own, so that nesting is bounded by memory alone."""
        todo = [(root, caller)]
        while todo:
            node, caller = todo.pop()
            caller = self.visit(node, caller)
            todo.extend((child, caller) for child in reversed(list(ast.iter_child_nodes(node))))

    def visit(self, node: ast.AST, caller: tuple[int, int]) -> tuple[int, int]:
        """Add a node's rows; the span of the function that its children are in."""
        add = self.rows.add
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            caller = self.span(node)
            add("symbol", node.name, *caller, "Function", "function_definition")
        elif isinstance(node, ast.ClassDef):
            here = self.span(node)
            add("symbol", node.name, *here, "Class", "class_definition")
            for base in node.bases:
                if isinstance(base, ast.Name):
                    add("impl", node.name, *here, base.id)
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else self.text[slice(*self.span(f))].decode("utf-8", "replace")
            add("call", name, *self.span(node), other=caller)
        self.flow(node)
        return caller

    def flow(self, node: ast.AST) -> None:
        add = self.rows.add
        if isinstance(node, ast.If):
            add("control", None, *self.span(node), "Branch", other=self.body_span(node.body))
            if node.orelse:
                add("control", None, *self.span(node), "Branch", other=self.body_span(node.orelse))
        elif isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
            add("control", None, *self.body_span(node.body), "BackEdge", other=self.span(node))
        elif isinstance(node, ast.Match):
            for case in node.cases:
                add("control", None, *self.span(node), "Branch", other=(self.span(case.pattern)[0], self.body_span(case.body)[1]))
        elif isinstance(node, ast.Return):
            add("control", None, *self.span(node), "Return", other=self.span(node))
        elif isinstance(node, ast.Name):
            single = isinstance(node.ctx, ast.Store) and getattr(node, "assigned", False)
            add("def" if single else "use", node.id, *self.span(node))
        elif isinstance(node, ast.arg):
            start = self.span(node)[0]
            add("use", node.arg, start, start + len(node.arg.encode()))
        if isinstance(node, (ast.Assign, ast.AnnAssign)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name):
                    target.assigned = True


def extract(path: str, source: bytes) -> Rows:
    """All rows of a file; one that can't be parsed has a row of kind failed."""
    rows = Rows(path, "python", source)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        rows.add("failed", type(e).__name__, 0, 0)
        return rows
    w = _Walker(rows)
    for node in tree.body:
        if isinstance(node, ast.Import):
            for a in node.names:
                if a.asname is None:
                    rows.add("import", a.name, *w.span(a))
        elif isinstance(node, ast.ImportFrom):
            if node.module:
                rows.add("import", node.module, *w.span(node))
            for a in node.names:
                if a.asname is None and a.name != "*":
                    rows.add("import", a.name, *w.span(a))
    w.walk(tree, (0, 0))
    return rows
