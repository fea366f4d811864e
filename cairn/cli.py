"""Command line: python -m cairn.cli COMMAND --help."""

from __future__ import annotations

import argparse
import json
import os
import sys

COMMANDS = {
    "index": {"--force": {"action": "store_true"}, "--overlays": {"action": "store_true"}},
    "query": {"--file": {"required": True}, "--line": {"type": int, "required": True}, "--direction": {"default": "downstream"}, "--top": {"type": int, "default": 20}},
    "status": {},
    "init": {},
    "verify": {"--log": {"required": True}, "--kind": {"default": "experiment"}},
    "analyze": {"--log": {"required": True}},
    "experiment": {"--log": {"required": True}, "--iterations": {"type": int, "default": 10}, "--fitness": {"default": "ImpactAccuracy"}},
    "federate": {"--config": {"required": True}},
    "visualize": {"--output": {"default": "graph.html"}, "--min-confidence": {"type": float, "default": 0.0}, "--relations": {"nargs": "*"}},
    "workspace-report": {},
    "serve": {},
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cairn")
    sub = out.add_subparsers(dest="command", required=True)
    for name, options in COMMANDS.items():
        p = sub.add_parser(name)
        p.add_argument("--source-dir", default=".")
        p.add_argument("--store-dir", default=".cairn")
        p.add_argument("--format", choices=["json", "table"], default="json")
        for flag, spec in options.items():
            p.add_argument(flag, **spec)
    return out


def serve(engine, lines, out) -> None:
    """One JSON request a line, one JSON answer a line; errors are answers too.

    {"list": true} gives the catalogue of tools, {"tool": name, "args": {...}} calls one.
    """
    from cairn.tools import InvalidParams, call_tool, list_tools

    for line in lines:
        try:
            request = json.loads(line)
            answer = {"tools": list_tools(engine)} if request.get("list") else call_tool(engine, request.get("tool"), request.get("args"))
        except InvalidParams as e:
            answer = {"error": str(e), "kind": "invalid_params"}
        except Exception as e:  # noqa: BLE001  the server goes on
            answer = {"error": f"{type(e).__name__}: {e}"}
        print(json.dumps(answer, default=str), file=out, flush=True)


def init(engine, folder: str = ".") -> dict:
    """Index where there is no store yet, and write the file by which clients find the server."""
    done = engine.index() if engine.store.load_meta() is None else {"status": "exists"}
    path = os.path.join(folder, ".mcp.json")
    server = {"command": sys.executable, "args": ["-m", "cairn.cli", "serve", "--source-dir", engine.source_dir, "--store-dir", engine.store_dir]}
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"mcpServers": {"cairn": server}}, f, indent=2)
    return done | {"written": path}


def table(rows: list[dict]) -> str:
    """Rows as text in aligned columns."""
    if not rows:
        return ""
    names = list(rows[0])
    cells = [names, *([str(r.get(n, "")) for n in names] for r in rows)]
    widths = [max(len(c[i]) for c in cells) for i in range(len(names))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(c, widths)).rstrip() for c in cells)


def shown(answer: object, form: str) -> str:
    """An answer as JSON, or with its lists of rows as tables."""
    if form == "json" or not isinstance(answer, dict):
        return json.dumps(answer, indent=2, default=str)
    out = []
    for key, value in answer.items():
        rows = isinstance(value, list) and value and isinstance(value[0], dict)
        out.append(f"{key}:\n{table(value)}" if rows else f"{key}: {json.dumps(value, default=str)}")
    return "\n".join(out)


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("cairn").getOrCreate()
    from cairn.engine import Engine, federate, workspace_report

    e = Engine(spark, a.source_dir, a.store_dir)
    if a.command == "serve":
        serve(e, sys.stdin, sys.stdout)
        return 0
    do = {
        "index": lambda: e.index(a.force) | ({"overlays": e.derive()} if a.overlays else {}),
        "init": lambda: init(e),
        "query": lambda: e.impact(a.file, a.line, a.direction, a.top),
        "status": e.status,
        "verify": lambda: {"verified": e.verify(a.log, a.kind)},
        "analyze": lambda: e.analyze(a.log),
        "experiment": lambda: e.experiment(a.log, a.iterations, a.fitness).__dict__,
        "federate": lambda: federate(spark, a.config, a.store_dir),
        "visualize": lambda: {"written": e.visualize(a.output, a.min_confidence, tuple(a.relations) if a.relations else None)},
        "workspace-report": lambda: workspace_report(spark, a.store_dir),
    }
    print(shown(do[a.command](), a.format))
    return 0


if __name__ == "__main__":
    sys.exit(main())
