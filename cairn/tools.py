"""The tools that the server offers: their inputs, and requests that are checked against them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from cairn.engine import Engine, workspace_trace

#: Python types of the JSON types that inputs have.
_KINDS = {"string": str, "integer": int, "number": (int, float)}
REQUIRED = object()


class InvalidParams(ValueError):
    """A request that names no tool, or whose arguments don't fit it."""


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    inputs: dict[str, tuple[str, object, str]]  # name -> (JSON type, default, description)
    call: Callable[..., object]

    def schema(self) -> dict:
        """The JSON schema of the arguments."""
        properties = {n: {"type": kind, "description": text} | ({} if default in (REQUIRED, None) else {"default": default}) for n, (kind, default, text) in self.inputs.items()}
        return {"type": "object", "properties": properties, "required": [n for n, (_, d, _) in self.inputs.items() if d is REQUIRED]}

    def checked(self, arguments: dict) -> dict:
        """The arguments with defaults filled in; raises for missing, unknown or mistyped ones."""
        out = {}
        for name, (kind, default, _) in self.inputs.items():
            value = arguments.get(name, default)
            if value is REQUIRED:
                raise InvalidParams(f"invalid arguments for tool {self.name}: missing {name}")
            if value is not None and (not isinstance(value, _KINDS[kind]) or isinstance(value, bool)):
                raise InvalidParams(f"invalid arguments for tool {self.name}: {name} must be {kind}")
            if kind == "integer" and value is not None and value < 0:
                raise InvalidParams(f"invalid arguments for tool {self.name}: {name} must not be negative")
            out[name] = value
        return out


def tools(e: Engine) -> dict[str, Tool]:
    """The catalogue."""
    at = {"file": ("string", REQUIRED, "path, relative to the source folder"), "line": ("integer", REQUIRED, "line number")}
    actor = ("string", "tool", "who asks, for provenance")
    depth = ("integer", 1, "how far to go")
    log = ("string", REQUIRED, "path of the experiment log")
    each = [
        Tool("context", "What is around the symbol at a place", at | {"depth": depth, "direction": ("string", "downstream", "downstream, upstream or both")}, e.context),
        Tool("impact", "What a change of the symbol at a place reaches", at, e.impact),
        Tool("detect_changes", "What a diff touches", {"from_ref": ("string", "HEAD", "revision to compare from"), "to_ref": ("string", None, "revision to compare to; the work tree if left out")}, e.detect_changes),
        Tool("trace", "Calls from an entry point", {"entrypoint": ("string", REQUIRED, "file:line or the name of a process"), "max_depth": depth}, e.trace),
        Tool("reindex", "Build the index anew, behind the write gate", {"actor": actor}, e.reindex),
        Tool("status", "Freshness and counts of the index", {}, e.status),
        Tool("experiment_start", "Start an experiment in the background", {"log": log, "iterations": ("integer", REQUIRED, "how many iterations at most")}, e.experiment_start),
        Tool("experiment_status", "How far an experiment is", {"run_id": ("string", REQUIRED, "what experiment_start gave")}, e.experiment_status),
        Tool("experiment_results", "The last results of an experiment", {"log": log, "last_n": ("integer", 1, "how many; 0 for ten")}, e.experiment_results),
        Tool("workspace_trace", "A shortest path between two repositories", {"workspace_dir": ("string", REQUIRED, "store of the workspace"), "from_repo": ("string", REQUIRED, "where it starts"), "to_repo": ("string", REQUIRED, "where it ends")}, lambda workspace_dir, from_repo, to_repo: workspace_trace(e.spark, workspace_dir, from_repo, to_repo)),
        Tool("assert", "Store a belief about the symbol at a place, behind the write gate", {"claim": ("string", REQUIRED, "what is believed"), "subject_file": ("string", REQUIRED, "file of the symbol"), "subject_line": ("integer", REQUIRED, "line of the symbol"), "confidence": ("number", REQUIRED, "0 to 1"), "actor": actor}, lambda claim, subject_file, subject_line, confidence, actor: {"address": e.assert_belief(claim, subject_file, subject_line, confidence, actor)}),
    ]
    return {t.name: t for t in each}


def list_tools(e: Engine) -> list[dict]:
    return [{"name": t.name, "description": t.description, "inputSchema": t.schema()} for t in tools(e).values()]


def call_tool(e: Engine, name: str, arguments: dict | None = None) -> object:
    known = tools(e)
    if name not in known:
        raise InvalidParams(f"unknown tool: {name}")
    if not isinstance(arguments or {}, dict):
        raise InvalidParams(f"invalid arguments for tool {name}: not an object")
    return known[name].call(**known[name].checked(arguments or {}))
