"""Evidence: what was done, and the hash-chained logs of it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.identity import address

from .chain import ChainWriter

# Operations of the log, and of typed entries.
OPERATIONS = {"Index": "index", "Query": "query", "DetectChanges": "detect_changes", "Fuse": "fuse"}
TYPED_OPERATIONS = ("Index", "Query", "Gate", "Implement", "Substantiate", "Assert", "DetectChanges", "Fuse")
EVIDENCE_COLUMNS = ["timestamp", "operation", "input_hash", "output_hash"]
LEDGER_COLUMNS = ["seq", "timestamp", "operation", "actor", "input", "output"]


def operation_text(name: Column | str) -> Column:
    """How an operation is written in a log."""
    table = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])
    return F.try_element_at(table, F.col(name) if isinstance(name, str) else name)


def operation(text: Column | str) -> Column:
    """The operation of a log's word; unknown words are read as Fuse."""
    table = F.create_map(*[F.lit(x) for k, v in OPERATIONS.items() for x in (v, k)])
    return F.coalesce(F.try_element_at(table, F.col(text) if isinstance(text, str) else text), F.lit("Fuse"))


def log_evidence(path: str, timestamp: int, operation: str, input_hash: str, output_hash: str) -> str:
    """Append a row of evidence; returns its chain hash.  The header is written with the first row."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation!r}")
    return ChainWriter(path, "evidence", EVIDENCE_COLUMNS).append(timestamp, OPERATIONS[operation], input_hash, output_hash)


def append_ledger(path: str, sequence: int, timestamp: int, operation: str, actor: str, input_hash: str, output_hash: str) -> str:
    """Append a row of the governance ledger; returns its chain hash."""
    return ChainWriter(path, "ledger", LEDGER_COLUMNS).append(sequence, timestamp, operation, actor, input_hash, output_hash)


def content_chain(content_hash: str, previous_hash: str) -> str:
    """The hash that chains a content address to the one before it."""
    return address(content_hash + previous_hash)


@dataclass(frozen=True)
class TypedEvidence:
    entry_id: int
    timestamp: int
    operation: str
    actor: str
    target: str
    content_hash: str
    previous_hash: str
    chain_hash: str

    def __post_init__(self) -> None:
        if self.operation not in TYPED_OPERATIONS:
            raise ValueError(f"unknown operation {self.operation!r}")

    @classmethod
    def chained(cls, entry_id: int, timestamp: int, operation: str, actor: str, target: str, content: str, previous_hash: str) -> TypedEvidence:
        digest = address(content)
        return cls(entry_id, timestamp, operation, actor, target, digest, previous_hash, content_chain(digest, previous_hash))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> TypedEvidence:
        """Raises ValueError for text that is no entry."""
        try:
            return cls(**json.loads(text))
        except TypeError as e:
            raise ValueError(str(e)) from e
