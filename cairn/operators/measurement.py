"""What can be known about a property: how it is measured and how its failure shows."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Protocol


class GroundTruth(Enum):
    """Whether the truth about a property can be had."""

    AVAILABLE = "Available"
    CONSTRUCTIBLE = "Constructible"
    UNSOLVED = "Unsolved"


class FailureMode(Enum):
    """How a wrong value shows: not at all, by a broken invariant, or by breaking others."""

    SILENT = "Silent"
    OBSERVABLE = "Observable"
    CATASTROPHIC = "Catastrophic"


@dataclass(frozen=True)
class Violation:
    property: str
    description: str
    failure_mode: FailureMode


class Measurable[E](Protocol):
    """A property that evidence of kind E can decide on."""

    def correct(self, evidence: E) -> bool: ...

    def detect_wrong(self, evidence: E) -> Violation | None: ...

    def failure_mode(self) -> FailureMode: ...

    def ground_truth_level(self) -> GroundTruth: ...


@dataclass(frozen=True)
class ChainIntact:
    """That every row of a log fits its chain; evidence is the first row that doesn't, or None."""

    log: str

    def correct(self, evidence: int | None) -> bool:
        return evidence is None

    def detect_wrong(self, evidence: int | None) -> Violation | None:
        return None if evidence is None else Violation("chain", f"{self.log}: row {evidence} doesn't fit the chain", self.failure_mode())

    def failure_mode(self) -> FailureMode:
        return FailureMode.OBSERVABLE

    def ground_truth_level(self) -> GroundTruth:
        return GroundTruth.AVAILABLE
