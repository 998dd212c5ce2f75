"""Feature declarations: what to compute, from which columns, over which window."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_UNITS = {"s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
#: Names and parts of names that would leak the label (fixed values).
_FORBIDDEN = {"label", "target", "y", "is_laundering"}
_FORBIDDEN_PARTS = ("laundering", "pattern", "typology", "attempt")


class SpecError(ValueError):
    """A declaration that can't be compiled."""


def parse_window(text: str) -> int:
    """Microseconds of a window such as ``"1h"`` or ``"7d"``."""
    m = re.fullmatch(r"([1-9]\d*)(s|min|h|d)", str(text).strip().lower())
    if not m:
        raise SpecError(f"window {text!r} is not a positive number with s, min, h or d")
    return int(m[1]) * _UNITS[m[2]]


def check_no_leak(names: list[str], what: str) -> None:
    bad = [n for n in names if n.strip().lower() in _FORBIDDEN or any(p in n.lower() for p in _FORBIDDEN_PARTS)]
    if bad:
        raise SpecError(f"{what} would leak the label: {', '.join(sorted(bad))}")


@dataclass(frozen=True)
class FeatureSpec:
    """One output column. ``inputs`` maps roles (entity, value, counterparty ...) to columns; ``params`` holds window, aggregate and fill."""

    operation: str
    output: str
    inputs: dict[str, str] = field(default_factory=dict)
    params: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        check_no_leak([self.output, *self.inputs.values()], f"feature {self.output!r}")

    def role(self, name: str) -> str:
        if name not in self.inputs:
            raise SpecError(f"{self.operation} {self.output!r} lacks the input {name!r}")
        return self.inputs[name]

    def window(self) -> int:
        return parse_window(str(self.params.get("window", "")))

    def fill(self, default: float = 0.0) -> float:
        return float(self.params.get("fill_value", default))
