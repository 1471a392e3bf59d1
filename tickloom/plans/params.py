"""Documented parameters and their resolution."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Param:
    """A parameter: its kind is that of its default."""

    name: str
    default: float | bool | str
    low: float | None = None
    high: float | None = None
    integer: bool = False
    about: str = ""

    @property
    def kind(self) -> str:
        return "boolean" if isinstance(self.default, bool) else "string" if isinstance(self.default, str) else "number"

    def check(self, value: Any) -> Any:
        if self.kind == "boolean":
            if not isinstance(value, bool):
                raise ValueError(f"parameter {self.name} takes true or false, not {value!r}")
            return value
        if self.kind == "string":
            if not isinstance(value, str):
                raise ValueError(f"parameter {self.name} takes a text, not {value!r}")
            return value
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
            raise ValueError(f"parameter {self.name} takes a finite number, not {value!r}")
        if self.integer and value != int(value):
            raise ValueError(f"parameter {self.name} takes a whole number, not {value!r}")
        if self.low is not None and value < self.low:
            raise ValueError(f"parameter {self.name} is {value!r}; the least is {self.low}")
        if self.high is not None and value > self.high:
            raise ValueError(f"parameter {self.name} is {value!r}; the most is {self.high}")
        return int(value) if self.integer else float(value)

    def parse(self, text: str) -> Any:
        """A value from the command line, by the parameter's kind."""
        if self.kind == "string":
            return self.check(text)
        if self.kind == "boolean":
            if text.lower() not in ("true", "false", "1", "0"):
                raise ValueError(f"parameter {self.name} takes true or false, not {text!r}")
            return text.lower() in ("true", "1")
        try:
            return self.check(float(text))
        except ValueError as bad:
            raise ValueError(f"parameter {self.name}: {bad}") from bad


def merged(lists: Iterable[Iterable[Param]]) -> dict[str, Param]:
    """All parameters by name; equal declarations count once, different ones of a name collide."""
    out: dict[str, Param] = {}
    for params in lists:
        for p in params:
            if out.setdefault(p.name, p) != p:
                raise ValueError(f"param collision: {p.name} is declared in two ways")
    return out


def resolved(docs: Mapping[str, Param], given: Mapping[str, Any] | None) -> dict[str, Any]:
    """Defaults with what is given on top, checked."""
    if given is None:
        given = {}
    if not isinstance(given, Mapping):
        raise ValueError(f"parameters are given by name, not as {type(given).__name__}")
    if unknown := [k for k in given if k not in docs]:
        raise ValueError(f"unknown parameter {', '.join(map(str, unknown))}; there are {', '.join(docs)}")
    return {name: p.check(given[name]) if name in given else p.check(p.default) for name, p in docs.items()}
