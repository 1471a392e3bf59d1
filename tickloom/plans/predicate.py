"""Boolean trees over filters: their notation in JSON, and how they compile to columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.operators.filters import need

DEEPEST, MOST_LEAVES = 3, 12


@dataclass(frozen=True)
class Node:
    """kind: filter, and, or, not. id: the filter of a leaf."""

    kind: str
    children: tuple[Node, ...] = ()
    id: str = ""

    def leaves(self) -> Iterator[str]:
        """The filters of the leaves, in order, repeated ones included."""
        if self.kind == "filter":
            yield self.id
        for c in self.children:
            yield from c.leaves()

    def filters(self) -> list[str]:
        return list(dict.fromkeys(self.leaves()))

    def __str__(self) -> str:
        if self.kind == "filter":
            return self.id
        if self.kind == "not":
            return f"NOT({self.children[0]})"
        return f" {self.kind.upper()} ".join(map(str, self.children))


def leaf(filter_id: str) -> Node:
    return Node("filter", id=need(filter_id).id)


def both(*children: Node | str) -> Node:
    return Node("and", tuple(leaf(c) if isinstance(c, str) else c for c in children))


def either(*children: Node | str) -> Node:
    return Node("or", tuple(leaf(c) if isinstance(c, str) else c for c in children))


def negated(child: Node | str) -> Node:
    return Node("not", (leaf(child) if isinstance(child, str) else child,))


def parse(raw: Any) -> Node:
    """A tree from its JSON form: a filter's id, or an object with exactly one of all, any (lists) and not."""
    node = _parse(raw, 0)
    if (n := sum(1 for _ in node.leaves())) > MOST_LEAVES:
        raise ValueError(f"the predicate has {n} leaves; the most is {MOST_LEAVES}")
    return node


def _parse(raw: Any, depth: int) -> Node:
    if isinstance(raw, str):
        return leaf(raw)
    if not isinstance(raw, dict):
        raise ValueError(f"a predicate is a filter's id or an object with all, any or not; this is {raw!r}")
    if depth == DEEPEST:
        raise ValueError(f"groups may be nested {DEEPEST} deep")
    keys = [k for k in ("all", "any", "not") if raw.get(k) is not None]
    if len(keys) != 1:
        raise ValueError(f"a group has exactly one of all, any and not; this has {', '.join(keys) or 'none'}")
    key = keys[0]
    if key == "not":
        return Node("not", (_parse(raw["not"], depth + 1),))
    if not isinstance(raw[key], list) or not raw[key]:
        raise ValueError(f"{key} takes a list with at least one member")
    return Node("and" if key == "all" else "or", tuple(_parse(c, depth + 1) for c in raw[key]))


@dataclass(frozen=True)
class Compiled:
    passed: Column
    failed: Column
    reached: tuple[tuple[str, Column], ...]  # leaves in order, with the condition under which each is evaluated


def gate(filter_id: str) -> Column:
    """The column that holds a filter's gate."""
    return F.col(f"gate_{filter_id}")


def none() -> Column:
    return F.array().cast("array<string>")


def compiled(node: Node, short: bool, reach: Column | None = None) -> Compiled:
    """Columns over the gates. short: children are evaluated in order until the result is known, else all of them."""
    reach = F.lit(True) if reach is None else reach
    if node.kind == "filter":
        p = gate(node.id)
        return Compiled(p, F.when(p, none()).otherwise(F.array(F.lit(node.id))), ((node.id, reach),))
    if node.kind == "not":
        c = compiled(node.children[0], short, reach)
        return Compiled(~c.passed, none(), c.reached)
    done, now = [], reach
    for child in node.children:
        c = compiled(child, short, now)
        done.append(c)
        if short:
            now = now & (c.passed if node.kind == "and" else ~c.passed)
    reached = tuple(x for c in done for x in c.reached)
    if node.kind == "and":
        passed = reduce(Column.__and__, (c.passed for c in done))
        return Compiled(passed, F.flatten(F.array(*(F.when(c.passed, none()).otherwise(c.failed) for c in done))), reached)
    passed = reduce(Column.__or__, (c.passed for c in done))
    return Compiled(passed, F.when(passed, none()).otherwise(F.flatten(F.array(*(c.failed for c in done)))), reached)
