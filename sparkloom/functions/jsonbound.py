"""JSON values within bounds: one walk, whose limits and labels are parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Bounds:
    """What a bounded value may hold. deep gives what stands for a value below `depth` levels (containers alone unless `scalars`); a list of more than `items` is its first `head`
    and last `tail`, under the names in `ends` (none: a plain list); a string of more than `chars` is its first `lead` letters, and its last `trail` behind its length."""

    keys: int
    items: int
    head: int
    chars: int
    lead: int
    tail: int = 0
    trail: int = 0
    depth: int | None = None
    deep: Callable[[object], object] = lambda value: {"bounded": True}
    scalars: bool = False
    omitted: str = ""
    ends: tuple[str, str, str] | None = None
    order: Callable[[str], tuple] = lambda key: (key,)


def bound(value: object, b: Bounds, level: int = 0) -> object:
    """The value within the bounds; numbers, booleans and null stay."""
    nested = isinstance(value, dict | list)
    if b.depth is not None and level >= b.depth and (nested or b.scalars):
        return b.deep(value)
    if isinstance(value, str):
        if len(value) <= b.chars:
            return value
        return value[: b.lead] + (f"…<{len(value)} chars>…{value[-b.trail :]}" if b.trail else "…")
    if not nested:
        return value
    below = lambda some: [bound(x, b, level + 1) for x in some]
    if isinstance(value, list):
        if len(value) <= b.items:
            return below(value)
        cut = below(value[: b.head]), below(value[len(value) - b.tail :])
        return dict(zip(b.ends, (len(value), *cut), strict=True)) if b.ends else cut[0]
    names = sorted(value, key=lambda k: b.order(str(k)))
    kept = dict(zip(map(str, names), below(value[k] for k in names[: b.keys]), strict=False))
    if b.omitted and len(names) > b.keys:
        kept[b.omitted] = len(names) - b.keys
    return kept
