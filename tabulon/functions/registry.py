"""Where functions register: name -> (least arguments, most arguments, builder(compiler, argument trees))."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[int, int | None, Callable]] = {}


def function(name: str, least: int, most: int | None = -1):
    """Register a builder; ``most`` None means any number, left out means ``least``."""

    def put(f: Callable) -> Callable:
        REGISTRY[name] = (least, least if most == -1 else most, f)
        return f

    return put


def names() -> list[str]:
    return sorted(REGISTRY)
