"""What a Python worker keeps between tasks. Workers are used again by later stages, so only one operator's caches live at a time."""

from __future__ import annotations

from collections.abc import Callable

_clear: dict[str, Callable[[], None]] = {}
_holder: str | None = None


def register(owner: str, clear: Callable[[], None]) -> None:
    _clear[owner] = clear


def claim(owner: str) -> None:
    """The caches of all other operators are emptied, unless the last claim was this owner's too."""
    global _holder
    if _holder != owner:
        for name, clear in _clear.items():
            if name != owner:
                clear()
        _holder = owner
