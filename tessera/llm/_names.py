"""Names for columns that come and go within an operator."""

from __future__ import annotations

from collections.abc import Iterable


def free(taken: Iterable[str], *names: str) -> tuple[str, ...]:
    """``names``, with underscores in front of those that a table has already, in whatever case."""
    seen, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in seen:
            name = f"_{name}"
        seen.add(name.lower())
        out.append(name)
    return tuple(out)
