"""Type-faithful canonical JSON and its hashes.

Mappings become sorted lists of typed keys and values, sets are sorted and tagged, lists and tuples are alike; dates, decimals, UUIDs
and bytes carry a type tag. Other leaves are refused, so equal hashes mean equal values.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from datetime import date, time
from decimal import Decimal
from operator import itemgetter
from typing import Any
from uuid import UUID


def keytag(key: Any) -> str:
    """A mapping key with its type, so that 1 and "1" differ."""
    return f"{type(key).__name__}::{key!r}"


#: The tag of each kind that JSON lacks, and how its content is written.
_TAGGED: tuple[tuple[tuple[type, ...], str, Callable[[Any], Any]], ...] = (
    ((bytes,), "__bytes__", bytes.hex),
    ((date, time), "__temporal__", lambda v: v.isoformat()),
    ((Decimal,), "__decimal__", str),
    ((UUID,), "__uuid__", str),
    ((Mapping,), "__map__", lambda v: sorted(([keytag(k), canonical_plain(x)] for k, x in v.items()), key=itemgetter(0))),
    ((set, frozenset), "__set__", lambda v: sorted(map(canonical_plain, v), key=repr)),
)


def canonical_plain(value: Any) -> Any:
    """``value`` as plain JSON types; kinds that JSON lacks become a one-entry object with a tag."""
    if isinstance(value, (list, tuple)):
        return [canonical_plain(v) for v in value]
    for kinds, tag, write in _TAGGED:
        if isinstance(value, kinds):
            return {tag: write(value)}
    if value is not None and not isinstance(value, (str, int, float)):
        raise TypeError(f"{type(value).__name__} has no canonical form")
    return value


def canonical_json(value: Any) -> str:
    """Canonical text; NaN and infinities raise."""
    return json.dumps(canonical_plain(value), sort_keys=True, allow_nan=False)


def hash_bytes(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def hash_text(text: str) -> str:
    return hash_bytes(text.encode())


def hash_value(value: Any) -> str:
    return hash_text(canonical_json(value))


def stable_seed(*parts: Any, bits: int = 32) -> int:
    """A seed that follows from its parts."""
    return int(hash_text("\x1f".join(str(p) for p in parts)), 16) % (1 << bits)
