"""Compressed bitmaps of ordinals: sorted 16-bit arrays or 65536-bit words by container, as in published designs."""

from __future__ import annotations

import numpy as np

#: A container with at least this many members is kept as bits, a smaller one as a sorted array.
DENSE = 4096


class OrdinalBitmap:
    """A set of non-negative ordinals below 2**48, held by their upper bits in containers of 65536."""

    __slots__ = ("containers",)

    def __init__(self, containers: dict[int, np.ndarray] | None = None) -> None:
        self.containers = containers or {}

    @classmethod
    def of(cls, ordinals: np.ndarray) -> "OrdinalBitmap":
        """From ordinals in any order, repeats allowed."""
        ordinals = np.unique(np.asarray(ordinals, dtype=np.int64))
        high = ordinals >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(part[0] >> 16): _packed((part & 0xFFFF).astype(np.uint16)) for part in np.split(ordinals, cuts) if len(part)})

    def and_not(self, other: "OrdinalBitmap") -> "OrdinalBitmap":
        """The ordinals of this bitmap that the other lacks."""
        out = {}
        for key, mine in self.containers.items():
            theirs = other.containers.get(key)
            if theirs is None:
                out[key] = mine
            elif mine.dtype == np.uint64 and theirs.dtype == np.uint64:
                out[key] = mine & ~theirs
            else:
                members = _members(mine)
                out[key] = members[~_has(theirs, members)]
        return OrdinalBitmap({k: v for k, v in out.items() if v.any() or (v.dtype == np.uint16 and len(v))})

    def and_(self, other: "OrdinalBitmap") -> "OrdinalBitmap":
        """The ordinals of both."""
        out = {}
        for key in self.containers.keys() & other.containers.keys():
            mine, theirs = self.containers[key], other.containers[key]
            if mine.dtype == np.uint64 and theirs.dtype == np.uint64:
                out[key] = mine & theirs
            else:
                few, many = (mine, theirs) if mine.dtype == np.uint16 else (theirs, mine)
                out[key] = few[_has(many, few)]
        return OrdinalBitmap({k: v for k, v in out.items() if v.any() or (v.dtype == np.uint16 and len(v))})

    def ordinals(self) -> np.ndarray:
        """The members, ascending."""
        parts = [_members(self.containers[k]).astype(np.int64) + (k << 16) for k in sorted(self.containers)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def __len__(self) -> int:
        return sum(int(np.bitwise_count(c).sum()) if c.dtype == np.uint64 else len(c) for c in self.containers.values())


def _packed(members: np.ndarray) -> np.ndarray:
    if len(members) < DENSE:
        return members
    bits = np.zeros(65536, dtype=np.uint8)
    bits[members] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _members(container: np.ndarray) -> np.ndarray:
    if container.dtype == np.uint16:
        return container
    return np.flatnonzero(np.unpackbits(container.view(np.uint8), bitorder="little")).astype(np.uint16)


def _has(container: np.ndarray, members: np.ndarray) -> np.ndarray:
    if container.dtype == np.uint64:
        return (container[members >> 6] >> (members & 63).astype(np.uint64)) & np.uint64(1) == 1
    at = np.minimum(np.searchsorted(container, members), len(container) - 1)
    return container[at] == members if len(container) else np.zeros(len(members), bool)
