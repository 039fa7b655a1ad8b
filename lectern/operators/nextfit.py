"""Next fit in parallel.

Next fit closes a shard before the row that would overfill it, so where a shard begins depends on all rows before it. But
what a range of rows does to the open shard is a function of how full that shard is on entry, and such functions compose. A range's
function is a step function of the room left: rows enter while they fit, the first that doesn't starts a shard, and from there on
the range runs its own course: each start jumps to the next. Starts that lead to the same end are one step. A
range that fits whole into the room left starts none.

So ranges are summed up in parallel, groups of ranges are composed in parallel, only the groups' functions are
followed one after another, and then each group and each range goes its way from what it enters with.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_LOW = -(2**62)
#: Shards so far and the open shard's fill, before any row.
NOTHING = (0, None)


@dataclass
class Steps:
    """At room x (limit less fill, below 0 after a row that is larger than a shard) the last step with at <= x holds: `starts` shards begin, and the last of them holds `fill`. From room `whole` on (None: never) nothing begins, and `whole` is added."""

    at: np.ndarray
    starts: np.ndarray
    fill: np.ndarray
    whole: int | None

    def enter(self, limit: int, shards: int, fill: int | None) -> tuple[int, int | None]:
        """Shards and fill after the range."""
        if fill is None:  # no shard is open: the first row begins one, as after an overfull one
            x = _LOW
        else:
            x = limit - fill
            if self.whole is not None and x >= self.whole:
                return shards, fill + self.whole
        if not len(self.at):
            return shards, fill
        k = int(np.searchsorted(self.at, x, "right")) - 1
        return shards + int(self.starts[k]), int(self.fill[k])

    def then(self, other: Steps, limit: int) -> Steps:
        """This range and the one after it as one."""
        if not len(self.at):
            return other
        if not len(other.at):
            return self
        x = limit - self.fill
        k = np.searchsorted(other.at, x, "right") - 1
        starts, fill = self.starts + other.starts[k], other.fill[k]
        if other.whole is not None:
            free = x >= other.whole
            starts, fill = np.where(free, self.starts, starts), np.where(free, self.fill + other.whole, fill)
        if self.whole is None:
            return _steps(self.at, starts, fill, None)
        at = np.r_[self.at, np.maximum(other.at, 0) + self.whole]
        return _steps(at, np.r_[starts, other.starts], np.r_[fill, other.fill], None if other.whole is None else self.whole + other.whole)


def _steps(at: np.ndarray, starts: np.ndarray, fill: np.ndarray, whole: int | None) -> Steps:
    """Without steps that are empty, or like the one before them."""
    last = np.r_[at[1:] != at[:-1], True] if len(at) else np.empty(0, bool)
    at, starts, fill = at[last], starts[last], fill[last]
    new = np.r_[True, (starts[1:] != starts[:-1]) | (fill[1:] != fill[:-1])] if len(at) else last
    return Steps(at[new], starts[new], fill[new], whole)


def _jumps(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums before each row and after the last, and for each row the row that begins the next shard if this one begins one."""
    before = np.r_[0, np.cumsum(sizes)]
    following = np.searchsorted(before, before[:-1] + limit, "right") - 1
    return before, np.maximum(following, np.arange(1, len(sizes) + 1))


def steps_of(sizes: np.ndarray, limit: int) -> Steps:
    """The function of a range of rows; sizes aren't negative."""
    m = len(sizes)
    if not m:
        return Steps(*[np.empty(0, np.int64)] * 3, 0)
    before, following = _jumps(sizes, limit)
    # doubling: where the chain of starts ends, and how many it has
    end, count, jump = np.arange(m), np.ones(m, np.int64), following.copy()
    while (inside := jump < m).any():
        j = np.minimum(jump, m - 1)
        count = np.where(inside, count + count[j], count)
        end = np.where(inside, end[j], end)
        jump = np.where(inside, jump[j], jump)
    first = int(np.searchsorted(before, max(limit, 0), "right"))  # rows that can be the first that doesn't fit
    first = max(1, min(first, m))
    at = before[:first].copy()
    at[0] = _LOW
    whole = int(before[-1])
    return _steps(at, count[:first], (whole - before[end])[:first], whole if whole <= limit else None)


def starts_of(sizes: np.ndarray, limit: int, shards: int, fill: int | None) -> Iterator[tuple[int, int]]:
    """(row, shard's number) where shards begin in a range that is entered with that, preceded by (0, the open shard) if one goes on."""
    before, following = _jumps(sizes, limit)
    at = 0 if fill is None else max(0, int(np.searchsorted(before, limit - fill, "right")) - 1)
    if at:
        yield 0, shards - 1
    while at < len(sizes):
        yield at, shards
        shards, at = shards + 1, int(following[at])


def pack(s: Steps) -> tuple[bytes, int | None]:
    return np.vstack([s.at, s.starts, s.fill]).astype("<i8").tobytes(), s.whole


def unpack(raw: bytes, whole: int | None) -> Steps:
    return Steps(*np.frombuffer(raw, "<i8").reshape(3, -1), whole)
