"""Depth and state before each token, as compositions of transitions.

What a run of tokens does to the state of strings, brackets, fences and lines is a function, and such functions compose. So nothing
here walks token by token:

- strings: each token maps the three states (outside, in a string, after a backslash in it) to three; there are 27 such maps, and
  their running compositions take a logarithmic number of steps over all tokens of a batch;
- brackets (outside of strings): depths are running sums less their running minima, and the innermost
  bracket is the last one that opened at the depth;
- lines: whether a token begins a line is told by the last token before it that isn't blank;
- fences: only tokens that begin a line and look like a fence are looked at one by one.

A long text is cut where no token can cross. `effect` sums up a piece for any state that it may be entered in, `Effect.then` composes
pieces, and `Effect.on` gives the state after it; so each piece is annotated on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: States, and the deepest level.
PLAIN, JSON_OBJECT, JSON_ARRAY, JSON_STRING, JSON_ESCAPE, MD_TEXT, MD_OUTER, MD_INNER, MD_CODE = range(9)
MAX_DEPTH = 32
#: Tokens that are an escape as a whole.
ESCAPES = ('\\"', "\\\\", "\\n")

Fence = tuple[str, int]


def _code(outside: int, inside: int, escaped: int) -> int:
    return outside + 3 * inside + 9 * escaped


_MAPS = np.array([[c % 3, c // 3 % 3, c // 9] for c in range(27)], np.uint8)
#: _AFTER[f, g]: the map that is f and then g.
_AFTER = np.array([[_code(*_MAPS[g][_MAPS[f]]) for g in range(27)] for f in range(27)], np.uint8)
_OTHER, _QUOTE, _BACKSLASH = _code(0, 1, 1), _code(1, 0, 1), _code(0, 2, 1)


@dataclass(frozen=True)
class State:
    """What the tokens before leave behind: 0, 1, 2 for strings, open brackets, open fences, and whether a line begins."""

    string: int = 0
    brackets: str = ""
    fences: tuple[Fence, ...] = ()
    fresh: bool = True


START = State()


def _run_of(token: str) -> tuple[str, int, str] | None:
    """Fence character, its run's length and what follows it, of a token that begins with such a character."""
    t = token.strip()
    if not t or t[0] not in "`~":
        return None
    rest = t.lstrip(t[0])
    return t[0], len(t) - len(rest), rest.strip()


class _Kinds:
    """What matters of each distinct token."""

    def __init__(self, names: list[str]):
        n = len(names)
        self.map, self.bracket, self.line = np.full(n, _OTHER, np.uint8), np.zeros(n, np.int8), np.ones(n, np.uint8)
        self.escape, self.fence = np.zeros(n, bool), np.zeros(n, bool)
        self.runs: list[tuple[str, int, str] | None] = [None] * n
        for i, t in enumerate(names):
            if t[:1].isalnum():
                if "\n" not in t:
                    continue
            elif t == '"':
                self.map[i] = _QUOTE
            elif t == "\\":
                self.map[i] = _BACKSLASH
            elif t in ("{", "["):
                self.bracket[i] = 1 if t == "{" else 2
            elif t in ("}", "]"):
                self.bracket[i] = -1
            elif t in ESCAPES:
                self.escape[i] = True
            elif (run := _run_of(t)) is not None:
                self.runs[i], self.fence[i] = run, True
            end = t.rfind("\n")
            if not t[end + 1 :].strip():
                self.line[i] = 2 if end >= 0 else 0


def _last_before(there: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each place, the number of the last marked one before it in its row, or -1."""
    number = np.cumsum(there) - there - 1
    at = np.flatnonzero(there)
    ok = number >= 0
    ok[ok] = rows[at[number[ok]]] == rows[ok]
    return np.where(ok, number, -1)


class Batch:
    """Tokens of several texts one after another; `offsets` are where texts begin and end."""

    def __init__(self, tokens: pa.Array | Sequence[str], offsets: np.ndarray):
        found = (tokens if isinstance(tokens, pa.Array) else pa.array(tokens, pa.string())).dictionary_encode()
        self.ids = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.kinds = _Kinds(found.dictionary.to_pylist())
        self.offsets = np.asarray(offsets, np.int64)
        self.rows = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        self.maps = self.kinds.map[self.ids]
        self.lines = self.kinds.line[self.ids]

    def strings(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The string state before each token, and after each text."""
        first, filled = self.offsets[:-1], np.diff(self.offsets) > 0
        maps = self.maps.copy()
        start = _MAPS[maps[first[filled]], entry[filled]]
        maps[first[filled]] = _code(1, 1, 1) * start  # from here on what came before doesn't matter
        step, longest = 1, int(np.diff(self.offsets).max(initial=0))
        while step < longest:
            maps[step:] = _AFTER[maps[:-step], maps[step:]]
            step *= 2
        after = _MAPS[maps, 0]
        before = np.r_[0, after[:-1]] if len(after) else after
        before[first[filled]] = entry[filled]
        out = entry.copy()
        out[filled] = after[self.offsets[1:][filled] - 1]
        return before, out

    def fresh(self, entry: np.ndarray) -> np.ndarray:
        """Whether each token begins a line, blanks aside."""
        said = self.lines > 0
        last = _last_before(said, self.rows)
        begins = self.lines[said] == 2
        return np.where(last >= 0, begins[last] if len(begins) else False, entry[self.rows])

    def fence_at(self, i: int) -> tuple[str, int, bool] | None:
        """Character, length and whether it can close, of a fence that begins at a token."""
        char, n, rest = self.kinds.runs[self.ids[i]]
        if n >= 3:
            return char, n, not rest
        if n > 1 or rest:
            return None
        n, end = 0, self.offsets[self.rows[i] + 1]
        while i < end and (run := self.kinds.runs[self.ids[i]]) and run[0] == char and not run[2]:
            n, i = n + run[1], i + 1
        return (char, n, True) if n >= 3 else None

    def annotate(self, entry: Sequence[State] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Depth and state before each token."""
        entry = entry or [START] * (len(self.offsets) - 1)
        string, _ = self.strings(np.array([e.string for e in entry], np.uint8))
        fresh = self.fresh(np.array([e.fresh for e in entry], bool))
        depth, kind = self._brackets(string, entry)
        fences = self._fences(fresh, entry)
        escape = (string == 2) | (string == 1) & self.kinds.escape[self.ids]
        state = np.select(
            [escape, string == 1, (depth > 0) & (kind == 1), depth > 0, fences > 1, fences == 1, fresh],
            [JSON_ESCAPE, JSON_STRING, JSON_OBJECT, JSON_ARRAY, MD_INNER, MD_OUTER, PLAIN],
            MD_TEXT,
        )
        return np.minimum(depth + fences, MAX_DEPTH).astype(np.int32), state.astype(np.int32)

    def _brackets(self, string: np.ndarray, entry: Sequence[State]) -> tuple[np.ndarray, np.ndarray]:
        """Open brackets before each token, and the innermost one: 1 an object, 2 an array."""
        held = np.array([len(e.brackets) for e in entry], np.int64)
        inner = np.array([0 if not e.brackets else 1 if e.brackets[-1] == "{" else 2 for e in entry])
        there = (string == 0) & (self.kinds.bracket[self.ids] != 0)
        at = np.flatnonzero(there)
        last = _last_before(there, self.rows)
        if not len(at):
            return held[self.rows], inner[self.rows]
        rows, what = self.rows[at], self.kinds.bracket[self.ids[at]].astype(np.int64)
        step = np.where(what > 0, 1, -1)
        sums = np.cumsum(step)
        first = np.r_[True, rows[1:] != rows[:-1]]
        base = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        total = sums - (sums - step)[base] + held[rows]
        far = len(at) + int(held.max()) + 1  # rows lie so far apart that a row's minimum is its own
        lowest = np.minimum.accumulate(total - rows * far) + rows * far
        depth = total - np.minimum(lowest, 0)
        # the innermost bracket: the last one in the row that opened at this depth
        level = rows * (int(depth.max()) + 1) + depth
        order = np.argsort(level, kind="stable")
        opened = np.maximum.accumulate(np.where(what[order] > 0, np.arange(len(order)), -1))
        same = (opened >= 0) & (level[order][opened] == level[order])
        kind = np.empty(len(at), np.int64)
        kind[order] = np.where(same, what[order][opened], 0)
        for i in np.flatnonzero((kind == 0) & (depth > 0)):
            kind[i] = 1 if entry[rows[i]].brackets[depth[i] - 1] == "{" else 2
        return np.where(last >= 0, depth[last], held[self.rows]), np.where(last >= 0, kind[last], inner[self.rows])

    def _fences(self, fresh: np.ndarray, entry: Sequence[State]) -> np.ndarray:
        """Open fences before each token."""
        there = np.zeros(len(self.ids), bool)
        counts, stack, row = [], [], -1
        for i in np.flatnonzero(fresh & self.kinds.fence[self.ids]).tolist():
            if self.rows[i] != row:
                row = int(self.rows[i])
                stack = list(entry[row].fences)
            if f := self.fence_at(i):
                _meet(stack, f)
                there[i] = True
                counts.append(len(stack))
        last = _last_before(there, self.rows)
        before = np.array([len(e.fences) for e in entry], np.int64)[self.rows]
        return np.where(last >= 0, np.array(counts, np.int64)[last], before) if counts else before

    def effects(self) -> list[Effect]:
        """What each text does to the state it's entered in."""
        n = len(self.offsets) - 1
        ends, moves = [], []
        for s in range(3):
            string, end = self.strings(np.full(n, s, np.uint8))
            what = np.where(string == 0, self.kinds.bracket[self.ids], 0)
            at = np.flatnonzero(what)
            net = [(0, "")] * n
            for i, w in zip(self.rows[at].tolist(), what[at].tolist(), strict=True):
                pops, pushed = net[i]
                net[i] = (pops, pushed + "{["[w - 1]) if w > 0 else (pops, pushed[:-1]) if pushed else (pops + 1, "")
            ends.append(end.tolist())
            moves.append(net)
        met, left = [], []
        for fresh in (False, True):
            begins = self.fresh(np.full(n, fresh))
            fences: list[list] = [[] for _ in range(n)]
            for i in np.flatnonzero(begins & self.kinds.fence[self.ids]).tolist():
                if f := self.fence_at(i):
                    fences[int(self.rows[i])].append((*f[:2], f[2]))
            met.append([_reduced(f) for f in fences])
            said = np.flatnonzero(self.lines > 0)
            last = np.full(n, -1)
            last[self.rows[said]] = said  # the last one stays
            left.append([fresh if k < 0 else bool(self.lines[k] == 2) for k in last.tolist()])
        return [Effect(tuple(e[i] for e in ends), tuple(m[i] for m in moves), tuple(f[i] for f in met), tuple(x[i] for x in left)) for i in range(n)]


def _meet(stack: list[Fence], f: tuple[str, int, bool]) -> None:
    char, n, closes = f
    if closes and stack and stack[-1][0] == char and n >= stack[-1][1]:
        stack.pop()
    else:
        stack.append((char, n))


def _reduced(fences: Sequence[tuple[str, int, bool]]) -> tuple[tuple[str, int, bool], ...]:
    """The same effect on any stack, shorter: a fence that surely opens and the one that closes it vanish, and what can't close what it meets opens."""
    out: list[tuple[str, int, bool]] = []
    for char, n, closes in fences:
        if out and not out[-1][2] and closes:
            if out[-1][0] == char and n >= out[-1][1]:
                out.pop()
                continue
            closes = False
        out.append((char, n, closes))
    return tuple(out)


@dataclass(frozen=True)
class Effect:
    """By the string state on entry: the one on exit, and how many brackets close and which open; by whether a line begins on entry: fences met, and whether a line begins on exit."""

    strings: tuple[int, int, int]
    brackets: tuple[tuple[int, str], tuple[int, str], tuple[int, str]]
    fences: tuple[tuple[tuple[str, int, bool], ...], tuple[tuple[str, int, bool], ...]]
    fresh: tuple[bool, bool]

    def then(self, other: Effect) -> Effect:
        def both(s: int) -> tuple[int, str]:
            pops, pushed = self.brackets[s]
            more, opened = other.brackets[self.strings[s]]
            return (pops, pushed[: len(pushed) - more] + opened) if more <= len(pushed) else (pops + more - len(pushed), opened)

        return Effect(
            tuple(other.strings[x] for x in self.strings),
            (both(0), both(1), both(2)),
            tuple(_reduced(self.fences[k] + other.fences[self.fresh[k]]) for k in (0, 1)),
            tuple(other.fresh[x] for x in self.fresh),
        )

    def on(self, s: State) -> State:
        pops, pushed = self.brackets[s.string]
        stack = list(s.fences)
        for f in self.fences[s.fresh]:
            _meet(stack, f)
        return State(self.strings[s.string], s.brackets[: max(0, len(s.brackets) - pops)] + pushed, tuple(stack), self.fresh[s.fresh])


def annotate(tokens: Sequence[str]) -> tuple[list[int], list[int]]:
    """Depths and states of one text's tokens."""
    depth, state = Batch(list(tokens), np.array([0, len(tokens)])).annotate()
    return depth.tolist(), state.tolist()


def annotate_lists(lists: pa.Array, entry: Sequence[State] | None = None) -> tuple[pa.Array, pa.Array]:
    """Depth and state lists of token lists; a null list is empty."""
    filled = lists.fill_null([]) if lists.null_count else lists
    offsets = np.r_[0, np.cumsum(filled.value_lengths().to_numpy(zero_copy_only=False))]
    made = Batch(filled.flatten(), offsets).annotate(entry)
    kind = pa.int32() if offsets[-1] < 2**31 else pa.int64()
    cls = pa.ListArray if kind == pa.int32() else pa.LargeListArray
    return tuple(cls.from_arrays(pa.array(offsets, kind), pa.array(x)) for x in made)


def effects_of(lists: pa.Array) -> Iterator[Effect]:
    filled = lists.fill_null([]) if lists.null_count else lists
    yield from Batch(filled.flatten(), np.r_[0, np.cumsum(filled.value_lengths().to_numpy(zero_copy_only=False))]).effects()
