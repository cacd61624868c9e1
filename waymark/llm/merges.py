"""Merge agendas of byte-pair vocabularies, for all parts of a batch together.

A part is a run of symbols. Its agenda holds the adjacent pairs that can merge, least rank first, leftmost first. The
agendas of many parts advance together, one candidate of each part a step, as array operations: a table by (left symbol,
right symbol) holds rank and number of the merged symbol, and the least entry of a part's column of ranks is its next
candidate. Parts over LONG symbols, for which a column would cost the square of the length, take the same candidates in
the same order from a heap. A Dropout may skip candidates; a skipped one is gone for good.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np

LONG = 48
NEVER = np.int64(2**62)
_PLACE, _SYMBOL, _FINAL = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9
_WORD = (1 << 64) - 1


class PairTable:
    """Numbers by pair of symbols: open addressing over arrays, so that a whole batch is looked up at once."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (len(pairs) * 6).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        for (a, b), value in pairs.items():
            key = a << 32 | b
            slot = (key * _PLACE & _WORD) >> 64 - bits
            while self.keys[slot] >= 0:
                slot = slot + 1 & self.last
            self.keys[slot], self.values[slot] = key, value

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pair; -1 where there is none. Symbols under 0 are in no pair."""
        key = a.astype(np.int64) << np.int64(32) | b.astype(np.int64)
        slot = ((key.view(np.uint64) * np.uint64(_PLACE)) >> self.shift).view(np.int64)
        held = self.keys[slot]
        out = self.values[slot]
        out[held != key] = -1
        astray = np.flatnonzero((held != key) & (held >= 0))
        while len(astray):
            slot[astray] = slot[astray] + 1 & self.last
            held = self.keys[slot[astray]]
            hit = held == key[astray]
            out[astray[hit]] = self.values[slot[astray[hit]]]
            astray = astray[~hit & (held >= 0)]
        return out


@dataclass(frozen=True)
class Dropout:
    """Skips a candidate if the hash of (key of its part, place in the text, merged symbol) is among the lowest `limit` of 2**32."""

    keys: np.ndarray  # 64 bits by part
    places: np.ndarray  # of the first symbol of each part
    limit: int

    def skipped(self, part: np.ndarray, at: np.ndarray, merged: np.ndarray) -> np.ndarray:
        x = self.keys[part].view(np.uint64) + (self.places[part] + at).view(np.uint64) * np.uint64(_PLACE) + merged.astype(np.uint64) * np.uint64(_SYMBOL)
        return ((x ^ (x >> np.uint64(31))) * np.uint64(_FINAL)) >> np.uint64(32) < np.uint64(self.limit)

    def skipped_one(self, key: int, place: int, merged: int) -> bool:
        x = key + place * _PLACE + merged * _SYMBOL & _WORD
        return ((x ^ x >> 31) * _FINAL & _WORD) >> 32 < self.limit


class Merges:
    """Merges by pair: (left, right) to rank and merged symbol."""

    def __init__(self, ranked: dict[tuple[int, int], tuple[int, int]]):
        self.plain = {pair: rank << 32 | merged for pair, (rank, merged) in ranked.items()}
        self.table = PairTable(self.plain)

    def apply(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, dropout: Dropout | None = None) -> None:
        """Merge each part [start, end) of `symbols` in place: a merged pair stands at its left place, -1 at the other."""
        lengths = ends - starts
        for low, high in ((2, 4), (5, 8), (9, 12), (13, 20), (21, LONG)):
            of = np.flatnonzero((lengths >= low) & (lengths <= high))
            if len(of):
                self._together(symbols, starts, lengths, of, high, dropout)
        for i in np.flatnonzero(lengths > LONG).tolist():
            part = slice(int(starts[i]), int(ends[i]))
            symbols[part] = self._long(symbols[part].tolist(), i, dropout)

    def _together(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, of: np.ndarray, wide: int, dropout: Dropout | None) -> None:
        """Agendas of the parts `of`, each of at most `wide` symbols: arrays by (place in the part, part)."""
        n = len(of)
        where = np.minimum(starts[of] + np.arange(wide + 1)[:, None], len(symbols) - 1)
        held = np.where(np.arange(wide + 1)[:, None] < lengths[of], symbols[where], -1).astype(np.int32)
        after = np.repeat(np.arange(1, wide + 2, dtype=np.int64)[:, None], n, axis=1)
        before = np.repeat(np.arange(-1, wide, dtype=np.int64)[:, None], n, axis=1)
        found = self.table.get(held[:-1].ravel(), held[1:].ravel()).reshape(wide, n)
        agenda = np.where(found >= 0, (found >> 32 << 6) | np.arange(wide, dtype=np.int64)[:, None], NEVER)  # rank, then place
        merged_to = (found & 0xFFFFFFFF).astype(np.int32)
        while True:
            best = agenda.min(axis=0)
            live = np.flatnonzero(best < NEVER)
            if not len(live):
                break
            if len(live) < 0.7 * n:  # parts that are done leave the arrays
                done = np.flatnonzero(best >= NEVER)
                _put(symbols, held[:, done], starts[of[done]], lengths[of[done]])
                held, after, before, agenda, merged_to = (np.ascontiguousarray(x[:, live]) for x in (held, after, before, agenda, merged_to))
                of, best, n = of[live], best[live], len(live)
                live = np.arange(n)
            j = best[live] & 63
            at = j * n + live
            merged = merged_to.ravel()[at]
            agenda.ravel()[at] = NEVER
            if dropout:
                taken = ~dropout.skipped(of[live], j, merged)
                live, j, at, merged = live[taken], j[taken], at[taken], merged[taken]
            right = after.ravel()[at]
            gone = right * n + live
            beyond = after.ravel()[gone]
            held.ravel()[at], held.ravel()[gone] = merged, -1
            agenda.ravel()[gone[right < wide]] = NEVER
            after.ravel()[at] = beyond
            more = beyond <= wide
            before.ravel()[(beyond * n + live)[more]] = j[more]
            self._offer(held, agenda, merged_to, j[more], beyond[more], live[more], n)
            left = before.ravel()[at]
            more = left >= 0
            self._offer(held, agenda, merged_to, left[more], j[more], live[more], n)
        _put(symbols, held, starts[of], lengths[of])

    def _offer(self, held: np.ndarray, agenda: np.ndarray, merged_to: np.ndarray, left: np.ndarray, right: np.ndarray, part: np.ndarray, n: int) -> None:
        """Enter the pairs at (left, right) of parts into the agenda, in place of what stood at left."""
        at = left * n + part
        found = self.table.get(held.ravel()[at], held.ravel()[right * n + part])
        agenda.ravel()[at] = np.where(found >= 0, (found >> 32 << 6) | left, NEVER)
        merged_to.ravel()[at] = found & 0xFFFFFFFF

    def _long(self, symbols: list[int], part: int, dropout: Dropout | None) -> list[int]:
        """The same agenda of one part from a heap."""
        get, n, held = self.plain.get, len(symbols), list(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        key, place = (int(dropout.keys[part]), int(dropout.places[part])) if dropout else (0, 0)

        def entry(left: int, right: int) -> tuple[int, int, int, int] | None:
            found = get((held[left], held[right]))
            return None if found is None else (found >> 32, left, right, found & 0xFFFFFFFF)

        agenda = [e for i in range(n - 1) if (e := entry(i, i + 1))]
        heapify(agenda)
        while agenda:
            top = heappop(agenda)
            _, left, right, merged = top
            if held[left] < 0 or after[left] != right or entry(left, right) != top:
                continue
            if dropout and dropout.skipped_one(key, place + left, merged):
                continue
            held[left], held[right] = merged, -1
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                if e := entry(left, after[left]):
                    heappush(agenda, e)
            if before[left] >= 0 and (e := entry(before[left], left)):
                heappush(agenda, e)
        return held


def _put(symbols: np.ndarray, held: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    inside = np.arange(len(held))[:, None] < lengths
    symbols[(starts + np.arange(len(held))[:, None])[inside]] = held[inside]
