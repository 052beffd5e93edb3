"""Suffix sorting of one shard by induced sorting, with queues and arrays on disk when large.

The text is read by character class. Suffixes smaller than their successor that follow a
larger one are the seeds; they are put in order first, by the same induction on their
substrings and then on the shorter string of substring names. From ordered seeds, a queue
keyed by (first character, order of arrival) gives out suffixes in order; each brings the
suffix that begins one place earlier into the queue, once upwards and once downwards. A
queue's entries of one character leave it together as an array.

Order, and so common prefixes, matter only to ``depth`` characters.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY_BYTES = 256_000_000
SPILL_ITEMS = 4_000_000
COMPARE_ROWS = 1_000_000


class Scratch:
    """Arrays in memory, or in files of a task's own folder once they exceed the allowance."""

    def __init__(self, allowance: int = MEMORY_BYTES):
        self.left, self.folder, self.files = allowance, None, 0

    def path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="suffixes-")
        self.files += 1
        return os.path.join(self.folder, str(self.files))

    def array(self, size: int, dtype) -> np.ndarray:
        need = size * np.dtype(dtype).itemsize
        self.left -= need
        return np.empty(size, dtype) if self.left >= 0 or not size else np.memmap(self.path(), dtype, "w+", shape=size)

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class SuffixQueue:
    """Suffix places by first character, each character's in order of arrival; spills to files."""

    def __init__(self, characters: int, scratch: Scratch, spill: int = SPILL_ITEMS):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(characters)]
        self.scratch, self.spill, self.held = scratch, spill, 0

    def put(self, places: np.ndarray, first: np.ndarray) -> None:
        if not len(places):
            return
        order = np.argsort(first, kind="stable")
        places, first = places[order], first[order]
        cut = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part, c in zip(np.split(places, cut), first[np.r_[0, cut]].tolist()):
            self.parts[c].append(part)
        self.held += len(places)
        if self.held > self.spill:
            self._spill()

    def _spill(self) -> None:
        """Writes the longest waiting characters to files until a quarter of the allowance is held."""
        waiting = sorted(((sum(len(p) for p in parts if not isinstance(p, np.memmap)), c) for c, parts in enumerate(self.parts)), reverse=True)
        for size, c in waiting:
            if self.held <= self.spill // 4 or not size:
                break
            loose = [p for p in self.parts[c] if not isinstance(p, np.memmap)]
            file = np.memmap(self.scratch.path(), loose[0].dtype, "w+", shape=size)
            np.concatenate(loose, out=file)
            self.parts[c] = [p for p in self.parts[c] if isinstance(p, np.memmap)] + [file]
            self.held -= size

    def take(self, c: int) -> np.ndarray | None:
        """All places now waiting under a character, or None; files that are read out go."""
        parts, self.parts[c] = self.parts[c], []
        if not parts:
            return None
        whole = np.concatenate(parts)
        for p in parts:
            if isinstance(p, np.memmap):
                os.unlink(p.filename)
            else:
                self.held -= len(p)
        return whole


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that begins a place later; the last one is."""
    n = len(text)
    out = np.ones(n, bool)
    turn = np.flatnonzero(text[1:] != text[:-1])
    rises = text[turn + 1] > text[turn]
    length = np.diff(np.r_[-1, turn])
    out[: turn[-1] + 1 if len(turn) else 0] = np.repeat(rises, length)
    return out


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, characters: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From ordered seeds, all suffixes in falling order of first character.

    Yields (small suffixes, large suffixes) of a character, the first in falling and the
    second in rising order. The last suffix of the text, a seed, is before all and not yielded.
    """
    size = np.int32 if len(text) < 1 << 31 else np.int64
    waiting, seeded = SuffixQueue(characters, scratch), SuffixQueue(characters, scratch)
    seeded.put(seeds.astype(size), text[seeds])
    large: list[list[np.ndarray]] = [[] for _ in range(characters)]

    def before(places: np.ndarray, want_small: bool) -> None:
        earlier = places[places > 0] - size(1)
        earlier = earlier[small[earlier] == want_small]
        waiting.put(earlier, text[earlier])

    for c in range(characters):
        while (batch := waiting.take(c)) is not None:
            large[c].append(batch)
            before(batch, False)
        if (batch := seeded.take(c)) is not None:
            before(batch, False)
    for c in range(characters - 1, -1, -1):
        falling = []
        while (batch := waiting.take(c)) is not None:
            falling.append(batch)
            before(batch, True)
        rising = np.concatenate(large[c]) if large[c] else np.zeros(0, size)
        large[c] = []
        before(rising[::-1], True)
        # A small suffix brings only equal or smaller characters, a large one only smaller.
        yield np.concatenate(falling) if falling else np.zeros(0, size), rising


def _ranks_of_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of a name string, to ``depth`` names: equal ones share a rank."""
    rank, step = names.astype(np.int64), 1
    while step < depth:
        following = np.zeros(len(rank), np.int64)
        following[:-step] = rank[step:] + 1
        pair = rank * (int(rank.max()) + 2) + following
        values, new = np.unique(pair, return_inverse=True)
        rank, step = new, 2 * step
        if len(values) == len(rank):
            break
    return rank


def suffix_order(text: np.ndarray, characters: int, depth: int, scratch: Scratch) -> np.ndarray:
    """Places of all suffixes, ordered by their first ``depth`` characters at least.

    The last character must be smaller than all others.
    """
    small = smaller_than_next(text)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = scratch.array(len(text), np.int32 if len(text) < 1 << 31 else np.int64)
    if len(seeds) > 1:
        sorted_seeds = []
        is_seed = np.zeros(len(text), bool)
        is_seed[seeds] = True
        for falling, _ in induce(text, small, seeds, characters, scratch):
            sorted_seeds.append(falling[is_seed[falling]])
        sorted_seeds = np.concatenate([*sorted_seeds, seeds[-1:]])[::-1]
        names = _names(text, seeds, sorted_seeds)
        if int(names.max()) + 1 < len(seeds):
            names = _ranks_of_names(names, -(-depth // 2))
        seeds = seeds[np.argsort(names, kind="stable")]
    at = len(text)
    for falling, rising in induce(text, small, seeds, characters, scratch):
        order[at - len(falling) : at] = falling[::-1]
        at -= len(falling)
        order[at - len(rising) : at] = rising
        at -= len(rising)
    order[0] = len(text) - 1
    return order


def _names(text: np.ndarray, seeds: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Of each seed, in text order, the rank of its substring up to the next seed."""
    length = np.diff(np.r_[seeds, len(text) - 1]) + 1
    index = np.searchsorted(seeds, ordered)
    size = length[index]
    same = size[1:] == size[:-1]
    a, b, n = ordered[1:][same].astype(np.int64), ordered[:-1][same].astype(np.int64), size[1:][same]
    equal, live, k = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(live):
        live = live[n[live] > k]
        differ = text[a[live] + k] != text[b[live] + k]
        equal[live[differ]] = False
        live, k = live[~differ], k + 1
    fresh = np.ones(len(ordered), bool)
    fresh[1:][same] = ~equal
    names = np.empty(len(seeds), np.int64)
    names[index] = np.cumsum(fresh) - 1
    return names


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix in order shares its first ``depth`` (4 or more) characters with the one before.

    Four 16-bit characters are compared at once.
    """
    same = np.zeros(len(order), bool)
    if len(order) < 2:
        return same
    padded = np.concatenate([text.astype(np.uint16), np.zeros(depth, np.uint16)])
    four = padded[:-3].astype(np.uint64)
    for k in (1, 2, 3):
        four |= padded[k : len(padded) - 3 + k].astype(np.uint64) << np.uint64(16 * k)
    for start in range(1, len(order), COMPARE_ROWS):
        live = np.arange(start, min(start + COMPARE_ROWS, len(order)))
        before, after = order[live - 1], order[live]
        for k in [*range(0, depth - 4, 4), depth - 4]:
            equal = four[after + k] == four[before + k]
            live, before, after = live[equal], before[equal], after[equal]
        same[live] = True
    return same
