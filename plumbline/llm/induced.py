"""Depth-limited suffix sorting by induced sorting over disk-backed bucket queues.

Suffixes wait in queues by their first symbol, which is the priority; inside a queue they stand in the order in
which they were induced, which is their sorted order. Every queued suffix carries its common-prefix value with the one
before it: one more than the smallest value between their two inducing suffixes. A queue keeps little in memory
and appends the rest to a temporary file of the task that uses it; the file has no name and goes with the task, like a spill.

The leftmost smaller (LMS) suffixes that start the induction are sorted by inducing their substrings, naming these and sorting the reduced text of
names. Matches are wanted up to ``depth`` symbols only, so the reduced text is sorted by rank doubling to that depth, which replaces
deeper levels of recursion.
"""

from __future__ import annotations

import tempfile

import numpy as np

QUEUE_ITEMS = 1 << 16


class BucketQueues:
    """First in, first out for every symbol, of (suffix, common-prefix value) arrays."""

    def __init__(self, symbols: int) -> None:
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.file = None

    def push(self, symbol: int, suffixes: np.ndarray, values: np.ndarray) -> None:
        if len(suffixes) < QUEUE_ITEMS:
            self.parts[symbol].append((suffixes, values))
            return
        self.file = self.file or tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(suffixes.tobytes())
        self.file.write(values.tobytes())
        self.parts[symbol].append((at, len(suffixes)))

    def take(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts[symbol] = self.parts[symbol], []
        suffixes, values = [np.zeros(0, np.int32)], [np.zeros(0, np.int16)]
        for a, b in parts:
            if isinstance(a, int):
                self.file.seek(a)
                a, b = np.frombuffer(self.file.read(4 * b), np.int32), np.frombuffer(self.file.read(2 * b), np.int16)
            suffixes.append(a)
            values.append(b)
        return np.concatenate(suffixes), np.concatenate(values)

    def close(self) -> None:
        if self.file:
            self.file.close()


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low + 1 .. high]) for every pair, by a sparse table built level by level."""
    out = np.empty(len(low), np.int16)
    span = high - low
    level = np.frexp(span.astype(float))[1] - 1
    table, width = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[low[at] + 1], table[high[at] - width + 1])
        if 2 * width > len(values):
            break
        table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def _turned(values: np.ndarray) -> np.ndarray:
    """Common-prefix values of the reversed order: they belong to the pair (one before, this one), so they move by one."""
    return np.concatenate((values[:1] * 0, values[1:][::-1])).astype(np.int16)


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than its successor, and the length of the run of equal symbols that starts there."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    last = np.concatenate((change, [n - 1]))
    run = np.searchsorted(change, np.arange(n))
    end = last[run]
    follow = np.minimum(end + 1, n - 1)
    return text[end] < text[follow], end - np.arange(n) + 1


class _Sorter:
    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.text, self.depth, self.symbols = text, depth, int(text.max()) + 1
        self.smaller, self.run = _types(text)
        self.smaller[-1] = True
        self.is_lms = np.concatenate(([False], self.smaller[1:] & ~self.smaller[:-1]))

    def _grow(self, symbol: int, first: np.ndarray, values: np.ndarray, smaller: bool) -> tuple[np.ndarray, np.ndarray]:
        """A bucket's queue with what its own members induce into it, generation by generation."""
        members, carried = [first], [values]
        total, source_low = len(first), 0
        seq, vals = first, values
        generation, last_source = first, None
        while len(generation):
            before = np.maximum(generation - 1, 0)
            keep = (generation > 0) & (self.text[before] == symbol) & (self.smaller[before] == smaller)
            at = np.flatnonzero(keep) + source_low
            source_low += len(generation)
            if not len(at):
                break
            low = np.concatenate(([last_source if last_source is not None else -1], at[:-1]))
            last_source = int(at[-1])
            new = np.empty(len(at), np.int16)
            known = low >= 0
            new[~known] = 1
            new[known] = np.minimum(_range_min(vals, low[known], at[known]) + 1, self.depth)
            generation = before[at - (source_low - len(generation))]
            if not known[0]:
                # the one before it was induced from another bucket: only the run of this symbol is shared
                new[0] = min(self.depth, int(min(self.run[seq[-1]], self.run[generation[0]])))
            members.append(generation)
            carried.append(new)
            seq, vals = np.concatenate((seq, generation)), np.concatenate((vals, new))
            total += len(generation)
        return seq, vals

    def _send(self, queues: BucketQueues, symbol: int, seq: np.ndarray, vals: np.ndarray, smaller: bool) -> None:
        """What the members of a bucket induce into the other buckets."""
        before = np.maximum(seq - 1, 0)
        target = self.text[before]
        at = np.flatnonzero((seq > 0) & (self.smaller[before] == smaller) & (target != symbol))
        if not len(at):
            return
        at = at[np.argsort(target[at], kind="stable")]
        to = target[at]
        first = np.concatenate(([True], to[1:] != to[:-1]))
        new = np.ones(len(at), np.int16)  # induced from different buckets: one symbol in common
        inner = np.flatnonzero(~first)
        new[inner] = np.minimum(_range_min(vals, at[inner - 1], at[inner]) + 1, self.depth)
        cut = np.append(np.flatnonzero(first), len(at))
        places = before[at].astype(np.int32)
        for low, high in zip(cut[:-1].tolist(), cut[1:].tolist()):
            queues.push(int(to[low]), places[low:high], new[low:high])

    def _shared(self, a: int, b: int) -> int:
        """Common prefix of a larger-type and a smaller-type suffix of one bucket: the shorter run of the symbol."""
        return min(self.depth, int(min(self.run[a], self.run[b])))

    def induce(self, seeds: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes and their common-prefix values from the ordered LMS suffixes and theirs."""
        first = np.searchsorted(self.text[seeds], np.arange(self.symbols + 1))
        queues, larger = BucketQueues(self.symbols), []
        for symbol in range(self.symbols):
            waiting, carried = queues.take(symbol)
            seq, vals = self._grow(symbol, waiting, carried, smaller=False) if len(waiting) else (waiting, carried)
            larger.append((seq, vals))
            lms, lms_vals = seeds[first[symbol] : first[symbol + 1]], values[first[symbol] : first[symbol + 1]].copy()
            if len(lms):
                lms_vals[0] = self._shared(seq[-1], lms[0]) if len(seq) else 0
                seq, vals = np.concatenate((seq, lms)), np.concatenate((vals, lms_vals))
            if len(seq):
                vals = vals.copy()
                vals[0] = 0
                self._send(queues, symbol, seq, vals, smaller=False)
        queues.close()
        queues, parts = BucketQueues(self.symbols), []
        for symbol in range(self.symbols - 1, -1, -1):
            waiting, carried = queues.take(symbol)
            if symbol == 0:  # the end mark induces nothing and nothing induces it
                waiting, carried = np.array([len(self.text) - 1], np.int32), np.zeros(1, np.int16)
            seq, vals = self._grow(symbol, waiting, carried, smaller=True) if len(waiting) else (waiting, carried)
            low, low_vals = larger[symbol]
            down, down_vals = low[::-1], _turned(low_vals)
            if len(seq) and len(down):
                down_vals[0] = self._shared(down[0], seq[-1])
            all_, all_vals = np.concatenate((seq, down)), np.concatenate((vals, down_vals))
            if len(all_):
                all_vals[0] = 0
                self._send(queues, symbol, all_, all_vals, smaller=True)
            parts.append((all_[::-1], _turned(all_vals)))
        queues.close()
        parts.reverse()
        return np.concatenate([p for p, _ in parts]), np.concatenate([v for _, v in parts])

    def lms_order(self) -> np.ndarray:
        """The LMS suffixes in order, to ``depth`` symbols."""
        lms = np.flatnonzero(self.is_lms).astype(np.int32)
        seeds = lms[np.argsort(self.text[lms], kind="stable")]
        order, _ = self.induce(seeds, np.ones(len(seeds), np.int16))
        order = order[self.is_lms[order]]
        # names of LMS substrings, by their length and a fingerprint of their symbols
        end = np.full(len(self.text), len(self.text) - 1, np.int64)
        end[lms[:-1]] = lms[1:]
        prints = _fingerprints(self.text, order, end[order] + 1)
        size = end[order] - order
        name = np.cumsum(np.concatenate(([0], (prints[1:] != prints[:-1]) | (size[1:] != size[:-1]))))
        rank = np.empty(len(lms), np.int64)
        place = np.empty(len(self.text), np.int32)
        place[lms] = np.arange(len(lms), dtype=np.int32)
        rank[place[order]] = name
        reach = 1
        count = int(name[-1]) + 1
        while count < len(lms) and reach <= self.depth:  # an LMS substring has one symbol more at least
            ahead = np.concatenate((rank[reach:] + 1, np.zeros(min(reach, len(rank)), np.int64)))[: len(rank)]
            key = rank * (len(lms) + 1) + ahead
            by = np.argsort(key, kind="stable")
            sorted_key = key[by]
            new = np.cumsum(np.concatenate(([0], sorted_key[1:] != sorted_key[:-1])))
            rank = np.empty(len(lms), np.int64)
            rank[by] = new
            count, reach = int(new[-1]) + 1, reach * 2
        return lms[np.argsort(rank, kind="stable")]


def _fingerprints(text: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    from plumbline.llm.common import mix, powers

    power, inverse = powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)], out=total[1:])
    return mix((total[high] - total[low]) * inverse[low])


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common-prefix lengths of the pairs, up to ``depth``: by halving over fingerprints of prefixes."""
    from plumbline.llm.common import powers

    power, inverse = powers(len(text) + 1)
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)], out=total[1:])
    most = np.minimum(depth, len(text) - np.maximum(a, b))
    done = np.zeros(len(a), np.int64)
    step = 1 << (depth.bit_length() - 1)
    while step:
        fits = np.flatnonzero(done + step <= most)
        x, y = a[fits] + done[fits], b[fits] + done[fits]
        same = (total[x + step] - total[x]) * inverse[x] == (total[y + step] - total[y]) * inverse[y]
        done[fits[same]] += step
        step //= 2
    return done.astype(np.int16)


def suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in the order of their first ``depth`` symbols, and each one's common prefix with the one before.

    Symbols are small non-negative integers; the last one is 0 and stands nowhere else.
    """
    if len(text) == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.int16)
    sorter = _Sorter(text, depth)
    seeds = sorter.lms_order()
    values = np.concatenate(([0], _common(text, seeds[:-1].astype(np.int64), seeds[1:].astype(np.int64), depth))).astype(np.int16)
    return sorter.induce(seeds, values)
