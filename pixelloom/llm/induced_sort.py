"""External induced suffix sorting with common-prefix values, in bulk.

Suffixes whose type changes (leftmost smaller ones, the seeds) are named by what stands up to the next seed. The sequence of names is
sorted by the same procedure, recursively, until all names differ. All other suffixes are induced from the seeds in
two sweeps over the alphabet, one up and one down. A sweep keeps a priority queue of suffix tuples (position, common prefix with the
tuple before), ordered by first symbol and then by rank. Ranks only grow during a sweep, so the queue is a list of runs for each symbol.

Sequences of very many names would make a run of each suffix. There a tuple stands for all symbols from its position up to the next
change of type, and for the rank of the suffix there; it goes into the queue under a window of neighbouring names. What a tuple needs is known when its
window is taken out, so a window's tuples are put in order at once: first those induced from seeds, then those induced from these.

Memory is bounded by `budget`: beyond it the queues move runs to a file, and text, types, seeds, names, and the order lie in files
that are mapped, all of them unnamed and gone with the task. Arrays in memory have at most `CHUNK` elements or one window's tuples.

The common prefix of two suffixes induced one after the other is one more than the least common prefix of their sources and all
suffixes swept in between. That of two neighbouring seeds follows from the number of names they share, which the recursion gives, and
from the first symbols behind those. Values are cut at `depth`, and the order of suffixes that agree in `depth` symbols is left open.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that one sort may hold in memory before it goes to disk, and elements of an array that is worked on at once.
BUDGET, CHUNK = 256 << 20, 1 << 20
#: Alphabets of up to so many symbols are swept symbol by symbol; larger ones are dealt into windows of about WINDOW tuples.
SYMBOLS, WINDOW = 1024, 1 << 20
_FAR = np.uint16(65535)


class Space:
    """Arrays within a budget of bytes; those beyond it are mapped files without a name, gone with the task."""

    def __init__(self, budget: int = BUDGET):
        self.budget, self.left, self.on_disk = budget, budget // 2, 0

    def array(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.left or not n:
            self.left -= size
            return np.zeros(n, kind)
        self.on_disk += size
        return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))

    def keep(self, a: np.ndarray) -> np.ndarray:
        out = self.array(len(a), a.dtype)
        out[:] = a
        return out

    def free(self, *arrays: np.ndarray) -> None:
        self.left += sum(a.nbytes for a in arrays if not isinstance(a, np.memmap))

    def queue(self, windows: int) -> RunQueue:
        return RunQueue(windows, self.budget // 4, self)


def chunks(n: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, CHUNK):
        yield a, min(n, a + CHUNK)


class RunQueue:
    """Runs of tuples (position, prefix) by window, each window's in the order they came; beyond the budget the largest windows' runs go to disk."""

    def __init__(self, windows: int, budget: int, space: Space):
        self.runs: list[list] = [[] for _ in range(windows)]
        self.held, self.budget, self.file, self.space = 0, budget, None, space

    def push(self, window: int, position: np.ndarray, prefix: np.ndarray) -> None:
        self.runs[window].append((position, prefix))
        self.held += position.nbytes + prefix.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        size = [sum(r[0].nbytes for r in runs if len(r) == 2) for runs in self.runs]
        for window in np.argsort(size)[::-1]:
            if self.held <= self.budget // 2:
                break
            for i, r in enumerate(self.runs[window]):
                if len(r) == 2:
                    at = self.file.tell()
                    self.file.write(r[0].tobytes())
                    self.file.write(r[1].tobytes())
                    self.runs[window][i] = (at, len(r[0]), len(r[1]))
                    self.held -= r[0].nbytes + r[1].nbytes
                    self.space.on_disk += r[0].nbytes + r[1].nbytes

    def pop(self, window: int, most: int = 1 << 62, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The first runs of a window, or its last ones, in their order: as many as have `most` tuples together, one at least."""
        runs, got, n = self.runs[window], [], 0
        while runs and (not got or n < most):
            r = runs.pop() if last else runs[len(got)]
            if len(r) == 2:
                self.held -= r[0].nbytes + r[1].nbytes
            else:
                at, size, prefixes = r
                self.file.seek(at)
                r = np.frombuffer(self.file.read(8 * size), np.int64), np.frombuffer(self.file.read(2 * prefixes), np.uint16)
            got.append(r)
            n += len(r[0])
            if not last and len(got) == len(runs):
                break
        if not got:
            return None
        if last:
            got.reverse()
        else:
            del runs[: len(got)]
        return got[0] if len(got) == 1 else (np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo : hi + 1]) of many ranges, from minima over power-of-two stretches."""
    out = np.empty(len(lo), values.dtype)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    table, width = values, 1
    for k in range(int(level.max()) + 1 if len(lo) else 0):
        here = level == k
        if here.any():
            out[here] = np.minimum(table[lo[here]], table[hi[here] - width + 1])
        if len(table) > width:
            table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


class _Sweep:
    """One sweep's queue and, for each symbol, the least common prefix swept since something was last queued under it."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int, space: Space):
        self.text, self.depth, self.queue = text, depth, space.queue(symbols)
        self.least = np.full(symbols, _FAR)

    def visit(self, position: np.ndarray, prefix: np.ndarray, wanted: np.ndarray) -> None:
        """Sweeps over suffixes in order; those before the wanted ones are queued. prefix: common with the one swept before."""
        at = np.flatnonzero(wanted)
        after = np.minimum.accumulate(prefix[::-1])[::-1]
        if not len(at):
            np.minimum(self.least, after[0], out=self.least)
            return
        symbol = self.text[position[at] - 1]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        first = np.r_[True, symbol[1:] != symbol[:-1]]
        lo = np.where(first, 0, np.r_[0, at[:-1] + 1])
        least = range_minima(prefix, lo, at)
        heads = np.flatnonzero(first)
        least[heads] = np.minimum(least[heads], self.least[symbol[heads]])
        np.minimum(self.least, after[0], out=self.least)
        ends = np.r_[heads[1:], len(at)]
        last = at[ends - 1] + 1
        self.least[symbol[heads]] = np.where(last < len(after), np.r_[after, _FAR][last], _FAR)
        least = np.minimum(least, self.depth - 1) + np.uint16(1)
        before, push = position[at] - 1, self.queue.push
        for w, a, b in zip(symbol[heads].tolist(), heads.tolist(), ends.tolist()):
            push(w, before[a:b], least[a:b])


def _types(text: np.ndarray, space: Space) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last is."""
    n = len(text)
    smaller = space.array(n, bool)
    smaller[n - 1] = True
    for a, b in reversed([*chunks(n - 1)]):
        x = np.asarray(text[a : b + 1])
        up, same = x[:-1] < x[1:], x[:-1] == x[1:]
        place = np.where(same, b - a, np.arange(b - a))
        decides = np.minimum.accumulate(place[::-1])[::-1]
        smaller[a:b] = np.r_[up, smaller[b]][decides]
    return smaller


def _seeds(smaller: np.ndarray, space: Space) -> np.ndarray:
    """Positions whose suffix is smaller than the next one, but whose predecessor's is not."""
    n = len(smaller)
    found = [np.flatnonzero(smaller[a + 1 : b + 1] & ~smaller[a:b]) + a + 1 for a, b in chunks(n - 1)] if n <= CHUNK else None
    if found is not None:
        return space.keep(found[0])
    total = sum(int((smaller[a + 1 : b + 1] & ~smaller[a:b]).sum()) for a, b in chunks(n - 1))
    seeds, at = space.array(total, np.int64), 0
    for a, b in chunks(n - 1):
        got = np.flatnonzero(smaller[a + 1 : b + 1] & ~smaller[a:b]) + a + 1
        seeds[at : at + len(got)] = got
        at += len(got)
    return seeds


def _typed(text: np.ndarray, smaller: np.ndarray, space: Space) -> np.ndarray:
    """Symbols and types as one number from 1 on."""
    typed = space.array(len(text), np.int32)
    for a, b in chunks(len(text)):
        typed[a:b] = text[a:b]
        typed[a:b] = 2 * typed[a:b] + smaller[a:b] + 1
    return typed


def _names(typed: np.ndarray, starts: np.ndarray, size: np.ndarray, symbols: int, depth: int) -> np.ndarray:
    """Ranks (not dense) of the stretches of such sizes, by symbols and types."""
    bits = int(2 * symbols + 2).bit_length()
    each = max(1, 62 // bits)
    name, active = np.zeros(len(starts), np.int64), np.arange(len(starts))
    done, last = 0, len(typed) - 1
    while len(active) and done < depth + each:
        key, at, left = np.zeros(len(active), np.int64), starts[active], size[active]
        for k in range(done, done + each):
            key <<= bits
            key |= np.where(k < left, typed[np.minimum(at + k, last)], 0)
        order = np.lexsort((key, name[active])) if done else np.argsort(key, kind="stable")
        sorted_, n, k = active[order], name[active][order], key[order]
        group = np.r_[True, n[1:] != n[:-1]]
        new = group | np.r_[True, k[1:] != k[:-1]]
        place = np.arange(len(sorted_))
        group_at, new_at = np.maximum.accumulate(np.where(group, place, 0)), np.maximum.accumulate(np.where(new, place, 0))
        name[sorted_] = n + new_at - group_at
        done += each
        alone = new & np.r_[new[1:], True]
        active = sorted_[(size[sorted_] > done) & ~alone]
    return name


def _dense(name: np.ndarray) -> tuple[np.ndarray, int]:
    """(names numbered without gaps, how many); names are below their number."""
    used = np.zeros(len(name), np.int32)
    used[name] = 1
    number = np.cumsum(used, dtype=np.int32)
    return number[name] - np.int32(1), int(number[-1])


def _ranks(text: np.ndarray, typed: np.ndarray, seeds: np.ndarray, symbols: int, depth: int, space: Space) -> tuple[np.ndarray, int]:
    """(dense ranks of the stretches from each seed to the next, both included; number of different ones).

    Seeds are dealt by their first one or two symbols into blocks of about CHUNK, and named block by block.
    """
    m, two = len(seeds), symbols <= SYMBOLS
    size = lambda at: np.r_[seeds[1:], seeds[-1]][at] - seeds[at] + 1 if m <= CHUNK else np.asarray(seeds[np.minimum(at + 1, m - 1)]) - seeds[at] + 1
    if m <= CHUNK:
        rank, kinds = _dense(_names(typed, seeds, size(np.arange(m)), symbols, depth))
        return space.keep(rank), kinds
    lead = lambda p: text[p].astype(np.int64) * symbols + text[np.minimum(p + 1, len(text) - 1)] if two else np.asarray(text[p]).astype(np.int64)
    count = np.zeros(symbols * symbols if two else symbols, np.int64)
    for a, b in chunks(m):
        count += np.bincount(lead(seeds[a:b]), minlength=len(count))
    block = (np.cumsum(count) - count) // CHUNK
    rank, base = space.array(m, np.int32), 0
    for k in np.unique(block[count > 0]).tolist():
        at = np.concatenate([a + np.flatnonzero(block[lead(seeds[a:b])] == k) for a, b in chunks(m)])
        own, kinds = _dense(_names(typed, np.asarray(seeds[at]), size(at), symbols, depth))
        rank[at] = own + base
        base += kinds
    return rank, base


class _Prefixes:
    """Common prefixes of pairs of suffixes, up to depth. Texts that fit in a few chunks are looked at some symbols at once, as numbers; others one by one."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int, exact: bool):
        self.text, self.depth, self.exact, self.last = text, depth, exact, len(text) - 1
        self.bits = max(1, (symbols - 1).bit_length())
        self.each = max(1, 52 // self.bits)  # few enough for an exact double
        self.words = None
        if len(text) <= 4 * CHUNK:
            self.words = np.zeros(len(text), np.int64)
            for k in range(self.each):
                self.words <<= self.bits
                self.words[: max(0, len(text) - k)] |= text[k:]

    def of(self, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> np.ndarray:
        """For pairs of which so many symbols are known to agree. If that need not be exact, at least so many, and one look further."""
        depth, last = self.depth, self.last
        out, open_ = np.minimum(known, depth), np.flatnonzero(known < depth)
        while len(open_):
            d = out[open_]
            x, y = np.minimum(a[open_] + d, last), np.minimum(b[open_] + d, last)
            if self.words is None:
                some = self.text[x] != self.text[y]
                out[open_] += ~some
            else:
                apart = self.words[x] ^ self.words[y]
                some = apart != 0
                # the highest bit that differs tells the symbol; it is 0 bits where none does
                out[open_] += np.where(some, self.each - 1 - (np.frexp(apart.astype(np.float64))[1] - 1) // self.bits, self.each)
            open_ = open_[~some & (out[open_] < depth)] if self.exact else open_[:0]
        return np.minimum(out, depth).astype(np.uint16)


def _run(text: np.ndarray, position: int, depth: int) -> int:
    """How often the symbol at a position stands there in a row, up to depth."""
    x = np.asarray(text[position : position + depth])
    differ = np.flatnonzero(x != x[0])
    return int(differ[0]) if len(differ) else len(x)


def _turns(smaller: np.ndarray, a: int, b: int, carry: int) -> np.ndarray:
    """For each position from a to b - 1 the next one of the other type; carry is that of position b if it is of the type of b - 1, else b."""
    x = np.asarray(smaller[a:b])
    change = np.r_[x[:-1] != x[1:], True]
    place = np.where(change, np.arange(a + 1, b + 1), b)
    place[-1] = carry
    return np.minimum.accumulate(np.where(change, place, 1 << 62)[::-1])[::-1]


def _induced(text: np.ndarray, smaller: np.ndarray, typed: np.ndarray, sorted_seeds: np.ndarray, symbols: int, depth: int, space: Space, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """suffix_order() of a sequence with very many symbols, by the order of its seeds."""
    n, m = len(text), len(sorted_seeds)
    count = np.zeros(symbols, np.int64)
    for a, b in chunks(n):
        count += np.bincount(text[a:b], minlength=symbols)
    window_of = np.unique((np.cumsum(count) - count) // WINDOW, return_inverse=True)[1].astype(np.int32)
    windows = int(window_of[-1]) + 1
    larger, smalls, carry = space.queue(windows), space.queue(windows), n
    for a, b in reversed([*chunks(n - 1)]):
        turn = _turns(smaller, a, b, carry if b < n - 1 and smaller[b] == smaller[b - 1] else b)
        carry = int(turn[0])
        for queue, of in ((larger, ~smaller[a:b]), (smalls, smaller[a:b])):
            at = np.flatnonzero(of)
            window = window_of[text[a + at]]
            at = at[np.argsort(window, kind="stable")]
            window = window_of[text[a + at]]
            heads = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(at) else []
            for x, y in zip(heads, np.r_[heads[1:], len(at)] if len(at) else []):
                queue.push(int(window[x]), a + at[x:y], np.minimum(turn[at[x:y]] - a - at[x:y], depth).astype(np.uint16))
    place = space.array(n, np.int64)  # ranks of seeds, then of the suffixes that are larger than their followers
    for a, b in chunks(m):
        place[sorted_seeds[a:b]] = np.arange(a, b)
    none = np.zeros(0, np.int64)

    def in_order(got: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
        if got is None:
            return none
        position, size = got[0], got[1].astype(np.int64)
        name = _names(typed, position, size + 1, symbols, depth)
        return position[np.lexsort((place[np.minimum(position + size, n - 1)], name))]

    first, rank = space.queue(windows), 0
    for w in range(windows):
        position = in_order(larger.pop(w))
        first.push(w, position, np.zeros(0, np.uint16))
        place[position] = np.arange(rank, rank + len(position))
        rank += len(position)
    out, out_prefix, end = space.array(n, np.int64), space.array(n, np.uint16), 1
    out[0] = n - 1
    for w in range(windows):
        both = np.r_[first.pop(w)[0], in_order(smalls.pop(w))]
        both = both[np.argsort(typed[both], kind="stable")]
        out[end : end + len(both)] = both
        end += len(both)
    prefixes = _Prefixes(text, symbols, depth, exact)
    for a, b in chunks(n - 1):
        out_prefix[a + 1 : b + 1] = prefixes.of(out[a:b], out[a + 1 : b + 1], np.zeros(b - a, np.int64))
    space.free(place)
    return out, out_prefix


def suffix_order(text: np.ndarray, depth: int, space: Space | None = None, exact: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, common prefix of each with the one before). text: symbols from 1 on; its last symbol must be 0.

    The recursion asks for prefixes that need not be exact, as it only wants to know how much it need not compare again: no common prefix is shorter.
    """
    space, n = space or Space(), len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.uint16)
    symbols = 1 + max(int(np.max(text[a:b])) for a, b in chunks(n))
    smaller = _types(text, space)
    seeds = _seeds(smaller, space)  # the last position is one
    m = len(seeds)
    typed = _typed(text, smaller, space)
    rank, kinds = _ranks(text, typed, seeds, symbols, depth, space)
    if kinds == m:
        order, shared = space.array(m, np.int64), None
        for a, b in chunks(m):
            order[rank[a:b]] = np.arange(a, b)
    else:
        order, shared = suffix_order(rank, depth // 2 + 1, space, False)
    space.free(rank)
    prefixes = _Prefixes(text, symbols, depth, exact)
    sorted_seeds, seed_prefix = space.array(m, np.int64), space.array(m, np.uint16)
    for a, b in chunks(m):
        o = np.asarray(order[max(0, a - 1) : b])
        p = np.asarray(seeds[o])
        sorted_seeds[a:b] = p if not a else p[1:]
        same = np.zeros(len(o) - 1, np.int64) if shared is None else np.asarray(shared[max(1, a) : b]).astype(np.int64)
        known = seeds[np.minimum(o[1:] + same, m - 1)] - p[1:]
        seed_prefix[max(1, a) : b] = prefixes.of(p[:-1], p[1:], known)
    space.free(seeds, order, *([] if shared is None else [shared]))
    seeds = sorted_seeds

    if symbols > SYMBOLS:
        found = _induced(text, smaller, typed, seeds, symbols, depth, space, exact)
        space.free(smaller, typed, seeds, seed_prefix)
        return found
    space.free(typed)
    lots = np.zeros(symbols, np.int64)
    for a, b in chunks(m):
        lots += np.bincount(text[seeds[a:b]], minlength=symbols)
    cut = np.r_[0, np.cumsum(lots)]
    larger, up = space.queue(symbols), _Sweep(text, symbols, depth, space)
    for c in range(symbols):
        a, b, before = int(cut[c]), int(cut[c + 1]), None
        while (got := up.queue.pop(c, CHUNK)) is not None:
            position, prefix = got
            if before is None:
                prefix = prefix.copy()
                prefix[0] = 0
            larger.push(c, position, prefix)
            up.visit(position, prefix, (position > 0) & ~smaller[position - 1])
            before = int(position[-1])
        for x, y in chunks(b - a):
            position, prefix = np.asarray(seeds[a + x : a + y]), np.array(seed_prefix[a + x : a + y])
            if not x:
                prefix[0] = 0 if before is None else min(_run(text, before, depth), _run(text, int(position[0]), depth))
            up.visit(position, prefix, position > 0)
    space.free(seeds, seed_prefix)

    out, out_prefix, end = space.array(n, np.int64), space.array(n + 1, np.uint16), n
    down = _Sweep(text, symbols, depth, space)
    down.queue.push(0, np.array([n - 1]), np.zeros(1, np.uint16))

    def put(position: np.ndarray, prefix: np.ndarray) -> None:
        """Writes suffixes in falling order before those that are there; prefix: common with the one that was put before."""
        nonlocal end
        out[end - len(position) : end] = position[::-1]
        out_prefix[end - len(position) + 1 : end + 1] = prefix[::-1]
        end -= len(position)

    for c in range(symbols - 1, -1, -1):
        before, border = None, 0
        while (got := down.queue.pop(c, CHUNK)) is not None:
            position, prefix = got
            if before is None:
                prefix = prefix.copy()
                prefix[0] = 0
            down.visit(position, prefix, (position > 0) & smaller[position - 1])
            put(position, prefix)
            before = int(position[-1])
        while (got := larger.pop(c, CHUNK, last=True)) is not None:
            position, ahead = got[0][::-1], got[1]
            if before is not None:
                border = min(_run(text, before, depth), _run(text, int(position[0]), depth))
            # in falling order a suffix's prefix is the one that its follower had
            prefix = np.r_[np.uint16(border), ahead[:0:-1]].astype(np.uint16)
            border, before = int(ahead[0]), None
            down.visit(position, prefix, (position > 0) & smaller[position - 1])
            put(position, prefix)
    out_prefix[0] = 0
    space.free(smaller)
    return out, out_prefix[:n]
