"""Binary deltas: suffix sort, longest match, matcher, delta writer and delta reader, as kernels and columns."""

from __future__ import annotations

import bisect
import itertools
import struct
from collections.abc import Callable, Iterator

import numpy as np

from .kernels import kernel

#: Fixed values of the delta format and of the search.
MAGIC = b"ENDSLEY/BSDIFF43"
MIN_MATCH = 16
MATCH_BUDGET = 1 << 26
MAX_SIZE = (1 << 31) - 1

ENTRIES = "array<struct<diff:long,extra:long,seek:long>>"


class DeltaError(ValueError):
    """A delta that can't be applied."""


def pack_long(n: int) -> bytes:
    """Eight bytes, little end first, sign and magnitude."""
    return (abs(n) | (1 << 63 if n < 0 else 0)).to_bytes(8, "little")


def unpack_long(raw: bytes) -> int:
    if len(raw) < 8:
        raise DeltaError("a number is cut off")
    n = int.from_bytes(raw, "little")
    if n == 1 << 63:
        raise DeltaError("negative zero")
    return -(n & ~(1 << 63)) if n >> 63 else n


def suffix_array(data: bytes) -> np.ndarray:
    """Starts of all suffixes in order, the empty one first.

    Ranks of the first 2**k letters give those of the first 2**(k+1) by one sort
    of rank pairs; it ends when all ranks differ.
    """
    n = len(data)
    if n == 0:
        return np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8).astype(np.int64) + 1
    rank = np.zeros(n, np.int64)
    for shift in range(7):  # the first seven letters at once
        part = raw[shift:] if shift < n else raw[:0]
        rank[: len(part)] += part << (9 * (6 - shift))
    reach = 7
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        step = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])])
        dense = np.empty(n, np.int64)
        dense[order] = step + 1
        if step[-1] == n - 1:
            return np.concatenate([[n], order])
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - reach)] = dense[reach:]
        rank = dense * (n + 2) + behind
        order = np.argsort(rank, kind="stable")
        reach *= 2


def common_prefix(a: bytes, i: int, b: bytes, j: int) -> int:
    """Letters that a[i:] and b[j:] begin with alike."""
    most = min(len(a) - i, len(b) - j)
    done, size = 0, 32
    while done < most:
        size = min(size, most - done)
        if a[i + done : i + done + size] != b[j + done : j + done + size]:
            while size > 1:  # the first difference is within these
                half = size // 2
                if a[i + done : i + done + half] == b[j + done : j + done + half]:
                    done += half
                    size -= half
                else:
                    size = half
            return done
        done += size
        size *= 2
    return most


_LETTERS, _WIDE = 7, np.int64(9)


def _heads(data: bytes) -> np.ndarray:
    """For every start, the end included, the next seven letters as one number that sorts as they do; 0 stands for no letter."""
    raw = np.zeros(len(data) + _LETTERS + 1, np.int64)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    raw[: len(data)] += 1
    out = np.zeros(len(data) + 1, np.int64)
    for k in range(_LETTERS):
        out = out << _WIDE | raw[k : k + len(out)]
    return out


class Matcher:
    """Longest matches of many places of `new` in `old` at once.

    A place stands between two suffixes of old: the next one not below it and the one before that (at
    the ends of the order, the last two or the first two).  It matches the one that agrees longer, the upper one on ties.
    """

    DEPTHS = 5  # times seven letters that are compared for all places together; what agrees further is compared alone

    def __init__(self, old: bytes, new: bytes):
        self.old, self.new = old, new
        self.suffixes = suffix_array(old)
        self.of_old, self.of_new = _heads(old), _heads(new)
        self.sorted_heads = self.of_old[self.suffixes]

    def _head(self, heads: np.ndarray, at: np.ndarray) -> np.ndarray:
        return heads[np.minimum(at, len(heads) - 1)]

    def _narrowed(self, low: np.ndarray, high: np.ndarray, want: np.ndarray, depth: int, beyond: bool) -> np.ndarray:
        """First place in low..high whose letters at a depth are not below want (beyond: above it), for each."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            mid = (low + high) >> 1
            head = self._head(self.of_old, self.suffixes[np.minimum(mid, len(self.suffixes) - 1)] + depth)
            right = (head <= want if beyond else head < want) & (low < high)
            low = np.where(right, mid + 1, low)
            high = np.where(right | (low > high), high, np.minimum(mid, high))
        return low

    def _places(self, at: np.ndarray) -> np.ndarray:
        """How many suffixes of old are below new[at:], for each."""
        want = self.of_new[at]
        low, high = np.searchsorted(self.sorted_heads, want, "left"), np.searchsorted(self.sorted_heads, want, "right")
        for depth in range(_LETTERS, _LETTERS * self.DEPTHS, _LETTERS):
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            want = self._head(self.of_new, at[open_] + depth)
            first = self._narrowed(low[open_], high[open_], want, depth, False)
            high[open_] = self._narrowed(first, high[open_], want, depth, True)
            low[open_] = first
        for i in np.flatnonzero(low < high).tolist():
            low[i] = self._place_alone(int(at[i]), int(low[i]), int(high[i]))
        return low

    def _place_alone(self, at: int, low: int, high: int) -> int:
        while low < high:
            mid = (low + high) // 2
            s = int(self.suffixes[mid])
            n = common_prefix(self.old, s, self.new, at)
            if self.old[s + n : s + n + 1] < self.new[at + n : at + n + 1]:
                low = mid + 1
            else:
                high = mid
        return low

    def _agreeing(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Letters that old[s:] and new[at:] begin with alike."""
        n = np.zeros(len(s), np.int64)
        going = np.arange(len(s))
        for depth in range(0, _LETTERS * self.DEPTHS, _LETTERS):
            x = self._head(self.of_old, s[going] + depth) ^ self._head(self.of_new, at[going] + depth)
            n[going] += sum((x >> (_WIDE * k) == 0).astype(np.int64) for k in range(_LETTERS))
            going = going[x == 0]
            if not len(going):
                break
        room = np.minimum(len(self.old) - s, len(self.new) - at)
        for i in going[room[going] > n[going]].tolist():
            n[i] += common_prefix(self.old, int(s[i] + n[i]), self.new, int(at[i] + n[i]))
        return np.minimum(n, room)

    def longest(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(start in old, length) of the longest match at each of new's places begin..end-1."""
        at = np.arange(begin, end)
        upper = np.clip(self._places(at), min(1, len(self.old)), len(self.old))
        above, below = self.suffixes[upper], self.suffixes[np.maximum(upper - 1, 0)]
        n_above, n_below = self._agreeing(above, at), self._agreeing(below, at)
        return np.where(n_below > n_above, below, above), np.maximum(n_below, n_above)


def _dense_matches(old: bytes, new: bytes, min_match: int, budget: int, at: int = 0, diagonal: int = 0) -> Iterator[tuple[int, int]]:
    """matches() from a place behind the last match on, by the suffix array.

    Places are judged many at once: in a block, those worth it and those that lead
    further than one place are found for all of it, and the walk goes from one of these to the next.
    """
    find = Matcher(old, new)
    a, b = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    while at < len(new):
        hit, seen, size = None, 0, 16
        while hit is None and at < len(new):
            n = min(size, len(new) - at)
            start, length = find.longest(at, at + n)
            place = np.arange(n)
            reach = int((place + length).max())
            along = np.arange(at, at + reach) + diagonal
            inside = (along >= 0) & (along < len(old))
            same = np.zeros(reach + 1, np.int64)
            same[1:][inside] = a[along[inside]] == b[at : at + reach][inside]
            agreed = np.cumsum(same)
            agree = agreed[place + length] - agreed[place]
            worth, leads = np.flatnonzero(length > agree + min_match), np.flatnonzero((length == agree) & (length > 1))
            spent = np.concatenate([[0], np.cumsum(length)])
            k = 0
            while hit is None and k < n:
                w, j = np.searchsorted(worth, k), np.searchsorted(leads, k)
                last = int(leads[j]) if j < len(leads) else n - 1  # places k..last come in turn
                over = int(np.searchsorted(spent[1:], budget - seen + spent[k]))
                first = min(int(worth[w]) if w < len(worth) else n, max(over, k))
                if first <= last:
                    hit = first
                else:
                    seen += int(spent[last + 1] - spent[k])
                    k = last + (int(length[last]) if j < len(leads) else 1)
            if hit is None:
                at, size = at + k, min(2 * size, 1 << 16)
        if hit is not None:
            old_at, at, n = int(start[hit]), at + hit, int(length[hit])
            yield old_at, at
            diagonal, at = old_at - at, at + n


class _Costly(Exception):
    """Searching letter by letter has cost more than a suffix array would."""


class _Finder:
    """Longest matches of single places of `new` in `old` by searching; gives up where many have to be searched.

    Only a match of at least `least` letters is looked for.  Where some place's first `least` letters stand in old is searched for a few
    places; then all of old's are sorted by hash, and new's are looked up a block of places at a time.
    """

    WORTH = 1024  # letters searched for each letter of either side; a suffix array costs about as much
    SPARSE = 4  # table places for each hash of old, as a power of two
    FEW, MANY = 16, 1024  # places of a beginning that are compared one by one, places of a longest match that are put in order
    BLOCK = 256

    def __init__(self, old: bytes, new: bytes, least: int):
        self.old, self.new, self.least = old, new, least
        self.left = self.WORTH * (len(old) + len(new) + 256)
        self.lazy = 24 * (len(old) + 256)
        self.order = self.sorted = None
        self.blocks: dict[int, tuple[np.ndarray, list[int]]] = {}

    def find(self, what: bytes, begin: int = 0) -> int:
        at = self.old.find(what, begin)
        self.left -= 64 + (at if at >= 0 else len(self.old)) - begin
        if self.left < 0:
            raise _Costly
        return at

    def follow(self, at: int, diagonal: int) -> None:
        """Begins to list where new differs from old on a diagonal; beyond old's ends all does."""
        self.diagonal, self.listed, self.size, self.differing, self.first = diagonal, at, 64, [], 0

    def difference(self, at: int, k: int = 0) -> int | None:
        """The place of the first difference not before `at`, which doesn't fall, or of the k-th behind that; None if there is none."""
        self.first = bisect.bisect_left(self.differing, at, self.first)
        while self.first + k >= len(self.differing) and self.listed < len(self.new):
            n = min(self.size, len(self.new) - self.listed)
            i = self.listed + self.diagonal
            before, differs = max(0, -i), np.ones(n, bool)
            if before < n and i < len(self.old):
                a = np.frombuffer(self.old, np.uint8)[i + before : i + n]
                differs[before : before + len(a)] = a != np.frombuffer(self.new, np.uint8)[self.listed + before :][: len(a)]
            self.differing += (np.flatnonzero(differs) + self.listed).tolist()
            self.listed, self.size = self.listed + n, min(2 * self.size, 1 << 16)
            self.first = bisect.bisect_left(self.differing, at, self.first)
        return self.differing[self.first + k] if self.first + k < len(self.differing) else None

    def holds(self, begin: int, end: int) -> bool:
        """Whether old has new[begin:end] anywhere."""
        what = self.new[begin:end]
        if len(what) >= self.least:
            if self.order is not None:
                places = self.begins(begin)
                if places is not None:
                    self.left -= 64
                    return any(self.old.startswith(what, i) for i in places)
            else:
                before = self.left
                found = self.find(what) >= 0
                self.lazy -= before - self.left
                if self.lazy < 0:
                    self._sort()
                return found
        return self.find(what) >= 0

    def _sort(self) -> None:
        h = self._hashes(self.old)
        self.order = h.argsort()
        self.sorted = h[self.order]
        bits = max(10, len(h).bit_length() + self.SPARSE)
        self.shift = np.uint64(64 - bits)
        self.known = np.zeros(1 << bits, bool)
        self.known[self._slots(h)] = True

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """Where a table of flags tells whether old may have a hash; most that it has not are told at once."""
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def begins(self, at: int) -> list[int] | None:
        """Where the first `least` letters at a place of new, or all there are, stand in old; None for more than a few places."""
        if self.order is None or at + self.least > len(self.new):
            return self._all(self.new[at : at + self.least], self.FEW)
        number, k = divmod(at, self.BLOCK)
        if number not in self.blocks:
            self._look_up(number)
        h = self.blocks[number][0][k]
        low = int(self.sorted.searchsorted(h))
        high, most = low, min(low + self.FEW + 1, len(self.sorted))
        while high < most and self.sorted[high] == h:
            high += 1
        if high - low > self.FEW:
            return None
        what = self.new[at : at + self.least] if low < high else b""
        return [i for i in self.order[low:high].tolist() if self.old.startswith(what, i)]

    def _look_up(self, number: int) -> None:
        """Keeps the hashes of a block of new, and at which of its places old may have the same."""
        begin = number * self.BLOCK
        h = self._hashes(self.new[begin : begin + self.BLOCK + self.least - 1])
        some = np.flatnonzero(self.known[self._slots(h)])
        if len(some) < self.BLOCK // 4:  # else new has a match here, and most will not be asked for
            low = np.minimum(self.sorted.searchsorted(h[some]), len(self.sorted) - 1)
            some = some[self.sorted[low] == h[some]] if len(self.sorted) else some[:0]
        self.blocks[number] = h, np.append(some, len(h)).tolist()

    def quiet(self, at: int) -> int:
        """How many places from `at` on, in its block, the walk passes without a match of `least` letters.

        At such a place the longest match isn't worth it and leads at most to the end of the run, so that the walk
        comes by every letter that differs on the diagonal, and by the place behind the last of them before the first place that may have such a match.
        """
        if self.order is None:
            return 0
        number, k = divmod(at, self.BLOCK)
        if number not in self.blocks:
            self._look_up(number)
        loud = self.blocks[number][1]
        end = number * self.BLOCK + loud[bisect.bisect_left(loud, min(k, loud[-1]))]
        if end <= at:
            return 0
        self.difference(end)
        return max(0, self.differing[self.first - 1] + 1 - at) if self.first else 0

    def _hashes(self, data: bytes) -> np.ndarray:
        """A number of the `least` letters from each place that has as many; shifts double what is covered."""
        n = len(data) - self.least + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h, covered = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), 1
        while covered < self.least:
            step = min(covered, self.least - covered)
            m = h * np.uint64(0x9E3779B97F4A7C15)
            m ^= m >> np.uint64(29)
            h = m[: len(m) - step] * np.uint64(0xBF58476D1CE4E5B9) + h[step:]
            covered += step
        return h

    def longest(self, at: int) -> tuple[int, int]:
        """(start, length) as Matcher.longest() has them; (0, 0) if the match has fewer than `least` letters and new goes on."""
        old, new = self.old, self.new
        places = self.begins(at)
        if places is None:  # as long as it is found; steps double, then halve
            n, step, grows = self.least, 32, True
            while step:
                longer = at + n + step <= len(new) and self.find(new[at : at + n + step]) >= 0
                n, grows = n + step * longer, grows and longer
                step = 2 * step if grows else step // 2
            places = self._all(new[at : at + n], self.MANY)
            if places is None:
                raise _Costly
        else:
            agreeing = [common_prefix(old, i, new, at) for i in places]
            n = max(agreeing, default=0)
            self.left -= sum(agreeing)
            places = [i for i, k in zip(places, agreeing) if k == n]
        if not places:
            return 0, 0
        if len(places) > 1:
            behind = new[at + n : at + n + 1]
            above = [i for i in places if old[i + n : i + n + 1] >= behind]
            places = [self._extreme(above or places, n, min if above else max)]
        return places[0], n

    def _all(self, what: bytes, most: int) -> list[int] | None:
        """Where it stands in old; None for more than `most` places."""
        places, at = [], self.find(what)
        while at >= 0:
            if len(places) == most:
                return None
            places.append(at)
            at = self.find(what, at + 1)
        return places

    def _extreme(self, places: list[int], n: int, pick: Callable) -> int:
        """The place whose suffix of old is the first (min) or last (max) in order; all have the same n letters ahead."""
        size = 16
        while len(places) > 1:
            parts = [self.old[i + n : i + n + size] for i in places]
            best = pick(parts)
            places = [i for i, part in zip(places, parts) if part == best]
            self.left -= size * len(parts)
            n, size = n + size, 2 * size
        return places[0]


def matches(old: bytes, new: bytes, min_match: int = MIN_MATCH, budget: int = MATCH_BUDGET) -> Iterator[tuple[int, int]]:
    """(old, new) positions of matches worth a new entry.

    The rule: after a match, places behind it are looked at in turn.  The longest match at a place is
    worth it if it has over min_match letters more than agree, within its length, where the last
    match's diagonal goes on; or if the matches looked at since the last one have `budget` letters in sum.  If all of its letters
    agree on the diagonal, the next place is behind it, else it is the one after.

    On the diagonal letters agree in runs between those that differ.  Two things follow.  A place's longest match agrees wholly
    if old doesn't have new's letters from there to the first that differs, that one included.  It has over min_match
    letters more than agree if old has new's letters from there to the (min_match + 1)-th that differs; within a run this end is the same, so
    that if it holds for a place, it holds for those behind.  So a few searches judge a run.

    Where this costs more than a suffix array, or the budget may be spent by matches whose lengths
    aren't known, the walk goes on with _dense_matches().
    """
    at = diagonal = 0
    find = _Finder(old, new, min_match + 1)
    end = len(new)
    while at < end:
        behind, seen, exact, hit = at, 0, True, None
        find.follow(at, diagonal)
        try:
            while hit is None and at < end:
                if n := find.quiet(at):
                    at, seen, exact = at + n, seen + n * min_match, False
                    if seen >= budget:
                        raise _Costly
                    continue
                run = find.difference(at)  # the run at..run-1 agrees; none is left at a letter that differs
                run = end if run is None else run
                if run > at and (run == end or not find.holds(at, run + 1)):
                    seen += run - at
                    if seen < budget:
                        at = run
                        continue
                    hit = at
                    break
                last = max(run - 1, at)
                far = find.difference(at, min_match)
                stop = last + 1
                if far is not None and find.holds(last, far + 1):
                    low, stop = at, last
                    while low < stop:
                        mid = (low + stop) // 2
                        low, stop = (low, mid) if find.holds(mid, far + 1) else (mid + 1, stop)
                    hit = stop
                longest = (end if far is None else far) - at
                seen += (stop - at) * longest - (stop - at) * (stop - at - 1) // 2
                exact &= stop == at
                if seen >= budget and stop > at:
                    raise _Costly
                at = stop
            if hit is not None:
                if not exact and seen >= budget:
                    raise _Costly
                start, n = find.longest(hit)
                if not n:
                    raise _Costly
        except _Costly:
            yield from _dense_matches(old, new, min_match, budget, behind, diagonal)
            return
        if hit is not None:
            yield start, at
            diagonal, at = start - at, at + n


def naive_matches(old: bytes, new: bytes, least: int = 3) -> Iterator[tuple[int, int]]:
    """Longest match at every position, the first in old on ties, if it has at least `least` letters."""
    at = 0
    while at < len(new):
        size = next((k for k in range(len(new) - at, least - 1, -1) if new[at : at + k] in old), 0)
        if size:
            yield old.index(new[at : at + size]), at
            at += size
        else:
            at += 1


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(len(a), len(b))
    return a[:n] == b[:n]


def _most(score: np.ndarray) -> int:
    """How many steps, none included, lead to the largest sum; the fewest of them."""
    return int(np.concatenate([[0], np.cumsum(score)]).argmax())


def delta_entries(old: bytes, new: bytes, found: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(diff, extra, seek, start in old, start in new) of each entry of a delta.

    An entry goes from one match to the next.  The match is carried on ahead, and the next one back towards
    it, as far as letters that agree outnumber those that don't by the most; where both claim the same letters, they part
    so that most agree.  What neither claims is extra.
    """
    a, b = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    i = j = 0
    for hit in itertools.chain(found, [None] if new else []):
        s, t = hit or (len(old), len(new))
        gap = t - j
        ahead = _most(2 * _alike(a[i : i + gap], b[j:t]).astype(np.int64) - 1)
        room = min(gap, s) if hit else 0
        back = _most(2 * _alike(a[s - room : s][::-1], b[t - room : t][::-1]).astype(np.int64) - 1)
        both = ahead + back - gap
        if both > 0:
            begin = t - back
            claimed = b[begin : begin + both]
            first, second = a[i + begin - j :][:both] == claimed, a[s - back :][:both] == claimed
            k = _most(first.astype(np.int64) - second)
            ahead, back = begin - j + k, back - k
        yield ahead, gap - ahead - back, s - back - (i + ahead) if hit else 0, i, j
        i, j = s - back, t - back


def write_delta(old: bytes, new: bytes, min_match: int = MIN_MATCH, matcher: Callable | None = None) -> bytes:
    if len(old) > MAX_SIZE or len(new) > MAX_SIZE:
        raise ValueError("over 2 GiB")
    found = matcher(old, new) if matcher else matches(old, new, min_match)
    a, b = np.frombuffer(old, np.uint8), np.frombuffer(new, np.uint8)
    out = [MAGIC, pack_long(len(new))]
    for diff, extra, seek, i, j in delta_entries(old, new, found):
        out += [pack_long(diff), pack_long(extra), pack_long(seek), (b[j : j + diff] - a[i : i + diff]).tobytes(), new[j + diff : j + diff + extra]]
    return b"".join(out)


def read_delta(delta: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(diff, extra, seek, place of the bytes) of each entry."""
    if delta[:16] != MAGIC:
        raise DeltaError("not a delta of this format")
    size = unpack_long(delta[16:24])
    if not 0 <= size <= MAX_SIZE:
        raise DeltaError(f"bad size {size}")
    at, made = 24, 0
    while made < size:
        diff, extra, seek = (unpack_long(delta[at + k : at + k + 8]) for k in (0, 8, 16))
        at += 24
        if not (0 <= diff <= MAX_SIZE and 0 <= extra <= MAX_SIZE and -MAX_SIZE <= seek <= MAX_SIZE) or made + diff + extra > size:
            raise DeltaError("an entry's lengths don't fit")
        if at + diff + extra > len(delta):
            raise DeltaError("the delta is cut off")
        yield diff, extra, seek, at
        at += diff + extra
        made += diff + extra


def apply_delta(old: bytes, delta: bytes, expected: int | None = None) -> bytes:
    if expected is not None and unpack_long(delta[16:24]) != expected:
        raise DeltaError("the new size isn't the expected one")
    a, d = np.frombuffer(old, np.uint8), np.frombuffer(delta, np.uint8)
    out, at = [], 0
    for diff, extra, seek, place in read_delta(delta):
        if at + diff > len(old):
            raise DeltaError("an entry reads beyond the old bytes")
        out += [(a[at : at + diff] + d[place : place + diff]).tobytes(), delta[place + diff : place + diff + extra]]
        at += diff + seek
        if not 0 <= at <= len(old):
            raise DeltaError("an entry leaves the old bytes")
    return b"".join(out)


# GDIFF.  Fixed values: magic and version, and of each copying opcode the forms of offset and length.
GDIFF_MAGIC = b"\xd1\xff\xd1\xff\x04"
GDIFF_COPIES = {249: "HB", 250: "HH", 251: "Hi", 252: "iB", 253: "iH", 254: "ii", 255: "qi"}


def gdiff_commands(patch: bytes) -> Iterator[tuple[str, int, int]]:
    """("data", place in the patch, length) or ("copy", offset, length) in order."""
    if patch[:5] != GDIFF_MAGIC:
        raise DeltaError("not a GDIFF patch of version 4")

    def read(form: str, at: int) -> tuple[int, int]:
        try:
            return struct.unpack_from(f">{form}", patch, at)[0], at + struct.calcsize(f">{form}")
        except struct.error:
            raise DeltaError("the patch is cut off") from None

    at = 5
    while True:
        op, at = read("B", at)
        if op == 0:
            return
        if op <= 248:
            n, at = (op, at) if op <= 246 else read("H" if op == 247 else "i", at)
            if n < 0 or at + n > len(patch):
                raise DeltaError("data of a negative length or cut off")
            yield "data", at, n
            at += n
        else:
            offset, at = read(GDIFF_COPIES[op][0], at)
            n, at = read(GDIFF_COPIES[op][1], at)
            if offset < 0 or n < 0:
                raise DeltaError("a copy with a negative offset or length")
            yield "copy", offset, n


def apply_gdiff(base: bytes, patch: bytes, most: int | None = None) -> bytes:
    """Patched bytes; over `most` is an error, fewer is not."""
    out, size = [], 0
    for kind, at, n in gdiff_commands(patch):
        size += n
        if most is not None and size > most:
            raise DeltaError("more bytes than expected")
        if kind == "copy" and at + n > len(base):
            raise DeltaError("a copy reads beyond the base")
        out.append((base if kind == "copy" else patch)[at : at + n])
    return b"".join(out)


def write_delta_column(old, new, min_match: int = MIN_MATCH):
    return kernel(lambda a, b: None if a is None or b is None else write_delta(bytes(a), bytes(b), min_match), "binary")(old, new)


def apply_delta_column(old, delta):
    return kernel(lambda a, d: None if a is None or d is None else apply_delta(bytes(a), bytes(d)), "binary")(old, delta)


def delta_entries_column(delta):
    """Entries of a delta as array<struct<diff,extra,seek>>."""
    return kernel(lambda d: None if d is None else [e[:3] for e in read_delta(bytes(d))], ENTRIES)(delta)


def apply_gdiff_column(base, patch):
    return kernel(lambda b, p: None if b is None or p is None else apply_gdiff(bytes(b), bytes(p)), "binary")(base, patch)
