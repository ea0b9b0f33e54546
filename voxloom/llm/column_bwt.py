"""Column-wise construction of the Burrows-Wheeler transform of many strings, with common prefixes.

Round ``j`` inserts the suffix of ``j`` symbols of every string that is as long. The collection so far is one
file of entries (symbol before the suffix, common prefix with the entry before, owner, size) in suffix order. A
round reads it twice from front to back, ``block`` entries at a time: first it counts the symbols that the last
round's entries extend with, which gives each new suffix its place, and carries for each of these symbols the
least common prefix since it was last met, which gives the common prefix of the two extensions; then it copies
the entries to a second file with the new ones put in. The two files change places; none is renamed or grown
anew, so the operating system has nothing to flush. Memory is a block and some numbers for each string and symbol.
"""

from __future__ import annotations

import contextlib
import io
import os
import uuid

BLOCK = 1 << 16
NONE = 2**16 - 1


class _Entries:
    """Entries in a file that is read and written in order; a buffer of the same form without a folder."""

    def __init__(self, file, dtype, block: int):
        self.file, self.dtype, self.block, self.count = file, dtype, block, 0

    def start(self) -> None:
        self.file.seek(0)
        self.count = 0

    def put(self, rows) -> None:
        self.file.write(memoryview(rows).cast("B"))
        self.count += len(rows)

    def blocks(self):
        import numpy as np

        self.file.seek(0)
        for at in range(0, self.count, self.block):
            rows = np.empty(min(self.block, self.count - at), self.dtype)
            view, got = memoryview(rows).cast("B"), 0
            while got < len(view):
                got += self.file.readinto(view[got:]) or _broken()
            yield at, rows


def _broken():
    raise OSError("a file of entries is shorter than what was written to it")


@contextlib.contextmanager
def _files(folder: str | None):
    """Two files in ``folder`` (two buffers without one), gone afterwards."""
    if folder is None:
        yield io.BytesIO(), io.BytesIO()
        return
    os.makedirs(folder, exist_ok=True)
    name = os.path.join(folder, uuid.uuid4().hex)
    try:
        with open(f"{name}.0", "w+b", buffering=0) as a, open(f"{name}.1", "w+b", buffering=0) as b:
            yield a, b
    finally:
        for k in (0, 1):
            with contextlib.suppress(FileNotFoundError):
                os.remove(f"{name}.{k}")


def _range_minima(values, first, last):
    """Minima of ``values[first:last + 1]``."""
    import numpy as np

    level = np.frexp(last - first + 1)[1] - 1
    out, now = np.empty(len(first), values.dtype), values
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(now[first[at]], now[last[at] - (1 << k) + 1])
        now = np.minimum(now[: -(1 << k)], now[1 << k :])
    return out


class _Round:
    """The first reading of a round: ranks of the extensions, and their common prefixes where they are new.

    ``start[s]``: rank of the first extension by symbol ``s``; ``places``, ascending: entries whose extension is new.
    """

    def __init__(self, start, places, symbols):
        import numpy as np

        self.start, self.places = start, places
        self.wanted = np.zeros(len(start), bool)
        self.wanted[symbols] = True
        self.met = np.zeros(len(start), np.int64)
        self.since = np.full(len(start), NONE, np.uint16)
        self.last_is_new = np.zeros(len(start), bool)
        self.ranks, self.at, self.common = [], [], []

    def read(self, at: int, rows) -> None:
        import numpy as np

        bwt, lcp = np.ascontiguousarray(rows["bwt"]), np.ascontiguousarray(rows["lcp"])
        lo, hi = np.searchsorted(self.places, (at, at + len(rows)))
        is_new = np.zeros(len(rows), bool)
        is_new[self.places[lo:hi] - at] = True
        p = np.flatnonzero(self.wanted[bwt])
        p = p[np.argsort(bwt[p], kind="stable")]
        s = bwt[p]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
        count = np.diff(np.r_[first, len(s)])
        rank = self.start[s] + self.met[s] + np.arange(len(s)) - np.repeat(first, count)
        fresh = is_new[p]
        by_place = np.full(len(rows), -1)
        by_place[p] = rank
        self.ranks.append(by_place[self.places[lo:hi] - at])
        # neighbours with the same symbol in this block
        b = np.flatnonzero(np.r_[False, (s[1:] == s[:-1]) & (fresh[1:] | fresh[:-1])][: len(s)])
        self.at.append(rank[b])
        self.common.append(1 + _range_minima(lcp, p[b - 1] + 1, p[b]))
        # the first one of a symbol and the last one in the blocks before
        f, own = p[first], s[first]
        ask = (self.met[own] > 0) & (fresh[first] | self.last_is_new[own])
        self.at.append(rank[first[ask]])
        self.common.append(1 + np.minimum(self.since[own[ask]], np.minimum.accumulate(lcp)[f[ask]]))
        self.since = np.minimum(self.since, lcp.min())
        end = first + count - 1
        left = np.r_[np.minimum.accumulate(lcp[::-1])[::-1], np.uint16(NONE)].astype(np.uint16)
        self.since[own], self.last_is_new[own] = left[p[end] + 1], fresh[end]
        self.met[own] += count


def column_bwt(symbols, lengths, folder: str | None = None, block: int = BLOCK):
    """``owner, size, lcp, bwt`` of all suffixes in order, the empty ones first.

    ``symbols``: the strings one after the other, each symbol 1 or more; ``lengths``: how long each is, under
    65,535. ``size`` is a suffix's number of symbols, ``lcp`` the common prefix with the suffix before, ``bwt`` the
    symbol that stands before the suffix (0: none).
    """
    import numpy as np

    n, longest = len(lengths), int(lengths.max()) if len(lengths) else 0
    ends = np.cumsum(lengths)
    most = int(symbols.max()) if len(symbols) else 0
    kind = np.uint16 if most < 1 << 16 else np.uint32
    entry = np.dtype([("bwt", kind), ("lcp", np.uint16), ("owner", np.int32), ("size", np.uint16)])
    symbols = symbols.astype(kind)

    def entries(own, size: int):
        """The strings' suffixes of that size."""
        out = np.zeros(len(own), entry)
        some = lengths[own] > size
        out["bwt"][some] = symbols[ends[own[some]] - size - 1]
        out["owner"], out["size"] = own, size
        return out

    with _files(folder) as (a, b):
        now, then = _Entries(a, entry, block), _Entries(b, entry, block)
        live = place = np.arange(n)
        new = entries(live, 0)
        now.put(new)
        total = np.bincount(new["bwt"], minlength=most + 1)
        for j in range(1, longest + 1):
            stay = new["bwt"] > 0
            live, place, extend = live[stay], place[stay], new["bwt"][stay]
            order = np.argsort(place)
            live, place, extend = live[order], place[order], extend[order]
            # extensions stand by symbol, then as the entries they extend; the empty suffixes come before them
            scan = _Round(n + np.r_[0, total[1:].cumsum()] - np.r_[0, total[1:]], place, extend)
            for at, rows in now.blocks():
                scan.read(at, rows)
            place, at_new, common = (np.concatenate(x) for x in (scan.ranks, scan.at, scan.common))
            order = np.argsort(place)
            live, place = live[order], place[order]
            new = entries(live, j)
            by_rank = np.argsort(at_new)
            at_new, common = at_new[by_rank], common[by_rank]
            before, done = place - np.arange(len(place)), 0  # how many old entries come first
            then.start()
            for at, rows in now.blocks():
                last = len(place) if at + len(rows) == now.count else int(np.searchsorted(before, at + len(rows)))
                out = np.empty(len(rows) + last - done, entry)
                is_old = np.ones(len(out), bool)
                is_old[place[done:last] - then.count] = False
                out[is_old], out[~is_old] = rows, new[done:last]
                lo, hi = np.searchsorted(at_new, (then.count, then.count + len(out)))
                out["lcp"][at_new[lo:hi] - then.count] = common[lo:hi]
                then.put(out)
                done = last
            total += np.bincount(new["bwt"], minlength=most + 1)
            now, then = then, now
        found = [rows for _, rows in now.blocks()]
        found = np.concatenate(found) if found else np.zeros(0, entry)
        return found["owner"].copy(), found["size"].astype(np.int64), found["lcp"].copy(), found["bwt"].copy()
