"""The suffix order of many strings, built column by column through sequential files.

Round j inserts the suffix of length j of every string that is long enough. The order is held as a file, in suffix
order: for each suffix its symbol of the Burrows-Wheeler transform (the symbol before it; 0 before a whole string) and
the common prefix with the suffix before. A round reads the file once, block by block, and writes it anew with the new
suffixes inserted; each new block is looked through on the way for where the suffixes of the next round go and what
prefixes they share. What goes from block to block is, for each symbol, its count, the least common prefix since it was
last seen, and the string that waits for its next one. Beside that a few numbers for each string stay in memory, and
after the last round the place that each suffix's extension has, which leads from a string's end through its suffixes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import compute, fs

#: Entries of a file that are worked on at once.
BLOCK = 1 << 18
#: Bytes that a file may have before it goes to the folder.
HELD = 8 << 20


class Files:
    """Sequential files in a folder of one task's own below a shared folder, each in memory as long as it has at most HELD
    bytes; all in memory where no folder is given or pyarrow doesn't know its kind. They are gone after the with statement."""

    def __init__(self, folder: str | None):
        self.store, self.path, self.held, self.made = None, "", {}, False
        if folder:
            kind = urlparse(folder)
            try:
                local = kind.scheme in ("", "file")
                self.store, base = (fs.LocalFileSystem(), kind.path) if local else fs.FileSystem.from_uri(folder)
            except (pa.ArrowInvalid, NotImplementedError, ImportError):
                return
            self.path = f"{base}/{uuid.uuid4().hex}"

    def __enter__(self) -> Files:
        return self

    def __exit__(self, *_) -> None:
        if self.made:
            self.store.delete_dir(self.path)
        self.held.clear()

    def write(self, name: str) -> Writer:
        return Writer(self, name)

    def read(self, name: str):
        if name in self.held:
            return pa.BufferReader(self.held[name])
        return self.store.open_input_stream(f"{self.path}/{name}")


class Writer:
    """Writes a file of Files anew."""

    def __init__(self, files: Files, name: str):
        self.files, self.name, self.size = files, name, 0
        self.out = pa.BufferOutputStream()
        files.held.pop(name, None)
        self.inside = True

    def __enter__(self) -> Writer:
        return self

    def write(self, data: np.ndarray) -> None:
        self.size += data.nbytes
        if self.inside and self.files.store and self.size > HELD:
            if not self.files.made:
                self.files.store.create_dir(self.files.path, recursive=True)
                self.files.made = True
            self.inside, so_far = False, self.out.getvalue()
            self.out = self.files.store.open_output_stream(f"{self.files.path}/{self.name}")
            self.out.write(so_far)
        self.out.write(data)

    def __exit__(self, *_) -> None:
        if self.inside:
            self.files.held[self.name] = self.out.getvalue()
        else:
            self.out.close()


class RangeLeast:
    """The least of values[a:b] for non-empty ranges, by tables over powers of two."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.uint8)
        span = (np.frexp(b - a)[1] - 1).astype(np.uint8)  # floor of log2
        order = np.argsort(span, kind="stable")
        end = np.cumsum(np.bincount(span, minlength=1)).tolist()
        for k, z in enumerate(end):
            if k == len(self.tables):
                half = 1 << (k - 1)
                self.tables.append(np.minimum(self.tables[-1][:-half], self.tables[-1][half:]))
            own = order[end[k - 1] if k else 0 : z]
            out[own] = np.minimum(self.tables[k][a[own]], self.tables[k][b[own] - (1 << k)])
        return out


class Runs:
    """The runs of equal symbols of a block: start and end of each, its symbol, by (the runs symbol by symbol, rising), the place
    of each in by, how many equal symbols are before it, and first, last and own: for each symbol its runs in by and its count."""

    def __init__(self, bwt: np.ndarray):
        self.start = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
        self.end = np.append(self.start[1:], len(bwt))
        self.symbol = bwt[self.start]
        self.by = compute.array_sort_indices(pa.array(self.symbol)).to_numpy().view(np.int64)  # a stable counting sort
        self.place = np.empty(len(self.by), np.int64)
        self.place[self.by] = np.arange(len(self.by))
        self.last = np.cumsum(np.bincount(self.symbol, minlength=256))
        self.first = np.append(0, self.last[:-1])
        before = np.append(0, np.cumsum((self.end - self.start)[self.by]))
        self.own = before[self.last] - before[self.first]
        self.before = before[self.place] - before[self.first][self.symbol]


class Scan:
    """One pass over the order, block by block. For the symbols at the places (rising): where their suffixes go, and the
    common prefixes with those of the same symbols before and after them."""

    def __init__(self, ends: int, place: np.ndarray):
        self.ends, self.place, self.at = ends, place, 0
        self.symbol, self.rank = np.zeros(len(place), np.uint8), np.zeros(len(place), np.int64)
        self.up, self.down = np.zeros(len(place), np.uint8), np.zeros(len(place), np.uint8)
        self.count, self.since, self.waiting = np.zeros(256, np.int64), np.full(256, 255, np.int64), np.full(256, -1, np.int64)

    def block(self, entries: np.ndarray) -> None:
        bwt, lcp, n = (entries >> 8).astype(np.uint8), entries.astype(np.uint8), len(entries)
        count, since, waiting, up, down = self.count, self.since, self.waiting, self.up, self.down
        low, high = np.searchsorted(self.place, (self.at, self.at + n))
        q = self.place[low:high] - self.at
        runs, least = Runs(bwt), RangeLeast(lcp)
        k = np.searchsorted(runs.start, q, "right") - 1
        s, at, r, end = bwt[q], q - runs.start[k], runs.place[k], runs.end[k]
        self.symbol[low:high], self.rank[low:high] = s, count[s] + runs.before[k] + at
        # in a run the symbol before is the next entry, else it is the end of the run before of that symbol, else in a block before
        i = np.flatnonzero(at > 0)
        up[low + i] = 1 + lcp[q[i]]
        i = np.flatnonzero((at == 0) & (r > runs.first[s]))
        up[low + i] = 1 + least(runs.end[runs.by[r[i] - 1]], q[i] + 1)
        i = np.flatnonzero((at == 0) & (r == runs.first[s]) & (count[s] > 0))
        up[low + i] = 1 + np.minimum(since[s[i]], least(np.zeros(len(i), np.int64), q[i] + 1))
        i = np.flatnonzero(q + 1 < end)
        down[low + i] = 1 + lcp[q[i] + 1]
        i = np.flatnonzero((q + 1 == end) & (r + 1 < runs.last[s]))
        down[low + i] = 1 + least(q[i] + 1, runs.start[runs.by[r[i] + 1]] + 1)
        seen = np.flatnonzero(runs.own)
        met = seen[waiting[seen] >= 0]
        down[waiting[met]] = 1 + np.minimum(since[met], least(np.zeros(len(met), np.int64), runs.start[runs.by[runs.first[met]]] + 1))
        after = runs.end[runs.by[runs.last[seen] - 1]]
        self.since = since = np.minimum(since, int(lcp.min()))
        since[seen] = 255
        inner = np.flatnonzero(after < n)
        since[seen[inner]] = least(after[inner], np.full(len(inner), n))
        i = np.searchsorted(q, after - 1)
        hit = np.append(q, -1)[i] == after - 1
        waiting[seen] = np.where(hit, low + i, -1)
        count += runs.own
        self.at += n

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.count[0] = 0  # string starts have no suffix before them
        return self.ends + (np.cumsum(self.count) - self.count)[self.symbol] + self.rank, self.up, self.down


class Columns:
    """flat: the bytes of all strings end to end (below 255, as UTF-8 has them), size: the bytes of each, one at least."""

    def __init__(self, flat: np.ndarray, size: np.ndarray, length: int, files: Files):
        self.m, self.size, self.length, self.files = len(size), size.astype(np.int64), length, files
        self.rounds = int(self.size.max())
        self.total = np.append(0, np.bincount(flat, minlength=255))  # of each symbol
        ends = np.cumsum(self.size)
        back = np.repeat(ends, self.size) - 1 - np.arange(len(flat))
        column = np.zeros((self.rounds + 1, self.m), np.uint8)  # row j: each string's symbol j from its end
        column[back, np.repeat(np.arange(self.m), self.size)] = flat + np.uint8(1)
        with files.write("symbols") as out:
            out.write(column)
        with files.write("order0") as out:
            out.write(column[0].astype(np.uint16) << 8)

    def blocks(self, turn: int) -> Iterator[np.ndarray]:
        """The entries of a turn's file: the symbol, times 256, and the common prefix."""
        stream = self.files.read(f"order{turn}")
        while len(data := stream.read(2 * BLOCK)):
            yield np.frombuffer(data, np.uint16)
        stream.close()

    def insert(self, turn: int, n: int, target: np.ndarray, new: np.ndarray, down: np.ndarray, scan: Scan) -> None:
        """Writes the file of the next turn: that of this one with new entries at the places of target (rising). scan goes over it."""
        before = target - np.arange(len(target))  # old entries before each
        at = 0
        with self.files.write(f"order{1 - turn}") as out:
            for old in self.blocks(turn):
                size = len(old)
                low, high = np.searchsorted(before, (at, at + size))
                high = len(target) if at + size == n else high
                put = target[low:high] - at - low
                stay = np.ones(size + high - low, bool)
                stay[put] = False
                made = np.empty(len(stay), np.uint16)
                made[stay] = old
                after = put + 1
                inside = np.flatnonzero(after < len(made))
                after = after[inside]
                made[after] = (made[after] & np.uint16(0xFF00)) | down[low:high][inside]
                made[put] = new[low:high]  # of two new neighbours the later one's own value holds
                out.write(made)
                if len(scan.place):
                    scan.block(made)
                at += size

    def extensions(self, turn: int, n: int) -> np.ndarray:
        """For each entry the place of its suffix with its symbol before."""
        out, at = np.empty(n, np.int32 if n < 1 << 31 else np.int64), 0
        next_ = self.m + np.cumsum(self.total) - self.total
        next_[0] = 0  # string starts have none
        for entries in self.blocks(turn):
            bwt = (entries >> 8).astype(np.uint8)
            runs = Runs(bwt)
            out[at : at + len(bwt)] = np.arange(len(bwt)) + np.repeat(next_[runs.symbol] + runs.before - runs.start, runs.end - runs.start)
            next_ += runs.own
            at += len(bwt)
        return out

    def equal_windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """string, start, class: the windows of length symbols that all strings have; equal windows have equal class."""
        m, n, turn = self.m, self.m, 0
        if self.rounds < self.length:
            return (np.zeros(0, np.int64),) * 3
        who = np.arange(m)
        scan = Scan(m, who)  # the empty ends come first, by string
        for entries in self.blocks(turn):
            scan.block(entries)
        symbols = self.files.read("symbols")
        symbols.read(m)
        for j in range(1, self.rounds + 1):
            before = np.frombuffer(symbols.read(m), np.uint8)
            target, up, down = scan.found()
            order = np.argsort(target)
            who, place, up, down = who[order], target[order], up[order], down[order]
            go = self.size[who] > j
            scan = Scan(m, place[go])
            self.insert(turn, n, place, before[who].astype(np.uint16) << 8 | up, down, scan)
            n, turn = n + len(who), 1 - turn
            who = who[go]
        symbols.close()
        after = self.extensions(turn, n)
        found = []
        who = place = np.arange(m)
        for j in range(1, self.rounds + 1):
            go = self.size[who] >= j
            who, place = who[go], after[place[go]]
            if j >= self.length:
                found.append((who, self.size[who] - j, place))
        who, start, place = (np.concatenate(x) for x in zip(*found))
        group, at = after, 0  # in the same memory
        for entries in self.blocks(turn):
            new = np.cumsum(entries.astype(np.uint8) < self.length)
            group[at : at + len(new)] = new + (int(group[at - 1]) if at else 0)
            at += len(new)
        return who, start, group[place].astype(np.int64)
