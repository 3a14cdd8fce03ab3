"""Which windows of the corpus occur more than once: a count-min prefilter,
then exact grouping of what it lets through.

Texts are dealt into chunks.  Pass 1 makes, per chunk, one sketch: two rows of
cells, each cell the count (0, 1, more) of windows hashed into it, sent as the
sorted list of its cells in use.  The sketches of all chunks are merged per
slab (a range of cells), and each chunk gets back one bit per cell it sent:
whether the merged count is above one.  A count-min estimate never falls short,
so a window that repeats anywhere keeps both its cells.  Pass 2 groups the
96-bit identities of only the windows estimated repeated, and each chunk gets
back those that do repeat; pass 3 is the caller's and marks the text.

What moves is about four bytes a window up and two bits down, plus 12 bytes
up and down for each window let through.  A key that a third of all rows share is sent
once per chunk.  The text is shuffled once: all passes reuse that exchange.
The sketch's width follows the corpus (``cells`` a window), so that the share
of false positives is the same at every size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import partitions

CHUNK_BYTES, MAX_CHUNK = 4 << 20, 64 << 20
MAX_SLAB_BITS = 26           # a slab's merged counters take 64 MB, of the largest corpora 256 MB
PART_BYTES = 64 << 20        # text whose keys are grouped in one task at most

Windows = Callable[[pa.Table], Iterable[tuple[np.ndarray, np.ndarray]]]


class Plan:
    """Sizes derived from the corpus; only the false-positive share and the
    parallelism depend on them, never the result.

    The keys grouped in one task are those of a bounded stretch of text, so
    their groups grow in number, not in size.  From 64 GB on chunks grow with
    the square root of the corpus, up to 64 MB, so that a chunk still has many
    cells for each slab it writes to."""

    def __init__(self, nbytes: int, nwindows: int, parts: int, cells: int = 8):
        chunk = min(MAX_CHUNK, max(CHUNK_BYTES, round(CHUNK_BYTES * math.sqrt(nbytes / (64 << 30)))))
        self.chunks = max(1, nbytes // chunk, 2 * parts)
        self.cell_bits = max(16, math.ceil(math.log2(max(2, nwindows * cells))))
        widest = MAX_SLAB_BITS if self.cell_bits <= 40 else MAX_SLAB_BITS + 2
        self.slab_bits = min(widest, max(12, self.cell_bits - max(0, round(math.log2(max(1, parts / 2))))))
        self.key_bits = max(1, math.ceil(math.log2(max(2, parts, nbytes / PART_BYTES))))


def chunked(df: DataFrame, plan: Plan) -> DataFrame:
    """Rows with their chunk: equal rows share one, the rest spread evenly."""
    return df.withColumn("chunk", F.pmod(F.xxhash64(*df.columns), F.lit(plan.chunks)).cast("int"))


def _pack(low: np.ndarray, more: np.ndarray) -> bytes:
    """Sorted cell numbers as differences, and one bit each: more than once."""
    d = np.diff(low, prepend=np.uint32(0)).astype(np.uint32)
    small = not len(d) or int(d.max()) < 65536
    return (b"\x02" if small else b"\x04") + len(d).to_bytes(4, "little") + \
        d.astype(np.uint16 if small else np.uint32).tobytes() + np.packbits(more).tobytes()


def _unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, w = int.from_bytes(b[1:5], "little"), b[0]
    d = np.frombuffer(b, np.uint16 if w == 2 else np.uint32, n, 5)
    return np.cumsum(d, dtype=np.uint32), np.unpackbits(np.frombuffer(b, np.uint8, -1, 5 + n * w), count=n)


def _cells(h: np.ndarray, plan: Plan) -> np.ndarray:
    return h >> np.uint64(64 - plan.cell_bits)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and whether each occurs more than once."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x))) > 1


def _hashes(t: pa.Table, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    got = list(windows(t))
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])


def key_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order of keys (a, b).  The first halves decide but for rare
    collisions, and sorting one array is several times faster than two."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():
        return np.lexsort((b, a))
    return order


KEY = np.dtype([("a", "<u8"), ("b", "<u4")])       # a window's identity: 96 bits of its two hashes


def _short(b: np.ndarray) -> np.ndarray:
    return (b >> np.uint64(32)).astype(np.uint32)


def _packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), KEY)
    out["a"], out["b"] = a, b
    return out


def _distinct_keys(a: np.ndarray, b: np.ndarray):
    """Sorted distinct (a, b) and, for each input, the number of its key."""
    order = key_order(a, b)
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return a[first], b[first], first, order, new


def repeated_windows(texts: DataFrame, plan: Plan, windows: Windows) -> DataFrame:
    """(chunk, keys): identities, 12 bytes each and sorted, of the windows of
    a chunk that start more than once in the corpus.  ``texts`` has a column
    chunk; ``windows`` yields both hashes of the windows of a table's rows."""
    lowest = np.uint64((1 << plan.slab_bits) - 1)
    per_row = 1 << (plan.cell_bits - plan.slab_bits) if plan.cell_bits > plan.slab_bits else 1

    def sketch(key, t):
        slabs, blobs = [], []
        for r, h in enumerate(_hashes(t, windows)):
            cell, more = _distinct(_cells(h, plan))
            cut = np.searchsorted(cell, np.arange(1, per_row + 1, dtype=np.uint64) << np.uint64(plan.slab_bits))
            for s, (i, j) in enumerate(zip(np.concatenate(([0], cut[:-1])), cut)):
                if j > i:
                    slabs.append(r * per_row + s)
                    blobs.append(_pack((cell[i:j] & lowest).astype(np.uint32), more[i:j]))
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(slabs), pa.int32()),
                         "slab": pa.array(slabs, pa.int32()), "cells": pa.array(blobs, pa.binary())})

    def merge(key, t):
        count = np.zeros(1 << plan.slab_bits, np.uint8)
        for blob in t["cells"]:
            cell, more = _unpack(blob.as_py())
            count[cell] = np.minimum(count[cell] + 1 + more, 2)
        bits = [np.packbits(count[_unpack(blob.as_py())[0]] > 1).tobytes() for blob in t["cells"]]
        return pa.table({"chunk": t["chunk"], "slab": t["slab"], "bits": pa.array(bits, pa.binary())})

    def candidates(t, reply):
        h = _hashes(t, windows)
        bits = dict(zip(reply["slab"].to_pylist(), reply["bits"].to_pylist()))
        keep = np.ones(len(h[0]), bool)
        for r in range(2):
            cells = _cells(h[r], plan)
            cell, _ = _distinct(cells)
            slab = r * per_row + (cell >> np.uint64(plan.slab_bits)).astype(np.int64)
            cut = np.flatnonzero(np.diff(slab, prepend=-1)) if len(slab) else []
            ends = np.append(cut[1:], len(slab)) if len(slab) else []
            flag = np.zeros(len(cell), bool)
            for i, j in zip(cut, ends):
                flag[i:j] = np.unpackbits(np.frombuffer(bits[int(slab[i])], np.uint8), count=j - i)
            keep &= flag[np.searchsorted(cell, cells)]
        a, b, first, _, _ = _distinct_keys(h[0][keep], _short(h[1][keep]))
        more = np.diff(np.append(first, int(keep.sum()))) > 1
        part = (a >> np.uint64(64 - plan.key_bits)).astype(np.int32)
        cut = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
        ends = np.append(cut[1:], len(part)) if len(part) else []
        keys = _packed(a, b)
        chunk = t["chunk"][0].as_py() if t.num_rows else -1
        return pa.table({"chunk": pa.array([chunk] * len(cut), pa.int32()),
                         "part": pa.array([int(part[i]) for i in cut], pa.int32()),
                         "keys": pa.array([keys[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary()),
                         "more": pa.array([more[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())})

    def exact(key, t):
        keys = [np.frombuffer(k.as_py(), KEY) for k in t["keys"]]
        more = np.concatenate([np.frombuffer(m.as_py(), bool) for m in t["more"]])
        every = np.concatenate(keys)
        _, _, first, order, new = _distinct_keys(every["a"], every["b"])
        total = np.add.reduceat(1 + more[order].astype(np.int64), first)
        hit = np.empty(len(every), bool)
        hit[order] = (total > 1)[np.cumsum(new) - 1]
        cut = np.cumsum([0, *map(len, keys)])
        return pa.table({"chunk": t["chunk"], "keys": pa.array(
            [k[hit[i:j]].tobytes() for k, i, j in zip(keys, cut, cut[1:])], pa.binary())})

    reply = (texts.groupBy("chunk").applyInArrow(sketch, "chunk int, slab int, cells binary")
             .groupBy("slab").applyInArrow(merge, "chunk int, slab int, bits binary"))
    return (texts.groupBy("chunk").cogroup(reply.groupBy("chunk"))
            .applyInArrow(candidates, "chunk int, part int, keys binary, more binary")
            .groupBy("part").applyInArrow(exact, "chunk int, keys binary"))


class KeySet:
    """Membership of window identities among the keys of a reply."""

    def __init__(self, blobs: list[bytes]):
        keys = np.frombuffer(b"".join(blobs), KEY)
        a, b = keys["a"].copy(), keys["b"].copy()
        order = key_order(a, b)
        self.a, self.b = a[order], b[order]

    def __contains__(self, _):
        raise TypeError("use has()")

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        hit, b = np.zeros(len(a), bool), _short(b)
        if not len(self.a):
            return hit
        at, todo = np.searchsorted(self.a, a), np.arange(len(a))
        while len(todo):                    # one step, but for equal first halves
            ok = at[todo] < len(self.a)
            todo = todo[ok]
            todo = todo[self.a[at[todo]] == a[todo]]
            hit[todo[self.b[at[todo]] == b[todo]]] = True
            todo = todo[~hit[todo]]
            at[todo] += 1
        return hit


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Elements that lie in a window starting at one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + width] -= 1
    return np.cumsum(edge[:n]) > 0
