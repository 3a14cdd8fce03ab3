"""Suffix-array dedup by a distributed difference-cover algorithm.

Removed is every byte that lies in a string of ``width`` bytes which also
starts anywhere else, in the same document or another.

Suffixes are sorted to that depth, and the sort is dealt by content: each
window of ``width`` bytes has an anchor, the smallest of its ``gram``-byte
strings by hash (the rightmost of equals), so windows with equal bytes have
equal anchors and meet in one bucket.  Consecutive windows with one anchor
share a context, the stretch of text they cover.  Contexts whose anchor occurs
only once hold no repeat; contexts that occur more than once consist of
repeats.  One occurrence of each other context goes to its anchor's bucket,
where the suffixes are sorted by the difference-cover algorithm: the triples
at two of three positions are sorted and named, the names are sorted by
recursion, the remaining suffixes are merged in, and neighbours in the order
are compared over ``width`` bytes.

Anchors with more than ``bucket`` contexts would make one bucket too large;
their windows are dealt further, by the 128-bit fingerprint of the window.

The text is shuffled once, into chunks; all passes reuse that exchange.
Chunks and buckets exchange sorted arrays, one entry per distinct key and
chunk, so that no key is hot.

Defined cases: null and shorter texts lose nothing; rows that occur more than
once are copies of each other; extra columns pass through, one named like an
output column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import binary_parts, blocks, is_text, mix64, outside, partitions, powers
from vigil.llm.sketch import Plan, chunked, covered, key_order

WIDTH, GRAM = 400, 260
BUCKET = 2048            # contexts of one anchor sorted together; more are dealt by window
BATCH = 300_000          # symbols of one suffix array (names must fit in 21 bits)
FINER = 3                # buckets of contexts are dealt by this many more bits than keys are
BLOCK = 1 << 20
MADE = ["kept", "n_bytes", "n_removed", "n_spans"]
_BASES = tuple((np.uint64(b), np.uint64(pow(b, -1, 2**64))) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_VALUES = np.random.default_rng(77).integers(0, 2**64, (2, 256), dtype=np.uint64)


# ------------------------------------------------------------- suffix array


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (positive integers below 2**21, at most
    about two million) in order, by the difference cover of period three."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s.astype(np.int64), [0, 0, 0]))
    one = np.arange(1, n + (n % 3 == 1), 3)             # a dummy suffix keeps the two parts of the name string apart
    two = np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    triple = t[sample] << 42 | t[sample + 1] << 21 | t[sample + 2]
    order = np.argsort(triple)
    new = np.concatenate(([True], triple[order[1:]] != triple[order[:-1]]))
    name = np.empty(len(sample), np.int64)
    name[order] = np.cumsum(new)
    if not new.all():
        order = suffix_array(name)                      # equal triples: sort by the names that follow
    rank = np.zeros(n + 3, np.int64)
    sorted12 = sample[order]
    rank[sorted12] = np.arange(1, len(sorted12) + 1)
    sorted12 = sorted12[sorted12 < n]
    zero = np.arange(0, n, 3)
    by_next = t[zero] << 22 | rank[zero + 1]
    zero = zero[np.argsort(by_next)]
    # merge: how many sampled suffixes precede each of the others
    s1, s2 = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    key2 = lambda i: t[i].astype(np.uint64) << np.uint64(43) | (t[i + 1] << 22 | rank[i + 2]).astype(np.uint64)
    ahead = np.searchsorted(t[s1] << 22 | rank[s1 + 1], t[zero] << 22 | rank[zero + 1]) \
        + np.searchsorted(key2(s2), key2(zero))
    out = np.empty(n, np.int64)
    at = ahead + np.arange(len(zero))
    free = np.ones(n, bool)
    free[at] = False
    out[at] = zero
    out[free] = sorted12
    return out


# ------------------------------------------------------------------ anchors


class Hashes:
    """Two independent 64-bit hashes of any stretch of ``data``."""

    def __init__(self, data: np.ndarray):
        self.data, self.sums = data, []
        for (base, _), values in zip(_BASES, _VALUES):
            total = np.empty(len(data) + 1, np.uint64)
            total[0] = 0
            np.cumsum(values[data] * powers(base, len(data)), out=total[1:])
            self.sums.append(total)

    def of(self, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        total, inverse = self.sums[which], powers(_BASES[which][1], len(self.data) + 1)
        return mix64((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))

    def both(self, start, stop) -> np.ndarray:
        return np.stack([self.of(start, stop, 0), self.of(start, stop, 1)], 1)


def _window_anchors(h: Hashes, off: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows that lie in one document, and their anchors."""
    n = len(h.data)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(off)
    at = np.arange(n)
    bits = np.uint64(max(1, int(n).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    last = np.repeat(off[1:], size)                          # end of each byte's document
    i = at[:n - gram + 1]
    key = (h.of(i, i + gram, 0) >> bits << bits) | (mask - i.astype(np.uint64))
    key[i + gram > last[:len(i)]] = np.iinfo(np.uint64).max
    span, reach = width - gram + 1, 1                         # smallest key of ``span`` neighbours
    while reach * 2 <= span:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < span:
        key = np.minimum(key[:len(key) - (span - reach)], key[span - reach:])
    p = at[:len(key)][at[:len(key)] + width <= last[:len(key)]]
    return p, (mask - (key[p] & mask)).astype(np.int64)


class Contexts:
    """Runs of windows with one anchor in a block of documents."""

    def __init__(self, data: np.ndarray, off: np.ndarray, width: int, gram: int):
        self.hashes = h = Hashes(data)
        p, a = _window_anchors(h, off, width, gram)
        new = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(p) != 1)))) if len(p) else \
            np.zeros(0, np.int64)
        self.first, self.count = p[new] if len(p) else p, np.diff(np.append(new, len(p)))
        self.anchor, self.stop = a[new] if len(p) else a, self.first + self.count - 1 + width
        # the first hash chose the anchors and is small for all of them: keys are dealt by the second
        self.gram = h.both(self.anchor, self.anchor + gram)[:, ::-1]
        inner = mix64((self.anchor - self.first).astype(np.uint64) + np.uint64(1 << 40))
        self.text = h.both(self.first, self.stop) ^ np.stack([inner, mix64(inner)], 1)

    def __len__(self):
        return len(self.first)

    def windows(self, r: int, width: int) -> np.ndarray:
        """Fingerprints of the windows of one run."""
        p = np.arange(self.first[r], self.first[r] + self.count[r])
        return self.hashes.both(p, p + width)


# --------------------------------------------------- key exchange of chunks


def _distinct(keys: np.ndarray):
    """Sorted distinct rows of (n, 2) keys, the number of each input's key,
    how often each occurs and one place where it does."""
    order = key_order(keys[:, 0], keys[:, 1])
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]).any(1)
    first = np.flatnonzero(new)
    of = np.empty(len(k), np.int64)
    of[order] = np.cumsum(new) - 1
    return k[new], of, np.diff(np.append(first, len(k))), order[first]


def _deal(keys: np.ndarray, bits: int):
    """(part, from, to) of sorted keys dealt by their leading bits."""
    part = (keys[:, 0] >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.zeros(0, np.int64)
    return zip(part[cut].tolist(), cut.tolist(), np.append(cut[1:], len(part)).tolist())


SENT = "chunk int, kind int, part int, keys binary, number binary, body binary"
REPLY = "chunk int, kind int, part int, body binary"
ANCHORS, TEXTS, SORTED, WINDOWS, STATUS = range(5)
REPEATED, OWNER, HOT = 1, 2, 4


def _sent(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    cols = list(zip(*rows)) if rows else [()] * 6
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["chunk", "kind", "part", "keys", "number", "body"])


def _replies(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    cols = list(zip(*rows)) if rows else [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["chunk", "kind", "part", "body"])


def _count(kind: int, t: pa.Table, bucket: int) -> list[tuple]:
    """Flags of each key a chunk sent: does it occur more than once, is this
    chunk the first to have it, are its contexts too many for one bucket."""
    chunk, part = t["chunk"].to_numpy(), t["part"].to_pylist()
    keys = [np.frombuffer(k, np.uint64).reshape(-1, 2) for k in t["keys"].to_pylist()]
    number = np.concatenate([np.frombuffer(x, np.uint32) for x in t["number"].to_pylist()]).astype(np.int64)
    contexts = np.concatenate([np.frombuffer(x, np.uint32) for x in t["body"].to_pylist()]).astype(np.int64)
    size = np.array([len(k) for k in keys])
    _, of, _, _ = _distinct(np.concatenate(keys))
    n = of.max() + 1
    owner = np.full(n, np.iinfo(np.int64).max)
    whose = np.repeat(chunk.astype(np.int64), size)
    np.minimum.at(owner, of, whose)
    flags = ((np.bincount(of, number, n) > 1)[of] * REPEATED + (owner[of] == whose) * OWNER
             + (np.bincount(of, contexts, n) > bucket)[of] * HOT).astype(np.uint8)
    cut = np.cumsum(np.concatenate(([0], size)))
    return [(int(c), kind, p, flags[i:j].tobytes()) for c, p, i, j in zip(chunk, part, cut, cut[1:])]


_HEAD = np.dtype([("row", np.int32), ("first", np.int32), ("windows", np.int32), ("bytes", np.int32), ("known", np.int32)])


def _sort_bucket(t: pa.Table, width: int) -> list[tuple]:
    """Suffix-sort the contexts that share an anchor with another one; bits of
    the windows that have an equal neighbour."""
    keys = np.concatenate([np.frombuffer(k, np.uint64).reshape(-1, 2) for k in t["keys"].to_pylist()])
    heads = [np.frombuffer(x, _HEAD) for x in t["number"].to_pylist()]
    head = np.concatenate(heads)
    chunk = np.repeat(t["chunk"].to_numpy(), [len(h) for h in heads])
    data = np.frombuffer(b"".join(t["body"].to_pylist()), np.uint8)
    start = np.cumsum(head["bytes"].astype(np.int64)) - head["bytes"]
    _, of, times, _ = _distinct(keys)
    todo = np.flatnonzero(times[of] > 1)
    todo = todo[np.argsort(of[todo], kind="stable")]
    found: dict[int, list[bytes]] = {}
    i = 0
    while i < len(todo):
        size = np.cumsum(head["bytes"][todo[i:i + BATCH // width + 1]].astype(np.int64) + 1)
        j = i + max(1, int(np.searchsorted(size, BATCH)))
        while j < len(todo) and of[todo[j]] == of[todo[j - 1]]:
            j += 1                                            # an anchor's contexts stay together
        mine, i = todo[i:j], j
        n = head["bytes"][mine].astype(np.int64)
        begin = np.cumsum(n + 1) - n - 1
        src = np.repeat(start[mine] - begin, n + 1) + np.arange(int((n + 1).sum()))
        ends = begin + n
        src[ends] = 0
        text = data[src]
        symbols = text.astype(np.int64) + 1
        symbols[ends] = 257 + np.arange(len(mine))
        sa = suffix_array(symbols)
        window = np.zeros(len(symbols), bool)
        w = head["windows"][mine].astype(np.int64)
        window[np.repeat(begin, w) + np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)] = True
        sa = sa[window[sa]]
        print_ = Hashes(text).both(sa, sa + width)
        same = (print_[1:] == print_[:-1]).all(1)
        hit = np.zeros(len(symbols), bool)
        hit[sa[1:][same]] = True
        hit[sa[:-1][same]] = True
        for r, b, k in zip(mine, begin, w):
            if not head["known"][r]:
                found.setdefault(int(chunk[r]), []).append(
                    head["row"][r:r + 1].tobytes() + np.int32(k).tobytes() + np.packbits(hit[b:b + k]).tobytes())
    return [(c, SORTED, 0, b"".join(x)) for c, x in found.items()]


# ----------------------------------------------------------------- operator


def remove_repeats(df: DataFrame, text: str = "text", width: int = WIDTH, gram: int = GRAM,
                   bucket: int = BUCKET) -> DataFrame:
    """Input columns other than ``text``, then kept (the remaining bytes),
    n_bytes, n_removed and n_spans (maximal removed runs)."""
    rest = [c for c in outside(df, MADE) if c != text]
    src = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], is_text(text).alias("t"))
    size = src.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    plan = Plan(size, size, partitions(df.sparkSession))
    texts = chunked(src, plan).withColumn("h", F.xxhash64(*src.columns))

    def ordered(t):
        """A chunk's rows in an order that does not depend on how they arrived:
        the passes refer to contexts by their number."""
        return t.take(pa.array(np.argsort(t["h"].to_numpy(), kind="stable")))

    def contexts(t):
        """(first document, last, offsets, contexts, number of the first)."""
        data, off = binary_parts(t["t"])
        row = 0
        for i, j in blocks(off, BLOCK):
            c = Contexts(data[off[i]:off[j]], off[i:j + 1] - off[i], width, gram)
            yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i], c, row
            row += len(c)

    def joined(parts):
        every = [c for *_, c, _ in parts]
        return (np.concatenate([c.gram for c in every]) if every else np.zeros((0, 2), np.uint64),
                np.concatenate([c.text for c in every]) if every else np.zeros((0, 2), np.uint64))

    def announce(key, t):
        chunk, (gram_, text_), rows = key[0].as_py(), joined(contexts(ordered(t))), []
        texts_, _, times, first = _distinct(text_) if len(text_) else (text_, None, text_[:, 0], None)
        grams, of, often, _ = _distinct(gram_) if len(gram_) else (gram_, None, gram_[:, 0], None)
        kinds = np.bincount(of[first], minlength=len(grams)) if len(gram_) else often
        for kind, keys, number, body in ((ANCHORS, grams, often, kinds), (TEXTS, texts_, times, np.zeros(len(texts_)))):
            for part, i, j in _deal(keys, plan.key_bits):
                rows.append((chunk, kind, part, keys[i:j].tobytes(), number[i:j].astype(np.uint32).tobytes(),
                             body[i:j].astype(np.uint32).tobytes()))
        return _sent(rows)

    def count(key, t):
        return _replies(_count(key[0].as_py(), t, bucket))

    def flags_of(reply, kind):
        got = sorted((p, b) for k, p, b in zip(reply["kind"].to_pylist(), reply["part"].to_pylist(),
                                               reply["body"].to_pylist()) if k == kind)
        return np.frombuffer(b"".join(b for _, b in got), np.uint8)

    def ship(t, reply):
        if not t.num_rows:
            return _sent([])
        chunk, rows, parts = t["chunk"][0].as_py(), [], list(contexts(ordered(t)))
        gram_, text_ = joined(parts)
        if not len(gram_):
            return _sent([])
        _, of_gram, _, _ = _distinct(gram_)
        _, of_text, _, first = _distinct(text_)
        anchor, whole = flags_of(reply, ANCHORS)[of_gram], flags_of(reply, TEXTS)[of_text]
        leads = np.zeros(len(gram_), bool)
        leads[first] = True
        known = whole & REPEATED > 0
        out = (anchor & REPEATED > 0) & np.where(known, leads & (whole & OWNER > 0), True)
        hot = out & (anchor & HOT > 0)
        rows.append((chunk, STATUS, -1 - chunk, b"", b"", (known + 2 * (out & ~known) + 4 * hot).astype(np.uint8).tobytes()))
        keys, heads, bodies, wide = [], [], [], []
        for _, _, data, _, c, row in parts:
            mine = slice(row, row + len(c))
            for r in np.flatnonzero(out[mine] & ~hot[mine]):
                heads.append((row + r, c.first[r], c.count[r], c.stop[r] - c.first[r], known[row + r]))
                bodies.append(data[c.first[r]:c.stop[r]].tobytes())
            keys.append(c.gram[out[mine] & ~hot[mine]])
            for r in np.flatnonzero(hot[mine]):
                wide.append(c.windows(r, width))
        keys, head = np.concatenate(keys), np.array(heads, _HEAD)
        order = key_order(keys[:, 0], keys[:, 1])
        keys, head, bodies = keys[order], head[order], [bodies[i] for i in order]
        for part, i, j in _deal(keys, plan.key_bits + FINER):
            rows.append((chunk, SORTED, part, keys[i:j].tobytes(), head[i:j].tobytes(), b"".join(bodies[i:j])))
        if wide:
            windows, _, times, _ = _distinct(np.concatenate(wide))
            for part, i, j in _deal(windows, plan.key_bits):
                rows.append((chunk, WINDOWS, part, windows[i:j].tobytes(), times[i:j].astype(np.uint32).tobytes(),
                             np.zeros(j - i, np.uint32).tobytes()))
        return _sent(rows)

    def compare(key, t):
        kind = key[0].as_py()
        if kind == STATUS:
            return _replies(list(zip(t["chunk"].to_pylist(), t["kind"].to_pylist(), t["part"].to_pylist(),
                                     t["body"].to_pylist())))
        return _replies(_count(kind, t, bucket) if kind == WINDOWS else _sort_bucket(t, width))

    def mark(t, reply):
        t = ordered(t)
        by_kind = {k: [b for x, b in zip(reply["kind"].to_pylist(), reply["body"].to_pylist()) if x == k]
                   for k in (STATUS, SORTED)}
        status = np.frombuffer(b"".join(by_kind[STATUS]), np.uint8)
        bits: dict[int, np.ndarray] = {}
        for blob in by_kind[SORTED]:
            at = 0
            while at < len(blob):
                row, k = np.frombuffer(blob, np.int32, 2, at)
                size_ = (k + 7) // 8
                bits[int(row)] = np.unpackbits(np.frombuffer(blob, np.uint8, size_, at + 8), count=k).astype(bool)
                at += 8 + size_
        parts = list(contexts(t))
        wide = [c.windows(r, width) for *_, c, row in parts for r in np.flatnonzero(status[row:row + len(c)] & 4)]
        flags = flags_of(reply, WINDOWS)
        hits = (flags[_distinct(np.concatenate(wide))[1]] & REPEATED > 0) if wide else np.zeros(0, bool)
        used, kept, total, gone, spans = 0, [], [], [], []
        for i, j, data, off, c, row in parts:
            starts = []
            for r in range(len(c)):
                s = status[row + r]
                if s & 4:
                    got = hits[used:used + c.count[r]]
                    used += c.count[r]
                else:
                    got = bits.get(row + r)
                if s & 1:
                    starts.append(np.arange(c.first[r], c.first[r] + c.count[r]))
                elif got is not None and s & 2:
                    starts.append(c.first[r] + np.flatnonzero(got))
            starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
            out = covered(starts, width, len(data))
            for a, b in zip(off, off[1:]):
                mine = out[a:b]
                total.append(int(b - a))
                gone.append(int(mine.sum()))
                spans.append(int((np.diff(mine.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(data[a:b][~mine].tobytes())
        cols = {f"c{i}": t[f"c{i}"] for i in range(len(rest))}
        return pa.table(cols | {"kept": pa.array(kept, pa.binary()), "n": pa.array(total, pa.int64()),
                                "gone": pa.array(gone, pa.int64()), "spans": pa.array(spans, pa.int64())})

    flags = (texts.groupBy("chunk").applyInArrow(announce, SENT)
             .groupBy("kind", "part").applyInArrow(count, REPLY))
    repeats = (texts.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(ship, SENT)
               .groupBy("kind", "part").applyInArrow(compare, REPLY))
    kinds = ", ".join([f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]
                      + ["kept binary", "n long", "gone long", "spans long"])
    return texts.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(mark, kinds).toDF(*rest, *MADE)


def op8_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                       F.sha2("kept", 256).alias("kept_sha256"))
