"""BPE codec and packing against the tokenizers library and brute force."""
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm import best_fit_packing as P
from vigil.llm import bpe_codec as B

R = random.Random(3)
ODD = ["", None, " ", "a" * 70000, "ab" * 40000, "the" * 20000 + "<|endoftext|>" + "é" * 40000,
       "".join(R.choice("etaoin") for _ in range(60000)), "x " * 50 + "<|startoftext|>hello<|endoftext|>",
       "Á ẛ̣ İSTANBUL ΣΑΣ", "\x1c a\x1fb \x85c d e　f", "it's don't I'LL we've 12345 ...!!! 日本語 👍🏽 ﬁ",
       "́a b ́", "a\x00b﻿c", "!!!" * 9000, "1234567890" * 3000, "the  \n\n\t quick\r\nbrown\x0bfox\x0c", "  lead",
       "tail   ", "a <|endoftext|> b", " " * 5000, "\n" * 300 + " x"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "mine", 1) for i, t in enumerate(ODD)] + [(7, ODD[7], "mine", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, x int").repartition(2).cache()


def test_codec(odd):
    tok = Tokenizer.from_file(B.VOCABULARY)
    tok.no_truncation()
    out = B.encode(odd)
    assert out.columns == ["doc_id", "x", "n_tokens", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        ids = tok.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (
            len(ids), " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False)), r.doc_id
    again = B.decode(out.drop("decoded")).collect()
    assert sorted((r.doc_id, r.decoded) for r in again) == sorted((r.doc_id, r.decoded) for r in rows)
    assert B.encode(odd.limit(0)).count() == 0


def test_join_agrees_with_whole():
    code = B.codec(B.VOCABULARY)
    rng = random.Random(9)
    for _ in range(300):
        w = "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 400)))
        cuts = sorted(rng.sample(range(1, len(w)), min(len(w) - 1, rng.randint(1, 6))))
        parts = [w[i:j] for i, j in zip([0, *cuts], [*cuts, len(w)])]
        leaves = [code.encode(p, k == len(parts) - 1) for k, p in enumerate(parts)]
        assert code.tree(leaves) == code.encode(w, True), (w, cuts)


def pieces_of(text, tok):
    ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
    n, at = len(ids), 0
    for p, k in enumerate([n] if n <= 1024 else ([n % 1024] if n % 1024 else []) + [1024] * (n // 1024)):
        yield p, at, k, zlib.crc32(np.array(ids[at:at + k], "<u4").tobytes())
        at += k


def test_packing(odd):
    tok = Tokenizer.from_file(P.VOCABULARY)
    out = P.pack(odd).withColumn("crc", F.crc32("ids"))
    assert out.columns == ["doc_id", "x", "piece", "start", "length", "ids", "sequence_id", "offset", "crc"]
    rows = out.collect()
    want = Counter((i, *p) for i, t in [*enumerate(ODD), (7, ODD[7])] for p in pieces_of(t, tok))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.crc) for r in rows) == want
    check_sequences(rows)
    assert P.pack(odd.limit(0)).count() == 0


def check_sequences(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by)


def test_packing_is_tight(spark):
    rows = P.op3_query(spark, "/root/testdata/sf0.1").collect()
    least = -(-sum(r.length for r in rows) // 1024)
    assert check_sequences(rows) <= 1.005 * least


def test_plan_uses_every_piece():
    rng = random.Random(1)
    for _ in range(40):
        counts = Counter(rng.randint(1, rng.choice([30, 500, 1024])) for _ in range(rng.randint(0, 400)))
        used, n = Counter(), 0
        for lengths, times in P.plan(counts):
            assert sum(lengths) <= 1024 and times > 0
            n += times
            for k in lengths:
                used[k] += times
        assert used == counts
    assert P.plan({700: 5, 324: 5}) == [((700, 324), 5)]
    assert P.plan({500: 1, 300: 1, 200: 1, 24: 1}) == [((500, 300, 200, 24), 1)]
    assert P.plan({}) == []


def test_chunks_in_parts_are_those_of_the_library():
    """Chunks of more than SPLIT bytes are joined from their parts."""
    import random
    code = B.codec(B.VOCABULARY)
    rng = random.Random(5)
    for n in (17, 18, 33, 60, 200, 5000):
        for _ in range(40 if n < 5000 else 2):
            c = "".join(rng.choice("aabcdeäßИ漢🦆.,-_'<|>9éE") for _ in range(n))
            assert code.parts(c.encode()) == code.whole.encode(c, add_special_tokens=False).ids, c
    assert code.chunk(b"Donaudampfschifffahrt")[0].decode().split() == [
        str(i) for i in code.whole.encode("Donaudampfschifffahrt", add_special_tokens=False).ids]


def test_sums_are_found_under_availability():
    """The index against all pairs and triples, while lengths run out."""
    rng = np.random.default_rng(4)
    for size in (12, 40):
        left = np.where(rng.random(size) < 0.7, rng.integers(1, 4, size), 0)
        left[0] = 0
        sums = P.Sums(left)
        for _ in range(6):
            for total in range(1, size):
                have = [int(k) for k in np.flatnonzero(left)]
                want = [(total,)] if left[total] else []
                want += [(a, total - a) for a in sorted(have, reverse=True) if 2 * a >= total > a and left[total - a]]
                want += [(a, b, total - a - b) for a in sorted(have, reverse=True) for b in sorted(have, reverse=True)
                         if a >= b >= total - a - b > 0 and left[total - a - b]]
                assert list(sums.of(total)) == want, (total, have)
            gone = np.flatnonzero(left)
            if len(gone):
                left[rng.choice(gone)] = 0
