"""Substring dedup, suffix-array dedup and SimHash against brute force, with
nulls, empty and very long texts, repeated rows, ties and clashing columns."""
import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vigil.llm import simhash_dedup, substring_dedup, suffix_dedup
from vigil.llm.common import components

R = random.Random(11)


def prose(n, letters="abcdefghij"):
    return " ".join("".join(R.choice(letters) for _ in range(R.randint(2, 6))) for _ in range(n))


PASSAGE = prose(60)
BASE = prose(300)
TEXTS = [None, "", "   \t\n", "one", BASE, BASE, BASE.replace(" ", "\n", 3), prose(20) + " " + PASSAGE + " " + prose(20),
         PASSAGE + " " + prose(40), prose(200) + "\x0b" + BASE[:700], "word " * 400, "a" * 3000, "ab" * 900, "é" * 700,
         prose(4000), BASE + " " + BASE, prose(36), "\x00 x \x85 y"] + [prose(30) + " " + PASSAGE + prose(30) for _ in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_removed string, extra int").repartition(3).cache()


def removed(units, width):
    """Per text: which units lie in a window that starts twice or more."""
    count = collections.Counter(tuple(u[i:i + width]) for u in units for i in range(len(u) - width + 1))
    out = []
    for u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - width + 1):
            if count[tuple(u[i:i + width])] > 1:
                gone[i:i + width] = True
        out.append(gone)
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("width", [35, 3])
def test_substring_dedup(docs, width):
    units = [(t or "").encode().split() for t in TEXTS]
    want = {i: (len(u), int(g.sum()), b" ".join(w for w, x in zip(u, g) if not x).decode())
            for i, (u, g) in enumerate(zip(units, removed(units, width)))}
    got = substring_dedup.remove_repeats(docs, width=width)
    assert got.columns == ["doc_id", "extra", "kept_text", "n_words", "n_removed"]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == want
    assert sum(w[1] for w in want.values()) > 200


def test_substring_dedup_as_is(docs):
    got = {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(docs, as_is=True).collect()}
    assert got[0] is None and got[1] == "" and got[2] == "   \t\n" and got[16] == TEXTS[16]
    assert got[4] == ""


@pytest.mark.parametrize("bucket", [2048, 3, 0])
def test_suffix_dedup(docs, bucket):
    units = [(t or "").encode() for t in TEXTS]
    want = {}
    for i, (u, g) in enumerate(zip(units, removed(units, 400))):
        spans = int((np.diff(g.astype(int), prepend=0) == 1).sum())
        want[i] = (len(u), int(g.sum()), spans, sha(np.frombuffer(u, np.uint8)[~g].tobytes()))
    got = suffix_dedup.remove_repeats(docs, bucket=bucket)
    assert got.columns == ["doc_id", "extra", "kept", "n_bytes", "n_removed", "n_spans"]
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, sha(r.kept)) for r in got.collect()} == want


def test_suffix_array():
    rng = np.random.default_rng(5)
    for n in [*range(0, 14), 300, 301, 302]:
        for k in (1, 2, 40):
            s = rng.integers(1, k + 1, n)
            assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert substring_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert simhash_dedup.simhash_components(none).count() == 0


def fingerprint(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = low.encode().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def linked(prints, bits):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= bits and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_simhash(spark, docs):
    near = BASE.split()
    more = [(100 + k, " ".join(near[:k] + ["zz"] + near[k + 1:]), "n", 7) for k in (5, 50, 120, 250)]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema)).unionByName(
        spark.createDataFrame([(None, BASE, "n", 7)], docs.schema))
    ids = [*range(len(TEXTS)), *(m[0] for m in more)]
    prints = [fingerprint(t) for t in [*TEXTS, *(m[1] for m in more)]]
    label = linked(prints, 4)
    got = simhash_dedup.simhash_components(both)
    assert got.columns == ["doc_id", "n_removed", "extra", "fingerprint", "component_id"]
    rows = {r.doc_id: r for r in got.collect()}
    assert {i: rows[i].component_id for i in ids} == {i: ids[k] for i, k in zip(ids, label)}
    assert {i: rows[i].fingerprint % 2**64 for i in ids} == dict(zip(ids, prints))
    assert rows[None].component_id is None and rows[None].fingerprint == rows[4].fingerprint


@pytest.mark.parametrize("block", [16384, 4])
def test_simhash_links_all_pairs(spark, monkeypatch, block):
    """Every pair within four bits is linked, dense balls included."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    prints = [int(c) for c in centres]
    for c in centres[:20]:
        for _ in range(12):
            flips = rng.choice(64, rng.integers(1, 6), replace=False)
            prints.append(int(c) ^ sum(1 << int(f) for f in flips))
    prints = sorted(set(prints))
    df = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)],
                               "node long, fingerprint long")
    comp = {r.node: r.component for r in components(simhash_dedup.links(df, 4)).collect()}
    assert [comp.get(i, i) for i in range(len(prints))] == linked(prints, 4)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] \
        + [(500, x) for x in range(501, 560)] + [(7, 7)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_outputs_keep_repeated_rows(docs):
    twice = docs.where("doc_id in (4, 16)").unionByName(docs.where("doc_id = 16"))
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(twice).collect())
    assert got == [(4, 0), (16, 36), (16, 36)]
    assert suffix_dedup.remove_repeats(twice.withColumn("text", F.repeat("text", 9))).count() == 3


def test_fingerprints_of_one_id_with_other_texts(spark, monkeypatch):
    """An id may stand for different texts: a class is known by its fingerprint."""
    from vigil.llm import simhash_dedup as H
    prints = {"a": 0, "b": 0x0F0F0F0F0F0F0F0F, "c": 1}
    marked = spark.createDataFrame([(5, "a", prints["a"]), (5, "b", prints["b"]), (3, "c", prints["c"]), (None, "c", prints["c"])],
                                   "doc_id long, name string, fingerprint long")
    monkeypatch.setattr(H, "fingerprints", lambda df, text, shingle: marked)
    got = sorted((r.doc_id or 0, r.name, r.component_id) for r in H.simhash_components(marked.withColumn("text", marked.name)).collect())
    assert got == [(0, "c", None), (3, "c", 3), (5, "a", 3), (5, "b", 5)]


def test_groups_do_not_grow_with_the_corpus():
    """Text per group of keys and cells per chunk and slab stay bounded from 100 MB to 100 TB, whatever the partitions."""
    from vigil.llm.sketch import MAX_CHUNK, PART_BYTES, Plan
    for size in (10**8, 5 * 10**8, 10**10, 10**12, 10**14):
        for parts in (12, 50, 2000):
            p = Plan(size, size // 6, parts)
            assert size / 2**p.key_bits <= PART_BYTES and size / p.chunks <= 2 * MAX_CHUNK
            assert p.slab_bits <= 28 and 2**p.cell_bits >= 8 * (size // 6)
            slabs = 2 ** max(0, p.cell_bits - p.slab_bits)
            assert size / 6 / p.chunks / slabs >= 4                     # cells a chunk sends to one slab
    a, b = Plan(10**8, 10**8 // 6, 12), Plan(5 * 10**8, 5 * 10**8 // 6, 50)
    assert (a.key_bits, b.key_bits) == (4, 6) and a.chunks == 24 and b.chunks == 119
