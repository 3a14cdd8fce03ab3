"""The trie against a plain walk over all prefixes."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vigil.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, c string, d int"
EMPTY = hashlib.sha256(b"").hexdigest()


def conversations(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t, key=lambda x: x[:2])] for c, t in out.items()}


def plain_rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = {}
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        own = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + own
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))).encode()).hexdigest())
                  for p, m in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


def random_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 12])):
            rows.append((c, t if t else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é🦆"])))
    hot = [(f, "user", f"hot {f}") for f in range(6)]               # a third has the same conversation
    for c in range(10 * n, 10 * n + n // 2):
        rows += [(c, *t) for t in hot]
    rows += [(20 * n, t, "user", f"long {t % 3}") for t in range(300)] + [(20 * n + 1, t, "user", f"long {t % 3}") for t in range(270)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("band", [256, T.BAND])
def test_trie_against_all_prefixes(spark, monkeypatch, band):
    monkeypatch.setattr(T, "BAND", band)
    monkeypatch.setattr(T, "CHUNK", 7)
    rows = random_rows(60, band)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(7)
    assert rows_of(T.conversation_trie(df)) == plain_trie(conversations(rows))
    assert rows_of(T.trie(*T.rebuilt(T.ranked_turns(df)))) == plain_trie(plain_rebuild(conversations(rows)))


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.conversation_trie(empty).collect() == []
    rows = [(None, 1, "user", "x"), (-7, 1, "user", "x"), (-7, None, None, None), (3, 5, "user", "y" * 200000), (3, 5, "user", "y" * 200000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert rows_of(T.conversation_trie(df)) == plain_trie(conversations(rows))
    assert rows_of(T.trie(*T.rebuilt(T.ranked_turns(df)))) == plain_trie(plain_rebuild(conversations(rows)))
    # turns that tie: the same tree whatever the order of the rows
    tied = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b")]
    got = rows_of(T.conversation_trie(spark.createDataFrame([(*r, "x", 1) for r in tied], SCHEMA)))
    assert [g[:6] for g in got] == [(1, 0, -1, 2, 1, 1), (1, 1, 1, 2, 1, 1), (1, 2, 1, 2, 0, 1)]


def test_bands_follow_rows(spark):
    """Thin deep levels are peeled together, thick ones alone."""
    levels = spark.range(1, 400).select(F.col("id").alias("d"), F.when(F.col("id") <= 6, 9000).otherwise(20).alias("n"))
    levels = levels.select("d", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    got = T.bands(levels)
    assert got[-6:] == [(d, d) for d in range(6, 0, -1)] and len(got) == 7 and got[0] == (7, 399)
    assert T.bands(levels.limit(0)) == []
