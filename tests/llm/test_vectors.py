"""Vector operators: recall against brute force, links against all pairs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import cap_filter_dedup as C
from vigil.llm import permutation_ann as A

NAN, INF = float("nan"), float("inf")


def load(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    return t["vec_id"].to_numpy(), np.array(t["embedding"].tolist(), float), t["label"].to_numpy()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1", "/root/testdata/sf0.01"])
def test_ann_recall(spark, sf):
    ids, x, _ = load(spark, sf)
    rows = A.op2_query(spark, sf).collect()
    asked = np.flatnonzero(ids % 20 == 0)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = {int(ids[a]): set(ids[np.argsort(-s, kind="stable")[:20]].tolist()) for a, s in zip(asked, score)}
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(best) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(best[q] & {v for _, v, _ in got[q]}) / 20 for q in best]) >= 0.9
    for q, v in list(got.items())[:30]:
        v.sort()
        assert [k for k, *_ in v] == list(range(1, 21))
        assert [(-s, i) for _, i, s in v] == sorted((-s, i) for _, i, s in v)
        assert all(s == pytest.approx(float(x[ids == q][0] @ x[ids == i][0])) for _, i, s in v)


@pytest.mark.parametrize("norms", ["outlier", "spread"])
def test_ann_recall_of_other_norms(spark, norms):
    """One vector ten times as long as the others; lengths spread over a factor of ten and more."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.where(np.arange(6000) == 77, 10.0, 1.0)[:, None] if norms == "outlier" else rng.lognormal(0, 0.5, (6000, 1))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    index, pivots, dim = A.build_index(df.repartition(4))
    assert len(pivots.rows) == 256 and pivots.prefix == 64
    index = index.withColumn("block", F.lit(0))
    got = {}
    for r in A.search(index, pivots, dim, F.col("id") % 60 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len(found & set(np.argsort(-score)[:20].tolist())) / 20)
    assert len(got) == 100 and np.mean(hits) >= 0.95


def test_ann_cases(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [3.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [NAN, 1.0]),
            (6, [1.0]), (7, [-1.0, -1.0]), (40, [1.0, INF]), (None, [9.0, 9.0]), (8, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = sorted(map(tuple, A.search(*A.build_index(df), F.col("id") % 20 == 0).collect()))
    assert got == [(0, 1, 1, 3.0), (0, 2, 2, 3.0), (0, 3, 20, 0.0), (0, 4, 7, -1.0),
                   (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0), (20, 4, 7, -2.0)]
    assert A.search(*A.build_index(df.limit(0)), F.col("id") % 20 == 0).count() == 0


def brute(ids, x, label, least=0.98):
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    near = (unit @ unit.T >= least) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    comp, changed = ids.copy(), True
    while changed:
        low = np.where(near, comp[None, :], np.iinfo(np.int64).max).min(1)
        new = np.minimum(comp, low)
        changed, comp = bool((new != comp).any()), new
    return near.sum(1), comp


@pytest.mark.parametrize("block", [8192, 40])
def test_cap_filters_find_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = np.random.default_rng(8)
    x = [rng.standard_normal(64) for _ in range(300)]
    for k in range(60):                                    # pairs just above and below the threshold, chains, scaled copies
        base = x[k] / np.linalg.norm(x[k])
        side = rng.standard_normal(64)
        side -= side @ base * base
        side /= np.linalg.norm(side)
        c = 0.98 + 1e-6 * (k + 1) * (1 if k % 2 else -1) if k < 40 else 0.985
        x.append((c * base + np.sqrt(1 - c * c) * side) * (k + 1))
    hub = rng.standard_normal(64)
    x += [hub + 0.02 * rng.standard_normal(64) for _ in range(150)] + [hub] * 30
    x = np.array(x)
    ids = rng.permutation(len(x)).astype(np.int64)
    label = np.where(np.arange(len(x)) % 11 == 10, 1, 0)
    df = spark.createDataFrame([(int(i), v.tolist(), int(k)) for i, v, k in zip(ids, x, label)],
                               "vec_id long, embedding array<double>, label int")
    links, comp = brute(ids, x, label)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in C.near_duplicates(df).collect()}
    assert got == {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, links, comp)}


@pytest.mark.parametrize("block", [8192, 100])
def test_low_dimensions_miss_no_link(spark, monkeypatch, block):
    """Pairs just above the threshold in 3 and 8 dimensions, some of whose blocks have one component."""
    monkeypatch.setattr(C, "BLOCK", block)
    rng = np.random.default_rng(9)
    for dim in (3, 8):
        x = rng.standard_normal((250, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        side = rng.standard_normal(x.shape)
        side -= (side * x).sum(1, keepdims=True) * x
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        x = np.vstack([x, 0.9801 * x + np.sqrt(1 - 0.9801**2) * side])
        ids, label = np.arange(len(x)), np.arange(len(x)) % 250 % 2
        df = spark.createDataFrame([(int(i), v.tolist(), int(k)) for i, v, k in zip(ids, x, label)],
                                   "vec_id long, embedding array<double>, label int")
        links, comp = brute(ids, x, label)
        got = {r.vec_id: (r.n_links, r.component_id) for r in C.near_duplicates(df).collect()}
        assert got == {int(i): (int(n), int(c)) for i, n, c in zip(ids, links, comp)}


def test_rotations_keep_the_stated_miss_chance():
    for dim, words in ((16, 40), (64, 15), (64, 40)):
        turns = C.turns_needed(dim, words, C.CAPS, 0.98)
        assert turns and C.miss(dim, words, C.CAPS, 0.98) ** turns <= C.MISS
    assert C.turns_needed(8, 15, C.CAPS, 0.98) == 0


def test_cap_filter_cases(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(1, v, 0, "k"), (2, v, 0, "k"), (2, v, 0, "k"), (3, v, 1, "k"), (4, v, None, "k"), (5, None, 0, "k"),
            (6, [0.0, 0.0, 0.0], 0, "k"), (7, [NAN, 1.0, 1.0], 0, "k"), (8, [1.0, None, 2.0], 0, "k"), (9, [2.0, 4.0, 6.0], 0, "k"),
            (10, w, 0, "k"), (11, [1.0, 2.0], 0, "k"), (None, v, 0, "k"), (12, [-0.0, 1.0, 0.0], 0, "k"), (13, [0.0, 1.0, 0.0], 0, "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string")
    out = C.near_duplicates(df)
    assert out.columns == ["vec_id", "embedding", "label", "n_links", "component_id", "kept"]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in out.collect())
    assert got == [(0, 0, None, True), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True),
                   (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 3, 1, False), (10, 0, 10, True),
                   (11, 0, 11, True), (12, 1, 12, True), (13, 1, 12, False)]
    assert C.near_duplicates(df.limit(0)).count() == 0


def test_real_embeddings(spark):
    sf = "/root/testdata/sf0.1"
    ids, x, label = load(spark, sf)
    links, comp = brute(ids, x, label)
    got = C.op4_query(spark, sf).toPandas().sort_values("vec_id")
    assert (got["n_links"].to_numpy() == links).all() and (got["component_id"].to_numpy() == comp).all()


def test_links_of_one_id_with_other_vectors(spark):
    """An id may stand for different vectors: only those that are near are linked."""
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (1, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.embedding, r.n_links, r.component_id) for r in C.near_duplicates(df).collect())
    assert got == [(1, [0.0, 1.0, 0.0], 0, 1), (1, [1.0, 0.0, 0.0], 2, 1), (1, [1.0, 0.0, 0.0], 2, 1), (2, [1.0, 0.01, 0.0], 2, 1)]
    # the other vector of id 1 joins a component of its own when something is near it
    more = df.unionByName(spark.createDataFrame([(7, [0.0, 1.0, 0.01], 0)], df.schema))
    got = {(r.vec_id, tuple(r.embedding)): (r.n_links, r.component_id) for r in C.near_duplicates(more).collect()}
    assert got[7, (0.0, 1.0, 0.01)] == (1, 1) and got[1, (0.0, 1.0, 0.0)] == (1, 1) and got[2, (1.0, 0.01, 0.0)] == (2, 1)


def test_neighbours_of_repeated_queries(spark):
    """Each of two equal query rows has its own 20 and finds the other one."""
    rng = np.random.default_rng(9)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((60, 8)).tolist())]
    rows.append((20, rows[20][1]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index, pivots, dim = A.build_index(df)
    got = [r for r in A.search(index, pivots, dim, F.col("id") % 20 == 0, share=1.0).collect() if r.query_id == 20]
    assert sorted(r["rank"] for r in got) == sorted([*range(1, 21)] * 2)
    x = np.array([v for _, v in rows])
    score = x @ x[20]
    score[20] = -np.inf
    want = [rows[i][0] for i in np.lexsort((np.array([i for i, _ in rows]), -score))[:20]]
    for k in range(1, 21):
        assert [r.vec_id for r in got if r["rank"] == k] == [want[k - 1]] * 2
