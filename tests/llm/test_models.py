"""Toxicity and language ID: held-out accuracy, defined cases, exact lengths."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import language_id, toxicity
from vigil.llm.common import crc32_mod

SF = "/root/testdata/sf0.1"


def test_language_id_held_out(spark):
    got = language_id.op6_query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert r[0] > 0.99
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def small(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(
        [("the cat and the dog", "en")] * 6 + [("der hund und die katze", "de")] * 6 + [("abc", None)])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id_cases(spark):
    trees = language_id.learn(small(spark), "text", "lang", F.lit(True))
    assert trees.langs == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 -- !"), (4, "the dog and the cat"), (5, "die katze und der hund " * 5000), (6, "ß"),
            (4, "the dog and the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    out = language_id.identify(df, trees)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    got = sorted((r.doc_id, r.lang_pred) for r in out.collect())
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")] and got[3:6] == [(4, "en"), (4, "en"), (5, "de")]
    assert [r.score for r in out.where("lang_pred = 'und'").collect()] == [0.0] * 3
    assert language_id.learn(small(spark).limit(0), "text", "lang", F.lit(True)) is None
    assert {r.lang_pred for r in language_id.identify(df, None).collect()} == {"und"}


def test_code_lengths_are_exact(spark):
    """Against a plain walk down the context trees."""
    trees = language_id.learn(small(spark), "text", "lang", F.lit(True))
    texts = {0: "der hund und die katze", 1: "the cat and the dog"}
    for probe in ("the katze", "xyz", "dog", "катя", "catcatcat der"):
        data = np.frombuffer(probe.encode(), np.uint8)
        got = trees.lengths(data, np.array([0, len(data)]))[0]
        for k, text in texts.items():
            sym = [0] * 3 + list(text.lower().encode())
            grams = [tuple(sym[i - o:i + 1]) for i in range(3, len(sym)) for o in range(4)]      # equal texts count once
            bits, past = 0.0, [0] * 3
            for b in probe.encode():
                s = b
                p, o = 1.0, 3
                while o >= 0:
                    ctx = tuple(past[len(past) - o:])
                    seen = [g for g in grams if len(g) == o + 1 and g[:-1] == ctx]
                    kinds = len(set(seen))
                    if seen:
                        n = seen.count((*ctx, s))
                        if n:
                            p *= n / (len(seen) + kinds)
                            break
                        p *= kinds / (len(seen) + kinds)
                    o -= 1
                if o < 0:
                    p /= 256
                bits -= math.log2(p)
                past = [*past[1:], s]
            assert got[k] == pytest.approx(bits, rel=1e-4), (probe, k)


def test_five_scripts(spark):
    """Letters of any script are told apart, however many languages there are."""
    words = {"el": "και το να του η ο στην είναι για με που δεν", "ru": "и в не на что он как это она по но из", "uk": "і в не на що він як це вона по але з",
             "zh": "的 一 是 不 了 在 人 有 我 他 这 中", "ja": "の に は を た が で て と し れ さ", "ar": "في من على أن إلى هذا التي ما لا كان", "he": "של את על לא זה הוא היא עם כל גם",
             "hi": "के में है की को से यह और का पर", "en": "the of and to in a is that for it", "de": "der die und in den von zu das mit sich"}
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(w.split(), 30)), lang) for lang, w in words.items() for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language_id.learn(df, "text", "lang", F.col("doc_id") < 30)
    got = language_id.identify(df.where("doc_id >= 30"), trees).collect()
    assert len(got) == 100 and all(r.lang_pred == r.lang for r in got)


def test_one_text_repeated_is_learned_once(spark):
    many = small(spark).unionByName(spark.range(3000).selectExpr("id AS doc_id", "'the cat and the dog' AS text", "'en' AS lang"))
    one, two = (language_id.learn(d, "text", "lang", F.lit(True), sample_docs=2) for d in (small(spark), many))
    assert (one.four == two.four).all() and np.allclose(one.cost4, two.cost4)


def test_toxicity_held_out(spark):
    got = toxicity.op5_query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    rate = {r[0]: r[1] for r in got.groupBy("toxic").agg(F.avg("predicted")).collect()}
    assert rate[1] > 0.85 and rate[0] < 0.005            # measured: 0.876 (85 of 97) and 0.0014


def test_toxicity_of_very_many_clauses(spark):
    """Time grows with the text: a clause is looked for behind the one before it."""
    import time
    model = toxicity.Model(toxicity.Grammar({"idiot": 1.0}, {}), toxicity.SEED_WEIGHTS, toxicity.SEED_BIAS)
    took = []
    for n in (20_000, 80_000):
        t = time.process_time()
        assert model.score("you idiot. " * n) == pytest.approx(model.score("you idiot. " * n))
        took.append(time.process_time() - t)
    assert took[1] < 9 * took[0]


def test_toxicity_near_copies_make_no_atoms(spark):
    """A third of the toxic rows are one text with one word changed in each."""
    rng = np.random.default_rng(4)
    base = [f"neutral{i:02d}x" for i in range(60)]
    rows = []
    for k in range(100):
        copy = list(base)
        copy[k % 60] = f"{k}changed"
        rows.append((" ".join(copy), 1))
    rows += [("you qwertzer " + " ".join(f"a{x}" for x in rng.integers(0, 10**9, 20)), 1) for _ in range(200)]
    rows += [(" ".join(f"b{x}" for x in rng.integers(0, 10**9, 20)), 0) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    g = toxicity.learn(docs, labels, F.lit(True)).grammar
    assert g.lexical("qwertzer") > 0
    assert [w for w in base if g.lexical(w)] == []


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["you are a stupid idiot"] * 30 + ["a fine day for a walk"] * 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i < 30 else 0) for i in range(90)] + [(None, 1), (3, None), (5, 0)],
                                   "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, F.lit(True))
    texts = [None, "", "x " * 100_000, "you are an idiot", "a fine walk", "a fine walk"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("predicted", F.lit("x"))
    out = toxicity.score(df, model)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].predicted for i in range(6)] == [0, 0, 0, 1, 0, 0]
    assert got[0].score == got[1].score and 0 <= got[0].score <= 1
    for bad in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.score(df, toxicity.learn(docs, bad, F.lit(True))).count() == 6
    assert toxicity.score(df.limit(0), model).count() == 0


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 2.0}, {"moro": 1.0})

    def kinds(t):
        return np.flatnonzero(g.features(t)[:toxicity.KINDS]).tolist()
    assert kinds("nothing here") == []
    assert kinds("an idiot arrived") == [0]
    assert kinds("you idiot") == [4] and kinds("idiot that you are") == [4]
    assert kinds("not an idiot") == [2]
    assert kinds("they said an idiot arrived") == [5] and kinds('the "idiot" arrived') == [1]
    assert kinds("I will kill you. A fine day") == [12]
    assert kinds("an idiot. you are kind") == [0]
    assert kinds("what a MORON") == [0]


def test_crc_folds(spark):
    import zlib
    got = spark.range(50).select("id", crc32_mod("id", 5).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 5 for r in got)
