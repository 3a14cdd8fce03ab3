"""The pipeline against a plain version of every stage."""
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from test_text_dedup import fingerprint, linked, removed
from test_tokens import check_sequences, pieces_of
from vigil.llm import best_fit_packing, toxicity
from vigil.llm.common import crc32_mod

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def folder(spark, tmp_path):
    """sf0.001 with odd rows added: nulls, empty and blank texts, copies."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("doc_id = 1").first()
    odd = [(9001, None, "en", None, None), (9002, "", None, "src1", 0), (9003, " \n ", "en", "src1", 3),
           (9004, first.text, first.lang, first.source, first.n_chars), (9005, "123 456", "de", "src0", 7),
           (None, "a row without a number, of plain words", "en", "src0", 38), (9006, "you stupid idiot " * 30, "en", "src2", 510)]
    out = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    out.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_stages(spark, tmp_path):
    sf, docs = folder(spark, tmp_path)
    assert [n for n, _ in C.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    stage = dict(C.STAGES)

    model = toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"), crc32_mod("doc_id", 5) != 0)
    kept = stage["toxicity"](spark, docs, sf).cache()
    assert kept.columns == COLUMNS
    assert rows(kept) == sorted((r for r in rows(docs) if model.score(r[1]) < 0.5), key=str)
    assert 9006 not in {r[0] for r in rows(kept)} and kept.count() > 150

    known = stage["language_id"](spark, kept, sf).cache()
    assert rows(known) == sorted((r for r in rows(kept) if any(c.isalpha() for c in r[1] or "")), key=str)

    alone = stage["simhash_near_dedup"](spark, known, sf).cache()
    given = [r for r in rows(known) if r[0] is not None]
    given.sort()
    label = linked([fingerprint(r[1]) for r in given], 4)
    want = [r for i, r in enumerate(given) if label[i] == i] + [r for r in rows(known) if r[0] is None]
    assert rows(alone) == sorted(want, key=str) and 9004 not in {r[0] for r in want}

    cut = stage["substring_dedup"](spark, alone, sf).cache()
    before = rows(alone)
    units = [(r[1] or "").encode().split() for r in before]
    want = []
    for r, u, gone in zip(before, units, removed(units, 35)):
        text = b" ".join(w for w, x in zip(u, gone) if not x).decode() if gone.any() else r[1]
        want.append((r[0], text, r[2], r[3], len(text) if gone.any() else r[4]))
    assert rows(cut) == sorted(want, key=str)

    packed = stage["best_fit_packing"](spark, cut, sf).collect()
    tok = Tokenizer.from_file(best_fit_packing.VOCABULARY)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == Counter(
        (r[0], *p) for r in rows(cut) for p in pieces_of(r[1], tok))
    check_sequences(packed)

    whole = C.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, whole)) == Counter(map(key, packed))


def test_one_row_of_each_component_stays(spark):
    """Repeated rows, null-id copies and ids with two texts, through the substring stage."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    a, b, c, d, e = (" ".join(rng.choice(words, 90)) for _ in range(5))
    f = e.upper()                                           # another text, the same fingerprint
    given = [(1, a), (1, a), (None, a), (None, b), (None, b), (2, c), (3, c), (3, d), (4, e), (None, f), (0, b + " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(C.STAGES)
    alone = stage["simhash_near_dedup"](spark, docs, SF).cache()
    assert alone.columns == COLUMNS
    want = sorted([(1, a), (0, b + " "), (2, c), (3, d), (4, e)])
    assert sorted((r.doc_id, r.text) for r in alone.collect()) == want
    cut = stage["substring_dedup"](spark, alone, SF).collect()
    assert sorted((r.doc_id, r.text) for r in cut) == want
    nameless = stage["simhash_near_dedup"](spark, docs.where("doc_id is null"), SF).collect()
    assert sorted(r.text.lower() for r in nameless) == sorted([a, b, e])


def test_unlabelled_corpus_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "plain words", None, "s", 11), (2, "123 456", None, "s", 7), (3, None, None, "s", None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in C.drop_unknown_language(spark, docs, str(tmp_path)).collect()] == [1]


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_entry_without_the_operators(tmp_path):
    """The rest imports and lists its queries when the subpackage is away."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(C.__file__))
    away = tmp_path / "repo"
    shutil.copytree(os.path.join(root, "vigil"), away / "vigil", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), away)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=away, check=True, env={**os.environ, "PYTHONPATH": str(away)})


def test_crc_of_ids(spark):
    out = best_fit_packing.pack(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"))
    r = out.withColumn("crc", F.crc32("ids")).first()
    assert r.crc == zlib.crc32(np.frombuffer(r.ids, "<u4").tobytes()) and np.frombuffer(r.ids, "<u4")[-1] == 2
