"""BPE encoding and decoding with tree concatenation.

A text is split at ASCII white space, which no token of this vocabulary
crosses; equal chunks are encoded once per worker, those of at most ``SPLIT``
bytes by the ``tokenizers`` library.  Longer ones are cut into leaves, and
neighbouring encodings are joined, halves by halves: a window of tokens around
the join is encoded anew and grows until its first and last tokens are those of
the left and right side.  The leaves of a run without white space of ``LONG``
bytes or more are encoded in parallel, as rows of their own.  A token sequence is the BPE encoding of its text
when every two neighbours are the encoding of theirs, so the result is then
exactly that of the whole run.

Defined cases: null is the empty text, with no tokens; special tokens written
in a text are encoded as the library does by default; rows that occur more
than once give a result each; extra columns pass through, one named like an
output column is replaced.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import is_text, outside, store

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = 1 << 15           # bytes without white space from which a run is cut
LEAF = 1 << 12           # symbols of a leaf that is a row
SPLIT, PART = 16, 8      # bytes from which a chunk is encoded in parts; symbols of a part
CACHE = 250_000          # chunks remembered per worker
FLUSH = 4 << 20
MADE = ["n_tokens", "ids", "decoded"]


class Codec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, models
        spec = json.load(open(path, encoding="utf-8"))
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        m = spec["model"]
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]]
        self.end = m["end_of_word_suffix"] or ""
        # the model inside a word (no end mark) and at its end
        self.inner, self.last = models.BPE(vocab=m["vocab"], merges=merges), self.whole.model
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.token = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        self.cache: dict[bytes, tuple[bytes, int, bytes]] = {}
        # byte-level symbols: printable bytes stand for themselves (fixed values), others follow from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.symbol = [chr(b) if b in own else chr(next(other)) for b in range(256)]

    def rendered(self, ids: list[int]) -> tuple[bytes, int, bytes]:
        return (" ".join(map(str, ids)).encode(), len(ids), " ".join([self.token[i] for i in ids]).encode())

    def plain(self, c: bytes) -> list[int] | None:
        """Ids of a chunk of Latin-1 letters with punctuation after them, which
        normalising only turns to lower case and splits in two; else None."""
        text = c.decode()
        word = text.rstrip(".,;:!?")
        if not word.isalpha() or max(word) > "ÿ":
            return None
        low = word.lower()
        parts = [low if low.isascii() else "".join([self.symbol[b] for b in low.encode()])]
        if len(word) < len(text):
            parts.append(text[len(word):])
        return [t.id for p in parts for t in self.last.tokenize(p)]

    def chunk(self, c: bytes) -> tuple[bytes, int, bytes]:
        """Decimal ids, their number and the decoded text of one chunk."""
        got = self.cache.get(c)
        if got is None:
            if len(c) > SPLIT:
                ids = self.parts(c)
            else:
                ids = self.plain(c)
                if ids is None:
                    ids = self.whole.encode(c.decode(), add_special_tokens=False).ids
            got = self.rendered(ids)
            if len(c) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[c] = got
        return got

    def text(self, t: bytes) -> tuple[bytes, int, bytes]:
        parts = [p for p in map(self.chunk, t.split()) if p[1]]
        return b" ".join([p[0] for p in parts]), sum([p[1] for p in parts]), b" ".join([p[2] for p in parts])

    # -- long runs

    def words(self, c: bytes):
        """The words the model sees of a chunk: an id, or a string of byte
        symbols."""
        rest, found = c.decode(), []
        while rest:
            at, s = min(((rest.find(s), s) for s in self.special if s in rest), default=(-1, ""))
            head, rest = (rest, "") if at < 0 else (rest[:at], rest[at + len(s):])
            head = self.whole.normalizer.normalize_str(head)
            found += [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(head)]
            if at >= 0:
                found.append(self.whole.token_to_id(s))
        return found

    def encode(self, symbols: str, ends: bool) -> list[int]:
        """Ids of a stretch of a word; ``ends``: it holds the word's end."""
        return [t.id for t in (self.last if ends else self.inner).tokenize(symbols)]

    def symbols(self, ids: list[int]) -> str:
        out = "".join([self.token[i] for i in ids])
        return out.removesuffix(self.end) if self.end and ids and self.token[ids[-1]].endswith(self.end) else out

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        """The encoding of both stretches as one."""
        k = 4
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            ends_here = ends and j == len(right)
            new = self.encode(self.symbols(left[i:] + right[:j]) if not ends_here else
                              self.symbols(left[i:]) + self.symbols(right[:j]), ends_here)
            if (i == 0 or new[0] == left[i]) and (j == len(right) or new[-1] == right[j - 1]):
                return left[:i] + new + right[j:]
            k *= 2

    def parts(self, c: bytes) -> list[int]:
        """The encoding of a chunk from those of its parts."""
        ids: list[int] = []
        for w in self.words(c):
            if isinstance(w, int):
                ids.append(w)
            else:
                size = PART if len(w) <= LEAF else LEAF
                ids += self.tree([self.encode(w[i:i + size], i + size >= len(w)) for i in range(0, len(w), size)])
        return ids

    def tree(self, leaves: list[list[int]]) -> list[int]:
        """Join leaves, halves by halves; the last one holds the word's end."""
        def up(lo, hi):
            if hi - lo == 1:
                return leaves[lo]
            mid = (lo + hi) // 2
            return self.join(up(lo, mid), up(mid, hi), hi == len(leaves))
        return up(0, len(leaves))


@lru_cache(1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Input columns other than ``text``, then n_tokens, ids (decimal, joined
    by one space) and decoded (their decoding, special tokens kept)."""
    rest = [c for c in outside(df, MADE) if c != text]
    src = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], is_text(text).alias("t"))
    kept = [f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]
    made = "n long, ids binary, decoded binary"
    as_text = F.col("t").cast("string")
    has_run = (F.octet_length("t") >= LONG) & as_text.rlike(f"[^ \\t-\\r]{{{LONG // 4}}}")

    def short(batches):
        code = codec(vocabulary)
        for b in batches:
            texts, size = b.column(len(rest)), 0
            first, got = 0, []
            for r, t in enumerate(texts):
                got.append(code.text(t.as_py()))
                size += len(got[-1][0]) + len(got[-1][2])
                if size > FLUSH or r == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(first, len(got)) for c in b.columns[:len(rest)]),
                         pa.array([g[1] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.binary()),
                         pa.array([g[2] for g in got], pa.binary())],
                        [*b.schema.names[:len(rest)], "n", "ids", "decoded"])
                    first, got, size = r + 1, [], 0

    # A text with long runs as rows: per word its number; a finished word has
    # its ids, a leaf of a long one the stretch still to be encoded.
    def cut(batches):
        code = codec(vocabulary)
        for b in batches:
            for r in range(b.num_rows):
                rows, word = [], 0
                for c in b.column(1)[r].as_py().split():
                    if len(c) < LONG // 4:
                        rows.append((word, 0, "", code.chunk(c)[0].decode()))
                        word += 1
                        continue
                    for w in code.words(c):
                        if isinstance(w, int):
                            rows.append((word, 0, "", str(w)))
                        elif len(w) <= LEAF:
                            rows.append((word, 0, "", " ".join(map(str, code.encode(w, True)))))
                        else:
                            rows += [(word, i, w[i:i + LEAF], "e" if i + LEAF >= len(w) else "i")
                                     for i in range(0, len(w), LEAF)]
                        word += 1
                for at in range(0, len(rows), 4096):
                    part = rows[at:at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column(0)[r].as_py()] * len(part), pa.int64()),
                         pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.int32()),
                         pa.array([x[2] for x in part]), pa.array([x[3] for x in part])],
                        ["row", "word", "at", "raw", "ids"])

    def leaf(batches):
        code = codec(vocabulary)
        for b in batches:
            raw, ids = b.column(3).to_pylist(), b.column(4).to_pylist()
            yield b.set_column(4, "ids", pa.array(
                [" ".join(map(str, code.encode(w, i == "e"))) if w else i for w, i in zip(raw, ids)], pa.string())
                ).set_column(3, "raw", pa.array([w[:0] for w in raw], pa.string()))

    def whole(key, t):
        code = codec(vocabulary)
        word, at, ids = t["word"].to_numpy(), t["at"].to_numpy(), t["ids"].to_pylist()
        order, out, i = np.lexsort((at, word)), [], 0
        while i < len(order):
            j = i
            while j < len(order) and word[order[j]] == word[order[i]]:
                j += 1
            out += code.tree([[int(x) for x in ids[k].split()] for k in order[i:j]])
            i = j
        got = code.rendered(out)
        return pa.table({"row": [key[0].as_py()], "n": pa.array([got[1]], pa.int64()),
                         "ids": pa.array([got[0]], pa.binary()), "decoded": pa.array([got[2]], pa.binary())})

    plain = src.where(~has_run).mapInArrow(short, ", ".join([*kept, made]))
    # read twice, so the row numbers are fixed by writing them
    runs = store(src.where(has_run).withColumn("row", F.monotonically_increasing_id()), "long-runs")
    leaves = runs.select("row", "t").mapInArrow(cut, "row long, word int, at int, raw string, ids string")
    found = (leaves.repartition("row", "word", "at").mapInArrow(leaf, "row long, word int, at int, raw string, ids string")
             .groupBy("row").applyInArrow(whole, f"row long, {made}"))
    names = [f"c{i}" for i in range(len(rest))]
    long = runs.select("row", *names).join(found, "row", "left").select(
        *names, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ids", F.lit(b"")).alias("ids"),
        F.coalesce("decoded", F.lit(b"")).alias("decoded"))
    both = plain.unionByName(long)
    return both.select(*names, "n", F.col("ids").cast("string").alias("ids"),
                       F.col("decoded").cast("string").alias("decoded")).toDF(*rest, *MADE)


def decode(df: DataFrame, ids: str = "ids", vocabulary: str = VOCABULARY, out: str = "decoded") -> DataFrame:
    """Input columns and the text of the decimal ids in ``ids`` (null: null)."""
    rest = outside(df, [out])
    src = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.col(ids).alias("i"))

    def run(batches):
        token = codec(vocabulary).token
        for b in batches:
            texts = [None if x is None else " ".join([token[int(i)] for i in x.split()])
                     for x in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(rest)], pa.array(texts, pa.string())],
                                             [*b.schema.names[:len(rest)], "d"])

    kinds = ", ".join([f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)] + ["d string"])
    return src.mapInArrow(run, kinds).toDF(*rest, out)


def op9_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
                               F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
