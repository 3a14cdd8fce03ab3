"""Toxicity by a weighted finite-state pattern grammar.

Four small transducers read the word classes of a clause: insult, threat,
target, and the two that soften, negation and reported speech.  Their
composition (:func:`compose`) is one automaton over clauses; its output for a
clause with an insult or a threat says what was matched, whether it is aimed
at somebody, negated, or reported.  A text's features are its matched clauses
by kind, with the weight of the strongest lexical atom; isolated words
outside a matched clause score nothing.

The terminals of insult and threat are a fixed seed of plain words in four
languages, and words and word beginnings learned from labelled rows.  Lexicon
and feature weights are fitted on a sample of labelled rows whose expected
bound is ``sample_rows`` for each label, taken by a hash of the text, whole;
everything else reads all rows.  Labels are the only other input.  Of sampled
rows that share their four smallest word hashes by any of ``LOOKS`` hash
functions (near copies) one is used, so that a document's copies do not make
its words look common.

Defined cases: null and empty texts have no clause and score what such texts
score; without labels of both kinds the seed and fixed weights are used;
repeated rows score alike; extra columns pass through, one named like an
output column is replaced; of several labels of an id the highest counts.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import crc32_mod, outside, store

MADE = ["score", "predicted"]
# Seed terminals (plain words, not learned).
INSULTS = ("idiot idiots stupid moron morons scum loser losers trash pathetic worthless disgusting imbecile "
           "idioten dumm dummkopf abschaum versager arschloch widerlich wertlos "
           "idiote imbécile crétin ordure minable stupide "
           "idiota idiotas estúpido estúpida imbécil basura escoria patético").split()
THREATS = ("kill murder destroy hurt strangle töten umbringen vernichten tuer détruire assassiner "
           "matar destruir asesinar").split()
TARGETS = frozenset(("you your yours u thou he she they him her them his their this that these those people "
                     "du dich dir dein deine ihr euch er sie sein seine tu te toi ton vous votre il elle ils "
                     "tú ti usted ustedes vosotros él ella ellos su sus").split())
NEGATIONS = frozenset(("not never no don't doesn't isn't aren't won't cannot can't nicht kein keine nie niemals "
                       "ne pas jamais aucun nunca tampoco").split())
REPORTS = frozenset(("said says say told wrote writes called claims claimed quoted reported sagte sagt schrieb "
                     "nannte behauptet dit disait écrit appelait dijo dice escribió llamó").split())
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[\"“”«»]")
BEGINNINGS = (4, 5, 6)
LOOKS = 3            # a changed word of n breaks one look of a near copy with a chance of about 8/n


# ------------------------------------------------------------- transducers
# A transducer is (start, step); step(state, symbol) gives the next state and
# an output set.  Symbols are "I" insult, "V" threat, "T" target, "N"
# negation, "R" reported speech, "Q" quotation mark, "-" any other word.


def marker(symbol: str, reach: int):
    """Says "seen" for ``reach`` words after ``symbol`` (0: to the end of the
    clause)."""
    def step(left, s):
        if s == symbol:
            left = reach or -1
        elif left > 0:
            left -= 1
        return left, left != 0
    return 0, step


def reported():
    """Reported speech: after a verb of saying, or inside quotation marks."""
    def step(state, s):
        said, quoted = state
        if s == "Q":
            quoted = not quoted
        return (said or s == "R", quoted), said or s == "R" or quoted
    return (False, False), step


def core():
    """Matches an insult (1) or a threat (2)."""
    def step(state, s):
        return state, {"I": 1, "V": 2}.get(s, 0)
    return 0, step


def compose(*parts):
    """All transducers read the same clause; states and outputs are tuples.
    Steps are computed once for each state and symbol."""
    start, table = tuple(p[0] for p in parts), {}

    def step(state, s):
        got = table.get((state, s))
        if got is None:
            both = [p[1](q, s) for p, q in zip(parts, state)]
            got = table[state, s] = (tuple(x[0] for x in both), tuple(x[1] for x in both))
        return got
    return start, step


KINDS = 16          # (insult, threat) x aimed x negated x reported


class Grammar:
    def __init__(self, atoms: dict[str, float], beginnings: dict[str, float]):
        self.atoms, self.beginnings = atoms, beginnings
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def lexical(self, word: str) -> float:
        w = self.atoms.get(word, 0.0)
        for n in BEGINNINGS:
            if len(word) >= n:
                w = max(w, self.beginnings.get(word[:n], 0.0))
        return w

    def _prepare(self):
        find = ahocorasick.Automaton()
        for a in {*self.atoms, *self.beginnings, *THREATS}:
            find.add_word(a, a)
        find.make_automaton()
        self._threats = frozenset(THREATS)
        # aimed: a target before or, read backwards, after the match
        self._ready = find, compose(core(), marker("T", 6), marker("N", 3), reported()), compose(core(), marker("T", 6))

    def _class(self, w: str) -> str:
        if w in self._threats:
            return "V"
        if self.lexical(w):
            return "I"
        return "T" if w in TARGETS else "N" if w in NEGATIONS else "R" if w in REPORTS else \
            "Q" if w in "\"“”«»" else "-"

    def features(self, text: str | None) -> np.ndarray:
        """Counts of matched clauses by kind (log), strongest atom, and
        whether anything matched."""
        out = np.zeros(KINDS + 2)
        if not text:
            return out
        if self._ready is None:
            self._prepare()
        find, forward, backward = self._ready
        low = text.lower()
        at = [end for end, _ in find.iter(low)] if len(find) else []
        if not at:
            return out
        done = -1
        for end in at:
            if end < done:
                continue
            begin = _clause_start(low, max(done, 0), end)
            stop = CLAUSE.search(low, end)
            done = stop.start() if stop else len(low)
            words = WORD.findall(low, begin, done)
            classes = [self._class(w) for w in words]
            if "I" not in classes and "V" not in classes:
                continue
            after = [False] * len(words)
            state = backward[0]
            for i in range(len(words) - 1, -1, -1):
                state, (_, after[i]) = backward[1](state, classes[i])
            state = forward[0]
            kinds = set()
            for i, s in enumerate(classes):
                state, (what, before, negated, said) = forward[1](state, s)
                if what:
                    kinds.add((what - 1) * 8 + (before or after[i]) * 4 + bool(negated) * 2 + bool(said))
                    out[KINDS] = max(out[KINDS], self.lexical(words[i]) or 1.0)
            for k in kinds:
                out[k] += 1
        out[KINDS + 1] = float(out[:KINDS].sum() > 0)
        out[:KINDS] = np.log1p(out[:KINDS])
        return out


def _clause_start(text: str, first: int, end: int) -> int:
    """Start of the clause around ``end``; the clause before it ended at
    ``first``, so no more of the text is searched."""
    return max(first, max(text.rfind(c, first, end) for c in ".!?;:\n") + 1)


SEED_WEIGHTS = np.array([1.5, .5, .5, .2, 2.5, 1, 1, .4, 1, .3, .3, .1, 2, .8, .8, .3, .5, 1.0])
SEED_BIAS = -3.0


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, drawn towards the grammar's own
    weights: few labels leave the order of its clause kinds as it is."""
    z = np.hstack([x, np.ones((len(x), 1))])
    prior = np.append(SEED_WEIGHTS, SEED_BIAS)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - ridge * len(y) * np.append((w - prior)[:-1], 0)
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(np.append(np.full(len(w) - 1, ridge * len(y)), 1e-6))
        step = np.linalg.solve(h, g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


class Model:
    def __init__(self, grammar: Grammar, weights: np.ndarray, bias: float):
        self.grammar, self.weights, self.bias = grammar, weights, bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.grammar.features(text) @ self.weights + self.bias, -30, 30))))


def _look(salt: int) -> Column:
    """Hash of the four smallest hashes of the distinct words ``w``."""
    hashes = F.transform("w", lambda x: F.xxhash64(F.lit(salt), x))
    return F.xxhash64(F.slice(F.array_sort(hashes), 1, 4))


def learn(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text",
          sample_rows: int = 6000) -> Model:
    """Lexicon and weights from labelled rows where ``train`` holds."""
    known = (labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & train)
             .groupBy(id_col).agg(F.max(F.col("toxic").cast("int")).alias("y")))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    seed = Grammar({**{a: 1.0 for a in INSULTS}}, {})
    if not sizes.get(0) or not sizes.get(1):
        return Model(seed, SEED_WEIGHTS, SEED_BIAS)
    scale = 1 << 30
    share = {y: int(min(1.0, sample_rows / n) * scale) for y, n in sizes.items()}
    picked = known.where(F.pmod(F.xxhash64(id_col), F.lit(scale)) <
                         F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    sample = (docs.where(F.col(text).isNotNull()).select(id_col, text)
              .join(F.broadcast(picked), id_col).select(F.col(text).alias("t"), "y")
              .select("t", "y", F.array_distinct(F.split("t", r"\s+")).alias("w"))
              .select("t", "y", F.xxhash64("t").alias("h"), *[_look(k).alias(f"look{k}") for k in range(LOOKS)]))
    for k in range(LOOKS):
        rest = F.struct(*[c for c in sample.columns if c not in (f"look{k}", "y")])
        sample = sample.groupBy(f"look{k}", "y").agg(F.min_by(rest, "h").alias("one")).select("y", "one.*")
    sample = store(sample.select("t", "y"), "toxic-sample", 40 * sample_rows)

    def atoms(batches):
        n: Counter = Counter()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = set(WORD.findall(t.lower()))
                for w in words:
                    n["=" + w, y] += 1
                for a in {w[:k] for w in words for k in BEGINNINGS if len(w) > k}:
                    n[a, y] += 1
        keys = list(n)
        for at in range(0, len(keys), 50_000):
            part = keys[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in part]), pa.array([n[k] if k[1] == 1 else 0 for k in part], pa.int64()),
                 pa.array([n[k] if k[1] == 0 else 0 for k in part], pa.int64())], ["atom", "bad", "good"])

    total = sample.agg(F.sum("y"), F.count("*")).first()
    bad_rows, good_rows = float(total[0] or 0), float(total[1] - (total[0] or 0))
    if not bad_rows or not good_rows:
        return Model(seed, SEED_WEIGHTS, SEED_BIAS)
    least = max(5.0, 0.015 * bad_rows)
    ratio = (F.col("bad") + 0.5) / (bad_rows + 1) / ((F.col("good") + 0.5) / (good_rows + 1))
    lexicon = (sample.mapInArrow(atoms, "atom string, bad long, good long").groupBy("atom")
               .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
               .where((F.col("bad") >= least) & (F.col("good") <= 0.02 * F.col("bad")))
               .select("atom", F.log(ratio).alias("w")).where("w > 1.5").collect())    # each is in 1.5 % of the toxic sample
    words = {a: 1.0 for a in INSULTS} | {r[0][1:]: r[1] for r in lexicon if r[0][0] == "="}
    grammar = Grammar(words, {r[0]: r[1] for r in lexicon if r[0][0] != "="})

    def read(batches):
        for b in batches:
            x = [grammar.features(t).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    rows = sample.mapInArrow(read, "x array<double>, y int").collect()      # at most the sample's bound
    weights, bias = _fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float))
    return Model(grammar, weights, bias)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Input columns, then score and predicted."""
    rest = outside(df, MADE)
    src = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.col(text).alias("t"))

    def run(batches):
        for b in batches:
            p = [model.score(t) for t in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(rest)], pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())],
                [*b.schema.names[:len(rest)], *MADE])

    kinds = ", ".join([f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(rest)]
                      + ["score double", "predicted int"])
    return src.mapInArrow(run, kinds).toDF(*rest, *MADE)


def op5_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = crc32_mod("doc_id", 5)
    model = learn(docs, labels, fold != 0)
    return (score(docs.select("doc_id", "text", (fold == 0).alias("held_out")), model)
            .select("doc_id", "held_out", "score", "predicted"))
