"""Long rule packs: which rules can match a text at all, in one pass.

Every regex has literals one of which each match contains (``required_atoms``).
An Aho-Corasick automaton over the literals of all rules of a block reads a
text once and names the candidate rules; only those regexes run, in the JVM.
Rules without such literals are candidates everywhere.

A pack is read in blocks of bounded size, so neither the automaton nor the
broadcast rule table grows with it; a pack of several blocks costs a pass over
the texts each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import required_atoms

BLOCK_RULES, BLOCK_CHARS = 20_000, 8 << 20
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def atoms(pattern: str) -> list[str] | None:
    """ASCII-lower literals one of which is in the ASCII-lower text of every
    match, or None."""
    got = required_atoms(pattern)
    if got is None:
        return None
    # case pairs beyond ASCII differ between engines: only the ASCII part of a literal is asked for
    out = [max(re.split(r"[^\x00-\x7f]+", a.translate(_ASCII_LOWER)), key=len) for a in got[0]]
    return out if all(out) else None


def rows_of(section, columns: list[str], order: list[str]) -> Iterator[tuple]:
    """Rows of a pack section: an iterable of tuples as it comes, a DataFrame
    in ``order``, partition by partition."""
    if isinstance(section, DataFrame):
        for r in section.select(*columns).orderBy(*order).toLocalIterator():
            yield tuple(r)
    else:
        yield from section


def blocks(rules: Iterable[tuple[str, tuple]]) -> Iterator[list[tuple[int, str, tuple]]]:
    """Numbered (regex, row) rules in blocks of bounded size."""
    block, chars = [], 0
    for j, (rx, row) in enumerate(rules):
        if block and (len(block) >= BLOCK_RULES or chars + len(rx) > BLOCK_CHARS):
            yield block
            block, chars = [], 0
        block.append((j, rx, row))
        chars += len(rx)
    if block:
        yield block


def candidates(block: list[tuple[int, str, tuple]]):
    """Column function: text -> numbers of the block's rules that may match."""
    always, by_atom = [], {}
    for j, rx, _ in block:
        need = atoms(rx)
        for a in need or ():
            by_atom.setdefault(a, []).append(j)
        if need is None:
            always.append(j)
    kept: list = []

    def automaton():
        import ahocorasick
        if not kept:
            a = ahocorasick.Automaton()
            for word, js in by_atom.items():
                a.add_word(word, js)
            a.make_automaton()
            kept.append(a)
        return kept[0]

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        machine = automaton() if by_atom else None

        def one(text):
            if text is None:
                return []
            found = set(always)
            if machine is not None:
                low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")     # ASCII letters only
                for _, js in machine.iter(low):
                    found.update(js)
            return sorted(found)
        return texts.map(one)
    return run


class Gates:
    """Which of a few patterns may match a text, as bits of one long: every
    literal is looked for in one pass, instead of one search each.  A bit that is
    not set rules the pattern out; a pattern without a bit may match anywhere."""

    def __init__(self, patterns: Iterable[str]):
        need = {p: a for p in dict.fromkeys(patterns) if (a := atoms(p))}
        self.bit = {p: i for i, p in enumerate(list(need)[:63])}
        self.words: dict[str, int] = {}
        for p, i in self.bit.items():
            for a in need[p]:
                self.words[a] = self.words.get(a, 0) | 1 << i

    def bits(self, text: Column) -> Column:
        if not self.words:
            return F.lit(0).cast("long")
        words, kept = self.words, []

        @F.pandas_udf("long")
        def run(texts: pd.Series) -> pd.Series:
            import ahocorasick
            if not kept:
                a = ahocorasick.Automaton()
                for word, bits in words.items():
                    a.add_word(word, bits)
                a.make_automaton()
                kept.append(a)

            def one(text):
                found = 0
                if text is not None:            # bytes: lower() takes ASCII letters only, and any bytes are characters of latin-1
                    for _, bits in kept[0].iter(text.lower().decode("latin-1")):
                        found |= bits
                return found
            return pd.Series([one(t) for t in texts], dtype="int64")
        return run(text.cast("binary"))

    def open(self, bits: Column, pattern: str) -> Column | None:
        i = self.bit.get(pattern)
        return None if i is None else bits.bitwiseAND(F.lit(1 << i)) != 0

    def rlike(self, bits: Column, text: Column, pattern: str) -> Column:
        may = self.open(bits, pattern)
        return text.rlike(pattern) if may is None else may & text.rlike(pattern)

    def first_match(self, bits: Column, text: Column, patterns: list[str]) -> Column:
        """Position of the first pattern that matches ``text`` (or null)."""
        return F.coalesce(*[F.when(self.rlike(bits, text, p), F.lit(i)) for i, p in enumerate(patterns)])


def matches(df: DataFrame, text: str, rules: Iterable[tuple[str, tuple]], schema: str) -> DataFrame | None:
    """``df`` joined with every rule that matches its ``text``: the rule's
    number ``j``, regex ``rx`` and columns (``schema``).  Texts are not
    shuffled: a block of rules is broadcast, joined by number.  None for an
    empty pack."""
    out = None
    for block in blocks(rules):
        table = df.sparkSession.createDataFrame([(j, rx, *row) for j, rx, row in block], f"j long, rx string, {schema}")
        # explode_outer and a filter behind it: the texts are read once (see explode_hits)
        may = df.select("*", F.explode_outer(candidates(block)(F.col(text))).alias("j")).where("j IS NOT NULL")
        hits = may.join(F.broadcast(table), "j").where(F.regexp_like(F.col(text), F.col("rx")))
        out = hits if out is None else out.unionByName(hits)
    return out
