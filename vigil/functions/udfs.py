"""The two Python helpers the engine needs (Arrow-batched).

Both run only on rows a JVM filter already selected (P3 hits, files whose
content matches an obfuscation pattern), so they never see the bulk of the
data.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import packs as R


@F.pandas_udf(T.StringType())
def unicode_escape_evidence(lines: pd.Series) -> pd.Series:
    """``Decoded: <line decoded as unicode_escape, stripped, 80 chars>``;
    null when Python cannot decode (caller keeps the count text)."""
    def one(s):
        if s is None:
            return None
        try:
            return "Decoded: " + s.encode().decode("unicode_escape").strip()[:80]
        except Exception:
            return None
    return lines.map(one)


_JS = [re.compile(p, re.ASCII) for p, _ in R.JS_OBFUSCATION_PATTERNS]
_PY = [re.compile(p, re.ASCII) for p, _ in R.PY_OBFUSCATION_PATTERNS]
MATCHES = "package_id string, path string, idx int, k long, line_no int, snippet string"
FLUSH_ROWS = 20_000


def obfuscation_matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """P9a over (package_id, path, content, is_js): every match of the file's
    language patterns, in pattern order: pattern index in the JS+PY list,
    ordinal, line of the match's start, snippet.  Line ends are found once per
    file; rows go out in bounded batches however many matches a file has."""
    cols = [c.split()[0] for c in MATCHES.split(", ")]
    rows: list[tuple] = []
    for batch in batches:
        for pkg, path, text, js in batch.itertuples(index=False):
            if text is None:
                continue
            ends = [m.start() for m in re.finditer("\n", text)]
            lines, n, first = text.splitlines(), 0, 0 if js else len(_JS)
            for j, rx in enumerate(_JS if js else _PY, first):
                for m in rx.finditer(text):
                    at = bisect_left(ends, m.start())
                    rows.append((pkg, path, j, n, at + 1, lines[at].strip()[:120] if at < len(lines) else ""))
                    n += 1
                    if len(rows) >= FLUSH_ROWS:
                        yield pd.DataFrame(rows, columns=cols)
                        rows = []
    yield pd.DataFrame(rows, columns=cols)
