"""SRC13: Python source -> relational code-fact rows.

The only Python-side step of the code rules: each ``.py`` file is parsed with
the standard library's ``ast`` inside ``mapInPandas`` (Arrow batches, files
partitioned by Spark) and flattened into fact rows.  Every rule and the taint
analysis downstream are joins, windows and aggregates; source text is not
copied into facts (findings join the lines they need).

Fact kinds (one wide schema, ``kind`` column):

* ``call``  one per call node, breadth-first order ``seq``; callee dotted
  name, number of arguments, string values of the first two, and ``kws``:
  the keyword arguments with their constant or attribute values.
* ``arg``   a call argument that S8 may send (positional >= 1 or keyword).
* ``def``   one per plain-name assignment target; ``seq`` = def key.
* ``lit``   every string constant with its line.
* ``expr``  an expression to resolve: fallback mode and operands.
* ``leaf``  ordered external candidates of an expression (a source, or a
  name whose reaching definition may be external).
* ``parse_error``  a file that could not be parsed; ``name`` says why.

Nothing here recurses over the tree: an expression is walked with an explicit
stack, so a long chain of ``+`` costs memory, not stack.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import packs as R

MAX_KEY = (1 << 62)
TARGETS = 1 << 16        # def key = walk position * TARGETS + target number
FLUSH_ROWS = 20_000

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
FACTS = T.StructType([T.StructField(n, t) for n, t in [
    ("package_id", _S), ("path", _S), ("kind", _S), ("seq", _L), ("line", _I), ("name", _S), ("attr", _S),
    ("n_args", _I), ("arg0_str", _S), ("arg1_str", _S), ("arg0_expr", _L),
    ("kws", T.ArrayType(T.StructType([T.StructField("name", _S), T.StructField("text", _S), T.StructField("attr", _S),
                                      T.StructField("is_true", _B)]))),
    ("expr", _L), ("pos", _I), ("kw", _S), ("emode", _S),
    ("operands", T.ArrayType(T.StructType([T.StructField("okind", _S), T.StructField("oname", _S)]))),
    ("use_key", _L), ("ord", _I), ("lkind", _S), ("src_type", _S), ("src_desc", _S)]])
COLS = [f.name for f in FACTS.fields]

_SOURCE_ATTRS = dict(R.SOURCE_ATTRIBUTES)


def dotted(node: ast.AST) -> str:
    """``a.b.c`` for a name or a chain of attributes; what stands left of a
    chain that does not start at a name is left out."""
    tail = ""
    while isinstance(node, ast.Attribute):
        tail = f".{node.attr}{tail}"
        node = node.value
    return node.id + tail if isinstance(node, ast.Name) else tail[1:]


def _callee(call: ast.Call) -> str:
    return dotted(call.func) if isinstance(call.func, (ast.Name, ast.Attribute)) else ""


def _source_call(name: str) -> str | None:
    """Type of the first source function that ``name`` is, or ends like."""
    end = name.rsplit(".", 1)[-1] if "." in name else None
    return next((kind for full, kind in R.SOURCE_FUNCTIONS if name == full or end == full.rsplit(".", 1)[-1]), None)


def _text(node: ast.AST | None) -> str | None:
    value = node.value if isinstance(node, ast.Constant) else None
    return value if isinstance(value, str) else None


def _call_parts(call: ast.Call) -> list[ast.AST]:
    """What a call that is no source hands on: the object of a reading
    method, the arguments of ``format``."""
    if not isinstance(call.func, ast.Attribute):
        return []
    out = [call.func.value] if call.func.attr in R.PROPAGATING_METHODS else []
    if call.func.attr == "format":
        out += [*call.args, *(k.value for k in call.keywords)]
    return out


# node type -> the parts whose taint it takes over, in order
_PARTS = {
    ast.JoinedStr: lambda n: [v.value for v in n.values if isinstance(v, ast.FormattedValue)],
    ast.BinOp: lambda n: [n.left, n.right] if isinstance(n.op, ast.Add) else [],
    ast.Subscript: lambda n: [n.value],
    ast.Attribute: lambda n: [n.value],
    ast.Call: _call_parts,
    ast.List: lambda n: n.elts,
    ast.Tuple: lambda n: n.elts,
    ast.Set: lambda n: n.elts,
    ast.Dict: lambda n: [v for v in n.values if v is not None],
}
_LITERAL = (ast.Constant, ast.JoinedStr, ast.List, ast.Tuple, ast.Set, ast.Dict)


def _origin(node: ast.AST) -> tuple[str, str] | None:
    """(type, description) if the node itself is an external source."""
    if isinstance(node, ast.Attribute):
        name = dotted(node)
        return (_SOURCE_ATTRS[name], name) if name in _SOURCE_ATTRS else None
    if isinstance(node, ast.Call):
        name = _callee(node)
        kind = _source_call(name)
        return (kind, f"{name}()") if kind else None
    return None


def candidates(node: ast.AST) -> list[tuple[str, str | None, str | None, str | None]]:
    """Sources and names below ``node``, in evaluation order."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        origin = _origin(n)
        if origin:
            out.append(("source", None, *origin))
        elif isinstance(n, ast.Name):
            out.append(("name", n.id, None, None))
        else:
            todo.extend(reversed(_PARTS.get(type(n), lambda _: [])(n)))
    return out


def _bare(node: ast.AST) -> ast.AST:
    """Without subscripts and attribute accesses, which keep the level."""
    while isinstance(node, (ast.Subscript, ast.Attribute)) and not _origin(node):
        node = node.value
    return node


def _is_sum(node: ast.AST) -> bool:
    return isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add)


def fallback(node: ast.AST) -> tuple[str, list[tuple[str, str | None]]]:
    """Level of an expression without an external candidate: mode, operands."""
    node = _bare(node)
    mode = ("add" if _is_sum(node) else "pass_name" if isinstance(node, ast.Name)
            else "literal" if isinstance(node, _LITERAL) else "unknown")
    operands, todo = [], [node]
    while todo:
        n = _bare(todo.pop())
        if _is_sum(n):
            todo += [n.right, n.left]
        else:
            operands.append(("name", n.id) if isinstance(n, ast.Name)
                            else ("lit", None) if isinstance(n, _LITERAL) else ("unk", None))
    return mode, operands


def file_facts(pkg: str, path: str, source: str) -> Iterator[dict]:
    """Fact rows of one file."""
    def row(kind, **values):
        return dict.fromkeys(COLS) | {"package_id": pkg, "path": path, "kind": kind} | values

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        yield row("parse_error", name=type(e).__name__)
        return
    pending: list[dict] = []
    n_exprs = 0

    def resolve(node, use_key):
        nonlocal n_exprs
        mode, operands = fallback(node)
        pending.append(row("expr", expr=n_exprs, emode=mode, use_key=use_key,
                           operands=[{"okind": k, "oname": n} for k, n in operands]))
        pending.extend(row("leaf", expr=n_exprs, ord=i, lkind=k, name=n, src_type=t, src_desc=d, use_key=use_key)
                       for i, (k, n, t, d) in enumerate(candidates(node)))
        n_exprs += 1
        return n_exprs - 1

    for seq, node in enumerate(ast.walk(tree)):
        if isinstance(node, (ast.Assign, ast.AnnAssign)) and node.value is not None:
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            for j, target in enumerate(targets):
                if isinstance(target, ast.Name):
                    key = seq * TARGETS + j
                    yield row("def", seq=key, name=target.id, line=node.lineno, expr=resolve(node.value, key))
        elif isinstance(node, ast.Call) and (name := _callee(node)):
            first, second = (node.args + [None, None])[:2]
            yield row("call", seq=seq, line=node.lineno, name=name, n_args=len(node.args), arg0_str=_text(first),
                      attr=node.func.attr if isinstance(node.func, ast.Attribute) else None, arg1_str=_text(second),
                      arg0_expr=None if first is None else resolve(first, MAX_KEY),
                      kws=[{"name": k.arg, "text": _text(k.value),
                            "attr": k.value.attr if isinstance(k.value, ast.Attribute) else None,
                            "is_true": isinstance(k.value, ast.Constant) and k.value.value is True}
                           for k in node.keywords])
            for k in node.keywords:
                if k.arg in R.SEND_KEYWORDS:
                    yield row("arg", seq=seq, kw=k.arg, pos=-1, expr=resolve(k.value, MAX_KEY))
            for i, a in enumerate(node.args[1:], 1):
                yield row("arg", seq=seq, pos=i, expr=resolve(a, MAX_KEY))
        elif (value := _text(node)) is not None:
            yield row("lit", seq=seq, line=node.lineno, name=value)
        yield from pending
        pending.clear()


def _map(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[dict] = []
    for pdf in batches:
        for pkg, path, content in zip(pdf["package_id"], pdf["path"], pdf["content"]):
            for fact in file_facts(pkg, path, content or ""):
                held.append(fact)
                if len(held) >= FLUSH_ROWS:
                    yield pd.DataFrame(held, columns=COLS)
                    held = []
    yield pd.DataFrame(held, columns=COLS)


def code_facts(files: DataFrame) -> DataFrame:
    """Fact rows for every ``.py`` file of ``files`` (already SRC1-filtered)."""
    py = files.where(F.col("path").endswith(".py")).select("package_id", "path", "content")
    return py.mapInPandas(_map, FACTS)
