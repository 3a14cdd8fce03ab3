"""Code facts synthesised from the driver's ``events`` table.

Gives the taint machinery (T1 reaching definitions, T2 propagation) input
that grows with the data and that an SQL engine can check independently:
each user is one file ``u<user_id>.py``; each event is one assignment to
``v<event_id % 5>`` (definition key = event_id) whose right-hand side
depends on ``event_type``:

* ``view``     -> a constant                       (literal)
* ``click``    -> ``os.getenv(...)``               (external, env_var)
* ``error``    -> another name ``v<k>``           (pass-through)
* ``purchase`` -> ``v<k> + "..."``                 (add: literal only if v<k> is)
* ``signup``   -> ``v<k>.read()``                  (external propagates, else unknown)

with ``k = (3 * event_id + 1) % 5``.  Every file also reads each of its
names once at the end (a sink, use key = +inf).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .code_facts import COLS, FACTS, MAX_KEY  # noqa: F401

N_NAMES = 5
SINK_BASE = 1 << 40


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    pkg = F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"))
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".py"))
    name = F.concat(F.lit("v"), (F.col("event_id") % N_NAMES).cast("string"))
    ref = F.concat(F.lit("v"), ((F.col("event_id") * 3 + 1) % N_NAMES).cast("string"))
    t = F.col("event_type")
    base = ev.select(pkg.alias("package_id"), path.alias("path"), F.col("event_id"), name.alias("nm"),
                     ref.alias("ref"), F.col("event_type").alias("t"))
    t = F.col("t")

    def row(kind, **kw):
        cols = []
        for c in COLS:
            if c == "kind":
                cols.append(F.lit(kind).alias("kind"))
            elif c in kw:
                cols.append(kw[c].cast(FACTS[c].dataType).alias(c))
            elif c in ("package_id", "path"):
                cols.append(F.col(c))
            else:
                cols.append(F.lit(None).cast(FACTS[c].dataType).alias(c))
        return cols

    op = T.StructType([T.StructField("okind", T.StringType()), T.StructField("oname", T.StringType())])

    def opnd(k, n=None):
        return F.struct(F.lit(k).alias("okind"), (n if n is not None else F.lit(None)).cast("string").alias("oname"))

    mode = (F.when(t == "view", "literal").when(t == "click", "unknown").when(t == "error", "pass_name")
            .when(t == "purchase", "add").otherwise("unknown"))
    operands = (F.when(t == "view", F.array(opnd("lit"))).when(t == "click", F.array(opnd("unk")))
                .when(t == "error", F.array(opnd("name", F.col("ref"))))
                .when(t == "purchase", F.array(opnd("name", F.col("ref")), opnd("lit")))
                .otherwise(F.array(opnd("unk")))).cast(T.ArrayType(op))
    eid = F.col("event_id")
    defs = base.select(*row("def", seq=eid, name=F.col("nm"), line=eid, expr=eid))
    exprs = base.select(*row("expr", expr=eid, emode=mode, operands=operands, use_key=eid))
    src_leaf = base.where(t == "click").select(*row("leaf", expr=eid, ord=F.lit(0), lkind=F.lit("source"),
                                                    src_type=F.lit("env_var"), src_desc=F.lit("os.getenv()"),
                                                    use_key=eid))
    name_leaf = base.where(t.isin("error", "purchase", "signup")).select(
        *row("leaf", expr=eid, ord=F.lit(0), lkind=F.lit("name"), name=F.col("ref"), use_key=eid))
    files = base.select("package_id", "path").distinct()
    sinks = files.select("package_id", "path", F.explode(F.sequence(F.lit(0), F.lit(N_NAMES - 1))).alias("i"))
    sk = F.lit(SINK_BASE) + F.col("i")
    sname = F.concat(F.lit("v"), F.col("i").cast("string"))
    sink_expr = sinks.select(*row("expr", expr=sk, emode=F.lit("pass_name"),
                                  operands=F.array(F.struct(F.lit("name").alias("okind"), sname.alias("oname"))),
                                  use_key=F.lit(MAX_KEY)))
    sink_leaf = sinks.select(*row("leaf", expr=sk, ord=F.lit(0), lkind=F.lit("name"), name=sname,
                                  use_key=F.lit(MAX_KEY)))
    out = defs
    for p in (exprs, src_leaf, name_leaf, sink_expr, sink_leaf):
        out = out.unionByName(p)
    return out
