"""T1 reaching definitions and T2 taint propagation over code facts.

T1 is an as-of lookup: definitions and uses of a name in one file are merged by
key, and each use takes the last definition before it (a use at key k never
sees the definition made at k itself).  The merge runs in ranges of keys, so a
name used very often is many small sorts; a use with no definition in its own
range takes what the ranges before it carry.

T2 resolves definitions with joins.  A definition's state is the resolution of
its value expression: the FIRST external candidate in order (a source, or a
name whose reaching definition is external) gives level ``external`` with that
source's type and description; otherwise the fallback level (literal / unknown /
the referenced name's level / ``+`` of operands: literal only if all are).
Dependencies always point to lower keys.  Each round looks only at definitions
still open: those whose inputs are known are settled; those that wait for one
other definition are functions of its state, and chains of such functions are
composed by pointer doubling, so a chain costs the logarithm of its length; only
definitions that wait for several others need another round.  Rounds are
checkpointed to the shared checkpoint folder to cut lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.code_facts import MAX_KEY

FILE = ["package_id", "path"]
PLACE = ["path", "package_id"]   # in keys: rows are sorted by what tells them apart first


def _last_kw(name: str, value) -> Column:
    """``value`` of the last keyword argument ``name`` that has one."""
    got = F.filter(F.transform(F.filter("kws", lambda k: k["name"] == name), value), lambda v: v.isNotNull())
    return F.get(got, F.size(got) - 1)


def _call_modes() -> list[Column]:
    """shell_true, the mode a file is opened with, and yaml's Loader."""
    shell = F.coalesce(F.exists("kws", lambda k: (k["name"] == "shell") & k["is_true"]), F.lit(False))
    mode = F.coalesce(_last_kw("mode", lambda k: F.nullif(k["text"], F.lit(""))), F.nullif("arg1_str", F.lit("")),
                      F.lit("r"))
    loader = _last_kw("Loader", lambda k: F.coalesce(k["attr"], k["text"], F.lit("")))
    return [shell.alias("shell_true"), mode.alias("mode"), loader.alias("loader")]


def split_facts(facts: DataFrame) -> dict[str, DataFrame]:
    k = F.col("kind")
    return {
        "defs": facts.where(k == "def").select(*FILE, F.col("seq").alias("def_key"), "name", "expr", "line"),
        "exprs": facts.where(k == "expr").select(*FILE, "expr", "emode", "operands", "use_key"),
        "leaves": facts.where(k == "leaf").select(*FILE, "expr", "ord", "lkind", "name", "src_type", "src_desc",
                                                  "use_key"),
        "calls": facts.where(k == "call").select(*FILE, "seq", "line", "name", "attr", "n_args", "arg0_str", "arg0_expr",
                                                 *_call_modes()),
        "args": facts.where(k == "arg").select(*FILE, "seq", "pos", "kw", "expr"),
        "lits": facts.where(k == "lit").select(*FILE, "seq", "line", F.col("name").alias("value")),
    }


def name_refs(exprs: DataFrame, leaves: DataFrame) -> DataFrame:
    """Every (file, name, use_key) that needs a reaching definition."""
    a = leaves.where(F.col("lkind") == "name").select(*FILE, "name", "use_key")
    b = exprs.select(*FILE, "use_key", F.explode("operands").alias("o")) \
        .where(F.col("o.okind") == "name").select(*FILE, F.col("o.oname").alias("name"), "use_key")
    return a.unionByName(b).distinct()


KEY_RANGE = 4096 << 16   # keys merged in one sort: those of 4,096 statements, which are 65,536 apart


def reaching_defs(defs: DataFrame, refs: DataFrame) -> DataFrame:
    """(file, name, use_key) -> def_key of the last definition with a
    smaller key (null when the name was never assigned before)."""
    d = defs.select(*FILE, "name", F.col("def_key").alias("key"), F.lit(1).alias("is_def"),
                    F.col("def_key").alias("dk"))
    u = refs.select(*FILE, "name", F.col("use_key").alias("key"), F.lit(0).alias("is_def"),
                    F.lit(None).cast("long").alias("dk"))
    part = [*PLACE, "name", "part"]
    every = d.unionByName(u).withColumn("part", F.floor(F.col("key") / KEY_RANGE))
    inside = Window.partitionBy(*part).orderBy("key", "is_def").rowsBetween(Window.unboundedPreceding, 0)
    # the last definition of each range, carried to the ranges after it (keys rise, so the last is the largest)
    before = Window.partitionBy(*PLACE, "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (every.groupBy(*part).agg(F.max("dk").alias("dk")).withColumn("carried", F.max("dk").over(before))
               .where("carried IS NOT NULL").select(*part, "carried"))
    return (every.withColumn("reach", F.last("dk", ignorenulls=True).over(inside)).where("is_def = 0")
            .join(carried, part, "left")
            .select(*FILE, "name", F.col("key").alias("use_key"), F.coalesce("reach", "carried").alias("reach")))


def _with_reach(exprs: DataFrame, leaves: DataFrame, reach: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves and operands joined to their reaching definition.  Static
    across fixpoint rounds, so computed (and materialised) once."""
    lr = leaves.join(reach, ["use_key", "path", "name", "package_id"], "left") \
        .select(*FILE, "expr", "ord", "lkind", "src_type", "src_desc", "reach")
    ops = exprs.select(*FILE, "expr", "use_key", F.posexplode("operands").alias("oi", "o")) \
        .select(*FILE, "expr", "use_key", "oi", F.col("o.okind").alias("okind"), F.col("o.oname").alias("name"))
    orr = ops.join(reach, ["use_key", "path", "name", "package_id"], "left").select(*FILE, "expr", "oi", "okind", "reach")
    return lr, orr


def _evaluate(exprs: DataFrame, lr: DataFrame, orr: DataFrame, state: DataFrame) -> DataFrame:
    """Resolve ``exprs`` against the current definition ``state``:
    (file, expr) -> level, src_type, src_desc.  ``lr`` / ``orr`` are the
    leaves / operands with their reaching definition (``_with_reach``)."""
    st = state.select(*FILE, F.col("def_key").alias("reach"), F.col("level").alias("s_level"),
                      F.col("src_type").alias("s_type"), F.col("src_desc").alias("s_desc"))
    lv = lr.join(st, ["reach", *PLACE], "left")
    is_ext = (F.col("lkind") == "source") | ((F.col("lkind") == "name") & (F.col("s_level") == "external"))
    first_ext = lv.where(is_ext).groupBy("expr", *PLACE).agg(F.min(F.struct(
        "ord", F.when(F.col("lkind") == "source", F.col("src_type")).otherwise(F.col("s_type")).alias("t"),
        F.when(F.col("lkind") == "source", F.col("src_desc")).otherwise(F.col("s_desc")).alias("d"))).alias("x"))
    ov = orr.join(st, ["reach", *PLACE], "left")
    # a name with no reaching definition is UNKNOWN, never literal (null must not be skipped by bool_and)
    op_lit = F.coalesce((F.col("okind") == "lit") | ((F.col("okind") == "name") & (F.col("s_level") == "literal")),
                        F.lit(False))
    op_agg = ov.groupBy("expr", *PLACE).agg(
        F.bool_and(op_lit).alias("all_lit"),
        F.min(F.struct("oi", F.when(F.col("okind") == "name", F.coalesce("s_level", F.lit("unknown")))
                       .alias("lvl")))["lvl"].alias("name_lvl"))
    fallback = (F.when(F.col("emode") == "literal", "literal").when(F.col("emode") == "unknown", "unknown")
                .when(F.col("emode") == "pass_name", F.coalesce("name_lvl", F.lit("unknown")))
                .when(F.col("all_lit"), "literal").otherwise("internal"))
    j = exprs.join(first_ext, ["expr", *PLACE], "left").join(op_agg, ["expr", *PLACE], "left")
    ext = F.col("x").isNotNull()
    return j.select(*FILE, "expr", F.when(ext, F.lit("external")).otherwise(fallback).alias("level"),
                    F.when(ext, F.col("x.t")).alias("src_type"), F.when(ext, F.col("x.d")).alias("src_desc"))


DEF = ["def_key", *PLACE]
STATE = ["level", "src_type", "src_desc"]


def _look(pending: DataFrame, leaves: DataFrame, operands: DataFrame, final: DataFrame) -> DataFrame:
    """Open definitions against the settled ones: their state where it is
    known, else ``dep``, the one definition they wait for (null: several), with
    the level that follows from each level of it (``if_*``; an external one
    passes through) and the source that applies unless it is external."""
    st = final.select(*FILE, F.col("def_key").alias("reach"), F.col("level").alias("s_level"),
                      F.col("src_type").alias("s_type"), F.col("src_desc").alias("s_desc"))
    source = F.col("lkind") == "source"
    external = source | (F.col("s_level") == "external")
    waits = (F.col("lkind") == "name") & F.col("reach").isNotNull() & F.col("s_level").isNull()
    lv = leaves.join(st, ["reach", *PLACE], "left").groupBy(*DEF).agg(
        F.min(F.when(external, F.struct("ord", F.when(source, F.col("src_type")).otherwise(F.col("s_type")).alias("t"),
                                        F.when(source, F.col("src_desc")).otherwise(F.col("s_desc")).alias("d")))).alias("x"),
        F.min(F.when(waits, F.col("ord"))).alias("first_wait"),
        F.min(F.when(waits, F.col("reach"))).alias("r0"), F.max(F.when(waits, F.col("reach"))).alias("r1"))
    named = F.col("okind") == "name"
    open_ = named & F.col("reach").isNotNull() & F.col("s_level").isNull()
    # a name with no reaching definition is unknown, never literal (null must not be skipped by bool_and)
    lit = F.coalesce((F.col("okind") == "lit") | (named & (F.col("s_level") == "literal")), F.lit(False))
    ov = operands.join(st, ["reach", *PLACE], "left").groupBy(*DEF).agg(
        F.bool_and(lit | F.coalesce(open_, F.lit(False))).alias("others_lit"),
        F.min(F.struct("oi", F.when(named, F.coalesce("s_level", F.lit("unknown"))).alias("l")))["l"].alias("name_level"))
    mode, found = F.col("emode"), F.col("x").isNotNull()
    known = F.col("first_wait").isNull() | (found & (F.col("x.ord") < F.col("first_wait")))
    plain = (F.when(mode.isin("literal", "unknown"), mode)
             .when(mode == "pass_name", F.coalesce("name_level", F.lit("unknown")))
             .when(F.col("others_lit"), "literal").otherwise("internal"))

    def given(level):
        return (F.when(found, "external").when(mode.isin("literal", "unknown"), mode).when(mode == "pass_name", level)
                .when(F.col("others_lit") & F.lit(level == "literal"), "literal").otherwise("internal"))

    return pending.join(lv, DEF, "left").join(ov, DEF, "left").select(
        *DEF, "expr", "emode", F.when(known, F.when(found, "external").otherwise(plain)).alias("level"),
        F.when(found, F.col("x.t")).alias("src_type"), F.when(found, F.col("x.d")).alias("src_desc"),
        F.when(~known & (F.col("r0") == F.col("r1")), F.col("r0")).alias("dep"),
        *[given(v).alias(f"if_{v}") for v in ("literal", "unknown", "internal")])


def _after(level, prefix: str = ""):
    """Level that follows from a non-external ``level``."""
    return (F.when(level == "literal", F.col(prefix + "if_literal")).when(level == "unknown", F.col(prefix + "if_unknown"))
            .otherwise(F.col(prefix + "if_internal")))


def _compose(moving: DataFrame, waiting: DataFrame) -> DataFrame:
    """One doubling step: a definition of ``moving`` that waits for a waiting one
    waits for what that one waits for."""
    names = ["dep", "if_literal", "if_unknown", "if_internal", "src_type", "src_desc"]
    g = waiting.select(*FILE, F.col("def_key").alias("dep"), *[F.col(c).alias("g_" + c) for c in names])
    both = moving.join(g, ["dep", *PLACE], "left")
    moved, over = F.col("g_dep").isNotNull(), F.col("g_if_literal") == "external"     # g settles on its own source
    then = {v: F.when(~moved, F.col(f"if_{v}")).when(over, "external").otherwise(_after(F.col(f"g_if_{v}")))
            for v in ("literal", "unknown", "internal")}
    return both.select(
        *DEF, F.coalesce("g_dep", "dep").alias("dep"), *[c.alias(f"if_{v}") for v, c in then.items()],
        F.when(moved & over, F.col("g_src_type")).otherwise(F.col("src_type")).alias("src_type"),
        F.when(moved & over, F.col("g_src_desc")).otherwise(F.col("src_desc")).alias("src_desc"), moved.alias("moved"))


def propagate_taint(facts: DataFrame, max_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (definition state, resolution of every expression).

    Runs until every definition is settled (``max_rounds`` only for tests)."""
    parts = split_facts(facts)
    defs, exprs, leaves = parts["defs"], parts["exprs"], parts["leaves"]
    reach = reaching_defs(defs, name_refs(exprs, leaves)).checkpoint()
    # what is used at a definition's key is its value; all else is looked up behind the last statement
    late = F.col("use_key") >= MAX_KEY
    lr_val, or_val = _with_reach(exprs.where(~late), leaves.where(~late), reach)
    ids = defs.select(*FILE, "expr", "def_key")
    pending = ids.join(exprs.select(*FILE, "expr", "emode"), ["expr", *PLACE]).checkpoint()
    lr_def = lr_val.join(ids, ["expr", *PLACE]).checkpoint()
    or_def = or_val.join(ids, ["expr", *PLACE]).checkpoint()
    final = pending.limit(0).select(*DEF, "expr", *[F.lit(None).cast("string").alias(c) for c in STATE])
    rounds = 0
    while True:
        look = _look(pending, lr_def, or_def, final).checkpoint()
        done = look.where("level is not null").select(*DEF, "expr", *STATE)
        waiting = look.where("level is null and dep is not null").drop("expr", "emode", "level")
        # a definition that did not move waits for a settled or an open one: only the others go on
        moving, there = waiting, None
        while moving.limit(1).count():
            step = _compose(moving, waiting).checkpoint()
            moving, stays = step.where("moved").drop("moved"), step.where("NOT moved").drop("moved")
            there = stays if there is None else there.unionByName(stays)
            waiting = there.unionByName(moving)
        final = final.unionByName(done)
        base = final.select(*FILE, F.col("def_key").alias("dep"), F.col("level").alias("b_l"),
                            F.col("src_type").alias("b_t"), F.col("src_desc").alias("b_d"))
        out = F.col("b_l") == "external"
        level = F.when(out, "external").otherwise(_after(F.col("b_l")))
        settled = waiting.join(base, ["dep", *PLACE]).select(
            *DEF, level.alias("level"),
            F.when(out, F.col("b_t")).when(level == "external", F.col("src_type")).alias("src_type"),
            F.when(out, F.col("b_d")).when(level == "external", F.col("src_desc")).alias("src_desc"))
        settled = look.select(*DEF, "expr").join(settled, DEF).select(*DEF, "expr", *STATE)
        final = final.unionByName(settled).checkpoint()
        rounds += 1
        pending = look.where("level is null").select(*DEF, "expr", "emode").join(
            final.select(*DEF), DEF, "left_anti").checkpoint()
        if pending.limit(1).count() == 0 or (max_rounds is not None and rounds >= max_rounds):
            break
    # every S rule reads the resolution: materialise it once; that of a definition's value is the definition's state
    rest = exprs.where(late)
    found = _evaluate(rest, *_with_reach(rest, leaves.where(late), reach), final)
    resolved = final.select(*FILE, "expr", *STATE).unionByName(found).checkpoint()
    return final, resolved
