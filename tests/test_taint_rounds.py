"""Values of definitions are resolved by the rounds alone, and only what still moves is composed."""
from pyspark.sql import functions as F

from vigil.operators import taint


def test_values_are_resolved_by_the_rounds(spark, make_files, monkeypatch):
    from vigil.sources.code_facts import MAX_KEY, code_facts
    n = 60
    text = "import os\nv0 = os.getenv('A')\n" + "".join(f"v{i} = v{i - 1}\n" for i in range(1, n)) + f"w = 1\nos.system(v{n - 1})\n"
    evaluated, moved = [], []
    evaluate, compose = taint._evaluate, taint._compose
    monkeypatch.setattr(taint, "_evaluate", lambda e, *a: evaluated.append(e) or evaluate(e, *a))
    monkeypatch.setattr(taint, "_compose", lambda m, w: moved.append(m.count()) or compose(m, w))
    facts = code_facts(make_files({"a.py": text})).checkpoint()
    state, resolved = taint.propagate_taint(facts)
    assert {r.level for r in state.collect()} == {"external", "literal"}
    assert evaluated[0].where(F.col("use_key") < MAX_KEY).count() == 0
    assert moved == sorted(moved, reverse=True) and moved[-1] < moved[0]
    exprs = facts.where("kind = 'expr'").select("package_id", "path", "expr")
    assert resolved.count() == exprs.count() == exprs.join(resolved, ["package_id", "path", "expr"]).count()
    assert resolved.where("level = 'external'").count() == n + 1      # every v, and what system is given
