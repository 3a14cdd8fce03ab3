"""Taint levels of random programs against a plain sequential evaluation, and
chains far longer than any number of rounds."""
import random
import time

from conftest import rows
from vigil.operators.code_rules import code_findings, code_inputs


def program(rng, n):
    """(source lines, expected state of each assignment)."""
    env, lines, want = {}, [], []

    def operand():
        k = rng.random()
        if k < 0.25:
            return f'"{rng.randint(0, 9)}"', ("literal", None)
        if k < 0.33:
            return 'os.environ["A"]', ("external", "os.environ")
        if k < 0.4:
            return "sys.argv[1]", ("external", "sys.argv")
        if k < 0.5:
            return "make()", ("unknown", None)
        name = f"v{rng.randint(0, n // 3)}"
        return name, env.get(name, ("unknown", None))

    def first_external(states):
        return next((s for s in states if s[0] == "external"), None)

    for _ in range(n):
        target = f"v{rng.randint(0, n // 3)}"
        kind = rng.choice(["one", "one", "sum", "sum3", "fstring", "format", "list", "read", "item"])
        a, b, c = operand(), operand(), operand()
        if kind == "one":
            text, state = a
        elif kind in ("sum", "sum3"):
            parts = [a, b] if kind == "sum" else [a, b, c]
            text = " + ".join(p[0] for p in parts)
            states = [p[1] for p in parts]
            state = first_external(states) or (("literal" if all(s[0] == "literal" for s in states) else "internal"), None)
        elif kind == "fstring":
            text, state = "f'{%s}x{%s}'" % (a[0].replace('"', ""), b[0].replace('"', "")), None
            if '"' in a[0] or '"' in b[0]:
                text, state = a
            else:
                state = first_external([a[1], b[1]]) or ("literal", None)
        elif kind == "format":
            text, state = f'"t".format({a[0]}, z={b[0]})', first_external([a[1], b[1]]) or ("unknown", None)
        elif kind == "list":
            text, state = f"[{a[0]}, {b[0]}]", first_external([a[1], b[1]]) or ("literal", None)
        elif kind == "read":
            text, state = f"({a[0]}).read()", first_external([a[1]]) or ("unknown", None)
        else:
            text, state = f"({a[0]})[0]", a[1]
        lines.append(f"{target} = {text}")
        want.append(state)
        env[target] = state
    return lines, want


def test_random_programs(make_files):
    rng = random.Random(17)
    files, want = {}, {}
    for f in range(25):
        lines, states = program(rng, 40)
        files[f"f{f}.py"] = "\n".join(lines) + "\n"
        want[f"f{f}.py"] = states
    state = code_inputs(make_files(files))["state"].select("path", "def_key", "level", "src_desc")
    got = {}
    for path, key, level, desc in sorted(rows(state, "path", "def_key", "level", "src_desc")):
        got.setdefault(path, []).append((level, desc))
    assert got == want


def test_long_chains(make_files):
    began = time.time()
    n = 3000
    copy = "import os\nv0 = os.getenv('A')\n" + "".join(f"v{i} = v{i - 1}\n" for i in range(1, n)) + f"os.system(v{n - 1})\n"
    grow = "import os\ns = 'a'\n" + "s = s + 'b'\n" * n + "os.system(s, shell=True)\n"
    found = code_findings(make_files({"copy.py": copy, "grow.py": grow}))
    assert sorted(rows(found.where("rule_id = 'S1'"), "path", "severity", "evidence")) == [
        ("copy.py", "critical", "Unsanitized input from os.getenv() flows to os.system()"),
        ("grow.py", "medium", "Constant command argument")]
    assert time.time() - began < 120


def test_hot_name_is_merged_in_ranges(spark, monkeypatch):
    """One name used very often: the last definition is carried over key ranges."""
    import random

    from vigil.operators import taint as T
    monkeypatch.setattr(T, "KEY_RANGE", 16)
    rng = random.Random(2)
    keys = rng.sample(range(3000), 1500)
    defs = [("p", "f", "hot", k) for k in keys[:40]] + [("p", "f", "rare", 5), ("p", "g", "hot", 2900)]
    uses = [("p", "f", "hot", k) for k in keys[20:]] + [("p", "f", "rare", 5), ("p", "f", "rare", 2999), ("p", "f", "none", 7)]
    got = T.reaching_defs(spark.createDataFrame(defs, "package_id string, path string, name string, def_key long"),
                          spark.createDataFrame(uses, "package_id string, path string, name string, use_key long"))
    want = {(p, f, n, k, max((d for a, b, c, d in defs if (a, b, c) == (p, f, n) and d < k), default=None)) for p, f, n, k in uses}
    rows_got = got.collect()
    assert len(rows_got) == len(uses) and {tuple(r) for r in rows_got} == want
