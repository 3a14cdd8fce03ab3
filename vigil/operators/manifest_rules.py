"""Manifest rules M1-M7, capabilities (C1), category (C2), S11 and the
manifest sources (SRC6-SRC10), over all packages at once.

Manifests are parsed with JSON built-ins (``from_json`` / ``try_parse_json``
+ ``variant_get``); every rule is a filter, an equi-join against a small
fixed dimension, or a per-package aggregate bounded by the dimension size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import human_size, path_glob_regex, py_strip, step_up
from ..rules import packs as R
from ..schemas import findings_from_hits, hit
from ..sources.files import to_lines

NPM_SCHEMA = T.StructType([
    T.StructField("description", T.StringType()),
    T.StructField("scripts", T.MapType(T.StringType(), T.StringType())),
    T.StructField("dependencies", T.MapType(T.StringType(), T.StringType())),
    T.StructField("devDependencies", T.MapType(T.StringType(), T.StringType())),
    T.StructField("peerDependencies", T.MapType(T.StringType(), T.StringType())),
])


def _emit(df: DataFrame, h: Column, path: Column, line: Column | None = None) -> DataFrame:
    d = df.select("package_id", path.alias("_path"), (line if line is not None else F.lit(None)).alias("_line"),
                  h.alias("h")).where(F.col("h").isNotNull())
    return findings_from_hits(d, "manifest", "metadata", path="_path", line="_line")


# ------------------------------------------------------------------ SRC6 / SRC7
def npm_manifest(files: DataFrame) -> DataFrame:
    """(package_id, description, scripts, deps) from the root package.json;
    unparsable JSON gives no row."""
    pj = files.where(F.col("path") == "package.json").select(
        "package_id", F.from_json("content", NPM_SCHEMA, {"mode": "PERMISSIVE"}).alias("j"),
        F.try_parse_json("content").alias("v"))
    keys = [F.coalesce(F.map_keys(F.col("j." + k)), F.array().cast("array<string>"))
            for k in ("dependencies", "devDependencies", "peerDependencies")]
    return pj.where(F.col("v").isNotNull()).select(
        "package_id", F.col("j.description").alias("description"), F.col("j.scripts").alias("scripts"),
        F.array_distinct(F.concat(*keys)).alias("deps"))


def pip_requirements(files: DataFrame) -> DataFrame:
    """(package_id, dep) from requirements.txt, only for packages that have
    setup.py or pyproject.toml.  Names end at the first of ``> = < ! [``
    (and ``~ ;`` and blanks, so ``requests~=2.0`` names ``requests``)."""
    gate = files.where(F.col("path").isin("setup.py", "pyproject.toml")).select("package_id").distinct()
    req = files.where(F.col("path") == "requirements.txt").join(gate, "package_id", "left_semi")
    ln = to_lines(req).select("package_id", py_strip(F.col("line")).alias("l"))
    ln = ln.where((F.col("l") != "") & ~F.col("l").startswith("#"))
    dep = F.trim(F.regexp_extract(F.col("l"), r"^([^>=<!\[~; \t]*)", 1))
    return ln.select("package_id", dep.alias("dep")).where(F.col("dep") != "")


# ------------------------------------------------------------------ M4
def one_less(name: Column) -> Column:
    """The name and every string made by leaving one of its characters out:
    names one edit apart have one of these in common."""
    n = F.length(name)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                      lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1, n)))
    return F.array_distinct(F.concat(F.array(name), F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))))


def typosquat(files: DataFrame, popular=None) -> DataFrame:
    """M4: dependency one edit away from a popular name (separators and case
    ignored); an exact match exempts; the alphabetically first popular name
    wins.  Distinct names meet in an equi-join on their deletion
    neighbourhoods, so neither list is broadcast and a dependency that every
    package has is looked up once."""
    spark = files.sparkSession
    pop = popular if popular is not None else spark.createDataFrame([(p,) for p in R.TOP_PACKAGES], "top string")
    norm = lambda c: F.regexp_replace(F.lower(c), "[-_]", "")
    top = pop.select(norm(F.col("top")).alias("tn"), "top").groupBy("tn").agg(F.min("top").alias("top"))
    # outer: Spark would add a filter below a plain explode that parses every manifest again
    npm = npm_manifest(files).select("package_id", F.explode_outer("deps").alias("dep"),
                                     F.lit("package.json").alias("file")).where(F.col("dep").isNotNull())
    pip = pip_requirements(files).withColumn("file", F.lit("requirements.txt"))
    deps = npm.unionByName(pip).withColumn("dn", norm(F.col("dep")))
    names = deps.select("dn").distinct().join(top.select(F.col("tn").alias("dn")), "dn", "left_anti")
    near = names.withColumn("key", F.explode(one_less(F.col("dn")))).join(
        top.withColumn("key", F.explode(one_less(F.col("tn")))), "key").where(F.levenshtein("dn", "tn", 1) == 1)
    best = near.groupBy("dn").agg(F.min("top").alias("top"))
    # one finding per dependency occurrence (requirements may list a name twice)
    out = deps.join(best, "dn")
    h = hit("M4", "critical", 0.85,
            F.concat(F.lit('Possible typo-squatting: "'), F.col("dep"), F.lit('" (similar to "'), F.col("top"),
                     F.lit('")')),
            F.concat(F.lit('Dependency name is 1 edit away from popular package "'), F.col("top"), F.lit('"')),
            evidence="Levenshtein distance = 1", tags=["typosquatting", "supply_chain"],
            remediation=F.concat(F.lit('Verify this is the intended package. Did you mean "'), F.col("top"),
                                 F.lit('"?')),
            refs=["CWE-1357"], phase=4, k=0)
    return _emit(out, h, F.col("file"))


# ------------------------------------------------------------------ M5
def npm_install_hooks(files: DataFrame) -> DataFrame:
    """Preinstall / postinstall / prepare / prepublish scripts."""
    npm = npm_manifest(files).where(F.col("scripts").isNotNull())
    rows = npm.select("package_id", F.explode(F.array(*[
        F.when(F.col("scripts")[h].isNotNull(), F.struct(F.lit(i).alias("i"), F.lit(h).alias("hook"),
                                                         F.col("scripts")[h].alias("script")))
        for i, h in enumerate(R.INSTALL_HOOKS)])).alias("x")).where(F.col("x").isNotNull()).select("package_id", "x.*")
    s = F.col("script")
    h = hit("M5", F.when(s.rlike(R.HOOK_ESCALATE), "critical").otherwise("high"), 0.9,
            F.concat(F.lit("Install-time script: "), F.col("hook")),
            F.concat(F.lit("package.json contains "), F.col("hook"), F.lit(" script that executes during npm install")),
            tags=["install_script", "supply_chain"],
            remediation=F.concat(F.lit("Review "), F.col("hook"),
                                 F.lit(" script carefully. Use --ignore-scripts flag during install.")),
            refs=["MITRE T1195.002"],
            snippet=F.concat(F.lit('"'), F.col("hook"), F.lit('": "'), F.substring(s, 1, 100), F.lit('"')),
            phase=1, k=F.col("i"))
    return _emit(rows, h, F.lit("package.json"))


def install_refs(manifests: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(package_id, path) of files an npm install hook names that exist
    anywhere in the package (excluded directories too), plus setup.py when it
    overrides install commands.  A file named by two hooks counts once."""
    files = manifests if files is None else files
    npm = npm_manifest(manifests).where(F.col("scripts").isNotNull())
    refs = npm.select("package_id", F.explode(F.array(*[F.col("scripts")[h] for h in R.INSTALL_HOOKS])).alias("s")) \
        .where(F.col("s").isNotNull()) \
        .select("package_id", F.explode(F.regexp_extract_all("s", F.lit(R.HOOK_FILE_REF), 0)).alias("ref")) \
        .select("package_id", F.regexp_replace("ref", r"^(?:\./)+", "").alias("path"))
    exist = refs.join(files.select("package_id", "path"), ["package_id", "path"], "left_semi")
    return exist.unionByName(cmdclass_setups(manifests).select("package_id", "path")).distinct()


def cmdclass_setups(files: DataFrame) -> DataFrame:
    c = F.col("content")
    return files.where((F.col("path") == "setup.py") & c.contains("cmdclass")
                       & (c.contains("install") | c.contains("develop")))


def pip_cmdclass(files: DataFrame) -> DataFrame:
    """Setup.py overriding install/develop through cmdclass."""
    h = hit("M5", "high", 0.85, "Custom install command in setup.py",
            "setup.py overrides install/develop cmdclass, code executes during pip install",
            tags=["install_script", "supply_chain"],
            remediation="Review setup.py install command. Custom cmdclass is a common attack vector.",
            refs=["MITRE T1195.002"], phase=2, k=0)
    return _emit(cmdclass_setups(files), h, F.lit("setup.py"))


def install_time_elevation(code_findings: DataFrame, refs: DataFrame) -> DataFrame:
    """Code findings of install-time files again, as ``S11/<rule>``,
    one severity step up, tagged install_time."""
    f = code_findings.join(refs, ["package_id", "path"], "left_semi")
    return f.select(
        "package_id", F.concat(F.lit("S11/"), F.col("rule_id")).alias("rule_id"), F.lit("manifest").alias("engine"),
        "layer", step_up(F.col("severity")).alias("severity"), "confidence", "title",
        F.concat(F.lit("[install-time] "), F.col("description")).alias("description"), "path", "line", "snippet",
        "evidence", F.when(F.array_contains("tags", "install_time"), F.col("tags"))
        .otherwise(F.concat("tags", F.array(F.lit("install_time")))).alias("tags"),
        "remediation", "refs",
        F.struct(F.lit(2).alias("eng"), F.col("ord.path"), F.lit(1).alias("phase"), F.col("ord.line"),
                 F.col("ord.k")).alias("ord"))


# ------------------------------------------------------------------ SRC8 + M2b-1
TOOLS_HEADING = r"(?i)^#{1,3}\s+tools?\b"
ANY_HEADING = r"^#{1,3}\s+"


def skill_tools(files: DataFrame) -> DataFrame:
    """SRC8: tools declared in SKILL.md's Tools section (list items and
    ``####`` sub-headings), lower-cased, with the line they are on."""
    ln = to_lines(files.where(F.col("path") == "SKILL.md")).withColumn("s", py_strip(F.col("line")))
    kind = F.when(F.col("s").rlike(TOOLS_HEADING), "T").when(F.col("s").rlike(ANY_HEADING), "H")
    w = Window.partitionBy("package_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    st = ln.withColumn("kind", kind).withColumn("sec", F.last("kind", ignorenulls=True).over(w))
    items = st.where((F.col("sec") == "T") & F.col("kind").isNull())
    item = F.regexp_extract("s", r"^[-*]\s+`?(\w[\w_.-]*)`?", 1)
    sub = F.regexp_extract("s", r"^#{2,4}\s+`?(\w[\w_.-]*)`?", 1)
    a = items.select("package_id", "line_no", F.lower(item).alias("tool"), F.lit(0).alias("j")).where(F.col("tool") != "")
    b = items.select("package_id", "line_no", F.lower(sub).alias("tool"), F.lit(1).alias("j")).where(F.col("tool") != "")
    return a.unionByName(b)


def dangerous_tools(files: DataFrame) -> DataFrame:
    t = skill_tools(files).where(F.col("tool").isin(*R.DANGEROUS_TOOLS))
    h = hit("M2b", "high", 0.85, F.concat(F.lit("Skill requests dangerous tool: "), F.col("tool")),
            F.concat(F.lit("SKILL.md declares a tool '"), F.col("tool"),
                     F.lit("' that grants powerful/dangerous capabilities")),
            tags=["dangerous_tool", "capability_escalation"],
            remediation=F.concat(F.lit("Review whether the skill genuinely needs the '"), F.col("tool"),
                                 F.lit("' tool.")),
            refs=["CWE-250"], phase=0, k=F.col("line_no") * 2 + F.col("j"))
    return _emit(t, h, F.lit("SKILL.md"))


# ------------------------------------------------------------------ SRC9, M2b-2, M6
def mcp_manifest(files: DataFrame) -> DataFrame:
    """(package_id, manifest, v): mcp.json, else manifest.json; v null = malformed."""
    has_mcp = files.where(F.col("path") == "mcp.json").select("package_id").distinct()
    mcp = files.where(F.col("path") == "mcp.json")
    man = files.where(F.col("path") == "manifest.json").join(has_mcp, "package_id", "left_anti")
    both = mcp.unionByName(man)
    return both.select("package_id", F.col("path").alias("manifest"), F.try_parse_json("content").alias("v"))


def malformed_manifest(files: DataFrame) -> DataFrame:
    m = mcp_manifest(files).where(F.col("v").isNull())
    h = hit("M6", "medium", 0.9, F.concat(F.lit("Malformed manifest: "), F.col("manifest")),
            F.concat(F.lit("Could not parse "), F.col("manifest"), F.lit(": invalid JSON")),
            tags=["manifest", "parse_error"], remediation="Fix JSON syntax in manifest file.", phase=3, k=0)
    return _emit(m, h, F.col("manifest"))


def declared_capabilities(files: DataFrame) -> DataFrame:
    """(package_id, manifest, cap): tool names (objects' name or plain
    strings) and resource names of the parsed manifest."""
    m = mcp_manifest(files).where(F.col("v").isNotNull())
    tools = m.select("package_id", "manifest",
                     F.explode(F.try_variant_get("v", "$.tools", "array<variant>")).alias("t"))
    tname = F.when(F.schema_of_variant("t") == "STRING", F.try_variant_get("t", "$", "string")) \
        .otherwise(F.try_variant_get("t", "$.name", "string"))
    res = m.select("package_id", "manifest",
                   F.explode(F.try_variant_get("v", "$.resources", "array<variant>")).alias("r"))
    rname = F.try_variant_get("r", "$.name", "string")
    a = tools.select("package_id", "manifest", tname.alias("cap"))
    b = res.select("package_id", "manifest", rname.alias("cap"))
    return a.unionByName(b).where(F.col("cap").isNotNull() & (F.col("cap") != "")).distinct()


def broad_permissions(files: DataFrame) -> DataFrame:
    """M2b-2: wildcard / true permissions, and broad filesystem values."""
    m = mcp_manifest(files).where(F.col("v").isNotNull())
    perms = m.select("package_id", "manifest", F.posexplode(
        F.try_variant_get("v", "$.permissions", "map<string,variant>")).alias("i", "key", "val"))
    typ = F.schema_of_variant("val")
    sval = F.try_variant_get("val", "$", "string")
    is_true = (typ == "BOOLEAN") & F.coalesce(F.try_variant_get("val", "$", "boolean"), F.lit(False))
    is_star = (typ == "STRING") & (sval == "*")
    val_str = F.when(typ == "STRING", sval).otherwise(F.to_json("val"))
    listy = (typ == "STRING") | typ.startswith("ARRAY")
    fs = F.col("key").isin("filesystem", "file", "fs") & listy & (
        (val_str == "/") | val_str.contains("~") | val_str.contains("*"))
    wild = hit("M2b", "high", 0.9, F.concat(F.lit("Overly broad permission: "), F.col("key")),
               F.concat(F.lit("Manifest declares wildcard/unrestricted permission for '"), F.col("key"), F.lit("'")),
               tags=["permission", "overly_broad"],
               remediation=F.concat(F.lit("Restrict the '"), F.col("key"), F.lit("' permission to specific resources.")),
               refs=["CWE-250"], phase=3, k=F.col("i") * 2)
    fsh = hit("M2b", "high", 0.85, F.concat(F.lit("Broad filesystem permission: "), F.col("key")),
              F.concat(F.lit("Manifest requests broad filesystem access: "), F.substring(val_str, 1, 100)),
              tags=["permission", "filesystem", "overly_broad"],
              remediation="Restrict filesystem access to specific directories needed by the tool.",
              refs=["CWE-250"], phase=3, k=F.col("i") * 2 + 1)
    rows = perms.select("package_id", "manifest", F.explode(F.array(F.when(is_true | is_star, wild),
                                                                     F.when(fs, fsh))).alias("hh"))
    return _emit(rows, F.col("hh"), F.col("manifest"))


# ------------------------------------------------------------------ C1, C2, M1, M2a
def actual_capabilities(behavior_findings: DataFrame) -> DataFrame:
    """Capability names per package from behavior-layer findings (by
    rule id and by tag), suppressed ones included, as the scanner does."""
    spark = behavior_findings.sparkSession
    b = behavior_findings.where(F.col("layer") == "behavior")
    rc = spark.createDataFrame(R.RULE_CAPABILITY, "rule_id string, cap string")
    tc = spark.createDataFrame(R.TAG_CAPABILITY, "tag string, cap string")
    by_rule = b.select("package_id", "rule_id").join(F.broadcast(rc), "rule_id").select("package_id", "cap")
    by_tag = b.select("package_id", F.explode("tags").alias("tag")).join(F.broadcast(tc), "tag") \
        .select("package_id", "cap")
    return by_rule.unionByName(by_tag).distinct()


def description_text(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """SRC10: SKILL.md and README files (whole, or ``max_chars`` of each),
    package.json and pyproject descriptions, in that order, joined by
    newlines, lower-cased.  A package has at most seven of them."""
    rank = None
    for i, name in enumerate(R.DESCRIPTION_FILES):
        rank = F.when(F.col("path") == name, i) if rank is None else rank.when(F.col("path") == name, i)
    docs = files.where(F.col("path").isin(*R.DESCRIPTION_FILES)).select(
        "package_id", rank.alias("r"),
        (F.col("content") if max_chars is None else F.substring("content", 1, max_chars)).alias("t"))
    npm = npm_manifest(files).where(F.col("description").isNotNull() & (F.col("description") != "")).select(
        "package_id", F.lit(10).alias("r"), F.col("description").alias("t"))
    py = files.where(F.col("path") == "pyproject.toml").select(
        "package_id", F.lit(11).alias("r"), F.regexp_extract("content", r'description\s*=\s*"([^"]*)"', 1).alias("t"),
        F.col("content").rlike(r'description\s*=\s*"([^"]*)"').alias("ok")).where("ok").drop("ok")
    allp = docs.unionByName(npm).unionByName(py)
    return allp.groupBy("package_id").agg(F.lower(F.array_join(
        F.array_sort(F.collect_list(F.struct("r", "t")))["t"], "\n")).alias("description"))


def detect_category(files: DataFrame) -> DataFrame:
    """Category with the most keywords present; ties keep list order."""
    d = description_text(files)
    best = None
    for i, (cat, kws) in enumerate(R.CATEGORY_KEYWORDS):
        cnt = sum((F.col("description").contains(k)).cast("int") for k in kws)
        s = F.struct(cnt.alias("n"), F.lit(-i).alias("neg"), F.lit(cat).alias("cat"))
        best = s if best is None else F.greatest(best, s)
    return d.select("package_id", F.when(best["n"] > 0, best["cat"]).alias("category")) \
        .where(F.col("category").isNotNull())


def capability_baseline(files: DataFrame, caps: DataFrame) -> DataFrame:
    """M1: actual capabilities in the category's suspicious set."""
    spark = files.sparkSession
    rows = [(cat, s, ", ".join(sorted(allowed))) for cat, allowed, sus in R.CAPABILITY_BASELINES for s in sus]
    dim = spark.createDataFrame(rows, "category string, cap string, allowed string")
    j = detect_category(files).join(caps, "package_id").join(F.broadcast(dim), ["category", "cap"])
    h = hit("M1", "high", 0.75, F.concat(F.lit("Unexpected capability for "), F.col("category"), F.lit(" skill: "),
                                         F.col("cap")),
            F.concat(F.lit("A '"), F.col("category"), F.lit("' skill would not normally require '"), F.col("cap"),
                     F.lit("' capability. Allowed capabilities for this category: "), F.col("allowed")),
            tags=["capability_mismatch", "suspicious"],
            remediation=F.concat(F.lit("Review why a "), F.col("category"), F.lit(" skill needs "), F.col("cap"),
                                 F.lit(" access.")),
            refs=["CWE-250"], phase=5, k=0)
    return _emit(j, h, F.lit(None).cast("string"))


def undeclared_capabilities(files: DataFrame, caps: DataFrame) -> DataFrame:
    """Actual minus declared, when both sets are non-empty."""
    decl = declared_capabilities(files)
    has_decl = decl.select("package_id", "manifest").distinct()
    und = caps.join(has_decl, "package_id").join(decl.select("package_id", "cap"), ["package_id", "cap"], "left_anti")
    h = hit("M2a", "high", 0.8, F.concat(F.lit("Undeclared capability: "), F.col("cap")),
            F.concat(F.lit("Code uses '"), F.col("cap"), F.lit("' capability but it is not declared in "),
                     F.col("manifest"), F.lit(". This may indicate hidden behavior.")),
            tags=["undeclared_capability", "transparency"],
            remediation=F.concat(F.lit("Declare the '"), F.col("cap"), F.lit("' capability in "), F.col("manifest"),
                                 F.lit(" or remove it from code.")),
            refs=["CWE-284"], phase=6, k=0)
    return _emit(und, h, F.col("manifest"))


# ------------------------------------------------------------------ M7
def debug_artifacts(files: DataFrame, per_pattern: int | None = None) -> DataFrame:
    """M7: published debug artifacts, one finding each.  With ``per_pattern``
    at most that many per (package, pattern), ordered by path, plus one
    summary row when there are more.

    Only (package_id, path, size) are read.  A limited group is cut map-side:
    ``row_number() <= k`` becomes a partial WindowGroupLimit."""
    p = files.select("package_id", "path", "size")
    segs = F.split("path", "/")
    p = p.where(~F.arrays_overlap(segs, F.array(*[F.lit(d) for d in R.DEBUG_EXCLUDED_DIRS])))
    arms = [F.when(F.col("path").rlike(path_glob_regex(g)),
                   F.struct(F.lit(i).alias("pi"), F.lit(g).alias("glob"), F.lit(desc).alias("desc"),
                            F.lit(sev).alias("sev"), F.lit(advice).alias("advice")))
            for i, (g, desc, sev, advice) in enumerate(R.DEBUG_ARTIFACTS)]
    m = p.select("package_id", "path", "size", F.explode_outer(F.array(*arms)).alias("x")).where(F.col("x").isNotNull()) \
        .select("package_id", "path", "size", "x.*")
    tags = ["debug_artifact", "publish_hygiene", "supply_chain"]
    if per_pattern is None:
        listed = m
    else:
        w = Window.partitionBy("package_id", "pi").orderBy("path")
        listed = m.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_pattern)
    h = hit("M7", F.col("sev"), 0.9,
            F.concat(F.lit("Publishable package contains "), F.lower("desc"), F.lit(": "), F.col("path")),
            F.concat(F.lit("Found '"), F.col("path"), F.lit("' which is a "), F.lower("desc"),
                     F.lit(". This type of file should not be included in published packages.")),
            evidence=F.concat(F.lit("File: "), F.col("path"), F.lit(" ("), human_size(F.col("size")), F.lit(")")),
            tags=tags, remediation=F.col("advice"), refs=["CWE-540"], phase=7, k=F.col("pi") * 2)
    found = _emit(listed, h, F.col("path"))
    if per_pattern is None:
        return found
    cnt = m.groupBy("package_id", "pi", "glob", "desc", "sev", "advice").agg(F.count("*").alias("n")) \
        .where(F.col("n") > per_pattern)
    hs = hit("M7", F.col("sev"), 0.9,
             F.concat(F.lit("Multiple "), F.lower("desc"), F.lit(" files found ("), F.col("n").cast("string"),
                      F.lit(" total)")),
             F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" files matching '"), F.col("glob"),
                      F.lit(f"'. Only first {per_pattern} are listed individually.")),
             evidence=F.concat(F.lit("Total: "), F.col("n").cast("string"), F.lit(" files matching "), F.col("glob")),
             tags=tags, remediation=F.col("advice"), refs=["CWE-540"], phase=7, k=F.col("pi") * 2 + 1)
    return found.unionByName(_emit(cnt, hs, F.lit(None).cast("string")))


MANIFEST_NAMES = ["package.json", "requirements.txt", "setup.py", "pyproject.toml", "SKILL.md", "mcp.json",
                  "manifest.json", *R.DESCRIPTION_FILES, R.IGNORE_FILE]


def manifest_subset(files: DataFrame) -> DataFrame:
    """The root manifest files of every package, cut out of ``files`` in one
    selective pass, so the manifest rules never re-read the bulk content
    (on a ``kind``-partitioned table, by partition pruning)."""
    if "kind" in files.columns:
        files = files.where(F.col("kind").isin("manifest", "scan_manifest"))
    return files.where(F.col("path").isin(*sorted(set(MANIFEST_NAMES))))


def manifest_findings(files: DataFrame, behavior: DataFrame, code: DataFrame | None,
                      manifests: DataFrame | None = None, refs: DataFrame | None = None) -> DataFrame:
    """Every manifest-engine finding; ``behavior`` feeds capabilities and
    ``code`` (S findings) feeds S11, with ``refs`` (default: looked up).  ``manifests`` (default: the
    ``manifest_subset`` of ``files``) is what the content rules read; the
    debug-artifact and install-reference checks read only paths and sizes
    of all files."""
    m = manifests if manifests is not None else manifest_subset(files)
    caps = actual_capabilities(behavior)
    parts = [npm_install_hooks(m), typosquat(m), pip_cmdclass(m), dangerous_tools(m),
             malformed_manifest(m), broad_permissions(m), capability_baseline(m, caps),
             undeclared_capabilities(m, caps), debug_artifacts(files)]
    if code is not None:
        parts.append(install_time_elevation(code, refs if refs is not None else install_refs(m, files)))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df
