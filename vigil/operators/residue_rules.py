"""Residue checks R1-R10 over fleet inventory tables, and the R11 cleanup plan.

The scanner this re-implements probes one local machine; here every check
is a filter / equi-join over inventory rows of all hosts.  Findings carry
``host_id`` in the ``package_id`` column so the common findings schema,
suppression and scoring apply unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..rules import packs as R
from ..schemas import findings_from_hits, hit


def _has_kw(col: Column) -> Column:
    c = None
    for k in R.AGENT_KEYWORDS:
        x = col.contains(k)
        c = x if c is None else (c | x)
    return c


def _emit(df: DataFrame, h: Column, path: Column | None, line: Column | None, k: int) -> DataFrame:
    d = df.select(F.col("host_id").cast("string").alias("package_id"),
                  (path if path is not None else F.lit(None)).cast("string").alias("_path"),
                  (line if line is not None else F.lit(None)).cast("int").alias("_line"),
                  h.alias("h")).where(F.col("h").isNotNull())
    return findings_from_hits(d, "residue", "residue", path="_path", line="_line")


def r1_crontab(lines: DataFrame) -> DataFrame:
    c = lines.where(F.col("path") == "crontab").withColumn("s", py_strip(F.col("line")))
    c = c.where((F.col("s") != "") & ~F.col("s").startswith("#"))
    snip = F.substring("s", 1, 120)
    kw = hit("R1", "high", 0.8, "Suspicious crontab entry", "Crontab contains agent-related entry",
             tags=["persistence", "crontab"], remediation="Remove with: crontab -e", snippet=snip,
             phase=1, k=F.col("line_no"))
    tmp = hit("R1", "medium", 0.6, "Crontab entry runs from temporary directory",
              "Crontab entry references tmp/cache path", tags=["persistence", "crontab"],
              remediation="Verify if this crontab entry is expected.", snippet=snip, phase=1, k=F.col("line_no"))
    h = F.when(_has_kw(F.lower("s")), kw).when(F.col("s").rlike(R.CRON_TMP), tmp)
    return _emit(c, h, None, None, 1)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def r2_launch_agents(files: DataFrame) -> DataFrame:
    f = files.where((F.col("os") == "macos") & F.col("parent").isin(*R.LAUNCH_AGENT_DIRS)
                    & F.col("name").endswith(".plist") & _has_kw(F.lower(_stem(F.col("name")))))
    h = hit("R2", "high", 0.85, F.concat(F.lit("Suspicious LaunchAgent: "), F.col("name")),
            "LaunchAgent plist matches agent keyword", tags=["persistence", "launch_agent"],
            remediation=F.concat(F.lit("Remove: launchctl unload "), F.col("path"), F.lit(" && rm "), F.col("path")),
            phase=2, k=0)
    return _emit(f, h, F.col("path"), None, 2)


def r3_systemd(files: DataFrame) -> DataFrame:
    f = files.where((F.col("os") == "linux") & F.col("parent").isin(*R.SYSTEMD_DIRS)
                    & F.col("name").endswith(".service") & _has_kw(F.lower(_stem(F.col("name")))))
    h = hit("R3", "high", 0.85, F.concat(F.lit("Suspicious systemd service: "), F.col("name")),
            "systemd service matches agent keyword", tags=["persistence", "systemd"],
            remediation=F.concat(F.lit("Remove: systemctl disable "), _stem(F.col("name")), F.lit(" && rm "),
                                 F.col("path")), phase=3, k=0)
    return _emit(f, h, F.col("path"), None, 3)


def r4_sudoers(files: DataFrame) -> DataFrame:
    f = files.where((F.col("os") == "macos") & (F.col("parent") == "/etc/sudoers.d") & ~F.col("is_dir")
                    & _has_kw(F.lower("name")))
    h = hit("R4", "critical", 0.95, F.concat(F.lit("Suspicious sudoers modification: "), F.col("name")),
            "File in /etc/sudoers.d/ matches agent keyword — may grant passwordless root",
            tags=["persistence", "privilege_escalation"],
            remediation=F.concat(F.lit("IMMEDIATELY review and remove: sudo rm "), F.col("path")), phase=4, k=0)
    return _emit(f, h, F.col("path"), None, 4)


def r5_shell_config(lines: DataFrame) -> DataFrame:
    sev = None
    for p, s in R.SHELL_CONFIGS:
        sev = F.when(F.col("path") == p, s) if sev is None else sev.when(F.col("path") == p, s)
    ln = lines.where(F.col("path").isin(*[p for p, _ in R.SHELL_CONFIGS]))
    hits = F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")))
                     for i, (p, d) in enumerate(R.SHELL_CONFIG_PATTERNS)])
    x = ln.select("host_id", "path", "line_no", "line", sev.alias("sev"), F.explode_outer(hits).alias("x")) \
        .where(F.col("x").isNotNull())
    h = hit("R5", F.col("sev"), 0.7, F.concat(F.lit("Shell config modification: "), F.col("x.d")),
            F.concat(F.lit("Suspicious content in "), F.col("path")), tags=["persistence", "shell_config"],
            remediation=F.concat(F.lit("Review and remove this line from "), F.col("path")),
            snippet=F.substring(py_strip(F.col("line")), 1, 120), phase=5, k=F.col("line_no") * 10 + F.col("x.i"))
    return _emit(x, h, F.col("path"), F.col("line_no"), 5)


def r6_git_hooks(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Executable hooks that mention an agent anywhere (or in their first
    ``max_chars`` characters)."""
    text = F.coalesce("head", F.lit(""))
    text = text if max_chars is None else F.substring(text, 1, max_chars)
    roots = "|".join(r.replace(".", r"\.") for r in R.GIT_HOOK_ROOTS)
    # hooks dir at most 5 path parts below a search root
    rx = rf"^(?:{roots})(?:/[^/]+){{0,3}}/\.git/hooks$"
    f = files.where(F.col("parent").rlike(rx) & ~F.col("is_dir") & F.col("is_exec")
                    & ~F.col("name").endswith(".sample")
                    & _has_kw(F.lower(text)))
    f = f.dropDuplicates(["host_id", "path"])
    h = hit("R6", "medium", 0.7, F.concat(F.lit("Agent-related git hook: "), F.col("name")),
            "Git hook contains agent-related keywords", tags=["persistence", "git_hook"],
            remediation=F.concat(F.lit("Review and remove if no longer needed: rm "), F.col("path")), phase=6, k=0)
    return _emit(f, h, F.col("path"), None, 6)


def r7_residue_dirs(files: DataFrame) -> DataFrame:
    """Known residue directories directly under the cache/config roots, with
    the recursive size of their files.  Files are mapped to their top
    directory below a root (an equi key), so the sum is a plain aggregate."""
    dirs = files.where(F.col("is_dir") & F.col("parent").isin(*R.RESIDUE_ROOTS)
                       & F.lower("name").isin(*R.KNOWN_RESIDUE_DIRS)).select("host_id", "path", "name")
    root_rx = "^(" + "|".join(r.replace(".", r"\.") for r in R.RESIDUE_ROOTS) + ")/([^/]+)/"
    under = files.where(~F.col("is_dir") & F.col("path").rlike(root_rx)).select(
        "host_id", F.concat(F.regexp_extract("path", root_rx, 1), F.lit("/"),
                            F.regexp_extract("path", root_rx, 2)).alias("path"), "size")
    sizes = under.groupBy("host_id", "path").agg(F.sum("size").alias("bytes"))
    d = dirs.join(sizes, ["host_id", "path"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    mb = F.format_string("%.1f", F.bround(F.col("bytes") / (1024 * 1024), 1))
    h = hit("R7", "low", 0.9, F.concat(F.lit("Residual directory: "), F.col("name"), F.lit(" ("), mb, F.lit(" MB)")),
            F.concat(F.lit("Agent-related directory found at "), F.col("path")), tags=["residue", "cache"],
            remediation=F.concat(F.lit("If no longer needed: rm -rf "), F.col("path")), phase=7, k=0)
    return _emit(d, h, F.col("path"), None, 7)


def r8_credentials(files: DataFrame) -> DataFrame:
    f = files.where(F.col("path").isin(*R.CREDENTIAL_FILES))
    world = F.col("mode").bitwiseAND(4) != 0
    oct3 = F.substring(F.conv(F.col("mode").cast("string"), 10, 8), -3, 3)
    h = hit("R8", F.when(world, "high").otherwise("medium"), 0.9,
            F.concat(F.lit("Residual credentials: "), F.col("name"), F.lit(" (perms: "), oct3, F.lit(")")),
            F.concat(F.lit("Credential file exists"), F.when(world, F.lit(" and is world-readable")).otherwise(F.lit(""))),
            tags=["credential", "residue"],
            remediation=F.concat(F.lit("Revoke tokens inside, then: chmod 600 "), F.col("path"), F.lit(" or rm "),
                                 F.col("path")), phase=8, k=0)
    return _emit(f, h, F.col("path"), None, 8)


def r9_hosts(lines: DataFrame) -> DataFrame:
    ln = lines.where(F.col("path") == "/etc/hosts").withColumn("s", py_strip(F.col("line")))
    ln = ln.where((F.col("s") != "") & ~F.col("s").startswith("#"))
    parts = F.split(F.col("s"), r"\s+")
    host = F.lower(F.get(parts, 1))
    x = ln.select("host_id", "line_no", "s", host.alias("hn")).where(F.col("hn").isNotNull())
    x = x.where(~F.col("hn").isin(*R.STANDARD_HOSTS) & _has_kw(F.col("hn")))
    h = hit("R9", "medium", 0.7, F.concat(F.lit("Non-standard /etc/hosts entry: "), F.col("hn")),
            "Agent-related hostname in /etc/hosts", tags=["network_config", "residue"],
            remediation="Remove this entry if no longer needed.", snippet=F.substring("s", 1, 120),
            phase=9, k=F.col("line_no"))
    return _emit(x, h, F.lit("/etc/hosts"), F.col("line_no"), 9)


def r10_packages(packages: DataFrame, managers=("pip",)) -> DataFrame:
    p = packages.where(F.col("manager").isin(*managers) & _has_kw(F.lower("name")))
    h = hit("R10", "low", 0.9, F.concat(F.lit("Residual pip package: "), F.col("name"), F.lit("=="),
                                        F.coalesce(F.col("version"), F.lit("?"))),
            "Agent-related package still installed", tags=["residue", "global_package"],
            remediation=F.concat(F.lit("If no longer needed: pip uninstall "), F.col("name")), phase=10, k=0)
    return _emit(p, h, None, None, 10)


def residue_findings(files: DataFrame, lines: DataFrame, packages: DataFrame) -> DataFrame:
    parts = [r1_crontab(lines), r2_launch_agents(files), r3_systemd(files), r4_sudoers(files),
             r5_shell_config(lines), r6_git_hooks(files), r7_residue_dirs(files), r8_credentials(files),
             r9_hosts(lines), r10_packages(packages)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df


def cleanup_plan(findings: DataFrame) -> DataFrame:
    """One numbered action per actionable residue finding and host."""
    r = F.col("rule_id")
    typ = (F.when(r.isin("R2", "R3", "R4", "R6", "R7") & F.col("path").isNotNull(), "remove_file")
           .when((r == "R5") & F.col("path").isNotNull() & F.col("line").isNotNull(), "remove_line")
           .when((r == "R8") & F.col("path").isNotNull(), "fix_permissions")
           .when((r == "R1") & F.col("snippet").isNotNull(), "remove_crontab"))
    from ..plans.analytics import group_rank
    a = findings.select(F.col("package_id").alias("host_id"), "rule_id", "title", "path", "line", "snippet",
                        F.col("ord.phase").alias("_ph"), typ.alias("type")) \
        .where(F.col("type").isNotNull())
    # numbering inside a host without a per-host window (a host may hold a third of all rows)
    ranked = group_rank(a, ["host_id"], ["_ph", "path", "line", "rule_id", "title", "snippet"])
    return ranked.select("host_id", F.col("n").cast("int").alias("n"), "type", "rule_id", "title",
                    F.when(F.col("type") != "remove_crontab", F.col("path")).alias("path"),
                    F.when(F.col("type") == "remove_line", F.col("line")).alias("line"),
                    F.when(F.col("type").isin("remove_line", "remove_crontab"), F.col("snippet")).alias("content"),
                    F.when(F.col("type") == "fix_permissions", F.lit("600")).alias("target_mode"))
