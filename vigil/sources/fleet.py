"""Fleet inventory tables, seeded from the driver's ``customer`` and
``orders`` tables (one host per customer, one crontab / shell-config /
hosts line, package and cache file per order), so the residue checks have
work that grows with the data.

Schemas (the same a real inventory collector would produce):

* ``host_files(host_id, os, path, name, parent, is_dir, size, mode, is_exec, head)``
* ``host_lines(host_id, path, line_no, line)`` - crontab is path ``crontab``
* ``host_packages(host_id, manager, name, version)``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..rules import packs as R

OS_BY_NATION = ["linux", "macos", "windows"]
# FIXED VALUES (fleet shape): crontab / shell / hosts line templates ({kw} = host keyword)
CRON_LINES = ["*/5 * * * * /opt/{kw}/run.sh", "0 3 * * * /tmp/job{o}.sh", "# nightly", "",
              "@daily /usr/bin/backup"]
SHELL_FILES = ["~/.zshrc", "~/.zshenv", "~/.bash_logout"]
SHELL_LINES = ["export PATH=$PATH:~/.{kw}/bin", "alias {kw}=open", 'eval "$(curl -fsSL https://get.example.sh)"',
               "export EDITOR=vim"]
HOSTS_LINES = ["127.0.0.1 localhost", "10.0.0.{m} {kw}-gw.local", "# local", "::1 ip6-localhost"]
PKG_NAMES = ["{kw}-sdk", "requests", "numpy", "my{kw}"]


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _fmt(tmpl: Column, kw: Column, o: Column | None = None, m: Column | None = None) -> Column:
    out = F.replace(tmpl, F.lit("{kw}"), kw)
    if o is not None:
        out = F.replace(out, F.lit("{o}"), o.cast("string"))
    if m is not None:
        out = F.replace(out, F.lit("{m}"), m.cast("string"))
    return out


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    return c.select(F.col("c_custkey").alias("host_id"),
                    _pick(OS_BY_NATION, F.col("c_nationkey") % 3).alias("os"),
                    _pick(R.AGENT_KEYWORDS, F.col("c_custkey") % len(R.AGENT_KEYWORDS)).alias("kw"),
                    _pick(R.KNOWN_RESIDUE_DIRS, F.col("c_custkey") % len(R.KNOWN_RESIDUE_DIRS)).alias("rd"))


def host_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hosts(spark, sf_dir)
    hid = F.col("host_id")
    hs = hid.cast("string")

    def row(cond, parent, name, is_dir=False, size=0, mode=33188, is_exec=False, head=""):
        return h.where(cond).select(
            "host_id", "os", F.concat(parent, F.lit("/"), name).alias("path"), name.alias("name"),
            parent.alias("parent"), F.lit(is_dir).alias("is_dir"), F.lit(size).cast("long").alias("size"),
            (mode if isinstance(mode, Column) else F.lit(mode)).cast("int").alias("mode"),
            F.lit(is_exec).alias("is_exec"), (head if isinstance(head, Column) else F.lit(head)).alias("head"))

    la = F.lit("~/Library/LaunchAgents")
    parts = [
        row(hid % 4 == 0, la, F.concat(F.lit("com."), F.col("kw"), F.lit(".helper.plist"))),
        row(hid % 4 == 1, la, F.concat(F.lit("com.apple.update"), hs, F.lit(".plist"))),
        row(hid % 5 == 0, F.lit("/etc/systemd/system"), F.concat(F.col("kw"), F.lit("-sync.service"))),
        row(hid % 11 == 0, F.lit("/etc/sudoers.d"), F.concat(F.col("kw"), F.lit("-nopasswd"))),
        row(hid % 6 == 0, F.concat(F.lit("~/Projects/p"), hs, F.lit("/.git/hooks")), F.lit("post-commit"),
            is_exec=True, head=F.concat(F.lit("#!/bin/sh\n"), F.col("kw"), F.lit(" sync\n"))),
        row(hid % 6 == 1, F.concat(F.lit("~/Projects/p"), hs, F.lit("/.git/hooks")), F.lit("pre-commit.sample"),
            is_exec=True, head=F.lit("#!/bin/sh\n# agent sample\n")),
        row(hid % 3 == 0, F.lit("~/.config"), F.col("rd"), is_dir=True),
        row(hid % 7 == 0, F.lit("~/.claude"), F.lit("credentials.json"),
            mode=F.when(hid % 14 == 0, F.lit(33188)).otherwise(F.lit(33152))),
    ]
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    cache = o.join(h.where(hid % 3 == 0), o["o_custkey"] == h["host_id"]).select(
        "host_id", "os", F.concat(F.lit("~/.config/"), F.col("rd"), F.lit("/o"), F.col("o_orderkey").cast("string"),
                                  F.lit(".bin")).alias("path"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".bin")).alias("name"),
        F.concat(F.lit("~/.config/"), F.col("rd")).alias("parent"), F.lit(False).alias("is_dir"),
        (F.col("o_totalprice") * 1000).cast("long").alias("size"), F.lit(33188).alias("mode"),
        F.lit(False).alias("is_exec"), F.lit("").alias("head"))
    df = parts[0]
    for p in parts[1:] + [cache]:
        df = df.unionByName(p)
    return df


def host_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hosts(spark, sf_dir).select("host_id", "kw")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    j = o.join(h, o["o_custkey"] == h["host_id"]).select("host_id", "kw", "o_orderkey")
    ok = F.col("o_orderkey")
    cron = j.select("host_id", "o_orderkey", F.lit("crontab").alias("path"),
                    _fmt(_pick(CRON_LINES, ok % len(CRON_LINES)), F.col("kw"), ok).alias("line"))
    shell = j.select("host_id", "o_orderkey", _pick(SHELL_FILES, ok % 3).alias("path"),
                     _fmt(_pick(SHELL_LINES, F.floor(ok / 3) % len(SHELL_LINES)), F.col("kw")).alias("line"))
    hostf = j.select("host_id", "o_orderkey", F.lit("/etc/hosts").alias("path"),
                     _fmt(_pick(HOSTS_LINES, ok % len(HOSTS_LINES)), F.col("kw"), m=ok % 250).alias("line"))
    allr = cron.unionByName(shell).unionByName(hostf)
    w = Window.partitionBy("host_id", "path").orderBy("o_orderkey")
    return allr.select("host_id", "path", F.row_number().over(w).cast("int").alias("line_no"), "line")


def host_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hosts(spark, sf_dir).select("host_id", "kw")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    ok = F.col("o_orderkey")
    return o.join(h, o["o_custkey"] == h["host_id"]).select(
        "host_id", F.lit("pip").alias("manager"), _fmt(_pick(PKG_NAMES, ok % len(PKG_NAMES)), F.col("kw")).alias("name"),
        F.concat(F.lit("1."), (ok % 10).cast("string")).alias("version"))
