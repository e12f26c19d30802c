"""Versioned partition tables: a manifest says which files make up the table.

Every write goes to a folder of its own (``data/commit=<id>/<grain>=<value>``)
and becomes visible by one small file appended to ``manifest``, which names the
partitions that the write replaces, extends or empties. Readers resolve the
manifest when they build their plan and read exactly the folders it names, so a
reader sees the table before or after a write and never in between, and a
DataFrame made earlier keeps reading its own version: nothing is overwritten.
A folder that no version in use names can be deleted (:func:`unused_folders`).

The manifest grows by one row per partition written and is resolved by Spark;
what reaches the driver is one row per live partition. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "version long, action string, grain string, part string, commit string, n long, note string"
ADD, REPLACE, RESET = "add", "replace", "reset"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(version, action, grain, part, commit, n, note): every change ever made."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _head(entries: DataFrame) -> tuple[int, str | None]:
    row = entries.agg(F.max("version").alias("v"), F.max_by("grain", "version").alias("g")).collect()[0]
    return row["v"] or 0, row["g"]


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the last write, 0 before any."""
    return _head(manifest(spark, path))[0]


def grain_of(spark: SparkSession, path: str) -> str | None:
    """The column that the table is partitioned by (None before any write)."""
    return _head(manifest(spark, path))[1]


def live_parts(entries: DataFrame, version: int | None = None) -> DataFrame:
    """(part, commit, n) of the table as of ``version`` (default: the last)."""
    seen = entries if version is None else entries.where(F.col("version") <= version)
    last_reset = F.max(F.when(F.col("action") == RESET, F.col("version"))).over(Window.partitionBy("grain"))
    last_replace = F.max(F.when(F.col("action") == REPLACE, F.col("version"))).over(Window.partitionBy("part"))
    return (seen.withColumn("_reset", F.coalesce(last_reset, F.lit(0))).withColumn("_base", F.coalesce(last_replace, F.lit(0)))
            .where((F.col("version") >= F.col("_reset")) & (F.col("version") >= F.col("_base")) & F.col("commit").isNotNull())
            .select("part", "commit", "n"))


def last_note(spark: SparkSession, path: str) -> str | None:
    """What the last write that left a note said."""
    return manifest(spark, path).where("note IS NOT NULL").agg(F.max_by("note", "version").alias("note")).collect()[0]["note"]


def write(df: DataFrame, path: str, grain: str, action: str | Column = REPLACE, parts: Sequence[str] | None = None,
          note: str | None = None) -> int:
    """Write ``df`` as the next version; the number of that version.

    ``action``: "replace" the partitions that ``df`` holds and those named in
    ``parts`` (named ones without rows become empty), "add" rows to partitions,
    or "reset" the whole table to ``df``; or an expression over ``part`` that says
    "replace" or "add" for each partition. Rows are rebalanced by partition, so a
    large partition is split over tasks and small ones share one. ``note`` is
    kept with the version.
    """
    spark = df.sparkSession
    entries = manifest(spark, path)
    version, had = _head(entries)
    if had is not None and had != grain:
        raise ValueError(f"the table at {path} is partitioned by {had}, not by {grain}")
    if isinstance(action, str) and action not in (ADD, REPLACE, RESET):
        raise ValueError(f"unknown action {action!r}")
    commit = uuid.uuid4().hex[:16]
    folder = f"{path}/data/commit={commit}"
    df.hint("rebalance", grain).write.partitionBy(grain).parquet(folder)
    version += 1
    written = spark.read.schema(df.schema).parquet(folder).groupBy(F.col(grain).cast("string").alias("part")) \
        .agg(F.count(F.lit(1)).alias("n"))
    if written.where("part IS NULL").limit(1).count():
        raise ValueError(f"rows without {grain} have no partition")
    rows = written.select("part", F.lit(commit).alias("commit"), "n")
    change = action if isinstance(action, Column) else F.lit(REPLACE if action == RESET else action)
    rows = rows.withColumn("action", change)
    if parts:
        empty = spark.createDataFrame([(p, None, 0, REPLACE) for p in parts], "part string, commit string, n long, action string")
        rows = rows.unionByName(empty.join(rows.select("part"), "part", "left_anti").select(*rows.columns))
    if isinstance(action, str) and action == RESET:
        rows = rows.unionByName(spark.createDataFrame([(None, None, 0, RESET)], "part string, commit string, n long, action string"))
    # one file: the write becomes visible as a whole
    rows.select(F.lit(version).cast("long").alias("version"), "action", F.lit(grain).alias("grain"), "part", "commit", "n",
                F.lit(note).cast("string").alias("note")).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def read(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None,
         lo: str | None = None, hi: str | None = None) -> DataFrame:
    """The table as of ``version``; with ``lo`` / ``hi`` only the partitions
    from ``lo`` to ``hi`` (as text) are looked up and listed. A filter on the
    partition column prunes as on any partitioned table."""
    entries = manifest(spark, path)
    live = live_parts(entries, version)
    if lo is not None:
        live = live.where(F.col("part") >= lo)
    if hi is not None:
        live = live.where(F.col("part") <= hi)
    sizes = entries.where("commit IS NOT NULL").groupBy("commit").agg(F.count(F.lit(1)).alias("of"), F.max("grain").alias("grain"))
    rows = live.join(sizes, "commit").collect()                              # one row per live partition
    if not rows:
        return spark.createDataFrame([], schema)
    commits: dict[str, list] = {}
    for r in rows:
        commits.setdefault(r["commit"], []).append(r)
    folders = []
    for commit, own in sorted(commits.items()):
        root = f"{path}/data/commit={commit}"
        folders += [root] if len(own) == own[0]["of"] else [f"{root}/{r['grain']}={r['part']}" for r in own]
    full = T.StructType([*schema.fields, T.StructField("commit", T.StringType())])
    return spark.read.schema(full).option("basePath", f"{path}/data").parquet(*folders).select(*schema.names)


def folders_per_part(spark: SparkSession, path: str) -> DataFrame:
    """(part, folders, n): how many writes a live partition is made of."""
    return live_parts(manifest(spark, path)).groupBy("part").agg(F.count(F.lit(1)).alias("folders"), F.sum("n").alias("n"))


def compact(spark: SparkSession, path: str, schema: T.StructType, most: int = 1, merge=lambda df: df) -> list[str]:
    """Rewrite every partition made of more than ``most`` writes as one, as the
    next version; its names. ``merge`` may sum up rows while they are rewritten."""
    grain = grain_of(spark, path)
    parts = sorted(r["part"] for r in folders_per_part(spark, path).where(F.col("folders") > most).collect())
    if parts:
        rows = read(spark, path, schema, lo=parts[0], hi=parts[-1])
        own = F.col(grain).cast("string").isin(parts)
        write(merge(rows.where(own)).select(*schema.names), path, grain, REPLACE, parts, last_note(spark, path))
    return parts


def unused_folders(spark: SparkSession, path: str, since: int) -> DataFrame:
    """Folders that no version from ``since`` on reads: free to delete."""
    entries = manifest(spark, path)
    folder = F.concat(F.lit(f"{path}/data/commit="), "commit", F.lit("/"), "grain", F.lit("="), "part").alias("folder")
    old = entries.where((F.col("version") <= since) & F.col("commit").isNotNull())
    kept = live_parts(entries, since).select("part", "commit")
    return old.join(kept, ["part", "commit"], "left_anti").select(folder)
