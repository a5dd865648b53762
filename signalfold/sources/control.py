"""Control-plane tables as append-only inputs: ingest keys, releases, source-map artifacts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalfold.scale import broadcast_if_small


def live_projects(keys: DataFrame, projects: DataFrame) -> DataFrame:
    """public_key -> project, live keys only."""
    live = keys.filter(F.col("revoked_at").isNull()).select("public_key", "project_id")
    return live.join(broadcast_if_small(projects), "project_id")


def resolve_keys(items: DataFrame, keys: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with their project, items whose key is unknown or revoked)."""
    known = broadcast_if_small(live_projects(keys, projects))
    matched = items.join(known, "public_key")
    rejected = items.join(known.select("public_key"), "public_key", "left_anti")
    return matched, rejected.withColumn("reason", F.lit("unknown or revoked key"))


def fold_releases(uploads: DataFrame) -> DataFrame:
    """One row per (project, version); a blank ref never replaces a known one."""
    named = F.nullif("ref", F.lit(""))
    return uploads.groupBy("project_id", "version").agg(
        F.coalesce(
            F.max_by(named, F.when(named.isNotNull(), F.col("uploaded_at"))), F.lit("")
        ).alias("ref")
    )


def fold_release_files(uploads: DataFrame) -> DataFrame:
    """Latest upload of every (project, version, url_pattern)."""
    rest = ("artifact_key", "size_bytes", "checksum")
    return (
        uploads.groupBy("project_id", "version", "url_pattern")
        .agg(F.max_by(F.struct(*rest), F.struct("uploaded_at", *rest)).alias("_f"))
        .select("project_id", "version", "url_pattern", "_f.*")
    )


def files_of_releases(files: DataFrame, releases: DataFrame) -> DataFrame:
    """Artifacts with their release's ref; files of unknown releases drop out."""
    return files.join(releases, ["project_id", "version"])


def load_artifacts(
    spark: SparkSession, folder: str, project_id: int, version: str, url_prefix: str, ref: str = ""
) -> DataFrame:
    """Every `.map` file below a folder as an artifact row, bytes included.

    The pattern is what the browser calls the minified file: prefix, relative path, no `.map`.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.map")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    # Paths come back with a scheme; the folder may have been given without one.
    bare_root = re.sub(r"^[A-Za-z0-9+.-]+:/*", "/", folder.rstrip("/"))
    bare_path = F.regexp_replace("path", r"^[A-Za-z0-9+.-]+:/*", "/")
    relative = F.substring(bare_path, len(bare_root) + 2, 1 << 20)
    pattern = F.concat(
        F.lit(url_prefix.removesuffix("/") + "/"),
        F.regexp_replace(relative, r"\.map\z", ""),
    )
    checksum = F.sha2("content", 256)
    return files.select(
        F.lit(project_id).cast("long").alias("project_id"),
        F.lit(version).alias("version"),
        F.lit(ref).alias("ref"),
        pattern.alias("url_pattern"),
        F.concat(
            F.lit(f"sourcemaps/{project_id}/{version}/"), checksum, F.lit(".map")
        ).alias("artifact_key"),
        F.col("length").alias("size_bytes"),
        checksum.alias("checksum"),
        F.col("modificationTime").alias("uploaded_at"),
        "content",
    )
