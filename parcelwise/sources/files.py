"""Which files of an export make up which table. Only names are looked at, never contents."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import SparkSession

# File stems of the delimited roll.
ACCOUNT_STEM, BUILDING_STEM, FIXTURE_STEM = "real_acct", "building_res", "fixtures"
FEATURE_STEM, FEATURE_DETAIL_PREFIX, LOOKUP_PREFIX = "extra_features", "extra_features_detail", "desc_"


def list_files(spark: SparkSession, root: str, suffix: str = "") -> list[str]:
    """Paths under ``root`` on whatever file system it names, sorted."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found, walk = [], fs.listFiles(path, True)
    while walk.hasNext():
        name = walk.next().getPath().toString()
        if name.upper().endswith(suffix.upper()):
            found.append(name)
    return sorted(found)


def stem(path: str) -> str:
    return re.sub(r"\.[^./]*$", "", path.rsplit("/", 1)[-1]).lower()


def table_of(path: str) -> str | None:
    """Table a roll file belongs to; lookup and unknown files belong to none."""
    name = stem(path)
    if name.startswith(LOOKUP_PREFIX):
        return None
    if name in (ACCOUNT_STEM, BUILDING_STEM, FIXTURE_STEM, FEATURE_STEM):
        return name
    return FEATURE_STEM if name.startswith(FEATURE_DETAIL_PREFIX) else None


def table_files(paths: Sequence[str], table: str) -> list[str]:
    """Files of one table in name order; feature detail files replace the feature summary."""
    mine = sorted(p for p in paths if table_of(p) == table)
    if table == FEATURE_STEM and any(stem(p).startswith(FEATURE_DETAIL_PREFIX) for p in mine):
        mine = [p for p in mine if stem(p) != FEATURE_STEM]
    return mine


def missing_account_files(paths: Sequence[str]) -> list[str]:
    return [] if ACCOUNT_STEM in {stem(p) for p in paths} else ["real_acct.txt"]


def missing_building_files(paths: Sequence[str]) -> list[str]:
    """Names of required building-roll files that are absent."""
    have = {stem(p) for p in paths}
    missing = [f"{s}.txt" for s in (BUILDING_STEM, FIXTURE_STEM) if s not in have]
    if not any(s == FEATURE_STEM or s.startswith(FEATURE_DETAIL_PREFIX) for s in have):
        missing.append("extra_features*.txt")
    return missing


def require_files(missing: Sequence[str], root: str) -> None:
    if missing:
        raise FileNotFoundError(f"required files missing under {root}: {', '.join(missing)}")


def newest_copy(paths: Sequence[str], filename: str) -> str | None:
    """The newest of several timestamp-prefixed copies: ISO prefixes sort as text."""
    matches = [p for p in paths if p.endswith(filename)]
    return max(matches) if matches else None


def year_directories(root: str, start_year: int, end_year: int) -> dict[int, str]:
    """One directory per tax year, both ends included."""
    if start_year > end_year:
        raise ValueError("start year must not be after end year")
    return {year: f"{root.rstrip('/')}/{year}" for year in range(start_year, end_year + 1)}
