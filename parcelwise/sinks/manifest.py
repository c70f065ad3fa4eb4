"""Several tables published by one step.

A folder of tables holds, for each table, one sub-folder per version, and in ``_manifests`` a numbered file per commit. A
manifest names, for every table, the folders its rows lie in: one for a table replaced as a whole, and for a table
replaced by slices the partitions each commit wrote, so that a load of one county and year writes only these. Tables are
written first, each into fresh folders nobody reads; then the next manifest is moved to its name in one rename, which
fails if the name is taken. Readers go by the newest manifest, so they see all tables of a load or none of them,
whenever a load ends; a killed one leaves folders that :func:`clean` removes.

Two loads at once: the one that comes second bases its manifest on the first one's and tries the next number.

Nothing passes through the driver but names of folders: their number is that of slices, not of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFESTS = "_manifests"
ATTEMPTS = 20


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder, none if there is no such folder."""
    p, fs = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    names = _names(spark, f"{folder}/{MANIFESTS}")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def _load(spark: SparkSession, folder: str, number: int) -> dict:
    p, fs = _hadoop(spark, f"{folder}/{MANIFESTS}/{number:012d}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def current(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the newest manifest; ``(0, {})`` before the first commit."""
    numbers = _numbers(spark, folder)
    return (numbers[-1], _load(spark, folder, numbers[-1])) if numbers else (0, {})


def _place(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Write a manifest aside and move it to its number; false if another commit has that number."""
    jvm = spark.sparkContext._jvm
    draft, fs = _hadoop(spark, f"{folder}/{MANIFESTS}/draft-{uuid.uuid4().hex}")
    target, _ = _hadoop(spark, f"{folder}/{MANIFESTS}/{number:012d}.json")
    out = fs.create(draft, False)
    try:
        out.write(json.dumps(content, indent=1).encode())
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, target, options)
    except Exception as error:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(error):
            return False
        raise
    return True


def _slices(spark: SparkSession, path: str, depth: int) -> list[str]:
    """The partition folders of a written version, as ``a=1/b=2``."""
    found = [""]
    for _ in range(depth):
        found = [f"{f}/{n}".lstrip("/") for f in found for n in _names(spark, f"{path}/{f}") if "=" in n]
    return found


def commit(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], slices: Mapping[str, Sequence[str]] | None = None) -> int:
    """Publish all ``tables`` by one new manifest and return its number.

    A table named in ``slices`` has those columns as partitions, and keeps the partitions that the new rows do not have;
    any other table is replaced whole. Tables that are not given stay as they are.
    """
    slices, written = slices or {}, {}
    for name, rows in tables.items():
        by = list(slices.get(name, ()))
        version = f"{name}/v-{uuid.uuid4().hex}"
        rows.write.partitionBy(*by).parquet(f"{folder}/{version}")
        parts = _slices(spark, f"{folder}/{version}", len(by)) if by else [""]
        written[name] = {"by": by, "schema": rows.schema.jsonValue(), "parts": [[version, p] for p in parts]}
    _make_manifests(spark, folder)
    for _ in range(ATTEMPTS):
        number, content = current(spark, folder)
        merged = dict(content)
        for name, new in written.items():
            old = content.get(name)
            kept = []
            if new["by"] and old and old["by"] == new["by"]:
                replaced = {p for _, p in new["parts"]}
                kept = [part for part in old["parts"] if part[1] not in replaced]
            merged[name] = new | {"parts": kept + new["parts"]}
        if _place(spark, folder, number + 1, merged):
            return number + 1
    raise RuntimeError(f"no commit in {ATTEMPTS} attempts: {folder} is written by others all the time")


def _make_manifests(spark: SparkSession, folder: str) -> None:
    p, fs = _hadoop(spark, f"{folder}/{MANIFESTS}")
    fs.mkdirs(p)


def read(spark: SparkSession, folder: str, name: str, number: int | None = None) -> DataFrame:
    """A table as of the newest manifest, or of manifest ``number``."""
    content = current(spark, folder)[1] if number is None else _load(spark, folder, number)
    entry = content[name]
    schema = T.StructType.fromJson(entry["schema"])
    by_version: dict[str, list[str]] = {}
    for version, part in entry["parts"]:
        by_version.setdefault(version, []).append(part)
    out = spark.createDataFrame([], schema)
    for version, parts in by_version.items():
        base = f"{folder}/{version}"
        reader = spark.read.schema(schema).option("basePath", base)
        out = out.unionByName(reader.parquet(*[f"{base}/{p}" if p else base for p in parts]))
    return out


def clean(spark: SparkSession, folder: str, keep: int = 1) -> list[str]:
    """Delete the versions that none of the newest ``keep`` manifests names, and older manifests; returns what went.

    For times without a running load: its versions are not named yet.
    """
    numbers = _numbers(spark, folder)
    held = {version for n in numbers[-keep:] for entry in _load(spark, folder, n).values() for version, _ in entry["parts"]}
    gone = [f"{MANIFESTS}/{n:012d}.json" for n in numbers[:-keep]]
    for table in _names(spark, folder):
        if table != MANIFESTS:
            gone += [v for v in (f"{table}/{n}" for n in _names(spark, f"{folder}/{table}")) if v not in held]
    for path in gone:
        p, fs = _hadoop(spark, f"{folder}/{path}")
        fs.delete(p, True)
    return gone
