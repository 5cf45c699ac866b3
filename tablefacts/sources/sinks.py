"""Writing results: plain frames, JSON profiles, and landings that switch at once."""

from __future__ import annotations

import json
import time
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

from ..operators.profile import profile_to_json
from ..session import shared_folder
from .workspace import load_table

MANIFESTS = "_landings"
"""Subfolder of the manifests, one small JSON file per landing; Spark's readers skip it."""

GRACE = 24 * 3600
"""Folders without a manifest stay so many seconds after their last file, as a landing that
still runs has none either."""


def write_frames(frames: dict[str, DataFrame], folder: str, file_format: str = "parquet") -> None:
    """Write every named frame to its own subfolder as parquet, orc or json."""
    for name, frame in frames.items():
        frame.write.format(file_format).mode("errorifexists").save(f"{folder.rstrip('/')}/{name}")


def write_profile_json(profile: DataFrame, folder: str) -> None:
    """One JSON document per table, one per line."""
    profile_to_json(profile).select("json").write.mode("errorifexists").text(folder)


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _children(spark: SparkSession, folder: str) -> list[str]:
    files, place = _path(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def manifests(spark: SparkSession, folder: str) -> list[dict]:
    """The landings of a folder, oldest first: ``number``, ``folder`` and ``tables``."""
    place = f"{folder.rstrip('/')}/{MANIFESTS}"
    names = [n for n in _children(spark, place) if n.endswith(".json") and not n.startswith((".", "_"))]
    if not names:
        return []
    rows = spark.read.option("wholetext", "true").text([f"{place}/{n}" for n in names]).collect()
    return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["number"])


def _commit(spark: SparkSession, folder: str, manifest: dict) -> None:
    """Write a manifest under another name, then give it its own. The rename shows all of
    it or nothing, and fails if another landing took the number."""
    place = f"{folder}/{MANIFESTS}"
    files, draft = _path(spark, f"{place}/_{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    _, final = _path(spark, f"{place}/{manifest['number']:010d}.json")
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise FileExistsError(f"another landing was committed to {folder} meanwhile")


def land(spark: SparkSession, tables: dict[str, DataFrame], folder: str | None = None) -> dict[str, DataFrame]:
    """Write the tables as parquet and return them read back, by default below the shared
    folder of the session. Text grids are parsed again by every query until landed.

    A landing writes to a new subfolder; a manifest then names it, which switches readers
    (:func:`landed`) from the landing before to all new tables at once. A run that dies leaves
    the old landing as it was, and files that :func:`sweep` removes."""
    folder = (folder or shared_folder(spark)).rstrip("/")
    before = manifests(spark, folder)
    own = f"landing-{uuid.uuid4().hex}"
    write_frames({f"{name}.parquet": table for name, table in tables.items()}, f"{folder}/{own}")
    number = before[-1]["number"] + 1 if before else 1
    _commit(spark, folder, {"number": number, "folder": own, "tables": list(tables)})
    return landed(spark, folder)


def landed(spark: SparkSession, folder: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of the newest landing in a folder, or of an earlier one."""
    found = [m for m in manifests(spark, folder) if number is None or m["number"] == number]
    if not found:
        raise FileNotFoundError(f"no landing in {folder}" if number is None else f"no landing {number} in {folder}")
    root = f"{folder.rstrip('/')}/{found[-1]['folder']}"
    return {name: load_table(spark, f"{root}/{name}.parquet", "parquet") for name in found[-1]["tables"]}


def _last_write(spark: SparkSession, folder: str) -> float:
    files, place = _path(spark, folder)
    found, last = files.listFiles(place, True), files.getFileStatus(place).getModificationTime()
    while found.hasNext():
        last = max(last, found.next().getModificationTime())
    return last / 1000


def sweep(spark: SparkSession, folder: str, keep: int = 1, grace: float = GRACE) -> list[str]:
    """Remove the landings before the last ``keep``, and what landings that never ended left
    behind, if nothing was written there for ``grace`` seconds. Other files stay. Returns the
    names of the removed subfolders."""
    if keep < 1:
        raise ValueError("the newest landing stays")
    folder = folder.rstrip("/")
    known = manifests(spark, folder)
    old, kept = known[:-keep], {m["folder"] for m in known[-keep:]}
    for m in old:  # no manifest may name a folder that is gone
        files, place = _path(spark, f"{folder}/{MANIFESTS}/{m['number']:010d}.json")
        files.delete(place, False)
    replaced, removed = {m["folder"] for m in old}, []
    for name in _children(spark, folder):
        path = f"{folder}/{name}"
        if not name.startswith("landing-") or name in kept:
            continue
        if name in replaced or _last_write(spark, path) <= time.time() - grace:
            files, place = _path(spark, path)
            files.delete(place, True)
            removed.append(name)
    return removed
