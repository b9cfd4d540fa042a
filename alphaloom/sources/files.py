"""Small texts and version manifests on any file system that Spark can write to."""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.sql import SparkSession


def folder(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def put(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small text beside its path and renames it there; false if the path is taken."""
    fs, place = folder(spark, path)
    aside = place.suffix(f".{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(place) and fs.rename(aside, place):
        return True
    fs.delete(aside, False)
    return False


def get(spark: SparkSession, path: str) -> str:
    fs, place = folder(spark, path)
    read = fs.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(read)).decode()
    finally:
        read.close()


def manifests(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed versions under a path, the newest last."""
    fs, place = folder(spark, path)
    if not fs.exists(place):
        return []
    return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(place)) if re.fullmatch(r"manifest-\d{6}", n))


def newest(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The newest committed manifest under a path, if there is any."""
    found = manifests(spark, path)
    return json.loads(get(spark, f"{path}/{found[-1]}")) if found else None


def commit(spark: SparkSession, path: str, manifest: dict[str, Any], after: int | None = None) -> int:
    """Puts the next manifest in place and gives its number. With ``after``, fails if another version than that is the newest by now."""
    last = int(([None, *manifests(spark, path)][-1] or "manifest-0").rsplit("-", 1)[1])
    version = last + 1 if after is None else after + 1
    while not put(spark, f"{path}/manifest-{version:06d}", json.dumps(manifest, indent=2)):
        if after is not None:
            raise RuntimeError(f"{path} was changed by another writer")
        version += 1
    return version


def tidy(spark: SparkSession, path: str, keep: set[str], pattern: str) -> None:
    """Removes what matches the pattern under a path, but the newest manifest and what is to be kept."""
    fs, place = folder(spark, path)
    keep = keep | set(manifests(spark, path)[-1:])
    for f in fs.listStatus(place):
        name = f.getPath().getName()
        if name not in keep and re.match(pattern, name):
            fs.delete(f.getPath(), True)
