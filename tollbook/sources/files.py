"""Folders of a store: their files, and whether they are there."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import SparkSession

from tollbook.schemas import EVENT_MONTH


def _location(spark: SparkSession, path: str):
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, path: str) -> bool:
    location, system = _location(spark, path)
    return system.exists(location)


def remove_folder(spark: SparkSession, path: str) -> None:
    location, system = _location(spark, path)
    system.delete(location, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, none if that is missing."""
    location, system = _location(spark, path)
    if not system.exists(location):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(location) if s.isDirectory())


def month_signatures(files: Iterable[str]) -> dict[str, str]:
    """A digest of the file names of each month of the fact table; it changes with every append."""
    names = defaultdict(list)
    for file in files:
        folder, name = file.split("/")[-2:]
        names[folder.removeprefix(f"{EVENT_MONTH}=")].append(name)
    return {month: hashlib.sha256("\n".join(sorted(own)).encode()).hexdigest() for month, own in names.items()}
