"""Whole groups of tables: reading, writing with their description, copying."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..model import TableGroup, is_url
from ..sources import dsv
from .scan import Scan, scan, texts, write_table


def read_group(spark: SparkSession, group: TableGroup, strict_header: bool = True) -> dict[str, Scan]:
    """A lazy scan of each table, by URL."""
    return {t.url: scan(spark, t, strict_header=strict_header) for t in group.tables}


def write_group(group: TableGroup, frames: dict[str, DataFrame], description: str | Path, zipped: bool = False, folders: bool = False) -> dict[str, int]:
    """Write the description and, beside it, the file of each table that has a frame (by tasks, part
    by part, then joined); with ``folders`` a folder of parts for each, which a scan reads as well.

    Returns the number of rows written by URL."""
    folder = Path(description).parent
    folder.mkdir(parents=True, exist_ok=True)
    counts = {}
    for t in group.tables:
        if t.url in frames:
            where = folder / t.url
            where.parent.mkdir(parents=True, exist_ok=True)
            if folders:
                df = frames[t.url]
                made = texts(t, df.orderBy("rownum") if "rownum" in df.columns else df)
                counts[t.url] = dsv.write_dir(made, str(where), t.effective_dialect)
                continue
            counts[t.url] = write_table(t, frames[t.url], str(where), zipped)
    group.to_file(description)
    return counts


def copy_group(group: TableGroup, folder: str | Path) -> TableGroup:
    """Copy the description and the local files (zipped ones too) into a folder."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    for t in group.tables:
        if is_url(t.location):
            continue
        for suffix in ("", ".zip"):
            if os.path.exists(t.location + suffix):
                target = folder / (t.url + suffix)
                target.parent.mkdir(parents=True, exist_ok=True)
                shutil.copy(t.location + suffix, target)
    name = Path(group.base).name if group.base and not is_url(group.base) else "metadata.json"
    group.to_file(folder / name)
    return TableGroup.from_file(folder / name)
