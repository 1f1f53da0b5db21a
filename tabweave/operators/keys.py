"""Primary and foreign keys: violations as data."""

from __future__ import annotations

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ForeignKey, Table, TableGroup
from ..staging import stage
from .scan import Scan, scan

VIOLATION = "kind string, url string, sourcenum long, columns string, message string"


def _key(columns: list[str]) -> Expr:
    return F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]), {"ignoreNullFields": "false"})


def _number(df: DataFrame) -> Expr:
    return F.col("sourcenum") if "sourcenum" in df.columns else F.lit(None).cast("long")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """(key columns, n): keys that more than one row has; nulls equal each other.

    Counts are added up before rows move, so a key that a third of all rows have is one row
    a task."""
    return df.groupBy(*[F.col(f"`{c}`") for c in key]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_primary_key(table: Table, df: DataFrame, ties: bool = False) -> DataFrame:
    """A violation for every row but the first (by ``rownum``, then ``sourcenum``) of a key.

    Only the first place of each repeated key is joined back, so no key's rows have to
    meet in one task as in a window.  Scans number rows over all files of a table; a frame whose
    rows may share a ``rownum`` and ``sourcenum`` needs ``ties``: of rows with equal ones all but one count as
    later ones.  Rows without a ``rownum`` are numbered first, in a table of their keys that is
    written once, so that both sides of the join see the same numbers."""
    key = [table.schema.column(k).header for k in table.schema.primary_key]
    spark, numbered = df.sparkSession, "rownum" in df.columns
    if not key:
        return spark.createDataFrame([], VIOLATION)
    number = F.col("rownum") if numbered else F.monotonically_increasing_id()
    place = F.struct(number.alias("rownum"), _number(df).alias("sourcenum")) if ties else number
    rows = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key)], place.alias("place"), _number(df).alias("sourcenum"), _key(key).alias("shown"))
    rows = rows if numbered else stage(spark, rows, "keys")
    names = [f"k{i}" for i in range(len(key))]
    repeated = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).filter("n > 1").select(*[F.col(n).alias(f"r{n}") for n in names], "first")
    same = [F.col(n).eqNullSafe(F.col(f"r{n}")) for n in names]
    met = rows.join(repeated, same)
    found = met.filter(F.col("place") > F.col("first")).select("sourcenum", "shown")
    if ties:
        tied = met.filter(F.col("place") == F.col("first")).groupBy("sourcenum", "shown").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = found.union(tied.select("sourcenum", "shown", F.explode(F.sequence(F.lit(2), F.col("n")))).select("sourcenum", "shown"))
    return found.select(F.lit("primary key").alias("kind"), F.lit(table.url).alias("url"), "sourcenum", F.lit(",".join(key)).alias("columns"), F.concat(F.lit("duplicate key "), F.col("shown")).alias("message"))


def child_keys(df: DataFrame, table: Table, key: ForeignKey) -> DataFrame:
    """(k0, k1, ..., sourcenum) of a table's references; items of lists one by one.

    A null reference refers to nothing; a null item of a list is checked like any other."""
    headers = [table.schema.column(c).header for c in key.columns]
    listed = [table.schema.column(c).inherit("separator") is not None for c in key.columns]
    if len(headers) == 1 and listed[0]:
        return df.select(F.explode(F.col(f"`{headers[0]}`")).alias("k0"), _number(df).alias("sourcenum"))
    out = df.select(*[F.col(f"`{h}`").alias(f"k{i}") for i, h in enumerate(headers)], _number(df).alias("sourcenum"))
    for i in range(len(headers)):
        out = out.filter(F.col(f"k{i}").isNotNull())
    return out


def _fits_all_tasks(df: DataFrame) -> bool:
    """Is a frame, by what Spark knows of its size, within the session's bound of what is sent to all tasks?"""
    bound = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= bound


def check_foreign_key(child: DataFrame, table: Table, key: ForeignKey, parent: DataFrame, parent_table: Table) -> DataFrame:
    """A violation for every reference without a parent row.

    A parent whose keys are small enough to be sent to all tasks is anti-joined with the references as
    they are.  Otherwise only distinct references move: they are counted together before the shuffle (a
    reference that a third of all rows hold is one row a task), anti-joined, and those without a parent, one
    row each, are written down; the rows that hold them are found by a semi-join, for which Spark knows the
    size of what was written."""
    mine = child_keys(child, table, key)
    target = [parent_table.schema.column(c).header for c in key.target]
    theirs = parent.select(*[F.col(f"`{h}`").alias(f"p{i}") for i, h in enumerate(target)])
    same = [F.col(f"k{i}").eqNullSafe(F.col(f"p{i}")) for i in range(len(target))]
    if _fits_all_tasks(theirs):
        lost = mine.join(theirs, same, "left_anti")
    else:
        keys = mine.select(*[f"k{i}" for i in range(len(target))]).distinct()
        orphaned = stage(mine.sparkSession, keys.join(theirs, same, "left_anti").toDF(*[f"o{i}" for i in range(len(target))]), "orphaned")
        lost = mine.join(orphaned, [F.col(f"k{i}").eqNullSafe(F.col(f"o{i}")) for i in range(len(target))], "left_semi")
    shown = F.to_json(F.array(*[F.col(f"k{i}").cast("string") for i in range(len(target))]), {"ignoreNullFields": "false"})
    return lost.select(F.lit("foreign key").alias("kind"), F.lit(table.url).alias("url"), "sourcenum", F.lit(",".join(key.columns)).alias("columns"), F.concat(F.lit(f"no row in {parent_table.url} for "), shown).alias("message"))


def strict_checks(child: DataFrame, table: Table, key: ForeignKey, parent: DataFrame, parent_table: Table) -> DataFrame:
    """What only strict validation asks for: no null references, and unique parent keys."""
    headers = [table.schema.column(c).header for c in key.columns]
    missing = F.lit(False)
    for h in headers:
        missing = missing | F.col(f"`{h}`").isNull()
    nulls = child.filter(missing).select(F.lit("null reference").alias("kind"), F.lit(table.url).alias("url"), _number(child).alias("sourcenum"), F.lit(",".join(headers)).alias("columns"), F.lit("a reference is null").alias("message"))
    target = [parent_table.schema.column(c).header for c in key.target]
    twice = duplicate_keys(parent, target).select(F.lit("parent key").alias("kind"), F.lit(parent_table.url).alias("url"), F.lit(None).cast("long").alias("sourcenum"), F.lit(",".join(target)).alias("columns"), F.concat(F.lit("parent key is not unique: "), _key(target)).alias("message"))
    return nulls.union(twice)


def _keys_of(group: TableGroup, t: Table) -> list[str]:
    """The columns of a table that a key of the group reads."""
    names = [*t.schema.primary_key]
    for child, key in group.foreign_keys():
        names += key.columns if child is t else []
        names += key.target if group.table(key.resource) is t else []
    return list(dict.fromkeys(t.schema.column(n).header for n in names))


def checked_once(spark: SparkSession, group: TableGroup, t: Table, s: Scan) -> tuple[DataFrame, DataFrame]:
    """(complaints, keys of the rows without one) of a table, parsed in one pass.

    A table that no key reads needs no second look; of others, complaints and keys are written
    to the shared folder: narrow rows, whatever the table holds."""
    keys = _keys_of(group, t)
    if not keys:
        return s.errors, s.rows.limit(0)
    once = stage(spark, s.checked(*keys), "checked")
    return s.told(once), once.filter(F.size("_errors") == 0).drop("_errors")


def validate(spark: SparkSession, group: TableGroup, frames: dict[str, Scan] | None = None, strict: bool = True) -> DataFrame:
    """All violations of a group of tables: cells, primary keys, foreign keys.

    Each table is scanned and parsed once (see :func:`checked_once`); the report is one lazy
    DataFrame (kind, url, sourcenum, columns, message), empty for valid tables."""
    group.validate_schema()
    scans = frames or {t.url: scan(spark, t, strict_header=False) for t in group.tables}
    found = {t.url: checked_once(spark, group, t, scans[t.url]) for t in group.tables}
    report = spark.createDataFrame([], VIOLATION)
    for t in group.tables:
        cells, good = found[t.url]
        report = report.union(cells.select(F.lit("cell").alias("kind"), "url", "sourcenum", F.col("column").alias("columns"), "message"))
        if t.schema.primary_key:
            report = report.union(check_primary_key(t, good))
    for t, key in group.foreign_keys():
        parent = group.table(key.resource)
        pair = (found[t.url][1], t, key, found[parent.url][1], parent)
        report = report.union(check_foreign_key(*pair))
        if strict:
            report = report.union(strict_checks(*pair))
    return report


def is_valid(spark: SparkSession, group: TableGroup, frames: dict[str, Scan] | None = None) -> bool:
    """No warning about the headers and no violation."""
    import warnings

    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        found = validate(spark, group, frames).isEmpty()
    return found and not [w for w in seen if issubclass(w.category, UserWarning)]
