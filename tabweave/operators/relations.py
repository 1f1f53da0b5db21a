"""Tables in Spark's catalog, with association tables for lists that are foreign keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import Compiled
from ..model import ForeignKey, Table, TableGroup
from ..staging import stage, unstage
from .keys import VIOLATION, _number, check_foreign_key, check_primary_key
from .scan import array_type, compiled_type, scan


def default_name(table: Table) -> str:
    from ..sources.dialect import normal_name

    return normal_name(table.url.rsplit("/", 1)[-1].rsplit(".", 1)[0])


@dataclass(frozen=True)
class Association:
    """A list of references as a table (own key, target key, context, position)."""

    name: str
    owner: str
    column: str
    target: str
    own_key: str
    target_key: str
    context: str


@dataclass
class TablePlan:
    """What a table becomes in the catalog."""

    name: str
    table: Table
    columns: dict[str, str] = field(default_factory=dict)
    not_null: list[str] = field(default_factory=list)
    key: list[str] = field(default_factory=list)
    foreign: list[ForeignKey] = field(default_factory=list)
    associations: list[Association] = field(default_factory=list)
    #: What the columns are called in the catalog, by header.
    names: dict[str, str] = field(default_factory=dict)

    def ddl(self, database: str | None = None, name: str | None = None) -> str:
        lines = [f"`{self.names.get(c, c)}` {t}{' NOT NULL' if c in self.not_null or c in self.key else ''}" for c, t in self.columns.items()]
        place = f"`{database}`." if database else ""
        return f"CREATE TABLE {place}`{name or self.name}` ({', '.join(lines)}) USING parquet"

    def rows(self, df: DataFrame) -> DataFrame:
        """A frame's rows as those of the table; columns that it lacks are null."""
        return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(self.names.get(c, c)) for c, t in self.columns.items()])

    def headers(self, df: DataFrame) -> DataFrame:
        """The table's rows under the headers of its columns."""
        return df.select(*[F.col(f"`{self.names.get(c, c)}`").alias(c) for c in self.columns])


def plan_tables(
    group: TableGroup,
    name: Callable[[Table], str] = default_name,
    keep_self_references: bool = False,
    column: Callable[[Table, str], str] = lambda table, header: header,
    context: Callable[[Table, str], str] = lambda table, header: header,
) -> list[TablePlan]:
    """Catalog tables in an order in which parents come before their children.

    ``name`` and ``column`` say what tables and columns are called there, ``context`` what the rows of
    an association table tell about the list that they come from."""
    plans, graph = {}, {}
    for t in group.tables:
        p = TablePlan(name(t), t)
        p.key = [t.schema.column(k).header for k in t.schema.primary_key]
        lists = {}
        for key in t.schema.foreign_keys:
            parent = group.table(key.resource) if key.resource else None
            if parent is None or (parent is t and not keep_self_references and t.schema.column(key.columns[0]).inherit("separator") is None):
                continue
            listed = t.schema.column(key.columns[0])
            if len(key.columns) == 1 and listed.inherit("separator") is not None:
                if len(p.key) != 1:
                    raise ValueError(f"{t.url}: a list of references needs a primary key of one column")
                lists[listed.header] = (parent, parent.schema.column(key.target[0]).header)
            else:
                p.foreign.append(key)
        for c in t.schema.columns:
            if c.virtual or c.header in lists:
                continue
            p.columns[c.header], p.names[c.header] = array_type(c), column(t, c.header)
            if c.inherit("required"):
                p.not_null.append(c.header)
        if len(set(p.names.values())) < len(p.names):
            raise ValueError(f"{t.url}: two columns would have one name: {sorted(p.names.values())}")
        for header, (parent, target_key) in lists.items():
            own, other = p.name, name(parent)
            clash = own == other
            p.associations.append(Association(f"{own}_{other}", own, header, other, f"{own}_{column(t, p.key[0])}" + "_1" * clash, f"{other}_{column(parent, target_key)}" + "_2" * clash, context(t, header)))
        plans[t.url] = p
        graph[t.url] = {k.resource for k in t.schema.foreign_keys if k.resource and k.resource != t.url and group.table(k.resource)}
    try:
        order = list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise ValueError(f"tables refer to each other in a circle: {e.args[1]}") from e
    return [plans[u] for u in order]


def association_rows(plan: TablePlan, df: DataFrame) -> dict[str, DataFrame]:
    """Rows of the association tables of a table; ``position`` is the place in the list."""
    out: dict[str, DataFrame] = {}
    for a in plan.associations:
        rows = df.select(F.col(f"`{plan.key[0]}`").alias(a.own_key), F.posexplode(F.col(f"`{a.column}`")).alias("position", a.target_key))
        rows = rows.select(a.own_key, a.target_key, F.lit(a.context).alias("context"), "position")
        out[a.name] = out[a.name].union(rows) if a.name in out else rows
    return out


def _complaint(kind: Compiled) -> Callable[[Column], Column]:
    def first(v: Column) -> Column:
        out = F.lit(None).cast("string")
        for fails, message in reversed(kind.checks):
            out = F.when(fails(v, kind.format(v)), F.lit(message)).otherwise(out)
        return out

    return first


def check_values(table: Table, df: DataFrame) -> DataFrame:
    """A violation for each typed value (or item of a list) outside the bounds and lengths of its
    column's datatype."""
    found = []
    for c in table.schema.columns:
        if c.virtual or c.header not in df.columns:
            continue
        kind, value = compiled_type(c), F.col(f"`{c.header}`")
        if not kind.checks:
            continue
        complaint = _complaint(kind)
        wrong = F.array_compact(F.transform(value, complaint) if c.inherit("separator") is not None else F.array(complaint(value)))
        found.append(F.when(F.size(wrong) > 0, F.struct(F.lit(c.header).alias("columns"), F.get(wrong, F.lit(0)).alias("message"))))
    rows = df.select(_number(df).alias("sourcenum"), F.explode(F.array_compact(F.array(*found))).alias("e")) if found else None
    if rows is None:
        return df.sparkSession.createDataFrame([], VIOLATION)
    return rows.select(F.lit("check").alias("kind"), F.lit(table.url).alias("url"), "sourcenum", "e.columns", "e.message")


def with_lists(plan: TablePlan, df: DataFrame, associations: dict[str, DataFrame]) -> DataFrame:
    """Rows with their lists of references again, in order; absent lists are empty."""
    for a in plan.associations:
        items = F.transform(F.sort_array(F.collect_list(F.struct("position", F.col(f"`{a.target_key}`").alias("v")))), lambda x: x["v"])
        lists = associations[a.name].filter(F.col("context") == a.context).groupBy(F.col(f"`{a.own_key}`").alias("_tw_key")).agg(items.alias(a.column))
        kind = array_type(plan.table.schema.column(a.column))
        joined = df.join(lists, df[f"`{plan.key[0]}`"] == lists["_tw_key"], "left").drop("_tw_key")
        df = joined.withColumn(a.column, F.coalesce(F.col(f"`{a.column}`"), F.array().cast(kind)))
    return df


def violations(spark: SparkSession, group: TableGroup, frames: dict[str, DataFrame], plans: list[TablePlan]) -> DataFrame:
    """What would break a constraint of the tables: keys, references, required columns."""
    found = spark.createDataFrame([], VIOLATION)
    for p in plans:
        df = frames[p.table.url]
        found = found.union(check_primary_key(p.table, df)).union(check_values(p.table, df))
        for key in p.table.schema.foreign_keys:
            parent = group.table(key.resource) if key.resource else None
            if parent is not None:
                found = found.union(check_foreign_key(df, p.table, key, frames[parent.url], parent))
        for c in {*p.not_null, *p.key}:
            none = df.filter(F.col(f"`{c}`").isNull())
            found = found.union(none.select(F.lit("not null").alias("kind"), F.lit(p.table.url).alias("url"), _number(df).alias("sourcenum"), F.lit(c).alias("columns"), F.lit("a required value is missing").alias("message")))
    return found


def write_tables(
    spark: SparkSession,
    group: TableGroup,
    database: str,
    frames: dict[str, DataFrame] | None = None,
    force: bool = False,
    name: Callable[[Table], str] = default_name,
    skip_extra: bool = False,
    column: Callable[[Table, str], str] = lambda table, header: header,
    context: Callable[[Table, str], str] = lambda table, header: header,
    refused: str | None = None,
) -> list[TablePlan]:
    """Check all constraints, then write every table and association table, or none.

    Each frame is evaluated once, into the shared folder; what was written there is checked and then
    copied into tables under other names, with NOT NULL where the plan says so.  Only when all are there
    do they take the places of the old ones; if anything fails before that, these are as they were.

    Rows that break a constraint are an error; with ``refused`` all of them (kind, url, sourcenum,
    columns, message) go to a table of that name first.  Existing tables are an error unless ``force``;
    columns that are not described are one unless ``skip_extra``."""
    plans = plan_tables(group, name, column=column, context=context)
    frames = frames or {t.url: scan(spark, t, strict_header=False).strict for t in group.tables}
    for p in plans:
        extra = set(frames[p.table.url].columns) - {c.header for c in p.table.schema.columns} - {"rownum", "sourcenum"}
        if extra and not skip_extra:
            raise ValueError(f"{p.table.url}: columns that are not described: {sorted(extra)}")
    names = [p.name for p in plans] + sorted({a.name for p in plans for a in p.associations})
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    there = {t.name for t in spark.catalog.listTables(database) if not t.isTemporary}  # views of the session are no tables
    if not force and (clash := there & {n.lower() for n in names}):
        raise ValueError(f"tables are there already: {sorted(clash)}")
    once = {}
    try:
        for p in plans:
            once[p.table.url] = stage(spark, frames[p.table.url], p.name)
        found = violations(spark, group, once, plans)
        if refused:
            found.write.mode("overwrite").saveAsTable(f"`{database}`.`{refused}`")
            found = spark.table(f"`{database}`.`{refused}`")
        broken = found.limit(5).collect()
        if broken:
            raise ValueError("; ".join(f"{b.kind} in {b.url}: {b.message}" for b in broken))
        linked: dict[str, DataFrame] = {}
        for p in plans:
            for n, rows in association_rows(p, once[p.table.url]).items():
                linked[n] = linked[n].unionByName(rows) if n in linked else rows
        _write_all(spark, database, [(p.name, p.ddl, p.rows(once[p.table.url])) for p in plans] + [(n, None, rows) for n, rows in linked.items()])
    finally:
        for df in once.values():
            unstage(spark, df)
    return plans


def _write_all(spark: SparkSession, database: str, tables: list[tuple[str, Callable | None, DataFrame]]) -> None:
    """Write tables under names of their own, then let all of them take their places.

    A failure while rows are written leaves the old tables; one while names change brings them back."""
    place = lambda n: f"`{database}`.`{n}`"
    mark = uuid.uuid4().hex[:12]
    new, old, moved = {n: f"{n}_tw_new_{mark}" for n, _, _ in tables}, {n: f"{n}_tw_old_{mark}" for n, _, _ in tables}, []
    try:
        for n, ddl, rows in tables:
            if ddl is not None:
                spark.sql(ddl(database, new[n]))
                rows.write.insertInto(place(new[n]))
            else:
                rows.write.saveAsTable(place(new[n]))
        for n, _, _ in tables:
            if spark.catalog.tableExists(f"{database}.{n}"):
                spark.sql(f"ALTER TABLE {place(n)} RENAME TO {place(old[n])}")
                moved.append((old[n], n))
            spark.sql(f"ALTER TABLE {place(new[n])} RENAME TO {place(n)}")
            moved.append((n, new[n]))
    except BaseException:
        for now, before in reversed(moved):
            spark.sql(f"ALTER TABLE {place(now)} RENAME TO {place(before)}")
        raise
    finally:
        for n in [*new.values(), *old.values()]:
            spark.sql(f"DROP TABLE IF EXISTS {place(n)}")


def read_tables(spark: SparkSession, database: str, plans: list[TablePlan]) -> dict[str, DataFrame]:
    """The tables again, lists of references in their order; absent lists are empty."""
    out = {}
    for p in plans:
        linked = {a.name: spark.table(f"`{database}`.`{a.name}`") for a in p.associations}
        out[p.table.url] = with_lists(p, p.headers(spark.table(f"`{database}`.`{p.name}`")), linked)
    return out
