"""Catalogs of running databases as DataFrames, over JDBC or any Python DB-API driver.

A catalog query runs in as many tasks as asked for, each with its own connection and its own share of
the objects; of many databases, a task reads several, and each in fewer shares. Filters on the query's columns become part of its WHERE, and one on `database` leaves
out whole databases. Nothing passes through the driver but the connections' parameters.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BooleanType, StructType

_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_FETCHED = 1000
#: Tasks of a query for each core.
_TASKS = 4


class DbApiSource(DataSource):
    """Format `dbapi`. Options: module (a DB-API module), databases (JSON: name to arguments of connect()), query,
    follow (a column that holds statements, each replaced by what it gives), shard (a condition with {i} and {n}), partitions (n),
    tasks (so many at most; for databases that keep them busy, n is less).

    The first column is the database's name, the others are the query's, by name.
    """

    @classmethod
    def name(cls) -> str:
        return "dbapi"

    def reader(self, schema: StructType) -> DbApiReader:
        return DbApiReader(dict(self.options), schema)


@dataclass
class Share(InputPartition):
    """A share of one database's rows, and those that the same task reads after it."""

    database: str
    i: int
    then: list[Share] = field(default_factory=list)


class DbApiReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.schema = {k.lower(): v for k, v in options.items()}, schema
        self.databases: dict[str, dict] = json.loads(self.options["databases"])
        self.chosen: set[str] = set(self.databases)
        self.filters: list[tuple[str, str, list]] = []  # column, operator, values

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over the filters that SQL can apply, and gives all of them back.

        Spark tests the rows again: it takes two scans for the same whose taken filters alone differ, and would reuse one's exchange for the other.
        """
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = list(f.value) if isinstance(f, In) else [f.value] if type(f) in _COMPARED else []
            yield f
            if column is None or column == self.options.get("follow") or not (isinstance(f, (In, IsNull, IsNotNull)) or type(f) in _COMPARED):
                continue
            if column == self.schema[0].name:
                self.chosen &= set(values) if isinstance(f, (In, EqualTo)) else self.chosen
            else:
                self.filters.append((column, "IN" if isinstance(f, In) else _COMPARED.get(type(f), "IS NULL" if isinstance(f, IsNull) else "IS NOT NULL"), values))

    def partitions(self) -> Sequence[InputPartition]:
        shares = [Share(d, i) for d in sorted(self.chosen) for i in range(self.shares())]
        first = shares[: int(self.options.get("tasks", len(shares)))]
        for k, share in enumerate(shares[len(first) :]):
            first[k % len(first)].then.append(share)
        return first

    def shares(self) -> int:
        """The shares of each database."""
        shares, tasks = int(self.options.get("partitions", "1")), self.options.get("tasks")
        if not self.options.get("shard") or not self.chosen:
            return 1
        return min(shares, -(-int(tasks) // len(self.chosen))) if tasks else shares

    def statement(self, share: Share, style: str) -> tuple[str, list | dict]:
        """The SQL of a share and its parameters, in the driver's style."""
        wanted, values = [], []
        if self.options.get("shard"):
            wanted.append("(" + self.options["shard"].format(i=share.i, n=self.shares()) + ")")
        mark = {"qmark": lambda k: "?", "numeric": lambda k: f":{k}", "named": lambda k: f":p{k}"}.get(style, lambda k: "%s")
        for column, operator, given in self.filters:
            marks = [mark(len(values) + k) for k in range(1, len(given) + 1)]
            values += given
            wanted.append(f"q.{column} {operator}" + (f" ({', '.join(marks)})" if operator == "IN" else "".join(f" {m}" for m in marks)))
        names = ", ".join(f"q.{f.name}" for f in self.schema.fields[1:])
        text = f"SELECT {names} FROM ({self.options['query']}) q"
        if wanted:
            text += " WHERE " + " AND ".join(wanted)
        if values and style in ("format", "pyformat"):
            text = text.replace("%", "%%").replace("%%s", "%s")
        return text, {f"p{k}": v for k, v in enumerate(values, 1)} if style == "named" else values

    def read(self, partition: Share) -> Iterator[tuple]:
        for share in (partition, *partition.then):
            yield from self._rows(share)

    def _rows(self, partition: Share) -> Iterator[tuple]:
        module = importlib.import_module(self.options["module"])
        text, values = self.statement(partition, module.paramstyle)
        flags = [isinstance(f.dataType, BooleanType) for f in self.schema.fields[1:]]
        follow = self.schema.names.index(self.options["follow"]) - 1 if self.options.get("follow") else None
        connection = module.connect(**self.databases[partition.database])
        try:
            cursor = connection.cursor()
            cursor.execute(text, values) if values else cursor.execute(text)
            while rows := cursor.fetchmany(_FETCHED):
                for row in rows:
                    out = [bool(x) if flag and x is not None else x for x, flag in zip(row, flags, strict=True)]
                    if follow is not None:
                        out[follow] = _followed(module, connection, out[follow])
                    yield (partition.database, *out)
        finally:
            connection.close()


def _followed(module: Any, connection: Any, statement: str | None) -> str | None:
    """What a statement gives: its column called `Create ...`, else the last one; None if it gives nothing or isn't allowed."""
    if not statement:
        return None
    cursor = connection.cursor()
    try:
        cursor.execute(statement)
        row = cursor.fetchone()
    except module.Error:
        return None
    if row is None:
        return None
    names = [d[0].lower() for d in cursor.description]
    return row[next((i for i, x in enumerate(names) if x.startswith("create ")), len(row) - 1)]


@dataclass(frozen=True)
class DbApi:
    """Databases that a Python driver reaches: name to the arguments of its connect()."""

    module: str
    databases: dict[str, dict]
    partitions: int = 4

    def load(self, spark: SparkSession, query: str, shape: str, shard: str | None = None, follow: str | None = None) -> DataFrame:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(DbApiSource)
        reader = spark.read.format("dbapi").schema(f"database string, {shape}").options(module=self.module, databases=json.dumps(self.databases), query=query, partitions=str(self.partitions), tasks=str(_TASKS * spark.sparkContext.defaultParallelism))
        for k, v in (("shard", shard), ("follow", follow)):
            reader = reader.option(k, v) if v else reader
        return reader.load()


@dataclass(frozen=True)
class Jdbc:
    """Databases that JDBC reaches: name to URL; the driver's jar must be on the class path."""

    driver: str
    databases: dict[str, str]
    properties: dict[str, str] = field(default_factory=dict)
    partitions: int = 4

    def load(self, spark: SparkSession, query: str, shape: str, shard: str | None = None, follow: str | None = None) -> DataFrame:
        if follow:
            raise ValueError("JDBC sources can't run a statement for each object; use a DB-API driver")
        parts = {"predicates": [shard.format(i=i, n=self.partitions) for i in range(self.partitions)]} if shard else {}
        kinds = StructType.fromDDL(shape)

        def one(name: str, url: str) -> DataFrame:
            rows = spark.read.jdbc(url, f"({query}) q", properties={"driver": self.driver, **self.properties}, **parts)
            return rows.select(F.lit(name).alias("database"), *[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds.fields])

        return reduce(DataFrame.unionByName, [one(*x) for x in sorted(self.databases.items())])
