"""The whole analysis: scripts to objects, columns, edges, flows and mappings.

Scripts are read once. What the scanners find is stored in the shared folder, one table for
statements, one for definitions, one for bodies and one for derived columns; every relation is
worked out from these by joins, windows and array expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweave.functions import text
from schemaweave.functions.storage import stored
from schemaweave.operators import derive, finalize, graph, routines, splitting, statements, tables


@dataclass(frozen=True)
class Analysis:
    """Relations over scripts(script_id, ddl); nothing runs until a relation is used."""

    scripts: DataFrame

    @cached_property
    def statements(self) -> DataFrame:
        return stored(statements.statements(self.scripts), by="kind")

    @cached_property
    def _bodies(self) -> DataFrame:
        return stored(routines.bodies(self.statements))

    @cached_property
    def _parts(self) -> DataFrame:
        return routines.body_parts(self._bodies)

    @cached_property
    def _made(self) -> DataFrame:
        """Tables that routine bodies create, unless a statement defines them."""
        own = self.statements.where("kind <> 'ALTER'").select("script_id", "name")
        return routines.body_tables(self._parts).join(own, ["script_id", "name"], "left_anti")

    @cached_property
    def _definitions(self) -> DataFrame:
        """Tables and routines, and with part_seq 0 and on the tables that bodies create."""
        top = self.statements.where("kind in ('TABLE', 'FUNCTION', 'PROCEDURE')").select("script_id", "stmt_seq", F.lit(-1).alias("part_seq"), "name", "kind", "stmt")
        made = self._made.select("script_id", "stmt_seq", "part_seq", "name", F.lit("TABLE").alias("kind"), "stmt")
        return stored(tables.definitions(top.unionByName(made)))

    @cached_property
    def _tables(self) -> DataFrame:
        return self._definitions.where("kind = 'TABLE' and part_seq < 0")

    @cached_property
    def _altered(self) -> DataFrame:
        return stored(tables.alterations(self.statements.where("kind = 'ALTER'")))

    @cached_property
    def _derived(self) -> DataFrame:
        """script_id, stmt_seq, part_seq, name and columns of views, of tables made by queries and of routines that return a table's rows."""
        known = self._definitions
        lists = known.where("listed and (kind = 'TABLE' or size(columns) > 0)")
        views = self._bodies.where("kind in ('VIEW', 'MATERIALIZED_VIEW')").select("script_id", "stmt_seq", F.lit(-1).alias("part_seq"), "name", "body")
        made = known.where("kind = 'TABLE' and not listed").select("script_id", "stmt_seq", "part_seq", "name", F.col("stmt").alias("body"))
        of = F.lower(text.first(F.col("stmt"), rf"\bRETURNS\s+SETOF\s+(?:[`\"\[]?\w+[`\"\]]?\.)*{text.NAME}"))
        sets = known.where("kind <> 'TABLE' and size(columns) = 0").select("script_id", "stmt_seq", "name", of.alias("of")).where("of is not null")
        given = lists.where("part_seq < 0").select("script_id", "stmt_seq", "name", F.transform("columns", derive.as_given).alias("columns"))
        return stored(derive.derived_columns(derive.queries(views.unionByName(made)).unionByName(derive.copies(sets)), given))

    @cached_property
    def derived_columns(self) -> DataFrame:
        """script_id, stmt_seq, name, ordinal and COLUMN; what a view or query gives has no flags, what a routine returns has its table's."""
        return self._derived.select("script_id", "stmt_seq", "name", F.posexplode("columns").alias("pos", "c")).select("script_id", "stmt_seq", "name", (F.col("pos") + 1).alias("ordinal"), "c.*")

    @cached_property
    def columns(self) -> DataFrame:
        """Columns of the final definition of every object: script_id, name, ordinal, column, data_type, nullable, pk, unique, fk_to, default."""
        names = ["script_id", "stmt_seq", "name"]
        given = tables.with_alterations(self._definitions.where("listed").select(*names, "columns"), self._altered).select(*names, F.inline("columns"))
        derived = self.derived_columns.select(*names, "ordinal", *tables.COLUMN)
        defined = self.statements.where("kind <> 'ALTER'").select(*names).unionByName(self._made.select(*names))
        last = defined.groupBy("script_id", "name").agg(F.max("stmt_seq").alias("stmt_seq"))
        return stored(given.unionByName(derived).join(last, names, "left_semi").drop("stmt_seq"))

    @cached_property
    def edges(self) -> DataFrame:
        parts = [tables.foreign_edges(self._tables), tables.parent_edges(self._tables), tables.alter_edges(self._altered), routines.read_edges(self._bodies), routines.write_edges(self._bodies), routines.create_edges(self._parts)]
        return stored(finalize.numbered(reduce(DataFrame.unionByName, parts)))

    @cached_property
    def flows(self) -> DataFrame:
        return stored(finalize.distinct_flows(routines.flows(self._parts)))

    @cached_property
    def column_lineage(self) -> DataFrame:
        return routines.column_mappings(self._bodies)

    @cached_property
    def objects(self) -> DataFrame:
        """script_id, obj_seq, name, type, schema, temporary, parent."""
        schema = F.when(F.col("kind").isin("FUNCTION", "PROCEDURE"), "").otherwise(F.col("schema"))
        top = tables.latest(self.statements.where("kind <> 'ALTER'").drop("stmt")).select("script_id", F.array(F.lit(0).cast("bigint"), F.col("obj_seq").cast("bigint")).alias("obj_seq"), "name", F.col("kind").alias("type"), schema.alias("schema"), "temporary", F.lit(None).cast("string").alias("parent"))
        made = self._made.select("script_id", F.array(*[F.lit(1).cast("bigint"), F.col("stmt_seq").cast("bigint"), F.col("part_seq").cast("bigint")]).alias("obj_seq"), "name", F.lit("TABLE").alias("type"), "schema", "temporary", "parent")
        return stored(finalize.registered(top.unionByName(made), self.edges))

    @cached_property
    def cyclic(self) -> DataFrame:
        return stored(graph.cyclic_nodes(self.edges, self._levels))

    @cached_property
    def stats(self) -> DataFrame:
        return stored(finalize.stats(self.objects, self.edges, self.cyclic))

    def impact(self, targets: DataFrame, edge_types: list[str] | None = None, directions: tuple[str, ...] = ("upstream", "downstream")) -> DataFrame:
        return graph.impact(self.edges, targets, edge_types, directions)

    def topological_order(self) -> DataFrame:
        return self._order

    def cycles(self) -> DataFrame:
        return self._cycles

    @cached_property
    def _levels(self) -> DataFrame:
        return stored(graph.levels(self.objects, self.edges))

    @cached_property
    def _order(self) -> DataFrame:
        return stored(graph.topological_order(self.objects, self.edges, self._levels))

    @cached_property
    def _cycles(self) -> DataFrame:
        return stored(graph.cycles(self.objects, self.edges, self._levels))


@dataclass(frozen=True)
class Project(Analysis):
    """All scripts as one, called `name`: their statements in order of script_id, so a script sees what those before it define.

    Each script is cut by itself. Statements get numbers that go on from script to script; from there on a
    project is analysed like one script, so columns, flows, mappings and edges cross scripts.
    """

    name: str

    @cached_property
    def statements(self) -> DataFrame:
        ids = self.scripts.select("script_id").distinct()
        numbers = stored(graph.ranked(ids.withColumn("all", F.lit(1)), ["all"], ["script_id"], "number", ids.count()).drop("all"))
        own = statements.statements(self.scripts).join(numbers, ["script_id"])
        placed = F.shiftleft(F.col("number"), 31) + F.col("stmt_seq")  # a script has fewer statements than characters
        return stored(own.withColumn("stmt_seq", placed).withColumn("script_id", F.lit(self.name)).drop("number"), by="kind")


@dataclass(frozen=True)
class Dump(Analysis):
    """Scripts too large for one task: `scripts` are blocks from splitting.read_blocks() or line_blocks()."""

    @cached_property
    def statements(self) -> DataFrame:
        return splitting.statements(self.scripts)


def analyze(scripts: DataFrame) -> Analysis:
    return Analysis(scripts)
