"""Analyses as text, DOT, Mermaid and JSON: one row per script.

Each renderer takes an analysis (objects, columns, edges, flows, column_lineage, cyclic, stats,
cycles(), topological_order()) and is a union of sections of lines, which are sorted and joined
by script. A script's rendering is one text, so it has to fit in one row; with `lines` a renderer gives script_id,
key and line instead, for sources.scripts.write_lines(), and no row holds more than a line. Names that are
null or missing give no lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schemaweave.operators import compare

#: Order of edge types in reports, and their labels in Mermaid.
EDGE_ORDER = ("FK", "READ", "WRITE", "INHERITS")
LABELS = {"FK": "FK", "READ": "reads", "WRITE": "writes", "INHERITS": "inherits"}
#: Words that can't be node ids in Mermaid.
MERMAID_WORDS = ("end", "graph", "flowchart", "subgraph", "style", "class", "classdef", "click", "linkstyle", "direction", "call", "href", "default", "interpolate")
_FILL = {"TABLE": "#dbeafe", "VIEW": "#dcfce7", "MATERIALIZED_VIEW": "#a7f3d0", "FUNCTION": "#ede9fe", "PROCEDURE": "#ffedd5"}
_COLOUR = {"FK": "gray40", "READ": "steelblue", "WRITE": "firebrick", "INHERITS": "darkgreen"}


def _lines(rows: DataFrame, section: int, line: Column, *order: Column, seq: Column | None = None) -> DataFrame:
    """script_id, key, line: a section's lines, in order of up to three texts and a number, or of seq, an array of numbers."""
    texts = [F.coalesce(x.cast("string"), F.lit("")) for x in order[:-1]]
    texts += [F.lit("")] * (3 - len(texts))
    number = F.array((order[-1] if order else F.lit(0)).cast("bigint")) if seq is None else seq.cast("array<bigint>")
    return rows.select("script_id", F.struct(F.lit(section).alias("s"), *[t.alias(f"t{i}") for i, t in enumerate(texts)], number.alias("n")).alias("key"), line.alias("line")).where("line is not null")


def _joined(sections: list[DataFrame], name: str, lines: bool) -> DataFrame:
    every = reduce(DataFrame.unionByName, sections)
    return every if lines else every.groupBy("script_id").agg(F.sort_array(F.collect_list(F.struct("key", "line"))).alias("l")).select("script_id", F.array_join(F.col("l.line"), "\n").alias(name))


def _title(rows: DataFrame, section: int, title: str) -> list[DataFrame]:
    """A headline with the number of rows, for scripts that have any, and a blank line after the section."""
    counted = rows.groupBy("script_id").agg(F.count("*").alias("n"))
    return [_lines(counted, section, F.format_string(f"  {title}  (%s)\n  " + "-" * 52, "n")), _lines(counted, section + 2, F.lit(""))]


def _wide(c: Column | str, n: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)


def _braced(details: str = "details") -> Column:
    return F.when(F.col(details) != "", F.concat(F.lit(" ("), F.col(details), F.lit(")"))).otherwise("")


def _of(values: dict[str, str], key: str) -> Column:
    return F.coalesce(*[F.when(F.col(key) == k, F.lit(v)) for k, v in values.items()], F.lit(""))


def _mapped(a) -> DataFrame:
    """script_id, source, target, pos and the columns of the first INSERT of each edge."""
    rows = a.column_lineage.withColumn("__first", F.min(F.struct("stmt_seq", "insert_seq")).over(Window.partitionBy("script_id", "via", "tgt_table")))
    return rows.where(F.struct("stmt_seq", "insert_seq") == F.col("__first")).select("script_id", F.col("via").alias("source"), F.col("tgt_table").alias("target"), "pos", "src_table", "src_col", "tgt_col")


def to_text(a, most: int = 6, lines: bool = False) -> DataFrame:
    """script_id, report: objects by type with their first columns, edges, mappings, flows, cycles, order, summary."""
    objects, edges, stats = a.objects, a.edges, a.stats
    rule = "=" * 58
    head = _lines(stats, 0, F.lit(f"{rule}\n  Schema lineage\n{rule}\n"))
    kinds = objects.groupBy("script_id", "type").agg(F.count("*").alias("n"))
    marks = F.concat_ws(", ", F.when(F.col("temporary"), "TEMP"), F.concat(F.lit("created in "), "parent"))
    named = F.concat(F.lit("    * "), F.when(F.col("schema") != "", F.concat("schema", F.lit("."))).otherwise(""), "name", F.when(marks != "", F.concat(F.lit("  ["), marks, F.lit("]"))).otherwise(""))
    cols = a.columns.join(objects.select("script_id", "name", "type"), ["script_id", "name"]).withColumn("place", F.row_number().over(Window.partitionBy("script_id", "name").orderBy("ordinal")))
    flags = F.concat_ws(" ", F.when(F.col("pk"), "PK"), F.when(F.col("fk_to").isNotNull(), "FK"), F.when(F.col("unique"), "UNIQUE"), F.when(~F.col("nullable"), "NOT NULL"))
    column = F.concat(F.lit("        "), _wide("column", 24), F.lit(" "), _wide("data_type", 20), F.lit(" "), flags, F.coalesce(F.concat(F.lit("  -> "), "fk_to"), F.lit("")))
    more = cols.groupBy("script_id", "type", "name").agg(F.count("*").alias("n")).where(F.col("n") > most)
    rank = F.array_position(F.lit(list(EDGE_ORDER)), F.col("edge_type")).cast("string")
    arrow = F.concat(F.lit("    "), _wide("source", 24), F.lit(" --["), "edge_type", _braced(), F.lit("]--> "), "target")
    mapped = _mapped(a).where("pos < 4").withColumn("rank", F.lit(str(EDGE_ORDER.index("WRITE") + 1)))
    pair = lambda wide: F.concat(F.col("src_table"), F.lit("."), wide, F.lit("  ->  "), F.col("tgt_table"), F.lit("."), "tgt_col")
    lineage, flows, cycles = a.column_lineage, a.flows, a.cycles()
    order = a.topological_order().groupBy("script_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]), " -> ").alias("order"))
    warned = cycles.groupBy("script_id").agg(F.count("*").alias("n"))
    return _joined(
        [
            head,
            _lines(kinds, 1, F.format_string("  %ss  (%s)", "type", "n"), F.col("type"), F.lit(""), F.lit(0)),
            _lines(objects, 1, named, F.col("type"), F.col("name"), F.lit(0)),
            _lines(cols.where(F.col("place") <= most), 1, column, F.col("type"), F.col("name"), F.col("place")),
            _lines(more, 1, F.format_string("        ... +%s more columns", F.col("n") - most), F.col("type"), F.col("name"), F.lit(most + 1)),
            _lines(kinds, 1, F.lit(""), F.col("type"), F.lit("\U0010ffff"), F.lit(0)),
            *_title(edges, 2, "Lineage edges"),
            _lines(edges, 3, arrow, rank, F.col("source"), F.col("target"), F.lit(0)),
            _lines(mapped, 3, F.concat(F.lit("        "), F.col("src_table"), F.lit("."), "src_col", F.lit("  ->  "), F.col("target"), F.lit("."), "tgt_col"), F.col("rank"), F.col("source"), F.col("target"), F.col("pos") + 1),
            *_title(lineage, 5, "Column-level lineage"),
            _lines(lineage, 6, F.concat(F.lit("    "), pair(_wide("src_col", 24)), F.lit("  (via "), "via", F.lit(")")), seq=F.array("stmt_seq", "insert_seq", "pos")),
            *_title(flows, 8, "Data flows in function bodies"),
            _lines(flows, 9, F.concat(F.lit("    "), _wide("source", 24), F.lit(" ==["), "edge_type", _braced(), F.lit("]==> "), "target", F.lit("  (in "), "via", F.lit(")")), F.col("via"), F.col("source"), F.col("target"), F.lit(0)),
            _lines(warned, 11, F.format_string("  WARNING: %s circular dependency cycle(s) detected!", "n")),
            _lines(cycles, 12, F.concat(F.lit("    "), F.array_join("path", " -> ")), F.col("seq")),
            _lines(warned, 13, F.lit("")),
            _lines(order, 14, F.concat(F.lit("  Topological order (leaves first)\n    "), "order", F.lit("\n"))),
            _lines(stats, 15, F.concat(F.format_string("  Summary: %s objects, %s edges", "total_objects", "total_edges"), F.when(F.col("has_cycles"), "  [CYCLES DETECTED]").otherwise(""), F.lit("\n"))),
        ],
        "report",
        lines,
    )


#: What an edge says of its source.
_VERBS = {"FK": "refers to", "READ": "reads", "WRITE": "writes", "INHERITS": "inherits from"}


def to_report(a, most: int = 5, lines: bool = False) -> DataFrame:
    """script_id, report: counts, objects in order of definition with their first columns, what each depends on, and cycles by number."""
    objects, cycles = a.objects, a.cycles()
    cols = a.columns.join(objects.select("script_id", "name", "obj_seq"), ["script_id", "name"]).withColumn("place", F.row_number().over(Window.partitionBy("script_id", "name").orderBy("ordinal")))
    notes = F.concat_ws(", ", F.when(F.col("pk"), "primary key"), F.concat(F.lit("refers to "), "fk_to"))
    more = cols.groupBy("script_id", "name", "obj_seq").agg(F.count("*").alias("n")).where(F.col("n") > most)
    within = lambda n: F.concat("obj_seq", F.array(n.cast("bigint")))
    described = F.concat(F.lit("      "), F.concat_ws(" ", "column", F.nullif("data_type", F.lit(""))), F.when(notes != "", F.concat(F.lit("  ("), notes, F.lit(")"))).otherwise(""))
    said = F.concat(F.lit("  "), "source", F.lit(" "), _of(_VERBS, "edge_type"), F.lit(" "), "target", _braced(), F.when((F.col("via") != "") & (F.col("via") != F.col("source")), F.concat(F.lit(", by "), "via")).otherwise(""))
    counts = F.concat("script_id", F.format_string("\n  %s objects, %s edges, ", "total_objects", "total_edges"), F.when(F.col("has_cycles"), "with cycles").otherwise("without cycles"))
    return _joined(
        [
            _lines(a.stats, 0, counts),
            _lines(objects.select("script_id").distinct(), 1, F.lit("\nObjects")),
            _lines(objects, 2, F.concat(F.lit("  "), "name", F.lit(" : "), F.lower(F.replace("type", F.lit("_"), F.lit(" ")))), seq=within(F.lit(0))),
            _lines(cols.where(F.col("place") <= most), 2, described, seq=within(F.col("place"))),
            _lines(more, 2, F.format_string("      and %s more", F.col("n") - most), seq=within(F.lit(most + 1))),
            _lines(a.edges.select("script_id").distinct(), 3, F.lit("\nDependencies")),
            _lines(a.edges, 4, said, seq=F.col("edge_seq")),
            _lines(cycles.select("script_id").distinct(), 5, F.lit("\nCycles")),
            _lines(cycles.withColumn("k", F.row_number().over(Window.partitionBy("script_id").orderBy("seq"))), 6, F.concat(F.format_string("  %s. ", "k"), F.array_join("path", " > ")), F.col("k")),
        ],
        "report",
        lines,
    )


def _grouped(objects: DataFrame) -> DataFrame:
    """objects with owner: the routine in whose group an object is drawn, or null."""
    groups = compare.groups(objects.join(objects.select("script_id", F.col("name").alias("parent")).distinct(), ["script_id", "parent"], "left_semi"))
    members = groups.select("script_id", "owner", F.explode("members").alias("name"))
    return objects.join(members, ["script_id", "name"], "left")


def _cycle_ends(cycles: DataFrame) -> DataFrame:
    return cycles.select("script_id", F.explode("path").alias("name")).distinct().withColumn("cyclic", F.lit(True))


def to_dot(a, most: int = 8, lines: bool = False) -> DataFrame:
    """script_id, dot: objects with columns, in a cluster for each routine with its tables; edges, flows and cycles."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    cycles = a.cycles()
    shown = F.concat("column", F.lit(" "), "data_type", F.when(F.col("pk"), " PK").otherwise(""), F.coalesce(F.concat(F.lit(" -> "), "fk_to"), F.lit("")))
    cols = a.columns.groupBy("script_id", "name").agg(F.slice(F.sort_array(F.collect_list(F.struct("ordinal", shown.alias("c")))), 1, most).alias("c")).select("script_id", "name", F.array_join(F.col("c.c"), "\\l").alias("cols"))
    nodes = _grouped(a.objects).join(cols, ["script_id", "name"], "left").join(_cycle_ends(cycles), ["script_id", "name"], "left")
    label = F.concat("name", F.lit("\\n("), "type", F.lit(")"), F.coalesce(F.concat(F.lit("\\n---\\l"), "cols", F.lit("\\l")), F.lit("")))
    box = F.concat(quote(F.col("name")), F.lit(" [label="), quote(label), F.lit(' style=filled fillcolor="'), _of(_FILL, "type"), F.lit('"'), F.when(F.col("cyclic"), " color=red penwidth=2.5").otherwise(""), F.lit("];"))
    inside = F.col("owner").isNotNull()
    owners = nodes.where(inside).select("script_id", "owner").distinct()
    pairs = _mapped(a).where("pos < 4").groupBy("script_id", "source", "target").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "src_col", "tgt_col"))), lambda m: F.concat(m["src_col"], F.lit(" -> "), m["tgt_col"])), "\\n").alias("maps"))
    edges = a.edges.join(pairs, ["script_id", "source", "target"], "left").withColumn("maps", F.when((F.col("edge_type") == "WRITE") & (F.col("details") == "INSERT"), F.col("maps")))
    link = lambda label, style: F.concat(F.lit("  "), quote(F.col("source")), F.lit(" -> "), quote(F.col("target")), F.lit(" ["), style, F.lit(" label="), quote(label), F.lit("];"))
    steps = cycles.select("script_id", "seq", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("source"), F.slice("path", F.lit(2), F.size("path") - 1).alias("target"))).alias("k", "p")).select("script_id", "seq", "k", "p.*")
    ids = a.objects.select("script_id").distinct()
    return _joined(
        [
            _lines(ids, 0, F.lit("digraph lineage {\n  rankdir=LR;\n  node [shape=box fontsize=11];\n  edge [fontsize=9];\n")),
            _lines(nodes.where(~inside), 1, F.concat(F.lit("  "), box), F.col("name"), F.lit(0)),
            _lines(owners, 2, F.concat(F.lit("  subgraph "), quote(F.concat(F.lit("cluster_"), "owner")), F.lit(" {\n    label="), quote(F.concat(F.lit("ƒ "), "owner")), F.lit("; style=dashed;")), F.col("owner"), F.lit(0)),
            _lines(nodes.where(inside), 2, F.concat(F.lit("    "), box), F.col("owner"), F.when(F.col("name") == F.col("owner"), "").otherwise(F.col("name")), F.lit(1)),
            _lines(owners, 2, F.lit("  }"), F.col("owner"), F.lit("\U0010ffff"), F.lit(2)),
            _lines(edges, 3, link(F.concat("edge_type", _braced(), F.coalesce(F.concat(F.lit("\\n"), "maps"), F.lit(""))), F.concat(F.lit("color="), _of(_COLOUR, "edge_type"))), seq=F.col("edge_seq")),
            _lines(a.flows, 4, link(F.concat(F.lit("flow"), F.when(F.col("details") != "", F.concat(F.lit(" "), "details")).otherwise("")), F.lit("color=orange style=bold")), seq=F.col("flow_seq")),
            _lines(steps, 5, link(F.lit("CYCLE!"), F.lit("color=red penwidth=2.5")), seq=F.array("seq", "k")),
            _lines(ids, 6, F.lit("}")),
        ],
        "dot",
        lines,
    )


def mermaid_id(name: Column) -> Column:
    clean = F.regexp_replace(name, r"(?U)\W", "_")
    return F.when(clean.rlike(r"(?U)^[^\W\d_]") & ~F.lower(clean).isin(*MERMAID_WORDS), clean).otherwise(F.concat(F.lit("n_"), clean))


def _mermaid_text(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit("#quot;"))


def _mermaid_link(arrow: str, label: Column) -> Column:
    return F.concat(F.lit("  "), mermaid_id(F.col("source")), F.lit(f' {arrow}|"'), _mermaid_text(label), F.lit('"| '), mermaid_id(F.col("target")))


def mermaid_links(edges: DataFrame) -> DataFrame:
    """script_id, edge_seq, line of each edge."""
    return edges.select("script_id", "edge_seq", _mermaid_link("-->", F.concat(_of(LABELS, "edge_type"), _braced())).alias("line"))


def to_mermaid(a, lines: bool = False) -> DataFrame:
    """script_id, mermaid: objects, in a subgraph for each routine with its tables; edges, flows, and cycles as a class."""
    nodes, cycles = _grouped(a.objects), a.cycles()
    box = F.concat(mermaid_id(F.col("name")), F.lit('["'), _mermaid_text(F.col("name")), F.lit("<br/>"), "type", F.lit('"]'))
    inside = F.col("owner").isNotNull()
    owners = nodes.where(inside).select("script_id", "owner").distinct()
    ends = _cycle_ends(cycles).join(a.objects.select("script_id", "name").distinct(), ["script_id", "name"], "left_semi")
    marked = ends.groupBy("script_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("name")), mermaid_id), ",").alias("names"))
    warned = cycles.select("script_id").distinct()
    return _joined(
        [
            _lines(a.objects.select("script_id").distinct(), 0, F.lit("graph LR")),
            _lines(nodes.where(~inside), 1, F.concat(F.lit("  "), box), F.col("name"), F.lit(0)),
            _lines(owners, 2, F.concat(F.lit("  subgraph "), mermaid_id(F.col("owner")), F.lit('_group["ƒ '), _mermaid_text(F.col("owner")), F.lit('"]')), F.col("owner"), F.lit(0)),
            _lines(nodes.where(inside), 2, F.concat(F.lit("    "), box), F.col("owner"), F.when(F.col("name") == F.col("owner"), "").otherwise(F.col("name")), F.lit(1)),
            _lines(owners, 2, F.lit("  end"), F.col("owner"), F.lit("\U0010ffff"), F.lit(2)),
            mermaid_links(a.edges).select("script_id", F.struct(F.lit(3).alias("s"), *[F.lit("").alias(f"t{i}") for i in range(3)], F.col("edge_seq").alias("n")).alias("key"), "line"),
            _lines(a.flows, 4, _mermaid_link("==>", F.when(F.col("details") != "", F.col("details")).otherwise(F.lower("edge_type"))), seq=F.col("flow_seq")),
            _lines(warned, 5, F.lit("  %% WARNING: circular dependencies detected:")),
            _lines(cycles, 6, F.concat(F.lit("  %% "), F.array_join("path", " -> ")), F.col("seq")),
            _lines(marked, 7, F.concat(F.lit("  classDef cycle stroke:#d33,stroke-width:3px\n  class "), "names", F.lit(" cycle"))),
        ],
        "mermaid",
        lines,
    )


def to_json(a) -> DataFrame:
    """script_id, json: objects with columns, edges with mappings, col_lineage, flows, cycles, topo_order and stats."""
    cols = F.struct("ordinal", F.col("column").alias("name"), F.col("data_type").alias("type"), "nullable", "pk", F.coalesce("fk_to", F.lit("")).alias("fk_to"), "unique", F.coalesce("default", F.lit("")).alias("default"))
    columns = a.columns.groupBy("script_id", "name").agg(F.transform(F.sort_array(F.collect_list(cols)), lambda c: c.dropFields("ordinal")).alias("columns"))
    maps = F.struct("pos", "src_table", "src_col", F.col("target").alias("tgt_table"), "tgt_col", F.col("source").alias("via"))
    mapped = _mapped(a).groupBy("script_id", "source", "target").agg(F.transform(F.sort_array(F.collect_list(maps)), lambda m: m.dropFields("pos")).alias("col_lineage"))
    edges = a.edges.join(mapped, ["script_id", "source", "target"], "left")
    maps = F.when((F.col("edge_type") == "WRITE") & (F.col("details") == "INSERT"), F.col("col_lineage"))
    kind = "array<struct<src_table:string,src_col:string,tgt_table:string,tgt_col:string,via:string>>"

    def gathered(rows: DataFrame, name: str, seq: list[str], value: Column) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct(F.struct(*seq).alias("seq"), value.alias("value"))))
        return rows.groupBy("script_id").agg(F.transform(ordered, lambda x: x["value"]).alias(name))

    objects = a.objects.join(columns, ["script_id", "name"], "left")
    out = gathered(objects, "objects", ["obj_seq", "name"], F.struct("name", "type", "schema", "temporary", F.coalesce("parent", F.lit("")).alias("parent"), F.coalesce("columns", F.array()).alias("columns")))
    for more in (
        gathered(edges, "edges", ["edge_seq"], F.struct("source", "target", F.col("edge_type").alias("type"), "via", "details", F.coalesce(maps.cast(kind), F.array().cast(kind)).alias("col_lineage"))),
        gathered(a.column_lineage, "col_lineage", ["stmt_seq", "insert_seq", "pos"], F.struct("src_table", "src_col", "tgt_table", "tgt_col", "via")),
        gathered(a.flows, "flows", ["flow_seq"], F.struct("source", "target", F.col("edge_type").alias("type"), "via", "details")),
        gathered(a.cycles(), "cycles", ["seq"], F.col("path")),
        gathered(a.topological_order(), "topo_order", ["position"], F.col("name")),
        a.stats.select("script_id", F.struct("total_objects", "total_edges", "has_cycles").alias("stats")),
    ):
        out = out.join(more, "script_id", "left")
    lists = [F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("objects", "edges", "col_lineage", "flows", "cycles", "topo_order")]
    return out.select("script_id", F.to_json(F.struct(*lists, "stats"), {"ignoreNullFields": "false"}).alias("json"))
