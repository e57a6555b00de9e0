"""Graph operators over edges(script_id, source, target, edge_type): loops whose every step is a join.

The driver only steers; each step is written to the shared folder, and loops end when a
step adds nothing. Null or missing nodes give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from schemaweave.functions.storage import dropped, stored

#: So many rows are sorted in one task.
ALONE = 200_000
#: Rounds of levels() before chains are put together: graphs of so few levels don't need it.
SHALLOW = 3
#: Steps along links in one stored round of the component search.
RELAXED = 3


def _links(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    return edges.select("script_id", F.col(source).alias("from"), F.col(target).alias("to")).distinct()


def reachable(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """starts(script_id, start) to script_id, start, node: all that is reached along the edges, the start only by a cycle.

    Each round's new nodes are written once and never again; what is known is the union of the rounds.
    """
    links = stored(_links(edges))
    frontier = starts.select("script_id", "start", F.col("start").alias("node")).distinct()
    found = None
    while True:
        step = frontier.withColumnRenamed("node", "from").join(links, ["script_id", "from"]).select("script_id", "start", F.col("to").alias("node")).distinct()
        frontier = stored(step if found is None else step.join(found, ["script_id", "start", "node"], "left_anti"))
        found = frontier if found is None else found.unionByName(frontier)
        if not frontier.take(1):
            return found


def impact(edges: DataFrame, targets: DataFrame, edge_types: list[str] | None = None, directions: tuple[str, ...] = ("upstream", "downstream")) -> DataFrame:
    """targets(script_id, target) to script_id, target, direction (upstream, downstream), node."""
    kept = edges if edge_types is None else edges.where(F.col("edge_type").isin(edge_types))
    starts = targets.select("script_id", F.lower("target").alias("start"))
    along = {"upstream": kept, "downstream": kept.select("script_id", F.col("target").alias("source"), F.col("source").alias("target"))}
    both = reduce(DataFrame.unionByName, [reachable(starts, along[d]).withColumn("direction", F.lit(d)) for d in directions])
    return both.where("node <> start").select("script_id", F.col("start").alias("target"), "direction", "node")


def impact_summary(found: DataFrame) -> DataFrame:
    """script_id, target, upstream, downstream as sorted comma lists, `none` where empty."""
    lists = found.groupBy("script_id", "target").agg(*[F.array_join(F.sort_array(F.collect_set(F.when(F.col("direction") == d, F.col("node")))), ", ").alias(d) for d in ("upstream", "downstream")])
    return lists.select("script_id", "target", *[F.when(F.col(d) == "", "none").otherwise(F.col(d)).alias(d) for d in ("upstream", "downstream")])


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(script_id, name) to script_id, name, level: the longest path of dependencies; null on or above a cycle.

    Each round takes out the nodes whose links are all done, and lets every node with one link left, to a node
    with one link left, jump over it: its level is max(base, level(on) + far), and such steps can be
    put together. So a chain takes a logarithmic number of rounds, whatever its length, and any
    other graph at most one for each level. When a round frees no node, the rest lies on or above a cycle.
    """
    known = nodes.select("script_id", "name").distinct()
    links = edges.where("source <> target").select("script_id", F.col("source").alias("name"), F.col("target").alias("on")).distinct()
    links = stored(links.join(known, ["script_id", "name"], "left_semi").join(known.withColumnRenamed("name", "on"), ["script_id", "on"], "left_semi").withColumn("far", F.lit(1).cast("bigint")))
    counted = links.groupBy("script_id", "name").agg(F.count("*").alias("left"))
    open_ = stored(known.join(counted, ["script_id", "name"], "left").select("script_id", "name", F.lit(0).cast("bigint").alias("base"), F.coalesce("left", F.lit(0).cast("bigint")).alias("left")))
    done, turn = None, 0
    while True:
        turn += 1
        ready = stored(open_.where("left = 0").select("script_id", "name", F.col("base").alias("level")))
        done = ready if done is None else done.unionByName(ready)
        if not ready.take(1):
            waiting = open_.select("script_id", "name", F.lit(None).cast("bigint").alias("level"))
            return done.unionByName(waiting)
        freed = ready.withColumnRenamed("name", "on")
        got = links.join(freed, ["script_id", "on"]).groupBy("script_id", "name").agg(F.max(F.col("level") + F.col("far")).alias("got"), F.count("*").alias("lost"))
        rest = open_.where("left > 0").join(got, ["script_id", "name"], "left")
        rest = stored(rest.select("script_id", "name", F.greatest("base", F.coalesce("got", "base")).alias("base"), (F.col("left") - F.coalesce("lost", F.lit(0))).alias("left")))
        kept = stored(links.join(freed, ["script_id", "on"], "left_anti"))
        if turn <= SHALLOW:
            for old in (links, open_):
                dropped(old)
            links, open_ = kept, rest
            continue
        single = kept.join(rest.where("left = 1"), ["script_id", "name"]).select("script_id", "name", "on", "far", "base")
        jumped = stored(_jumped(_jumped(single)))
        for old in (links, open_):
            dropped(old)
        links = kept.join(jumped, ["script_id", "name"], "left_anti").unionByName(jumped.select("script_id", "on", "name", "far"))
        bases = jumped.select("script_id", "name", F.col("base").alias("new"))
        open_ = rest.join(bases, ["script_id", "name"], "left").select("script_id", "name", F.coalesce("new", "base").alias("base"), "left")
        links, open_, gone = stored(links), stored(open_), (rest, kept, jumped)
        for old in gone:
            dropped(old)


def _jumped(single: DataFrame) -> DataFrame:
    """single(script_id, name, on, far, base), where `on` is among the names: on its link, with the steps put together."""
    next_ = single.select("script_id", F.col("name").alias("on"), F.col("on").alias("next"), F.col("far").alias("more"), F.col("base").alias("under"))
    far = F.col("far")
    return single.join(next_, ["script_id", "on"], "left").select("script_id", "name", F.coalesce("next", "on").alias("on"), (far + F.coalesce("more", F.lit(0))).alias("far"), F.greatest("base", F.coalesce(F.col("under") + far, "base")).alias("base"))


def ranked(rows: DataFrame, within: list[str], order: list[str], rank: str, large: int) -> DataFrame:
    """rows with `rank`, from 1, among those with the same `within`, by `order`.

    large: the most rows with one `within`. Up to ALONE of them are sorted in one task. More are dealt out by ranges of
    (within, order), counted by range, and numbered in their range; so no task gets more than a range.
    """
    if large <= ALONE:
        return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("bigint"))
    dealt = stored(rows.repartitionByRange(*within, *order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy(*within, "__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*within, "__range").orderBy(*order))
    marked = dealt.withColumn("__own", own).join(F.broadcast(counts.withColumn("__before", before).drop("__n")) if counts.count() <= ALONE else counts.withColumn("__before", before).drop("__n"), [*within, "__range"])
    return marked.withColumn(rank, (F.col("__before") + F.col("__own")).cast("bigint")).select(*rows.columns, rank)


def topological_order(nodes: DataFrame, edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """nodes(script_id, name, obj_seq) to script_id, position, name: first-in-first-out order of dependencies.

    of: what levels() has found, if that is known.

    Within a level nodes come by the last position among their dependencies and name, on the
    first level by obj_seq. What depends on a cycle comes last, sorted, marked by `*`. The only node of a
    level has its place at once; other levels are numbered one by one, large ones by ranges (see ranked()).
    """
    of = stored(levels(nodes, edges)) if of is None else of
    sizes = stored(of.groupBy("script_id", "level").agg(F.count("*").alias("n")))
    through = Window.partitionBy("script_id").orderBy(F.col("level").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = stored(sizes.withColumn("before", F.coalesce(F.sum("n").over(through), F.lit(0))))
    of = stored(of.join(before, (of["script_id"] == before["script_id"]) & of["level"].eqNullSafe(before["level"])).select(of["script_id"], "name", of["level"], "before", "n"))
    placed = of.where("n = 1 and level is not null").select("script_id", (F.col("before") + 1).alias("position"), "name")
    links = stored(edges.where("source <> target").select("script_id", F.col("source").alias("name"), F.col("target").alias("on")).distinct().join(of.where("n > 1"), ["script_id", "name"]))
    shared = sizes.where("n > 1").groupBy("level").agg(F.max("n").alias("n")).orderBy(F.col("level").asc_nulls_last()).collect()  # a row per level

    def numbered(rows: DataFrame, large: int, *order: str) -> DataFrame:
        return ranked(rows, ["script_id"], list(order), "own", large).select("script_id", (F.col("before") + F.col("own")).cast("bigint").alias("position"), "name")

    for level, large in shared:
        if level is None:
            continue
        now = of.where((F.col("level") == level) & (F.col("n") > 1))
        if level == 0:
            keyed = now.join(nodes.groupBy("script_id", "name").agg(F.min("obj_seq").alias("key")), ["script_id", "name"])
        else:
            met = links.where(F.col("level") == level).join(placed.select("script_id", F.col("name").alias("on"), "position"), ["script_id", "on"])
            keyed = met.groupBy("script_id", "name", "before").agg(F.max("position").alias("key"))
        placed = placed.unionByName(stored(numbered(keyed, large, "key", "name")))
    tail = numbered(of.where("level is null"), max([n for level, n in shared if level is None], default=1), "name")
    return placed.unionByName(tail.withColumn("name", F.concat(F.lit("*"), "name")))


def cyclic_nodes(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """script_id, node: nodes that reach themselves. of: what levels() has found of these edges, if that is known.

    What doesn't reach a cycle, or isn't reached from one, is left out by levels(). Chains between nodes with
    several links become one link, by pointers that double their reach; a ring without such a node is found by that
    alone. On what remains, components come from forward and backward colours. Nodes of a chain lie on
    a cycle if both its ends lie in one component. Rows are one per link and node in every step.
    """
    links = _core(_links(edges.where("source <> target")), of)
    if not links.take(1):
        return links.select("script_id", F.col("from").alias("node"))
    nodes = stored(_degrees(links))
    inner = nodes.where("came = 1 and went = 1").select("script_id", "node")
    ahead, behind = (_ends(links.select("script_id", F.col(a).alias("node"), F.col(b).alias("end")), inner) for a, b in (("from", "to"), ("to", "from")))
    ends = stored(ahead.withColumnRenamed("end", "after").join(behind.withColumnRenamed("end", "before"), ["script_id", "node"]))
    rings = inner.join(ends, ["script_id", "node"], "left_anti")
    outer = stored(links.join(inner.withColumnRenamed("node", "from"), ["script_id", "from"], "left_anti"))
    short = outer.join(ends.select("script_id", F.col("node").alias("to"), "after"), ["script_id", "to"], "left").select("script_id", "from", F.coalesce("after", "to").alias("to")).distinct()
    short = stored(short)
    of = stored(_components(short.where("`from` <> `to`")))
    own = short.where("`from` = `to`").select("script_id", F.col("from").alias("node"))
    at = lambda end: of.select("script_id", F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
    chained = ends.join(at("before"), ["script_id", "before"], "left").join(at("after"), ["script_id", "after"], "left").where("before = after or before_of = after_of").select("script_id", "node")
    return of.select("script_id", "node").unionByName(own).unionByName(chained).unionByName(rings).distinct()


def _core(links: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Links between nodes that reach a cycle and are reached from one. of: levels of the nodes, if they are known."""
    for source, target in (("from", "to"), ("to", "from")):
        if of is None:
            links = stored(links)
            ends = links.select("script_id", F.explode(F.array("from", "to")).alias("name"))
            of = levels(ends, links.select("script_id", F.col(source).alias("source"), F.col(target).alias("target")))
        stay, of = stored(of.where("level is null").select("script_id", "name")), None
        if not stay.take(1):
            return stored(links.limit(0))
        links = stored(links.join(stay.withColumnRenamed("name", "from"), ["script_id", "from"], "left_semi").join(stay.withColumnRenamed("name", "to"), ["script_id", "to"], "left_semi"))
    return links


def _degrees(links: DataFrame) -> DataFrame:
    """script_id, node, came, went: how many links come to each node and go from it."""
    both = links.select("script_id", F.inline(F.array(F.struct(F.col("from").alias("node"), F.lit(0).alias("came"), F.lit(1).alias("went")), F.struct(F.col("to").alias("node"), F.lit(1).alias("came"), F.lit(0).alias("went")))))
    return both.groupBy("script_id", "node").agg(F.sum("came").alias("came"), F.sum("went").alias("went"))


def _ends(steps: DataFrame, inner: DataFrame) -> DataFrame:
    """script_id, node, end: the node that isn't inner where the chain from each inner node ends; none on rings.

    A round looks twice as far as the one before; when a round brings no node to its end, the rest goes round.
    """
    open_ = stored(steps.join(inner, ["script_id", "node"], "left_semi"))
    done, left = None, open_.count()
    while left:
        at = inner.withColumnRenamed("node", "end")
        ended = stored(open_.join(at, ["script_id", "end"], "left_anti").select("script_id", "node", "end"))
        done = ended if done is None else done.unionByName(ended)
        rest = open_.join(at, ["script_id", "end"], "left_semi")
        far = done.unionByName(rest.select("script_id", "node", "end"))
        open_ = stored(rest.join(far.select("script_id", F.col("node").alias("end"), F.col("end").alias("next")), ["script_id", "end"]).select("script_id", "node", F.col("next").alias("end")))
        if not ended.take(1):
            break
        left = open_.count()
    return done if done is not None else open_.select("script_id", "node", "end")


def _components(links: DataFrame) -> DataFrame:
    """script_id, node, component of the nodes of strongly connected components with two nodes or more.

    Each node takes the least name that reaches it as its colour; nodes of a colour that reach the node
    of that name are its component, and leave.
    """
    out = None
    while True:
        links = _core(links) if out is not None else links
        if not links.take(1):
            return out if out is not None else links.select("script_id", F.col("from").alias("node"), F.col("from").alias("component"))
        colour = _coloured(links)
        inner = links.join(colour.withColumnsRenamed({"node": "from", "colour": "own"}), ["script_id", "from"]).join(colour.withColumnsRenamed({"node": "to", "colour": "other"}), ["script_id", "to"]).where("own = other")
        inner = stored(inner.select("script_id", "from", "to", "own"))
        # Backwards from the node that gave the colour, within the colour; three steps a round.
        frontier = stored(colour.where("node = colour").select("script_id", "node"))
        back = frontier
        while True:
            near = frontier
            for _ in range(RELAXED):
                near = near.unionByName(inner.join(near.withColumnRenamed("node", "to"), ["script_id", "to"]).select("script_id", F.col("from").alias("node"))).distinct()
            frontier = stored(near.join(back, ["script_id", "node"], "left_anti"))
            if not frontier.take(1):
                break
            back = back.unionByName(frontier)
        # A colour's own node is on a cycle if any node of its colour links to it.
        closed = inner.where("to = own").select("script_id", F.col("own").alias("colour")).distinct()
        found = stored(colour.join(closed, ["script_id", "colour"], "left_semi").join(back, ["script_id", "node"], "left_semi").select("script_id", "node", F.col("colour").alias("component")))
        out = found if out is None else out.unionByName(found)
        gone = stored(found.select("script_id", "node").unionByName(colour.where("node = colour").select("script_id", "node")).distinct())
        rest = links.join(gone.withColumnRenamed("node", "from"), ["script_id", "from"], "left_anti").join(gone.withColumnRenamed("node", "to"), ["script_id", "to"], "left_anti")
        links = stored(rest)


def _coloured(links: DataFrame) -> DataFrame:
    """script_id, node, colour: the least name that reaches a node, itself included. Three steps a round."""
    ends = links.select("script_id", F.inline(F.array(F.struct(F.col("from").alias("node")), F.struct(F.col("to").alias("node")))))
    colour = stored(ends.distinct().withColumn("colour", F.col("node")))
    changed = colour
    while True:
        near = changed
        for _ in range(RELAXED):
            offered = links.join(near.withColumnRenamed("node", "from"), ["script_id", "from"]).select("script_id", F.col("to").alias("node"), "colour")
            near = near.unionByName(offered).groupBy("script_id", "node").agg(F.min("colour").alias("colour"))
        better = stored(near.withColumnRenamed("colour", "new").join(colour, ["script_id", "node"]).where("new < colour").select("script_id", "node", F.col("new").alias("colour")))
        if not better.take(1):
            return colour
        fresh = stored(colour.unionByName(better).groupBy("script_id", "node").agg(F.min("colour").alias("colour")))
        dropped(colour)
        colour, changed = fresh, better


def _pieces(links: DataFrame) -> DataFrame:
    """script_id, node, piece: the least name of all nodes that links join to a node, whichever way they run.

    Every node points to a node of its piece. A round lets it point to the least that those around it point to, two
    steps on, offers the same to the node that it points to, and lets pointers double their reach; so
    rounds are logarithmic, and a node's offers are put together before they are shuffled.
    """
    both = stored(links.unionByName(links.select("script_id", F.col("to").alias("from"), F.col("from").alias("to"))).distinct())
    of = stored(both.select("script_id", F.col("from").alias("node"), F.col("from").alias("up")).distinct())
    while True:
        top = of.select("script_id", F.col("node").alias("up"), F.col("up").alias("top"))
        far = stored(of.join(top, ["script_id", "up"]).select("script_id", "node", "up", "top"))
        near = both.join(far.select("script_id", F.col("node").alias("to"), "top"), ["script_id", "to"]).groupBy("script_id", F.col("from").alias("node")).agg(F.min("top").alias("top"))
        near = near.join(far.select("script_id", "node", "up"), ["script_id", "node"])
        offers = near.select("script_id", F.explode(F.array("node", "up")).alias("node"), "top").unionByName(far.select("script_id", "node", "top")).withColumn("up", F.lit(None).cast("string"))
        new = offers.unionByName(far.select("script_id", "node", "top", "up")).groupBy("script_id", "node").agg(F.min("top").alias("top"), F.max("up").alias("up"))
        new = stored(new.select("script_id", "node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        for old in (of, far):
            dropped(old)
        of = new.drop("moved")
        of._stored_at = new._stored_at
        if not new.where("moved").take(1):
            dropped(both)
            return of.select("script_id", "node", F.col("up").alias("piece"))


def _walked(nodes: DataFrame, edges: DataFrame, of: DataFrame | None) -> DataFrame:
    """script_id, seq, path of each link that a depth-first walk in object order finds to lead back; path: from the link's end to its start.

    of: what levels() has found of these edges, if that is known. Only nodes on or above a cycle are walked: the
    others lead to no link back, so the walk finds the same without them. Nodes that no links join don't change each
    other's walk either, so scripts with more than ALONE such nodes are walked piece by piece, and what is found is put
    in the order of the roots. In one piece the order decides which links lead back, so a piece isn't split.
    edges need edge_seq, nodes obj_seq.
    """
    import pandas as pd

    links = edges.where("source <> target").select("script_id", F.col("edge_seq").alias("seq"), F.col("source").alias("a"), F.col("target").alias("b"))
    if of is None:
        of = levels(links.select("script_id", F.explode(F.array("a", "b")).alias("name")), edges)
    open_ = stored(of.where("level is null").select("script_id", F.col("name").alias("a")))
    links = links.join(open_, ["script_id", "a"], "left_semi").join(open_.withColumnRenamed("a", "b"), ["script_id", "b"], "left_semi")
    if _most(open_) > ALONE:
        links = stored(links)
        pieces = _pieces(links.select("script_id", F.col("a").alias("from"), F.col("b").alias("to"))).withColumnRenamed("node", "a")
    else:
        pieces = open_.withColumn("piece", F.lit(""))
    roots = nodes.select("script_id", F.lit(0).alias("kind"), F.col("obj_seq").alias("seq"), F.col("name").alias("a"), F.lit("").alias("b"))
    rows = links.withColumn("kind", F.lit(1)).unionByName(roots).join(pieces, ["script_id", "a"])
    shape = StructType([rows.schema["script_id"], StructField("at", rows.schema["seq"].dataType), StructField("root", StringType()), StructField("step", LongType()), StructField("path", ArrayType(StringType()))])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["seq"] = pdf["seq"].map(lambda x: tuple(x) if hasattr(x, "__len__") else x)
        pdf = pdf.sort_values(["kind", "seq", "a", "b"])
        of = pdf[pdf["kind"] == 1].drop_duplicates(["a", "b"]).groupby("a", sort=False)["b"].agg(list).to_dict()
        found, seen, first = [], set(), pdf[pdf["kind"] == 0]
        for at, root in zip(first["seq"], first["a"], strict=True):
            path, place, todo = [], {}, [[root]]  # todo[k]: what is left to visit from path[k - 1], last first
            while todo:
                node = todo[-1].pop() if todo[-1] else None
                if node is None:
                    todo.pop()
                    place.pop(path.pop() if path else None, None)
                elif node in place:
                    found.append((at, root, len(found), path[place[node] :]))
                elif node not in seen:
                    seen.add(node)
                    place[node] = len(path)
                    path.append(node)
                    todo.append(of.get(node, [])[::-1])
        out = pd.DataFrame(found, columns=["at", "root", "step", "path"])
        out.insert(0, "script_id", pdf["script_id"].iloc[0])
        return out

    found = stored(rows.groupBy("script_id", "piece").applyInPandas(walk, shape))
    return ranked(found, ["script_id"], ["at", "root", "step"], "rank", _most(found)).select("script_id", (F.col("rank") - 1).alias("seq"), "path")


def _most(rows: DataFrame) -> int:
    """The most rows of one script."""
    return rows.groupBy("script_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def cycles(nodes: DataFrame, edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """script_id, seq, path: the distinct cycles that a depth-first walk closes, smallest name first and last (see _walked()).

    of: what levels() has found of these edges, if that is known.
    """
    k = F.array_position("path", F.array_min("path")).cast("int")
    ring = F.concat(F.slice("path", k, F.size("path")), F.slice("path", F.lit(1), k - 1), F.array(F.array_min("path")))
    return _walked(nodes, edges, of).select("script_id", "seq", ring.alias("path")).groupBy("script_id", "path").agg(F.min("seq").alias("seq")).select("script_id", "seq", "path")


def layer_levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(script_id, name, obj_seq), links(script_id, edge_seq, from, to) to script_id, name, level: the longest path that leads to a node.

    Links that a depth-first walk finds to lead back are left out, so every node has a level.
    """
    edges = links.select("script_id", "edge_seq", F.col("from").alias("source"), F.col("to").alias("target"))
    back = _walked(nodes, edges, None).select("script_id", F.element_at("path", -1).alias("source"), F.element_at("path", 1).alias("target")).distinct()
    ahead = edges.join(back, ["script_id", "source", "target"], "left_anti")
    return levels(nodes, ahead.select("script_id", F.col("target").alias("source"), F.col("source").alias("target")))
