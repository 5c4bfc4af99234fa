"""Density clusters of points: neighbour graph, mutual reachability, spanning forest, condensed tree, excess of mass.

Every step is a Spark job over tables of rows, edges or components; the driver sees a bounded sample of the points,
one box a cell, and one weight a level of the tree.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tieline.operators.network import components
from tieline.operators.ordering import top_per_key
from tieline.session import cut_lineage

# Cells of space have about half of BLOCK_ROWS points, until there are MOST_CELLS; a task meets about BLOCK_ROWS visitors of a cell at once.
BLOCK_ROWS, MOST_CELLS = 4096, 2048
# Up to so many edges are united on the driver, more by rounds over tables; the components are the same.
FEW_EDGES = 20_000
# Distances held at once inside a task.
PRODUCT_CELLS = 400_000


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _squares(a: np.ndarray, b: np.ndarray):
    """(first row, block of squared distances) of the rows of ``a`` to those of ``b``, from differences so that equal points are 0 apart."""
    step = max(1, PRODUCT_CELLS // max(1, len(b)))
    for lo in range(0, len(a), step):
        rows = a[lo : lo + step]
        total = np.zeros((len(rows), len(b)))
        for x, y in zip(rows.T, b.T, strict=True):
            total += (x[:, None] - y) ** 2
        yield lo, total


def _cuts(sample: np.ndarray, cells: int, least: int) -> list[tuple]:
    """A k-d tree over the sample as rows (dimension, cut, left, right), or (−1, 0, cell, 0) for a cell.

    Every cell holds at least ``least`` of the sampled rows, so tied coordinates may leave fewer cells than asked for.
    """
    tree, found = [], 0
    todo = [(sample, cells, None)]
    while todo:
        rows, wanted, at = todo.pop()
        if at is not None:
            tree[at[0]][at[1]] = len(tree)
        split = None
        for dim in np.argsort(-np.ptp(rows, axis=0)) if wanted > 1 and len(rows) >= 2 * least else []:
            line = np.sort(rows[:, dim])
            edges = np.flatnonzero(line[1:] > line[:-1]) + 1
            edges = edges[(edges >= least) & (edges <= len(line) - least)]
            if len(edges):
                split = int(dim), float(line[edges[np.abs(edges - len(line) // 2).argmin()]])
                break
        if split is None:
            tree.append([-1, 0.0, found, 0])
            found += 1
            continue
        low = rows[:, split[0]] < split[1]
        todo += [(rows[~low], wanted - wanted // 2, (len(tree), 3)), (rows[low], wanted // 2, (len(tree), 2))]
        tree.append([*split, 0, 0])
    return [tuple(row) for row in tree]


def _cell_of(rows: np.ndarray, tree: list[tuple]) -> np.ndarray:
    cell, todo = np.zeros(len(rows), np.int32), [(0, np.arange(len(rows)))]
    while todo:
        at, which = todo.pop()
        dim, cut, left, right = tree[at]
        if dim < 0:
            cell[which] = left
        elif len(which):
            low = rows[which, dim] < cut
            todo += [(left, which[low]), (right, which[~low])]
    return cell


def _in_cells(sites: DataFrame, k: int) -> DataFrame:
    """``sites`` (v, …) and the cell of each, by a tree over a bounded sample of them."""
    n = sites.count()
    cells = min(MOST_CELLS, -(-n // (BLOCK_ROWS // 2)))
    share = min(1.0, cells * 4 * (k + 1) / n)
    sample = sites.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow()
    tree = _cuts(_matrix(sample["v"]), cells, k + 1) if sample.num_rows else [(-1, 0.0, 0, 0)]
    schema = T.StructType([*sites.schema.fields, T.StructField("cell", T.IntegerType())])

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("cell", pa.array(_cell_of(_matrix(batch.column("v")), tree)))

    return cut_lineage(sites.mapInArrow(assign, schema))


def _near_sites(sites: DataFrame, k: int) -> DataFrame:
    """(site, other, distance): the ``k`` + 1 nearest of ``sites`` (site, v, n) to each, itself included; ties go to the smaller site.

    A site first searches its own cell, which bounds how far it needs to look, and then visits the cells whose boxes lie within
    that bound.  Cells keep their size as rows grow, so a site meets a number of cells that depends on how the points lie, not on the rows.
    """
    kind = sites.schema["site"].dataType
    placed = _in_cells(sites, k)
    width = F.size("v")
    dims = placed.select(width).first()[0]
    edge = lambda f: F.array(*[f(F.get("v", F.lit(i))) for i in range(dims)])
    boxes = placed.groupBy("cell").agg(edge(F.min).alias("lo"), edge(F.max).alias("hi")).orderBy("cell").toArrow()  # one row a cell
    cells, lows, highs = boxes["cell"].to_numpy(), _matrix(boxes["lo"]), _matrix(boxes["hi"])

    def route(block: pa.Table) -> pa.Table:
        rows, far = _matrix(block["v"]), np.full(block.num_rows, np.inf)
        if len(rows) > k:
            for lo, d in _squares(rows, rows):
                far[lo : lo + len(d)] = np.partition(d, k, axis=1)[:, k]
        far[block["n"].to_numpy() > k] = 0.0
        far *= 1 + 1e-12
        gap = np.maximum(0, np.maximum(lows - rows.max(axis=0), rows.min(axis=0) - highs))
        around = np.flatnonzero((gap**2).sum(axis=1) <= far.max() * (1 + 1e-9))
        out = []
        for c in around:
            away = (np.maximum(0, np.maximum(lows[c] - rows, rows - highs[c])) ** 2).sum(axis=1)
            went = pa.array(np.flatnonzero(away <= far * (1 + 1e-9)))
            part = block.select(["site", "v"]).take(went).append_column("far", pa.array(far).take(went))
            out.append(part.append_column("to", pa.array(np.full(len(went), cells[c], np.int32))))
        return pa.concat_tables(out)

    visit = T.StructType([T.StructField("site", kind), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("far", T.DoubleType()), T.StructField("to", T.IntegerType())])
    visits = cut_lineage(placed.groupBy("cell").applyInArrow(route, visit))
    parts = cut_lineage(visits.groupBy("to").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts")))  # one row a cell
    left = visits.join(F.broadcast(parts), "to").select("site", "v", "far", "to", F.pmod(F.xxhash64("site"), F.col("parts")).cast("int").alias("part"))
    right = placed.select(F.col("site").alias("other"), "v", F.col("cell").alias("to")).join(F.broadcast(parts), "to")
    right = right.select("other", "v", "to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = right.toDF(*right.columns)  # columns of its own: both sides come from the same tables
    schema = T.StructType([T.StructField("site", kind), T.StructField("other", kind), T.StructField("distance", T.DoubleType())])

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [pa.table({"site": a["site"][:0], "other": b["other"][:0], "distance": pa.array([], pa.float64())})]
        ids, others = a["site"].combine_chunks(), b["other"].combine_chunks()
        if len(ids) and len(others):
            order = np.array(pc.sort_indices(others))
            others, rows, far = others.take(pa.array(order)), _matrix(b["v"])[order], a["far"].to_numpy()
            for lo, d in _squares(_matrix(a["v"]), rows):
                p, q = np.nonzero(d <= far[lo : lo + len(d), None])
                away = np.sqrt(d[p, q])
                best = np.lexsort((q, away, p))
                starts = np.searchsorted(p, np.arange(len(d)))  # p rises, before and after the sort
                best = best[np.arange(len(best)) - starts[p] <= k]
                found.append(pa.table({"site": ids.take(pa.array(lo + p[best])), "other": others.take(pa.array(q[best])), "distance": away[best]}))
        return pa.concat_tables(found)

    met = left.groupBy("to", "part").cogroup(right.groupBy("to", "part")).applyInArrow(search, schema)
    return top_per_key(met, ["site"], [F.col("distance"), F.col("other")], k + 1).select("site", "other", "distance")


def neighbours(points: DataFrame, k: int, item: str = "vec_id", vec: str = "point") -> DataFrame:
    """(item, other, distance): the ``k`` nearest other points of each point, exactly; ties go to the smaller id.

    Equal points are one site, of which only the ``k`` + 1 smallest ids can be among anyone's neighbours: copies cost rows, not pairs.
    Sites find their nearest by cells; see :func:`_near_sites`.  Item ids are unique; null vectors take no part.
    """
    points = points.where(F.col(vec).isNotNull() & F.col(item).isNotNull()).select(item, F.col(vec).cast("array<double>").alias("v"))
    kind = points.schema[item].dataType
    if points.isEmpty():
        schema = T.StructType([T.StructField(item, kind), T.StructField("other", kind), T.StructField("distance", T.DoubleType())])
        return points.sparkSession.createDataFrame([], schema)
    first = top_per_key(points, ["v"], [F.col(item)], k + 1)
    sites = cut_lineage(first.groupBy("v").agg(F.min(item).alias("site"), F.collect_list(item).alias("ids"), F.count("*").alias("n")))
    near = _near_sites(sites.select("site", "v", "n"), k)
    ids = sites.select(F.col("site").alias("other"), F.explode("ids").alias("_id"))
    near = near.join(ids, "other").select("site", F.col("_id").alias("other"), "distance")
    members = points.join(sites.select("v", "site"), "v").select(item, "site")
    met = members.join(near, "site").where(F.col(item) != F.col("other"))
    return top_per_key(met, [item], [F.col("distance"), F.col("other")], k).select(item, "other", "distance")


def reachability(near: DataFrame, item: str = "vec_id") -> DataFrame:
    """(u, v, w): each neighbour pair once, with the largest of its distance and both core distances.

    A point's core distance is that to the last of its neighbours in ``near``.
    """
    core = cut_lineage(near.groupBy(item).agg(F.max("distance").alias("core")))
    pairs = near.groupBy(F.least(item, "other").alias("u"), F.greatest(item, "other").alias("v")).agg(F.min("distance").alias("d"))
    pairs = pairs.join(core.select(F.col(item).alias("u"), F.col("core").alias("cu")), "u").join(core.select(F.col(item).alias("v"), F.col("core").alias("cv")), "v")
    return pairs.select("u", "v", F.greatest("d", "cu", "cv").alias("w"))


def _united(edges: DataFrame) -> DataFrame:
    """(node, component) of the ends ``cu`` and ``cv`` of ``edges``, the component being its smallest node."""
    few = edges.select("cu", "cv").limit(FEW_EDGES + 1).collect()
    if len(few) > FEW_EDGES:
        return cut_lineage(components(edges.select(F.col("cu").alias("src"), F.col("cv").alias("dst"))))
    root: dict = {}
    for pair in few:
        ends = []
        for x in pair:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            ends.append(x)
        root[max(ends)] = min(ends)
    rows = []
    for node in root:
        top = node
        while root[top] != top:
            top = root[top]
        rows.append((node, top))
    kind = edges.schema["cu"].dataType
    return edges.sparkSession.createDataFrame(rows, T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))


def _renamed(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges whose ends ``cu`` and ``cv`` take the names in ``moved`` (node, component)."""
    for end in ("cu", "cv"):
        to = moved.select(F.col("node").alias(end), F.col("component").alias("_to"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v, w): a minimum spanning forest by rounds in which each component takes its lightest edge outward.

    Edges are in one order by (w, u, v), so no round closes a circle; components at least halve.  Of edges between the same two
    components only the lightest goes on.  Each round is a table in the shared folder.
    """
    edges = cut_lineage(edges.where("u <> v").select(F.col("u").alias("cu"), F.col("v").alias("cv"), F.struct("w", "u", "v").alias("e")))
    kept = []
    while not edges.isEmpty():
        ends = edges.select(F.col("cu").alias("c"), "cu", "cv", "e").unionByName(edges.select(F.col("cv").alias("c"), "cu", "cv", "e"))
        chosen = cut_lineage(ends.groupBy("c").agg(F.min_by(F.struct("cu", "cv", "e"), "e").alias("b")).select("b.*").distinct())
        kept.append(chosen.select("e.u", "e.v", "e.w"))
        moved = _united(chosen)
        edges = _renamed(edges, moved).where("cu <> cv")
        edges = edges.groupBy(F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv")).agg(F.min("e").alias("e"))
        edges = cut_lineage(edges)
    return cut_lineage(reduce(DataFrame.unionByName, kept)) if kept else edges.select("e.u", "e.v", "e.w")


def levels_of(forest: DataFrame, even: int = 6) -> list[float]:
    """Rising weights that cut the forest's edges into levels: even shares, then shares that halve down to the heaviest edge.

    Clusters part at the few heaviest edges, so that is where levels are fine.  Their number grows with the logarithm of the rows.
    """
    n = forest.count()
    if not n:
        return []
    shares, tail = [0.9 * i / even for i in range(1, even + 1)], 0.1
    while tail * n > 1:
        tail /= 2
        shares.append(1 - tail)
    at = forest.agg(F.percentile_approx("w", [*shares, 1.0], 100_000)).first()[0]
    return sorted(set(at))


def condensed_clusters(items: DataFrame, forest: DataFrame, min_size: int, item: str = "vec_id", out: str = "cluster") -> DataFrame:
    """(item, out): clusters of at least ``min_size`` points; see :func:`condensed_at`."""
    return condensed_at(items, forest, {out: min_size}, item)


def condensed_at(items: DataFrame, forest: DataFrame, sizes: dict[str, int], item: str = "vec_id") -> DataFrame:
    """(item, …): a column for each of ``sizes`` with clusters of at least so many points chosen by excess of mass, numbered from the largest; −1 is noise.

    Levels of rising weight unite components.  A component becomes a cluster when it reaches its size; smaller ones that
    join later fall to it; where two clusters meet, both end and a parent begins.  A cluster's mass is the sum over its points of 1 / w
    at which they came less 1 / w at which it ended.  The chosen clusters are those with at least the mass of the best choice below them,
    the topmost on each branch; the root of a connected forest is not one.  Weights count by level.  Points that no edge touches are noise.

    All sizes go through the levels together.  A component has the name of its smallest point, so each name ends once: in a cluster, or in
    a smaller name.  That is logged, and points are looked up at the end.
    """
    ids = items.select(F.col(item).alias("comp")).distinct()
    grains = F.explode(F.array(*[F.struct(F.lit(out).alias("grain"), F.lit(n).cast("bigint").alias("need")) for out, n in sizes.items()])).alias("g")
    comps = ids.select("comp", grains).select("g.*", "comp", F.lit(1).cast("bigint").alias("size"), F.lit(None).cast("string").alias("cluster"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("below"), F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("born_at"))
    comps = cut_lineage(comps)
    cuts = levels_of(forest)
    least = next((w for w in cuts if w > 0), 1.0)
    level = reduce(lambda c, i: F.when(F.col("w") <= cuts[i], i).otherwise(c), reversed(range(len(cuts) - 1)), F.lit(len(cuts) - 1)) if cuts else F.lit(0)
    edges = cut_lineage(forest.select(F.col("u").alias("cu"), F.col("v").alias("cv"), level.alias("level")))
    logs = []

    def ending(rows: DataFrame, rate: float) -> DataFrame:
        own = F.col("mass") - F.col("size") * rate
        return rows.withColumn("own", own).withColumn("best", F.greatest("own", "below")).withColumn("taken", F.col("own") >= F.col("below"))

    big = F.col("cluster").isNotNull()
    for i, weight in enumerate(cuts):
        rate = 1 / max(weight, least)
        moved = _united(edges.where(F.col("level") == i))
        parts = ending(comps.drop("n").join(moved, F.col("comp") == F.col("node")).drop("node"), rate)
        met = parts.groupBy("grain", "need", "component").agg(
            F.sum("size").alias("size"), F.count_if(big).alias("n"), F.max("cluster").alias("cluster"), F.coalesce(F.sum(F.when(~big, F.col("size"))), F.lit(0)).alias("small"),
            F.sum("mass").alias("mass"), F.sum("below").alias("below"), F.coalesce(F.sum(F.when(big, F.col("best"))), F.lit(0.0)).alias("best"),
        )
        born = (F.col("n") != 1) & (F.col("size") >= F.col("need"))
        named = F.when(born, F.concat(F.lit(f"{i}:"), F.col("component").cast("string"))).otherwise(F.col("cluster"))
        mass = F.when(born, F.col("size") * rate).when(F.col("n") == 1, F.col("mass") + F.col("small") * rate).otherwise(0.0)
        below = F.when(F.col("n") > 1, F.col("best")).when(F.col("n") == 1, F.col("below")).otherwise(0.0)
        met = met.select("grain", "need", F.col("component").alias("comp"), "size", named.alias("cluster"), mass.alias("mass"), below.alias("below"), "n", F.lit(i).alias("born_at"))
        comps = cut_lineage(comps.join(moved, F.col("comp") == F.col("node"), "left_anti").unionByName(met))
        up = comps.where(F.col("born_at") == i).select("grain", F.col("comp").alias("component"), F.col("cluster").alias("parent"), "n")
        ends = (big & (F.col("n") > 1)) | (~big & (F.col("parent").isNotNull() | (F.col("comp") != F.col("component"))))
        logs.append(cut_lineage(parts.join(up, ["grain", "component"]).where(ends).select("grain", "comp", F.col("component").alias("to"), "cluster", "parent", "taken")))
        if i + 1 < len(cuts):
            edges = cut_lineage(_renamed(edges.where(F.col("level") > i), moved))

    if not logs:
        return items.select(item, *[F.lit(-1).alias(out) for out in sizes])
    log = cut_lineage(reduce(DataFrame.unionByName, logs))
    # Pointer jumping, for names as for clusters: each looks twice as far every round.
    ended = cut_lineage(log.where(~big).select("grain", "comp", "to", F.col("parent").alias("cluster")))
    while not ended.where("cluster is null and to is not null").isEmpty():
        ahead = ended.select("grain", F.col("comp").alias("to"), F.col("to").alias("_to"), F.col("cluster").alias("_cluster"))
        onward = ended.where("cluster is null and to is not null").join(ahead, ["grain", "to"], "left").select("grain", "comp", F.col("_to").alias("to"), F.col("_cluster").alias("cluster"))
        ended = cut_lineage(ended.where("cluster is not null").unionByName(onward))
    last = cut_lineage(ending(comps.where(big), 0.0))
    roots = last.groupBy("grain").agg((F.count("*") > 1).alias("several"))  # one row a size
    last = last.join(F.broadcast(roots), "grain").select("grain", "cluster", F.lit(None).cast("string").alias("parent"), (F.col("taken") & F.col("several")).alias("taken"))
    closed = log.where(big).select("grain", "cluster", "parent", "taken").unionByName(last)
    way = cut_lineage(closed.select("grain", "cluster", F.when(F.col("taken"), F.col("cluster")).alias("top"), F.col("parent").alias("up")))
    while not way.where("up is not null").isEmpty():
        above = way.select("grain", F.col("cluster").alias("up"), F.col("top").alias("_top"), F.col("up").alias("_up"))
        way = cut_lineage(way.join(above, ["grain", "up"], "left").select("grain", "cluster", F.coalesce("_top", "top").alias("top"), F.col("_up").alias("up")))
    labels = cut_lineage(ended.where("cluster is not null").join(way.where("top is not null"), ["grain", "cluster"]).select("grain", F.col("comp").alias(item), "top"))
    counts = labels.groupBy("grain", "top").agg(F.count("*").alias("n"), F.min(item).alias("first"))
    # One row a cluster, each of at least its size.
    numbered = counts.select("grain", "top", (F.row_number().over(Window.partitionBy("grain").orderBy(F.desc("n"), "first")) - 1).alias("_number"))
    label = lambda out: F.max(F.when(F.col("grain") == out, F.col("_number"))).alias(out)
    wide = labels.join(numbered, ["grain", "top"]).groupBy(item).agg(*[label(out) for out in sizes])
    return items.select(item).join(wide, item, "left").select(item, *[F.coalesce(out, F.lit(-1)).alias(out) for out in sizes])


def density_clusters(points: DataFrame, min_size: int, near: int | None = None, item: str = "vec_id", out: str = "cluster") -> DataFrame:
    """Density clusters of ``points`` (item, point), −1 for noise; ``near`` neighbours (default: ``min_size``) set the density."""
    forest = spanning_forest(reachability(neighbours(points, near or min_size, item), item))
    return condensed_clusters(points, forest, min_size, item, out)
