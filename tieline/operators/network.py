"""Graph operators over edge tables ``(src, dst, weight)``.

Every iterative operator keeps its state in a DataFrame, cuts lineage with a reliable checkpoint
each round and reads back only a row of counters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieline.functions import vocabulary as V
from tieline.session import cut_lineage, drop_steps

CUT_EVERY = 6
#: Share of the nodes that a round of trimming has to take out for another one to follow.
TRIM_SHARE = 0.01
#: About how many links of one source are one row.
LINKS_A_ROW = 4096


def real_name(col: Column) -> Column:
    """False for empty names and the spelled-out nulls."""
    return F.coalesce(~F.lower(F.trim(col)).isin(*V.MISSING_NAMES), F.lit(False))


def edge_weights(mail: DataFrame, sender: str, recipients: str) -> DataFrame:
    """Mails per directed (sender, recipient) pair; empty names and self loops are left out."""
    return (
        mail.select(F.trim(F.col(sender)).alias("src"), F.explode(recipients).alias("_to"))
        .select("src", F.trim("_to").alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("weight"))
    )


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Unordered pairs ``a < b``; the weights of both directions are summed."""
    return (
        edges.where("src <> dst")
        .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")
        .groupBy("a", "b")
        .agg(F.sum("weight").alias("weight"))
    )


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once per direction, as (src, dst, weight)."""
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(
        pairs.select("b", "a", "weight")
    )


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree, unweighted and weighted, from one pass over the edges."""
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    one = edges.select("weight", F.inline(ends))
    return one.groupBy("node").agg(
        F.sum("i").cast("bigint").alias("in_degree"),
        F.sum("o").cast("bigint").alias("out_degree"),
        F.count("*").alias("total_degree"),
        F.sum(F.col("i") * F.col("weight")).alias("weighted_in"),
        F.sum(F.col("o") * F.col("weight")).alias("weighted_out"),
        F.sum("weight").alias("weighted_total"),
    )


def density(edges: DataFrame) -> DataFrame:
    n = nodes(edges).agg(F.count("*").alias("nodes")).scalar()
    return edges.agg(F.count("*").alias("edges")).select(
        n.alias("nodes"), "edges", F.try_divide(F.col("edges"), n * (n - 1)).alias("density")
    )


class _State:
    """The iterate of a loop.

    Every round ends in a reliable checkpoint: the plan of the next round then starts from files,
    however often the round refers to the state, and a lost executor costs one round at most.
    """

    def __init__(self, df: DataFrame):
        self.df = cut_lineage(df)

    def step(self, df: DataFrame) -> DataFrame:
        self.df = cut_lineage(df)
        return self.df


def pagerank(edges: DataFrame, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100) -> DataFrame:
    """Weighted PageRank with uniform restart; sinks spread their mass evenly.

    Stops when the summed change falls below ``N * tol`` and raises if ``max_iter`` rounds do not reach that;
    ``tol=0`` asks for exactly ``max_iter`` rounds.  One job per round returns the change and the mass on sinks;
    ranks never leave the cluster.  Nodes are numbered, and a round moves each source's links as lists of about
    ``LINKS_A_ROW``, not a row a link.
    """
    end = lambda c, starts: F.struct(F.col(c).alias("node"), F.when(F.lit(starts), F.col("weight")).alias("_w"), F.lit(int(starts)).alias("_n"))
    ends = F.array(end("src", True), end("dst", False))
    base = cut_lineage(_numbered(edges.select(F.inline(ends)).groupBy("node").agg(F.sum("_w").alias("_w"), F.sum("_n").alias("_n"))))
    head = base.agg(F.count("*").alias("n"), F.count_if(F.col("_n") == 0).alias("sinks")).first()
    n = head["n"]
    if not n:
        return base.select("node", F.lit(0.0).alias("pagerank"))
    source = base.where("_n > 0").select(F.col("node").alias("src"), F.col("id").alias("_s"), "_w", F.ceil(F.col("_n") / LINKS_A_ROW).alias("_rows"))
    # The join by source comes last, so that the lists are made where its rows lie.
    links = edges.join(base.select(F.col("node").alias("dst"), F.col("id").alias("_d")), "dst").join(source, "src")
    links = links.groupBy("src", "_s", F.pmod(F.xxhash64("_d"), F.col("_rows")).alias("_row")).agg(
        F.collect_list(F.struct(F.col("_d").alias("id"), (F.col("weight") / F.col("_w")).alias("share"))).alias("to")
    )
    links = cut_lineage(links.select(F.col("_s").alias("src"), F.col("to.id").alias("ids"), F.col("to.share").alias("shares")))
    sink_mass = head["sinks"] / n
    state = _State(base.select("id", (F.col("_n") == 0).alias("sink"), F.lit(1.0 / n).alias("rank")))
    for _ in range(max_iter):
        sent = links.join(state.df.select(F.col("id").alias("src"), "rank"), "src")
        flow = (
            sent.select("rank", "shares", F.posexplode("ids").alias("_at", "id"))
            .groupBy("id")
            .agg(F.sum(F.col("rank") * F.get("shares", F.col("_at"))).alias("flow"))
        )
        rest = (1 - alpha) / n + alpha * sink_mass / n
        new = state.df.join(flow, "id", "left").select(
            "id",
            "sink",
            (F.lit(alpha) * F.coalesce("flow", F.lit(0.0)) + F.lit(rest)).alias("rank"),
            F.col("rank").alias("_before"),
        )
        new = state.step(new)
        seen = new.agg(
            F.sum(F.abs(F.col("rank") - F.col("_before"))).alias("change"),
            F.sum(F.when(F.col("sink"), F.col("rank")).otherwise(0.0)).alias("sunk"),
        ).first()
        sink_mass = seen["sunk"]
        if seen["change"] < n * tol:
            break
    else:
        if tol > 0:
            raise RuntimeError(f"PageRank did not converge in {max_iter} rounds")
    return base.select("node", "id").join(state.df, "id").select("node", F.col("rank").alias("pagerank"))


def components(edges: DataFrame) -> DataFrame:
    """Weakly connected components: (node, component), the label being the smallest member.

    Each round takes the smallest label among neighbours, then follows one label pointer, so
    long chains shrink geometrically.  Labels only fall, so the loop runs until none moves.
    """
    everyone = cut_lineage(nodes(edges))
    pairs = undirected(edges.withColumn("weight", F.lit(1)))
    links = cut_lineage(both_ways(pairs).select("src", "dst"))
    state = _State(everyone.select("node", F.col("node").alias("component"), F.lit(True).alias("_moved")))
    while True:
        labels = state.df
        # Neighbours have seen every label that did not move in the round before.
        near = (
            links.join(labels.where("_moved").select(F.col("node").alias("src"), "component"), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min("component").alias("_near"))
        )
        best = labels.join(near, "node", "left").select(
            "node", F.col("component").alias("_old"), F.least("component", "_near").alias("_new")
        )
        hop = labels.select(F.col("node").alias("_new"), F.col("component").alias("_jump"))
        new = best.join(hop, "_new", "left").select(
            "node", F.least("_new", "_jump").alias("component"), (F.least("_new", "_jump") < F.col("_old")).alias("_moved")
        )
        new = state.step(new)
        moved = new.agg(F.count_if("_moved")).first()[0]
        drop_steps(labels)
        if moved == 0:
            drop_steps(links, everyone)
            return state.df.select("node", "component")


def _spread(seed: DataFrame, links: DataFrame, take) -> DataFrame:
    """Push labels along links until nothing changes; ``take`` merges two labels."""
    state = _State(seed.withColumn("_moved", F.col("label").isNotNull()))
    while True:
        near = (
            links.join(state.df.where("_moved").select(F.col("node").alias("src"), "label"), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(take("label").alias("_near"))
        )
        new = state.df.join(near, "node", "left").select(
            "node",
            F.least(F.col("label"), F.col("_near")).alias("label"),
            (~F.least(F.col("label"), F.col("_near")).eqNullSafe(F.col("label"))).alias("_moved"),
        )
        new = state.step(new)
        moved = new.agg(F.count_if("_moved")).first()[0]
        if moved == 0:
            return state.df.select("node", "label")


def strong_components(edges: DataFrame) -> DataFrame:
    """Strongly connected components by forward colouring and backward matching.

    Forward: every node takes the smallest label that reaches it.  Backward: within one
    colour, the nodes that reach the colour's own root form a component and are taken out.
    Every round takes out at least one component, so the loop ends when no node is left.
    """
    live_edges = cut_lineage(edges.select("src", "dst").where("src <> dst").distinct())
    live = cut_lineage(nodes(edges))
    n_live, done = live.count(), None
    # A node without edges on one side is a component of its own, and so on among those left, while that takes many out.
    while True:
        core = cut_lineage(live_edges.select(F.col("src").alias("node")).intersect(live_edges.select("dst")))
        alone = live.join(core, "node", "left_anti").select("node", F.col("node").alias("component"))
        done = alone if done is None else done.unionByName(alone)
        n_core = core.count()
        if n_core < n_live:
            live_edges = cut_lineage(
                live_edges.join(core.withColumnRenamed("node", "src"), "src", "left_semi").join(
                    core.withColumnRenamed("node", "dst"), "dst", "left_semi"
                )
            )
        few = n_live - n_core <= TRIM_SHARE * n_live
        live, n_live = core, n_core
        if few:
            break
    while not live.isEmpty():
        colour = _spread(live.select("node", F.col("node").alias("label")), live_edges, F.min)
        same = cut_lineage(
            live_edges.join(colour.select(F.col("node").alias("src"), F.col("label").alias("_a")), "src")
            .join(colour.select(F.col("node").alias("dst"), F.col("label").alias("_b")), "dst")
            .where("_a = _b")
            .select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        )
        roots = colour.select("node", F.when(F.col("node") == F.col("label"), F.col("label")).alias("label"))
        found = cut_lineage(
            _spread(roots, same, F.min).where("label is not null").select("node", F.col("label").alias("component"))
        )
        done = done.unionByName(found)
        live = cut_lineage(live.join(found, "node", "left_anti"))
        keep = live.select(F.col("node"))
        live_edges = cut_lineage(
            live_edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(
                keep.withColumnRenamed("node", "dst"), "dst", "left_semi"
            )
        )
    return done


def _numbered(ranked: DataFrame) -> DataFrame:
    """``ranked`` and ``id``: the number of each row from 0, in the order of the table; int where that suffices.

    Rows are written with their place in their partition; one count a partition reaches the driver.
    """
    placed = cut_lineage(ranked.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, n = [], 0
    for r in counts:
        starts.append((r["_part"], n))
        n += r["n"]
    starts = placed.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    number = (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("int" if n < 1 << 31 else "bigint")
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("id", number).drop("_part", "_start", "_at")


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles and degree per node of the undirected projection.

    Nodes are numbered by rising degree and edges point to the higher number, which bounds every node's outgoing
    edges by ``sqrt(2 E)``.  A node sends each of its ends the ends after that one, as one list; what the list shares
    with the receiver's own ends closes triangles.  So an edge is a row, and a wedge one number in a list.
    """
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    pairs = cut_lineage(pairs.distinct())
    deg = (
        pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    )
    deg = cut_lineage(_numbered(deg.orderBy("degree", "node")))
    ranked = pairs.join(deg.select(F.col("node").alias("a"), F.col("id").alias("_a")), "a").join(
        deg.select(F.col("node").alias("b"), F.col("id").alias("_b")), "b"
    )
    arcs = ranked.select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v"))
    ends = cut_lineage(arcs.groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("ends")))
    sent = ends.select("u", "ends", F.posexplode("ends").alias("_at", "v")).where(F.col("_at") + 1 < F.size("ends"))
    sent = sent.select("u", "v", F.slice("ends", F.col("_at") + 2, F.size("ends")).alias("after"))
    own = ends.select(F.col("u").alias("v"), "ends")
    closed = sent.join(own, "v").select("u", "v", F.array_intersect("after", "ends").alias("w")).where(F.size("w") > 0)
    corners = F.concat(
        F.array(*[F.struct(F.col(c).alias("id"), F.size("w").cast("bigint").alias("n")) for c in ("u", "v")]),
        F.transform("w", lambda w: F.struct(w.alias("id"), F.lit(1).cast("bigint").alias("n"))),
    )
    per_node = closed.select(F.inline(corners)).groupBy("id").agg(F.sum("n").alias("triangles"))
    return deg.join(per_node, "id", "left").select("node", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """Average local clustering and transitivity of the undirected projection."""
    t = triangles(edges)
    open_pairs = F.col("degree") * (F.col("degree") - 1)
    return t.agg(
        F.avg(F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / open_pairs).otherwise(0.0)).alias("avg_clustering"),
        F.coalesce(F.try_divide(2.0 * F.sum("triangles"), F.sum(open_pairs)), F.lit(0.0)).alias("transitivity"),
    )


def distances(edges: DataFrame, sources: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """Shortest distances (source, node, distance) by rounds of frontier joins."""
    links = edges.select("src", "dst", (F.col("weight") if weighted else F.lit(1)).cast("double").alias("_w"))
    links = cut_lineage(links)
    seeds = sources if sources is not None else nodes(links)
    start = seeds.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance"), F.lit(True).alias("_new"))
    state = _State(start)
    while True:
        ahead = (
            state.df.where("_new")
            .join(links, F.col("node") == F.col("src"))
            .groupBy("source", F.col("dst").alias("node"))
            .agg(F.min(F.col("distance") + F.col("_w")).alias("_d"))
        )
        new = state.df.join(ahead, ["source", "node"], "full").select(
            "source",
            "node",
            F.least("distance", "_d").alias("distance"),
            F.coalesce(F.col("_d") < F.col("distance"), F.col("distance").isNull()).alias("_new"),
        )
        new = state.step(new)
        moved = new.agg(F.count_if("_new")).first()[0]
        if moved == 0:
            return state.df.select("source", "node", "distance")


def path_summary(edges: DataFrame) -> DataFrame:
    """Weak components, the largest one's size, its diameter and mean undirected distance."""
    edges = cut_lineage(edges)
    comp = components(edges)
    sizes = comp.groupBy("component").agg(F.count("*").alias("size"))
    n_comp = sizes.agg(F.count("*")).scalar()
    biggest = sizes.orderBy(F.desc("size"), "component").limit(1)
    inside = comp.join(biggest.select("component"), "component", "left_semi").select("node")
    pairs = undirected(edges)
    core = both_ways(pairs).join(inside.withColumnRenamed("node", "src"), "src", "left_semi")
    far = distances(core).where("source <> node")
    return far.agg(
        n_comp.alias("weak_components"),
        F.count_distinct("source").alias("largest_size"),
        F.max("distance").cast("bigint").alias("diameter"),
        F.avg("distance").alias("avg_shortest_path"),
    )


def betweenness(
    edges: DataFrame, sources: DataFrame | None = None, distance: str = "weight", normalised: bool = True
) -> DataFrame:
    """Directed betweenness with the edge weight as length (``distance="inverse"`` uses 1/weight).

    Works on (source, node) rows: distances, then shortest-path counts hop by hop, then
    dependencies hop by hop backwards, each a join and a grouped sum.
    """
    if distance == "inverse":
        edges = edges.withColumn("weight", 1.0 / F.col("weight"))
    links = cut_lineage(edges.where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("weight")))
    everyone = cut_lineage(nodes(links))
    n = everyone.count()
    dist = distances(links, sources if sources is not None else everyone, weighted=True)
    ahead = dist.select("source", F.col("node").alias("dst"), F.col("distance").alias("_to"))
    close = F.abs(F.col("distance") + F.col("weight") - F.col("_to")) <= 1e-9 * (1.0 + F.col("_to"))
    dag = cut_lineage(
        dist.join(links, F.col("node") == F.col("src"))
        .join(ahead, ["source", "dst"])
        .where(close)
        .select("source", F.col("src").alias("u"), F.col("dst").alias("v"))
    )

    def series(first: DataFrame, step) -> DataFrame:
        """Sum of a row vector pushed through the path graph until nothing is left."""
        total, current, rounds = first, first, 0
        while True:
            current = cut_lineage(step(current))
            if current.isEmpty():
                return total.groupBy("source", "node").agg(F.sum("value").alias("value"))
            total = total.unionByName(current)
            rounds += 1
            if rounds % CUT_EVERY == 0:
                total = cut_lineage(total.groupBy("source", "node").agg(F.sum("value").alias("value")))

    def forward(cur: DataFrame) -> DataFrame:
        return (
            dag.join(cur.withColumnRenamed("node", "u"), ["source", "u"])
            .groupBy("source", F.col("v").alias("node"))
            .agg(F.sum("value").alias("value"))
        )

    start = dist.where("source = node").select("source", "node", F.lit(1.0).alias("value"))
    sigma = cut_lineage(series(start, forward))
    ratio = cut_lineage(
        dag.join(sigma.select("source", F.col("node").alias("u"), F.col("value").alias("_su")), ["source", "u"])
        .join(sigma.select("source", F.col("node").alias("v"), F.col("value").alias("_sv")), ["source", "v"])
        .select("source", "u", "v", (F.col("_su") / F.col("_sv")).alias("share"))
    )

    def backward(cur: DataFrame) -> DataFrame:
        return (
            ratio.join(cur.withColumnRenamed("node", "v"), ["source", "v"])
            .groupBy("source", F.col("u").alias("node"))
            .agg(F.sum(F.col("share") * F.col("value")).alias("value"))
        )

    ones = dist.where("source <> node").select("source", "node", F.lit(1.0).alias("value"))
    delta = series(ones, backward)
    own = ones.withColumnRenamed("value", "_one")
    through = (
        delta.join(own, ["source", "node"])
        .groupBy("node")
        .agg(F.sum(F.col("value") - F.col("_one")).alias("through"))
    )
    scale = 1.0 / ((n - 1) * (n - 2)) if normalised and n > 2 else 1.0
    return everyone.join(through, "node", "left").select(
        "node", (F.coalesce("through", F.lit(0.0)) * F.lit(scale)).alias("betweenness")
    )


def modularity(pairs: DataFrame, member: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of a partition (node, community) of an undirected graph (a, b, weight)."""
    m = pairs.agg(F.sum("weight")).first()[0] or 0
    if not m:
        return 0.0
    side = lambda c: member.select(F.col("node").alias(c), F.col("community").alias(f"_{c}"))
    inside = (
        pairs.join(side("a"), "a").join(side("b"), "b").agg(F.sum(F.when(F.expr("_a = _b"), F.col("weight")).otherwise(0)))
    )
    strength = (
        pairs.select(F.explode(F.array("a", "b")).alias("node"), "weight")
        .join(member, "node")
        .groupBy("community")
        .agg(F.sum("weight").alias("k"))
        .agg(F.sum(F.col("k") * F.col("k")))
    )
    return float(inside.first()[0]) / m - resolution * float(strength.first()[0]) / (4.0 * m * m)


def louvain(edges: DataFrame, resolution: float = 1.0, tol: float = 1e-7, seed: int = 42) -> DataFrame:
    """Communities (node, community) by distributed local moves and contraction.

    In one round only half of the nodes (by hash) may move, so neighbours do not swap places
    for ever.  Each half round is one grouped sum of link weights per neighbouring community
    plus a ``max_by``; no neighbourhood is collected.  A level ends when nothing moves or a round of both
    halves no longer raises modularity by ``tol`` (the better state is kept); levels end when one brings no gain.
    Modularity is bounded, so both loops end without a limit on rounds.
    """
    graph = cut_lineage(both_ways(undirected(edges)).withColumn("weight", F.col("weight").cast("double")))
    total = graph.agg(F.sum("weight")).first()[0]
    member = cut_lineage(nodes(graph).select("node", F.col("node").alias("community")))
    if not total:
        return member

    def score(cur: DataFrame, graph: DataFrame) -> float:
        side = lambda c, name: cur.select(F.col("node").alias(c), F.col("community").alias(name))
        inside = graph.join(side("src", "_a"), "src").join(side("dst", "_b"), "dst").where("_a = _b").agg(F.sum("weight")).first()[0]
        masses = cur.groupBy("community").agg(F.sum("k").alias("m")).agg(F.sum(F.col("m") * F.col("m"))).first()[0]
        return (inside or 0.0) / total - resolution * (masses or 0.0) / (total * total)

    while True:
        strength = graph.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
        links = graph.where("src <> dst")
        state = _State(strength.select("node", "k", F.col("node").alias("community"), F.lit(False).alias("_moved")))
        kept, start = state.df, score(state.df, graph)
        best_score, quiet, rnd = start, 0, 0
        while quiet < 2:
            cur = state.df.select("node", "k", "community")
            mass = cur.groupBy("community").agg(F.sum("k").alias("mass"), F.count("*").alias("size"))
            toward = (
                links.join(cur.select(F.col("node").alias("dst"), "community"), "dst")
                .groupBy(F.col("src").alias("node"), "community")
                .agg(F.sum("weight").alias("link"))
            )
            stay = cur.select("node", "community", F.lit(0.0).alias("link"))
            option = (
                toward.unionByName(stay)
                .groupBy("node", "community")
                .agg(F.sum("link").alias("link"))
                .join(mass, "community")
                .join(cur.select("node", "k", F.col("community").alias("_own")), "node")
            )
            mine = F.col("community") == F.col("_own")
            other = F.col("mass") - F.when(mine, F.col("k")).otherwise(0.0)
            gain = F.col("link") - resolution * F.col("k") * other / total
            # Two single nodes must not swap places: only the larger label may join the smaller.
            swap = (F.col("size") == 1) & ~mine & (F.col("community") > F.col("_own"))
            best = option.where(~swap).groupBy("node").agg(
                F.max_by("community", F.struct(F.round(gain, 9), F.col("community"))).alias("_best"),
                F.max(F.round(gain, 9)).alias("_top"),
                F.max(F.when(mine, F.round(gain, 9))).alias("_keep"),
            )
            turn = F.pmod(F.xxhash64("node", F.lit(seed + rnd // 2)), F.lit(2)) == rnd % 2
            moves = turn & (F.col("_top") > F.col("_keep") + 1e-9)
            new = cur.join(best, "node", "left").select(
                "node",
                "k",
                F.when(moves, F.col("_best")).otherwise(F.col("community")).alias("community"),
                F.coalesce(moves, F.lit(False)).alias("_moved"),
            )
            new = state.step(new)
            moved = new.agg(F.count_if("_moved")).first()[0]
            quiet = 0 if moved else quiet + 1
            rnd += 1
            if rnd % 2 == 0:
                now = score(new, graph)
                if now <= best_score + tol:
                    break
                kept, best_score = new, now
        if best_score <= start:
            return member
        step = cut_lineage(kept.select(F.col("node").alias("_from"), F.col("community").alias("_to")))
        member = cut_lineage(
            member.join(step, F.col("community") == F.col("_from")).select("node", F.col("_to").alias("community"))
        )
        graph = cut_lineage(
            graph.join(step.select(F.col("_from").alias("src"), F.col("_to").alias("_s")), "src")
            .join(step.select(F.col("_from").alias("dst"), F.col("_to").alias("_d")), "dst")
            .groupBy(F.col("_s").alias("src"), F.col("_d").alias("dst"))
            .agg(F.sum("weight").alias("weight"))
        )


def org_chart(reports: DataFrame, depth: int = 2, names: DataFrame | None = None) -> DataFrame:
    """Bosses above and reports below each person up to ``depth`` steps (1–5), smallest depth per name.

    ``reports`` is (subordinate, superior).  Returns (name, relation, other, depth).
    """
    depth = max(1, min(int(depth), 5))
    up = reports.select("subordinate", "superior").distinct()
    walk = up.select(F.col("subordinate").alias("low"), F.col("superior").alias("high"), F.lit(1).alias("depth"))
    reach = walk
    for d in range(2, depth + 1):
        walk = (
            walk.join(up, F.col("high") == F.col("subordinate"))
            .select("low", F.col("superior").alias("high"), F.lit(d).alias("depth"))
            .distinct()
        )
        reach = reach.unionByName(walk)
    reach = reach.where("low <> high").groupBy("low", "high").agg(F.min("depth").alias("depth"))
    both = F.array(
        F.struct(F.col("low").alias("name"), F.lit("boss").alias("relation"), F.col("high").alias("other")),
        F.struct(F.col("high").alias("name"), F.lit("report").alias("relation"), F.col("low").alias("other")),
    )
    out = reach.select(F.col("depth").cast("bigint").alias("depth"), F.inline(both)).select(
        "name", "relation", "other", "depth"
    )
    return out.join(names, "name", "left_semi") if names is not None else out


def top_subgraph(edges: DataFrame, n: int) -> DataFrame:
    """Edges among the ``n`` nodes of highest (unweighted) degree, ties by name."""
    top = degrees(edges).orderBy(F.desc("total_degree"), "node").limit(n).select("node")
    return edges.join(top.withColumnRenamed("node", "src"), "src", "left_semi").join(
        top.withColumnRenamed("node", "dst"), "dst", "left_semi"
    ).select("src", "dst", "weight")


def typed_subgraph(
    node_table: DataFrame, edge_table: DataFrame, node_types: list[str], edge_types: list[str], cap: int
) -> DataFrame:
    """Nodes (node, node_type, degree) of the chosen types under the chosen edge types.

    Isolated nodes go when at least one node is connected; at most ``cap`` nodes by degree stay.
    """
    keep = node_table.where(F.col("node_type").isin(node_types))
    inside = (
        edge_table.where(F.col("edge_type").isin(edge_types))
        .join(keep.select(F.col("node").alias("src")), "src", "left_semi")
        .join(keep.select(F.col("node").alias("dst")), "dst", "left_semi")
    )
    deg = (
        inside.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    )
    connected = inside.agg(F.count("*")).scalar()
    scored = keep.join(deg, "node", "left").select("node", "node_type", F.coalesce("degree", F.lit(0)).alias("degree"))
    return scored.where((F.col("degree") > 0) | (connected == 0)).orderBy(F.desc("degree"), "node").limit(cap)
