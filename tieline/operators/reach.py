"""Distances and betweenness of whole graphs without a row for each (source, node)."""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window, functions as F

from tieline.operators.network import betweenness, both_ways, components, distances, nodes, undirected
from tieline.session import cut_lineage, drop_step, drop_steps, work_dir


#: Bytes of registers that a task of a round holds at once, and the ways to cut a sketch.
TASK_BYTES, SLICES = 1 << 25, (16, 32, 64)
#: Bytes that the rounds of a pass move at once, about: it bounds what lies on disk.
PASS_BYTES = 1 << 31
#: 2**-register, nothing for an empty one.
WEIGHT = np.r_[0.0, np.exp2(-np.arange(1.0, 256.0))]


def _cut(n: int, links: int, registers: int) -> tuple[int, int]:
    """(blocks of nodes, slices of registers) so that a block's slices fit a task and a round moves least: a sketch at most once
    a block, a link once a slice."""
    ways = [(-(-n * registers // (s * TASK_BYTES)), s) for s in SLICES]
    return min(ways, key=lambda way: way[0] * n * registers + way[1] * links * 4)


def _passes(n: int, links: int, registers: int, blocks: int, parts: int) -> list[range]:
    """The slices of each pass: as many as move at most PASS_BYTES in a round, one at least."""
    at_once = max(1, PASS_BYTES // (blocks * n * registers // parts + links * 4))
    return [range(low, min(low + at_once, parts)) for low in range(0, parts, at_once)]


def _seeds(width: int):
    def seed(batches):
        for batch in batches:
            ids, at, rank = (np.asarray(c) for c in batch.columns)
            regs = np.zeros((len(ids), width), np.uint8)
            regs[np.arange(len(ids)), at % width] = rank
            yield _slices(ids, (at // width).astype(np.int32), regs, np.zeros_like(regs))

    return seed


def _slices(ids: np.ndarray, part: np.ndarray, regs: np.ndarray, before: np.ndarray) -> pa.RecordBatch:
    """Rows of a state with what they add to their nodes' counts since ``before``: how many registers are set, and the sum of
    2**-register over these."""
    full = (regs > 0).sum(axis=1, dtype=np.int32) - (before > 0).sum(axis=1, dtype=np.int32)
    weight = WEIGHT[regs].sum(axis=1) - WEIGHT[before].sum(axis=1)
    offsets = pa.py_buffer((np.arange(len(ids) + 1) * regs.shape[1]).astype(np.int32))
    packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, pa.py_buffer(np.ascontiguousarray(regs))])
    columns = [pa.array(ids), pa.array(part), packed, pa.array((regs != before).any(axis=1)), pa.array(full), pa.array(weight)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "part", "regs", "moved", "full", "weight"])


def _united(width: int, sizes: dict[int, int]):
    """Unites the slices that reach a block; a task holds one (block, part)."""

    def finish(block, part, own, got):
        some = np.flatnonzero(got.any(axis=1))
        for lo in range(0, len(some), 10_000):
            rows = some[lo : lo + 10_000]
            yield _slices((np.int64(block) << 33) + rows, np.full(len(rows), part, np.int32), got[rows], own[rows])

    def add(got, regs, to, lens):
        order = np.argsort(to, kind="stable")
        ends, row = to[order], np.repeat(np.arange(len(lens)), lens)[order]
        first = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
        times = np.diff(np.r_[first, len(ends)])
        step = max(1, (1 << 18) // width)  # what is united at a time stays in the cache
        for lo in range(0, len(first), step):
            at, left = first[lo : lo + step], times[lo : lo + step]
            some = got[ends[at]]
            for k in range(left.max()):  # the k-th sketch of each end that has as many
                more = np.flatnonzero(left > k)
                some[more] = np.maximum(some[more], regs[row[at[more] + k]])
            got[ends[at]] = some

    def unite(batches):
        held = {}
        for batch in batches:
            block, part, sent = (np.asarray(batch.column(i)) for i in range(3))
            edge = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (sent[1:] != sent[:-1])])
            for lo, hi in zip(edge, np.r_[edge[1:], len(block)], strict=True):
                key = int(block[lo]), int(part[lo])
                if key not in held:
                    held[key] = tuple(np.zeros((sizes[key[0]], width), np.uint8) for _ in range(2))
                own, got = held[key]
                regs, to = batch.column(3).slice(lo, hi - lo), batch.column(4).slice(lo, hi - lo)
                at = np.frombuffer(regs.buffers()[1], np.int32)[regs.offset]
                flat = np.frombuffer(regs.buffers()[2], np.uint8)[at : at + len(regs) * width].reshape(-1, width)
                ends = np.asarray(to.flatten())
                if not sent[lo]:
                    own[ends] = flat
                add(got, flat, ends, np.asarray(to.value_lengths()))
        for key, state in held.items():
            yield from finish(*key, *state)

    return unite


def neighbourhoods(links: DataFrame, at_least: int = 0, lg_registers: int = 12) -> list[float]:
    """How many (node, node) pairs lie within 0, 1, … steps, by sketches united along the links, until none of them changes.

    A node's sketch (2**lg_registers one-byte registers) counts the nodes it has reached; a round unites it with those of its
    neighbours.  The standard error of a count is about 1 / sqrt(2**lg_registers), 1.6 % by default; the counts of 0 and 1 steps are exact.
    ``links`` holds each link in both directions (src, dst), once; ``at_least`` rounds are run.

    Nodes lie in blocks by their order and sketches are cut into slices.  A slice that changed goes once to each block that
    its node has links into, with the list of their ends, and is united there: no sketch is moved or written for each link.
    A task holds two copies of one slice of one block.

    Slices do not depend on each other, so they go through their rounds in passes of about PASS_BYTES.  On disk are the last state of
    a pass, what its round moves, and for each node and round what its slices so far have added to its count.
    """
    spark, registers = links.sparkSession, 1 << lg_registers
    everyone = cut_lineage(nodes(links))
    n, n_links = everyone.count(), links.count()
    if not n:
        return [0.0]
    blocks, parts = _cut(n, n_links, registers)
    parts = min(parts, registers)
    width = registers // parts
    ids = cut_lineage(everyone.repartitionByRange(blocks, "node").select("node", F.monotonically_increasing_id().alias("id")))
    block, index = F.shiftright("id", 33).cast("int"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).cast("int")
    sizes = {r["block"]: r["n"] for r in ids.groupBy(block.alias("block")).agg(F.count("*").alias("n")).collect()}
    ends = ids.select(F.col("node").alias("dst"), block.alias("block"), index.alias("to"))
    out = links.select("src", "dst").join(ends, "dst").join(ids.withColumnRenamed("node", "src"), "src")
    out = cut_lineage(out.groupBy("id", "block").agg(F.collect_list("to").alias("to")))

    bits = F.xxhash64(F.col("node").cast("string"))
    left = F.shiftrightunsigned(bits, lg_registers)
    rank = F.lit(64 - lg_registers + 1) - F.when(left == 0, 0).otherwise(F.length(F.bin(left)))
    seeds = ids.select("id", bits.bitwiseAND(F.lit(registers - 1)).cast("int").alias("at"), rank.cast("int").alias("rank"))
    schema = "id bigint, part int, regs binary, moved boolean, full int, weight double"
    totals = [F.sum("full").alias("full"), F.sum("weight").alias("weight")]
    seen, steps = None, 0
    for share in _passes(n, n_links, registers, blocks, parts):
        path, step = work_dir(spark, "gains"), 0
        state = cut_lineage(seeds.where(F.col("at").between(share.start * width, share.stop * width - 1)).mapInArrow(_seeds(width), schema))
        while True:
            gains = state.where("moved").groupBy("id").agg(*totals)
            gains.select("id", F.lit(step).alias("step"), "full", "weight").write.mode("append").parquet(path)
            sent = state.where("moved").join(out, "id").select("block", "part", F.lit(True).alias("sent"), "regs", "to")
            own = state.select(block.alias("block"), "part", F.lit(False).alias("sent"), "regs", F.array(index).alias("to"))
            task = F.col("block") * len(share) + F.col("part") - F.lit(share.start)
            met = own.unionByName(sent).repartitionById(blocks * len(share), task.cast("int")).mapInArrow(_united(width, sizes), schema)
            changed = Observation()
            before, state = state, cut_lineage(met.observe(changed, F.count_if("moved").alias("n")))
            drop_step(before)
            if not changed.get["n"]:
                drop_step(state)
                break
            step += 1
        steps = max(steps, step)
        gains = spark.read.parquet(path)
        parts_seen = [gains] if seen is None else [gains, seen]
        seen = cut_lineage(reduce(DataFrame.unionByName, parts_seen).groupBy("id", "step").agg(*totals))
        drop_steps(*parts_seen)
    empty = (F.lit(registers) - F.col("full")) / registers
    # Ertl's estimate: right over the whole range, from the empty registers and the weights of the others.
    sigma = reduce(lambda a, b: a + b, [F.pow(empty, F.lit(float(1 << k))) * float(1 << (k - 1)) for k in range(1, lg_registers + 8)], empty)
    count = F.lit(registers**2 / (2 * math.log(2))) / (F.col("weight") + registers * sigma)
    so_far = Window.partitionBy("id").orderBy("step")
    reached = seen.select("id", "step", F.sum("full").over(so_far).alias("full"), F.sum("weight").over(so_far).alias("weight")).select("id", "step", count.alias("n"))
    more = reached.select("step", (F.col("n") - F.coalesce(F.lag("n").over(so_far), F.lit(0.0))).alias("n")).groupBy("step").agg(F.sum("n").alias("n"))
    more = {r["step"]: r["n"] for r in more.collect()}
    drop_steps(seen, ids, out, everyone)
    counts = list(accumulate(more.get(t, 0.0) for t in range(max(steps, at_least) + 1)))
    return [float(n), *[float(n + n_links)][: len(counts) - 1], *counts[2:]]


def diameter(links: DataFrame) -> tuple[int, int]:
    """The exact diameter of a connected graph and how many breadth-first searches it took.

    A search from a node bounds every other eccentricity: at least max(distance, eccentricity - distance), at most eccentricity
    + distance.  Searches start at the node of most links, then take the node that could be farthest, and the most central one, in turn.
    When no node can lie farther than the longest distance seen, that is the diameter.  Each search is one row a node.
    """
    spark = links.sparkSession
    degree = links.groupBy("src").agg(F.count("*").alias("n"))
    start = degree.orderBy(F.desc("n"), "src").limit(1).collect()
    if not start:
        return 0, 0
    state = cut_lineage(nodes(links).select("node", F.lit(0.0).alias("low"), F.lit(math.inf).alias("high"), F.lit(False).alias("done")))
    source, longest, searches = start[0]["src"], 0.0, 0
    while True:
        seen = distances(links, spark.createDataFrame([(source,)], state.select("node").schema)).select("node", "distance")
        farthest = seen.agg(F.max("distance")).first()[0]
        longest, searches = max(longest, farthest), searches + 1
        low = F.greatest("low", "distance", F.lit(farthest) - F.col("distance"))
        high = F.least("high", F.lit(farthest) + F.col("distance"))
        state = cut_lineage(state.join(seen, "node").select("node", low.alias("low"), high.alias("high"), (F.col("done") | (F.col("node") == F.lit(source))).alias("done")))
        left = state.where(~F.col("done") & (F.col("high") > longest) & (F.col("low") < F.col("high")))
        order = F.struct(-F.col("high"), F.col("node")) if searches % 2 else F.struct(F.col("low"), F.col("node"))
        following = left.agg(F.min_by("node", order)).first()[0]
        if following is None:
            return int(longest), searches
        source = following


def distance_estimates(edges: DataFrame, lg_registers: int = 12) -> DataFrame:
    """(weak_components, largest_size, steps, avg_shortest_path) of the largest weak component, links taken both ways.

    Components and size are exact.  The mean distance comes from :func:`neighbourhoods` and carries the sketches' error, except that
    the pairs within no, one and all steps are exact; ``steps`` is the number of rounds that changed a sketch, the diameter unless its
    last pairs change none.  No row a pair of nodes exists.  An empty graph has no components and null distances.
    """
    pairs = cut_lineage(undirected(edges))
    comp = cut_lineage(components(edges))
    sizes = cut_lineage(comp.groupBy("component").agg(F.count("*").alias("size")))
    biggest = sizes.orderBy(F.desc("size"), "component").limit(1)
    inside = comp.join(biggest.select("component"), "component", "left_semi").select(F.col("node").alias("src"))
    links = cut_lineage(both_ways(pairs).join(inside, "src", "left_semi").select("src", "dst"))
    drop_steps(pairs, comp)
    counts = neighbourhoods(links, 0, lg_registers)
    drop_steps(links)
    if len(counts) > 1:
        counts[-1] = counts[0] ** 2  # one component: every pair is reached
    reached = counts[-1] - counts[0]
    mean = sum(t * (b - a) for t, (a, b) in enumerate(zip(counts, counts[1:], strict=False), 1)) / reached if reached > 0 else None
    return sizes.agg(
        F.count("*").alias("weak_components"), F.max("size").alias("largest_size"),
        F.lit(len(counts) - 1 if reached > 0 else None).cast("bigint").alias("steps"), F.lit(mean).cast("double").alias("avg_shortest_path"),
    )


def betweenness_in_blocks(edges: DataFrame, ledger: str, blocks: int, distance: str = "weight") -> DataFrame:
    """(node, betweenness) over every source, ``blocks`` groups of sources one after the other, resumable.

    Each group's share is a table below ``ledger`` that counts once it is whole; a run that is stopped and repeated computes
    only the groups that are missing.  A group holds (sources of the group) x nodes rows, so choose ``blocks`` to fit.
    """
    spark = edges.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(ledger).getFileSystem(spark._jsc.hadoopConfiguration())
    everyone = cut_lineage(nodes(edges.where("src <> dst")))
    n = everyone.count()
    for block in range(blocks):
        if not fs.exists(path(f"{ledger}/block={block}/_SUCCESS")):
            sources = everyone.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == block)
            betweenness(edges, sources, distance, normalised=False).write.mode("overwrite").parquet(f"{ledger}/block={block}")
    shares = spark.read.parquet(*[f"{ledger}/block={b}" for b in range(blocks)])
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return shares.groupBy("node").agg((F.sum("betweenness") * F.lit(scale)).alias("betweenness"))
