"""Distances by sketches and searches, betweenness in blocks, against brute force."""

import random

from tieline.operators import network, reach
from tieline.session import work_dir


def ring_with_chords(n, chords, seed=3):
    draw = random.Random(seed)
    pairs = {(i, (i + 1) % n) for i in range(n)} | {tuple(draw.sample(range(n), 2)) for _ in range(chords)}
    return sorted(pairs)


def all_distances(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for s in near:
        seen, front, d = {s}, {s}, 0
        while front:
            d += 1
            front = {y for x in front for y in near[x]} - seen
            seen |= front
            out |= {(s, y): d for y in front}
    return out


def test_distances(spark):
    pairs = ring_with_chords(18, 7)
    far = all_distances(pairs)
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs] + [(900, 901, 1)], "src int, dst int, weight int")
    row = reach.distance_estimates(edges).first()
    mean = sum(far.values()) / len(far)
    assert (row["weak_components"], row["largest_size"], row["steps"]) == (2, 18, max(far.values()))
    assert abs(row["avg_shortest_path"] - mean) < 0.02 * mean
    links = network.both_ways(network.undirected(edges.where("src < 900")))
    longest, searches = reach.diameter(links)
    assert longest == max(far.values()) and 2 <= searches <= 18
    none = reach.distance_estimates(edges.limit(0)).first()
    assert none["weak_components"] == 0 and none["avg_shortest_path"] is None and none["steps"] is None


def test_betweenness_in_blocks_goes_on_where_it_stopped(spark, monkeypatch):
    draw = random.Random(1)
    edges = spark.createDataFrame([(*draw.sample(range(9), 2), draw.randint(1, 3)) for _ in range(26)], "src int, dst int, weight int").dropDuplicates(["src", "dst"])
    want = {r["node"]: r["betweenness"] for r in network.betweenness(edges).collect()}
    ledger, calls, real = work_dir(spark, "ledger"), [], reach.betweenness

    def counted(*args, **kw):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return real(*args, **kw)

    monkeypatch.setattr(reach, "betweenness", counted)
    try:
        reach.betweenness_in_blocks(edges, ledger, 3)
    except RuntimeError:
        pass
    got = {r["node"]: r["betweenness"] for r in reach.betweenness_in_blocks(edges, ledger, 3).collect()}
    assert len(calls) == 4 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_neighbourhoods_move_slices_not_a_sketch_a_link(spark, monkeypatch):
    pairs = ring_with_chords(90, 40, 5)
    far = all_distances(pairs)
    edges = spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}", 1) for a, b in pairs], "src string, dst string, weight int")
    links = network.both_ways(network.undirected(edges))
    whole = reach.neighbourhoods(links, lg_registers=8)
    monkeypatch.setattr(reach, "TASK_BYTES", 700)
    dropped, real = [], reach.drop_step
    monkeypatch.setattr(reach, "drop_step", lambda df: dropped.append(df.columns) or real(df))
    cut = reach.neighbourhoods(links, lg_registers=8)
    blocks, parts = reach._cut(90, links.count(), 256)
    assert blocks > 1 and -(-90 // blocks) * 256 // parts <= 700
    assert len(cut) == len(whole) and all(abs(a - b) < 1e-6 * b for a, b in zip(cut, whole, strict=True))
    want = [90 + sum(d <= t for d in far.values()) for t in range(len(cut))]
    assert cut[:2] == want[:2] and all(abs(a - b) < 0.15 * b for a, b in zip(cut, want, strict=True))
    assert len(dropped) == len(cut) + 1  # every round's state


def test_neighbourhoods_keep_the_slices_of_one_pass_on_disk(spark, monkeypatch):
    pairs = [(0, i) for i in range(1, 40)] + [(39, 40)]
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src int, dst int, weight int")
    links = network.both_ways(network.undirected(edges))
    whole = reach.neighbourhoods(links, lg_registers=6)
    held, real = [], reach.cut_lineage

    def cut(df):
        out = real(df)
        if "regs" in out.columns:
            held.append(out.select("part").distinct().count())
        return out

    monkeypatch.setattr(reach, "cut_lineage", cut)
    monkeypatch.setattr(reach, "PASS_BYTES", 8 * (41 * 4 + 80 * 4), raising=False)  # of 16 slices
    assert reach.neighbourhoods(links, lg_registers=6) == whole
    assert max(held) <= 8 and len(whole) == 4 and whole[:2] == [41, 41 + 80]
