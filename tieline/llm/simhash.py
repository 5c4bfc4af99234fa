"""Operator 4: near-duplicate groups by SimHash and pigeonhole blocks."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tieline.llm.common import doc_texts, with_whole_row
from tieline.session import cut_lineage


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed integer."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # the bit matrix of a long text stays small
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def simhash(text: bytes, shingle: int = 3, distinct: bool = False, seeds: tuple[int, ...] = (42,)) -> list[int]:
    """A fingerprint for each seed, over all shingles or over the distinct ones; zeros for a text without words."""
    words = text.lower().split()
    if not words:
        return [0] * len(seeds)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))) if shingle > 1 else words
    if distinct:
        grams = list(set(grams))
    return [_majority(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype="<u8", count=len(grams))) for seed in seeds]


def fingerprints(docs: DataFrame, shingle: int = 3, distinct: bool = False, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(doc_id, content, fps): fingerprints of whole texts as signed integers; ``content`` is a hash of the exact text."""

    def batches(it):
        for batch in it:
            fps = [simhash(t, shingle, distinct, seeds) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "content", "fps"])

    rows = doc_texts(docs, as_bytes=True).select("doc_id", F.xxhash64("text").alias("content"), "text")
    return rows.mapInArrow(batches, "doc_id bigint, content bigint, fps array<bigint>")


def _block_keys(fp: Column, max_bits: int, blocks: int) -> list[Column]:
    """Fingerprints that differ in ``max_bits`` bits agree on all but ``max_bits`` blocks: one key for each choice of the others."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = []
    for n, kept in enumerate(combinations(masks, blocks - max_bits)):
        mask = reduce(lambda a, b: a | b, kept)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(n).cast("tinyint").alias("choice"), fp.bitwiseAND(F.lit(signed)).alias("value")))
    return keys


def links(distinct: DataFrame, max_bits: int = 2, blocks: int = 4, pair_limit: int = 32) -> DataFrame:
    """(t, a, b): links that connect all distinct fingerprints ``fp`` of one table ``t`` at most ``max_bits`` apart.

    Blocks shared by up to ``pair_limit`` fingerprints are joined pairwise and verified.  From a fuller block every
    fingerprint goes on to the points within half of ``max_bits``: two fingerprints meet at such a point if and only if they
    are within ``max_bits`` of each other, so those at a point are tied to its smallest.  That is exact too, and grows with
    the fingerprints, not with their pairs.  ``max_bits`` is even.
    """
    if max_bits % 2:
        raise ValueError("max_bits must be even")
    keys = F.array(*_block_keys(F.col("fp"), max_bits, blocks))
    blocked = distinct.select("t", "fp", F.inline(keys))
    on = ["t", "choice", "value"]
    sizes = blocked.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(blocked.join(sizes, on))
    few = shared.where(F.col("n") <= pair_limit)
    pairs = few.select(*on, F.col("fp").alias("a")).join(few.select(*on, F.col("fp").alias("b")), on)
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("t", "a", "b")
    crowded = shared.where(F.col("n") > pair_limit).select("t", "fp").distinct()
    flips = F.array(*[F.lit(m) for m in _flips(max_bits // 2)])
    met = crowded.select("t", "fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    least = met.groupBy("t", "point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("t", "point", "a")
    halfway = met.join(least, ["t", "point"]).where("a <> fp").select("t", "a", F.col("fp").alias("b"))
    return pairs.unionByName(halfway).distinct()


def _flips(upto: int) -> list[int]:
    """Masks of at most ``upto`` set bits, as signed integers."""
    masks = [sum(1 << i for i in bits) for k in range(upto + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every linked node, the root being its component's smallest node.

    Each round ties every node to the smallest neighbour seen, then all larger neighbours and the node to that
    minimum, until no link changes.  Every round is written to the shared folder and checked by an order-free
    digest of its links.
    """
    state = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        state = cut_lineage(small.where("u <> v").distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def groups(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(node, component_id, keeper): groups of the documents in ``prints``, linked if any of their fingerprints are close.

    ``node`` is the first fingerprint: documents that share it are one node before anything is joined.
    ``component_id`` is the smallest document id of the group (null if it has none), ``keeper`` the content that goes with it.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "content"))
    nodes = cut_lineage(prints.groupBy(F.col("fps")[0].alias("node")).agg(first.alias("first")))
    tables = prints.select(F.col("fps")[0].alias("node"), F.posexplode("fps").alias("t", "fp")).groupBy("t", "fp", "node").agg(F.lit(1).alias("one"))
    tables = cut_lineage(tables.select("t", "fp", "node"))
    heads = cut_lineage(tables.groupBy("t", "fp").agg(F.min("node").alias("head")))
    same = tables.join(heads, ["t", "fp"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    near = links(heads.select("t", "fp"), max_bits)
    near = near.join(heads.select("t", F.col("fp").alias("a"), F.col("head").alias("ha")), ["t", "a"])
    near = near.join(heads.select("t", F.col("fp").alias("b"), F.col("head").alias("hb")), ["t", "b"])
    member = connected(same.unionByName(near.select(F.col("ha").alias("a"), F.col("hb").alias("b")))).withColumnRenamed("node", "of")
    labelled = nodes.join(member, nodes["node"] == member["of"], "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    labelled = cut_lineage(labelled)
    roots = labelled.groupBy("root").agg(F.min("first").alias("first"))
    return labelled.select("node", "root").join(roots, "root").select("node", F.col("first.doc_id").alias("component_id"), F.col("first.content").alias("keeper"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row a document.

    Null and empty texts have fingerprint zero and are linked like any other; rows that share an id are rows of
    their own; a group without any id has a null component.  An empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(docs, shingle))
    found = prints.select("doc_id", F.col("fps")[0].alias("node")).join(groups(prints, max_bits), "node")
    return found.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


#: MinHash keys of the pipeline's stage: pairs at a similarity of 0.8 share one of the keys but for 1 in 300,000.
_BANDS, _ROWS = 32, 5
_XOR, _ODD = (np.random.default_rng(5).integers(0, 1 << 64, (2, _BANDS * _ROWS, 1), dtype=np.uint64) | np.array([[[0]], [[1]]], np.uint64))


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, a text without words has none."""
    words = text.lower().split()
    if len(words) < shingle:
        grams = [b" ".join(words)] if words else []
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)))


def bit_sketch(grams: np.ndarray) -> np.ndarray:
    """1,024 bits, each set if a shingle falls on it, as signed integers: a set bit the other set lacks is a shingle it lacks."""
    held = np.zeros(1024, np.uint8)
    held[(grams >> np.uint64(17)).astype(np.int64) & 1023] = 1
    return np.packbits(held, bitorder="little").view("<i8")


def band_keys(grams: np.ndarray) -> list[int]:
    """One key for each band of least hashes, as signed integers; none for the empty set."""
    if not len(grams):
        return []
    least = np.full(_BANDS * _ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(grams), 1 << 12):  # the products of a long text stay small
        least = np.minimum(least, ((grams[i : i + (1 << 12)] ^ _XOR) * _ODD).min(axis=1))
    return [xxhash.xxh64_intdigest(row.tobytes(), n) - (1 << 63) for n, row in enumerate(least.reshape(_BANDS, _ROWS))]


#: Shingles that two similar sets share, at least, among the first of both (all that they share, if fewer).
_FIRST = 32


def first_shingles(grams: np.ndarray, percent: int) -> np.ndarray:
    """The smallest hashes of a set: those of two sets that share ``percent`` hundredths of their union have ``_FIRST`` in common.

    At most n - ceil(n * percent / 100) of a set's n shingles are not shared, so the ``_FIRST``-th shared one lies this early in both.
    """
    return grams[: len(grams) - -(-len(grams) * percent // 100) + _FIRST]


def _set_prints(docs: DataFrame, shingle: int, percent: int = 80) -> DataFrame:
    """(doc_id, content, node, n, keys, early): ``node`` is a hash of the shingle set, ``n`` its size, ``early`` its first shingles."""

    def batches(it):
        for batch in it:
            sets = [shingle_set(t, shingle) for t in batch.column(2).to_pylist()]
            out = [pa.array([xxhash.xxh64_intdigest(g.tobytes()) - (1 << 63) for g in sets], pa.int64()), pa.array(map(len, sets), pa.int64())]
            out.append(pa.array(map(band_keys, sets), pa.list_(pa.int64())))
            out.append(pa.array([first_shingles(g, percent).view(np.int64) for g in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], names=["doc_id", "content", "node", "n", "keys", "early"])

    rows = doc_texts(docs, as_bytes=True).select("doc_id", F.xxhash64("text").alias("content"), "text")
    return rows.mapInArrow(batches, "doc_id bigint, content bigint, node bigint, n bigint, keys array<bigint>, early array<bigint>")


def _shingle_sets(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, grams, bits): the shingle sets of the ``wanted`` nodes as bytes, read from one document of each, and their sketches."""

    def sets(it):
        for batch in it:
            grams = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            bits = pa.array([bit_sketch(g) for g in grams], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g.tobytes() for g in grams], pa.binary()), bits], names=["node", "grams", "bits"])

    found = wanted.select("node").distinct().join(nodes.select("node", "first"), "node")
    found = found.select("node", F.col("first.doc_id").alias("id"), F.col("first.content").alias("content"))
    texts = doc_texts(docs, as_bytes=True).withColumn("content", F.xxhash64("text"))
    same = texts["doc_id"].eqNullSafe(found["id"]) & (texts["content"] == found["content"])
    texts = texts.join(found, same).select("node", "text").groupBy("node").agg(F.first("text").alias("text"))
    return cut_lineage(texts.mapInArrow(sets, "node bigint, grams binary, bits array<bigint>"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have a Jaccard similarity of at least ``percent`` hundredths."""

    def alike(it):
        for batch in it:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(k), F.col("grams").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return cut_lineage(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(alike, "a bigint, b bigint"))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(gram, node, n, at): the rarest shingles of each set, as many as one of them must be in any similar set.

    Sets of n shingles in one order that share ``percent`` hundredths of their union share one of the first
    n - ceil(n * percent / 100) + 1.  The order is by how many of the sets hold a shingle, so what many texts share comes
    last and a family of texts with a common passage does not meet there.  A shingle of one set alone counts but meets none.
    """

    def spread(it):
        for batch in it:
            for node, grams in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                grams = np.frombuffer(grams.as_buffer(), np.int64)
                for i in range(0, len(grams), 1 << 15):
                    part = grams[i : i + (1 << 15)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node)), pa.array(np.full(len(part), len(grams))), pa.array(part)], names=["node", "n", "gram"])

    rows = cut_lineage(sets.select("node", "grams").mapInArrow(spread, "node bigint, n bigint, gram bigint"))
    often = rows.groupBy("gram").agg(F.count("*").alias("often")).where("often > 1")
    # The list below is one text's own shingles.
    lists = rows.join(often, "gram").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("grams"))
    alone = F.col("n") - F.size("grams")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    lists = lists.select("node", "n", alone.alias("alone"), F.slice("grams", 1, F.greatest(length, F.lit(0)).cast("int")).alias("grams"))
    return lists.select("node", "n", "alone", F.posexplode("grams").alias("i", "g")).select("g.gram", "node", "n", (F.col("alone") + F.col("i")).alias("at"))


def _met(runs: DataFrame, label: str) -> DataFrame:
    """The rows of ``runs`` whose shingle (gram) stands under several values of ``label``."""
    runs = runs.repartition("gram")  # moved once, for the groups and for the join
    several = runs.groupBy("gram").agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low <> high")
    return runs.join(several.select("gram"), "gram")


def similar(docs: DataFrame, nodes: DataFrame, shingle: int = 5, percent: int = 80, heads: int = 8, runs: DataFrame | None = None) -> DataFrame:
    """(a, b): verified links that connect all ``nodes`` (node, first, n, keys) of similar shingle sets.

    First each node is compared with the smallest node of each of its keys.  Where ``runs`` (gram, node) has the first shingles of
    every node, the nodes that share enough of them with other components go on, and no similar pair is left out; without it those
    of keys that still hold several components, and a similar pair without a common key is left out.  They go on by their rarest shingles, where every similar pair meets: in rounds each is compared with ``heads``
    nodes a shingle, a number of rows in proportion to the shingles, for as long as a round joins a hundredth of the nodes
    that are left.  All pairs that share such a shingle across the last components are compared at the end, so rounds
    change the work and not the components.  Pairs leave these joins only if sizes, places in the orders and bit sketches
    allow enough shared shingles: exact bounds that every similar pair meets.  No key, shingle or pair is capped.
    """
    sized = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    blocked = nodes.select("node", "n", F.explode("keys").alias("key"))
    sizes = blocked.groupBy("key").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("size")).where("size > 1")
    shared = cut_lineage(blocked.join(sizes.select("key", "head"), "key"))
    stars = shared.where((F.col("node") != F.col("head.node")) & sized(F.col("n"), F.col("head.n"))).select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct()
    wanted, enough_met = shared.select("node"), F.col("met") >= F.least(F.lit(_FIRST), F.ceil(F.col("n") * percent / 100))
    if runs is not None:
        met = cut_lineage(_met(runs, "node"))
        known = cut_lineage(met.groupBy("node").agg(F.count("*").alias("met")).join(nodes.select("node", "n"), "node").where(enough_met).select("node", "n"))
        wanted = wanted.unionByName(known.select("node"))
    sets = _shingle_sets(wanted, docs, nodes, shingle)
    links = _verified(cut_lineage(stars), sets, percent)
    root = connected(links).withColumnRenamed("node", "of")
    rooted = lambda rows: rows.join(root, rows["node"] == root["of"], "left").withColumn("root", F.coalesce("root", "node")).drop("of")

    def mixed(rows: DataFrame, key: str) -> DataFrame:
        several = rows.groupBy(key).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        return rows.join(several.select(key), key)

    if runs is None:
        left = cut_lineage(mixed(cut_lineage(rooted(shared.select("key", "node"))), "key").select("node", "root").distinct())
    else:
        apart_met = _met(cut_lineage(rooted(met.join(known, "node"))), "root").groupBy("node", "n", "root").agg(F.count("*").alias("met"))
        left = cut_lineage(apart_met.where(enough_met).select("node", "root"))
    open_ = cut_lineage(mixed(_prefixes(sets.join(left.select("node"), "node", "left_semi"), percent).join(left.join(sets.select("node", "bits"), "node"), "node"), "gram"))
    # Sets that meet at places i and j of their orders share at most the rest of either.
    needed = lambda p, q: F.ceil((p["n"] + q["n"]) * percent / (100 + percent))
    enough = lambda p, q: F.least(p["n"] - p["at"], q["n"] - q["at"]) >= needed(p, q)
    # A bit of one sketch that the other lacks stands for a shingle, at least, that is not shared.
    lacks = lambda p, q: F.aggregate(F.zip_with(p["bits"], q["bits"], lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda a, c: a + c)
    shares = lambda p, q: F.least(p["n"] - lacks(p, q), q["n"] - lacks(q, p)) >= needed(p, q)
    apart = lambda p, q: (p["root"] != q["root"]) & sized(p["n"], q["n"]) & enough(p, q) & shares(p, q)
    entry = F.struct("node", "root", "n", "at", "bits")
    tried = cut_lineage(stars)
    for turn in count():
        # A head early in its own order can meet sets of its size, a later one only smaller sets.
        late = F.col("at") * (100 + percent) > F.col("n") * (100 - percent)
        chosen = [F.min_by(entry, F.struct(late, F.xxhash64("node", "gram", F.lit(turn * heads + i)))) for i in range(heads)]
        first = open_.groupBy("gram").agg(F.array_distinct(F.array(*chosen)).alias("heads")).select("gram", F.explode("heads").alias("head"))
        pairs = open_.select("gram", entry.alias("one")).join(first, "gram").where(apart(F.col("one"), F.col("head")))
        pairs = pairs.select(F.least("one.node", "head.node").alias("a"), F.greatest("one.node", "head.node").alias("b")).distinct()
        pairs = cut_lineage(pairs.join(tried, ["a", "b"], "left_anti"))
        new = _verified(pairs, sets, percent)
        links, tried = links.unionByName(new), tried.unionByName(pairs)
        at = open_.select("node", "root").distinct()
        joined = new.join(at.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(at.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        moved = connected(joined.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("of"), F.col("root").alias("to"))
        n_moved, n_left = moved.count(), at.count()
        open_ = open_.join(moved, F.col("root") == F.col("of"), "left").withColumn("root", F.coalesce("to", "root")).drop("of", "to")
        open_ = cut_lineage(mixed(open_, "gram"))
        if 100 * n_moved < n_left or not n_left:
            break
    left, right = (open_.select("gram", entry.alias(side)) for side in ("one", "two"))
    rest = left.join(right, "gram").where((F.col("one.node") < F.col("two.node")) & apart(F.col("one"), F.col("two")))
    rest = rest.select(F.col("one.node").alias("a"), F.col("two.node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    return links.unionByName(_verified(cut_lineage(rest), sets, percent))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that with the smallest id, all its columns unchanged.

    Two documents are linked if the sets of their ``shingle``-word runs (lower case, split at white space) have a Jaccard
    similarity of at least ``percent`` hundredths; each link is verified on the sets.  Candidates share a MinHash key or enough
    of their first runs, where every similar pair meets.  A text of fewer words is one run.  Null and empty texts form one group.
    Of rows that repeat an id and its text one stays.
    """
    prints = _set_prints(docs, shingle, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "content"))
    nodes = cut_lineage(prints.groupBy("node").agg(first.alias("first"), *[F.first(c).alias(c) for c in ("n", "keys", "early")]))
    runs = nodes.select(F.explode("early").alias("gram"), "node")
    member = connected(similar(docs, nodes, shingle, percent, runs=runs)).withColumnRenamed("node", "of")
    labelled = nodes.select("node", "first").join(member, F.col("node") == F.col("of"), "left")
    roots = labelled.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    keep = cut_lineage(roots.select(F.col("first.doc_id").alias("id"), F.col("first.content").alias("content")).distinct())
    rows = with_whole_row(docs).select("row", F.col("row.doc_id").cast("bigint").alias("id"), F.xxhash64(F.coalesce("row.text", F.lit("")).cast("binary")).alias("content"))
    both = rows["id"].eqNullSafe(keep["id"]) & (rows["content"] == keep["content"])
    kept = rows.join(keep, both, "left_semi")
    repeated = rows.groupBy("id", "content").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["id", "content"])
    return kept.select("row.*")
