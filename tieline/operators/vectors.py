"""Vector search, centroids and reduction."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tieline.operators.density import density_clusters
from tieline.operators.ordering import top_per_key
from tieline.session import cut_lineage

# Largest matrix that one task holds (numbers of 8 bytes: 32 MB).  A query or centroid set up to this size is
# sent to every task; a larger one stays a table and meets the items block by block.
BLOCK_CELLS = 4_000_000
# Products held at once inside a task.
PRODUCT_CELLS = 2_000_000
# Similarities are compared after rounding, so that equal vectors tie and ids break the tie.
TIE_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Cosine similarity; ``floor`` is added to the norm product."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(floor))


def unit(v: Column) -> Column:
    # The norm is bound once: inside the lambda over ``v`` it would be summed anew for every component.
    scaled = lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), scaled), F.lit(0))


def truncated(v: Column, dims: int) -> Column:
    """First ``dims`` components, normalised again."""
    return unit(F.slice(v, 1, dims))


def _block_count(df: DataFrame, vec: str) -> int:
    """How many blocks of BLOCK_CELLS numbers hold ``df``; only two counters reach the driver."""
    size = df.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d")).first()
    return math.ceil(size["n"] * max(size["d"] or 0, 1) / BLOCK_CELLS)


def _unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _similarities(vectors: np.ndarray, matrix: np.ndarray):
    """(first row, block of rounded cosines), vectors down and matrix rows across; a value that is no number sinks below all."""
    step = max(1, PRODUCT_CELLS // max(1, len(matrix)))
    for lo in range(0, len(vectors), step):
        sims = np.round(vectors[lo : lo + step] @ matrix.T, TIE_DIGITS)
        yield lo, np.where(np.isnan(sims), -np.inf, sims)


def _best(vectors: np.ndarray, ids: pa.Array, matrix: np.ndarray, k: int) -> pa.Table:
    """(q, s, i): for each of ``vectors`` its ``k`` nearest rows of ``matrix``, equal similarities by id."""
    found = [pa.table({"q": pa.array([], pa.int64()), "s": pa.array([], pa.float64()), "i": ids[:0]})]
    for lo, sims in _similarities(vectors, matrix):
        n = sims.shape[1]
        cut = np.partition(sims, n - k, axis=1)[:, n - k, None] if n > k else -np.inf
        q, j = np.nonzero((sims >= cut) & (sims > -np.inf))
        found.append(_first_k(pa.table({"q": q + lo, "s": sims[q, j], "i": ids.take(pa.array(j))}), k))
    return pa.concat_tables(found)


def _first_k(rows: pa.Table, k: int) -> pa.Table:
    rows = rows.sort_by([("q", "ascending"), ("s", "descending"), ("i", "ascending")])
    q = rows["q"].to_numpy()
    return rows.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


def _by_blocks(items: DataFrame, others: DataFrame, item: str, vec: str, other: str, ovec: str, fn, schema: T.StructType) -> DataFrame:
    """``fn`` over every pair of an item block and a block of ``others``, joined on the two block numbers.

    Items are sent once for each block of the other table and the other way round; a task holds one block of either.
    """
    n, m = max(1, _block_count(items, vec)), _block_count(others, ovec)
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = items.select(item, vec, F.pmod(F.xxhash64(item, vec), F.lit(n)).cast("int").alias("_i")).withColumn("_o", each(m))
    right = others.select(other, ovec, F.pmod(F.xxhash64(other, ovec), F.lit(m)).cast("int").alias("_o")).withColumn("_i", each(n))
    pairs = left.groupBy("_i", "_o").cogroup(right.groupBy("_i", "_o"))

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_arrays([pa.array([], _arrow(f.dataType)) for f in schema.fields], names=schema.names)
        return fn(a[item].combine_chunks(), _unit_rows(a[vec]), b[other].combine_chunks(), _unit_rows(b[ovec]))

    return pairs.applyInArrow(match, schema)


def _one_block(df: DataFrame, key: str, vec: str) -> tuple[list, np.ndarray]:
    """The keys and unit rows of a table already known to fit one block."""
    rows = df.select(key, vec).orderBy(key).collect()
    return [r[0] for r in rows], _unit_rows(pa.array([r[1] for r in rows], pa.list_(pa.float64())))


def cosine_top_k(
    items: DataFrame, queries: DataFrame, k: int, item: str = "vec_id", vec: str = "embedding", query: str = "query_id", qvec: str = "query"
) -> DataFrame:
    """Exact ``k`` nearest items per query: (query, item, similarity, rank).

    Up to BLOCK_CELLS numbers, the queries go to every task in one scan of the items; a larger set stays a table and is
    joined block by block.  Either way a task keeps its own best ``k`` per query, so only those are shuffled for the
    final rank.  Filters belong before the call and reach the scan.  Null vectors take no part.
    """
    fields = {f.name: f.dataType for f in items.schema.fields} | {f.name: f.dataType for f in queries.schema.fields}
    schema = T.StructType(
        [T.StructField(query, fields[query]), T.StructField(item, fields[item]), T.StructField("similarity", T.DoubleType())]
    )
    narrow = items.where(F.col(vec).isNotNull()).select(item, vec)
    asked = queries.where(F.col(qvec).isNotNull()).select(query, qvec)
    blocks = _block_count(asked, qvec)

    def named(best: pa.Table, keys: pa.Array) -> pa.Table:
        return pa.Table.from_arrays([keys.take(best["q"].combine_chunks()), best["i"], best["s"]], names=[query, item, "similarity"])

    if not blocks:
        found = items.sparkSession.createDataFrame([], schema)
    elif blocks == 1:
        listed, matrix = _one_block(asked, query, qvec)
        kind = _arrow(fields[query])

        def scan(batches):
            keys, best = pa.array(listed, kind), None
            for batch in batches:
                if batch.num_rows:
                    near = _best(matrix, batch.column(item), _unit_rows(batch.column(vec)), k)
                    best = near if best is None else _first_k(pa.concat_tables([best, near]), k)
            if best is not None and best.num_rows:
                yield from named(best, keys).to_batches()

        found = narrow.mapInArrow(scan, schema)
    else:
        found = _by_blocks(narrow, asked, item, vec, query, qvec, lambda ids, rows, keys, qs: named(_best(qs, ids, rows, k), keys), schema)
    return top_per_key(found, [query], [F.desc("similarity"), F.col(item)], k)


def nearest_centroid(items: DataFrame, centroids: DataFrame, item: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """(item, label, similarity) of the centroid with the highest cosine; the smallest label wins a tie."""
    kind = {f.name: f.dataType for f in centroids.schema.fields}[label]
    key = {f.name: f.dataType for f in items.schema.fields}[item]
    schema = T.StructType([T.StructField(item, key), T.StructField(label, kind), T.StructField("similarity", T.DoubleType())])
    narrow = items.where(F.col(vec).isNotNull()).select(item, vec)
    blocks = _block_count(centroids, "centroid")

    def assigned(ids: pa.Array, rows: np.ndarray, names: pa.Array, mids: np.ndarray) -> pa.Table:
        best = _best(rows, names, mids, 1)
        return pa.Table.from_arrays([ids.take(best["q"].combine_chunks()), best["i"], best["s"]], names=[item, label, "similarity"])

    if not blocks:
        return items.sparkSession.createDataFrame([], schema)
    if blocks == 1:
        listed, matrix = _one_block(centroids, label, "centroid")
        names = pa.array(listed, _arrow(kind))

        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    yield from assigned(batch.column(item), _unit_rows(batch.column(vec)), names, matrix).to_batches()

        return narrow.mapInArrow(assign, schema)
    found = _by_blocks(narrow, centroids, item, vec, label, "centroid", assigned, schema)
    top = found.groupBy(item).agg(F.min(F.struct((-F.col("similarity")).alias("s"), label)).alias("_b"))
    return top.select(item, f"_b.{label}", (-F.col("_b.s")).alias("similarity"))


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"integer": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}[kind.typeName()]


def centroids(items: DataFrame, label: str = "label", vec: str = "embedding", min_size: int = 1) -> DataFrame:
    """(label, n, centroid): mean vector per label, small groups dropped.

    The mean is a streaming aggregate with map-side partials; no group is collected.
    """
    v = array_to_vector(F.col(vec))
    out = items.groupBy(label).agg(F.count("*").alias("n"), Summarizer.mean(v).alias("_m")).where(F.col("n") >= min_size)
    return out.select(label, "n", vector_to_array("_m").alias("centroid"))


def representatives(items: DataFrame, k: int = 5, item: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """The ``k`` items closest to their own label's centroid: (label, item, similarity, rank)."""
    mid = centroids(items.where(F.col(label) >= 0), label, vec).select(label, "centroid")
    sims = items.where(F.col(label) >= 0).join(mid, label).select(
        label, item, F.round(cosine(F.col(vec), F.col("centroid"), 1e-9), TIE_DIGITS).alias("similarity")
    )
    return top_per_key(sims, [label], [F.desc("similarity"), F.col(item)], k)


def reduce_dimensions(items: DataFrame, k: int = 5, item: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(item, point): principal components of the unit vectors."""
    data = cut_lineage(items.select(item, unit(F.col(vec)).alias("_u"))).select(item, array_to_vector("_u").alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(data)
    return model.transform(data).select(item, vector_to_array("_p").alias("point"))


def label_table(items: DataFrame, item: str, project: str, topic: str) -> DataFrame:
    """(email_id, project_label, topic_label, project_id, topic_id)."""
    from tieline.functions.text import padded_id

    return items.select(
        F.col(item).cast("string").alias("email_id"),
        F.col(project).cast("int").alias("project_label"),
        F.col(topic).cast("int").alias("topic_label"),
        padded_id(F.col(project), "P").alias("project_id"),
        padded_id(F.col(topic), "T").alias("topic_id"),
    )


__all__: Sequence[str] = (
    "centroids", "cosine", "cosine_top_k", "density_clusters", "label_table", "nearest_centroid", "reduce_dimensions",
    "representatives", "truncated", "unit",
)
