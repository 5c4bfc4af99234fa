"""Operator 12: all periodic runs of words in a text, by uniting suffix classes from the longest common prefix down.

At level ``l`` a class holds the positions whose suffixes share ``l`` words.  Classes are united in the order of
decreasing common prefixes of neighbours in the suffix array (Kruskal's way, with union-find).  If two positions become
neighbours within a class at level ``l`` and lie ``d <= l`` apart, the words from the first on have the period ``d`` for
``l + d`` words and no further, and ``d`` is their smallest period: a smaller one would have put a position between them.
The start of every run is such a position, so runs are the seeds with the smallest start for each (end, period).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tieline.llm.common import doc_texts

RUNS = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
# A small class is put into a large one place by place; classes of like sizes are merged whole.
_PLACE_BY_PLACE = 16


def word_ids(words: list[bytes]) -> np.ndarray:
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _paired(first: np.ndarray, second: np.ndarray, gap: int) -> np.ndarray:
    """Dense ranks of (first[i], second[i + gap]), in their order; beyond the end comes before all."""
    n = len(first)
    key = first * (n + 1)
    if gap < n:
        key[: n - gap] += second[gap:] + 1
    return np.unique(key, return_inverse=True)[1]


def _suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and the common prefix of each suffix with the one before it, by doubling."""
    n = len(ids)
    levels = [np.unique(ids, return_inverse=True)[1]]
    while levels[-1].max() < n - 1:
        levels.append(_paired(levels[-1], levels[-1], 1 << (len(levels) - 1)))
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 2, -1, -1):
        # Ranks of one level are equal if and only if the next 2**k words are (the end of the text counts as a word).
        inside = np.flatnonzero((a < n) & (b < n))
        same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
        for part in (a, b, common):
            part[same] += 1 << k
    return order, common


def _joined(big: list[int], small: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """Both ordered sets in one, and the pairs of neighbours that come from different sets."""
    pairs = []
    if len(small) * _PLACE_BY_PLACE < len(big):
        at, last = 0, -1
        for x, following in zip(small, [*small[1:], None], strict=True):
            at = bisect_left(big, x, at)
            if at and big[at - 1] != last:
                pairs.append((big[at - 1], x))
            if at < len(big) and (following is None or big[at] < following):
                pairs.append((x, big[at]))
            big.insert(at, x)
            last = x
        return big, pairs
    inside = set(small)
    big += small
    big.sort()
    for x, y in zip(big, big[1:], strict=False):
        if (x in inside) != (y in inside):
            pairs.append((x, y))
    return big, pairs


def find_runs(ids: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and twice its period, by start and period.

    A run of ``least`` words has half as many in common with itself one period on, so classes below that level are never
    united, and a text without a repeated stretch of that length is done before its suffixes are sorted.
    """
    n, floor = len(ids), (least + 1) // 2
    if n < max(least, 2):
        return []
    stretch, width = np.unique(ids, return_inverse=True)[1], 1
    while width < floor:
        if stretch.max() == n - 1:
            return []
        gap = min(width, floor - width)
        stretch, width = _paired(stretch, stretch, gap), width + gap
    if stretch.max() == n - 1:
        return []
    order, common = _suffixes(ids)
    links = np.flatnonzero(common >= floor)
    links = links[np.argsort(-common[links], kind="stable")]
    root: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    starts: dict[tuple[int, int], int] = {}
    for level, x, y in zip(common[links].tolist(), order[links].tolist(), order[links + 1].tolist(), strict=True):
        x, y = find(x), find(y)
        mine, other = members.pop(x, None) or [x], members.pop(y, None) or [y]
        if len(mine) < len(other):
            x, y, mine, other = y, x, other, mine
        root[y] = x
        members[x], pairs = _joined(mine, other)
        for i, j in pairs:
            if j - i <= level and j - i + level >= least:
                run = (j + level, j - i)
                if starts.get(run, n) > i:
                    starts[run] = i
    return sorted((start, end - start, period) for (end, period), start in starts.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run repeats after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


def repetitions(docs: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs of each text and its words without the repeated periods.

    Words are stretches without ASCII white space, compared byte by byte over the whole text.  A run is a stretch
    of at least ``least`` words and twice its smallest period that no neighbour prolongs.  ``runs`` is in order of start and
    period, overlapping runs included; ``collapsed`` joins the words outside all repeats by one space.  Null and empty
    texts have no words, no runs and collapse to the empty text; repeated rows are alike; an empty table gives no rows;
    other columns are not read.  The work on a text of n words is O(n log² n), its memory O(n log n); rows do not meet.
    """

    def work(batches):
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column(1).to_pylist():
                words = text.split()
                found = find_runs(word_ids(words), least) if len(words) >= least else []
                if found:
                    keep = kept_words(len(words), found).tolist()
                    words_kept = [w for w, k in zip(words, keep, strict=True) if k]
                else:
                    words_kept = words
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(b" ".join(words_kept).decode())
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, _RUN), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "runs", "collapsed"])

    return doc_texts(docs, as_bytes=True).mapInArrow(work, RUNS)


def plant_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts, chosen by a check sum of the id, made periodic from a word on.

    With ``h = crc32(decimal doc_id)`` and ``g = h // 10``, a text of n > 0 words with ``h % 10 == 0`` keeps its words up to
    ``a = g % n`` and repeats the next ``p = 1 + (n - a) // (3 + g % 8)`` words to its end, joined by one space.  Other texts, and
    those without an id, stay as they are; null texts become empty.
    """

    def work(batches):
        for batch in batches:
            texts = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = zlib.crc32(str(doc_id).encode())
                if doc_id is not None and h % 10 == 0 and (words := text.split()):
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    text = b" ".join(words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a])
                texts.append(text.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return doc_texts(docs, as_bytes=True).mapInArrow(work, "doc_id bigint, text string")


def run_digests(found: DataFrame) -> DataFrame:
    """One row a text of :func:`repetitions`: how many runs, the longest one (ties: first start, then period) and digests."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", "n_words", "runs", "collapsed", longest.alias("top"))
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"), F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
