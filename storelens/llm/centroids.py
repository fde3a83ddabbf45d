"""Centroid clustering (Lloyd rounds) in exact integers over subvector dictionaries.

Components become integers (SCALE times the value, floored). The vectors of a
task are encoded in pages of PAGE_ROWS: of each block of BLOCK dimensions a page
keeps the dictionary of its distinct subvectors, and per vector a code into it,
so nothing is lost. A round computes the squared distance of every distinct
subvector of a block to every centroid once, and adds up a vector's distances
from the partial ones of its codes. Likewise a cluster's sums come from how
often it uses each code.

Pages are written once, to the shared folder; rounds read them and give one row
per cluster and dimension and task, summed by Spark, so k times DIMENSIONS
numbers reach the driver in a round, and the k centroids go back with the task.
Dictionaries belong to pages as no bound holds for the distinct subvectors of
a whole table; no table is joined or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from storelens.session import cut_lineage

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
SCALE = 64
#: Dimensions of a block, and vectors of a page.
BLOCK = 2
PAGE_ROWS = 1 << 14
#: Integers of this size or more are no components: squared distances would not fit a long.
LARGEST = 1 << 27


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows with DIMENSIONS components that are finite numbers, as integers (in doubles, floored)."""
    v = vectors[vector_col].cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(x * SCALE))
    fits = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LARGEST / SCALE), F.lit(False)))
    return vectors.filter((F.size(v) == DIMENSIONS) & fits).select(vectors[id_col].alias("vec_id"), whole.alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The vectors with the k smallest hashes of their ids, in the order of these (k rows reach the driver)."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), DIMENSIONS)


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages: vector ids, per block the number of its distinct subvectors, these one after another, and the codes, block by block."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, PAGE_ROWS - rows)
            held.append(part)
            rows, batch = rows + part.num_rows, batch.slice(part.num_rows)
            if rows == PAGE_ROWS:
                yield _page(held)
                held, rows = [], 0
    if held:
        yield _page(held)


def _page(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    ids, vectors = table.column("vec_id").combine_chunks(), table.column("v").combine_chunks()
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)
    sizes, words, codes = [], [], []
    for at in range(0, DIMENSIONS, BLOCK):
        distinct, code = np.unique(matrix[:, at : at + BLOCK], axis=0, return_inverse=True)
        sizes.append(len(distinct))
        words.append(distinct.ravel())
        codes.append(code.ravel().astype("<u2").tobytes())
    lists = [
        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        pa.array([sizes], pa.list_(pa.int32())),
        pa.array([np.concatenate(words)], pa.list_(pa.int64())),
        pa.array([b"".join(codes)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(lists, ["ids", "sizes", "words", "codes"])


def dictionaries(page: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct subvectors, codes) of every block of a page."""
    n = len(page["ids"])
    codes = np.frombuffer(page["codes"], dtype="<u2").reshape(-1, n)
    words = page["words"].reshape(-1, BLOCK)
    ends = np.cumsum(page["sizes"])
    return [(words[e - s : e], codes[i]) for i, (s, e) in enumerate(zip(page["sizes"], ends, strict=True))]


def assign(blocks: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and squared distance of every vector of a page."""
    total = np.zeros((len(blocks[0][1]), len(centroids)), dtype=np.int64)
    for i, (words, codes) in enumerate(blocks):
        part = centroids[:, i * BLOCK : (i + 1) * BLOCK]
        partial = ((words[:, None, :] - part[None]) ** 2).sum(2)  # distinct subvectors x centroids
        total += partial[codes]
    nearest = total.argmin(1)
    return nearest, total[np.arange(len(total)), nearest]


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("ids")[i].values
            sizes, words = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("sizes", "words"))
            yield ids, dictionaries({"ids": ids, "sizes": sizes, "words": words, "codes": batch.column("codes")[i].as_py()})


def cluster_sums(pages: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every cluster around ``centroids``: number of vectors, sum of each component, sum of distances."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per cluster: components, then count, then distances; Python integers, which never overflow
        sums = [[0] * (DIMENSIONS + 2) for _ in range(k)]
        for _, blocks in _pages(batches):
            nearest, distance = assign(blocks, centroids)
            for i, (words, codes) in enumerate(blocks):
                used = np.bincount(nearest * len(words) + codes, minlength=k * len(words)).reshape(k, -1)
                for c, row in enumerate((used @ words).tolist()):
                    for d, x in enumerate(row):
                        sums[c][i * BLOCK + d] += x
            for c in range(k):
                mine = nearest == c
                sums[c][DIMENSIONS] += int(mine.sum())
                sums[c][DIMENSIONS + 1] += sum(distance[mine].tolist())
        some = [c for c in range(k) if sums[c][DIMENSIONS]]
        if some:
            cells = [(c, d, x) for c in some for d, x in enumerate(sums[c])]
            cluster, place, total = zip(*cells, strict=True)
            columns = [pa.array(cluster, pa.int32()), pa.array(place, pa.int32())]
            columns.append(pa.array([str(x) for x in total], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "place", "total"])

    out = [[0] * (DIMENSIONS + 2) for _ in range(k)]
    parts = pages.mapInArrow(run, "cluster int, place int, total string")
    for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("t")).collect():
        out[r["cluster"]][r["place"]] = int(r["t"])
    table = np.array(out, dtype=object).reshape(k, DIMENSIONS + 2)
    return table[:, DIMENSIONS], table[:, :DIMENSIONS], table[:, DIMENSIONS + 1]


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of DIMENSIONS components, none null, NaN, infinite or of
    LARGEST / SCALE and above in size. Every round assigns all vectors to the
    nearest centroid (ties: the smaller number) and replaces each centroid that
    has vectors by their componentwise floored mean; at the end they are assigned
    once more. Centroids start as the kept vectors with the smallest hashes of
    their ids (a null id counts as the empty text, repeated ids go by the vector's
    components); with fewer than ``k`` kept there are fewer clusters. Repeated
    rows give repeated results; without kept vectors there are no rows. Other
    columns are not read.
    """
    kept = kept_vectors(vectors, id_col, vector_col)
    id_type = vectors.schema[id_col].dataType.simpleString()
    pages = cut_lineage(
        kept.mapInArrow(encode, f"ids array<{id_type}>, sizes array<int>, words array<bigint>, codes binary")
    )
    centroids = first_centroids(kept, k)
    for _ in range(rounds if len(centroids) else 0):
        count, total, _ = cluster_sums(pages, centroids)
        moved = [[x // n for x in row] if n else c for n, row, c in zip(count, total, centroids.tolist(), strict=True)]
        centroids = np.array(moved, dtype=np.int64)
    inertia = [int(x) for x in cluster_sums(pages, centroids)[2]] if len(centroids) else []
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, blocks in _pages(batches):
            nearest, distance = assign(blocks, centroids)
            columns = [ids, pa.array(nearest, pa.int32()), pa.array(distance, pa.int64())]
            columns.append(pa.array([inertia[c] for c in nearest], pa.int64()))
            columns.append(pa.array([sum(inertia)] * len(nearest), pa.int64()))
            columns.append(pa.array([names[c] for c in nearest], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in out.fields])

    schema = f"vec_id {id_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    out = vectors.sparkSession.createDataFrame([], schema).schema
    return pages.mapInArrow(run, out)
