"""K-Means over all restarts in one scan per step, in exact decimals.

Standardised features are taken with four decimals and centres with two, as
integers, so every sum is exact: labels do not depend on how rows are
partitioned, and equal what SQL computes. All restarts go through one pass over
the vectors per step. A task adds up its vectors per restart and cluster, so
restarts x k x (features + 2) numbers are shuffled from it and reach the driver
as one table of that size, whatever the number of clients.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import exprs as X
from ..session import cut_lineage
from .segmentation import FEATURES

#: Decimals of the features, and what a centre's integers are multiples of (two decimals).
DIGITS = 4
CENTRE_STEP = 100
#: A restart whose centres moved by this much in a step, as a sum of squares, has come to rest (the reference's tolerance).
REST = 1e-4
#: Vectors measured against all centres at a time.
CHUNK = 4096
#: Hex digits by which the hash of a client is read further on from one restart to the next.
TURN = 3


@dataclass
class Segments:
    """The kept restart: its number, centres (k x features, in the unit of the features) and cost (sum of squared distances)."""

    restart: int
    centres: np.ndarray
    cost: float
    steps: int


def decimal_vectors(scaled: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """(cliente_id, v): the features in units of 10^-DIGITS."""
    whole = [(X.round_half_up(c, DIGITS).cast(f"decimal(18,{DIGITS})") * 10**DIGITS).cast("bigint") for c in cols]
    return scaled.select("cliente_id", F.array(*whole).alias("v"))


def start_key(client: str, seed: int, restart: int) -> str:
    digits = sha256(f"{seed}:{client}".encode()).hexdigest()
    at = TURN * restart % 64
    return digits[at:] + digits[:at]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def first_centres(vec: DataFrame, k: int, seed: int, restarts: int) -> list[np.ndarray]:
    """Per restart: the vectors of the k clients whose hashes, read from that restart's digit on, are smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[list] = [[] for _ in range(restarts)]
        for batch in batches:
            names, rows = batch.column("name").to_pylist(), batch.column("v").to_pylist()
            for r in range(restarts):
                mine = ((start_key(name, seed, r), v) for name, v in zip(names, rows, strict=True))
                least[r] = heapq.nsmallest(k, [*least[r], *heapq.nsmallest(k, mine)])
        cells = [(r, key, v) for r in range(restarts) for key, v in least[r]]
        if cells:
            r, key, v = zip(*cells, strict=True)
            columns = [pa.array(r, pa.int32()), pa.array(key, pa.string()), pa.array(v, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["r", "key", "v"])

    named = vec.select(F.coalesce(F.col("cliente_id").cast("string"), F.lit("")).alias("name"), "v")
    per_task = named.mapInArrow(run, "r int, key string, v array<bigint>")
    # at most k a task and restart; one array of k a restart
    best = per_task.groupBy("r").agg(F.slice(F.sort_array(F.collect_list(F.struct("key", "v"))), 1, k).alias("c"))
    found = {row["r"]: np.array([c["v"] for c in row["c"]], dtype=np.int64) for row in best.collect()}
    return [found[r] for r in sorted(found)]


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre (ties: the smaller number) and squared distance of every row."""
    away = np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)
    mine = away.argmin(1)
    return mine, away[np.arange(len(x)), mine]


def cluster_sums(vec: DataFrame, centres: dict[int, np.ndarray], dims: int) -> dict[int, np.ndarray]:
    """Per restart: k rows of sums, count and cost around its centres, from one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {r: [[0] * (dims + 2) for _ in c] for r, c in centres.items()}  # Python integers never overflow
        seen = False
        for batch in batches:
            x_all = _matrix(batch)
            for at in range(0, len(x_all), CHUNK):
                x = x_all[at : at + CHUNK]
                seen = True
                for r, cs in centres.items():
                    mine, away = nearest(x, cs)
                    for c in range(len(cs)):
                        own = mine == c
                        row = [*x[own].sum(0).tolist(), int(own.sum()), sum(away[own].tolist())]
                        sums[r][c] = [a + b for a, b in zip(sums[r][c], row, strict=True)]
        if seen:
            cells = [(r, c, d, str(s)) for r, rows in sums.items() for c, row in enumerate(rows) for d, s in enumerate(row)]
            r, c, d, s = zip(*cells, strict=True)
            columns = [pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(s, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["r", "c", "d", "s"])

    out = {r: [[0] * (dims + 2) for _ in c] for r, c in centres.items()}
    per_task = vec.mapInArrow(run, "r int, c int, d int, s string")
    for row in per_task.groupBy("r", "c", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[row["r"]][row["c"]][row["d"]] = int(row["s"])
    return {r: np.array(rows, dtype=object) for r, rows in out.items()}


def moved(centres: np.ndarray, sums: np.ndarray, dims: int) -> np.ndarray:
    """Means with two decimals, half up; a cluster without clients keeps its centre."""
    step = CENTRE_STEP
    new = [
        [(2 * s + step * row[dims]) // (2 * step * row[dims]) * step for s in row[:dims]] if row[dims] else c
        for c, row in zip(centres.tolist(), sums.tolist(), strict=True)
    ]
    return np.array(new, dtype=np.int64)


def lloyd_segments(
    scaled: DataFrame,
    k: int = P.N_CLUSTERS,
    seed: int = P.KMEANS_SEED,
    restarts: int = P.KMEANS_RESTARTS,
    cols: Sequence[str] = FEATURES,
    max_steps: int = 100,
    cluster_col: str = "cluster_raw",
) -> tuple[DataFrame, Segments]:
    """(cliente_id, cluster) of the restart with the least cost (ties: the first), and that restart.

    Each restart starts at k clients picked by a hash and moves its centres to
    the means of their clients until they move by REST at most, at most ``max_steps`` times;
    restarts that have come to rest take no more part in a step. Clusters are
    numbered by the hash order of the clients they started at. With fewer than
    k clients there are fewer clusters, without any no rows.
    """
    dims = len(cols)
    vec = cut_lineage(decimal_vectors(scaled, cols))
    id_type = vec.schema["cliente_id"].dataType.simpleString()
    schema = f"cliente_id {id_type}, {cluster_col} int"
    centres = dict(enumerate(first_centres(vec, k, seed, restarts)))
    if not centres:
        return vec.select("cliente_id", F.lit(0).alias(cluster_col)), Segments(0, np.zeros((0, dims)), 0.0, 0)
    moving, steps = dict(centres), 0
    while moving and steps < max_steps:
        sums = cluster_sums(vec, moving, dims)
        new = {r: moved(c, sums[r], dims) for r, c in moving.items()}
        centres |= new
        moving = {r: c for r, c in new.items() if int(((c - moving[r]) ** 2).sum()) > REST * 10 ** (2 * DIGITS)}
        steps += 1
    costs = {r: sum(s[:, dims + 1].tolist()) for r, s in cluster_sums(vec, centres, dims).items()}
    best = min(costs, key=lambda r: (costs[r], r))
    kept = centres[best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                labels = pa.array(nearest(_matrix(batch), kept)[0], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("cliente_id"), labels], ["cliente_id", cluster_col])

    unit = 10.0**DIGITS
    return vec.mapInArrow(run, schema), Segments(best, kept / unit, costs[best] / unit**2, steps)
