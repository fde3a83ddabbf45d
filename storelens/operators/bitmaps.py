"""Distinct counts that merge: exact bitmaps over dense ids.

A distinct count per month cannot be added up over months. A bitmap of the ids
seen can: ``distinct_state`` keeps, per cell of the finest grain (month, state)
and block of 32,768 ids, the bits of the orders and of the clients; any coarser
count is the OR of its cells' bitmaps, read from the state instead of the lines.

Ids are made dense first, numbered in the order of the first cell they occur
in. An order lies in one month, a client in one state, so a cell's ids are
neighbours and its bitmaps are full: about a bit per id and cell, not a block
per id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import ROWS_PER_RANGE, global_rank
from ..session import cut_lineage

CELL = ("mes_ref", "uf")
WHAT = {"pedidos": ("pedido_id", ("mes_ref", "uf")), "clientes": ("cliente_id", ("uf", "mes_ref"))}


def dense_ids(pairs: DataFrame, id_col: str, order: Sequence[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``id_col, _denso``: every id numbered from 1, by the first of its cells in ``order``, then by id."""
    first = pairs.groupBy(id_col).agg(F.min(F.struct(*order)).alias("_primeira"))
    return global_rank(first, ["_primeira", id_col], "_denso", rows_per_range, "long").select(id_col, "_denso")


def id_bitmaps(
    rows: DataFrame, id_col: str, cell: Sequence[str], order: Sequence[str] | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """``*cell, bloco, bits``: the ids of each cell as bitmaps of 32,768 dense ids. NULL ids count nowhere."""
    pairs = cut_lineage(rows.where(F.col(id_col).isNotNull()).select(*cell, id_col).distinct())
    numbered = pairs.join(dense_ids(pairs, id_col, order or cell, rows_per_range), id_col)
    return numbered.groupBy(*cell, F.expr("bitmap_bucket_number(_denso)").alias("bloco")).agg(
        F.bitmap_construct_agg(F.expr("bitmap_bit_position(_denso)")).alias("bits")
    )


def distinct_state(sales: DataFrame, clients: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``mes_ref, uf, medida, bloco, bits`` of orders and clients, per month and state of the client.

    The lines are reduced to (order, client, month) before the clients are
    joined. A NULL month or state (no such client) is a cell of its own, so
    totals over it count its orders.
    """
    keys = cut_lineage(sales.select("pedido_id", "cliente_id", "mes_ref").distinct())
    rows = keys.join(clients.select("cliente_id", "uf"), "cliente_id", "left")
    parts = [
        id_bitmaps(rows, id_col, CELL, order, rows_per_range).select(*CELL, F.lit(what).alias("medida"), "bloco", "bits")
        for what, (id_col, order) in WHAT.items()
    ]
    return parts[0].unionByName(parts[1])


def merge_bitmaps(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The state at a coarser grain (itself a state that merges on): the OR of the bitmaps of each block."""
    return state.groupBy(*by, "medida", "bloco").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_counts(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct orders and clients per ``by`` (all in one row if empty), from the merged bitmaps."""
    sizes = merge_bitmaps(state, by).withColumn("_n", F.expr("bitmap_count(bits)"))
    return sizes.groupBy(*by).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("medida") == what, F.col("_n"))), F.lit(0)).cast("long").alias(what)
            for what in WHAT
        ]
    )
