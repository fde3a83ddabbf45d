"""Substring search by trigram postings instead of a scan.

Every run of three characters of the searched columns is a posting
``(trigrama, id)``. A row that contains a text contains all its trigrams, so the
ids found under every one of them are the only candidates; these are verified
by the plain substring test, which also sorts out trigrams of unlike columns.
Postings are ranged and sorted by trigram: a search reads the few row groups
whose statistics admit its trigrams, and a frequent trigram lies in many files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_shared
from .explore import search_condition, text_search

SIZE = 3
#: Rows whose postings one task makes: a product's text gives about 50, which the task's hash table holds.
ROWS_PER_TASK = 50_000


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters of the lower-cased text (none if it is shorter or NULL)."""
    t = F.lower(c.cast("string"))
    n = F.char_length(t)
    return F.when(
        n >= SIZE, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (SIZE - 1)), lambda i: F.substring(t, i, F.lit(SIZE))))
    ).otherwise(F.array().cast("array<string>"))


def needle_trigrams(q: str) -> list[str]:
    """Distinct trigrams of a search text as ``search_condition`` reads it (trimmed, lower-cased)."""
    needle = q.strip().lower()
    return sorted({needle[i : i + SIZE] for i in range(len(needle) - SIZE + 1)})


def postings(rows: DataFrame, id_col: str, cols: Sequence[str], parts: int | None = None) -> DataFrame:
    """``trigrama, id`` of all searched columns, each pair once.

    With ``parts``, the rows (a small file holds many) are dealt to so many tasks
    before they are taken apart.
    """
    if parts:
        rows = rows.select(id_col, *[c for c in cols if c != id_col]).repartition(parts)
    per_row = F.array_distinct(F.flatten(F.array(*[F.coalesce(trigrams(F.col(c)), F.array().cast("array<string>")) for c in cols])))
    # other names than the columns': an alias of theirs inside a lambda is not resolved
    made = rows.select(F.col(id_col).alias("__id"), F.explode(per_row).alias("__trigrama"))
    return made.select(F.col("__trigrama").alias("trigrama"), F.col("__id").alias("id")).distinct()


@dataclass(frozen=True)
class PostingIndex:
    """Rows with their postings; ``search`` equals ``explore.text_search``."""

    rows: DataFrame
    postings: DataFrame
    id_col: str
    cols: tuple[str, ...]

    def candidates(self, q: str) -> DataFrame | None:
        """Ids that have every trigram of the text; None for a text without one (too short)."""
        wanted = needle_trigrams(q)
        if not wanted:
            return None
        found = self.postings.where(F.col("trigrama").isin(wanted)).groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
        return found.where(F.col("_n") == len(wanted)).select(F.col("id").alias("_id"))

    def search(self, q: str) -> DataFrame:
        """Rows with the text in any searched column; texts of one or two characters scan, an empty one finds all rows.

        Rows that share an id, or have none, are candidates together and verified one by one.
        """
        ids = self.candidates(q)
        if ids is None:
            return text_search(self.rows, q, self.cols)
        kept = self.rows.join(ids, self.rows[self.id_col].eqNullSafe(ids["_id"]), "left_semi")
        return kept.where(search_condition(q, self.cols))


def build_index(rows: DataFrame, id_col: str, cols: Sequence[str]) -> PostingIndex:
    """Postings written once to the shared folder, ranged and sorted by trigram; the caller or a ``shared_scope`` removes them.

    ``rows`` is kept as it is: give a written table, as every search reads its candidates from there.
    The number of tasks, and of the ranges written, follows the rows.
    """
    parts = max(1, -(-rows.count() // ROWS_PER_TASK))
    made = postings(rows, id_col, cols, parts)
    ranged = made.repartitionByRange(parts, "trigrama", "id").sortWithinPartitions("trigrama", "id")
    return PostingIndex(rows, write_shared(ranged, "postings"), id_col, tuple(cols))
