"""Near-duplicate classes by ProbMinHash signatures, banding and verification.

1. Every distinct text is a node. Its weighted five-word shingles give a
   ProbMinHash signature (see ``shingles``) of REGISTERS registers, cut into
   bands of BAND_ROWS; equal bands put nodes into one bucket. A text with
   repeated shingles has the bands of a second signature as well, with all
   weights 1 (of other texts the two are the same), so that both similarities
   have buckets of their own. A pair with either similarity at 0.8 shares no
   bucket with probability below 1e-4, and the more alike two texts are the less
   likely that gets.
2. In every bucket all nodes are compared with its centre, the node that meets
   most others over all its buckets.
   Nodes within 0.8 of it are linked, and links are closed to components.
3. What can still hide a link are pairs in buckets with two components. The nodes
   of such buckets are set beside a pivot: the shingles that most of VOTERS nodes
   hold, here of all buckets whose centres are in one component. Order every node's shingles by
   whether the pivot lacks them, then by hash. Two similar nodes share one among the
   first fifth of both (by number, or by weight where shingles repeat): either one
   that the pivot lacks, then both are in the smaller bucket of that shingle, or
   none, then both have nearly all their shingles in the pivot, which bounds their
   sizes, and they are compared at once. Smaller buckets with two components go the
   same way, with a pivot of their own, so that their parts miss half of its voters;
   those of up to SMALL nodes are compared within, across components.

These filters are exact: no pair that shares a bucket goes unseen, and edited
copies that are not within 0.8 of each other, each with shingles of its own, share
no smaller bucket and are never compared, however many have one origin. So a
group of thousands of near copies costs comparisons with a few pivots, not its
square. Copies of one text are one node from the start, combined map-side. Bucket
sizes, centres and labels are grouped aggregates; skewed joins are left to AQE.
Signatures, buckets, packed sets and labels are tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from storelens.llm import shingles
from storelens.llm.common import by_content, checkpointed, text_or_empty, written
from storelens.session import shared_scope

SIMILAR = 0.8
REGISTERS = 280
BAND_ROWS = 7
#: Unresolved buckets up to this size are compared within (a node meets at most this many others).
SMALL = 16
#: Nodes of a group, at most, whose majority is its pivot.
VOTERS = 16
#: Width of a class of set sizes, as a logarithm.
SIZE_STEP = 0.02
#: Rows handled together in numpy.
CHUNK = 64


def _keyed(docs: DataFrame, text_col: str, *more) -> DataFrame:
    t = text_or_empty(text_col)
    return docs.select(F.xxhash64(t).alias("k1"), F.xxhash64(F.lit("text"), t).alias("k2"), *more, t.alias("text"))


def band_keys(sets: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Distinct band keys of every set: those of its weights, and where a shingle is repeated those of weights 1."""
    none = np.zeros(1, dtype=np.uint64)  # texts without words share a bucket
    some = [i for i, s in enumerate(sets) if len(s[0])]
    repeated = [i for i in some if sets[i][1].max() > 1]
    signed = [sets[i] for i in some] + [(sets[i][0], np.ones_like(sets[i][1])) for i in repeated]
    out = [none] * len(sets)
    if signed:
        keys = shingles.bands(shingles.signatures(signed, REGISTERS), BAND_ROWS)
        for i, k in zip(some, keys, strict=False):
            out[i] = k
        for i, k in zip(repeated, keys[len(some) :], strict=True):
            out[i] = np.union1d(out[i], k)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            rows = batch.slice(at, CHUNK)
            sets = [shingles.shingles(t.as_py()) for t in rows.column("text")]
            banded = pa.array([x.view(np.int64) for x in band_keys(sets)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("k1"), rows.column("k2"), banded], ["k1", "k2", "bands"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            rows = batch.slice(at, CHUNK)
            packed = [shingles.pack(*shingles.shingles(t.as_py())) for t in rows.column("text")]
            yield pa.RecordBatch.from_arrays([rows.column("nid"), pa.array(packed, pa.binary())], ["nid", "packed"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sims = [
            shingles.similarities(a.as_py(), b.as_py())
            for a, b in zip(batch.column("packed_a"), batch.column("packed_b"), strict=True)
        ]
        columns = [pa.array([s[i] for s in sims], pa.float64()) for i in range(2)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns], ["a", "b", "plain", "prob"])


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Node pairs (a, b) with plain, the Jaccard similarity of their shingle sets, and prob, the probability Jaccard similarity."""
    one = pairs.join(sets.select(F.col("nid").alias("b"), F.col("packed").alias("packed_b")), "b")
    two = one.join(sets.select(F.col("nid").alias("a"), F.col("packed").alias("packed_a")), "a")
    return two.select("a", "b", "packed_a", "packed_b").mapInArrow(_compare, "a bigint, b bigint, plain double, prob double")


def _majorities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [shingles.majority(p.as_py()) for p in batch.column("packs")]
        yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(made, pa.binary())], ["g", "pivot"])


def pivots(voters: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, pivot): what most voters of a group hold. Voters (g, nid, p): of each of VOTERS hash classes, the one with most p."""
    chosen = voters.groupBy("g", F.pmod(F.xxhash64("nid"), F.lit(VOTERS)).alias("class")).agg(F.max(F.struct("p", "nid")).alias("t"))
    packs = chosen.select("g", F.col("t.nid").alias("nid")).join(sets, "nid").groupBy("g").agg(F.collect_list("packed").alias("packs"))
    return packs.mapInArrow(_majorities, "g bigint, pivot binary")


def beside(groups: DataFrame, pivot: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """``groups`` (g, nid, label, g_label) with what ``shingles.beside_pivot`` says of a node beside its group's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.int64()))
        for batch in batches:
            both = zip(batch.column("pivot"), batch.column("packed"), strict=True)
            out = [shingles.beside_pivot(c.as_py(), x.as_py(), 1 - similar) for c, x in both]
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            names = ["g", "nid", "label", "g_label", "n", "a", "mass", "repeats", "prefix"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), *columns], names)

    schema = "g bigint, nid bigint, label bigint, g_label bigint, n bigint, a bigint, mass double, repeats boolean, prefix array<bigint>"
    joined = groups.join(sets, "nid").join(pivot, "g").select("g", "nid", "label", "g_label", "pivot", "packed")
    return joined.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (u, v): the components, by contraction.

    Each step maps every node to the least of itself and its neighbours and
    replaces the edges' ends by that; ids are in no order related to the
    edges, so the number of steps grows with the logarithm of the longest path.
    """
    labels = None
    edges = written(edges.filter("u != v").distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")))
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("label"))
        else:
            to = parent.select(F.col("u").alias("label"), "p")
            labels = written(
                labels.join(to, "label", "left").select("node", F.coalesce("p", "label").alias("label"))
            )
        edges = written(
            edges.join(parent, "u")
            .select(F.col("p").alias("pu"), F.col("v").alias("u"))
            .join(parent, "u")
            .select(F.least("pu", "p").alias("u"), F.greatest("pu", "p").alias("v"))
            .filter("u != v")
            .distinct()
        )
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, p, label) with the components of linked pairs (a, b) made one."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("u")), "a").join(
        labels.select(F.col("node").alias("b"), F.col("label").alias("v")), "b"
    )
    merged = components(ends.select("u", "v"))
    to = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return written(labels.join(to, "label", "left").select("node", "p", F.coalesce("to", "label").alias("label")))


def unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` (b, nid) of the buckets that hold two components, with label and p."""
    known = written(members.join(labels.withColumnRenamed("node", "nid"), "nid").select("b", "nid", "p", "label"))
    two = known.groupBy("b").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    return written(known.join(two.select("b"), "b"))


def pairs_without_additions(rows: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b) of a group that can be similar although they share no shingle outside of their pivot.

    ``rows``: what ``beside`` gives. Two sets of n and m
    shingles, x and y of them in the pivot, have at most min(x, y) in common, so neither may be below
    similar / (1 + similar) of n + m. Given x that bounds m, and partners are found by classes of sizes.
    With repeated shingles, both need the share ``similar`` of their weight in the pivot instead.
    At least one of a pair is in another component than g_label.
    """
    ratio = (1 + similar) / similar
    size_class = lambda c: F.floor(F.log(F.greatest(c, F.lit(1))) / SIZE_STEP)
    fit = rows.withColumn("most", F.floor(F.col("a") * ratio - F.col("n") + 1e-6)).withColumn("least", F.ceil(F.col("n") * similar - 1e-6))
    able = fit.filter("most >= least")
    outside = F.col("label") != F.col("g_label")
    e = able.filter(outside).select(
        "g", F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most")))).alias("class"),
        F.col("nid").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("most").alias("mx"),
    )
    t = able.select(
        "g", size_class(F.col("n")).alias("class"), F.col("nid").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"),
        F.col("most").alias("my"),
    )
    plain = e.join(t, ["g", "class"]).filter("lx != ly and ny <= mx and nx <= my").select("x", "y")
    heavy = rows.filter(F.col("mass") >= similar - 1e-9)
    u = heavy.filter(outside).select("g", F.col("nid").alias("x"), F.col("label").alias("lx"), F.col("repeats").alias("rx"))
    v = heavy.select("g", F.col("nid").alias("y"), F.col("label").alias("ly"), F.col("repeats").alias("ry"))
    prob = u.filter("rx").join(v, "g").unionByName(u.filter("not rx").join(v.filter("ry"), "g")).filter("lx != ly").select("x", "y")
    return plain.unionByName(prob).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def link_nodes(members: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(node, label) components of the similar pairs within the buckets of ``members`` (b, nid)."""
    met_in = members.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    labels = written(
        members.join(met_in, "b").groupBy(F.col("nid").alias("node")).agg(F.sum("n").alias("p")).withColumn("label", F.col("node"))
    )
    alike = F.greatest("plain", "prob") >= similar
    # the node that meets most others is most likely the one that its near copies were made from
    known = members.join(labels.withColumnRenamed("node", "nid"), "nid")
    centre = known.groupBy("b").agg(F.max(F.struct("p", "nid")).alias("t")).select("b", F.col("t.nid").alias("c"))
    pairs = members.join(centre, "b").filter("nid != c").select(F.least("c", "nid").alias("a"), F.greatest("c", "nid").alias("b"))
    labels = relabelled(labels, written(verify(pairs.distinct(), sets), per_core=8).filter(alike))
    active, first = unresolved(members, labels), True
    while not active.isEmpty():
        top = active.groupBy("b").agg(F.max(F.struct("p", "nid", "label")).alias("t"), F.count(F.lit(1)).alias("size"))
        placed = written(active.join(top.select("b", F.col("t.label").alias("g_label"), "size"), "b"))
        if first:  # one group for all buckets whose centres are in one component
            groups = placed.select(F.col("g_label").alias("g"), "nid", "label", "g_label", "p").distinct()
        else:
            groups = placed.filter(F.col("size") > SMALL).select(F.col("b").alias("g"), "nid", "label", "g_label", "p")
        rows = written(beside(groups, pivots(groups, sets), sets, similar), per_core=8)
        pairs = pairs_without_additions(rows, similar)
        if not first:
            left = placed.filter(F.col("size") <= SMALL).select("b", F.col("nid").alias("a"), F.col("label").alias("la"))
            right = left.select("b", F.col("a").alias("nid"), F.col("la").alias("lb"))
            inner = left.join(right, "b").filter("a < nid and la != lb").select("a", F.col("nid").alias("b"))
            pairs = pairs.unionByName(inner).distinct()
        labels = relabelled(labels, written(verify(pairs, sets), per_core=8).filter(alike))
        if first:
            token = rows.groupBy("nid").agg(F.array_distinct(F.flatten(F.collect_list("prefix"))).alias("prefix"))
            members = token.select(F.explode("prefix").alias("b"), "nid")
        else:
            members = rows.select("g", "nid", F.explode("prefix").alias("t")).select(F.xxhash64("g", "t").alias("b"), "nid")
        active, first = unresolved(members, labels), False
    return labels.select("node", "label")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept, and the text's key (k1, k2).

    A class is a component of pairs with similarity of at least ``similar``:
    the larger of plain and probability Jaccard of the five-word shingles (A-Z
    lower-cased; a repeated shingle weighs 1 + ln of its count; a text of fewer
    words is one shingle). class_id is the least id in the class, and that row
    is kept. Texts without words, null among them, form one class. Null ids
    come after all others. Of rows repeated with one id and text one is kept.
    An empty table gives no rows. Other columns are not read.
    """
    with shared_scope(docs.sparkSession):  # all written tables go once the classes are checkpointed
        return _near_classes(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("__text")), similar)


def _near_classes(bare: DataFrame, similar: float) -> DataFrame:
    rows = written(_keyed(bare, "__text", "doc_id").drop("text").withColumn("rid", F.monotonically_increasing_id()))
    signed = _keyed(bare, "__text").mapInArrow(_sign, "k1 bigint, k2 bigint, bands array<bigint>")
    nodes = written(
        signed.groupBy("k1", "k2").agg(F.first("bands").alias("bands")).withColumn("nid", F.monotonically_increasing_id()),
        per_core=8,
    )
    keys = nodes.select("nid", F.explode("bands").alias("b"))
    shared = keys.groupBy("b").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi")).filter("lo < hi").select("b")
    members = written(keys.join(shared, "b").select("b", "nid"), per_core=8)
    named = members.select("nid").distinct().join(nodes.select("nid", "k1", "k2"), "nid")
    texts = _keyed(bare, "__text").join(named, ["k1", "k2"]).groupBy("nid").agg(F.first("text").alias("text"))
    sets = written(texts.mapInArrow(_pack, "nid bigint, packed binary"), per_core=8)
    labels = link_nodes(members, sets, similar)
    labelled = nodes.select("nid", "k1", "k2").join(labels.withColumnRenamed("node", "nid"), "nid", "left")
    placed = checkpointed(
        rows.join(labelled.select("k1", "k2", F.coalesce("label", "nid").alias("label")), ["k1", "k2"])
    )
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    # checkpointed, so that the join below is between two exchanges and a large class's rows can be split
    classes = checkpointed(
        placed.groupBy("label").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("class_size"))
    )
    return placed.join(classes, "label").select(
        "doc_id", F.col("keep.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("keep.rid")).alias("kept"),
        "k1", "k2",
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every class, all columns as they were.

    Rows are found again by id and text; of rows with the same id and text the one with the least hash of all columns
    stays. Nulls, texts of any length and empty tables are handled as ``near_classes`` says.
    """
    kept = near_classes(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("__id"), "k1", "k2")
    t = text_or_empty(text_col)
    mine = docs.withColumn("__k1", F.xxhash64(t)).withColumn("__k2", F.xxhash64(F.lit("text"), t))
    once = Window.partitionBy(F.col(id_col), "__k1", "__k2").orderBy(by_content(docs))
    same = mine[id_col].eqNullSafe(kept["__id"]) & (mine["__k1"] == kept["k1"]) & (mine["__k2"] == kept["k2"])
    return (
        mine.join(kept, same, "left_semi").withColumn("__nth", F.row_number().over(once)).filter("__nth = 1")
        .drop("__k1", "__k2", "__nth")
    )
