"""Filter cube: every selection looked up equals the filtered aggregate."""

import itertools

import pytest

from storelens.operators import cubes as Q
from storelens.operators import explore as E
from storelens.session import shared_scope

ROW = (
    "cliente_id long, canal string, uf string, regiao_comercial string, porte string, cluster_raw int, vendedor_id long, "
    "receita_liquida decimal(38,4), receita_bruta decimal(38,4), desconto_total decimal(38,4), margem_total decimal(38,4), "
    "total_pedidos long"
)


def clients(n=60):
    for i in range(n):
        yield (
            i, ["A", "B", None][i % 3], f"U{i % 4}", "NS"[i % 2], ["P", "M", "G", None][i % 4], [0, 1, 2, None][i // 7 % 4],
            None if i % 11 == 0 else i % 5, i * 10 - 50, i * 12, i, i * 3, i % 6,
        )


@pytest.fixture(scope="module")
def master(spark):
    from decimal import Decimal

    rows = [tuple(Decimal(v) if 7 <= j <= 10 else v for j, v in enumerate(r)) for r in clients()]
    return spark.createDataFrame(rows, ROW).cache()


@pytest.fixture(scope="module")
def cube(spark, master):
    with shared_scope(spark):
        yield Q.write_cube(master)


def kept(spec):
    """The clients of a selection, in plain Python."""
    names = dict(canal=1, uf=2, regiao=3, porte=4, cluster=5, vendedor=6)
    return [
        r for r in clients()
        if all(getattr(spec, f) in (None, E.ALL) or str(r[i]) == str(getattr(spec, f)) and r[i] is not None for f, i in names.items())
    ]


def test_every_selection_of_a_grid(spark, cube):
    """All sets of fixed dimensions: each of the 64 grouping sets is asked once, against plain Python."""
    values = dict(canal="A", uf="U1", regiao="S", porte="M", cluster=0, vendedor=1)
    specs = [
        E.FilterSpec(**{f: values[f] for f in fixed})
        for n in range(7)
        for fixed in itertools.combinations(values, n)
    ]
    from functools import reduce

    from pyspark.sql import functions as F

    rows = reduce(lambda a, b: a.unionByName(b), [cube.kpis(s).withColumn("i", F.lit(i)) for i, s in enumerate(specs)]).collect()
    assert len(rows) == len(specs) == 64
    for r in rows:
        want = kept(specs[r.i])
        rec, bruta = sum(x[7] for x in want), sum(x[8] for x in want)
        assert (r.receita_liquida, r.receita_bruta, r.clientes) == (rec, bruta, len(want))
        assert r.pedidos == sum(x[11] for x in want)
        assert r.ativos == sum(x[7] > 0 for x in want)
        assert r.taxa_ativacao == (100 * (r.ativos / r.clientes) if r.clientes else 0)


@pytest.mark.parametrize(
    "spec",
    [E.FilterSpec(), E.FilterSpec(canal="B"), E.FilterSpec(cluster=1), E.FilterSpec(cluster="2", vendedor="3"), E.FilterSpec(uf="none")],
)
def test_lookups_equal_the_filtered_master(master, cube, spec):
    assert cube.kpis(spec).collect() == E.kpis_filtered(master, spec).collect()
    assert cube.counts(spec).collect() == E.filter_counts(master, spec).collect()
    assert sorted(cube.cards(spec).collect()) == sorted(E.cluster_cards(master, spec).collect())


def test_facets_ignore_their_own_filter(cube):
    got = {r.porte: r.clientes for r in cube.facet("porte", E.FilterSpec(canal="A", porte="M")).collect()}
    want = kept(E.FilterSpec(canal="A"))
    assert got == {p: sum(r[4] == p for r in want) for p in "PMG" if any(r[4] == p for r in want)}


def test_a_lookup_reads_one_grouping_set(cube):
    plan = cube.lookup(E.FilterSpec(canal="A", porte="M"))._jdf.queryExecution().executedPlan().toString()
    n = Q.grouping_set(["canal", "porte"])
    assert f"PartitionFilters: [isnotnull(conjunto" in plan and f"= {n})" in plan


def test_empty_master(spark, master):
    none = master.limit(0)
    cube = Q.FilterCube(Q.filter_cube(none))
    assert cube.rows.count() == 0
    assert cube.kpis().collect() == E.kpis_filtered(none, E.FilterSpec()).collect()
    assert cube.counts(E.FilterSpec()).first() == (0, 0)
    assert cube.cards(E.FilterSpec(canal="A")).collect() == []


def test_unknown_dimension():
    with pytest.raises(ValueError):
        Q.grouping_set(["cidade"])
