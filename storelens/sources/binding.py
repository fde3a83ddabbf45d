"""Binding of the TPC-H-style test tables to the six tables of the model.

The test data has no retail schema, so each model column is an expression over
the test tables. Columns marked "stand-in" below are arithmetic with no
business meaning, chosen to be exact in decimal and to reach every branch of
the operators. The binding is lazy: every model table is a DataFrame plan over
the parquet files, so Catalyst prunes columns and pushes filters (the billed
status, dimension filters) down to the scans. Every order line is read; the
horizon (reference date, number of months) is taken from the orders themselves.
"""

from __future__ import annotations

import os
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import CHECKIN_OK, VISIT_CONVERTED, VISIT_EXTRA_ROUTE, VISIT_PLANNED, Horizon
from ..schemas import MONEY
from ..session import fit_shuffles

# Parameters of the binding: the billed status, and the two years that growth compares (the last whole ones).
BILLED = "F"
GROWTH_YEARS = (1999, 2000)
# Years of the yearly pivot.
PIVOT_YEARS = tuple(range(1995, 2002))


class RetailModel:
    """The six model tables plus the horizon.

    Each table is given either as a DataFrame or as a zero-argument builder;
    a builder runs on first access, so a query only plans the tables it reads.
    """

    TABLES = ("clients", "products", "sellers", "sales", "visits", "potential")

    def __init__(self, horizon: Horizon, **tables):
        unknown = set(tables) - set(self.TABLES)
        if unknown:
            raise TypeError(f"unknown model tables: {sorted(unknown)}")
        self.horizon = horizon
        self._given = tables
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._built:
            src = self._given[name]
            self._built[name] = src if isinstance(src, DataFrame) else src()
        return self._built[name]

    def replace(self, **tables) -> "RetailModel":
        """The same model with some tables swapped (e.g. a written billed fact as ``sales``)."""
        given = {n: self._built.get(n, self._given[n]) for n in self.TABLES}
        given.update(tables)
        return RetailModel(self.horizon, **given)

    clients = property(lambda self: self.table("clients"))
    products = property(lambda self: self.table("products"))
    sellers = property(lambda self: self.table("sellers"))
    sales = property(lambda self: self.table("sales"))
    visits = property(lambda self: self.table("visits"))
    potential = property(lambda self: self.table("potential"))


# Columns of the test tables that the binding reads, with their parquet types.
# Passing the schema skips footer-based schema inference on every read.
TEST_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


# Dimensions of fixed size, which no shuffle has to be fitted to.
FIXED_TABLES = ("nation", "region")


class TestTables:
    """Reads each test table at most once per binding (explicit schema, no inference).

    A table's rows are counted as it is first asked for (Parquet footers only),
    and the session's shuffles fitted to them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._cache = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._cache:
            path = os.path.join(self.sf_dir, f"{name}.parquet")
            schema = TEST_SCHEMAS.get(name)
            reader = self.spark.read.schema(schema) if schema else self.spark.read
            self._cache[name] = reader.parquet(path)
            if name not in FIXED_TABLES:
                fit_shuffles(self.spark, self._cache[name].count())
        return self._cache[name]


def _tables(spark: SparkSession, sf_dir: str, tables: TestTables | None) -> TestTables:
    return tables if tables is not None else TestTables(spark, sf_dir)


def _geo(t: TestTables) -> DataFrame:
    # nation (25 rows) and region (5 rows) are fixed-size dimensions.
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    region = t("region").select("r_regionkey", "r_name")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left").select(
        "n_nationkey", "n_name", "r_name"
    )


def data_horizon(t: "TestTables") -> Horizon:
    """The horizon of the data: reference date (last order) and distinct months, as scalar subqueries over the orders."""
    orders = t("orders").select("o_orderdate")
    return Horizon(
        billed_status=BILLED,
        reference_date=orders.agg(F.max("o_orderdate")).scalar(),
        years=GROWTH_YEARS,
        months=orders.agg(F.countDistinct(F.date_format("o_orderdate", "yyyy-MM")).cast("int")).scalar(),
    )


def bind_sales(spark: SparkSession, sf_dir: str, tables: TestTables | None = None) -> DataFrame:
    """All order lines of all statuses (``billed_sales`` filters them); a line without its order keeps NULL order columns."""
    t = _tables(spark, sf_dir, tables)
    li = t("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    gross = F.col("l_extendedprice").cast("decimal(18,2)")
    disc = gross * F.col("l_discount").cast("decimal(4,2)")
    cost = gross * (F.lit(0.70).cast("decimal(4,2)") + F.col("l_tax").cast("decimal(4,2)"))  # stand-in
    # every column is line- or order-level: the fact is one join (lines to their
    # orders), never a join to the SKU table that all queries would pay for
    lines = li.join(orders, li.l_orderkey == orders.o_orderkey, "left")
    return lines.select(
        F.col("l_orderkey").alias("pedido_id"),
        F.col("o_custkey").alias("cliente_id"),
        F.col("l_suppkey").alias("vendedor_id"),
        F.col("l_partkey").alias("sku_id"),
        F.col("o_orderdate").alias("data_pedido"),
        F.date_format("o_orderdate", "yyyy-MM").alias("mes_ref"),
        F.col("o_orderstatus").alias("status_pedido"),
        F.col("l_quantity").alias("quantidade"),
        (F.col("l_quantity") * F.col("l_linenumber")).alias("volume_kg"),  # stand-in
        gross.alias("receita_bruta"),
        disc.alias("desconto"),
        (gross - disc).alias("receita_liquida"),
        cost.alias("custo_total"),
        (gross - disc - cost).alias("margem_contribuicao"),  # stand-in
    )


def bind_clients(spark: SparkSession, sf_dir: str, tables: TestTables | None = None) -> DataFrame:
    t = _tables(spark, sf_dir, tables)
    cust = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    geo = _geo(t)
    bal = F.col("c_acctbal")
    return cust.join(F.broadcast(geo), cust.c_nationkey == geo.n_nationkey, "left").select(
        F.col("c_custkey").alias("cliente_id"),
        F.col("c_name").alias("nome_cliente_ficticio"),
        F.col("c_mktsegment").alias("canal"),
        F.when(bal < 3000, "P").when(bal <= 7000, "M").otherwise("G").alias("porte"),  # stand-in
        F.col("n_name").alias("cidade"),  # stand-in
        F.col("n_name").alias("uf"),
        F.col("r_name").alias("regiao_comercial"),
        (F.col("c_custkey") % 10).alias("vendedor_id"),  # stand-in
        F.when(bal >= 0, (1 + F.floor(bal / 1000)).cast("double")).alias("n_checkouts"),  # stand-in
        F.when(bal >= 0, (30 + F.floor(bal / 10)).cast("double")).alias("area_loja_m2"),  # stand-in
        F.lit(None).cast("string").alias("faixa_faturamento_pdv"),
        F.lit(None).cast("timestamp_ntz").alias("data_cadastro"),
        F.lit(None).cast("string").alias("status_cliente"),
    )


def bind_products(spark: SparkSession, sf_dir: str, tables: TestTables | None = None) -> DataFrame:
    t = _tables(spark, sf_dir, tables)
    part = t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return part.select(
        F.col("p_partkey").alias("sku_id"),
        F.col("p_name").alias("sku_nome"),
        F.col("p_type").alias("categoria"),
        F.col("p_size").cast("string").alias("subcategoria"),  # stand-in
        F.col("p_brand").alias("marca"),
        F.lit(None).cast("string").alias("formato"),
        F.lit(None).cast("string").alias("volume"),
        F.col("p_retailprice").cast(MONEY).alias("preco_lista"),
        F.lit(None).cast(MONEY).alias("custo_unitario"),
        F.lit(None).cast("string").alias("status_sku"),
        F.lit(None).cast("string").alias("substituto_sku_id"),
    )


def bind_sellers(spark: SparkSession, sf_dir: str, tables: TestTables | None = None) -> DataFrame:
    t = _tables(spark, sf_dir, tables)
    supp = t("supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    geo = _geo(t)
    k = F.col("s_suppkey")
    return supp.join(F.broadcast(geo), supp.s_nationkey == geo.n_nationkey, "left").select(
        k.alias("vendedor_id"),
        F.col("s_name").alias("nome_vendedor_ficticio"),
        F.col("r_name").alias("regiao_comercial"),
        F.lit(None).cast("timestamp_ntz").alias("data_admissao"),
        F.lit(5000).cast(MONEY).alias("custo_mensal_total"),  # stand-in
        (F.lit(100000) + F.lit(8) * F.col("s_acctbal").cast("decimal(18,2)")).cast(MONEY).alias(
            "meta_receita_mensal"
        ),  # stand-in
        ((F.lit(20) + k % 5).cast("double") / F.lit(100.0)).alias("meta_margem_pct"),  # stand-in
        (F.lit(40) + k % 20).cast("double").alias("capacidade_visitas_mes"),  # stand-in
    )


def bind_visits(spark: SparkSession, sf_dir: str, tables: TestTables | None = None) -> DataFrame:
    t = _tables(spark, sf_dir, tables)
    ev = t("events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("event_id").alias("visita_id"),
        F.col("user_id").alias("cliente_id"),
        (F.col("user_id") % 10).alias("vendedor_id"),  # stand-in
        F.col("ts").alias("data_visita"),
        F.when(k % 4 == 0, VISIT_EXTRA_ROUTE).otherwise(VISIT_PLANNED).alias("tipo_visita"),  # stand-in
        F.when(F.col("event_type").isin("purchase", "signup"), VISIT_CONVERTED)
        .otherwise("Sem pedido")
        .alias("resultado_visita"),  # stand-in
        F.col("value").alias("duracao_min"),  # stand-in
        F.when(k % 10 != 0, CHECKIN_OK).otherwise("Nao").alias("checkin_ok"),  # stand-in
    )


def bind_potential(spark: SparkSession, sf_dir: str, tables: TestTables | None = None) -> DataFrame:
    """One row per (nation, segment): 20 x the sum of positive balances (stand-in)."""
    t = _tables(spark, sf_dir, tables)
    cust = t("customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    nation = t("nation").select("n_nationkey", "n_name")
    pos = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))
    return (
        cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey, "left")
        .groupBy("n_name", "c_mktsegment")
        .agg((F.lit(20) * F.sum(pos)).alias("mercado_estimado_mensal"))
        .select(
            F.col("n_name").alias("cidade"),
            F.col("n_name").alias("uf"),
            F.col("c_mktsegment").alias("canal"),
            "mercado_estimado_mensal",
        )
    )


def bind_test_tables(spark: SparkSession, sf_dir: str) -> RetailModel:
    t = TestTables(spark, sf_dir)
    return RetailModel(
        data_horizon(t),
        clients=lambda: bind_clients(spark, sf_dir, t),
        products=lambda: bind_products(spark, sf_dir, t),
        sellers=lambda: bind_sellers(spark, sf_dir, t),
        sales=lambda: bind_sales(spark, sf_dir, t),
        visits=lambda: bind_visits(spark, sf_dir, t),
        potential=lambda: bind_potential(spark, sf_dir, t),
    )
