"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each builds the model tables from the test tables (``bind_test_tables``) and
runs one operator over the whole tables. Parameters (filters, search text,
page, scenario levers) are fixed values chosen to reach every branch. The
cluster operators run on a fixed labelling (store-size tier) so that they
get a full value check independent of K-Means; the K-Means / PCA path itself
is checked by invariants in ``tests/``.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..functions import exprs as X
from ..operators import bitmaps as B
from ..operators import clustering as L
from ..operators import cubes as Q
from ..operators import curves as C
from ..operators import explore as E
from ..operators import masters as M
from ..operators import postings as PI
from ..operators import ranking as K
from ..operators import rollup_state as RS
from ..operators import rollups as R
from ..operators import scenario as S
from ..operators import segmentation as G
from ..session import cut_lineage, shared_path
from ..sources import sinks
from ..sources.binding import PIVOT_YEARS, RetailModel, bind_test_tables
from ..sources.tables import coerce_numeric, load_checked, load_table
from .output import as_output

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed query parameters (chosen to hit every branch on the test data).
FILTER_MAIN = E.FilterSpec(canal="HOUSEHOLD", porte="M", cluster=2)
FILTER_KPI = E.FilterSpec(regiao="AMERICA", porte="G")
FILTER_CARDS = E.FilterSpec(canal="MACHINERY")
FILTER_PAGE = E.FilterSpec(canal="BUILDING")
FILTER_FLAG = E.FilterSpec(regiao="ASIA")
SELECTIONS = (
    E.FilterSpec(),
    E.FilterSpec(canal="HOUSEHOLD"),
    E.FilterSpec(regiao="AMERICA", porte="G"),
    E.FilterSpec(cluster=2, vendedor=7),
    E.FilterSpec(canal="BUILDING", regiao="ASIA", porte="M", cluster=3),
    E.FilterSpec(canal="MACHINERY", uf="NATION_12", regiao="EUROPE", porte="P", cluster=1, vendedor=3),
    E.FilterSpec(canal="NONE SUCH"),
)
SEARCH_CLIENTS = " 12 "
SEARCH_FLAG = "nation_1"
SEARCHES = ("blue", " RING", "ar", "99", "7", "small", "no such product")
SEARCH_PRODUCTS = "blue"
SEARCH_FIRST_N = "ring"
MIX_CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
PAGE, PAGE_KEY = 2, "rec_liq"
DEEP_RANGE_ROWS = 100_000
FIXED_K = 5
SCENARIO_GRID = {
    "corte_desconto_pp": (0.0, 0.5, 1.0),
    "reativacao_pct": (0.0, 15.0, 30.0),
    "cross_sell_pct": (0.0, 12.0),
    "ganho_conversao_pct": (0.0, 5.0),
}


def register(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: as_output(fn(spark, sf_dir))
        return fn

    return deco


def round6(df: DataFrame, cols) -> DataFrame:
    """Six-decimal rounding of means/ratios of doubles (their sums are order dependent)."""
    return df.withColumns({c: X.round_half_up(c, 6) for c in cols})


def model(spark: SparkSession, sf_dir: str) -> RetailModel:
    return bind_test_tables(spark, sf_dir)


def billed(m: RetailModel) -> DataFrame:
    return R.billed_sales(m.sales, m.horizon.billed_status)


def master(m: RetailModel) -> DataFrame:
    return M.client_master(m.clients, m.sales, m.products, m.visits, m.potential, m.horizon)


def fixed_labels(df: DataFrame) -> DataFrame:
    """A fixed labelling by store-size tier (number of checkouts; unknown size = tier 0).

    Stands in for the K-Means labels wherever a cluster operator needs a full
    value check; computed from client attributes only, so it labels both the
    client table and the client master.
    """
    chk = F.col("n_checkouts")
    tier = F.when(chk.isNull(), 0).when(chk <= 3, 1).when(chk <= 5, 2).when(chk <= 7, 3).otherwise(4)
    return df.withColumn("cluster_raw", tier.cast("int"))


def labelled_master(m: RetailModel) -> DataFrame:
    # the master feeds the profile, the roles and the labels: write it once to
    # the shared checkpoint folder instead of recomputing it for each
    lm = cut_lineage(fixed_labels(master(m)))
    roles = G.segment_roles(G.cluster_profile(lm))
    return G.segment_labels(lm, roles)


def client_rec(m: RetailModel) -> DataFrame:
    return M.client_record(labelled_master(m), m.horizon.years)


def sku_abc(m: RetailModel) -> DataFrame:
    return K.abc_curve(M.sku_master(m.products, m.sales, m.horizon))


def seller_m(m: RetailModel) -> DataFrame:
    return M.seller_master(m.sellers, m.sales, m.visits, m.horizon)


# 2.1 sources and sinks -------------------------------------------------------

PART_SCHEMA = T.StructType(
    [
        T.StructField("p_partkey", T.LongType()),
        T.StructField("p_name", T.StringType()),
        T.StructField("p_size", T.LongType()),
        T.StructField("p_retailprice", T.DecimalType(18, 2)),
    ]
)


@register("load_table")
def q_load_table(spark, sf_dir):
    return load_table(spark, os.path.join(sf_dir, "part.parquet"), PART_SCHEMA)


@register("coerce_numeric")
def q_coerce_numeric(spark, sf_dir):
    cust = spark.read.parquet(os.path.join(sf_dir, "customer.parquet")).select(
        "c_custkey", F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_mktsegment"
    )
    return coerce_numeric(cust, ["c_acctbal", "c_mktsegment"])


CHECKED_SCHEMA = T.StructType(
    [
        T.StructField("c_custkey", T.ByteType()),
        T.StructField("c_name", T.LongType()),
        T.StructField("c_mktsegment", T.DoubleType()),
        T.StructField("c_nationkey", T.StringType()),
        T.StructField("c_segment_code", T.LongType()),
    ]
)


@register("load_rejects")
def q_load_rejects(spark, sf_dir):
    """Rejects per column of the customers read to a schema that does not fit them."""
    return load_checked(spark, os.path.join(sf_dir, "customer.parquet"), CHECKED_SCHEMA).counts()


@register("sink_published")
def q_sink_published(spark, sf_dir):
    """Two sections published together and read back through the manifest."""
    m = model(spark, sf_dir)
    base = shared_path(spark, "published")
    manifest = sinks.publish_sections(
        {
            "temporal": as_output(R.monthly_trend(billed(m))),
            "perfis_vendedores": as_output(E.count_by(seller_m(m), "perfil_vendedor")),
        },
        base,
    )
    months = sinks.read_section(spark, base, "temporal", manifest).select(
        F.lit("temporal").alias("secao"), F.col("mes_ref").alias("chave"), F.col("pedidos").alias("n")
    )
    profiles = sinks.read_section(spark, base, "perfis_vendedores", manifest)
    return months.unionByName(profiles.select(F.lit("perfis_vendedores").alias("secao"), F.col("perfil_vendedor").alias("chave"), "n"))


@register("sink_json")
def q_sink_json(spark, sf_dir):
    m = model(spark, sf_dir)
    path = sinks.write_json(as_output(R.monthly_trend(billed(m))), shared_path(spark, "monthly_trend"))
    return spark.read.json(path)


@register("sink_csv")
def q_sink_csv(spark, sf_dir):
    m = model(spark, sf_dir)
    rec = E.search_clients(client_rec(m), "", FILTER_PAGE)
    path = sinks.write_clients_csv(rec, shared_path(spark, "clients_csv"))
    return spark.read.option("header", True).option("escape", '"').csv(path)


# 2.2 filters, predicates, projections ---------------------------------------


@register("billed_sales")
def q_billed_sales(spark, sf_dir):
    return billed(model(spark, sf_dir))


@register("dimension_filter")
def q_dimension_filter(spark, sf_dir):
    m = model(spark, sf_dir)
    return E.dimension_filter(fixed_labels(m.clients), FILTER_MAIN).select(
        "cliente_id", "canal", "uf", "regiao_comercial", "porte", "cluster_raw", "vendedor_id"
    )


@register("search_clients")
def q_search_clients(spark, sf_dir):
    m = model(spark, sf_dir)
    return E.search_clients(client_rec(m), SEARCH_CLIENTS).select("id", "nome", "cidade", "uf", "vendedor_id", "rec_liq")


@register("search_products")
def q_search_products(spark, sf_dir):
    m = model(spark, sf_dir)
    prods = m.products.select("sku_id", F.col("sku_nome").alias("nome"), "categoria")
    return E.search_products(prods, SEARCH_PRODUCTS)


@register("search_postings")
def q_search_postings(spark, sf_dir):
    """Several product searches answered from one set of trigram postings."""
    m = model(spark, sf_dir)
    prods = cut_lineage(m.products.select("sku_id", F.col("sku_nome").alias("nome"), "categoria"))
    index = PI.build_index(prods, "sku_id", E.PRODUCT_SEARCH_COLS)
    return reduce(DataFrame.unionByName, [index.search(s).withColumn("busca", F.lit(s)) for s in SEARCHES])


@register("search_flag")
def q_search_flag(spark, sf_dir):
    m = model(spark, sf_dir)
    return E.search_flag(client_rec(m), SEARCH_FLAG, FILTER_FLAG)


@register("distinct_values")
def q_distinct_values(spark, sf_dir):
    m = model(spark, sf_dir)
    out = E.distinct_values(m.clients, "canal")
    out = out.unionByName(E.distinct_values(m.clients, "uf"))
    out = out.unionByName(E.distinct_values(m.clients, "regiao_comercial"))
    return out.unionByName(E.distinct_values(m.sellers, "vendedor_id", order_by="nome_vendedor_ficticio", label="vendedor"))


@register("client_record")
def q_client_record(spark, sf_dir):
    return client_rec(model(spark, sf_dir))


@register("seller_record")
def q_seller_record(spark, sf_dir):
    return M.seller_record(seller_m(model(spark, sf_dir)))


@register("sku_record")
def q_sku_record(spark, sf_dir):
    return M.sku_record(sku_abc(model(spark, sf_dir)))


# 2.3 joins -------------------------------------------------------------------


@register("sales_with_product")
def q_sales_with_product(spark, sf_dir):
    m = model(spark, sf_dir)
    return R.sales_with_product(billed(m), m.products)


@register("client_master")
def q_client_master(spark, sf_dir):
    return master(model(spark, sf_dir))


@register("client_potential")
def q_client_potential(spark, sf_dir):
    m = model(spark, sf_dir)
    return M.client_potential(m.clients, m.potential).select(
        "cliente_id", "cidade", "canal", "potencial_mercado_cidade_canal_mensal"
    )


@register("seller_master")
def q_seller_master(spark, sf_dir):
    return seller_m(model(spark, sf_dir))


@register("sku_master")
def q_sku_master(spark, sf_dir):
    m = model(spark, sf_dir)
    return M.sku_master(m.products, m.sales, m.horizon)


@register("sales_with_client_geo")
def q_sales_with_client_geo(spark, sf_dir):
    m = model(spark, sf_dir)
    return R.sales_with_client_geo(billed(m), m.clients)


@register("client_360")
def q_client_360(spark, sf_dir):
    """The 360 view, flattened to scalars for the value check (nested form is unit-tested)."""
    m = model(spark, sf_dir)
    # five sections read the billed fact: join the lines to their orders once
    b = cut_lineage(billed(m))
    mb = m.replace(sales=b)
    # top SKUs, category mix and sparkline share one (client, SKU, month) pre-aggregate
    hist = cut_lineage(R.client_sku_month(b))
    full = E.client_360(
        client_rec(mb),
        K.client_category_mix(m.clients, R.sales_with_product(hist, m.products), m.products),
        K.client_top_skus(hist),
        m.products,
        M.seller_record(seller_m(mb)),
        K.client_sparkline(m.clients, hist),
    )
    return full.select(
        "cliente_id",
        "nome",
        "cluster_code",
        "rec_liq",
        "categorias_compradas",
        *[F.get("top_skus", i)["nome"].alias(f"top{i + 1}_nome") for i in range(3)],
        *[F.get("top_skus", i)["receita_liquida"].alias(f"top{i + 1}_receita") for i in range(3)],
        F.coalesce(F.size("top_skus"), F.lit(0)).alias("n_top"),
        "vendedor_nome",
        "vendedor_ating_rec_pct",
        *[F.element_at("sparkline", i + 1).alias(f"sparkline_{i + 1}") for i in range(P.SPARKLINE_MONTHS)],
        *[F.col("mix")[F.lit(c)].alias(f"mix_{c.lower()}") for c in MIX_CATEGORIES],
    )


# 2.4 aggregations ------------------------------------------------------------


@register("client_sales")
def q_client_sales(spark, sf_dir):
    return R.client_sales(billed(model(spark, sf_dir)))


@register("client_categories")
def q_client_categories(spark, sf_dir):
    m = model(spark, sf_dir)
    return R.client_categories(R.sales_with_product(billed(m), m.products))


@register("client_visits")
def q_client_visits(spark, sf_dir):
    return R.client_visits(model(spark, sf_dir).visits)


@register("client_year_pivot")
def q_client_year_pivot(spark, sf_dir):
    m = model(spark, sf_dir)
    return R.client_year_pivot(billed(m), PIVOT_YEARS)


@register("potential_city_channel")
def q_potential_city_channel(spark, sf_dir):
    return R.potential_by(model(spark, sf_dir).potential, ["cidade", "canal"])


@register("potential_state")
def q_potential_state(spark, sf_dir):
    m = model(spark, sf_dir)
    return R.potential_by(m.potential, ["uf"], months=m.horizon.months)


@register("cluster_profile")
def q_cluster_profile(spark, sf_dir):
    prof = G.cluster_profile(fixed_labels(master(model(spark, sf_dir))))
    return round6(prof, ["margem_pct_med", "desconto_pct_med", "conversao_visitas_med", "checkouts_med", "area_med"])


@register("cluster_summary")
def q_cluster_summary(spark, sf_dir):
    return G.cluster_summary(labelled_master(model(spark, sf_dir)))


@register("cluster_distributions")
def q_cluster_distributions(spark, sf_dir):
    return G.cluster_distributions(fixed_labels(model(spark, sf_dir).clients))


@register("seller_sales")
def q_seller_sales(spark, sf_dir):
    return R.seller_sales(billed(model(spark, sf_dir)))


@register("seller_visits")
def q_seller_visits(spark, sf_dir):
    return R.seller_visits(model(spark, sf_dir).visits)


@register("sku_sales")
def q_sku_sales(spark, sf_dir):
    return R.sku_sales(billed(model(spark, sf_dir)))


@register("monthly_trend")
def q_monthly_trend(spark, sf_dir):
    return R.monthly_trend(billed(model(spark, sf_dir)))


@register("visit_duration_curve")
def q_visit_duration_curve(spark, sf_dir):
    return C.visit_duration_curve(model(spark, sf_dir).visits)


@register("visit_conversion_pivot")
def q_visit_conversion_pivot(spark, sf_dir):
    return C.visit_conversion_pivot(C.visit_duration_curve(model(spark, sf_dir).visits))


@register("discount_margin_curve")
def q_discount_margin_curve(spark, sf_dir):
    return C.discount_margin_curve(billed(model(spark, sf_dir)))


@register("geo_performance")
def q_geo_performance(spark, sf_dir):
    m = model(spark, sf_dir)
    return C.geo_performance(billed(m), m.clients, m.potential, m.horizon.months)


@register("category_cooccurrence")
def q_category_cooccurrence(spark, sf_dir):
    m = model(spark, sf_dir)
    return C.category_cooccurrence(R.sales_with_product(billed(m), m.products), m.products)


@register("kpis_global")
def q_kpis_global(spark, sf_dir):
    m = model(spark, sf_dir)
    return R.kpis_global(billed(m), m.clients, m.visits)


@register("kpis_filtered")
def q_kpis_filtered(spark, sf_dir):
    return E.kpis_filtered(fixed_labels(master(model(spark, sf_dir))), FILTER_KPI)


@register("filter_cube")
def q_filter_cube(spark, sf_dir):
    """All 64 grouping sets of the six filter dimensions (values as text; NULL where summed over)."""
    cube = Q.filter_cube(fixed_labels(master(model(spark, sf_dir))))
    return cube.withColumns({d: F.col(d).cast("string") for d in Q.DIMENSIONS})


@register("cube_selections")
def q_cube_selections(spark, sf_dir):
    """The KPI row of several selections, looked up in the written cube."""
    cube = Q.write_cube(fixed_labels(master(model(spark, sf_dir))))
    rows = [cube.kpis(spec).withColumn("selecao", F.lit(i)) for i, spec in enumerate(SELECTIONS)]
    return reduce(DataFrame.unionByName, rows)


@register("distinct_from_bitmaps")
def q_distinct_from_bitmaps(spark, sf_dir):
    """Distinct orders and clients per month, per state and in all, merged from the bitmaps of (month, state)."""
    m = model(spark, sf_dir)
    state = cut_lineage(B.distinct_state(billed(m), m.clients))
    levels = [("mes_ref", ["mes_ref"]), ("uf", ["uf"]), ("total", [])]
    return reduce(
        DataFrame.unionByName,
        [
            B.distinct_counts(state, by).select(
                F.lit(level).alias("nivel"), (F.col(by[0]) if by else F.lit("total")).alias("chave"), *B.WHAT
            )
            for level, by in levels
        ],
    )


@register("client_sales_state")
def q_client_sales_state(spark, sf_dir):
    """``client_sales`` from a state built without the last month and then updated by it."""
    m = model(spark, sf_dir)
    sales = billed(m)
    path = shared_path(spark, "client_state")
    last = m.sales.agg(F.max("mes_ref")).first()[0]
    schema = RS.write_state(sales.where(F.coalesce(F.col("mes_ref") != last, F.lit(True))), path)
    RS.update_months(sales, [last], path)
    return RS.client_sales_from_state(RS.read_state(spark, path, schema))


@register("cluster_cards")
def q_cluster_cards(spark, sf_dir):
    return E.cluster_cards(fixed_labels(master(model(spark, sf_dir))), FILTER_CARDS)


@register("channel_cluster_crosstab")
def q_channel_cluster_crosstab(spark, sf_dir):
    return E.crosstab_counts(fixed_labels(model(spark, sf_dir).clients), "canal", "cluster_raw", range(FIXED_K), "cluster_")


@register("seller_profile_counts")
def q_seller_profile_counts(spark, sf_dir):
    return E.count_by(seller_m(model(spark, sf_dir)), "perfil_vendedor")


@register("abc_class_counts")
def q_abc_class_counts(spark, sf_dir):
    return E.count_by(sku_abc(model(spark, sf_dir)), "curva_abc", P.ABC_LABELS)


@register("category_revenue")
def q_category_revenue(spark, sf_dir):
    m = model(spark, sf_dir)
    return E.category_revenue(M.sku_master(m.products, m.sales, m.horizon))


# 2.5 windows, ranking, limits ------------------------------------------------


@register("abc_curve")
def q_abc_curve(spark, sf_dir):
    return sku_abc(model(spark, sf_dir)).select("sku_id", "receita_total", "receita_cum", "receita_cum_pct", "curva_abc")


@register("client_top_skus")
def q_client_top_skus(spark, sf_dir):
    return K.client_top_skus(billed(model(spark, sf_dir)))


@register("recent_months")
def q_recent_months(spark, sf_dir):
    return K.recent_months(billed(model(spark, sf_dir)))


@register("client_sparkline")
def q_client_sparkline(spark, sf_dir):
    m = model(spark, sf_dir)
    return K.client_sparkline(m.clients, billed(m))


@register("client_category_mix")
def q_client_category_mix(spark, sf_dir):
    m = model(spark, sf_dir)
    return K.client_category_mix(m.clients, R.sales_with_product(billed(m), m.products), m.products)


@register("sorted_page")
def q_sorted_page(spark, sf_dir):
    m = model(spark, sf_dir)
    rec = E.search_clients(client_rec(m), "", FILTER_PAGE)
    return K.sorted_page(rec.select("id", "nome", "canal", "uf", "rec_liq", "margem_pct", "pedidos"), PAGE_KEY, False, PAGE)


@register("deep_pages")
def q_deep_pages(spark, sf_dir):
    """First, middle and last page of the whole client record, read through the page directory."""
    rec = client_rec(model(spark, sf_dir)).select("id", "nome", "canal", "uf", "rec_liq", "margem_pct", "pedidos")
    pages = K.page_directory(rec, PAGE_KEY, False, rows_per_range=DEEP_RANGE_ROWS)
    asked = sorted({1, (pages.pages + 1) // 2, pages.pages})
    return reduce(DataFrame.unionByName, [pages.page(p).withColumn("pagina", F.lit(p).cast("long")) for p in asked])


@register("first_n_products")
def q_first_n_products(spark, sf_dir):
    m = model(spark, sf_dir)
    rec = E.search_products(M.sku_record(sku_abc(m)), SEARCH_FIRST_N)
    return K.first_n(rec, P.PRODUCT_LIST_CAP, [F.desc("rec_total"), F.asc("sku_id")]).select(
        "sku_id", "nome", "categoria", "rec_total", "curva_abc"
    )


@register("cluster_ranking")
def q_cluster_ranking(spark, sf_dir):
    return K.cluster_ranking(G.cluster_profile(fixed_labels(master(model(spark, sf_dir)))))


# 2.7 scalar expressions --------------------------------------------------------


@register("safe_ratio")
def q_safe_ratio(spark, sf_dir):
    return master(model(spark, sf_dir)).select("cliente_id", "margem_pct", "desconto_pct", "ticket_medio")


@register("recency_days")
def q_recency_days(spark, sf_dir):
    return master(model(spark, sf_dir)).select("cliente_id", "ultima_compra", "recencia_dias")


@register("yoy_growth")
def q_yoy_growth(spark, sf_dir):
    m = model(spark, sf_dir)
    y0, y1 = R.year_column(m.horizon.years)
    return master(m).select("cliente_id", y0, y1, "crescimento_yoy")


@register("seller_attainment")
def q_seller_attainment(spark, sf_dir):
    return seller_m(model(spark, sf_dir)).select(
        "vendedor_id",
        "meta_receita_periodo",
        "atingimento_receita_pct",
        "margem_realizada_pct",
        "atingimento_margem_pct",
        "visitas_mes_realizadas",
        "aproveitamento_capacidade_visitas",
    )


@register("seller_quadrant")
def q_seller_quadrant(spark, sf_dir):
    return seller_m(model(spark, sf_dir)).select("vendedor_id", "perfil_vendedor")


@register("band")
def q_band(spark, sf_dir):
    v = model(spark, sf_dir).visits
    return v.select("visita_id", "duracao_min", X.band("duracao_min", P.DURATION_EDGES, P.DURATION_LABELS).alias("duracao_faixa"))


@register("discount_rate")
def q_discount_rate(spark, sf_dir):
    b = billed(model(spark, sf_dir))
    rate = X.discount_rate()
    return b.select(
        "pedido_id",
        "sku_id",
        "vendedor_id",
        rate.alias("taxa_desconto"),
        X.band(rate, P.DISCOUNT_EDGES, P.DISCOUNT_LABELS).alias("faixa_desconto"),
    )


@register("fill_defaults")
def q_fill_defaults(spark, sf_dir):
    m = model(spark, sf_dir)
    j = m.clients.join(R.client_sales(billed(m)), "cliente_id", "left")
    j = j.withColumn("recencia_dias", X.recency_days("ultima_compra", m.horizon.reference_date))
    out = M.fill_defaults(
        j, {"receita_liquida": 0, "total_pedidos": 0, "skus_unicos": 0, "n_checkouts": 1.0, "area_loja_m2": 30.0}
    )
    return out.select("cliente_id", "receita_liquida", "total_pedidos", "skus_unicos", "recencia_dias", "n_checkouts", "area_loja_m2")


@register("month_year_parts")
def q_month_year_parts(spark, sf_dir):
    b = billed(model(spark, sf_dir))
    return b.select("pedido_id", F.year("data_pedido").alias("ano"), "mes_ref").distinct()


@register("radar_scores")
def q_radar_scores(spark, sf_dir):
    return G.radar_scores(G.cluster_summary(labelled_master(model(spark, sf_dir))))


@register("recommended_action")
def q_recommended_action(spark, sf_dir):
    return G.recommended_action(client_rec(model(spark, sf_dir)))


@register("margin_status")
def q_margin_status(spark, sf_dir):
    rec = client_rec(model(spark, sf_dir))
    return rec.select("id", "margem_pct", X.status_band("margem_pct").alias("status_margem"))


@register("seller_light")
def q_seller_light(spark, sf_dir):
    rec = M.seller_record(seller_m(model(spark, sf_dir)))
    return rec.select("id", "ating_rec_pct", "margem_pct", "meta_margem_pct", X.seller_light("ating_rec_pct", "margem_pct", "meta_margem_pct").alias("cor"))


# 2.8 segmentation ------------------------------------------------------------


@register("client_features")
def q_client_features(spark, sf_dir):
    return round6(G.client_features(master(model(spark, sf_dir))), G.FEATURES)


@register("standardize")
def q_standardize(spark, sf_dir):
    return round6(G.standardize(G.client_features(master(model(spark, sf_dir)))), G.FEATURES)


def scaled_features(m: RetailModel) -> DataFrame:
    # standardize checkpoints the features it reads twice; fitting and
    # transforming then re-read that checkpoint, not the master
    return G.standardize(G.client_features(master(m)))


@register("kmeans_segments")
def q_kmeans_segments(spark, sf_dir):
    scaled = scaled_features(model(spark, sf_dir))
    labelled, _ = L.lloyd_segments(scaled)
    return labelled


@register("segmented_client_record")
def q_segmented_client_record(spark, sf_dir):
    """The whole segmentation chain: K-Means labels, PCA coordinates, roles, labels, published record with x and y."""
    m = model(spark, sf_dir)
    whole = cut_lineage(master(m))
    scaled = G.standardize(G.client_features(whole))
    labels, _ = L.lloyd_segments(scaled)
    lm = cut_lineage(whole.join(labels, "cliente_id", "left").join(G.pca_2d(scaled), "cliente_id", "left"))
    roles = G.segment_roles(G.cluster_profile(lm))
    return M.client_record(G.segment_labels(lm, roles), m.horizon.years)


@register("pca_2d")
def q_pca_2d(spark, sf_dir):
    return G.pca_2d(scaled_features(model(spark, sf_dir)))


@register("segment_roles")
def q_segment_roles(spark, sf_dir):
    return G.segment_roles(G.cluster_profile(fixed_labels(master(model(spark, sf_dir)))))


@register("segment_labels")
def q_segment_labels(spark, sf_dir):
    return labelled_master(model(spark, sf_dir)).select("cliente_id", "cluster_raw", "cluster_code", "cluster_nome", "cluster_tag")


# 2.9 scenario sweep ----------------------------------------------------------


def scenario_grid(spark: SparkSession) -> DataFrame:
    """The lever grid as a DataFrame (a generate over literal arrays, no driver data)."""
    df = spark.range(1)
    for lever, values in SCENARIO_GRID.items():
        df = df.withColumn(lever, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return df.drop("id")


@register("scenario_sweep")
def q_scenario_sweep(spark, sf_dir):
    m = model(spark, sf_dir)
    lm = labelled_master(m).withColumn("is_high_potential", F.col("cluster_code") == P.SEG_HIGH_POTENTIAL.code)
    base = S.scenario_base(lm)
    out = S.scenario_sweep(scenario_grid(spark), base)
    return round6(
        out.select(
            *SCENARIO_GRID.keys(),
            "receita_incremental",
            "margem_incremental",
            "receita_incremental_pct",
            "nova_margem_pct",
            "delta_margem_pp",
        ),
        ["receita_incremental", "margem_incremental", "receita_incremental_pct", "nova_margem_pct", "delta_margem_pp"],
    )
