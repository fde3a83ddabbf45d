"""Fixed values of the commercial-analytics model.

Everything in this module is a *fixed value*: a constant, label or text that
must equal the dashboard model's own values for results to line up (band
edges and labels, class cut-offs, segment codes and texts, quadrant names,
scenario constants; two segment texts and one action text leave out a brand name). They are stated here once, in their natural order, and
every operator takes them as overridable parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

# ---------------------------------------------------------------------------
# Fixed values (must equal the model's constants)
# ---------------------------------------------------------------------------

BILLED_STATUS = "Faturado"
REFERENCE_DATE = "2025-12-31"
NEVER_BOUGHT_RECENCY = 999
HORIZON_MONTHS = 24
YEARS = (2024, 2025)

VISIT_PLANNED = "Planejada"
VISIT_EXTRA_ROUTE = "Extra-rota"
VISIT_TYPES = (VISIT_PLANNED, VISIT_EXTRA_ROUTE)
VISIT_CONVERTED = "Pedido"
CHECKIN_OK = "Sim"

DURATION_EDGES = (0, 15, 30, 45, 60, 90, 180)
DURATION_LABELS = ("0-15 min", "16-30 min", "31-45 min", "46-60 min", "61-90 min", "90+ min")

DISCOUNT_EDGES = (-0.01, 0.0, 0.03, 0.06, 0.10, 0.15, 0.25, 1.0)
DISCOUNT_LABELS = (
    "0% (Sem desconto)",
    "0.1% a 3%",
    "3.1% a 6%",
    "6.1% a 10%",
    "10.1% a 15%",
    "15.1% a 25%",
    "> 25%",
)

ABC_CUTS = (0.70, 0.90)
ABC_LABELS = ("A (Top 70%)", "B (Próximos 20%)", "C (Cauda Longa 10%)")

N_CLUSTERS = 5
KMEANS_SEED = 42
KMEANS_RESTARTS = 20
PCA_DIMS = 2

QUADRANT_STAR = "Alta Performance (Estrela)"
QUADRANT_VOLUME = "Volume com Baixa Margem"
QUADRANT_PROFITABLE = "Rentável com Baixo Volume"
QUADRANT_CRITICAL = "Abaixo da Meta (Crítico)"

SPARKLINE_MONTHS = 6
TOP_SKUS = 3
PAGE_SIZE = 15
PRODUCT_LIST_CAP = 50
INACTIVE_RECENCY = 900

MARGIN_GOOD = 25.0
MARGIN_WARN = 20.0

RADAR_CAPS = (1200.0, 35.0, 300.0, 30.0, 25.0, 6.0)  # ticket, orders, recency, margin %, SKUs, checkouts

SCENARIO_CHURN_TICKET = 4800.0
SCENARIO_CHURN_MARGIN = 0.25
SCENARIO_CROSS_SELL_MARGIN = 0.255
SCENARIO_ROUTE_SHARE = 0.04
SCENARIO_ROUTE_MARGIN = 0.25


@dataclass(frozen=True)
class Segment:
    code: str
    name: str
    tag: str
    description: str


# Segment roles in priority order of assignment: key accounts (highest mean
# revenue), churn risk (highest mean recency), high potential (most
# checkouts), discount hunters (highest mean discount), the rest stable.
SEG_KEY_ACCOUNTS = Segment(
    "C1_KEY_ACCOUNTS",
    "Key Accounts / Campeões",
    "Diamante",
    "Grandes clientes com alto faturamento, alta frequência e ampla cesta de produtos. "
    "Geradores chave de margem.",
)
SEG_HIGH_POTENTIAL = Segment(
    "C2_HIGH_POTENTIAL",
    "Alto Potencial Inexplorado",
    "Oportunidade",
    "PDVs com estrutura física relevante (checkouts/área) e alto mercado local, mas subpenetrados "
    "no portfólio. Meta principal de cross-sell.",
)
SEG_CHURN_RISK = Segment(
    "C3_CHURN_RISK",
    "Em Risco / Churn",
    "Risco Alto",
    "Clientes com longa inatividade ou acentuada queda de pedidos em 2025. "
    "Necessitam de plano urgente de reativação.",
)
SEG_DISCOUNT_HUNTERS = Segment(
    "C4_DISCOUNT_HUNTERS",
    "Sensíveis a Preço / Margem Apertada",
    "Atenção Margem",
    "Clientes com alta dependência de descontos promocionais, operando em margens abaixo da média corporativa.",
)
SEG_RETAIL_STABLE = Segment(
    "C5_RETAIL_STABLE",
    "Pequeno Varejo / Frequentes Estáveis",
    "Base Recorrente",
    "Varejo tradicional de vizinhança. Compras regulares de itens essenciais (Cloro/Detergente), "
    "com margem saudável e alta fidelidade.",
)
SEGMENTS = (SEG_KEY_ACCOUNTS, SEG_HIGH_POTENTIAL, SEG_CHURN_RISK, SEG_DISCOUNT_HUNTERS, SEG_RETAIL_STABLE)

# Recommended-action texts per segment code; {…} slots are filled with the
# client's own metrics (money and percentages with two decimals).
ACTION_TEXTS = {
    "C1_KEY_ACCOUNTS": (
        "PDV de alto volume faturado (R$ {rec_liq}) com compra regular de {skus} SKUs. "
        "Ação: Blindagem comercial e visitação quinzenal obrigatória."
    ),
    "C2_HIGH_POTENTIAL": (
        "PDV com infraestrutura relevante ({checkouts} checkouts, {area_m2}m²), mas com baixa positivação "
        "de categorias. Ação prioritária: Introduzir combo de categorias secundárias."
    ),
    "C3_CHURN_RISK": (
        "PDV sem compras nos últimos {recencia_dias} dias (Status: {status}). Ação: Campanha de reativação "
        "com visita presencial e condição promocional de reentrada."
    ),
    "C4_DISCOUNT_HUNTERS": (
        "PDV com alta sensibilidade a preço (Desconto médio: {desconto_pct}%, Margem: {margem_pct}%). "
        "Ação: Estipular teto de desconto e condicionar ofertas a mix completo."
    ),
    "C5_RETAIL_STABLE": (
        "PDV de pequeno porte com recompra estável e rentabilidade saudável ({margem_pct}% de margem). "
        "Ação: Manter rotina de atendimento via telefone/visita periódica."
    ),
}


@dataclass(frozen=True)
class Horizon:
    """Analysis window of the model: billed status, reference date, years, months.

    Reference date and months are values, or columns computed from the data
    (scalar subqueries).
    """

    billed_status: str = BILLED_STATUS
    reference_date: str | Column = REFERENCE_DATE
    years: tuple[int, int] = YEARS
    months: int | Column = HORIZON_MONTHS
