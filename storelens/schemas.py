"""Schemas of the six input tables of the commercial model.

Money columns are exact decimals; sums widen to ``decimal(38, 4)``.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, D, TS = T.StringType(), T.DoubleType(), T.TimestampNTZType()
MONEY = T.DecimalType(18, 2)
MONEY4 = T.DecimalType(18, 4)
SUM_MONEY = T.DecimalType(38, 4)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CLIENTS = _struct(
    ("cliente_id", T.LongType()),
    ("nome_cliente_ficticio", S),
    ("canal", S),
    ("porte", S),
    ("cidade", S),
    ("uf", S),
    ("regiao_comercial", S),
    ("vendedor_id", T.LongType()),
    ("n_checkouts", D),
    ("area_loja_m2", D),
    ("faixa_faturamento_pdv", S),
    ("data_cadastro", TS),
    ("status_cliente", S),
)

PRODUCTS = _struct(
    ("sku_id", T.LongType()),
    ("sku_nome", S),
    ("categoria", S),
    ("subcategoria", S),
    ("marca", S),
    ("formato", S),
    ("volume", S),
    ("preco_lista", MONEY),
    ("custo_unitario", MONEY),
    ("status_sku", S),
    ("substituto_sku_id", S),
)

SELLERS = _struct(
    ("vendedor_id", T.LongType()),
    ("nome_vendedor_ficticio", S),
    ("regiao_comercial", S),
    ("data_admissao", TS),
    ("custo_mensal_total", MONEY),
    ("meta_receita_mensal", MONEY),
    ("meta_margem_pct", D),
    ("capacidade_visitas_mes", D),
)

SALES = _struct(
    ("pedido_id", T.LongType()),
    ("cliente_id", T.LongType()),
    ("vendedor_id", T.LongType()),
    ("sku_id", T.LongType()),
    ("data_pedido", TS),
    ("mes_ref", S),
    ("status_pedido", S),
    ("quantidade", D),
    ("volume_kg", D),
    ("receita_bruta", MONEY),
    ("desconto", MONEY4),
    ("receita_liquida", MONEY4),
    ("custo_total", MONEY4),
    ("margem_contribuicao", MONEY4),
)

VISITS = _struct(
    ("visita_id", T.LongType()),
    ("cliente_id", T.LongType()),
    ("vendedor_id", T.LongType()),
    ("data_visita", TS),
    ("tipo_visita", S),
    ("resultado_visita", S),
    ("duracao_min", D),
    ("checkin_ok", S),
)

POTENTIAL = _struct(
    ("cidade", S),
    ("uf", S),
    ("canal", S),
    ("mercado_estimado_mensal", MONEY),
)

ALL = {
    "clients": CLIENTS,
    "products": PRODUCTS,
    "sellers": SELLERS,
    "sales": SALES,
    "visits": VISITS,
    "potential": POTENTIAL,
}
