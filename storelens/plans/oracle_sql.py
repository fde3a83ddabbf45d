"""Independent DuckDB SQL for each registered query.

Written by hand from the operator definitions (not generated from the Spark
plans). ``BINDING`` maps the test tables onto the six model tables exactly as
described in FIXTURES.md §3; each query is ``BINDING`` + its own CTEs/SELECT.
Money is summed in DECIMAL and converted to DOUBLE at the end; ratios divide
doubles; timestamps are rendered as text.
"""

from __future__ import annotations

# distinct months of the orders
MONTHS = "(SELECT CAST(count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS INTEGER) FROM orders)"

BINDING = """
WITH
sales_raw AS (
  SELECT l.l_orderkey, o.o_custkey, l.l_suppkey, l.l_partkey, o.o_orderdate, o.o_orderstatus,
         l.l_quantity, l.l_linenumber,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS g,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS d,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) * (CAST(0.70 AS DECIMAL(4,2)) + CAST(l.l_tax AS DECIMAL(4,2))) AS c
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
),
sales AS (
  SELECT l_orderkey AS pedido_id, o_custkey AS cliente_id, l_suppkey AS vendedor_id, l_partkey AS sku_id,
         o_orderdate AS data_pedido, strftime(o_orderdate, '%Y-%m') AS mes_ref, o_orderstatus AS status_pedido,
         l_quantity AS quantidade, l_quantity * l_linenumber AS volume_kg,
         g AS receita_bruta, d AS desconto, g - d AS receita_liquida, c AS custo_total, g - d - c AS margem_contribuicao
  FROM sales_raw
),
billed AS (SELECT * FROM sales WHERE status_pedido = 'F'),
geo AS (
  SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
clients AS (
  SELECT c.c_custkey AS cliente_id, c.c_name AS nome_cliente_ficticio, c.c_mktsegment AS canal,
         CASE WHEN c.c_acctbal < 3000 THEN 'P' WHEN c.c_acctbal <= 7000 THEN 'M' ELSE 'G' END AS porte,
         g.n_name AS cidade, g.n_name AS uf, g.r_name AS regiao_comercial,
         c.c_custkey % 10 AS vendedor_id,
         CASE WHEN c.c_acctbal >= 0 THEN CAST(1 + floor(c.c_acctbal / 1000) AS DOUBLE) END AS n_checkouts,
         CASE WHEN c.c_acctbal >= 0 THEN CAST(30 + floor(c.c_acctbal / 10) AS DOUBLE) END AS area_loja_m2,
         CAST(NULL AS VARCHAR) AS faixa_faturamento_pdv, CAST(NULL AS TIMESTAMP) AS data_cadastro,
         CAST(NULL AS VARCHAR) AS status_cliente
  FROM customer c LEFT JOIN geo g ON c.c_nationkey = g.n_nationkey
),
products AS (
  SELECT p_partkey AS sku_id, p_name AS sku_nome, p_type AS categoria, CAST(p_size AS VARCHAR) AS subcategoria,
         p_brand AS marca, CAST(NULL AS VARCHAR) AS formato, CAST(NULL AS VARCHAR) AS volume,
         CAST(p_retailprice AS DECIMAL(18,2)) AS preco_lista, CAST(NULL AS DECIMAL(18,2)) AS custo_unitario,
         CAST(NULL AS VARCHAR) AS status_sku, CAST(NULL AS VARCHAR) AS substituto_sku_id
  FROM part
),
sellers AS (
  SELECT s.s_suppkey AS vendedor_id, s.s_name AS nome_vendedor_ficticio, g.r_name AS regiao_comercial,
         CAST(NULL AS TIMESTAMP) AS data_admissao, CAST(5000 AS DECIMAL(18,2)) AS custo_mensal_total,
         CAST(100000 + 8 * CAST(s.s_acctbal AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS meta_receita_mensal,
         CAST(20 + s.s_suppkey % 5 AS DOUBLE) / 100.0::DOUBLE AS meta_margem_pct,
         CAST(40 + s.s_suppkey % 20 AS DOUBLE) AS capacidade_visitas_mes
  FROM supplier s LEFT JOIN geo g ON s.s_nationkey = g.n_nationkey
),
visits AS (
  SELECT event_id AS visita_id, user_id AS cliente_id, user_id % 10 AS vendedor_id, ts AS data_visita,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 = 0 THEN 'Extra-rota' ELSE 'Planejada' END AS tipo_visita,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'Pedido' ELSE 'Sem pedido' END AS resultado_visita,
         value AS duracao_min,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 <> 0 THEN 'Sim' ELSE 'Nao' END AS checkin_ok
  FROM events
),
potential AS (
  SELECT n.n_name AS cidade, n.n_name AS uf, c.c_mktsegment AS canal,
         20 * sum(CASE WHEN c.c_acctbal > 0 THEN CAST(c.c_acctbal AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END)
           AS mercado_estimado_mensal
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY n.n_name, c.c_mktsegment
)"""

# Reusable query fragments ---------------------------------------------------

CLIENT_ROLLUP = """
client_roll AS (
  SELECT b.cliente_id,
         sum(b.receita_bruta) AS receita_bruta, sum(b.receita_liquida) AS receita_liquida,
         sum(b.desconto) AS desconto_total, sum(b.custo_total) AS custo_total,
         sum(b.margem_contribuicao) AS margem_total, count(DISTINCT b.pedido_id) AS total_pedidos,
         sum(b.quantidade) AS total_itens, sum(b.volume_kg) AS volume_total_kg,
         min(b.data_pedido) AS primeira_compra, max(b.data_pedido) AS ultima_compra,
         count(DISTINCT b.sku_id) AS skus_unicos, count(DISTINCT p.categoria) AS categorias_unicas,
         coalesce(sum(CASE WHEN year(b.data_pedido) = 1999 THEN b.receita_liquida END), 0) AS receita_1999,
         coalesce(sum(CASE WHEN year(b.data_pedido) = 2000 THEN b.receita_liquida END), 0) AS receita_2000
  FROM billed b LEFT JOIN products p ON b.sku_id = p.sku_id
  WHERE b.cliente_id IS NOT NULL
  GROUP BY b.cliente_id
),
client_vis AS (
  SELECT cliente_id, count(visita_id) AS total_visitas,
         CAST(sum(CAST(duracao_min AS DECIMAL(38,2))) AS DOUBLE) / CAST(count(duracao_min) AS DOUBLE) AS duracao_media_visita,
         count(*) FILTER (WHERE tipo_visita = 'Planejada') AS visitas_planejadas,
         count(*) FILTER (WHERE tipo_visita = 'Extra-rota') AS visitas_extra,
         count(*) FILTER (WHERE resultado_visita = 'Pedido') AS visitas_com_pedido,
         max(data_visita) AS ultima_visita
  FROM visits WHERE cliente_id IS NOT NULL GROUP BY cliente_id
),
pot_cc AS (
  SELECT cidade, canal, sum(mercado_estimado_mensal) AS pot
  FROM potential WHERE cidade IS NOT NULL AND canal IS NOT NULL GROUP BY cidade, canal
),
master0 AS (
  SELECT c.*,
         coalesce(r.receita_bruta, 0) AS receita_bruta, coalesce(r.receita_liquida, 0) AS receita_liquida,
         coalesce(r.desconto_total, 0) AS desconto_total, coalesce(r.custo_total, 0) AS custo_total,
         coalesce(r.margem_total, 0) AS margem_total, coalesce(r.total_pedidos, 0) AS total_pedidos,
         coalesce(r.total_itens, 0) AS total_itens, coalesce(r.volume_total_kg, 0) AS volume_total_kg,
         r.primeira_compra, r.ultima_compra,
         coalesce(r.skus_unicos, 0) AS skus_unicos, coalesce(r.categorias_unicas, 0) AS categorias_unicas,
         coalesce(r.receita_1999, 0) AS receita_1999, coalesce(r.receita_2000, 0) AS receita_2000,
         coalesce(v.total_visitas, 0) AS total_visitas, coalesce(v.duracao_media_visita, 0) AS duracao_media_visita,
         coalesce(v.visitas_planejadas, 0) AS visitas_planejadas, coalesce(v.visitas_extra, 0) AS visitas_extra,
         coalesce(v.visitas_com_pedido, 0) AS visitas_com_pedido, v.ultima_visita,
         coalesce(CAST(v.visitas_com_pedido AS DOUBLE) / CASE WHEN v.total_visitas = 0 THEN 1.0::DOUBLE
                  ELSE CAST(v.total_visitas AS DOUBLE) END, 0) AS taxa_conversao_visitas,
         coalesce(pc.pot, 0) AS potencial_mercado_cidade_canal_mensal
  FROM clients c
  LEFT JOIN client_roll r ON c.cliente_id = r.cliente_id
  LEFT JOIN client_vis v ON c.cliente_id = v.cliente_id
  LEFT JOIN pot_cc pc ON c.cidade = pc.cidade AND c.canal = pc.canal
),
master AS (
  SELECT *,
         CASE WHEN receita_liquida > 0 THEN CAST(margem_total AS DOUBLE) / CAST(receita_liquida AS DOUBLE) ELSE 0.0 END AS margem_pct,
         CASE WHEN receita_bruta > 0 THEN CAST(desconto_total AS DOUBLE) / CAST(receita_bruta AS DOUBLE) ELSE 0.0 END AS desconto_pct,
         CASE WHEN total_pedidos > 0 THEN CAST(receita_liquida AS DOUBLE) / CAST(total_pedidos AS DOUBLE) ELSE 0.0 END AS ticket_medio,
         coalesce(CAST(floor((epoch((SELECT max(o_orderdate) FROM orders)) - epoch(ultima_compra)) / 86400) AS BIGINT), 999) AS recencia_dias,
         CASE WHEN receita_1999 > 0 THEN (CAST(receita_2000 AS DOUBLE) - CAST(receita_1999 AS DOUBLE)) / CAST(receita_1999 AS DOUBLE)
              WHEN receita_2000 > 0 THEN 1.0 ELSE 0.0 END AS crescimento_yoy
  FROM master0
)"""


def q(*parts: str) -> str:
    """BINDING followed by extra CTEs (comma-joined) and the final SELECT (last part)."""
    *ctes, final = parts
    body = BINDING
    for c in ctes:
        body += ",\n" + c.strip()
    return (body + "\n" + final.strip()).replace("{MONTHS}", MONTHS)


TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def ts(col: str) -> str:
    return TS.format(col)



from .. import params as P  # noqa: E402


def r6(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), 6) AS DOUBLE)"


def rhu(x: str, d: int) -> str:
    """Half-up rounding of a double through DECIMAL."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {d}) AS DOUBLE)"


def rmoney(x: str, d: int = 2) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,4)), {d}) AS DOUBLE)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def sq(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SEG_VALUES = ", ".join(
    f"({sq(s.code)}, {sq(s.name)}, {sq(s.tag)}, {sq(s.description)})" for s in P.SEGMENTS
)

DURATION_CASE = "CASE " + " ".join(
    f"WHEN duracao_min > {lo} AND duracao_min <= {hi} THEN {sq(lab)}"
    for lo, hi, lab in zip(P.DURATION_EDGES[:-1], P.DURATION_EDGES[1:], P.DURATION_LABELS)
) + " END"

DISC_RATE = "CASE WHEN receita_bruta > 0 THEN CAST(desconto AS DOUBLE) / CAST(receita_bruta AS DOUBLE) ELSE 0.0 END"
DISC_CASE = "CASE " + " ".join(
    f"WHEN ({DISC_RATE}) > CAST({lo} AS DOUBLE) AND ({DISC_RATE}) <= CAST({hi} AS DOUBLE) THEN {sq(lab)}"
    for lo, hi, lab in zip(P.DISCOUNT_EDGES[:-1], P.DISCOUNT_EDGES[1:], P.DISCOUNT_LABELS)
) + " END"

DUR_LABELS = "(VALUES " + ", ".join(f"({sq(l)}, {i})" for i, l in enumerate(P.DURATION_LABELS)) + ") AS l(duracao_faixa, ordem)"
DISC_LABELS = "(VALUES " + ", ".join(f"({sq(l)}, {i})" for i, l in enumerate(P.DISCOUNT_LABELS)) + ") AS l(faixa_desconto, ordem)"
ABC_LABELS = "(VALUES " + ", ".join(f"({sq(l)})" for l in P.ABC_LABELS) + ") AS l(curva_abc)"

# fixed labelling by store-size tier (checkouts), its profile and the greedy roles
TIER = (
    "CAST(CASE WHEN n_checkouts IS NULL THEN 0 WHEN n_checkouts <= 3 THEN 1 WHEN n_checkouts <= 5 THEN 2 "
    "WHEN n_checkouts <= 7 THEN 3 ELSE 4 END AS INTEGER)"
)
LABELS = f"""
master_l AS (SELECT *, {TIER} AS cluster_raw FROM master),
prof AS (
  SELECT cluster_raw, count(cliente_id) AS n,
         CAST(sum(CAST(receita_liquida AS DECIMAL(38,4))) AS DOUBLE) / CAST(count(receita_liquida) AS DOUBLE) AS rec_liq_med,
         sum(receita_liquida) AS rec_liq_sum,
         CAST(sum(total_pedidos) AS DOUBLE) / CAST(count(total_pedidos) AS DOUBLE) AS pedidos_med,
         CAST(sum(recencia_dias) AS DOUBLE) / CAST(count(recencia_dias) AS DOUBLE) AS recencia_med,
         avg(margem_pct) AS margem_pct_med, avg(desconto_pct) AS desconto_pct_med,
         CAST(sum(skus_unicos) AS DOUBLE) / CAST(count(skus_unicos) AS DOUBLE) AS skus_med,
         avg(n_checkouts) AS checkouts_med, avg(area_loja_m2) AS area_med,
         avg(taxa_conversao_visitas) AS conversao_visitas_med
  FROM master_l GROUP BY cluster_raw
),
r1 AS (SELECT cluster_raw FROM prof ORDER BY rec_liq_med DESC NULLS LAST, cluster_raw LIMIT 1),
r2 AS (SELECT cluster_raw FROM prof WHERE cluster_raw NOT IN (SELECT cluster_raw FROM r1)
       ORDER BY recencia_med DESC NULLS LAST, cluster_raw LIMIT 1),
r3 AS (SELECT cluster_raw FROM prof WHERE cluster_raw NOT IN (SELECT cluster_raw FROM r1 UNION ALL SELECT cluster_raw FROM r2)
       ORDER BY checkouts_med DESC NULLS LAST, cluster_raw LIMIT 1),
r4 AS (SELECT cluster_raw FROM prof WHERE cluster_raw NOT IN (SELECT cluster_raw FROM r1 UNION ALL SELECT cluster_raw FROM r2
       UNION ALL SELECT cluster_raw FROM r3) ORDER BY desconto_pct_med DESC NULLS LAST, cluster_raw LIMIT 1),
seg AS (SELECT * FROM (VALUES {SEG_VALUES}) AS t(cluster_code, cluster_nome, cluster_tag, cluster_desc)),
roles0 AS (
  SELECT cluster_raw, 'C1_KEY_ACCOUNTS' AS cluster_code, 0 AS prioridade FROM r1
  UNION ALL SELECT cluster_raw, 'C3_CHURN_RISK', 1 FROM r2
  UNION ALL SELECT cluster_raw, 'C2_HIGH_POTENTIAL', 2 FROM r3
  UNION ALL SELECT cluster_raw, 'C4_DISCOUNT_HUNTERS', 3 FROM r4
  UNION ALL SELECT cluster_raw, 'C5_RETAIL_STABLE', 4 FROM prof
    WHERE cluster_raw NOT IN (SELECT cluster_raw FROM r1 UNION ALL SELECT cluster_raw FROM r2
                              UNION ALL SELECT cluster_raw FROM r3 UNION ALL SELECT cluster_raw FROM r4)
),
roles AS (SELECT r.cluster_raw, r.cluster_code, s.cluster_nome, s.cluster_tag, s.cluster_desc, r.prioridade
          FROM roles0 r LEFT JOIN seg s ON r.cluster_code = s.cluster_code),
labelled AS (SELECT m.*, r.cluster_code, r.cluster_nome, r.cluster_tag, r.cluster_desc
             FROM master_l m LEFT JOIN roles r ON m.cluster_raw = r.cluster_raw)"""

REC = f"""
rec AS (
  SELECT cliente_id AS id, nome_cliente_ficticio AS nome, canal, porte, cidade, uf, regiao_comercial AS regiao, vendedor_id,
         coalesce(CAST(trunc(n_checkouts) AS BIGINT), 0) AS checkouts,
         coalesce(CAST(trunc(area_loja_m2) AS BIGINT), 0) AS area_m2,
         coalesce(faixa_faturamento_pdv, '') AS faixa_fat, coalesce(strftime(data_cadastro, '%Y-%m-%d'), '') AS data_cad,
         coalesce(status_cliente, '') AS status, cluster_raw, cluster_nome, cluster_code, cluster_tag,
         {rmoney('receita_bruta')} AS rec_bruta, {rmoney('receita_liquida')} AS rec_liq,
         {rmoney('margem_total')} AS margem, {rhu('margem_pct * 100', 2)} AS margem_pct,
         {rmoney('desconto_total')} AS desconto, {rhu('desconto_pct * 100', 2)} AS desconto_pct,
         CAST(total_pedidos AS BIGINT) AS pedidos, CAST(trunc(total_itens) AS BIGINT) AS itens,
         {rhu('volume_total_kg', 1)} AS volume_kg, {rhu('ticket_medio', 2)} AS ticket_medio,
         CAST(skus_unicos AS BIGINT) AS skus, CAST(categorias_unicas AS BIGINT) AS categorias,
         CAST(recencia_dias AS BIGINT) AS recencia_dias,
         coalesce(strftime(primeira_compra, '%Y-%m-%d'), '') AS primeira_compra,
         coalesce(strftime(ultima_compra, '%Y-%m-%d'), '') AS ultima_compra,
         CAST(total_visitas AS BIGINT) AS visitas, CAST(visitas_com_pedido AS BIGINT) AS visitas_pedidos,
         {rhu('taxa_conversao_visitas * 100', 1)} AS conv_visitas,
         {rmoney('receita_1999')} AS rec_1999, {rmoney('receita_2000')} AS rec_2000,
         {rhu('crescimento_yoy * 100', 1)} AS cresc_yoy,
         {rmoney('potencial_mercado_cidade_canal_mensal')} AS potencial_cidade
  FROM labelled
)"""

SELLER = """
s_sales AS (
  SELECT vendedor_id, sum(receita_liquida) AS receita_total, sum(margem_contribuicao) AS margem_total,
         count(DISTINCT pedido_id) AS pedidos_total, sum(quantidade) AS itens_total,
         count(DISTINCT cliente_id) AS clientes_atendidos, sum(desconto) AS desconto_total, sum(receita_bruta) AS receita_bruta
  FROM billed WHERE vendedor_id IS NOT NULL GROUP BY vendedor_id
),
s_vis AS (
  SELECT vendedor_id, count(visita_id) AS total_visitas,
         count(*) FILTER (WHERE resultado_visita = 'Pedido') AS visitas_com_pedido,
         CAST(sum(CAST(duracao_min AS DECIMAL(38,2))) AS DOUBLE) / CAST(count(duracao_min) AS DOUBLE) AS duracao_media,
         CAST(count(*) FILTER (WHERE checkin_ok = 'Sim') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS checkin_ok_pct
  FROM visits WHERE vendedor_id IS NOT NULL GROUP BY vendedor_id
),
sm0 AS (
  SELECT s.*,
         coalesce(a.receita_total, 0) AS receita_total, coalesce(a.margem_total, 0) AS margem_total,
         coalesce(a.pedidos_total, 0) AS pedidos_total, coalesce(a.itens_total, 0) AS itens_total,
         coalesce(a.clientes_atendidos, 0) AS clientes_atendidos, coalesce(a.desconto_total, 0) AS desconto_total,
         coalesce(a.receita_bruta, 0) AS receita_bruta,
         coalesce(v.total_visitas, 0) AS total_visitas, coalesce(v.visitas_com_pedido, 0) AS visitas_com_pedido,
         coalesce(v.duracao_media, 0) AS duracao_media, coalesce(v.checkin_ok_pct, 0) AS checkin_ok_pct,
         coalesce(CAST(v.visitas_com_pedido AS DOUBLE) / CASE WHEN v.total_visitas = 0 THEN 1.0::DOUBLE
                  ELSE CAST(v.total_visitas AS DOUBLE) END, 0) AS conversao_visitas_pct
  FROM sellers s LEFT JOIN s_sales a ON s.vendedor_id = a.vendedor_id LEFT JOIN s_vis v ON s.vendedor_id = v.vendedor_id
),
sm1 AS (
  SELECT *, CAST(meta_receita_mensal AS DECIMAL(38,4)) * {MONTHS} AS meta_receita_periodo,
         CASE WHEN receita_total > 0 THEN CAST(margem_total AS DOUBLE) / CAST(receita_total AS DOUBLE) ELSE 0.0 END AS margem_realizada_pct,
         CASE WHEN receita_bruta > 0 THEN CAST(desconto_total AS DOUBLE) / CAST(receita_bruta AS DOUBLE) ELSE 0.0 END AS desconto_medio_pct,
         CAST(total_visitas AS DOUBLE) / CAST({MONTHS} AS DOUBLE) AS visitas_mes_realizadas
  FROM sm0
),
sm2 AS (
  SELECT *,
         CASE WHEN meta_receita_periodo <> 0 THEN CAST(receita_total AS DOUBLE) / CAST(meta_receita_periodo AS DOUBLE) END AS atingimento_receita_pct,
         CASE WHEN meta_margem_pct <> 0 THEN margem_realizada_pct / meta_margem_pct END AS atingimento_margem_pct,
         CASE WHEN capacidade_visitas_mes <> 0 THEN visitas_mes_realizadas / capacidade_visitas_mes END AS aproveitamento_capacidade_visitas
  FROM sm1
),
smaster AS (
  SELECT *,
         CASE WHEN atingimento_receita_pct >= 1.0 AND margem_realizada_pct >= meta_margem_pct THEN 'Alta Performance (Estrela)'
              WHEN atingimento_receita_pct >= 1.0 AND margem_realizada_pct < meta_margem_pct THEN 'Volume com Baixa Margem'
              WHEN atingimento_receita_pct < 1.0 AND margem_realizada_pct >= meta_margem_pct THEN 'Rentável com Baixo Volume'
              ELSE 'Abaixo da Meta (Crítico)' END AS perfil_vendedor
  FROM sm2
)"""

SREC = f"""
srec AS (
  SELECT vendedor_id AS id, nome_vendedor_ficticio AS nome, regiao_comercial AS regiao,
         coalesce(strftime(data_admissao, '%Y-%m-%d'), '') AS admissao,
         CAST(custo_mensal_total AS DOUBLE) AS custo_mensal, CAST(meta_receita_mensal AS DOUBLE) AS meta_rec_mensal,
         {rhu('meta_margem_pct * 100', 2)} AS meta_margem_pct,
         {rmoney('receita_total')} AS rec_total, {rmoney('margem_total')} AS margem_total,
         {rhu('margem_realizada_pct * 100', 2)} AS margem_pct,
         CAST(pedidos_total AS BIGINT) AS pedidos, CAST(clientes_atendidos AS BIGINT) AS clientes_ativos,
         CAST(total_visitas AS BIGINT) AS visitas_total, CAST(visitas_com_pedido AS BIGINT) AS visitas_pedidos,
         {rhu('conversao_visitas_pct * 100', 1)} AS conv_visitas,
         {rhu('atingimento_receita_pct * 100', 1)} AS ating_rec_pct,
         {rhu('atingimento_margem_pct * 100', 1)} AS ating_margem_pct,
         {rhu('desconto_medio_pct * 100', 2)} AS desconto_pct,
         {rhu('checkin_ok_pct * 100', 1)} AS checkin_pct,
         perfil_vendedor AS perfil, CAST(trunc(capacidade_visitas_mes) AS BIGINT) AS capacidade_visitas
  FROM smaster
)"""

SKU = """
k_sales AS (
  SELECT sku_id, sum(receita_liquida) AS receita_total, sum(quantidade) AS quantidade_total,
         sum(volume_kg) AS volume_kg_total, sum(margem_contribuicao) AS margem_total, sum(desconto) AS desconto_total,
         count(DISTINCT pedido_id) AS pedidos_total, count(DISTINCT cliente_id) AS clientes_atendidos
  FROM billed WHERE sku_id IS NOT NULL GROUP BY sku_id
),
km0 AS (
  SELECT p.*, coalesce(k.receita_total, 0) AS receita_total, coalesce(k.quantidade_total, 0) AS quantidade_total,
         coalesce(k.volume_kg_total, 0) AS volume_kg_total, coalesce(k.margem_total, 0) AS margem_total,
         coalesce(k.desconto_total, 0) AS desconto_total, coalesce(k.pedidos_total, 0) AS pedidos_total,
         coalesce(k.clientes_atendidos, 0) AS clientes_atendidos
  FROM products p LEFT JOIN k_sales k ON p.sku_id = k.sku_id
),
kmaster AS (
  SELECT *,
         CASE WHEN receita_total > 0 THEN CAST(margem_total AS DOUBLE) / CAST(receita_total AS DOUBLE) ELSE 0.0 END AS margem_pct,
         CASE WHEN receita_total + desconto_total > 0 THEN CAST(desconto_total AS DOUBLE) / CAST(receita_total + desconto_total AS DOUBLE) ELSE 0.0 END AS desconto_medio_pct,
         CASE WHEN pedidos_total > 0 THEN CAST(receita_total AS DOUBLE) / CAST(pedidos_total AS DOUBLE) ELSE 0.0 END AS ticket_medio_item
  FROM km0
),
kabc0 AS (
  SELECT *, sum(receita_total) OVER (ORDER BY receita_total DESC, sku_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS receita_cum,
         sum(receita_total) OVER () AS _total
  FROM kmaster
),
kabc AS (
  SELECT *, CASE WHEN _total <> 0 THEN CAST(receita_cum AS DOUBLE) / CAST(_total AS DOUBLE) END AS receita_cum_pct,
         CASE WHEN CASE WHEN _total <> 0 THEN CAST(receita_cum AS DOUBLE) / CAST(_total AS DOUBLE) END <= 0.70::DOUBLE THEN 'A (Top 70%)'
              WHEN CASE WHEN _total <> 0 THEN CAST(receita_cum AS DOUBLE) / CAST(_total AS DOUBLE) END <= 0.90::DOUBLE THEN 'B (Próximos 20%)'
              ELSE 'C (Cauda Longa 10%)' END AS curva_abc
  FROM kabc0
)"""

KREC = f"""
krec AS (
  SELECT sku_id, sku_nome AS nome, categoria, subcategoria, marca, formato, volume,
         CAST(preco_lista AS DOUBLE) AS preco_lista, CAST(custo_unitario AS DOUBLE) AS custo_unit,
         status_sku AS status, substituto_sku_id AS substituto,
         {rmoney('receita_total')} AS rec_total, CAST(trunc(quantidade_total) AS BIGINT) AS qtd_total,
         {rhu('volume_kg_total', 1)} AS volume_kg, {rmoney('margem_total')} AS margem_total,
         {rhu('margem_pct * 100', 2)} AS margem_pct, {rhu('desconto_medio_pct * 100', 2)} AS desconto_pct,
         curva_abc, CAST(pedidos_total AS BIGINT) AS pedidos, CAST(clientes_atendidos AS BIGINT) AS clientes
  FROM kabc
)"""

SUMMARY = f"""
csum AS (
  SELECT cluster_raw, cluster_nome, cluster_code, cluster_tag, cluster_desc, count(*) AS total_clientes,
         sum(receita_liquida) AS _rec, sum(margem_total) AS _marg, avg(margem_pct) AS _mpct, avg(desconto_pct) AS _dpct,
         CAST(sum(CAST(receita_liquida AS DECIMAL(38,4))) AS DOUBLE) / CAST(count(receita_liquida) AS DOUBLE) AS _recm,
         CAST(sum(total_pedidos) AS DOUBLE) / CAST(count(total_pedidos) AS DOUBLE) AS _ped,
         avg(ticket_medio) AS _tick,
         CAST(sum(skus_unicos) AS DOUBLE) / CAST(count(skus_unicos) AS DOUBLE) AS _skus,
         CAST(sum(recencia_dias) AS DOUBLE) / CAST(count(recencia_dias) AS DOUBLE) AS _rece,
         avg(n_checkouts) AS _chk, avg(area_loja_m2) AS _area,
         CAST(sum(total_visitas) AS DOUBLE) / CAST(count(total_visitas) AS DOUBLE) AS _vis,
         avg(taxa_conversao_visitas) AS _conv
  FROM labelled GROUP BY cluster_raw, cluster_nome, cluster_code, cluster_tag, cluster_desc
),
ctot AS (SELECT count(*) AS _n_all, sum(receita_liquida) AS _rec_all FROM labelled),
summary AS (
  SELECT cluster_raw, cluster_nome, cluster_code, cluster_tag, cluster_desc, total_clientes,
         {rhu('CAST(total_clientes AS DOUBLE) / CAST(_n_all AS DOUBLE) * 100', 1)} AS pct_clientes,
         {rmoney('_rec')} AS rec_total,
         {rhu('(CASE WHEN _rec_all <> 0 THEN CAST(_rec AS DOUBLE) / CAST(_rec_all AS DOUBLE) END) * 100', 1)} AS pct_receita,
         {rmoney('_marg')} AS margem_total,
         {rhu('_mpct * 100', 2)} AS margem_pct_med, {rhu('_dpct * 100', 2)} AS desconto_pct_med,
         {rhu('_recm', 2)} AS rec_med, {rhu('_ped', 1)} AS pedidos_med, {rhu('_tick', 2)} AS ticket_med,
         {rhu('_skus', 1)} AS skus_med, {rhu('_rece', 0)} AS recencia_med, {rhu('_chk', 1)} AS checkouts_med,
         {rhu('_area', 1)} AS area_med, {rhu('_vis', 1)} AS visitas_med, {rhu('_conv * 100', 1)} AS conv_visitas_med
  FROM csum, ctot
)"""

CURVE = f"""
vband AS (SELECT *, {DURATION_CASE} AS duracao_faixa FROM visits),
vcells AS (
  SELECT duracao_faixa, tipo_visita, count(visita_id) AS total,
         count(*) FILTER (WHERE resultado_visita = 'Pedido') AS com_pedido
  FROM vband WHERE duracao_faixa IS NOT NULL AND tipo_visita IS NOT NULL GROUP BY duracao_faixa, tipo_visita
),
vtypes AS (SELECT DISTINCT tipo_visita FROM visits WHERE tipo_visita IS NOT NULL),
curve AS (
  SELECT l.duracao_faixa, t.tipo_visita, coalesce(c.total, 0) AS total, coalesce(c.com_pedido, 0) AS com_pedido,
         CAST(coalesce(c.com_pedido, 0) AS DOUBLE) / CASE WHEN coalesce(c.total, 0) = 0 THEN 1.0::DOUBLE
              ELSE CAST(coalesce(c.total, 0) AS DOUBLE) END AS taxa_conversao
  FROM {DUR_LABELS} CROSS JOIN vtypes t
  LEFT JOIN vcells c ON c.duracao_faixa = l.duracao_faixa AND c.tipo_visita = t.tipo_visita
)"""

SWP = """
swp AS (SELECT b.*, p.categoria, p.subcategoria, p.marca, p.preco_lista, p.custo_unitario
        FROM billed b LEFT JOIN products p ON b.sku_id = p.sku_id)"""

TOP = """
cs AS (SELECT cliente_id, sku_id, sum(receita_liquida) AS receita_liquida FROM billed
       WHERE cliente_id IS NOT NULL AND sku_id IS NOT NULL GROUP BY cliente_id, sku_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cliente_id ORDER BY receita_liquida DESC, sku_id) AS rank FROM cs)
        WHERE rank <= 3)"""

SPARK_LONG = """
months6 AS (SELECT DISTINCT mes_ref FROM billed WHERE mes_ref IS NOT NULL ORDER BY mes_ref DESC LIMIT 6),
cm AS (SELECT cliente_id, mes_ref, sum(receita_liquida) AS receita_liquida FROM billed
       WHERE mes_ref IN (SELECT mes_ref FROM months6) AND cliente_id IS NOT NULL GROUP BY cliente_id, mes_ref),
spark_long AS (
  SELECT c.cliente_id, m.mes_ref, coalesce(cm.receita_liquida, 0) AS receita_liquida
  FROM clients c CROSS JOIN months6 m LEFT JOIN cm ON cm.cliente_id = c.cliente_id AND cm.mes_ref = m.mes_ref
)"""

MIX_LONG = """
ccat AS (SELECT cliente_id, categoria, sum(receita_liquida) AS receita_liquida FROM swp
         WHERE cliente_id IS NOT NULL AND categoria IS NOT NULL GROUP BY cliente_id, categoria),
cats AS (SELECT DISTINCT categoria FROM products WHERE categoria IS NOT NULL),
mix0 AS (
  SELECT c.cliente_id, k.categoria, coalesce(cc.receita_liquida, 0) AS receita_liquida
  FROM clients c CROSS JOIN cats k LEFT JOIN ccat cc ON cc.cliente_id = c.cliente_id AND cc.categoria = k.categoria
),
mix_long AS (
  SELECT *, least(100.0::DOUBLE, CAST(receita_liquida AS DOUBLE)
               / CAST(greatest(max(receita_liquida) OVER (PARTITION BY cliente_id), 100) AS DOUBLE) * 100.0::DOUBLE) AS barra_pct,
         receita_liquida > 0 AS comprado
  FROM mix0
)"""

STD = """
feat AS (
  SELECT cliente_id, ln(1 + CAST(receita_liquida AS DOUBLE)) AS log_receita, CAST(total_pedidos AS DOUBLE) AS frequencia,
         CAST(recencia_dias AS DOUBLE) AS recencia, margem_pct, desconto_pct, CAST(skus_unicos AS DOUBLE) AS mix_skus,
         ln(1 + ticket_medio) AS ticket_medio_log, coalesce(n_checkouts, 1.0) AS checkouts, coalesce(area_loja_m2, 30.0) AS area_loja
  FROM master
)"""

FEATS = ["log_receita", "frequencia", "recencia", "margem_pct", "desconto_pct", "mix_skus", "ticket_medio_log", "checkouts", "area_loja"]


def pick(*names: str) -> str:
    return ", ".join(names)


SQL: dict[str, str] = {}

SQL["load_table"] = """SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size,
       CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS p_retailprice FROM part"""

SQL["coerce_numeric"] = """SELECT c_custkey, TRY_CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) AS c_acctbal,
       TRY_CAST(c_mktsegment AS DOUBLE) AS c_mktsegment FROM customer"""

MONTHLY = f"""
SELECT mes_ref, CAST(sum(receita_liquida) AS DOUBLE) AS receita_liquida, CAST(sum(receita_bruta) AS DOUBLE) AS receita_bruta,
       CAST(sum(desconto) AS DOUBLE) AS desconto, CAST(sum(custo_total) AS DOUBLE) AS custo_total,
       CAST(sum(margem_contribuicao) AS DOUBLE) AS margem_contribuicao,
       count(DISTINCT pedido_id) AS pedidos, count(DISTINCT cliente_id) AS clientes_ativos,
       CASE WHEN sum(receita_liquida) <> 0 THEN CAST(sum(margem_contribuicao) AS DOUBLE) / CAST(sum(receita_liquida) AS DOUBLE) END AS margem_pct,
       CASE WHEN sum(receita_bruta) <> 0 THEN CAST(sum(desconto) AS DOUBLE) / CAST(sum(receita_bruta) AS DOUBLE) END AS desconto_pct
FROM billed WHERE mes_ref IS NOT NULL GROUP BY mes_ref"""
SQL["monthly_trend"] = q(MONTHLY)
SQL["sink_json"] = q(MONTHLY)

BILLED_COLS = f"""pedido_id, cliente_id, vendedor_id, sku_id, {ts('data_pedido')} AS data_pedido, mes_ref, status_pedido,
       quantidade, volume_kg, CAST(receita_bruta AS DOUBLE) AS receita_bruta, CAST(desconto AS DOUBLE) AS desconto,
       CAST(receita_liquida AS DOUBLE) AS receita_liquida, CAST(custo_total AS DOUBLE) AS custo_total,
       CAST(margem_contribuicao AS DOUBLE) AS margem_contribuicao"""

SQL["billed_sales"] = q(f"SELECT {BILLED_COLS} FROM billed")

SQL["dimension_filter"] = q(f"""
SELECT cliente_id, canal, uf, regiao_comercial, porte, {TIER} AS cluster_raw, vendedor_id
FROM clients WHERE canal = 'HOUSEHOLD' AND porte = 'M' AND {TIER} = 2""")


def contains(col: str, needle: str) -> str:
    return f"coalesce(contains(lower(CAST({col} AS VARCHAR)), {sq(needle)}), false)"


SQL["search_clients"] = q(CLIENT_ROLLUP, LABELS, REC, f"""
SELECT id, nome, cidade, uf, vendedor_id, rec_liq FROM rec
WHERE {' OR '.join(contains(c, '12') for c in ('nome', 'id', 'cidade', 'uf', 'vendedor_id'))}""")

CSV_COLUMNS = (
    "id ID, nome Nome, canal Canal, porte Porte, cidade Cidade, uf UF, regiao Regiao, vendedor_id Vendedor, "
    "cluster_nome Cluster, rec_liq Receita_Liquida, margem_pct Margem_Pct, pedidos Pedidos, recencia_dias Recencia_Dias, "
    "skus SKUs_Mix"
)
SQL["sink_csv"] = q(CLIENT_ROLLUP, LABELS, REC, f"""
SELECT {', '.join('CAST({} AS VARCHAR) AS "{}"'.format(*c.split()) for c in CSV_COLUMNS.split(', '))}
FROM rec WHERE CAST(canal AS VARCHAR) = 'BUILDING'""")

SQL["search_products"] = q(f"""
SELECT sku_id, sku_nome AS nome, categoria FROM products
WHERE {' OR '.join(contains(c, 'blue') for c in ('sku_nome', 'sku_id', 'categoria'))}""")

SQL["search_postings"] = q(" UNION ALL ".join(f"""
SELECT {sq(b)} AS busca, sku_id, sku_nome AS nome, categoria FROM products
WHERE {' OR '.join(contains(c, b.strip().lower()) for c in ('sku_nome', 'sku_id', 'categoria'))}"""
    for b in ("blue", " RING", "ar", "99", "7", "small", "no such product")))

SQL["load_rejects"] = " UNION ALL ".join(f"""
SELECT '{c}' AS coluna, 'tipo' AS motivo, count(*) AS n, min(CAST({c} AS VARCHAR)) AS menor_valor
FROM customer WHERE {c} IS NOT NULL AND TRY_CAST({c} AS {t}) IS NULL HAVING count(*) > 0"""
    for c, t in (("c_custkey", "TINYINT"), ("c_name", "BIGINT"), ("c_mktsegment", "DOUBLE")))

SQL["search_flag"] = q(CLIENT_ROLLUP, LABELS, REC, f"""
SELECT id, ({' OR '.join(contains(c, 'nation_1') for c in ('nome', 'id', 'cidade'))}) AS destaque_busca,
       (CAST(regiao AS VARCHAR) = 'ASIA') AS no_filtro
FROM rec""")

SQL["distinct_values"] = q("""
SELECT dimensao, valor, CAST(row_number() OVER (PARTITION BY dimensao ORDER BY o, valor) AS INTEGER) AS ordem FROM (
  SELECT DISTINCT 'canal' AS dimensao, canal AS valor, canal AS o FROM clients WHERE canal IS NOT NULL
  UNION ALL SELECT DISTINCT 'uf', uf, uf FROM clients WHERE uf IS NOT NULL
  UNION ALL SELECT DISTINCT 'regiao_comercial', regiao_comercial, regiao_comercial FROM clients WHERE regiao_comercial IS NOT NULL
  UNION ALL SELECT DISTINCT 'vendedor', CAST(vendedor_id AS VARCHAR), nome_vendedor_ficticio FROM sellers WHERE vendedor_id IS NOT NULL
)""")

SQL["client_record"] = q(CLIENT_ROLLUP, LABELS, REC, "SELECT * FROM rec")
SQL["seller_record"] = q(SELLER, SREC, "SELECT * FROM srec")
SQL["sku_record"] = q(SKU, KREC, "SELECT * FROM krec")

SQL["sales_with_product"] = q(SWP, f"""
SELECT {BILLED_COLS}, categoria, subcategoria, marca, CAST(preco_lista AS DOUBLE) AS preco_lista,
       CAST(custo_unitario AS DOUBLE) AS custo_unitario FROM swp""")

SQL["client_potential"] = q(CLIENT_ROLLUP, """
SELECT c.cliente_id, c.cidade, c.canal, CAST(coalesce(p.pot, 0) AS DOUBLE) AS potencial_mercado_cidade_canal_mensal
FROM clients c LEFT JOIN pot_cc p ON c.cidade = p.cidade AND c.canal = p.canal""")

SQL["seller_master"] = q(SELLER, f"""
SELECT vendedor_id, nome_vendedor_ficticio, regiao_comercial, {ts('data_admissao')} AS data_admissao,
       CAST(custo_mensal_total AS DOUBLE) AS custo_mensal_total, CAST(meta_receita_mensal AS DOUBLE) AS meta_receita_mensal,
       meta_margem_pct, capacidade_visitas_mes,
       CAST(receita_total AS DOUBLE) AS receita_total, CAST(margem_total AS DOUBLE) AS margem_total, pedidos_total,
       itens_total, clientes_atendidos, CAST(desconto_total AS DOUBLE) AS desconto_total,
       CAST(receita_bruta AS DOUBLE) AS receita_bruta, total_visitas, visitas_com_pedido, duracao_media, checkin_ok_pct,
       conversao_visitas_pct, CAST(meta_receita_periodo AS DOUBLE) AS meta_receita_periodo, margem_realizada_pct,
       desconto_medio_pct, visitas_mes_realizadas, atingimento_receita_pct, atingimento_margem_pct,
       aproveitamento_capacidade_visitas, perfil_vendedor
FROM smaster""")

SQL["sku_master"] = q(SKU, """
SELECT sku_id, sku_nome, categoria, subcategoria, marca, formato, volume, CAST(preco_lista AS DOUBLE) AS preco_lista,
       CAST(custo_unitario AS DOUBLE) AS custo_unitario, status_sku, substituto_sku_id,
       CAST(receita_total AS DOUBLE) AS receita_total, quantidade_total, volume_kg_total,
       CAST(margem_total AS DOUBLE) AS margem_total, CAST(desconto_total AS DOUBLE) AS desconto_total,
       pedidos_total, clientes_atendidos, margem_pct, desconto_medio_pct, ticket_medio_item
FROM kmaster""")

SQL["sales_with_client_geo"] = q(f"""
SELECT b.pedido_id, b.cliente_id, b.vendedor_id, b.sku_id, {ts('b.data_pedido')} AS data_pedido, b.mes_ref, b.status_pedido,
       b.quantidade, b.volume_kg, CAST(b.receita_bruta AS DOUBLE) AS receita_bruta, CAST(b.desconto AS DOUBLE) AS desconto,
       CAST(b.receita_liquida AS DOUBLE) AS receita_liquida, CAST(b.custo_total AS DOUBLE) AS custo_total,
       CAST(b.margem_contribuicao AS DOUBLE) AS margem_contribuicao, c.uf, c.regiao_comercial, c.cidade, c.canal
FROM billed b LEFT JOIN clients c ON b.cliente_id = c.cliente_id""")

MIX = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
SQL["client_360"] = q(CLIENT_ROLLUP, LABELS, REC, SELLER, SREC, SWP, TOP, SPARK_LONG, MIX_LONG, f"""
topn AS (SELECT t.*, coalesce(p.sku_nome, CAST(t.sku_id AS VARCHAR)) AS nome FROM top t LEFT JOIN products p ON t.sku_id = p.sku_id),
t_agg AS (
  SELECT cliente_id, count(*) AS n_top,
         max(CASE WHEN rank = 1 THEN nome END) AS top1_nome, max(CASE WHEN rank = 2 THEN nome END) AS top2_nome,
         max(CASE WHEN rank = 3 THEN nome END) AS top3_nome,
         max(CASE WHEN rank = 1 THEN CAST(receita_liquida AS DOUBLE) END) AS top1_receita,
         max(CASE WHEN rank = 2 THEN CAST(receita_liquida AS DOUBLE) END) AS top2_receita,
         max(CASE WHEN rank = 3 THEN CAST(receita_liquida AS DOUBLE) END) AS top3_receita
  FROM topn GROUP BY cliente_id
),
m_agg AS (
  SELECT cliente_id, count(*) FILTER (WHERE comprado) AS categorias_compradas,
         {", ".join(f"max(CASE WHEN categoria = '{c}' THEN CAST(receita_liquida AS DOUBLE) END) AS mix_{c.lower()}" for c in MIX)}
  FROM mix_long GROUP BY cliente_id
),
s_agg AS (
  SELECT cliente_id, {", ".join(f"max(CASE WHEN nth = {i} THEN CAST(receita_liquida AS DOUBLE) END) AS sparkline_{i}" for i in range(1, 7))}
  FROM (SELECT *, row_number() OVER (PARTITION BY cliente_id ORDER BY mes_ref) AS nth FROM spark_long) GROUP BY cliente_id
)""", """
SELECT r.id AS cliente_id, r.nome, r.cluster_code, r.rec_liq, coalesce(m.categorias_compradas, 0) AS categorias_compradas,
       t.top1_nome, t.top2_nome, t.top3_nome, t.top1_receita, t.top2_receita, t.top3_receita,
       CAST(coalesce(t.n_top, 0) AS INTEGER) AS n_top, s.nome AS vendedor_nome, s.ating_rec_pct AS vendedor_ating_rec_pct,
       """ + ", ".join([f"sa.sparkline_{i}" for i in range(1, 7)] + [f"m.mix_{c.lower()}" for c in MIX]) + """
FROM rec r LEFT JOIN m_agg m ON r.id = m.cliente_id LEFT JOIN t_agg t ON r.id = t.cliente_id
LEFT JOIN s_agg sa ON r.id = sa.cliente_id LEFT JOIN srec s ON r.vendedor_id = s.id""")

SQL["client_categories"] = q("""
SELECT b.cliente_id, count(DISTINCT p.categoria) AS categorias_unicas
FROM billed b LEFT JOIN products p ON b.sku_id = p.sku_id WHERE b.cliente_id IS NOT NULL GROUP BY b.cliente_id""")

SQL["client_visits"] = q(CLIENT_ROLLUP, f"""
SELECT cliente_id, total_visitas, duracao_media_visita, visitas_planejadas, visitas_extra, visitas_com_pedido,
       {ts('ultima_visita')} AS ultima_visita,
       CAST(visitas_com_pedido AS DOUBLE) / CASE WHEN total_visitas = 0 THEN 1.0::DOUBLE ELSE CAST(total_visitas AS DOUBLE) END
         AS taxa_conversao_visitas
FROM client_vis""")

SQL["client_year_pivot"] = q(CLIENT_ROLLUP, """
SELECT cliente_id, """ + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN year(data_pedido) = {y} THEN receita_liquida END), 0) AS DOUBLE) AS receita_{y}"
    for y in range(1995, 2002)) + """
FROM billed WHERE cliente_id IS NOT NULL GROUP BY cliente_id""")

SQL["potential_city_channel"] = q("""
SELECT cidade, canal, CAST(sum(mercado_estimado_mensal) AS DOUBLE) AS mercado_estimado_mensal
FROM potential WHERE cidade IS NOT NULL AND canal IS NOT NULL GROUP BY cidade, canal""")

SQL["potential_state"] = q("""
SELECT uf, CAST(sum(mercado_estimado_mensal) * {MONTHS} AS DOUBLE) AS potencial_total
FROM potential WHERE uf IS NOT NULL GROUP BY uf""")

SQL["cluster_profile"] = q(CLIENT_ROLLUP, LABELS, f"""
SELECT cluster_raw, n, rec_liq_med, CAST(rec_liq_sum AS DOUBLE) AS rec_liq_sum, pedidos_med, recencia_med,
       {r6('margem_pct_med')} AS margem_pct_med, {r6('desconto_pct_med')} AS desconto_pct_med, skus_med,
       {r6('checkouts_med')} AS checkouts_med, {r6('area_med')} AS area_med,
       {r6('conversao_visitas_med')} AS conversao_visitas_med
FROM prof""")

SQL["cluster_summary"] = q(CLIENT_ROLLUP, LABELS, SUMMARY, "SELECT * FROM summary")

SQL["cluster_distributions"] = q(f"""
SELECT cluster_raw, dimensao, valor, count(*) AS n FROM (
  SELECT {TIER} AS cluster_raw, 'canal' AS dimensao, canal AS valor FROM clients
  UNION ALL SELECT {TIER}, 'porte', porte FROM clients
  UNION ALL SELECT {TIER}, 'regiao_comercial', regiao_comercial FROM clients
) WHERE valor IS NOT NULL GROUP BY cluster_raw, dimensao, valor""")

SQL["seller_sales"] = q("""
SELECT vendedor_id, CAST(sum(receita_liquida) AS DOUBLE) AS receita_total, CAST(sum(margem_contribuicao) AS DOUBLE) AS margem_total,
       count(DISTINCT pedido_id) AS pedidos_total, sum(quantidade) AS itens_total, count(DISTINCT cliente_id) AS clientes_atendidos,
       CAST(sum(desconto) AS DOUBLE) AS desconto_total, CAST(sum(receita_bruta) AS DOUBLE) AS receita_bruta
FROM billed WHERE vendedor_id IS NOT NULL GROUP BY vendedor_id""")

SQL["seller_visits"] = q(SELLER, """
SELECT vendedor_id, total_visitas, visitas_com_pedido, duracao_media, checkin_ok_pct,
       CAST(visitas_com_pedido AS DOUBLE) / CASE WHEN total_visitas = 0 THEN 1.0::DOUBLE ELSE CAST(total_visitas AS DOUBLE) END
         AS conversao_visitas_pct
FROM s_vis""")

SQL["sku_sales"] = q(SKU, """
SELECT sku_id, CAST(receita_total AS DOUBLE) AS receita_total, quantidade_total, volume_kg_total,
       CAST(margem_total AS DOUBLE) AS margem_total, CAST(desconto_total AS DOUBLE) AS desconto_total,
       pedidos_total, clientes_atendidos
FROM k_sales""")

SQL["visit_duration_curve"] = q(CURVE, "SELECT * FROM curve")

SQL["visit_conversion_pivot"] = q(CURVE, f"""
SELECT l.duracao_faixa, l.ordem,
       coalesce(max(CASE WHEN c.tipo_visita = 'Planejada' THEN {rhu('c.taxa_conversao * 100', 1)} END), 0.0) AS planejada_pct,
       coalesce(max(CASE WHEN c.tipo_visita = 'Extra-rota' THEN {rhu('c.taxa_conversao * 100', 1)} END), 0.0) AS extra_rota_pct
FROM {DUR_LABELS} LEFT JOIN curve c ON c.duracao_faixa = l.duracao_faixa
GROUP BY l.duracao_faixa, l.ordem""")

SQL["discount_margin_curve"] = q(f"""
dband AS (SELECT *, {DISC_CASE} AS faixa_desconto FROM billed),
dagg AS (SELECT faixa_desconto, count(pedido_id) AS total_itens, sum(receita_liquida) AS receita_liquida,
                sum(desconto) AS desconto_total, sum(margem_contribuicao) AS margem_total
         FROM dband WHERE faixa_desconto IS NOT NULL GROUP BY faixa_desconto)""", f"""
SELECT l.faixa_desconto, l.ordem, coalesce(d.total_itens, 0) AS total_itens,
       CAST(coalesce(d.receita_liquida, 0) AS DOUBLE) AS receita_liquida,
       CAST(coalesce(d.desconto_total, 0) AS DOUBLE) AS desconto_total,
       CAST(coalesce(d.margem_total, 0) AS DOUBLE) AS margem_total,
       CASE WHEN coalesce(d.receita_liquida, 0) > 0 THEN CAST(d.margem_total AS DOUBLE) / CAST(d.receita_liquida AS DOUBLE) ELSE 0.0 END AS margem_pct
FROM {DISC_LABELS} LEFT JOIN dagg d ON d.faixa_desconto = l.faixa_desconto""")

SQL["geo_performance"] = q("""
gagg AS (
  SELECT c.uf, c.regiao_comercial, sum(b.receita_liquida) AS receita_liquida, sum(b.margem_contribuicao) AS margem_contribuicao,
         count(DISTINCT b.cliente_id) AS clientes_atendidos, count(DISTINCT b.pedido_id) AS pedidos_total
  FROM billed b LEFT JOIN clients c ON b.cliente_id = c.cliente_id
  WHERE c.uf IS NOT NULL AND c.regiao_comercial IS NOT NULL GROUP BY c.uf, c.regiao_comercial
),
puf AS (SELECT uf, sum(mercado_estimado_mensal) * {MONTHS} AS potencial_total FROM potential WHERE uf IS NOT NULL GROUP BY uf)""", """
SELECT g.uf, g.regiao_comercial, CAST(g.receita_liquida AS DOUBLE) AS receita_liquida,
       CAST(g.margem_contribuicao AS DOUBLE) AS margem_contribuicao, g.clientes_atendidos, g.pedidos_total,
       CASE WHEN g.receita_liquida <> 0 THEN CAST(g.margem_contribuicao AS DOUBLE) / CAST(g.receita_liquida AS DOUBLE) END AS margem_pct,
       CAST(coalesce(p.potencial_total, 0) AS DOUBLE) AS potencial_total,
       CASE WHEN coalesce(p.potencial_total, 0) > 0 THEN CAST(g.receita_liquida AS DOUBLE) / CAST(p.potencial_total AS DOUBLE) ELSE 0.0 END AS share_pct
FROM gagg g LEFT JOIN puf p ON g.uf = p.uf""")

SQL["category_cooccurrence"] = q(SWP, """
oc AS (SELECT DISTINCT pedido_id, categoria FROM swp WHERE pedido_id IS NOT NULL AND categoria IS NOT NULL),
pairs AS (SELECT a.categoria AS base, b.categoria AS other, count(*) AS n FROM oc a JOIN oc b ON a.pedido_id = b.pedido_id
          GROUP BY a.categoria, b.categoria),
basen AS (SELECT base, n AS n_pedidos_base FROM pairs WHERE base = other)""", """
SELECT x.base, y.base AS other, coalesce(p.n, 0) AS n_pedidos_ambos, x.n_pedidos_base,
       100.0::DOUBLE * CAST(coalesce(p.n, 0) AS DOUBLE) / CAST(x.n_pedidos_base AS DOUBLE) AS pct
FROM basen x CROSS JOIN basen y LEFT JOIN pairs p ON p.base = x.base AND p.other = y.base""")

SQL["kpis_global"] = q(f"""
s AS (SELECT sum(receita_liquida) AS rl, sum(receita_bruta) AS rb, sum(desconto) AS dt, sum(margem_contribuicao) AS mt,
             count(DISTINCT pedido_id) AS total_pedidos, count(DISTINCT cliente_id) AS total_clientes_ativos FROM billed),
c AS (SELECT count(*) AS total_clientes_base FROM clients),
v AS (SELECT count(*) AS total_visitas, count(*) FILTER (WHERE resultado_visita = 'Pedido') AS conv FROM visits)""", f"""
SELECT {rmoney('rl')} AS receita_liquida_total, {rmoney('rb')} AS receita_bruta_total, {rmoney('dt')} AS desconto_total,
       {rmoney('mt')} AS margem_total,
       {rhu('(CASE WHEN rl <> 0 THEN CAST(mt AS DOUBLE) / CAST(rl AS DOUBLE) END) * 100', 2)} AS margem_pct_media,
       {rhu('(CASE WHEN rb <> 0 THEN CAST(dt AS DOUBLE) / CAST(rb AS DOUBLE) END) * 100', 2)} AS desconto_pct_medio,
       total_pedidos,
       {rhu('CASE WHEN total_pedidos <> 0 THEN CAST(rl AS DOUBLE) / CAST(total_pedidos AS DOUBLE) END', 2)} AS ticket_medio,
       total_clientes_base, total_clientes_ativos,
       {rhu('(CASE WHEN total_clientes_base <> 0 THEN CAST(total_clientes_ativos AS DOUBLE) / CAST(total_clientes_base AS DOUBLE) END) * 100', 1)} AS taxa_ativacao_pdvs,
       total_visitas,
       {rhu('(CASE WHEN total_visitas <> 0 THEN CAST(conv AS DOUBLE) / CAST(total_visitas AS DOUBLE) END) * 100', 1)} AS taxa_conversao_visitas
FROM s, c, v""")

KPI_ROW = """
SELECT {extra}CAST(coalesce(rec, 0) AS DOUBLE) AS receita_liquida, CAST(coalesce(bruta, 0) AS DOUBLE) AS receita_bruta,
       CAST(coalesce(des, 0) AS DOUBLE) AS desconto_total, CAST(coalesce(marg, 0) AS DOUBLE) AS margem_total,
       pedidos, ativos, clientes,
       (CASE WHEN rec > 0 THEN CAST(marg AS DOUBLE) / CAST(rec AS DOUBLE) ELSE 0.0 END) * 100 AS margem_pct,
       (CASE WHEN bruta > 0 THEN CAST(des AS DOUBLE) / CAST(bruta AS DOUBLE) ELSE 0.0 END) * 100 AS desconto_pct,
       CASE WHEN pedidos > 0 THEN CAST(rec AS DOUBLE) / CAST(pedidos AS DOUBLE) ELSE 0.0 END AS ticket_medio,
       (CASE WHEN clientes > 0 THEN CAST(ativos AS DOUBLE) / CAST(clientes AS DOUBLE) ELSE 0.0 END) * 100 AS taxa_ativacao
FROM f"""
SQL["kpis_filtered"] = q(CLIENT_ROLLUP, """
f AS (SELECT sum(receita_liquida) AS rec, sum(receita_bruta) AS bruta, sum(desconto_total) AS des, sum(margem_total) AS marg,
             CAST(coalesce(sum(total_pedidos), 0) AS BIGINT) AS pedidos,
             count(*) FILTER (WHERE receita_liquida > 0) AS ativos, count(*) AS clientes
      FROM master WHERE regiao_comercial = 'AMERICA' AND porte = 'G')""", KPI_ROW.format(extra=""))

CUBE_DIMS = ("canal", "uf", "regiao_comercial", "porte", "cluster_raw", "vendedor_id")
SQL["filter_cube"] = q(CLIENT_ROLLUP, f"ml AS (SELECT *, {TIER} AS cluster_raw FROM master)", f"""
SELECT CAST(grouping_id({', '.join(CUBE_DIMS)}) AS BIGINT) AS conjunto,
       {', '.join(f'CAST({d} AS VARCHAR) AS {d}' for d in CUBE_DIMS)},
       CAST(sum(receita_liquida) AS DOUBLE) AS rec, CAST(sum(receita_bruta) AS DOUBLE) AS bruta,
       CAST(sum(desconto_total) AS DOUBLE) AS "desc", CAST(sum(margem_total) AS DOUBLE) AS marg,
       CAST(sum(total_pedidos) AS BIGINT) AS pedidos, count(*) FILTER (WHERE receita_liquida > 0) AS ativos, count(*) AS clientes
FROM ml GROUP BY CUBE ({', '.join(CUBE_DIMS)})""")

SELECTIONS = (
    "true",
    "canal = 'HOUSEHOLD'",
    "regiao_comercial = 'AMERICA' AND porte = 'G'",
    "cluster_raw = 2 AND vendedor_id = 7",
    "canal = 'BUILDING' AND regiao_comercial = 'ASIA' AND porte = 'M' AND cluster_raw = 3",
    "canal = 'MACHINERY' AND uf = 'NATION_12' AND regiao_comercial = 'EUROPE' AND porte = 'P' AND cluster_raw = 1 AND vendedor_id = 3",
    "canal = 'NONE SUCH'",
)
SQL["cube_selections"] = q(CLIENT_ROLLUP, f"ml AS (SELECT *, {TIER} AS cluster_raw FROM master)", "f AS (" + " UNION ALL ".join(f"""
SELECT CAST({i} AS INTEGER) AS selecao, sum(receita_liquida) AS rec, sum(receita_bruta) AS bruta, sum(desconto_total) AS des,
       sum(margem_total) AS marg, CAST(coalesce(sum(total_pedidos), 0) AS BIGINT) AS pedidos,
       count(*) FILTER (WHERE receita_liquida > 0) AS ativos, count(*) AS clientes FROM ml WHERE {cond}""" for i, cond in enumerate(SELECTIONS)) + ")", KPI_ROW.format(extra="selecao, "))

SQL["distinct_from_bitmaps"] = q("bc AS (SELECT b.*, c.uf FROM billed b LEFT JOIN clients c ON b.cliente_id = c.cliente_id)", """
SELECT 'mes_ref' AS nivel, mes_ref AS chave, count(DISTINCT pedido_id) AS pedidos, count(DISTINCT cliente_id) AS clientes FROM bc GROUP BY mes_ref
UNION ALL SELECT 'uf', uf, count(DISTINCT pedido_id), count(DISTINCT cliente_id) FROM bc GROUP BY uf
UNION ALL SELECT 'total', 'total', count(DISTINCT pedido_id), count(DISTINCT cliente_id) FROM bc""")

SQL["cluster_cards"] = q(CLIENT_ROLLUP, f"""
ml AS (SELECT *, {TIER} AS cluster_raw FROM master),
fl AS (SELECT * FROM ml WHERE canal = 'MACHINERY'),
per AS (SELECT cluster_raw, count(*) AS n_clientes, sum(receita_liquida) AS receita_liquida FROM fl GROUP BY cluster_raw),
nf AS (SELECT count(*) AS nf FROM fl)""", """
SELECT k.cluster_raw, coalesce(p.n_clientes, 0) AS n_clientes,
       (CASE WHEN nf > 0 THEN CAST(coalesce(p.n_clientes, 0) AS DOUBLE) / CAST(nf AS DOUBLE) ELSE 0.0 END) * 100 AS pct_filtro,
       CAST(coalesce(p.receita_liquida, 0) AS DOUBLE) AS receita_liquida
FROM (SELECT DISTINCT cluster_raw FROM ml) k LEFT JOIN per p ON k.cluster_raw = p.cluster_raw CROSS JOIN nf""")

SQL["channel_cluster_crosstab"] = q(
    "SELECT canal, "
    + ", ".join(f"count(*) FILTER (WHERE {TIER} = {i}) AS cluster_{i}" for i in range(5))
    + " FROM clients WHERE canal IS NOT NULL GROUP BY canal"
)

SQL["seller_profile_counts"] = q(SELLER, "SELECT perfil_vendedor, count(*) AS n FROM smaster GROUP BY perfil_vendedor")

SQL["sink_published"] = q(SELLER, """
SELECT 'temporal' AS secao, mes_ref AS chave, count(DISTINCT pedido_id) AS n FROM billed WHERE mes_ref IS NOT NULL GROUP BY mes_ref
UNION ALL SELECT 'perfis_vendedores', perfil_vendedor, count(*) FROM smaster GROUP BY perfil_vendedor""")

SQL["abc_class_counts"] = q(SKU, f"""
SELECT l.curva_abc, coalesce(c.n, 0) AS n
FROM {ABC_LABELS} LEFT JOIN (SELECT curva_abc, count(*) AS n FROM kabc GROUP BY curva_abc) c ON l.curva_abc = c.curva_abc""")

SQL["category_revenue"] = q(SKU, """
SELECT categoria, CAST(sum(receita_total) AS DOUBLE) AS receita_total FROM kmaster WHERE categoria IS NOT NULL GROUP BY categoria""")

SQL["abc_curve"] = q(SKU, """
SELECT sku_id, CAST(receita_total AS DOUBLE) AS receita_total, CAST(receita_cum AS DOUBLE) AS receita_cum, receita_cum_pct, curva_abc
FROM kabc""")

SQL["client_top_skus"] = q(TOP, "SELECT cliente_id, sku_id, CAST(receita_liquida AS DOUBLE) AS receita_liquida, CAST(rank AS INTEGER) AS rank FROM top")

SQL["recent_months"] = q("SELECT DISTINCT mes_ref FROM billed WHERE mes_ref IS NOT NULL ORDER BY mes_ref DESC LIMIT 6")

SQL["client_sparkline"] = q(SPARK_LONG, "SELECT cliente_id, mes_ref, CAST(receita_liquida AS DOUBLE) AS receita_liquida FROM spark_long")

SQL["client_category_mix"] = q(SWP, MIX_LONG, """
SELECT cliente_id, categoria, CAST(receita_liquida AS DOUBLE) AS receita_liquida, barra_pct, comprado FROM mix_long""")

SQL["sorted_page"] = q(CLIENT_ROLLUP, LABELS, REC, """
pg AS (SELECT id, nome, canal, uf, rec_liq, margem_pct, pedidos FROM rec WHERE canal = 'BUILDING'
       ORDER BY rec_liq DESC, id ASC LIMIT 15 OFFSET 15),
tot AS (SELECT count(*) AS total_linhas FROM rec WHERE canal = 'BUILDING')""", """
SELECT pg.*, total_linhas, greatest(1, CAST(ceil(CAST(total_linhas AS DOUBLE) / 15) AS BIGINT)) AS total_paginas FROM pg, tot""")

SQL["deep_pages"] = q(CLIENT_ROLLUP, LABELS, REC, """
nth AS (SELECT id, nome, canal, uf, rec_liq, margem_pct, pedidos, row_number() OVER (ORDER BY rec_liq DESC, id ASC) - 1 AS i,
               count(*) OVER () AS total_linhas FROM rec),
pg AS (SELECT * EXCLUDE (i), CAST(i // 15 + 1 AS BIGINT) AS pagina, CAST((total_linhas + 14) // 15 AS BIGINT) AS total_paginas FROM nth)""", """
SELECT * FROM pg WHERE pagina IN (1, (total_paginas + 1) // 2, total_paginas)""")

SQL["first_n_products"] = q(SKU, KREC, f"""
SELECT sku_id, nome, categoria, rec_total, curva_abc FROM krec
WHERE {' OR '.join(contains(c, 'ring') for c in ('nome', 'sku_id', 'categoria'))}
ORDER BY rec_total DESC, sku_id LIMIT 50""")

SQL["cluster_ranking"] = q(CLIENT_ROLLUP, LABELS, """
SELECT cluster_raw,
       CAST(row_number() OVER (ORDER BY rec_liq_med DESC NULLS LAST, cluster_raw) AS INTEGER) AS rank_receita,
       CAST(row_number() OVER (ORDER BY recencia_med DESC NULLS LAST, cluster_raw) AS INTEGER) AS rank_recencia,
       CAST(row_number() OVER (ORDER BY checkouts_med DESC NULLS LAST, cluster_raw) AS INTEGER) AS rank_checkouts,
       CAST(row_number() OVER (ORDER BY desconto_pct_med DESC NULLS LAST, cluster_raw) AS INTEGER) AS rank_desconto
FROM prof""")

SQL["safe_ratio"] = q(CLIENT_ROLLUP, "SELECT cliente_id, margem_pct, desconto_pct, ticket_medio FROM master")
SQL["recency_days"] = q(CLIENT_ROLLUP, f"SELECT cliente_id, {ts('ultima_compra')} AS ultima_compra, recencia_dias FROM master")
SQL["yoy_growth"] = q(CLIENT_ROLLUP, """
SELECT cliente_id, CAST(receita_1999 AS DOUBLE) AS receita_1999, CAST(receita_2000 AS DOUBLE) AS receita_2000, crescimento_yoy FROM master""")

SQL["seller_attainment"] = q(SELLER, """
SELECT vendedor_id, CAST(meta_receita_periodo AS DOUBLE) AS meta_receita_periodo, atingimento_receita_pct, margem_realizada_pct,
       atingimento_margem_pct, visitas_mes_realizadas, aproveitamento_capacidade_visitas FROM smaster""")
SQL["seller_quadrant"] = q(SELLER, "SELECT vendedor_id, perfil_vendedor FROM smaster")

SQL["band"] = q(f"SELECT visita_id, duracao_min, {DURATION_CASE} AS duracao_faixa FROM visits")

SQL["discount_rate"] = q(f"SELECT pedido_id, sku_id, vendedor_id, {DISC_RATE} AS taxa_desconto, {DISC_CASE} AS faixa_desconto FROM billed")

SQL["fill_defaults"] = q("""
cs AS (SELECT cliente_id, sum(receita_liquida) AS receita_liquida, count(DISTINCT pedido_id) AS total_pedidos,
              count(DISTINCT sku_id) AS skus_unicos, max(data_pedido) AS ultima_compra
       FROM billed WHERE cliente_id IS NOT NULL GROUP BY cliente_id)""", """
SELECT c.cliente_id, CAST(coalesce(s.receita_liquida, 0) AS DOUBLE) AS receita_liquida, coalesce(s.total_pedidos, 0) AS total_pedidos,
       coalesce(s.skus_unicos, 0) AS skus_unicos,
       coalesce(CAST(floor((epoch((SELECT max(o_orderdate) FROM orders)) - epoch(s.ultima_compra)) / 86400) AS BIGINT), 999) AS recencia_dias,
       coalesce(c.n_checkouts, 1.0) AS n_checkouts, coalesce(c.area_loja_m2, 30.0) AS area_loja_m2
FROM clients c LEFT JOIN cs s ON c.cliente_id = s.cliente_id""")

SQL["month_year_parts"] = q("SELECT DISTINCT pedido_id, CAST(year(data_pedido) AS INTEGER) AS ano, mes_ref FROM billed")

SQL["radar_scores"] = q(CLIENT_ROLLUP, LABELS, SUMMARY, """
SELECT cluster_raw, cluster_code,
       least(100.0::DOUBLE, ticket_med / 1200.0::DOUBLE * 100.0::DOUBLE) AS score_ticket,
       least(100.0::DOUBLE, pedidos_med / 35.0::DOUBLE * 100.0::DOUBLE) AS score_frequencia,
       greatest(0.0::DOUBLE, 100.0::DOUBLE - recencia_med / 300.0::DOUBLE * 100.0::DOUBLE) AS score_recencia,
       least(100.0::DOUBLE, margem_pct_med / 30.0::DOUBLE * 100.0::DOUBLE) AS score_margem,
       least(100.0::DOUBLE, skus_med / 25.0::DOUBLE * 100.0::DOUBLE) AS score_mix,
       least(100.0::DOUBLE, checkouts_med / 6.0::DOUBLE * 100.0::DOUBLE) AS score_porte
FROM summary""")


def _fill(template: str, slots: dict[str, str]) -> str:
    import re

    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(sq(template[pos : m.start()]))
        parts.append(f"coalesce(CAST({slots[m.group(1)]} AS VARCHAR), '')")
        pos = m.end()
    if pos < len(template):
        parts.append(sq(template[pos:]))
    return " || ".join(parts)


_SLOTS = {
    "rec_liq": "CAST(rec_liq AS DECIMAL(38,2))",
    "skus": "skus",
    "checkouts": "checkouts",
    "area_m2": "area_m2",
    "recencia_dias": "recencia_dias",
    "status": "status",
    "desconto_pct": "CAST(desconto_pct AS DECIMAL(38,2))",
    "margem_pct": "CAST(margem_pct AS DECIMAL(38,2))",
}
_ACTION_CASE = "CASE " + " ".join(f"WHEN cluster_code = {sq(c)} THEN {_fill(t, _SLOTS)}" for c, t in P.ACTION_TEXTS.items()) + " END"

SQL["recommended_action"] = q(CLIENT_ROLLUP, LABELS, REC, f"SELECT id, cluster_code, {_ACTION_CASE} AS acao_recomendada FROM rec")

SQL["margin_status"] = q(CLIENT_ROLLUP, LABELS, REC, """
SELECT id, margem_pct, CASE WHEN margem_pct >= 25.0 THEN 'good' WHEN margem_pct >= 20.0 THEN 'warn' ELSE 'bad' END AS status_margem FROM rec""")

SQL["seller_light"] = q(SELLER, SREC, """
SELECT id, ating_rec_pct, margem_pct, meta_margem_pct,
       CASE WHEN ating_rec_pct >= 100 AND margem_pct >= meta_margem_pct THEN 'green' WHEN ating_rec_pct >= 100 THEN 'amber' ELSE 'red' END AS cor
FROM srec""")

SQL["client_features"] = q(CLIENT_ROLLUP, STD, "SELECT cliente_id, " + ", ".join(f"{r6(c)} AS {c}" for c in FEATS) + " FROM feat")

SQL["standardize"] = q(
    CLIENT_ROLLUP,
    STD,
    "st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATS) + " FROM feat)",
    "SELECT cliente_id, "
    + ", ".join(f"{r6(f'CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END')} AS {c}" for c in FEATS)
    + " FROM feat, st",
)

ST = "st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATS) + " FROM feat)"
Z = {c: f"CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END" for c in FEATS}

_STARTS = " UNION ALL ".join(
    f"(SELECT {r} AS r, list(v ORDER BY key) AS cs FROM (SELECT v, substr(h || h, {3 * r % 64 + 1}, 64) AS key FROM x ORDER BY key, v LIMIT 5))"
    for r in range(20)
)
_AWAY = "list_transform(cs, lambda q: CAST(list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT))"
_SUMS = ", ".join(f"CAST(sum(v[{d + 1}]) AS BIGINT)" for d in range(len(FEATS)))
KMEANS = f"""
x AS MATERIALIZED (SELECT cliente_id, sha256('42:' || cliente_id) AS h,
                   [{", ".join(f"CAST(CAST({rhu(Z[c], 4)} AS DECIMAL(18,4)) * 10000 AS BIGINT)" for c in FEATS)}] AS v FROM feat, st),
starts AS MATERIALIZED ({_STARTS}),
lloyd AS (
  SELECT 0 AS it, r, cs, true AS moves FROM starts
  UNION ALL
  SELECT it + 1, r, new, list_sum(list_transform(list_zip(flatten(new), flatten(cs)), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) > 10000 FROM (
    SELECT it, r, cs, list_transform(range(1, len(cs) + 1), lambda c: coalesce(map_from_entries(list((c_, m)))[c], cs[c])) AS new
    FROM (SELECT it, r, cs, c_, list_transform(s, lambda t: (((2 * t + 100 * n) - ((((2 * t + 100 * n) % (200 * n)) + 200 * n) % (200 * n))) // (200 * n)) * 100) AS m
          FROM (SELECT it, r, cs, list_position(ds, list_min(ds)) AS c_, count(*) AS n, [{_SUMS}] AS s
                FROM (SELECT it, r, cs, v, {_AWAY} AS ds FROM lloyd, x WHERE it < 100 AND moves) GROUP BY it, r, cs, list_position(ds, list_min(ds))))
    GROUP BY it, r, cs)
),
ends AS (SELECT r, arg_max(cs, it) AS cs FROM lloyd GROUP BY r),
costs AS (SELECT r, cs, sum(list_min(ds)) AS cost FROM (SELECT r, cs, {_AWAY} AS ds FROM ends, x) GROUP BY r, cs),
best AS (SELECT cs FROM costs ORDER BY cost, r LIMIT 1)"""
SQL["kmeans_segments"] = q(CLIENT_ROLLUP, STD, ST, KMEANS, f"""
SELECT cliente_id, CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS cluster_raw FROM (SELECT cliente_id, {_AWAY} AS ds FROM x, best)
""").replace("WITH", "WITH RECURSIVE", 1)


def _axis(n: int) -> str:
    """One eigenvector ``a<n>`` (i, x) of ``c<n>`` (i, j, x) by repeated squaring, and the deflated ``c<n + 1>``."""
    out, last = "", f"c{n}"
    for s in range(16):
        new = f"p{n}_{s}"
        out += f"""
{new} AS MATERIALIZED (SELECT a.i, b.j, sum(a.x / t * b.x / t) AS x
  FROM {last} a JOIN {last} b ON a.j = b.i, (SELECT sum(x) AS t FROM {last} WHERE i = j) GROUP BY a.i, b.j),"""
        last = new
    return out + f"""
u{n} AS MATERIALIZED (SELECT i, x FROM {last} WHERE j = (SELECT arg_max(i, x) FROM {last} WHERE i = j)),
a{n} AS MATERIALIZED (SELECT i, x / (SELECT sqrt(sum(x * x)) * sign(arg_max(x, abs(x))) FROM u{n}) AS x FROM u{n}),
c{n + 1} AS MATERIALIZED (SELECT i, j, c.x - (SELECT sum(p.x * c.x * q.x) FROM c{n} c JOIN a{n} p USING (i) JOIN a{n} q ON q.i = c.j) * p.x * q.x AS x
  FROM c{n} c JOIN a{n} p USING (i) JOIN a{n} q ON q.i = c.j)"""


SQL["pca_2d"] = q(CLIENT_ROLLUP, STD, ST, "z AS MATERIALIZED (SELECT cliente_id, [" + ", ".join(Z[c] for c in FEATS) + "] AS v FROM feat, st)", f"""
z6 AS (SELECT [{", ".join(r6(f"v[{d + 1}]") for d in range(len(FEATS)))}] AS v FROM z),
ij AS (SELECT i, j FROM range(1, {len(FEATS) + 1}) a(i), range(1, {len(FEATS) + 1}) b(j)),
c1 AS MATERIALIZED (SELECT i, j, CAST(sum(CAST(CAST(v[i] AS DECIMAL(18,6)) * CAST(v[j] AS DECIMAL(18,6)) AS DECIMAL(38,12))) AS DOUBLE) AS x
  FROM z6, ij GROUP BY i, j)""", _axis(1), _axis(2), f"""
SELECT cliente_id, {", ".join(f"round(list_sum(list_transform(list_zip(v, (SELECT list(x ORDER BY i) FROM a{n})), lambda p: p[1] * p[2])), 3) + 0.0 AS {name}" for n, name in ((1, "pca_x"), (2, "pca_y")))}
FROM z""")

SQL["segment_roles"] = q(CLIENT_ROLLUP, LABELS, "SELECT cluster_raw, cluster_code, cluster_nome, cluster_tag, cluster_desc, prioridade FROM roles")
SQL["segment_labels"] = q(CLIENT_ROLLUP, LABELS, "SELECT cliente_id, cluster_raw, cluster_code, cluster_nome, cluster_tag FROM labelled")

_GRID = " CROSS JOIN ".join(
    f"(SELECT unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in vals)}]) AS {lever})"
    for lever, vals in (
        ("corte_desconto_pp", (0.0, 0.5, 1.0)),
        ("reativacao_pct", (0.0, 15.0, 30.0)),
        ("cross_sell_pct", (0.0, 12.0)),
        ("ganho_conversao_pct", (0.0, 5.0)),
    )
)
SQL["scenario_sweep"] = q(CLIENT_ROLLUP, LABELS, f"""
base AS (SELECT CAST(sum(receita_bruta) AS DOUBLE) AS g, CAST(sum(receita_liquida) AS DOUBLE) AS r,
                CAST(sum(margem_total) AS DOUBLE) AS m,
                CAST(count(*) FILTER (WHERE total_pedidos = 0) AS DOUBLE) AS inativos,
                CAST(coalesce(sum(receita_liquida) FILTER (WHERE cluster_code = 'C2_HIGH_POTENTIAL'), 0) AS DOUBLE) AS rap
         FROM labelled),
grid AS (SELECT * FROM {_GRID}),
calc AS (
  SELECT grid.*, base.*,
         g * (corte_desconto_pp / 100.0::DOUBLE) AS ganho_desc,
         inativos * (reativacao_pct / 100.0::DOUBLE) * 4800.0::DOUBLE AS rec_churn,
         rap * (cross_sell_pct / 100.0::DOUBLE) AS rec_cross,
         (ganho_conversao_pct / 100.0::DOUBLE) * (r * 0.04::DOUBLE) AS rec_rotas
  FROM grid, base
),
calc2 AS (
  SELECT *, rec_churn + rec_cross + rec_rotas AS receita_incremental,
         ganho_desc + rec_churn * 0.25::DOUBLE + rec_cross * 0.255::DOUBLE + rec_rotas * 0.25::DOUBLE AS margem_incremental
  FROM calc
)""", f"""
SELECT corte_desconto_pp, reativacao_pct, cross_sell_pct, ganho_conversao_pct,
       {r6('receita_incremental')} AS receita_incremental, {r6('margem_incremental')} AS margem_incremental,
       {r6('(CASE WHEN r <> 0 THEN receita_incremental / r END) * 100.0::DOUBLE')} AS receita_incremental_pct,
       {r6('(CASE WHEN r + receita_incremental <> 0 THEN (m + margem_incremental) / (r + receita_incremental) END) * 100.0::DOUBLE')} AS nova_margem_pct,
       {r6('(CASE WHEN r + receita_incremental <> 0 THEN (m + margem_incremental) / (r + receita_incremental) END) * 100.0::DOUBLE - (CASE WHEN r <> 0 THEN m / r END) * 100.0::DOUBLE')} AS delta_margem_pp
FROM calc2""")

SQL["client_sales"] = q(
    f"""
SELECT cliente_id,
       CAST(sum(receita_bruta) AS DOUBLE) AS receita_bruta, CAST(sum(receita_liquida) AS DOUBLE) AS receita_liquida,
       CAST(sum(desconto) AS DOUBLE) AS desconto_total, CAST(sum(custo_total) AS DOUBLE) AS custo_total,
       CAST(sum(margem_contribuicao) AS DOUBLE) AS margem_total, count(DISTINCT pedido_id) AS total_pedidos,
       sum(quantidade) AS total_itens, sum(volume_kg) AS volume_total_kg,
       {ts('min(data_pedido)')} AS primeira_compra, {ts('max(data_pedido)')} AS ultima_compra,
       count(DISTINCT sku_id) AS skus_unicos
FROM billed WHERE cliente_id IS NOT NULL GROUP BY cliente_id
"""
)

SQL["client_sales_state"] = SQL["client_sales"]

SQL["client_master"] = q(
    CLIENT_ROLLUP,
    f"""
SELECT cliente_id, nome_cliente_ficticio, canal, porte, cidade, uf, regiao_comercial, vendedor_id,
       n_checkouts, area_loja_m2, faixa_faturamento_pdv, {ts('data_cadastro')} AS data_cadastro, status_cliente,
       CAST(receita_bruta AS DOUBLE) AS receita_bruta, CAST(receita_liquida AS DOUBLE) AS receita_liquida,
       CAST(desconto_total AS DOUBLE) AS desconto_total, CAST(custo_total AS DOUBLE) AS custo_total,
       CAST(margem_total AS DOUBLE) AS margem_total, total_pedidos, total_itens, volume_total_kg,
       {ts('primeira_compra')} AS primeira_compra, {ts('ultima_compra')} AS ultima_compra,
       skus_unicos, categorias_unicas,
       CAST(receita_1999 AS DOUBLE) AS receita_1999, CAST(receita_2000 AS DOUBLE) AS receita_2000,
       total_visitas, duracao_media_visita, visitas_planejadas, visitas_extra, visitas_com_pedido,
       {ts('ultima_visita')} AS ultima_visita, taxa_conversao_visitas,
       CAST(potencial_mercado_cidade_canal_mensal AS DOUBLE) AS potencial_mercado_cidade_canal_mensal,
       margem_pct, desconto_pct, ticket_medio, recencia_dias, crescimento_yoy
FROM master
""",
)
