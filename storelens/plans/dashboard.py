"""End-to-end batch build: all result sections of the commercial model, written as JSON folders.

Stages (each a Spark job graph; nothing is assembled on the driver):

1. the billed fact and the client master are written once as parquet under
   the shared checkpoint folder (``spark.checkpoint.dir``) and read back, which
   cuts lineage (a lost executor re-reads files instead of re-running joins)
   and lets every later section scan a pruned, already-joined table;
2. features → standardisation → K-Means restarts → PCA on the client master;
3. profile → greedy roles → labels, then every section;
4. each section is written by the executors to a build folder of its own; one
   manifest then publishes them together (``sinks.publish_sections``), so a
   reader of ``<out>`` never sees half a build.

Usage: ``python -m storelens.plans.dashboard <sf_dir> <out_dir> [--restarts N]``
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from .. import params as P
from ..functions import exprs as X
from ..operators import clustering as L
from ..operators import curves as C
from ..operators import explore as E
from ..operators import masters as M
from ..operators import ranking as K
from ..operators import rollups as R
from ..operators import segmentation as G
from ..session import apply_unset, cut_lineage, scale_conf, shared_scope, write_shared
from ..sources import sinks
from ..sources.binding import RetailModel, bind_test_tables
from .output import as_output


def build_sections(m: RetailModel, restarts: int = P.KMEANS_RESTARTS, k: int = P.N_CLUSTERS) -> dict[str, DataFrame]:
    hz = m.horizon
    # unpartitioned: every section reads all months, and a month partitioning
    # would make each writing task emit up to one file per month
    billed = write_shared(R.billed_sales(m.sales, hz.billed_status), "billed")
    master = write_shared(M.client_master(m.clients, billed, m.products, m.visits, m.potential, hz), "client_master")

    scaled = G.standardize(G.client_features(master))
    labels, _ = L.lloyd_segments(scaled, k=k, restarts=restarts)
    coords = G.pca_2d(scaled)
    lm = write_shared(master.join(labels, "cliente_id", "left").join(coords, "cliente_id", "left"), "client_segmented")
    roles = G.segment_roles(G.cluster_profile(lm))
    labelled = G.segment_labels(lm, roles)

    swp = R.sales_with_product(billed, m.products)
    # top SKUs, category mix and sparkline all sum net revenue at a grain
    # coarser than (client, SKU, month): aggregate the fact to it once
    hist = cut_lineage(R.client_sku_month(billed))
    seller = M.seller_master(m.sellers, billed, m.visits, hz)
    skus = K.abc_curve(M.sku_master(m.products, billed, hz))
    summary = G.cluster_summary(labelled)
    dist = G.cluster_distributions(labelled)
    return {
        "kpis": R.kpis_global(billed, m.clients, m.visits),
        "clusters": summary,
        "clusters_distribuicoes": G.distributions_nested(dist),
        "clusters_radar": G.radar_scores(summary),
        "clientes": M.client_record(labelled, hz.years),
        "clientes_sparklines": K.sparkline_nested(K.client_sparkline(m.clients, hist)),
        "clientes_mix": K.mix_nested(K.client_category_mix(m.clients, R.sales_with_product(hist, m.products), m.products)),
        "clientes_top_skus": K.top_skus_nested(K.client_top_skus(hist)),
        "vendedores": M.seller_record(seller),
        "produtos": M.sku_record(skus),
        "cross_sell": C.category_cooccurrence(swp, m.products).withColumn("pct", X.round_half_up("pct", 1)),
        "temporal": R.monthly_trend(billed),
        "visitas_padroes": C.visit_duration_curve(m.visits),
        "desconto_curva": C.discount_margin_curve(billed),
        "geografia": C.geo_performance(billed, m.clients, m.potential, hz.months),
        "perfis_vendedores": E.count_by(seller, "perfil_vendedor"),
        "curva_abc_contagem": E.count_by(skus, "curva_abc", P.ABC_LABELS),
        "receita_categorias": E.category_revenue(skus),
    }


def build(spark: SparkSession, sf_dir: str, out_dir: str, restarts: int = P.KMEANS_RESTARTS) -> dict[str, str]:
    m = bind_test_tables(spark, sf_dir)
    with shared_scope(spark):  # the written fact and master go once every section is written
        sections = {name: as_output(df) for name, df in build_sections(m, restarts).items()}
        manifest = sinks.publish_sections(sections, out_dir)
        return {name: os.path.join(out_dir, made["path"]) for name, made in manifest["sections"].items()}


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("sf_dir")
    ap.add_argument("out_dir")
    ap.add_argument("--restarts", type=int, default=P.KMEANS_RESTARTS)
    ap.add_argument("--cpus", default="*")
    ap.add_argument("--input-bytes", type=int, help="input size for partition sizing (default: measured if local)")
    a = ap.parse_args(argv)
    from ..session import local_session

    spark = local_session(a.cpus)
    # partition sizing from the input size, for keys the session leaves unset
    size = a.input_bytes
    if size is None and os.path.isdir(a.sf_dir):
        size = sum(os.path.getsize(os.path.join(r, f)) for r, _, files in os.walk(a.sf_dir) for f in files)
    if size:
        apply_unset(spark, scale_conf(size))
    for name, path in build(spark, a.sf_dir, a.out_dir, a.restarts).items():
        print(f"{name}\t{path}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
