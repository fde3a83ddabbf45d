"""Client segmentation: features, standardisation, K-Means, PCA, business roles, cluster summaries.

The ML steps use Spark MLlib on the client table (one row per client); the
per-cluster steps work on k-row profiles. Cluster operators take the label
column as a parameter so they can run on any labelling.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import add

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import domains as D
from ..functions import exprs as X
from ..session import cut_lineage

FEATURES = (
    "log_receita",
    "frequencia",
    "recencia",
    "margem_pct",
    "desconto_pct",
    "mix_skus",
    "ticket_medio_log",
    "checkouts",
    "area_loja",
)


def client_features(master: DataFrame, checkouts_default: float = 1.0, area_default: float = 30.0) -> DataFrame:
    """The nine clustering features per client."""
    return master.select(
        "cliente_id",
        F.log1p(X.dbl("receita_liquida")).alias("log_receita"),
        X.dbl("total_pedidos").alias("frequencia"),
        X.dbl("recencia_dias").alias("recencia"),
        X.dbl("margem_pct").alias("margem_pct"),
        X.dbl("desconto_pct").alias("desconto_pct"),
        X.dbl("skus_unicos").alias("mix_skus"),
        F.log1p(X.dbl("ticket_medio")).alias("ticket_medio_log"),
        F.coalesce(X.dbl("n_checkouts"), F.lit(checkouts_default)).alias("checkouts"),
        F.coalesce(X.dbl("area_loja_m2"), F.lit(area_default)).alias("area_loja"),
    )


def standardize(features: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """Zero mean, unit population variance per column; a constant column becomes 0.

    One aggregation gives all means and population deviations (a single row),
    attached as a scalar subquery. The features are read twice (statistics,
    then scaling), so they are checkpointed once instead of recomputed.
    """
    features = cut_lineage(features)
    stats = features.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    j = features.withColumn("_st", D.one_row(stats))
    scaled = {
        c: F.when(F.col(f"_st.s_{c}") > 0, (F.col(c) - F.col(f"_st.m_{c}")) / F.col(f"_st.s_{c}")).otherwise(
            F.lit(0.0)
        )
        for c in cols
    }
    return j.withColumns(scaled).drop("_st")


def assemble(df: DataFrame, cols: Sequence[str] = FEATURES, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def kmeans_segments(
    scaled: DataFrame,
    k: int = P.N_CLUSTERS,
    seed: int = P.KMEANS_SEED,
    restarts: int = P.KMEANS_RESTARTS,
    cols: Sequence[str] = FEATURES,
    max_iter: int = 100,
    n_partitions: int | None = None,
    cluster_col: str = "cluster_raw",
    parallel_fits: int = 8,
    rows_per_partition: int = 250_000,
):
    """Best of ``restarts`` K-Means fits (k-means||, seeds seed..seed+restarts-1) by training cost.

    The vectors are laid out in a fixed partitioning and order and cached, so a
    seed gives the same fit on every run. Returns (labelled frame, model, cost).
    """
    base = assemble(scaled, cols).select("cliente_id", "features").persist(StorageLevel.MEMORY_AND_DISK)
    n_rows = base.count()
    # partition count is a function of the data size only, so a seed gives the
    # same fit on every run of the same data (about 250k vectors per task)
    parts = n_partitions or max(1, math.ceil(n_rows / rows_per_partition))
    vec = (
        base.repartition(parts, "cliente_id").sortWithinPartitions("cliente_id").persist(StorageLevel.MEMORY_AND_DISK)
    )
    vec.count()  # lay the vectors out once
    base.unpersist()

    def fit(i: int):
        est = KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="features", predictionCol=cluster_col)
        model = est.fit(vec)
        return i, model, model.summary.trainingCost

    # the restarts are independent Spark jobs; submit them concurrently
    with ThreadPoolExecutor(max_workers=max(1, min(parallel_fits, restarts))) as pool:
        fits = list(pool.map(fit, range(restarts)))
    _, model, cost = min(fits, key=lambda t: (t[2], t[0]))
    labelled = cut_lineage(
        model.transform(vec).select("cliente_id", F.col(cluster_col).cast("int").alias(cluster_col))
    )
    vec.unpersist()
    return labelled, model, cost


#: Squarings of the moment matrix: the eigenvectors are those of its 2^EIGEN_STEPS-th power.
EIGEN_STEPS = 16


def cross_moments(scaled: DataFrame, cols: Sequence[str] = FEATURES) -> np.ndarray:
    """Exact sums of the products of all pairs of columns (six decimals each), from one scan; one row reaches the driver."""
    exact = scaled.select(*[X.round_half_up(c, 6).cast("decimal(18,6)").alias(f"x{i}") for i, c in enumerate(cols)])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    product = lambda i, j: F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(38,12)"))
    row = exact.agg(*[X.dbl(product(i, j)).alias(f"m{i}_{j}") for i, j in pairs]).collect()[0]
    out = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"m{i}_{j}"] or 0.0
    return out


def principal_axes(moments: np.ndarray, k: int) -> list[np.ndarray]:
    """The k first eigenvectors by repeated squaring and deflation, each with its largest loading positive."""
    axes = []
    for _ in range(k):
        power = moments
        for _ in range(EIGEN_STEPS):
            trace = np.trace(power)
            if trace <= 0:
                break
            power = power / trace
            power = power @ power
        axis = power[:, int(power.diagonal().argmax())]
        length = math.sqrt(float(axis @ axis))
        axis = axis / length if length else axis
        axis = -axis if axis[int(abs(axis).argmax())] < 0 else axis
        axes.append(axis)
        moments = moments - float(axis @ moments @ axis) * np.outer(axis, axis)
    return axes


def pca_2d(scaled: DataFrame, cols: Sequence[str] = FEATURES, k: int = P.PCA_DIMS, digits: int = 3) -> DataFrame:
    """First two principal components of the standardised features, 3 decimals.

    The features have mean 0, so their cross-moments are the covariances but for
    a factor. Sign rule: each axis is flipped so that its largest-magnitude
    loading is positive.
    """
    axes = principal_axes(cross_moments(scaled, cols), k)
    names = ["pca_x", "pca_y"] + [f"pca_{j}" for j in range(2, k)]
    at = [reduce(add, [F.col(c) * F.lit(float(x)) for c, x in zip(cols, axis, strict=True)]) for axis in axes]
    return scaled.select("cliente_id", *[F.round(c, digits).alias(n) for c, n in zip(at, names, strict=True)])


def cluster_profile(df: DataFrame, cluster_col: str = "cluster_raw") -> DataFrame:
    """Per cluster: size, mean/sum revenue, mean orders, recency, margin %, discount %, SKUs,
    checkouts and area (NULLs skipped), visit conversion."""
    return (
        df.where(F.col(cluster_col).isNotNull())
        .groupBy(cluster_col)
        .agg(
            F.count("cliente_id").alias("n"),
            X.mean_decimal("receita_liquida").alias("rec_liq_med"),
            X.money_sum("receita_liquida").alias("rec_liq_sum"),
            (X.dbl(F.sum("total_pedidos")) / X.dbl(F.count("total_pedidos"))).alias("pedidos_med"),
            (X.dbl(F.sum("recencia_dias")) / X.dbl(F.count("recencia_dias"))).alias("recencia_med"),
            F.avg("margem_pct").alias("margem_pct_med"),
            F.avg("desconto_pct").alias("desconto_pct_med"),
            (X.dbl(F.sum("skus_unicos")) / X.dbl(F.count("skus_unicos"))).alias("skus_med"),
            F.avg("n_checkouts").alias("checkouts_med"),
            F.avg("area_loja_m2").alias("area_med"),
            F.avg("taxa_conversao_visitas").alias("conversao_visitas_med"),
        )
    )


ROLE_METRICS = (
    (P.SEG_KEY_ACCOUNTS, "rec_liq_med"),
    (P.SEG_CHURN_RISK, "recencia_med"),
    (P.SEG_HIGH_POTENTIAL, "checkouts_med"),
    (P.SEG_DISCOUNT_HUNTERS, "desconto_pct_med"),
)


def segments_frame(spark) -> DataFrame:
    """The fixed segment table (code, name, tag, description)."""
    return spark.createDataFrame(
        [(s.code, s.name, s.tag, s.description) for s in P.SEGMENTS],
        "cluster_code string, cluster_nome string, cluster_tag string, cluster_desc string",
    )


def segment_roles(profile: DataFrame, cluster_col: str = "cluster_raw") -> DataFrame:
    """Greedy, exclusive role assignment over the k-row cluster profile.

    Highest mean revenue → key accounts; of the rest, highest mean recency →
    churn risk; then most checkouts → high potential; then highest mean
    discount → discount hunters; every remaining cluster → stable. NULL
    metrics rank last and ties go to the lower cluster id. With fewer
    clusters, only the roles that can be assigned are emitted, in that order.

    The profile has one row per cluster — model-sized like the K-Means centres —
    so the sequential pick runs on those k rows and the result is a k-row
    DataFrame.
    """
    metrics = [m for _, m in ROLE_METRICS]
    rows = profile.select(cluster_col, *metrics).collect()
    remaining = sorted(rows, key=lambda r: r[cluster_col])
    assigned = []
    for prio, (seg, metric) in enumerate(ROLE_METRICS):
        if not remaining:
            break
        best = max(remaining, key=lambda r: (r[metric] is not None, r[metric] or 0.0, -r[cluster_col]))
        assigned.append((best[cluster_col], seg.code, prio))
        remaining = [r for r in remaining if r[cluster_col] != best[cluster_col]]
    assigned += [(r[cluster_col], P.SEG_RETAIL_STABLE.code, len(ROLE_METRICS)) for r in remaining]
    ctype = profile.schema[cluster_col].dataType.simpleString()
    roles = profile.sparkSession.createDataFrame(assigned, f"{cluster_col} {ctype}, cluster_code string, prioridade int")
    return roles.join(F.broadcast(segments_frame(profile.sparkSession)), "cluster_code", "left").select(
        cluster_col, "cluster_code", "cluster_nome", "cluster_tag", "cluster_desc", "prioridade"
    )


def segment_labels(df: DataFrame, roles: DataFrame, cluster_col: str = "cluster_raw") -> DataFrame:
    """Attach role name, code, tag and description (roles has at most k rows)."""
    return df.join(F.broadcast(roles.drop("prioridade")), cluster_col, "left")


def cluster_summary(labelled: DataFrame, cluster_col: str = "cluster_raw") -> DataFrame:
    """Per cluster/role: size and share, revenue and share, margin, mean metrics (document rounding)."""
    keys = [cluster_col] + [c for c in ("cluster_nome", "cluster_code", "cluster_tag", "cluster_desc") if c in labelled.columns]
    per = labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_clientes"),
        X.money_sum("receita_liquida").alias("_rec"),
        X.money_sum("margem_total").alias("_marg"),
        F.avg("margem_pct").alias("_mpct"),
        F.avg("desconto_pct").alias("_dpct"),
        X.mean_decimal("receita_liquida").alias("_recm"),
        (X.dbl(F.sum("total_pedidos")) / X.dbl(F.count("total_pedidos"))).alias("_ped"),
        F.avg("ticket_medio").alias("_tick"),
        (X.dbl(F.sum("skus_unicos")) / X.dbl(F.count("skus_unicos"))).alias("_skus"),
        (X.dbl(F.sum("recencia_dias")) / X.dbl(F.count("recencia_dias"))).alias("_rece"),
        F.avg("n_checkouts").alias("_chk"),
        F.avg("area_loja_m2").alias("_area"),
        (X.dbl(F.sum("total_visitas")) / X.dbl(F.count("total_visitas"))).alias("_vis"),
        F.avg("taxa_conversao_visitas").alias("_conv"),
    )
    tot = labelled.agg(F.count(F.lit(1)).alias("n"), X.money_sum("receita_liquida").alias("rec"))
    j = per.withColumn("_tot", D.one_row(tot)).withColumns({"_n_all": F.col("_tot.n"), "_rec_all": F.col("_tot.rec")})
    return j.select(
        *keys,
        "total_clientes",
        X.round_half_up(X.dbl("total_clientes") / X.dbl("_n_all") * 100, 1).alias("pct_clientes"),
        X.round_money("_rec").alias("rec_total"),
        X.round_half_up(X.try_ratio("_rec", "_rec_all") * 100, 1).alias("pct_receita"),
        X.round_money("_marg").alias("margem_total"),
        X.round_half_up(F.col("_mpct") * 100, 2).alias("margem_pct_med"),
        X.round_half_up(F.col("_dpct") * 100, 2).alias("desconto_pct_med"),
        X.round_half_up("_recm", 2).alias("rec_med"),
        X.round_half_up("_ped", 1).alias("pedidos_med"),
        X.round_half_up("_tick", 2).alias("ticket_med"),
        X.round_half_up("_skus", 1).alias("skus_med"),
        X.round_half_up("_rece", 0).alias("recencia_med"),
        X.round_half_up("_chk", 1).alias("checkouts_med"),
        X.round_half_up("_area", 1).alias("area_med"),
        X.round_half_up("_vis", 1).alias("visitas_med"),
        X.round_half_up(F.col("_conv") * 100, 1).alias("conv_visitas_med"),
    )


def cluster_distributions(
    df: DataFrame, cluster_col: str = "cluster_raw", cols: Sequence[str] = ("canal", "porte", "regiao_comercial")
) -> DataFrame:
    """Per cluster: value → count for each listed column (long form), in one pass and one shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimensao"), F.col(c).cast("string").alias("valor")) for c in cols])
    ex = df.select(cluster_col, F.explode(pairs).alias("_p")).select(cluster_col, "_p.dimensao", "_p.valor")
    return ex.where(F.col("valor").isNotNull()).groupBy(cluster_col, "dimensao", "valor").agg(F.count(F.lit(1)).alias("n"))


def distributions_nested(long: DataFrame, cluster_col: str = "cluster_raw") -> DataFrame:
    """``cluster, dimensao, contagens: map<valor, n>``."""
    return long.groupBy(cluster_col, "dimensao").agg(F.map_from_entries(F.collect_list(F.struct("valor", "n"))).alias("contagens"))


def radar_scores(summary: DataFrame, caps: Sequence[float] = P.RADAR_CAPS, cluster_col: str = "cluster_raw") -> DataFrame:
    """Six 0–100 scores per cluster from the summary (recency inverted)."""
    c_ticket, c_freq, c_rec, c_marg, c_mix, c_chk = caps
    keep = [c for c in (cluster_col, "cluster_code") if c in summary.columns]
    return summary.select(
        *keep,
        X.clamp_score("ticket_med", c_ticket).alias("score_ticket"),
        X.clamp_score("pedidos_med", c_freq).alias("score_frequencia"),
        X.clamp_score("recencia_med", c_rec, invert=True).alias("score_recencia"),
        X.clamp_score("margem_pct_med", c_marg).alias("score_margem"),
        X.clamp_score("skus_med", c_mix).alias("score_mix"),
        X.clamp_score("checkouts_med", c_chk).alias("score_porte"),
    )


_SLOT = re.compile(r"\{(\w+)\}")


def fill_template(template: str, slots: dict[str, Column]) -> Column:
    """Concatenate the template's literal parts with the slot columns (as text, NULL → '')."""
    parts: list[Column] = []
    pos = 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos : m.start()]))
        parts.append(F.coalesce(slots[m.group(1)].cast("string"), F.lit("")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def _two_dec(c: str) -> Column:
    return F.col(c).cast("decimal(38,2)").cast("string")


def recommended_action(record: DataFrame, texts: dict[str, str] = P.ACTION_TEXTS) -> DataFrame:
    """Per client, the action text of its segment code with the client's metrics filled in."""
    slots = {
        "rec_liq": _two_dec("rec_liq"),
        "skus": F.col("skus"),
        "checkouts": F.col("checkouts"),
        "area_m2": F.col("area_m2"),
        "recencia_dias": F.col("recencia_dias"),
        "status": F.col("status"),
        "desconto_pct": _two_dec("desconto_pct"),
        "margem_pct": _two_dec("margem_pct"),
    }
    expr = None
    for code, tpl in texts.items():
        t = fill_template(tpl, slots)
        expr = F.when(F.col("cluster_code") == code, t) if expr is None else expr.when(F.col("cluster_code") == code, t)
    return record.select("id", "cluster_code", expr.alias("acao_recomendada"))
