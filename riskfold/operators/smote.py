"""Synthetic minority oversampling (every class up to the majority count).

new = x + u * (x_nn - x): x is a base row of the class, x_nn one of its k
nearest neighbours inside the class (exact kNN join), u in [0, 1). Base row,
neighbour and u are md5 draws of (class, i, seed), so the output is the same
under any partitioning. Requests are generated with ``spark.range`` per class
and resolved with equi-joins (class, base rank) and (base id, neighbour
rank): no row-level data passes through the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.draws import md5_uniform
from .neighbors import CELL_ROWS, knn_join
from .ranking import class_rank, md5_key


def smote(train: DataFrame, features: list[str], label: str = C.LABEL, id_col: str = C.ID,
          k: int = C.SMOTE_K, seed: int = C.SEED, cell_rows: int = CELL_ROWS, within: str | None = None) -> DataFrame:
    """Originals plus synthetic rows; ``source`` tells them apart. Synthetic
    rows get negative ids: -(1 + i * n_groups + group_index).

    ``within``: an integer column from 0 (a fold); each of its values is
    balanced for itself, neighbours included, and ids may repeat between them."""
    spark = train.sparkSession
    extra = [within] if within else []
    base = train.select(id_col, label, *extra, *features)
    by = [label, *extra]
    counts = {(r[label], r[within] if within else 0): r["n"] for r in
              base.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class (and fold)
    n_max: dict = {}
    for (_, w), n in counts.items():
        n_max[w] = max(n_max.get(w, 0), n)
    n_within = max(n_max, default=0) + 1
    groups = sorted(counts, key=lambda g: (g[1], g[0]))
    # classes are told apart by the label alone, or by fold and label
    name = (lambda c, w: c) if not within else (lambda c, w: f"{w}|{c}")
    grp = F.col(label) if not within else F.concat_ws("|", F.col(within).cast("string"), F.col(label).cast("string"))
    key = F.col(id_col) if not within else F.col(id_col) * n_within + F.col(within)
    base = base.withColumns({"__grp": grp, "__key": key})
    need = {g: n_max[g[1]] - n for g, n in counts.items() if n_max[g[1]] - n > 0 and n > 1}
    originals = base.drop("__grp", "__key").withColumn("source", F.lit("original"))
    if not need:
        return originals
    small = base.where(F.col("__grp").isin([name(*g) for g in need]))   # only these classes are drawn from
    nn = knn_join(small, small, k, features, qid="__key", rid="__key", group="__grp",
                  exclude_self=True, cell_rows=cell_rows)
    ranked = class_rank(base, "__grp", md5_key("__key", seed), rank_col="__base_rank", count_col=None)
    n_map = F.create_map(*[x for g in groups for x in (F.lit(name(*g)), F.lit(counts[g]))])
    index = F.create_map(*[x for i, g in enumerate(groups) for x in (F.lit(name(*g)), F.lit(i))])
    req = None
    for g, m in need.items():
        part = spark.range(m).select(F.col("id").alias("__i"), F.lit(name(*g)).alias("__grp"), F.lit(g[0]).alias(label),
                                     *([F.lit(g[1]).cast(train.schema[within].dataType).alias(within)] if within else []))
        req = part if req is None else req.unionByName(part)
    n_c = F.try_element_at(n_map, F.col("__grp"))
    k_eff = F.least(F.lit(k), n_c - 1)
    req = req.withColumns({
        "__base_rank": F.floor(md5_uniform(F.col("__grp"), F.col("__i"), seed, "base") * n_c),
        "nn_rank": (F.floor(md5_uniform(F.col("__grp"), F.col("__i"), seed, "nn") * k_eff) + 1).cast("int"),
        "__gap": md5_uniform(F.col("__grp"), F.col("__i"), seed, "gap"),
    })
    b = ranked.select("__grp", "__base_rank", F.col("__key").alias("__base_key"),
                      *[F.col(f).alias(f"__x_{f}") for f in features])
    s = req.join(b, ["__grp", "__base_rank"])
    s = s.join(nn.select(F.col("__key").alias("__base_key"), F.col("__key_nn").alias("__nn_key"), "nn_rank"),
               ["__base_key", "nn_rank"])
    s = s.join(small.select(F.col("__key").alias("__nn_key"), *[F.col(f).alias(f"__y_{f}") for f in features]),
               "__nn_key")
    synth = s.select(
        (-(1 + F.col("__i") * len(groups) + F.try_element_at(index, F.col("__grp")))).cast("bigint").alias(id_col),
        *by,
        *[(F.col(f"__x_{f}") + F.col("__gap") * (F.col(f"__y_{f}") - F.col(f"__x_{f}"))).alias(f)
          for f in features],
        F.lit("synthetic").alias("source"))
    return originals.unionByName(synth)


def oversample_counts(before: DataFrame, after: DataFrame, label: str = C.LABEL) -> DataFrame:
    """Counts per class before and after, stacked with a ``phase`` column."""
    b = before.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("phase", F.lit("before"))
    a = after.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("phase", F.lit("after"))
    return b.unionByName(a)
