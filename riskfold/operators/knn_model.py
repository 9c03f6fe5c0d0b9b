"""k-nearest-neighbour classifier: vote share of the k exact neighbours."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .naive_bayes import argmax_first
from .neighbors import CELL_ROWS, knn_join


def knn_vote(queries: DataFrame, train: DataFrame, features: list[str], k: int = C.KNN_K,
             label: str = C.LABEL, id_col: str = C.ID, n_classes: int = 3,
             cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds p0..p{n-1} (share of neighbours per class) and ``pred`` (largest
    share, ties to the lowest class) to the query rows."""
    nn = knn_join(queries, train, k, features, qid=id_col, rid=id_col, carry=label, cell_rows=cell_rows)
    # the neighbours of a query are already in one partition
    votes = nn.groupBy(id_col).agg(*[F.count(F.when(F.col(f"{label}_nn") == c, 1)).alias(f"__n{c}")
                                     for c in range(n_classes)])
    counts = [F.col(f"__n{c}") for c in range(n_classes)]
    votes = votes.select(id_col, *[(F.col(f"__n{c}") / float(k)).alias(f"p{c}") for c in range(n_classes)],
                         argmax_first(counts).cast("int").alias("pred"))
    return queries.join(votes, id_col)
