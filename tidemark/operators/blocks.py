"""A stated set of query vectors against all rows, in blocks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Query vectors of one broadcast; more queries take more passes over the rows.
BLOCK_ROWS = 8_192


def block_search(rows: DataFrame, queries: DataFrame, least: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All (query_id, id, similarity) with a dot product of at least ``least``; ``rows`` and ``queries`` have id LONG and vector.

    Queries are streamed to the driver and broadcast in blocks of bounded size; every block meets every row once, as matrix products.
    Null vectors and vectors of another length than the queries' are left out; a row is no match of itself. An empty query set gives no rows.
    """
    spark = rows.sparkSession
    schema = "query_id long, id long, similarity double"
    found: list[DataFrame] = []
    corpus = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")

    def search(ids: list[int], vectors: list[list[float]]) -> None:
        shared = spark.sparkContext.broadcast((np.array(ids), np.array(vectors)))

        def run(batches):
            qi, q = shared.value
            for b in batches:
                b = b[[len(v) == q.shape[1] for v in b["vector"]]]
                for s in range(0, len(b), 1024):
                    part = b.iloc[s : s + 1024]
                    sim = np.stack(part["vector"].to_numpy()) @ q.T
                    i, j = np.nonzero(sim >= least)
                    own = part["id"].to_numpy()[i]
                    keep = own != qi[j]
                    yield pd.DataFrame({"query_id": qi[j][keep], "id": own[keep], "similarity": sim[i, j][keep]})

        found.append(corpus.mapInPandas(run, schema))

    ids, vectors = [], []
    for r in queries.select("id", "vector").where("id IS NOT NULL AND vector IS NOT NULL").toLocalIterator():
        if vectors and (len(vectors) >= block_rows or len(r["vector"]) != len(vectors[0])):
            search(ids, vectors)
            ids, vectors = [], []
        ids.append(r["id"])
        vectors.append(list(r["vector"]))
    if vectors:
        search(ids, vectors)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
