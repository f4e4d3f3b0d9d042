"""Exact top-k by inner product: term-at-a-time accumulation over blocks of candidates.

Vectors become sparse rows of integer weights. Candidates are packed into blocks of bounded size, as
postings: for each dimension the weights of the block's vectors. A query row goes through its non-zero
dimensions one at a time and adds weight times posting to a dense array of scores; a partition then
selects its best, and the bests of all blocks are merged. Query rows are packed into blocks too, and
each pair of a query block and a candidate block is one bounded piece of work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prioscope.llm.tables import durable

LIMIT = (1 << 63) - 1


@dataclass(frozen=True)
class SearchConfig:
    k: int = 5
    every: int = 50
    scale: float = 256.0
    block_rows: int = 8192


def whole(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows whose vector has only finite components."""
    finite = "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return embeddings.filter(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )


def narrowest(data: np.ndarray) -> np.ndarray:
    """The same whole numbers in 2, 4 or 8 bytes each: blocks are copied once for each block on the other side."""
    most = np.abs(data).max(initial=0)
    return data.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8")


def blocks(vectors: DataFrame, scale: float, rows: int) -> DataFrame:
    """(block, ids, data, kind, width): up to ``rows`` vectors of a partition, quantised, a vector a column."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        kept: list[np.ndarray] = []

        def out() -> pd.DataFrame:
            width = max(map(len, kept))
            data = np.zeros((width, len(kept)), np.float64)
            for j, v in enumerate(kept):
                data[: len(v), j] = np.floor(v * scale)
            data = narrowest(data)
            made = pd.DataFrame({
                "ids": [np.array(ids, np.int64).tobytes()], "data": [data.tobytes()], "kind": [data.dtype.str], "width": [width],
            })
            ids.clear()
            kept.clear()
            return made

        for batch in batches:
            for i, v in zip(batch["vec_id"], batch["vector"], strict=True):
                ids.append(i)
                kept.append(np.asarray(v, float))
                if len(ids) >= rows:
                    yield out()
        if ids:
            yield out()

    made = vectors.mapInPandas(packed, "ids binary, data binary, kind string, width int")
    return made.withColumn("block", F.monotonically_increasing_id())


def accumulate(query: np.ndarray, postings: list[tuple[np.ndarray | None, np.ndarray]], scores: np.ndarray, spare: np.ndarray) -> None:
    """Add the products of one sparse query row to the dense ``scores``, a dimension at a time."""
    scores.fill(0)
    for term in np.flatnonzero(query):
        if term >= len(postings):
            break
        where, weights = postings[term]
        if where is None:
            np.multiply(weights, query[term], out=spare)
            scores += spare
        else:
            scores[where] += weights * query[term]


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The cheapest number type in which every partial sum of products is exact."""
    width = min(len(a), len(b))
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * max(1, width)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def best(queries: tuple[np.ndarray, np.ndarray], candidates: tuple[np.ndarray, np.ndarray], k: int) -> pd.DataFrame:
    """Each query's k best of one block of candidates other than itself."""
    q_ids, q = queries
    order = np.argsort(candidates[0], kind="stable")
    ids, data = candidates[0][order], candidates[1][:, order]
    kind = exact_type(q, data)
    as_kind = (lambda x: np.vectorize(int, otypes=[object])(x)) if kind is object else (lambda x: x.astype(kind))
    q, data = as_kind(q), as_kind(data)
    postings: list[tuple[np.ndarray | None, np.ndarray]] = []
    for row in data:
        where = np.flatnonzero(row)
        postings.append((None, np.ascontiguousarray(row)) if 2 * len(where) > len(row) else (where, row[where]))
    scores, spare = np.zeros(len(ids), q.dtype), np.zeros(len(ids), q.dtype)
    out_q, out_id, out_s = [], [], []
    for j, own in enumerate(q_ids):
        accumulate(q[:, j], postings, scores, spare)
        others = ids != own if (at := np.searchsorted(ids, own)) < len(ids) and ids[at] == own else None
        usable = scores if others is None else scores[others]
        names = ids if others is None else ids[others]
        if not len(usable):
            continue
        if len(usable) > k:
            edge = np.partition(usable, len(usable) - k)[len(usable) - k]
            top = np.flatnonzero(usable > edge)
            top = np.concatenate([top, np.flatnonzero(usable == edge)[: k - len(top)]])
        else:
            top = np.arange(len(usable))
        out_q.append(np.full(len(top), own))
        out_id.append(names[top])
        out_s.append(np.array([min(max(int(s), -LIMIT - 1), LIMIT) for s in usable[top]], np.int64))
    if not out_q:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_id), "score": np.concatenate(out_s)})


def top_k(embeddings: DataFrame, queries: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of ``embeddings`` for each row of ``queries``.

    Both have (vec_id, embedding). Vectors that are null, hold null or non-finite components or have no
    id take no part. A shorter vector counts as filled up with zeros, an empty one is zero throughout.
    Every row with the query's own id is left out. An id repeated among candidates can fill several
    ranks; of a repeated query id the smallest vector is asked, once. Scores beyond 64 bits are cut to the nearest long. With fewer
    candidates than ``k`` all are returned; an empty table gives no rows.
    """
    once = whole(queries).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = durable(blocks(once, config.scale, config.block_rows))
    held = durable(blocks(whole(embeddings), config.scale, config.block_rows))
    # numbers of blocks of thousands of rows: every block of queries meets every block of candidates
    pairs = durable(asked.select(F.col("block").alias("q")).crossJoin(held.select(F.col("block").alias("c"))))
    columns = ["q", "c", "asking", "ids", "data", "kind", "width"]
    pieces = (
        asked.join(pairs, F.col("block") == F.col("q")).withColumn("asking", F.lit(True)).select(*columns)
        .unionByName(held.join(pairs, F.col("block") == F.col("c")).withColumn("asking", F.lit(False)).select(*columns))
    )
    k = config.k

    def search(pair: pd.DataFrame) -> pd.DataFrame:
        parts = {}
        for r in pair.itertuples():
            ids = np.frombuffer(r.ids, np.int64)
            parts[bool(r.asking)] = ids, np.frombuffer(r.data, r.kind).reshape(r.width, len(ids))
        return best(parts[True], parts[False], k)

    found = pieces.groupBy("q", "c").applyInPandas(search, "query_id long, vec_id long, score long")
    return _merged(found, k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def search_all(embeddings: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """``top_k`` with the rows whose vec_id is divisible by ``every`` as queries."""
    return top_k(embeddings, embeddings.filter(F.col("vec_id") % config.every == 0), config)
