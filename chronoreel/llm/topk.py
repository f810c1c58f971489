"""Exact top-k inner products by a three-phase uniform threshold.

Vectors become whole numbers floor(64 * x). The nodes are dimension blocks: node j of NODES scores a pair by its own block alone and
the score of a pair is the sum over nodes. Queries are dealt into blocks of QUERY_BLOCK and rows into shards of SHARD_ROWS.

1. Each (query block, shard) takes from every node its k best local scores for each query, and adds up their whole scores. The k
   best of these per query and shard are gathered; the k-th best over all shards is a safe cutoff: k rows reach it.
2. The cutoffs go back to the shards. A row whose every node score is under cutoff / NODES cannot reach the cutoff, so each
   node keeps only its entries at or above that uniform threshold.
3. The kept entries' missing node scores are resolved exactly, and only those whose sum reaches the cutoff are sent on and ranked.

What is sent is a few k per query and shard, however many rows there are; ties at the cutoff are all kept. Products are taken by
float64 matrix multiplication where every sum stays under 2**53 and by whole-number arithmetic elsewhere, so scores are exact.

Scale. Rows are replicated once per query block and queries once per shard, in bounded blocks; nothing is broadcast, and work is
queries x rows, which the task states.

Nulls and odd input: vectors null, or holding null or non-finite components, take no part; a null id takes no part; vectors of unlike
length are compared as if padded with zeros; rows that share an id each count, and none is offered to a query of that id;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K = 20
NODES = 4
QUERY_BLOCK = 1024
SHARD_ROWS = 16384
STEP = 256


def _matrix(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows of x against rows of q, exact."""
    if x.size == 0 or q.size == 0 or np.abs(x).max() * np.abs(q).max() * x.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _blocks(dim: int, nodes: int) -> list[slice]:
    edges = [dim * j // nodes for j in range(nodes + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a] or [slice(0, 0)]


def _unpack(pdf: pd.DataFrame):
    q, x = pdf[pdf["is_query"]], pdf[~pdf["is_query"]]
    dim = max([1, *map(len, pdf["v"])])
    return q, x, _matrix(list(q["v"]), dim), _matrix(list(x["v"]), dim), dim


def local_lists(k: int, nodes: int):
    """Phase 1 in one (query block, shard)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x, qm, xm, dim = _unpack(pdf)
        ids, out = x["vec_id"].to_numpy(), []
        if len(q) and len(x):
            for at in range(0, len(q), STEP):
                qi = q["vec_id"].to_numpy()[at : at + STEP]
                own = qi[:, None] == ids[None, :]
                parts = [_products(xm[:, b], qm[at : at + STEP, b]) for b in _blocks(dim, nodes)]
                whole = sum(parts)
                listed = np.zeros(whole.shape, bool)
                for p in parts:
                    p = np.where(own, np.iinfo(np.int64).min, p)
                    top = np.argpartition(-p, min(k, p.shape[1]) - 1, axis=1)[:, :k] if p.shape[1] > k else np.tile(np.arange(p.shape[1]), (len(p), 1))
                    np.put_along_axis(listed, top, True, axis=1)
                listed &= ~own
                for i in range(len(qi)):
                    s = np.sort(whole[i, listed[i]])[::-1][:k]
                    out.append(pd.DataFrame({"query_id": np.full(len(s), qi[i]), "score": s}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.array([], np.int64), "score": np.array([], np.int64)})

    return run


def resolve(k: int, nodes: int):
    """Phases 2 and 3 in one (query block, shard): pdf's query rows carry their cutoff (null: fewer than k rows exist)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x, qm, xm, dim = _unpack(pdf)
        ids, out = x["vec_id"].to_numpy(), []
        if len(q) and len(x):
            blocks = _blocks(dim, nodes)
            lowest = q["cutoff"].to_numpy(dtype=np.float64, na_value=-np.inf)
            for at in range(0, len(q), STEP):
                qi, cut = q["vec_id"].to_numpy()[at : at + STEP], lowest[at : at + STEP, None]
                parts = [_products(xm[:, b], qm[at : at + STEP, b]) for b in blocks]
                sent = np.zeros(parts[0].shape, bool)
                for p in parts:
                    sent |= p * len(blocks) >= cut
                i, j = np.nonzero(sent & (qi[:, None] != ids[None, :]))
                score = sum(p[i, j] for p in parts)
                good = score >= cut[i, 0]
                out.append(pd.DataFrame({"query_id": qi[i[good]], "vec_id": ids[j[good]], "score": score[good]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.array([], np.int64) for c in ("query_id", "vec_id", "score")})

    return run


def top_k(vectors: DataFrame, is_query, k: int = K, scale: int = 64, nodes: int = NODES, query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score) for rows where is_query holds, each distinct query id once."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    rows = materialize(whole.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"), is_query.alias("asks")))
    n = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards, blocks = max(1, -(-n["n"] // shard_rows)), max(1, -(-n["q"] // query_block))
    asked = rows.where("asks").groupBy("vec_id").agg(F.first("v").alias("v")) if n["q"] else rows.where("asks").select("vec_id", "v")
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    sides = lambda more: (
        rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), spread.alias("shard"), "vec_id", "v", F.lit(False).alias("is_query"), F.lit(None).cast("double").alias("cutoff"))
    ).unionByName(more.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "vec_id", "v", F.lit(True).alias("is_query"), "cutoff"))
    asked = materialize(asked)
    first = sides(asked.withColumn("cutoff", F.lit(None).cast("double"))).groupBy("block", "shard").applyInPandas(local_lists(k, nodes), "query_id long, score long")
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    cutoffs = ranked.where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("cutoff"))
    found = sides(asked.join(cutoffs, "vec_id", "left")).groupBy("block", "shard").applyInPandas(resolve(k, nodes), "query_id long, vec_id long, score long")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20"""
