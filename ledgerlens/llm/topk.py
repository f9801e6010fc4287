"""Exact top-k inner products by norm buckets with per-bucket coordinate or length pruning.

Vectors are scaled to integers and grouped by length (norm) into buckets, each cut into blocks of bounded size. A first
round scores every query against one block of the longest vectors only and so learns a lower bound of its k-th score. Then
query blocks meet the blocks' descriptions (longest vector, range of each coordinate; no vectors): a pair of blocks stays only if for
some query either bound, norm times longest vector or the best corner of the ranges, reaches what is known of it. Vectors are
sent for the pairs that stay. There the bound turns into a local cosine threshold t = bound / (|q| * longest vector of the block).
Above 1 nothing in the block can win. Otherwise a query takes the cheaper pruning: by length (the suffix of the block sorted
by norm that can still reach the bound) or by coordinate (on the query's largest coordinate f, a unit vector with cosine >= t
lies within q_f*t +- sqrt((1-q_f^2)(1-t^2))). Survivors are verified by integer products, so all prunings only save work.

Defined cases: vectors that are null, empty or hold null or non-finite components (also after scaling) take no part; vectors of
different widths are never compared; ids that repeat are separate rows, and a query skips all rows of its own id; ties go to the
smaller id; products are exact, and a score beyond the range of a long is that range's end; no vectors give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import small, stored, table

SCALE = 1024
TOP_K = 10
#: Rows of a candidate block and of a query block; bound a task's memory.
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
#: Query blocks and descriptions of candidate blocks that meet in one task.
MEETING_QUERIES = 16
MEETING_BLOCKS = 512
#: Buckets per doubling of the vector length.
BUCKETS_PER_OCTAVE = 4
EXACT = 2.0**53
LAST = (1 << 63) - 1

BLOCK = "dim int, bucket int, salt int, ids binary, comps binary, n int, longest double, lows binary, highs binary"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("norm", ascending=False, kind="stable")
    comps = np.stack(pdf["ints"].to_numpy()).astype("<f8")
    narrow = comps.astype("<f4")
    return pd.DataFrame(
        {
            "dim": [int(pdf["dim"].iloc[0])],
            "bucket": [int(pdf["bucket"].iloc[0])],
            "salt": [int(pdf["salt"].iloc[0])],
            "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()],
            "comps": [(narrow if np.abs(comps).max() < 2**24 else comps).tobytes()],
            "n": [len(pdf)],
            "longest": [float(pdf["norm"].iloc[0])],
            "lows": [comps.min(0).tobytes()],
            "highs": [comps.max(0).tobytes()],
        }
    )


def _vectors(comps: bytes, n: int, dim: int) -> np.ndarray:
    """The rows of a block; it holds four bytes a component where these are exact, else eight."""
    return np.frombuffer(comps, "<f4" if len(comps) == 4 * n * dim else "<f8").reshape(n, dim).astype("f8")


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer products: in doubles where they are exact, else in Python integers."""
    if not len(rows) or not len(queries):
        return np.zeros((len(queries), len(rows)))
    if float(np.abs(queries).max()) * float(np.abs(rows).max()) * queries.shape[1] < EXACT:
        return queries @ rows.T
    ints = lambda m: [[int(v) for v in r] for r in m.tolist()]
    right, out = ints(rows), np.empty((len(queries), len(rows)), object)
    for i, q in enumerate(ints(queries)):
        for j, r in enumerate(right):
            out[i, j] = min(LAST, max(-LAST - 1, sum(x * y for x, y in zip(q, r, strict=True))))
    return out


def can_win(q: np.ndarray, bound: np.ndarray, longest: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Which blocks (longest, lows, highs) may hold a score of at least its bound for some query."""
    with np.errstate(over="ignore", invalid="ignore"):
        by_norm = np.sqrt((q * q).sum(1))[:, None] * longest[None, :]
        by_range = np.maximum(q, 0) @ highs.T + np.minimum(q, 0) @ lows.T
        most = np.fmin(np.nan_to_num(by_norm, nan=np.inf), np.nan_to_num(by_range, nan=np.inf, posinf=np.inf, neginf=-np.inf))
        return (most + np.abs(most) * 1e-9 + 1 >= bound[:, None]).any(0)


def search_block(q, q_ids, bound, c, c_ids, k):
    """(query row, candidate row, score) of each query's best k in one block; bound: scores below it can't be in the result."""
    with np.errstate(over="ignore"):
        c_norm, q_norm = np.sqrt((c * c).sum(1)), np.sqrt((q * q).sum(1))
    out = []
    slack = 1e-9
    longest = c_norm[0] if len(c_norm) else 0.0
    focus = np.abs(q).argmax(1)
    unit = c / np.where(c_norm > 0, c_norm, 1)[:, None]
    columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i in range(len(q)):
        low = bound[i]
        top = q_norm[i] * longest
        if low > top * (1 + slack) and low > 0:
            continue  # local threshold above 1
        by_length, chosen = len(c), None
        if low > 0 and top > 0:
            by_length = int(np.searchsorted(-c_norm, -low / q_norm[i] * (1 - slack), side="right"))
            t, x, f = min(1.0, low / top), q[i, focus[i]] / q_norm[i], int(focus[i])
            half = math.sqrt(max(0.0, (1 - x * x) * (1 - t * t)))
            if f not in columns:
                order = np.argsort(unit[:, f], kind="stable")
                columns[f] = (order, unit[order, f])
            order, values = columns[f]
            a, b = np.searchsorted(values, x * t - half - 1e-9), np.searchsorted(values, 1.0 if t <= x else x * t + half + 1e-9, side="right")
            if t <= x:
                b = len(values)
            if -x >= t:
                a = 0
            if b - a < by_length:
                chosen = order[a:b]
        rows = np.arange(by_length) if chosen is None else chosen
        scores = _products(q[i : i + 1], c[rows])[0]
        ok = (c_ids[rows] != q_ids[i]) & (scores >= low)
        rows, scores = rows[ok], scores[ok]
        if len(rows) > k:
            if scores.dtype == object:
                best = sorted(range(len(rows)), key=lambda j: (-scores[j], c_ids[rows[j]]))[:k]
            else:
                best = np.lexsort((c_ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
        out += zip([i] * len(rows), rows.tolist(), [int(s) for s in scores], strict=True)
    return out


def top_products(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer products of each query over all vectors but its own."""

    def scaled(df: DataFrame) -> DataFrame:
        whole = lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)
        ints = F.transform(F.col(vector_col), lambda x: whole(x.cast("double") * F.lit(SCALE)))
        finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * F.lit(SCALE)) < F.lit(float("inf"))))
        most = F.greatest(F.array_max(F.transform("ints", lambda x: F.abs(x))), F.lit(1.0))
        return (
            df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
            .filter((F.size(vector_col) > 0) & finite)
            .select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("ints"))
            .withColumn("dim", F.size("ints"))
            .withColumn("most", most)
            .withColumn("norm", F.col("most") * F.sqrt(F.aggregate("ints", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most")))))
            .withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.least(F.log2("norm"), F.lit(1100.0)) * BUCKETS_PER_OCTAVE)).otherwise(F.lit(-1)).cast("int"))
        )

    def blocked(df: DataFrame, rows: int, name: str) -> DataFrame:
        sizes = stored(df.groupBy("dim", "bucket").agg(F.count("*").alias("size")))
        parts = df.join(small(sizes, sizes.count()), ["dim", "bucket"])
        parts = parts.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.ceil(F.col("size") / F.lit(rows))).cast("int"))
        packed = parts.select("dim", "bucket", "salt", "vec_id", "norm", "ints").groupBy("dim", "bucket", "salt").applyInPandas(_pack, BLOCK)
        return stored(packed.withColumn(name, F.monotonically_increasing_id()))

    cands = blocked(scaled(vectors), BLOCK_ROWS, "cand")
    asked = blocked(scaled(queries), QUERY_ROWS, "block")
    groups = lambda n, size: F.ceil(n / F.lit(size)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1))
    # One row a width: how many blocks it has, and its block of the longest vectors that alone holds more than k rows.
    per_dim = cands.groupBy("dim").agg(groups(F.count("*"), MEETING_BLOCKS).alias("supers"), F.max_by("cand", F.struct(F.col("n") > k, "longest", "cand")).alias("first"))
    per_dim = stored(per_dim.join(asked.groupBy("dim").agg(groups(F.count("*"), MEETING_QUERIES).alias("turns")), "dim"))
    n_dims = per_dim.count()

    def searched(pairs: DataFrame) -> DataFrame:
        def run(batches):
            for pdf in batches:
                found = []
                for r in pdf.itertuples(index=False):
                    q, c = _vectors(r.q_comps, r.q_n, r.dim), _vectors(r.comps, r.n, r.dim)
                    q_ids, c_ids = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.ids, "<i8")
                    bound = np.frombuffer(r.bound, "<f8") if r.bound is not None else np.full(len(q), -np.inf)
                    found += [(r.block, i, int(q_ids[i]), int(c_ids[j]), s) for i, j, s in search_block(q, q_ids, bound, c, c_ids, k)]
                yield pd.DataFrame(found, columns=["block", "q_row", "query_id", "vec_id", "score"])

        return pairs.mapInPandas(run, "block long, q_row int, query_id long, vec_id long, score long")

    def with_vectors(pairs: DataFrame) -> DataFrame:
        """Pairs (block, cand, bound) with both blocks' vectors; those of a candidate block, of which there are more, meet last."""
        q = asked.select("block", "dim", F.col("ids").alias("q_ids"), F.col("comps").alias("q_comps"), F.col("n").alias("q_n"))
        return pairs.join(q, "block").join(cands.select("cand", "ids", "comps", "n"), "cand")

    none = F.lit(None).cast("binary")
    ranked = Window.partitionBy("block", "q_row").orderBy(F.desc("score"), "vec_id")
    firsts = asked.select("block", "dim").join(small(per_dim, n_dims), "dim").select("block", F.col("first").alias("cand"), none.alias("bound"))
    seen = searched(with_vectors(firsts))
    kth = seen.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k).select("block", "q_row", F.col("score").cast("double").alias("low"))

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.full(int(pdf["q_n"].iloc[0]), -np.inf)
        known = pdf[pdf["q_row"].notna()]
        values = known["low"].to_numpy(float)
        low[known["q_row"].to_numpy(int)] = np.where(np.abs(values) < EXACT, values, np.nextafter(values, -np.inf))
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "bound": [low.tobytes()]})

    lows = stored(asked.select("block", F.col("n").alias("q_n")).join(kth, "block", "left").groupBy("block").applyInPandas(bounds, "block long, bound binary"))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        """block, cand of the pairs that may hold a result."""
        out = []
        if len(q) and len(c):
            dim, number = int(c["dim"].iloc[0]), c["cand"].to_numpy()
            stack = lambda column: np.stack([np.frombuffer(x, "<f8") for x in c[column]])
            longest, low, high = c["longest"].to_numpy(float), stack("lows"), stack("highs")
            for r in q.itertuples(index=False):
                wins = can_win(_vectors(r.comps, r.n, dim), np.frombuffer(r.bound, "<f8"), longest, low, high)
                out += [(int(r.block), int(x)) for x in number[wins]]
        return pd.DataFrame(out, columns=["block", "cand"]).astype("int64")

    key = ["dim", "super", "turn"]
    widths = small(per_dim.select("dim", "supers", "turns"), n_dims)
    left = asked.select("block", "dim", "comps", "n").join(lows, "block").join(widths, "dim").withColumn("turn", F.pmod(F.xxhash64("block"), F.col("turns")).cast("int")).withColumn("super", numbers(F.col("supers")))
    right = cands.select("cand", "dim", "longest", "lows", "highs").join(widths, "dim").withColumn("super", F.pmod(F.xxhash64("cand"), F.col("supers")).cast("int")).withColumn("turn", numbers(F.col("turns")))
    pairs = left.select(*key, "block", "comps", "n", "bound").groupBy(*key).cogroup(right.select(*key, "cand", "longest", "lows", "highs").groupBy(*key)).applyInPandas(meet, "block long, cand long")
    return (
        searched(with_vectors(stored(pairs).join(lows, "block")))
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def op10_norm_bucket_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_products(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP10_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
