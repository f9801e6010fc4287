"""Importance resampling toward a target distribution: documents that look like the target texts are drawn more often.

Words of source and target are hashed into a fixed number of buckets; a bucket's gain is the log ratio of its smoothed shares in the
target and in the source. A document weighs the sum of its words' gains, read from one array by bucket number; Gumbel noise
drawn from its id makes the highest scores a sample without replacement.

The k-th score is found by a distributed quickselect over keys (score down, id up, place), which are unique: each round draws
random pivot keys among the rows still in question, counts exactly the rows between and at the pivots, and keeps the one gap in
which the k-th key lies. Only rows up to that key are then sorted, by range partitions, and numbered by the partitions' sizes.

Defined cases: a null text has no words; a null id is drawn as the empty string and loses ties; rows that repeat score alike, and
the row's place in the scored table decides which of them comes first; no documents or no target texts count as zero features; no rows
give no rows; other columns play no part. A long text is one Arrow value, counted word by word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored, table, text_or_empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
#: Of 100 documents with enough words, how many are drawn.
PERCENT = 10
#: Pivot keys of one round of the selection: rows in question fall by about this factor.
PIVOTS = 63
KEY = ["down", "late", "id", "place"]


def lowered(text: Column) -> Column:
    return F.translate(text, A_TO_Z, A_TO_Z.lower())


def word_counts(text: str, longest: int = 1) -> Counter:
    """How often each run of 1 to longest words occurs."""
    words = WORD.findall(text)
    counts = Counter(words)
    for n in range(2, longest + 1):
        counts.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return counts


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """bucket, n: the features of all texts by bucket. A partition counts into one array and sends its filled places."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for feature, n in word_counts(text, longest).items():
                    counts[crc32(feature.encode()) % buckets] += n
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["bucket", "n"])

    return texts.select(lowered(text_or_empty(text_col)).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket. Both sides hold one row a bucket at most, so what reaches the driver is bounded by buckets."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, found in ((s, source), (t, target)):
        for bucket, n in found.collect():
            counts[bucket] = n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of every row of docs."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                counts = word_counts(text, longest)
                at = np.fromiter((crc32(x.encode()) % buckets for x in counts), np.int64, len(counts))
                n = np.fromiter(counts.values(), np.int64, len(counts))
                runs = int(n.sum())
                rows.append((runs, _words_of(runs, longest), int(gain[at] @ n)))
            f, w, g = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (f, w, g))], names=["doc_id", "h", "n_features", "n_words", "weight"])

    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), lowered(text_or_empty(text_col)).alias("text")).select("doc_id", drawn.alias("h"), "text")
    noise = F.floor(-1000 * F.log(-F.log((F.col("h") + 0.5) / F.lit(4294967296.0)))).cast("long")
    return chosen.mapInArrow(run, "doc_id long, h long, n_features long, n_words long, weight long").withColumn("score", F.col("weight") + noise).drop("h")


def _words_of(runs: int, longest: int) -> int:
    """The number of words behind a number of runs: m words have m + (m - 1) + ... runs."""
    if longest == 1:
        return runs
    for m in range(1, longest):
        if m * (m + 1) // 2 >= runs:
            return m if runs else 0
    return (runs + longest * (longest - 1) // 2) // longest


def _key(values=None) -> Column:
    """A row's key, or that of a pivot, as a struct that orders like KEY."""
    return F.struct(*[(F.col(c) if values is None else F.lit(values[c]).cast("long")).alias(c) for c in KEY])


def kth_key(keys: DataFrame, k: int, pivots: int = PIVOTS, seed: int = SEED):
    """The k-th smallest key (from 1) of keys, whose columns are KEY. What reaches the driver is pivots rows a round."""
    rest, left, turn = keys, k, 0
    while True:
        drawn = rest.orderBy(F.xxhash64("place", F.lit(seed + turn)), *KEY).limit(pivots).collect()
        drawn.sort(key=lambda r: tuple(r[c] for c in KEY))
        at = F.array(*[_key(p) for p in drawn])
        # 2i: between pivots i-1 and i; 2i+1: pivot i itself.
        place = 2 * F.size(F.filter(at, lambda p: p < _key())) + F.array_contains(at, _key()).cast("int")
        counted = dict(rest.groupBy(place.alias("gap")).count().collect())
        for gap in range(2 * len(drawn) + 1):
            n = counted.get(gap, 0)
            if left <= n:
                break
            left -= n
        if gap % 2:
            return drawn[gap // 2]
        rest, turn = stored(rest.filter(place == gap)), turn + 1


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, longest: int = 1, seed: int = SEED, pivots: int = PIVOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null where the row isn't drawn."""
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, text_col, buckets, longest), buckets)
    scored = stored(weighed(docs, gain, seed, id_col, text_col, longest).withColumn("place", F.monotonically_increasing_id()))
    keyed = scored.select("*", (-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("long").alias("late"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    able = F.col("n_words") >= min_words
    k = math.floor(percent * keyed.filter(able).count() / 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return keyed.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = kth_key(keyed.filter(able).select(*KEY), k, pivots, seed)
    drawn = able & (_key() <= _key(last.asDict()))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Of an id that grows within a sorted partition, the high bits are the partition and the low 33 the row's place in it.
    ordered = stored(keyed.filter(drawn).repartitionByRange(parts, *KEY).sortWithinPartitions(*KEY).withColumn("at", F.monotonically_increasing_id()).select(*columns, F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("row")))
    before, total = {}, 0
    for part, n in sorted(ordered.groupBy("part").count().collect()):  # one row a shuffle partition
        before[part], total = total, total + n
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]), F.col("part"))
    ranked = ordered.select(*columns, (start + F.col("row") + 1).alias("rank"))
    return ranked.unionByName(keyed.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_quickselect_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: DuckDB has no crc32: the 256 remainders of its polynomial are computed bit by bit, then each distinct word byte by byte.
CRC_SQL = """
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda k: CAST(k AS BIGINT))), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def crc_of(text: str) -> str:
    """A DuckDB expression for the crc32 of a text column, where t of crc_table is in scope."""
    data = f"list_transform(range(1, CAST(length(hex(encode({text}))) / 2 AS BIGINT) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


def _words_sql(source: str) -> str:
    return f"regexp_extract_all(translate(coalesce({source}.text, ''), '{A_TO_Z}', '{A_TO_Z.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP11_SQL = f"""
WITH {CRC_SQL.strip()},
texts AS (SELECT doc_id, row_number() OVER () AS place, {_words_sql("documents")} AS words FROM documents),
words AS (SELECT place, unnest(words) AS word FROM texts),
targets AS (SELECT unnest({_words_sql("benchmark")}) AS word FROM benchmark),
buckets AS (SELECT word, {crc_of("word")} % {BUCKETS} AS bucket FROM (SELECT word FROM words UNION SELECT word FROM targets), crc_table),
s AS (SELECT bucket, count(*) AS n FROM words JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM targets JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT CAST((SELECT count(*) FROM words) AS DOUBLE) AS s_all, CAST((SELECT count(*) FROM targets) AS DOUBLE) AS t_all),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (s_all + {BUCKETS}) / ((CAST(s.n AS DOUBLE) + 1) * (t_all + {BUCKETS})))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT place, CAST(sum(g) AS BIGINT) AS weight FROM words JOIN buckets USING (word) JOIN gain USING (bucket) GROUP BY place),
scored AS (SELECT doc_id, place, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (place)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER (PARTITION BY n_features >= {MIN_WORDS}) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND r <= {PERCENT} * n // 100 THEN r END AS rank FROM ranked"""
