"""Language of pages and documents by Bayesian fusion of evidence.

Per record the evidence is: the likelihood of its text under smoothed byte-trigram models (counted over all documents by
their declared language); the language declared in its markup; the suffix of its address; and the prior of its host.
What declarations and suffixes say about a language, and the host priors, come from grouped aggregation over the text
decisions of all records. Host priors are smoothed down a hierarchy: all records, domain, host; a record's own text
decision is taken out of the counts that it is judged by. The languages are all declared ones of the documents; models and
counts are long rows with what was seen only, and plans don't grow with the number of languages.

Defined cases: null or empty texts, addresses, declarations or hosts give no evidence of their kind; without any evidence
the prior decides; ties go to the alphabetically first language; no documents means no languages and null results;
repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stored, table

TRIGRAM_BUCKETS = 1 << 14
#: A task counts so many languages at once before it hands over their counts, and judges rows in slices of so many numbers.
COUNTED_AT_ONCE = 64
SLICE = 1 << 20
#: Trigrams are far from independent, so a text counts as at most this many.
EFFECTIVE_TRIGRAMS = 40.0
SMOOTHING = 0.5
HOST_STRENGTH = 8.0
#: Rows without a value at a level are joined in so many shares.
NULL_SHARES = 4096


def _trigrams(text: str) -> np.ndarray:
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64)


class TextModels:
    """Smoothed log-likelihoods of trigram buckets by language. What was never seen in a language has the likelihood of its
    floor; rows of a bucket hold, for the languages that have it, how far they are above that."""

    def __init__(self, n: int, of: np.ndarray, at: np.ndarray, count: np.ndarray):
        order = np.lexsort((of, at))
        self.n, self.of = n, of[order].astype(np.int32)
        self.above = np.log((count[order] + SMOOTHING) / SMOOTHING)
        self.starts = np.searchsorted(at[order], np.arange(TRIGRAM_BUCKETS + 1))
        self.floor = np.log(SMOOTHING / (np.bincount(of, count, n) + SMOOTHING * TRIGRAM_BUCKETS))

    def sums(self, grams: np.ndarray) -> np.ndarray:
        """The log-likelihood of the trigrams in each language."""
        seen, times = np.unique(grams, return_counts=True)
        size = self.starts[seen + 1] - self.starts[seen]
        entries = np.repeat(self.starts[seen] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return len(grams) * self.floor + np.bincount(self.of[entries], self.above[entries] * np.repeat(times, size), self.n)


def text_models(labelled: DataFrame) -> tuple[list[str], TextModels]:
    """Languages and their models from text and lang of all rows."""
    languages = sorted(r["lang"] for r in labelled.filter("lang is not null").select("lang").distinct().collect())
    number = {v: i for i, v in enumerate(languages)}

    def rows(counts):
        of, at, n = [], [], []
        for i, own in counts.items():
            found = np.flatnonzero(own)
            of.append(np.full(len(found), i))
            at.append(found)
            n.append(own[found])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in ((of, pa.int32()), (at, pa.int32()), (n, pa.int64()))], names=["of", "at", "n"])

    def run(batches):
        counts = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and lang is not None:
                    i = number[lang]
                    if i not in counts and len(counts) == COUNTED_AT_ONCE:
                        yield rows(counts)
                        counts = {}
                    own = counts.setdefault(i, np.zeros(TRIGRAM_BUCKETS, np.int64))
                    own += np.bincount(_trigrams(text), minlength=TRIGRAM_BUCKETS)
        if counts:
            yield rows(counts)

    # At most TRIGRAM_BUCKETS rows a language, only of buckets that it has.
    summed = labelled.select("text", "lang").mapInArrow(run, "of int, at int, n long").groupBy("of", "at").agg(F.sum("n").alias("n")).toPandas()
    return languages, TextModels(len(languages), *[summed[c].to_numpy(np.int64) for c in ("of", "at", "n")])


def identify(records: DataFrame, labelled: DataFrame, keys: list[str]) -> DataFrame:
    """records (keys, text, declared, suffix, domain, host) with text_language, language, posterior."""
    spark = records.sparkSession
    languages, model = text_models(labelled)
    n = len(languages)
    if not n:
        return records.select(*keys, "declared", "suffix", "host", *[F.lit(None).cast(t).alias(c) for c, t in (("text_language", "string"), ("language", "string"), ("posterior", "double"))])
    shared = spark.sparkContext.broadcast(model)

    def likelihoods(batches):
        models, step = shared.value, max(1, SLICE // n)
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                out, votes = np.zeros((batch.num_rows, n)), np.full(batch.num_rows, -1, np.int32)
                for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    grams = _trigrams(text) if text else ()
                    if len(grams):
                        sums = models.sums(grams) * min(1.0, EFFECTIVE_TRIGRAMS / len(grams))
                        out[i], votes[i] = sums - sums.max(), sums.argmax()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, n), pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(votes)], names=[*batch.schema.names[:-1], "ll", "vote"])

    about = ["declared", "suffix", "domain", "host"]
    chosen = records.select(*keys, *about, "text")
    schema = ", ".join([f"{c} {t}" for c, t in chosen.dtypes if c != "text"] + ["ll array<double>", "vote int"])
    judged = stored(chosen.mapInArrow(likelihoods, schema))
    voted = judged.filter("vote >= 0")
    numbers = F.sequence(F.lit(0), F.lit(n - 1))
    zeros = F.array_repeat(F.lit(0.0), n)
    all_counts = [0.0] * n
    for r in voted.groupBy("vote").count().collect():
        all_counts[r["vote"]] = float(r["count"])
    kinds = voted.agg(*[F.count_distinct(c).cast("double") for c in ("declared", "suffix")]).first()
    everything = spark.createDataFrame([(languages, all_counts, sum(all_counts), *kinds)], "names array<string>, all_counts array<double>, all_seen double, declared_kinds double, suffix_kinds double")

    def by(level: str) -> DataFrame:
        """Votes by language of each value: rows first, then one array a value."""
        rows = voted.filter(F.col(level).isNotNull()).groupBy(level, "vote").agg(F.count("*").cast("double").alias("n"))
        found = rows.groupBy(level).agg(F.map_from_entries(F.collect_list(F.struct("vote", "n"))).alias("found"), F.sum("n").alias(f"{level}_seen"))
        return found.select(level, f"{level}_seen", F.transform(numbers, lambda i: F.coalesce(F.try_element_at("found", i), F.lit(0.0))).alias(f"{level}_counts"))

    df = judged.crossJoin(F.broadcast(everything))  # one row
    # Rows without a value meet nothing; their own number beside the key spreads them over all partitions.
    spread = lambda level: F.when(F.col(level).isNull(), F.pmod(F.xxhash64(*keys), F.lit(NULL_SHARES))).otherwise(F.lit(0).cast("long"))
    for level in about:
        df = df.withColumn("share", spread(level)).join(by(level).withColumn("share", F.lit(0).cast("long")), [level, "share"], "left").drop("share")
    # A record's own vote is in the counts of each level of which it has a value; the sums are numbers beside the arrays.
    voter = F.when(F.col("vote") >= 0, 1.0).otherwise(0.0)
    rest = lambda level: F.transform(F.coalesce(f"{level}_counts", zeros), lambda x, i: F.greatest(x - F.when(i == F.col("vote"), 1.0).otherwise(0.0), F.lit(0.0)))
    seen = lambda level: F.greatest(F.coalesce(f"{level}_seen", F.lit(0.0)) - voter, F.lit(0.0))
    for level in [*about, "all"]:
        df = df.withColumn(f"{level}_rest", rest(level)).withColumn(f"{level}_left", seen(level))
    df = df.withColumn("all_prior", F.transform("all_rest", lambda x: (x + SMOOTHING) / (F.col("all_left") + SMOOTHING * n)))
    for level, above in (("domain", "all"), ("host", "domain")):
        df = df.withColumn(f"{level}_prior", F.zip_with(f"{level}_rest", f"{above}_prior", lambda x, p: (x + HOST_STRENGTH * p) / (F.col(f"{level}_left") + HOST_STRENGTH)))  # noqa: B023
    # P(value | language) is P(language | value) P(value) / P(language); P(value) is the same for all languages.
    said = lambda level: F.when(F.col(level).isNull(), zeros).otherwise(F.zip_with(f"{level}_rest", "all_rest", lambda x, a: F.log((x + SMOOTHING) / (a + SMOOTHING * F.greatest(F.col(f"{level}_kinds"), F.lit(1.0))))))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = plus(plus(F.zip_with("ll", "host_prior", lambda x, p: x + F.log(p)), said("declared")), said("suffix"))
    df = df.withColumn("fused", fused).withColumn("top", F.array_max("fused"))
    return df.select(
        *keys,
        "declared",
        "suffix",
        "host",
        F.when(F.col("vote") >= 0, F.get("names", F.col("vote"))).alias("text_language"),
        F.get("names", (F.array_position("fused", F.col("top")) - 1).cast("int")).alias("language"),
        (1 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("posterior"),
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Text and evidence of raw pages."""
    none = lambda c: F.when(c != "", c)
    host = none(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)))
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&[A-Za-z#0-9]+;", " ")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.lit(None).cast("long").alias("doc_id"),
        none(F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))).alias("declared"),
        none(F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"),
        none(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
        host.alias("host"),
        body.alias("text"),
    )


def document_records(docs: DataFrame) -> DataFrame:
    """Documents carry their declared language and, for a host, their source."""
    null = F.lit(None).cast("string")
    return docs.select(F.lit(None).cast("long").alias("page_id"), F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("lang").cast("string")).alias("declared"), null.alias("suffix"), null.alias("domain"), F.col("source").cast("string").alias("host"), F.col("text").alias("text"))


def op1_bayes_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    records = page_records(table(spark, sf_dir, "pages")).unionByName(document_records(docs))
    return identify(records, docs.select("text", F.lower(F.col("lang").cast("string")).alias("lang")), ["page_id", "doc_id"])
