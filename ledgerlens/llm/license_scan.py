"""License scans by diagonal voting, in DataFrame operations only.

Every rolling three-word gram of every text is joined to the positions of that gram in the license templates. A hit votes
for the diagonal (text position minus template position) on which it lies; votes are gathered per text, template and
diagonal as a bit set of template positions, in as many 64-bit words as the longest template needs. For long templates,
diagonals at most MERGE_GAP apart, or one for each MERGE_WORDS of the template's words, are merged, which lets a copy lose or
gain a few words. A merged span is verified: its grams equal the template's grams word by word (the join
compares the words, not only their hash), enough of them are present, and the span isn't stretched. A base phrase must be
complete on one diagonal.

Defined cases: a null text counts as empty; a text without words or hits gets zero, nulls and empty labels; rows that
repeat with equal id and text each get a row of their own; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import table, text_or_empty

GRAM = 3
#: Diagonals of a long template that lie this close are one copy of it; or as close as one for so many words of it.
MERGE_GAP = 3
MERGE_WORDS = 20
#: Share of a long template's grams that a copy has at least, and words it spans at most for each word of the template.
MIN_SHARE = 0.6
MAX_STRETCH = 1.5
#: Not a word of any text, as words have no such character; carries each text's own row through the join.
MARK = "\u0000"

#: Phrases that must be present word by word, and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Longer public license statements, found also in slightly changed copies.
TEMPLATES = [
    ("mit-notice", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2-notice", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc-4", "licensed under cc by nc 4 0"),
    ("bsd-terms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
        to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsd-2-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code
        must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
        CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
]


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(dict(zip(range(65, 91), range(97, 123), strict=True))))


#: How many 64-bit words hold the votes of the longest template.
VOTE_WORDS = -(-max(len(template_words(t)) - GRAM + 1 for _, t in PHRASES + TEMPLATES) // 64)


def template_positions(spark: SparkSession) -> DataFrame:
    """gram, template, label, exact, t_pos, n_grams, n_words: a fixed table with a row for each gram of a template."""
    entries = [(-1, "", False, -1, MARK, 1, 0)]
    for number, (label, phrase) in enumerate(PHRASES + TEMPLATES):
        words = template_words(phrase)
        grams = [" ".join(words[i : i + GRAM]) for i in range(len(words) - GRAM + 1)]
        entries += [(number, label, number < len(PHRASES), i, g, len(grams), len(words)) for i, g in enumerate(grams)]
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("template", "label", "exact", "t_pos", "t_gram", "n_grams", "n_template_words"), e, strict=True)]) for e in entries])
    return spark.range(1).select(F.inline(rows)).withColumn("t_hash", F.xxhash64("t_gram"))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row of docs."""
    text = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), words_of(text).alias("words"))
    grams = F.transform("words", lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2)))
    placed = (
        texts.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.concat(F.array(F.lit(MARK)), grams).alias("grams"))
        # The outer form: for the inner one Spark infers a filter on the size of the array and evaluates the whole
        # expression, nested into itself, once more below.
        .select("doc_id", "text_key", "n_words", F.posexplode_outer("grams").alias("at", "gram"))
        .withColumn("gram_hash", F.xxhash64("gram"))
    )
    templates = template_positions(docs.sparkSession)
    hits = placed.join(F.broadcast(templates), (F.col("gram_hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))
    about = ["doc_id", "text_key", "n_words", "template", "label", "exact", "n_grams", "n_template_words"]
    votes = [f"votes_{i}" for i in range(VOTE_WORDS)]
    bit = lambda i: F.when(F.col("t_pos").between(64 * i, 64 * i + 63), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t_pos") - 64 * i)).otherwise(F.lit(0).cast("long"))
    diagonals = (
        hits.withColumn("at", F.col("at").cast("long") - 1)
        .withColumn("diagonal", F.col("at") - F.col("t_pos"))
        .groupBy(*about, "diagonal")
        .agg(*[F.bit_or(bit(i)).alias(v) for i, v in enumerate(votes)], F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))
    )
    along = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    starts = F.when(gap.isNull() | F.col("exact") | (gap > F.greatest(F.lit(MERGE_GAP), F.floor(F.col("n_template_words") / MERGE_WORDS))) | (F.col("lo") - F.lag("hi").over(along) > F.col("n_template_words")), 1).otherwise(0)
    merged = (
        diagonals.withColumn("starts", starts)
        .withColumn("copy", F.sum("starts").over(along))
        .groupBy(*about, "copy")
        .agg(*[F.bit_or(v).alias(v) for v in votes], F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diagonal").alias("diagonal"), F.max("n").alias("n"))
        .withColumn("share", sum(F.bit_count(v) for v in votes) / F.col("n_grams"))
        .withColumn("span_words", F.col("hi") - F.col("lo") + GRAM)
    )
    mark = F.col("template") < 0
    base = F.col("exact") & (F.col("share") >= 1.0)
    copy = ~F.col("exact") & ~mark & (F.col("share") >= MIN_SHARE) & (F.col("span_words") <= F.col("n_template_words") * MAX_STRETCH)
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    found = merged.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(base).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(base | copy).alias("labels"),
        F.coalesce(F.max(F.when(base | copy, F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(base | copy, F.struct(F.col("lo").alias("word"), "span_words", "label", "share")))).alias("spans"),
        F.max(F.when(mark, F.col("n"))).alias("copies"),
    )
    return found.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("text_key", "copies", "copy")


def op5_diagonal_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def _oracle() -> str:
    """The same result stated over DuckDB lists: all words, gram hits, diagonals, merged copies."""
    entries = []
    for number, (label, phrase) in enumerate(PHRASES + TEMPLATES):
        words = template_words(phrase)
        n = len(words) - GRAM + 1
        entries += [f"({number}, '{label}', {str(number < len(PHRASES)).lower()}, {i}, '{' '.join(words[i : i + GRAM])}', {n}, {len(words)})" for i in range(n)]
    return f"""
WITH templates(template, label, exact, t_pos, gram, n_grams, n_tw) AS (VALUES {", ".join(entries)}),
texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
grams AS (SELECT doc_id, unnest(range(0, len(w) - 2)) AS pos, unnest(list_transform(range(0, len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS gram FROM texts),
hits AS (SELECT doc_id, template, label, exact, n_grams, n_tw, pos, t_pos, pos - t_pos AS diagonal FROM grams JOIN templates USING (gram)),
diagonals AS (SELECT doc_id, template, label, exact, n_grams, n_tw, diagonal, list(DISTINCT t_pos) AS votes, min(pos) AS lo, max(pos) AS hi FROM hits GROUP BY ALL),
marked AS (SELECT *, CASE WHEN lag(diagonal) OVER w IS NULL OR exact OR diagonal - lag(diagonal) OVER w > greatest({MERGE_GAP}, n_tw // {MERGE_WORDS}) OR lo - lag(hi) OVER w > n_tw THEN 1 ELSE 0 END AS starts FROM diagonals WINDOW w AS (PARTITION BY doc_id, template ORDER BY diagonal)),
copies AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS copy FROM marked),
merged AS (SELECT doc_id, template, label, exact, n_grams, n_tw, copy, len(list_distinct(flatten(list(votes)))) / n_grams AS share, max(hi) - min(lo) + {GRAM} AS span, min(diagonal) AS diagonal FROM copies GROUP BY doc_id, template, label, exact, n_grams, n_tw, copy),
good AS (SELECT *, exact AS base FROM merged WHERE CASE WHEN exact THEN share >= 1 ELSE share >= {MIN_SHARE} AND span <= n_tw * {MAX_STRETCH} END),
per_doc AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(diagonal) FILTER (base) AS first_word, max(diagonal) FILTER (base) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score FROM good GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM texts LEFT JOIN per_doc USING (doc_id)"""


OP5_SQL = _oracle()
