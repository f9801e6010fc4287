"""Fill-in-the-middle: each document is cut into prefix, middle and suffix at drawn places and written in another order.

Places are found in the UTF-8 bytes of a whole Arrow batch. A sparse exception index holds only the multibyte characters of the
batch: the byte at which each starts and the running sum of the bytes that they have beyond one. A binary search in it turns
byte cuts into code-point cuts and back; between two entries both are a constant apart, so plain spans need arithmetic only.

Units are lines (`[^\\n]*\\n|[^\\n]+`) or single code points. Which units end the prefix and the middle is drawn from the sha256 of
seed and id, so any executor draws the same.

Defined cases: a null text counts as empty, and an empty text stays plain, as do texts that contain one of the three marks; a null id is
drawn as the empty string; rows that repeat are separate rows with equal results; no rows give no rows; other columns play no part.
A long text is one Arrow value, handled in memory linear in the batch that holds it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import table, text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of 100 documents, how many are transformed, and how many of these have the suffix first.
RATE, SUFFIX_FIRST = 100, 50
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class SparseCharIndex:
    """Where the multibyte characters of data start, and how many bytes beyond one they and all before them have."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        lead = data[self.at]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(extra)])
        #: The code point number of each of them.
        self.char_at = self.at - self.excess[:-1]

    def chars(self, byte):
        """How many code points start before byte, the start of a character."""
        return byte - self.excess[np.searchsorted(self.at, byte)]

    def bytes(self, char):
        """At which byte the code point of number char starts."""
        return char + self.excess[np.searchsorted(self.char_at, char)]


def batch_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes under a string array, and where its values start and the last ends in them."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def cut_batch(texts: pa.Array, first: np.ndarray, second: np.ndarray, unit: str):
    """Per text: number of units, byte bounds (start, end of prefix, end of middle, end), code points of prefix and of middle."""
    data, bounds = batch_bytes(texts)
    start, end = bounds[:-1], bounds[1:]
    low = int(bounds[0])
    index = SparseCharIndex(data[low : bounds[-1]])
    as_char = lambda byte: index.chars(byte - low)
    if unit == "char":
        n = as_char(end) - as_char(start)
    else:
        line_ends = np.flatnonzero(data[low : bounds[-1]] == 10) + low
        before = np.searchsorted(line_ends, start)
        n_ends = np.searchsorted(line_ends, end) - before
        n = n_ends + ((end > start) & (data[np.maximum(end - 1, 0)] != 10) if len(data) else 0)
    a, b = first % (n + 1), second % (n + 1)

    def byte_of(k):
        if unit == "char":
            return index.bytes(as_char(start) + k) + low
        ends = np.append(line_ends, 0)[np.minimum(before + np.maximum(k - 1, 0), len(line_ends))] + 1
        return np.where(k == 0, start, np.where(k <= n_ends, ends, end))

    p, m = byte_of(np.minimum(a, b)), byte_of(np.maximum(a, b))
    return data, n, (start, p, m, end), as_char(p) - as_char(start), as_char(m) - as_char(p)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, unit: str = "line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and the output text of every row."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring("drawn", 8 * i - 7, 8), 16, 10).cast("long")
    marked = reduce(lambda x, y: x | y, [F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)])
    plain = (F.col("text") == "") | marked | (number(3) % 100 >= rate)
    chosen = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
        .withColumn("drawn", drawn)
        .select("doc_id", "text", number(1).alias("h1"), number(2).alias("h2"), F.when(plain, "plain").when(number(4) % 100 < suffix_first, "spm").otherwise("psm").alias("form"))
    )

    def run(batches):
        for batch in batches:
            ids, texts, h1, h2, forms = batch.columns
            data, n, bounds, prefix, middle = cut_batch(texts, h1.to_numpy(), h2.to_numpy(), unit)
            out, forms = [], forms.to_pylist()
            for form, s, p, m, e in zip(forms, *(x.tolist() for x in bounds), strict=True):
                parts = [data[s:e]] if form == "plain" else [data[s:p], data[p:m], data[m:e]]
                parts = [x.tobytes().decode() for x in parts]
                if form == "plain":
                    out.append(parts[0])
                elif form == "psm":
                    out.append(f"{PREFIX}{parts[0]}{SUFFIX}{parts[2]}{MIDDLE}{parts[1]}")
                else:
                    out.append(f"{SUFFIX}{parts[2]}{PREFIX}{parts[0]}{MIDDLE}{parts[1]}")
            is_plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64(), mask=is_plain), pa.array(middle, pa.int64(), mask=is_plain), pa.array(out, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return chosen.mapInArrow(run, OUTPUT)


def restored(form: str = "form", output: str = "output"):
    """The text that fill_in_middle was given, from its output and form alone: the marks occur once each, as no such text holds one."""
    after = lambda mark: F.substring_index(output, mark, -1)
    before = lambda text, mark: F.substring_index(text, mark, 1)
    middle = after(MIDDLE)
    return (
        F.when(F.col(form) == "psm", F.concat(before(after(PREFIX), SUFFIX), middle, before(after(SUFFIX), MIDDLE)))
        .when(F.col(form) == "spm", F.concat(before(after(PREFIX), MIDDLE), middle, before(after(SUFFIX), PREFIX)))
        .otherwise(F.col(output))
    )


def op12_sparse_index_fim(spark, sf_dir):
    done = fill_in_middle(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP12_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS x, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT *, regexp_extract_all(x, '[^\\n]*\\n|[^\\n]+') AS u, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS hs FROM texts),
drawn AS (SELECT *, CAST(len(u) AS BIGINT) AS n, hs[1] % (len(u) + 1) AS a, hs[2] % (len(u) + 1) AS b,
  CASE WHEN x = '' OR contains(x, '{PREFIX}') OR contains(x, '{SUFFIX}') OR contains(x, '{MIDDLE}') OR hs[3] % 100 >= {RATE} THEN 'plain' WHEN hs[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT doc_id, x, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM parts"""
