"""Removal of repeated byte strings by longest previous factors, keeping each string's first document.

A byte goes if a MATCH-byte string that covers it also starts in a document with a smaller id. Four steps, all keyed so that
Spark spreads them:

1. Texts are dealt into chunks of bounded size. In every MATCH-byte window the GRAM-byte string with the least hash is
   its anchor; equal windows have equal anchors, and only about one byte in fourteen is one. For each anchor the chunk asks the
   bucket of its hash, sending hashes only: of the anchor, of the segment (all bytes of windows that can hold it), and the id.
   A chunk asks once for equal segments, for its smallest id, so a passage in a third of all rows costs one entry a chunk.
2. The bucket answers: the whole segment stands in an earlier document (gone); or the anchor stands in one segment only
   (stays); or there are different segments around the anchor (to be compared).
3. Of those to be compared, one copy of each segment goes to the bucket as bytes. There the windows are put into suffix order
   (prefix doubling to depth MATCH, ties in order of ids). The longest previous factor of a window reaches MATCH if its
   previous smaller position, the nearest one before it in that order with a smaller id, shares MATCH bytes; the next
   smaller position never shares them, since equal windows stand in order of ids.
4. Each chunk joins the answers to its texts again and removes what is covered.

Defined cases: a null text counts as empty; null ids count as larger than all others; rows with equal ids never remove each
other's bytes; texts under MATCH bytes stay whole; extra columns come along only where asked for; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import table, text_or_empty

MATCH = 50
GRAM = 24
REACH = MATCH - GRAM
#: Bytes of text in one chunk and, about, in one bucket; bound the memory of a task.
CHUNK_BYTES = 3 << 20
BUCKET_BYTES = 6 << 20
#: Bytes of text, and the rest of the last one, whose anchors are sought at once: some twenty numbers a byte are held meanwhile.
SLICE_BYTES = 1 << 19
LAST_ID = np.iinfo(np.int64).max

_rng = np.random.default_rng(20240229)
_LETTER = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _sliding(op, a: np.ndarray, w: int) -> np.ndarray:
    """op over every w neighbours."""
    n, cur = 1, a
    while 2 * n <= w:
        cur = op(cur[:-n], cur[n:])
        n *= 2
    m = len(a) - w + 1
    return op(cur[:m], cur[w - n : w - n + m]) if n < w else cur[:m]


class Chunk:
    """The texts of one chunk in order of id, and their anchors."""

    def __init__(self, ids: list, texts: list[bytes], extra: list | None = None):
        order = sorted(range(len(ids)), key=lambda i: (LAST_ID if ids[i] is None else ids[i], texts[i]))
        self.rows = order
        self.given = [ids[i] for i in order]
        self.ids = np.array([LAST_ID if ids[i] is None else ids[i] for i in order], np.int64)
        self.texts = [texts[i] for i in order]
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64) if order else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if order else self.ends
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        self._anchors()

    def _anchors(self) -> None:
        part = self.starts // SLICE_BYTES
        bounds = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
        parts = [self._anchors_of(a, b) for a, b in zip(bounds, bounds[1:], strict=False)]
        parts.append((*[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 2))
        self.at, self.doc, self.left, self.right, self.anchor, self.segment = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((self.at, self.segment, self.anchor))
        a, s = self.anchor[order], self.segment[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
        #: For each anchor the chunk's first one with an equal segment.
        self.first = np.empty(len(order), np.int64)
        self.first[order] = order[new][np.cumsum(new) - 1] if len(order) else order

    def _anchors_of(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """Place, text, left, right, hash and segment's hash of the anchors of texts a to b - 1, with which the working memory ends."""
        low, n = int(self.starts[a]), int(self.ends[b - 1] - self.starts[a])
        if n < MATCH:
            return (*[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 2)
        starts, ends = self.starts[a:b] - low, self.ends[a:b] - low
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[self.bytes[low : low + n]] * _power(_BASE, n), out=sums[1:])
        inverse = _power(_INVERSE, n)
        hashes = np.maximum(_mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1]), np.uint64(1))
        least = _sliding(np.minimum, hashes, REACH + 1)
        for back in range(1, MATCH):  # windows that cross the end of a text are none
            over = ends - back
            least[over[(over >= 0) & (over < len(least))]] = 0
        pad = np.zeros(REACH, np.uint64)
        at = np.flatnonzero(hashes == _sliding(np.maximum, np.concatenate([pad, least, pad]), REACH + 1))
        # An empty text has no bytes: its start equals the next one's, and the last such start is the text that holds them.
        doc = np.searchsorted(starts, at, "right") - 1
        left = np.maximum(starts[doc], at - REACH)
        right = np.minimum(ends[doc], at + MATCH)
        shape = ((at - left) * 1000003 + (right - at)).astype(np.uint64)
        segment = _mix((sums[right] - sums[left]) * inverse[left] + _mix(shape + np.uint64(1)))
        return at + low, doc + a, left + low, right + low, hashes[at], segment

    def asked(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """The anchors that ask, by bucket, in order of place."""
        own = np.flatnonzero(self.first == np.arange(len(self.first)))
        bucket = (self.anchor[own] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        return [(int(bucket[order[a]]), own[order[a:b]]) for a, b in zip(bounds, [*bounds[1:], len(order)], strict=True)]


def _table(columns: dict, kinds: dict) -> pa.Table:
    return pa.table({k: pa.array(columns[k], t) for k, t in kinds.items()})


NOTE = {"chunk": pa.int32(), "bucket": pa.int32(), "kind": pa.int8(), "data": pa.binary()}
NOTE_SQL = "chunk int, bucket int, kind byte, data binary"


def _notes(rows: list[tuple]) -> pa.Table:
    return _table(dict(zip(NOTE, zip(*rows, strict=True), strict=True)) if rows else {k: [] for k in NOTE}, NOTE)


def _read(docs: pa.Table) -> Chunk:
    texts = [t or b"" for t in docs["text_bytes"].to_pylist()]
    return Chunk(docs["doc_id"].to_pylist(), texts)


def _codes(chunk: Chunk, notes: pa.Table, buckets: int) -> tuple[np.ndarray, dict[int, bytes], list]:
    """Each asking anchor's answer (0 stays, 1 compare, 2 gone), the compared windows' bits by bucket, and the asked lists."""
    codes, bits, asked = np.zeros(len(chunk.at), np.uint8), {}, chunk.asked(buckets)
    by_bucket = dict(asked)
    for bucket, kind, data in zip(notes["bucket"].to_pylist(), notes["kind"].to_pylist(), notes["data"].to_pylist(), strict=True):
        if kind == 0:
            codes[by_bucket[bucket]] = np.frombuffer(zlib.decompress(data), np.uint8)
        else:
            bits[bucket] = data
    return codes, bits, asked


def answer_hashes(anchor: np.ndarray, segment: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """0 stays, 1 compare, 2 gone; for anchors of one bucket from all chunks."""
    order = np.lexsort((ids, segment, anchor))
    a, s, d = anchor[order], segment[order], ids[order]
    new_a = np.ones(len(order), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_s = new_a.copy()
    new_s[1:] |= s[1:] != s[:-1]
    at_a, at_s = np.flatnonzero(new_a), np.flatnonzero(new_s)
    of_a, of_s = np.cumsum(new_a) - 1, np.cumsum(new_s) - 1
    later = d > d[at_s][of_s]
    several = np.bincount(of_a, new_s)[of_a] > 1
    spread = (np.minimum.reduceat(d, at_a) < np.maximum.reduceat(d, at_a))[of_a]
    out = np.empty(len(order), np.uint8)
    out[order] = np.where(later, 2, np.where(several & spread, 1, 0))
    return out


def windows_seen_earlier(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every MATCH-byte window of the segments, in order: whether its longest previous factor reaches MATCH bytes."""
    counts = ends - starts - MATCH + 1
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    who = np.repeat(ids, counts)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.zeros(len(data), np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + len(data)]
    rank = np.unique(eight, return_inverse=True)[1].astype(np.int64)
    length = 8
    while length < MATCH:  # ranks of the strings twice as long, from pairs; the last pair overlaps
        step = min(length, MATCH - length)
        if length + step == MATCH:
            pair = rank[at] * np.int64(len(data) + 1) + rank[at + step]
        else:
            second = np.zeros(len(rank), np.int64)
            second[: len(rank) - step] = rank[step:]
            pair = rank * np.int64(len(data) + 1) + second
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        length += step
    order = np.lexsort((who, rank))  # suffix order to depth MATCH
    r, d = rank[order], who[order]
    new = np.ones(len(order), bool)
    new[1:] = r[1:] != r[:-1]
    previous_smaller_shares = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
    seen = np.empty(len(order), bool)
    seen[order] = previous_smaller_shares
    return seen


def covered_bytes(docs: DataFrame, id_col: str, text_col: str, finish, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """finish(chunk, covered, extra columns) for every chunk of docs, as rows of schema."""
    text = text_or_empty(text_col)
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks, buckets = max(1, -(-total // CHUNK_BYTES)), max(1, -(-total // BUCKET_BYTES))
    dealt = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.cast("binary").alias("text_bytes"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
        F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(chunks)).cast("int").alias("chunk"),
    )

    def ask(docs: pa.Table) -> pa.Table:
        number, chunk = docs["chunk"][0].as_py(), _read(docs)
        rows = []
        for bucket, own in chunk.asked(buckets):
            anchor = (chunk.anchor[own] // np.uint64(buckets)).astype("<u4")
            rows.append((number, bucket, 0, anchor.tobytes() + chunk.segment[own].astype("<u8").tobytes() + chunk.ids[chunk.doc[own]].astype("<i8").tobytes()))
        return _notes(rows)

    def answer(notes: pa.Table) -> pa.Table:
        blobs = notes["data"].to_pylist()
        sizes = [len(b) // 20 for b in blobs]
        anchor = np.concatenate([np.frombuffer(b, "<u4", n) for b, n in zip(blobs, sizes, strict=True)])
        segment = np.concatenate([np.frombuffer(b, "<u8", n, 4 * n) for b, n in zip(blobs, sizes, strict=True)])
        ids = np.concatenate([np.frombuffer(b, "<i8", n, 12 * n) for b, n in zip(blobs, sizes, strict=True)])
        codes, rows, at = answer_hashes(anchor, segment, ids), [], 0
        for number, bucket, n in zip(notes["chunk"].to_pylist(), notes["bucket"].to_pylist(), sizes, strict=True):
            if (own := codes[at : at + n]).any():
                rows.append((number, bucket, 0, zlib.compress(own.tobytes(), 1)))
            at += n
        return _notes(rows)

    def show(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not len(docs) or not len(notes):
            return _notes([])
        number, chunk = docs["chunk"][0].as_py(), _read(docs)
        codes, _, asked = _codes(chunk, notes, buckets)
        rows = []
        for bucket, own in asked:
            own = own[codes[own] == 1]
            if len(own):
                lengths = (chunk.right[own] - chunk.left[own]).astype("u1")
                data = b"".join([chunk.bytes[a:b].tobytes() for a, b in zip(chunk.left[own].tolist(), chunk.right[own].tolist(), strict=True)])
                rows.append((number, bucket, 1, len(own).to_bytes(4, "little") + lengths.tobytes() + chunk.ids[chunk.doc[own]].astype("<i8").tobytes() + data))
        return _notes(rows)

    def compare(notes: pa.Table) -> pa.Table:
        blobs = notes["data"].to_pylist()
        counts = [int.from_bytes(b[:4], "little") for b in blobs]
        lengths = [np.frombuffer(b, "u1", n, 4).astype(np.int64) for b, n in zip(blobs, counts, strict=True)]
        ids = np.concatenate([np.frombuffer(b, "<i8", n, 4 + n) for b, n in zip(blobs, counts, strict=True)])
        data = np.frombuffer(b"".join([b[4 + 9 * n :] for b, n in zip(blobs, counts, strict=True)]), np.uint8)
        ends = np.cumsum(np.concatenate(lengths))
        starts = np.concatenate([[0], ends[:-1]])
        seen, rows, at = windows_seen_earlier(data, starts, ends, ids), [], 0
        for number, bucket, own in zip(notes["chunk"].to_pylist(), notes["bucket"].to_pylist(), lengths, strict=True):
            n = int((own - MATCH + 1).sum())
            if seen[at : at + n].any():
                rows.append((number, bucket, 1, np.packbits(seen[at : at + n]).tobytes()))
            at += n
        return _notes(rows)

    def remove(docs: pa.Table, notes: pa.Table) -> pa.Table:
        chunk = _read(docs)
        marks = np.zeros(len(chunk.bytes) + 1, np.int32)
        if len(notes):
            codes, bits, asked = _codes(chunk, notes, buckets)
            codes[(chunk.first != np.arange(len(codes))) & (chunk.ids[chunk.doc] > chunk.ids[chunk.doc[chunk.first]])] = 2
            same = chunk.first != np.arange(len(codes))  # repeated rows of the id that asked take over its answer
            same &= codes != 2
            codes[same] = codes[chunk.first[same]]
            gone = np.flatnonzero(codes == 2)
            np.add.at(marks, chunk.left[gone], 1)
            np.add.at(marks, chunk.right[gone], -1)
            seen_at: dict[int, np.ndarray] = {}
            for bucket, own in asked:
                own = own[codes[own] == 1]
                if bucket in bits and len(own):
                    counts = chunk.right[own] - chunk.left[own] - MATCH + 1
                    seen = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=int(counts.sum())).astype(bool)
                    before = np.cumsum(counts) - counts
                    at = np.repeat(chunk.left[own] - before, counts) + np.arange(len(seen))
                    np.add.at(marks, at[seen], 1)
                    np.add.at(marks, at[seen] + MATCH, -1)
                    if same.any():
                        seen_at |= {int(o): seen[b : b + c] for o, b, c in zip(own, before, counts, strict=True)}
            for i in np.flatnonzero(same & (codes == 1)):
                if (seen := seen_at.get(int(chunk.first[i]))) is not None:
                    at = chunk.left[i] + np.flatnonzero(seen)
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + MATCH, -1)
        covered = np.cumsum(marks[:-1]) > 0
        return finish(chunk, covered, docs)

    asks = dealt.groupBy("chunk").applyInArrow(ask, NOTE_SQL)
    answers = asks.groupBy("bucket").applyInArrow(answer, NOTE_SQL)
    shown = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(show, NOTE_SQL)
    compared = shown.groupBy("bucket").applyInArrow(compare, NOTE_SQL)
    return dealt.groupBy("chunk").cogroup(answers.unionByName(compared).groupBy("chunk")).applyInArrow(remove, schema)


DIGESTS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}


def _digests(chunk: Chunk, covered: np.ndarray, docs: pa.Table) -> pa.Table:
    rows = []
    for doc, a, b in zip(chunk.given, chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
        own = covered[a:b]
        spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
        rows.append((doc, b - a, int(own.sum()), spans, hashlib.sha256(chunk.bytes[a:b][~own].tobytes()).hexdigest()))
    return _table(dict(zip(DIGESTS, zip(*rows, strict=True), strict=True)) if rows else {k: [] for k in DIGESTS}, DIGESTS)


def dedup_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return covered_bytes(docs, id_col, text_col, _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup_texts(docs: DataFrame, keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, the remaining text (bytes of characters cut in two go as well) and the columns named in keep."""

    def finish(chunk: Chunk, covered: np.ndarray, docs: pa.Table) -> pa.Table:
        texts = [chunk.bytes[a:b][~covered[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True)]
        rest = {f"kept_{c}": docs[f"kept_{c}"].take(pa.array(chunk.rows, pa.int64())) for c in keep}
        return pa.table({"doc_id": pa.array(chunk.given, pa.int64()), "text": pa.array(texts, pa.string()), **rest})

    kinds = dict(docs.dtypes)
    schema = ", ".join(["doc_id long", "text string", *[f"kept_{c} {kinds[c]}" for c in keep]])
    out = covered_bytes(docs, "doc_id", "text", finish, schema, keep)
    return out.select("doc_id", "text", *[F.col(f"kept_{c}").alias(c) for c in keep])


def op9_previous_factor_dedup(spark, sf_dir):
    return dedup_digests(table(spark, sf_dir, "documents"))
