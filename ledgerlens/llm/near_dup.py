"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive lower-cased words (runs of anything but blanks and control characters). Its weight is its count in
the text times its idf, 1 + ln((N + 1) / (df + 1)) / ln(N + 1) in steps of 1 / IDF_STEPS, where df counts all texts that have it. The
idf so lies between 1 and 2: what makes a group of copies alike keeps weight however large the group is.

1. Texts are dealt into chunks of bounded size. A chunk asks the bucket of each shingle hash, with the number of its own
   texts that have it; the bucket adds up the document frequencies and answers with idf steps. The chunk attaches them to
   its texts, one byte a shingle, and draws SAMPLES consistent weighted samples a text: two texts agree in one with a
   probability equal to their weighted Jaccard similarity. BANDS groups of ROWS samples are the buckets of a text.
2. Equal shingle sequences are one node. The members of each bucket are dealt into blocks of bounded size, together with
   the bucket's first member; inside a block all pairs are verified exactly at once, by sums over the shingles that several
   members have. Only links that unite something come out; they give components.
3. A bucket of several blocks that still holds several components: members outside its largest component meet, block by
   block, each other and those of the largest one. Members of one component aren't compared again.
4. Components of all links, by alternating large-star and small-star steps until nothing changes, are the classes.

A pair at the threshold shares no bucket with a probability of 0.0008; all else is exact.

Defined cases: a null text counts as empty; texts of fewer than five words have one shingle of all their words; texts without
words are classes of their own; a class is named by its smallest id; rows with equal ids and different texts are judged
each; null ids are rows of class null, linked to nothing; a very long text is one entry of its block, which ends at
BLOCK_BYTES; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, small, stored, table, text_or_empty

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
SAMPLES = BANDS * ROWS
IDF_STEPS = 8
#: Bytes of text in a chunk and, about, of texts whose shingle hashes meet in one task; bound the memory of a task.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 24 << 20
#: Members and bytes of text that are compared with each other in one go.
BLOCK_MEMBERS = 800
BLOCK_BYTES = 8 << 20
#: Bytes of text and numbers of the sketch that one step works on.
SLICE = 1 << 18
SKETCH_CELLS = 1 << 16

_rng = np.random.default_rng(7919)
_odd = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER, _PLACES, _SEEDS = _odd(256), _odd(max(SHINGLE_WORDS, ROWS)), _odd(SAMPLES)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_TAIL = np.uint64((1 << 44) - 1)


def _score_table() -> np.ndarray:
    """For each idf step and each of 65,536 draws (r, c, beta) the rank of ln a = ln c - r (t - beta + 1), t = floor(ln w / r + beta).
    Equal ranks mean equal draws and levels t, so a rank and a shingle are a consistent weighted sample."""
    gamma = lambda: -np.log(_rng.random(1 << 16)) - np.log(_rng.random(1 << 16))
    r, c, beta = gamma(), gamma(), _rng.random(1 << 16)
    w = 1 + np.arange(IDF_STEPS + 1)[:, None] / IDF_STEPS
    t = np.floor(np.log(w) / r + beta)
    ranks = np.unique(np.log(c) - r * (t - beta + 1), return_inverse=True)[1]
    return ranks.astype(np.uint64).ravel() << np.uint64(44)


_SCORES = _score_table()


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def _slice_shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts between bounds, in order, and how many each text has."""
    n, k = len(data), SHINGLE_WORDS
    solid = data > 32
    before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    before[1:], after[:-1] = solid, solid
    before[bounds], after[bounds] = False, False  # texts end words
    starts, ends = np.flatnonzero(solid & ~before[:-1]), np.flatnonzero(solid & ~after[1:]) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[data] * _power(_BASE, n), out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts])
    first = np.searchsorted(starts, bounds)
    m = np.diff(first)
    counts = np.where(m >= k, m - k + 1, np.minimum(m, 1))
    out = np.empty(int(counts.sum()), np.uint64)
    if len(words) >= k:
        grams = np.full(len(words) - k + 1, k, np.uint64)
        for j in range(k):
            grams += words[j : j + len(grams)] * _PLACES[j]
        within = np.ones(len(grams), bool)
        for back in range(1, k):
            over = first[1:] - back
            within[over[(over >= 0) & (over < len(grams))]] = False
        out[np.repeat(m >= k, counts)] = _mix(grams[within])
    at = np.cumsum(counts) - counts
    for i in np.flatnonzero((m > 0) & (m < k)).tolist():
        own = words[first[i] : first[i + 1]]
        out[at[i]] = _mix((own * _PLACES[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))[0]
    return out, counts


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and the place of each text's first one (and the end)."""
    lower = pc.utf8_lower(texts)
    n = len(lower)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(lower.type)
    offsets = np.frombuffer(lower.buffers()[1], np.int64 if wide else np.int32)[lower.offset : lower.offset + n + 1].astype(np.int64)
    body = lower.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    grams, counts, a = [], [], 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        g, c = _slice_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        grams.append(g)
        counts.append(c)
        a = b
    return np.concatenate(grams), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def elements(grams: np.ndarray) -> np.ndarray:
    """One number an occurrence: repeats of a shingle differ, so a set of them counts as a multiset of shingles."""
    ordered = np.sort(grams)
    if not (ordered[1:] == ordered[:-1]).any():
        return grams
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    place = np.arange(len(grams))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ordered[1:] != ordered[:-1]]), place, 0))
    turn = (place - first).astype(np.uint64)
    out = np.empty_like(grams)
    out[order] = np.where(turn > 0, _mix(ordered + turn * np.uint64(_BASE)), ordered)
    return out


def sketch(own: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """SAMPLES 64-bit values, each a shingle occurrence and the level that a consistent weighted sample picks."""
    out, tail, offset = np.empty(SAMPLES, np.uint64), own & _TAIL, steps.astype(np.uint64) << np.uint64(16)
    step = max(1, SKETCH_CELLS // len(own))
    for j in range(0, SAMPLES, step):
        x = own * _SEEDS[j : j + step, None]
        x >>= np.uint64(48)
        x += offset
        key = _SCORES.take(x.view(np.int64))
        key |= tail
        out[j : j + step] = key.min(1)
    return out


def idf_steps(frequency: np.ndarray, n_texts: int) -> np.ndarray:
    """The idf of shingles above 1, in steps."""
    n = max(1, n_texts)
    return np.rint(IDF_STEPS * np.clip(np.log((n + 1) / (frequency + 1)) / np.log(n + 1), 0, 1)).astype(np.uint8)


NOTE = {"chunk": pa.int32(), "bucket": pa.int32(), "data": pa.binary(), "counts": pa.binary()}
NOTE_SQL = "chunk int, bucket int, data binary, counts binary"


def _rows(rows: list[tuple], kinds: dict) -> pa.Table:
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), zip(*rows, strict=True) if rows else [()] * len(kinds), strict=True)})


def sketched(texts: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, text, steps (one byte a shingle), node_key and buckets of every text; the last two null for
    texts without words and null ids."""
    total = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_texts, size = total["n"], total["bytes"] or 0
    chunks, buckets = max(1, -(-size // CHUNK_BYTES)), max(1, -(-size // BUCKET_BYTES))
    dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(chunks)).cast("int"))
    usual = idf_steps(np.ones(1), n_texts)[0]

    def known(docs: pa.Table):
        """Shingles of the chunk's texts, the number of each among the distinct ones, these in order, how many texts have each, and
        where each bucket's begin."""
        grams, bounds = shingles(docs["text"].combine_chunks())
        order = np.argsort(grams, kind="stable")
        ordered, who = grams[order], np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        other = new.copy()
        other[1:] |= who[1:] != who[:-1]
        own, number = ordered[new], np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        counts = np.add.reduceat(other, np.flatnonzero(new), dtype=np.int64) if len(order) else np.zeros(0, np.int64)
        edges = np.searchsorted(((own >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        return grams, bounds, number, own, counts, edges

    def ask(docs: pa.Table) -> pa.Table:
        number, (_, _, _, own, counts, edges) = docs["chunk"][0].as_py(), known(docs)
        rows = []
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[bucket], edges[bucket + 1]
            rows.append((number, bucket, own[a:b].astype("<u4").tobytes(), zlib.compress(counts[a:b].astype("<u4").tobytes(), 1)))
        return _rows(rows, NOTE)

    def answer(notes: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u4") for x in notes["data"].to_pylist()]
        counts = np.concatenate([np.frombuffer(zlib.decompress(x), "<u4") for x in notes["counts"].to_pylist()])
        at = np.unique(np.concatenate(parts), return_inverse=True)[1]
        steps, rows, a = idf_steps(np.bincount(at, counts), n_texts)[at], [], 0
        for number, bucket, part in zip(notes["chunk"].to_pylist(), notes["bucket"].to_pylist(), parts, strict=True):
            own = steps[a : a + len(part)]
            a += len(part)
            if (own != usual).any():
                rows.append((number, bucket, zlib.compress(own.tobytes(), 1), None))
        return _rows(rows, NOTE)

    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "text": pa.string(), "steps": pa.binary(), "node_key": pa.binary(), "buckets": pa.list_(pa.int64())}

    def attach(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not len(docs):
            return _rows([], kinds)
        number, (grams, bounds, place, own, _, edges) = docs["chunk"][0].as_py(), known(docs)
        of_own = np.full(len(own), usual, np.uint8)
        for bucket, data in zip(notes["bucket"].to_pylist(), notes["data"].to_pylist(), strict=True):
            of_own[edges[bucket] : edges[bucket + 1]] = np.frombuffer(zlib.decompress(data), np.uint8)
        steps = of_own[place]
        keys, found, levels = [], [], []
        for doc, a, b in zip(docs["doc_id"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            levels.append(steps[a:b].tobytes())
            if a == b or doc is None:
                keys.append(None), found.append(None)
                continue
            keys.append(hashlib.blake2b(grams[a:b].tobytes(), digest_size=16).digest())
            values = _mix(sketch(elements(grams[a:b]), steps[a:b]))
            found.append(_mix(sum((values[j::ROWS] * _PLACES[j] for j in range(ROWS)), np.arange(BANDS, dtype=np.uint64))).view(np.int64).tolist())
        rows = (np.int64(number) << 32) + np.arange(len(docs))
        columns = [rows, docs["doc_id"].combine_chunks(), docs["text"].combine_chunks(), levels, keys, found]
        return pa.table({k: pa.array(c, t) if isinstance(c, (list, np.ndarray)) else c.cast(t) for (k, t), c in zip(kinds.items(), columns, strict=True)})

    asks = dealt.groupBy("chunk").applyInArrow(ask, NOTE_SQL)
    answers = asks.groupBy("bucket").applyInArrow(answer, NOTE_SQL)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(attach, "row long, doc_id long, text string, steps binary, node_key binary, buckets array<long>")


def similarities(members: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs of members (elements, weights): sums over the elements that several have."""
    n = len(members)
    mass = np.array([w.sum() for _, w in members])
    every = np.concatenate([e for e, _ in members])
    who = np.repeat(np.arange(n), [len(e) for e, _ in members])
    order = np.argsort(every)
    every = every[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    several = np.bincount(column) > 1
    number = np.cumsum(several) - 1
    held = several[column]
    who, column, weight = who[order][held], number[column[held]], np.concatenate([w for _, w in members])[order][held]
    both = np.zeros((n, n))
    width = max(1, min(int(several.sum()), (1 << 21) // n))
    edges = np.searchsorted(column, np.arange(0, int(several.sum()) + width, width))
    for at, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        ones = np.zeros((n, width))
        roots = np.zeros((n, width))
        ones[who[a:b], column[a:b] - at * width] = 1
        roots[who[a:b], column[a:b] - at * width] = weight[a:b]
        both += roots @ ones.T
    either = mass[:, None] + mass[None, :] - both
    return np.where(either > 0, both / np.where(either > 0, either, 1), 0)


def uniting(near: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs that are near, those that unite members of different roots; root takes over what they unite."""
    out = []
    for i in range(len(root) - 1):
        later = np.flatnonzero(near[i, i + 1 :]) + i + 1
        later = later[root[later] != root[i]]
        while len(later):
            j = int(later[0])
            out.append((i, j))
            root[root == root[j]] = root[i]
            later = later[root[later] != root[i]]
    return out


def linked(seats: DataFrame) -> DataFrame:
    """Links a, b inside each group (key, part) of seats (key, part, node, class, text, steps) that unite classes."""
    links = {"a": pa.int64(), "b": pa.int64()}

    def run(batches):
        waiting, of = [], None

        def decide():
            if len({m[1] for m in waiting}) < 2:
                return []
            near = similarities([m[2:] for m in waiting]) >= THRESHOLD
            root = np.unique([m[1] for m in waiting], return_inverse=True)[1]
            return [(waiting[i][0], waiting[j][0]) for i, j in uniting(near, root)]

        for batch in batches:
            rows, columns = [], batch.to_pydict()
            grams, bounds = shingles(batch.column(batch.schema.get_field_index("text")))
            for i, group in enumerate(zip(columns["key"], columns["part"], strict=True)):
                if group != of:
                    rows += decide()
                    waiting, of = [], group
                steps = np.frombuffer(columns["steps"][i], np.uint8)
                waiting.append((columns["node"][i], columns["class"][i], elements(grams[bounds[i] : bounds[i + 1]]), 1 + steps / IDF_STEPS))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), ()), links.values(), strict=True)], names=list(links))
        rows = decide()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), links.values(), strict=True)], names=list(links))

    dealt = seats.select("key", "part", "node", "class", "text", "steps").repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return dealt.mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, class (its smallest node) of every node on a link (a, b), by large-star and small-star steps until nothing changes."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut(hung.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("h")).first()
        if state == before:
            break
        before = state
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
    return stars.unionByName(stars.select(F.col("class").alias("node"), "class").distinct())


def _seated(members: DataFrame) -> DataFrame:
    """key, part, node of the members (bucket, node, bytes) of buckets that several nodes share: blocks of bounded size, and the
    bucket's first node in each of them. Of buckets with the same members only one counts."""
    size = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_MEMBERS)), F.ceil(F.sum("bytes") / F.lit(BLOCK_BYTES))).cast("int")
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min("node").alias("head"), size.alias("parts")).filter("n > 1")
    kept = shared.groupBy("n", "x", "y").agg(F.min_by(F.struct("bucket", "head", "parts"), "bucket").alias("s")).select("s.*")
    placed = members.join(kept, "bucket").select(F.col("bucket").alias("key"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "parts")
    heads = kept.filter("parts > 1").select(F.col("bucket").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("head").alias("node"), "parts")
    return placed.unionByName(heads.join(placed.select("key", "part", "node"), ["key", "part", "node"], "left_anti"))


def _apart(seats: DataFrame, found: DataFrame) -> DataFrame:
    """key, part, node, class for buckets of several blocks that hold several classes: blocks of members outside the largest class
    meet each other and blocks of the largest one."""
    wide = seats.filter("parts > 1").select("key", "node").distinct()
    placed = wide.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("key", "node", F.coalesce("class", "node").alias("class"))
    sizes = placed.groupBy("key", "class").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("class", F.struct("n", "class")).alias("big"), F.max("n").alias("n_big"), F.sum("n").alias("n_all")).filter("n_big < n_all")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK_MEMBERS)).cast("int")
    split = placed.join(largest, "key").withColumn("few", blocks(F.col("n_all") - F.col("n_big"))).withColumn("many", blocks(F.col("n_big"))).withColumn("rest", F.col("class") != F.col("big"))
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("rest"), F.col("few")).otherwise(F.col("many"))).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    name = lambda kind, a, b: F.concat_ws("/", F.lit(kind), a, b)
    among = F.transform(numbers(F.col("few")), lambda i: name("rest", F.least(i, F.col("own")), F.greatest(i, F.col("own"))))
    across = F.transform(numbers(F.col("many")), lambda i: name("big", F.col("own"), i))
    of_big = F.transform(numbers(F.col("few")), lambda i: name("big", i, F.col("own")))
    return split.withColumn("own", own).select("key", "node", "class", F.explode(F.when(F.col("rest"), F.concat(among, across)).otherwise(of_big)).alias("part"))


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), class_no (a number of its own; null for a class of one row), class_id of every row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    drawn = stored(sketched(texts))
    nodes = stored(drawn.filter("node_key is not null").groupBy("node_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")))
    narrow = drawn.filter("node_key is not null").select(F.col("row").alias("node"), "buckets", F.octet_length("text").alias("bytes"))  # before the join: texts aren't shuffled
    members = stored(narrow.join(nodes.select("node"), "node", "left_semi").select("node", F.explode("buckets").alias("bucket"), "bytes"))
    seats = stored(_seated(members))
    wanted = seats.select(F.col("node").alias("row")).distinct()
    bodies = stored(drawn.select("row", "text", "steps").join(small(wanted, wanted.count()), "row", "left_semi")).withColumnRenamed("row", "node")
    links = stored(linked(seats.withColumn("class", F.col("node")).join(bodies, "node")))
    found = components(links)
    apart = stored(_apart(seats, found))
    if not apart.isEmpty():
        more = stored(linked(apart.join(bodies, "node")))
        if not more.isEmpty():
            found = components(links.unionByName(more))
    of_node = nodes.join(found.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("node_key", "least", F.coalesce("class", "node").alias("class_no"))
    names = of_node.groupBy("class_no").agg(F.min("least").alias("class_id"))
    named = of_node.join(names, "class_no").select("node_key", "class_no", "class_id")
    rows = drawn.select("doc_id", F.xxhash64("text").alias("text_hash"), "node_key")
    return rows.join(named, "node_key", "left").select("doc_id", "text_hash", "class_no", F.coalesce("class_id", "doc_id").alias("class_id"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest id of its class) of every row of docs."""
    return classified(docs, id_col, text_col).select("doc_id", "class_id")


def op8_weighted_minhash_classes(spark, sf_dir):
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
