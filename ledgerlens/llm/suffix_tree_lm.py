"""Scores of texts under a probabilistic suffix tree over words.

A node of the tree is a context of 1 to DEPTH words. A context is a candidate if it makes up a least share of the training tokens,
at any size, so the number of nodes is bounded by that share and not by the corpus; it
stays if the words after it diverge from what its longest kept suffix foretells: the mean log ratio of the two smoothed
distributions over its occurrences, each left out of its own count, must reach DIVERGENCE. A next-word distribution is smoothed by
STRENGTH imagined occurrences, dealt as the longest kept suffix says; the empty context has the add-one distribution of all words. A
token is scored in the state of the longest kept suffix of the words before it.

What is counted grows with the corpus, so no task holds it. Texts are cut into blocks of bounded bytes, stored once as numbers into the block's own
word list and bucketed by block. For each level a block asks with its distinct (context, next word) pairs and what its
training texts count of each; the pairs meet in buckets by context, a context with many occurrences in several buckets by next word;
a bucket adds up, decides which contexts stay, and answers where the sum of a context that stays, or of one that may be a context
itself, differs from what the block knows. The few contexts dealt over several buckets are decided by a sum over these. Words, contexts and pairs travel as 64-bit hashes; two
words of equal hash would count as one symbol in contexts. The counts of single words are by the words themselves.

Defined cases: a null text counts as empty and has the end token alone; a null id is dealt as the empty string, which trains; rows that
repeat are separate rows and count as often; no rows give no rows; without training rows every token is unknown; other columns play no
part. A text longer than a block's bytes is a block of its own.
"""

from __future__ import annotations

import math
import uuid
import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import shared_dir, stored, table, text_or_empty

#: The end token: no word is empty.
END = b""
DEPTH = 2
#: The least share of a context in the training tokens.
MIN_SHARE = 2e-6
STRENGTH = 150.0
#: Nats per occurrence of a context.
DIVERGENCE = 0.02
#: Text bytes of a block, and about as many bytes for each bucket of a level.
BLOCK_BYTES = 8_000_000
#: Occurrences of a context beyond which its next words are dealt over several buckets.
SHARD = 500_000
HELD_OUT = (7, 2)
NOTES = "block long, level int, bucket int, ctx long, gain double, data binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
BLOCKS = "block long, bucket int, doc_ids binary, ids binary, words binary, data binary"


def held_out(id_col: Column, parts: tuple[int, int] = HELD_OUT) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % parts[0] == parts[1]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _pack(*arrays) -> bytes:
    return zlib.compress(b"".join(len(a).to_bytes(8, "little") + a.tobytes() for a in arrays), 1)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    data, at, out = zlib.decompress(data), 0, []
    for kind in kinds:
        n, at = int.from_bytes(data[at : at + 8], "little"), at + 8
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _word_bucket(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


class Numbers(dict):
    """Words with their numbers; a new word takes the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _split(order_by: np.ndarray):
    """(value, places) for each value of order_by, places ascending."""
    order = np.argsort(order_by, kind="stable")
    bounds = [*np.flatnonzero(np.diff(order_by[order], prepend=-1)).tolist(), len(order)]
    for a, b in pairwise(bounds):
        yield int(order_by[order[a]]), order[a:b]


def _heads(ctx: np.ndarray) -> np.ndarray:
    """Where each run of equal contexts begins, and the end of the last."""
    return np.append(np.flatnonzero(np.diff(ctx, prepend=-1)), len(ctx))


def _notes(rows: list[dict]) -> pa.Table:
    kinds = {"block": pa.int64(), "level": pa.int32(), "bucket": pa.int32(), "ctx": pa.int64(), "gain": pa.float64(), "data": pa.binary()}
    return pa.table({k: pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()})


def block_rows(buckets: int, block_bytes: int):
    """Texts to blocks: one row with the block itself, and one a bucket with words and their training counts."""

    def made(block, docs, held, lengths, ids, number_of):
        tokens, words = np.array(ids, np.int32), list(number_of)
        trains = np.repeat(~np.array(held, bool), lengths)
        counts = np.bincount(tokens[trains], minlength=len(words))
        lost = np.array([d is None for d in docs], bool)
        rows = [(block, None, _pack(np.array([d or 0 for d in docs], np.int64), lost, np.array(held, bool), np.array(lengths, np.int64)), _pack(tokens), zlib.compress(b"\n".join(words), 1), None)]
        for bucket, own in _split(_word_bucket(words, buckets)):
            rows.append((block, bucket, None, None, zlib.compress(b"\n".join([words[i] for i in own]), 1), _pack(counts[own])))
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        # One row a batch: a block is some megabytes.
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    def run(batches):
        block, size = TaskContext.get().partitionId() << 32, 0
        docs, held, lengths, ids, number_of = [], [], [], [], Numbers({END: 0})
        for batch in batches:
            for doc, out, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                # Of bytes, lower and split know ASCII letters and the blanks 0x20 and 0x09 to 0x0D only.
                words = text.lower().split()
                ids.extend(map(number_of.__getitem__, words))
                ids.append(0)
                docs.append(doc)
                held.append(out)
                lengths.append(len(words) + 1)
                size += len(text)
                if size >= block_bytes:
                    yield from made(block, docs, held, lengths, ids, number_of)
                    block, size = block + 1, 0
                    docs, held, lengths, ids, number_of = [], [], [], [], Numbers({END: 0})
        if docs:
            yield from made(block, docs, held, lengths, ids, number_of)

    return run


def count_words(notes: pa.Table) -> pa.Table:
    """Adds up the counts of one bucket's words. Row without a block: the bucket's tokens, and in level its number of words."""
    lists = [zlib.decompress(w).split(b"\n") for w in notes["words"].to_pylist()]
    counts = [_unpack(d, "<i8")[0].tolist() for d in notes["data"].to_pylist()]
    total: dict[bytes, int] = {}
    for words, own in zip(lists, counts, strict=True):
        for w, n in zip(words, own, strict=True):
            total[w] = total.get(w, 0) + n
    rows = [{"block": b, "level": 0, "bucket": k, "data": _pack(np.array([total[w] for w in words], np.int64))} for b, k, words in zip(notes["block"].to_pylist(), notes["bucket"].to_pylist(), lists, strict=True)]
    return _notes([*rows, {"level": sum(n > 0 for n in total.values()), "ctx": sum(total.values())}])


@dataclass(frozen=True)
class Tree:
    """What all tasks know of the model: its parameters and the two totals of the training tokens."""

    depth: int = DEPTH
    least: int = 1
    strength: float = STRENGTH
    divergence: float = DIVERGENCE
    shard: int = SHARD
    buckets: int = 1
    tokens: int = 0
    types: int = 0


@dataclass
class Level:
    """The distinct pairs of a block at one level, sorted by context and next word."""

    of_token: np.ndarray  # the pair of each token, or -1
    ctx: np.ndarray  # the number of the context among the pairs (at level 1: the words) one level up
    next: np.ndarray
    ctx_hash: np.ndarray
    ctx_total: np.ndarray
    bucket: np.ndarray
    count: np.ndarray  # in training texts: of the block first, of all blocks once answered
    stays: np.ndarray  # whether the context stays in the tree
    hash: np.ndarray


class Block:
    """One block with the answers that it has got so far, those of `answered` levels."""

    def __init__(self, row: dict, answers: pa.Table, tree: Tree, answered: int):
        self.tree, self.number = tree, row["block"]
        self.doc_ids, self.lost, self.held, self.lengths = _unpack(row["doc_ids"], "<i8", "?", "?", "<i8")
        self.ids = _unpack(row["ids"], "<i4")[0].astype(np.int64)
        words = zlib.decompress(row["words"]).split(b"\n")
        self.trains = np.repeat(~self.held, self.lengths)
        self.count, self.hash = np.zeros(len(words), np.int64), np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        told: dict[tuple[int, int], bytes] = {}
        kept: dict[int, list[int]] = {}
        for level, bucket, ctx, data in zip(*(answers[c].to_pylist() for c in ("level", "bucket", "ctx", "data")), strict=True):
            if data is None:
                kept.setdefault(level, []).append(ctx)
            else:
                told[level, bucket] = data
        for bucket, own in _split(_word_bucket(words, tree.buckets)):
            self.count[own] = _unpack(told[0, bucket], "<i8")[0]
        self.chance = ((self.count + 1) / (tree.tokens + tree.types + 1))[self.ids]
        self.base = np.log10(self.chance)
        self.known = self.count[self.ids] > 0
        self.levels: list[Level] = []
        for k in range(1, answered + 1):
            level = self._pairs()
            self.levels.append(level)
            if k in kept:
                level.stays = np.isin(level.ctx_hash, np.array(kept[k], np.int64).view(np.uint64))
            for bucket, own in _split(level.bucket):
                if (k, bucket) in told:
                    at, n, stays = _unpack(told[k, bucket], "<u4", "<i8", "?")
                    level.count[own[at]] = n
                    level.stays[own] |= np.repeat(stays, np.diff(_heads(level.ctx[own])))
            use = np.append(level.stays, False)[level.of_token]
            pair = level.of_token[use]
            self.chance[use] = (level.count[pair] + tree.strength * self.chance[use]) / (level.ctx_total[pair] + tree.strength)

    def _pairs(self) -> Level:
        """The pairs one level below those known: contexts often enough seen, each with the words after it."""
        above = self.levels[-1] if self.levels else None
        up_of_token, up_count, up_hash = (self.ids, self.count, self.hash) if above is None else (above.of_token, above.count, above.hash)
        ctx = np.full(len(self.ids), -1, np.int64)
        ctx[1:] = np.where(self.ids[:-1] == 0, -1, up_of_token[:-1])
        if len(up_count):
            ctx[(ctx >= 0) & (up_count[ctx] < self.tree.least)] = -1
        at = np.flatnonzero(ctx >= 0)
        key, first, inverse = np.unique(ctx[at] * len(self.hash) + self.ids[at], return_index=True, return_inverse=True)
        of_token = np.full(len(self.ids), -1, np.int64)
        of_token[at] = inverse
        own_ctx, own_next = key // len(self.hash), key % len(self.hash)
        ctx_hash, ctx_total, next_hash = up_hash[own_ctx], up_count[own_ctx], self.hash[own_next]
        shard = next_hash % (1 + ctx_total // self.tree.shard).astype(np.uint64)
        bucket = (mixed(ctx_hash, shard) % np.uint64(self.tree.buckets)).astype(np.int64)
        count = np.bincount(inverse, self.trains[at], len(key)).astype(np.int64)
        self.parent = self.chance[at[first]].astype("<f4")
        return Level(of_token, own_ctx, own_next, ctx_hash, ctx_total, bucket, count, np.zeros(len(key), bool), mixed(ctx_hash, next_hash))

    def asks(self) -> list[dict]:
        """The pairs of the next level, by bucket."""
        level, rows = self._pairs(), []
        for bucket, own in _split(level.bucket):
            bounds = _heads(level.ctx[own])
            runs, heads = np.diff(bounds).astype("<u4"), own[bounds[:-1]]
            data = _pack(level.ctx_hash[heads], level.ctx_total[heads], runs, self.hash[level.next[own]], level.count[own], self.parent[own])
            rows.append({"block": self.number, "level": len(self.levels) + 1, "bucket": bucket, "data": data})
        return rows

    def scores(self) -> pa.Table:
        starts = np.cumsum(self.lengths) - self.lengths
        total = lambda x: np.add.reduceat(x, starts)
        columns = [pa.array(self.doc_ids, pa.int64(), mask=self.lost), pa.array(self.held), pa.array(self.lengths), pa.array(total(self.known.astype(np.int64))), pa.array(total(self.base)), pa.array(total(np.log10(self.chance)))]
        return pa.table(dict(zip([c.split()[0] for c in SCORES.split(", ")], columns, strict=True)))


def count_pairs(tree: Tree):
    """Adds up the pairs of one bucket and decides its contexts. An answer names the pairs whose sum the block doesn't know and needs, their
    sums, and which of its contexts stay. Of a context in several buckets it gives a row without data: its share of the divergence
    sum, once, and a row for every block that asked for it."""

    def run(notes: pa.Table) -> pa.Table:
        blocks, bucket, level = notes["block"].to_pylist(), notes["bucket"][0].as_py(), notes["level"][0].as_py()
        parts = [_unpack(d, "<u8", "<i8", "<u4", "<u8", "<i8", "<f4") for d in notes["data"].to_pylist()]
        heads, totals, runs, nexts, counts, parents = (np.concatenate(x) for x in zip(*parts, strict=True))
        of_head = np.repeat(np.arange(len(heads)), runs)
        ctx = heads[of_head]
        order = np.lexsort((nexts, ctx))
        new = np.flatnonzero(np.append(True, (np.diff(ctx[order]) != 0) | (np.diff(nexts[order]) != 0)))
        sums = np.add.reduceat(counts[order], new)
        total, p = totals[of_head[order[new]]], parents[order[new]].astype(np.float64)
        s = tree.strength
        with np.errstate(divide="ignore", invalid="ignore"):
            shares = np.where(sums > 0, sums * np.log((sums - 1 + s * p) / ((total - 1 + s) * p)), 0.0) / total
        first_of = np.flatnonzero(np.append(True, np.diff(ctx[order[new]]) != 0))
        gains = np.add.reduceat(shares, first_of)
        whole = totals[of_head[order[new[first_of]]]] < tree.shard
        stays = whole & (gains >= tree.divergence)
        group = np.empty(len(ctx), np.int64)  # the context of each asked pair, numbered by first_of
        group[order] = np.repeat(np.repeat(np.arange(len(first_of)), np.diff(np.append(first_of, len(new)))), np.diff(np.append(new, len(order))))
        answer = np.empty(len(ctx), np.int64)
        answer[order] = np.repeat(sums, np.diff(np.append(new, len(order))))
        needed = (answer != counts) & (stays[group] | ~whole[group] | (answer >= tree.least))
        rows, at, told = [], 0, set()
        for block, part in zip(blocks, parts, strict=True):
            n = len(part[3])
            own = group[at : at + n][np.cumsum(part[2]) - part[2]]  # of the block's contexts
            differs = np.flatnonzero(needed[at : at + n])
            if len(differs) or stays[own].any():
                rows.append({"block": block, "level": level, "bucket": bucket, "data": _pack(differs.astype("<u4"), answer[at : at + n][differs], stays[own])})
            for g, h in zip(own[~whole[own]].tolist(), part[0][~whole[own]].view(np.int64).tolist(), strict=True):
                rows.append({"block": block, "level": level, "ctx": h, "gain": 0.0 if g in told else float(gains[g])})
                told.add(g)
            at += n
        return _notes(rows)

    return run


def _bucketed(rows: DataFrame, parts: int) -> DataFrame:
    """Rows stored in as many buckets by block as shuffles have partitions, so that blocks are never shuffled again."""
    spark, name = rows.sparkSession, f"ledgerlens_{uuid.uuid4().hex}"
    rows.repartition(parts, "block").write.bucketBy(parts, "block").option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def suffix_tree_scores(docs: DataFrame, depth: int = DEPTH, least: int | None = None, least_share: float = MIN_SHARE, strength: float = STRENGTH, divergence: float = DIVERGENCE, parts: tuple[int, int] = HELD_OUT, shard: int = SHARD, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every row of docs. Candidate contexts
    occur `least` times, if given, else they make up least_share of the training tokens."""
    text = text_or_empty(text_col)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, -(-size // block_bytes))
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), parts).alias("out"), text.cast("binary").alias("text"))
    made = _bucketed(chosen.mapInArrow(block_rows(buckets, block_bytes), BLOCKS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = stored(made.filter("bucket is not null").select("block", "bucket", "words", "data").groupBy("bucket").applyInArrow(count_words, NOTES))
    tokens, types = counted.filter("block is null").agg(F.sum("ctx"), F.sum("level")).first()
    least = max(1, math.ceil(least_share * (tokens or 0)) if least is None else least)
    tree = Tree(depth, least, strength, divergence, shard, buckets, tokens or 0, types or 0)
    blocks = made.filter("bucket is null").select("block", "doc_ids", "ids", "words")
    answers = counted.filter("block is not null").select("block", "level", "bucket", "ctx", "data")

    def ask(answered: int):
        return lambda block, told: _notes(Block(block.to_pylist()[0], told, tree, answered).asks())

    def score(block: pa.Table, told: pa.Table) -> pa.Table:
        return Block(block.to_pylist()[0], told, tree, depth).scores()

    for level in range(depth):
        asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask(level), NOTES)
        found = stored(asked.groupBy("bucket").applyInArrow(count_pairs(tree), NOTES))
        told = found.filter("data is not null").select("block", "level", "bucket", "ctx", "data")
        gain = F.sum("gain").over(Window.partitionBy("ctx"))
        kept = found.filter("data is null").withColumn("all", gain).filter(F.col("all") >= divergence).select("block", "level", "bucket", "ctx", "data").distinct()
        answers = answers.unionByName(told).unionByName(kept)
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op13_suffix_tree_scores(spark, sf_dir):
    return suffix_tree_scores(table(spark, sf_dir, "documents"))
