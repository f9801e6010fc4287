"""Byte-pair encoding and decoding: a priority queue of merge ranks over a doubly linked list of symbols.

A piece of text starts as a linked list of byte symbols. A heap holds every adjacent pair that has a merge, by rank and then
place; the best is popped, skipped if one of its symbols has changed or gone since (a stale entry), else its right symbol is
unlinked and the two new neighbour pairs are pushed. Decoding concatenates the vocabulary strings of the ids.

Texts are cut at the spaces where no pre-token can cross, and what such a cut yields is kept in a bounded two-generation
cache for the life of the Python worker, as words recur across texts.

Defined cases: a null text counts as empty; the string of a special token becomes its id, as the tokenizer file states; a long
text without spaces is merged as one list, in memory linear in it, and isn't cached; rows that repeat are separate rows; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerlens.llm.common import table, text_or_empty

#: Entries of one generation of a worker's cache, and the longest key that it keeps; together they bound its bytes.
CACHE_ENTRIES = 450_000
LONGEST_KEY = 64
#: Unicode white space.
WHITE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: White space other than spaces and line ends.
OTHER_WHITE = re.compile("[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SAFE_CUT = regex.compile(rf"(?<=[^{WHITE}])(?= [^{WHITE}])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TwoGenerations(dict):
    """A bounded cache: what was used in the last two generations stays, long keys never. make(key) fills a miss."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if isinstance(key, str) and len(key) > LONGEST_KEY:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def cuts(text: str) -> tuple[str, list[str]]:
    """A first substring and the rest, each of the rest after one space that starts it, so that no pre-token crosses a cut."""
    if "  " in text or " \n" in text or "\n " in text or OTHER_WHITE.search(text):
        first, *rest = SAFE_CUT.split(text)
        return first, [x[1:] for x in rest]
    first, *rest = text.split(" ")
    return first, rest


class BytePairCoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        of_letter = {c: b for b, c in letters.items()}
        self.vocabulary = {i: bytes(of_letter[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocabulary |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        #: Rank of a pair under one number, and the id that each rank makes.
        self.ranks, self.made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.after_space = TwoGenerations(lambda word: self._chunk(" " + word))
        self.at_start = TwoGenerations(self._chunk, 10_000)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token. A queue entry is the rank and, in its low bits, the place of the left symbol."""
        ids = [self.byte_ids[b] for b in data]
        n, rank_of, made = len(ids), self.ranks.get, self.made
        if n == 1:
            return ids
        queue, a, bits = [], ids[0], n.bit_length()
        low = (1 << bits) - 1
        for i in range(1, n):
            b = ids[i]
            rank = rank_of(a << 20 | b)
            if rank is not None:
                queue.append(rank << bits | i - 1)
            a = b
        if not queue:
            return ids
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = pop(queue)
            rank, i = entry >> bits, entry & low
            j = right[i]
            if j >= n or ids[i] < 0 or rank_of(ids[i] << 20 | ids[j]) != rank:
                continue  # stale: one of the two symbols was merged since
            ids[i] = merged = made[rank]
            ids[j] = -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                rank = rank_of(merged << 20 | ids[k])
                if rank is not None:
                    push(queue, rank << bits | i)
            h = left[i]
            if h >= 0:
                rank = rank_of(ids[h] << 20 | merged)
                if rank is not None:
                    push(queue, rank << bits | h)
        return [x for x in ids if x >= 0]

    def _chunk(self, chunk: str) -> tuple[str, int, bytes]:
        pieces = PRE_TOKEN.findall(chunk)
        if len(pieces) == 1:
            ids = self.merge(pieces[0].encode())
            return ",".join(map(str, ids)), len(ids), self.decode_bytes(ids)
        # A word before a comma and the like is often known from elsewhere.
        parts = [self.after_space[p[1:]] if p[0] == " " and len(p) > 1 else self.at_start[p] for p in pieces]
        return ",".join([p[0] for p in parts]), sum([p[1] for p in parts]), b"".join([p[2] for p in parts])

    def decode_bytes(self, ids) -> bytes:
        return b"".join([self.vocabulary[i] for i in ids])

    def _plain(self, text: str) -> list[tuple[str, int, bytes]]:
        first, rest = cuts(text)
        parts = list(map(self.after_space.__getitem__, rest))
        if first:
            parts.insert(0, self.at_start[first])
        return parts

    def encoded(self, text: str) -> list[tuple[str, int, bytes]]:
        """For each cut of the text: its ids joined by commas, their number, their decoded bytes."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append((str(self.special[part]), 1, self.vocabulary[self.special[part]]))
            elif part:
                out += self._plain(part)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for x in self.encoded(text) for i in x[0].split(",")]

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_coders: dict[str, BytePairCoder] = {}


def coder(path: str) -> BytePairCoder:
    """One coder a worker and vocabulary."""
    if path not in _coders:
        _coders[path] = BytePairCoder(path)
    return _coders[path]


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text."""
    import pyspark.sql.functions as F

    def run(batches):
        code = coder(path)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids, counts, data = zip(*code.encoded(text), strict=True) if text else ((), (), ())
                ids = ",".join(ids)
                decoded = b"".join(data).decode("utf-8", "replace")
                rows.append((sum(counts), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            n, i, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_heap_bpe_roundtrip(spark, sf_dir):
    return round_trips(table(spark, sf_dir, "documents"), default_vocabulary())
