"""Packing of documents into sequences of bounded length by swap-based local search.

Token counts come from the tokenizer; only documents over the capacity are cut. Pieces are dealt into blocks of bounded
size by a hash of their id and each block is packed on its own. Next fit gives a quick start, about a third above the least number
of bins; the search does the rest: the fullest underfull bin is filled by moves, one-for-one and two-for-one exchanges out of
less full ones, each of which increases the sum of squared fills, until none is left; then the next one. Emptied bins go. This is
repeated until a sweep over all underfull bins changes nothing. Bins of a block that aren't nearly full are dealt anew into
blocks of the same bounded size and packed once more.

Defined cases: a null text counts as empty and takes the closing id alone; rows with equal ids are packed as separate
documents; a very long text becomes as many full pieces as it fills and one more; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.bpe import OTHER_WHITE, TwoGenerations, byte_letters, cuts, default_vocabulary
from ledgerlens.llm.common import stored, table, text_or_empty

CAPACITY = 2048
CLOSING_ID = 0
#: Pieces of one block; bounds the memory and time of a packing task.
BLOCK_PIECES = 10_000
#: Bins filled less than this share after the first round are opened again.
NEARLY_FULL = 0.95
#: A word that is one pre-token, of Latin, Greek or Cyrillic letters of every Unicode version, and one sign behind it that is another.
PLAIN_WORD = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u021f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u04ce]+)([.,;:!?)]?)")
#: Fixed value: ASCII signs of which every run is one pre-token; an apostrophe may begin another kind.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: What a tokenizer file must say for words to go to its model without the pre-tokenizer.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


_token_id = attrgetter("id")


def has_odd_white(text: str) -> bool:
    """White space beside white space, or such other than spaces and line ends."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text:
        return True
    return not text.isascii() and OTHER_WHITE.search(text) is not None


class TokenCounter:
    """Ids by the tokenizers library. A text is cut before words where no pre-token crosses the cut, and what the library makes of
    each cut is kept in a bounded cache, as words recur; texts with the string of a special token go to it whole. A word of letters is
    known to be one pre-token, so it goes to the library's model at once, in less time."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = spec["normalizer"] is None and {k: (spec["pre_tokenizer"] or {}).get(k, True) for k in BYTE_LEVEL} == BYTE_LEVEL
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.signs = TwoGenerations(self.whole, 10_000)
        self.plain = plain
        self.line_end = self.whole("\n")
        self.space = self.letters[32]
        self.after_space = TwoGenerations(self.spaced)
        self.at_start = TwoGenerations(self.word, 50_000)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def modelled(self, spelled: str) -> bytes:
        """Ids of one pre-token in the model's letters."""
        return array("I", map(_token_id, self.model.tokenize(spelled))).tobytes()

    def spaced(self, word: str) -> bytes:
        """whole(" " + word). Most words are ASCII letters and a run of signs or none behind them, two pre-tokens at most."""
        letters = word.rstrip(SIGNS)
        if not (self.plain and letters.isalpha() and word.isascii()):
            return self.word(" " + word)
        ids = self.modelled(self.space + letters)
        return ids if len(letters) == len(word) else ids + self.signs[word[len(letters) :]]

    def word(self, word: str) -> bytes:
        """whole(word), by the model where the word is plain."""
        parts = PLAIN_WORD.fullmatch(word) if self.plain else None
        if not parts:
            return self.whole(word)
        spelled = parts[1].replace(" ", self.letters[32]) if word.isascii() else parts[1].encode().decode("latin-1").translate(self.letters)
        return self.modelled(spelled) + (self.signs[parts[2]] if parts[2] else b"")

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the text."""
        if any(s in text for s in self.special):
            return self.whole(text)
        # A line end between two other signs is a pre-token of its own.
        if self.plain and not has_odd_white(text):
            return self.line_end.join([self._joined(*line.split(" ", 1)) for line in text.split("\n")])
        first, rest = cuts(text)
        return self._ids(first, rest)

    def _joined(self, first: str, rest: str | None = None) -> bytes:
        return self._ids(first, () if rest is None else rest.split(" "))

    def _ids(self, first: str, rest) -> bytes:
        return (self.at_start[first] if first else b"") + b"".join(map(self.after_space.__getitem__, rest))


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def pieces_of(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: cuts of every document; the first piece takes the rest."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = counter(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = count.ids(text) + CLOSING_ID.to_bytes(4, "little")
                n = len(ids) // 4
                start, end, piece = 0, n % capacity or min(n, capacity), 0
                while start < n:
                    rows.append((doc, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    start, end, piece = end, end + capacity, piece + 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def next_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item goes into the last bin if it fits, else into a new one."""
    bins: list[list[int]] = []
    room = 0
    for i, n in enumerate(lengths):
        if n > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= n
    return bins


class Stock:
    """The items of open bins by length, with the stocked lengths as bits: bit s of sizes, bit capacity - s of mirrored."""

    def __init__(self, size: list[int], capacity: int):
        self.size, self.capacity, self.held, self.sizes, self.mirrored = size, capacity, {}, 0, 0

    def put(self, item: int) -> None:
        s = self.size[item]
        self.held.setdefault(s, {})[item] = None
        self.sizes |= 1 << s
        self.mirrored |= 1 << (self.capacity - s)

    def take(self, item: int) -> None:
        s = self.size[item]
        del self.held[s][item]
        if not self.held[s]:
            self.sizes &= ~(1 << s)
            self.mirrored &= ~(1 << (self.capacity - s))

    def longest(self, most: int) -> int:
        """The largest stocked length up to most, or -1."""
        return (self.sizes & ((2 << most) - 1)).bit_length() - 1

    def item(self, length: int, but: int | None = None) -> int | None:
        return next((i for i in self.held[length] if i != but), None)

    def pairs(self, total: int):
        """Two items whose lengths add up to total: for each way one pair, the longest first item first."""
        ways = self.sizes & (self.mirrored >> (self.capacity - total)) if total <= self.capacity else 0
        while ways and 2 * (longer := ways.bit_length() - 1) >= total:
            ways ^= 1 << longer
            one = next(iter(self.held[longer]))
            other = next(iter(self.held[total - longer])) if 2 * longer != total else self.item(longer, one)
            if other is not None:
                yield one, other


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins after moves and exchanges between underfull bins, each raising the sum of squared fills, until none is left."""
    size = [int(n) for n in lengths]
    bins = [list(b) for b in bins]
    fill = [sum(size[i] for i in b) for b in bins]
    while _sweep(bins, fill, size, capacity):
        pass
    return [b for b in bins if b]


def _sweep(bins: list[list[int]], fill: list[int], size: list[int], capacity: int) -> bool:
    """Fill each underfull bin, the fullest first, out of those that are still open; whether anything changed."""
    stock, where, closed, changed = Stock(size, capacity), {}, set(), False
    queue = [(-f, b) for b, f in enumerate(fill) if 0 < f < capacity]
    for _, b in queue:
        for i in bins[b]:
            where[i] = b
            stock.put(i)
    heapq.heapify(queue)

    def shift(item: int, to: int) -> None:
        bins[where[item]].remove(item)
        fill[where[item]] -= size[item]
        bins[to].append(item)
        fill[to] += size[item]
        where[item] = to

    def one_for_one(target: int, room: int):
        """(gain, item out, items in) of the best exchange."""
        options = ((stock.longest(s + room) - s, i) for s, i in {size[i]: i for i in bins[target]}.items())
        gain, out = max(options, key=lambda x: x[0], default=(0, None))
        return (gain, out, (stock.item(size[out] + gain),)) if gain > 0 else (0, None, ())

    def two_for_one(target: int, room: int, least: int):
        """The first exchange of the largest gain above least whose displaced item fits and that raises the squared fill."""
        own = {size[i]: i for i in bins[target]}.items()
        for gain in range(room, least, -1):
            for s, out in own:
                for one, other in stock.pairs(s + gain):
                    a, b = where[one], where[other]
                    filled = fill[a] - size[one] + s - (size[other] if a == b else 0)
                    raised = (fill[target] + gain) ** 2 - fill[target] ** 2 + filled**2 - fill[a] ** 2
                    raised += (fill[b] - size[other]) ** 2 - fill[b] ** 2 if a != b else 0
                    if filled <= capacity and raised > 0:
                        return gain, out, (one, other)
        return 0, None, ()

    while queue:
        known, target = heapq.heappop(queue)
        if target in closed or not fill[target]:
            continue
        if -known != fill[target]:
            heapq.heappush(queue, (-fill[target], target))
            continue
        closed.add(target)
        for i in bins[target]:
            stock.take(i)
        while (room := capacity - fill[target]) > 0:
            if (length := stock.longest(room)) >= 0:
                item = stock.item(length)
                stock.take(item)
                shift(item, target)
                changed = True
                continue
            gain, out, into = one_for_one(target, room)
            if gain < room:
                better = two_for_one(target, room, gain)
                gain, out, into = better if better[0] else (gain, out, into)
            if not gain:
                break
            home = where[into[0]]
            for item in into:
                stock.take(item)
                shift(item, target)
            shift(out, home)
            stock.put(out)
            heapq.heappush(queue, (-fill[home], home))
            changed = True
    return changed


def pack_block(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(next_fit(lengths.tolist(), capacity), lengths, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """pieces with sequence_id and offset. pieces must give the same rows whenever it is read."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def packer(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(keys, kind="stable").reset_index(drop=True)
            bins = pack_block(pdf["length"].to_numpy(), capacity)
            of, place, full = np.zeros(len(pdf), int), np.zeros(len(pdf), int), np.zeros(len(pdf), bool)
            sizes = pdf["length"].to_numpy()
            for number, b in enumerate(bins):
                at = 0
                for i in b:
                    of[i], place[i] = number, at
                    at += sizes[i]
                full[b] = at >= NEARLY_FULL * capacity
            block = int(pdf["block"].iloc[0])
            return pdf[keys].assign(sequence_id=((2 * block + level) << 24) + of, offset=place, full=full)

        return run

    def blocked(df: DataFrame, rows: int, salt: int) -> DataFrame:
        blocks = max(1, -(-rows // block_pieces))
        return df.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(salt)), F.lit(blocks)))

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, full boolean"
    first = stored(blocked(pieces, pieces.count(), 1).groupBy("block").applyInPandas(packer(0), kinds))
    loose = first.filter("not full").select(*keys)
    again = blocked(loose, loose.count(), 2).groupBy("block").applyInPandas(packer(1), kinds)
    return first.filter("full").drop("full").unionByName(again.drop("full"))


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(stored(pieces_of(docs, path or default_vocabulary(), capacity, id_col, text_col)), capacity)


def op4_swap_search_packing(spark, sf_dir):
    return packed_documents(table(spark, sf_dir, "documents"))
