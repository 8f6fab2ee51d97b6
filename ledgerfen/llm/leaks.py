"""Evaluation texts leaking into training text, by greedy string tiling.

Texts become lists of words (``words``); the items' vocabulary gives each word a number, and other words have none. Seeds are
runs of ``min_match`` words, compared by Karp-Rabin hashes of the whole batch at once. For each document and item that share
enough seeds, the longest match of unmarked words is marked again and again, until none of ``min_match`` words is left
(``tile``): so passages are found in whatever order they stand. The tiles' words, held against the item's, are the coverage;
the item's words in any common seed bound it, so that most pairs are left out before they are tiled.

The items are the smaller side. They are taken in blocks of at most ``BLOCK_WORDS`` words, each of which is broadcast, indexed
once a worker and held against all documents in one narrow pass; with several blocks the documents' words are written down
first. No document is shuffled and no pair is made without a shared seed.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .spread import slices, spread

#: Words of the items in a block: a broadcast of about 100 MB at the most.
BLOCK_WORDS = 1_000_000

_INVISIBLE = regex.compile(r"[\p{Cf}--\u00ad]+", regex.V1)
_BROKEN = re.compile(r"(?<=[^\W_])[-\u00ad\u2010\u2011]\s*\n\s*(?=[^\W_])")
_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]+")
_ASIDE = re.compile(r"\([^()\[\]]*\)|\[[^()\[\]]*\]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text: runs of letters and digits, without case, accents and invisible characters.

    A word broken by a hyphen at a line end is put together; what stands in ( ) or [ ], nested too, is left out; brackets
    without their partner are punctuation. Null and empty texts have no words.
    """
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if text.isascii():
        text = text.lower()
    else:
        folded = unicodedata.normalize("NFKD", text).casefold()
        text = _MARKS.sub("", unicodedata.normalize("NFKD", folded))
    while "(" in text or "[" in text:
        text, n = _ASIDE.subn(" ", text)
        if not n:
            break
    return _WORD.findall(text)


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """The tiles (doc start, item start, length) of two lists of word numbers, longest first.

    Negative numbers match nothing. Among the longest matches the first in the document, then in the item, is taken. Tiles
    overlap neither in the document nor in the item. Only maximal matches are looked at, each once, so long runs of the same
    words cost as many steps as they have words, not as many as there are pairs of them.
    """
    if min(len(doc), len(item)) < min_match:
        return []
    # words that match nothing are all different
    d = np.where(doc < 0, -2 - np.arange(len(doc)), doc)
    e = np.where(item < 0, -2 - len(doc) - np.arange(len(item)), item)
    starts = _match_starts(d, e, min_match)
    lengths = _common_lengths(d, e, *starts)
    queue = [(-k, i, j) for i, j, k in zip(starts[0].tolist(), starts[1].tolist(), lengths.tolist()) if k >= min_match]
    heapq.heapify(queue)
    tiles, doc_left, item_left = [], len(d), len(e)
    doc_marked, item_marked = bytearray(len(d)), bytearray(len(e))
    while queue and min(doc_left, item_left) >= min_match:
        k, i, j = heapq.heappop(queue)
        k = -k
        if doc_marked.find(1, i, i + k) < 0 and item_marked.find(1, j, j + k) < 0:
            if not np.array_equal(d[i : i + k], e[j : j + k]):  # hashes that met by chance
                k = int(np.argmax(d[i : i + k] != e[j : j + k]))
                if k >= min_match:
                    heapq.heappush(queue, (-k, i, j))
                continue
            tiles.append((i, j, k))
            doc_marked[i : i + k] = item_marked[j : j + k] = b"\1" * k
            doc_left, item_left = doc_left - k, item_left - k
            continue
        # what earlier tiles have left of the match comes up again with its own length
        marked = np.frombuffer(doc_marked, np.uint8)[i : i + k] | np.frombuffer(item_marked, np.uint8)[j : j + k]
        edges = np.flatnonzero(np.diff(np.concatenate([[1], marked, [1]])))
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= min_match:
                heapq.heappush(queue, (a - b, i + a, j + a))
    return tiles


_BASE = 0x9E3779B97F4A7C15


def _hashes(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes modulo 2**64 of all runs of ``k`` numbers, and whether a run is free of negative ones."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    x, total = (ids + 1).astype(np.uint64), np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(_BASE) + x[i : i + n]
    bad = np.concatenate([[0], np.cumsum(ids < 0)])
    return total, bad[k:] == bad[:-k]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the ranges [lo, hi), and the number of the range of each."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), of


def _match_starts(d: np.ndarray, e: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``d``, in ``e``) where runs of ``k`` words have equal hashes and the words before differ, in order."""
    hd, he = _hashes(d, k)[0], _hashes(e, k)[0]
    n, m = len(hd), len(he)
    seeds = np.unique(he)
    of_e = np.searchsorted(seeds, he)
    of_d = np.minimum(np.searchsorted(seeds, hd), len(seeds) - 1)
    at = np.flatnonzero(seeds[of_d] == hd)
    # the word before, as a number from 0; there is none at the beginnings, which equals no word
    low = min(d.min(), e.min())
    before = np.unique(np.concatenate([[low - 1], d[: n - 1], [low - 2], e[: m - 1]]), return_inverse=True)[1]
    count = int(before.max()) + 1
    place = of_e * count + before[n:]
    order = np.argsort(place, kind="stable")
    place = place[order]
    group, own = of_d[at] * count, of_d[at] * count + before[at]
    # of the item's places with the same seed those before and after the ones with the same word before
    edge = lambda x: np.searchsorted(place, x, "left")
    left, of_left = _ranges(edge(group), edge(own))
    right, of_right = _ranges(edge(own + 1), edge(group + count))
    i, j = at[np.concatenate([of_left, of_right])], order[np.concatenate([left, right])]
    return i, j


def _common_lengths(d: np.ndarray, e: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words are the same from each pair of places on, by hashes of runs of 1, 2, 4 and so on words."""
    tables, power, size = [], _BASE, 1
    hd, he = (d + 1).astype(np.uint64), (e + 1).astype(np.uint64)
    while True:
        tables.append((size, hd, he))
        if 2 * size > min(len(d), len(e)):
            break
        hd, he = (h[:-size] * np.uint64(power) + h[size:] for h in (hd, he))
        power, size = power * power % 2**64, 2 * size
    out = np.zeros(len(i), np.int64)
    for size, hd, he in reversed(tables):
        at = np.flatnonzero((i + out < len(hd)) & (j + out < len(he)))
        same = at[hd[i[at] + out[at]] == he[j[at] + out[at]]]
        out[same] += size
    return out


class ItemIndex:
    """The items of a block: vocabulary, word numbers and the places of their seeds by the sorted hashes."""

    #: Places of seeds that are looked at together, about; a single document may have more, but none more than the block has.
    TOGETHER = 4_000_000

    def __init__(self, items: list[tuple], min_match: int) -> None:
        self.min_match, self.items = min_match, []
        self.vocabulary: dict[str, int] = {}
        hashes, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for item_id, text_words in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in text_words], np.int64)
            own = _hashes(ids, min_match)[0]
            hashes.append(own)
            owners.append(np.full(len(own), len(self.items)))
            places.append(np.arange(len(own)))
            self.items.append((item_id, ids))
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        self.owners, self.places = np.concatenate(owners)[order], np.concatenate(places)[order]
        self.seeds, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.lengths = np.array([len(ids) for _, ids in self.items], np.int64)

    def candidates(self, docs: list[list[str]], min_coverage: float = 0.0) -> Iterator[tuple[int, np.ndarray, int]]:
        """(number of the document, its word numbers, number of the item) of the pairs with a common seed whose common seeds
        hold at least ``min_coverage`` of the item's words; no tiling covers more."""
        if not len(self.seeds):
            return
        get = self.vocabulary.get
        flat = np.array([i for d in docs for i in (*[get(w, -1) for w in d], -1)], np.int64)
        ends = np.cumsum([len(d) + 1 for d in docs])
        hashes, whole = _hashes(flat, self.min_match)
        at = np.flatnonzero(whole)
        seed = np.minimum(np.searchsorted(self.seeds, hashes[at]), len(self.seeds) - 1)
        hit = self.seeds[seed] == hashes[at]
        doc = np.searchsorted(ends, at[hit], "right")
        # each seed of a document once
        pair = np.unique(doc * len(self.seeds) + seed[hit])
        doc, seed = pair // len(self.seeds), pair % len(self.seeds)
        size = self.first[seed + 1] - self.first[seed]
        group = np.cumsum(size) // self.TOGETHER
        # a document is in one group
        first_of = np.searchsorted(doc, doc, "left")
        group = group[first_of] if len(group) else group
        for g in np.unique(group).tolist():
            own = group == g
            for d, item in self._reached(doc[own], seed[own], min_coverage):
                yield d, flat[ends[d] - len(docs[d]) - 1 : ends[d] - 1], item

    def _reached(self, doc: np.ndarray, seed: np.ndarray, min_coverage: float) -> list[tuple[int, int]]:
        place, of = _ranges(self.first[seed], self.first[seed + 1])
        pair, at = doc[of] * len(self.items) + self.owners[place], self.places[place]
        order = np.lexsort((at, pair))
        pair, at = pair[order], at[order]
        begins = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        # a seed covers its words up to the next seed
        covers = np.minimum(np.append(at[1:] - at[:-1], self.min_match), self.min_match)
        covers[np.append(begins[1:], len(pair)) - 1] = self.min_match
        reach, pairs = np.add.reduceat(covers, begins), pair[begins]
        enough = reach >= min_coverage * self.lengths[pairs % len(self.items)]
        return list(zip((pairs[enough] // len(self.items)).tolist(), (pairs[enough] % len(self.items)).tolist()))


#: Of a worker: the index of the block that it was last given.
_made: dict = {}


def _index(name: str, block: list[tuple], min_match: int) -> ItemIndex:
    if name not in _made:
        _made.clear()
        _made[name] = ItemIndex(block, min_match)
    return _made[name]


def find_leaks(documents: DataFrame, items: DataFrame, min_match: int, min_longest: int = 0, min_coverage: float = 0.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, tiles, longest, covered, item_words, coverage) of the pairs that share tiles of ``min_match`` words.

    Kept are pairs with a tile of ``min_longest`` words and ``min_coverage`` of the item's words in tiles. Texts without
    ``min_match`` words, null and empty ones take part in no pair. Repeated items are taken once for each (item_id, text);
    documents repeated as a whole give repeated rows. Whole texts are read.
    """
    spark = documents.sparkSession
    columns = ["doc_id", "item_id", "tiles", "longest", "covered", "item_words", "coverage"]
    doc_kind, item_kind = dict(documents.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {doc_kind}, item_id {item_kind}, tiles int, longest int, covered int, item_words int, coverage double"
    docs = spread(documents.select("doc_id", "text").where("text IS NOT NULL"), "doc_id")
    every, count = _item_words(items, min_match, block_words)
    split = count > 1
    if split:  # several passes: texts are made into words in the first one only
        docs = materialize(_in_words(docs, "doc_id"), "words")
    out = spark.createDataFrame([], schema)
    for n, block in enumerate(_blocks(every, count, block_words)):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def batches(it: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value, min_match)
            for batch in it if split else slices(it, 1):
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                rows = []
                for doc, numbers, i in index.candidates(texts if split else [words(t) for t in texts], min_coverage):
                    item_id, item = index.items[i]
                    tiles = tile(numbers, item, min_match)
                    if not tiles:
                        continue
                    longest, covered = max(t[2] for t in tiles), sum(t[2] for t in tiles)
                    if longest >= min_longest and covered >= min_coverage * len(item):
                        rows.append((doc, item_id, len(tiles), longest, covered, len(item), covered / len(item)))
                if rows:
                    cols = list(zip(*rows))
                    numbers_out = [pa.array(c, pa.int32()) for c in cols[2:6]]
                    out = [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1]), *numbers_out, pa.array(cols[6], pa.float64())]
                    yield pa.RecordBatch.from_arrays(out, columns)

        found = docs.mapInArrow(batches, schema)
        out = found if n == 0 else out.unionByName(found)
    return out


def _in_words(texts: DataFrame, key: str) -> DataFrame:
    """(key, words) of (key, text)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it, 1):
            lists = pa.array([words(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "words"])

    return texts.select(key, "text").mapInArrow(batches, f"`{key}` {dict(texts.dtypes)[key]}, words array<string>")


def _item_words(items: DataFrame, min_match: int, block_words: int) -> tuple[DataFrame, int]:
    """(item_id, words, block) of the items with ``min_match`` words, each once, in a folder for each block, and the number of blocks."""
    rows = _in_words(items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct(), "item_id")
    rows = materialize(rows.where(F.size("words") >= min_match), "item-words")
    total = rows.agg(F.sum(F.size("words"))).first()[0] or 0
    count = max(1, int(-(-total // max(1, block_words // 2)))) if total > block_words else 1
    block = F.pmod(F.xxhash64("item_id", "words"), F.lit(count)).cast("int")
    rows = rows.withColumn("block", block)
    if count > 1:
        path = scratch(rows.sparkSession, "item-blocks")
        rows.repartition("block").write.partitionBy("block").parquet(path)
        rows = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return rows, count


def _blocks(rows: DataFrame, count: int, block_words: int) -> Iterator[list[tuple]]:
    """The items of each block in turn, or of its parts of at most ``block_words`` words; only one is on the driver."""
    for i in range(count):
        block: list[tuple] = []
        size = 0
        for r in rows.where(F.col("block") == i).select("item_id", "words").toLocalIterator():
            if block and size + len(r.words) > block_words:
                yield sorted(block, key=lambda x: (str(x[0]), x[1]))
                block, size = [], 0
            block.append((r.item_id, r.words))
            size += len(r.words)
        if block:
            yield sorted(block, key=lambda x: (str(x[0]), x[1]))
