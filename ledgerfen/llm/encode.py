"""Encoding of whole texts into ids of a public byte-level BPE vocabulary, and decoding.

The encoder backtracks. An Aho-Corasick automaton over the reversed tokens gives, in one pass over the reversed bytes, the
longest token that starts at each byte. From the left, the longest token whose pair with the token before it is compatible is
taken, then shorter ones; when none fits, the last token is given up and its end is marked as dead. Two adjacent tokens are
compatible when the merges, in their order, would leave the border between them. The tokens found so are exactly those of
the merges, in time linear in the text. Decoding takes slices of one byte string by a table of offsets.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .spread import slices, spread

#: Default place of the vocabulary.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits a text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers, and the longest piece that it remembers: at most about 100 MB.
CACHE_PIECES, CACHE_CHARS = 200_000, 64


def read_ranks(path: str = RANKS) -> list[bytes]:
    """The tokens by id. Ids must be dense and in the order of the merges."""
    with open(path, "rb") as f:
        ids = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ids) != list(range(len(ids))):
        raise ValueError("ids aren't dense")
    return [ids[i] for i in range(len(ids))]


class Vocabulary:
    """The tokens, the merge that makes each of them and the longest token that is a proper prefix of each of them."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.ids = ids = {t: i for i, t in enumerate(tokens)}
        if any(bytes([b]) not in ids for b in range(256)):
            raise ValueError("a byte has no token")
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.pairs: dict[tuple[int, int], int] = {}
        self.shorter: list[int] = [-1] * len(tokens)
        for i, t in enumerate(tokens):
            for cut in range(len(t) - 1, 0, -1):
                head = ids.get(t[:cut])
                if head is None:
                    continue
                if self.shorter[i] < 0:
                    self.shorter[i] = head
                tail = ids.get(t[cut:])
                if self.left[i] == i and head < i and tail is not None and tail < i and self.compatible(head, tail):
                    self.left[i], self.right[i], self.pairs[head, tail] = head, tail, i

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave the border between tokens ``a`` and ``b``.

        The two tokens next to the border are undone merge by merge, the latest first; the border would go if, before the
        merge just undone, the tokens there had a merge of their own.
        """
        pairs, left, right = self.pairs, self.left, self.right
        before = len(self.tokens)
        while True:
            if pairs.get((a, b), before) < before:
                return False
            a_is_byte, b_is_byte = right[a] == a, left[b] == b
            if a_is_byte and b_is_byte:
                return True
            # of equal merges the left one was made first, so the right one is undone first
            if b_is_byte or (a > b and not a_is_byte):
                before, a = a, right[a]
            else:
                before, b = b + 1, left[b]


class Encoder:
    """Texts to lists of ids. ``vocabulary`` is what ``read_ranks`` gives."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.v = Vocabulary(tokens)
        self._lengths = [len(t) for t in tokens]
        self._longest = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self._longest.add_word(t[::-1].decode("latin-1"), i)
        self._longest.make_automaton()
        self._split = regex.compile(PATTERN).findall
        self._cache: dict[str, list[int]] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    def piece(self, piece: bytes) -> list[int]:
        """The ids of bytes that the pattern doesn't split."""
        whole = self.v.ids.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        starts = [-1] * n
        for end, token in self._longest.iter(piece[::-1].decode("latin-1")):
            if starts[n - 1 - end] < 0 or self._lengths[token] > self._lengths[starts[n - 1 - end]]:
                starts[n - 1 - end] = token
        lengths, shorter, fits = self._lengths, self.v.shorter, self._fits
        alive, out, at, token = bytearray(b"\1") * (n + 1), [], 0, starts[0]
        while at < n:
            while token >= 0:
                if alive[at + lengths[token]]:
                    if not out:
                        break
                    ok = fits.get(pair := (out[-1], token))
                    if ok is None:
                        if len(fits) >= CACHE_PIECES:
                            fits.clear()
                        ok = fits[pair] = self.v.compatible(*pair)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += lengths[token]
                token = starts[at] if at < n else -1
            else:
                alive[at] = 0
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; none for an empty and for a null text."""
        cache, out = self._cache, []
        for piece in self._split(text) if text else ():
            ids = cache.get(piece)
            if ids is None:
                ids = self.piece(piece.encode())
                if len(piece) <= CACHE_CHARS:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out


class Decoder:
    """Lists of ids to texts, by one byte string of all tokens and the offsets in it."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.blob = b"".join(tokens)
        self.offsets = np.cumsum([0, *map(len, tokens)]).tolist()

    def decode(self, ids: list[int] | None) -> str:
        """The text of the ids; bytes that are no text become replacement characters. Unknown ids raise IndexError."""
        blob, offsets = self.blob, self.offsets
        if ids and min(ids) < 0:
            raise IndexError(min(ids))
        return b"".join([blob[offsets[i] : offsets[i + 1]] for i in ids or ()]).decode(errors="replace")


#: Of a worker: the encoder of the broadcast vocabulary it was last given.
_made: dict = {}


def _of(kind: type, shared) -> Encoder | Decoder:
    if (kind, shared.id) not in _made:
        _made[kind, shared.id] = kind(shared.value)
    return _made[kind, shared.id]


def encode(documents: DataFrame, ranks: str = RANKS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids): a row for each row, with the ids of its text, an empty list for empty and null text; blank text is text.

    Only the driver reads the vocabulary, which is broadcast; its size is fixed. Repeated rows and null ids stay.
    """
    tokens = documents.sparkSession.sparkContext.broadcast(_BroadcastTokens(read_ranks(ranks)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _of(Encoder, tokens.value)
        for batch in slices(it, 1):
            lists = [encoder.encode(x) for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)])
            if ends[-1] > np.iinfo(np.int32).max:
                raise OverflowError("a text has too many ids for a list")
            flat = np.fromiter((i for x in lists for i in x), np.int32, ends[-1])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_column, "ids"])

    rows = spread(documents.select(id_column, text_column), id_column)
    kind = dict(rows.dtypes)[id_column]
    return rows.mapInArrow(batches, f"`{id_column}` {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks: str = RANKS, id_column: str = "doc_id") -> DataFrame:
    """(id, text) of (id, ids); an empty text for an empty and for a null list."""
    tokens = encoded.sparkSession.sparkContext.broadcast(_BroadcastTokens(read_ranks(ranks)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _of(Decoder, tokens.value)
        for batch in it:
            texts = pa.array([decoder.decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], [id_column, "text"])

    rows = encoded.select(id_column, "ids")
    return rows.mapInArrow(batches, f"`{id_column}` {dict(rows.dtypes)[id_column]}, text string")


class _BroadcastTokens:
    """Tokens with a name by which a worker knows whether it has their encoder already."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.value, self.id = tokens, hash(tuple(tokens))
