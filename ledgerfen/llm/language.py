"""Languages of documents and of their lines, by hierarchical discrimination with linear support vector machines.

A first machine tells the family, Germanic or Romance; within the family there is a machine for each two of its languages, and
the language that wins most of them is taken (ties by the sum of margins). Features are hashed character n-grams within words
and whole words, so the margins of a line are the mean of its words' margins, and a word's margins are worked out once and
remembered. The machines are fitted here, on a bounded sample of labelled rows, in two rounds: what the first round's machines
take for wrongly labelled is left out of the second.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, combinations, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spread import slices, spread

#: The families, and what labels call the languages, in lower case and without region.
FAMILIES = {"germanic": ["de", "en", "nl"], "romance": ["es", "fr", "pt"]}
NAMES = {
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish español espanol castellano",
    "fr": "fr fra fre french français francais",
    "nl": "nl nld dut dutch nederlands flemish vlaams",
    "pt": "pt por portuguese português portugues",
}
LANGUAGES = sorted(NAMES)
_CODE = {name: code for code, names in NAMES.items() for name in names.split()}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
#: The machines: the family's first, then each two languages of a family.
PAIRS = [tuple(p) for langs in FAMILIES.values() for p in combinations(langs, 2)]

#: The bound of the sample that is fitted on: rows of each label, and characters of a row's text, of which longer ones give a piece.
SAMPLE_ROWS, SAMPLE_CHARS = 150, 20_000
BUCKETS = 1 << 16
#: Words of the pieces of lines that are fitted on.
PIECE_WORDS = 10
#: Words that a worker remembers.
CACHE_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")


def label_code(label: str | None) -> str | None:
    """The language that a label names, whatever its spelling, case, spaces and region; null for labels that name none of these."""
    name = re.split(r"[-_\s(,;/]", (label or "").strip().lower(), maxsplit=1)[0]
    return _CODE.get(name)


def features(word: str) -> list[int]:
    """Buckets of a word's n-grams of 1 to 4 characters, with its borders, and of the word itself."""
    w = f"<{word}>"
    grams = [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)]
    return [crc32(g.encode()) % BUCKETS for g in (*grams, f"={w}", *word)]


def line_words(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def _svms(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, seed: int, epochs: int, penalty: float = 3e-5) -> np.ndarray:
    """Weights of several linear support vector machines, a column each, fitted side by side.

    Subgradient steps on rows of (buckets, values of unit length); ``signs`` has 1, -1 or, for rows that a machine isn't
    fitted on, 0. The weights are averaged over the second half of the steps.
    """
    rng = np.random.default_rng(seed)
    w, total, kept, step = np.zeros((BUCKETS, signs.shape[1])), np.zeros((BUCKETS, signs.shape[1])), 0, 0
    scale, steps = 1.0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            step += 1
            rate = 1 / (penalty * step + 1)
            (x, v), y = rows[i], signs[i]
            short = y * (y * (v @ w[x]) < 1 / scale)
            scale *= 1 - rate * penalty
            if short.any():
                w[x] += v[:, None] * (short * (rate / scale))
            if step > steps // 2 and step % 400 == 0:
                total += scale * w
                kept += 1
    return total / kept if kept else scale * w


def _row(words: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of words' features with their counts, scaled to unit length."""
    counts = Counter(chain.from_iterable(words))
    values = np.fromiter(counts.values(), float, len(counts))
    return np.fromiter(counts, np.int64, len(counts)), values / np.sqrt(values @ values)


class Discriminator:
    """The machines' weights, one column for each, and the scale of each machine's margins."""

    def __init__(self, lines: list[tuple[str, str]], seed: int = 7) -> None:
        """Fits on (line, language); languages may be wrong in part."""
        # pieces of a few words, as the shortest lines that count have no more
        pieces = [(w[i : i + PIECE_WORDS], lang) for line, lang in lines for w in [line_words(line)] for i in range(0, len(w), PIECE_WORDS)]
        known: dict[str, list[int]] = {w: features(w) for w in {w for ws, _ in pieces for w in ws}}
        rows = [_row([known[w] for w in ws]) for ws, _ in pieces]
        langs = np.array([LANGUAGES.index(lang) for _, lang in pieces], int)
        self.weights, self.scale = np.zeros((BUCKETS, 1 + len(PAIRS)), np.float32), np.ones(1 + len(PAIRS))
        right = np.ones(len(rows), bool)
        for epochs in (1, 3):
            self._fit([r for r, ok in zip(rows, right) if ok], langs[right], seed, epochs)
            right = self.decide(np.array([v @ self.weights[x] / v.sum() for x, v in rows]).reshape(-1, 1 + len(PAIRS)))[0] == langs

    def _fit(self, rows: list[tuple], langs: np.ndarray, seed: int, epochs: int) -> None:
        first = next(iter(FAMILIES))
        signs = np.zeros((len(rows), 1 + len(PAIRS)))
        for n, lang in enumerate(LANGUAGES):
            signs[langs == n] = [1 if _FAMILY_OF[lang] == first else -1, *((lang == a) - (lang == b) for a, b in PAIRS)]
        self.weights[:] = _svms(rows, signs, seed, epochs)
        # margins of lines are means over features; the logistic slope is that at which the sample's typical one is 99 percent
        margins = np.abs(np.array([v @ self.weights[x] / v.sum() for x, v in rows]).reshape(-1, 1 + len(PAIRS)))
        for k in range(1 + len(PAIRS)):
            own = margins[signs[:, k] != 0, k]
            self.scale[k] = np.log(99) / max(np.median(own), 1e-12) if len(own) else 1.0

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of margins the numbers in ``LANGUAGES`` and the confidences, from 0 to 1: the family's times the least within it."""
        m = margins * self.scale
        sure = 1 / (1 + np.exp(-np.clip(m, -50, 50)))
        wins, sums = np.zeros((len(m), len(LANGUAGES))), np.zeros((len(m), len(LANGUAGES)))
        least = np.ones((len(m), len(LANGUAGES)))
        for k, (a, b) in enumerate(PAIRS, 1):
            a, b = LANGUAGES.index(a), LANGUAGES.index(b)
            wins[:, a] += m[:, k] > 0
            wins[:, b] += m[:, k] <= 0
            sums[:, a] += m[:, k]
            sums[:, b] -= m[:, k]
            least[:, a] = np.minimum(least[:, a], sure[:, k])
            least[:, b] = np.minimum(least[:, b], 1 - sure[:, k])
        first = np.array([_FAMILY_OF[x] == next(iter(FAMILIES)) for x in LANGUAGES])
        wins[first[None, :] != (m[:, :1] > 0)] = -1  # languages of the other family
        # within equal wins, which sums of margins decide, sums are squeezed under one
        best = np.argmax(wins + 0.5 + np.arctan(sums) / 4, axis=1)
        at = np.arange(len(m))
        return best, np.maximum(sure[:, 0], 1 - sure[:, 0]) * least[at, best]


class Scorer:
    """Languages of lines. The margins of words are remembered, in rows of one matrix."""

    def __init__(self, model: Discriminator) -> None:
        self.model, self._rows = model, {}
        self._margins = np.zeros((1024, 2 + len(PAIRS)))

    def _row(self, word: str) -> int:
        row = self._rows[word] = len(self._rows)
        if row == len(self._margins):
            self._margins = np.concatenate([self._margins, np.zeros_like(self._margins)])
        f = features(word)
        self._margins[row, :-1] = self.model.weights[f].sum(0, dtype=np.float64)
        self._margins[row, -1] = len(f)
        return row

    def lines(self, lines: list[str]) -> list[tuple[str, float] | None]:
        """The language and confidence of each line; None for one without letters."""
        rows, ends, get = [], [0], self._rows.get
        for line in lines:
            for w in line_words(line):
                row = get(w)
                rows.append(self._row(w) if row is None else row)
            ends.append(len(rows))
        ends = np.array(ends)
        total = np.concatenate([np.zeros((1, 2 + len(PAIRS))), np.cumsum(self._margins[rows], axis=0)])
        total = total[ends[1:]] - total[ends[:-1]]
        best, sure = self.model.decide(total[:, :-1] / np.maximum(total[:, -1:], 1))
        if len(self._rows) > CACHE_WORDS:
            self._rows.clear()
        found = (ends[1:] > ends[:-1]).tolist()
        return [(LANGUAGES[b], c) if f else None for b, c, f in zip(best.tolist(), sure.tolist(), found)]


def named_language() -> Column:
    """``label_code`` of the column lang, as an expression."""
    labels = F.create_map(*(F.lit(x) for pair in sorted(_CODE.items()) for x in pair))
    return labels[F.split(F.lower(F.trim(F.coalesce("lang", F.lit("")))), r"[-_\s(,;/]")[0]]


def sample(documents: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(line, language) of at most ``rows`` rows of each language, after their labels.

    The labels are counted first, on their column alone. Then one scan keeps the rows whose hash is under a limit that
    leaves about four times ``rows`` of each language, wherever they stand, and the least hashes of these are taken. Of a text
    longer than ``chars`` a piece of that length is fitted on, from a place that its hash tells; it is labelled whole like any
    other. Languages that so come to fewer rows than they have, as most of their texts are null or under 40 characters, are
    looked for once more without the limit.
    """
    code = named_language().alias("code")
    counts = documents.select(code).groupBy("code").count().where("code IS NOT NULL").collect()
    if not counts:
        return []
    share = {r.code: min(1.0, 4 * rows / r["count"]) for r in counts}
    top = _sampled(documents, share, rows, chars)
    have = Counter(r.code for r in top)
    few = {c: 1.0 for c, part in share.items() if part < 1 and have[c] < rows}
    if few:
        top = [r for r in top if r.code not in few] + _sampled(documents, few, rows, chars)
    top.sort(key=lambda r: (r.code, r.no))
    return [(line, r.code) for r in top for line in r.text.split("\n") if len(line_words(line)) >= 3]


def _sampled(documents: DataFrame, share: dict[str, float], rows: int, chars: int) -> list:
    """(text, code, no): the ``rows`` least hashes of each language among its ``share`` of the rows."""
    code = named_language().alias("code")
    limit = F.create_map(*(F.lit(x) for c, part in share.items() for x in (c, part)))
    usable = documents.where("text IS NOT NULL").where(F.length("text") >= 40).select("text", code, F.xxhash64("doc_id", "text").alias("h"))
    few = usable.where(F.pmod("h", F.lit(1 << 30)) < limit[F.col("code")] * (1 << 30))
    spare = F.greatest(F.length("text") - chars, F.lit(0))
    piece = F.when(spare > 0, F.substring("text", (1 + F.pmod("h", spare + 1)).cast("int"), F.lit(chars))).otherwise(F.col("text"))
    order = W.partitionBy("code").orderBy("h", "text")
    few = few.select(piece.alias("text"), "code", "h")
    return few.withColumn("no", F.row_number().over(order)).where(F.col("no") <= rows).select("text", "code", "no").collect()


def languages(documents: DataFrame, model: Discriminator | None = None, min_words: int = 8) -> DataFrame:
    """(doc_id, lang, seg_no, words, seg_lang, confidence, main): seg_no 0 for each document and n for its n-th line.

    Document rows have the main language, in which most of the words stand, counted between white space (ties by the code),
    and are there for every document: with nulls for null texts and texts without letters. Line rows are there for lines of
    ``min_words`` words. ``lang`` is the label as it came. Without ``model`` one is fitted on a sample of ``documents``; with
    no usable row there, all languages are null.
    """
    if model is None:
        lines = sample(documents)
        model = Discriminator(lines) if lines else None
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in slices(it, 2):
            at, no, words, lang, sure, mains = [], [], [], [], [], []
            texts = [(t or "").split("\n") for t in batch.column(2).to_pylist()]
            found_of = iter(scorer.lines([x for lines in texts for x in lines]) if scorer else repeat(None))
            for k, lines in enumerate(texts):
                count, weighed = Counter(), Counter()
                total, first = 0, len(at)
                for n, line in enumerate(lines, 1):
                    size, found = len(line.split()), next(found_of)
                    total += size
                    if found:
                        count[found[0]] += size
                        weighed[found[0]] += size * found[1]
                    if size >= min_words:
                        at.append(k), no.append(n), words.append(size)
                        lang.append(found and found[0]), sure.append(found and found[1])
                main = max(sorted(count), key=count.get, default=None)
                at.insert(first, k), no.insert(first, 0), words.insert(first, total)
                lang.insert(first, main), sure.insert(first, main and weighed[main] / sum(count.values()))
                mains += [main] * (len(at) - len(mains))
            index = pa.array(at, pa.int64())
            out = [batch.column(0).take(index), batch.column(1).take(index), pa.array(no, pa.int32()), pa.array(words, pa.int64()), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(mains, pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang", "seg_no", "words", "seg_lang", "confidence", "main"])

    rows = spread(documents.select("doc_id", "lang", "text"), "doc_id")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(batches, f"doc_id {kind}, lang string, seg_no int, words bigint, seg_lang string, confidence double, main string")


def wrong_labels(found: DataFrame, min_words: int = 8) -> DataFrame:
    """Of what ``languages`` gives, the documents of ``min_words`` words whose label doesn't name their main language, and
    the lines in another language than their document's.

    Each line row carries its document's main language, ``main``, so that no join is needed. Documents without a main
    language have no case.
    """
    wrong = (F.col("seg_no") == 0) & (F.col("words") >= min_words) & ~named_language().eqNullSafe(F.col("main"))
    mixed = (F.col("seg_no") > 0) & (F.col("seg_lang") != F.col("main"))
    return found.where(F.col("main").isNotNull() & F.col("seg_lang").isNotNull()).where(wrong | mixed)
