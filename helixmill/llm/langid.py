"""Language of documents and of the parts of mixed documents, with a confidence, whatever the stored label says.

Model: for each language a unigram distribution over the pieces of a fixed public vocabulary. A word's likelihood is the
sum over all its segmentations into pieces, by a forward pass; the distributions are fitted by expectation maximisation
(forward and backward) on a bounded sample of labelled documents. Pieces never reach over a word's end, so a text's
likelihood is the product over its words, and each worker scores a word once. Documents are decoded over sentence-like
units with a price for each change of language.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .spans import HAN, LETTER, NUMBER, OTHER, SpanCache, blocks, fingerprints, lower_case, word_classes
from .tokens import PerfectHash, vocabulary_path

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl", "ru", "zh")
PIECES = "piece_bpe_32k.model"
#: Bound of the training sample: labelled documents of each language.
SAMPLE_PER_LANGUAGE = 250
#: Share of the background in each language's distribution.
BACKGROUND = 0.03
#: Chance that a word is one of any language at all (a name, a loan word), whatever language stands around it.
ANY_LANGUAGE = 0.0073
#: Price of a change of language between two units, in nats.
SWITCH = 7.0
#: Least lead of a segment's language over the next one, in nats; below it the segment has no language.
LEAD = 9.0
#: Characters below which a run between two of one other language is taken as foreign words within them.
ISLAND = 20
#: Words after which a unit ends even without punctuation.
UNIT_WORDS = 10
#: Letters of a part in which a longer run of letters is scored; the run is one word all the same, and none of the sample's.
WORD_PART = 40
#: A word that touches one of these signs, or a figure, belongs to a formula or to markup and speaks for no language.
SIGNS = "&\\<>/=_{}[]^$|#@+*~"
_MARK = "▁"
_SIGN_POINTS = np.array([ord(c) for c in SIGNS], np.uint32)
_STOPS = np.array([ord(c) for c in ".!?;:"], np.uint32)
_WIDE_STOPS = np.array([ord(c) for c in "\n\r。；！？：  "], np.uint32)


def named_language(label: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """The code that a stored label names: what is left of the first ``-`` or ``_``, trimmed, in lower case; else null."""
    code = F.regexp_extract(F.lower(F.trim(label)), "^([^-_]*)", 1)
    return F.when(code.isin(*languages), code)


def read_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece vocabulary that can stand in lower-case text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [t for t in texts if t == t.lower()]


class Lattice:
    """All segmentations of a list of words: edges between the places of each word, one for each piece that fits.

    A character that is no piece has an edge of its own that stands for its bytes; one such piece for each first byte.
    """

    def __init__(self, words: list[str], pieces: PerfectHash, longest: int, n_pieces: int):
        texts = [w if word_classes()[ord(w[0])] == HAN else _MARK + w for w in words]
        sizes = np.array([len(t) for t in texts], np.int64)
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        self.first = ends - sizes + np.arange(len(texts))  # node of each word's beginning
        self.last = ends + np.arange(len(texts))
        self.nodes = len(cp) + len(texts)
        word = np.repeat(np.arange(len(texts)), sizes)
        left = ends[word] - np.arange(len(cp))
        place = np.arange(len(cp)) - (ends - sizes)[word]
        froms, spans, ids = [], [], []
        for n in range(1, longest + 1):
            at = np.flatnonzero(left >= n)
            if not len(at):
                break
            piece = pieces.get(fingerprints(cp, at, at + n)).astype(np.int64)
            if n == 1:
                none = piece < 0
                piece[none] = n_pieces + _first_byte(cp[at[none]])
            hit = piece >= 0
            froms.append(at[hit])
            spans.append(np.full(int(hit.sum()), n))
            ids.append(piece[hit])
        at, span, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (froms, spans, ids))
        stop = place[at] + span if len(at) else at
        order = np.lexsort((at + span, stop))
        at, span, self.piece = at[order], span[order], piece[order]
        self.word = word[at]
        self.start, self.end = at + self.word, at + self.word + span
        self.steps = np.searchsorted(stop[order], np.arange(1, (int(stop.max()) if len(stop) else 0) + 2))

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Likelihood sums of all nodes from the left, and each edge's probability."""
        sums = np.zeros((self.nodes, p.shape[1]))
        sums[self.first] = 1
        edge = p[self.piece]
        for a, b in zip(self.steps[:-1], self.steps[1:], strict=True):
            ends = self.end[a:b]
            heads = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
            sums[ends[heads]] = np.add.reduceat(sums[self.start[a:b]] * edge[a:b], heads, axis=0)
        return sums, edge

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in each language, words counting with ``weight``."""
        alpha, edge = self.forward(p)
        beta = np.zeros_like(alpha)
        beta[self.last] = weight / np.maximum(alpha[self.last], 1e-300)
        for a, b in zip(self.steps[-2::-1], self.steps[:0:-1], strict=True):
            np.add.at(beta, self.start[a:b], beta[self.end[a:b]] * edge[a:b])
        uses = alpha[self.start] * edge * beta[self.end]
        return np.stack([np.bincount(self.piece, uses[:, k], len(p)) for k in range(p.shape[1])], 1)


def _first_byte(cp: np.ndarray) -> np.ndarray:
    """First UTF-8 byte of each code point."""
    return np.where(cp < 0x80, cp, np.where(cp < 0x800, 0xC0 | cp >> 6, np.where(cp < 0x10000, 0xE0 | cp >> 12, 0xF0 | cp >> 18))).astype(np.int64)


def _evidence(logs: np.ndarray) -> np.ndarray:
    """Log likelihoods against the best language, where a word may also be one of any language."""
    share = np.exp(logs - logs.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    logs = np.log((1 - ANY_LANGUAGE) * share + ANY_LANGUAGE / share.shape[1])
    return logs - logs.max(1, keepdims=True)


@dataclass
class Model:
    languages: tuple[str, ...]
    pieces: list[str]
    p: np.ndarray  # piece x language


class Scorer:
    """Scores words and units by a model; lives in a worker and remembers the words it has seen."""

    def __init__(self, pieces: list[str], languages: tuple[str, ...]):
        cp = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in pieces])
        starts = np.concatenate(([0], ends[:-1]))
        self.table = PerfectHash(fingerprints(cp, starts, ends), np.arange(len(pieces), dtype=np.int32))
        self.longest = max(len(t) for t in pieces)
        self.size = len(pieces) + 256
        self.n_pieces, self.languages = len(pieces), languages
        self.p = np.full((self.size, len(languages)), 1 / self.size)

    def use(self, p: np.ndarray) -> None:
        self.p = p
        self._reset()

    def _reset(self) -> None:
        self.cache = SpanCache(18)
        self.scores = np.zeros((1 << 14, len(self.languages)), np.float32)
        self.seen = 0

    def lattice(self, words: list[str]) -> Lattice:
        return Lattice(words, self.table, self.longest, self.n_pieces)

    def score(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word in each language, against the best of them."""
        parts = [w[i : i + WORD_PART] for w in words for i in range(0, len(w), WORD_PART)]
        lattice = self.lattice(parts)
        logs = np.log(np.maximum(lattice.forward(self.p)[0][lattice.last], 1e-300))
        heads = np.cumsum([0, *(-(-len(w) // WORD_PART) for w in words)])[:-1]
        return _evidence(np.add.reduceat(logs, heads, axis=0)).astype(np.float32)

    def words(self, cp: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words (runs of letters, single Han ideographs), their fingerprints, lower-case text.

        Words of formulas and markup (see ``SIGNS``) are left out.
        """
        kind = word_classes()[cp]
        first = np.zeros(len(cp), bool)
        first[docs[docs < len(cp)]] = True
        first[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == HAN)
        runs = np.flatnonzero(first)
        ends = np.append(runs[1:], len(cp))
        word = (kind[runs] == LETTER) | (kind[runs] == HAN)
        starts, ends = runs[word], ends[word]
        near = kind == NUMBER
        near[kind == OTHER] = np.isin(cp[kind == OTHER], _SIGN_POINTS)
        before, after = near[np.maximum(starts - 1, 0)] & (starts > 0), near[np.minimum(ends, len(cp) - 1)] & (ends < len(cp))
        plain = ~(before | after) | (kind[starts] == HAN)
        starts, ends = starts[plain], ends[plain]
        low = lower_case()[cp]
        return starts, ends, fingerprints(low, starts, ends), low

    def known(self, starts: np.ndarray, ends: np.ndarray, prints: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Number of each word's row in ``scores``; new words are scored first."""
        if self.seen > 500_000:
            self._reset()
        at = self.cache.get(prints)
        new = np.flatnonzero(at < 0)
        if len(new):
            kinds, first, back = np.unique(prints[new], return_index=True, return_inverse=True)
            texts = [low[starts[j] : ends[j]].tobytes().decode("utf-32-le", "surrogatepass") for j in new[first].tolist()]
            scores = self.score(texts)
            while self.seen + len(texts) > len(self.scores):
                self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
            numbers = self.seen + np.arange(len(texts))
            self.scores[numbers] = scores
            self.seen += len(texts)
            self.cache.put(kinds, numbers)
            at[new] = numbers[back]
        return at

    def units(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Units of all texts in order: row, start, end (characters, from the first word to the last), words, scores."""
        out: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "start", "end", "words", "scores")}
        base: dict[int, int] = {}
        for cp, docs, rows in blocks(texts):
            shift = np.array([base.get(int(r), 0) for r in rows[:1]] + [0] * (len(rows) - 1))
            base = {int(rows[-1]): int(shift[-1]) + len(cp) - int(docs[-1])}
            starts, ends, prints, low = self.words(cp, docs)
            if not len(starts):
                continue
            at = self.known(starts, ends, prints, low)
            doc, unit = _units(cp, docs, starts)
            heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            tails = np.append(heads[1:], len(starts)) - 1
            number = np.cumsum(np.append(0, unit[1:] != unit[:-1]))
            scores = self.scores[at]
            sums = np.stack([np.bincount(number, scores[:, k], len(heads)) for k in range(scores.shape[1])], 1)
            d = doc[heads]
            for name, value in (("row", rows[d]), ("start", starts[heads] - docs[d] + shift[d]), ("end", ends[tails] - docs[d] + shift[d]), ("words", tails - heads + 1), ("scores", sums)):
                out[name].append(value)
        width = len(self.languages)
        return {k: np.concatenate(v) if v else np.zeros((0, width) if k == "scores" else 0, float if k == "scores" else np.int64) for k, v in out.items()}


def _units(cp: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and unit of each word. A unit ends at a line break, at a stop that white space follows, or by its length."""
    stop = np.isin(cp, _WIDE_STOPS)
    at = np.flatnonzero(np.isin(cp[:-1], _STOPS))
    stop[at] |= np.isin(cp[at + 1], np.array([0x20, 0x0A, 0x0D, 0x09], np.uint32))
    stops = np.searchsorted(np.flatnonzero(stop), starts)
    doc = np.searchsorted(docs, starts, "right") - 1
    fresh = np.append(True, (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1]))
    heads = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    place = np.arange(len(starts)) - heads[group]
    return doc, np.cumsum(fresh | (place % UNIT_WORDS == 0))


def decode(row: np.ndarray, scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each unit: Viterbi over each text's units, all texts in step."""
    n, width = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    counts = np.diff(np.append(heads, n))
    order = np.argsort(-counts, kind="stable")
    heads, counts = heads[order], counts[order]
    came = np.zeros((n, width), np.int8)
    best = np.zeros(n, np.int64)
    state = scores[heads].copy()
    ascending = -counts
    for t in range(1, int(counts[0])):
        m = int(np.searchsorted(ascending, -t, "left"))  # texts with more than t units
        live = state[:m]
        top = live.argmax(1)
        jump = live[np.arange(m), top][:, None] - switch
        came[heads[:m] + t] = np.where(jump > live, top[:, None], np.arange(width))
        state[:m] = np.maximum(live, jump) + scores[heads[:m] + t]
    now = state.argmax(1)
    best[heads + counts - 1] = now
    for t in range(int(counts[0]) - 1, 0, -1):
        m = int(np.searchsorted(ascending, -t, "left"))
        now[:m] = came[heads[:m] + t, now[:m]]
        best[heads[:m] + t - 1] = now[:m]
    return best


def _confidence(sums: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language of each row of sums, its posterior with evidence counted by the root of the words, its lead."""
    best = sums.argmax(1)
    scaled = sums / np.sqrt(np.maximum(words, 1))[:, None]
    scaled = np.exp(scaled - scaled.max(1, keepdims=True))
    ranked = np.sort(sums, 1)
    lead = ranked[:, -1] - ranked[:, -2] if sums.shape[1] > 1 else np.full(len(sums), np.inf)
    return best, 1 / scaled.sum(1), lead


def _runs(row: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    heads = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (lang[1:] != lang[:-1])))
    return heads, np.append(heads[1:], len(row)) - 1


def segments(units: dict[str, np.ndarray], switch: float = SWITCH, lead: float = LEAD) -> dict[str, np.ndarray]:
    """Runs of units in one language: row, start, end, lang (-1 where the lead is too small), confidence.

    A foreign word or two between parts of one language belong to them.
    """
    lang = decode(units["row"], units["scores"], switch)
    if not len(lang):
        return {k: np.zeros(0, float if k == "confidence" else np.int64) for k in ("row", "start", "end", "lang", "confidence")}
    row = units["row"]
    heads, tails = _runs(row, lang)
    inner = np.flatnonzero(units["end"][tails] - units["start"][heads] < ISLAND)
    inner = inner[(inner > 0) & (inner < len(heads) - 1)]
    before, after = heads[inner - 1], heads[np.minimum(inner + 1, len(heads) - 1)]
    alone = (row[before] == row[heads[inner]]) & (row[after] == row[heads[inner]]) & (lang[before] == lang[after])
    for i in inner[alone]:
        lang[heads[i] : tails[i] + 1] = lang[heads[i - 1]]
    heads, tails = _runs(row, lang)
    sums = np.add.reduceat(units["scores"], heads, axis=0)
    words = np.add.reduceat(units["words"], heads)
    best, confidence, ahead = _confidence(sums, words)
    sure = ahead >= lead
    return {"row": row[heads], "start": units["start"][heads], "end": units["end"][tails], "lang": np.where(sure, best, -1), "confidence": np.where(sure, confidence, 0.0)}


def train(texts: list[str], labels: list[str], languages: tuple[str, ...] = LANGUAGES, path: str | None = None, rounds: int = 3, steps: int = 2) -> Model:
    """Fits the piece distributions. The first round believes the labels; later ones the model's own units.

    So a wrong label or a foreign part of a sample text does little harm. Every language is weighed alike.
    """
    pieces = read_pieces(path or vocabulary_path(PIECES))
    scorer = Scorer(pieces, languages)
    width = len(languages)
    if not texts:
        return Model(languages, pieces, np.full((scorer.size, width), 1 / scorer.size, np.float32))
    column = np.array([languages.index(x) for x in labels])
    parts = []
    for cp, docs, rows in blocks(pa.array(texts, pa.string())):
        starts, ends, prints, low = scorer.words(cp, docs)
        short = ends - starts <= WORD_PART
        starts, ends, prints = starts[short], ends[short], prints[short]
        if len(starts):
            doc, unit = _units(cp, docs, starts)
            parts.append((rows[doc], unit, starts, ends, prints, low))
    if not parts:
        return Model(languages, pieces, np.full((scorer.size, width), 1 / scorer.size, np.float32))
    prints = np.concatenate([x[4] for x in parts])
    row = np.concatenate([x[0] for x in parts])
    steps_of = np.cumsum([0, *(int(x[1][-1]) for x in parts)])
    unit = np.concatenate([x[1] + s for x, s in zip(parts, steps_of, strict=False)])
    _, first, word = np.unique(prints, return_index=True, return_inverse=True)
    origin = np.cumsum([0, *(len(x[4]) for x in parts)])
    vocabulary = []
    for j in first.tolist():
        k = int(np.searchsorted(origin, j, "right")) - 1
        _, _, starts, ends, _, low = parts[k]
        vocabulary.append(low[starts[j - origin[k]] : ends[j - origin[k]]].tobytes().decode("utf-32-le", "surrogatepass"))
    lattice = scorer.lattice(vocabulary)
    heads = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]) | (row[1:] != row[:-1])))
    number = np.cumsum(np.append(0, (unit[1:] != unit[:-1]) | (row[1:] != row[:-1])))
    p = scorer.p
    label = column[row]
    for turn in range(rounds):
        if turn:
            scores = _evidence(np.log(np.maximum(lattice.forward(p)[0][lattice.last], 1e-300)))[word]
            sums = np.stack([np.bincount(number, scores[:, k], len(heads)) for k in range(width)], 1)
            label = decode(row[heads], sums)[number]
        weight = np.stack([np.bincount(word[label == k], minlength=len(vocabulary)) for k in range(width)], 1).astype(float)
        for _ in range(steps):
            uses = lattice.expected(p, weight)
            share = uses / np.maximum(uses.sum(0), 1e-9)
            ground = share.mean(1, keepdims=True) * 0.98 + 0.02 / scorer.size
            p = (1 - BACKGROUND) * share + BACKGROUND * ground
            p[:, uses.sum(0) <= 0] = 1e-12  # no sample: never chosen
    return Model(languages, pieces, p.astype(np.float32))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", languages: tuple[str, ...] = LANGUAGES, per_language: int = SAMPLE_PER_LANGUAGE, path: str | None = None) -> Model:
    """Fits a model on at most ``per_language`` labelled documents of each language, chosen by a hash of their key.

    The label counts come from a scan of the label column alone; the sample's whole texts go to the driver.
    """
    code = named_language(F.col(label).cast("string"), languages)
    counts = {r[0]: r[1] for r in df.select(code.alias("c")).where("c is not null").groupBy("c").count().collect()}
    if not counts:
        return train([], [], languages, path)
    draw = (F.xxhash64(F.col(key).cast("string"), F.lit(7)).cast("double") / F.lit(2.0**64)) + 0.5
    bound = F.coalesce(*[F.when(F.col("_c") == c, F.lit(1.3 * per_language / n)) for c, n in counts.items()])
    rows = (
        df.select(code.alias("_c"), draw.alias("_d"), F.col(text).alias("_t"))
        .where(F.col("_c").isNotNull() & (F.col("_d") < bound))
        .where(F.length(F.trim("_t")) > 0)
        .limit(2 * per_language * len(languages))
        .collect()
    )
    texts, labels = [], []
    left = dict.fromkeys(languages, per_language)
    for r in sorted(rows, key=lambda r: (r["_d"], r["_t"])):
        if left[r["_c"]]:
            left[r["_c"]] -= 1
            texts.append(r["_t"])
            labels.append(r["_c"])
    return train(texts, labels, languages, path)


@lru_cache(maxsize=2)
def _scorer(packed: bytes) -> Scorer:
    model = pickle.loads(packed)  # noqa: S301 - written by our own driver
    scorer = Scorer(model.pieces, model.languages)
    scorer.use(model.p.astype(float))
    return scorer


def _run(df: DataFrame, model: Model, key: str, text: str, rows_of, schema: str) -> DataFrame:
    packed = pickle.dumps(model)
    shipped = df.sparkSession.sparkContext.broadcast(packed)  # the vocabulary's size bounds it: about 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shipped.value)
        for batch in batches:
            yield rows_of(scorer, batch.column(0), batch.column(1))

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text).cast("string").alias("_text"))).mapInArrow(run, f"`{key}` {kind}, {schema}")


def _names(lang: np.ndarray, languages: tuple[str, ...]) -> pa.Array:
    return pa.array(np.array([*languages, None], object)[lang], pa.string())


def language_segments(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key``, seg_no, seg_start, seg_end, lang, confidence: each text's parts by language.

    Offsets count characters from 0, end exclusive, from the first word of the part to its last. Texts without words
    (null, empty, blank, figures alone) have no row; a part whose words decide nothing has a null lang and confidence 0.
    """

    def rows_of(scorer: Scorer, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        s = segments(scorer.units(texts))
        row = s["row"]
        number = np.arange(len(row)) - (np.searchsorted(row, row, "left") if len(row) else 0) + 1
        ints = [pa.array(x.astype(np.int32)) for x in (number, s["start"], s["end"])]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), *ints, _names(s["lang"], scorer.languages), pa.array(s["confidence"])], names=[key, "seg_no", "seg_start", "seg_end", "lang", "confidence"])

    return _run(df, model, key, text, rows_of, "seg_no int, seg_start int, seg_end int, lang string, confidence double")


def document_languages(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key``, lang, confidence, n_langs: one row for each document, whatever its text.

    lang is the language of most characters, ties by the order of the model's languages; null with confidence 0 where
    no part of the text has one. The confidence is the mean of the document's parts in that language by length, times
    their share of all characters in parts with a language.
    """

    def rows_of(scorer: Scorer, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        s = segments(scorer.units(texts))
        n, width = len(keys), len(scorer.languages)
        ok = s["lang"] >= 0
        cell = s["row"][ok] * width + s["lang"][ok]
        size = (s["end"] - s["start"])[ok].astype(float)
        chars = np.bincount(cell, size, n * width).reshape(n, width)
        trust = np.bincount(cell, size * s["confidence"][ok], n * width).reshape(n, width)
        best = chars.argmax(1)
        total = chars.sum(1)
        confidence = np.where(total > 0, trust[np.arange(n), best] / np.maximum(total, 1), 0.0)
        return pa.RecordBatch.from_arrays([keys, _names(np.where(total > 0, best, -1), scorer.languages), pa.array(confidence), pa.array((chars > 0).sum(1).astype(np.int32))], names=[key, "lang", "confidence", "n_langs"])

    return _run(df, model, key, text, rows_of, "lang string, confidence double, n_langs int")


def unnamed_languages(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", label: str = "lang", least_chars: int = 60) -> DataFrame:
    """Columns ``key``, lang: languages of at least ``least_chars`` consecutive characters that the label doesn't name.

    A document's row count is at most the number of languages. Repeated input rows give one row. The label travels
    through the scan next to the text, so there is no join; only the distinct at the end shuffles, and only its cases.
    """
    code = named_language(F.col(label).cast("string"), model.languages)
    packed = df.select(F.struct(F.col(key).alias("k"), code.alias("c")).alias("_key"), F.col(text).alias("_text"))
    parts = language_segments(packed, model, "_key", "_text")
    long = parts.where((F.col("seg_end") - F.col("seg_start") >= least_chars) & F.col("lang").isNotNull())
    return long.where(~F.col("lang").eqNullSafe(F.col("_key.c"))).select(F.col("_key.k").alias(key), "lang").distinct()
