"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Every language has a probability for each piece of the vocabulary.  A word's probability is the sum, over all ways to cut
it into pieces, of the product of its pieces' probabilities; a forward recursion over the word's positions gives it.
Piece probabilities are fitted by expectation maximisation (forward and backward sums) on the word counts of a bounded
sample of labelled rows.  Texts are lower-cased; their words are runs of letters, marked at the start as the vocabulary does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, staged

VOCABULARY = "piece_bpe_32k.model"
#: Longer words are scored one by one, without being remembered; the fit alone looks at them in stretches of this length.
LONG_WORD = 48
#: The fit holds a number for each piece and language; more labels than this are taken for dirty data.
MOST_LANGUAGES = 1000
#: Probability of a character that no piece covers, alike in all languages.
UNKNOWN = 1e-7
#: Documents per language that the fit looks at, about; they are chosen by a hash of the key.
SAMPLE_DOCS = 1000
ROUNDS = 4
SMOOTHING = 0.05
UNDETERMINED = "und"

_MARK = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")
_STRETCHES = re.compile(r"[^\W\d_]{1,%d}" % LONG_WORD)
#: Keeps forward sums near 1: each character counts this much more, and the logarithm is corrected.
_LIFT = 30.0
_CHUNK_CHARS = 1_000_000
_CACHED_WORDS = 200_000
_TABLE_BITS = 20
#: Letters of a long word whose pieces are looked up at once.
_PLACES = 1 << 16


def load_vocabulary(path: str | None = None) -> list[str]:
    """The pieces of a public sentencepiece model that hold letters only, lower-cased, in a fixed order."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p == _MARK or _LETTERS.fullmatch(p.removeprefix(_MARK)))


def words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


class _Numbers(dict):
    """Numbers words in the order in which they are first looked up."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _extend(hashes: np.ndarray, characters: np.ndarray) -> np.ndarray:
    return (hashes + characters.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (hashes >> np.uint64(29))


class PieceTable:
    """Looks up many strings at once among the pieces and the beginnings of pieces, in two hash tables.

    Numbers below ``n`` are pieces, those from there to below ``miss`` are beginnings only, ``miss`` is neither.
    """

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        known = set(pieces)
        strings = pieces + sorted({p[:i] for p in pieces for i in range(1, len(p))} - known)
        self.miss = len(strings)
        self.keys = np.zeros(self.miss + 1, dtype=np.uint64)
        for length in range(1, self.longest + 1):
            own = [i for i, p in enumerate(strings) if len(p) == length]
            if own:
                h = np.zeros(len(own), dtype=np.uint64)
                for column in as_matrix([strings[i] for i in own], length).T:
                    h = _extend(h, column)
                self.keys[own] = h
        self.first = np.full(1 << _TABLE_BITS, self.miss, dtype=np.int32)
        self.second = self.first.copy()
        for i, key in enumerate(self.keys[: self.miss]):
            a, b = self._slots(key)
            table, slot = (self.first, a) if self.first[a] == self.miss else (self.second, b)
            if table[slot] != self.miss:
                raise ValueError("two pieces share both slots; enlarge the table")
            table[slot] = i

    @staticmethod
    def _slots(h):
        return h >> np.uint64(64 - _TABLE_BITS), (h >> np.uint64(8)) & np.uint64((1 << _TABLE_BITS) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        a, b = self._slots(h)
        i = self.first[a]
        wrong = np.flatnonzero(self.keys[i] != h)
        if len(wrong):
            j = self.second[b[wrong]]
            i[wrong] = np.where(self.keys[j] == h[wrong], j, self.miss)
        return i


def as_matrix(same_length: list[str], length: int) -> np.ndarray:
    return np.array(same_length, dtype=f"U{length}").view(np.uint32).reshape(len(same_length), length)


def _piece_numbers(table: PieceTable, letters: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, length, words, piece numbers) for all pieces in the words; number n is an unknown character.

    Words drop out at each start as soon as no piece begins with what has been read from there.
    """
    n, everyone = letters.shape[1], np.arange(len(letters))
    for start in range(n):
        alive, h = everyone, np.zeros(len(letters), dtype=np.uint64)
        for length in range(1, min(table.longest, n - start) + 1):
            h = _extend(h, letters[alive, start + length - 1])
            found = table.find(h)
            if length == 1:
                yield start, 1, everyone, np.minimum(found, table.n)
            elif len(own := np.flatnonzero(found < table.n)):
                yield start, length, alive[own], found[own]
            on = np.flatnonzero(found != table.miss)
            if not len(on):
                break
            alive, h = alive[on], h[on]


def _lifted(probabilities: np.ndarray, longest: int) -> list[np.ndarray]:
    """Probabilities for pieces of each length (index 0 unused), with a last row for unknown characters."""
    full = np.vstack([probabilities, np.full((1, probabilities.shape[1]), UNKNOWN)])
    return [full * _LIFT**length for length in range(longest + 1)]


def log_probabilities(table: PieceTable, probabilities: np.ndarray, texts: list[str]) -> np.ndarray:
    """log P(word | language), one row per word and one column per language."""
    texts = [_MARK + w for w in texts]
    out = np.zeros((len(texts), probabilities.shape[1]))
    lifted = _lifted(probabilities, table.longest)
    for length, own in _by_length(texts):
        for at in range(0, len(own), 8192):
            part = own[at : at + 8192]
            forward = np.zeros((length + 1, len(part), probabilities.shape[1]))
            forward[0] = 1
            for start, size, rows, pieces in _piece_numbers(table, as_matrix([texts[i] for i in part], length)):
                forward[start + size][rows] += forward[start][rows] * lifted[size][pieces]
            out[part] = np.log(forward[length]) - length * np.log(_LIFT)
    return out


def long_log_probability(table: PieceTable, probabilities: np.ndarray, word: str) -> np.ndarray:
    """log P(word | language) of one word of any length, one number per language.

    Pieces are looked up at many places at once; the recursion keeps the last few sums, scaled to stay near 1.
    """
    letters = as_matrix([_MARK + word], len(word) + 1)[0]
    lifted, n, longest = _lifted(probabilities, table.longest), len(letters), table.longest
    forward, log = np.zeros((longest + 1, probabilities.shape[1])), np.zeros(probabilities.shape[1])
    forward[0] = 1  # row i: the sum over all ways to reach the place i letters after the one at hand
    for at in range(0, n, _PLACES):
        size = min(_PLACES, n - at)
        by_start: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        alive, h = np.arange(size), np.zeros(size, dtype=np.uint64)
        for length in range(1, longest + 1):
            inside = at + alive + length <= n
            alive, h = alive[inside], h[inside]
            if not len(alive):
                break
            h = _extend(h, letters[at + alive + length - 1])
            found = table.find(h)
            own = np.arange(len(found)) if length == 1 else np.flatnonzero(found < table.n)
            for start, piece in zip(alive[own].tolist(), np.minimum(found[own], table.n).tolist(), strict=True):
                by_start[start].append((length, piece))
            on = found != table.miss
            alive, h = alive[on], h[on]
        for cuts in by_start:
            here = forward[0].copy()
            for length, piece in cuts:
                forward[length] += here * lifted[length][piece]
            forward[:-1] = forward[1:]
            forward[-1] = 0
            scale = forward.max(axis=0)
            forward /= scale
            log += np.log(scale)
    return log + np.log(forward[0]) - n * np.log(_LIFT)


def expected_counts(table: PieceTable, probabilities: np.ndarray, texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in the weighted words, under one language's probabilities."""
    texts = [_MARK + w for w in texts]
    out = np.zeros(table.n + 1)
    lifted = [x[:, 0] for x in _lifted(probabilities.reshape(-1, 1), table.longest)]
    for length, own in _by_length(texts):
        for at in range(0, len(own), 8192):
            part = own[at : at + 8192]
            forward, backward = np.zeros((length + 1, len(part))), np.zeros((length + 1, len(part)))
            forward[0] = backward[length] = 1
            cuts = [(s, k, r, p, lifted[k][p]) for s, k, r, p in _piece_numbers(table, as_matrix([texts[i] for i in part], length))]
            for start, size, rows, _, chance in cuts:
                forward[start + size][rows] += forward[start][rows] * chance
            for start, size, rows, _, chance in reversed(cuts):
                backward[start][rows] += chance * backward[start + size][rows]
            scale = weights[part] / forward[length]
            for start, size, rows, pieces, chance in cuts:
                out += np.bincount(pieces, forward[start][rows] * chance * backward[start + size][rows] * scale[rows], minlength=len(out))
    return out[: table.n]


def _by_length(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.array([len(w) for w in texts], dtype=np.int64)
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)


@dataclass
class LanguageModel:
    """Languages in order, the vocabulary and a matrix of probabilities: pieces by languages."""

    languages: list[str]
    pieces: list[str]
    probabilities: np.ndarray
    _cache: _Numbers = field(default_factory=_Numbers, repr=False)
    _table: PieceTable | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"languages": self.languages, "pieces": self.pieces, "probabilities": self.probabilities, "_cache": _Numbers(), "_table": None}

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods (texts by languages) of whole texts, and which texts have a letter."""
        if self._table is None:
            self._table, self._rows = PieceTable(self.pieces), np.zeros((0, len(self.languages)))
        out, lettered, at = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=bool), 0
        while at < len(texts):
            if len(self._cache) > _CACHED_WORDS:
                self._cache, self._rows = _Numbers(), self._rows[:0]
            numbers, sizes, chars, begin = [], [], 0, at
            while at < len(texts) and chars < _CHUNK_CHARS:
                found = words(texts[at]) if texts[at] else []
                lettered[at] = bool(found)
                if found and max(map(len, found)) > LONG_WORD:
                    for word in found:
                        if len(word) > LONG_WORD:
                            out[at] += long_log_probability(self._table, self.probabilities, word)
                    found = [w for w in found if len(w) <= LONG_WORD]
                numbers += map(self._cache.__getitem__, found)
                sizes.append(len(found))
                chars += len(texts[at] or "")
                at += 1
            new = list(islice(self._cache, len(self._rows), None))
            if new:
                self._rows = np.concatenate([self._rows, log_probabilities(self._table, self.probabilities, new)])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            for j in range(len(self.languages)):
                out[begin:at, j] += np.bincount(owner, self._rows[numbers, j] if numbers else None, minlength=len(sizes))
        return out, lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its share of the likelihood of all languages."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        logs, lettered = self.score(texts)
        share = np.exp(logs - logs.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        names = [self.languages[i] if ok else UNDETERMINED for i, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, share.max(axis=1), 0.0)


def held_out(key: str = "doc_id"):
    """Whether a row takes no part in the fit: the CRC-32 of its key as text leaves 1 modulo 3."""
    return F.crc32(as_text(key).cast("binary")) % 3 == 1


def fit_language_model(docs: DataFrame, vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> LanguageModel:
    """Fit on the text and label of rows that are not held out and have a label.

    About ``sample_docs`` rows per language are looked at (all, where there are fewer), chosen by a hash of the key, so
    the choice does not depend on the input's order.  Word counts and expected piece counts are summed by Spark; what
    reaches the driver is a number per piece and language.  Without labelled rows, as in an empty table, the model has no
    language; more than ``MOST_LANGUAGES`` labels are an error.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels in lang")
    languages, pieces = sorted(totals), load_vocabulary(vocabulary)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces), 0)))
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, sample_docs / n))])
    draw = F.conv(F.substring(F.md5(as_text("doc_id")), 1, 8), 16, 10).cast("double") / 4294967296.0
    sample = labelled.where(draw < F.element_at(share, F.col("lang")))

    def count_words(batches):
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found, n = np.unique(np.array(_STRETCHES.findall(text.lower()) or [""], dtype=object), return_counts=True)
                yield pd.DataFrame({"lang": lang, "word": found, "n": n})

    counted = sample.select("lang", "text").mapInPandas(count_words, "lang string, word string, n long")
    counted = counted.where("word <> ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = staged(counted, "langid-words")
    probabilities = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    for _ in range(rounds):
        model = LanguageModel(languages, pieces, probabilities)

        def expect(batches, model=model):
            sums, piece_table = np.zeros((len(model.pieces), len(model.languages))), PieceTable(model.pieces)
            for batch in batches:
                for lang, own in batch.groupby("lang"):
                    j = model.languages.index(lang)
                    sums[:, j] += expected_counts(piece_table, model.probabilities[:, j], own["word"].tolist(), own["n"].to_numpy(dtype=float))
            piece, language = np.nonzero(sums)
            yield pd.DataFrame({"piece": piece, "language": language, "n": sums[piece, language]})

        found = counted.mapInPandas(expect, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
        sums = np.full_like(probabilities, SMOOTHING)
        sums[found["piece"].to_numpy(), found["language"].to_numpy()] += found["n"].to_numpy()
        probabilities = sums / sums.sum(axis=0)
    return LanguageModel(languages, pieces, probabilities)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of columns of those names.

    Each text is scored whole and by itself.  Null, empty and letterless texts are ``und`` with score 0, as is every
    text if the model has no language.  All rows stay, repeated ones too; nothing is exchanged; an empty table stays so.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, share = model.predict([t if isinstance(t, str) else None for t in batch])
            yield pd.DataFrame({"lang_pred": names, "score": share})

    # Only texts go to Python and only predictions come back; a condition on them must not score the texts again.
    guess = docs.select(*kept, predict.asNondeterministic()(F.col(text)).alias("__guess"))
    return guess.select(*kept, "__guess.lang_pred", "__guess.score")
