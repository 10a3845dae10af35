"""Packing documents into sequences of a fixed length by minimum bin slack.

Pieces matter to the packing by their length alone, so it is planned on the histogram of lengths, which has at most one
entry per length whatever the corpus' size.  The fullest combination for a bin comes from subset sums over the lengths
that are left, kept as the bits of one integer; it is repeated for as many bins as there are pieces for, then removed.
Spark does the rest: tokenising, counting, numbering the pieces of each length and giving each its place.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, staged

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1

#: Characters that normalisation leaves alone (but for case), and on whose classes all libraries agree.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u0148\\u014a-\\u017e\\u2010-\\u2027\\u20ac]*")
#: The tokenizer's own split of lower-case text into words, over those characters.
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xffā-ž", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(f"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
_CACHED_WORDS = 500_000


class WordTokenizer:
    """Token ids of whole texts, equal to the public tokenizer's; the ids of words are remembered.

    The tokenizer treats the words of a text one by one, so a text of plain characters is split here and only unseen
    words are encoded.  Texts with other characters, or with a special token's name in them, are encoded whole.
    """

    def __init__(self, path: str | None = None):
        self.path, self._tokenizer = path, None
        self._forget()

    def __getstate__(self):
        return {"path": self.path}

    def __setstate__(self, state):
        self.__init__(**state)

    def _forget(self):
        """Words are numbered; the ids of word w are ``_ids[_starts[w] : _starts[w + 1]]``."""
        self._numbers, self._starts, self._ids = {}, np.zeros(1, dtype=np.int64), np.zeros(0, dtype="<u4")

    def _encode(self, text: str) -> np.ndarray:
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            if self.path is None:
                import public_tokenizers

                self.path = public_tokenizers.path(TOKENIZER)
            self._tokenizer = Tokenizer.from_file(self.path)
            vocabulary = self._tokenizer.get_vocab()
            self._ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self._ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        """Encode the words as one text; the tokens that end a word tell them apart."""
        ids = self._encode(" ".join(words))
        ends = np.flatnonzero(self._ends_word[ids]) + 1
        if len(ends) != len(words):
            each = [self._encode(w) for w in words]
            ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        self._numbers.update(zip(words, range(len(self._numbers), len(self._numbers) + len(words)), strict=True))
        self._starts = np.concatenate([self._starts, len(self._ids) + ends])
        self._ids = np.concatenate([self._ids, ids])

    def ids_of_all(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [_WORDS.findall(t.lower()) if t and "<|" not in t and _PLAIN.fullmatch(t) else None for t in texts]
        if len(self._numbers) > _CACHED_WORDS:
            self._forget()
        new = [w for w in set(chain.from_iterable(x for x in split if x)) if w not in self._numbers]
        if new:
            self._learn(new)
        out = []
        for text, found in zip(texts, split, strict=True):
            if found is None:
                out.append(self._encode(text) if text else np.zeros(0, dtype="<u4"))
                continue
            words = np.fromiter(map(self._numbers.__getitem__, found), dtype=np.int64, count=len(found))
            starts = self._starts[words]
            sizes = self._starts[words + 1] - starts
            before = np.cumsum(sizes) - sizes
            out.append(self._ids[np.repeat(starts - before, sizes) + np.arange(sizes.sum())])
        return out

    def ids(self, text: str | None) -> np.ndarray:
        return self.ids_of_all([text])[0]


def _in_groups(texts: list, characters: int = 1_000_000):
    """Slices of about so many characters."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= characters:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins that hold all items: (items of each length in a bin, number of such bins).

    Each bin takes the longest item left and the combination of others that fills the rest best; longer items are tried
    first, so that short ones remain to fill later bins.
    """
    left = {length: n for length, n in histogram.items() if n > 0}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("lengths must be between 1 and the capacity")
    order = sorted(left, reverse=True)
    bins = []
    while order:
        longest = order[0]
        room = capacity - longest
        left[longest] -= 1
        reachable, mask, goal, trail = 1, (1 << (room + 1)) - 1, 1 << room, []
        for length in order:
            if length > room:
                continue
            n, step = min(left[length], room // length), 1
            while n > 0 and not reachable & goal:
                step = min(step, n)
                trail.append((length, step, reachable))
                reachable |= (reachable << (length * step)) & mask
                n -= step
                step *= 2
            if reachable & goal:
                break
        left[longest] += 1
        content, at = {longest: 1}, reachable.bit_length() - 1
        for length, step, before in reversed(trail):
            if not before >> at & 1:
                content[length] = content.get(length, 0) + step
                at -= length * step
        times = min(left[length] // n for length, n in content.items())
        bins.append((content, times))
        for length, n in content.items():
            left[length] -= n * times
        order = [length for length in order if left[length]]
    return bins


def _places(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """For runs of the pieces of one length: length, first number, pieces per bin, first bin, first offset; sorted."""
    rows, used, sequence = [], {}, 0
    for content, times in bins:
        offset = 0
        for length, n in content.items():
            first = used.get(length, 0)
            rows.append((length, first, n, sequence, offset))
            used[length] = first + n * times
            offset += length * n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, key="doc_id", text="text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``ids``, and the
    task that cut them (``part``) with a running number for each length in it (``nth``).

    A document is its text's ids and ``end_id``, so a null or empty text is one token; a very long one is cut in as many pieces
    as it fills.  ``doc_id`` is text: as a number a batch with a null would round it.  Without ``with_ids``, ids are null.
    """
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("text"))
    encoder = WordTokenizer(tokenizer)
    schema = rows.drop("text").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("ids", T.ArrayType(T.IntegerType())).add("part", "integer").add("nth", "long")

    def cut(batches):
        part_id, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            docs = batch["doc_id"].tolist()
            for group in _in_groups(texts):
                out = []
                for doc, ids in zip(docs[group], encoder.ids_of_all(texts[group]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for i in range(0, len(ids), capacity):
                        part = ids[i : i + capacity]
                        out.append((doc, i // capacity, i, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None, part_id, seen[len(part)]))
                        seen[len(part)] += 1
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "nth"])

    return rows.mapInPandas(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece with its place: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``;
    ``with_ids`` adds the token ids themselves.

    The pieces of a length are numbered by the tasks that cut them, whose counts give each task its first number; so
    nothing is sorted, and neither a length nor a key that a third of all rows share comes together anywhere.  The
    numbers are written with the pieces, so a lost executor cannot change them.  What reaches the driver is the
    histogram (at most ``capacity`` rows) and what it sends back has a row per length and kind of bin.
    Repeated rows are packed each; an empty table gives no rows; other columns are not read.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id, with_ids)
    pieces = staged(pieces if with_ids else pieces.drop("ids"), "packing-pieces")
    counts = staged(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(minimum_bin_slack(histogram, capacity))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    first = staged(counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("first")), "packing-first")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    numbered = pieces.join(small(first), ["length", "part"]).select(*columns, (F.col("first") + F.col("nth")).alias("number"))
    schema = numbered.drop("number").schema.add("sequence_id", "long").add("offset", "long")
    base = int(places[:, 1].max(initial=0)) + 1

    def place(batches):
        starts = places[:, 0] * base + places[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["number"].to_numpy()
            run = places[np.searchsorted(starts, length * base + np.minimum(rank, base - 1), side="right") - 1]
            rank = rank - run[:, 1]
            yield batch.drop(columns="number").assign(sequence_id=run[:, 3] + rank // run[:, 2], offset=run[:, 4] + rank % run[:, 2] * length)

    placed = numbered.mapInPandas(place, schema)
    return placed.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
