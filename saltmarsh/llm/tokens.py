"""Problem 7: the whole corpus encoded with a public byte-level BPE vocabulary.

The distinct words of a batch are put in byte order, which is the depth-first traversal of their prefix trie. Each trie
node carries the last token of the encoding of its prefix: the one vocabulary token that ends there and may stand
behind the last token of the prefix before it. Moving to the next word keeps the states of the shared prefix, so every
prefix is encoded once; an encoding is read off by stepping back over last tokens. Words seen in earlier batches come
from a store of bounded size that is emptied, never truncated, when full. There is no shuffle.

Defined results: null and empty texts give an empty list; a text is encoded whole whatever its length; the strings of
special tokens are ordinary text; repeated rows are kept; further columns are ignored.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies are, unless a caller says otherwise.
VOCABULARIES = "/opt/tokenizers"
#: The pattern that splits text before merging (fixed value, public).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words in a worker's store before it is emptied.
STORE = 200_000


def byte_letters() -> dict[str, int]:
    """The public byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for letters from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
    return out


class Encoder:
    """Byte-level BPE of a vocabulary whose ids of merged tokens follow the order of merges."""

    def __init__(self, vocabulary: str) -> None:
        model = json.loads(vocabulary)["model"]
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in s): i for s, i in model["vocab"].items() if all(c in letters for c in s)}
        self.size = [0] * (max(self.ids.values()) + 1)
        for b, i in self.ids.items():
            self.size[i] = len(b)
        vocab, self.parts, self.rank, self.merged = model["vocab"], {}, {}, {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            t = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = r
            if t not in self.parts:
                self.parts[t] = (vocab[a], vocab[b])
                self.rank[t] = r
        self.tails = {b[k:] for b in self.ids for k in range(len(b))}
        self.words = regex.compile(PATTERN)
        self.store: dict[str, list[int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    def follows(self, a: int, b: int) -> bool:
        """Whether BPE of the joined texts of tokens a and b gives just a, b: no merge across the border comes before those that built them."""
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            known = True
            # both tokens are taken apart, latest merge first; a merge over the border that precedes it would have won
            left, right, rank = a, b, self.rank
            limit = 1 << 60  # merges of this rank or later don't count: the token would already have been built
            while True:
                r = self.merged.get((left, right))
                if r is not None and r < limit:
                    known = False
                    break
                ra, rb = rank.get(left, -1), rank.get(right, -1)
                if ra < 0 and rb < 0:
                    break
                if ra >= rb:  # of equal merges the left one is made first, so the right one is undone first below
                    if ra == rb and rb >= 0:
                        limit, right = rb + 1, self.parts[right][0]
                    else:
                        limit, left = ra, self.parts[left][1]
                else:
                    limit, right = rb + 1, self.parts[right][0]
            self.fits[key] = known
        return known

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of words in byte order: a depth-first walk of their trie."""
        out = []
        last: list[int] = []
        before = b""
        ids, tails, follows, size = self.ids, self.tails, self.follows, self.size
        for w in words:
            shared = len(os.path.commonprefix((before, w)))
            del last[shared:]
            for end in range(shared + 1, len(w) + 1):
                start, found = end - 1, -1
                while start >= 0:
                    piece = w[start:end]
                    if piece not in tails:
                        break
                    t = ids.get(piece)
                    if t is not None and (start == 0 or follows(last[start - 1], t)):
                        found = t
                        break
                    start -= 1
                last.append(found)
            at, got = len(w), []
            while at:
                t = last[at - 1]
                got.append(t)
                at -= size[t]
            out.append(got[::-1])
            before = w
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.words.findall(t) if t else [] for t in texts]
        store = self.store
        new = {w for ws in split for w in ws if w not in store} if store else set(chain.from_iterable(split))
        if len(store) + len(new) > STORE:
            store.clear()
            new = set(chain.from_iterable(split))
        if new:
            order = sorted((w.encode("utf-8", "surrogatepass"), w) for w in new)
            for (_, w), e in zip(order, self.encode_words([b for b, _ in order])):
                store[w] = e
        get = store.__getitem__
        return [list(chain.from_iterable(map(get, ws))) for ws in split]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(held) -> Encoder:
    """One encoder a worker process and vocabulary."""
    key = hash(held.value)  # of one string object, so computed once
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(held.value)
    return _ENCODERS[key]


def broadcast_vocabulary(spark: SparkSession, path: str | None = None):
    """The vocabulary file, sent to the executors once; its size is that of a public file, about 2 MB."""
    with open(path or f"{VOCABULARIES}/byte_bpe_50k.json", encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def token_ids(spark: SparkSession, text: str | Column, vocabulary: str | None = None) -> Column:
    held = broadcast_vocabulary(spark, vocabulary)

    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(_encoder(held).encode([t if isinstance(t, str) else None for t in texts]))

    return F.pandas_udf(encode, "array<int>")(text)


def token_counts(spark: SparkSession, text: str | Column, vocabulary: str | None = None) -> Column:
    held = broadcast_vocabulary(spark, vocabulary)

    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in _encoder(held).encode([t if isinstance(t, str) else None for t in texts])], dtype="int32")

    return F.pandas_udf(count, "int")(text)


def encode_documents(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return documents.select("doc_id", token_ids(documents.sparkSession, "text", vocabulary).alias("ids"))
