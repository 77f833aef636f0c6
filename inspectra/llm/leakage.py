"""Evaluation passages inside corpus documents: q-gram lemma filter in diagonal bands, then banded alignment of words.

Texts are compared as words without case, accents, punctuation, typography, markup and line layout. Every run of
``RUN`` words has at least ``Q`` characters, and each of its q-grams lies on one diagonal (place in the document less
place in the passage). A region is kept only if its band holds as many shared q-grams as the shortest run of the
item has; kept regions are aligned word by word within the band.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a run, characters of a q-gram (a run of four words has at least seven), width of a band of diagonals.
RUN, Q, BAND = 4, 7, 32
#: Bits of the table by which q-grams that no passage has are passed over.
SEEN_BITS = 22
#: Items whose index is held by a worker at a time; more are searched in blocks of so many characters.
BLOCK_CHARS = 8_000_000
#: Windows of a document that are searched at a time; consecutive windows overlap, so no run is cut.
WINDOW_WORDS, OVERLAP_WORDS = 20_000, 4_000

_TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]*>")
_LINK = re.compile(r"\[([^\]]*)\]\((?:[^()\s]*)\)")
_HYPHEN = re.compile(r"(?<=[^\W\d_])(?:[-‐‑¬]|­)[ \t]*(?:\r\n|\r|\n| )[ \t>|*]*(?=[^\W\d_])")
_QUOTED = re.compile(r"(?<=\w)['’‘ʼ`´′](?=\w)")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"), None)


def normal_words(text: str | None) -> list[str]:
    """The words of a text that count for a comparison."""
    if not text:
        return []
    s = html.unescape(text) if "&" in text else text
    s = _LINK.sub(r"\1", s)
    s = _TAG.sub("", s) if "<" in s else s
    s = _HYPHEN.sub("", s)
    s = s.translate(_INVISIBLE)
    s = _QUOTED.sub("", s)
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return _WORD.findall(s.casefold())


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the q-grams of the words joined by blanks, and the number of the word at each character."""
    data = " ".join(words).encode("utf-32-le")
    c = np.frombuffer(data, dtype="<u4").astype(np.uint64)
    n = len(c) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(Q):
        h = h * np.uint64(1_099_511_628_211) + c[i : i + n]
    return h, np.cumsum(c == 32)


class ItemIndex:
    """The q-grams of a block of passages in hash order, for searching documents against all of them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, self.least = [], [], []
        hashes, owners, places, at_word = [], [], [], []
        for item_id, passage in items:
            words = normal_words(passage)
            if len(words) < RUN:
                continue
            h, word_of = _grams(words)
            lengths = np.array([len(w) for w in words])
            shortest = min(int(lengths[i : i + RUN].sum()) + RUN - 1 for i in range(len(words) - RUN + 1))
            k = len(self.ids)
            self.ids.append(item_id)
            self.words.append(words)
            self.least.append(max(1, shortest - Q + 1))
            hashes.append(h)
            owners.append(np.full(len(h), k, np.int32))
            places.append(np.arange(len(h), dtype=np.int32))
            at_word.append(word_of[: len(h)].astype(np.int32))
        cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
        h = cat(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place, self.word = h[order], cat(owners, np.int32)[order], cat(places, np.int32)[order], cat(at_word, np.int32)[order]
        self.least = np.array(self.least, np.int64)
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.seen[self._slot(self.hash)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SEEN_BITS)

    def search(self, words: list[str]) -> dict[int, np.ndarray]:
        """For each item (by position) with an aligned run: which of its words the runs hold."""
        found: dict[int, np.ndarray] = {}
        h, word_of = _grams(words)
        if not len(h) or not len(self.hash):
            return found
        maybe = np.nonzero(self.seen[self._slot(h)])[0]  # most q-grams of a document are in no passage
        lo, hi = np.searchsorted(self.hash, h[maybe], "left"), np.searchsorted(self.hash, h[maybe], "right")
        n = hi - lo
        if not n.any():
            return found
        maybe, lo, n = maybe[n > 0], lo[n > 0], n[n > 0]
        doc_place = np.repeat(maybe, n)
        entry = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        owner = self.owner[entry].astype(np.int64)
        diagonal = doc_place - self.place[entry] + (1 << 30)
        half = diagonal // (BAND // 2)
        kept = np.zeros(len(owner), bool)
        for shift in (0, 1):  # bands overlap by half
            key = owner * (1 << 32) + (half + shift) // 2
            bands, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            kept |= counts[inverse] >= self.least[bands >> 32][inverse]
        if not kept.any():
            return found
        owner, entry, doc_place = owner[kept], entry[kept], doc_place[kept]
        shift = word_of[doc_place] - self.word[entry]
        for pair in np.unique(owner * (1 << 32) + (shift + (1 << 30))):
            k, d = int(pair >> 32), int(pair & 0xFFFFFFFF) - (1 << 30)
            own = self.words[k]
            a, b = max(0, -d), min(len(own), len(words) - d)
            start = None
            for i in range(a, b + 1):
                if i < b and own[i] == words[i + d]:
                    start = i if start is None else start
                elif start is not None:
                    if i - start >= RUN:
                        found.setdefault(k, np.zeros(len(own), bool))[start:i] = True
                    start = None
        return found


def item_blocks(items: DataFrame, item_id: str, passage: str, *, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; an item set is a stated query set and is searched against all documents."""
    block, size = [], 0
    for r in items.select(item_id, passage).where(F.col(passage).isNotNull()).orderBy(item_id).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_items(docs: DataFrame, items: DataFrame, *, doc_id: str, text: str, item_id: str, passage: str, min_share: float = 0.4, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, share)``: documents that hold at least ``min_share`` of an item's words in runs of ``RUN`` or more.

    Documents are read once a block of items and never moved; items cross to the workers in blocks of bounded size. Very
    long texts are searched in overlapping windows of words. NULL or empty texts and passages of fewer than ``RUN``
    words give no row; repeated documents are reported one by one.
    """
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, share double"

    def searcher(block: list[tuple[int, str]]):
        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = ItemIndex(block)
            for batch in batches:
                rows = []
                for doc, content in zip(batch["doc_id"], batch["text"]):
                    words = normal_words(content)
                    held: dict[int, np.ndarray] = {}
                    step = WINDOW_WORDS - OVERLAP_WORDS
                    for at in range(0, max(1, len(words) - OVERLAP_WORDS), step):
                        for k, mask in index.search(words[at : at + WINDOW_WORDS]).items():
                            held[k] = held[k] | mask if k in held else mask
                    rows += [(doc, index.ids[k], float(m.mean())) for k, m in held.items() if m.sum() >= min_share * len(m) - 1e-9]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share"])

        return search

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
    parts = [source.mapInPandas(searcher(b), schema) for b in item_blocks(items, item_id, passage, block_chars=block_chars)]
    if not parts:
        return source.mapInPandas(searcher([]), schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
