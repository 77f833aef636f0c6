"""Keyword-stuffed pages and lists of links, by block-wise compression normalized by length and language.

A text is cut into blocks of at most ``BLOCK_WORDS`` words within a paragraph. The words of a block are sorted and
compressed; how far the ratio lies below that of usual blocks of its language and length is its redundancy, whatever
the order of the words. Extreme redundancy makes a block spam, and so does clear redundancy with few sentence ends.
Less redundant blocks are suspects, above all those with few sentence ends; they are confirmed by their words, compared
with the words of the blocks that compression alone has found (a classifier fitted on the blocks of all documents).
"""

from __future__ import annotations

import html
import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectra.session import checkpoint

#: Words a block has at most, and the least with which it can be called redundant.
BLOCK_WORDS, LEAST_WORDS = 250, 12
#: Ratios to the usual one: redundant whatever the punctuation; with few sentence ends.
EXTREME, CLEAR = 0.37, 0.5
#: Ratios to the usual one under which a block is suspect: whatever the punctuation; with few sentence ends.
DENSE, SPARSE = 0.6, 1.1
#: Share of distinct words up to which a block can be suspect whatever its punctuation.
DISTINCT = 0.35
#: Sentence ends per word under which a block is no running text.
FEW_SENTENCES = 0.03
#: Slots that words are hashed to.
SLOTS = 1 << 18

#: Frequent function words, by which the language of a text is told.
FUNCTION_WORDS = {
    "en": "the of and a to in is was that it for on with as at by an be this are from or had not but have has no which his her they we "
          "you were been their said when who will would there if so our my one all".split(),
    "es": "el la los las de y en que un una es por con para se no al lo su del como más pero sus le ya o este sí porque esta entre cuando "
          "muy sin sobre también hay fue si".split(),
    "fr": "le la les des du de et en un une est que pour dans qui sur pas au par plus avec se ce sont il elle nous vous mais ou si leur aux "
          "été cette à près".split(),
}
_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}

_HREF = re.compile(r"<[^<>]*?(?:href|src)\s*=\s*[\"']?([^\"'\s>]+)[^<>]*>", re.I)
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]*>")
#: Where a link points to: its host is one word like any other; the words of its path stay.
_HOST = re.compile(r"(?:\b[a-z]+://)?(?:\b[a-z0-9][a-z0-9-]*\.)+[a-z]{2,}(?![^\W_])", re.I)
#: Words by letters; words written together are cut at inner capitals, capitals in a row are one word.
_PART = re.compile(r"[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+(?![a-zß-öø-ÿ])|[^\W\d_]+")
_END = re.compile(r"[.!?…]+(?=[\s\"'”»)]|$)")


def plain(text: str) -> str:
    """Without character references and markup; the target of a link stays as a word."""
    return _MARKUP.sub(" ", _HREF.sub(r" \1 ", html.unescape(text)))


def words_of(text: str) -> list[str]:
    """The words that count, lower case: hosts as ``link``, joined words in their parts."""
    return [w.lower() for w in _PART.findall(_HOST.sub(" link ", text) if "." in text else text)]


def language(words: list[str]) -> str:
    """The language with the most function words; ``und`` if there are none or two have as many."""
    second, best = sorted((sum(w in s for w in words), k) for k, s in _SETS.items())[-2:]
    return best[1] if best[0] > second[0] else "und"


def _cut(tokens: list[str], target: float) -> list[tuple[list[str], list[str]]]:
    """Runs of tokens with about ``target`` words, ``BLOCK_WORDS`` at most; one token with more words is a run of its own, cut."""
    out, current, words = [], [], []
    for token in tokens:
        own = words_of(token)
        if words and (len(words) + len(own) > BLOCK_WORDS or len(words) >= target):
            out.append((current, words))
            current, words = [], []
        current.append(token)
        words.extend(own)
        while len(words) > BLOCK_WORDS:
            out.append((current, words[:BLOCK_WORDS]))
            current, words = [], words[BLOCK_WORDS:]
    return [*out, (current, words)]


def blocks(text: str) -> list[tuple[int, list[str], int]]:
    """``(tokens, words, sentence ends)`` of each block: paragraphs, cut evenly where they have more than ``BLOCK_WORDS`` words."""
    out = []
    for paragraph in re.split(r"\n\s*\n", text):
        tokens, words = paragraph.split(), words_of(paragraph)
        whole = [(tokens, words)] if len(words) <= BLOCK_WORDS else _cut(tokens, len(words) / math.ceil(len(words) / BLOCK_WORDS))
        out += [(len(t), w, len(_END.findall(" ".join(t)))) for t, w in whole if w]
    return out


def slot(word: str) -> int:
    return zlib.crc32(word.encode()) % SLOTS


_BLOCK = "array<struct<tokens:int,words:int,lang:string,ratio:double,ends:double,terms:array<int>>>"


def _measure(texts: pd.Series, sampled: pd.Series) -> pd.Series:
    """The measures of the blocks of each text; the distinct words of suspects and of documents to learn from as slots."""
    def one(text, keep):
        if not isinstance(text, str) or not text.strip():
            return []
        found = blocks(plain(text))
        lang = language([w for _, ws, _ in found for w in ws])
        rows = []
        for tokens, words, ends in found:
            raw, own = " ".join(sorted(words)).encode(), set(words)
            density = ends / max(1, tokens)
            rows.append({
                "tokens": tokens, "words": len(words), "lang": lang, "ratio": len(zlib.compress(raw, 6)) / len(raw), "ends": density,
                "terms": sorted({slot(w) for w in own}) if keep or density < FEW_SENTENCES or len(own) <= DISTINCT * len(words) else None})
        return rows

    return pd.Series([one(t, k) for t, k in zip(texts, sampled)])


def measured_blocks(docs: DataFrame, doc_id: str, text: str, *, sample_docs: int | None = None) -> DataFrame:
    """One row a block: document, tokens, words, language, compression ratio, sentence ends a token, and whether its words are learnt from.

    They are, in every document; only a caller who gives ``sample_docs`` has them learnt from about so many, chosen by a hash.
    """
    sampled = F.lit(True)
    if sample_docs is not None:
        share = min(1.0, sample_docs / max(1, docs.count()))
        sampled = F.pmod(F.xxhash64(F.col(doc_id), F.length(text)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), sampled.alias("sampled"))
    each = d.select("doc_id", "sampled", F.explode(F.pandas_udf(_measure, _BLOCK)(F.col("text"), F.col("sampled"))).alias("b"))
    return each.select("doc_id", "sampled", "b.*").withColumn("size", F.floor(2 * F.log2("words")).cast("int"))


def usual_ratios(each: DataFrame) -> DataFrame:
    """``(lang, size, usual)``: the median ratio of the blocks of a language and length (a step is half a doubling), and under ``und``
    that of all languages; at most one row a language and step."""
    known = each.where("lang <> 'und'")
    return known.unionByName(known.withColumn("lang", F.lit("und"))).groupBy("lang", "size").agg(F.percentile_approx("ratio", 0.5, 1000).alias("usual"))


def redundant(relative: Column, ends: Column, words: Column) -> Column:
    """What compression and sentence density alone call spam."""
    return (words >= LEAST_WORDS) & ((relative <= EXTREME) | ((relative <= CLEAR) & (ends < FEW_SENTENCES)))


def word_weights(each: DataFrame) -> np.ndarray:
    """For each slot how much likelier its words are in redundant blocks than in running text (log of the ratio, 0 if unseen).

    Counted where they lie, with map-side combine; one row a slot reaches the driver, ``SLOTS`` at most.
    """
    found = redundant(F.col("relative"), F.col("ends"), F.col("words"))
    running = (F.col("relative") >= 0.6) & (F.col("ends") >= FEW_SENTENCES)
    labelled = each.where("sampled").where(found | running).withColumn("label", found.cast("int"))
    n = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros(SLOTS, np.float32)
    if not n.get(1) or not n.get(0):
        return weights
    counts = labelled.select("label", F.explode("terms").alias("slot")).groupBy("slot").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    for r in counts.collect():
        weights[r["slot"]] = math.log((r["a"] + 0.5) / (n[1] + 1)) - math.log((r["b"] + 0.5) / (n[0] + 1))
    return np.clip(weights, -3, 3)


def _weigher(weights: np.ndarray):
    def weigh(terms: pd.Series) -> pd.Series:
        return pd.Series([float(weights[t].mean()) if t is not None and len(t) else 0.0 for t in terms])

    return F.pandas_udf(weigh, "double")


def spam_blocks(docs: DataFrame, doc_id: str, text: str, *, sample_docs: int | None = None, words: bool = True) -> DataFrame:
    """Every block of every document with its measures and whether it is spam; ``words=False`` leaves out the check of the words.

    Texts are read and measured once, and numbers are kept. A block of a language and length that no usual block has
    is compared with all languages, then with itself (and is not redundant).
    """
    each = checkpoint(measured_blocks(docs, doc_id, text, sample_docs=sample_docs))
    usual = checkpoint(usual_ratios(each))  # a row a language and step of the length
    own = F.broadcast(usual)
    any_language = F.broadcast(usual.where("lang = 'und'").select("size", F.col("usual").alias("any_usual")))
    each = each.join(own, ["lang", "size"], "left").join(any_language, "size", "left")
    each = each.withColumn("relative", F.col("ratio") / F.coalesce("usual", "any_usual", "ratio")).drop("usual", "any_usual", "size")
    found = redundant(F.col("relative"), F.col("ends"), F.col("words"))
    if not words:
        return each.withColumn("spam", found).drop("sampled", "terms")
    suspect = ~found & ((F.col("relative") <= DENSE) | ((F.col("ends") < FEW_SENTENCES) & (F.col("relative") < SPARSE)))
    weight = _weigher(word_weights(each))(F.when(suspect, F.col("terms")))
    return each.withColumn("spam", found | (suspect & (weight > 0))).drop("sampled", "terms")


def spam_pages(docs: DataFrame, doc_id: str, text: str, *, min_share: float = 0.5, sample_docs: int | None = None, words: bool = True) -> DataFrame:
    """``(doc_id, share, words)`` of the documents in which more than ``min_share`` of the words stand in spam blocks.

    NULL, empty and wordless texts are none; repeated ids are taken together. An empty table gives an empty result.
    """
    b = spam_blocks(docs, doc_id, text, sample_docs=sample_docs, words=words)
    share = F.sum(F.when(F.col("spam"), F.col("tokens")).otherwise(0)) / F.sum("tokens")
    return b.groupBy("doc_id").agg(share.alias("share"), F.sum("tokens").alias("words")).where(F.col("share") > min_share)
