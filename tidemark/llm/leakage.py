"""Evaluation texts inside the training corpus, by suffix arrays.

Each shard of the corpus gets the suffix array of its words, built without any evaluation text; every suffix of the evaluation
texts is looked up in it by binary search, word by word, and the places found are extended to the longest verbatim match.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import require_columns, spread

#: Consecutive words that count as a leak.
MIN_WORDS = 10
#: Words of evaluation text searched at once; more items are searched block after block in the suffix array of each shard.
ITEM_WORDS = 500_000
#: Words at which a shard is closed; a longer document is a shard of its own.
SHARD_WORDS = 2_000_000
#: Places of matches held at once.
_PLACES = 1_000_000

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_INVISIBLE = dict.fromkeys([0x200B, 0x2060, 0x00AD, 0xFEFF])
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Comparable words: tags are blanks, invisible marks nothing, then NFKC, lower case, runs of letters and digits."""
    if not text:
        return []
    text = text.translate(_INVISIBLE) if not text.isascii() else text
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower()
        # Folding may bring forth another mark or a composable letter after lower-casing.
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
    else:
        text = text.lower()
    return _WORD.findall(text)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``codes`` in lexical order, by prefix doubling; a suffix that ends comes before one that goes on.

    Only suffixes that still tie are sorted again, so repeated texts cost a round for each doubling of their length and the rest two or three.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    fresh = np.concatenate([[True], codes[order[1:]] != codes[order[:-1]]])[:n]
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied, step = np.arange(n), 1
    while True:
        own = rank[order[tied]]
        again = np.zeros(len(tied), dtype=bool)
        same = own[1:] == own[:-1]
        again[1:] |= same
        again[:-1] |= same
        tied, own = tied[again], own[again]
        if not len(tied):
            return order
        starts = order[tied]
        ahead = starts + step
        key = own * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        starts, key = starts[by], key[by]
        order[tied] = starts
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[starts] = np.maximum.accumulate(np.where(fresh, tied, 0))
        step *= 2


def _narrow(codes: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each range [low, high) of the suffix array whose suffixes have the ``wanted`` code at ``depth``, by binary search."""

    def edge(a: np.ndarray, z: np.ndarray, after: bool) -> np.ndarray:
        a, z = a.copy(), z.copy()
        while len(live := np.flatnonzero(a < z)):
            mid = (a[live] + z[live]) // 2
            place = order[mid] + depth
            code = np.where(place < len(codes), codes[np.minimum(place, len(codes) - 1)], np.iinfo(codes.dtype).min)
            right = code <= wanted[live] if after else code < wanted[live]
            a[live[right]], z[live[~right]] = mid[right] + 1, mid[~right]
        return a

    begin = edge(low, high, False)
    return begin, edge(begin, high, True)


def find_matches(codes: np.ndarray, order: np.ndarray, tests: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(test place, text place, length) of all matches of at least ``depth`` codes that can be extended to neither side.

    ``order`` is the suffix array of ``codes``. Negative codes match nothing. The range of a test suffix is narrowed word by word while it is
    not empty. Of its places only those are kept that no earlier word precedes alike, a bounded number at a time, so a repetitive text
    gives a match once and not once for each word of it.
    """
    at = np.flatnonzero(tests >= 0)
    low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(codes), dtype=np.int64)
    for k in range(depth):
        inside = at + k < len(tests)
        at, low, high = at[inside], low[inside], high[inside]
        wanted = tests[at + k]
        known = wanted >= 0
        at, low, high, wanted = at[known], low[known], high[known], wanted[known]
        low, high = _narrow(codes, order, low, high, wanted, k)
        some = high > low
        at, low, high = at[some], low[some], high[some]
    ends = np.cumsum(high - low)
    found = []
    for s in range(0, int(ends[-1]) if len(ends) else 0, _PLACES):
        flat = np.arange(s, min(s + _PLACES, int(ends[-1])))
        which = np.searchsorted(ends, flat, "right")
        t, d = at[which], order[high[which] - (ends[which] - flat)]
        before = (t > 0) & (d > 0) & (tests[t - 1] >= 0) & (tests[t - 1] == codes[d - 1])
        found.append((t[~before], d[~before]))
    t = np.concatenate([np.zeros(0, dtype=np.int64), *[f[0] for f in found]])
    d = np.concatenate([np.zeros(0, dtype=np.int64), *[f[1] for f in found]])
    length, live = np.full(len(t), depth), np.arange(len(t))
    while len(live):
        a, b = t[live] + length[live], d[live] + length[live]
        live = live[(a < len(tests)) & (b < len(codes))]
        a, b = t[live] + length[live], d[live] + length[live]
        live = live[(tests[a] >= 0) & (tests[a] == codes[b])]
        length[live] += 1
    return t, d, length


class _Items:
    """Words of evaluation texts in one row, the items separated by None."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.words: list[str | None] = []
        self.starts: list[int] = []
        self.ids: list[int] = []
        for item, words in items:
            self.starts.append(len(self.words))
            self.ids.append(item)
            self.words += [*words, None]


def _shards(batches: Iterator[pd.DataFrame], depth: int, most: int) -> Iterator[tuple[np.ndarray, dict[str, int], np.ndarray, np.ndarray]]:
    """Per shard: codes of its words, the code of each word, and the starts and ids of its documents. A negative code of its own ends each document."""
    code: dict[str, int] = {}
    parts: list[np.ndarray] = []
    starts: list[int] = []
    ids: list[int] = []
    held = 0
    for b in batches:
        for doc, text in zip(b["doc_id"], b["text"]):
            words = words_of(text)
            if len(words) < depth:
                continue
            starts.append(held)
            ids.append(doc)
            parts.append(np.fromiter((code.setdefault(w, len(code)) for w in words), dtype=np.int32, count=len(words)))
            parts.append(np.array([-len(ids)], dtype=np.int32))
            held += len(words) + 1
            if held >= most:
                yield np.concatenate(parts), code, np.array(starts), np.array(ids)
                code, parts, starts, ids, held = {}, [], [], [], 0
    if parts:
        yield np.concatenate(parts), code, np.array(starts), np.array(ids)


_MATCHES = "item_id long, doc_id long, n_words int, item_word int, doc_word int"


def leaked_passages(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, item_words: int = ITEM_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """All passages of at least ``min_words`` words that documents of ``docs`` (doc_id LONG, text) share with items of ``items`` (item_id LONG, text).

    Null or empty texts and null ids match nothing; repeated rows count once; extra columns are ignored; empty tables give no rows.
    Items reach the tasks in blocks of about ``item_words`` words; the corpus is read, and its suffix arrays are built, once for all blocks.
    Result, one row for each passage that can be extended to neither side: item_id, doc_id, n_words, item_word and doc_word (where it starts, in words).
    """
    require_columns(docs, ["doc_id", "text"])
    require_columns(items, ["item_id", "text"])
    spark = docs.sparkSession
    corpus = spread(docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL AND length(text) >= 2"))
    blocks, block, size = [], [], 0
    for row in items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct().toLocalIterator(prefetchPartitions=True):
        words = words_of(row["text"])
        if len(words) >= min_words:
            block.append((row["item_id"], words))
            size += len(words)
        if size >= item_words:
            blocks.append(spark.sparkContext.broadcast(_Items(block)))
            block, size = [], 0
    if block:
        blocks.append(spark.sparkContext.broadcast(_Items(block)))
    if not blocks:
        return spark.createDataFrame([], _MATCHES)

    def run(batches):
        for codes, code, starts, ids in _shards(batches, min_words, shard_words):
            order = suffix_array(codes)
            for shared in blocks:
                it = shared.value
                # Words that the shard lacks, and the ends of items, match nothing.
                tests = np.fromiter((code.get(w, -1) for w in it.words), dtype=np.int64, count=len(it.words))
                t, d, n = find_matches(codes, order, tests, min_words)
                item, doc = np.searchsorted(it.starts, t, "right") - 1, np.searchsorted(starts, d, "right") - 1
                yield pd.DataFrame({
                    "item_id": np.array(it.ids)[item], "doc_id": ids[doc], "n_words": n, "item_word": t - np.array(it.starts)[item], "doc_word": d - starts[doc],
                })

    # Repeated rows of a document may lie in different shards.
    return corpus.mapInPandas(run, _MATCHES).distinct()


def leaked_items(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, item_words: int = ITEM_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each document and item of ``leaked_passages`` with its longest passage, of equal ones the first in the item, then in the document."""
    hits = leaked_passages(docs, items, min_words, item_words, shard_words)
    best = F.max(F.struct("n_words", (-F.col("item_word")).alias("i"), (-F.col("doc_word")).alias("d"))).alias("m")
    return hits.groupBy("item_id", "doc_id").agg(best).select(
        "item_id", "doc_id", F.col("m.n_words").alias("n_words"), (-F.col("m.i")).alias("item_word"), (-F.col("m.d")).alias("doc_word")
    )


def remove_leaked(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the documents of ``found``; all columns are kept."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
