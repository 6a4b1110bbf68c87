"""Held-out passages inside a corpus: n-grams of words of the test items, looked up in every text.

The n-grams of the items are indexed on the driver in blocks of bounded size and broadcast; each block is one pass over the corpus. One block is held at
a time: where there are several, the hits of a block are written to the shared folder and its broadcast is destroyed before the next one is built.
Texts are read whole, in Arrow batches. A hit of the hash is compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.llm.text import WORD, plain, words
from flowquarry.session import cut

FACTOR = np.uint64(0x9E3779B97F4A7C15)
LONG = 1 << 20
#: Characters of items that one broadcast may hold: about 20 bytes for each of their words, and their different words.
MAX_CHARS = 50_000_000


@dataclass
class GramIndex:
    """The windows of n words of all items, sorted by hash. A window is a place in ``words``, where the items stand one after the other."""

    n: int
    vocabulary: dict[str, int]
    words: np.ndarray
    hashes: np.ndarray
    at: np.ndarray
    item: np.ndarray  # row of ``ids``
    ids: list


def _roll(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n word numbers."""
    m = len(ids) - n + 1
    h = np.zeros(max(m, 0), np.uint64)
    u = ids.astype(np.uint64)
    for k in range(n):
        h = h * FACTOR + u[k : k + m]
    return h


def build_index(items: list[tuple[int, str]], n: int) -> GramIndex:
    """Items of under n words hold no n-gram; null texts likewise."""
    vocabulary: dict[str, int] = {}
    texts = [np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in words(text or "")], np.int32) for _, text in items]
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    windows = np.maximum(sizes - n + 1, 0)
    item = np.repeat(np.arange(len(items), dtype=np.int32), windows)
    at = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(ends - sizes, windows)
    every = np.concatenate(texts) if texts else np.empty(0, np.int32)
    h = _roll(every, n)[at] if len(at) else np.empty(0, np.uint64)
    order = np.argsort(h, kind="stable")
    return GramIndex(n, vocabulary, every, h[order], at[order], item[order], [i for i, _ in items])


def _numbers(text: str, get) -> np.ndarray:
    t = plain(text)
    if len(t) < LONG:
        return np.array([get(w.lower(), 0) for w in WORD.findall(t)], np.int64)
    return np.fromiter((get(m.group().lower(), 0) for m in WORD.finditer(t)), np.int64)


def hits(ids: np.ndarray, index: GramIndex) -> Iterator[tuple[int, int]]:
    """(window, row of the item) for each window of known words that is a window of an item. 0 is a word no item has."""
    n = index.n
    if len(ids) < n or len(index.hashes) == 0:
        return
    unknown = np.concatenate(([0], np.cumsum(ids == 0)))
    windows = np.flatnonzero(unknown[n:] == unknown[:-n])
    if len(windows) == 0:
        return
    h = _roll(ids, n)[windows]
    lo, hi = np.searchsorted(index.hashes, h, "left"), np.searchsorted(index.hashes, h, "right")
    for k in np.flatnonzero(hi > lo):
        w = int(windows[k])
        for g in range(lo[k], hi[k]):
            at = index.at[g]
            if np.array_equal(index.words[at : at + n], ids[w : w + n]):
                yield w, int(index.item[g])


def _passes(corpus: DataFrame, items: DataFrame, n: int, item_id: str, text: str, max_chars: int, scan: Callable[..., Iterator[pd.DataFrame]], schema: T.StructType, columns: list[str]) -> DataFrame:
    """``scan`` (batches, index) over the corpus once for each block of items, the results together."""
    spark = corpus.sparkSession
    size = items.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    k = max(1, -(-size // max_chars))
    out = None
    for b in range(k):
        part = items.select(item_id, text).filter(F.pmod(F.xxhash64(item_id), F.lit(k)) == b) if k > 1 else items.select(item_id, text)
        shared = spark.sparkContext.broadcast(build_index([tuple(r) for r in part.collect()], n))

        def over(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            return scan(batches, shared.value)

        found = corpus.select(*columns).filter(F.length(text) > 0).mapInPandas(over, schema)
        if k == 1:
            return found
        found = cut(found, "hits")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def leaks(corpus: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, item_id, n_windows, first_word, last_word): texts that hold at least n consecutive words of an item, and where.

    Words are counted from 0; last_word is the last word of the last window. Items beyond ``max_chars`` characters are taken in
    blocks, a pass over the corpus each, one after the other. Null and empty texts and items of under n words match nothing.
    An item id that repeats holds the n-grams of all its rows.
    """
    schema = T.StructType([corpus.schema[doc_id], items.schema[item_id], *[T.StructField(c, T.IntegerType()) for c in ("n_windows", "first_word", "last_word")]])

    def scan(batches: Iterator[pd.DataFrame], ix: GramIndex) -> Iterator[pd.DataFrame]:
        get = ix.vocabulary.get
        for pdf in batches:
            rows = []
            for doc, t in zip(pdf[doc_id], pdf[text], strict=True):
                spans: dict = {}
                for w, i in set(hits(_numbers(t, get), ix)):
                    spans.setdefault(ix.ids[i], set()).add(w)
                rows += [(doc, item, len(s), min(s), max(s) + ix.n - 1) for item, s in spans.items()]
            yield pd.DataFrame(rows, columns=schema.names)

    return _passes(corpus, items, n, item_id, text, max_chars, scan, schema, [doc_id, text])


def without_leaks(corpus: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, n_removed, clean_text): the plain form of each text without the words of any window that leaked; texts without leaks stay as they are.

    Null and empty texts come out unchanged. doc_id must be unique. The places of all blocks of items are gathered by document, a few numbers each, and then met with the texts.
    """
    places = T.StructType([corpus.schema[doc_id], T.StructField("__from", T.ArrayType(T.IntegerType()))])

    def scan(batches: Iterator[pd.DataFrame], ix: GramIndex) -> Iterator[pd.DataFrame]:
        get = ix.vocabulary.get
        for pdf in batches:
            rows = [(doc, sorted({w for w, _ in hits(_numbers(t, get), ix)})) for doc, t in zip(pdf[doc_id], pdf[text], strict=True)]
            yield pd.DataFrame([r for r in rows if r[1]], columns=places.names)

    found = _passes(corpus, items, n, item_id, text, max_chars, scan, places, [doc_id, text])
    per = found.groupBy(F.col(doc_id).alias("__doc")).agg(F.flatten(F.collect_list("__from")).alias("__from"))
    schema = T.StructType([corpus.schema[doc_id], T.StructField("n_removed", T.IntegerType()), T.StructField("clean_text", T.StringType())])

    def cut_out(t: str | None, starts) -> tuple[int, str | None]:
        if starts is None or len(starts) == 0:
            return 0, t
        p = plain(t)
        spots = [m.span() for m in WORD.finditer(p)]
        keep = np.ones(len(spots), bool)
        for w in starts:
            keep[w : w + n] = False
        parts, at = [], 0
        for (a, b), k in zip(spots, keep, strict=True):
            if not k:
                parts.append(p[at:a])
                at = b
        parts.append(p[at:])
        return int((~keep).sum()), "".join(parts)

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(d, *cut_out(t, s)) for d, t, s in zip(pdf[doc_id], pdf[text], pdf["__from"], strict=True)], columns=schema.names)

    return corpus.select(doc_id, text).join(per, F.col(doc_id) == F.col("__doc"), "left").select(doc_id, text, "__from").mapInPandas(clean, schema)
