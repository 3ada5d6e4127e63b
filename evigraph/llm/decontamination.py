"""Op 8, benchmark decontamination: every training passage is a query against a BM25 inverted index of test items.

Impacts are divided by a share of the item's score for itself, so one threshold, 1, holds for all items. Passages are
two strides long and a stride is as long as the longest item of its length group, so a whole copy of an item lies in
one passage. Items stand in blocks; block maxima of the rare terms, plus what the other terms can give an item of the
block, bound a passage's score there. Blocks whose bound reaches the threshold go through WAND, which returns every
item above it. A hit is a leak when the item's question and its answer
both overlap with the passage in words, five in a row, to a given share.

An item's answer is its last sentence, or its second half when it has one sentence. A part of n < 5 words is one window
of n words, sought among the passage's windows of n words; where both parts are that short, the windows are the whole item's.

The index of a pass over the documents has at most SHARD_BYTES of item text, which is what is broadcast; with more
items there are more passes, each exact, with statistics of all items.

Defined results: null or empty texts and items have no words and match nothing. Repeated rows give repeated hits,
repeated items count as items each. Other columns are ignored. Texts are queried whole."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, passes, shingles, words

K1, B = 1.2, 0.75
#: Share of an item's own score that retrieves it, and of its question's and answer's five-word windows that make a leak.
SCORE_SHARE, OVERLAP, GRAM = 0.75, 0.8, 5
BLOCK = 8
LEAST_STRIDE = 32
SHARD_BYTES = 4_000_000
#: Terms in at most this share of the items are bounded each, the others by their joint share of an item.
RARE_SHARE = 0.05


def parts(text: str) -> tuple[list[str], list[str]]:
    """(question words, answer words)."""
    sentences = [w for s in re.split(r"(?<=[.!?])\s+|\n+", text) if (w := words(s))]
    if len(sentences) >= 2:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    ws = words(text)
    return ws[: len(ws) // 2], ws[len(ws) // 2 :]


class Index:
    """BM25 postings of some items of like length, with block maxima; statistics are those of all items."""

    def __init__(self, items: list[tuple[int, list[str], str]], n_items: int, mean_words: float, df: dict[str, int], share: float):
        self.ids, self.parts = [], []
        lists: dict[str, list[tuple[int, float]]] = {}
        common = np.zeros(len(items))
        self.stride = max(LEAST_STRIDE, max(len(ws) for _, ws, _ in items))
        rare_df = RARE_SHARE * n_items
        for i, (item, ws, text) in enumerate(items):
            self.ids.append(item)
            question, answer = parts(text)
            short = max(len(question), len(answer)) < GRAM  # single words of both could stand anywhere
            self.parts.append(tuple(self.grams(ws if short and p else p) for p in (question, answer)))
            scale = K1 * (1 - B + B * len(ws) / max(mean_words, 1))
            impact = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + scale) for t, n in Counter(ws).items()}
            need = share * sum(impact.values())
            for t, x in impact.items():
                lists.setdefault(t, []).append((i, x / need))
                common[i] += (x / need) * (df[t] > rare_df)
        self.term = {t: k for k, t in enumerate(lists, 1)}
        self.items = [[], *([i for i, _ in p] for p in lists.values())]
        self.impacts = [[], *([x for _, x in p] for p in lists.values())]
        self.n_blocks = -(-len(items) // BLOCK)
        self.most = [max(x, default=0.0) for x in self.impacts]
        self.block_max: list[dict[int, float]] = []
        for places, values in zip(self.items, self.impacts, strict=True):
            top: dict[int, float] = {}
            for i, x in zip(places, values, strict=True):
                top[i // BLOCK] = max(top.get(i // BLOCK, 0.0), x)
            self.block_max.append(top)
        # for the bound of whole passages: the blocks of each rare term, and what the other terms give an item of a block at most
        rare = [False, *(df[t] <= rare_df for t in lists)]
        flat = [(b, x) for t, top in enumerate(self.block_max) if rare[t] for b, x in top.items()]
        self.size = np.array([len(top) if rare[t] else 0 for t, top in enumerate(self.block_max)], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat_block, self.flat_max = np.array([b for b, _ in flat], np.int64), np.array([x for _, x in flat])
        self.common = np.array([common[k : k + BLOCK].max() for k in range(0, len(items), BLOCK)])

    @staticmethod
    def grams(ws: list[str]) -> tuple[int, np.ndarray]:
        """(words of a window, different windows)"""
        return min(len(ws), GRAM), np.unique(shingles(WordHash().of(ws), GRAM)) if ws else np.zeros(0, np.uint64)

    def search(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """Block-max WAND inside one block: the items whose score over these distinct terms is 1 or more."""
        lo, hi, slack = block * BLOCK, (block + 1) * BLOCK, 1 - 1e-9
        lists = []
        for t in terms:
            if block in self.block_max[t]:
                k = bisect_left(self.items[t], lo)
                lists.append([self.items[t][k], k, t, self.block_max[t][block]])
        found = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for x in lists:
                bound += x[3]
                if bound >= slack:
                    pivot = x[0]
                    break
            if pivot < 0:
                break
            if lists[0][0] == pivot:
                score = sum(self.impacts[t][k] for at, k, t, _ in lists if at == pivot)
                if score >= slack:
                    found.append((pivot, score))
                pivot += 1
            keep = []
            for x in lists:
                if x[0] < pivot:
                    x[1] = bisect_left(self.items[x[2]], pivot, x[1])
                    x[0] = self.items[x[2]][x[1]] if x[1] < len(self.items[x[2]]) else hi
                if x[0] < hi:
                    keep.append(x)
            lists = keep
        return found

    def open_blocks(self, ids: np.ndarray, doc: np.ndarray, place: np.ndarray, first: np.ndarray, n_passages: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs whose bound reaches the threshold; passage first[d] + j is blocks j and j + 1 of the words of text d."""
        if (self.common >= 1 - 1e-9).any():  # items without rare terms: all that could match stay open
            free = np.flatnonzero(self.common >= 1 - 1e-9)
        else:
            free = np.zeros(0, np.int64)
        at = np.flatnonzero(self.size[ids])
        ids, doc, place = ids[at], doc[at], place[at]
        key = doc * np.int64(len(self.size)) + ids
        order = np.argsort(key, kind="stable")
        before = np.full(len(ids), -1, np.int64)
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        before[order[same + 1]] = place[order[same]]
        j = place // self.stride
        own = np.flatnonzero(before < j * self.stride)  # a term counts once in a passage
        last = np.flatnonzero((before < (j - 1) * self.stride) & (j > 0))
        passage = np.concatenate([(first[doc] + j)[own], (first[doc] + j - 1)[last]])
        term = np.concatenate([ids[own], ids[last]])
        n = self.size[term]
        spot = np.repeat(self.begin[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair = np.repeat(passage, n) * self.n_blocks + self.flat_block[spot]
        pairs, inverse = np.unique(pair, return_inverse=True)
        total = np.bincount(inverse, self.flat_max[spot], len(pairs)) if len(pairs) else np.zeros(0)
        got = pairs[total + self.common[pairs % self.n_blocks] >= 1 - 1e-9]
        if len(free):
            got = np.unique(np.concatenate([got, (np.arange(n_passages)[:, None] * self.n_blocks + free[None]).ravel()]))
        return got // self.n_blocks, got % self.n_blocks


class Vocabulary(dict):
    """word → number, 0 for all other words."""

    def __missing__(self, word: str) -> int:
        return 0


class Indexes:
    """One index for each doubling of item lengths, so short items are sought in short passages."""

    def __init__(self, items: list[tuple[int, str]], n_items: int, mean_words: float, df: dict[str, int], share: float = SCORE_SHARE):
        groups: dict[int, list[tuple[int, list[str], str]]] = {}
        for item, text in items:
            if ws := words(text):
                groups.setdefault((max(len(ws), LEAST_STRIDE) - 1).bit_length(), []).append((item, ws, text))
        self.share = share
        self.each = [Index(sorted(g, key=lambda x: (sorted(df[w] for w in x[1])[len(x[1]) // 2], x[0])), n_items, mean_words, df, share) for g in groups.values()]

        self.vocabulary = Vocabulary()
        for ix in self.each:
            for t in ix.term:
                self.vocabulary.setdefault(t, len(self.vocabulary) + 1)
        self.local = [np.zeros(len(self.vocabulary) + 1, np.int64) for _ in self.each]
        for ix, local in zip(self.each, self.local, strict=True):
            for t, k in ix.term.items():
                local[self.vocabulary[t]] = k

    def hits(self, texts: list[str], hasher: WordHash) -> list[tuple[int, int, float, float, float]]:
        """(text, item id, share of the item's own score, question overlap, answer overlap) of all items above the threshold, best passage each."""
        split = [words(t) for t in texts]
        size = np.array([len(w) for w in split], np.int64)
        flat = [w for ws in split for w in ws]
        known = np.fromiter(map(self.vocabulary.__getitem__, flat), np.int64, len(flat))
        begins = np.cumsum(size) - size
        doc = np.repeat(np.arange(len(texts)), size)
        place = np.arange(len(flat)) - begins[doc]
        best: dict[tuple[int, int, int], tuple[float, float, float, float]] = {}
        for g, ix in enumerate(self.each):
            ids = self.local[g][known]
            n = np.maximum(-(-size // ix.stride), 1)
            first = np.cumsum(n) - n
            for p, block in zip(*ix.open_blocks(ids, doc, place, first, int(n.sum())), strict=True):
                d = int(np.searchsorted(first, p, side="right") - 1)
                a = int(p - first[d]) * ix.stride
                b = min(a + 2 * ix.stride, int(size[d]))
                terms = set(ids[begins[d] + a : begins[d] + b].tolist())
                terms.discard(0)
                got = ix.search(list(terms), int(block))
                if got:
                    hashes = hasher.of(split[d][a:b])
                    grams = {k: np.unique(shingles(hashes, k)) for k in {k for item, _ in got for k, _ in ix.parts[item] if k}}
                    for item, score in got:
                        q, w = (float(np.isin(x, grams[k]).mean()) if k else 1.0 for k, x in ix.parts[item])
                        now = (min(q, w), q, w, score * self.share)
                        if best.get((d, g, item), (-1.0,)) < now:
                            best[d, g, item] = now
        return [(d, self.each[g].ids[item], s, q, w) for (d, g, item), (_, q, w, s) in best.items()]


def search(docs: DataFrame, items: DataFrame, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, leaked) of all pairs above the threshold; score is the share of the item's own."""
    spark = docs.sparkSession
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text")).where(F.trim("item_text") != "")
    n, size, n_words = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0)), F.coalesce(F.avg(F.size(F.split("item_text", r"\W+"))), F.lit(1.0))).first()
    shards = max(1, math.ceil(2 * size / shard_bytes)) if size > shard_bytes else 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    of = F.pmod(F.xxhash64("item_id", "item_text"), F.lit(shards))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(s, w) for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in set(words(t))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in pairs], pa.int64()), pa.array([w for _, w in pairs], pa.string())], ["shard", "term"])

    each = items.select(of.alias("shard"), "item_text").mapInArrow(terms, "shard long, term string")
    df_all = each.groupBy("term").agg(F.count("*").alias("df"), F.collect_set("shard").alias("shards"))
    found = []
    for s in range(shards):
        own = [(r.item_id, r.item_text) for r in items.where(of == s).toLocalIterator()]  # about shard_bytes at most
        df = {r.term: r.df for r in df_all.where(F.array_contains("shards", F.lit(s).cast("long"))).select("term", "df").toLocalIterator()}
        if own:
            found.append(_pass(rows, spark.sparkContext.broadcast(Indexes(own, n, n_words, df)), overlap))
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, leaked boolean")
    return reduce(DataFrame.unionByName, found)


def _pass(rows: DataFrame, index, overlap: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ix = WordHash(), index.value
        for batch in batches:
            for part, texts in passes(batch):
                got = ix.hits(texts, hasher)
                ids = part.column(0).to_pylist()
                cols = list(zip(*((ids[d], i, s, q, w, q >= overlap and w >= overlap) for d, i, s, q, w in got), strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 2 + [pa.float64()] * 3 + [pa.bool_()], strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "leaked"])

    return rows.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, leaked boolean")
