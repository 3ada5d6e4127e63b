"""Op 4, substring dedup: collinear chains of shared k-mer seeds, aligned to find fuzzy passages.

Equal texts are one text. Of each text, the k-word windows whose hash is least among their neighbours (minimizers) are
seeds; any run of K + W - 1 equal words shares one. Every occurrence of a seed is matched with the first text that has
it, so a passage that thousands of texts share makes one match for each occurrence and not all pairs. The second occurrence
in a text is matched with the second in the first text and so on, counted round, so words that repeat side by side make one
long chain and not one passage for each repeat. A seed of at most FEW occurrences matches all their pairs. Where a text's neighbouring seeds of more occurrences belong to different first texts,
or to places of one that are far apart, the two together are a seed of the next level, whether or not changed words lie
between them, and so on until none is left: texts that share a passage meet even if its parts stand in different earlier texts. The matches of two texts are chained by a Fenwick tree over the places in the first
text: a chain ascends in both texts and pays for gaps. Chains are then aligned word by word between their seeds and
extended at both ends, and passages of enough words and identity are returned; a chain that is not alike enough as a whole
is split at the gap that loses most words, so a passage is not lost with what stands beside it.

A seed that more than one in HOT of a sample's texts have falls into PARTS parts by text; each part has a first text of its
own, and the first texts of the parts are matched with the first of all. The sample only decides where rows are sorted.

Defined results: a null or empty text has no passage. Equal texts give a row that spans the text, if it is
long enough; rows that repeat an id and its text give none, and rows without an id are reported with a null id. Passages
repeated within one text only give none. Other columns are ignored. Texts are taken whole; they are split into words once and
held as 32 bits of each word's hash."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, WordHash, passes, shingles, signed, words

K, W = 6, 4
LEAST_WORDS, IDENTITY = 50, 0.8
#: Cost of a word of gap in a chain, where a seed is worth its K words; words looked at beyond both ends of a chain.
GAP, MARGIN = 0.05, 60
#: Words that one numpy pass works on.
PASS_WORDS = 500_000
#: Occurrences of a seed up to which all their pairs are matched.
FEW = 8
#: Texts that are looked at for hot seeds, about; a seed is hot if more than one in HOT of them have it.
SAMPLE, HOT, PARTS = 5_000, 500, 64


def minimizers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed, place) of the least of every W neighbouring K-word windows."""
    if len(hashes) < K:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = shingles(hashes, K)
    w = min(W, len(s))
    at = np.unique(sliding_window_view(s, w).argmin(1) + np.arange(len(s) - w + 1))
    return s[at], at


def chains(a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    """Best disjoint chains of matches (a ascending) as lists of match numbers."""
    da, db = np.diff(a), np.diff(b)
    if len(a) == 1 or (da.min() > 0 and db.min() > 0 and GAP * (da + db).max() < K):
        return [list(range(len(a)))]  # all ascend and every gap costs less than a seed: one chain
    order = np.lexsort((b, a))
    ranks = np.unique(b)
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (len(ranks) + 1)
    score, before = np.zeros(len(a)), np.full(len(a), -1)
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and a[order[j]] == a[order[i]]:
            j += 1
        for m in order[i:j]:  # matches at one place of the text can't follow each other
            r, best = bisect_left(ranks, b[m]), (-np.inf, -1)
            while r > 0:
                best = max(best, tree[r])
                r -= r & -r
            gain = best[0] - GAP * (a[m] + b[m])
            score[m] = K + max(0.0, gain)
            before[m] = best[1] if gain > 0 else -1
        for m in order[i:j]:
            r, now = bisect_left(ranks, b[m]) + 1, (score[m] + GAP * (a[m] + b[m]), int(m))
            while r <= len(ranks):
                tree[r] = max(tree[r], now)
                r += r & -r
        i = j
    used, out = np.zeros(len(a), bool), []
    for m in np.argsort(-score, kind="stable"):
        chain = []
        while m >= 0 and not used[m]:
            used[m] = True
            chain.append(int(m))
            m = before[m]
        if chain:
            out.append(chain[::-1])
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with `raw`, 32 bits for each word, instead of the text."""
    hasher = WordHash()
    for batch in batches:
        for part, texts in passes(batch):
            raw = [hasher.of(words(t)).astype(np.uint32).tobytes() for t in texts]
            rest = part.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(raw, pa.binary())], [*rest.schema.names, "raw"])


def _numbered(seed: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each seed stands earlier in its row."""
    order = np.lexsort((row, seed))
    s, r = seed[order], row[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])])
    at = np.arange(len(s))
    out = np.empty(len(s), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, id, at): above the place's 32 bits, `at` holds how often the seed stands earlier in the text."""
    for batch in batches:
        ids, raw = batch.column("id").to_numpy(), batch.column("raw").to_pylist()
        edges = np.cumsum([0, *map(len, raw)]) // (4 * PASS_WORDS)
        cuts = [0, *(np.flatnonzero(np.diff(edges)) + 1).tolist(), len(raw)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            got = [minimizers(np.frombuffer(x, np.uint32).astype(np.uint64)) for x in raw[lo:hi]]
            n = [len(s) for s, _ in got]
            if not sum(n):
                continue
            seed, row = np.concatenate([s for s, _ in got]), np.repeat(np.arange(lo, hi), n)
            at = np.concatenate([p for _, p in got]).astype(np.int64) | (_numbered(seed, row) << 32)
            yield pa.RecordBatch.from_arrays([pa.array(signed(seed)), pa.array(ids[row]), pa.array(at)], ["seed", "id", "at"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, ref, places, ref_places) of all chains, those of a single seed too, from matches sorted by (id, ref, at)."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["id", "ref", "places", "ref_places"]
    held: list[np.ndarray] | None = None

    def ready(doc: np.ndarray, ref: np.ndarray, at: np.ndarray, ref_at: np.ndarray) -> pa.RecordBatch:
        edges = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1])) + 1, [len(doc)]])
        size = np.diff(edges)
        one = edges[:-1][size == 1]  # a single match is a chain
        offsets = pa.array(np.arange(len(one) + 1, dtype=np.int32))
        lone = [pa.array(doc[one]), pa.array(ref[one]), *(pa.ListArray.from_arrays(offsets, pa.array(x[one].astype(np.int32))) for x in (at, ref_at))]
        rows = []
        for i in np.flatnonzero(size > 1):
            cut = slice(edges[i], edges[i + 1])
            a, b = at[cut], ref_at[cut]
            rows += [(int(doc[edges[i]]), int(ref[edges[i]]), a[chain].tolist(), b[chain].tolist()) for chain in chains(a, b)]
        more = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays([x.cast(t), y]) for x, y, t in zip(lone, more, kinds, strict=True)], names)

    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in ("id", "ref", "at", "ref_at")]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        last = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
        if last:
            yield ready(*(c[:last] for c in cols))
        held = [c[last:] for c in cols]
    if held is not None and len(held[0]):
        yield ready(*held)


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of a longest common subsequence, by rows of bits."""
    rows: dict[int, int] = {}
    for j, y in enumerate(b.tolist()):
        rows[y] = rows.get(y, 0) | (1 << j)
    full, v = (1 << len(b)) - 1, (1 << len(b)) - 1
    for x in a.tolist():
        m = rows.get(x, 0) & v
        v = ((v + m) | (v - m)) & full
    return len(b) - bin(v).count("1")


def extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words, matches) of the best equal-length start of both: a mismatch costs two matches."""
    n = min(len(a), len(b), MARGIN)
    if n == 0:
        return 0, 0
    same = a[:n] == b[:n]
    gain = np.cumsum(np.where(same, 1, -2))
    best = int(gain.argmax())
    return (best + 1, int(same[: best + 1].sum())) if gain[best] > 0 else (0, 0)


def align(x: np.ndarray, y: np.ndarray, px: list[int], py: list[int]) -> tuple[int, int, int, int, int]:
    """(start, end) in x, (start, end) in y, matches: exact seeds, longest common subsequences of the gaps, extended ends."""
    matches, ax, ay = 0, px[0], py[0]
    for i, j in zip(px, py, strict=True):
        if i < ax or j < ay:  # overlaps the seed before: what is new of it
            step = max(ax - i, ay - j)
            if step >= K:
                continue
            i, j, size = i + step, j + step, K - step
        else:
            size = K
        gx, gy = x[ax:i], y[ay:j]
        if len(gx) and len(gy):
            matches += int((gx == gy).sum()) if len(gx) == len(gy) else common_words(gx, gy)
        matches += size
        ax, ay = i + size, j + size
    right, more = extend(x[ax:], y[ay:])
    left, less = extend(x[: px[0]][::-1], y[: py[0]][::-1])
    return px[0] - left, ax + right, py[0] - left, ay + right, matches + more + less


def lost(x: np.ndarray, y: np.ndarray, px: list[int], py: list[int]) -> list[int]:
    """Words that each gap between seeds leaves unmatched, about."""
    out = []
    for i, j, i2, j2 in zip(px, py, px[1:], py[1:], strict=False):
        gx, gy = x[i + K : i2], y[j + K : j2]
        equal = 0
        if len(gx) and len(gy):
            equal = int((gx == gy).sum()) if len(gx) == len(gy) else common_words(gx, gy)
        out.append(max(abs((i2 - i) - (j2 - j)), max(len(gx), len(gy)) - equal))
    return out


def stretches(x: np.ndarray, y: np.ndarray, px: list[int], py: list[int], least_words: int, identity: float) -> Iterator[tuple[int, int, int, int, int]]:
    """Passages of a chain as align() gives them: a chain that is not alike enough as a whole is split at the gap that loses most words."""
    gaps, todo = None, [(0, len(px))]
    while todo:
        lo, hi = todo.pop()
        got = align(x, y, px[lo:hi], py[lo:hi])
        a, b, c, d, matches = got
        if b - a >= least_words and matches >= identity * max(b - a, d - c):
            yield got
        elif hi - lo > 1:
            gaps = lost(x, y, px, py) if gaps is None else gaps
            if (most := max(gaps[lo : hi - 1])) > 0:
                cut = gaps.index(most, lo, hi - 1) + 1
                todo += [(cut, hi), (lo, cut)]


def _reach(lone: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Words that chains of a single seed span with extended ends, as align() finds them; a side is (hashes, first, end, seed) by numbers of words."""
    spot, total = np.arange(MARGIN), np.full(len(lone), K)
    for step in (1, -1):
        there, room = [], []
        for h, first, end, seed in sides:
            start = seed[lone] + K if step > 0 else seed[lone] - 1
            room.append(end[lone] - start if step > 0 else start - first[lone] + 1)
            there.append(h[np.clip(start[:, None] + step * spot, 0, len(h) - 1)])
        same = (there[0] == there[1]) & (spot < np.minimum(*room)[:, None])
        gain = np.cumsum(np.where(same, 1, -2), 1)
        best = gain.argmax(1)
        total += np.where(gain[np.arange(len(lone)), best] > 0, best + 1, 0)
    return total


def _align(batches: Iterator[pa.RecordBatch], least_words: int, identity: float) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "end", "ref_doc_id", "ref_start", "ref_end", "matches"]
    for batch in batches:
        out, single = [], pa.compute.list_value_length(batch.column("places")).to_numpy() == 1
        lone, sides = np.flatnonzero(single), []
        if len(lone):  # most chains are single seeds, and few of them reach a passage's length
            for raw, places, lo in (("raw_a", "places", "lo_a"), ("raw_b", "ref_places", "lo_b")):
                column, at = batch.column(raw), batch.column(places)
                edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
                firsts = at.flatten().to_numpy()[np.cumsum([0, *pa.compute.list_value_length(at).to_pylist()])[:-1]]
                hashes = np.frombuffer(column.buffers()[2], np.uint32, count=edges[-1])
                sides.append((hashes, edges[:-1], edges[1:], edges[:-1] + firsts - batch.column(lo).to_numpy()))
            single[lone[_reach(lone, sides) >= least_words]] = False
        for r in batch.filter(pa.array(~single)).to_pylist():
            x, y = np.frombuffer(r["raw_a"], np.uint32), np.frombuffer(r["raw_b"], np.uint32)
            px, py = [p - r["lo_a"] for p in r["places"]], [p - r["lo_b"] for p in r["ref_places"]]
            for a, b, c, d, m in set(stretches(x, y, px, py, least_words, identity)):
                out.append((r["doc_id"], a + r["lo_a"], b + r["lo_a"], r["ref_doc_id"], c + r["lo_b"], d + r["lo_b"], m))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(7)], names)


def _placed(rows: DataFrame) -> DataFrame:
    """(id, ref, at, ref_at): the later occurrences of a key in a text, `nth` from 0, stand with those of its first text, counted round."""
    cols = ["id", "ref", "at", "ref_at"]
    places = rows.where("id = ref").groupBy("key", "part").agg(F.sort_array(F.collect_list("at")).alias("spots")).where(F.size("spots") > 1)
    later = rows.where("id != ref AND nth > 0").join(places, ["key", "part"], "left")
    later = later.withColumn("ref_at", F.expr("if(spots IS NULL, ref_at, get(spots, nth % size(spots)))"))
    return rows.where("id != ref AND nth = 0").select(*cols).unionByName(later.select(*cols))


def _matches(texts: DataFrame, least_words: int, kept: Kept) -> DataFrame:
    """(id, ref, at, ref_at): places of seeds in texts, each with the place in the first text that has the seed."""
    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(1 + texts.count() // SAMPLE)) == 0).select("id", "raw")
    seeds = "seed long, id long, at long"
    hot = sample.mapInArrow(_seeds, seeds).where("shiftright(at, 32) = 0").groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > 20 + sample.count() / HOT)
    hot = kept.keep(hot.select("seed", F.lit(True).alias("hot")), "hot")  # a bounded sample has few such seeds
    occurs = texts.select("id", "raw").mapInArrow(_seeds, seeds).join(F.broadcast(hot), "seed", "left")
    occurs = occurs.withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).otherwise(-1)).drop("hot")
    order = Window.partitionBy("seed", "part").orderBy("id", "at")
    top = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("seed", "part")
    whole, last = F.count("*").over(every).alias("n"), F.max("id").over(every).alias("last")
    shared = occurs.select("seed", "part", "id", "at", F.first("id").over(top).alias("ref"), F.first("at").over(top).alias("ref_at"), F.lead("id").over(order).alias("next"), whole, last)
    # of the first text only its last occurrence is `main`; the others are there to be matched
    shared = shared.where("last != ref OR part >= 0").withColumn("main", F.expr("id != ref OR coalesce(next != id, false) OR (part >= 0 AND at = ref_at)"))
    low = lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1)).cast("int").alias(c)
    nth = F.shiftright("at", 32).cast("int").alias("nth")
    shared = kept.keep(shared.select(F.col("seed").alias("key"), "part", "id", low("at"), nth, "ref", low("ref_at"), F.when(F.col("part") < 0, F.col("n")).alias("n"), "main"), "shared")
    tops = shared.where("part >= 0 AND id = ref").select("key", "id", "at", "nth")  # the first texts of the parts of hot seeds
    first = tops.groupBy("key").agg(F.min(F.struct("id", "at")).alias("f")).select("key", F.col("f.id").alias("ref"), F.col("f.at").alias("ref_at"))
    found = [_placed(shared), _placed(tops.join(first, "key").withColumn("part", F.lit(-1)))]
    shared = shared.where("main")

    def among(level: DataFrame) -> DataFrame:
        """The pairs of few occurrences beside those with the first."""
        few = level.where(f"id != ref AND n BETWEEN 3 AND {FEW}").select("key", "id", "at")
        earlier = few.select("key", F.col("id").alias("ref"), F.col("at").alias("ref_at"))
        return few.join(earlier, "key").where("ref < id").select("id", "ref", "at", "ref_at")

    found.append(among(shared))
    # neighbours of different first texts, in the first level of places far apart in one too; after `least_words` levels a key alone spans a passage
    level = shared.select("key", "id", "at", "ref", "ref_at", "n")
    for i in range(least_words):
        row = Window.partitionBy("id").orderBy("at")
        ahead = {c: F.lead(c).over(row).alias(f"{c}_2") for c in ("key", "at", "ref", "ref_at")}
        pairs = level.where(f"n IS NULL OR n > {FEW}").select("key", "id", "at", "ref", "ref_at", *ahead.values())
        apart = "ref_2 != ref" if i else f"ref_2 != ref OR (id != ref AND abs(ref_at_2 - ref_at) > {2 * MARGIN})"
        pairs = pairs.where(f"at_2 - at <= {MARGIN} AND ({apart})")
        pairs = kept.keep(pairs.select(F.xxhash64("key", "key_2").alias("key"), "id", "at"), f"pairs{i}")
        first = pairs.groupBy("key").agg(F.min(F.struct("id", "at")).alias("f"), F.max("id").alias("last"), F.count("*").alias("n")).where("f.id < last")
        level = kept.keep(pairs.join(first.select("key", F.col("f.id").alias("ref"), F.col("f.at").alias("ref_at"), "n"), "key"), f"level{i}")
        kept.drop(f"pairs{i}")
        if level.isEmpty():
            break
        nth = F.row_number().over(Window.partitionBy("key", "id").orderBy("at")) - 1
        found += [_placed(level.withColumns({"nth": nth, "part": F.lit(-1)})), among(level)]
    return reduce(DataFrame.unionByName, found).distinct()


def passages(docs: DataFrame, least_words: int = LEAST_WORDS, identity: float = IDENTITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, ref_doc_id, ref_start, ref_end, matches, identity): stretches of words that repeat one
    of an earlier text, where earlier is of smaller id among equal texts and any fixed order among others."""
    kept = Kept(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    same = kept.keep(rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "same")
    one = rows.join(same, ["t1", "t2"]).where("doc_id <=> first").dropDuplicates(["t1", "t2"])
    texts = one.select(F.monotonically_increasing_id().alias("id"), "doc_id", "t1", "t2", F.col("n").alias("copies"), "text")
    texts = kept.keep(texts.mapInArrow(_hashed, "id long, doc_id long, t1 long, t2 long, copies long, raw binary"), "texts")
    # copies take the length of their first, so no text is shuffled for them
    size = F.expr("octet_length(raw) div 4").alias("n")
    whole = rows.select("doc_id", "t1", "t2").join(texts.where("copies > 1").select("t1", "t2", F.col("doc_id").alias("first"), size), ["t1", "t2"])
    whole = whole.where(F.col("n") >= least_words).select("doc_id", "first", "n")
    matches = _matches(texts, least_words, kept)
    found = matches.repartition("id", "ref").sortWithinPartitions("id", "ref", "at").mapInArrow(_chain, "id long, ref long, places array<int>, ref_places array<int>")
    found = kept.keep(found, "chains")
    kept.drop("shared", "hot", *(f"level{i}" for i in range(least_words)))
    # first the text's stretch goes along, then that of the text it refers to is cut beside it and both are aligned
    low = lambda places: F.greatest(F.col(places)[0] - MARGIN, F.lit(0))
    cut = lambda places, lo: F.expr(f"substring(raw, 4 * {lo} + 1, 4 * (element_at({places}, -1) + {K + MARGIN} - {lo}))")
    pairs = found.withColumns({"lo_a": low("places"), "lo_b": low("ref_places")}).join(texts.select("id", "doc_id", "raw"), "id")
    pairs = pairs.select("ref", "doc_id", "places", "ref_places", "lo_a", "lo_b", cut("places", "lo_a").alias("raw_a"))
    pairs = pairs.join(texts.select(F.col("id").alias("ref"), F.col("doc_id").alias("ref_doc_id"), "raw"), "ref")
    pairs = pairs.select("doc_id", "ref_doc_id", "places", "ref_places", "lo_a", "lo_b", "raw_a", cut("ref_places", "lo_b").alias("raw_b"))
    spans = pairs.mapInArrow(partial(_align, least_words=least_words, identity=identity), "doc_id long, start long, end long, ref_doc_id long, ref_start long, ref_end long, matches long")
    share = F.col("matches") / F.greatest(F.col("end") - F.col("start"), F.col("ref_end") - F.col("ref_start"))
    spans = spans.withColumn("identity", share).where((F.col("end") - F.col("start") >= least_words) & (F.col("identity") >= identity))
    spans = spans.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "ref_doc_id", "ref_start", "ref_end", "matches", "identity")
    copies = whole.where("NOT doc_id <=> first").select("doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"), F.col("first").alias("ref_doc_id"), F.lit(0).cast("long").alias("ref_start"), F.col("n").alias("ref_end"), F.col("n").alias("matches"), F.lit(1.0).alias("identity"))
    return spans.unionByName(copies)
