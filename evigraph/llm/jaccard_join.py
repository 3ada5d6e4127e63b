"""Op 6, n-gram Jaccard join: chosen paths over minhash sketches, brute force in small buckets, exact counts at the end.

Documents with equal sets of five-word shingles are one class. A class becomes 128 minhashes, so its tokens are
(position, value) pairs and the share of equal tokens estimates the Jaccard similarity. Each run splits all classes
recursively: a node draws one position, in a quarter of the cases two, and sends a class to the child that its value
there names. Nodes with few classes are compared all against all, larger ones are split further; nodes with the same
classes are compared once. A node that is still large at the greatest depth holds classes that share that many drawn
tokens; they are tied to its first class. That gives candidate groups.

Inside each candidate group all pairs are then verified by exact Jaccard similarity of the whole shingle sets, block
against block, so a group of any size is spread over tasks of bounded memory and only counts leave them. A pair of
similarity 0.8 meets in a run with probability 0.64; RUNS runs miss one pair in about 4000.
Where nodes are split to depth 8 it is 0.41, and one pair in about 70 is missed.

Defined results: a text of fewer than five words is one shingle; a null or empty text has none, is its own class and
has no link. Repeated rows are copies of each other. Other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, Kept, WordHash, mixed, passes, shingles, signed, words
from .components import components

GRAM, SIMILARITY = 5, 0.8
HASHES, RUNS = 128, 8
#: Depth to which every run splits at once, depth to which large nodes are split, and classes that a node may compare.
FIRST_DEPTH, LAST_DEPTH, BUCKET = 3, 8, 64
#: Share of equal minhashes that makes a candidate: 0.8 less four standard deviations.
CANDIDATE = 0.66
BLOCK = 256
_DRAW = np.random.default_rng(17).integers(1, 2**63, (2, HASHES), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str, hasher: WordHash) -> np.ndarray:
    return np.unique(shingles(hasher.of(words(text)), GRAM))


def sketch(s: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(s), 2048):
        x = s[i : i + 2048, None] * _DRAW[0][None] + _DRAW[1][None]
        np.minimum(best, (x >> np.uint64(32)).astype(np.uint32).min(0), out=best)
    return best


def split(nodes: np.ndarray, owner: np.ndarray, sketches: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes after some levels: (node, owner) pairs; owner is a row of sketches."""
    with np.errstate(over="ignore"):
        for _ in range(levels):
            h = mixed(nodes * MIX + np.uint64(1))
            again = np.flatnonzero((h >> np.uint64(8)) & np.uint64(3) == 0)
            at = np.concatenate([h & np.uint64(127), (h[again] >> np.uint64(16)) & np.uint64(127)]).astype(np.int64)
            nodes, owner = np.concatenate([nodes, nodes[again]]), np.concatenate([owner, owner[again]])
            nodes = mixed(nodes + mixed(sketches[owner, at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(40))))
    return nodes, owner


def sketches_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHash()
    for batch in batches:
        for part, texts in passes(batch):
            sets = [shingle_set(t, hasher) for t in texts]
            names = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], ["doc_id", "mark", "c1", "c2", "n", "sketch"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            ids, sk = part.column(0).to_numpy(), sketches_of(part.column(1))
            owner = np.tile(np.arange(len(ids)), RUNS)
            nodes, owner = split(np.repeat(mixed(np.arange(1, RUNS + 1, dtype=np.uint64)), len(ids)), owner, sk, FIRST_DEPTH)
            yield pa.RecordBatch.from_arrays([pa.array(signed(nodes)), pa.array(ids[owner])], ["node", "id"])


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            ids, sk = part.column(0).to_numpy(), sketches_of(part.column(1))
            nodes, owner = split(part.column(2).to_numpy().view(np.uint64), np.arange(len(ids)), sk, 1)
            yield pa.RecordBatch.from_arrays([pa.array(signed(nodes)), pa.array(ids[owner])], ["node", "id"])


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal values in the first columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tie(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each class of a node tied to the first it is a candidate with, directly or through others."""
    out: list[tuple[int, int]] = []

    def ready() -> pa.RecordBatch:
        rows = [pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)]
        out.clear()
        return pa.RecordBatch.from_arrays(rows, ["a", "b"])

    for group in groups_of(batches, 1):
        ids, sk = group.column("id").to_numpy(), sketches_of(group.column("sketch").combine_chunks())
        f = Forest(len(ids))
        for i in range(len(ids) - 1):
            for j in np.flatnonzero((sk[i + 1 :] == sk[i]).mean(1) >= CANDIDATE):
                f.tie(i, i + 1 + int(j))
        out += [(int(ids[i]), int(ids[f.root(i)])) for i in range(len(ids)) if f.root(i) != i]
        if len(out) > 5000:
            yield ready()
    yield ready()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHash()
    for batch in batches:
        for part, texts in passes(batch):
            raw = [shingle_set(t, hasher).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(part.schema.names.index(c)) for c in ("id", "component", "blocks", "block", "copies")] + [pa.array(raw, pa.binary())], ["id", "component", "blocks", "block", "copies", "set"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of incidence matrices of some thousand columns."""
    flat, size = np.concatenate(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    out = np.zeros((len(sets), len(sets)), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]]))
        for lo in range(0, int(column[-1]) + 1, 8192):
            a, b = np.searchsorted(column, [lo, lo + 8192])
            m = np.zeros((len(sets), min(8192, int(column[-1]) + 1 - lo)), np.float32)
            m[owner[a:b], column[a:b] - lo] = 1
            out += m @ m.T
    return out


def verifier(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, links, root) of the classes of each pair of blocks; links counts the documents of linked classes."""
        out: list[tuple[int, int, int]] = []

        def ready() -> pa.RecordBatch:
            rows = [pa.array([x[i] for x in out], pa.int64()) for i in range(3)]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, ["id", "links", "root"])

        for group in groups_of(batches, 3):
            bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
            ids, block, copies = (group.column(c).to_numpy() for c in ("id", "block", "copies"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set").combine_chunks()]
            both = overlaps(sets)
            size = np.array([len(s) for s in sets], np.float64)
            link = both / (size[:, None] + size[None] - both) >= similarity - 1e-9
            np.fill_diagonal(link, False)
            if bi != bj:
                link &= block[:, None] != block[None]
            links = link @ copies
            f = Forest(len(ids))
            for i, j in zip(*np.nonzero(np.triu(link)), strict=True):
                f.tie(int(i), int(j))
            out += [(int(ids[i]), int(links[i]), int(ids[f.root(i)])) for i in range(len(ids)) if links[i]]
            if len(out) > 5000:
                yield ready()
        yield ready()

    return run


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, class_id, n_links, copy_id, n_copies): class_id is the smallest id that links reach, n_links how many
    documents are similar to this one, copy_id the smallest id with the same shingles; mark is a hash of the text."""
    kept = Kept(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    marks = kept.keep(rows.mapInArrow(_profile, "doc_id long, mark long, c1 long, c2 long, n long, sketch binary"), "profile")
    classes = marks.where("n > 0").groupBy("c1", "c2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("r"), F.count("*").alias("copies"))
    classes = kept.keep(classes.select("c1", "c2", "r.doc_id", "r.mark", "copies", F.monotonically_increasing_id().alias("id")), "classes")
    own = classes.select(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark"), "id")  # a class of null ids only has one too
    first = marks.select("doc_id", "mark", "sketch").join(own, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark"))).dropDuplicates(["id"])
    sketches = kept.keep(first.select("id", "sketch"), "sketches")

    paths = kept.keep(sketches.mapInArrow(_runs, "node long, id long"), "paths3")
    edges, depth = [], FIRST_DEPTH
    while True:
        count = paths.groupBy("node").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("least")).where("m > 1")
        count = kept.keep(count, f"count{depth}")
        small = count.where(F.col("m") <= BUCKET).groupBy("m", "x", "least").agg(F.min("node").alias("node")).select("node")
        edges.append(kept.keep(_compare(paths.join(small, "node"), sketches), f"edges{depth}"))
        large = count.where(F.col("m") > BUCKET).select("node", "least")
        if large.isEmpty():
            break
        rest = paths.join(large, "node")
        if depth >= LAST_DEPTH:
            edges.append(rest.select(F.col("id").alias("a"), F.col("least").alias("b")))
            break
        depth += 1
        paths = kept.keep(rest.select("id", "node").join(sketches, "id").select("id", "sketch", "node").mapInArrow(_deeper, "node long, id long"), f"paths{depth}")
    tied = edges[0]
    for e in edges[1:]:
        tied = tied.unionByName(e)
    groups = components(tied, kept, "candidates")

    members = groups.withColumnRenamed("node", "id").join(groups.groupBy("component").agg(F.count("*").alias("m")), "component")
    members = members.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = members.join(classes.select("id", "doc_id", "mark", "copies"), "id").select("doc_id", "mark", "id", "component", "blocks", "block", "copies")
    members = members.withColumnsRenamed({"doc_id": "of", "mark": "of_mark"})
    texts = rows.join(members, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark"))).dropDuplicates(["id"]).select("id", "component", "blocks", "block", "copies", "text")
    sets = texts.mapInArrow(_sets, "id long, component long, blocks int, block int, copies long, set binary")
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "id", "block", "copies", "set")
    pairs = pairs.repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")
    links = kept.keep(pairs.mapInArrow(verifier(similarity), "id long, links long, root long"), "links")
    found = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")), kept, "found").withColumnRenamed("node", "id")
    total = links.groupBy("id").agg(F.sum("links").alias("links"))
    named = found.join(classes.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    of = found.join(named, "component").join(total, "id").select("id", "class_id", "links")
    of = classes.join(of, "id", "left").select("c1", "c2", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("doc_id").alias("copy_id"), F.col("copies").alias("n_copies"))
    out = marks.select("doc_id", "mark", F.when(F.col("n") > 0, F.col("c1")).alias("c1"), F.when(F.col("n") > 0, F.col("c2")).alias("c2")).join(of, ["c1", "c2"], "left")
    return out.select("doc_id", "mark", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def _compare(nodes: DataFrame, sketches: DataFrame) -> DataFrame:
    rows = nodes.select("node", "id").join(sketches, "id").select("node", "id", "sketch")
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(_buckets, "a long, b long")
