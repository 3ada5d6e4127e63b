"""Op 9, toxicity: a convolutional text classifier in numpy.

A word's embedding is the mean of hashed rows for the word and its three-letter pieces. Filters of several widths
slide over the words, the largest response of each filter over the whole text feeds a logistic unit. It is trained
with Adagrad; gradients flow through the positions of the maxima only. All labelled rows outside the held-out fifth are
used: a first shard fits a model, every other goes on from it with its own rows, and the weights are averaged. Thresholds for rejection are calibrated
for each language on the fifth of the training rows that no fit has seen; language, source and id are never inputs of the score.

Defined results: a null or empty text is scored as one blank word. Repeated rows are scored each. Without any
training row every score is 0. Labels that are null or repeated for a document: nulls are left out, a document counts
once with its largest label. Other columns are ignored. Texts are scored whole, in pieces of bounded memory."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, passes, words

ROWS, DIM, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 12
#: Labelled rows, and characters, that a shard has, about; a shard also has about LEAST_OF_CLASS rows of the rarer class.
TRAIN_ROWS, TRAIN_BYTES, LEAST_OF_CLASS = 6_000, 64_000_000, 50
#: Models that a task averages at once.
MERGED = 16
#: Steps of gradient descent at least, more until each row was taken; each takes half its rows from either class.
STEPS, BATCH, RATE, SEED = 1000, 32, 0.1, 5
CACHE_WORDS = 300_000
PIECE_WORDS = 100_000


def buckets(word: str) -> list[int]:
    """Embedding rows of a word: itself and its three-letter pieces. Row 0 is blank."""
    w = f"<{word}>"
    return [1 + xxhash.xxh32_intdigest(x) % (ROWS - 1) for x in (word, *(w[i : i + 3] for i in range(len(w) - 2)))]


class Model:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.e = (rng.standard_normal((ROWS, DIM)) * 0.3).astype(np.float32)
        self.e[0] = 0
        self.w = [(rng.standard_normal((k, DIM, FILTERS)) * (1.0 / np.sqrt(k * DIM))).astype(np.float32) for k in WIDTHS]
        self.b = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32)
        self.bias = np.float32(-1.0)
        self.thresholds: dict[str, float] = {}
        self.sums = None  # of squared gradients, to go on fitting
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((0, DIM), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "rows": np.zeros((0, DIM), np.float32)}

    def embed(self, texts_words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(vectors of all words, each text followed by blanks, and where each text begins)."""
        need = set().union(*texts_words).difference(self.cache) if texts_words else set()
        if len(self.cache) + len(need) > CACHE_WORDS:
            self.cache, self.rows = {}, np.zeros((0, DIM), np.float32)
            need = set().union(*texts_words)
        if need or not len(self.rows):
            fresh = ["", *need] if not len(self.rows) else list(need)
            parts = [[0] if not w else buckets(w) for w in fresh]
            flat, size = np.concatenate([np.array(p, np.int64) for p in parts]), np.array([len(p) for p in parts])
            vectors = np.add.reduceat(self.e[flat], np.cumsum(size) - size, axis=0) / size[:, None].astype(np.float32)
            self.cache.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            self.rows = np.concatenate([self.rows, vectors.astype(np.float32)])
        pad = [""] * (max(WIDTHS) - 1)
        flat = [x for ws in texts_words for x in (*(ws or [""]), *pad)]
        ids = np.fromiter(map(self.cache.__getitem__, flat), np.int64, len(flat))
        size = np.array([max(len(ws), 1) + len(pad) for ws in texts_words])
        return self.rows[ids], np.cumsum(size) - size

    def pooled(self, texts_words: list[list[str]]) -> np.ndarray:
        """Largest response of each filter over each text; long texts are taken piece by piece, with the overlap that the widths need."""
        reach = max(WIDTHS) - 1
        out = np.full((len(texts_words), len(self.b)), -np.inf, np.float32)
        piece: list[list[str]] = []
        owner: list[int] = []
        total = 0

        def flush() -> None:
            nonlocal piece, owner, total
            if piece:
                x, at = self.embed(piece)
                for j, k in enumerate(WIDTHS):
                    h = x[: len(x) - reach] @ self.w[j][0]
                    for i in range(1, k):
                        h += x[i : len(x) - reach + i] @ self.w[j][i]
                    best = self._segment_max(h, at, reach)
                    cols = slice(j * FILTERS, (j + 1) * FILTERS)
                    np.maximum.at(out[:, cols], np.array(owner), best)
            piece, owner, total = [], [], 0

        for d, ws in enumerate(texts_words):
            for i in range(0, max(len(ws) - reach, 1), PIECE_WORDS):
                part = ws[i : i + PIECE_WORDS + reach]
                piece.append(part)
                owner.append(d)
                total += len(part)
                if total >= PIECE_WORDS:
                    flush()
        flush()
        return out

    @staticmethod
    def _segment_max(h: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
        ends = np.append(at[1:], len(h) + reach) - reach  # rows of the blanks between texts don't count
        edges = np.stack([at, ends], 1).ravel()
        if edges[-1] == len(h):
            edges = edges[:-1]
        return np.maximum.reduceat(h, edges, axis=0)[::2]

    def score(self, texts_words: list[list[str]]) -> np.ndarray:
        z = np.maximum(self.pooled(texts_words) + self.b, 0) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))

    def fit(self, texts_words: list[list[str]], y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> None:
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for ws in texts_words for w in ws))}
        parts = [buckets(w) for w in vocabulary]
        size = np.array([len(p) for p in parts], np.int64)
        flat = np.concatenate([np.array(p, np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
        first = np.cumsum(size) - size
        docs = [np.array([vocabulary[w] for w in ws], np.int64) for ws in texts_words]
        rng = np.random.default_rng(seed)
        eps = np.float32(1e-6)
        g_e = np.full((ROWS, 1), 1e-3, np.float32)
        g_w, g_b, g_out, g_bias = [np.full_like(w, 1e-3) for w in self.w], np.full_like(self.b, 1e-3), np.full_like(self.out, 1e-3), np.float32(1e-3)
        if self.sums:
            g_e, g_w, g_b, g_out, g_bias = self.sums
        reach = max(WIDTHS) - 1
        classes = [np.flatnonzero(y == c) for c in (0, 1)]
        steps = max(steps, *(-(-len(c) // (BATCH // 2)) for c in classes))
        turns = [np.concatenate([rng.permutation(c) for _ in range(-(-steps * BATCH // 2 // len(c)))]) for c in classes]
        for step in range(steps):
            part = np.concatenate([t[step * BATCH // 2 : (step + 1) * BATCH // 2] for t in turns])
            ids = np.unique(np.concatenate([docs[i] for i in part] + [np.zeros(0, np.int64)]))
            if not len(ids):
                continue
            take = np.concatenate([np.arange(first[i], first[i] + size[i]) for i in ids])
            rows, per = flat[take], size[ids]
            vec = np.add.reduceat(self.e[rows], np.cumsum(per) - per, axis=0) / per[:, None].astype(np.float32)
            vec = np.concatenate([vec, np.zeros((1, DIM), np.float32)])
            blank = np.full(reach, len(ids))
            local = [np.concatenate([np.searchsorted(ids, docs[i]) if len(docs[i]) else np.array([len(ids)]), blank]) for i in part]
            stream = np.concatenate(local)
            sizes = np.array([len(x) for x in local])
            at = np.cumsum(sizes) - sizes
            x = vec[stream]
            best, where = np.empty((len(part), len(self.b)), np.float32), np.empty((len(part), len(self.b)), np.int64)
            for j, k in enumerate(WIDTHS):
                h = sum(x[i : len(x) - reach + i] @ self.w[j][i] for i in range(k))
                cols = slice(j * FILTERS, (j + 1) * FILTERS)
                for d, (a, n) in enumerate(zip(at, sizes - reach, strict=True)):
                    where[d, cols] = a + h[a : a + n].argmax(0)
                best[:, cols] = np.take_along_axis(h, where[:, cols], 0)
            feature = np.maximum(best + self.b, 0)
            p = 1 / (1 + np.exp(-np.clip(feature @ self.out + self.bias, -30, 30)))
            dz = ((p - y[part]) / len(part)).astype(np.float32)
            d_out = feature.T @ dz
            d_f = dz[:, None] * self.out[None, :] * (best + self.b > 0)
            d_vec = np.zeros_like(vec)
            for j, k in enumerate(WIDTHS):
                cols = slice(j * FILTERS, (j + 1) * FILTERS)
                g, pos = d_f[:, cols], where[:, cols]
                for i in range(k):
                    src = stream[pos + i]
                    d_w = np.einsum("df,dfe->ef", g, vec[src])
                    np.add.at(d_vec, src.ravel(), (g[:, :, None] * self.w[j][i].T[None]).reshape(-1, DIM))
                    g_w[j][i] += d_w**2
                    self.w[j][i] -= RATE * d_w / np.sqrt(g_w[j][i] + eps)
            d_b = d_f.sum(0)
            for value, grad, acc in ((self.out, d_out, g_out), (self.b, d_b, g_b)):
                acc += grad**2
                value -= RATE * grad / np.sqrt(acc + eps)
            g_bias += dz.sum() ** 2
            self.bias -= np.float32(RATE) * dz.sum() / np.sqrt(g_bias + eps)
            hit = np.flatnonzero(np.abs(d_vec[:-1]).sum(1))
            if len(hit):
                use = np.concatenate([np.arange(first[i], first[i] + size[i]) for i in ids[hit]])
                d_rows = np.repeat(d_vec[hit] / size[ids[hit], None], size[ids[hit]], axis=0).astype(np.float32)
                touched, inverse = np.unique(flat[use], return_inverse=True)
                d_e = np.zeros((len(touched), DIM), np.float32)
                np.add.at(d_e, inverse, d_rows)
                g_e[touched] += (d_e**2).mean(1, keepdims=True)
                self.e[touched] -= RATE * d_e / np.sqrt(g_e[touched] + eps)
        self.sums = g_e, g_w, g_b, g_out, g_bias
        self.cache, self.rows = {}, np.zeros((0, DIM), np.float32)


def calibrate(scores: np.ndarray, y: np.ndarray) -> float:
    """The threshold with fewest errors, in the middle of the widest such gap."""
    order = np.argsort(scores)
    s, t = scores[order], y[order].astype(float)
    errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    edges = np.concatenate([[0.0], s, [1.0]])
    i = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[i] + edges[i + 1]) / 2)


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def untrained() -> Model:
    """The model that scores 0."""
    model = Model()
    model.out[:], model.bias = 0, np.float32(-30)
    return model


def average(models: list[tuple[int, Model]]) -> Model:
    """The mean of models' weights, each counted as often as it has rows."""
    total, out = sum(n for n, _ in models), Model()
    mean = lambda get: sum(np.float64(n / total) * get(m) for n, m in models).astype(np.float32)
    out.e, out.b, out.out, out.bias = mean(lambda m: m.e), mean(lambda m: m.b), mean(lambda m: m.out), mean(lambda m: m.bias)
    out.w = [mean(lambda m, j=j: m.w[j]) for j in range(len(WIDTHS))]
    return out


def calibrated(model: Model, scores: np.ndarray, y: np.ndarray, lang: np.ndarray) -> Model:
    """The model whose best cut over all languages is 0.5, with thresholds by language."""
    logit = lambda p: np.log(p / (1 - p))
    scores = np.clip(scores, 1e-13, 1 - 1e-13)
    shift = logit(np.clip(calibrate(scores, y), 1e-6, 1 - 1e-6))
    model.bias -= np.float32(shift)
    scores = 1 / (1 + np.exp(shift - logit(scores)))
    model.thresholds = {"": 0.5}
    for name in sorted(set(lang) - {""}):
        at = lang == name
        if min(y[at].sum(), (1 - y[at]).sum()) >= 5:
            model.thresholds[str(name)] = calibrate(scores[at], y[at])
    return model


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One model of all of a task."""
    sofar: tuple[int, Model] | None = None
    for batch in batches:
        for n, raw in zip(batch.column("n").to_pylist(), batch.column("model"), strict=True):
            got = (n, pickle.loads(raw.as_py()))
            sofar = got if sofar is None else (sofar[0] + n, average([sofar, got]))
    if sofar:
        yield pa.RecordBatch.from_arrays([pa.array([sofar[0]], pa.int64()), pa.array([pickle.dumps(sofar[1])], pa.binary())], ["n", "model"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Model:
    """Fits the classifier to all labelled documents outside the held-out fifth, in shards of about `rows` and `most_bytes`.

    A task fits one shard at a time, the first before all others; others average the models, MERGED at once; only weights, about 2 MB a model, and the
    scores of the rows that calibrate come together. A repeated id counts once."""
    kept = Kept(docs.sparkSession)
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("_doc")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang"))
    texts = texts.join(marked, "_doc").withColumn("fold", F.pmod(F.xxhash64("_doc"), F.lit(5)) == 4)
    data = kept.keep(texts, "labelled")
    sizes = data.groupBy("fold", "_y").agg(F.countDistinct("_doc").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    if len({r._y for r in sizes}) < 2:
        return untrained()
    apart = len(sizes) == 4  # both classes on both sides
    fit = data.where("NOT fold") if apart else data
    sizes = [r for r in sizes if not (apart and r.fold)]
    rare = min(sum(r.n for r in sizes if r._y == c) for c in (0, 1))
    shards = max(1, min(max(-(-sum(r.n for r in sizes) // rows), -(-sum(r.chars for r in sizes) // most_bytes)), rare // LEAST_OF_CLASS))
    fit = fit.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "_doc"), F.lit(shards)).cast("int"))
    order = [F.col("shard"), F.xxhash64("_doc"), F.col("_doc"), F.xxhash64("text")]
    shard = lambda of, n: fit.where(of).repartition(n, "shard").sortWithinPartitions(*order).select("shard", "_doc", "text", "_y")

    start = None

    def fitted(taken: list[tuple[str, int]], shard: int) -> Iterator[pa.RecordBatch]:
        y = np.array([t[1] for t in taken], np.float32)
        if len(set(y)) == 2:
            model = pickle.loads(start.value) if start else Model()
            model.fit([words(t[0]) for t in taken], y, steps=0 if start else STEPS)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([len(y)], pa.int64()), pa.array([pickle.dumps(model)], pa.binary())], ["shard", "n", "model"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: list[tuple[str, int]] = []
        last = None
        for batch in batches:
            for shard, doc, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last and shard != last[0]:
                    yield from fitted(taken, last[0])
                    taken = []
                if (shard, doc) != last:
                    taken.append((text, y))
                last = (shard, doc)
        if last:
            yield from fitted(taken, last[0])

    kind = "shard long, n long, model binary"
    models = kept.keep(shard("shard = 0", 1).mapInArrow(run, kind), "first")
    if shards > 1:
        row = models.select("model").first()
        start = docs.sparkSession.sparkContext.broadcast(bytes(row.model)) if row else None
        models = kept.keep(models.unionByName(shard("shard > 0", shards - 1).mapInArrow(run, kind)), "models")
    left, i = shards, 0
    while left > 1:
        left, i = -(-left // MERGED), i + 1
        models = models.repartition(left, F.col("shard") % left).drop("shard").mapInArrow(_merge, "n long, model binary")
        models = kept.keep(models.withColumn("shard", F.monotonically_increasing_id()), f"models{i}")
    row = models.select("model").first()
    if row is None:
        return untrained()
    model = pickle.loads(row.model)
    checked = (data.where("fold") if apart else data).dropDuplicates(["_doc"]).select(F.col("_doc").alias("doc_id"), "text", "lang", "_y")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in passes(batch):
                yield pa.RecordBatch.from_arrays([pa.array(held.value.score([words(t) for t in raw])), part.column("_y"), part.column("lang")], ["score", "y", "lang"])

    got = checked.mapInArrow(judge, "score double, y int, lang string").toArrow()
    kept.drop("labelled", "first", "models", *(f"models{k + 1}" for k in range(i)))
    return calibrated(model, got["score"].to_numpy(), got["y"].to_numpy().astype(np.float32), np.array(got["lang"].to_pylist()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, rejected) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for part, texts in passes(batch):
                s = m.score([words(t) for t in texts])
                least = np.array([m.thresholds.get(x, m.thresholds.get("", 1.1)) for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(least), pa.array(s >= least)], ["doc_id", "held_out", "score", "predicted", "threshold", "rejected"])

    lang = F.col(lang_col) if lang_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.coalesce(lang, F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, threshold double, rejected boolean")
