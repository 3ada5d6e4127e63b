"""Op 1, packing: documents in Hilbert order of their hashed token vectors, cut into full sequences.

Defined results: a null text is the empty one, and an empty document is its end id alone. Repeated rows are packed
once each. An empty table gives an empty result. Other columns of the input are ignored. Documents with equal keys
follow one another by id, so one vector that a third of all rows share is still cut over many partitions."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, passes

#: Hashed counts that make a document's vector, dimensions it is projected to, and bits of a dimension in the key.
BUCKETS, DIMS, BITS = 512, 4, 10
#: The split and the normalisation for which a text may be encoded piece by piece (fixed values of the tokenizer's file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = ["NFC", "Replace", "Lowercase"]
#: The same split for texts below U+0250, where every character is in NFC and lower case is taken sign by sign.
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\u00b2\u00b3\u00b9\u00bc-\u00be]+|[\d\u00b2\u00b3\u00b9\u00bc-\u00be]|(?:[^\w\s]|_)+")
NOT_LATIN = re.compile(r"[^\x00-\u024f]|[\x1c-\x1f]")
CONTROLS = "\x1c\x1d\x1e\x1f"
CACHE = 1_500_000


class Encoder:
    """Token ids of texts as bytes; equal to the library's ids, with cached pieces of the split."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4")
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_piece = pre[0].get("pattern", {}).get("Regex") == SPLIT and pre[0].get("behavior") == "Removed" and steps == STEPS and spec["model"].get("end_of_word_suffix") == "</w>" and all(not any(c.isspace() for c in a["content"]) for a in spec["added_tokens"])
        self.added = [a["content"] for a in spec["added_tokens"]]
        self.last = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.last[i] = token.endswith("</w>")
        self.piece: dict[str, bytes] = {}

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, seen: set[str]) -> None:
        """Fills the cache with the ids of lower-case chunks; a chunk of letters is a piece of the split, others fall into
        pieces first. Beyond its bound the cache begins anew with the chunks of this batch."""
        new = seen.difference(self.piece)
        cut = {c: LATIN.findall(c) for c in new if not c.isalpha()}
        known, self.piece[""] = self.piece, b""
        pieces = list({p for ps in cut.values() for p in ps}.union(c for c in new if c.isalpha()).difference(known))
        for i in range(0, len(pieces), 2000):
            part = pieces[i : i + 2000]
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            raw, ends = ids.tobytes(), ((np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize).tolist()
            got = [raw[x:y] for x, y in zip([0, *ends], ends, strict=False)] if len(ends) == len(part) else self._direct(part)
            known.update(zip(part, got, strict=True))
        for c, ps in cut.items():
            known[c] = b"".join([known[p] for p in ps])
        if len(self.piece) > CACHE:
            self.piece = {p: self.piece[p] for p in seen}

    def _chunks(self, texts: list[str]) -> list[bytes]:
        """Texts with other signs: chunks between spaces that are Latin fall into pieces, the others go to the library whole."""
        parts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        chunks = list({c for p in parts for c in p if c})
        plain = [c for c in chunks if not NOT_LATIN.search(c) and not any(a in c for a in self.added)]
        other = list(set(chunks).difference(plain))
        known = dict(zip(other, self._direct(other), strict=True)) | dict(zip(plain, self._pieces(plain), strict=True)) | {"": b""}
        return [b"".join([known[c] for c in p]) for p in parts]

    def _pieces(self, texts: list[str]) -> list[bytes]:
        cut = [t.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        self._learn(set().union(*cut))
        get = self.piece.__getitem__
        return [b"".join(map(get, p)) for p in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._direct(texts)
        out: list[bytes] = [b""] * len(texts)
        odd = {i for i, t in enumerate(texts) if (any(c in t for c in CONTROLS) if t.isascii() else NOT_LATIN.search(t)) or any(a in t for a in self.added)}
        for ids, f in ((sorted(odd), self._chunks), ([i for i in range(len(texts)) if i not in odd], self._pieces)):
            if ids:
                for i, x in zip(ids, f([texts[i] for i in ids]), strict=True):
                    out[i] = x
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, one a worker process: tasks that follow one another find its pieces cached."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of coordinates in [0, 2**bits)."""
    x = points.astype(np.int64).copy()
    n, dims = x.shape
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations and reflections of each level
        p = q - 1
        for i in range(dims):
            hit = (x[:, i] & q) > 0
            swap = np.where(hit, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(hit, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = top
    while q > 1:
        t ^= np.where(x[:, dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray], seed: int) -> np.ndarray:
    """Hilbert keys of token lists: hashed counts on the unit sphere, projected by a seeded Gaussian matrix."""
    to = np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))
    bucket = (np.arange(1 + max((int(x.max()) for x in ids if len(x)), default=0)) * 2654435761 >> 7) % BUCKETS
    counts = np.array([np.bincount(bucket[x], minlength=BUCKETS) for x in ids], float).reshape(-1, BUCKETS)
    v = counts @ to / np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1e-9)
    cells = np.floor((0.5 + np.arctan(v) / np.pi) * (1 << BITS)).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def tokens(docs: DataFrame, path: str, end_id: int = 1, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, wide, ids): ids as little-endian 16-bit numbers, 32-bit ones where wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for part, texts in passes(batch):
                raw = [x + end for x in enc.encode(texts)]
                keys = curve_keys([np.frombuffer(x, enc.dtype) for x in raw], seed)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(keys, pa.int64()), pa.array([enc.dtype.itemsize == 4] * len(raw), pa.bool_()), pa.array(raw, pa.binary())], ["doc_id", "key", "wide", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, key long, wide boolean, ids binary")


class Cutter:
    """Lays documents end to end and cuts sequences of `size`; the rest is cut at powers of two, so nothing is padded."""

    NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")

    def __init__(self, size: int, first: int, with_ids: bool):
        self.size, self.next, self.with_ids = size, first, with_ids
        self.open: list[tuple[int, int, np.ndarray, int]] = []
        self.filled = 0
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple[int, int, np.ndarray, int]]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, self.next, at, raw if self.with_ids else b""))
            at += len(ids)
        self.next += 1

    def add(self, doc: int, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(self.size - self.filled, len(ids) - at)
            self.open.append((doc, at, ids[at : at + n], len(ids)))
            self.filled, at = self.filled + n, at + n
            if self.filled == self.size:
                self._close(self.open)
                self.open, self.filled = [], 0

    def end(self) -> None:
        rest, left = self.open, self.filled
        while left:
            power, take, used = 1 << (left.bit_length() - 1), [], 0
            while used < power:
                doc, start, ids, total = rest[0]
                n = min(power - used, len(ids))
                take.append((doc, start, ids[:n], total))
                rest[:1] = [(doc, start + n, ids[n:], total)] if n < len(ids) else []
                used += n
            self._close(take)
            left -= power
        self.open, self.filled = [], 0

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = [pa.int64()] * 7 + [pa.binary()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
        keep = 8 if self.with_ids else 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:keep], kinds, strict=False)], list(self.NAMES[:keep]))


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, seed: int = 7, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids as little-endian 32-bit numbers.

    A sequence is `size` tokens long, or a power of two at the end of a partition. Tokens are written to the shared
    folder once, so the sampling of the range sort reads them back instead of encoding again."""
    held = Kept(docs.sparkSession).keep(tokens(docs, path, end_id, seed, id_col, text_col), "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(size, TaskContext.get().partitionId() << 32, with_ids)
        for batch in batches:
            for doc, wide, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                cut.add(doc, np.frombuffer(raw.as_buffer(), "<u4" if wide else "<u2"))
                if len(cut.rows) >= 2000:
                    yield cut.batch()
        cut.end()
        yield cut.batch()

    order = held.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").select("doc_id", "wide", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return order.mapInArrow(run, schema + ", ids binary" * with_ids)
