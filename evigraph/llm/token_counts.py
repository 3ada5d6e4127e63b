"""Op 2, token counts: the pre-tokens of a byte-level tokenizer by a transducer whose chunk maps compose by prefix scan.

The split into pre-tokens is a deterministic transducer of eight states. A batch of texts is one stream of characters,
cut into chunks of equal length; for each chunk the map from every entry state to its exit state is computed for all
chunks at once, an associative scan composes the maps, and each chunk is then run from its true entry state to find
where pre-tokens close. The merges are no transducer: the tokenizers library counts the tokens of a pre-token when it is
first seen, and a dict of whole pre-tokens keeps the counts.

Defined results: a null text is empty and has no tokens. Texts that hold an added token's string, which splits a text
before all else, are given to the library as they are. Repeated rows are counted each. Other columns are ignored."""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passes

#: Classes of characters, in the light of the one or two that follow.
LETTER, NUMBER, OTHER, SPACE, LAST_SPACE, LAST_WHITE, SHORT, LONG, SEP = range(9)
#: States: nothing open; in a run of letters, numbers, others, white space; one space held; one or two letters of a contraction to come.
FRESH, IN_L, IN_N, IN_O, IN_W, HELD, ONE, TWO = range(8)
CHUNK = 256
LEXICON = 800_000


def compile_split() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a pre-token starts here) by state * 9 + class, for
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+."""
    to, start = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    for cls, run in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O)):
        to[:, cls] = run
        start[[run, HELD], cls] = False
    to[[ONE, TWO], LETTER] = FRESH, ONE
    start[[ONE, TWO], LETTER] = False
    to[:, SPACE], start[IN_W, SPACE] = IN_W, False
    to[:, LAST_SPACE], to[:, LAST_WHITE], to[:, SEP] = HELD, FRESH, FRESH
    for cls, state in ((SHORT, ONE), (LONG, TWO)):  # an apostrophe opens a contraction only where no run of others goes on
        to[:, cls] = state
        to[[IN_O, HELD], cls] = IN_O
        start[[IN_O, HELD], cls] = False
    return to.ravel(), start.ravel()


_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _CLASSES:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for i in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(i))[0]
            if kind in "LN":
                table[i] = LETTER if kind == "L" else NUMBER
        for i in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
            table[i] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def classify(points: np.ndarray, seps: np.ndarray) -> np.ndarray:
    cls = classes()[points]
    white = cls == SPACE
    ends = np.ones(len(cls) + 1, bool)  # white space or the end of a text
    ends[:-1] = white
    ends[seps] = True
    last = np.flatnonzero(white & ~ends[1:])
    cls[last] = np.where(points[last] == 32, LAST_SPACE, LAST_WHITE)
    marks = np.flatnonzero(points == 39)
    if len(marks):
        ahead = np.concatenate([points, np.zeros(2, points.dtype)])
        ahead[seps] = 0
        a, b = ahead[marks + 1], ahead[marks + 2]
        of = lambda pair: (a == ord(pair[0])) & (b == ord(pair[1]))
        cls[marks[of("re") | of("ve") | of("ll")]] = LONG
        cls[marks[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
    cls[seps] = SEP
    return cls


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (row i: first row 0, last row i), in log2(n) parallel steps."""
    maps, d = maps.copy(), 1
    while d < len(maps):
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d], 1)
        d *= 2
    return maps


def starts(cls: np.ndarray, split: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where pre-tokens (and separators) start in a stream that begins fresh."""
    to, start = split
    n = -(-len(cls) // CHUNK)
    grid = np.full(n * CHUNK, SEP, np.uint8)
    grid[: len(cls)] = cls
    grid = np.ascontiguousarray(grid.reshape(n, CHUNK).T).astype(np.intp)
    maps = np.tile(np.arange(8, dtype=np.intp), (n, 1))
    for column in grid:
        maps = to[maps * 9 + column[:, None]].astype(np.intp)
    state = np.zeros(n, np.intp)
    state[1:] = scan(maps)[:-1, FRESH]
    found = np.empty((CHUNK, n), bool)
    for i, column in enumerate(grid):
        at = state * 9 + column
        found[i] = start[at]
        state = to[at].astype(np.intp)
    return np.flatnonzero(found.T.ravel()[: len(cls)])


class Counter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.compiled = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("post_processor")
        self.added = [a["content"] for a in spec["added_tokens"]]
        self.split = compile_split()
        self.closing: dict[str, int] = {}

    def _direct(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _compile(self, stream: list[str]) -> None:
        if len(self.closing) > LEXICON:
            self.closing.clear()
        new = list(set(stream).difference(self.closing))
        self.closing.update(zip(new, self._direct(new), strict=True))

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        odd = [i for i, t in enumerate(texts) if not self.compiled or any(a in t for a in self.added)]
        if odd:
            out[odd] = self._direct([texts[i] for i in odd])
        rest = sorted(set(range(len(texts))).difference(odd))
        if not rest:
            return out
        stream = "\0".join([texts[i] for i in rest]) + "\0"
        points = np.frombuffer(stream.encode("utf-32-le"), np.uint32)
        seps = np.cumsum([len(texts[i]) + 1 for i in rest]) - 1
        at = starts(classify(points, seps), self.split)
        doc = np.searchsorted(seps, at)
        real = at != seps[doc]
        bounds = [*at.tolist(), len(stream)]
        closed = [stream[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        self._compile(closed)
        n = np.fromiter(map(self.closing.__getitem__, closed), np.int64, len(closed))
        out[rest] = np.bincount(doc[real], n[real], len(rest)).astype(np.int64)
        return out


_COUNTERS: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """The counter of a tokenizer file, one a worker process: tasks that follow one another find its lexicon filled."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            for part, texts in passes(batch):
                n = counter.count(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0)).alias("n_bytes"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
