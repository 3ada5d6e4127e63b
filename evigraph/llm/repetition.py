"""Op 3, quality rules: how much of a text lies in repeated n-grams and lines, by rolling hashes in numpy.

A batch of texts is one array of bytes. Cumulative sums of seeded byte values times powers of an odd number modulo
2**64 give the hash of any word, line or window of words as one difference; equal windows of a text are found by one
sort of (text, hash) keys for each length.

Defined results: a null text has no words and fails the base rule. Repeated rows are judged each. Other columns are
ignored. Work and memory follow the bytes of a text, so very long texts only take longer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, passes

#: Largest share of a text's word characters inside repeated n-grams, by n, and inside repeated lines.
NGRAM_SHARE = {5: 0.25, 8: 0.22, 10: 0.20}
LINE_SHARE = 0.20
BASE_WINDOW = 8
WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
LEAD = (np.arange(256) & 0xC0) != 0x80
ODD = 0x5851F42D4C957F2D


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.bytes = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (np.uint64(ODD), np.uint64(pow(ODD, -1, 2**64))))


def sums(values: np.ndarray, p: Powers) -> np.ndarray:
    p.reach(len(values) + 1)
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * p.up[: len(values)], dtype=np.uint64)])


def spans(total: np.ndarray, a: np.ndarray, b: np.ndarray, p: Powers) -> np.ndarray:
    """Hash of values[a:b], the same wherever the values stand."""
    with np.errstate(over="ignore"):
        return mixed((total[b] - total[a]) * p.down[a] + (b - a).astype(np.uint64))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more, is not the first) of each key."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same
    return twice, later


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of that width that begins at one of the starts."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: list[str], p: Powers) -> dict[str, np.ndarray]:
    raw = [t.encode() + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw])
    begins = ends - [len(x) for x in raw]
    per_doc = lambda flags: np.add.reduceat(flags.astype(np.int64), begins)
    white = WHITE[data]
    total = sums(p.bytes[data], p)
    leads = np.concatenate([[0], np.cumsum(LEAD[data] & ~white)])

    edge = np.diff(np.concatenate([[1], white, [1]]).astype(np.int8))
    a, b = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = len(texts)
    doc = np.searchsorted(ends, a, side="right")
    chars = leads[b] - leads[a]
    count = lambda of, weights=None: np.bincount(of, weights, n).astype(np.int64)
    out = {"n_words": count(doc), "word_chars": count(doc, chars), "n_symbols": per_doc(SYMBOL[data])}

    stop = np.flatnonzero(data == 10)
    line_a = np.concatenate([[0], stop[:-1] + 1])
    text_of = np.searchsorted(ends, line_a, side="right")
    full = leads[stop] > leads[line_a]
    line_a, stop, text_of = line_a[full], stop[full], text_of[full]
    with np.errstate(over="ignore"):
        _, later = repeated(mixed(spans(total, line_a, stop, p) + text_of.astype(np.uint64) * np.uint64(ODD)))
    out["n_dup_lines"] = count(text_of[later])
    out["line_chars"] = count(text_of[later], (leads[stop] - leads[line_a])[later])

    words = spans(total, a, b, p)
    run = sums(words, p)
    for k in sorted({BASE_WINDOW, *NGRAM_SHARE}):
        inside = np.zeros(len(a), bool)
        if len(a) >= k:
            at = np.flatnonzero(doc[: len(a) - k + 1] == doc[k - 1 :])
            with np.errstate(over="ignore"):
                twice, _ = repeated(mixed(spans(run, at, at + k, p) + doc[at].astype(np.uint64) * np.uint64(ODD)))
            inside = covered(at[twice], k, len(a))
        out[f"chars_{k}"] = count(doc[inside], chars[inside])
        if k == BASE_WINDOW:
            out["n_repeat_words"] = count(doc[inside])
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the shares that decide."""
    shares = [*(f"share_{k}" for k in NGRAM_SHARE), "share_lines"]
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Powers()
        for batch in batches:
            for part, texts in passes(batch):
                m = measure(texts, p)
                failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
                base = np.maximum(m["word_chars"], 1)
                got = [*(m[f"chars_{k}"] / base for k in NGRAM_SHARE), m["line_chars"] / base]
                most = [*NGRAM_SHARE.values(), LINE_SHARE]
                kept = ~failed & np.all([x <= y for x, y in zip(got, most, strict=True)], axis=0)
                cols = [part.column(0), *(pa.array(m[k], pa.int64()) for k in longs), pa.array(failed), pa.array(kept), *(pa.array(x, pa.float64()) for x in got)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *longs, "base_failed", "kept", *shares])

    schema = "doc_id long, " + "".join(f"{k} long, " for k in longs) + "base_failed boolean, kept boolean, " + ", ".join(f"{k} double" for k in shares)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
