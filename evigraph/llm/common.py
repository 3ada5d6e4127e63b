"""Shared by the operators of this folder: scratch tables, Arrow batches, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"\w+")
#: Characters that one numpy pass works on; longer texts are taken alone.
PASS_CHARS = 1_000_000
#: Entries of a worker's word cache; beyond it the cache starts anew, results stay the same.
CACHE_WORDS = 600_000
MIX = np.uint64(0x9E3779B97F4A7C15)
_ROOT: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, a temporary one only where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        app = spark.sparkContext.applicationId
        shared = _ROOT.setdefault(app, "file://" + tempfile.mkdtemp(prefix="evigraph-"))
    return shared.rstrip("/")


class Kept:
    """Intermediate tables of one operator call, written to the shared folder.

    Written tables survive the loss of executors, which cached blocks and shuffle files do not."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{scratch(spark)}/evigraph-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        df.write.option("compression", compression).parquet(f"{self.at}/{name}")
        self.spark._jvm.System.gc()  # the driver forgets the finished plan, so executors free its shuffle files
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        """Frees tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(conf).delete(path, True)


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings, null as the empty one."""
    return [x or "" for x in column.to_pylist()]


def passes(batch: pa.RecordBatch, text: str = "text", most: int = PASS_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about `most` characters each, at least one row."""
    texts, at, n = strings(batch.column(text)), 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield batch.slice(at, i + 1 - at), texts[at : i + 1]
            at, n = i + 1, 0
    if at < len(texts):
        yield batch.slice(at), texts[at:]


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


class WordHash(dict):
    """word → 64-bit hash, cached."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORD.findall(text.lower())


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows in order; a text of fewer words is one window, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < k:
        k = n
    with np.errstate(over="ignore"):
        s = hashes[: n - k + 1] + np.uint64(k)
        for i in range(1, k):
            s = mixed(s * MIX + hashes[i : n - k + 1 + i])
    return mixed(s)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
