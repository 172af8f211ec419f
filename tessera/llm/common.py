"""What the corpus operators share: inputs, tables in the shared folder, words and hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.loop import shared_dir

#: A word is a run of anything but ASCII white space, in Java and in DuckDB syntax alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends here.

    The shuffle files that it took are removed as soon as the table stands.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    for made in _collecting:
        made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`written` that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_collecting: list[list[DataFrame]] = []


@contextmanager
def last_table_only() -> Iterator[None]:
    """Of the tables that are written inside, the last one stays and all before it go: it holds what was asked for."""
    made: list[DataFrame] = []
    _collecting.append(made)
    try:
        yield
    finally:
        _collecting.remove(made)
        discard(*made[:-1])


BATCH = "8m"


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes: a batch counts rows by default, and texts can be long.

    The bound is a setting of the session, made only where it is unset. When a
    task ends its free memory goes back to the system.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, BATCH)

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(trimmed, schema)


def give_back() -> None:
    """Free memory goes back to the system: a worker may idle beside others for a while."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # not glibc


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ascii_lower(data: bytes) -> bytes:
    """A-Z lower-cased and nothing else (``bytes.lower`` touches ASCII only)."""
    return data.lower()


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _S
    x *= _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


class WordHashes:
    """64-bit hashes of words with a bounded memo."""

    def __init__(self, most: int = 120_000, seed: int = 7) -> None:
        self.most, self.seed, self.memo = most, seed, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        memo, h, seed = self.memo, xxhash.xxh64_intdigest, self.seed
        found = list(map(memo.get, words))
        if None in found:
            if len(memo) > self.most:
                memo.clear()
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    found[i] = v = h(w, seed)
                    if len(w) <= 64:
                        memo[w] = v
        return np.array(found, dtype=np.uint64)


def ends_in_stop(word: bytes) -> bool:
    """An ASCII letter and then one final full stop or comma."""
    return len(word) > 2 and word[-1] in b".," and (65 <= word[-2] <= 90 or 97 <= word[-2] <= 122)
