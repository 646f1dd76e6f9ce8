"""What the operators share: tables in the shared folder, row keys, and numpy hashes of byte strings."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset (tests), a new folder is made and set. A cluster must set it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that deletes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of the writing job go when it ends, as nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drawn(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """At most `size` rows, those of the least hashes of `keys` among about twice as many that a hash picks first: so a
    task sorts few rows however many it reads, and few rows meet where the last ones are chosen."""
    thin = max(1, df.count() // (2 * size))
    return df.where(F.pmod(F.xxhash64(*keys, F.lit(77)), F.lit(thin)) == 0).orderBy(F.xxhash64(*keys), *keys).limit(size)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many marks as no column of `df` has (case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame, id_col: str, text_col: str, key: str = "_row") -> DataFrame:
    """`df` with a unique long `key` whose order is that of `id_col`.

    Unique ids are the key themselves. Where ids repeat or are null, rows are numbered in the order of
    (id, null first; text) and stored, so that the numbers stay the same however often they are read.
    """
    ids = df.select(F.col(id_col).cast("long").alias("i"))
    repeated = ids.groupBy("i").count().where("count > 1 or i is null").limit(1).count()
    if not repeated:
        return df.withColumn(key, F.col(id_col).cast("long"))
    order = [F.col(id_col).asc_nulls_first(), F.sha1(F.coalesce(F.col(text_col), F.lit("")))]
    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn(key, F.monotonically_increasing_id()), "keyed")


# ---- hashes of substrings -------------------------------------------------------------------------------------------
def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """64-bit hashes of any substring of a byte array: a polynomial over random byte values, then mixed."""

    def __init__(self, seed: int, block: int = 1 << 18):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self._base, self._back = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self._grow(block)

    def _grow(self, n: int) -> None:
        self.n = n
        one = np.ones(1, np.uint64)
        self.up = np.cumprod(np.concatenate([one, np.full(n, self._base)]))
        self.down = np.cumprod(np.concatenate([one, np.full(n, self._back)]))

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        if len(data) > self.n:
            self._grow(max(len(data), 2 * self.n))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]; strings of different length differ by their length as well."""
        return _mixed((prefixes[end] - prefixes[start]) * self.down[start] + (end - start).astype(np.uint64))

    def rolling(self, prefixes: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all substrings of `width` bytes."""
        n = len(prefixes) - width
        return _mixed((prefixes[width:] - prefixes[:-width]) * self.down[:n] + np.uint64(width))


def portions(batch: pa.RecordBatch, column: int, limit: int = 1 << 23):
    """Slices of a batch whose `column` holds about `limit` bytes each, so that a task's memory stays bounded."""
    size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def sub_batches(texts: list[bytes], limit: int = 1 << 20):
    """(first, end) index ranges of `texts` that hold about `limit` bytes each; a longer text is alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indices of the ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
