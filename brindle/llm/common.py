"""What the corpus operators share: Arrow batches as ragged byte arrays, row keys, shared storage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker expands into numpy arrays at once. A single longer text is still one piece.
CHUNK_BYTES = 2 << 20

#: The white space that ends a word: space and the bytes 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that further columns of any name can neither clash nor be read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits of SHA-256. Rows of equal id and text share it, and share every result too, so that joins by it are exact for repeated rows."""
    whole = F.concat(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")), F.when(F.col(text).isNull(), "-").otherwise("+"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def ragged(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more entry than rows). Null is empty."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index("text")), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, which never cross texts, and the number of words before each text."""
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = at[(at > 0) & (at < len(raw))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers outlive a stage, and allocators keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_texts(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str, limit: int = CHUNK_BYTES, after: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow with batches of bounded text. `after` runs at the end of a partition, before memory is given back."""

    def run(batches):
        batch = out = None
        try:
            for batch in chunks(batches, limit):
                out = each(batch)
                yield from [out] if isinstance(out, pa.RecordBatch) else out.to_batches()
        finally:
            del batch, out
            if after is not None:
                after()
            give_back()

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir or, where that is unset, under the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/brindle_shared"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: it cuts lineage and survives lost executors."""
    folder = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    out.brindle_folder = folder
    return out


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files of frames that are gone. Spark's listeners hold the last query, and so its
    shuffle files, until another one has ended."""
    gc.collect()
    spark.sql("select 1").collect()
    spark._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Delete tables that `written` returned, once nothing that is still to run reads them, and let Spark's cleaner find the
    shuffle files that nothing refers to any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.brindle_folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if tables:
        sweep(spark)


def hot_join(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with facts, a written table of which each key has one row. `count` is a column of facts: how many of
    about `total` rows have the key, at least. Keys of more than one row in 256 are at most 255: they are collected, and a
    broadcast keeps their rows where they are. Joins without such keys are plain; Spark splits skewed partitions."""
    hot = F.col(count) * 256 > total
    few = facts.where(hot).collect()
    if not few:
        return rows.join(facts, key, how)
    few = rows.sparkSession.createDataFrame(few, facts.schema)
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(facts.where(~hot), key, how)
    return rows.join(F.broadcast(few), key).unionByName(others)


def with_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows joined with facts, of which each key has one row; hot keys as in hot_join."""
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = rows.count()
    hot = facts.join(F.broadcast(counted.where(F.col("n") * 256 > total).select(key)), key, "left_semi")
    hot = written(hot, "hot")
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts, key)
    return rows.join(F.broadcast(hot), key).unionByName(others)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]], of which some may be empty."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[at[1:]] - total[at[:-1]]
