"""Media columns as content-defined chunks.

A payload is wrapped as an 8-bit mono WAV file. Gear-hash cuts divide the file; chunks of equal SHA-256 are stored once,
in packs of some megabytes that are compressed whole; the ordered chunk list of a file rebuilds it from its pack and
from chunks of other packs, fetched by a join, and length and digest are verified before features are computed.

Edge cases: a null text is empty and becomes one block of spaces; repeated rows share all chunks; null ids are kept;
further columns are ignored; an empty table gives an empty table. A file that fails verification raises. The tables of the
warehouse are dropped at the end, after an error too.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, forget, ids_and_texts, with_facts, written

BLOCK, LEAST, MOST, REACH = 192, 256, 8192, 16
#: A cut where these nine of the rolling hash's sixteen bits are zero: 512 bytes apart on average, beyond the least.
CUT = np.uint16(0xFF80)
RATE = 8000
#: Compression of a pack.
LEVEL = 6


def gear() -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=2).digest(), "big") for b in range(256)], np.uint16)


GEAR = gear()


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (BLOCK if not raw else -len(raw) % BLOCK)


def wav(samples: bytes) -> bytes:
    odd = len(samples) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * odd


def samples_of(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not a WAV file of this library")
    (n,) = struct.unpack_from("<I", media, 40)
    return media[44 : 44 + n]


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: the rolling hash of the last 16 bytes decides, between LEAST and MOST bytes a chunk."""
    g = GEAR[np.frombuffer(data, np.uint8)]
    h = g.copy()
    for k in range(1, REACH):
        h[k:] += g[:-k] << np.uint16(k)
    ends, start = [], 0
    for at in (np.flatnonzero((h & CUT) == 0) + 1).tolist():
        while at - start > MOST:
            start += MOST
            ends.append(start)
        if at - start >= LEAST:
            ends.append(at)
            start = at
    while len(data) - start > MOST:
        start += MOST
        ends.append(start)
    return ends + [len(data)] if start < len(data) else ends


def feature(samples: bytes) -> str:
    """Mean, mean square and mean step of the samples, and how often each sixteenth of their range occurs."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    bins = np.bincount(x >> 4, minlength=16)
    return f"mean={x.sum() / len(x):.4f};square={(x * x).sum() / len(x):.3f};step={np.abs(np.diff(x)).sum() / len(x):.4f};bins={'.'.join(map(str, bins.tolist()))}"


def packed(text_batch: list[str | None], ids: list, lane: int, pack: int) -> dict:
    """One pack: every distinct chunk of some texts once, the files as places in that directory, and the rows' files."""
    place: dict[bytes, int] = {}
    parts, files, owners = [], {}, []
    for doc_id, text in zip(ids, text_batch, strict=True):
        data = wav(payload(text))
        digest = hashlib.sha256(data).digest()
        owners.append({"doc_id": doc_id, "n_bytes": len((text or "").encode()), "sha": digest})
        if digest in files:
            continue
        ends, order = cuts(data), []
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            part = data[a:b]
            name = hashlib.sha256(part).digest()
            if name not in place:
                place[name] = len(place)
                parts.append(part)
            order.append(place[name])
        files[digest] = {"sha": digest, "size": len(data), "list": order}
    return {"lane": lane, "pack": pack, "held": list(place), "lens": list(map(len, parts)), "blob": squeezed(parts), "files": list(files.values()), "owners": owners}


def squeezed(parts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(parts))


def unpacked(blob: bytes, held: list[bytes], lens: list[int], gone: set[bytes]) -> dict[bytes, bytes]:
    """The chunks of a pack by digest, but those that another pack holds."""
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, {}
    for name, n in zip(held, lens, strict=True):
        if name not in gone:
            out[name] = data[at : at + n]
            at += n
    return out


FILES = pa.list_(pa.struct([("sha", pa.binary()), ("size", pa.int64()), ("list", pa.list_(pa.int32()))]))
NAMES = pa.list_(pa.binary())
PACK = pa.schema([("lane", pa.int64()), ("pack", pa.int64()), ("held", NAMES), ("lens", pa.list_(pa.int32())), ("blob", pa.binary()), ("files", FILES)])
OWNERS = ("owners", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary())])))
PACK_DDL = "lane long, pack long, held array<binary>, lens array<int>, blob binary, files array<struct<sha:binary,size:long,list:array<int>>>"
FACTS = pa.schema([("sha", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("feature", pa.string())])
FACTS_DDL = "sha binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"


def lanes(spark: SparkSession) -> list[int]:
    """A bucket key for each bucket, as many as shuffle partitions: a task that writes under one key writes one file."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.range(n * (10 + n.bit_length())).groupBy(F.pmod(F.hash("id"), F.lit(n))).agg(F.min("id").alias("key")).collect()
    return sorted(r["key"] for r in found)


@contextmanager
def bucketed(spark: SparkSession):
    """Lets joins by (lane, pack) use the tables' bucketing by lane, so that packs are not shuffled, and hands few packs at
    a time to a Python worker."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "4"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def new_name() -> str:
    return f"media_{uuid.uuid4().hex}"


def table(df: DataFrame, buckets: int, name: str) -> DataFrame:
    """The rows as a table of the warehouse, bucketed by lane."""
    df.write.bucketBy(buckets, "lane").saveAsTable(name)
    return df.sparkSession.table(name)


def rows_of(batches: Iterable[pa.RecordBatch], each: Callable[[dict], list[dict]], schema: pa.Schema):
    """Results of one row at a time: a row holds a pack of bounded size."""
    for batch in batches:
        for k in range(batch.num_rows):
            if out := each(batch.slice(k, 1).to_pylist()[0]):
                yield pa.RecordBatch.from_pylist(out, schema)


def chunk_store(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """The store (each chunk in one pack, each file listed in one), shared chunks' homes, each row's file, and the store's table.

    Tasks pack their own texts; joins of digests alone then find the chunks and files that several packs hold; the one
    with the least number keeps each, and the packs are rewritten without the others'. Bytes are not shuffled."""
    spark = docs.sparkSession
    keys = lanes(spark)

    def pack(batches):
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(chunks(batches)):
            yield pa.RecordBatch.from_pylist([packed(batch.column(1).to_pylist(), batch.column(0).to_pylist(), keys[task % len(keys)], task << 32 | k)], PACK.append(pa.field(*OWNERS)))

    name = new_name()
    try:
        return deduplicated(table(ids_and_texts(docs).mapInArrow(pack, PACK_DDL + ", owners array<struct<doc_id:long,n_bytes:long,sha:binary>>"), len(keys), name), len(keys))
    finally:
        spark.sql(f"drop table if exists {name}")


def deduplicated(raw: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """The same from the packs as tasks made them."""
    spark = raw.sparkSession
    owners = written(raw.select(F.explode("owners").alias("x")).select("x.*"), "owners")

    def shared(items: DataFrame) -> DataFrame:
        return items.groupBy("digest").agg(F.min(F.struct("pack", "lane")).alias("home"), F.count("*").alias("n")).where("n > 1").select("digest", "home")

    def elsewhere(items: DataFrame, homes: DataFrame, out: str) -> DataFrame:
        return items.join(homes, "digest").where(F.col("pack") != F.col("home.pack")).groupBy("lane", "pack").agg(F.collect_list("digest").alias(out))

    held = raw.select("lane", "pack", F.explode("held").alias("digest"))
    listed = raw.select("lane", "pack", F.explode("files.sha").alias("digest"))
    homes = written(shared(held), "homes")
    away = written(elsewhere(held, homes, "gone"), "gone")
    copies = written(elsewhere(listed, shared(listed), "copies"), "copies")

    def rewrite(r: dict) -> list[dict]:
        gone, copied = set(r["gone"] or ()), set(r["copies"] or ())
        parts = unpacked(r["blob"], r["held"], r["lens"], set())
        r["files"] = [f for f in r["files"] if f["sha"] not in copied]
        used = {r["held"][k] for f in r["files"] for k in f["list"]}
        return [r | {"blob": squeezed([x for n, x in parts.items() if n not in gone]), "gone": list(gone), "need": [n for n in gone if n in used]}]

    schema = PACK.append(pa.field("gone", NAMES)).append(pa.field("need", NAMES))
    with bucketed(spark):
        decided = raw.drop("owners").join(away, ["lane", "pack"], "left").join(copies, ["lane", "pack"], "left")
        kept = new_name()
        try:
            store = table(decided.mapInArrow(lambda batches: rows_of(batches, rewrite, schema), PACK_DDL + ", gone array<binary>, need array<binary>"), buckets, kept)
        except BaseException:
            spark.sql(f"drop table if exists {kept}")
            raise
    forget(away, copies)
    return store, homes, owners, kept


def rebuilt(store: DataFrame, homes: DataFrame) -> DataFrame:
    """Facts of each stored file, whose chunks come from its pack and, by joins, from the packs that hold the others."""
    asked = written(store.select("lane", "pack", F.explode("need").alias("digest")).join(homes, "digest"), "asked")
    lent = asked.select(F.col("home.lane").alias("lane"), F.col("home.pack").alias("pack"), "digest").distinct().groupBy("lane", "pack").agg(F.collect_list("digest").alias("lent"))

    def lend(r: dict) -> list[dict]:
        parts = unpacked(r["blob"], r["held"], r["lens"], set(r["gone"]))
        return [{"digest": n, "part": parts[n]} for n in r["lent"]]

    def read(r: dict) -> list[dict]:
        parts = unpacked(r["blob"], r["held"], r["lens"], set(r["gone"])) | {x["digest"]: x["part"] for x in r["fetched"] or ()}
        out = []
        for f in r["files"]:
            data = b"".join(parts[r["held"][k]] for k in f["list"])
            if len(data) != f["size"] or hashlib.sha256(data).digest() != f["sha"]:
                raise ValueError("a stored file does not match its digest")
            got = samples_of(data)
            out.append({"sha": f["sha"], "payload_bytes": len(got), "payload_sha256": hashlib.sha256(got).hexdigest(), "tail_crc32": zlib.crc32(got[-16:]), "media_bytes": len(data), "feature": feature(got)})
        return out

    spark = store.sparkSession
    columns = ["lane", "pack", "held", "lens", "blob", "gone"]
    with bucketed(spark):
        parts = store.select(columns).join(lent, ["lane", "pack"]).mapInArrow(lambda b: rows_of(b, lend, pa.schema([("digest", pa.binary()), ("part", pa.binary())])), "digest binary, part binary")
        # a shared chunk is asked for once by each pack at most
        fetched = asked.select("lane", "pack", "digest").join(parts, "digest").groupBy("lane", "pack").agg(F.collect_list(F.struct("digest", "part")).alias("fetched"))
        facts = written(store.select(*columns, "files").join(fetched, ["lane", "pack"], "left").mapInArrow(lambda b: rows_of(b, read, FACTS), FACTS_DDL), "facts")
    forget(asked)
    return facts


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, sizes and digests of payload and stored file, and features, of the file rebuilt from the chunk store."""
    store, homes, owners, name = chunk_store(docs)
    try:
        facts = rebuilt(store, homes)
    finally:
        docs.sparkSession.sql(f"drop table if exists {name}")
    forget(homes)
    return with_facts(owners, facts, "sha").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("sha")).alias("media_sha256"), "feature")
