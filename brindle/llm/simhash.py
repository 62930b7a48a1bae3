"""SimHash near-duplicate groups.

Fingerprints are embedded by the number of set bits in each two-bit segment. Manhattan distance there is never above
Hamming distance. If two fingerprints differ in at most 3 bits, one of their halves differs in at most 1, so its 16
counts are in one grid cell or in neighbouring ones (one count differs by one). Each half is range-joined over that
grid; the Manhattan distance of both halves and then the exact Hamming distance confirm. Of two neighbouring cells one
has an even total, so only even ones look into the neighbours.

Exact copies are one fingerprint before anything is joined. Fingerprints of one cell whose half is the very same
pattern are not paired with each other but by pieces of the other half (of three differing bits among four pieces at
least one piece is free of them).

Edge cases: null and empty texts have fingerprint zero; null ids take part, and a component of null ids only has a null
id; repeated rows are kept; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, hot_join, ids_and_texts, map_texts, row_key, written

LINK_BITS = 3


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is in over half of the shingles' XXH64."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    grams = map(b" ".join, zip(*(found[i:] for i in range(shingle)), strict=False)) if len(found) >= shingle else [b" ".join(found)]
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(total * 2 > len(h)).tolist()))


def fingerprints(docs: DataFrame, more: str = "") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) for each row, and what further column `more` declares of docs."""
    name = more.split(" ")[0]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
        kept = [batch.column(2)] if more else []
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *kept], names=["doc_id", "fp", *([name] if more else [])])

    rows = docs.select("doc_id", "text", name) if more else ids_and_texts(docs)
    return map_texts(rows, each, "doc_id long, fp long" + (f", {more}" if more else ""))


def counts(x: Column) -> Column:
    """The counts of set bits of all two-bit segments, each in two bits of one long: the embedding's coordinates."""
    odd = F.lit(0x5555555555555555)
    other = F.shiftrightunsigned(x, 1)
    return x.bitwiseXOR(other).bitwiseAND(odd).bitwiseOR(F.shiftleft(x.bitwiseAND(other).bitwiseAND(odd), 1))


def manhattan(a: Column, b: Column) -> Column:
    """Sum of absolute differences of two embeddings: of x, y in 0..2, |x - y| from the bits of both."""
    odd = F.lit(0x5555555555555555)
    high_a, high_b = F.shiftrightunsigned(a, 1).bitwiseAND(odd), F.shiftrightunsigned(b, 1).bitwiseAND(odd)
    low_a, low_b = a.bitwiseAND(odd), b.bitwiseAND(odd)
    # 1 apart where exactly one of the two is 1; 2 apart where one is 2 and the other 0
    one = low_a.bitwiseXOR(low_b)
    two = high_a.bitwiseXOR(high_b).bitwiseAND(F.bitwise_not(one))
    return F.bit_count(one) + 2 * F.bit_count(two)


def links(fps: DataFrame) -> DataFrame:
    """a, b of distinct fingerprints (column fp, each once) that differ in at most three bits, found once or more."""
    halves = []
    for k in (0, 1):
        half = F.shiftrightunsigned("fp", 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))
        rest = F.shiftrightunsigned("fp", 32 * (1 - k)).bitwiseAND(F.lit(0xFFFFFFFF))
        halves.append(fps.select("fp", F.lit(k).alias("k"), half.alias("half"), rest.alias("rest"), counts(half).alias("cell")))
    rows = reduce(DataFrame.unionByName, halves)
    pieces = F.posexplode(F.array(*(F.shiftrightunsigned("rest", 8 * i).bitwiseAND(F.lit(0xFF)) for i in range(4))))
    rows = rows.select("fp", "k", "half", "cell", pieces.alias("piece", "value"))
    even = F.bit_count("half") % 2 == 0
    step = [F.shiftleft(F.lit(1).cast("long"), 2 * i) for i in range(16)]
    at = [F.shiftrightunsigned("cell", 2 * i).bitwiseAND(F.lit(3)) for i in range(16)]
    up = [F.when(a < 2, F.col("cell") + s) for a, s in zip(at, step, strict=True)]
    down = [F.when(a > 0, F.col("cell") - s) for a, s in zip(at, step, strict=True)]
    near = F.when(even, F.array_compact(F.array(F.col("cell"), *up, *down))).otherwise(F.array(F.col("cell")))
    left = rows.select(F.col("fp").alias("a"), F.col("cell").alias("own"), "k", "piece", "value", F.explode(near).alias("cell"))
    right = rows.select(F.col("fp").alias("b"), "k", "piece", "value", "cell")
    close = manhattan(counts(F.col("a")), counts(F.col("b"))) <= LINK_BITS
    exact = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK_BITS
    once = (F.col("own") != F.col("cell")) | (F.col("a") < F.col("b"))
    return left.join(right, ["k", "piece", "value", "cell"]).where(once & close & exact).select("a", "b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root, the least reachable node, of all nodes of edges (a, b): each round ties every node's larger
    neighbours, then its smaller ones, to its least neighbour, until every edge is a star's. Each round is a written table."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = written(both.where("a > b").distinct(), "edges")
    least = F.least("a", "m")
    for _ in range(rounds):
        twice = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = twice.groupBy("a").agg(F.min("b").alias("m"))
        large = twice.join(m, "a").where("b > a").select(F.col("b").alias("a"), least.alias("b")).distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = written(small.where("a > b").distinct(), "edges")
        same = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out.brindle_folder = now.brindle_folder
    return out


def marked(found: DataFrame) -> DataFrame:
    """The columns of found (a written table with doc_id and fp), root, the least fingerprint of the group, and component_id."""
    groups = written(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "groups")
    linked = written(links(groups.select("fp")), "links")
    comp = components(linked)
    tied = groups.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    ids = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    final = written(tied.join(ids, "root").select("fp", "n", "root", "component_id"), "tied")
    forget(groups, linked, comp)
    return hot_join(found, final, "fp", "n", found.count())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable, for each row."""
    out = marked(written(fingerprints(docs), "fingerprints"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which one of each near-duplicate group stays: the one with the least doc_id, of
    equal ids the one of the lesser row key; two groups may have one id. Rows without an id: of those one of each text stays."""
    rows = ids_and_texts(docs).withColumn("key", row_key())
    found = written(fingerprints(rows, "key binary"), "fingerprints")
    keep = marked(found).where("doc_id = component_id").groupBy("root").agg(F.min("key").alias("_row_key")).select("_row_key")
    keep = written(keep, "kept")
    nameless = docs.where("doc_id is null").dropDuplicates(["text"])
    # columns of docs of any name are out of the way in a struct
    whole = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("_row_key"))
    return whole.join(keep, "_row_key", "left_semi").dropDuplicates(["_row_key"]).select("row.*").unionByName(nameless)
