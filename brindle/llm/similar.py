"""Near-duplicates by SimHash and the similarity of five-word shingles: every pair of Jaccard similarity 0.8 or more is linked.

Rows of equal shingle sets are one set. Sets are told by SimHash first: fingerprints of their shingles are embedded and
joined as in simhash.py, and those of at most three differing bits are compared by their shingles. Bits cannot promise a
similarity, so what they leave is found by shingles, exactly: two sets of n and m shingles that are similar enough share
one of the first n - ceil(0.8 n) + 1 and first m - ceil(0.8 m) + 1 shingles of one common order. The order is by hash,
those met in many texts of a sample last; it decides how many pairs are looked at, not which are found. Of the sets that
share such a shingle each is compared with a drawn one, turn by turn, which ties nearly all of a large group at a cost
that grows with its size; then those pairs are compared that are not yet tied together. Only sets of near parities are
compared. A parity has PARITY bits, each set if an odd number of shingles falls on it; two of them differ in no more
bits than the sets do in shingles.

Edge cases: texts of fewer than five words are one shingle; null and empty texts are one set; of a group the row with
the least doc_id stays (rows without an id come last, of equal ids the one of lesser hash), whatever ids are null or
repeated; further columns are kept. Shingles, sets and rows are told by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, ids_and_texts, map_texts, row_key, sweep, written
from .simhash import components, links, majority

SHINGLE = 5
#: One text in SAMPLED says which shingles are common: those of at least MANY sampled texts, the MOST commonest at most.
SAMPLED, MANY, MOST = 16, 4, 50_000
#: Bits of a set's parity, a multiple of 64.
PARITY = 512
#: Sets meet drawn ones until no more than one pair in FEW is similar enough, at most TURNS times; both decide how many pairs are left to be looked at, not which are found.
TURNS, FEW = 8, 16


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's runs of five words, sorted."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.int64)
    grams = map(b" ".join, zip(*(found[i:] for i in range(SHINGLE)), strict=False)) if len(found) >= SHINGLE else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64).view(np.int64))


def hashed(rows: DataFrame, kept: str = "key binary") -> DataFrame:
    """The column that `kept` declares and the shingles of each of the rows, which have it and text."""
    name = kept.split(" ")[0]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([shingles(x) for x in batch.column("text").to_pylist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(name), sets], names=[name, "shingles"])

    return map_texts(rows.select("text", name), each, f"{kept}, shingles array<long>")


def common(rows: DataFrame) -> np.ndarray:
    some = hashed(rows.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(SAMPLED)) == 0).withColumn("key", F.unhex(F.md5("text"))))
    met = some.select("key", F.explode("shingles").alias("x")).distinct().groupBy("x").count().where(F.col("count") >= MANY)
    return np.sort(np.array([r.x for r in met.orderBy(F.desc("count"), "x").limit(MOST).collect()], np.int64))


def parity(x: np.ndarray) -> np.ndarray:
    odd = np.bincount(x & (PARITY - 1), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def leads(rows: DataFrame) -> DataFrame:
    """doc_id, key, the hash of the shingle set, its size, its SimHash, its parity and its first shingles in the common order, for each row."""
    often = common(rows)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, sizes, fps, parities, first = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            x = shingles(text)
            names.append(xxhash.xxh64_intdigest(x.tobytes()))
            sizes.append(n := len(x))
            fps.append(majority(x.view(np.uint64)))
            parities.append(parity(x))
            late = often[np.minimum(np.searchsorted(often, x), len(often) - 1)] == x if len(often) else np.zeros(n, bool)
            first.append(np.concatenate((x[~late], x[late]))[: n - (4 * n + 4) // 5 + 1])
        signed = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (names, fps)]
        columns = [batch.column(0), batch.column(2), signed[0], pa.array(sizes, pa.int64()), signed[1], pa.array(parities, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "name", "n", "fp", "parity", "first"])

    return map_texts(rows, each, "doc_id long, key binary, name long, n long, fp long, parity array<long>, first array<long>")


def enough(shared: Column, n: Column, m: Column) -> Column:
    """Jaccard of at least 0.8, in whole numbers."""
    return shared * 9 >= (n + m) * 4


def near_parity(a: Column, b: Column, n: Column, m: Column) -> Column:
    """False only for sets that differ in too many shingles to be similar enough."""
    apart = sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, PARITY // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))
    return apart * 9 <= n + m


def near_fingerprints(groups: DataFrame) -> DataFrame:
    """Pairs of sets (a, b) with SimHashes of at most three differing bits: the sets of one with its least set, the least sets of two."""
    head = written(groups.groupBy("fp").agg(F.min("name").alias("head")), "heads")
    same = groups.select("fp", "name").join(head, "fp").where("name > head").select(F.col("head").alias("a"), F.col("name").alias("b"))
    one, two = (head.select(F.col("fp").alias(s), F.col("head").alias(f"head_{s}")) for s in "ab")
    linked = links(head.select("fp")).distinct().join(one, "a").join(two, "b").select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
    out = written(same.unionByName(linked), "near")
    forget(head)
    return out


def plausible(pairs: DataFrame) -> DataFrame:
    """Those of the pairs of sets (a, b, of sizes n_a, n_b; once for each first shingle that both have) that can be similar
    enough: what two sets share beyond the first shingles of one of them is at most the rest of that one."""
    rest = F.greatest(*(F.floor((F.col(n) * 4 + 4) / 5) - 1 for n in ("n_a", "n_b")))
    counted = pairs.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    return counted.where(enough(F.col("shared") + rest, F.col("n_a"), F.col("n_b"))).select("a", "b")


def shingled(pairs: DataFrame, groups: DataFrame, rows: DataFrame) -> DataFrame:
    """name and shingles of the sets that the pairs (a, b) name. Rows that repeat an id and text are one before they meet
    the names, and the shingles stay where their text was: texts are dealt once, shingles not at all."""
    names = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "name")
    keys = groups.join(names, "name").select("name", F.col("least.key").alias("key"))
    return written(hashed(rows.select("text", "key").dropDuplicates(["key"]).join(keys, "key"), "name long"), "sets")


def verified(pairs: DataFrame, groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of the pairs of sets (a, b) that are similar enough, by their shingles. A pair carries the shingles of one set
    to the other, so the pairs are taken in parts of about as many pairs as there are sets: the disk that a part needs grows
    with the sets, however many pairs there are. What a step has shuffled goes before the next one."""
    pairs = written(pairs, "pairs")
    sets = shingled(pairs, groups, rows)
    sweep(pairs.sparkSession)
    parts = max(1, -(-pairs.count() // max(1, sets.count())))
    found = []
    for part in range(parts):
        some = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == part)
        both = some.join(sets.select(F.col("name").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("name").alias("b"), F.col("shingles").alias("y")), "b")
        found.append(written(both.where(enough(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b"), "similar"))
        del some, both
        sweep(pairs.sparkSession)
    if parts == 1:
        out, found = found[0], []
    else:
        out = written(reduce(DataFrame.unionByName, found), "similar")
    forget(pairs, sets, *found)
    return out


def fit() -> Column:
    """No more can be shared than what stands before a shared shingle and after it in both."""
    most = F.expr("least(at_a, at_b) + 1 + least(n_a - at_a - 1, n_b - at_b - 1)")
    return enough(most, F.col("n_a"), F.col("n_b"))


def drawn(tied: DataFrame, turn: int) -> DataFrame:
    """Pairs of sets (a, b): of the sets with a common first shingle, each with one that is drawn by a hash, anew for each
    shingle and turn, if it has another root. So a set meets as many of a group as it has first shingles, however large the
    group is. tied: x, name, n, at, root."""
    draw = F.xxhash64("name", "x", F.lit(turn)).alias("draw")
    head = tied.groupBy("x").agg(F.min(F.struct(draw, "name", "n", "at", "root")).alias("head"))
    met = tied.join(head, "x").where("root != head.root").select("name", F.col("head.name").alias("other"), F.col("n").alias("n_a"), F.col("head.n").alias("n_b"), F.col("at").alias("at_a"), F.col("head.at").alias("at_b"))
    return met.where(fit()).select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b"))


def hopeful(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The distinct pairs of sets (a, b) whose parities are near."""
    a, b = (groups.select(F.col("name").alias(s), F.col("n").alias(f"n_{s}"), F.col("parity").alias(f"parity_{s}")) for s in "ab")
    both = pairs.distinct().join(a, "a").join(b, "b")
    return both.where(near_parity(F.col("parity_a"), F.col("parity_b"), F.col("n_a"), F.col("n_b"))).select("a", "b")


def opened(tied: DataFrame) -> DataFrame:
    """The rows of tied whose shingle has sets of two roots or more."""
    return tied.join(tied.groupBy("x").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("x"), "x", "left_semi")


def untied(tied: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of sets (a, b, n_a, n_b) of different roots with a common first shingle, once for each, that can be similar
    enough by its places and their parities. The sets of a shingle's commonest root are met by the others only, not by each
    other. tied: x, name, n, at, root."""
    counted = tied.groupBy("x", "root").agg(F.count("*").alias("many")).groupBy("x").agg(F.max(F.struct("many", "root")).alias("main"), F.count("*").alias("roots"))
    open = tied.join(counted.where("roots > 1").select("x", F.col("main.root").alias("main")), "x")
    open = written(open.join(groups.select("name", "parity"), "name"), "open")
    a, b = (open.select("x", *(F.col(c).alias(f"{c}_{s}") for c in ("name", "n", "at", "root", "parity", "main"))) for s in "ab")
    apart = (F.col("root_a") != F.col("root_b")) & ((F.col("root_b") == F.col("main_b")) | (F.col("name_a") < F.col("name_b"))) & fit()
    near = near_parity(F.col("parity_a"), F.col("parity_b"), F.col("n_a"), F.col("n_b"))
    found = a.where("root_a != main_a").join(b, "x").where(apart & near)
    turned = F.col("name_a") > F.col("name_b")
    ends = (F.when(turned, F.col(f"{c}_{t}")).otherwise(F.col(f"{c}_{s}")).alias(to) for c, s, t, to in (("name", "a", "b", "a"), ("name", "b", "a", "b"), ("n", "a", "b", "n_a"), ("n", "b", "a", "n_b")))
    out = written(found.select(*ends), "untied")
    forget(open)
    return out


def tie(pairs: DataFrame, comp: DataFrame | None, groups: DataFrame, rows: DataFrame) -> tuple[DataFrame, int]:
    """node and root after those of the pairs (a, b) that are similar enough are tied too, and how many are."""
    found = verified(pairs, groups, rows)
    known = found if comp is None else found.unionByName(comp.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = components(known)
    out, many = written(whole, "roots"), found.count()
    forget(found, whole, *([] if comp is None else [comp]))
    return out, many


def rooted(tied: DataFrame, comp: DataFrame) -> DataFrame:
    """tied with the roots of comp, without the shingles whose sets all have one root."""
    now = written(tied.drop("root").join(comp, F.col("name") == F.col("node"), "left").select("x", "name", "n", "at", F.coalesce("root", "name").alias("root")), "tied")
    out = written(opened(now), "open")
    forget(now, tied)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which one of each group tied by similarity stays: the least."""
    rows = ids_and_texts(docs).withColumn("key", row_key())
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")
    found = written(leads(rows), "leads")
    groups = written(found.groupBy("name").agg(F.min(order).alias("least"), *(F.first(c).alias(c) for c in ("n", "fp", "parity", "first"))), "groups")
    # what a step leaves goes before the next one; shuffle files go only when no frame of the step is left
    forget(found)
    near = near_fingerprints(groups)
    sweep(docs.sparkSession)
    entries = groups.select("name", "n", F.posexplode("first").alias("at", "x"))
    held = entries.groupBy("x").agg(F.count("*").alias("many")).where("many > 1").select("x")
    tied = written(entries.join(held, "x", "left_semi").select("x", "name", "n", "at", F.col("name").alias("root")), "tied")
    del entries, held
    whole, groups = groups, written(groups.select("name", "least", "n", "parity"), "groups")
    forget(whole)
    comp = None
    for turn in range(TURNS):
        pairs = drawn(tied, turn)
        pairs = written(hopeful(pairs if turn else pairs.unionByName(near), groups), "drawn")
        met = pairs.count()
        comp, many = tie(pairs, comp, groups, rows)
        forget(pairs)
        tied = rooted(tied, comp)
        if many * FEW <= met:
            break
    rest = untied(tied, groups)
    comp, _ = tie(plausible(rest), comp, groups, rows)
    final = groups.join(comp, F.col("name") == F.col("node"), "left").groupBy(F.coalesce("root", "name").alias("root")).agg(F.min("least").alias("least"))
    kept = written(final.select(F.col("least.key").alias("_row_key")), "kept")
    forget(groups, near, tied, rest, comp)
    # columns of docs of any name are out of the way in a struct
    whole = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("_row_key"))
    return whole.join(kept, "_row_key", "left_semi").dropDuplicates(["_row_key"]).select("row.*")
