"""Repeated windows over a corpus, found through content-chosen phrases.

Every window of `width` units (bytes or words) picks the least rolling hash of the `gram`-unit strings within it, its
trigger. Consecutive windows that pick one place form a phrase, which overlaps its neighbours so that each window lies in
exactly one phrase. Equal windows lie at equal places of phrases with equal triggers, hence
1. equal phrases are joined to one dictionary entry by groupBy (pre-aggregated, so a hot passage is one row per map task);
2. only entries whose trigger occurs in another entry have their windows compared, once per entry and not per copy, in
   blocks of `block` windows by their distance from the trigger. All windows of a block hold its core; its span holds
   them all. An unshared core means that none is repeated, a shared span that all are; only the windows of blocks whose
   core is shared by an entry that its span does not settle, the ends of repeats, are compared one by one, by what each
   adds to the core on both sides;
3. the windows found are dealt back to the entries' occurrences and from there to documents.
No pairs of documents or entries are ever made.

Phrases, cores and spans are told by 128-bit BLAKE2 digests of their bytes. The windows of one core are told by sums of
64-bit values that new random keys give to each unit at each place, so that no texts can be made to collide, and two
given windows do so by a chance of 2**-64. Keys of the joins by core, span and entry that hold
more than one row in 256 are at most 255; they are broadcast and their rows stay where they are.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, forget, hot_join, ids_and_texts, map_texts, ragged, row_key, words, written

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bits of a place within a text; a text of an Arrow batch is shorter.
PLACE_BITS = 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def rolling(units: np.ndarray, gram: int) -> np.ndarray:
    """The rolling hash of every run of `gram` units, from prefix sums modulo 2**64. It only chooses triggers."""
    n = len(units)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(units * powers(INVERSE, n), dtype=np.uint64)))
    return mixed((sums[gram:] - sums[: n + 1 - gram]) * powers(BASE, n + 1 - gram))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i + width]) for each i: block-wise running minima from both ends."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Bytes:
    """A text as its bytes."""

    kind = np.uint8
    table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

    def __init__(self, values: np.ndarray):
        self.values, self.raw = values, values.tobytes()

    def __len__(self) -> int:
        return len(self.values)

    def hashes(self) -> np.ndarray:
        return self.table[self.values]

    def name(self, a: int, b: int, salt: bytes = b"") -> bytes:
        return hashlib.blake2b(self.raw[a:b], digest_size=16, salt=salt).digest()

    @staticmethod
    def read(raw: np.ndarray, at: np.ndarray) -> Iterator[Bytes]:
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield Bytes(raw[a:b])


class Words:
    """A text as its words: their 64-bit hashes, and their bytes with a space after each."""

    kind = np.uint64

    def __init__(self, values: np.ndarray, raw: bytes, at: np.ndarray):
        self.values, self.raw, self.at = values, raw, at

    def __len__(self) -> int:
        return len(self.values)

    def hashes(self) -> np.ndarray:
        return self.values

    def name(self, a: int, b: int, salt: bytes = b"") -> bytes:
        return hashlib.blake2b(self.raw[self.at[a] : self.at[b]], digest_size=16, salt=salt).digest()

    @staticmethod
    def read(raw: np.ndarray, at: np.ndarray) -> Iterator[Words]:
        starts, ends, before = words(raw, at)
        whole = raw.tobytes()
        known: dict[bytes, int] = {}

        def digest(word: bytes) -> int:
            if (h := known.get(word)) is None:
                h = known[word] = xxhash.xxh3_64_intdigest(word)
            return h

        spans = zip(starts.tolist(), ends.tolist(), strict=True)
        values = np.fromiter((digest(whole[a:b]) for a, b in spans), np.uint64, len(starts))
        # the bytes of all words, one space after each
        inside, places = ~SPACE[raw], np.concatenate(([0], np.cumsum(ends - starts + 1)))
        joined = np.full(places[-1], 32, np.uint8)
        joined[np.arange(inside.sum()) + np.repeat(np.arange(len(starts)), ends - starts)] = raw[inside]
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            yield Words(values[a:b], joined[places[a] : places[b]].tobytes(), places[a : b + 1] - places[a])


def phrases(text: Bytes | Words, width: int, gram: int):
    """First and last window start, trigger's hash and place of each phrase of one text."""
    n = len(text)
    if n < width:
        return None
    grams = rolling(text.hashes(), gram)
    low = np.uint64(PLACE_BITS)
    least = sliding_least((grams >> low << low) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], len(place)) - 1
    return first, last, grams[place[first]], place[first]


def blocks_of(text: Bytes | Words, first: int, last: int, place: int, width: int, block: int) -> Iterator[tuple]:
    """Each block of a phrase: first and last window start, names of core and span (none where the text ends before it
    does), which tell blocks of unequal distance from the trigger apart, and the units on both sides of the core."""
    n, side = len(text), block - 1
    for k in range((place - last) // block, (place - first) // block + 1):
        end = place - k * block
        start, salt = end - side, k.to_bytes(8, "little", signed=True)
        span = text.name(start, end + width, salt) if start >= 0 and end + width <= n else None
        edge = np.zeros(2 * side, text.kind)
        left, right = text.values[max(start, 0) : end], text.values[start + width : end + width]
        edge[side - len(left) : side] = left
        edge[side : side + len(right)] = right
        yield max(start, first), min(end, last), start, text.name(end, start + width, salt), span, edge.tobytes()


def window_repeats(docs: DataFrame, units: type[Bytes] | type[Words], width: int, gram: int, block: int, earlier: bool) -> DataFrame:
    """key, text, doc_id and `runs`: window starts [first, last] that are repeated. earlier: only if a smaller doc_id has
    the window (a null id is smaller than none and none is smaller than it); else if it starts anywhere else."""
    keyed = ids_and_texts(docs).withColumn("key", row_key())
    no_id, side = (1 << 63) - 1, block - 1

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, ids, names, parts = [], [], [], []
        for key, doc, text in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), units.read(*ragged(batch)), strict=True):
            if (p := phrases(text, width, gram)) is not None:
                keys += [key] * len(p[0])
                ids += [no_id if doc is None else doc] * len(p[0])
                names += [text.name(a, b + width) for a, b in zip(p[0].tolist(), p[1].tolist(), strict=True)]
                parts.append(p)
        first, last, anchor, place = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4
        arrays = [pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(first), pa.array(last), pa.array(anchor.view(np.int64)), pa.array(names, pa.binary()), pa.array(place - first)]
        return pa.RecordBatch.from_arrays(arrays, names=["key", "id", "first", "last", "anchor", "entry", "place"])

    found = written(map_texts(keyed, find, "key binary, id long, first long, last long, anchor long, entry binary, place long"), "phrases")
    entries = found.groupBy("entry", "anchor").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"), F.min(F.struct("key", "first", "last", "place")).alias("at"))
    entries = written(entries, "entries")
    shared = entries.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    # entries of one trigger are distinct texts
    asked = entries.join(shared, "anchor", "left_semi").select("entry", "n", "least", "at.*")
    asked = asked.groupBy("key").agg(F.collect_list(F.struct("entry", "n", "least", "first", "last", "place")).alias("asked"))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(9)]
        done = set()
        for text, wanted, key in zip(units.read(*ragged(batch)), batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key in done:
                continue
            done.add(key)
            for w in wanted:
                f = w["first"]
                for a, b, start, core, span, edge in blocks_of(text, f, w["last"], f + w["place"], width, block):
                    for column, value in zip(out, (w["entry"], w["n"], w["least"], a - f, a - start, b - a + 1, core, span, edge), strict=True):
                        column.append(value)
        kinds = [pa.binary(), *[pa.int64()] * 5, *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["entry", "n", "least", "offset", "skip", "size", "core", "span", "edge"])

    blocks = written(map_texts(keyed.join(asked, "key").select("doc_id", "text", "key", "asked"), compare, "entry binary, n long, least long, offset long, skip long, size long, core binary, span binary, edge binary"), "blocks")
    many = blocks.count()
    cores = written(blocks.groupBy("core").agg(F.count("*").alias("m"), F.min("least").alias("core_low")).where("m > 1"), "cores")
    spans = written(blocks.where("span is not null").groupBy("span").agg(F.count("*").alias("m"), F.min("least").alias("span_low")).where("m > 1"), "spans")
    whole = F.coalesce(F.col("span_low") < F.col("least") if earlier else F.col("span_low").isNotNull(), F.lit(False))
    unsettled = F.col("core_low") < F.col("least") if earlier else F.col("n") == 1
    cored = hot_join(blocks.select("entry", "n", "least", "offset", "size", "core", "span"), cores, "core", "m", many).drop("m")
    # no span matches another: such rows are dealt apart
    cored = cored.withColumn("span", F.coalesce("span", F.concat("core", "entry")))
    judged = hot_join(cored, spans, "span", "m", many, "left")
    judged = written(judged.select("entry", "offset", "size", "core", whole.alias("whole"), (unsettled & ~whole).alias("open")), "judged")
    opened = written(cores.select("core", "m").join(judged.where("open").select("core").distinct(), "core"), "opened")
    random = np.array([secrets.randbits(64) for _ in range(2 * side)], np.uint64)

    def windows_of(batches):
        for batch in batches:
            if not (rows := batch.num_rows):
                continue
            edge = np.frombuffer(b"".join(batch.column(5).to_pylist()), units.kind).reshape(rows, 2 * side).astype(np.uint64)
            edge = mixed(edge + random)
            sums = np.zeros((rows, block), np.uint64)
            sums[:, :side] = np.cumsum(edge[:, :side][:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
            sums[:, 1:] += np.cumsum(edge[:, side:], axis=1, dtype=np.uint64)
            skip, size, offset = (batch.column(k).to_numpy()[:, None] for k in (3, 4, 2))
            at = np.arange(block)[None, :]
            row, place = np.nonzero((at >= skip) & (at < skip + size))
            pick = pa.array(row)
            core = np.frombuffer(b"".join(x[:8] for x in batch.column(6).to_pylist()), np.int64)
            arrays = [batch.column(0).take(pick), batch.column(1).take(pick), batch.column(7).take(pick), pa.array((offset + at - skip)[row, place]), pa.array(core[row]), pa.array(sums[row, place].view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["entry", "n", "least", "offset", "core", "window"])

    edges = hot_join(blocks.select("entry", "n", "offset", "skip", "size", "edge", "core", "least"), opened, "core", "m", many)
    windows = edges.select("entry", "n", "offset", "skip", "size", "edge", "core", "least").mapInArrow(windows_of, "entry binary, n long, least long, offset long, core long, window long")
    windows = written(windows, "windows")
    if earlier:
        hit = windows.groupBy("core", "window").agg(F.min("least").alias("low"), F.max("least").alias("high")).where("low < high").drop("high")
        back = windows.join(hit, ["core", "window"]).where("least > low")
    else:
        hit = windows.groupBy("core", "window").agg(F.sum("n").alias("all")).where("all > 1").drop("all")
        back = windows.where("n = 1").join(hit, ["core", "window"], "left_semi")
    single = back.select("entry", F.col("offset").alias("a"), F.col("offset").alias("b"))
    spread = judged.where("whole").select("entry", F.col("offset").alias("a"), (F.col("offset") + F.col("size") - 1).alias("b"))
    offsets = single.unionByName(spread).groupBy("entry").agg(F.collect_list(F.struct("a", "b")).alias("offsets"))
    known = entries.select("entry", "n", "least", "most").join(offsets, "entry", "left")
    all_of = "least < most" if earlier else "n > 1"
    known = written(known.where(f"{all_of} or offsets is not null").select("entry", "n", "least", "offsets"), "known")
    forget(entries, blocks, cores, spans, judged, opened, windows)
    whole = (F.col("id") > F.col("least")) if earlier else (F.col("n") > 1)
    part = F.transform("offsets", lambda o: F.struct((F.col("first") + o["a"]).alias("a"), (F.col("first") + o["b"]).alias("b")))
    runs = F.when(whole, F.array(F.struct(F.col("first").alias("a"), F.col("last").alias("b")))).otherwise(part)
    marks = hot_join(found, known, "entry", "n", found.count()).select("key", runs.alias("runs")).where("runs is not null")
    marks = written(marks.groupBy("key").agg(F.flatten(F.collect_set("runs")).alias("runs")), "marks")
    forget(found, known)
    return keyed.join(marks, "key", "left").select("doc_id", "text", "key", "runs")


def covered(n: int, runs: list | None, width: int) -> np.ndarray:
    """Which of n units lie in a window that starts in one of the runs."""
    step = np.zeros(n + 1, np.int64)
    if runs:
        np.add.at(step, [r["a"] for r in runs], 1)
        np.add.at(step, [r["b"] + width for r in runs], -1)
    return np.cumsum(step[:-1]) > 0


def n_runs(mask: np.ndarray) -> int:
    return int(np.count_nonzero(mask[1:] & ~mask[:-1]) + bool(len(mask) and mask[0]))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
