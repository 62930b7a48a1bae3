"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ORDER bytes is counted on a bounded sample of labelled rows. A byte
seen in its context costs -log2 c / (n + d), n the context's count and d its distinct successors; one not seen costs the
escape d / (n + d) and then what the next shorter context says, down to one of 256 bytes at order -1. A context that was
never met costs nothing to leave. Statistics are frozen before scoring, so the exact code length of a text is the sum of
its bytes' costs; the language with the shortest code is predicted.

The tree is held as sorted arrays of contexts and of contexts with a successor, one pair for each order; a text is
looked up in them as a whole, longest contexts first, and only the bytes that escape go on to shorter ones.

Bounds: at most `per_language` rows of each language are learned from, spread by a hash of doc_id, and at most
`languages` languages, those of the most rows; texts are learned from and predicted whole. A language's tree is never
larger than its sample, and trees are counted by Spark, so that no text comes to the driver.

Edge cases: null texts and texts without a letter are `und` with score 0; without any labelled row all are `und`; null
ids count as held in for prediction and are not learned from; of a repeated id one text is learned from; ties go to the
first language by name; case of the letters A to Z is ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, give_back, ids_and_texts, map_texts

PER_LANGUAGE, LANGUAGES, ORDER = 300, 1000, 3
#: A text of JUNK_BYTES or more is in none of the languages if even the best needs JUNK_BITS bits a byte. Prose needs two to
#: five, a drawn row of letters 14, and other scripts 20; shorter texts tell too little.
JUNK_BITS, JUNK_BYTES = 12.0, 64
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def grams(text: bytes, order: int) -> np.ndarray:
    """Each byte behind its `order` predecessors, as one number; spaces precede the text."""
    x = FOLD[np.frombuffer(b" " * order + text, np.uint8)].astype(np.int64)
    out = x[: len(text)].copy()
    for k in range(1, order + 1):
        out = out << 8 | x[k : k + len(text)]
    return out


class Tree:
    """The frozen statistics of one language."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """keys: the distinct numbers of ORDER bytes and a successor, sorted, and how often each was met."""
        self.known, self.seen, self.escape = [], [], []
        for order in range(ORDER, -1, -1):
            contexts, first = np.unique(keys >> 8, return_index=True)
            n = np.add.reduceat(counts, first) if len(keys) else counts
            d = np.diff(np.append(first, len(keys)))
            total = np.repeat(n + d, d)
            self.seen.append((keys, -np.log2(counts / total)))
            self.known.append(contexts)
            self.escape.append(-np.log2(d / (n + d)))
            if order:
                # the statistics of the next shorter contexts: without the first byte
                short = keys & ((1 << 8 * order) - 1)
                keys, at = np.unique(short, return_inverse=True)
                counts = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)

    def costs(self, distinct: np.ndarray) -> np.ndarray:
        """The cost in bits of each number of ORDER bytes and a successor."""
        out, place, left = np.zeros(len(distinct)), np.arange(len(distinct)), distinct
        for k, order in enumerate(range(ORDER, -1, -1)):
            keys, price = self.seen[k]
            at = np.minimum(np.searchsorted(keys, left), len(keys) - 1)
            hit = keys[at] == left
            out[place[hit]] += price[at[hit]]
            place, left = place[~hit], left[~hit]
            contexts = self.known[k]
            at = np.minimum(np.searchsorted(contexts, left >> 8), len(contexts) - 1)
            met = contexts[at] == left >> 8
            out[place[met]] += self.escape[k][at[met]]
            left = left & ((1 << 8 * order) - 1)
        out[place] += 8.0
        return out


class Model:
    """Trees by language."""

    def __init__(self, counted: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.names = sorted(counted)
        self.trees = [Tree(*counted[name]) for name in self.names]

    @classmethod
    def of_texts(cls, samples: dict[str, list[bytes]]) -> Model:
        return cls({name: np.unique(np.concatenate([grams(x, ORDER) for x in texts]), return_counts=True) for name, texts in samples.items()})

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """The code length of each text (a row) in each language (a column). Numbers that many texts share are priced once."""
        out = np.zeros((len(texts), len(self.names)))
        pieces: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            found = [p for p in pieces if len(p[1])]
            pieces.clear()
            if found:
                distinct, of = np.unique(np.concatenate([g for _, g in found]), return_inverse=True)
                first = np.concatenate(([0], np.cumsum([len(g) for _, g in found])[:-1]))
                for k, tree in enumerate(self.trees):
                    np.add.at(out[:, k], [i for i, _ in found], np.add.reduceat(tree.costs(distinct)[of], first))

        held = 0
        for i, raw in enumerate(texts):
            for at in range(0, len(raw), CHUNK_BYTES):
                # each piece begins with the bytes before it
                back = min(at, ORDER)
                pieces.append((i, grams(raw[at - back : at + CHUNK_BYTES], ORDER)[back:]))
                held += len(pieces[-1][1])
                if held >= CHUNK_BYTES:
                    settle()
                    held = 0
        settle()
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """For each text the language, its share among the languages' code lengths as probabilities, and its bits per byte."""
        out: list[tuple[str, float, float]] = [("und", 0.0, 0.0)] * len(texts)
        asked = [k for k, x in enumerate(texts) if x and self.names and any(map(str.isalpha, x))]
        raw = [texts[k].encode() for k in asked]
        for k, x, bits in zip(asked, raw, self.bits(raw), strict=True):
            best = int(np.argmin(bits))
            out[k] = self.names[best], float(1 / np.exp2(np.minimum(0, bits[best] - bits)).sum()), float(bits[best] / len(x))
        return out


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language the distinct numbers of its sample and their counts. Which rows are sampled is found by ids alone;
    executors count their texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.coalesce(F.col("text"), F.lit("")) != "") & ~held_out())
    draw = F.xxhash64("doc_id")
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    picked = rows.groupBy("lang", F.pmod(draw, F.lit(per_language)).alias("place")).agg(F.min(F.struct(draw.alias("h"), "doc_id")).alias("x")).select("lang", F.col("x.doc_id").alias("doc_id"))
    # one row of each lang and place at most: the broadcast is bounded
    picked = picked.join(F.broadcast(most), "lang")
    texts = rows.join(F.broadcast(picked), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def count(batches):
        for batch in batches:
            names, keys, counts = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k, c = np.unique(grams(text.encode(), ORDER), return_counts=True)
                names += [lang] * len(k)
                keys.append(k)
                counts.append(c)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))], names=["lang", "gram", "n"])

    counted = texts.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names, keys, counts = np.array(counted["lang"].to_pylist(), object), counted["gram"].to_numpy(), counted["n"].to_numpy()
    order = np.argsort(keys, kind="stable")
    names, keys, counts = names[order], keys[order], counts[order]
    return {lang: (keys[names == lang], counts[names == lang]) for lang in sorted(set(names.tolist()))}


#: A worker builds a model once for each broadcast.
_built: dict[str, Model] = {}


def model_of(number: str, sent) -> Model:
    if number not in _built:
        _built.clear()
        _built[number] = Model(sent.value)
    return _built[number]


def identify(docs: DataFrame, counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte for each row, from text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(counted)
    number = uuid.uuid4().hex

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = model_of(number, sent)
        got = model.predict(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    rows = ids_and_texts(docs).withColumn("held_out", held_out())
    return map_texts(rows, each, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, counted: dict[str, tuple[np.ndarray, np.ndarray]], junk_bits: float = JUNK_BITS) -> DataFrame:
    """The rows of docs, all columns, that are in one of the languages: `und` rows go, and those of JUNK_BYTES or more whose
    best language needs `junk_bits` or more a byte. Where no language was learned, rows with a letter stay."""
    if not counted:
        return docs.where(F.coalesce(F.regexp_like(F.col("text").cast("string"), F.lit(r"\p{L}")), F.lit(False)))
    sent = docs.sparkSession.sparkContext.broadcast(counted)
    number, at = uuid.uuid4().hex, docs.columns.index("text")

    def run(batches):
        batch = texts = None
        try:
            for batch in chunks(batches):
                model = model_of(number, sent)
                texts = batch.column(at).cast(pa.string()).to_pylist()
                kept = [name != "und" and (bits < junk_bits or len(x.encode()) < JUNK_BYTES) for x, (name, _, bits) in zip(texts, model.predict(texts), strict=True)]
                yield batch.filter(pa.array(kept, pa.bool_()))
        finally:
            del batch, texts
            give_back()

    return docs.mapInArrow(run, docs.schema)
