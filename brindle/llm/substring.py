"""Substring dedup over words: what an earlier document holds goes.

The reference is the dictionary of distinct phrases of all documents with the least id of each (repeats.py). A factor is a
maximal run of windows of `width` words that documents of smaller ids hold, found by windows and not by matching word by
word against reference blocks as relative Lempel-Ziv parsing does: the README says why, with figures. Factors are the
duplicate spans, the words between them literals.

Edge cases: null texts have no words; texts of fewer than `width` words keep all; a null id is later than none and earlier
than none; rows that repeat an id and text get equal results; further columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts
from .repeats import Words, covered, n_runs, sha, window_repeats

WIDTH, GRAM, BLOCK = 50, 12, 10
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, kept string"


def dedup_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """One row for each row: word counts, the words kept joined by one space, their SHA-256 and the number of factors."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[], [], [], [], []]
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            found = (text or "").encode().split()
            mask = covered(len(found), runs, width)
            kept = b" ".join(w for w, gone in zip(found, mask.tolist(), strict=True) if not gone)
            for column, value in zip(out, (len(found), int(mask.sum()), sha(kept), n_runs(mask), kept.decode()), strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "kept"])

    return map_texts(window_repeats(docs, Words, width, gram, block, earlier=True), each, SCHEMA)
