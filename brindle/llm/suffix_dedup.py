"""Byte-level removal of long repeated strings, as in prefix-free parsing but without suffix arrays.

Triggers chosen by a rolling hash cut all texts into overlapping phrases; the distinct phrases are the dictionary. Where
prefix-free parsing sorts the suffixes of dictionary and parse, here equal windows are found among dictionary entries
whose trigger recurs (repeats.py): the README says why, with figures.

Edge cases: null texts are empty; texts of fewer than `width` bytes keep all; every row is its own document, so rows that
repeat an id and text are copies of each other and are removed; further columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts
from .repeats import Bytes, covered, n_runs, sha, window_repeats

WIDTH, GRAM, BLOCK = 400, 48, 32
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def dedup_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """One row for each row: sizes, maximal removed runs, and the bytes kept with their SHA-256."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [[], [], [], [], []]
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            mask = covered(len(raw), runs, width)
            kept = raw[~mask].tobytes()
            for column, value in zip(out, (len(raw), int(mask.sum()), n_runs(mask), sha(kept), kept), strict=True):
                column.append(value)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return map_texts(window_repeats(docs, Bytes, width, gram, block, earlier=False), each, SCHEMA)
