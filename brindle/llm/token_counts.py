"""Token counts by rank-synchronous array merging.

Texts are split by the byte-level pattern of the vocabulary file. Pre-tokens not met before are held as one ragged
array of symbols; each round finds every sequence's lowest-ranked adjacent pair and merges all its places at once, until
no sequence has a pair left. The symbols that survive are the tokens. A sequence of more than LONG symbols is merged
alone, its places held by rank, so that a round costs what it merges and not the whole sequence; its work grows as n log n.

Edge cases: a null text counts as empty (no bytes, no tokens); repeated rows are counted each; null ids are kept;
further columns are ignored; an empty table gives an empty table; one pre-token of a megabyte takes seconds.
"""

from __future__ import annotations

import json
from collections import defaultdict
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ids_and_texts, map_texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Pre-tokens whose counts a worker remembers.
CACHE = 300_000
#: Symbols of a pre-token above which it is merged alone.
LONG = 256
#: White space as the Unicode property has it, without the separators 0x1C to 0x1F that Python adds.
WHITE = r"\t\n\x0b\f\r \x85\xa0  -     　"
#: The published split pattern of byte-level vocabularies, white space spelled out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else the next free code point from 256."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(seen) else chr(next(hidden)) for b in range(256)]


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        ids = spec["model"]["vocab"]
        self.base = np.array([ids[x] for x in byte_letters()], np.int64)
        self.size = max(ids.values()) + 1
        pairs = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        # a pair is made of symbols that lower ranks make, so that no merge opens a place of a lower rank
        first = {x: r for r, x in reversed(list(enumerate(self.made.tolist())))}
        if any(max(first.get(ids[a], -1), first.get(ids[b], -1)) >= r for r, (a, b) in enumerate(pairs)):
            raise ValueError(f"merges are not in the order of their parts: {path}")
        special = [regex.escape(x["content"]) for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, int] = {}

    def merged(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols of each non-empty sequence of bytes after all merges."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = lengths.copy()
        symbols = self.base[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols) > 1:
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], NONE)
            rank = np.append(rank, NONE)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            counts[owner[starts]] = sizes
            live = np.repeat(lowest != NONE, sizes)
            if not live.any():
                break
            hit = (rank == np.repeat(lowest, sizes)) & live
            # of a run of overlapping places, which are all of one symbol, every second one is merged from the left
            place = np.flatnonzero(hit)
            fresh = np.append(True, np.diff(place) > 1)
            run = place[fresh][np.cumsum(fresh) - 1]
            place = place[(place - run) % 2 == 0]
            symbols[place] = self.made[rank[place]]
            live[place + 1] = False
            symbols, owner = symbols[live], owner[live]
        if len(symbols) == 1:
            counts[owner[0]] = 1
        return counts

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The rank of each pair."""
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def alone(self, piece: bytes) -> int:
        """The number of symbols of one long sequence after all merges: the same rounds, over lists linked both ways."""
        symbols = self.base[np.frombuffer(piece, np.uint8)].tolist()
        n, size, rank_of, made = len(symbols), self.size, self.pairs, self.made.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = defaultdict(list)
        for i in range(n - 1):
            if (r := rank_of.get(symbols[i] * size + symbols[i + 1])) is not None:
                places[r].append(i)
        ranks = list(places)
        heapify(ranks)
        left = n

        def open_place(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and (r := rank_of.get(symbols[i] * size + symbols[j])) is not None:
                if r not in places:
                    heappush(ranks, r)
                places[r].append(i)

        while ranks:
            r = heappop(ranks)
            for i in sorted(places.pop(r)):
                j = after[i]
                # a place may be gone, or hold another pair by now
                if symbols[i] < 0 or j >= n or rank_of.get(symbols[i] * size + symbols[j]) != r:
                    continue
                symbols[i], symbols[j], after[i] = made[r], -1, after[j]
                if after[i] < n:
                    before[after[i]] = i
                left -= 1
                if before[i] >= 0:
                    open_place(before[i])
                open_place(i)
        return left

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > CACHE:
            self.known.clear()
        fresh = [x for x in pieces if x not in self.known]
        if fresh:
            raw = {x: x.encode() for x in fresh}
            short = [x for x in fresh if len(raw[x]) <= LONG]
            if short:
                self.known.update(zip(short, self.merged([raw[x] for x in short]).tolist(), strict=True))
            self.known.update((x, self.alone(raw[x])) for x in fresh if len(raw[x]) > LONG)

    def count(self, texts: list[str]) -> list[int]:
        """The tokens of each text; strings of added tokens count as one each, as the library's default has it."""
        found, out = [], []
        for text in texts:
            parts, extra = [text], 0
            if self.special is not None:
                parts = self.special.split(text)
                extra = len(parts) - 1
            found.append((extra, [p for part in parts for p in self.split(part)]))
        need = {p for _, pieces in found for p in pieces}
        self.learn(need)
        for extra, pieces in found:
            out.append(extra + sum(map(self.known.__getitem__, pieces)))
        return out


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens is over `limit`, for each row. vocabulary: a file that each executor has."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        n = np.array(counter(vocabulary).count(texts), np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_texts(ids_and_texts(docs), each, SCHEMA)
