"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three transducers are compiled from the model file. The normaliser, as the file specifies it, maps letters to letters and
puts U+2581 before a text. The pieces are an automaton with an arc for each piece over its letters. Byte fallback maps a
letter that no piece spells to the pieces of its bytes. Composed with a text they are the lattice of its positions, and
the encoding is its shortest path in the tropical semiring.

A BPE model's scores are merge ranks and no costs to add up, so weights are 0 and infinity: a state is the piece that
ends at a position, and an arc costs nothing if it is merge-consistent with that piece. Two pieces are consistent if
merging their joint letters (the best score first, of equal ones the leftmost) ends in just these two. A path is what
merging gives the whole text exactly if all its neighbours are consistent, as the first merge over a border would be made
for the two pieces alone too. So one arc of finite weight ends at each position, and the shortest path is SentencePiece's
own encoding. The lattice is composed as far as it is searched: depth first, the longest arcs first, and a position from
which no finite path goes on is not entered again, as only one leads to it. No piece holds U+2581 after another letter, so
the lattice falls apart before each run of them; the parts' paths are remembered. Decoding maps pieces and bytes back.

Edge cases: null and empty texts have no pieces and decode to the empty text; repeated rows are kept; null ids are kept;
further columns are ignored by encode; U+2581 in a text is read as a space, as the model has it; an empty table gives an
empty table; work grows with the length of a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_and_texts, map_texts, sums

SPACE = "▁"
CACHE, LONG, PAIRS = 400_000, 64, 300_000
SCHEMA = "doc_id long, n_pieces long, n_bytes_pieces long, ids array<int>, ids_sha256 string, decoded string, round_trip boolean"


class Paths(dict):
    """Paths of parts met before; those of long parts are not kept. Of CACHE, those that were not met again while half as
    many others were go."""

    def __init__(self, find: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.find, self.before = find, {}

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self.before.pop(part, None) or self.find(part)
        if len(part) <= LONG:
            if len(self) >= CACHE // 2:
                self.before = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def forget(self) -> None:
        self.before = {}
        self.clear()


class Arcs(dict):
    """The arcs that begin with letters which lead on in the automaton, by these letters: length and id, the longest first.
    A letter that leads nowhere has one arc, that of byte fallback, told by a number below -1."""

    def __init__(self, ids: dict[str, int]):
        super().__init__()
        self.ids = ids

    def __missing__(self, head: str) -> list[tuple[int, int]]:
        found = [(k, self.ids[head[:k]]) for k in range(len(head), 0, -1) if head[:k] in self.ids]
        if not found:
            return [(1, -2 - ord(head))]
        self[head] = found
        return found


class Fits(dict):
    """Whether two pieces, by id, are merge-consistent neighbours; all are forgotten when there are PAIRS."""

    def __init__(self, find: Callable[[int, int], bool]):
        super().__init__()
        self.find = find

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        self[pair] = good = self.find(*pair)
        return good


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a message in the protocol-buffer wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return out

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, raw[at : at + n]
        at += n


class Normaliser:
    """The model's normaliser as a transducer of one state: what it puts before a text, and each letter's output."""

    #: Fixed values of the format: the field of the normaliser's specification and the fields in it.
    SPEC, CHARSMAP, PREFIX, TRIM, ESCAPE = 3, 2, 3, 4, 5

    def __init__(self, path: str):
        with open(path, "rb") as f:
            found = dict(fields(next((v for k, v in fields(f.read()) if k == self.SPEC), b"")))
        if found.get(self.CHARSMAP) or found.get(self.TRIM, 1):
            raise ValueError(f"the model's normaliser maps strings or removes white space: {path}")
        self.arcs = {ord(" "): SPACE} if found.get(self.ESCAPE, 1) else {}
        self.start = (SPACE if self.arcs else " ") if found.get(self.PREFIX, 1) else ""

    def __call__(self, text: str) -> str:
        for letter, out in self.arcs.items():
            text = text.replace(chr(letter), out)
        return self.start + text if text else ""

    def back(self, text: str) -> str:
        """The text of an output, which is the text itself but for U+2581 that it had."""
        return (text.replace(SPACE, " ") if self.arcs else text)[len(self.start) :]


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        self.normal = Normaliser(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(len(model))]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        usable = [i for i in range(len(model)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(SPACE in p.lstrip(SPACE) for p in map(self.pieces.__getitem__, usable)):
            raise ValueError("a piece goes on after a space; texts cannot be parted before spaces")
        # the automaton tells how far letters lead
        self.automaton, self.score, ids = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), {}, {}
        for i in usable:
            self.score[self.pieces[i]], ids[self.pieces[i]] = model.get_score(i), i
            self.automaton.add_word(self.pieces[i])
        self.arcs, self.longest = Arcs(ids), max(map(len, ids), default=1)
        # a letter that is a piece is never its bytes
        letters = frozenset(x for x in self.score if len(x) == 1)
        if not all(map(letters.issuperset, self.score)):
            raise ValueError("a piece holds a letter that is none; its bytes could not be told from the letter in merging")
        self.known, self.fits, self.grown = Paths(self.path), Fits(self.consistent), {}
        # by id: the bytes it stands for, its number in decimal and whether it is a byte's
        self.raw = [bytes([self.of_byte[i]]) if i in self.of_byte else p.encode() for i, p in enumerate(self.pieces)]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.is_byte = np.array([i in self.of_byte for i in range(len(self.pieces))])
        self.runs = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def parts(self, text: str) -> list[str]:
        """Each run of U+2581 with the letters behind it, up to the next."""
        if " " in text or not text.startswith(SPACE):
            return self.runs(text)
        # no space is in the text, so that they can be put before each U+2581 and taken away again within runs
        apart = text.replace(SPACE, " " + SPACE)
        while (double := f"{SPACE} {SPACE}") in apart:
            apart = apart.replace(double, SPACE + SPACE)
        return apart[1:].split(" ")

    def growth(self, i: int) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its letters, in order: the score of each and the first and the last symbol after it.
        None if merging ends otherwise, so that no text has the piece."""
        if i not in self.grown:
            symbols, steps = list(self.pieces[i]), []
            while len(symbols) > 1:
                score, at = max((self.score.get(a + b, -inf), -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
                if score == -inf:
                    break
                symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
                steps.append((score, symbols[0], symbols[-1]))
            self.grown[i] = steps if len(symbols) == 1 else None
        return self.grown[i]

    def consistent(self, a: int, b: int) -> bool:
        """Whether merging the letters of both pieces ends in these two: until both are made, no merge over their border comes first.
        Bytes are of letters that nothing merges with."""
        alone = a < 0 or a in self.of_byte, b < 0 or b in self.of_byte
        left, right = ([] if x else self.growth(i) for x, i in zip(alone, (a, b), strict=True))
        if left is None or right is None or any(alone):
            return left is not None and right is not None
        end, start, j, k = self.pieces[a][-1], self.pieces[b][0], 0, 0
        while True:
            one = left[j][0] if j < len(left) else -inf
            two = right[k][0] if k < len(right) else -inf
            over = self.score.get(end + start, -inf)
            if over > one and over >= two and over > -inf:
                return False
            if one == two == -inf:
                return True
            if one >= two:
                end, j = left[j][2], j + 1
            else:
                start, k = right[k][1], k + 1

    def path(self, part: str) -> tuple[int, ...]:
        """The ids on the shortest path: the one whose neighbours are all merge-consistent."""
        n, fits, begin, reach, longest = len(part), self.fits, self.arcs, self.automaton.longest_prefix, self.longest
        out: list[int] = []
        # for each arc of the path, where it begins and which arcs are left there
        taken: list[tuple[int, Iterator[tuple[int, int]]]] = []
        dead: set[int] = set()
        at, last, spelt = 0, -1, False
        while at < n:
            k = reach(part[at : at + longest])
            if not k:
                k, spelt = 1, True
            arcs = iter(begin[part[at : at + k]])
            while True:
                for k, arc in arcs:
                    if fits[last, arc] and at + k not in dead:
                        break
                else:
                    # nothing goes on from here: the arc that led here was not the one
                    dead.add(at)
                    at, arcs = taken.pop()
                    out.pop()
                    last = out[-1] if out else -1
                    continue
                break
            taken.append((at, arcs))
            out.append(arc)
            at, last = at + k, arc
        if spelt:
            out = [i for arc in out for i in ([arc] if arc >= 0 else map(self.bytes.__getitem__, chr(-2 - arc).encode()))]
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.parts(self.normal(text or "")))))

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return self.normal.back(raw.decode(errors="replace"))


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """For each row its piece ids, their number and digest, the decoded text and whether it equals the text."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        fst = transducer(model)
        texts = batch.column(1).to_pylist()
        found = [fst.encode(x) for x in texts]
        at = np.cumsum([0, *map(len, found)])
        places = np.fromiter(chain.from_iterable(found), np.int32, at[-1])
        digests = [hashlib.sha256(",".join(map(fst.decimal.__getitem__, ids)).encode()).hexdigest() for ids in found]
        decoded = [fst.decode(ids) for ids in found]
        same = [back == (text or "").replace(SPACE, " ") for back, text in zip(decoded, texts, strict=True)]
        columns = [pa.array(np.diff(at), pa.int64()), pa.array(sums(fst.is_byte[places].astype(np.int64), at), pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(places)), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_pieces", "n_bytes_pieces", "ids", "ids_sha256", "decoded", "round_trip"])

    # a worker that has paths of one partition in mind would hold them while other stages run
    return map_texts(ids_and_texts(docs), each, SCHEMA, after=lambda: transducer(model).known.forget())
