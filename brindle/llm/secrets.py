"""Secret scan with structural confirmation.

Three plain kinds (assign, access, hex) are found by pattern. Further kinds are reported only when decoding confirms
them: `pem` and `der` are private keys whose base64 or hex body parses as nested DER lengths with the fields of a
private key (or as an OpenSSH key's length-prefixed strings), `jwt` is a signed token whose header decodes to JSON with
an algorithm. Spans are in code points, end exclusive.

Work grows with the length of a text: markers are paired once, and each candidate's bytes are decoded once. A key that
is wrapped over lines without markers is followed for as many letters as its outer length says, WRAPPED at most.

Edge cases: a null text counts as empty; null ids and repeated rows are kept; further columns are ignored by scan_secrets
and kept, whatever their names, by redact_secrets; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, map_texts

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "jwt")
#: The patterns of the plain kinds and the least lengths of group 2, or of the match.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
MARKER = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
#: Base64 letters of a key without markers that goes on over line ends, at most: RSA keys of 16,384 bits have 13,000.
WRAPPED = 65_536
#: The first base64 letters of a DER sequence and of an OpenSSH key.
BASE64 = re.compile(r"(?:M[A-Za-z0-9+/_-]{22}|b3BlbnNzaC1rZXktdjEA)[A-Za-z0-9+/_-]*={0,2}")
#: The same in hex.
LONG_HEX = re.compile(r"(?:30|6f70656e7373682d6b65792d7631)[0-9A-Fa-f]{46,}", re.I)
#: The head of a token is an object in JSON; white space may follow its brace.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*")
LINE_END = re.compile(r"\\r\\n|\\n|[\r\n]\s*")
LINE, PAD = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"={0,2}")
SSH_MAGIC = b"openssh-key-v1\0"
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def decoded(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, padded or not; None if it isn't."""
    body = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of consecutive DER values that fill `data` exactly; None if the lengths don't fit."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 0x80:
            wide = n & 0x7F
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            n, at = int.from_bytes(data[at : at + wide], "big"), at + wide
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        items.append((tag, data[at : at + n]))
        at += n
    return items


def private_der(data: bytes) -> bool:
    """Whether the bytes are one DER sequence with the fields of a PKCS#1, PKCS#8, encrypted PKCS#8, DSA or SEC1 private key."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(outer[0][1])
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _ in inner]
    if tags[0] == 0x30:  # encrypted PKCS#8: algorithm, then octets
        algorithm = der_items(inner[0][1])
        return tags == [0x30, 0x04] and bool(algorithm) and algorithm[0][0] == 0x06
    if tags[0] != 0x02 or inner[0][1] not in (b"\0", b"\1"):
        return False
    if tags[1] == 0x30 and len(tags) > 2 and tags[2] == 0x04:
        algorithm = der_items(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags[1] == 0x04:
        return inner[0][1] == b"\1"
    return tags[1:] in ([0x02] * 8, [0x02] * 5)


def ssh_key(data: bytes) -> bool:
    """Whether length-prefixed strings follow the OpenSSH magic: cipher, kdf and its options, count, public key, private part."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)
    for k in range(6):
        if at + 4 > len(data):
            return False
        n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if k == 3:
            if not 1 <= n <= 16:
                return False
            continue
        if at + n > len(data):
            return False
        at += n
    return True


def key_bytes(data: bytes | None) -> bool:
    return bool(data) and (private_der(data) or ssh_key(data))


def pem_body(body: str) -> bool:
    """Whether what lies between markers is a key; its line ends may be escaped."""
    body = body.replace("\\r", "").replace("\\n", "\n").replace("\r", "")
    head, blank, rest = body.partition("\n\n")
    if blank and ":" in head:
        # an encrypted body shows no structure; its headers name the cipher
        return "ENCRYPTED" in head and bool(decoded(rest))
    return key_bytes(decoded(body))


def wrapped_key(text: str, start: int, end: int) -> int | None:
    """The end of a DER key in base64 that goes on over line ends after its first line, which ends at `end`."""
    head = decoded(text[start : start + 8]) or b""
    if len(head) < 6 or head[0] != 0x30 or not head[1] & 0x80 or not 1 <= (wide := head[1] & 0x7F) <= 4:
        return None
    need = -(-(2 + wide + int.from_bytes(head[2 : 2 + wide], "big")) * 4 // 3)
    if not end - start < need <= WRAPPED:
        return None
    parts, held, at = [text[start:end]], end - start, end
    while held < need and (gap := LINE_END.match(text, at)):
        line = LINE.match(text, gap.end())
        if not line:
            return None
        parts.append(line[0][: need - held])
        at = gap.end() + len(parts[-1])
        held += len(parts[-1])
    pad = PAD.match(text, at)[0]
    return at + len(pad) if held == need and key_bytes(decoded("".join(parts))) else None


def signed_header(token: str) -> bool:
    try:
        header = json.loads(decoded(token.split(".")[0]) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def plain_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the three plain kinds."""
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST["assign"]:
            yield m.start(), 0, m.end()
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= LEAST[KINDS[kind]]:
                yield m.start(), kind, m.end()


def confirmed_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of what decoding confirms."""
    begin = None
    for m in MARKER.finditer(text) if "PRIVATE KEY-----" in text else ():
        # a key lies between markers of one name with none in between
        if m[1] == "BEGIN":
            begin = m
        elif begin is not None:
            if begin[2] == m[2] and pem_body(text[begin.end() : m.start()]):
                yield begin.start(), 3, m.end()
            begin = None
    letters = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
    for m in BASE64.finditer(text):
        if m.start() and text[m.start() - 1] in letters:
            continue
        if key_bytes(decoded(m[0])):
            yield m.start(), 4, m.end()
        elif (end := wrapped_key(text, m.start(), m.end())) is not None:
            yield m.start(), 4, end
    for m in LONG_HEX.finditer(text):
        inside = m.start() and text[m.start() - 1] in "0123456789abcdefABCDEF"
        if not inside and len(m[0]) % 2 == 0 and key_bytes(bytes.fromhex(m[0])):
            yield m.start(), 4, m.end()
    for m in TOKEN.finditer(text):
        if signed_header(m[0]):
            yield m.start(), 5, m.end()


def secret_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of every secret, sorted."""
    return sorted([*plain_spans(text), *confirmed_spans(text)]) if text else []


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row: counts of the plain kinds, the digest of their spans, all spans, and how many were confirmed by decoding."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for text in batch.column(1).to_pylist():
            spans = secret_spans(text)
            base = [x for x in spans if x[1] < 3]
            kinds = [k for _, k, _ in spans]
            row = (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return map_texts(ids_and_texts(docs), each, SCHEMA)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with each maximal run of secret characters replaced by the mark."""
    out, at = [], 0
    runs: list[list[int]] = []
    for a, _, b in secret_spans(text):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for a, b in runs:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with secrets replaced in text, and n_chars, where there is one, counted again. A null text stays null."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = [x if x is None else redacted(x, mark) for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out
