"""Secret scans: an Aho-Corasick prefilter, anchored regular expressions at its hits, checksums.

All work is on UTF-8 bytes of whole texts in narrow Arrow tasks; nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, ship

#: Kinds in the order of the contract, then this operator's own.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
_ASSIGN = re.compile(rb"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: A maximal run of 24 or more; shorter runs are dropped by the contract. It has no keyword to look for.
_HEX = re.compile(rb"[0-9a-f]{24,}")
_GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_JWT = re.compile(rb"(eyJ[0-9A-Za-z_-]+)\.(eyJ[0-9A-Za-z_-]+)\.[0-9A-Za-z_-]+")
#: A web token's part: where a token fails, none begins in the rest of its first part.
_JWT_PART = re.compile(rb"[0-9A-Za-z_-]+")
_PEM = re.compile(rb"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
#: Lower-case keyword, kind, anchored expression, whether the keyword itself must match in its own case.
KEYWORDS = (
    ("password", "assign", _ASSIGN),
    ("passwd", "assign", _ASSIGN),
    ("secret", "assign", _ASSIGN),
    ("token", "assign", _ASSIGN),
    ("apikey", "assign", _ASSIGN),
    ("api_key", "assign", _ASSIGN),
    ("akia", "access", _ACCESS),
    ("ghp_", "github", _GITHUB),
    ("gho_", "github", _GITHUB),
    ("ghu_", "github", _GITHUB),
    ("ghs_", "github", _GITHUB),
    ("ghr_", "github", _GITHUB),
    ("npm_", "npm", _NPM),
    ("eyj", "jwt", _JWT),
    ("-----begin ", "pem", _PEM),
)
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: bytes) -> bytes:
    """The six base-62 digits of a body's CRC-32, as such tokens end with."""
    value, out = zlib.crc32(body), bytearray()
    for _ in range(6):
        value, digit = divmod(value, 62)
        out.append(_BASE62[digit])
    return bytes(reversed(out))


def _json_part(part: bytes) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))), dict)
    except (ValueError, binascii.Error, RecursionError):
        return False


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= 6
    if kind == "access":
        return len(m[0]) >= 20
    if kind in ("github", "npm"):
        return base62_crc(m[1]) == m[2]
    if kind == "jwt":
        return _json_part(m[1]) and _json_part(m[2])
    return len(re.sub(rb"\s", b"", m[2])) >= 64


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, kind, pattern in KEYWORDS:
        out.add_word(word, (len(word), kind, pattern))
    out.make_automaton()
    return out


def find(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in code points, sorted; leftmost and non-overlapping by kind."""
    raw = text.encode("utf-8", "surrogatepass")
    # Bytes as characters: the automaton's places are then byte places, and lower() is ASCII only.
    hits = sorted((end + 1 - n, kind, pattern) for end, (n, kind, pattern) in machine.iter(raw.lower().decode("latin-1")))
    ends, spans = dict.fromkeys(KINDS, 0), []
    for at, kind, pattern in hits:
        if at < ends[kind]:
            continue
        m = pattern.match(raw, at)
        if m is None and kind == "jwt" and (part := _JWT_PART.match(raw, at)):
            ends[kind] = part.end()
        if m:
            ends[kind] = m.end()
            if _valid(kind, m):
                spans.append((m.start(), KINDS.index(kind), m.end()))
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(raw)]
    if len(raw) == len(text):
        return sorted(spans)
    points, seen, count = {}, 0, 0
    for at in sorted({x for s, _, e in spans for x in (s, e)}):
        count += len(raw[seen:at].decode("utf-8", "surrogatepass"))
        seen = at
        points[at] = count
    return sorted((points[s], k, points[e]) for s, k, e in spans)


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for a, b in blocks(batch, 1):
            for text in batch.column(1).slice(a, b - a).to_pylist():
                spans = find(text, machine) if text else []
                base = [x for x in spans if x[1] < 3]
                for number, kind in enumerate(("n_assign", "n_access", "n_hex")):
                    out[kind].append(sum(x[1] == number for x in base))
                out["base_sha256"].append(hashlib.sha256(said(base).encode()).hexdigest())
                out["spans"].append(said(spans))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in out.items())], names=["key", *out])


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row: counts of the base kinds, their digest and all spans in code points.

    The base kinds are exact; this operator adds checksummed hosting and registry tokens, web tokens whose
    two parts decode to objects, and private-key blocks. Null and empty texts have no spans. Keys
    may be null or repeated; rows are independent. Other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(scan_batches, f"key {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.withColumnRenamed("key", key)


def _redact(batches: Iterator[pa.RecordBatch], column: int, mark: str) -> Iterator[pa.RecordBatch]:
    machine = automaton()
    for batch in batches:
        for a, b in blocks(batch, column):
            part, texts = batch.slice(a, b - a), []
            for text in part.column(column).to_pylist():
                spans, parts, at = find(text, machine) if text else [], [], 0
                for start, _, end in spans:
                    if end <= at:
                        continue
                    if start >= at:
                        parts += [text[at:start], mark]
                    at = end
                texts.append("".join([*parts, text[at:]]) if spans else text)
            yield part.set_column(column, part.schema.field(column), pa.array(texts, part.schema.field(column).type))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Every row with all secrets (overlapping ones once) replaced by ``mark``; other columns stay as they are.

    Null and empty texts stay so; repeated rows are each redacted.
    """
    ship(docs.sparkSession)
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _redact(batches, column, mark)

    return docs.mapInArrow(run, docs.schema)
