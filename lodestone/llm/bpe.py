"""Byte-level BPE by a distinct-word table: encode each distinct word once, join ids back by position.

1. Documents are split into words in Spark tasks, and the words of the corpus are counted (``word_table``).
2. Each distinct word is encoded once by the tokenizers library; the result is a stored table (word, n, ids).
3. The most frequent words (at most ``TABLE_WORDS`` of at most ``WORD_BYTES`` bytes, so of a bounded size) are broadcast, and the
   ids of all words come back by an array join on the word's place. The few other words are encoded where they stand.
4. Decoding joins ids with the table of pieces.

Words meet in the table by a 64-bit hash; every document is decoded and compared with its text, and one that differs is
encoded by the library alone, so a collision cannot survive.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, environment_path, ship, span_hashes, stored, text_bytes

#: Words of the broadcast table, and bytes of each, at most.
TABLE_WORDS, WORD_BYTES = 1 << 18, 64
#: Distinct words that a task counts at once.
LOCAL_WORDS = 1 << 17
#: Words whose ids a worker remembers, the broadcast ones among them, and ids of theirs; beyond either it forgets the less used.
CACHED_WORDS, CACHED_IDS = 1 << 19, 1 << 22
PLACES = 1 << 20
_L, _N, _O, _S, _UNKNOWN = 0, 1, 2, 3, 255


def _byte_of_char() -> dict[str, int]:
    """The published byte-to-character alphabet of byte-level BPE: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces:
    """The bytes of each id, as one array with offsets."""

    def __init__(self, spec: dict):
        alphabet = _byte_of_char()
        pieces = {i: bytes(alphabet[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        # The decoder maps a special token's characters too; other characters stand for their UTF-8.
        for t in spec.get("added_tokens", ()):
            pieces[t["id"]] = b"".join(bytes([alphabet[c]]) if c in alphabet else c.encode() for c in t["content"])
        size = max(pieces, default=-1) + 1
        self.lengths = np.zeros(size, np.int64)
        for i, piece in pieces.items():
            self.lengths[i] = len(piece)
        self.at = np.concatenate(([0], np.cumsum(self.lengths)[:-1])) if size else np.zeros(0, np.int64)
        self.data = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(size)), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The joined bytes of all ids, and the end of each id's bytes."""
        return gather(self.data, self.at, self.lengths, ids)


def gather(data: np.ndarray, at: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``data[at[w] : at[w] + lengths[w]]`` for each w of ``which``, joined; and where each ends."""
    n = lengths[which]
    ends = np.cumsum(n)
    if not len(ends):
        return data[:0], ends
    index = np.repeat(at[which] - (ends - n), n)
    index += np.arange(len(index))
    return data[index], ends


def splits_here(spec: dict) -> bool:
    """Whether a tokenizer file is plain byte-level BPE, whose words this module splits itself."""
    before, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    return spec.get("normalizer") is None and spec.get("post_processor") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)


class Encoder:
    """A tokenizer file's encoding with the distinct-word table of one worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pieces = Pieces(spec)
        #: Whether words can be split here; if not, the library encodes whole documents.
        self.splits = splits_here(spec)
        added = spec.get("added_tokens", [])
        self.special = {t["content"].encode(): t["id"] for t in added}
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self.base: Table | None = None
        self.reset()

    def use(self, base: Table | None) -> None:
        """Take the ids of frequent words from a broadcast table."""
        if base is not self.base:
            self.base = base
            self.reset()

    def reset(self) -> None:
        #: An open-addressing table: hashes, and the slot of each (-1: free).
        self.seen = np.zeros(PLACES, np.uint64)
        self.seen_slot = np.full(PLACES, -1, np.int32)
        self.ids = np.zeros(0, np.uint32)
        #: By slot: where the word's ids begin, how many there are, and how often it was met of late.
        self.at, self.lengths, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.used = self.n = self.fixed = 0
        if self.base is not None:
            self._add(self.base.hashes, self.base.lengths, self.base.ids)
            self.fixed = self.n

    def _class(self, point: int) -> int:
        """The class of a character, asked of the library's own splitter."""
        if 0xD800 <= point < 0xE000:
            return _O
        split, c = self.tokenizer.pre_tokenizer.pre_tokenize_str, chr(point)
        return next((k for k, probe in ((_L, "a"), (_N, "1"), (_O, "!")) if len(split(probe + c)) == 1), _S)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words in bytes, and the first word of each row."""
        raw = data.tobytes()
        cuts, inside = [offsets], []
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right"))
                if at + len(s) <= offsets[row]:
                    inside.append((at, at + len(s)))
                    at = raw.find(s, at + len(s))
                else:
                    at = raw.find(s, at + 1)
        if inside:
            cuts.append(np.array(inside, np.int64).ravel())
        cuts = np.unique(np.concatenate(cuts))
        lead = None if raw.isascii() else np.flatnonzero((data & 0xC0) != 0x80)
        points = data if lead is None else np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        if (kind == _UNKNOWN).any():
            for p in np.unique(points[kind == _UNKNOWN]).tolist():
                self.classes[p] = self._class(p)
            kind = self.classes[points]
        n = len(points)
        edges = cuts if lead is None else np.searchsorted(lead, cuts)
        cut = np.zeros(n + 1, bool)
        cut[edges] = True
        cut[n] = True
        run = cut[:-1].copy()
        run[1:] |= kind[1:] != kind[:-1]
        ends_run = np.ones(n, bool)
        ends_run[:-1] = run[1:]
        space = kind == _S
        # The last space of a run goes with, or stands alone before, what follows it in the same text.
        start = run | (space & ends_run & ~cut[1:])
        joined = np.zeros(n, bool)
        joined[1:] = run[1:] & ~space[1:] & (points[:-1] == 32) & ~cut[1:-1]
        start &= ~joined
        self._contractions(points, kind, run, ends_run, joined, cut, start)
        starts = np.flatnonzero(start)
        if lead is not None:
            starts = lead[starts]
        for a, b in inside:
            starts = starts[(starts <= a) | (starts >= b)]
        return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)

    @staticmethod
    def _contractions(points, kind, run, ends_run, joined, cut, start) -> None:
        """An apostrophe that begins a word takes s, t, m, d, re, ve or ll with it."""
        n = len(points)
        for p in np.flatnonzero((points == 39) & run & ends_run & ~joined).tolist():
            if p + 1 >= n or cut[p + 1]:
                continue
            one = chr(points[p + 1])
            two = one + chr(points[p + 2]) if p + 2 < n and not cut[p + 2] else ""
            took = 1 if one in "stmd" else 2 if two in ("re", "ve", "ll") else 0
            if took:
                start[p + 1] = False
                after = p + 1 + took
                if after < n and not cut[after] and kind[after] == _L:
                    start[after] = True

    def slots_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of every word; new words are encoded."""
        if self.n > self.fixed and (self.n > CACHED_WORDS or self.used > CACHED_IDS):
            self._forget()
        hashes = span_hashes(data, starts, ends)
        found = self._find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, first, inverse = np.unique(hashes[new], return_index=True, return_inverse=True)
            raw, at = data.tobytes(), new[first]
            ids = self.encode_words([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            found[new] = self._add(distinct, lengths, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())))[inverse.ravel()]
        self.uses[: self.n] += np.bincount(found, minlength=self.n)
        return found

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of every hash, -1 where it is not in the table."""
        mask = len(self.seen) - 1
        places = (hashes & np.uint64(mask)).astype(np.int64)
        slots = self.seen_slot[places]
        found = np.where(self.seen[places] == hashes, slots, -1).astype(np.int64)
        rest = np.flatnonzero((found < 0) & (slots >= 0))
        while len(rest):
            at = places[rest] = (places[rest] + 1) & mask
            slots = self.seen_slot[at]
            hit = self.seen[at] == hashes[rest]
            found[rest] = np.where(hit, slots, -1)
            rest = rest[~hit & (slots >= 0)]
        return found

    def _place(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        """Put distinct hashes that are not in the table into it."""
        mask = len(self.seen) - 1
        places, rest = (hashes & np.uint64(mask)).astype(np.int64), np.arange(len(hashes))
        while len(rest):
            at = places[rest]
            free = self.seen_slot[at] < 0
            self.seen_slot[at[free]] = slots[rest[free]]
            won = self.seen_slot[at] == slots[rest]
            self.seen[at[won]] = hashes[rest[won]]
            rest = rest[~won]
            places[rest] = (places[rest] + 1) & mask

    def _hashes(self) -> np.ndarray:
        """The hash of every slot's word."""
        out, taken = np.zeros(self.n, np.uint64), self.seen_slot >= 0
        out[self.seen_slot[taken]] = self.seen[taken]
        return out

    def _forget(self) -> None:
        """Of the words that are not broadcast, keep those met most often, up to half the room; their counts age."""
        order = self.fixed + np.argsort(-self.uses[self.fixed : self.n], kind="stable")
        order = order[self.lengths[order] <= WORD_BYTES]
        order = order[np.cumsum(self.lengths[order]) <= CACHED_IDS // 2][: max(0, CACHED_WORDS - self.fixed) // 2]
        keep = np.sort(order)
        hashes, lengths, uses = self._hashes()[keep], self.lengths[keep], self.uses[keep]
        ids, _ = gather(self.ids, self.at, self.lengths, keep)
        self.reset()
        slots = self._add(hashes, lengths, ids)
        self.uses[slots] = uses // 2

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct words, each encoded once.

        A word that begins with a space and goes on with another character splits off from the one
        before it, so many such words are encoded as one text and cut again by their lengths.
        """
        out: list[list[int] | None] = [[self.special[w]] if w in self.special else None for w in words]
        texts = [w.decode("utf-8") for w in words]
        chained = [i for i, t in enumerate(texts) if out[i] is None and len(t) > 1 and t[0] == " " and not t[1].isspace()]
        chunks = [chained[i : i + 256] for i in range(0, len(chained), 256)]
        for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast(["".join(texts[i] for i in c) for c in chunks], add_special_tokens=False), strict=True):
            ids = e.ids
            ends = np.cumsum(self.pieces.lengths[ids])
            wanted = np.cumsum([len(words[i]) for i in chunk])
            at = np.searchsorted(ends, wanted)
            if len(ends) and at[-1] < len(ends) and np.array_equal(ends[at], wanted):
                begin = 0
                for i, end in zip(chunk, (at + 1).tolist(), strict=True):
                    out[i] = ids[begin:end]
                    begin = end
        alone = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Slots of new words, given their distinct hashes and their ids, joined."""
        n, used = self.n + len(hashes), self.used + len(ids)
        if used > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(max(self.used, len(ids)), np.uint32)))
        if n > len(self.at):
            more = max(self.n, len(hashes))
            self.at, self.lengths, self.uses = (np.concatenate((x[: self.n], np.zeros(more, x.dtype))) for x in (self.at, self.lengths, self.uses))
        if 4 * n > 3 * len(self.seen):
            old, size = self._hashes(), 1 << (2 * n - 1).bit_length()
            self.seen, self.seen_slot = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
            self._place(old, np.arange(self.n))
        new = np.arange(self.n, n)
        self.ids[self.used : used] = ids
        self.at[new] = self.used + np.cumsum(lengths) - lengths
        self.lengths[new] = lengths
        self._place(hashes, new)
        self.n, self.used = n, used
        return new

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows and their row ends, then the decoded bytes and their row ends."""
        if not self.splits:
            return self._whole(data, offsets)
        starts, ends, first = self.words(data, offsets)
        slots = self.slots_of(data, starts, ends)
        ids, word_ends = gather(self.ids, self.at, self.lengths, slots)
        bounds = np.concatenate(([0], word_ends))[first]
        text, piece_ends = self.pieces.decode(ids)
        if len(text) == len(data) and np.array_equal(text, data):
            return ids, bounds, text, offsets
        return self._whole(data, offsets)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.uint32)
        decoded = [self.tokenizer.decode(x.tolist(), skip_special_tokens=False).encode() for x in ids]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in decoded]))).astype(np.int64)
        return flat, bounds, np.frombuffer(b"".join(decoded), np.uint8), ends


class Table:
    """Ids of words, by the ascending hashes of the words."""

    def __init__(self, words: list[bytes], ids: list[bytes]):
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate((np.zeros(min(1, len(ends)), np.int64), ends[:-1]))
        hashes = span_hashes(data, starts, ends)
        self.hashes, order = np.unique(hashes, return_index=True)
        self.lengths = np.array([len(ids[i]) // 4 for i in order.tolist()], np.int64)
        self.ids = np.frombuffer(b"".join(ids[i] for i in order.tolist()), "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str, base: Table | None = None) -> Encoder:
    """The worker's encoder, which lives as long as the Python worker does."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].use(base)
    return _encoders[path]


def word_table(docs: DataFrame, path: str) -> DataFrame:
    """(word, n, ids): every distinct word of ``docs`` (one text column), how often it occurs, and its ids (little-endian uint32)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        words: dict[int, bytes] = {}
        counts: dict[int, int] = {}

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(words.values()), pa.binary()), pa.array([counts[h] for h in words], pa.int64())], names=["word", "n"])
            words.clear()
            counts.clear()
            return out

        for batch in batches:
            batch = batch.set_column(0, "text", valid_utf8(batch.column(0)))
            for a, b in blocks(batch, 0):
                data, offsets = text_bytes(batch.column(0).slice(a, b - a))
                starts, ends, _ = coder.words(data, offsets)
                hashes, first, n = np.unique(span_hashes(data, starts, ends), return_index=True, return_counts=True)
                raw, keys = data.tobytes(), hashes.tolist()
                for h, k in zip(keys, n.tolist(), strict=True):
                    counts[h] = counts.get(h, 0) + k
                new = [i for i, h in enumerate(keys) if h not in words]
                for i, x, y in zip(new, starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True):
                    words[keys[i]] = raw[x:y]
                if len(words) > LOCAL_WORDS:
                    yield counted()
        yield counted()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            ids = coder.encode_words(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary())], names=["word", "n", "ids"])

    counted = docs.mapInArrow(split, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(encode, "word binary, n long, ids binary")


def frequent(docs: DataFrame, path: str) -> Table:
    """The most frequent words of ``docs`` (one text column), from the stored table of all distinct words.

    They are all words above a count, found from a histogram of counts: so no task sends words that are not among them.
    """
    table = stored(word_table(docs, path)).filter(F.octet_length("word") <= WORD_BYTES).withColumn("level", F.floor(F.log2("n") * 16))
    room, least = TABLE_WORDS, None
    for r in table.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():  # 16 levels for each power of two
        room -= r["words"]
        if room < 0:
            break
        least = r["level"]
    top = table.filter(F.lit(False) if least is None else F.col("level") >= least).select("word", "ids").toArrow()  # TABLE_WORDS at most
    return Table(top["word"].to_pylist(), top["ids"].to_pylist())


def valid_utf8(column: pa.Array) -> pa.Array:
    """The column with ill-formed bytes read as U+FFFD, and null as empty."""
    data, offsets = text_bytes(column)
    try:
        data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
    return column


def encoded_blocks(batch: pa.RecordBatch, column: int, coder: Encoder) -> Iterator[tuple[int, int, tuple]]:
    """Row range and ``Encoder.encode`` of each block of a batch."""
    batch = batch.set_column(column, "text", valid_utf8(batch.column(column)))
    for a, b in blocks(batch, column):
        yield a, b, coder.encode(*text_bytes(batch.column(column).slice(a, b - a)))


def shared_table(docs: DataFrame, path: str) -> Broadcast | None:
    """The frequent words of ``docs``, broadcast; none where words cannot be split here and the library encodes whole documents."""
    with open(path, encoding="utf-8") as f:
        if not splits_here(json.load(f)):
            return None
    return docs.sparkSession.sparkContext.broadcast(frequent(docs, path))  # at most TABLE_WORDS words of WORD_BYTES bytes


def codec(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode every row: key, n_tokens, token_ids (little-endian uint32 binary), decoded.

    Null and empty texts have no tokens and decode to an empty text. The added token's string in a
    text is that token, as in the library. Rows are independent: keys may be null or repeated. Other columns are
    ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    path = environment_path(tokenizer)
    base = shared_table(docs.select(F.col(text).alias("text")), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, base and base.value)
        for batch in batches:
            for a, b, (ids, bounds, decoded, ends) in encoded_blocks(batch, 1, coder):
                flat = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(bounds)),
                        pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(flat)]),
                        pa.StringArray.from_buffers(b - a, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(decoded.tobytes())),
                    ],
                    names=["key", "n_tokens", "token_ids", "decoded"],
                )

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, token_ids binary, decoded string").withColumnRenamed("key", key)


def append_codes(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text") -> DataFrame:
    """Every row with n_tokens and token_ids beside its own columns; columns of those names are replaced.

    Null and empty texts have no tokens; repeated rows are each encoded.
    """
    ship(docs.sparkSession)
    docs = docs.drop("n_tokens", "token_ids")
    path, column = environment_path(tokenizer), docs.columns.index(text)
    base = shared_table(docs.select(F.col(text).alias("text")), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, base and base.value)
        for batch in batches:
            for a, b, (ids, bounds, _, _) in encoded_blocks(batch, column, coder):
                part = batch.slice(a, b - a)
                binary = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(bounds)), binary], names=[*part.schema.names, "n_tokens", "token_ids"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]))
