"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words too common to search by.
STOP_WORDS = "a an and are as at be by for from how in is it of on or that the this to was what when where which who with".split()
WORD = r"[\p{L}\p{N}]+"
JOINED_WORD = r"[\p{L}\p{N}]+(?:[._/-][\p{L}\p{N}]+)*"
NUMBER = r"\b\d{3,8}\b"
CODE = r"\b\d{1,5}/[A-Z][A-Z0-9-]*\b"
DATE = r"\b\d{1,2}/\d{1,2}/\d{4}\b"
CAPITALISED_RUN = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+"


def collapse(text: Column) -> Column:
    """Lower case, runs of white space as one blank, no blank at either end."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _mark_tables() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their bases, from Unicode's decompositions; combining marks follow, without a base."""
    import unicodedata

    marked, bases = [], []
    for point in (*range(0xDF, 0x250), *range(0x1E00, 0x1F00)):
        rest = [c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn"]
        if rest != [chr(point)] and len(rest) == 1 and chr(point).islower():
            marked.append(chr(point))
            bases += rest
    marked += [chr(x) for x in range(0x300, 0x370) if unicodedata.category(chr(x)) == "Mn"]
    return "".join(marked), "".join(bases)


MARKED, BASES = _mark_tables()


def fold(text: Column, keep_stroke: bool = True) -> Column:
    """Lower case without marks, white space collapsed; ``keep_stroke`` leaves the letter d with a stroke."""
    out = F.translate(collapse(text), MARKED, BASES)
    return out if keep_stroke else F.translate(out, "đ", "d")


def tokens(text: Column, pattern: str = WORD) -> Column:
    """Lower-case matches of ``pattern`` in order, repeats included; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Distinct ASCII tokens of two or more characters that are not stop words."""
    return F.array_distinct(F.filter(tokens(text, "[a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS)))


def sparse_tokens(text: Column) -> Column:
    """Joined identifiers whole, and their components of two or more characters."""
    whole = tokens(text, JOINED_WORD)
    parts = F.flatten(F.transform(F.filter(whole, lambda t: t.rlike(r"[._/-]")), lambda t: F.filter(F.split(t, r"[._/-]"), lambda p: F.length(p) >= 2)))
    return F.concat(whole, parts)


def bucket(token: Column, dimensions: int = 1 << 20) -> Column:
    """A token's place among hashed dimensions: the first 15 hex digits of SHA-256 modulo their number."""
    return F.pmod(F.conv(F.substring(F.sha2(token, 256), 1, 15), 16, 10).cast("long"), F.lit(dimensions))


def preview(text: Column, size: int = 300) -> Column:
    return F.substring(text, 1, size)


def content_hash(text: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def name_uuid(namespace: str, name: Column) -> Column:
    """A version-5 UUID: SHA-1 over the namespace's bytes and the name, version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def coverage(needles: Column, haystack: Column) -> Column:
    """The share of distinct ``needles`` that are in ``haystack``; 0 where there are none."""
    n = F.size(F.array_distinct(needles))
    return F.when(n > 0, F.size(F.array_intersect(needles, haystack)) / n).otherwise(F.lit(0.0))


def hash_embedding(text: Column, blocks: int = 12) -> Column:
    """A deterministic unit vector: bytes of SHA-256 over numbered copies of the text, scaled to [-1, 1]."""
    digests = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.sha2(F.concat(i.cast("string"), F.lit(":"), text), 256))
    byte = lambda h, j: F.conv(F.substring(h, j * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1
    raw = F.flatten(F.transform(digests, lambda h: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: byte(h, j))))
    return F.get(F.transform(F.array(raw), lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)))), F.lit(0))


def rewrite_text(text: Column) -> Column:
    """Lower case without marks (the letter d with a stroke too), everything but a-z, 0-9 and white space as one blank."""
    plain = F.translate(F.translate(F.lower(text), MARKED, BASES), "đ", "d")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s]", " "), r"\s+", " "))


def text_hash(text: Column) -> Column:
    """SHA-256 of the text as it is."""
    return F.sha2(text, 256)


def unique_list(text: Column, pattern: str = r"[,;|]") -> Column:
    """Parts of a separated text, white space collapsed and edge punctuation off, each once in either case, in order."""
    clean = F.filter(F.transform(F.split(text, pattern), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", "")), lambda x: x != "")
    low = F.transform(clean, lambda x: F.lower(x))
    return F.filter(clean, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def path_parts(text: Column) -> Column:
    """A section path, separated by >, as a list."""
    return F.filter(F.transform(F.split(text, ">"), lambda x: F.trim(x)), lambda x: x != "")


def json_object(text: Column) -> Column:
    """A model's reply as JSON text: code fences off, else from the first brace to the last; null unless that is an object."""
    inside = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.json_object_keys(inside).isNotNull(), inside)


def days(text: Column) -> Column:
    """The first whole number of days that a text names."""
    return F.nullif(F.regexp_extract(F.lower(text), r"(\d+)\s*(?:days?|ngày)", 1), F.lit("")).cast("long")


def fields_with(metadata: Column, fragments: list[str]) -> Column:
    """Entries of a map whose key holds one of the fragments."""
    return F.map_filter(metadata, lambda k, v: F.exists(F.array(*map(F.lit, fragments)), lambda f: F.contains(F.lower(k), f)))


def row_range(text: Column) -> Column:
    """STRUCT<first, last>: the least and greatest leading numbers of a text's pipe-table rows."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.startswith(F.trim(x), F.lit("|")))
    first = F.transform(rows, lambda x: F.trim(F.get(F.split(F.regexp_replace(F.trim(x), r"^\|+", ""), r"\|"), F.lit(0))))
    numbers = F.transform(F.filter(first, lambda x: x.rlike(r"^[0-9]{1,9}$")), lambda x: x.cast("long"))
    return F.struct(F.array_min(numbers).alias("first"), F.array_max(numbers).alias("last"))


def clean_answer(text: Column) -> Column:
    """An answer without hidden reasoning (closed, left open, or ended only), bare source headings and spare blank lines."""
    out = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)<think>.*$", ""), r"(?is)^.*?</think>", "")
    out = F.regexp_replace(out, r"(?im)^\s*(?:supporting text|sources?|references?)\s*:\s*$", "")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def fake_answer(prompt: Column) -> Column:
    """A deterministic answer to a prompt: its question and its first three citation markers."""
    question = F.trim(F.regexp_replace(F.regexp_extract(prompt, r"(?s)Question:\s*(.*?)\n\nContext:", 1), r"\s+", " "))
    marks = F.slice(F.regexp_extract_all(prompt, F.lit(r"(?m)^\[(\d+)\]\s+"), F.lit(1)), 1, 3)
    cited = F.array_join(F.transform(marks, lambda m: F.concat(F.lit("["), m, F.lit("]"))), " ")
    return F.concat(F.lit("Generated from provided context. Question: "), F.when(question == "", "unknown").otherwise(question), F.lit(". Relevant citations: "), F.when(cited == "", "[no context]").otherwise(cited))
