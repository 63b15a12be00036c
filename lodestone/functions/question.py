"""What a question asks for: kinds, follow-ups, identifiers, exact terms. Columns for batches, plain functions for one query."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import enrich
from . import text as T

# The terms of each kind of question, compared without marks; those of three letters or fewer as whole words.
EXACT_LOOKUP = ("ma", "so hieu", "dinh nghia", "la gi", "what is", "definition")
OVERVIEW = ("tong quan", "khung", "cau truc", "cau thanh", "overview", "structure", "framework")
COUNT_LIST = ("co may", "bao nhieu", "so luong", "gom", "bao gom", "danh sach", "liet ke", "nhung phan nao", "cac loai", "how many", "list", "include")
TABLE_DETAIL = ("bang", "dong", "cot", "truong", "thuoc tinh", "table", "row", "column", "field", "attribute")
COMPARISON = ("so sanh", "khac nhau", "giong nhau", "compare", "difference")
PROCEDURE = ("quy trinh", "cac buoc", "thu tuc", "procedure", "steps", "workflow")
CALCULATION = ("tinh", "tong", "ti le", "phan tram", "calculate", "sum", "average")
MULTI_HOP = ("moi quan he", "lien quan", "giua", "nhieu phan", "nhieu muc", "multi hop", "relationship")
DOCUMENT_CODE = r"(?i)\b\d{1,6}\s*/\s*[A-ZĐ0-9][A-ZĐ0-9_\-/]{1,}\b"
#: Phrases that refer to what was said before, in English and in Vietnamese without marks.
FOLLOW_UP = (
    "van ban nay", "tai lieu nay", "quyet dinh nay", "thong bao nay", "bao cao nay", "bang nay", "bang do", "dong nay", "dong do", "muc nay", "muc do",
    "nguoi nay", "nguoi do", "nguoi kia", "tac gia nay", "tac gia do", "van ban do", "tai lieu do", "o tren", "ben tren", "truoc do", "vua roi", "cau truoc",
    "ket qua tren", "noi dung tren", "y tren", "cai nay", "cai do", "no", "ho", "nguoi dau tien", "nguoi thu hai", "nguoi cuoi", "cai dau tien", "cai thu hai", "cai cuoi",
    "this document", "that document", "this table", "that table", "this item", "that item", "the above", "previous answer",
)
#: Phrases by which a user asks to be remembered; the first group are instructions.
INSTRUCTIONS, PREFERENCES = ("từ nay", "hãy luôn"), ("nhớ rằng", "tôi thích", "ưu tiên")
#: Question words that are no content.
QUESTION_WORDS = "anh bạn các cho có của đang đây đó được gì hãy hỏi không khi là làm nào này nêu nếu nhé như nói sao theo thì tôi trong và về với xin bao nhiêu mấy".split()
MOST_TERMS = 6


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether a normalised text has a term; one of three letters or fewer only as a whole word."""
    padded, out = F.concat(F.lit(" "), text, F.lit(" ")), F.lit(False)
    for term in terms:
        out = out | (F.contains(padded, F.lit(f" {term} ")) if len(term) <= 3 else F.contains(text, F.lit(term)))
    return out


def strategies(question: Column) -> Column:
    """All kinds of a question, in a fixed order; a question of none is a semantic search."""
    q = F.coalesce(T.fold(question, keep_stroke=False), F.lit(""))
    overview, listing = has_any(q, OVERVIEW), has_any(q, COUNT_LIST)
    kinds = (
        ("exact_lookup", has_any(q, EXACT_LOOKUP) | F.coalesce(question.rlike(DOCUMENT_CODE), F.lit(False))),
        ("overview_summary", overview),
        ("count_list", listing),
        ("table_detail", has_any(q, TABLE_DETAIL)),
        ("comparison", has_any(q, COMPARISON)),
        ("procedure", has_any(q, PROCEDURE)),
        ("calculation", has_any(q, CALCULATION)),
        ("multi_hop", has_any(q, MULTI_HOP) | (overview & listing)),
    )
    found = F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in kinds)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("semantic_search")))


def needs(kinds: Column) -> Column:
    """STRUCT<overview, diversity, second>: what a question's kinds ask of its context."""
    overview = F.arrays_overlap(kinds, F.array(*map(F.lit, ("overview_summary", "count_list", "multi_hop"))))
    return F.struct(overview.alias("overview"), (overview | F.array_contains(kinds, "comparison")).alias("diversity"), overview.alias("second"))


def follows_up(question: Column) -> Column:
    """Whether a question leans on what was said before it."""
    q = F.coalesce(T.rewrite_text(question), F.lit(""))
    phrase = F.exists(F.array(*map(F.lit, FOLLOW_UP)), lambda p: F.contains(q, p))
    short = (F.size(F.split(q, " ")) <= 6) & F.exists(F.array(*map(F.lit, ("sao", "nua", "tiep", "do", "nay"))), lambda p: F.contains(q, p))
    and_also = F.startswith(q, F.lit("con ")) & ~F.startswith(q, F.lit("con nguoi"))
    return (q != "") & (phrase | and_also | q.rlike(r"\b(?:thi sao|nua khong|tiep tuc|ke tiep)\b") | short)


#: Phrases that ask to be remembered, in the order that decides.
ASKS = {p: "instruction" if p in INSTRUCTIONS else "preference" for p in ("nhớ rằng", "từ nay", "tôi thích", "hãy luôn", "ưu tiên")}


def remembered(message: Column, phrases: dict[str, str] = ASKS) -> Column:
    """STRUCT<kind, content> of a message that asks to be remembered, else null; the earliest of the ``phrases`` (to kinds) that it has decides."""
    low, out = F.lower(message), None
    for phrase, name in phrases.items():
        kind = F.lit(name)
        out = F.when(F.contains(low, F.lit(phrase)), kind) if out is None else out.when(F.contains(low, F.lit(phrase)), kind)
    return F.when(out.isNotNull(), F.struct(out.alias("kind"), F.trim(message).alias("content")))


def fold(text: str) -> str:
    """Without marks, the letter d with a stroke as d; case-folded."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return plain.replace("Đ", "D").replace("đ", "d").casefold()


def content_grams(query: str, most: int = MOST_TERMS) -> list[str]:
    """Runs of a query's content words, five words down to two and then single ones, each once, at most ``most``."""
    words = [w for w in re.findall(r"[\wÀ-ỹĐđ]+", query or "") if len(fold(w)) > 1 and fold(w) not in QUESTION_WORDS]
    sizes = [*range(min(5, len(words)), 1, -1), 1]
    out: dict[str, str] = {}
    for n in sizes:
        for i in range(len(words) - n + 1):
            out.setdefault(fold(" ".join(words[i : i + n])), " ".join(words[i : i + n]))
    return list(out.values())[:most]


def exact_terms(query: str, entities: tuple[str, ...] = (), most: int = MOST_TERMS) -> list[str]:
    """Terms to be found literally: content runs, the whole query, quotations, entities and codes, each once in either case."""
    quoted = [t.strip() for pair in re.findall(r"\"([^\"]+)\"|'([^']+)'", query) for t in pair if t.strip()]
    codes = re.findall(r"\b[A-Z0-9][A-Z0-9._/-]{1,}\b", query)
    out: dict[str, str] = {}
    for term in (*content_grams(query), query.strip(), *quoted, *entities, *codes):
        clean = " ".join(term.split()).strip(" ?!.,;:")
        if len(clean) >= 2:
            out.setdefault(clean.lower(), clean)
    return list(out.values())[:most]


def identifiers(query: str) -> list[str]:
    """Codes and numbers that a query looks up, each once."""
    clean = " ".join((query or "").split()).strip(" ?!.,;:")
    found = [clean] if re.fullmatch(r"[0-9]{2,8}", clean) or re.fullmatch(r"(?i)[A-Z0-9][A-Z0-9._/-]{1,40}", clean) else []
    found += re.findall(r"(?i)\b[0-9]{3,8}(?:/[A-Z0-9._/-]+)?\b", clean)
    out: dict[str, str] = {}
    for f in found:
        out.setdefault(f.casefold(), f)
    return list(out.values())


def embedding_text(query: str) -> str:
    """What is embedded for a query: a lookup of a code is spelled out, anything else stays as it is."""
    clean = " ".join((query or "").split())
    if clean and (re.search(r"(?i)\b\d{2,6}\s*/\s*[A-ZĐ0-9][A-ZĐ0-9\-_/]{2,}\b", clean) or re.fullmatch(r"\d{2,8}", clean)):
        return "\n".join((f"Mã tra cứu / số hiệu văn bản: {clean}", f"Identifier exact lookup: {clean}", clean))
    return clean


# Words by which a question's intent and the shape of its answer are told, without marks, and the artifacts each intent prefers.
PERSON_WORDS = "who|person|people|staff|assignee|owner|participant|phong|phong ban|don vi|mang|nhiem vu|tham gia"
PROCEDURE_WORDS = "procedure|process|workflow|step|steps|application|dossier|fee|deadline|result|agency|thu tuc|ho so|le phi|thoi han|ket qua|co quan"
POLICY_WORDS = "policy|rule|condition|benefit|entitlement|obligation|exception|amount|days|salary|allowance|quyen loi|nghia vu|dieu kien|muc huong|so ngay|nghi|luong"
TABLE_WORDS = "table|row|column|list|total|matrix|bang|dong|cot|danh sach|liet ke|tong"
TABLE_OUTPUT = "table|matrix|bang|danh sach|liet ke|list|all rows"
REPORT_OUTPUT = "summary|summarize|report|overview|tong hop|tom tat|bao cao"
CONTRACT_CODES = (r"[0-9]{3,8}(?:/[A-Z0-9._/-]+)?", r"[A-Z]{1,12}[0-9]{1,8}[A-Z0-9._/-]*")
PREFERRED = {
    "identifier_lookup": ("identifier_lookup", "document_profile"),
    "person_assignment": ("person_assignment_artifact", "table_row_artifact"),
    "procedure_lookup": ("procedure_artifact", "table_row_artifact", "document_profile"),
    "policy_rule_lookup": ("policy_rule_artifact", "table_row_artifact"),
    "table_lookup": ("table_row_artifact", "person_assignment_artifact", "policy_rule_artifact", "procedure_artifact"),
    "general_summary": ("document_profile", "policy_rule_artifact", "procedure_artifact", "table_row_artifact"),
}


def contract(question: Column) -> Column:
    """STRUCT<intent, shape, exact_terms, artifact_types>: what a question asks for, how it is answered, the codes it names, and the
    kinds of artifacts to be tried first. Null is a question without words."""
    q = F.coalesce(T.fold(question), F.lit(""))
    n_words = F.size(F.filter(F.split(q, " "), lambda w: w != ""))
    has = lambda words: q.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])")
    codes = F.concat(*(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}_]){p}"), F.lit(0)) for p in CONTRACT_CODES))
    terms = F.slice(enrich.unique(F.filter(F.transform(codes, lambda c: F.regexp_replace(c, r"[.,;:!? ]+$", "")), lambda c: F.length(c) >= 2)), 1, 8)
    intent = F.when((F.size(terms) > 0) & (n_words <= 8), "identifier_lookup").when(has(PERSON_WORDS) & (n_words >= 3), "person_assignment")
    intent = intent.when(has(PROCEDURE_WORDS), "procedure_lookup").when(has(POLICY_WORDS), "policy_rule_lookup").when(has(TABLE_WORDS), "table_lookup").otherwise("general_summary")
    shape = F.when(has(TABLE_OUTPUT) | intent.isin("person_assignment", "table_lookup"), "table").when(has(REPORT_OUTPUT), "report").otherwise("short_fact")
    kinds = None
    for name, types in PREFERRED.items():
        value = F.array(*map(F.lit, types))
        kinds = F.when(intent == name, value) if kinds is None else kinds.when(intent == name, value)
    return F.struct(intent.alias("intent"), shape.alias("shape"), terms.alias("exact_terms"), kinds.alias("artifact_types"))
