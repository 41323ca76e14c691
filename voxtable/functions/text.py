"""Text functions. Unicode normal forms and case folding are the only Python; the rest is Catalyst."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that count as punctuation when transcripts are compared.
COMPARE_PUNCTUATION = "，。！？；：、（）【】《》〈〉…—－,.!?;:()[]{}<>\"'`~–-"
# Marks that end a sentence, and marks that end a clause.
SENTENCE_END = "。！？!?…;；"
CLAUSE_END = "，,、：:"
# Marks at which a transcript line is cut into sentences.
SENTENCE_CUT = "。！？!?；;"
# Marks a translated line may end with.
TERMINAL_MARKS = (".", "!", "?", "…", "。", "！", "？")
# Characters of a line that is only an exclamation.
NONVERBAL_CHARS = "啊呃嗯哎哈呵！？!?,，。 "

_SPACE = r"(?U)[\s\x1c-\x1f]+"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else t.casefold())


@F.pandas_udf(T.StringType())
def text_units(text: pd.Series) -> pd.Series:
    """Case-folded letters and digits only: what an alignment has to cover."""
    return text.map(lambda t: t if t is None else "".join(c for c in t if c.isalnum()).casefold())


@F.pandas_udf(T.BooleanType())
def same_units(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether two texts have the same case-folded letters and digits."""
    fold = lambda t: "".join(c for c in t or "" if c.isalnum()).casefold()
    return pd.Series([fold(a) == fold(b) for a, b in zip(left, right)], dtype="bool")


_BLANKED = str.maketrans(COMPARE_PUNCTUATION, " " * len(COMPARE_PUNCTUATION))


def compare_form(text: str | None) -> str:
    """Python twin of :func:`normalize_chinese` for tokens inside a vectorized function."""
    return "".join(unicodedata.normalize("NFC", text or "").translate(_BLANKED).split())


def squeeze_space(col: Column, to: str) -> Column:
    return F.regexp_replace(col, _SPACE, to)


def strip(col: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalize_chinese(col: Column, *, punctuation: bool = True, ignore_spaces: bool = True) -> Column:
    """NFC, punctuation to blanks, then white space dropped or squeezed."""
    out = nfc(col)
    if punctuation:
        out = F.translate(out, COMPARE_PUNCTUATION, " " * len(COMPARE_PUNCTUATION))
    return squeeze_space(out, "") if ignore_spaces else strip(squeeze_space(out, " "))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate of normalized text; null for an empty reference, may exceed 1."""
    size = F.char_length(reference)
    return F.when(size > 0, F.levenshtein(reference, hypothesis) / size)


def context_key(col: Column) -> Column:
    return strip(squeeze_space(nfkc(col), " "))


def context_hash(series: Column, source: Column, nearby: Column, version: Column) -> Column:
    """Translation-memory key. ``source`` and ``nearby`` are already passed through context_key."""
    doc = F.struct(
        version.alias("glossary_version"), nearby.alias("nearby_context"),
        series.alias("series_id"), source.alias("source"),
    )
    return F.sha2(F.to_json(doc, {"ignoreNullFields": "false"}), 256)


def timestamp(ms: Column) -> Column:
    """``HH:MM:SS,mmm``."""
    whole = lambda unit: F.floor(ms / unit)
    return F.format_string(
        "%02d:%02d:%02d,%03d", whole(3_600_000), whole(60_000) % 60, whole(1000) % 60, ms % 1000
    )


def has_any(col: Column, marks: str) -> Column:
    return F.translate(col, marks, "") != col


def ends_sentence(col: Column) -> Column:
    return has_any(col, SENTENCE_END)


def ends_clause(col: Column) -> Column:
    return has_any(col, CLAUSE_END)


def has_punctuation(col: Column) -> Column:
    return col.rlike(r"[\p{P}\p{S}]")


def nonverbal(col: Column) -> Column:
    return (F.char_length(col) > 0) & (F.char_length(F.translate(col, NONVERBAL_CHARS, "")) == 0)


def with_terminal(col: Column, mark: Column) -> Column:
    """Append the mark to non-empty text that does not already end with one."""
    last = F.substring(col, -1, 1)
    needs = (F.char_length(col) > 0) & (F.char_length(mark) > 0) & ~last.isin(*TERMINAL_MARKS)
    return F.when(needs, F.concat(col, mark)).otherwise(col)


def repaired_mark(mark: Column) -> Column:
    """Keep a known mark, read three dots as an ellipsis, and drop anything else."""
    known = mark.isin("", *TERMINAL_MARKS)
    return F.when(known, mark).when(F.trim(mark) == "...", "…").otherwise("")


def word_budget(duration_ms: Column) -> Column:
    """Words that fit a slot at 5.5 words per second, half-even rounding, at least 2."""
    return F.greatest(F.lit(2), F.bround(duration_ms / 1000 * 5.5)).cast("long")


def segment_id(start_ms: Column, number: Column) -> Column:
    return F.format_string("seg_%012d_%04d", start_ms, number)


def cue_text(col: Column) -> Column:
    """Subtitle text without control characters, override braces or markup; blank lines dropped."""
    lines = F.split(F.replace(strip(col), F.lit("\r"), F.lit("")), "\n")
    clean = F.transform(lines, lambda x: _escaped(strip(F.regexp_replace(x, r"[\x00-\x1f\x7f-\x9f]", " "))))
    return F.array_join(F.filter(clean, lambda x: F.char_length(x) > 0), "\n")


def _escaped(col: Column) -> Column:
    for old, new in (("{", "｛"), ("}", "｝"), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def strict_object(json: Column, fields: dict[str, str]) -> Column:
    """True when the JSON text is an object with exactly these fields and types (variant type names)."""
    shape = ", ".join(f"{k}: {v}" for k, v in sorted(fields.items()))
    return F.coalesce(F.schema_of_variant(F.try_parse_json(json)) == f"OBJECT<{shape}>", F.lit(False))


def job_slug(case_id: Column) -> Column:
    """Lower-case file-safe form of a case id, at most 48 characters."""
    edge = r"^[-._]+|[-._]+$"
    slug = F.lower(F.regexp_replace(F.regexp_replace(strip(case_id), r"[^A-Za-z0-9._-]+", "-"), edge, ""))
    slug = F.when(slug == "", "case").otherwise(slug)
    cut = F.regexp_replace(F.substring(slug, 1, 48), r"[-._]+$", "")
    return F.when(cut == "", "case").otherwise(cut)
