"""Tokenizers, normalizers and splitters as Columns. All stay in the JVM.

Patterns name letters and digits by Unicode property, so that Spark, Python and other engines cut alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the lexical judges, of BM25 over questions, of answer metrics, and of cache keys.
STOP_JUDGE = "the is a an of to and in with for at on was were it its by as that this are be or not no yes within about".split()
STOP_QUERY = "how do i get my the a to your of and for on at is in you".split()
STOP_METRIC = "the is a an of to and in with for at on was were it its by as that this".split()
STOP_CACHE = "what whats is the of a an to and in on for with s was are did do does me my".split()
FILLERS = ("you know", "i mean", "sort of", "kind of", "um", "uh", "erm", "hmm", "like", "basically")
BLANK = r"[\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def tokenize_alnum(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def tokenize_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def tokenize_stopwords(text: Column, stop=STOP_QUERY) -> Column:
    return F.filter(tokenize_words(text), lambda w: ~w.isin(list(stop)))


def tokenize_blank(text: Column, lower: bool = True) -> Column:
    """Runs of non-blank characters."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def tokenize_ascii(text: Column, longer_than: int = 0) -> Column:
    """Distinct lower-cased runs of a-z and 0-9 that are longer than a bound."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))
    return F.filter(found, lambda w: F.length(w) > longer_than) if longer_than else found


def _stripped(word: Column, marks: str) -> Column:
    group = "".join("\\" + c for c in marks)
    return F.regexp_replace(word, f"^[{group}]+|[{group}]+$", "")


def content_words(text: Column) -> Column:
    """Distinct words without outer punctuation, stop words and single characters."""
    words = F.transform(tokenize_blank(text, lower=False), lambda w: _stripped(w, ".,()$[]'\""))
    words = F.filter(words, lambda w: (F.length(w) > 1) & ~F.lower(w).isin(STOP_JUDGE))
    return F.array_distinct(F.transform(words, F.lower))


def metric_tokens(text: Column, stop=STOP_METRIC, marks: str = ".,()$") -> Column:
    """Distinct words for answer metrics: stop words go before outer punctuation does."""
    words = F.filter(tokenize_blank(text, lower=False), lambda w: ~F.lower(w).isin(list(stop)))
    words = F.filter(F.transform(words, lambda w: F.lower(_stripped(w, marks))), lambda w: w != "")
    return F.array_distinct(words)


def squeeze(text: Column) -> Column:
    """One space for each run of blanks, trimmed."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def snake_case(name: Column) -> Column:
    name = F.regexp_replace(name, r"[^\p{L}\p{N}_\x20\x09-\x0D]", " ")
    name = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, f"{BLANK}+", " "))), " ", "_")


UNIT = r"^(.*?)[\x20\x09-\x0D]*[(\[]([^)\]]+)[)\]][\x20\x09-\x0D]*$"


def unit_of(name: Column) -> tuple[Column, Column]:
    """Base name and unit of 'name (unit)' or 'name [unit]'; the unit is null where there is none."""
    unit = F.trim(F.regexp_extract(name, UNIT, 2))
    has = name.rlike(UNIT)
    return F.when(has, F.trim(F.regexp_extract(name, UNIT, 1))).otherwise(name), F.when(has, unit)


def line_signature(line: Column) -> Column:
    """Trimmed, lower-cased, digit runs as #, blanks squeezed."""
    return squeeze(F.regexp_replace(F.lower(line), "[0-9]+", "#"))


def normal_subject(subject: Column) -> Column:
    """Without reply marks and bracketed tags."""
    bare = F.regexp_replace(subject, r"(?i)^(\s*(re|fwd|fw)\s*:\s*)+", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\[.*?\]", "")))


def mark_inaudible(text: Column) -> tuple[Column, Column]:
    """Text with one form of the inaudible mark and without overlap marks; and the count of the former."""
    marked = F.regexp_replace(text, r"(?i)\[inaudible\]", " <INAUDIBLE> ")
    return squeeze(F.regexp_replace(marked, r"(?i)\[overlap\]", " ")), F.regexp_count(text, F.lit(r"(?i)\[inaudible\]"))


def strip_fillers(text: Column, fillers=FILLERS) -> Column:
    """Filler words go, longer ones first."""
    for filler in sorted(fillers, key=lambda f: -len(f.split())):
        text = F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_]){filler}(?![\p{{L}}\p{{N}}_])", " ")
    return squeeze(text)


def atomic_claims(answer: Column) -> Column:
    """Parts between full stops or semicolons before blanks, longer than three characters."""
    parts = F.transform(F.split(F.trim(answer), r"[.;][\x20\x09-\x0D]+"), lambda p: F.regexp_replace(p, f"^{BLANK}+|{BLANK}+$", ""))
    return F.filter(parts, lambda p: F.length(p) > 3)


def sentences(text: Column) -> Column:
    """Split after . or ; before blanks and an ASCII capital."""
    parts = F.transform(F.split(text, r"(?<=[.;])[\x20\x09-\x0D]+(?=[A-Z])"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


# Fixed value: what a number may carry.
_NUMBER_MARKS = r"(?i)[,\x20\x09-\x0D₹$€£]|inr|usd|rs\.?"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def bare_number(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, _NUMBER_MARKS, ""), "%", ""))


def looks_numeric(text: Column) -> Column:
    return bare_number(text).rlike(_NUMBER)


def coerce_number(text: Column) -> Column:
    """The number in a cell; a percent sign at the end divides by 100; null where there is none."""
    value = F.when(looks_numeric(text), bare_number(text)).try_cast("double")
    return F.when(F.trim(text).endswith("%"), value / 100.0).otherwise(value)


# Fixed value: cells that mean nothing.
SENTINELS = ("", "n/a", "na", "-", "--", "tbd", "none", "null", "nan", "#n/a")


def is_sentinel(cell: Column) -> Column:
    return cell.isNull() | F.lower(F.trim(cell)).isin(*SENTINELS)


def scripts(text: Column) -> Column:
    """Which of Devanagari and Latin (ASCII) letters a text has, sorted, and Other for further letters."""
    other = text.rlike(r"[\p{L}&&[^\x00-\x7Fऀ-ॿ]]")
    found = F.array(
        F.when(text.rlike(r"[ऀ-ॿ]"), "Devanagari"), F.when(text.rlike("[A-Za-z]"), "Latin"), F.when(other, "Other")
    )
    return F.array_compact(found)


ROMAN_HINDI = "haan theek hai lekin humein phir karni hogi se".split()


def code_switch(text: Column) -> Column:
    """Latin and Devanagari together, or two romanized Hindi words or more."""
    words = F.array_distinct(F.transform(tokenize_blank(text), lambda w: _stripped(w, ".,?!")))
    both = F.array_contains(scripts(text), "Latin") & F.array_contains(scripts(text), "Devanagari")
    return both | (F.size(F.array_intersect(words, strings(ROMAN_HINDI))) >= 2)


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct stretches of k words; one of all words where there are fewer."""

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1)))
        parts = F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(F.size(words) < k, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(parts))

    return let(tokenize_words(text), cut)
