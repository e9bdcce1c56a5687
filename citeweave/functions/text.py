"""Text functions as Columns: normalisation, search terms, labels, and line predicates.

Patterns keep the meaning they have in a browser's regular expressions: white space
includes the Unicode spaces, and word boundaries look at ASCII letters only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels, vocab

SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: The characters of ``SPACE``, of which a text's ends are freed without a pattern that looks at every place.
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
NUMBER = r"\d+(?:[.,]\d+)?"


def words(pattern: str) -> str:
    """The alternatives as whole words, any case."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def leading(pattern: str) -> str:
    """The alternatives as the first whole word, any case."""
    return rf"(?i)\A(?:{pattern})(?![A-Za-z0-9_])"


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def normalize_whitespace(x: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(x, "\r", ""), r"[ \t]+\n", "\n"))


def normalize_query(x: Column) -> Column:
    return trim(F.regexp_replace(F.lower(x), rf"{SPACE}+", " "))


def clean_line(x: Column) -> Column:
    """White space collapsed, case kept."""
    return trim(F.regexp_replace(x, rf"{SPACE}+", " "))


def split_words(x: Column) -> Column:
    """Non-empty words of a text."""
    return F.filter(F.split(x, rf"{SPACE}+"), lambda w: w != "")


def estimate_tokens(x: Column) -> Column:
    n = F.size(F.split(trim(x), rf"{SPACE}+"))
    return F.when(trim(x) == "", F.lit(0)).otherwise(F.ceil(n * F.lit(1.3)).cast("int"))


def search_terms(x: Column) -> Column:
    """Stemmed terms longer than two letters that are no stopwords, in order, repeats kept."""
    return kernels.text_terms(x)


def distinct_nonempty(x: Column) -> Column:
    return F.array_distinct(F.filter(x, lambda s: s.isNotNull() & (s != "")))


def any_of(terms: Column, fixed: tuple[str, ...]) -> Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, fixed)))


def slugify(x: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), r"\A-|-\z", ""), 1, 80)


def sanitize_filename(x: Column) -> Column:
    cleaned = F.regexp_replace(x, "[^a-zA-Z0-9._-]+", "-")
    return F.when(cleaned == "", "document.pdf").otherwise(cleaned)


def vector_literal(x: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(x.cast("array<string>"), ","), F.lit("]"))


def count_matches(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


# Section paths keep null entries for skipped levels: they join as empty and have no terms.


def joined_path(path: Column, by: str = " > ") -> Column:
    return F.array_join(path, by, "")


def section_key(path: Column) -> Column:
    key = joined_path(path)
    return F.when(key == "", "Document").otherwise(key)


def section_prefixed(path: Column, text: Column) -> Column:
    return F.when(F.size(path) == 0, text).otherwise(F.concat(joined_path(path), F.lit("\n"), text))


def haystack(path: Column, text: Column) -> Column:
    return F.lower(F.concat(joined_path(path, " "), F.lit(" "), text))


def searchable_text(path: Column, text: Column) -> Column:
    return trim(F.concat(joined_path(path, " "), F.lit(" "), text))


def clean_body(path: Column, text: Column) -> Column:
    """Lower-case text with white space collapsed, without the section line in front."""
    flat, prefix = normalize_query(text), normalize_query(joined_path(path))
    own = F.when(flat.startswith(prefix), trim(flat.substr(F.length(prefix) + 1, F.length(flat)))).otherwise(flat)
    return F.when(joined_path(path) == "", flat).otherwise(own)


def deepest(path: Column) -> Column:
    return F.coalesce(F.when(F.size(path) > 0, F.element_at(path, -1)), F.lit(""))


def page_label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("Page "), first)).otherwise(F.concat(F.lit("Pages "), first, F.lit("-"), last))


def _lookup(x: Column, table: dict[str, str], default: Column) -> Column:
    return reduce(lambda acc, kv: F.when(x == kv[0], kv[1]).otherwise(acc), table.items(), default)


def chunk_type_label(x: Column) -> Column:
    return _lookup(x, vocab.CHUNK_TYPE_LABELS, F.lit("Paragraph"))


def status_label(x: Column) -> Column:
    return _lookup(x, vocab.STATUS_LABELS, x)


def summarize_error(x: Column) -> Column:
    return F.coalesce(x, F.lit("An unexpected error occurred."))


def iso_time(x: Column) -> Column:
    """A timestamp as ISO 8601 in UTC with milliseconds; the session's time zone does not matter."""
    return F.date_format(F.to_utc_timestamp(x, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def password_protected(x: Column) -> Column:
    return F.coalesce(x.rlike("(?i)password|encrypted|owner password|permission"), F.lit(False))


def numbered(prefix: Column, n: Column) -> Column:
    """A number of four digits at least behind a prefix; longer ones are not cut."""
    return F.concat(prefix, F.when(n > 9999, n.cast("string")).otherwise(F.lpad(n.cast("string"), 4, "0")))


def lower_first(x: Column) -> Column:
    return F.concat(F.lower(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))


def capitalize(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))


def citation_list(ids: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.array_distinct(ids), ", "), F.lit("]"))


# Line predicates of the chunkers.

HEADING = rf"\A(#{{1,6}}){SPACE}+(.+)\z"
CALLOUT_WORDS = "warning|caution|note|important|alert"
QUESTION_WORDS = "what|why|how|can|is|are|do|does|should|will|when|where|which"


def heading_level(line: Column) -> Column:
    """1 to 6 for a markdown heading, else 0."""
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_title(line: Column) -> Column:
    return trim(F.regexp_extract(line, HEADING, 2))


def is_table_line(line: Column) -> Column:
    return line.rlike(r"\A\|.+\|\z") | line.rlike(r"\A\|?[-: ]+\|[-|: ]+\z")


def is_ordered(line: Column) -> Column:
    return line.rlike(rf"\A\d+\.{SPACE}+")


def is_bullet(line: Column) -> Column:
    return line.rlike(rf"\A[-*+]{SPACE}+")


def is_warning(line: Column) -> Column:
    return trim(line).rlike(leading(CALLOUT_WORDS))


def is_callout(line: Column) -> Column:
    return line.startswith(">") | line.rlike(leading(CALLOUT_WORDS))


def has_faq_section(path: Column) -> Column:
    return F.coalesce(F.exists(path, lambda p: F.coalesce(p.rlike(leading("faq")), F.lit(False))), F.lit(False))


def is_faq_question(line: Column, path: Column) -> Column:
    text = trim(line)
    return text.endswith("?") & (F.length(text) >= 8) & (text.rlike(leading(QUESTION_WORDS)) | has_faq_section(path))


def letters(x: Column) -> Column:
    return F.length(F.regexp_replace(x, "[^A-Za-z]+", ""))


def upper_share(x: Column) -> Column:
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(x, "[^A-Z]+", "")).cast("double"), letters(x).cast("double")), F.lit(0.0))


def looks_like_heading(line: Column, font: Column, body: Column) -> Column:
    text = trim(line)
    n_words = F.size(split_words(text))
    caps = (upper_share(text) >= 0.88) & (n_words <= 10)
    large = (font >= body + 6) & (n_words <= 8) & ~text.rlike("[.,]") & ~text.rlike("[a-z]{4,}")
    larger = (font >= body + 8) & (n_words <= 12) & ~text.rlike("[a-z]{5,}")
    # the cheap bounds come first, so that other conditions are looked at for short lines alone
    shape = (F.length(text) <= 90) & (F.length(text) >= 4) & (letters(text) >= 4) & ~text.rlike(r"[.,]\z")
    return shape & (text.rlike(leading("faq")) | caps | large | larger)


def layout_heading_level(line: Column, font: Column, body: Column) -> Column:
    return F.when((font >= body + 8) | line.rlike(leading("faq")), 1).otherwise(2)


def clean_heading(line: Column) -> Column:
    return normalize_whitespace(F.regexp_replace(line, rf"\A-+{SPACE}*", ""))


def is_value_line(line: Column, path: Column) -> Column:
    """A row of a value table rather than a sentence."""
    text = trim(line)
    numbers, n_words = count_matches(text, NUMBER), F.size(split_words(text))
    in_values = F.coalesce(F.exists(path, lambda p: F.coalesce(p.rlike("(?i)cost|estimation|mix|composition|ratio|material"), F.lit(False))), F.lit(False))
    sentence = (n_words >= 7) & text.rlike(words("is|are|was|were|be|been|being|with|instead|because|allow|wait|keep|begin|used|using|applied"))
    # a percent sign is no word character, so boundaries stand beside it only next to a letter or digit
    cue = text.rlike("[:|]") | text.rlike(words(r"total|qty|quantity|rate|cost|assumption|bag|per|ratio|inr|sq\.?ft|kg|mm")) | text.rlike("(?<=[A-Za-z0-9_])%(?=[A-Za-z0-9_])")
    unit = text.rlike(r"(?i)@|inr|kg|sq\.?ft|ton|%|mm")
    return (F.length(text) <= 120) & ~sentence & ((numbers >= 2) | (in_values & (numbers >= 1) & cue) | ((n_words <= 7) & cue & unit))
