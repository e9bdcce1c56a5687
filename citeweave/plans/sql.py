"""Pieces of plain SQL from which the oracle queries are put together."""

from __future__ import annotations

from ..functions import vocab


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def stem(w: str) -> str:
    cases = " ".join(f"WHEN {w} IN ({quoted(forms)}) THEN '{forms[0]}'" for forms in vocab.STEMS)
    return (
        f"CASE {cases} WHEN length({w}) > 4 AND ends_with({w}, 'ies') THEN {w}[1:-4] || 'y' "
        f"WHEN length({w}) > 4 AND ends_with({w}, 's') AND NOT ends_with({w}, 'ss') THEN {w}[1:-2] ELSE {w} END"
    )


def terms(x: str) -> str:
    split = f"regexp_split_to_array(lower({x}), '[^a-z0-9]+')"
    stemmed = f"list_transform(list_filter({split}, lambda w: length(w) > 2), lambda w: {stem('w')})"
    return f"list_filter({stemmed}, lambda t: length(t) > 2 AND t NOT IN ({quoted(vocab.STOPWORDS)}))"


def any_term(t: str, fixed) -> str:
    return f"list_has_any({t}, [{quoted(fixed)}])"


def normal(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'), ' ')"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def bonus(condition: str, value: float) -> str:
    return f"CASE WHEN {condition} THEN {value}::DOUBLE ELSE 0 END"


SLOT = "CAST('0x' || substr(sha1(term), 1, 8) AS BIGINT)"
SIGN = "CASE WHEN CAST('0x' || substr(sha1(term), 9, 2) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END"


def embedding(source: str, key: str, text: str, dimensions: int = vocab.VECTOR_DIMENSIONS) -> str:
    """A subquery of (key, idx, value): the non-zero and cancelled slots of the lexical embedding."""
    return f"""
    (SELECT {key}, idx, round(coalesce(n / nullif(sqrt(sum(n * n) OVER (PARTITION BY {key})), 0), 0), 8) AS value
     FROM (SELECT {key}, {SLOT} % {dimensions} AS idx, CAST(sum({SIGN}) AS DOUBLE) AS n
           FROM (SELECT {key}, unnest({terms(text)}) AS term FROM {source}) GROUP BY ALL))"""


def signals(source: str) -> str:
    """A subquery that adds the question's signals."""
    q, t = "question", "q_terms"
    return rf"""
    (SELECT *,
      {matches(q, r'(?i)^(how|steps?|procedure|process)\b')} OR (NOT q_value AND {any_term(t, vocab.PROCEDURE_TERMS)}) AS q_procedure,
      {matches('q_norm', r'(?i)^(can|is|are|do|does|should|will|would|could|did)\b')} AS q_yesno,
      {any_term(t, vocab.COMPOSITION_TERMS)} AS q_composition,
      {any_term(t, vocab.TOOLING_TERMS)} AS q_tooling,
      {matches(q, r'(?i)\b(cur(?:e|ed|ing)|watering|72 hours|dry out)\b')} AS q_curing
     FROM (SELECT *, {matches(q, r'\d')} OR {any_term(t, vocab.VALUE_TERMS)} AS q_value
           FROM (SELECT *, {normal(q)} AS q_norm, list_distinct({terms(q)}) AS q_terms FROM {source})))"""
