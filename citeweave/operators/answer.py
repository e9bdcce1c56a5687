"""Answers from retrieved excerpts, deterministic and cited.

A question's excerpts are at most a dozen rows, so each question is answered in one
pandas group; search, ranking and all that grows with the corpus stays in Columns.
An excerpt becomes a span: the lines that bear on the question and a confidence.
Spans are selected greedily around an anchor, because whether one adds something
depends on those taken before. Facts from the selected spans make the answer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab

# Texts of answers.
CLARIFY = "Which section, topic, or page should I focus on in the PDF?"
NOT_FOUND = "I could not find this in the uploaded PDF."
NOTE_NOTHING = "No relevant PDF excerpts matched the question in local fallback mode."
NOTE_PART = "The local fallback could only support part of this question from the PDF text."
LEAD, LEAD_VALUES, LEAD_STEPS = "Based on the uploaded PDF:", "The PDF gives these details:", "The PDF describes the process as:"
DRAFT_OPEN = "Thank you for your question. Based on the uploaded PDF, "
DRAFT_CLOSE = "\n\nPlease let us know if you would like the exact page or section reference from the document."


def _has(pattern: str) -> Callable[[str], bool]:
    found = re.compile(pattern, re.IGNORECASE | re.ASCII).search
    return lambda text: found(text) is not None


# Signals of a line or question.
numeric = _has(r"\d")
composition = _has(r"\b(?:fat lime|ash|sand|aggregate|water|booster|25kg|ratio|mix)\b")
measured = _has(r"\bmeasure by (?:weight|volume)\b|\bfor every \d+(?:[.,]\d+)?\s*kg\b")
tool = _has(r"\b(?:tool|rammers?|vibrators?|bamboo|mechanical|manual)\b")
curing = _has(r"\b(?:cur(?:e|ing|ed)|watering|72 hours|4-6 days|dry out|embankment)\b")
procedural = _has(r"\b(?:add|mix|measure|combine|wet|lay|keep|allow|wait|begin|carry|compact|cure|feed|create)\b")
asks_curing = _has(r"\b(?:cur(?:e|ed|ing)|watering|72 hours|dry out)\b")
starts_procedure = _has(r"^(?:how|steps?|procedure|process)\b")
starts_yesno = _has(r"^(?:can|is|are|do|does|should|will|would|could|did)\b")
value_row = _has(r"^(?:~?\d+(?:[.,]\d+)?\b|for every \d|measure by\b)")
about_pronoun = _has(r"^(?:what|why|how|can|is|are|do|does|should|will)\s+(?:this|that|it|they|those|these)\b")
TOOL_WORDS = {w: _has(rf"\b{p}\b") for w, p in (("bamboo", "bamboo"), ("vibrator", "vibrators?"), ("rammer", "rammers?"), ("manual", "manual"), ("mechanical", "mechanical"))}

_STEMS = {word: forms[0] for forms in vocab.STEMS for word in forms}


def stem(word: str) -> str:
    if word in _STEMS:
        return _STEMS[word]
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    return word[:-1] if len(word) > 4 and word.endswith("s") and not word.endswith("ss") else word


def terms(text: str) -> list[str]:
    """The search terms of a text, as the Column of that name gives them."""
    found = (stem(w) for w in re.split("[^a-z0-9]+", text.lower()) if w)
    return [t for t in found if len(t) > 2 and t not in vocab.STOPWORDS]


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def plain(text: str) -> str:
    """White space normalised, lines kept."""
    return re.sub(r"[ \t]+\n", "\n", text.replace("\r", "")).strip()


@dataclass(frozen=True)
class Intent:
    """What a question wants."""

    kind: str
    question: str
    terms: tuple[str, ...]
    numbers: bool
    tools: bool
    composition: bool
    curing: bool

    @classmethod
    def of(cls, question: str) -> Intent:
        words = tuple(dict.fromkeys(terms(question)))
        wants = lambda fixed: not set(fixed).isdisjoint(words)
        numbers = numeric(question) or wants(vocab.VALUE_TERMS)
        mixture, tools, cures = wants(vocab.COMPOSITION_TERMS), wants(vocab.TOOLING_TERMS), asks_curing(question)
        steps = starts_procedure(question) or (not numbers and not mixture and (cures or wants(vocab.ANSWER_PROCEDURE_TERMS)))
        normal = question.strip().lower()
        if tools and _has(r"\bwhat\b")(question):
            kind = "explanation"
        elif numbers or mixture:
            kind = "value"
        elif steps:
            kind = "procedure"
        else:
            kind = "yesno" if starts_yesno(normal) else "explanation"
        return cls(kind, normal, words, numbers, tools, mixture, cures)

    def overlap(self, text: str) -> float:
        """Share of the question's terms that a text has."""
        return len(set(self.terms).intersection(terms(text))) / len(self.terms) if self.terms else 0.0

    def line_score(self, line: str, title: str) -> float:
        # Weights of a line's signals.
        return (
            self.overlap(line)
            + (0.4 * self.overlap(title) if title else 0)
            + 0.7 * (self.numbers and numeric(line))
            + 0.75 * (self.composition and composition(line))
            + 0.75 * (self.tools and tool(line))
            + 0.85 * (self.curing and curing(line))
            + 0.42 * (self.kind == "procedure" and procedural(line))
        )

    def states_mixture(self, line: str) -> bool:
        return self.composition and (measured(line) or (numeric(line) and composition(line)))


@dataclass(frozen=True)
class Span:
    """The lines of an excerpt that bear on a question."""

    source: str
    type: str
    section: str
    title: str
    page_from: int
    page_to: int
    order: int
    lines: tuple[str, ...]
    confidence: float = 0.0
    asked: str | None = None
    verdict: str | None = None

    @property
    def text(self) -> str:
        return " ".join(self.lines)

    @property
    def fact_order(self) -> int:
        return self.page_from * 100 + self.order

    def answers(self, intent: Intent) -> bool:
        """Is this the FAQ entry of just this question?"""
        return self.asked is not None and squeeze(self.asked).lower() == intent.question

    def any(self, signal: Callable[[str], bool]) -> bool:
        return any(map(signal, self.lines))


def yes_or_no(text: str) -> str | None:
    """By prefix alone: "not", "note" and "north" say no as well."""
    start = squeeze(text).lower()
    return "yes" if start.startswith("yes") else "no" if start.startswith("no") else None


def _continues(line: str, more: str) -> bool:
    """Was ``more`` wrapped off ``line``?"""
    closed = line[-1] in ".!?:"
    if value_row(line) or value_row(more) or re.match(r"[A-Z][A-Z\s/&-]{3,}\Z", more):
        return False
    if closed and re.match("[A-Z0-9]", more):
        return False
    return not closed or re.match(r"[a-z(]", more) is not None


def unwrapped(lines: list[str], kind: str) -> list[str]:
    """Lines that were wrapped become one again; tables and lists stay as they are."""
    out: list[str] = []
    for line in filter(None, map(squeeze, lines)):
        if out and kind not in ("table", "list") and _continues(out[-1], line):
            out[-1] = f"{out[-1]} {line}"
        else:
            out.append(line)
    return out


def _around_best(lines: list[str], scores: list[float], n: int) -> list[str]:
    best = max(range(len(lines)), key=lambda i: (scores[i], -i))
    start = max(0, best - 1) if scores[best] > 0 else 0
    return lines[start : start + n]


def relevant_lines(lines: list[str], scores: list[float], intent: Intent) -> list[str]:
    if intent.kind == "procedure":
        return lines if len(lines) <= 5 else _around_best(lines, scores, 4)
    if intent.kind != "value":
        return _around_best(lines, scores, 3)
    telling = [x for x, s in zip(lines, scores, strict=True) if s >= 0.5 or numeric(x) or intent.states_mixture(x) or (intent.tools and tool(x))]
    if telling:
        return telling[:5]
    best = sorted(range(len(lines)), key=lambda i: (-scores[i], i))[:3]
    return [lines[i] for i in sorted(best)]


def body_of(path: list[str | None], text: str) -> str:
    header = " > ".join(p or "" for p in path)
    return plain(text).removeprefix(f"{header}\n") if header else plain(text)


def span_of(chunk: dict, order: int, intent: Intent) -> Span | None:
    """The span of one excerpt, or None if it has no line to offer."""
    path = list(chunk["section_path"])
    body = body_of(path, chunk["text"])
    lines = unwrapped(body.split("\n"), chunk["chunk_type"])
    if not lines:
        return None
    bare = Span(chunk["label"], chunk["chunk_type"], " > ".join(p or "" for p in path), (path[-1] or "") if path else "", int(chunk["page_from"]), int(chunk["page_to"]), order, tuple(lines))
    rank = float(chunk["score"] or 0.0)
    entry = re.search(r"Question:\s*(.+?)\nAnswer:\s*([\s\S]+)", body, re.IGNORECASE) if bare.type == "faq" else None
    if entry:
        told = plain(entry[2])
        given = unwrapped(told.split("\n"), "faq")
        if given:
            return _faq_span(bare, squeeze(entry[1]), told, given, rank, intent)
    scores = [intent.line_score(x, bare.title) for x in lines]
    span = replace(bare, lines=tuple(relevant_lines(lines, scores, intent)))
    # What raises the confidence of an excerpt.
    formula = intent.composition and bare.title[:1].isdigit() and span.any(numeric) and span.any(composition)
    confidence = (
        max(scores)
        + min(1.2, 0.14 * rank)
        + 0.25 * (intent.numbers and span.any(numeric))
        + 0.75 * formula
        + 0.3 * (intent.tools and tool(span.text))
        + 0.15 * (intent.kind == "procedure")
    )
    return replace(span, confidence=confidence)


def _faq_span(bare: Span, asked: str, told: str, given: list[str], rank: float, intent: Intent) -> Span:
    # What raises and lowers the confidence of a FAQ entry.
    confidence = max(intent.line_score(asked, bare.title) + 0.65, intent.line_score(told, bare.title)) + min(1.35, 0.16 * rank) + 0.6
    if intent.tools:
        confidence += 0.35 * TOOL_WORDS["vibrator"](f"{asked} {told}") + 0.25 * _has(r"\bweighted rammers?\b")(told) - 0.15 * TOOL_WORDS["bamboo"](asked)
    if intent.composition and not any(map(numeric, given)):
        confidence -= 1.9
    return replace(bare, type="faq", lines=tuple(given), confidence=confidence, asked=asked, verdict=yes_or_no(told))


def spans_of(chunks: list[dict], intent: Intent) -> list[Span]:
    """Spans by falling confidence; the FAQ entry of just this question is raised, unless steps are wanted."""
    by_confidence = lambda spans: sorted(spans, key=lambda s: -s.confidence)
    spans = by_confidence(s for i, c in enumerate(chunks) if (s := span_of(c, i, intent)))
    exact = next((s for s in spans if s.answers(intent)), None)
    if exact and intent.kind != "procedure":
        spans = by_confidence(replace(s, confidence=s.confidence + 0.7) if s.source == exact.source else s for s in spans)
    return spans


def anchor_of(spans: list[Span], intent: Intent) -> Span | None:
    """The span that others are judged by: the first that fits what is wanted and is nearly as good as the best."""
    if not spans:
        return None
    best = spans[0].confidence
    rules: list[tuple[bool, Callable[[Span], bool], float]] = [
        (True, lambda s: s.answers(intent), -math.inf),
        (intent.curing, lambda s: curing(f"{s.title} {s.text}"), 0.68),
        (intent.tools, lambda s: s.type != "faq" and _has("tools?|compaction")(s.section) and tool(s.text), 0.7),
    ]
    for applies, fits, share in rules:
        found = next((s for s in spans if fits(s) and (share == -math.inf or s.confidence >= best * share)), None) if applies else None
        if found:
            return found
    if intent.kind == "value":
        # here only the first that fits is asked whether it is good enough
        found = next((s for s in spans if s.type != "faq" and s.any(numeric) and (s.title[:1].isdigit() or s.any(composition))), None)
        if found and found.confidence >= best * 0.72:
            return found
    return spans[0]


def adds_coverage(span: Span, taken: list[Span], intent: Intent) -> bool:
    """Does a span say something asked for that those taken do not?"""
    seen = set(terms(" ".join(t.text for t in taken)))
    if any(t in intent.terms and t not in seen for t in terms(span.text)):
        return True
    if intent.numbers and span.any(numeric):
        return not any(t.any(numeric) for t in taken)
    if intent.tools and tool(span.text):
        named = lambda text: {w for w, said in TOOL_WORDS.items() if said(text)}
        return bool(named(span.text) - set().union(*(named(t.text) for t in taken)))
    if intent.curing and curing(span.text):
        return not any(curing(t.text) for t in taken)
    return False


def belongs(span: Span, taken: list[Span], anchor: Span, intent: Intent) -> bool:
    """May a span join those taken?"""
    same = span.section == anchor.section
    near = abs(span.page_from - anchor.page_to) <= 1
    at_least = lambda share: span.confidence >= anchor.confidence * share
    adds = adds_coverage(span, taken, intent)
    if intent.curing and not curing(span.text) and not _has("curing regime")(span.section):
        return False
    if intent.kind == "value":
        return span.type != "faq" and ((same and near and at_least(0.45)) or ((same or near) and (at_least(0.3) or adds)))
    if (same and near and at_least(0.45)) or (intent.kind == "procedure" and near and at_least(0.35)):
        return True
    if intent.curing and curing(span.text):
        return near or at_least(0.45) or adds
    if intent.tools and (tool(span.text) or span.type == "faq"):
        return at_least(0.28) or adds
    return adds and (at_least(0.45) or (bool(span.title) and span.title == anchor.title and near))


def select(spans: list[Span], intent: Intent) -> list[Span]:
    """The anchor and what belongs to it, three spans at most, or four where details are wanted."""
    anchor = anchor_of(spans, intent)
    if anchor is None:
        return []
    if anchor.answers(intent) and intent.kind != "procedure":
        return [anchor]
    most = 4 if intent.kind in ("procedure", "value") or intent.tools else 3
    taken = [anchor]
    for span in spans:
        if len(taken) < most and all(t.source != span.source for t in taken) and belongs(span, taken, anchor, intent):
            taken.append(span)
    return taken


def supported(spans: list[Span], intent: Intent) -> bool:
    """Is there enough in the selected spans to answer?"""
    said = set(terms(" ".join(x for s in spans for x in (s.title, s.asked or "", s.text))))
    share = sum(t in said for t in intent.terms) / max(1, len(intent.terms))
    steps = intent.kind == "procedure" and any(curing(s.text) or procedural(s.text) for s in spans) and (share >= 0.24 or len(spans) >= 2)
    return spans[0].answers(intent) or spans[0].verdict is not None or share >= 0.34 or (intent.kind == "value" and any(s.any(numeric) for s in spans)) or steps


@dataclass
class Fact:
    text: str
    sources: list[str] = field(default_factory=list)
    order: int = 0

    @property
    def cited(self) -> str:
        return f"{self.text} {citation(self.sources)}"


def citation(sources: list[str]) -> str:
    return f"[{', '.join(dict.fromkeys(s for s in sources if s))}]"


def merged(found: list[tuple[str, Span]]) -> list[Fact]:
    """Facts in the order of their pages; those that read alike become one with all sources."""
    facts: dict[str, Fact] = {}
    for text, span in found:
        fact = facts.setdefault(squeeze(text).lower(), Fact(text, [], span.fact_order))
        fact.order = min(fact.order, span.fact_order)
        if span.source not in fact.sources:
            fact.sources.append(span.source)
    return sorted(facts.values(), key=lambda f: f.order)


def value_facts(spans: list[Span], intent: Intent) -> list[Fact]:
    found = []
    for s in spans:
        lines = list(s.lines)
        if intent.composition and s.title[:1].isdigit() and all(squeeze(x).lower() != squeeze(s.title).lower() for x in lines):
            lines.insert(0, s.title)
        found += [(x, s) for x in lines if numeric(x) or intent.states_mixture(x) or (intent.tools and tool(x))]
    return merged(found)


def step_facts(spans: list[Span], intent: Intent) -> list[Fact]:
    tells = (lambda x: curing(x) or numeric(x)) if intent.curing else (lambda x: procedural(x) or numeric(x) or _has(r"^(?:yes|no)\b")(x))
    return merged([(x, s) for s in spans for x in ([y for y in s.lines if tells(y)] or s.lines)])


def faq_tool_fact(span: Span) -> str:
    """A FAQ answer that names no tool gets the question's subject in front."""
    if tool(span.text):
        return span.text
    subject = re.match(r"Can\s+(.+?)\s+be used", span.asked, re.IGNORECASE) or re.match(r"What\s+(.+?)\s+(?:is|are)\s+used", span.asked, re.IGNORECASE)
    return f"Regarding {subject[1]}, {span.text[:1].lower()}{span.text[1:]}" if subject else span.text


def plain_facts(spans: list[Span], intent: Intent) -> list[Fact]:
    found = []
    for s in spans:
        if intent.tools and s.type == "faq" and s.asked and s.text:
            found.append((faq_tool_fact(s), s))
            continue
        telling = [
            x
            for x in s.lines
            if (intent.tools and tool(x)) or (intent.curing and curing(x)) or (intent.numbers and numeric(x)) or intent.line_score(x, s.title) > 0.18
        ]
        found += [(x, s) for x in (telling or s.lines)[:2]]
    return merged(found)


def _bullets(lead: str, facts: list[Fact]) -> str:
    return facts[0].cited if len(facts) == 1 else "\n".join([lead, *(f"- {f.cited}" for f in facts)])


def explain(spans: list[Span], intent: Intent) -> str:
    facts = plain_facts(spans, intent)[:4]
    if facts:
        return _bullets(LEAD, facts)
    return "\n\n".join(f"{s.text} {citation([s.source])}" for s in spans) or NOT_FOUND


def answer_text(spans: list[Span], intent: Intent, mode: str) -> str:
    exact = spans[0].answers(intent)
    kind = "yesno" if exact and intent.kind != "procedure" else intent.kind
    if mode == "draft":
        facts = (step_facts if kind == "procedure" else plain_facts)(spans, intent)[:4]
        said = " ".join(f"{f.text[:1].lower()}{f.text[1:]} {citation(f.sources)}" for f in facts)
        return f"{DRAFT_OPEN}{said}{DRAFT_CLOSE}" if facts else NOT_FOUND
    if kind == "yesno":
        verdict = next((s.verdict for s in spans if s.verdict), None) or yes_or_no(spans[0].text)
        intro = f"{verdict.capitalize()}." if verdict else LEAD
        facts = plain_facts(spans[:1] if exact else spans, intent)[: 1 if exact else 3]
        return "\n".join([intro, *(f"- {f.cited}" for f in facts)]) if facts else f"{intro} {citation([spans[0].source])}"
    if kind == "value" and (facts := value_facts(spans, intent)[:8]):
        return _bullets(LEAD_VALUES, facts)
    if kind == "procedure" and (facts := step_facts(spans, intent)[:5]):
        return "\n".join([LEAD_STEPS, *(f"{i}. {f.cited}" for i, f in enumerate(facts, 1))])
    return explain(spans, intent)


def unclear(question: str, intent: Intent, chunks: list[dict]) -> bool:
    """Does the question name too little to choose between the excerpts?"""
    compact = question.strip().lower()
    if len(intent.terms) >= 2 and not about_pronoun(compact) and compact not in ("this?", "that?"):
        return False
    return len(chunks) <= 1 or abs((chunks[0]["score"] or 0) - (chunks[1]["score"] or 0)) < 0.15


def answer(question: str, mode: str, chunks: list[dict]) -> dict:
    """The answer to a question from its excerpts in their order; these have label, section_path, chunk_type, text, pages and score."""
    intent = Intent.of(question)
    out = {"type": "answer", "answer": NOT_FOUND, "clarifying_question": None, "used_source_ids": [], "missing": [NOTE_NOTHING]}
    if unclear(question, intent, chunks):
        return out | {"type": "clarification", "answer": "", "clarifying_question": CLARIFY, "missing": []}
    taken = select(spans_of(chunks, intent), intent)
    if not taken or not supported(taken, intent):
        return out
    said = set(terms(" ".join(s.text for s in taken)))
    open_terms = [t for t in intent.terms if t not in said]
    notes = [NOTE_PART] if open_terms and len(open_terms) >= math.ceil(len(intent.terms) / 2) else []
    return out | {"answer": answer_text(taken, intent, mode), "used_source_ids": list(dict.fromkeys(s.source for s in taken)), "missing": notes}


# Fixed value.
NOTE_UNRETRIEVED = "No relevant PDF excerpts were retrieved for this question."

_ANSWER = "qid long, type string, answer string, clarifying_question string, used_source_ids array<string>, missing array<string>"


def _answer_group(rows: pd.DataFrame) -> pd.DataFrame:
    chunks = rows.sort_values("place").to_dict("records")
    return pd.DataFrame([{"qid": chunks[0]["qid"], **answer(chunks[0]["question"], chunks[0]["mode"], chunks)}])


def answers(retrieved: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """qid, type, answer, clarifying_question, used_source_ids, missing for the questions of labelled excerpts.

    ``questions`` (column qid) that retrieved nothing get the fixed answer that nothing was found.
    """
    rows = retrieved if "mode" in retrieved.columns else retrieved.withColumn("mode", F.lit("answer"))
    rows = rows.select("qid", "question", "mode", "place", "label", "section_path", "chunk_type", "text", "page_from", "page_to", "score")
    found = rows.groupBy("qid").applyInPandas(_answer_group, _ANSWER)
    if questions is None:
        return found
    nothing = {"type": F.lit("answer"), "answer": F.lit(NOT_FOUND), "used_source_ids": F.expr("cast(array() as array<string>)"), "missing": F.array(F.lit(NOTE_UNRETRIEVED))}
    met = questions.select("qid").join(found, "qid", "left")
    return met.select("qid", *(F.when(F.col("type").isNull(), nothing[c]).otherwise(F.col(c)).alias(c) if c in nothing else F.col(c) for c in found.columns if c != "qid"))
