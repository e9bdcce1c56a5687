"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

The patterns give the base spans. Novelty is then measured of what each base span
names as its secret, and of every other long token in sensitive context: the
surrounding text is compressed with and without the token, primed by a dictionary of
common code and identifier words, and the difference is what the token adds. A token
that neither the surroundings nor the dictionary explain costs nearly its entropy.
Such tokens outside base spans are reported as spans of their own; base spans always
stay, and how many of them novelty confirms is counted.

Sensitive context is a token that begins at most ``NEAR`` code points behind a cue or
ends that many before one. Cues are sensitive words, names that look like keys in an
assignment, headers that carry credentials, passwords and key parameters in URLs, and
the heads of key blocks. Long words and identifiers are as novel as secrets, so a token
of letters alone whose parts look like words (``worded``) is not reported; that also
spares random letters of one case.

Null and empty texts have no spans. Offsets count code points, ends exclusive.
Whole texts are scanned; a token is compared with at most ``WINDOW`` code points
on either side, which is what "surrounding" means here. Rows are judged each for
itself: repeated rows give repeated results, null ids are kept, an empty table gives
an empty one. Spans that begin at one place are listed in the order of ``KINDS``.
Other columns are not read by ``secret_scan``; ``redact_secrets`` hands them on.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ._shared import keep_alone, text_slices

KINDS = ("assign", "access", "hex", "novel")
RANK = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of hex digits is found whole, so asking for 24 at once drops the same runs.
_HEX = re.compile(r"[0-9a-f]{24,}")

WINDOW = 160
NEAR = 48
LEAST_LENGTH = 16
#: Added compressed bytes for each character. Base64 text has 0.75, hex digits 0.5.
LEAST_NOVELTY = 0.55
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Where secrets stand: sensitive words, names like keys that are assigned to, headers, URLs, key blocks.
_CUE = re.compile(
    "(?ai:"
    r"passphrase|passcode|passwd|password|pwd|secret|token|credential|bearer|authorization|private|signature|auth|api[ _-]?key|access[ _-]?key|client[ _-]?key"
    r"|(?:[_.-](?:key|pass|pw|cred|creds|sig|salt|seed|nonce|cert|hmac|otp|sas|sid|jwt|dsn)|\b(?:key|pass|pw|creds|sig|salt|nonce|hmac|otp|sas|jwt|dsn))[\"']?\x20*(?::=|=>|[:=])"
    r"|\b(?:x-[a-z-]+-(?:key|sig|id)|cookie|session[ _-]?id):"
    r"|[?&](?:key|sig|code|sas)=|://[^/\s:@]{0,64}:"
    r"|-----BEGIN [A-Z ]{0,32}KEY-----"
    ")"
)

#: Words that code and configuration repeat; they prime the compressor.
IDENTIFIERS = (
    "access account address api app application argument array async auth authorization await base64 bearer begin bool boolean "
    "bucket buffer cache callback certificate char class client client_id client_secret code column config configuration connect "
    "connection const content context cookie count create credential data database debug default define delete description "
    "dictionary directory domain double else email enable encode encoding end endpoint engine entry environment error event "
    "example except exception export extends false field file filename filter final float for format from function global group "
    "handle handler hash header host hostname html http https identifier import index info init input insert instance int integer "
    "interface internal item json key lambda language length library license list load local localhost log logger login long main "
    "manager map master max memory message method min model module name namespace new node null number object offset open option "
    "order output package page param parameter parent parse parser passphrase password path pattern port prefix print private "
    "process project property protected protocol provider proxy public query queue random read record redirect region register "
    "release remote remove render replace request require resource response result return role root route row schema scope script "
    "search secret secret_key security select self send sequence server service session set setting signature size socket sort "
    "source spark sql start state static status stop storage stream string struct style suffix switch system table tag target task "
    "template temp test text thread throw time timeout timestamp title token total true try type undefined unique update upload "
    "url user user_id username utf8 value var variable vector version view void while window with worker write yaml "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef"
)

#: One case, or humps of a capital and two small letters at least. 0.4 % of tokens of 16 random letters are like that.
_WORD = re.compile(r"[A-Z]*|[a-z]+|[a-z]*(?:[A-Z][a-z]{2,})+")
_JOINTS = re.compile(r"[+/_=-]+")

_machine: dict[str, object] = {}


def _compressor() -> zstandard.ZstdCompressor:
    if "c" not in _machine:
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _machine["c"] = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return _machine["c"]


def novelty(before: str, token: str, after: str = "") -> float:
    """Compressed bytes that ``token`` adds to its surroundings, for each of its bytes."""
    c = _compressor()
    around, own = (before + after).encode("utf-8", "surrogatepass"), token.encode()
    return (len(c.compress(around + own)) - len(c.compress(around))) / max(1, len(own))


def _base_matches(text: str) -> list[tuple[str, int, int, int, int]]:
    """Base spans and where in them the secret itself stands."""
    out = [("assign", *m.span(), *m.span(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [("access", *m.span(), *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span(), *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], RANK[s[0]]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [s[:3] for s in _base_matches(text)]


def worded(token: str) -> bool:
    """Whether the token has no digit and all its parts look like words; also true of bare joints."""
    return all(map(_WORD.fullmatch, _JOINTS.split(token)))


def _tokens_near(text: str) -> list[tuple[int, int]]:
    """Tokens that begin behind a cue or end before one, at most ``NEAR`` away; each is seen whole, however long."""
    cues = [m.span() for m in _CUE.finditer(text)]
    out, done = [], -1
    for _, end in cues:
        stop = end + NEAR
        at = max(done, end)
        while at < stop and (m := _TOKEN.search(text, at, stop + LEAST_LENGTH)):
            m = _TOKEN.match(text, m.start())
            at = done = m.end()
            out.append(m.span())
    behind = set(out)
    starts, ends = [a for a, _ in cues], [b for _, b in cues]
    for m in _TOKEN.finditer(text) if cues else ():
        s, e = m.span()
        k = bisect_right(ends, s)  # the first cue that ends inside the token or later
        if k == len(cues) or starts[k] - e > NEAR:
            continue
        # of a token that holds a cue, the part before it; what follows was found above
        e = min(e, starts[k])
        if e - s >= LEAST_LENGTH and (s, e) not in behind:
            out.append((s, e))
    return out


def _outside(tokens: list[tuple[int, int]], spans: list[tuple]) -> list[tuple[int, int]]:
    """Tokens that no span touches; spans are by start."""
    covered: list[list[int]] = []  # spans joined where they touch, so a bisection finds the one before a token
    for _, a, b, *_ in spans:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(b, covered[-1][1])
        else:
            covered.append([a, b])
    starts = [a for a, _ in covered]
    return [(s, e) for s, e in tokens if not (k := bisect_left(starts, e)) or covered[k - 1][1] <= s]


def measured(text: str) -> list[tuple[str, int, int, int, int, float]]:
    """All that novelty is measured of: (kind, start, end, of the secret itself start and end, novelty).

    Base spans come with their kind; other tokens in sensitive context are ``novel``,
    whether novel enough or not. Ordered by start, then kind.
    """
    base = _base_matches(text)
    tokens = [("novel", s, e, s, e) for s, e in _outside(_tokens_near(text), base) if not worded(text[s:e])]
    around = lambda a, b: novelty(text[max(0, a - WINDOW) : a], text[a:b], text[b : b + WINDOW])
    return sorted(((*x, around(x[3], x[4])) for x in base + tokens), key=lambda x: (x[1], RANK[x[0]], x[2]))


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text: (kind, start, end) by start, then kind."""
    return [x[:3] for x in measured(text) if x[0] != "novel" or x[5] >= LEAST_NOVELTY] if text else []


def _digest(spans: Iterable[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_alone("secrets")
    for part, texts in text_slices(batches):
        every = [measured(t) if t else [] for t in texts]
        base = [[x for x in m if x[0] != "novel"] for m in every]
        found = [[x for x in m if x[0] != "novel" or x[5] >= LEAST_NOVELTY] for m in every]
        count = lambda kind: pa.array([sum(s[0] == kind for s in f) for f in found], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                *(count(k) for k in KINDS),
                pa.array([hashlib.sha256(_digest(b).encode()).hexdigest() for b in base], pa.string()),
                pa.array([_digest(f) for f in found], pa.string()),
                pa.array([len(m) for m in every], pa.int64()),
                pa.array([sum(x[5] >= LEAST_NOVELTY for x in b) for b in base], pa.int64()),
                pa.array([max((x[5] for x in m), default=None) for m in every], pa.float64()),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "n_measured", "n_confirmed", "max_novelty"],
        )


def secret_scan(documents: DataFrame) -> DataFrame:
    """One row per document: counts by kind, a digest of the base spans, all spans, and what novelty was measured.

    ``n_measured`` tokens were compressed, base spans among them; ``n_confirmed`` base
    spans are as novel as a reported token; ``max_novelty`` is the largest novelty, null
    if nothing was measured. Odd rows as the module says.
    """
    return documents.select("doc_id", "text").mapInArrow(
        _scan_batches,
        "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, n_measured long, n_confirmed long, max_novelty double",
    )


def redact(text: str | None) -> str | None:
    """The text with every found span replaced by ``<secret:kind>``; overlapping spans become one."""
    if not text:
        return text
    out, at, spans = [], 0, scan(text)
    k = 0
    while k < len(spans):
        kind, a, b = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < b:
            b = max(b, spans[k][2])
            k += 1
        out += [text[at:a], f"<secret:{kind}>"]
        at = b
    return "".join([*out, text[at:]]) if spans else text


class _Redact:
    """The same rows with redacted texts; as many texts at a time as ``text_slices`` gives."""

    def __init__(self, schema: StructType):
        self.names = schema.names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_alone("secrets")
        at = self.names.index("text")
        for part, texts in text_slices(batches):
            known = pa.compute.is_valid(part.column(at)).to_pylist()
            out = [redact(t) if k else None for t, k in zip(texts, known, strict=True)]
            columns = list(part.columns)
            columns[at] = pa.array(out, part.schema.field(at).type)
            if "n_chars" in self.names:
                n = self.names.index("n_chars")
                columns[n] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(part.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)


def redact_secrets(documents: DataFrame) -> DataFrame:
    """The same rows and columns with secrets cut out of ``text``; ``n_chars``, where present, follows."""
    return documents.mapInArrow(_Redact(documents.schema), documents.schema)
