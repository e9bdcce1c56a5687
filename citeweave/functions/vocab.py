"""Word lists and constants that fix the meaning of search and answers."""

# Fixed values.
STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "from", "into", "your", "have", "what", "when", "where", "which",
    "about", "there", "their", "them", "then", "will", "would", "should", "could", "does", "using", "only", "page", "pages",
)

# Words that share a stem; the stem comes first.
STEMS = (
    ("cure", "cures", "cured", "curing"),
    ("water", "waters", "watered", "watering"),
    ("lay", "lays", "layed", "laying"),
    ("compact", "compacts", "compacted", "compacting", "compaction"),
    ("mix", "mixes", "mixed", "mixing"),
    ("tool", "tools"),
    ("method", "methods"),
    ("rammer", "rammers"),
    ("vibrator", "vibrators"),
    ("aggregate", "aggregates"),
    ("application", "applications"),
    ("day", "days"),
    ("week", "weeks"),
    ("hour", "hours"),
)

# Question vocabularies, compared with stemmed terms.
PROCEDURE_TERMS = ("apply", "build", "compact", "cure", "install", "lay", "mix", "prepare", "process", "procedure", "step")
VALUE_TERMS = ("cost", "day", "estimate", "hour", "inr", "kg", "measurement", "mm", "percent", "price", "quantity", "ratio", "thick", "thickness", "value", "week")
COMPOSITION_TERMS = ("aggregate", "ash", "booster", "composition", "mix", "ratio", "sand", "water")
TOOLING_TERMS = ("bamboo", "compact", "manual", "mechanical", "method", "rammer", "tool", "vibrator")
#: Answers count one procedure word more than search does.
ANSWER_PROCEDURE_TERMS = (*PROCEDURE_TERMS, "start")

# Labels shown for chunk types and document statuses.
CHUNK_TYPE_LABELS = {"faq": "FAQ", "procedure": "Procedure", "table": "Table", "warning": "Warning", "list": "List"}
STATUS_LABELS = {"uploaded": "Queued", "parsing": "Parsing PDF", "chunking": "Building sections", "embedding": "Embedding chunks", "ready": "Ready", "failed": "Failed"}
STATUSES = tuple(STATUS_LABELS)

# Limits.
INGESTION_VERSION = 3
VECTOR_DIMENSIONS = 3072
CHUNK_TARGET_TOKENS = 800
CANDIDATES, MERGED, CHAT_LIMIT, SEARCH_LIMIT = 24, 32, 12, 8
MAX_UPLOAD_MB = 50
