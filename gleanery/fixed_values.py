"""Word lists, limits and texts that results depend on."""

# --- fixed values: character classes -------------------------------------
# White space as the web platform defines it (Java's \s is ASCII only).
SPACE_CHARS = r"\t-\r\p{Z}\x{FEFF}"
SPACE = "[" + SPACE_CHARS + "]"
NOT_SPACE = "[^" + SPACE_CHARS + "]"
# The same set as plain characters, for trimming.
SPACE_TEXT = "".join(
    chr(code)
    for code in (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
                 0x3000, 0xFEFF)
)
LINE_END_CHARS = r"\n\r\x{2028}\x{2029}"
# ASCII word boundary after a word; Java's \b also counts accented letters.
WORD_END = "(?![A-Za-z0-9_])"
WORD_START = "(?<![A-Za-z0-9_])"
ELLIPSIS = "…"

# --- fixed values: markup -------------------------------------------------
BLOCK_TAGS = ("p", "div", "section", "article", "br", "li", "ul", "ol", "h[1-6]")
ENTITIES = (  # order matters: an escaped ampersand is decoded before the rest
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
)

# --- fixed values: scoring and classification words -----------------------
AI_WORDS = ("ai", "llm", "model", "agent", "openai", "anthropic")
AGGREGATION_WORDS = ("summary", "roundup", "linkdump")
CLASSIFICATION_RULES = (  # label, topic, tags, words; the first match wins
    ("research", "Research", ("research", "analysis"),
     ("research", "paper", "study", "benchmark", "report")),
    ("product-update", "Product updates", ("product", "release"),
     ("release", "launch", "shipped", "announced", "announcement", "beta")),
    ("tutorial", "Guides", ("tutorial", "guide"),
     ("tutorial", "guide", "walkthrough", "how to")),
    ("news", "News", ("news",),
     ("news", "update", "roundup", "round-up")),
)

# --- fixed values: reading-queue policy -----------------------------------
POLICY_VERSION = "v2"
SELECTION_BUDGET = 8
CANDIDATE_WINDOW = 64
MAX_PER_TOPIC = 2
MAX_PER_SOURCE = 3
MIN_REVIEW_SCORE = 0.62
GREETING = (r"(?i)^(hi|hello|hey|good (morning|afternoon|evening)|dear)" + WORD_END)
PROMOTION = r"(?i)^listen to this update" + WORD_END
ROUNDUP_TITLE = r"(?i)(roundup|linkdump|daily digest|weekly digest|briefing)"

# --- fixed values: enrichment processing ----------------------------------
PROCESSING_ORDER = ("score", "dedupe", "summarize", "classify", "group", "preserve")
PROCESSING_VERSION = "v1"
RECOMMENDATIONS = ("keep", "discard", "review")

# --- fixed values: page capture -------------------------------------------
MAX_REDIRECTS = 5
FETCH_TIMEOUT_MS = 15000
EXTRACTOR_NAME = "article-region"
EXTRACTOR_VERSION = "first-pass"
USER_AGENT = "GleaneryPageCapture/0.1"

# --- fixed values: note destinations --------------------------------------
DEFAULT_DESTINATIONS = (  # type, name, target
    ("notion", "Notion Knowledge", "notion://gleanery/default"),
    ("obsidian", "Obsidian Knowledge", "obsidian://gleanery/default"),
)

# --- fixed values: enumerations -------------------------------------------
ENUMS = {
    "source_type": ("rss",),
    "source_status": ("active", "paused", "error"),
    "entry_type": ("source_sync", "manual_link", "url_submission"),
    "entry_status": ("captured", "normalized", "failed"),
    "asset_type": ("url", "article"),
    "asset_status": ("new", "normalized", "failed"),
    "item_type": ("article",),
    "item_status": ("new", "processed", "archived"),
    "preserve_recommendation": RECOMMENDATIONS,
    "group_type": ("topic",),
    "note_type": ("reference", "summary"),
    "destination_type": ("notion", "obsidian"),
    "destination_status": ("active", "disabled", "error"),
}
