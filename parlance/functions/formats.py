"""Text that must equal the reference's for identical output.

Kept together, in natural order. Prompt wording is not here: prompts are
written in our own words (``functions/prompts.py``); only the JSON
contracts of the model responses are fixed.
"""

# Text normalisation and dates.
TRIM_CHARS = " \t\n\r\x00\x0b"          # space, tab, newline, CR, NUL, vertical tab
DATE_FMT = "yyyy-MM-dd HH:mm"           # "Y-m-d H:i"
LONG_DATE_FMT = "dd MMM yyyy HH:mm"     # "d M Y H:i"

# Snippets, stars and condensed text.
SNIPPET_WIDTH = 80
ELLIPSIS = "…"
STAR = "★"
MESSAGE_CAP = 1500
MESSAGE_CAP_MARKER = " [...]"
MIDDLE_MARKER = "\n\n[... middle truncated ...]\n\n"

# Placeholders.
NO_REPLY = "(no reply)"
NO_SUMMARY = "(no summary)"
EXPANSION_FAILED = "(Expansion failed for this range.)"
NO_SUMMARY_AVAILABLE = "(no summary available)"

# Document labels.
H1 = "# "
H2 = "## "
RULE = "---"
TABLE_HEAD = "| Field | Value |"
TABLE_RULE = "|-------|-------|"
ROW_CREATED = "| Created | "
ROW_UPDATED = "| Updated | "
ROW_MESSAGES = "| Messages | "
FROM_USER = " from user) |"
ROW_RELEVANCE = "| Relevance | "
ROW_CATEGORIES = "| Categories | "
ROW_TAGS = "| Tags | "
CELL_END = " |"
SUMMARY = "**Summary**: "
KEY_FACTS = "**Key facts**:"
KEY_FACTS_DECISIONS = "**Key facts & decisions**:"
KEY_FACTS_ENHANCED = "**Key Facts & Decisions**:"
TAGS = "**Tags**: "
DATE = "**Date**: "
UPDATED = " | **Updated**: "
RELEVANCE = " | **Relevance**: "
MESSAGES = " | **Messages**: "
EXPORTED = "Exported: "
GENERATED = "Generated: "
CONVERSATIONS = "Conversations: "
MIN_RELEVANCE = "Minimum relevance: "
CONTEXT_TITLE = "# Context Package: "
ENHANCED_TITLE = "# Enhanced Context Package: "
DIGEST = "**Conversation Digest** *(message-pair one-liners)*:"
DEEP_DIVE = "**Deep-Dive Sections**:"
EXCHANGES = "### Exchanges "
CREATED_LINE = "_Created: "
USER_HEADING = "### 🧑 User"
ASSISTANT_HEADING = "### 🤖 Assistant"
ASK_TITLE = "# Ask: "
GENERATED_LINE = "_Generated: "
SOURCES = "## Sources"
SOURCE_OPEN = "- **"
SOURCE_MID = "** ("
STUB_SUMMARY = "**Summary:** "
STUB_FACTS = "**Key facts:**"
STUB_TAGS = "**Tags:** "

# Numbers and word lists.
HISTOGRAM_BINS = [("0.0-0.2", 0.2), ("0.2-0.4", 0.4), ("0.4-0.6", 0.6), ("0.6-0.8", 0.8), ("0.8-1.0", None)]
HIGH_RELEVANCE = 0.7
KEYWORD_SCORE = 0.5
DEFAULT_SCORE = 0.5
FIRST_USER_MESSAGES = 5
MAX_TAGS = 10
USER_JOIN = "\n\n"
STOP_WORDS = ["and", "the", "of", "in", "for", "a", "an", "to", "with", "&", "/"]

# Defaults of the runs.
MIN_MESSAGES = 4
LABEL_CHARS = 8000
PAIR_BATCH = 3
EXPLORE_SAMPLE = 50
EXPLORE_BATCH = 5
EXPLORE_CHARS = 600
ASK_BATCH = 3
MIN_RELEVANCE_DEFAULT = 0.3

# Fixed value: characters that take two display columns (East Asian wide and full-width ranges).
WIDE_CHARACTERS = (
    r"[\x{1100}-\x{115F}\x{11A3}-\x{11A7}\x{11FA}-\x{11FF}\x{2329}-\x{232A}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}"
    r"\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{A960}-\x{A97C}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE10}-\x{FE19}\x{FE30}-\x{FE6B}"
    r"\x{FF01}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1B000}-\x{1B001}\x{1F200}-\x{1F251}\x{20000}-\x{2FFFD}\x{30000}-\x{3FFFD}]"
)

# Patterns of response cleanup.
FENCE_BLOCK = r"(?si)```(?:json)?\s*(.*?)\s*```"
FENCE_OPEN = r"(?m)^```(?:json)?\s*"
FENCE_CLOSE = r"(?m)```\s*$"
REASONING = r"(?s)<think>.*?</think>"
