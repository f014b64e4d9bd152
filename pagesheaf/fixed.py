"""Fixed values.

Everything in this file has to equal the values the page format and the documented behaviour
prescribe, so it is stated plainly and in natural order.
"""

from __future__ import annotations

# Elements removed together with their content before anything else.
NONCONTENT_TAGS = ["script", "style", "noscript", "link", "meta"]

# Elements whose content is text and not markup.
RAW_TEXT_TAGS = ["script", "style"]

# Content-root selectors, best first. The fields are tag, exact class and class part;
# None means "any".
CONTENT_SELECTORS = [
    ("div", "notion-page-content", None),
    ("div", "notion-collection-view-body", None),
    (None, None, "notion-collection-view"),
    ("main", None, None),
    ("article", None, None),
]

# Block class, block kind, heading level, ordered list.
BLOCK_VOCABULARY = [
    ("notion-divider-block", "divider", None, None),
    ("notion-header-block", "heading", 1, None),
    ("notion-sub_header-block", "heading", 2, None),
    ("notion-sub_sub_header-block", "heading", 3, None),
    ("notion-callout-block", "quote", None, None),
    ("notion-quote-block", "quote", None, None),
    ("notion-toggle-block", "toggle", None, None),
    ("notion-text-block", "paragraph", None, None),
    ("notion-bulleted_list-block", "list_item", None, False),
    ("notion-numbered_list-block", "list_item", None, True),
]

# Markup hooks inside blocks.
SELECTABLE_CLASS = "notion-selectable"
LIST_MARKER_CLASS = "notion-list-item-box-left"
LEAF_ATTRIBUTE = "data-content-editable-leaf"
CODE_CLASSES = ["line-numbers", "notion-code-block"]
LANGUAGE_ATTRIBUTES = ["data-language", "data-lang", "data-block-language"]
UNKNOWN_BLOCK_CLASS = "notion-unknown-block"
SHIMMER_CLASS = "nds-shimmer-text"
PAGE_CONTENT_CLASS = "notion-page-content"
EXPORT_CLASS = "notion-export"

# Inline emoji images.
EMOJI_CLASS = "notion-emoji"
EMOJI_SOURCE_PART = "notion-emojis"
EMOJI_SOURCE_PREFIX = "data:image/gif"

# Hosts whose addresses are pages rather than files.
PAGE_HOST_REGEX = r"(?i)^https?://((www\.)?notion\.so|[\w-]+\.notion\.site)/"

# Default placeholder phrases and patterns.
PLACEHOLDER_PATTERNS = ["Carregando", "Loading", "Loading code", "(click to open)"]
PLACEHOLDER_REGEX_PATTERNS = [r"\bcarregando\b", r"\bloading\b", r"loading code", r"\(click to open\)"]
PLACEHOLDER_IGNORE_TAGS = ["script", "style"]
PLACEHOLDER_CLASS_KEYWORDS = [
    "shimmer", "loading", "loader", "nds-shimmer", "notion-unknown", "placeholder", "skeleton",
]
PLACEHOLDER_ATTRIBUTE_KEYWORDS = ["loading", "busy", "placeholder", "skeleton", "shimmer", "unknown"]
PLACEHOLDER_ATTRIBUTE_NAMES = ["aria-busy", "data-loading"]
CONTEXT_CHARS = 60

# Substrings that mark a Markdown line as a leftover placeholder.
LINE_PLACEHOLDERS = [
    "carregando",
    "carregando código",
    "carregando código de",
    "loading",
    "loading code",
    "carregando código de plain text",
    "(click to open)",
]

# Round limits.
HEIGHT_STABLE_ROUNDS = 8
HEIGHT_MAX_STEPS = 220
PENDING_STABLE_ROUNDS = 3
PENDING_MAX_ROUNDS = 14
PENDING_PER_ROUND = 80
PHRASE_MAX_ROUNDS = 10
PHRASE_PER_ROUND = 20
MAX_RETRIES = 2

# File naming.
DEFAULT_STEM = "notion_page"
DEFAULT_SUBDOCUMENT = "sub_document"
DEFAULT_RESOURCE = "resource"
DEFAULT_ASSET = "asset"
EMBEDDED_STEM = "embedded"
EMBEDDED_SUFFIX = ".bin"
NAME_LIMIT = 160
FOLDER_TIMESTAMP = "yyyyMMdd-HHmmss"

# HTML element classes used for segmentation (from the HTML standard).
VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
]
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "body", "button", "caption", "dd", "details", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
]
