"""Text column functions.  All are built-in expressions: no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the behaviour being reproduced.
#
# Whitespace: the characters Python's str.split() treats as separators, as one
# regex class that means the same in Java regex and RE2.
_NOT_SPACE = (
    r"\x09-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Most characters are seen not to begin a run at a glance; a single space before one of
# them stays as it is, so it is not matched.
WHITESPACE_RUN = rf"(?![!-~]| [!-~])[\x20{_NOT_SPACE}]+"
# Keyword tokens: runs of ASCII letters and digits in lower-cased text.
TOKEN_PATTERN = "[a-z0-9]+"
# Stop words dropped from keyword token sets.
STOPWORDS = (
    "a", "an", "the", "is", "are", "do", "does", "how", "what", "why", "of",
    "in", "on", "for", "to", "and", "or", "with", "this", "that", "these",
    "those", "work", "works", "about", "can", "you",
)
# Tokens of length <= MIN_TOKEN_LEN are dropped.
MIN_TOKEN_LEN = 2
# Separator placed between title and abstract for the encoder.
DOCUMENT_SEP = "[SEP]"
# Number of authors shown in a paper label before "et al.".
LABEL_AUTHORS = 3
# Numbered result listing: position, score to three places, title, then id and link.
LISTING_FORMAT = "%d. [%.3f] %s\n   %s - %s"
# ---------------------------------------------------------------------------

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_whitespace(x) -> Column:
    """Collapse every whitespace run to one space and strip the ends."""
    return F.trim(F.regexp_replace(_c(x), WHITESPACE_RUN, " "))


def first_line(x) -> Column:
    return F.substring_index(_c(x), "\n", 1)


def stopword_array() -> Column:
    return F.array(*[F.lit(w) for w in STOPWORDS])


def tokenize(x) -> Column:
    """Distinct keyword tokens: lower-case, ASCII alphanumeric runs, no stop
    words, longer than MIN_TOKEN_LEN.  Order is first appearance."""
    words = F.regexp_extract_all(F.lower(_c(x)), F.lit(TOKEN_PATTERN), 0)
    stop = stopword_array()
    kept = F.filter(words, lambda w: (F.length(w) > MIN_TOKEN_LEN) & ~F.array_contains(stop, w))
    return F.array_distinct(kept)


def ascii_lower(x) -> Column:
    """Lower-case A-Z only, leaving every other character as is (the
    case-insensitive match used for title search folds ASCII only)."""
    return F.translate(_c(x), _UPPER, _LOWER)


def title_contains(title, term: str) -> Column:
    """Case-insensitive (ASCII) substring test."""
    return F.contains(ascii_lower(title), F.lit(term.translate(str.maketrans(_UPPER, _LOWER))))


def paper_label(arxiv_id, title, authors) -> Column:
    """"[id] title (a, b, c et al.)" with at most LABEL_AUTHORS names."""
    authors = _c(authors)
    shown = F.array_join(F.slice(authors, 1, LABEL_AUTHORS), ", ")
    more = F.when(F.size(authors) > LABEL_AUTHORS, F.lit(" et al.")).otherwise(F.lit(""))
    return F.concat(F.lit("["), _c(arxiv_id), F.lit("] "), _c(title), F.lit(" ("), shown, more,
                    F.lit(")"))


def document_text(title, abstract, sep: str = DOCUMENT_SEP) -> Column:
    """Encoder input: title, separator, abstract."""
    return F.concat(_c(title), F.lit(sep), _c(abstract))


def result_listing(position, score, title, arxiv_id, abs_url) -> Column:
    """"1. [0.033] Title" and an indented "id - link" line."""
    return F.format_string(LISTING_FORMAT, _c(position), _c(score), _c(title), _c(arxiv_id), _c(abs_url))
