"""Text expressions: all are Column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The English stop words that search drops.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "this",
    "to", "was", "will", "with",
)

#: Fixed value: runs of white space (with the Unicode spaces that JavaScript's \s has) or of these signs part tokens.
TOKEN_BREAK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\-_@.,:;!?(){}\[\]<>/\\|\"'`~]+"
#: Markers of comments, in the order in which they are listed.
MARKERS = ("TODO", "FIXME", "NOTE", "HACK", "XXX", "BUG")
#: Fixed value: what counts as a file path in a code span.
FILE_PATH = r"^(?:\.{0,2}/)?(?:[A-Za-z0-9_-]+/)*[A-Za-z0-9_-]+\.[A-Za-z0-9_]+$"
#: Fixed value: a capitalised identifier in backticks.
SYMBOL_MENTION = r"`([A-Z][a-zA-Z0-9_]*)`"


def raw_tokens(text: Column) -> Column:
    """Lower-cased pieces between breaks; may begin or end with an empty one."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK)


def is_token(token: Column) -> Column:
    return (token != "") & ~token.isin(*STOP_WORDS)


def tokens(text: Column) -> Column:
    """Array of a text's tokens, in order. Prefer exploding raw_tokens on hot paths: this one is interpreted."""
    return F.filter(raw_tokens(text), is_token)


def normalize_code(code: Column) -> Column:
    """Trimmed lines without blank ones and without whole-line // or # comments, joined again."""
    lines = F.transform(F.split(code, "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("#")), "\n")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, in code points; two empty texts are alike."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longer)


def link_type(url: Column) -> Column:
    return F.when(url.rlike("^(https?:)?//"), "external").otherwise("internal")


def file_path_in(code_span: Column) -> Column:
    """The trimmed span if it has the form of a file path, else null."""
    trimmed = F.trim(code_span)
    return F.when(trimmed.rlike(FILE_PATH), trimmed)


def symbol_mentions(markdown: Column) -> Column:
    return F.regexp_extract_all(markdown, F.lit(SYMBOL_MENTION), F.lit(1))


def marker_of(comment: Column) -> Column:
    """The leftmost marker followed by a colon, else null."""
    return F.nullif(F.regexp_extract(comment, f"({'|'.join(MARKERS)}):", 1), F.lit(""))


def extension_of(path: Column) -> Column:
    """Lower-cased extension with its dot, '' where the last segment has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def occurrences(line: Column, name: str) -> Column:
    """0-based columns of every occurrence, overlapping ones included; none for an empty name.

    A split before each place where the name starts (it consumes nothing) gives pieces whose lengths add up to the columns,
    so a line is searched once whatever its length."""
    none = F.array().cast("array<int>")
    if not name:
        return none
    quoted = name.replace("\\E", "\\E\\\\E\\Q")
    pieces = F.split(line, f"(?=\\Q{quoted}\\E)")
    ends = F.aggregate(
        F.transform(pieces, lambda x: F.char_length(x)),
        F.struct(F.lit(0).alias("at"), none.alias("ends")),
        lambda done, n: F.struct((done["at"] + n).alias("at"), F.concat(done["ends"], F.array(done["at"])).alias("ends")),
    )
    # A piece starts at each occurrence, and the first piece at 0, where the name may be or not.
    return F.when(~line.contains(name), none).when(line.startswith(name), ends["ends"]).otherwise(F.slice(ends["ends"], 2, F.greatest(F.lit(0), F.size(pieces) - 1)))


def cache_key(query: Column) -> Column:
    return F.lower(F.trim(query))
