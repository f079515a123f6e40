"""Lines, terms and normal forms of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by file extension (fixed values).
LANGUAGES = {
    ".go": "go", ".md": "markdown", ".sql": "sql",
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript",
    ".yml": "yaml", ".yaml": "yaml", ".json": "json",
}
MAX_TERMS = 32


def language_of(path: Column) -> Column:
    """Language by the last extension, empty where it is not known."""
    extension = F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension), F.lit(""))


def line_count(text: Column) -> Column:
    """Line terminators, and one more where the last byte is none; 0 for empty text."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (breaks + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)).cast("int")


def has_tokens(text: Column) -> Column:
    """Whether there is a letter or a digit."""
    return text.rlike(r"[\p{L}\p{Nd}]")


def indexable(path: Column, text: Column) -> Column:
    """A known language, and no NUL in the body."""
    return (language_of(path) != "") & (F.instr(text, F.decode(F.unhex(F.lit("00")), "UTF-8")) == 0)


def last_segment(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def exported(symbol: Column) -> Column:
    """Whether every dotted part begins with an upper-case letter."""
    return F.forall(F.split(symbol, r"\."), lambda s: s.rlike(r"^\p{Lu}"))


def camel_spaced(word: Column) -> Column:
    """Spaces before an upper-case letter after another kind, and before the last capital of a run that lower case follows."""
    once = F.regexp_replace(word, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.regexp_replace(once, r"([^\p{Lu} ])(\p{Lu})", "$1 $2")


def terms(question: Column, split_identifiers: bool, most: int = MAX_TERMS) -> Column:
    """The first ``most`` different words in lower case; with ``split_identifiers`` each followed by its camel parts."""
    runs = F.regexp_extract_all(question, F.lit(r"([\p{L}\p{Nd}]+)"), 1)
    if split_identifiers:
        runs = F.flatten(F.transform(runs, lambda w: F.concat(F.array(w), F.split(camel_spaced(w), " "))))
    return F.slice(F.array_distinct(F.transform(runs, F.lower)), 1, most)


def normalised(text: Column) -> Column:
    """Lower case, every run of other than letters and digits one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "))


def holds_phrase(text: Column, phrase: Column) -> Column:
    """Whole-phrase containment in normal form; an empty phrase is nowhere."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def lines_of(text: Column) -> Column:
    """Lines without terminators; one trailing terminator opens no line, blank text has none, ``\\r`` stays."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(F.trim(F.regexp_replace(text, r"\s", " ")) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def slug(remote: Column) -> Column:
    """Owner and name of a remote as part of a file name; ``unknown`` where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(remote, "^https://", ""), r"\.git$", "")
    parts = F.split(bare, "/")
    kept = F.when(F.size(parts) >= 3, F.slice(parts, -2, 2)).otherwise(parts)
    name = F.regexp_replace(F.lower(F.array_join(kept, "-")), "[^a-z0-9._-]", "-")
    return F.when(name == "", "unknown").otherwise(name)


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("int")
