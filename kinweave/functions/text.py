"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic (a short list of our own; pass another one where needed).
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "of", "on", "or", "she", "that", "the", "this", "to", "was", "with",
    "de", "la", "le", "les", "et", "un", "une", "des", "du", "der", "die", "das", "und", "ein", "el", "los", "las", "que", "y", "en",
)

#: Emoji and what joins them: pictographs, symbols, flags, dingbats, variation selector, joiner (fixed ranges).
EMOJI = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}\x{20E3}]"


def display(text: Column) -> Column:
    """White space collapsed and trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def label_key(text: Column) -> Column:
    """A label for comparison: collapsed and lower-cased."""
    return F.lower(display(text))


def without_emoji(text: Column) -> Column:
    """Emoji as blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, EMOJI, " "), " {2,}", " "))


def clean(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Lower-cased words of letters a-z without mentions, links, signs, laughter, stopwords and immediate repeats.

    Line breaks and tabs are deleted like other signs, without leaving a blank.
    """
    x = F.lower(text)
    # fixed values: what is cleaned away, in this order
    for pattern, by in (
        (r"@[^ ]+", " "), (r"https?://[A-Za-z0-9./]+", " "), (r"https?:\S+", " "), ("#", " "), (r"www\S+", " "), (r"[/(){}\[\]|@,;.]", " "),
        (r"(?U)\b(?:(?:ah)+a?|(?:ha)+|(?:ja)+)\b", " "), ("[^a-z A-Z]", ""),
    ):
        x = F.regexp_replace(x, pattern, by)
    words = F.array_join(F.filter(F.split(x, " +"), lambda w: (w != "") & ~w.isin(*stopwords)), " ")
    # a word equal to the one before goes
    return F.regexp_replace(words, r"\b(\w+)(?: \1\b)+", "$1")


def tokens(text: Column) -> Column:
    r"""Words (\w of Unicode)."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1))


def filled_name(name: Column, user_id: Column) -> Column:
    """A blank or missing user name becomes ``anonymous<id>``."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("anonymous"), user_id))


def stable_id(prefix: str, *parts: Column) -> Column:
    """The prefix and 16 hex digits of the SHA-256 of the parts joined by ``|``."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 16))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4).cast("int"))


def distinct_keywords(words: Column) -> Column:
    """Trimmed keywords without blanks; of those equal but for case, the first."""
    trimmed = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != "")
    lower = F.transform(trimmed, lambda w: F.lower(w))
    return F.filter(F.transform(trimmed, lambda w, i: F.when(F.array_position(lower, F.lower(w)) == i + 1, w)), lambda w: w.isNotNull())


def strip_html(html: Column) -> Column:
    """Text between tags, each part trimmed, joined without a separator; scripts, styles and comments go."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "<>")
    parts = F.filter(F.transform(F.split(x, "<[^>]*>"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    joined = F.array_join(parts, "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        joined = F.replace(joined, F.lit(entity), F.lit(sign))
    return joined


def legacy_multi_theme(name: Column) -> Column:
    """True if a name is several themes joined by full stops: two segments at least, two of several words."""
    parts = F.split(name, r"\.(?=[A-Z][A-Za-z])")
    return (F.size(parts) >= 2) & (F.size(F.filter(parts, lambda p: F.size(F.split(F.trim(p), r"\s+")) > 1)) >= 2)


def parsed_list(cell: Column) -> Column:
    """A list cell: JSON, quoted literal, else split at commas; blanks and null give an empty list."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    listed = text.startswith("[")
    json = F.from_json(F.when(listed, text), "array<string>")
    literal = F.from_json(F.when(listed, F.translate(text, "'", '"')), "array<string>")
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(json, literal, parts)


def first_entries(cell: Column) -> Column:
    """Entries (key, words) of a JSON object of lists; of a key that is there twice the first counts, which a map can't tell."""
    entry = F.lit(r'"((?:[^"\\]|\\.)*)"\s*:\s*(\[[^\]]*\])')
    keys, lists = F.regexp_extract_all(cell, entry, F.lit(1)), F.regexp_extract_all(cell, entry, F.lit(2))
    pairs = F.arrays_zip(keys.alias("key"), lists.alias("words"))
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.transform(first, lambda p: F.struct(p["key"].alias("key"), F.from_json(p["words"], "array<string>").alias("words")))


def month_number(month: Column) -> Column:
    """1 to 12 from a number, digits or an English month name; null for null, and an error for anything else."""
    names = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    text = F.lower(F.trim(month.cast("string")))
    number = text.try_cast("int")
    at = F.array_position(F.lit(list(names)), text).cast("int")
    return F.coalesce(F.when(number.between(1, 12), number), F.when(at > 0, at), F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("not a month: "), text)).cast("int")))


def period(year: Column, month: Column) -> Column:
    return F.format_string("%04d-%02d", year.cast("int"), month_number(month))


def day_of(text: Column) -> Column:
    """The day of the month from a tuple like ``(2017, 3, 9, 12)``, an ISO text or a date."""
    tuple_day = F.regexp_extract(text, r"^\(\d+,\s*\d+,\s*(\d+)", 1).try_cast("int")
    return F.coalesce(tuple_day, F.dayofmonth(F.try_to_timestamp(text)))


def mock_embedding(text: Column) -> Column:
    """A deterministic vector: words counted by the first byte of their SHA-256 modulo 16, then their number.

    The byte modulo 16 is the second hex digit; digits are counted by what is missing once they are taken out.
    """
    words = F.filter(F.split(F.lower(display(text)), " "), lambda w: w != "")
    digits = F.array_join(F.transform(words, lambda w: F.substring(F.sha2(w.cast("binary"), 256), 2, 1)), "")
    counts = [(F.length(digits) - F.length(F.replace(digits, F.lit(d), F.lit("")))).cast("double") for d in "0123456789abcdef"]
    return F.array(*counts, F.length(digits).cast("double"))


def group_themes(keywords: Column, width: int = 4) -> Column:
    """Unique keywords in groups of ``width``, each named after its first two: a stand-in for a theme provider."""
    unique = distinct_keywords(keywords)
    starts = F.when(F.size(unique) > 0, F.sequence(F.lit(1), F.size(unique), F.lit(width))).otherwise(F.array().cast("array<int>"))
    groups = F.transform(starts, lambda i: F.slice(unique, i, width))
    return F.transform(groups, lambda g: F.struct(F.array_join(F.slice(g, 1, 2), " and ").alias("theme"), g.alias("keywords")))
