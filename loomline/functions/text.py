"""Text columns: normal form, tokens, cue rules, URLs, names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The nine cue rules.
CUES = {
    "VERIFY": r"\b(verif(?:y|ied|ication)|independently check(?:ed)?|cross[- ]check(?:ed)?|confirmed live|byte[- ]exact)\b",
    "PROPOSE": r"\b(i propose|i suggest|we should|let[’']s|how about|recommend(?:ation)?)\b",
    "COORDINATE": r"\b(please (?:check|review|verify|run|publish|take|update)|can you|could you|ready for (?:review|verification)|you[’']re unblocked|assign(?:ed)?|volunteer|join me)\b",
    "ACKNOWLEDGE": r"\b(agreed|received|acknowledged|thanks|thank you|i[’']ll (?:follow|use|adopt)|following your)\b",
    "CHALLENGE": r"\b(disagree|incorrect|not correct|unsupported|unverified|contradict(?:s|ion)?|reliability issue|breach|please exclude)\b",
    "BLOCKED": r"\b(blocked|stuck|unable to|cannot access|can[’']t access|permission denied|timed out|404|propagat(?:ing|ion))\b",
    "REPORT": r"\b(published|deployed|shipped|merged|completed|committed|is live|pushed|finished)\b",
    "RESEARCH": r"\b(research(?:ing|ed)?|investigat(?:e|ing|ed)|look(?:ing)? into|search(?:ing|ed)? for)\b",
    "ABANDON": r"\b(abandon(?:ed|ing)?|dropping (?:this|the)|stop pursuing|shelv(?:e|ed|ing)|no longer pursue)\b",
}
# Words that topics leave out.
STOPWORDS = (
    "the a an and or for to of in is it this that with on as at by from be are was were i we you my our your has have had not "
    "no will can all now new its their they them but if so into more same also than then been about just out up one two three "
    "each any do does did me us he she his her there here these those some only still today update thanks thank please day next "
    "ready goal session agent village http https com org www"
).split()
# The two URL patterns, the path pattern, and the marks that are cut off the ends of URLs of either.
URL = r"https?://[^\s<>\[\]\"`]+"
AUDIT_URL = r"(?i)https?://[^\s\]\[()<>\"']+"
AUDIT_PATH = (
    r"(?iu)(?<![\w])(?:/[^\s,;()<>\"']{2,}|[\w.-]+\.(?:py|js|ts|json|csv|md|txt|pdf|html|ipynb|xlsx|docx))(?![\w])"
)
TRAILING = ".,;:!?)]}’'"
AUDIT_TRAILING = ".,!?;:"
DURATION = r"(?i)\b\d+(?:\.\d+)?\s*(?:ms|milliseconds?|seconds?|secs?|minutes?|mins?|hours?|hrs?|days?)\b"
READ_CLAIM = r"(?i)\b(?:verified[- ]read|observed[- ]read|consumed|consumption|read[- ]verified)\b"


def normal(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def tags(text: Column, rules: dict[str, str] | None = None) -> Column:
    """The names of the rules that match, in the order of the rules."""
    rules = CUES if rules is None else rules
    return F.array_compact(F.array(*[F.when(text.rlike("(?iu)" + r), F.lit(k)) for k, r in rules.items()]))


def tokens(text: Column) -> Column:
    """Words of three letters a-z and more, repeats kept, URLs left out."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, URL, " ")), F.lit("([a-z]{3,})"), 1)


def words(text: Column, stopwords: list[str] | None = None) -> Column:
    """Tokens without the stopwords, which are looked up in a hashed set."""
    stop = STOPWORDS if stopwords is None else stopwords
    return F.filter(tokens(text), lambda w: ~w.isin(stop)) if stop else tokens(text)


def without_trailing(url: Column, marks: str = TRAILING) -> Column:
    return F.regexp_replace(url, "[" + re.escape(marks) + "]+$", "")


def urls(text: Column, pattern: str = URL, marks: str = TRAILING) -> Column:
    """Distinct URLs of a text as they stand, then with trailing marks cut off: two that differ in these stay two."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))
    return F.transform(found, lambda u: without_trailing(u, marks))


def normal_url(url: Column, least_path: int = 0) -> Column:
    """Lower-case scheme and host, path and query as they are, no fragment; null if the path is short."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
    path = F.regexp_extract(url, parts, 3)
    built = F.concat(
        F.lower(F.regexp_extract(url, parts, 1)), F.lit("://"), F.lower(F.regexp_extract(url, parts, 2)), path, F.regexp_extract(url, parts, 4)
    )
    return F.when(url.rlike(parts) & (F.length(path) >= least_path), built)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def name_pattern(names: list[str]) -> str:
    """Longest names first, whole, not beside word characters or hyphens, nor before a dotted suffix."""
    choice = "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))
    return rf"(?iu)(?<![\w-])({choice})(?![\w-]|\.\w)"


def mentions(text: Column, names: list[str]) -> Column:
    """Registered names that a text mentions, each once and as registered. The registry is small: an argument, not a table."""
    if not names:
        return F.array().cast("array<string>")
    canonical = F.create_map(*[x for n in sorted(names) for x in (F.lit(n.lower()), F.lit(n))])
    found = F.regexp_extract_all(text, F.lit(name_pattern(names)), 1)
    return F.array_compact(F.array_distinct(F.transform(found, lambda n: canonical[F.lower(n)])))


def evidence(text: Column, length: int = 2800) -> Column:
    """A text's prefix and whether it was cut."""
    return F.struct(F.left(text, F.lit(length)).alias("text"), (F.length(text) > length).alias("truncated"))


def locator(source: Column, day: Column, index: Column) -> Column:
    """ev-<12 of the source's sha256>-d<day>-e<index>."""
    return F.concat(F.lit("ev-"), F.left(source, F.lit(12)), F.lit("-d"), day.cast("string"), F.lit("-e"), index.cast("string"))


def label_key(label: Column) -> Column:
    """A label in lower case, hyphens and runs of white space as one underscore."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(label), r"(?U)[-\s]+", " ")), " ", "_")


def form_encoded(value: Column) -> Column:
    """A value as in a query string: space as plus, all but letters, digits and ``-_.~`` escaped."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def link(base: str, **fields: Column) -> Column:
    """``base`` and a query string of the fields in their order."""
    parts = [F.concat(F.lit(f"{k}="), form_encoded(F.coalesce(v.cast("string"), F.lit("")))) for k, v in fields.items()]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *parts))


def safe_name(name: str) -> str:
    """A plain file name as it is; raises on a path, on nothing, and on dots alone."""
    if not name or name in (".", "..") or "/" in name or "\\" in name or "\0" in name:
        raise ValueError(f"not a plain file name: {name!r}")
    return name


def first_filled(*columns: Column, default: str | None = None) -> Column:
    """The first value that is neither null nor empty."""
    found = F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
    return found if default is None else F.coalesce(found, F.lit(default))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
