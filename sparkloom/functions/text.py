"""Text as Column expressions: tokens, shapes, redaction, estimates. All run on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns by name. Tokens are lower-cased; a minimum length of two holds but for "memory".
TOKEN_PATTERNS = {
    "table": r"[\p{L}\p{N}]+|[A-Za-z0-9_./:-]+",
    "segment": r"[A-Za-z_][A-Za-z0-9_.:/-]{1,}",
    "session": r"[\p{L}\p{N}_./:-]+",
    "word": r"[a-z]+",
    "memory": r"[\p{L}\p{N}_.-]+",
    "plan": r"[A-Za-z0-9_./:-]+",
    "graph": r"[A-Za-z0-9_./:@-]+",
    "tool": r"[a-z0-9]+",
}
# Line classes.
ERROR_LINE = r"(?i)\b(error|failed|failure|panic|assertion|traceback|exception|fatal|denied|timeout|critical|segfault)\b"
WARNING_LINE = r"(?i)\b(warn(?:ing)?|deprecated|retry|throttl)\b"
LOCATION = r"(?:[A-Za-z0-9_./\\-]{1,512}\.(?:py|rs|js|jsx|ts|tsx|java|cs|go|rb|php|lua|luau|cpp|c|h|hpp):\d+(?::\d+)?|line \d+)"
CODE_SYMBOL = r"^\s*(?:class |def |async def |function |export |pub fn |fn |interface |struct |enum |impl )"
NUMBER_SHAPE = r"(?i)\b(?:0x[0-9a-f]+|\d+(?:\.\d+)?)\b"
# Letters that look like Latin ones, and what they look like.
CONFUSABLE = "аеорсухΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
CONFUSABLE_LATIN = "aeopcyxABEZHIKMNOPTYX"
# Query intents, first match wins.
INTENTS = [
    ("anomaly", ["anomaly", "outlier", "abnormal", "hata", "aykırı"]),
    ("trend", ["trend", "over", "time", "zaman", "artış", "azalış"]),
    ("count", ["count", "how", "many", "kaç", "sayı"]),
    ("compare", ["compare", "versus", "difference", "kıyasla", "karşılaştır"]),
    ("root-cause", ["root", "cause", "why", "neden", "sebep"]),
    ("lookup", ["find", "record", "id", "bul", "kayıt"]),
]


def tokens(text: Column, kind: str = "table", least: int = 2) -> Column:
    """Lower-cased tokens in order, with repeats; those shorter than `least` are dropped: by the pattern itself where it is a run of one class."""
    pattern = TOKEN_PATTERNS[kind]
    if pattern.startswith("[") and pattern.index("]") == len(pattern) - 2 and pattern.endswith("+"):
        return F.regexp_extract_all(F.lower(text), F.lit(f"{pattern[:-1]}{{{max(1, least)},}}"), F.lit(0))
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= least)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for a row, though lambdas in the body use it for each element."""
    return F.transform(F.array(value), body)[0]


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def session_normal(text: Column) -> Column:
    """Lower case, camel case split, hyphens and underscores as spaces."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " ")), "[_-]+", " ")


def grams(plain: Column) -> Column:
    """Distinct character 3-grams of a text; a shorter text is its own only one."""
    # Characters first: a substring by number walks a UTF-8 text from its start.
    made = let(F.split(plain, ""), lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 2, F.lit(1))), lambda i: F.array_join(F.slice(c, i, F.lit(3)), "")))
    return F.filter(F.array_distinct(made), lambda g: g != "")


def gram_list(text: str) -> list[str]:
    """The same of a Python text, as session texts are normalised."""
    import re

    low = re.sub("[_-]+", " ", re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", text).lower())
    plain = re.sub(r"[ \t\n\x0b\f\r]+", " ", low).strip(" ")
    return [g for g in dict.fromkeys(plain[i : i + 3] for i in range(max(len(plain) - 2, 1))) if g]


def trigrams(text: Column) -> Column:
    """Distinct character 3-grams of the collapsed lower-case text; a shorter text is its own only one."""
    return grams(collapse(session_normal(text)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap(a: Column, query: list[str]) -> Column:
    """How many of the query's distinct tokens are among a's."""
    return F.size(F.array_intersect(a, F.array(*map(F.lit, dict.fromkeys(query)))))


def token_estimate(text: Column) -> Column:
    """A token for every four bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def lines(text: Column) -> Column:
    """Lines after unifying their ends."""
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def strip_ansi(text: Column) -> Column:
    """Without terminal escapes and zero-width characters."""
    hidden = "​‌‍⁠﻿"
    plain = lambda t: F.when(F.contains(t, F.lit("\x1b")), F.regexp_replace(t, "\x1b(?:[@-_][0-?]*[ -/]*[@-~]|\\][^\x07]*(?:\x07|\x1b\\\\))", "")).otherwise(t)
    return let(text, lambda t: let(plain(t), lambda p: F.when(p.rlike(f"[{hidden}]"), F.translate(p, hidden, "")).otherwise(p)))


def skeleton(text: Column) -> Column:
    return F.translate(text, CONFUSABLE, CONFUSABLE_LATIN)


def truncated(text: Column, limit: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(mark))).otherwise(text)


def excerpt(text: Column, limit: int) -> Column:
    """Three quarters from the head, a quarter from the tail."""
    cut = F.concat(F.left(text, F.lit(limit * 3 // 4)), F.lit(" … "), F.right(text, F.lit(limit // 4)))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def log_shape(line: Column) -> Column:
    return F.regexp_replace(line, NUMBER_SHAPE, "<n>")


def line_class(line: Column) -> Column:
    return F.when(line.rlike(ERROR_LINE), "error").when(line.rlike(WARNING_LINE), "warning").otherwise("info")


def shannon_entropy(text: Column) -> Column:
    """Bits a character; 0 for empty texts."""
    shares = let(F.split(text, ""), lambda chars: F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)))
    bits = F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(bits)


def intent(query: Column) -> Column:
    own = tokens(query)
    out = None
    for name, words in INTENTS:
        hit = F.arrays_overlap(own, F.array(*map(F.lit, words)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("overview")


def distinct_lines(text: Column) -> Column:
    """Non-blank lines, trimmed, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x != ""))


def sentences(text: Column) -> Column:
    """Distinct sentences in order."""
    parts = F.split(collapse(text), r"(?<=[.!?])\s+")
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def head_tail(items: Column, head: int, tail: int) -> Column:
    """The first and last items of an array, with a mark for those left out."""
    n = F.size(items)
    left = F.concat(F.lit("… "), (n - head - tail).cast("string"), F.lit(" omitted …"))
    return F.when(n <= head + tail, items).otherwise(F.concat(F.slice(items, 1, head), F.array(left), F.slice(items, -tail, tail)))
