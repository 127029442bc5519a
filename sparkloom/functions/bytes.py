"""Bytes, encodings, paths and addresses; what expressions can't say runs in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Languages by file suffix and by name of the file, and interpreters of a first line.
SUFFIXES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go", "java": "java", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "rb": "ruby", "php": "php", "lua": "lua", "luau": "luau", "sql": "sql", "sh": "shell", "html": "html", "css": "css", "json": "json", "md": "markdown"}
FILENAMES = {"makefile": "make", "dockerfile": "dockerfile", "cmakelists.txt": "cmake", "gemfile": "ruby", "rakefile": "ruby"}
INTERPRETERS = {"python": "python", "node": "javascript", "bash": "shell", "sh": "shell", "ruby": "ruby", "perl": "perl"}


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def folded(text: Column) -> Column:
    """NFKC and case folding: on the JVM for ASCII, by a pandas function otherwise."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(_folded(text))


def utf8_prefix(text: Column, limit: int, mark: str = "") -> Column:
    """The longest prefix of whole characters within `limit` bytes: the cut steps back over at most three bytes of one."""
    raw = text.cast("binary")
    whole = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, limit - i).cast("string")) for i in range(4)])
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(whole, F.lit(mark)))


def replace_all(text: Column, pairs: dict[str, str]) -> Column:
    """Replacements of fixed strings, longest first."""
    for old in sorted(pairs, key=lambda k: (-len(k), k)):
        text = F.replace(text, F.lit(old), F.lit(pairs[old]))
    return text


def is_binary(data: Column) -> Column:
    """A zero byte, or bytes that aren't UTF-8, in the first 8 KiB (a character cut at its end aside)."""
    head = F.substring(data, 1, 8192)
    valid = F.coalesce(*[F.try_validate_utf8(F.substring(head, F.lit(1), F.greatest(F.octet_length(head) - i, F.lit(0))).cast("string")) for i in range(4)])
    return F.hex(head).rlike("^(?:..)*?00") | valid.isNull()


def language(path: Column, text: Column) -> Column:
    """By the file's name, then its suffix, then its first line, else unknown with the suffix."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    suffix = F.regexp_extract(name, r"\.([a-z0-9]+)$", 1)
    first = F.regexp_extract(text, r"^#!\s*(?:\S*/)?([a-z]+)", 1)
    second = F.regexp_extract(text, r"^#!\s*\S*env\s+([a-z]+)", 1)
    program = F.when(second != "", second).otherwise(first)
    return F.coalesce(F.try_element_at(pick_map(FILENAMES), name), F.try_element_at(pick_map(SUFFIXES), suffix), F.try_element_at(pick_map(INTERPRETERS), program), F.concat(F.lit("unknown:"), F.when(suffix != "", suffix).otherwise("text")))


def pick_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def minified(text: Column) -> Column:
    """One line over 10 000 characters, or fewer than 8 lines of over 1 500 on average."""
    sizes = F.transform(F.split(text, "\n"), F.length)
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    return (F.array_max(sizes) > 10_000) | ((F.size(sizes) < 8) & (total / F.size(sizes) > 1500))


def address(uri: Column) -> Column:
    """scheme, authority and path parts of a hierarchical address; null where it isn't one."""
    parts = F.filter(F.split(F.regexp_extract(uri, r"^[a-z][a-z0-9+.-]*://[^/]*/(.*)$", 1), "/"), lambda x: x != "")
    ok = uri.rlike(r"^[a-z][a-z0-9+.-]*://[^/]+") & ~uri.rlike(r"/\.\.?(?:/|$)")
    return F.when(ok, F.struct(F.regexp_extract(uri, "^([a-z][a-z0-9+.-]*):", 1).alias("scheme"), F.regexp_extract(uri, "://([^/]*)", 1).alias("authority"), parts.alias("parts")))
