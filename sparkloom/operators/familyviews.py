"""Small views of texts by their own family: selections of lines as column functions; JSON and tables, which need a parser, in Arrow batches."""

from __future__ import annotations

import csv
import io
import json
from collections import deque
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.bytes import utf8_prefix
from ..functions.jsonbound import Bounds, bound
from . import security

# What ends a line or a sentence, and marks problems, frames, tags, numbers and a diff's heads.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
SENTENCE_END = r"(?U)(?<=[.!?])\s+|\n+"
PROBLEM = r"(?iU)\b(error|failed|failure|panic|assertion|traceback|exception|fatal|denied)\b"
FRAME = r"""(?U)File "[^"]+", line \d+|\bat [\w.$<>]+\([^)]*:\d+\)|[^\s:]+\.(?:py|rs|js|ts|java|cs|go|rb|php):\d+"""
TAG = r"(?U)</?([A-Za-z_:][\w:.-]*)"
NUMBER = r"(?U)\b\d+(?:\.\d+)?\b"
DIFF_HEAD = r"^(?:index |diff --git|@@ |--- |\+\+\+ )"
# How much of what is shown.
JSON_BOUNDS = Bounds(keys=40, items=12, head=5, tail=3, chars=500, lead=240, trail=120, depth=5, deep=lambda v: f"<{type(v).__name__}:{len(v)}>", omitted="<omitted_keys>", ends=("<array_length>", "<head>", "<tail>"))
ROWS, LAST_ROWS, WIDEST = 5, 2, 30
PROBLEMS, SHAPES, FRAMES, HEADS, CHANGES, TAGS, LETTERS, BLOCKS, SYMBOLS, SENTENCES, LAST_SENTENCES = 40, 50, 40, 80, 120, 50, 4000, 10, 100, 20, 8


def _lines(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def _full(parts: Column) -> Column:
    return F.filter(F.transform(parts, _strip), lambda x: x != "")


def _has(parts: Column, pattern: str) -> Column:
    return F.filter(parts, lambda x: x.rlike(pattern))


def _label(*parts: Column | str) -> Column:
    return F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _rest(n: Column, what: str) -> Column:
    return F.when(n > 0, _label("… ", n, f" {what} externalized …")).otherwise(F.array().cast("array<string>"))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.concat(*parts), "\n")


def log_view(text: Column) -> Column:
    """Lines that name problems, and the shapes of lines, whose numbers count as alike, by first appearance."""

    def shown(own: Column) -> Column:
        shapes = F.transform(own, lambda x: F.regexp_replace(x, NUMBER, "<n>"))
        bad = F.array_distinct(F.slice(_has(own, PROBLEM), 1, PROBLEMS))
        critical = F.when(F.size(bad) > 0, F.concat(_label("Critical:"), bad)).otherwise(F.array().cast("array<string>"))
        counted = lambda all_: lambda kinds: _joined(
            _label("Log lines: ", F.size(_lines(text)), " | Unique event shapes: ", F.size(kinds)),
            critical,
            _label("Event shapes:"),
            F.transform(F.slice(kinds, 1, SHAPES), lambda s: F.concat(F.lit("["), F.size(F.filter(all_, lambda x: x == s)).cast("string"), F.lit("x] "), s)),
            _rest(F.size(kinds) - SHAPES, "event shapes"),
        )
        return tx.let(shapes, lambda all_: tx.let(F.array_distinct(all_), counted(all_)))

    return tx.let(_full(_lines(text)), shown)


def stack_view(text: Column) -> Column:
    """The last line that names a problem, and the different frames."""
    own = F.filter(F.transform(_lines(text), lambda x: F.regexp_replace(x, r"(?U)\s+\z", "")), lambda x: _strip(x) != "")
    root = lambda rows: F.coalesce(F.try_element_at(_has(rows, PROBLEM), F.lit(-1)), F.try_element_at(rows, F.lit(-1)), F.lit(""))
    frames = lambda rows: tx.let(_has(rows, FRAME), lambda f: _joined(_label("Root cause: ", root(rows)), _label("Frames: ", F.size(f), " (", F.size(F.array_distinct(f)), " unique)"), F.slice(F.array_distinct(f), 1, FRAMES)))
    return tx.let(own, frames)


def diff_view(text: Column) -> Column:
    """The heads of files and hunks, then the lines that came or went."""
    changed = lambda rows: F.filter(rows, lambda x: x.rlike("^[+-]") & ~x.rlike(r"^(?:\+\+\+|---)"))
    shown = lambda rows: lambda moved: _joined(_label("Diff lines: ", F.size(rows), " | Changed lines: ", F.size(moved)), F.slice(_has(rows, DIFF_HEAD), 1, HEADS), F.slice(moved, 1, CHANGES), _rest(F.size(moved) - CHANGES, "changed lines"))
    return tx.let(_lines(text), lambda rows: tx.let(changed(rows), shown(rows)))


def markup_view(text: Column) -> Column:
    """Tags by number, and the text between them."""
    counts = lambda tags: F.transform(F.slice(F.array_sort(F.array_distinct(tags)), 1, TAGS), lambda t: F.concat(t, F.lit("="), F.size(F.filter(tags, lambda x: x == t)).cast("string")))
    plain = _strip(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"(?U)\s+", " "))
    return F.concat(F.lit("Tags: "), F.array_join(tx.let(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), counts), ", "), F.lit("\nText: "), F.left(plain, F.lit(LETTERS)))


def passages_view(text: Column) -> Column:
    """The blocks of the most different words, earlier ones first where they tie."""
    words = lambda b: F.size(F.array_distinct(F.regexp_extract_all(F.lower(b), F.lit(r"(?U)\w+"), F.lit(0))))
    ranked = lambda blocks: F.array_sort(F.transform(blocks, lambda b, i: F.struct((-words(b)).alias("n"), i.alias("i"), b.alias("b"))))
    return F.array_join(F.transform(F.slice(tx.let(_full(F.split(text, r"\n{2,}")), ranked), 1, BLOCKS), lambda x: x["b"]), "\n\n---\n\n")


def code_view(text: Column) -> Column:
    """Lines that define symbols, with their numbers."""
    numbered = lambda rows: F.filter(F.transform(rows, lambda x, i: F.struct((i + 1).alias("i"), x.alias("x"))), lambda y: y["x"].rlike(tx.CODE_SYMBOL))
    shown = lambda rows: tx.let(numbered(rows), lambda s: _joined(_label("Lines: ", F.size(rows), " | Symbols: ", F.size(s)), F.transform(F.slice(s, 1, SYMBOLS), lambda y: F.concat(y["i"].cast("string"), F.lit(": "), _strip(y["x"])))))
    return tx.let(_lines(text), shown)


def prose_view(text: Column) -> Column:
    """Different sentences: those that name problems, the first and the last."""
    last = lambda all_: F.when(F.size(all_) <= LAST_SENTENCES, all_).otherwise(F.slice(all_, -LAST_SENTENCES, LAST_SENTENCES))
    kept = lambda all_: F.array_distinct(F.concat(F.slice(_has(all_, PROBLEM), 1, SENTENCES), F.slice(all_, 1, SENTENCES), last(all_)))
    shown = lambda all_: tx.let(kept(all_), lambda some: _joined(some, _rest(F.size(all_) - F.size(some), "segments")))
    return tx.let(F.array_distinct(_full(F.split(text, SENTENCE_END))), shown)


def table_view(text: str) -> str:
    """How many rows a table has, its head, and its first and last rows; rows stream past."""
    rows = csv.reader(io.StringIO(text), delimiter="\t" if "\t" in text.split("\n", 1)[0] else ",")
    head = next(rows, None)
    if head is None:
        return "<empty table>"
    first = list(islice(rows, ROWS))
    n, tail = len(first), deque(maxlen=LAST_ROWS)
    for row in rows:
        n += 1
        tail.append(row)
    shown = first + (list(tail) if n > ROWS + LAST_ROWS else [])
    width = lambda i: max(len(r[i]) for r in [head, *shown] if i < len(r))
    rule = ["-" * min(WIDEST, max(3, width(i))) for i in range(len(head))]
    body = [" | ".join(r[: len(head)]) for r in [head, rule, *shown]]
    more = [f"… {n - len(shown)} rows externalized …"] if n > len(shown) else []
    return "\n".join([f"Rows: {n} | Columns: {len(head)}", *body, *more])


def parsed(text: str, by_line: bool) -> object:
    """The value of a JSON text; of one by line, those of its lines that are JSON."""
    if not by_line:
        return json.loads(text)
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        try:
            out.append(json.loads(line))
        except ValueError:
            continue
    return out


@F.pandas_udf(T.StringType())
def _parsed_view(family: pd.Series, text: pd.Series) -> pd.Series:
    """Views of JSON and tables; null for other families and for JSON that isn't."""

    def of(kind: str, t: str) -> str | None:
        if kind == "table":
            return table_view(t)
        try:
            return json.dumps(bound(parsed(t, kind == "jsonl"), JSON_BOUNDS), ensure_ascii=False, indent=2, sort_keys=True)
        except ValueError:
            return None

    return pd.Series([of(k, t) if k in ("json", "jsonl", "table") else None for k, t in zip(family, text, strict=True)], dtype=object)


_VIEWS = {"log": log_view, "stack-trace": stack_view, "diff": diff_view, "xml": markup_view, "rag": passages_view, "code": code_view}


def family_view(family: Column, text: Column) -> Column:
    """The view of a text (not null) by its family; JSON that isn't any, and families without a view of their own, are prose."""
    needs = family.isin("json", "jsonl", "table")
    out = F.when(needs, F.coalesce(_parsed_view(family, F.when(needs, text).otherwise("")), prose_view(text)))
    for name, view in _VIEWS.items():
        out = out.when(family == name, view(text))
    return out.otherwise(prose_view(text))


def within(text: Column, budget: int) -> Column:
    """A text's head within a budget of UTF-8 bytes, never within a letter."""
    return F.when(F.octet_length(text) <= budget, text).otherwise(F.concat(utf8_prefix(text, max(0, budget - 4)), F.lit("…")))


def family_views(df: DataFrame, key: str, family: str, text: str, budget: int = 4096) -> DataFrame:
    """(key, family, view): texts (null: empty) by their family, as bounded and redacted views. One narrow pass."""
    told = df.select(key, family, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    shown = told.select(key, family, family_view(F.col(family), F.col("_t")).alias("view"))
    return shown.select(key, family, security.redacted(within(F.col("view"), budget)).alias("view"))
