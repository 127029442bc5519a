"""Readers and writers of the formats that operational data comes in."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_rows(df: DataFrame, text: str, row_type: str) -> DataFrame:
    """Rows of JSON payloads that are a list, or an object with rows, records or items."""
    shape = f"struct<rows:array<{row_type}>,records:array<{row_type}>,items:array<{row_type}>>"
    own = F.from_json(F.col(text), shape)
    rows = F.when(F.ltrim(text).startswith("["), F.from_json(F.col(text), f"array<{row_type}>")).otherwise(F.coalesce(own["rows"], own["records"], own["items"]))
    return df.withColumn("_row", F.explode(rows)).select(*df.columns, "_row.*")


def jsonl(spark: SparkSession, path: str, schema: str, mode: str = "tolerant") -> DataFrame:
    """JSON lines. tolerant: bad lines stay as rows with `_bad`; skip: they go; strict: the first one fails the read."""
    modes = {"tolerant": "PERMISSIVE", "skip": "DROPMALFORMED", "strict": "FAILFAST"}
    if mode == "tolerant":
        return spark.read.schema(f"{schema}, _bad string").option("mode", modes[mode]).option("columnNameOfCorruptRecord", "_bad").json(path)
    return spark.read.schema(schema).option("mode", modes[mode]).json(path)


def delimited(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV, or TSV by its suffix, with a header; the schema is given, so that the files are read once."""
    return spark.read.schema(schema).option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)


def transcript(df: DataFrame, text: str) -> DataFrame:
    """(role, content, position) of transcripts that are a list, an object with events, messages or transcript, or JSON lines."""
    item = "struct<role:string,content:string>"
    own = F.from_json(F.col(text), f"struct<events:array<{item}>,messages:array<{item}>,transcript:array<{item}>>")
    as_lines = F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, item))
    listed = F.when(F.ltrim(text).startswith("["), F.from_json(F.col(text), f"array<{item}>"))
    rows = F.coalesce(listed, own["events"], own["messages"], own["transcript"], as_lines)
    return df.select("*", F.posexplode(rows).alias("position", "_m")).select(*df.columns, "position", "_m.role", "_m.content")


def tag_counts(df: DataFrame, markup: str) -> DataFrame:
    """How often each tag opens, over all rows: counts combine before the shuffle."""
    tags = F.explode(F.regexp_extract_all(F.lower(markup), F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))
    return df.select(tags.alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def strip_tags(markup: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]*>", " "), r"\s+", " "))


def server_sent_events(df: DataFrame, stream: str, text: str) -> DataFrame:
    """(stream, sequence, event, data, id) of whole event streams: blocks between blank lines, comments dropped, data lines joined. Expressions only."""
    blocks = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n\n+")
    rows = df.select(stream, F.posexplode(blocks).alias("_i", "_b"))
    fields = F.filter(F.split("_b", "\n"), lambda x: ~x.startswith(":") & (x != ""))
    value = lambda name: F.transform(F.filter("_f", lambda x: F.regexp_extract(x, "^[^:]*", 0) == name), lambda x: F.regexp_replace(x, "^[^:]*:? ?", ""))
    own = rows.withColumn("_f", fields).select(stream, "_i", value("event").alias("_e"), value("data").alias("_d"), value("id").alias("_n"))
    own = own.where("size(_e) + size(_d) + size(_n) > 0")
    number = F.row_number().over(Window.partitionBy(stream).orderBy("_i")).cast("bigint")
    return own.select(stream, number.alias("sequence"), F.coalesce(F.try_element_at("_e", F.lit(-1)), F.lit("message")).alias("event"), F.array_join("_d", "\n").alias("data"), F.coalesce(F.try_element_at("_n", F.lit(-1)), F.lit("")).alias("id"))


# Usage fields that a stream reports.
USAGE = ["input_tokens", "prompt_tokens", "output_tokens", "completion_tokens", "cached_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "reasoning_tokens", "total_tokens"]


def stream_usage(events: DataFrame, stream: str) -> DataFrame:
    """Per stream: events, whether it is done, and the largest value of each usage field anywhere in its data."""
    most = [F.max(F.array_max(F.transform(F.regexp_extract_all(F.lower("data"), F.lit(f'"{u}"\\s*:\\s*(\\d+)'), F.lit(1)), lambda x: x.cast("bigint")))).alias(u) for u in USAGE]
    return events.groupBy(stream).agg(F.count("*").alias("events"), F.bool_or(F.trim("data") == "[DONE]").alias("done"), *most)


LSIF = "id string, type string, label string, uri string, outV string, inV string, inVs array<string>, start struct<line:int>, `end` struct<line:int>, identifier string"


def lsif(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of a JSON-lines code index, see lsif_graph()."""
    return lsif_graph(spark.read.schema(LSIF).json(path))


def lsif_graph(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, uri, start_line, end_line, name) and definition or reference edges (src, label, dst) of a JSON-lines code index: joins over
    vertices and edges, no driver loop."""
    vertex, edge = raw.where("type = 'vertex'"), raw.where("type = 'edge'")
    docs = vertex.where("label = 'document'").select(F.col("id").alias("doc"), "uri")
    ranges = vertex.where("label = 'range'").select("id", (F.col("start.line") + 1).alias("start_line"), (F.col("end.line") + 1).alias("end_line"))
    inside = edge.where("label = 'contains'").select(F.col("outV").alias("doc"), F.explode("inVs").alias("id"))
    names = edge.where("label = 'moniker'").select(F.col("outV").alias("id"), F.col("inV").alias("_m")).join(vertex.where("label = 'moniker'").select(F.col("id").alias("_m"), F.col("identifier").alias("name")), "_m").drop("_m")
    nodes = ranges.join(inside, "id").join(docs, "doc").join(names, "id", "left").select("id", "uri", "start_line", "end_line", "name")
    results = edge.where("label like 'textDocument/%'").select(F.col("outV").alias("_o"), F.col("inV").alias("_r"), "label")
    items = edge.where("label = 'item'").select(F.col("outV").alias("_r"), F.explode(F.coalesce("inVs", F.array("inV"))).alias("dst"))
    after = edge.where("label = 'next'").select(F.col("outV").alias("src"), F.col("inV").alias("_o"))
    own = results.select(F.col("_o").alias("src"), "_o").unionByName(after).distinct()
    return nodes, own.join(results, "_o").join(items, "_r").where("src <> dst").select("src", "label", "dst").distinct()


SCIP = "documents array<struct<relative_path:string,language:string,occurrences:array<struct<range:array<int>,symbol:string,symbol_roles:int>>,symbols:array<struct<symbol:string,relationships:array<struct<symbol:string,is_implementation:boolean,is_reference:boolean>>>>>>"


def scip(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Occurrences (path, symbol, line, definition) and symbol relations (src, kind, dst) of a JSON code index."""
    docs = df.select(F.explode(F.from_json(F.col(text), SCIP)["documents"]).alias("d"))
    seen = docs.select(F.col("d.relative_path").alias("path"), F.explode("d.occurrences").alias("o"))
    seen = seen.select("path", F.col("o.symbol").alias("symbol"), (F.element_at("o.range", 1) + 1).alias("line"), (F.coalesce("o.symbol_roles", F.lit(0)).bitwiseAND(1) == 1).alias("definition"))
    own = docs.select(F.explode("d.symbols").alias("s")).select(F.col("s.symbol").alias("src"), F.explode("s.relationships").alias("r"))
    return seen, own.select("src", F.when(F.col("r.is_implementation"), "implements").otherwise("references").alias("kind"), F.col("r.symbol").alias("dst"))


def coverage(df: DataFrame, test: str, text: str) -> DataFrame:
    """(test, path, executed, missing) of coverage documents: an edge for each covered file."""
    files = F.from_json(F.col(text), "struct<files:map<string,struct<executed_lines:array<int>,missing_lines:array<int>>>>")["files"]
    return df.select(test, F.explode(files).alias("path", "_d")).select(test, "path", F.coalesce(F.size("_d.executed_lines"), F.lit(0)).alias("executed"), F.coalesce(F.size("_d.missing_lines"), F.lit(0)).alias("missing"))


def trace(df: DataFrame) -> DataFrame:
    """Edges of spans (source, target) that name both ends."""
    ends = df.select(F.trim("source").alias("src"), F.trim("target").alias("dst"), F.coalesce("relation", F.lit("RUNTIME_CALL")).alias("relation"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))
    return ends.where("src <> '' and dst <> ''")


def numstat(df: DataFrame, line: str) -> DataFrame:
    """(path, added, removed, commits) of lines of added, removed and path; binary files count as 0."""
    part = F.split(line, "\t")
    number = lambda i: F.coalesce(F.try_to_number(F.try_element_at(part, F.lit(i)), F.lit("999999999")).cast("bigint"), F.lit(0))
    rows = df.where(F.size(part) == 3).select(F.element_at(part, 3).alias("path"), number(1).alias("a"), number(2).alias("r"))
    return rows.groupBy("path").agg(F.sum("a").alias("added"), F.sum("r").alias("removed"), F.count("*").alias("commits"))


def file_scan(spark: SparkSession, path: str, suffixes: list[str] | None = None) -> DataFrame:
    """(path, size, modified, sha256) of the files below a folder; contents are hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    return out.where(F.lower("path").rlike(r"\.(?:" + "|".join(suffixes) + ")$")) if suffixes else out


#: Rows of symbols that are held at once, beside those of one file.
HELD = 8192


def python_symbols(df: DataFrame, path: str, source: str) -> DataFrame:
    """(path, kind, name, line, end_line) of classes, functions and imports, by the language's own parser; what doesn't parse gives one row of kind error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [path, "kind", "name", "line", "end_line"]
        kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function"}
        for b in batches:
            rows = []
            for p, text in zip(b[path], b[source], strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError):
                    rows.append((p, "error", "", 0, 0))
                    continue
                for node in ast.walk(tree):
                    if type(node) in kinds:
                        rows.append((p, kinds[type(node)], node.name, node.lineno, node.end_lineno))
                    elif isinstance(node, ast.Import | ast.ImportFrom):
                        base = getattr(node, "module", None)
                        rows += [(p, "import", f"{base}.{a.name}" if base else a.name, node.lineno, node.end_lineno) for a in node.names]
                if len(rows) >= HELD:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return df.select(path, source).mapInPandas(run, f"{path} string, kind string, name string, line bigint, end_line bigint")


# Patterns of definitions, by kind, and of imports in languages that aren't parsed.
PROFILES = {
    "javascript": (
        [
            ("class", r"\b(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)"),
            ("interface", r"\b(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"),
            ("type", r"\b(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*="),
            ("enum", r"\b(?:export\s+)?enum\s+([A-Za-z_$][\w$]*)"),
            ("function", r"\b(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\("),
            ("function", r"\b(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"),
        ],
        [r"""\bimport(?:[^'"]*?from\s*)?['"]([^'"]+)['"]""", r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""", r"""\bexport\s+\*\s+from\s+['"]([^'"]+)['"]"""],
    ),
    "rust": (
        [
            ("function", r"\b(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+([A-Za-z_][\w]*)\s*(?:<[^>]+>)?\s*\("),
            ("struct", r"\b(?:pub\s+)?struct\s+([A-Za-z_][\w]*)"),
            ("enum", r"\b(?:pub\s+)?enum\s+([A-Za-z_][\w]*)"),
            ("trait", r"\b(?:pub\s+)?trait\s+([A-Za-z_][\w]*)"),
            ("type", r"\b(?:pub\s+)?type\s+([A-Za-z_][\w]*)\s*="),
            ("module", r"\b(?:pub\s+)?mod\s+([A-Za-z_][\w]*)"),
        ],
        [r"\buse\s+([^;]+);", r"\bextern\s+crate\s+([A-Za-z_][\w]*)"],
    ),
    "go": (
        [("function", r"\bfunc\s+(?:\([^)]*\)\s*)?([A-Za-z_][\w]*)\s*\("), ("type", r"\btype\s+([A-Za-z_][\w]*)\s+(?:struct|interface|=)"), ("variable", r"\bvar\s+([A-Za-z_][\w]*)\s+")],
        [r"""(?m)^\s*import\s+(?:[A-Za-z_.]+\s+)?"([^"]+)\""""],
    ),
    "java": (
        [("class", r"\bclass\s+([A-Za-z_][\w]*)"), ("interface", r"\binterface\s+([A-Za-z_][\w]*)"), ("enum", r"\benum\s+([A-Za-z_][\w]*)"), ("record", r"\brecord\s+([A-Za-z_][\w]*)\s*\(")],
        [r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", r"(?m)^\s*package\s+([\w.]+)\s*;"],
    ),
    "csharp": (
        [("class", r"\bclass\s+([A-Za-z_][\w]*)"), ("interface", r"\binterface\s+([A-Za-z_][\w]*)"), ("struct", r"\bstruct\s+([A-Za-z_][\w]*)"), ("record", r"\brecord(?:\s+class|\s+struct)?\s+([A-Za-z_][\w]*)")],
        [r"(?m)^\s*using\s+(?:static\s+)?([\w.]+)\s*;", r"(?m)^\s*namespace\s+([\w.]+)"],
    ),
    "cpp": (
        [("class", r"\bclass\s+([A-Za-z_][\w]*)"), ("struct", r"\bstruct\s+([A-Za-z_][\w]*)"), ("enum", r"\benum(?:\s+class)?\s+([A-Za-z_][\w]*)")],
        [r"""(?m)^\s*#\s*include\s*[<"]([^>"]+)[>"]""", r"(?m)^\s*using\s+namespace\s+([\w:]+)"],
    ),
    "ruby": (
        [("class", r"(?m)^\s*class\s+([A-Za-z_][\w:]*)"), ("module", r"(?m)^\s*module\s+([A-Za-z_][\w:]*)"), ("method", r"(?m)^\s*def\s+(?:self\.)?([A-Za-z_][\w!?=]*)")],
        [r"""(?m)^\s*require(?:_relative)?\s*[('"]([^)'"]+)"""],
    ),
    "php": (
        [
            ("class", r"\b(?:abstract\s+|final\s+|readonly\s+)?class\s+([A-Za-z_][\w]*)"),
            ("interface", r"\binterface\s+([A-Za-z_][\w]*)"),
            ("trait", r"\btrait\s+([A-Za-z_][\w]*)"),
            ("enum", r"\benum\s+([A-Za-z_][\w]*)"),
            ("function", r"\bfunction\s+&?\s*([A-Za-z_][\w]*)\s*\("),
        ],
        [r"""\b(?:require|require_once|include|include_once)\s*\(?\s*['"]([^'"]+)""", r"(?m)^\s*use\s+([^;]+);", r"(?m)^\s*namespace\s+([^;]+);"],
    ),
    "lua": (
        [("function", r"(?m)^\s*(?:local\s+)?function\s+([A-Za-z_][\w.:]*)\s*\("), ("function", r"(?m)^\s*local\s+([A-Za-z_][\w]*)\s*=\s*function\s*\("), ("type", r"(?m)^\s*(?:export\s+)?type\s+([A-Za-z_][\w]*)\s*=")],
        [r"\brequire\s*\(\s*([^\)]+)\)"],
    ),
}


def profile_symbols(df: DataFrame, path: str, source: str, language: str) -> DataFrame:
    """(path, kind, name) by the patterns of a language: definitions by their kinds, and imports."""

    def named(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name"))

    definitions, imports = PROFILES[language]
    parts = [F.transform(F.regexp_extract_all(source, F.lit(p), F.lit(1)), named(k)) for k, p in [*definitions, *(("import", p) for p in imports)]]
    return df.select(path, F.explode(F.concat(*parts)).alias("s")).select(path, "s.kind", "s.name")


# writers and keepers


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """target with changes merged in: of each key the row with the greatest version, changes before equal ones. One partial maximum a key."""
    both = target.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    row = F.struct(*[F.col(f"`{c}`") for c in target.columns])
    return both.groupBy(*keys).agg(F.max_by(row, F.struct(version, "_new")).alias("_row")).select("_row.*")


def insert_missing(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target and those rows whose keys it doesn't have, once each."""
    return target.unionByName(rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def content_addressed(df: DataFrame, body: str) -> DataFrame:
    """(digest, body, size, refs): bodies once each, by SHA-256."""
    own = df.select(F.sha2(F.col(body).cast("binary"), 256).alias("digest"), F.col(body).alias("body"))
    return own.groupBy("digest").agg(F.first("body").alias("body"), F.max(F.octet_length("body")).alias("size"), F.count("*").alias("refs"))


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes df so that only the partitions it has rows of are replaced, each as a whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def payload(df: DataFrame, text: str) -> DataFrame:
    """kind of each payload, json or text, and its JSON as a variant where it is any."""
    value = F.try_parse_json(F.col(text))
    structured = F.ltrim(text).rlike(r"^[\[{]")
    return df.withColumn("kind", F.when(structured & value.isNotNull(), "json").otherwise("text")).withColumn("value", F.when(structured, value))


def export_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def split_verified(df: DataFrame, body: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose body has the digest that they claim, and the others, for quarantine."""
    ok = F.sha2(F.col(body).cast("binary"), 256) == F.col(digest)
    return df.where(ok), df.where(~F.coalesce(ok, F.lit(False)))


def prometheus(metrics: DataFrame) -> DataFrame:
    """(line) in the text format of metrics (name, labels as a map, value), in order of name and labels."""
    pairs = F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))))
    labels = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return metrics.select(F.concat(F.regexp_replace("name", "[^A-Za-z0-9_:]", "_"), labels, F.lit(" "), F.col("value").cast("string")).alias("line")).orderBy("line")


def wire_encode(value: object, least_saving: float = 0.08) -> dict:
    """JSON with repeated keys and long repeated strings as numbers into dictionaries; plain where that saves too little."""
    keys: dict[str, int] = {}
    strings: dict[str, int] = {}

    def count(x):
        if isinstance(x, dict):
            for k, v in x.items():
                keys[k] = keys.get(k, 0) + 1
                count(v)
        elif isinstance(x, list):
            for v in x:
                count(v)
        elif isinstance(x, str) and len(x) > 8:
            strings[x] = strings.get(x, 0) + 1

    count(value)
    names = [k for k, n in sorted(keys.items(), key=lambda p: (-p[1], p[0])) if n > 1 and len(k) > 2]
    texts = [k for k, n in sorted(strings.items(), key=lambda p: (-p[1], p[0])) if n > 1]
    at, of = {k: i for i, k in enumerate(names)}, {k: i for i, k in enumerate(texts)}

    def small(x):
        if isinstance(x, dict):
            return {(f"#{at[k]}" if k in at else "\\" + k if k[:1] in ("#", "\\", "$") else k): small(v) for k, v in x.items()}
        if isinstance(x, list):
            return [small(v) for v in x]
        return {"$": of[x]} if isinstance(x, str) and x in of else x

    plain = json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True)
    packed = json.dumps({"k": names, "s": texts, "d": small(value)}, separators=(",", ":"), ensure_ascii=False)
    saved = 1 - len(packed.encode()) / max(1, len(plain.encode()))
    digest = hashlib.sha256(plain.encode()).hexdigest()
    return {"packed": True, "body": packed, "sha256": digest, "saving": saved} if saved >= least_saving else {"packed": False, "body": plain, "sha256": digest, "saving": 0.0}


def wire_decode(encoded: dict) -> object:
    """The value again; fails if it isn't the one that was encoded."""
    body = json.loads(encoded["body"])
    if encoded["packed"]:
        names, texts = body["k"], body["s"]

        def grow(x):
            if isinstance(x, dict):
                if set(x) == {"$"}:
                    return texts[x["$"]]
                return {(names[int(k[1:])] if k[:1] == "#" else k[1:] if k[:1] == "\\" else k): grow(v) for k, v in x.items()}
            return [grow(v) for v in x] if isinstance(x, list) else x

        body = grow(body["d"])
    if hashlib.sha256(json.dumps(body, separators=(",", ":"), ensure_ascii=False, sort_keys=True).encode()).hexdigest() != encoded["sha256"]:
        raise ValueError("the decoded value differs from the encoded one")
    return body
