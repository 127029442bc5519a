"""Secret scans: patterns, and dictionary-primed zstandard novelty for strings in sensitive context."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_back, id_key, in_arrow, table

#: The base kinds, in the order that ties at a start go by.
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
#: What the method adds: strings that may be keys, of letters or digits alone too, words that make their surroundings sensitive, and the distance in code points to look for them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"(?:secret|passw|pwd|token|api[_-]?key|apikey|credential|private|bearer|authoriz|access|auth|signature|akia)", re.ASCII | re.IGNORECASE)
NEAR = 48
#: Code points of surroundings that the compressor sees before a candidate.
CONTEXT = 512
#: Marginal compressed bytes for each byte of a candidate from which on it is reported. Random strings of 16 and more letters, digits or both take 0.9
#: to 1 in contexts of any length; identifiers that a dictionary knows 0.5 to 0.75.
NOVELTY = 0.85
#: The compressor's level, for texts of about this many bytes; bytes of a candidate in a block, and bytes of a block's header.
LEVEL, SIZE, PIECE, HEADER = 9, 2048, 48, 3
#: Common identifiers and words that prime the compressor, so that camel-case and snake-case names aren't novel.
IDENTIFIERS = """
access account action address amount application argument array authorization backup balance base buffer builder bytes cache callback channel character check
child class client cluster code collection column command comment commit common component condition config connection container content context count create
current customer data database date debug default delete description detail directory disable document domain element email enable encode engine entity
entry error event exception expression factory field file filter format function group handler hash header height host http identifier
image index information input instance interface item json key label language layout length level library line list listener load location
manager map match memory message method mode model module name network node notification number object offset operation option order output
package page parameter parent parse password path pattern payload permission policy position prefix process product profile project property provider
public query range read record reference register remove request resource response result root route rule schema scope score search secret
section select server service session set setting size source start state status storage stream string style system table target task
template test text thread time timeout token total type unit update url user username validate value variable version view width
worker write
""".split()


#: Modules of the standard library whose public names, and those of their classes, are identifiers of real code.
MODULES = "argparse base64 builtins collections configparser csv datetime functools hashlib http.client io itertools json logging os pathlib random re shutil socket sqlite3 ssl string subprocess tempfile threading time typing urllib.parse urllib.request uuid xml.etree.ElementTree zipfile".split()


def code_identifiers() -> list[str]:
    """Keywords, and the names that MODULES and their classes export, once each, in sorted order."""
    import keyword
    from importlib import import_module

    names = set(keyword.kwlist)
    for module in map(import_module, MODULES):
        for name in dir(module):
            names.add(name)
            if isinstance(member := getattr(module, name, None), type):
                names.update(dir(member))
    return sorted(n for n in names if len(n) > 3 and not n.startswith("_"))


def dictionaries(more: tuple[str, ...] = ()) -> list[zstandard.ZstdCompressionDict]:
    """Raw-content dictionaries: common words in lower, upper, capital and joined forms; identifiers of the standard library; those of one's own code."""
    forms = [*IDENTIFIERS, *map(str.upper, IDENTIFIERS), *map(str.capitalize, IDENTIFIERS)]
    joined = ["_".join(IDENTIFIERS[i : i + 3]) for i in range(0, len(IDENTIFIERS), 3)]
    camel = ["".join(map(str.capitalize, IDENTIFIERS[i : i + 3])) for i in range(0, len(IDENTIFIERS), 3)]
    return [zstandard.ZstdCompressionDict(" ".join(names).encode(), zstandard.DICT_TYPE_RAWCONTENT) for names in ([*forms, *joined, *camel], code_identifiers(), more) if names]


class Novelty:
    """Marginal compressed bytes of a string after its surroundings, for each of its bytes, under the dictionary that knows it best."""

    def __init__(self, more: tuple[str, ...] = ()):
        self.press = []
        for known in dictionaries(more):
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=SIZE, dict_size=len(known.as_bytes()), write_content_size=0, write_checksum=0, write_dict_id=0)
            self.press.append(zstandard.ZstdCompressor(dict_data=known, compression_params=params))

    def __call__(self, context: str, candidate: str) -> float:
        before, own = context.encode("utf-8", "surrogatepass"), candidate.encode("utf-8", "surrogatepass")
        return min(sum(self._marginal(p, before, own)) for p in self.press) / len(own)

    @staticmethod
    def _marginal(press: zstandard.ZstdCompressor, before: bytes, own: bytes) -> Iterator[int]:
        """Sizes of the blocks that the candidate adds behind its surroundings. Blocks are so short that their literals stay plain: only
        what the surroundings and the dictionary have said already makes them smaller, whatever letters they consist of."""
        stream = press.compressobj()
        stream.compress(before)
        stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)
        for at in range(0, len(own), PIECE):
            block = stream.compress(own[at : at + PIECE]) + stream.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)
            yield len(block) - HEADER


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping within a kind, by start and then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(start, end, BASE[kind]) for start, kind, end in sorted(found)]


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    """Candidates in sensitive context that no base span touches, whose marginal compressed bytes are high."""
    out = []
    marks = [m.span() for m in SENSITIVE.finditer(text)]
    taken = [(s, e) for s, e, _ in base]
    at = i = 0
    for m in CANDIDATE.finditer(text) if marks else ():
        s, e = m.span()
        while at < len(marks) and marks[at][1] < s - NEAR:
            at += 1
        if at == len(marks):
            break
        if marks[at][0] > e + NEAR:
            continue
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if i < len(taken) and taken[i][0] < e:  # the first span that ends behind the start decides, as the others start later
            continue
        context = text[max(0, s - CONTEXT) : s] + text[e : e + CONTEXT]
        if novelty(context, m[0]) >= NOVELTY:
            out.append((s, e, "novel"))
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: id key, found: array of (kind, start, end, value), by start and then kind; ends are exclusive, in code points.

    `identifiers` of one's own code join the dictionary. Whole texts; null texts are empty; null and repeated ids pass through; an empty table gives no
    rows; other columns are ignored. A narrow plan without a shuffle.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        rank = {k: i for i, k in enumerate((*BASE, "novel"))}
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = sorted(base + novel_spans(text, base, novelty), key=lambda x: (x[0], rank[x[2]]))
                out.append([{"kind": k, "start": s, "end": e, "value": text[s:e]} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(kind))], ["id", "found"])

    rows = docs.select(id_key(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(rows, run, "id bigint, found array<struct<kind: string, start: bigint, end: bigint, value: string>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", identifiers: tuple[str, ...] = ()) -> DataFrame:
    """docs' id keys and texts with every found span replaced by the mark (overlapping spans as one).

    Null texts stay null and empty ones empty; null and repeated ids pass through; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                at, parts = 0, []
                for s, e, _ in sorted(base + novel_spans(text or "", base, novelty)):
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                out.append(None if text is None else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "text"])

    return in_arrow(docs.select(id_key(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, "id bigint, text string")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    n = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("found", lambda x: x["kind"] != "novel"), line), ",")
    return found.select(id_back("id").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("found", line), ",").alias("spans"))
