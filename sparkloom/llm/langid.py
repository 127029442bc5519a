"""Language ID: Bayesian fusion of text likelihoods with the declared language, the address suffix and host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_back, id_key, in_arrow, materialize, table

#: Most labelled rows a language that the text model is fitted on (those with the least hashes of their ids), and the buckets
#: of its byte trigrams.
LABELLED, BUCKETS = 2_000, 1 << 16
#: Most languages that a model is fitted for; each takes a row of counts on the driver.
LANGUAGES = 1000
#: Trigrams overlap and repeat, so that a text's log-likelihood counts as that of this share of them, and of this many at most.
SHARE, MOST = 0.1, 40.0
#: Prior observations of the language shares of suffixes, domains and hosts, and of declarations and suffixes by language.
STRENGTH, SMOOTH = 5.0, 0.5
NONE = ""

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)|<[^>]*>|&[#\w]+;", re.DOTALL | re.IGNORECASE)
_DECLARED = re.compile(r"""<html\b[^>]*?\slang\s*=\s*["']?\s*([A-Za-z]{2,3})(?![A-Za-z])""", re.IGNORECASE)
_META = re.compile(r"""<meta\b[^>]*?http-equiv\s*=\s*["']?content-language["']?[^>]*?\scontent\s*=\s*["']?\s*([A-Za-z]{2,3})(?![A-Za-z])""", re.IGNORECASE)
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a lower-cased text, digits and signs as spaces, runs of spaces as one."""
    data = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    if not data:
        return np.empty(0, np.int64)
    b = np.frombuffer(f" {data} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * 2654435761
    return h >> 12 & (BUCKETS - 1)


def visible(html: str) -> str:
    return _DROP.sub(" ", html)


def address(url: str | None) -> tuple[str, str, str]:
    """Host, registered domain (its last two labels) and suffix (the last label) of an address, lower case; empty where there is none."""
    m = _HOST.match(url or "")
    host = m[1].lower().rstrip(".") if m else NONE
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else NONE


def declared(html: str) -> str:
    """Primary subtag of the markup's language, of two or three letters, or empty."""
    m = _DECLARED.search(html) or _META.search(html)
    return m[1].lower() if m else NONE


class TextModel:
    """Naive Bayes over byte trigrams."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        self.table = np.empty((len(self.langs), BUCKETS), np.float32)
        for i, x in enumerate(self.langs):  # one row of doubles at a time
            row = np.asarray(counts[x], float) + 0.5
            self.table[i] = np.log(row / row.sum())

    def __call__(self, text: str) -> np.ndarray:
        """Tempered log-likelihood of each language, the best at 0."""
        if not self.langs:
            return np.empty(0)
        at = trigrams(text)
        if not len(at):
            return np.zeros(len(self.langs))
        mean = self.table[:, at].mean(1, dtype=np.float64)
        return (mean - mean.max()) * min(MOST, SHARE * len(at))


def fit(samples: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", labelled: int = LABELLED) -> TextModel:
    """Fits on at most `labelled` rows of each language. Counts are made by the executors, a row of BUCKETS for each language and task; more than LANGUAGES
    labels are an error, as they aren't languages."""
    rows = samples.select(id_key(id_col).alias("id"), F.lower(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    # A threshold on the hash takes about twice `labelled` rows of each language, however many it has, without a sort of all texts; the window takes the exact bound
    # from those. That fewer than `labelled` of more come through is beyond chance.
    sizes = rows.groupBy("lang").count().select(F.col("lang").alias("l"), F.least(F.lit(1.0), (2.0 * labelled + 64) / F.col("count")).alias("share"))
    sizes = materialize(sizes, "label-sizes")
    if sizes.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} different labels")
    near = rows.join(F.broadcast(sizes), F.col("lang") == F.col("l")).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= F.col("share") * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    some = near.withColumn("n", rank).where(F.col("n") <= labelled).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[lang] = held.get(lang, 0) + np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    for row in in_arrow(some, run, "lang string, counts binary").toLocalIterator():
        total[row[0]] = total.get(row[0], 0) + np.frombuffer(row[1], "<i8")
    return TextModel(total)


def _evidence(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "scores", "declared", "host", "domain", "suffix"]
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                urls, htmls = part.column(1).to_pylist(), [x or "" for x in part.column(2).to_pylist()]
                scores = [model.value(visible(x)) for x in htmls]
                hosts = list(zip(*map(address, urls), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.list_(pa.float64())), pa.array(list(map(declared, htmls)), pa.string()), *(pa.array(x, pa.string()) for x in hosts)], names)

    return run


def identify(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id (key), lang, probability, text_lang, text_probability, declared, host.

    The posterior of a language is its text likelihood (whole visible text) times P(declared | language) times P(suffix | language) times the
    host's prior. All three tables are grouped over the whole corpus, weighted by what the text alone says; a host's shares shrink toward its
    domain's, those toward the suffix's and those toward the corpus's, leaving out the row itself. A missing
    declaration or suffix is evidence like any other. Null pages are empty: their priors decide; ties go to the first language by
    name. Null and repeated ids pass; an empty table gives no rows; a model without languages gives null languages. Other columns are ignored.
    """
    spark = pages.sparkSession
    langs = model.langs
    rows = pages.select(id_key(id_col).alias("id"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    schema = "id bigint, scores array<double>, declared string, host string, domain string, suffix string"
    found = in_arrow(rows, _evidence(spark.sparkContext.broadcast(model)), schema)
    if not langs:
        return found.select("id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("double").alias("text_probability"), "declared", "host")
    found = materialize(found.withColumn("p", softmax(F.col("scores"))), "evidence")
    size = len(langs)
    weights = lambda prefix: [F.sum(F.col("p")[i]).alias(f"{prefix}{i}") for i in range(size)]
    by_host = found.groupBy("suffix", "domain", "host").agg(*weights("h"))
    by_host = materialize(by_host, "hosts")
    again = lambda a, b: [F.sum(f"{a}{i}").alias(f"{b}{i}") for i in range(size)]
    by_domain = by_host.groupBy("suffix", "domain").agg(*again("h", "d"))
    by_suffix = by_domain.groupBy("suffix").agg(*again("d", "s"))
    shares = [float(x or 0) for x in by_suffix.agg(*again("s", "t")).first()]
    prior = [(x + 1) / (sum(shares) + size) for x in shares]
    by_declared = found.groupBy("declared").agg(*weights("c"))
    joined = found.join(by_host.join(by_domain, ["suffix", "domain"]).join(by_suffix, "suffix").drop("suffix", "domain"), "host").join(by_declared, "declared")
    own = lambda prefix: [F.greatest(F.col(f"{prefix}{i}") - F.col("p")[i], F.lit(0.0)) for i in range(size)]

    def shrink(counts: list[Column], toward: list[Column]) -> list[Column]:
        total = sum(counts[1:], counts[0])
        return [(c + STRENGTH * t) / (total + STRENGTH) for c, t in zip(counts, toward, strict=True)]

    flat = [F.lit(x) for x in prior]
    joined = joined.withColumn("ps", F.array(*shrink(own("s"), flat)))
    joined = joined.withColumn("pd", F.array(*shrink(own("d"), [F.col("ps")[i] for i in range(size)])))
    joined = joined.withColumn("ph", F.array(*shrink(own("h"), [F.col("pd")[i] for i in range(size)])))
    terms = []
    for i in range(size):
        of_lang = F.lit(shares[i] + SMOOTH * 2)
        said, suffix = ((own(x)[i] + SMOOTH) / of_lang for x in ("c", "s"))
        terms.append(F.col("scores")[i] + F.log(said) + F.log(suffix) + F.log(F.col("ph")[i]))
    out = joined.withColumn("fused", F.array(*terms)).withColumn("q", softmax(F.col("fused")))
    names = F.array(*map(F.lit, langs))
    best = lambda c: F.array_position(F.col(c), F.array_max(c)).cast("int")
    return out.select("id", F.element_at(names, best("q")).alias("lang"), F.array_max("q").alias("probability"), F.element_at(names, best("p")).alias("text_lang"), F.array_max("p").alias("text_probability"), "declared", "host")


def softmax(scores: Column) -> Column:
    up = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(up, lambda x: x / F.aggregate(up, F.lit(0.0), lambda a, b: a + b))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "pages"), fit(table(spark, sf_dir, "documents")))
    return out.select(id_back("id").alias("page_id"), "lang", F.round("probability", 6).alias("probability"), "text_lang", F.round("text_probability", 6).alias("text_probability"), "declared", "host")
