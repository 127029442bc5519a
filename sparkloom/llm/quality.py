"""Quality classifier: hierarchical empirical Bayes over a document classifier, hosts and paths."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import without
from .common import id_back, id_key, in_arrow, materialize, numbered, table

#: Most labelled rows that the document classifier is fitted on: those with the least hashes of their ids.
LABELLED = 20_000
#: Rows with a posterior of good quality from here on are kept.
KEEP = 0.5
#: Penalty of the logistic regression's squared weights, and its Newton steps.
PENALTY, STEPS = 1.0, 25
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~!"
_DIGITS = b"0123456789"
_LINE = re.compile(r"[^\n]+")
FEATURES = ("log_words", "upper", "symbols", "digits", "distinct", "top_word", "repeated_lines", "repeated_pairs", "word_length", "stops")


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all are finite, for empty texts too."""
    text = text or ""
    data, words = text.encode("utf-8", "surrogatepass"), text.split()
    n, letters = max(1, len(data)), max(1, sum(map(len, words)))
    lines = [x.strip() for x in _LINE.findall(text)]
    counts = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    ends = sum(w[-1] in ".?" for w in words)
    upper = sum(len(w) for w in words if len(w) > 1 and w.isupper())
    return [
        math.log1p(len(words)), upper / letters, 1 - len(data.translate(None, _SYMBOLS)) / n, 1 - len(data.translate(None, _DIGITS)) / n,
        len(counts) / max(1, len(words)), max(counts.values(), default=0) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)),
        1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0, min(letters / max(1, len(words)), 50.0), ends / max(1, len(words)),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t) for t in b.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(rows, pa.list_(pa.float64()))], ["row", "id", "host", "path", "x"])


class Logistic:
    """Logistic regression on standardised features by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.rate = float((y.sum() + 1) / (len(y) + 2))
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
        self.weights = np.zeros(2 * len(FEATURES) + 1)
        self.weights[0] = math.log(self.rate / (1 - self.rate))
        if 0 < y.sum() < len(y):
            z = self.expand((x - self.mean) / self.scale)
            penalty = np.full(z.shape[1], PENALTY)
            penalty[0] = 1e-6
            for _ in range(STEPS):
                p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
                step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.weights)
                self.weights += step
                if np.abs(step).max() < 1e-8:
                    break

    @staticmethod
    def expand(z: np.ndarray) -> np.ndarray:
        z = np.clip(z, -8, 8)
        return np.column_stack([np.ones(len(z)), z, z * z])

    def column(self, x: str) -> Column:
        """log-odds as a Spark expression over an array column."""
        at = [F.least(F.greatest((F.col(x)[i] - float(m)) / float(s), F.lit(-8.0)), F.lit(8.0)) for i, (m, s) in enumerate(zip(self.mean, self.scale, strict=True))]
        out = F.lit(float(self.weights[0]))
        for i, z in enumerate(at):
            out = out + z * float(self.weights[1 + i]) + z * z * float(self.weights[1 + len(at) + i])
        return F.least(F.greatest(out, F.lit(-12.0)), F.lit(12.0))


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(mean: Column, prior: Column, n: Column) -> Column:
    """Prior observations by the method of moments: how much groups' means spread beyond what their sizes explain."""
    spread = F.avg(F.pow(mean - prior, 2) - prior * (1 - prior) / n)
    return F.least(F.greatest(F.coalesce(F.avg(prior * (1 - prior)) / F.greatest(spread, F.lit(1e-6)) - 1, F.lit(1.0)), F.lit(1.0)), F.lit(1e4))


class Sites:
    """What the corpus says about hosts and paths: the fitted model, the global mean, prior strengths and a table of sums by site."""

    def __init__(self, model: Logistic, scored: DataFrame):
        """scored: host, path and p, the document classifier's probability, of every row, written already."""
        self.model = model
        paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
        hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
        mean = hosts.agg(F.sum("host_s") / F.sum("host_n")).first()[0]
        self.mean = min(max(0.5 if mean is None else float(mean), 1e-4), 1 - 1e-4)
        g = F.lit(self.mean)
        self.k1 = float(hosts.agg(_strength(F.col("host_s") / F.col("host_n"), g, F.col("host_n"))).first()[0])
        both = paths.join(hosts, "host").withColumn("mu", (F.col("host_s") + self.k1 * g) / (F.col("host_n") + self.k1))
        self.table = materialize(both.select(F.col("host").alias("_sl_h"), F.col("path").alias("_sl_q"), "n", "s", "host_n", "host_s", "mu"), "sites")
        self.k2 = float(self.table.agg(_strength(F.col("s") / F.col("n"), F.col("mu"), F.col("n"))).first()[0])

    def judged(self, df: DataFrame, host: Column, path: Column, z: Column) -> DataFrame:
        """df, narrow rows, with _sl_p_doc, _sl_p_host, _sl_p_path and _sl_posterior. The planner joins the sites by host and path: it broadcasts them if it
        measures that they are small, and else adaptive execution splits hot ones, which have one row on the sites' side."""
        sums = {c: F.col(f"_sl_{c}") for c in ("n", "s", "host_n", "host_s", "z", "p_doc", "p_host", "p_path")}
        sites = self.table.select("_sl_h", "_sl_q", *[F.col(c).alias(f"_sl_{c}") for c in ("n", "s", "host_n", "host_s")])
        rows = df.withColumn("_sl_z", z).withColumn("_sl_host", host).withColumn("_sl_path", path)
        out = rows.join(sites, (F.col("_sl_host") == F.col("_sl_h")) & (F.col("_sl_path") == F.col("_sl_q")))
        bound = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
        out = out.withColumn("_sl_p_doc", 1 / (1 + F.exp(-sums["z"])))
        out = out.withColumn("_sl_p_host", bound((sums["host_s"] - sums["p_doc"] + self.k1 * self.mean) / (sums["host_n"] - 1 + self.k1)))
        out = out.withColumn("_sl_p_path", bound((sums["s"] - sums["p_doc"] + self.k2 * sums["p_host"]) / (sums["n"] - 1 + self.k2)))
        return out.withColumn("_sl_posterior", 1 / (1 + F.exp(-(sums["z"] + _odds(sums["p_path"]) - _odds(F.lit(self.mean))))))


def _site(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def study(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED, row: Column | None = None) -> tuple[Sites, DataFrame]:
    """The sites of a corpus, and (row, id, host, path, x) of every row."""
    rows = docs.select((F.lit(None) if row is None else row).cast("bigint").alias("row"), id_key(id_col).alias("id"), _site(host).alias("host"), _site(path).alias("path"), F.col(text_col).cast("string").alias("text"))
    found = materialize(in_arrow(rows, _features, "row bigint, id bigint, host string, path string, x array<double>"), "features")
    marked = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    marked = marked.withColumn("order", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    # Labels beyond about twice the bound go before the join, by the order that the bound goes by: what tasks send stays bounded.
    marked = marked.where(F.col("order") <= int(min(1.0, 2 * labelled / max(1, marked.count()) + 1e-3) * (1 << 40)))
    sample = found.join(marked, "id").select("x", "y", "order", "id").orderBy("order", "id", "y", F.xxhash64("x")).limit(labelled).toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(len(sample), len(FEATURES))
    model = Logistic(x, (sample["y"].to_numpy(float) > 0).astype(float))
    scored = found.select("host", "path", (1 / (1 + F.exp(-model.column("x")))).alias("p"))
    return Sites(model, materialize(scored, "scores")), found


def quality_scores(docs: DataFrame, labels: DataFrame, host: Column, path: Column, **names) -> DataFrame:
    """Per row: id (key), p_doc, p_host, p_path, posterior and kept.

    p_doc is the document classifier's probability, fitted on at most `labelled` labelled rows (join on id). Hosts, and paths
    within hosts, are grouped over all documents: a host's mean shrinks toward the global mean, a path's toward its host's,
    each with as many prior observations as the spread between groups asks for, leaving out the row itself. The
    posterior odds are the classifier's odds times p_path's odds over the global odds. Null texts are empty; null hosts and paths are groups of their own;
    without usable labels p_doc is the rate of the labels, smoothed. Labels that repeat an id count each; rows
    that repeat an id are scored each. Empty tables give no rows; other columns are ignored.
    """
    sites, found = study(docs, labels, host, path, **names)
    out = sites.judged(found, F.col("host"), F.col("path"), sites.model.column("x"))
    return out.select("id", *[F.col(f"_sl_{c}").alias(c) for c in ("p_doc", "p_host", "p_path", "posterior")], (F.col("_sl_posterior") >= KEEP).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, host: Column, path: Column, text_col: str = "text", **names) -> DataFrame:
    """The rows of docs, all columns, that the classifier keeps; each row on its own, ids may repeat or be null.

    Rows are written once with a number; features, which are narrow, meet the sites and decide which numbers go. Of the texts only those that the filter of
    these numbers passes can be shuffled, whatever the number of sites.
    """
    rows = numbered(docs, "quality-rows")
    sites, found = study(rows, labels, host, path, text_col=text_col, row=F.col("_sl_row"), **names)
    out = sites.judged(found, F.col("host"), F.col("path"), sites.model.column("x"))
    gone = materialize(out.where(~(F.col("_sl_posterior") >= KEEP)).select(F.col("row").alias("_sl_gone")), "rejected-rows")
    return without(rows, "_sl_row", gone, "_sl_gone").drop("_sl_row")


def site_columns() -> tuple[Column, Column]:
    """The host and path of documents: their source, and the language section within it."""
    return F.col("source"), F.col("lang")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), *site_columns())
    digits = [F.round(c, 6).alias(c) for c in ("p_doc", "p_host", "p_path", "posterior")]
    return scores.select(id_back("id").alias("doc_id"), *digits, "kept")
