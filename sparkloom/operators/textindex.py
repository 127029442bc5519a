"""A stored full-text index: postings in blocks with maxima, on shelves by term; exact weighted BM25 with prefixes, by block-max pruning."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import parts_for
from .graph import cut
from .rank import B, K1

#: Ids in a block of postings, shelves that terms are dealt to, blocks' ranges that a query looks at first, and the most shelves that are named to the scan.
SPAN, SHELVES, FIRST, NAMED = 4096, 256, 4, 4096
#: Queries that are scored together on a range, asked terms that are broadcast at most, and bytes of the texts' files for a task.
TOGETHER, ASKED, EACH = 256, 100_000, 4 << 20
#: Ranges that follow each other in a shelf's part, and parts of a shelf when it is written.
TURN, TURNS = 16, 64
#: Scores are rounded to so many places, so that equal texts tie whatever the order of their sums.
PLACES = 9
_SLACK = 1e-6
_POSTINGS = "term string, span bigint, entries array<struct<doc: bigint, length: bigint, counts: array<int>>>, n bigint, most array<int>, least bigint, made string, shelf int"


def _shelf(term: Column, shelves: int = SHELVES) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shelves)).cast("int")


class TextIndex:
    """An index of texts by whole-number ids in a folder, built once and searched by any number of batches of queries.

    `postings` has a row for each term and range of SPAN ids: its entries (doc, length, counts by field) and, beside them, the most that each field counts and
    the least length, which bound every score in the block for any weights. They lie on shelves by a hash of the term and are sorted within, so that a search
    reads its own terms' shelves; a term that every text has is many blocks, dealt over tasks. `terms` has each term's number of texts, sorted for prefixes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fields = spark.read.parquet(f"{path}/stats").first().fields

    @classmethod
    def build(cls, docs: DataFrame, key: str, fields: dict[str, Column], path: str) -> TextIndex:
        """Indexes docs: fields maps names to arrays of tokens (null: none). Ids are unique; rows without one are left out."""
        _write(docs, key, fields, path)
        return cls(docs.sparkSession, path)

    def append(self, docs: DataFrame, key: str, fields: dict[str, Column]) -> None:
        """Adds texts whose ids aren't there yet, as blocks of their own; nothing that is stored is rewritten."""
        if list(fields) != list(self.fields):
            raise ValueError(f"the index has the fields {', '.join(self.fields)}")
        _write(docs, key, fields, self.path)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def expand(self, queries: DataFrame) -> DataFrame:
        """(query, phrase, prefix, times, term, df) of queries (query, phrase, prefix): a phrase's own term, or all that begin with it."""
        asked = queries.where("phrase != ''").groupBy("query", "phrase", "prefix").agg(F.count("*").alias("times"))
        terms = self._read("terms").groupBy("term").agg(F.sum("df").alias("df"))
        exact = asked.where("not prefix").join(terms, F.col("phrase") == F.col("term"))
        lengths = sorted(r[0] for r in asked.where("prefix").select(F.length("phrase")).distinct().collect())
        if not lengths:
            return exact
        heads = terms.select("*", F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(F.length("term") >= n, F.left("term", n))))).alias("head"))
        return exact.unionByName(asked.where("prefix").join(heads, F.col("phrase") == F.col("head")).drop("head"))

    def _postings(self, expanded: DataFrame) -> DataFrame:
        """The blocks of the expanded terms. The shelves, of which there are few, are named to the scan, so that it lists and reads those alone."""
        blocks = self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings")
        shelves = [r[0] for r in expanded.select(_shelf(F.col("term"))).distinct().limit(NAMED).collect()]
        return blocks.where(F.col("shelf").isin(shelves)) if len(shelves) < NAMED else blocks

    def search(self, queries: DataFrame, k: int = 10, weights: dict[str, float] | None = None, floor: bool = False) -> DataFrame:
        """(query, doc, score): for each query the k texts of the highest BM25, ties to the smaller id; texts without any of its phrases are none's result.

        queries: (query, phrase, prefix), a row for each phrase, more than once for one that counts so. A field's counts are weighted (by default 1). With floor, rarity is that of
        full-text indexes, ln((N - n + 0.5) / (n + 0.5)) and 1e-6 at least; else ln(1 + the same). A prefix counts as one word that all its terms are forms of.

        Blocks' maxima give each range of ids an upper bound. The FIRST ranges of the highest bounds are scored, their k-th best score is what any other
        result must reach, and of the other ranges only those are unpacked whose bounds reach it.
        """
        bounds, scored = self._bounds(queries, weights or {}, floor)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "span"))
        first = cut(bounds.withColumn("_place", place).where(F.col("_place") <= FIRST).select("query", "span"))
        best = cut(_top(scored(first, k), k))
        least = best.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        rest = bounds.join(first, ["query", "span"], "left_anti").join(least, "query", "left").where(F.col("least").isNull() | (F.col("bound") + _SLACK >= F.col("least")))
        return _top(best.unionByName(scored(cut(rest.select("query", "span")), k)), k)

    def bounds(self, queries: DataFrame, weights: dict[str, float] | None = None, floor: bool = False) -> DataFrame:
        """(query, span, bound): the most that any text of a range of ids can score."""
        return self._bounds(queries, weights or {}, floor)[0]

    def _bounds(self, queries: DataFrame, weights: dict[str, float], floor: bool):
        expanded = cut(self.expand(queries))
        blocks = self._postings(expanded)
        size = self._read("stats").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
        phrase = ["query", "phrase", "prefix"]
        # How many texts have a phrase: the dictionary knows for one term; forms of a prefix may share texts, which are counted once.
        forms = expanded.groupBy(*phrase).agg(F.count("*").alias("forms"), F.max("df").alias("df"), F.max("times").alias("times"))
        many = cut(forms.where("forms > 1").select(*phrase))
        shared = blocks.join(expanded.join(many, phrase, "left_semi").select("term", "phrase").distinct(), "term").select("phrase", "span", F.explode("entries.doc").alias("doc"))
        texts = shared.groupBy("phrase", "doc").agg(F.lit(1)).groupBy("phrase").agg(F.count("*").alias("texts"))
        known = forms.join(texts.withColumn("prefix", F.lit(True)), ["phrase", "prefix"], "left").select(*phrase, "times", F.when(F.col("forms") > 1, F.col("texts")).otherwise(F.col("df")).alias("df"))
        rare = (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
        idf = F.greatest(F.log(rare), F.lit(1e-6)) if floor else F.log(1 + rare)
        known = cut(known.crossJoin(F.broadcast(size)).select(*phrase, (F.col("times") * idf * (K1 + 1)).alias("worth"), F.greatest(F.col("length") / F.col("n"), F.lit(1.0)).alias("mean")))
        terms = cut(expanded.select(*phrase, "term").join(known, phrase))

        def count(x: str) -> Column:
            return sum((F.lit(float(weights.get(f, 1.0))) * F.get(x, F.lit(i)) for i, f in enumerate(self.fields)), F.lit(0.0))

        def part(tf: Column, length: Column) -> Column:
            return F.when(tf > 0, F.col("worth") * tf / (tf + K1 * (1 - B + B * length / F.col("mean")))).otherwise(0.0)

        of = [*phrase, "worth", "mean"]
        most = blocks.select("term", "span", "most", "least").join(terms, "term").groupBy(*of, "span").agg(F.sum(count("most")).alias("tf"), F.min("least").alias("length"))
        bounds = cut(most.groupBy("query", "span").agg(F.sum(part(F.col("tf"), F.col("length"))).alias("bound")).where("bound > 0"))

        together = -(-max(1, expanded.select("query").distinct().count()) // TOGETHER)
        group = F.pmod(F.xxhash64("query"), F.lit(together)).alias("together")
        words = terms.select("term").distinct()
        words = F.broadcast(words) if words.limit(ASKED + 1).count() <= ASKED else words
        kind = dict(terms.dtypes)["query"]

        def scored(spans: DataFrame, k: int) -> DataFrame:
            wanted = spans.select("query", "span", group)
            tf = F.transform("entries", lambda e: sum((F.lit(float(weights.get(f, 1.0))) * F.get(e["counts"], F.lit(i)) for i, f in enumerate(self.fields)), F.lit(0.0)))
            packed = blocks.join(words, "term", "left_semi").select("term", "span", F.col("entries.doc").alias("docs"), F.col("entries.length").alias("lengths"), tf.alias("tf"))
            held = packed.join(wanted.select("span", "together").distinct(), "span")
            asks = terms.select("query", "phrase", "prefix", "term", "worth", "mean").join(wanted, "query")
            held = held.select("term", "docs", "lengths", "tf", F.col("span").alias("of_span"), F.col("together").alias("of_group"))
            return held.groupBy("of_span", "of_group").cogroup(asks.groupBy("span", "together")).applyInPandas(_scores(k), f"query {kind}, doc bigint, score double")

        return bounds, scored


def _scores(k: int):
    def run(blocks: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        """The k best texts of a range for each of its queries; ties to the smaller id."""
        none = pd.DataFrame({"query": asks["query"].iloc[:0], "doc": np.empty(0, "int64"), "score": np.empty(0)})
        if not len(blocks) or not len(asks):
            return none
        docs, at = np.unique(np.concatenate(blocks["docs"].tolist()), return_inverse=True)
        ends = np.cumsum([len(d) for d in blocks["docs"]])[:-1]
        places = defaultdict(list)  # a term has a block for each time that texts of the range were added
        for term, place, tf in zip(blocks["term"], np.split(at, ends), blocks["tf"], strict=True):
            places[term].append((place, tf))
        length = np.empty(len(docs))
        length[at] = np.concatenate(blocks["lengths"].tolist())
        norm = K1 * (1 - B + B * length / asks["mean"].iloc[0])
        number, queries = pd.factorize(asks["query"])
        score = np.zeros((len(queries), len(docs)))
        asks = asks.assign(query=number)
        for _, own in asks.groupby(["phrase", "prefix"], sort=True):
            tf = np.zeros(len(docs))
            for term in own["term"].unique():
                for place, n in places.get(term, ()):
                    tf[place] += n
            met = np.flatnonzero(tf > 0)
            if len(met):
                each = own.drop_duplicates("query")
                score[np.ix_(each["query"].to_numpy(), met)] += np.outer(each["worth"].to_numpy(), tf[met] / (tf[met] + norm[met]))
        score = np.round(score, PLACES)
        out = []
        for q, row in enumerate(score):
            some = np.flatnonzero(row > 0)
            if len(some) > k:
                some = some[row[some] >= np.partition(row[some], -k)[-k]]
            some = some[np.lexsort((docs[some], -row[some]))[:k]]
            out.append((np.full(len(some), q), docs[some], row[some]))
        q, doc, best = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query": queries.take(q), "doc": doc, "score": best})

    return run


def _top(scores: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return scores.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def _write(docs: DataFrame, key: str, fields: dict[str, Column], path: str) -> None:
    spark = docs.sparkSession
    parts = parts_for(docs, EACH)
    # A text's rows lie in one partition from here on, so that its words are counted without a shuffle; a row for each different word is shuffled once, to its shelf.
    docs = docs.where(F.col(key).isNotNull()).withColumn("_doc", F.col(key).cast("bigint")).repartition(parts, "_doc")
    arrays = {f"f{i}": F.coalesce(c, F.array().cast("array<string>")) for i, c in enumerate(fields.values())}
    own = docs.select(F.col("_doc").alias("doc"), *[c.alias(n) for n, c in arrays.items()])
    own = own.withColumn("length", sum((F.size(n) for n in arrays), F.lit(0)).cast("bigint"))
    # The empty term, which no query asks for, has every text once: its blocks say how many texts there are, and of what length.
    tokens = F.posexplode(F.concat(*arrays, F.array(F.lit("")))).alias("at", "term")
    ends = [sum((F.size(n) for n in list(arrays)[: i + 1]), F.lit(0)).alias(f"e{i}") for i in range(len(arrays))]
    rows = own.select("doc", "length", *ends, tokens).where("term <> '' OR at = length")
    field = F.coalesce(*[F.when(F.col("at") < F.col(f"e{i}"), F.lit(i)) for i in range(len(arrays))], F.lit(-1))
    counts = rows.groupBy("doc", "length", "term").agg(F.array(*[F.count_if(field == i).cast("int") for i in range(len(fields))]).alias("counts"))
    # Ranges of ids in turn, so that a term that every text has, of few or of many, is dealt over tasks.
    turn = F.pmod(F.floor(F.col("span") / TURN), F.lit(TURNS))
    placed = counts.select("*", F.floor(F.col("doc") / SPAN).alias("span"), _shelf(F.col("term")).alias("shelf")).withColumn("slice", turn)
    most = F.array(*[F.max(F.get("counts", F.lit(i))) for i in range(len(fields))])
    blocks = placed.repartition(parts, "shelf", "slice").groupBy("shelf", "slice", "term", "span").agg(F.sort_array(F.collect_list(F.struct("doc", "length", "counts"))).alias("entries"), F.count("*").alias("n"), most.alias("most"), F.min("length").alias("least"))
    order, made = ["shelf", "term", "span"], uuid.uuid4().hex
    blocks = blocks.drop("slice").withColumn("made", F.lit(made)).sortWithinPartitions(*order)
    blocks.write.mode("append").option("compression", "zstd").partitionBy("made", "shelf").parquet(f"{path}/postings")
    written = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").where(F.col("made") == made)
    terms = written.where("term != ''").groupBy("term").agg(F.sum("n").alias("df"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("append").parquet(f"{path}/terms")
    every = written.where((F.col("shelf") == _shelf(F.lit(""))) & (F.col("term") == ""))
    lengths = F.aggregate("entries", F.lit(0).cast("bigint"), lambda a, e: a + e["length"])
    every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(lengths), F.lit(0)).alias("length")).withColumn("fields", F.array(*map(F.lit, fields))).write.mode("append").parquet(f"{path}/stats")


def phrases(queries: DataFrame, key: str, tokens: Column, prefix: bool = False) -> DataFrame:
    """Queries as TextIndex.search() takes them, from a table with an array of tokens a row."""
    return queries.select(F.col(key).alias("query"), F.explode(tokens).alias("phrase"), F.lit(prefix).alias("prefix"))


# Weights of a node's fields, scores of the ways that a node is found, and what is added to them.
NODE_WEIGHTS = {"name": 8.0, "qualified_name": 5.0, "path": 3.0, "kind": 1.0, "language": 1.0}
EXACT, FOUND, DEEPEST, LIKE, SEMANTIC, SYNTAX, NAMED_SO, PER_EDGE, MOST_EDGES = 120.0, 70.0, -20.0, 40.0, 10.0, 4.0, 20.0, 0.4, 12.0


def node_search(index: TextIndex, nodes: DataFrame, degree: DataFrame, query: str, terms: Iterable[str], limit: int = 20) -> DataFrame:
    """node_id, score and degree of the nodes that a query finds, best first, ties by path, start_line and id.

    nodes: node_id (whole number), name, qualified_name, path, kind, start_line, trust (`semantic`, `syntax` or other); degree: (node_id, degree). Exact names come first, then what the
    index has for any of the terms as prefixes, by weighted fields; where neither finds any, names and paths that contain the query. Each way gives its best max(40, 8 x limit)
    candidates; those are few, so that nodes and degrees meet them by broadcast.
    """
    limit = max(1, min(limit, 200))
    most, wanted = max(40, 8 * limit), query.strip().lower()
    terms = list(terms)
    own = nodes.where("kind != 'external'")
    is_name = (F.lower("name") == wanted) | (F.lower("qualified_name") == wanted)
    exact = own.where(is_name if wanted else F.lit(False)).orderBy("path", "start_line", "node_id").limit(most).select("node_id", F.lit(EXACT).alias("way"))
    asked = nodes.sparkSession.createDataFrame([(0, t, True) for t in terms], "query int, phrase string, prefix boolean")
    hits = index.search(asked, most, NODE_WEIGHTS, floor=True).select(F.col("doc").alias("node_id"), (FOUND + F.greatest(F.lit(DEEPEST), F.col("score"))).alias("way"))
    found = cut(exact.unionByName(hits).groupBy("node_id").agg(F.max("way").alias("way")))
    if found.isEmpty():
        holds = F.lit(False)
        for c in ("name", "qualified_name", "path"):
            holds = holds | F.contains(F.lower(c), F.lit(wanted))
        found = own.where(holds).orderBy("path", "start_line", "node_id").limit(most).select("node_id", F.lit(LIKE).alias("way"))
    few = F.broadcast(found)
    edges = degree.join(few, "node_id", "left_semi")
    bonus = F.when(F.col("trust") == "semantic", SEMANTIC).when(F.col("trust") == "syntax", SYNTAX).otherwise(0.0)
    scored = own.join(few, "node_id").join(edges, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))
    score = F.col("way") + bonus + F.least(F.lit(MOST_EDGES), PER_EDGE * F.col("degree")) + F.when(is_name, NAMED_SO).otherwise(0.0)
    return scored.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "path", "start_line", "node_id").limit(limit).select("node_id", "score", "degree")
