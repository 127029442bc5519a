"""Ranked retrieval: BM25, hybrid scores with source diversity, token and trigram searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text as tx
from .graph import cut

# Saturation and length weight of BM25, weights of the hybrid score, penalty of a repeated source.
K1, B = 1.2, 0.75
WEIGHTS = {"lexical": 0.35, "vector": 0.30, "graph": 0.15, "temporal": 0.10, "authority": 0.10}
DIVERSITY = 0.15
# Synonyms that a session query is widened by.
ALIASES = {
    "auth": ["authentication", "authorization", "credential", "login"],
    "authentication": ["auth", "credential", "login"],
    "authorization": ["auth", "permission", "access"],
    "crash": ["failure", "fatal", "panic", "exception", "segfault"],
    "failure": ["failed", "error", "crash", "fatal"],
    "refresh": ["renew", "rotate", "rotation"],
    "token": ["credential", "jwt", "bearer"],
    "memory": ["context", "history", "recall"],
    "slow": ["latency", "performance", "timeout"],
    "delete": ["remove", "purge", "drop"],
    "fix": ["repair", "resolve", "patch"],
    "old": ["previous", "prior", "superseded"],
    "new": ["latest", "current", "replacement"],
    "karar": ["decision", "choice"],
    "hata": ["error", "failure", "bug"],
    "çökme": ["crash", "failure", "panic"],
}


def expand(query: list[str]) -> list[str]:
    """The query's tokens and their synonyms, in order, once each."""
    return list(dict.fromkeys([*query, *(a for t in query for a in ALIASES.get(t, ()))]))


def term_counts(df: DataFrame, key: str, tokens: Column, query: list[str]) -> DataFrame:
    """(key, length, tf of each query token) in one narrow pass: no token is exploded, only the query's are counted."""
    own = df.select(F.col(key), tokens.alias("_t"))
    counts = [(F.size("_t") - F.size(F.array_remove("_t", q))).alias(f"tf{i}") for i, q in enumerate(query)]
    return own.select(key, F.size("_t").alias("length"), *counts)


def bm25(df: DataFrame, key: str, tokens: Column, query: list[str], saturate: bool = True, floor: bool = False) -> DataFrame:
    """(key, score): BM25 of a whole table for one query; 1 - exp(-s) where saturated, for tokens that repeat in the query up to twice. With floor, a token's
    weight is that of full-text indexes: it may be 1e-6 at least where most texts have it.

    Counts are written, a narrow row a text, so that texts are read and cut into tokens once; corpus counts are one aggregate row of them, which goes to all
    tasks as a single broadcast row.
    """
    terms = list(dict.fromkeys(query))
    tf = cut(term_counts(df, key, tokens, terms))
    stats_ = tf.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    both = tf.crossJoin(F.broadcast(stats_))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        ratio = (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)
        idf = F.greatest(F.log(ratio), F.lit(1e-6)) if floor else F.log(1 + ratio)
        norm = F.col(f"tf{i}") + K1 * (1 - B + B * F.col("length") / F.greatest(F.col("avg_length"), F.lit(1.0)))
        score = score + F.when(F.col(f"tf{i}") > 0, idf * F.col(f"tf{i}") * (K1 + 1) / norm * min(2, query.count(t))).otherwise(0.0)
    return both.select(key, ((1 - F.exp(-score)) if saturate else score).alias("score"))


def hybrid(df: DataFrame, lexical: Column, vector: Column, graph: Column, temporal: Column, authority: Column) -> DataFrame:
    """score: the weighted sum of unit parts."""
    w = WEIGHTS
    return df.withColumn("score", w["lexical"] * lexical + w["vector"] * vector + w["graph"] * stats.unit(graph) + w["temporal"] * temporal + w["authority"] * stats.unit(authority))


def diverse(df: DataFrame, source: str, key: str, score: str, limit: int, penalty: float = DIVERSITY) -> DataFrame:
    """The greedy choice with a penalty for every earlier row of the same source, without a loop: within a source rows are taken by score,
    so that the k-th has the penalty (k - 1) times; then one top-k. Rows without a source have none.

    No more than `limit` rows of a source can be among the best: rank limits drop the others before the shuffle, and rows without a source are a top-k of their own.
    """
    none = F.col(source).isNull() | (F.col(source) == "")
    place = F.row_number().over(Window.partitionBy(source).orderBy(F.desc(score), F.desc(key)))
    named = df.where(~none).withColumn("_place", place).where(F.col("_place") <= limit)
    best = named.withColumn("adjusted", F.col(score) - penalty * (F.col("_place") - 1)).drop("_place")
    free = df.where(none).orderBy(F.desc(score), F.desc(key)).limit(limit).withColumn("adjusted", F.col(score).cast("double"))
    return best.unionByName(free).orderBy(F.desc("adjusted"), F.desc(key)).limit(limit)


def hash_embedding(df: DataFrame, key: str, tokens: Column, size: int = 128) -> DataFrame:
    """(key, vector): each token adds 1 + ln(1 + length) to the cell that its SHA-256 names, with the sign that it names; unit length, zeros without tokens.

    Cells are sums by key and cell, which combine on the map side, so that no more than `size` rows a key are shuffled.
    """
    digest = lambda t: F.sha2(t, 256)
    # The cell is the first 32 bits modulo the size: of a power of two up to 256, the last of their bytes says it all.
    number = F.conv(F.substring("_h", 7, 2) if size & (size - 1) == 0 and size <= 256 else F.substring("_h", 1, 8), 16, 10).cast("bigint") % size
    sign = F.when(F.substring("_h", 10, 1).isin(*"13579bdf"), -1.0).otherwise(1.0)
    each = df.select(key, F.explode_outer(tokens).alias("_t")).select(key, digest(F.col("_t")).alias("_h"), (1 + F.log1p(F.length("_t"))).alias("_w"))
    cells = each.groupBy(key, number.cast("int").alias("i")).agg(F.sum(sign * F.col("_w")).alias("w"))
    rows = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "w")))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    at = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.coalesce(F.nullif("norm", F.lit(0.0)), F.lit(1.0))
    return rows.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at).alias("vector"))


def weighted_fields(df: DataFrame, key: str, fields: dict[str, float], query: list[str]) -> DataFrame:
    """(key, score): weighted counts of the query's tokens over several fields."""
    score = F.lit(0.0)
    for c, w in fields.items():
        own = tx.tokens(F.coalesce(F.col(c), F.lit("")))
        score = score + w * tx.overlap(F.array_distinct(own), query)
    return df.select(key, score.alias("score"))


def session_scores(df: DataFrame, text: Column, query: str, tokens: list[str]) -> DataFrame:
    """score of session events: 4 a direct token, 1.75 an alias (up to 8), 8 for the whole phrase, 12 times the trigram Jaccard from 0.04 up to 4.

    The query has few trigrams: a text has those that are found in it, and how many others it has makes the union's size. A text without any is none's match,
    so that its own trigrams aren't made; nor are those of one that is so long that its Jaccard must stay below 0.04.
    """
    plain = tx.collapse(tx.session_normal(text))
    own = F.array_distinct(tx.tokens(tx.session_normal(text), "session"))
    direct = tx.overlap(own, tokens)
    aliases = [t for t in expand(tokens) if t not in tokens]
    alias = F.least(tx.overlap(own, aliases), F.lit(8)) if aliases else F.lit(0)
    phrase = F.when(F.contains(plain, F.lit(query.lower())), 8.0).otherwise(0.0)
    wanted = tx.gram_list(query)
    shared = sum((F.contains(F.col("_plain"), F.lit(g)).cast("int") for g in wanted), F.lit(0))
    found = df.withColumn("_plain", plain).withColumn("_shared", shared)
    size = F.size(tx.grams(F.col("_plain")))
    # The Jaccard is shared / (wanted + size - shared).
    near = F.when(F.col("_shared") > 0, F.col("_shared") / (len(wanted) + size - F.col("_shared"))).otherwise(0.0)
    points = F.when(F.col("_shared") > 0, tx.let(near, lambda j: F.when(j >= 0.04, F.least(j * 12, F.lit(4.0))).otherwise(0.0))).otherwise(0.0)
    return found.withColumn("score", direct * 4.0 + alias * 1.75 + phrase + points).drop("_plain", "_shared")


def line_search(df: DataFrame, key: str, text: Column, query: list[str], phrase: str) -> DataFrame:
    """(key, line, text, score): lines by 3 a shared token, 4 for the phrase, 1.5 for an error word; those above zero."""
    rows = df.select(key, F.posexplode(tx.lines(text)).alias("line", "text"))
    score = tx.overlap(F.array_distinct(tx.tokens(F.col("text"), "segment")), query) * 3.0 + F.when(F.contains(F.lower("text"), F.lit(phrase.lower())), 4.0).otherwise(0.0)
    found = rows.withColumn("score", score).where("score > 0")
    return found.withColumn("score", F.col("score") + F.when(F.col("text").rlike(tx.ERROR_LINE), 1.5).otherwise(0.0))
