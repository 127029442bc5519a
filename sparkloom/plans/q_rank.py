"""Retrieval: BM25, cosine, hybrid scores, searches by tokens, trigrams and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats, text as tx
from ..operators import rank, textindex
from ..sources.tables import scratch, table
from .registry import query

_WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
_TF = f"WITH t AS (SELECT doc_id, list_filter({_WORDS}, lambda x: length(x) >= 2) AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t), q AS (SELECT unnest(['that', 'der', 'idiot']) AS q), tf AS (SELECT doc_id, q, len(w) AS len, len(list_filter(w, lambda x: x = q)) AS f FROM t, q), df AS (SELECT q, count(*) AS df FROM tf WHERE f > 0 GROUP BY q)"
_QUERY = ["that", "der", "idiot"]


@query(_TF + " SELECT doc_id, round(1 - exp(-sum(CASE WHEN f > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / greatest(a, 1))) ELSE 0 END)), 6) AS score FROM tf JOIN df USING (q), s GROUP BY doc_id")
def bm25_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return rank.bm25(d, "doc_id", tx.tokens(F.col("text"), "word"), _QUERY).withColumn("score", F.round("score", 6))


_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))"
_NORM = "sqrt(list_sum(list_transform(range(1, 65), lambda i: CAST({0}.embedding[i] AS DOUBLE) * CAST({0}.embedding[i] AS DOUBLE))))"


@query(f"SELECT vec_id, similarity FROM (SELECT a.vec_id, round(least(greatest(({_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}) + 1) / 2, 0), 1), 6) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) b)")
def cosine_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    one = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(stats.cosine_unit(F.col("embedding"), F.col("q")), 6).alias("similarity"))


@query("SELECT event_id, round(exp(-ln(2) * greatest(epoch((SELECT max(ts) FROM events)) - epoch(ts), 0) / 2592000.0), 6) AS recency FROM events")
def half_life_decay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    newest = e.agg(F.max("ts").alias("now"))
    age = F.unix_micros(F.col("now").cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.crossJoin(F.broadcast(newest)).select("event_id", F.round(stats.half_life(age), 6).alias("recency"))


_HYBRID = "SELECT doc_id, source, round(0.35 * least(n_chars / 5000.0, 1) + 0.30 * (doc_id % 11) / 10.0 + 0.15 * (doc_id % 7) / 6.0 + 0.10 * (doc_id % 5) / 4.0 + 0.10 * (doc_id % 3) / 2.0, 9) AS score FROM documents"


@query(f"WITH s AS ({_HYBRID}) SELECT doc_id, round(score, 6) AS score, round(adjusted, 6) AS adjusted FROM (SELECT *, score - 0.15 * (row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id DESC) - 1) AS adjusted FROM s) ORDER BY adjusted DESC, doc_id DESC LIMIT 10")
def hybrid_rank(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    part = lambda m: (F.col("doc_id") % m) / (m - 1.0)
    scored = rank.hybrid(d, F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), part(11), part(7), part(5), part(3)).withColumn("score", F.round("score", 9))
    out = rank.diverse(scored, "source", "doc_id", "score", 10)
    return out.select("doc_id", F.round("score", 6).alias("score"), F.round("adjusted", 6).alias("adjusted"))


@query("SELECT event_id, round(value / 100 * 0.5 * 1 * (event_id % 5 + 1) / (event_id % 3 + 1) * log2(2 + event_id % 8), 6) AS roi FROM events ORDER BY roi DESC, event_id LIMIT 20")
def ranked_by_roi(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    worth = stats.roi(F.col("value") / 100, F.lit(0.5), F.lit(1), k % 5, k % 3, k % 8)
    return e.select("event_id", F.round(worth, 6).alias("roi")).orderBy(F.desc("roi"), "event_id").limit(20)


_TRI = "list_distinct(list_transform(range(1, greatest(length({0}) - 2, 1) + 1), lambda i: substring({0}, i, 3)))"


@query(f"SELECT p_partkey, round(len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))), 6) AS near FROM (SELECT p_partkey, {_TRI.format('lower(p_name)')} AS t, {_TRI.format(chr(39) + 'small red ring' + chr(39))} AS u FROM part)")
def trigram_jaccard(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(tx.jaccard(tx.trigrams(F.col("p_name")), tx.trigrams(F.lit("small red ring"))), 6).alias("near"))


_PLAIN = "trim(regexp_replace(regexp_replace(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT conv_id, turn, {_PLAIN} AS t FROM conversations),
g AS (SELECT conv_id, turn, t, list_distinct(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substring(t, i, 3))) AS a, ['tha', 'hat', 'at ', 't i', ' id', 'ide', 'dea'] AS q, list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_./:-]+'), lambda x: length(x) >= 2) AS w FROM p),
j AS (SELECT *, len(list_intersect(a, q)) / len(list_distinct(list_concat(a, q))) AS near FROM g),
s AS (SELECT conv_id, turn, 4.0 * len(list_intersect(w, ['that', 'idea'])) + CASE WHEN contains(t, 'that idea') THEN 8 ELSE 0 END + CASE WHEN near >= 0.04 THEN least(near * 12, 4) ELSE 0 END AS score FROM j)
SELECT conv_id, turn, round(score, 6) AS score FROM s WHERE score > 1.6 ORDER BY 3 DESC, conv_id, turn LIMIT 50""")
def session_search(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    scored = rank.session_scores(c, F.col("text"), "that idea", ["that", "idea"])
    return scored.where("score > 1.6").select("conv_id", "turn", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "conv_id", "turn").limit(50)


@query("SELECT doc_id, CAST(len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 2)), ['that', 'the', 'idiot'])) AS INT) AS shared FROM documents ORDER BY shared DESC, doc_id LIMIT 40")
def token_overlap_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    shared = tx.overlap(F.array_distinct(tx.tokens(F.col("text"), "word")), ["that", "the", "idiot"])
    return d.select("doc_id", shared.alias("shared")).orderBy(F.desc("shared"), "doc_id").limit(40)


@query("SELECT p_partkey, CASE WHEN lower(p_name) = 'red ring' THEN 120.0 ELSE 0 END + CASE WHEN lower(p_name) LIKE '%ring%' THEN 40.0 ELSE 0 END + least(12, 0.4 * coalesce(n, 0)) AS score FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey ORDER BY score DESC, p_partkey LIMIT 30")
def repository_query(spark, sf_dir):
    degree = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = table(spark, sf_dir, "part").join(degree, F.col("p_partkey") == F.col("l_partkey"), "left")
    score = F.when(F.lower("p_name") == "red ring", 120.0).otherwise(0.0) + F.when(F.lower("p_name").contains("ring"), 40.0).otherwise(0.0) + F.least(F.lit(12.0), 0.4 * F.coalesce("n", F.lit(0)))
    return p.select("p_partkey", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(30)


@query("""SELECT doc_id, CAST(line - 1 AS INT) AS line, 3.0 * CASE WHEN list_contains(list_distinct(regexp_extract_all(lower(text), '[a-z_][a-z0-9_.:/-]{1,}')), 'token') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'token =') THEN 4.0 ELSE 0 END AS score
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
WHERE list_contains(regexp_extract_all(lower(text), '[a-z_][a-z0-9_.:/-]{1,}'), 'token') OR contains(lower(text), 'token =')""")
def line_search(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return rank.line_search(d, "doc_id", F.col("text"), ["token"], "token =").where(~F.col("text").rlike(tx.ERROR_LINE)).select("doc_id", "line", "score")


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 2)) AS t FROM documents),
c AS (SELECT doc_id, CAST('0x' || left(h, 8) AS BIGINT) % 128 AS i, sum(CASE WHEN CAST('0x' || substring(h, 9, 2) AS BIGINT) % 2 = 1 THEN -1 ELSE 1 END * (1 + ln(1 + length(t)))) AS w FROM (SELECT doc_id, t, sha256(t) AS h FROM t) GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM c GROUP BY doc_id),
v AS (SELECT d.doc_id, g.i, CAST(round(coalesce(w, 0) / coalesce(nullif(norm, 0), 1) * 1000) AS BIGINT) AS x FROM documents d CROSS JOIN (SELECT unnest(range(128)) AS i) g LEFT JOIN c ON c.doc_id = d.doc_id AND c.i = g.i LEFT JOIN n ON n.doc_id = d.doc_id)
SELECT doc_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY i) AS vector FROM v GROUP BY doc_id""")
def hash_embedding(spark, sf_dir):
    """Vectors of 128 cells, in thousandths."""
    found = rank.hash_embedding(table(spark, sf_dir, "documents"), "doc_id", tx.tokens(F.col("text"), "word"))
    return found.select("doc_id", F.array_join(F.transform("vector", lambda x: F.round(x * 1000).cast("bigint")), ",").alias("vector"))


_FIELD = "list_filter(regexp_extract_all(lower({0}), '[a-z]+'), lambda x: length(x) >= 2)"


@query(f"""WITH d AS (SELECT doc_id, coalesce({_FIELD.format("text")}, []) AS w, coalesce({_FIELD.format("source")}, []) AS s FROM documents),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_FIELD.format("text")}) AS t FROM benchmark) GROUP BY ALL),
n AS (SELECT count(*) AS n, greatest(sum(len(w) + len(s)) / count(*), 1) AS mean FROM d),
e AS (SELECT doc_id, length, t, sum(x) AS tf FROM (SELECT doc_id, len(w) + len(s) AS length, unnest(w) AS t, 1.0 AS x FROM d UNION ALL SELECT doc_id, len(w) + len(s), unnest(s), 3.0 FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM e GROUP BY t),
r AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM q JOIN e USING (t) JOIN df USING (t), n GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM r) WHERE place <= 10""")
def text_index_search(spark, sf_dir):
    """The ten best documents for every benchmark item, by a stored index of two weighted fields."""
    fields = {"text": tx.tokens(F.col("text"), "word"), "source": tx.tokens(F.col("source"), "word")}
    index = textindex.TextIndex.build(table(spark, sf_dir, "documents"), "doc_id", fields, scratch(spark, "text-index"))
    asked = textindex.phrases(table(spark, sf_dir, "benchmark"), "item_id", tx.tokens(F.col("text"), "word"))
    found = index.search(asked, 10, {"source": 3.0})
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


_PART = "SELECT p_partkey AS id, lower(p_name) AS name, lower(p_brand || '.' || p_name) AS qualified, replace(p_type, ' ', '/') AS path, p_size FROM part"


@query(f"""WITH p AS ({_PART}), f AS (SELECT id, x.w AS w, x.l AS l FROM (SELECT id, unnest([{{w: 8.0, l: regexp_extract_all(name, '[a-z0-9]+')}}, {{w: 5.0, l: regexp_extract_all(qualified, '[a-z0-9]+')}}, {{w: 3.0, l: regexp_extract_all(lower(path), '[a-z0-9]+')}}]) AS x FROM p)),
len AS (SELECT id, sum(len(l)) AS length FROM f GROUP BY id), n AS (SELECT count(*) AS n, avg(length) AS mean FROM len), t AS (SELECT id, w, unnest(l) AS t FROM f),
h AS (SELECT id, q, sum(w) AS tf FROM t JOIN (SELECT unnest(['red', 'ri', 'st']) AS q) ON starts_with(t, q) GROUP BY ALL), df AS (SELECT q, count(*) AS df FROM h GROUP BY q),
s AS (SELECT id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM h JOIN df USING (q) JOIN len USING (id), n GROUP BY id),
e AS (SELECT id, 120.0 AS way FROM (SELECT id FROM p WHERE name = 'red ring' OR qualified = 'red ring' ORDER BY path, id LIMIT 240) UNION ALL (SELECT id, 70 + greatest(-20, score) FROM s ORDER BY score DESC, id LIMIT 240)),
d AS (SELECT l_partkey, count(*) AS degree FROM lineitem GROUP BY l_partkey),
r AS (SELECT id, path, round(max(way) + CASE WHEN max(p_size) % 3 = 0 THEN 10.0 WHEN max(p_size) % 3 = 1 THEN 4.0 ELSE 0 END + least(12, 0.4 * coalesce(max(degree), 0)) + CASE WHEN name = 'red ring' OR qualified = 'red ring' THEN 20 ELSE 0 END, 6) AS score, coalesce(max(degree), 0) AS degree FROM e JOIN p USING (id) LEFT JOIN d ON l_partkey = id GROUP BY id, path, name, qualified)
SELECT id AS node_id, score, degree FROM r ORDER BY score DESC, path, id LIMIT 30""")
def node_search(spark, sf_dir):
    """Nodes by exact name, weighted fields with prefixes, trust and degree; parts stand for nodes."""
    p = table(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.replace("p_type", F.lit(" "), F.lit("/")).alias("path"), F.lit("part").alias("kind"), F.lit(0).alias("start_line"), F.when(F.col("p_size") % 3 == 0, "semantic").when(F.col("p_size") % 3 == 1, "syntax").alias("trust"))
    fields = {c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)) for c in ("name", "qualified_name", "path")}
    index = textindex.TextIndex.build(nodes, "node_id", fields, scratch(spark, "node-index"))
    degree = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node_id")).agg(F.count("*").alias("degree"))
    return textindex.node_search(index, nodes, degree, "red ring", ["red", "ri", "st"], 30)
