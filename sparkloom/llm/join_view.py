"""A stored full outer join, kept up to date by primary and secondary deltas of the side that changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, materialize, scratch_path, table

#: Places over which the stored rows of one key are spread, so that a hot key is never in one task.
SALTS = 16
#: Logs of changes that are read beside the stored rows before they are folded in.
LOGS = 16
_BAG = ["kind", "key", "l", "r", "n"]


def bag(rows: DataFrame, key: Column | str, part: list[str], count: Column | str | None = None) -> DataFrame:
    """Rows as counted copies: key, part (a struct of the named columns) and n, the sum of count (by default 1 a row; negative where rows go)."""
    n = F.lit(1) if count is None else F.col(count) if isinstance(count, str) else count
    kept = rows.select((F.col(key) if isinstance(key, str) else key).alias("key"), F.struct(*[F.col(f"`{c}`") for c in part]).alias("part"), n.cast("bigint").alias("n"))
    return kept.groupBy("key", "part").agg(F.sum("n").alias("n")).where("n != 0")


def _place() -> Column:
    """Where a stored row lies: one of SALTS places of its key; rows without a key, which no other row can match, by their parts."""
    parts = F.xxhash64("l", "r")
    return F.when(F.col("key").isNull(), parts).otherwise(F.xxhash64("key", F.pmod(parts, F.lit(SALTS))))


def _places(change: DataFrame, own: str) -> DataFrame:
    """The places that a change of one side may touch."""
    salts = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.xxhash64("key", s.cast("bigint")))
    parts = F.xxhash64(*[F.col("part") if c == own else F.lit(None).cast("string") for c in "lr"])
    return change.select(F.explode(F.when(F.col("key").isNull(), F.array(parts)).otherwise(salts)).alias("place"))


def _delta(change: DataFrame, other: DataFrame, view: DataFrame, own: str, opposite: str) -> DataFrame:
    """What a change (key, own part, n) of one side changes in the full outer join with the unchanged other side (key, opposite part, n).

    The primary delta is the change joined to the other side, outer on the changed side. The secondary delta removes orphans of the opposite side that found a
    partner and restores those that lost their last one: the stored view's rows of a part tell how many copies were matched and how many stood alone.
    """
    joined = change.join(other.select("key", opposite, F.col("n").alias("m")).hint("merge"), "key", "left")
    primary = joined.select("key", own, opposite, (F.col("n") * F.coalesce("m", F.lit(1))).alias("n"))
    none = F.lit(0).cast("bigint")
    alone = F.col(own).isNull()
    hits = joined.where("m is not null").select("key", opposite, (F.col("n") * F.col("m")).alias("matched"), none.alias("alone"), F.col("m").alias("copies"))
    stood = view.where(F.col(opposite).isNotNull()).select("key", opposite, F.when(alone, none).otherwise(F.col("n")).alias("matched"), F.when(alone, F.col("n")).otherwise(none).alias("alone"), F.lit(None).cast("bigint").alias("copies"))
    told = hits.unionByName(stood).groupBy("key", opposite).agg(F.sum("matched").alias("matched"), F.sum("alone").alias("alone"), F.max("copies").alias("copies")).where("copies is not null")
    secondary = told.select("key", opposite, (F.when(F.col("matched") == 0, F.col("copies")).otherwise(0) - F.col("alone")).alias("n")).where("n != 0")
    return primary.unionByName(secondary, allowMissingColumns=True)


class JoinView:
    """The full outer join of two tables of counted rows (see bag()) on their key, stored with both tables and maintained by batches of changes.

    Stored rows lie in buckets by place, so that a batch shuffles its changes and what they touch, never what is stored; a batch's own changes go to a log
    that later batches read beside it, and every LOGS batches logs are folded in. Keys may have any number of rows on either side, and one key any share of
    them: its rows are spread over SALTS places, and joins on changes are shuffles that adaptive execution splits. Nothing is collected or broadcast. Rows
    without a key match nothing and stand alone. Columns that are null are values like others; equal rows are copies. Empty tables and batches are fine.
    Taking away copies that aren't there is an error.
    """

    def __init__(self, left: DataFrame, right: DataFrame):
        """left, right: bags (key, part, n) at the start."""
        self.spark = left.sparkSession
        a, b = left.withColumnRenamed("part", "l"), right.withColumnRenamed("part", "r")
        a, b = materialize(a, "left"), materialize(b, "right")
        both = a.join(b.select("key", "r", F.col("n").alias("m")).hint("merge"), "key", "left")
        lone = b.join(a.select("key").distinct().hint("merge"), "key", "left_anti")
        view = both.select("key", "l", "r", (F.col("n") * F.coalesce("m", F.lit(1))).alias("n")).unionByName(lone, allowMissingColumns=True)
        tall = [x.select(F.lit(kind).alias("kind"), *x.columns) for kind, x in (("l", a), ("r", b), ("v", view))]
        rows = tall[0].unionByName(tall[1], allowMissingColumns=True).unionByName(tall[2], allowMissingColumns=True)
        self.logs: list[DataFrame] = []
        self._store(rows)

    def _store(self, rows: DataFrame) -> None:
        self.base = bucketed(rows.select(*_BAG, _place().alias("place")), "join_view", ["place"])

    def _sum(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("kind", "key", "l", "r").agg(F.sum("n").alias("n")).where("n != 0")

    def rows(self) -> DataFrame:
        """The joined rows as they stand: key, l, r (null: padded) and n, their copies."""
        return self._sum(self._all().where("kind = 'v'")).drop("kind")

    def _all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.logs, self.base)

    def fold(self) -> None:
        """Folds the logs into the stored rows."""
        self._store(self._sum(self._all()))
        self.logs = []

    def apply(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Takes in one batch, bags (key, part, n) with negative n for copies that go; gives the joined rows whose copies changed: key, l, r, weight (copies after
        less copies before) and total (after)."""
        dl, dr = (materialize(x.select("key", "part", "n"), "changes") for x in (left, right))
        places = _places(dl, "l").unionByName(_places(dr, "r")).distinct().hint("merge")
        found = self.base.join(places, "place", "left_semi").select(*_BAG)
        if self.logs:
            found = found.unionByName(reduce(DataFrame.unionByName, self.logs).join(places, "place", "left_semi").select(*_BAG))
        touched = materialize(self._sum(found), "touched")
        of = {kind: touched.where(F.col("kind") == kind).drop("kind") for kind in "lrv"}
        dl, dr = dl.withColumnRenamed("part", "l"), dr.withColumnRenamed("part", "r")
        one = materialize(_delta(dl, of["r"].select("key", "r", "n"), of["v"], "l", "r").select("key", "l", "r", "n"), "left-delta")
        after = of["l"].select("key", "l", "n").unionByName(dl).groupBy("key", "l").agg(F.sum("n").alias("n")).where("n != 0")
        two = _delta(dr, after, of["v"].unionByName(one), "r", "l").select("key", "l", "r", "n")
        none = F.lit(0).cast("bigint")
        moved = one.unionByName(two).select("key", "l", "r", F.col("n").alias("weight"), none.alias("before"))
        was = of["v"].select("key", "l", "r", none.alias("weight"), F.col("n").alias("before"))
        total = F.col("weight") + F.col("before")
        out = moved.unionByName(was).groupBy("key", "l", "r").agg(F.sum("weight").alias("weight"), F.sum("before").alias("before")).where("weight != 0")
        out = materialize(out.select("key", "l", "r", "weight", F.when(total < 0, F.raise_error(F.lit("a batch takes away copies that aren't there"))).otherwise(total).alias("total")), "view-delta")
        tall = [x.select(F.lit(kind).alias("kind"), *x.columns) for kind, x in (("l", dl), ("r", dr), ("v", out.select("key", "l", "r", F.col("weight").alias("n"))))]
        log = tall[0].unionByName(tall[1], allowMissingColumns=True).unionByName(tall[2], allowMissingColumns=True)
        self.logs.append(materialize(log.select(*_BAG, _place().alias("place")), "log"))
        if len(self.logs) >= LOGS:
            self.fold()
        return out


#: Batches that the query takes the view through.
BATCHES = 3


def _feed(rows: DataFrame, tag: str, key, part) -> DataFrame:
    """The changes (batch, key, part, n) that the query's rules give for each row by its id; batch 0 is the start. key, part: from the number of updates so far."""
    c = lambda t: F.crc32(F.concat(F.lit(f"{tag}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{t}")))
    state = lambda t, there, sign, updates: F.when(there, F.struct(F.lit(t).alias("batch"), key(updates).cast("bigint").alias("key"), part(updates).alias("part"), F.lit(sign).alias("n")))
    there, updates = c(0) % 3 != 0, F.lit(0)
    changes = [state(0, there, 1, updates)]
    for t in range(1, BATCHES + 1):
        rows = rows.withColumns({f"there{t}": there, f"updates{t}": updates, f"c{t}": c(t) % 31})
        was, before = F.col(f"there{t}"), F.col(f"updates{t}")
        flip, update = F.col(f"c{t}") == 0, (F.col(f"c{t}") == 1) & was
        there, updates = was != flip, before + update.cast("int")
        changes += [state(t, (flip | update) & was, -1, before), state(t, (flip | update) & there, 1, updates)]
    one = rows.select(F.explode(F.filter(F.array(*changes), lambda x: x.isNotNull())).alias("x")).select("x.*")
    return one.groupBy("batch", "key", "part").agg(F.sum(F.col("n").cast("bigint")).alias("n")).where("n != 0")


def _written(feed: DataFrame, name: str) -> list[DataFrame]:
    """The feed's batches, from files of their own."""
    path = scratch_path(feed.sparkSession, name)
    feed.write.partitionBy("batch").parquet(path)
    back = feed.sparkSession.read.schema(feed.schema).parquet(path)
    return [back.where(F.col("batch") == t).drop("batch") for t in range(BATCHES + 1)]


def op11_join_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full outer join of documents and labels on join_key through three batches: the joined rows whose copies changed in each.

    Rows without a doc_id have no join_key and stand alone; their rules go by `null` in place of the id.
    """
    fifth = F.floor(F.col("doc_id") / 5)
    docs = _feed(table(spark, sf_dir, "documents").select("doc_id", "lang"), "d", lambda u: fifth + u, lambda u: F.struct("lang"))
    quality = lambda u: F.when(u % 2 == 0, F.col("quality")).otherwise(1 - F.col("quality"))
    labels = _feed(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "l", lambda u: fifth, lambda u: F.struct(quality(u).alias("quality"), F.col("toxic")))
    left, right = _written(docs, "document-changes"), _written(labels, "label-changes")
    view, out = JoinView(left[0], right[0]), None
    told = lambda part, names: F.when(F.col(part).isNull(), "-").otherwise(F.concat_ws(",", *[F.coalesce(F.col(f"{part}.{c}").cast("string"), F.lit("null")) for c in names]))
    for t in range(1, BATCHES + 1):
        changed = view.apply(left[t], right[t]).select(F.lit(t).alias("batch"), F.col("key").alias("join_key"), told("l", ["lang"]).alias("doc_part"), told("r", ["quality", "toxic"]).alias("label_part"), "weight", "total")
        out = changed if out is None else out.unionByName(changed)
    return out


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text of ASCII letters, as SQL."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {step}), 4294967295::BIGINT)"


def _states_sql(source: str, tag: str, key: str, part: str) -> str:
    """CTEs of a table's rows (t, join_key, part) at each t; u stands for the updates so far."""
    out = [f"{tag}0 AS (SELECT *, {_crc32(f"concat('{tag}:', coalesce(doc_id::VARCHAR, 'null'), ':0')")} % 3 != 0 AS here, 0 AS u FROM {source})"]
    for t in range(1, BATCHES + 1):
        out.append(f"""{tag}{t} AS (SELECT * EXCLUDE (here, u, c), here != (c = 0) AS here, u + (here AND c = 1)::INT AS u
          FROM (SELECT *, {_crc32(f"concat('{tag}:', coalesce(doc_id::VARCHAR, 'null'), ':{t}')")} % 31 AS c FROM {tag}{t - 1}))""")
    out.append(f"{tag} AS (" + " UNION ALL ".join(f"SELECT {t} AS t, {key} AS join_key, {part} AS part FROM {tag}{t} WHERE here" for t in range(BATCHES + 1)) + ")")
    return ", ".join(out)


OP11_SQL = f"""
WITH {_states_sql("documents", "d", "floor(doc_id / 5)::BIGINT + u", "coalesce(lang, 'null')")},
     {_states_sql("labels", "l", "floor(doc_id / 5)::BIGINT", "concat(coalesce((CASE WHEN u % 2 = 0 THEN quality ELSE 1 - quality END)::VARCHAR, 'null'), ',', coalesce(toxic::VARCHAR, 'null'))")},
     joined AS (SELECT coalesce(d.t, l.t) AS t, coalesce(d.join_key, l.join_key) AS join_key, coalesce(d.part, '-') AS doc_part, coalesce(l.part, '-') AS label_part
                FROM d FULL JOIN l ON d.t = l.t AND d.join_key = l.join_key),
     signed AS (SELECT t AS batch, join_key, doc_part, label_part, 1 AS w, 1 AS after FROM joined WHERE t > 0
                UNION ALL SELECT t + 1, join_key, doc_part, label_part, -1, 0 FROM joined WHERE t < {BATCHES})
SELECT batch::INT AS batch, join_key, doc_part, label_part, sum(w)::BIGINT AS weight, sum(after)::BIGINT AS total
FROM signed GROUP BY ALL HAVING sum(w) != 0
"""
