"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow whose documents queue in a shuffled order (by a keyed md5) and
come round up to three times. A queued document's virtual finish time is the
cumulative number of its source's words, itself included, divided by the source's
target; the mix is the head of the global order by finish time whose words fit the
total budget. Prefix sums are taken in two levels (buckets of the shuffled order,
then rows of a bucket), so no source and no order meets in one task.

Edge cases: a null text has size 0; a null source is a source, the last one; a
document of size 0 is taken 0 words; rows alike in doc_id, source and size are taken
equally often; a source of size 0 has target 0; an empty table gives an empty
result. Only doc_id, source and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.tables import fresh, small, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
ROUNDS = 3
SEED = "mix-1"
#: Steps of virtual time in which words are summed before the step that holds the cut is ordered row by row.
STEPS = 4096


def targets(sizes: DataFrame, weights=WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """(rank, source, source_size, target) from (source, source_size): weights repeat over the sources by code point, null last.

    One row a source. Shares of the total by weight; a target above `rounds` times its
    source's size stops there, and the rest is shared by weight again (water-filling:
    with sources ordered by limit / weight, the level is the first that its own source can hold).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(by_name))
    turn = (F.col("rank") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("ratio", (rounds * F.col("source_size")) / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "rank")
    every = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(every) - rounds * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest))
    s = s.withColumn("fill", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every))
    held = F.struct("ratio", "rank") < F.struct("fill.ratio", "fill.rank")
    return s.select("rank", "source", "source_size", F.when(held, (rounds * F.col("source_size")).cast("double")).otherwise(F.col("fill.level") * F.col("weight")).alias("target"))


def _place(e: int) -> Column:
    """Where the document's copy of round e stands in the global order."""
    finish = (e * F.col("source_size") + F.col("cum")) / F.col("target")
    return F.struct(finish.alias("finish"), "rank", "key", F.col("doc_id").alias("id"), "size", F.lit(e).alias("round"))


def mix(docs: DataFrame, seed: str = SEED, weights=WEIGHTS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for each document."""
    docs = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    docs = written(docs)
    flows = written(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, rounds))
    flow = small(flows.withColumnRenamed("source", "name"), 64)
    rows = docs.join(flow, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("part", F.substring("key", 1, 3))
    sums = rows.groupBy("rank", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "part", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("rank", "part").orderBy("key", "doc_id", "size")  # peers share a sum
    rows = rows.join(sums, ["rank", "part"]).withColumn("cum", F.col("ahead") + F.sum("size").over(within)).drop("part", "ahead")
    queue = written(rows)

    total = queue.agg(F.sum("size")).first()[0] or 0
    places = F.array(*[_place(e) for e in range(rounds)])
    copies = queue.filter("size > 0").select("size", F.explode(places).alias("place")).withColumn("step", F.least(F.floor(F.col("place.finish") * STEPS), F.lit(4 * STEPS)))
    # words up to each step of virtual time, at most 4 * STEPS + 1 rows
    upto = copies.groupBy("step").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(Window.orderBy("step")))
    cut = upto.filter(F.col("upto") > total).orderBy("step").select("step", (F.col("upto") - F.col("words")).alias("ahead")).head()
    if cut is None:
        taken = F.lit(rounds if total else 0)
    else:
        inside = copies.filter(F.col("step") == cut["step"]).withColumn("cum", cut["ahead"] + F.sum("size").over(Window.orderBy("place")))
        last = inside.filter(F.col("cum") <= total).agg(F.max("place").alias("p")).first()["p"]
        if last is None:
            taken_in = [F.floor(_place(e)["finish"] * STEPS) < cut["step"] for e in range(rounds)]
        else:
            kinds = dict(inside.select("place.*").dtypes)
            edge = F.struct(*[F.lit(last[k]).cast(kinds[k]).alias(k) for k in ("finish", "rank", "key", "id", "size", "round")])
            taken_in = [_place(e) <= edge for e in range(rounds)]
        taken = sum((x.cast("int") for x in taken_in), F.lit(0))
    queue = queue.withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)))
    return queue.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with the columns of docs."""
    id_, source, size, copies, words = fresh(docs, "_id", "_source", "_size", "_copies", "_words")
    taken = mix(docs, **options).filter("copies > 0")
    taken = written(taken.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size), F.col("copies").alias(copies)).distinct())
    sized = docs.withColumn(words, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(words) == F.col(size))
    out = sized.join(small(taken, 64), same)
    return out.withColumn(words, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(seed: str = SEED) -> str:
    """The same rows in DuckDB SQL (production weights and rounds)."""
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM n),
r AS (SELECT *, (3 * source_size) / weight AS ratio FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::BIGINT - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
             / (sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM r),
f AS (SELECT ratio AS f_ratio, rank AS f_rank, level AS f_level FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
t AS (SELECT source, rank, source_size, CASE WHEN (ratio, rank) < (f_ratio, f_rank) THEN (3 * source_size)::DOUBLE ELSE f_level * weight END AS target FROM l, f),
q AS (SELECT d.*, t.rank, t.source_size, t.target,
             (sum(d.size) OVER (PARTITION BY t.rank ORDER BY key, doc_id, d.size))::BIGINT AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, e, (e * source_size + cum) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, key, doc_id, size, e) AS upto FROM c),
k AS (SELECT rank, key, doc_id, size, count(DISTINCT e) AS copies FROM g WHERE upto <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, (q.size * coalesce(k.copies, 0))::BIGINT AS taken, coalesce(k.copies, 0)::INT AS copies
FROM q LEFT JOIN k ON q.rank = k.rank AND q.key = k.key AND q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.size = k.size"""
