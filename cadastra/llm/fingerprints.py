"""Document fingerprints: canonical exact digests, in DataFrame functions only.

The canonical form of a text is Unicode-normalised (NFKC), case-folded, with each
run of white space folded to one space and trimmed. Its wide (2 x 64 bit) xxhash
groups texts; inside each group of equal hashes the canonical bytes are compared,
and a text that merely collides gets the hash with an ordinal behind it. Two texts
so have equal fingerprints exactly if their canonical forms are equal.

Edge cases: a null text counts as empty; a null doc_id orders first; rows with
equal doc_id order by text; in a table of one row the next document is the row
itself; an empty table gives an empty result; columns besides doc_id and text are
not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.llm.tables import parallelism, small, written

#: Rows of a bucket of neighbouring documents, the unit in which successors are found.
BUCKET_ROWS = 1000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, white space folded. Pure ASCII needs no Unicode tables."""
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)), F.lit(True))
    unicode_form = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    form = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(unicode_form)
    return F.trim(F.regexp_replace(form, r"(?U)\s+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits of xxhash as 32 hex digits."""
    one = lambda *x: F.lpad(F.lower(F.hex(F.xxhash64(*x))), 16, "0")
    return F.concat(one(canon), one(F.lit("second half"), canon))


def bucketed(docs: DataFrame, spark_splits: int = 256) -> tuple[DataFrame, int]:
    """docs (doc_id, text) with `bucket`, a number that grows with doc_id; about BUCKET_ROWS rows each.

    256 quantiles of doc_id, and equal steps between two of them.
    """
    at = [i / spark_splits for i in range(spark_splits + 1)]
    total, splits = docs.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", at, 10_000)).first()
    if not total or not splits:
        return docs.withColumn("bucket", F.lit(-1).cast("long")), total
    splits = sorted(set(splits))
    steps = max(1, round(total / BUCKET_ROWS / max(1, len(splits))))
    edges = F.array(*[F.lit(int(x)).cast("long") for x in splits])
    i = F.greatest(F.lit(0), F.size(F.filter(edges, lambda x: x <= F.col("doc_id"))) - 1)
    lo, hi = F.get(edges, i), F.coalesce(F.get(edges, i + 1), F.get(edges, i) + 1)
    share = (F.col("doc_id").cast("double") - lo.cast("double")) / (hi.cast("double") - lo.cast("double"))
    step = F.least(F.lit(steps - 1), F.greatest(F.lit(0), F.floor(share * steps)))
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(i * steps + step).cast("long")), total


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with next_id and next_text of the document that follows by doc_id (after the last: the first).

    The first documents of a bucket also visit the bucket before, so one shuffle of the texts finds all successors.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs, total = bucketed(docs)
    firsts = docs.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))
    order = Window.orderBy("bucket")
    firsts = firsts.select("bucket", "first_id", F.lag("bucket").over(order).alias("before"), F.max("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    firsts = written(firsts.select(F.col("bucket").alias("own_bucket"), "first_id", F.coalesce("before", "last").alias("bucket")))
    visits = docs.withColumnRenamed("bucket", "own_bucket").join(small(firsts, 32), ["own_bucket"])
    visits = visits.filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "text", "bucket", F.lit(True).alias("visit"))
    rows = docs.select("doc_id", "text", "bucket", F.lit(False).alias("visit")).unionByName(visits)
    rows = rows.repartition(max(parallelism(docs.sparkSession), 1), "bucket")
    w = Window.partitionBy("bucket").orderBy("visit", "doc_id", "text")
    out = rows.select("doc_id", "text", "visit", F.lead("doc_id").over(w).alias("next_id"), F.lead("text").over(w).alias("next_text"))
    return out.filter(~F.col("visit")).drop("visit")


def edited(text: Column, next_text: Column) -> Column:
    """The last floor(n / 2) characters replaced by the first as many (or all) of the next text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def _collisions(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (doc_id, hash, is_edit, ordinal) whose canonical bytes differ from the first text under their hash. Normally none."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = found.select("doc_id", "next_id", F.inline(F.array(F.struct(F.lit(False).alias("is_edit"), F.col("h").alias("hash")), F.struct(F.lit(True).alias("is_edit"), F.col("e").alias("hash")))))
    shared = both.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    held = written(both.join(shared, "hash"))
    n = held.count()
    ids = written(held.select(F.col("doc_id").alias("id")).union(held.filter("is_edit").select("next_id")).distinct())
    some = texts.join(small(ids, 16), texts.doc_id.eqNullSafe(F.col("id"))).select("doc_id", "text")
    own = some.join(small(held.filter(~F.col("is_edit")), 80, n), "doc_id").select("doc_id", "hash", "is_edit", canonical(F.col("text")).alias("canon"))
    after = some.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    edits = some.join(small(held.filter("is_edit"), 80, n), "doc_id").join(after, "next_id")
    edits = edits.select("doc_id", "hash", "is_edit", canonical(edited(F.col("text"), F.col("next_text"))).alias("canon"))
    every = own.unionByName(edits)
    # equal texts fold into one row before the shuffle, so a hot group is small when its bytes meet
    kinds = every.select("hash", "canon").distinct()
    kinds = kinds.withColumn("fits", wide_hash(F.col("canon")) == F.col("hash")).filter("fits").drop("fits")
    several = kinds.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
    ranked = written(several.join(kinds, "hash").withColumn("ordinal", F.row_number().over(Window.partitionBy("hash").orderBy("canon"))).filter("ordinal > 1"))
    if ranked.isEmpty():
        return None
    return written(every.join(ranked, ["hash", "canon"]).select("doc_id", "hash", "is_edit", "ordinal").distinct())


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each document.

    Fingerprints are exact digests, so the likeness of two of them is 1.0 if they are equal and 0.0 if not.
    """
    pairs = with_next(docs)
    pairs = pairs.withColumn("edit", edited(F.col("text"), F.col("next_text")))
    found = written(
        pairs.select(
            "doc_id",
            "next_id",
            F.char_length("text").cast("long").alias("n_chars"),
            F.sha2("edit", 256).alias("edited_sha256"),
            wide_hash(canonical(F.col("text"))).alias("h"),
            wide_hash(canonical(F.col("edit"))).alias("e"),
            wide_hash(canonical(F.col("next_text"))).alias("x"),
        )
    )
    odd = _collisions(docs, found)
    if odd is not None:
        mark = lambda c, o: F.when(F.col(o).isNull(), F.col(c)).otherwise(F.concat_ws("-", c, o))
        for c, o, key, is_edit in (("h", "ho", "doc_id", False), ("e", "eo", "doc_id", True), ("x", "xo", "next_id", False)):
            part = odd.filter(F.col("is_edit") == is_edit).select(F.col("doc_id").alias(key), F.col("hash").alias(c), F.col("ordinal").cast("string").alias(o))
            found = found.join(part, [key, c], "left").withColumn(c, mark(c, o)).drop(o)
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("h").alias("fingerprint"),
        F.col("e").alias("edited_fingerprint"),
        (F.col("h") == F.col("e")).cast("double").alias("near_edited"),
        (F.col("h") == F.col("x")).cast("double").alias("near_next"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each document's text."""
    return fingerprint_pairs(docs).select("doc_id", "fingerprint")
