"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

The benchmark's items are the small sets, the documents the long ones. An item's sketch holds
the least hash values of its five-word shingles. Items are partitioned by size, and a
partition's sketch size follows from its largest item: with at most a share of 1 - t of the
shingles missing, one value more than that number is always present, so the sketch finds
every document that contains t of an item. Candidates are then verified on all shingles.
Items of fewer than five words are one shingle, their whole word sequence, for which the
documents' sequences of as many words are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Sketch rows that may be broadcast (about 24 bytes each); a larger benchmark is joined by shuffle.
BROADCAST_ROWS = 500_000
#: A shingle of more items than this is taken into a sketch only where the item has too few others.
COMMON = 100


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def _runs(width: int) -> Column:
    """Hashes of all runs of `width` words of the column hashes."""
    at = F.transform(F.sequence(F.lit(1), F.size("hashes") - (width - 1)), lambda k: F.xxhash64(*(F.element_at("hashes", k + d) for d in range(width))))
    return F.when(F.size("hashes") >= width, at).otherwise(F.array().cast("array<bigint>"))


def with_shingles(df: DataFrame, width: int, short: tuple[int, ...] = ()) -> DataFrame:
    """Replaces column `text` by `shingles`, the hashes of every run of `width` words, and of every run of each of the `short` widths."""
    df = df.withColumn("hashes", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    return df.withColumn("shingles", F.concat(*(_runs(k) for k in (width, *short)))).drop("hashes", "text")


def item_shingles(df: DataFrame, width: int) -> DataFrame:
    """As with_shingles(), but a text of fewer words is one shingle; beside it n_words."""
    df = df.withColumn("hashes", F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).withColumn("n_words", F.size("hashes"))
    at = _runs(width)
    for k in range(1, width):
        at = F.when(F.col("n_words") == k, _runs(k)).otherwise(at)
    return df.withColumn("shingles", at).drop("hashes", "text")


def sketches(items: DataFrame, width: int, threshold: float) -> DataFrame:
    """item, item_id, n_words, shingles (distinct), n_shingles, size_class, sketch (empty without shingles) of each row, item its number.

    The sketch holds the least hashes; shingles of more than COMMON items come last, so that a
    phrase that opens many items does not pair each of them with every document that has it.
    """
    sized = item_shingles(items.withColumn("item", F.monotonically_increasing_id()), width).withColumn("shingles", F.array_sort(F.array_distinct("shingles")))
    sized = sized.withColumn("n_shingles", F.size("shingles").cast("long")).withColumn("size_class", F.floor(F.log2(F.greatest("n_shingles", F.lit(1)))).cast("int"))
    sized = blocks.checkpoint(sized)
    each = sized.select("item", F.explode("shingles").alias("hash"))
    counts = each.groupBy("hash").agg(F.count("*").alias("uses"))
    order = blocks.keyed(each, counts.withColumn("common", F.col("uses") > COMMON), "hash", "uses", COMMON << 16, COMMON + 1).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("common", "hash"))).alias("order"))
    # the largest size of class c is 2^(c+1) - 1; the classes keep the sketches of short items short
    most = F.floor((F.pow(F.lit(2.0), F.col("size_class") + 1) - 1) * F.lit(1 - threshold) + F.lit(1e-9)).cast("int") + 1
    sketch = F.transform(F.slice("order", F.lit(1), most), lambda x: x["hash"])
    return sized.join(order, "item", "left").withColumn("sketch", F.coalesce(sketch, F.array().cast("array<bigint>"))).drop("order")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """With a broadcast hint if the table was counted to be small, else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _found(docs: DataFrame, benchmark: DataFrame, width: int, threshold: float) -> DataFrame:
    """doc_id, rk (row key), item_id, n_shingles, n_shared of every pair of rows with containment >= threshold."""
    at = blocks.corpus(docs).select("doc_id", blocks.row_key().alias("rk"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    sketch = blocks.checkpoint(sketches(items, width, threshold))
    short = tuple(sorted(r["n_words"] for r in sketch.filter(F.col("n_words").between(1, width - 1)).select("n_words").distinct().collect()))
    by_value = sketch.select("item", F.explode("sketch").alias("hash"))
    values = by_value.select("hash").distinct()

    # search: the documents' shingles against the sketches
    # (explode_outer: for explode, Catalyst would compute the shingles a second time in a filter)
    hits = with_shingles(at, width, short).select("doc_id", "rk", F.explode_outer("shingles").alias("hash")).join(_bounded(values, values.count()), "hash").distinct()
    pairs = blocks.checkpoint(hits.join(_bounded(by_value, sketch.select(F.sum(F.size("sketch"))).first()[0] or 0), "hash").select("doc_id", "rk", "item").distinct())

    # verification: of the documents found, all shingles
    found = pairs.select("rk").distinct()
    again = with_shingles(at.join(_bounded(found, found.count()), "rk", "left_semi").dropDuplicates(["doc_id", "rk"]), width, short).withColumnRenamed("doc_id", "id")
    whole = sketch.select("item", "item_id", "n_shingles", F.col("shingles").alias("wanted"))
    wanted = pairs.join(_bounded(whole, sketch.select(F.sum("n_shingles")).first()[0] or 0), "item")
    shared = wanted.join(again.withColumnRenamed("rk", "again"), (F.col("rk") == F.col("again")) & F.col("doc_id").eqNullSafe(F.col("id")))
    shared = shared.withColumn("n_shared", F.size(F.array_intersect("wanted", "shingles")).cast("long")).filter(F.col("n_shared") >= threshold * F.col("n_shingles") - 1e-9)
    return shared.select("doc_id", "rk", "item_id", "n_shingles", "n_shared")


def contained(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment of every pair with containment >= threshold.

    n_shingles counts an item's distinct shingles, n_shared those that the document has. Items of
    fewer than `width` words have one, their whole sequence. Items without words (empty, null) have
    none and are in no document. Rows that repeat a doc_id or an item_id are compared each, and
    the pair is reported once, with the most that any of them share; so are rows without an id,
    under a null. Empty tables give an empty one. Long texts cost as their words; only doc_id,
    item_id and text are read.
    """
    best = F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_shared")).alias("best")
    return _found(docs, benchmark, width, threshold).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_shingles", "best.n_shared", "best.containment")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs whose own text contains no item, also among rows that repeat an id or have none; all columns are kept."""
    found = _found(docs, benchmark, width, threshold).select(F.col("doc_id").alias("f_id"), F.col("rk").alias("f_rk")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("t")).select("row", "id", F.xxhash64("id", "t").alias("rk"))
    left = rows.join(_bounded(found, found.count()), (F.col("rk") == F.col("f_rk")) & F.col("id").eqNullSafe(F.col("f_id")), "left_anti")
    return left.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), v AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), d AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5
  UNION ALL SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) FROM w, (SELECT DISTINCT len(w) AS k FROM v WHERE len(w) BETWEEN 1 AND 4) WHERE len(w) >= k
), b AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM v WHERE len(w) >= 5
  UNION ALL SELECT DISTINCT item_id, array_to_string(w, ' ') FROM v WHERE len(w) BETWEEN 1 AND 4
), n AS (
  SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id
)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles::DOUBLE AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING count(*) >= 0.8 * n_shingles - 1e-9
"""
