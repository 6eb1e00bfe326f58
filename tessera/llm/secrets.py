"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in every text by pattern. Their values are hashed and counted over the
whole corpus by distinct documents (repositories) and distinct owners: a value that several
owners hold, or that stands in many documents of one owner, is a copied example; one that a single
owner holds in a few looks live. A document stands for a repository, `source` for its owner. Wider candidates
(long mixed tokens) only become spans if they look live; base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

#: Kind, pattern, group that holds the value, least length of that value.
PATTERNS = (
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),  # the runs that [0-9a-f]+ finds and the length keeps, found at once
    ("other", "(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{20,}", 0, 20),
)
BASE = ("assign", "access", "hex")
#: Parts of values that stand for a secret in examples.
PLACEHOLDER = "(?i)example|changeme|placeholder|your[_-]|xxxx|dummy|redacted"

#: Matches whose positions are summed together.
RUN = 128
_SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"


def _matches(text: Column, rank: int) -> Column:
    """before (text since the match before), match and value of each match of a kind: leftmost, non-overlapping."""
    _, pattern, group, _ = PATTERNS[rank]
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    rows = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("before"), found.alias("match"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    return F.when(F.rlike(text, p), rows).otherwise(F.array().cast("array<struct<before:string,match:string,value:string>>"))


def _spans(matches: str, rank: int) -> Column:
    """The matches of a kind with code point positions, as an array of _SPAN.

    Positions are running sums of lengths. They are built run by run of RUN matches, as an array
    that grows by one value is copied each time: so the cost stays linear in the matches.
    """
    kind, _, _, least = PATTERNS[rank]
    empty = F.array().cast(f"array<{_SPAN}>")
    start = lambda s, x: s["at"] + F.length(x["before"])
    end = lambda s, x: start(s, x) + F.length(x["match"])
    span = lambda s, x: F.struct(start(s, x).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end(s, x).alias("end"), x["value"].alias("value"))
    step = lambda s, x: F.struct(end(s, x).alias("at"), F.when(F.length(x["value"]) >= least, F.array_append(s["out"], span(s, x))).otherwise(s["out"]).alias("out"))
    runs = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / RUN).cast("int"))
    walk = lambda done, k: F.array_append(
        done, F.aggregate(F.slice(matches, k * RUN + 1, F.lit(RUN)), F.struct(F.coalesce(F.get(done, F.size(done) - 1)["at"], F.lit(0)).alias("at"), empty.alias("out")), step)
    )
    walked = F.aggregate(runs, F.array().cast(f"array<struct<at:int,out:array<{_SPAN}>>>"), walk)
    return F.when(F.size(matches) > 0, F.flatten(F.transform(walked, lambda r: r["out"]))).otherwise(empty)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", max_owners: int = 1, max_documents: int = 10) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, live_spans, spread; a row per input row.

    A candidate is live if at most `max_owners` distinct owners hold its value in at most
    `max_documents` distinct documents and it is no placeholder. Rows without an owner count as
    one owner together. Null and empty texts have no spans, an empty table gives an empty one; the cost
    is linear in a text's length. Only doc_id, text and the owner's column are read. The corpus counts take each doc_id once (rows
    without one by their text), so repeated rows do not make a value common. `spread` has
    owners:documents of each of the spans.
    """
    base_ranks = [i for i, p in enumerate(PATTERNS) if p[0] in BASE]
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(blocks.column_or_null(docs, owner, "string"), F.lit("")).alias("owner"))
    found = at.select("doc_id", "owner", blocks.row_key().alias("rk"), *(_matches(F.col("text"), k).alias(f"m_{p[0]}") for k, p in enumerate(PATTERNS)))
    found = found.select("doc_id", "owner", "rk", *(_spans(f"m_{p[0]}", k).alias(p[0]) for k, p in enumerate(PATTERNS)))
    mixed = F.filter("other", lambda o: F.rlike(o["value"], F.lit("[A-Z]")) & F.rlike(o["value"], F.lit("[a-z]")))
    found = blocks.checkpoint(found.select("doc_id", "owner", "rk", *(F.size(PATTERNS[k][0]).cast("long").alias(f"n_{PATTERNS[k][0]}") for k in base_ranks), F.array_sort(F.concat(*BASE)).alias("base"), mixed.alias("wide")))

    # one row per candidate of each document; wide ones that meet a base span of their text go
    each = found.select("doc_id", "owner", "rk", F.explode(F.concat("base", "wide")).alias("span")).distinct()
    text = Window.partitionBy("doc_id", "rk")
    before = F.max(F.when(F.col("span.rank") < 3, F.col("span.end"))).over(text.orderBy("span.start", "span.rank").rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(F.col("span.rank") < 3, F.col("span.start"))).over(text.orderBy(F.desc("span.start"), F.desc("span.rank")).rowsBetween(Window.unboundedPreceding, -1))
    alone = (F.coalesce(F.col("before"), F.lit(0)) <= F.col("span.start")) & (F.coalesce(F.col("behind"), F.col("span.end")) >= F.col("span.end"))
    each = each.withColumn("before", before).withColumn("behind", behind).filter((F.col("span.rank") < 3) | alone)
    each = blocks.checkpoint(each.select("doc_id", "owner", "rk", "span", F.sha2("span.value", 256).alias("hash")))
    # a value's owners and documents are made distinct before they are counted
    without_id = F.when(F.col("doc_id").isNull(), F.col("rk")).alias("no_id")
    by_document = each.select("hash", "doc_id", without_id).distinct().groupBy("hash").agg(F.count("*").alias("documents"))
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("uses"))
    counts = by_owner.join(by_document.hint("merge"), "hash")
    judged = blocks.keyed(each, counts, "hash", "uses", each.count()).withColumn("live", (F.col("owners") <= max_owners) & (F.col("documents") <= max_documents) & ~F.rlike("span.value", F.lit(PLACEHOLDER)))
    told = judged.filter("live OR span.rank < 3").groupBy("doc_id", "rk").agg(F.array_sort(F.collect_set(F.struct("span.start", "span.rank", "span.kind", "span.end", "live", "owners", "documents"))).alias("all"))
    both = found.alias("f").join(told.alias("t"), F.col("f.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("f.rk") == F.col("t.rk")), "left")
    spans = F.coalesce("t.all", F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,live:boolean,owners:bigint,documents:bigint>>"))
    live = F.filter(spans, lambda s: s["live"])
    return both.select(
        "f.doc_id",
        *(f"f.n_{k}" for k in BASE),
        F.sha2(_written(F.col("f.base")), 256).alias("base_sha256"),
        _written(spans).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda s: ~s["live"])).cast("long").alias("n_example"),
        _written(live).alias("live_spans"),
        F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["owners"].cast("string"), s["documents"].cast("string"))), ",").alias("spread"),
    )
