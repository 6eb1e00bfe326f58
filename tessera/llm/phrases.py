"""Collocations of two and three words by SON partitioning.

The rows are dealt into `shards` by their id. A phrase with `support` occurrences has at least
support / shards of them in one shard, so the union of what the shards find frequent at that
lowered support holds every frequent phrase. A shard is mined completely, by many tasks: each
sends sorted blocks of 62-bit hashes with the shard in the two lowest bits, and a bucket of
hashes sums them by shard. What is frequent in some shard is noted in a filter of a fixed
number of bits, so its broadcast does not grow with the corpus; a chance hit only costs a row.

Words and pairs are mined first; triples are mined where both their pairs passed. Then all phrases
that passed are counted over the whole corpus as text, exactly, and those below `support` go.

Hot words: the parts of a phrase are joined with their counts by blocks.keyed(), which broadcasts the
few parts of a large share of all words and shuffles the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks

SHARDS = 4  # held in two bits of a key
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = np.zeros(256, bool)
_GAP[[9, 32]] = True
_FLUSH = 1_000_000
#: Text to a bucket of hashes.
BUCKET_BYTES = 4 << 20
#: Most bits of the filter that a bucket needs.
_SLICE = 1 << 22


def texts(docs: DataFrame) -> DataFrame:
    """shard, lang (null: und), text (null: empty)."""
    shard = F.pmod(F.hash(F.col("doc_id").cast("long")), F.lit(SHARDS)).cast("int")
    return docs.select(shard.alias("shard"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


class Words:
    """The words of a chunk of texts, lower-cased, each followed by one space: a phrase is a slice of `data`."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data = blocks.lower_ascii(data)
        cut = _ENDS[data] if len(data) else np.zeros(0, bool)
        solid = ~(cut | _GAP[data]) if len(data) else cut
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before = np.concatenate(([False], solid[:-1])) if len(solid) else solid
        first = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.concatenate((solid[1:], [False])) if len(solid) else solid
        last = np.flatnonzero(solid & (~after | edge[1:]))
        size = last - first + 1
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.data = np.full(int(self.end[-1]) + 1 if len(size) else 0, 32, np.uint8)
        taken = np.ones(len(self.data), bool)
        taken[self.end] = False
        self.data[taken] = data[solid]
        self.row = np.searchsorted(at, first, "right") - 1
        # a piece ends at a mark or at the end of its text
        marks = np.cumsum(cut)
        self.piece = (marks[first] if len(first) else np.zeros(0, np.int64)) + self.row

    def runs(self, length: int) -> np.ndarray:
        """First words of all runs of so many words within a piece."""
        n = len(self.piece) - length + 1
        return np.flatnonzero(self.piece[:n] == self.piece[length - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def hashes(self, first: np.ndarray, length: int, langs: np.ndarray) -> np.ndarray:
        """62-bit hashes of phrases, with their language; the two lowest bits are free."""
        found = blocks.span_hashes(self.data, self.start[first], self.end[first + length - 1])
        return blocks.mix(found ^ langs[self.row[first]]) & ~np.uint64(3)


def _lang_keys(column: pa.Array) -> np.ndarray:
    data, at = blocks.utf8(column)
    return blocks.span_hashes(data, at[:-1], at[1:]) if len(column) else np.zeros(0, np.uint64)


def _chunks(batch: pa.RecordBatch):
    """Words, language keys and first row of each chunk."""
    langs = _lang_keys(batch.column("lang"))
    for i, j, data, at in blocks.chunks(batch.column("text")):
        yield i, Words(data, at), langs[i:j]


class Seen:
    """Which hashes are frequent in some shard, by PROBES bits for each. The bucket of a hash owns a slice of `each` bits."""

    PROBES = 2

    def __init__(self, bits: np.ndarray, buckets: int, each: int):
        self.bits, self.buckets, self.each = bits, buckets, each

    @staticmethod
    def places(keys: np.ndarray, each: int):
        for p in range(Seen.PROBES):
            yield (blocks.mix(keys + np.uint64(0xD1B54A32D192ED03 * (p + 1) % 2**64)) >> np.uint64(20)) % np.uint64(each)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        base = blocks.bucket_of(keys, self.buckets).astype(np.uint64) * np.uint64(self.each)
        hit = np.ones(len(keys), bool)
        for at in self.places(keys, self.each):
            at = base + at
            hit &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return hit


def _mined(rows: DataFrame, lengths: tuple[int, ...], support: int, buckets: int, each: int, within=None) -> np.ndarray:
    """The bits of Seen for phrases of these lengths; `within` has the bits that both parts of a longer phrase must be in."""

    def count(batches):
        held, waiting = [], 0

        def packed():
            keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            cut = np.searchsorted(blocks.bucket_of(keys, buckets), np.arange(buckets + 1))
            full = np.flatnonzero(cut[1:] > cut[:-1])
            for k in range(0, len(full), 64):
                some = full[k : k + 64].tolist()
                parts = [(keys[cut[b] : cut[b + 1]], counts[cut[b] : cut[b + 1]]) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([x.tobytes() for x, _ in parts], pa.binary()), pa.array([y.astype(np.uint8 if y.max() < 256 else np.int64).tobytes() for _, y in parts], pa.binary())], names=["bucket", "keys", "counts"])

        seen = within and Seen(np.frombuffer(within.value, np.uint8), buckets, each)
        for batch in batches:
            shards = batch.column("shard").to_numpy().astype(np.uint64)
            for i, words, langs in _chunks(batch):
                for n in lengths:
                    first = words.runs(n)
                    if seen is not None:
                        pairs = np.zeros(len(words.row) + 1, bool)
                        two = words.runs(2)
                        pairs[two] = seen(words.hashes(two, 2, langs))
                        first = first[pairs[first] & pairs[first + 1]]
                    keys = words.hashes(first, n, langs) | shards[i + words.row[first]]
                    held.append(_summed(keys, np.ones(len(keys), np.int64)))
                    waiting += len(held[-1][0])
                if waiting > _FLUSH:
                    yield from packed()
                    waiting = 0
        if held:
            yield from packed()

    def frequent(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in table["keys"]]
        counts = [np.frombuffer(y := x.as_py(), np.uint8 if len(y) == len(k) else np.int64).astype(np.int64) for x, k in zip(table["counts"], keys, strict=True)]
        keys, counts = _summed(np.concatenate(keys), np.concatenate(counts))
        keys = keys[counts * SHARDS >= support] & ~np.uint64(3)
        bits = np.zeros(each, bool)
        for at in Seen.places(keys, each):
            bits[at] = True
        return pa.table({"bucket": table["bucket"].slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    found = rows.mapInArrow(count, "bucket int, keys binary, counts binary").groupBy("bucket").applyInArrow(frequent, "bucket int, bits binary")
    out = np.zeros(buckets * each // 8, np.uint8)  # of a fixed size, whatever the corpus
    for r in found.collect():
        out[r["bucket"] * each // 8 : (r["bucket"] + 1) * each // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The slices of data as an Arrow column."""
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data[place].tobytes()))


def _tallied(rows: DataFrame, buckets: int, each: int, shared) -> DataFrame:
    """lang, words, phrase, f: partial counts of the phrases that passed, and of all words under 0 words."""

    def count(batches):
        short, long = (Seen(np.frombuffer(x.value, np.uint8), buckets, each) for x in shared)
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            code, langs_of = names.indices.to_numpy(), names.dictionary
            for i, words, langs in _chunks(batch):
                row = words.row
                total = np.bincount(code[i + row], minlength=len(langs_of)) if len(row) else np.zeros(len(langs_of), np.int64)
                yield pa.RecordBatch.from_arrays([langs_of, pa.array(np.zeros(len(langs_of), np.int32)), pa.array([""] * len(langs_of)), pa.array(total.astype(np.int64))], names=["lang", "words", "phrase", "f"])
                for n, seen in ((1, short), (2, short), (3, long)):
                    first = words.runs(n)
                    keys = words.hashes(first, n, langs)
                    some = seen(keys)
                    first, keys = first[some], keys[some]
                    if not len(first):
                        continue
                    start, end = words.start[first], words.end[first + n - 1]
                    # a second hash keeps phrases apart that share the first
                    again = blocks.span_hashes(255 - words.data, start, end) ^ langs[row[first]]
                    order = np.argsort(keys)
                    keys, again = keys[order], again[order]
                    new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (again[1:] != again[:-1]))))
                    uses = np.diff(np.append(new, len(keys)))
                    one = order[new]
                    for k in range(0, len(one), 50_000):
                        part = one[k : k + 50_000]
                        yield pa.RecordBatch.from_arrays([langs_of.take(pa.array(code[i + row[first[part]]])), pa.array(np.full(len(part), n, np.int32)), _slices(words.data, start[part], end[part]), pa.array(uses[k : k + 50_000].astype(np.int64))], names=["lang", "words", "phrase", "f"])

    return rows.mapInArrow(count, "lang string, words int, phrase string, f long").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


#: floor(1000000 * a * a / (l * r)) in 38 digits, which a corpus of 10^15 words does not fill.
_SCORE = "(1000000 * CAST(a AS DECIMAL(38, 0)) * CAST(a AS DECIMAL(38, 0))) DIV (CAST(l AS DECIMAL(38, 0)) * CAST(r AS DECIMAL(38, 0)))"


def counted(docs: DataFrame, support: int = 10, filter_bits: int = 1 << 28) -> DataFrame:
    """lang, words, phrase, f of every word, pair and triple with f >= support, and under 0 words each lang's number of words."""
    rows = texts(docs)
    spark = docs.sparkSession
    buckets = min(1 + blocks.text_bytes(rows) // BUCKET_BYTES, filter_bits >> 6)
    each = min(filter_bits // buckets // 8 * 8, _SLICE)
    share = lambda bits: spark.sparkContext.broadcast(bits.tobytes())
    short = share(_mined(rows, (1, 2), support, buckets, each))
    long = share(_mined(rows, (3,), support, buckets, each, short))
    return _tallied(rows, buckets, each, (short, long)).filter((F.col("words") == 0) | (F.col("f") >= support))


def collocations(docs: DataFrame, support: int = 10, absorbed_percent: int = 50, top: int = 2000, filter_bits: int = 1 << 28) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two and three words.

    a, l, r are the occurrences of the phrase and of the two parts of its weakest cut, n the
    language's words; score is floor(1000000 a^2 / (l r)). Phrases that a longer candidate holds in
    `absorbed_percent` of their occurrences are dropped. Ties go by a, then by the phrase's bytes.

    A null language is `und`, a null text is empty; rows that repeat count each, whatever their
    ids. Without phrases of that support, as in an empty table, the result is empty. Texts
    are read whole, a chunk of rows at a time; only doc_id, lang and text are read.
    """
    all_counts = blocks.table(counted(docs, support, filter_bits))
    total = all_counts.filter("words = 0").agg(F.sum("f")).first()[0] or 0
    phrases = all_counts.filter("words >= 2").withColumnRenamed("f", "a")
    parts = all_counts.filter("words BETWEEN 1 AND 2").select(F.struct("lang", "phrase").alias("part"), "f", F.col("f").alias("uses"))

    split = F.split("phrase", " ")
    joined = lambda lo, n: F.array_join(F.slice(split, lo, n), " ")
    cuts = phrases.select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("part", F.struct("lang", joined(F.lit(1), F.col("k")).alias("phrase")))
    # a part begins or ends at most f / support candidates of each length, so its f bounds its uses
    cuts = blocks.keyed(cuts, parts, "part", "uses", total, 2_000).withColumnRenamed("f", "l")
    cuts = cuts.withColumn("part", F.struct("lang", joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("phrase")))
    cuts = blocks.keyed(cuts, parts, "part", "uses", total, 2_000).withColumnRenamed("f", "r").drop("part")
    weakest = F.min(F.struct(F.expr(_SCORE).alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "words", "phrase", "a").agg(weakest)

    inside = phrases.filter("words = 3").select("lang", "a", F.explode(F.array(joined(1, 2), joined(2, 2))).alias("phrase"))
    longest = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longest.hint("merge"), ["lang", "phrase"], "left").filter((F.col("words") == 3) | F.col("longer").isNull() | (100 * F.col("longer") < absorbed_percent * F.col("a")))

    # a language's best: first of each of 16 salts, then of these, at most 16 * top rows
    row = F.struct((-F.col("cut.score")).alias("down"), (-F.col("a")).alias("less"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    salted = kept.select("lang", F.pmod(F.xxhash64("phrase"), F.lit(16)).alias("salt"), row.alias("row"))
    place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy("row"))
    best = salted.withColumn("place", place).filter(F.col("place") <= top).groupBy("lang").agg(F.slice(F.sort_array(F.collect_list("row")), 1, top).alias("rows"))
    words = all_counts.filter("words = 0").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    out = best.join(words.hint("merge"), F.col("lang") == F.col("of")).select("lang", "n", F.posexplode("rows").alias("at", "row"))
    return out.select("lang", (F.col("at") + 1).cast("long").alias("rank"), "row.phrase", "row.a", "row.l", "row.r", "n", "row.score")


ORACLE_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (
    SELECT row, lang, generate_subscripts(p, 1) AS piece, unnest(p) AS words FROM (SELECT row, lang, regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]') AS p FROM rows)
),
split AS (
    SELECT row, lang, piece, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (SELECT * EXCLUDE words, list_filter(regexp_split_to_array(words, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces)
),
runs AS (SELECT lang, w, lead(w) OVER q AS w2, lead(w, 2) OVER q AS w3 FROM split WINDOW q AS (PARTITION BY row, piece ORDER BY i)),
every AS (
    SELECT lang, 1 AS k, w AS phrase FROM runs
    UNION ALL SELECT lang, 2, w || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL
),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM every GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2 AND f >= 10),
halves AS (
    SELECT lang, k, phrase, a, 1 AS pos, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM candidates
    UNION ALL SELECT lang, k, phrase, a, 2, array_to_string(w[:2], ' '), w[3] FROM candidates WHERE k = 3
),
cuts AS (
    SELECT h.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM halves h JOIN counts x ON x.lang = h.lang AND x.phrase = h.head JOIN counts y ON y.lang = h.lang AND y.phrase = h.tail
),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1),
inside AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE k = 3
        UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE k = 3
    ) GROUP BY lang, phrase
),
kept AS (
    SELECT c.* FROM weakest c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE longer IS NULL OR 100 * longer < 50 * c.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
