"""Line-first quality rules, in DataFrame functions only.

Every line with words is judged on its own: punctuation (symbols, rows of exclamation marks),
shouting, navigation (link marks, labels, lines of capitalised words without a sentence mark),
boilerplate (fixed phrases in English, German, French and Spanish) and one word over and over.
All but the phrases hold in any language. Failing lines go. A document that loses too large a part of its
word characters that way is rejected, as is one that fails the base rules: under ten words,
or over 20 % of its words inside five-word windows that the text repeats.

Null and empty texts have no words, so they fail the base rule. Lines without words are
neither judged nor counted as repeated. Very long texts cost n log n.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy",
    "cookie policy", "use cookies", "copyright (c)", "copyright ©", "enable javascript", "lorem ipsum",
    "click here", "sign up for our newsletter", "subscribe to our", "follow us on", "share this",
    "alle rechte vorbehalten", "datenschutzerklärung", "allgemeine geschäftsbedingungen", "verwendet cookies", "newsletter abonnieren",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "utilise des cookies", "abonnez-vous à",
    "todos los derechos reservados", "política de privacidad", "condiciones de uso", "utiliza cookies", "suscríbete a",
)


#: Lines that are a link's label.
LABELS = ("home", "menu", "next", "previous", "back to top", "startseite", "weiter", "zurück", "nach oben", "accueil", "suivant", "précédent", "inicio", "siguiente", "anterior")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPLIT), "")


def _line_ok(line: Column, words: Column, max_symbols: float, max_shouts: float, min_distinct: float) -> Column:
    """True for a line that stays. Lines without words stay (they are blank lines between paragraphs)."""
    n = F.size(words)
    small = F.lower(line)
    punctuation = (F.regexp_count(line, F.lit(SYMBOLS)) > n * max_symbols) | (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("!"))) > n * max_shouts)
    links = F.regexp_count(line, F.lit("[|\u2022\u00bb]"))
    titles = F.rlike(line, F.lit("^\\s*+(?:[\\p{Lu}\\p{Lt}]\\S*+\\s*+){2,12}$")) & ~F.rlike(line, F.lit("[.!?\u2026:;,\"]"))
    navigation = ((links >= 2) & (links * 4 >= n)) | ((n <= 3) & F.trim(small).isin(*LABELS)) | titles
    boilerplate = reduce(Column.__or__, (F.contains(small, F.lit(p)) for p in BOILERPLATE))
    shouting = (n >= 5) & F.rlike(line, F.lit("^\\P{Ll}*+$")) & F.rlike(line, F.lit("\\p{Lu}"))
    dull = (n >= 10) & (F.size(F.array_distinct(words)) < n * min_distinct)
    return (n == 0) | ~(punctuation | navigation | boilerplate | shouting | dull)


def judge(
    docs: DataFrame,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    max_lost: float = 0.5,
    max_symbols: float = 0.5,
    max_shouts: float = 0.3,
    min_distinct: float = 0.2,
) -> DataFrame:
    """row (struct of the input's columns), cleaned (text of the lines that stay) and the figures of each row.

    Figures: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost (share of the
    word characters in failed lines, 0 for no words), base_failed, kept. One row per input row, also for
    rows that repeat; an empty table gives an empty one; the input's columns may have any names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    at = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"))
    # every line with its words, split once; line breaks separate words, so these are the text's words too
    at = at.withColumn("lines", F.transform(F.split(F.col("text"), "\n", -1), lambda x: F.struct(x.alias("line"), _words(x).alias("words"))))
    at = at.withColumn("words", F.flatten(F.transform("lines", lambda x: x["words"])))
    at = at.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    i = lambda k, d: F.element_at("hashes", k + d)
    windows = F.when(F.size("hashes") >= 5, F.transform(F.sequence(F.lit(1), F.size("hashes") - 4), lambda k: F.xxhash64(i(k, 0), i(k, 1), i(k, 2), i(k, 3), i(k, 4)))).otherwise(F.array().cast("array<bigint>"))
    at = at.withColumn("windows", windows)
    # windows beside their like in sorted order occur twice or more; their places are then walked in order
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    at = at.withColumn("sorted", F.when(some, F.sort_array(F.transform("windows", lambda h, p: F.struct(h.alias("h"), p.alias("p"))))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    twice = F.filter("sorted", lambda s, k: (s.h == F.get("sorted", k + 1).h) | (s.h == F.get("sorted", k - 1).h))
    at = at.withColumn("places", F.sort_array(F.transform(twice, lambda s: s.p)))
    covered = F.aggregate(F.transform("places", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("places", k + 1) - p, F.lit(5))).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    spoken = F.transform(F.filter("lines", lambda x: F.size(x["words"]) > 0), lambda x: x["line"])
    stay = F.filter("lines", lambda x: _line_ok(x["line"], x["words"], max_symbols, max_shouts, min_distinct))
    at = at.withColumn("spoken", spoken).withColumn("stay", stay)
    chars = lambda words: F.length(F.array_join(words, "")).cast("long")
    out = at.select(
        "row",
        F.array_join(F.transform("stay", lambda x: x["line"]), "\n").alias("cleaned"),
        F.size("words").cast("long").alias("n_words"),
        chars("words").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("spoken") - F.size(F.array_distinct("spoken"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        chars(F.flatten(F.transform("stay", lambda x: x["words"]))).alias("clean_chars"),
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    lost = F.coalesce(1 - F.try_divide("clean_chars", "word_chars"), F.lit(0.0))
    return out.withColumns({"base_failed": base, "lost": lost}).withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost)).drop("clean_chars")


def keep_clean(docs: DataFrame, **limits) -> DataFrame:
    """The documents that pass, without their failed lines, in the input's columns; n_chars, if there, follows the text."""
    # the row number keeps Catalyst from pushing the filter, and with it every figure, under the projections
    kept = judge(docs, **limits).withColumn("place", F.monotonically_increasing_id()).filter("kept AND place >= 0")
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return kept.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))
