"""The SQL of op6 and op8 gives the operators' rows on texts put together from awkward pieces."""

import random

import duckdb

from tessera.llm import oracles, quality_rules, secrets

LINES = (
    "", "   ", "\t", "Home", " menu ", "Next page", "Über Uns Ihre Themen", "Über Uns, Ihre Themen", "one | two | three", "a•b » c", "ALL OF THIS IS LOUD", "ÄRGER ÜBER ALLES UND MEHR",
    "so good !!!!!! yes", "# # # x", "All Rights Reserved by us", "Datenschutzerklärung hier", "ab " * 12, "ab " * 12 + "cd ef", "a plain line with words enough to count.", "a plain line with words enough to count.",
    "wide space and \x0b a vertical tab", "carriage return\r", "1 2 3 4 5 6", "\U0001f600 smile over two halves of a pair", "Ǆ Ǆ", "x", "ein ganz normaler Satz, der bleibt.", "one two three four five six seven",
)
PIECES = (
    "password = hunter2x", "Token:\"abc123\"", "API_KEY='q9", "passwd=ab", "ſecret=longvalue1", "AKIA" + "Z" * 15, "AKIA" + "Q7" * 9, "f" * 23, "0a" * 14, "deadbeef" * 5, "secret=" + "0a" * 14, "aB3" * 8, "aB_" * 8 + "4",
    "aB3" * 6, "key " + "aB3" * 8, "xToken=AKIA" + "Q7" * 9, "your_" + "aB3" * 8, "é\U0001f600ü", "\n", " ", " - ", "plain words", "\\x", "AKIA", "[\"token\": \"aB3/+=.-_\"]",
)


def by_sql(frame, sql):
    con = duckdb.connect()
    con.register("documents", frame.select("doc_id", "text", "source").toArrow())
    table = con.sql(sql)
    return sorted(tuple(dict(zip(table.columns, row, strict=True)).items()) for row in table.fetchall())


def by_spark(frame, columns):
    return sorted(tuple((c, r[c]) for c in columns) for r in frame.collect())


def test_quality_rules(make):
    r = random.Random(11)
    texts = [None, "", "\n\n", *LINES, *("\n".join(r.choices(LINES, k=r.randint(1, 14))) for _ in range(400)), "one two three four five six\n" * 3_000]
    docs = make(list(enumerate(texts)))
    found = by_sql(docs, oracles.QUALITY_RULES)
    kept = [dict(x)["kept"] for x in found]
    assert 20 < sum(kept) < len(kept) - 20
    assert by_spark(quality_rules.judge(docs).select("row.doc_id", "*"), [c for c, _ in found[0]]) == found


def test_secret_scan(spark):
    r = random.Random(12)
    texts = [None, "", *PIECES, *(r.choice(("", " ", ";")).join(r.choices(PIECES, k=r.randint(1, 9))) for _ in range(400)), "token=a1b2c3 " * 3_000]
    docs = spark.createDataFrame([(i, t, r.choice(("s", "s", "t", None))) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = by_sql(docs, oracles.SECRET_SCAN)
    assert any(dict(x)["n_live"] for x in found) and any("other" in dict(x)["spans"] for x in found)
    assert by_spark(secrets.scan(docs), [c for c, _ in found[0]]) == found
