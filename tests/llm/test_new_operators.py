"""Phrase mining, tokenizer alignment and page extraction against SQL, brute force and hand-made pages."""

import collections
import hashlib
import itertools
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import align, html_text, phrases, pii

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spoken(r, n, words="the of a new york city The Über x1 it's"):
    return "".join(r.choice(words.split()) + r.choice((" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " - ", "!?")) for _ in range(n))


@pytest.fixture(scope="module")
def talk():
    r = random.Random(21)
    rows = [(k, spoken(r, r.randint(0, 60)), r.choice(("en", "en", "de", None))) for k in range(120)]
    rows += [(500, None, "en"), (501, "", "de"), (502, " \t\n", None), (None, "no id here, no id here", "xx"), (7, "new york " * 3000, "en"), (7, "new york " * 30, "und"), (503, ", . ;", "fr")]
    return rows


def collocations_by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    found = con.sql(phrases.ORACLE_SQL)
    return found.columns, sorted(found.fetchall())


def test_collocations(spark, talk):
    extra = "doc_id long, text string, lang string, part string, words string, row string, n string"
    docs = spark.createDataFrame([(*x, "p", "w", "r", "n") for x in talk], extra)
    columns, expected = collocations_by_sql(talk)
    assert len(expected) > 80 and {x[0] for x in expected} >= {"en", "de", "und"}
    for bits in (1 << 28, 1 << 12):  # a filter that lets most phrases pass changes nothing
        assert sorted(tuple(x[c] for c in columns) for x in phrases.collocations(docs, filter_bits=bits).collect()) == expected


def test_collocations_of_few_rows(spark):
    schema = "doc_id long, text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], schema)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, "one two three", "en"), (2, None, None)], schema)).collect() == []
    # nine are too few, ten are enough, and a tie goes to the first cut
    ten = spark.createDataFrame([(1, "a b c, " * 10 + "d e, " * 9, "en")], schema)
    assert [tuple(x) for x in phrases.collocations(ten).collect()] == [("en", 1, "a b c", 10, 10, 10, 48, 1_000_000)]


def test_scores_of_counts_beyond_64_bits(spark):
    at = spark.createDataFrame([(3 * 10**12, 4 * 10**12 + 1, 5 * 10**12 + 7)], "a long, l long, r long")
    a, left, right = 3 * 10**12, 4 * 10**12 + 1, 5 * 10**12 + 7
    assert at.selectExpr(f"{phrases._SCORE} AS s").first().s == 1_000_000 * a * a // (left * right)


def token_bytes():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    first = lambda i: bytes(of[c] for c in one.id_to_token(i))
    second = lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: (one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)), (first, second)


def aligned(rows):
    encode, raw = token_bytes()
    found, count = [], collections.Counter()
    for i, t in rows:
        t = t or ""
        ids = encode(t)
        spelt = [[r(k) for k in x] for r, x in zip(raw, ids, strict=True)]
        if not t or any(b"".join(x) != (" " + t).encode() for x in spelt):
            found.append((i, None))
            continue
        ends = [list(itertools.accumulate(map(len, x))) for x in spelt]
        links = [(a, b) for a, e, s in zip(ids[0], ends[0], spelt[0], strict=True) for b, f, u in zip(ids[1], ends[1], spelt[1], strict=True) if max(e - len(s), f - len(u)) < min(e, f)]
        count.update(links)
        groups, before = [], 0
        for c in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(k) for k, e in zip(x, y, strict=True) if before < e <= c) for x, y in zip(ids, ends, strict=True)))
            before = c
        found.append((i, (len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return sorted(((i, *(none if x is None else (*x[:3], len(x[3]), sum(count[k] == best[k[1]] for k in x[3]), sum(count[k] for k in x[3]), x[4]))) for i, x in found), key=str)


@pytest.fixture(scope="module")
def letters():
    r = random.Random(3)
    pieces = ["the", " and", "de", "f\n", "\t", "’s", "é", " ü", "ño", "中文", " \U0001f600", "  ", ", ", "don't", " 12", " ", " ", "xyz ", " a"]
    rows = [(k, "".join(r.choice(pieces) for _ in range(r.randint(0, 40)))) for k in range(120)]
    return rows + [(900, None), (901, ""), (902, " "), (903, "  a"), (904, "a "), (905, "a▁b"), (906, "<|endoftext|> <s> <unk>"), (907, "\x00"), (None, "twice the same"), (None, "twice the same"), (1, "an id that repeats"), (908, "中" * 400), (909, "word and " * 400)]


@pytest.mark.parametrize(("chunk", "head"), [(1 << 18, 500_000), (90, 40)])
def test_alignment(make, letters, chunk, head):
    """Short documents at once, long ones by fragments of 90 bytes over tasks; all pairs in the head, or nearly none."""
    found = align.align(make(letters), A, B, chunk_bytes=chunk, head_pairs=head).collect()
    assert sorted((tuple(x) for x in found), key=str) == aligned(letters)


def test_alignment_of_an_empty_table(make):
    assert align.align(make([]), A, B).collect() == []


def test_fragments_compose_in_any_order():
    """Any cut of a text's tokens into byte ranges, composed in any order, gives the same fragment; the empty one changes nothing."""
    sides = align.Sides((A, B))
    data = np.frombuffer("It's the Straße of 中文 and unbelievable’s 12,345 things \U0001f600 all over again".encode(), np.uint8)
    ((a, a_end), (b, b_end)), ok = sides.tokens(data, np.array([0, len(data)]))
    assert ok.all()
    whole = align._packed(sides, align.Fragment.of(sides, a, a_end, b, b_end))
    r = random.Random(4)
    for _ in range(60):
        edges = [-1, *sorted(r.sample(range(len(data)), r.randint(0, 12))), 1 << 40]
        parts = [align.Fragment.of(sides, a[p], a_end[p], b[q], b_end[q]) for lo, hi in itertools.pairwise(edges) for p, q in [((a_end > lo) & (a_end <= hi), (b_end > lo) & (b_end <= hi))]]
        parts.insert(r.randint(0, len(parts)), align.Fragment())
        while len(parts) > 1:
            k = r.randrange(len(parts) - 1)
            parts[k : k + 2] = [align.compose(sides, *parts[k : k + 2])]
        assert align._packed(sides, parts[0]) == whole


def test_long_texts_align_in_linear_time():
    sides = align.Sides((A, B))
    for text in ("word and more " * 70_000, "a" * 300_000, " " * 300_000, "中" * 100_000):
        data = np.frombuffer(text.encode(), np.uint8)
        (one, two), ok = sides.tokens(data, np.array([0, len(data)]))
        assert ok.all() and one[1][-1] == two[1][-1] == len(data) + 1


STORY = ["A headline of a story", *(f"Paragraph number {k} tells the story, with commas, names and a few more words than a menu has." for k in range(4)), "Short end."]
HTML = "<h1>{}</h1>".format(STORY[0]) + "".join(f"<p>{x}</p>\n" for x in STORY[1:])
LONG = "Readers say a lot about this. " * 60


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><article>{HTML}</article><footer>&copy; us</footer>",
        f"<body><div class='header'><a>Home</a> <a>News</a></div><div><ul><li><a>one</a><li><a>two</a></ul></div><div class=post>{HTML}</div><div class=sideBar><p>{LONG}</p></div>",
        f"<body><header><h1>Site</h1><nav>menu</nav></header><main>{HTML}<aside>{LONG}</aside></main><section id=comments><article class=comment><p>{LONG}</p></article></section>",
        f"<body class='has-sidebar'><div class='page with-sidebar'><div id='cookie-notice'>We use cookies.</div>{HTML}<div class=comments><p>{LONG}</p></div></div><form><label>Mail</label><input></form>",
        f"<article><script>var x = '<p>no</p>';</script>{HTML}<div class='ad'>{LONG}</div><noscript>no</noscript></article>",
        f"<title>T</title><p><a>x</a> | <a>y</a></p><div hidden>{LONG}</div>{HTML}<div style='display: none'>x</div>",
    ],
)
def test_main_text(page):
    assert html_text.main_text(page).split("\n") == STORY


def test_main_text_of_odd_pages():
    assert [html_text.main_text(x) for x in (None, "", " \n ", "<p></p>", "<nav>menu</nav>", "plain words")] == ["", "", "", "", "", "plain words"]
    assert html_text.main_text("<article><p>a &amp; b&nbsp;c\n\t d &#8364;<br>e<wbr>f <b>g</b>h<p>open <i>tags") == "a & b c d € ef gh\nopen tags"
    for broken in ("<" * 50_000, "<div>" * 20_000 + "x", "<!--" * 20_000, "</p>" * 20_000, "<p>x" * 20_000, "<a b='" * 20_000):
        html_text.main_text(broken)


def test_extract(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", f"<article>{HTML}</article>", "x", "y"), (1, "u", None, "x", "y"), (None, None, "", "x", "y"), (2, "v", f"<article>{HTML}</article>" + "<p>tail</p>" * 50_000, "x", "y")]
    found = [tuple(x) for x in html_text.extract(spark.createDataFrame(rows, schema)).collect()]
    whole = "\n".join(STORY)
    assert found[:3] == [(1, "u", whole, len(whole)), (1, "u", "", 0), (None, None, "", 0)] and len(found) == 4
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []


def test_names_are_sought_in_linear_time():
    """Reformatted names in texts of growing size; a text with one long name costs no more than its length."""
    text = ".".join(f"a{k}" for k in range(40_000)) + "@x.com " + "word and more " * 20_000
    assert [x[:2] for x in pii.Nodes(text, pii.base_spans(text)).spans] == [(0, text.index(" "))]
    many = " ".join(f"p{k}.q{k}@x.com then P{k} Q{k} wrote" for k in range(3_000))
    assert len(pii.Nodes(many, pii.base_spans(many)).spans) == 6_000 - 10  # P0 Q0 to P9 Q9 are too short


def test_field_finds_reformatted_repeats(spark):
    """On texts that were not in the fit: repeats of found entities in another form, beside numbers and names that are none."""
    r = random.Random(31)
    number = lambda: f"+{r.randint(1, 9)}{r.randint(10, 99)} {r.randint(100, 999)} {r.randint(1000, 9999)}"
    name = lambda: "".join(r.choice("abcdefghiklmnoprst") for _ in range(6))

    def text(k):
        tel, first, last = number(), name(), name()
        digits = tel.replace("+", "").replace(" ", "")
        again = f"{digits[:3]}-{digits[3:6]}-{digits[6:]}"
        other = "".join(r.choice("123456789") for _ in range(10))
        return f"Call {tel} or write {first}.{last}@mail.org today. Later {again} was busy and {first} {last} asked about order {other} again.", (again, f"{first} {last}"), other

    fit = [text(k) for k in range(300)]
    weights = pii.fit(spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(fit)], "doc_id long, text string"))
    hit = wrong = 0
    for k in range(200):
        t, wanted, other = text(k)
        nodes = pii.Nodes(t, pii.base_spans(t))
        label = weights.infer(nodes).argmax(axis=1)
        found = {t[a:b] for (a, b, base), x in zip(nodes.spans, label, strict=True) if base < 0 and x > 0}
        hit += sum(w in found for w in wanted)
        wrong += other in found
    assert hit >= 0.9 * 400 and wrong <= 0.1 * hit
