"""The other text operators against brute force, the tokenizers library, or held-out accuracy."""

import collections
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, components, decontaminate, lm, pii, quality_model, quality_rules, secrets, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(r, n):
    return " ".join("".join(r.choice("aeiourstnlüé") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    base = [prose(r, r.randint(5, 90)) for _ in range(30)]
    out = [(k, t) for k, t in enumerate(base)]
    out += [(40 + k, base[k]) for k in range(6)]  # copies
    out += [(50 + k, base[k].replace(" ", " x ", 1)) for k in range(6, 12)]  # near copies
    out += [(60, None), (61, ""), (62, " \n\t "), (63, "One"), (64, "Two words"), (3, base[3]), (4, base[5]), (None, base[7]), (65, "be " * 400), (66, "a b c d e f " * 3 + "\nA\nA\n\nA")]
    return out


def classes(rows):
    """Fingerprint of each row, and the name of its class."""
    fp = []
    for _, t in rows:
        words = WORD.findall((t or "").translate(LOWER))
        grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        bits = [sum(xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1 for g in grams) for b in range(64)]
        fp.append(sum(1 << b for b in range(64) if 2 * bits[b] > len(grams)))
    parent = {x: x for x in fp}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(list(parent), 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    return fp, [root(x) for x in fp]


def test_simhash_components(make, rows):
    fp, roots = classes(rows)
    least = {}
    for (i, _), root in zip(rows, roots, strict=True):
        if i is not None:
            least[root] = min(least.get(root, 10**9), i)
    expected = collections.Counter((i, f"{x:016x}", least.get(root)) for (i, _), x, root in zip(rows, fp, roots, strict=True))
    assert collections.Counter(tuple(x) for x in simhash.near_duplicates(make(rows)).collect()) == expected


def test_crowded_fingerprints_are_linked(spark):
    r = random.Random(2)
    center = r.getrandbits(63)
    near = {center ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)} | {center, center ^ 0b111 << 40, r.getrandbits(62)}
    edges = simhash.links(spark.createDataFrame([(x,) for x in near], "fp long"))
    found = {x.node: x.component for x in components.components(edges).collect()}
    expected, todo = {}, set(near)
    while todo:
        group, front = set(), {todo.pop()}
        while front:
            group |= front
            front = {x for x in todo if any((x ^ g).bit_count() <= 2 for g in front)}
            todo -= front
        if len(group) > 1:
            expected |= dict.fromkeys(group, min(group))
    assert found == expected


def test_keep_one(make, rows):
    """One row of each class, with its smallest id; rows that repeat an id are judged by their own text."""
    more = [*rows, (3, "an unique text under an id that repeats " * 3), (3, base_text := rows[8][1]), (None, "no id at all, but a text of its own"), (None, "no id at all, but a text of its own"), (70, base_text)]
    _, roots = classes(more)
    named = dict(zip(more, roots, strict=True))
    kept = [named[x.doc_id, x.text] for x in simhash.keep_one(make(more)).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == set(roots)
    order = lambda i: 10**9 if i is None else i
    least = {}
    for (i, _), root in zip(more, roots, strict=True):
        least[root] = min(least.get(root, 10**9), order(i))
    assert all(order(x.doc_id) == least[named[x.doc_id, x.text]] for x in simhash.keep_one(make(more)).collect())


def figures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count, covered = collections.Counter(windows), set()
    for k, x in enumerate(windows):
        if count[x] > 1:
            covered |= set(range(k, k + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_figures(make, rows):
    more = [*rows, (70, "x## y** | a <b>\n" * 3), (71, "aaa bbb ccc ddd eee. " * 30)]
    found = {(x.row.doc_id, x.row.text): x for x in quality_rules.judge(make(more)).collect()}
    for i, t in more:
        x, expected = found[i, t], figures(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == expected
        assert x.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0]) and not (x.base_failed and x.kept)


def line_ok(line):
    words = WORD.findall(line)
    n, small = len(words), line.lower()
    links = sum(c in "|\u2022\u00bb" for c in line)
    bad = len(re.findall(r"[#*$%&|<>]", line)) > 0.5 * n or len(line) - len(line.replace("!!", "!")) > 0.3 * n
    bad |= links >= 2 and links * 4 >= n or n <= 3 and small.strip(" ") in quality_rules.LABELS
    bad |= 2 <= n <= 12 and all(w[0].isupper() for w in words) and not re.search('[.!?\u2026:;,"]', line)
    bad |= any(p in small for p in quality_rules.BOILERPLATE)
    bad |= n >= 5 and any(c.isupper() for c in line) and not any(c.islower() for c in line)
    bad |= n >= 10 and len(set(words)) < 0.2 * n
    return not n or not bad


def test_quality_verdicts_against_brute_force(make, rows):
    r = random.Random(14)
    junk = ["BUY!! NOW!! HERE!!", "Home | About | News", "Privacy Policy applies to all.", "Alle Rechte vorbehalten.", "ALL CAPS LINE OF SIX WORDS", "## ** $$ %% a", "Startseite", "About Us Contact News", "la " * 12, "", "  ", "a b c", "É Ü ß É Ü"]
    texts = ["\n".join(r.choice(junk) if r.random() < 0.5 else prose(r, r.randint(3, 14)) + "." for _ in range(r.randint(1, 8))) for _ in range(150)]
    docs = [*rows, *enumerate(texts, 1000)]
    found = {(x.row.doc_id, x.row.text): x for x in quality_rules.judge(make(docs)).collect()}
    for i, t in docs:
        stay = [x for x in (t or "").split("\n") if line_ok(x)]
        chars = lambda s: sum(map(len, WORD.findall(s)))
        lost = 1 - chars("\n".join(stay)) / chars(t) if chars(t or "") else 0.0
        x = found[i, t]
        assert x.cleaned == "\n".join(stay) and x.lost == pytest.approx(lost, abs=1e-12), (i, t)
        assert x.kept == (not x.base_failed and lost <= 0.5 + 1e-12)
    assert {x.kept for x in found.values()} == {True, False}


def test_quality_lines(make):
    good = "The quick brown fox jumps over the lazy dog and then it sleeps well."
    junk = "BUY!! NOW!! BEST!! PRICE!! EVER!! HERE!!"
    kept = quality_rules.keep_clean(make([(1, good), (2, f"{good}\n{junk}"), (3, f"{good[:30]}\n{junk}\nHome | About | News | Contact"), (4, None), (5, "w " * 50)])).collect()
    assert {x.doc_id: x.text for x in kept} == {1: good, 2: good} and all(x.n_chars == len(x.text) for x in kept)


def test_secrets(spark):
    schema = "doc_id long, text string, source string, owner string"
    shared, own = "token = 'abcdef123456'", "api_key: Zk93kfQ0aa81Lm77x, AKIA" + "B" * 17
    data = [(1, f"é {shared}", "a", "q"), (2, shared, "b", "q"), (3, own, "a", "q"), (4, None, None, None), (5, "password=ab token=token:abcdefgh " + "0f" * 13, "c", "q"), (3, own, "a", "q")]
    found = {}
    for x in secrets.scan(spark.createDataFrame(data, schema)).collect():
        found.setdefault(x.doc_id, []).append(x)
    assert [len(v) for v in found.values()].count(2) == 1 and len(found[3]) == 2
    for i, t, *_ in data:
        spans = []
        for rank, (kind, p, group, least) in enumerate(secrets.PATTERNS[:3]):
            p = r"[0-9a-f]+" if kind == "hex" else p
            spans += [(m.start(), rank, kind, m.end()) for m in re.finditer(p, t or "") if len(m[group]) >= least]
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert found[i][0].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(found[i][0].spans.split(","))
    assert found[1][0].n_live == 0 and found[1][0].n_example == 1 and found[3][0].n_live >= 2


def test_secret_in_many_documents_of_one_owner(spark):
    example, own = "token = 'Qz81abcdef123456'", "token = 'Kf20ghijkl654321'"
    data = [(k, example, "a") for k in range(40)] + [(50, own, "a")] * 40 + [(51, own, "a")] + [(None, f"{k} password=hunter2hunter", None) for k in range(30)]
    found = {x.doc_id: x for x in secrets.scan(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert found[0].n_live == 0 and found[0].n_example == 1 and found[0].spread == "1:40"
    assert found[50].n_live == 1 and found[50].n_example == 0 and found[50].spread == "1:2"
    assert found[None].n_live == 0 and found[None].spread == "1:30"


def test_secret_counts_against_brute_force(spark):
    """Wide candidates, verdicts and counts; a digit late in a token; matches beyond one run of positions."""
    r = random.Random(12)
    token = lambda n: "".join(r.choice("abcXYZ019_") for _ in range(n))
    pool = [token(r.randint(18, 40)) for _ in range(30)] + ["aB" * 60 + "7x", "your_Token_example_1234567"]
    data = []
    for k in range(60):
        parts = [r.choice(("see ", "password=", "é: ")) + r.choice(pool) for _ in range(r.randint(0, 6))]
        data.append((k if k % 9 else None, " ".join(parts), r.choice("abc")))
    data += [(200, "token=abcdef " * 400 + pool[-2], "a"), (201, None, "a"), (202, "", None)]
    spans = {}
    for i, t, s in data:
        base = sorted((m.start(), rank, kind, m.end(), m[group]) for rank, (kind, p, group, least) in enumerate(secrets.PATTERNS[:3]) for m in re.finditer(p, t or "") if len(m[group]) >= least)
        wide = [(m.start(), 3, "other", m.end(), m[0]) for m in re.finditer(secrets.PATTERNS[3][1], t or "") if re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])]
        spans[i, t, s] = base + [w for w in wide if not any(b[0] < w[3] and w[0] < b[3] for b in base)]
    owners, documents = collections.defaultdict(set), collections.defaultdict(set)
    for (i, t, s), found in spans.items():
        for x in found:
            owners[x[4]].add(s or "")
            documents[x[4]].add(t if i is None else i)
    live = lambda v: len(owners[v]) <= 1 and len(documents[v]) <= 10 and not re.search(secrets.PLACEHOLDER, v)
    expected = []
    for i, t, s in data:
        told = sorted(x for x in spans[i, t, s] if x[1] < 3 or live(x[4]))
        expected.append((str(i), ",".join(f"{k}:{a}:{b}" for a, _, k, b, _ in told), sum(live(x[4]) for x in told), ",".join(f"{len(owners[x[4]])}:{len(documents[x[4]])}" for x in told)))
    found = secrets.scan(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    assert sorted((str(x.doc_id), x.spans, x.n_live, x.spread) for x in found) == sorted(expected)
    assert any(pool[-2] in (t or "") and live(pool[-2]) for _, t, _ in data) or len(owners[pool[-2]]) > 1


def test_containment(spark, make, rows):
    r = random.Random(4)
    items = [(k, prose(r, n)) for k, n in enumerate((4, 5, 6, 9, 20, 41, 80))] + [(90, None), (91, "")]
    docs = [*rows, (100, prose(r, 300) + " " + items[4][1].upper() + ". " + prose(r, 200)), (101, items[5][1]), (102, " ".join(items[6][1].split()[:66])), (103, items[1][1] + " " + items[2][1]), (104, items[0][1]), (None, f"x {items[4][1]} y"), (105, items[4][1]), (105, "clean under an id that another row has contaminated")]
    items += [(92, "ab CD"), (93, "word"), (94, items[1][1])]
    docs += [(106, "one ab, cd two"), (107, "a word"), (108, "ab"), (109, "abcd words")]
    split = lambda t: [x for x in re.split(r"[^a-züé]+", (t or "").lower()) if x]
    runs = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    wanted = lambda s: runs(split(s), min(5, len(split(s)))) if split(s) else set()
    grams = lambda t: set().union(*(runs(split(t), n) for n in range(1, 6)))
    hits = [(i, t, k, len(grams(t) & wanted(s)) / len(wanted(s))) for i, t in docs for k, s in items if wanted(s) and len(grams(t) & wanted(s)) >= 0.8 * len(wanted(s)) - 1e-9]
    expected = {}
    for i, _, k, share in hits:
        expected[i, k] = max(share, expected.get((i, k), 0))
    assert (106, 92) in expected and (107, 93) in expected and (None, 4) in expected
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id): x.containment for x in decontaminate.contained(make(docs), bench).collect()} == pytest.approx(expected)
    left = sorted((str(x.doc_id), str(x.text)) for x in decontaminate.without_contaminated(make(docs), bench).collect())
    bad = {(i, t) for i, t, _, _ in hits}
    assert left == sorted((str(i), str(t)) for i, t in docs if (i, t) not in bad) and any(i == "105" for i, _ in left)
    assert decontaminate.contained(make([]), bench).collect() == [] and decontaminate.contained(make(docs), bench.limit(0)).collect() == []
    assert len(decontaminate.without_contaminated(make(docs), bench.limit(0)).collect()) == len(docs)


def test_phrase_that_opens_many_items(spark, make):
    r = random.Random(11)
    opening = prose(r, 8)
    items = [(k, f"{opening} {prose(r, 12)}") for k in range(130)]
    docs = [(k, f"{prose(r, 9)} {items[k][1] if k % 3 == 0 else opening} {prose(r, 9)}") for k in range(60)]
    found = decontaminate.contained(make(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} == {(k, k) for k in range(0, 60, 3)}


def test_pii_base_and_skip_chain(make):
    good = "4111 1111 1111 1111"
    texts = ["mail a.b@c.example.org, a.b@c.example", "ip 10.0.0.255 and 300.1.1.1 1.2.3.4.5.6.7.8", f"card {good} no 4111111111111112", "+49 (170) 1234567 and +1 2", "x@y @z.com", "0" * 5000 + ".1.2.3"]
    patterns = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    for t in texts:
        assert pii.base_spans(t) == [[m.span() for m in re.finditer(p, t) if ok(m[0])] for p, ok in patterns]
    text = "call +49 170 1234567 today " + "and so on " * 40 + "again 0170 1234567 please"
    docs = make([(1, text), (2, None), (3, ""), (4, "no data"), (None, text), *((10 + k, texts[k % 4]) for k in range(20))])
    found = {x.doc_id: x for x in pii.scan(docs).collect()}
    assert found[1].n_phone == 1 and found[1].n_added == 1 and found[1].spans.count("phone") == 2 and found[2].spans == found[4].spans == ""
    redacted = {x.doc_id: x for x in pii.redact(docs).collect()}
    assert redacted[1].text.count("[PHONE]") == 2 and redacted[2].text is None and redacted[4].text == "no data" and redacted[1].n_chars == len(redacted[1].text)
    assert pii.scan(make([])).collect() == []


def test_pii_weights_of_links_are_learned(make):
    """Found entities that repeat teach the link, and with it mentions in other forms are found, others left alone."""
    r = random.Random(31)
    number = lambda: f"{r.randint(100, 999)} {r.randint(1000000, 9999999)}"
    docs = [(k, f"call +49 {(n := number())} or +49 {n} at once") for k in range(60)]
    docs += [(100 + k, f"order {r.randint(10**15, 10**16 - 1)} of a set {r.randint(10**15, 10**16 - 1)}") for k in range(60)]
    docs += [(300 + k, f"write jane.roe{k}@mail.example.org and jane.roe{k}@mail.example.org") for k in range(40)]
    docs += [(200, "call +49 170 1234567, later 0170 1234567; order 9807915762804490"), (201, "9807915762804490 and 9807915762804490"), (202, "jane.roe@mail.example.org, that is Jane Roe or jane_roe, not Janet Roe"), (203, "host 10.1.2.3 once, 10[.]1[.]2[.]3 again"), (204, "jane.roe@mail.example.org, jane.roe at mail dot example dot org")]
    weights = pii.fit(make(docs))
    phone, mail = pii.LABELS.index("phone"), pii.LABELS.index("email")
    assert weights.skip[phone, phone] > max(0, weights.skip[0, phone]) and weights.skip[mail, mail] > max(0, weights.skip[0, mail])
    found = {x.doc_id: x for x in pii.scan(make(docs), weights).collect()}
    assert found[200].spans == "phone:5:20,phone:28:40" and found[201].spans == ""
    assert [found[k].n_added for k in (202, 203, 204)] == [2, 1, 1]
    assert all(found[k].n_added == 0 for k in range(160) if k in found)


def test_marginals_equal_enumeration():
    """Belief propagation against the sum over all labelings, on chains and trees of links (exact there)."""
    r = np.random.RandomState(3)
    for case in range(20):
        w = pii.Weights()
        w.node, w.chain, w.skip = r.normal(size=w.node.shape), r.normal(size=w.chain.shape), r.normal(size=w.skip.shape)
        w.chain[:-1], w.skip[:-1] = (x[:-1] + x[:-1].T for x in (w.chain, w.skip))
        nodes = object.__new__(pii.Nodes)
        n = 5
        nodes.code = r.randint(0, int(np.prod(pii.SIZES)), n).tolist()
        nodes.label = [int(r.randint(1, 5)) if r.rand() < 0.2 else -1 for _ in range(n)]
        nodes.prev = [-1, 0, 1, -1, 3] if case % 2 else [-1, 0, -1, 2, -1]
        nodes.skips = [(1, 3)] if case % 2 else [(0, 4), (1, 3)]
        own = pii._one_hot(np.array(nodes.code)) @ w.node
        total = np.zeros((n, 5))
        for y in itertools.product(range(5), repeat=n):
            if any(k >= 0 and k != a for k, a in zip(nodes.label, y, strict=True)):
                continue
            score = sum(own[i, a] for i, a in enumerate(y)) + sum(w.chain[y[nodes.prev[i]], y[i]] for i in range(n) if nodes.prev[i] >= 0) + sum(w.skip[y[j], y[i]] for j, i in nodes.skips)
            total[range(n), y] += np.exp(score)
        assert w.infer(nodes) == pytest.approx(total / total.sum(axis=1, keepdims=True), abs=2e-3)


def test_pii_finds_every_repeat(make):
    call, mail, gap = "call +49 170 1234567 today ", "write to jane.roe@mail.example.org ", "and so on " * 40
    texts = [call + (gap + "again 0170 1234567 please ") * 50, (gap + "again 0170 1234567 please ") * 50 + call, mail + (gap + "ask jane.roe there ") * 50]
    rows = [*enumerate(texts), *((10 + k, f"call +49 171 {7654321 + k} or 2.5 at 10.0.0.{k}, no {k} of 1000{k}") for k in range(40))]
    found = {x.doc_id: x for x in pii.scan(make(rows)).collect()}
    assert [found[k].n_added for k in range(3)] == [50, 50, 50]
    redacted = {x.doc_id: x.text for x in pii.redact(make(rows)).collect()}
    assert [redacted[k].count(f"[{name}]") for k, name in enumerate(("PHONE", "PHONE", "EMAIL"))] == [51, 51, 51]


def test_bpe_equals_the_library(make, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(3)
    parts = ["a", "b", "ing", "th", "e", "!", "'", " ", "1", "é", "ü", "S", "\n", "tion", "́", "Σ", "ß", "<|", "in", "'s", "<|endoftext|>", "\x1c", "İ", "日本", "🎉"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 40))) for _ in range(300)] + ["a" * 2000, "!" * 301]
    docs = [*rows, *enumerate(texts, 1000)]
    found = {(x.doc_id, x.decoded): x for x in bpe.encode(make(docs), path, full=True).collect()}
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        x = found[i, library.decode(ids, skip_special_tokens=False)]
        assert x.ids == ids and x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    again = bpe.decode(bpe.encode(make(rows), path, full=True).select("doc_id", "ids"), path)
    assert {x.decoded for x in again.collect()} <= {d for _, d in found}


def test_bpe_on_every_code_point(make):
    """All assigned and unassigned code points but surrogates, 64 to a text, alone and inside words."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0 or 0x1E000 <= c < 0x1FC00)]
    texts = ["".join(points[k : k + 64]) for k in range(0, len(points), 64)] + [" ".join(f"a{c}b" for c in points[k : k + 64]) for k in range(0, 13312, 64)]
    found = {x.doc_id: x.ids for x in bpe.encode(make(list(enumerate(texts))), path, full=True).collect()}
    expected = library.encode_batch(texts, add_special_tokens=False)
    assert all(found[k] == e.ids for k, e in enumerate(expected))


def test_bpe_of_empty_tables_and_other_files(make, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.encode(make([]), path).collect() == []
    with pytest.raises(ValueError, match="tokenizer file"):
        bpe._encoder(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())


def test_compiled_rows_are_the_gadgets():
    r = random.Random(21)
    for _ in range(60):
        symbols, merges = list("abc"), []
        known = list(symbols)
        while len(merges) < 8:
            u, v = r.choice(known), r.choice(known)
            if u + v not in known:
                merges.append((u, v))
                known.append(u + v)
        pieces = {p: i for i, p in enumerate(known)}
        machine = bpe.MergeAutomaton(pieces, merges, "")
        for _ in range(40):
            word = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
            tokens = list(word)
            for u, v in merges:
                out = []
                for x in tokens:
                    if out and out[-1] == u and x == v:
                        out[-1] = u + v
                    else:
                        out.append(x)
                tokens = out
            assert [known[i] for i in machine.encode(word)] == tokens, (merges, word)
            for a, b in itertools.pairwise(tokens):
                assert machine.arc(pieces[a], pieces[b])
        for u, v in merges:
            assert not machine.arc(pieces[u], pieces[v])


def test_lm_base_score(make, rows):
    tokens = [(i, WORD.findall((t or "").translate(LOWER)) + [None]) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(x for i, ts in tokens if not out(i) for x in ts)
    n, v = sum(count.values()), len(count)
    expected = sorted((str(i), out(i), len(ts), sum(count[x] > 0 for x in ts), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in ts), 6)) for i, ts in tokens)
    for head in (400_000, 3):  # all words in the broadcast head, and nearly none
        found = lm.score(make(rows), head_words=head).collect()
        assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in found) == expected
        assert all(x.score < 0 for x in found)
    assert lm.score(make([])).collect() == []
    known = {x.doc_id: x.score / x.n_tokens for x in found}
    assert known[65] > known[63]


def quantised_scores(rows, prior=8.0):
    """Sum of log10 of the smoothed pair probability, with every count read as the middle of its power of two."""
    texts = [(i, [None, *WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = collections.Counter(x for i, ts in texts if not out(i) for x in ts[1:])
    pairs = collections.Counter(p for i, ts in texts if not out(i) for p in itertools.pairwise(ts))
    read = lambda c: (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2 if c else 0.0
    bottom = sum(words.values()) + len(words) + 1
    chance = lambda a, b: (read(pairs[a, b]) + prior * (read(words[b]) + 1) / bottom) / (read(words[a]) + prior)
    return {i: sum(math.log10(min(chance(a, b), 1.0)) for a, b in itertools.pairwise(ts)) for i, ts in texts}


def test_lm_score_of_frequent_words(make):
    often = [(7, "of the " * 140_000 + "of a " * 40_000), (2, "of the of a cat"), (3, "the cat"), (4, "a a of of"), (5, ""), (6, "the of a dog")]
    found = lm.score(make(often), bits_per_entry=64).collect()
    assert {x.doc_id: x.score for x in found} == pytest.approx(quantised_scores(often), rel=1e-9)


def test_lm_score_beyond_the_filter(make, rows):
    some = [(k, t) for k, (_, t) in enumerate(rows)]
    expected = quantised_scores(some)
    for bits in (64 << 20, 512_000, 5_120):  # all counts in the filter, the frequent ones, nearly none
        found = {x.doc_id: x.score for x in lm.score(make(some), bits_per_entry=512, filter_bits=bits).collect()}
        assert found == pytest.approx(expected, rel=1e-9), bits


def test_filter_never_forgets():
    keys = np.random.RandomState(1).randint(0, 2**63, 5000).astype(np.uint64)
    level = lm._level(np.arange(1, 5001))
    size = 64 + int(level.sum()) * 8
    f = lm.Filter({0: (size, lm._filter(keys, level, size))}, 1)
    counts = f.pairs(keys)
    assert (counts >= lm._MIDDLE[level]).all() and (f.pairs(keys ^ np.uint64(12345)) == 0).mean() > 0.9


def test_quality_classifier_held_out(spark, make):
    r = random.Random(6)
    docs, labels = [], []
    for k in range(400):
        good = k % 2
        t = prose(r, 60)
        docs.append((k, t if good else " ".join(w + "###" for w in t.split())))
        labels.append((k, good, 0))
    docs += [(1000, None), (1001, "")]
    frame, marks = make(docs), spark.createDataFrame([*labels, (7, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = {x.doc_id: x for x in quality_model.score(frame, quality_model.train(frame, marks)).collect()}
    held = [x for i, x in found.items() if x.held_out and i < 1000]
    assert held and np.mean([x.predicted == x.doc_id % 2 for x in held]) > 0.95
    assert found[1000].score == found[1001].score and all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in found.items())
    assert not quality_model.train(frame, marks.limit(0)).any()


@pytest.mark.parametrize("operator", [simhash.near_duplicates, quality_rules.judge, secrets.scan])
def test_empty_tables(make, operator):
    assert operator(make([])).collect() == []


def plain_grams(text):
    """N-grams of words and of shapes, with their kind, in plain Python."""
    words = WORD.findall(text)
    shapes, before = [], None
    for w in words:
        marks = "".join("a" if c.islower() or ord(c) >= 128 else "A" if "A" <= c <= "Z" else "0" if c.isdigit() else c for c in w)
        shapes.append("again" if w == before else "".join(k for k, _ in itertools.groupby(marks)))
        before = w
    return [(kind, *x[k : k + n]) for kind, x, most in (("word", words, 2), ("shape", shapes, 3)) for n in range(1, most + 1) for k in range(len(x) - n + 1)]


def plain_ftrl(rows, passes, alpha, beta, l1, l2):
    """One coordinate at a time."""
    z, n, order = collections.Counter(), collections.Counter(), np.random.RandomState(7)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(passes):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_quality_classifier_against_plain_python(spark, make):
    """N-grams, FTRL steps, shard average and scores, each against a version without NumPy."""
    r = random.Random(16)
    texts = [" ".join(r.choice(("Ab1", "word", "word", "x#y", "1,234", "über", "MIX", "a")) for _ in range(r.randint(1, 12))) for _ in range(40)] + ["", None]
    slot_of = {}
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        _, slots = quality_model._slots(data, np.array([0, len(data)]))
        grams = plain_grams(t or "")
        # in the order of kinds and lengths, as the operator lists them
        assert len(slots) == len(grams)
        for g, s in zip(grams, slots.tolist(), strict=True):
            assert slot_of.setdefault(g, s) == s, g
    assert len(set(slot_of.values())) > 0.99 * len(slot_of)

    def example(t):
        grams = plain_grams(t or "")
        out = collections.Counter(slot_of[g] for g in grams)
        return {i: float(np.float32(c * (quality_model.SCALE / len(grams)))) for i, c in out.items()} | {1 << quality_model.BITS: 1.0}

    docs, marks = make(list(enumerate(texts))), spark.createDataFrame([(k, k % 2) for k in range(42)], "doc_id long, quality int")
    options = {"passes": 2, "alpha": 0.5, "beta": 1.0, "l1": 0.02, "l2": 0.1}
    parts = quality_model._examples(docs.join(marks.withColumnRenamed("quality", "y"), "doc_id").filter(~quality_model.held_out()), 3).toPandas()
    total, expected = len(parts), collections.Counter()
    for _, shard in parts.groupby("shard"):
        rows = [(dict(zip(np.frombuffer(s, np.int32).tolist(), np.frombuffer(v, np.float32).tolist(), strict=True)) | {1 << quality_model.BITS: 1.0}, y) for s, v, y in zip(shard["slots"], shard["values"], shard["y"], strict=True)]
        # every example is that of some text
        assert all(any(x == example(t) for t in texts) for x, _ in rows)
        fitted = quality_model._ftrl(pa.Table.from_pandas(shard), **options)
        plain = plain_ftrl(rows, **options)
        got = np.frombuffer(fitted["weights"][0].as_py(), np.float32)
        assert fitted["rows"][0].as_py() == len(rows) and max(abs(got[i] - w) for i, w in plain.items()) < 1e-5 and (got != 0).sum() <= len(plain)
        for i, w in plain.items():
            expected[i] += w * len(rows) / total
    # the average of the shards is what scores; the order of a shard's rows may differ, so compare one-row shards
    few = [k for k in range(40) if zlib.crc32(str(k).encode()) % 4 != 2][:1]
    one = marks.filter(F.col("doc_id").isin(few))
    weights = quality_model.train(docs, one, shards=1, **options)
    plain = plain_ftrl([(example(texts[few[0]]), few[0] % 2)], **options)
    assert max(abs(weights[i] - w) for i, w in plain.items()) < 1e-6 and (weights != 0).sum() == sum(w != 0 for w in plain.values())
    for x in quality_model.score(docs, weights).collect():
        margin = sum(plain.get(i, 0.0) * v for i, v in example(texts[x.doc_id]).items())
        assert x.score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-6) and x.predicted == int(x.score >= 0.7)


def test_quality_classifier_on_empty_tables_and_long_texts(spark, make):
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    assert not quality_model.train(make([]), marks).any() and not quality_model.train(make([(1, "a b")]), marks.limit(0)).any()
    weights = quality_model.train(make([(1, "a b " * 400_000), (1, "a b"), (2, "C D"), (3, None)]), marks)
    assert quality_model.score(make([]), weights).collect() == []
    found = quality_model.score(make([(1, "a b " * 400_000), (1, "a b " * 400_000), (None, ""), (9, None)]), weights).collect()
    assert len(found) == 4 and found[0].score == found[1].score and found[2].score == found[3].score


def test_bpe_worker_holds_a_piece_once():
    """Pieces and words of letters share one entry; emptied transitions leave the compiled rows, and the ids stay."""
    import public_tokenizers

    from tessera.llm import bpe

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        encoder = bpe.WordEncoder(f.read())
    text = "unbelievable words, unbelievable, it's 12 naïve words!"
    before = encoder(text)
    assert encoder["unbelievable"] is not None and "unbelievable" not in encoder.words
    machine = encoder.automaton
    rows = len(machine.rows)
    assert rows and all(isinstance(x, int) for state in machine.under_way for x in state)
    machine.clear()
    encoder.clear()
    encoder.words.clear()
    assert len(machine.rows) == rows and len(machine.moves) == 1
    assert encoder(text) == before
