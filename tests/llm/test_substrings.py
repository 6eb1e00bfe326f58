"""Both substring dedup operators against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import chunk_dedup, suffix_dedup


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioustrnäß") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    rows = [(k, prose(r.randint(1, 120)) + (" " + shared[k % 4] + " " if k % 3 == 0 else "") + prose(20)) for k in range(40)]
    rows += [(100 + k, rows[k][1]) for k in range(5)]  # exact copies
    rows += [(200, "a" * 3000), (201, "b" + "a" * 3000), (202, "ab" * 700), (203, None), (204, ""), (205, "x" * 49), (206, "x" * 50), (207, "x" * 50)]
    rows += [(3, rows[3][1]), (3, rows[5][1]), (None, rows[6][1]), (None, rows[6][1])]  # repeated ids and rows, null ids
    return rows


def cut_out(text, ranges):
    edge = [False] * len(text)
    for a, b in ranges:
        edge[a:b] = [True] * (b - a)
    spans = sum(e and not (k and edge[k - 1]) for k, e in enumerate(edge))
    return len(text), sum(edge), spans, hashlib.sha256(bytes(c for c, e in zip(text, edge, strict=True) if not e)).hexdigest()


def compare(result, expected):
    found = sorted(tuple(r) for r in result.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").na.fill({"doc_id": 10**9}).collect())
    assert found == sorted((i if i is not None else 10**9, *x) for i, x in expected)


def test_suffix_dedup_is_exact(make):
    rows = corpus()
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            least[raw[k : k + 50]] = min(least.get(raw[k : k + 50], 10**9), i if i is not None else 10**9)
    expected = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = [(k, k + 50) for k in range(len(raw) - 49) if least[raw[k : k + 50]] < (i if i is not None else 10**9)]
        expected.append((i, cut_out(raw, gone)))
    compare(suffix_dedup.dedup(make(rows)), expected)
    compare(suffix_dedup.dedup(make(rows), hot=2), expected)  # every key split as a hot one


def test_suffix_dedup_is_exact_where_pieces_repeat_by_chance(make):
    """Few words in any order, copies of long passages with a word changed, and one id for several rows."""
    r = random.Random(21)
    word = [f"{c}{d}nt" for c in "abcd" for d in "ei"]
    prose = lambda n: " ".join(r.choice(word) for _ in range(n))
    passage = prose(150).split()
    rows = [(k, prose(r.randint(10, 60))) for k in range(25)]
    for k in range(25, 45):
        now = passage.copy()
        now[r.randrange(150)] = "other"
        rows.append((k % 35 if k % 4 else None, prose(5) + " " + " ".join(now[r.randrange(40) :])))
    least = {}
    for i, t in rows:
        raw = t.encode()
        for k in range(len(raw) - 49):
            least[raw[k : k + 50]] = min(least.get(raw[k : k + 50], 10**9), i if i is not None else 10**9)
    lost = lambda i, raw: [(k, k + 50) for k in range(len(raw) - 49) if least[raw[k : k + 50]] < (i if i is not None else 10**9)]
    expected = [(i, cut_out(t.encode(), lost(i, t.encode()))) for i, t in rows]
    assert sum(x[1] for _, x in expected) > 3000
    compare(suffix_dedup.dedup(make(rows)), expected)
    compare(suffix_dedup.dedup(make(rows), hot=2), expected)


def test_suffix_dedup_sends_no_text_of_whole_copies():
    """Of a passage that two documents share, only what meets other text at its ends is searched; the rest is lost by its hash."""
    r = random.Random(22)
    prose = lambda n: "".join(r.choice("abcdefghijklmnopqrst ") for _ in range(n))
    passage = prose(5000)
    texts = [prose(300) + passage + prose(300) for _ in range(2)]
    found = {1: [], 2: []}
    blocks_ = [b for i, t in enumerate(texts) for b in suffix_dedup._anchors(1)([pa.record_batch({"id": pa.array([i + 1], pa.int64()), "text": [t]})])]
    for some in suffix_dedup._slices(np.array([b["bucket"][k].as_py() for b in blocks_ for k in range(b.num_rows)])):
        table = suffix_dedup._repeated(1, 1, 1000)(pa.Table.from_batches(blocks_).slice(some[0], some[1] - some[0]))
        for row in table.to_pylist():
            for i, number in zip(suffix_dedup.blocks.wide(row["ids"], row["n"]), np.frombuffer(row["keys"], np.int64), strict=True):
                found[int(i)].append(int(number))

    class Hot:
        value = np.zeros(0, np.uint64)

    sent, covered = 0, 0
    for i, t in enumerate(texts):
        batch = pa.record_batch({"id": pa.array([i + 1], pa.int64()), "place": pa.array([i], pa.int64()), "text": [t], "keys": pa.array([found[i + 1]], pa.list_(pa.int64()))})
        for b in suffix_dedup._contexts(1, Hot)([batch]):
            sent += sum(len(x.as_py()) for x in b["bytes"])
            covered += sum(int(np.frombuffer(x["sizes"], np.uint32).sum()) for x in b.to_pylist() if x["bucket"] >= 1)
    assert sent < 1000  # 37,312 when every context under a repeated key was sent
    assert 4800 < covered <= 5000


def test_suffix_dedup_over_the_whole_range_of_ids(make):
    """Also ids from 2^62 up are told apart, in their order, beside negative and null ones."""
    r = random.Random(15)
    text = "".join(r.choice("abcdefghij ") for _ in range(90))
    big = 2**62
    rows = [(big + 2, text), (big, text), (big + 1, "x " + text), (2**63 - 1, text), (-(2**63), text[:60]), (None, text), (None, text + "!"), (5, "short")]
    found = {(x.doc_id, x.n_bytes): x.n_removed for x in suffix_dedup.dedup(make(rows)).collect()}
    assert found == {(big + 2, 90): 90, (big, 90): 60, (big + 1, 92): 90, (2**63 - 1, 90): 90, (-(2**63), 60): 0, (None, 90): 90, (None, 91): 90, (5, 5): 0}


def chunks_of(raw):
    out, start = [], 0
    for k in range(len(raw)):
        h = 0
        for j in range(max(0, k - 15), k + 1):
            h += int(chunk_dedup._GEAR[raw[j]]) << (k - j)
        if (h >> 11) & 31 == 0 or k == len(raw) - 1 or k + 1 - start == 512:
            out.append((start, k + 1))
            start = k + 1
    return out


def test_chunk_dedup_matches_brute_force(make):
    rows = corpus()
    expected, seen = [], {}
    key = lambda row: (row[0] if row[0] is not None else 10**9, row[1] or "")
    every = [(i, t, a, b) for i, t in set(rows) for a, b in chunks_of((t or "").encode())]
    for i, t, a, _ in every:
        raw = (t or "").encode()
    result = {}
    for row in chunk_dedup.dedup(make(rows)).collect():
        result.setdefault(row.doc_id, []).append(row)
    # which of two rows with one doc_id comes first is not specified, so single ids are compared
    single = [i for i, _ in rows if sum(j == i for j, _ in rows) == 1]
    twice = {i for i, _ in rows} - set(single)
    for i, t in sorted(set(rows), key=key):
        raw = (t or "").encode()
        for a, b in chunks_of(raw):
            seen.setdefault(raw[a:b], []).append((i if i is not None else 10**9, t or "", a))
    for i in single:
        t = next(t for j, t in rows if j == i)
        raw, gone = (t or "").encode(), []
        for a, b in chunks_of(raw):
            first = min(seen[raw[a:b]], key=lambda x: (x[0], 0 if x[0] != i else x[2]))
            if (first[0], first[2]) != (i, a):
                gone.append((a, b))
        runs = []
        for a, b in gone:
            if runs and runs[-1][1] == a:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        expected.append((i, cut_out(raw, [x for x in runs if x[1] - x[0] >= 100])))
    for i, x in expected:
        assert [tuple(r)[1:] for r in result[i]] == [x], i
    assert len(result[3]) == sum(j == 3 for j, _ in rows) and twice


def test_insertion_moves_few_cuts():
    r = np.random.RandomState(3)
    raw = r.randint(97, 123, 5000).astype(np.uint8)
    more = np.concatenate((raw[:2000], np.frombuffer(b"inserted", np.uint8), raw[2000:]))
    cut = lambda x: {x[a:b].tobytes() for a, b in zip(*chunk_dedup.cuts(x, np.array([0, len(x)]))[:2], strict=True)}
    assert len(cut(raw) - cut(more)) <= 3


def test_suffix_array_is_sorted():
    r = random.Random(1)
    for n in (1, 2, 3, 4, 7, 50, 400):
        for alphabet in ("a", "ab", "abcdefgh"):
            text = np.frombuffer("".join(r.choice(alphabet) for _ in range(n)).encode(), np.uint8).astype(np.int64)
            raw = bytes(text.astype(np.uint8))
            assert suffix_dedup.suffix_array(text).tolist() == sorted(range(n), key=lambda k: raw[k:])


@pytest.mark.parametrize("operator", [suffix_dedup.dedup, chunk_dedup.dedup])
def test_empty_table(make, operator):
    assert operator(make([])).collect() == []
