"""Personal data with a skip-chain conditional random field.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. Every match and
every weaker mention (a long number, an address written around, the name of a found address with
other marks between its parts) is a node. Neighbouring nodes share a chain potential; a node and the previous one
with the same or a similar key (digits, last seven digits, name or its parts) share a skip potential,
however far apart, and so do a mention and the first base match with its key, so that evidence
does not fade from repeat to repeat. Loopy belief propagation makes the labels of a document consistent, so a
mention that repeats a found entity in another form is found too. Base spans always stay.

The weights are fitted by pseudo-likelihood on the base labels of the whole corpus. A node
enters as its discrete pattern, so the counts of all patterns are a small table whatever the
size of the corpus. Mentions with a skip link to a found entity are left out of the fit, as
their label is what the model is for. In their place, found entities with a link to another one
enter once more with their form masked: what made the pattern find them (the plus, the at sign,
the dots, the check digit) is hidden, so that the link has to tell the label, as for a mention.

Null and empty texts have no spans. Time and memory are linear in a text's length and nodes.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Most rows of the pattern table, which is all that reaches the driver: cells of SIZES x labels x two neighbours' labels x skip label.
SIZES = (6, 2, 2, 2, 2, 5)
CHAIN_GAP = 60

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number begins where no digit stands before it: from inside a run of digits a match would fail as it did from the run's start
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9])\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
_AT = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{2,}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++", re.I)
_AT_DOT = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{2,}+\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++", re.I)
_IP_AROUND = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[\[(](?:\.|dot)[\])][0-9]{1,3}){3}(?![0-9])", re.I)
_PART = re.compile(r"[A-Za-z0-9]+")
_BETWEEN = frozenset(" ._-")
_CUES = (re.compile(r"mail|contact", re.I), re.compile(r"\bip\b|host|addr|server", re.I), re.compile(r"card|visa|iban|account", re.I), re.compile(r"tel|phone|call|fax|mobil", re.I))
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return not sum(twice[int(c)] if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans (start, end) of the base patterns, for each kind in order: leftmost, non-overlapping, failed matches dropped."""
    emails = list(_emails(text))
    if not _DIGITS.search(text):
        return [emails, [], [], []]
    ips = [m.span() for m in _IP.finditer(text) if all(len(n) <= 3 and int(n or 0) <= 255 for n in (p.lstrip("0") for p in m[0].split(".")))]
    cards, phones = [], []
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            cards.append(m.span())
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            phones.append(m.span())
    return [emails, ips, cards, phones]


def _named(text: str, names: set[str]) -> list[tuple[int, int]]:
    """Where the local part of a found address stands, as it is or with other marks between its parts."""
    plain = {n for n in names if len(n) >= 5}
    parts = [p for n in names if len(p := _PART.findall(n.lower())) >= 2 and sum(map(len, p)) >= 5]
    out = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]{5,}+", text) if m[0] in plain] if plain else []
    if not parts or not (runs := list(_runs(text))):
        return out
    # names of n parts are sought among all n neighbours of a run at once, by hashes from one running sum
    at = [x for run in runs for x in run]
    run_of = np.repeat(np.arange(len(runs)), [len(run) for run in runs])
    hashed = _hashes([text[a:b].lower() for a, b in at])
    known: dict[int, list[np.uint64]] = {}
    for p in parts:
        known.setdefault(len(p), []).append(_hashes(p)(np.array([0]), len(p))[0])
    for n, wanted in known.items():
        first = np.flatnonzero(run_of[: len(at) - n + 1] == run_of[n - 1 :]) if n <= len(at) else np.zeros(0, np.int64)
        hits = first[np.isin(hashed(first, n), np.array(wanted, np.uint64))]
        out += [(at[k][0], at[k + n - 1][1]) for k in hits.tolist()]
    return out


def _hashes(parts: list[str]):
    """A function from first parts and a number n to the hashes of n parts in a row."""
    end = np.cumsum([len(p) + 1 for p in parts])
    start = end - [len(p) + 1 for p in parts]
    data = np.frombuffer(("\n".join(parts) + "\n").encode(), np.uint8)
    return lambda first, n: blocks.span_hashes(data, start[first], end[first + n - 1])


def _runs(text: str):
    """Runs of two or more parts that stand one mark apart."""
    run: list[tuple[int, int]] = []
    for m in _PART.finditer(text):
        if run and not (m.start() - run[-1][1] == 1 and text[run[-1][1]] in _BETWEEN):
            if len(run) > 1:
                yield run
            run = []
        run.append(m.span())
    if len(run) > 1:
        yield run


def _keys(word: str) -> list[str]:
    """What makes two nodes alike: for numbers all digits and the last seven, for names the word, the name and its parts."""
    digits = "".join(_DIGITS.findall(word))
    numbers = re.split(r"[.\[\]()]+|dot", word, flags=re.I)
    if len(numbers) == 4 and all(n.isdigit() for n in numbers):
        return [f"={'.'.join(numbers)}"]
    if len(digits) >= 7 and "." not in word and "@" not in word and not re.search("[A-Za-z]", word):
        return [f"={digits}", f"~{digits[-7:]}"]
    name = re.split(r"@|\x20?[\[(]at[\])]|\x20at\x20", word.lower())[0].strip()
    return [f"={word.lower()}", f"@{name}", f"#{''.join(_PART.findall(name))}"]


class Nodes:
    """The nodes of one text in order: spans, base labels (-1 for a mention), feature codes, chain and skip links."""

    def __init__(self, text: str, base: list[list[tuple[int, int]]]):
        found = [(a, b, k + 1) for k, spans in enumerate(base) for a, b in spans]
        taken = sorted((a, b) for a, b, _ in found)
        mentions = [m.span() for p in (_NUMBER, _AT, _IP_AROUND) for m in p.finditer(text)]
        if " dot " in text.lower():
            mentions += [m.span() for m in _AT_DOT.finditer(text)]
        mentions += _named(text, {text[a : text.index("@", a)] for a, _ in base[0]})
        last = -1
        free, k, reach = [], 0, -1
        for a, b in sorted(mentions):
            while k < len(taken) and taken[k][0] < b:
                reach = max(reach, taken[k][1])
                k += 1
            if a >= reach and a >= last:  # of overlapping mentions the first
                free.append((a, b, -1))
                last = b
        self.spans = sorted(found + free)
        self.label = [s[2] for s in self.spans]
        self.code = [self._features(text, a, b) for a, b, _ in self.spans]
        self.prev = [i - 1 if i and self.spans[i][0] - self.spans[i - 1][1] <= CHAIN_GAP else -1 for i in range(len(self.spans))]
        self.skips: list[tuple[int, int]] = []
        seen: dict[str, int] = {}
        first: dict[str, int] = {}  # the first base match with a key
        keys_of = []
        for i, (a, b, _) in enumerate(self.spans):
            keys = _keys(text[a:b])
            for j in {seen[k] for k in keys if k in seen}:
                self.skips.append((j, i))
            keys_of.append(keys)
            for key in keys:
                seen[key] = i
                if self.label[i] >= 0:
                    first.setdefault(key, i)
        linked = set(self.skips)
        for i, keys in enumerate(keys_of):
            if self.label[i] < 0:
                self.skips += [(j, i) for j in sorted({first[k] for k in keys if k in first}) if (min(i, j), max(i, j)) not in linked]

    @staticmethod
    def _features(text: str, a: int, b: int) -> int:
        word = text[a:b]
        digits = "".join(_DIGITS.findall(word))
        n = len(digits)
        cue = next((k + 1 for k, c in enumerate(_CUES) if c.search(text, max(0, a - 20), a)), 0)
        values = (0 if not n else 1 if n < 7 else 2 if n < 9 else 3 if n < 13 else 4 if n < 20 else 5, word[0] == "+", "@" in word, word.count(".") == 3, n >= 13 and luhn(digits), cue)
        code = 0
        for v, size in zip(values, SIZES, strict=True):
            code = code * size + int(v)
        return code


def _one_hot(code: np.ndarray) -> np.ndarray:
    out = [np.ones((len(code), 1))]
    for size in reversed(SIZES):
        out.append(np.eye(size)[code % size])
        code = code // size
    return np.concatenate(out, axis=1)


class Weights:
    """Node weights (features x labels) and symmetric chain and skip weights (labels x labels, with a last row for "no neighbour")."""

    def __init__(self):
        n = len(LABELS)
        self.node = np.zeros((1 + sum(SIZES), n))
        self.node[0, 0] = 1.0  # prior: a node is nothing; the fit is drawn to this prior
        self.chain = np.zeros((n + 1, n))
        self.skip = np.vstack([2.0 * np.eye(n), np.zeros((1, n))])

    def fit(self, rows: list[tuple], steps: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> Weights:
        """rows: (code, label, label before, label after, label at the skip link, count); -1 for no neighbour."""
        if not rows:
            return self
        code, y, before, after, far, count = (np.array(c) for c in zip(*rows, strict=True))
        for k in np.unique(y[(far > 0) & (far == y)]):  # linked entities of a kind tell its weight, which needs no prior then
            self.skip[k, k] = 0.0
        x, weight, goal = _one_hot(code), count / count.sum(), np.eye(len(LABELS))[y]
        start = [w.copy() for w in (self.node, self.chain, self.skip)]
        eye = np.eye(len(LABELS) + 1)
        b, a, s = eye[before], eye[after], eye[far]
        step = [np.zeros_like(w) for w in start]
        for _ in range(steps):
            score = x @ self.node + (b + a) @ self.chain + s @ self.skip
            score -= score.max(axis=1, keepdims=True)
            p = np.exp(score)
            gap = (goal - p / p.sum(axis=1, keepdims=True)) * weight[:, None]
            for k, (w, g) in enumerate(((self.node, x.T @ gap), (self.chain, (b + a).T @ gap), (self.skip, s.T @ gap))):
                g = g - ridge * (w - start[k])
                step[k] += g * g
                w += rate * g / (np.sqrt(step[k]) + 1e-9)
        for w in (self.chain, self.skip):  # one potential for both directions
            w[:-1] = (w[:-1] + w[:-1].T) / 2
            w[-1] = 0.0
        return self

    def infer(self, nodes: Nodes, patience: int = 50) -> np.ndarray:
        """Marginals by loopy belief propagation until the messages settle; base labels are clamped.

        Where `patience` rounds bring the messages no nearer, the step is halved, so that it always ends.
        """
        n, m = len(nodes.code), len(LABELS)
        own = _one_hot(np.array(nodes.code)) @ self.node
        for i, k in enumerate(nodes.label):
            if k >= 0:
                own[i] = np.where(np.arange(m) == k, 0.0, -50.0)
        own -= own.max(axis=1, keepdims=True)
        edges = [(nodes.prev[i], i, self.chain) for i in range(n) if nodes.prev[i] >= 0] + [(j, i, self.skip) for j, i in nodes.skips]
        if not edges:
            p = np.exp(own)
            return p / p.sum(axis=1, keepdims=True)
        u, v = np.array([e[0] for e in edges] + [e[1] for e in edges]), np.array([e[1] for e in edges] + [e[0] for e in edges])
        pot = np.stack([e[2][:-1] for e in edges] * 2)
        twin = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        msg = np.zeros((len(u), m))
        step, least, since = 0.5, np.inf, 0
        while True:
            belief = own.copy()
            np.add.at(belief, v, msg)
            out = (belief[u] - msg[twin])[:, :, None] + pot
            top = out.max(axis=1, keepdims=True)
            new = (top + np.log(np.exp(out - top).sum(axis=1, keepdims=True)))[:, 0]
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - msg).max()
            msg = (1 - step) * msg + step * new
            if step * change < 1e-4:
                break
            least, since = (change, 0) if change < least else (least, since + 1)
            if since == patience:
                step, since = step / 2, 0
        belief = own.copy()
        np.add.at(belief, v, msg)
        belief -= belief.max(axis=1, keepdims=True)
        p = np.exp(belief)
        return p / p.sum(axis=1, keepdims=True)


def _masked(code: int) -> int:
    """The code without what only the form of a base match shows: a plus, an at sign, three dots, a check digit."""
    values = []
    for size in reversed(SIZES):
        values.append(code % size)
        code //= size
    digits, _, _, _, _, cue = reversed(values)
    for v, size in zip((digits, 0, 0, 0, 0, cue), SIZES, strict=True):
        code = code * size + v
    return code


def _patterns(nodes: Nodes) -> Counter:
    """Counts of (code, label, label before, label after, label at the skip link); of several links one to a found entity counts."""
    far: dict[int, int] = {}
    label = [max(k, 0) for k in nodes.label]
    for j, i in nodes.skips:
        far[i] = max(far.get(i, 0), label[j])
        far[j] = max(far.get(j, 0), label[i])
    out: Counter = Counter()
    for i, k in enumerate(nodes.label):
        linked = far.get(i, 0) > 0
        if k < 0 and linked:
            continue
        after = label[i + 1] if i + 1 < len(label) and nodes.prev[i + 1] == i else -1
        before = label[i - 1] if nodes.prev[i] >= 0 else -1
        out[nodes.code[i], label[i], before, after, far.get(i, -1)] += 1
        if k > 0 and linked:
            out[_masked(nodes.code[i]), label[i], before, after, far[i]] += 1
    return out


#: Only these texts can hold a node; others reach Python as null.
_WORTH = "[0-9@]|(?i:[\\[(]at[\\])]| dot )"


def fit(docs: DataFrame) -> Weights:
    """Fit the field on all texts; the driver receives counts by pattern only."""

    def run(batches):
        for batch in batches:
            total: Counter = Counter()
            for t in batch.column("text"):
                if text := t.as_py():
                    total += _patterns(Nodes(text, base_spans(text)))
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[c] for k in keys], pa.int32()) for c in range(5)] + [pa.array([total[k] for k in keys], pa.int64())], names=["code", "label", "before", "after", "far", "n"])

    worth = blocks.corpus(docs).filter(F.rlike("text", F.lit(_WORTH))).select("text")
    counted = worth.mapInArrow(run, "code int, label int, before int, after int, far int, n long").groupBy("code", "label", "before", "after", "far").agg(F.sum("n").alias("n"))
    return Weights().fit(sorted(tuple(r) for r in counted.collect()))


def find(text: str, weights: Weights) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Base spans and all spans of a text, by kind."""
    base = base_spans(text)
    nodes = Nodes(text, base)
    both = [list(s) for s in base]
    if -1 in nodes.label:
        p = weights.infer(nodes)
        for i, k in enumerate(nodes.label):
            if k < 0 and p[i].argmax() > 0 and p[i].max() > 0.5:
                both[p[i].argmax() - 1].append(nodes.spans[i][:2])
    return base, [sorted(s) for s in both]


def _written(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, s in zip(KINDS, spans, strict=True) for a, b in s)


def scan(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added; one row per input row, also for rows that repeat.

    An empty table gives an empty one. Only doc_id and text are read, so other columns cannot clash.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights or fit(docs))

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                text = t.as_py()
                base, both = find(text, model.value) if text else ([[]] * 4, [[]] * 4)
                rows.append((*map(len, base), hashlib.sha256(_written(base).encode()).hexdigest(), _written(both), sum(map(len, both)) - sum(map(len, base))))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    worth = blocks.corpus(docs).select("doc_id", F.when(F.rlike("text", F.lit(_WORTH)), F.col("text")).alias("text"))
    return worth.mapInArrow(run, "doc_id long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets, overlapping ones by the first; n_chars, if there, follows."""
    model = docs.sparkSession.sparkContext.broadcast(weights or fit(docs))
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = []
            for t in batch.column("text"):
                text = t.as_py()
                if text:
                    out, at = [], 0
                    _, both = find(text, model.value)
                    for a, b, k in sorted((a, b, k) for k, s in zip(KINDS, both, strict=True) for a, b in s):
                        if a >= at:
                            out += [text[at:a], f"[{k.upper()}]"]
                        at = max(at, b)
                    text = "".join(out) + text[at:]
                texts.append(text)
            columns = [pa.array(texts, batch.schema.field(n).type) if n == "text" else batch.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, docs.schema)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in names))
