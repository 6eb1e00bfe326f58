"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled in order, each by a merge gadget: after merge (u, v) -> uv the state
behind u loses its arc v, every state with an arc u gets an arc uv, and the state behind uv
has the arcs that the state behind v had. States are named by the token of the arc that
leads to them (arcs with one label share a target), so the automaton accepts exactly the
token sequences that the merges produce. The arcs of a state are compiled when it is first
reached: all merges are applied to its row in their order, one level of parts at a time.

Over symbols (bytes) it becomes a transducer by determinisation, one transition at a time as
in a lazy regular-expression automaton. A state of it is the list of tokens under way: the
automaton's state before each, and how far it has been read in the tree of the vocabulary.
A transition (state, symbol) has the next state and the one token that ends here. Encoding a
pre-split word follows transitions and reads the tokens back from the end; decoding emits the
arc labels of the ids.

Compiled rows and transitions are kept up to a bound and then compiled anew. Normalising and
pre-splitting are the tokenizers library's, so that they agree with it on every code point.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from . import blocks

#: Words kept per Python worker with their ids; beyond that the memory is emptied and filled anew.
CACHED_WORDS = 300_000
#: Compiled states (a bit for each token) and transitions kept per Python worker.
KEPT_ROWS, KEPT_MOVES = 4_096, 600_000
_NEVER = 1 << 30
#: Fixed value: the usual pattern of such files. Of ASCII letters with a mark behind them it makes the letters and the mark.
LETTERS = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


class MergeAutomaton:
    """Compiled arcs of states and transitions over symbols, from the vocabulary and the ordered merges."""

    def __init__(self, pieces: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.end = end
        self.size = max(pieces.values()) + 1
        self.made = np.full(self.size, -1, np.int64)
        self.right: dict[int, int] = {}
        lefts: dict[int, list[tuple[int, int]]] = {}
        depth = np.zeros(self.size, np.int64)
        first = np.zeros(self.size, np.int64)
        for r, (a, b) in enumerate(merges):
            u, v, uv = pieces[a], pieces[b], pieces[a + b]
            if uv in self.right:
                raise ValueError(f"two merges make {a + b!r}")
            self.made[uv], self.right[uv], first[uv], depth[uv] = r, v, u, depth[u] + 1
            lefts.setdefault(u, []).append((v, r))
        self.lefts = {u: tuple(np.array(x) for x in zip(*vr, strict=True)) for u, vr in lefts.items()}
        # tokens by the number of merges along their left parts: a level only needs the one before
        self.levels = [(x := np.flatnonzero(depth == d), first[x], self.made[x]) for d in range(1, int(depth.max(initial=0)) + 1)]
        self.tree: list[dict[str, int]] = [{}]
        self.ends = [-1]
        for piece, i in pieces.items():
            if i not in self.right and len(piece.removesuffix(end) if end else piece) != 1:
                continue  # special tokens are no arcs
            node = 0
            for c in self.symbols(piece.removesuffix(end), piece.endswith(end)) if end else piece:
                if c not in self.tree[node]:
                    self.tree[node][c] = len(self.tree)
                    self.tree.append({})
                    self.ends.append(-1)
                node = self.tree[node][c]
            self.ends[node] = i
        self.rows: dict[int, bytes] = {}
        self.clear()

    def symbols(self, word: str, whole: bool = True) -> list[str]:
        """The symbols of a word; the last one carries the end mark."""
        out = list(word)
        if whole:
            out[-1] += self.end
        return out

    def clear(self) -> None:
        """Empty states and transitions; compiled rows, from which they are made cheaply, have their own bound."""
        # a token under way in one number: the state before it, and in the low half its place in the tree
        self.ids: dict[tuple, int] = {(-1 << 32,): 0}
        self.under_way: list[tuple] = [(-1 << 32,)]
        self.lists: dict[tuple, tuple] = {}  # the few lists of places, each once
        self.moves: list[dict[str, tuple]] = [{}]
        self.kept = 0

    def row(self, t: int) -> bytes:
        """The arcs of the state behind t, a bit for each token: all merges applied in their order.

        Behind t, the arcs were copied from its right part when t was made, and so on down to a
        symbol: so merges with t, its right part, ... on the left took an arc away in turn.
        An arc x came if that of x's left part was there when x was made.
        """
        gone = np.full(self.size, _NEVER, np.int64)
        until = _NEVER
        while t >= 0:
            since = int(self.made[t])
            if t in self.lefts:
                v, rank = self.lefts[t]
                some = (rank >= since) & (rank < until)
                gone[v[some]] = np.minimum(gone[v[some]], rank[some])
            t, until = self.right.get(t, -1), since
        came = np.ones(self.size, bool)
        for x, u, made in self.levels:
            came[x] = came[u] & (gone[u] > made)
        return np.packbits(came & (gone == _NEVER), bitorder="little").tobytes()

    def arc(self, t: int, x: int) -> bool:
        """Whether the state behind t has an arc x, read from its compiled row."""
        row = self.rows.get(t)
        if row is None:
            if len(self.rows) >= KEPT_ROWS:
                self.rows.clear()
            row = self.rows[t] = self.row(t)
        return row[x >> 3] >> (x & 7) & 1 == 1

    def _move(self, state: int, symbol: str) -> tuple:
        """Compile a transition: next state, which of the tokens under way ends here, its id, and which go on."""
        on, left, ended, token = [], [], -1, -1
        for k, at in enumerate(self.under_way[state]):
            t, node = at >> 32, self.tree[at & 0xFFFFFFFF].get(symbol, -1)
            if node < 0:
                continue
            x = self.ends[node]
            if x >= 0 and (t < 0 or self.arc(t, x)):
                ended, token = k, x
            if self.tree[node]:
                on.append(t << 32 | node)
                left.append(k)
        if ended < 0:
            raise ValueError(f"no token for the symbol {symbol!r}")
        after = (*on, token << 32)
        to = self.ids.get(after)
        if to is None:
            to = self.ids[after] = len(self.under_way)
            self.under_way.append(after)
            self.moves.append({})
        places = tuple(left)
        move = self.moves[state][symbol] = (to, ended, token, self.lists.setdefault(places, places))
        self.kept += 1
        return move

    def encode(self, word: str) -> list[int]:
        """Ids of a pre-split word, given in the characters that stand for its bytes."""
        if self.kept >= KEPT_MOVES:
            self.clear()
        moves, state, path = self.moves, 0, []
        for c in self.symbols(word):
            move = moves[state].get(c) or self._move(state, c)
            path.append(move)
            state = move[0]
        out, j = [], len(path)
        while j:
            j -= 1
            _, k, token, _ = path[j]
            out.append(token)
            # where the token that ended began: back through the places it had among those under way
            while j and k < len(left := path[j - 1][3]):
                k = left[k]
                j -= 1
        return out[::-1]


def _checked(spec: dict) -> dict:
    """The file, if it is of the kind that this encoder is exact for."""
    model, pre = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    # words without the white space between them, then bytes
    split = [p.get("type") for p in pre] == ["Split", "ByteLevel"] and pre[0].get("behavior") == "Removed" and pre[0].get("invert") and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
    spaces = any(n.get("type") == "Replace" and n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " " for n in (spec.get("normalizer") or {}).get("normalizers", []))
    added = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not (plain and split and spaces and added and spec.get("decoder") is None and spec.get("post_processor") is None):
        raise ValueError("the tokenizer file must be BPE over bytes of words that a pattern splits off, without a decoder")
    return spec


class WordEncoder(dict):
    """White-space free piece of normalised text -> ids as little-endian bytes, and their labels joined by spaces."""

    def __init__(self, raw: bytes):
        spec = _checked(json.loads(raw))
        model = spec["model"]
        self.automaton = MergeAutomaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.labels = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        library = Tokenizer.from_str(raw.decode())
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.plain = [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.letters = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == LETTERS
        self.words: dict[str, tuple[bytes, str]] = {}

    def __missing__(self, piece: str) -> tuple[bytes, str]:
        stem = piece[:-1] if piece[-1] in ".,!?;:" else piece
        if self.letters and stem.isascii() and stem.isalpha():  # what the pattern does with letters and a mark behind them
            if stem is piece:
                ids = self.automaton.encode(piece)
                out = self[piece] = np.array(ids, "<u4").tobytes(), self.decode(ids)
                return out
            found = [self[stem], self.words.get(piece[-1]) or self._word(piece[-1])]
        else:
            found = [self.words.get(w) or self._word(w) for w, _ in self.split(piece)]
        out = self[piece] = b"".join([i for i, _ in found]), " ".join([t for _, t in found])
        return out

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.automaton.encode(word)
        out = self.words[word] = np.array(ids, "<u4").tobytes(), self.decode(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.labels[i] for i in ids])

    def pieces(self, text: str) -> list[str]:
        if self.plain and text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split would take these for white space
            return text.lower().split()
        return [p for p in self.normalize(text).split(" ") if p]

    def __call__(self, text: str) -> tuple[bytes, str]:
        """Ids and decoded text of a whole text."""
        if len(self) >= CACHED_WORDS:
            for memory in (self, self.words):
                memory.clear()
        ids, said = [], []
        parts = self.marks.split(text) if self.marks and self.marks.search(text) else [text]
        for part in parts:
            if part in self.added:
                ids.append(self.added[part].to_bytes(4, "little"))
                said.append(part)
                continue
            found = [self[p] for p in self.pieces(part)]
            ids.append(b"".join([i for i, _ in found]))
            said.append(" ".join([t for _, t in found if t]))
        return b"".join(ids), " ".join([s for s in said if s])


_encoders: dict[str, WordEncoder] = {}


def vocabulary(spark: SparkSession, path: str):
    """The tokenizer file, read once on the driver and broadcast; its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoder(raw: bytes) -> WordEncoder:
    name = hashlib.md5(raw).hexdigest()
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = WordEncoder(raw)
    return _encoders[name]


def encode(docs: DataFrame, path: str, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with `full` also ids (array of int) and decoded.

    One row per input row. A null or empty text has no ids and decodes to the empty text.
    The strings of added tokens in a text become these tokens, as in the tokenizers library.
    An empty table gives an empty one; a very long text is cut into words like any other. Only
    doc_id and text are read. A tokenizer file of another kind is an error.
    """
    vocab = vocabulary(docs.sparkSession, path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * full

    kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * full

    def judged(ids, said):
        # a text's ids and decoded text go at once, unless they are asked for
        out = len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode()).hexdigest()
        return (*out, memoryview(ids).cast("I").tolist() if ids else [], said) if full else out

    def run(batches):
        encoder = _encoder(vocab.value)
        for batch in batches:
            rows = [judged(*encoder(t.as_py() or "")) for t in batch.column("text")]
            columns = [batch.column("doc_id"), *map(pa.array, zip(*rows, strict=True), kinds)] if rows else [batch.column("doc_id"), *(pa.array([], k) for k in kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.corpus(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full)


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded of rows (doc_id, ids array<int>): the labels of the ids, joined by spaces; null ids give the empty text."""
    vocab = vocabulary(ids.sparkSession, path)

    def run(batches):
        encoder = _encoder(vocab.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encoder.decode(i.as_py() or []) for i in batch.column("ids")], pa.string())], names=["doc_id", "decoded"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")
