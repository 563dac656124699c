"""BPE encoding and decoding by a tokenization automaton.

Compiling. Start with one state and a loop for every byte. Each merge (u, v), in order of rank, is a gadget on the automaton: the state
after u is replaced by a copy without the arc v, and every state with an arc u gets an arc uv to where u, v led. After
all merges the automaton accepts exactly the right tokenizations and nothing else. All u-arcs lead to one state, so there is
a state per token, and it is stored as what the gadgets changed: the rank at which its arc v was removed, and for uv
the rank from which it copies the arcs of v. :meth:`Gadgets.arc` unrolls these differences for one arc.

Encoding. A pre-split word is read from the start state: a tree of labels gives those that continue the word, the arc table says
which of them leave the present state, and the path that spells the whole word (there is exactly one) is the tokenization; its arc labels are the ids. Arcs
are entered in the table the first time they are asked for. Decoding takes the ids alone and emits the bytes of each id's label.

Words repeat, so each task keeps tables from words to their ids (as decimal text); tables are bounded by a fixed number of entries, which
changes no result.

Defined results: NULL text is empty: no ids, the digests of nothing; the text of an added token becomes its id, as in the
tokenizers library; repeated rows are encoded alike; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import MEMO_LIMIT, Memo, batch, batches_of, utf8

TABLE_LIMIT = 1_000_000          # arcs in a task's table before it is emptied: bounds memory, not results

# Letters, numbers and white space below U+0250, and the splitting rule of byte-level BPE.
NEAR = re.compile("[^\x00-ɏ]")
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
BLANK = "\t-\r \x85\xa0"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{BLANK}{LETTER}{NUMBER}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
# what a text must not have to be looked up by chunks: other white space, white space at an end or next to white space
OTHER_BLANK = re.compile(r"[^\S \n]").search
SINGLE = ("  ", " \n", "\n ", "\n\n")
LATIN_BLANKS = ("\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")


def plain(text: str) -> bool:
    if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in SINGLE):
        return False
    try:
        text.isascii() or text.encode("latin-1")
    except UnicodeEncodeError:
        return OTHER_BLANK(text) is None
    return not any(x in text for x in LATIN_BLANKS)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Gadgets:
    """The automaton over tokens, built merge by merge."""

    def __init__(self, n_tokens: int) -> None:
        self.born = [-1] * n_tokens              # rank of the merge that made a token; -1: a byte
        self.left = [0] * n_tokens
        self.right = [0] * n_tokens
        self.removed: dict[int, int] = {}        # (state u, arc v) -> rank at which the arc went

    def merge(self, u: int, v: int, uv: int, rank: int) -> None:
        if self.born[uv] < 0 and self.arc(u, v):                        # else no path has u, v: nothing to merge
            self.born[uv], self.left[uv], self.right[uv] = rank, u, v   # arc uv where arc u is; then the arcs after v
            self.removed[u << 20 | v] = rank                            # the copy of the state after u has no arc v

    def arc(self, x: int, y: int) -> bool:
        """Whether the state after token x has an arc y. Going back in rank, the younger of the two is replaced by
        what its gadget copied: arc y by the arc of its left part, the state after x by the state after its right part."""
        now = 1 << 60
        born, removed = self.born, self.removed
        while True:
            gone = removed.get(x << 20 | y)
            if gone is not None and gone < now:
                return False
            a, b = born[x], born[y]
            if a < 0 and b < 0:
                return True
            if b > a:
                if x == self.left[y] == self.right[y]:                  # the state after u has just lost its arc u
                    return False
                now, y = b, self.left[y]
            elif a > b:
                now, x = a, self.right[x]
            else:                                                       # x = y
                now, x, y = a, self.right[x], self.left[x]


class Machine:
    """Reads words: from state to state along the arcs whose labels spell the word."""

    def __init__(self, tokens: dict[int, bytes], gadgets: Gadgets) -> None:
        self.gadgets = gadgets
        self.length = {t: len(b) for t, b in tokens.items()}
        self.child: dict[int, int] = {}          # (node, byte) -> node of the tree of labels
        self.label_at = [-1]                     # of each node
        self.arcs: dict[int, bool] = {}          # (state, label) -> whether the arc exists; entered when first needed
        for t, data in tokens.items():
            at = 0
            for b in data:
                to = self.child.get(at << 8 | b)
                if to is None:
                    to = self.child[at << 8 | b] = len(self.label_at)
                    self.label_at.append(-1)
                at = to
            self.label_at[at] = t
        self.shorter = {t: self._shorter(data) for t, data in tokens.items()}      # the longest label that begins a label; -1: none

    def _shorter(self, data: bytes) -> int:
        return self.longest(data[:-1], 0)

    def longest(self, word: bytes, at: int) -> int:
        """The longest label that continues a word; -1 if there is none. ``shorter`` leads on to the others."""
        found, node, child, label_at = -1, 0, self.child, self.label_at
        for b in word[at:]:
            node = child.get(node << 8 | b)
            if node is None:
                break
            t = label_at[node]
            if t >= 0:
                found = t
        return found

    def arc(self, state: int, label: int) -> bool:
        key = state << 20 | label
        ok = self.arcs.get(key)
        if ok is None:
            ok = self.arcs[key] = self.gadgets.arc(state, label)
        return ok

    def encode(self, word: bytes) -> list[int]:
        """The one path that spells the word: at each state the longest label with an arc; where none is left, one label back and on with
        the next shorter one. Only one path spells each beginning of the word, too, so no position is entered twice and the
        work is bounded by positions times labels."""
        arcs, length, shorter, n = self.arcs, self.length, self.shorter, len(word)
        if len(arcs) > TABLE_LIMIT:
            arcs.clear()
        path: list[int] = []
        at, state = 0, -1
        t = self.longest(word, 0) if n else -1
        while at < n:
            while t >= 0 and state >= 0:
                ok = arcs.get(state << 20 | t)
                if ok or ok is None and self.arc(state, t):
                    break
                t = shorter[t]
            if t < 0:
                t = path.pop()
                at -= length[t]
                t, state = shorter[t], path[-1] if path else -1
                continue
            path.append(t)
            at += length[t]
            state = t
            t = self.longest(word, at)
        return path


class Coder:
    """A byte-level BPE tokenizer compiled from the text of a ``tokenizer.json``."""

    def __init__(self, text: str, memo: int = MEMO_LIMIT) -> None:
        spec = json.loads(text)
        model = spec["model"]
        vocab = model["vocab"]
        raw = {c: b for b, c in enumerate(byte_letters())}
        self.bytes_of = {i: bytes(raw[c] for c in t) for t, i in vocab.items()}
        gadgets = Gadgets(max(vocab.values()) + 1)
        for rank, pair in enumerate(model["merges"]):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            gadgets.merge(vocab[u], vocab[v], vocab[u + v], rank)
        reachable = {i: b for i, b in self.bytes_of.items() if len(b) == 1 or gadgets.born[i] >= 0}
        self.machine = Machine(reachable, gadgets)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: utf8(t) for t, i in self.added.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.emits = {self.decimal[i]: b for i, b in self.bytes_of.items()}          # label of an id in decimal text
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.spec = text
        self.first, self.spaced = Memo(self._chunk, memo), Memo(lambda c: self._chunk(c, " "), memo)         # chunk -> ids in decimal text; spaced: after a space
        self.feed = self.first["\n"]
        self._library = None

    def split(self, text: str) -> list[str]:
        """Pre-split words. Texts with characters from U+0250 on are split by the library, which knows its own Unicode tables."""
        if NEAR.search(text) is None:
            return SPLIT.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_str(self.spec).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """Words and added tokens in order."""
        if self.cut is None or not any(a in text for a in self.added):
            return self.split(text)
        out = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self.split(part)
        return out

    def coded(self, text: str) -> str:
        """Ids as decimal text, joined by commas.

        In a text whose only white space are single spaces and line feeds between other characters, the splitting rule cuts before each
        space and on both sides of each line feed; so its chunks can be looked up whole. Other texts are split first."""
        if text and plain(text) and not any(a in text for a in self.added):
            firsts, spaced, out = self.first, self.spaced, []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                out.append(firsts[first])
                out += [spaced[w] for w in rest]
                out.append(self.feed)
            out.pop()
            return ",".join(out)
        return ",".join([self._word(w) for w in self.pieces(text)])

    def emitted(self, ids: str) -> bytes:
        """The labels of ids in decimal text."""
        return b"".join(map(self.emits.__getitem__, ids.split(","))) if ids else b""

    def _word(self, word: str) -> str:
        return self.spaced[word[1:]] if word[0] == " " and len(word) > 1 else self.first[word]

    def _chunk(self, chunk: str, before: str = "") -> str:
        whole = before + chunk
        words = [whole] if chunk.isalpha() else self.pieces(whole)
        if len(words) == 1:
            return ",".join([self.decimal[i] for i in self.encode_word(whole)])
        return ",".join([self._word(w) for w in words])

    def encode_word(self, word: str) -> list[int]:
        one = self.added.get(word)
        return [one] if one is not None else self.machine.encode(utf8(word))

    def encode(self, text: str) -> list[int]:
        return [i for w in self.pieces(text) for i in self.encode_word(w)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(1)
def coder_of(text: str, memo: int) -> Coder:
    return Coder(text, memo)


def encode_decode(docs: DataFrame, tokenizer: str, keep_ids: bool = False, memo: int = MEMO_LIMIT) -> DataFrame:
    """doc_id, n_tokens, ids (NULL unless ``keep_ids``), ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the text
    decoded from them). ``tokenizer`` is the path of a byte-level ``tokenizer.json`` on the driver; its text is sent to the tasks. ``memo`` bounds the chunks a
    task remembers; it changes time and memory, not results."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())               # a vocabulary: of fixed size

    def run(batches):
        coder = coder_of(shared.value, memo)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, a, z = [], [], [], []
            none = pa.nulls(b.num_rows, pa.list_(pa.int32()))
            for t in b.column("text").to_pylist():
                text = coder.coded(t or "")
                n.append(text.count(",") + 1 if text else 0)
                if keep_ids:
                    ids.append(np.fromstring(text, np.int32, sep=",") if text else np.empty(0, np.int32))
                a.append(hashlib.sha256(text.encode()).hexdigest())
                z.append(hashlib.sha256(coder.emitted(text).decode("utf-8", "replace").encode()).hexdigest())
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), np.concatenate(ids)) if keep_ids else none
            return batch(doc_id=b.column("doc_id"), n_tokens=pa.array(n, pa.int64()), ids=lists,
                         ids_sha256=pa.array(a, pa.string()), decoded_sha256=pa.array(z, pa.string()))
        return batches_of(one)(batches)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
