"""BPE encoding and decoding by prefix-sharing trie traversal.

Of a text's symbols, one token alone can end the encoding of each prefix, so the
encoding of a prefix is fully told by its last token and that of the shorter prefix
before it. The distinct words of a batch are inserted in a trie; a depth-first walk
hands each node's last-token state down, so a prefix that many words share is
encoded once. Which token ends a prefix is decided by whether it can stand beside
the last token of what precedes it: whether no merge across the border would have
come first.

The vocabulary file is that of a word-end BPE: texts are composed (NFC), lower-cased
and split into words, a word's UTF-8 bytes are symbols, and its last one carries a
word-end mark. Special strings in a text are their own tokens.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from meridia.llm.common import documents

#: Words that a Python worker remembers, and bytes of text that it looks at together.
REMEMBERED, TOGETHER = 200_000, 2 << 20
#: Pairs of tokens whose standing side by side is remembered.
PAIRS = 2_000_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in vocabularies of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class State:
    """A state of the automaton that tells which tokens end at a byte."""

    __slots__ = ("held", "after", "inner", "final")

    def __init__(self, held: bytes, inner: tuple, final: tuple) -> None:
        self.held = held
        self.after: dict[int, State] = {}
        #: (size, token, {token before it: whether the two can stand side by side}), longest first.
        self.inner, self.final = inner, final


#: Bytes of words that are compared at once.
WIDTH = 24


def trie(words: Iterable[str]) -> Iterator[tuple[str, bytes, int]]:
    """The prefix trie of distinct words in depth-first order: each word, its bytes, and how many of them it shares with the word before, that is the depth of the node where its own path begins."""
    texts = sorted(words)
    raw = [w.encode() for w in texts]
    head = np.array(raw, f"S{WIDTH}").reshape(-1, 1).view(np.uint8).reshape(-1, WIDTH)
    depth = np.zeros(len(raw), np.int64)
    apart = head[1:] != head[:-1]
    depth[1:] = np.where(apart.any(axis=1), apart.argmax(axis=1), WIDTH)
    size = np.array([len(r) for r in raw], np.int64)
    np.minimum(depth[1:], np.minimum(size[1:], size[:-1]), out=depth[1:])
    for i in (np.flatnonzero(depth >= WIDTH)).tolist():
        depth[i] = shared(raw[i - 1], raw[i])
    return zip(texts, raw, depth.tolist(), strict=True)


def shared(a: bytes, b: bytes) -> int:
    """The length of what two byte strings begin with together."""
    n, step, most = 0, 1 << 12, min(len(a), len(b))
    while step:
        while n + step <= most and a[n : n + step] == b[n : n + step]:
            n += step
        step >>= 4
    return n


class WordBPE:
    """A word-end BPE read from the JSON text of its vocabulary file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens: dict[int, str] = {i: t for t, i in self.ids.items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.symbols = {chr(b): s for b, s in byte_symbols().items()}
        self.symbols = str.maketrans(self.symbols)
        # Each pair's rank; each token's rank and its two parts; its bytes and whether it ends a word.
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        plain = {s: bytes([b]) for b, s in byte_symbols().items()}
        self.raw = {self.ids[t]: (r, last) for s, r in plain.items() for t, last in ((s, False), (s + self.end, True)) if t in self.ids}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole, a, b = self.ids[a + b], self.ids[a], self.ids[b]
            self.rank[a, b] = r
            if whole not in self.born:
                self.born[whole], self.parts[whole] = r, (a, b)
                self.raw[whole] = self.raw[a][0] + self.raw[b][0], self.raw[b][1]
        # Tokens whose own bytes are encoded as the token, by their bytes: inside of a word, and at its end.
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for i, (r, last) in self.raw.items():
            if self._reached(i):
                (self.final if last else self.inner)[r] = i
        self.begun = {r[:n] for r, _ in self.raw.values() for n in range(len(r) + 1)}
        self.beside: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.seen: dict[bytes, State] = {}
        self.start = self._state(b"")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _reached(self, token: int) -> bool:
        """Whether the token's own string is encoded as the token."""
        return token not in self.parts or self._border(*self.parts[token], self.born[token])

    def _border(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether no merge across the border of a and b comes before the given rank.

        The pieces that touch the border are the right parts of a and the left parts
        of b; a piece is there from its own rank until that of the piece it goes into.
        """
        a_ends = b_ends = before
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < a_ends and (r <= b_ends if b_ends < before else r < b_ends):
                return False
            a_born, b_born = self.born.get(a, -1), self.born.get(b, -1)
            if a_born < 0 and b_born < 0:
                return True
            if a_born > b_born:
                a_ends, a = a_born, self.parts[a][1]
            else:
                b_ends, b = b_born, self.parts[b][0]

    def _can_stand(self, a: int, b: int) -> bool:
        if self.pairs >= PAIRS:
            self.pairs = 0
            for allowed in self.beside.values():
                allowed.clear()
        self.pairs += 1
        got = self.beside[b][a] = self._border(a, b)
        return got

    def _state(self, held: bytes) -> State:
        """The automaton's state whose longest held end of what was read is the given beginning of a token."""
        if held not in self.seen:
            ends = lambda of: tuple((n, of[held[-n:]], self.beside.setdefault(of[held[-n:]], {})) for n in range(len(held), 0, -1) if held[-n:] in of)
            self.seen[held] = State(held, ends(self.inner), ends(self.final))
        return self.seen[held]

    def _next(self, state: State, symbol: int) -> State:
        """The state after one more byte: the longest end of what was read that begins a token."""
        held = state.held + bytes([symbol])
        while held not in self.begun:
            held = held[1:]
        got = state.after[symbol] = self._state(held)
        return got

    def _last(self, ends: tuple, tokens: list[int]) -> tuple[int, int]:
        """Size and number of the last token of a prefix: of the tokens that end it the longest that can stand beside what precedes it."""
        depth = len(tokens)
        for size, token, allowed in ends:
            if size > depth:
                return size, token
            got = allowed.get(tokens[-size])
            if got or (got is None and self._can_stand(tokens[-size], token)):
                return size, token
        raise ValueError("the vocabulary lacks a symbol")

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids, as little-endian 32-bit integers, of each distinct word."""
        out: dict[str, bytes] = {}
        # By depth: the last token of the prefix, its size, and the automaton's state behind it.
        tokens: list[int] = []
        sizes: list[int] = []
        states = [self.start]
        last = self._last
        for text, word, depth in trie(words):
            del tokens[depth:], sizes[depth:], states[depth + 1 :]
            state = states[-1]
            for symbol in word[len(tokens) : -1]:
                state = state.after.get(symbol) or self._next(state, symbol)
                size, token = last(state.inner, tokens)
                tokens.append(token)
                sizes.append(size)
                states.append(state)
            state = state.after.get(word[-1]) or self._next(state, word[-1])
            size, token = last(state.final, tokens)
            ids, at = [token], len(word) - size
            while at:
                ids.append(tokens[at - 1])
                at -= sizes[at - 1]
            ids.reverse()
            out[text] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def split(self, text: str) -> list[str]:
        """Words of a text; special strings stand as they are."""
        if self.specials is not None and self.specials.search(text):
            out = []
            for i, part in enumerate(self.specials.split(text)):
                out += [part] if i % 2 else self._words(part)
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        return self.words.findall(text.replace("Σ", "σ").lower())  # no final sigma

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        split = [self.split(t) for t in texts]
        words = {w for ws in split for w in ws}.difference(self.known)
        if len(self.known) + len(words) > REMEMBERED:  # words not met since the last time are forgotten
            self.older, self.known = self.known, {}
            words = {w for ws in split for w in ws}
        again = words.intersection(self.older)
        self.known |= {w: self.older[w] for w in again}
        self.known |= self.encode_words(words.difference(again, self.special))
        self.known |= {t: struct.pack("<I", i) for t, i in self.special.items()}
        get = self.known.__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings, parted by blanks, as the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(text: str) -> WordBPE:
    return WordBPE(text)


def _encoder(shared, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(shared.value)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            start = 0
            while start < len(texts):
                part, size = [], 0
                while start + len(part) < len(texts) and (not part or size < TOGETHER):
                    part.append(texts[start + len(part)].as_py())
                    size += len(part[-1])
                codes = model.encode(part)
                back = [model.decode(c).encode() for c in codes]
                cols = [
                    ids.slice(start, len(part)),
                    pa.array([len(c) // 4 for c in codes], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in codes]),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    cols += [pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in codes], pa.list_(pa.int32())), pa.array([b.decode() for b in back])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)
                start += len(part)

    return run


def word_file() -> str:
    """The public word-end BPE file of this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with keep also ids and decoded.

    `path` is a vocabulary file that the driver can read; its text, of bounded size,
    is sent to the executors. Null and empty texts have no tokens. Rows that repeat
    a doc_id are encoded each, a null doc_id stays null, other columns aren't looked
    at, an empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    with open(path or word_file(), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return documents(docs, id_col, text_col).mapInArrow(_encoder(shared, keep), schema)
