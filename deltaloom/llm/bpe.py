"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over tokens. It
starts as one state with a loop for each base symbol. The gadget of a merge (u, v) -> w
takes the state p that u leads to; where p has an arc v, p is copied without that arc,
u is led to the copy, and each state with an arc u gets an arc w to where v leads. All arcs
of a token lead to one state, so a state is kept as (what it was copied from, the arc it
lost, when it was made) and an arc is looked up along that chain; a token's copies follow
each other, so one search by time passes all of them. Looked-up arcs are kept
in a transition table. A word's tokenization is the only path whose labels spell it, and
so is each prefix's: the encoder goes over the word once and keeps, for each position, the
one token by which the automaton gets there. Decoding emits the labels of the arcs.

Results for edge cases: a null or empty text has no ids and decodes to an empty string; a
special token's text inside a text is that token; repeated documents get the same ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pick, spread, table, tune, workers_threads
from .tokens import byte_chars, ids_column, texts, vocabulary

#: Text chunks whose ids a worker keeps; beyond that the cache starts anew.
CACHE_CHUNKS = 500_000
CACHE_WORDS = 300_000
CACHE_CHARS = 64
#: Looked-up arcs that a worker keeps.
CACHE_ARCS = 2_000_000
#: Characters below this have no canonical compositions, and lower case one by one.
_PLAIN_BELOW = 0x130


#: The normalizer and pre-tokenizer of the word vocabulary, for which there is a faster way.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _plain_split() -> re.Pattern:
    """The word vocabulary's pre-split pattern, for characters below _PLAIN_BELOW."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for c in map(chr, range(_PLAIN_BELOW)):
        kinds.setdefault(unicodedata.category(c)[0], []).append(re.escape(c))
    letters, numbers = "".join(kinds["L"]), "".join(kinds["N"])
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t-\r \x85\xa0{letters}{numbers}]+")


class _Chain:
    """The copies made for one token, each of the one before; the first is a copy of ``parent``."""

    def __init__(self, owner: int, parent: int):
        self.owner, self.parent = owner, parent
        self.states: list[int] = []
        self.born: list[int] = []
        self.lost: dict[int, int] = {}  # the place of the copy that lost a token's arc


class MergeAutomaton:
    """The deterministic automaton of ordered merges over integer tokens."""

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]], size: int):
        never = len(merges) + 1
        self.left, self.time = [0] * size, [never] * size
        self.target = [-1] * size
        self.chain, self.place = [-1], [0]
        self.chains: list[_Chain] = []
        for t in base:
            self.time[t] = 0
            self.target[t] = 0
        for now, (u, v, w) in enumerate(merges, 1):
            self._gadget(u, v, w, now)
        self.never = never
        self.arcs: dict[int, bool] = {}

    def _gadget(self, u: int, v: int, w: int, now: int) -> None:
        p = self.target[u]
        if p < 0 or self.target[v] < 0 or not self.has_arc(p, v):
            return
        self.left[w], self.time[w] = u, now
        self.target[w] = self.target[v]
        state, c = len(self.chain), self.chain[p]
        if not p or self.chains[c].owner != u:
            c = len(self.chains)
            self.chains.append(_Chain(u, p))
        own = self.chains[c]
        self.chain.append(c)
        self.place.append(len(own.states))
        own.lost[v] = len(own.states)
        own.states.append(state)
        own.born.append(now)
        self.target[u] = state

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc for ``token``: the younger of the two is traced back, a chain at a time, until it is settled."""
        while state:
            own, place = self.chains[self.chain[state]], self.place[state]
            lost = own.lost.get(token)
            if lost is not None and lost <= place:
                return False
            before = bisect_right(own.born, self.time[token], 0, place + 1)
            if before:
                state, token = own.states[before - 1], self.left[token]
            else:
                state = own.parent
        return True

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before``, by the transition table."""
        key = before << 20 | token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= CACHE_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self.has_arc(self.target[before], token)
        return known

    def alive(self, token: int) -> bool:
        return self.target[token] >= 0


class _Chunks(dict):
    """Ids of chunks of UTF-8 text, as int32 bytes, kept up to a bound."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.encode(chunk.decode())
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


class Lengths(dict):
    """How many ids a word or piece has, kept up to a bound."""

    def __init__(self, count: Callable[[str | bytes], int]):
        self.count = count

    def __missing__(self, piece: str | bytes) -> int:
        n = self.count(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[piece] = n
        return n


class BpeCoder:
    """Encodes and decodes as the vocabulary file says (word-end BPE over byte characters)."""

    def __init__(self, path: str):
        workers_threads()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or spec.get("post_processor") or spec.get("decoder"):
            raise ValueError("this vocabulary's kind isn't supported")
        self.end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.labels = [""] * size
        for t, i in [*vocab.items(), *self.specials.items()]:
            self.labels[i] = t
        merges = []
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            merges.append((vocab[a], vocab[b], vocab[a + b]))
        made = {w for _, _, w in merges}
        self.automaton = MergeAutomaton([i for t, i in vocab.items() if i not in made], merges, size)
        end = self.end
        live = {t: i for t, i in vocab.items() if self.automaton.alive(i)}
        self.final = {t[: len(t) - len(end)]: i for t, i in live.items() if t.endswith(end)} if end else live
        self.inner = {t: i for t, i in live.items() if not t.endswith(end)} if end else live
        self.longest = max(map(len, live))
        self.split_specials = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str if library.normalizer else lambda s: s
        self.pre_split = library.pre_tokenizer.pre_tokenize_str
        self.plain = _plain_split() if spec.get("pre_tokenizer") == WORD_PRE_TOKENIZER and spec.get("normalizer") == WORD_NORMALIZER else None
        self.bytes_as = [c for _, c in sorted(byte_chars().items())]
        self.above = re.compile(f"[^\x00-{chr(_PLAIN_BELOW - 1)}]")
        self.chunks = _Chunks(self._chunk)
        self.words: dict[str, bytes] = {}
        self.lengths = Lengths(lambda word: len(self._plain_ids(word)) // 4)
        self.chunk_lengths = Lengths(self._chunk_count)

    def word(self, word: str) -> bytes:
        """Ids, as int32 bytes, of a pre-split word of byte characters: one pass, one token kept for each position."""
        n, longest, inner = len(word), self.longest, self.inner
        arcs, follows = self.automaton.arcs, self.automaton.follows
        by, at = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            labels = inner if i < n else self.final
            for j in range(i - longest if i > longest else 0, i):
                if (label := word[j:i]) in labels:
                    t = labels[label]
                    if j == 0 or ((before := by[j]) >= 0 and ((known := arcs.get(before << 20 | t)) or known is None and follows(before, t))):
                        by[i], at[i] = t, j
                        break
        if by[n] < 0:
            raise ValueError(f"no path for {word!r}")
        ids = []
        i = n
        while i:
            ids.append(by[i])
            i = at[i]
        ids.reverse()
        return array("i", ids).tobytes()

    def _words(self, text: str) -> bytes:
        if self.plain is None or self.above.search(text):
            return b"".join([self.word(word) for word, _ in self.pre_split(self.normalize(text))])
        found = self.plain.findall(text.lower())
        known, word = self.words, self._plain_word
        return b"".join([known.get(w) or word(w) for w in found])

    def _plain_ids(self, word: str) -> bytes:
        return self.word(word if word.isascii() and word.isalnum() else "".join([self.bytes_as[b] for b in word.encode()]))

    def _plain_word(self, word: str) -> bytes:
        ids = self._plain_ids(word)
        if len(word) <= CACHE_CHARS:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if not self.split_specials or "<" not in chunk:
            return self._words(chunk)
        parts = self.split_specials.split(chunk)
        return b"".join([array("i", [self.specials[p]]).tobytes() if p in self.specials else self._words(p) for p in parts])

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian int32 bytes; text is cut at ASCII white space, other is left to the pre-splitter."""
        return b"".join(map(self.chunks.__getitem__, text.encode().split())) if text else b""

    def _chunk_count(self, chunk: bytes) -> int:
        text = chunk.decode()
        if self.plain is None or self.split_specials and "<" in text or self.above.search(text):
            return len(self._chunk(text)) // 4
        return sum(map(self.lengths.__getitem__, self.plain.findall(text.lower())))

    def count(self, text: str | None) -> int:
        """How many ids a text has, by lengths of its chunks and words."""
        return sum(map(self.chunk_lengths.__getitem__, text.encode().split())) if text else 0

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels, joined as the library joins them where the file names no decoder."""
        return " ".join(self.labels[i] for i in ids)


@lru_cache(2)
def coder(path: str) -> BpeCoder:
    return BpeCoder(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row; no shuffle, a task keeps one Arrow batch."""
    docs = spread(pick(docs, doc_id=id_col, text=text_col))
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path).encode_bytes
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), ids_column([encode(t) for t in texts(b.column(1))])], ["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded string) for each row of (doc_id, ids)."""
    encoded = encoded.select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(coder(path).labels)
        for b in batches:
            ids = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            words = pa.LargeListArray.from_arrays(pc.cast(ids.offsets, pa.int64()), labels.take(ids.values))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pc.binary_join(words, " ").cast(pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: its count of ids and digests of ids and text."""
    path = vocabulary("word_bpe_49k.json")
    done = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), path), path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
