"""Byte-level BPE ids of whole texts, by cached pieces.

The pre-split pattern of the byte-level vocabularies never joins text across the border
between a run of non-space and the white space after it. So a text may be cut there and
each piece encoded alone; pieces repeat, and their ids are kept in a bounded cache.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ._common import workers_threads

#: Pieces whose ids a worker keeps; beyond that the cache starts anew.
CACHE_PIECES = 600_000
#: Longer pieces aren't kept.
CACHE_CHARS = 64

PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python counts these as white space, the tokenizers' pattern doesn't.
_ODD = re.compile("[\x1c-\x1f]")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a vocabulary file; a path is returned as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Ids of pieces, as int32 bytes, kept up to a bound."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.asarray(self.encode(piece), "<i4").tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class PieceEncoder:
    """Ids as the tokenizers library gives them with add_special_tokens=False, as little-endian int32 bytes."""

    def __init__(self, path: str):
        workers_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ordinary = self._ordinary(path)
        self.pieces = _Pieces(self.ordinary)

    def _ordinary(self, path: str):
        """A faster encoder of one piece, by the same ranks; the library's own where there is none."""
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        try:
            import public_tokenizers
            import tiktoken
        except ImportError:
            return None
        back = {c: b for b, c in byte_chars().items()}
        vocab = spec["model"]["vocab"]
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in added}
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            return None
        return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes()

    def cuts(self, text: str) -> bool:
        """Whether a text may be cut into pieces."""
        return not (self.ordinary is None or _ODD.search(text) or any(s in text for s in self.special))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuts(text):
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, PIECE.findall(text)))


def byte_chars() -> dict[int, str]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(4)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def ids_column(rows: list[bytes]) -> pa.ListArray:
    """int32 byte strings as a column of lists."""
    offsets = np.zeros(len(rows) + 1, "<i4")
    np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def id_buffers(column: pa.Array) -> Iterator[memoryview]:
    """The ids of each row of a list column, as little-endian 32-bit bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    values = memoryview(np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield values[4 * a : 4 * b]


def crc32(ids: bytes | memoryview) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids) & 0xFFFFFFFF


def texts(column: pa.Array) -> Iterable[str | None]:
    return column.to_pylist()
