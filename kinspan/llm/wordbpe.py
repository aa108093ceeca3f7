"""Exact ids of a lower-casing word BPE (a tokenizers .json file), one white-space chunk at a time.

White space never lies inside a pre-token, and neither normalisation nor an added token reaches across it, so
the ids of a text are those of its chunks in turn. A chunk falls into pre-tokens: of plain letters, digits and marks
by the pattern, of any other script by the library's own normaliser and splitter. Pre-tokens go to a rank-ordered
byte-pair merger in which a closing byte stands for the end of a word. Only chunks that hold the string of an added
token go to the library as a whole.
"""

from __future__ import annotations

import json
from array import array

import regex
import tiktoken
from tokenizers import Tokenizer

from kinspan.llm import _docs

#: Never part of UTF-8: ends a word; marks a chunk that only the library may encode.
END, RAW = b"\xff", b"\xfe"
SUFFIX = "</w>"
#: Marks that close a word; together they are one pre-token.
_CLOSING = b".,;:!?"
#: Characters that neither composition nor a rare case mapping touches.
_PLAIN = regex.compile(r"[!-~¡-įı-ňŊ-ž]+")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


class WordBPE:
    """pre_tokens(chunk) are keys; ids(key) are its vocabulary ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.bytes_of = {ord(c): chr(b) for c, b in letters.items()}

        def raw(token: str) -> bytes:
            body = token.removesuffix(SUFFIX)
            return bytes(letters[c] for c in body) + (END if body != token else b"")

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + END: 256 + b for b in range(256)}
        for merge in spec["model"]["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            ranks.setdefault(raw(left) + raw(right), len(ranks))
        self.id_of = [0] * len(ranks)
        for token, number in vocab.items():
            if (rank := ranks.get(raw(token))) is not None:
                self.id_of[rank] = number
        merger = tiktoken.Encoding("merger", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.merge = merger._core_bpe.encode_single_piece

    def pre_tokens(self, chunk: bytes) -> tuple[bytes, ...]:
        """The chunk's pre-tokens, normalised; or the chunk itself, marked, where only the library is exact."""
        if chunk.isalpha():
            return (chunk.lower(),)
        if any(a in chunk for a in self.added):
            return (RAW + chunk,)
        text = chunk.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text):
            return tuple(p.encode() for p in self.pattern.findall(text.lower()))
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return tuple(piece.translate(self.bytes_of).encode("latin-1") for piece, _ in pieces)

    def ids(self, key: bytes) -> list[int]:
        if key[:1] == RAW:
            return self.library.encode(key[1:].decode("utf-8", "replace"), add_special_tokens=False).ids
        return [self.id_of[r] for r in self.merge(key + END)]

    def chunk_ids(self, chunk: bytes, known: dict[bytes, bytes] | None = None) -> bytes:
        """The ids of a white-space chunk as unsigned 32-bit integers. known: such ids by chunk, made if missing."""
        if known is not None:
            stem = chunk.rstrip(_CLOSING)
            if stem.isalpha():  # then the closing marks are a pre-token of their own, and case doesn't count
                low = stem.lower()
                if low != chunk:
                    return known[low] + known[chunk[len(stem) :]] if len(stem) < len(chunk) else known[low]
        return array("I", [i for key in self.pre_tokens(chunk) for i in self.ids(key)]).tobytes()


_loaded: dict[str, WordBPE] = {}


def load(path: str) -> WordBPE:
    """One copy for each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def ids_by_chunk(path: str) -> _docs.Cache:
    """`chunk_ids` of each chunk; those of words serve for their capitals and closing marks too."""
    model = load(path)
    cache = _docs.Cache(lambda chunk: model.chunk_ids(chunk, cache), 80 << 20)
    return cache
