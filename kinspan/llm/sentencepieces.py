"""SentencePiece encoding and decoding that keep each piece's place in the original bytes.

Normalising goes through the model's compiled character map, a double-array trie: at each place where a known prefix
can start the longest one is replaced, what lies between stays, and every normalised byte keeps the original offset it
came from. The normalised text falls into segments, each a run of space marks with what follows it. No piece has a
space mark after another character, so no merge crosses a segment's start: each distinct segment is encoded once by the
library (with an identity normaliser) and kept. Pieces are projected through the alignment to spans of the original
bytes; decoding joins the pieces' surfaces.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from kinspan.llm import _docs

MARK = "▁"
_MARK = MARK.encode()
#: Starts the key of a segment that is more than a mark and what follows it; never part of UTF-8.
OWN = b"\xff"
#: Bytes of segments that a worker keeps, and of one that is kept.
KEPT, LONGEST = 64 << 20, 256
_SEGMENTS = re.compile("▁*[^▁]+|▁+")
SCHEMA = "doc_id long, n_tokens long, ids string, span_ends binary, decoded string"


class CharacterMap:
    """A compiled character map: sizes, double-array trie, replacements ended by NUL."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = array("I", blob[4 : 4 + size])
        self.replacements = blob[4 + size :]
        firsts = [b for b in range(256) if self._known(b)]
        self._start = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in firsts) + b"]") if firsts else None

    def _known(self, first: int) -> bool:
        """Whether a known prefix can start with this byte."""
        if not self.units:
            return False
        at = (self.units[0] >> 10 << ((self.units[0] & 512) >> 6)) ^ first
        return at < len(self.units) and self.units[at] & 0x800000FF == first

    def hits(self, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Place, length and replacement of each longest known prefix, from the left."""
        done = 0
        for m in self._start.finditer(text) if self._start else ():
            if m.start() >= done and (hit := self.longest(text, m.start())) is not None:
                done = m.start() + hit[1]
                yield m.start(), hit[1], hit[0]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """What replaces the longest known prefix of text[at:], and that prefix's length."""
        if not self.units:
            return None
        unit, found = self.units[0], None
        node = unit >> 10 << ((unit & 512) >> 6)
        for end in range(at, len(text)):
            node ^= text[end]
            unit = self.units[node]
            if unit & 0x800000FF != text[end]:
                break
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit & 256:
                found = self.units[node] & 0x7FFFFFFF, end + 1 - at
        if found is None:
            return None
        start, length = found
        return self.replacements[start : self.replacements.index(0, start)], length


class Encoder:
    def __init__(self, path: str):
        proto = model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with space as a suffix aren't supported")
        if any(p.type == p.USER_DEFINED for p in proto.pieces):
            raise ValueError("models with user-defined pieces aren't supported")
        #: Whether segments can be encoded each on its own.
        self.apart = proto.trainer_spec.model_type == proto.trainer_spec.BPE and not any(
            MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type == p.NORMAL
        )
        unknown = proto.trainer_spec.unk_surface.encode()
        self.sizes: list[int] = []  # of a piece in normalised bytes; 0: as long as its surface
        self.surfaces: list[bytes] = []
        for p in proto.pieces:
            raw = bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.encode()
            kind = {p.UNKNOWN: unknown, p.CONTROL: b""}.get(p.type, raw.replace(_MARK, b" "))
            self.sizes.append(0 if p.type in (p.UNKNOWN, p.CONTROL) else len(raw))
            self.surfaces.append(kind)
        spec.precompiled_charsmap = b""
        spec.name = "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.kept: dict[bytes, tuple] = {}
        self.held = 0

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the original offset."""
        parts, origins, fixed, done, size = [], [], [], 0, 0

        def put(part: bytes, origin: np.ndarray) -> None:
            nonlocal size
            parts.append(part)
            origins.append(origin)
            size += len(part)

        for at, length, new in self.map.hits(text):
            if new == text[at : at + length]:
                continue  # each byte keeps its own place
            put(text[done:at], np.arange(done, at))
            fixed.append((size + len(new) - len(new.lstrip(b" ")), size + len(new)))
            put(new, np.full(len(new), at))
            done = at + length
        put(text[done:], np.arange(done, len(text)))
        raw, origin, end = b"".join(parts), np.concatenate(origins), len(text)
        if self.squeeze:
            space = np.frombuffer(raw, np.uint8) == 32
            gone = space & np.concatenate([[True], space[:-1]])
            for start, stop in fixed:  # spaces inside a replacement stay
                gone[start:stop] = False
            kept = ~gone
            if len(last := np.flatnonzero(kept & space)) and last[-1] == np.flatnonzero(kept)[-1]:
                end = int(origin[last[-1]])
                kept[last[-1]] = False
            raw, origin = np.frombuffer(raw, np.uint8)[kept].tobytes(), origin[kept]
        if not raw:
            return b"", np.array([end])
        mark = _MARK if self.escape else b" "
        if self.escape:
            origin = np.repeat(origin, np.where(np.frombuffer(raw, np.uint8) == 32, len(mark), 1))
            raw = raw.replace(b" ", mark)
        before = len(mark) if self.dummy else 0
        return mark * self.dummy + raw, np.concatenate([np.full(before, origin[0]), origin, [end]])

    def segments(self, normal: bytes) -> list[bytes]:
        """Keys: what follows a segment's one mark; OWN and the segment where that isn't what starts it."""
        if not normal:
            return []
        if not self.apart:
            return [OWN + normal]
        if normal.startswith(_MARK) and _MARK + _MARK not in normal:
            return normal.split(_MARK)[1:]
        return [
            s[1:].encode() if s[0] == MARK and s[1:2] != MARK else OWN + s.encode()
            for s in _SEGMENTS.findall(normal.decode("utf-8", "replace"))
        ]

    def _value(self, segment: str, ids: list[int]) -> tuple[bytes, bytes, bytes]:
        """Ids joined by commas, sizes of the pieces in normalised bytes, their surfaces."""
        sizes = [self.sizes[i] for i in ids]
        if 0 in sizes:
            sizes = [len(p.surface.encode()) for p in self.library.encode(segment, return_type="proto").pieces]
        return ",".join(map(str, ids)).encode(), array("I", sizes).tobytes(), b"".join(self.surfaces[i] for i in ids)

    def values(self, keys: set[bytes]) -> dict[bytes, tuple]:
        """What `_value` gives for each segment, by key; those up to LONGEST bytes are kept, as far as they fit."""
        missing = [k for k in keys if k not in self.kept]
        if missing and self.held > KEPT:
            self.kept, self.held, missing = {}, 0, list(keys)
        if not missing:
            return self.kept
        texts = [(k[1:] if k[:1] == OWN else _MARK + k).decode("utf-8", "replace") for k in missing]
        long = {}
        for key, text, ids in zip(missing, texts, self.library.encode(texts, num_threads=1)):
            value = self._value(text, ids)
            if len(key) > LONGEST:
                long[key] = value
            else:
                self.kept[key] = value
                self.held += 250 + len(key) + sum(map(len, value))
        return ChainMap(long, self.kept) if long else self.kept

    def decode(self, joined: bytes) -> bytes:
        """Text of the pieces' surfaces."""
        if (self.dummy or self.squeeze) and joined[:1] == b" ":
            joined = joined[1:]
        return joined.decode("utf-8", "replace").encode()

    def rows(self, texts: list[bytes]) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """(n_tokens, ids joined by commas, span ends as unsigned 32-bit integers, decoded text) of each text."""
        normal = [self.normalise(text) for text in texts]
        every = [self.segments(text) for text, _ in normal]
        known = self.values(set().union(*every))
        for (_, origin), keys in zip(normal, every):
            parts = [known[k] for k in keys]
            sizes = np.frombuffer(b"".join([p[1] for p in parts]), "<u4")
            ends = origin[np.cumsum(sizes, dtype=np.int64)]
            yield len(sizes), b",".join([p[0] for p in parts if p[0]]), ends.astype("<u4").tobytes(), self.decode(b"".join([p[2] for p in parts]))


_loaded: dict[str, Encoder] = {}


def load(path: str) -> Encoder:
    """One copy for each Python worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Encode each text of `docs` (doc_id, text) and decode its ids again.

    model: path of the .model file, present on every executor. Gives doc_id, n_tokens, ids (decimal, joined by
    commas), span_ends (for each piece the end of its span in the text's UTF-8 bytes, as unsigned 32-bit
    little-endian integers; spans follow one another) and decoded (what the ids decode to).

    Null and empty texts have no ids. Rows with equal or null doc_id are encoded each on its own. An empty table
    gives no rows. Further columns are not read.
    """

    def make():
        encoder = load(model)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts, doc_ids = _docs.utf8(batch.column(1)), batch.column(0)
            start, size = 0, 0
            for stop in range(1, len(texts) + 1):
                size += len(texts[stop - 1])
                if size < 1 << 20 and stop < len(texts):
                    continue
                n, ids, ends, decoded = zip(*encoder.rows(texts[start:stop]))
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(start, stop - start),
                        pa.array(n, pa.int64()),
                        pa.array(ids, pa.binary()).cast(pa.string()),
                        pa.array(ends, pa.binary()),
                        pa.array(decoded, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "span_ends", "decoded"],
                )
                start, size = stop, 0

        return each

    return _docs.map_batches(_docs.texts(docs), make, SCHEMA)
