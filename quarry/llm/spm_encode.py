"""SentencePiece encoding that keeps the place of every piece in the original text.

The model file's compiled character map (a double-array trie over UTF-8, then replacement
strings) is walked here: at each position the longest matching prefix is replaced, and
every normalised byte records the offset of the original text it came from. Pieces are
then cut by the library from the normalised text, and their byte spans projected back.

The library encodes only segments (a run of white-space marks and what follows up to the
next): no piece of the vocabulary holds a mark after another character, so merges never
cross segments and a segment's pieces do not depend on its neighbours. That property is
checked when the model is loaded; without it whole texts are encoded.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, map_arrow, utf8_list

MARK = "▁"
_MARK = MARK.encode()
# Segments that a worker remembers with their ids.
REMEMBERED = 250_000


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, buf[at:at + size]
            at += size


class CharacterMap:
    """The compiled character map: longest-prefix replacement in UTF-8 text."""

    def __init__(self, compiled: bytes):
        self.empty = len(compiled) < 4
        if not self.empty:
            size = struct.unpack("<I", compiled[:4])[0]
            self._units = np.frombuffer(compiled[4:4 + size], "<u4").tolist()
            self._replacements = compiled[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes it replaces) of the longest entry that ``text`` has at ``at``."""
        if self.empty:
            return None
        units, found = self._units, None
        node = units[0]
        place = (node >> 10) << ((node & 512) >> 6)
        for k in range(at, len(text)):
            place ^= text[k]
            if place >= len(units):
                break
            node = units[place]
            if node & 0x800000FF != text[k]:
                break
            place ^= (node >> 10) << ((node & 512) >> 6)
            if node >> 8 & 1:
                found = units[place] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        end = self._replacements.index(b"\0", found[0])
        return self._replacements[found[0]:end], found[1]


class OffsetEncoder:
    """Normalise with alignment, encode, and project each piece to its original bytes."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        spec = {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}
        suffix, kinds = 0, []
        for number, value in _fields(model):
            if number == 3:
                spec |= dict(_fields(value))
            elif number == 2:
                suffix = dict(_fields(value)).get(24, 0)
            elif number == 1:
                kinds.append(dict(_fields(value)).get(3, 1))
        if 4 in kinds or suffix or not spec[5]:
            raise ValueError("models with user-defined symbols, white-space suffixes or raw spaces are not supported")
        self.map = CharacterMap(spec[2])
        self.dummy_prefix, self.squeeze = bool(spec[3]), bool(spec[4])
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = b"\x0a\x08identity\x12\x00\x18\x00\x20\x00"  # normalizer: identity, no map, no prefix, no squeezing
        self._cutter = sentencepiece.SentencePieceProcessor()
        self._cutter.LoadFromSerializedProto(model + b"\x1a" + bytes([len(plain)]) + plain)
        pieces = [self.library.id_to_piece(k) for k in range(len(kinds))]
        self.end_id = self.library.eos_id()
        self.size = np.array([1 if kind == 6 else len(p.encode()) for p, kind in zip(pieces, kinds)], np.int64)
        self._unknown = self.library.unk_id() if 6 not in kinds else None
        if any(MARK in p.lstrip(MARK) for p in pieces) or self._unknown is not None:
            self._segments = None
        else:
            line = "" if any("\n" in p for p in pieces) else "\n"
            self._segments = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+|\n").findall
        self._known: dict[str, tuple[tuple[int, ...], str]] = {}

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised text, for each of its bytes and its end the original offset)."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.map.empty and not self.squeeze:
            raw = np.frombuffer(text, np.uint8)
            place = np.arange(len(raw))
            char = np.maximum.accumulate(np.where((raw & 0xC0) != 0x80, place, 0))
            source = np.repeat(char, np.where(raw == 32, len(_MARK), 1))
            head = _MARK if self.dummy_prefix else b""
            return head + text.replace(b" ", _MARK), np.concatenate([np.zeros(len(head), np.int64), source, [len(raw)]])
        out, source, at, after_space = [], [], 0, self.squeeze
        prefix = self.dummy_prefix
        while at < len(text):
            hit = self.map.longest(text, at)
            if hit is None:
                lead = text[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = text[at:at + n], n
            new, n = hit
            if after_space:
                new = new.lstrip(b" ")
            if new:
                if prefix:
                    out.append(_MARK)
                    source += [at] * len(_MARK)
                    prefix = False
                shown = new.replace(b" ", _MARK)
                out.append(shown)
                source += [at] * len(shown)
            if self.squeeze:
                after_space = new.endswith(b" ") if new else after_space
            at += n
        done, end = b"".join(out), len(text)
        if self.squeeze:
            while done.endswith(_MARK):
                done = done[:-len(_MARK)]
                end = source[len(done)]
                del source[len(done):]
        return done, np.array([*source, end], np.int64)

    def _segment(self, segment: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(self._cutter.encode(segment))
        value = ids, " ".join(map(str, ids))
        if len(self._known) < REMEMBERED:
            self._known[segment] = value
        return value

    def encode(self, text: bytes) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        """(ids, the same as decimals joined by spaces, first byte and end of each piece); no end id."""
        normal, source = self.normalise(text)
        shown = normal.decode()
        known = self._known.get
        if self._segments is None:
            ids = self._cutter.encode(shown)
            decimal = " ".join(map(str, ids))
        else:
            parts = [known(s) or self._segment(s) for s in self._segments(shown)]
            ids = [k for part, _ in parts for k in part]
            decimal = " ".join([d for _, d in parts])
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.size[np.fromiter(ids, np.int64, len(ids))], out=at[1:])
        if self._unknown is not None and self._unknown in ids:
            at = self._surface_ends(shown, ids)
        if at[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        return ids, decimal, source[at[:-1]], source[at[1:]]

    def _surface_ends(self, shown: str, ids: list[int]) -> np.ndarray:
        surfaces = self._cutter.encode(shown, return_type="proto").pieces
        return np.concatenate([[0], np.cumsum([len(p.surface.encode()) for p in surfaces])])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@functools.cache
def _encoder(path: str) -> OffsetEncoder:
    return OffsetEncoder(path)


def _encoded(batches: Iterable[pa.RecordBatch], path: str, outputs: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    tail = str(encoder.end_id)
    for part in byte_slices(batches, "text", 1 << 20):
        cols: dict[str, list] = {c: [] for c in outputs}
        for text in utf8_list(part.column("text")):
            ids, decimal, begin, end = encoder.encode(text)
            ids.append(encoder.end_id)
            row = {"n_tokens": len(ids), "covered_bytes": int((end - begin).sum())}
            if "ids" in cols:
                row["ids"] = np.array(ids, np.int32)
            if "spans" in cols:
                at = np.full((len(ids), 2), len(text), np.int32)
                at[:-1, 0], at[:-1, 1] = begin, end
                row["spans"] = at.ravel()
            if "ids_sha256" in cols:
                row["ids_sha256"] = hashlib.sha256((f"{decimal} {tail}" if decimal else tail).encode()).hexdigest()
            if "decoded" in cols or "decoded_sha256" in cols:
                row["decoded"] = encoder.decode(ids)
                row["decoded_sha256"] = hashlib.sha256(row["decoded"].encode()).hexdigest()
            for c in cols:
                cols[c].append(row[c])
        types = {"n_tokens": pa.int64(), "covered_bytes": pa.int64(), "ids": pa.list_(pa.int32()),
                 "spans": pa.list_(pa.int32())}
        yield pa.RecordBatch.from_arrays(
            [part.column("id"), *[pa.array(cols[c], types.get(c, pa.string())) for c in outputs]], ["id", *outputs])


_TYPES = {"n_tokens": "long", "covered_bytes": "long", "ids": "array<int>", "spans": "array<int>",
          "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                     outputs: tuple[str, ...] = ("ids", "spans", "decoded")) -> DataFrame:
    """One row per input row: (id, *outputs). Null text is empty: its only id is the end id.

    ``ids`` end with the end id; ``spans`` holds begin and end byte of the original text for
    each id in turn (the end id's is empty, at the end); ``decoded`` is the library's text of
    the ids. The digests and counts are of those: ids_sha256, decoded_sha256, n_tokens, and
    covered_bytes (bytes of the original text under the spans).
    """
    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(cols, functools.partial(_encoded, path=model_path, outputs=tuple(outputs)),
                     "id long, " + ", ".join(f"{c} {_TYPES[c]}" for c in outputs))
