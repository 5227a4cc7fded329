"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding. The transducer reads a piece of text byte by byte. Its state is the set of places
where a token may still be open, determinised: the longest open prefix stands for all of
them. A transition tells the next state and which tokens may close at this byte; the seam
table of the merges (see ``merges``) picks the one of them that greedy merging leaves, from
the token before it. A token is put out once all open places agree on it, so the lookahead is
bounded by the longest token. States, transitions and seams are made when first needed. There
are at most as many states as prefixes of tokens; remembered seams are bounded.

Decoding. Bytes of tokens are fed to an incremental UTF-8 machine. It works on whole tokens:
a token's effect on each of the machine's states is computed once.

Text is cut into pieces by the vocabulary's pattern; merging never crosses a piece.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from codeloom.llm.common import arrow_map, file_broadcast, one_model, slices
from codeloom.llm.merges import RankMerges

# Chunks, and pieces, whose ids a task remembers: twice so many at most.
REMEMBERED = 400_000
# Positions that are held before agreed tokens are put out.
_HELD = 4096
_EDGE = re.compile(r"\A\s|\s\Z")


class Transducer:
    """Tokens of byte strings, by transitions that are compiled on first use."""

    def __init__(self, merges: RankMerges) -> None:
        self.merges = merges
        self._rows: dict[bytes, dict] = {b"": {}}  # longest open prefix -> its transitions by byte

    def _compile(self, row: dict, byte: int) -> tuple[dict, list[tuple[int, int]], int, int]:
        """The next row, the tokens that may close but the last, and the last one with its width."""
        ids, starts = self.merges.ids, self.merges.starts
        body = row.get("prefix", b"") + bytes((byte,))
        closing = [(ids[body[i:]], len(body) - i) for i in range(len(body)) if body[i:] in ids]
        prefix = next((body[i:] for i in range(len(body)) if body[i:] in starts), b"")
        after = self._rows.get(prefix)
        if after is None:
            after = self._rows[prefix] = {"prefix": prefix}
        found = row[byte] = (after, closing[:-1], *closing[-1])
        return found

    def encode(self, data: bytes) -> list[int]:
        compatible, seams = self.merges.compatible, self.merges.seams
        row, out = self._rows[b""], []
        last, widths = [-1], [0]  # token and width of the token that ends at each held position
        for here, byte in enumerate(data, 1):
            row, others, token, width = row.get(byte) or self._compile(row, byte)
            if others:  # exactly one token closes, so no test is due for the last
                for other, wide in others:
                    before = last[-wide]
                    if before < 0:
                        token, width = other, wide
                        break
                    stands = seams.get(before << 20 | other)
                    if compatible(before, other) if stands is None else stands:
                        token, width = other, wide
                        break
            last.append(token)
            widths.append(width)
            if not here % _HELD:
                last, widths = self._put_out(row.get("prefix", b""), last, widths, out)
        out += self._path(last, widths, len(last) - 1)
        return out

    @staticmethod
    def _path(last: list[int], widths: list[int], end: int, start: int = 0) -> list[int]:
        tokens = []
        while end > start:
            tokens.append(last[end])
            end -= widths[end]
        tokens.reverse()
        return tokens

    def _put_out(self, prefix: bytes, last: list[int], widths: list[int], out: list[int]) -> tuple[list[int], list[int]]:
        """Put out what all open places agree on; keep the positions after it."""
        end = len(last) - 1
        places = {end}
        places.update(end - len(prefix) + i for i in range(len(prefix)) if prefix[i:] in self.merges.starts)
        while len(places) > 1:  # step the farthest place back until all meet
            far = max(places)
            places.remove(far)
            places.add(far - widths[far])
        meet = places.pop()
        out.extend(self._path(last, widths, meet))
        return last[meet:], [0, *widths[meet + 1 :]]


class Recent(dict):
    """What was found for recent keys: two generations of at most ``size`` entries."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size = size
        self._old: dict = {}

    def __missing__(self, key):
        found = self._old.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self) >= self.size:
            self._old = dict(self)
            self.clear()
        self[key] = value


class Encoder:
    """Token ids of whole texts; ids of pieces and of chunks between single spaces are remembered for a while.

    Ids are remembered as the bytes of 32-bit numbers, so that those of a text are joined in one step.
    """

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        self.merges = RankMerges(vocabulary)
        self.machine = Transducer(self.merges)
        self.pieces = regex.compile(pattern)
        self._of_chunk = Recent(REMEMBERED)  # by the chunk without the space before it
        self._of_piece = Recent(REMEMBERED)

    def _pieces(self, text: str) -> bytes:
        return self._joined(self.pieces.findall(text))

    def _joined(self, pieces: list[str]) -> bytes:
        known, found = self._of_piece, []
        for piece in pieces:
            ids = known[piece]
            if ids is None:
                ids = array("i", self.machine.encode(piece.encode())).tobytes()
                if len(piece) <= 64:
                    known.keep(piece, ids)
            found.append(ids)
        return found[0] if len(found) == 1 else b"".join(found)

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a chunk and the space before it; none where white space at its edge would be extended by a space."""
        ids = self._of_chunk[chunk]
        if ids is None and not _EDGE.search(chunk):
            pieces = self.pieces.findall(" " + chunk)
            if len(pieces) == 1 and len(chunk) < 64:  # remembered as a chunk, so not as a piece too
                ids = array("i", self.machine.encode(pieces[0].encode())).tobytes()
            else:
                ids = self._joined(pieces)
            if len(chunk) < 64:
                self._of_chunk.keep(chunk, ids)
        return ids

    def _bytes(self, text: str) -> bytes:
        """A space between two characters that are not white space always starts a piece; cuts there change nothing."""
        first, *chunks = text.split(" ")
        if not first or not all(chunks) or _EDGE.search(first):
            return self._pieces(text)
        found = list(map(self._of_chunk.__getitem__, chunks))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = ids = self._chunk(chunks[i])
                    if ids is None:  # read the text as a whole
                        return self._pieces(text)
        return self._pieces(first) + b"".join(found)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self._bytes(text), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()


def _encoder(vocabulary: bytes, pattern: str) -> Encoder:
    """One encoder per worker process, so what it remembers serves many tasks."""
    return one_model(Encoder, vocabulary, pattern)


# States of the UTF-8 machine: how many bytes are missing and which first bytes are allowed.
_START, _REJECT = 0, 8
_LEADS = [  # first and last lead byte, state after it
    (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2),
    (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7),
]
_FOLLOW = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}


def utf8_step(state: int, byte: int) -> int:
    if state == _START:
        if byte < 0x80:
            return _START
        return next((after for low, high, after in _LEADS if low <= byte <= high), _REJECT)
    if state == _REJECT:
        return _REJECT
    low, high, after = _FOLLOW[state]
    return after if low <= byte <= high else _REJECT


class StreamDecoder:
    """Bytes of token ids, and whether they are whole UTF-8, fed in portions of any length."""

    def __init__(self, merges: RankMerges) -> None:
        self.bytes_of = merges.bytes_of
        top = max(self.bytes_of) + 1
        self._bodies = np.empty(top, object)
        self._whole = np.zeros(top, bool)  # tokens that begin and end between characters
        self._steps: list[dict[int, int]] = [{} for _ in range(9)]
        for token, body in self.bytes_of.items():
            self._bodies[token] = body
            self._whole[token] = self._after(_START, token) == _START
        self.state = _START

    def _after(self, state: int, token: int) -> int:
        found = self._steps[state].get(token)
        if found is None:
            found = state
            for byte in self.bytes_of[token]:
                found = utf8_step(found, byte)
            self._steps[state][token] = found
        return found

    def feed(self, ids: list[int] | np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int32)
        if len(ids):
            odd = np.flatnonzero(~self._whole[ids]) if self.state == _START else range(len(ids))
            at = 0
            for i in odd:
                if i < at and self.state == _START:
                    continue
                i = max(i, at)
                while i < len(ids):
                    self.state = self._after(self.state, int(ids[i]))
                    i += 1
                    if self.state in (_START, _REJECT):
                        break
                at = i
                if self.state == _REJECT:
                    break
        return b"".join(self._bodies[ids].tolist())

    def finish(self) -> bool:
        """Whether the bytes fed so far are whole characters; starts anew."""
        whole, self.state = self.state == _START, _START
        return whole


ENCODED = "ids array<int>, decoded binary, valid_utf8 boolean"


def _round_trip(key: str, text: str, vocabulary: Broadcast, pattern: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value, pattern)
        decoder = StreamDecoder(encoder.merges)
        for batch in slices(batches):
            ids = [encoder.ids(t or "") for t in batch.column(text).to_pylist()]
            decoded, whole = [], []
            for one in ids:
                decoded.append(b"".join(decoder.feed(one[i : i + 4096]) for i in range(0, len(one), 4096)))
                whole.append(decoder.finish())
            ends = np.append(0, np.cumsum([len(one) for one in ids])).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), lists, pa.array(decoded, pa.binary()), pa.array(whole)],
                names=[key, "ids", "decoded", "valid_utf8"],
            )

    return task


def encode_decode(docs: DataFrame, vocabulary_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every whole text and what they decode to: ``key``, ``ids``, ``decoded``, ``valid_utf8``.

    One row per row of ``docs``, repeated keys included; other columns of ``docs`` are left
    out, so their names cannot clash. A null text counts as empty: no ids, empty bytes. A null
    key stays null. Special strings are ordinary text. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(
        docs.select(key, text), _round_trip(key, text, file_broadcast(spark, vocabulary_path), pattern), f"`{key}` {kind}, {ENCODED}"
    )
