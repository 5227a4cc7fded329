"""Byte-pair merges of a public vocabulary: which token pairs a greedy encoder leaves standing next to each other."""

from __future__ import annotations

import base64
import json
from math import inf


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, mapped back to the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


# Bound of the answers that are remembered.
SEAMS = 600_000


class Merges:
    """Tokens with the order in which merging makes them.

    Greedy merging leaves tokens ``t1 .. tn`` exactly if each token is what its own bytes
    merge to and no neighbouring pair would have merged across its seam before both sides
    were complete. ``compatible`` decides the second, by undoing merges from the newest.
    """

    def __init__(self) -> None:
        self.made: dict[int, int] = {}  # token -> order of its merge, -1 for a single symbol
        self.parts: dict[int, tuple[int, int]] = {}
        self.seams: dict[int, bool] = {}

    def order(self, left: int, right: int) -> float:
        """Order of the merge of this pair, infinite if there is none."""
        raise NotImplementedError

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.seams.get(key)
        if known is None:
            if len(self.seams) > SEAMS:
                self.seams.clear()
            known = self.seams[key] = self._seam_stands(left, right)
        return known

    def _seam_stands(self, left: int, right: int) -> bool:
        before = inf
        made, parts, order = self.made, self.parts, self.order
        while True:
            if order(left, right) < before:
                return False
            a, b = made[left], made[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, parts[left][1]
            else:  # of equal merges the left one comes first
                before, right = b + 1, parts[right][0]


class WordEndMerges(Merges):
    """A merge list whose words end in a marked symbol (``.json`` vocabularies with ``</w>``)."""

    def __init__(self, data: bytes) -> None:
        super().__init__()
        doc = json.loads(data)
        model, letters = doc["model"], byte_letters()
        end = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in doc["added_tokens"]}
        self._pairs: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(model["merges"]):
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            self._pairs[left, right] = i
            self.made[token] = i
            self.parts[token] = (left, right)
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for name, token in vocab.items():
            if name in self.special:
                continue
            self.made.setdefault(token, -1)
            closing = name.endswith(end) and len(name) > len(end)
            body = name[: -len(end)] if closing else name
            (self.final if closing else self.inner)[bytes(letters[c] for c in body)] = token
        self.longest = max(map(len, [*self.inner, *self.final]))

    def order(self, left: int, right: int) -> float:
        return self._pairs.get((left, right), inf)


class RankMerges(Merges):
    """A vocabulary of ranks: any two neighbours whose bytes together are a token may merge, lowest rank first."""

    def __init__(self, data: bytes) -> None:
        super().__init__()
        self.ids: dict[bytes, int] = {}
        for line in data.split(b"\n"):
            if line.strip():
                body, rank = line.split()
                self.ids[base64.b64decode(body)] = int(rank)
        self.bytes_of: dict[int, bytes] = {rank: body for body, rank in self.ids.items()}
        self.starts = {body[:i] for body in self.ids for i in range(1, len(body))}
        for body, rank in list(self.ids.items()):
            if len(body) == 1:
                self.made[rank] = -1
                continue
            last = self._last_pair(body)
            if last is None:  # its own bytes merge to something else, so no text gives it
                del self.ids[body]
                self.made[rank] = -1
            else:
                self.made[rank] = rank
                self.parts[rank] = last

    def _last_pair(self, body: bytes) -> tuple[int, int] | None:
        ids, symbols = self.ids, [body[i : i + 1] for i in range(len(body))]
        while len(symbols) > 2:
            best = min(range(len(symbols) - 1), key=lambda i: (ids.get(symbols[i] + symbols[i + 1], inf), i))
            if symbols[best] + symbols[best + 1] not in ids:
                return None
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return ids[symbols[0]], ids[symbols[1]]

    def order(self, left: int, right: int) -> float:
        return self.ids.get(self.bytes_of[left] + self.bytes_of[right], inf)
