"""Token ids of whole texts with a given tokenizers file of byte-level BPE.

Such a tokenizer always begins a new piece at a single space that a non-space follows. Texts are
cut there, and the ids of the cuts are remembered, since most words come again. New cuts of plain
Latin text are encoded by tiktoken over the same vocabulary, which gives the same ids; cuts with
other characters, and texts with special tokens or irregular spaces, go to the tokenizer itself.
"""

from __future__ import annotations

import gc
import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

PLAIN = re.compile("[\n -~¡-ɏ]*")
#: Fixed value: the pre-tokenising pattern of the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of many texts at once. One per Python worker; what it remembers is bounded in bytes, about."""

    def __init__(self, path: str, most_bytes: int = 128 << 20):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = _byte_alphabet()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {
            bytes(alphabet[c] for c in piece): rank for piece, rank in spec["model"]["vocab"].items() if piece not in self.special
        }
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.most_bytes = most_bytes
        self._forget()

    def _forget(self) -> None:
        self.known: tuple[dict, dict] = ({}, {})  # cuts at the start of a text, and after a space
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.used, self.held = [0], 0, 0

    def _encode(self, text: str) -> list[int]:
        if PLAIN.fullmatch(text):
            return self.plain.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _store(self, ids: list[int]) -> int:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.starts.append(self.used)
        self.held += 4 * len(ids) + 200  # the ids, the cut and its entry
        return len(self.starts) - 2

    def _regular(self, text: str) -> bool:
        odd = any(s in text for s in self.special) or "  " in text or " \n" in text or " \t" in text or " \r" in text
        return not odd and not text.endswith(" ") and not text.startswith(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the bounds of the texts in them."""
        if self.held > self.most_bytes:
            self._forget()
        heads, tails = self.known
        cuts: list[int] = []
        counts = []
        for text in texts:
            found = self._cut(text, heads, tails) if self._regular(text) else None
            if found is None:  # one cut that is not remembered
                found = [self._store(self.tokenizer.encode(text, add_special_tokens=False).ids)]
            cuts += found
            counts.append(len(found))
        at = np.array(cuts, np.int64)
        starts = np.array(self.starts, np.int64)
        lengths = starts[at + 1] - starts[at]
        ends = np.cumsum(lengths)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[at] - (ends - lengths), lengths)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return self.ids[place], bounds

    def _cut(self, text: str, heads: dict, tails: dict) -> list[int] | None:
        first, *rest = text.split(" ")
        found = list(map(tails.get, rest))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    cut = rest[i]
                    if not cut or cut[0].isspace():
                        return None
                    known = tails.get(cut)
                    if known is None:
                        known = tails[cut] = self._store(self._encode(" " + cut))
                    found[i] = known
        head = heads.get(first)
        if head is None:
            head = heads[first] = self._store(self._encode(first))
        return [head, *found]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, most_bytes: int = 128 << 20) -> Encoder:
    """The encoder of this worker process for a vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, most_bytes)
    return _encoders[path]


def drop_encoders() -> None:
    """Leave the memory of this worker process to the tasks of other steps."""
    _encoders.clear()
    gc.collect()
