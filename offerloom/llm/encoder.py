"""Token ids of whole texts by a public tokenizer file, with a memo of space-separated pieces."""

from __future__ import annotations

import gc
import json
import os
import re
import string
from array import array
from functools import lru_cache

import numpy as np


#: The letters that byte-level vocabularies write bytes as: printable Latin-1 characters stand for themselves, the rest for what
#: follows U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: b for b in _PRINTABLE} | {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The default for the tokenizer parameters: the path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def shared_encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder for each Python worker, so that its memo serves all the worker's tasks."""
    return Encoder(path, special_as_text)


#: Normalizer and pre-tokenizer under which a text's ids are those of its pieces between spaces: lower case, and no match reaches
#: over white space.
_APART = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed", "invert": True
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class Encoder:
    """encode(texts): ids as little-endian unsigned 32-bit integers.

    A tokenizer that lower-cases, drops white space and never joins over it, as word_bpe_49k does, gives
    a text the ids of its pieces between spaces and line ends, one after the other. Pieces recur, so most are looked
    up. A piece of plain letters and closing punctuation is put together from its letters in lower case and its
    punctuation: any of ASCII that is neither an apostrophe nor in an added token. The memo has two generations of bounded size; long pieces are not kept. Texts go whole to
    any tokenizer of other rules.
    """

    MOST_PIECES = 200_000
    LONGEST_PIECE = 48
    #: Letters of one code point whose lower case is one code point, whatever stands around them.
    _plain = re.compile("[A-Za-zÀ-ÖØ-öø-įĲ-ɏ]+")
    _mark = "\x00"

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        rules = json.loads(self.tokenizer.to_str())
        self.apart = all(rules[k] == v for k, v in _APART.items()) and rules["model"]["type"] == "BPE" and not any(
            t["lstrip"] or t["rstrip"] or " " in t["content"] for t in rules["added_tokens"]
        )
        added = "".join(t["content"] for t in rules["added_tokens"])
        self.closing = "".join(c for c in string.punctuation if c != "'" and c not in added)
        self.model = self.tokenizer.model
        self.memo: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        if self.apart:
            (self.mark_id,) = self.tokenizer.encode(self._mark, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.apart:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        collects = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and there are many small objects
        try:
            split = [t.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") for t in texts]
            if len(self.memo) > self.MOST_PIECES:
                self.memo, self.old = {"": b""}, self.memo
            passing = self._learn(set().union(*split).difference(self.memo))
            known = self.memo.__getitem__
            out = [b"".join(map(known, pieces)) for pieces in split]
            for p in passing:
                self.memo.pop(p, None)
            return out
        finally:
            if collects:
                gc.enable()

    def _learn(self, missing: set[str]) -> list[str]:
        """Adds pieces to the memo; returns those too long to stay."""
        memo, old, tails, closing = self.memo, self.old, self.tails, self.closing
        plain, longest = self._plain.fullmatch, self.LONGEST_PIECE
        rest, passing = [], []
        for p in missing:
            if len(p) > longest:
                passing.append(p)
            if (ids := old.get(p)) is not None:
                memo[p] = ids
                continue
            core = p.rstrip(closing)
            if not (core.isalpha() and (core.isascii() or plain(core))):
                rest.append(p)
                continue
            low = core.lower()
            ids = memo.get(low)
            if ids is None:
                ids = old.get(low)
                if ids is None:
                    ids = self._word(low)
                if len(low) <= longest:
                    memo[low] = ids
            if len(core) < len(p):
                tail = p[len(core) :]
                if tail not in tails:
                    if len(tails) > 1000:
                        tails.clear()
                    tails.update(self._ids([tail]))
                ids += tails[tail]
            memo[p] = ids
        memo.update(self._ids(rest))
        return passing

    def _word(self, core: str) -> bytes:
        """A word of plain lower-case letters: no normalizer changes it and it is one piece to the merges, so these are asked directly."""
        if not core.isascii():
            core = core.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(core)]).tobytes()

    def _ids(self, pieces: list[str]) -> dict[str, bytes]:
        """Many pieces in one string, apart by a mark whose id stands for nothing else."""
        out = {}
        alone = [p for p in pieces if self._mark in p]
        for p, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            out[p] = np.array(e.ids, "<u4").tobytes()
        pieces = [p for p in pieces if self._mark not in p]
        for lo in range(0, len(pieces), 10_000):
            some = pieces[lo : lo + 10_000]
            (e,) = self.tokenizer.encode_batch_fast([f" {self._mark} ".join(some)], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            raw = ids.tobytes()
            for p, a, b in zip(some, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                out[p] = raw[4 * a : 4 * b]
        return out


def encoded(texts, encoder: Encoder, step: int = 512, most_bytes: int = 2 << 20):
    """ids of each text of an Arrow array; null is empty."""
    held, size = [], 0
    for text in texts:
        t = text.as_py() or ""
        held.append(t)
        size += len(t)
        if len(held) >= step or size >= most_bytes:
            yield from encoder.encode(held)
            held, size = [], 0
    if held:
        yield from encoder.encode(held)
