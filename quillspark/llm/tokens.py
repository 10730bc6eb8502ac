"""Token ids of texts from a public byte-level BPE vocabulary."""

from __future__ import annotations

import array
import base64

import public_tokenizers

SPECIAL = "<|endoftext|>"
END = 50256


class Encoder:
    """ids(text) equals what the tokenizers library gives for the vocabulary file, add_special_tokens=False.

    tiktoken runs the same vocabulary several times as fast; only texts that spell the special token need the other library
    (special=False takes the spelled token as ordinary text, so that its id never occurs)."""

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        import tiktoken

        self.json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._whole = None

    def ids(self, text: str | None, special: bool = True) -> array.array:
        """The ids as unsigned 16-bit numbers; none for null."""
        text = text or ""
        if special and SPECIAL in text:
            if self._whole is None:
                from tokenizers import Tokenizer

                self._whole = Tokenizer.from_file(self.json_path)
            return array.array("H", self._whole.encode(text, add_special_tokens=False).ids)
        return array.array("H", self._bpe.encode_ordinary(text))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(json_path: str | None = None, ranks_path: str | None = None) -> Encoder:
    """One encoder a Python worker and vocabulary."""
    key = (json_path, ranks_path)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(json_path, ranks_path)
    return _ENCODERS[key]
