"""Byte-level BPE identifiers, equal to those of the ``tokenizers`` library on the same file."""

from __future__ import annotations

import json
import os
from functools import cached_property

import numpy as np

#: Fixed value: the pre-tokenizer's published pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Identifiers of texts, equal to those of the ``tokenizers`` library on the same file.

    Where the file holds plain byte-level merges, they are handed as ranks to ``tiktoken``, which is
    some four times as fast; a text with a special token's string, and any other file, is left to
    the library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            self.spec = f.read()
        spec = json.loads(self.spec)
        self.special = [x["content"] for x in spec.get("added_tokens", ())]
        self.engine = self._ranks(spec)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.spec)

    @cached_property
    def plain(self):
        """The library without special tokens."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(json.dumps({**json.loads(self.spec), "added_tokens": [], "post_processor": None}))

    @staticmethod
    def _ranks(spec: dict):
        """The same merges by rank, where the file's order of identifiers is the order of merges; else None."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return None
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {x["content"] for x in spec.get("added_tokens", ())}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
        merged = [model["vocab"][("".join(m) if isinstance(m, list) else m.replace(" ", ""))] for m in model["merges"]]
        if merged != sorted(merged):
            return None
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Unsigned 32-bit identifiers of the whole text."""
        if self.engine is None or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.engine.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def encode_ordinary(self, text: str) -> np.ndarray:
        """As :meth:`encode`, with special tokens' strings as ordinary text; never a special identifier."""
        if self.engine is None:
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4")
        return self.engine.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


_LOADED: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One encoder per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
