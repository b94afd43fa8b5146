"""Pre-tokens of byte-level tokenizers, found without the library's slower alignment bookkeeping.

Two split rules are known: that of the byte-level pre-tokenizer itself, and a split that drops white
space after lower-casing. They are applied to texts whose characters are all below U+0100, where
composition, case and character classes are the same in every Unicode version; every other text, every
text that holds a special string and every other kind of tokenizer goes to the library whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Memo(dict):
    """Results by key, worked out where missing. Beyond ``size`` entries nothing more is remembered."""

    def __init__(self, learn: Callable, size: int = 700_000):
        super().__init__()
        self.learn, self.size = learn, size

    def __missing__(self, key):
        value = self.learn(key)
        if len(self) < self.size:
            self[key] = value
        return value


class Apart(Exception):
    """The pre-tokens of a chunk depend on its neighbours."""


class Splitter:
    """Cuts texts at single spaces into chunks whose pre-tokens do not depend on each other.

    ``chunks(text)`` is None where the library has to read the whole text. The pre-tokens of a text are
    those of its first chunk and, of each later one, those of the chunk with its space in front.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.lower, self.space = False, ""
        pattern, pre, norm = None, spec["pre_tokenizer"] or {}, spec["normalizer"]
        plain = not spec["truncation"] and not spec["padding"] and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        if plain and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
            pattern, self.space = BYTE_LEVEL, " "
        elif plain and pre.get("type") == "Sequence" and norm and norm.get("type") == "Sequence":
            kinds = [n["type"] for n in norm["normalizers"]]
            split, level = (pre["pretokenizers"] + [{}, {}])[:2]
            if kinds == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split["invert"] and split["behavior"] == "Removed" \
                    and level.get("type") == "ByteLevel" and not level["use_regex"] and not level["add_prefix_space"]:
                pattern, self.lower = split["pattern"]["Regex"], True
        self.find = regex.compile(pattern).findall if pattern else None
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(256)}

    def chunks(self, text: str) -> list[str] | None:
        if self.find is None or any(s in text for s in self.specials):
            return None
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return None
        return (text.lower() if self.lower else text).split(" ")

    def pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk that follows a space; ``Apart`` where white space meets that space."""
        if chunk.isalpha():
            return [self.space + chunk]
        if chunk[-1:] in (",", ".") and chunk[:-1].isalpha():
            return [self.space + chunk[:-1], chunk[-1]]
        if self.space and (not chunk or chunk[0].isspace() or chunk[-1].isspace()):
            raise Apart
        return self.find(self.space + chunk)

    def merged(self, piece: str) -> list[int]:
        """Ids of one pre-token by the merges of the vocabulary."""
        return [t.id for t in self.model.tokenize(piece.translate(self.bytes))]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids
