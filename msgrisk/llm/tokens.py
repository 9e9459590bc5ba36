"""Exact token ids of whole texts through the tokenizers library, one lookup for each repeated word.

Both supported tokenizer files split a text into pre-tokens that never cross the cuts made here, so the ids of a
text are the ids of its pieces in order:

* byte-level BPE: a piece is an optional space and a run of non-spaces, all but the last character of a run of
  white space, or one white-space character;
* word BPE (white space dropped): a piece is a run of non-spaces.

A run of Latin letters before white space or plain punctuation is a piece of its own in both.

Every piece is encoded by the library; the ids of short pieces are kept in a bounded cache.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from msgrisk.llm.common import Memo

# White space as the tokenizers library sees it: Python's, without the four separator controls.
_SPACE = r"[^\S\x1c-\x1f]"
_SOLID = r"[\S\x1c-\x1f]"
# Letters that are one pre-token with what follows them below: all composed, so normalization leaves them alone.
LETTER = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]"
_BYTE_PIECES = re.compile(rf" ?{LETTER}+(?=[ \n.,;:!?|]|$)| ?{_SOLID}+|{_SPACE}+(?!{_SOLID})|{_SPACE}")
_WORD_PIECES = re.compile(rf"{LETTER}+(?=[ \n.,;:!?|]|$)|{_SOLID}+")
_LETTERS_ONLY = re.compile(f" ?{LETTER}+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: a byte's own character, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TextEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes.

    The name of a special token inside a text is that token, as in the library by default; with ``plain`` it is spelled out
    like any other text.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        added = [] if plain else settings.get("added_tokens", [])
        #: What every text that names a special token holds; empty if that is not known, none if there are no such tokens.
        self.named = os.path.commonprefix(["" if t["normalized"] else t["content"] for t in added]) if added else None
        before = json.dumps([settings.get("normalizer"), settings.get("pre_tokenizer")])
        self.kind = "whole"
        if settings["model"].get("type") == "BPE":
            if settings.get("normalizer") is None and settings["pre_tokenizer"] == {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True,
            }:
                self.kind = "byte"
            elif '"Removed", "invert": true' in before and "\\\\s+" in before:
                self.kind = "word"
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.stand_ins = _byte_letters()
        self.cache = Memo(self._piece_ids)

    def _piece_ids(self, piece: str) -> bytes:
        """A run of letters is one pre-token and goes to the library's model at once; any other piece takes all steps."""
        if len(piece) > 64 or not _LETTERS_ONLY.fullmatch(piece):
            return self._library_ids(piece)
        if self.kind == "word":
            piece = piece.lower()
        raw = piece.encode().decode("latin-1").translate(self.stand_ins)
        return np.asarray([t.id for t in self.library.model.tokenize(raw)], dtype="<u4").tobytes()

    def _library_ids(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.named is not None and self.named in text:
            return self._library_ids(text)
        if self.kind == "byte":
            pieces = _BYTE_PIECES.findall(text)
        elif self.kind == "word":
            pieces = _WORD_PIECES.findall(text)
        else:
            return self._library_ids(text)
        return b"".join(map(self.cache.__getitem__, pieces))


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """One encoder for each file and worker process; names of special tokens inside texts are those tokens."""
    return TextEncoder(path)
