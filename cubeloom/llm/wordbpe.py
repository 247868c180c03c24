"""Ids of a word-level BPE tokenizer (a tokenizers file), much faster than by the library alone.

The file's tokenizer lower-cases, splits at white space and by a pattern, and merges inside each
piece, whose last symbol carries an end mark. No token spans white space, so that a text's ids are
its words' ids, and each distinct word is encoded once and remembered.

Merges are done by tiktoken's core over the same vocabulary, with the end mark as one byte 0xFF
that no text has. It merges the pair whose union has the lowest id, the library the pair of the
first merge rule. For a vocabulary whose tokens are made by one rule each, in the order of their
ids, these are the same pair: when all merges before a token's rule are done, a stretch that spells
the token is in the state that the token alone would be in. A file of another kind, words of other
than printable ASCII and Latin letters, and words that hold a special token's literal text go to the
tokenizer itself. By default a literal becomes that special token, as the library has it; with
``literals`` false it is ordinary text.
"""

from __future__ import annotations

import json
import sys
from array import array

END = b"\xff"
#: Words remembered; beyond that a worker begins anew. Longer words than KEPT bytes aren't remembered.
REMEMBERED, KEPT = 300_000, 64
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
_loaded: dict[tuple[str, bool], "WordIds"] = {}


def byte_letters() -> dict[str, int]:
    """The byte for each letter that stands for one in a byte-level vocabulary: itself if printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordIds(dict):
    """A word's ids (4 bytes each, little-endian) by the word's UTF-8 bytes; words are free of ASCII white space."""

    def __init__(self, path: str, literals: bool = True):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not literals
        vocabulary, mark = file["model"]["vocab"], file["model"]["end_of_word_suffix"]
        split = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
        special = {t["content"] for t in file["added_tokens"]}
        self.literals = [t.encode() for t in special]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token.removesuffix(mark)) + END * token.endswith(mark): i for token, i in vocabulary.items() if token not in special}
        made = [vocabulary[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"])]
        single = sum(t in special or len(t.removesuffix(mark)) == 1 for t in vocabulary)
        self.fast = split == PIECES and made == sorted(set(made)) and single + len(made) == len(vocabulary)
        ranks.setdefault(END, len(vocabulary) + 1)
        self.core = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.simple = regex.compile(r"[\x21-\x7e\xa1-ɏ]+").fullmatch
        self.pieces = regex.compile(PIECES).findall

    def __missing__(self, word: bytes) -> bytes:
        low = word.lower()
        if self.fast and low.isalpha():
            ids = array("I", self.core(low + END))
        elif self.fast and self.simple(text := word.decode()) and not any(t in word for t in self.literals):
            ids = array("I", [i for p in self.pieces(text.lower()) for i in self.core(p.encode() + END)])
        else:
            ids = array("I", self.whole.encode(word.decode(), add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        out = ids.tobytes()
        if len(word) <= KEPT:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


def load(path: str, literals: bool = True) -> WordIds:
    """The vocabulary's ids, once in each Python worker."""
    key = path, literals
    if key not in _loaded:
        _loaded[key] = WordIds(path, literals)
    if len(_loaded[key]) > REMEMBERED:
        _loaded[key].clear()
    return _loaded[key]
