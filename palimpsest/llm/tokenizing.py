"""Fast, exact encoding with public tokenizer files.

Both tokenizers' pre-tokens never reach across the places where ``WordEncoder`` cuts a
text, so each cut piece is encoded once and kept in a bounded cache; a text's ids are the joined
ids of its pieces.

The tokenizers library loads the file, normalizes, and encodes every piece that holds a control character or a
letter beyond the Armenian block. Other pieces, by far the most, get the same
merges from tiktoken's faster routine, built from the vocabulary that the library loaded.

So most ids are not the library's own output, though equal to it: the library alone takes too long (see the README).
A text that holds an added token's string goes to the library as it is.

Why the cuts are safe. The byte-level pattern lets a match start with one space and end before
white space, or be a run of white space that leaves its last character to a following
word. So there is always a boundary between a non-space and a space, and before a space that a
non-space follows. The word-level tokenizer drops white space altogether, and neither
normal form C nor lower-casing reaches across a space.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array
from collections.abc import Callable

#: Unicode's White_Space, which the tokenizers' patterns call \s.
_SPACES = "\t-\r \x85\xa0  -     　"
_LOOSE_SPACE = re.compile(f" (?:[{_SPACES}]|$)")
_PIECE = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")


#: Fixed value: the pattern of the byte-level pre-tokenizer.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Control characters but the line feed, and what lies beyond the Armenian block.
_RARE = re.compile("[\\x00-\\x09\\x0b-\\x1f\\x7f-\\x9f\u0590-\U0010ffff]")
#: A byte that no UTF-8 text holds: in merges it stands for the end of a word.
_WORD_END = b"\xff"


def _byte_names() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 is itself, the
    others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_ranks(tokenizer) -> dict[bytes, int]:
    """The vocabulary as bytes with their ids, which are in the order of the merges."""
    names, end = _byte_names(), json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
    ranks = {}
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        stem = token.removesuffix(end) if end else token
        ranks[bytes(names[c] for c in stem) + (_WORD_END if stem != token else b"")] = number
    return ranks


#: Pieces that an encoder may remember from one task to the next.
KEPT_PIECES = 100_000


class _Known(dict):
    """Ids of pieces, learnt when first asked for."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        super().__init__()
        self._learn = learn

    def __missing__(self, piece: str) -> bytes:
        self[piece] = found = self._learn(piece)
        return found


class WordEncoder:
    """Texts to ids (little-endian unsigned 32-bit bytes).

    ``drops_space`` says that the tokenizer drops white space. ``cache_pieces`` bounds the cache between
    batches: when full it starts anew, so memory does not grow with the vocabulary of the corpus.
    """

    def __init__(self, path: str, drops_space: bool, cache_pieces: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._drops_space = drops_space
        self._limit = cache_pieces
        self._known = _Known(self._learn_word if drops_space else self._learn_bytes)
        #: Of pieces without the one space before them, so that it need not be put back in a copy.
        self._after_space = _Known(lambda piece: self._learn_bytes(" " + piece))
        model = json.loads(self._tokenizer.to_str())
        self._special = [x["content"] for x in model["added_tokens"]]
        if drops_space:
            pattern = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self._words = regex.compile(pattern).findall
        else:
            pattern = _BYTE_LEVEL
        self._merges = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=merge_ranks(self._tokenizer), special_tokens={})._core_bpe

    @classmethod
    def shared(cls, path: str, drops_space: bool) -> "WordEncoder":
        """The encoder of this Python process; loading one takes long."""
        kept = sys.modules.setdefault("_palimpsest_encoders", types.ModuleType("_palimpsest_encoders")).__dict__
        if (path, drops_space) not in kept:
            kept[path, drops_space] = cls(path, drops_space)
        return kept[path, drops_space]

    def forget(self, pieces: int = 0) -> None:
        """Empty the caches if they hold more pieces than that."""
        if len(self._known) + len(self._after_space) > pieces:
            self._known.clear()
            self._after_space.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        self.forget(self._limit)
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> bytes:
        # An added token's string in a text is that token, wherever it stands: such texts go to the library whole.
        if any(x in text for x in self._special):
            return self._library(text)
        if self._drops_space:
            return b"".join(map(self._known.__getitem__, text.replace("\n", " ").split(" ")))
        if _LOOSE_SPACE.search(text):
            return b"".join(map(self._known.__getitem__, _PIECE.findall(text)))
        first, *rest = text.split(" ")
        return self._known[first] + b"".join(map(self._after_space.__getitem__, rest))

    def _library(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn_bytes(self, piece: str) -> bytes:
        if _RARE.search(piece):
            return self._library(piece)
        if piece[1:].isalpha() and piece[0] == " ":  # one pre-token
            return array("I", self._merges.encode_single_piece(piece.encode())).tobytes()
        return array("I", self._merges.encode_ordinary(piece)).tobytes()

    def _learn_word(self, piece: str) -> bytes:
        if _RARE.search(piece):
            return self._library(piece)
        plain = piece.lower() if piece.isascii() else self._tokenizer.normalizer.normalize_str(piece)
        words = [plain] if plain.isalpha() else self._words(plain)
        single = self._merges.encode_single_piece
        return array("I", [i for word in words for i in single(word.encode() + _WORD_END)]).tobytes()


def batches(texts: list[str], chars: int = 2_000_000):
    """Index ranges of texts, each of about ``chars`` characters at most, or one text."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
