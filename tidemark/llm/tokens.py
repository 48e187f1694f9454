"""Token ids of whole texts by the tokenizers library, with what a worker has seen before kept at hand.

Ids are those of the library's encode(text, add_special_tokens=False); so the literal of a special token in a text gets
that token's id, unless special_as_text is set.

Byte-level BPE never merges across pre-tokens, and a pre-token never goes on over a space that follows a character other
than white space, nor reaches over a space before such a character. Cutting a text before each space is therefore exact
unless a space stands between white space and white space (or the end); such texts are encoded as they are. Pieces are
kept with their ids in a bounded table, so that frequent words cost one look-up.
"""

from __future__ import annotations

import re
import sys
from array import array

PIECES_KEPT = 500_000
_UNSAFE = re.compile(r"\s (?=\s|\Z)")
_LINE_END = re.compile(r"(?<=\S)\n(?=\S)")  # a pre-token of its own
_SPACED = [" " + chr(c) for c in (32, 9, 10, 11, 12, 13, 28, 29, 30, 31)]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """How byte-level BPE writes bytes: printable ones as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def safe(text: str) -> bool:
    """Whether a text may be cut before each space."""
    if text.isascii() and text[-1] != " " and not any(x in text for x in _SPACED):
        return True
    return not _UNSAFE.search(text)


class Encoder(dict):
    """Piece (without the space before it) -> ids of space and piece, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, special_as_text: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.model = self.library.model
        self.full_stop, self.comma, self.new_line = (self.encoded(x) for x in ".,\n")
        self.starts = Starts(self)

    def encoded(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        return self.looked_up(piece, " ", self)

    def looked_up(self, piece: str, before: str, known) -> bytes:
        """ids of before + piece; known: a table of pieces with the same `before`."""
        if piece.isalpha():  # one pre-token
            spelt = (before + piece).encode("utf-8").decode("latin-1").translate(self.letters)
            out = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        elif piece[-1:] in (".", ",") and piece[:-1].isalpha():  # two
            return known[piece[:-1]] + (self.full_stop if piece[-1] == "." else self.comma)
        else:
            first, *lines = _LINE_END.split(piece) if "\n" in piece else (piece,)
            if lines:  # in a loop: a piece may have any number of lines
                return self.new_line.join([known[first], *map(self.starts.__getitem__, lines)])
            out = self.encoded(before + piece)
        if len(piece) < 64:  # what is put together from pieces is not kept itself
            if len(known) >= PIECES_KEPT:  # the first are mostly the frequent ones
                for rare in list(known)[PIECES_KEPT // 2 :]:
                    del known[rare]
            known[piece] = out
        return out

    def ids(self, text: str | None) -> bytes:
        """All ids of a whole text."""
        if not text:
            return b""
        if not safe(text) or any(x in text for x in self.special):
            return self.encoded(text)
        first, *rest = text.split(" ")
        return b"".join([self.encoded(first) if first else b"", *map(self.__getitem__, rest)])


class Starts(dict):
    """Piece without a space before it -> ids; for the first word of a line."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        return self.encoder.looked_up(piece, "", self)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def encoder(path: str) -> Encoder:
    """One for each path and worker process; it stays from task to task."""
    kept = sys.__dict__.setdefault("_tidemark_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
