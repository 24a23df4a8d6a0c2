"""Worker side of the operators that tokenize: encodings of pieces between white space, kept in a bounded cache.

The tokenizer's pattern never matches across white space, so a text's tokens are those of its pieces between white
space, one after another, and a piece's are those of its pattern's matches. That holds as long as normalising a piece does
not depend on its neighbours: texts with characters outside PLAIN (combining marks, final sigma, separators that differ
between libraries) or with something like a special token's string are given to the library whole. Misses are encoded by the
same vocabulary and merges without the normaliser and the pattern, which a lower-cased match of the pattern no longer needs.
"""

from __future__ import annotations

import functools
import json
import os

import pyarrow as pa
import pyarrow.compute as pc

#: What must not be in a text that is encoded piece by piece (RE2 syntax).
UNPLAIN = "[^\t\n\r -~¡-¬®-įı-ɏ]|<\\|"


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer's file; a path is returned as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(2)
def _parts(path: str):
    """The vocabulary's own pattern, as a function from a piece to its matches, and an encoder for one match. None and
    None for a tokenizer that isn't normaliser NFC + white space + lower case, then one pattern, then bytes."""
    import regex
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    steps = [x["type"] for x in (own["normalizer"] or {}).get("normalizers", [])]
    split, *level = (own["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    if steps != ["NFC", "Replace", "Lowercase"] or split.get("type") != "Split" or [x["type"] for x in level] != ["ByteLevel"]:
        return None, None
    own |= {"normalizer": None, "pre_tokenizer": level[0]}
    return regex.compile(split["pattern"]["Regex"]).findall, Tokenizer.from_str(json.dumps(own))


class PieceCache(dict):
    """Piece -> value of its ids, for pieces of plain lower-case text; empty + one value is that value.

    `table` is always there, beside it at most `most` pieces and `most_bytes` (of pieces and values that are bytes) since the last turnover, and as much from before it, so
    that pieces in use stay. Pieces of more than `longest` characters are encoded each time.
    """

    def __init__(self, path: str, value, empty, table: dict, most: int, most_bytes: int = 96 << 20, longest: int = 256):
        super().__init__(table)
        self.path, self.value, self.empty, self.table, self.most, self.most_bytes, self.longest = path, value, empty, table, most + len(table), most_bytes, longest
        self.old, self.bytes, self.of_bytes = {}, 0, isinstance(empty, bytes)
        self.matches, self.encoder = _parts(path)

    def __missing__(self, piece: str):
        found = self.old.get(piece)
        if found is None:
            if piece.isalpha() or len(own := self.matches(piece)) == 1 and own[0] == piece:
                found = self.value(self.encoder.encode(piece, add_special_tokens=False).ids)
            elif self.of_bytes:
                found = b"".join([self[x] for x in own])
            else:
                found = sum([self[x] for x in own], self.empty)
        if len(piece) <= self.longest:
            self[piece] = found
            self.bytes += 150 + 4 * len(piece) + (len(found) if self.of_bytes else 0)
            if len(self) > self.most or self.bytes > self.most_bytes:
                self.turn_over()
        return found

    def turn_over(self) -> None:
        self.old, self.bytes = dict(self), 0
        self.clear()
        self.update(self.table)

    def values_of(self, texts: pa.Array, join):
        """join() of the values of each text's pieces. A text that is not plain is encoded whole."""
        plain = pc.invert(pc.match_substring_regex(texts, UNPLAIN)).to_pylist() if self.encoder else [False] * len(texts)
        for text, is_plain in zip(texts, plain):
            text = text.as_py()
            if is_plain:
                yield join(map(self.__getitem__, text.lower().split()))
            else:
                yield join([self.value(tokenizer(self.path).encode(text, add_special_tokens=False).ids)])
