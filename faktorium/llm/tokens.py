"""Token ids of whole texts by a public tokenizer file, as little-endian unsigned 32-bit bytes.

For vocabularies that lower-case and that end every token at white space (``word_bpe_49k.json``): a text is encoded
piece by piece, and the ids of pieces seen before come from a bounded table of the worker. Pieces of Latin letters, in
capitals or not and with marks behind them or not, share an entry. The tokenizers library encodes whatever isn't in
the table.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

END_ID = 2
TABLE_ENTRIES = 800_000

# Python's split() also cuts at these, which aren't white space to the tokenizer.
_OTHER_SEPARATORS = re.compile("[\x1c-\x1f]")
_MARKED = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:|]*)\\Z")


def _byte_names() -> dict[int, int]:
    """How byte-level vocabularies name bytes: visible Latin-1 characters themselves, the others from 256 on in their order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: b if b in visible else 256 + hidden.index(b) for b in range(256)}


_BYTE_NAMES = _byte_names()


def _bytes(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class PieceTable(dict):
    """Piece -> bytes of its ids, filled by need. A full table becomes the older one, which what is used again leaves."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.entries = Tokenizer.from_file(path), entries // 2
        self.model = self.tokenizer.model
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            marked = _MARKED.match(piece)
            if marked and (marked[2] or not piece.islower()):
                found = self[marked[1].lower()]
                if marked[2]:
                    found += self[marked[2]]
            elif marked:
                # Small Latin letters pass the normaliser and the splitter unchanged: the model alone is enough.
                name = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_NAMES)
                found = _bytes([token.id for token in self.model.tokenize(name)])
            else:
                found = self.encode(piece)
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        if len(piece) < 64:
            self[piece] = found
        return found

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text without an end id; a null text is empty."""
        if not text:
            return b""
        if _OTHER_SEPARATORS.search(text):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


_tables: dict[str, PieceTable] = {}


def table(path: str) -> PieceTable:
    """The worker's table of one tokenizer file."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
