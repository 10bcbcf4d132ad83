"""Token ids of whole texts by a public tokenizer file, with a bounded cache of chunks.

The vocabulary file is named by the caller and opened where the work runs (public_tokenizers is
installed on every node); it is never copied into this repository.
"""

from __future__ import annotations

from array import array

#: Distinct chunks cached per Python worker.
CACHE = 1_000_000


def _byte_level() -> dict[int, int]:
    """Byte-level form: printable Latin-1 bytes stand for themselves, the others for U+0100 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


BYTE_LEVEL = _byte_level()


class WordTokens(dict):
    """Ids of the word-level vocabulary as little-endian unsigned 32-bit bytes, by text chunk.

    This vocabulary's tokenizer lower-cases, never joins pieces across white space and starts a
    new piece between an ASCII letter or digit and a full stop or comma. So a text's ids are those
    of its white-space-free chunks, one after the other, and a chunk such as ``word,`` is ``word``
    and ``,``.
    """

    def __init__(self, file: str):
        super().__init__()
        from tokenizers import Tokenizer
        import public_tokenizers

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        self.pieces = self.tokenizer.model.tokenize

    def __missing__(self, chunk: bytes) -> bytes:
        if len(chunk) > 1 and chunk[-1:] in b".," and chunk[-2:-1].isalnum():
            ids = self[chunk[:-1]] + self[chunk[-1:]]
        else:
            ids = array("I", self._ids(chunk.decode())).tobytes()
        if len(self) < CACHE:
            self[chunk] = ids
        return ids

    def _ids(self, chunk: str) -> list[int]:
        # letters below U+0180 are one piece and unchanged by normalising, so the merges alone are run
        if chunk.isalpha() and max(chunk) < "\u0180" and (low := chunk.lower()).isalpha():
            return [t.id for t in self.pieces(low.encode().decode("latin-1").translate(BYTE_LEVEL))]
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def encode(self, text: str | None) -> bytes:
        raw = (text or "").encode()
        # special tokens are matched before lower-casing, so a text that may hold one keeps its case
        return b"".join(map(self.__getitem__, (raw if b"<|" in raw else raw.lower()).split()))

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) // 4


_OPEN: dict[str, object] = {}


def word_tokens(file: str) -> WordTokens:
    """This worker's encoder for ``file``."""
    if file not in _OPEN:
        _OPEN[file] = WordTokens(file)
    return _OPEN[file]


class ByteTokens:
    """Token counts under a rank file (byte-level pieces), the text taken as ordinary text."""

    def __init__(self, file: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(file), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str | None) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0


def byte_tokens(file: str) -> ByteTokens:
    """This worker's counter for ``file``."""
    if file not in _OPEN:
        _OPEN[file] = ByteTokens(file)
    return _OPEN[file]
