"""Token counts and offsets by a public byte-level tokenizer whose rank file is a parameter."""

from __future__ import annotations

import base64
import re

import numpy as np

#: Fixed value: the pre-tokenizer expression that the rank files were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CHUNK = re.compile(r"\s*\S+|\s+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_CACHED, _LONGEST = 400_000, 400


def default_ranks() -> str:
    """Path of the rank file used unless another is given: that of the installed package of public tokenizers."""
    try:
        import public_tokenizers
    except ImportError as missing:
        raise RuntimeError("no package of public tokenizers is installed: give the path of a rank file as ranks") from missing
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def has_odd_space(text: str) -> bool:
    """Whether a text has control characters that Python and the tokenizer's expression don't both take for space: it is tokenized whole."""
    return _ODD_SPACE.search(text) is not None


def begins_chunk(text: str, at: int) -> bool:
    """Whether a chunk of white space and word, which is tokenized by itself, begins at a place before the text's end."""
    return at == 0 or text[at].isspace() and not text[at - 1].isspace()


def chunk_end(text: str, at: int) -> int:
    """Where the chunk ends that a place stands in."""
    return _CHUNK.match(text, at).end()


def last_chunk(text: str, lo: int, hi: int) -> int:
    """Where the last chunk of a stretch begins."""
    if text[hi - 1].isspace():
        return lo + len(text[lo:hi].rstrip())
    head = text[lo:hi].rsplit(None, 1)
    return lo + len(head[0]) if len(head) > 1 else lo


class Tokenizer:
    """Byte lengths of the tokens of a text.

    A pre-token never reaches from a word into the white space behind it, so a text's tokens are those of its chunks of
    white space and word strung together, and frequent chunks are looked up instead of encoded again.
    """

    def __init__(self, ranks: str | None = None) -> None:
        self.ranks = ranks or default_ranks()
        self._encode = None
        self._known: dict[str, bytes] = {}

    def __getstate__(self):
        return {"ranks": self.ranks}

    def __setstate__(self, state) -> None:
        self.__init__(state["ranks"])

    def _load(self) -> None:
        import tiktoken

        with open(self.ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        lengths = np.zeros(max(table.values()) + 1, np.uint8)
        for piece, number in table.items():
            lengths[number] = len(piece)
        self._encode = lambda text: lengths[np.array(encoding.encode_ordinary(text), np.int64)].tobytes()

    def count(self, text: str) -> int:
        """The number of tokens of a text; a chunk met before is looked up."""
        got = self._known.get(text)
        return len(self.lengths(text) if got is None else got)

    def lengths(self, text: str) -> bytes:
        """One byte for each token: the number of bytes of the text it stands for."""
        if self._encode is None:
            self._load()
        if not text:
            return b""
        if has_odd_space(text):
            return self._encode(text)
        known = self._known
        chunks = _CHUNK.findall(text)
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            out = []
            for c in chunks:
                got = known.get(c)
                if got is None:
                    got = self._encode(c)
                    if len(c) <= _LONGEST:
                        if len(known) >= _CACHED:
                            known.clear()
                        known[c] = got
                out.append(got)
            return b"".join(out)
