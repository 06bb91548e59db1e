"""Texts cut at spaces into chunks that encode independently of each other.

The split pattern of byte-level BPE never lets a match run across a space whose left neighbour is not
white space or whose right neighbour is not white space: the match before it ends there, and the space opens the next
one. So ids of the text are the ids of its space-separated chunks in order (every chunk but the first carrying its
space), and chunks repeat often enough to be encoded once and looked up afterwards. The rare texts that have a space
between two other white-space characters, or a special string, go through the encoder whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: A space inside a longer white-space run, where cutting would change the run's token.
INNER_SPACE = re.compile(r"\s (?=\s|\Z)")
#: Characters of texts whose chunks are looked up together.
BLOCK = 1 << 22


class ChunkCodes(dict):
    """Codes by chunk (without its leading space), filled by ``encode_many``; texts that can't be cut go to ``encode_whole``.

    At ``limit`` entries the table becomes the earlier generation and a new one begins; a chunk met again moves over, one that
    both have forgotten is encoded again. So memory is bounded and codes don't depend on the limit.
    """

    def __init__(self, encode_many: Callable[[list[str]], list], specials: tuple[str, ...] = (), limit: int = 500_000, encode_whole: Callable | None = None):
        super().__init__()
        self.encode_many, self.specials, self.limit = encode_many, specials, limit
        self.encode_whole = encode_whole or (lambda text: encode_many([text])[0])
        self.earlier: dict = {}

    def cut(self, text: str) -> list[str] | None:
        """The chunks of a text, or None if it must be encoded whole."""
        if INNER_SPACE.search(text) or any(s in text for s in self.specials):
            return None
        return text.split(" ")

    def learn(self, chunks: set[str]) -> None:
        """Afterwards the table has all of ``chunks``."""
        missing = chunks - self.keys()
        if len(self) + len(missing) > self.limit:
            self.earlier = dict(self)
            self.clear()
            missing = chunks
        old = missing & self.earlier.keys() if self.earlier else ()
        for c in old:
            self[c] = self.earlier[c]
        new = list(missing.difference(old))
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            self.update(zip(part, self.encode_many([" " + c for c in part]), strict=True))

    def groups(self, texts: list[str]):
        """``(text, chunks, first)`` in groups of about BLOCK characters, whose chunks are in the table when a group comes; chunks of a text that is
        to be encoded whole are None. The first chunk is by itself, as no space precedes it."""
        at = 0
        while at < len(texts):
            group, size, wanted = [], 0, set()
            while at < len(texts) and (not group or size < BLOCK):
                chunks = self.cut(texts[at])
                first = chunks.pop(0) if chunks else ""
                group.append((texts[at], chunks, first))
                wanted.update(chunks or ())
                size += len(texts[at])
                at += 1
            self.learn(wanted)
            yield group

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; codes must be bytes."""
        out, code = [], self.__getitem__
        for group in self.groups(texts):
            for text, chunks, first in group:
                if chunks is None:
                    out.append(self.encode_whole(text))
                else:
                    out.append((self.encode_many([first])[0] if first else b"") + b"".join(map(code, chunks)))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]
