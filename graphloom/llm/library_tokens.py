"""Ids as the ``tokenizers`` library gives them for a byte-level BPE file, by chunks looked up once encoded.

Plain characters (ASCII and Latin-1 letters, on whose classes all pattern engines agree) are encoded by ``tiktoken`` with ranks taken from the
file's own vocabulary, a third of the library's time; this needs every merge's result to be numbered in merge order, which is checked. All other
chunks, every text that cannot be cut, and every special string go to the library itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

from graphloom.llm.chunks import ChunkCodes
from graphloom.llm.common import table

#: Plain texts; a chunk's leading space and plain characters, line feeds only inside; and many such chunks, a tab after each.
PLAIN_TEXT = re.compile(r"[\n -~À-ÖØ-öø-ÿ]*+")
PLAIN = re.compile(r" [!-~À-ÖØ-öø-ÿ]++(?:\n[!-~À-ÖØ-öø-ÿ]++)*+")
ALL_PLAIN = re.compile(r"(?: [!-~À-ÖØ-öø-ÿ]++(?:\n[!-~À-ÖØ-öø-ÿ]++)*+\t)++")
#: The split pattern built into byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks that are encoded as one text, divided by tabs.
TOGETHER = 1024


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already fill the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=4)
def _ranked(path: str):
    """A rank encoder over the file's vocabulary, or None if the file is not plain byte-level BPE numbered in merge order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    numbers = [model["vocab"].get(a + b, -1) for a, b in pairs]
    if numbers != sorted(set(numbers)) or numbers[0] < 256:
        return None
    # Bytes that print stand for themselves in the vocabulary, the others for the characters from 256 on, in order.
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in prints} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(prints))}
    special = set(_specials(path))
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _whole(path: str):
    """A function from a text to its packed ids, special strings and all, by the library alone."""
    t = tokenizer(path)
    return lambda text: array("I", t.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()


def _packed(path: str):
    """A function from chunks, in which no special string is, to packed ids."""
    alone, fast = _whole(path), _ranked(path)
    tab = fast.encode_ordinary("\t") if fast else []

    def run(texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        if len(tab) == 1 and len(texts) > 1 and ALL_PLAIN.fullmatch("\t".join(texts) + "\t"):
            plain = list(range(len(texts)))
        else:
            plain = [i for i, x in enumerate(texts) if len(tab) == 1 and PLAIN.fullmatch(x)]
            for i in set(range(len(texts))).difference(plain):
                out[i] = alone(texts[i])
        for at in range(0, len(plain), TOGETHER):
            # A tab after each chunk is a token of its own, as no chunk here begins or ends with more white space than its first space.
            part = plain[at : at + TOGETHER]
            ids = np.array(fast.encode_ordinary("".join([texts[i] + "\t" for i in part])), dtype="<u4")
            stops = 4 * np.flatnonzero(ids == tab[0])
            if len(stops) != len(part):
                raise ValueError("tabs did not divide the chunks")
            raw, start = ids.tobytes(), 0
            for i, stop in zip(part, stops.tolist(), strict=True):
                out[i] = raw[start:stop]
                start = stop + 4
        return out

    return run


def document_ids(path: str):
    """A function from texts to packed ids: plain texts in one go by ranks, others by chunks."""
    fast, specials, codes = _ranked(path), _specials(path), chunk_ids(path)

    def one(text: str) -> bytes:
        if fast and PLAIN_TEXT.fullmatch(text) and not any(s in text for s in specials):
            return array("I", fast.encode_ordinary(text)).tobytes()
        return codes.encode(text)

    return lambda texts: list(map(one, texts))


def chunk_ids(path: str) -> ChunkCodes:
    """Packed ids by chunk; one table per worker process."""
    return table(("chunk_ids", path), lambda: ChunkCodes(_packed(path), _specials(path), 400_000, _whole(path)))

