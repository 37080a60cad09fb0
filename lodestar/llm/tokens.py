"""Token ids of whole texts, as the tokenizers library gives them, with a cache of words.

A text is cut before each single space, which both supported vocabularies split at in any
context, so the ids of a text are those of its chunks. Each distinct chunk is encoded once
for each Python worker. A text where a cut could matter (white space beside the space, a
special token's string) is encoded whole by the tokenizers library.

New chunks of plain Latin letters go through a second, faster program with the same merges:
a token's id is its merge rank in both files, so the lowest-ranked pair is merged first
either way. tests/llm/test_tokens.py compares the two on every text. All other chunks go to
the tokenizers library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .common import worker_cache

#: Distinct chunks a worker keeps; then it starts anew.
CACHED = 800_000


def default_path(name: str) -> str:
    """The vocabulary file's place on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Uncut(Exception):
    """White space lies beside a space, so the cut there may matter."""


class Chunks(dict):
    """The ids of each chunk; a new one is encoded when first asked for."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        if chunk:
            body = chunk.removeprefix(" ")
            if not self.encoder.words and chunk[0] == " " and (not body or body[0].isspace()):
                raise Uncut
        ids = self.encoder.fast(chunk)
        self[chunk] = out = self.encoder.whole(chunk) if ids is None else np.array(ids, dtype="<u4").tobytes()
        return out


class Encoder:
    """Encodes texts with one tokenizer file. ``ids(texts)``: little-endian unsigned 32-bit ids of each text.

    Null and empty texts have no ids. ``plain_specials``: strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False, fast: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])  # the largest id
        self.words = spec["model"].get("end_of_word_suffix") == "</w>"  # else byte-level with spaces kept
        self.cache = Chunks(self)
        self.fast = self._word_merges(spec) if self.words else self._byte_merges(spec)
        if not fast:
            self.fast = lambda chunk: None

    def _byte_merges(self, spec):
        import tiktoken

        of = _byte_chars()
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        odd = re.compile("[^\n -~¡-ſ]").search
        return lambda chunk: None if odd(chunk) else encode(chunk)

    def _word_merges(self, spec):
        import tiktoken

        of, end = _byte_chars(), b"\xff"  # no UTF-8 text holds this byte: it stands for the end of a word
        ranks = {}
        for t, i in spec["model"]["vocab"].items():
            if t not in self.specials:
                ranks[bytes(of[c] for c in t.removesuffix("</w>")) + end * t.endswith("</w>")] = i
        encode = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        odd = re.compile("[^\n!-~À-ÿ]").search
        pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+").findall
        return lambda chunk: None if odd(chunk) else [i for p in pieces(chunk.lower()) for i in encode(p.encode() + end)]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHED:
            self.cache.clear()
        get, out = self.cache.__getitem__, []
        for t in texts:
            if any(s in t for s in self.specials) or (not self.words and "\0" in t):
                out.append(self.whole(t))
                continue
            try:
                out.append(b"".join(map(get, t.split(" ") if self.words else t.replace(" ", "\0 ").split("\0"))))
            except Uncut:
                out.append(self.whole(t))
        return out


def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """The worker's encoder of this file."""
    held = worker_cache("encoders", dict)
    key = (path, plain_specials)
    if key not in held:
        held[key] = Encoder(path, plain_specials)
    return held[key]
