"""Byte-level BPE in a Python worker, each distinct pre-token encoded once.

A byte-level BPE never merges across pre-tokens, and a pre-token alone is split
like in its text, so a text's ids are the ids of its pre-tokens in a row. Each
distinct pre-token goes through the tokenizers library once per worker; the memo
is bounded and starts anew when full, which costs time and changes nothing.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .common import holds_memory, use_memory

#: Most pre-tokens in the memo.
MEMO = 150_000
#: Pre-tokens of Latin-1 texts; other texts take the library's own splitter.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_alphabet() -> dict[int, str]:
    """Byte to the letter that stands for it in byte-level vocabularies: visible
    Latin-1 characters stand for themselves, the others for 256, 257, ..."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Memo(dict):
    """Ids of a pre-token, packed (bytes need no garbage collection), from the
    library's merge model alone: the rest of its chain has nothing to do on a
    single pre-token and costs four times as much."""

    def __init__(self, tok, kind: str):
        super().__init__()
        self.model, self.kind = tok.model, kind
        self.alphabet = byte_alphabet()

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= MEMO:
            self.clear()
        spelled = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
        ids = self[word] = array(self.kind, [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return ids


class PretokenEncoder:
    """packed() and encode() give the ids that Tokenizer.encode(add_special_tokens=False)
    gives, packed as unsigned integers of 16 bits (32 for vocabularies over 65,536)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        #: Whether splitting into pre-tokens is safe for this tokenizer.
        self.splits = spec.get("normalizer") is None and spec.get("post_processor") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["model"].get("dropout")
        added = spec.get("added_tokens") or []
        self.plain = not any(a.get(k) for a in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
        self.special = {a["content"]: a["id"] for a in added}
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self.kind, self.dtype = ("H", "<u2") if self.vocab <= 1 << 16 else ("I", "<u4")
        self.memo = _Memo(self.tok, self.kind)

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def has_special(self, text: str) -> bool:
        return bool(self.special_at and self.special_at.search(text))

    def scan(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        return LATIN.findall(text)

    def packed(self, text: str) -> bytes:
        if not self.splits or self.has_special(text):
            return array(self.kind, self.whole(text)).tobytes()
        return b"".join(map(self.memo.__getitem__, self.scan(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=self.dtype).tolist()


_ENCODERS: dict[str, PretokenEncoder] = {}
holds_memory("tokens", lambda: [e.memo.clear() for e in _ENCODERS.values()])


def encoder(path: str) -> PretokenEncoder:
    """One encoder per worker and vocabulary file."""
    use_memory("tokens")
    if path not in _ENCODERS:
        _ENCODERS[path] = PretokenEncoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
