"""Exact, memoised encoding with a tokenizer file of the tokenizers library.

``Encoder(path).ids(text)`` equals
``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``
(truncation and padding off).  Where the file drops white space and encodes
each pre-token on its own (lower-casing BPE with word ends), repeated
pre-tokens are looked up instead of encoded again; texts or words outside a
set of characters on which normalising is plain lower-casing go through the
library whole.  Any other file is always encoded by the library.

The memo is per worker process, bounded by ``MEMO`` entries; when full, the
newer half (the rarer words) is dropped.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

MEMO = 700_000

# The normaliser and pre-tokeniser for which the memo is exact.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# ASCII and the precomposed Latin-1 letters: NFC leaves them alone.
_PLAIN_TEXT = re.compile(r"[\x09-\x0D\x20-~À-ÖØ-öø-ÿ]*").fullmatch
_PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0D\x20a-z0-9ß-öø-ÿ]+").findall


def _byte_letters() -> dict[int, str]:
    """The two byte-level letters of each Latin-1 letter."""
    from tokenizers.pre_tokenizers import ByteLevel

    level = ByteLevel(add_prefix_space=False, use_regex=False)
    return {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}


class _Memo(dict):
    def __init__(self, model, dtype) -> None:
        super().__init__()
        self._model, self._dtype, self._letters = model, dtype, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        ids = [t.id for t in self._model.tokenize(word.translate(self._letters))]
        out = self[word] = np.array(ids, self._dtype).tobytes()
        return out

    def trim(self) -> None:
        if len(self) > MEMO:
            for word in list(self)[MEMO // 2 :]:
                del self[word]


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_words = (
            spec.get("normalizer") == _NORMALIZER
            and spec["model"]["type"] == "BPE"
            and spec["model"].get("dropout") is None
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["pattern"] == {"Regex": _SPLIT}
            and steps[0]["behavior"] == "Removed"
            and steps[0]["invert"]
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
        )
        self._special = [t["content"] for t in spec.get("added_tokens") or []]
        self._marks = {s[:1] for s in self._special}
        self._memo = _Memo(self.tokenizer.model, self.dtype)

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def packed(self, text: str) -> bytes:
        """The ids as little-endian integers of ``dtype``."""
        if not self.by_words:
            return self._library(text)
        if _PLAIN_TEXT(text) and not any(s in text for s in self._special):
            memo = self._memo
            memo.trim()
            return b"".join(map(memo.__getitem__, _PRETOKENS(text.lower())))
        # Words cut at ASCII white space are encoded independently.
        words = re.split(r"[\x09-\x0D\x20]+", text)
        if len(words) == 1:
            return self._library(text)
        return b"".join(self.packed(w) for w in words if w)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
