"""The parts that both word-BPE operators share: vocabulary file, normalisation, pre-tokenisation."""

from __future__ import annotations

import json
import re
from functools import cache
from unicodedata import is_normalized

import regex

#: The split pattern of the vocabulary file, with its white space (``SPACES``) spelled out.
SPACES = r" \t\n\v\f\r\x85\xa0"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+"
#: The same for text of Latin letters alone, where character ranges stand for the classes.
LATIN_LETTERS, LATIN_NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
SPLIT_LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^{SPACES}{LATIN_LETTERS}{LATIN_NUMBERS}]+"
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+"
END = "</w>"

_words = regex.compile(SPLIT).findall
_words_latin = re.compile(SPLIT_LATIN).findall
_words_ascii = re.compile(SPLIT_ASCII).findall
_latin = re.compile(r"[\x00-ɏ‐-‧‰-⁞₠-₿]*").fullmatch
#: Scripts whose letters and digits have the same classes in every Unicode version that is in use.
_settled = re.compile(r"[\x00-ɏΑ-ΡΣ-ωЀ-џḀ-ỿ‐-‧‰-⁞₠-₿、-〩ぁ-ゖァ-ヺ一-龥가-힣]*").fullmatch


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in chars:
            chars[b] = chr(256 + len(chars) - len(plain))
    return [chars[b] for b in range(256)]


class Vocabulary:
    """Merge ranks, ids and added tokens of a word-BPE file, and its text splitting."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.ids: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks: dict[tuple[str, str], int] = {pair: rank for rank, pair in enumerate(merges)}
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if longest_first else None
        self.chars = byte_chars()
        self._library = None

    @property
    def library(self):
        """The library's tokenizer, for its normaliser and splitter on scripts outside the settled ones."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def symbols(self, word: str) -> list[str]:
        """Start symbols of a pre-token: one per byte, the last one marked as word end."""
        out = [self.chars[b] for b in word.encode("utf-8")]
        if out:
            out[-1] += END
        return out

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens, as plain text."""
        if text.isascii():
            return _words_ascii(text.lower())
        if is_normalized("NFC", text):
            low = text.lower()
            if _latin(low):
                return _words_latin(low)
            if "Σ" not in text and _settled(low):  # lower() looks at the context of this letter alone
                return _words(low)
        normal = self.library.normalizer.normalize_str(text)
        if _settled(normal):
            return _words(normal)
        back = {c: b for b, c in enumerate(self.chars)}
        return [bytes(back[c] for c in piece).decode("utf-8") for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def pieces(self, text: str):
        """(words, added id or None) for each stretch between added tokens."""
        if self.cut_added is None or "<|" not in text:
            yield self.words(text), None
            return
        parts = self.cut_added(text)
        for k in range(0, len(parts), 2):
            yield self.words(parts[k]), (self.added[parts[k + 1]] if k + 1 < len(parts) else None)


@cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and file."""
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memo(dict):
    """A bounded memo of two generations: when the newer is full it becomes the older, which is then dropped.

    Keys that are in use move to the newer one, so a vocabulary larger than the limit does not push out its
    frequent part. At most twice ``limit`` keys of up to 64 symbols are held.
    """

    def __init__(self, compute, limit: int):
        super().__init__()
        self._compute, self._limit, self._old = compute, limit, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
        if len(key) <= 64:
            if len(self) >= self._limit:
                self._old = dict(self)
                self.clear()
            self[key] = value
        return value
