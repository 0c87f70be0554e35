"""Byte-level BPE files: reading them, and cutting texts into the words that are merged on their own."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import regex

#: The word pattern of byte-level BPE vocabularies.
WORD = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space by the Unicode property; the modules' own \s also holds U+001C to U+001F.
_WIDE = regex.compile(WORD.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s+(?!\S)", r"\p{White_Space}+(?!\P{White_Space})").replace(r"\s+", r"\p{White_Space}+"))
#: Texts of these characters only are cut by the standard module, in half the time; all of the range from U+00C0 but two are letters.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_NARROW_TEXT = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ɏ]*")
_NARROW = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\t-\r {_LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

#: A longer text is cut this many words at a time, so that its list of words stays small.
WORDS_AT_ONCE = 200_000


def words_of(text: str):
    """Lists of the words of a text, in order."""
    cut = _NARROW if _NARROW_TEXT.fullmatch(text) else _WIDE
    if len(text) <= 1_000_000:
        yield cut.findall(text)
        return
    some: list[str] = []
    for m in cut.finditer(text):
        some.append(m.group())
        if len(some) == WORDS_AT_ONCE:
            yield some
            some = []
    yield some


class ByteBpe:
    """Ranks of a byte-level BPE file of the tokenizers library (given as its bytes, so that it can be broadcast)."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["ignore_merges"]:
            raise ValueError("not a plain byte-level BPE file")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens with matching rules are not known here")
        self.added = {t["content"]: t["id"] for t in added}
        self.specials = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if added else None
        vocab, shown = model["vocab"], shown_bytes()
        self.symbol = [vocab[shown[b]] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))

    def plain(self, text: str):
        """(ordinary text, None) and (None, id of an added token), in order."""
        if self.specials is None or "<" not in text and not self.specials.search(text):
            yield text, None
            return
        at = 0
        for m in self.specials.finditer(text):
            yield text[at : m.start()], None
            yield None, self.added[m.group()]
            at = m.end()
        yield text[at:], None


@lru_cache(maxsize=1)
def shown_bytes() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is visible Latin-1, else the next from U+0100."""
    seen = {b: chr(b) for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)}
    hidden = [b for b in range(256) if b not in seen]
    return seen | {b: chr(0x100 + k) for k, b in enumerate(hidden)}
