"""Byte-level BPE by pre-tokens: the library's ids, without running its pre-tokenizer on ordinary text.

The pre-token pattern is the public one of this tokenizer family. Python's ``re`` gives the same pieces as the
library's engine wherever both agree on what a letter, a number and white space are; that holds for characters
that Unicode 3.2 already knew with the class they have now. A text with any other character goes through the
library's own pre-tokenizer.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

# The white space of Unicode that has not changed since version 3.2, as a character class.
SPACE = r"\t-\r \x85\xa0  -     　"
_MOVED = {0x180E}


def _classes() -> tuple[str, str, str]:
    """Character classes of letters, numbers, and everything whose class is certain."""
    old, kinds = unicodedata.ucd_3_2_0, {"L": [], "N": [], "safe": []}
    for point in range(0x10000):
        char = chr(point)
        before, now = old.category(char), unicodedata.category(char)
        same = ("L" if before[0] == "L" else "N" if before[0] == "N" else "") == ("L" if now[0] == "L" else "N" if now[0] == "N" else "")
        if before in ("Cn", "Cs") or not same or point in _MOVED:
            continue
        kinds["safe"].append(point)
        if now[0] in "LN":
            kinds[now[0]].append(point)
    return tuple(_ranges(kinds[k]) for k in ("L", "N", "safe"))


def _ranges(points: list[int]) -> str:
    runs: list[list[int]] = []
    for p in points:
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in vocabularies of this family."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Remembered(dict):
    """A dictionary that fills itself, emptied when ``most`` entries are reached."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class Pieces:
    """Pre-tokens, piece counts and ids of one tokenizer file."""

    #: Pre-tokens whose ids a worker keeps, about 200 bytes each.
    REMEMBER = 600_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["normalizer"]:
            raise ValueError("expected a byte-level BPE file with the plain pattern, no prefix space and no normaliser")
        specials = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self._specials = specials
        self._special_id = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters, numbers, safe = _classes()
        self._find = re.compile(rf" ?[{letters}]+| ?[{numbers}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self._unsafe = re.compile(f"[^{safe}]").search
        self._letters = _byte_letters()
        self._ids = _Remembered(self._piece_ids, self.REMEMBER)

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text that holds no added token."""
        if text.isascii() or not self._unsafe(text):
            return self._find(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def segments(self, text: str) -> tuple[list[str], int]:
        """What stands between added tokens, and how many of these there are."""
        if not any(s in text for s in self._specials):
            return [text], 0
        cut = self._special.split(text)
        return cut[::2], len(cut) // 2

    def _model_tokens(self, pretoken: str):
        return self.tokenizer.model.tokenize(pretoken.encode().decode("latin-1").translate(self._letters))

    def _piece_ids(self, pretoken: str) -> bytes:
        return _packed([t.id for t in self._model_tokens(pretoken)])

    def count(self, pretoken: str) -> int:
        return len(self._model_tokens(pretoken))

    def single(self) -> frozenset[str]:
        """Pre-tokens that are one piece: vocabulary entries that the model itself leaves whole."""
        back = {c: b for b, c in self._letters.items()}
        whole = set()
        for entry in self.tokenizer.get_vocab(with_added_tokens=False):
            try:
                text = bytes(back[c] for c in entry).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if len(self.pretokens(text)) == 1 and self.count(text) == 1:
                whole.add(text)
        return frozenset(whole)

    def ids(self, text: str) -> bytes:
        """All ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self._specials):
            return b"".join(_packed([self._special_id[s]]) if i % 2 else self._plain_ids(s) for i, s in enumerate(self._special.split(text)))
        return self._plain_ids(text)

    def _plain_ids(self, text: str) -> bytes:
        return b"".join(map(self._ids.__getitem__, self.pretokens(text)))


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One instance for each path and process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]
