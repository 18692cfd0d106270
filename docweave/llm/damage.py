"""Undoing what scanning and wrong encodings do to words.

``skeleton`` maps a word and its usual misreadings to one form: accents are
dropped, letters that scanners mix up share a letter. ``repaired`` undoes
UTF-8 text that was read as a single-byte encoding, once or twice.
"""

from __future__ import annotations

import re
import unicodedata

#: Bytes 0x80 to 0xFF as Windows-1252 (else Latin-1) and Windows-1250 show them.
_WEST = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0x100)]
_EAST = [bytes([b]).decode("cp1250", "ignore") or chr(b) for b in range(0x80, 0x100)]
#: Western letters that were read as Central European ones.
EAST_TO_WEST = {ord(e): w for e, w in zip(_EAST, _WEST) if e != w and e not in _WEST}

_TO_BYTE = {c: b for b, c in enumerate(_WEST, 0x80)} | {chr(b): b for b in range(0x80, 0x100)}
_HIGH = "".join(re.escape(c) for c in _TO_BYTE)
#: A lead byte and its continuation bytes as single-byte characters; a lost byte stands as U+FFFD.
_SEQUENCE = re.compile(f"[\u00c2-\u00f4][{_HIGH}\ufffd]{{1,3}}")
_TELLTALE = re.compile("[ÃÂâÅï][\u0080-\u00bf\u2013-\u203a\u0152-\u017e\u02c6\u02dc\u20ac\u2122\u0192\ufffd]|Ã.")

#: Single characters that scanners mix up, and pairs read as one letter.
_ALIKE = str.maketrans({"0": "o", "1": "l", "|": "l", "i": "l", "!": "l", "5": "s", "8": "b", "h": "b", "c": "e", "ø": "o", "œ": "oe", "æ": "ae", "ß": "ss"})
_PAIRS = (("rn", "m"), ("vv", "w"), ("ll", "u"))


def _decode_run(match: re.Match) -> str:
    text = match[0]
    out, at = [], 0
    while at < len(text):
        lead = _TO_BYTE.get(text[at], 0)
        need = 1 if 0xC2 <= lead < 0xE0 else 2 if 0xE0 <= lead < 0xF0 else 3 if 0xF0 <= lead < 0xF5 else 0
        tail = text[at + 1 : at + 1 + need]
        if need and len(tail) == need:
            try:
                out.append(bytes([lead, *(_TO_BYTE[c] for c in tail)]).decode("utf-8"))
                at += 1 + need
                continue
            except (KeyError, UnicodeDecodeError):
                if need == 1 and tail == "\ufffd":
                    out.append("\ufffd")
                    at += 2
                    continue
        out.append(text[at])
        at += 1
    return "".join(out)


def looks_damaged(text: str) -> bool:
    return _TELLTALE.search(text) is not None


def repaired(text: str) -> str:
    """``text`` with doubly read UTF-8 undone, at most twice."""
    for _ in range(2):
        if not _TELLTALE.search(text):
            break
        text = _SEQUENCE.sub(_decode_run, text)
    return text


def plain(word: str) -> str:
    """Lower case without accents; a lost character stays as U+FFFD."""
    word = word.lower()
    if word.isascii():
        return word
    word = word.translate(EAST_TO_WEST)
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def skeleton(word: str) -> str:
    word = plain(word).translate(_ALIKE)
    for pair, one in _PAIRS:
        word = word.replace(pair, one)
    return word


def run_together(a: str, b: str) -> str:
    """The skeleton of two words without the blank between them, from their skeletons."""
    word = a + b
    for pair, one in _PAIRS:
        word = word.replace(pair, one)
    return word


def near(a: str, b: str) -> bool:
    """At most one edit apart (two in words of nine or more letters).

    U+FFFD and ``?`` in ``a`` stand for any character. Words with digits are
    near only if equal up to lost characters.
    """
    if a == b:
        return True
    if ("\ufffd" in a or "?" in a) and len(a) == len(b):
        if all(x == y or x in "\ufffd?" for x, y in zip(a, b)):
            return True
    if min(len(a), len(b)) < 4 or any(c.isdigit() for c in b):
        return False
    most = 2 if min(len(a), len(b)) >= 9 else 1
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y and x not in "\ufffd?"))
        if min(row) > most:
            return False
    return row[-1] <= most


class NearWords:
    """Words of a fixed vocabulary near a given word, found by their deletions."""

    def __init__(self, words: list[str]):
        self.words = words
        self._by: dict[str, list[int]] = {}
        for n, w in enumerate(words):
            for key in self._keys(w):
                self._by.setdefault(key, []).append(n)
        self._lengths = {len(w) for w in words}

    @staticmethod
    def _keys(word: str) -> set[str]:
        """The word's halves: two words one edit apart share the start or the end."""
        half = len(word) // 2
        if len(word) < 6:
            return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}
        return {"<" + word[:3], word[-3:] + ">", f"{word[half - 1:half + 2]}={half}"}

    def near(self, word: str) -> list[int]:
        keys = self._keys(word)
        if len(word) >= 6:
            half = len(word) // 2
            keys |= {f"{word[half - 2:half + 1]}={half - 1}", f"{word[half:half + 3]}={half + 1}"}
        if 5 <= len(word) <= 7:
            keys |= {word, *(word[:i] + word[i + 1 :] for i in range(len(word))), "<" + word[:3], word[-3:] + ">"}
        found = {n for k in keys for n in self._by.get(k, ())}
        return sorted(n for n in found if near(word, self.words[n]))
