"""Folding of names as people type them, and distances between folded ones."""

from __future__ import annotations

import re
import unicodedata

_SIGNS = re.compile("[™®©℠­]")
_BROKEN = re.compile("[Â-Æ][\u0080-¿Œ-™]")
_HYPHENATED = re.compile(r"(?<=[^\W\d_])-(?=[a-z])")
_APOSTROPHE = re.compile(r"(?<=[^\W\d_])['’](?=[^\W\d_])")
_LEET = str.maketrans("013456@$8", "oieasbasb")
_MIXED = re.compile(r"[^\W\d_]*[013456@$8][^\W_@$]*[013456@$8\w]*")


def repair(t: str) -> str:
    """Undo UTF-8 read as Latin-1, where the text shows it."""
    if _BROKEN.search(t):
        for code in ("latin-1", "cp1252"):
            try:
                return t.encode(code).decode("utf-8")
            except UnicodeError:
                pass
        try:  # piecewise, where other characters stand between
            return re.sub("[\u0080-\u00ff]{2,}", lambda m: m[0].encode("latin-1").decode("utf-8"), t)
        except UnicodeError:
            pass
    return t


def plain(t: str) -> str:
    """Without accents, signs, invisible and control characters, widths; the case is kept."""
    t = unicodedata.normalize("NFKC", _SIGNS.sub("", repair(t)))
    t = "".join(" " if unicodedata.category(c) in ("Cc", "Zl", "Zp", "Zs") else c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) not in ("Mn", "Cf"))
    return " ".join(t.split())


def letters(t: str) -> str:
    """Digits and signs that stand for letters inside a word become letters."""

    def one(m):
        w = m[0]
        return w.translate(_LEET) if sum(c.isalpha() for c in w) >= 2 and not re.fullmatch(r"[^\d@$]*\d+\w?|\d+[^\d@$]*", w) or "@" in w[1:] or "$" in w[1:] else w

    return re.sub(r"[\w@$]+", one, t)


def words(t: str, numbers: bool = True) -> list[str]:
    """Lower-case words and numbers; hyphenation inside a word is undone. Without `numbers` all digits next to letters stand for letters."""
    t = _APOSTROPHE.sub("", _HYPHENATED.sub("", plain(t)))
    if numbers:
        return re.findall(r"[^\W_]+", letters(t).casefold())
    return [w.translate(_LEET) if any(c.isalpha() for c in w) else w for w in re.findall(r"[^\W_]+", re.sub(r"(?<=\w)[@$]|[@$](?=\w\w)", lambda m: "as"["@$".index(m[0])], t).casefold())]


_SOUNDS = (("ph", "f"), ("ck", "k"), ("oo", "u"), ("sh", "s"), ("th", "t"), ("y", "i"), ("z", "s"), ("v", "w"), ("l", "i"), ("j", "i"), ("rn", "m"), ("c", "e"), ("q", "k"))


def skeleton(w: str) -> str:
    """What is left when letters that look or sound alike are made equal and doubled ones single."""
    w = re.sub(r"(.)\1+", r"\1", w)
    for a, b in _SOUNDS:
        w = w.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", w)


def within(a: str, b: str, most: int) -> int:
    """The Damerau-Levenshtein distance of adjacent swaps, or most + 1 if it is greater."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    # Only cells within `most` of the diagonal can hold a distance that counts.
    far, n = most + 1, len(b)
    before, last = None, [j if j <= most else far for j in range(n + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(n, i + most)
        now = [far] * (n + 1)
        now[0] = i if i <= most else far
        least = now[0]
        for j in range(lo, hi + 1):
            y = b[j - 1]
            v = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now[j] = v
            if v < least:
                least = v
        if least > most:
            return far
        before, last = last, now
    return min(last[-1], far)


def deletions(w: str) -> set[str]:
    """The word and what is left without any one of its letters."""
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}
