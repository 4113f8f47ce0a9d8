"""Context-free transliteration of characters to ASCII.

ASCII stands for itself and combining marks for nothing.  Latin, Greek, Cyrillic,
Arabic, Hebrew and kana letters follow from their Unicode names and small tables
of letter names.  Ideographs and other scripts need a table: ``install`` takes one
(``onomast.functions.transliteration`` generates it from the ICU library inside
Spark) and then knows those too.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letter names whose sound is not the first part of their name, by script.
_GREEK = {
    "ALPHA": "a", "BETA": "b", "GAMMA": "g", "DELTA": "d", "EPSILON": "e", "ZETA": "z", "ETA": "e", "THETA": "th", "IOTA": "i",
    "KAPPA": "k", "LAMDA": "l", "MU": "m", "NU": "n", "XI": "x", "OMICRON": "o", "PI": "p", "RHO": "r", "SIGMA": "s", "TAU": "t",
    "UPSILON": "u", "PHI": "ph", "CHI": "kh", "PSI": "ps", "OMEGA": "o", "FINAL SIGMA": "s",
}
_CYRILLIC = {
    "A": "a", "BE": "b", "VE": "v", "GHE": "g", "DE": "d", "IE": "e", "IO": "io", "ZHE": "zh", "ZE": "z", "I": "i", "SHORT I": "i",
    "KA": "k", "EL": "l", "EM": "m", "EN": "n", "O": "o", "PE": "p", "ER": "r", "ES": "s", "TE": "t", "U": "u", "EF": "f",
    "HA": "kh", "TSE": "ts", "CHE": "ch", "SHA": "sh", "SHCHA": "shch", "HARD SIGN": "", "YERU": "y", "SOFT SIGN": "", "E": "e",
    "YU": "iu", "YA": "ia", "UKRAINIAN IE": "ie", "BYELORUSSIAN-UKRAINIAN I": "i", "YI": "yi", "JE": "j", "LJE": "lj", "NJE": "nj",
    "DJE": "dj", "TSHE": "c", "DZHE": "dzh", "DZE": "dz", "GHE WITH UPTURN": "g",
}
_ARABIC = {
    "HAMZA": "", "ALEF": "a", "BEH": "b", "TEH": "t", "TEH MARBUTA": "", "THEH": "th", "JEEM": "j", "HAH": "h", "KHAH": "kh",
    "DAL": "d", "THAL": "th", "REH": "r", "ZAIN": "z", "SEEN": "s", "SHEEN": "sh", "SAD": "s", "DAD": "d", "TAH": "t", "ZAH": "z",
    "AIN": "a", "GHAIN": "gh", "FEH": "f", "QAF": "q", "KAF": "k", "LAM": "l", "MEEM": "m", "NOON": "n", "HEH": "h", "WAW": "w",
    "ALEF MAKSURA": "a", "YEH": "y", "FARSI YEH": "y", "KEHEH": "k", "GAF": "g", "PEH": "p", "TCHEH": "ch",
}
_HEBREW = {
    "ALEF": "", "BET": "b", "GIMEL": "g", "DALET": "d", "HE": "h", "VAV": "v", "ZAYIN": "z", "HET": "kh", "TET": "t", "YOD": "y",
    "KAF": "k", "LAMED": "l", "MEM": "m", "NUN": "n", "SAMEKH": "s", "AYIN": "", "PE": "p", "TSADI": "ts", "QOF": "q", "RESH": "r",
    "SHIN": "sh", "TAV": "t",
}
_LATIN = {
    "SHARP S": "ss", "AE": "ae", "OE": "oe", "ETH": "d", "THORN": "th", "DOTLESS I": "i", "KRA": "k", "ENG": "ng", "LONG S": "s",
    "SCHWA": "e", "EZH": "zh", "OPEN E": "e", "OPEN O": "o",
}
_SCRIPTS = (("GREEK", _GREEK), ("CYRILLIC", _CYRILLIC), ("ARABIC", _ARABIC), ("HEBREW", _HEBREW), ("LATIN", _LATIN))
_PUNCTUATION = {"‘": "'", "’": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "–": "-", "—": "-", "−": "-"}

_installed: dict[str, str] = {}


def install(table: dict[str, str]) -> None:
    """Use ``table`` (character -> ASCII) for characters that no rule covers."""
    if table is not _installed:
        _installed.clear()
        _installed.update(table)
        to_ascii.cache_clear()


def _by_name(c: str) -> str | None:
    name = unicodedata.name(c, "")
    for script, letters in _SCRIPTS:
        if name.startswith(script):
            _, _, letter = name.partition("LETTER ")
            letter = letter.removeprefix("SMALL ")
            bare = letter.split(" WITH ")[0]
            sound = letters.get(letter, letters.get(bare.removeprefix("FINAL ")))
            if sound is None and script == "LATIN" and len(bare) == 1:
                sound = bare.lower()
            if sound is not None:
                return sound.capitalize() if "CAPITAL" in name else sound
    if "KATAKANA" in name or "HIRAGANA" in name:
        return name.rpartition(" ")[2].lower()
    return None


@lru_cache(maxsize=1 << 17)
def to_ascii(c: str) -> str:
    """The ASCII string that a character stands for, possibly empty."""
    if c.isascii():
        return c
    if unicodedata.combining(c):
        return ""
    if c in _PUNCTUATION:
        return _PUNCTUATION[c]
    sound = _by_name(c)
    if sound is None:
        sound = _installed.get(c)
    if sound is None:
        plain = unicodedata.normalize("NFKD", c)
        sound = "".join(to_ascii(x) for x in plain) if plain != c else ""
    return sound if sound.isascii() else ""


def ascii_initial(c: str) -> str | None:
    """The first ASCII letter of a character, in upper case."""
    if c.isascii():
        return c.upper() if c.isalpha() else None
    return next((x.upper() for x in to_ascii(c) if x.isalpha()), None)


def ascii_letters(text: str) -> str:
    """All ASCII letters of a text, in lower case."""
    if not text.isascii():
        text = "".join(map(to_ascii, text))
    text = text.lower()
    return text if text.isalpha() else "".join(filter(str.isalpha, text))
