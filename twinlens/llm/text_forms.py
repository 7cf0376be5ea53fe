"""Forms of a text in which writing differences disappear."""

from __future__ import annotations

import json
import unicodedata
from decimal import Decimal, InvalidOperation

# Cyrillic and Greek letters that look like the Latin letter after them.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ɡ": "g",
}
_LOOK = {ord(k): v for k, v in LOOKALIKES.items()}


def plain(text: str) -> str:
    """Latin look of a text: compatibility forms, look-alike letters and accents folded, invisible characters dropped; case is kept."""
    if text.isascii():
        return text
    out = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).translate(_LOOK))
    return "".join(c for c in out if unicodedata.category(c) not in ("Mn", "Me", "Cf"))


#: Full-width forms of the ASCII characters.
_NARROW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}


def letters_and_digits(text: str) -> str:
    """The sequence of letters and digits: case, white space, punctuation and invisible characters gone, accents kept, composed, decomposed and full-width forms equal. Ligatures, raised digits, fractions and other compatibility forms stay letters and digits of their own."""
    if text.isascii():
        return "".join(filter(str.isalnum, text.lower()))
    folded = unicodedata.normalize("NFC", text.translate(_NARROW)).lower().replace("ς", "σ")
    return unicodedata.normalize("NFC", "".join(c for c in folded if unicodedata.category(c)[0] in "LN" or (unicodedata.category(c) in ("Mn", "Mc") and not 0xFE00 <= ord(c) <= 0xFE0F)))


def _number(x: str) -> str:
    """The value of a number's text: 1, 1.0 and 10e-1 are one number, whatever their length."""
    sign, digits, power = Decimal(x).as_tuple()
    short = "".join(map(str, digits)).strip("0")
    zeros = len(digits) - len("".join(map(str, digits)).rstrip("0"))
    return f"{'-' if sign else ''}{short}e{power + zeros}" if short else "0"


def _value(v: object) -> object:
    """Every value with its type: numbers by value, texts marked as texts."""
    if isinstance(v, dict):
        return {k: _value(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_value(x) for x in v]
    if isinstance(v, _Number):
        return "#" + v.value
    return "s" + v if isinstance(v, str) else v


class _Number:
    def __init__(self, text: str):
        self.value = _number(text)


def _no_json(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def canonical_json(text: str | None) -> str | None:
    """One writing for all JSON texts with the same keys and values; a text that is no JSON stands for itself; NULL stays NULL."""
    if text is None:
        return None
    try:
        return "j" + json.dumps(_value(json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_no_json)), sort_keys=True, ensure_ascii=True, separators=(",", ":"))
    except (ValueError, InvalidOperation, RecursionError):
        return "t" + text
