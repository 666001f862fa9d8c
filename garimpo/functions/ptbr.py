"""Portuguese numbers: words, decimals and fractions, in plain Python for use inside pandas UDFs."""

from __future__ import annotations

import re
import unicodedata

# Number words, accents stripped.
UNITS = {"um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10, "onze": 11, "doze": 12, "treze": 13, "catorze": 14, "quatorze": 14, "quinze": 15, "dezesseis": 16, "dezessete": 17, "dezoito": 18, "dezenove": 19}
TENS = {"vinte": 20, "trinta": 30, "quarenta": 40, "cinquenta": 50, "sessenta": 60, "setenta": 70, "oitenta": 80, "noventa": 90}
HUNDREDS = {"cem": 100, "cento": 100, "duzentos": 200, "duzentas": 200, "trezentos": 300, "trezentas": 300, "quatrocentos": 400, "quinhentos": 500}

_U, _T, _H = ("(?:" + "|".join(sorted(d, key=len, reverse=True)) + ")" for d in (UNITS, TENS, HUNDREDS))
#: A number in words, lower case and without accents.
WORDS = rf"(?:{_H}(?:\s+e\s+{_T})?(?:\s+e\s+{_U})?|{_T}(?:\s+e\s+{_U})?|{_U})"
#: A number in digits: 1.440 and 1440, 1,5 and 1.5, 1 1/2 and 1/2.
DIGITS = r"(?:\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+\s+\d/\d+|\d+/\d+|\d+(?:[.,]\d+)?)"


def plain(text: str) -> str:
    """Lower case, without accents, blanks collapsed."""
    folded = unicodedata.normalize("NFKD", text.replace("º", "o ").replace("ª", "a ")).lower()
    return re.sub(r"\s+", " ", "".join(c for c in folded if not unicodedata.combining(c))).strip()


def number(text: str) -> float | None:
    """The value of a match of WORDS or DIGITS; meio and meia are a half."""
    t = text.strip()
    if t in ("meio", "meia"):
        return 0.5
    if re.fullmatch(r"\d{1,3}(\.\d{3})+(,\d+)?", t):
        return float(t.replace(".", "").replace(",", "."))
    if m := re.fullmatch(r"(?:(\d+)\s+)?(\d+)/(\d+)", t):
        return int(m[1] or 0) + int(m[2]) / int(m[3]) if int(m[3]) else None
    if re.fullmatch(r"\d+([.,]\d+)?", t):
        return float(t.replace(",", "."))
    values = [{**UNITS, **TENS, **HUNDREDS}.get(w) for w in t.split() if w != "e"]
    return float(sum(values)) if values and None not in values else None
