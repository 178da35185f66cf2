"""Labelled spans for the PII model: patterns that mark the spans of training texts.

They are used only to train and to measure the model (``python -m vellum.llm.pii_train``), never to find anything in a query.
"""

from __future__ import annotations

import re

from vellum.llm.pii import fold

# Syllables and endings of the invented names of the training texts.
_FORE = "Ash Bel Bran Cor Dri Eld Fen Gar Hol Jor Kam Lun Mar Mir Nil Ost Pas Quel Rand Rok Sev Tam Tiv Tor Ulf Ves Vin Wen Yar Zel".split()
_FIRST_END = "a al el en et ey ik ine is o us".split()
_LAST_END = "ander arsen oby ekker etti hurst ikov mont ovar stad ulin wick".split()
_ARABIC = "هل تم شو لم غا كر نو را صا بي زي في دا ري وس".split()

_TLD = r"(?:example|test|invalid)"
_AT = r"(?: ?@ ?| ?\(at\) ?| ?\[at\] ?| at )"
_DOT = r"(?:\.| ?\[dot\] ?| ?\(dot\) ?| dot )"
_EMAIL = re.compile(rf"(?<![\w.+\-])[a-z][\w.+\-]*{_AT}(?:[a-z][a-z\-]*{_DOT})+{_TLD}(?!\w)", re.I)
_PHONE = re.compile(r"(?<![\w+(])(?:\+ ?999|00999|\(?0\d)[\d .\-/()]*?5[ .\-]?5[ .\-]?5[ .\-]?0[ .\-]?1[ .\-]?\d[ .\-]?\d(?!\d)")
_ID = re.compile(r"(?<![\w\-])(?:ZZ\d\d(?: ?\d{4}){3} ?\d{0,4}(?: ?\d{1,2})?|AX\d{7}|X\d{4} ?\d{4} ?\d{3}|IDN-\d{10}|\d{4} \d{4} \d{4}|\d{3}-\d\d-\d{4}|\d{11})(?![\w\-])")
_STREETS = (
    r"(?<![\w:.\-])(?:Flat \d+, )?\d+[A-Z]? (?:(?:Old|New|Upper|Lower|[NSEW]\.) )?[A-Z][a-z]+ (?:Street|St|Road|Rd|Lane|Ln|Row|Close|Avenue|Ave)\b",
    r"(?<![\w:.\-])\d+(?: bis| ter)?,? (?:rue|place|avenue|quai|impasse|all[eé]e|cours|boulevard|chemin) (?:de la |de |des |du |d')",
    r"(?<![\w\-])[A-ZÄÖÜ][a-zäöüß]+(?:str\.|strasse|straße|gasse|platz|allee|weg|damm|ufer) \d+[a-z]?(?!\w)",
    r"(?<!\w)(?:شارع [ء-ي]+ \d+|زقاق [ء-ي]+[،,] بيت \d+|(?<![\d.])\d+ (?:شارع|زقاق) [ء-ي]+)",
)
_ADDRESS = re.compile("|".join(_STREETS))
_F = "|".join(_FORE)
_f = _F.lower()
_first = rf"(?:{_F})(?:{_f}){{0,2}}(?:{'|'.join(_FIRST_END)})"
_last = rf"(?:{_F})(?:{_f})?(?:{'|'.join(_LAST_END)})"
_lasts = rf"{_last}(?:-{_last})?"
_person = rf"(?:{_first}(?: [A-Z]\.)? {_lasts}|{_lasts}, {_first}|(?<!\w)[A-Z]\. {_lasts}|{_lasts}, [A-Z]\.)"
_up = lambda s: re.sub(r"[a-z]+(?![a-z]*\])", lambda m: m.group().upper(), s)
_ar = rf"(?:{'|'.join(_ARABIC)})"
_ar_end = "(?:ن|ت|ا|ات|و|م|ي|اي|ان|ين|ون|يت|يي|وي|من|لي|مي)?"
_ARABIC_NAME = re.compile(rf"(?<![\wء-ي]){_ar}{{1,4}}{_ar_end} (?:ال)?{_ar}{{2,4}}{_ar_end}(?![\wء-ي])|(?<![\wء-ي])(?:ال)?{_ar}{{2,4}}{_ar_end}[،,] {_ar}{{1,4}}{_ar_end}(?![\wء-ي])")
_NAME = re.compile(rf"(?<![\w\-]){_person}(?![\w\-])")
_CAPS = re.compile(rf"(?<![\w\-]){_up(_person)}(?![\w\-])")


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each labelled span, in characters of the raw text; no two overlap."""
    s, at = fold(text)
    out = []

    def add(kind, a, b):
        if all(b <= x or a >= y for _, x, y in out):
            out.append((kind, a, b))

    for m in _EMAIL.finditer(s):
        add("email", m.start(), m.end())
    for m in _PHONE.finditer(s):
        d = re.sub(r"\D", "", m.group())
        if "55501" in d and 9 <= len(d) <= 15:
            add("phone", m.start(), m.end())
    for m in _ID.finditer(s):
        if not re.search(r"(ISBN|acc\W*no|MS|shelf|Signatur|Cote|Call number)\W*$", s[max(0, m.start() - 14) : m.start()]):
            add("idnum", m.start(), m.end())
    for m in _ADDRESS.finditer(s):
        end = m.end()
        if s[end - 1] in " '":
            w = re.match(r"[A-Z][\w\-]*", s[end:])
            end += w.end() if w else 0
        add("address", m.start(), end)
    for r in (_NAME, _CAPS, _ARABIC_NAME):
        for m in r.finditer(s):
            a = m.start()
            if s[a : a + 3] == "M. " and s[m.end() : m.end() + 9] == " signale ":
                a += 3
            add("name", a, m.end())
    return sorted(((k, int(at[a]), int(at[b - 1]) + 1) for k, a, b in out), key=lambda x: x[1])
