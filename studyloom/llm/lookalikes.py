"""Characters that look the same: the tables that problems 1, 2, 4, 5 and 8 fold text by."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

# Letters of other scripts that are drawn as the Latin letter in the same place of LATIN.
LATIN = "ABESIJKMHOPCTXYZNaeopcyxsijhvdqwl"
CYRILLIC = "АВЕЅІЈКМНОРСТХҮ··аеорсухѕіјһѵԁԛԝӏ"
GREEK = "ΑΒΕ·Ι·ΚΜΗΟΡ·ΤΧΥΖΝ··ο········ν····"
# Hyphens that are drawn as the ASCII one.
HYPHENS = "‐‑"

SCRIPTS = ("latin", "cyrillic", "greek")
#: Every look-alike with its spelling in each script.
VARIANTS: dict[str, dict[str, str]] = {}
for _l, _c, _g in zip(LATIN, CYRILLIC, GREEK, strict=True):
    _of = {s: x for s, x in zip(SCRIPTS, (_l, _c, _g), strict=True) if x != "·"}
    VARIANTS |= {x: _of for x in _of.values()}
VARIANTS |= dict.fromkeys("µμ", {"latin": "µ", "greek": "μ"})
CONFUSED = {x: of["latin"] for x, of in VARIANTS.items() if x != of["latin"]}
#: Small letters that look like no Latin one but whose capital does, with the small Latin letter of that capital.
CAPITAL_ONLY = {x.lower(): to.lower() for x, to in CONFUSED.items() if x.isupper() and x.lower() not in CONFUSED}


# Characters that cannot be seen, besides those of the categories Cf and Cc.
UNSEEN = "\u034f\u115f\u1160\u3164\uffa0" + "".join(map(chr, range(0xFE00, 0xFE10)))
_LINE_END = regex.compile(rf"\r(?:[\p{{Cf}}{UNSEEN}]*\n)?")


def unify(text: str) -> str:
    """text with one kind of line end (whatever invisible stands within it) and tabs as blanks, all that plain text needs."""
    if "\r" in text:
        text = _LINE_END.sub("\n", text)
    return text.replace("\t", " ") if "\t" in text else text


def _plainer(ch: str) -> str:
    """One character without its width or font; '' for what is invisible."""
    if ch in "\n µ":
        return ch
    if ch in HYPHENS:
        return "-"
    kind = unicodedata.category(ch)
    if ch in "\t" or kind == "Zs":
        return " "
    if kind in ("Zl", "Zp"):
        return "\n"
    if kind in ("Cf", "Cc") or ch in UNSEEN:
        return ""
    tag, _, points = unicodedata.decomposition(ch).partition(" ")
    if tag in ("<wide>", "<narrow>", "<font>") or tag == "<compat>" and kind[0] == "L":
        return "".join(_plainer(chr(int(p, 16))) for p in points.split())
    return ch


class _Plainer(dict):
    def __missing__(self, point: int) -> str:
        out = self[point] = _plainer(chr(point))
        return out


_PLAINER = _Plainer()


def plainer(text: str) -> str:
    """text decomposed, with one kind of blank and line end, without invisible characters, widths, fonts and ligatures."""
    if text.isascii() and "\r" not in text and "\t" not in text:
        return text
    text = unicodedata.normalize("NFD", unify(text)).translate(_PLAINER)
    return unicodedata.normalize("NFD", text)


#: Characters that plain text is made of: ASCII and precomposed Latin letters and marks of Western Europe.
PLAIN = "\\x0A\\x20-\\x7E¡¢£§«¬®°±²³´µ¶·¹º»¼½¾¿À-ÿŒœŸ–—‘’‚“”„†‡•…€"
UNPLAIN = re.compile(f"[^{PLAIN}]")


class _Skeleton(dict):
    def __missing__(self, point: int) -> str:
        out = self[point] = CONFUSED.get(chr(point), chr(point))
        return out


_SKELETON = _Skeleton()


def skeleton(text: str) -> str:
    """What text looks like: equal for two texts exactly when they look the same. Look-alikes become Latin."""
    if not UNPLAIN.search(text):
        return text
    return unicodedata.normalize("NFC", plainer(text).translate(_SKELETON))


@lru_cache(1 << 16)
def script_of(ch: str) -> str | None:
    """The script of a letter that has no look-alike; None for the others and for what is no letter."""
    if ch in VARIANTS or not ch.isalpha():
        return None
    name = unicodedata.name(ch, "").split(" ")[0].lower()
    return name if name in SCRIPTS else "other"


def spell(word: str, context: str) -> str:
    """A plainer() word by table: every look-alike in the script of the word's other letters, in context's where it has none."""
    if word.isascii() and context == "latin":
        return word
    fixed = [script_of(ch) for ch in word]
    scripts = {s for s in fixed if s in SCRIPTS}
    if len(scripts) == 1:
        context = next(iter(scripts))
    out, last = [], next((s for s in fixed if s in SCRIPTS), context)
    for ch, own in zip(word, fixed, strict=True):
        last = own if own in SCRIPTS else last
        of = VARIANTS.get(ch)
        out.append(of.get(last if len(scripts) > 1 else context, of["latin"]) if of else ch)
    return "".join(out)


_CAPITALS = str.maketrans(CAPITAL_ONLY)


def caseless(text: str) -> str:
    """What text looks like whatever its letter case: equal for a letter and its capital, and for all that looks like either."""
    if text.isascii():
        return text.lower()
    low = skeleton(skeleton(text).lower())
    return low if not UNPLAIN.search(low) else unicodedata.normalize("NFD", low).translate(_CAPITALS)
