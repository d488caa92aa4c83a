"""Characters that look alike, and characters that do not show: fixed values shared by the operators of this subpackage."""

from __future__ import annotations

import unicodedata

#: Letters that look the same in Latin, Greek and Cyrillic type; the first of each group stands for it where one must.
LOOKALIKES = """
aаα cсϲ dԁ eе hһ iіι jјϳ kκ lӏ oоοօ pрρ qԛ sѕ uυ vνѵ wԝω xхχ yуγ
AАΑ BВΒ CСϹ EЕΕ FϜ GԌ HНΗ IІΙӀ JЈͿ KКΚ MМΜ NΝ OОΟՕ PРΡ QԚ SЅ TТΤ VѴ WԜ XХΧ YҮΥ ZΖ
""".split()
#: Accented letters that Latin and Cyrillic share, as composed characters.
ACCENTED = "ëё ïї ËЁ ÏЇ èѐ ÈЀ".split()

#: Invisible characters (besides those of Unicode's category Cf, and variation selectors).
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
#: Hyphens that look like the ASCII one.
HYPHENS = "‐‑­"


def invisible(ch: str) -> bool:
    return ch in INVISIBLE or "︀" <= ch <= "️" or unicodedata.category(ch) == "Cf"


def hidden_class() -> str:
    """The invisible characters as a class for a regular expression."""
    runs, start = [], None
    for o in range(0x80, 0xE0200):
        if 0xD800 <= o < 0xE000 or 0x20000 <= o < 0xE0000 or not invisible(chr(o)):
            if start is not None:
                runs.append((start, o - 1))
                start = None
        elif start is None:
            start = o
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"


def _alike() -> dict[str, str]:
    return {ch: group[0] for group in [*LOOKALIKES, *ACCENTED] for ch in group}


#: Character -> the representative of its look-alikes.
PROTOTYPE = _alike()


def _caseless() -> dict[int, str]:
    """Look-alikes closed under case: what looks alike as capitals is one letter as small letters too."""
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.get(c, c) != c:
            c = root[c]
        return c

    for group in [*LOOKALIKES, *ACCENTED]:
        folded = sorted({c.casefold() for c in group if len(c.casefold()) == 1})
        for c in folded[1:]:
            a, b = sorted((find(folded[0]), find(c)))
            root[b] = a
    return {ord(c): find(c) for c in root}


CASELESS = _caseless()


def match_form(word: str) -> str:
    """A form of a word that is equal for all spellings that look alike, whatever the case, width, composition or invisible characters."""
    w = unicodedata.normalize("NFKC", word)
    if not w.isascii():
        w = "".join(c for c in w if not invisible(c))
    return unicodedata.normalize("NFC", w.casefold()).translate(CASELESS).replace("_", "")


def script(ch: str) -> str:
    """L, G or C for a Latin, Greek or Cyrillic letter; empty for anything else."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0xA720 <= o < 0xA800:
        return "L" if ch.isalpha() else ""
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G" if ch.isalpha() else ""
    return "C" if (0x400 <= o < 0x530 or 0x1C80 <= o < 0x1C90) and ch.isalpha() else ""


#: Character -> its look-alikes by script.
IN_SCRIPT = {c: {script(x): x for x in reversed(group)} for group in [*LOOKALIKES, *ACCENTED] for c in group}


def one_script(word: str) -> str:
    """A word of several scripts in the one that most of its distinctive letters have, as far as look-alikes exist."""
    scripts = [script(c) for c in word]
    if len({x for x in scripts if x}) < 2:
        return word
    own = [x for c, x in zip(word, scripts) if x and c not in IN_SCRIPT] or [x for x in scripts if x]
    want = max(sorted(set(own)), key=own.count)
    return "".join(IN_SCRIPT[c].get(want, c) if c in IN_SCRIPT else c for c in word)
