"""The Porter2 (English Snowball) stemmer, from its published definition."""

from __future__ import annotations

import re

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Fixed values of the published algorithm: words with stems of their own, and words that step 1a leaves final.
_WORDS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_FINAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Fixed values of the published algorithm: endings and what replaces them, steps 2 and 3; endings that step 4 drops.
_STEP2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _regions(word: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.compile(f"[{_V}][^{_V}]").search(word, start)
        return m.end() if m else len(word)

    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = after(0) if first is None else first
    return r1, after(r1)


def _short_end(word: str) -> bool:
    return bool(re.search(rf"[^{_V}][{_V}][^{_V}wxY]$", word) or re.fullmatch(rf"[{_V}][^{_V}]", word))


def stem(word: str) -> str:
    word = word.lower().replace("’", "'")
    if len(word) <= 2:
        return word
    if word in _WORDS:
        return _WORDS[word]
    word = re.sub(rf"(^|[{_V}])y", r"\1Y", word.lstrip("'"))
    r1, r2 = _regions(word)
    word = re.sub(r"('s'|'s|')$", "", word)
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_V}]", word[:-2]):
        word = word[:-1]
    if word in _FINAL:
        return word
    # 1b
    if word.endswith(("eedly", "eed")):
        cut = 5 if word.endswith("eedly") else 3
        if len(word) - cut >= r1:
            word = word[:-cut] + "ee"
    else:
        ending = next((e for e in ("ingly", "edly", "ing", "ed") if word.endswith(e)), None)
        if ending and re.search(f"[{_V}]", word[: -len(ending)]):
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLE):
                word = word[:-1]
            elif _short_end(word) and r1 >= len(word):
                word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _V:
        word = word[:-1] + "i"
    # 2
    ending = next((e for e in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True) if word.endswith(e)), None)
    if ending and len(word) - len(ending) >= r1:
        if ending == "ogi":
            word = word[:-1] if word[-4:-3] == "l" else word
        elif ending == "li":
            word = word[:-2] if word[-3:-2] in tuple("cdeghkmnrt") else word
        else:
            word = word[: -len(ending)] + _STEP2[ending]
    # 3
    ending = next((e for e in sorted([*_STEP3, "ative"], key=len, reverse=True) if word.endswith(e)), None)
    if ending and len(word) - len(ending) >= r1:
        if ending == "ative":
            word = word[:-5] if len(word) - 5 >= r2 else word
        else:
            word = word[: -len(ending)] + _STEP3[ending]
    # 4
    ending = next((e for e in sorted([*_STEP4, "ion"], key=len, reverse=True) if word.endswith(e)), None)
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(ending)]
    # 5
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_end(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
