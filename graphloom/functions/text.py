"""Text functions: tokens, folding, excerpts, similarity, truncation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: accented letters and what they fold to, in step
ACCENTS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿœæ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyyoa"


def fold(text: Column) -> Column:
    """Lower case without accents; sharp s becomes ss."""
    return F.replace(F.translate(F.lower(text), ACCENTS, FOLDED), F.lit("ß"), F.lit("ss"))


def code_tokens(text: Column) -> Column:
    """Tokens of identifiers: camel case apart, folded, split at all but letters and digits."""
    apart = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(fold(apart), "[^a-z0-9]+"), lambda t: t != "")


def word_tokens(text: Column) -> Column:
    """Tokens of prose: folded, split at all but letters and digits."""
    return F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda t: t != "")


def fields(text: Column) -> Column:
    """White-space separated parts; none of an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def word_set(text: Column) -> Column:
    """Distinct lower-case words of more than two bytes."""
    return F.array_distinct(F.filter(fields(F.lower(text)), lambda w: F.octet_length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def truncate(text: Column, most: int) -> Column:
    """The first ``most`` characters."""
    return F.substring(text, 1, most)


def ellipsis(text: Column, most: int) -> Column:
    """The first ``most`` characters and three dots, where there are more."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def ellipsis_bytes(text: Column, most: int) -> Column:
    """The first ``most`` bytes of UTF-8, whole characters only, and three dots, where there are more."""
    raw = F.encode(text, "UTF-8")
    # after the cut at most three bytes of a divided character stand at the end
    cut = [F.substring(raw, 1, most - k) for k in range(4)]
    whole = F.coalesce(*(F.try_validate_utf8(c.cast("string")) for c in cut))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(whole, F.lit("...")))


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes."""
    return F.floor(F.octet_length(text) / 4).cast("int")


def count_lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def excerpt(body: Column, start_line: Column, line: Column, around: int = 3) -> Column:
    """Lines of a body about an absolute line, ``around`` on either side; null outside of the body."""
    lines = F.split(body, "\n")
    at = line - start_line + 1
    low = F.greatest(F.lit(1), at - around)
    high = F.least(F.size(lines), at + around)
    return F.when((at >= 1) & (at <= F.size(lines)), F.array_join(F.slice(lines, low, high - low + 1), "\n"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def bare_signature(signature: Column, nesting: int = 4) -> Column:
    """A signature without type parameters (brackets, nested up to ``nesting``) and with single spaces."""
    for _ in range(nesting):
        signature = F.regexp_replace(signature, r"\[[^\[\]]*\]", "")
    return F.trim(F.regexp_replace(signature, r"\s+", " "))


# --- English stemming: the published Porter2 (Snowball English) rules ----------------------------------------------

VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: fixed values of the published algorithm: words with a stem of their own, words left alone, prefixes that set the first region
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SAME = frozenset("sky news howe atlas cosmos bias andes".split())
SAME_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
FIRST_REGIONS = ("gener", "commun", "arsen")
STEP_2 = (("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
          ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    """The place after the first consonant that follows a vowel, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_end(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS + "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def stem(word: str) -> str:
    """Stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    w = word.lstrip("'")
    if w in SPECIAL:
        return SPECIAL[w]
    if w in SAME:
        return w
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWELS) else c for i, c in enumerate(w))  # a y that is a consonant
    prefix = next((p for p in FIRST_REGIONS if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(w, 0)
    r2 = _region(w, r1)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in SAME_AFTER_PLURAL:
        return w
    # past and present forms
    end = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), None)
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and any(c in VOWELS for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for end, new in STEP_2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, new in STEP_3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in STEP_4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.lower()


def stems(tokens: Column) -> Column:
    """Stems of an array of tokens, in order; an Arrow-batched function."""

    @F.pandas_udf("array<string>")
    def stemmed(rows: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return pd.Series([None if row is None else [known.setdefault(w, stem(w)) for w in row] for row in rows], dtype=object)

    return stemmed(tokens)
