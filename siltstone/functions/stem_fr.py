"""A French stemmer after the published Snowball description, applied to distinct tokens by a pandas UDF.

Every rule is a suffix list and the region it must lie in; regions RV, R1 and R2 are computed once a word.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

VOWELS = "aeiouyâàëéêèïîôûù"
# The suffix groups of the published algorithm.
DELETE_R2 = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
AT = "atrice ateur ation atrices ateurs ations".split()
I_VERB = tuple("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split())
E_VERB = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
A_VERB = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
VERB = ("ions", *E_VERB, *A_VERB)
STANDARD = tuple(DELETE_R2 + AT) + tuple(
    "logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments".split()
)


def _after_vowel_consonant(w: str, start: int) -> int:
    for i in range(start + 1, len(w)):
        if w[i] not in VOWELS and w[i - 1] in VOWELS:
            return i + 1
    return len(w)


def _regions(w: str) -> tuple[int, int, int]:
    if w[:3] in ("par", "col", "tap") or len(w) > 1 and w[0] in VOWELS and w[1] in VOWELS:
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in VOWELS), len(w))
    r1 = _after_vowel_consonant(w, 0)
    return min(rv, len(w)), r1, _after_vowel_consonant(w, r1)


def _mark(w: str) -> str:
    """Vowels in consonant position in upper case."""
    out = list(w)
    for i, c in enumerate(w):
        before = out[i - 1] if i else ""
        after = w[i + 1] if i + 1 < len(w) else ""
        if c == "u" and before == "q" or c in "ui" and before and before in VOWELS and after and after in VOWELS or c == "y" and (before and before in VOWELS or after and after in VOWELS):
            out[i] = c.upper()
    return "".join(out)


def _longest(w: str, suffixes: tuple[str, ...]) -> str:
    if not w.endswith(suffixes):  # most words have none
        return ""
    return max((s for s in suffixes if w.endswith(s)), key=len, default="")


def _standard(w: str, rv: int, r1: int, r2: int) -> tuple[str, bool, bool]:
    """(word, changed, whether verb suffixes are tried although it changed)."""
    if not w.endswith(STANDARD):
        return w, False, True

    def at(s: str) -> int:
        return len(w) - len(s)

    def delete(s):
        return (w[: at(s)], True) if at(s) >= r2 else (w, False)

    def ic(s, keep="iqU"):
        if at(s) < r2:
            return w, False
        x = w[: at(s)]
        return ((x[:-2], True) if len(x) - 2 >= r2 else (x[:-2] + keep, True)) if x.endswith("ic") else (x, True)

    def swap(new):
        return lambda s: (w[: at(s)] + new, True) if at(s) >= r2 else (w, False)

    def ement(s):
        if at(s) < rv:
            return w, False
        x = w[: at(s)]
        if x.endswith("iv") and len(x) - 2 >= r2:
            x = x[:-2]
            return (x[:-2] if x.endswith("at") and len(x) - 2 >= r2 else x), True
        if x.endswith("eus"):
            return (x[:-3], True) if len(x) - 3 >= r2 else (x[:-1] + "x", True) if len(x) - 3 >= r1 else (x, True)
        if x.endswith(("abl", "iqU")) and len(x) - 3 >= r2:
            return x[:-3], True
        if x.endswith(("ièr", "Ièr")) and len(x) - 3 >= rv:
            return x[:-3] + "i", True
        return x, True

    def ite(s):
        if at(s) < r2:
            return w, False
        x = w[: at(s)]
        if x.endswith("abil"):
            return (x[:-4] if len(x) - 4 >= r2 else x[:-4] + "abl"), True
        if x.endswith("ic"):
            return (x[:-2] if len(x) - 2 >= r2 else x[:-2] + "iqU"), True
        return (x[:-2] if x.endswith("iv") and len(x) - 2 >= r2 else x), True

    def if_(s):
        if at(s) < r2:
            return w, False
        x = w[: at(s)]
        if x.endswith("at") and len(x) - 2 >= r2:
            x = x[:-2]
            if x.endswith("ic"):
                x = x[:-2] if len(x) - 2 >= r2 else x[:-2] + "iqU"
        return x, True

    def euse(s):
        return (w[: at(s)], True) if at(s) >= r2 else (w[: at(s)] + "eux", True) if at(s) >= r1 else (w, False)

    def issement(s):
        return (w[: at(s)], True) if at(s) >= r1 and at(s) and w[at(s) - 1] not in VOWELS else (w, False)

    def in_rv(new):
        return lambda s: (w[: at(s)] + new, True) if at(s) >= rv else (w, False)

    def ment(s):
        return (w[: at(s)], True) if at(s) - 1 >= rv and w[at(s) - 1] in VOWELS else (w, False)

    groups = [
        (DELETE_R2, delete), (AT, ic), (["logie", "logies"], swap("log")), (["usion", "ution", "usions", "utions"], swap("u")), (["ence", "ences"], swap("ent")),
        (["ement", "ements"], ement), (["ité", "ités"], ite), (["if", "ive", "ifs", "ives"], if_), (["eaux"], lambda s: (w[:-1], True)),
        (["aux"], lambda s: (w[:-3] + "al", True) if at(s) >= r1 else (w, False)), (["euse", "euses"], euse), (["issement", "issements"], issement),
        (["amment"], in_rv("ant")), (["emment"], in_rv("ent")), (["ment", "ments"], ment),
    ]
    found = {s: f for names, f in groups for s in names}
    s = _longest(w, STANDARD)
    if not s:
        return w, False, True
    x, done = found[s](s)
    return x, done, s in ("amment", "emment", "ment", "ments")


def _verb_i(w: str, rv: int) -> tuple[str, bool]:
    s = _longest(w[rv:], I_VERB)
    at = len(w) - len(s)
    return (w[:at], True) if s and at > rv and w[at - 1] not in VOWELS else (w, False)


def _verb(w: str, rv: int, r2: int) -> tuple[str, bool]:
    s = _longest(w[rv:], VERB)
    if not s:
        return w, False
    x = w[: len(w) - len(s)]
    if s == "ions":
        return (x, True) if len(x) >= r2 else (w, False)
    if s in A_VERB and x.endswith("e") and len(x) - 1 >= rv:
        x = x[:-1]
    return x, True


def _residual(w: str, rv: int, r2: int) -> str:
    if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
        w = w[:-1]
    s = _longest(w[rv:], ("ion", "ier", "ière", "Ier", "Ière", "e"))
    at = len(w) - len(s)
    if s == "ion":
        return w[:at] if at >= r2 and at - 1 >= rv and w[at - 1] in "st" else w
    if s == "e":
        return w[:at]
    return w[:at] + "i" if s else w


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    w = _mark(word.lower())
    rv, r1, r2 = _regions(w)
    x, changed, try_verbs = _standard(w, rv, r1, r2)
    if not changed or try_verbs:
        y, verb = _verb_i(x, rv)
        if not verb:
            y, verb = _verb(x, rv, r2)
        x, changed = y, changed or verb
    if changed:
        x = x[:-1] + "i" if x.endswith("Y") else x[:-1] + "c" if x.endswith("ç") else x
    else:
        x = _residual(x, rv, r2)
    if x.endswith(("enn", "onn", "ett", "ell", "eill")):
        x = x[:-1]
    tail = len(x.rstrip("".join(c for c in set(x) if c.lower() not in VOWELS)))
    if 0 < tail < len(x) and x[tail - 1] in "éè":
        x = x[: tail - 1] + "e" + x[tail:]
    return x.lower()


# Suffixes that a keyword's stem loses too if five letters stay.
KEYWORD_SUFFIXES = ("issement", "ements", "ement", "ations", "ation", "itions", "ition", "ments")


@F.pandas_udf(ArrayType(StringType()))
def stem_all(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: None if t is None else [stem(x) for x in t])


def keyword_token(stemmed: Column) -> Column:
    out = stemmed
    for s in reversed(KEYWORD_SUFFIXES):
        out = F.when(stemmed.endswith(s) & (F.length(stemmed) - len(s) >= 5), F.left(stemmed, F.length(stemmed) - len(s))).otherwise(out)
    return out
