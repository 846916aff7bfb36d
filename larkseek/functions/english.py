"""English word normalisation: a stop-word list and the published Porter2 suffix rules.

The stemmer sees each distinct word of an Arrow batch once; everything around it (splitting,
positions, weights, matching, rank) is native column expressions.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now"
).split()

# Irregular words and words left alone after the first step.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}

# Suffix tables of steps 2, 3 and 4, longest first within a shared ending.
STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"),
    ("alli", "al"), ("bli", "ble"),
]
STEP3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
         "ive", "ize", "al", "er", "ic"]

_REGION = re.compile("[aeiouy][^aeiouy](.*)")
_SHORT_END = re.compile("(?:^|.*[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
_VOWEL = re.compile("[aeiouy]")
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(w: str) -> tuple[int, int]:
    """Start offsets of the two suffix regions."""
    for head in ("gener", "commun", "arsen"):
        if w.startswith(head):
            r1 = len(head)
            break
    else:
        m = _REGION.search(w)
        r1 = m.start(1) if m else len(w)
    m = _REGION.search(w, r1)
    return r1, (m.start(1) if m else len(w))


def stem(word: str) -> str:
    """Porter2 stem of one lower-case word."""
    if len(word) < 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    if not word.isascii() or not word.isalpha():
        # The rules speak about a-z only; numbers and other scripts pass through them untouched
        # except for a plural-like ending, which the plain path below would also leave alone.
        if not any("a" <= ch <= "z" for ch in word):
            return word
    # A consonantal y (first letter or after a vowel) is marked Y.
    w = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = _regions(w)

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w.lower() in KEPT_AFTER_PLURAL:
        return w.lower()

    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(suffix):
            base = w[:-len(suffix)]
            if suffix in ("eedly", "eed"):
                if len(base) >= r1:
                    w = base + "ee"
            elif _VOWEL.search(base):
                if base.endswith(("at", "bl", "iz")):
                    w = base + "e"
                elif base.endswith(_DOUBLE):
                    w = base[:-1]
                elif r1 >= len(base) and _SHORT_END.match(base):
                    w = base + "e"
                else:
                    w = base
            break

    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    for suffix, repl in STEP2:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[:-len(suffix)] + repl
            break
    else:
        if w.endswith("ogi"):
            if len(w) - 3 >= r1 and w[-4:-3] == "l":
                w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]

    for suffix, repl in STEP3:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[:-len(suffix)] + repl
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]

    for suffix in STEP4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2:
                w = w[:-len(suffix)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]

    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _SHORT_END.match(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _normalise(words: pa.Array) -> pa.Array:
    """Stems of an Arrow text array, null for stop words; each distinct word is stemmed once."""
    coded, stop = words.dictionary_encode(), set(STOP_WORDS)
    stems = pa.array([None if w is None or w in stop else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    return stems.take(coded.indices)


def _normalise_lists(column: pa.Array) -> pa.Array:
    """The same for arrays of words; the rows never become Python objects."""
    stems = _normalise(column.flatten())
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), stems, mask=column.is_null())


# Executors may not have this package on their path; ship the helper by value.
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))


def stem_words(words: Column) -> Column:
    """Stem every word of an ``array<string>``; stop words become null so that positions keep."""
    return F.arrow_udf(_normalise_lists, "array<string>")(words)


def stem_word(word: Column) -> Column:
    """Stem of a word, null for a stop word."""
    return F.arrow_udf(_normalise, "string")(word)
