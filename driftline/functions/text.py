"""Text functions: cleaning, keys, tokens, stems."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words left out of the index and of queries; fixed values.
STOP_WORDS = """
a about above after again against all also am an and any are as at be because been before being below
between both but by can could did do does doing down during each few for from further had has have
having he her here hers herself him himself his how i if in into is it its itself just me more most my
myself no nor not now of off on once only or other our ours ourselves out over own same she should so
some such than that the their theirs them themselves then there these they this those through to too
under until up very was we were what when where which while who whom why will with would you your
yours yourself yourselves via using based use used new paper study approach show shows propose proposed
""".split()
#: Limits of a query; fixed values.
QUERY_TOKENS, QUERY_WORDS = 24, 12


def clean(s: Column) -> Column:
    """Without literal backslash-n and tags, white space collapsed; null gives ''."""
    s = F.replace(F.coalesce(s, F.lit("")), F.lit("\\n"), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", ""), r"\s+", " "))


def title_key(s: Column) -> Column:
    """Key under which titles count as the same: a-z and digits of the lower-cased title."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")


def words(s: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(s, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def index_tokens(s: Column, stop: bool = True) -> Column:
    """Tokens as indexed; stop words go before positions are given, so phrases span them."""
    return F.filter(words(s), lambda w: ~w.isin(*STOP_WORDS)) if stop else words(s)


def query_words(s: Column) -> Column:
    """Words of a query: of its first 24 tokens those that are no stop words, 12 at most."""
    return F.slice(F.filter(F.slice(words(s), 1, QUERY_TOKENS), lambda w: ~w.isin(*STOP_WORDS)), 1, QUERY_WORDS)


def match_expression(s: Column, any_word: bool = False) -> Column:
    """The query written out: every word, or the phrase; with ``any_word`` any of them; '' if no word is left."""
    w = query_words(s)
    quoted = F.transform(w, lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    if any_word:
        return F.array_join(quoted, " OR ")
    both = F.concat(F.lit("("), F.array_join(quoted, " "), F.lit(') OR "'), F.array_join(w, " "), F.lit('"'))
    return F.when(F.size(w) == 0, "").when(F.size(w) == 1, F.get(quoted, F.lit(0))).otherwise(both)


def fold(word: str) -> str:
    """Without diacritics; ligatures, superscripts and syllable blocks stay as they are."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)))


class Porter:
    """The Porter stemmer (1980) as rules by step: suffix, replacement, least measure."""

    STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
    STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
    STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"

    @staticmethod
    def _consonants(w: str) -> list[bool]:
        out: list[bool] = []
        for i, c in enumerate(w):
            out.append(c not in "aeiou" and not (c == "y" and i and out[-1]))
        return out

    @classmethod
    def measure(cls, w: str) -> int:
        kinds = cls._consonants(w)
        return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if not a and b)

    @classmethod
    def _has_vowel(cls, w: str) -> bool:
        return not all(cls._consonants(w))

    @classmethod
    def _double(cls, w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and cls._consonants(w)[-1]

    @classmethod
    def _cvc(cls, w: str) -> bool:
        return len(w) > 2 and cls._consonants(w)[-3:] == [True, False, True] and w[-1] not in "wxy"

    @classmethod
    def _longest(cls, w: str, rules: list[tuple[str, str]], least: int) -> str:
        for suffix, other in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(suffix):
                root = w[: len(w) - len(suffix)]
                return root + other if cls.measure(root) > least else w
        return w

    @classmethod
    def stem(cls, w: str) -> str:
        if len(w) < 3 or not w.isascii() or not w.isalpha():
            return w
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if cls.measure(w[:-3]) > 0 else w
        else:
            root = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x)), None)
            if root is not None and cls._has_vowel(root):
                w = root
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif cls._double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif cls.measure(w) == 1 and cls._cvc(w):
                    w += "e"
        if w.endswith("y") and cls._has_vowel(w[:-1]):
            w = w[:-1] + "i"
        w = cls._longest(w, [tuple(r.split(":")) for r in cls.STEP2.split()], 0)
        w = cls._longest(w, [tuple(r.split(":")) for r in cls.STEP3.split()], 0)
        if w.endswith("ion") and w[-4:-3] in ("s", "t"):
            w = w[:-3] if cls.measure(w[:-3]) > 1 else w
        else:
            w = cls._longest(w, [(s, "") for s in cls.STEP4.split()], 1)
        if w.endswith("e"):
            m = cls.measure(w[:-1])
            if m > 1 or m == 1 and not cls._cvc(w[:-1]):
                w = w[:-1]
        if cls._double(w) and w[-1] == "l" and cls.measure(w) > 1:
            w = w[:-1]
        return w


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(tokens: pa.Array) -> pa.Array:
    """Folded and stemmed tokens, each distinct one of a batch once; there is no built-in stemmer."""
    flat = tokens.flatten().dictionary_encode()
    stemmed = pa.array([Porter.stem(fold(w)) for w in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), stemmed, mask=tokens.is_null())


#: White space as Spark's regular expressions take it.
BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def _inverted(texts: pa.Array) -> pa.Array:
    ends, words, stops, places = [0], [], [0], []
    for s in texts.to_pylist():
        held: dict[str, list[int]] = {}
        for p, w in enumerate(BLANK.split(s or "")):
            held.setdefault(w, []).append(p)
        words.extend(held)
        for ps in held.values():
            places.extend(ps)
            stops.append(len(places))
        ends.append(len(words))
    at = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(places, pa.int32()))
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()), at)


@F.arrow_udf(T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
def invert_text(texts: pa.Array) -> pa.Array:
    """Map from the words of a text, split at white space, to their positions; null is ''.  Within the row, so that no word is moved.

    A batch goes by 256 texts, so Python holds the words of these alone.
    """
    return pa.concat_arrays([_inverted(texts.slice(i, 256)) for i in range(0, max(len(texts), 1), 256)])


def rebuild_text(inverted: Column) -> Column:
    """Text of a map from words to positions; of words at the same place the greatest stays; null gives ''."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    # held by a lambda variable: a lambda body would sort anew for each word
    last = F.get(F.transform(F.array(F.sort_array(pairs)), lambda o: F.filter(o, lambda x, i: F.coalesce(F.get(o, i + 1)["p"] != x["p"], F.lit(True)))), F.lit(0))
    return F.coalesce(clean(F.array_join(F.transform(last, lambda x: x["w"]), " ")), F.lit(""))
