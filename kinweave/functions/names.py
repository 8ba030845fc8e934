"""Names of context entities: plain letters, initials, last name, canonical forms, block key."""

from __future__ import annotations

import functools
import json
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Letters whose compatibility decomposition is one letter and marks, with that letter."""
    source, target = [], []
    for code in (*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


_FROM, _TO = _plain_letters()


@functools.cache
def _decomposition() -> tuple[str, str, str, str]:
    """Of all characters but Hangul syllables, by what stays of their compatibility decomposition without marks: those of one character and these, those of none, and those of several as JSON."""
    one, letters, none, several = [], [], [], {}
    for code in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not plain:
            none.append(c)
        elif len(plain) > 1:
            several[c] = plain
        elif plain != c:
            one.append(c)
            letters.append(plain)
    return "".join(one), "".join(letters), "".join(none), json.dumps(several)


#: Letters of a Hangul syllable: first, second, and third or none.
_HANGUL = tuple("".join(map(chr, range(start, start + n))) for start, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def _expanded(c: Column) -> Column:
    """A character that decomposes to several ones, as these; others as they are. Syllables by arithmetic."""
    first, second, third = _HANGUL
    n = F.ascii(c) - 0xAC00
    letter = lambda letters, i: F.substring(F.lit(letters), i, F.lit(1))
    size = len(second) * (len(third) + 1)
    parts = [letter(first, F.floor(n / size) + 1), letter(second, F.floor(n % size / (len(third) + 1)) + 1), F.when(n % (len(third) + 1) > 0, letter(third, n % (len(third) + 1))).otherwise(F.lit(""))]
    syllable = F.when(n.between(0, len(first) * size - 1), F.concat(*parts))
    return F.coalesce(F.element_at(F.from_json(F.lit(_decomposition()[3]), "map<string,string>"), c), syllable, c)


def strip_diacritics(value: Column, exact: bool = False) -> Column:
    """Letters without their marks, by a table. ``exact`` takes the full decomposition (ligatures, all scripts); only texts with a character that becomes several ones are taken apart."""
    if exact:
        one, letters, none, several = _decomposition()
        low = F.translate(value, one + none, letters)
        found = F.lit("[\\x{AC00}-\\x{D7A3}" + "".join(f"\\x{{{ord(c):X}}}" for c in json.loads(several)) + "]")
        taken = F.array_join(F.transform(F.regexp_extract_all(low, F.lit("(?s)."), F.lit(0)), _expanded), "")
        return F.when(F.rlike(low, found), taken).otherwise(low)
    return F.regexp_replace(F.translate(value, _FROM, _TO), r"\p{Mn}+", "")


def name_features(name: Column, exact: bool = False) -> Column:
    """A struct of raw, norm, initials (the whole first token), first_initial, middle_initial (its second letter), last_name (the last of the further tokens of two letters or more, or empty), canon_full, canon_init and block_key."""
    low = strip_diacritics(F.lower(F.coalesce(name, F.lit(""))), exact)
    norm = F.trim(F.regexp_replace(F.regexp_replace(low, "[^a-z]", " "), " +", " "))
    parts = F.split(norm, " ")
    initials = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    later = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.length(x) >= 2)
    last = F.coalesce(F.try_element_at(later, F.lit(-1)), F.lit(""))
    first, middle = F.substring(initials, 1, 1), F.substring(initials, 2, 1)
    return F.struct(
        name.alias("raw"), norm.alias("norm"), initials.alias("initials"), first.alias("first_initial"), middle.alias("middle_initial"), last.alias("last_name"),
        F.trim(F.concat(last, F.lit(" "), initials)).alias("canon_full"),
        F.trim(F.regexp_replace(F.concat_ws(" ", last, first, middle), " +", " ")).alias("canon_init"),
        F.struct(last.alias("last"), first.alias("initial")).alias("block_key"),
    )
