"""Text columns.  Everything runs inside the JVM except NFC composition."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from preciario.constants import CONECTORES, PATRON_M3_KM, UNIDAD_M3_KM

# Blanks that trimming removes, line breaks aside.
_BLANK = r"\t\x0B\f \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_BLANKS = "\t\x0b\f \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# Characters that may change under NFC: marks, conjoining jamo, singletons.
_NOT_NFC = (
    r"[\p{M}\u1100-\u11FF\u0374\u037E\u0387\u1F71-\u1FFD\u2000\u2001\u2126\u212A\u212B"
    r"\u2329\u232A\uF900-\uFAFF\uFB1D-\uFB4E]"
)


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFC")


def to_nfc(texto: Column) -> Column:
    """Canonical composition.  Spark has no function for it, so the few texts
    that can change travel to Python in Arrow batches; the others pass as null."""
    may_change = texto.rlike(_NOT_NFC)
    return F.when(may_change, _compose(F.when(may_change, texto))).otherwise(texto)


#: What a text without anything to clean does not have.
_UNCLEAN = r"[^ -~]|  |^ | \z"


def clean_text(texto: Column) -> Column:
    """Unix line breaks, single blanks, every line trimmed, empty gives null."""
    texto = texto.cast("string")
    out = F.regexp_replace(texto, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t\u00a0]+", " ")
    out = F.regexp_replace(out, rf"[{_BLANK}]*\n[{_BLANK}]*", "\n")
    out = F.btrim(out, F.lit(_BLANKS + "\n"))
    return F.when((texto != "") & ~texto.rlike(_UNCLEAN), texto).otherwise(F.when(out != "", out))


@lru_cache(maxsize=None)
def _fold_tables(search: bool) -> tuple[str, str]:
    """``translate`` arguments: letters lose their marks, marks disappear.

    Derived from the Unicode decompositions of the basic plane.  ``search``
    also deletes spacing diacritics such as the acute accent and the caret.
    """
    letters: dict[str, str] = {}
    marks: list[str] = []
    for point in range(0x5E, 0x10000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        if search:
            deleted = (
                unicodedata.combining(char) != 0
                or unicodedata.category(char) == "Sk"
                or point == 0xB7
                or 0x2B0 <= point <= 0x2FF
            )
        else:
            deleted = 0x300 <= point <= 0x36F
        if deleted:
            marks.append(char)
            continue
        parts = unicodedata.normalize("NFD", char)
        base = "".join(c for c in parts if not 0x300 <= ord(c) <= 0x36F)
        if base != char and len(base) == 1:
            letters[char] = base
    return "".join(letters) + "".join(marks), "".join(letters.values())


def fold(texto: Column) -> Column:
    """Lower case without combining marks."""
    source, target = _fold_tables(False)
    ascii_only = F.octet_length(texto) == F.length(texto)
    return F.lower(F.when(ascii_only, texto).otherwise(F.translate(texto, source, target)))


def fold_search(texto: Column) -> Column:
    """Search form: lower case, no marks and no spacing diacritics."""
    source, target = _fold_tables(True)
    return F.translate(F.lower(texto), source, target)


def equivalent(left: Column, right: Column) -> Column:
    """Equal but for case, marks and surplus blanks."""

    def plain(text: Column) -> Column:
        return F.trim(F.regexp_replace(fold(text), rf"[{_BLANK}\r\n]+", " "))

    return plain(left) == plain(right)


def slugify(*parts: Column) -> Column:
    """ASCII key: marks removed, anything else becomes one hyphen."""
    joined = fold(F.concat_ws(" ", *parts))
    return F.regexp_replace(F.regexp_replace(joined, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_case(nombre: Column) -> Column:
    """Spanish capitals: connectors stay in lower case unless they lead."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.translate(nombre, "_", " ")), r"\s+", " ")), " ")

    def shape(word: Column, index: Column) -> Column:
        capital = F.when(
            word.rlike("^[a-záéíóúüñ]"),
            F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2))),
        ).otherwise(word)
        return F.when((index > 0) & word.isin(*CONECTORES), word).otherwise(capital)

    return F.array_join(F.transform(words, shape), " ")


def first_line(texto: Column) -> Column:
    """The title as written: everything before the first line break."""
    return F.substring_index(texto, "\n", 1)


def title(texto: Column) -> Column:
    return trim_all(first_line(texto))


def trim_all(texto: Column) -> Column:
    return F.btrim(texto, F.lit(_BLANKS + "\r\n"))


def rest_of_lines(texto: Column) -> Column:
    """Everything after the first line break, trimmed; null when there is none."""
    after = F.when(F.instr(texto, "\n") > 0, F.substr(texto, F.instr(texto, "\n") + 1))
    return F.nullif(trim_all(after), F.lit(""))


def scope_without_parentheses(texto: Column) -> Column:
    """The scope without its outer parentheses; empty when there is no scope."""
    rest = F.coalesce(rest_of_lines(texto), F.lit(""))
    wrapped = rest.startswith("(") & rest.endswith(")") & (F.length(rest) > 1)
    return F.when(wrapped, trim_all(F.substr(rest, F.lit(2), F.length(rest) - 2))).otherwise(rest)


def scope_on_one_line(texto: Column) -> Column:
    """The scope with its lines joined by blanks; null when empty."""
    after = F.when(F.instr(texto, "\n") > 0, F.substr(texto, F.instr(texto, "\n") + 1))
    return F.nullif(trim_all(F.regexp_replace(after, "\n", " ")), F.lit(""))


def is_m3_km(cruda: Column) -> Column:
    return F.when(cruda.rlike(PATRON_M3_KM), F.lit(UNIDAD_M3_KM))
