"""Text functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Latin letters that decompose into a plain letter and marks, and that letter; and those (ligatures, digraphs) that
    give several letters. By rule, not listed."""
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()) for r in ((0xAA, 0x250), (0x1E00, 0x1F00), (0x2460, 0x2474), (0xFB00, 0xFB07), (0xFF10, 0xFF5B)) for c in range(*r)]
    one = [(a, b) for a, b in pairs if len(b) == 1]
    return "".join(a for a, _ in one), "".join(b for _, b in one), [(a, b) for a, b in pairs if len(b) > 1]


def bound(x: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def normalize_whitespace(x: Column) -> Column:
    """Runs of white space become one space, ends are trimmed. Null stays null."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def is_empty(x: Column) -> Column:
    """Null, blank, or an empty JSON list or object."""
    return x.isNull() | F.regexp_like(x, F.lit(r"^\s*(\[\]|\{\})?\s*$"))


def non_empty(x: Column) -> Column:
    return F.when(~is_empty(x), x)


def to_title_case(x: Column) -> Column:
    """Each word capitalised, but words with lower case and a later capital ("McDonald") kept."""
    word = lambda w: F.when(F.regexp_like(w, F.lit(r"\p{Ll}")) & F.regexp_like(F.substring(w, 2, 1 << 20), F.lit(r"\p{Lu}")), w).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))
    )
    return F.array_join(F.transform(F.split(normalize_whitespace(x), " "), word), " ")


def slugify(x: Column) -> Column:
    """ASCII letters, digits and hyphens: marks fall away, ligatures are spelt out, other characters go, spaces and _
    become -. Texts of ASCII letters skip the folds."""
    a, b, many = _folds()
    folded = F.translate(x, a, b)
    for old, new in many:
        folded = F.replace(folded, F.lit(old), F.lit(new))
    kept = F.regexp_replace(F.lower(F.when(F.regexp_like(x, F.lit(r"[^\x00-\x7F]")), folded).otherwise(x)), r"[^\x00-\x7F]", "")
    kept = F.trim(F.regexp_replace(kept, r"[^\w\s-]", ""))
    return F.regexp_replace(F.regexp_replace(kept, r"[\s_]+", "-"), r"^-+|-+$", "")


def clean_url(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), r"/+$", "")


def stable_hash(*columns: Column) -> Column:
    """SHA-256 of the values as JSON; the same in every run."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def distinct_ignoring_case(values: Column) -> Column:
    """The first of each string that differs in more than case, in order."""
    return F.filter(values, lambda x, i: F.array_position(F.transform(values, lambda y: F.lower(y)), F.lower(x)) == i + 1)


def years_of_experience(text: Column) -> Column:
    """Years that a text states: the first pattern that occurs anywhere counts ("3-5 years" gives 5)."""
    patterns = [r"(?i)(\d+(?:\.\d+)?)\+?\s*years?", r"(?i)(\d+)\s*-\s*\d+\s*years?", r"(?i)over\s+(\d+)\s+years?"]
    return F.coalesce(*[F.expr("try_cast(null as double)")] + [F.regexp_extract(text, p, 1).try_cast("double") for p in patterns])


def glued(text: Column) -> Column:
    """Text without its spaces: a run of over 25 letters, or under 4 % spaces."""
    return F.regexp_like(text, F.lit("[A-Za-z]{26,}")) | ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) < 0.04 * F.length(text))
