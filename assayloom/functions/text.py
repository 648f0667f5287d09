"""Compatibility forms of characters folded to their plain ones, inside the engine."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character of the basic plane whose compatibility form is one other character: full-width forms, super- and subscripts, ...
_PAIRS = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xA0, 0x10000) if not 0xD800 <= c < 0xE000]
_PAIRS = [(a, b) for a, b in _PAIRS if len(b) == 1 and a != b]
FROM, TO = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)
#: Units and signs that unfold to several characters.
UNITS = {c: unicodedata.normalize("NFKC", c) for c in "㎎㎏㎖㎛㎥㎡㎍℃№™…"}


def fold(text: Column) -> Column:
    """NFKC of single characters and of UNITS; sequences of combining characters are left as they are."""
    folded = F.translate(text, FROM, TO)
    for unit, plain in UNITS.items():
        folded = F.replace(folded, F.lit(unit), F.lit(plain))
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


def fold_sql(expression: str) -> str:
    """The same as SQL for another engine."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    folded = f"translate({expression}, {quote(FROM)}, {quote(TO)})"
    for unit, plain in UNITS.items():
        folded = f"replace({folded}, {quote(unit)}, {quote(plain)})"
    return folded
