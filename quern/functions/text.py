"""Text folding as native column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F


def _letters() -> tuple[str, str]:
    """Composed Latin letters and the plain letter each folds to, by rule over their code blocks."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base != chr(cp) and base.isascii():
            src.append(chr(cp))
            dst.append(base)
    return "".join(src) + "đĐ", "".join(dst) + "dD"


_FROM, _TO = _letters()


def fold_accents(c: Column) -> Column:
    """Without accents: composed letters to their base letter, combining marks dropped, đ as d."""
    return F.translate(F.regexp_replace(c, r"\p{M}+", ""), _FROM, _TO)


def fold_name(c: Column) -> Column:
    """A place or person name without regard to letter case, spacing and accents."""
    return F.lower(F.regexp_replace(fold_accents(c), r"[\s ​  ﻿]+", ""))
