"""Words of letters, digits and signs beyond ASCII, with A-Z in lower case."""

from __future__ import annotations

_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, in order; every other ASCII sign separates."""
    return text.translate(_CLEAN).split()


#: the same in DuckDB SQL: a list of words of the column ``text``
WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
