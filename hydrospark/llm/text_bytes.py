"""Tables for `bytes.translate`, after which `split` gives a text's words: one pass over the bytes, whatever they hold."""

from __future__ import annotations


def _lower(c: int) -> int:
    return c + 32 if 0x41 <= c <= 0x5A else c


#: For UTF-8: ASCII other than letters becomes a space, A-Z are lower-cased, all other characters stay.
TERMS = bytes(_lower(c) if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))
#: For Latin-1: letters and U+00C0 to U+00FF stay, A-Z are lower-cased, all else (a `?` for what Latin-1 lacks, too) becomes a space.
RUNS = bytes(_lower(c) if c >= 0xC0 or c < 0x80 and chr(c).isalpha() else 32 for c in range(256))
