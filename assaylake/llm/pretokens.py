"""How texts are cut before byte-level BPE: special strings, pieces at white space, pre-tokens.

A pre-token never ends in white space of a run that goes on, so every start of a run of white space is
a safe place to cut. The pieces between such places repeat a lot and carry the caches of the operators.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import regex

# The Unicode White_Space characters and the public pre-token pattern of byte-level BPE.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

PIECE = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
_CUT = re.compile(f"(?<=[^{WHITE_SPACE}])[{WHITE_SPACE}]")


def text_windows(text: str, size: int) -> Iterator[str]:
    """Cut a text at starts of white space into windows of about ``size`` characters."""
    start = 0
    while len(text) - start > size:
        found = _CUT.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    if start < len(text):
        yield text[start:]


def pre_tokens(piece: str) -> list[str]:
    return PRE_TOKEN.findall(piece)
