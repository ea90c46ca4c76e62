"""Cutting texts at single spaces, where byte-level pre-tokenizers always cut."""

from __future__ import annotations

import re

#: White space of Unicode, as the pre-tokenizers' patterns take it.
SPACE = "\t-\r \x85\xa0  -     　"
_RUN = re.compile(f"[{SPACE}] | [{SPACE}]")
_CUT = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")


def pieces(text: str) -> list[str]:
    """The text cut at each space between two visible characters, those spaces dropped.

    A pre-token takes a space only as its first character or within a run of white space, and no rule looks
    behind. So every piece, with its space put back in front (but for the first), is tokenized as in the text.
    """
    if _RUN.search(text) or text[:1] == " " or text[-1:] == " ":
        return _CUT.split(text)
    return text.split(" ")
