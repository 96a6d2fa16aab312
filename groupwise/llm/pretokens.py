"""Cutting texts where the pre-token pattern always cuts, so that equal runs are encoded once."""

from __future__ import annotations

import base64
import re

#: A space before white space, or one that ends the text: there a plain split would cut inside a run of spaces.
_IRREGULAR = re.compile(r" (?:\s|\Z)")
_BEFORE_WORD = re.compile(r"(?= \S)")


def runs(text: str) -> tuple[str, list[str]]:
    """(head, rest): text is head + "".join(" " + r for r in rest), cut only before a space that a non-space follows.

    The pattern takes at most one space before a word and never one inside, so it cuts at each of these
    places whatever stands around them, and each part alone gives the same matches as in its text.
    """
    if not _IRREGULAR.search(text):
        head, *rest = text.split(" ")
        return head, rest
    head, *rest = _BEFORE_WORD.split(text)
    return head, [r[1:] for r in rest]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank from a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
