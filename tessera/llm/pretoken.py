"""Pre-tokens of byte-level BPE, split as the tokenizer libraries split them.

The libraries and the `regex` module know different Unicode versions. Which code points a library takes for letters or
numbers is asked of the library itself; texts that hold none of the code points in question (all of Latin-1, say) use
the plain pattern.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import regex

#: Characters in a chunk, characters that neighbouring chunks share, and characters before a chunk's end that are not trusted.
CHUNK, OVERLAP, MARGIN = 32_768, 1_024, 8


def disagreed(joins: Callable[[str, str], bool]) -> str:
    """The code points that `regex` takes for letters or numbers and the library does not.

    joins(a, b): whether the library keeps the characters a and b in one pre-token.
    """
    known = regex.compile(r"\p{L}|\p{N}")
    letter = regex.compile(r"\p{L}")
    found = []
    for cp in range(0x100, 0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if known.match(ch) and not joins("a" if letter.match(ch) else "1", ch):
            found.append(ch)
    return "".join(found)


@lru_cache(maxsize=4)
def patterns(pattern: str, odd: str) -> tuple[regex.Pattern, regex.Pattern]:
    """The plain pattern, and the one for texts beyond Latin-1, in which `odd` are neither letters nor numbers."""
    plain = regex.compile(pattern)
    if not odd:
        return plain, plain
    kept = {}
    for kind in "LN":
        kept[kind] = rf"[\p{{{kind}}}--[{regex.escape(odd, special_only=False)}]]"
    other = rf"[^\s{kept['L']}{kept['N']}]"
    told = pattern.replace(r"[^\s\p{L}\p{N}]", "\0").replace(r"\p{L}", kept["L"]).replace(r"\p{N}", kept["N"]).replace("\0", other)
    return plain, regex.compile("(?V1)" + told)


def split(text: str, pattern: str, odd: str = "") -> list[str]:
    """All pre-tokens of a whole text."""
    plain, told = patterns(pattern, odd)
    if plain is told:
        return plain.findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return told.findall(text)
    return plain.findall(text)


def _starts(text: str, at: int, pattern: str, odd: str, chunk: int, overlap: int) -> tuple[list[int], int]:
    """Where the pre-tokens of one chunk start (places in the whole text), and up to where they are certain."""
    end = min(len(text), at + chunk + overlap)
    part = text[at:end]
    starts, place = [], at
    for piece in split(part, pattern, odd):
        starts.append(place)
        place += len(piece)
    if end == len(text):
        return starts, end + 1
    # A run of white space may go on behind the end and then be split elsewhere; any other run is cut where it is.
    return starts, at + len(part.rstrip()) - MARGIN


def stitched(text: str, pattern: str, odd: str = "", chunk: int = CHUNK, overlap: int = OVERLAP, threads: int = 1) -> list[str]:
    """All pre-tokens of a text, from chunks that overlap.

    A pre-token depends only on what stands from its start on, so two chunks that both start one at the same place agree
    from there on. Each chunk but the first is entered at the first such place inside what it shares with the chunk
    before it. If there is none (a run longer than the overlap), the chunk before it is split further instead, over a
    span that doubles until both meet or the text ends. The result is that of splitting the whole text at once.
    """
    if len(text) <= chunk + overlap:
        return split(text, pattern, odd)
    at = list(range(0, len(text), chunk))
    work = lambda a: _starts(text, a, pattern, odd, chunk, overlap)
    if threads > 1:
        with ThreadPoolExecutor(threads) as pool:
            parts = list(pool.map(work, at))
    else:
        parts = list(map(work, at))
    starts, sure = parts[0]
    cuts: list[int] = []
    k = 1
    while k < len(at):
        ahead, ahead_sure = parts[k]
        there = set(ahead)
        meet = next((p for p in starts if p >= at[k] and p < sure and p in there), None)
        if meet is not None:
            cuts.extend(p for p in starts if p < meet)
            starts, sure = [p for p in ahead if p >= meet], ahead_sure
            k += 1
            continue
        # No common place: go on from the last certain one of what we have, over a longer span.
        last = max((p for p in starts if p < sure), default=starts[0])
        cuts.extend(p for p in starts if p < last)
        span = chunk
        while True:
            more, more_sure = _starts(text, last, pattern, odd, span, overlap)
            if more_sure > len(text) or any(last < p < more_sure for p in more):
                break
            span *= 2
        starts, sure = more, more_sure
        while k < len(at) and at[k] + chunk + overlap <= sure and at[k] < sure:
            k += 1
        if sure > len(text):
            break
    cuts.extend(starts)
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
