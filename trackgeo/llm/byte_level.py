"""Token ids of whole texts by a byte-level BPE tokenizer, each distinct chunk encoded once in a task.

The tokenizer cuts a text into parts by a fixed pattern (a letter run, digit run or sign run with at most one space
in front, or white space) and never joins over a cut. A single space before a part always opens that part, so
a text of Latin letters, digits and usual signs can be cut at spaces, and the ids of each chunk be remembered, for all
tasks of a Python worker. White-space
runs of three or more, and runs of two at the end, can hold a cut that depends on both sides: such texts
are cut by the whole pattern. Any other text goes through the tokenizer as it is. Results equal those of
`encode(text, add_special_tokens=False)`.
"""

from __future__ import annotations

from collections.abc import Callable

from trackgeo.llm.tokenizing import DIGITS, LETTERS, PLAIN, _byte_letters

#: The tokenizer's parts, over the letters, digits and white space of `PLAIN` texts.
BLANK = r"\x20\t\n\x0B\f\r"
PARTS = (rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{BLANK}{LETTERS}{DIGITS}]+"
         rf"|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
MOST_KEPT, LONGEST_KEPT = 200_000, 100


def encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit integers, made once in a worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tokenizers

    # Tasks unpickle this function anew, so what outlives a task hangs on the imported library.
    held = tokenizers.__dict__.setdefault("_encoders_of_this_worker", {})
    if path not in held:
        held[path] = _encoder(path)
    return held[path]


def _encoder(path: str) -> Callable[[str], bytes]:
    import re
    from array import array

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenize, shown = tokenizer.model.tokenize, {byte: chr(letter) for byte, letter in _byte_letters().items()}
    plain, parts = re.compile(PLAIN).fullmatch, re.compile(PARTS).findall
    crossing = re.compile(rf"[{BLANK}]{{3}}|[{BLANK}]{{2}}\Z").search
    rare = ("  ", " \n", "\n ", "\t", "\x0B", "\f", "\r")  # no long run of blanks that holds a space is without one of these

    def one(part: str) -> bytes:
        if part.isascii() and part.isprintable():  # only the space has another letter
            letters = part.replace(" ", shown[0x20])
        else:
            letters = part.encode().decode("latin-1").translate(shown)
        return array("I", [t.id for t in tokenize(letters)]).tobytes()

    class Kept(dict):
        """Ids by text, computed where missing. Of a full table the texts in use move on, the others are forgotten."""

        def __init__(self, make: Callable[[str], bytes]):
            self.make, self.old = make, {}

        def __missing__(self, text: str) -> bytes:
            ids = self.old.get(text)
            if ids is None:
                ids = self.make(text)
                if len(text) > LONGEST_KEPT:
                    return ids
            self[text] = ids
            return ids

        def tidy(self) -> None:
            if len(self) > MOST_KEPT:
                self.old = dict(self)
                self.clear()

    of_part = Kept(one)

    def spaced(chunk: str) -> bytes:
        if chunk.isalpha() and chunk.isascii():
            return array("I", [t.id for t in tokenize(shown[0x20] + chunk)]).tobytes()
        return b"".join(map(of_part.__getitem__, parts(" " + chunk)))

    of_chunk = Kept(spaced)

    def encode(text: str) -> bytes:
        of_chunk.tidy()
        of_part.tidy()
        if not plain(text) or "<|" in text:
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if any(sign in text for sign in rare) and crossing(text) or text[-2:].isspace():
            return b"".join(map(of_part.__getitem__, parts(text)))
        first, _, rest = text.partition(" ")
        opening = b"".join(map(of_part.__getitem__, parts(first)))
        return opening + b"".join(map(of_chunk.__getitem__, rest.split(" "))) if _ else opening

    return encode
