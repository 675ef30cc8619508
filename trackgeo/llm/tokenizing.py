"""Token ids of whole texts by a BPE tokenizer with word ends, each distinct word encoded once in a task.

The tokenizer lower-cases, cuts a text into parts (letter runs, digits, signs) by a fixed pattern and never
joins over a cut, so the ids of a text are those of its parts in a row. Texts of Latin letters, digits and
usual signs are cut here by the same pattern and their parts are remembered; any other text goes through the
tokenizer as it is. Results equal those of `encode(text, add_special_tokens=False)`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Characters for which composition and lower-casing are plain, and the tokenizer's word parts.
PLAIN = r"[\x20-\x7E\t\n\x0B\f\r\xA1-įı-ňŊ-ž‐-‧€]*"
LETTERS, DIGITS = r"a-zA-ZªµºÀ-ÖØ-öø-įı-ňŊ-ž", r"0-9²³¹¼-¾"
PARTS = rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{DIGITS}]|[^\x20\t\n\x0B\f\r{LETTERS}{DIGITS}]+"
MOST_WORDS, MOST_PARTS = 600_000, 400_000


def encoder(path: str, width: type = np.uint32) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian integers of `width`. Loads the file once."""
    import os
    import re
    from array import array

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, shown = tokenizer.model, _byte_letters()
    plain, parts = re.compile(PLAIN).fullmatch, re.compile(PARTS).findall

    kind = "I" if width is np.uint32 else "H"

    class Parts(dict):
        def __missing__(self, part: str) -> bytes:
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(shown)
            ids = array(kind, [t.id for t in model.tokenize(letters)]).tobytes()
            if len(part) <= 200:  # long junk is not kept
                self[part] = ids
            return ids

    of_part = Parts()

    class Words(dict):
        def __missing__(self, raw: bytes) -> bytes:
            ids = b"".join(map(of_part.__getitem__, parts(raw.decode().lower())))
            if len(raw) <= 200:
                self[raw] = ids
            return ids

    of_word = Words()

    def encode(text: str) -> bytes:
        for held, most in ((of_word, MOST_WORDS), (of_part, MOST_PARTS)):
            if len(held) > most:
                held.clear()
        if plain(text) and "<|" not in text:
            return b"".join(map(of_word.__getitem__, text.encode().split()))
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, width).tobytes()

    return encode


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(others)}
