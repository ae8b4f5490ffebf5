"""Token ids of whole texts by a public vocabulary whose words end at white space."""

from __future__ import annotations

import importlib.util
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

FOLDER = "/opt/tokenizers"
#: Parts of words remembered by a task before it starts afresh: a bound of its memory.
REMEMBERED = 150_000
#: Texts whose normal form is their lower case and nothing else: Latin-1 without odd controls and spaces.
SIMPLE = re.compile(r"[\x09-\x0d\x20-\x7e\xa1-\xff]*")
#: How the vocabulary's own pre-tokenizer splits such texts in lower case; fixed by word_bpe_49k.json:
#: contractions, runs of letters, single digits, runs of what is neither nor white space.
LETTERS, DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\x09-\x0d\x20{LETTERS}{DIGITS}]+")


def vocabulary_path(name: str = "word_bpe_49k.json", folder: str = FOLDER) -> str:
    """The file's place: by the installed ``public_tokenizers``, or in ``folder``."""
    if found := importlib.util.find_spec("public_tokenizers"):
        return os.path.join(os.path.dirname(found.origin), name)
    return os.path.join(folder, name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from 256 on."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, nxt = {b: chr(b) for b in same}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(nxt)
            nxt += 1
    return out


class WordTokens:
    """Encodes texts by their parts: in this kind of vocabulary no token reaches across white space or
    from one part of a word to the next, so a text's ids are its parts' ids one after another.

    Parts of plain Latin-1 go to the tokenizer's model once each, which spares its bookkeeping of
    offsets. Words beyond Latin-1, and those that hold a special token, take the tokenizer's full way."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or "(?!)")
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        for text in texts:
            text = text or ""
            if self.plain(text):
                yield self.simple(text)
            else:  # bytes.split() knows ASCII white space only
                words = map(bytes.decode, text.encode().split())
                yield b"".join(self.simple(w) if self.plain(w) else self.full(w) for w in words)

    def plain(self, text: str) -> bool:
        return bool(SIMPLE.fullmatch(text)) and not self.special.search(text)

    def full(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def simple(self, text: str) -> bytes:
        parts = PARTS.findall(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for p in parts:
                if p not in self.known:
                    spelled = p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode()))
                    self.known[p] = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled))
            return b"".join(map(self.known.__getitem__, parts))
