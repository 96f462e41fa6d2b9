"""Token ids of a public tokenizer file, word by word with a bounded memory of words seen."""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

# The split of the vocabulary's own file, for texts of printable Latin-1 characters. Letters and numbers
# are those of that block.
LETTER, NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{LETTER}{NUMBER}]+")
PLAIN = re.compile(r"[!-~¡-¬®-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = _byte_letters()


class WordIds(dict):
    """Ids of texts under a byte-level vocabulary with word ends that drops white space.

    White space separates words before anything else in such a vocabulary, so that a text's ids are those of its words.
    The dictionary maps a word to its place in the arrays; at ``most`` words it is emptied and begins anew.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.clear_words()

    def clear_words(self) -> None:
        self.clear()
        self.starts, self.sizes = np.zeros(self.most + 1, np.int64), np.zeros(self.most + 1, np.int64)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0

    def of_word(self, word: bytes) -> list[int]:
        if word.isalpha():  # ASCII letters alone are one piece
            return [t.id for t in self.model.tokenize(word.lower().decode())]
        text = word.decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and "<|" not in text:
            out = []
            for piece in PIECE.findall(text.lower()):
                if not piece.isascii():
                    piece = "".join(map(LETTERS.__getitem__, piece.encode()))
                out += [t.id for t in self.model.tokenize(piece)]
            return out
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, word: bytes) -> int:
        ids = self.of_word(word)
        place, end = len(self), self.used + len(ids)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : end] = ids
        self.starts[place], self.sizes[place] = self.used, len(ids)
        self.used = end
        self[word] = place
        return place

    def encode(self, text: bytes) -> np.ndarray:
        words = text.split()
        done = []
        # A text of more words than the memory holds is taken in parts.
        for at in range(0, max(1, len(words)), self.most // 2):
            part = words[at : at + self.most // 2]
            if len(self) + len(part) > self.most:
                self.clear_words()
            places = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            sizes = self.sizes[places]
            before = np.cumsum(sizes) - sizes
            done.append(self.flat[np.repeat(self.starts[places] - before, sizes) + np.arange(sizes.sum())])
        return done[0] if len(done) == 1 else np.concatenate(done)
