"""Token ids of whole texts from the tokenizers library, for vocabularies that drop white space.

Such a tokenizer treats the pieces between white space one by one, so ids of pieces are remembered and
only new pieces go to the library. Ids are kept as little-endian unsigned 16-bit numbers.
"""

from __future__ import annotations

import gc
import os
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from .pretokens import WHITE_SPACE, text_windows

CACHED = 500_000  # pieces of a generation
CACHED_LENGTH = 64
BATCH = 2 << 20  # characters whose new pieces go to the library together

_PIECE = re.compile(f"[^{WHITE_SPACE}]+")
_PUNCTUATION = "!\"#$%&()*+,-./:;=?@[]^_`{|}~"  # of ASCII, without the characters of contractions and special tokens
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch  # letters that normal forms and lower case treat one by one
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space for str.split, but not in Unicode


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        vocabulary = self.library.get_vocab()
        if len(vocabulary) > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.ends_word = np.zeros(1 << 16, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # Two generations: what was not used since the last change is forgotten at the next one.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, two bytes each; null counts as empty."""
        # Nothing here makes cycles, but many short-lived objects, for which the collector would go through all pieces known.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encoded(texts)
        finally:
            if collects:
                gc.enable()

    def _encoded(self, texts: list[str | None]) -> list[bytes]:
        made: list[list[bytes]] = [[] for _ in texts]
        waiting, size = [], 0
        for row, text in enumerate(texts):
            for part in text_windows(text or "", BATCH):
                waiting.append((row, part))
                size += len(part)
                if size >= BATCH:
                    self._add(made, waiting)
                    waiting, size = [], 0
        self._add(made, waiting)
        return [b"".join(parts) for parts in made]

    def _add(self, made: list[list[bytes]], waiting: list[tuple[int, str]]) -> None:
        known, gaps, fresh = self.known.get, [], set()
        for row, part in waiting:
            found = _PIECE.findall(part) if _SEPARATORS.search(part) else part.split()
            ids = list(map(known, found))
            places = [i for i, x in enumerate(ids) if x is None]
            if not places:
                made[row].append(b"".join(ids))
                continue
            missing = [found[i] for i in places]
            fresh.update(missing)
            gaps.append((len(made[row]), row, ids, places, missing))
            made[row].append(b"")
        new = {piece: self.older[piece] for piece in fresh if piece in self.older}
        new |= self._pieces([piece for piece in fresh if piece not in new])
        for place, row, ids, places, missing in gaps:
            for i, piece in zip(places, missing, strict=True):
                ids[i] = new[piece]
            made[row][place] = b"".join(ids)
        self._remember({piece: ids for piece, ids in new.items() if len(piece) <= CACHED_LENGTH})

    def _remember(self, new: dict[str, bytes]) -> None:
        if len(self.known) + len(new) > CACHED:
            self.older, self.known = self.known, {}
        self.known |= new

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces. Words with punctuation behind them are looked up as two pieces."""
        parts, others = {}, []
        for piece in pieces:
            word = piece if piece.isalpha() else piece.rstrip(_PUNCTUATION)
            if (word.isascii() and word.isalpha()) or _WORD(word):
                parts[piece] = (word.lower(), piece[len(word) :])
            else:
                others.append(piece)
        plain = {word for word, _ in parts.values()}
        ends = {end for _, end in parts.values() if end}
        found = {x: self.known.get(x) or self.older.get(x) for x in plain | ends}
        words = [x for x in plain if found[x] is None]
        found |= zip(words, self._words(words), strict=True)
        others += [x for x in ends if found[x] is None]
        encoded = self.library.encode_batch_fast(others, add_special_tokens=False) if others else []
        found |= {x: np.array(e.ids, dtype="<u2").tobytes() for x, e in zip(others, encoded, strict=True)}
        self._remember({x: found[x] for x in [*words, *ends]})
        return found | {piece: found[word] + (found[end] if end else b"") for piece, (word, end) in parts.items()}

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters, all in one call; a token that ends a word parts them."""
        if not words:
            return []
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u2")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
        if len(ends) != len(words):
            raise ValueError("the vocabulary does not mark the ends of words")
        data = ids.tobytes()
        return [data[2 * a : 2 * b] for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
