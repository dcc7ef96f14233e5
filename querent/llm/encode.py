"""Token ids of whole texts by a stored tokenizer, with a cache of encoded words.

White space always ends a token of this family of tokenizers (the pre-tokenizer drops
it), so a text's ids are those of its space-separated parts in order; only parts not
seen before are encoded. ``exact`` is the plain path that tests compare with.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

VOCABULARY = "word_bpe_49k.json"
#: Cached words a worker keeps; then the cache starts anew. Bounds memory only.
CACHE = 600_000

#: Text in which lower case can come first: nothing beyond Latin-1 and no marked-up token.
_UNSAFE = re.compile(r"[^\x00-\xff]|<\|")
#: Marks before a stop or comma, which would be one group with it.
_RUN = re.compile(r"[^\w\s][.,] ")

_loaded: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def exact(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _groups(self, groups: list[str]) -> None:
        """Encodes groups (letters alone or marks alone) as one text; the vocabulary marks each group's last token."""
        ids = np.array(self.tokenizer.encode(" ".join(groups), add_special_tokens=False).ids, dtype="<u4")
        stops = (np.flatnonzero(self.last[ids]) + 1).tolist()
        if len(stops) != len(groups):
            raise ValueError("this vocabulary does not mark the ends of words")
        data = ids.tobytes()
        start = 0
        for group, stop in zip(groups, stops, strict=True):
            self.known[group] = data[4 * start : 4 * stop]
            start = stop

    def _learn(self, missing: set[str]) -> None:
        """Encodes new parts: those of Latin-1 letters alone together, the rest one by one."""
        groups = [x for x in missing if x.isalpha() and (x.isascii() or max(x) <= "\xff")]
        if groups:
            self._groups(groups)
        other = [x for x in missing if x not in self.known]
        if other:
            for part, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
                self.known[part] = np.array(e.ids, dtype="<u4").tobytes()

    @staticmethod
    def _parts(text: str) -> list[str]:
        """Pieces between which a token always ends, whose ids in order are the text's."""
        text = text.replace("\n", " ") + " "
        if not _UNSAFE.search(text):
            text = text.lower()
        if not _RUN.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ")
        return text.split(" ")

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self.known
        if len(known) > CACHE:
            known.clear()
            known[""] = b""
        split = [self._parts(text) for text in texts]
        missing = set(chain.from_iterable(split)).difference(known)
        if missing:
            self._learn(missing)
        return [b"".join(map(known.__getitem__, parts)) for parts in split]


def encoder(path: str | None = None) -> Encoder:
    path = path or default_path()
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
