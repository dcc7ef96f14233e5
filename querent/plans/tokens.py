"""Token counters from the vocabulary files of public tokenizers, by path, for prompt budgets."""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass

#: How a text is split before its parts are merged, where a file of ranks does not say: contractions, words, numbers, marks, white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[TokenFile, Callable[[str], int]] = {}


@dataclass(frozen=True)
class TokenFile:
    """A factory of counters: path is a file of ranks (`.tiktoken`), a piece model (`.model`) or a tokenizer as JSON. Each worker loads it once."""

    path: str
    pattern: str = PATTERN

    def __call__(self) -> Callable[[str], int]:
        if self not in _loaded:
            _loaded[self] = self._load()
        return _loaded[self]

    def _load(self) -> Callable[[str], int]:
        if self.path.endswith(".tiktoken"):
            import tiktoken

            with open(self.path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            return lambda text: len(encoding.encode_ordinary(text))
        if self.path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=self.path)
            return lambda text: len(pieces.encode(text))
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
