"""Token ids of whole texts with a public tokenizer's vocabulary."""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterable

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

DEFAULT = "byte_bpe_50k.json"
# White space next to white space: there the pieces before the merges are not cut at single spaces.
_CROWDED = re.compile(r"\s\s")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Byte-level BPE that encodes each distinct space-led word once and keeps it.

    ``path`` is a tokenizer file. If its vocabulary also lies beside it as ranks (same name, ``.tiktoken``),
    the ranks are used: the same ids, several times faster on single words.

    Before its merges the tokenizer cuts a text in front of every single space between two non-spaces, so
    a text's ids are its words' ids in a row. Texts with adjoining white space are encoded whole. The
    strings of special tokens are ordinary text. At most ``most_words`` words are kept, then the memory is
    emptied; that changes the speed only.
    """

    def __init__(self, path: str, most_words: int = 500_000):
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
            fast = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.encode = fast.encode_ordinary
        else:
            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self.encode = lambda text: whole.encode(text, add_special_tokens=False).ids
        self.most_words = most_words
        self.known: dict[str, bytes] = {}

    def ids(self, texts: Iterable[str]) -> list[bytes]:
        """Unsigned 32-bit ids (little-endian, as on every machine Spark supports) of each text."""
        return [self._whole(t) if _CROWDED.search(t) else self._by_words(t) for t in texts]

    def _whole(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def _by_words(self, text: str) -> bytes:
        first, *words = text.split(" ")  # the words are keyed without the space that leads them
        try:
            return self._whole(first) + b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > self.most_words:
                self.known.clear()
            for w in words:
                if w not in self.known:
                    self.known[w] = self._whole(" " + w)
            return self._whole(first) + b"".join(map(self.known.__getitem__, words))


def encoder(path: str | None = None) -> Encoder:
    """One encoder per file and Python worker."""
    path = path or public_tokenizers.path(DEFAULT)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
