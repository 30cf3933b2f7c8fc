"""Ids of the tokenizers library for a vocabulary that lower-cases and drops white space, word by word.

Such a vocabulary encodes what stands between spaces or line ends apart from the rest, so equal words are encoded
once and kept, in a cache of bounded size. Words of plain letters go to the library's BPE model directly (its
normalizer and splitter leave them as they are); all others go through the whole library tokenizer.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import cache
from itertools import chain
from struct import pack

import numpy as np

from quillmark.llm.bpe import CACHED_LENGTH

#: Entries of a worker's word cache; when it is full, further words are encoded anew.
CACHE = 1_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Letters that lower-casing, composition and the splitter leave alone.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


def visible_bytes() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    same = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    spare = iter(range(256, 512))
    return {b: chr(b if b in same else next(spare)) for b in range(256)}


class WordCoder:
    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._model = self._tokenizer.model.tokenize
        alphabet = visible_bytes()
        self._letters = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}
        self._cache: dict[bytes, bytes] = {b"": b""}
        self._stops = {c: self._library([c])[0] for c in (".", ",")}
        self._byte_stops = {ord(c): i for c, i in self._stops.items()}

    def _library(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch(words, add_special_tokens=False)]

    def _plain(self, word: str) -> bytes:
        ids = [t.id for t in self._model(word if word.isascii() else word.translate(self._letters))]
        return pack(f"<{len(ids)}I", *ids)

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        out, rest = {}, []
        plain, model, known, stops = self._plain, self._model, self._cache, self._byte_stops
        for w in words:
            # ASCII letters need no second look
            if len(w) <= CACHED_LENGTH and w.islower():
                if w.isalpha():
                    ids = [t.id for t in model(w.decode())]
                    out[w] = pack(f"<{len(ids)}I", *ids)
                    continue
                if w[-1] in stops and (base := w[:-1]).isalpha():
                    out[w] = (known.get(base) or out.get(base) or plain(base.decode())) + stops[w[-1]]
                    continue
            s = w.decode("utf-8", "surrogatepass")
            if len(s) <= CACHED_LENGTH and _PLAIN(s):
                out[w] = self._plain(s)
            elif 1 < len(s) <= CACHED_LENGTH and s[-1] in self._stops and _PLAIN(s, 0, len(s) - 1):
                base = w[:-1]
                out[w] = (self._cache.get(base) or out.get(base) or self._plain(s[:-1])) + self._stops[s[-1]]
            else:
                rest.append(w)
        out.update(zip(rest, self._library([w.decode("utf-8", "surrogatepass") for w in rest]), strict=True))
        return out

    def encode(self, texts: Iterable[str | None], end: int | None = None) -> list[np.ndarray]:
        """Ids of each text (null: empty) as little-endian 32-bit numbers, and end behind them if given."""
        words = []
        for t in texts:
            data = (t or "").encode("utf-8", "surrogatepass")
            if b"<|" not in data:  # strings of special tokens are found before letters are lowered
                data = data.translate(_LOWER)
            words.append(data.replace(b"\n", b" ").split(b" "))
        known = self._cache
        new = self._new(list(set(chain.from_iterable(words)).difference(known)))
        if len(known) + len(new) <= CACHE:
            known.update((w, i) for w, i in new.items() if len(w) <= CACHED_LENGTH)
            new = {w: i for w, i in new.items() if len(w) > CACHED_LENGTH}
        tail = b"" if end is None else int(end).to_bytes(4, "little")
        get = known.__getitem__ if not new else lambda w: known[w] if w in known else new[w]
        return [np.frombuffer(b"".join(map(get, w)) + tail, "<u4") for w in words]


@cache
def word_coder(vocabulary: str) -> WordCoder:
    return WordCoder(vocabulary)


def encoded(texts: list, vocabulary: str, end: int, weight: int = 2_000_000):
    """(position, ids) of texts, encoded in batches of about weight characters."""
    coder, start, held = word_coder(vocabulary), 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= weight or i + 1 == len(texts):
            yield from zip(range(start, i + 1), coder.encode(texts[start : i + 1], end), strict=True)
            start, held = i + 1, 0
