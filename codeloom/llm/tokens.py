"""Token ids by the tokenizers library, a word at a time and each distinct word once.

The pre-tokenizers of both vocabularies never join a non-space character to a
following space, so a text's ids are those of its pieces ``spaces + word``. Texts
with the control characters U+001C to U+001F, of which Python and the tokenizer
disagree whether they are spaces, are encoded whole; so are texts that may hold an
added token of the vocabulary, such as an end mark, as the library finds those first.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

import numpy as np

from codeloom.llm._util import WordCache

_PIECES = re.compile(r"\s*\S+|\s+")
_UNSURE = "\x1c\x1d\x1e\x1f"
#: Where cutting before each blank or line end is not certain: more than one blank in a row, or blanks of other kinds.
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
_WIDE_BLANK = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_START = "\x1c"  # marks a text's first word, which has no blank before it; texts with this character go another way
#: Words after a space, of characters that normalisation leaves alone but for lower case of the same length.
_PLAIN = re.compile("[ \t\n\r]+[!-~À-ÖØ-öø-ÿ]{1,64}")
_PLAIN_BARE = re.compile("[!-~À-ÖØ-öø-ÿ]{1,64}")
_LATIN = re.compile("[\x00-\xff]*")
#: Both pre-tokenizers cut between a letter and a tail of these.
_TAIL = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
LONG_WORD = 4096
CACHE_BYTES = 128 << 20  # of a generation of the words known
TOGETHER = 1 << 14  # characters
MOST_TAILS = 100_000
AT_ONCE = 100  # new words that go through the library in one text


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.lib = self.bare = Tokenizer.from_file(path)
        self.drops_spaces = self.lib.normalizer is not None
        if self.drops_spaces:
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = None  # for words that normalisation would leave as they are
        for lib in (self.lib, self.bare):
            lib.model._resize_cache(0)  # words come to the library once: keeping them again costs more than it saves
        added = self.lib.get_added_tokens_decoder().values()
        self.marks = sorted({"" if t.normalized else t.content[:2] for t in added})  # how added tokens begin; "" is in every text
        vocabulary = self.lib.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token.removesuffix("</w>"))  # byte-level: a character for each byte
        self.tails: dict[str, bytes] = {}
        self.cache = WordCache(self._fresh)

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]

    def _fresh(self, words: list[str]) -> list[bytes]:
        """New words; those of letters and a tail are put together from the two."""
        cache, tails = self.cache, self.tails
        stems = [w.rstrip(_TAIL) for w in words]
        stems = [x if x is not w and x.isalpha() and x[-1] <= "\xff" else None for x, w in zip(stems, words, strict=True)]
        ends = [w[len(x) :] if x else None for x, w in zip(stems, words, strict=True)]
        used = set(filter(None, ends))
        if not used <= tails.keys():
            new = list(used.difference(tails))
            if len(tails) + len(new) > MOST_TAILS:
                tails.clear()
                new = list(used)
            tails.update(zip(new, self._one_by_one(new), strict=True))
        plain = [w for w, x in zip(words, stems, strict=True) if not x]
        new = [x for x in set(filter(None, stems)) if x not in cache and x not in cache.old]
        got = self._encoded(plain + new)
        cache.add(new, got[len(plain) :])
        rest = iter(got)
        return [cache[x] + tails[y] if x else next(rest) for x, y in zip(stems, ends, strict=True)]

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Words go through the library many in a row, and are told apart by how many
        bytes their tokens stand for; where that is not certain, one by one."""
        if not self.drops_spaces:  # the words as they stand in the text
            words = [w[1:] if w[0] == _START else w if w[0] == "\n" else " " + w for w in words]
        out: list[bytes] = [b""] * len(words)
        match = (_PLAIN_BARE if self.drops_spaces else _PLAIN).fullmatch
        between = " " if self.drops_spaces else ""
        plain = [i for i, w in enumerate(words) if match(w)]
        rest = sorted(set(range(len(words))).difference(plain))
        for a in range(0, len(plain), AT_ONCE):
            some = plain[a : a + AT_ONCE]
            these = [words[i] for i in some]
            text = between.join(these)
            if self.drops_spaces:
                text = text.lower()
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.cumsum(np.fromiter(map(len, these if text.isascii() else map(str.encode, these)), dtype=np.int64, count=len(these)))
            stands = np.cumsum(self.bytes_of[ids])
            cuts = np.searchsorted(stands, ends) + 1
            if cuts[-1] != len(ids) or (stands[cuts - 1] != ends).any():
                rest += some
                continue
            raw, low = ids.tobytes(), 0
            for i, high in zip(some, (4 * cuts).tolist(), strict=True):
                out[i] = raw[low:high]
                low = high
        for i, found in zip(rest, self._one_by_one([words[i] for i in rest]), strict=True):
            out[i] = found
        return out

    def whole(self, text: str) -> bytes:
        return self._one_by_one([text])[0]

    def split(self, text: str | None) -> list[str] | None:
        """The words that make up the text's ids; None: to be encoded whole."""
        if not text or any(c in text for c in _UNSURE) or any(m in text for m in self.marks):
            return None
        if self.drops_spaces:  # and lower-cases: in Latin-1 a character at a time
            words = text.lower().split() if _LATIN.fullmatch(text) else text.split()
        elif text[0] in " \n" or text[-1] in " \n" or any(r in text for r in _RUNS) or (not text.isascii() and _WIDE_BLANK.search(text)):
            words = [w[1:] if w[0] == " " and w[1:2] not in ("", "\n", _START) and not w[1].isspace() else _START + w for w in _PIECES.findall(text)]
        else:
            words = text.replace("\n", " \n").split(" ")
            words[0] = _START + words[0]
        return words if len(words) >= 64 or len(text) <= LONG_WORD * 8 else None

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; texts go through together as long as their words stay in the processor's cache."""
        out: list[bytes] = []
        a, held = 0, 0
        for i, text in enumerate(texts):
            held += len(text or "")
            if held > TOGETHER and i > a:
                out += self._encode_some(texts[a:i])
                a, held = i, len(text or "")
        return out + self._encode_some(texts[a:])

    def _encode_some(self, texts: list[str | None]) -> list[bytes]:
        """The new words of all of ``texts`` are learned at once."""
        split = list(map(self.split, texts))
        ids = self.cache.lookup(list(chain.from_iterable(w for w in split if w)))
        out, a = [], 0
        for words, text in zip(split, texts, strict=True):
            if words is None:
                out.append(self.whole(text) if text else b"")
            else:
                out.append(b"".join(ids[a : a + len(words)]))
                a += len(words)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].cache.limit = cache_bytes
    return _encoders[path]
