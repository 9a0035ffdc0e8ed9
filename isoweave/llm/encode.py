"""Token ids of whole texts, encoded word by word with a cache.

The tokenizer treats white space as a boundary that no token crosses, so a
text's ids are those of its white-space-separated chunks in order.  Chunks
repeat, so each Python worker keeps their ids; ``CACHE_CHUNKS`` bounds the
memory (about 200 bytes a chunk), and a full cache starts anew.  Words of Latin
letters only, which normalizing changes letter by letter, go to the tokenizer's
model directly; all other chunks go through the whole tokenizer.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Sequence

CACHE_CHUNKS = 800_000
#: Chunks that are looked up together.
PART_CHUNKS = 200_000
#: White space of ASCII; other white space stays inside a chunk, where the tokenizer sees it.
_ASCII_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
#: What str.split() takes for white space beyond that.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


#: ASCII symbols that follow a word as one run of their own; not the apostrophe, which may begin one.
_SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters below this code point don't compose with each other.
_LATIN = 0x250


class ChunkEncoder:
    """Ids as little-endian unsigned 32-bit integers; only for tokenizers that drop white space."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocab.values()) + 1, bool)
        self.word_end[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.letters: dict[str, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.limit = cache_chunks
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        latin = [c for c in map(chr, range(_LATIN)) if self._is_letter(c)]
        #: What the model sees of a letter.
        self.seen = {ord(c): level.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c))[0][0] for c in latin}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self._encode_latin(latin) != self._encode_each(latin):  # another kind of tokenizer
            self.seen = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        if _OTHER_SPACE.search(text):
            return [c for c in _ASCII_SPACE.split(text) if c]
        return text.split()

    def _is_letter(self, c: str) -> bool:
        """Whether the tokenizer, which normalizes first, keeps this character within a run of letters."""
        known = self.letters.get(c)
        if known is None:
            run = self.tokenizer.normalizer.normalize_str(f"a{c}a")
            known = self.letters[c] = c.isalpha() and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(run)) == 1
        return known

    def _encode_each(self, chunks: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Words of letters only, so that each is one run of tokens with a word end at its last."""
        import numpy as np

        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(words):  # some word is not one run after all
            return self._encode_each(words)
        raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _encode_latin(self, words: list[str]) -> list[bytes]:
        """Words of the letters in ``seen``, as the model reads them."""
        import numpy as np

        if not words:
            return []
        tokenize, ids, cuts = self.tokenizer.model.tokenize, [], [0]
        for w in " ".join(words).translate(self.seen).split(" "):
            ids += [t.id for t in tokenize(w)]
            cuts.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _stem(self, chunk: str) -> str:
        """The chunk without the symbols that follow its last letter; those are a run of their own."""
        stem = chunk if any(t in chunk for t in self.added) else chunk.rstrip(_SYMBOLS)
        return stem if stem and stem[-1].isalpha() and (stem[-1].isascii() or self._is_letter(stem[-1])) else chunk

    def _learn(self, chunks: list[str]) -> None:
        """Puts the ids of chunks that the cache lacks into it."""
        found: dict[str, bytes] = {}
        stems = {c: c if c.isalpha() else self._stem(c) for c in chunks}
        ends = {c[len(s) :] for c, s in stems.items() if len(s) < len(c)}
        todo = [s for s in {*stems.values(), *ends} if s not in self.cache]
        words = [s for s in todo if s.isalpha()]
        beyond = set().union(*(s for s in words if not s.isascii()))
        odd = {c for c in beyond if not self._is_letter(c)}
        wide = {c for c in beyond if ord(c) not in self.seen}
        latin = [s for s in words if s.isascii() or wide.isdisjoint(s)] if self.seen else []
        found.update(zip(latin, self._encode_latin(latin), strict=True))
        plain = [s for s in words if s not in found and odd.isdisjoint(s)]
        found.update(zip(plain, self._encode_words(plain), strict=True))
        rest = [s for s in todo if s not in found]
        found.update(zip(rest, self._encode_each(rest), strict=True))
        self.cache.update(found)
        for c, s in stems.items():
            if len(s) < len(c):
                self.cache[c] = self.cache[s] + self.cache[c[len(s) :]]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        out: list[bytes] = []
        part: list[list[str]] = []
        size = 0
        for text in texts:
            part.append(self.chunks(text or ""))
            size += len(part[-1])
            if size > PART_CHUNKS:
                out += self._encode_part(part)
                part, size = [], 0
        return out + self._encode_part(part)

    def _encode_part(self, part: list[list[str]]) -> list[bytes]:
        new: set[str] = set()
        for words in part:  # a text's own set is small and fast
            new.update(set(words).difference(self.cache))
        if new:
            self._learn([*new])
        known = self.cache.__getitem__
        out = [b"".join(map(known, words)) for words in part]
        if len(self.cache) > self.limit:
            self.cache = {}
        return out


@functools.cache
def encoder(path: str, cache_chunks: int = CACHE_CHUNKS) -> ChunkEncoder:
    """One encoder per Python worker, kept between its tasks."""
    return ChunkEncoder(path, cache_chunks)


def word_bpe() -> str:
    """The place of the installed word_bpe_49k.json."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
