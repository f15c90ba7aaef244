"""Subword ids of many texts at once: each different word of a batch is encoded once.

Texts are cut at ASCII white space, which neither normalisation nor pre-tokenisation of the used
vocabularies looks across, so the ids of a text are those of its words in a row.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 400_000  # words a worker remembers; fewer where spelling a word anew is cheap
CACHE_CHEAP = 80_000


class WordIds:
    """Ids of words by a vocabulary file (of tokenizers, or ranks of tiktoken), with a bounded cache:
    when it is full, the words met since the last time are kept and the others forgotten.

    Unknown words are encoded many at a time as one text, with a null character between them whose
    id shows where one ends; words that hold one, or spell a special token, are encoded alone.
    """

    def __init__(self, path: str, prefix: str = ""):
        self.alone, cheap = ["\x00"], path.endswith(".tiktoken")
        self.most = CACHE_CHEAP if cheap else CACHE
        if cheap:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encoder = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.spell = encoder.encode_ordinary
        else:
            from tokenizers import Tokenizer

            encoder = Tokenizer.from_file(path)
            self.alone += [t.content for t in encoder.get_added_tokens_decoder().values()]
            self.spell = lambda text: encoder.encode(text, add_special_tokens=False).ids
        self.lone = re.compile("|".join(map(re.escape, self.alone)))
        self.prefix = prefix
        one, three = self._ids(prefix + "a"), self._ids(prefix + "a \x00 a")
        self.between = three[len(one) : len(three) - len(one)]
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.spell(text), "<u4")

    def encode(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        if len(self.cache) > self.most:
            self.older, self.cache = self.cache, {}
        cache, prefix = self.cache, self.prefix
        new = list(dict.fromkeys(w for w in words if w not in cache))
        if self.older:
            cache.update((w, x) for w in new if (x := self.older.get(w)) is not None)
            new = [w for w in new if w not in cache]
        odd, plain = [], new
        if self.lone.search("\n".join(new)):  # words hold no white space, so nothing is found across them
            odd = [w for w in new if self.lone.search(w)]
            plain = [w for w in new if not self.lone.search(w)]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            ids = self._ids(prefix + " \x00 ".join(part))
            ends = np.r_[np.flatnonzero(ids == self.between[-1]), len(ids) + len(self.between) - 1]
            if len(ends) != len(part):
                raise ValueError("the separator did not show once between words")
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, ends.tolist()):
                cache[w] = raw[4 * start : 4 * (end - len(self.between) + 1)]
                start = end + 1
        for w in odd:
            cache[w] = self._ids(prefix + w).tobytes()
        return [cache[w] for w in words]


@lru_cache(maxsize=4)
def word_ids(path: str, prefix: str = "") -> WordIds:
    """One encoder per Python worker and file."""
    return WordIds(path, prefix)


def ranges(sizes: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of sizes, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def encode_texts(coder: WordIds, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, with `end` after each text if given, and the count per text.
    Null texts are empty."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    return encode_words(coder, *words_of(split), end)


def words_of(split: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The non-empty words of lists in a row, and where each list's begin and end."""
    flat, ends = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))][ends]


def encode_words(coder: WordIds, flat: pa.Array, lists: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """encode_texts for texts that are cut into words already."""
    coded = flat.dictionary_encode()
    got = coder.encode(coded.dictionary.to_pylist())
    size = np.array([len(b) // 4 for b in got], np.int64)
    table, first = np.frombuffer(b"".join(got), "<u4"), np.r_[0, np.cumsum(size)]
    index = coded.indices.to_numpy()
    n = size[index]
    ids = table[np.repeat(first[index], n) + ranges(n)]
    upto = np.r_[0, np.cumsum(n)][lists - lists[0]]
    counts = np.diff(upto)
    if end is not None:
        ids = np.insert(ids, upto[1:], end)
        counts = counts + 1
    return ids, counts


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `most` bytes; a longer text is alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto
