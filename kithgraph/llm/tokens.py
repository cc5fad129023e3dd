"""Token ids by a public tokenizer file, with a cache of words in each Python worker.

A word is what stands between blanks or line breaks: the tokenizer never joins across
them, so the ids of a text are those of its words in order. A text that holds the literal of an added token
(as "<|endoftext|>") is encoded whole, as the tokenizer does at its defaults.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept in a worker; the cache is emptied beyond this.
CACHE_WORDS = 300_000
#: Longer words are encoded anew each time.
CACHE_LENGTH = 48
_TAILED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
_ENCODERS: dict[str, "WordEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str | None = None) -> "WordEncoder":
    path = path or default_path()
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class WordEncoder:
    """Encodes string columns for a tokenizer whose tokens end words visibly (word_bpe)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.literals = sorted(x.content for x in self.plain.get_added_tokens_decoder().values())
        # words never hold a literal as it is written, but lower-casing can make one
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")
        self.dtype = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.cache: dict[str, bytes] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> None:
        """Words of letters only are one word to the tokenizer too: many are encoded as one text and cut at the word ends."""
        width = np.dtype(self.dtype).itemsize
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * width
            if len(cuts) != len(part):
                self.cache.update(zip(part, self._ids(part), strict=True))
                continue
            held, start = ids.tobytes(), 0
            for word, end in zip(part, cuts.tolist(), strict=True):
                self.cache[word] = held[start:end]
                start = end

    def _learn(self, words: list[str]) -> None:
        cache = self.cache
        plain, tailed, other = set(), [], []
        for word in words:
            if word.isalpha():
                plain.add(word)
            elif m := _TAILED.fullmatch(word):
                tailed.append((word, m[1], m[2]))
                plain.add(m[1])
                plain.add(m[2])
            else:
                other.append(word)
        plain = [x for x in plain if x not in cache]
        self._letters([x for x in plain if x.isalpha()])
        other += [x for x in plain if not x.isalpha()]
        cache.update(zip(other, self._ids(other), strict=True))
        for word, head, tail in tailed:
            cache[word] = cache[head] + cache[tail]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and len + 1 offsets. Null counts as empty."""
        column = pc.fill_null(column, "")
        marked = np.zeros(len(column), dtype=bool)
        for literal in self.literals:
            marked |= pc.match_substring(column, literal).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._by_words(column)
        ids, at = self._by_words(pc.if_else(pa.array(marked), "", column))
        parts = [ids[b:e] for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for i in np.flatnonzero(marked).tolist():
            parts[i] = np.array(self.plain.encode(column[i].as_py(), add_special_tokens=False).ids, dtype=self.dtype)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def _by_words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What encode returns, for texts without a null and without an added token's literal."""
        column = pc.replace_substring(pc.ascii_lower(column), "\n", " ")
        words = pc.split_pattern(column, " ")
        distinct = words.flatten().dictionary_encode()
        names = distinct.dictionary.to_pylist()
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        missing = [x for x in names if x not in cache]
        if missing:
            self._learn(missing)
        found = [cache[x] for x in names]
        for x in missing:
            if len(x) > CACHE_LENGTH:
                cache.pop(x, None)
        width = np.dtype(self.dtype).itemsize
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // width
        held = np.frombuffer(b"".join(found), dtype=self.dtype)
        begin = np.cumsum(size) - size
        which = distinct.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(size[which])))
        ids = gather(held, begin[which], size[which])
        at = np.asarray(words.offsets.to_numpy(zero_copy_only=False), dtype=np.int64)
        return ids, ends[at - at[0]]


def gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin[0]:begin[0]+size[0]], values[begin[1]:...], ... in one array."""
    full = size > 0
    begin, size = begin[full], size[full]
    if not len(size):
        return values[:0]
    steps = np.ones(int(size.sum()), dtype=np.int64)
    steps[0] = begin[0]
    steps[(np.cumsum(size) - size)[1:]] = begin[1:] - (begin[:-1] + size[:-1]) + 1
    return values[np.cumsum(steps)]
