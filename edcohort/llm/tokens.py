"""Token ids of whole texts by a public tokenizer file, inside tasks.

The files used here cut at ASCII white space before anything else, so a text's
ids are its words' ids in order. A task keeps the ids of words it has met (a
bounded cache) and gives only new words to the tokenizers library. ``joined``
does so text by text, ``batch`` for the distinct words of many texts at once.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .cache import Recent

#: Cached words per generation.
CACHE_WORDS = 400_000
#: Bytes of text whose words are looked up together, at least.
BATCH_BYTES = 1 << 24
#: New words given to the merge model as one text.
TEXT_WORDS = 500
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 stands for
    itself, the other bytes for the letters from U+0100 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; a path of one's own passes through."""
    if os.path.dirname(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


#: A full stop or comma that ends a word: the pre-tokeniser cuts there anyway.
WORD_END = re.compile(rb"([.,])(?<=[a-z0-9].)(?=\s|$)")
#: Words that the normaliser leaves as they are and the pre-tokeniser whole.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
#: ASCII signs but the apostrophe: a run of them after letters is one piece.
SIGNS = r"[!-&(-/:-@\[-`{-~]"
SIGN_LETTERS = string.punctuation.replace("'", "")
#: Words of letters with a composed lower case, and a run of signs at most.
STEM = "^[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"
LETTERS = STEM + SIGNS + "*$"


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), then the next run."""
    ends = np.cumsum(size)
    places = np.repeat(start - (ends - size), size)
    places += np.arange(len(places))
    return places


class WordTokenizer:
    """Ids of a text (uint32) as the tokenizers library gives them with
    ``add_special_tokens=False``, for a file whose normaliser (composition,
    lower case) and pre-tokeniser (letters, digits, others) work within
    white-space separated words.

    Plain words go straight to the library's merge model in its byte letters;
    all others through its whole pipeline, word by word."""

    def __init__(self, path: str = WORD_BPE, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(vocabulary(path))
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = {t.content.encode() for t in self.library.get_added_tokens_decoder().values()}
        self.letters = {b: c for c, b in byte_letters().items()}
        self.cache = Recent(self._ids, cache_words)
        self.cache_words = cache_words
        # words met by ``batch``: word i has ``size[i]`` ids from ``start[i]`` on in the pool
        self.words, self.pool = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # the merge model alone, for words in byte letters; a word's last token is one of ``last``
        from tokenizers import Tokenizer, pre_tokenizers
        self.spaced = {b: c for b, c in self.letters.items() if b != 32}
        self.merges = Tokenizer(self.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        suffix = getattr(self.model, "end_of_word_suffix", None)
        vocab = self.library.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True

    def _ids(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if PLAIN(text):
            if not text.isascii():
                text = word.decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(text)]
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def joined(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not any(s in raw.lower() for s in self.special):  # lower case must not make a special token
            raw = WORD_END.sub(rb" \1", raw.lower())
        return b"".join(map(self.cache.__getitem__, raw.split()))

    def _letter_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of ``LETTERS`` words one after another and each word's number of
        them. Distinct pieces are encoded once and told apart by their last
        tokens (None if the file does not mark these)."""
        signed = pc.match_substring_regex(words, SIGNS + "$")
        whole, cut = words.filter(pc.invert(signed)), words.filter(signed)
        pieces = pa.concat_arrays([whole, pc.ascii_rtrim(cut, SIGN_LETTERS),
                                   pc.replace_substring_regex(cut, STEM, "")]).dictionary_encode()
        distinct = pieces.dictionary
        lists = pa.ListArray.from_arrays([*range(0, len(distinct), TEXT_WORDS), len(distinct)], distinct)
        texts = [t.lower() for t in pc.binary_join(lists, " ").to_pylist()]
        texts = [t if t.isascii() else t.encode().decode("latin-1").translate(self.spaced) for t in texts]
        ids = np.concatenate([np.array(e.ids, np.uint32)
                              for e in self.merges.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(distinct):
            return None
        at, tail = pieces.indices.to_numpy(), signed.to_numpy(zero_copy_only=False)
        parts = np.full((len(words), 2), len(ends))  # a word's pieces; the one beyond the last is empty
        parts[~tail, 0] = at[:len(whole)]
        parts[tail] = at[len(whole):].reshape(2, -1).T
        size = np.append(np.diff(ends, prepend=0), 0)
        start = np.append(ends, 0) - size
        return ids[_runs(start[parts.ravel()], size[parts.ravel()])], size[parts].sum(1)

    def _meet(self, words: pa.Array) -> None:
        """Adds distinct words not met before."""
        letters = pc.match_substring_regex(words, LETTERS).to_numpy(zero_copy_only=False)
        easy = words.filter(pa.array(letters))
        found = self._letter_ids(easy) if len(easy) else None
        if found is None:
            letters[:] = False
        other = [self._ids(w) for w in words.filter(pa.array(~letters)).cast(pa.binary()).to_pylist()]
        size = np.empty(len(words), np.int64)
        size[~letters] = np.fromiter(map(len, other), np.int64, len(other)) // 4
        pool = [self.pool, np.frombuffer(b"".join(other), "<u4")]
        if found is not None:
            size[letters] = found[1]
            pool.append(found[0])
        order = np.concatenate([np.flatnonzero(~letters), np.flatnonzero(letters)])
        start = np.empty(len(words), np.int64)
        start[order] = len(self.pool) + np.cumsum(size[order]) - size[order]
        self.words, self.pool = pa.concat_arrays([self.words, words]), np.concatenate(pool)
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])

    def _places(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words among those met."""
        at = pc.index_in(words, value_set=self.words)
        new = at.is_null()
        numbers = at.fill_null(0).to_numpy().copy()
        if at.null_count:
            fresh = new.to_numpy(zero_copy_only=False)
            if len(self.words) + at.null_count > 2 * self.cache_words:
                self._keep(numbers[~fresh])
                numbers[~fresh] = np.arange(len(self.words))
            numbers[fresh] = len(self.words) + np.arange(at.null_count)
            self._meet(words.filter(new))
        return numbers

    def _keep(self, at: np.ndarray) -> None:
        """Forgets all words but those numbered ``at``."""
        size = self.size[at]
        self.pool = self.pool[_runs(self.start[at], size)]
        self.words, self.start, self.size = self.words.take(pa.array(at)), np.cumsum(size) - size, size

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """``joined`` of every text; each distinct word of some ``BATCH_BYTES``
        of text is looked up once."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        part = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield from self._joined(texts.slice(a, b - a))

    def _joined(self, texts: pa.Array) -> Iterator[bytes]:
        lower = pc.ascii_lower(texts)
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(lower, s.decode()).to_numpy(zero_copy_only=False)
        if special.any():
            lower = pc.if_else(pa.array(special), "", lower)
        words = pc.ascii_split_whitespace(lower)
        coded = words.flatten().dictionary_encode()
        at = self._places(coded.dictionary)[coded.indices.to_numpy()]
        n = self.size[at]
        ids = self.pool[_runs(self.start[at], n)]
        offsets = words.offsets.to_numpy()
        cuts = np.concatenate([[0], np.cumsum(n)])[offsets - offsets[0]].tolist()
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            yield self.joined(texts[i].as_py()) if special[i] else ids[a:b].tobytes()

    def __call__(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.joined(text), "<u4")


@lru_cache(maxsize=2)
def word_tokenizer(path: str = WORD_BPE) -> WordTokenizer:
    """One per Python worker, so later tasks of it find a filled cache."""
    return WordTokenizer(path)
