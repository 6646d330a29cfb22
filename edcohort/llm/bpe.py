"""Byte-pair encoding by backtracking, and decoding by an offset table.

Encoding: pre-tokens are cut as the vocabulary's pattern says. Within one, an
Aho-Corasick pass finds the longest token from every place; the encoder goes
left to right with the longest match, and takes it only if the pair with the
token before is compatible: if no merge across their border would have come
first when the merges were applied in order. If not, it tries the next shorter
prefix token, and if none fits it steps back and marks the place as a dead
end. No place is left twice, so work is linear, and the result is what the
merges give in order. Pair checks are kept in a table.

Decoding: all token bytes lie in one buffer; an offset table gives each id's
part, gathered for a whole document at once.

Texts are cut, by their bytes, at borders that are surely pre-token borders.
Each distinct part of some ``BATCH_BYTES`` of text is looked up once among those
a task has met (bounded); new ones go through the encoder together: one
Aho-Corasick pass over all their bytes, then all take their next step at once.
Nothing is shuffled.

Defined cases: null and empty texts have no ids and decode to the empty text;
an empty table gives an empty result; repeated rows give equal rows; further
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_text
from .tokens import BYTE_BPE, _runs, byte_letters, vocabulary

#: Text parts kept between batches, and their bytes.
CACHE_WORDS = 500_000
CACHE_BYTES = 1 << 26
CACHE_PAIRS = 300_000
#: Places of the pair table of a batch's steps (a pair has one; the last stays).
PAIR_BITS = 21
BATCH_BYTES = 1 << 23
#: Bytes of pre-tokens that are encoded together; longer pre-tokens go alone.
STEP_BYTES = 1 << 18
LONG = 64
#: The pre-token pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Tokens as bytes, the merge that makes each, and the search structures.

    ``order[id]`` is the place of the token's merge (bytes: before all)."""

    def __init__(self, path: str):
        import ahocorasick
        with open(vocabulary(path), encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = spec["model"]["vocab"]
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for text, i in ids.items():
            if text not in self.special:
                self.tokens[i] = bytes(letters[c] for c in text)
        of = {t: i for i, t in enumerate(self.tokens) if t}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.order = [-1] * size
        for place, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.merged[left, right] = whole
            if whole not in self.parts:
                self.parts[whole], self.order[whole] = (left, right), place
        self.shorter: list[int] = [-1] * size
        automaton = ahocorasick.Automaton()
        for t, i in of.items():
            if len(t) > 1:
                automaton.add_word(t.decode("latin-1"), i)
            self.shorter[i] = next((of[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in of), -1)
        self.single = np.array([of.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.shorter_of = np.array(self.shorter, np.int64)
        automaton.make_automaton()
        self.automaton = automaton
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.lengths, self.offsets = lengths, np.cumsum(lengths) - lengths
        self.buffer = np.frombuffer(b"".join(self.tokens), np.uint8)


@lru_cache(maxsize=2)
def load(path: str = BYTE_BPE) -> Vocabulary:
    return Vocabulary(path)


class _Pairs(dict):
    """(left, right) -> whether the two can stand side by side."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v = v

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= CACHE_PAIRS:
            self.clear()
        self[pair] = ok = self._compatible(*pair)
        return ok

    def _compatible(self, left: int, right: int) -> bool:
        """Undo merges from the last to the first on the two edges. A merge of
        the edges that is older than all undone so far would have joined them."""
        merged, order, parts = self.v.merged, self.v.order, self.v.parts
        last = len(order) + 1
        while True:
            across = merged.get((left, right))
            # of two equal merges the one further left comes first, so the
            # border loses ties against the left part only
            if across is not None and order[across] < last:
                return False
            if order[left] > order[right]:
                last, left = order[left], parts[left][1]
            elif order[right] >= 0:
                last, right = order[right] + 1, parts[right][0]
            else:
                return True


def _byte_sets() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: 1, 2, 3 for ASCII letters, digits and signs (but ', which can
    start a pre-token of letters), else 0; whether white space can start with
    it; whether white space can end with it."""
    kind = np.zeros(256, np.uint8)
    for b in range(33, 127):
        c = chr(b)
        kind[b] = 1 if c.isalpha() else 2 if c.isdigit() else 3 if c != "'" else 0
    starts, ends = np.zeros(256, bool), np.zeros(256, bool)
    for c in filter(str.isspace, map(chr, range(0x3001))):
        starts[c.encode()[0]] = ends[c.encode()[-1]] = True
    return kind, starts, ends


KIND, STARTS_SPACE, ENDS_SPACE = _byte_sets()


def part_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in the bytes of texts, which start at ``offsets``, where a part
    starts, and the end. No pre-token crosses one, and a part alone is cut as
    it is within its text: the last white space before a word ends the run
    before it, a space is the word's, a line break a pre-token."""
    if not len(raw):
        return np.zeros(1, np.int64)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    kind = KIND[raw]
    cut = edge.copy()
    cut[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    gap = np.flatnonzero((raw == 32) | (raw == 10))
    word_after = ~edge[gap + 1] & ~STARTS_SPACE[raw[np.minimum(gap + 1, len(raw) - 1)]]
    cut[gap[word_after | ~ENDS_SPACE[raw[gap - 1]]]] = True
    cut[gap[word_after & (raw[gap] == 10)] + 1] = True
    return np.flatnonzero(cut)


class Encoder:
    def __init__(self, path: str = BYTE_BPE):
        import regex
        self.v = load(path)
        self.pairs = _Pairs(self.v)
        # pair * 2 + whether it is compatible, at a place given by the pair
        self.known = np.full(1 << PAIR_BITS, -1, np.int64)
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.v.special)) + ")").split \
            if self.v.special else None
        # parts met: part i has ``size[i]`` ids from ``start[i]`` on in the pool
        self.words, self.pool = pa.array([], pa.string()), np.zeros(0, np.uint32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        raw = text.encode("utf-8")
        n, tokens, shorter, pairs = len(raw), self.v.tokens, self.v.shorter, self.pairs
        longest = self.v.single[list(raw)].tolist()
        for end, i in self.v.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - len(tokens[i])] = i  # of one start, later ends are longer
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            end = at + len(tokens[token])
            if not dead[end] and (not out or pairs[out[-1], token]):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = shorter[token]
            while token < 0:
                # nothing fits here: the token before must be a shorter one
                dead[at] = 1
                before = out.pop()
                at -= len(tokens[before])
                token = shorter[before]
        return out

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``_Pairs`` for many pairs; those not at their place are looked up once."""
        pair = left * len(self.v.order) + right
        place = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)
        known = self.known[place]
        missed = np.flatnonzero(known >> 1 != pair)
        if len(missed):
            new, first, at = np.unique(pair[missed], return_index=True, return_inverse=True)
            one = missed[first]
            new = 2 * new + np.fromiter(map(self.pairs.__getitem__, zip(left[one].tolist(), right[one].tolist(),
                                                                        strict=True)), bool, len(new))
            self.known[place[one]] = new
            known[missed] = new[at]
        return known & 1 == 1

    def _steps(self, raw: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``piece`` for all pre-tokens that lie side by side in ``raw``, each
        taking its next step at the same time: ids and each one's number of them."""
        v, n, starts = self.v, len(raw), first
        hits = np.fromiter(chain.from_iterable(v.automaton.iter(raw.tobytes().decode("latin-1"))), np.int64)
        end, token = hits[::2] + 1, hits[1::2]
        begin = end - v.lengths[token]
        inside = end <= np.repeat(stop, stop - first)[begin]
        longest = np.append(v.single[raw], -1)
        longest[begin[inside]] = token[inside]  # of one start, later ends are longer
        # the token taken at a place, where the one before it starts, whether it is in the result
        taken, before = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        used, dead = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        at, token, left = first, longest[first], np.full(len(first), -1)
        while len(at):
            end = at + v.lengths[token]
            ok = ~dead[end]
            test = np.flatnonzero(ok & (left >= 0))
            ok[test] = self._fit(left[test], token[test])
            here, there, took = at[ok], end[ok], token[ok]
            taken[here], used[here], before[there] = took, True, here
            bad = np.flatnonzero(~ok)
            token, left, at = np.where(ok, longest[end], v.shorter_of[token]), np.where(ok, token, left), \
                np.where(ok, end, at)
            bad = bad[token[bad] < 0]
            while len(bad):
                # nothing fits here: the token before must be a shorter one
                back = before[at[bad]]
                dead[at[bad]], used[back] = True, False
                at[bad], token[bad] = back, v.shorter_of[taken[back]]
                left[bad] = np.where(back == first[bad], -1, taken[before[back]])
                bad = bad[token[bad] < 0]
            going = at < stop
            at, token, left, first, stop = at[going], token[going], left[going], first[going], stop[going]
        return taken[used].astype(np.uint32), np.add.reduceat(used, starts, dtype=np.int64)

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pre-tokens in a pool, where each one's start and how many they are."""
        short = pc.less_equal(pc.binary_length(pieces), LONG)
        together, alone = pieces.filter(short), pieces.filter(pc.invert(short)).to_pylist()
        ids, sizes = [], []
        bounds = np.concatenate([[0], np.cumsum(pc.binary_length(together).to_numpy(), dtype=np.int64)])
        raw = np.frombuffer("".join(together.to_pylist()).encode(), np.uint8)
        cuts = np.flatnonzero(np.diff(bounds[:-1] // STEP_BYTES)) + 1
        for part in np.split(np.arange(len(together)), cuts) if len(together) else []:
            a, b = bounds[part[0]], bounds[part[-1] + 1]
            for all_of, one in zip((ids, sizes), self._steps(raw[a:b], bounds[part] - a, bounds[part + 1] - a),
                                   strict=True):
                all_of.append(one)
        for text in alone:
            ids.append(np.array(self.piece(text), np.uint32))
            sizes.append(np.array([len(ids[-1])]))
        order = np.concatenate([np.flatnonzero(short), np.flatnonzero(pc.invert(short))])
        size, start = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        size[order] = counted = np.concatenate(sizes)
        start[order] = np.cumsum(counted) - counted
        return np.concatenate(ids), start, size

    def _meet(self, words: pa.Array) -> None:
        """Adds distinct parts not met before."""
        found = list(map(self.find, words.to_pylist()))
        pieces = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
        ids, start, size = self._encode(pieces.dictionary)
        at = pieces.indices.to_numpy()
        count = np.fromiter(map(len, found), np.int64, len(found))
        of_word = np.add.reduceat(size[at], np.cumsum(count) - count)
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(of_word) - of_word])
        self.size = np.concatenate([self.size, of_word])
        self.pool = np.concatenate([self.pool, ids[_runs(start[at], size[at])]])
        self.words = pa.concat_arrays([self.words, words])

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct parts among those met."""
        at = pc.index_in(words, value_set=self.words)
        new = at.is_null().to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        if new.any():
            if len(self.words) + new.sum() > CACHE_WORDS or self.words.nbytes + words.nbytes > CACHE_BYTES:
                # forgets all but these
                kept = at[~new]
                size = self.size[kept]
                self.pool = self.pool[_runs(self.start[kept], size)]
                self.words, self.start, self.size = self.words.take(pa.array(kept)), np.cumsum(size) - size, size
                at[~new] = np.arange(len(kept))
            at[new] = len(self.words) + np.arange(new.sum())
            self._meet(words.filter(pa.array(new)))
        return at

    def _plain(self, texts: pa.Array) -> Iterator[bytes]:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        if offsets[0] == offsets[-1]:
            yield from [b""] * len(texts)
            return
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
        cuts = part_starts(raw, offsets - offsets[0])
        parts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer((cuts + offsets[0]).astype(np.int32)), data)
        coded = parts.dictionary_encode()
        at = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        n = self.size[at]
        ids = self.pool[_runs(self.start[at], n)]
        ends = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(cuts, offsets - offsets[0])].tolist()
        for a, b in zip(ends, ends[1:], strict=False):
            yield ids[a:b].tobytes()

    def batch(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each whole text as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        part = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            some = texts.slice(a, b - a)
            special = np.zeros(len(some), bool)
            for s in self.v.special:
                special |= pc.match_substring(some, s).to_numpy(zero_copy_only=False)
            if not special.any():
                yield from self._plain(some)
                continue
            # the texts between special tokens go first, all at once
            split = {i: [p for p in self.split(some[i].as_py()) if p] for i in np.flatnonzero(special).tolist()}
            between = [p for parts in split.values() for p in parts if p not in self.v.special]
            found = self._plain(pa.concat_arrays([pa.array(between, pa.string()),
                                                  pc.if_else(pa.array(special), "", some)]))
            inner = iter(list(islice(found, len(between))))
            for i, ids in enumerate(found):
                yield ids if i not in split else b"".join(
                    np.array([self.v.special[p]], "<u4").tobytes() if p in self.v.special else next(inner)
                    for p in split[i])

    def __call__(self, text: str | None) -> bytes:
        return next(self.batch(pa.array([text], pa.string())))


@lru_cache(maxsize=2)
def encoder_of(path: str = BYTE_BPE) -> Encoder:
    """One per Python worker, so later tasks of it find filled caches."""
    return Encoder(path)


def decode(ids: np.ndarray, v: Vocabulary) -> bytes:
    """Bytes of the ids, gathered through the offset table."""
    n = v.lengths[ids]
    if not len(ids):
        return b""
    ends = np.cumsum(n)
    return v.buffer[np.repeat(v.offsets[ids] - ends + n, n) + np.arange(ends[-1])].tobytes()


def encode_documents(docs: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """doc_id, ids array<int>."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            ids = [np.frombuffer(x, "<i4") for x in encoder.batch(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))],
                                             ["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(ids: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(path)
        for batch in batches:
            texts = [decode(np.array(x.as_py() or [], np.int64), v).decode("utf-8", "replace")
                     for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())],
                                             ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """op7: doc_id, n_tokens, ids_sha256, decoded_sha256 per document. Encoded
    and decoded in one task, so no ids are written or moved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in encoder.batch(batch.column("text")):
                back = decode(np.frombuffer(ids, "<u4"), encoder.v)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
