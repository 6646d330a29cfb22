"""Adaptive context-mixing range coder for token ids, many blocks side by side.

A block holds up to ``BLOCK`` ids and is coded on its own: every adaptive
statistic starts anew. What all blocks of a file row share is a fixed table of
id frequencies (``Prior``), stored in the row. Three predictors look at each id:

* order 2: the id that last followed the two ids before it (hashed context);
* order 1: the id that last followed the id before it (hashed context);
* order 0: the ids of the block up to the last power of two, with their counts.

An id is coded by the highest order that predicts it, else as a new id by its
frequency in the prior. The probabilities of these four kinds are mixed from three
estimates: given the order-2 context's record of hits, given the order-1
context's record, and given both together with their agreement. The mixing
weights follow each estimate's success. Counts and weights are brought up to
date whenever the length reaches a power of two, in whole numbers only, so
encoder and decoder agree on any machine.

All blocks of a call advance together, one id per step: numpy works across
blocks, so a step costs the same few array operations for one block or for
hundreds. The range coder is carry-less with 64-bit state and 32-bit words.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
PLACE_BITS = 12  # of a place in a block
FIRST_CHUNK = 256
SLOTS = 4096  # entries of a context table
KIND_BITS = 12
TOTAL = 1 << KIND_BITS
U32, U64 = np.uint32, np.uint64
HASH1, HASH2 = U32(2654435761), U32(2246822519)  # modulo 2**32
WORD = U64(32)
MASK = U64(0xFFFFFFFF)
LIMIT = U64(1 << 32)
LOW16 = U64(0xFFFF)
#: At most 2**18 distinct ids in one file row.
PRIOR_BITS = 18
#: Kinds: predicted by order 2, by order 1, by order 0, new.
KINDS = 4
STATES = 32
MODEL_LANES = 32


def chunk_ends(n: int) -> list[int]:
    ends, e = [], FIRST_CHUNK
    while e < n:
        ends.append(e)
        e *= 2
    return [*ends, n]


def _slot1(p1: np.ndarray) -> np.ndarray:
    return p1 * HASH1 >> U32(16) & U32(SLOTS - 1)


def _slot2(p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    return p1 * HASH1 + p2 * HASH2 >> U32(16) & U32(SLOTS - 1)


class Prior:
    """Frequencies of ids in whole numbers that sum to 2**PRIOR_BITS."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray):
        self.ids, self.freqs = ids.astype(np.int64), freqs.astype(np.int64)
        self.starts = np.cumsum(self.freqs) - self.freqs

    @classmethod
    def of(cls, blocks: list[np.ndarray]) -> Prior:
        every = np.concatenate(blocks)
        if every.max() < 1 << 20:
            n = np.bincount(every)
            ids = np.flatnonzero(n)
            n = n[ids]
        else:
            ids, n = np.unique(every, return_counts=True)
        total = 1 << PRIOR_BITS
        if len(ids) > total:
            raise ValueError(f"more than {total} distinct ids in one file row")
        freqs = 1 + n * (total - len(ids)) // n.sum()
        freqs[n.argmax()] += total - freqs.sum()
        return cls(ids, freqs)

    def lookup(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.ids, ids) if self.ids[-1] >= 1 << 20 else self._dense()[ids]
        return self.starts[at], self.freqs[at]

    def _dense(self) -> np.ndarray:
        if not hasattr(self, "dense"):
            self.dense = np.zeros(self.ids[-1] + 1, np.int64)
            self.dense[self.ids] = np.arange(len(self.ids))
        return self.dense


class Mixer:
    """Kind probabilities of ``lanes`` blocks by state: 16 * agree + 4 * q2 + q1."""

    def __init__(self, lanes: int):
        q = np.arange(4)
        own = np.tile(np.array([1, 1, 4, 4], np.int64), (4, 1))
        two, one = own.copy(), own.copy()
        two[:, 0] += 2 * q * q
        one[:, 1] += 2 * q * q
        self.two = np.repeat(two[None], lanes, 0)
        self.one = np.repeat(one[None], lanes, 0)
        self.both = np.ones((lanes, STATES, KINDS), np.int64)
        self.weights = np.tile(np.array([85, 85, 86], np.int64), (lanes, 1))
        s = np.arange(STATES)
        self.q2, self.q1 = (s >> 2) & 3, s & 3
        self._mix()

    @staticmethod
    def _share(counts: np.ndarray) -> np.ndarray:
        return 1 + counts * (TOTAL - KINDS) // counts.sum(-1, keepdims=True)

    def _mix(self) -> None:
        self.parts = (self._share(self.two)[:, self.q2], self._share(self.one)[:, self.q1], self._share(self.both))
        w = self.weights[:, :, None, None]
        mixed = sum(w[:, m] * p for m, p in enumerate(self.parts))
        freq = self._share(mixed)
        freq[..., 2] += TOTAL - freq.sum(-1)
        self.freq = freq
        self.start = np.cumsum(freq, -1) - freq

    def packed(self) -> np.ndarray:
        """Start and (from bit 16 on) size of every block's states' kinds."""
        return (self.start | self.freq << 16).astype(np.uint32).ravel()

    def learn(self, seen: np.ndarray) -> None:
        """``seen``: occurrences of (state, kind) since the last call."""
        merit = np.stack([(seen * p).sum((1, 2)) for p in self.parts], 1) + 1
        self.weights = 1 + merit * 253 // merit.sum(1, keepdims=True)
        self.weights[:, 2] += 256 - self.weights.sum(1)
        for q in range(4):
            self.two[:, q] += seen[:, self.q2 == q].sum(1)
            self.one[:, q] += seen[:, self.q1 == q].sum(1)
        self.both += seen
        self._mix()

    def keep(self, lanes: int) -> None:
        for name in ("two", "one", "both", "weights", "freq", "start"):
            setattr(self, name, getattr(self, name)[:lanes])
        self.parts = tuple(p[:lanes] for p in self.parts)


def _tally(seen: np.ndarray) -> np.ndarray:
    """Occurrences of each state * KINDS + kind, per block."""
    lanes = len(seen)
    key = np.arange(lanes)[:, None] * (STATES * KINDS) + seen
    return np.bincount(key.ravel(), minlength=lanes * STATES * KINDS).reshape(lanes, STATES, KINDS)


def _order(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat: the keys of every row in order, equal ones by place, and their
    places. Keys are sorted together with their place, as whole numbers."""
    wide = np.uint64 if keys.max() >= 1 << (32 - PLACE_BITS) else np.uint32
    packed = keys.astype(wide) << wide(PLACE_BITS)
    packed |= np.arange(keys.shape[1], dtype=wide)
    packed.sort(axis=1)
    places = (packed & wide(BLOCK - 1)).astype(np.int64)
    places += row
    packed >>= wide(PLACE_BITS)
    return packed.ravel(), places.ravel()


def _context(ids: np.ndarray, slots: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place of (flat) blocks: the id at the last place with the same
    slot (-1: none) and that slot's record: 0 none, 1 missed last, 2 hit once,
    3 hit twice."""
    s, order = _order(slots, row)
    x = ids.ravel().take(order)
    same, hit = np.zeros(len(s), bool), np.zeros(len(s), bool)
    np.equal(s[1:], s[:-1], out=same[1:])
    same[::ids.shape[1]] = False  # the first of each block
    np.equal(x[1:], x[:-1], out=hit[1:])
    hit &= same
    guess = np.full_like(x, -1)
    np.copyto(guess[1:], x[:-1], where=same[1:])
    record = same.astype(np.int8)
    after = same[1:] & hit[:-1]
    record[1:] += after
    record[2:] += after[1:] & hit[:-2]
    out_guess, out_record = np.empty_like(guess), np.empty_like(record)
    out_guess[order], out_record[order] = guess, record
    return out_guess.reshape(ids.shape), out_record.reshape(ids.shape)


def _shift(prefix: int) -> np.ndarray:
    """Bits of the second choice by kind."""
    return np.array([0, 0, max(prefix, 1).bit_length() - 1, PRIOR_BITS], np.uint8)


def _model(ids: np.ndarray, prior: Prior) -> tuple[np.ndarray, ...]:
    """Per place of equally long blocks (int32): start and size of the kind,
    bits, start and size of the second choice."""
    lanes, n = ids.shape
    row = np.arange(lanes)[:, None] * n
    before = np.zeros((lanes, n + 2), np.uint32)
    before[:, 2:] = ids + 1
    p1, p2 = before[:, 1:n + 1], before[:, :n]
    guess1, q1 = _context(ids, _slot1(p1), row)
    guess2, q2 = _context(ids, _slot2(p1, p2), row)
    states = (guess1 == guess2).astype(np.int16) * 16 + 4 * q2 + q1
    kinds = np.where(guess2 == ids, np.int8(0), np.where(guess1 == ids, np.int8(1), np.int8(2)))
    ordered, order = _order(ids, row)
    ordered = ordered.reshape(lanes, n)
    rank = np.zeros((lanes, n), np.int32)
    np.cumsum(ordered[:, 1:] != ordered[:, :-1], 1, out=rank[:, 1:])
    local = np.empty(lanes * n, np.int64)
    local[order] = (rank + row).ravel()  # the id's number in its block, plus the block's place
    local = local.reshape(lanes, n)
    counts = np.zeros(lanes * n, np.int32)
    mixer = Mixer(lanes)
    cell_row = np.arange(lanes)[:, None] * (STATES * KINDS)
    kind_start, kind_size = np.empty((lanes, n), np.uint16), np.empty((lanes, n), np.uint16)
    bits = np.empty((lanes, n), np.uint8)
    start, size = np.empty((lanes, n), np.uint32), np.empty((lanes, n), np.uint32)
    a = 0
    for b in chunk_ends(n):
        part = slice(a, b)
        z, kind, s = local[:, part], kinds[:, part], states[:, part]
        cnt = counts.take(z)
        kind += (kind == 2) & (cnt == 0)
        seen = s * KINDS + kind
        share = mixer.packed().take(cell_row + seen)
        kind_start[:, part], kind_size[:, part] = share & U32(0xFFFF), share >> U32(16)
        bits[:, part] = _shift(a).take(kind)
        grid = counts.reshape(lanes, n)
        below = np.cumsum(grid, 1, dtype=np.int32) - grid
        known = kind == 2
        first, many = below.take(z), cnt
        first *= known
        many[~known] = 1
        new = np.flatnonzero(kind == 3)
        first.ravel()[new], many.ravel()[new] = prior.lookup(ids[:, part].ravel().take(new))
        start[:, part], size[:, part] = first, many
        if b < n:
            mixer.learn(_tally(seen))
            counts += np.bincount(z.ravel(), minlength=lanes * n).astype(np.int32)
        a = b
    return kind_start, kind_size, bits, start, size


def encode(blocks: list[np.ndarray], prior: Prior) -> list[bytes]:
    """Code of each block (1 to BLOCK ids, all in the prior)."""
    if not blocks:
        return []
    by_len = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lens = np.array([len(blocks[i]) for i in by_len])
    n, lanes = int(lens[0]), len(blocks)
    types = (np.uint16, np.uint16, np.uint8, np.uint32, np.uint32)
    tables = [np.zeros((n, lanes), t) for t in types]  # by step: rows lie together
    a = 0
    while a < lanes:
        b = a + 1
        while b < lanes and b - a < MODEL_LANES and lens[b] == lens[a]:
            b += 1
        group = np.stack([blocks[i] for i in by_len[a:b]]).astype(np.int32)
        for t, m in zip(tables, _model(group, prior), strict=True):
            t[:lens[a], a:b] = m.T
        a = b
    low, rng = np.zeros(lanes, U64), np.full(lanes, 2**64 - 1, U64)
    width = n * (KIND_BITS + PRIOR_BITS + 2) // 32 + n // 8 + 8
    out = np.zeros(lanes * width, "<u4")
    first = np.arange(lanes) * width
    at = first.copy()
    alive = np.searchsorted(-lens, -np.arange(n), side="left").tolist()  # blocks longer than each step
    k = lanes
    for i in range(n):
        k = alive[i]
        kind_start, kind_size, bits, start, size = (t[i, :k] for t in tables)
        lo, r = low[:k], rng[:k]
        r >>= U64(KIND_BITS)
        lo += r * kind_start
        r *= kind_size
        r >>= bits
        lo += r * start
        r *= size
        full = np.flatnonzero(r < LIMIT)
        if len(full):
            lf, rf = lo[full], r[full]
            top = lf >> WORD
            spot = at[full]
            out[spot] = top
            at[full] = spot + 1
            rf = np.where(top != ((lf + rf - U64(1)) >> WORD), (~lf + U64(1)) & MASK, rf)
            lo[full], r[full] = lf << WORD, rf << WORD
    out[at], out[at + 1] = low >> WORD, low & MASK
    coded: list[bytes] = [b""] * lanes
    for j, i in enumerate(by_len):
        coded[i] = out[first[j]:at[j] + 2].tobytes()
    return coded


def _prefix_slots(ids: np.ndarray) -> np.ndarray:
    """The ids of each row in order, flat; with each id the first place and
    the number of it: id << 40 | first << 20 | number."""
    lanes, m = ids.shape
    s = np.sort(ids, axis=1, kind="stable")
    new = np.ones((lanes, m), bool)
    new[:, 1:] = s[:, 1:] != s[:, :-1]
    starts = np.flatnonzero(new)
    n = np.diff(np.append(starts, lanes * m))
    packed = s.ravel()[starts].astype(np.int64) << 40 | (starts % m) << 20 | n
    return np.repeat(packed, n)


def decode(coded: list[bytes], lengths: list[int], prior: Prior) -> list[np.ndarray]:
    """Ids (uint32) of each block from its code and its number of ids."""
    if not coded:
        return []
    by_len = sorted(range(len(coded)), key=lambda i: -lengths[i])
    lens = np.array([lengths[i] for i in by_len])
    n, lanes = int(lens[0]), len(coded)
    words = np.zeros((lanes, max(map(len, coded)) // 4 + 2), U64)
    for j, i in enumerate(by_len):
        w = np.frombuffer(coded[i], "<u4")
        words[j, :len(w)] = w
    width, flat = words.shape[1], words.ravel()
    narrow = prior.ids[-1] < 1 << 16
    # by step, so that a step's results lie together
    ids = np.zeros((n, lanes), np.uint16 if narrow else np.uint32)
    seen = np.zeros((n, lanes), np.uint8)  # state * KINDS + kind
    table1, table2 = np.zeros(lanes * SLOTS, np.int32), np.zeros(lanes * SLOTS, np.int32)  # 4 * (id + 1) + record
    base = np.arange(lanes) * SLOTS
    low, rng = np.zeros(lanes, U64), np.full(lanes, 2**64 - 1, U64)
    rel = (words[:, 0] << WORD) | words[:, 1]  # code minus low
    at = np.arange(lanes) * width + 2
    p1, p2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    alive = np.searchsorted(-lens, -np.arange(n), side="left").tolist()
    mixer = Mixer(lanes)
    fresh = np.repeat(prior.ids << 40 | prior.starts << 20 | prior.freqs, prior.freqs)
    slots = fresh
    ends, chunk, prefix, k, lane = chunk_ends(n), 0, 0, lanes, np.arange(0)
    for i in range(n):
        if i == ends[chunk]:
            k = alive[i]
            mixer.keep(k)
            mixer.learn(_tally(seen[prefix:i, :k].T))
            chunk, prefix = chunk + 1, i
            slots = np.concatenate([fresh, _prefix_slots(np.ascontiguousarray(ids[:i, :k].T))])
        k = alive[i]
        if i == prefix or k != len(lane):
            lane = np.arange(k)
            start, freq = mixer.start[:k].astype(U64), mixer.freq[:k].astype(U64)
            bounds = (start[..., 1] | start[..., 2] << U64(16) | start[..., 3] << U64(32)).ravel()
            part = (start | freq << U64(16)).ravel()
            second = _shift(prefix).astype(U64)
            most = (U64(1) << second) - U64(1)
            row = len(fresh) + lane * prefix
            state0 = lane * STATES
        a1 = p1[:k]
        mixed = a1 * HASH1
        place1 = base[:k] + (mixed >> U32(16) & U32(SLOTS - 1))
        mixed += p2[:k] * HASH2
        place2 = base[:k] + (mixed >> U32(16) & U32(SLOTS - 1))
        e1, e2 = table1.take(place1), table2.take(place2)
        record1, record2 = e1 & 3, e2 & 3
        state = (((e1 ^ e2) < 4) << 4) + (record2 << 2) + record1
        cell = state0 + state
        cut = bounds.take(cell)
        lo, left, r = low[:k], rel[:k], rng[:k]
        r >>= U64(KIND_BITS)
        kind = (left >= r * (cut & LOW16)).view(np.int8) + (left >= r * (cut >> U64(16) & LOW16)).view(np.int8)
        kind += (left >= r * (cut >> U64(32))).view(np.int8)
        cell *= KINDS
        cell += kind
        share = part.take(cell)
        below = r * (share & LOW16)
        r *= share >> U64(16)
        r >>= second.take(kind)
        left -= below
        spot = np.minimum(left // r, most.take(kind)).view(np.int64)
        spot += row * (kind == 2)
        guessed = kind < 2
        spot *= ~guessed
        packed = slots.take(spot)
        # a predicted id is the only one of its kind: from 0, 1 wide
        np.copyto(packed, ((np.where(kind == 0, e2, e1) >> 2).astype(np.int64) - 1) << 40 | 1, where=guessed)
        x1 = ((packed >> 40) + 1).astype(np.int32)
        step = r * (packed >> 20 & 0xFFFFF).view(U64)
        r *= (packed & 0xFFFFF).view(U64)
        lo += below
        lo += step
        left -= step
        full = np.flatnonzero(r < LIMIT)
        if len(full):
            lf, rf, spot = lo[full], r[full], at[full]
            crosses = (lf >> WORD) != ((lf + rf - U64(1)) >> WORD)
            r[full] = np.where(crosses, (~lf + U64(1)) & MASK, rf) << WORD
            lo[full] = lf << WORD
            left[full] = (left[full] << WORD) | flat[spot]
            at[full] = spot + 1
        ids[i, :k], seen[i, :k] = x1 - 1, state * KINDS + kind
        # the record after this: 1, or one more than before a hit, 3 at most
        entry = (x1 << 2) + 1
        table1[place1] = entry + ((e1 ^ entry) < 4) * np.minimum(record1, 2)
        table2[place2] = entry + ((e2 ^ entry) < 4) * np.minimum(record2, 2)
        p2[:k] = a1
        p1[:k] = x1
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * lanes
    for j, i in enumerate(by_len):
        out[i] = ids[:lens[j], j].astype(np.uint32)
    return out
