"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads each word (run without ASCII white space, a closing full stop
or comma apart; longer ones in parts of ``WORD_BYTES``) from both ends, byte by byte, and gives every byte
position a distribution over the languages. A document's probabilities are the
mean over all positions of its whole text; the prediction is the largest.

Training: a bounded sample of labelled rows, at most ``SAMPLE`` documents per
language by hash of the id and one window of ``WINDOW`` code points of each,
goes to the driver, where numpy trains by backpropagation through time (fixed
seed). Rows whose crc32(doc_id) mod 4 is 2 are never used. The weights are a
few thousand numbers, sent with the task.

Prediction: a map over rows. State never crosses a word, so a task computes
each word once and keeps the sums of its positions in a bounded cache.

Defined cases: null text or text without a letter gives ``und`` and score 0;
without any labelled row all predictions are ``und``; ties go to the language
first in alphabetical order; an empty table gives an empty result; repeated
rows get equal predictions; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cache import Recent
from .common import id_text

SAMPLE = 300
WINDOW = 800
WORD_BYTES = 24
HIDDEN = 16
STEPS = 700
BATCH = 256
RATE = 0.01
CACHE_WORDS = 200_000
#: Texts whose new words are computed together, and words per call.
TEXTS = 256
WORDS = 4096
UNKNOWN = "und"
#: A full stop or comma after a word is a word of its own: fewer distinct words.
WORD_END = re.compile(rb"([.,])(?<=[A-Za-z0-9\x80-\xff].)(?=\s|$)")


def held_out(doc_id: Column) -> Column:
    """A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = SAMPLE, window: int = WINDOW) -> DataFrame:
    """lang, part: one window of at most ``per_language`` documents a language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return rows.select("lang", F.col("text").alias("part")).limit(0)
    # a hash cut keeps about half more than needed, so the exact cut below
    # orders a bounded number of rows
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items())
                           for x in (k, min(1.0, (1.5 * per_language + 50) / n))])
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    kept = rows.filter(spot < F.try_element_at(share, F.col("lang")) * (1 << 30)).withColumn("spot", spot)
    start = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.greatest(F.char_length("text") - window + 1, F.lit(1))) + 1
    parts = kept.select("lang", "spot", "doc_id", F.substring(F.col("text"), start.cast("int"), F.lit(window))
                        .alias("part"))
    order = Window.partitionBy("lang").orderBy("spot", "doc_id", "part")
    return (parts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)
            .orderBy("lang", "n").select("lang", "part"))


def words_of(text: str) -> list[bytes]:
    out = WORD_END.sub(rb" \1", text.encode("utf-8", "surrogatepass")).split()
    if any(len(w) > WORD_BYTES for w in out):
        out = [w[i:i + WORD_BYTES] for w in out for i in range(0, len(w), WORD_BYTES)]
    return out


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes [words, places] and lengths."""
    n = np.array([len(w) for w in words])
    x = np.zeros((len(words), int(n.max())), np.int64)
    x[np.arange(x.shape[1]) < n[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return x, n


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * a))


class Network:
    """Weights per direction d: ``in{d}`` [256, 3H] (byte to update gate,
    reset gate, candidate), ``gate{d}`` [H, 2H], ``cand{d}`` [H, H],
    ``bias{d}`` [3H]; ``out`` [2H, L], ``out_bias`` [L]."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        h, self.languages, self.hidden = hidden, languages, hidden

        def small(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(h)).astype(np.float32)

        self.w = {"out": small(2 * h, len(languages)), "out_bias": np.zeros(len(languages), np.float32)}
        for d in "fb":
            self.w |= {f"in{d}": small(256, 3 * h), f"gate{d}": small(h, 2 * h), f"cand{d}": small(h, h),
                       f"bias{d}": np.zeros(3 * h, np.float32)}

    def fingerprint(self) -> str:
        parts = [str(self.languages).encode(), *(self.w[k].tobytes() for k in sorted(self.w))]
        return xxhash.xxh3_128_hexdigest(b"".join(parts))

    def _states(self, d: str, x: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden state after each place, read from the left (f) or right (b)."""
        w, h = self.w, self.hidden
        n, t = x.shape
        byte_in = w[f"in{d}"] + w[f"bias{d}"]
        out, trace = np.zeros((t, n, h), np.float32), []
        s = np.zeros((n, h), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a = byte_in[x[:, i]]
            g = _sigmoid(a[:, :2 * h] + s @ w[f"gate{d}"])
            z, r = g[:, :h], g[:, h:]
            c = np.tanh(a[:, 2 * h:] + (r * s) @ w[f"cand{d}"])
            m = z * live[:, i, None]
            new = s + m * (c - s)
            if keep:
                trace.append((i, s, z, r, c, m))
            out[i] = s = new
        return out, trace

    def probabilities(self, x: np.ndarray, n: np.ndarray, keep: bool = False):
        live = (np.arange(x.shape[1]) < n[:, None]).astype(np.float32)
        f, trace_f = self._states("f", x, live, keep)
        b, trace_b = self._states("b", x, live, keep)
        both = np.concatenate([f, b], 2)
        logits = both @ self.w["out"] + self.w["out_bias"]
        logits -= logits.max(2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(2, keepdims=True)
        return p, live, both, {"f": trace_f, "b": trace_b}

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[dict, float]:
        """Of the mean cross entropy over all positions."""
        p, live, both, traces = self.probabilities(x, n, keep=True)
        weight = live.T[:, :, None] / live.sum()
        rows = np.arange(len(y))
        loss = float(-(np.log(p[:, rows, y] + 1e-9) * weight[:, :, 0]).sum())
        d = p.copy()
        d[:, rows, y] -= 1
        d *= weight
        h, w = self.hidden, self.w
        grads = {"out": np.einsum("tnh,tnl->hl", both, d), "out_bias": d.sum((0, 1))}
        into = d @ w["out"].T
        for k, part in (("f", into[:, :, :h]), ("b", into[:, :, h:])):
            g_in, g_gate, g_cand = (np.zeros_like(w[f"{name}{k}"]) for name in ("in", "gate", "cand"))
            g_bias = np.zeros(3 * h, np.float32)
            ds = np.zeros_like(part[0])
            for i, s, z, r, c, m in reversed(traces[k]):
                ds = ds + part[i]
                dc = ds * m * (1 - c * c)
                dz = ds * (c - s) * live[:, i, None] * z * (1 - z)
                back = dc @ w[f"cand{k}"].T
                dr = back * s * r * (1 - r)
                dg = np.concatenate([dz, dr], 1)
                g_gate += s.T @ dg
                g_cand += (r * s).T @ dc
                da = np.concatenate([dg, dc], 1)
                np.add.at(g_in, x[:, i], da)
                g_bias += da.sum(0)
                ds = ds * (1 - m) + back * r + dg @ w[f"gate{k}"].T
            grads |= {f"in{k}": g_in, f"gate{k}": g_gate, f"cand{k}": g_cand, f"bias{k}": g_bias}
        return grads, loss


def train(parts: list[tuple[str, str]], steps: int = STEPS, batch: int = BATCH, seed: int = 5) -> Network | None:
    """From (language, text) pairs; None without any word."""
    samples = {}
    for lang, text in parts:
        samples.setdefault(lang, []).extend(words_of(text))
    languages = sorted(k for k, v in samples.items() if v)
    if not languages:
        return None
    net, rng = Network(languages, seed=seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), batch)  # languages alike, whatever their share
        words = [samples[languages[k]][rng.integers(len(samples[languages[k]]))] for k in y]
        grads, _ = net.gradients(*padded(words), y)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.w[k] -= (rate * (first[k] / (1 - 0.9**step))
                         / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


class Reader:
    """Document probabilities inside a task."""

    def __init__(self, net: Network):
        self.net, self.width = net, len(net.languages)
        self.cache = Recent(lambda w: self._sums([w])[0], CACHE_WORDS)

    def _sums(self, words: list[bytes]) -> list[bytes]:
        """Per word the sum of its positions' distributions (float32)."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out = [b""] * len(words)
        for a in range(0, len(order), WORDS):
            some = order[a:a + WORDS]
            p, live, _, _ = self.net.probabilities(*padded([words[i] for i in some]))
            sums = np.einsum("tnl,nt->nl", p, live).astype(np.float32)
            for i, row in zip(some, sums, strict=True):
                out[i] = row.tobytes()
        return out

    def learn(self, texts: list[list[bytes]]) -> None:
        new = [w for w in set().union(*texts) if w not in self.cache and w not in self.cache.old]
        for a in range(0, len(new), CACHE_WORDS // 2):
            some = new[a:a + CACHE_WORDS // 2]
            for w, sums in zip(some, self._sums(some), strict=True):
                self.cache.add(w, sums)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        total = np.frombuffer(b"".join(map(self.cache.__getitem__, words)), np.float32)
        mean = total.reshape(-1, self.width).astype(np.float64).sum(0)
        return mean / mean.sum()


_READERS: dict[str, Reader] = {}


def _reader(net: Network, key: str) -> Reader:
    """One per Python worker and network, so later tasks find a filled cache."""
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(net)
    return _READERS[key]


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score per document."""
    key = net.fingerprint() if net else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(net, key) if net else None
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                texts = part.column("text").to_pylist()
                known = [bool(t) and any(map(str.isalpha, t)) and reader is not None for t in texts]
                words = [words_of(t) if k else [] for t, k in zip(texts, known, strict=True)]
                langs, scores = [], []
                if any(known):
                    reader.learn(words)
                for w, k in zip(words, known, strict=True):
                    p = reader(w) if k else None
                    langs.append(net.languages[int(p.argmax())] if k else UNKNOWN)
                    scores.append(round(float(p.max()), 6) if k else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()),
                     pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = id_text(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """op8: doc_id, held_out, lang_pred, score."""
    net = train([(r["lang"], r["part"]) for r in training_sample(docs).collect()])
    return predict(docs, net)
