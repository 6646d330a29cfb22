"""Tokenisers, token files, packing and byte-pair encoding."""
import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import SF, TEXTS, rows

from edcohort.llm import bpe, packing, queries, token_coder, token_files, tokens


def library(name):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def fuzz(n=3000):
    rnd = random.Random(5)
    parts = [*"abe sS'’tlv \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 ​0123½²ñßΣς<|>#-_̸あ漢🎉\x00İıK",
             "<|endoftext|>", "<|startoftext|>", "'re", "  ", "the"]
    out = ["".join(rnd.choices(parts, k=rnd.randrange(40))) for _ in range(n)]
    return out + ["".join(rnd.choices("abcdethinr", k=60)) for _ in range(300)] + ["a" * 50, "hello " * 50 + "aaa"]


def test_word_tokenizer_equals_the_library():
    mine, lib = tokens.WordTokenizer(cache_words=500), library(tokens.WORD_BPE)
    for t in [*TEXTS[:20], *fuzz()]:
        assert mine(t).tolist() == lib.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_batches_equal_the_library(monkeypatch):
    lib = library(tokens.WORD_BPE)
    texts = [*TEXTS[:20], *fuzz(), *["Él. straße,... no-one $$$ été$$$ ÿ×÷ don't. x''"] * 3]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    for words, size in ((400_000, 1 << 24), (50, 500)):  # also with words forgotten and met again
        monkeypatch.setattr(tokens, "BATCH_BYTES", size)
        got = tokens.WordTokenizer(cache_words=words).batch(pa.array(texts, pa.string()))
        for t, ids, w in zip(texts, got, want, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == w, repr(t)


def test_a_batch_encodes_a_word_once(monkeypatch):
    tok, asked = tokens.WordTokenizer(), []
    one = tok._ids
    monkeypatch.setattr(tok, "_ids", lambda w: asked.append(w) or one(w))
    texts = ["plain words repeat. plain words repeat, 12a plain", "12a words plain$$$"]
    assert len(list(tok.batch(pa.array(texts)))) == 2
    assert asked == [b"12a"]  # words of letters go to the merge model together
    assert sorted(tok.words.to_pylist()) == sorted({w for t in texts for w in t.split()})


def test_backtracking_encoder_equals_the_library():
    mine, lib = bpe.Encoder(), library(bpe.BYTE_BPE)
    for t in [*TEXTS, *fuzz()]:
        want = lib.encode(t or "", add_special_tokens=False).ids
        ids = np.frombuffer(mine(t), "<u4")
        assert ids.tolist() == want, repr(t)
        assert bpe.decode(ids, mine.v).decode() == lib.decode(want, skip_special_tokens=False)


def test_backtracking_batches_equal_the_library(monkeypatch):
    lib, rnd = library(bpe.BYTE_BPE), random.Random(9)
    spaces = " \n\n  \t\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b\u180e"
    texts = ["".join(rnd.choices(spaces + "aé漢1½.'s(", k=rnd.randrange(12))) for _ in range(1500)]
    texts += [None, "", *fuzz(700), "x" * 300 + " " + "ñ" * 90 + "\n" + "ab" * 200, " " * 200, "it's 'so'; we're(ok)'s",
              "".join(rnd.choices("thenationrsd", k=3000))]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    # also with parts forgotten and met again, pairs sharing a place, few bytes at a time
    for words, size, bits, step in ((500_000, 1 << 23, 21, 1 << 18), (60, 700, 3, 50)):
        monkeypatch.setattr(bpe, "CACHE_WORDS", words)
        monkeypatch.setattr(bpe, "BATCH_BYTES", size)
        monkeypatch.setattr(bpe, "PAIR_BITS", bits)
        monkeypatch.setattr(bpe, "STEP_BYTES", step)
        encoder = bpe.Encoder()
        got = encoder.batch(pa.array(["cut off", *texts], pa.string()).slice(1))
        for t, ids, w in zip(texts, got, want, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == w, repr(t)
        assert len(encoder.words) <= max(words, 700)


def test_a_batch_takes_each_pre_token_once_and_together(monkeypatch):
    encoder, steps, alone = bpe.Encoder(), [], []
    many, one = encoder._steps, encoder.piece
    monkeypatch.setattr(encoder, "_steps", lambda raw, *at: steps.append(raw.tobytes()) or many(raw, *at))
    monkeypatch.setattr(encoder, "piece", lambda text: alone.append(text) or one(text))
    texts = pa.array(["a word, a word. A word\na word!", "a word? " + "w" * 100])
    assert len(list(encoder.batch(texts))) == 2
    # signs and breaks do not make a new pre-token of a word, and all go one way at once
    assert steps == [b"a word, a. A\n!?"] and alone == [" " + "w" * 100]
    list(encoder.batch(texts))
    assert len(steps) == len(alone) == 1
    # special tokens do not send texts through one by one
    steps.clear()
    list(encoder.batch(pa.array(["new<|endoftext|> words", "here", " more<|endoftext|>"])))
    assert steps == [b"new words morehere"]


def test_bpe_query_and_edges(spark, edge, empty):
    lib = library(bpe.BYTE_BPE)
    assert bpe.round_trip(empty).collect() == []
    got = collections.Counter(tuple(r) for r in bpe.round_trip(edge).collect())
    want = collections.Counter()
    for r in rows():
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert got == want
    back = bpe.decode_documents(bpe.encode_documents(edge)).collect()
    assert collections.Counter(map(tuple, back)) == collections.Counter((r[0], r[1] or "") for r in rows())


@pytest.mark.parametrize("block", [
    [5], list(range(4000)), [0] * 4096, [49407] * 300, [1, 2, 3] * 600, [2**17] * 3 + [0]])
def test_coder_round_trip(block):
    rng = np.random.default_rng(len(block))
    blocks = [np.array(block, np.uint32), rng.integers(0, 60_000, 257).astype(np.uint32),
              rng.zipf(1.4, 4096).clip(0, 65535).astype(np.uint32)]
    prior = token_coder.Prior.of(blocks)
    coded = token_coder.encode(blocks, prior)
    back = token_coder.decode(coded, [len(b) for b in blocks], prior)
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))


def test_coder_blocks_are_independent():
    rng = np.random.default_rng(2)
    blocks = [rng.zipf(1.3, n).clip(0, 9999).astype(np.uint32) for n in (4096, 100, 4096, 2000)]
    prior = token_coder.Prior.of(blocks)
    coded = token_coder.encode(blocks, prior)
    alone = token_coder.decode([coded[2]], [4096], prior)[0]
    assert (alone == blocks[2]).all()
    assert sum(map(len, coded)) < sum(2 * len(b) for b in blocks)


def expected_tokens(texts_by_order, end_id):
    lib, at, out = library(tokens.WORD_BPE), 0, []
    for doc_id, text in texts_by_order:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_on_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op2_token_files"](spark, SF).collect())
    assert got == expected_tokens(docs, token_files.END_ID)


def test_token_file_edges(spark, edge, empty, tmp_path):
    assert token_files.token_report(spark, empty).collect() == []
    got = token_files.token_report(spark, edge).collect()
    want = {(d, n, c) for d, _, n, c in expected_tokens([(r[0], r[1]) for r in rows()], token_files.END_ID)}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(rows())
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0, *(r.n_tokens for r in by_start)])[:-1].tolist()
    ids = [r.doc_id for r in by_start]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(edge, path)
    lib = library(tokens.WORD_BPE)
    back = token_files.read_tokens(spark.read.parquet(path)).collect()
    texts = collections.Counter((r[0], tuple([*lib.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in back) == texts


def test_damaged_block_is_noticed(spark, tmp_path):
    files = token_files.encoded(spark.createDataFrame([(1, "some words to encode")], "doc_id long, text string"))
    broken = files.selectExpr("* except (block_crc32)", "transform(block_crc32, c -> c + 1) AS block_crc32")
    with pytest.raises(Exception, match="checksum mismatch"):
        token_files.token_digests(broken).collect()


def check_pieces(found, texts, max_len=4096):
    lib = library(tokens.WORD_BPE)
    docs = collections.Counter()
    for doc_id, text in texts:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        for a in range(0, len(ids), max_len):
            part = ids[a:a + max_len]
            docs[doc_id, a, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == docs
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= max_len
    return len(sequences)


def test_packing_on_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = queries.QUERIES["op6_packing"](spark, SF).collect()
    n = check_pieces(found, docs)
    assert n <= 1.02 * sum(r.length for r in found) / 4096 + 1


def test_packing_edges(spark, edge, empty):
    assert packing.pack(spark, empty).collect() == []
    texts = [(r[0], r[1]) for r in rows()]
    check_pieces(packing.pack(spark, edge).collect(), texts)
    check_pieces(packing.pack(spark, edge, send_ranges=0).collect(), texts)


def test_histogram_packing_is_whole_and_tight():
    rnd = random.Random(3)
    counts = collections.Counter(min(4096, 1 + int(rnd.expovariate(1 / 400))) for _ in range(20_000))
    counts[4096] += 700
    ranges = packing.pack_histogram(dict(counts))
    fill = collections.Counter()
    for length, lo, hi, base, offset in ranges[np.argsort(-ranges[:, 0], kind="stable")].tolist():
        for s in range(base, base + hi - lo):
            assert fill[s] == offset
            fill[s] += length
    assert max(fill.values()) <= 4096
    for length, n in counts.items():
        own = ranges[ranges[:, 0] == length]
        assert own[0, 1] == 0 and own[-1, 2] == n and (own[1:, 1] == own[:-1, 2]).all()
    total = sum(k * v for k, v in counts.items())
    assert len(fill) * 4096 < 1.01 * total + 4096
