"""MinHash near-duplicates against brute force."""
import itertools
import random

from llm_helpers import SF, rows

from edcohort.llm import minhash, queries


def brute(texts, width=4):
    """doc_id -> (n_shingles, component_id) for (doc_id, text) pairs."""
    sets = []
    for doc_id, text in texts:
        w = (text or "").encode().lower().split()
        n = min(len(w), width)
        sets.append((doc_id, frozenset(tuple(w[i:i + width]) for i in range(len(w) - n + 1)) if w else frozenset()))
    root = {d: d for d, _ in sets if d is not None}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = [(d, s) for d, s in sets if d is not None and s]
    for (a, x), (b, y) in itertools.combinations(ids, 2):
        if 100 * len(x & y) >= 80 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {(d, len(s), find(d)) for d, s in sets if d is not None}


def found(frame):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in frame.collect() if r.doc_id is not None}


def test_components_on_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.QUERIES["op1_minhash"](spark, SF)
    assert found(out) == brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_edges(spark, edge, empty):
    assert minhash.near_duplicates(spark, empty).collect() == []
    assert found(minhash.near_duplicates(spark, edge, width=4)) == brute([(r[0], r[1]) for r in rows()], 4)
    out = minhash.near_duplicates(spark, edge)
    assert out.count() == len(rows())
    assert found(out) == brute([(r[0], r[1]) for r in rows()], 5)
    without_id = [r for r in out.collect() if r.doc_id is None]
    assert [(r.component_id, r.kept) for r in without_id] == [(0, False)]


def family(size, seed, edits, words=120):
    """Near copies of one text, some of them too far from each other."""
    rnd = random.Random(seed)
    base = [f"w{seed}x{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(size):
        copy = list(base)
        for _ in range(rnd.randrange(edits)):
            copy[rnd.randrange(words)] = f"e{seed}n{i}r{rnd.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_families_and_shared_passages(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = family(60, 1, 9) + family(25, 2, 4) + [passage + " " + f"own{i} " * 3 for i in range(40)]
    texts += [" ".join(f"s{i}t{j}" for j in range(30)) + " " + passage for i in range(30)]
    random.Random(4).shuffle(texts)
    data = list(enumerate(texts))
    # short lists and small blocks, so that the block path is taken as well
    monkeypatch.setattr(minhash, "SHORT_LIST", 4)
    monkeypatch.setattr(minhash, "LIST_BLOCK", 16)
    frame = spark.createDataFrame(data, "doc_id long, text string")
    assert found(minhash.near_duplicates(spark, frame)) == brute(data, 5)
