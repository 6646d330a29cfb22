"""Ranked lexical search, sharding and spelling variants."""
import collections
import heapq
import itertools
import math
import random
import re
import zlib

import pytest
from llm_helpers import SF, rows, same

from edcohort.llm import lexical_search, queries, sharding, spelling

ITEMS = "item_id long, text string, score double, rank int, term string, block int, raw string"


# ---------------------------------------------------------------- search
def terms_of(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in found]


def brute_search(docs, items, k):
    """(item_id, doc_id, score) lists per (item_id, text), best first."""
    bags = [(i, collections.Counter(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = {}
    for item_id, text in {(i, t) for i, t in items if t is not None}:
        found = []
        for doc_id, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms_of(text) if bag[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out[item_id, text] = [(None if none else d, -s) for s, none, d in sorted(found)[:k]]
    return out


@pytest.fixture(scope="module")
def items(spark):
    data = [(1, "quick brown Fox fox"), (2, "la repeated LINE la"), (2, "café 漢字"), (2, "café 漢字"), (3, None),
            (4, ""), (5, "--- ... ###"), (6, "nowhereword"), (None, "seven wizards"), (7, "word " * 5000 + "one")]
    return spark.createDataFrame([(*r, 0.5, 1, "clash", 3, "clash") for r in data], ITEMS).repartition(2)


def check_search(out, docs, items, k):
    want = brute_search(docs, items, k)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    expected = collections.defaultdict(list)
    for (item_id, _), found in want.items():
        expected[item_id] += [(n, d, s) for n, (d, s) in enumerate(found, 1)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert {i: sorted(v, key=key) for i, v in got.items()} == {i: sorted(v, key=key) for i, v in expected.items() if v}


@pytest.mark.parametrize("block_bytes", [lexical_search.BLOCK_BYTES, 30])
def test_search_edges_by_brute_force(spark, edge, items, block_bytes):
    docs, asked = [(r[0], r[1]) for r in rows()], [(r.item_id, r.text) for r in items.collect()]
    check_search(lexical_search.search(spark, edge, items, k=3, block_bytes=block_bytes), docs, asked, 3)


def test_search_matches_sql(spark, con):
    con.execute(f"CREATE OR REPLACE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    same(queries.QUERIES["op11_lexical_search"](spark, SF), con, lexical_search.SQL)


def test_search_empty_sides(spark, empty, edge, items):
    assert lexical_search.search(spark, empty, items).collect() == []
    assert lexical_search.search(spark, edge, items.limit(0)).collect() == []


def test_ties_go_to_smaller_ids(spark):
    docs = spark.createDataFrame([(i, "same text here") for i in range(50, 0, -1)], "doc_id long, text string").repartition(7)
    asked = spark.createDataFrame([(0, "text")], "item_id long, text string")
    assert [(r["rank"], r.doc_id) for r in lexical_search.search(spark, docs, asked).orderBy("rank").collect()] == \
        [(k, k) for k in range(1, 11)]


def test_terms_are_the_pattern():
    text = "".join(map(chr, itertools.chain(range(0x300), range(0x2000, 0x2100)))) + " Ünï-ÇODE_42"
    assert [t.decode() for t in lexical_search.terms(text.encode())] == terms_of(text)


# ---------------------------------------------------------------- sharding
def heap_loads(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return sorted(load for load, _ in heap)


def test_counted_rounds_equal_single_steps():
    rnd = random.Random(5)
    for _ in range(200):
        shards = rnd.randint(1, 7)
        histogram = {rnd.randint(1, 60): rnd.randint(1, 40) for _ in range(rnd.randint(1, 9))}
        loads = sharding.Loads(shards)
        for size in sorted(histogram, reverse=True):
            assert sum(n for _, n in loads.place(size, histogram[size])) == histogram[size]
        assert sorted(x for x, _ in loads.heap) == heap_loads([s for s, n in histogram.items() for _ in range(n)], shards)


def check_shards(report, docs, shards):
    got = report.collect()
    assert len(got) == len(docs)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs)
    groups, slots, loads = {}, collections.defaultdict(list), collections.Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        assert groups.setdefault((r["size"], r.text_crc32), r.shard) == r.shard
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sums = collections.Counter()
    for _, t in docs:
        sums[t or ""] += len((t or "").encode()) + 8
    assert sorted(loads[s] for s in range(shards)) == heap_loads(sums.values(), shards)


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards_on_edges(spark, edge, shards):
    check_shards(sharding.shard_report(spark, edge, shards), [(r[0], r[1]) for r in rows()], shards)


def test_shards_on_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_shards(queries.QUERIES["op12_sharding"](spark, SF), docs, 24)


def test_hot_group_and_hot_size(spark):
    data = [(i, "copy of one text" if i % 3 == 0 else f"{i:08d}") for i in range(6000)]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    first = sharding.shard_report(spark, frame, 5)
    check_shards(first, data, 5)
    again = sharding.shard_report(spark, frame.repartition(13), 5)
    assert sorted(first.collect()) == sorted(again.collect())   # by the rows alone


def test_shards_empty_and_files(spark, empty, edge, tmp_path):
    assert sharding.shard_report(spark, empty).collect() == []
    sharding.write_shards(spark, edge, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("doc.*").columns == edge.columns and back.count() == len(rows())
    assert back.groupBy("shard", "slot").count().filter("count > 1").isEmpty()


# ---------------------------------------------------------------- spelling
def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(counts):
    out = {}
    for w, n in counts.items():
        close = [x for x in counts if abs(len(x) - len(w)) < 2 and x != w and near(w, x)]
        top = min(close, key=lambda x: (-counts[x], x), default=None)
        form = top if top is not None and counts[top] >= 10 * n else None
        out[w] = (form, n, len(close), counts[form] if form else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {(w, f, root(w), n, k, fn) for w, (f, n, k, fn) in out.items()}


def grouped(spark, counts):
    frame = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    return {tuple(r) for r in spelling.group_variants(spark, frame).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()}


def test_spelling_matches_sql(spark, con):
    same(queries.QUERIES["op13_spelling"](spark, SF), con, spelling.SQL)


def test_dense_words_by_brute_force(spark):
    rnd = random.Random(3)
    counts = {"".join(rnd.choices("abé", k=rnd.randint(7, 9))): rnd.choice([2, 3, 30, 300, 5000]) for _ in range(700)}
    assert grouped(spark, counts) == brute_groups(counts)


def test_runs_of_one_letter_and_very_long_words(spark):
    base = "".join(random.Random(1).choices("abcdefghij", k=1500))
    counts = {"a" * k: k for k in range(7, 40)}
    counts |= {base: 90, base[:700] + "x" + base[701:]: 2, base + "z": 3, base[1:]: 900, "y" + base[:-1]: 4,
               base[:700] + "xy" + base[701:]: 5, base[:44] + "q" + base[44:]: 9}
    assert grouped(spark, counts) == brute_groups(counts)


def brute_words(docs):
    counts = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_spelling_edges(spark, edge, empty):
    assert spelling.spelling_report(spark, empty).collect() == []
    texts = [(i, f"Wörterbuch WÖRTERBUCH wörterbuch{'' if i % 9 else 's'} ÀÉÎabcd×÷ßÿ {'x' * 20_000} alphabet12alphabet") for i in range(80)]
    texts += [(None, "Wörterbuch alphabet"), (90, None), (91, "")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {tuple(r) for r in spelling.spelling_report(spark, frame).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == brute_groups(brute_words(texts))
    docs = [(r[0], r[1]) for r in rows()]
    assert {(r.word, r.n) for r in spelling.vocabulary(edge).collect()} == set(brute_words(docs).items())
