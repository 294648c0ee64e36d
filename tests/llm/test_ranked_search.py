"""Ranked search against scores of every document, and on odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tallyframe.llm import ranked_search

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def terms(text):
    folded = re.sub("[A-Z]", lambda c: c.group().lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", folded)


def brute_force(docs, items, k=10):
    held = [(doc, Counter(terms(text))) for doc, text in docs if terms(text)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in dict.fromkeys(items):
        scored = []
        for doc, count in held:
            m = 10 + 90 * sum(count.values()) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * count[t] // (1000 * count[t] + 8 * m))
                for t in set(terms(text))
                if t in count
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, doc, -score] += 1
    return out


def searched(frame, docs, items, parts=3, k=10, **how):
    index = ranked_search.build_index(frame([(*d, "x") for d in docs], DOCS + ", term string", parts), **how)
    rows = ranked_search.search(index, frame([(*i, 1) for i in items], ITEMS + ", rank int", 2), k=k).collect()
    return Counter(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in rows)


def collection(seed, n, vocabulary=400):
    """Words of very different frequencies, texts of very different lengths."""
    draw = random.Random(seed)
    word = lambda: f"w{int(vocabulary * draw.random() ** 3)}"
    docs = [(k, " ".join(word() for _ in range(draw.choice([3, 30, 200])))) for k in range(n)]
    items = [(k, " ".join(word() for _ in range(draw.randrange(1, 15)))) for k in range(25)]
    return docs, items


def test_search_equals_brute_force_in_many_shards(frame):
    docs, items = collection(1, 900)
    wanted = brute_force(docs, items)
    assert searched(frame, docs, items, 3, shard_bytes=20_000) == wanted
    assert searched(frame, docs, items, 1) == wanted
    assert searched(frame, docs, items, 2, k=3, shard_bytes=50_000) == brute_force(docs, items, 3)


def test_odd_rows(frame):
    docs = [
        (1, "Alpha beta-GAMMA"), (2, "alpha"), (2, "alpha"), (3, None), (4, ""), (5, " .,;\x00\x7f"), (None, "alpha delta"),
        (None, "alpha delta"), (6, "été ÉTÉ Straße 東京"), (7, "long " * 50_000 + "beta"), (8, "\U0001f600x alpha"), (9, "x" * 200_000),
    ]
    items = [
        (1, "ALPHA alpha"), (2, "gamma delta"), (3, None), (4, "?!"), (5, "été"), (None, "beta"), (1, "ALPHA alpha"),
        (6, "absent"), (7, "\U0001f600X"), (8, "long"), (9, "x" * 200_000), (10, "東京"), (1, "straße"),
    ]
    for parts in (1, 4):
        assert searched(frame, docs, items, parts, shard_bytes=100) == brute_force(docs, items)


def test_ties_go_by_id(frame):
    docs = [(k, "same words here") for k in range(500, 0, -1)] + [(1000 + k, "other text") for k in range(300)]
    got = searched(frame, docs, [(1, "words")], 4, shard_bytes=500)
    assert [doc for _, rank, doc, _ in sorted(got)] == list(range(1, 11)) and got == brute_force(docs, [(1, "words")])


def test_nothing_to_search(frame):
    assert not searched(frame, [], [(1, "a")]) and not searched(frame, [(1, "a")], []) and not searched(frame, [(1, None)], [(1, "a")])


def test_items_in_rounds(frame, monkeypatch):
    monkeypatch.setattr(ranked_search, "TERMS_AT_ONCE", 40)
    docs, items = collection(2, 200)
    assert searched(frame, docs, items) == brute_force(docs, items)


def shard_batch(docs):
    shard = ranked_search._Shard()
    shard.add(pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], names=["id", "text"]))
    return pa.Table.from_batches(list(shard.rows(0))).combine_chunks().to_batches()[0]


def test_blocks_without_a_survivor_stay_closed():
    """A rare word decides; the common one's list of 80 blocks is opened only where the rare word is."""
    docs = [(k, "common filler text" + (" rare rare" if k % 1000 == 7 else "")) for k in range(5200)]
    batch = shard_batch(docs)
    n_terms = sum(len(terms(t)) for _, t in docs)
    term = dict(zip(("common", "rare"), ranked_search.terms_of(pa.array(["common rare"])).hashes().view(np.int64).tolist()))
    find = ranked_search._Searcher([(0, 1, [(term["common"], 2), (term["rare"], 9000)])], len(docs), n_terms, 5)
    got = find(batch)
    assert sorted(got.column("doc_id").to_pylist()) == [7, 1007, 2007, 3007, 4007]
    common = -(-5200 // ranked_search.BLOCK)
    # The sixth document with the rare word ties, so that all six blocks are looked at and no more.
    assert find.opened == 1 + 6 and find.passed >= common - 6


def test_wide_gaps_and_frequencies_are_packed_whole():
    docs = [(k, "a" if k in (0, 300, 70_000) else "b") for k in range(70_001)] + [(80_000, "a " * 70_000), (80_001, "a " * 300)]
    batch = shard_batch(docs)
    row = batch.column("term").to_pylist().index(ranked_search.terms_of(pa.array(["a"])).hashes().view(np.int64)[0])
    searcher = ranked_search._Searcher([], len(docs), 10**6, 1)
    one = ranked_search._List(batch.column("blocks")[row].as_py(), batch.column("postings")[row].as_py(), np.full(len(docs), 10), searcher)
    where, impact = one.all()
    assert where.tolist() == [0, 300, 70_000, 70_001, 70_002]
    assert impact.tolist() == [10**9 * tf // (1000 * tf + 80) for tf in (1, 1, 1, 70_000, 300)]
    assert searcher.measure(np.array([2**40])).tolist() == [10 + 90 * 2**40 * len(docs) // 10**6]
