"""Each operator on small tables: nulls, empty and long texts, ties, repeats, empty tables, extra
columns, and against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import (
    bayes_minhash,
    decontamination,
    language_id,
    lattice_dedup,
    ordinal_quality,
    source_mixing,
    substring_dedup,
    token_counts,
    url_filter,
    warc,
)
from tallyframe.llm.components import components
from tallyframe.llm.wordscan import gram_hashes, scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 20_000


def words_of(n, seed, vocabulary=4000):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def odd_documents():
    """Null ids and texts, blanks, separators of all kinds, a long text, repeated rows, one id twice."""
    text = " ".join(words_of(60, 1))
    return [
        (1, text, "en", "a", 5),
        (2, text, "en", None, None),
        (2, text, "en", None, None),
        (3, None, None, "a", 0),
        (4, "", "en", "b", 0),
        (5, " \t\n\x0b\x0c\r ", "en", "b", 7),
        (6, LONG, "en", "b", None),
        (None, text, None, "c", None),
        (None, "few words", "en", "c", None),
        (7, "é\u00a0x\tmany  spaces", "fr", "é", 3),
        (8, "A" * 5000, None, "é", 3),
        (9, " ".join(words_of(60, 2)), "fr", "c", 1),
        (9, " ".join(words_of(60, 3)), "fr", "c", 1),
    ]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words_and_grams_agree_with_plain_python():
    import pyarrow as pa

    texts = ["one two  three", None, "", " x ", "tail\n", "é ü" * 30, "b" * 200 + " c", "one two"]
    found = scan(pa.array(texts))
    raw = found.data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(found.starts, found.ends)]
    assert got == [w for t in texts for w in split(t)]
    assert np.diff(found.bounds).tolist() == [len(split(t)) for t in texts]
    hashes = found.hashes()
    assert len(set(hashes.tolist())) == len(set(got))
    for n in (1, 2, 5, 7, 8, 35):
        grams = gram_hashes(hashes, n)
        plain = [tuple(got[k : k + n]) for k in range(len(got) - n + 1)]
        assert len(grams) == len(plain)
        assert len(set(zip(plain, grams.tolist()))) == len(set(plain)) == len(set(grams.tolist()))


def test_components_of_chains_hubs_and_loops(frame):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    rows = {r["node"]: r["component"] for r in components(frame(edges, "a long, b long")).collect()}
    assert rows == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 300: 200}
    assert components(frame([], "a long, b long")).count() == 0


# WARC ------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, frame, tmp_path):
    body = "<p>" + "x\r\n\r\n" * 40
    rows = [
        (3, "http://b.example/x?q=1", body),
        (1, "http://B.example/x?q=1", body),
        (2, None, body),
        (4, "not a url\r\nX-Injected: 1", "short"),
        (5, "http://a.example/", "short"),
        (6, "http://a.example/", None),
        (7, "http://ü.example/é", "é" * 60),
        (8, "http://a.example/", LONG),
        (8, "http://a.example/", LONG),
        (None, "http://z.example/", body),
    ]
    pages = frame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    folder = str(tmp_path / "warc")
    warc.write_archives(pages, folder, captured=F.timestamp_seconds(F.lit(1000) + F.col("page_id")), records_per_archive=2)
    runs = warc.read_runs(spark, folder)
    assert runs.select("run").distinct().count() >= 4
    index = warc.merge_runs(runs).collect()
    keys = [(r["url_key"], r["captured"], r["record_id"]) for r in index]
    assert keys == sorted(keys) and len(keys) == len(rows)
    expected = Counter()
    for page, _, html in rows:
        payload = (html or "").encode()
        equal = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        revisit = len(payload) >= 100 and page != min(equal)
        kind, refers = ("revisit", str(min(equal))) if revisit else ("response", None)
        expected[str(page) if page else "none", len(payload), hashlib.sha256(payload).hexdigest(), kind, refers] += 1
    got = Counter(tuple(r[c] for c in ("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in index)
    assert got == expected
    assert all(r["intact"] is (None if r["record_type"] == "revisit" else True) for r in index)
    assert {r["uri"] for r in index if r["record_id"] == "4"} == {"not a url%0D%0AX-Injected: 1"}


def test_archives_of_no_pages(spark, frame, tmp_path):
    folder = str(tmp_path / "none")
    warc.write_archives(frame([], "page_id long, url string, html string"), folder)
    assert warc.merge_runs(warc.read_runs(spark, folder)).count() == 0


def test_loser_tree_merges_any_number_of_runs():
    draw = random.Random(5)
    for k in (0, 1, 2, 3, 7, 16):
        runs, keys = [], []
        for _ in range(k):
            some = sorted(draw.randrange(20) for _ in range(draw.randrange(0, 12)))
            runs.append((len(keys), len(keys) + len(some)))
            keys += some
        order = warc.loser_tree_order(keys, runs)
        assert order == sorted(range(len(keys)), key=lambda i: (keys[i], i))


# Quality ---------------------------------------------------------------------------------------


def test_grades_are_learned_in_order(frame):
    marks = {0: "bad awful", 1: "plain", 2: "fine great"}
    rows = [(k, " ".join(words_of(30, k, 300)) + " " + marks[k % 3], k % 3) for k in range(300)]
    rows += [(None, "bad", 0), (900, None, 1), (901, "plain", None), (902, "odd", 7)]
    how = ordinal_quality.Fitting(least_rows=3, bits=16)
    grader = ordinal_quality.fit(frame(rows, "doc_id long, text string, grade int"), 3, how=how)
    assert grader.thresholds.tolist() == sorted(grader.thresholds.tolist())
    docs = frame([(*r, 1.0) for r in odd_documents()] + [(50, "great fine", "en", "a", 1, 1.0), (51, "awful bad", "en", "a", 1, 1.0)], DOCS + ", tail double")
    got = ordinal_quality.grade(docs, grader, 2, how=how).collect()
    assert len(got) == 15
    grade = {r["doc_id"]: r["expected_grade"] for r in got}
    assert grade[50] > 1.4 and grade[51] < 0.6 and grade[3] == grade[4] == grade[5]


def test_grader_without_ratings(frame):
    grader = ordinal_quality.fit(frame([], "doc_id long, text string, grade int"), 3)
    got = ordinal_quality.grade(frame([(1, "x")], "doc_id long, text string"), grader, 1).first()
    assert not grader.weights.any() and got["expected_grade"] == pytest.approx(1.0)
    assert ordinal_quality.grade(frame([], "doc_id long, text string"), grader, 1).count() == 0


# Mixing ----------------------------------------------------------------------------------------


def water_filled(sizes, weights, most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(target.values())
        shares = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if shares[s] > most * sizes[s]]
        if not over:
            return target | shares
        for s in over:
            target[s] = most * sizes[s]
            open_.remove(s)


def test_mix_meets_targets(frame):
    rows = odd_documents()
    got = source_mixing.mix(frame(rows, DOCS)).collect()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(split(text))
    targets = water_filled(sizes, [1, 2, 3])
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] in range(r["epochs"] * r["size"], (r["epochs"] + 1) * r["size"] + 1)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    again = source_mixing.mix(frame(rows, DOCS, 1)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_prefers_quality_and_crosses_slots(frame, monkeypatch):
    monkeypatch.setattr(source_mixing, "SLOT_ROWS", 50)
    rows = [(k, "a b c d", "x") for k in range(1200)] + [(k, "a b c d", "y") for k in range(1200, 2400)]
    quality = frame([(k, 10.0) for k in range(0, 2400, 2)] + [(1, -1.0), (None, 5.0)], "doc_id long, quality double")
    mixed = source_mixing.mix(frame(rows, "doc_id long, text string, source string"), weights=(1.0, 3.0), quality=quality).collect()
    part = [r for r in mixed if r["source"] == "x"]
    assert sum(r["taken"] for r in part) == 2400 and {r["taken"] for r in part} <= {0, 4, 1, 2, 3}
    assert sum(r["taken"] for r in part if r["doc_id"] % 2 == 0) > 0.75 * 2400


def test_rows_without_an_id_are_drawn_one_by_one(frame):
    """Half of a source has no id, a fifth is one row again and again; each part gives its share."""
    texts = [f"w{k} b c d" for k in range(4000)]
    rows = [(None, t, "x") for t in texts] + [(k, t, "x") for k, t in enumerate(texts)] + [(7, "e f g h", "x")] * 2000
    rows += [(k, "a b c d", "y") for k in range(10_000, 20_000)]
    kind = "doc_id long, text string, source string"
    mixed = source_mixing.mix(frame(rows, kind), weights=(1.0, 3.0))
    taken = Counter()
    for r in mixed.where("source = 'x'").collect():
        taken["none" if r["doc_id"] is None else "same" if r["doc_id"] == 7 else "other"] += r["taken"]
    whole = sum(taken.values())
    assert whole == pytest.approx(20_000, abs=1)
    assert abs(taken["none"] / whole - 0.4) < 0.02 and abs(taken["same"] / whole - 0.2) < 0.02
    again = source_mixing.mix(frame(rows, kind, 7), weights=(1.0, 3.0))
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, again.collect()))


def test_mix_of_nothing(frame):
    assert source_mixing.mix(frame([], DOCS)).count() == 0
    one = source_mixing.mix(frame([(1, None, None, None, None)], DOCS)).first()
    assert (one["size"], one["source_size"], one["target"], one["taken"]) == (0, 0, 0, 0)


# Decontamination -------------------------------------------------------------------------------


def test_leaks_survive_substitutions(frame):
    item = words_of(30, 7)
    changed = [w if k % 6 else "other" for k, w in enumerate(item)]
    mangled = [w if k % 2 else "other" for k, w in enumerate(item)]
    before, after = words_of(500, 8, 10**6), words_of(500, 9, 10**6)
    docs = [
        (1, " ".join(before + item + after)),
        (2, ", ".join(before[:40] + changed).upper()),
        (3, " ".join(before + mangled + after)),
        (4, " ".join(item[10:25] + after)),
        (None, " ".join(item)),
        (5, " ".join(before)),
        (6, LONG),
        (1, "same id, another text"),
        *[(d, t) for d, t, *_ in odd_documents()[3:6]],
    ]
    items = [(10, " ".join(item)), (11, " ".join(item)), (12, None), (13, ""), (14, "too short to tell"), (14, "word word word"), (None, " ".join(item))]
    corpus, benchmark = frame([(*d, "x") for d in docs], "doc_id long, text string, item string"), frame(items, "item_id long, text string")
    found = decontamination.leaks(corpus, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(d, i) for d in (1, 2, 4, None) for i in (10, 11, None)} | {(6, 14)}
    assert {r["doc_token"] for r in found if r["doc_id"] == 1} == {500}
    kept = decontamination.remove_leaking(corpus, benchmark)
    assert kept.columns == corpus.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 3, 4, 5, 5]
    joined = decontamination.leaks(corpus, benchmark, how=decontamination.Seeds(broadcast_rows=0)).collect()
    assert sorted(map(str, joined)) == sorted(map(str, found))


@pytest.mark.parametrize("sizes", [range(8, 14), range(4, 8)])
def test_leaks_under_every_allowed_substitution(frame, sizes):
    items, docs, expected = [], [], set()
    for n in sizes:
        item = [f"i{n}t{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        most = n - (80 * n + 99) // 100
        for changed in range(most + 2):
            for places in itertools.combinations(range(n), changed):
                text = ["x" if k in places else w for k, w in enumerate(item)]
                docs.append((len(docs), "y " + " ".join(text) + " z"))
                if changed <= most:
                    expected.add((len(docs) - 1, n))
    found = decontamination.leaks(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected


def test_short_and_unspaced_items(frame):
    han = "敏捷的棕色狐狸跳过了那只懒惰的狗然后回家睡觉"
    thai = "สุนัขจิ้งจอกสีน้ำตาล"
    docs = [(1, f"前面的文字{han}后面的文字"), (2, f"x {han[:9]}猫{han[10:]}"), (3, f"ก่อน{thai}หลัง"), (4, "so what is the capital, then"), (5, "the capital what is"), (6, "狐狸"), (7, "to be")]
    items = [(1, han), (2, thai), (3, "What is the capital?"), (4, "to be"), (5, "狐狸"), (6, None), (7, "...")]
    corpus, benchmark = frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")
    found = decontamination.leaks(corpus, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 1), (2, 1), (3, 2), (4, 3), (7, 4), (1, 5), (2, 5), (6, 5)}


def test_items_of_a_few_tokens_are_found_verbatim(frame):
    draw = random.Random(8)
    docs = [(k, " ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(0, 12)))) for k in range(300)]
    docs += [(300, "Point, seven!"), (300, "point seven"), (None, "nothing here"), (301, None), (302, "a " * 50_000 + "zz")]
    items = [(1, "a"), (2, "b c"), (3, "d e f"), (4, "h h h"), (5, "point seven"), (6, "Nothing here."), (7, "b c"), (8, "zz"), (9, "absent")]
    found = decontamination.leaks(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()
    plain = lambda t: re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (t or "").lower())
    expected = set()
    for doc, text in docs:
        words = plain(text)
        for item, wanted in items:
            wanted = plain(wanted)
            at = next((k for k in range(len(words)) if words[k : k + len(wanted)] == wanted), None)
            if at is not None:
                expected.add((doc, item, at, len(wanted)))
    assert {(r["doc_id"], r["item_id"], r["doc_token"], r["matched"]) for r in found} == expected
    clean = decontamination.remove_leaking(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"))
    assert clean.count() == sum(1 for doc, _ in docs if doc not in {d for d, *_ in expected})


def plain_leaks(docs, items, stretch=13, percent=80):
    """Best stretch of every item in every document over all diagonals."""
    out = set()
    for doc, text in docs:
        words = text.split()
        for item, wanted in items:
            wanted = wanted.split()
            size, best = min(stretch, len(wanted)), None
            for diagonal in range(1 - len(wanted), len(words)):
                equal = [0 <= diagonal + k < len(words) and words[diagonal + k] == w for k, w in enumerate(wanted)]
                for k in range(len(wanted) - size + 1):
                    best = max(best or (0,), (sum(equal[k : k + size]), -(diagonal + k), -k))
            if best and best[0] * 100 >= size * percent:
                out.add((doc, item, -best[1], -best[2], best[0], size))
    return out


@pytest.mark.parametrize("together", [1_000_000, 100])
def test_leaks_of_repetitive_texts(frame, together):
    draw = random.Random(4)
    docs = [(1, "a " * 90), (2, "a b " * 40), (3, "a b c " * 9 + "x " + "a b c " * 9), (4, "b " * 7), (5, "a " * 30 + "b " * 30)]
    docs += [(10 + k, " ".join(draw.choice("ab") for _ in range(draw.randrange(1, 60)))) for k in range(20)]
    items = [(1, "a " * 20), (2, "a b " * 8), (3, "b a a " * 6), (4, "b " * 5), (5, "a " * 10 + "b " * 10), (6, "c a b c a b x a b c a b c a")]
    found = decontamination.leaks(
        frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), how=decontamination.Seeds(together=together)
    ).collect()
    got = [tuple(r[c] for c in ("doc_id", "item_id", "doc_token", "item_token", "matched", "stretch")) for r in found]
    assert len(got) == len(set(got)) and set(got) == plain_leaks(docs, items)


def test_leaks_of_a_long_repetitive_text(frame):
    docs = [(1, "word " * 100_000), (2, "one two three four five " * 20_000), (3, "other words here")]
    items = [(k, "word " * (16 + k % 40)) for k in range(100)] + [(100, "three four five one two " * 4)]
    corpus, benchmark = frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")
    found = decontamination.leaks(corpus, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, k) for k in range(100)} | {(2, 100)}
    assert {(r["doc_token"], r["item_token"], r["matched"]) for r in found if r["doc_id"] == 1} == {(0, 0, 13)}
    assert [r["doc_id"] for r in decontamination.remove_leaking(corpus, benchmark).collect()] == [3]


def test_leaks_of_empty_tables(frame):
    docs, items = frame([(1, "a")], "doc_id long, text string"), frame([], "item_id long, text string")
    assert decontamination.leaks(docs, items).count() == 0
    assert decontamination.remove_leaking(docs, items).count() == 1
    assert decontamination.leaks(frame([], "doc_id long, text string"), frame([(1, "a")], "item_id long, text string")).count() == 0


# Passages --------------------------------------------------------------------------------------


def plain_passages(texts, size):
    docs = [split(t) for t in texts]
    starts = Counter(tuple(w[k : k + size]) for w in docs for k in range(len(w) - size + 1))
    out = []
    for w in docs:
        gone = {i for k in range(len(w) - size + 1) if starts[tuple(w[k : k + size])] > 1 for i in range(k, k + size)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("bucket", [4096, 3])
def test_passages_agree_with_brute_force(frame, bucket):
    shared, other = words_of(50, 20), words_of(36, 21)
    rows = [(k, " ".join(words_of(40, 100 + k) + shared[k % 4 :] + words_of(k, 200 + k))) for k in range(24)]
    rows += [(30, " ".join(other + other)), (31, "a b " * 60), (32, " ".join(shared[:34])), (33, "\t".join(other[:35]))]
    rows += [(d, t) for d, t, *_ in odd_documents()]
    docs = frame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    got = substring_dedup.remove_repeats(docs, how=substring_dedup.Windows(bucket=bucket)).collect()
    plain = plain_passages([t for _, t in rows], 35)
    expected = Counter((d, n, gone, None if t is None else kept) for (d, t), (n, gone, kept) in zip(rows, plain))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == expected
    assert all(r["n_removed"] == sum(s["last"] - s["first"] + 1 for s in r["removed"]) for r in got)


@pytest.mark.parametrize("how", [substring_dedup.Windows(), substring_dedup.Windows(bucket=3, string=7)])
def test_passages_of_repetitive_texts(frame, how):
    draw = random.Random(5)
    rows = [(1, "a " * 900), (2, "a " * 35), (3, "a b " * 17 + "a"), (4, "a " * 34), (5, "x y z " * 40 + " ".join(words_of(50, 30)))]
    rows += [(6 + k, " ".join(draw.choice("ab") for _ in range(draw.randrange(200)))) for k in range(30)]
    rows += [(40 + k, " ".join(words_of(6, 40 + k) * (k + 4))) for k in range(6)]
    rows += [(50, "a " * 20 + " ".join(words_of(40, 31)) + " a" * 20), (51, "q " * 36 + "end"), (52, "r " * 35 + "end")]
    got = substring_dedup.remove_repeats(frame(rows, "doc_id long, text string"), how=how).collect()
    expected = {d: e for (d, _), e in zip(rows, plain_passages([t for _, t in rows], 35))}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in got} == expected


def test_a_long_repetitive_text_is_split(frame):
    how = substring_dedup.Windows(bucket=64)
    docs = frame([(1, "word " * 200_000), (2, "word " * 60 + "end")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(docs, how=how).collect()}
    assert got == {1: (200_000, ""), 2: (60, "end")}


def test_untouched_texts_may_stay(frame):
    docs = frame([(1, "a  b\n")], "doc_id long, text string")
    assert substring_dedup.remove_repeats(docs, untouched_as_is=True).first()["text"] == "a  b\n"
    assert substring_dedup.remove_repeats(docs).first()["text"] == "a b"
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


# URLs ------------------------------------------------------------------------------------------


def test_urls_are_judged(frame):
    rules = (url_filter.Rule("allow", "com"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"))
    cases = [
        ("http://WWW.Example.com/en/porn", "www.example.com", "/en/porn", "www.example.com/en/", "allow"),
        ("http://x.example.com/en/?a", "x.example.com", "/en/", "example.com/en/", "block"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://example.com#a://b/", "example.com", "", None, "allow"),
        ("ftp://s.org/xxx/1", "s.org", "/xxx/1", None, "block"),
        ("http://s.org/xxxl", "s.org", "/xxxl", None, "allow"),
        ("http://s.org/poker", "s.org", "/poker", None, "allow"),
        ("http://s.org/poker-poker", "s.org", "/poker-poker", None, "allow"),
        ("http://Casino.org/POKER", "casino.org", "/POKER", None, "block"),
        ("casino poker", "", "", None, "block"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://s.org/" + "a" * 100_000, "s.org", "/" + "a" * 100_000, None, "allow"),
    ]
    pages = frame([(c[0], k, "mine") for k, c in enumerate(cases)], "url string, page_id long, verdict string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, rules).collect()}
    for k, (_, *expected) in enumerate(cases):
        assert [got[k][c] for c in ("host", "path", "rule", "verdict")] == expected
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    none = url_filter.judge(pages, (), url_filter.Vocabulary((), {}))
    assert {r["verdict"] for r in none.collect()} == {"allow"}


# Vectors ---------------------------------------------------------------------------------------


def plain_links(rows):
    usable = []
    for k, (_, v, label) in enumerate(rows):
        if rows[k][0] is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not np.any(v):
            continue
        usable.append((k, np.array(v, float) / np.linalg.norm(v)))
    root, degree = list(range(len(rows))), Counter()
    find = lambda x: x if root[x] == x else find(root[x])
    for a, (i, x) in enumerate(usable):
        for j, y in usable[:a]:
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y >= 0.93:
                degree[i] += 1
                degree[j] += 1
                p, q = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[q] = p
    return [(rows[k][0], degree[k], rows[find(k)][0]) for k in range(len(rows))]


@pytest.mark.parametrize("block", [512, 8])
def test_vector_links_agree_with_brute_force(frame, block):
    draw = np.random.default_rng(1)
    rows = []
    for group in range(6):
        center = draw.normal(size=64)
        for _ in range(25):
            noise = draw.normal(size=64) * 0.15
            rows.append((len(rows) * 7 % 1009 + 5, (center + noise).astype(np.float32).tolist(), group % 2))
    rows += [(2000 + k, draw.normal(size=64).tolist(), 1) for k in range(40)]
    rows += [(3000, rows[0][1], rows[0][2]), (3001, rows[0][1], rows[0][2]), (3002, rows[0][1], None), (3003, None, 1), (3004, [], 1)]
    rows += [(3005, [0.0] * 64, 1), (3006, [float("nan")] * 64, 1), (3007, [1.0, None], 1), (3008, [float("inf"), 1.0], 1), (3009, [1.0, 2.0], 1), (3010, [2.0, 4.0], 1)]
    rows += [(None, rows[0][1], rows[0][2])]
    vectors = frame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, copies int")
    got = lattice_dedup.near_vectors(vectors, how=lattice_dedup.Lattice(block=block)).collect()
    found = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    assert found == Counter(plain_links(rows))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert lattice_dedup.near_vectors(vectors.limit(0)).count() == 0


def test_recall_at_the_threshold(frame):
    """Pairs just over the threshold, which are the hardest."""
    draw = np.random.default_rng(2)
    rows = []
    for k in range(400):
        x, y = draw.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        rows += [(2 * k, x.tolist(), 0), (2 * k + 1, (0.931 * x + np.sqrt(1 - 0.931**2) * y).tolist(), 0)]
    got = lattice_dedup.near_vectors(frame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r["n_links"] for r in got) >= 0.95 * 800


def test_decoded_points_are_nearest():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(200, 8)) * 2
    points = lattice_dedup.nearest_points(x)
    around = lattice_dedup._neighbours()
    assert len(around) == 240
    own = ((x - points) ** 2).sum(1)
    assert all((((x - points - step) ** 2).sum(1) >= own - 1e-9).all() for step in around)


# Documents -------------------------------------------------------------------------------------


def plain_near(rows):
    sets = []
    for doc, text, *_ in rows:
        w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = sorted({r[0] for r in rows if r[0] is not None})
    root = {d: d for d in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            a, b = rows[i][0], rows[j][0]
            if a is not None and b is not None and x & y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return Counter((d, len(s), None if d is None else find(d)) for (d, *_), s in zip(rows, sets))


@pytest.mark.parametrize("block", [2048, 4])
def test_near_documents_agree_with_brute_force(frame, block):
    rows = [(d, t) for d, t, *_ in odd_documents()]
    draw = random.Random(4)
    for group in range(4):
        base = words_of(150, 300 + group)
        # Far variants: linked to the base but hardly to each other.
        for k in range(30):
            text = list(base)
            for _ in range(draw.choice([0, 1, 3, 4, 5])):
                text[draw.randrange(len(text))] = f"new{draw.randrange(10**9)}"
            rows.append((1000 - 40 * group - k, " ".join(text).upper() if k % 7 == 0 else " ".join(text)))
    rows += [(2000, "A b"), (2001, "a B"), (2002, "a b c d e"), (2003, "a b c d f")]
    docs = frame([(*r, "x") for r in rows], "doc_id long, text string, rep string")
    got = bayes_minhash.near_duplicates(docs, how=bayes_minhash.MinHashing(block=block)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_near(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert bayes_minhash.near_duplicates(docs.limit(0)).count() == 0


def clashing_documents():
    """Tables merged from several sources: ids with several unlike texts, near-copies under other ids."""
    draw = random.Random(11)
    bases = [words_of(80, 500 + k) for k in range(12)]
    rows = []
    for k in range(60):
        text = list(bases[k % 12])
        text[draw.randrange(80)] = f"new{k}"
        # A third of the rows has one id.
        rows.append((77 if k % 3 == 0 else draw.randrange(8) * 10, " ".join(text)))
    return rows + [(k, " ".join(words_of(80, 700 + k // 2))) for k in range(100, 140)] + [(k, " ".join(words_of(80, 800 + k))) for k in range(100, 140, 4)]


@pytest.mark.parametrize("block", [2048, 4])
def test_near_documents_whose_ids_clash(frame, block):
    rows = clashing_documents() + [(77, None), (100, " ")]
    docs = frame(rows, "doc_id long, text string")
    got = bayes_minhash.near_duplicates(docs, how=bayes_minhash.MinHashing(block=block)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_near(rows)


def test_unlike_texts_of_one_id_stay(spark, frame, tmp_path):
    import corpus_pipeline

    rows = clashing_documents() + [(None, "no id"), (None, "no id"), (9, None), (9, "")]
    docs = frame([(d, t, "en", "a", k) for k, (d, t) in enumerate(rows)], DOCS)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    # Every text as a document of its own, numbered in the order of (id, text).
    order = sorted({r for r in rows if r[0] is not None and r[1]})
    groups = {}
    for number, _, group in plain_near([(k, t) for k, (_, t) in enumerate(order)]):
        groups.setdefault(group, []).append(order[number])
    expected = [min(d for d, _ in texts) for texts in groups.values()]
    assert sorted(d for d, t in got if d is not None and t) == sorted(expected)
    assert all(any(r in texts for r in got) for texts in groups.values())
    assert Counter(r for r in got if r[0] is None or not r[1]) == Counter({(None, "no id"): 1, (9, None): 1, (9, ""): 1})


def test_near_duplicates_stage_is_the_same_on_every_rerun(spark, frame, tmp_path):
    import corpus_pipeline

    text, other = " ".join(words_of(60, 1)), " ".join(words_of(60, 2))
    rows = [(4, text, "en", s, k) for k, s in enumerate("cab")] + [(None, text, "en", "d", 1)] * 5 + [(None, other, None, s, None) for s in "yzx"]
    rows += [(3, None, "en", "b", 2), (3, None, "en", "a", 3), (None, other + " and more", "en", "q", 1)]
    runs = [
        sorted(map(str, corpus_pipeline.near_duplicates(spark, frame(rows, DOCS, parts), str(tmp_path)).collect()))
        for parts in (1, 3, 5)
    ]
    assert runs[0] == runs[1] == runs[2]
    got = corpus_pipeline.near_duplicates(spark, frame(rows, DOCS), str(tmp_path)).collect()
    # One text of each group; of equal rows the first by their other columns.
    assert (4, text, "a") in {(r["doc_id"], r["text"], r["source"]) for r in got}
    assert Counter(r["doc_id"] for r in got) == Counter({4: 1, None: 1, 3: 1})


def test_pruning_bound_is_the_posterior():
    how = bayes_minhash.MinHashing(miss=0.01)
    draw = np.random.default_rng(6)
    for n, least in zip((32, 64, 96, 128), how.least_matches()):
        tail = lambda m: (draw.beta(m + 1, n - m + 1, 400_000) >= 0.75).mean()
        assert tail(least) > 0.007 and tail(least - 1) < 0.013


# Tokens ----------------------------------------------------------------------------------------


def test_spliced_counts_are_whole_counts(frame):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = Tokenizer.from_file(path)
    draw = random.Random(8)
    alphabet = "aé'sß1 \n\t日本<|end>.e\u0301\u00a0\x1cXΣİ"
    texts = ["".join(draw.choice(alphabet) for _ in range(n)) for n in (50, 400, 3000, 9000)]
    texts += ["x" * 3000, "<|endoftext|> x<|ENDOFTEXT|>y<|startoftext|>z " * 100, " ".join(words_of(3000, 9)), " " * 2000, "", None, "don't " * 500, "日本" * 900]
    docs = frame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for how in (token_counts.Chunking(chunk=200, overlap=8), token_counts.Chunking()):
        rows = token_counts.count_tokens(docs, token_counts.tokenizer_json(path), how=how).collect()
        got = {r["doc_id"]: r for r in rows}
        for k, text in enumerate(texts):
            assert got[k]["n_tokens"] == len(encoder.encode(text or "", add_special_tokens=False))
            assert got[k]["n_bytes"] == len((text or "").encode())
        assert (got[6]["n_chunks"] > 20) == (how.chunk == 200)
    assert token_counts.count_tokens(docs.limit(0), token_counts.tokenizer_json(path)).count() == 0


# Languages -------------------------------------------------------------------------------------


def all_segmentations(word, chance):
    """Sum over all segmentations, as an exact fraction."""
    sums = [Fraction(1)]
    for end in range(1, len(word) + 1):
        terms = [sums[end - len(p)] * Fraction(c) for p, c in chance.items() if p is not None and word[:end].endswith(p)]
        if word[end - 1] not in chance:
            terms.append(sums[end - 1] * Fraction(chance[None]))
        sums.append(sum(terms, Fraction(0)))
    return sums[-1]


def log_of(x):
    return math.log(x.numerator) - math.log(x.denominator)


@pytest.mark.parametrize("letters", [400_000, 100])
def test_forward_sums_all_segmentations(letters, monkeypatch):
    monkeypatch.setattr(language_id, "_CHUNK_LETTERS", letters)
    pieces = ("▁", "▁t", "the", "t", "h", "e", "he", "▁th", "é", "hehehehehehe", "▁thehehehehe", "theth")
    draw = np.random.default_rng(9)
    chance = draw.dirichlet(np.ones(len(pieces) + 1), 2).T
    model = language_id.Model(language_id.Pieces(pieces), ("a", "b"), chance)
    words = ["the", "tthe", "zé", "he" * 20, "e", "the" * 20 + "he" * 30, "zzé" * 30, "the", "he" * 150, "z" * 400]
    scores = model.word_scores(words)
    for w, word in enumerate(words):
        for lang in (0, 1):
            own = dict(zip(pieces, chance[:, lang])) | {None: chance[-1, lang]}
            assert scores[w, lang] == pytest.approx(log_of(all_segmentations("▁" + word, own)), rel=1e-9)
    assert model.word_scores([]).shape == (0, 2)


def test_expected_counts_of_pieces():
    """The expected count of a piece is its chance times the derivative of the log likelihood."""
    pieces = ("▁", "▁t", "the", "t", "h", "e", "he", "hehehehehehe")
    chance = np.random.default_rng(3).dirichlet(np.ones(len(pieces) + 1))
    words, counts = ["the", "he" * 40, "tzh", "e"], np.array([2, 1, 5, 3])
    vocabulary = language_id.Pieces(pieces)
    got = vocabulary.lattice(words).expected(np.log(chance), counts, len(chance))
    assert (got @ [*map(len, pieces), 1]) == pytest.approx(sum((len(w) + 1) * n for w, n in zip(words, counts)))
    for k in range(len(chance)):
        step = chance[k] * 1e-5
        sides = [chance + np.where(np.arange(len(chance)) == k, d, 0) for d in (step, -step)]
        likely = [language_id.Model(vocabulary, ("a",), c[:, None]).word_scores(words)[:, 0] @ counts for c in sides]
        assert got[k] == pytest.approx((likely[0] - likely[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_languages_are_learned(frame):
    pieces = ["▁", *"abcdefghijklmnopqrstuvwxyz", "ing", "ung", "▁the", "▁der", "tion"]
    docs = [(k, ("the thing nation king " if k % 2 else "der ding zeitung wohnung ") * (1 + k % 5), "en" if k % 2 else "de") for k in range(60)]
    docs += [(None, "der", "xx"), (100, None, "yy"), (101, "the", None)]
    model = language_id.train(frame(docs, "doc_id long, text string, lang string"), pieces)
    assert model.languages == ("de", "en") and model.chance.sum(0) == pytest.approx(1)
    tests = [(1, "the king"), (2, "DIE ZEITUNG der"), (3, None), (4, ""), (5, "123 !?"), (6, "the " * 30_000), (None, "a" * 5000), (1, "the king")]
    got = language_id.predict(frame([(*t, 0.5) for t in tests], "doc_id long, text string, score double"), model).collect()
    assert len(got) == len(tests)
    best = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [best[k] for k in range(1, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 and (r["score"] == 0) == (r["lang_pred"] == "und") for r in got)
    untrained = language_id.train(frame([], "doc_id long, text string, lang string"), pieces)
    assert {r["lang_pred"] for r in language_id.predict(frame(tests, "doc_id long, text string"), untrained).collect()} == {"und"}


# Pipeline --------------------------------------------------------------------------------------


def test_stages_on_odd_documents(spark, frame, tmp_path):
    import corpus_pipeline

    frame([(1, " ".join(words_of(30, 1)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame([(1, 1, 0), (1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame([(*r, "x", 2) for r in odd_documents()], DOCS + ", text_ string, carried int")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if number < 4:
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
            assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
    # Out: blank and null texts, copies of 1, also the one without an id, and 1, which holds the item.
    sizes = {(r["doc_id"], r["size"]) for r in docs.collect()}
    assert sizes == {(None, 2), (6, 0), (7, 3), (8, 1), (9, 60)}
