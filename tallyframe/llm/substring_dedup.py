"""Repeated passages: every window of consecutive words that starts more than once is removed.

A window's minimiser is the smallest hash among its word 8-grams. Consecutive windows with one
minimiser form a super-k-mer, and equal windows have equal minimisers, so:

1. every text lists its minimisers; those that occur once in the corpus are done with;
2. super-k-mers of the other minimisers travel as one packed string each to the bucket of their
   minimiser, where the windows in it are sorted and counted;
3. runs of repeated windows go back to their documents, whose covered words are removed.

A text that repeats a few words moves from one place of its minimiser to the next; windows in a row
whose minimisers have the same value travel together, in strings of up to ``string`` windows.

Words are compared by 64-bit hashes and windows by two such hashes of their 35 words. A bucket with
more than ``bucket`` strings is split by document and place: each part counts its own windows and
sends one copy of each distinct window, dealt by window hash, to a second count across parts. So no
group holds more than about ``bucket`` strings, also where they all come from one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.grouped import map_groups, named_texts, others
from tallyframe.llm.wordscan import Words, gram_hashes, mix, scan, slices
from tallyframe.session import saved_table

_POSITION_BITS = np.uint64(28)
_RUNS = "doc long, mark long, first int, last int, value long, piece int, windows binary"
_WINDOW = np.dtype([("x", "<u8"), ("y", "<u8"), ("doc", "<i8"), ("mark", "<i8"), ("at", "<i4")])


@dataclass(frozen=True)
class Windows:
    words: int = 35
    gram: int = 8
    bucket: int = 4096
    string: int = 256


def repeated_runs(docs: DataFrame, how: Windows = Windows()) -> DataFrame:
    """(doc, mark, first, last): runs of repeated windows by the word number they start at.

    ``docs`` has doc, mark and text, where doc and mark together name a row's text.
    """
    anchors = saved_table(_anchors(docs, how), "passage-anchors")
    counted = anchors.select(F.explode("anchors").alias("value")).groupBy("value").count()
    parts = F.ceil(F.col("count") / how.bucket).cast("int").alias("parts")
    shared = saved_table(counted.where("count > 1").select("value", parts), "passage-shared")
    own = anchors.select("doc", "mark", F.explode(F.array_distinct("anchors")).alias("value")).distinct()
    wanted = own.join(shared, "value").groupBy("doc", "mark").agg(F.collect_list(F.struct("value", "parts")).alias("wanted"))
    wanted = saved_table(wanted, "passage-wanted")

    strings = docs.join(wanted, ["doc", "mark"]).mapInArrow(
        _super_kmers(how), "value long, part int, parts int, doc long, mark long, at int, packed binary"
    )
    counted = saved_table(map_groups(strings, ["value", "part"], _count_windows(how), _RUNS, together=True), "passage-runs")
    across = counted.where("piece is not null").select("value", "piece", "windows")
    across = map_groups(across, ["value", "piece"], _count_across, "doc long, mark long, first int, last int", together=True)
    return counted.where("piece is null").select("doc", "mark", "first", "last").union(across)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    how: Windows = Windows(),
    untouched_as_is: bool = False,
) -> DataFrame:
    """``docs`` with the words that stay as its text, and ``n_words``, ``n_removed``, ``removed``;
    columns of these names are replaced.

    The words are joined by single spaces, unless ``untouched_as_is`` and none was removed.
    ``removed`` has the removed spans by word number. A null text has no words and stays null; an
    empty or short text has no windows. Rows are told apart by id and text, so null ids and ids
    with several texts are fine; a row that occurs twice repeats itself.
    """
    kept = others(docs, "n_words", "n_removed", "removed")
    named = named_texts(docs, id_col, text_col, others(docs, text_col))
    runs = repeated_runs(named.select("doc", "mark", "text"), how)
    spans = runs.groupBy("doc", "mark").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    spans = saved_table(spans, "passage-spans")
    cut = named.join(spans, ["doc", "mark"], "left").select("row", "text", "runs")
    row = cut.schema["row"].dataType.simpleString()
    cut = cut.mapInArrow(
        _cut(how, untouched_as_is),
        f"row {row}, text string, n_words long, n_removed long, removed array<struct<first:int,last:int>>",
    )
    columns = [F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept]
    return cut.select(*columns, "n_words", "n_removed", "removed")


def _anchors(docs: DataFrame, how: Windows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = scan(part.column("text"))
                at, _, values, moved = _runs_of_one_minimiser(words, words.hashes(), how)
                # A string whose minimiser has several places may repeat a window by itself.
                twice = np.where(moved, 2, 1)
                at, values = np.repeat(at, twice), np.repeat(values, twice)
                offsets = np.searchsorted(at, words.bounds).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
                keep = pa.array(np.diff(offsets) > 0)
                out = pa.RecordBatch.from_arrays([part.column("doc"), part.column("mark"), lists], ["doc", "mark", "anchors"])
                yield out.filter(keep)

    return docs.mapInArrow(run, "doc long, mark long, anchors array<long>")


def _runs_of_one_minimiser(words: Words, hashes: np.ndarray, how: Windows) -> tuple[np.ndarray, ...]:
    """First window, number of windows and minimiser of each super-k-mer, in order of the words, and
    whether its minimiser stands at several places."""
    grams = gram_hashes(hashes, how.gram)
    n = len(hashes) - how.words + 1
    if n <= 0:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, bool)
    # Leftmost smallest gram: the position is part of the compared value.
    ranked = (grams >> _POSITION_BITS << _POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
    width, span = how.words - how.gram + 1, 1
    while span * 2 <= width:
        ranked = np.minimum(ranked[: len(ranked) - span], ranked[span:])
        span *= 2
    rest = width - span
    least = np.minimum(ranked[: len(ranked) - rest], ranked[rest:])[:n]
    where = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
    text = words.text_index()
    inside = text[:n] == text[how.words - 1 :]
    least = grams[where]
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (text[1:n] != text[: n - 1])
    cuts = np.flatnonzero(change)
    far = np.arange(n) - np.repeat(cuts, np.diff(np.append(cuts, n)))
    cuts = np.flatnonzero(far % how.string == 0)
    counts = np.diff(np.append(cuts, n))
    moved = where[cuts] != where[cuts + counts - 1]
    keep = inside[cuts]
    return cuts[keep], counts[keep], least[cuts[keep]], moved[keep]


def _super_kmers(how: Windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = scan(part.column("text"))
                at, counts, values, _ = _runs_of_one_minimiser(words, words.hashes(), how)
                wanted = part.column("wanted").flatten()
                known, pick = np.unique(wanted.field("value").to_numpy().view(np.uint64), return_index=True)
                split = wanted.field("parts").to_numpy()[pick]
                place = np.minimum(np.searchsorted(known, values), len(known) - 1)
                keep = known[place] == values
                at, counts, values, parts = at[keep], counts[keep], values[keep], split[place[keep]]
                text = words.text_index()[at]
                doc, mark = (part.column(c).to_numpy()[text] for c in ("doc", "mark"))
                first = at - words.bounds[text]
                salt = mix(doc.view(np.uint64) + mix(mark.view(np.uint64) + first.astype(np.uint64))) % parts.astype(np.uint64)
                raw = words.data.tobytes()
                ends = words.ends[at + counts + how.words - 2]
                packed = [raw[lo:hi] for lo, hi in zip(words.starts[at].tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(values.view(np.int64)),
                        pa.array(salt.astype(np.int32)),
                        pa.array(parts.astype(np.int32)),
                        pa.array(doc),
                        pa.array(mark),
                        pa.array(first.astype(np.int32)),
                        pa.array(packed, pa.binary()),
                    ],
                    ["value", "part", "parts", "doc", "mark", "at", "packed"],
                )

    return run


def _count_windows(how: Windows):
    """Runs of windows that repeat in their bucket; of split buckets, also their distinct windows."""

    def work(groups: pa.RecordBatch) -> pa.RecordBatch | None:
        words = scan(groups.column("packed").cast(pa.large_binary()).view(pa.large_string()))
        hashes = words.hashes()
        text = words.text_index()
        n = len(hashes) - how.words + 1
        at = np.flatnonzero(text[:n] == text[how.words - 1 :])
        text = text[at]
        windows = np.empty(len(at), _WINDOW)
        windows["x"] = gram_hashes(hashes, how.words)[at]
        windows["y"] = gram_hashes(mix(~hashes), how.words)[at]
        windows["doc"] = groups.column("doc").to_numpy()[text]
        windows["mark"] = groups.column("mark").to_numpy()[text]
        windows["at"] = groups.column("at").to_numpy()[text] + at - words.bounds[text]
        order = np.lexsort((windows["y"], windows["x"]))
        same = _equal_before(windows[order])
        again = np.zeros(len(at), bool)
        again[order] = same | np.append(same[1:], False)
        doc, mark, first, last = _as_runs(windows[again], text[again])
        out = [pa.RecordBatch.from_arrays(
            [pa.array(doc), pa.array(mark), pa.array(first), pa.array(last)]
            + [pa.nulls(len(doc), kind) for kind in (pa.int64(), pa.int32(), pa.binary())],
            ["doc", "mark", "first", "last", "value", "piece", "windows"],
        )]
        parts = groups.column("parts").to_numpy()
        if (parts > 1).any():
            lead = order[~same]
            lead = lead[parts[text[lead]] > 1]
            out.append(_pieces(windows[lead], groups.column("value").to_numpy()[text[lead]], parts[text[lead]]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(map(len, out)) else None

    return work


def _pieces(windows: np.ndarray, values: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    piece = (windows["x"] % parts.astype(np.uint64)).astype(np.int32)
    order = np.lexsort((piece, values))
    values, piece, windows = values[order], piece[order], windows[order]
    cuts = np.flatnonzero(np.append(True, (values[1:] != values[:-1]) | (piece[1:] != piece[:-1])))
    packed = [windows[lo:hi].tobytes() for lo, hi in zip(cuts, np.append(cuts[1:], len(windows)))]
    empty = [pa.nulls(len(cuts), kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
    return pa.RecordBatch.from_arrays(
        [*empty, pa.array(values[cuts]), pa.array(piece[cuts]), pa.array(packed, pa.binary())],
        ["doc", "mark", "first", "last", "value", "piece", "windows"],
    )


def _count_across(groups: pa.RecordBatch) -> pa.RecordBatch | None:
    """Windows that several parts of a split bucket have sent."""
    packed = groups.column("windows")
    windows = np.concatenate([np.frombuffer(x.as_buffer(), _WINDOW) for x in packed])
    order = np.lexsort((windows["y"], windows["x"]))
    windows = windows[order]
    same = _equal_before(windows)
    found = windows[same | np.append(same[1:], False)]
    found = found[np.lexsort((found["at"], found["mark"], found["doc"]))]
    doc, mark, first, last = _as_runs(found, np.zeros(len(found), int))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(mark), pa.array(first), pa.array(last)], ["doc", "mark", "first", "last"]
    )


def _equal_before(windows: np.ndarray) -> np.ndarray:
    """Whether each of the sorted windows equals the one before it."""
    same = np.zeros(len(windows), bool)
    same[1:] = (windows["x"][1:] == windows["x"][:-1]) & (windows["y"][1:] == windows["y"][:-1])
    return same


def _as_runs(windows: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join windows that start at consecutive words of one string; they come in that order."""
    if not len(windows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    at = windows["at"]
    change = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
    change |= (windows["doc"][1:] != windows["doc"][:-1]) | (windows["mark"][1:] != windows["mark"][:-1])
    cuts = np.flatnonzero(np.append(True, change))
    ends = np.append(cuts[1:], len(windows)) - 1
    return windows["doc"][cuts].copy(), windows["mark"][cuts].copy(), at[cuts].copy(), at[ends].copy()


def _cut(how: Windows, untouched_as_is: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, spans = [], [], [], []
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                sizes.append(len(words))
                cover = np.zeros(len(words) + 1, np.int64)
                if runs.is_valid:
                    first = runs.values.field("first").to_numpy()
                    np.add.at(cover, first, 1)
                    np.add.at(cover, runs.values.field("last").to_numpy() + how.words, -1)
                    covered = cover.cumsum()[:-1] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
                    spans.append([{"first": int(a), "last": int(b) - 1} for a, b in edges.reshape(-1, 2)])
                    gone.append(int(covered.sum()))
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                else:
                    spans.append([])
                    gone.append(0)
                if text.is_valid and untouched_as_is and not gone[-1]:
                    kept.append(text.as_buffer().to_pybytes())
                else:
                    kept.append(b" ".join(words) if text.is_valid else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(sizes, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
                ],
                ["row", "text", "n_words", "n_removed", "removed"],
            )

    return run
