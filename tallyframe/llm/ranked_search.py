"""Ranked lexical search: an inverted index in shards and Block-Max MaxScore in each of them.

A shard holds the documents of about ``SHARD_BYTES`` of text, in the order in which a task reads
them, so that indexing shuffles nothing. For every term it has the list of its documents, in blocks of
``BLOCK`` postings; a block says which document is its last, its highest frequency and its shortest
document, and packs the gaps between documents and the frequencies in one, two or four bytes each.
Nothing in the index depends on statistics of the whole corpus, so that shards can be added.

A search reads the lists of its terms only and deals them out by shard. In a shard, the lists with the
highest bounds are read first and add to the documents' scores, until the bounds of all other lists
together stay below the k-th score: those lists are not essential. Of the documents found so far, those
that cannot reach that score by the maxima of the very blocks that they would be in are rejected, and
only blocks that hold a survivor are decompressed. The k best of each shard then meet in one window per
item, of which every task sends k rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm.grouped import map_groups
from tallyframe.llm.wordscan import SLICE_BYTES, Words, scan, slices, text_bytes
from tallyframe.session import saved_table

SHARD_BYTES = 16 << 20
BLOCK = 64
# Terms of the items that are searched at once; they are sent to all tasks. More go in further rounds.
TERMS_AT_ONCE = 200_000
# Scores: impacts of a frequency are (SCALE * tf) div (1000 * tf + 8 * m).
_SCALE, _TF, _LENGTH = 1_000_000_000, 1000, 8

# Separators become spaces, A-Z lower case; ASCII digits, letters and all bytes of other characters stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20
_FOLD[0x41:0x5B] += 0x20

_BLOCKS = np.dtype([("last", "<i4"), ("most", "<i4"), ("least", "<i4"), ("at", "<i4"), ("gap", "u1"), ("tf", "u1")])
_DOCS = np.dtype([("id", "<i8"), ("n", "<i8"), ("null", "u1")])
_INDEX = "shard long, term long, n_docs long, n_terms long, blocks binary, postings binary"
_INDEX_ARROW = pa.schema(
    [("shard", pa.int64()), ("term", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
     ("blocks", pa.binary()), ("postings", pa.binary())]
)


def terms_of(texts: pa.Array) -> Words:
    """The terms of texts: maximal runs of ASCII letters and digits and of all characters beyond ASCII,
    A-Z folded. A null has none."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    folded = _FOLD[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    return scan(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, pa.py_buffer(folded)], offset=texts.offset))


@dataclass(frozen=True)
class Index:
    """The shards' lists, one row a term, and one without a term for the shard's documents."""

    rows: DataFrame

    def counts(self) -> tuple[int, int, int]:
        """Documents that hold a term, terms with repeats, shards."""
        whole = self.rows.where("term IS NULL").agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
        return whole[0] or 0, whole[1] or 0, whole[2]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index every whole text. Rows are documents of their own, also if their ids are equal or null.

    Terms are told apart by 64-bit hashes: among a billion terms the chance that one is taken for
    another that is searched is below one in ten million per searched term.
    """

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", min(SLICE_BYTES, shard_bytes)):
                shard.add(part)
                if shard.bytes >= shard_bytes:
                    yield from shard.rows(number)
                    shard, number = _Shard(), number + 1
        yield from shard.rows(number)

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return Index(saved_table(slim.mapInArrow(indexed, _INDEX), "search-index"))


class _Shard:
    """Postings of the documents that a task has read since the last shard."""

    def __init__(self):
        self.bytes = self.n_docs = 0
        self.docs: list[np.ndarray] = []
        self.postings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        self.bytes += int(text_bytes(batch.column("text")).sum())
        words = terms_of(batch.column("text"))
        lengths = np.diff(words.bounds)
        held = np.flatnonzero(lengths)
        if not len(held):
            return
        ids = batch.column("id")
        docs = np.zeros(len(held), _DOCS)
        docs["id"] = ids.fill_null(0).to_numpy()[held]
        docs["null"] = ids.is_null().to_numpy(zero_copy_only=False)[held]
        docs["n"] = lengths[held]
        terms, place = np.unique(words.hashes(), return_inverse=True)
        doc = np.repeat(np.arange(len(held), dtype=np.int64), lengths[held])
        pairs, tf = np.unique(doc * len(terms) + place, return_counts=True)
        local = pairs // len(terms)
        self.postings.append((terms[pairs - local * len(terms)], (local + self.n_docs).astype(np.int32), tf.astype(np.int32)))
        self.docs.append(docs)
        self.n_docs += len(held)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, _DOCS)
        if not len(docs):
            return
        table = [pa.array([v], t) for v, t in zip((number, None, len(docs), int(docs["n"].sum()), docs.tobytes(), b""), _INDEX_ARROW.types)]
        yield pa.RecordBatch.from_arrays(table, schema=_INDEX_ARROW)
        term, doc, tf = (np.concatenate(parts) for parts in zip(*self.postings))
        order = np.argsort(term, kind="stable")
        yield from _packed_lists(number, term[order], doc[order], tf[order], docs["n"])


def _packed_lists(number: int, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Index rows of postings sorted by term and document."""
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    count = np.diff(np.r_[first, len(term)])
    in_list = np.arange(len(term)) - np.repeat(first, count)
    before = np.where(in_list == 0, -1, np.r_[np.int32(-1), doc[:-1]])
    gap = doc - before
    start = np.flatnonzero(in_list % BLOCK == 0)
    size = np.diff(np.r_[start, len(term)])
    block = np.repeat(np.arange(len(start)), size)
    inside = np.arange(len(term)) - np.repeat(start, size)

    def width(values: np.ndarray) -> np.ndarray:
        return np.where(values < 1 << 8, 1, np.where(values < 1 << 16, 2, 4))

    most = np.maximum.reduceat(tf, start)
    gap_width, tf_width = width(np.maximum.reduceat(gap, start)), width(most)
    ends = np.cumsum(size * (gap_width + tf_width))
    begins = np.r_[0, ends[:-1]]
    data = np.zeros(int(ends[-1]), np.uint8)
    _put(data, begins[block], inside, gap_width[block], gap)
    _put(data, (begins + size * gap_width)[block], inside, tf_width[block], tf)

    n_blocks = -(-count // BLOCK)
    upto = np.cumsum(n_blocks)
    from_block = upto - n_blocks
    blocks = np.zeros(len(start), _BLOCKS)
    blocks["last"] = doc[start + size - 1]
    blocks["most"] = most
    blocks["least"] = np.minimum.reduceat(lengths[doc], start)
    blocks["at"] = begins - np.repeat(begins[from_block], n_blocks)
    blocks["gap"], blocks["tf"] = gap_width, tf_width

    def column(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)])

    rows = pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(first), number)),
            pa.array(term[first].view(np.int64)),
            pa.array(count.astype(np.int64)),
            pa.array(np.add.reduceat(tf.astype(np.int64), first)),
            column(blocks.view(np.uint8), np.r_[0, upto] * _BLOCKS.itemsize),
            column(data, np.r_[begins[from_block], len(data)]),
        ],
        schema=_INDEX_ARROW,
    )
    for at in range(0, rows.num_rows, 20_000):
        yield rows.slice(at, 20_000)


def _put(data: np.ndarray, begin: np.ndarray, place: np.ndarray, width: np.ndarray, values: np.ndarray) -> None:
    """Write little-endian numbers of the given widths."""
    at = begin + place * width
    for byte in range(4):
        wide = slice(None) if byte == 0 else np.flatnonzero(width > byte)
        data[at[wide] + byte] = (values[wide] >> (8 * byte)) & 255


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of every item: the item's id, ``rank`` from 1, ``doc_id`` and ``score``.

    With N documents that hold a term, L terms in them with repeats, n terms in one document, df
    documents holding a term and tf of it in one, a term weighs floor(1000 ln((2N+2)/(2df+1))), a
    document's m is 10 + (90 n N) div L, and its score sums weight * ((10^9 tf) div (1000 tf + 8 m))
    over the item's terms, once each. Only scores above 0 count; equal ones go by ascending id, nulls
    last. Items of equal id and text are one item. Items without terms have no rows. Item ids that
    are no integers become null.
    """
    distinct = items.select(F.col(id_col).try_cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    kinds = "key long, item long, terms array<long>"
    asked = saved_table(distinct.select(F.monotonically_increasing_id().alias("key"), "item", "text").mapInArrow(_asked, kinds), "search-items")
    n_docs, n_terms, shards = index.counts()
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    rounds = -(-total // TERMS_AT_ONCE)
    found = asked.sparkSession.createDataFrame([], _FOUND)
    if n_docs:
        for number in range(rounds):
            some = asked.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == number)
            found = found.unionByName(_round(index, some, n_docs, n_terms, shards, k))
    best = W.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(id_col), "rank", "doc_id", "score")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = terms_of(batch.column("text"))
        hashes = words.hashes().view(np.int64)
        lists = [np.unique(hashes[lo:hi]) for lo, hi in zip(words.bounds, words.bounds[1:])]
        terms = pa.array(lists, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("item"), terms], names=["key", "item", "terms"])


_FOUND = "key long, item long, doc_id long, score long"


def _round(index: Index, asked: DataFrame, n_docs: int, n_terms: int, shards: int, k: int) -> DataFrame:
    """The k best of every shard for a bounded number of items, which all tasks get."""
    wanted = asked.select(F.explode("terms").alias("wanted")).distinct()
    # A null stands for the row of the shard's documents.
    wanted = wanted.union(asked.sparkSession.range(1).select(F.lit(None).cast("long")))
    lists = index.rows.join(F.broadcast(wanted), F.col("term").eqNullSafe(F.col("wanted")), "left_semi")
    df = {r["term"]: r["df"] for r in lists.where("term IS NOT NULL").groupBy("term").agg(F.sum("n_docs").alias("df")).collect()}
    weight = {term: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for term, n in df.items()}
    queries = [
        (row["key"], row["item"], [(term, weight[term]) for term in row["terms"] if weight.get(term, 0) > 0])
        for row in asked.collect()
    ]
    find = _Searcher([q for q in queries if q[2]], n_docs, n_terms, k)
    # Few bytes make much work here, so that the number of tasks follows the shards.
    return map_groups(lists, ["shard"], find, _FOUND, partitions=min(-(-shards // 2), 8192))


class _Searcher:
    """Finds the best documents of a shard. The k-th score that a task has seen goes along from one
    of its shards to the next, as no worse document can be among the best."""

    def __init__(self, queries: list[tuple], n_docs: int, n_terms: int, k: int):
        self.queries, self.n_docs, self.n_terms, self.k = queries, n_docs, n_terms, k
        self.best: dict[int, np.ndarray] = {}
        #: Blocks decompressed and blocks passed by, for tests.
        self.opened = self.passed = 0

    def measure(self, lengths: np.ndarray) -> np.ndarray:
        """m of document lengths, exactly, also where the product needs more than 64 bits."""
        if len(lengths) and 90 * int(lengths.max()) * self.n_docs < 1 << 62:
            return 10 + 90 * lengths.astype(np.int64) * self.n_docs // self.n_terms
        return np.array([10 + 90 * int(n) * self.n_docs // self.n_terms for n in lengths], np.int64)

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        terms = batch.column("term").to_pylist()
        blocks, postings = batch.column("blocks"), batch.column("postings")
        at = {term: row for row, term in enumerate(terms)}
        docs = np.frombuffer(blocks[at.pop(None)].as_py(), _DOCS)
        m = self.measure(docs["n"])
        lists = {t: _List(blocks[r].as_py(), postings[r].as_py(), m, self) for t, r in at.items()}
        out = []
        for key, item, weighted in self.queries:
            held = [(lists[t], w) for t, w in weighted if t in lists]
            if held:
                rows, scores = self._top(key, held, docs)
                out += [(key, item, None if docs["null"][d] else int(docs["id"][d]), int(s)) for d, s in zip(rows, scores)]
        self.opened += sum(len(one.open) for one in lists.values())
        self.passed += sum(len(one.blocks) - len(one.open) for one in lists.values())
        if not out:
            return None
        columns = [pa.array(c, pa.int64()) for c in zip(*out)]
        return pa.RecordBatch.from_arrays(columns, names=["key", "item", "doc_id", "score"])

    def _top(self, key: int, held: list[tuple[_List, int]], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = sorted(held, key=lambda x: -x[1] * x[0].bound)
        bounds = [w * one.bound for one, w in held]
        left = sum(bounds)
        scores = np.zeros(len(docs), np.int64)
        floor = self._floor(key, scores[:0])
        essential = 0
        while essential < len(held) and (left >= floor or floor == 0):
            one, weight = held[essential]
            where, impact = one.all()
            scores[where] += weight * impact
            left -= bounds[essential]
            essential += 1
            floor = self._floor(key, scores)
        found = np.flatnonzero(scores + left >= max(floor, 1)) if essential else np.zeros(0, np.int64)
        # Without a score yet a document is in no essential list, and cannot reach the floor by others.
        found = found[scores[found] > 0]
        found = self._complete(key, found, scores, held[essential:], floor)
        picked = found[np.lexsort((docs["id"][found], docs["null"][found], -scores[found]))[: self.k]]
        known = np.r_[self.best.get(key, np.zeros(0, np.int64)), scores[picked]]
        self.best[key] = -np.sort(-known)[: self.k]
        return picked, scores[picked]

    def _complete(self, key: int, found: np.ndarray, scores: np.ndarray, others: list[tuple[_List, int]], floor: int) -> np.ndarray:
        """Add what the lists that are not essential give to documents that may still be among the best."""
        places = [one.place(found) for one, _ in others]
        tops = [w * one.tops[p] for (one, w), p in zip(others, places)]
        rest = np.sum(tops, axis=0) if tops else np.zeros(len(found), np.int64)
        for number, (one, weight) in enumerate(others):
            stay = scores[found] + rest >= floor
            if not stay.all():
                found, rest = found[stay], rest[stay]
                tops, places = [t[stay] for t in tops], [p[stay] for p in places]
            scores[found] += weight * one.impacts(found, places[number])
            rest = rest - tops[number]
            floor = max(floor, self._floor(key, scores[found]))
        return found[scores[found] >= max(floor, 1)]

    def _floor(self, key: int, scores: np.ndarray) -> int:
        """The k-th best score known; 0 with fewer."""
        known = self.best.get(key)
        floor = int(known[-1]) if known is not None and len(known) == self.k else 0
        if len(scores) >= self.k:
            floor = max(floor, int(np.partition(scores, len(scores) - self.k)[len(scores) - self.k]))
        return floor


class _List:
    """A term's list in a shard. Blocks are decompressed when first asked for."""

    def __init__(self, blocks: bytes, postings: bytes, m: np.ndarray, searcher: _Searcher):
        self.blocks = np.frombuffer(blocks, _BLOCKS)
        self.postings, self.m = postings, m
        most, least = self.blocks["most"].astype(np.int64), searcher.measure(self.blocks["least"])
        # The last entry stands for documents behind the list's end.
        self.tops = np.r_[(_SCALE * most) // (_TF * most + _LENGTH * least), 0]
        self.bound = int(self.tops.max())
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.whole: tuple[np.ndarray, np.ndarray] | None = None

    def block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if number not in self.open:
            head = self.blocks[number]
            at, gap, tf = int(head["at"]), int(head["gap"]), int(head["tf"])
            end = int(self.blocks["at"][number + 1]) if number + 1 < len(self.blocks) else len(self.postings)
            size = (end - at) // (gap + tf)
            before = int(self.blocks["last"][number - 1]) if number else -1
            docs = before + np.cumsum(np.frombuffer(self.postings, f"<u{gap}", size, at), dtype=np.int64)
            often = np.frombuffer(self.postings, f"<u{tf}", size, at + size * gap).astype(np.int64)
            self.open[number] = docs, (_SCALE * often) // (_TF * often + _LENGTH * self.m[docs])
        return self.open[number]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if self.whole is None:
            parts = [self.block(b) for b in range(len(self.blocks))]
            self.whole = tuple(np.concatenate(p) for p in zip(*parts))
        return self.whole

    def place(self, docs: np.ndarray) -> np.ndarray:
        """The block that each document would be in."""
        return np.searchsorted(self.blocks["last"], docs)

    def impacts(self, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The term's impact on each of some sorted documents, 0 where it does not occur."""
        out = np.zeros(len(docs), np.int64)
        if not len(docs):
            return out
        cuts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(docs)]):
            if places[lo] == len(self.blocks):
                continue
            held, impact = self.block(int(places[lo]))
            at = np.searchsorted(held, docs[lo:hi])
            at[at == len(held)] = 0
            out[lo:hi] = np.where(held[at] == docs[lo:hi], impact[at], 0)
        return out
