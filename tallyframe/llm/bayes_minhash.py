"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact verification.

1. Every document becomes a set of 64-bit hashes of its five-word shingles, of which a size, an
   order-free 128-bit key and a MinHash signature are kept. Equal sets collapse to one
   representative before any candidates are made.
2. Bands of the signatures deal representatives into buckets.
3. Candidates are compared signature batch by signature batch. With m of n values equal, Jaccard
   has the posterior Beta(m + 1, n - m + 1) under a flat prior; a pair is dropped as soon as the
   probability of reaching the threshold falls under ``miss`` (Satuluri and Parthasarathy 2012).
4. Survivors are verified on their full shingle sets.

Candidates come in two rounds, so that a bucket of many copies does not become all its pairs: first
each member with the smallest of its bucket; then, where a bucket still spans several components,
blocks of its members against each other, inside tasks. The second round verifies every surviving
pair that crosses components in the first band that the pair shares, and sends on only the links
of a spanning forest. No candidate link between components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.components import components
from tallyframe.llm.grouped import in_blocks, map_groups, named_texts
from tallyframe.llm.wordscan import gram_hashes, mix, scan, slices
from tallyframe.session import saved_table


@dataclass(frozen=True)
class MinHashing:
    """``percent``: linked from this Jaccard on. A true link at it is missed by all bands with
    probability (1 - p ** rows) ** bands, about 5e-6, and pruned with ``miss`` per batch."""

    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    batch: int = 32
    miss: float = 1e-5
    block: int = 2048
    seed: int = 7

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def least_matches(self) -> np.ndarray:
        """After each batch, the fewest equal values with which a pair may still be a link."""
        t = self.percent / 100
        out = []
        for n in range(self.batch, self.size + 1, self.batch):
            tail, m = 0.0, -1
            while tail < self.miss:
                m += 1
                # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
                tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append(m)
        return np.array(out)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: MinHashing = MinHashing()) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    A-Z is folded; a text of fewer than five words has its whole word sequence as its one shingle;
    a null, empty or blank text has none and links with nothing. Texts are compared whatever their
    ids; rows of one id are one document, which has the links of all its texts. Rows with a null id
    come back with a null component and kept = true.
    """
    profiles, classes, links = _classes(docs, id_col, text_col, how)
    linkable = profiles.where(_LINKABLE).select("doc", *_SET)
    members = saved_table(linkable.join(classes.select("rep", *_SET), _SET).select("doc", "rep"), "minhash-members")
    # An id with several texts links their classes.
    several = members.groupBy("doc").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
    several = saved_table(several.where("least < most").select("doc", "least"), "minhash-several")
    same = members.join(several, "doc").where("rep <> least").select("rep", "least").distinct()

    parts = _parts(classes, links.union(same))
    named = parts.select("rep", "part").join(_firsts(parts), "part").select("rep", F.col("first.doc").alias("component_id"))
    # All classes of an id are in one part.
    moved = members.join(named, "rep").where("component_id <> doc").select("doc", "component_id").distinct()
    out = profiles.select("id", "n_shingles").join(saved_table(moved, "minhash-moved"), F.col("id") == F.col("doc"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: MinHashing = MinHashing()) -> DataFrame:
    """The texts (doc, mark) of ``named_texts`` that stay: of texts which links connect, the one with
    the smallest id, null ids last; every text without words. Unlike texts stay although they share
    an id."""
    profiles, classes, links = _classes(docs, id_col, text_col, how, nameless=True)
    firsts = _firsts(_parts(classes, links)).select("first.doc", "first.mark")
    bare = profiles.where("n_shingles = 0").select("doc", "mark")
    return firsts.union(bare.distinct())


_SET = ["n_shingles", "key_a", "key_b"]
_LINKABLE = "n_shingles > 0 and id is not null"


def _classes(
    docs: DataFrame, id_col: str, text_col: str, how: MinHashing, nameless: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of all rows, classes of equal sets, and the verified links (a, b) between classes; rows
    without an id are in classes only if ``nameless``.

    A class has a number ``rep`` and the smallest (doc, mark) of its texts as ``first``, which
    represents it.
    """
    rows = named_texts(docs, id_col, text_col)
    profiles = saved_table(_profiles(rows, how), "minhash-profiles")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "doc", "mark"))
    linkable = profiles.where("n_shingles > 0" if nameless else _LINKABLE)
    seen = linkable.groupBy(*_SET).agg(first.alias("first"), F.first("signature").alias("signature"))
    # Written once: the numbers stay, and joins can split a class of very many copies.
    classes = saved_table(seen.withColumn("rep", F.monotonically_increasing_id()), "minhash-classes")
    return profiles, classes, _links(classes, rows, how)


def _parts(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rep, first, part) of all classes; edges connect the classes of a part."""
    joined = classes.select("rep", "first").join(components(edges), F.col("rep") == F.col("node"), "left")
    return saved_table(joined.select("rep", "first", F.coalesce("component", "rep").alias("part")), "minhash-parts")


def _firsts(parts: DataFrame) -> DataFrame:
    """(part, first): the smallest (doc, mark) of each part."""
    return saved_table(parts.groupBy("part").agg(F.min("first").alias("first")), "minhash-firsts")


def _links(classes: DataFrame, rows: DataFrame, how: MinHashing) -> DataFrame:
    """Verified links (a, b) that connect all representatives which candidate links connect."""
    signatures = classes.select("rep", "signature")
    buckets = _buckets(signatures, how)
    wanted = classes.select("rep", "first.doc", "first.mark").join(buckets.select("rep").distinct(), "rep", "left_semi")
    sets = _sets(rows, wanted, how)
    star = buckets.where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
    links = _verified(star, signatures, sets, how)

    found = components(links)
    labelled = buckets.join(found, F.col("rep") == F.col("node"), "left").select(
        "bucket", "band", "rep", F.coalesce("component", "rep").alias("part")
    )
    spread = labelled.groupBy("bucket").agg(F.count("*").alias("n"), F.min("part").alias("p"), F.max("part").alias("q"))
    spread = saved_table(spread.where("p < q").select("bucket", "n"), "minhash-spread")
    blocks = in_blocks(labelled, spread, ["bucket"], "rep", how.block).join(signatures, "rep")
    keys = ["bucket", "lo", "hi"]
    kind = "bucket long, lo int, hi int, block int, band int, rep long, part long"
    open_ = saved_table(map_groups(blocks, keys, _with_survivors(how), kind), "minhash-open")
    full = open_.join(signatures, "rep").join(sets, "rep")
    crossing = map_groups(full, keys, _crossing_links(how), "a long, b long")
    return links.union(saved_table(crossing, "minhash-crossing"))


def _profiles(rows: DataFrame, how: MinHashing) -> DataFrame:
    shape = (how.size, 1)
    draw = np.random.default_rng(how.seed)
    flip = draw.integers(0, 1 << 32, shape, np.uint32)
    factor = draw.integers(0, 1 << 32, shape, np.uint32) | np.uint32(1)

    def signature(shingles: np.ndarray) -> bytes:
        least = np.full(how.size, 0xFFFFFFFF, np.uint32)
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 4096):
            np.minimum(least, ((short[None, at : at + 4096] ^ flip) * factor).min(1), out=least)
        return least.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, keys_a, keys_b, marks = [], [], [], []
                for shingles in _shingle_sets(part.column("text"), how.words):
                    sizes.append(len(shingles))
                    keys_a.append(int(mix(shingles).sum(dtype=np.uint64)))
                    keys_b.append(int(mix(~shingles).sum(dtype=np.uint64)))
                    marks.append(signature(shingles))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("doc"),
                        part.column("mark"),
                        pa.array(sizes, pa.int64()),
                        pa.array(np.array(keys_a, np.uint64).view(np.int64)),
                        pa.array(np.array(keys_b, np.uint64).view(np.int64)),
                        pa.array(marks, pa.binary()),
                    ],
                    ["id", "doc", "mark", "n_shingles", "key_a", "key_b", "signature"],
                )

    return rows.mapInArrow(run, "id long, doc long, mark long, n_shingles long, key_a long, key_b long, signature binary")


def _shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    found = scan(texts)
    hashes = found.hashes(lower=True)
    grams = gram_hashes(hashes, words)
    for lo, hi in zip(found.bounds, found.bounds[1:]):
        if hi - lo >= words:
            ordered = np.sort(grams[lo : hi - words + 1])
            yield ordered[np.append(True, ordered[1:] != ordered[:-1])]
        else:
            yield gram_hashes(hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64)


def _buckets(signatures: DataFrame, how: MinHashing) -> DataFrame:
    """(bucket, band, rep, least) of all buckets with several members; least is the smallest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _matrix(batch.column("signature"), how).astype(np.uint64)
            keys = np.empty((len(marks), how.bands), np.uint64)
            for band in range(how.bands):
                h = np.full(len(marks), band + 1, np.uint64)
                for row in range(how.rows):
                    h = mix(h ^ marks[:, band * how.rows + row])
                keys[:, band] = h
            reps = batch.column("rep").to_numpy()
            band = np.tile(np.arange(how.bands, dtype=np.int32), len(reps))
            columns = [pa.array(keys.ravel().view(np.int64)), pa.array(band), pa.array(np.repeat(reps, how.bands))]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "band", "rep"])

    dealt = signatures.select("rep", "signature").mapInArrow(run, "bucket long, band int, rep long")
    shared = dealt.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most"))
    shared = shared.where("least < most").select("bucket", "least")
    return saved_table(dealt.join(shared, "bucket"), "minhash-buckets")


def _matrix(signatures: pa.Array, how: MinHashing) -> np.ndarray:
    joined = b"".join(signatures.to_pylist())
    return np.frombuffer(joined, np.uint32).reshape(-1, how.size)


def _survivors(left: np.ndarray, right: np.ndarray, how: MinHashing) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the paired signatures that no batch prunes, and their equal values."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), int)
    for k, least in enumerate(how.least_matches()):
        cut = slice(k * how.batch, (k + 1) * how.batch)
        equal = equal + (left[alive, cut] == right[alive, cut]).sum(1)
        stay = equal >= least
        alive, equal = alive[stay], equal[stay]
    return alive, equal


def _pairs_across(group: pa.RecordBatch, how: MinHashing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Surviving pairs of a block pair that cross components and share no earlier band."""
    block, part, band = (group.column(c).to_numpy() for c in ("block", "part", "band"))
    marks = _matrix(group.column("signature"), how)
    bands = marks.reshape(len(marks), how.bands, how.rows)
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    first, second = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    found = [np.zeros((3, 0), int)]
    for i in first:
        other = second[part[second] != part[i]]
        if lo == hi:
            other = other[other > i]
        kept, equal = _survivors(marks[np.full(len(other), i)], marks[other], how)
        other = other[kept]
        earlier = (bands[other, : band[i]] == bands[i, : band[i]]).all(2).any(1)
        found.append(np.stack([np.full(len(other), i), other, equal])[:, ~earlier])
    i, j, equal = np.concatenate(found, axis=1)
    return i, j, equal


def _with_survivors(how: MinHashing):
    def work(group: pa.RecordBatch) -> pa.RecordBatch | None:
        i, j, _ = _pairs_across(group, how)
        rows = group.take(pa.array(np.unique(np.concatenate([i, j]))))
        return rows.select(["bucket", "lo", "hi", "block", "band", "rep", "part"])

    return work


def _crossing_links(how: MinHashing):
    """A spanning forest of the verified links across components, likeliest pairs first."""

    def work(group: pa.RecordBatch) -> pa.RecordBatch | None:
        i, j, equal = _pairs_across(group, how)
        reps, part = group.column("rep").to_numpy(), group.column("part").to_numpy().tolist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        keep = []
        for k in np.argsort(-equal, kind="stable"):
            p, q = find(part[i[k]]), find(part[j[k]])
            if p != q and _linked(sets[i[k]], sets[j[k]], how):
                root[p] = q
                keep.append(k)
        a, b = reps[i[keep]], reps[j[keep]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return work


def _linked(x: np.ndarray, y: np.ndarray, how: MinHashing) -> bool:
    """The exact test on sorted full sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < how.percent * len(y):
        return False
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * shared >= how.percent * (len(x) + len(y) - shared)


def _sets(rows: DataFrame, wanted: DataFrame, how: MinHashing) -> DataFrame:
    """(rep, shingles): the full shingle sets of the wanted texts (doc, mark, rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                packed = [s.tobytes() for s in _shingle_sets(part.column("text"), how.words)]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(packed, pa.binary())], ["rep", "shingles"])

    # The wanted texts grow with the input: a sort-merge join at every size.
    texts = rows.join(wanted.hint("merge"), ["doc", "mark"]).select("rep", "text")
    sets = texts.mapInArrow(run, "rep long, shingles binary")
    # Rows of one text repeat its set.
    return saved_table(sets.dropDuplicates(["rep"]), "minhash-sets")


def _verified(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, how: MinHashing) -> DataFrame:
    """Those of the candidate pairs (a, b) that are links."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive, _ = _survivors(_matrix(batch.column("mark_a"), how), _matrix(batch.column("mark_b"), how), how)
            yield batch.select(["a", "b"]).take(pa.array(alive))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("set_a"), batch.column("set_b"))
            linked = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), how) for x, y in sides]
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    marked = _with_both(pairs, signatures, "signature", "mark")
    alive = saved_table(marked.mapInArrow(prune, "a long, b long"), "minhash-alive")
    return saved_table(_with_both(alive, sets, "shingles", "set").mapInArrow(verify, "a long, b long"), "minhash-links")


def _with_both(pairs: DataFrame, values: DataFrame, column: str, name: str) -> DataFrame:
    """Join a value to both ends of each pair."""
    for end in ("a", "b"):
        side = values.select(F.col("rep").alias(end), F.col(column).alias(f"{name}_{end}"))
        pairs = pairs.join(side, end)
    return pairs.select("a", "b", f"{name}_a", f"{name}_b")
