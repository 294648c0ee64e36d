"""Language of whole texts by unigram pieces, summed over all segmentations.

The vocabulary is fixed and public; per language, every piece has a probability. A word's
likelihood is the sum over all its segmentations into pieces, found by the forward algorithm; a
text's is the product over its words. Probabilities are fitted by expectation maximisation: the
expected piece counts of the training words under all their segmentations are summed by Spark, and
only the model, vocabulary x languages, comes to the driver. Probabilities are kept as logarithms, so
words of any length are summed whole. Long words are gone through in stretches, with the sums at the
last places of one carried into the next.

Words are lower-cased runs of letters and marks, so other characters have no say.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.grouped import hash_share, others, packed
from tallyframe.llm.wordscan import slices
from tallyframe.session import saved_table

UNDETERMINED = "und"
WORD_START = "▁"
_BETWEEN_WORDS = r"[^\p{L}\p{M}]+"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
# Letters that are in memory at a time as a lattice.
_CHUNK_LETTERS = 400_000
# Words repeat less in smaller slices, and larger ones need more memory.
SLICE_BYTES = 8 << 20


@dataclass(frozen=True)
class Training:
    """``rows``: about so many labelled documents per language are learned from, or all if there are
    fewer, those with the smallest hash of their id. ``word``: words of more letters are not learned from.
    ``floor``: added to each expected count; a character that no piece covers is a piece of its own kind."""

    rows: int = 2000
    rounds: int = 3
    word: int = 10_000
    floor: float = 0.02


def public_pieces(model_file: str) -> list[str]:
    """Normal pieces of a sentencepiece vocabulary, of which no upper-case letters are left out."""
    from sentencepiece import SentencePieceProcessor

    vocabulary = SentencePieceProcessor(model_file=model_file)
    every = range(vocabulary.get_piece_size())
    kinds = (vocabulary.is_control, vocabulary.is_unknown, vocabulary.is_byte, vocabulary.is_unused)
    pieces = [vocabulary.id_to_piece(i) for i in every if not any(kind(i) for kind in kinds)]
    return sorted({p for p in pieces if p == p.lower()})


@dataclass(frozen=True)
class Pieces:
    """The vocabulary with a hash table of all piece prefixes, to find the pieces inside words."""

    pieces: tuple[str, ...]

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @cached_property
    def _table(self) -> tuple[np.ndarray, ...]:
        number = {p: i for i, p in enumerate(self.pieces)}
        prefixes = sorted({p[:k] for p in number for k in range(1, len(p) + 1)})
        hashes = np.array([_text_hash(p) for p in prefixes], np.uint64)
        ids = np.array([number.get(p, -1) for p in prefixes], np.int32)
        order = np.argsort(hashes)
        hashes, ids = hashes[order], ids[order]
        # A slot per high bits of the hash; prefixes that find it taken go to a small sorted rest.
        slots = np.full(1 << 20, -1, np.int32)
        slots[(hashes >> np.uint64(44)).astype(np.int64)] = np.arange(len(hashes))
        placed = slots[(hashes >> np.uint64(44)).astype(np.int64)] == np.arange(len(hashes))
        rest = np.flatnonzero(~placed)
        return hashes, ids, slots, hashes[rest], rest

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash in the prefix table, -1 where it is no prefix."""
        known, _, slots, rest_hashes, rest = self._table
        row = slots[(hashes >> np.uint64(44)).astype(np.int64)]
        hit = (row >= 0) & (known[row] == hashes)
        row = np.where(hit, row, -1)
        if len(rest):
            missed = np.flatnonzero(~hit)
            at = np.minimum(np.searchsorted(rest_hashes, hashes[missed]), len(rest) - 1)
            row[missed] = np.where(rest_hashes[at] == hashes[missed], rest[at], -1)
        return row

    def lattice(self, words: Sequence[str]) -> Lattice:
        """All pieces inside the words, each after a word start."""
        letters = _letters(WORD_START + WORD_START.join(words)) if len(words) else _letters("")
        return self.among(letters, np.flatnonzero(letters == ord(WORD_START)))

    def among(self, letters: np.ndarray, begins: np.ndarray) -> Lattice:
        """All pieces inside the stretches of letters that start at ``begins``; a character without
        a piece is one of the unknown piece."""
        size = np.diff(np.append(begins, len(letters)))
        left = np.repeat(begins + size, size) - np.arange(len(letters))
        ids = self._table[1]
        codes = letters.astype(np.uint64) + np.uint64(1)
        at, h = np.arange(len(letters)), np.zeros(len(letters), np.uint64)
        froms, tos, found = [], [], []
        covered = np.zeros(len(letters), bool)
        for length in range(1, self.longest + 1):
            inside = left[at] >= length
            at, h = at[inside], _next_hash(h[inside], codes[at[inside] + length - 1])
            row = self.find(h)
            going = row >= 0
            at, h, row = at[going], h[going], row[going]
            piece = ids[row]
            whole = piece >= 0
            froms.append(at[whole])
            tos.append(at[whole] + length)
            found.append(piece[whole])
            if length == 1:
                covered[at[whole]] = True
            if not len(at):
                break
        alone = np.flatnonzero(~covered)
        froms, tos = np.concatenate([*froms, alone]), np.concatenate([*tos, alone + 1])
        found = np.concatenate([*found, np.full(len(alone), len(self.pieces), np.int32)])
        return Lattice(begins, size, froms, tos, found)


@dataclass(frozen=True)
class Lattice:
    """Edges (from, to, piece) between the character places of many words. Word w has the places
    begins[w] + w to begins[w] + w + size[w]: one more than it has characters."""

    begins: np.ndarray
    size: np.ndarray
    froms: np.ndarray
    tos: np.ndarray
    pieces: np.ndarray

    @cached_property
    def _steps(self) -> tuple[np.ndarray, ...]:
        word = np.searchsorted(self.begins, self.froms, side="right") - 1
        depth = self.tos - self.begins[word]
        order = np.lexsort((self.tos, depth))
        depth = depth[order]
        levels = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2)) if len(depth) else np.zeros(1, int)
        return self.froms[order] + word[order], self.tos[order] + word[order], self.pieces[order], levels

    @property
    def first(self) -> np.ndarray:
        return self.begins + np.arange(len(self.begins))

    @property
    def last(self) -> np.ndarray:
        return self.first + self.size

    def forward(self, log_chance: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each place's left side by language; ``log_chance`` is piece x language.
        ``known`` has that of the first places, if they are not the word's first (one word only)."""
        froms, tos, pieces, levels = self._steps
        alpha = np.full((int(self.size.sum()) + len(self.size), log_chance.shape[1]), -np.inf)
        start = 1
        if known is None:
            alpha[self.first] = 0
        else:
            start = len(known)
            alpha[:start] = known
        for lo, hi in zip(levels[start - 1 :], levels[start:]):
            if lo < hi:
                _log_add(alpha, tos[lo:hi], alpha[froms[lo:hi]] + log_chance[pieces[lo:hi]])
        return alpha

    def expected(self, log_chance: np.ndarray, counts: np.ndarray, n_pieces: int) -> np.ndarray:
        """Expected piece counts of words that occur ``counts`` times, under one language."""
        alpha = self.forward(log_chance[:, None])[:, 0]
        froms, tos, pieces, levels = self._steps
        word = np.searchsorted(self.last, tos)
        # The backward sums go by the letters that are left, so that all words end at once.
        left = self.last[word] - froms
        order = np.lexsort((froms, left))
        bounds = np.searchsorted(left[order], np.arange(1, int(left.max()) + 2)) if len(left) else np.zeros(1, int)
        beta = np.full((len(alpha), 1), -np.inf)
        beta[self.last] = 0
        for lo, hi in zip(bounds, bounds[1:]):
            some = order[lo:hi]
            if len(some):
                _log_add(beta, froms[some], beta[tos[some]] + log_chance[pieces[some], None])
        share = np.exp(alpha[froms] + log_chance[pieces] + beta[tos, 0] - alpha[self.last][word]) * counts[word]
        return np.bincount(pieces, share, minlength=n_pieces)


def _log_add(sums: np.ndarray, places: np.ndarray, terms: np.ndarray) -> None:
    """Set ``sums`` at each place to the log of the sum of its terms; equal places stand together."""
    cuts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    top = np.maximum.reduceat(terms, cuts)
    each = np.repeat(top, np.diff(np.append(cuts, len(places))), axis=0)
    sums[places[cuts]] = top + np.log(np.add.reduceat(np.exp(terms - each), cuts))


@dataclass(frozen=True)
class Model:
    pieces: Pieces
    languages: tuple[str, ...]
    chance: np.ndarray

    def word_scores(self, words: Sequence[str]) -> np.ndarray:
        """Log likelihood by language."""
        out = np.zeros((len(words), len(self.languages)))
        log_chance = np.log(self.chance)
        for some in _chunks(words):
            if len(some) == 1:
                out[some] = self._stretches(words[some[0]], log_chance)
            else:
                lattice = self.pieces.lattice([words[k] for k in some])
                out[some] = lattice.forward(log_chance)[lattice.last]
        return out

    def _stretches(self, word: str, log_chance: np.ndarray) -> np.ndarray:
        letters = _letters(WORD_START + word)
        known, at = np.zeros((1, len(self.languages))), 0
        while at < len(letters):
            lo, hi = at - len(known) + 1, min(at + _CHUNK_LETTERS, len(letters))
            # Places from lo to at are known; no piece from further left reaches beyond.
            lattice = self.pieces.among(letters[lo:hi], np.zeros(1, np.int64))
            known, at = lattice.forward(log_chance, known)[-self.pieces.longest :], hi
        return known[-1]


def train(docs: DataFrame, pieces: Sequence[str], label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", how: Training = Training()) -> Model:
    """Fit piece probabilities per label. Rows with a null id, text or label are left out; without
    any row the model knows no language."""
    vocabulary = Pieces(tuple(pieces))
    labelled = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    chosen = labelled.select(F.col(id_col).alias("doc"), F.col(label_col).cast("string").alias("label"))
    counts = saved_table(chosen.groupBy("label").agg(F.count("*").alias("n")), "language-counts")
    chosen = chosen.join(counts, "label").where(hash_share(F.col("doc")) * F.col("n") < how.rows).select("doc")
    chosen = saved_table(chosen.distinct(), "language-sample")
    texts = labelled.select(F.col(id_col).alias("doc"), F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    words = texts.join(chosen, "doc", "left_semi").mapInArrow(_label_words, "label string, word string, n long")
    words = words.where(F.length("word") <= how.word).groupBy("label", "word").agg(F.sum("n").alias("n"))
    words = saved_table(words, "language-words")
    languages = tuple(r[0] for r in words.select("label").distinct().orderBy("label").collect())

    n_pieces = len(pieces) + 1
    chance = np.full((n_pieces, len(languages)), 1 / n_pieces)
    # Shorter pieces start likelier, as the flat start would prefer few long pieces.
    lengths = np.array([len(p) for p in pieces] + [1])
    chance *= (0.25**lengths)[:, None] / (0.25**lengths).mean()
    chance[-1] = 1e-7
    for _ in range(how.rounds if languages else 0):
        model = Model(vocabulary, languages, chance)
        sums = words.mapInArrow(_expect(model), "language int, piece int, n double")
        rows = sums.groupBy("language", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((n_pieces, len(languages)), how.floor)
        np.add.at(counts, (rows["piece"].to_numpy(), rows["language"].to_numpy()), rows["n"].to_numpy())
        chance = counts / counts.sum(0)
    return Model(vocabulary, languages, chance)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, columns of these names being replaced, and its
    text only with ``keep_text``.

    The score is the probability of the language under equal priors. A text that is null or has no
    letters, or any text for a model without languages, is ``und`` with score 0.
    """
    carried = others(docs, text_col, "lang_pred", "score")
    rows = docs.select(packed(carried), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = np.array([*model.languages, UNDETERMINED], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                best, score = _predict(model, part.column("text"))
                found = [pa.array(names[best], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), *found], [*passed, "lang_pred", "score"])

    passed = ["row", "text"] if keep_text else ["row"]
    row = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(run, f"row {row}, {'text string, ' if keep_text else ''}lang_pred string, score double")
    columns = [c for c in docs.columns if c in carried or (keep_text and c == text_col)]
    values = {c: F.col("row")[c] for c in carried} | {text_col: F.col("text")}
    return out.select(*[values[c].alias(c) for c in columns], "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the ids, by checksum. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def _predict(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    n = len(model.languages)
    best, score = np.full(len(texts), n), np.zeros(len(texts))
    words, bounds = _words(texts)
    if not n or not len(words):
        return best, score
    coded = words.dictionary_encode()
    scores = model.word_scores(coded.dictionary.to_pylist())
    rows = np.flatnonzero(np.diff(bounds))
    total = np.add.reduceat(scores[coded.indices.to_numpy()], bounds[rows])
    best[rows] = total.argmax(1)
    score[rows] = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return best, score


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where those of each text begin."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), _BETWEEN_WORDS)
    words = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    keep = pc.not_equal(words, "")
    kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    return words.filter(keep), kept[bounds]


def _label_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            words, bounds = _words(part.column("text"))
            labels = part.column("label").take(pa.array(np.repeat(np.arange(part.num_rows), np.diff(bounds))))
            counted = pa.table({"label": labels, "word": words.cast(pa.string())}).group_by(["label", "word"]).aggregate([([], "count_all")])
            yield from counted.rename_columns(["label", "word", "n"]).to_batches()


def _expect(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, log_chance = len(model.chance), np.log(model.chance)
        sums = np.zeros((len(model.languages), n))
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), object)
            counts = batch.column("n").to_numpy()
            words = np.array(batch.column("word").to_pylist(), object)
            for number, name in enumerate(model.languages):
                own = np.flatnonzero(labels == name)
                for some in _chunks(words[own]):
                    lattice = model.pieces.lattice(words[own[some]].tolist())
                    sums[number] += lattice.expected(log_chance[:, number], counts[own[some]], n)
        language, piece = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(language.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(sums[language, piece])],
            ["language", "piece", "n"],
        )

    return run


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _chunks(words: Sequence[str]) -> list[np.ndarray]:
    """Numbers of the words, in chunks of about so many letters; a longer word is alone."""
    size = np.array([len(w) + 1 for w in words], np.int64)
    long = size > _CHUNK_LETTERS // 8
    # Words of like length share their levels.
    short = np.flatnonzero(~long)
    short = short[np.argsort(size[short], kind="stable")]
    part = np.cumsum(size[short]) // _CHUNK_LETTERS
    chunks = np.split(short, np.flatnonzero(np.diff(part)) + 1) if len(short) else []
    return [*chunks, *([k] for k in np.flatnonzero(long))]


def _next_hash(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ code) * _FACTOR
    return h ^ (h >> np.uint64(29))


def _text_hash(text: str) -> int:
    h = np.zeros(1, np.uint64)
    for letter in text:
        h = _next_hash(h, np.array([ord(letter) + 1], np.uint64))
    return int(h[0])
