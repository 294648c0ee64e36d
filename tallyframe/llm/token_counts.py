"""Token counts of whole texts, huge ones in overlapping chunks that are spliced.

A text longer than a chunk is encoded in chunks that overlap. Two neighbours are spliced at a white
space in the overlap. That place is stable: no pre-token of the supported tokenizers crosses white
space, white space does not compose with what follows, and no special string contains it, so the
tokens before it do not depend on the text after it, nor the other way round. The tokens of both
chunks are also compared from there to the last white space of the overlap. Without such a place,
or where the tokens differ, the overlap is doubled, up to the whole rest of the text.

A text of one chunk needs no splice. By the same stability its tokens are those of its pieces
between white space, and a piece that many texts have is encoded once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.grouped import others, packed
from tallyframe.llm.wordscan import slices, text_bytes

# Below U+0250 every character is its own NFC form, and lower-casing does not depend on context.
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
# Pieces remembered by a task; beyond, it starts afresh.
_KNOWN_PIECES = 400_000
_SPACE = re.compile(r"[ \t-\r]")


@dataclass(frozen=True)
class Chunking:
    """Lengths in characters. Texts of up to ``chunk`` characters are encoded in one piece."""

    chunk: int = 16_384
    overlap: int = 256


def tokenizer_json(path: str) -> str:
    """The tokenizer file, of a fixed size, as text that travels with the job."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", how: Chunking = Chunking()) -> DataFrame:
    """``docs`` without its text, with ``n_bytes``, ``n_tokens`` and ``n_chunks``; columns of these
    names are replaced.

    ``tokenizer`` is the JSON of a tokenizer whose pre-tokens do not cross white space. A null text
    counts as empty: 0 bytes, 0 tokens.
    """
    carried = others(docs, text_col, "n_bytes", "n_tokens", "n_chunks")
    rows = docs.select(packed(carried), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(shared.value)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                counts, chunks = _count(encoder, part.column("text").to_pylist(), how)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(text_bytes(part.column("text"))), pa.array(counts, pa.int64()), pa.array(chunks, pa.int32())],
                    ["row", "n_bytes", "n_tokens", "n_chunks"],
                )

    row = rows.schema["row"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"row {row}, n_bytes long, n_tokens long, n_chunks int")
    return counted.select(*[F.col("row")[c].alias(c) for c in carried], "n_bytes", "n_tokens", "n_chunks")


class Encoder:
    """The library's tokenizer, without its normalizer for texts that are normalized more cheaply,
    and the token counts of the pieces between white space that it has met.

    NFC, white space runs and lower-casing cost a quarter of the time. On a text of characters below
    U+0250 they only lower-case, as white space never gets into a token. Lower-casing must not make
    a special string of what was none.
    """

    def __init__(self, tokenizer: str) -> None:
        from tokenizers import Tokenizer, normalizers

        settings = json.loads(tokenizer)
        steps = (settings.get("normalizer") or {}).get("normalizers", [])
        self.special = [token["content"].lower() for token in settings.get("added_tokens", [])]
        self.whole = Tokenizer.from_str(tokenizer)
        self.plain = None
        if [step["type"] for step in steps] == ["NFC", "Replace", "Lowercase"]:
            self.plain = Tokenizer.from_str(tokenizer)
            self.plain.normalizer = normalizers.Sequence([])
        self.known: dict[bytes, int] = {}

    def learn(self, pieces: set[bytes]) -> None:
        """Count the tokens of pieces that are not known yet."""
        if len(self.known) > _KNOWN_PIECES:
            self.known.clear()
        by_tokenizer: dict[int, tuple[object, list[bytes], list[str]]] = {}
        for piece in pieces - self.known.keys():
            tokenizer, text = self.prepared(piece.decode())
            _, own, texts = by_tokenizer.setdefault(id(tokenizer), (tokenizer, [], []))
            own.append(piece)
            texts.append(text)
        for tokenizer, own, texts in by_tokenizer.values():
            for at in range(0, len(own), 20_000):
                found = tokenizer.encode_batch_fast(texts[at : at + 20_000], add_special_tokens=False)
                self.known.update(zip(own[at : at + 20_000], map(len, found)))

    def prepared(self, text: str) -> tuple[object, str]:
        """The tokenizer for a text, and the text as it takes it."""
        if self.plain is not None and not _BEYOND_LATIN.search(text):
            lowered = text.lower()
            if not any(token in lowered for token in self.special):
                return self.plain, lowered
        return self.whole, text


def _count(encoder: Encoder, texts: list[str | None], how: Chunking) -> tuple[list[int], list[int]]:
    counts, chunks = [0] * len(texts), [1] * len(texts)
    pieces: dict[int, list[bytes]] = {}
    for i, text in enumerate(texts):
        if text and len(text) > how.chunk:
            counts[i], chunks[i] = count_long(*encoder.prepared(text), how)
        elif text:
            pieces[i] = text.encode().split()
    encoder.learn(set().union(*pieces.values()))
    for i, own in pieces.items():
        counts[i] = sum(map(encoder.known.__getitem__, own))
    return counts, chunks


def count_long(encoder, text: str, how: Chunking) -> tuple[int, int]:
    """Tokens and chunks of one text. Chunk k starts at a splice and ends past the next one."""
    total, chunks, at = 0, 0, 0
    current = _encode(encoder, text, 0, how.chunk)
    while True:
        chunks += 1
        if current.end >= len(text):
            return total + len(current.ids), chunks
        overlap = how.overlap
        while True:
            start = max(current.end - overlap, at + 1)
            nearly_all = start == at + 1
            if nearly_all:
                # No splice inside: lengthen the current chunk instead.
                current = _encode(encoder, text, at, 2 * (current.end - at))
                if current.end >= len(text):
                    return total + len(current.ids), chunks
                overlap = how.overlap
                continue
            following = _encode(encoder, text, start, overlap + how.chunk)
            splice = _splice(text, current, following)
            if splice is not None:
                break
            overlap *= 2
        total += int(np.searchsorted(current.starts, splice))
        at = splice
        current = following.after(splice)


@dataclass(frozen=True)
class _Encoded:
    """Token ids with their start in the whole text; the encoded piece ends at ``end``."""

    ids: np.ndarray
    starts: np.ndarray
    begin: int
    end: int

    def after(self, place: int) -> _Encoded:
        first = int(np.searchsorted(self.starts, place))
        return _Encoded(self.ids[first:], self.starts[first:], place, self.end)


def _encode(encoder, text: str, begin: int, length: int) -> _Encoded:
    end = min(len(text), begin + length)
    found = encoder.encode(text[begin:end], add_special_tokens=False)
    starts = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.offsets))
    return _Encoded(np.array(found.ids, np.int64), starts + begin, begin, end)


def _splice(text: str, left: _Encoded, right: _Encoded) -> int | None:
    """The first white space of the overlap, if both encode what lies up to its last one alike."""
    spaces = [m.start() for m in _SPACE.finditer(text, right.begin, left.end)]
    if len(spaces) < 2:
        return None
    first, last = spaces[0], spaces[-1]
    a, b = np.searchsorted(left.starts, [first, last]), np.searchsorted(right.starts, [first, last])
    same = (
        a[1] > a[0]
        and np.array_equal(left.ids[a[0] : a[1]], right.ids[b[0] : b[1]])
        and np.array_equal(left.starts[a[0] : a[1]], right.starts[b[0] : b[1]])
    )
    return first if same else None
