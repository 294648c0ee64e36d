"""Web archives and their capture index.

``write_archives`` writes a WARC 1.1 record per page; repeated payloads become revisit records.
``read_runs`` reads archives back, checks payload digests and gives every archive's captures as a
run sorted by URL key and time. ``merge_runs`` is the external merge: runs are dealt by ranges of
(URL key, time, record id), and in each range a loser tree merges the pieces of all runs, which
gives capture histories in one order over all ranges.

Archives are plain WARC files written and read by Spark, so they can lie in any store. A record
can be fetched alone by its archive, offset and length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import saved_table

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAK = "\r\n"
_CAPTURE = (
    "url_key string, captured timestamp, record_id string, record_type string, refers_to string, uri string, "
    "payload_digest string, payload_bytes long, intact boolean, archive string, offset long, length long"
)


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    captured: Column | None = None,
    least_revisit: int = 100,
    records_per_archive: int = 4000,
    large: int = 64 << 10,
) -> None:
    """Write a record per page to new archives in ``folder``, which is created.

    An archive is read as one value, so it stays small: pages of more than ``large`` bytes go to
    archives of their own, with a 250th of the records.

    The payload is the text in UTF-8, empty for null. Of equal payloads of ``least_revisit`` bytes
    or more, rows with the smallest id (null last) are responses and the others revisit it; smaller
    ones are all responses. A null URL has no target URI; line breaks in one are percent-encoded.
    A capture time that is null or not given is written as 1970-01-01.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("none")).alias("id"),
        F.col(id_col).cast("long").alias("rank"),
        F.replace(F.replace(F.col(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("uri"),
        F.coalesce(F.lit(None).cast("timestamp") if captured is None else captured, F.timestamp_seconds(F.lit(0))).alias("at"),
        payload.alias("payload"),
        F.octet_length(payload).alias("size"),
        F.sha2(payload, 256).alias("digest"),
    )
    # Only repeated payloads are joined back, so that pages move only if these are many.
    again = rows.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    again = saved_table(again.where("n > 1 and first is not null").select("digest", "first"), "warc-repeats")
    rows = rows.join(again, "digest", "left")
    revisit = F.coalesce(~F.col("first").eqNullSafe(F.col("rank")) & F.col("first").isNotNull(), F.lit(False))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_BREAK}Content-Type: text/html; charset=utf-8{_BREAK}Content-Length: "), F.col("size"), F.lit(_BREAK * 2))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))

    def header(name: str, *value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), *value, F.lit(_BREAK))

    record = F.concat(
        F.lit(f"WARC/1.1{_BREAK}"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.lit("<urn:page:"), F.col("id"), F.lit(">")),
        header("WARC-Date", F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.when(F.col("uri").isNotNull(), header("WARC-Target-URI", F.col("uri"))).otherwise(""),
        header("WARC-Payload-Digest", F.lit("sha256:"), F.col("digest")),
        F.when(revisit, F.concat(header("WARC-Refers-To", F.lit("<urn:page:"), F.col("first"), F.lit(">")), header("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        header("Content-Type", F.lit("application/http;msgtype=response")),
        header("Content-Length", F.octet_length("block")),
        F.lit(_BREAK),
        F.col("block"),
    )
    texts = rows.withColumn("block", block).select(record.alias("record"), "size")
    parts = (texts.where(F.col("size") <= large), records_per_archive), (
        texts.where(F.col("size") > large), max(1, records_per_archive // 250)
    )
    for (part, most), mode in zip(parts, ("errorifexists", "append")):
        # A record ends with two line breaks, which is what the text writer puts after each row.
        writer = part.select("record").write.mode(mode).option("lineSep", _BREAK * 2)
        writer.option("maxRecordsPerFile", most).text(folder)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives in a folder, with ``run`` (the archive) and ``turn`` in it.

    ``payload_digest`` and ``payload_bytes`` are those of the full payload, also for revisits.
    ``intact`` tells whether a response's payload has its digest; it is null for revisits.
    """
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "content")
    return files.mapInArrow(_sorted_captures, f"{_CAPTURE}, run string, turn long")


def merge_runs(runs: DataFrame) -> DataFrame:
    """Captures in the order of URL key, time and record id, over all partitions of the result.

    A URL captured very often is cut by time and id like any other range.
    """
    ranged = runs.repartitionByRange("url_key", "captured", "record_id").sortWithinPartitions("run", "turn")
    return ranged.mapInArrow(_merged, _CAPTURE)


def url_key(uri: str | None) -> str:
    """Host labels from the last to the first, then path and query, lower-cased; '' without URI."""
    if not uri:
        return ""
    try:
        parts = urlsplit(uri.strip())
        host = parts.hostname or ""
    except ValueError:
        return uri.lower()
    labels = [label for label in host.split(".") if label]
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(labels))}){parts.path or '/'}{query}".lower()


def _sorted_captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            found = sorted(_records(memoryview(content.as_buffer())), key=lambda r: (r["url_key"], r["captured"], r["record_id"]))
            columns = {name: [r[name] for r in found] for name in _FIELDS}
            arrays = [pa.array(columns[name], kind) for name, kind in _FIELDS.items()]
            archive = pa.array([path.as_py()] * len(found), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*arrays[:9], archive, *arrays[9:], archive, pa.array(range(len(found)), pa.int64())],
                [*list(_FIELDS)[:9], "archive", *list(_FIELDS)[9:], "run", "turn"],
            )


_FIELDS = {
    "url_key": pa.string(),
    "captured": pa.timestamp("us", "UTC"),
    "record_id": pa.string(),
    "record_type": pa.string(),
    "refers_to": pa.string(),
    "uri": pa.string(),
    "payload_digest": pa.string(),
    "payload_bytes": pa.int64(),
    "intact": pa.bool_(),
    "offset": pa.int64(),
    "length": pa.int64(),
}


def _records(data: memoryview) -> Iterator[dict]:
    """Records are found by their Content-Length, so payloads may hold anything."""
    from datetime import datetime

    raw, at = bytes(data), 0
    while at < len(raw):
        body = raw.index(b"\r\n\r\n", at) + 4
        head = _headers(raw[at:body])
        end = body + int(head["content-length"])
        payload = raw.index(b"\r\n\r\n", body, end) + 4
        http = _headers(raw[body:payload])
        digest = head["warc-payload-digest"].removeprefix("sha256:")
        response = head["warc-type"] == "response"
        yield {
            "url_key": url_key(head.get("warc-target-uri")),
            "captured": datetime.fromisoformat(head["warc-date"]),
            "record_id": _inner(head["warc-record-id"]),
            "record_type": head["warc-type"],
            "refers_to": _inner(head["warc-refers-to"]) if "warc-refers-to" in head else None,
            "uri": head.get("warc-target-uri"),
            "payload_digest": digest,
            "payload_bytes": end - payload if response else int(http["content-length"]),
            "intact": hashlib.sha256(raw[payload:end]).hexdigest() == digest if response else None,
            "offset": at,
            "length": end - at,
        }
        at = end + 4


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    pairs = (line.partition(": ") for line in lines if line)
    return {name.lower(): value for name, _, value in pairs}


def _inner(record_id: str) -> str:
    return record_id.strip("<>").removeprefix("urn:page:")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows come run by run, each in order."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    keys = list(zip(*(rows.column(c).to_pylist() for c in ("url_key", "captured", "record_id"))))
    names = rows.column("run").to_pylist()
    starts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
    order = loser_tree_order(keys, list(zip(starts, [*starts[1:], len(names)])))
    yield from rows.drop_columns(["run", "turn"]).take(pa.array(order, pa.int64())).combine_chunks().to_batches()


def loser_tree_order(keys: Sequence, runs: Sequence[tuple[int, int]]) -> list[int]:
    """Positions in the order of their keys, given as runs (from, to) that are sorted already.

    Every inner node keeps the loser of its match, so that after a run has moved on only the
    matches on its way to the root are played again: log2(k) comparisons a row. Ties go to the
    earlier run.
    """
    k = len(runs)
    at = [lo for lo, _ in runs]
    ends = [hi for _, hi in runs]

    def beats(a: int, b: int) -> bool:
        if at[a] == ends[a] or at[b] == ends[b]:
            return at[b] == ends[b] and (at[a] != ends[a] or a < b)
        x, y = keys[at[a]], keys[at[b]]
        return x < y or (x == y and a < b)

    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    winner = winners[1] if k > 1 else 0
    out = []
    for _ in range(sum(hi - lo for lo, hi in runs)):
        out.append(at[winner])
        at[winner] += 1
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
    return out
