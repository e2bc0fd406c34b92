"""WARC archives: written through Spark's text writer, read back by boundary-chain verification.

Writing: every page is a record; of records with equal payloads of at least 1000
bytes the one with the largest page_id is a response and the others revisit it. Which
ones do is decided on narrow rows (page_id, digest), so payloads of revisits are never
moved. The text writer's line separator is the end of a record, so archives are plain
(or gzipped) concatenations of records on any file system that Spark writes to.

Reading: the text reader cuts archives at the version line, so tasks see every place
where a record might start, with its offset in their split. For each they emit the
successor that its length header claims. A task follows the chains of SEGMENT
candidates in a row to where they leave that segment; from there pointers jump: from
the start of each file, over segments, doubling in every round, as tables in the shared
folder. Only records that the chain reaches are kept, so version lines inside payloads
are never taken for records. A payload that stands in one piece is hashed as it is
read; those that hold version lines are put together once the chain is known, so every
byte is hashed once, whatever false heads a payload holds.

Defined results: null html is an empty payload and a null url an empty target; very
long payloads are read whole; rows with a null page_id are written and read back with a
null id, and never revisit or are revisited; repeated rows are records each; an empty
table gives an empty result; other columns are ignored. A chain that breaks (a damaged
archive) ends there, as does one that would leave the file.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fibrelark.llm.common import Scratch, batches

MAGIC = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
LEAST_BYTES = 1000
RECORDS_A_FILE = 50_000
SEGMENT = 512
BROADCAST_IDS = 1_000_000  # revisits are broadcast up to this number, joined by a shuffle beyond
_LENGTH = re.compile(rb"^Content-Length: ([0-9]{1,18})$", re.M | re.I)


def _described(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )


def revisits(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, digest and refers_to of the pages whose payload another one brings.

    The largest page_id of a digest is found by partial maxima over (digest, salt), and
    comes back to the narrow rows by the same pair. There are four salts for each
    partition, so a payload that a third of all pages share is dealt over all tasks.
    """
    salts = 4 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    narrow = _described(pages).drop("payload").filter(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= LEAST_BYTES))
    narrow = narrow.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    salted = narrow.groupBy("digest", "salt").agg(F.max("page_id").alias("high"), F.count(F.lit(1)).alias("n"))
    whole = salted.groupBy("digest").agg(F.max("high").alias("response"), F.sum("n").alias("n")).filter("n > 1")
    # Only digests with copies come back, with the salts that they have.
    back = salted.select("digest", "salt").join(whole, "digest").select(F.col("digest").alias("d"), F.col("salt").alias("s"), "response")
    joined = narrow.join(back, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")))
    return joined.filter("page_id <> response").select("page_id", "url", "payload_bytes", "digest", F.col("response").alias("refers_to"))


def typed(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, digest and refers_to (the response's page_id, for revisits)."""
    moved = Scratch(spark, "warc-revisits").write(revisits(spark, pages), "revisits")
    keys = moved.select(F.col("page_id").alias("p"), F.col("digest").alias("d")).distinct()
    small = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    responses = _described(pages).join(F.broadcast(keys) if small else keys, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left_anti")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(moved.withColumn("payload", F.lit(None).cast("string")))


def _record() -> Column:
    """A record up to its end mark; lengths count bytes."""
    line = F.lit("\r\n")
    revisit = F.col("refers_to").isNotNull()
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    place = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    return F.concat(
        F.lit(MAGIC.decode()),
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), line,
        F.lit("WARC-Record-ID: <urn:page:"), page, F.lit(">"), line,
        F.lit("WARC-Target-URI: "), place, line,
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"), line,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), line,
        F.when(revisit, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), line,
            F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"), line,
        )).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response"), line,
        F.lit("Content-Length: "),
        (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))).cast("string"), line, line,
        http,
        F.coalesce(F.col("payload"), F.lit("")),
    )


def write_archives(pages: DataFrame, path: str, compression: str | None = None) -> None:
    """Writes archives of at most RECORDS_A_FILE records each below ``path``."""
    writer = typed(pages.sparkSession, pages).select(_record().alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", RECORDS_A_FILE)
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


_FOUND = "file string, block long, segment long, at long, next long, leaves long, span long, head string, http string, digest string, n long"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_KINDS = [pa.string(), *[pa.int64()] * 6, *[pa.string()] * 3, pa.int64()]


def _candidates(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each place in a split where a record might start: offset, claimed successor, where its chain leaves the segment.

    Offsets count from the first version line of the split (from the start of the
    file in its first split). The last row of a split has only its span. A record
    that goes on after the next version line has no digest yet.
    """
    rows: list[dict] = []
    here: tuple[str, int] | None = None
    at = segment = 0

    def told(ends: bool) -> pa.RecordBatch:
        by_place: dict[int, dict] = {}
        for row in reversed(rows):  # successors come later, so theirs is known
            after = by_place.get(row["next"])
            row["leaves"] = row["next"] if after is None else after["leaves"]
            by_place[row["at"]] = row
        out = [*rows, *([{"file": here[0], "block": here[1], "at": -1, "span": at}] if ends else [])]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in out], t) for k, t in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)

    for batch in batches(parts):
        for file, block, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if here != (file, block):
                if here is not None:
                    yield told(True)
                here, at, segment = (file, block), 0, 0
                if block == 0:  # what stands before the first version line
                    at = len(piece)
                    continue
            end = piece.find(END)
            length = _LENGTH.search(piece[: end + 2].replace(b"\r\n", b"\n")) if end >= 0 else None
            if length is not None:
                size, start = int(length[1]), end + len(END)
                row = {"file": file, "block": block, "segment": segment, "at": at, "next": at + len(MAGIC) + start + size + len(END), "head": piece[:end].decode("utf-8", "replace")}
                cut = piece.find(END, start, start + size)
                if start + size <= len(piece) and cut >= 0:
                    payload = piece[cut + len(END) : start + size]
                    row |= {"http": piece[start:cut].decode("latin-1"), "digest": hashlib.sha1(payload).hexdigest(), "n": len(payload)}
                rows.append(row)
                if len(rows) == SEGMENT:
                    yield told(False)
                    segment += 1
            at += len(MAGIC) + len(piece)
    if here is not None:
        yield told(True)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.option("lineSep", MAGIC.decode())
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").cast("long").alias("block"), F.col("value").cast("binary").alias("piece"))
    )


def _walk(frame: pd.DataFrame) -> pd.DataFrame:
    """Of a segment's candidates those that the chain reaches from its entry."""
    entry = int(frame["entry"].iloc[0])
    after = dict(zip(frame["at"], frame["next"], strict=True))
    reached = set()
    while entry in after:
        reached.add(entry)
        entry = after[entry]
    return frame[frame["at"].isin(reached)].drop(columns=["segment", "entry"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records that the chain from the start of each file reaches: file, at, head, http, digest and n of the payload."""
    scratch = Scratch(spark, "warc-read")
    found = scratch.write(_pieces(spark, path).mapInArrow(_candidates, _FOUND), "found")
    spans = found.filter("at = -1").select("file", "block", "span")
    # Sums over the splits of a file: as many rows as the file has splits.
    upto = F.sum("span").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    bases = scratch.write(spans.withColumn("until", upto).withColumn("base", F.col("until") - F.col("span")), "bases")
    nodes = (
        found.filter("at >= 0").alias("c").join(bases.alias("b"), ["file", "block"])
        .select("file", "block", "segment", "base", "until", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("next")).alias("next"), (F.col("base") + F.col("leaves")).alias("leaves"), "head", "http", "digest", "n")
    )
    entries = _jump(scratch, nodes)
    kept = nodes.drop("leaves").join(entries, ["file", "block", "segment"]).groupBy("file", "block", "segment").applyInPandas(
        _walk, "file string, block long, base long, until long, at long, next long, head string, http string, digest string, n long"
    )
    return _with_tails(spark, scratch.write(kept, "kept"), bases, path)


def _jump(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """(file, block, segment, entry): where the chain enters each segment that it enters, by pointer jumping.

    After round k the known entries are the first 2^k of each file's chain, and a
    pointer leads 2^k segments on. Only places where some chain enters a segment have one.
    """
    segments = nodes.groupBy("file").agg(F.count_distinct("block", "segment").alias("n")).agg(F.max("n")).first()[0] or 0
    starts = nodes.filter("block = 0 and segment = 0").groupBy("file").agg(F.min("at").alias("entry"))
    entered = starts.union(nodes.select("file", F.col("leaves").alias("entry"))).distinct()
    steps = nodes.join(entered.withColumnRenamed("file", "f"), (F.col("file") == F.col("f")) & (F.col("at") == F.col("entry")), "left_semi")
    steps = scratch.write(steps.select("file", "block", "segment", F.col("at").alias("here"), F.col("leaves").alias("there")), "steps")
    pointers = scratch.write(steps.select("file", "here", "there"), "pointers-0")
    known = scratch.write(starts, "entries-0")
    reach, k = 1, 0
    while reach < segments:
        k += 1
        step = known.alias("e").join(pointers.alias("p"), (F.col("e.file") == F.col("p.file")) & (F.col("entry") == F.col("here"))).select("e.file", F.col("there").alias("entry"))
        known = scratch.write(known.union(step).distinct(), f"entries-{k}")
        reach *= 2
        if reach < segments:
            far = pointers.alias("p").join(pointers.alias("q"), (F.col("p.file") == F.col("q.file")) & (F.col("p.there") == F.col("q.here")))
            pointers = scratch.write(far.select("p.file", "p.here", "q.there"), f"pointers-{k}")
    places = known.alias("e").join(steps.alias("s"), (F.col("e.file") == F.col("s.file")) & (F.col("entry") == F.col("here")))
    return places.select("e.file", "block", "segment", "entry")


def _with_tails(spark: SparkSession, kept: DataFrame, bases: DataFrame, path: str) -> DataFrame:
    """Completes the payloads of records that go on in later splits; archives whose files are one split have none."""
    names = ["file", "at", "head", "http", "digest", "n"]
    open_ = kept.filter("digest is null")
    if not open_.limit(1).count():
        return kept.filter("digest is not null").select(names)
    # The splits that each such record touches, and from those the pieces that lie in it.
    wanted = open_.alias("r").join(
        bases.alias("b"), (F.col("r.file") == F.col("b.file")) & (F.col("b.until") > F.col("r.at")) & (F.col("b.base") < F.col("r.next"))
    ).select("r.file", "b.block", "b.base", F.col("r.at").alias("record"), F.col("r.next").alias("stop"))
    pieces = _pieces(spark, path).mapInArrow(_placed, "file string, block long, at long, piece binary")
    inside = pieces.join(wanted, ["file", "block"]).filter("base + at >= record and base + at < stop")
    whole = inside.select("file", "record", "stop", (F.col("base") + F.col("at")).alias("at"), "piece")
    done = whole.groupBy("file", "record").applyInPandas(_assemble, "file string, record long, http string, digest string, n long")
    ended = open_.select("file", "at", "head").join(done, (open_["file"] == done["file"]) & (open_["at"] == done["record"])).select(
        open_["file"], "at", "head", "http", "digest", "n"
    )
    return kept.filter("digest is not null").select(names).union(ended.filter("digest is not null"))


def _placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every piece with its offset in the split, with the version line before it."""
    here, at = None, 0
    for batch in batches(parts):
        rows = []
        for file, block, piece in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if here != (file, block):
                here, at = (file, block), 0
                if block == 0:
                    at = len(piece)
                    continue
            rows.append((file, block, at, MAGIC + piece))
            at += len(MAGIC) + len(piece)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["file", "block", "at", "piece"])


def _assemble(frame: pd.DataFrame) -> pd.DataFrame:
    """One record's payload from its pieces."""
    frame = frame.sort_values("at")
    record, stop = int(frame["record"].iloc[0]), int(frame["stop"].iloc[0])
    data = b"".join(bytes(x) for x in frame["piece"])[: stop - record - len(END)]
    block = data[data.find(END) + len(END) :]
    cut = block.find(END)
    complete = len(data) == stop - record - len(END) and cut >= 0
    payload = block[cut + len(END) :]
    row = (frame["file"].iloc[0], record, block[:cut].decode("latin-1"), hashlib.sha1(payload).hexdigest(), len(payload)) if complete else (frame["file"].iloc[0], record, None, None, None)
    return pd.DataFrame([row], columns=["file", "record", "http", "digest", "n"])


def page_rows(records: DataFrame) -> DataFrame:
    """The contract's columns, from headers and payloads that were read.

    A response's digest and length come from its payload, and must agree with its
    headers; a revisit's come from its headers.
    """
    head = lambda name: F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}: ([^\r]*)", 1)
    kind = head("WARC-Type")
    said = F.regexp_extract(head("WARC-Payload-Digest"), "sha1:([0-9a-f]+)", 1)
    length = F.regexp_extract("http", r"(?i)\r\nContent-Length: ([0-9]+)", 1).try_cast("long")
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    response = kind == "response"
    holds = ~response | ((said == F.col("digest")) & (length == F.col("n")))
    checked = F.when(holds, said).otherwise(F.raise_error(F.concat(F.lit("payload and header disagree in "), F.col("file"))))
    return records.select(
        number(head("WARC-Record-ID")).alias("page_id"),
        length.alias("payload_bytes"),
        checked.alias("payload_digest"),
        kind.alias("record_type"),
        number(head("WARC-Refers-To")).alias("refers_to"),
    )


def round_trip(spark: SparkSession, pages: DataFrame, compression: str | None = None) -> DataFrame:
    """Writes the archives to the shared folder and reads them back."""
    scratch = Scratch(spark, "warc")
    write_archives(pages, scratch.at("archives"), compression)
    return page_rows(read_archives(spark, scratch.at("archives")))
