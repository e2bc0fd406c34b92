"""Mixture-controlled packing of documents into sequences, by deficit round-robin over source queues.

Every source is a queue of packets: its documents in a seeded order, each cut into packets of at
most a sequence's length. A round serves a window of one sequence's length: each queue's deficit
grows by its quantum (its share of the target proportions, times the length), and the queue sends
packets while its deficit covers the next one. What is left of a deficit is carried to the next
window, so a queue is never further from its target than a packet, however many windows there are.

A deficit needs no loop: after r rounds a queue has been granted r quanta, and as unspent grants
are carried, the packet that ends at token e of its queue is sent in round ceil(e / quantum). The
place e comes from totals carried over the partitions of one sort by source, the place of a
packet in the stream of all rounds from totals carried over the partitions of a second sort, by
round. Both sort narrow rows without ids. The stream is cut every ``length`` tokens: all
sequences are full but the last one, and a document of up to ``length`` tokens is cut once at
most. Ids are made once, written, and meet the plan in one shuffle.

Without given weights the targets are the sources' shares of all tokens, so that proportions hold
to the end. With weights a source that runs dry leaves its part to the others.

Defined results: a null text is empty, and an empty document is its end id alone; very long texts
are packets like others, no row holds more than one; a null source is a queue of its own, last in
each round; a null doc_id is kept; repeated rows are documents each; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fibrelark.llm.byte_pairs import Encoder, read_vocabulary
from fibrelark.llm.common import Scratch, batches, bytes_column, own_columns, trimmed

# Bytes of ids in one batch that a task hands back, and rows of text that come to it at once.
HANDED = 4 << 20
TEXTS = 2000

_ENCODERS: dict[str, Encoder] = {}


def packets(docs: DataFrame, tokenizer_path: str, length: int, end_id: int, seed: int) -> DataFrame:
    """row_id, doc_id, source, order_key, start, n, doc_tokens and ids (little-endian, ``width`` bytes each) of every packet."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_path))
    names = ["row_id", "doc_id", "source", "order_key", "start", "n", "doc_tokens", "width", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def handed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    @trimmed
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = Encoder(tokenizer_path, vocabulary.value)
        encoder = _ENCODERS[tokenizer_path]
        end = np.array([end_id], encoder.kind)
        for batch in batches(parts):
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True))
            rows, size = [], 0
            for key, ids in zip(keys, encoder.encode(bytes_column(batch, "text")), strict=True):
                ids = np.concatenate([ids, end])
                for start in range(0, len(ids), length):
                    some = ids[start : start + length]
                    rows.append((*key, start, len(some), len(ids), encoder.kind.itemsize, some.tobytes()))
                    size += some.nbytes
                    if size >= HANDED:
                        yield handed(rows)
                        rows, size = [], 0
            if rows:
                yield handed(rows)

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    key = F.xxhash64(F.lit(seed), doc_id, text).alias("order_key")
    own = own_columns(docs, "doc_id", "source", "text")
    keyed = own.select(F.monotonically_increasing_id().alias("row_id"), doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), key, text.alias("text"))
    return keyed.mapInArrow(run, "row_id long, doc_id long, source string, order_key long, start long, n long, doc_tokens long, width int, ids binary")


def running(rows: DataFrame, by_source: bool) -> DataFrame:
    """Adds part, the task's number, and upto, the tokens of the task's rows up to each one (of the row's source, if asked).

    ``rows`` is sorted over partitions, so the totals of the parts before complete the sum.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, source, total = TaskContext.get().partitionId(), "", 0
        for batch in batches(parts):
            n = batch.column(batch.schema.get_field_index("n")).to_numpy()
            upto = total + np.cumsum(n)
            if by_source:
                sources = batch.column(batch.schema.get_field_index("source")).to_pylist()
                changed = [k for k, s in enumerate(sources) if s != (sources[k - 1] if k else source)]
                for k in changed:  # each starts anew from the sum before it
                    upto[k:] -= upto[k] - n[k]
                source = sources[-1]
            total = int(upto[-1])
            columns = [pa.array(np.full(len(n), part, np.int32)), pa.array(upto)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "part", "upto"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, part int, upto long")


def plan(scratch: Scratch, queued: DataFrame, length: int, weights: DataFrame | None) -> DataFrame:
    """row_id, start and at, the packet's place in the stream; ``queued`` has row_id, source, order_key, start and n."""
    order = [F.col("source").asc_nulls_last(), "order_key", "row_id", "start"]
    queue = scratch.write(running(queued.orderBy(*order), True), "queue")
    # A row for each source and part, about as many as parts and sources together.
    totals = scratch.write(queue.groupBy("source", "part").agg(F.max("upto").alias("total")), "totals")
    by_source = totals.groupBy("source").agg(F.sum("total").alias("size"))
    if weights is None:
        whole = by_source.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        quanta = by_source.select("source", (F.lit(float(length)) * F.col("size") / F.lit(float(max(whole, 1)))).alias("quantum"))
    else:
        mixed = by_source.alias("a").join(weights.alias("w"), F.col("a.source").eqNullSafe(F.col("w.source")), "left")
        weight = F.when(F.col("w.weight") > 0, F.col("w.weight").cast("double")).otherwise(F.raise_error(F.lit("a source without a positive weight")).cast("double"))
        weighed = scratch.write(mixed.select("a.source", weight.alias("weight")), "weights")
        whole = weighed.agg(F.coalesce(F.sum("weight"), F.lit(1.0))).first()[0]
        quanta = weighed.select("source", (F.lit(float(length)) * F.col("weight") / F.lit(whole)).alias("quantum"))
    before = F.sum("total").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("source", "part", F.coalesce(before, F.lit(0)).alias("base")).alias("t")
    base = base.join(quanta.alias("q"), F.col("t.source").eqNullSafe(F.col("q.source"))).select("t.source", "t.part", "t.base", "q.quantum")
    base = scratch.write(base, "bases").alias("b")
    placed = queue.alias("r").join(base, (F.col("r.part") == F.col("b.part")) & F.col("r.source").eqNullSafe(F.col("b.source")))
    ends = F.col("b.base") + F.col("r.upto")
    placed = placed.select("r.row_id", "r.start", "r.n", "r.source", ends.alias("ends"), F.ceil(ends / F.col("b.quantum")).alias("round"))
    stream = running(placed.orderBy("round", F.col("source").asc_nulls_last(), "ends"), False).select("row_id", "start", "n", "part", "upto")
    stream = scratch.write(stream, "stream")
    scratch.drop("queue")
    bases, total = [], 0
    for r in stream.groupBy("part").agg(F.max("upto").alias("total")).orderBy("part").collect():  # a row for each task of the sort
        bases.append((r["part"], total))
        total += r["total"]
    table = scratch.spark.createDataFrame(bases, "part int, base long")
    return stream.join(F.broadcast(table), "part").select("row_id", "start", (F.col("base") + F.col("upto") - F.col("n")).alias("at"))


def pack(
    spark: SparkSession, docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, weights: DataFrame | None = None, seed: int = 7
) -> DataFrame:
    """doc_id, source, start, length, doc_tokens, sequence_id, offset and ids of every piece of a document.

    ``weights`` has source and weight, one row for each source; ids are little-endian numbers of 32 bits.
    """
    scratch = Scratch(spark, "packing")
    made = scratch.write(packets(docs, tokenizer_path, length, end_id, seed), "packets", TEXTS, compression="zstd")
    at = plan(scratch, made.select("row_id", "source", "order_key", "start", "n"), length, weights)
    # Both sides grow with the documents: sorted and merged at any size.
    met = made.alias("p").join(at.hint("merge").alias("s"), (F.col("p.row_id") == F.col("s.row_id")) & (F.col("p.start") == F.col("s.start")))
    met = met.select("p.doc_id", "p.source", "p.start", "p.doc_tokens", "s.at", "p.width", "p.ids")
    names = ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary()]

    def handed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    @trimmed
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches(parts):
            for doc_id, source, start, tokens, place, width, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                done = 0
                while done < len(wide):
                    sequence, offset = divmod(place + done, length)
                    some = wide[done : done + length - offset]
                    rows.append((doc_id, source, start + done, len(some), tokens, sequence, offset, some.tobytes()))
                    done += len(some)
                    size += some.nbytes
                if size >= HANDED:
                    yield handed(rows)
                    rows, size = [], 0
        if rows:
            yield handed(rows)

    return met.mapInArrow(cut, "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids of every sequence, filled with ``pad_id`` unless its size is a power of two.

    The pieces of a sequence are bounded by its length.
    """
    met = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("held", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    n = F.col("n_tokens")
    padded = F.rpad("ids", length * 4, F.lit(pad_id.to_bytes(4, "little")))
    ids = F.when(n.bitwiseAND(n - 1) == 0, F.col("ids")).otherwise(padded)
    return met.select("sequence_id", "n_tokens", joined.alias("ids")).select("sequence_id", "n_tokens", ids.alias("ids"))
