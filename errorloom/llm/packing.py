"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous rounds.

A document's ids, with an end id, are one piece, or several if they do not fit a sequence: then the first
piece takes the odd rest and the others fill a sequence each.

Pieces are sorted by length across the cluster. Pieces of one length are interchangeable, so a run of them
(length, ranks from, count) moves as one, and so does a run of sequences with the same gap. Every round
sweeps the sorted runs once: from the longest pieces down, a piece takes the smallest gap it fits into
(its successor among the gaps), each gap serves one piece per round (shorter ones than an eighth of a
sequence: as many of one length as it holds), and where pieces contend for a gap the lower rank has it
and the others go on to the next. Then gaps are updated and the sweep repeats. Where a round places none of
the longest pieces, new sequences open, no more than their tokens need. There are at most as many runs of
pieces as a sequence has tokens, whatever the number of documents, so the sweeps take only these
counts to the driver; the pieces themselves get their rank, sequence and offset in tasks. Ranks
within a length are counted in as many parts as shuffles have, so a length that a third of all pieces
share is spread too.
"""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from errorloom.llm.common import lean, stored, tasks
from errorloom.llm.tokens import END, encode_all, vocabulary_path

SEQUENCE = 2048


def cut(length: int, most: int) -> list:
    """(start, length) of the pieces of a document of ``length`` ids."""
    first = length % most or most
    return [(0, first)] + [(start, most) for start in range(first, length, most)]


def pieces(docs: DataFrame, most: int = SEQUENCE, path: str = "", id_column: str = "doc_id",
           text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32, and ``ids`` on request.

    A null or empty text is one piece that holds the end id. Rows are taken as they come: a repeated row gives
    its pieces again. A null id stays null. An empty table has no pieces.
    """
    path = path or vocabulary_path()

    def encode(batches):
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(batch.column(1), path)):
                ids += END.to_bytes(4, "little")
                for number, (start, length) in enumerate(cut(len(ids) // 4, most)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, number, start, length, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*rows)) or [()] * 6
            names = schema.names
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[i], schema.field(i).type) for i in range(len(names))], names=names
            )

    kind = dict(docs.dtypes)[id_column]
    schema = pa.schema([("doc_id", to_arrow_type(docs.schema[id_column].dataType)), ("piece", pa.int32()),
                        ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
                       + [("ids", pa.binary())] * with_ids)
    ddl = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`").cast("string")).mapInArrow(lean(encode), ddl)


def sweeps(counts: dict, most: int = SEQUENCE) -> list:
    """Placements for ``counts`` pieces of each length: (length, rank from, count, per, sequence, offset).

    The piece of rank ``rank from + j`` goes to sequence ``sequence + j // per`` at
    ``offset + (j % per) * length``.
    """
    waiting = dict(sorted(((s, n) for s, n in counts.items() if n), reverse=True))
    rank = dict.fromkeys(waiting, 0)
    gaps: dict = {}  # gap: runs of (first sequence, count)
    opened, placed = 0, []

    def place(length, count, per, first, gap):
        placed.append((length, rank[length], count, per, first, most - gap))
        rank[length] += count
        waiting[length] -= count

    while waiting:
        longest = next(iter(waiting))
        # The sweep: lengths that belong together go downwards through the gaps.
        stack, after, moved = [], {}, False
        active = [s for s in waiting if 2 * s > longest]
        sizes = sorted(gaps, reverse=True)
        at = 0
        for length in active:
            while at < len(sizes) and sizes[at] >= length:
                stack.extend((sizes[at], first, n) for first, n in gaps.pop(sizes[at]))
                at += 1
            while waiting[length] and stack:
                gap, first, n = stack.pop()
                per = gap // length if 8 * length <= most else 1
                count = min(waiting[length], n * per)
                used, odd = divmod(count, per)
                place(length, count, per, first, gap)
                moved = True
                if used:
                    after.setdefault(gap - per * length, []).append((first, used))
                if odd:
                    after.setdefault(gap - odd * length, []).append((first + used, 1))
                if n > used + bool(odd):
                    stack.append((gap, first + used + bool(odd), n - used - bool(odd)))
        for gap, first, n in stack:
            gaps.setdefault(gap, []).append((first, n))
        for gap, runs in after.items():
            if gap:
                gaps.setdefault(gap, []).extend(runs)
        waiting = {s: n for s, n in waiting.items() if n}
        if not moved and waiting:
            need = sum(s * waiting[s] for s in active if s in waiting)
            fit = most // longest
            n = -(-need // most) if 2 * longest <= most else waiting[longest]
            n = max(1, min(n, -(-sum(waiting[s] for s in active if s in waiting) // fit)))
            gaps.setdefault(most, []).append((opened, n))
            opened += n
    return placed


def pack(pieces: DataFrame, most: int = SEQUENCE) -> DataFrame:
    """All rows with ``sequence_id`` and ``offset``.

    ``length`` must lie between 1 and ``most``. Columns named like the added ones are replaced, others are free; equal rows
    get different places. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    own = [F.col(f"`{name}`") for name in pieces.columns]
    part = F.pmod(F.xxhash64(*[c for c in ("doc_id", "piece") if c in pieces.columns], "length"),
                  F.lit(tasks(spark))).cast("int")
    rows = pieces.withColumn("_part", part)
    counts = stored(rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    placed = sweeps(by_length, most)
    placed.sort()
    length, first, _, per, sequence, offset = (np.array(x, dtype=np.int64) for x in (zip(*placed) if placed else [[]] * 6))
    # Ranks are below 2^51 for lengths below 2^12 and so on, so that one sorted key finds the run.
    shift = 62 - max(1, int(most).bit_length())
    keys = (length << shift) | first

    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    order = [c for c in ("doc_id", "piece", "start") if c in pieces.columns] or ["length"]
    place = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order)) - 1
    ranked = (
        rows.withColumn("_place", place)
        .join(starts.drop("_n"), ["length", "_part"])
        .withColumn("_rank", F.col("_place") + F.col("_before"))
        .select(*own, "_rank")
    )

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def located(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        s, r = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        run = np.searchsorted(keys, (s << shift) | r, side="right") - 1
        j = r - first[run]
        return pd.DataFrame({"sequence_id": sequence[run] + j // per[run],
                             "offset": offset[run] + j % per[run] * length[run]})

    return ranked.withColumn("_at", located("length", "_rank")).select(*own, "_at.*")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences' ids in order, from packed pieces that carry ``ids``."""
    return packed.groupBy("sequence_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(offset, hex(ids) AS ids))), x -> x.ids), '')").alias("hex")
    ).select("sequence_id", F.unhex("hex").alias("ids"))
