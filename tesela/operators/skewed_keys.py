"""Results per key with even work, however few keys hold most rows.

Exact offset chunking. Rows are laid out in order of (key, item) over range partitions of even size, which cut
through heavy keys. Every partition counts its rows of each key and goes through them in chunks of exactly
``chunk_rows`` rows (the last chunk of a key in a partition may be smaller), each of which gives a state: rows,
distinct items, total, first and last item. Neighbouring states are merged at their boundaries, where an item
that ends one and begins the next is counted once: within a partition at once, so a key has one state in each
partition it lies in; across partitions in the order of the row numbers, which are prefix sums of the counts.
Only these states are shuffled a second time, at most as many for a key as there are partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 100_000
_STATES = "key_value string, part int, n bigint, items bigint, cents bigint, filled bigint, chunks bigint, first_item string, last_item string"
_SCHEMA = pa.schema([("key_value", pa.string()), ("part", pa.int32()), *[(c, pa.int64()) for c in ("n", "items", "cents", "filled", "chunks")], ("first_item", pa.string()), ("last_item", pa.string())])


def _differs(a: pa.Array) -> np.ndarray:
    """True where an element isn't the one before it (null equals null); the first is True."""
    out = np.ones(len(a), dtype=bool)
    if len(a) > 1:
        x, y = a.slice(1), a.slice(0, len(a) - 1)
        same = pc.fill_null(pc.equal(x, y), False)
        both = pc.and_(pc.is_null(x), pc.is_null(y))
        out[1:] = ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    return out


def _merged(a: list, b: list) -> list:
    """State of the rows of two neighbouring states of one key: [n, items, cents, filled, chunks, first, last]."""
    again = a[6] is not None and a[6] == b[5]
    return [a[0] + b[0], a[1] + b[1] - again, a[2] + b[2], a[3] + b[3], a[4] + b[4], a[5], b[6]]


def _chunks(chunk_rows: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        key, done, chunk = None, None, None  # key at hand, state of its full chunks, state of its open chunk
        opened = False
        for b in batches:
            if not b.num_rows:
                continue
            keys, item = b.column(0).cast(pa.string()), b.column(1).cast(pa.string())
            new_key, new_item = _differs(keys), _differs(item)
            begins = opened and keys[0].as_py() == key
            starts = np.flatnonzero(new_key)
            lengths = np.diff(np.append(starts, b.num_rows))
            pieces = []
            for i, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
                room = (chunk_rows - chunk[0] if i == 0 and begins else 0) or chunk_rows  # a full chunk leaves none
                pieces += [s, *range(s + room, s + n, chunk_rows)] if n > room else [s]
            starts = np.array(pieces)
            ends = np.append(starts[1:], b.num_rows) - 1
            filled_item = item.is_valid().to_numpy(zero_copy_only=False)
            new_item[starts] = True
            distinct = np.add.reduceat((new_item & filled_item).astype(np.int64), starts)
            cents = b.column(2)
            has = np.add.reduceat(cents.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), starts)
            total = np.add.reduceat(pc.fill_null(cents, 0).to_numpy(zero_copy_only=False), starts)
            firsts, lasts, names = item.take(pa.array(starts)).to_pylist(), item.take(pa.array(ends)).to_pylist(), keys.take(pa.array(starts)).to_pylist()
            out = []
            for i, name in enumerate(names):
                state = [int(ends[i] - starts[i] + 1), int(distinct[i]), int(total[i]), int(has[i]), 1, firsts[i], lasts[i]]
                if opened and name == key:
                    if chunk[0] < chunk_rows:  # goes on with the open chunk
                        chunk = [*_merged(chunk, state)[:4], 1, chunk[5], state[6]]
                    else:
                        done, chunk = (chunk if done is None else _merged(done, chunk)), state
                else:
                    if opened:
                        out.append([key, part, *(chunk if done is None else _merged(done, chunk))])
                    key, done, chunk, opened = name, None, state, True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)
        if opened:
            last = [key, part, *(chunk if done is None else _merged(done, chunk))]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return run


def key_states(df: DataFrame, key: str, item: str, amount: str | None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One state for each key and partition it lies in, in order of part."""
    cents = F.lit(None).cast("bigint") if amount is None else F.when(~F.isnan(F.col(amount).cast("double")), F.round(F.col(amount).cast("double") * 100).cast("bigint"))
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(item).cast("string").alias("i"), cents.alias("c"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("short").alias("s"))
    laid = rows.repartitionByRange("k", "i", "s").sortWithinPartitions("k", "i").select("k", "i", "c")
    return laid.mapInArrow(_chunks(chunk_rows), _STATES)


def numbered_states(states: DataFrame) -> DataFrame:
    """States with the number of the first row of each among the rows of its key, by prefix sums of the counts."""
    w = Window.partitionBy("key_value").orderBy("part")
    return states.withColumn("first_row", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def per_key(df: DataFrame, key: str, item: str, amount: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """key_value, n_rows, n_items (distinct, null not counted), total, n_chunks, for every key.

    Null and blank keys are keys of their own; a total is null where no row has an amount (NaN counts as
    none) and exact to the cent. Ties and repeated rows count as rows; an empty table gives an empty one.
    Other columns, also ones with the result's names, are ignored.
    """
    states = numbered_states(key_states(df, key, item, amount, chunk_rows))
    w = Window.partitionBy("key_value").orderBy("first_row")
    again = F.when(F.lag("last_item").over(w) == F.col("first_item"), 1).otherwise(0)
    merged = states.withColumn("again", again).groupBy("key_value").agg(
        F.sum("n").alias("n_rows"),
        (F.sum("items") - F.sum("again")).alias("n_items"),
        F.when(F.sum("filled") > 0, F.sum("cents") / F.lit(100.0)).alias("total"),
        F.sum("chunks").alias("n_chunks"),
    )
    return merged


def heavy_keys(df: DataFrame, key: str, item: str, amount: str | None = None, share: float = 0.03, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Results of the non-blank keys that hold at least ``share`` of all rows."""
    total = df.count()
    return per_key(df, key, item, amount, chunk_rows).where((F.trim("key_value") != "") & (F.col("n_rows") >= F.lit(share) * F.lit(total)))
