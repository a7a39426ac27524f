"""Words of whole columns of texts, found in a Python worker: what ``text.tokens`` gives, without an object for each word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .text import ALONE, TOGETHER

#: Bytes of texts that are looked at together, one text at least.
BYTES_AT_ONCE = 1 << 21
CODE_POINTS = 0x110000

#: By session: what kind each character is.
_kinds: dict[str, list[tuple[int, int, int]]] = {}


def kinds(spark: SparkSession) -> list[tuple[int, int, int]]:
    """Stretches (first, end, kind) of characters that are part of a word (1) or a word of their own (2), as Spark's own patterns see them."""
    key = spark.sparkContext.applicationId
    if key not in _kinds:
        character = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        kind = F.when(character.rlike(f"^{TOGETHER}$"), 1).when(character.rlike(f"^{ALONE}$"), 2)
        rows = spark.range(CODE_POINTS).where("id not between 55296 and 57343").select("id", kind.alias("kind")).where("kind is not null")
        # as many as Unicode has letters
        at, of = np.array([(r[0], r[1]) for r in rows.collect()], np.int64).reshape(-1, 2).T
        order = np.argsort(at)
        at, of = at[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(of) != 0)]))
        last = np.append(first[1:], len(at)) - 1
        _kinds[key] = list(zip(at[first].tolist(), (at[last] + 1).tolist(), of[first].tolist(), strict=True))
    return _kinds[key]


def table_of(stretches: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(CODE_POINTS, np.uint8)
    for first, end, kind in stretches:
        out[first:end] = kind
    return out


def split(texts: pa.Array, table: np.ndarray) -> pa.ListArray:
    """Lists of words of lower-case texts; a null has none."""
    whole = texts.cast(pa.string()).fill_null("")
    before = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    raw = whole.buffers()[2].to_pybytes()[before[0] : before[-1]] if before[-1] > before[0] else b""
    before = before.astype(np.int64) - before[0]
    data = np.frombuffer(raw, np.uint8)
    head = (data & 0xC0) != 0x80  # where characters begin
    kind = table[np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)]
    starts = np.flatnonzero(head)
    # a word begins at a character that follows another kind, at one that stands alone, and where a text begins
    begins = np.ones(len(kind), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    begins[np.searchsorted(starts, before[:-1][before[:-1] < len(raw)])] = True
    first = starts[begins & (kind > 0)]
    inside = np.repeat(kind > 0, np.diff(np.append(starts, len(raw))))
    kept = np.cumsum(inside)
    ends = np.append(kept[first] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
    held = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.tobytes()), pa.py_buffer(data[inside].tobytes()))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, before).astype(np.int32)), held)


def slices(batch: pa.RecordBatch, text: int, limit: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts have about ``limit`` bytes, one row at least."""
    before = np.append(0, np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy().astype(np.int64)))
    row = 0
    while row < batch.num_rows:
        end = max(int(np.searchsorted(before, before[row] + limit, side="right")) - 1, row + 1)
        yield batch.slice(row, end - row)
        row = end


def worded(rows: DataFrame, text: Column, carry: list[str], made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """Rows that ``made`` gives for batches of ``carry`` and the words of a text that isn't null, a list that may be empty.

    Texts become lower-case in Spark; what a word is, is what its pattern says, asked once a session.
    """
    given = rows.where(text.isNotNull()).select(*carry, F.lower(text).alias("text"))
    stretches = kinds(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(stretches)

        def split_up() -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, len(carry)):
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], split(batch.column(len(carry)), table)], names=[*carry, "words"])

        return made(split_up())

    return given.mapInArrow(run, schema)
