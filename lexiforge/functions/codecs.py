"""Gap and variable-byte coding of integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delta_encode(values: Column) -> Column:
    """Differences of an array's neighbours; the first is kept."""
    return F.transform(values, lambda x, i: x - F.when(i > 0, F.get(values, i - 1)).otherwise(0))


def _lists(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, one row after the other, and the n+1 offsets; a null row has none."""
    size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(size, dtype=np.int64))


def _list_array(values: np.ndarray | pa.Array, offs: np.ndarray, mask: pa.Array | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values), mask=mask)


def _gaps(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Differences within the rows that offs bounds; each row's first value is kept."""
    out, starts = np.diff(values, prepend=0), offs[:-1][offs[:-1] < offs[1:]]
    out[starts] = values[starts]
    return out


def _sums(gaps: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Running sums within the rows that offs bounds."""
    total = np.append(0, np.cumsum(gaps))
    return total[1:] - np.repeat(total[offs[:-1]], np.diff(offs))


@F.arrow_udf(T.ArrayType(T.LongType()))
def delta_decode(deltas: pa.Array) -> pa.Array:
    """Running sums of an array, in time that grows with its length."""
    values, offs = _lists(deltas)
    return _list_array(_sums(values, offs), offs, deltas.is_null())


def _encoded(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian groups of 7 bits; the high bit says that more follow. And where each number's bytes begin and end."""
    if len(n) and n.min() < 0:
        raise ValueError("vbyte codes numbers from 0")
    size = np.ones(len(n), np.int64)
    for k in range(1, 9):
        more = n >> (7 * k) > 0
        if not more.any():
            break
        size += more
    end = np.append(0, np.cumsum(size))
    out = np.empty(end[-1], np.uint8)
    for k in range(int(size.max()) if len(n) else 0):
        has = np.flatnonzero(size > k)
        out[end[has] + k] = (n[has] >> (7 * k)) & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, end


def encode_numbers(numbers) -> bytes:
    return _encoded(np.asarray(numbers, np.int64))[0].tobytes()


def _decoded(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of rows of bytes, and their offsets; an unfinished last one of a row is dropped."""
    end = np.flatnonzero(b < 128)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[end]
    start = np.maximum(np.append(0, end[:-1] + 1)[: len(end)], offs[:-1][row])
    size = end + 1 - start
    first = np.cumsum(size) - size
    shift = np.arange(size.sum()) - np.repeat(first, size)
    bits = (b[shift + np.repeat(start, size)].astype(np.int64) & 127) << 7 * shift
    values = np.add.reduceat(bits, first) if len(end) else np.zeros(0, np.int64)
    return values, np.append(0, np.cumsum(np.bincount(row, minlength=len(offs) - 1)))


def decode_array(data: bytes) -> np.ndarray:
    """The numbers of data; an unfinished last one is dropped."""
    return _decoded(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]


def decode_numbers(data: bytes) -> list[int]:
    return decode_array(data).tolist()


def _binary(n: np.ndarray, offs: np.ndarray, mask: pa.Array | None = None) -> pa.Array:
    """The bytes of each row of numbers."""
    out, end = _encoded(n)
    buffers = [pa.py_buffer(end[offs].astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())]
    valid = None if mask is None else pa.py_buffer(np.packbits(~mask.to_numpy(zero_copy_only=False), bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [valid, *buffers])


def _numbers(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each row of bytes, one row after the other, and the offsets; a null row has none."""
    size = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False)
    raw = b"".join(x for x in data.to_pylist() if x)
    return _decoded(np.frombuffer(raw, np.uint8), np.append(0, np.cumsum(size, dtype=np.int64)))


@F.arrow_udf(T.BinaryType())
def vbyte_encode(values: pa.Array) -> pa.Array:
    return _binary(*_lists(values), values.is_null())


@F.arrow_udf(T.ArrayType(T.LongType()))
def vbyte_decode(data: pa.Array) -> pa.Array:
    return _list_array(*_numbers(data), data.is_null())


# ---- blocks: some postings of a term in one value: their number, doc_id gaps, frequencies, then position gaps


def _within(size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The places of runs of so many that begin at start."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


@F.arrow_udf(T.BinaryType())
def encode_block(doc_ids: pa.Array, positions: pa.Array) -> pa.Array:
    """doc_ids ascend; positions: as many arrays, each ascending and not empty."""
    docs, offs = _lists(doc_ids)
    flat, cut = _lists(positions.flatten())
    k, tf = np.diff(offs), np.diff(cut)
    places = cut[offs[1:]] - cut[offs[:-1]]
    ends = np.append(0, np.cumsum(1 + 2 * k + places))
    at, out = ends[:-1], np.empty(ends[-1], np.int64)
    out[at] = k
    out[_within(k, at + 1)] = _gaps(docs, offs)
    out[_within(k, at + 1 + k)] = tf
    out[_within(places, at + 1 + 2 * k)] = _gaps(flat, cut)
    return _binary(out, ends)


_BLOCK = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.LongType()))]))


def _blocks(data: pa.Array, places: bool) -> pa.Array:
    n, ends = _numbers(data)
    at = ends[:-1]
    k = n[at]
    offs = np.append(0, np.cumsum(k))
    docs, tf = _sums(n[_within(k, at + 1)], offs), n[_within(k, at + 1 + k)]
    cut = np.append(0, np.cumsum(tf))
    if places:
        own = _list_array(_sums(n[_within(cut[offs[1:]] - cut[offs[:-1]], at + 1 + 2 * k)], cut), cut)
    else:
        own = pa.nulls(len(docs), pa.list_(pa.int64()))
    return _list_array(pa.StructArray.from_arrays([pa.array(docs), pa.array(tf), own], ["doc_id", "tf", "positions"]), offs)


@F.arrow_udf(_BLOCK)
def decode_block(data: pa.Array) -> pa.Array:
    return _blocks(data, True)


@F.arrow_udf(_BLOCK)
def decode_block_counts(data: pa.Array) -> pa.Array:
    """doc_id and tf alone."""
    return _blocks(data, False)


def block_of(doc_id: Column, docs: int = 1 << 16) -> Column:
    """The block of a posting: ranges of doc_id, so that no common word fills a row or a task."""
    return F.floor(doc_id / docs)
