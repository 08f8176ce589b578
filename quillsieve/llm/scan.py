"""Words of a column of texts, read from Arrow buffers with NumPy: no Python object a text or word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words: a space and bytes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of texts looked at together; a longer text is looked at alone, whole.
SLICE = 4_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, data, ends): runs of texts of a string column, their UTF-8 bytes and len + 1 offsets into these.

    Nulls count as empty, whatever bytes lie below them.
    """
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, offset=column.offset * (8 if wide else 4), count=len(column) + 1).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, side="right")) - 1)
        yield first, last, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def word_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of all words; none reaches over the end of its text."""
    full = ~SPACE[data]
    begins = full.copy()
    begins[1:] &= ~full[:-1]
    stops = full.copy()
    stops[:-1] &= ~full[1:]
    inner = ends[(ends > 0) & (ends < len(data))]
    begins[inner] = full[inner]
    stops[inner - 1] = full[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1 - starts


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(data) + 1,), strides=(1,))


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers with all bits stirred."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def word_hashes(at: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes eight at a time; at: eights() of the data."""
    h = mixed((lengths.astype(np.uint64) + np.uint64(1)) * _ODD)
    each, step = np.arange(len(starts)), 0
    while len(each):
        part = at[starts[each] + step] & _MASKS[np.minimum(lengths[each] - step, 8)]
        h[each] = mixed(h[each] ^ part)
        step += 8
        each = each[lengths[each] > step]
    return h


def same_words(at: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[i] have the same bytes."""
    same = lengths[a] == lengths[b]
    each, step = np.flatnonzero(same), 0
    while len(each):
        x, y = a[each], b[each]
        mask = _MASKS[np.minimum(lengths[x] - step, 8)]
        equal = (at[starts[x] + step] & mask) == (at[starts[y] + step] & mask)
        same[each[~equal]] = False
        step += 8
        each = each[equal & (lengths[x] > step)]
    return same


def distinct_words(data: np.ndarray, at: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """How many different words each of `texts` texts has; owner: the text of each word, in order.

    Words are sorted by text and hash. Neighbours with one hash are compared byte by byte; a text in
    which two of them differ is counted anew by its words themselves.
    """
    h = word_hashes(at, starts, lengths)
    bits = max(1, int(texts - 1).bit_length())
    key = (owner.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits))
    order = np.argsort(key)
    key = key[order]
    again = np.flatnonzero(key[1:] == key[:-1]) + 1
    count = np.bincount(owner, minlength=texts) - np.bincount(owner[order[again]], minlength=texts)
    wrong = ~same_words(at, starts, lengths, order[again], order[again - 1])
    for text in np.unique(owner[order[again[wrong]]]):
        own = np.flatnonzero(owner == text)
        count[text] = len({data[starts[w] : starts[w] + lengths[w]].tobytes() for w in own})
    return count


def sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the flags are set between neighbouring ends, from prefix sums."""
    upto = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=upto[1:])
    return upto[ends[1:]] - upto[ends[:-1]]
