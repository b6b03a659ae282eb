"""Suffix-array dedup by merging the Burrows-Wheeler transforms of shards.

Each shard of texts has its own suffix order and transform.  Shards are merged
by refining their interleave: before step h all suffixes stand in the order of
their first h bytes, equals in the order of shards; reading each one's preceding
byte from its shard's transform and sorting stably by it gives the order by h + 1 bytes.
Only intervals that still hold several suffixes are refined.  The last step at which
a suffix shares its interval is the length of its longest common prefix with any
other, and an interval that is left after W steps is a repeat of W bytes.  No suffixes
of different shards are ever compared or sorted anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.anchors import BYTE_ITEMS, covered, keyed, repeated_windows
from kinfold.llm.common import arrow_columns

WINDOW, ANCHOR = 100, 32


def suffix_order(text: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a shard by their first ``depth`` bytes, from eight-byte keys by doubling; room is each suffix's length in its own text."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for j in range(8):
        key |= np.where(room > j, padded[j : j + n], np.uint64(0)) << np.uint64(56 - 8 * j)
    size = 8
    while True:
        order = np.argsort(key)
        step = np.empty(n, bool)
        step[:1], step[1:] = True, key[order[1:]] != key[order[:-1]]
        if size >= depth or step.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(step)
        after = np.zeros(n, np.uint64)
        after[:-size] = np.where(room[:-size] > size, rank[size:], np.uint64(0))
        key = (rank << np.uint64(32)) | after
        size *= 2


class Shard:
    """A shard's transform: the byte before each suffix in their order, where that longer suffix stands, and how far the suffix lies in its own text.

    ``before8`` and ``back8`` say the same of the eight bytes before, the nearest in the lowest byte.
    """

    def __init__(self, text: np.ndarray, room: np.ndarray, inside: np.ndarray, depth: int):
        self.order = suffix_order(text, room, depth)
        place = np.empty(len(text), np.int32)
        place[self.order] = np.arange(len(text), dtype=np.int32)
        self.inside = inside[self.order]
        self.before = text[self.order - 1]  # read only for suffixes that do not begin their text
        self.back = place[self.order - 1]
        eight = np.zeros(len(text), np.uint64)
        for j in range(1, 9):
            eight |= np.roll(text, j).astype(np.uint64) << np.uint64(8 * (j - 1))
        self.before8, self.back8 = eight[self.order], place[self.order - 8] if len(text) >= 8 else self.back


def repeated_intervals(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes (numbered through all shards, in shard order) whose first ``depth`` bytes repeat, their interval numbers, and common prefixes.

    Only suffixes with ``depth`` bytes before them start: what they reach has that many bytes after it.
    The common prefixes are the most bytes, ``depth`` at most, that each suffix shares with any other,
    counting strings that end ``depth`` bytes or more after the start of their text.
    An interval of two stands in its order already: its suffixes only have to agree in the byte before.
    """
    offset = np.cumsum([0] + [len(s.order) for s in shards])
    before, before8, inside = (np.concatenate([getattr(s, f) for s in shards]) for f in ("before", "before8", "inside"))
    back, back8 = (np.concatenate([getattr(s, f) + np.int32(o) for s, o in zip(shards, offset, strict=False)]) for f in ("back", "back8"))
    text_at = np.concatenate([s.order + o for s, o in zip(shards, offset, strict=False)])
    at = np.flatnonzero(inside >= depth).astype(np.int32)  # the interleave before the first step: shard after shard
    block = np.zeros(len(at), np.int32)
    twos: list[np.ndarray] = []
    left: list[tuple[np.ndarray, np.ndarray | int]] = []  # places in the text of strings that are shared so far and no farther, and their lengths

    def refine_pairs(pairs: np.ndarray, have: int) -> np.ndarray:
        """Intervals of two, of ``have`` bytes, to the full depth."""
        while have < depth and len(pairs):
            step = min(8, depth - have)
            unlike = (before8[pairs[:, 0]] ^ before8[pairs[:, 1]]) & np.uint64((1 << (8 * step)) - 1)
            if unlike.any():
                apart = unlike != 0
                same = sum(((unlike[apart] & np.uint64((1 << (8 * k)) - 1)) == 0).astype(np.int64) for k in range(1, 8))  # bytes nearest to the suffix
                left.append(((text_at[pairs[apart]] - same[:, None]).ravel(), np.repeat(have + same, 2)))
                pairs = pairs[~apart]
            if step == 8:
                pairs = back8[pairs]
            else:
                for _ in range(step):
                    pairs = back[pairs]
            have += step
        return pairs

    for step in range(1, depth + 1):
        if not len(at):
            break
        byte = before[at]
        order = np.argsort(byte, kind="stable")
        was, block, byte = at[order], block[order], byte[order]
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = (byte[1:] != byte[:-1]) | (block[1:] != block[:-1])
        single = new[:-1] & new[1:]
        left.append((text_at[was[single]], step - 1))
        block = np.cumsum(new[:-1], dtype=np.int32)
        at = back[was]
        if step % 4:
            at, block = at[~single], block[~single]
            continue
        size = np.bincount(block)[block]
        twos.append(refine_pairs(at[size == 2].reshape(-1, 2), step))
        at, block = at[size > 2], block[size > 2]
    pairs = np.concatenate([np.empty((0, 2), np.int32), *twos])
    found = np.concatenate([at, pairs.ravel()])
    block = np.concatenate([block, np.repeat(np.arange(len(pairs)), 2) + (int(block.max()) + 1 if len(block) else 0)])
    left.append((text_at[found], depth))
    place, length = np.concatenate([x for x, _ in left]), np.concatenate([np.broadcast_to(h, len(x)) for x, h in left])
    reach = np.zeros(len(before), np.int64)  # where the shared string ends that begins here
    np.maximum.at(reach, place, place + length)
    prefixes = np.maximum(np.maximum.accumulate(reach) - np.arange(len(reach)), 0)
    return text_at[found], block, prefixes


def resolve(contexts: list[tuple[int, np.ndarray]], roles: list[int] | None = None, shard_bytes: int = 1 << 16) -> list[np.ndarray]:
    """Which windows of each context occur earlier, in the order in which the contexts come; all contexts are looked at, whatever their roles.

    A byte more stands at each context's end: the steps go from a suffix to the longer one
    before it, so that a suffix of W bytes is reached after W steps from the empty one.
    """
    sizes = np.array([len(x) + 1 for _, x in contexts], np.int64)
    ends = np.cumsum(sizes)
    text = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for (_, x), e in zip(contexts, ends.tolist(), strict=True):
        text[e - 1 - len(x) : e - 1] = x
    inside = np.arange(len(text)) - np.repeat(ends - sizes, sizes)
    room = np.repeat(sizes, sizes) - inside
    cuts = [0]
    for e in ends.tolist():
        if e - cuts[-1] >= shard_bytes or e == len(text):
            cuts.append(e)
    shards = [Shard(text[a:b], room[a:b], inside[a:b], WINDOW) for a, b in zip(cuts, cuts[1:], strict=False)]
    marks = np.zeros(len(text), bool)
    if shards:
        found, block, prefixes = repeated_intervals(shards, WINDOW)
        marks[prefixes >= WINDOW] = True  # of an interval, all but its first suffix stay marked
        heads = np.flatnonzero(np.diff(block, prepend=-1))
        marks[np.minimum.reduceat(found, heads) if len(heads) else heads] = False
    return [marks[e - n : e - WINDOW] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def byte_items(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return BYTE_ITEMS[raw], starts


def raw_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): the bytes of texts without those of repeated 100-byte strings.

    A byte goes if a 100-byte string over it starts earlier too: in a document of
    smaller id, or before in its own.  Strings are judged on the input and never
    cross documents.  Null and empty texts keep no byte.  A null id is smaller than all others.
    """
    base, once = keyed(docs, id_col, text_col)
    found = repeated_windows(once, byte_items, resolve, WINDOW, ANCHOR, within=True, batch_bytes=1 << 18, body=raw_bytes)
    whole = base.join(found.hint("shuffle_hash"), ["d", "t"], "left").select("d", "text", "ranges")
    out = T.StructType([T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())])

    def make():
        def fn(texts: pa.Array, ranges: pa.Array) -> list:
            rows = []
            for text, r in zip(texts.to_pylist(), ranges.to_pylist(), strict=True):
                raw = text.encode()
                if not r:
                    rows.append((len(raw), 0, 0, raw))
                    continue
                gone = covered(r, len(raw), WINDOW)
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                rows.append((len(raw), int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]

        return fn

    done = arrow_columns(whole, ["text", "ranges"], out, make, keep=["d"], rows=500)
    return done.select(F.when(F.col("d") > -(1 << 63), F.col("d")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


