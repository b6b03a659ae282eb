"""Benchmark decontamination: containment of short test items in long documents.

A MinHash that compares two whole sets loses short items in long documents.
Here only the items are sampled: an item's signature is its bottom-k shingles by
hash, and each is looked up among a document's shingles, however many those are.
Items are partitioned by size; a partition's k is one more than the number of
shingles that an item of its largest size may miss.  An item contained to the
threshold therefore has a signature shingle in the document, so that the
search loses nothing.  Candidates are then verified by exact containment.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.anchors import written
from kinfold.llm.common import WordHashes, arrow_columns, mix, window_hashes

#: Words are runs of letters, marks and digits of the lower-cased text.
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
#: Lower ends of the size partitions, in shingles.
SIZES = (1, 8, 16, 32, 64, 128, 256, 512, 1024)


def word_hashes(text: str | None, hashes: WordHashes) -> np.ndarray:
    return hashes.of(WORD.findall((text or "").lower()))


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct hashes of runs of ``size`` words, or of all words where there are fewer; no words have none."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(words, min(size, len(words))))


@dataclass
class ItemIndex:
    """Items as arrays: the signature shingles in order with their items, and every item's shingles."""

    ids: np.ndarray
    widths: np.ndarray  # words in an item's shingles
    need: np.ndarray  # shingles that a document has to hold
    keys: np.ndarray  # signature shingles, in order
    item_of: np.ndarray  # item of each key
    sets: list[np.ndarray]

    @classmethod
    def build(cls, ids: list[int], texts: list[str | None], threshold: float, size: int) -> ItemIndex:
        hashes = WordHashes()
        keep, sets, widths, need, keys, owner = [], [], [], [], [], []
        for i, t in zip(ids, texts, strict=True):
            words = word_hashes(t, hashes)
            s = shingles(words, size)
            if i is None or not len(s):
                continue
            largest = next((hi - 1 for hi in SIZES[1:] if len(s) < hi), len(s))
            k = min(len(s), largest - math.ceil(threshold * largest - 1e-9) + 1)
            signature = s[np.argsort(mix(s))[:k]]
            keys.append(signature)
            owner.append(np.full(k, len(keep)))
            keep.append(i)
            sets.append(s)
            widths.append(min(size, len(words)))
            need.append(math.ceil(threshold * len(s) - 1e-9))
        all_keys = np.concatenate([np.empty(0, np.uint64), *keys])
        order = np.argsort(all_keys, kind="stable")
        return cls(np.array(keep, np.int64), np.array(widths, np.int64), np.array(need, np.int64), all_keys[order], np.concatenate([np.empty(0, np.int64), *owner])[order], sets)

    def bytes(self) -> int:
        return sum(s.nbytes for s in self.sets) + self.keys.nbytes * 2

    def search(self, words: np.ndarray) -> list[tuple[int, int, float]]:
        """(item id, shingles shared, containment) of every item contained to the threshold."""
        out = []
        for width in np.unique(self.widths).tolist():
            runs = window_hashes(words, width)
            if not len(runs) or not len(self.keys):
                continue
            at = np.searchsorted(self.keys, runs)
            hit = np.unique(runs[self.keys[np.minimum(at, len(self.keys) - 1)] == runs])
            if not len(hit):
                continue
            lo, hi = np.searchsorted(self.keys, hit, "left"), np.searchsorted(self.keys, hit, "right")
            items = {int(self.item_of[k]) for a, b in zip(lo, hi, strict=True) for k in range(a, b)}
            whole = np.unique(runs) if any(self.widths[i] == width for i in items) else runs
            for i in items:
                if self.widths[i] == width and (n := int(np.isin(self.sets[i], whole, assume_unique=True).sum())) >= self.need[i]:
                    out.append((int(self.ids[i]), n, n / len(self.sets[i])))
        return sorted(out)


def contained(
    docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5, text_col: str = "text", keep: list[str] | None = None,
    item_id: str = "item_id", item_text: str = "text", block_items: int = 20_000, block_bytes: int = 1 << 26,
) -> DataFrame:
    """docs with matches: an array of (item_id, shared, containment) of each item whose distinct word shingles it holds to the threshold.

    Shingles are runs of ``size`` words, for shorter items runs of all their words.
    Items without words or with a null id match nothing; a null or empty document
    matches nothing.  Items are searched in blocks of about ``block_items`` items and
    ``block_bytes`` bytes of shingles at most, so that what is sent to the tasks is
    bounded, however many items there are; each block is one more pass over the
    documents, written before the next block is sent.
    """
    row = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("shared", T.IntegerType()), T.StructField("containment", T.DoubleType())])
    out = T.StructType([T.StructField("matches", T.ArrayType(row))])
    chosen = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    total = chosen.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    blocks = max(1, math.ceil(total["n"] / block_items), math.ceil(16 * total["chars"] / block_bytes))  # a word has two characters at least, and up to three hashes
    block = F.pmod(F.xxhash64("i"), F.lit(blocks))
    found = docs.drop("matches")
    for b in range(blocks):
        rows = chosen.where((block == b) | (F.col("i").isNull() & F.lit(b == 0))).collect()
        index = ItemIndex.build([r["i"] for r in rows], [r["t"] for r in rows], threshold, size)
        if len(rows) > 1 and index.bytes() > 4 * block_bytes:
            raise ValueError(f"a block of {len(rows)} items has {index.bytes()} bytes; lower block_items")
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def make(sent=sent):
            hashes = WordHashes()

            def fn(texts: pa.Array) -> list:
                index = sent.value
                return [[[dict(zip(("item_id", "shared", "containment"), m, strict=True)) for m in index.search(word_hashes(t, hashes))] for t in texts.to_pylist()]]

            return fn

        name = "matches" if blocks == 1 else f"__matches_{b}"
        named = T.StructType([T.StructField(name, out["matches"].dataType)])
        found = arrow_columns(found, [text_col], named, make, None if keep is None or b < blocks - 1 else [*keep, *[f"__matches_{i}" for i in range(b)]])
        if blocks > 1:
            found = written(found)
            sent.unpersist()
    if blocks > 1:
        found = found.withColumn("matches", F.array_sort(F.concat(*[f"__matches_{b}" for b in range(blocks)]))).drop(*[f"__matches_{b}" for b in range(blocks)])
    return found


