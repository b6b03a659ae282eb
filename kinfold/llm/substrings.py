"""Substring dedup by suffix automata of reference shards.

A reference shard is a bounded batch of contexts that share anchors, or the
first document, with those looked up in it; its automaton keeps with each state the
first document that holds the state's strings.  Contexts are streamed through it for
matching statistics, and a window is removed whose match reaches the threshold in an
earlier document.  Shards go only to the tasks whose documents share their anchors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.anchors import BYTE_ITEMS, Hashes, covered, keyed, repeated_windows
from kinfold.llm.common import arrow_columns, mix

WINDOW, ANCHOR = 50, 10
#: Which bytes are no ASCII white space.
NO_SPACE = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class SuffixAutomaton:
    """The automaton of several sequences, added in the order of their documents."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]

    def add(self, sequence: list[int], doc: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:  # an earlier sequence holds this one's suffix, but in a longer state: part it
                last = self._clone(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            first.append(doc)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        self.first.append(self.first[q])
        link.append(link[q])
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def repeats(self, sequence: list[int], doc: int, window: int) -> list[bool]:
        """For each window of the sequence, whether a document before ``doc`` holds it."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state, have, out = 0, 0, []
        for j, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                have = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                have += 1
            while link[state] >= 0 and length[link[state]] >= window:  # the state of the last ``window`` items
                state = link[state]
                have = min(have, length[state])
            if j >= window - 1:
                out.append(have >= window and first[state] < doc)
        return out


def resolve(contexts: list[tuple[int, np.ndarray]], roles: list[int] | None = None) -> list[np.ndarray]:
    """Which windows of each context an earlier document's context holds; roles: 0 for the shard's contexts, 1 for those streamed through it, 2 for both."""
    roles = roles or [2] * len(contexts)
    automaton = SuffixAutomaton()
    names: dict[int, int] = {}
    sequences = [[names.setdefault(v, len(names)) for v in x.tolist()] for _, x in contexts]
    for (doc, _), s, role in zip(contexts, sequences, roles, strict=True):
        if role != 1:
            automaton.add(s, doc)
    none = np.zeros(0, bool)
    return [np.array(automaton.repeats(s, doc, WINDOW), bool) if role else none for (doc, _), s, role in zip(contexts, sequences, roles, strict=True)]


def word_items(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts that lie one after the other in raw, each from its start on; and where each text's words start."""
    letter = np.concatenate([NO_SPACE[raw], [False]])
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    after = np.concatenate([[False], letter[:-1]]) & ~edge  # whether the byte before belongs to the same text and to a word
    begin = np.flatnonzero(letter & ~after)
    end = np.flatnonzero(np.concatenate([[False], letter[:-1]]) & (~letter | edge))
    size = (end - begin).astype(np.uint64)
    return mix(Hashes(BYTE_ITEMS[raw]).of(begin, end) + size), np.searchsorted(begin, starts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept): texts without the words of repeated 50-word windows, the kept ones joined by a space.

    Words are runs of anything but ASCII white space, unchanged.  A word goes if a
    window over it occurs in a document with a smaller id; windows are judged on the
    input.  Null and empty texts have no words.  A null id is smaller than all others.
    """
    base, once = keyed(docs, id_col, text_col)
    found = repeated_windows(once, word_items, resolve, WINDOW, ANCHOR, within=False)
    whole = base.join(found.hint("shuffle_hash"), ["d", "t"], "left").select("d", "text", "ranges")
    out = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def make():
        def fn(texts: pa.Array, ranges: pa.Array) -> list:
            n_words, n_removed, kept = [], [], []
            for text, r in zip(texts.to_pylist(), ranges.to_pylist(), strict=True):
                words = text.encode().split()
                n_words.append(len(words))
                if r:
                    gone = covered(r, len(words), WINDOW)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            return [n_words, n_removed, kept]

        return fn

    done = arrow_columns(whole, ["text", "ranges"], out, make, keep=["d"], rows=500)
    return done.select(F.when(F.col("d") > -(1 << 63), F.col("d")).alias(id_col), "n_words", "n_removed", "kept")
