"""Byte-pair encoding by speculation and verification.

Greedy longest match over the vocabulary proposes the tokens of each new word.
A proposal is what merging would give exactly if each pair of neighbours, put
together and merged by rank, falls apart into the same two tokens again.  Those
pair checks are looked up for whole batches of words at once in a table that
grows with the pairs met; only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kinfold.llm.common import arrow_columns

#: Characters that the pattern's \s stands for.
SPACE = "\t-\r \x85\xa0  -     　"

#: Letters and numbers that later editions of Unicode have assigned and the vocabulary's (16.0) does not know as such.
UNKNOWN = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Capitals of Unicode 16.0 and 17.0 with their small letters, which the library lowers.
LATER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Those of both within the basic plane, and whatever lies beyond it: searches that are quick.
_RARE = re.compile("[" + UNKNOWN[: UNKNOWN.index("\U000107bb")] + "".join(chr(c) for c in LATER if c < 0x10000) + "]")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_UNKNOWN = regex.compile(f"[{UNKNOWN}]")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where visible, else from U+0100 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    """Encoder and decoder for a vocabulary file of words with an end mark (JSON text of the file)."""

    def __init__(self, spec: str, cache: int = 500_000, pairs: int = 1_000_000):
        data = json.loads(spec)
        model, pre = data["model"], data["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in data["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"] or data["decoder"]:
            raise ValueError("not a word vocabulary of the kind this encoder reads")
        self.end = model["end_of_word_suffix"]
        pattern = pre[0]["pattern"]["Regex"].replace(r"^\s", f"^{SPACE}")
        self.pattern = regex.compile(pattern)
        known = {c: rf"[\p{{{c}}}--[{UNKNOWN}]]" for c in "LN"}  # for texts that hold unknown letters
        self.careful = regex.compile("(?V1)" + pattern.replace(r"\p{L}", known["L"]).replace(r"\p{N}", known["N"]))
        vocab, to_byte = model["vocab"], byte_symbols()
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.tokens: dict[int, str] = {}
        for token, i in vocab.items():
            self.tokens[i] = token
            last = token.endswith(self.end) and len(token) > len(self.end)
            body = token[: -len(self.end)] if last else token
            if all(c in to_byte for c in body):
                (self.final if last else self.inner)[bytes(to_byte[c] for c in body)] = i
        self.raw = {i: (b, last) for last, d in ((False, self.inner), (True, self.final)) for b, i in d.items()}
        self.most = max(map(len, self.final), default=0)
        self.longest: dict[bytes, int] = {}  # of the inner tokens that start with four given bytes
        for raw in self.inner:
            if len(raw) >= 4:
                self.longest[raw[:4]] = max(self.longest.get(raw[:4], 1), len(raw))
        self.ranks: dict[int, int] = {}  # by both ids of a pair in one number
        self.merged: list[int] = []  # by rank
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 20 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens |= {i: c for c, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.cache, self.pairs = cache, pairs
        self.known = np.empty(0, np.int64)  # pairs checked so far, in order
        self.fits = np.empty(0, bool)
        self.failed = 0  # words merged exactly

    def merge(self, ids: list[int]) -> list[int]:
        """Merge by rank, leftmost first among equals, in n log n."""
        n, ids, none = len(ids), list(ids), len(self.merged)
        get, merged = self.ranks.get, self.merged
        if n <= 40:  # a scan of all ranks each time is quicker than a heap
            ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
            while ranks and (r := min(ranks)) != none:
                i = ranks.index(r)
                ids[i : i + 2] = [merged[r]]
                del ranks[i]
                if i:
                    ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
                if i < len(ranks):
                    ranks[i] = get(ids[i] << 20 | ids[i + 1], none)
            return ids
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = merged[r], False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for p, q in ((left[i], i), (i, right[i])):
                if p >= 0 and q >= 0 and (r := get(ids[p] << 20 | ids[q])) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def symbols(self, raw: bytes, last: bool) -> list[int]:
        out = [self.inner[raw[i : i + 1]] for i in range(len(raw) - last)]
        return [*out, self.final[raw[-1:]]] if last else out

    def propose(self, raw: bytes) -> list[int]:
        """Greedy longest match; only the last token may carry the end mark."""
        out, i, n, inner, final, longest = [], 0, len(raw), self.inner, self.final, self.longest
        while i < n:
            if n - i <= self.most and (t := final.get(raw[i:])) is not None:
                out.append(t)
                break
            k = min(longest.get(raw[i : i + 4], 3), n - 1 - i)
            while (t := inner.get(raw[i : i + k])) is None:
                k -= 1
            out.append(t)
            i += k
        return out

    def stands(self, a: int, b: int) -> bool:
        """Whether a and b, put together and merged, fall into a and b again (b == a stands for a alone if b is -1)."""
        if b < 0:
            return self.merge(self.symbols(*self.raw[a])) == [a]
        (x, _), (y, last) = self.raw[a], self.raw[b]
        return self.merge(self.symbols(x, False) + self.symbols(y, last)) == [a, b]

    def learn(self, words: set[str]) -> None:
        """Encode words not met before and keep their tokens."""
        todo = list(words)
        raws = [w.encode() for w in todo]
        proposals = [self.propose(r) for r in raws]
        size = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(size.sum()))
        ends = np.cumsum(size) - 1
        follow = np.empty_like(flat)
        follow[:-1] = flat[1:]
        follow[ends] = -1
        follow[ends[size > 1]] = -2  # the last of several has been tested with the one before
        keys = (flat << 20) + follow + 2
        pairs = np.unique(keys[follow != -2])
        at = np.searchsorted(self.known, pairs)
        new = pairs[(at >= len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != pairs)] if len(self.known) else pairs
        if len(self.known) + len(new) > self.pairs:
            self.known, self.fits, new = np.empty(0, np.int64), np.empty(0, bool), pairs
        if len(new):
            fits = np.fromiter((self.stands(int(k) >> 20, (int(k) & 0xFFFFF) - 2) for k in new), bool, len(new))
            order = np.argsort(both := np.concatenate([self.known, new]), kind="stable")
            self.known, self.fits = both[order], np.concatenate([self.fits, fits])[order]
        ok = np.ones(len(flat), bool)
        tested = follow != -2
        ok[tested] = self.fits[np.searchsorted(self.known, keys[tested])]
        starts = ends - size + 1
        good = np.logical_and.reduceat(ok, starts) if len(starts) else ok
        for w, raw, ids, g in zip(todo, raws, proposals, good.tolist(), strict=True):
            if not g:
                self.failed += 1
                ids = self.merge(self.symbols(raw, True))
            self.words[w] = tuple(ids)

    def pieces(self, text: str) -> list:
        """The text's words, and ids for control strings, in order."""
        if self.split is None or not any(s in text for s in self.special):
            return self.words_of(text)
        out: list = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.words_of(part)
        return out

    def words_of(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        try:
            text.encode("latin-1")
            return self.pattern.findall(text)
        except UnicodeEncodeError:
            if not _RARE.search(text) and not _BEYOND.search(text):
                return self.pattern.findall(text)
        text = text.translate(LATER)
        return (self.careful if _UNKNOWN.search(text) else self.pattern).findall(text)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        flat, sizes = [], []
        for lo in range(0, len(texts), 200):
            docs = [self.pieces(t or "") for t in texts[lo : lo + 200]]
            need = {w for d in docs for w in d if w.__class__ is str}
            new = need.difference(self.words)
            if len(self.words) + len(new) > self.cache // 2:  # words not met again since the last time go
                self.older, self.words, new = self.words, {}, need
            met = [w for w in new if w in self.older]
            self.words.update({w: self.older[w] for w in met})
            if len(met) < len(new):
                self.learn(new.difference(met))
            get = self.words
            for d in docs:
                try:
                    ids = list(chain.from_iterable(map(get.__getitem__, d)))
                except KeyError:  # control strings stand as ids
                    ids = list(chain.from_iterable([get[w] if w.__class__ is str else (w,) for w in d]))
                sizes.append(len(ids))
                flat.append(np.array(ids, np.int32))
        return np.concatenate([np.empty(0, np.int32), *flat]), np.array(sizes, np.int64)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a vocabulary without decoder has it; unknown ids give nothing."""
        get = self.tokens.get
        return " ".join([t for i in ids if (t := get(i)) is not None])


_MODELS: dict[tuple[int, int], WordBpe] = {}


def model_of(spec: str, cache: int = 500_000) -> WordBpe:
    """The encoder of a vocabulary, with the words it has met; a worker process keeps it from task to task."""
    key = hash(spec), cache
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = WordBpe(spec, cache)
    return _MODELS[key]


def encode(df: DataFrame, spec_path: str, text_col: str = "text", out: str = "ids", keep: list[str] | None = None, cache: int = 500_000) -> DataFrame:
    """df with the token ids of text_col, an array of int; a worker process keeps the tokens of ``cache`` words at most.

    A null or empty text has no ids.  The vocabulary is read on the driver
    (spec_path is a local file there) and sent along; it has the size of the file.
    """
    with open(spec_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        bpe = model_of(spec.value, cache)

        def fn(texts: pa.Array) -> list:
            flat, sizes = bpe.encode_batch(texts.to_pylist())
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]

        return fn

    return arrow_columns(df, [text_col], T.StructType([T.StructField(out, T.ArrayType(T.IntegerType()))]), make, keep)


def decode(df: DataFrame, spec_path: str, ids_col: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """df with the text of ids_col, with control strings; null or no ids give an empty text."""
    with open(spec_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        bpe = model_of(spec.value)
        top = max(bpe.tokens) + 1
        names = pa.array([bpe.tokens.get(i) for i in range(top)], pa.string())

        def fn(ids: pa.ListArray) -> list:
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            if ids.null_count or len(flat) and (flat.dtype.kind != "i" or flat.min() < 0 or flat.max() >= top or len(bpe.tokens) < top):
                return [[bpe.decode(x or []) for x in ids.to_pylist()]]
            sizes = pc.list_value_length(ids).to_numpy()
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            return [pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(pa.array(flat))), " ")]

        return fn

    return arrow_columns(df, [ids_col], T.StructType([T.StructField(out, T.StringType())]), make, keep, rows=500)
