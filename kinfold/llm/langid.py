"""Language identification with spans of mixed texts.

The scripts of its letters narrow a word's languages; each language scores the
word by its letter trigrams; and the best path through the words, at a penalty
for each change of language, gives spans.  A text's language is the one with
the most letters in its spans.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.common import arrow_columns, bounded_sample

#: The first code points of script ranges, and the script of each range.
SCRIPT_STARTS = np.array([0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0x980, 0xE00, 0xE80, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000, 0x323B0])
SCRIPTS = ["latin", "greek", "cyrillic", "other", "hebrew", "arabic", "other", "devanagari", "other", "thai", "other", "hangul", "other", "latin", "greek", "other", "kana", "other", "han", "other", "hangul", "other", "han", "other", "han", "other"]
SCRIPT_NAMES = sorted(set(SCRIPTS))
SCRIPT_OF = np.array([SCRIPT_NAMES.index(s) for s in SCRIPTS])
#: The score of a word in a language that its script rules out.
NEVER = -1e6
_ALPHA: list[np.ndarray] = []


def letters_of(code: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _ALPHA[0][code]


def cut(texts: list[str]) -> tuple[np.ndarray, ...]:
    """All texts in one array of code points, lower case, each after a 0: (codes, is letter, text's start)."""
    lowered = [t.lower() if len(t.lower()) == len(t) else "".join(x if len(x := c.lower()) == 1 else c for c in t) for t in texts]
    whole = "\0" + "\0".join(lowered) + "\0"
    code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, lowered), np.int64, len(lowered))
    starts = 1 + np.cumsum(size + 1) - size - 1
    return code, letters_of(code), starts


def trigram_slots(code: np.ndarray, letter: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """A slot of 2**bits for the trigram around each letter; what is no letter counts as 0."""
    c = np.where(letter, code, 0).astype(np.uint64)
    key = (c[at - 1] << np.uint64(42)) | (c[at] << np.uint64(21)) | c[at + 1]
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class LanguageModel:
    langs: list[str]
    bits: int
    table: np.ndarray  # slot, language: log probability
    scripts: np.ndarray  # script, language: whether the language is written so
    switch: float = 12.0

    def candidates(self, mask: int) -> np.ndarray:
        """The languages written in all scripts of a mask; where there are none, in any of them; where there are none, all."""
        used = self.scripts[[bool(mask >> i & 1) for i in range(len(SCRIPT_NAMES))]]
        found = np.flatnonzero(used.all(axis=0))
        found = found if len(found) else np.flatnonzero(used.any(axis=0))
        return found if len(found) else np.arange(len(self.langs))

    def label(self, texts: list[str | None]) -> tuple:
        """For each text: language, score, and spans (start, end, language) in code points."""
        texts = [t or "" for t in texts]
        parts = [self.words(texts[i : i + 100]) for i in range(0, len(texts), 100)]
        word_of = [np.concatenate(x) for x in zip(*parts, strict=True)]
        start, end, size, emit, n_words = word_of
        state = viterbi(emit, n_words, self.switch) if len(emit) else np.empty(0, np.int64)
        first = np.cumsum(n_words) - n_words
        doc = np.repeat(np.arange(len(texts)), n_words)
        share = np.zeros((len(texts), len(self.langs)))
        np.add.at(share, (doc, state), size)
        best, letters = share.argmax(axis=1), share.sum(axis=1)
        new = np.ones(len(state), bool)
        new[1:] = (state[1:] != state[:-1]) | (doc[1:] != doc[:-1])
        runs = np.flatnonzero(new)
        lasts = np.append(runs[1:], len(state))[: len(runs)] - 1
        n_spans = np.bincount(doc[runs], minlength=len(texts))
        known = n_words > 0
        lang = [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
        score = np.where(known, share.max(axis=1) / np.maximum(letters, 1), 0.0)
        return lang, score, n_spans, start[runs], end[lasts], [self.langs[s] for s in state[runs]], first

    def words(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Of each run of letters: start, end (in its text), letters, score by language; and the runs of each text.

        Only the languages that the scripts leave score a word; all others have NEVER.
        """
        code, letter, starts = cut(texts)
        at = np.flatnonzero(letter)
        if not len(at):
            none = np.empty(0, np.int64)
            return none, none, none, np.empty((0, len(self.langs)), np.float32), np.zeros(len(texts), np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        script = SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, code[at], side="right") - 1]
        slots, masks = trigram_slots(code, letter, at, self.bits), np.bitwise_or.reduceat(1 << script, first)
        size = np.diff(np.append(first, len(at)))
        emit = np.full((len(first), len(self.langs)), NEVER, np.float32)
        for mask in np.unique(masks).tolist():
            rows, chosen = np.flatnonzero(masks == mask), self.candidates(mask)
            own = slots if len(rows) == len(first) else slots[np.repeat(masks == mask, size)]
            heads = np.cumsum(size[rows]) - size[rows]
            emit[rows[:, None], chosen] = np.add.reduceat(self.table[own[:, None], chosen], heads, axis=0)
        begin = at[first]
        doc = np.searchsorted(starts, begin, side="right") - 1
        start = begin - starts[doc]
        return start, start + size, size, emit, np.bincount(doc, minlength=len(texts))


def viterbi(emit: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """The best state of each step of all sequences, in lockstep over sequences, longest first."""
    first, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
    begin, steps = first[order], sizes[order]
    longest = int(steps[0]) if len(steps) else 0
    active = np.searchsorted(-steps, -np.arange(longest), side="left")  # sequences with more than t steps
    back = np.full(emit.shape, -1, np.int32)  # -1: stay
    value, out = emit[begin[: active[0]]].astype(float), np.empty(len(emit), np.int64)
    final = np.zeros(len(steps), np.int64)
    for t in range(1, longest + 1):
        k = active[t] if t < longest else 0
        if k < len(value):
            final[k : len(value)] = value[k:].argmax(axis=1)
            value = value[:k]
        if not k:
            break
        top = value.argmax(axis=1)
        jump = value[np.arange(k), top] - switch
        stay = value >= jump[:, None]
        at = begin[:k] + t
        back[at] = np.where(stay, -1, top[:, None])
        value = np.where(stay, value, jump[:, None]) + emit[at]
    state = final.copy()
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at, now = begin[:k] + t, state[:k]
        out[at] = now
        b = back[at, now]
        state[:k] = np.where(b < 0, now, b)
    return out


def train(docs: DataFrame, rows: int = 8_000, bits: int = 17, switch: float = 12.0) -> LanguageModel:
    """A model from texts with a language (doc_id, text, lang); rows with either null are left out.

    The fit uses a sample of about ``rows`` rows, by the hash of doc_id, and their whole texts.
    What reaches the driver is one count for each language and trigram slot (2**bits).
    Without rows the model knows no language and calls every text ``und``.
    """
    some = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    some = bounded_sample(some, "doc_id", rows)
    out = "lang string, kind int, slot long, n long"

    def count(batches):
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, text in zip(langs, texts, strict=True):
                code, letter, _ = cut([text])
                at = np.flatnonzero(letter)
                script = SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, code[at], side="right") - 1]
                for kind, slots, n in ((0, trigram_slots(code, letter, at, bits), 1 << bits), (1, script, len(SCRIPT_NAMES))):
                    if (lang, kind) not in total:
                        total[lang, kind] = np.zeros(n, np.int64)
                    total[lang, kind] += np.bincount(slots, minlength=n)
        for (lang, kind), c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(c[at])], names=["lang", "kind", "slot", "n"]
            )

    got = some.select("lang", "text").mapInArrow(count, out).groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique().tolist())
    table = np.full((1 << bits, len(langs)), 0.3)
    scripts = np.zeros((len(SCRIPT_NAMES), len(langs)))
    code = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)
    kind, slot, n = got["kind"].to_numpy(), got["slot"].to_numpy(), got["n"].to_numpy(float)
    np.add.at(table, (slot[kind == 0], code[kind == 0]), n[kind == 0])
    np.add.at(scripts, (slot[kind == 1], code[kind == 1]), n[kind == 1])
    used = (scripts >= 0.01 * scripts.sum(axis=0)) & (scripts > 0)
    return LanguageModel(langs, bits, (np.log(table) - np.log(table.sum(axis=0))).astype(np.float32), used, switch)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score (share of the letters) and spans (start, end, lang; code points, end exclusive).

    Texts that are null or hold no letter are ``und`` with score 0 and no spans.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    out = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])

    def make():
        def fn(texts: pa.Array) -> list:
            if not sent.value.langs:
                return [["und"] * len(texts), [0.0] * len(texts), [[]] * len(texts)]
            lang, score, n, start, end, names, _ = sent.value.label(texts.to_pylist())
            flat = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(names, pa.string())], names=["start", "end", "lang"])
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            return [lang, pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), flat)]

        return fn

    return arrow_columns(docs, [text_col], out, make, keep, rows=4000)
