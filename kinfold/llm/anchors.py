"""Finding where long runs of items repeat, over any number of documents.

A window is a run of W items.  Each window owns one anchor: the run of A items in
it with the smallest hash, the leftmost among equals.  Equal windows have equal
anchors, so that windows need comparing only under the same anchor.  Windows next
to each other with the same anchor form a context, and each window is in one.
Anchors and 128-bit content hashes only say which contexts are worth comparing;
what repeats is found by the operator's own structure, in batches of bounded size.

1. Anchors that occur once are dropped (counts are summed before they are shuffled).
2. Contexts with equal content form a class.  Its first and its last member, joined
   to runs with their neighbours of the same two documents, go through the structure
   (twins); what it marks in the last one holds for all members but the first.
3. Under anchors with several classes, the first members of all go through the
   structure together.
4. An anchor with more than ``hot`` classes, as at the ends of a passage that very many
   documents share, is split into its windows: those form
   classes of their own, whose twins decide them as in step 2.  No task holds such an anchor.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import BASE, checkpoint_dir, mix, slices, text_bytes

#: A second odd base, for hashes that are independent of the first ones.
OTHER = 0xD1342543DE82EF95
_INVERSES = {b: pow(b, -1, 1 << 64) for b in (BASE, OTHER)}
_POWERS: dict[int, np.ndarray] = {}
#: A 64-bit item for each byte.
BYTE_ITEMS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


class Hashes:
    """Polynomial hashes of any runs of one sequence, from prefix sums."""

    def __init__(self, x: np.ndarray, base: int = BASE):
        self.sums, self.inverse = np.zeros(len(x) + 1, np.uint64), _INVERSES[base]
        np.cumsum(x * powers(base, len(x)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(self.inverse, len(self.sums))[start])

    def runs(self, length: int) -> np.ndarray:
        """Of all runs of ``length`` items, from each item on."""
        h = self.sums[length:] - self.sums[:-length]
        h *= powers(self.inverse, len(h))
        return mix(h)


def contexts(x: np.ndarray, starts: np.ndarray, window: int, anchor: int, both: bool = True, piece: int = 1 << 23) -> tuple[np.ndarray, ...]:
    """Contexts of texts that lie one after the other in x, each from its start on (starts ends with len(x)).

    Of each: its text, the anchor's hash, two hashes of the content (only if ``both``, else the anchor's), its first window in the text, number of windows.
    """
    none = np.empty(0, np.int64)
    parts = []
    for at in range(0, max(1, len(x) - window + 1), piece):
        part = x[at : at + piece + window - 1]
        n = len(part) - window + 1
        if n <= 0:
            break
        hashes = Hashes(part)
        h = hashes.runs(anchor)
        low, span = np.uint64((1 << 24) - 1), window - anchor + 1
        least, size = h & ~low, 1
        least |= np.arange(len(h), dtype=np.uint64)
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:n], least[span - size : span - size + n])
        least &= low
        where = least.view(np.int64)
        a, b = np.searchsorted(starts, [at, at + n - 1], side="right") - 1
        cuts = starts[a : b + 2].clip(at, at + n) - at
        whole = np.arange(n) <= np.repeat(starts[a + 1 : b + 2] - window - at, np.diff(cuts))  # the window lies in one text
        edge = np.zeros(n, bool)
        edge[cuts[(cuts > 0) & (cuts < n)]] = True
        edge[1:] |= where[1:] != where[:-1]
        edge &= whole
        edge |= whole != np.concatenate([[False], whole[:-1]])
        edge = np.flatnonzero(edge)
        count = np.diff(np.append(edge, n))
        lo, count = edge[whole[edge]], count[whole[edge]]
        q, text = where[lo], np.searchsorted(starts, lo + at, side="right") - 1
        content = other = key = h[q]
        if both:
            shape = count.astype(np.uint64) * np.uint64(BASE) + (q - lo).astype(np.uint64)
            content = mix(hashes.of(lo, lo + count + window - 1) + shape)
            other = mix(Hashes(part, OTHER).of(lo, lo + count + window - 1) + shape)
        parts.append((text, key, content, other, lo + at - starts[text], count))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (none, *[none.astype(np.uint64)] * 3, none, none)


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared checkpoint folder, and read from there."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/kinfold-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")  # its shuffle files go when the table is there
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.kinfold_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing still to be computed reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.kinfold_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(d, t, text) of all rows, and of all documents: d is the id, the least long for null; t is 0 where ids are unique, else a hash of the text.

    Rows of one id with equal texts are one document; with different texts they are
    documents of their own, in the order of that hash.
    """
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    repeated = not docs.groupBy(d.alias("d")).count().where("count > 1").isEmpty()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(d.alias("d"), (F.xxhash64(text) if repeated else F.lit(0).cast("long")).alias("t"), text.alias("text"))
    return rows, written(rows.dropDuplicates(["d", "t"])) if repeated else rows


#: What an extracted row holds: kind 0, a context under its anchor ka; kind 1, a window with hashes kb and kc of the hot anchor ka;
#: kind 2, a run for the twins whose first member is in the document (ka, kb), of last members if kc is 1, with the classes of its contexts.
EXTRACTED = "d long, t long, kind int, ka long, kb long, kc long, lo int, n int, g int, body binary, classes array<struct<a:long,c:long,e:long,lo:int,n:int,flo:int,g:int>>"
#: Members of a class that one task joins to what was found for it, at about most.
GROUP = 4096


def repeated_windows(
    docs: DataFrame, items: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], resolve: Callable[[list, list], list], window: int, anchor: int,
    within: bool, hot: int = 512, batch_bytes: int = 1 << 20, body: Callable[[str], np.ndarray] | None = None,
) -> DataFrame:
    """(d, t, ranges) of documents (d, t, text), each there once, in which some window repeats an earlier one.

    ranges lists (start, end), end exclusive, of first items of such windows.
    Earlier is a smaller (d, t) or, if ``within``, the same document and an earlier start.
    items takes the bytes of texts in one array and where each starts (and the last one
    ends) to their 64-bit items in one array and where each text's items start.  resolve
    takes contexts (document number, item array) in the order of documents and starts,
    and whether each is asked about (1), only looked up (0) or both (2), and returns for
    each a boolean array: which of its windows repeat an earlier one.
    body, if given, takes a text to an array of smaller items that resolve reads instead.
    """

    def scan(both: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 500, 1 << 17):
                text, a, c, e, start, count = contexts(*items(*text_bytes(part.column(part.num_columns - 1))), window, anchor, both)
                hashes = [pa.array(x.view(np.int64)) for x in (a, c, e)]
                if not both:
                    yield pa.RecordBatch.from_arrays(hashes[:1], names=["a"])
                    continue
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), *hashes, pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["d", "t", "a", "c", "e", "lo", "n"],
                )

        return run

    rows = docs.select("d", "t", "text").mapInArrow(scan(True), "d long, t long, a long, c long, e long, lo int, n int")
    anchors = docs.select("text").mapInArrow(scan(False), "a long")
    # Tables are written before they are joined, so that both sides have shuffles of their own, which Spark can split at a hot anchor.
    counts = anchors.groupBy("a").count().where("count > 1")
    shared = written(counts.select("a", F.ceil(F.col("count") / GROUP).cast("int").alias("g")))
    rows = written(rows.join(shared.hint("shuffle_hash"), "a"))
    discard(shared)
    classes = written(_classes(rows, ["a", "c", "e"], F.any_value("n").alias("n"), F.any_value("g").alias("g")))
    crowds = written(classes.groupBy("a").count().where("count > 1").select("a", (F.col("count") > hot).cast("int").alias("kind")))
    alone = F.lit(None).cast("long")
    first = classes.join(crowds, "a").select("f.d", "f.t", _wanted(F.col("kind"), F.col("a"), alone, alone, F.col("f.lo"), F.col("n"), F.col("g")))
    got = _extract(docs, first.union(_twins(classes, within)), items, window, body)
    discard(classes, crowds)
    settled = written(_settle(got.where("kind = 2"), resolve, window, batch_bytes, body))
    open_ = _settle(got.where("kind = 0"), resolve, window, batch_bytes, body).select("d", "t", F.col("lo").alias("start"), F.col("n").alias("end"))
    marks = _spread(rows, settled, ["a", "c", "e"], within).union(open_)
    windows = got.where("kind = 1").select("d", "t", F.col("ka").alias("a"), F.col("kb").alias("c"), F.col("kc").alias("e"), "lo", "g")
    if not windows.isEmpty():
        classes = _classes(windows, ["a", "c", "e"], F.lit(1).alias("n"), F.any_value("g").alias("g"))
        found = _extract(docs, _twins(classes, within), items, window, body, few=True)
        settled = written(_settle(found, resolve, window, batch_bytes, body))
        marks = marks.union(_spread(windows, settled, ["a", "c", "e"], within))
    return marks.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def _classes(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Of each content the first and the last (d, t, lo)."""
    place = F.struct("d", "t", "lo")
    return rows.groupBy(*keys).agg(F.min(place).alias("f"), F.max(place).alias("l"), *more)


def _wanted(kind: Column, ka: Column, kb: Column, kc: Column, lo: Column, n: Column, g: Column, a=None, c=None, e=None, flo=None) -> Column:
    none, small = F.lit(None).cast("long"), F.lit(None).cast("int")
    parts = [kind.cast("int").alias("kind"), ka.alias("ka"), kb.alias("kb"), kc.alias("kc"), lo.alias("lo"), n.cast("int").alias("n"), g.alias("g")]
    rest = [(none if v is None else v).alias(k) for k, v in (("a", a), ("c", c), ("e", e))]
    return F.struct(*parts, *rest, (small if flo is None else flo).alias("flo")).alias("x")


def _twins(classes: DataFrame, within: bool) -> DataFrame:
    """(d, t, x): the first and the last member of classes whose last one may repeat the first."""
    apart = (F.col("f.d") != F.col("l.d")) | (F.col("f.t") != F.col("l.t"))
    if within:
        apart = apart | (F.col("f.lo") != F.col("l.lo"))
    two, kd, kt = F.lit(2), F.col("f.d"), F.col("f.t")
    first = F.struct(kd.alias("d"), kt.alias("t"), _wanted(two, kd, kt, F.lit(0).cast("long"), F.col("f.lo"), F.col("n"), F.col("g")))
    last = _wanted(two, kd, kt, F.lit(1).cast("long"), F.col("l.lo"), F.col("n"), F.col("g"), F.col("a"), F.col("c"), F.col("e"), F.col("f.lo"))
    last = F.struct(F.col("l.d").alias("d"), F.col("l.t").alias("t"), last)
    return classes.where(apart).select(F.explode(F.array(first, last)).alias("y")).select("y.d", "y.t", "y.x")


def _extract(docs: DataFrame, wanted: DataFrame, items: Callable, window: int, body: Callable | None, few: bool = False) -> DataFrame:
    """The content of what is wanted (d, t, x), cut from the documents: rows EXTRACTED.

    ``few`` writes what is wanted first, so that Spark knows its size and may send it to the documents rather than shuffle them.
    """
    asked = wanted.groupBy("d", "t").agg(F.collect_list("x").alias("xs"))
    asked = written(asked) if few else asked.hint("shuffle_hash")
    texts = docs.join(asked, ["d", "t"])
    types = [pa.int64()] * 2 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()]
    member = pa.struct([("a", pa.int64()), ("c", pa.int64()), ("e", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("flo", pa.int32()), ("g", pa.int32())])
    names = ["d", "t", "kind", "ka", "kb", "kc", "lo", "n", "g", "body", "classes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 50):
            xs = part.column(3)
            flat = xs.flatten()
            field = {f.name: flat.field(i).fill_null(0).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
            ends = np.cumsum(pc.list_value_length(xs).to_numpy())
            out: list[list] = [[] for _ in range(9)]
            bodies: list[bytes | None] = []
            member_of, sizes = [], []
            for row, end in enumerate(ends.tolist()):
                d, t, text = (part.column(i)[row].as_py() for i in range(3))
                at = np.arange(end - len(xs[row]), end)
                code = np.frombuffer(text.encode(), np.uint8)
                x = items(code, np.array([0, len(code)]))[0] if body is None or (field["kind"][at] == 1).any() else None
                raw = x if body is None else body(text)
                hot = at[field["kind"][at] == 1]
                if len(hot):
                    lo = np.concatenate([np.arange(s, s + n) for s, n in zip(field["lo"][hot], field["n"][hot], strict=True)])
                    k = len(lo)
                    hashes = [Hashes(x, b).of(lo, lo + window).view(np.int64) for b in (BASE, OTHER)]
                    for column, v in zip(out, ([d] * k, [t] * k, [1] * k, np.repeat(field["ka"][hot], field["n"][hot]), *hashes, lo, [1] * k, np.repeat(field["g"][hot], field["n"][hot])), strict=True):
                        column.append(np.asarray(v, np.int64))
                    bodies += [None] * k
                    sizes.append(np.zeros(k, np.int64))
                at = at[field["kind"][at] != 1]
                at = at[np.lexsort((field["lo"][at], field["kc"][at], field["kb"][at], field["ka"][at], field["kind"][at]))]
                lo, n = field["lo"][at].astype(np.int64), field["n"][at].astype(np.int64)
                new = np.ones(len(at), bool)
                new[1:] = (field["kind"][at[1:]] != 2) | (lo[1:] != lo[:-1] + n[:-1])
                for k in ("kind", "ka", "kb", "kc"):
                    new[1:] |= field[k][at[1:]] != field[k][at[:-1]]
                heads = np.flatnonzero(new)
                run_lo, size = lo[heads], np.diff(np.append(heads, len(at)))
                run_n = np.add.reduceat(n, heads) if len(heads) else n
                bodies += [raw[s : s + m + window - 1].tobytes() for s, m in zip(run_lo.tolist(), run_n.tolist(), strict=True)]
                k, keys = len(heads), at[heads]
                for column, v in zip(out, ([d] * k, [t] * k, *(field[f][keys] for f in ("kind", "ka", "kb", "kc")), run_lo, run_n, field["g"][keys]), strict=True):
                    column.append(np.asarray(v, np.int64))
                late = (field["kind"][at] == 2) & (field["kc"][at] == 1)
                member_of.append(at[late])
                sizes.append(np.where((field["kind"][keys] == 2) & (field["kc"][keys] == 1), size, 0))
            members = pa.array(np.concatenate(member_of)) if member_of else pa.array([], pa.int64())
            structs = pa.StructArray.from_arrays([pa.array(field[f.name]).take(members).cast(f.type) for f in member], names=[f.name for f in member])
            offsets = np.concatenate([[0], *map(np.asarray, sizes)]).astype(np.int64).cumsum()
            columns = [pa.array(np.concatenate(c)).cast(k) for c, k in zip(out, types, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bodies, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), structs)], names=names)

    return written(texts.select("d", "t", "text", "xs").mapInArrow(run, EXTRACTED))


def _settle(rows: DataFrame, resolve: Callable, window: int, batch_bytes: int, body: Callable | None) -> DataFrame:
    """What the structure marks, as ranges of first items lo to n: of contexts (kind 0) in their document, of twins (kind 2) from each class's first window on.

    Rows come in the order of their keys; a batch ends where a key does.
    """
    kind = np.uint64 if body is None else np.uint8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for part in slices(batches, 2000):
            flat = part.column(8).flatten()
            classes = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
            ends = np.cumsum(pc.list_value_length(part.column(8)).to_numpy()).tolist()
            for d, t, k, ka, kb, kc, lo, raw, end, before in zip(*(part.column(i).to_pylist() for i in range(8)), ends, [0, *ends[:-1]], strict=True):
                if size >= batch_bytes and (k, ka, kb) != last:
                    yield settled(held)
                    held, size = [], 0
                mine = {f: v[before:end] for f, v in classes.items()} if end > before else None
                held.append((d, t, lo, k, kc, ka, kb, np.frombuffer(raw, kind), mine))
                size += len(raw)
                last = (k, ka, kb)
        if held:
            yield settled(held)

    def settled(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda r: r[:3])
        number, before = -1, None
        numbered, roles = [], []
        for d, t, _, k, kc, _, _, x, _ in held:
            number += (d, t) != before
            before = (d, t)
            numbered.append((number, x))
            roles.append(2 if k == 0 else kc)
        plain: list[tuple] = []  # d, t, start, end
        late: list[tuple] = []  # start and end from the class's first window on, a, c, e, fd, ft, flo, all arrays
        for (d, t, lo, k, kc, ka, kb, _, mine), marks in zip(held, resolve(numbered, roles), strict=True):
            if k == 0:
                plain += [(d, t, lo + s, lo + e) for s, e in _runs(marks)]
            elif kc:
                begin, n = mine["lo"] - lo, mine["n"]
                sums = np.concatenate([[0], np.cumsum(marks)])
                got = sums[begin + n] - sums[begin]
                spans = [(i, 0, n[i]) for i in np.flatnonzero(got == n)] if (got == n).any() else []
                spans += [(i, s, e) for i in np.flatnonzero((got > 0) & (got < n)) for s, e in _runs(marks[begin[i] : begin[i] + n[i]])]
                if spans:
                    at, start, end = np.array(spans, np.int64).T
                    late.append((start, end, *(mine[f][at] for f in ("a", "c", "e")), np.full(len(at), ka), np.full(len(at), kb), mine["flo"][at], mine["g"][at]))
        columns = [np.array(c, np.int64) for c in zip(*plain, strict=True)] if plain else [np.empty(0, np.int64)] * 4
        more = [np.concatenate(c) for c in zip(*late, strict=True)] if late else [np.empty(0, np.int64)] * 9
        none = pa.nulls(len(more[0]), pa.int64())
        joined = [pa.concat_arrays([pa.array(x, pa.int64()), y]) for x, y in zip(columns, (none, none, pa.array(more[0], pa.int64()), pa.array(more[1], pa.int64())), strict=True)]
        joined += [pa.concat_arrays([pa.nulls(len(columns[0]), pa.int64()), pa.array(x, pa.int64())]) for x in more[2:]]
        kinds = [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64()] * 5 + [pa.int32()] * 2
        return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(joined, kinds, strict=True)], names=["d", "t", "lo", "n", "a", "c", "e", "fd", "ft", "flo", "g"])

    keys = ("kind", "ka", "kb")
    plain = rows.repartition(*keys).sortWithinPartitions(*keys).select("d", "t", "kind", "ka", "kb", "kc", "lo", "body", "classes")
    return plain.mapInArrow(run, "d long, t long, lo int, n int, a long, c long, e long, fd long, ft long, flo int, g int")


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of marks."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8))).tolist()
    return list(zip(edge[::2], edge[1::2], strict=True))


def _spread(rows: DataFrame, settled: DataFrame, keys: list[str], within: bool) -> DataFrame:
    """(d, t, start, end): the ranges found for the classes' last members, in all members but the first.

    Classes under anchors of many contexts (g groups of them) are joined group by group.
    """
    found = settled.select(*keys, F.col("lo").alias("s"), F.col("n").alias("e_"), "fd", "ft", "flo", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("part"))
    late = (F.col("d") != F.col("fd")) | (F.col("t") != F.col("ft"))
    late = late | (F.col("lo") != F.col("flo")) if within else late
    rows = rows.withColumn("part", F.pmod(F.xxhash64("d", "t", "lo"), F.col("g")).cast("int"))
    marks = rows.join(found.hint("shuffle_hash"), [*keys, "part"]).where(late)
    return marks.select("d", "t", (F.col("lo") + F.col("s")).alias("start"), (F.col("lo") + F.col("e_")).alias("end"))


def covered(ranges: list[dict] | None, n: int, window: int) -> np.ndarray:
    """Which of n items are in a window that starts in one of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    for r in ranges or ():
        edge[r["start"]] += 1
        edge[min(n, r["end"] + window - 1)] -= 1
    return np.cumsum(edge[:-1]) > 0


