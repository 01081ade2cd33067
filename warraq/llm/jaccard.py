"""Exact n-gram Jaccard join with set relations: block-skipping lists, derived answers.

The join follows the prefix filter: in one global order of shingles, two sets
that are similar enough share a shingle near the start of each. Index lists of
such shingles give candidates. Two relations save work:

* Lists are sorted by set size and cut where a candidate's place in a list
  already rules out the overlap it needs, so whole blocks are skipped by
  position.
* In a list a set is first compared with one leader only. The overlap of two
  other sets is bounded by their overlaps with a common leader: most answers
  follow from a highly similar set's without comparing the sets.

Components come first, from leaders and what those don't settle. Links are
then counted within components: tasks hold two parts of one and return a sum
for each set, never its pairs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, engine, small_batches, written
from .shingles import fingerprint, shingle_sets

#: Characters of texts that are cut into shingles at once; it bounds memory only.
TOGETHER_CHARS = 1_000_000
#: Bits of a shingle that pick its counter, bits of a document's mark, and slices in which both travel. They fix the size of what is broadcast: 8 MB and 2 MB.
SKETCH_BITS, MARK_BITS, SLICES = 23, 24, 64
#: Slices from so many tasks meet in one task at once.
FAN_IN = 256
#: Sets and shingles of one part of a component, about; a task that counts links holds two parts.
PART_SETS, PART_SHINGLES = 2048, 2_000_000
#: A set at least this similar to a leader takes its links from the leader's overlaps.
FOLLOWS = 0.9
#: Lists up to this length give all their candidates at once; longer ones go by leaders.
SHORT = 6


class Rule:
    """Jaccard at least ``percent`` / 100, in whole numbers."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def prefix(self, n: int) -> int:
        """Shingles at the start of the order of which any partner has one, the partner's smallest possible size considered."""
        return n - -(-self.percent * n // 100) + 1

    def overlap(self, a, b):
        """The overlap that sizes ``a`` and ``b`` need."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def smallest(self, n):
        return -(-self.percent * n // 100)


def _lots(texts: list[str | None]):
    at, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= TOGETHER_CHARS:
            yield at, k + 1
            at, held = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _sets(batch: pa.RecordBatch, width: int, keep=None):
    """(row, set) of the rows of a batch with columns doc_id, text."""
    for low, high in _lots(texts := batch.column("text").to_pylist()):
        rows = [k for k in range(low, high) if keep is None or keep[k]]
        yield from zip(rows, shingle_sets([texts[k] for k in rows], width), strict=True) if rows else ()


def _digest(width: int):
    def run(batches):
        """A row per document, and the counters of the task's shingles in slices."""
        engine(None, None)
        counters = np.zeros(1 << SKETCH_BITS, np.uint16)
        any_row = False
        for b in batches:
            ids, n, high, low = b.column("doc_id").to_pylist(), [], [], []
            held: list[np.ndarray] = []
            for _, s in _sets(b, width):
                h, l = fingerprint(s)  # noqa: E741
                n.append(len(s))
                high.append(h)
                low.append(l)
                held.append(s)
                if len(held) >= 512:
                    _count(counters, held)
                    held = []
            _count(counters, held)
            any_row = any_row or bool(ids)
            yield _batch(DIGEST, [ids, n, high, low, *[[None] * len(ids)] * 3])
        if any_row:
            parts = [_packed(x) for x in np.split(np.minimum(counters, 255).astype(np.uint8), SLICES)]
            yield _batch(DIGEST, [[None] * SLICES] * 4 + [list(range(SLICES)), [TaskContext.get().partitionId()] * SLICES, parts])

    return run


DIGEST = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "high": pa.int64(), "low": pa.int64(), "slice": pa.int32(), "task": pa.int32(), "data": pa.binary()}
SLICE = "slice int, task int, data binary"


def _packed(x: np.ndarray) -> bytes:
    """An array of one, two or four bytes a number, compressed, behind its length in bytes."""
    return x.nbytes.to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(x.tobytes(), asbytes=True)


def _unpacked(blob, size: int) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    return np.frombuffer(pa.decompress(blob[4:], n, codec="zstd"), {1: np.uint8, 2: np.uint16, 4: np.uint32}[n // size])


def _merged(slices: DataFrame, tasks: int, merge, size: int, finish=lambda x: x) -> DataFrame:
    """One row for each slice. ``FAN_IN`` tasks' rows of a slice meet at a time, so no task gets those of all tasks."""

    def run(finish):
        def one(table: pa.Table) -> pa.Table:
            total = None
            for x in table.column("data"):
                total = merge(total, _unpacked(x.as_buffer().to_pybytes(), size))
            return pa.table({"slice": table.column("slice").slice(0, 1), "task": pa.array([table.column("task")[0].as_py() // FAN_IN], pa.int32()), "data": pa.array([_packed(finish(total))], pa.binary())})

        return one

    while True:
        last = tasks <= FAN_IN
        if last:
            return slices.groupBy("slice").applyInArrow(run(finish), SLICE)
        slices = slices.withColumn("group", F.expr(f"task div {FAN_IN}")).groupBy("slice", "group").applyInArrow(run(lambda x: x), SLICE)
        tasks = -(-tasks // FAN_IN)


def _batch(kinds: dict, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _schema(kinds: dict) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>"}
    return ", ".join(f"{n} {names[k]}" for n, k in kinds.items())


def _count(counters: np.ndarray, sets: list[np.ndarray]) -> None:
    if sum(map(len, sets)):
        at = np.sort((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        many = np.diff(np.concatenate([first, [len(at)]]))
        where = at[first]
        counters[where] = np.minimum(counters[where] + many, 60_000)


def _add(total, x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if total is None else np.minimum(total.astype(np.uint64) + x, 2**32 - 1).astype(np.uint32)


def _coded(total: np.ndarray) -> np.ndarray:
    """A counter in a byte: exact below 128, then twelve steps for each doubling."""
    return np.where(total < 128, total, np.minimum(255, 128 + 12 * np.log2(np.maximum(128, total) / 128))).astype(np.uint8)


PREFIX = {"doc_id": pa.int64(), "high": pa.int64(), "low": pa.int64(), "n_shingles": pa.int64(), "prefix": pa.binary()}


def _prefixes(width: int, rule: Rule, sketch):
    def run(batches):
        """The first shingles of each set in the global order: rare before common, then by number."""
        counters = np.frombuffer(sketch.value, np.uint8)
        for b in batches:
            ids, out = b.column("doc_id").to_pylist(), ([], [], [], [], [])
            for k, s in _sets(b, width):
                if not len(s) or ids[k] is None:
                    continue
                high, low = fingerprint(s)
                often = counters[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(often, kind="stable")[: rule.prefix(len(s))]
                for column, value in zip(out, (ids[k], high, low, len(s), s[order].tobytes()), strict=True):
                    column.append(value)
            yield _batch(PREFIX, list(out))

    return run


BUCKET = {"bucket": pa.int32(), "data": pa.binary()}
POSTING = np.dtype([("token", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("at", "<i4")])


def _postings(buckets: int):
    def run(batches):
        """Postings of many documents, packed by bucket of the shingle."""
        for b in batches:
            for low in range(0, b.num_rows, 4096):
                part = b.slice(low, 4096)
                tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("prefix")]
                if not tokens:
                    continue
                many = np.array([len(t) for t in tokens])
                rows = np.empty(int(many.sum()), POSTING)
                rows["token"] = np.concatenate(tokens)
                rows["doc"] = np.repeat(part.column("node").to_numpy(), many)
                rows["n"] = np.repeat(part.column("n_shingles").to_numpy(), many)
                rows["at"] = np.concatenate([np.arange(k) for k in many.tolist()])
                where = (rows["token"] % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(where, kind="stable")
                rows, where = rows[order], where[order]
                cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
                codec = pa.Codec("zstd", compression_level=1)
                packed = [codec.compress(_columns(x), asbytes=True) for x in np.split(rows, cuts[1:])]
                sizes = np.diff(np.concatenate([cuts, [len(rows)]]))
                yield _batch(BUCKET, [where[cuts].tolist(), [int(s).to_bytes(4, "little") + p for s, p in zip(sizes, packed, strict=True)]])

    return run


def _columns(rows: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in POSTING.names)


def _rows(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    data = pa.decompress(blob[4:], n * POSTING.itemsize, codec="zstd")
    rows, at = np.empty(n, POSTING), 0
    for c in POSTING.names:
        kind = POSTING[c]
        rows[c] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return rows


FOUND = {"a": pa.int64(), "b": pa.int64(), "shared": pa.int64(), "na": pa.int64(), "nb": pa.int64(), "list": pa.int64(), "docs": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64()), "places": pa.list_(pa.int64())}


def _possible(rule: Rule, n1, at1, n2, at2):
    """Whether two entries of a list may be of linked sets, by their sizes and places."""
    need = rule.overlap(n1.astype(np.int64), n2.astype(np.int64))
    return (at1 <= n1 - need) & (at2 <= n2 - need) & (np.minimum(n1, n2) >= rule.smallest(np.maximum(n1, n2).astype(np.int64)))


def _candidates(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        """Candidate pairs of a bucket's lists, and those long lists that leaders alone don't settle."""
        rows = np.concatenate([_rows(x.as_py()) for x in table.column("data")])
        rows = rows[np.lexsort((rows["at"], rows["n"], rows["token"]))]
        edge = np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]])
        first = np.flatnonzero(edge)
        length = np.diff(np.concatenate([first, [len(rows)]]))
        of = np.repeat(length, length)
        few = rows[(of > 1) & (of <= SHORT)]
        i_all, j_all = [], []
        for step in range(1, SHORT):
            if len(few) <= step:
                break
            x, y = few[:-step], few[step:]
            ok = np.flatnonzero((x["token"] == y["token"]) & _possible(rule, x["n"], x["at"], y["n"], y["at"]))
            i_all.append(np.stack([x["doc"][ok], y["doc"][ok]]))
            j_all.append(np.stack([x["n"][ok], y["n"][ok]]))
        long_lists = []
        for s, n in zip(first[length > SHORT].tolist(), length[length > SHORT].tolist(), strict=True):
            part = rows[s : s + n]
            a, b, rest = _leaders(rule, part)
            i_all.append(np.stack([part["doc"][a], part["doc"][b]]))
            j_all.append(np.stack([part["n"][a], part["n"][b]]))
            if rest is not None:
                long_lists.append(part[rest])
        docs = np.concatenate(i_all, axis=1) if i_all else np.empty((2, 0), np.int64)
        sizes = np.concatenate(j_all, axis=1) if j_all else np.empty((2, 0), np.int32)
        turn = docs[0] > docs[1]
        docs[:, turn], sizes[:, turn] = docs[::-1, turn], sizes[::-1, turn]
        order = np.lexsort((docs[1], docs[0]))
        docs, sizes = docs[:, order], sizes[:, order]
        new = np.flatnonzero(np.concatenate([[True], (docs[:, 1:] != docs[:, :-1]).any(axis=0)])) if docs.shape[1] else np.empty(0, int)
        shared = np.diff(np.concatenate([new, [docs.shape[1]]]))
        k, m = len(new), len(long_lists)
        tables = []
        for low in range(0, k, 100_000):
            at = new[low : low + 100_000]
            none = [None] * len(at)
            tables.append(_batch(FOUND, [docs[0, at], docs[1, at], shared[low : low + 100_000], sizes[0, at], sizes[1, at], none, none, none, none]))
        if m:
            none = [None] * m
            number = [(table.column("bucket")[0].as_py() << 32) + k for k in range(m)]
            tables.append(_batch(FOUND, [none] * 5 + [number] + [[p[c].tolist() for p in long_lists] for c in ("doc", "n", "at")]))
        return pa.Table.from_batches(tables, pa.schema(FOUND))

    return run


def _leaders(rule: Rule, part: np.ndarray):
    """In a list sorted by size: pairs of each entry with one leader, and the entries that have other partners too.

    The entry with the smallest document among those without a leader leads
    all entries it may link with. A block of sizes beyond its reach is skipped.
    """
    free, a, b = np.ones(len(part), bool), [], []
    degree = np.zeros(len(part), np.int64)
    by_doc = np.argsort(part["doc"], kind="stable")
    high_of = np.searchsorted(part["n"], part["n"].astype(np.int64) * 100 // rule.percent, side="right")
    low_of = np.searchsorted(part["n"], rule.smallest(part["n"].astype(np.int64)), side="left")
    # an entry whose place is beyond what its smallest partner allows links with nothing here
    free &= part["at"] <= part["n"] - rule.overlap(part["n"].astype(np.int64), rule.smallest(part["n"].astype(np.int64)))
    alive = free.copy()
    for x in by_doc.tolist():
        if not free[x]:
            continue
        free[x] = False
        low, high = int(low_of[x]), int(high_of[x])
        block = np.arange(low, high)[alive[low:high]]
        ok = block[_possible(rule, part["n"][block], part["at"][block], part["n"][x], part["at"][x])]
        ok = ok[ok != x]
        degree[x] += len(ok)
        taken = ok[free[ok]]
        free[taken] = False
        degree[taken] += 1
        a.append(np.full(len(taken), x))
        b.append(taken)
    a, b = np.concatenate(a) if a else np.empty(0, int), np.concatenate(b) if b else np.empty(0, int)
    return a, b, (np.flatnonzero(alive) if len(b) and alive.sum() > 2 else None)


CROSS = {"a": pa.int64(), "b": pa.int64(), "na": pa.int64(), "nb": pa.int64()}


def _cross(rule: Rule):
    def run(batches):
        """Of long lists with their components: pairs of entries in different components."""
        for batch in batches:
            for r in range(batch.num_rows):
                docs, n, at, comp = (np.array(batch.column(c)[r].as_py(), np.int64) for c in ("docs", "sizes", "places", "comps"))
                order = np.argsort(n, kind="stable")
                docs, n, at, comp = docs[order], n[order], at[order], comp[order]
                high = np.searchsorted(n, n * 100 // rule.percent, side="right")
                out: list[np.ndarray] = []
                for x in range(len(docs)):
                    y = np.arange(x + 1, high[x])
                    y = y[(comp[y] != comp[x]) & (docs[y] != docs[x]) & _possible(rule, n[y], at[y], n[x : x + 1], at[x : x + 1])]
                    if len(y):
                        out.append(np.stack([np.full(len(y), docs[x]), docs[y], np.full(len(y), n[x]), n[y]]))
                if out:
                    p = np.concatenate(out, axis=1)
                    turn = p[0] > p[1]
                    p[:2, turn], p[2:, turn] = p[1::-1, turn], p[:1:-1, turn]
                    yield _batch(CROSS, list(p))

    return run


def _bits(ids: np.ndarray, bits: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _marks(bits: int):
    def run(batches):
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            seen[_bits(b.column("id").to_numpy(), bits)] = True
        parts = [_packed(x) for x in np.split(np.packbits(seen), SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32()), pa.array(parts, pa.binary())], names=["slice", "task", "data"])

    return run


def _either(total, x: np.ndarray) -> np.ndarray:
    return x if total is None else total | x


def _joined(df: DataFrame, size: int) -> bytes:
    """The slices of a table of fixed size, in one string."""
    rows = {r["slice"]: _unpacked(bytes(r["data"]), size).tobytes() for r in df.collect()}
    return b"".join(rows[k] for k in range(SLICES)) if rows else b""


SET = {"doc_id": pa.int64(), "high": pa.int64(), "low": pa.int64(), "n_shingles": pa.int64(), "shingles": pa.binary()}


def _sets_of(width: int, marks):
    def run(batches):
        """Sets of the documents that the marks let through: all that are asked for, and few others."""
        seen = np.unpackbits(np.frombuffer(marks.value, np.uint8)).astype(bool)
        for b in batches:
            ids = b.column("doc_id")
            keep = np.zeros(b.num_rows, bool)
            known = np.flatnonzero(~np.array(ids.is_null()))
            keep[known] = seen[_bits(ids.take(pa.array(known)).to_numpy(), MARK_BITS)]
            ids, out = ids.to_pylist(), ([], [], [], [], [])
            for k, s in _sets(b, width, keep):
                for column, value in zip(out, (ids[k], *fingerprint(s), len(s), s.tobytes()), strict=True):
                    column.append(value)
                if len(out[0]) >= 1000:
                    yield _batch(SET, list(out))
                    out = ([], [], [], [], [])
            yield _batch(SET, list(out))

    return run


KEY = ["high", "low", "n_shingles"]


class Corpus(NamedTuple):
    """The documents, their distinct sets as nodes, and how to tell a node's set among rows with its doc_id.

    ``reps`` has for each distinct set its key, smallest doc_id ``rep``, rows
    ``n`` and ``node``. Where ``plain``, no doc_id has two different sets, and
    a node is its smallest doc_id.
    """

    docs: DataFrame
    reps: DataFrame
    plain: bool
    width: int

    def named(self, rows: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
        """(node, n_shingles, ``column``) of the rows (doc_id, key, column) whose doc_id and set are those of one of ``nodes``; repeated rows stay."""
        if self.plain:
            return rows.withColumnRenamed("doc_id", "node").join(nodes.select("node"), "node", "left_semi").select("node", "n_shingles", column)
        keys = self.reps.join(nodes.select("node"), "node", "left_semi").select(F.col("rep").alias("doc_id"), *KEY, "node")
        return rows.join(keys, ["doc_id", *KEY]).select("node", "n_shingles", column)

    def sets(self, nodes: DataFrame, name: str) -> DataFrame | None:
        """(node, n_shingles, shingles) of distinct ``nodes``, or None without any. Only the sets of their documents are built and move."""
        spark = self.docs.sparkSession
        ids = nodes.select(F.col("node").alias("id")) if self.plain else self.reps.join(nodes, "node", "left_semi").select(F.col("rep").alias("id"))
        size = (1 << MARK_BITS) // 8 // SLICES
        marks = _joined(_merged(ids.mapInArrow(_marks(MARK_BITS), SLICE), _tasks(spark), _either, size), size)
        if not marks or not any(marks):
            return None
        shared = spark.sparkContext.broadcast(marks)
        return self.named(self.docs.mapInArrow(_sets_of(self.width, shared), _schema(SET)), nodes, "shingles").dropDuplicates(["node"])


def _tasks(spark) -> int:
    """The tasks that a stage behind a shuffle has, about."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


VERIFIED = {"a": pa.int64(), "b": pa.int64(), "na": pa.int64(), "nb": pa.int64(), "overlap": pa.int64()}


def _overlaps(batches):
    for b in batches:
        out = []
        for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(s) > len(t):
                s, t = t, s
            at = np.searchsorted(t, s)
            out.append(int((t[np.minimum(at, len(t) - 1)] == s).sum()) if len(t) else 0)
        yield _batch(VERIFIED, [b.column("a"), b.column("b"), b.column("na"), b.column("nb"), out])


def _verify(corpus: Corpus, pairs: DataFrame, name: str) -> DataFrame:
    """The overlap of each pair (a, b, na, nb)."""
    sets = corpus.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), name)
    if sets is None:
        return pairs.sparkSession.createDataFrame([], _schema(VERIFIED))
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return written(with_b.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_overlaps, _schema(VERIFIED)), name)


def near_duplicates(documents: DataFrame, percent: int = 75, width: int = 5, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id): documents whose shingle sets have Jaccard of ``percent`` / 100 or more.

    ``n_links`` counts the other rows linked directly, copies among them (null
    where ``count_links`` is off);
    ``component_id`` is the smallest doc_id reachable by links. Needs doc_id
    and text; other columns are ignored. Every input row gives a row. A text
    without words, or null, has no shingles and links with nothing; a null
    doc_id links with nothing and has a null component_id. Documents with
    equal sets link. What rows with an equal doc_id link with is joined under
    that id; of these, a row without words keeps its own doc_id.
    """
    spark, rule = documents.sparkSession, Rule(percent)
    small_batches(spark)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    digests = written(docs.mapInArrow(_digest(width), _schema(DIGEST)), "digests")
    slices = digests.where("slice is not null").select("slice", "task", "data")
    size = (1 << SKETCH_BITS) // SLICES
    last_task = slices.agg(F.max("task")).first()[0]
    sketch = _joined(_merged(slices, 1 + last_task, _add, size, _coded), size) if last_task is not None else b""
    each = digests.where("slice is null").select("doc_id", *KEY)
    sound = each.where("doc_id is not null and n_shingles > 0")
    spans = [f(c) for c in KEY for f in (F.min, F.max)]
    plain = not sound.groupBy("doc_id").agg(*(x.alias(f"x{k}") for k, x in enumerate(spans))).where("x0 <> x1 or x2 <> x3 or x4 <> x5").limit(1).count()
    node = F.col("rep") if plain else F.monotonically_increasing_id()
    reps = written(sound.groupBy(*KEY).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).select(*KEY, "rep", "n", node.alias("node")), "set-reps")
    corpus = Corpus(docs, reps, plain, width)
    named = reps.withColumn("links", F.lit(0).cast("bigint")).withColumn("component", F.lit(None).cast("bigint"))
    if sketch:
        shared = spark.sparkContext.broadcast(sketch)
        rows = docs.mapInArrow(_prefixes(width, rule, shared), _schema(PREFIX))
        prefixes = corpus.named(rows if plain else rows.dropDuplicates(["doc_id", *KEY]), reps, "prefix")
        buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        packed = prefixes.mapInArrow(_postings(buckets), _schema(BUCKET))
        found = written(packed.groupBy("bucket").applyInArrow(_candidates(rule), _schema(FOUND)), "candidates")
        shared.destroy()
        links = written(_links(corpus, found, rule), "set-links")
        edges = links
        if not plain:  # sets that share a doc_id are joined under it
            shares = sound.join(reps.select(*KEY, "node"), KEY).select("doc_id", "node").distinct()
            least = shares.groupBy("doc_id").agg(F.min("node").alias("b"))
            edges = edges.unionByName(shares.join(least, "doc_id").select(F.col("node").alias("a"), "b"))
        joined = written(components(edges), "components")
        counted = _counted(corpus, joined, links, rule) if count_links else joined.select("node", F.lit(None).cast("bigint").alias("links"))
        named = reps.join(joined, "node", "left").join(counted, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    least = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    known = named.join(least, "component", "left").where("n > 1 or component is not null").select(*KEY, (F.col("links") + F.col("n") - 1).alias("n_links"), F.coalesce("least", "rep").alias("least"))
    out = each.join(known, KEY, "left")
    is_known = F.col("doc_id").isNotNull()
    links = F.when(is_known, F.coalesce("n_links", F.lit(0))).otherwise(0) if count_links else F.lit(None)
    return out.select("doc_id", "n_shingles", links.cast("bigint").alias("n_links"), F.when(is_known, F.coalesce("least", "doc_id")).alias("component_id"))


def _links(corpus: Corpus, found: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of linked nodes, enough to join all that link."""
    linked = F.expr(f"{100 + rule.percent} * overlap >= {rule.percent} * (na + nb)")
    pairs = written(found.where("a <> b").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb")), "pairs")
    # each set with the partner that shares most with it; of equals the smallest, so that a family has one leader
    sides = pairs.select(F.col("b").alias("x"), "a", "b", "shared", "na", "nb").unionByName(pairs.select(F.col("a").alias("x"), "a", "b", "shared", "na", "nb"))
    best = sides.groupBy("x").agg(F.min_by(F.struct("a", "b", "na", "nb"), F.struct(-F.col("shared"), "a", "b")).alias("p")).select("p.*").distinct()
    first = _verify(corpus, best, "first")
    good = first.where(linked)
    comp = written(components(good.select("a", "b")), "first-components")
    lists = found.where("a is null").select("list", F.explode(F.arrays_zip("docs", "sizes", "places")).alias("e")).select("list", F.col("e.docs").alias("node"), F.col("e.sizes").alias("size"), F.col("e.places").alias("place"))
    with_comp = lists.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    again = with_comp.groupBy("list").agg(F.collect_list(F.struct("node", "size", "place", "component")).alias("e"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    cross = again.select(F.col("e.node").alias("docs"), F.col("e.size").alias("sizes"), F.col("e.place").alias("places"), F.col("e.component").alias("comps")).mapInArrow(_cross(rule), _schema(CROSS))
    rest = pairs.select("a", "b", "na", "nb").unionByName(cross).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti")
    side = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    rest = rest.join(side("a"), "a", "left").join(side("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "na", "nb")
    rest = written(rest, "rest")
    if not rest.limit(1).count():
        return good.select("a", "b")
    undecided, derived = _derive(rest, first, rule)
    second = _verify(corpus, undecided, "second").where(linked)
    return good.select("a", "b").unionByName(derived.select("a", "b")).unionByName(second.select("a", "b"))


def _derive(rest: DataFrame, known: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Answers of pairs whose sets were both compared with a common set L, from those overlaps.

    overlap(a, b) is at least o(a, L) + o(b, L) - |L|, and at most
    min(o(a, L), o(b, L)) + min(|a| - o(a, L), |b| - o(b, L)).
    """
    to = known.select(F.col("a").alias("x"), F.col("b").alias("l"), F.col("nb").alias("nl"), "overlap").unionByName(known.select(F.col("b").alias("x"), F.col("a").alias("l"), F.col("na").alias("nl"), "overlap"))
    one = to.groupBy("x").agg(F.max_by(F.struct("l", "nl", "overlap"), F.struct("overlap", -F.col("l"))).alias("to"))
    with_both = rest.join(one.select(F.col("x").alias("a"), F.col("to").alias("ta")), "a", "left").join(one.select(F.col("x").alias("b"), F.col("to").alias("tb")), "b", "left")
    same = F.coalesce(F.col("ta.l") == F.col("tb.l"), F.lit(False))
    low = F.col("ta.overlap") + F.col("tb.overlap") - F.col("ta.nl")
    high = F.least("ta.overlap", "tb.overlap") + F.least(F.col("na") - F.col("ta.overlap"), F.col("nb") - F.col("tb.overlap"))
    enough = lambda o: (100 + rule.percent) * o >= rule.percent * (F.col("na") + F.col("nb"))
    told = written(with_both.select("a", "b", "na", "nb", F.when(same & enough(low), 1).when(same & ~enough(high), -1).otherwise(0).alias("answer")), "derived")
    return told.where("answer = 0").drop("answer"), told.where("answer = 1")


COUNTED = {"node": pa.int64(), "links": pa.int64()}


def _counted(corpus: Corpus, joined: DataFrame, links: DataFrame, rule: Rule) -> DataFrame:
    """(node, links): the rows of other nodes that a node links with, for nodes in a component.

    A component of two nodes has its one link already (``links``). Others are
    dealt into parts of bounded size, and each pair of parts is one task,
    which counts its links without listing them. In a component of many parts
    all nodes are first compared with one leader: nodes within half of the
    permitted distance of it, Jaccard distance being a metric, all link with
    each other, so no task holds two parts of those.
    """
    weights = corpus.reps.select("node", "n", F.col("n_shingles").alias("size"))
    members = joined.join(weights, "node")
    sizes = members.groupBy("component").agg(F.count("*").alias("nodes"), F.greatest(F.ceil(F.count("*") / PART_SETS), F.ceil(F.sum("size") / PART_SHINGLES)).cast("int").alias("parts"))
    members = written(members.join(sizes, "component"), "members")
    pair = F.col("nodes") == 2 if corpus.plain else F.lit(False)
    weight = lambda c: weights.select(F.col("node").alias(c), F.col("n").alias(f"w{c}"))
    twos = links.join(members.where(pair).select(F.col("node").alias("a")), "a", "left_semi").join(weight("a"), "a").join(weight("b"), "b")
    sums = twos.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("wb").alias("links")), F.struct(F.col("b").alias("node"), F.col("wa").alias("links")))).alias("e")).select("e.*")
    rest = members.where(~pair).withColumn("core", F.lit(False))
    sets = corpus.sets(rest.select("node"), "counted")
    if sets is not None:
        if rest.where("parts > 1").limit(1).count():
            rest = written(_cored(corpus, rest, rule), "cored")
            inner = rest.where("core").groupBy("component").agg(F.sum("n").alias("all"))
            sums = sums.unionByName(rest.where("core").join(inner, "component").select("node", (F.col("all") - F.col("n")).alias("links")))
        part = F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("parts")).cast("int") * 2 + F.when(F.col("core"), 1).otherwise(0)
        dealt = rest.where("not core or parts > 1").withColumn("part", part)
        others = F.expr("filter(sequence(0, 2 * parts - 1), x -> not core or x % 2 = 0)")
        tasks = dealt.withColumn("with", F.explode(others)).select("component", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), (F.col("part") > F.col("with")).alias("second"), "node", "n")
        # a part alone with an empty other part has no pairs
        alone = tasks.groupBy("component", "p", "q").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).where("p = q or lo <> hi").select("component", "p", "q")
        held = tasks.join(alone, ["component", "p", "q"], "left_semi").join(sets, "node").select("component", "p", "q", "second", "node", "n", "shingles")
        sums = sums.unionByName(held.groupBy("component", "p", "q").applyInArrow(_degrees_of(rule), _schema(COUNTED)))
    return written(sums.groupBy("node").agg(F.sum("links").alias("links")), "counted")


def _cored(corpus: Corpus, rest: DataFrame, rule: Rule) -> DataFrame:
    """``rest`` with ``core``: in a component of many parts, whether a node is so near the leader that it links with all others as near."""
    large = rest.where("parts > 1")
    leaders = large.groupBy("component").agg(F.min("node").alias("a")).join(large.select(F.col("node").alias("a"), F.col("size").alias("na")), "a")
    pairs = large.select("component", F.col("node").alias("b"), F.col("size").alias("nb")).join(leaders, "component").where("a <> b").select("a", "b", "na", "nb")
    apart = F.col("na") + F.col("nb") - 2 * F.col("overlap")  # sizes of the difference, and below of the union
    near = 2 * 100 * apart <= (100 - rule.percent) * (F.col("na") + F.col("nb") - F.col("overlap"))
    core = _verify(corpus, pairs, "leaders").where(near).select(F.col("b").alias("node")).unionByName(leaders.select(F.col("a").alias("node")))
    return rest.drop("core").join(core.withColumn("near", F.lit(True)), "node", "left").withColumn("core", F.coalesce("near", F.lit(False))).drop("near")


def _degrees_of(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        second, weight = table.column("second").to_numpy(zero_copy_only=False), table.column("n").to_numpy()
        found = degrees(rule, sets, weight, second if second.any() else None)
        has = np.flatnonzero(found)
        return pa.table({"node": table.column("node").to_numpy()[has], "links": found[has]}, schema=pa.schema(COUNTED))

    return run


def degrees(rule: Rule, sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """The weights of the sets that each set links with; with ``side``, only of those on the other side.

    Sets stand in order of size, so a block beyond a set's reach is skipped.
    A set much like an earlier leader takes the leader's overlaps as bounds of
    its own, and only what those leave open is compared; any other set is
    compared with all and leads.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[k]) for k in order], np.int64)
    w, of = weight[order].astype(np.int64), None if side is None else side[order]
    token = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1].astype(np.int32)
    end = np.cumsum(size)
    start, marked = end - size, np.zeros(int(token.max(initial=-1)) + 1, bool)
    high = np.searchsorted(size, size * 100 // rule.percent, side="right")
    leader_of, own, leaders, overlaps = np.full(len(size), -1), np.zeros(len(size), np.int64), [], []
    out = np.zeros(len(size), np.int64)
    for x in range(len(size)):
        y = np.arange(x + 1, high[x])
        if of is not None:
            y = y[of[y] != of[x]]
        need = rule.overlap(size[x], size[y])
        lead = leader_of[x]
        if lead < 0:
            marked[token[start[x] : end[x]]] = True
            got = np.add.reduceat(marked[token], start, dtype=np.int32)
            marked[token[start[x] : end[x]]] = False
            union = size + size[x] - got
            new = np.flatnonzero((leader_of < 0) & (got >= FOLLOWS * union))
            leader_of[new], own[new] = len(leaders), got[new]
            leaders.append(x)
            overlaps.append(got)
            linked = got[y] >= need
        else:
            o = overlaps[lead][y].astype(np.int64)
            linked = own[x] + o - size[leaders[lead]] >= need
            open_ = np.flatnonzero(~linked & (np.minimum(own[x], o) + np.minimum(size[x] - own[x], size[y] - o) >= need))
            if len(open_):
                marked[token[start[x] : end[x]]] = True
                z = y[open_]
                many = size[z]
                at = np.repeat(start[z] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                linked[open_] = np.add.reduceat(marked[token[at]], np.cumsum(many) - many, dtype=np.int64) >= need[open_]
                marked[token[start[x] : end[x]]] = False
        out[x] += w[y[linked]].sum()
        out[y[linked]] += w[x]
    back = np.empty_like(out)
    back[order] = out
    return back
