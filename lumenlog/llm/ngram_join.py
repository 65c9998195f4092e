"""Jaccard join on word n-grams by vertical partitioning.

The 64-bit hashes of a document's n-grams, in their global order, are cut into fragments. Two sets of similar size that are similar
enough differ in fewer n-grams than there are fragments, so a known number of fragments must be the same in both, and at least one.
Sets that share a whole fragment are brought together; those that share enough of all fragments, as far as 16 bits of each tell, are
candidates. No similar pair is missed, and a passage that many documents share makes few candidates. Candidates are then compared
exactly, fragment after fragment: the partial overlaps of all pairs in a block are counted for each fragment by itself and summed
per pair.

Documents with the same set count as one. No table of pairs is made: inside a cluster of candidates, blocks of bounded size meet
each other, and a task gives back only the links that connect its documents (a forest).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm import words as W
from lumenlog.llm.graph import components
from lumenlog.llm.marks import marked, marks, numbered, without_ids
from lumenlog.session import materialize

SLICE_BYTES = 1 << 20
#: Sets a task remembers to send each once; forgetting some only sends them again.
REMEMBERED_SETS = 1_000_000
#: Sets that share a fragment and are compared in one go.
GROUP_SETS = 256
BLOCK_NGRAMS = 200_000
#: N-grams a task gives back at a time.
SENT_NGRAMS = 1 << 18
BLOCK_SETS = 512
OVERLAP_WIDTH = 2048


class Fragments:
    """How many fragments sets of a size are cut into, for a similarity of ``percent``/100 or more.

    Sizes fall into classes, each reaching so far that similar sets are in the same or in neighbouring classes. Sets of a class
    are cut as their own class and as the class below demand, and two sets meet in the lower of their classes.
    """

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must be in 1..100")
        self.percent = percent
        self.low = [1]
        self.known: dict[int, tuple[int, int]] = {}

    def _reach(self, cls: int) -> None:
        while len(self.low) <= cls + 2:
            a = self.low[-1]
            self.low.append(a * 100 // self.percent + 1)

    def of_size(self, n: int) -> int:
        """The class of a set of ``n``."""
        while self.low[-1] <= n:
            self._reach(len(self.low))
        return int(np.searchsorted(self.low, n, "right")) - 1

    def spare(self, cls: int) -> int:
        """Fragments beyond those that differences can touch: as many as a set of the class may leave empty by chance.

        A set with more empty fragments than that also shows the empty ones, so that even such sets cannot miss each other.
        """
        differences = self._differences(cls)
        for spare in range(1, differences + 2):
            n = differences + 1 + spare
            empty = n * math.exp(-self.low[cls] / n)
            if spare >= empty + 3 * math.sqrt(empty):
                break
        return spare

    def _differences(self, cls: int) -> int:
        self._reach(cls)
        most = (self.low[cls + 1] - 1) + (self.low[cls + 2] - 1)
        return most * (100 - self.percent) // (100 + self.percent)

    def count(self, cls: int) -> tuple[int, int]:
        """Fragments of a class, and how many of them are spare."""
        if cls not in self.known:
            spare = self.spare(cls)
            self.known[cls] = self._differences(cls) + 1 + spare, spare
        return self.known[cls]

    def cut(self, grams: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(class, hash of every fragment, which of them are shown, how many a similar set must share of those shown)."""
        own = self.of_size(len(grams))
        for cls in range(max(0, own - 1), own + 1):
            n, spare = self.count(cls)
            fragment = (((grams >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
            content, shown = np.zeros(n, np.uint64), np.zeros(n, bool)
            content[fragment[first]], shown[fragment[first]] = np.add.reduceat(W.mix(grams), first), True
            empty = n - len(first)
            if empty > spare:
                shown[:], empty = True, 0
            place = np.arange(n, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(cls + 1)
            yield cls, W.mix(content + W.mix(place)), shown, 1 + spare - empty

    def agree(self, cls: int, sizes: np.ndarray) -> np.ndarray:
        """Fragments of the class that two sets of these sizes must share to be similar, for all pairs."""
        n, _ = self.count(cls)
        return n - (sizes[:, None] + sizes[None, :]) * (100 - self.percent) // (100 + self.percent)

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        """The hashes of all fragments that are shown."""
        return np.concatenate([hashes[shown] for _, hashes, shown, _ in self.cut(grams)]).view(np.int64)


def _sets(batch: pa.RecordBatch, column: str, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of every text with a word; shorter texts have one gram, the whole sequence."""
    data, starts = W.buffers(batch.column(column))
    for lo, hi in W.slices(starts, SLICE_BYTES):
        w = W.words(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
        if not len(w.row):
            continue
        first = np.flatnonzero(np.concatenate([[True], w.row[1:] != w.row[:-1]]))
        last = np.concatenate([first[1:], [len(w.row)]])
        joined = w.hashes.copy()
        for k in range(1, n):
            joined[:-k] = W.mix(joined[:-k]) + w.hashes[k:]
        joined = W.mix(joined + np.uint64(n))
        for a, b in zip(first.tolist(), last.tolist()):
            if b - a >= n:
                yield lo + int(w.row[a]), np.unique(joined[a : b - n + 1])
            else:
                h = w.hashes[a : a + 1]
                for k in range(a + 1, b):
                    h = W.mix(h) + w.hashes[k : k + 1]
                yield lo + int(w.row[a]), W.mix(h + np.uint64(b - a))


def _signature(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _lists(values: list[np.ndarray]) -> pa.Array:
    """A list column of the arrays."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))


def _short(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def _describe(n: int):
    """Per document its set's size and 128-bit name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
            for row, grams in _sets(batch, "t", n):
                sizes[row], names[row] = len(grams), _signature(grams)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(names, pa.binary())], names=["id", "n", "name"])

    return run


def _send(percent: int, n: int):
    """(fragment, set, class, need) of every set that is new to the task, sets by the first 64 bits of their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frags = Fragments(percent)
        out: list[list[np.ndarray]] = [[], [], [], []]
        seen, size = set(), 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c), k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["fragment", "key", "cls", "need"])

        for batch in batches:
            for _, grams in _sets(batch, "t", n):
                key = _short(_signature(grams))
                if key in seen:
                    continue
                seen.add(key)
                for cls, hashes, shown, need in frags.cut(grams):
                    hashes = hashes[shown].view(np.int64)
                    for column, value in zip(out, (hashes, key, cls, need)):
                        column.append(value if value is hashes else np.full(len(hashes), value, np.int64))
                    size += len(hashes)
                if size > 100_000:
                    yield flush()
                    size = 0
            if len(seen) > REMEMBERED_SETS:
                seen.clear()
        if size:
            yield flush()

    return run


def _sketches(percent: int, n: int):
    """(set, class, size, sketch): 16 bits of each fragment's hash, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frags = Fragments(percent)
        for batch in batches:
            rows = []
            for _, grams in _sets(batch, "t", n):
                key = _short(_signature(grams))
                rows += [(key, cls, len(grams), (hashes >> np.uint64(48)).astype(np.uint16).tobytes()) for cls, hashes, _, _ in frags.cut(grams)]
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "cls", "size", "sketch"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose fragment another set of the partition has too. Rows come sorted by fragment and set; one row is held back."""
    held, before = None, False
    names = ["fragment", "key", "cls", "need"]
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        frag, key = columns[0], columns[1]
        keep = np.concatenate([[True], (frag[1:] != frag[:-1]) | (key[1:] != key[:-1])])
        columns = [c[keep] for c in columns]
        frag = columns[0]
        same = frag[1:] == frag[:-1]
        shared = np.concatenate([[before], same]) | np.concatenate([same, [False]])
        held, before = [c[-1:] for c in columns], bool(shared[-1])
        rows = [c[:-1][shared[:-1]] for c in columns]
        if len(rows[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=names)
    if held is not None and before:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=names)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matrix of links that connect what all of them connect."""
    parent = list(range(linked.shape[1]))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(*(x.tolist() for x in np.nonzero(linked))):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _agree(percent: int):
    """Candidates among the sets that share a fragment: those that share enough fragments, as far as sketches tell.

    Rows come sorted by group; a group is bounded. Only pairs that connect the group's candidates are given back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frags = Fragments(percent)
        group, rows, found = None, [], []

        def compare() -> None:
            sets = {key: (size, sketch) for key, size, sketch in rows}
            if len(sets) < 2:
                return
            keys = list(sets)
            sizes = np.asarray([sets[k][0] for k in keys])
            marks = np.stack([np.frombuffer(sets[k][1], np.uint16) for k in keys])
            common = np.stack([np.count_nonzero(marks == m, axis=1) for m in marks])
            near = np.triu(common >= frags.agree(group[3], sizes), 1)
            found.extend((keys[a], keys[b]) for a, b in _forest(near))

        def flush() -> pa.RecordBatch:
            pairs = sorted(set(found))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            heads = zip(*(batch.column(c).to_pylist() for c in ("fragment", "lo", "hi", "cls")))
            for head, row in zip(heads, zip(*(batch.column(c).to_pylist() for c in ("key", "size", "sketch")))):
                if head != group:
                    compare()
                    group, rows = head, []
                rows.append(row)
            if len(found) > 50_000:
                yield flush()
        compare()
        if found:
            yield flush()

    return run


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sets, size = [], [], 0
            for _, grams in _sets(batch, "t", n):
                names.append(_signature(grams))
                sets.append(grams.view(np.int64))
                size += len(grams)
                if size > SENT_NGRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), _lists(sets)], names=["name", "grams"])
                    names, sets, size = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), _lists(sets)], names=["name", "grams"])

    return run


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first ``left`` sets with all of them: partial counts of every fragment, summed per pair.

    A fragment here is a range of the global order that holds ``OVERLAP_WIDTH`` n-grams; n-grams of a single set are left out, as
    they add nothing.
    """
    size = np.asarray([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    grams, rank, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.where(shared, np.cumsum(shared) - 1, -1)[rank]
    owner, rank = owner[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    owner, rank = owner[order], rank[order]
    total = np.zeros((left, len(sets)), np.float64)
    for start in range(0, int(shared.sum()), OVERLAP_WIDTH):
        a, b = np.searchsorted(rank, [start, start + OVERLAP_WIDTH])
        part = np.zeros((len(sets), OVERLAP_WIDTH), np.float32)
        part[owner[a:b], rank[a:b] - start] = 1
        total += part[:left] @ part.T
    return total.astype(np.int64)


def _link(percent: int):
    def run(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sets: dict[bytes, tuple[int, np.ndarray]] = {}
        for name, block, grams in zip(table.column("name").to_pylist(), table.column("block").to_pylist(), table.column("grams")):
            if name not in sets:
                sets[name] = block, np.asarray(grams.values)
        names = sorted(sets, key=lambda x: (sets[x][0] != lo, x))
        left = sum(sets[x][0] == lo for x in names)
        a_out, b_out = [], []
        if len(names) > 1 and left:
            size = np.asarray([len(sets[x][1]) for x in names])
            both = overlaps([sets[x][1] for x in names], left)
            linked = 100 * both >= percent * (size[:left, None] + size[None, :] - both)
            cols, rows = np.arange(len(names))[None, :], np.arange(left)[:, None]
            for a, b in _forest(linked & (cols > rows) & ((cols >= left) | (lo == hi))):
                a_out.append(names[a])
                b_out.append(names[b])
        return pa.table({"a": pa.array(a_out, pa.binary()), "b": pa.array(b_out, pa.binary())})

    return run


def _candidates(docs: DataFrame, percent: int, n: int) -> DataFrame:
    """Pairs (a, b) of sets that connect all that may be similar, over columns id and t.

    Similar sets share at least ``need`` of the fragments they show. A fragment that more than ``GROUP_SETS`` sets share, a common
    passage say, is passed over for a set with fewer than ``need`` such fragments: the set meets whom it may be similar to in
    another one. What remains of such a fragment is compared in blocks.
    """
    sent = docs.select("t").mapInArrow(_send(percent, n), "fragment bigint, key bigint, cls int, need int")
    rows = sent.repartition("fragment").sortWithinPartitions("fragment", "key").mapInArrow(_repeated, sent.schema)
    rows = materialize(rows, "ngram-fragments")
    crowded = rows.groupBy("fragment").agg(F.count("*").alias("crowd")).filter(F.col("crowd") > GROUP_SETS)
    rows = rows.join(crowded, "fragment", "left")
    often = rows.filter("crowd IS NOT NULL").groupBy("key", "cls").agg(F.count("*").alias("often"))
    rows = rows.join(often, ["key", "cls"], "left").filter("crowd IS NULL OR often >= need").select("fragment", "key", "cls", "crowd")
    rows = materialize(rows, "ngram-groups")
    # Fragments that the same sets share say the same; one of them is compared, however many near copies of long texts share.
    same = [F.bit_xor(F.xxhash64("key")), F.bit_xor(F.xxhash64("key", F.lit(1)))]
    groups = rows.groupBy("fragment", "cls").agg(F.count("*").alias("n"), same[0].alias("x"), same[1].alias("y")).filter("n > 1")
    rows = rows.join(groups.groupBy("cls", "n", "x", "y").agg(F.min("fragment").alias("fragment")).select("fragment"), "fragment", "left_semi")
    left = rows.filter("crowd IS NOT NULL").groupBy("fragment").agg(F.ceil(F.count("*") / GROUP_SETS).cast("int").alias("blocks"))
    rows = rows.join(left, "fragment", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("fragment", "key", "cls", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    sketches = docs.select("t").mapInArrow(_sketches(percent, n), "key bigint, cls int, size bigint, sketch binary")
    wanted = rows.select("key").distinct()
    sketches = marked(sketches, marks(wanted, "key"), F.col("key")).dropDuplicates(["key", "cls"])
    met = rows.join(sketches, ["key", "cls"]).repartition("fragment", "lo", "hi").sortWithinPartitions("fragment", "lo", "hi", "key")
    return met.select("fragment", "lo", "hi", "cls", "key", "size", "sketch").mapInArrow(_agree(percent), "a bigint, b bigint")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: id, ``n_shingles`` (size of its set of word n-grams) and ``component_id``.

    Documents link when 100 * intersection >= percent * union; the component is named by the smallest id reachable over links.
    Words are lower-cased (A-Z); a text with fewer than ``n`` words has its whole sequence as its one n-gram; a null, empty or
    white text has an empty set and no links, so its component is itself. Repeated rows are copies of each other. A null id is
    passed over when the smallest id is sought, and is its own component's name only where there is no other. Only the two named
    columns are read; an empty table gives an empty result. Ids must be integers.

    N-grams and fragments are compared by 64-bit hashes, sets by 128-bit ones.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    described = materialize(docs.mapInArrow(_describe(n), "id bigint, n bigint, name binary"), "ngram-sets")

    clusters = components(_candidates(docs, percent, n))

    sets = described.filter("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    inside = materialize(sets.withColumn("key", _key("name")).join(clusters.withColumnRenamed("node", "key"), "key").select("name", "id", "n", "root"), "ngram-clusters")
    weight = inside.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_NGRAMS), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"))
    blocked = inside.join(weight, "root").select("name", "root", "blocks", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int").alias("block"))

    wanted = inside.select(F.col("id").alias("wanted")).distinct()
    near = marked(docs, marks(wanted, "wanted"), docs["id"])
    texts = near.join(wanted.hint("merge"), near["id"].eqNullSafe(wanted["wanted"]), "left_semi").select("t")
    grams = texts.mapInArrow(_grams(n), "name binary, grams array<bigint>")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    meetings = grams.join(blocked, "name").select("name", "grams", "root", "block", other)
    meetings = meetings.select("name", "grams", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    links = meetings.groupBy("root", "lo", "hi").applyInArrow(_link(percent), "a binary, b binary")

    # Components of the real links, named by their smallest document.
    linked = components(links).withColumnRenamed("node", "name")
    named = sets.select("name", "id").join(linked, "name", "left").select("name", "id", F.coalesce("root", "name").alias("component"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "component").select("name", "component_id")
    own = described.select("id", "n", "name")
    result = own.filter("name IS NOT NULL").join(named, "name").select("id", "n", "component_id")
    result = result.unionByName(own.filter("name IS NULL").select("id", "n", F.col("id").alias("component_id")))
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _key(name: str):
    """The first eight bytes of a set's name as a number, as the tasks compute it."""
    swapped = F.concat(*[F.substring(name, i, 1) for i in range(8, 0, -1)])
    return F.conv(F.hex(swapped), 16, -10).cast("bigint")


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row of each group of similar texts, with all columns: one with the smallest id, null ids last.

    Ids may repeat or be null: rows are told apart by a number of their own, and of several rows with the smallest id the one that
    was written first stays. A text that is null or has no words is similar to none and stays; whole texts are compared, however
    long. Other columns are carried along, whatever their names. An empty table gives an empty result.
    """
    rows, row = numbered(df, "similar-rows")
    found = jaccard_components(rows, row, text_col, n, percent).select(F.col(row).alias("row"), "component_id")
    named = found.join(rows.select(F.col(row).alias("row"), F.col(id_col).alias("id")), "row")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row"))["row"]
    stays = named.groupBy("component_id").agg(first.alias("row"))
    gone = found.select("row").join(stays, "row", "left_anti")
    return without_ids(rows, row, gone).drop(row)
