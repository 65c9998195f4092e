"""Best-fit packing of tokenised documents into sequences of a fixed length, improved by local search.

Documents are cut into pieces of at most one sequence. Pieces are dealt into groups of bounded size by a hash; each group is packed
by itself: longest first into the fullest sequence with room, then the least full sequence is taken apart by moving its pieces to
other underfull ones or exchanging one or two of them for a smaller piece. Every step increases the sum of squared fills, so the
search ends. Pieces may share sequences in any combination, so a group is as good as the whole table to within a sequence or two.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.session import materialize

SEQUENCE = 1024
END_ID = 2
GROUP_PIECES = 16_384


class Encoder:
    """Token ids of texts in the vocabulary of a tokenizer file.

    ``ranks`` names the same vocabulary as byte ranks, whose encoder gives the same ids several times faster; texts that spell a
    special token go to the tokenizer itself.
    """

    def __init__(self, tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken"):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(public_tokenizers.path(ranks), "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full sequences, with what is over in front."""
    first = n % length
    return ([(0, first)] if first else []) + [(s, length) for s in range(first, n, length)]


def _pieces(length: int, end_id: int, tokenizer: str, ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, ranks)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.asarray(encode(text.as_py() or "") + [end_id], "<u4")
                for k, (start, size) in enumerate(cuts(len(ids), length)):
                    for column, value in zip(out, (doc, k, start, size, zlib.crc32(ids[start : start + size].tobytes()))):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of item numbers, longest items first, each into the fullest bin that still has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    some = 0  # bit r: a bin with room r exists
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                some &= ~(1 << r)
            bins[b].append(item)
        else:
            r, b = room, len(bins)
            bins.append([item])
        left = r - size
        by_room[left].append(b)
        some |= 1 << left
    return bins


def improve(sizes: list[int], bins: list[list[int]], room: int) -> list[list[int]]:
    """Empty bins by local search; returns the bins that are left.

    The least full bin gives a piece, or two, to an underfull bin, against nothing or one smaller piece there, as long as the
    receiving bin is at least as full and has room. Both fills then move apart, which increases their sum of squares.
    """
    full = [b for b in bins if sum(sizes[i] for i in b) == room]
    under = sorted((b for b in bins if sum(sizes[i] for i in b) < room), key=lambda b: sum(sizes[i] for i in b))
    item = np.asarray([i for b in under for i in b], np.int64)
    size = np.asarray([sizes[i] for i in item], np.int64)
    home = np.repeat(np.arange(len(under)), [len(b) for b in under])
    fill = np.bincount(home, weights=size, minlength=len(under)).astype(np.int64)
    for victim in np.argsort(fill, kind="stable").tolist():
        while fill[victim] and fill[victim] < room:
            own = np.flatnonzero(home == victim)
            offers = [(int(size[a]), (a,)) for a in own]
            # Pairs of neighbours in size are enough to offer many sums without trying all.
            ranked = own[np.argsort(size[own])]
            offers += [(int(size[a] + size[b]), (a, b)) for a, b in zip(ranked[:-1], ranked[1:])]
            gap = np.where((fill > 0) & (fill >= fill[victim]), room - fill, -1)
            gap[victim] = -1
            best, move = 0, None
            widest = int(gap.max()) if len(gap) else -1
            for amount, given in offers:
                if amount <= widest and amount > best:
                    fitting = np.where(gap >= amount, gap, room + 1)
                    best, move = amount, (given, None, int(np.argmin(fitting)))
                gain = amount - size
                gain[(gain <= 0) | (gain > gap[home])] = 0
                at = int(np.argmax(gain))
                if gain[at] > best:
                    best, move = int(gain[at]), (given, at, int(home[at]))
            if move is None:
                break
            given, taken, to = move
            home[list(given)] = to
            if taken is not None:
                home[taken] = victim
            fill[to] += best
            fill[victim] -= best
    kept: dict[int, list[int]] = {}
    for i, h in zip(item.tolist(), home.tolist()):
        kept.setdefault(h, []).append(i)
    return full + list(kept.values())


def _pack(room: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("id", "piece", "ids_crc32")])
        sizes = group["length"].to_pylist()
        bins = improve(sizes, best_fit(sizes, room), room)
        first = group["grp"][0].as_py() << 32
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for b, members in enumerate(bins):
            at = 0
            for i in members:
                sequence[i], offset[i] = first + b, at
                at += sizes[i]
        return group.drop_columns(["grp"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE, end_id: int = END_ID, tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty; an empty one is its end token alone. Documents longer than a sequence are cut, the first piece
    being the short one. Rows that repeat an id are packed each for itself; a null id stays null. Only the two named columns are
    read. An empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    kinds = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    pieces = materialize(docs.mapInArrow(_pieces(length, end_id, tokenizer, ranks), kinds), "pack-pieces")
    groups = -(-pieces.count() // GROUP_PIECES)
    # Dealt by the place of the row in the table just written, so that no number of equal rows gathers in one group.
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, groups))).cast("int"))
    packed = dealt.groupBy("grp").applyInArrow(_pack(length), kinds + ", sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("id", id_col)
