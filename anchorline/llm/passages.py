"""Finding every window of ``span`` tokens that also starts in a document with a smaller id.

A window belongs to the anchor it is certain to share with equal windows (see ``anchored_runs``), so equal windows can
be brought together without comparing documents in pairs:

1. Documents are dealt into batches of about ``BATCH_BYTES`` by a hash of id and text. The exchange is used again by
   the later steps.
2. A batch sends each distinct anchor once, as 4 bytes, to the bucket its hash names. A bucket answers which anchors
   stand in two or more batches ("shared"), and which in so many that their text must be spread ("hot"). A very
   frequent passage costs one entry per batch, not one per document.
3. A batch names the pieces around its shared anchors, a piece per run of windows, to the shard that its anchor names:
   equal pieces once, by a hash of their text, with the smallest id that holds them. A hot anchor's windows go singly, to
   the shard that the hash of the whole window names, so no shard collects the surroundings of a frequent passage.
4. Where all pieces of an anchor are equal, as inside long copies, the shard answers at once. Of the others it asks for
   the text, and then finds, with the solver it is given, the windows of each piece that occur at a smaller id.
5. A batch puts the answers together per document.

Number and size of batches, buckets and shards follow from the bytes of the table. Ids are compared as numbers; a null
id is never smaller than another and larger than all. Rows that repeat an id are copies of one document: they are
never compared with each other, and each gets its own answer.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from anchorline.llm.frames import NULL_ID, parts, total_bytes
from anchorline.llm.kernels import RangeHash, anchored_runs, byte_codes, ranges, slices_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES, BUCKET_BYTES, SHARD_BYTES = 2 << 20, 32 << 20, 8 << 20
BLOCK_BYTES = 2 << 20  # pieces that a shard solves together
HOT_BATCHES = 64

ANSWER = np.dtype([("piece", "<u4"), ("start", "<u4"), ("count", "<u4"), ("ref_doc", "<i8"), ("ref_place", "<i8")])


@dataclass
class Pieces:
    """Distinct texts with the smallest document that holds each, and the place of its first token there."""

    text: pa.Array
    doc: np.ndarray
    place: np.ndarray
    route: np.ndarray
    windows: np.ndarray


Solver = Callable[[Pieces, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
"""(pieces, span) -> for each window, piece after piece: smallest document that holds it, place there, a piece's
first window in these arrays."""


def bounds_of(texts: pa.Array) -> np.ndarray:
    """Bounds of the values of a large binary array."""
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)


def planes(values: np.ndarray) -> bytes:
    """The bytes of equally wide numbers, all first bytes before all second ones, which compresses well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()


class Batch:
    """The rows of one batch in a fixed order, with their runs of windows."""

    def __init__(self, rows: pa.Table, tokenize, span: int, gram: int, buckets: int):
        ids = pc.fill_null(rows.column("doc_id").cast(pa.int64()), NULL_ID).to_numpy()
        texts = rows.column("text").combine_chunks()
        order = np.argsort(ids, kind="stable")
        if len(ids) > 1 and (ids[order[1:]] == ids[order[:-1]]).any():
            plain = texts.to_pylist()
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], plain[i] or "")))
        self.order, self.ids, self.span = order, ids[order], span
        self.tokens = tokenize(texts.take(pa.array(order)))
        self.first, self.last, self.key = anchored_runs(self.tokens, span, gram)
        self.row = np.searchsorted(self.tokens.offsets, self.first, "right") - 1
        bucket, sign = self.key % np.uint64(buckets), (self.key >> np.uint64(32)).astype(np.uint32)
        self.anchors, self.of = np.unique((bucket << np.uint64(32)) | sign, return_inverse=True)
        self.anchor_bucket = (self.anchors >> np.uint64(32)).astype(np.int64)
        least, most = np.full(len(self.anchors), NULL_ID), np.full(len(self.anchors), -NULL_ID)
        doc = self.ids[self.row]
        np.minimum.at(least, self.of, doc)
        np.maximum.at(most, self.of, doc)
        self.several = least < most

    def keys_by_bucket(self) -> Iterator[tuple[int, bytes]]:
        edges = np.append(np.flatnonzero(np.diff(self.anchor_bucket, prepend=-1)), len(self.anchors))
        for a, b in pairwise(edges):
            yield int(self.anchor_bucket[a]), (self.anchors[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()

    def set_flags(self, buckets: np.ndarray, shared: list[bytes], hot: list[bytes]) -> None:
        """Take the answers of the buckets; keep the runs of shared anchors, cut into single windows where hot."""
        flags = []
        for bits in (shared, hot):
            flag = np.zeros(len(self.anchors), bool)
            for bucket, packed in zip(buckets, bits, strict=True):
                a, b = np.searchsorted(self.anchor_bucket, [bucket, bucket + 1])
                flag[a:b] = np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a)
            flags.append(flag)
        runs = (self.several | flags[0])[self.of]
        first, last, row, key = self.first[runs], self.last[runs], self.row[runs], self.key[runs]
        spread = flags[1][self.of[runs]]
        each = np.where(spread, last - first + 1, 1)
        take = np.repeat(np.arange(len(first)), each)
        single = spread[take]
        at = ranges(first, each)
        self.p_first = np.where(single, at, first[take])
        self.p_last = np.where(single, at, last[take])
        self.p_row = row[take]
        route = key[take]
        if single.any():
            for a, b in slices_of(self.tokens.offsets, 1 << 19):
                lo, hi = self.tokens.offsets[a], self.tokens.offsets[b]
                mine = np.flatnonzero(single & (self.p_first >= lo) & (self.p_first < hi))
                start = self.p_first[mine] - lo
                route[mine] = RangeHash(self.tokens.codes(lo, hi)).of(start, start + self.span)
        self._collapse(route)

    def _collapse(self, route: np.ndarray) -> None:
        """One piece per distinct text, with the smallest document of this batch that holds it."""
        begin, end = self.tokens.byte_range(self.p_first, self.p_last + self.span)
        ends = np.cumsum(end - begin)
        bounds = np.concatenate([[0], ends])
        data = self.tokens.data[ranges(begin, end - begin)]
        cells = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = cells.dictionary_encode()
        self.piece_of = coded.indices.to_numpy().astype(np.int64)
        # rows stand in the order of their ids, so the first holder of a text is the smallest
        _, head = np.unique(self.piece_of, return_index=True)
        self.text, self.route = coded.dictionary, route[head]
        self.doc = self.ids[self.p_row[head]]
        self.place = self.p_first[head] - self.tokens.offsets[self.p_row[head]]
        self.windows = self.p_last[head] - self.p_first[head] + 1
        self.prints = np.empty(len(head), np.uint64)
        for a, b in slices_of(bounds_of(self.text), 1 << 20):
            bounds = bounds_of(self.text)[a : b + 1]
            raw = np.frombuffer(self.text.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
            found = RangeHash(byte_codes()[raw])
            self.prints[a:b] = found.of(bounds[:-1] - bounds[0], bounds[1:] - bounds[0])

    def by_shard(self, shards: int) -> Iterator[tuple[int, np.ndarray]]:
        shard = (self.route % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(shard[order], prepend=-1)), len(order))
        for a, b in pairwise(edges):
            yield int(shard[order[a]]), order[a:b]

    def wanted(self, shards: int, asked: dict[int, bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """The pieces whose text a shard has asked for."""
        for shard, pieces in self.by_shard(shards):
            if shard in asked:
                yes = np.unpackbits(np.frombuffer(asked[shard], np.uint8), count=len(pieces)).astype(bool)
                if yes.any():
                    yield shard, pieces[yes]

    def factors(self, shards: int, told: Told) -> tuple[np.ndarray, ...]:
        """Maximal runs of found windows: row, first window, number of windows, document and place they repeat."""
        got = []
        for replies, groups in ((told.settled, self.by_shard(shards)), (told.solved, self.wanted(shards, told.asked))):
            for shard, pieces in groups:
                if shard in replies:
                    found = np.frombuffer(replies[shard], ANSWER).copy()
                    found["piece"] = pieces[found["piece"]]
                    got.append(found)
        answer = np.concatenate(got) if got else np.zeros(0, ANSWER)
        whole = answer["count"] == 0  # a settled piece repeats in all its windows
        answer["count"][whole] = self.windows[answer["piece"][whole]]
        # answers reach every holder of the piece
        holders = np.argsort(self.piece_of, kind="stable")
        size = np.bincount(self.piece_of, minlength=len(self.doc))
        begin = np.cumsum(size) - size
        each = size[answer["piece"]]
        holder = holders[ranges(begin[answer["piece"]], each)]
        found = answer[np.repeat(np.arange(len(answer)), each)]
        rows, first = [self.p_row[holder]], [self.p_first[holder] + found["start"]]
        count, ref_doc, ref_place = [found["count"].astype(np.int64)], [found["ref_doc"]], [found["ref_place"]]
        # and what the smallest holder in this batch has, all later holders repeat
        later = np.flatnonzero(self.ids[self.p_row] > self.doc[self.piece_of])
        rows.append(self.p_row[later])
        first.append(self.p_first[later])
        count.append(self.p_last[later] - self.p_first[later] + 1)
        ref_doc.append(self.doc[self.piece_of[later]])
        ref_place.append(self.place[self.piece_of[later]])
        return tuple(np.concatenate(x) for x in (rows, first, count, ref_doc, ref_place))

    def removed(self, shards: int, told: Told) -> np.ndarray:
        """Which tokens a found window covers."""
        n = len(self.tokens.offsets) and int(self.tokens.offsets[-1])
        edge = np.zeros(n + 1, np.int32)
        _, first, count, _, _ = self.factors(shards, told)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + count + self.span - 1, -1)
        return np.cumsum(edge[:n]) > 0


def shared_anchors(key: tuple, rows: pa.Table) -> pa.Table:
    """Which anchors of a bucket stand in two and more batches."""
    keys = [np.frombuffer(k, "<u4") for k in rows.column("keys").to_pylist()]
    _, inverse, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    in_batches = counts[inverse]
    edges = np.cumsum([0, *map(len, keys)])
    packed = [
        [np.packbits(in_batches[a:b] >= least).tobytes() for a, b in pairwise(edges)]
        for least in (2, HOT_BATCHES)
    ]
    return pa.table({"batch": rows.column("batch"), "bucket": rows.column("bucket"), "shared": packed[0], "hot": packed[1]})


def settle_shard(key: tuple, rows: pa.Table) -> pa.Table:
    """Answer the pieces of anchors that have one text only, and ask for the texts of all others."""
    records = rows.to_pylist()
    doc, place, print_, sign = (
        np.concatenate([from_planes(r[n], kind) for r in records])
        for n, kind in (("docs", "<i8"), ("places", "<i8"), ("prints", "<u8"), ("signs", "<u4"))
    )
    order = np.lexsort((place, doc, sign))
    first = np.flatnonzero(np.diff(sign[order].astype(np.int64), prepend=-1))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.diff(sign[order].astype(np.int64), prepend=-1) != 0) - 1
    low, high = np.minimum.reduceat(print_[order], first), np.maximum.reduceat(print_[order], first)
    ask = (low != high)[group]
    head = order[first][group]
    repeats = np.flatnonzero(~ask & (doc[head] < doc))
    out = np.zeros(len(repeats), ANSWER)
    out["ref_doc"], out["ref_place"] = doc[head[repeats]], place[head[repeats]]
    edges = np.cumsum([0, *[len(r["signs"]) // 4 for r in records]])
    cut = np.searchsorted(repeats, edges)
    settled, asked = [], []
    for i, (a, b) in enumerate(pairwise(edges)):
        mine = out[cut[i] : cut[i + 1]]
        mine["piece"] = repeats[cut[i] : cut[i + 1]] - a
        settled.append(mine.tobytes())
        asked.append(np.packbits(ask[a:b]).tobytes() if ask[a:b].any() else None)
    return pa.table({"batch": rows.column("batch"), "shard": rows.column("shard"), "settled": settled, "asked": pa.array(asked, pa.binary())})


def solve_shard(rows: pa.Table, span: int, solver: Solver) -> pa.Table:
    """Solve a shard block by block; pieces of one anchor stand in one block."""
    records = rows.to_pylist()
    doc, place, route, windows, sizes = (
        np.concatenate([from_planes(r[n], kind) for r in records])
        for n, kind in (("docs", "<i8"), ("places", "<i8"), ("routes", "<u8"), ("windows", "<u4"), ("sizes", "<u4"))
    )
    windows, sizes = windows.astype(np.int64), sizes.astype(np.int64)
    data = b"".join(r["texts"] for r in records)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    cells = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    coded = cells.dictionary_encode()
    piece = coded.indices.to_numpy().astype(np.int64)
    holder = np.lexsort((place, doc, piece))
    head = holder[np.flatnonzero(np.diff(piece[holder], prepend=-1))]
    # blocks: distinct pieces in the order of their routes, cut between routes
    order = np.argsort(route[head], kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    head = head[order]
    piece = number[piece]
    route_edges = np.concatenate([np.flatnonzero(np.diff(route[head], prepend=route[head[0]] + np.uint64(1))), [len(head)]])
    upto = np.concatenate([[0], np.cumsum(sizes[head])])
    win_first = np.concatenate([[0], np.cumsum(windows[head])])
    ref_doc, ref_place = np.repeat(doc[head], windows[head]), ranges(place[head], windows[head])
    # a text that is alone with its anchor has no other text to be compared with
    alone = np.zeros(len(head), bool)
    alone[route_edges[:-1][np.diff(route_edges) == 1]] = True
    several = route_edges[:-1][np.diff(route_edges) > 1]
    groups = route_edges[1:][np.diff(route_edges) > 1]
    weight = np.concatenate([[0], np.cumsum(upto[groups] - upto[several])])
    for a, b in slices_of(weight, BLOCK_BYTES):
        mine = ranges(several[a:b], groups[a:b] - several[a:b])
        take = head[mine]
        block = Pieces(cells.take(pa.array(take)), doc[take], place[take], route[take], windows[take])
        at = ranges(win_first[mine], windows[take])
        ref_doc[at], ref_place[at] = solver(block, span)
    # answer every batch: runs of windows whose smallest document is smaller than the batch's own
    occurrence = ranges(win_first[piece], windows)
    of_row = np.repeat(np.arange(len(piece)), windows)
    hit = ref_doc[occurrence] < doc[of_row]
    spot = np.flatnonzero(hit)
    first_window = np.cumsum(windows) - windows
    step = spot - first_window[of_row[spot]]
    d, p, r = ref_doc[occurrence[spot]], ref_place[occurrence[spot]], of_row[spot]
    new = np.ones(len(spot), bool)
    new[1:] = (r[1:] != r[:-1]) | (step[1:] != step[:-1] + 1) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)
    begin = np.flatnonzero(new)
    out = np.zeros(len(begin), ANSWER)
    out["start"], out["count"] = step[begin], np.diff(np.append(begin, len(spot)))
    out["ref_doc"], out["ref_place"] = d[begin], p[begin]
    edges = np.cumsum([0, *[len(rec["docs"]) // 8 for rec in records]])
    cut = np.searchsorted(r[begin], edges)
    answers = []
    for i in range(len(records)):
        mine = out[cut[i] : cut[i + 1]]
        mine["piece"] = r[begin[cut[i] : cut[i + 1]]] - edges[i]
        answers.append(mine.tobytes())
    return pa.table({"batch": rows.column("batch"), "shard": rows.column("shard"), "answer": answers})


def repeated_passages(
    docs: DataFrame, tokenize, solver: Solver, finish, schema: str, span: int, gram: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Run the steps above and call ``finish(batch, shards, told)`` for the rows of each batch.

    ``gram`` is the length of an anchor: short ones are fewer, long ones are seldom shared by chance. An empty table
    gives no rows; a null text has no tokens.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = total_bytes(rows)
    batches, buckets, shards = parts(total, BATCH_BYTES), parts(total, BUCKET_BYTES), parts(total, SHARD_BYTES)
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int"))

    def send_keys(key: tuple, rows: pa.Table) -> pa.Table:
        batch = Batch(rows, tokenize, span, gram, buckets)
        sent = list(batch.keys_by_bucket())
        return pa.table(
            {"bucket": pa.array([b for b, _ in sent], pa.int32()), "batch": pa.array([key[0].as_py()] * len(sent), pa.int32()),
             "keys": pa.array([k for _, k in sent], pa.binary())}
        )

    def opened(rows: pa.Table, told: pa.Table) -> Batch:
        batch = Batch(rows, tokenize, span, gram, buckets)
        flags = told.filter(pc.equal(told.column("kind"), FLAGS))
        batch.set_flags(flags.column("place").to_numpy(), flags.column("one").to_pylist(), flags.column("two").to_pylist())
        return batch

    def send_prints(key: tuple, rows: pa.Table, flags: pa.Table) -> pa.Table:
        batch = opened(rows, flags) if rows.num_rows else None
        sent: dict[str, list] = {n: [] for n in ("shard", "docs", "places", "prints", "signs")}
        for shard, mine in batch.by_shard(shards) if batch else ():
            sent["shard"].append(shard)
            sent["docs"].append(planes(batch.doc[mine].astype("<i8")))
            sent["places"].append(planes(batch.place[mine].astype("<i8")))
            sent["prints"].append(planes(batch.prints[mine].astype("<u8")))
            sent["signs"].append(planes((batch.route[mine] >> np.uint64(32)).astype("<u4")))
        return as_table(key, sent)

    def send_texts(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        batch = opened(rows, told) if rows.num_rows else None
        sent: dict[str, list] = {n: [] for n in ("shard", "docs", "places", "routes", "windows", "sizes", "texts")}
        for shard, mine in batch.wanted(shards, Told.of(told).asked) if batch else ():
            text = batch.text.take(pa.array(mine))
            bounds = bounds_of(text)
            sent["shard"].append(shard)
            sent["docs"].append(planes(batch.doc[mine].astype("<i8")))
            sent["places"].append(planes(batch.place[mine].astype("<i8")))
            sent["routes"].append(planes(batch.route[mine].astype("<u8")))
            sent["windows"].append(planes(batch.windows[mine].astype("<u4")))
            sent["sizes"].append(planes(np.diff(bounds).astype("<u4")))
            sent["texts"].append(text.buffers()[2].to_pybytes()[bounds[0] : bounds[-1]])
        return as_table(key, sent)

    def conclude(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        return finish(opened(rows, told), shards, Told.of(told))

    by_batch = dealt.groupBy("batch")
    keys = by_batch.applyInArrow(send_keys, "bucket int, batch int, keys binary")
    flags = keys.groupBy("bucket").applyInArrow(shared_anchors, "batch int, bucket int, shared binary, hot binary")
    flags = _reply(flags, FLAGS, "bucket", "shared", "hot")
    prints = by_batch.cogroup(flags.groupBy("batch")).applyInArrow(
        send_prints, "batch int, shard int, docs binary, places binary, prints binary, signs binary"
    )
    settled = prints.groupBy("shard").applyInArrow(settle_shard, "batch int, shard int, settled binary, asked binary")
    known = flags.unionByName(_reply(settled, SETTLED, "shard", "settled", "asked"))
    texts = by_batch.cogroup(known.groupBy("batch")).applyInArrow(
        send_texts,
        "batch int, shard int, docs binary, places binary, routes binary, windows binary, sizes binary, texts binary",
    )
    solved = texts.groupBy("shard").applyInArrow(
        lambda key, rows: solve_shard(rows, span, solver), "batch int, shard int, answer binary"
    )
    told = known.unionByName(_reply(solved, SOLVED, "shard", "answer", None))
    return by_batch.cogroup(told.groupBy("batch")).applyInArrow(conclude, schema)


FLAGS, SETTLED, SOLVED = 0, 1, 2


def _reply(frame: DataFrame, kind: int, place: str, one: str, two: str | None) -> DataFrame:
    """Replies of all kinds in one form: batch, kind, bucket or shard, and up to two byte strings."""
    second = F.col(two) if two else F.lit(None).cast("binary")
    return frame.select("batch", F.lit(kind).alias("kind"), F.col(place).alias("place"), F.col(one).alias("one"), second.alias("two"))


def as_table(key: tuple, sent: dict[str, list]) -> pa.Table:
    shard = pa.array(sent["shard"], pa.int32())
    columns = {"batch": pa.array([key[0].as_py()] * len(shard), pa.int32()), "shard": shard}
    return pa.table(columns | {n: pa.array(v, pa.binary()) for n, v in sent.items() if n != "shard"})


@dataclass
class Told:
    """What the shards have told a batch, by shard: settled pieces, texts asked for, solved pieces."""

    settled: dict[int, bytes]
    asked: dict[int, bytes]
    solved: dict[int, bytes]

    @classmethod
    def of(cls, told: pa.Table) -> Told:
        out = {SETTLED: {}, SOLVED: {}}
        asked = {}
        for row in told.filter(pc.not_equal(told.column("kind"), FLAGS)).to_pylist():
            out[row["kind"]][row["place"]] = row["one"]
            if row["two"] is not None:
                asked[row["place"]] = row["two"]
        return cls(out[SETTLED], asked, out[SOLVED])
