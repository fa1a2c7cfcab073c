"""SimHash near-duplicates, found exactly with covering masks.

A document's fingerprint has 256 bits: bit b is the majority, over the document's distinct words,
of bit b of the word's hash. Two documents are near-duplicates when their fingerprints differ in
at most ``TAU`` bits; groups are the connected components of that relation, and no link is left out.

Candidates: the fingerprint is cut into ``BLOCKS`` blocks with radii whose sum, with one more for each block, is TAU + 1,
so that near fingerprints are within the radius r in one block at least. In a block every bit has a vector of r + 1
bits, and every nonzero vector v has a mask: the bits whose vectors have an odd product with v. The vectors of r
bits or fewer leave some v that is orthogonal to all of them, so that one mask has none of the bits that differ: rows are
equal under it, and sorting what each mask leaves of the rows finds them. A mask has about 25 bits, and there are 1531.

Cost: a task has the fingerprints of all documents, or beyond ``_TASK_ROWS`` of two groups of them, and a share of the masks; a distinct
fingerprint goes to about 32 tasks, 40 bytes each time; text is never shuffled. Equal fingerprints are one row. Rows already linked
aren't compared again, and long runs are compared with one of their rows first, so that a group of copies costs one pass.

Links: what isn't compared again are links, too, if inside a group. As near documents are always of one group, links are counted
afterwards, by comparing every two distinct fingerprints of a group, in tiles of ``_TILE_ROWS`` by as many; no pair is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import frames
from loomtext.llm import kernels as K
from loomtext.session import cut, read

U = np.uint64
BITS, BLOCKS, TAU = 256, 5, 40
_LONG_RUN, _PAIRS, _TASK_ROWS, _COPIES, _SET_ROWS, _TILE_ROWS = 64, 1 << 18, 2_000_000, 32, 1024, 1 << 15
#: Block radius: what orders the bits' vectors. These make the fewest light masks of thousands that were tried; any finds all pairs.
_SEEDS = {7: 2419, 8: 281}
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], U)


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One row of 32 bytes for each text, and how many distinct words it has (0: the fingerprint means nothing)."""
    words, n = K.Words(texts), len(texts)
    shift = U(40)  # a feature is a word's leading 40 bits, whatever else is in the batch
    key = np.sort((words.doc().astype(U) << shift) | (words.hash >> (U(64) - shift)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    off = np.searchsorted((key >> shift).astype(np.int64), np.arange(n + 1))
    feature, count = key & ((U(1) << shift) - U(1)), np.diff(off)
    # byte lanes hold sums of up to 255 words; longer texts are summed in parts
    parts = -(-count // 255)
    first = np.concatenate([[0], np.cumsum(parts)])
    doc = np.repeat(np.arange(n), parts)
    at = off[:-1][doc] + 255 * (np.arange(len(doc)) - first[:-1][doc])
    lanes = np.zeros((len(at), BITS // 8), U)
    if len(at):
        for k in range(BITS // 64):
            seen = K.mix(feature + U((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
            for j in range(8):
                lanes[:, 8 * k + j] = np.add.reduceat(_SPREAD[seen[:, j]], at)
    total = np.zeros((n, BITS), np.int64)
    if len(at):
        has = count > 0
        total[has] = np.add.reduceat(lanes.view(np.uint8).astype(np.int64), first[:-1][has], axis=0)
    return np.packbits(2 * total > count[:, None], axis=1, bitorder="little"), count


def _fingerprint_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for part, texts in K.chunks(batch):
            fp, count = fingerprints(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f.tobytes() if c else None for f, c in zip(fp, count)], pa.binary())], ["doc_id", "text_hash", "fp"])


def blocks() -> list[tuple[int, int, int]]:
    """First bit, end and radius of each block."""
    edge = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(edge[k], edge[k + 1], (TAU + 1 + k) // BLOCKS - 1) for k in range(BLOCKS)]


def masks(bits: int, radius: int) -> np.ndarray:
    """Masks over ``bits`` bits: of any ``radius`` bits, one mask at least has none."""
    vectors = np.arange(1, 2 << radius)
    column = vectors[np.argsort(K.mix(vectors.astype(U) + U(_SEEDS.get(radius, 0) << 16)))][np.arange(bits) % len(vectors)]
    odd = (np.bitwise_count(vectors[:, None] & column) & 1).astype(U)
    return (odd << np.arange(bits, dtype=U)).sum(1, dtype=U)


def _spread_rows(groups: int, sets: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints, packed, for each task: a pair of groups (or the only group) and a share of the masks."""
    pairs = list(combinations(range(groups), 2)) or [(0, 0)]
    for batch in it:
        n = batch.num_rows
        if not n:
            continue
        fp = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(n, BITS // 8)
        rep = batch.column(1).to_numpy(zero_copy_only=False).astype("<i8")
        group = K.bucket_of(K.mix(fp.view("<u8") @ np.array([1, 3, 5, 7], U)), groups)
        for k, pair in enumerate(pairs):
            own = np.isin(group, pair)
            if own.any():
                of = range(k * sets, (k + 1) * sets)
                fps, reps = fp[own].tobytes(), rep[own].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array([fps] * sets, pa.binary()), pa.array([reps] * sets, pa.binary())], ["part", "fps", "reps"])


def _within(block: np.ndarray, fp: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of rows are within the block's radius and near."""
    near = np.bitwise_count(block[a] ^ block[b]) <= radius
    left = np.flatnonzero(near)
    near[left] = np.bitwise_count(fp[a[left]] ^ fp[b[left]]).sum(1, dtype=np.int64) <= TAU
    return near


def _runs(block: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Rows that others equal under a mask, and the run that each is in, ascending."""
    low = U(max(1, len(block) - 1).bit_length())
    # a row's number goes where the product has its low bits; that others clash there only costs time
    key = np.sort(((block & mask) * U(0x9E3779B97F4A7C15) >> low << low) | np.arange(len(block), dtype=U))
    high = key >> low
    same = np.zeros(len(key) + 1, bool)
    np.equal(high[1:], high[:-1], out=same[1:-1])
    at = np.flatnonzero(same[1:] | same[:-1])
    return (key[at] & ((U(1) << low) - U(1))).astype(np.int64), np.cumsum(~same[at])


def _several(row: np.ndarray, run: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose runs have several labels."""
    if not len(row):
        return row, run
    own, first = label[row], np.flatnonzero(np.diff(run, prepend=-1))
    mixed = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
    keep = np.repeat(mixed, np.diff(np.append(first, len(row))))
    return row[keep], run[keep]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels when rows a and b are linked, too."""
    if not len(a):
        return label
    member, root = _smallest_linked(label[a], label[b])
    to = np.arange(len(label))
    to[member] = root
    return to[label]


def near_pairs(share: int, fp: np.ndarray, shares: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that connect all near rows which the masks of a share, one of ``shares``, find.

    These are enough for the groups, but not all links: near rows that others connect already are left out, see ``_count_links``.
    ``fp``: n x 4 words of 64 bits.
    """
    n, number = len(fp), 0
    label = np.arange(n)
    none = np.zeros(0, np.int64)
    left, right = [none], [none]
    for begin, end, radius in blocks() if n > 1 else []:
        word, shift = divmod(begin, 64)
        block = fp[:, word] >> U(shift)
        if shift + end - begin > 64:
            block = block | fp[:, word + 1] << U(64 - shift)
        block = block & U((1 << end - begin) - 1)
        for mask in masks(end - begin, radius):
            number += 1
            if number % shares != share:
                continue
            row, run = _several(*_runs(block, mask), label)
            while len(row):  # a tight group is linked through one of its rows
                first = np.flatnonzero(np.diff(run, prepend=-1))
                size = np.diff(np.append(first, len(row)))
                long = size > _LONG_RUN
                if not long.any():
                    break
                lead = np.repeat(row[first + size * (number * 40503 % 65536) // 65536], size)
                at = np.flatnonzero(np.repeat(long, size) & (label[row] != label[lead]))
                at = at[_within(block, fp, lead[at], row[at], radius)]
                left.append(lead[at])
                right.append(row[at])
                label = _merge(label, lead[at], row[at])
                before = len(row)
                row, run = _several(row, run, label)
                if len(row) > before // 2:
                    break
            if not len(row):
                continue
            first = np.flatnonzero(np.diff(run, prepend=-1))
            size = np.diff(np.append(first, len(row)))
            end_of_run, after, own = np.repeat(first + size, size), np.arange(1, len(row) + 1), label[row]
            long = np.flatnonzero(np.repeat(size > _LONG_RUN, size))
            if len(long):  # by label: a row is compared with those of its run that follow its label
                order = long[np.lexsort((own[long], run[long]))]
                row[long], own[long] = row[order], own[order]
                edge = np.flatnonzero((np.diff(own[long]) != 0) | (np.diff(run[long]) != 0)) + 1
                follows = np.searchsorted(edge, np.arange(len(long)), "right")
                after[long] = np.minimum(end_of_run[long], np.append(long[edge], len(row))[follows])
            total = np.cumsum(end_of_run - after)
            a_found, b_found = [none], [none]
            for start in range(0, int(total[-1]), _PAIRS):
                pair = np.arange(start, min(start + _PAIRS, int(total[-1])))
                to = int(np.searchsorted(total, pair[-1], "right")) + 1
                of = int(np.searchsorted(total, start, "right"))
                a = of + np.repeat(np.arange(to - of), np.diff(np.minimum(total[of:to], pair[-1] + 1), prepend=start))
                b = end_of_run[a] + pair - total[a]
                other = own[a] != own[b]
                a, b = row[a[other]], row[b[other]]
                near = _within(block, fp, a, b, radius)
                a_found.append(a[near])
                b_found.append(b[near])
            a, b = np.concatenate(a_found), np.concatenate(b_found)
            left.append(a)
            right.append(b)
            label = _merge(label, a, b)
    return np.concatenate(left), np.concatenate(right)


def _smallest_linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id of the edges that isn't its component's smallest, and that smallest one."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _link(sets: int, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, fps, reps = None, [], []
    for batch in it:
        if batch.num_rows:
            part = batch.column(0)[0].as_py()
        fps += batch.column(1).to_pylist()
        reps += batch.column(2).to_pylist()
    if part is None:
        return
    fp = np.frombuffer(b"".join(fps), "<u8").reshape(-1, BITS // 64)
    rep = np.frombuffer(b"".join(reps), "<i8")
    del fps, reps
    a, b = near_pairs(part % sets, fp, sets)
    member, root = _smallest_linked(rep[a], rep[b])
    yield pa.RecordBatch.from_arrays([pa.array(member, pa.int64()), pa.array(root, pa.int64())], ["a", "b"])


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b) and m, the least b of each a. A join, not a window: a hot node's edges are split over tasks."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of every node that isn't the smallest of its component, b being that one.

    Alternating large-star and small-star rounds, each written to the checkpoint folder; the number
    of rounds grows with the logarithm of a component's diameter.
    """
    edges, before = cut(edges.where("a <> b").distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        down = _with_least(down)
        small = down.select(F.col("a"), F.col("m").alias("b")).unionByName(down.select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = cut(small.where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges
        before = state


def _near_sums(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the sum of ny over the rows of y near it, and for each row of y the sum of nx."""
    of_x, of_y = np.zeros(len(x)), np.zeros(len(y))
    columns, nx, ny = np.ascontiguousarray(y.T), nx.astype(np.float64), ny.astype(np.float64)  # whole numbers, added as fast as floats are
    step = max(1, (_PAIRS >> 2) // max(1, len(y)))
    for start in range(0, len(x), step):
        own = slice(start, start + step)
        apart = np.zeros((len(x[own]), len(y)), np.uint16)
        for k in range(BITS // 64):
            apart += np.bitwise_count(x[own, k, None] ^ columns[k])
        near = apart <= TAU
        if near.any():
            near = near.astype(np.float64)
            of_x[own] = near @ ny
            of_y += nx[own] @ near
    return of_x.astype(np.int64), of_y.astype(np.int64)


def _count_links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``it``: root, i, j, side, fp and n, by the first four. Each fp with the documents, of n a row, that its tile has within ``TAU`` bits, itself included."""
    rest = None
    for batch in chain(it, [None]):  # a tile is counted when the next one begins
        if batch is not None:
            more = pa.Table.from_batches([batch])
            rest = more if rest is None else pa.concat_tables([rest, more])
        if rest is None or not rest.num_rows:
            continue
        tile = np.stack([rest.column(k).to_numpy().astype(np.int64) for k in range(3)])
        edge = np.flatnonzero(np.append(True, (tile[:, 1:] != tile[:, :-1]).any(0)))
        if batch is None:
            edge = np.append(edge, rest.num_rows)
        whole, rest = rest.slice(0, edge[-1]), rest.slice(edge[-1])
        if not whole.num_rows:
            continue
        side, n = whole.column(3).to_numpy(), whole.column(5).to_numpy()
        fp = np.frombuffer(b"".join(whole.column(4).to_pylist()), "<u8").reshape(-1, BITS // 64)
        links = np.zeros(len(fp), np.int64)
        for a, b in zip(edge[:-1], edge[1:]):
            if tile[1, a] == tile[2, a]:
                links[a:b] = _near_sums(fp[a:b], n[a:b], fp[a:b], n[a:b])[0]
            else:
                m = a + np.searchsorted(side[a:b], 1)
                links[a:m], links[m:b] = _near_sums(fp[a:m], n[a:m], fp[m:b], n[m:b])
        yield pa.RecordBatch.from_arrays([whole.column(4).combine_chunks(), pa.array(links)], ["fp", "links"])


def _links(members: DataFrame) -> DataFrame:
    """fp and links, the documents within ``TAU`` bits of it, itself included. ``members``: root, m (fingerprints of the root), fp and n (its documents)."""
    parts = F.ceil(F.col("m") / _TILE_ROWS).cast("int")
    rows = members.select("root", "fp", "n", parts.alias("parts"), F.pmod(F.hash("fp"), parts).alias("x"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = rows.select("root", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") > F.col("y")).cast("int").alias("side"), "fp", "n")
    tiles = tiles.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side")
    return tiles.mapInArrow(_count_links, "fp binary, links long").groupBy("fp").agg(F.sum("links").alias("links"))


def near_texts(docs: DataFrame, links: bool = False) -> DataFrame:
    """doc_id, text_hash, group_id, group_size and keep, and n_links if asked for, one row for each distinct (doc_id, text); see ``near_groups``."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_fingerprint_batches, "doc_id long, text_hash long, fp binary")
    prints = cut(rows.groupBy("doc_id", "text_hash").agg(F.min("fp").alias("fp")))
    # a text's node is its doc_id; of texts that share a doc_id all but one have a hash for it
    shared = cut(prints.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text_hash").alias("first")).where("n > 1").select(F.col("doc_id").alias("id"), "first"))
    own = (F.col("first").isNull()) | (F.col("first") == F.col("text_hash"))
    prints = prints.join(frames.sized(shared, shared.count(), 16), F.col("doc_id") == F.col("id"), "left")
    prints = prints.select("doc_id", "text_hash", "fp", F.when(own, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text_hash", "fp")).alias("node"))
    distinct = cut(prints.where("fp is not null").groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("n"), F.min(F.struct("doc_id", "text_hash")).alias("lead")))
    n = distinct.count()
    groups = 1 if n <= _TASK_ROWS else -(-2 * n // _TASK_ROWS)
    sets = max(1, min(_COPIES // max(1, groups - 1), -(-n // _SET_ROWS)))
    tasks = max(1, groups * (groups - 1) // 2) * sets
    spread = distinct.select("fp", "rep").mapInArrow(partial(_spread_rows, groups, sets), "part int, fps binary, reps binary")
    edges = spread.repartitionById(tasks, F.col("part")).mapInArrow(partial(_link, sets), "a long, b long")
    linked = components(edges).select(F.col("a").alias("rep"), F.col("b").alias("root"))
    rooted = cut(distinct.join(linked, "rep", "left").select("fp", "n", "lead", F.coalesce("root", "rep").alias("root")))
    groups = rooted.groupBy("root").agg(F.sum("n").alias("group_size"), F.min("lead").alias("first"), F.count("*").alias("m"))
    named = rooted.select("fp", "n", "root").join(groups, "root")
    columns = ["doc_id", "text_hash", "group_id", "group_size", "keep"]
    if links:
        named = named.join(_links(named.where("m > 1").select("root", "m", "fp", "n")), "fp", "left").withColumn("n_links", F.coalesce("links", "n") - 1)
        columns.append("n_links")
    whole = prints.where("fp is not null").join(named.drop("root"), "fp")
    keep = F.struct("doc_id", "text_hash") == F.col("first")
    grouped = whole.withColumn("group_id", F.col("first.doc_id")).withColumn("keep", keep)
    alone = prints.where("fp is null").withColumn("group_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long")).withColumn("keep", F.lit(True)).withColumn("n_links", F.lit(0).cast("long"))
    return grouped.select(*columns).unionByName(alone.select(*columns))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id, group_size (texts in the group), n_links (the other ones within ``TAU`` bits of its own fingerprint) and keep, one row for each distinct (doc_id, text).

    ``group_id`` is the smallest doc_id of the group and ``keep`` marks it. Defined cases: equal rows are
    one document; rows that share a doc_id but not their text are documents of their own, and may be in different groups,
    of which several may have one group_id; a document without a
    word (null or empty text too) is a group of its own; rows without doc_id are left out; texts of any length are read
    whole; an empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    return near_texts(docs, links=True).select("doc_id", "group_id", "group_size", "n_links", "keep")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest doc_id; same columns, whatever they are called.

    Defined cases: rows without doc_id and rows without a word stay, but of rows with one doc_id and one text
    any one stays, whatever their other columns hold; rows that share a doc_id but not their text are
    judged each for itself; an empty table stays empty.
    """
    columns, key, text = frames.every(docs), frames.fresh(docs, "__key"), frames.fresh(docs, "__text")
    id_, own = F.col("doc_id").cast("long"), F.xxhash64("text")
    gone = cut(near_texts(docs).where(~F.col("keep")).select(F.col("doc_id").alias(key), F.col("text_hash").alias(text)))
    left = docs.join(frames.sized(gone, gone.count(), 16), (id_ == F.col(key)) & (own == F.col(text)), "left_anti").select(*columns)
    repeated = cut(docs.where("doc_id is not null").groupBy(id_.alias(key), own.alias(text)).agg(F.count("*").alias("__n")).where("__n > 1").select(key, text))
    if repeated.isEmpty():
        return left
    few = frames.sized(repeated, repeated.count(), 16)
    same = (id_ == F.col(key)) & (own == F.col(text))
    one = left.join(few, same, "left_semi")
    best = one.groupBy(id_.alias(key), own.alias(text)).agg(F.any_value(F.struct(*columns)).alias("__row")).select("__row.*")
    return left.join(few, same, "left_anti").unionByName(best)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))
