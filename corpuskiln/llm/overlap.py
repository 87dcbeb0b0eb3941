"""Near-duplicates by shared shingles: an exact search for all that a Jaccard similarity or more links.

Each distinct set of shingles is a node. Shingles are put into one order, rare ones first; of two sets that are alike
enough, the first few of each share one, so only those are posted. Of a posting list first only neighbours are paired,
in an order by a minimum hash that puts likely copies side by side; what passes by length and position is verified by
the whole sets. Then all pairs of members that are not connected yet are looked at, so that no link is lost and a
group of copies costs a few pairs a member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_list, hash_words, map_arrow, map_batches, mix64, words_of, write_table
from .components import connected_components
from .knlm import gram_hash

#: Members of a posting list that each one is paired with at first, on either side.
NEIGHBOURS = 2
#: Orders by minimum hash; a list's own hash chooses among them.
ORDERS = 4
#: Cells of the table that counts all shingles by hash, and the blocks that it is added up in.
CELLS, BLOCKS = 1 << 21, 32
#: Bits of the table of representatives whose sets are wanted.
WANTED_BITS = 1 << 24
#: 64-bit words of a signature.
SIGNATURE = 8
#: Members of a list after each one that are paired with it in a round across parts; the last round takes all (None).
ACROSS = (None,)
#: Pairs that are held before repeated ones are taken out.
HELD = 2_000_000
_MARKS = [f"s{i}" for i in range(SIGNATURE)]
_SEEDS = mix64(np.arange(1, ORDERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles. A-Z is lower-cased; fewer words than shingle: the whole
    sequence; no words: none."""
    h = hash_words(words_of(text.lower() if text else None))
    k = min(shingle, len(h))
    return np.unique(gram_hash([h[i : len(h) - k + 1 + i] for i in range(k)])) if k else h


def node_of(shingles: np.ndarray) -> int:
    """64-bit digest of a set, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def least_shared(n, similarity: float):
    """Shingles that two sets must share for the similarity, given the sum of their sizes."""
    return np.ceil(similarity / (1 + similarity) * n - 1e-9)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles by hash, as SIGNATURE signed words."""
    bits = np.bincount((shingles >> np.uint64(24)).astype(np.int64) % (64 * SIGNATURE), minlength=64 * SIGNATURE) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def pack_set(shingles: np.ndarray) -> bytes:
    """A sorted set as the bytes of its differences, plane by plane, compressed."""
    steps = np.diff(shingles, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_set(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _nodes_and_counts(texts: DataFrame, shingle: int) -> DataFrame:
    """A row (doc_id, node, signature) for each text, and for each task rows (block, counts) of how many of its different sets
    have a shingle of each cell."""
    kind, names = texts.schema["doc_id"].dataType, ["doc_id", "node", "block", "counts", *_MARKS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, done, ids = np.zeros(CELLS, np.int32), set(), None
        for batch in batches:
            nodes, marks = [], []
            for text in binary_list(batch.column(1)):
                s = shingle_set(text, shingle)
                nodes.append(node_of(s))
                marks.append(signature(s))
                if nodes[-1] not in done:
                    done.add(nodes[-1])
                    np.add.at(cells, _cell(s), 1)
            n, ids = len(nodes), batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(nodes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *[pa.array(x) for x in np.stack(marks, axis=1)]], names)
        if ids is not None:
            parts = [zstandard.compress(x.tobytes(), 1) for x in cells.reshape(BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays([pa.nulls(BLOCKS, ids.type), pa.nulls(BLOCKS, pa.int64()), pa.array(np.arange(BLOCKS), pa.int32()), pa.array(parts, pa.binary()), *[pa.nulls(BLOCKS, pa.int64())] * SIGNATURE], names)

    return map_arrow(texts, run, f"doc_id {kind.simpleString()}, node bigint, block int, counts binary, {', '.join(f'{x} bigint' for x in _MARKS)}")


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(CELLS - 1)).astype(np.int64)


def _added_up(counts: DataFrame) -> np.ndarray:
    """The counts of all cells over all texts. They set the order of shingles, not what is found; their number is
    fixed, and so is what the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zstandard.decompress(x), np.int32).astype(np.int64)
                held[b] = held[b] + part if b in held else part
        if held:
            packed = [zstandard.compress(np.minimum(x, (1 << 31) - 1).astype(np.int32).tobytes(), 1) for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], ["block", "counts"])

    out = np.zeros((BLOCKS, CELLS // BLOCKS), np.int32)
    for r in map_arrow(counts.select("block", "counts").repartitionById(BLOCKS, "block"), run, "block int, counts binary").collect():
        out[r.block] = np.frombuffer(zstandard.decompress(bytes(r.counts)), np.int32)
    return out.ravel()


def _postings(texts: DataFrame, counts: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """h, n, at, m, node: the first shingles of each set, its size, their places, and the set's minimum hash in the
    order that h chooses. A task posts equal sets once."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def make():
        counts, done = shared.value, set()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for text in binary_list(batch.column(0)):
                s = shingle_set(text, shingle)
                node = node_of(s)
                if not len(s) or node in done:
                    continue
                done.add(node)
                k = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1
                first = s[np.argsort(counts[_cell(s)], kind="stable")[:k]]
                least = np.array([mix64(s ^ x).min() for x in _SEEDS])
                out.append((first.view(np.int64), np.full(k, len(s), np.int32), np.arange(k, dtype=np.int32), (least[_order(first)] >> np.uint64(33)).astype(np.int32), np.full(k, node)))
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["h", "n", "at", "m", "node"])

        return one

    return map_batches(texts.select("text"), make, "h bigint, n int, at int, m int, node bigint")


def _order(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(ORDERS)).astype(np.int64)


def _passes(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sizes and places leave room for the similarity."""
    rest = np.minimum(n[i] - at[i], n[j] - at[j])
    return (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9) & (rest >= least_shared(n[i] + n[j], similarity))


def _neighbour_pairs(rows: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole lists (h, n, at, m, node) -> pairs of neighbours, and the rows of lists that have other pairs as well."""
    rows = rows[:, np.lexsort((rows[4], rows[0]))]
    rows = rows[:, np.concatenate(([True], (rows[0, 1:] != rows[0, :-1]) | (rows[4, 1:] != rows[4, :-1])))]
    rows = rows[:, np.lexsort((rows[4], rows[1], rows[3], rows[0]))]
    h, n, at, _, node = rows
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    length = np.diff(np.append(first, len(h)))
    left = np.repeat(first + length, length) - np.arange(len(h)) - 1  # members that follow in its list
    out = [np.zeros((2, 0), np.int64)]
    for d in range(1, NEIGHBOURS + 1):
        i = np.flatnonzero(left >= d)
        i = i[_passes(n, at, i, i + d, similarity)]
        out.append(_pair(node[i], node[i + d]))
    return np.concatenate(out, axis=1), rows[:, np.repeat(length > NEIGHBOURS + 1, length)]


def _cross_pairs(limit: int | None):
    """Whole lists (h, n, at, part, node, signature) -> pairs of different parts that pass; limit: only with so many of
    the members that follow in the order of sizes."""

    def pairs(rows: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[:, np.lexsort((rows[4], rows[1], rows[0]))]
        h, n, at, part, node = rows[:5]
        marks = np.ascontiguousarray(rows[5:].T).view(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        length = np.diff(np.append(first, len(h)))
        several = np.minimum.reduceat(part, first) != np.maximum.reduceat(part, first)
        left = np.repeat(np.where(several, first + length, 0), length) - np.arange(len(h)) - 1
        left = left if limit is None else np.minimum(left, limit)
        out, i, d = [np.zeros((2, 0), np.int64)], np.flatnonzero(left > 0), 1
        while len(i):
            j = i + d
            near = n[i] >= similarity * n[j] - 1e-9  # sizes ascend, so no later member is nearer
            i, j = i[near], j[near]
            ok = np.flatnonzero((part[i] != part[j]) & _passes(n, at, i, j, similarity))
            x, y = i[ok], j[ok]
            differ = np.bitwise_count(marks[x] ^ marks[y]).sum(axis=1, dtype=np.int64)
            some = differ <= n[x] + n[y] - 2 * least_shared(n[x] + n[y], similarity)
            out.append(_pair(node[x[some]], node[y[some]]))
            d += 1
            i = i[left[i] >= d]
        return np.concatenate(out, axis=1), rows[:, :0]

    return pairs


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack((np.minimum(a, b), np.maximum(a, b)))


def _list_map(pairs_of, similarity: float):
    """Rows of numbers, sorted by the first -> distinct a, b in each task, and rows that are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal found, size
            if size:
                both = np.unique(np.concatenate(found, axis=1), axis=1)
                n = both.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], ["a", "b", "h", "n", "at", "node"])
            found, size = [], 0

        def take(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal size
            both, on = pairs_of(part, similarity)
            found.append(both)
            size += both.shape[1]
            if k := on.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(on[0]), pa.array(on[1].astype(np.int32)), pa.array(on[2].astype(np.int32)), pa.array(on[4])], ["a", "b", "h", "n", "at", "node"])
            if size >= HELD:
                yield from flush()

        for batch in batches:
            now = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if not now.shape[1]:
                continue
            other = np.flatnonzero(now[0] != now[0, -1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if rows and (cut or rows[-1][0, -1] != now[0, 0]):  # all lists but the last one are whole
                yield from take(np.concatenate([*rows, now[:, :cut]], axis=1))
                rows = []
            elif cut:
                yield from take(now[:, :cut])
            rows.append(now[:, cut:])
        if rows:
            yield from take(np.concatenate(rows, axis=1))
        yield from flush()

    return run


def _wanted(ids: DataFrame) -> np.ndarray:
    """A table of WANTED_BITS bits with those of the ids' keys set: of fixed size, and it only saves work."""
    cell = F.pmod("key", F.lit(WANTED_BITS))
    words = ids.select((cell / 32).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(key, {WANTED_BITS}) % 32 as int))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(WANTED_BITS // 32, np.uint32)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint32)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, prints: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike enough."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = write_table(prints.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("_id")).select(F.xxhash64("_id").alias("key"), "node"), "overlap-wanted")
    shared = texts.sparkSession.sparkContext.broadcast(_wanted(ids))

    def make():
        bits, done = shared.value, set()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            cell = batch.column(0).to_numpy() % WANTED_BITS
            some = np.flatnonzero(bits[cell >> 5] >> (cell & 31).astype(np.uint32) & np.uint32(1))
            nodes, sets = [], []
            for text in binary_list(batch.column(1).take(pa.array(some))):
                s = shingle_set(text, shingle)
                if (node := node_of(s)) not in done:
                    done.add(node)
                    nodes.append(node)
                    sets.append(pack_set(s))
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "s"]) if nodes else None

        return one

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.sort(np.concatenate((unpack_set(x), unpack_set(y))), kind="stable")
                ok.append(bool((both[1:] == both[:-1]).sum() >= least_shared(len(both), similarity)))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok, pa.bool_())) for i in (0, 1)], ["a", "b"])

    some = map_batches(texts.select(F.xxhash64("doc_id").alias("key"), "text"), make, "node bigint, s binary")
    sets = write_table(some.join(ids.select("node"), "node", "left_semi").dropDuplicates(["node"]), "overlap-sets")
    x, y = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    return write_table(map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), check, "a bigint, b bigint"), "overlap-edges")


def near_copies(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over pairs of the similarity or more, itself included) of each
    row with an id. Null and empty texts are alike, and texts of the same shingles are one node. Rows of one id count
    each; ids may have any type that sorts. An empty table gives no rows. Other columns are ignored."""
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = write_table(_nodes_and_counts(texts, shingle), "overlap-nodes")
    prints = seen.where("node is not null").select("doc_id", "node")
    post = _postings(texts, _added_up(seen.where("block is not null")), shingle, similarity)
    out = "a bigint, b bigint, h bigint, n int, at int, node bigint"
    found = write_table(map_arrow(post.repartition(n, "h").sortWithinPartitions("h"), _list_map(_neighbour_pairs, similarity), out), "overlap-pairs")
    pairs = found.where("a is not null").select("a", "b").distinct()
    edges = _verified(pairs, texts, prints, shingle, similarity)
    parts = connected_components(edges)
    marks = seen.where("node is not null").select(F.col("node").alias("_own"), *_MARKS).dropDuplicates(["_own"])
    lists = found.where("h is not null").join(marks, F.col("node") == F.col("_own")).select("h", "n", "at", "node", *_MARKS)
    for limit in ACROSS:
        rest = lists.join(parts.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        rest = rest.select("h", "n", "at", F.coalesce("component", "node").alias("part"), "node", *_MARKS)
        more = map_arrow(rest.repartition(n, "h").sortWithinPartitions("h"), _list_map(_cross_pairs(limit), similarity), out)
        more = write_table(more.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "overlap-more")
        if not more.isEmpty():
            pairs = pairs.unionByName(more)
            edges = edges.unionByName(_verified(more, texts, prints, shingle, similarity))
            parts = connected_components(edges)
    reps = prints.groupBy("node").agg(F.min("doc_id").alias("rep"))
    linked = reps.join(parts.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", "rep", F.coalesce("component", "node").alias("_part"))
    linked = write_table(linked, "overlap-reps")
    least = linked.groupBy("_part").agg(F.min("rep").alias("component_id"))
    named = write_table(linked.join(least, "_part").select(F.col("node").alias("_node"), "component_id"), "overlap-parts")
    return prints.join(named, prints["node"] == named["_node"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with the row of the smallest id of each group of near-duplicates. Rows of one id stay or go together; rows
    with null ids stay. All columns are kept."""
    found = near_copies(docs, id_col=id_col, **options).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs[id_col] == found["_gone"], "left_anti")
