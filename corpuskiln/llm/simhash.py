"""SimHash near-duplicates: an inverted index on byte positions with count filtering.

A fingerprint is 8 positional bytes; two at most 3 bits apart share at least 5 of them. Lists of single bytes would
hold 1 in 256 of all fingerprints each, and their pairs would grow with the square of the input; so fingerprints are
posted under four positional bytes at a time, by the 14 blocks of the Steiner system S(3, 4, 8). Any 5 of the 8
positions contain exactly one of these blocks, so every pair that shares 5 bytes meets in a list. There the pair's
shared positional bytes are tallied; pairs that reach the guaranteed minimum of 5 are retained and verified by their
bits. A list too long for a task is posted again under one more byte, and once more under 6 more bits, which ends with
lists of at most 2 ** 18 fingerprints; inside a task long lists are cut in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import overlap
from ._common import binary_list, map_arrow, map_batches, words_of, write_table
from .components import connected_components

BITS, BYTES, SEED = 64, 8, 42
#: Two fingerprints at most 3 bits apart differ in 3 bytes at most, so they share this many of the 8 positional bytes.
MAX_BITS = 3
SHARED = BYTES - MAX_BITS


def steiner_blocks() -> list[tuple[int, ...]]:
    """The 14 blocks of S(3, 4, 8): both halves of the positions, and the unions of a pair of either half that stand at
    the same place of the halves' three perfect matchings."""
    matchings = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    mixed = [(*p, *(x + 4 for x in q)) for m in matchings for p in m for q in m]
    return [(0, 1, 2, 3), (4, 5, 6, 7), *mixed]


def _byte_mask(positions) -> int:
    return sum(0xFF << (8 * p) for p in positions)


def _posting_masks() -> tuple[np.ndarray, list[list[int]]]:
    """Masks of the posting keys, those of the first round before the others; for each mask the masks that a list
    under it is posted again with."""
    masks, again = [], []
    blocks = steiner_blocks()
    for b in blocks:
        masks.append(_byte_mask(b))
        again.append([])
    for i, b in enumerate(blocks):
        for p in set(range(BYTES)) - set(b):
            again[i].append(len(masks))
            masks.append(_byte_mask((*b, p)))
            again.append([])
    for i in range(len(blocks), len(masks)):
        free = [k for k in range(BITS) if not masks[i] >> k & 1]
        size = len(free) // (MAX_BITS + 1)
        for g in range(MAX_BITS + 1):  # of 4 groups of bits, a pair at most 3 bits apart shares one
            again[i].append(len(masks))
            masks.append(masks[i] | sum(1 << k for k in free[g * size : (g + 1) * size]))
            again.append([])
    return np.array(masks, np.uint64), again


MASKS, AGAIN = _posting_masks()
FIRST = 14
#: Rows of a list that a task holds; longer lists are posted again. No list of the last masks is longer.
LONG = 1 << 18
#: Lists up to this length are compared pair by pair (inside numpy); longer ones are cut by further bits first.
PAIRWISE = 1024


def simhash(text: bytes | None, shingle: int = 3) -> int:
    """64-bit fingerprint: bit set if set in over half of the XXH64 hashes (seed 42) of the word shingles.

    A-Z is lower-cased; repeated shingles count; fewer words than shingle: the whole sequence; no words: 0.
    """
    words = words_of(text.lower() if text else None)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    n = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(n + 1) - 1
    start = end - n
    h = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row. Null and empty texts have 0."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([simhash(t, shingle) for t in binary_list(batch.column(1))], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), make, f"doc_id {kind}, fp bigint")


def links(nodes: DataFrame) -> DataFrame:
    """nodes (fp), each once -> edges (a, b) of fingerprints that join all within MAX_BITS of one another.

    A list gives the edges of a chain through each of its connected parts, so that a list of n fingerprints gives
    fewer than n edges and no node becomes a hub.
    """
    spark = nodes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    post = nodes.select(F.explode(F.array(*[F.lit(i) for i in range(FIRST)])).alias("c"), "fp")
    masks = F.array(*[F.lit(int(m.view(np.int64))) for m in MASKS])
    edges = None
    while True:
        key = F.element_at(masks, F.col("c") + 1).bitwiseAND(F.col("fp"))
        dealt = post.repartition(n, "c", key).sortWithinPartitions("c", key)
        found = write_table(map_arrow(dealt, _link_lists, "a bigint, b bigint, c int, fp bigint"), "simhash-links")
        some = found.where("a is not null").select("a", "b")
        edges = some if edges is None else edges.unionByName(some)
        post = found.where("c is not null").select("c", "fp")
        if post.isEmpty():  # at the latest after the third round
            return edges


def _link_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (c, fp), sorted by posting list -> edges, and the rows of lists that are too long, under their next masks."""
    held: list[np.ndarray] = []
    size, over = 0, None  # rows held, and the list that is passed on just now

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        if size:
            yield from _edges(np.concatenate(held, axis=1))
        held, size = [], 0

    for batch in batches:
        now = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)])
        if not now.shape[1]:
            continue
        key = now[1].view(np.uint64) & MASKS[now[0]]
        new = np.flatnonzero((now[0, 1:] != now[0, :-1]) | (key[1:] != key[:-1])) + 1
        cut = int(new[-1]) if len(new) else 0  # where the batch's last list begins
        first = int(new[0]) if len(new) else now.shape[1]  # and where its first ends
        if over == (now[0, 0], key[0]):
            yield from _posted_again(now[:, :first])
            now, cut = now[:, first:], cut - first
            if not now.shape[1]:
                continue
        elif held and (held[-1][0, -1], held[-1][1, -1:].view(np.uint64)[0] & MASKS[held[-1][0, -1]]) != (now[0, 0], key[0]):
            yield from close()
        over = None
        if cut > 0:  # all lists but the last one are whole
            held.append(now[:, :cut])
            size += cut
            yield from close()
            now = now[:, cut:]
        held.append(now)
        size += now.shape[1]
        if size > LONG and AGAIN[now[0, -1]]:
            yield from _posted_again(np.concatenate(held, axis=1))
            over = (now[0, -1], now[1, -1:].view(np.uint64)[0] & MASKS[now[0, -1]])
            held, size = [], 0
    yield from close()


def _posted_again(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    c = np.concatenate([np.full(rows.shape[1], x) for x in AGAIN[rows[0, 0]]])
    none = pa.nulls(len(c), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, pa.array(c.astype(np.int32)), pa.array(np.tile(rows[1], len(AGAIN[rows[0, 0]])))], ["a", "b", "c", "fp"])


def _edges(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    c, fp = rows[0], rows[1].view(np.uint64)
    key = fp & MASKS[c]
    first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (key[1:] != key[:-1]))))
    length = np.diff(np.append(first, len(c)))
    parent = np.arange(len(c))
    small = length <= PAIRWISE
    _pairwise(fp, np.repeat(np.where(small, first + length, 0), length) - np.arange(len(c)) - 1, np.arange(len(c)), parent)
    for i in np.flatnonzero(~small):
        _cut(fp, np.arange(first[i], first[i] + length[i]), parent)
    root = _roots(parent)
    order = np.lexsort((fp, root))
    a, b = order[:-1], order[1:]
    ok = root[a] == root[b]
    if ok.any():
        none = pa.nulls(int(ok.sum()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(fp[a[ok]].view(np.int64)), pa.array(fp[b[ok]].view(np.int64)), none, pa.nulls(len(none), pa.int64())], ["a", "b", "c", "fp"])


def _pairwise(fp: np.ndarray, left: np.ndarray, rows: np.ndarray, parent: np.ndarray) -> None:
    """Joins in parent the pairs of rows[i] with the left[i] rows after it that pass the tally and the check."""
    at, d = np.flatnonzero(left > 0), 1
    while len(at):
        x, y = rows[at], rows[at + d]
        ok = _verified(fp[x], fp[y])
        _union(parent, x[ok], y[ok])
        d += 1
        at = at[left[at] >= d]


def _cut(fp: np.ndarray, rows: np.ndarray, parent: np.ndarray) -> None:
    """A long list, cut by 4 groups of the bits that its members differ in: a linked pair shares one group at least."""
    own = fp[rows]
    vary = int(np.bitwise_or.reduce(own ^ own[0]))
    bits = [b for b in range(BITS) if vary >> b & 1]
    for g in range(MAX_BITS + 1):
        mask = np.uint64(sum(1 << b for b in bits[g :: MAX_BITS + 1]))
        order = np.argsort(own & mask, kind="stable")
        part = own[order] & mask
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        length = np.diff(np.append(first, len(part)))
        small = (length <= PAIRWISE) | (length == len(rows))
        _pairwise(fp, np.repeat(np.where(small, first + length, 0), length) - np.arange(len(part)) - 1, rows[order], parent)
        for i in np.flatnonzero(~small):
            _cut(fp, rows[order[first[i] : first[i] + length[i]]], parent)


def _verified(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs share enough positional bytes, and of these which are near enough."""
    diff = x ^ y
    tally = (diff.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    near = np.flatnonzero(tally >= SHARED)
    out = np.zeros(len(x), bool)
    out[near] = np.bitwise_count(diff[near]) <= MAX_BITS
    return out


def _roots(parent: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        parent[:] = _roots(parent)
        x, y = parent[a], parent[b]
        ok = x != y
        a, b, x, y = a[ok], b[ok], x[ok], y[ok]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def near_duplicates(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of at most MAX_BITS bits, itself included).

    Texts that give one fingerprint are one node, so exact copies never form pairs. Null and empty texts have
    fingerprint 0 and link like any other. Rows with null ids get the component of an equal fingerprint (null if no
    other row has it) and link nothing; repeated ids are fine, and ids may have any type that sorts. An empty table
    gives no rows. Other columns are ignored. The last join meets a frequent fingerprint (empty texts) on one side
    only, so adaptive execution can split it.
    """
    prints = write_table(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "simhash-fp")
    reps = write_table(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    parts = connected_components(links(reps.select("fp")))
    linked = reps.join(parts, reps["fp"] == parts["node"], "left").select(F.col("fp").alias("_fp"), "rep", F.coalesce("component", "fp").alias("_part"))
    least = linked.groupBy("_part").agg(F.min("rep").alias("component_id"))
    named = write_table(linked.join(least, "_part").select("_fp", "component_id"), "simhash-parts")
    return prints.join(named, prints["fp"] == named["_fp"], "left").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame, *, shingle: int = 5, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of each row with an id: components over the links of fingerprints and, as 3 bits leave many
    near copies apart, over those of an exact search for sets of shingles of the similarity or more. Ids are bigint."""
    near = near_duplicates(docs, shingle=shingle, id_col=id_col, text_col=text_col).where("doc_id is not null").select("doc_id", F.col("component_id").alias("a")).distinct()
    alike = overlap.near_copies(docs, shingle=shingle, similarity=similarity, id_col=id_col, text_col=text_col).select("doc_id", F.col("component_id").alias("b")).distinct()
    both = write_table(near.join(alike, "doc_id"), "simhash-both")
    parts = connected_components(both.select("a", "b"))  # a group's smallest id is its component
    named = both.join(parts, both["a"] == parts["node"], "left")
    return named.select("doc_id", F.coalesce("component", "a").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", similarity: float | None = None, **options) -> DataFrame:
    """docs with the row of the smallest id of each group of near-duplicates, by fingerprints (with a similarity: by
    near_copies). Rows of one id stay or go together; rows with null ids stay. All columns are kept."""
    groups = near_duplicates(docs, id_col=id_col, **options) if similarity is None else near_copies(docs, id_col=id_col, similarity=similarity, **options)
    found = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs[id_col] == found["_gone"], "left_anti")
