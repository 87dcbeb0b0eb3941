"""Token ids in Arrow IPC files: batches of fixed-size lists, with masks, for zero-copy random access.

Each shard is a file of equal-length sequences (input_ids and mask, both fixed-size lists) and an index file with a
row for each document (doc_id, start, n_tokens) that points into the shard's stream of ids.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import binary_list, commit_file, map_arrow, open_file

SEQ_LEN = 2048
#: Sequences in a record batch.
BATCH_ROWS = 128
#: Words whose ids a worker remembers; when full, the memory starts anew, so that it stays below about 200 MB.
CACHE_WORDS = 800_000
#: Punctuation that is a piece of its own after letters.
TAIL = b",.;:!?%$#*&|()"
#: The split of the vocabularies whose texts may be encoded word by word.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def works_by_words(spec: dict) -> bool:
    """Whether a vocabulary's file says that the ids of a text are those of its lower-cased words in turn: it folds white
    space and case, splits by WORD_SPLIT, marks the ends of pieces, and has no added token but those of the form <|...|>."""
    folds = (spec.get("normalizer") or {}).get("normalizers") or []
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        [x.get("type") for x in folds] == ["NFC", "Replace", "Lowercase"]
        and (folds[1].get("pattern"), folds[1].get("content")) == ({"Regex": r"\s+"}, " ")
        and [x.get("type") for x in splits] == ["Split", "ByteLevel"]
        and (splits[0].get("pattern"), splits[0].get("behavior"), splits[0].get("invert")) == ({"Regex": WORD_SPLIT}, "Removed", True)
        and not splits[1].get("add_prefix_space")
        and not splits[1].get("use_regex")
        and (spec.get("model") or {}).get("end_of_word_suffix") == "</w>"
        and all(x["content"].startswith("<|") and x["content"].endswith("|>") for x in spec.get("added_tokens") or [])
    )


class WordTokenizer:
    """A tokenizer with a memory of words, where its vocabulary allows one.

    Where works_by_words() holds, the ids of a text are those of its words in turn; other vocabularies encode whole texts
    by the library. A new word of letters, with or without punctuation after it, is two pieces at most; new letter
    parts are encoded many at a time, as one text, and told apart by the tokens that end a piece. All other new words
    are encoded one by one.
    """

    _made: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf8") as f:
            self.by_words = works_by_words(json.load(f))
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _one_by_one(self, words: list[bytes]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, self.dtype).tobytes()

    def _learn(self, words: set[bytes]) -> None:
        known, odd, cores, tailed = self.known, [], {}, []
        for w in words:
            core = w.rstrip(TAIL)
            if core.isalpha() or (core and not core.isascii() and (s := core.decode()).lower().isalpha() and max(s) < "\u0250"):
                if core not in known:
                    cores[core] = None
                if len(core) < len(w):
                    tailed.append((w, core, w[len(core) :]))
            else:
                odd.append(w)
        odd += {t for _, _, t in tailed if t not in known}
        it = iter(cores)
        while part := list(islice(it, 2000)):
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, self.dtype)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part):
                odd += part
                continue
            packed, cut = ids.tobytes(), (cut * self.dtype.itemsize).tolist()
            for w, i, j in zip(part, [0, *cut], cut, strict=False):
                known[w] = packed[i:j]
        self._one_by_one(odd)
        for w, core, tail in tailed:
            known[w] = known[core] + known[tail]

    def encode(self, text: bytes | None) -> bytes:
        """The ids of a text, packed. Null has none."""
        if not text:
            return b""
        if not self.by_words:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.dtype).tobytes()
        words = (text if b"<|" in text else text.lower()).split()
        got = list(map(self.known.get, words))
        if None in got:
            new = {w for w, g in zip(words, got, strict=True) if g is None}
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known.clear()
                new = set(words)
            self._learn(new)
            got = map(self.known.__getitem__, words)
        return b"".join(got)


def _schema(dtype: np.dtype, seq_len: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class _Writer:
    """Packs a stream of ids into sequences and writes them as record batches."""

    def __init__(self, sink, dtype: np.dtype, seq_len: int):
        self.schema, self.dtype, self.seq_len = _schema(dtype, seq_len), dtype, seq_len
        self.out, self.held, self.n = pa.ipc.new_file(sink, self.schema), [], 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.n += len(ids) // self.dtype.itemsize
        if self.n >= self.seq_len * BATCH_ROWS:
            # whole batches only: readers find a sequence's batch by division
            self._flush(self.n - self.n % (self.seq_len * BATCH_ROWS))

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        rest, ids = ids[n:], ids[:n]
        pad = -len(ids) % self.seq_len
        full = np.concatenate((ids, np.zeros(pad, self.dtype)))
        mask = np.arange(len(full)) < len(ids)
        for at in range(0, len(full), self.seq_len * BATCH_ROWS):
            part = slice(at, at + self.seq_len * BATCH_ROWS)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[part]), self.seq_len) for x in (full, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.n = [rest.tobytes()], len(rest)

    def close(self) -> None:
        if self.n:
            self._flush(self.n)
        self.out.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int = 2, seq_len: int = SEQ_LEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes docs into folder, in ascending order of id over all shards; returns the shards.

    Returns shard (int, ascending), tokens (real ids in it), docs. Each document's ids are followed by end_id. Null
    and empty texts give end_id alone. Null ids come first; rows with equal ids follow in the order of their texts.
    An empty table writes no shards. Shards are range partitions of the id, each written by one task under a
    temporary name and renamed, so a repeated task leaves the same file.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = TaskContext.get().partitionId(), []
        state = {"at": 0, "docs": 0}

        def write(sink) -> None:
            coder = WordTokenizer.load(tokenizer_path)
            end = np.array([end_id], coder.dtype).tobytes()
            writer = _Writer(sink, coder.dtype, seq_len)
            for batch in (first, *batches):
                sizes = np.zeros(batch.num_rows, np.int64)
                for i, text in enumerate(binary_list(batch.column(1))):
                    ids = coder.encode(text) + end
                    sizes[i] = len(ids) // coder.dtype.itemsize
                    writer.add(ids)
                start = state["at"] + np.cumsum(sizes) - sizes
                index.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array(start), pa.array(sizes)], ["doc_id", "start", "n_tokens"]))
                state["at"] += int(sizes.sum())
                state["docs"] += batch.num_rows
            writer.close()

        def write_index(sink) -> None:
            with pa.ipc.new_file(sink, index[0].schema) as out:
                for b in index:
                    out.write_batch(b)

        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            commit_file(shard_file(folder, shard), write)
            commit_file(index_file(folder, shard), write_index)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "tokens": state["at"], "docs": state["docs"]}], pa.schema([("shard", pa.int32()), ("tokens", pa.int64()), ("docs", pa.int64())]))

    return map_arrow(dealt, run, "shard int, tokens bigint, docs bigint")


def shard_file(folder: str, shard: int) -> str:
    return f"{folder}/tokens-{shard:06d}.arrow"


def index_file(folder: str, shard: int) -> str:
    return f"{folder}/index-{shard:06d}.arrow"


class Shard:
    """Random access to one shard: sequence(i) and mask(i) are views of the mapped file; ids(a, b) spans sequences."""

    def __init__(self, folder: str, shard: int):
        self.source = open_file(shard_file(folder, shard))
        self.file = pa.ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("input_ids").type.list_size
        self.index = pa.ipc.open_file(open_file(index_file(folder, shard)))

    def __len__(self) -> int:
        full = self.file.num_record_batches
        return (full - 1) * BATCH_ROWS + self.file.get_batch(full - 1).num_rows if full else 0

    def _values(self, batch: int) -> np.ndarray:
        return self.file.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> np.ndarray:
        at = i % BATCH_ROWS * self.seq_len
        return self._values(i // BATCH_ROWS)[at : at + self.seq_len]

    def mask(self, i: int) -> pa.Array:
        """The mask as a slice of the mapped bits."""
        return self.file.get_batch(i // BATCH_ROWS).column(1).slice(i % BATCH_ROWS, 1).flatten()

    def ids(self, start: int, stop: int) -> np.ndarray:
        size, parts = BATCH_ROWS * self.seq_len, []
        for b in range(start // size, (stop - 1) // size + 1):
            parts.append(self._values(b)[max(start - b * size, 0) : stop - b * size])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_tokens(spark: SparkSession, folder: str, shards: list[tuple[int, int]], id_type: str = "bigint") -> DataFrame:
    """The documents of written shards, from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian unsigned 32-bit integers). shards: (shard, tokens), all of them."""
    base, rows = 0, []
    for shard, tokens in sorted(shards):
        rows.append((shard, base))
        base += tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = Shard(folder, shard)
                for b in range(held.index.num_record_batches):
                    docs = held.index.get_batch(b)
                    start, n = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crc = [zlib.crc32(held.ids(a, a + k).astype("<u4").tobytes()) for a, k in zip(start.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(start + first), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    made = spark.createDataFrame(rows, "shard int, base bigint").repartition(max(1, len(rows)))
    return map_arrow(made, run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
