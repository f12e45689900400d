"""Best-fit packing of tokenised documents into sequences of fixed length.

One scan tokenises documents and stores their pieces. Pieces then stream, in as few tasks as their number allows,
through a bounded number of open bins, so memory does not depend on the input, nothing is shuffled, and the number of
sequences hardly depends on how the input was partitioned. Open bins are kept by their free space in a
bitset: the least free space that still holds a piece is one shift and one lowest-bit
operation away. When a new bin would exceed the bound, the fullest open bin closes.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.common import documents, small_batches, spread, stash

#: Tokens of a sequence, open bins of a task, id that ends a document.
SEQUENCE, OPEN_BINS, END = 2048, 512, 0
#: Vocabulary, and the same as ranks.
VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: First code point that the fast encoder leaves to the reference tokenizer. Below it the
#: letter, digit and space classes of the split pattern are the same in every Unicode version.
SETTLED = "ɐ"
#: The fast encoder's pattern matcher gives up on runs of white space of several hundred thousand; longer ones than this are left to the tokenizer.
LONG_RUN = re.compile(r"\s{100000}")
#: Pieces that a task places, about.
TASK_PIECES = 200_000

PIECES = {"doc_id": None, "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "tokens": pa.binary(), "ids_crc32": pa.int64()}


class Encoder:
    """Ids of texts as `tokenizers` gives them, special tokens' names being ordinary text.

    The ranks file holds the same vocabulary; its encoder takes texts whose characters are
    all below SETTLED and is four times as fast. Other texts go through `tokenizers` itself, and so do those that the
    fast encoder fails on.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.exact.encode_special_tokens = True
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and (not text or max(text) < SETTLED) and not (len(text) >= 100_000 and LONG_RUN.search(text)):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as failure:  # a panic of the native code isn't an Exception
                if type(failure).__name__ != "PanicException":
                    raise
        return self.exact.encode(text, add_special_tokens=False).ids


_encoders: dict[tuple, Encoder] = {}


def encoder(vocabulary: str, ranks: str | None) -> Encoder:
    """One encoder for each Python worker."""
    if (vocabulary, ranks) not in _encoders:
        _encoders[vocabulary, ranks] = Encoder(vocabulary, ranks)
    return _encoders[vocabulary, ranks]


class Bins:
    """Bounded-space best fit. `put` gives (bin, offset); bins are numbered from 0 as they open."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.free_bits = 0  # bit f: some open bin has f free
        self.by_free: dict[int, list[int]] = {}
        self.open = self.opened = 0

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most_open:  # the fullest closes
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
                self.open -= 1
            number, free = self.opened, self.capacity
            self.opened += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(number)
            self.free_bits |= 1 << left
        else:
            self.open -= 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        numbers = self.by_free[free]
        number = numbers.pop()
        if not numbers:
            del self.by_free[free]
            self.free_bits &= ~(1 << free)
        return number


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, vocabulary: str | None = None, ranks: str | None = None, tokens: bool = True) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, and tokens or their checksum ids_crc32."""
    small_batches(docs.sparkSession)
    names = [n for n in PIECES if n != ("ids_crc32" if tokens else "tokens")]

    def run(batches):
        own_vocabulary, own_ranks = vocabulary, ranks
        if own_vocabulary is None:
            import public_tokenizers

            own_vocabulary, own_ranks = public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)
        encode = encoder(own_vocabulary, own_ranks)
        for batch in batches:
            rows: list[tuple] = []
            sources: list[int] = []
            for n, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(np.array(encode(text or ""), dtype="<u4"), np.uint32(END))
                start, piece = 0, 0
                while start < len(ids):
                    length = (len(ids) - start) % sequence or min(sequence, len(ids) - start)
                    own = ids[start : start + length].tobytes()
                    rows.append((piece, start, length, own if tokens else zlib.crc32(own)))
                    sources.append(n)
                    start, piece = start + length, piece + 1
            columns = list(zip(*rows)) or [()] * 4
            arrays = [batch.column(0).take(pa.array(sources, pa.int64())), *(pa.array(c, PIECES[k]) for c, k in zip(columns, names[1:]))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, {'tokens binary' if tokens else 'ids_crc32 bigint'}"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def place(cut: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to rows with a length, in the order of their partition."""

    def run(batches):
        bins, first_id = Bins(sequence, open_bins), TaskContext.get().partitionId() << 32
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("length") if at is None else at
            found = [bins.put(n) for n in batch.column(at).to_pylist()]
            ids = pa.array([first_id + number for number, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array([offset for _, offset in found], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return cut.mapInArrow(run, f"{fields}, sequence_id bigint, `offset` bigint")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    open_bins: int = OPEN_BINS,
    vocabulary: str | None = None,
    ranks: str | None = None,
    tokens: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, tokens, sequence_id, offset.

    A document is its text's ids and the end id; null and empty texts are the end id alone.
    One longer than a sequence is cut from its end into whole sequences, so its first piece
    may be shorter. `tokens` holds little-endian unsigned 32-bit ids, or with `tokens=False` ids_crc32 their checksum. Sequence ids are the
    placing task's number and a count, the same whenever the task runs again. Repeated rows are packed
    again; null ids stay null; an empty table gives no piece; other columns are not read.
    `vocabulary` and `ranks` are paths that executors can open; by default the installed public files.
    """
    cut = stash(pieces(docs, id_col, text_col, sequence, vocabulary, ranks, tokens))
    return place(cut.coalesce(max(1, -(-cut.count() // TASK_PIECES))), sequence, open_bins)


def packed_rows(docs: DataFrame) -> DataFrame:
    """Pieces with a checksum in the place of their tokens."""
    return pack(docs, tokens=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit(spark, sf_dir: str) -> DataFrame:
    return packed_rows(spread(documents(spark, sf_dir)))


QUERIES = {"op4_best_fit": op4_best_fit}
ORACLE: dict[str, str] = {}
