"""Best-fit packing with certified bin counts.

``pack`` cuts long documents into pieces, packs the pieces of each partition by
best-fit decreasing, and certifies the partition's bin count with lower bounds
from dual-feasible functions. Partitions whose count exceeds the bound give the
documents of their loose bins to an exchange, which is packed again in fewer
partitions, until no partition has a gap or one partition is left.

Null texts count as empty; an empty text is a piece of one separator token.
Repeated rows are packed as often as they occur. Ties in length go by the order
of the rows. Very long texts are tokenised whole, one at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash, whole_text

SEQUENCE = 2048
SEPARATOR = 0
#: Pieces that one partition packs; a bound on a task's memory.
PIECES_PER_PARTITION = 40_000
#: Exchanges after which a partition keeps its gap.
ROUNDS = 5
#: Strings with characters from here on are encoded by the slower library.
_PLAIN = 0x250
_SPECIAL = "<|endoftext|>"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of the 50k byte-level BPE vocabulary.

    The rank file holds the same vocabulary and merges as the JSON file, and its
    encoder gives the same ids several times faster. Where the two libraries
    could differ (the special token's string, scripts whose character classes
    depend on the Unicode version), the JSON file's own encoder is used.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if text.isascii() and _SPECIAL not in text or text and ord(max(text)) < _PLAIN and _SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def default_encoder() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first may be shorter."""
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, size: int = SEQUENCE, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per piece of every document."""
    paths = paths or default_encoder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*paths)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[tuple] = []
            for doc_id, text in zip(ids, texts, strict=True):
                tokens = np.array([*encode(text.as_py() or ""), SEPARATOR], "<u4")
                for k, (start, length) in enumerate(cut(len(tokens), size)):
                    out.append((doc_id, k, start, length, zlib.crc32(tokens[start : start + length].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Bins that pieces with ``counts[length]`` need at least.

    The maximum over three families of dual-feasible functions: the identity,
    thresholds (lengths over size - k round up to a bin, under k to nothing) and
    multiples (a length counts floor((m + 1) x / size) of m parts of a bin).
    """
    length = np.arange(len(counts), dtype=np.int64)
    n = counts.astype(np.int64)
    best = -(-int((n * length).sum()) // size)
    number, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * length)])
    for k in range(1, size // 2 + 1):
        big = number[-1] - number[size - k + 1]
        middle = total[size - k + 1] - total[k]
        best = max(best, int(big) + -(-int(middle) // size))
    for m in range(1, 65):
        exact = ((m + 1) * length) % size == 0
        parts = np.where(exact, length * m, ((m + 1) * length // size) * size)
        best = max(best, -(-int((n * parts).sum()) // (m * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece (given in decreasing order), and room left.

    Bins are kept by the room that they have left, with a bit set of the rooms
    in use; the tightest bin that a piece fits into is a bit operation away.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    used, left = 0, []
    for i, x in enumerate(lengths.tolist()):
        fits = used >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                used &= ~(1 << room)
        else:
            room, b = size, len(left)
            left.append(size)
        bins[i], offsets[i] = b, size - room
        room -= x
        left[b] = room
        if room:
            rooms[room].append(b)
            used |= 1 << room
    return bins, offsets, np.array(left, np.int64)


def _pack_group(size: int, parts: int, rounds: int, number: int):
    """Packs one partition; a partition above its bound gives up its loose bins, but not in the last round."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        length, row = (table.column(c).to_numpy() for c in ("length", "row"))
        order = np.lexsort((row, -length))
        bins, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        bins[order], offsets[order], left = best_fit_decreasing(length[order], size)
        bound = lower_bound(np.bincount(length, minlength=size + 1), size)
        last = parts == 1 or number == rounds - 1
        taken = (np.zeros(len(left), bool) if last or len(left) <= bound else left > 0)[bins]
        sequence = (bins * parts + key[0].as_py()) * rounds + number  # apart from all other partitions' and rounds'
        made = {"round": np.full(len(length), number, np.int32), "sequence_id": np.where(taken, -1, sequence), "offset": np.where(taken, -1, offsets), "bins": np.full(len(length), len(left)), "bound": np.full(len(length), bound)}
        for name, x in made.items():
            table = table.append_column(name, pa.array(x))
        return table

    return run


_PACKED = "row long, " + PIECES + ", part int, round int, sequence_id long, offset long, bins long, bound long"


def pack(docs: DataFrame, size: int = SEQUENCE, per_partition: int = PIECES_PER_PARTITION, rounds: int = ROUNDS, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``.

    ``round`` and ``part`` tell the partition that a row was packed in, ``bins``
    its bin count and ``bound`` the lower bound that certifies it. Pieces are
    dealt by their row, so rows that share a doc_id do not meet.
    """
    made = stash(pieces(docs, size, paths).select(F.monotonically_increasing_id().alias("row"), "*"), "pieces")
    todo, out = made, None
    for number in range(rounds):
        n = todo.count()
        parts = max(1, -(-n // per_partition))
        part = F.pmod(F.xxhash64("row", F.lit(number)), F.lit(parts)).cast("int")
        groups = todo.select("row", "doc_id", "piece", "start", "length", "ids_crc32", part.alias("part"))
        packed = stash(groups.groupBy("part").applyInArrow(_pack_group(size, parts, rounds, number), _PACKED), "packed")
        done = packed.where("sequence_id >= 0").drop("row")
        out = done if out is None else out.unionByName(done)
        todo = packed.where("sequence_id < 0")
        if parts == 1:
            break
    unstash(made)
    return out
