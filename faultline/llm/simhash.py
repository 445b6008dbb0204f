"""SimHash near-dedup by a binary trie self-join.

Fingerprints are made per whole text; equal ones are merged first, so copies
never meet each other. The self-join walks pairs of trie nodes together, bit by
bit, adds up differing bits and drops a pair above the budget. To deal it over
the cluster, the trie is split by blocks: two fingerprints within the budget
agree on all but ``budget`` of the blocks, so each choice of agreeing blocks
gives tables whose groups are tries of their own. Groups that are too large are
split again by the same rule on their remaining bits. Within a task the links
are reduced to a spanning forest, and components come from alternating
large-star and small-star steps over the links.

``near_copies`` is the operator for corpora: texts whose sets of five-word
shingles are similar by 0.8 or more. Its tries are dealt by shared shingles, its
budget is as wide as that similarity needs, and each pair that a trie brings is
checked on the whole sets.

Null and empty texts have fingerprint zero and are linked like any other.
Repeated rows are returned each. A null doc_id is never a component's name
unless no other is there. Very long texts are read whole, alone in their step.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, shuffle_parts, slices, stash, unstash, without_rows
from .windows import ANCHORS, PER_BLOCK, PLACE, Rolling, by_anchor, keyed, marked, mix, repeated, with_marks, word_units

BUDGET = 3
SHINGLE = 3
#: Distinct fingerprints that one trie may hold before it is split again.
MAX_GROUP = 20_000
#: Node pairs that a step of the traversal holds at once.
MAX_PAIRS = 1_000_000
#: Pairs that two nodes make at most where the near copies' tries end; their budget cuts little below.
LEAF = 64
#: Words of a shingle and similarity of near copies.
NEAR_SHINGLE, SIMILARITY = 5, 0.8
#: Smallest shingle hashes of a set that tries are dealt by. Two sets of the similarity share none of them with a chance of 0.2^8.
KEYS = 8
#: Bits in which two sets of the similarity differ at most, but for one pair in a million (9.7 on average).
NEAR_BUDGET = 24


def fingerprint_bytes(text: bytes, size: int, digest) -> int:
    words = text.lower().split()
    return _majority([digest(b" ".join(words[i : i + size])) for i in range(max(1, len(words) - size + 1))]) if words else 0


def _majority(hashes: list[int]) -> int:
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            out = []
            for _, _, texts in slices(batch, 1):
                for text in texts:
                    words = text.lower().split()  # bytes split on the six ASCII spaces
                    if not words:
                        out.append(0)
                        continue
                    joined = b" ".join(words)
                    if len(words) <= size:
                        hashes = [xxh64_intdigest(joined, seed)]
                    else:
                        ends = list(itertools.accumulate(len(w) + 1 for w in words))
                        begins = [0, *ends]
                        hashes = [xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(begins, ends[size - 1 :], strict=False)]
                    bits = np.zeros(64, np.int64)
                    for k in range(0, len(hashes), 65_536):
                        part = np.array(hashes[k : k + 65_536], np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
                        bits += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
                    out.append(int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big"))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def masks(blocks: int, within: int = (1 << 64) - 1, agree: int = 1) -> list[int]:
    """Bit masks of every choice of ``agree`` of ``blocks`` runs of the bits in ``within``."""
    bits = [b for b in range(63, -1, -1) if within >> b & 1]
    runs = [sum(1 << int(b) for b in part) for part in np.array_split(bits, blocks)]
    return [sum(c) for c in itertools.combinations(runs, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(nodes: DataFrame, all_masks: list[int]) -> DataFrame:
    tables = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for m in all_masks])
    return nodes.select("fp", F.explode(tables).alias("t")).select("fp", F.col("t.mask").alias("mask"), F.col("t.part").alias("part"))


class Forest:
    """Union of indices, kept as a spanning forest."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        r = self.root[i]
        while (up := self.root[r]) is not None and not np.array_equal(up, r):
            r = up
        return r

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.find(i), self.find(j)
            low, high = np.minimum(a, b), np.maximum(a, b)
            differ = low != high
            if not differ.any():
                return
            i, j, low, high = i[differ], j[differ], low[differ], high[differ]
            order = np.lexsort((low, high))
            first = np.r_[True, high[order][1:] != high[order][:-1]]
            self.root[high[order][first]] = low[order][first]


def close_pairs(fps: np.ndarray, groups: np.ndarray, budget: int, max_pairs: int = MAX_PAIRS, sides: np.ndarray | None = None, leaf: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within the budget; ``fps`` are sorted uint64 within equal ``groups``.

    Nodes are runs of the sorted array; a pair of nodes (a, b) is four ends and
    the bits differing so far. Nodes that make at most ``leaf`` pairs are settled at once.
    With ``sides`` (0 or 1, and sorted by them first) a group of two sides gives
    the pairs between them only.
    """
    n = len(fps)
    run = groups if sides is None else 2 * groups + sides
    edges = np.flatnonzero(np.r_[True, run[1:] != run[:-1], True]) if n else np.zeros(1, np.int64)
    lo, hi = edges[:-1], edges[1:]
    two = groups[lo[1:]] == groups[lo[:-1]]  # this run and the next are sides of one group
    one = np.flatnonzero((hi - lo > 1) & ~(np.r_[two, False] | np.r_[False, two])[: len(lo)])
    two = np.flatnonzero(two)
    first, second = np.r_[one, two], np.r_[one, two + 1]
    stack = [(63, lo[first], hi[first], lo[second], hi[second], np.zeros(len(first), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        bit, a, b, c, d, diff = stack.pop()
        if len(a) > max_pairs:
            half = len(a) // 2
            stack += [(bit, a[:half], b[:half], c[:half], d[:half], diff[:half]), (bit, a[half:], b[half:], c[half:], d[half:], diff[half:])]
            continue
        small = ((b - a) * (d - c) <= leaf) & (a != c)
        if small.any():
            leaves, step = np.flatnonzero(small), max(1, max_pairs // leaf)
            for s in range(0, len(leaves), step):
                at = leaves[s : s + step]
                wide = d[at] - c[at]
                n = (b[at] - a[at]) * wide
                k, inside = np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                wide = np.repeat(wide, n)
                i, j = a[k] + inside // wide, c[k] + inside % wide
                near = np.bitwise_count(fps[i] ^ fps[j]) <= budget
                yield i[near], j[near]
            a, b, c, d, diff = (x[~small] for x in (a, b, c, d, diff))
        if not len(a):
            continue
        if bit < 0:  # equal fingerprints: every pair of the two nodes
            for w, x, y, z in zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True):
                i, j = np.repeat(np.arange(w, x), z - y), np.tile(np.arange(y, z), x - w)
                yield i[i < j], j[i < j]
            continue
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)]
        count = ones[bit]
        m, k = b - (count[b] - count[a]), d - (count[d] - count[c])  # where each node's half with the bit set begins
        same = a == c
        parts = [(a, m, c, k, diff), (m, b, k, d, diff), (a, m, k, d, diff + 1), (m[~same], b[~same], c[~same], k[~same], diff[~same] + 1)]
        a, b, c, d, diff = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (b > a) & (d > c) & (diff <= budget) & ~((a == c) & (b - a == 1))
        if live.any():
            stack.append((bit - 1, *(x[live] for x in (a, b, c, d, diff))))


def trie_self_join(fps: np.ndarray, groups: np.ndarray, budget: int = BUDGET, max_pairs: int = MAX_PAIRS) -> np.ndarray:
    """Root index of each of ``fps`` (distinct, sorted uint64 within equal ``groups``)."""
    forest = Forest(len(fps))
    for i, j in close_pairs(fps, groups, budget, max_pairs):
        forest.union(i, j)
    return forest.find(np.arange(len(fps)))


def _links(keyed: DataFrame, parts: int, budget: int) -> DataFrame:
    """fp, other: a spanning forest of the links within each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            mask, part, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
            change = np.r_[0, np.cumsum((mask[1:] != mask[:-1]) | (part[1:] != part[:-1]))] if len(fp) else fp
            fps = fp.view(np.uint64)
            order = np.lexsort((fps, change))
            fps, root = fps[order], trie_self_join(fps[order], change[order], budget)
            moved = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(fps[moved].view(np.int64)), pa.array(fps[root[moved]].view(np.int64))], names=["fp", "other"])

        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            mask, part, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(fp):
                continue
            last = np.flatnonzero((mask != mask[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if cut and size + cut >= 100_000:
                yield flush([*held, (mask[:cut], part[:cut], fp[:cut])])
                held, size = [], 0
                mask, part, fp = mask[cut:], part[cut:], fp[cut:]
            held.append((mask, part, fp))
            size += len(fp)
        if held:
            yield flush(held)

    dealt = keyed.repartition(parts, "mask", "part").sortWithinPartitions("mask", "part")
    return dealt.select("mask", "part", "fp").mapInArrow(run, "fp long, other long")


def links(nodes: DataFrame, budget: int = BUDGET, max_group: int = MAX_GROUP) -> DataFrame:
    """Links between distinct fingerprints (column fp) that connect whatever is within the budget."""
    spark = nodes.sparkSession
    n = nodes.count()
    blocks = budget + 1 + (n > 1 << 22) + (n > 1 << 32)
    todo = stash(_keyed(nodes, masks(blocks, agree=blocks - budget)), "keyed")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, -(-n // 5_000)))
    out = None
    for level in range(3):
        sizes = todo.groupBy("mask", "part").agg(F.count("*").alias("n"))
        large = stash(sizes.where(F.col("n") > max_group), "large")
        some = level < 2 and large.count() > 0
        fit = todo.join(large, ["mask", "part"], "left_anti") if some else todo
        made = stash(_links(fit, parts, budget), "links")
        out = made if out is None else out.unionByName(made)
        if not some:
            break
        rows = todo.join(large.select("mask", "part"), ["mask", "part"], "left_semi")
        more = [m.mask for m in large.select("mask").distinct().collect()]  # at most as many as masks
        each = [(m, [_signed(m & (1 << 64) - 1 | x) for x in masks(budget + 1, ~m & (1 << 64) - 1)]) for m in more]
        finer = F.create_map(*[y for m, x in each for y in (F.lit(m), F.array(*map(F.lit, x)))])
        nxt = rows.select("fp", F.explode(finer[F.col("mask")]).alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask"))).distinct()
        todo = stash(nxt.select("fp", "mask", "part"), "keyed")
    return out


def components(edges: DataFrame, a: str = "fp", b: str = "other") -> DataFrame:
    """node, label (the smallest of its component), for every node that has an edge."""
    pairs = stash(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        # large-star: larger neighbours and the node itself hang on the smallest neighbour
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stash(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "low")
        large = join_hot(both.where("v > u"), low, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stash(large, "large")
        # small-star: smaller neighbours hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        small = stash(small.distinct(), "small")
        moved = small.join(pairs, ["u", "v"], "left_anti").limit(1).count() + pairs.join(small, ["u", "v"], "left_anti").limit(1).count()
        for made in (low, large, pairs):
            unstash(made)
        pairs = small
        if not moved:
            break
    stars = pairs.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    return stars.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def classes(docs: DataFrame, budget: int = BUDGET, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id per row of ``docs``."""
    made = stash(fingerprints(docs, size), "fingerprints")
    nodes = stash(made.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    found = components(links(nodes.select("fp"), budget))
    named = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", "n", F.coalesce("label", "fp").alias("label"))
    named = stash(named, "named")
    names = named.groupBy("label").agg(F.min("first").alias("component_id"))
    each = stash(named.join(names, "label").select("fp", "n", "component_id"), "each")
    return join_hot(made, each, ["fp"], "n").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


SKETCH = "id long, fold long, node long, keys binary"


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin.

    A shorter text has its whole sequence of words as one, a wordless text none.
    """
    units, bounds = word_units([t.lower() for t in texts])
    n = np.diff(bounds)
    roll = Rolling(units)
    many = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(texts)), many)
    start = bounds[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    hashes = roll.at(start, np.minimum(start + size, bounds[1:][text]))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])][: len(text)]
    text, hashes = text[new], hashes[new]
    return hashes, np.searchsorted(text, np.arange(len(texts) + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin ``at``; of empty ones 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0, dtype=values.dtype)])
    return total[at[1:]] - total[at[:-1]]


def _fps(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The majority's bits of each set; a million hashes at a time."""
    set_bits = np.zeros((len(at) - 1, 64), np.int64)
    for k in range(0, len(hashes), 200_000):
        part = hashes[k : k + 200_000]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cut = np.clip(at - k, 0, len(part))
        set_bits += _sums(bits.astype(np.int32), cut)
    made = np.packbits(set_bits * 2 > np.diff(at)[:, None], axis=1)
    return np.ascontiguousarray(made).view(">u8").ravel().astype(np.uint64)


def _nodes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    return mix(_sums(mix(hashes ^ np.uint64(0x5DEECE66D)), at) ^ mix(np.diff(at).astype(np.uint64))).view(np.int64)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """id, fold, node (a hash of the shingle set) and its smallest hashes, per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch, 2):
                hashes, at = shingle_sets(texts, size)
                ends = np.minimum(at[:-1] + KEYS, at[1:])
                keys = [hashes[x:y].tobytes() for x, y in zip(at[:-1].tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(_nodes(hashes, at)), pa.array(keys, pa.binary())], names=["id", "fold", "node", "keys"])

    return keyed(docs).mapInArrow(run, SKETCH)


def _dealt_by_keys(nodes: DataFrame, per_block: int) -> DataFrame:
    """The first row of each distinct set under each of its keys, as ``windows.repeated`` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).to_pylist()
            if not keys:
                continue
            n = np.array([len(k) // 8 for k in keys])
            places = np.zeros(int(n.sum()), PLACE)
            for k, name in enumerate(("id", "fold")):
                places[name] = np.repeat(batch.column(k).to_numpy(zero_copy_only=False), n)
            if len(places):
                yield by_anchor(np.frombuffer(b"".join(keys), np.uint64), places, per_block)

    return nodes.select("first.id", "first.fold", "keys").mapInArrow(run, ANCHORS)


def _whole_sets(size: int):
    """What a trie's task needs of each set: node, fingerprint and the set, under each repeated key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts, marks, row in marked(batch):
                hashes, at = shingle_sets(texts, size)
                i = row - first
                sets = [hashes[x:y].astype(np.uint32).tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                node, fp = _nodes(hashes, at), _fps(hashes, at).view(np.int64)
                columns = [marks["h"], marks["salt"], marks["split"] > 0, node[i], fp[i], node[i]]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array([sets[k] for k in i.tolist()], pa.binary())], names=["h", "salt", "flag", "node", "fp", "label", "members"])

    return run


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """Whether a set has an odd number of members in each of 512 bins, packed. Two sets differ in at least as many members as bins."""
    size = np.array([len(x) for x in sets], np.int64)
    out = np.empty((len(sets), 8), np.uint64)
    for k in range(0, len(sets), 2_000):
        n = size[k : k + 2_000]
        bins = (np.concatenate([*sets[k : k + 2_000], np.zeros(0, np.uint32)]) % 512).astype(np.int64)
        count = np.bincount(np.repeat(np.arange(len(n)) * 512, n) + bins, minlength=len(n) * 512)
        out[k : k + 2_000] = np.packbits((count & 1).astype(np.uint8).reshape(-1, 512), axis=1).view(np.uint64)
    return out


def similar_roots(fps: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], similarity: float, budget: int, sides: np.ndarray | None = None, labels: np.ndarray | None = None) -> np.ndarray:
    """Root index of each set within its group; sets of one of its ``labels`` are one tree to begin with.

    Of the pairs that the tries bring, those whose sizes and parities allow the
    similarity are left, and a few of each tree are checked at a time, so that
    members of one cluster are not compared all with all.
    """
    forest = Forest(len(fps))
    if labels is not None:
        order = np.lexsort((labels, groups))
        same = (labels[order][1:] == labels[order][:-1]) & (groups[order][1:] == groups[order][:-1])
        head = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0))
        forest.union(order, order[head])
    size, parity = np.array([len(x) for x in sets], np.int64), _parities(sets)
    for i, j in close_pairs(fps, groups, budget, sides=sides, leaf=LEAF):
        apart = (forest.find(i) != forest.find(j)) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
        i, j = i[apart], j[apart]
        differ = sum((np.bitwise_count(parity[i, k] ^ parity[j, k]).astype(np.int32) for k in range(8)), np.zeros(len(i), np.int32))
        near = differ <= (size[i] + size[j]) * ((1 - similarity) / (1 + similarity)) + 1e-6
        i, j, many = i[near], j[near], 1
        while len(i):
            a, b = forest.find(i), forest.find(j)
            apart = a != b
            i, j, low, high = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            if not len(i):
                break
            order = np.lexsort((low, high))
            at = np.arange(len(order))
            rank = at - np.maximum.accumulate(np.where(np.r_[True, high[order][1:] != high[order][:-1]], at, 0))
            pick = np.zeros(len(i), bool)
            pick[order[rank < many]] = True
            alike = np.array([_similar(sets[x], sets[y], similarity) for x, y in zip(i[pick].tolist(), j[pick].tolist(), strict=True)], bool)
            forest.union(i[pick][alike], j[pick][alike])
            i, j, many = i[~pick], j[~pick], 2 * many
    return forest.find(np.arange(len(fps)))


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    if not len(a):
        return True
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


NEAR = "fp long, other long, h long, sig long, members binary"
#: Blocks of sets that a task compares with as many others, where the blocks of one key meet.
MEETING = 4


def _joined(similarity: float, budget: int, meeting: bool):
    """Links within blocks of sets that share a key, and all sets of split keys; ``meeting``, links between the labels of two blocks' sets."""

    def settle(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, salt, flag, node, fp, label = (np.concatenate([x[k] for x in held]) for k in range(6))
        members = [m for x in held for m in x[6]]
        group = np.cumsum(np.r_[True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])])
        order = np.lexsort((node, fp.view(np.uint64), flag & meeting, group))
        order = order[np.r_[True, (node[order][1:] != node[order][:-1]) | (group[order][1:] != group[order][:-1])]]  # equal rows once
        sets = [np.sort(np.frombuffer(members[k], np.uint32)) for k in order.tolist()]
        known = (flag[order].astype(np.int64), label[order]) if meeting else (None, None)
        root = similar_roots(fp[order].view(np.uint64), group[order], sets, similarity, budget, *known)
        links = np.stack([label[order], label[order[root]]], axis=1)
        links = np.unique(links[links[:, 0] != links[:, 1]], axis=0)
        none = pa.nulls(len(links))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(links[:, 0])), pa.array(np.ascontiguousarray(links[:, 1])), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary())], names=["fp", "other", "h", "sig", "members"])
        stay = [] if meeting else order[flag[order]]
        if len(stay):
            yield pa.RecordBatch.from_arrays([pa.array(node[stay]), pa.nulls(len(stay)).cast(pa.int64()), pa.array(h[stay]), pa.array(fp[stay]), pa.array([members[k] for k in stay.tolist()], pa.binary())], names=["fp", "other", "h", "sig", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, latest = 0, None
        for batch in batches:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)] + [batch.column(6).to_pylist()]
            if not len(rows[0]):
                continue
            heads = np.flatnonzero(np.r_[(rows[0][0], rows[1][0]) != latest, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
            reach = np.r_[0, np.cumsum([len(m) + 64 for m in rows[6]])]
            at = 0
            for k in heads.tolist():
                if size + reach[k] - reach[at] >= 8 << 20:
                    held.append(tuple(x[at:k] for x in rows))
                    yield from settle(held)
                    held, size, at = [], 0, k
            held.append(tuple(x[at:] for x in rows))
            size += reach[-1] - reach[at]
            latest = (rows[0][-1], rows[1][-1])
        if held:
            yield from settle(held)

    return run


def _meetings(rows: DataFrame, per_meeting: int) -> DataFrame:
    """The sets of split keys in every two blocks of ``per_meeting`` that must meet.

    ``rows`` tell the group (label) that a set has by then. Sets of a key's largest
    group meet all others, which also meet each other; those of one group don't.
    """
    of = rows.groupBy("h", "label").agg(F.count("*").alias("n")).groupBy("h")
    of = of.agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    of = of.select("h", "main", F.ceil(F.col("most") / per_meeting).alias("a"), F.ceil((F.col("n") - F.col("most")) / per_meeting).alias("b"))
    of = stash(of, "crowded")  # fewer than the places of split keys by a block's size
    dealt = rows.join(F.broadcast(of), "h").withColumn("main", F.col("label") == F.col("main")).withColumn("hash", F.xxhash64("node"))
    dealt = dealt.withColumn("block", F.when(F.col("main"), F.pmod("hash", "a")).otherwise(F.col("a") + F.pmod("hash", "b")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.when(F.col("main"), F.col("a")).otherwise(F.lit(0).cast("long")), F.col("a") + F.col("b") - 1)))
    salt = F.least("block", "with") * (F.col("a") + F.col("b")) + F.greatest("block", "with")
    return dealt.select("h", salt.alias("salt"), (F.col("block") > F.col("with")).alias("flag"), "node", "fp", "label", "members")


def near_copies(docs: DataFrame, size: int = NEAR_SHINGLE, similarity: float = SIMILARITY, budget: int = NEAR_BUDGET, per_block: int = PER_BLOCK) -> DataFrame:
    """id, fold, first (id and fold): each row's group is named by its first row.

    Equal sets are merged first. A set is dealt to a trie under each of its KEYS
    smallest shingle hashes that another set has too, the tries bring the pairs
    within the budget, and the whole sets decide. A key of more than ``per_block``
    different sets is dealt to blocks; what these leave in different groups then
    meets in every two blocks, so that no pair of the key is left out.
    """
    made = stash(sketches(docs, size), "sketches")
    nodes = stash(made.groupBy("node").agg(F.min(F.struct("id", "fold")).alias("first"), F.first("keys").alias("keys"), F.count("*").alias("n")), "nodes")
    marks = stash(repeated(_dealt_by_keys(nodes, per_block), per_block), "marks")
    parts = shuffle_parts(docs.sparkSession)

    def joined(sets: DataFrame, meeting: bool) -> DataFrame:
        return sets.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_joined(similarity, budget, meeting), NEAR)

    sets = with_marks(docs, marks).mapInArrow(_whole_sets(size), "h long, salt long, flag boolean, node long, fp long, label long, members binary")
    found = stash(joined(sets, False), "near")
    unstash(marks)
    label = components(found.where("other IS NOT NULL").select("fp", "other"))
    named = stash(nodes.join(label.withColumnRenamed("node", "named"), F.col("node") == F.col("named"), "left").select("node", "first", "n", F.coalesce("label", "node").alias("label")), "named")
    rest = found.where("other IS NULL").select("h", F.col("fp").alias("node"), F.col("sig").alias("fp"), "members")
    if not rest.isEmpty():
        rows = stash(rest.join(named.select("node", "label"), "node"), "rest")
        met = stash(joined(_meetings(rows, MEETING * per_block), True), "met")
        unstash(rows)
        more = components(met.select("fp", "other")).select(F.col("node").alias("label"), F.col("label").alias("wider"))
        named = stash(named.join(more, "label", "left").select("node", "first", "n", F.coalesce("wider", "label").alias("label")), "named")
    firsts = named.groupBy("label").agg(F.min("first").alias("first"))
    each = stash(named.drop("first").join(firsts, "label").select("node", "n", "first"), "each")
    return join_hot(made.select("id", "fold", "node"), each, ["node"], "n").select("id", "fold", "first")


def keep_first(docs: DataFrame, size: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id (null is the smallest), then of the smallest text hash; of equal rows any one."""
    made = stash(near_copies(docs, size, similarity), "copies")
    stay = (F.col("first.id") == F.col("id")) & (F.col("first.fold") == F.col("fold"))
    left = without_rows(docs, made.where(~stay).select("id", "fold"))
    twice = made.where(stay).groupBy("id", "fold").agg(F.count("*").alias("n")).where("n > 1")
    twice = stash(twice.select("id", "fold"), "twice")
    if twice.isEmpty():
        return left
    row = keyed(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"), "row")
    one = row.join(twice, ["id", "fold"], "left_semi").groupBy("id", "fold").agg(F.first("row").alias("row"))
    return without_rows(left, twice).unionByName(one.select("row.*"))
