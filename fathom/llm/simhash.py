"""Near-duplicates by SimHash, found through deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that, of two fingerprints that
link, one segment differs by at most one bit.  Each segment is indexed once for each
of its bits with that bit wiped out (a wildcard), together 64 variants a
fingerprint.  Fingerprints that share a variant meet in a bucket, where their
distance is verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, columns, components, fresh, join_unique, only_result, saved, whole_rows
from .exact import by_id, screen

BITS = 64
#: Buckets that may have more fingerprints are cut further, a key for each of a
#: member's pieces outside the bucket's segment; at most so many values of a segment
#: make such buckets, which a thousand million fingerprints don't reach.
HOT_BUCKET, HOT_VALUES = 20_000, 100_000
#: Up to so many members all distances of a bucket are computed, in blocks.
DENSE = 4096


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a text, A-Z lower-cased, repeats included.

    Shingles are of `words` words joined by spaces; a text of fewer words is one
    shingle, a text of none gives none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    words = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(line[a:b], 42) for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit is the majority of that bit in the hashes; zero where there are none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, print long) for each row of docs; the 64 bits as a signed number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(shingles(t.as_py(), words)) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return columns(docs, doc_id="long", text="string").mapInArrow(each, "doc_id long, print long")


def segments_for(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest segments of which one differs by at most one bit."""
    n = distance // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variants(prints: np.ndarray, segments: list[tuple[int, int]]) -> np.ndarray:
    """64 x n keys: each segment with one bit wiped out, mixed with which bit that is."""
    out = []
    for first, bits in segments:
        mask = np.uint64((1 << bits) - 1 << first)
        for bit in range(first, first + bits):
            out.append(_mix((prints & mask & ~np.uint64(1 << bit)) ^ _mix(np.full(1, bit + 1, np.uint64))))
    return np.stack(out)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (the finaliser of SplitMix64), so keys never collide by it."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def forest(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (i, j) that join all that links within distance would join.

    They are the edges of a minimum spanning forest, n - 1 at most.  Above DENSE
    members, for a distance of 2 or less, the fingerprints that share a neighbour at
    one bit are joined instead: those are exactly the links, found without pairs.
    """
    n = len(prints)
    if n > DENSE and distance <= 2:
        return _by_neighbours(prints, distance)
    left, best, parent = np.arange(1, n), np.bitwise_count(prints[1:] ^ prints[0]).astype(np.int16), np.zeros(n - 1, np.int64)
    a, b = [], []
    while len(left):
        k = int(best.argmin())
        node = left[k]
        if best[k] <= distance:
            a.append(parent[k])
            b.append(node)
        left[k], best[k], parent[k] = left[-1], best[-1], parent[-1]
        left, best, parent = left[:-1], best[:-1], parent[:-1]
        d = np.bitwise_count(prints[left] ^ prints[node])
        closer = d < best
        best[closer], parent[closer] = d[closer], node
    return np.array(a, np.int64), np.array(b, np.int64)


def _by_neighbours(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """x and y differ in at most two bits if and only if one-bit changes of them (or they) meet."""
    flips = np.array([0, *(1 << i for i in range(BITS))] if distance == 2 else [0], np.uint64)
    if distance == 1:
        bits = np.array([1 << i for i in range(BITS)], np.uint64)
        near = (prints[:, None] & ~bits[None]) ^ _mix(np.arange(1, BITS + 1, dtype=np.uint64))[None]
    else:
        near = prints[:, None] ^ flips[None]
    owner = np.repeat(np.arange(len(prints)), near.shape[1])
    order = np.argsort(near, axis=None, kind="stable")
    key, owner = near.ravel()[order], owner[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    head = owner[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
    links = np.unique(np.stack([head, owner])[:, head != owner], axis=1)
    return links[0], links[1]


def links(prints: DataFrame, distance: int, segments: list[tuple[int, int]] | None = None) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of prints(print long).

    With the segments that segments_for gives, the links join all fingerprints that
    chains of distances up to `distance` join.  Fewer or shorter segments than that
    find only those that also share a variant.  A bucket sends at most a link for
    each member, never its pairs.
    """
    segments = segments or segments_for(distance)
    spark = prints.sparkSession
    prints = saved(prints.select("print").distinct(), "prints")
    hot = spark.sparkContext.broadcast(_hot_variants(prints, segments))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            for part in np.array_split(whole, -(-len(whole) // 1000) or 1):
                keys, of = variants(part, segments), np.repeat(np.arange(len(segments)), [n for _, n in segments])
                member, of = np.broadcast_to(part, keys.shape), np.broadcast_to(of[:, None], keys.shape)
                if len(hot.value):
                    large = np.isin(keys, hot.value)
                    again = cut_further(keys[large], member[large], of[large], segments, distance)
                    keys, member = np.concatenate([keys[~large], again.ravel()]), np.concatenate([member[~large], np.tile(member[large], len(again))])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(member.ravel().view(np.int64))], ["key", "print"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for members, starts in _buckets(batches):
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            sizes = np.diff(starts)
            two = starts[:-1][sizes == 2]
            near = np.bitwise_count(members[two] ^ members[two + 1]) <= distance
            a.append(members[two[near]])
            b.append(members[two[near] + 1])
            for at, size in zip(starts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                group = members[at : at + size]
                i, j = forest(group, distance)
                a.append(group[i])
                b.append(group[j])
            a, b = np.concatenate(a), np.concatenate(b)
            a, b = np.minimum(a, b), np.maximum(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = prints.mapInArrow(keyed, "key long, print long").repartition(n, "key").sortWithinPartitions("key")
    return saved(dealt.mapInArrow(verified, "a long, b long").distinct(), "links")


def cut_further(keys: np.ndarray, prints: np.ndarray, of: np.ndarray, segments: list[tuple[int, int]], distance: int) -> np.ndarray:
    """Keys (pieces, members) that cut large buckets; of: the segment that each key is a variant of.

    The bits outside the segment are cut into pieces, one more than may differ (three
    at most), so two fingerprints that link share one of them.  Pieces of the segment
    itself cut nothing: all members have them.
    """
    pieces = min(distance, 2) + 1
    out = np.zeros((pieces, len(keys)), np.uint64)
    for s, (first, bits) in enumerate(segments):
        mine = of == s
        rest = [b for b in range(BITS) if not first <= b < first + bits]
        for i in range(pieces):
            mask = np.uint64(sum(1 << b for b in rest[len(rest) * i // pieces : len(rest) * (i + 1) // pieces]))
            out[i, mine] = _mix(keys[mine] + np.uint64(i) ^ _mix(prints[mine] & mask))
    return out


def _hot_variants(prints: DataFrame, segments: list[tuple[int, int]]) -> np.ndarray:
    """Keys of the buckets that may be large, from how often each segment's value occurs.

    A bucket has two values of a segment, so one of them has half its members.  Of
    values with HOT_BUCKET / 2 fingerprints there are at most HOT_VALUES a segment, up
    to a thousand million fingerprints; beyond, the threshold grows to keep that bound.
    """
    least = max(HOT_BUCKET // 2, prints.count() // HOT_VALUES)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("print").bitwiseAND(F.lit(_signed((1 << n) - 1 << a))).alias("v")) for i, (a, n) in enumerate(segments)])).alias("c")
    found = prints.select(cells).groupBy("c.i", "c.v").count().filter(F.col("count") >= least).select("i", "v").collect()
    out = [variants(np.array([r["v"]], np.int64).view(np.uint64), [segments[r["i"]]]) for r in found]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From rows sorted by key: members, and where each bucket of two or more starts."""
    keys, members = [], []

    def cut(last: bool) -> tuple[np.ndarray, np.ndarray]:
        key, member = np.concatenate(keys), np.concatenate(members)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        whole = len(key) if last else int(starts[-2])
        keys[:], members[:] = [key[whole:]], [member[whole:]]
        starts = starts[starts <= whole]
        sizes = np.diff(starts)
        several = np.repeat(sizes > 1, sizes)
        return member[:whole][several], np.concatenate([[0], np.cumsum(sizes[sizes > 1])])

    for b in batches:
        if b.num_rows:
            keys.append(b.column("key").to_numpy(zero_copy_only=False))
            members.append(b.column("print").to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, keys)) >= 200_000 and keys[-1][-1] != keys[0][0]:
                yield cut(False)
    if keys:
        yield cut(True)


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """For each row of docs: doc_id, fingerprint (16 hex digits) and component_id.

    Fingerprints that differ in at most `distance` bits link; component_id is the
    least doc_id that links lead to.  Null and empty texts, and texts of white space
    alone, have fingerprint zero and link like any other.  Rows without a doc_id
    link too but never name a component; a component of such rows alone has a null
    id.  Repeated rows are repeated in the result.  An empty table gives no rows.
    """
    rows = saved(fingerprints(docs, words), "fingerprints")
    groups = saved(rows.groupBy("print").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "groups")
    nodes = components(links(groups, distance)).withColumnRenamed("node", "print")
    rooted = groups.join(nodes, "print", "left").withColumn("root", F.coalesce("root", "print"))
    rooted = saved(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"))
    named = saved(join_unique(rooted, saved(least, "least"), "root", "prints", ["component_id"]).select("print", "n", "component_id"), "named")
    out = join_unique(rows, named, "print", "n", ["component_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


class _Words(dict):
    """XXH64 of words, held while they are few enough."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 42)
        return found


def shingle_set(text: str | None, words: int, held: _Words) -> np.ndarray:
    """The distinct hashes, ascending, of a text's shingles; made from the hashes of their words.

    As in `shingles`, A-Z are lower-cased, and a text of fewer words is one shingle.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(held.__getitem__, found), np.uint64, len(found))
    words = min(words, len(word))
    out = np.full(len(word) - words + 1, words, np.uint64)
    for i in range(words):
        out = _mix(out) ^ word[i : i + len(out)]
    return np.unique(_mix(out))


def sketch(grams: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each of as many bins as it has, rounded up to a power of two."""
    bins = 1 << max(len(grams) - 1, 0).bit_length()
    count = np.bincount((grams & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else b""


def may_reach(x: bytes, y: bytes, sizes: tuple[int, int], least: float) -> bool:
    """False if the sketches show that two sets are less similar than `least`: never wrongly."""
    if not x or not y:
        return True
    x, y = np.frombuffer(x, np.uint8).astype(np.int32), np.frombuffer(y, np.uint8).astype(np.int32)
    bins = min(len(x), len(y))
    both = int(np.minimum(x.reshape(-1, bins).sum(0), y.reshape(-1, bins).sum(0)).sum())
    return both >= least * (sum(sizes) - both)


#: How far apart fingerprints may be whose texts are proposed first: two segments
#: do for that, long enough that texts which have nothing in common hardly meet.
PROPOSE_DISTANCE = 3
#: Documents whose shingles are counted, one in so many, and how many of the most
#: frequent are put last.  They decide the cost alone: any order finds all pairs.
COUNTED_SHARE, COUNTED_LEAST, COMMON_SHINGLES = 16, 4, 500_000
#: A document in the bucket of a hash of its prefix: its set's size, the hash's place, two parities.
MEMBER = ("key", "doc_id", "size", "at", "p", "q")
#: Documents whose ids may be broadcast.
BROADCAST_IDS = 500_000
#: Words whose hashes a task holds; cells of a bucket that are compared at once; and
#: rows of buckets, or pairs, that are handled together.
HELD_WORDS, CELLS, ROWS = 100_000, 1 << 20, 200_000
#: Texts whose sets a task holds at once, as numbers and as what it sends back.
HELD_SETS = 1000


def prefix(grams: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first hashes of a set, rare ones first: sets as similar as `least` share one of theirs.

    Such sets have `least` of either's size in common, so one of the common hashes is
    among the first size - ceil(least * size) + 1 of each, in any order that is the
    same for all sets.  common: sorted hashes that come late, by counts.
    """
    n = len(grams)
    if not n:
        return grams
    often = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        often = np.where(common[at] == grams, counts[at], 0)
    return grams[np.lexsort((grams, often))][: n - int(np.ceil(least * n - 1e-9)) + 1]


def parity(grams: np.ndarray) -> np.ndarray:
    """128 bits, as two numbers: whether a set has an odd number of hashes in each of 128 bins."""
    odd = np.bincount((grams & np.uint64(127)).astype(np.int64), minlength=128) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


class Bucket:
    """The documents that have one hash in their prefixes."""

    def __init__(self, doc: np.ndarray, size: np.ndarray, at: np.ndarray, p: np.ndarray, q: np.ndarray, root: np.ndarray, least: float):
        self.doc, self.size, self.at, self.p, self.q, self.root, self.least = doc, size, at, p.view(np.uint64), q.view(np.uint64), root, least

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether members i and j, of different roots, could be as similar as `least`.

        Sets that are similar pass in the bucket of the first hash that they share:
        from there on at most the rest of the smaller is in common.  Each bit in
        which the parities differ takes a hash that only one of the sets has.
        """
        both, share = self.size[i] + self.size[j], self.least / (1 + self.least)
        ok = (self.root[i] != self.root[j]) & (np.minimum(self.size[i] - self.at[i], self.size[j] - self.at[j]) >= share * both - 1e-6)
        differ = np.bitwise_count(self.p[i] ^ self.p[j]).astype(np.int16) + np.bitwise_count(self.q[i] ^ self.q[j])
        return ok & (differ <= (1 - self.least) / (1 + self.least) * both + 1e-6)

    def star(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaders with those that could be similar to them: fewer than there are members.

        The least root leads; who can't be similar to a leader waits for the next one.
        """
        left = np.lexsort((self.doc, self.root))
        while len(left) > 1:
            lead, left = left[0], left[1:]
            same = self.root[left] == self.root[lead]
            ok = self.alike(np.full(len(left), lead), left)
            yield self.doc[np.full(int(ok.sum()), lead)], self.doc[left[ok]]
            left = left[~ok & ~same]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs that could be similar, of different roots; blocks of CELLS."""
        kinds, where, many = np.unique(self.root, return_inverse=True, return_counts=True)
        # The commonest root's members needn't be held against each other.
        rank = np.where(where == many.argmax(), len(self.doc), 0) + np.arange(len(self.doc))
        order, outer = np.argsort(rank), int((where != many.argmax()).sum())
        rows = max(1, CELLS // len(self.doc))
        for a in range(0, outer, rows):
            block, rest = order[a : min(a + rows, outer)], order[a:]
            ok = self.alike(block[:, None], rest)
            ok &= np.arange(len(block))[:, None] < np.arange(len(rest))
            i, j = np.nonzero(ok)
            yield self.doc[block[i]], self.doc[rest[j]]


def _common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many documents have, sorted, and their counts in a part of the documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Words()
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t.as_py(), words, held).view(np.int64))], ["gram"])

    part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(COUNTED_SHARE)) == 0).select("text")
    counts = part.mapInArrow(each, "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= COUNTED_LEAST)
    found = counts.orderBy(F.desc("n"), "gram").limit(COMMON_SHINGLES).toArrow()
    grams, n = found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, HELD_SETS):
            yield b.slice(at, HELD_SETS)


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def _described(docs: DataFrame, words: int, least: float) -> DataFrame:
    """For docs(doc_id, text): the set's digest, fingerprint, size, parities and prefix."""
    common = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, words))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Words()
        for b in _slices(batches):
            sets = [shingle_set(t.as_py(), words, held) for t in b.column("text")]
            first = [prefix(g, *common.value, least) for g in sets]
            bits = np.array([parity(g) for g in sets], np.uint64).reshape(-1, 2).view(np.int64)
            digest = pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in sets], pa.binary())
            prints = np.fromiter(map(fingerprint, sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), digest, pa.array(prints), pa.array(list(map(len, sets)), pa.int64()), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()), _lists(first)], ["doc_id", "digest", "print", "size", "p", "q", "prefix"])

    return docs.mapInArrow(each, "doc_id long, digest binary, print long, size long, p long, q long, prefix array<long>")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows(doc_id, …) with their root, which is the document itself where roots(node, root) has none."""
    named = roots.select(F.col("node").alias("doc_id"), "root")
    named = F.broadcast(named) if named.count() <= BROADCAST_IDS else named
    return rows.join(named, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))


def _in_buckets(members: DataFrame, least: float, way: str) -> DataFrame:
    """What the buckets of members(MEMBER, root) give.

    way 'star': the pairs (a, b) of Bucket.star, and the members of all buckets of
    two or more, as rows without a and b.  way 'pairs': the pairs of Bucket.pairs.
    """
    names = ("a", "b", *MEMBER) if way == "star" else ("a", "b")

    def sent(a: list[np.ndarray], b: list[np.ndarray], rows: np.ndarray | None = None) -> pa.RecordBatch:
        pairs = np.stack([np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b)])
        pairs = np.unique(np.sort(pairs, axis=0), axis=1)
        if way != "star":
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], [*names])
        k, n = pairs.shape[1], 0 if rows is None else rows.shape[1]
        ends = [pa.concat_arrays([pa.array(x), pa.nulls(n, pa.int64())]) for x in pairs]
        return pa.RecordBatch.from_arrays([*ends, *(pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(rows[i]) if n else pa.nulls(0, pa.int64())]) for i in range(len(MEMBER)))], [*names])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _runs(batches):
            a, b, held = [], [], 0
            for x, y in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if (rows[-1, x:y] == rows[-1, x]).all():
                    continue
                bucket = Bucket(*rows[1:, x:y], least)
                for i, j in bucket.star() if way == "star" else bucket.pairs():
                    a.append(i)
                    b.append(j)
                    held += len(i)
                    if held >= ROWS:
                        yield sent(a, b)
                        a, b, held = [], [], 0
            yield sent(a, b, rows[:-1])

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select(*MEMBER, "root").repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(each, ", ".join(f"{x} long" for x in names))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From rows sorted by key: those of the keys with two rows or more, and where each key starts."""
    held: list[np.ndarray] = []

    def cut(last: bool) -> tuple[np.ndarray, np.ndarray]:
        rows = np.concatenate(held, axis=1)
        starts = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1], [True]]))
        whole = rows.shape[1] if last else int(starts[-2])
        held[:] = [rows[:, whole:]]
        sizes = np.diff(starts[starts <= whole])
        return rows[:, :whole][:, np.repeat(sizes > 1, sizes)], np.concatenate([[0], np.cumsum(sizes[sizes > 1])])

    for b in batches:
        if b.num_rows:
            held.append(np.stack([b.column(c).to_numpy() for c in (*MEMBER, "root")]))
            if sum(x.shape[1] for x in held) >= ROWS and held[-1][0, -1] != held[0][0, 0]:
                yield cut(False)
    if held:
        yield cut(True)


def _sets(docs: DataFrame, words: int, ids: DataFrame, made: Callable[[list[np.ndarray]], list[pa.Array]], schema: str) -> DataFrame:
    """doc_id and what made gives of their sets, for the documents of ids(key) and a few that no one asked for.

    The texts are screened where they are, so none is shuffled, as long as a screen of the
    ids may be broadcast.
    """
    wanted, names = screen(ids), [x.split()[0] for x in schema.split(", ")]
    if wanted is None:
        docs = docs.join(ids.select(F.col("key").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Words()
        for b in _slices(x if wanted is None else x.filter(pa.array(wanted(x.column("doc_id").to_numpy()))) for x in batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made([shingle_set(t.as_py(), words, held) for t in b.column("text")])], names)

    return docs.mapInArrow(each, schema)


def _verified(pairs: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) of docs(doc_id, text) that are as similar as `least`."""

    def sketched(grams: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array(map(len, grams), pa.int64()), pa.array(map(sketch, grams), pa.binary())]

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c) for c in ("sketch_a", "sketch_b", "size_a", "size_b")), strict=True)
            yield b.select(["a", "b"]).filter(pa.array([may_reach(x.as_py(), y.as_py(), (m.as_py(), n.as_py()), least) for x, y, m, n in rows], pa.bool_()))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("key"))

    asked = saved(ends(pairs).groupBy("key").agg(F.count("*").alias("n")), "asked")
    # join_unique only needs the counts of ids that may be hot: all others go as one.
    often = F.broadcast(asked.filter(F.col("n") > HOT_ROWS).withColumnRenamed("key", "doc_id"))

    def counted(sets: DataFrame, name: str) -> DataFrame:
        return saved(sets.join(often, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(1))), name)

    # Sets are made, and travel, only where the much smaller sketches allow that similarity.
    sketches = counted(_sets(docs, words, asked.select("key"), sketched, "doc_id long, size long, sketch binary"), "sketches")
    for x in "ab":
        side = sketches.select(F.col("doc_id").alias(x), "n", F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))
        pairs = join_unique(pairs, side, x, "n", [f"size_{x}", f"sketch_{x}"]).drop("n")
    pairs = saved(pairs.mapInArrow(hopeful, "a long, b long"), "alike")
    sets = counted(_sets(docs, words, ends(pairs), lambda grams: [_lists(grams)], "doc_id long, grams array<long>"), "sets")
    first = join_unique(pairs, sets.select(F.col("doc_id").alias("a"), "n", F.col("grams").alias("x")), "a", "n", ["x"]).select("a", "b", "x")
    both = join_unique(first, sets.select(F.col("doc_id").alias("b"), "n", F.col("grams").alias("y")), "b", "n", ["y"])
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("all"))
    return saved(both.filter(F.col("both") >= F.lit(least) * (F.col("all") - F.col("both"))).select("a", "b"), "similar")


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """(node, root): documents of docs(doc_id, text) in groups of similar texts.

    Two texts are similar if the Jaccard similarity of their sets of word shingles is
    `least` or more.  Three steps, of which each leaves out what the ones before have
    joined, and each verified on whole texts: SimHash links (PROPOSE_DISTANCE) join
    the nearest; then, in each bucket of documents that share a hash of their sets'
    prefixes, a leader is held against the others; then all pairs of a bucket that are
    still in different groups are compared.  So no link is missed, and a large group
    takes a pair for each member, not for each two.

    root is the least doc_id of a group; documents alone have no row.  Null ids take
    no part; rows that repeat an id count as one document; texts without words are
    one group.
    """
    docs = columns(docs, doc_id="long", text="string").filter("doc_id is not null")
    if docs.groupBy("doc_id").count().filter("count > 1").take(1):
        docs = saved(docs.groupBy("doc_id").agg(F.min_by("text", F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.col("text").isNull())).alias("text")), "once")
    sets = saved(_described(docs, words, least), "described")
    # Equal sets are one from here on, under their least id.
    equal = saved(sets.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "equal")
    same = saved(join_unique(sets.select("doc_id", "digest"), equal, "digest", "n", ["first"]).select(F.col("first").alias("a"), F.col("doc_id").alias("b")), "same")
    gone = same.filter("a <> b").select(F.col("b").alias("doc_id"))
    gone = F.broadcast(gone) if same.count() <= BROADCAST_IDS else gone
    sets = sets.join(gone, "doc_id", "left_anti")

    least_id = saved(sets.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "groups")
    alike = join_unique(sets.select("doc_id", "print"), least_id.filter("n > 1"), "print", "n", ["first"]).select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    near = links(least_id, PROPOSE_DISTANCE)
    for x in "ab":
        near = near.join(least_id.select(F.col("print").alias(x), F.col("first").alias(f"_{x}")), x)
    near = alike.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).filter("a <> b")
    joined = _verified(saved(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near"), docs, words, least)

    rooted = _rooted(sets.drop("digest", "print"), saved(components(joined), "roots"))
    members = rooted.select("doc_id", "root", "size", "p", "q", F.posexplode("prefix").alias("at", "key"))
    stars = saved(_in_buckets(members, least, "star"), "stars")
    tried = saved(stars.filter("a is not null").select("a", "b").distinct(), "tried")
    joined = joined.unionByName(_verified(tried, docs, words, least))

    rest = _in_buckets(_rooted(stars.filter("key is not null").select(*MEMBER), saved(components(joined), "roots")), least, "pairs")
    rest = saved(rest.distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    return components(joined.unionByName(_verified(rest, docs, words, least)).unionByName(same))


def without_similar(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, without all but the least doc_id of each group.

    Rows that repeat a doc_id are documents of their own, in order of their texts'
    digests: of those whose texts are similar the first stays, and so do all whose texts
    are like no other.  A null text is empty; texts without words are one group, of
    which one stays.  Rows without doc_id stay.  Texts may be of any length; an empty
    table gives no rows.
    """
    ids = columns(docs, doc_id="long").filter("doc_id is not null")
    if ids.groupBy("doc_id").count().filter("count > 1").take(1):
        return _rows_without_similar(docs, words, least)
    (name,) = fresh(docs, "gone")
    gone = only_result(lambda: similar_groups(docs, words, least).filter("node <> root").select(F.col("node").alias(name)), "similar")
    docs, others = by_id(docs, gone, name)
    return others.unionByName(docs.join(gone, docs["doc_id"].cast("long") == F.col(name), "left_anti"))


def _rows_without_similar(docs: DataFrame, words: int, least: float) -> DataFrame:
    """As without_similar, with a number for each row in the place of ids that are repeated."""
    doc_id, text = ((docs[c] if c in docs.columns else F.lit(None)).cast(k) for c, k in (("doc_id", "long"), ("text", "string")))
    held = docs.select(whole_rows(docs).alias("row"), doc_id.alias("doc_id"), text.alias("text"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("sha"), F.monotonically_increasing_id().alias("read"))
    # Numbers follow the order of ids and digests, dealt by ranges, so an id of many rows spreads.
    order = ["doc_id", "sha", "read"]
    held = held.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "text", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id()).alias("node"))
    held = saved(held, "numbered")
    gone = only_result(lambda: similar_groups(held.select(F.col("node").alias("doc_id"), "text"), words, least).filter("node <> root").select("node"), "similar")
    return held.join(gone, "node", "left_anti").select("row.*")
