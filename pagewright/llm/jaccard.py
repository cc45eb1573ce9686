"""Operator 6: exact n-gram Jaccard join in a metric space.

Sets of word shingles under Jaccard distance are a metric space. The join:

1. Equal sets are one class (a row per text carries its set's digest), so a
   group of copies of any size is one member of the space from here on.
2. Regions. All shingles have one global order, rare ones first: shingles that
   a mergeable heavy-hitter summary of the whole corpus finds in many sets come
   last, the rest go by hash. Two sets within the radius share one of their
   first n - ceil(t n) + 1 shingles, so each such shingle spans a region and no
   pair within the radius is outside all regions. The summary only decides the
   order; any order is exact. Where the first shingle that two sets share stands
   in each bounds what they can share; a member that this rules out with all
   others of a region leaves it (a shingle shared by chance leaves none), and a
   region falls apart where no pair is left across. Regions with the same members
   are one.
3. In each region the member that is in most regions is the pivot; members within the radius of
   it belong to its cell, one component. Cells form in the first rounds, each
   member meeting one pivot a round. Regions that lie in one component are done.
   Those around one pivot are merged, so that a pair meets once, and split by the distance to the empty set, that is, by size:
   windows of size classes, each with the smaller class as its boundary. A window
   is joined in memory between components, where sizes and count sketches rule
   out pairs by lower bounds that can't err. Pairs are never written: members that
   the pairs left hold together are a group, whose sets are then counted against
   each other in memory, and only links that unite components come out, fewer
   than the group has members.
   A window too large for that is told apart by exact distances to its pivot: by
   the triangle inequality a pair within the radius differs by at most the radius
   there, so bands as wide as the radius, each with the members of the next band
   as its boundary, are the regions of the next round. What is still too large
   after some rounds is joined block by block.
4. Components of all links by star contraction.

All distances are computed on whole sets. A region is never gathered: pivots
are minima, and members meet them in joins. Links inside a class or a cell
aren't expanded into pairs; that changes no component.

Null and empty texts have an empty set and are linked with nothing. Repeated
rows get equal results. Null ids are never a component's id unless the whole
class has none. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, releasing, shingle_hashes, small_batches, text_bytes, word_hashes
from .components import components

#: Shingle width, and the similarity of a link as a fraction.
WIDTH, NUM, DEN = 5, 75, 100
#: Counters of a task's heavy-hitter summary, and how many sets make a shingle heavy.
COUNTERS, HEAVY = 1 << 16, 6
#: Shingles a task gathers before it adds them to its summary.
GATHERED = 1_000_000
#: The most heavy shingles that are ordered last.
MOST_HEAVY = 1 << 18
#: Packed entries of one bucket, and entries a task holds before it sends them on.
BUCKET_ENTRIES, HELD_ENTRIES = 400_000, 500_000
#: First rounds, in which cells form; members of a region that is joined as a
#: whole after them; the rounds after which a larger one is, in blocks of members.
CELL_ROUNDS, WHOLE_REGION, PIVOT_ROUNDS, BLOCK = 2, 3000, 4, 1000
#: Members of a region whose pairs are looked at one by one when it is made; a
#: larger one is kept whole. Steps of a size's code for each doubling.
FEW_MEMBERS, STEPS = 500, 2048
#: Shingles in the sets of one part of a group; a larger group is counted part
#: against part. Shared shingles counted at once.
PART_ENTRIES, COUNTED = 1 << 21, 1 << 20
#: Ids broadcast at most; more go by a shuffled join. The most bits that tell the
#: ids of texts wanted where these are more, sixteen an id as long as that is enough.
BROADCAST_IDS, ID_BITS = 1_000_000, 1 << 27


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(text_bytes(text).translate(LOWER)), width))


def digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    """Of n ordered members, so many first ones meet those of any set within the radius."""
    return n - (num * n + den - 1) // den + 1


class HeavyKeys:
    """Mergeable summary of the keys that occur most (Misra and Gries)."""

    def __init__(self, counters: int = COUNTERS):
        self.most = counters
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        new, counts = np.unique(keys, return_counts=True)
        again = counts > 1  # single ones would only fill the table
        if len(self.keys):
            again |= np.isin(new, self.keys, assume_unique=True)
        new, counts = new[again], counts[again]
        every = np.concatenate([self.keys, new])
        order = np.argsort(every, kind="stable")
        every, amount = every[order], np.concatenate([self.counts, counts])[order]
        if not len(every):
            return
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        self.keys, self.counts = every[first], np.add.reduceat(amount, first)
        if len(self.keys) > 4 * self.most:
            cut = np.partition(self.counts, len(self.counts) - self.most - 1)[len(self.counts) - self.most - 1]
            keep = self.counts > cut
            self.keys, self.counts = self.keys[keep], self.counts[keep] - cut


def describe(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """A row per text (id, n, digest) and a row per task with its heavy shingles."""
    kind = docs.schema[id_col].dataType.simpleString()

    @releasing
    def run(batches):
        heavy, seen, id_type, gathered = HeavyKeys(), set(), None, []
        for batch in batches:
            ns, digests, fresh = [], [], []
            id_type = batch.column(0).type
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                ns.append(len(s))
                d = digest(s) if len(s) else None
                digests.append(d)
                if d is not None and d not in seen:
                    fresh.append(s)
                    if len(seen) < 100_000:
                        seen.add(d)
            gathered += fresh
            if sum(map(len, gathered)) >= GATHERED:
                heavy.add(np.concatenate(gathered))
                gathered = []
            none = pa.nulls(len(ns), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(digests, pa.int64()), none, none], names=[id_col, "n", "digest", "heavy", "times"])
        if gathered:
            heavy.add(np.concatenate(gathered))
        if len(heavy.keys):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, id_type), pa.array([-1], pa.int64()), pa.array([None], pa.int64()), pa.array([heavy.keys.view(np.int64)], pa.list_(pa.int64())), pa.array([heavy.counts], pa.list_(pa.int64()))],
                names=[id_col, "n", "digest", "heavy", "times"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n long, digest long, heavy array<long>, times array<long>")


def _ordered_prefix(s: np.ndarray, heavy: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles of a set in the global order. ``heavy`` has the heavy
    shingles sorted by value with their places in the order in its second row."""
    p = prefix_length(len(s), num, den)
    if not heavy.shape[1]:
        return s[:p]
    at = np.minimum(np.searchsorted(heavy[0], s), heavy.shape[1] - 1)
    is_heavy = heavy[0][at] == s
    light = s[~is_heavy]
    if len(light) >= p:
        return light[:p]
    late = s[is_heavy]
    return np.concatenate([light, late[np.argsort(heavy[1][at[is_heavy]])][: p - len(light)]])


def _entries(docs: DataFrame, text_col: str, width: int, heavy: np.ndarray, buckets: int, num: int, den: int) -> DataFrame:
    """Prefix shingles with their set's digest and size and their place in it, packed by bucket."""

    @releasing
    def run(batches):
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        places: list[np.ndarray] = []
        held, seen = 0, set()

        def flush():
            key = np.concatenate(keys)
            bucket = (key % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            key, bucket = (key[order] // np.uint64(buckets)).astype(np.uint32), bucket[order]
            packed = [key] + [np.concatenate(x)[order] for x in (owners, sizes, places)]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for i in range(0, len(cut) - 1, 256):
                part = [(cut[j], cut[j + 1]) for j in range(i, min(i + 256, len(cut) - 1))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket[a] for a, _ in part], pa.int32())] + [pa.array([x[a:b].tobytes() for a, b in part], pa.binary()) for x in packed],
                    names=["bucket", "keys", "owners", "sizes", "places"],
                )

        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py(), width)
                if not len(s):
                    continue
                d = digest(s)
                if d in seen:
                    continue
                if len(seen) < 100_000:
                    seen.add(d)
                k = _ordered_prefix(s, heavy, num, den)
                keys.append(k)
                owners.append(np.full(len(k), d, np.int64))
                sizes.append(np.full(len(k), size_code(len(s)), np.uint16))
                places.append((np.arange(len(k)) * 256 // len(s)).astype(np.uint8))
                held += len(k)
            if held >= HELD_ENTRIES:
                yield from flush()
                keys, owners, sizes, places, held = [], [], [], [], 0
        if held:
            yield from flush()

    return docs.select(text_col).mapInArrow(run, "bucket int, keys binary, owners binary, sizes binary, places binary")


def size_code(n: int) -> int:
    """A set's size in two bytes; ``_size_range`` has it inside."""
    return min(int(STEPS * math.log2(n)), 65535)


def _size_range(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the sizes of a code, a step wider on each side than rounding asks for."""
    code = code.astype(np.float64)
    return np.exp2((code - 1) / STEPS), np.where(code < 65535, np.exp2((code + 2) / STEPS), np.inf)


def partners(key: np.ndarray, least: np.ndarray, left: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """For each member, ordered by key and least size: whether some other of its
    key may be within the radius, and the last such one after it (else itself).

    Two sets whose first common member leaves x in one and y in the other, it
    included, share min(x, y) members at most; ``left`` has upper bounds of these."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    end = np.repeat(start + size, size)
    whole = np.repeat(size > FEW_MEMBERS, size)
    some, last = whole.copy(), np.where(whole, end - 1, np.arange(len(key)))
    at, d = np.flatnonzero(~whole), 0
    while len(at):
        d += 1
        at = at[at + d < end[at]]
        need = num * (least[at] + least[at + d])
        # sizes rise, so one that is too large for a member is followed by such only
        ok = left[at] * (num + den) >= need
        at, need = at[ok], need[ok]
        near = at[left[at + d] * (num + den) >= need]
        some[near] = some[near + d] = True
        last[near] = near + d
    return some, last


def _regions(table: pa.Table, num: int, den: int) -> pa.Table:
    """The regions of one bucket: (region, member), a region named by its members."""
    key, owner, size, place = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[k]]) for k, kind in (("keys", np.uint32), ("owners", np.int64), ("sizes", np.uint16), ("places", np.uint8)))
    order = np.lexsort((place, owner, key))
    key, owner, size, place = key[order], owner[order], size[order], place[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
    # only keys of two members at least
    often = new & np.isin(key, key[new][1:][key[new][1:] == key[new][:-1]])
    key, owner, size, place = key[often], owner[often], size[often], place[often]
    order = np.lexsort((owner, size, key))
    key, owner, size, place = key[order], owner[order], size[order], place[order]
    one = np.empty(0, np.int64)
    if not len(key):
        return pa.table({"region": one, "member": one})
    least, most = _size_range(size)
    some, last = partners(key, least, most * (256 - place.astype(np.float64)) / 256, num, den)
    # a region ends where no member reaches further
    part = np.cumsum(np.concatenate([[True], np.maximum.accumulate(last)[:-1] < np.arange(1, len(key))]))[some]
    owner = owner[some]
    order = np.lexsort((owner, part))
    owner, part = owner[order], part[order]
    start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else one
    end = np.append(start[1:], len(part))
    names, members, seen = [], [], set()
    for a, b in zip(start, end):
        m = owner[a:b]
        name = int.from_bytes(hashlib.blake2b(m.tobytes(), digest_size=8).digest(), "little", signed=True)
        if name not in seen:
            seen.add(name)
            names.append(np.full(b - a, name, np.int64))
            members.append(m)
    return pa.table({"region": np.concatenate(names) if names else one, "member": np.concatenate(members) if members else one})


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, total) for the written pairs (a, b): sizes of intersection and union."""
    left = sets.select(F.col("digest").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("digest").alias("b"), F.col("members").alias("right"))

    @releasing
    def run(batches):
        for batch in batches:
            common, total = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                n = int(np.count_nonzero(both[1:] == both[:-1]))
                common.append(n)
                total.append(len(x) + len(y) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "common", "total"])

    # the sets of few pairs are picked out where they lie; then only these move
    pairs = _few(pairs, pairs.count())
    joined = left.join(pairs, "a").join(right.join(pairs, "b"), ["a", "b"]).select("a", "b", "left", "right")
    return joined.mapInArrow(run, "a long, b long, common long, total long")


def sketch(s: np.ndarray) -> bytes:
    """Counts of a set's members in ranges of the hash, about one in each, of large
    sets two to four. Two sets differ in at least as many members as their counts
    differ by; unrelated ones of n members by about 1.1 n / sqrt(members a range)."""
    bits = max(4, (max(len(s) - 1, 1)).bit_length())
    bits = max(min(bits, 6), bits - 2)
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def sketch_apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of members that only one of two sets has."""
    x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    n = min(len(x), len(y))
    return int(np.abs(x.reshape(n, -1).sum(axis=1) - y.reshape(n, -1).sum(axis=1)).sum())


def _maybe_near(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) but those whose sketches put them outside the radius."""
    left = sets.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("left"))
    right = sets.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("right"))

    @releasing
    def run(batches):
        for batch in batches:
            most = (np.asarray(batch.column(4)) + np.asarray(batch.column(5))) * (den - num)
            keep = [sketch_apart(x.as_py(), y.as_py()) * (den + num) <= m for x, y, m in zip(batch.column(2), batch.column(3), most)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right", "na", "nb")
    return joined.mapInArrow(run, "a long, b long")


def class_starts(most: int, num: int = NUM, den: int = DEN) -> list[int]:
    """Least sizes of the size classes up to ``most``: a set within the radius of
    one in class c is in class c - 1, c or c + 1."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, -(-out[-1] * den // num)))
    return out


def candidate_groups(root: np.ndarray, n: np.ndarray, sketches: list[bytes], side: np.ndarray, own: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The group of each member: those that pairs of different components, which
    sizes and sketches leave possible, hold together. A member without such a pair
    is alone. With ``side`` 0 and 1 (two blocks) only pairs across count; else -1.
    Of two members one at least is ``own``; the others' pairs meet elsewhere."""
    group = np.arange(len(root))
    folded: dict[int, np.ndarray] = {}

    def at_length(k):
        # all sketches that are at least k long, folded to k counts
        if k not in folded:
            folded[k] = np.stack([np.frombuffer(x, np.uint8).reshape(k, -1).sum(axis=1, dtype=np.int16) if len(x) >= k else np.zeros(k, np.int16) for x in sketches])
        return folded[k]

    long = np.array([len(x) for x in sketches])
    for i in range(len(root)):
        # members of one group already need no look at their pair
        ok = (n * den >= n[i] * num) & (n[i] * den >= n * num) & (root != root[i]) & (group != group[i]) & (own | own[i])
        ok[:i] = False
        if side[i] >= 0:
            ok &= side != side[i]
        js = np.flatnonzero(ok)
        for k in np.unique(np.minimum(long[js], long[i])) if len(js) else ():
            some = js[np.minimum(long[js], long[i]) == k]
            f = at_length(int(k))
            apart = np.abs(f[some] - f[i]).sum(axis=1, dtype=np.int64)
            some = some[apart * (den + num) <= (n[some] + n[i]) * (den - num)]
            for g in np.unique(group[some]):
                group[group == g] = group[i]
    return group


def parts(n: np.ndarray) -> list[np.ndarray]:
    """Positions of a group's members, of the sizes ``n``, in parts that are counted
    at once: all, or every two of the pieces that hold about ``PART_ENTRIES``."""
    piece = (np.cumsum(n) - n) // PART_ENTRIES
    pieces = [np.flatnonzero(piece == k) for k in np.unique(piece)]
    if len(pieces) == 1:
        return pieces
    return [np.concatenate([x, y]) for i, x in enumerate(pieces) for y in pieces[:i]]


def uniting_links(node: np.ndarray, root: np.ndarray, sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """Links (two arrays) of members within the radius, by exact distances, that
    unite all components which such links of these members do; no more than that takes."""
    m, size = len(sets), np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(m, dtype=np.int32), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    last = np.flatnonzero(np.concatenate([values[1:] != values[:-1], [True]])) + 1
    end = np.repeat(last, np.diff(last, prepend=0))
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    start, part, left, right = np.cumsum(size) - size, np.unique(root, return_inverse=True)[1], [], []
    for i in range(m - 1):
        # the owners of a shingle stand in order: those after this one
        a = at[start[i] : start[i] + size[i]] + 1
        times = end[a - 1] - a
        common, done = np.zeros(m, np.int64), 0
        upto = np.cumsum(times)
        while done < len(a):
            stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + COUNTED, "right")))
            t = times[done:stop]
            where = np.repeat(a[done:stop] - (np.cumsum(t) - t), t) + np.arange(t.sum())
            common += np.bincount(owner[where], minlength=m)
            done = stop
        for j in np.flatnonzero((common > 0) & (common * den >= (size + size[i] - common) * num)):
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                left.append(node[i])
                right.append(node[j])
    return np.array(left, np.int64), np.array(right, np.int64)


def _windows(open_: DataFrame, starts: list[int]) -> DataFrame:
    """Open regions by size windows: (region, w, pivot, member, root, n, own, m) with
    the window's number of members. Members of the smaller class aren't its own."""
    cls = sum((F.when(F.col("n") >= v, 1).otherwise(0) for v in starts), F.lit(0))
    windows = open_.withColumn("c", cls).withColumn("w", F.explode(F.array(F.col("c"), F.col("c") + 1))).withColumn("own", F.col("c") == F.col("w"))
    size = windows.groupBy("region", "w").agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("own").alias("any")).where("r0 <> r1 and any")
    return windows.join(size.select("region", "w", "m"), ["region", "w"]).select("region", "w", "pivot", "member", "root", "n", "own", "m")


def _groups(windows: DataFrame, sketches: DataFrame, whole: bool, num: int, den: int) -> DataFrame:
    """(grp, member, root): members whose sets are to be counted against each other,
    a group named by its members. Of windows larger than ``WHOLE_REGION`` only if
    ``whole``, in blocks against blocks."""
    told = windows if whole else windows.where(F.col("m") <= WHOLE_REGION)
    told = told.withColumn("blocks", F.when(F.col("m") > WHOLE_REGION, F.ceil(F.col("m") / BLOCK).cast("int")).otherwise(1)).withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    # a block meets itself and every other: (lesser, greater)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    told = told.withColumn("o", other).withColumn("b0", F.least("block", "o")).withColumn("b1", F.greatest("block", "o"))
    told = told.withColumn("side", F.when(F.col("b0") == F.col("b1"), -1).otherwise((F.col("block") == F.col("b1")).cast("int")))
    told = told.join(sketches.select(F.col("digest").alias("member"), "sketch"), "member").select("region", "w", "b0", "b1", "member", "root", "n", "side", "own", "sketch")

    def find(t: pa.Table) -> pa.Table:
        t = t.sort_by("member")
        member, root, n, side, own = (t[k].to_numpy() for k in ("member", "root", "n", "side", "own"))
        group = candidate_groups(root, n, t["sketch"].to_pylist(), side, own, num, den)
        order = np.argsort(group, kind="stable")
        cut = np.flatnonzero(np.diff(group[order])) + 1
        out = [(np.empty(0, np.int64),) * 3]
        for found in np.split(order, cut):
            for some in parts(n[found]) if len(found) > 1 else ():
                x = found[some]
                name = int.from_bytes(hashlib.blake2b(np.sort(member[x]).tobytes(), digest_size=8).digest(), "little", signed=True)
                out.append((np.full(len(x), name, np.int64), member[x], root[x]))
        return pa.table(dict(zip(("grp", "member", "root"), map(np.concatenate, zip(*out)))))

    return told.groupBy("region", "w", "b0", "b1").applyInArrow(find, "grp long, member long, root long").distinct()


def _united(groups: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that unite components of a group, fewer than it has members."""
    told = groups.join(sets.select(F.col("digest").alias("member"), "members"), "member")

    def unite(t: pa.Table) -> pa.Table:
        a, b = uniting_links(t["member"].to_numpy(), t["root"].to_numpy(), [np.frombuffer(x.as_py(), np.uint64) for x in t["members"]], num, den)
        return pa.table({"a": a, "b": b})

    return told.groupBy("grp").applyInArrow(unite, "a long, b long").distinct()


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_IDS else df


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row: id, n_shingles, component_id; a link is Jaccard >= num/den."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    told = scratch.put(describe(docs, id_col, text_col, width), "told")
    rows = told.where("n >= 0").select(id_col, "n", "digest")
    classes = scratch.put(rows.where("digest is not null").groupBy("digest").agg(F.min(id_col).alias("rep"), F.first("n").alias("n")), "classes")

    heavy = told.where("n = -1").select(F.explode(F.arrays_zip("heavy", "times")).alias("z")).groupBy(F.col("z.heavy").alias("key")).agg(F.sum("z.times").alias("times"))
    found = heavy.where(F.col("times") >= HEAVY).orderBy(F.desc("times"), "key").limit(MOST_HEAVY).toArrow()
    order = np.array([found["key"].to_numpy(), found["times"].to_numpy()], dtype=np.int64).reshape(2, -1)
    values, late = order[0].view(np.uint64), np.lexsort((order[0].view(np.uint64), order[1]))
    place = np.empty(len(values), np.uint64)
    place[late] = np.arange(len(values), dtype=np.uint64)
    by_value = np.argsort(values)
    heavy_table = np.stack([values[by_value], place[by_value]]) if len(values) else np.empty((2, 0), np.uint64)

    entries = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(entries) // BUCKET_ENTRIES + 1)
    packed = _entries(docs, text_col, width, heavy_table, buckets, num, den)
    regions = packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lambda t: _regions(t, num, den), "region long, member long")
    regions = scratch.put(regions.distinct(), "regions-0")
    scratch.sweep()

    links = None
    wanted = regions.select(F.col("member").alias("digest")).distinct()
    wanted = scratch.put(wanted.join(classes, "digest"), "wanted")
    sketches = scratch.put(_sets(docs, wanted, id_col, text_col, width, "sketch"), "sketches")
    scratch.sweep()
    labels = wanted.select(F.col("digest").alias("node"), F.col("digest").alias("root"))
    # the more regions a member is in, the more of it others share: cells grow around such
    degrees = regions.groupBy(F.col("member").alias("node")).agg(F.count("*").alias("degree"))
    sizes = scratch.put(wanted.select(F.col("digest").alias("node"), "n").join(degrees, "node"), "sizes")
    starts = class_starts(classes.agg(F.max("n")).first()[0] or 1, num, den)
    round_ = 0
    while True:
        known = regions.join(labels.join(sizes, "node"), F.col("member") == F.col("node")).select("region", "member", "root", "n", "degree")
        about = known.groupBy("region").agg(F.min_by("member", F.struct(-F.col("degree"), "member")).alias("pivot"), F.max("degree").alias("p_degree"), F.count("*").alias("members"), F.min("root").alias("r0"), F.max("root").alias("r1"))
        about = about.where("r0 <> r1").select("region", "pivot", "p_degree", "members")
        open_ = scratch.put(known.join(about, "region"), f"open-{round_}")
        if not open_.limit(1).count():
            break
        # a pair whose sizes are further apart than the radius can't be within it
        near_size = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
        windows = groups = None
        if round_ < CELL_ROUNDS:
            # cells first: each member meets one pivot of another component
            spokes = open_.join(labels.select(F.col("node").alias("pivot"), F.col("root").alias("p_root")), "pivot").where("p_root <> root")
            spokes = spokes.groupBy(F.col("member").alias("b")).agg(F.min_by("pivot", F.struct(-F.col("p_degree"), "pivot")).alias("a"), F.first("n").alias("nb"))
            spokes = spokes.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").where(near_size).select("a", "b")
            maybe = _maybe_near(spokes, sketches, num, den)
        else:
            windows = scratch.put(_windows(open_, starts), f"windows-{round_}")
            groups = scratch.put(_groups(windows, sketches, round_ >= PIVOT_ROUNDS, num, den), f"groups-{round_}")
            # the bands of larger windows need all distances to the pivots
            maybe = _too_large(windows).where(F.lit(round_ < PIVOT_ROUNDS)).select(F.col("pivot").alias("a"), F.col("member").alias("b")).distinct()
        maybe = scratch.put(maybe, f"maybe-{round_}")
        scratch.sweep()
        ends = maybe.select(F.col("a").alias("digest")).union(maybe.select("b"))
        ends = (ends if groups is None else ends.union(groups.select("member"))).distinct()
        ends = scratch.put(wanted.join(ends, "digest", "left_semi"), f"ends-{round_}")
        sets = scratch.put(_sets(docs, ends, id_col, text_col, width, "members"), f"sets-{round_}")
        scratch.sweep()
        distances = scratch.put(_distances(maybe, sets), f"distances-{round_}")
        new = distances.where(F.col("common") * den >= F.col("total") * num).select("a", "b")
        if groups is not None:
            new = new.union(scratch.put(_united(groups, sets, num, den), f"united-{round_}"))
        scratch.drop(f"sets-{round_}", f"groups-{round_}")
        scratch.sweep()
        links = new if links is None else links.union(new)
        roots = components(links, scratch, f"cc{round_}")
        labels = scratch.put(wanted.select(F.col("digest").alias("node")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), f"labels-{round_}")
        if round_ >= PIVOT_ROUNDS:  # all windows, small ones too, have been joined
            break
        if round_ == CELL_ROUNDS - 1:
            # regions around one pivot hold much the same members: as one, each pair meets once
            regions = scratch.put(open_.select(F.col("pivot").alias("region"), "member").distinct(), "merged")
        if round_ >= CELL_ROUNDS:
            regions = scratch.put(_next_regions(windows, distances, round_, num, den), f"regions-{round_ + 1}")
            scratch.drop(f"regions-{round_}" if round_ > CELL_ROUNDS else "merged")
        scratch.drop(f"open-{round_}", f"maybe-{round_}", f"windows-{round_}")
        round_ += 1

    reps = classes.join(labels, F.col("digest") == F.col("node"), "left").select("digest", "rep", F.coalesce("root", "digest").alias("root"))
    least = reps.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_digest = reps.join(least, "root").select("digest", "component_id")
    out = rows.join(by_digest, "digest", "left")
    return out.select(id_col, F.col("n").alias("n_shingles"), F.coalesce("component_id", id_col).alias("component_id"))


def _too_large(windows: DataFrame) -> DataFrame:
    """The members, but for the pivots, of windows too large to be joined at once."""
    return windows.where((F.col("m") > WHOLE_REGION) & (F.col("member") != F.col("pivot")))


def _next_regions(windows: DataFrame, distances: DataFrame, round_: int, num: int, den: int) -> DataFrame:
    """The regions of the next round from the members' distances to the pivots.

    Windows that are small enough have been joined. In larger ones the pivot is
    done: it has met all members. The others fall into bands as wide as the
    radius; a band's region holds the next band too."""
    rest = _too_large(windows)
    d = distances.select(F.col("a").alias("pivot"), F.col("b").alias("member"), "common", "total")
    rest = rest.join(d, ["pivot", "member"])
    # floor of distance / radius, in whole numbers
    band = F.floor((F.col("total") - F.col("common")) * den / (F.col("total") * (den - num))).cast("int")
    bands = F.array_distinct(F.array(F.greatest(band - 1, F.lit(0)), band))
    out = rest.select("region", "w", "member", F.explode(bands).alias("band"))
    return out.select(F.xxhash64("region", "w", "band", F.lit(round_)).alias("region"), "member").distinct()


def _bit(id_col: str, size: int) -> Column:
    """The bit of an id, of ``size`` (a power of two)."""
    return F.xxhash64(id_col).bitwiseAND(F.lit(size - 1)).cast("int").alias("bit")


def _id_bits(ids: DataFrame, size: int) -> np.ndarray:
    """The bits (bit) of ids, eight a byte; all of them for very many ids."""
    if ids.count() > size // 2:
        return np.full(size // 8, 255, np.uint8)
    on = np.zeros(size, bool)
    on[ids.distinct().toArrow()["bit"].to_numpy()] = True
    return np.packbits(on, bitorder="little")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int, what: str) -> DataFrame:
    """(digest, n, sketch or members) of the wanted classes, from one text of each."""
    n = wanted.count()
    ids = wanted.select(F.col("rep").alias("_rep")).distinct()
    if n <= BROADCAST_IDS:
        bits = None
        some = docs.select(id_col, text_col).join(F.broadcast(ids), F.col(id_col).eqNullSafe(F.col("_rep")), "left_semi").select(F.lit(0).alias("bit"), text_col)
    else:
        # texts never move: ids are told by bits where they lie, and the few texts
        # whose ids share a bit with another's are told by their digests below
        size = min(ID_BITS, 1 << (16 * n).bit_length())
        bits = _id_bits(ids.select(_bit("_rep", size)), size)
        some = docs.select(_bit(id_col, size), text_col)

    @releasing
    def run(batches):
        for batch in batches:
            digests, sizes, held = [], [], []
            texts = batch.column(1)
            if bits is not None:
                at = batch.column(0).to_numpy()
                texts = texts.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1, pa.bool_()))
            for text in texts:
                s = shingle_set(text.as_py(), width)
                if len(s):
                    digests.append(digest(s))
                    sizes.append(len(s))
                    held.append(s.tobytes() if what == "members" else sketch(s))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], names=["digest", "n", what])

    made = some.mapInArrow(run, f"digest long, n long, {what} binary")
    made = made.join(_few(wanted.select("digest"), n), "digest", "left_semi")
    return made.dropDuplicates(["digest"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, the one of the least id, of each component.

    Decided by id: a row stays if any row of its id is its component's least.
    Rows with a null id stay. A repeated id keeps one row."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = scratch.put(jaccard_components(docs, id_col, text_col), "found")
    ids = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(id_col) == F.col("component_id")).alias("stays"), F.count("*").alias("times"))
    ids = scratch.put(ids, "ids")
    gone = ids.where(~F.col("stays")).select(id_col)
    out = docs.join(_few(gone, gone.count()), id_col, "left_anti").select(docs.columns)
    if ids.where("stays and times > 1").limit(1).count():
        out = out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))
    return out
