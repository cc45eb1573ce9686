"""Operator 10: embedding near-duplicates over a robust-pruned flat graph.

1. Vectors are compared only within a label. Equal vectors of a label are one
   class, so a group of copies of any size is one node.
2. Shards. A label gets a centre for each ``PER_CENTRE`` classes (``MOST_CENTRES``
   at most), fitted by one task on a sample of ``PER_FIT`` classes a centre; a label
   too small for two is one shard. Every class goes to its nearest ``OVERLAP``
   centres, so neighbouring shards overlap. Centres of up to ``CENTRE_BYTES`` go
   to all tasks, more meet bounded parts of their labels on the executors. A shard
   with more than ``BLOCK`` classes is dealt into blocks.
3. Build. Each block gets a flat graph: every node keeps a few neighbours, the
   nearest first, and drops a candidate that a kept neighbour is closer to by
   the factor ``ALPHA`` (robust pruning); links back are added and pruned again.
4. Union. Adjacency lists that a node got in several shards are united, and go
   back to every block that has the node.
5. Search. Every class looks from its home shard into each block of it: a greedy
   search from the nearest of the block's medoids reaches its surroundings, then the range is
   expanded over the graph while nodes within ``SLACK`` of the threshold turn up.
6. Verify. Cosines of what was found are computed in double precision from the
   vectors; only pairs at or over the threshold count. ``audit`` measures recall
   against brute force for a share of the rows.

A task holds one block and a bounded batch of queries. Links leave a task as
counts and the least node reached, never as all pairs of a group. A link counts at
both of its ends: where the home shard of one end doesn't hold the other, only one
of them can find it, and its task counts the link for the other one too.

Vectors that are null, empty, zero or hold null or non-finite components, and
those with a null label, link with nothing. Vectors of unequal length aren't
compared. A repeated row (same id, vector and label) counts as a vector of its
own. Null ids are never a component's id unless the class has none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, releasing
from .components import components

THRESHOLD = 0.93
#: Classes a centre aims at, and sampled classes that it is fitted on; the most
#: centres of a label; bytes of all centres that go to every task; classes that
#: meet centres at once where they don't.
PER_CENTRE, PER_FIT, MOST_CENTRES, CENTRE_BYTES, PART = 400, 8, 4096, 32 << 20, 20_000
#: Shards that each class is put in, and classes in a block.
OVERLAP, BLOCK = 3, 1500
#: Neighbours a node keeps, candidates it is given, the pruning factor, the
#: width of the greedy search and how far below the threshold the range goes on.
DEGREE, CANDIDATES, ALPHA, BEAM, SLACK = 24, 64, 1.2, 48, 0.12
#: Neighbours that keep a link back to a node whatever pruning says.
FIRST = 3
#: Nodes that an entry node stands for, and entries a search begins with.
PER_MEDOID, ENTRIES = 20, 8
#: Rows a query batch holds.
QUERIES = 2000


# --- the graph of one block -------------------------------------------------


def robust_prune(sims: np.ndarray, among: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Of candidates in falling order of similarity ``sims``, those kept.

    ``among``: similarities between candidates. Distances are 1 - cosine."""
    alive, kept = np.ones(len(sims), bool), []
    far = 1.0 - sims
    while len(kept) < degree:
        left = np.flatnonzero(alive)
        if not len(left):
            break
        best = int(left[0])
        kept.append(best)
        alive &= alpha * (1.0 - among[best]) > far
        alive[best] = False
    return kept


def build_graph(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[list[int]]:
    """Adjacency lists of unit vectors ``x``."""
    n = len(x)
    if n <= 1:
        return [[] for _ in range(n)]
    k = min(candidates, n - 1)
    out: list[list[int]] = []
    for a in range(0, n, 512):
        sims = x[a : a + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        for i, row in enumerate(near):
            row = row[np.argsort(-sims[i, row], kind="stable")]
            out.append([int(row[j]) for j in robust_prune(sims[i, row], x[row] @ x[row].T, degree, alpha)])
    back: list[set[int]] = [set(e) for e in out]
    for i, e in enumerate(out):
        for j in e:
            back[j].add(i)
    for i, e in enumerate(back):
        if len(e) > 2 * degree:
            row = np.fromiter(e, np.int64)
            s = x[row] @ x[i]
            row = row[np.argsort(-s, kind="stable")]
            e = {int(row[j]) for j in robust_prune(x[row] @ x[i], x[row] @ x[row].T, 2 * degree, alpha)}
        back[i] = set(e)
    for i, e in enumerate(out):  # pruning may not cut a node off: its first neighbours lead to it
        for j in e[:FIRST]:
            back[j].add(i)
    return [sorted(e) for e in back]


def medoids(x: np.ndarray) -> np.ndarray:
    """Entry nodes: the node nearest to each of the block's own centres, so that
    a tight group of which no kept neighbour lies outside has one as well."""
    c = fit_centres(x, max(1, len(x) // PER_MEDOID), rounds=4)
    return np.unique(np.argmax(x @ c.T, axis=0))


def range_search(q: np.ndarray, x: np.ndarray, graph: list[np.ndarray], entries: np.ndarray, threshold: float = THRESHOLD, beam: int = BEAM, slack: float = SLACK) -> np.ndarray:
    """Nodes with similarity >= threshold to ``q`` that the graph leads to."""
    seen = np.zeros(len(x), bool)
    sims = x[entries] @ q
    best = np.argsort(-sims, kind="stable")[:ENTRIES]
    ids, sims, open_ = entries[best], sims[best], np.ones(len(best), bool)
    seen[ids] = True
    while open_.any():  # greedy: expand all open nodes of the beam at once
        front, open_ = ids[open_], np.zeros(len(ids), bool)
        new = np.unique(np.concatenate([graph[i] for i in front]))
        new = new[~seen[new]]
        if not len(new):
            break
        seen[new] = True
        ids, sims, open_ = np.concatenate([ids, new]), np.concatenate([sims, x[new] @ q]), np.concatenate([open_, np.ones(len(new), bool)])
        if len(ids) > beam:
            best = np.argpartition(-sims, beam - 1)
            keep = best[:beam]
            extra = best[beam:][sims[best[beam:]] >= threshold - slack]
            keep = np.concatenate([keep, extra])  # the range expands past the beam
            ids, sims, open_ = ids[keep], sims[keep], open_[keep]
    return ids[sims >= threshold - 1e-4]


# --- shards -----------------------------------------------------------------


def fit_centres(x: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Unit centres of unit vectors by k-means on the sphere."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-30), c)
    return c


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column], np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of large components stay finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _comparable(vec_col: str, label_col: str):
    """Whether a row is compared at all, and its vector in double precision."""
    v = F.transform(F.col(vec_col), lambda e: F.when(e == 0, F.lit(0.0)).otherwise(e.cast("double")))
    finite = F.forall(F.col(vec_col), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    some = F.exists(F.col(vec_col), lambda e: e != 0)
    return F.col(label_col).isNotNull() & F.coalesce(finite & some, F.lit(False)), v


def classes_of(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(node, label, dim, v, rep, copies): a row per distinct comparable vector of a label."""
    good, v = _comparable(vec_col, label_col)
    good = vectors.where(good)
    good = good.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    return good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).select(F.xxhash64("label", "v").alias("node"), "label", F.size("v").alias("dim"), "v", "rep", "copies")


def _centres(classes: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, dim, shard, centre) of the labels with more than one, from a bounded
    sample of each: the class of the least hash in each of its buckets."""
    many = counts.where("k > 1")
    bucket = F.pmod(F.xxhash64("node", F.lit(11)), F.col("k") * PER_FIT)
    picked = classes.join(many, ["label", "dim"]).groupBy("label", "dim", "k", bucket.alias("bucket")).agg(F.min_by("v", F.xxhash64("node", F.lit(13))).alias("v"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(_matrix(pdf.sort_values("bucket").v))
        c = fit_centres(x, min(int(pdf.k.iloc[0]), max(1, len(x) // PER_FIT)))
        return pd.DataFrame({"label": pdf.label.iloc[0], "dim": pdf.dim.iloc[0], "shard": range(len(c)), "centre": list(c)})

    return picked.groupBy("label", "dim", "k").applyInPandas(fit, "label string, dim int, shard int, centre array<double>")


def _assigned(part: pd.DataFrame, c: np.ndarray | None) -> pd.DataFrame:
    """The classes of ``part`` in each of their shards; ``shards``: the nearest first, their home."""
    order = np.zeros((len(part), 1), int) if c is None or not len(c) else np.argsort(-(_unit(_matrix(part.v)) @ c.T), axis=1, kind="stable")[:, :OVERLAP]
    all_of = [r.tolist() for r in order]
    return pd.concat([pd.DataFrame({"label": part.label, "dim": part.dim, "shard": order[:, r], "home": r == 0, "node": part.node, "v": part.v, "copies": part.copies, "shards": all_of}) for r in range(order.shape[1])])


_PLACED = "label string, dim int, shard int, home boolean, node long, v array<double>, copies long, shards array<int>"


def _placed(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The classes in their shards."""
    k = F.least(F.lit(MOST_CENTRES), F.greatest(F.lit(1), F.round(F.col("n") / PER_CENTRE).cast("int")))
    counts = scratch.put(classes.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("k", k), "counts")
    centres = scratch.put(_centres(classes, counts), "centres")
    if (centres.agg(F.sum(F.col("dim") * 8)).first()[0] or 0) <= CENTRE_BYTES:
        known: dict[tuple[str, int], np.ndarray] = {}
        for r in centres.orderBy("label", "dim", "shard").toLocalIterator():
            known.setdefault((r.label, r.dim), []).append(r.centre)
        known = {k: np.array(v) for k, v in known.items()}
        schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("shard", pa.int32()), ("home", pa.bool_()), ("node", pa.int64()), ("v", pa.list_(pa.float64())), ("copies", pa.int64()), ("shards", pa.list_(pa.int32()))])

        @releasing
        def assign(batches):
            for batch in batches:
                pdf = batch.to_pandas()
                out = [_assigned(part, known.get((label, int(dim)))) for (label, dim), part in pdf.groupby(["label", "dim"])]
                if out:
                    yield pa.RecordBatch.from_pandas(pd.concat(out), schema=schema, preserve_index=False)

        return classes.mapInArrow(assign, _PLACED)
    parts = F.ceil(F.col("n") / PART).cast("int")
    salted = classes.join(counts, ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(23)), parts).cast("int"))
    spread = centres.join(counts, ["label", "dim"]).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

    def meet(part: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({x.split()[0]: [] for x in _PLACED.split(", ")})
        return _assigned(part, _matrix(c.sort_values("shard").centre) if len(c) else None)

    key = ["label", "dim", "part"]
    return salted.select(*key, "node", "v", "copies").groupBy(key).cogroup(spread.select(*key, "shard", "centre").groupBy(key)).applyInPandas(meet, _PLACED)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Per vector: id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardup")
    classes = scratch.put(classes_of(vectors, id_col, vec_col, label_col), "classes")
    placed = scratch.put(_placed(classes, scratch), "placed")
    # blocks of a shard: as many as keep each within its size
    sizes = placed.groupBy("label", "dim", "shard").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = placed.join(sizes, ["label", "dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(17)), F.col("blocks")).cast("int"))
    dealt = scratch.put(dealt.select("label", "dim", "shard", "block", "blocks", "home", "node", "v", "copies", "shards"), "dealt")
    key = ["label", "dim", "shard", "block"]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        nodes = pdf.node.to_numpy()
        graph = build_graph(_unit(_matrix(pdf.v)))
        return pd.DataFrame({"node": nodes, "to": [nodes[np.asarray(e, np.int64)] for e in graph]})

    lists = dealt.select(*key, "node", "v").groupBy(key).applyInPandas(build, "node long, to array<long>")
    united = scratch.put(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to")), "lists")
    members = scratch.put(dealt.join(united, "node").select(*key, "node", "v", "copies", F.col("shards")[0].alias("lives"), "to"), "members")
    # a block's graph meets the queries of its shard in batches
    batch = F.pmod(F.xxhash64("node", F.lit(19)), F.greatest(F.lit(1), F.ceil(F.col("blocks") * BLOCK / QUERIES))).cast("int")
    asked = dealt.where("home").withColumn("part", batch).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = scratch.put(asked.select(*key, "part", "node", "v", "copies", "shards"), "asked")
    parts = scratch.put(asked.select(*key, "part").distinct(), "parts")
    given = members.join(parts, key).select(*key, "part", "node", "v", "copies", "lives", "to")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "n": [], "root": []}).astype("int64")
        right = right.sort_values("node")
        nodes, copies, lives, x = right.node.to_numpy(), right.copies.to_numpy(), right.lives.to_numpy(), _unit(_matrix(right.v))
        graph = []
        for e in right.to:
            at = np.minimum(np.searchsorted(nodes, e), len(nodes) - 1)
            graph.append(at[nodes[at] == e])
        start = medoids(x)
        links, back, root = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64), {}

        def find(i):
            while root.setdefault(i, i) != i:
                root[i] = i = root[root[i]]
            return i

        asking, own_copies, shards = left.node.to_numpy(), left.copies.to_numpy(), left.shards.to_list()
        for i, v in enumerate(_unit(_matrix(left.v))):
            hit = range_search(v, x, graph, start, threshold)
            hit = hit[(x[hit] @ v >= threshold) & (nodes[hit] != asking[i])]
            links[i] = copies[hit].sum()
            # whose home shard doesn't hold this one can't find it
            back[hit[~np.isin(lives[hit], shards[i])]] += own_copies[i]
            for j in nodes[hit].tolist():
                a, b = find(int(asking[i])), find(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
        touched = sorted(root)
        own = pd.DataFrame({"node": asking, "n": links, "root": [find(int(k)) for k in asking]})
        other = pd.DataFrame({"node": touched, "n": 0, "root": [find(k) for k in touched]})
        found_by = np.flatnonzero(back)
        more = pd.DataFrame({"node": nodes[found_by], "n": back[found_by], "root": [find(int(k)) for k in nodes[found_by]]})
        return pd.concat([own[own.n > 0], other[~other.node.isin(own.node)], more]).astype("int64")

    group = [*key, "part"]
    found = asked.groupBy(group).cogroup(given.groupBy(group)).applyInPandas(search, "node long, n long, root long")
    found = scratch.put(found, "found")
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    of_node = classes.select("node", "rep", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counted = of_node.join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left")
    least = of_node.groupBy("root").agg(F.min("rep").alias("component"))
    per_node = counted.join(least, "root").select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    good, v = _comparable(vec_col, label_col)
    rows = vectors.select(F.col(id_col).alias("_id"), F.when(good, F.xxhash64(F.col(label_col).cast("string"), v)).alias("node"))
    out = rows.join(per_node, "node", "left")
    component = F.coalesce("component", "_id")
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def audit(vectors: DataFrame, result: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, every: int = 50, block: int = 4000) -> tuple[float, int]:
    """Recall of links against brute force, and how many ends of links that is of:
    of all rows whose id is divisible by ``every`` against all rows, in blocks of
    about ``block`` of the former."""
    good, v = _comparable(vec_col, label_col)
    rows = vectors.where(good).select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    chosen = rows.where(F.col("id") % every == 0)
    blocks, true, got = -(-chosen.count() // block), 0, 0
    for k in range(blocks):
        asked = chosen.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).toPandas()

        def run(batches, asked=asked):
            total: dict[int, int] = {}
            for pdf in batches:
                for (label, dim), part in pdf.groupby(["label", pdf.v.map(len)]):
                    q = asked[(asked.label == label) & (asked.v.map(len) == dim)]
                    if len(q):
                        n = ((_unit(_matrix(q.v)) @ _unit(_matrix(part.v)).T) >= threshold).sum(axis=1)
                        for i, c in zip(q.id, n):
                            total[i] = total.get(i, 0) + int(c)
            yield pd.DataFrame({"id": list(total), "n": list(total.values())}).astype("int64")

        links = rows.mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        both = links.join(result, links.id == result[id_col]).agg(F.sum(F.col("n") - 1), F.sum(F.least(F.col("n") - 1, F.col("n_links")))).first()
        true, got = true + (both[0] or 0), got + (both[1] or 0)
    return (got / true if true else 1.0), int(true)
