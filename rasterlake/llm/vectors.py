"""Embedding near-duplicates by product quantisation.

Vectors are scaled to unit length, so cosine >= t means a distance of at most r = sqrt(2 - 2 t). A coarse codebook splits them
into inverted lists, and residuals are coded by subspace, in two rounds. The codebooks are fitted on a bounded sample; every vector is
indexed. A query probes every list whose Voronoi cell comes within r of it: x lies nearer to its own centroid than to the
query's, so the query must be within r of the plane between the two; of a list, it meets the entries whose stored place along the centroid's
direction is within r of its own. Asymmetric distances d(q, code of x) keep x only if d <= r + e, where e is the stored quantisation
error of x. All bounds hold for every pair, so the probes are sufficient and recall is that of brute force.

No vector is copied to the lists that it probes: a label's vectors are dealt to blocks as queries, once each, and only codes go to
every block of their label. What a block finds are the lists in which a vector has candidates; vectors that have any go there, and to
their own list, where they are compared by exact cosine in double precision.

Equal vectors of a label are one entry with a count. Lists are cut into blocks of stored vectors and of queries, and a block
returns counts and a spanning forest of its links, not all pairs.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label, link with
nothing; so do vectors of different widths; a null id is returned with its own (null) component and is no partner; repeated
ids link like different rows with one name; labels of any type are compared as they are; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .jaccard import Forest
from .runtime import hits, table, tidy

#: Bounds of the queries of a block of codes (a 64th of all) and of a side of an exact block (a 32nd of its rows).
QUERY_ROWS, EXACT_ROWS = (1024, 262_144), (64, 32_768)
#: Entries whose codes make one row, entries of a block that are met at a time, and cells of a distance matrix.
CHUNK, BUFFER, CELLS = 128, 262_144, 1 << 22
#: Slack of single precision in products of unit vectors.
SLACK = 1e-5


@dataclass
class Codebooks:
    coarse: np.ndarray  # lists x width
    fine: list[list[np.ndarray]]  # by round, by subspace: codes x sub-width
    cuts: list[slice]

    def __post_init__(self):
        self.along = self.coarse / np.maximum(np.linalg.norm(self.coarse, axis=1), 1e-30)[:, None]
        self.record = np.dtype([("rep", "<i8"), ("list", "<u2" if len(self.coarse) <= 1 << 16 else "<i4"), ("error", "<f4"), ("along", "<f4"), ("codes", "u1", (len(self.fine) * len(self.cuts),))])

    def own(self, u: np.ndarray) -> np.ndarray:
        """Own list of each unit vector."""
        return ((self.coarse**2).sum(1) - 2 * u @ self.coarse.T).argmin(1)

    def encode(self, u: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, round by round, and the distance of each vector to its reconstruction."""
        rest, codes = u - self.coarse[own], []
        for books in self.fine:
            for cut, book in zip(self.cuts, books, strict=True):
                codes.append(_nearest(rest[:, cut], book))
                rest[:, cut] -= book[codes[-1]]
        return np.stack(codes, 1).astype(np.uint8), np.linalg.norm(rest, axis=1)

    def decode(self, of: int, codes: np.ndarray) -> np.ndarray:
        """Reconstructions of entries of list ``of``."""
        x = np.repeat(self.coarse[of][None], len(codes), 0)
        for m, (cut, book) in enumerate((c, b) for books in self.fine for c, b in zip(self.cuts, books, strict=True)):
            x[:, cut] += book[codes[:, m]]
        return x

    def records(self, reps: np.ndarray, u: np.ndarray) -> np.ndarray:
        """What the index holds of each unit vector."""
        out = np.zeros(len(u), self.record)
        own = self.own(u)
        codes, error = self.encode(u, own)
        for name, x in (("rep", reps), ("list", own), ("codes", codes), ("error", error), ("along", (u * self.along[own]).sum(1))):
            out[name] = x
        return out


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(1) - 2 * x @ book.T).argmin(1)


class Queries:
    """A block's unit vectors, which meet codes."""

    def __init__(self, reps: np.ndarray, u: np.ndarray, own: np.ndarray, books: Codebooks, r: float):
        self.reps, self.u, self.own, self.books, self.r = reps, u, own, books, r
        self.norms, self.coarse = (books.coarse**2).sum(1), books.coarse.astype(np.float32)
        self.at_own = np.einsum("ij,ij->i", u, self.coarse[self.own])
        apart = self.norms[:, None] + self.norms - 2 * books.coarse @ books.coarse.T
        self.apart = np.sqrt(np.maximum(apart, 0)).astype(np.float32)
        self.found: list[tuple[np.ndarray, int]] = []

    def meet(self, records: np.ndarray) -> None:
        """Note the lists in which a query has a candidate other than itself."""
        records = records[np.lexsort((records["along"], records["list"]))]
        cuts = [0, *(np.flatnonzero(np.diff(records["list"].astype(np.int64))) + 1).tolist(), len(records)]
        of = records["list"][cuts[:-1]].astype(np.int64)
        for lo in range(0, len(of), 16):
            some = of[lo : lo + 16]
            dots = self.u @ self.coarse[some].T
            gap = (self.norms[some] - self.norms[self.own][:, None]).astype(np.float32) - 2 * (dots - self.at_own[:, None])
            near = gap <= 2 * self.r * self.apart[self.own[:, None], some] + SLACK
            for k, one in enumerate(some.tolist()):
                at = np.flatnonzero(near[:, k])
                place = dots[at, k] / max(np.sqrt(self.norms[one]), 1e-30)
                for a in range(cuts[lo + k], cuts[lo + k + 1], 256):
                    part = records[a : min(a + 256, cuts[lo + k + 1])]
                    reach = self.r + SLACK
                    self._meet(at[(place >= part["along"][0] - reach) & (place <= part["along"][-1] + reach)], one, part)

    def _meet(self, at: np.ndarray, of: int, part: np.ndarray) -> None:
        x = self.books.decode(of, part["codes"])
        least = ((1 + (x * x).sum(1) - (self.r + part["error"].astype(np.float64) + SLACK) ** 2) / 2 - SLACK).astype(np.float32)
        x = x.astype(np.float32).T
        for lo in range(0, len(at), step := max(1, CELLS // len(part))):
            q = at[lo : lo + step]
            hit = self.u[q] @ x >= least
            n = np.count_nonzero(hit, axis=1)
            alone = np.flatnonzero(n == 1)
            n[alone[part["rep"][hit[alone].argmax(1)] == self.reps[q[alone]]]] = 0  # only itself
            if n.any():
                self.found.append((q[n > 0], of))

    def wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries (by position) and the lists where they have candidates, each once."""
        q = np.concatenate([np.zeros(0, np.int64), *(a for a, _ in self.found)])
        of = np.concatenate([np.zeros(0, np.int64), *(np.full(len(a), k) for a, k in self.found)])
        both = np.unique(q * len(self.coarse) + of)
        return both // len(self.coarse), both % len(self.coarse)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return centres


def fit(u: np.ndarray, lists: int, subspaces: int, codes: int, rounds: int = 8) -> Codebooks:
    rng = np.random.default_rng(7)
    coarse = _kmeans(u, lists, rounds, rng)
    rest = u - coarse[_nearest(u, coarse)]
    edges = np.linspace(0, u.shape[1], min(subspaces, u.shape[1]) + 1).astype(int)
    cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    fine = []
    for _ in range(2):
        fine.append([_kmeans(rest[:, c], codes, rounds, rng) for c in cuts])
        for c, book in zip(cuts, fine[-1], strict=True):
            rest[:, c] -= book[_nearest(rest[:, c], book)]
    return Codebooks(coarse, fine, cuts)


def parsed(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """vec_id, label (its 64-bit hash, whatever its type), width and vec (bytes of floats as they are, of others as doubles) of the rows that may link."""
    single = dict(vectors.dtypes)[vec_col] == "array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, v in enumerate(batch.column(2)):
                x = None if not v.is_valid or v.values.null_count else np.asarray(v.values, np.float32 if single else np.float64)
                if x is not None and len(x) and np.isfinite(x).all() and (x != 0).any():
                    keep.append(i)
                    out.append((len(x), x.tobytes()))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([n for n, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["vec_id", "label", "width", "vec"])

    kind, label = dict(vectors.dtypes)[label_col], F.col(f"`{label_col}`")
    label = label + F.lit(0.0) if kind in ("float", "double") else label  # both zeros are one label
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.when(label.isNotNull(), F.xxhash64(label)).alias("label"), F.col(f"`{vec_col}`").cast(f"array<{'float' if single else 'double'}>").alias("v"))
    return v.filter("vec_id is not null and label is not null").mapInArrow(tidy(run), "vec_id long, label long, width int, vec binary")


def _matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """Rows of doubles; a blob has four or eight bytes for each of ``width`` components."""
    return np.frombuffer(b"".join(blobs), f"<f{len(blobs[0]) // width}").reshape(len(blobs), width).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, which changes no digit, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], Iterator[pa.RecordBatch]]]:
    """Runs of equal keys (the first columns) of sorted batches, with their parts in order; each must be read to its end."""

    def parts() -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
        for batch in batches:
            k = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(keys)], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            yield from ((tuple(k[a].tolist()), batch.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b)

    for key, group in groupby(parts(), key=lambda p: p[0]):
        yield key, (part for _, part in group)


PROBES = "label long, list int, role int, rep long, copies long, vec binary"


def probes(entries: DataFrame, sizes: DataFrame, books: Codebooks, threshold: float, width: int) -> DataFrame:
    """Entries that have candidates: in their own list (role 0), and as queries (role 1) in each list that holds one. entries: label, rep, copies, vec. sizes: label, n."""
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-7
    shared = entries.sparkSession.sparkContext.broadcast(books)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries as they are (role 0) and rows of codes of one label (role 1)."""
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.slice(lo, 2048)
                n, (label, rep) = len(part), (np.asarray(part.column(i)) for i in (0, 1))
                records = shared.value.records(rep, _unit(_matrix(part.column(3).to_pylist(), width)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.zeros(n, np.int32)), *part.columns[1:], pa.array(records["list"].astype(np.int32))], ["label", "role", "rep", "copies", "vec", "list"])
                order = np.argsort(label, kind="stable")
                ends = np.flatnonzero(np.append(np.diff(label[order]) != 0, True)) + 1
                cuts = [(i, min(i + CHUNK, b)) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) for i in range(a, b, CHUNK)]
                none = pa.nulls(len(cuts), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([int(label[order[a]]) for a, _ in cuts], pa.int64()), pa.array(np.ones(len(cuts), np.int32)), none, none, pa.array([records[order[a:b]].tobytes() for a, b in cuts], pa.binary()), pa.nulls(len(cuts), pa.int32())], ["label", "role", "rep", "copies", "vec", "list"])

    total = sizes.agg(F.sum("n")).first()[0] or 0
    each = min(max(total // 64, QUERY_ROWS[0]), QUERY_ROWS[1])
    large = [(x["label"], -(-x["n"] // each)) for x in sizes.filter(F.col("n") > each).collect()]  # 64 labels, or one for each full block
    blocks = F.broadcast(entries.sparkSession.createDataFrame(large, "label long, blocks int"))
    rows = entries.select("label", "rep", "copies", "vec").mapInArrow(tidy(index), "label long, role int, rep long, copies long, vec binary, list int")
    rows = rows.join(blocks, "label", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("rep"), "blocks").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("label", F.explode(block).alias("block"), "role", "rep", "copies", "vec", "list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (label, _), parts in _groups(batches, 2):
            held, u, queries, codes, n = [], [], None, [], 0
            for part in parts:
                role = np.asarray(part.column(2))
                if first := int((role == 0).sum()):
                    held.append(part.slice(0, first).select([3, 4, 5, 6]))
                    u += [_unit(_matrix(held[-1].column(2).slice(i, 4096).to_pylist(), width)).astype(np.float32) for i in range(0, first, 4096)]
                if first < len(role) and held:
                    if queries is None:
                        t = pa.Table.from_batches(held)
                        queries, u = Queries(t.column(0).to_numpy(), np.concatenate(u), t.column(3).to_numpy(), shared.value, r), []
                    codes += [np.frombuffer(b, shared.value.record) for b in part.column(5).slice(first).to_pylist()]
                    n += sum(map(len, codes[-(len(role) - first) :]))
                    if n >= BUFFER:
                        queries.meet(np.concatenate(codes))
                        codes, n = [], 0
            if queries is None:
                continue
            if codes:
                queries.meet(np.concatenate(codes))
            q, of = queries.wanted()
            for role, at, lists in ((0, np.unique(q), queries.own[np.unique(q)]), (1, q, of)):
                for lo in range(0, len(at), 4096):
                    some, k = [c.combine_chunks() for c in t.take(pa.array(at[lo : lo + 4096])).columns[:3]], len(at[lo : lo + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, label, np.int64)), pa.array(lists[lo : lo + 4096].astype(np.int32)), pa.array(np.full(k, role, np.int32)), *some], ["label", "list", "role", "rep", "copies", "vec"])

    parts = max(1, -(-total // each) + len(large))
    return rows.repartition(parts, "label", "block").sortWithinPartitions("label", "block", "role").mapInArrow(tidy(run), PROBES)


def links(rows: DataFrame, threshold: float, width: int) -> DataFrame:
    """rep, n (copies linked, itself excluded), a, b (a spanning forest's link) from every block of one width. rows: the written probes."""
    each = min(max(rows.count() // 32, EXACT_ROWS[0]), EXACT_ROWS[1])
    sizes = rows.groupBy("label", "list").agg(F.ceil(F.sum(1 - F.col("role")) / each).cast("int").alias("ms"), F.ceil(F.sum("role") / each).cast("int").alias("qs"))
    rows = rows.join(sizes.filter("ms > 0 and qs > 0"), ["label", "list"])
    mine, other = F.when(F.col("role") == 0, F.col("ms")).otherwise(F.col("qs")), F.when(F.col("role") == 0, F.col("qs")).otherwise(F.col("ms"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), mine).cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(0), other - 1)))
    block = F.when(F.col("role") == 0, F.col("salt") * F.col("qs") + F.col("copy")).otherwise(F.col("copy") * F.col("qs") + F.col("salt"))
    rows = rows.select("label", "list", block.cast("int").alias("block"), "role", "rep", "copies", "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches, 3):
            t = pa.Table.from_batches(list(parts))
            role, rep, copies = (t.column(i).to_numpy() for i in (3, 4, 5))
            s, q = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            if not len(s) or not len(q):
                continue
            vec = t.column(6)
            x = _scaled(_matrix(vec.take(pa.array(s)).to_pylist(), width))
            n_x = np.sqrt((x * x).sum(1))
            u_x, held, tree, forest, counts = (x / n_x[:, None]).T, copies[s].astype(np.float64), np.arange(len(s)), Forest(), []
            by_rep = np.argsort(rep[s], kind="stable")
            for lo in range(0, len(q), step := max(1, CELLS // len(s))):
                part = q[lo : lo + step]
                y = _scaled(_matrix(vec.take(pa.array(part)).to_pylist(), width))
                n_y = np.sqrt((y * y).sum(1))
                cos = (y / n_y[:, None]) @ u_x
                ok = cos >= threshold
                a, b = np.nonzero(np.abs(cos - threshold) <= 1e-9)
                ok[a, b] = np.einsum("ij,ij->i", y[a], x[b]) / (n_y[a] * n_x[b]) >= threshold
                same = [np.searchsorted(rep[s][by_rep], rep[part], side) for side in ("left", "right")]
                for i in np.flatnonzero(same[1] > same[0]):
                    ok[i, by_rep[same[0][i] : same[1][i]]] = False
                n = ok @ held
                counts.append((rep[part], n.astype(np.int64)))
                for i in np.flatnonzero(n):
                    at = np.flatnonzero(ok[i])
                    trees = tree[at]
                    if (trees == trees[0]).all():
                        forest.union(int(rep[part[i]]), int(rep[s[at[0]]]))
                        continue
                    trees, first = np.unique(trees, return_index=True)
                    for j in at[first]:
                        forest.union(int(rep[part[i]]), int(rep[s[j]]))
                    tree[np.isin(tree, trees)] = trees[0]
            ids, n = (np.concatenate(c) for c in zip(*counts, strict=True))
            e = np.array(forest.edges, np.int64).reshape(-1, 2)
            ids, n = ids[n > 0], n[n > 0]
            none = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), none(len(ids)), none(len(ids))], ["rep", "n", "a", "b"])
            yield pa.RecordBatch.from_arrays([none(len(e)), none(len(e)), pa.array(e[:, 0]), pa.array(e[:, 1])], ["rep", "n", "a", "b"])

    return rows.repartitionByRange("label", "list", "block").sortWithinPartitions("label", "list", "block").mapInArrow(tidy(run), "rep long, n long, a long, b long")


KEY = ["label", "width", "key"]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, sample: int = 20_000, per_list: int = 200, max_lists: int = 1024, subspaces: int = 8, codes: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. ``sample`` bounds the vectors that the codebooks are fitted on."""
    valid = table(parsed(vectors, id_col, vec_col, label_col).withColumn("key", F.expr("substring(unhex(sha2(vec, 256)), 1, 16)")), "pq-vectors")
    grouped = valid.groupBy(*KEY).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    equal = table(grouped.filter("copies > 1"), "pq-equal")
    n_equal = equal.count()
    entries = valid.select(*KEY, F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("copies"), "vec")
    named = valid.select("vec_id", F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("copies"))
    if n_equal:  # the others, nearly all, keep their vectors out of a shuffle
        once, more = (hits(valid, equal, KEY, n_equal, keep) for keep in (False, True))
        merged = table(more.groupBy(*KEY).agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("vec").alias("vec")), "pq-merged")
        entries = once.select(*KEY, F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("copies"), "vec").unionByName(merged)
        ids = valid.select("vec_id", *KEY)
        named = ids.join(equal, KEY, "left").select("vec_id", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    sizes = valid.groupBy("label", "width").agg(F.count("*").alias("n")).unionAll(equal.groupBy("label", "width").agg(F.sum(1 - F.col("copies")).alias("n")))
    sizes = table(sizes.groupBy("label", "width").agg(F.sum("n").alias("n")), "pq-sizes")  # of entries
    found = None
    for width, n in sizes.groupBy("width").agg(F.sum("n")).collect():
        mine = entries.filter(F.col("width") == width)
        picked = mine.select("rep", "vec").orderBy(F.xxhash64("rep", "vec")).limit(sample).collect()
        books = fit(_unit(_matrix([bytes(p["vec"]) for p in picked], width)), int(min(max_lists, max(1, n // per_list))), subspaces, codes)
        part = links(table(probes(mine, sizes.filter(F.col("width") == width), books, threshold, width), "pq-probes"), threshold, width)
        found = part if found is None else found.unionAll(part)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = table(found, "pq-links")
    n = found.filter("rep is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    comp = connected_components(found.filter("a is not null").select("a", "b")).withColumnRenamed("node", "rep")
    linked = named.join(n, "rep", "left").join(comp, "rep", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
