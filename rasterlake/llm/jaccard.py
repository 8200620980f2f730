"""N-gram Jaccard join over a token-group matrix.

Every document is the set of its distinct k-word shingles. Similar documents are partitioned into groups by the most
frequent of the four least hashes of their set. The matrix stores each group's token union, in blocks by token; a query document
opens only the groups whose union holds enough of its tokens, and is compared exactly there.

Steps, each exact, so that no link is lost:

1.  Documents with equal sets are one class, compared once.
2.  A token bound against the union of the whole corpus: a document that shares fewer than the threshold's share of its
    tokens with any other has no partner. Tokens travel as 32 bits, which can only raise the bound.
    That count also bounds every pair: the overlap of two documents is at most the lesser of their counts.
3.  The rarest ``n - ceil(threshold * n) + 1`` tokens of a partner must meet the query's own: these of each member index the
    matrix, so that a query meets only groups that share one of them. Rarity comes from bucket counts over all
    remaining documents, a table of fixed size. Of two groups that meet at a token, the one with more members there is asked
    by the members of the other.
4.  A query's overlap with the token union of each group that it meets is counted, block by block of the union, and summed. It bounds the overlap with
    any member: the group is opened only if it reaches the threshold's share of the query's tokens.
5.  Inside an opened group members that link with the group's hub need no comparison with each other. All others are compared
    through the group's postings. Large groups are split into blocks of members and of queries. Each block returns a spanning
    forest of its links, not all pairs.

Edge cases: null and empty texts, and texts without words, have an empty set and link with nothing; fewer than k words are one
shingle; a null id is returned with the component of its copies, or null; repeated rows are linked by their id, also where their
texts differ; a very long text is one set, in memory that grows with it; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .components import connected_components
from .runtime import bitmap, bitmap_position, hits, in_bitmap, sum_arrays, table, tidy

#: Tokens that one task sorts at once.
TOKENS_PER_TASK = 4_000_000
#: Documents whose counts one task adds.
DOCS_PER_TASK = 500_000
#: Tokens of the members and of the queries of one block of a group.
MEMBER_TOKENS, QUERY_TOKENS = 2_000_000, 1_000_000
#: Pairs of (query, group) that one step of the matrix forms in memory.
PAIRS_AT_ONCE = 2_000_000
BUCKETS, BLOCK = 1 << 20, 1 << 14
#: Most classes of copies that are broadcast.
LARGE = 100_000


def need(n, percent: int):
    """Least overlap of a set of n tokens with a partner."""
    return -(-percent * n // 100)


def digest(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two sums of differently mixed tokens for each set."""
    sums = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        total = np.concatenate([[np.uint64(0)], np.cumsum(T.mix(h ^ np.uint64(salt)))])
        sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return sums


def digests(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size) and a 128-bit digest of the set, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = T.text_column(batch.column(1))
            for lo, hi in T.slices(texts):
                h, bounds = T.shingle_sets(T.words(texts.slice(lo, hi - lo), lower=True), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), *map(pa.array, digest(h, bounds))], ["doc_id", "n", "d1", "d2"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, d1 long, d2 long")


def shared_counts(docs: DataFrame, k: int, parts: int, buckets: int) -> DataFrame:
    """doc_id and the number of its tokens that another row holds too (rows with none are left out).

    Each token goes to one of ``parts`` tasks by its upper 32 bits and is counted there by its lower 32 bits; counts
    go packed to ``buckets`` tasks by document, to be added.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = T.text_column(batch.column(1)), np.asarray(batch.column(0))
            for lo, hi in T.slices(texts):
                h, bounds = T.shingle_sets(T.words(texts.slice(lo, hi - lo), lower=True), k)
                doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
                part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                order = np.argsort(part, kind="stable")
                h, doc, part = h[order].astype(np.uint32), doc[order], part[order]
                at = np.searchsorted(part, np.arange(parts + 1))
                rows = {"part": [], "ids": [], "counts": [], "tokens": []}
                for p in np.flatnonzero(np.diff(at)):
                    of, count = np.unique(doc[at[p] : at[p + 1]], return_counts=True)
                    for c, v in zip(rows, (int(p), ids[lo:hi][of].tobytes(), count.astype(np.uint32).tobytes(), h[at[p] : at[p + 1]].tobytes()), strict=True):
                        rows[c].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if c == "part" else pa.binary()) for c, v in rows.items()], list(rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for p, ids, counts, tokens in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.setdefault(p, []).append((ids, counts, tokens))
        while held:
            rows = held.popitem()[1]
            ids, counts, tokens = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate((np.int64, np.uint32, np.uint32)))
            del rows
            order = np.argsort(tokens, kind="stable")
            s = tokens[order]
            twice = np.zeros(len(s), bool)
            twice[1:] = s[1:] == s[:-1]
            twice[:-1] |= twice[1:]
            shared = np.empty(len(s), np.int64)
            shared[order] = twice
            n = np.add.reduceat(shared, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64))
            ids, n = ids[n > 0], n[n > 0]
            of = (T.mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(of, kind="stable")
            at = np.searchsorted(of[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(at))
            cols = [[x[order[at[b] : at[b + 1]]].tobytes() for b in some] for x in (ids, n)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["bucket", "ids", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for b, *row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.setdefault(b, []).append(row)
        for rows in held.values():
            ids, n = (np.concatenate([np.frombuffer(r[i], np.int64) for r in rows]) for i in range(2))
            one, of = np.unique(ids, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(np.bincount(of, n).astype(np.int64))], ["doc_id", "s"])

    sent = docs.filter("doc_id is not null").mapInArrow(tidy(send), "part int, ids binary, counts binary, tokens binary")
    counted = sent.repartition(parts, "part").mapInArrow(tidy(count), "bucket int, ids binary, n binary")
    return counted.repartition(buckets, "bucket").mapInArrow(tidy(add), "doc_id long, s long")


def token_sets(docs: DataFrame, wanted: DataFrame, k: int, bits: int) -> DataFrame:
    """doc_id (the node of the text's class), n, tokens (sorted 64-bit values) and s of the wanted (doc_id, n, d1, d2, node, s)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap(wanted, "doc_id", bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(shared, np.asarray(batch.column(2)))
            if not hit.any():
                continue
            batch = batch.filter(pa.array(hit))
            texts = T.text_column(batch.column(1))
            for lo, hi in T.slices(texts):
                h, bounds = T.shingle_sets(T.words(texts.slice(lo, hi - lo), lower=True), k)
                some = np.flatnonzero(np.diff(bounds))
                arr = [h[bounds[i] : bounds[i + 1]] for i in some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(some)), pa.array(np.array([len(a) for a in arr], np.int64)), *(pa.array(x[some]) for x in digest(h, bounds)), pa.array([a.tobytes() for a in arr], pa.binary())],
                    ["doc_id", "n", "d1", "d2", "tokens"],
                )

    found = docs.filter("doc_id is not null").select("doc_id", "t", bitmap_position("doc_id", bits).alias("p")).mapInArrow(tidy(run), "doc_id long, n long, d1 long, d2 long, tokens binary")
    return found.join(wanted, ["doc_id", "n", "d1", "d2"]).select(F.col("node").alias("doc_id"), "n", "tokens", "s")


def bucket_counts(sets: DataFrame) -> np.ndarray:
    """Number of sets by bucket of token: a table of fixed size that orders tokens from rare to frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_buffer(), np.uint64) >> np.uint64(44), minlength=BUCKETS).astype(np.int32)
        keys = range(BUCKETS // BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([TaskContext.get().partitionId()] * len(keys), pa.int32()), pa.array([total[i * BLOCK : (i + 1) * BLOCK].astype(np.int64).tobytes() for i in keys], pa.binary())], ["key", "salt", "vec"])

    got = sum_arrays(sets.select("tokens").mapInArrow(tidy(run), "key int, salt int, vec binary"), "int64")
    return np.concatenate([got.get(i, np.zeros(BLOCK, np.int64)) for i in range(BUCKETS // BLOCK)])


def grouped(sets: DataFrame, level) -> DataFrame:
    """Adds grp, the most frequent (by level) of the four least tokens: edited copies of one text mostly agree on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(len(batch), np.uint64)
            for i, b in enumerate(batch.column(2)):
                h = np.frombuffer(b.as_buffer(), np.uint64)[:4]
                out[i] = h[np.argmax(level.value[h >> np.uint64(44)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], ["doc_id", "n", "tokens", "s", "grp"])

    return sets.select("doc_id", "n", "tokens", "s").mapInArrow(tidy(run), "doc_id long, n long, tokens binary, s long, grp long")


def openings(sets: DataFrame, shared, percent: int, parts: int) -> DataFrame:
    """doc_id, grp of the other groups that each document has to open, by the token-group matrix."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grp, n, s = (np.asarray(batch.column(i)) for i in range(4))
            tokens, rows = [], []
            for i, b in enumerate(batch.column(4)):
                h = np.frombuffer(b.as_buffer(), np.uint64)
                order = np.lexsort((h, shared.value[h >> np.uint64(44)]))
                h = h[order[: int(n[i] - need(n[i], percent) + 1)]]
                tokens.append(h)
                rows.append(np.full(len(h), i))
            if not tokens:
                continue
            h, of = np.concatenate(tokens), np.concatenate(rows)
            part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            h, of, part = h[order], of[order], part[order]
            at = np.searchsorted(part, np.arange(parts + 1))
            some = np.flatnonzero(np.diff(at))
            cols = [[np.ascontiguousarray(x[at[p] : at[p + 1]]).tobytes() for p in some] for x in (h, ids[of], grp[of], n[of], s[of])]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["part", "h", "ids", "grp", "n", "s"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for p, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                held.setdefault(p, []).append(row)
        for rows in held.values():
            h, ids, grp, n, s = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate((np.uint64, np.int64, np.int64, np.int64, np.int64)))
            order = np.lexsort((n, grp, h))
            h, ids, grp, n, s = h[order], ids[order], grp[order], n[order], s[order]
            # the matrix: runs of (token, group), with the sizes of the members that hold the token
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (grp[1:] != grp[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(h)) - 1
            held_by, most = last - first + 1, np.maximum.reduceat(s, first)
            own = np.cumsum(new) - 1  # the run of each row
            token_of = np.cumsum(np.append(True, h[first][1:] != h[first][:-1])) - 1
            lo, hi = np.searchsorted(token_of, np.arange(token_of[-1] + 1)), np.searchsorted(token_of, np.arange(token_of[-1] + 1), "right")
            t = token_of[own]
            rows_at = np.flatnonzero(hi[t] - lo[t] > 1)
            out = np.zeros((0, 2), np.int64)
            size = (hi - lo)[t[rows_at]]
            cuts = np.unique([0, *np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), PAIRS_AT_ONCE)), len(size)])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                r, c = rows_at[a:b], size[a:b]
                q = np.repeat(r, c)
                g = np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[t[r]], c)
                larger = (held_by[g] > held_by[own[q]]) | ((held_by[g] == held_by[own[q]]) & (grp[first[g]] > grp[q]))
                over = np.minimum(s[q], most[g])
                fits = larger & (100 * over >= percent * (n[q] + n[first[g]] - over)) & (100 * n[last[g]] >= percent * n[q]) & (percent * n[first[g]] <= 100 * n[q])
                out = np.unique(np.concatenate([out, np.stack([ids[q[fits]], grp[first[g[fits]]]], 1)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["doc_id", "grp"])

    sent = sets.select("doc_id", "grp", "n", "s", "tokens").mapInArrow(tidy(send), "part int, h binary, ids binary, grp binary, n binary, s binary")
    return sent.repartition(parts, "part").mapInArrow(tidy(match), "doc_id long, grp long").distinct()


def qualified(sets: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """The (doc_id, grp) of met whose group's token union holds enough of the document's tokens."""
    asked = met.join(sets.select("doc_id", "n"), "doc_id").groupBy("grp").agg(F.sum("n").alias("q_tokens"))
    groups = sets.groupBy("grp").agg(F.sum("n").alias("m_tokens")).join(asked, "grp")
    groups = table(groups.select("grp", F.ceil(F.col("m_tokens") / MEMBER_TOKENS).cast("int").alias("ps"), F.ceil(F.col("q_tokens") / QUERY_TOKENS).cast("int").alias("qs")), "jaccard-unions")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens by block of the union; members to every run of queries, a query to its own."""
        for batch in batches:
            for grp, ps, qs, asks, doc, n, blob in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                h = np.frombuffer(blob, np.uint64)
                part = (h >> np.uint64(20)) % np.uint64(ps)
                to = [int(T.mix(np.array([doc]).view(np.uint64))[0] % np.uint64(qs))] if asks else range(qs)
                rows = [(grp, p, q, asks, doc, n, x) for p in range(ps) for x in [h[part == p].tobytes()] for q in to]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["grp", "p", "q", "asks", "doc_id", "n", "tokens"])

    cols = ("grp", "ps", "qs", "asks", "doc_id", "n", "tokens")
    members = sets.join(groups, "grp").withColumn("asks", F.lit(0)).select(*cols)
    queries = met.join(groups, "grp").join(sets.select("doc_id", "n", "tokens"), "doc_id").withColumn("asks", F.lit(1)).select(*cols)
    dealt = members.unionAll(queries).mapInArrow(tidy(deal), "grp long, p int, q int, asks int, doc_id long, n long, tokens binary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, union, held = None, np.zeros(0, np.uint64), []
        for batch in batches:
            out = []
            for grp, p, q, asks, doc, n, blob in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (grp, p, q) != key:
                    key, union, held = (grp, p, q), np.zeros(0, np.uint64), []
                h = np.frombuffer(blob, np.uint64)
                if not asks:
                    held.append(h)
                    continue
                if held:  # members come first
                    union, held = np.unique(np.concatenate(held)), []
                at = np.minimum(np.searchsorted(union, h), max(len(union) - 1, 0))
                out.append((doc, grp, n, int((union[at] == h).sum()) if len(union) else 0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "grp", "n", "over"])

    counted = dealt.repartition("grp", "p", "q").sortWithinPartitions("grp", "p", "q", "asks").mapInArrow(tidy(count), "doc_id long, grp long, n long, over long")
    return counted.groupBy("doc_id", "grp").agg(F.max("n").alias("n"), F.sum("over").alias("over")).filter(100 * F.col("over") >= percent * F.col("n")).select("doc_id", "grp")


class Forest:
    """Union-find over longs that keeps the unions that joined two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        p = self.parent
        while (y := p.setdefault(x, x)) != x:
            p[x] = p[y] if y in p else y
            x = p[x]
        return x

    def union(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))


HUB, MEMBER, OWN, CROSS = range(4)


def compare(kind: np.ndarray, ids: np.ndarray, n: np.ndarray, s: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one block: queries (own and other) against members, and both against the hub."""
    hub = sets[int(np.flatnonzero(kind == HUB)[0])]
    hub_id = int(ids[kind == HUB][0])
    at = np.flatnonzero(kind == MEMBER)
    forest = Forest()

    def linked(over, n1, n2):
        return 100 * over >= percent * (n1 + n2 - over)

    size = np.array([len(sets[i]) for i in at], np.int64)
    tokens = np.concatenate([sets[i] for i in at]) if len(at) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(at)), size)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]

    def overlap(q: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(tokens, q, "left"), np.searchsorted(tokens, q, "right")
        c = b - a
        some = c > 0
        a, c = a[some], c[some]
        pos = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(a, c)
        return np.bincount(owner[pos], minlength=len(at))

    settled = linked(overlap(hub), size, len(hub)) if len(at) else np.zeros(0, bool)
    for i in at[settled]:
        forest.union(int(ids[i]), hub_id)
    queries = np.concatenate([np.flatnonzero((kind == OWN) | (kind == CROSS)), at[~settled] if not (kind == OWN).any() else at[:0]])
    for i in queries:
        q, mine = sets[i], int(ids[i])
        if kind[i] != CROSS:
            over = len(np.intersect1d(q, hub, assume_unique=True)) if kind[i] == OWN else 0
            if kind[i] == OWN and linked(over, len(q), len(hub)):
                forest.union(mine, hub_id)
                continue
        bound = np.minimum(s[i], s[at])
        if not linked(bound, len(q), size).any():
            continue
        for j in at[linked(overlap(q), size, len(q))]:
            if ids[j] != mine:
                forest.union(mine, int(ids[j]))
    return forest.edges


def verify(sets: DataFrame, opened: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), as spanning forests, of documents with the members of their own group and of the groups they open."""
    groups = sets.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("m_tokens"), F.max(F.struct(F.col("s") / F.col("n"), -F.col("doc_id"))).alias("h"))
    asked = opened.join(sets.select("doc_id", "n"), "doc_id").groupBy("grp").agg(F.count("*").alias("asking"), F.sum("n").alias("q_tokens"))
    groups = groups.join(asked, "grp", "left").fillna(0, ["asking", "q_tokens"]).filter("members > 1 or asking > 0")
    ms = F.ceil(F.col("m_tokens") / MEMBER_TOKENS).cast("int")
    qs = F.when(ms == 1, F.ceil((F.col("q_tokens") + 1) / QUERY_TOKENS)).otherwise(F.ceil((F.col("q_tokens") + F.col("m_tokens")) / QUERY_TOKENS)).cast("int")
    qs = F.when((ms == 1) & (F.col("m_tokens") > QUERY_TOKENS), F.ceil((F.col("q_tokens") + F.col("m_tokens")) / QUERY_TOKENS).cast("int")).otherwise(qs)
    groups = table(groups.select("grp", (-F.col("h")["col2"]).alias("hub"), ms.alias("ms"), qs.alias("qs")), "jaccard-groups")
    salt = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = sets.join(groups, "grp")
    cols = ("grp", "mi", "qi", "kind", "doc_id", "n", "s", "tokens")
    hubs = own.filter("doc_id = hub").withColumn("mi", every("ms")).withColumn("qi", every("qs")).withColumn("kind", F.lit(HUB))
    members = own.withColumn("mi", salt("ms")).withColumn("qi", every("qs")).withColumn("kind", F.lit(MEMBER))
    queries = own.filter("ms > 1 or qs > 1").withColumn("qi", salt("qs")).withColumn("mi", every("ms")).withColumn("kind", F.lit(OWN))
    cross = opened.join(groups, "grp").join(sets.drop("grp"), "doc_id").withColumn("qi", salt("qs")).withColumn("mi", every("ms")).withColumn("kind", F.lit(CROSS))
    rows = hubs.select(*cols)
    for x in (members, queries, cross):
        rows = rows.unionAll(x.select(*cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                kind, ids, n, s = (t.column(i).to_numpy() for i in (3, 4, 5, 6))
                sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in t.column(7)]
                e = np.array(compare(kind, ids, n, s, sets, percent), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

        for batch in batches:
            k = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if tuple(k[a]) != key:
                    yield from done()
                    key, held = tuple(k[a]), []
                held.append(batch.slice(a, b - a))
        yield from done()

    return rows.repartition("grp", "mi", "qi").sortWithinPartitions("grp", "mi", "qi").mapInArrow(tidy(run), "a long, b long")


def join(docs: DataFrame, percent: int = 75, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    d = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) t")
    base = table(digests(d, k), "jaccard-base")
    n_rows, total = base.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = shared_counts(d, k, max(least, -(-total // TOKENS_PER_TASK)), max(12, n_rows // DOCS_PER_TASK))
    key = ["n", "d1", "d2"]
    classes = base.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("rep is not null")
    # an id with several texts: every class after its first gets a node of its own, and all are linked
    several = base.filter("n > 0 and doc_id is not null").select("doc_id", *key).distinct().groupBy("doc_id").agg(F.count("*").alias("m"), F.min(F.struct(*key)).alias("first")).filter("m > 1").select("doc_id", "first")
    several = table(several, "jaccard-several")
    own = F.expr("9223372036854775807 - (xxhash64(n, d1, d2) & 2305843009213693951)")
    classes = classes.join(several.withColumnRenamed("doc_id", "rep"), "rep", "left").withColumn("node", F.when(F.col("first").isNull() | (F.col("first") == F.struct(*key)), F.col("rep")).otherwise(own)).drop("first")
    classes = table(classes, "jaccard-classes")
    same_id = base.join(several, "doc_id").join(classes, key).groupBy("doc_id").agg(F.collect_set("node").alias("nodes")).select(F.explode("nodes").alias("a"), F.array_min("nodes").alias("b"))
    alive = table(classes.select(F.col("rep").alias("doc_id"), *key, "node").join(shared, "doc_id").filter(f"100 * s >= {percent} * n").withColumn("s", F.least("s", "n")), "jaccard-alive")
    left, tokens = alive.agg(F.count("*"), F.sum("n")).first()
    if left:
        bits = 1 << min(27, max(20, (16 * left).bit_length()))
        sets = table(token_sets(d, alive, k, bits).dropDuplicates(["doc_id"]), "jaccard-sets")  # repeated rows
        level = spark.sparkContext.broadcast(np.minimum(255, np.ceil(4 * np.log2(1 + bucket_counts(sets)))).astype(np.uint8))
        sets = table(grouped(sets, level), "jaccard-groups")
        opened = table(openings(sets, level, percent, max(least, -(-tokens // TOKENS_PER_TASK))), "jaccard-opened")
        edges = verify(sets, table(qualified(sets, opened, percent), "jaccard-qualified"), percent).unionAll(same_id)
    else:
        edges = same_id
    found = connected_components(edges)
    named = classes.join(found, "node", "left").filter("copies > 1 or component is not null").select(*key, F.coalesce("component", "rep").alias("component_id"), "copies")
    named = table(named, "jaccard-named")
    # the classes with most copies, of which there can be no more than LARGE, are broadcast; no other key has many rows
    large = F.col("copies") > n_rows // LARGE
    part = base.filter("n > 0").join(F.broadcast(named.filter(large).drop("copies")), key, "left")
    cols = ("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    rest = part.filter("component_id is null").drop("component_id").join(named.filter(~large).drop("copies"), key, "left")
    return base.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")).unionAll(part.filter("component_id is not null").select(*cols)).unionAll(rest.select(*cols))


def representatives(docs: DataFrame, percent: int = 75, k: int = 5) -> DataFrame:
    """The rows of docs (doc_id, text, ...) whose id is the least of their component, with all their columns."""
    gone = table(join(docs, percent, k).filter("doc_id <> component_id").select("doc_id").distinct(), "jaccard-gone")
    n = gone.count()
    return hits(docs, gone, ["doc_id"], n, False).unionAll(hits(docs, gone, ["doc_id"], n, True).join(gone, "doc_id", "left_anti").select(*docs.columns))
