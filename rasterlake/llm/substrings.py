"""Substring deduplication with suffix automata of reference shards.

A window is ``span`` consecutive words of one document. Every word covered by a window that also starts in a document with a
smaller id goes. The reference is the corpus itself, so its shards are chosen by content and meet only the documents that can
match them:

1.  Every window has one leading anchor, its least hashed ``gram``-word shingle. Equal windows have equal anchors, so an anchor
    seen in one document only rules its windows out. Anchors travel packed, to be counted by hash range.
2.  The words around each remaining anchor (all windows that it leads) go to the shard of that anchor. Words that no other
    document has there are trimmed. A shard streams its
    contexts in order of document id: the suffix automaton of all earlier documents' contexts yields matching statistics, and a
    match of ``span`` words or more marks the windows that it covers; then the context extends the automaton.
3.  Marked windows become maximal spans, joined back to the texts that have any.

Equal texts are merged first: the one with the least id stands for them, and of the others every word that a window covers goes.
Words in contexts are 32-bit hashes; two contexts only meet under the same 64-bit anchor. A shard's automaton is built and read
where its documents meet: all of them would have to be broadcast to compare a corpus with itself, which has no bound.

Edge cases: a null text has no words; a document shorter than the span loses nothing; windows repeated inside one document do
not count; rows with a null id lose nothing and are no reference; repeated rows (same id and text) are one document, and
different texts of one id are no reference for each other; a very long text is split into words in one go; other columns than
those carried are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .runtime import hits, table, tidy

ANCHORS_PER_TASK, CONTEXTS_PER_TASK = 2_000_000, 5_000
META = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("first", "<i4"), ("size", "<i4")])
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over x[i : i + size], for every i with a full window."""
    width = 1
    while 2 * width <= size:
        x = op(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def leaders(w: T.Words, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word of each window, and the word (the first of equals) and hash of its leading anchor."""
    n, z = len(w.ids), np.zeros(0, np.int64)
    if n < span:
        return z, z, z.astype(np.uint64)
    h, at = T.windows(w, gram)
    full = np.full(n, _NONE, np.uint64)
    full[at] = h
    doc, per = w.doc, span - gram + 1
    starts = np.flatnonzero(doc[: n - span + 1] == doc[span - 1 :])
    least = _sliding(full[: n - gram + 1], per, np.minimum)[starts]
    # the first position at or after each start with the least value: candidates are few, so they are searched by value
    chosen = np.zeros(n, bool)
    low = np.zeros(n, np.uint64)
    low[starts] = least
    padded = np.concatenate([np.zeros(per - 1, np.uint64), low])
    chosen[at] = _sliding(padded, per, np.maximum)[at] == full[at]
    picks = np.flatnonzero(chosen)
    k = np.searchsorted(picks, starts)
    while True:
        off = full[picks[k]] != least
        if not off.any():
            break
        k[off] += 1
    return starts, picks[k], least


def _pack(part: np.ndarray, parts: int, *cols: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(at))
    return some, [[np.ascontiguousarray(c[order[at[p] : at[p + 1]]]).tobytes() for p in some] for c in cols]


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def shared_anchors(docs: DataFrame, span: int, gram: int, parts: int) -> DataFrame:
    """doc_id, th and packed anchors that two documents or more hold."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, th = T.text_column(batch.column(1)), np.asarray(batch.column(0)), np.asarray(batch.column(2))
            for lo, hi in T.slices(texts):
                w = T.words(texts.slice(lo, hi - lo))
                _, at, h = leaders(w, span, gram)
                doc = w.doc[at]
                first = np.ones(len(at), bool)
                first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc = h[first], doc[first]
                some, cols = _pack(_part(h, parts), parts, h, ids[lo:hi][doc], th[lo:hi][doc])
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["part", "h", "doc", "th"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for p, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.setdefault(p, []).append(row)
        for rows in held.values():
            h, doc, th = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate((np.uint64, np.int64, np.int64)))
            order = np.lexsort((th, doc, h))
            h, doc, th = h[order], doc[order], th[order]
            same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (th[1:] == th[:-1])
            keep = np.append(True, ~same)
            h, doc, th = h[keep], doc[keep], th[keep]
            new = np.append(True, h[1:] != h[:-1])
            run = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(h)) - 1
            hits = np.flatnonzero((doc[first] != doc[last])[run])
            order = hits[np.lexsort((th[hits], doc[hits]))]
            if not len(order):
                continue
            d, t = doc[order], th[order]
            cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])))
            ends = np.append(cut[1:], len(order))
            h = h[order]
            yield pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(t[cut]), pa.array([h[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())], ["doc_id", "th", "anchors"])

    sent = docs.filter("doc_id is not null").select("doc_id", "t", "th").mapInArrow(tidy(send), "part int, h binary, doc binary, th binary")
    found = sent.repartition(parts, "part").mapInArrow(tidy(count), "doc_id long, th long, anchors binary")
    return found.groupBy("doc_id", "th").agg(F.collect_list("anchors").alias("anchors"))


class Automaton:
    """Suffix automaton of several strings of integers."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def extend(self, text: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in text:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matches(self, text: list[int]) -> list[int]:
        """Matching statistics: the longest suffix of text[: i + 1] that some string holds."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for c in text:
            while c not in nxt[state]:
                state = link[state]
                if state == -1:
                    break
                size = length[state]
            if state == -1:
                state = size = 0
            else:
                state = nxt[state][c]
                size += 1
            out.append(size)
        return out


def trim(meta: np.ndarray, codes: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows all of whose shingles another document has under the same anchor: context, first word, last start.

    meta: contexts, ordered by anchor; codes: their words in that order. Other windows cannot match, so they are not put into
    an automaton.
    """
    n = len(codes) - gram + 1
    if len(codes) < span:
        z = np.zeros(0, np.int64)
        return z, z, z
    ctx = np.repeat(np.arange(len(meta), dtype=np.int32), meta["size"] // 4)
    h = np.zeros(n, np.uint64)
    for i in range(gram):
        h *= np.uint64(0x9FB21C651E98DF25)
        h += codes[i : n + i]
    h ^= T.mix(meta["anchor"])[ctx[:n]]
    whole = ctx[:n] == ctx[gram - 1 :]
    order = np.argsort(h, kind="stable")
    order = order[whole[order]]
    new = np.append(True, np.diff(h[order]) != 0)
    del h, whole
    _, doc = np.unique(meta[["doc", "text"]], return_inverse=True)
    d = doc.astype(np.int32)[ctx[order]]
    first = np.flatnonzero(new)
    several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(first) else np.zeros(0, bool)
    flag = np.zeros(n, np.int8)
    flag[order] = np.repeat(several, np.diff(np.append(first, len(order))))
    del order, d, new
    ok = np.flatnonzero(_sliding(flag, span - gram + 1, np.minimum))
    if not len(ok):
        return ok, ok, ok
    cut = np.flatnonzero(np.append(True, (np.diff(ok) > 1) | (ctx[ok[1:]] != ctx[ok[:-1]])))
    return ctx[ok[cut]], ok[cut], ok[np.append(cut[1:], len(ok)) - 1]


def slices(anchor: np.ndarray, size: np.ndarray, limit: int = 300_000) -> Iterator[tuple[int, int]]:
    """Runs of whole anchors of about limit words each."""
    ends = np.flatnonzero(np.append(anchor[1:] != anchor[:-1], True)) + 1
    total = np.cumsum(size)
    x = 0
    for y in ends.tolist():
        if y == len(anchor) or total[y - 1] - (total[x - 1] if x else 0) >= limit:
            yield x, y
            x = y


def shard(meta: np.ndarray, codes: list[bytes], span: int) -> Iterator[tuple[int, int, int, int]]:
    """(doc, text, first, last) runs of marked windows of one anchor's contexts, which are ordered by doc."""
    auto, known, waiting = Automaton(), set(), []
    doc = None
    for m, b in zip(meta, codes, strict=True):
        if m["doc"] != doc:
            for w in waiting:
                if w not in known:
                    known.add(w)
                    auto.extend(np.frombuffer(w, "<u4").tolist())
            waiting, doc = [], m["doc"]
        n = len(b) // 4
        first = int(m["first"])
        if b in known:
            yield int(doc), int(m["text"]), first, first + n - span
        else:
            waiting.append(b)
            if known:
                size = np.array(auto.matches(np.frombuffer(b, "<u4").tolist()))
                hit = np.flatnonzero(size >= span) - span + 1
                if len(hit):
                    cut = np.flatnonzero(np.diff(hit) > 1) + 1
                    for run in np.split(hit, cut):
                        yield int(doc), int(m["text"]), first + int(run[0]), first + int(run[-1])


def marked(docs: DataFrame, span: int = 50, gram: int = 8) -> DataFrame:
    """doc_id, th and packed (first, last) runs of windows that start in a smaller document too."""
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_chars = docs.agg(F.sum(F.length("t"))).first()[0] or 0
    lists = table(shared_anchors(docs, span, gram, max(least, n_chars // (100 * ANCHORS_PER_TASK))), "substring-anchors")
    n, total = lists.agg(F.count("*"), F.sum(F.aggregate("anchors", F.lit(0), lambda a, b: a + F.length(b)) / 8)).first()
    parts = max(least, int(total or 0) // CONTEXTS_PER_TASK)
    found = hits(docs.filter("doc_id is not null").select("doc_id", "t", "th"), lists, ["doc_id", "th"], n, True).dropDuplicates(["doc_id", "th"]).join(lists, ["doc_id", "th"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, th, lists = T.text_column(batch.column(1)), np.asarray(batch.column(0)), np.asarray(batch.column(2)), batch.column(3)
            for lo, hi in T.slices(texts):
                w = T.words(texts.slice(lo, hi - lo))
                starts, at, h = leaders(w, span, gram)
                metas, parts_of, blobs = [], [], []
                codes = w.ids.astype("<u4")
                doc = w.doc[starts]
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    a, b = bounds[i], bounds[i + 1]
                    known = np.sort(np.frombuffer(b"".join(lists[lo + i].as_py()), np.uint64))
                    new = np.flatnonzero(np.append(True, h[a + 1 : b] != h[a : b - 1])) + a
                    k = np.minimum(np.searchsorted(known, h[new]), len(known) - 1)
                    new_hit = known[k] == h[new]
                    ends = np.append(new[1:], b)
                    for s, e in zip(new[new_hit].tolist(), ends[new_hit].tolist(), strict=True):
                        blob = codes[starts[s] : starts[e - 1] + span].tobytes()
                        metas.append((int(h[s]), int(ids[lo + i]), int(th[lo + i]), int(starts[s] - w.bounds[i]), len(blob)))
                        blobs.append(blob)
                if not metas:
                    continue
                meta = np.array(metas, META)
                part = _part(meta["anchor"], parts)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                some = np.flatnonzero(np.diff(cut))
                picks = [order[cut[p] : cut[p + 1]] for p in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([meta[x].tobytes() for x in picks], pa.binary()), pa.array([b"".join([blobs[j] for j in x]) for x in picks], pa.binary())], ["part", "meta", "codes"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for p, meta, codes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.setdefault(p, []).append((np.frombuffer(meta, META), codes))
        while held:
            rows = held.popitem()[1]
            meta = np.concatenate([r[0] for r in rows])
            words = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows])
            del rows
            size = (meta["size"] // 4).astype(np.int64)
            start = np.cumsum(size) - size
            order = np.lexsort((meta["first"], meta["text"], meta["doc"], meta["anchor"]))
            meta, size, start = meta[order], size[order], start[order]
            out = []
            for x, y in slices(meta["anchor"], size):
                codes = np.concatenate([words[i : i + n] for i, n in zip(start[x:y].tolist(), size[x:y].tolist(), strict=True)])
                offset = np.cumsum(size[x:y]) - size[x:y]
                of, lo, hi = trim(meta[x:y], codes, span, gram)
                some = meta[x:y][of]
                some["first"] += (lo - offset[of]).astype(np.int32)
                cut = [0, *(np.flatnonzero(some["anchor"][1:] != some["anchor"][:-1]) + 1).tolist(), len(of)]
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    if a < b and some["doc"][a] != some["doc"][b - 1]:
                        out += shard(some[a:b], [codes[i : j + span].tobytes() for i, j in zip(lo[a:b].tolist(), hi[a:b].tolist(), strict=True)], span)
            if out:
                e = np.array(out, np.int64)
                e = e[np.lexsort((e[:, 2], e[:, 1], e[:, 0]))]
                at = np.flatnonzero(np.append(True, (e[1:, :2] != e[:-1, :2]).any(1)))
                runs = e[:, 2:].astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array(e[at, 0]), pa.array(e[at, 1]), pa.array([runs[i:j].tobytes() for i, j in zip(at, np.append(at[1:], len(e)), strict=True)], pa.binary())], ["doc_id", "th", "runs"])

    sent = found.select("doc_id", "t", "th", "anchors").mapInArrow(tidy(send), "part int, meta binary, codes binary")
    runs = sent.repartition(parts, "part").mapInArrow(tidy(match), "doc_id long, th long, runs binary")
    return runs.groupBy("doc_id", "th").agg(F.collect_list("runs").alias("runs"))


def cut_words(words: list[bytes], runs: np.ndarray, span: int) -> np.ndarray:
    """Mask of the words that stay."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 1] + span, -1)
    return np.cumsum(edge[:-1]) == 0


def dedupe(docs: DataFrame, span: int = 50, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the text that stays (digest: its words' kept_sha256), and columns carried as c_<name>.

    A text that loses nothing stays as it is; of others, removed words go with the white space that follows them.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), *(F.col(c).alias(f"c_{c}") for c in carry))
    key = ["doc_id", "th"]
    ids = d.filter("doc_id is not null and t is not null").select(*key, F.xxhash64(F.lit(1), "t").alias("th2"))
    copied = table(ids.groupBy("th", "th2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"), "substring-copied")
    copies = table(ids.join(copied, ["th", "th2"]).filter("doc_id > first").select(*key).distinct(), "substring-copies")
    n, texts = copies.count(), d.select("doc_id", "t", "th")
    once = hits(texts, copies, key, n, False).unionAll(hits(texts, copies, key, n, True).join(copies, key, "left_anti").select("doc_id", "t", "th"))
    runs = marked(once, span, gram).unionAll(copies.select(*key, F.expr("array()").cast("array<binary>").alias("runs")))
    runs = table(runs, "substring-runs")  # no runs: the whole text
    n = runs.count()
    extra = [f"c_{c}" for c in carry]
    kinds = dict(d.dtypes)
    schema = ", ".join(["doc_id long", "n_words long", "n_removed long", "kept_sha256 string" if digest else "kept_text string", *(f"`{c}` {kinds[c]}" for c in extra)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, out = [], [], []
            lists = batch.column("runs") if "runs" in batch.schema.names else None
            for i, t in enumerate(T.text_column(batch.column("t"))):
                raw = t.as_buffer().to_pybytes()
                words = raw.split()
                total.append(len(words))
                found = lists[i].as_py() if lists is not None else None
                if found is not None and (found or len(words) >= span):
                    keep = cut_words(words, np.frombuffer(b"".join(found), "<i4").reshape(-1, 2), span) if found else np.zeros(len(words), bool)
                    gone.append(int((~keep).sum()))
                    if digest:
                        out.append(hashlib.sha256(b" ".join([x for x, k in zip(words, keep.tolist(), strict=True) if k])).hexdigest())
                    else:
                        w = T.words(pa.array([raw.decode()], pa.large_string()))
                        head = np.append(w.starts, len(raw))
                        edges = np.concatenate([[0], np.repeat(keep.astype(np.int8), np.diff(head))]).astype(np.int8) if len(words) else np.zeros(1, np.int8)
                        body = np.frombuffer(raw, np.uint8)[w.starts[0] :]
                        out.append(raw[: int(w.starts[0])].decode() + body[edges[1:] == 1].tobytes().decode())
                else:
                    gone.append(0)
                    out.append(hashlib.sha256(b" ".join(words)).hexdigest() if digest else raw.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string()), *(batch.column(c) for c in extra)], ["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept_text", *extra])

    clean = hits(d, runs, key, n, False).mapInArrow(tidy(finish), schema)
    touched = hits(d, runs, key, n, True).join(runs, ["doc_id", "th"], "left").select("doc_id", "t", "runs", *extra).mapInArrow(tidy(finish), schema)
    return clean.unionAll(touched)
