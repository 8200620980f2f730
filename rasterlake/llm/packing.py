"""Packing documents into fixed-length sequences: shortest-pack-first over the length histogram.

Every document is tokenised in full and ends with one end id. Its ids are cut into pieces: whole sequences first, then one
remainder. The histogram of piece lengths (at most ``capacity`` numbers) is packed on the driver: lengths are placed longest
first, each into the shortest open pack (the one with the most room), updating pattern counts; if it does not fit there it fits
nowhere, and a new pack is opened. A pattern assigns, to each of
its slots, a run of ranks among the pieces of one length; pieces find their sequence and offset by that run. Ranks come from
ranks within a task plus the counts of earlier tasks, so no length, however common, is sorted in one place.

Edge cases: a null or empty text is the end id alone; a null id is packed like any other; repeated rows are packed once per
row; an empty table gives an empty result; a very long text is encoded in one go and gives as many pieces as it needs; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as T
from .runtime import table, tidy

#: Distinct space-separated strings whose ids a worker remembers before it starts afresh.
CACHE = 500_000
#: New strings encoded as one text.
RUN = 2_000
#: Fixed value: the splitting pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BETWEEN = re.compile(r"\s \s")
_TOKENIZERS: dict[str, Encoder] = {}


def byte_ranks(tokenizer) -> dict[bytes, int]:
    """Byte strings of a byte-level vocabulary; ids grow in merge order, so they are the ranks that a rank coder merges by."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(map(chars.__getitem__, t)): i for t, i in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in chars for c in t) and not t.startswith("<|")}


class Encoder:
    """Byte-level BPE ids of whole texts, remembering the ids of each space-separated string.

    The vocabulary's splitting pattern never joins a character with what stands before a single space, so a text is encoded
    string by string, each but the first with its space. New strings are encoded together from the same vocabulary as ranks,
    which gives the same ids faster. A text where a space has white space on both sides, or that starts
    or ends with a space, is encoded in one go. So is one that holds an added token (such as an end of text), by the tokenizer as
    loaded, which gives that token's own id.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        ranks = byte_ranks(self.tokenizer)
        self.ranks = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(1 + max(ranks.values()), bool)
        self.spaced[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Ids of strings that follow a space: many are encoded as one text, whose ids part where a token starts with a space."""
        plain = [p for p in new if not p[0].isspace()]
        for i in range(0, len(plain), RUN):
            run = plain[i : i + RUN]
            ids = np.array(self.ranks.encode_ordinary(" " + " ".join(run)), "<u4")
            at = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
            b, at = ids.tobytes(), (4 * at).tolist()
            self.known.update((p, b[s:e]) for p, s, e in zip(run, at[:-1], at[1:], strict=True))
        rest = [p for p in new if p[0].isspace()]
        self.known.update(zip(rest, self._encode([" " + p for p in rest]), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        held = [i for i, t in enumerate(texts) if self.added.search(t)]
        if held:
            self.tokenizer.encode_special_tokens = False
            as_loaded = dict(zip(held, self._encode([texts[i] for i in held]), strict=True))
            self.tokenizer.encode_special_tokens = True
            others = iter(self([t for i, t in enumerate(texts) if i not in as_loaded]))
            return [as_loaded[i] if i in as_loaded else next(others) for i in range(len(texts))]
        split = [None if "  " in t or _BETWEEN.search(t) or t.startswith(" ") or t.endswith(" ") else t.split(" ") for t in texts]
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        self._learn(list({p for parts in split if parts for p in parts[1:]}.difference(known)))
        whole = self._encode([t if parts is None else parts[0] for t, parts in zip(texts, split, strict=True)])
        return [first if parts is None else first + b"".join(map(known.__getitem__, parts[1:])) for first, parts in zip(whole, split, strict=True)]


def encoder(path: str) -> Encoder:
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, task_rank long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = T.text_column(batch.column(1))
            for lo, hi in T.slices(texts):
                cols = defaultdict(list)
                for doc_id, ids in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), encode(texts.slice(lo, hi - lo).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for s in range(0, n, capacity):
                        size = min(capacity, n - s)
                        for k, v in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "task_rank"), (doc_id, s, size, zlib.crc32(ids[4 * s : 4 * (s + size)]), n, task, seen[size]), strict=True):
                            cols[k].append(v)
                        seen[size] += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "task" else pa.int64()) for k, v in cols.items()], list(cols))
        _TOKENIZERS.clear()  # a worker outlives its task, and need not hold this beside the next one's

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) t").mapInArrow(tidy(run), PIECES)


@dataclass(frozen=True)
class Pattern:
    lengths: tuple[int, ...]
    count: int


def pack_histogram(counts: dict[int, int], capacity: int = 2048) -> list[Pattern]:
    """Shortest-pack-first: place lengths longest first, each into the open pack with the most room, or else into a new one."""
    open_by_room: dict[int, list[list]] = defaultdict(list)  # room -> [[lengths, count]]
    rooms: list[int] = []
    done: list[Pattern] = []

    def keep(lengths: tuple[int, ...], n: int, room: int) -> None:
        if not room:
            done.append(Pattern(lengths, n))
            return
        if not open_by_room[room]:
            at = bisect_left(rooms, room)
            rooms.insert(at, room)
        open_by_room[room].append([lengths, n])

    for size in sorted((k for k, v in counts.items() if v > 0), reverse=True):
        left = counts[size]
        while left:
            if not rooms or rooms[-1] < size:  # not even the shortest has room: a new pack is the shortest until it is full
                each = max(1, min(capacity // size, left))
                n = left // each
                keep((size,) * each, n, capacity - size * each)
                left -= n * each
                continue
            room = rooms[-1]
            lengths, n = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms.pop()
            used = min(n, left)
            if used < n:
                keep(lengths, n - used, room)
            keep((*lengths, size), used, room - size)
            left -= used
    done += [Pattern(lengths, n) for room in rooms for lengths, n in open_by_room[room]]
    return sorted(done, key=lambda p: (p.lengths, p.count), reverse=True)


def slots(patterns: list[Pattern]) -> dict[int, list[tuple[int, int, int]]]:
    """By length: (first rank, first sequence, offset) of each run of ranks, by first rank."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    given: dict[int, int] = defaultdict(int)
    first = 0
    for p in patterns:
        offset = 0
        for size in p.lengths:
            out[size].append((given[size], first, offset))
            given[size] += p.count
            offset += size
        first += p.count
    return out


def place(rows: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Join patterns to pieces by rank among the pieces of one length."""
    spark = rows.sparkSession
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("length", "task").agg(F.count("*").alias("n"))
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("length", "task", "base")
    ranked = rows.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("task_rank"))
    tables = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in slots(patterns).items()}
    shared = spark.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (2, 5))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                at = length == size
                firsts, seqs, offs = shared.value[int(size)]
                k = np.searchsorted(firsts, rank[at], "right") - 1
                seq[at], off[at] = seqs[k] + rank[at] - firsts[k], offs[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    rows = table(pieces(docs, tokenizer, capacity, end_id), "packing-pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(rows, pack_histogram(counts, capacity))
