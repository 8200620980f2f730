"""LM scoring by online logistic context mixing.

A text is its lower-cased words, then one end token, read as one stream of binary decisions. The training words of a bounded
vocabulary, an escape and the end are the leaves of a binary tree, balanced by their counts over words in byte order, so that a
token is its path of bits. At every node several predictors with hashed contexts give the probability of the next bit:

*   the corpus: how often training tokens went on with a one here;
*   the class of the word before (256 classes), on the first nine bits;
*   the text's own earlier tokens, at this node, and at this node after the same word (hashed tables of each text).

Their stretched probabilities are combined by weights that a gate selects (the bit's depth, and how often the text has been
here), and a map refines the result. Weights, map and the text's tables are learned online: each text starts from the same
values, and its bits are predicted, block by block, before they are learned. The corpus counts cover every token of every training text;
a training text's own bit is left out of the class context's counts. From the tenth bit on, a token that no text
context has met goes on by the corpus alone, which is its share of the node's tokens.

After the escape, one adaptive bit tells whether the text has had the word before (then it is one of those). If not, the word's
probability is its discounted share of the training tokens outside the vocabulary (a training text's own token left out); the
discounts go to its spelling, whose bytes are mixed bit by bit from contexts of the one to four bytes before. Spelling is learned online too,
over shards of distinct words in hash order, each from the same start, with each word left out of its own counts. The vocabulary bounds what is
broadcast; all other words are aggregated and joined, so what is gathered grows with the corpus.

All sums over the corpus are of integers, and all else depends on one text or one shard of words alone: scores are the same for
any number of tasks or order of rows.

Edge cases: a null or empty text is the end token alone; a null id is in no held-out fold; repeated rows count and are scored
row by row; a very long text is one block sequence of its own, in memory that grows with it; with no training document every
count is 0, and the base probability of any token is 1. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .runtime import sum_arrays, table, tidy

#: Most words of the broadcast vocabulary.
FREQUENT = 1 << 19
#: Log2 of the least training count of a vocabulary word, and the discount of the counts of other words.
LEAST, DISCOUNT = 2, 0.7
#: Bits of a path that the class context reaches, and the number of classes, a text's start included.
TOP, CLASSES = 9, 257
#: Slots of each text's own tables, texts mixed side by side, bytes of text at once, first block of tokens.
SLOTS, LANES, AT_ONCE, FIRST = 11, 512, 1 << 21, 64
#: Weight of the corpus's probability in a context's counts: the class, the text's nodes, and those after the same word.
PRIOR = np.array([8, 4, 0.5], np.float32)
#: Start of the weights (corpus, class, text, text after the same word), and what a block moves them by.
START, RATE, MOST = np.array([0, 0.5, 0.5, 0.1], np.float32), np.float32(0.02), np.float32(0.25)
DEPTHS, TRUST, STEPS = 13, 3, 33
#: Spelling: slots (as a power of two) of the tables of one to four bytes, and one byte with its place in the word.
SPELL_SLOTS = (16, 18, 18, 18, 18)
LEVELS = np.array([0.5, 4, 16], np.float32)
SHARD, WORDS_AT_ONCE = 20_000, 1 << 13  # words of a shard; bytes that one step predicts
BLOCK = 1 << 14
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def fold(doc_id, folds: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def word_counts(docs: DataFrame) -> DataFrame:
    """h, word, c: every distinct word of docs (t, held) with its count in those not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held = T.text_column(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in T.slices(texts, AT_ONCE):
                w = T.words(texts.slice(lo, hi - lo), lower=True)
                h, first, inv = np.unique(w.ids, return_index=True, return_inverse=True)
                c = np.bincount(inv, ~held[lo:hi][w.doc], len(h)).astype(np.int64)
                size = (w.ends - w.starts)[first]
                off = np.concatenate([[0], np.cumsum(size)])
                data = _LOW[w.buf][np.arange(off[-1]) - np.repeat(off[:-1] - w.starts[first], size)]
                word = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([word, pa.array(h.view(np.int64)), pa.array(c)], ["word", "h", "c"])

    return docs.select("t", "held").mapInArrow(tidy(run), "word binary, h long, c long").groupBy("h", "word").agg(F.sum("c").alias("c"))


def _blocks(vec: np.ndarray) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    n = -(-len(vec) // BLOCK)
    yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([task] * n, pa.int32()), pa.array([vec[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in range(n)], pa.binary())], ["key", "salt", "vec"])


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    got = sum_arrays(parts, "int64")
    return np.concatenate([got[i] for i in sorted(got)])[:size] if got else np.zeros(size, np.int64)


def stretch(n0, n1, p, q, prior):
    return np.log((n1 + prior * p) / (n0 + prior * q))


@dataclass
class Tree:
    """Paths of the leaves and what the corpus says at every inner node."""

    code: np.ndarray  # by leaf: bits of its path, the first one highest
    size: np.ndarray  # by leaf: bits
    own: np.ndarray  # by leaf: log2 of its weight
    child: np.ndarray  # 2 x node + bit -> node
    one: np.ndarray  # by node: probability of a one
    whole: np.ndarray  # by node: log2 of its weight

    def __post_init__(self):
        self.stretched = np.log(self.one / (1 - self.one))

    @classmethod
    def build(cls, weights: np.ndarray) -> Tree:
        """Halve intervals of leaves by weight, level by level."""
        total = np.concatenate([[0], np.cumsum(weights)])
        n = len(weights)
        code, size = np.zeros(n, np.uint64), np.zeros(n, np.uint8)
        child, one, whole = [], [], []
        lo, hi, path, depth, nodes = np.array([0]), np.array([n]), np.zeros(1, np.uint64), 0, 0
        while len(lo):
            inner = hi - lo > 1
            leaf = ~inner
            code[lo[leaf]], size[lo[leaf]] = path[leaf], depth
            lo, hi, path = lo[inner], hi[inner], path[inner]
            if not len(lo):
                break
            if depth == 64:
                raise ValueError("a path has more than 64 bits")
            half = (total[lo] + total[hi]) / 2
            k = np.searchsorted(total, half)
            k = np.clip(np.where(half - total[k - 1] < total[k] - half, k - 1, k), lo + 1, hi - 1)
            one.append((total[hi] - total[k]) / (total[hi] - total[lo]))
            whole.append(np.log2(total[hi] - total[lo]))
            ends = np.stack([lo, k, k, hi], 1).reshape(-1, 2)
            goes_on = ends[:, 1] - ends[:, 0] > 1
            child.append(np.where(goes_on, nodes + len(lo) + np.cumsum(goes_on) - 1, 0))
            nodes += len(lo)
            bit = np.uint64(1 << (63 - depth))
            path = np.stack([path, path | bit], 1).ravel()
            lo, hi, depth = ends[:, 0], ends[:, 1], depth + 1
        return cls(code, size, np.log2(weights).astype(np.float32), np.concatenate(child).astype(np.int32), np.concatenate(one).astype(np.float32), np.concatenate(whole).astype(np.float32))


def byte_order(words: pa.BinaryArray) -> np.ndarray:
    """The first eight bytes of each word as one number."""
    _, off, data = words.buffers()
    o = np.frombuffer(off, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    b = np.append(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.uint8(0)) if len(words) else np.zeros(1, np.uint8)
    key = np.zeros(len(words), np.uint64)
    for i in range(8):
        at = o[:-1] + i
        key = key << np.uint64(8) | np.where(at < o[1:], b[np.minimum(at, len(b) - 1)], 0).astype(np.uint64)
    return key


@dataclass
class Vocabulary:
    """Hashes (sorted), leaves and counts of the frequent words; the last two leaves are the escape and the end."""

    h: np.ndarray
    leaf: np.ndarray
    count: np.ndarray
    tree: Tree

    def __post_init__(self):
        """The first hash of each bucket of hashes with the same upper bits; there are several buckets a word."""
        self.bits = len(self.h).bit_length() + 2
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.append(np.searchsorted(self.h, edges), len(self.h)).astype(np.int32)

    @property
    def escape(self) -> int:
        return len(self.h)

    def leaves(self, w: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf and count of each word (escape and 0 where it is not held), and whether it is held."""
        leaf, count = np.full(len(w.ids), self.escape, np.int32), np.zeros(len(w.ids), np.int64)
        bucket = (w.ids >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop, todo, ids = self.first.take(bucket), self.first.take(bucket + 1), np.arange(len(w.ids)), w.ids
        while len(todo):
            live = at < stop
            todo, at, stop, ids = todo[live], at[live], stop[live], ids[live]
            same = self.h.take(at) == ids
            leaf[todo[same]], count[todo[same]] = self.leaf.take(at[same]), self.count.take(at[same])
            todo, at, stop, ids = todo[~same], at[~same] + 1, stop[~same], ids[~same]
        return leaf, count, leaf != self.escape


@dataclass
class Tokens:
    """Leaves of a run of texts, each ending in the end token, their bounds, and the class of the token before."""

    leaf: np.ndarray
    bounds: np.ndarray
    prev: np.ndarray  # leaf before, -1 at a text's start
    kind: np.ndarray


def tokens(v: Vocabulary, w: T.Words, leaf: np.ndarray) -> Tokens:
    bounds = w.bounds + np.arange(len(w.bounds))
    all_leaves = np.full(bounds[-1], v.escape + 1, np.int32)
    all_leaves[np.arange(len(leaf)) + w.doc] = leaf
    prev = np.empty(len(all_leaves) + 1, np.int32)
    prev[1:] = all_leaves
    prev[bounds] = -1
    prev = prev[:-1]
    kind = np.where(prev < 0, 256, (v.tree.code >> np.uint64(56))[prev].astype(np.int64))
    return Tokens(all_leaves, bounds, prev, kind)


def class_counts(docs: DataFrame, shared) -> np.ndarray:
    """Number of zeros and ones at (class before, node of the first bits), over all tokens of docs (t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, out = shared.value, np.zeros(CLASSES << TOP, np.int64)
        for batch in batches:
            texts = T.text_column(batch.column(0))
            for lo, hi in T.slices(texts, AT_ONCE):
                w = T.words(texts.slice(lo, hi - lo), lower=True)
                x = tokens(v, w, v.leaves(w)[0])
                top = (v.tree.code >> np.uint64(64 - TOP)).astype(np.int64)[x.leaf]
                out += np.bincount(x.kind << TOP | top, minlength=len(out))
        yield from _blocks(out)

    return by_node(_summed(docs.select("t").mapInArrow(tidy(run), "key int, salt int, vec binary"), CLASSES << TOP).reshape(CLASSES, -1))


def by_node(ends: np.ndarray) -> np.ndarray:
    """classes x ends counts to counts of zeros (real) and ones (imaginary) at the nodes above, numbered as in a heap."""
    out = np.zeros(ends.shape, np.complex64)
    while ends.shape[1] > 1:
        zeros, ones = ends[:, ::2], ends[:, 1::2]
        out[:, zeros.shape[1] : 2 * zeros.shape[1]] = zeros + 1j * ones
        ends = zeros + ones
    return out.ravel()


_SEEN, _HALF = np.array([1, 1 << 32]), np.int64((1 << 32) - 1)
_BITS = np.float32(1 / np.log(2))
_IDENTITY = (1 / (1 + np.exp(-(np.arange(STEPS) - STEPS // 2) / 2))).astype(np.float32)


class Mixer:
    """Mixes up to LANES texts side by side; no text looks at another."""

    def __init__(self, v: Vocabulary, by_class: np.ndarray, lanes: int):
        self.tree, self.by_class = v.tree, by_class
        self.weights = [[np.full(lanes * TRUST, x, np.float32) for x in START] for _ in range(DEPTHS)]
        self.map = np.zeros(lanes * STEPS, np.int64)  # bits met, and ones in the upper half
        self.text, self.after = (np.zeros(lanes << SLOTS, np.int64) for _ in range(2))  # zeros, and ones in the upper half

    def block(self, lane: np.ndarray, leaf: np.ndarray, prev: np.ndarray, kind: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log2 probabilities of a block's tokens, which are then learned."""
        tree = self.tree
        order = np.argsort(255 - tree.size[leaf], kind="stable")  # longest paths first, so that each level is a prefix
        leaf, lane = leaf[order], lane[order].astype(np.int64)
        size, code = -tree.size[leaf].astype(np.int16), tree.code[leaf]
        after = (prev[order].astype(np.uint32) + np.uint32(2)) * np.uint32(0x9E3779B1)
        kind, own = kind[order] << TOP, own[order].astype(np.float32)
        node, at = np.zeros(len(leaf), np.int64), None  # at: places in out, once they are no prefix
        base, trust, bins = lane << SLOTS, lane * TRUST, lane * STEPS + STEPS // 2
        out = np.zeros(len(leaf))
        for depth in range(-int(size[0]) if len(size) else 0):
            k = np.searchsorted(size, -depth, "left")  # those with more bits
            if k < len(size):
                size, code, base, trust, bins, after, own, kind, node, leaf = (x[:k] for x in (size, code, base, trust, bins, after, own, kind, node, leaf))
                at = None if at is None else at[:k]
            if not len(size):
                break
            key = node.astype(np.uint32) * np.uint32(0x85EBCA6B)
            i_text = base + (key >> np.uint32(32 - SLOTS))
            i_after = base + (((key ^ after) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - SLOTS))
            text, again = self.text.take(i_text), self.after.take(i_after)
            if depth >= TOP:  # a token that its text has not met here goes on by the corpus alone
                met = (text | again) > 0
                if not met.all():
                    new, met = np.flatnonzero(~met), np.flatnonzero(met)
                    out[new if at is None else at.take(new)] += tree.own.take(leaf.take(new)) - tree.whole.take(node.take(new))
                    # what follows is learned too: the text has now been at this node
                    seen = _SEEN.take((code.take(new) >> np.uint64(63 - depth) & np.uint64(1)).view(np.int64))
                    np.add.at(self.text, i_text.take(new), seen)
                    np.add.at(self.after, i_after.take(new), seen)
                    size, code, base, trust, bins, after, node, leaf, text, again, i_text, i_after = (x.take(met) for x in (size, code, base, trust, bins, after, node, leaf, text, again, i_text, i_after))
                    at = met if at is None else at.take(met)
                    if not len(size):
                        break
            step_to = (code >> np.uint64(63 - depth) & np.uint64(1)).view(np.int64)
            bit = step_to.astype(np.float32)
            p = tree.one.take(node)
            q = 1 - p
            s = [tree.stretched.take(node)]
            if depth < TOP:
                heap = (1 << depth) + (code >> np.uint64(64 - depth)).view(np.int64) if depth else 1
                n, mine = self.by_class.take(kind + heap), own * bit
                s.append(stretch(np.maximum(n.real - (own - mine), 0), np.maximum(n.imag - mine, 0), p, q, PRIOR[0]))
            s.append(stretch((text & _HALF).astype(np.float32), (text >> 32).astype(np.float32), p, q, PRIOR[1]))
            n0, n1 = (again & _HALF).astype(np.float32), (again >> 32).astype(np.float32)
            s.append(stretch(n0, n1, p, q, PRIOR[2]))
            used = range(4) if depth < TOP else (0, 2, 3)
            n = n0 + n1
            gate = trust + ((n > 0).view(np.int8) + (n > 2).view(np.int8))
            weights = self.weights[min(depth, DEPTHS - 1)]
            z = np.zeros(len(p), np.float32)
            for j, x in zip(used, s, strict=True):
                z += x * weights[j].take(gate)
            np.clip(z, -8, 8, out=z)
            mixed = 1 / (1 + np.exp(-z))
            bin_ = np.rint(2 * z).astype(np.int64)
            entry = bins + bin_
            met = self.map.take(entry)
            ones = 4 * _IDENTITY.take(bin_ + STEPS // 2) + (met >> 32).astype(np.float32)
            final = np.clip((mixed + ones / ((met & _HALF) + 4).astype(np.float32)) / 2, 1e-6, 1 - 1e-6)
            lp = np.log(np.abs(final - (1 - bit))) * _BITS
            if at is None:
                out[: len(lp)] += lp
            else:
                out[at] += lp  # places differ
            error = bit - mixed
            for j, x in zip(used, s, strict=True):
                weights[j] += np.clip(RATE * np.bincount(gate, error * x, len(weights[j])), -MOST, MOST).astype(np.float32)
            np.add.at(self.map, entry, (step_to << 32) + 1)
            seen = _SEEN.take(step_to)
            np.add.at(self.text, i_text, seen)
            np.add.at(self.after, i_after, seen)
            node = tree.child.take(2 * node + step_to).astype(np.int64)
        back = np.empty(len(out))
        back[order] = out
        return back


def mixed(v: Vocabulary, by_class: np.ndarray, x: Tokens, own: np.ndarray) -> np.ndarray:
    """log2 probability of each text's tokens. own: the text is one of the training texts."""
    size = np.diff(x.bounds)
    out, by_size = np.zeros(len(size)), np.argsort(size, kind="stable")
    for g in range(0, len(size), LANES):
        group = by_size[g : g + LANES]
        m, at, step = Mixer(v, by_class, len(group)), 0, FIRST
        n = size[group]
        while at < n[-1]:
            first = int(np.searchsorted(n, at, "right"))
            some = np.minimum(n[first:] - at, step)
            lane = np.repeat(np.arange(first, len(group)), some)
            tok = np.arange(len(lane)) - np.repeat(np.cumsum(some) - some - x.bounds[group[first:]] - at, some)
            lp = m.block(lane, x.leaf[tok], x.prev[tok], x.kind[tok], own[group[lane]])
            out[group] += np.bincount(lane, lp, len(group))
            at += step
            step = max(FIRST, at // 3)
    return out


def again_bits(doc: np.ndarray, ids: np.ndarray, rows: int) -> np.ndarray:
    """For escaped words in order: log2 probability, by text, of their again-bits and of the earlier words meant.

    The bit's probability is that of the text's earlier again-bits; an earlier word is one of the distinct ones so far.
    """
    if not len(ids):
        return np.zeros(rows)
    _, later = T.repeats(doc, ids)
    n = np.arange(len(doc)) - np.searchsorted(doc, doc)
    new = np.cumsum(~later) - ~later
    distinct = new - new[np.searchsorted(doc, doc)]
    p = (n - distinct + 0.4) / (n + 0.8)
    return np.bincount(doc, np.where(later, np.log2(p) - np.log2(np.maximum(distinct, 1)), np.log2(1 - p)), rows)


@dataclass
class Bits:
    """The bits of a run of words, each word followed by a space."""

    bit: np.ndarray  # bytes x 8
    slots: list[np.ndarray]  # for each context, bytes x 8
    before: np.ndarray  # preceding byte
    word: np.ndarray  # word of each byte


def spell(words: list[bytes]) -> Bits:
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    b = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(len(b)) - np.repeat(first, size)
    last = []
    for k in range(1, 5):
        x = np.zeros(len(b), np.uint64)
        x[k:] = b[:-k]
        last.append(np.where(place >= k, x, np.uint64(1)))
    bit = ((b[:, None] >> np.arange(7, -1, -1).astype(np.uint64)) & np.uint64(1)).astype(np.int8)
    node = np.ones((len(b), 8), np.uint64)
    for i in range(1, 8):
        node[:, i] = node[:, i - 1] * np.uint64(2) + bit[:, i - 1].astype(np.uint64)
    one = last[0]
    two = one << np.uint64(8) | last[1]
    three = two << np.uint64(8) | last[2]
    four = three << np.uint64(8) | last[3]
    placed = one << np.uint64(5) | np.minimum(place, 31).astype(np.uint64)
    slots = [(one[:, None] << np.uint64(8) | node).astype(np.int64)]
    for salt, (ctx, bits) in enumerate(zip((two, three, four, placed), SPELL_SLOTS[1:], strict=True)):
        h = (ctx * np.uint64(8) + np.uint64(salt + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (h[:, None] + node * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xFF51AFD7ED558CCD)
        slots.append((x >> np.uint64(64 - bits)).astype(np.int64))
    return Bits(bit, slots, one.astype(np.int64), np.repeat(np.arange(len(words)), size))


def runs(words: list[bytes], own: np.ndarray, limit: int = WORDS_AT_ONCE) -> Iterator[tuple[list[bytes], np.ndarray]]:
    size = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    lo = 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, "right")))
        yield words[lo:hi], own[lo:hi]
        lo = hi


def spelling_counts(words: DataFrame) -> list[np.ndarray]:
    """For each context, slots x 2 counts of zeros and ones over the distinct training words of words (word, c)."""
    total = sum(2 << s for s in SPELL_SLOTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(total, np.int32)
        for batch in batches:
            w = batch.column(0).to_pylist()
            for some, _ in runs(w, np.ones(len(w), bool), 4 * WORDS_AT_ONCE):
                x, base = spell(some), 0
                for s, slot in zip(SPELL_SLOTS, x.slots, strict=True):
                    out[base : base + (2 << s)] += np.bincount((2 * slot + x.bit).ravel(), minlength=2 << s)
                    base += 2 << s
        if out.any():
            yield from _blocks(out.astype(np.int64))

    vec = _summed(words.filter("c > 0").select("word").mapInArrow(tidy(run), "key int, salt int, vec binary"), total)
    cuts = np.cumsum([2 << s for s in SPELL_SLOTS])
    return [x.reshape(-1, 2).astype(np.float32) for x in np.split(vec, cuts[:-1])]


class Speller:
    """Online mixing over the bits of one shard's words."""

    def __init__(self, counts: list[np.ndarray]):
        self.counts = [n.view(np.complex64).ravel() for n in counts]  # zeros and ones of a slot side by side
        self.weights = np.full((len(counts) + 1, 8 * (len(LEVELS) + 1)), 0.3)
        self.weights[-1] = 0
        p = 1 / (1 + np.exp(-np.linspace(-12, 12, STEPS)))
        self.zeros, self.ones = np.tile(1 - p + 0.02, 256), np.tile(p + 0.02, 256)

    def log2(self, words: list[bytes], own: np.ndarray) -> np.ndarray:
        """log2 probability of each word and the space that ends it; own: the word is in the counts, and is left out. Then learns."""
        x = spell(words)
        bit, mine, s = x.bit.ravel().astype(np.float32), np.repeat(own[x.word].astype(np.float32), 8), []
        mine_one = mine * bit
        mine_zero = mine - mine_one
        for j, slot in enumerate(x.slots):
            n = self.counts[j].take(slot.ravel())
            n0, n1 = np.maximum(n.real - mine_zero, 0), np.maximum(n.imag - mine_one, 0)
            s.append(np.log((n1 + np.float32(0.1)) / (n0 + np.float32(0.1))))
            if j == 3:
                gate = np.tile(np.arange(8), len(x.bit)) * (len(LEVELS) + 1) + sum((n0 + n1 > level).view(np.int8) for level in LEVELS)
        s.append(np.ones(len(bit), np.float32))
        z = np.zeros(len(bit), np.float32)
        for w, y in zip(self.weights.astype(np.float32), s, strict=True):
            z += w.take(gate) * y
        np.clip(z, -12, 12, out=z)
        mixed = 1 / (1 + np.exp(-z))
        entry = np.repeat(x.before * STEPS, 8) + np.rint((z + 12) * np.float32((STEPS - 1) / 24)).astype(np.int64)
        n0, n1 = self.zeros.take(entry), self.ones.take(entry)
        p = np.clip(0.5 * mixed + 0.5 * n1 / (n0 + n1), 1e-6, 1 - 1e-6)
        lp = np.log2(np.abs(p - (1 - bit))).reshape(-1, 8).sum(1)
        met = np.maximum(np.bincount(gate, minlength=self.weights.shape[1]), 1)
        error = bit - mixed
        for w, y in zip(self.weights, s, strict=True):
            w += 0.5 * np.bincount(gate, error * y, len(w)) / met
        self.zeros += np.bincount(entry, 1 - bit, len(self.zeros))
        self.ones += np.bincount(entry, bit, len(self.ones))
        return np.bincount(x.word, lp, len(words))


def spelled(words: DataFrame, n: int, every: DataFrame) -> DataFrame:
    """h, c and log2 probability of the spelling of each of the n distinct words of words (h, word, c); every: those that train it."""
    shared = words.sparkSession.sparkContext.broadcast(spelling_counts(every))
    shards = 1 + n // SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                w, own, m = t.column(2).to_pylist(), t.column(3).to_numpy() > 0, Speller(shared.value)
                lp = np.concatenate([m.log2(some, o) for some, o in runs(w, own)])
                for b in pa.table({"h": t.column(1), "c": t.column(3), "lp": pa.array(lp)}).to_batches():
                    yield b

        for batch in batches:
            k = np.asarray(batch.column(0))
            for a, b in zip(c := [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)], c[1:], strict=False):
                if a == b:
                    continue
                if k[a] != key:
                    yield from done()
                    key, held = k[a], []
                held.append(batch.slice(a, b - a))
        yield from done()
        held.clear()

    dealt = words.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "word", "c")
    return dealt.repartition("shard").sortWithinPartitions("shard", "h", "word").mapInArrow(tidy(run), "h long, c long, lp double")


def vocabulary(words: DataFrame, n_docs: int, n_words: int) -> tuple[Vocabulary, int]:
    """The words of the most frequent sizes that the vocabulary may hold, and their least count."""
    levels = words.filter("c > 0").groupBy(F.floor(F.log2("c")).cast("int").alias("k")).count().collect()
    least, room = 62, FREQUENT
    for k, count in sorted(((r["k"], r["count"]) for r in levels), reverse=True):
        room -= count
        if room < 0 or k < LEAST:
            break
        least = k
    found = words.filter(F.col("c") >= (1 << least)).select("word", "h", "c").toArrow().combine_chunks()
    h, first = np.unique(found["h"].to_numpy().view(np.uint64), return_index=True)
    words_at = found["word"].combine_chunks() if found.num_rows else pa.array([], pa.binary())
    words_at = words_at.chunk(0) if isinstance(words_at, pa.ChunkedArray) else words_at
    c = found["c"].to_numpy()[first]
    order = np.lexsort((h, byte_order(words_at)[first]))
    leaf = np.empty(len(h), np.int32)
    leaf[order] = np.arange(len(h))
    weights = np.concatenate([c[order], [max(1, n_words - c.sum()), max(1, n_docs)]]).astype(np.int64)
    return Vocabulary(h, leaf, c, Tree.build(weights)), 1 << least


def score(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"), F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False)).alias("held"))
    words = table(word_counts(d), "lm-words")
    n_words, n_known = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    n_docs = d.filter("not held").count()
    n, v_size = n_words + n_docs, n_known + (n_docs > 0)

    v, least = vocabulary(words, n_docs, n_words)
    rest_words = words.filter(F.col("c") < least)
    n_rest, v_rest, all_rest = rest_words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count("*")).first()
    shared_v = spark.sparkContext.broadcast(v)
    shared = spark.sparkContext.broadcast(class_counts(d.filter("not held"), shared_v))
    rest = table(spelled(rest_words, all_rest, words), "lm-spelled")
    base_of = lambda c: np.log10((c + 1) / (n + v_size + 1))
    names = ["rid", "doc_id", "held", "h", "tf", "n_tokens", "n_known", "base", "bytes", "lp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared_v.value
        for batch in batches:
            texts, held_out = T.text_column(batch.column(3)), batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi in T.slices(texts, AT_ONCE):
                w = T.words(texts.slice(lo, hi - lo), lower=True)
                leaf, c, hit = v.leaves(w)
                doc, rows = w.doc, hi - lo
                lp = mixed(v, shared.value, tokens(v, w, leaf), ~held_out[lo:hi])
                out = np.flatnonzero(~hit)
                bits = again_bits(doc[out], w.ids[out], rows)
                known = np.bincount(doc[hit], minlength=rows) + int(n_docs > 0)
                base = np.bincount(doc[hit], base_of(c[hit]), rows) + base_of(n_docs)
                cols = [batch.column(i).slice(lo, rows) for i in range(3)]
                none = pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*cols, none, none, pa.array(w.counts + 1), pa.array(known), pa.array(base), pa.array(np.diff(w.offsets)), pa.array(lp + bits)], names)
                # one row for each word of a text that the vocabulary lacks
                key = np.lexsort((w.ids[out], doc[out]))
                d_s, i_s = doc[out][key], w.ids[out][key]
                cut = np.flatnonzero(np.append(True, (d_s[1:] != d_s[:-1]) | (i_s[1:] != i_s[:-1]))) if len(key) else np.zeros(0, np.int64)
                of, ids, tf = d_s[cut], i_s[cut], np.diff(np.append(cut, len(key)))
                m = len(of)
                z, f = pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64())
                yield pa.RecordBatch.from_arrays([cols[0].take(pa.array(of)), z, cols[2].take(pa.array(of)), pa.array(ids.view(np.int64)), pa.array(tf), z, z, f, z, f], names)

    schema = "rid long, doc_id long, held boolean, h long, tf long, n_tokens long, n_known long, base double, bytes long, lp double"
    rows = table(d.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held", "t").mapInArrow(tidy(run), schema), "lm-rows")
    by_hash = rest.groupBy("h").agg(F.max("c").alias("c"), F.max("lp").alias("lp"))
    tf, c = F.col("tf"), F.col("c")
    share = F.log10((c + 1) / F.lit(float(n + v_size + 1)))
    others = F.greatest(c - F.when(F.col("held"), 0).otherwise(1) - DISCOUNT, F.lit(0.0)) / max(n_rest, 1)
    one_word = F.log2(others + F.lit(DISCOUNT * v_rest / n_rest if n_rest else 1.0) * F.pow(F.lit(2.0), F.greatest("lp", F.lit(-900.0))))
    priced = rows.filter("h is not null").select("rid", "h", "tf", "held").join(by_hash, "h").groupBy("rid").agg(F.sum(F.when(c > 0, tf).otherwise(0)).alias("r_known"), F.sum(share * tf).alias("r_base"), F.sum(F.round(one_word, 6).cast("decimal(20,6)")).cast("double").alias("r_lp"))
    got = rows.filter("h is null").join(priced, "rid", "left")
    bits = F.col("lp") + F.coalesce("r_lp", F.lit(0.0))
    return got.select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("r_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", F.lit(0.0))).alias("base_score"), (bits * float(np.log10(2))).alias("score"), (-bits / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
