"""Language-model scores by a weighted backoff automaton.

Every word and n-gram of the training rows counts and has its state and arc, however large the corpus: nothing is left
out by frequency, unless ``word_share`` or ``ngram_share`` ask for it. States are histories; an arc reads a word, a
failure arc shortens the history and weighs what smoothing leaves to it. The automaton is a distributed table by ranges
of keys; each block of texts gets the states and arcs on its way, and is read once from left to right, all its texts
side by side, each carrying its state.

Smoothing: words by add-one over the training vocabulary and one unknown word; longer histories by interpolated
absolute discounting. All probabilities of a history sum to one.

The corpus is read once and kept as blocks: per block the distinct words as sorted 64-bit keys, and the texts as indexes
into them. From the longest n-grams to the words, the distinct keys of a block and their training counts are packed and
dealt by key range, summed, and the totals go back to the blocks in the order of their keys. Each distinct n-gram has one
owner among its blocks; the owner adds it to what goes on from its history, and that is dealt and summed with the counts
of the history. So a key costs a few bytes for each block that has it, and no word or history is ever a hot key.

Words and n-grams are told apart by 64-bit hashes. Defined results: null texts count as empty; an empty text is its end
token; without training rows every word is unknown and has probability one; repeated rows are each counted and scored; an
empty table gives no rows; null ids are kept. Only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, all_cores, as_bytes, bounded_batches, mix64

END = xxhash.xxh3_64_intdigest(b" end")  # has a space, so no word has its text
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    order: int = 3
    discount: float = 0.75
    word_share: float = 0.0  # of the training tokens; rarer words have no state. The default leaves out none
    ngram_share: float = 0.0  # the same for longer n-grams
    block_tokens: int = 1_000_000
    bucket_keys: int = 1_500_000  # keys of all blocks that meet in one group, about


def pack(values: np.ndarray) -> bytes:
    """Rising or small whole numbers: differences, byte by byte of equal weight, compressed."""
    v = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(v.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def squeeze(values: np.ndarray) -> bytes:
    """Counts or indexes as 32-bit numbers, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).reshape(-1)


def blocks_of(docs: DataFrame, key: str, text: str, train: Column, own: Settings) -> DataFrame:
    """(block, ids, train, sizes, tokens, keys, n_tokens, n_keys, n_train), one row for about ``block_tokens`` tokens."""
    kind = dict(docs.select(F.col(key).alias("id")).dtypes)["id"]

    def make(batches):
        from pyspark import TaskContext

        known: dict[bytes, int] = {}
        ids, flags, texts, size, number = [], [], [], 0, 0
        arrow = None

        def flush():
            nonlocal ids, flags, texts, size, number
            sizes = np.array([len(t) for t in texts])
            keys, index = np.unique(np.concatenate(texts), return_inverse=True)
            learn = np.repeat(np.array(flags, bool), sizes)
            row = {
                "block": [(TaskContext.get().partitionId() << 32) + number], "ids": [ids], "train": [np.array(flags, np.uint8).tobytes()], "sizes": [sizes.astype(np.int64).tobytes()],
                "tokens": [squeeze(index)], "keys": [pack(keys)], "n_tokens": [len(index)], "n_keys": [len(keys)], "n_train": [int(learn.sum())],
            }
            ids, flags, texts, size, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), ("ids", pa.list_(arrow)), ("train", pa.binary()), ("sizes", pa.binary()), ("tokens", pa.binary()), ("keys", pa.binary()), ("n_tokens", pa.int64()), ("n_keys", pa.int64()), ("n_train", pa.int64())]))

        for b in batches:
            arrow = b.schema.field(0).type
            for id_, raw, flag in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = raw.lower().split()
                if len(known) > 150_000:
                    known.clear()
                try:
                    own_keys = [known[w] for w in words]
                except KeyError:
                    for w in words:
                        if w not in known:
                            known[w] = xxhash.xxh3_64_intdigest(w)
                    own_keys = [known[w] for w in words]
                own_keys.append(END)
                ids.append(id_), flags.append(bool(flag)), texts.append(np.array(own_keys, np.uint64))
                size += len(own_keys)
                if size >= own.block_tokens:
                    yield flush()
        if texts:
            yield flush()

    rows = docs.select(F.col(key).alias("id"), as_bytes(F.col(text)).alias("raw"), F.coalesce(train, F.lit(False)).alias("flag"))
    return all_cores(rows).mapInArrow(make, f"block bigint, ids array<{kind}>, train binary, sizes binary, tokens binary, keys binary, n_tokens bigint, n_keys bigint, n_train bigint")


def _power(n: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n))))


class Block:
    """The texts of one block, and the distinct n-grams in them in the order of their keys."""

    def __init__(self, row: dict, frequent: np.ndarray | None):
        self.keys, self.tokens = unpack(row["keys"]), unsqueeze(row["tokens"]).astype(np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.learn = np.repeat(np.frombuffer(row["train"], np.uint8) > 0, self.sizes)
        self.place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.sizes)
        self.usable = np.ones(len(self.tokens), bool) if frequent is None else np.isin(self.keys, frequent)[self.tokens]

    def grams(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and for each place the number of the n-gram that ends there, or -1."""
        if length == 1:
            return self.keys, self.tokens
        words = self.keys[self.tokens]
        code, whole = words, self.usable
        for _ in range(length - 1):
            longer = np.zeros_like(code)
            longer[1:] = mix64(code[:-1] * MULTIPLIER + words[1:])
            code, whole = longer, self.usable & np.concatenate(([False], whole[:-1]))
        at = np.flatnonzero(whole & (self.place >= length - 1))
        keys, index = np.unique(code[at], return_inverse=True)
        number = np.full(len(code), -1, np.int64)
        number[at] = index
        return keys, number

    def counts(self, number: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(number[self.learn & (number >= 0)], minlength=n)


def dealt_keys(block: int, keys: np.ndarray, values: np.ndarray, bits: int) -> dict:
    cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(keys)] if bits else [0, len(keys)]
    some = [(i, lo, hi) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
    return {"bucket": pa.array([i for i, _, _ in some], pa.int32()), "block": pa.array([block] * len(some), pa.int64()), "keys": pa.array([pack(keys[lo:hi]) for _, lo, hi in some], pa.binary()), "sums": pa.array([squeeze(values[:, lo:hi].reshape(-1)) for _, lo, hi in some], pa.binary())}


DEALT = "bucket int, block bigint, keys binary, sums binary"


def deal_longest(blocks: DataFrame, length: int, bits: int, frequent) -> DataFrame:
    """For each block and range of keys (bucket) the n-grams and their training counts; nothing goes on from them."""

    def deal(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row, frequent and frequent.value)
                keys, number = block.grams(length)
                values = np.zeros((3, len(keys)), np.int64)
                values[0] = block.counts(number, len(keys))
                yield pa.RecordBatch.from_pydict(dealt_keys(row["block"], keys, values, bits))

    return blocks.select("block", "train", "sizes", "tokens", "keys").mapInArrow(deal, DEALT)


def deal_shorter(blocks: DataFrame, longer: DataFrame, length: int, bits: int, frequent) -> DataFrame:
    """The same with, for each n-gram, the number and the counts of those one word longer that the block owns."""

    def deal(texts, found):
        row = texts.to_pylist()[0]
        block = Block(row, frequent and frequent.value)
        keys, number = block.grams(length)
        values = np.zeros((3, len(keys)), np.int64)
        values[0] = block.counts(number, len(keys))
        long_keys, long_number = block.grams(length + 1)
        if len(long_keys):
            counts, owned, _, _ = returned(found)
            at = np.flatnonzero(long_number >= 0)
            history = np.zeros(len(long_keys), np.int64)
            history[long_number[at]] = number[at - 1]
            owned = owned > 0
            values[1] = np.bincount(history[owned], minlength=len(keys))
            values[2] = np.bincount(history[owned], counts[owned], len(keys))
        return pa.table(dealt_keys(row["block"], keys, values, bits))

    texts = blocks.select("block", "train", "sizes", "tokens", "keys")
    return texts.groupBy("block").cogroup(longer.groupBy("block")).applyInArrow(deal, DEALT)


def totals_of(dealt: DataFrame, length: int, least: int) -> DataFrame:
    """For each block and bucket, in the order of the block's keys: training counts of the whole corpus (0 for n-grams
    that do not reach ``least``), whether the block owns the n-gram, how many n-grams go on from it, and how much of its
    count they take, which the longest do not have; for words, in rows with a null block, the number of distinct training words."""

    def total(key, table):
        parts = [unpack(k) for k in table.column("keys").to_pylist()]
        values = np.concatenate([unsqueeze(x).reshape(3, -1) for x in table.column("sums").to_pylist()], axis=1)
        keys, first, index = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
        counts, following, used = (np.bincount(index, x, len(keys)).astype(np.int64) for x in values)
        if length > 1:
            counts[counts < least] = 0
        owned = np.zeros(len(index), np.int64)
        owned[first] = counts > 0
        ends = np.cumsum([len(p) for p in parts]).tolist()
        sums = []
        for end, part in zip(ends, parts, strict=True):
            mine = index[end - len(part) : end]
            sums.append(squeeze(np.concatenate((counts[mine], owned[end - len(part) : end], following[mine], used[mine]))))
        blocks, distinct = table.column("block").to_pylist(), [0] * len(parts)
        if length == 1:
            blocks, sums, distinct = [*blocks, None], [*sums, b""], [*distinct, int((counts > 0).sum())]
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([key[0].as_py()] * len(blocks), pa.int32()), "sums": pa.array(sums, pa.binary()), "distinct_words": pa.array(distinct, pa.int64())})

    return dealt.groupBy("bucket").applyInArrow(total, "block bigint, bucket int, sums binary, distinct_words bigint")


def returned(found: pa.Table) -> np.ndarray:
    """The rows of totals of one block and length, over all buckets; for the last, how much of the count does not go on."""
    parts = sorted(zip(found.column("bucket").to_pylist(), found.column("sums").to_pylist(), strict=True))
    out = np.concatenate([unsqueeze(s).reshape(4, -1) for _, s in parts], axis=1).astype(np.int64) if parts else np.zeros((4, 0), np.int64)
    out[3] = out[0] - out[3]
    return out


def frequent_words(blocks: DataFrame, bits: int, least: int, share: float):
    """Where ``share`` is positive, the keys of the words that reach ``least`` as a broadcast: at most 1/share."""
    if share <= 0:
        return None

    def total(key, table):
        keys, index = np.unique(np.concatenate([unpack(k) for k in table.column("keys").to_pylist()]), return_inverse=True)
        counts = np.concatenate([unsqueeze(x).reshape(3, -1)[0] for x in table.column("sums").to_pylist()])
        return pa.table({"keys": pa.array([keys[np.bincount(index, counts, len(keys)) >= least].tobytes()], pa.binary())})

    rows = deal_longest(blocks, 1, bits, None).groupBy("bucket").applyInArrow(total, "keys binary").collect()
    return blocks.sparkSession.sparkContext.broadcast(np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows] or [np.zeros(0, np.uint64)]))


class Automaton:
    """The states and arcs on the way of one block's texts.

    A state is a history of up to ``order - 1`` words that the training rows have; the root is the empty one. Its arc for
    a word, if they go on with it, weighs the word's probability; its failure arc leads to the history without its first
    word and weighs what smoothing leaves to that. The root has an arc for every word, an unknown one included."""

    def __init__(self, block: Block, totals: list[np.ndarray], tokens: int, vocabulary: int, least: int, own: Settings):
        self.order, self.block = own.order, block
        counts = totals[0][0]
        arc = (counts + 1.0) / (tokens + vocabulary + 1.0)  # of the root, by word
        self.numbers = [np.zeros(len(block.tokens), np.int64), block.tokens]  # of the n-gram that ends at each place, by length
        self.arcs, self.fails = [np.zeros(0), np.log10(arc)], [np.zeros(0)]  # logarithms, by the length of the n-gram and of the history
        words = np.zeros(len(counts), bool)
        words[block.tokens[block.usable]] = True
        self.known = [np.zeros(0, bool), words & (counts >= least)]  # whether an n-gram is a state
        for length in range(2, own.order + 1):
            short, _, following, unused = totals[length - 2]
            left = np.where(following > 0, np.maximum((unused + own.discount * following) / np.maximum(short, 1), 1e-12), 1.0)
            self.fails.append(np.log10(left))
            keys, number = block.grams(length)
            counts = totals[length - 1][0] if totals[length - 1].size else np.zeros(len(keys), np.int64)
            at = np.flatnonzero(number >= 0)
            place = np.zeros(len(keys), np.int64)
            place[number[at]] = at  # any place of each n-gram tells its history and its end
            history, end = self.numbers[-1][place - 1], self.numbers[-1][place]
            longer = np.where(counts > 0, (counts - own.discount) / np.maximum(short[history], 1) + left[history] * arc[end], 1.0) if len(keys) else np.zeros(0)
            arc = longer
            self.numbers.append(number), self.arcs.append(np.log10(arc)), self.known.append(counts > 0)

    def lanes(self, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where to begin reading, to begin counting, and to end: texts side by side. A long text is read in pieces, each
        after the words before it, which lead from the root to the state in which the piece before ends."""
        sizes, starts = self.block.sizes, self.block.starts
        pieces = -(-sizes // piece)
        text = np.repeat(np.arange(len(sizes)), pieces)
        begin = starts[text] + piece * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        lead, end = np.maximum(starts[text], begin - self.order + 1), np.minimum(begin + piece, (starts + sizes)[text])
        by = np.argsort(lead - end, kind="stable")
        return lead[by], begin[by], end[by]

    def read(self, piece: int = 512) -> np.ndarray:
        """The logarithm of each word's probability, by one traversal from left to right that carries the state."""
        lead, begin, end = self.lanes(piece)
        out = np.zeros(len(self.block.tokens))
        state, size = np.zeros(len(lead), np.int64), end - lead  # the length of the history; the place tells which one
        for step in range(int(size.max(initial=0))):
            n = int(np.searchsorted(-size, -step, "left"))  # the lanes that go on stand first
            at, now = lead[:n] + step, state[:n]
            weight, after = np.zeros(n), np.zeros(n, np.int64)
            for length in range(self.order - 1, -1, -1):
                who = np.flatnonzero(now == length)
                if not len(who):
                    continue
                gram = self.numbers[length + 1][at[who]]
                known = (gram >= 0) & self.known[length + 1][np.maximum(gram, 0)] if len(self.known[length + 1]) else np.zeros(len(who), bool)
                goes = known if length else np.ones(len(who), bool)
                weight[who[goes]] += self.arcs[length + 1][gram[goes]]
                after[who[goes]] = np.where(known[goes], min(length + 1, self.order - 1), 0)
                fails = who[~goes]
                if length:
                    weight[fails] += self.fails[length][self.numbers[length][at[fails] - 1]]
                    now[fails] -= 1
                now[who[goes]] = -1  # read
            state[:n] = after
            counted = at >= begin[:n]
            out[at[counted]] = weight[counted]
        return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", train: Column | None = None, settings: Settings | None = None) -> DataFrame:
    """Per row: (key), n_tokens, n_known, train_tokens, base_score, score; learns from the rows where ``train`` holds."""
    own = settings or Settings()
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = dict(docs.select(F.col(key).alias("id")).dtypes)["id"]
    scratch = Scratch(spark, "lm")
    blocks = scratch.stored(blocks_of(docs, key, text, F.lit(True) if train is None else train, own), "blocks")
    sums = blocks.agg(F.sum("n_train").alias("train"), F.sum("n_tokens").alias("tokens"), F.sum("n_keys").alias("keys")).first()
    n = sums["train"] or 0
    bits = [_power((sums["keys" if length == 1 else "tokens"] or 0) // own.bucket_keys) for length in range(1, own.order + 1)]
    least = [max(1, math.ceil((own.word_share if length == 1 else own.ngram_share) * n)) for length in range(1, own.order + 1)]
    frequent = frequent_words(blocks, bits[0], least[0], own.word_share)
    totals: list[DataFrame] = []  # from words to the longest
    for length in range(own.order, 0, -1):
        dealt = partial(deal_shorter, blocks, totals[0]) if totals else partial(deal_longest, blocks)
        totals.insert(0, scratch.stored(totals_of(dealt(length, bits[length - 1], frequent), length, least[length - 1]), f"totals-{length}"))
    vocabulary = totals[0].agg(F.sum("distinct_words").alias("v")).first()["v"] or 0
    scratch.release()

    def run(texts, found):
        row = texts.to_pylist()[0]
        block = Block(row, frequent and frequent.value)
        lengths = found.column("length").to_numpy()
        got = [returned(found.filter(pa.array(lengths == length))) for length in range(1, own.order + 1)]
        automaton = Automaton(block, got, n, vocabulary, least[0], own)
        known = (got[0][0] > 0)[block.tokens]
        sums = (np.add.reduceat(x, block.starts) for x in (known.astype(np.int64), automaton.arcs[1][block.tokens], automaton.read()))
        return pa.table(dict(zip(("id", "n_tokens", "n_known", "base_score", "score"), (pa.array(row["ids"], texts.schema.field("ids").type.value_type), pa.array(block.sizes), *map(pa.array, sums)), strict=True)))

    found = totals[0].where("block is not null").select("block", "bucket", "sums", F.lit(1).alias("length"))
    for length in range(2, own.order + 1):
        found = found.union(totals[length - 1].select("block", "bucket", "sums", F.lit(length).alias("length")))
    texts = blocks.select("block", "ids", "train", "sizes", "tokens", "keys")
    out = texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("id").alias(key), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
