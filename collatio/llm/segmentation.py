"""SentencePiece encoding and decoding: the n best segmentations of a text over the piece lattice.

Forward Viterbi scores of every lattice position are exact heuristics for a backward A-star search, which therefore
meets complete segmentations best first; the first of them is the path of the Viterbi pointers, so it is read off those.
No piece has a space mark after another character, so the lattice falls apart before each run of spaces (and around line
ends): the parts are searched one by one, remembered by their text, and the n best segmentations of the whole are the n
best combinations of the parts' own. The forward scores of all new parts of a
batch are computed together, position by position along the tree of pieces. A part's smallest loss, read off the
edges into its best path, tells which parts can matter; only for those the A-star search goes beyond the best path.

The vocabulary is read from a model file whose path is a parameter; scores are those of the file. Characters without a
piece become byte pieces, each at ``unknown`` below the lowest score. Text is not normalised, and decoding returns
exactly the text that was encoded, whatever it holds.

Defined results: a null text stays null (no ids, no scores); an empty text has no ids and one segmentation of score 0;
texts with fewer than n segmentations return them all; ties keep a fixed order; very long words are searched like
others, without a limit. Repeated rows get equal results. Other columns pass untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain, count, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, all_cores, bounded_batches, give_back, lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NEVER = float("inf")
_BYTE = -1
_READY: dict[str, Pieces] = KEPT.setdefault("segmentation", {})


class Tree:
    """All beginnings of pieces as states, in a hash table: (state, character) -> state."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        alphabet = sorted({c for name in pieces for c in name})
        self.letters = np.full(0x110000, -1, np.int64)
        self.letters[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        states = {"": 0}
        for name in sorted(pieces):
            for j in range(1, len(name) + 1):
                states.setdefault(name[:j], len(states))
        self.width = len(alphabet)
        self.piece = np.full(len(states), -1, np.int32)
        self.score = np.zeros(len(states))
        for name, (piece, score) in pieces.items():
            self.piece[states[name]], self.score[states[name]] = piece, score
        keys = np.array([states[name[:-1]] * self.width + int(self.letters[ord(name[-1])]) for name in states if name], np.int64)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):  # each free place takes one of those that want it, the others go on
            free = self.keys[at] < 0
            place, first = np.unique(at[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.keys[place], self.values[place] = keys[left[taken]], left[taken] + 1
            rest = np.ones(len(left), bool)
            rest[taken] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states that the letters lead to; -1 where no piece goes on."""
        out = np.full(len(state), -1, np.int64)
        wanted = np.flatnonzero(letter >= 0)
        key = state[wanted] * self.width + letter[wanted]
        at = self._home(key)
        while len(wanted):
            seen = self.keys[at]
            hit = seen == key
            out[wanted[hit]] = self.values[at[hit]]
            on = ~hit & (seen >= 0)
            wanted, key, at = wanted[on], key[on], (at[on] + 1) & (len(self.keys) - 1)
        return out


class Known:
    """Best segmentations of the parts of late, by number: ids, score, and how much the second best loses."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.score, self.loss = np.zeros(0), np.zeros(0)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def add(self, parts: list[str], flat: np.ndarray, sizes: np.ndarray, score: np.ndarray, loss: np.ndarray) -> None:
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts)), strict=True))
        starts = len(self.flat) + np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        self.flat = np.concatenate((self.flat, flat))
        self.starts, self.sizes = np.concatenate((self.starts, starts)), np.concatenate((self.sizes, sizes))
        self.score, self.loss = np.concatenate((self.score, score)), np.concatenate((self.loss, loss))


class Pieces:
    """A piece vocabulary and the segmentation of texts over it."""

    def __init__(self, proto: bytes, unknown: float = 10.0, remember: int = 200_000, at_once: int = 500_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces: some texts could not be decoded again")
        self.byte_ids = np.array([self.bytes[b] for b in range(256)], np.int32)
        own = {names[i]: (i, sp.get_score(i)) for i in plain}
        self.tree = Tree(own)
        # every beginning of a piece, so that a search along a text stops as soon as no piece goes on
        self.table: dict[str, tuple[int, float]] = {name[:j]: (-1, 0.0) for name in own for j in range(1, len(name))} | own
        self.lost = min(sp.get_score(i) for i in plain) - unknown
        self.content = [b""] * size
        for i in plain:
            self.content[i] = names[i].replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.content[i] = bytes([b])
        self.sizes = np.array([len(c) for c in self.content], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.flat = np.frombuffer(b"".join(self.content), np.uint8)
        inner = any(MARK in names[i].lstrip(MARK) for i in plain)
        ends = any("\n" in names[i] for i in plain)
        self.parts = re.compile(r"[\s\S]+") if inner else re.compile(r" *[^ ]+| +") if ends else re.compile(r" *[^ \n]+|\n| +")
        self.remember, self.at_once = remember, at_once
        self.forget()

    def forget(self) -> None:
        self.known, self.near = Known(), {}

    def _marked(self, part: str) -> str:
        # a space mark that the text itself holds is no space: it has no piece and goes by bytes
        return part.replace(MARK, "\n" if "\n" not in self.table else "\0").replace(" ", MARK)

    def _lattice(self, part: str) -> list[list[tuple[float, int, int]]]:
        """Edges into each position: (forward score through the edge, start, piece)."""
        into: list[list[tuple[float, int, int]]] = [[] for _ in range(len(part) + 1)]
        marked, get, n, lost = self._marked(part), self.table.get, len(part), self.lost
        for i in range(n):
            score = max(into[i])[0] if i else 0.0
            alone = True
            for j in range(i + 1, n + 1):
                found = get(marked[i:j])
                if found is None:
                    break
                if found[0] >= 0:
                    into[j].append((score + found[1], i, found[0]))
                    alone &= j > i + 1
            if alone:
                into[i + 1].append((score + lost * len(part[i].encode("utf-8", "surrogatepass")), i, _BYTE))
        return into

    def _ids(self, part: str, path: list[tuple[int, int]]) -> bytes:
        out: list[int] = []
        for start, piece in path:
            if piece == _BYTE:
                out += [self.bytes[b] for b in part[start].encode("utf-8", "surrogatepass")]
            else:
                out.append(piece)
        return array("i", out).tobytes()  # 32 bits wherever Spark runs

    def _long(self, part: str) -> tuple[bytes, float, float]:
        """Ids and score of the best segmentation of one long part, and how much the second best loses."""
        into, at, path, loss = self._lattice(part), len(part), [], NEVER
        total = max(into[at])[0]
        while at:
            edges = sorted(into[at], reverse=True)
            loss = min(loss, edges[0][0] - edges[1][0] if len(edges) > 1 else NEVER)
            path.append(edges[0][1:])
            at = edges[0][1]
        return self._ids(part, path[::-1]), total, loss

    def learn(self, parts: list[str], most: int = 64) -> None:
        """Forward Viterbi over many parts at once, position by position; long ones one by one."""
        for part in (p for p in parts if len(p) > most):
            ids, score, loss = self._long(part)
            own = np.frombuffer(ids, np.int32)
            self.known.add([part], own, np.array([len(own)]), np.array([score]), np.array([loss]))
        parts = sorted((p for p in parts if len(p) <= most), key=len, reverse=True)
        if not parts:
            return
        sizes, whole = np.array([len(p) for p in parts]), "".join(parts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)  # bytes of each character
        letter = np.where(codes == ord(MARK), -1, self.tree.letters[np.where(codes == 32, ord(MARK), codes)])
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        n, longest = len(parts), int(sizes[0])
        ahead, second = np.full((longest + 1, n), -NEVER), np.full((longest + 1, n), -NEVER)
        start, piece = np.zeros((longest + 1, n), np.int32), np.full((longest + 1, n), _BYTE, np.int32)
        ahead[0] = 0.0

        def offer(j: np.ndarray | int, who: np.ndarray, here: np.ndarray, i: int, by: np.ndarray | int) -> None:
            to, next_to = ahead[j], second[j]
            best = to[who]
            better = here >= best  # among equals the later start, as in the lattice's order
            next_to[who] = np.where(better, best, np.maximum(next_to[who], here))
            won = who[better]
            to[won], start[j][won] = here[better], i
            piece[j][won] = by if isinstance(by, int) else by[better]

        for i in range(longest):
            who = np.arange(int(np.searchsorted(-sizes, -i, "left")))  # parts longer than i stand first
            state, j = np.zeros(len(who), np.int64), i
            while len(who):
                state = self.tree.step(state, letter[first[who] + j])
                j += 1
                known = self.tree.piece[np.maximum(state, 0)]
                ends = (state >= 0) & (known >= 0)
                if j == i + 1 and not ends.all():  # no piece for this character: it goes by bytes
                    alone = who[~ends]
                    offer(j, alone, ahead[i, alone] + self.lost * width[first[alone] + i], i, _BYTE)
                done = who[ends]
                if len(done):
                    offer(j, done, ahead[i, done] + self.tree.score[state[ends]], i, known[ends])
                on = (state >= 0) & (sizes[who] > j)
                who, state = who[on], state[on]
        every = np.arange(n)
        total, loss = ahead[sizes, every], np.full(n, NEVER)
        at, who, steps = sizes.copy(), every, []
        while len(who):
            here = at[who]
            loss[who] = np.minimum(loss[who], ahead[here, who] - second[here, who])
            begin = start[here, who]
            steps.append((who, begin, piece[here, who]))
            at[who] = begin
            who = who[begin > 0]
        who, begin, by = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((begin, who))
        who, begin, by = who[order], begin[order], by[order]
        place = first[who] + begin
        count = np.where(by == _BYTE, width[place], 1)
        ids = np.repeat(by, count)
        raw = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        low = np.flatnonzero(ids == _BYTE)
        if len(low):
            step = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
            offset = np.cumsum(width) - width
            ids[low] = self.byte_ids[raw[np.repeat(offset[place], count)[low] + step[low]]]
        lengths = np.bincount(who, count, n).astype(np.int64)
        self.known.add(parts, ids.astype(np.int32), lengths, total, loss)

    def n_best(self, part: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations (score, ids), best first: backward A-star with the forward scores as heuristics."""
        return list(islice(self.segmentations(part), n))

    def others(self, part: str, n: int) -> list[tuple[float, np.ndarray]]:
        """``n_best`` of a part, remembered: the parts that lose least are often the same."""
        own = self.near.get((part, n))
        if own is None:
            if len(self.near) >= 20_000:
                self.near.clear()
            own = [(score, np.frombuffer(ids, np.int32)) for score, ids in self.n_best(part, n)]
            if len(part) <= 64:
                self.near[part, n] = own
        return own

    def segmentations(self, part: str) -> Iterator[tuple[float, bytes]]:
        """All segmentations of a part, best first."""
        into, order = self._lattice(part), count()
        ahead = [0.0] + [max(edges)[0] for edges in into[1:]]
        # (-(score behind + best score ahead), tie, position, score behind, path behind)
        heap = [(-ahead[-1], 0, len(part), 0.0, None)]
        while heap:
            lost, _, at, behind, path = heapq.heappop(heap)
            if not at:
                steps = []
                while path:
                    steps.append(path[0])
                    path = path[1]
                yield -lost, self._ids(part, steps)
                continue
            for through, start, piece in sorted(into[at]):
                here = behind + through - ahead[start]
                # later pushes first among equals: the search goes deep before it goes wide
                heapq.heappush(heap, (-(here + ahead[start]), -next(order), start, here, ((start, piece), path)))

    def encode(self, text: str, n: int = 1) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a whole text as (score, ids)."""
        return self.encode_many([text], n)[0]

    def encode_many(self, texts: list[str], n: int = 1) -> list[list[tuple[float, np.ndarray]]]:
        """The n best segmentations of each text; as many texts are worked on at once as have ``at_once`` characters."""
        out, some, size = [], [], 0
        for text in texts:
            if some and size + len(text) > self.at_once:
                out += self._encode_some(some, n)
                some, size = [], 0
            some.append(text)
            size += len(text)
        return out + (self._encode_some(some, n) if some else [])

    def _encode_some(self, texts: list[str], n: int) -> list[list[tuple[float, np.ndarray]]]:
        if len(self.known.number) > self.remember:
            self.forget()
            give_back()
        parts = [self.parts.findall(" " + t) if t else [] for t in texts]
        every = list(chain.from_iterable(parts))
        get = self.known.number.get
        at = np.fromiter(map(get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            names = [every[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(names)))
            at[missing] = np.fromiter(map(get, names), np.int64, len(names))
        known = self.known
        sizes, scores, losses = known.sizes[at], known.score[at], known.loss[at]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        flat = known.flat[np.arange(ends[-1]) + np.repeat(known.starts[at] - ends[:-1], sizes)]
        out, first = [], 0
        for own in parts:
            last = first + len(own)
            ids = flat[ends[first] : ends[last]]
            best = (float(scores[first:last].sum()), ids)
            out.append([best] if n == 1 or not own else [best, *self._next_best(own, n, best, scores[first:last], losses[first:last], ends[first : last + 1] - ends[first])])
            first = last
        return out

    def _next_best(self, parts: list[str], n: int, best: tuple[float, np.ndarray], scores: np.ndarray, losses: np.ndarray, ends: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """The second to the n-th best combinations of the parts' segmentations."""
        # a part outside the n - 1 smallest losses cannot change: each of those n - 1 alone does better
        some = np.argpartition(losses, n - 2)[: n - 1] if len(losses) >= n else np.arange(len(losses))
        free = sorted(i for i in some.tolist() if losses[i] < NEVER)
        options = [self.others(parts[i], n) for i in free]
        sums: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for i, choice in zip(free, options, strict=True):
            own = float(scores[i])
            sums = sorted((loss + own - score, picks + (k,)) for loss, picks in sums for k, (score, _) in enumerate(choice))[:n]
        out, (total, ids) = [], best
        for loss, picks in sums[1:]:
            pieces, last = [], 0
            for i, k, choice in zip(free, picks, options, strict=True):
                if k:
                    pieces += [ids[last : ends[i]], choice[k][1]]
                    last = ends[i + 1]
            out.append((total - loss, np.concatenate([*pieces, ids[last:]])))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_many(np.array(ids, np.int64), np.array([0, len(ids)]))[0]

    def decode_many(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Texts of the ids between each two offsets; the space put before every text is taken off again."""
        sizes = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.arange(ends[-1], dtype=np.int64) + np.repeat(self.starts[ids] - ends[:-1], sizes)
        flat = self.flat[at].tobytes()
        cuts = ends[offsets].tolist()
        return [flat[i + 1 : j] for i, j in zip(cuts, cuts[1:])]


def pieces(proto: bytes) -> Pieces:
    """Of a model file's content; made once in a process."""
    name = hashlib.sha1(proto).hexdigest()
    if name not in _READY:
        _READY[name] = Pieces(proto)
    return _READY[name]


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, n: int = 4, text: str = "text", path: str = MODEL, column: str = "segmentation", verify: bool = False) -> DataFrame:
    """docs with struct(ids, score, others): the best segmentation and, as (score, ids), the second to the n-th best.

    With ``verify`` the ids are decoded where they were made, and a further field ``round_trip`` says whether that gives
    the bytes of the text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model_bytes(path))  # one vocabulary file

    def lists(found: list) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum([0 if x is None else len(x) for x in found]))).astype(np.int32)
        some = [x for x in found if x is not None]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(some) if some else np.zeros(0, np.int32)), mask=pa.array([x is None for x in found], pa.bool_()))

    def run(batches):
        vocabulary = pieces(shared.value)
        try:
            for b in batches:
                texts = b.to_pylist()
                made = iter(vocabulary.encode_many([raw.decode("utf-8", "replace") for raw in texts if raw is not None], n))
                got = [None if raw is None else next(made) for raw in texts]
                first = lists([None if g is None else g[0][1] for g in got])
                more = [x for g in got if g for x in g[1:]]
                each = pa.StructArray.from_arrays([pa.array([x[0] for x in more], pa.float64()), lists([x[1] for x in more])], ["score", "ids"])
                offsets = np.concatenate(([0], np.cumsum([len(g) - 1 if g else 0 for g in got]))).astype(np.int32)
                others = pa.ListArray.from_arrays(pa.array(offsets), each, mask=pa.array([g is None for g in got], pa.bool_()))
                fields, names = [first, pa.array([None if g is None else g[0][0] for g in got], pa.float64()), others], ["ids", "score", "others"]
                if verify:
                    back = vocabulary.decode_many(first.values.to_numpy().astype(np.int64), first.offsets.to_numpy().astype(np.int64))
                    fields.append(pa.array([None if raw is None else raw == x for raw, x in zip(texts, back, strict=True)], pa.bool_()))
                    names.append("round_trip")
                yield pa.StructArray.from_arrays(fields, names)
        finally:  # a worker lives on; what this task has learnt of words would stay in its memory
            vocabulary.forget()

    shape = f"struct<ids:array<int>,score:double,others:array<struct<score:double,ids:array<int>>>{',round_trip:boolean' if verify else ''}>"
    return all_cores(docs).withColumn(column, F.arrow_udf(lean(run, "segmentation"), shape, F.ArrowUDFType.SCALAR_ITER)(F.col(text).cast("binary")))


def digest(coded: DataFrame, key: str = "doc_id", column: str = "segmentation") -> DataFrame:
    """(key), ids, n_pieces, score, other_ids (of the second to the n-th best), n_best_scores, round_trip of verified segmentations."""
    s = F.col(column)
    scores = F.when(s["ids"].isNotNull(), F.concat(F.array(s["score"]), s["others"]["score"]))
    return coded.select(key, s["ids"].alias("ids"), F.size(s["ids"]).alias("n_pieces"), s["score"].alias("score"), s["others"]["ids"].alias("other_ids"), scores.alias("n_best_scores"), s["round_trip"].alias("round_trip"))


def decode(docs: DataFrame, ids: str, path: str = MODEL, column: str = "decoded") -> DataFrame:
    """docs with the text that the ids stand for, as binary cast to string; null ids give null."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model_bytes(path))

    def run(batches):
        vocabulary = pieces(shared.value)
        for b in batches:
            offsets = b.offsets.to_numpy().astype(np.int64)
            got = vocabulary.decode_many(b.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0])
            yield pa.array(got, pa.binary(), mask=b.is_null().to_numpy(zero_copy_only=False))

    udf = F.arrow_udf(lean(run, "segmentation"), "binary", F.ArrowUDFType.SCALAR_ITER)
    return docs.withColumn(column, udf(F.col(ids)).cast("string"))
