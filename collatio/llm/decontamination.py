"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of words. Over all passages of the corpus the TF-IDF matrix (columns: the
hashed words of the benchmark; any other word has weight zero in every item) is factored by a distributed randomised
SVD: each task adds a'(a Omega) over its passages, the partial sketches are summed in pieces, and the small matrix is
decomposed on the driver (Nystroem form: one pass). Passages and items are compared by the cosine of their projections,
in blocks; an item longer than a passage is compared as a whole and by its own passages, so it may be of any length.
Each candidate is verified on words: the longest common subsequence of the item and the text around the passage, and the
same for the item's answer, its last sentence. Every passage of every whole text is searched.
Stop words weigh nothing, but the rarest few words of each item keep their weight however common they are. Besides, the
word sequence of every item is searched for as it is, so that an exact copy is found whatever its words weigh; such a
leak has no cosine where it was found in this way alone. Items under ``similar_words`` are found in this way only.

Defined results: null or empty texts leak nothing; items that are null or shorter than ``min_words`` are not searched
for (they occur by chance), where in scripts without spaces each character is a word; no item is too long; equal items
are each reported; repeated rows get equal results; an empty benchmark or an empty corpus gives no leaks. Only the named
columns are read; other columns pass untouched.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, all_cores, as_bytes, bounded_batches, lean

_PUNCTUATION = bytes.maketrans(bytes(i for i in range(128) if not chr(i).isalnum()), b" " * sum(not chr(i).isalnum() for i in range(128)))
_SENTENCE = re.compile(rb"(?:[.!?\n]|\xe3\x80\x82|\xef\xbc[\x81\x9f])+\s*")
#: The first bytes of characters of scripts without spaces, and those characters: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han.
_LEADS = [bytes([b]) for b in (0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0)]
_WIDE_MARK = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_UNSPACED = re.compile("([\u0e01-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u302f\u3031-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
LEAK = "array<struct<item_id:{0},cosine:double,overlap:double,answer:double,at:bigint>>"


def words(raw: bytes) -> list[bytes]:
    """Words between spaces and ASCII marks; in scripts without spaces each character is a word, and their marks are none."""
    if not raw.isascii() and any(b in raw for b in _LEADS):
        text = raw.decode("utf-8", "surrogateescape")
        raw = _UNSPACED.sub(r" \1 ", _WIDE_MARK.sub(" ", text)).encode("utf-8", "surrogateescape")
    return raw.lower().translate(_PUNCTUATION).split()


@dataclass(frozen=True)
class Settings:
    half: int = 24  # words; a passage is two neighbouring halves
    rank: int = 160
    oversampling: int = 16
    power: float = 2.0  # of the inverse document frequency
    stop_share: float = 0.002  # a word in more of the passages is a stop word, if several items have it too:
    stop_items: int = 3  # a passage that is copied everywhere does not turn its own words into stop words
    telling: int = 5  # words of each item, the rarest, that are no stop words in any case
    bits: int = 14  # of hashed words: bounds every matrix
    max_words: int = 1 << 20  # distinct words of a benchmark; more raise an error rather than go unsearched
    min_words: int = 3
    similar_words: int = 5  # shorter items are found as exact copies alone: a paraphrase of four words says little
    min_cosine: float = 0.45
    min_shared: float = 0.4  # of the item's words that are no stop words, before any alignment
    min_overlap: float = 0.7  # of the item's words, in order
    weak_overlap: float = 0.5  # enough where the answer is there too
    min_answer: float = 0.8
    piece: int = 128  # rows of the sketch in one message
    block_bytes: int = 16 << 20  # of item text searched for in one pass
    seed: int = 5


@dataclass
class Latent:
    """Numbers of words, their rows in the matrices, the projection of those, and the settings."""

    settings: Settings
    numbers: dict[bytes, int]  # of the words of the benchmark
    slots: np.ndarray  # row of each word, by its hash; the last entry, -1, is for all other words
    weight: np.ndarray  # idf of each row
    projection: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # rows x rank, idf included


def lcs_length(masks: dict[int, int], length: int, other: list[int]) -> int:
    """Longest common subsequence; masks holds the positions of each word of the one side as bits."""
    full = (1 << length) - 1
    row = full
    for w in other:
        hit = row & masks.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def masks_of(ids: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(ids):
        out[w] = out.get(w, 0) | 1 << i
    return out


def numbered(numbers: dict[bytes, int], raw: bytes) -> np.ndarray:
    """The words of a text as numbers; -1 for those that the benchmark does not know."""
    own = words(raw)
    return np.fromiter(map(numbers.get, own, repeat(-1)), np.int32, len(own))


def halves(texts: list[np.ndarray], weight: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts given as rows of the matrices (-1: none) the weighted words and the number of the half each lies in; for
    each such number (halves without a weighted word have none) its text and its place in it; whether the next number is
    the next half of the same text."""
    weighted = np.append(weight > 0, False)
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate(texts) if len(texts) else np.zeros(0, np.int32)
    at = np.flatnonzero(weighted[flat])  # the last entry, for words out of the benchmark, is false
    first = np.concatenate(([0], np.cumsum(sizes)))
    text = np.searchsorted(first, at, side="right") - 1
    place = (at - first[text]) // step
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    row = np.cumsum(new) - 1
    owner, place = text[new], place[new]
    follows = np.zeros(len(owner), bool)
    follows[:-1] = (owner[1:] == owner[:-1]) & (place[1:] == place[:-1] + 1)
    return flat[at], row, owner, place, follows


def _sums(matrix: np.ndarray, rows: np.ndarray, group: np.ndarray, large: int = 64) -> np.ndarray:
    """For each of the numbers in ``group``, which rise from 0 without gaps, the sum of its rows of the matrix."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(starts, len(group)))
    order = np.argsort(-sizes, kind="stable")
    first, left = starts[order], sizes[order]
    out = matrix[rows[first]]
    for i in range(int(np.searchsorted(-left, -large, "left"))):  # one by one
        out[i] = matrix[rows[first[i] : first[i] + left[i]]].sum(axis=0)
    small = int(np.searchsorted(-left, -large, "left"))
    for k in range(1, int(left[small]) if small < len(left) else 0):  # the k-th rows of all groups at once
        on = int(np.searchsorted(-left, -k, "left"))
        out[small:on] += matrix[rows[first[small:on] + k]]
    back = np.empty_like(out)
    back[order] = out
    return back


def _paired(halves: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Passages: each half with the next one of its text."""
    out = halves.copy()
    at = np.flatnonzero(follows)
    out[at] += halves[at + 1]
    return out


def _summed(pieces: DataFrame) -> dict[int, np.ndarray]:
    """Sums of (piece, data) over all tasks, first within 64 groups of tasks, then over those."""

    def add(key, table):
        total = None
        for x in table.column("data").to_pylist():
            x = np.frombuffer(x, np.float64)
            total = x.copy() if total is None else total + x
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    shape = "piece int, data binary"
    near = pieces.groupBy("piece", F.pmod("task", F.lit(64)).alias("g")).applyInArrow(add, shape)
    return {r["piece"]: np.frombuffer(r["data"], np.float64) for r in near.groupBy("piece").applyInArrow(add, shape).collect()}


def _tokens(docs: DataFrame, text: str, latent: Latent, scratch: Scratch) -> DataFrame:
    """(slots, n): each text as rows of the matrices, stored, so that texts are cut into words once."""
    shared = docs.sparkSession.sparkContext.broadcast((latent.numbers, latent.slots))  # bounded by Settings.max_words

    def run(batches):
        numbers, slots = shared.value
        kind = np.int16 if len(slots) < 1 << 15 else np.int32
        for b in batches:
            own = [slots[numbered(numbers, raw)].astype(kind) for raw in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in own], pa.binary()), pa.array([x.itemsize for x in own], pa.int32())], ["slots", "bytes"])

    return scratch.stored(all_cores(docs.select(as_bytes(F.col(text)).alias("raw"))).mapInArrow(lean(run), "slots binary, bytes int"), "words")


def _pass(tokens: DataFrame, latent: Latent, add, width: int) -> np.ndarray:
    """The sum over all texts of what ``add`` puts into a matrix of the latent's rows by ``width``."""
    shared = tokens.sparkSession.sparkContext.broadcast((latent.settings, latent.weight, latent.projection))  # bounded by Settings.bits
    piece = latent.settings.piece

    def run(batches):
        from pyspark import TaskContext

        settings, weight, projection = shared.value
        total = np.zeros((len(weight), width))
        some = False
        for b in batches:
            texts = [np.frombuffer(x, f"i{k}") for x, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            add(settings, weight, projection, texts, total)
            some = True
        if some:
            at = range(0, len(total), piece)
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([i // piece for i in at], pa.int32()), pa.array([task] * len(at), pa.int64()), pa.array([total[i : i + piece].tobytes() for i in at], pa.binary())], ["piece", "task", "data"])

    got = _summed(tokens.mapInArrow(lean(run), "piece int, task bigint, data binary"))
    out = np.zeros((len(latent.weight), width))
    for k, data in got.items():
        out[k * piece : (k + 1) * piece] = data.reshape(-1, width)
    return out


def _needed(items: DataFrame, item_text: str, index: dict[bytes, int], seen: np.ndarray, stop: np.ndarray, least: int) -> list[int]:
    """Stop words that items with few others need: the rarest, so that each item has ``least`` words, or all it has."""
    shared = items.sparkSession.sparkContext.broadcast((index, seen, stop))

    def run(batches):
        index, seen, stop = shared.value
        found: set[int] = set()
        for b in batches:
            for raw in b.column(0).to_pylist():
                own = np.array(sorted({index[w] for w in words(raw)}), np.int64)
                common = own[stop[own]]
                short = least - (len(own) - len(common))
                if short > 0:
                    found.update(common[np.argsort(seen[common], kind="stable")[:short]].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], ["row"])

    got = items.select(as_bytes(F.col(item_text)).alias("raw")).mapInArrow(lean(run), "row int").distinct()
    return [r["row"] for r in got.collect()]


def fit(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", settings: Settings | None = None) -> Latent:
    """Latent space of the passages of the whole corpus, over the words of the benchmark."""
    settings = settings or Settings()
    bounded_batches(docs.sparkSession)
    size = 1 << settings.bits

    def slots(batches):
        for b in batches:
            found = Counter(w for raw in b.column(0).to_pylist() for w in set(words(raw)))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "items"])

    known = items.select(as_bytes(F.col(item_text)).alias("raw")).mapInArrow(lean(slots), "word binary, items bigint").groupBy("word").agg(F.sum("items").alias("items"))
    if known.count() > settings.max_words:
        raise ValueError(f"the benchmark has more than {settings.max_words} distinct words; raise Settings.max_words and give the driver more memory")
    vocabulary = sorted(bytes(r["word"]) for r in known.collect())
    rows: dict[int, int] = {}
    index = {w: rows.setdefault(xxhash.xxh3_64_intdigest(w) & (size - 1), len(rows)) for w in vocabulary}
    latent = Latent(settings, {w: i for i, w in enumerate(vocabulary)}, np.array([*index.values(), -1], np.int32), np.ones(len(rows)))
    if not rows:
        return latent

    def frequency(settings, weight, projection, texts, total):
        ids, row, owner, _, _ = halves(texts, weight, settings.half)
        pair = np.unique(row * np.int64(len(weight)) + ids)
        total[:, 0] += np.bincount(pair % len(weight), minlength=len(weight))
        total[0, 1] += sum(-(-len(t) // settings.half) for t in texts)

    scratch = Scratch(docs.sparkSession, "latent")
    tokens = _tokens(docs, text, latent, scratch)
    counted = _pass(tokens, latent, frequency, 2)
    n, seen = max(1.0, counted[0, 1]), counted[:, 0]
    shared = np.zeros(len(rows))
    for r in known.collect():
        shared[index[bytes(r["word"])]] += r["items"]
    stop = (seen > settings.stop_share * n) & (shared >= settings.stop_items)
    stop[_needed(items, item_text, index, seen, stop, settings.telling)] = False
    latent.weight = np.where(stop, 0.0, (np.log((n + 1) / (seen + 1)) + 1e-3) ** settings.power)
    width = min(settings.rank + settings.oversampling, len(rows))
    omega = np.linalg.qr(np.random.default_rng(settings.seed).normal(size=(len(rows), width)))[0]
    latent.projection = (omega * latent.weight[:, None]).astype(np.float32)

    def sketch(settings, weight, projection, texts, total):
        ids, row, owner, _, follows = halves(texts, weight, settings.half)
        if not len(ids):
            return
        seen = _paired(_sums(projection, ids, row), follows)  # a Omega of each passage
        both = seen.copy()
        after = np.flatnonzero(follows) + 1
        both[after] += seen[after - 1]  # a half is in the passage that it begins and in the one before
        order = np.argsort(ids.astype(np.uint16) if len(weight) < 1 << 16 else ids, kind="stable")
        own_ids = ids[order]
        words_, number = np.unique(own_ids, return_inverse=True)
        total[words_] += _sums(both, row[order], number) * weight[words_, None]

    y = _pass(tokens, latent, sketch, width)
    scratch.drop()
    shift = 1e-9 * np.linalg.norm(y) + 1e-12
    y = y + shift * omega
    inner = omega.T @ y
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    keep = values > 1e-12 * max(values.max(), 1e-300)
    u, s, _ = np.linalg.svd((y @ vectors[:, keep]) / np.sqrt(values[keep]), full_matrices=False)
    top = min(settings.rank, int((s > 1e-9 * max(s.max(initial=0), 1e-300)).sum()))
    latent.projection = (u[:, :top] * latent.weight[:, None]).astype(np.float32)
    return latent


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _passages(ids: list[int], step: int) -> list[list[int]]:
    """The whole item and, if it is longer than two halves, each pair of neighbouring halves, the last one up to its end."""
    starts = [*range(0, len(ids) - 2 * step, step), len(ids) - 2 * step] if len(ids) > 2 * step else []
    return [ids, *(ids[i : i + 2 * step] for i in starts)]


def _run(settings: Settings) -> int:
    return max(1, min(settings.min_words, 4))


BITMAP = 8  # words of 64 bits


def _marks(ids: np.ndarray) -> np.ndarray:
    """A bitmap of a set of words: one bit for each, by its number."""
    out = np.zeros(BITMAP, np.uint64)
    np.bitwise_or.at(out, ids // 64 % BITMAP, np.uint64(1) << (ids % 64).astype(np.uint64))
    return out


def _codes(ids: np.ndarray, run: int) -> np.ndarray:
    """A code of each run of that many words."""
    n = max(0, len(ids) - run + 1)
    code = np.zeros(n, np.uint32)
    for k in range(run):
        code *= np.uint32(0x9E3779B1)
        code += ids[k : k + n].view(np.uint32)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA77)
    return code ^ code >> np.uint32(13)


@dataclass
class Items:
    """Benchmark items ready for the search."""

    keys: list
    ids: list[list[int]]
    answers: list[list[int]]
    rare: list[set[int]]  # words that are no stop words
    telling: list[bool]  # the answer has such a word
    marks: np.ndarray  # of the rare words of each item, see _marks
    directions: np.ndarray  # of whole items and, of those longer than a passage, of their passages
    owners: np.ndarray  # the item of each direction, rising
    masks: list[dict[int, int]]
    answer_masks: list[dict[int, int]]
    anchors: dict[int, list[tuple[int, int]]]  # code of an item's most telling run of words -> items, and its place in them
    known: np.ndarray  # whether a code with these lowest bits is an anchor

    @staticmethod
    def of(rows: list, latent: Latent) -> Items:
        settings, keys, ids, answers = latent.settings, [], [], []
        for key, raw in rows:
            own = numbered(latent.numbers, raw).tolist()
            if len(own) < settings.min_words:
                continue
            parts = [p for p in (numbered(latent.numbers, x).tolist() for x in _SENTENCE.split(raw)) if p]
            keys.append(key), ids.append(own), answers.append(parts[-1])
        weight = np.append(latent.weight, 0.0)[latent.slots]  # of each word; the last entry is for unknown ones
        rare = [{w for w in i if weight[w] > 0} for i in ids]
        parts = [(i, part) for i, x in enumerate(ids) if len(x) >= settings.similar_words for part in _passages(x, settings.half)]
        sums = np.stack([latent.projection[latent.slots[part]].sum(axis=0) for _, part in parts]) if parts else np.zeros((0, max(1, latent.projection.shape[1])))
        run = _run(settings)
        anchors: dict[int, list[tuple[int, int]]] = {}
        known = np.zeros(1 << 20, bool)
        for i, own in enumerate(ids):
            at = int(np.convolve(weight[own], np.ones(run), "valid").argmax())
            code = int(_codes(np.array(own[at : at + run], np.int32), run)[0])
            anchors.setdefault(code, []).append((i, at))
            known[code & len(known) - 1] = True
        marks = np.stack([_marks(np.array(sorted(r), np.int64)) for r in rare]) if rare else np.zeros((0, BITMAP), np.uint64)
        return Items(keys, ids, answers, rare, [bool(r & set(a)) for r, a in zip(rare, answers, strict=True)], marks, _unit(sums).astype(np.float32), np.array([i for i, _ in parts], np.int64), [masks_of(i) for i in ids], [masks_of(a) for a in answers], anchors, known)


def _search(latent: Latent, items: Items, raws: list[bytes]) -> list[list[dict]]:
    texts = [numbered(latent.numbers, raw) for raw in raws]
    out = _similar(latent, items, texts)
    _exact(latent, items, texts, out)
    return [[d[i] for i in sorted(d)] for d in out]


def _exact(latent: Latent, items: Items, texts: list[np.ndarray], out: list[dict]) -> None:
    """Adds the items whose words are in a text one after the other, and that were not found by similarity."""
    if not items.keys or not texts:
        return
    run, step = _run(latent.settings), latent.settings.half
    flat = np.concatenate(texts)
    codes = _codes(flat, run)
    hits = np.flatnonzero(items.known[codes & np.uint32(len(items.known) - 1)])
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    for at, code, doc in zip(hits.tolist(), codes[hits].tolist(), (np.searchsorted(first, hits, side="right") - 1).tolist(), strict=True):
        for i, offset in items.anchors.get(code, ()):
            begin, ids = at - int(first[doc]) - offset, items.ids[i]
            if i not in out[doc] and begin >= 0 and texts[doc][begin : begin + len(ids)].tolist() == ids:
                out[doc][i] = {"item_id": items.keys[i], "cosine": None, "overlap": 1.0, "answer": 1.0, "at": begin // step * step}


def _around(ids: np.ndarray, row: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each half the bitmap of the weighted words from two halves before it to three after it."""
    own = np.zeros((len(owner), BITMAP), np.uint64)
    np.bitwise_or.at(own, (row, ids // 64 % BITMAP), np.uint64(1) << (ids % 64).astype(np.uint64))
    out = own.copy()
    for k in (-2, -1, 1, 2, 3):
        here = np.arange(max(0, -k), len(own) - max(0, k))
        there = here + k
        near = (owner[here] == owner[there]) & (place[there] - place[here] >= -2) & (place[there] - place[here] <= 3)
        out[here[near]] |= own[there[near]]
    return out


def _similar(latent: Latent, items: Items, texts: list[np.ndarray]) -> list[dict]:
    own, step = latent.settings, latent.settings.half
    out: list[dict] = [{} for _ in texts]
    weight = np.append(latent.weight, 0.0)[latent.slots]  # of each word
    numbers, row, owner, place, follows = halves(texts, weight[:-1], step)
    if not len(numbers) or not len(items.owners) or not latent.projection.size:
        return out
    passages = _unit(_paired(_sums(latent.projection, latent.slots[numbers], row), follows))
    marks = _around(numbers.astype(np.int64), row, owner, place)
    lengths = np.array([len(i) for i in items.ids])
    rare = np.array([len(r) for r in items.rare])
    alike = rare - np.bitwise_count(items.marks).sum(axis=1)  # words of an item that share their bit with another one
    span, last, around = max(1, 4_000_000 // len(items.owners)), -1, set()
    for at in range(0, len(passages), span):
        cosine = passages[at : at + span] @ items.directions.T
        p_, part = np.nonzero(cosine >= own.min_cosine)
        pair = p_ * len(items.keys) + items.owners[part]  # rising
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        best_cosine = np.maximum.reduceat(cosine[p_, part], starts) if len(starts) else np.zeros(0)
        p_, i_ = p_[starts], items.owners[part[starts]]
        # no fewer than the shared words, so no pair is lost; long items look further around
        most = np.bitwise_count(marks[at + p_] & items.marks[i_]).sum(axis=1) + alike[i_]
        open_ = np.flatnonzero((most >= own.min_shared * rare[i_]) | (lengths[i_] > 2 * step))
        for p, i, near_by in zip(p_[open_].tolist(), i_[open_].tolist(), best_cosine[open_].tolist(), strict=True):
            doc, begin = int(owner[at + p]), int(place[at + p]) * step
            if at + p != last:
                last, around = at + p, set(texts[doc][max(0, begin - 2 * step) : begin + 4 * step].tolist())
            length = len(items.ids[i])
            near = None if length <= 2 * step else texts[doc][max(0, begin - length) : begin + 2 * step + length].tolist()
            if len(items.rare[i] & (around if near is None else set(near))) < own.min_shared * len(items.rare[i]):
                continue
            near = near or texts[doc][max(0, begin - length) : begin + 2 * step + length].tolist()
            overlap = lcs_length(items.masks[i], length, near) / length
            if overlap < own.weak_overlap:
                continue
            answer = lcs_length(items.answer_masks[i], len(items.answers[i]), near) / max(1, len(items.answers[i]))
            told = items.telling[i] and answer >= own.min_answer
            best = out[doc].get(i)
            if (overlap >= own.min_overlap or told) and (best is None or (overlap, near_by) > (best["overlap"], best["cosine"])):
                out[doc][i] = {"item_id": items.keys[i], "cosine": near_by, "overlap": overlap, "answer": answer, "at": begin}
    return out


def find(docs: DataFrame, items: DataFrame, latent: Latent, text: str = "text", item: str = "item_id", item_text: str = "text", column: str = "leaks") -> DataFrame:
    """docs with an array of leaks: (item_id, cosine, overlap, answer, at), at: the first word of the passage.

    Items go to the tasks in blocks of a bounded size; a benchmark of more than one block is searched for block by block.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = dict(items.select(F.col(item).alias("k")).dtypes)["k"]
    own = items.where(F.col(item).isNotNull()).select(F.col(item).alias("k"), as_bytes(F.col(item_text)).alias("raw"))
    size = own.agg(F.sum(F.length("raw") + 64).alias("s")).first()["s"] or 0
    blocks = max(1, -(-size // latent.settings.block_bytes))
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_type(_parse_datatype_string(kind))
    shape = LEAK.format(kind)
    typed = pa.list_(pa.struct([("item_id", arrow), ("cosine", pa.float64()), ("overlap", pa.float64()), ("answer", pa.float64()), ("at", pa.int64())]))
    found = []
    for block in range(blocks):
        rows = sorted((r["k"], bytes(r["raw"])) for r in own.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block).collect())
        shared = spark.sparkContext.broadcast((latent, Items.of(rows, latent)))

        def search(batches, shared=shared):
            latent_, items_ = shared.value
            for b in batches:
                yield pa.array(_search(latent_, items_, b.to_pylist()), typed)

        found.append(F.arrow_udf(lean(search), shape, F.ArrowUDFType.SCALAR_ITER)(as_bytes(F.col(text))))
    return all_cores(docs).withColumn(column, F.concat(*found) if len(found) > 1 else found[0])
