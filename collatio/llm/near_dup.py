"""Near-duplicate detection with SetSketch registers.

A document's set is its distinct word shingles. Every element runs a Poisson process over the registers, and a register
keeps the earliest arrival among all elements, stored as floor(1 - log_b(arrival)) in 16 bits: exponentially spaced,
truncated minima. Registers merge by maximum and agree with a probability close to the Jaccard similarity: with base 1.01
two sets without a common element share a register with a probability of 0.0025 and a band of five with 1e-13, so that
even among 10^11 sets a set meets less than one by chance, and the work grows with the input. Bands of registers propose pairs, a joint likelihood over the registers of both sides estimates their similarity, and pairs
that may pass are verified on the full sets.

Documents with equal sets fold into one before anything is compared. Within a bucket of a band no pairs are listed:
members are estimated against the bucket's pivot, and pairs that may pass join into families. Members of a bucket that
belong to another family than its pivot are estimated against the bucket's members of further families, so every two
sets that share a bucket are in one family or have been estimated. In a family each member is verified against one
likely neighbour, and the members outside its largest component are then counted against all of it exactly, in blocks
of bounded bytes that hold an inverted index, from which only links leave that join components not yet joined there.

Defined results: null or empty texts, and texts without a word, have an empty set, link with nothing and stay; a text
with fewer words than a shingle is one shingle; repeated rows each get a row; rows with a null id are never linked and
have a null component; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, all_cores, as_bytes, bounded_batches, lean, mix64, stored
from .components import connected_components

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SetSketch:
    """Registers of sets of 64-bit keys."""

    registers: int = 128  # a power of two
    base: float = 1.01
    rate: float = 20.0
    limit: int = 65_535

    def arrivals(self, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Earliest arrivals, sets x registers; keys holds the sets one after the other."""
        m = self.registers
        out = np.full((len(sizes), m), np.inf)
        enough = math.log(m) + 8.0
        owner = np.repeat(np.arange(len(sizes)), sizes)
        until = np.repeat(enough / (self.rate * np.maximum(sizes, 1)), sizes)
        self._run(out.reshape(-1), keys, owner, until)
        for row in np.flatnonzero(np.isinf(out).any(axis=1) & (sizes > 0)):
            own, span = keys[owner == row], enough / (self.rate * sizes[row])
            while np.isinf(out[row]).any():
                span *= 2
                out[row] = np.inf
                self._run(out[row], own, np.zeros(len(own), np.int64), np.full(len(own), span))
        return out

    def _run(self, flat: np.ndarray, keys: np.ndarray, owner: np.ndarray, until: np.ndarray) -> None:
        m = self.registers
        time, step = np.zeros(len(keys)), 0
        while len(keys):
            wide = max(1, min(64, 40_000 // len(keys)))  # several arrivals at once where few elements are left
            steps = np.arange(step + 1, step + wide + 1, dtype=np.uint64) * GOLDEN
            r = mix64(keys[:, None] + steps[None, :])
            at = time[:, None] + np.cumsum(-np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1) / (self.rate * m)
            inside = at < until[:, None]
            place = (owner * m)[:, None] + (mix64(r) & np.uint64(m - 1)).astype(np.int64)
            np.minimum.at(flat, place[inside], at[inside])
            on = inside[:, -1]
            keys, owner, until, time, step = keys[on], owner[on], until[on], at[on, -1], step + wide

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(s) for s in sets], np.int64)
        keys = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        first = self.arrivals(keys, sizes)
        with np.errstate(divide="ignore"):
            return np.clip(np.floor(1 - np.log(first) / math.log(self.base)), 0, self.limit).astype(np.uint16)

    def similarity(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 128) -> np.ndarray:
        """Jaccard similarity that makes the registers of both sides likeliest, given both sizes; row by row."""
        more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
        same = a.shape[1] - more - less
        u = (na / (na + nb))[:, None]
        v = 1 - u
        j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u)
        b_ = self.base
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (b_ - 1) / b_) / math.log(b_)
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        like = more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny) + same[:, None] * np.log(np.maximum(1 - up - down, tiny))
        return j[np.arange(len(j)), like.argmax(axis=1)]


class Shingles:
    """Distinct word shingles of a text as sorted 64-bit keys."""

    def __init__(self, width: int, remember: int = 150_000):
        self.width, self.remember, self.known = width, remember, {}

    def __call__(self, raw: bytes) -> np.ndarray:
        words, known = raw.lower().split(), self.known
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > self.remember:
            known.clear()
        try:
            keys = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            keys = np.array([known[w] for w in words], np.uint64)
        width = min(self.width, len(keys))
        n = len(keys) - width + 1
        out = np.full(n, width, np.uint64)
        for i in range(width):
            out = mix64(out * GOLDEN + keys[i : i + n])
        return np.unique(out)


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters: shingle width in words, and the least similarity in hundredths."""

    width: int = 5
    percent: int = 80
    rows: int = 5  # registers of a band
    slack: float = 0.2  # how far under the threshold an estimate may lie and still be verified; over six standard errors
    sketch: SetSketch = SetSketch()

    def sets(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(id, h, n, s1, s2, regs) of each row: hash of its text, size of its set, a 128-bit name of the set, its registers."""
        width, sketch = self.width, self.sketch
        kind = dict(docs.select(F.col(key).alias("id")).dtypes)["id"]

        def make(batches):
            shingles = Shingles(width)
            for b in batches:
                sets = [shingles(raw) for raw in b.column(1).to_pylist()]
                names = np.array([list(divmod(xxhash.xxh3_128_intdigest(s.tobytes()), 1 << 64)) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                regs = sketch(sets)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([r.tobytes() for r in regs], pa.binary())], ["id", "h", "n", "s1", "s2", "regs"])

        rows = docs.select(F.col(key).alias("id"), as_bytes(F.col(text)).alias("raw"), F.xxhash64(text).alias("h"))
        return all_cores(rows).mapInArrow(lean(make), f"id {kind}, h bigint, n bigint, s1 bigint, s2 bigint, regs binary")

    def estimated(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (u, v) whose registers allow the threshold."""
        sketch, least = self.sketch, self.percent / 100 - self.slack

        def keep(ra: pa.Array, rb: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
            m = sketch.registers
            a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, m) for x in (ra, rb))
            return pa.array(sketch.similarity(a, b, na.to_numpy().astype(float), nb.to_numpy().astype(float)) >= least)

        test = F.arrow_udf(keep, "boolean")
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("regs").alias(f"r{c}"), F.col("n").alias(f"n{c}"))
        return pairs.join(side("u"), "u").join(side("v"), "v").where((F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * self.percent) & test("ru", "rv", "nu", "nv")).select("u", "v")

    def verified(self, pairs: DataFrame, full: DataFrame) -> DataFrame:
        """The pairs (u, v) whose full sets pass the threshold."""
        percent = self.percent

        def passes(a: pa.Array, b: pa.Array) -> pa.Array:
            out = []
            for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            return pa.array(out)

        test = F.arrow_udf(passes, "boolean")
        side = lambda c: full.select(F.col("node").alias(c), F.col("elements").alias(f"e{c}"))
        return pairs.join(side("u"), "u").join(side("v"), "v").where(test("eu", "ev")).select("u", "v")

    def full_sets(self, docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
        """(node, elements) of the wanted nodes (node, id, s1, s2), from the texts again: sets of all rows are never stored."""
        width = self.width

        def make(batches):
            shingles = Shingles(width)
            for b in batches:
                out = []
                for raw, s1, s2 in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    s = shingles(raw).tobytes()
                    name = np.array(divmod(xxhash.xxh3_128_intdigest(s), 1 << 64), np.uint64).view(np.int64)
                    out.append(s if (name[0], name[1]) == (s1, s2) else None)  # another row under the same id
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["node", "elements"])

        residue = F.pmod(F.xxhash64("id"), F.lit(1 << 18))
        # at most 2^18 numbers: a proven bound for the broadcast, which keeps most other texts out of the shuffle
        some = F.broadcast(wanted.select(residue.alias("residue")).distinct())
        texts = docs.select(F.col(key).alias("id"), as_bytes(F.col(text)).alias("raw")).join(some, residue == some["residue"], "left_semi")
        texts = texts.join(wanted.select("node", "id", "s1", "s2"), "id").select("node", "raw", "s1", "s2")
        return texts.mapInArrow(lean(make), "node bigint, elements binary").where("elements is not null").dropDuplicates(["node"])

    def alike(self, a: str, b: str) -> Column:
        """Whether sizes and equal registers of two nodes allow the threshold: the same bound as ``estimated``, in the join."""
        def unequal(x: Column) -> Column:
            for k in (8, 4, 2, 1):  # the lowest bit of each register: whether any of its bits is set
                x = x.bitwiseOR(F.shiftrightunsigned(x, k))
            return F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))

        differing = F.transform(F.zip_with(f"l{a}", f"l{b}", lambda x, y: x.bitwiseXOR(y)), unequal)
        same = self.sketch.registers - F.aggregate(differing, F.lit(0), lambda x, y: x + y)
        j, base = self.percent / 100 - self.slack, self.sketch.base
        least = math.log(1 + j * (base - 1)) / math.log(base) * self.sketch.registers
        return (F.least(f"n{a}", f"n{b}") * 100 >= F.greatest(f"n{a}", f"n{b}") * self.percent) & (same >= int(least) - 1)

    def candidates(self, nodes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """Estimated pairs (u, v) that join all that may be linked into families, and (node, component) of the families."""
        rows, bands = self.rows, self.sketch.registers // self.rows
        # a bucket is named by the number of the band and its registers
        keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * 2 * rows + 1, F.lit(2 * rows))))
        entries = nodes.select("node", "id", F.explode(keys).alias("bucket"))
        # the smallest id is often what the others are copies of, and so more like all of them than they are among themselves
        pivots = entries.groupBy("bucket").agg(F.min(F.struct("id", "node"))["node"].alias("pivot"), F.count(F.lit(1)).alias("k")).where("k > 1")
        shared = scratch.stored(entries.drop("id").join(pivots, "bucket"), "buckets")  # only buckets that hold more than one set
        near = scratch.stored(self.estimated(shared.where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct(), nodes), "pairs")
        family = scratch.stored(connected_components(near, scratch), "families")

        # every member has been estimated against its pivot; what is left are pairs without the pivot, in buckets of three or more
        of = lambda c, name: family.select(F.col("node").alias(c), F.col("component").alias(name))
        now = shared.where("k > 2 and node <> pivot").join(of("node", "f"), "node", "left").join(of("pivot", "pf"), "pivot", "left").select("bucket", "node", F.coalesce("f", "node").alias("f"), F.coalesce("pf", "pivot").alias("pf"))
        now = scratch.stored(now, "members")
        strays = now.where("f <> pf").select("bucket", F.col("node").alias("a"), F.col("f").alias("fa"))
        mates = now.join(strays.select("bucket").distinct(), "bucket", "left_semi").select(F.col("bucket").alias("sb"), F.col("node").alias("b"), F.col("f").alias("fb"))
        lanes = F.array(*[F.conv(F.hex(F.substring("regs", 8 * i + 1, 8)), 16, -10).cast("bigint") for i in range(self.sketch.registers // 4)])
        known = lambda df, c: df.join(nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), lanes.alias(f"l{c}")), c)
        across = known(strays, "a").join(known(mates, "b"), (F.col("fa") != F.col("fb")) & self.alike("a", "b") & (F.col("sb") == F.col("bucket")))
        more = scratch.stored(self.estimated(across.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().join(near, ["u", "v"], "left_anti"), nodes), "pairs")
        if more.isEmpty():
            return near, family
        near = near.union(more)
        return near, scratch.stored(connected_components(near, scratch), "families")

    def links(self, nodes: DataFrame, docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
        """(node, component) of the nodes (node, id, n, s1, s2, regs) that are linked to another one."""
        near, family = self.candidates(nodes, scratch)
        full = scratch.stored(self.full_sets(docs, nodes.join(family, "node", "left_semi"), key, text), "sets")
        star = near.union(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("v"))
        good = scratch.stored(self.verified(star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), full), "links")
        linked = connected_components(good, scratch)
        member = family.select("node", F.col("component").alias("f")).join(linked, "node", "left").join(nodes.select("node", "n"), "node")
        member = scratch.stored(member.select("node", "f", F.coalesce("component", "node").alias("c"), "n"), "members")
        more = scratch.stored(self.within(member, full), "links")
        return linked if more.isEmpty() else connected_components(good.union(more), scratch)

    def within(self, member: DataFrame, full: DataFrame, block_bytes: int = 4 << 20, least_bytes: int = 256 << 10) -> DataFrame:
        """Links (u, v) between components (c) of one family (f), enough to join all that are linked.

        The members (node, f, c, n) outside a family's largest component are counted against all its members, in blocks
        of a sixteenth of the family, but not under ``least_bytes`` nor over ``block_bytes``.
        """
        percent = self.percent
        part = member.groupBy("f", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
        whole = part.groupBy("f").agg(F.max(F.struct("k", "c", "n")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        pieces = lambda n: F.ceil(n * 8 / F.least(F.lit(block_bytes), F.greatest(F.lit(least_bytes), n / 2)))
        plan = whole.select("f", F.col("top.c").alias("main"), pieces(F.col("n") - F.col("top.n")).alias("nx"), pieces(F.col("n")).alias("nm"))
        own = member.join(plan, "f").join(full, "node")
        salt = lambda n: F.pmod(F.xxhash64("node"), n)
        left = own.where("c <> main").select("f", salt(F.col("nx")).alias("x"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nm") - 1)).alias("m"), "node", "c", "elements")
        again = lambda c: F.col(c).alias(c)  # noqa: E731  else both sides of the cogroup hold the same columns
        right = own.select(again("f"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nx") - 1)).alias("x"), salt(F.col("nm")).alias("m"), again("node"), again("c"), again("elements"))
        def count(ours, theirs):
            sets = [np.frombuffer(e, np.uint64) for e in theirs.column("elements").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            ids, parts = theirs.column("node").to_pylist(), theirs.column("c").to_pylist()
            number = {c: i for i, c in enumerate(dict.fromkeys([*parts, *ours.column("c").to_pylist()]))}
            part_of = np.array([number[c] for c in parts])
            joined = np.arange(len(number))  # the components of this block, by what links them so far
            u, v = [], []
            if len(sets):
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                for node, c, e in zip(ours.column("node").to_pylist(), ours.column("c").to_pylist(), ours.column("elements").to_pylist(), strict=True):
                    e = np.frombuffer(e, np.uint64)
                    lo, hi = np.searchsorted(flat, e, "left"), np.searchsorted(flat, e, "right")
                    spans = hi - lo
                    at = np.repeat(lo - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
                    both = np.bincount(owner[at], minlength=len(sets))
                    passed = np.flatnonzero(100 * both >= percent * (len(e) + sizes - both))
                    here = joined[number[c]]
                    reached, first = np.unique(joined[part_of[passed]], return_index=True)
                    anew = reached != here  # a link that joins nothing new does not leave, so there are fewer of them than components
                    for i in passed[first[anew]]:
                        u.append(max(node, ids[i])), v.append(min(node, ids[i]))
                    if anew.any():
                        joined[np.isin(joined, reached)] = here
            return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

        block = ["f", "x", "m"]
        return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(count, "u bigint, v bigint").distinct()

    def groups(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """Per row: id, h, n, component (a number, null for rows in no group), component_id (its smallest id); stored."""
        bounded_batches(docs.sparkSession)
        scratch = Scratch(docs.sparkSession, "near-duplicates")
        sets = scratch.stored(self.sets(docs, key, text), "sketches")
        linked = sets.where("n > 0 and id is not null")
        # nodes are numbered, as ids may repeat; the numbers are fixed by storing them
        nodes = linked.groupBy("s1", "s2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("regs").alias("regs"))
        nodes = scratch.stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        found = scratch.stored(self.links(nodes, docs, key, text, scratch), "found")
        lead = found.join(nodes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("lead"))
        named = nodes.select("s1", "s2", "node", "id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = named.join(lead, "component", "left").select("s1", "s2", "component", F.coalesce("lead", "id").alias("component_id"))
        columns = ["id", "h", "n", "component", "component_id"]
        apart = sets.where("n = 0 or id is null").withColumns({"component": F.lit(None).cast("bigint"), "component_id": F.col("id")}).select(columns)
        result = stored(linked.select("id", "h", "n", "s1", "s2").join(named, ["s1", "s2"], "left").select(columns).union(apart), "groups")
        del sets, linked, nodes, found, lead, named, apart
        scratch.drop()
        return result

    def __call__(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Per row: (key), n_shingles, component_id (the smallest id reachable), kept."""
        kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
        return self.groups(docs, key, text).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))

    def kept(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The rows of docs that stay, one of each group, with their columns as they are.

        Rows are told apart by id and text, so one that clashes with another's id neither goes nor stays with it. Of a
        group the row with the smallest id stays, of its texts under that id the one with the smallest hash, and once if
        the row repeats. Rows without an id or without a word are in no group and stay."""
        found = self.groups(docs, key, text)
        grouped = found.where("component is not null")
        several = grouped.where("id = component_id").groupBy("component").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("k")).where("k > 1")
        several = stored(several, "several").alias("s")  # components whose smallest id is on several rows: ids that repeat
        own = F.col("id") == F.col("component_id")
        if not several.isEmpty():
            grouped = grouped.join(several.select(F.col("component").alias("sc"), F.col("h").alias("sh")), F.col("component") == F.col("sc"), "left")
            own = own & ((F.col("h") == F.col("sh")) | F.col("sh").isNull())
        gone = grouped.where(~own).select(F.col("id").alias("__id"), F.col("h").alias("__h")).distinct()
        residue = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 18))
        # at most 2^18 numbers: a proven bound for the broadcast. Rows whose number no lost id has stay where they are
        touched = lambda ids: F.broadcast(ids.select(residue("__id").alias("__residue")).distinct())
        some, same = touched(gone), (F.col(key) == F.col("__id")) & (F.xxhash64(text) == F.col("__h"))
        sure = docs.join(some, residue(key) == some["__residue"], "left_anti")
        rest = docs.join(some, residue(key) == some["__residue"], "left_semi")
        left = sure.union(rest.join(gone, same, "left_anti"))
        if several.isEmpty():
            return left
        repeated = grouped.where(own).select(F.col("id").alias("__id"), F.col("h").alias("__h")).join(several.select(F.col("h").alias("__h")).distinct(), "__h", "left_semi").distinct()
        return left.join(repeated, same, "left_anti").union(left.join(repeated, same, "left_semi").dropDuplicates([key, text]))
