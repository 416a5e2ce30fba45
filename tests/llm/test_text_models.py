"""Language ID, quality classifier, language model and segmentation against plain versions."""

import heapq
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from collatio.llm import common, language_id, lm_score, quality, segmentation
from collatio.llm.common import held_out
from collatio.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "x"), (5, "x"), (6, "Ünïcode ▁ text \U0001d518\x00 end"), (7, "word " * 30000), (None, "the and of")]
ODD_SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def odd(spark):
    clashes = {c: F.lit(1) for c in ("score", "lang_pred", "raw", "id", "n", "tokens", "block", "k", "y", "c0", "segmentation", "leaks")}
    return spark.createDataFrame(ODD, ODD_SCHEMA).withColumns(clashes | {"lang": F.lit("en"), "n_chars": F.length("text").cast("bigint")})


# language ID


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.97 and got.count() == docs.count()
    assert got.where("score < 0 or score > 1").isEmpty()


def test_own_dictionary_gives_fewer_bytes():
    model = language_id.LanguageModel({"a": b"the and of " * 40, "b": b"der die und " * 40}, {"a": [b""], "b": [b""]})
    sizes = language_id.Sizes(model)
    assert sizes.names == ["a", "b"]
    small, large = sizes(b"the and of the and of the and of"), sizes(b"die und der die und der die und")
    assert small[0] < small[1] and large[1] < large[0]


def test_language_of_odd_texts(odd):
    model = language_id.fit(odd)
    rows = [(r["doc_id"], r["g"]["lang_pred"], r["g"]["accepted"]) for r in language_id.predict(odd, model, column="g").collect()]
    assert len(rows) == len(ODD)
    assert {r[1] for r in rows if r[0] in (1, 2, 3)} == {"und"} and not any(r[2] for r in rows if r[0] in (1, 2, 3))
    assert {r[1] for r in rows if r[0] in (4, 7)} == {"en"}
    empty = odd.limit(0)
    assert language_id.predict(empty, language_id.fit(empty), column="g").count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["g"]["lang_pred"] for r in language_id.predict(unlabelled, language_id.fit(unlabelled), column="g").collect()} == {"und"}


def test_languages_of_few_texts_keep_a_dictionary(spark):
    rows = [(i, f"the w{i} and of it is was in that {i % 7}", "en") for i in range(2000)]
    for text in ("el perro de la casa que no es", "los que no la han visto en el mar", "un dia de estos que viene", "por la calle de la luna"):
        docs = spark.createDataFrame(rows + [(5000 + i, text, "es") for i in range(900)], "doc_id bigint, text string, lang string")
        model = language_id.fit(docs)
        assert sorted(model.dictionaries) == ["en", "es"] and text[:5].encode() in model.dictionaries["es"] + b"".join(model.primers["es"])
        got = language_id.predict(docs.where("doc_id in (3, 5000)"), model, column="g").select("lang", "g.lang_pred").collect()
        assert {r["lang"]: r["lang_pred"] for r in got} == {"en": "en", "es": "es"}
    again = language_id.fit(docs.repartition(5))
    assert again == language_id.fit(docs)
    with pytest.raises(ValueError):
        language_id.fit(docs, max_languages=1)


def test_languages_are_those_of_plain_compression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.where(~held_out(F.col("doc_id"), 4)))
    got = {r["doc_id"]: r["lang_pred"] for r in QUERIES["op7_language_id"](spark, SF).collect()}
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=3, target_length=16, window_log=18, chain_log=16, hash_log=16, write_content_size=0, write_checksum=0, write_dict_id=0)
    for r in docs.collect():
        words, data = re.findall(r"[^\W\d_]+", (r["text"] or "").lower()), []
        for w in words:
            if not data or data[-1] != w:
                data.append(w)
        data = " ".join(data).encode()
        if not data:
            assert got[r["doc_id"]] == "und"
            continue
        sizes = {}
        for name, content in model.dictionaries.items():
            size = lambda x, content=content: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress(x))
            used = model.primers[name][: max(1, 2048 // len(data))]
            sizes[name] = sum(size(p + data[i : i + 4096]) - size(p) for i in range(0, len(data), 4096) for p in used) / len(used)
        assert sizes[got[r["doc_id"]]] <= min(sizes.values()) + 2  # a dictionary read anew may give a byte more or less


# quality


def test_machine_scores_all_pairs():
    rng = np.random.default_rng(0)
    model = quality.FactorisationMachine(0.3, rng.normal(size=quality.FEATURES).astype(np.float32), rng.normal(size=(quality.FEATURES, 4)).astype(np.float32))
    rows = [(rng.choice(quality.FEATURES, n, replace=False).astype(np.int32), rng.normal(size=n).astype(np.float32) * 0.2) for n in (1, 5, 12)]
    for (idx, val), got in zip(rows, model.scores(rows), strict=True):
        z = 0.3 + (model.w[idx] * val).sum()
        for i in range(len(idx)):
            for j in range(i + 1, len(idx)):
                z += float(model.v[idx[i]] @ model.v[idx[j]]) * val[i] * val[j]
        assert got == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op1_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right = got.select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.97


def test_quality_of_odd_texts(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (6, 0), (None, 1), (99, None)], "doc_id bigint, quality int")
    model = quality.fit(odd, labels)
    scored = quality.score(odd.withColumn("n_chars", F.when(F.col("doc_id") != 4, F.col("n_chars"))), model)
    rows = scored.collect()
    assert len(rows) == len(ODD) and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert len({r["quality_score"] for r in rows if r["doc_id"] == 5}) == 1
    assert quality.score(odd.limit(0), quality.fit(odd.limit(0), labels)).count() == 0
    same = quality.fit(odd, spark.createDataFrame([(4, 1)], "doc_id bigint, quality int"))
    assert {round(r["quality_score"], 6) for r in quality.score(odd, same).collect()} == {round(2 / 3, 6)}


# language model


def brute_scores(docs, learn, own):
    """Scores by the definition, with plain dictionaries."""
    texts = [((t or "").encode().lower().split() + [None]) for _, t in docs]
    c = Counter(w for t, f in zip(texts, learn) if f for w in t)
    n, v = sum(c.values()), len(c)
    frequent = {w for w, k in c.items() if k >= max(1, math.ceil(own.word_share * n))}
    least = max(1, math.ceil(own.ngram_share * n))
    grams = [{(w,): k for w, k in c.items() if w in frequent}]
    for length in range(2, own.order + 1):
        counts = Counter()
        for t, f in zip(texts, learn):
            if f:
                counts.update(g for i in range(len(t) - length + 1) if (g := tuple(t[i : i + length]))[:-1] in grams[-1] and g[1:] in grams[-1])
        grams.append({g: k for g, k in counts.items() if k >= least})
    used = [defaultdict(float) for _ in grams]
    for m in range(1, len(grams)):
        for g, k in grams[m].items():
            used[m][g[:-1]] += (k - own.discount) / grams[m - 1][g[:-1]]

    def p(history, w):
        if not history:
            return (c.get(w, 0) + 1) / (n + v + 1)
        m = len(history)
        lower = p(history[1:], w)
        if history not in grams[m - 1]:
            return lower
        k = grams[m].get(history + (w,))
        left = max(1 - used[m][history], 1e-12) if history in used[m] else 1.0
        return ((k - own.discount) / grams[m - 1][history] if k else 0.0) + left * lower

    return n, [(len(t), sum(w in c for w in t), sum(math.log10(p((), w)) for w in t), sum(math.log10(p(tuple(t[max(0, i - own.order + 1) : i]), w)) for i, w in enumerate(t))) for t in texts]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores_are_those_of_the_definition(spark, order):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()] + ODD[:6]
    docs = spark.createDataFrame(rows, ODD_SCHEMA).repartition(3)
    own = lm_score.Settings(order=order, word_share=1e-3, ngram_share=5e-4, block_tokens=2000, bucket_keys=500)
    learn = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    n, expected = brute_scores(rows, learn, own)
    got = lm_score.score(docs, train=~held_out(F.col("doc_id"), 7), settings=own).collect()
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {n}
    by_id = defaultdict(list)
    for (i, _), e in zip(rows, expected):
        by_id[i].append(e)
    for r in got:
        near = [e for e in by_id[r["doc_id"]] if e[:2] == (r["n_tokens"], r["n_known"]) and e[2] == pytest.approx(r["base_score"], rel=1e-9) and e[3] == pytest.approx(r["score"], rel=1e-9)]
        assert near, r


def test_lm_states_grow_with_the_corpus(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 2000) % 20000)) for i in range(160)]  # 1/250,000 of the tokens is more than one
    learn = [i % 10 != 0 for i, _ in rows]
    n, expected = brute_scores(rows, learn, lm_score.Settings(word_share=0.0, ngram_share=0.0))
    assert n > 250_000
    docs = spark.createDataFrame(rows, ODD_SCHEMA).repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, train=F.col("doc_id") % 10 != 0).collect()}
    assert got == {i: pytest.approx(e[3], rel=1e-9) for (i, _), e in zip(rows, expected)}


@pytest.mark.parametrize("piece", [1, 2, 7, 512])
def test_pieces_of_long_texts_carry_their_state(piece, spark):
    docs = spark.createDataFrame([(1, "a b a c a b " * 30), (2, "b a c"), (3, "c c a b " * 9), (4, None)], ODD_SCHEMA)
    rows = [tuple(r) for r in docs.collect()]
    _, expected = brute_scores(rows, [True, False, True, True], lm_score.Settings(word_share=0.0, ngram_share=0.0))
    blocks = lm_score.blocks_of(docs.coalesce(1), "doc_id", "text", F.col("doc_id") != 2, lm_score.Settings()).collect()
    block = lm_score.Block(blocks[0].asDict(), None)
    totals = [plain_totals(block, length, 3) for length in (1, 2, 3)]
    n = int(block.learn.sum())
    automaton = lm_score.Automaton(block, totals, n, int((totals[0][0] > 0).sum()), 1, lm_score.Settings())
    sums = np.add.reduceat(automaton.read(piece), block.starts)
    assert sums.tolist() == [pytest.approx(e[3], rel=1e-9) for e in expected]


def plain_totals(block, length, order):
    """What all blocks together would say of a block that is alone."""
    keys, number = block.grams(length)
    out = np.zeros((4, len(keys)), np.int64)
    out[0] = block.counts(number, len(keys))
    if length < order:
        _, longer = block.grams(length + 1)
        seen = set()
        out[3] = out[0]
        for at in np.flatnonzero((longer >= 0) & block.learn):
            history = number[at - 1]
            out[3, history] -= 1
            if longer[at] not in seen:
                seen.add(longer[at])
                out[2, history] += 1
    return out


def test_lm_scores_with_the_settings_of_the_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted(tuple(r) for r in docs.collect())
    learn = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    _, expected = brute_scores(rows, learn, lm_score.Settings())
    got = {r["doc_id"]: r for r in QUERIES["op5_lm_scoring"](spark, "/root/testdata/sf0.01").collect()}
    for (i, _), e in zip(rows, expected, strict=True):
        assert (got[i]["n_tokens"], got[i]["n_known"]) == e[:2]
        assert got[i]["base_score"] == pytest.approx(e[2], rel=1e-9) and got[i]["score"] == pytest.approx(e[3], rel=1e-9)


def test_two_models_do_not_mix(spark):
    docs = spark.createDataFrame([(1, "a b a c"), (2, "b a c"), (3, "c c a b")], ODD_SCHEMA)
    rows = [tuple(r) for r in docs.collect()]
    for keep in (1, 2, 1):
        _, expected = brute_scores(rows, [i != keep for i, _ in rows], lm_score.Settings())
        got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, train=F.col("doc_id") != keep).collect()}
        assert got == {i: pytest.approx(e[3], rel=1e-9) for (i, _), e in zip(rows, expected)}


def test_lm_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "a b a c a b"), (2, "b a c"), (3, "c c a b")], ODD_SCHEMA)
    probes = ["a", "b", "c", "zzz"]
    asked = docs.union(spark.createDataFrame([(100 + i, f"a b {w}") for i, w in enumerate(probes)] + [(99, "a b")], ODD_SCHEMA))
    own = lm_score.Settings(word_share=1e-9, ngram_share=1e-9)
    got = {r["doc_id"]: r["score"] for r in lm_score.score(asked, train=F.col("doc_id") < 99, settings=own).collect()}
    _, texts = brute_scores([(1, "a b a c a b"), (2, "b a c"), (3, "c c a b"), (99, "a b")], [True] * 3 + [False], own)
    assert got[99] == pytest.approx(texts[-1][3])


def test_lm_of_odd_texts(spark, odd):
    rows = lm_score.score(odd, train=F.lit(False)).collect()
    assert len(rows) == len(ODD) and all(r["score"] == 0 and r["n_known"] == 0 for r in rows)
    assert sorted(r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)) == [1, 1, 1]
    assert len(lm_score.score(odd).collect()) == len(ODD)
    assert lm_score.score(odd.limit(0)).count() == 0


# segmentation


@pytest.fixture(scope="module")
def vocabulary():
    return segmentation.Pieces(segmentation.model_bytes())


def every_segmentation(vocabulary, text):
    out, marked = [], (" " + text).replace(" ", segmentation.MARK)

    def go(i, score, ids):
        if i == len(marked):
            out.append((score, tuple(ids)))
            return
        alone = True
        for j in range(i + 1, len(marked) + 1):
            piece = vocabulary.table.get(marked[i:j])
            if piece and piece[0] >= 0:
                go(j, score + piece[1], [*ids, piece[0]])
                alone &= j > i + 1
        if alone:
            raw = (" " + text)[i].encode()
            go(i + 1, score + vocabulary.lost * len(raw), [*ids, *(vocabulary.bytes[b] for b in raw)])

    go(0, 0.0, [])
    return sorted(out, reverse=True)


@pytest.mark.parametrize("text", ["hello wor", "the end", "ab  cd\ne", "thntion é𝔘", "a", "x,y.z"])
def test_n_best_are_the_best_of_all(vocabulary, text):
    every = every_segmentation(vocabulary, text)
    got = vocabulary.encode(text, 30)
    assert [s for s, _ in got] == pytest.approx([s for s, _ in every[:30]])
    scores = {ids: s for s, ids in every}
    found = [tuple(ids.tolist()) for _, ids in got]
    assert len(set(found)) == len(found) and all(scores[f] == pytest.approx(s) for f, (s, _) in zip(found, got))
    assert all(vocabulary.decode(list(f)) == text.encode() for f in found)


def plain_best(vocabulary, text, n):
    """The n best scores over the whole lattice of a text, by dynamic programming over sorted lists."""
    marked, before = (" " + text).replace(" ", segmentation.MARK), [[] for _ in range(len(text) + 2)]
    before[0] = [0.0]
    longest = max(map(len, vocabulary.table))
    for i in range(len(marked)):
        before[i] = heapq.nlargest(n, before[i])
        alone = True
        for j in range(i + 1, min(len(marked), i + longest) + 1):
            piece = vocabulary.table.get(marked[i:j])
            if piece and piece[0] >= 0:
                before[j] += [s + piece[1] for s in before[i]]
                alone &= j > i + 1
        if alone:
            before[i + 1] += [s + vocabulary.lost * len((" " + text)[i].encode()) for s in before[i]]
    return heapq.nlargest(n, before[-1])


def test_whole_documents_against_the_whole_lattice(spark, vocabulary):
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op6_sentencepiece"](spark, SF).collect()}
    for doc, text in rows:
        r = got[doc]
        assert r["n_best_scores"] == pytest.approx(plain_best(vocabulary, text, 4)), doc
        each = [r["ids"], *r["other_ids"]]
        assert len(set(map(tuple, each))) == len(each) == len(r["n_best_scores"]) == 4
        for ids, score in zip(each, r["n_best_scores"], strict=True):
            assert vocabulary.decode(ids) == text.encode()
            pieces = {i: s for i, s in vocabulary.table.values() if i >= 0}
            raw = set(vocabulary.bytes.values())
            assert sum(vocabulary.lost if i in raw else pieces[i] for i in ids) == pytest.approx(score)


@pytest.mark.parametrize("text", ["x" * 3000, "\u2581" * 70 + "a b", "\n\n  a\n", "\U0001d518" * 80, "ab" * 40 + " " * 90 + "c"])
def test_long_parts_are_searched_like_others(vocabulary, text):
    got = vocabulary.encode(text, 3)
    if segmentation.MARK not in text:
        assert [s for s, _ in got] == pytest.approx(plain_best(vocabulary, text, 3))
    assert all(vocabulary.decode(ids.tolist()) == text.encode() for _, ids in got)


def test_many_texts_take_little_more_memory_than_few(vocabulary):
    words = ["".join(chr(97 + (i * k) % 26) for k in (1, 3, 5, 7, 11, 17)) + str(i) for i in range(120_000)]
    texts = [" ".join(words[i : i + 400]) for i in range(0, len(words), 400)]
    vocabulary.forget()
    expected = [vocabulary.encode(t, 2) for t in texts[:3]]
    vocabulary.forget()
    tracemalloc.start()
    got = vocabulary.encode_many(texts, 2)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak - kept < 60e6, (peak, kept)
    assert [[(score, ids.tolist()) for score, ids in g] for g in got[:3]] == [[(score, ids.tolist()) for score, ids in e] for e in expected]
    vocabulary.forget()


def test_what_is_remembered_is_bounded():
    small = segmentation.Pieces(segmentation.model_bytes(), remember=50)
    texts = [f"some w{i} words x{i * 7}" for i in range(400)]
    whole = segmentation.pieces(segmentation.model_bytes()).encode_many(texts, 2)
    for text, expected in zip(texts, whole, strict=True):
        got = small.encode(text, 2)
        assert [(s, i.tolist()) for s, i in got] == [(s, i.tolist()) for s, i in expected] and len(small.known.number) < 60


def test_round_trips(spark, odd):
    coded = segmentation.encode(odd, n=3, column="s", verify=True)
    rows = segmentation.decode(coded, "s.ids").select("doc_id", "text", "decoded", "s").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r["decoded"] == r["text"] and r["s"]["round_trip"] == (None if r["text"] is None else True)
        if r["text"] is None:
            assert r["s"]["ids"] is None and r["s"]["score"] is None and r["s"]["others"] is None
        else:
            scores = [r["s"]["score"], *(x["score"] for x in r["s"]["others"])]
            assert scores == sorted(scores, reverse=True) and (len(scores) == 3 or len(r["text"].strip()) < 2)
    others = segmentation.decode(coded.select("text", F.explode("s.others").alias("o")), "o.ids")
    assert others.where("decoded <> text").isEmpty()
    assert segmentation.encode(odd.limit(0)).count() == 0
    assert QUERIES["op6_sentencepiece"](spark, SF).where("not round_trip or round_trip is null").isEmpty()


# memory of executors


def test_languages_are_learnt_without_workers_for_rows_of_a_list(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "die Katze und der Hund", "de")], "doc_id bigint, text string, lang string")
    docs = docs.localCheckpoint()

    def refused(*args, **kwargs):
        raise AssertionError("an RDD of Python rows starts Python workers of its own on every executor")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert sorted(language_id.fit(docs).dictionaries) == ["de", "en"]


def test_workers_keep_nothing_of_other_operators(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    segmentation.pieces(segmentation.model_bytes())

    def double(batches):
        for b in batches:
            yield 2 * b

    assert list(common.lean(double, "segmentation")(iter([1, 2]))) == [2, 4] and segmentation._READY and given == [1]
    task = common.lean(double)(iter([1, 2]))
    assert next(task) == 2 and not segmentation._READY and given == [1]
    task.close()  # a task that is ended early
    assert given == [1, 1]
