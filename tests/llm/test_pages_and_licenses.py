"""WARC archives, main text of pages, license scans, and the pipeline."""

import gzip
import hashlib
import html
import io
import re

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from collatio.llm import decontamination, html_text, license_scan, warc
from collatio.llm.queries import ORACLE_SQL, QUERIES
from test_search import groups_of, shingles

SF = "/root/testdata/sf0.001"


# archives

PAGES = [(1, "http://a/", "x" * 1500), (9, "http://b/\r\nInjected: 1", "x" * 1500), (5, None, "x" * 1500), (2, "http://c/", None), (3, "http://c/", ""), (4, "u", "é" * 600), (7, "u", "é" * 600), (8, "u", "small"), (6, "u", "small"), (11, "u", "head\r\n\r\nbody" * 200), (11, "u", "head\r\n\r\nbody" * 200)]


def test_archives_come_back(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "payload", "k", "n", "keeper")})
    rows = sorted(tuple(r) for r in warc.round_trip(pages.repartition(3)).drop("url").collect())[:20]
    expected = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        same = [j for j, _, g in PAGES if (g or "") == (h or "")]
        again = len(raw) >= 1000 and i != max(same)
        expected.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    assert rows == sorted(expected)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_headers_push_down_and_payloads_stay_closed(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    path = warc.write(warc.to_records(pages))
    frame = warc.read(spark, path, payloads="none")
    assert frame.where("payload is not null").isEmpty() and frame.count() == len(PAGES)
    assert warc.read(spark, path).where("warc_type = 'revisit'").count() == 3
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("warc_type",), "revisit"), In(("record_id",), ("<urn:page:1>",)), GreaterThan(("payload_length",), 3)]))
    assert [type(f) for f in left] == [GreaterThan]
    got = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert [(r["record_id"], r["payload"]) for r in got] == [("<urn:page:1>", None)]
    urls = {r["target_uri"] for r in frame.collect()}
    assert "http://b/%0D%0AInjected: 1" in urls and None in urls


def test_archives_are_read_in_parts(spark):
    pages = spark.createDataFrame([(i, f"u{i}", hashlib.sha1(str(i).encode()).hexdigest() * (i % 40 + 1)) for i in range(400)], "page_id bigint, url string, html string").coalesce(1)
    path = warc.shared_path(spark, "warc")
    warc.register(spark)
    warc.to_records(pages).coalesce(1).write.format("warc").option("partition_bytes", 4000).option("archive_bytes", 60_000).mode("append").save(path)
    reader = warc.WarcReader({"path": path, "partition_bytes": "4000"})
    parts = reader.partitions()
    spans = [s for p in parts for s in p.spans]
    assert len(parts) > 10 and len({s.path for s in spans}) < len(spans)
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["target_uri"] for r in rows) == sorted(f"u{i}" for i in range(400))
    assert spark.read.format("warc").option("partition_bytes", 4000).load(path).where("warc_type = 'response'").count() == sum(r["warc_type"] == "response" for r in rows)


def record_bytes(kind, body, n=1):
    return warc.record({"record_id": f"<urn:page:{n}>", "warc_type": kind, "target_uri": "u", "payload_digest": None, "refers_to": None, "payload_length": len(body), "content_type": None, "payload": body})


@pytest.mark.parametrize("style", ["member", "gzip", "plain", "one gzip", "mixed"])
@pytest.mark.parametrize("piece", [7, 1 << 16])
def test_archives_of_other_writers(style, piece):
    parts = [record_bytes("response", bytes([65 + i]) * (i * 700), i) for i in range(6)] + [record_bytes("revisit", b"", 9)]
    pack = {"member": warc.member, "gzip": gzip.compress, "plain": lambda x: x}
    data = b"".join(parts) if style == "plain" else b"".join(pack[style](p) for p in parts) if style in pack else b"".join((warc.member if i % 2 else gzip.compress)(p) for i, p in enumerate(parts))
    if style == "one gzip":
        data = b"".join(gzip.compress(p, 9) for p in parts)
    for want in (0, 1, 2):
        got = list(warc.Inflated(io.BytesIO(data), piece).records(lambda h: want))
        assert len(got) == (7 if want else 0)
        for i, (headers, block) in enumerate(got[:6]):
            assert headers["warc-type"] == "response" and headers["warc-record-id"] == f"<urn:page:{i}>"
            assert block is None if want == 1 else block.endswith(b"\r\n\r\n" + bytes([65 + i]) * (i * 700))
    mixed = list(warc.Inflated(io.BytesIO(data), piece).records(lambda h: 2 if h["warc-record-id"] == "<urn:page:4>" else 0))
    assert len(mixed) == 1 and len(mixed[0][1].partition(b"\r\n\r\n")[2]) == 2800


def test_uncommitted_archives_are_not_read(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    path = warc.write(warc.to_records(pages))
    store, root = warc.opened(path)
    with store.open_output_stream(f"{root}/left-over.warc.gz", compression=None) as out:
        out.write(warc.member(record_bytes("response", b"lost")))
    assert warc.read(spark, path).count() == len(PAGES)
    warc.write(warc.to_records(pages.limit(2)), path)
    assert warc.read(spark, path).count() == len(PAGES) + 2


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_agree_with_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = [tuple(r) for r in got.select(*columns).collect()]
    theirs = c.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    shape = lambda rows: sorted(repr(tuple(round(x, 12) if isinstance(x, float) else x for x in r)) for r in rows)
    assert shape(mine) == shape(theirs)


# main text

LONG = "A paragraph that is long enough to be told from the menus and other small things around it, by its length alone."


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), ("   ", ""), ("<p>x", "x"), ("plain &lt;b&gt; &amp;amp; &nbsp; text", "plain <b> &amp; text"),
        (f"<nav><a>n</a></nav><article><h1>T</h1><p>{LONG}<p>b <i>c</i>d<br>e</article><footer>f</footer>", f"T\n{LONG}\nb cd e"),
        (f"<article><header><h1>T</h1></header><p>{LONG}</p><aside>s</aside><div class='ad'>ad</div><p>End.</p><form>f</form></article><article class='comment'><p>{LONG}</p></article>", f"T\n{LONG}\nEnd."),
        (f"<body><div id='cookie-notice'>{LONG}</div><div class=sidebar>{LONG}</div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></body>", f"Title\n{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><script>if (a<b) '</p>'</script><style>p{{}}</style><!-- <p>no</p> --><p>z</p>", f"{LONG}\nz"),
        ("<article><p>cut of", "cut of"), ("<article><p>a</p></article><foot", "a"), ("<article><p>a<!-- open", "a"), ("<article><p title='x>y\">a</p>", 'y">a'), ("<p class=\"a>b\">c</p>", "c"),
        ("<article><P>One\n  two</P><ul><li>three</li><li><a href=x>four</a></li></ul></article>", "One two\nthree\nfour"), ("<article></article>", ""),
        ("<article><p>a</p><p hidden>b</p><div style='display: none'>c</div><p class='hidden-gem'>d</p><p aria-hidden=true>e</p></article>", "a\nd"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("start", ["<html><head><title>t</title><body>", "<head><meta charset=x><title>a <b> c</title>", "<title>t</title><body>", "<body><button>", "<body><select name='a>b'>", "<svg>", "<object data=x>", "<iframe src=x />", "<canvas>", "<button>x<p>y</p><button>z</button>", "<svg><button>" * 500])
def test_missing_end_tags_lose_nothing(start):
    assert html_text.main_text(f"{start}<article><h1>T</h1><p>{LONG}</p></article><footer>f</footer>") == f"T\n{LONG}"
    assert html_text.main_text(f"<article><p>{LONG}</p><p>a</p><button>b</button><svg><text>c</text></svg><p>d</p><script>e") == f"{LONG}\na\nd"


@pytest.mark.parametrize("start", ["<div class='container has-sidebar'>", "<div class=no-sidebar>", "<div class='post comments-open'>", "<div class='page with-banner'>", "<div id='legal-news'>", "<form action=x>", "<div class=banner>", "<div class='content social'><div id=legal>", "<form><fieldset>"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_wrappers_are_no_furniture(start, tag):
    page = f"<body>{start}<nav>n</nav><{tag}><p>{LONG}</p><p>{LONG}</p></{tag}><div class='site-footer'>f</div><div class=related><p>r</p></div><div class='sidebar'><{tag}><p>s</p></{tag}></div></body>"
    assert html_text.main_text(page) == f"{LONG}\n{LONG}"


def article_of(page):
    blocks = re.split(r"<(?!/?b>|br>)[^>]*>", re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1])
    return "\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split())))


def by_windows(page, window=3, surge=86):
    """Line blocks by their definition, for pages like those of the tables: a plain reading of the markup, and every window summed."""
    page = re.sub(r"<!--.*?-->|<head>.*?</head>", "", page, flags=re.S)
    marked, lines = "<article>" in page, []
    inside, names = {"nav": 0, "footer": 0, "ad": 0, "article": 0}, []
    for i, part in enumerate(re.split(r"<((?!/?b>|br>)[^>]*)>", page)):
        if i % 2:
            name = part.strip("/").split()[0]
            key = "ad" if name == "div" else name
            if key == "ad" and "/" not in part:
                names.append('"ad"' in part)
            step = 0 if key not in inside or key == "ad" and not names[-1] else -1 if part.startswith("/") else 1
            inside[key] = inside.get(key, 0) + step
            if key == "ad" and "/" in part:
                names.pop()
            heading = part == "h1"
            continue
        text = " ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", part))).split())
        if text:
            light = inside["nav"] or inside["footer"] or inside["ad"] or marked and not inside["article"]
            lines.append((text, 0 if light else len(text), heading))
    w = [x for _, x, _ in lines]
    total = lambda a, b: sum(w[a : min(a + window, b)])
    n = len(w)
    run = lambda i: [j for j in range(n) if all(total(k, n) for k in range(min(i, j), max(i, j) + 1))]
    head = {j for j in range(n) if lines[j][2] or marked and w[j] and (j == 0 or not w[j - 1])}
    sections = {}
    for j in range(n):
        if w[j] or total(j, n):
            first = next((k for k in range(j, -1, -1) if k in head or not total(k, n)), 0)
            first = first if total(first, n) and first in head else next(k for k in run(j) if w[k])
            if j >= first:
                sections.setdefault(first, []).append(j)
    peak = {f: max(total(j, s[-1] + 1) for j in s) for f, s in sections.items()}
    least = min(surge, max(peak.values(), default=0))
    kept = set()
    for f in sorted(sections):
        if peak[f] < least or f in kept:
            continue
        start = f if f in head else next(j for j in sections[f] if w[j] and total(j, sections[f][-1] + 1) >= least)
        own = run(f)
        before = [k for k in sorted(sections, reverse=True) if k < f and k in own] if start in head else []
        for k in before:
            if k not in head:
                break
            start = k
        kept |= {j for j in own if j >= start}
    return "\n".join(t for j, (t, x, _) in enumerate(lines) if j in kept and x)


def test_pages_of_the_tables(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op8_html_extraction"](spark, SF).collect():
        assert r["text"] == article_of(pages[r["page_id"]]) == by_windows(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("gone, share", [(r' class="[^"]*"', 1), (r"</?article>", 0.99), (r'</?article>| class="[^"]*"', 0.95)])
def test_pages_without_names(gone, share):
    """Without the marks of articles and adverts the windows alone find the text, as their definition does."""
    right, pages = 0, [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).to_pylist()]
    for page in pages:
        bare = re.sub(gone, "", page)
        got = html_text.main_text(bare)
        assert got == by_windows(bare)
        right += got == article_of(page)
    assert right >= share * len(pages)


def test_sections_without_a_large_one_stay():
    page = "<article>" + "".join(f"<h2>Part {i}</h2><p>some words</p>" for i in range(9)) + "</article>"
    assert html_text.main_text(page) == "\n".join(f"Part {i}\nsome words" for i in range(9))
    assert html_text.main_text("<p>menu</p><p>more</p>" + f"<h1>T</h1><p>{LONG}</p>" + "<ul><li><a>x</a></li><li><a>y</a></li><li><a>z</a></li></ul><p>end</p>") == f"T\n{LONG}"


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<p>" * 20000 + "deep"), (3, "<article>" + f"<p>{LONG}</p>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").withColumn("main_text", F.lit(1)).withColumn("lines", F.lit(2))
    got = sorted(html_text.extract(pages).select("page_id", F.length("main_text")).collect())
    assert [tuple(r) for r in got] == [(1, 0), (2, 0), (3, 4), (3, 3000 * (len(LONG) + 1) - 1)]
    assert html_text.extract(pages.limit(0)).count() == 0


# licenses


def base_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hits = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_base_places(spark):
    texts = [None, "", "...", "MIT License", "the mit-license mit license, MIT!LICENSE", "cc by cc by-nc 4.0 CC BY", "Apache License Apache", "gnu general public", "GNU General Public License v3 gnu general public license", "mit\x00license", "Ünder the mit licensé", "x " * 30000 + "cc by", "mit mit license"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("id", "h", "k", "words", "place", "pair", "template")})
    got = {r["doc_id"]: r for r in license_scan.scan(docs.union(docs.where("doc_id = 4"))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_scan(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert license_scan.scan(docs.limit(0)).count() == 0
    assert license_scan.scan(docs.where("doc_id = 4").union(docs.where("doc_id = 4"))).count() == 2


def test_notices_with_changes(spark):
    notice = next(n for n, label in license_scan.NOTICES.items() if label == "mit-text")
    words = notice.split()
    put_in = " ".join([*words[:8], "extra", *words[8:]])
    left_out = " ".join([*words[:8], *words[9:]])
    docs = spark.createDataFrame(list(enumerate([f"a b {notice} c", put_in, left_out, " ".join(words[:6]), " ".join(reversed(words))])), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(docs).collect()}
    assert got[0] == ("mit-text", 1.0) and got[1][0] == "mit-text" and got[2][0] == "mit-text" and 0.8 < got[1][1] < 1
    assert got[3] == ("", 0.0) and got[4] == ("", 0.0)
    span = license_scan.spans(docs.where("doc_id = 0")).first()
    assert (span["first_word"], span["last_word"]) == (2, 1 + len(words))


def test_no_python_in_license_scans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = license_scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


# pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality classifier", "MinHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
    now, sizes = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    out = corpus_pipeline.run(spark, SF)
    ids = [r["doc_id"] for r in now.select("doc_id").collect()]
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(ids) and all(r["round_trip"] for r in rows)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in r["text"] for r in now.collect() for i in items)
    texts = [r["text"] for r in now.collect()]
    assert len(set(texts)) == len(texts)


def overlap(item, text):
    """The largest share of an item's words that is in order in some stretch of the text."""
    n, step, masks = len(item), 24, decontamination.masks_of(item)
    return max((decontamination.lcs_length(masks, n, text[max(0, b - n) : b + 2 * step + n]) / n for b in range(0, len(text), step)), default=0.0)


def test_pipeline_is_that_of_plain_versions(spark, tmp_path):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    items = {r["item_id"]: r["text"] for r in read("benchmark").collect()}
    rows = sorted((r.asDict() for r in read("documents").collect()), key=lambda r: r["doc_id"])
    long = [r for r in rows if r["text"] and 120 < len(r["text"].split()) < 400]
    for i, r in enumerate(long[:24]):
        words = r["text"].split()
        if i % 2:  # a near copy
            words[len(words) // 2] = "changed"
        else:  # a benchmark item with two words replaced
            item = items[sorted(items)[i]].split()
            item[3], item[-4] = "other", "words"
            words[60:60] = item
        rows.append(r | {"doc_id": 10_000 + i, "text": " ".join(words)})
    spark.createDataFrame(rows, read("documents").schema).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        read(name).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:  # trained models: tested by their held-out rows
        docs = stage(spark, docs, str(tmp_path))
    texts = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    group = groups_of([shingles(t, 5) for _, t in texts])
    distinct = [x for i, x in enumerate(texts) if group[i] == i]
    known = [decontamination.words(x.encode()) for x in items.values()]
    number = {w: i for i, w in enumerate(sorted({w for x in known for w in x}))}
    known = [[number[w] for w in x] for x in known if len(x) >= 5]
    most = {}
    for i, t in distinct:
        text = [number.get(w, -1) for w in decontamination.words(t.encode())]
        most[i] = max(overlap(x, text) for x in known)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect())
    assert len(set(kept)) == len(kept) and set(kept) <= set(most)
    assert {i for i, x in most.items() if x < 0.5} <= set(kept) <= {i for i, x in most.items() if x < 0.7}
    assert len(texts) - len(distinct) >= 5 and len(most) - len(kept) >= 5


def test_pipeline_stages_with_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the and of " * 20, "en", "s", 200), (3, "the and of " * 20, "en", "s", 200), (4, "der die und " * 20, "de", "s", -1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit(7) for c in ("k", "score", "leaks", "id")})
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, SF).columns == docs.columns
            stage(spark, frame, SF).collect()
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == frame.count()
