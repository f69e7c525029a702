"""Media containers, HTML text and source mixing: round trips, definitions, brute force."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import html_text, media, mixing, registry, sql


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, source string, codec int").repartition(2)


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 64 * 16, 64 * 16 + 1, 64 * 33, 64 * 500 + 7])
def test_container_round_trip(size):
    data = random.Random(size).randbytes(size)
    payload = media.padded(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(data) and not payload[size:].strip(b"\0")
    box = media.pack(payload)
    p = media.probe(box)
    assert b"".join(box[a:b] for a, b in p["chunks"]) == payload
    assert [box[o : o + s] for o, s in zip(p["offsets"], p["sizes"])] == [payload[k : k + 64] for k in range(0, len(payload), 64)]
    assert p["keys"].tolist() == list(range(0, len(payload) // 64, media.KEY_EVERY)) and p["duration"] == len(payload) // 64


def test_other_writers_tables():
    """Variable sample sizes, 64-bit chunk offsets and box sizes, no sync table, unknown boxes, boxes to the end."""
    box, full = media._box, media._full
    big = lambda kind, body: struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body
    stbl = box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"abcd", bytes(8))), full(b"stsz", struct.pack(">II4I", 0, 4, 3, 5, 2, 7)),
        full(b"stsc", struct.pack(">I6I", 2, 1, 1, 1, 2, 3, 1)), full(b"co64", struct.pack(">I2Q", 2, 1000, 2000)), box(b"zzzz", b"?"),
    )
    mdhd = full(b"mdhd", struct.pack(">QQIQ", 0, 0, 90000, 1 << 33), bytes(4), version=1)
    data = box(b"free", bytes(5)) + big(b"moov", box(b"trak", box(b"mdia", mdhd, box(b"minf", stbl)))) + struct.pack(">I4s", 0, b"mdat") + bytes(9)
    p = media.probe(data)
    assert (p["codec"], p["timescale"], p["duration"]) == ("abcd", 90000, 1 << 33)
    assert p["offsets"].tolist() == [1000, 2000, 2005, 2007] and p["sizes"].tolist() == [3, 5, 2, 7] and p["keys"].tolist() == [0, 1, 2, 3]


def fragmented():
    """A movie without samples and two fragments of two tracks, with every kind of run field."""
    box, full, u = media._box, media._full, lambda *x: struct.pack(f">{len(x)}I", *x)

    def trak(number, kind, codec):
        stbl = box(b"stbl", full(b"stsd", u(1), box(codec, bytes(8))), full(b"stsz", u(0, 0)), full(b"stsc", u(0)), full(b"stco", u(0)))
        return box(b"trak", full(b"tkhd", u(0, 0, number, 0, 0)), box(b"mdia", full(b"mdhd", u(0, 0, 1000, 0)), full(b"hdlr", bytes(4), kind, bytes(12)), box(b"minf", stbl)))

    head = box(b"ftyp", b"iso5") + box(b"moov", trak(1, b"soun", b"mp4a"), trak(2, b"vide", b"avc1"), box(b"mvex", full(b"trex", u(2, 1, 40, 7, 0x10000)), full(b"trex", u(1, 1, 20, 5, 0))))
    video = box(b"traf", full(b"tfhd", u(2), flags=0), full(b"trun", u(3), struct.pack(">i", 100), u(0, 40, 11, 50, 12, 60, 13), flags=1 | 4 | 0x100 | 0x200))
    sound = box(b"traf", full(b"tfhd", u(1, 9), flags=16), full(b"trun", u(2), struct.pack(">i", 300), flags=1), full(b"trun", u(1)))
    return head + box(b"moof", full(b"mfhd", u(1)), video, sound) + box(b"mdat", bytes(400)), len(head)


def test_fragments_and_all_tracks(spark):
    data, at = fragmented()
    sound, video = media.probe_tracks(data)
    assert (sound["codec"], sound["duration"], sound["sizes"].tolist(), sound["keys"].tolist()) == ("mp4a", 60, [9, 9, 9], [0, 1, 2])
    assert sound["offsets"].tolist() == [at + 300, at + 309, at + 318]
    assert (video["codec"], video["duration"], video["sizes"].tolist(), video["keys"].tolist()) == ("avc1", 150, [11, 12, 13], [0])
    assert video["offsets"].tolist() == [at + 100, at + 111, at + 123] and media.probe(data)["codec"] == "avc1"
    row = media.media_columns(spark.createDataFrame([(1, bytearray(data))], "id int, media binary")).first()
    assert row.media_codec == "avc1" and [t.codec for t in row.media_tracks] == ["mp4a", "avc1"] and row.media_keyframes == [(at + 100, 11)]


def test_claims_of_samples_are_bounded_by_the_file():
    """Many runs, or tracks, that each claim as many samples as the file has bytes."""
    import tracemalloc

    data, head = fragmented()
    box, full, u = media._box, media._full, lambda *x: struct.pack(f">{len(x)}I", *x)
    for k in (10, 1000):
        run = full(b"trun", u(12 * k))
        hostile = data[:head] + box(b"moof", full(b"mfhd", u(1)), box(b"traf", full(b"tfhd", u(1), flags=0), run * k))
        tracemalloc.start()
        with pytest.raises(ValueError, match="more than the file"):
            media.probe_tracks(hostile)
        assert tracemalloc.get_traced_memory()[1] < 50e6
        tracemalloc.stop()
    stbl = lambda n: box(b"stbl", full(b"stsd", u(1), box(b"abcd", bytes(8))), full(b"stsz", u(1, n)), full(b"stsc", u(1, 1, n, 1)), full(b"stco", u(1, 0)))
    track = lambda n: box(b"trak", box(b"mdia", full(b"mdhd", u(0, 0, 1000, 0)), box(b"minf", stbl(n))))
    whole = box(b"moov", track(100) + track(50))
    assert [len(x["sizes"]) for x in media.probe_tracks(whole)] == [100, 50]
    with pytest.raises(ValueError, match="more than the file"):
        media.probe_tracks(box(b"moov", track(150) * 40 + track(2000)))


def test_hostile_containers_are_errors():
    box, full = media._box, media._full
    deep = b""
    for _ in range(3000):
        deep = box(b"moov", deep)
    stbl = lambda *x: box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">4I", 0, 0, 1, 1)), box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"abcd", bytes(8))), *x)))))
    tail = (full(b"stsc", struct.pack(">4I", 1, 1, 1, 1)), full(b"stco", struct.pack(">2I", 1, 0)))
    bad = [
        deep, b"", b"junk", stbl(), stbl(full(b"stsz", struct.pack(">II", 0, 2**32 - 1)), *tail), stbl(full(b"stsz", struct.pack(">II", 9, 2**32 - 1)), *tail),
        stbl(full(b"stsz", struct.pack(">III", 0, 1, 1)), full(b"stsc", struct.pack(">4I", 1, 1, 2**32 - 1, 1)), tail[1]),
        stbl(full(b"stsz", struct.pack(">III", 0, 1, 1)), full(b"stsc", struct.pack(">I", 2**31)), tail[1]),
        stbl(full(b"stsz", struct.pack(">III", 0, 1, 1)), *tail, full(b"stss", struct.pack(">II", 1, 7))),
    ]
    for data in bad:
        row = media._index_row(data)
        assert row["error"] and row["codec"] is None, data[:80]
    good = media.pack(bytes(640))
    for cut in range(0, len(good), 7):  # any truncation
        media._index_row(good[:cut])


def test_media_digests_and_columns(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "z" * 70_000), (5, "héllo"), (None, "q")]
    got = {r.doc_id: r for r in media.media_digests(texts(spark, rows)).collect()}
    for i, t in rows:
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.media_sha256 == hashlib.sha256(media.pack(payload)).hexdigest() and r.media_bytes == len(media.pack(payload))
    assert got[1].feature == got[5].feature and got[2].feature == got[3].feature
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None), (3, bytearray(media.pack(bytes(64))))], "id int, media binary")
    seen = {r.id: r for r in media.media_columns(bad).collect()}
    assert seen[1].media_codec is None and seen[1].media_error and seen[2].media_codec is None and seen[3].media_codec == "raw "
    assert media.media_digests(texts(spark, [])).count() == 0


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("<p>a&nbsp;b &lt;x&gt; 1 < 2<div class='sidebar-left'>no</div><p>c", [("a b <x> 1 < 2", False), ("c", False)]),
        ("<header>h</header><article><header><h1>T</h1></header><p>x<footer>f</footer></article><div id=comments><p>bad</p></div>", [("T", True), ("x", True)]),
        ("plain &amp text", [("plain & text", False)]),
        ("<script>a<b", []),
        ("<p>x<br>y<b>z</b>w", [("x yzw", False)]),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>", [("a", False), ("b", False), ("1", False), ("2", False)]),
        ('<div hidden>no</div>ok <a href="x>y">link</a>', [("ok link", False)]),
        ("<!-- c", []),
        ("", []),
        ("<p>a</p", [("a", False)]),
        ("<main><form><input>q</form><p>t\n t</main>", [("t t", True)]),
        ("<style>p{}</style><title>t</title><nav><p>n</nav><p>m", [("m", False)]),
        ("<article><p>one<div class='ad'>buy</div>two</article>", [("one", True), ("two", True)]),
        ("<p title=John's>Hello world. It's fine</p><p>next one</p>", [("Hello world. It's fine", False), ("next one", False)]),
        ("<article class='related-story'>a</article><div id='search-results'>b</div><div class='post-related'>no", [("a", True), ("b", False)]),
        ("<p title='a>b' x=\"c>d\" y='>z", [("z", False)]),
        ("<article class=comment>no</article><article><p data-x='1'>yes", [("yes", True)]),
    ],
)
def test_blocks(page, blocks):
    assert html_text.parse_blocks(page) == blocks


NAMED = [("div", "class", n) for n in ("ad-hoc-analysis", "navigation-history", "popup-culture", "comment-on-law", "share-prices", "banner-of-war")] + [
    ("section", "id", "popup-culture"), ("p", "class", "notice"), ("p", "class", "related"),
]


@pytest.mark.parametrize("tag,attribute,name", NAMED)
def test_article_parts_with_marked_words_in_their_names_stay(tag, attribute, name):
    page = f"<article><h1>A</h1><{tag} {attribute}='{name}'>kept text</{tag}></article>"
    assert [b for b, _ in html_text.parse_blocks(page)] == ["A", "kept text"]


@pytest.mark.parametrize("name", ["ad", "ads", "sidebar", "sidebar-left", "left-sidebar", "site_nav", "ad-slot-3", "cookie-banner", "notice", "nav__list", "newsletter-box", "top ad", "footer-links", "comments", "comment-list", "main-menu"])
def test_marked_parts_go(name):
    assert [b for b, _ in html_text.parse_blocks(f"<div class='{name}'>gone</div><article>kept</article>")] == ["kept"]


def test_a_teaser_is_not_the_page(spark):
    body = "<div><p>" + "</p><p>".join(f"long body text number {k} of this page" for k in range(9)) + "</p></div>"
    pages = spark.createDataFrame([(1, "http://a/1", "<div><article>teaser</article></div>" + body), (2, "http://a/2", f"<article>{body}</article><div>short aside</div>")], "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert texts[1].startswith("teaser\nlong body text number 0") and texts[1].count("\n") == 9
    assert "aside" not in texts[2] and texts[2].count("\n") == 8


def test_deep_and_long_pages_are_linear():
    import time

    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert html_text.parse_blocks("<div><p>" * n + "x" + "</div>" * n) == [("x", False)]
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5
    assert html_text.parse_blocks("<p " + "a='" * 50_000 + ">x") in ([("x", False)], [])
    assert len(html_text.parse_blocks("word " * 500_000)[0][0]) == 2_499_999


def test_whole_query_on_pages_without_main_element(spark):
    """Crawled-like pages: what three pages of a host repeat, over runs of eight words, is cut; all else stays."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    pools = {h: [[word() for _ in range(r.randint(5, 20))] for _ in range(12)] for h in ("a.example", "b.example")}
    rows = []
    for k in range(90):
        host = r.choice(sorted(pools))
        blocks = []
        for _ in range(r.randint(1, 6)):
            words = [word() for _ in range(r.randint(0, 12))]
            if r.random() < 0.6:
                at = r.randint(0, len(words))
                words[at:at] = r.choice(pools[host])
            blocks.append(words)
        rows.append((k, f"https://{host}/{k}", "".join(f"<div>{' '.join(b)}</div>" for b in blocks), [b for b in blocks if b]))
    expected = {}
    for host in pools:
        own = [x for x in rows if host in x[1]]
        where: dict = {}
        for k, _, _, blocks in own:
            flat = [w for b in blocks for w in b]
            for i in range(len(flat) - html_text.RUN + 1):
                where.setdefault(tuple(flat[i : i + html_text.RUN]), set()).add(k)
        for k, _, _, blocks in own:
            flat = [w for b in blocks for w in b]
            gone = set()
            for i in range(len(flat) - html_text.RUN + 1):
                if len(where[tuple(flat[i : i + html_text.RUN])]) >= html_text.LEAST_PAGES:
                    gone.update(range(i, i + html_text.RUN))
            at, kept = 0, []
            for b in blocks:
                kept.append(" ".join(w for j, w in enumerate(b, at) if j not in gone))
                at += len(b)
            expected[k] = "\n".join(x for x in kept if x)
    frame = spark.createDataFrame([x[:3] for x in rows], "page_id long, url string, html string").repartition(4)
    got = {x.page_id: x for x in html_text.main_text(frame).collect()}
    assert {k: x.text for k, x in got.items()} == expected
    assert sum(x.n_repeated > 0 for x in got.values()) > 30  # the array decides on many of these pages


@pytest.mark.parametrize("shard", [1, 7, 40, 2000])
def test_results_do_not_depend_on_shards(spark, monkeypatch, shard):
    """A host of 120 pages in any number of shards: passages on two pages stay, those on three or more go, wherever they are dealt."""
    r = random.Random(5)
    line = lambda n: [f"{r.choice('wW')}{r.randrange(10**6)}" for _ in range(n)]
    own = [line(20) for _ in range(120)]
    shared = [(line(r.randint(8, 15)), r.sample(range(120), n)) for n in (2, 2, 3, 3, 3, 4, 6, 50)]
    rows, expected = [], {}
    for k in range(120):
        here = [(words, len(where)) for words, where in shared if k in where]
        rows.append((k, f"https://{'ab'[k == 119]}.example/{k}", "".join(f"<div>{' '.join(x)}</div>" for x in [own[k], *(words for words, _ in here)])))
        expected[k] = [" ".join(own[k])] + [" ".join(words) for words, n in here if k == 119 or n - (119 in next(w for x, w in shared if x == words)) < 3]
    monkeypatch.setattr(html_text, "SHARD", shard)
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {x.page_id: x.text for x in got} == {k: "\n".join(v) for k, v in expected.items()}
    assert sum(x.n_repeated for x in got) == sum(len(words) * (n := len({*where} - {119})) for words, where in shared if len({*where} - {119}) >= 3)


def test_repeated_equals_brute_force():
    r = np.random.default_rng(7)
    for _ in range(60):
        n, run = int(r.integers(1, 120)), int(r.integers(1, 9))
        tokens, page = r.integers(0, 3, n), np.sort(r.integers(0, 5, n))
        tokens = np.where(np.append(page[1:] != page[:-1], True), -1 - page, tokens)
        for least in (1, 2, 3):
            where: dict = {}
            for i in range(n - run + 1):
                where.setdefault(tuple(tokens[i : i + run]), []).append(i)
            hit = np.zeros(n, bool)
            for places in where.values():
                if len({page[i] for i in places}) >= least:
                    for i in places:
                        hit[i : i + run] = True
            assert (html_text.repeated(tokens, page, run, least) == hit).all()


def test_pages(spark):
    r = random.Random(1)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    shared, boiler = line(30), line(12)
    rows, expected = [], {}
    for i in range(40):  # no main element: the repeated block goes, unique ones stay
        own = line(25)
        rows.append((i, f"https://a.example/{i}", f"<body><div>{boiler}</div><div>{own}</div></body>", 1))
        expected[i] = own
    for i in range(40, 60):  # a main element keeps what other pages quote
        rows.append((i, f"http://b.example/{i}", f"<nav>{line(9)}</nav><article><p>{shared}<p>&eacute;{i}</article><footer>{line(9)}</footer>", 1))
        expected[i] = f"{shared}\né{i}"
    rows += [(70, None, None, 1), (71, "x", "", 1), (72, "x", "<p>only", 1), (72, "x", "<p>only", 1), (None, "x", "<p>n", 1)]
    expected |= {70: "", 71: "", 72: "only", None: "n"}
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.text == expected[x.page_id] and x.n_chars == len(x.text)
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mix_equals_inverted_distribution(spark):
    weights = {"a": 0.5, "b": 0.2, "*": 0.3, "none": 0.4}
    r = random.Random(3)
    rows = [(i, f"t{i}", r.choice(["a", "b", "c", None, "d"]), 0) for i in range(800)] + [(5, "again", "a", 0), (None, None, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int")
    out = mixing.poisson_mix(docs, weights, budget=1.5)
    got = Counter((x.doc_id, x.text) for x in out.collect())
    groups = Counter(s if s in ("a", "b") else "*" for _, _, s, _ in rows)
    rates = {g: 1.5 * len(rows) * weights[g] / 1.0 / groups[g] for g in ("a", "b", "*")}
    assert mixing.group_rates(docs, weights, budget=1.5) == pytest.approx(rates)
    for i, t, s, _ in rows:
        u = int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-(rate := rates[s if s in ("a", "b") else "*"]))
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        assert got[(i, t)] == k
    order = [(x.doc_id, x.copy) for x in out.collect()]
    keys = [hashlib.md5(f"mix:{'' if i is None else i}:{c}".encode()).hexdigest() for i, c in order]
    assert keys == sorted(keys)
    assert mixing.poisson_mix(docs.limit(0), weights).count() == 0


def test_distribution_at_any_rate():
    for rate in (1e-9, 0.3, 1.0, 7.5, 80.0, 644.0, 5000.0, 1e6):
        k, steps = mixing.distribution(rate)
        assert steps == sorted(steps) and abs(steps[-1] - 1) < 1e-12 and len(steps) < 100 + 20 * math.sqrt(rate)
        mean = sum((k + i) * (b - a) for i, (a, b) in enumerate(zip([0.0, *steps], steps)))
        assert mean == pytest.approx(rate, rel=1e-6)
        if rate < 100:
            assert steps[0] == pytest.approx(sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(k + 1)), rel=1e-9)


def test_rare_source_and_clashing_columns(spark):
    rows = [(i, "t", "a", i, 2 * i) for i in range(3000)] + [(9000, None, "rare", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _n long, _place long")
    out = mixing.poisson_mix(docs, {"rare": 0.3, "*": 0.7})
    assert out.columns == [*docs.columns, "copy"]
    got = out.collect()
    assert 700 < sum(x.source == "rare" for x in got) < 1100 and all(x._place == 2 * x._n for x in got)


def test_registered_sql_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    for name, text in registry.oracle_sql().items():
        cursor = con.execute(text)
        names = sorted(d[0] for d in cursor.description)
        expected = sorted((tuple(dict(zip([d[0] for d in cursor.description], row))[n] for n in names) for row in cursor.fetchall()), key=repr)
        df = registry.queries()[name](spark, folder)
        assert sorted(df.columns) == names
        assert sorted((tuple(x[n] for n in names) for x in df.collect()), key=repr) == expected, name
    assert sql.near_duplicates().lstrip().startswith("WITH")


def test_pipeline_stages_keep_their_contract(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_dedup", "mixing", "bpe"]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = pipeline.stash(stage(spark, docs, folder))
        rows = out.collect()
        if k < 4:
            assert out.columns == docs.columns
        else:
            assert out.columns[:5] == docs.columns and len(rows) == docs.count()
        assert {r.doc_id for r in rows} <= set(before)
        if name == "minhash_dedup":
            groups = pipeline.near_duplicates(docs).where("kept").select("doc_id").distinct().collect()
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in groups)
        if name == "line_dedup":
            assert all(r.text in before[r.doc_id].text or "\n" in before[r.doc_id].text for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id].text)
        docs = out


def test_pipeline_run_equals_brute_force(spark, tmp_path):
    """All five stages over a small corpus: all pairs of lines, all pairs of documents, the tokenizers library."""
    pipeline = pytest.importorskip("corpus_pipeline")
    tokenizers, files = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from test_near_duplicates import closure, shingles

    from spanloom.llm import line_dedup, toxicity

    r = random.Random(77)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    footer, rows, labels = line(9), [], []
    for i in range(150):
        lines = [line(r.randint(1, 14)) for _ in range(r.randint(1, 6))]
        if i % 4 == 0:
            lines.append(footer[:-1] + r.choice("xyz") if i % 8 else footer)
        bad = i % 5 == 1
        if bad:
            lines[0] += " you " + r.choice(["grumbler", "snarkler"]) + " " + word()
        rows.append((i, "\n".join(lines), "en", f"src{i % 3}", 0))
        labels.append((i, 1, int(bad)))
    rows += [(200 + i, rows[i][1] + " tail", "en", "src1", 0) for i in (0, 7, 12)] + [(210, rows[3][1], "en", "src0", 0), (211, None, "en", None, 0), (212, "", "en", "src0", 0), (213, footer, "fr", "src2", 0)]
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    terms, w = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert {"grumbler", "snarkler"} <= set(terms)
    x = toxicity.Scorer(terms).features(pa.array([t for _, t, *_ in rows]))
    left = [row for row, f in zip(rows, x) if 1 / (1 + math.exp(-(w[0] + f @ np.array(w[1:])))) < 0.5]
    assert 20 < len(rows) - len(left) < 40

    spots = [(i, p, line_dedup.normal(y)) for i, t, *_ in sorted(left) for p, y in enumerate((t or "").split("\n")) if line_dedup.normal(y)]
    forms = sorted({f for _, _, f in spots})
    fuzzy = [len(f) - f.count(" ") >= line_dedup.WHOLE["letters"] for f in forms]
    root = closure(len(forms), [(a, b) for a in range(len(forms)) for b in range(a) if fuzzy[a] and fuzzy[b] and line_dedup.similar(forms[a], forms[b])])
    number, seen, gone = {f: k for k, f in enumerate(forms)}, set(), {}
    for i, p, f in spots:
        if root[number[f]] in seen:
            gone.setdefault(i, set()).add(p)
        seen.add(root[number[f]])
    kept = []
    for i, t, lang, s, n in left:
        lines = [y for p, y in enumerate((t or "").split("\n")) if p not in gone.get(i, ())]
        if i not in gone:
            kept.append((i, t, lang, s, n))
        elif any(map(line_dedup.normal, lines)):
            kept.append((i, "\n".join(lines), lang, s, len("\n".join(lines))))
    assert gone and len(kept) < len(left)

    sets = [shingles(t) for _, t, *_ in kept]
    order = sorted(range(len(kept)), key=lambda k: kept[k][0])
    pairs = [(a, b) for a in range(len(order)) for b in range(a) if (p := sets[order[a]]) and (q := sets[order[b]]) and 100 * len(p & q) >= 75 * len(p | q)]
    root = closure(len(order), pairs)
    single = [kept[order[k]] for k in range(len(order)) if root[k] == k]

    group = lambda s: s if s == "src0" else "*"
    sizes = Counter(group(s) for *_, s, _ in single)
    library, expected = tokenizers.Tokenizer.from_file(files.path("word_bpe_49k.json")), Counter()
    for i, t, lang, s, n in single:
        rate = pipeline.EPOCHS * len(single) * pipeline.WEIGHTS[group(s)] / sizes[group(s)]
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
        copies, total = 0, math.exp(-rate)
        while total <= u:
            copies += 1
            total += math.exp(-rate) * rate**copies / math.factorial(copies)
        ids = library.encode(t or "", add_special_tokens=False).ids
        if copies:
            expected[i, t, lang, s, n, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] = copies
    got = Counter((x.doc_id, x.text, x.lang, x.source, x.n_chars, x.n_tokens, x.ids_sha256) for x in pipeline.run(spark, str(tmp_path)).collect())
    assert got == expected
