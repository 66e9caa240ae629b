"""Text operators against brute force, with nulls, empty tables, ties, long texts and clashing columns."""

import hashlib
import re
import time
import zlib
from collections import Counter

import pytest

from fleetscope.llm import exact, html, lines, minhash, mixing, packing, quality, sharding, urls
from fleetscope.llm.queries import QUERIES, SQL, tokenizer_path
from tests.compare import connect, differences

DOC = "doc_id bigint, text string, source string, n bigint, text_hash string, kept int"
LONG = " ".join(f"word{i % 977}" for i in range(20000))
BASE = " ".join(f"alpha{i}" for i in range(60))
ROWS = [
    (1, BASE, "a", 1, "x", 0), (2, BASE.replace(" ", "  "), "a", 1, "x", 0), (3, BASE.replace("alpha59", "Beta"), "b", 1, "x", 0),
    (4, None, None, None, None, None), (5, "", "a", 1, "x", 0), (6, " \t\n", "b", 1, "x", 0), (7, LONG, "c", 1, "x", 0),
    (7, LONG, "c", 1, "x", 0), (8, "two words", "c", 1, "x", 0), (None, "two  words", "c", 1, "x", 0), (9, LONG + " end", None, 1, "x", 0),
    (10, "One line that repeats itself\nx", "a", 1, "x", 0), (11, " one LINE that repeats itself \ny", "a", 1, "x", 0),
    (12, "one line that repeats itself\none line that repeats itself", "a", 1, "x", 0),
]


@pytest.fixture
def docs(frame):
    return frame(DOC, ROWS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_twin(spark, small, name):
    assert differences(QUERIES[name](spark, small), connect(small), SQL[name]) == []


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_near_duplicates_equal_brute_force(docs):
    found = {(r.doc_id, r.n_shingles): r for r in minhash.near_duplicates(docs, words=4).collect()}
    assert {found[i, n].component_id for i, n in [(1, 57), (2, 57), (3, 57)]} == {1}
    assert found[1, 57].kept and not found[3, 57].kept
    assert [found[i, 0].component_id for i in (4, 5, 6)] == [4, 5, 6]
    assert found[8, 1].component_id == 8 and found[None, 1].component_id == 8 and not found[None, 1].kept
    assert {r.component_id for k, r in found.items() if k[0] in (7, 9)} == {7}
    assert minhash.near_duplicates(docs).count() == len(ROWS)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    kept = minhash.drop_near_duplicates(docs, words=4)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6, 7, 8, 10, 11, 12]


def test_parities_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    b = np.unique(np.concatenate([a[40:], rng.integers(0, 2**63, 30, dtype=np.uint64)]))
    flips = sum(int(x).bit_count() for x in (minhash.parity(a) ^ minhash.parity(b)).view(np.uint64))
    assert flips <= len(np.setxor1d(a, b))


def test_exact_duplicates(docs):
    found = exact.exact_duplicates(docs).collect()
    assert len(found) == len(ROWS)
    by_text = {}
    for r in found:
        by_text.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in group) == 1 and {r.group_size for r in group} == {len(group)} for group in by_text.values())
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].keep_id == 2 and by_id[2].kept  # the longer original stays
    assert by_id[4].keep_id == 6 and by_id[8].keep_id is None
    assert by_id[8].text_sha256 == hashlib.sha256(b"twowords").hexdigest()
    assert exact.drop_exact_duplicates(docs).count() == len(by_text)
    assert exact.exact_duplicates(docs.limit(0)).count() == 0


def test_exact_group_over_many_ranges(spark):
    many = spark.range(3000).selectExpr("id AS doc_id", "'same text' AS text")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert exact.exact_duplicates(many).selectExpr("keep_id", "group_size").distinct().collect() == [(0, 3000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines(docs):
    found = {(r.doc_id, r.n_lines): r for r in lines.drop_repeated_lines(docs).collect()}
    assert found[10, 2].text == "x" and found[11, 2].text == "y" and found[12, 2].n_dropped == 0
    assert found[4, 1].text == "" and found[7, 1].text == LONG
    assert lines.drop_repeated_lines(docs.limit(0)).count() == 0


def test_common_lines_of_long_documents_take_linear_time(frame):
    def seconds(n):
        text = "\n".join(f"a line that stands in all documents, number {i}" for i in range(n))
        rows = frame(DOC, [(i, text + f"\nown {i}", "a", 1, "x", 0) for i in range(4)] + [(None, text, "a", 1, "x", 0), (None, text + "\nx", "a", 1, "x", 0)]).cache()
        rows.count()
        start = time.perf_counter()
        found = lines.drop_repeated_lines(rows).collect()
        assert sorted(r.n_dropped for r in found) == [0, n, n, n, n, n] and [r.text for r in found if r.doc_id == 0] == ["own 0"]
        return time.perf_counter() - start

    seconds(100)
    assert seconds(16000) < 2 * seconds(8000) + 3


def test_mixing_meets_its_targets(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    total = sum(len(words(t[1])) for t in ROWS)
    assert abs(sum({r.target for r in rows}) - total) < 1e-6 * total
    assert all(r.taken <= 3 * r.size for r in rows) and all(r.taken == 0 for r in rows if r.size == 0)
    sizes = {}
    for r in rows:
        sizes.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(int(target) == sum(taken) for (_, target), taken in sizes.items())
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack(docs, tokenizer_path(), length=64).collect()
    by_sequence, got = {}, Counter()
    for p in pieces:
        assert len(p.ids) == p.length and p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0  # full, or a power of two: nothing is padded
    by_doc = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for row in ROWS:
        want = plain.encode(row[1] or "", add_special_tokens=False).ids + [2]
        own = by_doc[row[0], len(want)]
        got[row[0]] = sum(p.length for p in own)
        assert got[row[0]] == len(want) * sum(r[:2] == row[:2] for r in ROWS)
        if row[0] != 7:
            assert [i for p in sorted(own, key=lambda p: p.start) for i in p.ids] == want
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_chunked_ids_equal_the_tokenizer():
    ids = packing._chunk_ids(tokenizer_path())
    for text in ["It's x.. y., z.\nK. ΣΑΣ. é. a.", "Á İ. <|endoftext|> 12a\tb", "\x1cx y  z,", "we'll.—. d'"]:
        assert ids.of(text)[:-1].tolist() == ids.encoder.encode(text, add_special_tokens=False).ids


def test_special_names_are_the_contracts_tokens():
    assert packing._chunk_ids(tokenizer_path()).of("a <|endoftext|> b").tolist() == [320, 49407, 321, 2]


def test_ranges_hold_as_many_characters(frame):
    texts = frame(DOC, [(i, f"text {i % 7} " * (400 if i % 10 == 0 else 4), "a", 1, "x", 0) for i in range(600)])
    source = texts.selectExpr("doc_id AS id", "text", "xxhash64(text) AS tie")
    borders = packing._borders(source, 6)
    assert len(borders) == 5 and borders == sorted(set(borders))
    chars = source.mapInArrow(packing._keys(borders), packing._KEYED).groupBy("range").agg({"text": "count"}).count()
    assert chars == 6 and packing._borders(source.limit(0), 6) == []


def test_hilbert_neighbours_touch():
    cells = sorted(((x, y, z) for x in range(4) for y in range(4) for z in range(4)), key=lambda p: packing.hilbert_index(list(p), 2))
    assert sorted(packing.hilbert_index(list(c), 2) for c in cells) == list(range(64))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(cells, cells[1:]))


def test_sharding(docs):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill_table(names, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    less = sharding.fill_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, less) if a != 6) < 1009 * 0.2
    placed = sharding.assign_shards(docs, names).collect()
    assert len(placed) == len(ROWS) and len({r.shard for r in placed if r.doc_id == 7}) == 1
    assert sharding.assign_shards(docs.limit(0), names).count() == 0
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)


def test_url_rules_and_aliases(frame):
    page = "page_id bigint, url string, html string, host string, verdict string"
    canonical = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.EXAMPLE.com/en/x?q", None, "h", "v"), (2, "http://www.example.com/en/", "", "h", "v"), (3, None, None, None, None),
        (4, "no scheme", "", "h", "v"), (5, "https://x.net/fr/1#a", "", "h", "v"), (6, "https://x.org/p", canonical.format("https://x.net/fr/1"), "h", "v"),
        (7, "https://y.org/q", '<meta http-equiv="refresh" content="0; url=https://x.org/p">', "h", "v"),
        (8, "https://z.org/a/b", "<!--" + canonical.format("https://x.net/fr/1") + "-->", "h", "v"),
        (9, "https://w.org/", canonical.format("https://x.net/es/"), "h", "v"), (10, "https://shop.com/", canonical.format("https://w.org/"), "h", "v"),
        (11, "https://x.net/es/", "", "h", "v"), (11, "https://x.net/es/", "", "h", "v"),
    ]
    found = {r.page_id: r for r in urls.judge(frame(page, rows)).collect()}
    assert [(found[i].rule, found[i].verdict) for i in (1, 2, 3, 4, 5)] == [
        ("example.com/en/", "block"), ("www.example.com/en/", "allow"), (None, "allow"), (None, "allow"), ("net/fr/", "block")]
    assert found[1].host == "a.example.com" and found[1].path == "/en/x" and (found[3].host, found[3].path) == ("", "")
    assert found[6].verdict == found[7].verdict == "block"  # aliases of a blocked url
    assert found[8].verdict == "allow"  # a link in a comment is none
    assert found[9].verdict == "allow" and found[11].verdict == "block"  # an allowed alias comes before a blocked one; a rule settles its page
    assert urls.judge(frame(page, [])).count() == 0


def test_html(frame):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><nav><a href=/>Home</a></nav>"
        "<div class='cookie-notice'>Cookies</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>\n text.<p>Second<br>line.</p><ul><li>one<li>two</ul>"
        "<section id=comments>Nice post</section></article><aside>Side</aside><form>Name</form><footer>&copy; me</footer>")
    assert html.main_text(page) == "Title & more First bold text. Second line. one two"
    assert html.main_text("plain &lt;b&gt; text") == "plain <b> text"
    assert html.main_text(page[:-3]) == html.main_text(page) and html.main_text("<p>a</p><di") == "a"
    assert html.main_text("<div>" * 3000 + "deep") == "deep"
    rows = [(1, "u", page, "t"), (2, None, None, None), (3, "u", "", "t"), (3, "u", "", "t")]
    found = html.extract(frame("page_id bigint, url string, html string, text string", rows))
    assert sorted((r.page_id, r.n_chars) for r in found.collect()) == [(1, 50), (2, 0), (3, 0), (3, 0)]


def test_html_keeps_all_of_the_article():
    def text(n, word):
        return " ".join(f"{word}{i}" for i in range(n))

    menu = "<div><ul><li><a href=/a>Politics today</a><li><a href=/b>Sports today</a><li><a href=/c>Weather today</a></ul></div>"
    short = [text(5, "b"), text(9, "c"), text(3, "d")]
    for tag in ("article", "div"):  # an unclosed b in a first paragraph that outweighs the others
        page = f"<body>{menu}<{tag}><h1>Title</h1><p><b>{text(400, 'a')}<br>" + "".join(f"<p>{s}</p>" for s in short) + f"</{tag}></body>"
        assert html.main_text(page) == " ".join(["Title", text(400, "a"), *short])
    parts = [[text(60 + 7 * i, f"s{i}p{j}x") for j in range(9 - 2 * i)] for i in range(4)]
    whole = " ".join(p for part in parts for p in part)
    for tag in ("section", "div class=part", "div"):
        inner = "".join(f"<{tag}>" + "".join(f"<p>{p}</p>" for p in part) + f"</{tag.split()[0]}>" for part in parts)
        for around in ("<article>{}</article>", "<div id=story>{}</div>", "<main><div>{}</div></main>", "{}"):
            assert html.main_text(f"<body>{menu}{around.format(inner)}</body>") == whole, (tag, around)
    links = "<ul><li><a href=/x>Source one</a><li><a href=/y>Source two</a></ul>"
    assert html.main_text(f"<body>{menu}<article><section><p>{whole}<p>{whole}</section>{links}</article></body>").endswith("Source one Source two")


def test_html_marks_whole_names_only():
    inner = "<h1>Title here</h1><p>" + "Some long words of the story. " * 20 + "</p><p>More of it.</p>"
    want = html.main_text(f"<article>{inner}</article>")
    assert len(want) > 500
    for around in ('<div class="content has-sidebar">{}</div>', '<div class="post comments-open">{}</div>', "<form>{}</form>", "<form><div class=sidebar>{}</div></form>",
                   "<div class=widget>{}</div>", "<div title='nothing hidden'>{}</div>", "<aside>{}</aside>"):
        for own in ("<article>{}</article>", "<main>{}</main>", "<div>{}</div>"):
            page = around.format(own.format(inner))
            assert html.main_text(f"<body><nav><a href=/>Home</a></nav>{page}<footer>Imprint</footer></body>") == want, page
    kept = ('<h2 id="related-work">Related work</h2><p id="notice-of-appeal">Notice of <a href="/hidden-valley">the valley</a> and <a href=/x title="a hidden one">one</a></p>'
            '<h2 id="search">Search</h2><p><img alt="hidden" src=x>end</p>')
    assert html.main_text(f"<article>{inner}{kept}</article>") == want + " Related work Notice of the valley and one Search end"
    apart = ("<div class='ad'>buy</div><div class='sidebar-left'>side</div><div id=comments>nice</div><div hidden>x1</div><div hidden=''>x2</div><p style='display: none'>x3</p>"
             "<section class=comments><article class=comment>x4</article></section><div aria-hidden=true>x5</div><div role=complementary>x6</div><div class='x navBar'>x7</div>")
    assert html.main_text(f"<body><div class=related><article>Teaser text</article></div><article>{inner}{apart}</article>{apart}</body>") == want
    assert html.main_text(f"<body><article>{inner}</article><div class=comments>{'A long comment on it. ' * 90}</div></body>") == want


def test_quality_separates_held_out_rows(spark, small, frame):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = labels.where("doc_id % 2 = 1")
    rows = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(odd, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    poor = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.95 * len(clean) and sum(poor) <= 0.1 * len(poor)
    odd_rows = frame(DOC + ", p_good int", [r + (1,) for r in ROWS])
    assert quality.classify(odd_rows, labels).count() == len(ROWS)
    assert quality.good_documents(odd_rows, labels.limit(0)).count() == len(ROWS)
    assert quality.classify(docs.limit(0), labels).count() == 0
