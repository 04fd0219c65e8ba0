"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from oracle import connect, differences
from pyspark.sql import functions as F

from skein.llm import bitpack, catalog, cuckoo, html_extract, licences, line_dedup, mixing, packing, pq_dedup, simhash, tokens, toxicity
from skein.plans import storage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, component_id string, size string"


def rows_of(texts, sources=None):
    sources = sources or ["a"] * len(texts)
    return [(i, t, "en", s, len(t or ""), "x", "y", "z") for i, (t, s) in enumerate(zip(texts, sources))]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    make = lambda n: " ".join(rng.choice(words, n))
    base = make(400)
    near = base.split()
    near[100] = "changed"
    return [base, base, " ".join(near), make(3), None, "", "  \n ", "one", make(50), make(5000), "Ünï ΑΣ. İs <|endoftext|> it's 3.5", base.upper(), "x" * 50_000] + [make(60) + "\n" + make(20) for _ in range(10)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    extra = [(None, "null id", "en", None, 7, "x", "y", "z"), (0, texts[0], "en", "a", 1, "x", "y", "z")]
    return spark.createDataFrame(rows_of(texts) + extra, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def encode(text):
    from tokenizers import Tokenizer

    t = encode.__dict__.setdefault("t", Tokenizer.from_file(tokens.default_path()))
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


# 1


def test_line_dedup_is_its_sql(spark, sf):
    assert differences(catalog.QUERIES["op1_line_dedup"](spark, sf), connect(sf), catalog.ORACLE_SQL["op1_line_dedup"]) == ""


def test_line_dedup_generalises_a_field(spark, none):
    line = "the quick report of {} says that all is well in the town of {} today"
    t = [line.format("January", "Rome") + "\nfirst body line is here", line.format("March", "Rome") + "\nanother body line", "order 55 of 12 items was sent\nshort\nsame", "order 7 of 9 items was sent\nshort\nsame", None, ""]
    d = spark.createDataFrame(rows_of(t), SCHEMA)
    got = {r["doc_id"]: (r["text"], r["lines"], r["lines_dropped"]) for r in line_dedup.drop_recurring_lines(d).collect()}
    assert got[0] == (t[0], 2, 0) and got[1] == ("another body line", 2, 1)
    assert got[3] == ("short\nsame", 3, 1) and got[2] == (t[2], 3, 0)
    assert got[4] == (None, 0, 0) and got[5] == ("", 1, 0)
    out = line_dedup.drop_recurring_lines(none)
    assert out.count() == 0 and set(SCHEMA.replace(" string", "").replace(" long", "").split(", ")) <= set(out.columns)


def test_line_dedup_runs_no_python(spark, sf):
    plan = line_dedup.drop_recurring_lines(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 2


def test_main_text(spark):
    page = "<html><head><title>t</title><style>p{}</style><script>var a='<p>x</p>';</script></head><body><nav><ul><li><a>Home</a></li></ul></nav><div class='ad'>Buy this now, dear reader</div><article><h1>A &amp; B</h1><p>One  two\nthree.<p>Four&nbsp;<b>five</b>.<form><input>Your mail here please</form><p>Six.</article><section id=comments><p>I disagree with every word of it, and so does my cat</p></section><footer>&copy; us</footer></body></html>"
    cases = {0: (page, "A & B\nOne two three.\nFour five.\nSix."), 1: (None, ""), 2: ("", ""), 3: ("<nav><a>only</a></nav>", ""), 4: ("plain &lt; text", "plain < text"), 5: ("<p>" + "word " * 50_000, "word " * 49_999 + "word")}
    d = spark.createDataFrame([(k, "u", h) for k, (h, _) in cases.items()] + [(None, None, page)], "page_id long, url string, html string")
    for r in html_extract.extract(d).collect():
        want = cases[r["page_id"] or 0][1]
        assert (r["text"], r["n_chars"]) == (want, len(want))
    assert html_extract.extract(d.limit(0)).count() == 0


def test_pages_give_their_articles(spark, sf):
    import html

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        lines = re.sub(r"</?(?:p|h1|br)[^>]*>", "\n", article).replace("<b>", "").replace("</b>", "").split("\n")
        want = "\n".join(x for x in (" ".join(html.unescape(x).split()) for x in lines) if x)
        assert html_extract.main_text(r["html"]) == want


P = "<p>The council met at nine and agreed on the new bridge.</p><p>It will be built of stone, and it will last.</p>"
T = "The council met at nine and agreed on the new bridge.\nIt will be built of stone, and it will last."
ODD_PAGES = {
    "title in a header": ("<nav><a>x</a></nav><article><header><h1>Title here</h1></header>" + P + "</article>", "Title here\n" + T),
    "form around all": ("<form id=aspnetForm><article>" + P + "</article></form>", T),
    "layout with a telling word": ("<div class='layout sidebar-left'><h1>Head</h1>" + P + "</div>", "Head\n" + T),
    "content with a telling word": ("<h1>Head</h1><div class='entry-content sharing-enabled'>" + P + "</div>", "Head\n" + T),
    "nav left open": ("<nav><ul><li><a>Home</a></li></ul><article>" + P + "</article>", T),
    "nav left open, no article": ("<nav><ul><li><a>Home</a></li></ul><h1>Head</h1>" + P, "Head\n" + T),
    "discussion": ("<article>" + P + "<section class='discussion'><h2>Discussion</h2><p>We weigh it.</p></section></article>", T + "\nDiscussion\nWe weigh it."),
    "legal": ("<article>" + P + "<p class='legal'>The law says so.</p></article>", T + "\nThe law says so."),
    "caption": ("<article>" + P + "<figure><img><figcaption>A bridge.</figcaption></figure></article>", T + "\nA bridge."),
    "plain menu and copyright": ("<div><a>Home</a> <a>News</a> <a>Sport</a></div><div>" + P + "</div><div>Copyright 2024 Some Corp. All rights reserved.</div>", T),
    "teaser cards": ("<main>" + P + "</main><article><h3>Card one</h3><p>Short teaser text.</p></article><article><h3>Card two</h3><p>Another.</p></article>", T),
    "comments without a class": ("<article>" + P + "</article><div><h3>Comments</h3><div><b>Joe</b><p>I disagree with it all.</p></div></div>", T),
    "comments in the text's element": ("<div>" + P + "<div><h3>2 comments</h3><div><b>Joe</b><p>I disagree with it all.</p></div></div></div>", T),
    "open quote": ('<article><p>See <a href="x>the plan</a> now.</p>' + P + "</article>", "See the plan now.\n" + T),
    "mark in a quote": ('<article><p data-a="a>b <i>">Text one.</p>' + P + "</article>", "Text one.\n" + T),
    "advert in the article": ("<article><div class='ad-slot'>Buy now, cheap</div>" + P + "<div class='newsletter-signup'>Get our mail</div></article>", T),
    "words of comments in prose": ("<div>" + P + "<p>I do not believe a word of this, she says in reply to us all.</p></div>", T + "\nI do not believe a word of this, she says in reply to us all."),
}


@pytest.mark.parametrize("name", ODD_PAGES)
def test_odd_pages(name):
    page, want = ODD_PAGES[name]
    assert html_extract.main_text(f"<!doctype html><html><body>{page}</body></html>") == want


def test_labelled_pages_give_their_marked_text():
    """Scan and weights reproduce the marks, but for one page whose site name stands where a title would."""
    import html

    right = 0
    for marked in html_extract.labelled_pages.PAGES:
        lines = re.sub(r"<[^>]*>", "", re.sub(r"<(?!/?(?:a|b)\b)[^>]*>", "\n", "\n".join(marked.split("@@")[1::2]))).split("\n")
        right += html_extract.main_text(marked.replace("@@", "")) == "\n".join(x for x in (" ".join(html.unescape(x).split()) for x in lines) if x)
    assert right >= len(html_extract.labelled_pages.PAGES) - 1 >= 30


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "text", '<a href="x>y ' * 20_000, '"' * 20_000 + "<p " + '"' * 20_000, "<!-- " * 20_000, "<a " * 50_000, "</div>" * 50_000, "<h2>Comments" * 20_000])
def test_hostile_pages_take_linear_time(page):
    import time

    html_extract.weights()
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 2


def test_region_is_the_best_one():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.integers(-5, 6, rng.integers(1, 12)).tolist()
        a, b = html_extract.region([float(x) for x in s])
        assert sum(s[a:b]) == max(0, max(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))


# 3


@pytest.mark.parametrize("width", [1, 7, 13, 16, 17, 32])
def test_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, min(1 << width, 1 << 31), 1003)
    raw = bitpack.pack(ids, width)
    assert len(raw) == -(-1003 * width // 8) and bitpack.unpack(raw, width, 1003).tolist() == ids.tolist()


def test_token_files(spark, docs, none, tmp_path):
    got = [tuple(r) for r in bitpack.token_files(docs, folder=f"file://{tmp_path}").collect()]
    want, at = [], 0
    for doc_id, text in sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = encode(text) + [1]
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    assert bitpack.token_files(none).count() == 0


def test_shard_random_access(tmp_path):
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 49408, n) for n in (5, 0, 1000, 70_000, 1)]
    with open(tmp_path / "a", "wb") as f:
        w = bitpack.ShardWriter(f, 16, block=512)
        for i, p in enumerate(parts):
            w.add(i, p)
        w.close()
    flat, r = np.concatenate(parts), bitpack.ShardReader(str(tmp_path / "a"))
    for a, b in ((0, 0), (0, 5), (500, 530), (511, 513), (60_000, len(flat))):
        assert r.ids(a, b).tolist() == flat[a:b].tolist()


# 4


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("group", [8192, 7])
def test_mix(spark, none, group):
    rng = np.random.default_rng(3)
    sources = [None if i % 40 == 0 else f"s{min(int(rng.exponential(3)), 8)}" for i in range(600)]
    t = [None if i % 50 == 7 else "w " * int(rng.exponential(80)) for i in range(600)]
    d = spark.createDataFrame(rows_of(t, sources), SCHEMA)
    rows = mixing.mix(d, group=group).collect()
    assert len(rows) == 600
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for i, x in enumerate(t)}
    sizes, taken = Counter(), Counter()
    for i, s in enumerate(sources):
        sizes[s] += size[i]
    target = brute_targets(sizes)
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(100, 0.03 * target[s]) * (8 if group == 7 else 1)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(d.repartition(5), group=group).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    assert mixing.mix(none).count() == 0


def test_one_tiny_source_stops_at_three_times(spark):
    d = spark.createDataFrame(rows_of(["a b"] + ["w " * 100] * 9, ["a"] + ["b"] * 9), SCHEMA)
    rows = {r["doc_id"]: r for r in mixing.mix(d).collect()}
    assert rows[0]["target"] == 6.0 and rows[0]["taken"] == 6
    assert rows[1]["target"] == pytest.approx(902 - 6)


# 5


def brute_print(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(simhash.LOWER))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(prints, bits):
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprints_and_classes(spark, docs, texts, none):
    got = {(r["doc_id"], r["f0"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    prints = {i: brute_print(t, 4) for i, t in enumerate(texts)}
    classes = brute_classes(prints, 4)
    assert got == {(i, prints[i], classes[i]) for i in prints}
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("dense", [3, 64])
def test_no_link_is_lost(spark, dense):
    rng = np.random.default_rng(4)
    prints = []
    for _ in range(40):
        base = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        prints += [base] + [base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)) for _ in range(6)]
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, f0 long")
    got = {tuple(r) for r in simhash.links(df, ["f0"], 4, 3, dense).collect()}
    want = {(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4}
    if dense == 64:
        assert got == want
    else:  # forests of crowded signatures connect what the links connect
        assert classes(got, len(prints)) == classes(want, len(prints))


def classes(pairs, n):
    least = list(range(n))
    for _ in range(n):
        before = least.copy()
        for i, j in pairs:
            least[i] = least[j] = min(least[i], least[j])
        if least == before:
            return least
    return least


def test_signatures_are_never_sent_through_the_driver(spark):
    """Counts of signatures, 63 for each fingerprint, are joined by a shuffle whatever size the optimizer expects."""
    rows = spark.range(300).selectExpr("id", "xxhash64(id div 2) AS f").selectExpr("id", "f", "explode(array(f, id, 7)) AS key")
    joined = simhash._counted(rows, "key")
    assert joined.count() > 300 and "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_a_ball_gives_a_forest(spark):
    """1,500 fingerprints that nearly all link: few pairs come out, in several blocks, and one class."""
    rng = np.random.default_rng(14)
    ball = {0} | {sum(1 << int(b) for b in rng.choice(np.arange(40, 60), 2, replace=False)) for _ in range(400)} | {1 << b for b in range(40, 60)}
    rows = [(i, f) for i, f in enumerate(sorted(ball))]
    df = spark.createDataFrame([(i, f, 1, 1, len(rows)) for i, f in rows], "id long, f long, key long, key2 long, n long")
    got = [tuple(r) for r in simhash._forests(df, 4, 50).collect()]
    assert set(classes(got, len(rows))) == {0} and len(got) < 16 * len(rows)


# 6


def test_exact_duplicates(spark, docs, none):
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    want = []
    for r in rows:
        g = groups[r["text"] or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((r["doc_id"], keep, len(g), keep == r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in cuckoo.exact_duplicates(docs).collect())
    assert cuckoo.exact_duplicates(none).count() == 0


def test_exact_dedup_is_its_sql(spark, sf):
    assert differences(catalog.QUERIES["op6_exact_dedup"](spark, sf), connect(sf), catalog.ORACLE_SQL["op6_exact_dedup"]) == ""


def test_cuckoo_filter_inserts_deletes_and_resizes():
    keys = np.random.default_rng(6).integers(0, 1 << 63, 20_000).astype(np.uint64)
    f = cuckoo.CuckooFilter(20_000)
    assert f.insert(keys) and f.contains(keys).all()
    other = np.random.default_rng(7).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert f.contains(other).mean() < 0.01
    f.delete(keys[:5000])
    assert f.contains(keys[5000:]).all() and f.contains(keys[:5000]).mean() < 0.01
    assert not cuckoo.CuckooFilter(64).insert(keys[:1000])
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    live, one = cuckoo.LiveDigests(64), [1] * 3000
    for at in range(0, 3000, 100):
        live.insert(digests[at : at + 100] * 2, [1] * 200, [1] * 200, [1] * 200, list(range(200)))
    assert live.resizes > 0 and live.size == len(live.stored) == 3000 and live.filter.contains(live._keys(digests)).all()
    assert live.delete(digests[:10], one, one, one, [7] * 10) == 10 and len(live.stored) == 3000
    assert live.delete(digests[:10] + [b"\0" * 32], one, one, one, [7] * 11) == 10 and len(live.stored) == live.size == 2990
    # The filter decides: what it doesn't know is never looked for, and what it wrongly knows is told by the content.
    live = cuckoo.LiveDigests(1 << 14)
    live.insert(digests, one, one, one, one)
    assert (live.misses, live.hits) == (3000, 0)
    live.insert(digests, one, one, one, one)
    assert (live.misses, live.hits, live.false_hits) == (3000, 3000, 0)
    live._verified = lambda *content: pytest.fail("a miss looked into a bucket")
    live.filter.contains = lambda keys: np.zeros(len(keys), bool)
    live.insert([b"\1" * 32], [1], [1], [1], [1])
    del live._verified
    live.filter.contains = lambda keys: np.ones(len(keys), bool)
    live.insert([b"\2" * 32, digests[0]], [1, 2], [1, 1], [1, 1], [1, 1])  # no such digest; one of another length
    assert live.false_hits == 2 and len(live.stored[digests[0]]) == 2


def test_index_insert_and_delete(spark):
    schema = "doc_id long, text string"
    a, b = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], schema), spark.createDataFrame([(4, "y"), (5, "z")], schema)
    index = cuckoo.insert(cuckoo.build_index(a, 2), b, 2)
    assert sorted((r["rows"], r["keep"]) for r in index.collect()) == [(1, 5), (2, 2), (2, 4)]
    gone = spark.createDataFrame([(4, "y"), (5, "z"), (1, "x"), (9, "unknown")], schema)
    left = cuckoo.delete(index, gone, spark.createDataFrame([(2, "x"), (3, "y")], schema), 2)
    assert sorted((r["rows"], r["keep"]) for r in left.collect()) == [(1, 2), (1, 3)]  # the row that stays lives


def test_line_dedup_touches_only_the_row(spark):
    """Rows that share a doc_id, or have none, lose their own lines alone; clashing names are defined."""
    shared = "this line is shared by several documents here"
    rows = [(1, shared + "\nfirst body line of one", 0, "q"), (5, shared + "\nanother body line of five", 0, "q"), (5, "a unique first line of five\nand one more line", 0, "q"), (None, "a unique line without an id\n" + shared, 0, "q"), (None, shared, 0, "q")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lines long, _sk_gone string")
    got = line_dedup.drop_recurring_lines(d)
    assert got.columns == ["doc_id", "text", "lines", "_sk_gone", "lines_", "lines_dropped"]
    texts = sorted((str(r["doc_id"]), r["text"], r["lines_"], r["lines_dropped"]) for r in got.collect())
    # Null counts as the least id, so its rows keep what all others lose.
    assert texts == sorted([("1", "first body line of one", 2, 1), ("5", "another body line of five", 2, 1), ("5", "a unique first line of five\nand one more line", 2, 0), ("None", "a unique line without an id\n" + shared, 2, 0), ("None", shared, 1, 0)])


def test_mix_takes_rows_that_share_an_id(spark):
    rows = [(None, "w " * 7, "a")] * 500 + [(1, "w " * (i + 1), "b") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(d, group=50).collect()
    for source in "ab":
        mine = [r for r in got if r["source"] == source]
        assert len(mine) == (500 if source == "a" else 200)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) < 0.02 * mine[0]["target"]
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
    assert len({r["taken"] for r in got if r["source"] == "a"}) <= 2
    copies = mixing.repeat(d).groupBy("source").count().collect()
    want = {s: sum(r["copies"] for r in got if r["source"] == s) for s in "ab"}
    assert all(abs(r["count"] - want[r["source"]]) < 0.15 * want[r["source"]] + 5 for r in copies)


# 7


def toxic_corpus(n):
    rng = np.random.default_rng(8)
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    bad = ["vileon", "grubby", "slurka", "foulish"]
    out, labels = [], []
    for i in range(n):
        w = rng.choice(words, 80).tolist()
        toxic = int(i % 6 == 0)
        for _ in range(4 * toxic):
            w[int(rng.integers(80))] = bad[int(rng.integers(4))] + ("x" if rng.random() < 0.3 else "") + ","
        out.append(" ".join(w))
        labels.append((i, toxic))
    return out, labels


def test_toxicity_on_held_out_rows(spark, none):
    t, labels = toxic_corpus(900)
    d = spark.createDataFrame(rows_of(t + [None, "", "vileon vileon slurka grubby foulish " * 2000]), SCHEMA)
    known = spark.createDataFrame(labels[:700] + [(3, None), (None, 1), (5, 7)], "doc_id long, toxic int")
    model = toxicity.fit(d, known)
    rows = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    assert len(rows) == 903
    for i in range(900):
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    wrong = [i for i, y in labels if rows[i]["predicted"] != y]
    assert len(wrong) <= 3
    assert rows[900]["predicted"] == rows[901]["predicted"] == 0 and rows[902]["predicted"] == 1 and rows[902]["evidence"]
    kept = {r["doc_id"] for r in toxicity.keep_clean(d, model).collect()}
    assert kept == {i for i, r in rows.items() if not r["predicted"]}
    blank = toxicity.fit(d, known.limit(0))
    assert toxicity.score(none, blank).count() == 0 and {r["predicted"] for r in toxicity.score(d, blank).collect()} == {0}


def test_labels_held_out_change_nothing(spark):
    t, labels = toxic_corpus(300)
    d = spark.createDataFrame(rows_of(t), SCHEMA)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (toxicity.fit(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.vocabulary.tolist() == b.vocabulary.tolist() and (a.slope, a.offset) == (b.slope, b.offset)


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    rng = np.random.default_rng(9)

    def unit():
        terms = np.sort(rng.choice(50, rng.integers(0, 8), replace=False))
        weights = rng.random(len(terms))
        return terms, weights / (np.sqrt((weights**2).sum()) or 1)

    vectors = [unit() for _ in range(700)]
    index = toxicity.BlockMaxIndex(vectors, rng.integers(0, 2, 700), np.arange(700), 50)
    dense = np.zeros((700, 50))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for _ in range(50):
        t, w = unit()
        cosines = dense[:, t] @ w
        want = sorted((-c, i) for i, c in enumerate(cosines.round(12)) if c > 0)[:10]
        got, rows = index.nearest(t, w, 10)
        assert np.allclose(got, [-c for c, _ in want]) and np.allclose(cosines[rows], got)


def test_words_of_many_texts_are_cut_together(monkeypatch):
    """A group of texts is cut once, and each text has the words it has by itself, whatever its characters."""
    texts = [None, "", "one Two two", "don't 'tis", "Stra\u00dfe \u0391\u0392 words \u4e2d\u6587 x", "x" * 40 + " " + "\u00e9" * 30, "tail'", "s first", "a\0b a", "ends here"] * 3
    cuts, one = [], toxicity.LatinWords.cut
    monkeypatch.setattr(toxicity.LatinWords, "cut", staticmethod(lambda raw: cuts.append(1) or one(raw)))
    counter = toxicity.WordCounter()
    together = [dict(zip(n.tolist(), c.tolist())) for n, c in counter.count(texts)]
    assert len(cuts) == 1 and len(together) == len(texts)
    for text, counts in zip(texts, together):
        numbers, again = next(counter.count([text]))
        assert counts == dict(zip(numbers.tolist(), again.tolist()))
    assert sorted(together[2].values()) == [1, 2] and sum(together[4].values()) == 5 and sum(together[5].values()) == 2 and list(counter.count([])) == []


def test_a_model_holds_each_posting_once():
    """Common terms are dense rows and no postings, and a worker that scores lets the tokenizer go."""
    rng = np.random.default_rng(2)
    vectors = [(np.unique(np.append(rng.integers(0, 500, 20), [3, 4])), None) for _ in range(900)]
    vectors = [(t, rng.random(len(t))) for t, _ in vectors]
    index = toxicity.BlockMaxIndex(vectors, np.arange(900) % 2, np.arange(900), 500)
    common = np.flatnonzero(index.column >= 0)
    assert {3, 4} <= set(common.tolist())
    held = [np.repeat(np.arange(500), np.diff(starts)) for starts, _, _ in index.blocks]
    assert not set(common.tolist()) & set(np.concatenate(held).tolist())
    assert sum(map(len, held)) + np.count_nonzero(index.dense) == sum(len(t) for t, _ in vectors)
    tokens.encoder(tokens.default_path())
    toxicity.fresh_counter(np.arange(5))
    assert not tokens._loaded


def test_examples_stay_out_of_the_driver(spark, monkeypatch):
    """Tasks build the index and write it, others open it: the driver makes none and sends none with its functions."""
    t, labels = toxic_corpus(300)
    built = []
    monkeypatch.setattr(toxicity.BlockMaxIndex, "__post_init__", lambda self: built.append(self))
    model = toxicity.fit(spark.createDataFrame(rows_of(t), SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert not built and not any(isinstance(x, toxicity.BlockMaxIndex) for x in vars(model).values())
    index = model.opened()
    taught = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    assert dict(zip(index.ids.tolist(), index.labels.tolist())) == taught and not index.dense.flags.writeable
    d = spark.createDataFrame(rows_of([None, ""] * 10), SCHEMA)  # examples without a term
    blank = toxicity.fit(d, spark.createDataFrame([(i, i % 4 // 2) for i in range(20)], "doc_id long, toxic int"))
    assert len({r["score"] for r in toxicity.score(d, blank).collect()}) == 1


def test_scores_are_those_of_brute_force(spark):
    """Every term, weight, neighbour and vote again, over dense vectors of plain Python counts."""
    import math

    t, labels = toxic_corpus(240)
    t[5], t[6] = "Größe ÆON vileon 漢字 слово слово naïve " * 3, None
    model = toxicity.fit(spark.createDataFrame(rows_of(t), SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    words = [re.findall(r"[^\W\d_]+", (x or "").lower()) for x in t]
    terms = [Counter(w) + Counter(w_[:n] + "*" for w_ in w for n in toxicity.BEGINNINGS if len(w_) > n) for w in words]
    taught = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    toxic = {i for i, y in labels if y}
    n, m = sum(i in toxic for i in taught), sum(i not in toxic for i in taught)
    weight = {}
    for term in {x for i in taught for x in terms[i]}:
        a, b = sum(term in terms[i] for i in taught if i in toxic), sum(term in terms[i] for i in taught if i not in toxic)
        ratio = 2 * sum(x * math.log(x * (n + m) / (of * both)) for x, of, both in ((a, n, a + b), (b, m, a + b), (n - a, n, n + m - a - b), (m - b, m, n + m - a - b)) if x)
        share, other = (a + 0.5) / (n + 1), (b + 0.5) / (m + 1)
        if a + b >= 2 and (term[-1] != "*" or (a >= 4 and ratio >= 16 and share / (share + other) >= 0.9)):
            weight[term] = (math.log((1 + len(t)) / (1 + sum(term in x for x in terms))) + 1) * (1 + max(0.0, ratio))
    assert len(model.vocabulary) == len(weight) and np.allclose(np.sort(model.weight), np.sort(list(weight.values())))
    order = list(weight)
    x = np.array([[(1 + math.log(c[w])) * weight[w] if w in c else 0.0 for w in order] for c in terms])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(norm == 0, 1, norm)
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows_of(t), SCHEMA), model).collect()}
    for i in range(len(t)):
        cosine = x[taught] @ x[i]
        near = np.lexsort((taught, -cosine.round(12)))[: toxicity.NEIGHBOURS]
        near = near[cosine[near] > 0]
        vote = (cosine[near] * [1 if taught[j] in toxic else -1 for j in near]).sum() / cosine[near].sum() if len(near) else 0.0
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-(model.slope * vote + model.offset))), abs=1e-6)


# 8

MIT = 'Copyright (c) 2020 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal.\n\nThe above copyright notice and this permission notice shall be included in all\ncopies.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.'
BSD3 = 'Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that:\n\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.\n3. Neither the name of X nor the names of its contributors may be used to endorse or promote products.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY WARRANTY IS OUT.'
LICENCES = [
    (MIT, ["MIT"]),
    (BSD3, ["BSD-3-Clause"]),
    (BSD3.replace("3. Neither the name of X nor the names of its contributors may be used to endorse or promote products.\n", ""), ["BSD-2-Clause"]),
    ("Some text.\nReleased under the MIT License.\nMore text.", ["MIT"]),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"]),
    ("// SPDX-License-Identifier: mit OR apache-2.0", ["MIT OR Apache-2.0"]),
    ("Dual licensed under the MIT license or the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
    ("License: BSD-3-Clause", ["BSD-3-Clause"]),
    ("license: none", []),
    ("This project uses the MIT License.", ["MIT"]),
    ("The MIT License is short.", []),
    ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
    ("All rights reserved.", ["LicenseRef-all-rights-reserved"]),
    ("The driver renewed a licence.", []),
    (None, []),
    ("", []),
    ("word " * 100_000 + "\nReleased under the MIT License.\n" + "word " * 10, ["MIT"]),
    ("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.", ["MIT", "Apache-2.0"]),
]


def test_licences(spark, none):
    d = spark.createDataFrame(rows_of([t for t, _ in LICENCES]), SCHEMA)
    got = {r["doc_id"]: r for r in licences.scan_licences(d).collect()}
    for i, (t, want) in enumerate(LICENCES):
        assert got[i]["licences"] == want
        assert all(0 <= p < len(t) for p in got[i]["places"])
    assert licences.scan_licences(none).count() == 0


@pytest.mark.parametrize("name, spdx", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("Artistic", "Artistic-1.0"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.3", "GFDL-1.3")])
def test_whole_licence_texts(name, spdx):
    """Found whole, and most of them as a comment too; its beginning isn't enough."""
    import os

    path = f"/usr/share/common-licenses/{name}"
    if not os.path.exists(path):
        pytest.skip("this machine has no licence texts")
    text = open(path).read()
    assert spdx in licences.scan(text)[0]
    if name not in ("Artistic", "GFDL-1.3"):  # their lists of clauses join otherwise behind marks
        assert spdx in licences.scan("One line of prose.\n\n" + "\n".join(" * " + x for x in text.split("\n")))[0]
    parts = text.split("\n\n")
    found = licences._texts([(at, n, {}) for at, s in licences._join("\n\n".join(parts[: len(parts) // 10])) for _, n, _ in licences.identify(s)], [True] * 10_000)
    assert spdx not in [n for _, n in found]


def test_hint_never_hides_a_sentence(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        found = [n for _, s in licences._join(r["text"]) for _, n, _ in licences.identify(s)]
        assert licences.scan(r["text"])[1] == found


# 9


def test_vectors(spark):
    rng = np.random.default_rng(10)
    x = rng.standard_normal((400, 16))
    for i in range(100, 180):
        x[i] = x[i - 100] + rng.standard_normal(16) * 0.07
    x[200] = x[7] * 3
    x[201] = x[7]
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    odd = [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [None] + [1.0] * 15), (404, [float("inf")] * 16), (405, []), (406, [1.0] * 3)]
    d = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in pq_dedup.near_duplicates(d, lists=16, block=37).collect()}
    y = np.array([v for _, v in vectors])
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    hit = (y @ y.T >= 0.95) & ~np.eye(400, dtype=bool)
    assert hit.sum() > 60
    found = sum(got[i]["n_links"] for i in range(400))
    assert found >= 0.99 * hit.sum() and all(got[i]["n_links"] <= hit[i].sum() for i in range(400))
    full = {r["vec_id"]: r for r in pq_dedup.near_duplicates(d, lists=16, block=64, margin=1.0).collect()}
    classes = brute_components(hit)
    for i in range(400):
        assert full[i]["n_links"] == hit[i].sum() and full[i]["component_id"] == classes[i] and full[i]["kept"] == (classes[i] == i)
    for i, _ in odd:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert pq_dedup.near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [8, 16, 64])
def test_default_recall_on_clusters(spark, dim):
    """Planted partners just inside the radius: of all links of brute force 0.99 and more are counted, at both ends."""
    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((200, dim))
    x = centres[rng.integers(0, 200, 3000)] + rng.standard_normal((3000, dim)) * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.standard_normal(x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = rng.uniform(0.951, 0.96, (3000, 1))
    y = np.concatenate([x, c * x + np.sqrt(1 - c * c) * u]).astype(np.float32).astype(np.float64)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "vec_id long, embedding array<float>")
    got = np.array([r["n_links"] for r in pq_dedup.near_duplicates(d).orderBy("vec_id").collect()])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (y @ y.T >= 0.95).sum(1) - 1
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() and (got == want).mean() > 0.95


def test_vectors_are_written_once(spark):
    """However many lists a vector's search probes, no table has rows for each of them."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((2000, 8))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    with storage.collected() as made:
        assert pq_dedup.near_duplicates(d, lists=40, margin=1.0).count() == 2000
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(made[0])
    there = [p for p in made if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
    vectors = [spark.read.parquet(p) for p in there]
    assert all(t.count() <= 2000 for t in vectors if {"embedding", "vector"} & set(t.columns))


def brute_components(hit):
    label = np.arange(len(hit))
    while True:
        low = np.minimum(label, np.where(hit, label[None], len(hit)).min(1))
        if (low == label).all():
            return label
        label = low


# 10


def test_pieces(spark, docs, none):
    rows = packing.pack_documents(docs).collect()
    want = Counter()
    for r in docs.collect():
        want[(r["doc_id"], len(encode(r["text"])) + 1)] += 1
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r["doc_id"]].append(encode(r["text"]) + [2])
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_row[r["row_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert Counter((p[0]["doc_id"], p[0]["doc_tokens"]) for p in by_row.values()) == want
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r["start"])
        at = 0
        for r in pieces:
            assert r["start"] == at and r["length"] > 0
            at += r["length"]
            assert any(r["ids_crc32"] == crc(x[r["start"] : r["start"] + r["length"]]) for x in ids[r["doc_id"]])
        assert at == pieces[0]["doc_tokens"]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two: nothing is padded
    assert packing.pack_documents(none).count() == 0


def test_walk_covers_the_graph_and_neighbours_are_near():
    rng = np.random.default_rng(11)
    v = rng.standard_normal((120, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    where, near = packing.neighbours(v, 5)
    s = v @ v.T
    np.fill_diagonal(s, -2)
    assert np.allclose(near, -np.sort(-s, axis=1)[:, :5], atol=1e-5)
    paths = packing.walk(where, near)
    assert sorted(i for p in paths for i in p) == list(range(120))
    step = np.mean([s[a, b] for p in paths for a, b in zip(p, p[1:])])
    assert step > np.mean(s[s > -2]) + 0.3


def test_encoder_is_the_tokenizer(docs):
    enc = tokens.TextEncoder(tokens.default_path())
    more = ["a.b,c ..., 3.5 x.'s It's. _.a ._ ΑΣ. İstanbul. á.b", " x y\x1cz\x85", "it's. don't, 'twas 'll.", "word " * 600_000]
    texts = [r["text"] for r in docs.collect()] + more
    for t, ids in zip(texts, enc.encode_all(texts)):
        assert ids.tolist() == encode(t) == enc.encode(t).tolist()


def test_encoder_is_the_tokenizer_on_odd_strings(monkeypatch):
    """100,000 strings of marks, odd spaces, cases and special tokens; words are forgotten on the way."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CACHE_WORDS", 6000)
    rng, bits = np.random.default_rng(12), "a|the|I|'s|'|''|'re|'LL|it's|don't|12|3.5|.|,|...|é|É|œ|Œuvre|–|’|“x”|ß|İ|\x1c|\x0b|\x85|\xa0|½|²|\t| |\n|\r\n|<\\endoftext\\>|<\\startoftext\\>|<\\|Σ|ΑΣ|漢字|á|\u0301|_|@#$|ª|µ|ƒ|ˆ|ŉ|Ĳ|antidisestablishmentarianism|ﬁ|ẞ|Ǆ|🙂| 'd|xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx".split("|")
    bits = [b.replace("\\", "|") for b in bits] + [f"w{i:x}" for i in range(5000)]
    odds = np.array([8.0] * (len(bits) - 5000) + [0.05] * 5000)
    picks = rng.choice(len(bits), 400_000, p=odds / odds.sum())
    spaced = rng.random(400_000) < 0.3
    words = [bits[i] + (" " if s else "") for i, s in zip(picks.tolist(), spaced.tolist())]
    cuts = np.sort(rng.choice(400_000, 100_000, replace=False))
    texts = ["".join(words[a:b]) for a, b in zip(cuts, cuts[1:])]
    library = Tokenizer.from_file(tokens.default_path())
    for special in (False, True):
        library.encode_special_tokens = special
        enc = tokens.TextEncoder(tokens.default_path(), special)
        assert enc.latin is not None
        wrong = [t for t, ids, e in zip(texts, enc.encode_all(texts), library.encode_batch_fast(texts, add_special_tokens=False)) if ids.tolist() != e.ids]
        assert not wrong


@pytest.mark.xfail(reason="not reached: fewer than 0.9 of lightly changed copies lie in the next window", strict=False)
def test_cells_keep_neighbours_together(spark):
    """Copies with a few words changed lie in the windows of their originals, or in the next ones."""
    rng = np.random.default_rng(13)
    words = [a + b + c + d for a in "bdfgklm" for b in ("ara", "elo", "imu") for c in ("t", "sen", "rik", "dol") for d in ("a", "on", "ix", "eth", "us", "or")]
    texts = [" ".join(rng.choice(words, 150)) for _ in range(1500)]
    texts += [" ".join(w if rng.random() > 0.05 else "changed" for w in t.split()) for t in texts]
    rows = packing.pack_documents(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4)).collect()
    window = {}
    for r in rows:
        window.setdefault(r["doc_id"], set()).add(r["sequence_id"])
    near = np.mean([min(abs(a - b) for a in window[i] for b in window[1500 + i]) <= 1 for i in range(1500)])
    assert near > 0.9
