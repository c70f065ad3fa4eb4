"""The text operators on small tables: results by brute force, and the cases their docstrings define."""

import collections
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelwise.llm import chat, decontam, htmltext, licenses, linededup, neardup, packing, quality, secrets, shingles, urlrules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"wort{i % 977} été{i % 31}" for i in range(30_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (2, "", "en", "s", 0),
    (None, "A text\nwith no id", "en", None, 17),
    (3, LONG, "fr", "s", len(LONG)),
    (4, "\n\n \t\n", "en", "s", 5),
    (5, "same row twice and some more words to be kept here", "en", "s", 50),
    (5, "same row twice and some more words to be kept here", "en", "s", 50),
    (6, "<|endoftext|> </s>[INST] \\ ' \" $1 token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "en", "s", 1),
]


def folded(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return WORDS.findall(folded(text))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture
def odd(spark):
    """Awkward rows, with columns named like the operators' own."""
    clash = ["r", "doc", "d", "key", "t", "kept", "words", "path", "host", "line", "n", "comp", "fits", "lines", "url"]
    return spark.createDataFrame(ODD, DOCS).select("*", *[F.lit(7).alias(c) for c in clash])


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def repeated(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    return len({i + k for s in at.values() if len(s) > 1 for i in s for k in range(5)})


def test_quality_measures(spark, odd, none):
    texts = ["a b c d e a b c d e", "a a a a a a", "x " * 5000, "one\none\n \n \none two", "a\x0bb #c* d$%&|<>", "b c d e f q b c d e f c d e f q", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc"]["doc_id"]: r for r in quality.ledger(rows).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeated(t))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t
    assert quality.ledger(odd).count() == len(ODD)
    assert quality.filter_documents(odd).columns == odd.columns
    assert quality.filter_documents(none).count() == 0


def test_quality_ablation(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (3,), (16,)], "fail_bits long")
    got = {r["rule"]: (r["failed"], r["only_here"]) for r in quality.ablation(rows).collect()}
    assert got["few_words"] == (3, 2) and got["repeated_words"] == (1, 0) and got["symbols"] == (1, 1)


def test_line_dedup(spark, odd, none):
    texts = [f"Common LINE\nown {i}\n\n  common line \t" for i in range(6)] + [f"é common\nrare {i // 4}\nCOMMON line" for i in range(6)] + ["é Common", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = lambda x: folded(x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    count = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    for least in (2, 7, 12, 13):
        for batches in (1, 3, 9):
            got = {r["doc"]["doc_id"]: r for r in linededup.strip_lines(rows, least, batches=batches).collect()}
            for i, t in enumerate(texts):
                lines = (t or "").split("\n")
                stay = [x for x in lines if count[key(x)] < least]
                assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept"]) == (len(lines), len(lines) - len(stay), "\n".join(stay))
    assert linededup.strip_lines(odd, 2).count() == len(ODD)
    assert linededup.strip_lines(none).count() == 0


def test_line_runs_are_levelled(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for batch in range(5):
        runs.add(spark.range(3).select(F.lit(batch).alias("batch"), F.col("id").alias("h1"), F.lit(0).alias("h2")))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r["h1"], r["n_docs"]) for r in runs.counts().collect()} == {(0, 5), (1, 5), (2, 5)}
    assert runs.frequent(6).count() == 0


def phrase_hits(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        q = words(t)
        for s in range(max(1, len(q) - window + 1) if q else 0):
            p = q[s : s + window]
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, odd, none):
    items = [(1, "a b c d e"), (2, "The"), (3, "c d e f g h"), (10, "c d e f g h"), (4, None), (5, "!!"), (6, "nowhere to be found"), (7, "a a a")]
    texts = ["x a b c d, e y", "the THE tHe", "a a a a a b c d e f g h", "c d e f", "", None, "a b c", "é the_é"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.contaminated_words(rows, bench, window=4).collect()}
    assert got == {i: phrase_hits(t, items, 4) for i, t in enumerate(texts)}
    kept = decontam.drop_contaminated(rows, bench, window=4)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in enumerate(texts) if not phrase_hits(t, items, 4)[1]}
    assert decontam.drop_contaminated(odd, bench).columns == odd.columns
    assert decontam.contaminated_words(odd, bench).count() == len(ODD)
    assert decontam.contaminated_words(none, bench).count() == 0
    assert decontam.contaminated_words(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "red x green blue"), (2, "red x x x green blue"), (3, "green red blue")], "doc_id long, text string")
    terms, _, vocabulary = decontam.phrases_of(bench)
    index = decontam.build_index(rows, vocabulary)
    docs = index.where("term = 0").select("r", "doc")
    near = lambda slop: {r["doc"] for r in decontam.find_phrases(index, terms, slop).join(docs, "r").collect()}
    assert near(0) == set() and near(1) == {1, 3}


def test_shingles_and_signatures():
    texts = ["A b c d e f", "a b", "", "é ß ü x1 y2 z3 é ß ü x1 y2", "a b c d e " * 50]
    owner, element, count = shingles.shingle_sets([t.encode() for t in texts])
    assert [int((owner == i).sum()) for i in range(5)] == [len(shingle_set(t)) for t in texts]
    assert count[owner == 4].sum() == 246
    _, folded_element, _ = shingles.shingle_sets([b"a B c D e F"])
    assert set(folded_element.tolist()) == set(element[owner == 0].tolist())
    # Coordinates agree as often as the weighted Jaccard similarity says.
    rng = np.random.default_rng(5)
    a = {int(x): int(w) for x, w in zip(rng.integers(0, 2**62, 60), rng.integers(1, 4, 60), strict=True)}
    b = {x: (w if i % 3 else w + 1) for i, (x, w) in enumerate(a.items()) if i % 7}
    want = sum(min(a[x], b.get(x, 0)) for x in a) / (sum(a.values()) + sum(b.values()) - sum(min(a[x], b.get(x, 0)) for x in a))
    sets = np.array([0] * len(a) + [1] * len(b))
    values, weight = np.array([*a, *b], dtype=np.uint64), np.array([*a.values(), *b.values()])
    _, signature = shingles.dart_signatures(sets, values, weight, 2, 4000)
    assert abs((signature[0] == signature[1]).mean() - want) < 0.03


def mutated(rng, text, share):
    w = text.split()
    for i in rng.choice(len(w), max(1, int(share * len(w))), replace=False):
        w[i] = f"neu{rng.integers(10**6)}"
    return " ".join(w)


def by_brute_force(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if (texts[i] or "") == (texts[j] or "") or union and 5 * len(sets[i] & sets[j]) >= 4 * union:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def test_near_duplicates(spark, odd, none, monkeypatch):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{rng.integers(500)}" for _ in range(150)) for _ in range(6)]
    texts = base + [mutated(rng, base[0], 0.03) for _ in range(60)] + [mutated(rng, base[1], s) for s in (0.01, 0.02, 0.05, 0.2)]
    texts += [base[2], base[2].upper(), base[2] + " tail", None, "", "!!", "one two", "one, two"]
    chain = base[3]
    for _ in range(5):
        chain = mutated(rng, chain, 0.02)
        texts.append(chain)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc"]: r["class_id"] for r in neardup.near_duplicates(rows).collect()}
    assert [got[i] for i in range(len(texts))] == by_brute_force(texts)
    kept = neardup.keep_one(rows).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(by_brute_force(texts)))
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.near_duplicates(odd).count() == len(ODD)
    assert neardup.keep_one(odd).count() == len({t or "" for _, t, *_ in ODD})


def test_remaining_pairs_finds_what_leaders_miss(spark):
    """A bucket whose leader is unlike two texts that are alike."""
    rng = np.random.default_rng(9)
    base = " ".join(f"v{rng.integers(900)}" for _ in range(120))
    texts = [" ".join(f"u{rng.integers(900)}" for _ in range(120)), base, mutated(rng, base, 0.01)]
    rows = spark.createDataFrame(list(enumerate(texts)), "r long, t string")
    signed = neardup.sign(rows)
    # The bucket of the first band that the two like texts share.
    bands = {r["r"]: r["bands"] for r in signed.collect()}
    first = next(i for i in range(neardup.BANDS) if bands[1][i] == bands[2][i])
    buckets = spark.createDataFrame([(1, first, r, 3) for r in range(3)], "key long, band int, r long, n long")
    comp = spark.createDataFrame([], "r long, comp long")
    pairs = neardup.remaining_pairs(buckets, comp, signed, rows, 0.8, neardup.VALUES, neardup.BANDS)
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (7, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["r"]: r["comp"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 6)} == {1} and {got[i] for i in (7, 8, 9)} == {7} and {got[i] for i in range(100, 141)} == {100}


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    import public_tokenizers

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    known.encode_special_tokens = True
    rows = odd.repartition(3).cache()
    pieces = packing.pack(rows, length=64).collect()
    want = collections.Counter()
    for _, t, *_ in ODD:
        want[np.array(known.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()] += 1
    # Every id of every sequence once, in order and without gaps.
    sequences = collections.defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["size"]
        sequences[p["sequence_id"]].append(p)
    filled = []
    for s in sorted(sequences):
        at = 0
        for p in sorted(sequences[s], key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["size"]
        filled.append(at)
    assert sorted(sequences) == list(range(len(sequences))) and all(n == 64 for n in filled[:-1])
    order = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    whole, held = collections.Counter(), b""
    for p in order:
        assert p["start"] * 4 == len(held)
        held += bytes(p["ids"])
        if p["start"] + p["size"] == p["n"]:
            whole[held] += 1
            held = b""
    assert whole == want and held == b""
    assert packing.pack(none).count() == 0


def test_packing_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers
    from parcelwise.llm import queries

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", " <|endoftext|> <|endoftext|>\n", "<|endoftext", "plain <|im_end|> words", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in queries.op8_packing(spark, str(tmp_path)).collect()}
    want = [np.array(known.encode(t, add_special_tokens=False).ids + [1], dtype="<u4") for t in texts]
    assert got == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(want)}
    assert list(want[0]) == [64, 50256, 65, 1]


URLS = [
    "http://a.example.net/en/1?x#y", "HTTPS://EXAMPLE.NET/en/", "http://example.net/en", "http://net", "http://net/", "http://b.net/q",
    "ftp://x.org/fr/2", "http://x.org/de/2", "http://example.com/de/#/", "http://a.b.example.com/de/x", "http://notexample.com/de/x",
    "http://example-x.net/en/a", "no scheme", "", None, "://net/", "http://u@example.net/en/", "http://example.net:80/en/", "x://?q://net/", "http://a\nb.net/c\nd",
]


def judged(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (folded(m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_rules(spark, odd):
    rules = [
        ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
        ("a.example.net", "/en/1", "block"), ("net", "/q", "allow"), ("b.net", "", "allow"),
    ]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    urls = URLS + ["http://hot.net/x"] * 200
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("key", F.lit(2))
    got = {r["page"]["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge(pages, table).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}
    assert urlrules.judge(pages.limit(0), table).count() == 0
    assert urlrules.judge(pages, table.limit(0)).where("verdict = 'allow'").count() == len(urls)


def test_html_structure():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
    <header><p>no</p></header><nav><ul><li><a href="/x">no</a></ul></nav><div class="cookie-notice">no<div>no</div></div>
    <article><h1>A &amp; B</h1><p class=lead>One   <b>two</b>\n three &lt;four&gt;&nbsp;five<p>Six<br>seven &#233;&#x41; &am</p>
    <!-- <p>no</p> --><aside>no</aside><form><input value="no">no</form><div id="comments"><p>no</p></div><p hidden>no</p>
    <ul><li>x<li>y</ul><p></p></article><footer>no <p>no"""
    lines, certain = htmltext.read_lines(page)
    assert certain and lines == ["A & B", "One two three <four> five", "Six seven éA &am", "x", "y"]
    assert htmltext.read_lines("") == ([], False)
    assert htmltext.read_lines("plain <b>text</b> < 5 <a href=\"x>y") == (["plain text < 5 y"], False)
    assert htmltext.read_lines("<p>" * 50_000 + "deep")[0] == ["deep"]


def test_html_articles_that_mark_nothing():
    body = "<div class=post><p>One.</p><p>Two.</p></div>"
    for more in (
        "<aside><article>teaser</article></aside>", "<div id=comments><article>said</article></div>", "<script>x='<article>'</script>",
        "<!-- <main> -->", "<article></article>", "<ol><li class='comment even'><article class=comment-body>said</article></ol>",
    ):
        assert htmltext.read_lines(body + more) == (["One.", "Two."], False), more
        assert htmltext.read_lines(more + body) == (["One.", "Two."], False), more
    assert htmltext.read_lines("before<span role=main>in</span>after") == (["in"], True)


def test_html_whole_class_names():
    for name in ("elementor-widget-text-editor", "widget Blog", "content no-sidebar", "has-share", "article-header"):
        div = f'<div class="{name}"><h1>Head</h1><p>Text</p></div>'
        assert htmltext.read_lines(f"<article>{div}</article>") == (["Head", "Text"], True), name
        assert htmltext.read_lines(div) == (["Head", "Text"], False), name
        assert htmltext.read_lines(f'<div class="{name}"><main>x</main></div>') == (["x"], True), name
    page = "<div class=site-header>no</div><div class='a cookie-notice'>no</div>{}<p>yes</p><div class='share x'>no</div>{}"
    assert htmltext.read_lines(page.format("", "")) == (["yes"], False)
    assert htmltext.read_lines(page.format("<article>", "</article>")) == (["yes"], True)
    assert htmltext.read_lines("<article><pre><span class='token comment'># yes</span></pre></article>") == (["# yes"], True)


def test_html_differencing(spark):
    page = lambda body: f"<html><body><div>Shop of all</div>{body}<div>All rights</div></body></html>"
    rows = [
        (1, "http://h.net/a/1", page("<p>first</p>")), (2, "http://h.net/a/2", page("<p>second</p>")), (3, "http://h.net/b", page("<p>third</p>")),
        (4, "http://alone.net/", page("<p>alone</p>")), (5, "http://m.net/1", "<article><p>kept</article>"), (6, "http://m.net/2", "<article><p>kept</article>"),
        (7, None, None), (8, "http://c.net/1", page("")), (9, "http://c.net/2", page("")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit(1))
    got = {r["page"]["page_id"]: r["text"] for r in htmltext.extract(pages).collect()}
    assert got == {
        1: "first", 2: "second", 3: "third", 4: "Shop of all\nalone\nAll rights", 5: "kept", 6: "kept", 7: "",
        8: "Shop of all\nAll rights", 9: "Shop of all\nAll rights",
    }
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_html_near_copies_and_shared_passages(spark):
    page = lambda *body: "<div>Menu</div>" + "".join(f"<p>{x}</p>" for x in body) + "<div>All rights</div>"
    text = lambda n: [f"Text {n} paragraph {i} with words of its own" for i in range(6)]
    bodies = {
        "/a/1": text(1), "/a/1-print": [*text(1)[:5], "Another end"], "/a/1-x": ["Another start", *text(1)[1:]],
        "/a/2": [*text(2), "A passage of two"], "/a/3": ["A passage of two", *text(3)], "/a/4": text(4), "/a/5": text(5),
    }
    rows = [(f"http://h.net{k}", page(*v)) for k, v in bodies.items()] + [(f"http://two.net{k}", page(*bodies[k])) for k in ("/a/1", "/a/1-x")]
    got = {r["page"]["url"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert {k: got[f"http://h.net{k}"].split("\n") for k in bodies} == bodies
    assert all("\n".join(bodies[k]) in got[f"http://two.net{k}"] for k in ("/a/1", "/a/1-x"))


def test_html_template_across_runs(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "RUN", 7)
    monkeypatch.setattr(htmltext, "REACH", 3)
    rows = spark.range(300).select(
        F.format_string("http://h%d.net/%03d", F.col("id") % 2, F.col("id")).alias("url"),
        F.format_string("<p>top</p><p>own %d</p><p>end</p>", "id").alias("html"), "id",
    )
    got = {r["page"]["id"]: r["text"] for r in htmltext.extract(rows.repartition(5)).collect()}
    assert got == {i: f"own {i}" for i in range(300)}


def _outward(pages):
    """Kept lines of ``(host, path, lines)`` by the definition, without any reach."""
    made = [htmltext._Page(i, h, p, np.array([hash(x) for x in ls]), np.array([len(x.split()) for x in ls])) for i, (h, p, ls) in enumerate(pages)]
    order = sorted(made, key=lambda p: (p.host, p.path, p.row))
    out = {}
    for at, page in enumerate(order):
        common = lambda k: len(os.path.commonprefix([page.path, order[k].path]))  # noqa: E731, B023
        others = sorted((-common(k), k < at, abs(k - at), k) for k in range(len(order)) if k != at and order[k].host == page.host)
        taken = []
        for *_, k in others:
            if len(taken) < 2 and not any(order[k].copies(p) for p in (page, *taken)):
                taken.append(order[k])
        kept = htmltext.kept_lines(page.lines, [p.lines for p in taken])
        lines = pages[page.row][2]
        out[page.row] = "\n".join(x for x, y in zip(lines, kept or [True] * len(lines), strict=True) if y)
    return out


def test_html_template_beyond_many_copies(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "RUN", 8)
    monkeypatch.setattr(htmltext, "REACH", 3)
    near = lambda i: ["top", *[f"same {k}" for k in range(9)], f"own {i}", "end"]
    pages = [("a.net", f"/c/{i:03d}", ["top", "the very same", "end"]) for i in range(60)]
    pages += [("a.net", f"/c/{i:03d}", near(i)) for i in range(60, 100)]
    pages += [("a.net", f"/x/{i}", ["top", f"other {i}", "and more", "end"]) for i in range(3)]
    pages += [("b.net", f"/{i:02d}", near(i)) for i in range(40)] + [("c.net", f"/{i:02d}", near(i)) for i in range(30)] + [("c.net", "/99", ["top", "z", "end"])]
    rng = np.random.default_rng(3)
    kinds = [["top", *[f"kind {k} line {j}" for j in range(6)], "end"] for k in range(3)]
    pages += [("d.net", "/" + "".join(rng.choice(list("ab"), 5)) + str(i), [*kinds[rng.choice(3, p=[0.9, 0.06, 0.04])], f"own {i % 7}"]) for i in range(120)]
    rows = [(i, f"http://{h}{p}", "".join(f"<p>{x}</p>" for x in ls)) for i, (h, p, ls) in enumerate(pages)]
    got = {r["page"]["id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "id long, url string, html string").repartition(5)).collect()}
    assert got[0] == "the very same" and got[59] == "the very same"
    want = _outward(pages)
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (["".join(x) for x in rng.choice(list("abcd"), rng.integers(0, 12))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert len(a) - len(htmltext.without_shared(a, b)) == table[-1, -1]


def test_partners_cross_partitions(spark):
    rows = spark.range(500).select(F.col("id").alias("r"), F.lit("h").alias("host"), F.format_string("/%03d", F.col("id")).alias("path"))
    got = {r["r"]: r["partner"] for r in htmltext.partners(rows.repartition(7)).collect()}
    assert len(got) == 500 and all(abs(r - p) == 1 for r, p in got.items())


def test_licenses(spark, odd, none):
    mit = dict(licenses.TEMPLATES[::-1])["MIT"]
    long_mit = max((t for n, t in licenses.TEMPLATES if n == "MIT"), key=len)
    cut = long_mit.split(" ")
    texts = [
        f"Some prose.\n{mit.upper()}\nMore prose of the kind.", "intro\n" + "\n".join(" ".join(cut[i : i + 12]) for i in range(0, len(cut), 12)) + "\nend",
        "MIT License", "Licensed under CC BY-NC 4.0.", "The work of the MIT.", None, "",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc"], r["license"]): (r["first_line"], r["last_line"], r["dice"]) for r in licenses.scan(rows).collect()}
    assert set(got) == {(0, "MIT"), (1, "MIT"), (3, "CC-BY-NC-4.0")}
    assert got[0, "MIT"] == (2, 2, 1.0) and got[1, "MIT"][:2] == (2, 8)  # line 9 brings no new bigram
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


def test_secrets_on_held_out_findings(spark, none, odd):
    """Trained on half of the labelled findings, held against the other half."""
    rng = np.random.default_rng(2)
    hexed = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    rows, truth = [], {}
    for i in range(160):
        if i % 2:
            value = hexed(40)
            rows.append((i, f"some words token = \"{value}\" and others", "src/app/config"))
        else:
            value = str(rng.integers(10**15, 10**16))
            rows.append((i, f"some words order {value} and others", "docs"))
        truth[value] = float(i % 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    train = spark.createDataFrame([(v, t) for i, (v, t) in enumerate(truth.items()) if i % 4 < 2], "value string, label double")
    got = secrets.scan(docs, path="source", findings=train).where("label IS NULL").collect()
    assert len(got) == 80
    assert np.mean([r["secret"] == bool(truth[r["value"]]) for r in got]) > 0.95
    assert secrets.scan(none).count() == 0
    assert [r["value"] for r in secrets.scan(odd).where("secret").collect()] == ["04dbebab91ab85687d33eeaaf9ac699e1188f962"]


def test_secret_candidates_inside_words(spark):
    key, other = "9233b1c04e7f4d21a8", "77aa01c04e7f4d21b9"
    cases = {
        f'{{"user":"bob","token":"{key}","n":1}}': [("token", key)],
        f"https://host/v1?access_token={key}&n=1": [("access_token", key)],
        f"a={key},b={other}": [("a", key), ("b", other)],
        f"[{key},'{other}']": [("", key), ("", other)],
        "password=hunter": [("password", "hunter")],
        "password = hunter and more": [("", "hunter")],
        'the "pwd": "allletters", and': [("", "allletters")],
        "https://bob:open@host/": [("password", "open")],
        f"(token:{key}==).": [("token", f"{key}==")],
        "password=a,b?c;d": [("password", "a,b?c;d")],
        f"{key}==": [("", f"{key}==")],
        "author: Smith wrote hunter": [],
        f"x=\"{key},{other}\"": [("x", f"{key},{other}")],
        "?,&" * 30_000 + f";token={key}": [("token", key)],
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in secrets.candidates(docs).orderBy("doc", "at", "nth").collect():
        got[r["doc"]].append((r["name"], r["value"]))
    for i, (text, want) in enumerate(cases.items()):
        assert got[i] == want, text[:80]


CHATS = [
    (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<s>\\ </s> <\\s> [\\\\INST] $1"), (1, 2, "assistant", None), (2, 0, None, ""),
    (2, 0, None, ""), (None, 1, "assistant", "x\ny"), (3, None, "[/INST]", "é" * 10), (3, 5, "assistant", "<</s>>"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    done = chat.format_trees(chat.thread(rows))
    got = done.select(
        "path.key", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("learned")
    )
    got = {r["key"]: r for r in got.collect()}
    for key in (1, 2, 3, None):
        said = sorted((c[1:] for c in CHATS if c[0] == key), key=lambda c: (c[0] is None, c[0]))
        assert [tuple(t) for t in got[key]["turns"]] == [(r or "", t or "") for _, r, t in said]
        assert got[key]["learned"] == "".join(t or "" for _, r, t in said if r == "assistant")
        assert got[key]["formatted"].count("</s>") == len(said)
    assert chat.format_trees(chat.thread(rows.limit(0))).count() == 0


def test_chat_branches(spark):
    nodes = [
        ("a", 1, None, 0.0), ("a", 2, 1, 5.0), ("a", 3, 1, 1.0), ("a", 4, 3, 1.0), ("a", 5, 3, 9.0), ("a", 6, 99, 2.0), ("c", 1, 2, 0.0), ("c", 2, 1, 0.0),
    ]
    table = spark.createDataFrame(nodes, "tree string, node int, parent int, score double")
    got = collections.defaultdict(list)
    for r in chat.best_paths(table, per_tree=2).orderBy("depth").collect():
        got[r["tree"], r["place"]].append(r["node"])
    assert dict(got) == {("a", 1): [1, 3, 5], ("a", 2): [1, 2]}
    deep = spark.range(300).select(F.lit("t").alias("tree"), F.col("id").cast("int").alias("node"), F.when(F.col("id") > 0, F.col("id").cast("int") - 1).alias("parent"), F.lit(0.0).alias("score"))
    assert chat.best_paths(deep).count() == 300


def test_pipeline(spark, tmp_path):
    """Every stage against its brute force on the same input."""
    rng = np.random.default_rng(4)
    prose = lambda n: "\n".join(" ".join(f"p{rng.integers(3000)}" for _ in range(12)) + "." for _ in range(n))
    good = [prose(6) for _ in range(12)]
    shared = "this very line stands in ten documents or in more"
    item = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11"
    texts = [t + "\n" + shared for t in good] + [good[0] + "\n" + shared, mutated(rng, good[1].replace("\n", " "), 0.01), prose(5) + " " + item, "too short", "spam " * 60, None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = list(range(12)) + [14]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in rows}) == [i for i in kept if i != 14]
    encoder = packing.Encoder(packing.default_tokenizer())
    for i in range(12):
        ids = np.append(encoder.encode(good[i]), np.uint32(1)).astype("<u4")
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["doc_tokens"] for r in mine] == [len(ids)] * len(mine)
        assert [r["ids_crc32"] for r in mine] == [zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine]
