"""Quality classifier, hard negatives and tokenizer alignment: brute force, held-out accuracy, odd inputs."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelwise.llm import alignment, hardneg, packing, qualityqda, queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
ODD = [
    (1, None), (2, ""), (2, ""), (None, "no id here"), (3, " ".join(f"wort{i % 977} été{i % 31}" for i in range(30_000))),
    (4, "\n\n \t\n"), (5, "same row twice"), (5, "same row twice"), (6, "<|endoftext|> </s>[INST] \\ <0x41> <unk>"), (7, "a▁b"),
    (8, "漢字かな 😀👍🏽 \u0000 é"), (9, " " * 5000 + "x"), (10, "aaaa" * 3000),
]


@pytest.fixture
def odd(spark):
    clash = ["r", "doc", "a", "b", "n", "x", "t", "teaches", "score", "pairs", "groups", "window", "id", "label"]
    return spark.createDataFrame(ODD, DOCS).select("*", *[F.lit(7).alias(c) for c in clash])


# --- tokenizer alignment


def spelled(text):
    """Tokens of both sides as ``(id, start, end)``, from the libraries themselves."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    if not hasattr(spelled, "known"):
        known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        known.encode_special_tokens = True
        spelled.known = known, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in visible]
        spelled.byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}
    known, model = spelled.known
    if not text:
        return [], []
    coded = known.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(spelled.byte[c] for c in t)) for i, t in zip(coded.ids, coded.tokens)]
    pieces = model.encode(text)
    b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, model.id_to_piece(i)) for i in pieces)]
    out = []
    for side in (a, b):
        if b"".join(x for _, x in side) != (" " + text).encode():
            return [], []
        at, placed = 0, []
        for i, x in side:
            placed.append((i, at, at + len(x)))
            at += len(x)
        out.append(placed)
    return out


def grouped(a, b):
    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
    out, low = [], 0
    for c in cuts:
        out.append(([i for i, s, e in a if low <= s and e <= c], [i for i, s, e in b if low <= s and e <= c], c))
        low = c
    return out


def test_alignment_against_brute_force(spark, odd):
    short = odd.filter("length(text) < 20000 OR text IS NULL")
    rows = alignment.align(short, detail=True).collect()
    assert len(rows) == short.count()
    texts = collections.defaultdict(list)
    for i, t in ODD:
        texts[i].append(t)
    for row in rows:
        a, b = spelled(texts[row["doc"]][0])
        want = grouped(a, b)
        assert [(list(g["a"]), list(g["b"]), g["end"]) for g in row["groups"]] == want, row["doc"]
        assert (row["n_a"], row["n_b"], row["n_groups"]) == (len(a), len(b), len(want))
        assert row["listing"] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in want)
        assert row["n_links"] == sum(len(x) * len(y) for x, y, _ in want)
        pairs = collections.Counter((i, j) for x, y, _ in want for i in x for j in y)
        assert {(p["a"], p["b"]): p["n"] for p in row["pairs"]} == pairs
        if len(a) < 300:
            overlaps = [(i, j) for i, (_, s, e) in enumerate(a) for j, (_, s2, e2) in enumerate(b) if s < e2 and s2 < e]
            assert [(o["a"], o["b"]) for o in row["overlaps"]] == overlaps
    empty = {r["doc"] for r in rows if r["n_a"] == 0}
    assert empty == {1, 2, 7}


@pytest.mark.parametrize("heavy", [3, 50_000])
def test_link_counts_against_brute_force(spark, tmp_path, heavy):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60 AND length(text) < 3000")
    docs = docs.unionByName(docs.filter("doc_id < 3")).select("doc_id", "text")
    got = sorted((r["doc"], r["n_best"], r["count_sum"]) for r in alignment.count_links(alignment.align(docs), heavy).collect())
    each = [(r["doc_id"], grouped(*spelled(r["text"]))) for r in docs.collect()]
    linked = [(d, collections.Counter((i, j) for x, y, _ in g for i in x for j in y)) for d, g in each]
    held = collections.Counter(p for _, pairs in linked for p in pairs)
    top = collections.defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    want = [(d, sum(n for p, n in pairs.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in pairs.items())) for d, pairs in linked]
    assert got == sorted(want)


def test_alignment_query(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in queries.op13_tokenizer_alignment(spark, str(tmp_path)).collect()}
    assert rows[1]["groups_sha256"] == "" and rows[1]["count_sum"] == 0 and rows[7]["n_best"] == 0
    want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in grouped(*spelled("same row twice")))
    assert rows[5]["groups_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert rows[5]["count_sum"] >= 2 * rows[5]["n_links"]
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op13_tokenizer_alignment(spark, str(tmp_path / "none")).count() == 0


def test_runs_of_a_million_blanks():
    from tokenizers import Tokenizer

    import public_tokenizers

    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for added in (False, True):
        known.encode_special_tokens = not added
        encoder = packing.Encoder(packing.default_tokenizer(), added)
        for text in (" " * 1_000_000, "\n" * 1_000_000 + "x<|endoftext|>"):
            assert encoder.encode(text).tolist() == known.encode(text, add_special_tokens=False).ids


# --- hard negatives


def mined(rows, anchors, n_positives=5, n_negatives=10):
    """By scoring every pair; rows are ``(id, label, vector of whole numbers)``."""
    out = []
    width = max((len(v) for *_, v in rows), default=0)
    m = np.array([list(v) + [0] * (width - len(v)) for *_, v in rows]).reshape(len(rows), width)
    for k, (i, label, _) in enumerate(rows):
        if not anchors(i):
            continue
        scores = (m @ m[k]).tolist()
        rank = sorted((r for r in range(len(rows)) if r != k), key=lambda r: (-scores[r], rows[r][0] is None, rows[r][0] or 0))
        for p in [r for r in rank if rows[r][1] == label][:n_positives]:
            fit = [r for r in rank if rows[r][1] != label and 30 * scores[p] <= 100 * scores[r] <= 90 * scores[p]]
            out += [(i, rows[p][0], n, rows[r][0], scores[p], scores[r]) for n, r in enumerate(fit[:n_negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [300, hardneg.BLOCK])
@pytest.mark.parametrize("width", [5, 40])
def test_hard_negatives_against_brute_force(spark, block, width):
    rng = random.Random(width)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = [(i, rng.choice([0, 0, 0, 1, 2, 3]), [c + rng.gauss(0, 0.6) for c in rng.choice(centres)]) for i in range(220)]
    # A third are copies of one vector, some with another label.
    rows += [(i, i % 11 == 0 and 5 or 0, rows[0][2]) for i in range(220, 330)]
    given = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    got = hardneg.mine(hardneg.usable(given, scale=16), F.col("id") % 15 == 0, block=block)
    whole = [(i, label, [math.floor(16 * x) for x in v]) for i, label, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == mined(whole, lambda i: i % 15 == 0)


def test_hard_negatives_odd_rows(spark):
    bad = [(100, None, [1.0]), (200, 1, None), (300, 1, [float("nan")]), (400, 1, [None]), (500, 1, [float("inf"), 1.0])]
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [1.0]), (2, 2, [0.5, 0.25]), (None, 2, [0.5, 0.25]), (3, 2, []), (4, 3, [-1.0, -1.0])]
    rows += [(600, 9, [0.0, 0.0]), (700, 9, [0.0, 0.0])]
    kind = "vec_id long, label int, embedding array<float>"
    given = spark.createDataFrame(rows + bad, kind).select("*", *[F.lit(1).alias(c) for c in ("r", "id", "v", "window", "low")])
    got = hardneg.mine(hardneg.usable(given), F.col("id") % 100 == 0).collect()
    want = mined([(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows], lambda i: i is not None and i % 100 == 0)
    bare = lambda found: sorted(tuple((x is None, x) for x in r) for r in found)
    assert bare(got) == bare(want) and want
    # Scores beyond exact numbers are still in order and inside long.
    huge = given.select("vec_id", "label", "embedding").unionByName(
        spark.createDataFrame([(800, 4, [3e38, 1.0]), (801, 4, [3e38, 2.0]), (802, 5, [1e38, 2.0])], kind)
    )
    got = hardneg.mine(hardneg.usable(huge), F.col("id") % 100 == 0).filter("anchor_id = 800").collect()
    assert all(0 < r["positive_score"] < 2**63 for r in got)
    assert hardneg.mine(hardneg.usable(given.filter("false")), F.col("id") % 100 == 0).count() == 0


# --- quality classifier


def test_discriminant_against_densities(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (300, qualityqda.SIZE)), rng.normal(0.8, 2, (200, qualityqda.SIZE))])
    label = np.array([0] * 300 + [1] * 200)
    rows = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, label)], "x array<double>, label int").repartition(5)
    model = qualityqda.fit(rows, pooled=0.2, unit=0.1)
    own = [np.cov(x[label == k].T, bias=True) for k in (0, 1)]
    together = (300 * own[0] + 200 * own[1]) / 500
    logs = []
    for k in (0, 1):
        s = 0.8 * own[k] + 0.2 * together
        s = 0.9 * s + 0.1 * np.trace(s) / qualityqda.SIZE * np.eye(qualityqda.SIZE)
        away = x - x[label == k].mean(axis=0)
        logs.append(-0.5 * np.einsum("ni,ij,nj->n", away, np.linalg.inv(s), away) - 0.5 * np.linalg.slogdet(s)[1])
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + np.log(200.5 / 300.5), -60, 60)))
    assert np.allclose(model.scores(x), want, atol=1e-9)


def test_classifier_held_out(spark):
    rows = queries.op11_quality_classifier(spark, "/root/testdata/sf0.1").collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)
    assert len(held) > 500 and right >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_classifier_odd_rows(spark, odd, tmp_path):
    labels = [(1, 1, 0), (2, 0, 0), (3, None, 0), (5, 1, 0), (5, 0, 1), (None, 1, 1), (6, 1, 0), (8, 0, 0), (99, 1, 0)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = qualityqda.classify(odd, given, F.col("doc") > 0).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc"] in (1, 2)}) == 1
    only = qualityqda.classify(odd, given.filter("quality = 1"), F.col("doc") > 0).collect()
    assert all(r["score"] == pytest.approx(1.0) for r in only)
    none = qualityqda.classify(odd, given.filter("false"), F.col("doc") > 0).collect()
    assert {r["score"] for r in none} == {0.5}
    assert qualityqda.classify(odd.filter("false"), given, F.col("doc") > 0).count() == 0
