"""Registered queries of the text operators: the thin layer that fits them to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from parcelwise.llm import (
    alignment,
    chat,
    decontam,
    hardneg,
    htmltext,
    licenses,
    linededup,
    neardup,
    packing,
    quality,
    qualityqda,
    secrets,
    urlrules,
)
from parcelwise.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query(
    "op6_quality_rules",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    words AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
    starts AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM words),
    windows AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS x FROM starts),
    twice AS (SELECT r, x FROM windows GROUP BY r, x HAVING count(*) > 1),
    hit AS (SELECT DISTINCT r, i + k AS p FROM windows JOIN twice USING (r, x), range(5) AS s(k)),
    repeats AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
    lines AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
    real_lines AS (SELECT r, x FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
    dups AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n FROM real_lines GROUP BY r),
    m AS (
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
             CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_shouts
      FROM d JOIN words USING (r) LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r)),
    b AS (
      SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT
             + 4 * (word_chars < 2 * n_words)::INT + 8 * (word_chars > 15 * n_words)::INT
             + 16 * (10 * n_symbols > n_words)::INT + 32 * (2 * n_dup_lines > n_lines)::INT
             + 64 * (3 * n_shouts > n_words)::INT AS BIGINT) AS fail_bits
      FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
           fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept
    FROM b
    """,
)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of every document with the verdicts of the base and the current policy."""
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "fail_bits",
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.POLICY).alias("kept"),
    )


@query(
    "op7_line_dedup",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
    lines AS (SELECT r, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM d),
    keyed AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM lines),
    frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
    kept AS (
      SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text
      FROM keyed WHERE k NOT IN (SELECT k FROM frequent) GROUP BY r)
    SELECT doc_id, CAST(len(x) AS BIGINT) AS n_lines, CAST(len(x) - coalesce(n, 0) AS BIGINT) AS n_dropped,
           sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (r)
    """,
)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines found in ten documents or more."""
    rows = linededup.strip_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return rows.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op1_decontamination",
    r"""
    WITH item_words AS (
      SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark),
    item_starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0),
    phrases AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + 9], ' ') AS x FROM item_starts),
    d AS (
      SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM documents),
    sizes AS (SELECT DISTINCT l FROM phrases),
    starts AS (SELECT r, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= l),
    cut AS (SELECT r, l, i, array_to_string(w[i:i + l - 1], ' ') AS x FROM starts),
    met AS (SELECT r, i, l, item_id FROM cut JOIN phrases USING (l, x)),
    hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + l)) AS p FROM met) GROUP BY r),
    found AS (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM met),
    listed AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM found GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(listed.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(hit.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
    """,
)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside a ten-word window of a benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontam.contaminated_words(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return rows.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document lies in the packed sequences."""
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), added=True)
    return pieces.select(
        F.col("doc").alias("doc_id"),
        "start",
        F.col("size").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        "offset",
    )


@query("op4_minhash_neardup")
def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    rows = neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.withColumnRenamed("doc", "doc_id")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through all stages, down to their packed pieces."""
    return corpus_pipeline.run(spark, sf_dir)


@query(
    "op2_url_filters",
    r"""
    WITH p AS (
      SELECT page_id,
             translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages),
    r AS (
      SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
      FROM p)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
    FROM r
    """,
)
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the longest of four rules that fits each page's URL."""
    given = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    each = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in given]
    rules = spark.range(1).select(F.inline(F.array(*each)))
    rows = urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return rows.select("page.page_id", "host", "path", "rule", "verdict")


@query(
    "op10_chat_formatting",
    r"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e AS (
      SELECT *, '[INST]' || regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') || '[/INST]'
                || regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') || '</s>' AS formatted
      FROM c)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(3 + sum(length(formatted)) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
    """,
)
def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what is read back from the formatted text."""
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("turn"), F.lit(r).alias("role"), said) for n, r in enumerate(("user", "assistant"))]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.range(1).select(F.inline(F.array(*extra))))
    done = chat.format_trees(chat.thread(rows))
    turns, learned = chat.read_back(F.col("formatted")), chat.masked(F.col("formatted"), F.col("loss"))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select("path.key", "formatted", turns.alias("turns"), learned.alias("learned")).select(
        F.col("key").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    rows = htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page.page_id", "page.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def _license_sql() -> str:
    """Every run of lines against every template, without the pruning."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(name)}, {quoted(text)})" for i, (name, text) in enumerate(licenses.TEMPLATES))
    words = lambda c: (
        f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return f"""
    WITH tw AS (SELECT t, license, {words("text")} AS w FROM (VALUES {values}) AS v(t, license, text)),
    ti AS (SELECT t, license, w, unnest(range(1, len(w))) AS i FROM tw),
    tb AS (SELECT DISTINCT t, license, w[i] || ' ' || w[i + 1] AS b FROM ti),
    tn AS (SELECT t, license, count(*) AS n, CAST(ceil(count(*) * 0.8 / 1.2 - 1e-9) AS INT) AS low,
                  CAST(floor(count(*) * 1.2 / 0.8 + 1e-9) AS INT) AS high FROM tb GROUP BY t, license),
    d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
    l AS (SELECT r, doc_id, unnest(range(1, len(x) + 1)) AS no, unnest(x) AS line FROM d),
    lw AS (SELECT r, doc_id, no, {words("line")} AS w FROM l),
    lr AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY no) AS k FROM lw WHERE len(w) > 0),
    top AS (SELECT min(low) AS low, max(high) AS high FROM tn),
    s AS (
      SELECT a.r, a.doc_id, a.no AS first_line, b.no AS last_line, flatten(list(c.w ORDER BY c.k)) AS w
      FROM lr a JOIN lr b ON a.r = b.r AND b.k BETWEEN a.k AND a.k + (SELECT high FROM top)
           JOIN lr c ON c.r = a.r AND c.k BETWEEN a.k AND b.k
      GROUP BY a.r, a.doc_id, a.no, b.no
      HAVING sum(len(c.w)) - 1 BETWEEN (SELECT low FROM top) AND (SELECT high FROM top)),
    si AS (SELECT r, doc_id, first_line, last_line, len(w) AS n, w, unnest(range(1, len(w))) AS i FROM s),
    sb AS (SELECT DISTINCT r, doc_id, first_line, last_line, n, w[i] || ' ' || w[i + 1] AS b FROM si),
    sn AS (SELECT r, first_line, last_line, count(*) AS m FROM sb GROUP BY ALL),
    c AS (SELECT r, doc_id, first_line, last_line, n, t, license, count(*) AS common FROM sb JOIN tb USING (b) GROUP BY ALL),
    g AS (
      SELECT c.*, 2.0::DOUBLE * common / (m + tn.n) AS dice
      FROM c JOIN sn USING (r, first_line, last_line) JOIN tn USING (t)
      WHERE c.n - 1 BETWEEN low AND high AND 2.0::DOUBLE * common / (m + tn.n) >= 0.8),
    f AS (SELECT *, row_number() OVER (PARTITION BY r, first_line ORDER BY dice DESC, last_line, t) AS p FROM g),
    o AS (SELECT *, row_number() OVER (PARTITION BY r, license ORDER BY dice DESC, first_line) AS q FROM f WHERE p = 1)
    SELECT doc_id, license, CAST(first_line AS INT) AS first_line, CAST(last_line AS INT) AS last_line, round(dice, 6) AS dice
    FROM o WHERE q = 1
    """


@query("op5_license_scans", _license_sql())
def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in each document, with the lines that name them."""
    rows = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("doc").alias("doc_id"), "license", "first_line", "last_line", F.round("dice", 6).alias("dice"))


@query("op9_secret_scans")
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict; values leave as digests only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = secrets.scan(docs, path="source")
    return rows.select(
        F.col("doc").alias("doc_id"),
        "at",
        F.sha2("value", 256).alias("value_sha256"),
        F.length("value").alias("n_chars"),
        F.col("label").cast("int").alias("label"),
        F.round("probability", 6).alias("probability"),
        "secret",
    )


@query("op11_quality_classifier")
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from four fifths of the labels."""
    fold = F.crc32(F.coalesce(F.col("doc").cast("string"), F.lit(""))) % 5
    rows = qualityqda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != 0)
    return rows.select(
        F.col("doc").alias("doc_id"),
        (~F.col("teaches")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query(
    "op12_hard_negatives",
    """
    WITH e AS (
      SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (
      SELECT a.r AS ar, a.vec_id AS anchor_id, e.r, e.vec_id, e.label = a.label AS same,
             CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
      FROM e AS a JOIN e ON a.r <> e.r WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) AS k FROM s WHERE same QUALIFY k <= 5),
    n AS (
      SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id, s.r) AS place
      FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
      QUALIFY place <= 10)
    SELECT anchor_id, positive_id, CAST(place AS INT) AS rank, negative_id, positive_score, negative_score FROM n
    """,
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every hundredth vector."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hardneg.usable(table(spark, sf_dir, "embeddings"), label=moved)
    return hardneg.mine(rows, F.col("id") % 100 == 0)


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two tokenizers in every document, and how common their links are."""
    aligned = alignment.align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("listing", 256)).alias("groups_sha256")
    rows = aligned.select(F.col("doc").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", digest, "pairs")
    return alignment.count_links(rows)
