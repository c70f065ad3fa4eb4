"""Benchmark decontamination with a distributed positional inverted index.

1. ``build_index`` reads the training texts once and stores a posting ``(term, r, doc, pos)`` for every
   occurrence of a test term, plus one posting of the end mark (term 0) that holds a document's length.
   Terms that occur in no test item can take part in no match and are left out. The shards of the index
   follow the input partitions, so building it shuffles nothing.
2. Each phrase (a window of an item) is looked up from its rarest terms: the lists of the rarest two,
   shifted by the term's offset in the phrase, are intersected first; only starts that survive are
   checked for the phrase's other terms.
3. ``slop`` 0 gives exact phrases; with a larger slop each term may lie up to that many words off its
   place (proximity matches).

Term frequencies are counted over the whole index. The test terms are sent to every executor only up to
``SMALL`` rows, counted first; beyond that the same joins run as shuffles, where adaptive execution
splits a frequent term. DataFrame functions only.

Defined results: null or empty text has no words, and no item without words is ever found. Repeated
rows of documents are documents of their own; repeated items are found together. An item of fewer words
than a window is one window. Words are never cut, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import keep_whole, near, plain_words, stage

WINDOW = 10

def phrases_of(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct phrases of the items as ``(phrase, len, offset, term)``, ``(phrase, item)`` and ``(term, word)``.

    A phrase of several items, or found several times in one, is looked up once.
    """
    words = items.select(F.col(item).alias("item"), plain_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words"))
    owned = stage(cut.distinct())
    named = stage(owned.select("words").distinct().select(F.monotonically_increasing_id().alias("phrase"), "words"))
    owner = stage(owned.join(named, "words").select("phrase", "item"))
    spelled = named.select("phrase", F.size("words").alias("len"), F.posexplode("words").alias("offset", "word"))
    # Number 0 is the end mark.
    vocabulary = stage(
        spelled.select("word").distinct().select((F.monotonically_increasing_id() + 1).alias("term"), "word")
    )
    terms = stage(spelled.join(vocabulary, "word").select("phrase", "len", "offset", "term"))
    return terms, owner, vocabulary


def build_index(docs: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored postings ``(term, r, doc, pos)`` of the vocabulary; term 0 at ``pos`` = number of words."""
    end = vocabulary.sparkSession.range(1).select(F.col("id").alias("term"), F.lit("").alias("word"))
    words = F.concat(plain_words(F.col(text)), F.array(F.lit("")))
    # Rows are numbered before they are taken apart.
    numbered = docs.select(F.monotonically_increasing_id().alias("r"), F.col(doc_id).alias("doc"), words.alias("words"))
    tokens = numbered.select("r", "doc", F.posexplode("words").alias("pos", "word"))
    return stage(tokens.join(near(stage(vocabulary.unionByName(end))), "word").select("term", "r", "doc", "pos"))


def find_phrases(index: DataFrame, terms: DataFrame, slop: int = 0) -> DataFrame:
    """``(phrase, r, start, len)`` of every occurrence, from the rarest terms on."""
    in_text = index.where("term > 0")
    frequency = in_text.groupBy("term").agg(F.count("*").alias("n"))
    # A term that occurs nowhere has no list, so the phrase is dropped by the first intersection.
    weighed = terms.join(frequency, "term", "left").fillna(0, ["n"])
    ordered = weighed.groupBy("phrase", "len").agg(
        F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("parts")
    )
    plan = stage(ordered.where(F.get("parts", F.lit(0))["n"] > 0))

    def one(part: int) -> DataFrame:
        p = F.get("parts", F.lit(part))
        return plan.where(F.size("parts") > part).select("phrase", "len", p["term"].alias("term"), p["offset"].alias("offset"))

    def shifted(entries: DataFrame) -> DataFrame:
        """Start positions that the lists of these terms ask for."""
        hits = in_text.join(near(entries), "term")
        start = F.col("pos") - F.col("offset")
        if slop:
            start = F.explode(F.sequence(start - slop, start + slop))
        return hits.select("phrase", "len", "r", start.alias("start")).where(F.col("start") + slop >= 0)

    found = shifted(one(0)).distinct() if slop else shifted(one(0))
    second = shifted(one(1)).select("phrase", "r", "start").distinct()
    # Phrases of one word have no second list.
    found = stage(
        found.where("len > 1").join(second, ["phrase", "r", "start"]).unionByName(found.where("len = 1"))
    )

    rest = plan.where(F.size("parts") > 2).select("phrase", F.slice("parts", 3, 1_000_000_000).alias("parts"))
    asked = found.join(rest, "phrase").select(
        "phrase", "r", "start", F.inline("parts")
    ).select("phrase", "r", "start", "offset", "term")
    place = F.col("start") + F.col("offset")
    place = F.explode(F.sequence(place - slop, place + slop)) if slop else place
    asked = asked.select("phrase", "r", "start", "offset", "term", place.alias("pos"))
    # Only documents with a start left have to be looked at again.
    rows = stage(found.select("r").distinct())
    lists = in_text.join(near(rows), "r", "left_semi").select("r", "pos", "term")
    met = asked.join(lists, ["r", "pos", "term"]).select("phrase", "r", "start", "offset")
    if slop:
        met = met.distinct()
    full = met.groupBy("phrase", "r", "start").agg(F.count("*").alias("n"))
    checked = found.where("len > 2").join(full, ["phrase", "r", "start"]).where("n = len - 2").drop("n")
    return checked.unionByName(found.where("len <= 2")).select("phrase", "r", "start", "len")


def contaminated_words(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """``(r, doc, n_words, n_hit, items)`` of every document; ``items`` is the sorted list of item ids as strings."""
    terms, owner, vocabulary = phrases_of(items, item, text, window)
    index = build_index(docs, vocabulary, doc_id, text)
    matches = stage(find_phrases(index, terms))
    spans = matches.select("r", "start", (F.col("start") + F.col("len")).alias("stop")).distinct()
    # Starts in order: a span adds the words beyond what those before it reach.
    before = F.expr("max(stop) OVER (PARTITION BY r ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    added = spans.select("r", "start", "stop", before.alias("before")).select(
        "r", F.greatest(F.col("stop") - F.greatest("start", F.coalesce("before", F.lit(0))), F.lit(0)).alias("n")
    )
    hit = added.groupBy("r").agg(F.sum("n").alias("n_hit"))
    phrases = matches.select("r", "phrase").distinct().join(near(owner), "phrase")
    found = phrases.select("r", F.col("item").cast("string").alias("item")).distinct()
    found = found.groupBy("r").agg(F.sort_array(F.collect_list("item")).alias("items"))
    whole = index.where("term = 0").select("r", "doc", F.col("pos").cast("long").alias("n_words"))
    return whole.join(hit.join(found, "r", "full"), "r", "left").select(
        "r",
        "doc",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """The documents in which no window of any item occurs, with their own columns."""
    rows = stage(docs.select(F.monotonically_increasing_id().alias("n"), keep_whole(docs, "d")))
    texts = rows.select(F.col("n").alias("row"), F.col(f"d.`{text}`").alias(text))
    terms, _, vocabulary = phrases_of(items, item, text, window)
    index = build_index(texts, vocabulary, "row", text)
    bad = stage(find_phrases(index, terms).join(index.where("term = 0").select("r", "doc"), "r").select(F.col("doc").alias("n")).distinct())
    return rows.join(near(bad), "n", "left_anti").select("d.*")
