"""Secret scans: candidates by shape, false positives removed by a random forest.

1. ``candidates`` takes every assigned or quoted value, URL parameter, password of a URL and bare piece of every
   blank-delimited word as a value of its own, with its name and the words around it. Values have at least 16
   characters and a digit; where a credential's name is assigned before it, any value with a letter or digit counts.
2. ``features`` measures length, character transitions, dictionary coverage, path and neighbouring words.
   The dictionary are the words the corpus itself uses: a letter run of a candidate is covered if at least
   ``MIN_DOCS`` documents hold it as a word of their own, counted over all documents.
3. A random forest is trained on labelled findings and gives every candidate a probability.

Labelled findings are passed in; without any, ``weak_findings`` labels those candidates that a strict rule can
decide: named like a credential and assigned, or plainly a number, an address or a path. The forest is fitted
on at most ``TRAINED`` labelled findings, taken in the order of a hash (a documented bound; scoring covers
every candidate). Weak labels and features share evidence, the neighbouring words; the rule also asks for an
assignment, which the forest does not see. Findings labelled by people are the better input.

DataFrame functions and Spark's own forest only. Defined results: null and empty texts have no candidates;
each occurrence is a finding of its own, repeated rows included. Bare values end at ``,;|``, brackets and quotes and before
a URL parameter; those of a credential's name end only at quotes and before the next assignment. A quoted value
with blanks is seen word by word. If the findings do
not show both labels, no forest can be fitted: the probability is null and the label decides.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import bind, blank_words, near, plain_words, stage

LEAST = 16
MIN_DOCS = 5
TRAINED = 20_000
TREES, DEPTH = 40, 8

# What credentials are called.
_CALLED = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|credential|bearer)"
#: The same where it waives the least size: an author is no credential.
_CREDENTIAL = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth(?!or)|credential|bearer)"
_ENDS = r"[=:]>?[\"']?$"
_SIGN = r"(?::=|=>|={1,3}|:)"
_WORD = r"[A-Za-z_][\w.\-]{0,63}"
_NAME = rf"(?:\"{_WORD}\"|'{_WORD}'|{_WORD})" + _SIGN
_NEXT = r"(?!" + _NAME + r"[^=])"
_QUOTED = r"\"[^\"]*\"|'[^']*'"
# Groups that repeat are bounded, as Java's patterns recurse there; what lies beyond begins the next piece.
_PIECE = (
    r"(?i)(?:" + _NAME + r"){0,8}?[\"']?[\w.\-]{0,40}(?:token|secret|passw|pwd|api.?key|access.?key|private.?key|auth(?!or)|credential|bearer)[\w.\-]{0,40}[\"']?"
    + _SIGN + r"(?!" + _NAME + r"[^=])(?:" + _QUOTED + r"|[^\"'=\[{(<][^\"',;&?|]*(?:[,;&?|]" + _NEXT + r"[^\"',;&?|]*){0,64})"
    r"|(?:" + _NAME + r"(?=[^=])){0,8}(?:" + _QUOTED + r"|[^\"',;&?|{}()<>\[\]]+(?:[&?]" + _NEXT + r"[^\"',;&?|{}()<>\[\]]*){0,64})"
)
#: Name and value of a piece.
_HOLDER = (
    r"(?s)^(?:" + _NAME + r"(?=[^=])){0,8}?(?:[\"']?(" + _WORD + r")[\"']?" + _SIGN + r"(?=[^=]))?"
    r"(?:\"([^\"]*)\"|'([^']*)'|" + _NEXT + r"(.*))$"
)
#: Marks behind a value without quotes; they are trimmed, as a pattern would walk back over each run of them.
_BEHIND = "\"')]>},.;:!?#*$%&"
_IN_URL = r"://[^/@:\s]*:([^/@\s]+)@"

FEATURES = (
    "size", "digits", "uppers", "hex", "marks", "transitions", "distinct", "coverage", "called_before", "called_inside",
    "quoted_value", "word_before", "word_after", "path_called", "path_depth",
)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``(row, doc, path, at, nth, name, value, quoted, before, earlier, after)``: value ``nth`` of word ``at``."""
    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    shaped = lambda x: (F.length(x) >= LEAST) & x.rlike("[0-9]")

    def long(w: Column) -> Column:
        word = lambda i: F.coalesce(F.get(w, i), F.lit(""))

        def wanted(x: Column, i: Column) -> Column:
            return shaped(x) | x.rlike(_CREDENTIAL) | x.rlike(_IN_URL) | _assigned_before(word(i - 1), word(i - 2))

        places = F.transform(w, lambda x, i: F.when(wanted(x, i), i))
        return F.struct(w.alias("w"), F.array_compact(places).alias("places"))

    # With the row number in the projection no filter is pushed below it, and the words are cut once.
    words = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc"),
        F.coalesce(where, F.lit("")).alias("path"),
        bind(blank_words(F.col(text)), long).alias("found"),
    )
    found = words.where(F.size("found.places") > 0).select("row", "doc", "path", F.col("found.w").alias("w"), F.explode("found.places").alias("at"))
    beside = lambda n: F.coalesce(F.get("w", F.col("at") + n), F.lit(""))
    rows = found.select("row", "doc", "path", "at", beside(0).alias("word"), beside(-1).alias("before"), beside(-2).alias("earlier"), beside(1).alias("after"))

    def held(x: Column) -> Column:
        part = lambda n: F.regexp_extract(x, _HOLDER, n)
        return F.struct(part(1).alias("name"), F.concat(part(2), part(3), F.rtrim(part(4), F.lit(_BEHIND))).alias("value"), x.rlike("[\"']").alias("quoted"))

    pieces = F.transform(F.regexp_extract_all("word", F.lit(_PIECE), 0), held)
    logins = F.transform(
        F.regexp_extract_all("word", F.lit(_IN_URL), 1), lambda x: F.struct(F.lit("password").alias("name"), x.alias("value"), F.lit(False).alias("quoted"))
    )
    each = rows.select("row", "doc", "path", "at", F.posexplode(F.concat(pieces, logins)).alias("nth", "p"), "before", "earlier", "after")
    named = each.select("row", "doc", "path", "at", "nth", "p.name", "p.value", "p.quoted", "before", "earlier", "after")
    first = (F.col("nth") == 0) & (F.length("name") == 0) & _assigned_before(F.col("before"), F.col("earlier"))
    waived = F.col("value").rlike("[A-Za-z0-9]") & (F.col("name").rlike(_CREDENTIAL) | first)
    return named.where(shaped(F.col("value")) | waived)


def _assigned_before(before: Column, earlier: Column) -> Column:
    """Whether a credential's name and a sign of assignment stand before a word."""
    return before.rlike(_CREDENTIAL) & before.rlike(_ENDS) | before.isin("=", ":", ":=", "=>") & earlier.rlike(_CREDENTIAL)


def dictionary(docs: DataFrame, parts: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """Those of ``parts`` (one column ``part``) that at least ``min_docs`` documents hold as a word."""
    wanted = near(parts)
    each = docs.select(F.explode(F.array_distinct(plain_words(F.col(text)))).alias("part"))
    met = each.join(wanted, "part").groupBy("part").agg(F.count("*").alias("n"))
    return met.where(F.col("n") >= min_docs).select("part", F.lit(True).alias("known"))


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def _shape(value: Column) -> Column:
    """Letters, digits and marks as ``a``, ``0`` and ``.``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "."), "[A-Za-z]", "a"), "[0-9]", "0")


def _flag(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


def features(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The candidates of a written table with their features and a row number ``f``."""
    numbered = stage(found.withColumn("f", F.monotonically_increasing_id()))
    runs = numbered.select("f", F.length("value").alias("size"), F.explode(F.regexp_extract_all("value", F.lit("([A-Za-z]{3,})"), 1)).alias("run"))
    runs = stage(runs.select("f", "size", F.lower("run").alias("part")))
    known = dictionary(docs, runs.select("part").distinct(), text)
    covered = runs.join(known, "part").groupBy("f").agg((F.sum(F.length("part")) / F.first("size")).alias("coverage"))
    value, shape = F.col("value"), _shape(F.col("value"))
    turns = F.length(F.regexp_replace(shape, r"a+|0+|\.+", "x")) - 1
    called = lambda c: _flag(F.col(c).rlike(_CALLED))
    return numbered.join(covered, "f", "left").select(
        *numbered.columns,
        F.length(value).cast("double").alias("size"),
        _share(value, "[^0-9]").alias("digits"),
        _share(value, "[^A-Z]").alias("uppers"),
        _share(value, "[^0-9a-fA-F]").alias("hex"),
        _share(value, "[A-Za-z0-9]").alias("marks"),
        (turns / F.length(value)).alias("transitions"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.length(value)).alias("distinct"),
        F.least(F.coalesce("coverage", F.lit(0.0)), F.lit(1.0)).alias("coverage"),
        F.greatest(called("before"), called("earlier")).alias("called_before"),
        called("name").alias("called_inside"),
        _flag(F.col("before").isin("=", ":", ":=", "=>") | F.col("before").rlike("[=:]$") | (F.length("name") > 0)).alias("assigned"),
        _flag(F.col("quoted")).alias("quoted_value"),
        F.least(F.length("before"), F.lit(20)).cast("double").alias("word_before"),
        F.least(F.length("after"), F.lit(20)).cast("double").alias("word_after"),
        called("path").alias("path_called"),
        F.size(F.split("path", "/")).cast("double").alias("path_depth"),
    )


def weak_findings(measured: DataFrame) -> DataFrame:
    """``label`` 1.0, 0.0 or null: what a strict rule can decide."""
    called = (F.col("called_before") + F.col("called_inside")) > 0
    plain = (F.col("digits") == 1.0) | F.col("value").rlike(r"@[A-Za-z0-9-]+\.|://|^www\.") | (F.col("coverage") > 0.8)
    firm = (F.col("size") >= LEAST) & (F.col("digits") > 0)
    label = F.when(plain, 0.0).when(firm & called & (F.col("assigned") == 1.0) & (F.col("marks") < 0.3), 1.0)
    return measured.withColumn("label", label)


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def fit(labelled: DataFrame, bound: int = TRAINED, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest on at most ``bound`` labelled findings, or None unless both labels are there."""
    taken = labelled.where("label IS NOT NULL").orderBy(F.xxhash64("value", "before", "f"), "f").limit(bound)
    taken = stage(_vectors(taken).select("features", "label"))
    if taken.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, subsamplingRate=0.8).fit(taken)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, findings: DataFrame | None = None) -> DataFrame:
    """``(doc, at, nth, value, label, probability, secret)`` of every candidate.

    ``findings`` may bring labels as ``(value, label)``; candidates are labelled by their value then.
    """
    measured = stage(features(candidates(docs, doc_id, text, path), docs, text))
    if findings is None:
        labelled = weak_findings(measured)
    else:
        given = findings.groupBy("value").agg(F.max("label").cast("double").alias("label"))
        labelled = measured.join(given, "value", "left")
    labelled = stage(labelled)
    model = fit(labelled)
    if model is None:
        scored = labelled.withColumn("probability", F.lit(None).cast("double"))
    else:
        scored = model.transform(_vectors(labelled)).withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    secret = F.coalesce(F.col("probability") >= 0.5, F.col("label") == 1.0, F.lit(False))
    return scored.select("doc", "at", "nth", "value", "label", "probability", secret.alias("secret"))
