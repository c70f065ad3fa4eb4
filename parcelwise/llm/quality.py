"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores one failure bit per rule next to the
measurements the rules looked at; policies are versioned masks over these bits, so a new policy or an
ablation reads the stored ledger and never evaluates a rule again. DataFrame functions only, one pass, no
shuffle.

Defined results: null or empty text has no words and fails ``few_words``; repeated rows are judged
each for itself; other columns, whatever their names, are carried through ``filter_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwise.llm.common import BLANKS, bind, blank_words, count_char, keep_whole, stage

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails when ``fails`` of the measurements is true."""

    name: str
    bit: int
    fails: Column


@dataclass(frozen=True)
class Policy:
    """A named version of the rules that count."""

    version: str
    rules: tuple[str, ...]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text."""

    def covered(at: Column) -> Column:
        # Start positions in order: each adds what the next one does not cover.
        def add(total: Column, k: Column) -> Column:
            here = F.get(at, k)
            return total + F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - here, F.lit(WINDOW))).cast("long")

        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0).cast("long"), add)

    def repeats(ranked: Column) -> Column:
        # Sorted by hash, equal windows are neighbours.
        def start(k: Column) -> Column:
            h = F.get(ranked, k)["h"]
            twin = F.get(ranked, k - 1)["h"].eqNullSafe(h) | F.get(ranked, k + 1)["h"].eqNullSafe(h)
            return F.when(twin, F.get(ranked, k)["i"])

        return F.sort_array(F.array_compact(F.transform(F.sequence(F.lit(0), F.size(ranked) - 1), start)))

    def count(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        none = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(none, F.lit(0).cast("long")).otherwise(bind(bind(ranked, repeats), covered))

    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))
    )
    return F.when(F.size(words) > WINDOW, bind(windows, count)).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc`` (the whole row) and the measurements of each text."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(keep_whole(docs, "doc"), body.alias("t"), blank_words(body).alias("w"))
    blanks = sum((count_char(F.col("t"), b) for b in BLANKS), F.lit(0).cast("long"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    twice = bind(lines, lambda a: F.struct(F.size(a).alias("all"), F.size(F.array_distinct(a)).alias("own")))
    return rows.select(
        "doc",
        F.size("w").cast("long").alias("n_words"),
        (F.char_length("t") - blanks).cast("long").alias("word_chars"),
        sum((count_char(F.col("t"), c) for c in SYMBOLS), F.lit(0).cast("long")).alias("n_symbols"),
        twice.alias("lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        count_char(F.col("t"), "!").alias("n_shouts"),
    ).select(
        "doc",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("lines.all") - F.col("lines.own")).cast("long").alias("n_dup_lines"),
        F.col("lines.all").cast("long").alias("n_lines"),
        "n_repeat_words",
        "n_shouts",
    )


def rules() -> tuple[Rule, ...]:
    """All rules; a bit is never given to another rule later."""
    c = F.col
    return (
        Rule("few_words", 0, c("n_words") < 10),
        Rule("repeated_words", 1, 100 * c("n_repeat_words") > 20 * c("n_words")),
        Rule("short_words", 2, c("word_chars") < 2 * c("n_words")),
        Rule("long_words", 3, c("word_chars") > 15 * c("n_words")),
        Rule("symbols", 4, 10 * c("n_symbols") > c("n_words")),
        Rule("repeated_lines", 5, 2 * c("n_dup_lines") > c("n_lines")),
        Rule("shouting", 6, 3 * c("n_shouts") > c("n_words")),
    )


BASE = Policy("base", ("few_words", "repeated_words"))
POLICY = Policy(
    "2024-1", ("few_words", "repeated_words", "short_words", "long_words", "symbols", "repeated_lines", "shouting")
)


def mask(policy: Policy) -> int:
    bits = {r.name: r.bit for r in rules()}
    return sum(1 << bits[name] for name in policy.rules)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` of every document; what all policies read."""
    measured = measure(docs, text)
    bits = sum((F.when(r.fails, F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules()), F.lit(0).cast("long"))
    return measured.withColumn("fail_bits", bits)


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(rows: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that only this rule rejects.

    One partial aggregate over the distinct masks (at most two to the power of the rules).
    """
    held = mask(policy)
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(held).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    named = [(r.name, 1 << r.bit) for r in rules() if r.name in policy.rules]
    counts = masks.agg(
        *[
            F.struct(
                F.coalesce(F.sum(F.when(F.col("m").bitwiseAND(F.lit(b).cast("long")) != 0, F.col("n"))), F.lit(0)).alias("failed"),
                F.coalesce(F.sum(F.when(F.col("m") == b, F.col("n"))), F.lit(0)).alias("only_here"),
            ).alias(name)
            for name, b in named
        ]
    )
    one = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n)["failed"].alias("failed"), F.col(n)["only_here"].alias("only_here")) for n, _ in named])
    return counts.select(F.lit(policy.version).alias("policy"), F.inline(one))


def filter_documents(docs: DataFrame, policy: Policy = POLICY, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns.

    The ledger is stored first: a filter on its bits would else be pushed below the measurements and
    evaluate them again for every rule.
    """
    return stage(ledger(docs, text)).where(passes(policy)).select("doc.*")
