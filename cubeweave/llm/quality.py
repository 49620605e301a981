"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document: the ledger holds the measurements and, in one number, a bit for
each rule that the document fails. A policy is a mask of rules, so later policies and ablations need no text:
they are bitwise operations over the ledger. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeweave.scratch import materialize

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Low bits of a packed window hold its position; a text has fewer words than 2**31.
POSITION_BITS = 31


@dataclass(frozen=True)
class Rule:
    """fails is an SQL condition over the measurements; null counts as passed."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("too_few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbol_heavy", 2, "n_symbols > n_words"),
    Rule("duplicate_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("long_words", 4, "word_chars > 40 * n_words"),
    Rule("short_words", 5, "word_chars < n_words * 3 div 2"),
)
#: Policies by version; what they reject only ever follows from the ledger.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(r.name for r in RULES),
    "v2": ("too_few_words", "repeated_windows", "symbol_heavy", "duplicate_lines"),
}


def mask(policy: str) -> int:
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in POLICIES[policy])


def _beside(items: str, same) -> Column:
    """The items of an array column that are the same as the one before or after them."""
    near = lambda x, y: F.coalesce(same(x, y), F.lit(False))
    return F.filter(items, lambda x, i: near(x, F.get(items, i - 1)) | near(x, F.get(items, i + 1)))


def with_repeat_words(rows: DataFrame, windows: str) -> DataFrame:
    """Replaces windows, an array of 64-bit hashes in text order, by n_repeat_words: the words in windows that
    occur twice or more.

    Windows are sorted with their positions in the low bits of one number; those that agree with a neighbour
    in the high bits are looked at again with their full hashes, sorted as (hash, position). A word counts
    once, however many such windows it is in. Each step is a projection of its own: an array that a lambda
    reads at other places must be a column, or it would be computed anew for each element.
    """
    others = [c for c in rows.columns if c != windows]
    bits = POSITION_BITS
    high = lambda x: F.shiftright(x, bits)
    none = F.array().cast("array<bigint>")
    twice = F.size(F.array_distinct(windows)) < F.size(windows)
    packed = F.sort_array(F.transform(windows, lambda x, i: F.shiftleft(high(x), bits).bitwiseOR(i.cast("long"))))
    sorted_ = rows.select(*others, windows, F.when(twice, packed).otherwise(none).alias("__packed"))
    agree = F.transform(_beside("__packed", lambda x, y: high(x) == high(y)), lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))
    pairs = sorted_.select(*others, F.sort_array(F.transform(agree, lambda i: F.struct(F.get(windows, i).alias("h"), i.alias("i")))).alias("__pairs"))
    places = F.sort_array(F.transform(_beside("__pairs", lambda x, y: x["h"] == y["h"]), lambda x: x["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-WINDOW).alias("p"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("p"), (s["n"] + F.least(F.lit(WINDOW), i - s["p"])).alias("n")), lambda s: s["n"],
    )
    # a one-row explode: predicates on n_repeat_words stay above it instead of repeating all of these projections in themselves
    return pairs.select(*others, F.explode(F.array(covered)).alias("n_repeat_words"))


def measure(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id and the measurements of every whole text; null texts have no words.

    Equality of windows is that of 64-bit hashes of their words' 64-bit hashes. Lines are compared whole.
    `keep` names further columns to carry along.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = documents.select(F.col(id_col).alias("doc_id"), text.alias("__text"), *[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)])
    rest = [f"__keep_{i}" for i in range(len(keep))]
    words = base.select(
        "doc_id", *rest, F.length(F.translate("__text", SYMBOLS, "")).alias("__plain"), F.length("__text").alias("__chars"),
        F.array_remove(F.split("__text", f"[{SPACE}]+"), "").alias("__words"),
        F.when(F.locate("\n", F.col("__text")) > 0, F.filter(F.split("__text", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "")) != "")).otherwise(F.array("__text")).alias("__lines"),
    )
    hashed = words.select(
        "doc_id", *rest, F.size("__words").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.col("__chars") - F.col("__plain")).cast("long").alias("n_symbols"),
        F.least(F.size("__lines"), F.size("__words")).cast("long").alias("n_lines"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )
    count = F.size("__hashes")
    windows = F.when(count >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(count - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get("__hashes", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    found = with_repeat_words(hashed.select("doc_id", *rest, *names, windows.alias("__windows")), "__windows")
    return found.select("doc_id", *names, "n_repeat_words", *[F.col(r).alias(c) for r, c in zip(rest, keep, strict=True)])


def ledger(documents: DataFrame, **options) -> DataFrame:
    """measure() and fail_bits: a bit for each rule that fails. All rules are evaluated, once."""
    rows = measure(documents, **options)
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES), F.lit(0))
    return rows.withColumn("fail_bits", bits.cast("long"))


def stored_ledger(documents: DataFrame, **options) -> DataFrame:
    """ledger(), written in the shared folder and read back: policies and ablations over it read no text."""
    return materialize(ledger(documents, **options), "quality-ledger")


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """Adds kept_<policy> to a ledger."""
    return rows.withColumn(f"kept_{policy}", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy costs: rule, failed, rejected_alone, kept_with, kept_without.

    The ledger is first counted by its bits, 2**rules rows at most, so the ablations are sums over those.
    An empty ledger gives no rows.
    """
    whole = mask(policy)
    seen = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("b")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in POLICIES[policy]]))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    b, bit = F.col("b"), F.col("r.bit")
    return seen.select("b", "n", rules.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        total(b.bitwiseAND(bit) != 0).alias("failed"), total(b == bit).alias("rejected_alone"), total(b == 0).alias("kept_with"), total(b.bitwiseAND(F.lit(whole).bitwiseXOR(bit)) == 0).alias("kept_without")
    )


def judge(documents: DataFrame, *, policy: str = "v1", others: Sequence[str] = (), **options) -> DataFrame:
    """The stored ledger with base_failed (policy base), kept (the given policy, which has base's rules) and kept_<policy> of the others.

    Null or empty texts have no words and fail. Rows with null or repeated ids are kept as they are; extra
    columns are ignored unless named in keep; an empty table gives no rows.
    """
    return verdicts(stored_ledger(documents, **options), policy, others)


def verdicts(rows: DataFrame, policy: str, others: Sequence[str] = ()) -> DataFrame:
    """A ledger with base_failed, kept and kept_<policy> of other policies."""
    if mask("base") & ~mask(policy):
        raise ValueError("a policy has the base rules at least")
    for p in (policy, *others):
        rows = apply_policy(rows, p)
    return rows.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0).withColumnRenamed(f"kept_{policy}", "kept")


def without_rejected(documents: DataFrame, *, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that a policy keeps, with all their columns.

    The ledger isn't stored here: rows go through it and on, so no text has to meet its verdict by a shuffle.
    """
    names = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(names))])
    rows = verdicts(ledger(plain, id_col=f"c{names.index(id_col)}", text_col=f"c{names.index(text_col)}", keep=plain.columns), policy)
    return rows.filter("kept").select(*plain.columns).toDF(*names)
