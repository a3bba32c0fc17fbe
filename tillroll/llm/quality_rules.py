"""Quality rules as a ledger of bits: every rule is evaluated once, policies and ablations only read the bits.

``measured`` takes the measurements of a text, ``ledger`` adds one BIGINT with a bit for every rule that fails,
``apply_policy`` keeps what fails none of a policy's rules, ``ablation`` tells what each rule of a policy costs.
All of it is made of Spark's own functions, row by row: no shuffle, however long or skewed the texts are.

Defined cases: a null text counts as an empty one (no words, no lines, fails ``too_few_words``); repeated rows are judged
each for itself; extra columns are dropped by ``measured`` unless named in ``keep``; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.llm.common import WORD

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` stays with the rule for good, so that old ledgers can be read."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 20 * n_words"),
    Rule(6, "few_letters", "5 * n_letters < 2 * word_chars"),
    Rule(7, "stutter", "10 * n_stutter > 3 * n_words"),
)
BASE = ("too_few_words", "repeated_windows")
# version -> names of the rules it applies
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(r.name for r in RULES)}


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[name] for name in set(names))


def _neighbours(items: Column, gap: int, length: Column, join) -> Column:
    """``join`` of every element with the one ``gap`` further on."""
    n = F.greatest(length - gap, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(1 + gap), n), join)


def _mixed(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def measured(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Measurements per document; the columns ``keep`` are carried along under their names.

    n_words; word_chars (code points in words); n_symbols; n_lines (lines with a word); n_dup_lines (those equal to an
    earlier one); n_repeat_words (words in 5-word windows found twice or more in the text); n_letters;
    n_stutter (words equal to the one before).

    Every step stands in a projection of its own and is used at least twice by the next: Spark then keeps it as a column
    instead of working it out again inside the next expression.
    """
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    names = [f"_keep{i}" for i in range(len(keep))]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*kept, body.alias("_text"))
    rows = rows.select(
        *names,
        "_text",
        F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    rows = rows.select(
        *names,
        F.size("_words").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("int").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).alias("n_symbols"),
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.length(F.regexp_replace("_text", r"[^\p{L}]+", "")).alias("n_letters"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    scalars = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_letters"]
    n = F.col("n_words")
    # hashes of windows of 2, then 4, then 5 words
    stutter = F.size(F.filter(_neighbours(F.col("_h"), 1, n, lambda a, b: a == b), lambda same: same))
    rows = rows.select(
        *names, *scalars, "_h", _neighbours(F.col("_h"), 1, n, _mixed).alias("_two"), stutter.alias("n_stutter")
    )
    scalars.append("n_stutter")
    rows = rows.select(*names, *scalars, "_h", _neighbours(F.col("_two"), 2, n - 1, _mixed).alias("_four"))
    m = F.greatest(n - (WINDOW - 1), F.lit(0))
    five = F.zip_with(F.slice("_four", F.lit(1), m), F.slice("_h", F.lit(WINDOW), m), _mixed)
    rows = rows.select(*names, *scalars, five.alias("_five"))
    positions = F.sequence(F.lit(0), F.size("_five") - 1)
    # windows are sorted only where one of them occurs twice
    twice = F.size(F.array_distinct("_five")) < F.size("_five")
    found = F.when(twice, F.sort_array(F.arrays_zip(F.col("_five").alias("g"), positions.alias("i"))))
    rows = rows.select(*names, *scalars, found.alias("_z"))
    none = F.array().cast("array<int>")
    same = _neighbours(
        F.col("_z"), 1, F.size("_z"), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])).otherwise(none)
    )
    rows = rows.select(*names, *scalars, F.sort_array(F.array_distinct(F.flatten(same))).alias("_p"))
    # a window covers five words, or as many as lie before the next one
    steps = _neighbours(F.col("_p"), 1, F.size("_p"), lambda a, b: F.least(F.lit(WINDOW), b - a))
    covered = F.when(F.size("_p") > 0, F.aggregate(steps, F.lit(WINDOW), lambda total, x: total + x)).otherwise(0)
    # a filter on the result must not be moved below these projections, where all of them would be worked out again
    # inside it: it stays above an expression that depends on the row's place
    covered = F.when(F.monotonically_increasing_id() >= 0, covered).otherwise(0)
    return rows.select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
        *[F.col(c).cast("bigint") for c in scalars],
        covered.cast("bigint").alias("n_repeat_words"),
    )


def ledger(
    docs: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """Measurements and ``failed``: bit ``rule.bit`` is set if that rule fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint") for r in rules]
    failed = F.lit(0).cast("bigint")
    for bit in bits:
        failed = failed.bitwiseOR(bit)
    return measured(docs, keep, text).withColumn("failed", failed)


def apply_policy(
    rows: DataFrame,
    policy: str,
    policies: Mapping[str, Sequence[str]] = POLICIES,
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """Adds ``kept``: none of the policy's rules failed. Rules outside the policy do not matter."""
    bits = F.lit(mask(policies[policy], rules)).cast("bigint")
    return rows.withColumn("kept", F.col("failed").bitwiseAND(bits) == 0)


def ablation(
    rows: DataFrame,
    policy: str,
    policies: Mapping[str, Sequence[str]] = POLICIES,
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that would be kept without it.

    Documents are first counted by their bits, of which there are at most 2 to the number of rules.
    """
    whole = mask(policies[policy], rules)
    bits = F.col("failed").bitwiseAND(F.lit(whole).cast("bigint")).alias("bits")
    patterns = rows.groupBy(bits).agg(F.count(F.lit(1)).alias("n"))
    chosen = [r for r in rules if r.name in policies[policy]]
    pairs = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in chosen]
    failing = patterns.withColumn("r", F.explode(F.array(*pairs))).filter(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
    alone = F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)
    return failing.groupBy(F.col("r.rule").alias("rule")).agg(F.sum("n").alias("failing"), F.sum(alone).alias("only_this"))


def keep_good(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The documents, with all their columns, that pass the policy."""
    inner = [f"_doc{i}" for i in range(len(docs.columns))]
    rows = ledger(docs.toDF(*inner), keep=inner, text=inner[docs.columns.index(text)])
    return apply_policy(rows, policy).filter("kept").select(*inner).toDF(*docs.columns)
