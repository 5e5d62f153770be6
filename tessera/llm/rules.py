"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule; a policy is a versioned mask over those bits, so
a changed policy or an ablation reads the ledger, never the texts.

Defined cases: a null or empty text has no words, all measurements are 0 and
it fails ``few_words``; repeated rows are judged one by one; an empty table
gives an empty ledger; other columns of the input are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import WHITE

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]

#: Rule name -> condition (SQL over the measurements) under which it fails; the
#: position is the bit.  New rules are appended, bits are never reused.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "capitals": "3 * n_upper > word_chars",
}
BIT = {name: i for i, name in enumerate(RULES)}
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A versioned choice of the rules that reject a document."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BIT[r] for r in set(self.rules))


POLICIES = [
    Policy("base", 1, BASE),
    Policy("web", 1, (*BASE, "symbols", "repeated_lines")),
    Policy("web", 2, tuple(RULES)),
]


def _once(df: DataFrame, *cols: Column) -> DataFrame:
    """Adds columns behind a one-row generator: the optimiser does not copy
    their (costly) expressions into every later use."""
    names = df.columns
    made = F.struct(*[F.col(c) for c in names], *cols)
    return df.select(F.explode(F.array(made)).alias("_r")).select("_r.*")


def _repeat_words() -> Column:
    """Words covered by windows of ``WINDOW`` words that occur twice or more.
    ``wins`` is the array of window hashes in text order; sorted (hash, place)
    pairs put equal windows side by side."""
    pairs = F.array_sort(F.transform("wins", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    linked = F.expr(
        "zip_with(slice(_p, 1, size(_p) - 1), slice(_p, 2, size(_p) - 1),"
        " (x, y) -> if(x.h = y.h, array(x.i, y.i), cast(array() as array<int>)))")
    starts = F.array_sort(F.array_distinct(F.flatten(linked)))
    return pairs, starts


def measure(docs: DataFrame, text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the seven measurements (long)."""
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(1).alias("one"))
    d = docs.select(kept.alias("_keep"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = _once(d, F.array_remove(F.split("t", f"[{WHITE}]+"), "").alias("words"),
              F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{WHITE}]")).alias("lines"))
    d = d.select(
        "_keep", F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.length(F.regexp_replace("t", "[^A-Z]+", "")).alias("n_upper"),
        F.expr(f"if(size(words) > {WINDOW}, transform(sequence(0, size(words) - {WINDOW}),"
               f" i -> xxhash64(slice(words, i + 1, {WINDOW}))), cast(array() as array<bigint>))").alias("wins"))
    names = [c for c in d.columns if c != "wins"]
    # only texts with a repeated window pay for the sort
    d = _once(d, (F.size(F.array_distinct("wins")) < F.size("wins")).alias("_again"))
    pairs, starts = _repeat_words()
    d = _once(d.select(*names, F.when(F.col("_again"), F.col("wins")).alias("wins")), pairs.alias("_p"))
    d = _once(d.select(*names, "_p"), starts.alias("_s"))
    covered = F.expr(
        f"aggregate(zip_with(slice(_s, 1, size(_s) - 1), slice(_s, 2, size(_s) - 1),"
        f" (x, y) -> least(y - x, {WINDOW})), 0, (n, x) -> n + x) + {WINDOW}")
    d = d.withColumn("n_repeat_words", F.when(F.size("_s") > 0, covered).otherwise(F.lit(0)))
    return d.select(*[F.col(f"_keep.{c}").alias(c) for c in keep],
                    *[F.col(m).cast("long").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """``measure`` and ``fail_bits``: bit *i* is 1 if rule *i* fails."""
    m = measure(docs, text_col, keep)
    bits = [F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, cond in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return m.withColumn("fail_bits", total.cast("long"))


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def apply_policies(book: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """One boolean column ``kept_<name>_v<version>`` per policy."""
    return book.withColumns({f"kept_{p.name}_v{p.version}": passes(p) for p in policies})


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents failing it, failing only it (kept
    again if the rule were dropped), and documents failing every rule that
    each of its failures fails (``common_bits``, a bitwise and).  One pass
    over the ledger: documents are first counted by their bits, of which there
    are at most 2^rules."""
    by_bits = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit"))
                                for r in RULES if r in policy.rules])).alias("r")
    x = by_bits.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return x.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.bit_and(F.when(hit, F.col("bits"))).alias("common_bits"))
