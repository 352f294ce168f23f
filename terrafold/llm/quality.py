"""Quality rules as a short-circuit cascade, all in column expressions over the whole text.

Each rule is a condition that fails a document. ``order_rules`` estimates every rule's cost and selectivity (share
rejected) on a bounded sample drawn from all partitions and sorts by rejection per cost; ``cascade`` is then one CASE whose
later rules are evaluated only where the earlier ones pass. A rule's cost is the text that it reads, in characters a
document: the sample's mean length for every pass that its condition makes over the text, and one for what it compares.
So the order is the same whenever the table is, whatever else the machine does. It changes the time and the reported
reason, never which documents pass.

Null is the text without words; texts of any length are measured whole; repeated rows are judged alike; an empty table
gives an empty result and leaves the rules in their given order; extra columns stay, and a result column replaces one
of its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

#: Rows of the sample on which cost and selectivity are estimated, about.
SAMPLE_ROWS = 2000
BLANK = r"[\\x20\\x09-\\x0D]"


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def words_sql(text: str) -> str:
    return let(
        f"regexp_replace({text}, '^{BLANK}++|{BLANK}++$', '')", "tr",
        f"if(tr = '', cast(array() as array<string>), split(tr, '{BLANK}++'))",
    )


def repeat_words_sql(words: str) -> str:
    """Words inside three-word windows that occur twice or more, the first included.

    Windows are compared by a 64-bit hash and sorted with their place; neighbours with an equal hash are repeats, and
    the sorted places give how many words they cover.
    """
    hashes = "transform(sequence(1, size(w) - 2), i -> xxhash64(w[i - 1], w[i], w[i + 1]))"
    twice = (
        "filter(t, (x, k) -> (k > 0 and t[greatest(k - 1, 0)].h = x.h) "
        "or (k < size(t) - 1 and t[least(k + 1, size(t) - 1)].h = x.h))"
    )
    covered = (
        f"aggregate(sort_array(transform({twice}, x -> x.i)), named_struct('last', -3, 'n', 0L), "
        "(a, p) -> named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n)"
    )
    placed = let("sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))", "t", covered)
    return let(words, "w", f"if(size(w) < 3, 0L, {let(hashes, 'h', f'if(size(array_distinct(h)) = size(h), 0L, {placed})')})")


def lines_sql(text: str) -> str:
    return f"filter(split({text}, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"


MEASURES = {
    "n_words": "cast(size({words}) as bigint)",
    "word_chars": f"cast(length(regexp_replace({{text}}, '{BLANK}++', '')) as bigint)",
    "n_symbols": "cast(length(regexp_replace({text}, '[^#*$%&|<>]++', '')) as bigint)",
    "n_lines": "cast(size({lines}) as bigint)",
    "n_dup_lines": "cast(" + let("{lines}", "ls", "size(ls) - size(array_distinct(ls))") + " as bigint)",
    "n_repeat_words": "{repeats}",
}


def measure(name: str, text: str, words: str | None = None) -> str:
    """SQL of a measure of the text column; ``words`` names a column with its words, if there is one."""
    words = words or words_sql(text)
    return MEASURES[name].format(text=text, words=words, lines=lines_sql(text), repeats=repeat_words_sql(words))


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition with {measure} fields for measures and {text} for the text."""

    name: str
    fails: str

    def sql(self, text: str, known: dict[str, str] | None = None) -> str:
        class Fields(dict):
            def __missing__(self, key: str) -> str:
                return measure(key, text)

        return "(" + self.fails.format_map(Fields(known or {}, text=text)) + ")"


UPPER = r"length(regexp_replace({text}, '[^A-ZÀ-ÖØ-Þ]++', ''))"
LETTERS = r"length(regexp_replace({text}, '[^\\p{{L}}]++', ''))"
#: The base rules: too few words, and too many of them in repeated windows.
BASE = (Rule("few_words", "{n_words} < 50"), Rule("repeats", "100 * {n_repeat_words} > 50 * {n_words}"))
#: The further rules of the cascade.
RULES = (
    Rule("symbols", "10 * {n_symbols} > 3 * {n_words}"),
    Rule("marks", "2 * length(regexp_replace({text}, '[^!]++', '')) > {n_words}"),
    Rule("shouting", f"2 * {UPPER} > {{word_chars}}"),
    Rule("few_letters", f"2 * {LETTERS} < {{word_chars}}"),
    Rule("dup_lines", "{n_lines} >= 4 and 2 * {n_dup_lines} > {n_lines}"),
)
#: For cleaning a corpus: no rule on length, as short documents may be clean, but for those without a word.
CLEANING = (
    Rule("no_words", "{n_words} = 0"), *RULES, Rule("repeats", "{n_words} >= 50 and 100 * {n_repeat_words} > 50 * {n_words}"),
)


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows at a rate from the row count, so each partition sends its share only."""
    n = docs.count()
    return docs.sample(fraction=min(1.0, rows / n), seed=7).limit(2 * rows) if n else docs.limit(0)


def by_rate(rules: list[tuple[Rule, float, float]]) -> list[tuple[Rule, float, float]]:
    """(rule, cost, share rejected) by falling share per cost; equal rates keep their order."""
    return sorted(rules, key=lambda x: -x[2] / x[1])


def order_rules(
    docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", rows: int = SAMPLE_ROWS, known: tuple[str, ...] = ()
) -> list[tuple[Rule, float, float]]:
    """(rule, characters that it reads a document, share rejected), the most rejection per cost first.

    Costs are those of the rules as they will run: measures named in ``known`` are columns already and cost no pass.
    """
    sample = sampled(docs.select(whole(F.col(f"`{text_col}`")).alias("text")), rows)
    sample = sample.select("text", *[F.expr(measure(m, "text")).alias(m) for m in known])
    hits = [F.count_if(F.expr(r.sql("text", {m: m for m in known}))) for r in rules]
    n, length, *failed = sample.agg(F.count(F.lit(1)), F.avg(F.length("text")), *hits).first()
    if not n:
        return [(r, 0.0, 0.0) for r in rules]
    passes = [r.sql("\0", {m: m for m in known}).count("\0") for r in rules]
    return by_rate([(r, 1 + p * length, f / n) for r, p, f in zip(rules, passes, failed, strict=True)])


def cascade(rules: list[Rule], text: str, known: dict[str, str] | None = None) -> Column:
    """Name of the first rule that the document fails, null if none; later rules run only where earlier ones pass."""
    return F.expr("case " + " ".join(f"when {r.sql(text, known)} then '{r.name}'" for r in rules) + " end")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, text_col: str = "text") -> DataFrame:
    """The input with ``reason``, the first rule of the ordered cascade that it fails, or null."""
    return docs.withColumn("reason", verdict(docs, rules, text_col))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, text_col: str = "text") -> DataFrame:
    """The documents that pass every rule, with their columns."""
    return docs.where(verdict(docs, rules, text_col).isNull())


def verdict(docs: DataFrame, rules: tuple[Rule, ...], text_col: str) -> Column:
    """The cascade over the rules as ordered on a sample of these documents."""
    order = [r for r, _, _ in order_rules(docs, rules, text_col)]
    return cascade(order, f"coalesce(cast(`{text_col}` as string), '')")


def digest(docs: DataFrame) -> DataFrame:
    """Base measures of each document, whether it fails the base rules, and the verdict of all rules."""
    base = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    order = [r for r, _, _ in order_rules(docs, RULES, known=("n_words", *base))]
    df = docs.select("doc_id", whole(F.col("text")).alias("text")).withColumn("words", F.expr(words_sql("text")))
    df = df.select("doc_id", "text", F.expr(measure("n_words", "text", "words")).alias("n_words"),
                   *[F.expr(measure(m, "text", "words")).alias(m) for m in base])
    known = {m: m for m in ("n_words", *base)}
    failed = " or ".join(r.sql("text", known) for r in BASE)
    return df.select(
        "doc_id", "n_words", *base, F.expr(failed).alias("base_failed"), cascade(order, "text", known).alias("reason")
    ).select(
        "doc_id", "n_words", *base, "base_failed",
        F.when(F.col("base_failed"), False).otherwise(F.col("reason").isNull()).alias("kept"),
    )
