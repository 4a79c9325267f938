"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, BLANK_CHARS, let, words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from "
    "de la le et les des en un du que une pour est dans qui pas par sur au avec "
    "der die und den von zu das mit sich auf für nicht ist im dem ein eine als "
    "el y los se las del con por no su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails where `measure` lies outside [low, high]; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The default table. Ratios are per word or per line. Bounds were set from the labelled table:
#: labelled good texts of 50 words or more keep a wide margin to each.
RULES = (
    Rule("length", "n_words", low=50),
    Rule("repetition", "repeat_ratio", high=0.5),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("stop_words", "stop_ratio", low=0.06),
    Rule("line_copies", "dup_line_ratio", high=0.5),
    Rule("word_length", "mean_word", low=2.5, high=12.0),
)


def repeated_words(w: Column) -> Column:
    """Words that lie in 3-word windows found twice or more, the first ones included.

    Windows are sorted with their places, so repeats are neighbours; a window's words count up
    to the next repeated window's start, so overlaps count once. n log n in a text's words.
    """
    n = F.size(w)
    windows = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.struct(F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("g"), i.alias("i")),
    )

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-3).alias("last")),
            lambda a, i: F.struct((a["sum"] + F.least(F.lit(3), i - a["last"])).alias("sum"), i.alias("last")),
            lambda a: a["sum"],
        )

    def twice(s: Column) -> Column:
        """Places of windows equal to a neighbour in sorted order."""
        return F.sort_array(
            F.filter(
                F.transform(
                    F.sequence(F.lit(1), F.size(s)),
                    lambda k: F.when(
                        (F.get(s, k - 1)["g"] == F.get(s, k - 2)["g"]) | (F.get(s, k - 1)["g"] == F.get(s, k)["g"]),
                        F.get(s, k - 1)["i"],
                    ),
                ),
                lambda x: x.isNotNull(),
            )
        )

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), lambda s: covered(twice(s))))


def judgement(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One struct of a text's measures and verdicts. Everything used twice is bound once, so a
    filter on the verdict that moves below a projection takes one expression with it."""

    def counted(body: Column, w: Column, lines: Column) -> Column:
        long = lambda c: c.cast("long")
        return F.struct(
            long(F.size(w)).alias("n_words"),
            long(F.length(F.translate(body, BLANK_CHARS, ""))).alias("word_chars"),
            long(F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).alias("n_symbols"),
            long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            long(F.size(lines)).alias("n_lines"),
            long(F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS)))).alias("n_stop"),
        )

    def judged(m: Column) -> Column:
        n, lines = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["n_lines"], F.lit(1))
        measure = {
            "n_words": m["n_words"].cast("double"),
            "repeat_ratio": m["n_repeat_words"] / n,
            "symbol_ratio": m["n_symbols"] / n,
            "stop_ratio": m["n_stop"] / n,
            "dup_line_ratio": m["n_dup_lines"] / lines,
            "mean_word": m["word_chars"] / n,
        }
        broken = []
        for r in rules:
            low = measure[r.measure] < r.low if r.low is not None else F.lit(False)
            high = measure[r.measure] > r.high if r.high is not None else F.lit(False)
            broken.append(F.when(low | high, r.name))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop")
        return let(
            F.filter(F.array(F.lit(None).cast("string"), *broken), lambda x: x.isNotNull()),
            lambda failed: let(
                (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"]),
                lambda base: F.struct(*[m[k].alias(k) for k in names], base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed_rules")),
            ),
        )

    has_word = lambda x: x.rlike(f"[^{BLANK}]")
    return let(
        F.coalesce(text, F.lit("")),
        lambda body: let(words(body), lambda w: let(F.filter(F.split(body, "\n", -1), has_word), lambda lines: let(counted(body, w, lines), judged))),
    )


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Add the measures, `base_failed`, `failed_rules` and `kept` to every row.

    Null and empty texts have no words, so they fail the length rule and are not kept. Columns
    of the input stay, but for those named as the ones added, which are replaced. Repeated rows
    are judged alike; an empty table gives no rows.
    """
    held = docs.withColumn("__tw_judged", judgement(F.col(text), rules))
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "base_failed", "kept", "failed_rules")
    return held.select(*[c for c in docs.columns if c not in added], *[F.col("__tw_judged")[c].alias(c) for c in added])


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that pass all rules, with the columns they came with."""
    return docs.where(judgement(F.col(text), rules)["kept"])


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's digest over the whole table documents."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality(docs).select(*cols)


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: The same rows in DuckDB.
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM c WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '[ \t\n\x0B\f\r]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(h.n, 0)::BIGINT AS n_repeat_words,
        len(lines) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop
      FROM w LEFT JOIN h USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols / greatest(n_words, 1) > 0.1 OR n_stop / greatest(n_words, 1) < 0.06
       OR n_dup_lines / greatest(n_lines, 1) > 0.5 OR n_repeat_words / greatest(n_words, 1) > 0.5
       OR word_chars / greatest(n_words, 1) < 2.5 OR word_chars / greatest(n_words, 1) > 12) AS kept
FROM b
"""
