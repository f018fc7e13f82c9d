"""Quality rules: a table of thresholds compiled into one Spark projection. No user function runs.

The engine is two projections over the scan and has no shuffle: the first splits a text into words and lines, the second
measures them and compares each measure with its row of the threshold table.

Defined results: a null or empty text has no words, so all counts are 0 and it fails the base rule; texts of any length
are taken whole; repeated rows are judged one by one; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import WORD, let, table

#: Common function words of the covered languages (fixed values). Every text is judged by this rule, as in the SQL, so one in another language fails it.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be by this from or at a an",
    "de": "der die das und den von mit sich des auf nicht ein eine als auch es an im in zu",
    "fr": "le la les de des et du un une en que qui dans pour sur pas au par est avec",
    "es": "el la los las de del y en que un una se por con para no su al es lo",
}


@dataclass(frozen=True)
class Rule:
    """A text passes if ``least <= measure <= most``; a bound of None is open."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Measures are defined in :func:`measures`.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("dup_line_ratio", None, 0.5),
    Rule("ellipsis_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("stop_word_ratio", 0.005, None),
)


def _covered(starts: Column, width: int) -> Column:
    """Positions inside any of the windows of ``width`` words at the ascending ``starts``."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )


def _twice(hashes: Column) -> Column:
    """The distinct values that an array of BIGINT holds twice or more: neighbours once it is sorted."""
    again = lambda s: F.array_distinct(F.filter(s, lambda x, k: x == F.coalesce(F.get(s, k + 1), F.bitwise_not(x))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.array().cast("array<bigint>")).otherwise(let(F.sort_array(hashes), again))


def _repeat_words(hashes: Column, twice: Column, width: int, few: int = 64) -> Column:
    """Positions inside windows of ``width`` words that occur twice or more, the first occurrence included.

    Windows are compared by their 64-bit xxhash inside one text. A few repeated values are looked up one by one; with more,
    the windows are sorted by hash so that equal ones are neighbours. Both ways give the same count.
    """
    looked_up = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(twice, F.get(hashes, i)))
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = lambda a, k: F.get(a, k)["h"]
    same = lambda a: F.filter(a, lambda x, k: (x["h"] == F.coalesce(at(a, k - 1), F.bitwise_not(x["h"]))) | (x["h"] == F.coalesce(at(a, k + 1), F.bitwise_not(x["h"]))))
    by_sorting = F.sort_array(F.transform(let(ordered, same), lambda x: x["i"]))
    return F.when(F.size(twice) == 0, F.lit(0).cast("long")).when(F.size(twice) <= few, _covered(looked_up, width)).otherwise(_covered(by_sorting, width))


def measures(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), window: int = 3) -> DataFrame:
    """``keep`` columns plus one column per measure; see the module's threshold table."""
    stops = sorted({w for line in STOP_WORDS.values() for w in line.split() for w in (w, w.capitalize())})
    split = df.select(
        *keep,
        F.coalesce(F.col(text), F.lit("")).alias("_kl_text"),
    ).select(
        "*",
        F.regexp_extract_all("_kl_text", F.lit(WORD), 0).alias("_kl_words"),
        F.filter(F.split("_kl_text", "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD))).alias("_kl_lines"),
    )
    w, lines = F.col("_kl_words"), F.col("_kl_lines")
    n = F.size(w)
    h = F.col("_kl_hashes")
    windows = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>"))
    share = lambda part, whole: F.coalesce(part / F.when(whole > 0, whole), F.lit(0.0))
    count = lambda pattern: F.regexp_count("_kl_text", F.lit(pattern))
    return (
        split.select("*", F.transform(w, lambda x: F.xxhash64(x)).alias("_kl_hashes"))
        .select("*", windows.alias("_kl_windows"))
        .select("*", _twice(F.col("_kl_windows")).alias("_kl_twice"))
        .select(
            *keep,
            n.cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda total, x: total + F.length(x)).alias("word_chars"),
            count(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(F.col("_kl_windows"), F.col("_kl_twice"), window).alias("n_repeat_words"),
            F.size(lines).alias("n_lines"),
            F.size(F.filter(w, lambda x: x.isin(stops))).alias("n_stop_words"),
            F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).alias("n_ellipsis_lines"),
            F.size(F.filter(lines, lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("•"))).alias("n_bullet_lines"),
        )
        .select(
            "*",
            share(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
            share(F.col("n_symbols"), F.col("n_words")).alias("symbols_per_word"),
            share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
            share(F.col("n_stop_words"), F.col("n_words")).alias("stop_word_ratio"),
            share(F.col("n_ellipsis_lines"), F.col("n_lines")).alias("ellipsis_line_ratio"),
            share(F.col("n_bullet_lines"), F.col("n_lines")).alias("bullet_line_ratio"),
        )
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression."""
    out = F.lit(True)
    for r in rules:
        if r.least is not None:
            out = out & (F.col(r.measure) >= r.least)
        if r.most is not None:
            out = out & (F.col(r.measure) <= r.most)
    return out


def quality_rules(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeat_percent: int = 50) -> DataFrame:
    """Measures, ``base_failed`` (too short, or too many words in repeated windows), ``rules_failed`` (names) and ``kept``."""
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~compiled((r,)), F.lit(r.measure)) for r in rules]))
    return measures(df, text, keep).select("*", base.alias("base_failed"), failed.alias("rules_failed"), (~base & compiled(rules)).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for line in STOP_WORDS.values() for w in line.split() for w in (w, w.capitalize())}))
    tests = {
        "mean_word_chars": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words", "dup_line_ratio": "n_dup_lines / n_lines",
        "ellipsis_line_ratio": "n_ellipsis / n_lines", "bullet_line_ratio": "n_bullet / n_lines", "stop_word_ratio": "n_stop / n_words",
    }
    parts = []
    for r in RULES:
        parts += [f"coalesce({tests[r.measure]}, 0) >= {r.least}"] if r.least is not None else []
        parts += [f"coalesce({tests[r.measure]}, 0) <= {r.most}"] if r.most is not None else []
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM r GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words, len(l) AS n_lines,
             len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop,
             len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, chr(8230)))) AS n_ellipsis,
             len(list_filter(l, lambda x: starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, chr(8226)))) AS n_bullet
      FROM d LEFT JOIN n USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(parts)} AS kept FROM b"""


SQL = _sql()
