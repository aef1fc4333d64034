"""Quality rules: one threshold table, compiled into one projection of built-in functions.

`measure` adds the counts, `verdict` compiles the table, `apply_rules` does both. Everything runs in the JVM: words,
lines and eight-word windows are arrays inside a row, so there is no shuffle and no user function.

Defined cases: a null text has no words and no lines (it fails the base rule); repeated rows each get their own verdict;
an empty table gives an empty result; other columns, whatever their names, are left out of the result of `measure`.
Windows are compared by 64-bit hashes within one text; a very long text is held whole by a task, as its words and hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, named, words_of

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to a in is it that for on with as was at by be this are from or an not "
    "der die das und ist von den mit ein eine zu im nicht sich auf für als auch "
    "le la les de des et est un une que qui en dans pour par sur du au pas "
    "el los las y se por con su para del al lo como es"
).split()


@dataclass(frozen=True)
class Rule:
    """A metric must lie within [least, most]; a bound of None is open."""

    metric: str
    least: float | None = None
    most: float | None = None


RULES: tuple[Rule, ...] = (
    Rule("mean_word_chars", 2.5, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_word_ratio", None, 0.3),
    Rule("capital_ratio", None, 0.3),
)


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


METRICS: dict[str, Column | None] = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_word_ratio": ("n_repeat_words", "n_words"),
    "capital_ratio": ("n_capitals", "word_chars"),
}


def _held(text: Column, of: str) -> Column:
    """How many characters of a class a text holds."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, of, ""))).cast("long")


def _with_later(hashes: str, step: int) -> Column:
    """Each hash together with the one `step` places later."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(F.col(hashes), i + step)))


def measure(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The counts that rules use, beside the columns named in `keep`."""
    keep = ["doc_id"] if keep is None else keep
    kept = [named(c).alias(f"_in_{i}") for i, c in enumerate(keep)]
    body = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    rows = docs.select(*kept, named(text).cast("string").alias("_text"))
    rows = rows.select("*", words_of(F.col("_text")).alias("_words"), lines.alias("_lines"))
    # A window's hash by doubling: of one word, then of two, four and eight.
    rows = rows.select("*", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hash_1"))
    for step in (1, 2, 4):
        pair = _with_later(f"_hash_{step}", step)
        rows = rows.select(*(c for c in rows.columns if c != f"_hash_{step}"), pair.alias(f"_hash_{2 * step}"))
    last = F.size("_words") - WINDOW + 1
    rows = rows.select("*", F.when(last > 1, F.slice(f"_hash_{WINDOW}", 1, last)).alias("_hashes"))
    # Only texts with some window twice are sorted.
    twice = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    pairs = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select("*", F.when(twice, pairs).alias("_pairs"))
    same = lambda x, i, by: F.coalesce(F.get(F.col("_pairs"), i + by)["h"] == x["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter("_pairs", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    stops = F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))
    return rows.select(
        *(F.col(f"_in_{i}").alias(c) for i, c in enumerate(keep)),
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        _held(body, SYMBOLS).alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(stops).cast("long").alias("n_stop_words"),
        _held(body, "[A-Z]").alias("n_capitals"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(kept, names of the broken rules), compiled from the table."""
    broken = []
    for r in rules:
        value = _ratio(*METRICS[r.metric])
        if r.least is not None:
            broken.append(F.when(value < r.least, F.lit(f"{r.metric}<{r.least:g}")))
        if r.most is not None:
            broken.append(F.when(value > r.most, F.lit(f"{r.metric}>{r.most:g}")))
    names = F.array_compact(F.array(*broken))
    return ~base_failed() & (F.size(names) == 0), F.array_join(names, ",")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Counts, base_failed, kept and the broken rules of each row of `docs`."""
    kept, broken = verdict(rules)
    return measure(docs, keep, text).select("*", base_failed().alias("base_failed"), kept.alias("kept"), broken.alias("broken_rules"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that all rules keep, with their own columns."""
    own = [f"_own_{i}" for i in range(len(docs.columns))]
    rows = apply_rules(docs.toDF(*own), keep=own, text=own[docs.columns.index("text")])
    # The counts are worth having, and the filter isn't pushed below them, where it would compute every metric anew.
    counted = rows.observe("quality_rules", F.count(F.lit(1)).alias("n_read"), F.count_if("kept").alias("n_kept"))
    return counted.where("kept").select(*(F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines", "n_capitals"
    )


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP3_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce("text", '') AS t FROM documents
), w AS (
  SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) > 8)
), p AS (
  SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1
), r AS (
  SELECT rid, sum(least(8, i - coalesce(before, i - 8))) AS n FROM p GROUP BY rid
), m AS (
  SELECT d.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop_words,
         CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM d JOIN w USING (rid) LEFT JOIN r USING (rid)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12.0 AND n_symbols / n_words <= 0.1
       AND n_stop_words / n_words >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.5
       AND n_repeat_words / n_words <= 0.3 AND n_capitals / greatest(word_chars, 1) <= 0.3 AS kept,
       n_stop_words, n_lines, n_capitals
FROM b
"""
