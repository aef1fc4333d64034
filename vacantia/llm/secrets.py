"""Secret scans with built-in functions only: pattern rules, and sliding-window Shannon entropy of candidate strings.

Candidates are maximal runs of `[A-Za-z0-9+/_=-]` outside of what the base patterns cover. Each is scored per character
class (hex digits, letters and digits, base64) by the highest entropy of any window. The window's counts are held while
it moves: a step takes one character out and puts one in, and changes sum(c * log2 c) by those two counts alone. Letters
and digits between other characters are scored as runs of their own too, so that a key is found behind its prefix. A
run whose best window passes its class's threshold becomes an `entropy` span, unless the allow-list knows its form (UUIDs,
dashed words, numbers); of a run that names itself an example, only those parts between slashes are scored that don't.

Positions are code points. They come from the text cut at a pattern's matches: pieces and matches alternate, so running
sums of their lengths give the places.

Work is in proportion to a text's length, however long a run or a text is and however many spans it has: patterns are
possessive, so that none goes back or recurses, runs are scored in blocks, and running sums are made in blocks too.

Defined cases: null texts count as empty and have no spans (and stay null in `redact`); one text is held whole by a task,
whatever its length; equal rows each give their own result; an empty table gives an empty result; other columns, whatever
their names, are left out by `scan` and kept as they are by `redact`.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named

KINDS = ("assign", "access", "hex", "entropy")

# The three base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Class, what a run must be made of, what it must hold, entropy in bits that some window must reach.
CLASSES: tuple[tuple[str, str, tuple[str, ...], float], ...] = (
    ("hex", r"^[0-9A-Fa-f]++$", ("[0-9]", "[A-Fa-f]"), 3.0),
    ("alnum", r"^[0-9A-Za-z]++$", (r"^(?:[^0-9]*+[0-9]){3}",), 3.6),
    ("base64", r"^[0-9A-Za-z+/_=-]++$", (r"^(?:[^0-9]*+[0-9]){2}", "[A-Z]", "[a-z]"), 3.8),
)
#: Forms of whole runs that are no secrets.
ALLOWED: tuple[str, ...] = (
    r"^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
    r"^[-_=+/]*+[A-Za-z]++(?:[-_/+][A-Za-z]++)*+[-_=+/]*+$",
    r"^[-_/+=0-9]++$",
)
EXAMPLE = r"(?i)example|sample|dummy|placeholder|test_?key"
#: Characters of a run that are scored by one fold; code points that are cut by one substring; values summed by one fold.
RUN_BLOCK, TEXT_BLOCK, SUM_BLOCK = 128, 1024, 256

SPANS = "array<struct<start:int,kind:int,end:int>>"


def _before(values: str, join: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array column of whole numbers: the earlier values joined (0 for none), in blocks."""

    def folded(of: Column) -> Column:
        step = lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(of, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step)

    held = F.col(values)
    blocks = F.transform(F.sequence(F.lit(0), F.size(held) - 1, F.lit(SUM_BLOCK)), lambda at: F.slice(held, at + 1, SUM_BLOCK))
    within = F.transform(blocks, folded)
    tops = folded(F.transform(within, lambda w: w["at"]))["out"]
    whole = F.zip_with(F.transform(within, lambda w: w["out"]), tops, lambda w, top: F.transform(w, lambda x: join(x, top)))
    return F.when(F.size(held) > 0, F.flatten(whole)).otherwise(F.array().cast("array<int>"))


def _filled(pieces: Column, found: Column, hidden: Callable[[Column], Column]) -> Column:
    """The text again, with spaces in place of those matches that are `hidden`."""
    blank = lambda m: F.when(hidden(m), F.repeat(F.lit(" "), F.char_length(m["found"]))).otherwise(m["found"])
    return F.array_join(F.zip_with(pieces, found, lambda p, m: F.concat(p, F.coalesce(blank(m), F.lit("")))), "")


def _cut(text: Column, pattern: str, group: int) -> Column:
    """Pieces between matches, and structs (found, held) of the matches and what `group` holds; null without a match.

    Most texts have no match at all: they are only searched, not cut.
    """
    rx = F.lit(pattern)
    found = F.arrays_zip(F.regexp_extract_all(text, rx, F.lit(0)).alias("found"), F.regexp_extract_all(text, rx, F.lit(group)).alias("held"))
    return F.when(text.rlike(pattern), F.struct(F.split(text, pattern).alias("pieces"), found.alias("found")))


def _block_sum(block: Column, window: int) -> Column:
    """Least sum of c * log2 c over the windows of a block, by counts that are held while the window moves."""
    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    code = lambda i: F.position(F.substring(block, i, F.lit(1)), F.lit(ALPHABET))
    # Counts are a string with a sign for each character of the alphabet, "A" for none.
    count = lambda counts, c: F.ascii(F.substring(counts, c, F.lit(1))) - 65
    move = lambda c, by, full: F.struct(c.alias("code"), F.lit(by).alias("by"), full.alias("full"))
    out = lambda i: F.when(i > window, code(i - window)).otherwise(F.lit(0))
    moves = F.flatten(F.transform(F.sequence(F.lit(1), F.char_length(block)), lambda i: F.array(move(out(i), -1, F.lit(False)), move(code(i), 1, i >= window))))

    def step(a: Column, m: Column) -> Column:
        n = count(a["counts"], m["code"])
        total = a["sum"] - F.get(weights, n) + F.get(weights, n + m["by"])
        return F.struct(
            F.overlay(a["counts"], F.char(n + m["by"] + 65), m["code"], F.lit(1)).alias("counts"),
            total.alias("sum"),
            F.when(m["full"] & (total < a["low"]), total).otherwise(a["low"]).alias("low"),
        )

    start = F.struct(F.lit("A" * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("low"))
    return F.aggregate(F.filter(moves, lambda m: m["code"] > 0), start, step, lambda a: a["low"])


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits, over the windows of a run; minus infinity for a run shorter than a window."""
    blocks = F.regexp_extract_all(run, F.lit(f".{{1,{RUN_BLOCK}}}"), F.lit(0))
    # Windows that begin in a block end in the next one, at most (a block is longer than a window).
    whole = F.zip_with(blocks, F.slice(blocks, 2, 1 << 30), lambda b, after: F.concat(b, F.coalesce(F.substring(after, 1, window - 1), F.lit(""))))
    return F.lit(math.log2(window)) - F.array_min(F.transform(whole, lambda b: _block_sum(b, window))) / window


def _passes(run: Column, classes: tuple[tuple[str, str, tuple[str, ...], float], ...]) -> Column:
    bars = []
    for _, made, holds, bar in classes:
        fits = run.rlike(made)
        for pattern in holds:
            fits = fits & run.rlike(pattern)
        bars.append(F.when(fits, F.lit(bar)))
    plain = F.lit(False)
    for pattern in ALLOWED:
        plain = plain | run.rlike(pattern)
    bar = F.least(*bars) if len(bars) > 1 else bars[0]
    return F.coalesce(F.when(~plain & bar.isNotNull(), window_entropy(run) >= bar), F.lit(False))


def suspicious(run: Column) -> Column:
    """Whether a candidate, or letters and digits in it, pass some class's threshold and the allow-list doesn't know them."""
    long = lambda p: F.char_length(p) >= WINDOW
    others = F.filter(F.split(run, "/"), lambda p: long(p) & ~p.rlike(EXAMPLE))
    units = F.when(run.rlike(EXAMPLE), others).otherwise(F.array(run))
    parts = lambda u: F.when(u.rlike("[^0-9A-Za-z]"), F.regexp_extract_all(u, F.lit(f"[0-9A-Za-z]{{{WINDOW},}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    narrow = tuple(c for c in CLASSES if c[0] != "base64")
    return F.exists(units, lambda u: _passes(u, CLASSES) | F.exists(parts(u), lambda p: _passes(p, narrow)))


def _scanned(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The kept columns as _in_0, _in_1 and so on, so that none can clash, beside _text, _body, _base and _found."""
    rows = docs.select(*(named(c).alias(f"_in_{i}") for i, c in enumerate(keep)), named(text).cast("string").alias("_text"))
    rows = rows.withColumn("_body", F.coalesce("_text", F.lit("")))
    # Failing matches of the last two patterns lie in runs too short as a whole, so their length goes into the pattern.
    access, hexes = ACCESS[:-1] + f"{{{LEAST['access'] - 4},}}", HEX[:-1] + f"{{{LEAST['hex']},}}"
    held = lambda m: F.char_length(m["held"]) >= LEAST["assign"]
    every = lambda m: F.lit(True)
    for k, (pattern, group) in enumerate(((ASSIGN, 1), (access, 0), (hexes, 0))):
        rows = rows.withColumn(f"_cut_{k}", _cut(F.col("_body"), pattern, group))
    # What the base patterns cover is blanked before candidates are sought.
    of = F.col("_cut_0")
    rows = rows.withColumn("_bare", F.when(of.isNotNull(), _filled(of["pieces"], of["found"], held)).otherwise(F.col("_body")))
    for k, pattern in ((1, access), (2, hexes)):
        again = rows.withColumn("_again", F.when(F.col(f"_cut_{k}").isNotNull(), _cut(F.col("_bare"), pattern, 0)))
        rows = again.withColumn("_bare", F.when(F.col("_again").isNotNull(), _filled(F.col("_again.pieces"), F.col("_again.found"), every)).otherwise(F.col("_bare")))
    rows = rows.withColumn("_cut_3", _cut(F.col("_bare"), CANDIDATE, 0)).drop("_again", "_bare")
    for k in range(4):
        found = F.col(f"_cut_{k}.found")
        # The last piece is followed by no match.
        steps = F.zip_with(F.slice(F.col(f"_cut_{k}.pieces"), 1, F.size(found)), found, lambda p, m: F.char_length(p) + F.char_length(m["found"]))
        rows = rows.withColumn(f"_steps_{k}", F.when(F.col(f"_cut_{k}").isNotNull(), steps))
        ends = F.zip_with(_before(f"_steps_{k}", lambda a, b: a + b), F.col(f"_steps_{k}"), lambda at, step: at + step)
        good = held if k == 0 else (lambda m: suspicious(m["found"])) if k == 3 else every
        spans = F.zip_with(ends, found, lambda end, m: F.when(good(m), F.struct((end - F.char_length(m["found"])).alias("start"), F.lit(k).alias("kind"), end.alias("end"))))
        rows = rows.withColumn(f"_spans_{k}", F.when(F.col(f"_cut_{k}").isNotNull(), F.array_compact(spans)).otherwise(F.array()).cast(SPANS)).drop(f"_steps_{k}", f"_cut_{k}")
    rows = rows.withColumn("_base", F.sort_array(F.concat("_spans_0", "_spans_1", "_spans_2")))
    return rows.withColumn("_found", F.when(F.size("_spans_3") > 0, F.sort_array(F.concat("_base", "_spans_3"))).otherwise(F.col("_base")))


def scan(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns in `keep`, and `base` and `found`: arrays of (start, kind, end), code points, by start and kind."""
    keep = ["doc_id"] if keep is None else keep
    rows = _scanned(docs, keep, text)
    return rows.select(*(F.col(f"_in_{i}").alias(c) for i, c in enumerate(keep)), F.col("_base").alias("base"), F.col("_found").alias("found"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _between(start: Column, end: Column) -> Column:
    """Code points from `start` to `end` of the text whose blocks are in _blocks."""
    blocks, first, last = F.col("_blocks"), (start / TEXT_BLOCK).cast("int"), (end / TEXT_BLOCK).cast("int")
    head = F.substring(F.get(blocks, first), start % TEXT_BLOCK + 1, F.least(end - start, F.lit(TEXT_BLOCK)))
    tail = F.coalesce(F.substring(F.get(blocks, last), F.lit(1), end % TEXT_BLOCK), F.lit(""))
    across = F.concat(head, F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), tail)
    return F.when(end <= start, F.lit("")).when(first == last, head).otherwise(across)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of its texts replaced by `mark`; overlapping spans are replaced once. Null texts stay null."""
    rows = _scanned(docs, docs.columns, text)
    hit = F.size("_found") > 0
    rows = rows.withColumn("_blocks", F.when(hit, F.regexp_extract_all("_body", F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))))
    rows = rows.withColumn("_ends", F.when(hit, F.transform("_found", lambda x: x["end"])))
    rows = rows.withColumn("_upto", F.when(hit, _before("_ends", lambda a, b: F.greatest(a, b))))
    # What precedes a span reaches back to where the earlier ones end.
    parts = F.zip_with("_found", "_upto", lambda x, at: F.when(x["start"] >= at, F.concat(_between(at, x["start"]), F.lit(mark))).otherwise(F.lit("")))
    rest = _between(F.array_max("_ends"), F.char_length("_body"))
    clean = F.when(hit, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("_text"))
    return rows.select(*((clean if c == text else F.col(f"_in_{i}")).alias(c) for i, c in enumerate(docs.columns)))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, with their secrets replaced; n_chars follows the new text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans")
    )


_SQL_CUT = """{new} AS (
  SELECT *, regexp_split_to_array({of}, {rx}) AS p, regexp_extract_all({of}, {rx}, 0) AS f, regexp_extract_all({of}, {rx}, {group}) AS h FROM {old}
)"""


def _sql_spans(kind: str, order: int, least: int) -> str:
    """SQL for the spans of the cut p, f, h."""
    return f"""list_filter(list_transform(range(1, len(f) + 1), lambda i: {{
      's': coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0),
      'k': {order}, 'n': length(f[i]), 'kind': '{kind}', 'good': length(h[i]) >= {least}, 'run': f[i]}}), lambda x: x.good)"""


_SQL_BLANK = """array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(
      CASE WHEN length(h[i]) >= {least} THEN repeat(' ', length(f[i])) ELSE f[i] END, '')), '')"""
_SQL_ASSIGN = r"""'(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
_SQL_SPELLED = "array_to_string(list_transform({}, lambda x: x.kind || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT)), ',')"
#: Written from the rules, not from the code above: windows are counted anew by list_entropy.
OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce("text", '') AS t FROM documents),
{_SQL_CUT.format(new="c0", old="d", of="t", rx=_SQL_ASSIGN, group=1)},
s0 AS (SELECT doc_id, t, {_sql_spans("assign", 0, 6)} AS a, {_SQL_BLANK.format(least=6)} AS b FROM c0),
{_SQL_CUT.format(new="c1", old="s0", of="t", rx="'AKIA[A-Z0-9]{16,}'", group=0)},
s1 AS (SELECT doc_id, t, a, b, {_sql_spans("access", 1, 20)} AS k FROM c1),
{_SQL_CUT.format(new="c2", old="s1", of="t", rx="'[0-9a-f]{24,}'", group=0)},
s2 AS (SELECT doc_id, a, k, {_sql_spans("hex", 2, 24)} AS g, b FROM c2),
{_SQL_CUT.format(new="c3", old="s2", of="b", rx="'AKIA[A-Z0-9]{16,}'", group=0)},
s3 AS (SELECT doc_id, a, k, g, {_SQL_BLANK.format(least=20)} AS b FROM c3),
{_SQL_CUT.format(new="c4", old="s3", of="b", rx="'[0-9a-f]{24,}'", group=0)},
s4 AS (SELECT doc_id, a, k, g, {_SQL_BLANK.format(least=24)} AS b FROM c4),
{_SQL_CUT.format(new="c5", old="s4", of="b", rx="'[A-Za-z0-9+/_=-]{20,}'", group=0)},
s5 AS (SELECT doc_id, a, k, g, {_sql_spans("entropy", 3, 20)} AS e FROM c5),
runs AS (SELECT DISTINCT unnest(e).run AS run FROM s5),
units AS (
  SELECT run, unnest(CASE WHEN regexp_matches(run, '(?i)example|sample|dummy|placeholder|test_?key')
    THEN list_filter(string_split(run, '/'), lambda v: length(v) >= 20 AND NOT regexp_matches(v, '(?i)example|sample|dummy|placeholder|test_?key'))
    ELSE [run] END) AS u FROM runs),
parts AS (
  SELECT run, u, true AS whole FROM units UNION ALL
  SELECT run, unnest(list_filter(regexp_extract_all(u, '[0-9A-Za-z]+'), lambda v: length(v) >= 20)), false FROM units WHERE regexp_matches(u, '[^0-9A-Za-z]')),
scored AS (
  SELECT run, list_max(list_transform(range(1, length(u) - 18), lambda i: list_aggregate(string_split(u[i:i + 19], ''), 'entropy'))) AS bits,
    least(CASE WHEN regexp_full_match(u, '[0-9A-Fa-f]+') AND regexp_matches(u, '[0-9]') AND regexp_matches(u, '[A-Fa-f]') THEN 3.0 END,
          CASE WHEN regexp_full_match(u, '[0-9A-Za-z]+') AND length(regexp_replace(u, '[^0-9]', '', 'g')) >= 3 THEN 3.6 END,
          CASE WHEN whole AND length(regexp_replace(u, '[^0-9]', '', 'g')) >= 2 AND regexp_matches(u, '[A-Z]') AND regexp_matches(u, '[a-z]') THEN 3.8 END) AS bar
  FROM parts WHERE NOT (regexp_full_match(u, '[0-9A-Fa-f]{{8}}-([0-9A-Fa-f]{{4}}-){{3}}[0-9A-Fa-f]{{12}}') OR regexp_full_match(u, '[-_/+=0-9]+')
    OR regexp_full_match(u, '[-_=+/]*[A-Za-z]+([-_/+][A-Za-z]+)*[-_=+/]*'))),
bad AS (SELECT list(DISTINCT run) AS runs FROM scored WHERE bits >= bar - 1e-12)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_assign, CAST(len(k) AS BIGINT) AS n_access, CAST(len(g) AS BIGINT) AS n_hex,
       sha256({_SQL_SPELLED.format("list_sort(list_concat(a, k, g))")}) AS base_sha256,
       {_SQL_SPELLED.format("list_sort(list_concat(list_concat(a, k, g), list_filter(e, lambda v: coalesce(list_contains(bad.runs, v.run), false))))")} AS spans
FROM s5, bad
"""
