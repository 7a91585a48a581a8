"""Quality rules under weak supervision: rules vote or abstain, expectation-maximisation weighs them, the posterior decides."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import materialise, release

#: Blanks between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STOPS = ".!?。！？…\"'”’)]»"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner != "", F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column) -> Column:
    """How many words of an array lie in a window of three that occurs twice or more in it.

    Windows are first told apart by hashes; those whose hash occurs twice are
    then sorted as they are and counted if a neighbour is equal, so the count is
    exact.
    """

    def twice(same: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
        """The entries of a sorted array that are the `same` as a neighbour."""
        return lambda s: F.filter(s, lambda x, i: same(F.get(s, i + 1), x) | same(F.get(s, i - 1), x))

    def exact(ws: Column, hashes: Column) -> Column:
        # One long holds the upper bits of a window's hash and its place; long arrays sort fast.
        def alike(bits: int) -> Column:
            packed = F.transform(hashes, lambda h, i: F.shiftleft(F.shiftright(h, bits), bits).bitwiseOR(i))
            near = let(F.sort_array(packed), twice(lambda x, y: F.shiftright(x.bitwiseXOR(y), bits) == 0))
            return F.transform(near, lambda x: x.bitwiseAND((1 << bits) - 1).cast("int"))

        near = F.when(F.size(hashes) < 1 << 20, alike(20)).otherwise(alike(31))
        # A word has no blank, so windows joined by blanks are equal only if their words are.
        windows = F.transform(near, lambda i: F.struct(F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("window"), i.alias("i")))
        places = F.sort_array(F.transform(let(F.sort_array(windows), twice(lambda x, y: x["window"] == y["window"])), lambda x: x["i"]))
        # Each window adds the words up to the next one's start, three at most.
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def counted(ws: Column) -> Column:
        hashes = F.transform(F.slice(ws, 1, F.size(ws) - 2), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(ws, h)).otherwise(0))
        return F.when(F.size(ws) < 4, 0).otherwise(some)

    return let(words, counted).cast("long")


def symbols(text: Column) -> Column:
    """How many characters of a text are symbols. Only a text that has one is copied without them."""
    rest = text
    for sign in SYMBOLS:
        rest = F.replace(rest, F.lit(sign))
    return F.when(text.rlike("[#*$%&|<>]"), F.char_length(text) - F.char_length(rest)).otherwise(0)


def measures(text: Column) -> Column:
    """A struct of whole-text measures; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column, words: Column, lines: Column) -> Column:
        stopped = F.filter(lines, lambda x: F.instr(F.lit(STOPS), F.substring(F.rtrim(x, F.lit(BLANKS)), -1, 1)) > 0)
        counts = {
            "n_words": F.size(words), "word_chars": F.char_length(F.array_join(words, "")), "n_symbols": symbols(t), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(words), "n_lines": F.size(lines), "n_distinct": F.size(F.array_distinct(words)), "n_stopped": F.size(stopped),
        }
        return F.struct(*[x.cast("long").alias(c) for c, x in counts.items()])

    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(BLANKS)) != "")
    return let(F.struct(text.alias("t"), words_of(text).alias("w"), lines.alias("l")), lambda x: of(x["t"], x["w"], x["l"]))


#: Rule, what makes it vote against a text, what makes it vote for it; else it abstains. Counts are whole numbers, so no division.
RULES = [
    ("length", "n_words < 50", "n_words between 100 and 100000"),
    ("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words", "false"),
    ("symbols", "20 * n_symbols > n_words", "false"),
    ("lines", "n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines", "false"),
    ("repetition", "10 * n_repeat_words > 3 * n_words", "false"),
    ("variety", "10 * n_distinct < n_words", "5 * n_distinct >= 2 * n_words"),
    ("endings", "n_lines > 2 and 5 * n_stopped < n_lines", "10 * n_stopped >= 7 * n_lines"),
]
CAST = (-1, 0, 1)
#: For each rule how often it votes against, abstains and votes for, first for good and then for bad texts.
Rates = list[tuple[tuple[float, ...], tuple[float, ...]]]


def votes(measured: DataFrame) -> DataFrame:
    """`measured` and a column for each rule: -1 against, 1 for, 0 abstains. A text without words gets no vote for it."""
    return measured.select("*", *[F.expr(f"case when {against} then -1 when n_words > 0 and ({for_}) then 1 else 0 end").alias(f"vote_{rule}") for rule, against, for_ in RULES])


def log_odds(columns: list[str], prior: float, rates: Rates) -> Column:
    """Log odds of a good text given its votes."""
    total = F.lit(math.log(prior / (1 - prior)))
    for c, (good, bad) in zip(columns, rates, strict=True):
        weights = [math.log(g / b) for g, b in zip(good, bad, strict=True)]
        total = total + F.when(F.col(c) == CAST[0], weights[0]).when(F.col(c) == CAST[1], weights[1]).otherwise(weights[2])
    return total


def fit(voted: DataFrame, rounds: int = 20, least: float = 1e-7, trust: float = 0.95) -> tuple[float, Rates]:
    """The share of good texts and each rule's rates, by expectation-maximisation over all rows.

    Rows are counted by their votes first: 3^rules patterns at most, whatever
    the table's size. A round is one aggregation of that table; the driver sees
    its sums alone. It starts from what all-must-pass filtering would say, held
    with 95 % trust, adds one observation of each kind, so no rate is 0 or 1,
    and ends after `rounds` rounds or when no value moves by more than `least`.
    What is assumed of a rule is that its votes against are right in a share of
    `trust` at least; without that, two kinds of bad texts that never meet would
    make the rarer one count as good.
    """
    columns = [f"vote_{rule}" for rule, *_ in RULES]
    patterns = materialise(voted.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")))
    p, now, rates = F.when(F.least(*columns) < 0, 0.05).otherwise(0.95), [], []
    for _ in range(rounds):
        weight = lambda share, when: F.sum(F.when(when, F.col("n") * share).otherwise(0.0))
        sums = [weight(share, F.lit(True)) for share in (F.col("p"), 1 - F.col("p"))]
        sums += [weight(share, F.col(c) == v) for c in columns for share in (F.col("p"), 1 - F.col("p")) for v in CAST]
        good, bad, *each = [x or 0.0 for x in patterns.withColumn("p", p).agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()]
        then, now = now, [(good + 1) / (good + bad + 2)]
        for k in range(0, len(each), 6):
            g, b = each[k : k + 3], each[k + 3 : k + 6]
            b[0], g[0] = max(b[0], trust * (g[0] + b[0])), min(g[0], (1 - trust) * (g[0] + b[0]))
            now += [(x + 1) / (sum(side) + 3) for side in (g, b) for x in side]
        rates = [(tuple(now[k : k + 3]), tuple(now[k + 3 : k + 6])) for k in range(1, len(now), 6)]
        p = 1 / (1 + F.exp(-log_odds(columns, now[0], rates)))
        if then and max(abs(a - b) for a, b in zip(then, now, strict=True)) < least:
            break
    release(patterns)
    return now[0], rates


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 20, threshold: float = 0.5) -> DataFrame:
    """Per row the base measures, base_failed, kept and good (the posterior probability of a good text).

    Rules (`RULES`) vote on whole texts; their rates come from all rows without
    a label, and a row is kept unless it fails the base or its posterior is
    below `threshold`. Null and empty texts have no words and fail the base;
    repeated rows are judged one by one and each count in the fit; ids may be
    null; an empty table gives none. Other columns are ignored.
    """
    read = docs.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m"))
    voted = votes(materialise(read.select("doc_id", "m.*")))
    prior, rates = fit(voted, rounds)
    good = 1 / (1 + F.exp(-log_odds([f"vote_{rule}" for rule, *_ in RULES], prior, rates)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("good", good).withColumn("base_failed", failed)
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*base, (~F.col("base_failed") & (F.col("good") >= threshold)).alias("kept"), "good")


def op13_weak_quality(spark, sf_dir: str) -> DataFrame:
    """All `documents` judged by the rules' posterior."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("good")


def _oracle(rounds: int = 20) -> str:
    nth = range(1, len(RULES) + 1)
    cases = ", ".join(f"CASE WHEN {against} THEN -1 WHEN n_words > 0 AND ({for_}) THEN 1 ELSE 0 END" for _, against, for_ in RULES)
    odds = "ln(pi / (1 - pi)) + " + " + ".join(f"ln(good[{j}][v[{j}] + 2] / bad[{j}][v[{j}] + 2])" for j in nth)
    count = lambda share, j, x: f"coalesce(sum(n * {share}) FILTER (v[{j}] = {x}), 0)"

    def rates(right: str, wrong: str, bound: str) -> str:
        each = []
        for j in nth:
            cast = [f"{bound}({count(right, j, -1)}, {0.95 if bound == 'greatest' else 0.05} * ({count(right, j, -1)} + {count(wrong, j, -1)}))", count(right, j, 0), count(right, j, 1)]
            each.append("[" + ", ".join(f"(1 + {x}) / (3 + {' + '.join(cast)})" for x in cast) + "]")
        return f"[{', '.join(each)}]"

    sums = f"(1 + sum(n * p)) / (2 + sum(n)) AS pi, {rates('p', '(1 - p)', 'least')} AS good, {rates('(1 - p)', 'p', 'greatest')} AS bad"
    return f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
m AS (SELECT b.r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines, len(list_distinct(w)) AS n_distinct,
             len(list_filter(l, lambda x: strpos('{STOPS.replace("'", "''")}', right(regexp_replace(x, '[\x20\x09-\x0D]+$', ''), 1)) > 0)) AS n_stopped
      FROM b LEFT JOIN rep USING (r)),
v AS (SELECT *, [{cases}] AS v FROM m),
pt AS (SELECT v, count(*) AS n FROM v GROUP BY v),
em AS (
  SELECT 1 AS round, {sums} FROM (SELECT v, n, CASE WHEN list_min(v) < 0 THEN 0.05 ELSE 0.95 END AS p FROM pt)
  UNION ALL
  SELECT round + 1 AS round, {sums} FROM (SELECT round, v, n, 1 / (1 + exp(-({odds}))) AS p FROM em, pt WHERE round < {rounds}) GROUP BY round),
f AS (SELECT * FROM em WHERE round = {rounds})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v), f"""


ORACLE = _oracle()
