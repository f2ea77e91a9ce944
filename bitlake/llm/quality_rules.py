"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Each rule rejects a document whose measure lies above a cutoff; all rules together have one vector of
cutoffs per stratum (language). Labelled documents that pass the base rules are split by a hash of their id.
The smaller part, of good and bad ones, lays out a path of vectors: at each step every rule takes its tightest
cutoff that loses no more than the step's share of the part's good documents and catches more than it loses.
The larger part certifies: along the path, loosest first, the hypothesis "the vector falsely rejects more than
alpha of the stratum's good documents" is tested by the exact binomial tail P(Bin(n, alpha) <= rejected) at
delta / strata, and the first step that does not pass ends the path. Testing in an order fixed beforehand needs
no correction over steps, and testing whole vectors none over rules; strata are corrected for (Bonferroni).
So with probability 1 - delta no stratum loses more than alpha of its good documents. Base rejections do not
count in this promise. Among the certified vectors the one that best tells bad from good is taken, the
loosest of equals. With four strata, and no loss, 86 good labels certify; a stratum with fewer applies no rule.

Defined cases: a null or empty text has no words, so that the base rules reject it; measures of a text
without words are 0; a null language is a stratum of its own; labels that are null, neither 0 nor 1, or
without a document count for nothing; a doc_id with several labels or several rows counts once for each
pair; a document whose stratum has no labels passes every rule; an empty table gives an empty result;
columns of the input may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitlake.llm.common import SPACE, let, materialize, scratch

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
ALPHA = 0.05
DELTA = 0.05
#: How much a lost good document outweighs a caught bad one, both as shares.
GOOD_WEIGHT = 5.0
#: Rule -> cutoffs, loosest first. A document fails where its measure is above the cutoff.
RULES: dict[str, tuple[float, ...]] = {
    "symbols": (1.0, 0.5, 0.3, 0.2, 0.1, 0.05),  # symbols per word character
    "shouting": (0.9, 0.8, 0.6, 0.4, 0.3, 0.2),  # upper-case letters per word character
    "dup_lines": (0.9, 0.7, 0.5, 0.3, 0.2, 0.1),  # repeated lines per line
    "repeats": (0.9, 0.6, 0.3, 0.2, 0.1, 0.05),  # words in repeated windows per word
    "sameness": (0.98, 0.95, 0.9, 0.8, 0.7, 0.6),  # 1 - distinct words per word
    "bars": (0.5, 0.4, 0.3, 0.2, 0.1, 0.05),  # words without letter or digit per word
}
#: The path: at each step a rule may lose this share of the good documents of the part that lays out the path.
STEPS = (0.0, 0.0025, 0.005, 0.01, 0.02, 0.03)
#: The part that lays out the path: ids whose MD5 begins with a hexadecimal digit below this one.
LAYS = "5"
#: A table of strata is sent to all rows up to so many strata; more are joined.
MAX_SENT = 10_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside windows of that many words that occur twice or more in the text."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - (window - 1))
    hashes = F.when(n >= window, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))).otherwise(F.array().cast("array<bigint>"))

    def count(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            m = F.size(s)
            twin = lambda e, j: ((j > 0) & (F.get(s, j - 1)["h"] == e["h"])) | ((j < m - 1) & (F.get(s, j + 1)["h"] == e["h"]))
            at = F.array_sort(F.transform(F.filter(s, twin), lambda e: e["i"]))
            # Each repeated window adds the words up to the next one, all of its own at most.
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))), F.lit(0), lambda a, b: a + b))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, covered))

    return let(hashes, count).cast("long")


def measures(docs: DataFrame, out: str = "__q") -> DataFrame:
    """docs with a further column: a struct of the base counts, the rules' measures and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    long = lambda c: c.cast("long")

    def of_words(words: Column) -> Column:
        n = F.size(words)
        return F.struct(
            long(n).alias("n_words"),
            _repeat_words(words, WINDOW).alias("n_repeat_words"),
            long(F.size(F.array_distinct(words))).alias("n_distinct"),
            long(F.size(F.filter(words, lambda x: ~x.rlike(r"[\p{L}\p{N}]")))).alias("bars"),
        )

    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = F.struct(
        let(words, of_words).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
        long(F.length(F.regexp_replace(text, SPACE, ""))).alias("chars"),
        long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("symbols"),
        long(F.regexp_count(text, F.lit(r"\p{Lu}"))).alias("upper"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def whole(p: Column) -> Column:
        w = p["w"]
        failed = (w["n_words"] < MIN_WORDS) | (100 * w["n_repeat_words"] > MAX_REPEAT_PERCENT * w["n_words"])
        return F.struct(
            w["n_words"].alias("n_words"),
            p["chars"].alias("word_chars"),
            p["symbols"].alias("n_symbols"),
            p["l"]["dup"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            share(p["symbols"], p["chars"]).alias("symbols"),
            share(p["upper"], p["chars"]).alias("shouting"),
            share(p["l"]["dup"], p["l"]["n"]).alias("dup_lines"),
            share(w["n_repeat_words"], w["n_words"]).alias("repeats"),
            share(w["n_words"] - w["n_distinct"], w["n_words"]).alias("sameness"),
            share(w["bars"], w["n_words"]).alias("bars"),
        )

    return docs.withColumn(out, let(parts, whole))


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), summed term by term from k = 0; 1 where k lies above the mean, as no test passes there."""
    import math

    odds, none = math.log(rate / (1 - rate)), math.log(1 - rate)
    zero = F.struct((n * none).alias("log"), F.exp(n * none).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        log = s["log"] + F.log((n - i + 1) / i) + odds
        return F.struct(log.alias("log"), (s["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * rate, F.lit(1.0)).otherwise(F.aggregate(steps, zero, add)["sum"])


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES, steps: tuple[float, ...] = STEPS) -> DataFrame:
    """stratum and one cutoff per rule (null: the rule rejects nothing), from measured (doc_id, stratum, __q) and labels (doc_id, quality)."""
    lays = F.substring(F.md5(F.concat(F.lit("rules:"), F.col("doc_id").cast("string"))), 1, 1) < LAYS
    held = measured.where(~F.col("__q.base_failed")).join(labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id").withColumn("lays", lays)
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    totals = [F.count_if(good).alias("good"), F.count_if(bad).alias("bad")]
    sums = [F.count_if((F.col(f"__q.{rule}") > cut) & side).alias(f"{rule}_{i}_{name}") for rule, cuts in rules.items() for i, cut in enumerate(cuts) for side, name in ((good, "lost"), (bad, "caught"))]
    counts = held.where("lays").groupBy("stratum").agg(*totals, *sums)

    def gain(lost: Column, caught: Column) -> Column:
        return F.when((F.col("good") > 0) & (F.col("bad") > 0), caught / F.col("bad") - GOOD_WEIGHT * lost / F.col("good")).otherwise(0.0)

    def tightest(rule: str, step: float) -> Column:
        """The rule's least cutoff within the step, null where none is."""
        options = []
        for i, cut in enumerate(rules[rule]):
            lost, caught = F.col(f"{rule}_{i}_lost"), F.col(f"{rule}_{i}_caught")
            options.append(F.when((gain(lost, caught) > 0) & (lost / F.col("good") <= step), F.lit(cut)))
        return F.array_min(F.array_compact(F.array(*options)))

    path = counts.select("stratum", F.array(*[F.struct(*[tightest(r, step).alias(r) for r in rules]) for step in steps]).alias("path"))
    path = materialize(path, "path")  # a row per stratum
    few = path.count() <= MAX_SENT
    tested = held.where(~F.col("lays")).join(F.broadcast(path) if few else path, "stratum")
    out = lambda j: reduce(lambda a, b: a | b, [F.coalesce(F.col(f"__q.{r}") > F.col("path")[j][r], F.lit(False)) for r in rules])
    sums = [F.count_if(out(j) & side).alias(f"{name}_{j}") for j in range(len(steps)) for side, name in ((good, "lost"), (bad, "caught"))]
    counts = tested.groupBy("stratum").agg(*totals, *sums).withColumn("strata", F.count("*").over(Window.partitionBy())).join(path, "stratum")
    sure, options = F.col("good") > 0, []
    for j in range(len(steps)):
        lost = F.col(f"lost_{j}")
        sure = sure & (binomial_tail(F.col("good"), lost, alpha) <= delta / F.col("strata"))
        better = gain(lost, F.col(f"caught_{j}"))
        options.append(F.when(sure & (better > 0), F.struct(better.alias("gain"), F.lit(-j).alias("loose"), F.col("path")[j].alias("cuts"))))
    best = F.array_max(F.transform(F.array_compact(F.array(*options)), lambda x: F.struct(x["gain"].alias("gain"), x["loose"].alias("loose"))))
    counts = counts.withColumn("at", -best["loose"])
    return counts.select("stratum", *[F.when(F.col("at").isNotNull(), F.get("path", F.col("at"))[r]).alias(r) for r in rules])


def _stratum() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))


def _verdict(rules: dict, q: str, c: str) -> Column:
    kept = ~F.col(f"`{q}`.base_failed")
    for rule in rules:
        kept = kept & F.coalesce(F.col(f"`{q}`.{rule}") <= F.col(f"`{c}`.{rule}"), F.lit(True))
    return kept


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> DataFrame:
    """doc_id, the base columns, base_failed and kept of every row of docs (doc_id, text, lang)."""
    measured = materialize(measures(docs.select("doc_id", "text", _stratum().alias("stratum"))).drop("text"), "measures")
    cutoffs = calibrate(measured, labels, alpha, delta, rules).select("stratum", F.struct(*rules).alias("__c"))
    out = measured.join(cutoffs, "stratum", "left")
    return out.select("doc_id", *[F.col(f"__q.{c}").alias(c) for c in BASE], F.col("__q.base_failed").alias("base_failed"), _verdict(rules, "__q", "__c").alias("kept"))


def kept_documents(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> DataFrame:
    """The rows of docs that apply_rules keeps. Rows are measured once and written with their measures: a filter on
    measures that are not written yet would be pushed below them and have them computed twice."""
    q, stratum, c = (scratch(docs, x) for x in ("q", "stratum", "c"))
    measured = materialize(measures(docs.withColumn(stratum, _stratum()), q), "measures")
    sample = measured.select("doc_id", F.col(stratum).alias("stratum"), F.col(q).alias("__q"))
    cutoffs = materialize(calibrate(sample, labels, alpha, delta, rules), "cutoffs")  # a row per stratum
    return measured.join(cutoffs.select(F.col("stratum").alias(stratum), F.struct(*rules).alias(c)), stratum, "left").where(_verdict(rules, q, c)).select(*docs.columns)


def sql(alpha: float = ALPHA, delta: float = DELTA, rules: dict = RULES) -> str:
    """DuckDB SQL for apply_rules() over documents and labels (doc_ids unique)."""
    tail = (
        f"CASE WHEN lost > good * {alpha!r} THEN 1.0 ELSE list_sum(list_transform(range(0, (lost + 1)::BIGINT), lambda i: "
        f"exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({alpha!r}) + (good - i) * ln(1 - {alpha!r})))) END"
    )
    gain = f"CASE WHEN good > 0 AND bad > 0 THEN caught / bad - {GOOD_WEIGHT!r} * lost / good ELSE 0 END"
    cuts = " UNION ALL ".join(f"SELECT '{r}' AS rule, {c!r}::DOUBLE AS cut, {r} AS x, lang, quality FROM held WHERE lays" for r, cs in rules.items() for c in cs)
    steps = ", ".join(f"({j}, {b!r}::DOUBLE)" for j, b in enumerate(STEPS))
    path = ", ".join(f"min(cut) FILTER (rule = '{r}' AND lost / good <= step AND gain > 0) AS {r}" for r in rules)
    out = " OR ".join(f"coalesce(held.{r} > path.{r}, false)" for r in rules)
    passes = " AND ".join(f"coalesce(m.{r} <= path.{r}, true)" for r in rules)
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + {WINDOW - 1}) AS g FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS t(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, sum(least({WINDOW}, coalesce(gap, {WINDOW})))::BIGINT AS n FROM (SELECT doc_id, lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i AS gap FROM twice) GROUP BY doc_id),
b AS (SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(l) AS lines, len(list_distinct(w)) AS distinct_words, len(regexp_extract_all(text, '\\p{{Lu}}')) AS upper,
    len(list_filter(w, lambda x: NOT regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) AS n_bars FROM d LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbols, CASE WHEN word_chars > 0 THEN upper / word_chars ELSE 0 END AS shouting,
    CASE WHEN lines > 0 THEN n_dup_lines / lines ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeats,
    CASE WHEN n_words > 0 THEN (n_words - distinct_words) / n_words ELSE 0 END AS sameness, CASE WHEN n_words > 0 THEN n_bars / n_words ELSE 0 END AS bars FROM b),
held AS (SELECT m.*, quality, substr(md5('rules:' || doc_id::VARCHAR), 1, 1) < '{LAYS}' AS lays FROM m JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IN (0, 1)),
s AS (SELECT lang, sum(quality) AS good, sum(1 - quality) AS bad FROM held WHERE lays GROUP BY lang),
c AS (SELECT rule, cut, lang, count(*) FILTER (x > cut AND quality = 1) AS lost, count(*) FILTER (x > cut AND quality = 0) AS caught FROM ({cuts}) GROUP BY ALL),
g AS (SELECT c.*, good, {gain} AS gain FROM c JOIN s ON c.lang IS NOT DISTINCT FROM s.lang),
path AS (SELECT lang, j, {path} FROM g, (VALUES {steps}) AS v(j, step) GROUP BY lang, j),
r AS (SELECT held.lang, j, quality, {out} AS gone FROM held JOIN path ON held.lang IS NOT DISTINCT FROM path.lang WHERE NOT lays),
t AS (SELECT lang, j, sum(quality) AS good, sum(1 - quality) AS bad, count(*) FILTER (gone AND quality = 1) AS lost, count(*) FILTER (gone AND quality = 0) AS caught FROM r GROUP BY lang, j),
p AS (SELECT *, {gain} AS gain, good > 0 AND {tail} <= {delta!r} / (SELECT count(*) FROM t WHERE j = 0) AS sure FROM t),
e AS (SELECT *, bool_and(sure) OVER (PARTITION BY lang ORDER BY j) AS certified FROM p),
chosen AS (SELECT lang, arg_max(j, (gain, -j)) AS j FROM e WHERE certified AND gain > 0 GROUP BY lang),
final AS (SELECT path.* FROM path JOIN chosen ON path.j = chosen.j AND path.lang IS NOT DISTINCT FROM chosen.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {passes.replace('path.', 'final.')} AS kept
FROM m LEFT JOIN final ON m.lang IS NOT DISTINCT FROM final.lang
"""
