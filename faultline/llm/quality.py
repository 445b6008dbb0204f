"""Quality rules as weak supervision, in DataFrame functions.

Each rule votes good (1), bad (-1) or abstains (0) on a document's statistics.
Expectation-maximisation over the histogram of vote patterns (at most 3^rules
rows, whatever the corpus size) estimates how accurately each rule votes on good
documents and in each way of being bad, and the posterior probability of good
replaces all-must-pass filtering. All chances are estimated. There are no
labels, so priors, which weigh as a fixed share of the corpus, give the classes
their meaning: a rule seldom votes bad on good documents, and a failure mode has
the bad votes of the rule that it is named after. An abstention says nothing,
but for a mode's own rule. A bad vote that stands alone where its mode has other
marks is outvoted. One rule's bad votes alone on very many documents that all
other rules vote good on may be read either way.

A null text has no words and fails the base test. Rows are kept one for one,
repeated rows too; other columns are not read. Very long texts are read whole;
a row's words and its windows' hashes are held at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, whole_text

#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that for it with as was on be by are this from or an at "
    "le la les de des du et un une en que qui dans pour pas sur au par est "
    "der die das und zu den von mit sich im ist nicht ein eine als auf "
    "el los las y del una con por para se su al lo como"
).split()

MIN_WORDS = 50
THRESHOLD = 0.5
ITERATIONS = 40

Rule = tuple[str, Column, Column]


def default_rules() -> list[Rule]:
    """(name, good, bad): a rule abstains where neither holds."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    mean = F.col("word_chars") / n
    return [
        ("word_length", mean.between(3.0, 9.0), (mean < 2.2) | (mean > 12.0)),
        ("symbols", F.col("n_symbols") * 50 <= n, F.col("n_symbols") * 8 > n),
        ("duplicate_lines", F.col("n_dup_lines") == 0, F.col("n_dup_lines") * 3 > F.col("n_lines")),
        ("repetition", F.col("n_repeat_words") * 10 <= n, F.col("n_repeat_words") * 4 > n),
        ("capitals", F.col("n_upper") * 8 <= chars, F.col("n_upper") * 4 > chars),
        ("exclamations", F.col("n_exclaims") * 50 <= n, F.col("n_exclaims") * 8 > n),
        ("function_words", F.col("n_function") * 10 >= n, F.col("n_function") * 25 < n),
        ("sentence_ends", F.col("n_ends") * 2 >= F.col("n_lines"), F.col("n_ends") * 4 < F.col("n_lines")),
    ]


def statistics(docs: DataFrame, carried: str = "doc_id") -> DataFrame:
    """A carried column and the counts that rules look at, one row per document.

    Windows are compared by their 64-bit hash within one document. Only where a
    text has equal hashes at all are they sorted with their places.
    """
    spaces = r"[\x20\x09-\x0D]+"
    base = docs.select(
        carried,
        F.array_remove(F.split(whole_text(), spaces), "").alias("words"),
        F.filter(F.split(whole_text(), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(whole_text(), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(whole_text(), F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(whole_text(), F.lit("!")).cast("long").alias("n_exclaims"),
    )
    hashed = base.select(
        carried,
        "n_symbols",
        "n_upper",
        "n_exclaims",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda line: line.rlike(r"[.!?\"][\x20\x09-\x0D]*\z"))).cast("long").alias("n_ends"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*FUNCTION_WORDS))).cast("long").alias("n_function"),
        F.expr("CASE WHEN size(words) < 4 THEN CAST(array() AS array<bigint>) ELSE transform(slice(words, 1, size(words) - 2), (w, i) -> xxhash64(w, words[i + 1], words[i + 2])) END").alias("windows"),
    )
    places = F.expr("""
        CASE WHEN size(windows) = size(array_distinct(windows)) THEN CAST(array() AS array<struct<h: bigint, i: int>>)
        ELSE sort_array(transform(windows, (h, i) -> struct(h, i))) END""")
    repeated = F.expr("sort_array(transform(filter(places, (p, j) -> (j > 0 AND places[greatest(j - 1, 0)].h = p.h) OR (j < size(places) - 1 AND places[least(j + 1, size(places) - 1)].h = p.h)), p -> p.i))")
    count = F.expr("CASE WHEN size(at) = 0 THEN 0L ELSE aggregate(transform(at, (p, j) -> CASE WHEN j = size(at) - 1 THEN 3 ELSE least(3, at[least(j + 1, size(at) - 1)] - p) END), 0L, (s, x) -> s + x) END")
    kept = [c for c in hashed.columns if c != "windows"]
    return hashed.select(*kept, places.alias("places")).select(*kept, repeated.alias("at")).select(*kept, count.alias("n_repeat_words"))


def votes(rules: list[Rule]) -> Column:
    return F.array(*[F.when(bad, -1).when(good, 1).otherwise(0) for _, good, bad in rules])


#: Priors of the classes' shares (good, all modes together), of a bad and a good
#: vote in the good class and of a mode's other rules, and of a bad, a good and no
#: vote of a mode's own rule. Each weighs as much as that share of the documents.
SHARES, SHARES_WEIGHT = (0.8, 0.2), 0.01
GOOD, GOOD_WEIGHT = (0.02, 0.98), 0.1
OWN, OWN_WEIGHT = (0.9, 0.02, 0.08), 0.03
OTHER, OTHER_WEIGHT = (0.3, 0.7), 0.001


def fit(voted: DataFrame, n_rules: int, iterations: int = ITERATIONS) -> list[dict]:
    """The latent classes: good first, then one failure mode per rule.

    Bad documents fail in different ways, so each rule has a mode of its own.
    EM estimates each class's share ``pi`` and its chances ``t[rule]`` of a bad
    and a good vote, and of none in a mode's own rule. All of it is one aggregate
    over the pattern histogram; the driver gets one row.
    """
    patterns = voted.groupBy("votes").count().agg(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("count").cast("double").alias("n"))).alias("pats"))
    rules = f"sequence(0, {n_rules - 1})"
    shape = "struct<pi: double, t: array<array<double>>>"
    numbers = lambda xs: "array(" + ", ".join(f"{x}D" for x in xs) + ")"
    share = f"CASE WHEN k = 0 THEN {SHARES[0]}D ELSE {SHARES[1] / n_rules}D END"
    start = f"""transform(sequence(0, {n_rules}), k -> CAST(named_struct('pi', {share},
        't', transform({rules}, r -> CASE WHEN k = 0 THEN {numbers([*GOOD, 1])} WHEN r = k - 1 THEN {numbers(OWN)} ELSE {numbers([*OTHER, 1])} END)) AS {shape}))"""
    logs = f"transform(p, c -> ln(c.pi) + aggregate({rules}, 0D, (s, r) -> s + ln(c.t[r][CASE x.v[r] WHEN -1 THEN 0 WHEN 1 THEN 1 ELSE 2 END])))"
    weights = f"transform(array({logs}), l -> transform(l, y -> exp(y - array_max(l))))[0]"
    shares = f"transform(array({weights}), w -> transform(w, y -> x.n * y / aggregate(w, 0D, (s, z) -> s + z)))[0]"
    expect = f"transform(pats, x -> named_struct('v', x.v, 'n', x.n, 'g', {shares}))"
    documents = "greatest(1D, aggregate(pats, 0D, (s, x) -> s + x.n))"
    total = "aggregate(q, 0D, (s, x) -> s + x.g[k])"
    votes = "transform(array(-1, 1, 0), vote -> aggregate(q, 0D, (s, x) -> s + CASE WHEN x.v[r] = vote THEN x.g[k] ELSE 0D END))"
    own = "array(" + ", ".join(f"({OWN_WEIGHT * x}D * {documents} + c[{i}]) / ({OWN_WEIGHT}D * {documents} + c[0] + c[1] + c[2])" for i, x in enumerate(OWN)) + ")"
    two = lambda weight, prior: f"transform(array(({weight * prior[0]}D * {documents} + c[0]) / ({weight}D * {documents} + c[0] + c[1])), b -> array(b, 1 - b, 1D))[0]"
    update = f"""transform(sequence(0, {n_rules}), k -> named_struct(
        'pi', ({SHARES_WEIGHT}D * {documents} * {share} + {total}) / ({1 + SHARES_WEIGHT}D * {documents}),
        't', transform({rules}, r -> transform(array({votes}), c -> CASE WHEN k = 0 THEN {two(GOOD_WEIGHT, GOOD)} WHEN r = k - 1 THEN {own} ELSE {two(OTHER_WEIGHT, OTHER)} END)[0])))"""
    em = f"aggregate(sequence(1, {iterations}), {start}, (p, i) -> transform(array({expect}), q -> {update})[0])"
    row = patterns.select(F.expr(em).alias("classes")).collect()[0]["classes"]
    return [c.asDict() for c in row]


def posterior(classes: list[dict], rules: list[Rule]) -> Column:
    """Probability of the good class given a row's votes."""
    import math

    odds = F.lit(1.0)
    for c in classes[1:]:
        ratio = F.lit(math.log(c["pi"] / classes[0]["pi"]))
        for (_, good, bad), mine, best in zip(rules, c["t"], classes[0]["t"], strict=True):
            w = [math.log(x / y) for x, y in zip(mine, best, strict=True)]
            ratio = ratio + F.when(bad, w[0]).when(good, w[1]).otherwise(w[2])
        odds = odds + F.exp(F.least(F.lit(500.0), ratio))
    return 1 / odds


def _judged(stats: DataFrame, made: list[Rule], threshold: float) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    fitted = fit(stats.select(votes(made).alias("votes")), len(made))
    out = stats.withColumn("base_failed", failed).withColumn("posterior", posterior(fitted, made))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def judge(docs: DataFrame, rules: Callable[[], list[Rule]] = default_rules, threshold: float = THRESHOLD) -> DataFrame:
    """Statistics of each document with base_failed, posterior and kept."""
    return _judged(stash(statistics(docs), "quality"), rules(), threshold)


def clean(docs: DataFrame, rules: Callable[[], list[Rule]] = default_rules, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept. Rows travel with their statistics, so none is looked up by its id."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return _judged(stash(statistics(rows, "row"), "quality"), rules(), threshold).where("kept").select("row.*")
