"""Quality rules as weak supervision, in DataFrame functions alone.

Each rule looks at counts of a document and votes good, votes bad or abstains. Expectation-maximisation estimates how
often each rule votes right on good and on bad documents, without labels, from the counts of vote patterns of the
documents that pass the base rule (at most three to the power of the rules, whatever the table's size). A document's posterior probability of being good then
decides, in place of a demand that all rules pass; only the base rule is a hard limit.

Defined cases: a null or empty text has no words, fails the base rule and is not kept. Null and repeated ids are
rows of their own. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.session import materialise

#: Rule: (vote bad if, vote good if); it abstains between.
RULES = {
    "word_length": ("word_chars < 2 * n_words or word_chars > 12 * n_words", "word_chars >= 3 * n_words and word_chars <= 10 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "symbol_share": ("50 * n_symbols > word_chars", "250 * n_symbols <= word_chars"),
    "marked_words": ("10 * n_marked > n_words", "50 * n_marked <= n_words"),
    "lines": ("10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0"),
    "repeats": ("10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    "capitals": ("10 * n_capitals > 3 * word_chars", "10 * n_capitals <= word_chars"),
    "sentences": ("100 * n_stops < n_words", "30 * n_stops >= n_words"),
}
_SPACES = r"[\x20\x09-\x0D]+"


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules use.

    Three-word windows are compared within a text: a hash and the window's number are sorted as one number, and of those
    whose hashes are equal neighbours the words themselves are sorted and compared, so no chance hit of the shortened hash
    counts, however long the text.
    """
    words = docs.select("doc_id", F.expr("coalesce(text, '')").alias("text"),
                        F.expr(f"array_remove(split(coalesce(text, ''), '{_SPACES}'), '')".replace("\\", "\\\\")).alias("words"))
    plain = F.expr(r"translate(text, ' \t\n\u000b\u000c\r', '')")
    counted = words.select(
        "doc_id", "words", F.size("words").alias("n"), F.length(plain).alias("word_chars"),
        F.expr("length(text) - length(translate(text, '#*$%&|<>', ''))").alias("n_symbols"),
        F.expr("length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))").alias("n_capitals"),
        F.expr("length(text) - length(translate(text, '.!?', ''))").alias("n_stops"),
        F.expr("size(filter(words, w -> w rlike '[#*$%&|<>]|!!'))").alias("n_marked"),
        F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    keyed = counted.select(
        "*", F.length(F.bin("n")).alias("bits"), F.expr("""
        case when n >= 3 then transform(sequence(0, n - 3), i ->
            shiftleft(xxhash64(get(words, i), get(words, i + 1), get(words, i + 2)), length(bin(n))) | i) end""").alias("keys"))
    ordered = keyed.select("doc_id", "words", "n", "word_chars", "n_symbols", "n_capitals", "n_marked", "n_stops", "lines", "bits",
                           F.sort_array("keys").alias("keys"))
    alike = ordered.select("*", F.expr("""
        sort_array(transform(transform(filter(keys, (x, i) ->
            coalesce(shiftright(x, bits) = shiftright(get(keys, i - 1), bits), false)
            or coalesce(shiftright(x, bits) = shiftright(get(keys, i + 1), bits), false)),
            x -> x & (shiftleft(1L, bits) - 1)), x ->
            struct(get(words, int(x)) as a, get(words, int(x) + 1) as b, get(words, int(x) + 2) as c, x)))""").alias("windows"))
    same = "(x.a = get(windows, i {0} 1).a and x.b = get(windows, i {0} 1).b and x.c = get(windows, i {0} 1).c)"
    repeated = alike.select("*", F.expr(f"""
        sort_array(transform(filter(windows, (x, i) -> coalesce({same.format("-")}, false) or coalesce({same.format("+")}, false)),
            x -> x.x))""").alias("at"))
    covered = F.expr("aggregate(transform(at, (x, i) -> if(i = 0, 3L, least(3L, x - get(at, i - 1)))), 0L, (s, x) -> s + x)")
    return repeated.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), F.col("n_capitals").cast("long").alias("n_capitals"),
        F.col("n_marked").cast("long").alias("n_marked"), F.col("n_stops").cast("long").alias("n_stops"))


def _vote(name: str) -> Column:
    bad, good = RULES[name]
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


def fit_accuracies(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50,
                   on_good: tuple[float, float] = (0.55, 0.999), on_bad: tuple[float, float] = (0.2, 0.99)):
    """Share of good documents, and per rule how often its votes are right on good and on bad ones.

    ``patterns``: votes (-1, 0, 1) and how many documents cast them. Estimates are smoothed and held within
    ``on_good`` and ``on_bad``, so that a rule keeps its meaning: most good documents pass it, while a bad document
    may be bad in another way and pass it too.
    """
    n = len(RULES)
    share, right = 0.7, [(0.8, 0.8)] * n
    total = sum(c for _, c in patterns)
    if not total:
        return share, right
    for _ in range(rounds):
        good_mass = 0.0
        votes = [[1.0, 2.0, 1.0, 2.0] for _ in range(n)]  # right and all on good, right and all on bad
        for cast, count in patterns:
            p = posterior(cast, share, right)
            good_mass += p * count
            for j, v in enumerate(cast):
                if v:
                    votes[j][0] += p * count * (v > 0)
                    votes[j][1] += p * count
                    votes[j][2] += (1 - p) * count * (v < 0)
                    votes[j][3] += (1 - p) * count
        share = min(0.98, max(0.02, good_mass / total))
        right = [(min(on_good[1], max(on_good[0], a / b)), min(on_bad[1], max(on_bad[0], c / d))) for a, b, c, d in votes]
    return share, right


def _weights(share: float, right) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of good before any vote, and what a good and a bad vote of each rule add."""
    return math.log(share / (1 - share)), [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in right]


def posterior(cast, share: float, right) -> float:
    start, weights = _weights(share, right)
    odds = start + sum(w[0] if v > 0 else w[1] for v, w in zip(cast, weights) if v)
    return 1 / (1 + math.exp(-odds))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: the base counts, base_failed, kept and the posterior."""
    counts = materialise(text_counts(docs), "text-counts")
    votes = [_vote(name).alias(name) for name in RULES]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = counts.where(~failed).select(*votes).groupBy(*RULES).count().collect()  # at most 3 ** len(RULES)
    patterns = sorted((tuple(r[name] for name in RULES), r["count"]) for r in rows)
    start, weights = _weights(*fit_accuracies(patterns))
    odds = F.lit(start)
    for name, (good, bad) in zip(RULES, weights):
        vote = _vote(name)
        odds = odds + F.when(vote == 1, good).when(vote == -1, bad).otherwise(0.0)
    judged = counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           failed.alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("posterior"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
