"""Classifiers, rules and secrets: held-out accuracy, exact search, brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from scorewright.llm import nearest_toxic, rule_ensemble, secret_scan, weak_rules


def agreement(rows, labels, column):
    known = {r.doc_id: r[column] for r in labels.collect()}
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    return np.mean([a == b for a, b in held])


@pytest.fixture(scope="module")
def bigger(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_quality(bigger):
    docs, labels = bigger
    rows = rule_ensemble.score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert agreement(rows, labels, "quality") >= 0.95
    kept = rule_ensemble.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.predicted)


def test_rules_are_tree_paths():
    text = "Tree\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    assert rule_ensemble.tree_rules(text, ["a", "b"]) == [
        (("a", "<=", 1.5),), (("a", "<=", 1.5), ("b", "<=", 2.0)), (("a", "<=", 1.5), ("b", ">", 2.0)), (("a", ">", 1.5),)]


def plain_statistics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [l for l in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", l)]
    windows = Counter(zip(words, words[1:], words[2:]))
    repeats = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    n, chars, count = len(words), sum(map(len, words)), lambda letters: sum(c in letters for c in text)
    marked = sum(bool(re.search(r"[#*$%&|<>]|!!", w)) for w in words)
    return {"n_words": n, "word_length": chars / max(n, 1), "symbols": count("#*$%&|<>") / max(n, 1), "n_symbols": count("#*$%&|<>"),
            "marked": marked / max(n, 1), "n_marked": marked, "repeats": len(repeats) / max(n, 1),
            "capitals": sum("A" <= c <= "Z" for c in text) / max(chars, 1), "stops": count(".!?") / max(n, 1),
            "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1)}


def plain_score(text, intercept, rules):
    known = plain_statistics(text)
    odds = intercept
    for rule, weight in rules:
        if all(known[n] <= at if side == "<=" else known[n] > at for n, side, at in rule):
            odds += weight
    return 1 / (1 + np.exp(-odds))


def test_compiled_rules_like_plain_rules(spark, documents, labels, texts, odd_rows):
    sample = rule_ensemble.labelled_sample(documents, labels, "quality", 500)
    ready = rule_ensemble.statistics(documents).join(sample, "doc_id")
    intercept, rules = rule_ensemble.fit_rules(ready)
    assert rules
    many = [*texts.items(), *((1000 + i, t) for i, (_, t) in enumerate(odd_rows))]
    rows = rule_ensemble.statistics(spark.createDataFrame(many, "doc_id long, text string"))
    got = {r.doc_id: r.score for r in rows.select("doc_id", rule_ensemble.score_column(intercept, rules).alias("score")).collect()}
    for doc, text in many:
        assert abs(got[doc] - plain_score(text or "", intercept, rules)) < 1e-9


def test_lasso_has_converged(documents, labels):
    sample = rule_ensemble.labelled_sample(documents, labels, "quality", 500)
    ready = rule_ensemble.statistics(documents).join(sample, "doc_id")
    once, longer = (rule_ensemble.fit_rules(ready, iterations=n) for n in (rule_ensemble.ITERATIONS, 5 * rule_ensemble.ITERATIONS))
    assert once == longer


def test_toxic(bigger):
    docs, labels = bigger
    rows = nearest_toxic.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert agreement(rows, labels, "toxic") >= 0.95


def made_up(rng, n):
    return " ".join(rng.choice("abcdefgh") + rng.choice("klmnop") + str(rng.randrange(60)) for _ in range(n))


def test_words_of_copies_and_unsampled_words_are_not_toxic(spark):
    rng = random.Random(11)
    texts = [(f"{made_up(rng, 60)} sludge {made_up(rng, 60)}", 1) for _ in range(60)]
    odd = f"{made_up(rng, 60)} harmless {made_up(rng, 60)} sludge".split()
    texts += [(" ".join(w if rng.random() > 0.1 or w in ("harmless", "sludge") else made_up(rng, 1) for w in odd), 1) for _ in range(30)]
    texts += [(made_up(rng, 120) + (" common" if i % 40 == 0 else ""), 0) for i in range(1200)]
    texts += [(f"{made_up(rng, 120)} common sludge", 1) for _ in range(8)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    assert set(nearest_toxic.fit(docs, labels, 100).idf) == {"sludge"}


def test_block_max_search_is_exact():
    rng = random.Random(4)
    vectors = []
    for _ in range(700):
        v = {rng.randrange(40): rng.random() for _ in range(rng.randint(1, 6))}
        norm = sum(w * w for w in v.values()) ** 0.5
        vectors.append({t: w / norm for t, w in v.items()})
    index = nearest_toxic.BlockMaxIndex(vectors, block=16)
    for query in vectors[:60] + [{}, {99: 1.0}]:
        sums = [(-round(sum(w * v.get(t, 0.0) for t, w in query.items()), 12), i) for i, v in enumerate(vectors)]
        want = sorted(s for s in sums if s[0] < 0)[:15]
        got = index.search(query, 15)
        assert [round(s, 9) for s, _ in got] == [round(-s, 9) for s, _ in want]


@pytest.mark.parametrize("score", [rule_ensemble.score_quality, nearest_toxic.score_toxicity])
def test_scores_odd(spark, odd_docs, odd_rows, no_docs, labels, score):
    none = labels.limit(0)
    mixed = spark.createDataFrame([(i, i % 2, i % 2) for i in range(14)] + [(None, 1, 1), (3, None, None), (5, 1, 1)],
                                  "doc_id long, quality int, toxic int")
    for given in (none, mixed):
        rows = score(odd_docs, given).collect()
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in odd_rows)
        assert all(r.score is not None and 0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert score(no_docs, mixed).collect() == []


def brute_spans(text):
    spans = []
    for kind, pattern, least, group in (
            (0, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
            (1, r"AKIA[A-Z0-9]+", 20, 0), (2, r"[0-9a-f]+", 24, 0)):
        spans += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, re.A) if len(m[group]) >= least]
    return [("assign", "access", "hex")[k] + f":{a}:{b}" for a, k, b in sorted(spans)]


def test_secrets(spark, documents, texts):
    planted = ["PASSWORD = 'abcdef' x", "token:abc", "é api_key=\"0123456789abcdef0123456789\" AKIA" + "A1" * 9, "AKIAAKIA" + "Z" * 8,
               "token=" + "f" * 30 + " " + "0" * 23 + " " + "0" * 24, "key xK9+Qz7Lm2Rt8Vb4Nw6Yc1Hd3 done", "ordinary_identifier_name_2024 getElementByIdAndName12"]
    rows = list(texts.items()) + [(10_000 + i, t) for i, t in enumerate(planted)]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        base = brute_spans(text)
        assert got[doc].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in got[doc].spans.split(",") if s and not s.startswith("markov")] == base
        assert [got[doc].n_assign, got[doc].n_access, got[doc].n_hex] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]
    assert got[10_005].n_markov == 1 and got[10_006].n_markov == 0


def test_secrets_odd(odd_docs, odd_rows, no_docs):
    assert Counter(r.doc_id for r in secret_scan.scan(odd_docs).collect()) == Counter(i for i, _ in odd_rows)
    masked = secret_scan.masked(odd_docs)
    assert masked.columns == odd_docs.columns
    assert Counter(r.text for r in masked.collect()) == Counter(t if t is None else t.replace("password=b7db7aa4a5fcc78305", "[secret]") for _, t in odd_rows)
    assert secret_scan.scan(no_docs).collect() == [] and secret_scan.masked(no_docs).collect() == []


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    covered = {p + k for p, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_weak_rules(bigger):
    docs, labels = bigger
    rows = weak_rules.judge(docs).collect()
    texts = dict(docs.select("doc_id", "text").collect())
    for r in rows:
        want = brute_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    known = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(known[r.doc_id], int(r.kept)) for r in rows if r.doc_id in known and r.n_words >= 50]
    assert np.mean([a == b for a, b in judged]) >= 0.97


def test_accuracies_are_found():
    rng = random.Random(6)
    patterns = Counter()
    for _ in range(6000):
        good = rng.random() < 0.8
        patterns[tuple((1 if good else -1) * (1 if rng.random() < 0.9 else -1) if rng.random() < 0.7 else 0 for _ in weak_rules.RULES)] += 1
    share, right = weak_rules.fit_accuracies(sorted(patterns.items()))
    assert abs(share - 0.8) < 0.05 and all(abs(g - 0.9) < 0.05 and abs(b - 0.9) < 0.08 for g, b in right)
    assert weak_rules.fit_accuracies([])[0] == 0.7


def test_weak_rules_odd(odd_docs, odd_rows, no_docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in weak_rules.judge(odd_docs).collect())
    assert got == Counter((i, *brute_counts(t)) for i, t in odd_rows)
    assert weak_rules.judge(no_docs).collect() == []


def test_every_word_takes_part_in_the_search(spark):
    """A text without a toxic word is searched too; its nearest are those of the whole vectors."""
    rng = random.Random(3)
    texts = [(i, f"{made_up(rng, 40)} {'sludge' if i % 4 == 0 else ''} {made_up(rng, 40)}", int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    voter = nearest_toxic.fit(docs, labels, 60)
    assert "sludge" in voter.idf
    words = {i: Counter(t.split()) for i, t, _ in texts}
    seen = Counter(w for c in words.values() for w in c)
    idf = {w: (np.log(401 / (1 + n)) + 1) * (nearest_toxic.RAISED if w in voter.idf else 1.0) for w, n in seen.items()}

    def unit(counts):
        raw = {w: (1 + np.log(n)) * idf[w] for w, n in counts.items() if w in voter.number}
        return {w: x / sum(y * y for y in raw.values()) ** 0.5 for w, x in raw.items()}

    examples = {i: unit(words[i]) for i in voter.ids}
    assert set(voter.number) == {w for i in voter.ids for w in words[i]}
    found = {r.doc_id: r for r in nearest_toxic.score_toxicity(docs, labels, 60).collect()}
    for i in words:
        mine = unit(words[i])
        near = sorted(((-round(sum(x * examples[e].get(w, 0.0) for w, x in mine.items()), 9), e) for e in examples))[:nearest_toxic.EVIDENCE]
        assert len(found[i].evidence) == nearest_toxic.EVIDENCE and set(found[i].evidence) == {e for _, e in near}


def test_search_of_several_texts_is_exact():
    rng = random.Random(8)
    vectors = [{t: rng.random() for t in rng.sample(range(30), 6)} | {100 + rng.randrange(400): 3.0} for _ in range(900)]
    index = nearest_toxic.BlockMaxIndex(vectors, block=16)
    assert len(index.dense) == 30
    queries = vectors[:70] + [{}, {999: 1.0}]
    rows = [sorted((index.row[t], w) for t, w in q.items() if t in index.row) for q in queries]
    got = index.nearest([(np.array([r for r, _ in q], np.int64), np.array([w for _, w in q], np.float64)) for q in rows], 15)
    for query, found in zip(queries, got):
        sums = sorted((-round(sum(w * v.get(t, 0.0) for t, w in query.items()), 12), i) for i, v in enumerate(vectors))
        assert [round(s, 9) for s, _ in found] == [round(-s, 9) for s, _ in sums[:15] if s < 0]
