"""Line windows, pieces, the registered queries and the pipeline."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as driver
import corpus_pipeline
from scorewright.llm import line_windows, merge_dropout, queries
from scorewright.session import materialise
from tests.llm.test_near import brute_classes

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def brute_lines(rows):
    """Texts after dedup, for rows of distinct (id, text), in order."""
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        worded = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for k in range(len(worded) - 2):
            window = tuple(lines[i] for i in worded[k:k + 3])
            if window in seen:
                gone.update(worded[k:k + 3])
            seen.add(window)
        out[doc, text] = text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)
    return out


def test_line_windows_odd(odd_docs, odd_rows, no_docs):
    rows = [r for r in odd_rows if r[0] is not None]
    done = line_windows.dedup_lines(odd_docs.where("doc_id is not null"))
    want = brute_lines(rows)
    got = Counter((r.row_.doc_id, r.row_.text, r.dedup_.n_removed) for r in done.collect())
    assert got == Counter((i, *want[i, t]) for i, t in rows)
    assert line_windows.flat(done).columns == odd_docs.columns
    assert line_windows.dedup_lines(odd_docs).count() == len(odd_rows)
    assert line_windows.dedup_lines(no_docs).collect() == []


def test_line_windows_chains(spark):
    rows = [(0, "x\na\nb"), (1, "x\na\nb\nc\nd"), (2, "a\nb\nc\n\nz"), (3, "q\nq\nq\nq\nq"), (4, "b\nc\nd\ne"), (5, "q\n \nq\nq")]
    got = {r.row_.doc_id: r.row_.text for r in line_windows.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t for (i, _), (t, _) in brute_lines(rows).items()}


def test_pieces(spark, documents, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    exact, varied = merge_dropout.DropoutCoder(PIECES, 0.0), merge_dropout.DropoutCoder(PIECES, 0.3)
    odd = ["", " ", "  a  b\n c\t ", "\n", "é ﬁ 五六 😀", "a" * 500, "\x00x", "<s> </s> <unk> <0x41>", "abc " * 60]
    for text in list(texts.values())[:60] + odd:
        assert np.frombuffer(exact.encode(text, 0), "<u2").tolist() == model.encode(text)
        for variant in range(3):
            assert varied.decode(varied.encode(text, variant)) == text
            assert model.decode(np.frombuffer(varied.encode(text, variant), "<u2").tolist()) == model.decode(model.encode(text))
    for text in ("▁", "a▁b ▁ c", " ▁▁ "):  # a literal space mark
        assert varied.decode(varied.encode(text, 1)) == text
    long = "donaudampfschifffahrtsgesellschaft" * 2
    assert len({varied.encode(long, v) for v in range(20)}) > 5
    narrow = merge_dropout.DropoutCoder(PIECES, 0.3, wide=5)  # a heap for every longer word
    for text in [long, long * 9, *odd, *list(texts.values())[:20]]:
        for variant in range(4):
            assert varied.encode(text, variant) == narrow.encode(text, variant)


def test_pieces_odd(odd_docs, odd_rows, no_docs):
    rows = merge_dropout.round_trips(odd_docs, PIECES).collect()
    assert all(r.lossless for r in rows)
    assert Counter((r.doc_id, r.n_chars) for r in rows) == Counter((i, len(t or "")) for i, t in odd_rows)
    assert rows and merge_dropout.round_trips(no_docs, PIECES).collect() == []


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(driver.queries())
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_line_oracle(spark, duck, sf_dir):
    got = Counter(map(tuple, queries.op5_line_windows(spark, sf_dir).collect()))
    assert got == Counter(duck.sql(queries.ORACLES["op5_line_windows"]).fetchall())


@pytest.mark.parametrize("name", ["op2_repair_store", "op4_bagminhash", "op6_markov_secrets", "op7_residual_packing", "op8_minhash",
                                  "op9_merge_dropout", "op10_weak_rules"])
def test_query_covers_the_table(spark, sf_dir, documents, name):
    got = queries.QUERIES[name](spark, sf_dir)
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    assert ids == {r.doc_id for r in documents.select("doc_id").collect()}


def test_pipeline(spark, sf_dir, documents, labels):
    """Each stage against its own plain version, on what its predecessor kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "secrets", "pack"]
    rows, tables = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = materialise(stage(spark, rows, sf_dir), name)
        tables[name] = rows
        assert name == "pack" or rows.columns == documents.columns
    text = {n: dict(t.select("doc_id", "text").collect()) for n, t in tables.items() if n != "pack"}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good - text["quality"].keys()) <= 0.05 * len(good) and len(bad & text["quality"].keys()) <= 0.4 * len(bad)
    want = brute_lines(list(text["quality"].items()))
    assert text["lines"] == {i: t for (i, _), (t, _) in want.items()}
    ordered = sorted(text["lines"].items())
    assert sorted(text["near_copies"]) == sorted({ordered[r][0] for r in brute_classes(ordered)})
    assert all(len(r.text) == r.n_chars for r in tables["secrets"].collect())
    assert not any("password=" in t for t in text["secrets"].values())
    assert {r.doc_id for r in tables["pack"].collect()} == text["near_copies"].keys()
