"""Secrets of one kind of character, and what fixed patterns leave of a longer one."""

import random
import string

import pytest

from scorewright.llm import secret_scan


@pytest.fixture(scope="module")
def model(documents):
    return secret_scan.train(documents)


def test_random_strings_of_one_kind(model):
    rng = random.Random(3)
    for alphabet in (string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters, "0123456789-", string.ascii_letters + string.digits):
        keys = ["".join(rng.choices(alphabet, k=28)) for _ in range(100)]
        hit = sum(secret_scan.all_spans(f"a key {k} here", model) != [] for k in keys)
        assert hit >= 90, (alphabet, hit)


def test_ordinary_runs_pass(model):
    for run in ("-" * 40, "=" * 60, "_" * 20, "2024-01-15_2024-02-16", "internationalization", "antidisestablishmentarianism",
                "configuration_settings", "CONFIGURATION_SETTINGS", "state-of-the-art-solutions", "misunderstandings"):
        assert secret_scan.all_spans(f"see {run} there", model) == [], run


def test_rest_of_a_run(model):
    for key in ("xK9Qz7Lm" + "0123456789abcdef01234567" + "Rt8Vb4Nw", "AKIA" + "Q7ZK2MXW9TB4HC6D" + "xkqzvjwpfbgh"):
        spans = secret_scan.all_spans(f"use {key} now", model)
        assert secret_scan.mask(f"use {key} now", spans, "").split() == ["use", "now"], spans
    assert secret_scan.all_spans("my_long_secret_token=abcdef99", model)[0][1] == "assign"
