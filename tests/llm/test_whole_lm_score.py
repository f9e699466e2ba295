"""LM scoring over all characters, against plain loops over n-grams."""

import math
from collections import Counter

import pytest

from atlasloom.llm.lm_score import GRAMS, ORDER, STRENGTH, _grams, _segments, lm_score

TEXTS = ["abc 1203", "abc 4567", "Привет, мир", "привет 世界", "", None, "abcdefghijklmnopqrstuvwxyz0123456789áàâäãåéèêëíìîïóòôöúùûü", "@" * 9, "abc 1203"]
TARGET = {0, 2}


def plain() -> list:
    def grams(text):
        own = ["start"] * (ORDER - 1) + list((text or "").lower())
        return [tuple(own[i : i + ORDER]) for i in range(len(own) - ORDER + 1)]

    every = Counter(g for x in TEXTS for g in grams(x))
    target = Counter(g for k in TARGET for g in grams(TEXTS[k]))
    size, scale = len({g[-1] for g in every}), sum(target.values()) / sum(every.values())

    def p(counts, g, by):
        if not g:
            return 1 / size
        n = sum(c for h, c in counts.items() if h[ORDER - len(g) :] == g) * by
        of = sum(c for h, c in counts.items() if h[ORDER - len(g) : -1] == g[:-1]) * by
        return (n + STRENGTH * p(counts, g[1:], by)) / (of + STRENGTH)

    out = []
    for x in TEXTS:
        own = grams(x)
        out.append((len(own), *(sum(-math.log(p(c, g, by)) for g in own) / len(own) if own else None for c, by in ((target, 1.0), (every, scale)))))
    return out


@pytest.mark.parametrize("most", [GRAMS, 5])
def test_every_character_counts(spark, most):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm_score(docs, spark.createDataFrame([(k,) for k in TARGET], "doc_id long"), most=most).collect()}
    assert len(got) == len(TEXTS)
    for k, (n, target, background) in enumerate(plain()):
        assert got[k].n_tokens == n
        if n:
            assert math.isclose(got[k].target_loss, target, rel_tol=1e-9) and math.isclose(got[k].background_loss, background, rel_tol=1e-9)
            assert math.isclose(got[k].score, target - background, rel_tol=1e-9, abs_tol=1e-12)
        else:
            assert got[k].target_loss is None and got[k].score is None
    # Digits differ, so the one among the targets is nearer to them.
    assert got[0].score < got[1].score


def test_more_symbols_than_fit_one_number():
    text = "".join(map(chr, [*range(0x4E00, 0x9FFF), *range(0x20000, 0x2A6DF)]))
    head, tail, n, which = _grams(list(_segments(text)))
    assert len(n) == len(text) and set(n) == {1} and [chr(x) for x in tail[which]] == list(text)
