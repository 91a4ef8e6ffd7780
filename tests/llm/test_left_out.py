"""Training bits: what depends on counts only is worked out once, not for each text and pass."""

import math

import numpy as np

from ledgerloom.llm import context_mixing as cm

TEXTS = ["ban dan ban", "", "dan  ban kin " * 30, "É x", "ban"]


def log_odds(a, b):
    return min(10.0, max(-10.0, math.log((b + 0.4) / (a + 0.4))))


def often(n):
    return min(7, int(math.log2(n + 1)) * 2 // 3 + (n > 0))


def tallied(s):
    halves = np.zeros(cm.SLOTS, np.float32)
    for k in s.slots:
        np.add.at(halves, k, 1)
    return cm.Tally(halves)


def test_each_bit_is_out_of_its_own_counts():
    s = cm.Stream([cm.words_of(t) for t in TEXTS])
    tally = tallied(s)
    n0, n1 = cm.bits_of(tally.halves)
    met = []
    for gate, places, x in tally.inputs.by_gate(s):
        x = x.reshape(cm.INPUTS, -1, 4)
        for j, at in enumerate(places):
            h, starts = int(s.half[at]), [int(k[at]) & ~15 for k in s.slots]
            n = [int(n0[starts[p] + 1] + n1[starts[p] + 1]) - 1 for p in (cm.WORD, cm.LONGEST)]
            assert gate == 8 * often(n[0]) + often(n[1])
            for i in range(4):
                bit, node = h >> 3 - i & 1, 1 << i | h >> 4 - i
                for p, k in enumerate(starts):
                    want = log_odds(n0[k + node] - 1 + bit, n1[k + node] - bit)
                    assert math.isclose(x[p, j, i], want if bit else -want, abs_tol=1e-5)
            met.append(int(at))
    assert sorted(met) == list(range(2 * len(s.text)))


def test_passes_over_the_texts_take_no_logarithm_of_counts(monkeypatch):
    s = cm.Stream([cm.words_of(t) for t in TEXTS])
    left, mixer = tallied(s).inputs, cm.Mixer()
    monkeypatch.setattr(cm, "stretched", None)
    sums = np.zeros(cm.GATES * cm.INPUTS * (1 + cm.INPUTS))
    cm.newton_sums(sums, left, mixer, s)
    hits = np.zeros(2 * cm.GATES * cm.CELLS)
    cm.refine_sums(hits, left, mixer, s)
    assert sums.any() and hits[: cm.GATES * cm.CELLS].sum() == 8 * len(s.text)
    assert len(cm.left_out_costs(left, mixer, s)) == sum(len(cm.words_of(t)) for t in TEXTS)
