"""The learned operators against plain versions: a GRU written out position by position, its numerical gradient, all paths of a lattice."""

import itertools
import random

import numpy as np
import pytest

from pulsegrid.llm import language_id as L
from pulsegrid.llm import toxicity as X


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def plain_positions(p, data):
    """(positions, labels): the network on one text, step by step in double precision."""
    wx, u, b, wo, bo = (np.asarray(q, float) for q in p)
    n, h_ = len(data), u.shape[1]
    states = np.zeros((2, n, h_))
    for j in (0, 1):
        h = np.zeros(h_)
        for t in range(n) if j == 0 else range(n - 1, -1, -1):
            a, v = wx[j][data[t]] + b[j].reshape(-1), h @ u[j]
            z, r = sigmoid(a[:h_] + v[:h_]), sigmoid(a[h_ : 2 * h_] + v[h_ : 2 * h_])
            h = (1 - z) * np.tanh(a[2 * h_ :] + r * v[2 * h_ :]) + z * h
            states[j, t] = h
    logits = states[0] @ wo[0] + states[1] @ wo[1] + bo
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def parameters(net):
    return [net.wx, net.u, net.b, net.wo, net.bo]


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(97, 103, (60, 12)), rng.integers(100, 106, (60, 12))]).astype(np.uint8)
    return L.train(x, np.repeat([0, 1], 60), ["a", "b"], steps=20)


def test_predictions_are_the_plain_network(net):
    """Texts of 1 to 600 bytes, more than a segment among them; segments start from nothing."""
    rng = np.random.default_rng(1)
    sizes = [1, 2, 7, 50, L.SEGMENT, L.SEGMENT + 1, 2 * L.SEGMENT + 9, 0]
    data = rng.integers(0, 256, sum(sizes)).astype(np.uint8)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    got = L.predict_texts(net, data, offs)
    for k, (a, b) in enumerate(zip(offs, offs[1:])):
        text = data[a:b]
        parts = [plain_positions(parameters(net), text[i : i + L.SEGMENT]) for i in range(0, len(text), L.SEGMENT)]
        want = np.concatenate(parts).mean(0) if parts else np.zeros(2)
        assert np.allclose(got[k], want, atol=2e-4)


def test_one_step_goes_down_the_numerical_gradient():
    """The first step moves every parameter by the rate against its gradient's sign (Adam from nothing)."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(97, 100, (1, 5)).astype(np.uint8), np.array([1])
    before, after = (parameters(L.train(x, y, ["a", "b", "c"], steps=s)) for s in (0, 1))
    p = [np.array(q, float) for q in before]
    loss = lambda: -np.log(plain_positions(p, x[0])[:, 1]).mean()
    checked = 0
    for i, q in enumerate(p):
        places = [k for k in np.ndindex(q.shape) if i != 0 or k[1] in set(x[0].tolist())]
        for k in random.Random(i).sample(places, min(60, len(places))):
            old = q[k]
            q[k] = old + 1e-5
            up = loss()
            q[k] = old - 1e-5
            g = (up - loss()) / 2e-5
            q[k] = old
            if abs(g) > 1e-5:
                assert np.sign(before[i][k] - after[i][k]) == np.sign(g), (i, k)
                checked += 1
    assert checked > 150


@pytest.fixture(scope="module")
def chars():
    rng = np.random.default_rng(3)
    code = np.unique(rng.integers(0, 27, (4000, 3)) @ np.array([X.SYMBOLS**2, X.SYMBOLS, 1]))
    m = X.CharModel(code, rng.integers(1, 60, len(code)))
    m.build()
    return m


def cost(letters, prices, model):
    a = b = 0
    total = 0.0
    for part, price in zip([*letters, " "], [*prices, 0.0]):
        total += price
        for s in (int(X.SYMBOL[c]) for c in part.encode()):
            total += model.table[(a * X.SYMBOLS + b) * X.SYMBOLS + s]
            a, b = b, s
    return total


TOKENS = ["1d10t", "m0r0n", "i d i o t", "a.b-c_d", "sccccum", "idiooot", "h3110", "$h!t", "a  b c  d", "5ee", "(|0vvn", "zzz", "b00k", "x*y", "e-e-e-e"]


@pytest.mark.parametrize("token", TOKENS)
def test_viterbi_is_the_cheapest_of_all_paths(token, chars):
    slots = X.lattice(token)
    every = [("".join(l for l, _ in path), cost([l for l, _ in path], [c for _, c in path], chars)) for path in itertools.product(*slots)]
    least = min(c for _, c in every)
    got = X.viterbi(slots, chars)
    assert got in {s.strip() for s, c in every if c <= least + 1e-9}


def test_readings_of_random_lattices(chars):
    rng = random.Random(4)
    for _ in range(200):
        slots = [[(rng.choice(["a", "b", "ab", "", " ", "q"]), rng.choice([0.0, 0.5, 1.0])) for _ in range(rng.choice([1, 2, 3]))] for _ in range(rng.choice([1, 3, 6]))]
        every = {}
        for path in itertools.product(*slots):
            s = "".join(l for l, _ in path)
            every[s] = min(every.get(s, 1e18), cost([l for l, _ in path], [c for _, c in path], chars))
        least = min(every.values())
        assert X.viterbi(slots, chars) in {s.strip() for s, c in every.items() if c <= least + 1e-9}
