import itertools

import numpy as np

from siltworks.llm.chains import marginals, train, viterbi


def brute(emit, trans, start, first):
    """Every path of every sequence."""
    n, k = emit.shape
    starts = [i for i in range(n) if first[i] or i == 0] + [n]
    best, marg = [], np.zeros((n, k))
    for a, b in itertools.pairwise(starts):
        scores = {}
        for path in itertools.product(range(k), repeat=b - a):
            s = start[path[0]] + sum(emit[a + i, x] for i, x in enumerate(path)) + sum(trans[x, y] for x, y in itertools.pairwise(path))
            scores[path] = s
        best += max(scores, key=scores.get)
        z = sum(np.exp(v) for v in scores.values())
        for path, v in scores.items():
            for i, x in enumerate(path):
                marg[a + i, x] += np.exp(v) / z
    return np.array(best), marg


def test_messages_match_enumeration():
    rng = np.random.default_rng(1)
    for k in (2, 3):
        n = 60
        emit, trans, start = rng.normal(size=(n, k)) * 2, rng.normal(size=(k, k)), rng.normal(size=k)
        first = np.zeros(n, bool)
        first[[0, 1, 5, 11, 18, 20, 27, 33, 40, 46, 52, 59]] = True
        best, marg = brute(emit, trans, start, first)
        assert np.allclose(marginals(emit, trans, start, first), marg)
        assert (viterbi(emit, trans, start, first) == best).all()
    assert len(viterbi(np.zeros((0, 3)), np.zeros((3, 3)), np.zeros(3), np.zeros(0, bool))) == 0


def test_training_learns_context():
    """State 1 follows feature 0; feature 1 alone says nothing."""
    rng = np.random.default_rng(2)
    cue = rng.random((200, 12)) < 0.2
    states = np.zeros((200, 12), int)
    states[:, 1:] = cue[:, :-1]
    feats = np.where(cue, 0, 1)[:, :, None]
    w, t, s = train(np.concatenate([feats, np.concatenate([np.full((200, 1, 1), -1), feats[:, :-1] + 2], axis=1)], axis=2), states, np.ones((200, 12), bool), 4, 2)
    assert w[2, 1] - w[2, 0] > 2 > w[3, 1] - w[3, 0]
