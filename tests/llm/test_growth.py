"""What operators do once for each distinct thing, and not for each occurrence."""

import math

import numpy as np

from vertexloom.llm import toxicity


def test_plain_words_are_weighed_once(monkeypatch):
    rng = np.random.default_rng(5)
    lm = np.log(rng.dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE))).astype(np.float32)
    weights = {"idiot": 2.0, "^mora": 1.5, "bad": 1.2, "assess": 1.7}
    tokens = ["plain", "words", "grün", "idiot", "1d1ot", "moral", "moralist", "bad", "baad", "asses", "don't", "12", "...", "x-y", "sooo", "а", "i d i o t", "(bad)"]
    text = " ".join(rng.choice(tokens, 400))
    beginnings = lambda w: [w, *("^" + w[:k] for k in range(4, min(len(w), 8)))]
    lexicon, hits, seen, n = toxicity.Lexicon(weights), [], {}, 0
    for w in toxicity.words_of(text, lm, {}):
        n += 1
        x = lexicon.weigh(w) if w[0] == "~" else max(weights.get(f, 0.0) for f in beginnings(w)) or {"idiot": 2.0, "ases": 1.7}.get(toxicity.RUN.sub(r"\1", w), 0.0)
        if x:
            hits.append(x)
            seen[w] = x
    top = sorted(seen.values(), reverse=True)[:2]
    want = [1.0, *top, math.log1p(len(hits)), math.log1p(len(seen)), 100 * len(hits) / (n + 20)]
    assert len(hits) > 50 and toxicity.Lexicon(weights).vector(text, lm) == want
    weighed, weigh = [], toxicity.Lexicon.weigh
    monkeypatch.setattr(toxicity.Lexicon, "weigh", lambda self, w: weighed.append(w) or weigh(self, w))
    toxicity.Lexicon(weights).vector("plain words " * 1000, lm)
    assert sorted(weighed) == ["plain", "words"]
