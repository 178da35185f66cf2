"""The tagger: decoding against brute force, gradients, held-out accuracy, masking."""

import itertools
from pathlib import Path

import numpy as np
import pytest

from vellum.llm import pii, pii_train
from vellum.llm.pii_labels import spans


def test_decoding_is_exact():
    rng = np.random.default_rng(0)
    w = pii_train.start(3, 3, rng)
    for k in ("leave", "enter", "begin", "go"):
        w[k] = rng.normal(size=w[k].shape).astype(np.float32)
    m, trans = pii.Model(w), pii_train.transitions(w)
    e = rng.normal(size=(4, len(pii.TAGS), 3)).astype(np.float32)
    got = m.viterbi(e, np.array([4, 4, 2]))
    for r, n in enumerate((4, 4, 2)):
        best = max(itertools.product(range(len(pii.TAGS)), repeat=n), key=lambda t: w["S"][t[0]] + sum(e[k, x, r] for k, x in enumerate(t)) + sum(trans[a, b] for a, b in itertools.pairwise(t)))
        assert tuple(got[r, :n]) == best


def test_a_step_does_no_needless_work(monkeypatch):
    """Scores against a plain network, row by row; rows that have ended take no work, and embeddings are looked up, not gates."""
    rng = np.random.default_rng(2)
    w, size = pii_train.start(6, 5, rng), np.array([1, 2, 5, 5, 40])
    for k in ("bo", "bf", "bb"):
        w[k] = rng.normal(size=w[k].shape).astype(np.float32)
    ids = np.zeros((len(size), size.max()), np.intp)
    for r, n in enumerate(size):
        ids[r, :n] = rng.integers(1, 60, n)
    done, m = {"tanh": 0, "take": 0}, pii.Model(w)
    for name in done:

        def counted(*args, f=getattr(np, name), name=name, **more):
            y = f(*args, **more)
            done[name] += y.size
            return y

        monkeypatch.setattr(np, name, counted)
    got = m.emissions(ids, size)
    monkeypatch.undo()
    h, wide, steps = m.hidden, w["E"].shape[1], 2 * (size.sum() + len(size))  # the step after a row's last one reads its scores
    assert done["tanh"] <= steps * 5 * h and done["take"] <= steps * wide
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for r, n in enumerate(size):
        want = np.tile(w["bo"].astype(float), (n, 1))
        for k, d in enumerate("fb"):
            state, cell = np.zeros(h), np.zeros(h)
            for t in range(n) if d == "f" else range(n - 1, -1, -1):
                i, f, o, q = (w["E"][ids[r, t]] @ w[f"W{d}"] + w[f"b{d}"] + state @ w[f"U{d}"]).reshape(4, h)
                cell = sigmoid(f) * cell + sigmoid(i) * np.tanh(q)
                state = sigmoid(o) * np.tanh(cell)
                want[t] += state @ w["Wo"][k * h : (k + 1) * h]
        assert np.allclose(got[:n, :, r], want, atol=1e-5)


def test_gradients():
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in pii_train.start(4, 3, rng).items()}
    x, y, size = rng.integers(1, 60, (3, 9)), np.zeros((3, 9), int), np.array([9, 7, 9])
    y[:, 2], y[:, 3:5] = 1, 2
    _, g = pii_train.step(w, x, y, size)
    for k, at in (("Wo", (1, 2)), ("leave", (0,)), ("go", (0,)), ("Uf", (1, 3)), ("Wb", (0, 2)), ("bb", (1,)), ("E", (x[0, 3], 1))):
        old, h = w[k][at], 1e-2
        two = []
        for s in (h, -h):
            w[k][at] = old + s
            two.append(pii_train.step(w, x, y, size)[0])
        w[k][at] = old
        assert abs((two[0] - two[1]) / (2 * h) - g[k][at]) < 2e-3


SAY = [
    "One chain against a rubric condenses near the end. Signed, Fenjorik Eldoby <feneldoby@leaf-desk.example>",
    "That loose copy repeats; Frau Tamey Marekker-Wenovar hat verglichen. Bitte an tival@nuskha.example schreiben.",
    "Reached on +999 75 555 0190 yesterday. ID no. 6924 5204 1874 The margin follows, in plainer words.",
    "Each excerpt abridges. 164 Lantern St.\n(0832) 555-0114\nWenik M. Branulin",
]


@pytest.mark.parametrize("text", SAY)
def test_finds(text):
    want = {(k, a) for k, a, _ in spans(text)}
    got = {(k, a) for k, a, _ in pii.occurrences([text])[0]}
    assert want and len(want & got) >= len(want) - 1 and len(got - want) <= 1


def test_held_out_accuracy():
    """Labels of texts; those of check_s the model was not trained on."""
    at = next(p for p in (Path(f"/root/testdata/{d}/documents.parquet") for d in ("check_s", "sf0.01")) if p.exists())
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(at, columns=["text"]).column("text").to_pylist()[:1500] if t]
    right = missed = wrong = 0
    for t, got in zip(texts, pii.occurrences(texts), strict=True):
        want, got = {(k, a) for k, a, _ in spans(t)}, {(k, a) for k, a, _ in got}
        right, missed, wrong = right + len(want & got), missed + len(want - got), wrong + len(got - want)
    assert right > 100 and right / (right + missed) > 0.93 and right / (right + wrong) > 0.93


def test_held_out_vocabulary():
    """Values, syllables, domains and frames that training never saw."""
    from vellum.llm.pii_train import held_out

    texts, spans_ = held_out(200, seed=5)
    right, missed = dict.fromkeys(pii.KINDS, 0), dict.fromkeys(pii.KINDS, 0)
    for want, got in zip(spans_, pii.occurrences(list(texts)), strict=True):
        found = {(k, a) for k, a, _ in got}
        for k, a, _ in want:
            (right if (k, a) in found else missed)[k] += 1
    recall = {k: right[k] / (right[k] + missed[k]) for k in pii.KINDS}
    # names of unknown syllables without a title are the hard kind; README has the figures
    assert all(recall[k] > b for k, b in (("email", 0.9), ("address", 0.9), ("idnum", 0.9), ("phone", 0.8), ("name", 0.6))), recall


@pytest.mark.parametrize(("text", "want"), [("Call me at +1 415 212 7788 tomorrow.", ["+1 415 212 7788"]), ("Write to john.smith@gmail.com please.", ["john.smith@gmail.com"]), ("William Thompson lives at 221 Elm Avenue.", ["William Thompson", "221 Elm Avenue"]), ("Maria Gonzalez works here.", ["Maria Gonzalez"]), ("Please ask (sarah.miller@company.com).", ["sarah.miller@company.com"]), ("My name is Peter Johnson and I live at 12 Baker Street.", ["Peter Johnson", "12 Baker Street"])])
def test_ordinary_sentences(text, want):
    assert [text[a:b] for _, a, b in pii.occurrences([text])[0]] == want


def test_long_text_windows_agree():
    text = "The quire omits a verse in the margin only. " * 60
    at = [300, 610, 1190, 2000]
    for k in reversed(at):
        text = text[:k] + " Write to veskamet@nuskha.example about it. " + text[k:]
    got = [a for k, a, _ in pii.occurrences([text])[0] if k == "email"]
    assert got == [i for i in range(len(text)) if text.startswith("veskamet", i)]


def test_find_and_redact(spark):
    t = SAY[0]
    df = spark.createDataFrame([(1, t, "x"), (2, None, ""), (3, "", ""), (4, "   ", ""), (5, t, ""), (5, t, ""), (6, "​퟿", "")], "doc_id bigint, text string, kind string")
    n = len(pii.occurrences([t])[0])
    assert pii.find(df).count() == 3 * n and pii.find(df.filter("false")).count() == 0
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert "[EMAIL]" in out[1] and "@" not in out[1] and out[2] is None and out[3] == "" and out[4] == "   "
    assert pii.mask("ab cd", [("name", 3, 5)]) == "ab [NAME]"
