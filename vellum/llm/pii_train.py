"""Training of the personal-information model in NumPy: ``python -m vellum.llm.pii_train DOCUMENTS.parquet OUT.npz``.

The model is fitted on a bounded sample of texts whose spans ``pii_labels`` marks (at most ``most_docs`` documents, all windows
that hold a span and the share ``negatives`` of the others) and on ``made`` texts with values of open vocabularies (``pii_synth``). The loss is the CRF's negative log-likelihood; its gradient comes
from the forward-backward marginals and goes back through time in both directions. Adam with a cosine schedule.
"""

from __future__ import annotations

import itertools
import re
import sys
import time

import numpy as np

from vellum.llm.pii import ALPHABET, KINDS, TAGS, Model, classes, found
from vellum.llm.pii_labels import _ARABIC, _FIRST_END, _FORE, _LAST_END, spans
from vellum.llm.pii_synth import Maker

LENGTH = 224
FORBIDDEN = -100.0


_ARABIC_WORD, _NAME_WORD = re.compile("[ء-ي]{2,}"), re.compile("[A-Za-z]{3,}|[ء-ي]{4,}")
_LETTERS = "ابتثجحخدذرزسشصضطظعغفقكلمنهويةأإئ"
_LATIN = [a + b for a in "bcdfghjklmnprstvwyz" for b in ("an", "el", "ir", "os", "un", "a", "e", "i", "o", "ar", "en", "ol")]


def _word(rng, arabic: bool, upper: bool) -> str:
    """A name of syllables, known ones or others."""
    if arabic:
        pool = _ARABIC if rng.random() < 0.95 else [a + b for a in _LETTERS[1:28] for b in "اين"]
        return "".join(rng.choice(pool, int(rng.integers(2, 4)))) + str(rng.choice(["", "ن", "ي", "ان", "ين", "ون", "ا"]))
    known = rng.random() < 0.85
    pool = [x.lower() for x in _FORE] if known else _LATIN
    end = _LAST_END if rng.random() < 0.5 else _FIRST_END
    w = "".join(rng.choice(pool, int(rng.integers(1, 3)))) + (str(rng.choice(end)) if known else str(rng.choice(["", "s", "n", "son", "berg", "ic", "er"])))
    return w.upper() if upper else w.capitalize()


def varied(text: str, rng) -> tuple[str, list[tuple[str, int, int]]]:
    """A text with other names, digits and Arabic words around, and its spans there."""
    filler = rng.random() < 0.5
    out, found_, at, pos = [], [], 0, 0

    def put(s):
        nonlocal pos
        out.append(s)
        pos += len(s)

    def gap(s):
        # words near a span are its context and stay
        near = 18
        if filler and len(s) > 2 * near:
            mid = _ARABIC_WORD.sub(lambda m: "".join(rng.choice(list(_LETTERS), int(rng.integers(2, 10)))) if rng.random() < 0.5 else m.group(), s[near:-near])
            s = s[:near] + mid + s[-near:]
        put(s)

    maker = Maker(rng)
    for kind, a, b in spans(text):
        gap(text[at:a])
        s = text[a:b]
        maker.arabic = bool(_ARABIC_WORD.search(s))
        if rng.random() < 0.4:
            s = getattr(maker, kind)()
        elif kind == "name" and rng.random() < 0.5:
            s = _NAME_WORD.sub(lambda m: _word(rng, m.group()[0] >= "ء", m.group().isupper()), s)
        elif kind == "idnum":
            s = re.sub("[0-9]", lambda m: str(rng.integers(0, 10)), s)
        found_.append((kind, pos, pos + len(s)))
        put(s)
        at = b
    gap(text[at:])
    done = "".join(out)
    up = done.upper()
    return (up if rng.random() < 0.05 and len(up) == len(done) else done), found_


def labelled(text: str, known: list[tuple[str, int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a text's characters and their tags."""
    ids, at = classes(text)
    tags = np.zeros(len(ids), np.int64)
    for kind, a, b in spans(text) if known is None else known:
        x, y = np.searchsorted(at, a), np.searchsorted(at, b)
        k = 1 + 2 * KINDS.index(kind)
        tags[x:y] = k + 1
        tags[x] = k
    return ids.astype(np.int64), tags


def windows(texts, negatives: float, rng, copies: int, made: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded training windows (ids, tags, size) of the texts, of ``copies`` variations of each and of ``made`` made-up ones."""
    rows, maker = [], Maker(rng)
    own = ((t, None) if not k else varied(t, rng) for t in texts for k in range(copies + 1))
    for t, known in itertools.chain(own, (maker.document() for _ in range(made))):
        ids, tags = labelled(t, known)
        for a in range(-int(rng.integers(0, LENGTH // 2)), len(ids), LENGTH * 3 // 4):
            lo, hi = max(0, a), min(len(ids), a + LENGTH)
            if hi - lo >= 8 and (tags[lo:hi].any() or rng.random() < negatives):
                # a span that the window's start cuts is left out of it
                while lo < hi and tags[lo] and tags[lo] % 2 == 0:
                    lo += 1
                if hi > lo:
                    rows.append((ids[lo:hi], tags[lo:hi]))
    size = np.array([len(r[0]) for r in rows])
    x, y = (np.zeros((len(rows), LENGTH), np.int64) for _ in range(2))
    for i, (a, b) in enumerate(rows):
        x[i, : len(a)], y[i, : len(b)] = a, b
    return x, y, size


def start(hidden: int, embed: int, rng) -> dict[str, np.ndarray]:
    w = {"E": rng.normal(0, 0.3, (ALPHABET, embed)), "Wo": rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, len(TAGS))), "bo": np.zeros(len(TAGS)), "leave": np.zeros(len(TAGS)), "enter": np.zeros(1 + len(KINDS)), "begin": np.zeros(len(KINDS)), "go": np.zeros(len(KINDS)), "S": np.zeros(len(TAGS))}
    for d in "fb":
        w[f"W{d}"] = rng.normal(0, 1 / np.sqrt(embed), (embed, 4 * hidden))
        w[f"U{d}"] = np.concatenate([np.linalg.qr(rng.normal(size=(hidden, hidden)))[0] for _ in range(4)], 1)
        w[f"b{d}"] = np.zeros(4 * hidden)
        w[f"b{d}"][hidden : 2 * hidden] = 1
    w["S"][2::2] = FORBIDDEN  # no text starts inside a span
    return {k: v.astype(np.float32) for k, v in w.items()}


_OUT = [0, *range(1, len(TAGS), 2)]  # O and the B tags


def transitions(w) -> np.ndarray:
    """The full matrix (from, to) of the structured transitions."""
    t = np.full((len(TAGS),) * 2, FORBIDDEN, w["S"].dtype)
    t[:, _OUT] = w["leave"][:, None] + w["enter"][None, :]
    for k in range(len(KINDS)):
        t[1 + 2 * k, 2 + 2 * k], t[2 + 2 * k, 2 + 2 * k] = w["begin"][k], w["go"][k]
    return t


def _sig(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(proj, u):
    """States of one direction over (time, row, gates) inputs, with what the way back needs."""
    time_, rows, h4 = proj.shape
    n = h4 // 4
    h, c = np.zeros((time_ + 1, rows, n), np.float32), np.zeros((time_ + 1, rows, n), np.float32)
    gates, tc = np.empty_like(proj), np.empty((time_, rows, n), np.float32)
    for t in range(time_):
        z = proj[t] + h[t] @ u
        g = gates[t]
        g[:, : 3 * n] = _sig(z[:, : 3 * n])
        g[:, 3 * n :] = np.tanh(z[:, 3 * n :])
        c[t + 1] = g[:, n : 2 * n] * c[t] + g[:, :n] * g[:, 3 * n :]
        tc[t] = np.tanh(c[t + 1])
        h[t + 1] = g[:, 2 * n : 3 * n] * tc[t]
    return h, c, gates, tc


def lstm_back(dh_out, u, h, c, gates, tc):
    """Gradients of the gates' inputs and of ``u``."""
    time_, rows, n = dh_out.shape
    dz = np.empty_like(gates)
    dh, dc = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
    for t in range(time_ - 1, -1, -1):
        g = gates[t]
        i, f, o, q = (g[:, k * n : (k + 1) * n] for k in range(4))
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc[t] ** 2)
        z = dz[t]
        z[:, :n] = dc * q * i * (1 - i)
        z[:, n : 2 * n] = dc * c[t] * f * (1 - f)
        z[:, 2 * n : 3 * n] = dh * tc[t] * o * (1 - o)
        z[:, 3 * n :] = dc * i * (1 - q**2)
        dc = dc * f
        dh = z @ u.T
    return dz, h[:-1].reshape(-1, n).T @ dz.reshape(-1, 4 * n)


def crf(e, y, size, trans, begin):
    """Loss and gradients (emissions, transitions, begin) of (time, row, tag) emissions."""
    time_, rows, k = e.shape
    tt, line = np.exp(trans), np.arange(rows)
    top = e.max(2, keepdims=True)
    ee = np.exp(e - top)
    alive = np.arange(time_)[:, None] < size[None, :]
    a, scale = np.empty_like(e), np.ones((time_, rows))
    a[0] = ee[0] * np.exp(begin)
    for t in range(time_):
        if t:
            a[t] = (a[t - 1] @ tt) * ee[t]
        scale[t] = a[t].sum(1)
        a[t] /= scale[t][:, None]
    b = np.ones_like(e)
    for t in range(time_ - 2, -1, -1):
        nxt = (ee[t + 1] * b[t + 1]) @ tt.T
        b[t] = np.where((t + 1 < size)[:, None], nxt / nxt.sum(1, keepdims=True), 1)
    gamma = a * b
    gamma /= gamma.sum(2, keepdims=True)
    eb = ee[1:] * b[1:]
    norm = ((a[:-1] @ tt) * eb).sum(2)
    inside = alive[1:]
    xi = (a[:-1][inside] / norm[inside][:, None]).T @ eb[inside] * tt
    logz = ((np.log(scale) + top[:, :, 0]) * alive).sum()
    gold = (np.take_along_axis(e, y[:, :, None], 2)[:, :, 0] * alive).sum() + begin[y[0]].sum() + (trans[y[:-1], y[1:]] * inside).sum()
    de = gamma * alive[:, :, None]
    t_, r_ = np.nonzero(alive)
    de[t_, r_, y[t_, r_]] -= 1
    dt = xi
    np.subtract.at(dt, (y[:-1][inside], y[1:][inside]), 1)
    ds = gamma[0].sum(0)
    np.subtract.at(ds, y[0][line], 1)
    return (logz - gold) / rows, de / rows, dt / rows, ds / rows


def step(w, x, y, size):
    """Loss and gradients of a batch (row, time)."""
    rows, time_ = x.shape
    n = w["Uf"].shape[0]
    back = np.where(np.arange(time_)[None] < size[:, None], size[:, None] - 1 - np.arange(time_)[None], np.arange(time_)[None])
    orders = {"f": np.broadcast_to(np.arange(time_), x.shape), "b": back}
    out, kept = [], {}
    for d in "fb":
        ids = np.take_along_axis(x, orders[d], 1).T
        table = w["E"] @ w[f"W{d}"] + w[f"b{d}"]
        kept[d] = (ids, *lstm(table[ids], w[f"U{d}"]))
        out.append(np.take_along_axis(kept[d][1][1:], orders[d].T[:, :, None], 0))
    hid = np.concatenate(out, 2)
    e = hid @ w["Wo"] + w["bo"]
    loss, de, dt, ds = crf(e, y.T, size, transitions(w), w["S"])
    de = de.astype(np.float32)
    g = {"Wo": hid.reshape(-1, 2 * n).T @ de.reshape(-1, len(TAGS)), "bo": de.sum((0, 1)), "S": ds * (w["S"] > FORBIDDEN / 2), "leave": dt[:, _OUT].sum(1), "enter": dt[:, _OUT].sum(0), "begin": np.diagonal(dt, 1)[1::2].copy(), "go": np.diagonal(dt)[2::2].copy(), "E": np.zeros_like(w["E"])}
    dh = de @ w["Wo"].T
    for k, d in enumerate("fb"):
        ids, h, c, gates, tc = kept[d]
        part = np.take_along_axis(dh[:, :, k * n : (k + 1) * n], orders[d].T[:, :, None], 0)
        dz, g[f"U{d}"] = lstm_back(part, w[f"U{d}"], h, c, gates, tc)
        by_char = np.zeros((ALPHABET, 4 * n), np.float32)
        flat, zs = ids.reshape(-1), dz.reshape(-1, 4 * n)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        by_char[flat[order][first]] = np.add.reduceat(zs[order], first, 0)
        g[f"b{d}"] = by_char.sum(0)
        g[f"W{d}"] = w["E"].T @ by_char
        g["E"] += by_char @ w[f"W{d}"].T
    return loss, g


def train(texts, hidden=24, embed=16, epochs=24, batch=96, rate=8e-3, negatives=0.12, copies=3, seed=1, minutes=1e9, made=0, warm=None, log=print, save=None):
    """Weights fitted to ``texts``, from random ones or from the dict ``warm``. Training ends after ``epochs``, or by the schedule earlier if ``minutes`` run out."""
    rng = np.random.default_rng(seed)
    x, y, size = windows(texts, negatives, rng, copies, made)
    w = {k: v.copy() for k, v in warm.items()} if warm else start(hidden, embed, rng)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    log(f"{len(x)} windows, {(y > 0).any(1).sum()} with spans")
    began, t, total = time.time(), 0, epochs * -(-len(x) // batch)
    for epoch in range(epochs):
        order, losses = rng.permutation(len(x)), []
        for k in range(0, len(x), batch):
            part = order[k : k + batch]
            most = size[part].max()
            loss, g = step(w, x[part, :most], y[part, :most], size[part])
            losses.append(loss)
            norm = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
            t += 1
            done = max(t / total, (time.time() - began) / 60 / minutes)
            lr = rate * (0.02 + 0.98 * 0.5 * (1 + np.cos(np.pi * min(1, done))))
            for name, a in g.items():
                a = a * min(1, 5 / (norm + 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * a
                v[name] = 0.99 * v[name] + 0.01 * a**2
                w[name] = (w[name] - lr * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        log(f"epoch {epoch}: loss {np.mean(losses):.4f}, {time.time() - began:.0f} s")
        if save:
            np.savez_compressed(save, **w)
        if (time.time() - began) / 60 > minutes:
            break
    return w


def score(w, texts, known=None) -> dict[str, tuple[int, int, int]]:
    """By kind: (right, missed, wrong) starts against the labels, or against ``known`` spans of each text."""
    read = [classes(t) for t in texts]
    tags = Model(w).tag([r[0] for r in read])
    out = {k: [0, 0, 0] for k in KINDS}
    for t, g, (ids, at), own in zip(texts, tags, read, known or [None] * len(texts), strict=True):
        want = {(k, a) for k, a, _ in (spans(t) if own is None else own)}
        got = {(KINDS[k], int(at[a])) for k, a, _ in found(g, ids)} if len(ids) else set()
        for j, s in enumerate((want & got, want - got, got - want)):
            for k, _ in s:
                out[k][j] += 1
    return {k: tuple(v) for k, v in out.items()}


def main(source: str, target: str, most_docs: int = 12_000, warm: str | None = None, **how) -> None:
    import pyarrow.parquet as pq

    if warm:
        with np.load(warm) as z:
            how["warm"] = {k: z[k] for k in z.files}

    texts = [t for t in pq.read_table(source, columns=["text"]).column("text").to_pylist()[:most_docs] if t]
    cut = len(texts) * 9 // 10
    w = train(texts[:cut], save=target, log=lambda s: print(s, flush=True), **how)
    np.savez_compressed(target, **w)
    print("held out:", score(w, texts[cut:]))
    print("held-out vocabulary:", score(w, *held_out()))


def held_out(n: int = 400, seed: int = 77) -> tuple[list[str], list[list[tuple[str, int, int]]]]:
    """Texts with values and frames that training never sees, and their spans."""
    maker = Maker(np.random.default_rng(seed), held=True)
    return tuple(zip(*(maker.document() for _ in range(n)), strict=True))


if __name__ == "__main__":
    main(*sys.argv[1:3], **{k: v if k == "warm" else float(v) if "." in v else int(v) for k, v in (a.split("=") for a in sys.argv[3:])})
