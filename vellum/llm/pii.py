"""Problem 10: personal information in free text, by a character-level bidirectional LSTM with CRF transitions.

Characters are folded to a small alphabet (width, look-alikes and numeral systems make no difference; invisible characters are
skipped, their places kept), cut into overlapping windows, run through the network in batches sorted by length, decoded by
Viterbi, and the windows' tags are joined so that each character takes the tag of the window in whose middle it lies. The
weights are trained by ``pii_train`` in NumPy and stored beside this file.
"""

from __future__ import annotations

import functools
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.lookalike import LATIN_TWINS, TABLE

KINDS = ["email", "phone", "idnum", "address", "name"]
TAGS = ["O"] + [f"{x}-{k}" for k in KINDS for x in "BI"]
#: Windows have at most WINDOW characters and share OVERLAP with the next.
WINDOW, OVERLAP, BATCH = 1280, 64, 512
#: Characters of the alphabet; all others fall into the classes after them. The first stands for padding.
_CHARS = "\0 \n!\"'()*+,-./:;<>?@[]_&#%=0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyzءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي،؛؟ßäöüÄÖÜéèàçêôîûâÉ—–…«»°’"
_MARKED_LOW, _MARKED_UP, _LETTER, _OTHER = (len(_CHARS) + i for i in range(4))
ALPHABET = len(_CHARS) + 4
DROPPED = 255


@functools.cache
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane: its class (DROPPED if it doesn't show) and the code point it is folded to."""
    index = {c: i for i, c in enumerate(_CHARS)}
    klass, to = np.full(0x10000, _OTHER, np.uint8), np.arange(0x10000, dtype=np.uint32)
    for cp in range(1, 0x10000):
        c = chr(cp)
        s = TABLE.get(cp, c)
        if c in "\n\r":
            s = "\n"
        if s is None or unicodedata.category(c).startswith("M") or c == "ـ":
            klass[cp] = DROPPED
            continue
        s = s[0]
        s = LATIN_TWINS.get(s, s)
        d = unicodedata.decimal(s, None)
        s = str(d) if d is not None else {"ی": "ي", "ک": "ك", "“": '"', "”": '"', "‘": "'"}.get(s, s)
        to[cp] = ord(s)
        kind = unicodedata.category(s)
        klass[cp] = index.get(s, _MARKED_LOW if kind == "Ll" or s in "ʿʾ" else _MARKED_UP if kind == "Lu" else _LETTER if kind[0] == "L" else _OTHER)
    return klass, to


def _points(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(x < 0x10000, x, 0x25A1)


def fold(text: str) -> tuple[str, np.ndarray]:
    """The folded text without what doesn't show, and the place of each of its characters in the raw text."""
    klass, to = _fold()
    x = _points(text)
    at = np.flatnonzero(klass[x] != DROPPED)
    return to[x[at]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), at


def classes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The class of each character that shows, and its place in the raw text."""
    k = _fold()[0][_points(text)]
    at = np.flatnonzero(k != DROPPED)
    return k[at], at


class Model:
    """Weights of the network: E the characters' embeddings; per direction W, U, b with the gates input, forget, output,
    candidate; Wo, bo the emissions; the transitions leave[p] + enter[q] from any tag to O or a B tag, and begin[k], go[k] from
    B and I to I of one kind."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        h = self.hidden = weights["Uf"].shape[0]
        half = np.ones(4 * h, np.float32)
        half[: 3 * h] = 0.5  # a sigmoid is a tanh of half its argument, plus one, halved
        self.embed = np.ascontiguousarray(weights["E"].T, np.float32)
        self.step = []
        for k, d in enumerate("fb"):  # by (twice the state, embedding, 1): a step's gates, and the emissions of the step before
            gates = np.vstack([0.5 * weights[f"U{d}"], weights[f"W{d}"], weights[f"b{d}"][None]]) * half
            out = np.vstack([0.5 * weights["Wo"][k * h : (k + 1) * h], np.zeros((len(self.embed), len(TAGS))), weights["bo"][None] * (k == 0)])
            self.step.append(np.ascontiguousarray(np.hstack([gates, out]).T.astype(np.float32)))

    @classmethod
    def load(cls, path: str | Path | None = None) -> Model:
        with np.load(path or Path(__file__).with_name("pii_model.npz")) as z:
            return cls({k: z[k] for k in z.files})

    def emissions(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Scores (time, tag, row) of padded windows ``ids`` (row, time), sorted by size; a step leaves out rows that have ended."""
        rows, time = ids.shape
        n, m = self.hidden, self.hidden + len(self.embed)
        out = np.zeros((time, len(TAGS), rows), np.float32)
        x = np.ascontiguousarray(ids.T)
        ended = np.searchsorted(size, np.arange(time), "right").tolist()  # so many rows have ended before each step
        whole, cell = np.empty((4 * n + len(TAGS), rows), np.float32), np.empty((n, rows), np.float32)
        for d in (0, 1):
            step, state = self.step[d], np.zeros((m + 1, rows), np.float32)
            state[m], cell[:] = 1, 0
            at, before, left_out = (range(time), -1, -1) if d == 0 else (range(time - 1, -1, -1), time, -1)
            for k in at:
                a = ended[k if d else max(k - 1, 0)]
                if a != left_out:
                    left_out, live, c, z = a, state[:, a:], cell[:, a:], whole[:, a:]
                    h, seen, gate, sigmoid, score = live[:n], live[n:m], z[: 4 * n], z[: 3 * n], z[4 * n :]
                    i, f, o, q = gate.reshape(4, n, -1)
                np.take(self.embed, x[k, a:], axis=1, out=seen, mode="clip")
                np.matmul(step, live, out=z)
                if 0 <= before < time:
                    out[before, :, a:] += score
                np.tanh(gate, out=gate)
                sigmoid += 1
                c *= f
                i *= q
                c += i
                c *= 0.5
                np.tanh(c, out=h)
                h *= o
                before = k
            out[before] += step[4 * n :] @ state
        return out

    def viterbi(self, e: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best tags (row, time). As O and B tags follow any tag at a price of two parts, one maximum serves all of them."""
        time, _, rows = e.shape
        leave, enter = self.w["leave"][:, None], self.w["enter"][:, None]
        on = np.stack([self.w["begin"], self.w["go"]], 1).reshape(-1, 1)
        came, stay = np.zeros((time, rows), np.uint8), np.zeros((time, len(KINDS), rows), bool)
        score = np.full((len(TAGS), rows), -1e4, np.float32)
        score[0] = self.w["S"][0] + e[0, 0]
        score[1::2] = self.w["S"][1::2, None] + e[0, 1::2]
        left, kept, top = np.empty_like(score), np.empty_like(score[1:]), np.empty_like(score[0])
        final, last, shortest = np.zeros(rows, np.uint8), size - 1, int(size.min())
        ends = [()] * time
        for n in np.unique(last):
            ends[n] = np.flatnonzero(last == n)
        for k in range(time):
            if k:
                np.add(score, leave, out=left)
                left.max(0, out=top)
                other = (top > left[0]).nonzero()[0]  # few rows; the rest came from O
                if len(other):
                    came[k, other] = left[:, other].argmax(0)
                if k >= shortest:
                    came[k, last < k] = 0
                np.add(score[1:], on, out=kept)
                a, b = kept[::2], kept[1::2]
                np.greater(b, a, out=stay[k])
                np.maximum(a, b, out=score[2::2])
                np.add(top, enter[0], out=score[0])
                np.add(top, enter[1:], out=score[1::2])
                score += e[k]
            if len(ends[k]):
                final[ends[k]] = score[:, ends[k]].argmax(0)
        tags, tag = np.zeros((time, rows), np.uint8), np.zeros(rows, np.uint8)
        for k in range(time - 1, -1, -1):
            if len(ends[k]):
                tag[ends[k]] = final[ends[k]]
            tags[k] = tag
            if k:
                marked = tag.nonzero()[0]
                at = tag[marked]
                tag = came[k].copy()
                if len(marked):
                    inside = at % 2 == 0
                    marked, at = marked[inside], at[inside]
                    tag[marked] = np.where(stay[k, at // 2 - 1, marked], at, at - 1)
        return np.ascontiguousarray(tags.T)

    def tag(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        """The tags of the characters of each document."""
        where, step = [], WINDOW - OVERLAP
        for i, d in enumerate(docs):
            for a in range(0, max(1, len(d) - OVERLAP), step):
                where.append((min(len(d) - a, WINDOW), i, a))
        where.sort()
        out = [np.zeros(len(d), np.uint8) for d in docs]
        for k in range(0, len(where), BATCH):
            part = [w for w in where[k : k + BATCH] if w[0]]
            if not part:
                continue
            size = np.array([w[0] for w in part])
            ids = np.zeros((len(part), size.max()), np.intp)
            for r, (n, i, a) in enumerate(part):
                ids[r, :n] = docs[i][a : a + n]
            tags = self.viterbi(self.emissions(ids, size), size)
            for r, (n, i, a) in enumerate(part):
                lo = a + OVERLAP // 2 if a else 0
                hi = a + n if a + n >= len(docs[i]) else a + n - OVERLAP // 2
                out[i][lo:hi] = tags[r, lo - a : hi - a]
        return out


def found(tags: np.ndarray, k: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the tagged runs. A run of one kind that is broken by a blank, or opens with I, is one span; blanks
    at its ends are left out."""
    if not tags.any():
        return []
    kind = (tags + 1) // 2
    begin = (tags % 2 == 1) & (tags > 0)
    edge = np.flatnonzero((kind[1:] != kind[:-1]) | begin[1:]) + 1
    out = []
    for a, b in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(kind)]]), strict=True):
        if a < b and kind[a]:
            while a < b and k[a] in (1, 2):
                a += 1
            while b > a and k[b - 1] in (1, 2):
                b -= 1
            if b > a:
                out.append((int(kind[a]) - 1, int(a), int(b)))
    return out


_MODEL: list[Model] = []


def _model() -> Model:
    if not _MODEL:
        _MODEL.append(Model.load())
    return _MODEL[0]


def occurrences(texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in characters of the raw text, for each text."""
    read = [classes(t or "") for t in texts]
    return [[(KINDS[k], int(at[a]), int(at[b - 1]) + 1) for k, a, b in found(tags, ids)] if len(ids) else [] for tags, (ids, at) in zip(_model().tag([r[0] for r in read]), read, strict=True)]


def _spans(batches):
    for batch in batches:
        row, kind, start, end = [], [], [], []
        for i, spans in enumerate(occurrences(batch.column("text").to_pylist())):
            for k, a, b in spans:
                row.append(i), kind.append(k), start.append(a), end.append(b)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "kind", "start_pos", "end_pos"])


def find(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, start_pos, end_pos) of each occurrence in each text, positions in Unicode characters of the raw text.

    Null and empty texts hold none. Texts of any length are read whole. Nothing is shuffled.
    """
    return documents.select(F.col("doc_id").cast("bigint"), "text").filter("text is not null and text <> ''").mapInArrow(_spans, "doc_id bigint, kind string, start_pos bigint, end_pos bigint")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by a placeholder of its kind."""
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _masked(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        done = [mask(t, s) if t else t for t, s in zip(texts, occurrences(texts), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(done, pa.string())], names=["doc_id", "text"])


def redact(documents: DataFrame) -> DataFrame:
    """(doc_id, text) with each occurrence replaced by [EMAIL], [PHONE], [IDNUM], [ADDRESS] or [NAME]; null stays null."""
    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_masked, "doc_id bigint, text string")
