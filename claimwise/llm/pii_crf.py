"""Operator 4: personal data by base patterns and a linear-chain conditional
random field over word shapes.

Base kinds (email, ip, card, phone) are matched in every whole text, leftmost
and not overlapping, and failing matches are dropped.  (A linear RE2 scan of
the Arrow batch picks the documents that can match.)

The CRF labels every word O, EMAIL, IP, CARD or PHONE.  A word's shape is a
number from its byte classes (digits, upper case, '@', '.', '-', '+', other
signs, length steps); features are the shapes of the word and of its two
neighbours, so emissions are three table look-ups.  It is trained by gradient steps
(Adam on forward-backward expectations, numpy) on a small labelled table: all
lines with a digit or '@' of at most ``TRAIN_DOCS`` documents of the given table, those with the smallest
seeded hash of doc_id among those with and without matches, labelled by the
base spans that cover their words (O where none does), plus
the lines with matches with separators of numbers changed, so that shapes which the
patterns don't know are seen too.  Only the fit is bounded.

Decoding reads every document whole: words are cut into lines, and Viterbi runs
for all lines of a batch at once, one step a word.  Lines without any digit or
'@' can only be O and are passed over.  Words that a base span of their label's
kind touches are taken out; each run of the others with one label adds a span
of kind ``crf_<kind>``.

Offsets are code points, ends exclusive.  Defined cases.  Null or empty text has
no spans; null doc_ids and repeated rows are scanned like others; without any
match to learn from the CRF adds nothing; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, chunks, read, word_spans, written

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CAN = (r"@[A-Za-z0-9-]+\.", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){13}", r"\+[0-9][\x20().0-9-]+[0-9]")

DECODED = re.compile("[0-9@]")
TRAIN_DOCS = 2000          # documents of the labelled table, at most
LONGEST = 20_000           # and their length
STEPS, RATE, RIDGE = 120, 0.3, 1e-4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def byte(digits: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def base_spans(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    found = []
    if "email" in kinds and "@" in text:
        found += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    if "ip" in kinds:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(byte(p) for p in m[0].split("."))]
    if "card" in kinds:
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() < 40 else m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "phone" in kinds:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


# ---- shapes ---------------------------------------------------------------------

CLASSES = [(np.arange(256) >= 48) & (np.arange(256) < 58)] + [np.isin(np.arange(256), [ord(c) for c in cs]) for cs in ("@", ".", "-", "+", "()")]
CLASSES.append(~(CLASSES[0] | (np.arange(256) > 127) | np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
                 | np.isin(np.arange(256), [ord(c) for c in "@.-+()"])))
STEP = np.array([0, 1, 2, 3, 4, 4, 5, 5, 5, 6, 6, 6, 6, 7, 7, 7, 7, 7, 7, 7])  # digits of a word, in steps
SHAPES = 8 * 2 * 4 * 3 * 2 * 2 * 2 * 2


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number below SHAPES for each word."""
    counts = []
    for table in CLASSES:
        c = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        counts.append(c[ends] - c[starts])
    digits, at, dots, dashes, plus, round_, other = counts
    code = STEP[np.minimum(digits, 19)]
    for value, most in ((at, 1), (dots, 3), (dashes, 2), (plus, 1), (round_, 1), (other, 1), (ends - starts - digits > 3, 1)):
        code = code * (most + 1) + np.minimum(value, most)
    return code.astype(np.int32)


class Crf:
    """Linear chain with label scores of the word's and its neighbours' shapes."""

    LABELS = 1 + len(KINDS)

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move          # (3, SHAPES + 1, labels), (labels + 1, labels); the last is the line's edge

    @classmethod
    def zero(cls) -> Crf:
        return cls(np.zeros((3, SHAPES + 1, cls.LABELS)), np.zeros((cls.LABELS + 1, cls.LABELS)))

    @staticmethod
    def neighbours(shape: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(3, words): the shape before, the own one, the one after; SHAPES at a line's edges."""
        before, after = np.full(len(shape), SHAPES, np.int32), np.full(len(shape), SHAPES, np.int32)
        before[1:], after[:-1] = shape[:-1], shape[1:]
        some = bounds[:-1] < bounds[1:]
        before[bounds[:-1][some]] = SHAPES
        after[bounds[1:][some] - 1] = SHAPES
        return np.stack([before, shape, after])

    def scores(self, near: np.ndarray) -> np.ndarray:
        return self.emit[0][near[0]] + self.emit[1][near[1]] + self.emit[2][near[2]]

    @staticmethod
    def steps(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each place in a line: the lines that long (longest first), and the words there."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        left = size[order]
        n = len(order)
        for t in range(int(left[0]) if n else 0):
            n = int(np.searchsorted(-left, -t, "left"))
            yield order[:n], bounds[:-1][order[:n]] + t

    def viterbi(self, near: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The best label of every word, all lines together."""
        s, k = self.scores(near), self.LABELS
        back = np.zeros((len(s), k), np.int8)
        best, seen = np.zeros((len(bounds) - 1, k)), []
        for t, (lines, at) in enumerate(self.steps(bounds)):
            if t == 0:
                best[lines] = s[at] + self.move[k]
            else:
                over = best[lines][:, :, None] + self.move[None, :k]
                back[at] = over.argmax(1)
                best[lines] = over.max(1) + s[at]
            seen.append((lines, at))
        label = np.zeros(len(s), np.int8)
        now = best.argmax(1)
        for t in range(len(seen) - 1, -1, -1):
            lines, at = seen[t]
            label[at] = now[lines]
            now[lines] = back[at, now[lines]]
        return label

    def learn(self, near: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> Crf:
        """Maximum likelihood by Adam, with forward-backward expectations."""
        k, n = self.LABELS, len(label)
        state = [(np.zeros_like(x), np.zeros_like(x)) for x in (self.emit, self.move)]
        seen = list(self.steps(bounds))
        for step in range(1, STEPS + 1):
            s = self.scores(near)
            alpha, move = np.zeros((n, k)), np.exp(self.move)
            scaled = np.exp(s - s.max(1, keepdims=True))
            for t, (_, at) in enumerate(seen):
                a = move[k][None, :] if t == 0 else alpha[at - 1] @ move[:k]
                a = a * scaled[at]
                alpha[at] = a / a.sum(1, keepdims=True)
            g_move, p, beta = np.zeros_like(self.move), np.zeros((n, k)), np.ones((n, k))
            for t in range(len(seen) - 1, -1, -1):
                _, at = seen[t]
                g = alpha[at] * beta[at]
                p[at] = g / g.sum(1, keepdims=True)
                if t:
                    right = scaled[at] * beta[at]
                    b = right @ move[:k].T
                    beta[at - 1] = b / b.sum(1, keepdims=True)
                    pair = alpha[at - 1][:, :, None] * move[None, :k] * right[:, None, :]
                    g_move[:k] += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                    np.add.at(g_move, (label[at - 1], label[at]), -1)
                else:
                    g_move[k] += p[at].sum(0)
                    np.add.at(g_move[k], label[at], -1)
            p[np.arange(n), label] -= 1
            g_emit = np.stack([np.stack([np.bincount(near[j], weights=p[:, c], minlength=SHAPES + 1) for c in range(k)], 1) for j in range(3)])
            for x, g, (m, v) in zip((self.emit, self.move), (g_emit / len(bounds) + RIDGE * self.emit, g_move / len(bounds) + RIDGE * self.move), state, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                x -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        return self


def lines_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (starts, ends) of the texts and the bounds of the lines that hold a digit or '@'."""
    starts, ends, _ = word_spans(data, off)
    edge = np.unique(np.concatenate([off, np.flatnonzero(data == 10) + 1]))
    bounds = np.searchsorted(starts, edge)
    can = np.concatenate([[0], np.cumsum(CLASSES[0][data] | CLASSES[1][data])])
    go = np.flatnonzero((can[edge[1:]] > can[edge[:-1]]) & (np.diff(bounds) > 0)) if len(edge) > 1 else np.zeros(0, np.int64)
    take = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in go]) if len(go) else np.zeros(0, np.int64)
    return starts[take], ends[take], np.concatenate([[0], np.cumsum(np.diff(bounds)[go])]).astype(np.int64)


def train(texts: list[str]) -> Crf | None:
    """A CRF from texts whose base spans are the labels; None without any."""
    data, label, at, lines = [], [], 0, [0]
    for text in texts:
        for line in text.split("\n"):
            if not DECODED.search(line):              # such lines are passed over when decoding, too
                continue
            spans = base_spans(line)
            variants = [line]
            if spans:
                variants.append("".join(_changed(line[a:b], k) if inside else line[a:b] for a, b, k, inside in _pieces(line, spans)))
            for v in variants:
                got = base_spans(line) if v is line else _same_places(line, v, spans)
                raw = v.encode()
                arr = np.frombuffer(raw, np.uint8)
                s, e, _ = word_spans(arr, np.array([0, len(arr)]))
                if not len(s):
                    continue
                y = np.zeros(len(s), np.int8)
                for a, k, b in got:
                    a, b = len(v[:a].encode()), len(v[:b].encode())
                    y[(e > a) & (s < b)] = k + 1
                data.append((arr, s, e))
                label.append(y)
                at += len(s)
                lines.append(at)
    if not label or not np.concatenate(label).any():
        return None
    shape = np.concatenate([shapes(*d) for d in data])
    bounds = np.array(lines)
    return Crf.zero().learn(Crf.neighbours(shape, bounds), bounds, np.concatenate(label))


def _pieces(line: str, spans: list) -> Iterator[tuple[int, int, int, bool]]:
    at = 0
    for a, k, b in spans:
        if a >= at:
            yield at, a, -1, False
            yield a, b, k, True
            at = b
    yield at, len(line), -1, False


def _changed(part: str, kind: int) -> str:
    """The same number with other separators, of the same length; mails and addresses stay."""
    return part if kind < 2 else part.replace("-", ".").replace(" ", "-")


def _same_places(line: str, other: str, spans: list) -> list:
    return spans if len(line) == len(other) else []


def _without_base(label: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray, off: np.ndarray, doc: int, base: list) -> None:
    """Words that a base span touches lose the label of its kind (in place)."""
    raw = data[off[doc]:off[doc + 1]]
    at = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw)) + off[doc]       # of each code point
    for s, k, e in base:
        words = label[np.searchsorted(ends, at[s], "right"):np.searchsorted(starts, at[e], "left")]
        words[words == k + 1] = 0


def _detect(model: Crf | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, off in chunks(batches):
            text = b.column("text")
            can = [pc.fill_null(pc.match_substring_regex(text, p), False).to_pylist() for p in CAN]
            extra: dict[int, list] = {}
            if model is not None:
                starts, ends, bounds = lines_of(data, off)
                if len(starts):
                    label = model.viterbi(Crf.neighbours(shapes(data, starts, ends), bounds), bounds)
                    line = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                    for doc in np.unique(np.searchsorted(off, starts[label > 0], "right") - 1).tolist():
                        _without_base(label, starts, ends, data, off, doc, base_spans(text[doc].as_py(), tuple(k for k, c in zip(KINDS, can, strict=True) if c[doc])))
                    some = np.flatnonzero(label)
                    cut = np.flatnonzero(np.concatenate([[len(some) > 0], (np.diff(some) > 1) | (np.diff(label[some]) != 0) | (np.diff(line[some]) != 0)]))
                    for i, j in zip(cut, np.append(cut[1:], len(some))):
                        doc = int(np.searchsorted(off, starts[some[i]], "right")) - 1
                        extra.setdefault(doc, []).append((int(starts[some[i]] - off[doc]), int(label[some[i]]) - 1, int(ends[some[j - 1]] - off[doc])))
            out = []
            for r in range(b.num_rows):
                kinds = tuple(k for k, c in zip(KINDS, can, strict=True) if c[r])
                if not kinds and r not in extra:
                    out.append((0, 0, 0, 0, EMPTY, "", 0))
                    continue
                t = text[r].as_py()
                base = base_spans(t, kinds)
                found = [(s, k, e, KINDS[k]) for s, k, e in base]
                line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in found)
                added = []
                raw = data[off[r]:off[r + 1]]
                for s, k, e in extra.get(r, ()):
                    s, e = (int((raw[:x] & 0xC0 != 0x80).sum()) for x in (s, e))
                    added.append((s, k + len(KINDS), e, "crf_" + KINDS[k]))
                every = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found + added))
                out.append((*(sum(k == i for _, k, _, _ in found) for i in range(4)), hashlib.sha256(line.encode()).hexdigest(), every, len(added)))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()),
                                              pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64())],
                                             names=["doc_id", *("n_" + k for k in KINDS), "base_sha256", "spans", "n_crf"])

    return run


EMPTY = hashlib.sha256(b"").hexdigest()


def _can_match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hit = np.zeros(b.num_rows, bool)
        for p in CAN:
            hit |= np.asarray(pc.fill_null(pc.match_substring_regex(b.column("text"), p), False))
        short = pc.fill_null(pc.less_equal(pc.utf8_length(b.column("text")), LONGEST), False)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").filter(short), pa.array(hit).filter(short)], names=["doc_id", "hit"])


def labelled_texts(docs: DataFrame, most: int = TRAIN_DOCS) -> list[str]:
    """The bounded labelled table: up to most / 2 texts with and without a base match."""
    ids = written(docs.mapInArrow(_can_match, "doc_id long, hit boolean").where("doc_id is not null")
                  .withColumn("h", F.xxhash64("doc_id", F.lit(11))), "pii-ids")
    some = ids.where("hit").orderBy("h").limit(most // 2).unionByName(ids.where("not hit").orderBy("h").limit(most // 2))
    rows = docs.join(F.broadcast(some.select("doc_id").distinct()), "doc_id").orderBy("doc_id").select("text").limit(2 * most).collect()
    return [r["text"] for r in rows if r["text"] and len(r["text"]) <= LONGEST]


def personal_data(docs: DataFrame, model: Crf | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_crf) for every row of ``docs`` (doc_id, text)."""
    by_value()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_detect(model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_crf long")


def fit(docs: DataFrame, most: int = TRAIN_DOCS) -> Crf | None:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return train(labelled_texts(docs, most))


def op4_pii_crf(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return personal_data(docs, fit(docs))
