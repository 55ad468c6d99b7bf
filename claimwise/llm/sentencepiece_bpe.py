"""Operator 9: SentencePiece encoding and decoding, exact merge-type (BPE)
encoding by backtracking.

The encoder finds, left to right, the longest vocabulary piece at each place
(all pieces in a segment come from one Aho-Corasick pass) and keeps it if it is
compatible with the piece before: undoing the merges of the two pieces from
the latest to the first, no merge across their border may come before the
merge that is undone.  If not, it tries the next shorter piece, and if none is left it
steps back; a place from which no valid rest exists is noted in a bitfield and
not entered again.  The one sequence in which all neighbours are compatible is
the one that merging by score gives.

No piece of such a vocabulary goes on after a space mark that follows another
sign, so a text is cut before each run of spaces and the segments are encoded
on their own.  A bounded two-generation cache holds the ids and the decoded
text of recent segments; every document is still encoded and decoded whole.

Byte fallback: a sign without a piece becomes its UTF-8 bytes; a space becomes
U+2581, one is put before a text that isn't empty, and the end id closes every
sequence.  Decoding joins the pieces, reads runs of byte pieces as UTF-8
(U+FFFD for wrong bytes), drops control ids and one leading space.

A worker process makes its encoder once and keeps it, and the cache, for its later tasks.

Only models of type BPE with byte fallback, identity normalisation and such a
vocabulary are accepted, others raise ValueError.  Null or empty text gives the
end id alone and decodes to the empty text.  Null doc_ids and repeated rows
pass through; a text of any length is encoded whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from types import ModuleType

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, read

MARK = "▁"
CACHE = 150_000           # segments of a cache generation; two are held
SHORT = 24                # signs of a segment that is not cut further
FIRST = 1 << 40           # later than any merge


class Bpe:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.control = [sp.is_control(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unk, self.eos = sp.unk_id(), sp.eos_id()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i) or sp.is_unknown(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        if len(self.bytes) != 256 or sp.normalize("a ﬁ  b") != MARK + "a" + MARK + "ﬁ" + MARK * 2 + "b":
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece goes on after a space mark")
        # the merge order: pieces by score; single signs come before all merges
        order = sorted((i for i in plain if len(self.pieces[i]) > 1), key=lambda i: -sp.get_score(i))
        self.rank, last, at = {}, None, 0
        for i in order:
            at += sp.get_score(i) != last
            last = sp.get_score(i)
            self.rank[self.pieces[i]] = at
        self.halves: dict[str, tuple[str, str]] = {}
        self.find = ahocorasick.Automaton()
        whole = {p for p in self.id_of if len(p) == 1 or self._split(p)}
        for p in whole:
            self.find.add_word(p, (p, len(p) - 1))
        self.find.make_automaton()
        # the next shorter piece that a piece begins with
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in whole), None) for p in whole}
        self.digits = [str(i).encode() for i in range(n)]
        self.special = {i for i in range(n) if self.control[i] or i in self.byte_of or i == self.unk}
        self.joined = {p for p in self.id_of if len(p) > 1}
        self.pairs = {p[i:i + 2] for p in self.joined for i in range(len(p) - 1)}  # signs side by side in a piece
        self.lines = "\n" not in "".join(self.joined)
        self.fits: dict[tuple[str, str], bool] = {}
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def _split(self, piece: str) -> bool:
        """Notes the last merge of a piece; False if merging never makes it."""
        parts = list(piece)
        while len(parts) > 1:
            best = min((self.rank.get(parts[i] + parts[i + 1], FIRST), i) for i in range(len(parts) - 1))
            if best[0] == FIRST:
                return False
            i = best[1]
            if len(parts) == 2:
                self.halves[piece] = (parts[0], parts[1])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return True

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the text of both leaves a border between a and b."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        left, right, rank = a, b, self.rank
        bound, ok = FIRST, True  # a merge across the border must come before it to win
        while True:
            r = rank.get(left + right, FIRST)
            if r < bound:
                ok = False
                break
            ra, rb = rank.get(left, 0), rank.get(right, 0)
            if not ra and not rb:
                break
            if ra > rb:
                # undo the left piece's last merge; equal merges go left to right,
                # so one across the border at its rank comes after it
                left, bound = self.halves[left][1], ra
            else:
                # undo the right piece's; one across the border at its rank comes before it
                right, bound = self.halves[right][0], rb + 1
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def segment(self, text: str) -> list[str]:
        """The pieces of a segment (space marks in place), signs without a piece by themselves."""
        n = len(text)
        if n == 1 or text in self.halves:
            return [text]
        longest: list[str | None] = [None] * n
        for end, (p, back) in self.find.iter(text):
            longest[end - back] = p                 # longer ones end later
        open_ = bytearray(b"\x01") * (n + 1)
        shorter, fits, check = self.shorter, self.fits, self.compatible
        out: list[str] = []
        pos, before = 0, None                       # the piece before, None after a sign without one
        while pos < n:
            p = longest[pos]
            if p is None:
                out.append(text[pos])
                pos, before = pos + 1, None
                continue
            while True:
                while p is not None:
                    if open_[pos + len(p)]:
                        if before is None:
                            break
                        fit = fits.get((before, p))
                        if check(before, p) if fit is None else fit:
                            break
                    p = shorter[p]
                if p is not None:
                    break
                open_[pos] = 0                      # no valid rest from here: back to the piece before
                p = out.pop()
                pos -= len(p)
                before = out[-1] if out and out[-1] in shorter else None
                p = shorter[p]
            out.append(p)
            pos, before = pos + len(p), p
        return out

    def ids(self, segment: str) -> list[int]:
        """Ids of a segment; a long one is cut further between signs that no piece holds side by side."""
        got: list[int] = []
        pairs, at, id_of = self.pairs, 0, self.id_of
        n = len(segment)
        cuts = [n] if n <= SHORT else [i for i in range(1, n) if segment[i - 1:i + 1] not in pairs] + [n]
        for i in cuts:
            part, at = segment[at:i], i
            for p in self.segment(part):
                one = id_of.get(p)
                if one is None:
                    got += [self.bytes[b] for b in p.encode()]
                else:
                    got.append(one)
        return got

    def segments(self, text: str) -> list[str]:
        """A text cut before each run of spaces, one space put before it, and around line ends."""
        if not text:
            return []
        out: list[str] = []
        for line in (" " + text.replace(MARK, " ")).split("\n") if self.lines else [" " + text.replace(MARK, " ")]:
            if "  " in line or line[-1:] == " ":
                out += re.findall("^[^ ]+| +[^ ]*", line)
            else:
                words = line.split(" ")
                if words[0]:
                    out.append(words[0])
                out += [" " + w for w in words[1:]]
            out.append("\n")
        out.pop()
        return out

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.ids(s.replace(" ", MARK))] + [self.eos]

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if not self.control[i]), None)
        text = self._join(ids)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text

    def _join(self, ids: list[int]) -> str:
        if self.special.isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if not self.control[i]:
                out.append(" ⁇ " if i == self.unk else self.pieces[i])
        if run:
            out.append(_utf8(run))
        return "".join(out).replace(MARK, " ")

    def _fill(self, segments: set[str]) -> dict[str, tuple[bytes, str]]:
        """The cache with all of the segments in it."""
        if len(self.young) + len(segments) > CACHE:
            self.old, self.young = self.young, {}
        for s in segments.difference(self.young):
            hit = self.old.get(s)
            if hit is None:
                ids = self.ids(s.replace(" ", MARK))
                text = self._join(ids)
                hit = (b" ".join([self.digits[i] for i in ids]), s if text == s else text)
            self.young[s] = hit
        return self.young

    def row(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the text decoded from them."""
        segments = self.segments(text)
        known = self._fill(set(segments))
        got = [known[s] for s in segments]
        line = b" ".join([g[0] for g in got] + [str(self.eos).encode()])
        back = "".join([g[1] for g in got])[1:]
        return (line.count(b" ") + 1, hashlib.sha256(line).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def _utf8(run: bytearray) -> str:
    """Bytes as UTF-8, each wrong byte as U+FFFD."""
    out, i = [], 0
    while i < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[i:i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoder(model: bytes) -> Bpe:
    """The encoder of a model, made once per process and kept with its cache.  Functions
    sent by value get new globals in each task, so it is held in a module of its own."""
    held = sys.modules.setdefault("bpe_encoders_of_this_process", ModuleType("bpe_encoders_of_this_process"))
    key = "model_" + hashlib.sha256(model).hexdigest()
    if not hasattr(held, key):
        setattr(held, key, Bpe(model))
    return getattr(held, key)


def _digests(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = [bpe.row(t or "") for t in part.column("text").to_pylist()]
                n, ids, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``;
    the model's bytes go to the tasks with the code."""
    by_value()
    with open(model_file, "rb") as f:
        model = f.read()
    encoder(model)  # a wrong model fails here, not in a task
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_digests(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids): the token ids themselves, for a training job."""
    by_value()
    with open(model_file, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                ids = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), default_model())
