"""Exact merge-type subword encoding and decoding by backtracking.

The text is cut before each blank mark that follows another character (no piece of the vocabulary has a mark inside
unless it is made of marks only, which is checked at load). Within a unit the encoder walks left to right taking the
longest matching piece, found by one Aho-Corasick pass; a step is kept only if the piece and the one before it stay
apart when both are merged again from characters. On a dead end it goes back, and a bitfield marks positions from
which no valid rest exists. Two valid adjacent pairs in a row make a valid whole, so the result is that of merging.
Characters outside the vocabulary become their UTF-8 byte pieces and part the text on both sides.

Inside a run of blank marks equal pieces merge from the left, so two neighbours do not decide: there, and for the piece
that follows the run, the check merges the pieces of the last ``4 * longest`` marks and the new one again. Null is the
empty text, which has no ids; whole texts of any length are encoded;
repeated rows are encoded alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
import types
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

MARK = "▁"
#: Units whose encoding a worker keeps; beyond it the memo starts afresh.
MEMO = 1_000_000
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # fixed values of the model format


class Encoder:
    """Encoder and decoder of one merge-type model, given as the serialised model."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only merge-type models without text normalisation are handled")
        self.prefix = norm.add_dummy_prefix
        self.text = [p.piece for p in proto.pieces]
        self.kind = [p.type or NORMAL for p in proto.pieces]
        if USER in self.kind:
            raise ValueError("user-defined pieces are not handled")
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if (p.type or NORMAL) == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if (p.type or NORMAL) == NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = self.kind.index(UNKNOWN)
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a blank mark inside")
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.plain = [p.replace(MARK, " ") if k == NORMAL else None for p, k in zip(self.text, self.kind, strict=True)]
        self.letters = {p for p in self.id if len(p) == 1}
        self.reach = 4 * max((len(p) for p in self.id if not p.strip(MARK)), default=1)
        self.whole: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.runs_known: dict[tuple[str, ...], bool] = {}
        self.units: dict[str, tuple[int, str, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Merge from single characters: the adjacent pair of the best score first, the leftmost on ties."""
        part: list[str | None] = list(text)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if (s := self.score.get(p := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, p))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or part[i] + part[j] != p:
                continue
            part[i], part[j], after[i] = p, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in part if p is not None]

    def apart(self, left: str, right: str) -> bool:
        """Whether both pieces come back when their text is merged again."""
        pair = left, right
        if (known := self.pairs.get(pair)) is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[pair] = self.merge(left + right) == [left, right]
        return known

    def follows(self, pieces: list[str], piece: str) -> bool:
        """Whether a piece may follow the ones before it, the last of which holds blank marks only."""
        first, marks = len(pieces), 0
        while first and marks < self.reach:
            first -= 1
            marks += len(pieces[first])
        wanted = (*pieces[first:], piece)
        if (known := self.runs_known.get(wanted)) is None:
            if len(self.runs_known) > 100_000:
                self.runs_known.clear()
            known = self.runs_known[wanted] = self.merge("".join(wanted)) == list(wanted)
        return known

    def alone(self, piece: str) -> bool:
        """Whether a piece comes back when its own text is merged."""
        if (known := self.whole.get(piece)) is None:
            known = self.whole[piece] = self.merge(piece) == [piece]
        return known

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text whose characters all are in the vocabulary."""
        if text in self.id and self.alone(text):
            return [text]
        n, pairs = len(text), self.pairs
        starts: list[list[int]] = [[] for _ in range(n + 1)]  # lengths of the matches at each start, rising
        for end, size in self.automaton.iter(text):
            starts[end - size + 1].append(size)
        failed = bytearray(n // 8 + 1)  # bitfield of positions that no valid rest follows
        pieces: list[str] = []
        at = 0
        while at < n:
            left = starts[at]  # a position is entered once: what is popped here is never wanted again
            while left:
                to = at + left.pop()
                if failed[to >> 3] >> (to & 7) & 1:
                    continue
                piece = text[at:to]
                if pieces and not pieces[-1].strip(MARK):
                    fits = self.follows(pieces, piece)
                elif pieces:
                    if (fits := pairs.get((pieces[-1], piece))) is None:
                        fits = self.apart(pieces[-1], piece)
                else:
                    fits = self.alone(piece)
                if fits:
                    pieces.append(piece)
                    at = to
                    break
            else:
                if not pieces:
                    raise ValueError("the vocabulary does not hold what its own merges need")
                # The valid encoding of a prefix is unique, so a position is only ever reached in one way.
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(pieces.pop())
        return pieces

    def unit(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the decoded text of one unit."""
        if self.letters.issuperset(text):
            ids = [self.id[p] for p in self.backtrack(text)]
            return len(ids), ",".join(map(str, ids)), "".join([self.plain[i] for i in ids])
        ids = []
        for known, chunk in self.runs(text):
            if known:
                ids += [self.id[p] for p in self.backtrack(chunk)]
            elif self.byte:
                ids += [self.byte[b] for b in chunk.encode()]
            else:
                ids += [self.unknown] * len(chunk)
        return len(ids), ",".join(map(str, ids)), self.decode(ids)

    def runs(self, text: str) -> Iterator[tuple[bool, str]]:
        """Runs of characters in and outside the vocabulary."""
        at = 0
        while at < len(text):
            to, known = at, text[at] in self.id
            while to < len(text) and (text[to] in self.id) == known:
                to += 1
            yield known, text[at:to]
            at = to

    def decode(self, ids: list[int]) -> str:
        """Text of ids before the blank of the prefix is dropped; byte pieces in a row form UTF-8."""
        out, held = [], bytearray()
        for i in ids:
            if self.kind[i] == BYTE:
                held.append(int(self.text[i][3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if self.kind[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.kind[i] != CONTROL:
                out.append(self.text[i].replace(MARK, " "))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def encode_units(self, text: str) -> list[tuple[int, str, str]]:
        """The text's units with their ids, each unit encoded once a task."""
        if not text:
            return []
        marked = text.replace(" ", MARK)
        if self.prefix:
            marked = MARK + marked
        units, out = self.units, []
        for u in CUT.findall(marked):
            if (got := units.get(u)) is None:
                if len(units) >= MEMO:
                    units.clear()
                got = self.unit(u)
                if len(u) <= 64:
                    units[u] = got
            out.append(got)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.encode_units(text) for i in ids.split(",")]

    def text_of(self, ids: list[int]) -> str:
        """The text of ids, without the prefix's blank."""
        text = self.decode(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text


#: A unit: blank marks, then what follows up to the next mark.
CUT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def encode(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """Ids and decoded text of each row's whole text; with ``digest``, their count and SHA-256 instead."""
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    body = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens long, ids array<int>, decoded string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # kept by the worker process from task to task, so that a unit is encoded once a worker
        kept = sys.modules.setdefault("_merge_type_encoders", types.ModuleType("_merge_type_encoders")).__dict__
        key = hashlib.sha256(model.value).hexdigest()
        if key not in kept:
            kept[key] = Encoder(model.value)
        encoder = kept[key]
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                units = encoder.encode_units(text)
                n = sum(u[0] for u in units)
                ids, plain = ",".join([u[1] for u in units]), "".join([u[2] for u in units])
                if encoder.prefix and plain.startswith(" "):
                    plain = plain[1:]
                if digest:
                    rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()))
                else:
                    rows.append((n, [int(i) for i in ids.split(",")] if ids else [], plain))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in body.split(", ")])
            out.insert(0, id_col, pdf["id"].array)
            yield out

    # ids as text on the way, so that null ids do not turn longs into doubles
    slim = docs.select(F.col(id_col).cast("string").alias("id"), whole(F.col(text_col)).alias("text"))
    return slim.mapInPandas(run, f"{id_col} string, {body}").withColumn(id_col, F.col(id_col).cast(kind))
