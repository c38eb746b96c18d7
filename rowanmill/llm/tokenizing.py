"""SentencePiece BPE encoding and decoding by a prefix table (operator 9).

A sequence of pieces is the BPE encoding of its text exactly if every adjacent pair is the encoding
of its own concatenation.  So each prefix of a text has one possible last piece: of the pieces that
end there (found by an Aho-Corasick automaton), the one compatible with the last piece of the prefix
before it.  The table holds that piece; the ids are read from it backwards.

Pieces hold the space mark only as a leading run, and none goes on after a letter with anything but a
letter, so the text falls into units that encode by themselves.  Both are read off the vocabulary when it
is loaded; for one without the second property units end only at marks and line breaks.  Each worker
keeps a bounded memory of units.

Defined results: a null text is the empty text, which has no ids and decodes to the empty text; a text of any
length is encoded whole; of merges with equal scores the leftmost is made, as the library does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
BY_MARK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
KNOWN_UNITS = 300_000
_loaded: dict[str, "PieceTable"] = {}


def units_of(pieces: Iterable[str]) -> re.Pattern:
    """What to cut texts into: up to the end of a run of letters, if no piece goes on after a letter with another character."""
    odd = "".join(sorted({c for p in pieces for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
    letter, other = rf"[^\W\d_{re.escape(odd)}]", rf"(?![{MARK}\n])[\W\d_{re.escape(odd)}]"
    crossed = re.compile(rf"{letter}(?!{letter}).", re.S)
    if any(map(crossed.search, pieces)):
        return BY_MARK
    return re.compile(rf"{MARK}*(?:{other})*{letter}+|{MARK}*(?:{other})+|{MARK}+|\n")


class PieceTable:
    """The vocabulary of one model file, its automaton and the memory of units and pairs."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.text_of = {i: self.pieces[i] for i in plain}
        if model.encode("  a  b ") and model.decode(model.encode("  a  b ")) != "  a  b ":
            raise ValueError("models that normalize texts or drop spaces are not supported")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("pieces that go over a space or line break are not supported")
        self.unit = units_of(self.ids)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merged(p) == [p]:  # others are never the result of merging
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.units: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Plain BPE of a short text: merge the best-scored adjacent pair, the leftmost of equals, until none is a piece."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two pieces are the encoding of their concatenation."""
        a, b = self.text_of[left], self.text_of[right]
        fit = self.merged(a + b) == [a, b]
        if len(self.pairs) > 2 * KNOWN_UNITS:
            self.pairs.clear()
        self.pairs[left << 20 | right] = fit
        return fit

    def encode_unit(self, unit: str) -> tuple[int, ...]:
        n, known = len(unit), self.pairs.get
        last = [-1] * n  # the last piece of the prefix up to each character; -1: that character is outside the vocabulary
        for end, (size, piece) in self.automaton.iter(unit):
            start = end - size
            before = last[start] if start >= 0 else -1
            if before >= 0:
                fit = known(before << 20 | piece)
                if fit is None:
                    fit = self.fits(before, piece)
                if not fit:
                    continue
            last[end] = piece
        ids: list[int] = []
        while n:
            piece = last[n - 1]
            if piece >= 0:
                ids.append(piece)
                n -= len(self.pieces[piece])
            else:
                n -= 1
                ids.extend(self.byte_ids[b] for b in reversed(unit[n].encode("utf-8", "surrogatepass")))
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        units = self.units
        for unit in self.unit.findall(MARK + text.replace(" ", MARK)):
            known = units.get(unit)
            if known is None:
                known = self.encode_unit(unit)
                if len(unit) <= 32:
                    if len(units) >= KNOWN_UNITS:
                        units.clear()
                    units[unit] = known
            ids += known
        return ids

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, marks as spaces, runs of byte pieces as UTF-8, the leading mark dropped."""
        pieces, byte_of, out, held = self.pieces, self.byte_of, [], bytearray()
        for i in ids:
            b = byte_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def piece_table(model_file: str) -> PieceTable:
    """The table of a model file, built once in each worker."""
    if model_file not in _loaded:
        _loaded[model_file] = PieceTable(model_file)
    return _loaded[model_file]


def tokenize(docs: DataFrame, model_file: str, keep_ids: bool = True) -> DataFrame:
    """Per document: doc_id, ids (array, only with ``keep_ids``), n_tokens, ids_sha256, decoded_sha256.

    No shuffle: every row is encoded and decoded in the task that reads it.  Rows with a null doc_id and
    repeated rows are kept as they are; an empty table gives an empty result; other columns are not read.
    """
    kept = pa.schema([("doc_id", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep_ids else []), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_file)
        for batch in batches:
            rows = {name: [] for name in kept.names}
            for text in batch.column("text"):
                ids = table.encode(text.as_py() or "")
                if keep_ids:
                    rows["ids"].append(ids)
                rows["n_tokens"].append(len(ids))
                rows["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(table.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            rows["doc_id"] = batch.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if f.name != "doc_id" else rows["doc_id"] for f in kept], schema=kept)

    schema = "doc_id long, " + "ids array<int>, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(encode, schema)
