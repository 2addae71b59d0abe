"""SentencePiece encoding and decoding of merge-type (BPE) models with a prefix table.

Every prefix of a text has one encoding, and so one last token. The table keeps just that token for each
prefix: of the vocabulary's tokens that end there (found by an automaton) it is the one that may stand
behind the last token of the prefix in front of it. Two tokens may stand side by side if no merge across
their border would have come before the merges that made them. The ids are then read off backwards.

Tokens never reach over the place where a space mark follows another character, so a text falls into
stretches that begin with space marks; stretches already seen are looked up.

The library is used to read the model file only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import column, release

SPACE = "▁"
#: Stretches remembered at once by a worker, and pairs of tokens.
SEEN, PAIRS = 80_000, 150_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PrefixTable:
    """Encoder and decoder of one model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.vocab_size())
        self.texts = {i: model.id_to_piece(i) for i in every}
        self.bytes = {i: int(self.texts[i][1:-1], 16) for i in every if model.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.silent = {i for i in every if model.is_control(i)}
        self.unknown = model.unk_id()
        self.ids = {self.texts[i]: i for i in every if i not in self.bytes and i not in self.silent and i != self.unknown and not model.is_unused(i)}
        self.decimals = {p: str(i) for p, i in self.ids.items()}
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.left: dict[str, list[tuple[str, float]]] = {}
        self.right: dict[str, list[tuple[str, float]]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self._grow(piece):
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.seen = _Seen(self)

    def _grow(self, piece: str) -> bool:
        """Merges a piece from its characters and notes what stood at its two ends, from when on. False if
        the merges end in more than one symbol: such a piece is never a token."""
        parts = list(piece)
        left, right = [(parts[0], -1.0)], [(parts[-1], -1.0)]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get(parts[k] + parts[k + 1], float("inf")))
            made = parts[best] + parts[best + 1]
            if made not in self.rank:
                return False
            parts[best : best + 2] = [made]
            if best == 0:
                left.append((made, self.rank[made]))
            if best == len(parts) - 1:
                right.append((made, self.rank[made]))
        self.left[piece], self.right[piece] = left, right
        return True

    def _beside(self, a: str, b: str) -> bool:
        """Whether a and b stay side by side: follows what stood at either side of the border through the
        merges; one that joins the two sides must not come first. At equal rank the left one comes first."""
        ends, starts = self.right.get(a), self.left[b]
        if ends is None:
            return True
        i = j = 0
        while True:
            until_a = ends[i + 1][1] if i + 1 < len(ends) else float("inf")
            until_b = starts[j + 1][1] if j + 1 < len(starts) else float("inf")
            joined = self.rank.get(ends[i][0] + starts[j][0])
            if joined is not None and joined < until_a and joined <= until_b:
                return False
            if until_a == until_b == float("inf"):
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def last_tokens(self, text: str) -> list[str | None]:
        """For each prefix its last token; None where that is a character outside the vocabulary."""
        table: list[str | None] = [None] * (len(text) + 1)
        pairs = self.pairs
        for end, piece in self.automaton.iter(text):
            end += 1
            if table[end] is None:
                before = end - len(piece)
                if before == 0 or (left := table[before]) is None:
                    table[end] = piece
                else:
                    fits = pairs.get((left, piece))
                    if fits is None:
                        if len(pairs) > PAIRS:
                            pairs.clear()
                        fits = pairs[left, piece] = self._beside(left, piece)
                    if fits:
                        table[end] = piece
        return table

    def _stretch(self, text: str) -> list[int]:
        table, out, end = self.last_tokens(text), [], len(text)
        while end:
            piece = table[end]
            if piece is not None:
                out.append(self.ids[piece])
                end -= len(piece)
            else:
                codes = text[end - 1].encode()
                out += [self.byte_ids[c] for c in reversed(codes)] if self.byte_ids else [self.unknown]
                end -= 1
        return out[::-1]

    def _listed(self, stretch: str) -> tuple[str, str]:
        """Ids of a stretch as decimals joined by commas, and what they decode to, its first space left out."""
        stretch = SPACE + stretch
        if "\n" in stretch and "\n" not in self.ids and self.byte_ids:
            ids = [i for x in re.split("(\n)", stretch) if x for i in self._stretch(x)]
        else:
            # Tokens of the vocabulary decode to themselves, so only other characters need the ids themselves.
            table, out, end, decimals = self.last_tokens(stretch), [], len(stretch), self.decimals
            while end and (piece := table[end]) is not None:
                out.append(decimals[piece])
                end -= len(piece)
            if not end:
                return ",".join(out[::-1]), stretch[1:]
            ids = self._stretch(stretch)
        return ",".join(map(str, ids)), self._marked(ids)[1:]

    def stretches(self, text: str) -> list[str]:
        """A text with one more space in front, cut before the first of each run of spaces; that space is
        left out of the stretches. No token reaches across a cut."""
        if not text:
            return []
        if self.crossing:
            return [text.replace(" ", SPACE)]
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [x[1:] for x in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def listed_and_decoded(self, text: str) -> tuple[str, str]:
        """Ids of a text as decimals joined by commas, and the text that these ids decode to."""
        self.seen.trim()
        cut = self.stretches(text)
        listed = ",".join(map(self.seen.__getitem__, cut))
        odd = self.seen.odd
        if odd:
            cut = [odd.get(x, x) for x in cut]
        return listed, SPACE.join(cut).replace(SPACE, " ")

    def encode_listed(self, text: str) -> str:
        return ",".join(map(self.seen.__getitem__, self.stretches(text)))

    def encode(self, text: str) -> list[int]:
        listed = self.encode_listed(text)
        return list(map(int, listed.split(","))) if listed else []

    def _marked(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        run = bytearray()
        texts, as_bytes = self.texts, self.bytes
        for i in ids:
            if i in as_bytes:
                run.append(as_bytes[i])
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(texts[i])
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: space marks become spaces, the first is dropped, bytes are read as UTF-8."""
        text = self._marked(ids)
        return (text[1:] if text[:1] == SPACE else text).replace(SPACE, " ")


class _Seen(dict):
    """Stretch -> its ids as text. Once full, all but the last generation is forgotten. ``odd`` has the
    stretches that decode to something else than themselves."""

    def __init__(self, table: PrefixTable):
        super().__init__()
        self.table, self.past, self.odd = table, {}, {}

    def trim(self) -> None:
        """Forgets odd stretches that are no longer remembered; between two texts only."""
        if len(self.odd) > SEEN // 8:
            self.odd = {k: v for k, v in self.odd.items() if k in self or k in self.past}

    def __missing__(self, stretch: str) -> str:
        listed = self.past.get(stretch)
        if listed is None:
            listed, decoded = self.table._listed(stretch)
            if decoded != stretch:
                self.odd[stretch] = decoded
        if len(self) >= SEEN:
            self.past = dict(self)
            self.clear()
        self[stretch] = listed
        return listed


def _utf8(run: bytes) -> str:
    """Bytes as text; every byte that is part of no character becomes one replacement character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[k : k + n]).decode())
                    k += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                k += 1
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PrefixTable:
    return PrefixTable(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Ids of every whole text and the text that they decode to: (doc_id, ids, decoded).

    docs: doc_id, text; other columns are ignored. Null and empty texts give no ids and an empty text.
    Rows stay as they are, repeated or with a null doc_id; an empty table gives no rows.
    ``path`` is the model file, present on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model(path)
        for batch in batches:
            ids = [table.encode(t or "") for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([table.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Like encode_documents, with the digests of both results in place of them: (doc_id, n_tokens,
    ids_sha256 of the decimals joined by commas, decoded_sha256 of the UTF-8), so that the ids of a corpus
    need not leave the tasks. Stretches are decoded from their ids, once for each stretch remembered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in column(batch, "text").to_pylist():
                listed, back = table.listed_and_decoded(text or "")
                n.append(listed.count(",") + 1 if listed else 0)
                ids.append(hashlib.sha256(listed.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            release()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
