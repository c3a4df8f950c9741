"""Byte-level BPE: encoding by a priority queue of merge ranks over a doubly linked list of symbols, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: how byte-level BPE vocabularies split text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose encoding a worker remembers; the table is emptied when full. Longer pieces are not remembered.
REMEMBERED, LONGEST_REMEMBERED = 300_000, 64


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself if it is visible, else one from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}
    return [rest.get(b) or chr(b) for b in range(256)]


class ByteBPE:
    """A vocabulary file of the tokenizers library (model BPE, byte-level pieces).

    encode() gives the ids that the library gives with add_special_tokens=False, unused truncation and padding: the
    strings of special tokens in a text become their ids. decode() gives what its decode(ids, skip_special_tokens=False) gives.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE":
            raise ValueError(f"not a BPE vocabulary: {path}")
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(of_letter[c] for c in s) for s, i in self.vocab.items() if all(c in of_letter for c in s)}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.byte_id = [self.vocab[c] for c in letters]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((self.vocab[a], self.vocab[b]), (r, self.vocab[a + b]))
        self.pieces = regex.compile(PIECES)
        self.cuts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, tuple[str, int, bytes]] = {}
        self.nfc = (spec.get("normalizer") or {}).get("type") == "NFC"

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. The queue holds (rank, place); an entry is stale if its symbol is gone or the pair there has another rank now."""
        ids = [self.byte_id[b] for b in piece]
        n, rank = len(ids), self.rank
        if n == 1:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(x[0], i) for i in range(n - 1) if (x := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or (x := rank.get((ids[i], ids[j]))) is None or x[0] != r:
                continue
            ids[i], ids[j], after[i] = x[1], -1, (k := after[j])
            if k < n:
                before[k] = i
                if y := rank.get((ids[i], ids[k])):
                    heapq.heappush(queue, (y[0], i))
            if (h := before[i]) >= 0 and (y := rank.get((ids[h], ids[i]))):
                heapq.heappush(queue, (y[0], h))
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> tuple[str, int, bytes]:
        """Decimal ids joined by commas, their number, and the bytes that they decode to."""
        ids = self.merge(piece.encode("utf-8", "replace"))
        found = (",".join(map(str, ids)), len(ids), self.join(ids))
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = found
        return found

    def _parts(self, text: str) -> Iterator[tuple[str, int, bytes]]:
        known, at = self.known, 0
        text = unicodedata.normalize("NFC", text) if self.nfc else text
        for stop in [*(self.cuts.finditer(text) if self.cuts and any(s in text for s in self.special) else ()), None]:
            for piece in self.pieces.findall(text[at : stop.start()] if stop else text[at:] if at else text):
                yield known.get(piece) or self._piece(piece)
            if stop:
                i, at = self.special[stop[0]], stop.end()
                yield str(i), 1, self.bytes_of[i]

    def encode(self, text: str) -> list[int]:
        return [int(i) for x in self._parts(text) for i in x[0].split(",")]

    def join(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Strings of the vocabulary concatenated; bytes that are not UTF-8 become U+FFFD."""
        return self.join(ids).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""
        parts = list(self._parts(text))
        ids, n = ",".join([x[0] for x in parts]), sum([x[1] for x in parts])
        back = b"".join([x[2] for x in parts]).decode("utf-8", "replace")
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """One table for each worker."""
    return ByteBPE(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row of docs(doc_id, text), null text being empty: no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of each row of encoded(doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encode, then decode, in one pass without moving the ids.

    Null text counts as empty: no ids, both digests those of the empty string. A null doc_id is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            got = [bpe.digest(t.as_py() or "") for t in batch.column(1)]
            cols = [pa.array(x, kind) for x, kind in zip(zip(*got) if got else ([], [], []), (pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
