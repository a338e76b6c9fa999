"""Operator 4: byte-level BPE encoding and decoding with a segment tree.

Method. A piece of text starts as its bytes. The leaves of a segment tree hold the
merge ranks of adjacent symbol pairs, packed as rank * width + position, and every
inner node the minimum of its children: the root is the lowest rank at its leftmost
place. Merging there changes at most three leaves, each a logarithmic climb, until
the root holds no mergeable pair. A piece of m bytes costs O(m log m) whatever its
length, so one very long run without spaces does no harm.

Texts are split by the tokenizer's own pattern. As most pieces are short words that
repeat, each Python worker remembers what it has encoded, in a memory of fixed size
(a matter of speed only). Work is per row: no exchange, no state between rows.
"""

from __future__ import annotations

import functools
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import slices, tidy_map

#: The split pattern of byte-level pre-tokenization.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Remembered pieces a worker, in two halves: when one is full, the older one is dropped.
REMEMBERED = 700_000
#: Longer pieces aren't remembered.
LONG_PIECE = 64


def byte_alphabet() -> dict[str, int]:
    """Character -> byte, as byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    rest = [b for b in range(256) if b not in set(shown)]
    return table | {chr(256 + n): b for n, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.first = [0] * 256
        for char, byte in alphabet.items():
            self.first[byte] = vocab[char]
        self.pairs = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.bytes_of = {str(i): raw(t) for t, i in vocab.items() if t not in self.added}
        self.bytes_of |= {str(i): t.encode() for t, i in self.added.items()}
        self.find = regex.compile(PATTERN).findall
        self.split_added = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split
            if self.added
            else None
        )
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece by the segment tree."""
        symbols = [self.first[b] for b in piece]
        m = len(symbols)
        if m < 2:
            return symbols
        pairs, get = self.pairs, self.pairs.get
        bits = (m - 1).bit_length()
        width, none = 1 << bits, 1 << 62
        low = width - 1
        tree = [none] * (2 * width)
        for i in range(m - 1):
            hit = pairs.get(symbols[i] << 32 | symbols[i + 1])
            if hit is not None:
                tree[width + i] = hit[0] << bits | i
        for n in range(width - 1, 0, -1):
            a, b = tree[2 * n], tree[2 * n + 1]
            tree[n] = a if a < b else b
        after, before = list(range(1, m + 1)), list(range(-1, m - 1))
        while (best := tree[1]) != none:
            i = best & low
            j = after[i]
            k = after[j]
            p = before[i]
            symbols[i] = s = pairs[symbols[i] << 32 | symbols[j]][1]
            after[i] = k
            left, right = none, none
            if k < m:
                before[k] = i
                hit = get(s << 32 | symbols[k])
                if hit is not None:
                    right = hit[0] << bits | i
            if p >= 0:
                hit = get(symbols[p] << 32 | s)
                if hit is not None:
                    left = hit[0] << bits | p
            leaf, value = j, none
            while True:
                n = width + leaf
                if tree[n] != value:
                    tree[n] = value
                    while n > 1:
                        other = tree[n ^ 1]
                        n >>= 1
                        if other < value:
                            value = other
                        if tree[n] == value:
                            break
                        tree[n] = value
                if leaf == j:
                    leaf, value = i, right
                elif leaf == i and p >= 0:
                    leaf, value = p, left
                else:
                    break
        ids, i = [], 0
        while i < m:
            ids.append(symbols[i])
            i = after[i]
        return ids

    def piece(self, piece: str) -> str:
        """Comma-joined ids of one piece of the split pattern."""
        known = self.known
        ids = known.get(piece)
        if ids is None:
            ids = self.older.get(piece)
            if ids is None:
                ids = ",".join(map(str, self.merge(piece.encode())))
            if len(piece) <= LONG_PIECE:
                if len(known) >= REMEMBERED // 2:
                    # what has been used since the last time is kept
                    self.older = known
                    self.known = known = {}
                known[piece] = ids
        return ids

    def unit(self, unit: str) -> str | None:
        """Ids of a space and what follows up to the next space; None where the split
        pattern may join it with its neighbours (it is empty or has outer white space)."""
        if not unit or unit[0].isspace() or unit[-1].isspace():
            return None
        pieces = self.find(" " + unit)
        if len(pieces) == 1:
            return self.piece(pieces[0])
        return ",".join(map(self.piece, pieces))

    def plain(self, text: str) -> str:
        """Ids of a text without added tokens. Where single spaces divide words, no piece
        crosses the place before a space, so units can be looked up as a whole."""
        head, *units = text.split(" ")
        if head and not head[-1].isspace():
            out = list(map(self.known.get, [" " + u for u in units]))
            if None in out:
                for i, ids in enumerate(out):
                    if ids is None:
                        ids = self.unit(units[i])
                        if ids is None:
                            break
                        out[i] = ids
                else:
                    return ",".join([*map(self.piece, self.find(head)), *out])
            else:
                return ",".join([*map(self.piece, self.find(head)), *out])
        return ",".join(map(self.piece, self.find(text)))

    def encode(self, text: str) -> str:
        """Comma-joined decimal ids of a text; strings of added tokens become theirs."""
        if self.split_added is None or not any(t in text for t in self.added):
            return self.plain(text)
        parts = [str(self.added[p]) if p in self.added else self.plain(p) for p in self.split_added(text) if p]
        return ",".join(parts)

    def decode(self, ids: str) -> str:
        """Text of comma-joined ids; bytes that aren't UTF-8 become U+FFFD."""
        if not ids:
            return ""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each Python worker and file."""
    return Codec(path)


def roundtrip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Encodes and decodes each text: (doc_id, n_tokens, ids, decoded), and text if kept.

    ids are decimal, joined by commas; decoded is made from them alone. Null and empty
    texts have no ids and decode to the empty text; any length is encoded whole;
    repeated rows and null doc_ids are kept as they come; other columns are ignored,
    so their names can't clash; an empty table gives no rows.
    """

    def run(batches):
        own = codec(path)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            ids = [own.encode(t) if t else "" for t in texts]
            counts = [x.count(",") + 1 if x else 0 for x in ids]
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(map(own.decode, ids), pa.string())]
            names = ["doc_id", "n_tokens", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)] if keep_text else columns, names=[*names, "text"] if keep_text else names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy_map(run), "doc_id long, n_tokens long, ids string, decoded string" + (", text string" if keep_text else ""))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of roundtrip()."""
    return roundtrip(docs, path).select(
        "doc_id", "n_tokens", F.sha2(F.encode("ids", "UTF-8"), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )
