"""Harmonic packing of tokenised documents into fixed-length training sequences.

Every worker packs its own partition in one pass, so there is no shuffle and nothing is collected. A
document's whole sequences are cut off first. What remains, of length r, belongs to the reciprocal class
``j = capacity // r`` (lengths in ``(capacity / (j + 1), capacity / j]``), and a bin of class j holds exactly
j remainders. The gap that such a bin still has is closed by cutting *filler*: remainders shorter than
``capacity / classes`` and, only where those have run out, the next remainder that arrives. So most documents
stay whole, and every closed sequence is full. At the end of a partition the unfinished bins are joined, and
the last partial sequence is cut at powers of two.

Memory of a worker: one Arrow batch, at most ``classes`` unfinished bins, about one sequence of filler, and, for
vocabularies that are encoded by pieces, the pieces of text that the encoder remembers.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

PIECES = {"start": "long", "length": "long", "token_bytes": "binary", "doc_tokens": "long", "sequence_id": "long", "offset": "long"}
#: White space and what follows it up to the next white space.
PIECE = re.compile(r"\s*\S+|\s+")
#: Where a byte-level vocabulary with its own pattern cuts, without giving back what a repetition has taken.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class HarmonicPacker:
    """Packs pieces ``(document, start, ids)`` into sequences; ``take()`` returns those that are complete."""

    def __init__(self, capacity: int, classes: int) -> None:
        self.capacity, self.classes = capacity, classes
        self.open: dict[int, list] = {}
        self.filler: deque = deque()
        self.filler_size = 0
        self.waiting: list[tuple[list, int]] = []
        self.done: list[list] = []

    def add(self, doc, ids: np.ndarray) -> None:
        """All ids of one document."""
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self.done.append([(doc, at, ids[at : at + self.capacity])])
        if whole == len(ids):
            return
        rest = (doc, whole, ids[whole:])
        j = self.capacity // len(rest[2])
        if self.waiting or j > self.classes:
            self._put_filler(rest)
            return
        group = self.open.setdefault(j, [])
        group.append(rest)
        if len(group) == j:
            del self.open[j]
            self._close(group)

    def take(self) -> list[list]:
        done, self.done = self.done, []
        return done

    def flush(self) -> None:
        """Joins what is unfinished; the last partial sequence becomes sequences of power-of-two lengths."""
        for j in sorted(self.open):
            for piece in self.open[j]:
                self._put_filler(piece)
        self.open = {}
        rest = [piece for group, _ in self.waiting for piece in group]
        self.waiting = []
        self.filler.extendleft(reversed(rest))
        self.filler_size += sum(len(p[2]) for p in rest)
        while self.filler_size >= self.capacity:
            self.done.append(self._cut(self.capacity))
        for bit in range(self.filler_size.bit_length() - 1, -1, -1):
            if self.filler_size >> bit & 1:
                self.done.append(self._cut(1 << bit))

    def _cut(self, size: int) -> list:
        """Pieces of ``size`` ids in all from the front of the filler, or of fewer if it has fewer."""
        out = []
        while size and self.filler:
            doc, start, ids = self.filler.popleft()
            if len(ids) > size:
                self.filler.appendleft((doc, start + size, ids[size:]))
                ids = ids[:size]
            out.append((doc, start, ids))
            size -= len(ids)
            self.filler_size -= len(ids)
        return out

    def _close(self, group: list) -> None:
        gap = self.capacity - sum(len(p[2]) for p in group)
        cut = self._cut(gap)
        group += cut
        gap -= sum(len(p[2]) for p in cut)
        if gap:
            self.waiting.append((group, gap))
        else:
            self.done.append(group)

    def _put_filler(self, piece: tuple) -> None:
        self.filler.append(piece)
        self.filler_size += len(piece[2])
        waiting, self.waiting = self.waiting, []
        for group, _ in waiting:
            self._close(group)
        while self.filler_size >= self.capacity:
            self.done.append(self._cut(self.capacity))


def _ranked(model: dict):
    """A byte-level vocabulary as tiktoken's table of ranks; None if its ids are not the order of its merges or it has other options."""
    import tiktoken

    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*own}))}
    vocabulary = model["vocab"]
    merged = [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ()))]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    bytes_first = sorted(vocabulary.get(c, -1) for c in byte_of) == list(range(256))
    if not plain or not bytes_first or len(vocabulary) != 256 + len(merged) or any(vocabulary.get(m) != 256 + i for i, m in enumerate(merged)):
        return None
    return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={bytes(byte_of[c] for c in k): i for k, i in vocabulary.items()}, special_tokens={})


class Encoder:
    """Texts to token ids by a JSON vocabulary file of the public tokenizers, as little-endian unsigned 32-bit numbers.

    The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``. A byte-level vocabulary whose ids are
    the order of its merges, bytes first, is a table of ranks: merging by rank, as tiktoken does, gives the same ids in
    less than half the time and remembers nothing. Texts with a special token's string or a million blanks in a row
    go to the library.

    ``by_rank=False``, or other byte-level vocabularies: they never put a token across the place where white space
    follows something else, so texts are cut there and a piece that came before isn't encoded again. What that does
    not hold for is encoded whole: other vocabularies, and texts with a special token's string or one of the four
    characters that are white space for Python alone. At most ``most`` pieces of at most ``longest`` characters
    are remembered.
    """

    def __init__(self, tokenizer: str, most: int = 500_000, longest: int = 48, by_rank: bool = True) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        path = public_tokenizers.path(tokenizer)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        before = form.get("pre_tokenizer") or {}
        self.by_pieces = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not form.get("normalizer") and not form.get("post_processor")
        added = form.get("added_tokens", ())
        self.whole = re.compile("|".join(["[\x1c-\x1f]", *(re.escape(t["content"]) for t in added)]))
        self.between = next(((t["content"], t["id"]) for t in added if t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])), None)
        self.known: dict[str, bytes] = {}
        self.most, self.longest = most, longest
        self.added = [t["content"] for t in added]
        self.ranked = _ranked(form["model"]) if by_rank and self.by_pieces else None

    def _direct(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in encode(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Each piece's ids. What stands between special tokens is encoded by itself, so one call does for all."""
        if not self.between or not pieces:
            return self._direct(pieces)
        token, number = self.between
        ids = np.frombuffer(self._direct([token.join(pieces)])[0], "<u4")
        ends = np.append(np.flatnonzero(ids == number), len(ids))
        starts = np.append(0, ends[:-1] + 1)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]

    def _by_rank(self, text: str) -> bytes:
        if not any(a in text for a in self.added):
            try:
                return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # about a million blanks in a row are more than its pattern goes back over
                pass
        return self._direct([text])[0]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.ranked:
            return [self._by_rank(t) for t in texts]
        if not self.by_pieces:
            return self._direct(texts)
        out: list[bytes] = [b""] * len(texts)
        pieces = {i: PIECE.findall(t) for i, t in enumerate(texts) if not self.whole.search(t)}
        if len(self.known) > self.most:
            self.known.clear()
        fresh = list(set().union(*pieces.values()).difference(self.known))
        found = dict(zip(fresh, self._pieces(fresh), strict=True))
        short = {p: ids for p, ids in found.items() if len(p) <= self.longest}
        self.known.update(short)
        long = {p: ids for p, ids in found.items() if len(p) > self.longest}
        look = self.known.__getitem__ if not long else lambda p: long[p] if p in long else self.known[p]
        for i, own in pieces.items():
            out[i] = b"".join(map(look, own))
        rest = [i for i in range(len(texts)) if i not in pieces]
        for i, ids in zip(rest, self._direct([texts[i] for i in rest]) if rest else ()):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def load_encoder(tokenizer: str) -> Encoder:
    """One for each worker process, so that what it remembers serves all its tasks."""
    return Encoder(tokenizer)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, capacity: int = 2048, classes: int = 16, chunk: int = 256) -> DataFrame:
    """Pieces of token sequences: ``id_col, start, length, token_bytes, doc_tokens, sequence_id, offset``.

    ``token_bytes`` are the piece's ids as little-endian unsigned 32-bit numbers. A document is its ids, by the
    JSON vocabulary ``tokenizer``, and then ``end_id``; a null or empty text is ``end_id`` alone, and a null id is
    kept as it is. Where the string of a special token occurs in a text it is that token; no others are added.
    Repeated rows are packed once each. An empty table gives no rows; further columns are not read. If ``id_col``
    bears the name of a piece's column, that column gets an underscore.

    ``sequence_id`` is unique in the result (partition and number in it), ``offset`` counts from 0 without
    gaps in a sequence. Sequences have ``capacity`` ids, but for at most one set of power-of-two lengths for
    each partition. ``chunk``: documents that are tokenised at a time.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    columns = {(f"{c}_" if c == id_col.lower() else c): kind for c, kind in PIECES.items()}
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer)
        packer = HarmonicPacker(capacity, classes)
        first = TaskContext.get().partitionId() << 33
        made = 0
        kind = None

        def rows() -> pa.RecordBatch | None:
            nonlocal made
            found = []
            for sequence in packer.take():
                at = 0
                for (doc, total), start, tokens in sequence:
                    found.append((doc, start, len(tokens), tokens.tobytes(), total, first + made, at))
                    at += len(tokens)
                made += 1
            if not found:
                return None
            types = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), types, strict=True)], names=[id_col, *columns])

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, data in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    ids = np.frombuffer(data + end, "<u4")
                    packer.add((doc, len(ids)), ids)
                if (out := rows()) is not None:
                    yield out
        packer.flush()
        if (out := rows()) is not None:
            yield out

    schema = ", ".join(f"`{c}` {kind}" for c, kind in columns.items())
    return docs.select(id_col, text_col).mapInArrow(pack, f"`{id_col}` {id_type}, {schema}")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, a row for each piece."""
    pieces = pack_documents(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("token_bytes").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
