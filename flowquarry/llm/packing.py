"""Lexical retrieval packing: a sharded BM25 index returns unused neighbours that fill a document's window.

A shard is a run of documents that one task reads anyway, so nothing is shuffled:
BM25 statistics and postings are those of the shard. Starting from a seed, the
unused neighbour of highest score is appended until the window is full; what a
window cuts off is the seed of the next one. A window that is still open at the
end of a shard is carried to the task's next shard, and what is left at the end
of the task is cut into sequences of powers of two, so that no padding is needed.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import bounded

WINDOW = 2048
END = 1
#: Documents, and bytes of text, after which a shard is closed; a single document may be larger.
SHARD_DOCS = 512
SHARD_BYTES = 8_000_000
#: Distinct words, and pieces of words, whose ids a worker remembers (up to about 300 MB); then it starts anew.
REMEMBERED = 1_200_000
K1, B = 1.2, 0.75

# The tokenizer's own split of normalised text, and its printable stand-ins for bytes.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\p{L}\p{N}\p{P}\p{S}]+")
_MARKS = ".,!?;:"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of white-space separated words by a tokenizer that never joins across white space.

    Distinct words are encoded once and remembered: their pieces go to the
    tokenizer's model, words with unusual characters to the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        hidden = iter(range(256, 512))
        self.shown = {b: b if b in set(_SHOWN) else next(hidden) for b in range(256)}
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.pieces: dict[str, bytes] = {}  # ids as 32-bit integers
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.ends, self.count = np.zeros(1 << 16, np.int64), 0

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))
            ids = self.pieces[piece] = array("i", [t.id for t in found]).tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        if core.isalpha() and (core.isascii() or core.islower() and is_normalized("NFC", core)):
            # A run of lower-case letters and one of marks, as nearly all words are: two pieces.
            return self._piece(core) + self._piece(word[len(core) :]) if len(core) < len(word) else self._piece(core)
        if not _PLAIN.fullmatch(word):
            return array("i", self.whole.encode(word, add_special_tokens=False).ids if word else []).tobytes()
        return b"".join(map(self._piece, _SPLIT.findall(self.whole.normalizer.normalize_str(word))))

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of lower-case words: word i has ``ids[starts[i]:starts[i] + lengths[i]]``."""
        if len(self.slots) + len(words) > REMEMBERED or len(self.pieces) > REMEMBERED:
            self._forget()
        slots = np.array([self.slots.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(slots < 0).tolist()
        if new:
            made = [self._word(words[i]) for i in new]
            lengths = np.fromiter(map(len, made), np.int64, len(made)) // 4
            total = int(lengths.sum())
            if self.used + total > len(self.flat):
                self.flat = np.resize(self.flat, 2 * (self.used + total))
            self.flat[self.used : self.used + total] = np.frombuffer(b"".join(made), np.int32)
            if self.count + len(made) >= len(self.ends):
                self.ends = np.resize(self.ends, 2 * (self.count + len(made)) + 1)
            self.ends[self.count + 1 : self.count + 1 + len(made)] = self.used + np.cumsum(lengths)
            self.slots.update(zip((words[i] for i in new), range(self.count, self.count + len(made)), strict=True))
            slots[new] = np.arange(self.count, self.count + len(made))
            self.used, self.count = self.used + total, self.count + len(made)
        return self.flat, self.ends[slots], self.ends[slots + 1] - self.ends[slots]


_encoders: dict[str, WordEncoder] = {}


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Shard:
    """Token ids and BM25 postings of a run of texts."""

    def __init__(self, texts: pa.Array, encoder: WordEncoder):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.docs = n = len(sizes)
        flat, starts, lengths = encoder(words)
        self._encode(terms, sizes, np.append(starts, 0), np.append(lengths, 1), flat)
        blank = np.array([w == "" for w in words], bool)  # what white space at the edges of a text leaves
        self._index(terms, np.repeat(np.arange(n), sizes), blank, len(words))

    def _encode(self, terms, sizes, starts, lengths, flat) -> None:
        # Every document is followed by one more "word", whose only id is the end.
        closed = np.full(len(terms) + self.docs, len(starts) - 1, np.int64)
        closed[np.arange(len(terms)) + np.repeat(np.arange(self.docs), sizes)] = terms
        last = np.cumsum(sizes + 1) - 1
        per_word = lengths[closed]
        self.ids = flat[_ranges(starts[closed], per_word)].astype("<u4")
        self.ends = np.cumsum(per_word)[last]
        self.ids[self.ends - 1] = END
        self.starts = np.concatenate(([0], self.ends[:-1]))

    def _index(self, terms, docs, blank, count) -> None:
        n = self.docs
        terms, docs = terms[~blank[terms]], docs[~blank[terms]]
        pairs, tf = np.unique(terms * n + docs, return_counts=True)
        term, doc = pairs // n, pairs % n
        df = np.bincount(term, minlength=count)
        # Classic BM25: a term in half of the documents or more tells nothing.
        idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0)
        idf[df < 2] = 0
        size = np.bincount(doc, tf, minlength=n)
        tf = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(size.mean(), 1e-9)))
        use = idf[term] > 0
        self.post_doc, self.post_weight, kept = doc[use], (idf[term] * tf)[use].astype(np.float32), term[use]
        self.post_end = np.cumsum(np.bincount(kept, minlength=count))
        self.post_start = np.concatenate(([0], self.post_end[:-1]))
        order = np.argsort(self.post_doc, kind="stable")
        self.doc_terms = kept[order]
        self.doc_end = np.cumsum(np.bincount(self.post_doc, minlength=n))

    def scores(self, doc: int) -> np.ndarray:
        """BM25 score of every document of the shard for the terms of one of them."""
        terms = self.doc_terms[self.doc_end[doc - 1] if doc else 0 : self.doc_end[doc]]
        at = _ranges(self.post_start[terms], self.post_end[terms] - self.post_start[terms])
        return np.bincount(self.post_doc[at], self.post_weight[at], minlength=self.docs)


class Packer:
    """Fills the windows of one task, shard by shard."""

    def __init__(self, first: int, window: int):
        self.window, self.sequence, self.offset = window, first, 0
        self.open: list[tuple] = []  # pieces of the open window, as it may have to be cut again at the end

    def _place(self, key, total: int, start: int, ids: np.ndarray) -> int:
        """Put as much of ``ids`` as fits into the open window; returns how much did."""
        length = min(len(ids), self.window - self.offset)
        self.open.append((key, start, ids[:length], total, self.sequence, self.offset))
        self.offset += length
        return length

    def _close(self) -> list[tuple]:
        done, self.open = self.open, []
        self.sequence, self.offset = self.sequence + 1, 0
        return done

    def add(self, keys: list, shard: Shard) -> Iterator[tuple]:
        unused = np.ones(shard.docs, bool)
        scores, doc = None, 0
        for _ in range(shard.docs):
            if scores is None:  # a new seed: the first unused document
                doc = int(unused.argmax())
            else:
                doc = int(np.where(unused, scores, -1).argmax())
            unused[doc] = False
            ids = shard.ids[shard.starts[doc] : shard.ends[doc]]
            if scores is None:
                scores = shard.scores(doc)
            at = 0
            while at < len(ids):
                at += self._place(keys[doc], len(ids), at, ids[at:])
                if self.offset == self.window:
                    yield from self._close()
                    # The document that was cut is the next seed; one that ended here leaves the choice open.
                    scores = shard.scores(doc) if at < len(ids) and len(ids) - at < self.window else None

    def finish(self) -> Iterator[tuple]:
        """The last window, cut into sequences of powers of two."""
        rest, left, self.open, self.offset = self.open, self.offset, [], 0
        pieces = [(k, s, ids, t) for k, s, ids, t, _, _ in rest]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            offset = 0
            while offset < room:
                key, start, ids, total = pieces.pop(0)
                length = min(len(ids), room - offset)
                yield key, start, ids[:length], total, self.sequence, offset
                if length < len(ids):
                    pieces.insert(0, (key, start + length, ids[length:], total))
                offset += length
            self.sequence += 1


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and ``ids``.

    A document is the tokenizer's ids of its whole text and the end id; a null or
    empty text is the end id alone, a very long one spans many windows. Each row of
    ``docs`` is packed, repeated rows and rows without doc_id too; columns other
    than ``doc_id`` and ``text`` are ignored, and an empty table gives no pieces.
    Sequence ids are unique, with the task in their upper bits. The tokenizer must
    be installed at the same path on every executor (by default a package file).
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer or default_tokenizer()
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encoder = _encoders[path]
        packer = Packer(TaskContext.get().partitionId() << 33, window)

        def made(pieces: list[tuple]) -> pa.RecordBatch:
            arrays = [
                pa.array([p[0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([len(p[2]) for p in pieces], pa.int64()),
                pa.array([zlib.crc32(p[2].tobytes()) for p in pieces], pa.int64()),
                pa.array([p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64()),
                pa.array([p[5] for p in pieces], pa.int64()),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                flat = np.concatenate([p[2] for p in pieces]).astype(np.int32)
                ends = np.cumsum([0, *(len(p[2]) for p in pieces)])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def shards() -> Iterator[tuple[list, pa.Array]]:
            keys, texts, size = [], [], 0
            for batch in batches:
                weights = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
                ids, first = batch.column(0).to_pylist(), 0
                for i, weight in enumerate(weights):
                    size += weight
                    if len(keys) + i + 1 - first >= SHARD_DOCS or size >= SHARD_BYTES:
                        keys += ids[first : i + 1]
                        texts.append(batch.column(1).slice(first, i + 1 - first))
                        yield keys, pa.concat_arrays(texts)
                        keys, texts, size, first = [], [], 0, i + 1
                keys += ids[first:]
                texts.append(batch.column(1).slice(first))
            if keys:
                yield keys, pa.concat_arrays(texts)

        for keys, texts in shards():
            pieces = list(packer.add(keys, Shard(texts, encoder)))
            if pieces:
                yield made(pieces)
        pieces = list(packer.finish())
        if pieces:
            yield made(pieces)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
