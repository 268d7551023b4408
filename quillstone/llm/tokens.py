"""Token ids of whole texts, computed once for each distinct word of a batch.

The byte-level vocabulary cuts a text before every space that a non-space follows, whatever stands to
the left of it. So a text is split at its spaces (in Arrow), the words are dictionary-encoded, the
tokenizers library encodes each distinct word once, and the ids of the texts are gathered from the
words'. Texts with other runs of white space go to the library whole. The result is that of encoding
each text by itself.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: distinct words a worker keeps between batches
CACHE_WORDS = 400_000
JOINED = 1000
#: bytes of words or texts that the library encodes in one call: what it returns takes about 30 times as much until its ids are taken
CALL_BYTES = 256 << 10


@dataclass
class Segments:
    """Texts as sequences of segments: ``codes`` index a store of id runs; ``ends`` closes each text."""

    codes: np.ndarray
    ends: np.ndarray
    flat: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def token_counts(self) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(self.lengths[self.codes])))
        ends = total[self.ends]
        return np.diff(ends, prepend=0)


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of flat[start : start + length] over all runs."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    at = np.cumsum(lengths) - lengths
    index = np.repeat(starts - at, lengths)
    index += np.arange(total, dtype=np.int64)
    return flat[index]


class Encoder:
    """Encodes batches of texts with a byte-level vocabulary; keeps frequent words between batches."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.library.get_vocab_size()
        self.opens = np.zeros(size, dtype=bool)  # ids that begin with a space
        for token, i in self.library.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.cache_words = cache_words
        self.words = pa.array([], pa.large_string())  # word i has code 1 + i; Python's strings would take ten times as much
        self.fixed = self.fixed_ids = 0
        self.flat = np.empty(1 << 20, dtype=np.uint32)
        self.used = 0
        self.starts: list[np.ndarray] = []
        self.count = 0

    def _store(self, runs: list[np.ndarray] | np.ndarray, lengths: np.ndarray) -> int:
        """Append id runs; returns the code of the first."""
        flat = np.concatenate(runs) if isinstance(runs, list) else runs
        need = self.used + len(flat)
        if need > len(self.flat):
            self.flat = np.resize(self.flat, max(need, 2 * len(self.flat)))
        self.flat[self.used : need] = flat
        first = self.count
        self.starts.append(self.used + np.cumsum(lengths) - lengths)
        self.lengths.append(lengths)
        self.used, self.count = need, first + len(lengths)
        return first

    def _library_ids(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each text, ``CALL_BYTES`` a call or one text."""
        runs: list[np.ndarray] = []
        at = held = 0
        for to, text in enumerate(texts, 1):
            held += len(text)
            if held >= CALL_BYTES or to == len(texts):
                runs += [np.asarray(x.ids, dtype=np.uint32) for x in self.library.encode_batch_fast(texts[at:to], add_special_tokens=False)]
                at, held = to, 0
        return runs

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of words that each follow one space."""
        parts = [" " + " ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        ids = np.concatenate(self._library_ids(parts))
        first = np.flatnonzero(self.opens[ids])
        if len(first) != len(words):
            raise ValueError("the vocabulary does not cut words at spaces")
        return ids, np.diff(first, append=len(ids)).astype(np.int64)

    def _encode_whole(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        runs = self._library_ids(texts)
        return runs, np.asarray([len(x) for x in runs], dtype=np.int64)

    def encode(self, texts: pa.Array) -> Segments:
        """Segments of the texts (null: empty). They hold until the next call."""
        if self.fixed == 0 or self.count > self.fixed:  # drop what the last batch added beyond the cache
            if self.fixed == 0:
                self.lengths: list[np.ndarray] = []
                self.starts, self.used, self.count = [], 0, 0
                self._store(np.empty(0, np.uint32), np.zeros(1, np.int64))  # code 0: no ids
                self.fixed, self.fixed_ids = self.count, self.used
            else:
                starts, lengths = np.concatenate(self.starts)[: self.fixed], np.concatenate(self.lengths)[: self.fixed]
                self.starts, self.lengths, self.count, self.used = [starts], [lengths], self.fixed, self.fixed_ids
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern(texts, " ")
        offsets = np.asarray(split.offsets, dtype=np.int64)
        encoded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        index = encoded.indices.to_numpy()
        distinct = encoded.dictionary

        code = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=self.words), -2)).astype(np.int64) + 1
        unknown = np.flatnonzero(code < 0)
        words = distinct.take(pa.array(unknown)).to_pylist()
        fresh = np.asarray([i for i, w in enumerate(words) if w and not w[0].isspace()], dtype=np.int64)
        if len(fresh):
            unknown = unknown[fresh]
            first = self._store(*self._encode_words([words[i] for i in fresh.tolist()]))
            code[unknown] = np.arange(first, first + len(fresh))
            room = min(max(0, self.cache_words - len(self.words)), len(fresh))
            if room and self.fixed == first:
                self.words = pa.concat_arrays([self.words, distinct.take(pa.array(unknown[:room]))])
                self.fixed = first + room
                self.fixed_ids = int(self.starts[-1][room - 1] + self.lengths[-1][room - 1])
        codes = code[index]  # -1: not a word that the tokens of its neighbours leave alone

        # the first word of a text follows no space
        heads = offsets[:-1]
        runs, lengths = self._encode_whole(distinct.take(pa.array(index[heads])).to_pylist()) if len(heads) else ([], np.empty(0, np.int64))
        if len(heads):
            first = self._store(runs, lengths)
            codes[heads] = np.arange(first, first + len(heads))
        odd = np.flatnonzero(np.add.reduceat(codes < 0, heads)) if len(heads) else np.empty(0, np.int64)
        keep = np.ones(len(codes), dtype=bool)
        counts = np.diff(offsets)
        if len(odd):
            runs, lengths = self._encode_whole(texts.take(pa.array(odd)).to_pylist())
            first = self._store(runs, lengths)
            for k, doc in enumerate(odd.tolist()):
                keep[offsets[doc] : offsets[doc + 1]] = False
                keep[offsets[doc]] = True
                codes[offsets[doc]] = first + k
            counts[odd] = 1
        starts, lengths = np.concatenate(self.starts), np.concatenate(self.lengths)
        self.starts, self.lengths = [starts], [lengths]
        return Segments(codes[keep], np.cumsum(counts), self.flat, starts, lengths)


def text_chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of batches with these two columns, cut to about ``most`` bytes of text; a longer text comes alone."""
    ids: list[pa.Array] = []
    texts: list[pa.Array] = []
    held = 0
    for batch in batches:
        at, column = 0, batch.column(1)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
        while at < len(column):
            before = int(ends[at - 1]) if at else 0
            fits = int(np.searchsorted(ends, before + most - held, side="right")) - at
            if fits <= 0 and not ids:
                fits = 1
            if fits > 0:
                ids.append(batch.column(0).slice(at, fits))
                texts.append(column.slice(at, fits).cast(pa.large_string()))
                held += int(ends[at + fits - 1]) - before
                at += fits
            if at < len(column):
                yield pa.concat_arrays(ids), pa.concat_arrays(texts)
                ids, texts, held = [], [], 0
                pa.default_memory_pool().release_unused()
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release_memory() -> None:
    """Give freed memory back to the system: a worker shares its executor's limit with the JVM, and is kept idle for later stages."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


_encoders: dict[str, Encoder] = {}


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    """The installed vocabulary file; any other path may be passed instead."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
