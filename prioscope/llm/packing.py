"""Packing documents into windows of fixed length by the sum-of-squares rule.

Each task packs its documents as they come. A level array counts the open windows by their fill; a
piece goes to the level where the sum of the squared counts comes out smallest, which keeps windows
of all levels at hand and so fills them exactly. Documents of a window or more give whole windows
first. What is still open at the end of a task, or beyond a bound of open windows, is closed by
cutting the emptiest windows into the gaps of the fullest; the last rest is cut at powers of two.
"""

from __future__ import annotations

import functools
import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, pairwise

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class PackingConfig:
    """``vocabulary`` is a path, or the name of a file of the public tokenizers' package.

    ``known_bytes`` bounds what a worker process remembers of words and their ids, about as the process
    counts it; with ``remember`` it keeps that, and the tokenizer, from task to task.
    """

    window: int = 4096
    vocabulary: str = "word_bpe_49k.json"
    end_id: int = 2
    open_windows: int = 1024
    known_bytes: int = 192 << 20
    remember: bool = True


class WordIds:
    """Word between white space -> its token ids as little-endian 32-bit numbers.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids.
    Words seen are kept, and forgotten when they take too many bytes.
    """

    def __init__(self, config: PackingConfig):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        path = config.vocabulary
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer, self.most = Tokenizer.from_file(path), config.known_bytes
        # for words that are nothing but small Latin letters: no normalising, a split at spaces alone, and
        # the characters that stand for the bytes of a letter looked up here
        self.plain = Tokenizer(self.tokenizer.model)  # shares the vocabulary
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {n: shown.pre_tokenize_str(chr(n))[0][0] for n in range(128, 256) if chr(n).isalpha()}
        vocabulary, suffix = self.plain.get_vocab(), self.plain.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[n for token, n in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.used = 0
        self.marks = dict(zip(",.", self._encoded(self.tokenizer, [",", "."]), strict=True))

    @staticmethod
    def _encoded(tokenizer, words: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(words, add_special_tokens=False)
        numbers = array("I", chain.from_iterable(ids := [e.ids for e in found]))
        if sys.byteorder == "big":
            numbers.byteswap()
        raw, ends = numbers.tobytes(), [0, *accumulate(map(len, ids))]
        return [raw[4 * a : 4 * b] for a, b in pairwise(ends)]

    def _letters(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of small Latin letters: a block at a time as one text, cut after the ids that end a word."""
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            text = " ".join(part)
            text = text if text.isascii() else text.translate(self.shown)
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) != len(part) or ends[-1] != 4 * len(ids):  # a vocabulary without such ids
                yield from self._encoded(self.tokenizer, part)
                continue
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in pairwise([0, *ends]))

    def learn(self, words: set[bytes]) -> None:
        """Tokenize words not seen before; a last comma or full stop after a letter is a token apart."""
        tails = [b""] * len(words)
        stems = [word.decode() for word in words]
        for k, stem in enumerate(stems):
            if stem[-1] in self.marks and stem[-2:-1].isalpha():
                tails[k], stem = self.marks[stem[-1]], stem[:-1]
            stems[k] = stem.lower() if stem.isalpha() and max(stem) <= "ÿ" else stem
        new = set(stems).difference(self.stems)
        letters = [stem for stem in new if stem.isalpha() and max(stem) <= "ÿ"]
        others = list(new.difference(letters))
        self.stems.update(zip(letters, self._letters(letters), strict=True))
        self.stems.update(zip(others, self._encoded(self.tokenizer, others), strict=True))
        self.known.update(zip(words, [self.stems[s] + t for s, t in zip(stems, tails, strict=True)], strict=True))
        # a word and its ids: some 70 bytes of objects and table besides the bytes, twice for the stem
        self.used += sum(90 + 3 * len(w) for w in words) + sum(120 + 3 * len(s) for s in new)

    def ids(self, text: bytes | None, end: bytes) -> bytes:
        words = (text or b"").split()
        if self.used > self.most:
            self.known.clear()
            self.stems.clear()
            self.used = 0
        found = list(map(self.known.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            self.learn({words[k] for k in missing})
            for k in missing:
                found[k] = self.known[words[k]]
        return b"".join(found) + end


@functools.lru_cache(maxsize=1)
def word_ids(config: PackingConfig) -> WordIds:
    """One for each worker process, which Spark uses for many tasks."""
    return WordIds(config)


Piece = tuple[int | None, int, bytes, int]  # document, start in it, ids, the document's tokens


class Packer:
    """Open windows by fill. ``full`` is called with the pieces of each sequence that is done."""

    def __init__(self, window: int, most_open: int, full):
        self.window, self.most_open, self.full = window, most_open, full
        self.counts = np.zeros(window + 1, np.int64)  # the level array
        self.levels: dict[int, list[list[Piece]]] = {}
        self.open = 0

    def add(self, doc: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        start = 0
        while n - start >= self.window:
            self.full([(doc, start, ids[4 * start : 4 * (start + self.window)], n)])
            start += self.window
        if start < n:
            self.place((doc, start, ids[4 * start :], n))

    def best_level(self, size: int) -> int:
        """The level (0: a new window) that makes the sum of squared counts smallest; of equals the highest."""
        c, w = self.counts, self.window
        used = np.flatnonzero(c[1 : w - size + 1]) + 1
        if not len(used):
            return 0
        change = 2 - 2 * c[used] + 2 * c[used + size]
        if used[-1] + size == w:  # a full window is no level any more
            change[-1] = 1 - 2 * c[used[-1]]
        at = len(used) - 1 - int(change[::-1].argmin())
        return int(used[at]) if change[at] <= 1 + 2 * c[size] else 0

    def place(self, piece: Piece) -> None:
        size = len(piece[2]) // 4
        level = self.best_level(size)
        pieces: list[Piece] = []
        if level:
            pieces = self.levels[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        pieces.append(piece)
        self._put(pieces, level + size)
        if self.open > self.most_open:
            self.close()

    def _put(self, pieces: list[Piece], level: int) -> None:
        if level == self.window:
            self.full(pieces)
        elif level:
            self.levels.setdefault(level, []).append(pieces)
            self.counts[level] += 1
            self.open += 1

    def close(self) -> None:
        """Fill the fullest windows with cuts of the emptiest until one at most is open."""
        windows = [w for level in sorted(self.levels, reverse=True) for w in self.levels[level]]
        self.levels, self.open = {}, 0
        self.counts[:] = 0
        while len(windows) > 1:
            target = windows[0]
            gap = self.window - sum(len(p[2]) // 4 for p in target)
            while gap and len(windows) > 1:
                doc, start, ids, n = windows[-1].pop()
                size = len(ids) // 4
                if size > gap:
                    windows[-1].append((doc, start, ids[: 4 * (size - gap)], n))
                    start, ids = start + size - gap, ids[4 * (size - gap) :]
                target.append((doc, start, ids, n))
                gap -= min(gap, size)
                if not windows[-1]:
                    windows.pop()
            if gap:
                break
            self.full(target)
            windows[0] = windows[-1]
            windows.pop()
            windows.sort(key=lambda w: -sum(len(p[2]) for p in w)) if len(windows) < 3 else None
        for w in windows:
            self._put(w, sum(len(p[2]) // 4 for p in w))

    def end(self) -> None:
        """Close, and cut the window that is left into sequences of a power of two each."""
        self.close()
        for pieces in [w for level in self.levels.values() for w in level]:
            left = sum(len(p[2]) // 4 for p in pieces)
            pieces = pieces[::-1]
            while left:
                room, out = 1 << (left.bit_length() - 1), []
                left -= room
                while room:
                    doc, start, ids, n = pieces.pop()
                    size = min(room, len(ids) // 4)
                    out.append((doc, start, ids[: 4 * size], n))
                    if 4 * size < len(ids):
                        pieces.append((doc, start + size, ids[4 * size :], n))
                    room -= size
                self.full(out)


def packed(docs: DataFrame, config: PackingConfig = PackingConfig()) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece.

    A document is its token ids and the end id; null and empty texts are the end id alone. Rows that
    repeat, or share an id, are packed each on its own; a null id is carried along. Sequences have
    4096 tokens, but for a few at the end of each input partition, of a power of two each: nothing
    is padded. Sequence ids are unique, with the partition in the upper bits. An empty table gives
    no rows; other columns are not looked at.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(config) if config.remember else WordIds(config)
        end = np.array([config.end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def full(pieces: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, n in pieces:
                size = len(ids) // 4
                rows.append((doc, start, size, zlib.crc32(ids), n, number, offset))
                offset += size
            number += 1

        def out() -> pd.DataFrame:
            made = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            made["doc_id"] = made["doc_id"].astype("Int64")
            rows.clear()
            return made

        packer = Packer(config.window, config.open_windows, full)
        for batch in batches:
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                packer.add(None if doc is pd.NA else int(doc), words.ids(text, end))
            yield out()
        packer.end()
        yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInPandas(pack, SCHEMA)
