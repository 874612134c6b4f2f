"""Packing documents into token sequences by the sum-of-squares rule.

Each document is tokenized whole, ended by one end token and cut into full windows and a rest. A rest goes, as it
comes, to the fill level whose choice leaves the smallest sum of squared counts of partly filled windows; a level
array holds the count of open windows of each fill. The rule alone places every document. At the end of a task the
windows still open are cut anew into full windows, and what is left of a task into windows whose lengths are powers of
two, which need no padding. Every task packs its own input split, so nothing is shuffled, and a task that is run again
packs the same rows alike. Open windows are held in memory, so a task holds less than the tokens of its split: 573
windows were open at most while 8,581 were closed over 49 million characters of the 0.1 GB table.

Null and empty texts have the end token alone. Repeated rows are packed as often as they occur, rows without a doc_id
too. A text of any length is cut into windows as it stands. Of fill levels that grow the sum alike the fullest is
taken. An empty table has no pieces. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritrail.llm.common import at_once, in_small_batches, table

WINDOW, END_ID = 2048, 1
#: Latin-1 only: letters and digits as the tokenizer's own pattern takes them there.
LETTERS, DIGITS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
WORD = f"('s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\\s\xa0{LETTERS}{DIGITS}]+)"
#: Texts beyond this simple repertoire go to the tokenizer whole.
ODD = r"[^\x09-\x0d\x20-\x7e\x{a0}-\x{ff}]|<\|"
MAX_CACHE = 200_000
#: Characters whose words are held at once, unless one text has more.
AT_ONCE = 2_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of whole texts. The tokenizer never merges across its own word pattern, and words repeat, so a word's ids are kept: when MAX_CACHE are held they become the older ones, and the older ones before them go."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[at for word, at in self.tokenizer.get_vocab().items() if word.endswith("</w>")]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 1000):  # one text of words between spaces: every word ends with an id that ends a word
            part = words[at : at + 1000]
            ids = self.ids(" ".join(part))
            data, cuts = ids.tobytes(), (4 * (1 + self.ends[ids].nonzero()[0])).tolist()
            self.known.update(zip(part, (data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))

    def of(self, words: list[str]) -> list[bytes]:
        if len(self.known) > MAX_CACHE:
            self.known, self.older = {"": b""}, self.known
        got = list(map(self.known.get, words))
        lost = [w for w, x in zip(words, got, strict=True) if x is None]
        if lost:
            self.known.update((w, self.older[w]) for w in lost if w in self.older)
            self.learn([w for w in lost if w not in self.known])
            got = list(map(self.known.__getitem__, words))
        return got

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """AT_ONCE characters at a time; what Arrow took for them goes back to the system, since a worker runs the tasks of other stages too."""
        for a, b in at_once(texts, AT_ONCE):
            got = self.each(texts[a:b])
            pa.default_memory_pool().release_unused()
            yield from got

    def each(self, texts: list[str]) -> list[np.ndarray]:
        """Of texts that are held in memory together with their words."""
        whole = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(whole, ODD)
        apart = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(odd, "", whole)), WORD, r"\1 ")
        split = pc.utf8_split_whitespace(apart)
        coded = split.values.dictionary_encode()
        each = self.of(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        places = np.repeat((np.cumsum(sizes) - sizes)[at] - ends + n, n)
        places += np.arange(len(places))
        flat = np.frombuffer(b"".join(each), "<u4")[places]
        cuts = np.concatenate(([0], ends))[split.offsets.to_numpy()]
        return [self.ids(x) if o else flat[a:b] for x, o, a, b in zip(texts, odd.to_pylist(), cuts[:-1], cuts[1:], strict=True)]


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, which runs many tasks."""
    return Encoder(path)


class Packer:
    """Open windows by fill level. pieces(): those of the windows closed since it was last called."""

    def __init__(self, first: int, window: int = WINDOW) -> None:
        self.window, self.sequence, self.out = window, first, []
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]

    def close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.sequence, offset))
            offset += n
        self.sequence += 1

    def level(self, size: int) -> int:
        """The fill, 0 for a new window, where adding size makes the sum of squares grow least; of equals the fullest, which leaves the least open."""
        grow = np.empty(self.window - size + 1, np.int64)
        grow[:-1] = 2 * self.count[size : self.window] + 1
        grow[-1] = 0  # the window becomes full
        grow[1:] += np.where(self.count[1 : len(grow)] > 0, 1 - 2 * self.count[1 : len(grow)], 1 << 40)
        return len(grow) - 1 - int(grow[::-1].argmin())

    def add(self, doc: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.window
        at = 0
        while len(ids) - at >= step:
            self.close([(doc, at // 4, ids[at : at + step], total)])
            at += step
        if at < len(ids):
            piece, size = (doc, at // 4, ids[at:], total), (len(ids) - at) // 4
            fill = self.level(size)
            held = self.open[fill].pop() if fill else []
            held.append(piece)
            self.count[fill] -= fill > 0
            if fill + size == self.window:
                self.close(held)
            else:
                self.count[fill + size] += 1
                self.open[fill + size].append(held)

    def finish(self) -> None:
        """Cuts the open windows' tokens anew into full windows, and the rest at powers of two."""
        pieces = list(chain.from_iterable(held for level in reversed(self.open) for held in level))
        left = sum(len(x[2]) // 4 for x in pieces)
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        stream = iter(pieces)
        doc, start, ids, total = next(stream, (None, 0, b"", 0))
        while left:
            room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            taken, need = [], room
            while need:
                part = ids[: 4 * need]
                taken.append((doc, start, part, total))
                need -= len(part) // 4
                start, ids = start + len(part) // 4, ids[len(part) :]
                if not ids:
                    doc, start, ids, total = next(stream, (None, 0, b"", 0))
            left -= room
            self.close(taken)

    def pieces(self) -> pd.DataFrame:
        out, self.out = self.out, []
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pd.DataFrame(out, columns=names).astype({k: "Int64" if k == "doc_id" else "int64" for k in names})


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """docs: doc_id, text. One row for each piece; see PIECES. sequence_id is unique over the tasks."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, packer = encoder(path), Packer(TaskContext.get().partitionId() << 33, window)
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), [x if isinstance(x, str) else "" for x in batch["text"].tolist()]
            for doc, got in zip(ids, encode(texts), strict=True):
                packer.add(None if pd.isna(doc) else int(doc), got.tobytes() + end)
            yield packer.pieces()
        packer.finish()
        yield packer.pieces()

    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
