"""Token ids in binary files of directly addressable codes: any token can be read without decoding a block.

An id is cut into chunks, the low bits first. Level k holds the k-th chunks of those ids that have so many, packed at the
level's width; a bitmap beside each level but the last says which of its entries go on at the next, and a rank directory
(a count every 4096 bits, and one every 64 bits within) tells at which entry. So a token takes one look-up a level. The
widths are those that make a file smallest, from its own counts of bit lengths.

Documents are range-partitioned by doc_id, so files follow one another in ascending order. Every task writes its own
files, each closed at the first document that ends beyond `ids_a_file`; a document is never cut. A file is written under
a name of its attempt and renamed when it is whole, so a lost or repeated task leaves no part of a file under its name.
Files go to the folder that the cluster shares, through its own file system.

Null and empty texts have the end token alone. Rows without a doc_id come first. Rows that share a doc_id are in order of
their texts' hashes, and rows repeated outright one after another; such runs are dealt out over tasks by the rows' place
in the table. A text of any length is one document. An empty table has no files and no rows. Only doc_id and text are
read, whatever other columns are called.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritrail.llm.common import at_once, in_small_batches, partitions, staged, table
from veritrail.sources.remote import full_uri, opened
from veritrail.sources.staging import shared_folder

END_ID, IDS_A_FILE = 2, 1 << 22
#: Levels of a file at most, and their widths: those of which a few fill whole bytes.
MAX_LEVELS, WIDTHS = 3, (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16)
MAGIC = b"TOKENDAC"
#: Texts beyond Latin Extended-B and common punctuation go to the tokenizer whole.
ODD = re.compile("[^\t-\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞€]|<\\|")
CONTROLS = bytes([*range(9), *range(14, 32), *range(127, 160)])
#: Kinds of characters as the tokenizer's own pattern takes them; NONE stands before a text.
LETTER, DIGIT, OTHER, SPACE, WHITE, NONE = range(6)


def kind(char: str) -> int:
    return SPACE if char == " " else WHITE if char.isspace() else LETTER if char.isalpha() else DIGIT if char.isnumeric() else OTHER


#: Of each byte of UTF-8: all of a letter's from the second hundred on count as letters, and what isn't one is put right by its place.
KINDS = bytes([*(kind(chr(x)) for x in range(128)), *[LETTER] * 128])
AFTER_C2 = np.array([*[OTHER] * 160, *(kind(chr(x)) for x in range(160, 192)), *[OTHER] * 64], "u1")
MAX_CACHE = 600_000
#: Characters whose pieces are told apart at once, unless one text has more.
AT_ONCE = 3_000_000
DONE = "part int, file int, path string, n_docs long, n_ids long, start_in_part long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def is_odd(text: str) -> bool:
    try:
        single = text.encode("latin-1")
    except UnicodeEncodeError:
        return ODD.search(text) is not None
    return b"<|" in single or len(single.translate(None, CONTROLS)) < len(single)


def cuts(data: bytes, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces begin that the tokenizer's pattern finds, and the end: '(?:[stmd]|re|ve|ll)| ?letters+| ?digits+| ?others+|\\s+(?!\\S)|\\s+

    data: texts that are not odd, in UTF-8; bounds: of each text, and the end. White space begins a piece after something
    else, and before it too, as its last character goes to what follows, or stands alone if it isn't a space.
    """
    held, kinds = np.frombuffer(data, "u1"), np.frombuffer(bytearray(data.translate(KINDS)), "u1")
    pairs, triples = (held == 0xC2).nonzero()[0], (held == 0xE2).nonzero()[0]
    kinds[pairs] = kinds[pairs + 1] = AFTER_C2[held[pairs + 1]]
    signs = ((held[:-1] == 0xC3) & ((held[1:] == 0x97) | (held[1:] == 0xB7))).nonzero()[0]  # multiplied and divided by
    kinds[signs] = kinds[signs + 1] = OTHER
    kinds[triples] = kinds[triples + 1] = kinds[triples + 2] = OTHER
    some = bounds[:-1] < bounds[1:]
    firsts, lasts = bounds[:-1][some], bounds[1:][some] - 1
    before = np.concatenate(([NONE], kinds)).astype("u1")[:-1]
    before[firsts] = NONE
    white = kinds >= SPACE
    goes_on = np.concatenate((~white, [False]))[1:]  # with something else than white space
    goes_on[lasts] = False
    begins = np.where(white, (before < SPACE) | (before == NONE) | goes_on, (before != kinds) & (before != SPACE))
    wide = pairs[held[pairs + 1] == 0xA0]  # white space of two bytes
    begins[wide] |= goes_on[wide + 1]
    begins[wide + 1] = False
    quotes = (begins & (held == 0x27)).nonzero()[0]
    if len(quotes):
        ends, after = bounds[np.searchsorted(bounds, quotes, "right")], np.concatenate((held, np.zeros(2, "u1")))
        one, two = after[quotes + 1], after[quotes + 1].astype(np.uint16) << np.uint16(8) | after[quotes + 2]
        sizes = np.where(np.isin(one, list(b"stmd")) & (quotes + 1 < ends), 2, np.where(np.isin(two, [0x7265, 0x7665, 0x6C6C]) & (quotes + 2 < ends), 3, 0))
        quotes, sizes = quotes[sizes > 0], sizes[sizes > 0]
        begins[quotes + 1] = False
        begins[(quotes + sizes)[quotes + sizes < len(held)]] = True
    return np.concatenate((begins.nonzero()[0], [len(held)]))


class Encoder:
    """Ids of whole texts as bytes. The tokenizer never merges across its own pieces, and pieces repeat, so a piece's ids are kept: when MAX_CACHE are held they become the older ones, and the older ones before them go."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[at for word, at in vocabulary.items() if word[0] == "\u0120"]] = True  # the tokenizer's letter for a space

    def each(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: list[bytes]) -> None:
        """Pieces that are a space and something else are encoded many at once, one after another: each begins with the only id that has a space."""
        after_space = [k[0] == 32 and len(k) > 1 and not k.decode().isspace() for k in keys]
        words = list(compress(keys, after_space))
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            data, cuts = ids.tobytes(), [*(4 * self.begins[ids].nonzero()[0]).tolist(), 4 * len(ids)]
            self.known.update(zip(part, (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        rest = [k for k, x in zip(keys, after_space, strict=True) if not x]
        self.known.update(zip(rest, self.each([k.decode() for k in rest]), strict=True))

    def of(self, keys: list[bytes]) -> list[bytes]:
        if len(self.known) > MAX_CACHE:
            self.known, self.older = {}, self.known
        got = list(map(self.known.get, keys))
        lost = [k for k, x in zip(keys, got, strict=True) if x is None]
        if lost:
            self.known.update((k, self.older[k]) for k in lost if k in self.older)
            self.learn([k for k in lost if k not in self.known])
            got = [self.known[k] if x is None else x for k, x in zip(keys, got, strict=True)]
        return got

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Of texts that are held in memory together with their pieces."""
        odd = [is_odd(x) for x in texts]
        plain = [b"" if o else x.encode() for x, o in zip(texts, odd, strict=True)]
        data, bounds = b"".join(plain), np.concatenate(([0], np.cumsum([len(x) for x in plain], dtype=np.int64)))
        starts = cuts(data, bounds)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        each = self.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        places = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], n)
        places += np.arange(len(places))
        ids = memoryview(np.frombuffer(b"".join(each), "<u4")[places].tobytes())
        of = (4 * ends[np.searchsorted(starts, bounds)]).tolist()
        return [self.each([x])[0] if o else bytes(ids[a:b]) for x, o, a, b in zip(texts, odd, of, of[1:], strict=False)]


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, which runs many tasks."""
    return Encoder(path)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """How many ids have 0, 1, ... 32 bits. Ids of a vocabulary are few, so each is looked at once, with its number."""
    if not len(ids):
        return np.zeros(33, np.int64)
    n = np.bincount(ids) if ids.max() < 1 << 20 else None
    at = np.frexp((ids if n is None else np.arange(len(n))).astype(np.float64))[1]
    return np.bincount(at, n, minlength=33).astype(np.int64)


def best_widths(ids: np.ndarray) -> list[int]:
    """The widths of at most MAX_LEVELS levels that take the fewest bits, bitmaps included."""
    lengths = bit_lengths(ids)
    most = int(max(lengths.nonzero()[0], default=1)) or 1
    beyond = [len(ids), *(len(ids) - np.cumsum(lengths)[1:])]  # ids of more bits than so many
    cost = {(at, left): (0, []) for at in range(most, most + max(WIDTHS)) for left in range(MAX_LEVELS + 1)}
    for at in range(most - 1, -1, -1):
        for left in range(1, MAX_LEVELS + 1):
            cost[at, left] = min(((int(beyond[at]) * (w + (at + w < most)) + cost[at + w, left - 1][0], [w, *cost[at + w, left - 1][1]]) for w in WIDTHS if (at + w, left - 1) in cost), default=(1 << 60, []))
    return cost[0, MAX_LEVELS][1]


def lot(width: int) -> int:
    """Values that fill whole bytes, 64 bits at most."""
    return 8 if width <= 8 else 4


def packed(values: np.ndarray, width: int) -> bytes:
    n = lot(width)
    lots = np.zeros(-(-len(values) // n), np.uint64)
    for k in range(n):
        part = values[k::n].astype(np.uint64)
        part <<= np.uint64(k * width)
        lots[: len(part)] |= part
    return lots.astype("<u8").view("u1").reshape(-1, 8)[:, : n * width // 8].tobytes() + bytes(4)  # so that a look-up may read four bytes


def unpacked(held: np.ndarray, width: int, start: int, stop: int) -> np.ndarray:
    n = lot(width)
    size, first = n * width // 8, start // n
    lots = np.zeros((-(-stop // n) - first, 8), "u1")
    lots[:, :size] = held[first * size : (first + len(lots)) * size].reshape(-1, size)
    values = lots.view("<u8") >> (np.arange(n, dtype=np.uint64) * np.uint64(width)) & np.uint64((1 << width) - 1)
    return values.astype(np.uint32).ravel()[start - first * n : stop - first * n]


def directory(goes_on: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The bitmap in words of 64, the ones before every 64th word, and the ones from there to every word."""
    words = np.frombuffer(np.packbits(goes_on, bitorder="little").tobytes() + bytes(-(-len(goes_on) // 8) % 8 and 8 - -(-len(goes_on) // 8) % 8), "<u8")
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1]
    large = before[::64]
    return words.tobytes(), large.astype("<u4").tobytes(), (before - np.repeat(large, 64)[: len(before)]).astype("<u2").tobytes()


def encoded(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole file. starts: of each document, and the end."""
    widths = best_widths(ids)
    sections: list[bytes] = [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes(), starts.astype("<u8").tobytes()]
    left = ids.astype(np.uint32)
    for k, width in enumerate(widths):
        sections.append(packed(left & np.uint32((1 << width) - 1), width))
        if k + 1 < len(widths):
            left = left >> np.uint32(width)
            sections += directory(left > 0)
            left = left[left > 0]
    sizes = [len(x) for x in sections]
    head = json.dumps({"docs": len(doc_ids), "ids": len(ids), "widths": widths, "sizes": sizes}).encode()
    padded = [MAGIC + len(head).to_bytes(8, "little"), head, *sections]
    return b"".join(x + bytes(-len(x) % 8) for x in padded)


class TokenFile:
    """A file in memory, or mapped. take() reads any tokens by their places; document() one document's."""

    def __init__(self, held: bytes | memoryview | pa.Buffer) -> None:
        held = memoryview(held)
        if bytes(held[:8]) != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(held[8:16], "little")
        head = json.loads(bytes(held[16 : 16 + size]))
        at, parts = 16 + size + -size % 8, []
        for n in head["sizes"]:
            parts.append(held[at : at + n])
            at += n + -n % 8
        self.n_ids, self.widths = head["ids"], head["widths"]
        nulls = np.frombuffer(parts[1], "u1").tolist()
        self.doc_ids = [None if null else x for x, null in zip(np.frombuffer(parts[0], "<i8").tolist(), nulls, strict=True)]
        self.starts = np.frombuffer(parts[2], "<u8").astype(np.int64)
        parts = parts[3:]
        self.chunks = [np.frombuffer(x, "u1") for x in parts[::4]]
        self.words, self.large, self.small = ([np.frombuffer(x, kind) for x in parts[k::4]] for k, kind in ((1, "<u8"), (2, "<u4"), (3, "<u2")))

    def __len__(self) -> int:
        return self.n_ids

    def _chunk(self, level: int, at: np.ndarray) -> np.ndarray:
        width, held = self.widths[level], self.chunks[level]
        bit = at * width
        first = bit >> 3
        got = held[first].astype(np.uint32) | held[first + 1].astype(np.uint32) << np.uint32(8) | held[first + 2].astype(np.uint32) << np.uint32(16)
        return got >> (bit & 7).astype(np.uint32) & np.uint32((1 << width) - 1)

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places, in their order."""
        at = np.asarray(places, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.n_ids):
            raise IndexError("no such token")
        out = self._chunk(0, at) if self.n_ids else np.zeros(len(at), np.uint32)
        whose, shift = np.arange(len(at)), 0
        for level in range(len(self.widths) - 1):
            word = self.words[level][at >> 6]
            bit = (at & 63).astype(np.uint64)
            on = (word >> bit & np.uint64(1)).astype(bool)
            at, whose, word, bit = at[on], whose[on], word[on], bit[on]
            at = self.large[level][at >> 12].astype(np.int64) + self.small[level][at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            shift += self.widths[level]
            out[whose] |= self._chunk(level + 1, at) << np.uint32(shift)
        return out

    def at(self, place: int) -> int:
        return int(self.take(np.array([place]))[0])

    def ids(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """The ids of neighbouring places: a look-up in the rank directory says where they go on, the rest is read in order."""
        if not 0 <= start <= stop <= (self.n_ids if not level else stop):
            raise IndexError("no such tokens")
        if start == stop:
            return np.zeros(0, np.uint32)
        out = unpacked(self.chunks[level], self.widths[level], start, stop)
        if level + 1 < len(self.widths):
            first = start >> 6
            on = np.unpackbits(self.words[level][first : (stop + 63) >> 6].view("u1"), bitorder="little")[start - 64 * first : stop - 64 * first].astype(bool)
            before = int(self.large[level][start >> 12]) + int(self.small[level][first]) + (int(self.words[level][first]) & ((1 << (start & 63)) - 1)).bit_count()
            at = on.nonzero()[0]
            out[at] |= self.ids(before, before + len(at), level + 1) << np.uint32(self.widths[level])
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def put(uri: str, content: bytes) -> None:
    """The file under its name, whole or not at all; a repeated task puts the same once more."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    passing = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(passing) as out:
        out.write(content)
    system.move(passing, path)


class FileWriter:
    """The files of one task."""

    def __init__(self, folder: str, part: int, ids_a_file: int) -> None:
        self.folder, self.part, self.most, self.file, self.before, self.out = folder, part, ids_a_file, 0, 0, []
        self.docs: list[int | None] = []
        self.held: list[bytes] = []
        self.size = 0

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(doc)
        self.held.append(ids)
        self.size += len(ids) // 4
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if self.docs:
            uri = f"{self.folder}/ids-{self.part:06d}-{self.file:06d}.bin"
            starts = np.concatenate(([0], np.cumsum([len(x) // 4 for x in self.held])))
            put(uri, encoded(self.docs, starts, np.frombuffer(b"".join(self.held), "<u4")))
            self.out.append((self.part, self.file, uri, len(self.docs), self.size, self.before))
            self.before += self.size
            self.file, self.docs, self.held, self.size = self.file + 1, [], [], 0


def arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, ids_a_file: int = IDS_A_FILE) -> DataFrame:
    """docs: doc_id, text. Writes the files and returns one row for each, see DONE: start_in_part is of the ids that its task's files before it hold, and tasks follow in order of part."""
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    into = full_uri(spark, folder or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, files = encoder(path), FileWriter(into, TaskContext.get().partitionId(), ids_a_file)
        for batch in batches:
            docs, texts = batch["doc_id"].to_pylist(), [x or "" for x in batch["text"].to_pylist()]
            for a, b in at_once(texts, AT_ONCE):
                for doc, ids in zip(docs[a:b], encode(texts[a:b]), strict=True):
                    files.add(doc, ids + end)
        files.close()
        yield arrow(files.out, DONE)

    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", "hash", "place"]
    ranged = rows.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place")).repartitionByRange(partitions(spark), *order)
    return staged(ranged.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, DONE), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """files as of write_token_files. One row for each document, read from the files; see ROWS."""
    spark = files.sparkSession
    before, at = {}, 0
    for part, n in sorted((x["part"], x["n"]) for x in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):  # as many rows as tasks wrote
        before[part], at = at, at + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, uri, first in zip(*(batch[c].to_pylist() for c in ("part", "path", "start_in_part")), strict=True):
                system, path = opened(uri)
                with system.open_input_file(path) as source:
                    held = TokenFile(source.read_buffer())
                starts, first = held.starts.tolist(), first + before[part]
                cuts = [0]
                for k in range(1, len(starts)):  # about a million tokens at once, in whole documents
                    if k + 1 == len(starts) or starts[k] - starts[cuts[-1]] >= 1 << 20:
                        cuts.append(k)
                for a, b in zip(cuts, cuts[1:], strict=False):
                    ids = memoryview(held.ids(starts[a], starts[b]).astype("<u4").tobytes())
                    of = lambda k: ids[4 * (starts[k] - starts[a]) : 4 * (starts[k + 1] - starts[a])]  # noqa: B023, E731
                    yield arrow([(held.doc_ids[k], first + starts[k], starts[k + 1] - starts[k], zlib.crc32(of(k))) for k in range(a, b)], ROWS)

    return files.select("part", "path", "start_in_part").repartition(4 * partitions(spark), "path").mapInArrow(run, ROWS)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))
