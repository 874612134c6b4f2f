"""Secret scan: known forms by pattern, unknown ones by a battery of randomness tests.

A candidate is a longest run of 20 or more characters of an encoding's alphabet. Runs of the union of the alphabets
are split at '=', so that names, values and padding part; where no one alphabet has all of what is left, the longest
runs of each are candidates, and may overlap. A candidate's encoding is inferred (hex in either case, base 32,
base 64) and three tests ask whether it could be random in that alphabet: chi-squared
uniformity of the characters, Wald-Wolfowitz runs about the alphabet's middle, and serial correlation at lag one. The
three probabilities are combined by Fisher's method. How long a run must be for this to tell it from words is settled
by false-discovery control: a run has a decoy, words of the text before it run together to the same length and
tested alike, or of the text after it where there are too few before; over all documents, by encoding and length, the
share of decoys that reach a level, taken for all runs of the class, estimates the false discoveries there, and the
lowest level whose estimate is within FALSE is the threshold for runs of that encoding and length. Decoys of runs up to
a third shorter count with a class's own, since words look random the more easily the shorter they are; where they are
fewer than a tenth of the runs, so do those of all shorter runs, and at last of other encodings. Beyond the highest decoy
the estimate falls as the decoys' upper tenth does. A class without enough decoys even so, or without such a level, short
runs most of all, has no discoveries.

Null and empty texts have no spans, and so has every row of an empty table. Repeated rows get a row each, rows without a
doc_id too. Texts of any length are scanned whole, in one pass. Spans that start together are listed by kind, and two
of one kind by their end. Other columns, whatever they are called, are neither read nor changed.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritrail.llm.common import in_small_batches, staged, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Kinds in the order in which equal places are listed.
KINDS = ("assign", "access", "hex", "random")
LEAST = 20
RUN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
FALSE = 0.01
#: Levels of the combined probability, as its negative logarithm falls.
LEVELS = 40
ALPHABETS = {
    "hex": b"0123456789abcdef",
    "HEX": b"0123456789ABCDEF",
    "base32": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Longest runs of each alphabet.
PARTS = [re.compile(rb"[%s]{%d,}" % (re.escape(v), LEAST)) for v in ALPHABETS.values()]
CODES = {k: np.array([v.find(bytes([c])) for c in range(256)], np.int64) for k, v in ALPHABETS.items()}
SPANS = "array<struct<kind:int,start:long,end:long,encoding:string,size:int,level:int,decoy:int>>"


def encoding_of(run: bytes) -> str | None:
    """The smallest alphabet that has every character; padding at the end is left out by the caller."""
    return next((k for k, codes in CODES.items() if (codes[np.frombuffer(run, np.uint8)] >= 0).all()), None)


def cores(run: bytes) -> list[tuple[int, int, str]]:
    """(start, end, encoding) of what is tested of a run."""
    out = set()
    for piece in re.finditer(rb"[^=]+", run):
        places = [piece.span()]
        if not encoding_of(piece[0].strip(b"-_/+")):
            places = [m.span() for part in PARTS for m in part.finditer(run, *piece.span())]
        for a, b in places:
            core = run[a:b].strip(b"-_/+")
            if len(core) >= LEAST:
                a += run[a:b].find(core)
                out.add((a, a + len(core), encoding_of(core)))
    return sorted(out)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(codes: np.ndarray, k: int) -> float:
    """Fisher's combined probability of the three tests, for n symbols out of k."""
    n = len(codes)
    chi = float(((np.bincount(codes, minlength=k) - n / k) ** 2).sum() * k / n)
    v = k - 1
    uniform = 0.5 * math.erfc(((chi / v) ** (1 / 3) - 1 + 2 / (9 * v)) / math.sqrt(2 / (9 * v)) / math.sqrt(2))
    high = codes >= k // 2
    a = int(high.sum())
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        spread = (mean - 1) * (mean - 2) / max(n - 1, 1)
        runs = _two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    x = codes - (k - 1) / 2
    serial = _two_sided(float((x[1:] * x[:-1]).sum()) / ((k * k - 1) / 12 * math.sqrt(n - 1)))
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, runs, serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def level(p: float) -> int:
    """0 for the least random; LEVELS - 1 for probabilities near one."""
    return max(0, LEVELS - 1 - int(-math.log(max(p, 1e-300))))


def length_class(n: Column) -> Column:
    """Lengths by eighths of a doubling."""
    return F.floor(F.log2(n) * 8).cast("int")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, of the three known forms."""
    low = text.encode("utf-8", "surrogatepass").lower()
    out = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if any(x.encode() in low for x in NAMES) else []
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out


def beside(data: bytes, start: int, end: int, n: int) -> np.ndarray:
    """The n letters and digits next before a place, or next after it where there are fewer before; as many as there are where both are too few."""
    letters = lambda part: (x := np.frombuffer(part, np.uint8))[CODES["alnum"][x] >= 0]
    words = np.zeros(0, np.uint8)
    for a, b, last in ((max(0, start - 8 * n), start, True), (0, start, True), (end, end + 8 * n, False), (end, len(data), False)):
        if len(words) < n:
            found = letters(data[a:b])
            words = found[-n:] if last else found[:n]
    return words


def candidates(text: str | None) -> list[tuple]:
    """SPANS of one text: the known forms (no level), and the tested runs with their level and their decoy's."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    out = [(k, a, b, None, None, None, None) for k, a, b in base_spans(text)]
    ascii_only = len(data) == len(text)
    a = upto = 0
    for m in RUN.finditer(data):
        a = m.start() if ascii_only else a + len(data[upto : m.start()].decode("utf-8", "surrogatepass"))
        run, upto = m[0], m.start()
        out += [(2, a + h.start(), a + h.end(), None, None, None, None) for h in HEX.finditer(run.decode())]
        for start, end, kind in cores(run):
            codes, k, n = CODES[kind], len(ALPHABETS[kind]), end - start
            words = beside(data, m.start(), m.end(), n)
            fake = (CODES[kind][words] if (CODES[kind][words] >= 0).all() else words.astype(np.int64) % k) if len(words) == n else None
            out.append((3, a + start, a + end, kind, n, level(randomness(codes[np.frombuffer(run[start:end], np.uint8)], k)), None if fake is None else level(randomness(fake, k))))
    return out


def tested(text: Column) -> Column:
    """SPANS of each text, before the thresholds."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([candidates(x) for x in texts.tolist()], dtype=object)

    return F.pandas_udf(run, SPANS)(text)


#: The least share of a class's runs that must have decoys, and how many classes of length down they are counted with.
ENOUGH, NEAR = 0.1, 4


def expected(runs: int, fakes: np.ndarray) -> np.ndarray:
    """Of so many runs how many words would be among those that reach each level. fakes: decoys by level. Beside the counted ones a decoy is doubted, in full up to the highest that was seen, and from there on falling as the upper tenth of the decoys falls."""
    n = fakes.sum()
    above = np.cumsum(fakes[::-1])[::-1]
    upper = int(np.flatnonzero(above >= 0.1 * n)[-1])  # the level that a tenth of the decoys reach
    levels = np.arange(LEVELS)
    top = int(np.flatnonzero(fakes)[-1])
    scale = 1.0 + float((fakes * np.maximum(levels - upper, 0)).sum() / above[upper])
    return runs * (above / n + np.exp(-np.maximum(levels - top, 0) / scale) / (n + 1))


def thresholds(found: DataFrame, false: float = FALSE) -> dict[tuple[str, int], int]:
    """By encoding and class of length the lowest level whose estimated share of false discoveries is within the bound. What comes to the driver are counts by encoding, class and level: at most some 60,000 rows, however many runs there are."""
    each = found.select(F.explode("spans").alias("s")).where("s.kind = 3").select("s.encoding", length_class(F.col("s.size")).alias("length"), "s.level", "s.decoy")
    counts: dict[tuple[str, int], np.ndarray] = {}
    for place, column in enumerate(("level", "decoy")):
        for row in each.where(F.col(column).isNotNull()).groupBy("encoding", "length", F.col(column).alias("at")).agg(F.count("*").alias("n")).collect():
            counts.setdefault((row["encoding"], row["length"]), np.zeros((2, LEVELS), np.int64))[place, row["at"]] = row["n"]
    return levels_of(counts, false)


def levels_of(counts: dict[tuple[str, int], np.ndarray], false: float = FALSE) -> dict[tuple[str, int], int]:
    """thresholds() of counted runs and decoys: two rows for each class, by level."""
    least = {}
    for (encoding, length), (seen, _) in counts.items():
        runs = seen.sum()
        of = lambda own, near: sum((x[1] for (e, n), x in counts.items() if (e == encoding or not own) and length - near < n <= length), np.zeros(LEVELS, np.int64))  # noqa: B023, E731
        # decoys of a little shorter runs, else of all shorter ones, else of other encodings too
        fakes = next((x for x in (of(True, NEAR), of(True, 1 << 10), of(False, 1 << 10)) if x.sum() > 0 and x.sum() >= ENOUGH * runs), None)
        if fakes is not None:
            above = np.cumsum(seen[::-1])[::-1]
            good = np.flatnonzero((above > 0) & (expected(runs, fakes) <= false * above))
            if len(good):
                least[encoding, length] = int(good[0])
    return least


def kept(found: DataFrame, false: float = FALSE) -> Column:
    """Of the column spans those that count, as an array of start, kind, end, by start then kind. The levels sent out are as many as there are encodings and classes of lengths at most."""
    levels = [F.lit(x) for (encoding, length), least in thresholds(found, false).items() for x in (f"{encoding}:{length}", least)]
    least = F.create_map(*levels) if levels else F.create_map(F.lit(""), F.lit(LEVELS))
    held = F.filter("spans", lambda s: s["level"].isNull() | (s["level"] >= F.coalesce(F.try_element_at(least, F.concat_ws(":", s["encoding"], length_class(s["size"]).cast("string"))), F.lit(LEVELS))))
    return F.array_sort(F.transform(held, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def scan(docs: DataFrame, false: float = FALSE) -> DataFrame:
    """docs: doc_id, text. doc_id, spans (array of start, kind, end, by start then kind) for each row; code points, end exclusive."""
    found = staged(in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), tested(F.col("text").cast("string")).alias("spans")), "secrets")
    return found.select("doc_id", kept(found, false).alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]", false: float = FALSE) -> DataFrame:
    """docs: text and any other columns. The same rows with every span of scan() replaced; what touches or overlaps is replaced once."""
    others = [c for c in docs.columns if c != "text"]
    found = staged(in_small_batches(docs).select(F.struct(F.lit(0).alias("held"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(others)]).alias("row"), F.col("text").cast("string").alias("text"), tested(F.col("text").cast("string")).alias("spans")), "secrets")
    piece = lambda a, b: F.substring("text", a + 1, b - a)
    begun = F.struct(F.lit("").alias("out"), F.lit(-1).cast("long").alias("done"))
    step = lambda acc, s: F.struct(F.when(s["start"] > acc["done"], F.concat(acc["out"], piece(F.greatest(acc["done"], F.lit(0).cast("long")), s["start"]), F.lit(mask))).otherwise(acc["out"]).alias("out"), F.greatest(acc["done"], s["end"]).alias("done"))
    clean = F.aggregate("held", begun, step, lambda acc: F.concat(acc["out"], piece(acc["done"], F.length("text").cast("long"))))
    held = found.select("row", "text", kept(found, false).alias("held"))
    return held.select(F.when(F.size("held") > 0, clean).otherwise(F.col("text")).alias("clean"), "row").select(*[F.col("clean").alias("text") if c == "text" else F.col("row")[f"c{others.index(c)}"].alias(c) for c in docs.columns])


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


