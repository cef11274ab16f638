"""Secret scan: fixed forms, and a battery of randomness tests under false-discovery control.

Fixed forms (assignments, access keys, long hex) are always reported. The battery looks at all
runs of 20 and more characters of ``[A-Za-z0-9+/_=-]``. Runs are cut at inner ``=``; what then mixes
``+/`` with ``-_`` is cut at either pair of marks, and of overlapping parts the least p-value stays.
It infers the run's encoding (base16, base32, base36 of either case, base64 of either pair of
marks: the first whose alphabet holds the run) and computes these tests:

* chi-squared uniformity over the encoding's alphabet. Under the null "this is natural text"
  the statistic is a non-central one whose mean and variance follow from fixed letter
  frequencies and the length; its lower tail is a p-value. So is the upper tail of the letters' mean
  surprise under these frequencies, with room (``OVERSPREAD``) for other languages. Twice the
  lesser of both is the alphabet's p-value.
* runs of character classes. Natural text changes class rarely (``TEXT_CHANGE``; a capital at a
  word's start is no change); many changes for the length are the second p-value.
* lag-one serial correlation and the upper chi-squared tail against a random string: a
  candidate that is plainly not random (a counter, a repeated unit) has p-value 1, as have numbers.

Fisher's method joins the two p-values. No candidate leaves before the rule. Benjamini and Hochberg's rule at level ``Q`` then runs
inside each stratum of length over all candidates of the corpus, so short strings, where
the tests are weak, don't borrow strength from long ones. It uses counts of p-values in
``BINS`` fixed logarithmic bins for each stratum (a candidate counts at its bin's upper border), so
the driver receives strata times bins numbers whatever the corpus holds.

Positions are code points, end exclusive. Defined cases: a null text is the empty text; rows
repeat as they come; other columns pass through; empty tables work.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_ready
from .frames import LOWER, blocks, runs_of, text_pass, utf8_view

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
HEX = np.zeros(256, bool)
HEX[0x30:0x3A] = HEX[0x61:0x67] = True
TOKEN = np.zeros(256, bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-":
    TOKEN[_c] = True

Q, LEAST, TEXT_CHANGE, BINS, BIN_WIDTH = 0.01, 20, 0.06, 120, 0.25
UNEVEN, SERIAL, OVERSPREAD = 1e-5, 1e-3, 1.5
STRATA = (20, 24, 32, 40, 64, 128)
#: Letter frequencies of English, a to z, in thousandths (fixed values).
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
ALPHABETS = (
    ("base16", "0123456789abcdef"),
    ("base16", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base32", "abcdefghijklmnopqrstuvwxyz234567"),
    ("base36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def text_power(alphabet: str) -> float:
    """Sum of squared frequencies of the alphabet's symbols in natural text."""
    weight = {c: f for c, f in zip("abcdefghijklmnopqrstuvwxyz", LETTERS)}
    w = [weight.get(c.lower(), 4) * (0.05 if c.isupper() and any(x.islower() for x in alphabet) else 1) for c in alphabet]
    return sum(x * x for x in w) / sum(w) ** 2


POWERS = {a: text_power(a) for _, a in ALPHABETS}


def rarity(letters: str) -> tuple[dict[str, float], float, float]:
    """(surprise of each letter, its mean and variance) in natural text restricted to ``letters``."""
    f = {c: LETTERS[ord(c) - 97] for c in letters}
    surprise = {c: -math.log(x / sum(f.values())) for c, x in f.items()}
    mean = sum(x * surprise[c] for c, x in f.items()) / sum(f.values())
    return surprise, mean, sum(x * (surprise[c] - mean) ** 2 for c, x in f.items()) / sum(f.values())


RARITY = {a: rarity("".join(sorted({c.lower() for c in a if c.isalpha()}))) for _, a in ALPHABETS}


def classes(body: str) -> list[int]:
    """Digit, capital or small letter of each letter and digit; a capital before a small letter starts a word and is small."""
    told = [c for c in body if c.isalnum()]
    return [1 if c.isdigit() else 2 if c.isupper() and not (after and after.islower()) else 0 for c, after in zip(told, [*told[1:], ""])]


def battery(s: str) -> tuple[str, float] | None:
    """(encoding, p-value of "natural text") of a candidate; None if no single alphabet fits.

    The p-value is 1 for what is plainly not random and for numbers: they count as tested.
    """
    body = s.rstrip("=")
    n = len(body)
    for name, alphabet in ALPHABETS:
        if n >= LEAST and not set(body) - set(alphabet):
            break
    else:
        return None
    size = len(alphabet)
    codes = [alphabet.index(c) for c in body]
    counts = [0] * size
    for c in codes:
        counts[c] += 1
    chi = size / n * sum(c * c for c in counts) - n
    df = size - 1
    if body.isdigit() or normal_tail((chi - df) / math.sqrt(2 * df)) < UNEVEN:
        return name, 1.0
    mean = sum(codes) / n
    spread = sum((c - mean) ** 2 for c in codes)
    serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:])) / spread if spread else 1.0
    if 2 * normal_tail(abs(serial + 1 / n) * math.sqrt(n)) < SERIAL:
        return name, 1.0
    extra = n * (size * POWERS[alphabet] - 1)
    p_chi = normal_tail(-(chi - df - extra) / math.sqrt(2 * (df + 2 * extra)))
    surprise, usual, variance = RARITY[alphabet]
    letters = [surprise[c] for c in body.lower() if c in surprise]
    p_rare = normal_tail((sum(letters) - len(letters) * usual) / math.sqrt(OVERSPREAD * len(letters) * variance)) if letters else 1.0
    p_alphabet = min(1.0, 2 * p_chi, 2 * p_rare)
    kind = classes(body)
    changes = sum(a != b for a, b in zip(kind, kind[1:]))
    expected = (n - 1) * TEXT_CHANGE
    p_runs = normal_tail((changes - 0.5 - expected) / math.sqrt(expected * (1 - TEXT_CHANGE)))
    t = -2 * (math.log(max(p_alphabet, 1e-300)) + math.log(max(p_runs, 1e-300)))
    return name, min(1.0, math.exp(-t / 2) * (1 + t / 2))


def fits(body: str) -> bool:
    return any(not set(body) - set(alphabet) for _, alphabet in ALPHABETS)


def candidates(run: str) -> list[tuple[int, int, str, float]]:
    """(start, end, encoding, p-value) of the parts of a run, in order."""

    def judged(pattern: str, lo: int, hi: int):
        for m in re.compile(pattern).finditer(run, lo, hi):
            part = m[0]
            if len(part) >= LEAST and (told := battery(part)) is not None:
                yield (*m.span(), *told)

    out = []
    for m in re.finditer("[^=]+(?:=+$)?", run):
        if fits(m[0].rstrip("=")):
            out += judged(".+", *m.span())
            continue
        taken = []
        for one in sorted([x for marks in ("[^-_]+", "[^+/]+") for x in judged(marks, *m.span())], key=lambda x: (x[3], x[0], -x[1])):
            if all(one[1] <= a or one[0] >= b for a, b, *_ in taken):
                taken.append(one)
        out += sorted(taken)
    return out


def base_spans(text: str, hexes: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Fixed forms, by start and then kind; ``hexes`` are their code point borders."""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(a, 2, b, "hex") for a, b in hexes]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def find_all(raw: bytes, what: bytes) -> list[int]:
    out, at = [], raw.find(what)
    while at >= 0:
        out.append(at)
        at = raw.find(what, at + 1)
    return out


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
CANDIDATE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("bin", pa.int32()), ("stratum", pa.int32())]))
ADDED = "base array<struct<start:bigint,end:bigint,kind:string>>, candidates array<struct<start:bigint,end:bigint,kind:string,bin:int,stratum:int>>"


def scan_block(data: np.ndarray, offsets: np.ndarray):
    """(base spans, candidates) of each row of a block."""
    n_rows = len(offsets) - 1
    base: list[list] = [[] for _ in range(n_rows)]
    cands: list[list] = [[] for _ in range(n_rows)]
    lowered = LOWER[data].tobytes()
    raw = data.tobytes()
    spots = [x for k in KEYWORDS for x in find_all(lowered, k)] + find_all(raw, b"AKIA")
    ha, hb = runs_of(HEX[data], offsets)
    long = hb - ha >= 32
    ha, hb = ha[long], hb[long]
    ta, tb = runs_of(TOKEN[data], offsets)
    long = tb - ta >= LEAST
    ta, tb = ta[long], tb[long]
    row_of = lambda x: np.searchsorted(offsets, x, side="right") - 1
    rows = np.unique(np.concatenate((row_of(np.array(spots, np.int64)), row_of(ha), row_of(ta)))).astype(int)
    hrow, trow = row_of(ha), row_of(ta)
    for r in rows.tolist():
        a, b = int(offsets[r]), int(offsets[r + 1])
        chars = np.append(0, np.cumsum((data[a:b] & 0xC0) != 0x80))
        text = raw[a:b].decode("utf-8", "replace")
        at = lambda x, lo, hi: [(int(chars[p - a]), int(chars[q - a])) for p, q in zip(x[0][lo:hi].tolist(), x[1][lo:hi].tolist())]
        lo, hi = np.searchsorted(hrow, [r, r + 1])
        base[r] = [{"start": s, "end": e, "kind": k} for s, e, k in base_spans(text, at((ha, hb), lo, hi))]
        lo, hi = np.searchsorted(trow, [r, r + 1])
        for s, e in at((ta, tb), lo, hi):
            for a, b, kind, p in candidates(text[s:e]):
                rank = min(BINS - 1, int(-math.log10(max(p, 1e-300)) / BIN_WIDTH))
                cands[r].append({"start": s + a, "end": s + b, "kind": kind, "bin": rank, "stratum": max(k for k, v in enumerate(STRATA) if b - a >= v)})
    return base, cands


def thresholds(found: DataFrame) -> dict[int, int]:
    """The least bin that Benjamini and Hochberg's rule takes, for each stratum that has one."""
    counts: dict[int, dict[int, int]] = {}
    for s, b, n in found.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").count().collect():
        counts.setdefault(s, {})[b] = n
    out = {}
    for s, by_bin in counts.items():
        total, seen = sum(by_bin.values()), 0
        for b in sorted(by_bin, reverse=True):
            seen += by_bin[b]
            if 10 ** (-b * BIN_WIDTH) <= Q * seen / total:
                out[s] = b
    return out


def scan(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``base`` and ``found``: arrays of (start, end, kind), the second with the battery's spans too.

    The scan's spans (not the texts) are checkpointed: the rule needs them twice.
    """

    def kernel(col: pa.Array) -> list[pa.Array]:
        base, cands = [], []
        for _, _, data, offs in blocks(*utf8_view(col)):
            b, c = scan_block(data, offs)
            base.extend(b), cands.extend(c)
        return [pa.array(base, SPAN), pa.array(cands, CANDIDATE)]

    checkpoint_ready(df.sparkSession)
    found = text_pass(df, text_col, kernel, ADDED, keep).checkpoint()
    limit = thresholds(found)
    passes = lambda c: F.lit(False) if not limit else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in limit.items() for x in kv]), c["stratum"]) <= c["bin"], F.lit(False))
    own = F.filter("candidates", lambda c: passes(c) & ~F.exists("base", lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
    more = F.transform(own, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    return found.withColumn("found", F.concat("base", more)).drop("candidates")


KINDS = ("assign", "access", "hex", "base16", "base32", "base36", "base64")


def spell(spans) -> F.Column:
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("b"), s["end"].alias("c"), s["kind"].alias("d")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["d"], s["a"].cast("string"), s["c"].cast("string"))), ",")


def query(spark, sf_dir):
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spell(F.col("base")), 256).alias("base_sha256"), spell(F.col("found")).alias("spans"))
