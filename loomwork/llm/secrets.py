"""Secret scan: fixed patterns plus a token-efficiency test for random strings.

Ordinary words and identifiers are cheap under a BPE vocabulary (three or more characters a token);
random strings are dear (under two). A run of key-like characters whose characters-per-token ratio is
low, and which is not a known digest, UUID or plain number, is reported as ``random``; on letters, paths and names
the ratio alone decides.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import chunks, read

KINDS = ("assign", "access", "hex")
VOCABULARY = "byte_bpe_50k.tiktoken"

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
NUMBER = re.compile(r"[0-9]+(?:[-_/+=T]+[0-9]+)*Z?")  # dates, times, phone and card numbers too


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed kinds, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


@lru_cache(maxsize=2)
def encoder(path: str):
    import public_tokenizers as tok
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=tok.PATTERN, mergeable_ranks=ranks, special_tokens={})


def excluded(run: str) -> bool:
    """Known digests, identifiers and plain numbers: no secrets, however few characters a token they have."""
    return bool(UUID.fullmatch(run) or NUMBER.fullmatch(run) or (len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run)))


def random_spans(text: str, path: str, ratio: float, shortest: int) -> list[tuple[int, int]]:
    """Runs of at least ``shortest`` key-like characters with fewer than ``ratio`` characters a token."""
    out = []
    for m in RUN.finditer(text):
        run = m.group().strip("=-_/+")
        if len(run) < shortest or excluded(run):
            continue
        if len(run) < ratio * len(encoder(path).encode_ordinary(run)):
            start = m.start() + m.group().index(run)
            out.append((start, start + len(run)))
    return out


def scan(text: str | None, path: str, ratio: float, shortest: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    text = text or ""
    return base_spans(text), random_spans(text, path, ratio, shortest)


def digest_of(base: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()


def find_secrets(docs: DataFrame, vocabulary: str | None = None, ratio: float = 2.2, shortest: int = 16) -> DataFrame:
    """Secrets of every whole text of ``docs(doc_id, text, ...)``.

    Returns doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans (``kind:start:end`` by start,
    code points, end exclusive).
    ``vocabulary`` is the path of a ``.tiktoken`` file. A null or empty text has no spans; rows are scanned
    one by one, so repeated rows give repeated results; other columns are ignored; an empty table gives none.
    """
    if vocabulary is None:
        import public_tokenizers as tok

        vocabulary = tok.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in chunks(whole, "text"):
                rows = []
                for text in b.column("text").to_pylist():
                    base, more = scan(text, vocabulary, ratio, shortest)
                    kinds = [k for _, k, _ in base]
                    every = sorted([*base, *((s, len(KINDS), e) for s, e in more)])
                    spans = ",".join(f"{(*KINDS, 'random')[k]}:{s}:{e}" for s, k, e in every)
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more), digest_of(base), spans))
                types = [pa.int64()] * 4 + [pa.string()] * 2
                names = ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string")


def cover(text: str | None, spans: list[tuple[int, int]], word: str) -> str | None:
    """``text`` with the union of ``spans`` replaced, each joint stretch by one ``word``."""
    if not spans:
        return text
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], word]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, word: str = "[SECRET]", vocabulary: str | None = None, ratio: float = 2.2, shortest: int = 16) -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``word`` and ``n_chars`` brought up to date.

    All rows stay, and so do all other columns; a null text stays null.
    """
    if vocabulary is None:
        import public_tokenizers as tok

        vocabulary = tok.path(VOCABULARY)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            base, more = scan(text, vocabulary, ratio, shortest)
            return cover(text, [(s, e) for s, _, e in base] + more, word)

        return pd.Series([one(x) for x in texts], dtype=object)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))
