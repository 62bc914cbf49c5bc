"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The vocabulary file fixes the result: NFC, white space runs to one space, lower case, split into pieces,
bytes to printable characters, ``</w>`` on a piece's last symbol, then merges. A piece is merged through a
segment tree whose leaves hold the ranks of adjacent pairs: the root is the leftmost lowest-ranked pair, and
a merge changes three leaves, each in logarithmic time. Merged pieces are cached per worker, in bounded space.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomwork.llm.common import chunks, read

VOCABULARY = "word_bpe_49k.json"
NONE = 1 << 62
CACHED = 400_000

# Fixed value: how the vocabulary's pre-tokenizer cuts a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """``ids`` after all merges. ``pairs``: left id << 16 | right id to rank << 16 | merged id.

    Leaf i of the tree holds rank << 24 | i of the pair that starts at symbol i, NONE where there is none,
    so the minimum at the root is the leftmost pair of the lowest rank. ``ids`` is used up.
    """
    n = len(ids)
    if n < 2:
        return ids
    if n == 2:
        found = pairs.get(ids[0] << 16 | ids[1])
        return ids if found is None else [found & 0xFFFF]
    shift = max(24, n.bit_length())
    width = 1 << (n - 2).bit_length()
    get = pairs.get
    leaves = [NONE if (f := get(a << 16 | b)) is None else (f >> 16) << shift | i for i, (a, b) in enumerate(zip(ids, ids[1:]))]
    leaves += [NONE] * (width - n + 1)
    levels = [leaves]
    while len(leaves) > 1:
        leaves = list(map(min, leaves[::2], leaves[1::2]))
        levels.append(leaves)
    tree = [NONE]
    for level in reversed(levels):
        tree += level
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    mask = (1 << shift) - 1
    while (top := tree[1]) != NONE:
        i = top & mask
        j = after[i]
        k = after[j]
        left = before[i]
        ids[i] = new = get(ids[i] << 16 | ids[j]) & 0xFFFF
        ids[j] = -1
        after[i] = k
        if k < n:
            before[k] = i
            f = get(new << 16 | ids[k])
            changed = [(j, NONE), (i, NONE if f is None else (f >> 16) << shift | i)]
        else:
            changed = [(i, NONE)]
        if left >= 0:
            f = get(ids[left] << 16 | new)
            changed.append((left, NONE if f is None else (f >> 16) << shift | left))
        for at, key in changed:
            at += width
            while tree[at] != key:
                tree[at] = key
                other = tree[at ^ 1]
                if other < key:
                    key = other
                at >>= 1
                if not at:
                    break
    return [x for x in ids if x >= 0]


class Merges:
    """The same segment trees for many short pieces at once, one row of numpy arrays for each piece."""

    def __init__(self, pairs: dict[int, int]) -> None:
        self.keys = np.array(sorted(pairs), "i8")
        found = np.array([pairs[k] for k in self.keys.tolist()], "i8")
        self.ranks = found >> 16
        self.merged = np.zeros(len(found) + 1, "i8")
        self.merged[self.ranks] = found & 0xFFFF

    def leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rank << 24 | at of each pair, NONE where there is none or a symbol is missing (-1)."""
        pair = left << 16 | right
        i = np.searchsorted(self.keys, pair)
        i[i == len(self.keys)] = 0
        return np.where((self.keys[i] == pair) & (left >= 0) & (right >= 0), self.ranks[i] << 24 | at, NONE)

    def run(self, ids: np.ndarray, sizes: np.ndarray, width: int) -> None:
        """Merge in place. ids: (pieces, width + 1), -1 behind each piece's end; width a power of two."""
        rows, n = ids.shape
        tree = np.full((rows, 2 * width), NONE, "i8")
        tree[:, width:] = self.leaf(ids[:, :-1].ravel(), ids[:, 1:].ravel(), np.tile(np.arange(width), rows)).reshape(rows, width)
        for i in range(width.bit_length() - 2, -1, -1):
            a = 1 << i
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        after = np.tile(np.arange(1, n + 2), (rows, 1))  # one more column for the place behind the last symbol
        before = np.tile(np.arange(-1, n), (rows, 1))
        wide = np.concatenate([ids, np.full((rows, 1), -1, "i8")], axis=1)
        flat, ids1, after1, before1 = tree.ravel(), wide.ravel(), after.ravel(), before.ravel()
        r = np.arange(rows)
        while True:
            top = tree[r, 1]
            live = top != NONE
            r, top = r[live], top[live]
            if not len(r):
                break
            t, w = r * (2 * width), r * (n + 1)
            i = top & 0xFFFFFF
            j = after1[w + i]
            k = np.minimum(after1[w + j], n)
            new = self.merged[top >> 24]
            ids1[w + i], ids1[w + j] = new, -1
            after1[w + i] = k
            before1[w + k] = i
            left = before1[w + i]
            has = left >= 0
            flat[t + width + np.minimum(j, width - 1)] = NONE
            inner = i < width
            flat[(t + width + i)[inner]] = self.leaf(new, ids1[w + k], i)[inner]
            tl, wl, left = t[has], w[has], left[has]
            flat[tl + width + left] = self.leaf(ids1[wl + left], new[has], left)
            base = np.concatenate([t, t, tl])
            node = np.concatenate([i, np.minimum(j, width - 1), left]) + width
            node >>= 1
            while node[0]:
                child = base + 2 * node
                flat[base + node] = np.minimum(flat[child], flat[child + 1])
                node >>= 1
        ids[:] = wide[:, :-1]


class Codec:
    """Encoder and decoder of one vocabulary file. A small helper inside tasks; Spark spreads the texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + end) for s in symbols]
        self.pairs = {vocab[a] << 16 | vocab[b]: rank << 16 | vocab[a + b] for rank, (a, b) in enumerate(model["merges"])}
        self.many = Merges(self.pairs)
        self.first_ids, self.last_ids = (np.array([-1 if i is None else i for i in x], "i8") for x in (self.inner, self.last))
        assert None not in self.inner + self.last, "every byte has a symbol"
        assert max(vocab.values()) < 1 << 16, "ids of two bytes are assumed"
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max((vocab | self.special).values()) + 1)
        for name, i in (vocab | self.special).items():
            self.names[i] = name
        self.bytes = {s: b for b, s in enumerate(symbols)}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        near = [chr(i) for i in range(0x300)]
        letters, digits, spaces = ("".join(f"\\U{ord(c):08x}" for c in near if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
        # the same pattern for texts below U+0300, in the faster module
        self.find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+").findall
        self.odd = regex.compile(r"[^\x00-˿]").search  # below U+0300 NFC changes nothing and lower() has no context rules
        self.library = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}

    def piece(self, word: str, raw: bytes | None = None) -> bytes:
        """The ids of one piece, as little-endian unsigned 32-bit integers."""
        raw = raw or word.encode("utf-8")
        inner = self.inner
        ids = [inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        out = array("I", merge(ids, self.pairs)).tobytes()
        self.cache[word] = out
        return out

    def pieces(self, words: list[str]) -> None:
        """Put all ``words`` in the cache: those of up to 33 bytes by rows of numpy, longer ones one by one."""
        raws = [w.encode("utf-8") for w in words]
        sizes = np.array([len(x) for x in raws], "i8")
        done = 1
        for width in (2, 4, 8, 16, 32):
            chosen = np.flatnonzero((sizes > done) & (sizes <= width + 1) if done > 1 else sizes <= width + 1)
            done = width + 1
            for at in range(0, len(chosen), 1 << 14):
                some = chosen[at : at + (1 << 14)]
                n = sizes[some]
                raw = np.frombuffer(b"".join([raws[i] for i in some]), "u1")
                flat, ends = self.first_ids[raw], np.cumsum(n)
                flat[ends - 1] = self.last_ids[raw[ends - 1]]
                ids = np.full((len(some), width + 1), -1, "i8")
                ids[np.arange(width + 1) < n[:, None]] = flat
                self.many.run(ids, n, width)
                stay = ids >= 0
                out, stops = ids[stay].astype("<u4").tobytes(), (4 * np.cumsum(stay.sum(1))).tolist()
                start = 0
                for i, stop in zip(some.tolist(), stops):
                    self.cache[words[i]] = out[start:stop]
                    start = stop
        for i in np.flatnonzero(sizes > done).tolist():
            self.piece(words[i], raws[i])

    def learn(self, texts: list[str | None]) -> None:
        """Merge what these texts have and the cache has not; encoding them finds every plain piece there."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        fresh: set[str] = set()
        for text in texts:
            if text and not self.odd(text):
                fresh.update(set(self.find(text.lower())).difference(self.cache))
        self.pieces(list(fresh))

    def plain(self, text: str) -> bytes:
        got, piece = self.cache.get, self.piece
        if not self.odd(text):
            return b"".join([got(w) or piece(w) for w in self.find(text.lower())])
        # beyond Latin the library's own Unicode tables decide where pieces end; they come as byte symbols
        normal = self.library.normalizer.normalize_str(text)
        raws = [bytes(map(self.bytes.__getitem__, w)) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return b"".join([got(w := "\0" + raw.decode("latin-1")) or piece(w, raw) for raw in raws])

    def encode(self, text: str) -> bytes:
        """Special tokens' own strings are found before anything else, as in the vocabulary's library."""
        if "<|" not in text:
            return self.plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.plain(text[at : m.start()]), np.array([self.special[m.group()]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """Without a decoder in its file, the library joins the tokens by spaces."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode every whole text of ``docs(doc_id, text, ...)``.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, with ``keep_ids`` also ids and decoded, and the
    columns named in ``keep``. A null or empty text has no tokens; repeated rows give repeated results; columns
    that aren't kept are ignored; an empty table gives none.
    """
    if vocabulary is None:
        import public_tokenizers as tok

        vocabulary = tok.path(VOCABULARY)
    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", *keep, "text")
    schema = T.StructType([slim.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *(slim.schema[k] for k in keep)])
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType())).add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for whole in batches:
            for b in chunks(whole, "text"):
                counts, digests, texts, every, back = [], [], [], [], []
                every_text = b.column("text").to_pylist()
                c.learn(every_text)
                for text in every_text:
                    ids = c.encode(text or "")
                    decoded = c.decode(ids)
                    counts.append(len(ids) // 4)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    texts.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    if keep_ids:
                        every.append(np.frombuffer(ids, "<u4").astype("i8"))
                        back.append(decoded)
                cols = [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string()), *(b.column(k) for k in keep)]
                if keep_ids:
                    cols += [pa.array(every, pa.list_(pa.int64())), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return slim.mapInArrow(run, schema)


def op3_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
