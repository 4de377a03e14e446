"""Byte-level BPE encoding and decoding with a lexicon of the corpus's frequent words.

The frequent words are counted over the whole table, encoded once on the driver, and compiled with their ids into a
memory-mapped transducer (``lexicon``). A task looks its distinct words up there and merges the others exactly, pair by
pair in rank order. The lexicon only saves time: ids never depend on what it holds."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import tempfile
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pendscope.llm import lexicon
from pendscope.llm.common import stored

TOKENIZER = "byte_bpe_50k.json"
LEXICON_WORDS = 65_536  # bound on what is compiled on the driver and broadcast (some five MB)
LEAST_COUNT = 2  # a word seen once is not frequent
GROUP_CHARS = 100_000  # texts are worked on together up to this many characters
KEPT_CHUNKS = 120_000  # bound on the distinct chunks a task remembers

# In texts of these characters ``re`` tells letters, numbers and space as the tokenizer does; the tests check every one.
_PLAIN = re.compile("[\t-\r -\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ʯΑ-ΡΣ-ϿЀ-ҁ‐-‧‰-⁞₠-₿]*")
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")  # no token of the pattern below crosses the end of a chunk
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are themselves, the others
    follow from code point 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def read_tokenizer(path: str) -> dict[str, np.ndarray]:
    """Ids of the bytes, merges as (left, right, result) in rank order, each token's bytes, and the special tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab = spec["model"]["vocab"]
    letters = byte_letters()
    byte_of = {letter: b for b, letter in enumerate(letters)}
    special = {token["content"]: token["id"] for token in spec["added_tokens"]}
    spelled = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()} | {i: token.encode() for token, i in special.items()}
    tokens = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return {
        "byte_ids": np.array([vocab[letter] for letter in letters], np.int32),
        "merges": np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int32).reshape(-1),
        "token_starts": np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64),
        "token_bytes": np.frombuffer(b"".join(tokens), np.uint8),
        "special_ids": np.array(list(special.values()), np.int32),
        "special_names": np.frombuffer("\n".join(special).encode(), np.uint8),
    }


class Merger:
    """Exact merges of words: of each word the pair of least rank, leftmost first, until none is left."""

    LONG = 64  # longer words go one by one over a heap

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.byte_ids = np.asarray(arrays["byte_ids"])
        merges = np.asarray(arrays["merges"]).reshape(-1, 3).astype(np.int64)
        pairs = merges[:, 0] << 32 | merges[:, 1]
        self.order = np.argsort(pairs, kind="stable")
        self.pairs, self.made, self.none = pairs[self.order], merges[:, 2], len(merges)
        self._ranks: dict | None = None

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.order[at], self.none)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one word after the other, and the number of ids of each word. The words are merged together, one pair
        of each word at a time; words without a pair drop out."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        done = [np.empty(0, np.int64)] * len(words)
        for k in np.nonzero(sizes > self.LONG)[0]:
            done[k] = np.array(self._long(self.byte_ids[np.frombuffer(words[k], np.uint8)].tolist()), np.int64)
        short = np.nonzero((sizes > 0) & (sizes <= self.LONG))[0]
        ids = self.byte_ids[np.frombuffer(b"".join([words[k] for k in short]), np.uint8)].astype(np.int64)
        word = np.repeat(short, sizes[short])
        rank = np.full(len(ids), self.none, np.int64)
        if len(ids):
            rank[:-1] = np.where(word[1:] == word[:-1], self._rank(ids[:-1], ids[1:]), self.none)
        ended_ids, ended_words = [], []
        while len(ids):
            starts = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            over = best == self.none
            if over.any():
                ended_ids.append(ids[over])
                ended_words.append(word[over])
                ids, word, rank, best = ids[~over], word[~over], rank[~over], best[~over]
                continue
            at = np.nonzero(rank == best)[0]
            at = at[np.concatenate([[True], word[at][1:] != word[at][:-1]])]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol before each was dropped with every earlier merge
            ids, word, rank = ids[keep], word[keep], rank[keep]
            for left in (at, at - 1):
                inside = (left >= 0) & (left + 1 < len(ids))
                left = left[inside]
                rank[left] = np.where(word[left] == word[left + 1], self._rank(ids[left], ids[left + 1]), self.none)
            rank[-1] = self.none
        ids, word = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ended_ids, ended_words))
        order = np.argsort(word, kind="stable")
        lengths = np.bincount(word, minlength=len(words)).astype(np.int64)
        if not any(map(len, done)):
            return ids[order], lengths
        for k, part in zip(short, np.split(ids[order], np.cumsum(lengths[short])[:-1])):
            done[k] = part
        return np.concatenate(done), np.fromiter(map(len, done), np.int64, len(done))

    def _long(self, ids: list) -> list[int]:
        """The same order of merges with a heap, for long words."""
        if self._ranks is None:
            self._ranks = {(int(p >> 32), int(p & 0xFFFFFFFF)): (int(r), int(self.made[r])) for p, r in zip(self.pairs, self.order)}
        ranks, n = self._ranks, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[pair][0], at, pair) for at, pair in enumerate(zip(ids, ids[1:])) if pair in ranks]
        heapq.heapify(heap)
        while heap:
            _, at, pair = heapq.heappop(heap)
            right = after[at]
            if ids[at] is None or right >= n or (ids[at], ids[right]) != pair:
                continue  # one of the two is gone
            ids[at], ids[right] = ranks[pair][1], None
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < n and (pair := (ids[left], ids[after[left]])) in ranks:
                    heapq.heappush(heap, (ranks[pair][0], left, pair))
        return [i for i in ids if i is not None]


class _Codes(dict):
    """Chunk to code; a new chunk gets the next code and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, chunk):
        self[chunk] = code = len(self)
        self.new.append(chunk)
        return code


def _gather(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``table`` one after the other."""
    ends = np.cumsum(lengths)
    return table[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    """Encoder and decoder over the arrays of a packed file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.merge = Merger(arrays)
        names = arrays["special_names"].tobytes().decode()
        self.special = dict(zip(names.split("\n"), arrays["special_ids"].tolist())) if names else {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pre_tokenizer = None
        self.forget()

    def forget(self) -> None:
        self.codes = _Codes()
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def chunks(self, text: str) -> list:
        """Chunks of a text. A tuple is a word that needs no further splitting, an int a special token."""
        if self.split and any(name in text for name in self.special):
            parts = self.split.split(text)
            return list(chain.from_iterable([self.special[p]] if k % 2 else self.chunks(p) for k, p in enumerate(parts)))
        if _PLAIN.fullmatch(text):
            return _CHUNK.findall(text)
        if self.pre_tokenizer is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=True)
        return [(text[a:b],) for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]

    def _learn(self) -> None:
        """Ids of the new chunks."""
        new, self.codes.new = self.codes.new, []
        words = [[] if isinstance(c, int) else [c[0].encode()] if isinstance(c, tuple) else [w.encode() for w in _WORD.findall(c)] for c in new]
        index: dict[bytes, int] = {}
        flat = np.fromiter((index.setdefault(w, len(index)) for ws in words for w in ws), np.int64)
        distinct = list(index)
        numbers = lexicon.lookup(self.arrays, distinct)
        unseen = np.nonzero(numbers < 0)[0]
        merged, sizes = self.merge([distinct[k] for k in unseen])
        stored, at = self.arrays["ids"], self.arrays["id_starts"]
        table = np.concatenate([stored, merged])
        starts, counts = at[numbers], at[np.maximum(numbers, 0) + 1] - at[numbers] if len(at) > 1 else np.zeros(len(numbers), np.int64)
        starts[unseen], counts[unseen] = len(stored) + np.cumsum(sizes) - sizes, sizes
        per_chunk = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.concatenate([[0], np.cumsum(counts[flat])])
        lengths = np.diff(np.concatenate([[0], ends[np.cumsum(per_chunk)]]))
        more = _gather(table, starts[flat], counts[flat]).astype(np.int32)
        special = [k for k, c in enumerate(new) if isinstance(c, int)]
        if special:
            more = np.insert(more, (np.cumsum(lengths) - lengths)[special], [new[k] for k in special])
            lengths[special] = 1
        while self.used + len(more) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used:self.used + len(more)] = more
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.used += len(more)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > KEPT_CHUNKS:
            self.forget()
        chunks = [self.chunks(text) for text in texts]
        n = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(chunks)), np.int64, int(n.sum()))
        if self.codes.new:
            self._learn()
        lengths = self.lengths[codes]
        ids = _gather(self.ids, self.starts[codes], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(n)]
        return np.split(ids, ends[:-1]) if len(ends) else []

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ``ids`` in UTF-8; bytes that are none are replaced."""
        at = self.arrays["token_starts"]
        ids = ids.astype(np.int64)
        raw = _gather(self.arrays["token_bytes"], at[ids], at[ids + 1] - at[ids]).tobytes()
        return raw.decode("utf-8", "replace").encode()


_CODECS: dict[str, Codec] = {}


def codec_of(block: bytes, name: str) -> Codec:
    """The codec of a packed file, one per process. The file is unnamed as soon as it is mapped, so nothing is left behind
    and nobody else depends on it."""
    if name not in _CODECS:
        _CODECS.clear()
        with tempfile.NamedTemporaryFile() as file:
            file.write(block)
            file.flush()
            _CODECS[name] = Codec(lexicon.mapped(file.name))
    return _CODECS[name]


def frequent_words(docs: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> list[str]:
    """Up to ``words`` most frequent words (letters with the blank before them) of the whole table. Words are binned by count, an
    eighth of a doubling wide; the bins from the top that hold no more than ``words`` are taken whole, so nothing is
    sorted and only that many words reach the driver."""
    each = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r" ?\p{L}+"), F.lit(0))).alias("word"))
    counted = each.groupBy("word").count().filter(f"count >= {LEAST_COUNT} AND length(word) <= {Merger.LONG}")
    counted = stored(counted.select("word", F.expr("int(floor(log2(count) * 8))").alias("bin")), "lexicon-words")
    bins = sorted(((row["bin"], row["count"]) for row in counted.groupBy("bin").count().collect()), reverse=True)
    held, lowest = 0, None
    for at, n in bins:
        if (held := held + n) > words:
            break
        lowest = at
    return [] if lowest is None else [row["word"] for row in counted.filter(F.col("bin") >= lowest).select("word").collect()]


def compiled(words: list[str], path: str) -> bytes:
    """The packed file: tokenizer and transducer of ``words``."""
    arrays = read_tokenizer(path)
    spelled = sorted({word.encode() for word in words if word})
    return lexicon.pack(arrays | lexicon.build(spelled, *Merger(arrays)(spelled)))


def _groups(texts):
    """Runs of texts of up to ``GROUP_CHARS`` characters, or one longer text."""
    group, size = [], 0
    for text in texts:
        text = text or ""
        if group and size + len(text) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _with_codec(docs: DataFrame, text: str, words: int, path: str | None):
    block = compiled(frequent_words(docs, text, words), path or tokenizer_path())
    return docs.sparkSession.sparkContext.broadcast(block), hashlib.sha256(block).hexdigest()[:24]


def encode(docs: DataFrame, text: str = "text", into: str = "ids", words: int = LEXICON_WORDS, path: str | None = None) -> DataFrame:
    """``docs`` with ``into``, the array of token ids of ``text``. Null and empty texts have no ids; repeated rows are
    encoded each; an existing column of that name is replaced. Nothing is shuffled but the word counts."""
    shared, name = _with_codec(docs, text, words, path)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids_of(texts: pd.Series) -> pd.Series:
        codec = codec_of(shared.value, name)
        return pd.Series([ids for group in _groups(texts) for ids in codec.encode(group)], dtype=object)

    return docs.withColumn(into, ids_of(F.col(text)))


def decode(rows: DataFrame, ids: str = "ids", into: str = "text", path: str | None = None) -> DataFrame:
    """``rows`` with ``into``, the text of the ids. No ids or null: the empty text."""
    block = compiled([], path or tokenizer_path())
    shared, name = rows.sparkSession.sparkContext.broadcast(block), hashlib.sha256(block).hexdigest()[:24]

    @F.pandas_udf(T.StringType())
    def text_of(found: pd.Series) -> pd.Series:
        codec = codec_of(shared.value, name)
        return pd.Series([codec.decode(np.asarray([] if x is None else x, np.int32)).decode() for x in found], dtype=object)

    return rows.withColumn(into, text_of(F.col(ids)))


def encode_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = LEXICON_WORDS, path: str | None = None) -> DataFrame:
    """One row per row of ``docs``: key, n_tokens, ids_sha256 and decoded_sha256 of its encoding and of that decoded
    again; ids stay in the task."""
    shared, name = _with_codec(docs, text, words, path)
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    @F.pandas_udf(kind)
    def digests(texts: pd.Series) -> pd.DataFrame:
        codec = codec_of(shared.value, name)
        numbers = [b"%d," % i for i in range(len(codec.arrays["token_starts"]))]
        spelled, at = np.frombuffer(b"".join(numbers), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in numbers])])
        rows = []
        for group in _groups(texts):
            for ids in codec.encode(group):
                listed = _gather(spelled, at[ids], at[ids + 1] - at[ids])[:-1].tobytes()
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=kind.names)

    return docs.select(F.col(key), digests(F.col(text)).alias("d")).select(key, "d.*")
