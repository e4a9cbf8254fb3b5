"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon.

The most frequent pre-tokens of the corpus are compiled, with their token ids as outputs, into a
minimal deterministic acyclic automaton that shares suffixes; a transition stores how many words
pass before it, so that walking a word yields its rank and thereby its ids.  The automaton is
broadcast (its size is bounded by lexicon_words) and memory-mapped by each worker process from a
file in its own temporary folder, whose name is removed as soon as it is mapped.  All new pre-tokens
of a slice walk the automaton together, one byte a step; those it does not hold are merged exactly,
also together: in each step every word merges all places of its lowest-ranked pair.  A worker
remembers up to CACHED words with their ids; ids and bytes of whole slices are then gathered at once.

Texts are split at added tokens first, as the tokenizer file demands, then by the byte-level
pattern.  Decoding joins the tokens' bytes and reads them as UTF-8 with replacement.

Nulls and odd inputs: a null or empty text has no tokens; repeated rows are encoded row by row;
an empty table gives an empty lexicon and no rows; a text of any length is encoded whole.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

# Fixed value: the byte-level pre-tokenizer's pattern, as published with the tokenizer files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEXICON_WORDS = 1 << 16
LEAST_COUNT = 2
CACHED = 1 << 18  # words a worker remembers or counts before it forgets or emits them; no effect on results


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, by rule: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> "Vocabulary":
    return Vocabulary(json.loads(open(path, encoding="utf-8").read()))


@lru_cache(maxsize=2)
def vocabulary_of(spec: str) -> "Vocabulary":
    return Vocabulary(json.loads(spec))


@lru_cache(maxsize=1)
def encoder_of(spec: str, packed: bytes) -> "Encoder":
    """One encoder a worker process, kept between its tasks."""
    return Encoder(vocabulary_of(spec), Transducer.mapped(packed))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of all places start, start + 1, ... of each span, in order."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    def __init__(self, spec: dict):
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        ids = model["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = ids[c]
        left, right, made = [], [], []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left.append(ids[a]), right.append(ids[b]), made.append(ids[a + b])
        key = np.array(left, np.int64) << 20 | np.array(right, np.int64)
        order = np.argsort(key, kind="stable")
        self.pair, self.rank, self.made = key[order], order.astype(np.int64), np.array(made, np.int64)[order]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        top = max(self.bytes_of, default=-1) + 1
        self.token_size = np.array([len(self.bytes_of.get(i, b"")) for i in range(top)], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(top)), np.uint8)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.find = regex.compile(PATTERN).findall

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens in order; an added token comes as itself after a NUL pair that no pre-token starts with."""
        if self.split is None or not any(a in text for a in self.added):
            return self.find(text)
        out = []
        for i, part in enumerate(self.split.split(text)):
            out.extend([MARK + part] if i % 2 else self.find(part))
        return out

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word by the exact merge order, all words together."""
        out: list = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(1 << max(len(w) - 1, 0).bit_length(), []).append(k)
        for size, members in by_size.items():
            step = max(1, (1 << 21) // size)
            for i in range(0, len(members), step):
                some = members[i : i + step]
                for k, ids in zip(some, self._merge([words[k] for k in some])):
                    out[k] = ids
        return out

    def _pairs(self, ids: np.ndarray, word: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of the pairs that begin at these places; FAR where nothing merges."""
        after = np.minimum(where + 1, len(ids) - 1)
        key = ids[where] << 20 | ids[after]
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        good = (self.pair[at] == key) & (word[where] == word[after]) & (after > where)
        return np.where(good, self.rank[at], FAR), self.made[at]

    def _merge(self, words: list[bytes]) -> list[list[int]]:
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank, made = self._pairs(ids, word, np.arange(len(ids)))
        done: list = []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, first)
            span = np.diff(np.append(first, len(ids)))
            keep = np.repeat(least < FAR, span)  # words with no pair left are done
            done.append((word[~keep], ids[~keep]))
            spot = np.flatnonzero((rank == np.repeat(least, span)) & keep)
            # of overlapping places (a a a) the leftmost counts: keep every second of a run
            if len(spot) > 1:
                fresh = np.concatenate([[True], np.diff(spot) != 1])
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(spot)), 0))
                spot = spot[(np.arange(len(spot)) - run) % 2 == 0]
            ids[spot] = made[spot]
            keep[spot + 1] = False
            now = np.cumsum(keep)[spot] - 1
            ids, word, rank, made = ids[keep], word[keep], rank[keep], made[keep]
            touched = np.concatenate([now, now[now > 0] - 1])  # only these pairs changed
            rank[touched], made[touched] = self._pairs(ids, word, touched)
        word = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([i for _, i in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        ids, cut = ids[order].tolist(), np.searchsorted(word[order], np.arange(len(words) + 1)).tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]


FAR = np.int64(1 << 40)  # more than any rank
MARK = "\0\0added:"


class Transducer:
    """A minimal acyclic automaton over bytes whose words have consecutive ranks, with ids by rank."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays

    @classmethod
    def compile(cls, words: list[bytes], outputs: list[list[int]]) -> "Transducer":
        """words: sorted and distinct."""
        registry: dict = {}
        states: list = []  # (final, ((byte, state), ...)), children before parents

        def frozen(node) -> int:
            key = (node[0], tuple(node[1]))
            if key not in registry:
                registry[key] = len(states)
                states.append(key)
            return registry[key]

        path, last = [[False, []]], b""
        for w in words:
            common = os.path.commonprefix([w, last])
            while len(path) > len(common) + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], frozen(node)))
            for _ in w[len(common) :]:
                path.append([False, []])
            path[-1][0] = True
            last = w
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], frozen(node)))
        root = frozen(path[0])
        below = np.zeros(len(states), np.int64)
        key, to, before = [], [], []
        for s, (final, edges) in enumerate(states):
            n = int(final)
            for b, t in edges:
                key.append(s << 8 | b), to.append(t), before.append(n)
                n += below[t]
            below[s] = n
        order = np.argsort(np.array(key, np.int64)) if key else np.zeros(0, np.int64)
        take = lambda x: np.array(x, np.int64)[order]
        cut = np.concatenate([[0], np.cumsum([len(o) for o in outputs])]).astype(np.int64)
        flat = np.array([i for o in outputs for i in o], np.int64)
        return cls({"key": take(key), "to": take(to), "before": take(before), "final": np.array([f for f, _ in states], np.int64), "root": np.array([root]), "cut": cut, "ids": flat})

    def pack(self) -> bytes:
        """Head of names, sizes and widths, then the arrays, in 32 bits where their values fit."""
        small = lambda v: np.ascontiguousarray(v, np.int32 if not len(v) or v.max() < 2**31 else np.int64)
        arrays = {k: small(v) for k, v in self.a.items()}
        head = json.dumps({k: [len(v), v.itemsize] for k, v in arrays.items()}).encode()
        return len(head).to_bytes(8, "little") + head + b"".join(v.tobytes() for v in arrays.values())

    @classmethod
    def mapped(cls, data: bytes) -> "Transducer":
        """Map data from a file in the process's temporary folder; the mapping outlives the file's name."""
        fd, path = tempfile.mkstemp()
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(data)
            whole = np.memmap(path, np.uint8, "r")
        finally:
            os.unlink(path)
        n = int.from_bytes(data[:8], "little")
        at, arrays = 8 + n, {}
        for k, (size, width) in json.loads(data[8 : 8 + n]).items():
            arrays[k] = np.asarray(whole[at : at + width * size]).view(np.int32 if width == 4 else np.int64)
            at += width * size
        return cls(arrays)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Rank of each word, or -1."""
        a, n = self.a, len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(a["key"]):
            return out
        sizes = np.array([len(w) for w in words], np.int64)
        raw, first = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        live, state, rank, depth = np.arange(n), np.full(n, a["root"][0]), np.zeros(n, np.int64), 0
        while len(live):
            ended = sizes[live] == depth
            good = ended & (a["final"][state] == 1)
            out[live[good]] = rank[good]
            live, state, rank = live[~ended], state[~ended], rank[~ended]
            key = (state << 8 | raw[first[live] + depth]).astype(a["key"].dtype)
            at = np.minimum(np.searchsorted(a["key"], key), len(a["key"]) - 1)
            ok = a["key"][at] == key
            live, state, rank = live[ok], a["to"][at[ok]], rank[ok] + a["before"][at[ok]]
            depth += 1
        return out


class Encoder:
    def __init__(self, vocab: Vocabulary, lexicon: Transducer):
        self.v, self.lex = vocab, lexicon
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, words: list[str]) -> None:
        """Remember the ids of distinct words not known yet."""
        if not words:
            return
        raw = [w.encode() for w in words]
        ranks, cut = self.lex.ranks(raw), self.lex.a["cut"]
        added = [k for k, w in enumerate(words) if w.startswith(MARK) and w[len(MARK) :] in self.v.added]
        ranks[added] = -1
        held = np.flatnonzero(ranks >= 0)
        r = ranks[held]
        size = np.zeros(len(words), np.int64)
        size[held] = cut[r + 1] - cut[r]
        merged = dict(zip(added, ([self.v.added[words[k][len(MARK) :]]] for k in added)))
        missing = [k for k in np.flatnonzero(ranks < 0).tolist() if k not in merged]
        merged |= zip(missing, self.v.merge([raw[k] for k in missing]))
        others = np.array(list(merged), np.int64)
        size[others] = list(map(len, merged.values()))
        start = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), np.int32)
        ids[ragged(start[held], size[held])] = self.lex.a["ids"][ragged(cut[r].astype(np.int64), size[held])]
        ids[ragged(start[others], size[others])] = list(chain.from_iterable(merged.values()))
        self.slot.update(zip(words, range(len(self.slot), len(self.slot) + len(words))))
        self.start, self.size = np.append(self.start, start + len(self.ids)), np.append(self.size, size)
        self.ids = np.append(self.ids, ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of all texts, and where each text's begin and end."""
        split = [self.v.pre_tokens(t) for t in texts]
        if len(self.slot) > CACHED:
            self.forget()
        self.learn([w for w in set().union(*split) if w not in self.slot])
        cut = np.cumsum([0, *map(len, split)])
        word = np.fromiter(map(self.slot.__getitem__, chain.from_iterable(split)), np.int64, cut[-1])
        size = self.size[word]
        return np.append(0, np.cumsum(size))[cut], self.ids[ragged(self.start[word], size)]

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The text of each slice of ids; bytes that are not UTF-8 become replacement characters."""
        size = self.v.token_size[ids]
        data = self.v.token_bytes[ragged(self.v.token_start[ids], size)].tobytes()
        cut = np.append(0, np.cumsum(size))[offsets].tolist()
        return [data[a:b].decode("utf-8", errors="replace") for a, b in zip(cut[:-1], cut[1:])]


def lexicon(docs: DataFrame, vocab_path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """The packed transducer of the most frequent pre-tokens; counts cover all texts."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(open(vocab_path, encoding="utf-8").read())

    def count(batches):
        v, got = vocabulary_of(spec.value), Counter()
        for b in pieces(batches):
            for t in b.column("text").to_pylist():
                got.update(v.pre_tokens(t or ""))
            if len(got) > CACHED:
                yield counts(got)
                got = Counter()
        yield counts(got)

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    # A sorted exchange, of which the first partitions are read: a top-k would bring that many words of every partition to the driver.
    fallback = "spark.sql.execution.topKSortFallbackThreshold"
    before = spark.conf.get(fallback)
    spark.conf.set(fallback, "1")
    try:
        top = counted.where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "w").limit(words).collect()
    finally:
        spark.conf.set(fallback, before)
    found = sorted(r["w"].encode() for r in top if not r["w"].startswith(MARK))
    return Transducer.compile(found, vocabulary(vocab_path).merge(found)).pack()


def counts(got: Counter) -> pa.RecordBatch:
    """Counted words of under 256 characters."""
    kept = [w for w in got if len(w) < 256]
    return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([got[w] for w in kept], pa.int64())], ["w", "n"])


def bpe_encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """Encode and decode every text: doc_id, ids (array), decoded."""
    data = docs.sparkSession.sparkContext.broadcast((open(vocab_path, encoding="utf-8").read(), lexicon(docs, vocab_path, text_col, words)))
    fields = "doc_id {}, ids array<int>, decoded string".format(docs.schema[id_col].dataType.simpleString())

    def encode(batches):
        coder = encoder_of(*data.value)
        for b in pieces(batches):
            at, ids = coder.encode([t or "" for t in b.column("text").to_pylist()])
            rows = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), rows, pa.array(coder.decode(at, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, fields)


def token_digests(encoded: DataFrame) -> DataFrame:
    """Per text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path()))
