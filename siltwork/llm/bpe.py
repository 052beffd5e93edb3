"""BPE encoding and decoding through a minimal acyclic transducer.

A lexicon of frequent words is compiled, in one pass over sorted words, into a
minimal acyclic automaton whose arcs carry integer outputs. The outputs along a
path add up to the word's ordinal, which indexes its token ids, so words share
suffix states although their ids differ. The file is shipped to every executor
and memory-mapped there. Words outside it are merged exactly, all words of one
length at once. A chunk of texts is encoded by its distinct pieces.

The lexicon only saves time: whatever words it holds, the ids are the same.
"""

from __future__ import annotations

import gc
import heapq
import json
import os
import tempfile
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEXICON_WORDS = 49152
PARTITION_WORDS = 32768
CHUNK_CHARS = 4_000_000
MAGIC = 0x4C455831
#: A merge as one number: its rank above its new id.
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NO_MERGE = 1 << 62
#: Longer words are merged one by one; as a rank, that of no merge.
LONGEST_TOGETHER, NO_RANK = 48, (1 << 31) - 1

#: The split pattern and end-of-word mark of the vocabulary file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = regex.compile(WORD_PATTERN.replace(r"\s", _SPACE))
_RUNS = regex.compile(f"[^{_SPACE}]+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")  # str.split() takes them for white space, the pattern does not
#: Latin letters and ASCII marks after them, which the split pattern takes for two words.
_USUAL = "^(?P<letters>[a-z\u00df-\u00f6\u00f8-\u017f]*)(?P<marks>[!-/:-@\\[-`{-~]*)$"
#: Breaks UTF-8 words at ASCII characters that are not letters, in one pass.
_BREAKS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], extra = chr(extra), extra + 1
    return [table[b] for b in range(256)]


class Merger:
    """Exact BPE merges of single words for a vocabulary with word-end marks."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.first = [vocab[c] for c in alphabet]
        self.last = [vocab[c + WORD_END] for c in alphabet]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.rank[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.code = {pair: rank << ID_BITS | new for pair, (rank, new) in self.rank.items()}
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})

    def ids(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return self._short(ids) if len(ids) <= LONGEST_TOGETHER else self._long(ids)

    @cached_property
    def _tables(self) -> tuple[np.ndarray, ...]:
        """Ids of bytes inside and at the end of a word; sorted pairs, their ranks and new ids; ranks of pairs of bytes."""
        first, last = np.array(self.first, np.int32), np.array(self.last, np.int32)
        pairs = np.array([a << 32 | b for a, b in self.rank] + [NO_MERGE], np.int64)
        ranks = np.array([r for r, _ in self.rank.values()] + [NO_RANK], np.int32)
        new = np.zeros(len(self.rank) + 1, np.int32)
        new[ranks[:-1]] = [i for _, i in self.rank.values()]
        order = np.argsort(pairs)
        pairs, ranks = pairs[order], ranks[order]
        of_bytes = self._ranks(pairs, ranks, np.repeat(first, 512), np.tile(np.concatenate([first, last]), 256))
        return first, last, pairs, ranks, new, of_bytes

    @staticmethod
    def _ranks(pairs: np.ndarray, ranks: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(pairs, key)
        return np.where(pairs[at] == key, ranks[at], np.int32(NO_RANK))

    def ids_of_all(self, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words, one word after the other, and how many each has.

        A merge shortens a word by one, so words of one length are a matrix: those with a merge
        left join the next shorter ones, the others are done.
        """
        first, last, pairs, ranks, new, of_bytes = self._tables
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for w in np.flatnonzero(length > LONGEST_TOGETHER).tolist():
            raw = text[start[w] : start[w] + length[w]].tolist()
            ids = self._long([self.first[b] for b in raw[:-1]] + [self.last[raw[-1]]])
            done.append((np.array([w]), np.array([ids], np.int32)))
        together = np.flatnonzero(length <= LONGEST_TOGETHER)
        together = together[np.argsort(length[together], kind="stable")]
        ends = np.searchsorted(length[together], np.arange(LONGEST_TOGETHER + 2))
        rows, ids, codes = np.zeros(0, np.int64), np.zeros((0, LONGEST_TOGETHER), np.int32), np.zeros((0, LONGEST_TOGETHER - 1), np.int32)
        for n in range(LONGEST_TOGETHER, 0, -1):
            if ends[n] < ends[n + 1]:
                fresh = together[ends[n] : ends[n + 1]]
                raw = text[start[fresh][:, None] + np.arange(n)].astype(np.int64)
                given = first[raw]
                given[:, -1] = last[raw[:, -1]]
                right = raw[:, 1:]
                right[:, -1:] += 256
                rows, ids, codes = np.concatenate([rows, fresh]), np.concatenate([ids, given]), np.concatenate([codes, of_bytes[raw[:, :-1] * 512 + right]])
            if n == 1 or not len(rows):
                done.append((rows, ids))
                rows, ids, codes = rows[:0], ids[:0, 1:], codes[:0, 1:]
                continue
            at = codes.argmin(axis=1)  # of equal ranks the leftmost
            best = codes[np.arange(len(rows)), at]
            more = best != NO_RANK
            done.append((rows[~more], ids[~more]))
            rows, ids, codes, at, best = rows[more], ids[more], codes[more], at[more], best[more]
            each, keep = np.arange(len(rows)), np.ones(ids.shape, bool)
            ids[each, at] = new[best]
            keep[each, at + 1] = False
            ids = ids[keep].reshape(len(rows), n - 1)
            keep[:] = True
            keep[each, at] = False
            codes = codes[keep[:, :-1]].reshape(len(rows), n - 2)
            for shift in (-1, 0):
                able = np.flatnonzero((at + shift >= 0) & (at + shift < n - 2))
                place = at[able] + shift
                codes[able, place] = self._ranks(pairs, ranks, ids[able, place], ids[able, place + 1])
        sizes = np.zeros(len(length), np.int64)
        for r, found in done:
            sizes[r] = found.shape[1]
        flat, begin = np.empty(sizes.sum(), np.int32), np.cumsum(sizes) - sizes
        for r, found in done:
            flat[begin[r][:, None] + np.arange(found.shape[1])] = found
        return flat, sizes

    def _short(self, ids: list[int]) -> list[int]:
        """One merge after the other, the lowest rank first, of equal ones the leftmost."""
        code, none = self.code.get, NO_MERGE
        codes = [code(pair, none) for pair in zip(ids, ids[1:])]
        while codes and (best := min(codes)) != none:
            at, new = codes.index(best), best & ID_MASK
            ids[at : at + 2] = [new]
            del codes[at]
            if at:
                codes[at - 1] = code((ids[at - 1], new), none)
            if at < len(codes):
                codes[at] = code((new, ids[at + 1]), none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same merges by a heap of (rank, place) over a linked list."""
        n = len(ids)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(f[0], i, ids[i], ids[i + 1], f[1]) for i in range(n - 1) if (f := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], live[j], after[i] = new, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (f := self.rank.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (f[0], a, ids[a], ids[b], f[1]))
        return [ids[i] for i in range(n) if live[i]]


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]], path: str) -> None:
    """Write the minimal automaton of sorted, distinct words to a file."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    open_path: list[list] = [[False, []]]  # of the last word: finality and arcs per depth
    previous, offsets, ids = b"", [0], []

    def freeze(depth: int) -> None:
        while len(open_path) > depth + 1:
            final, arcs = open_path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            arcs_above = open_path[-1][1]
            arcs_above[-1] = (arcs_above[-1][0], register[key])

    for word, tokens in entries:
        shared = len(os.path.commonprefix([word, previous]))
        freeze(shared)
        for byte in word[shared:]:
            open_path[-1][1].append((byte, -1))
            open_path.append([False, []])
        open_path[-1][0] = True
        previous = word
        ids.extend(tokens)
        offsets.append(len(ids))
    freeze(0)
    root = len(states)
    states.append((open_path[0][0], tuple(open_path[0][1])))

    below = np.zeros(len(states), np.int64)  # words accepted from each state; arcs lead to earlier states
    keys, targets, outputs = [], [], []
    for s, (final, arcs) in enumerate(states):
        count = int(final)
        for byte, to in arcs:
            keys.append(s << 8 | byte)
            targets.append(to)
            outputs.append(count)
            count += below[to]
        below[s] = count
    final = np.array([f for f, _ in states], np.int64)
    parts = [np.asarray(x, np.int64) for x in (keys, targets, outputs, final, offsets, ids)]
    head = np.array([MAGIC, root, *map(len, parts)], np.int64)
    np.concatenate([head, *parts]).tofile(path)


class Lexicon:
    """The memory-mapped automaton; looks up many words at once."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int64, mode="r")
        if data[0] != MAGIC:
            raise ValueError(f"{path} is not a compiled lexicon")
        self.root, at, parts = int(data[1]), 8, []
        for size in data[2:8]:
            parts.append(data[at : at + int(size)])
            at += int(size)
        self.keys, self.targets, self.outputs, self.final, self.offsets, self.ids = parts

    def lookup(self, words: list[bytes]) -> list[list[int] | None]:
        length = np.fromiter(map(len, words), np.int64, len(words))
        found = self.ordinals(np.frombuffer(b"".join(words), np.uint8), np.cumsum(length) - length, length)
        return [self.ids[self.offsets[t] : self.offsets[t + 1]].tolist() if t >= 0 else None for t in found.tolist()]

    def ordinals(self, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The place of each word among the lexicon's words, -1 if it is none of them."""
        n = len(length)
        if not n or not len(self.keys):
            return np.full(n, -1)
        state, total = np.full(n, self.root), np.zeros(n, np.int64)
        live = np.arange(n)
        for depth in range(int(length.max())):
            live = live[length[live] > depth]
            if not len(live):
                break
            key = state[live] << 8 | text[start[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            state[live[~hit]] = -1
            live, arc = live[hit], arc[hit]
            total[live] += self.outputs[arc]
            state[live] = self.targets[arc]
        known = (state >= 0) & (self.final[state] == 1)
        return np.where(known, total, -1)


@lru_cache(maxsize=2)
def merger_of(vocabulary: str) -> Merger:
    """The merges of a vocabulary file, read once by each Python worker."""
    with open(vocabulary, encoding="utf-8") as f:
        return Merger(json.load(f))


def places(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def bounds(length: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())


class Encoder:
    """Encodes chunks of texts by their distinct pieces."""

    def __init__(self, merger: Merger, lexicon: Lexicon | None):
        self.merger, self.lexicon = merger, lexicon
        self.parts = regex.compile("(" + "|".join(map(regex.escape, merger.special)) + ")") if merger.special else None
        self.names = pa.array([merger.names.get(i, "") for i in range(max(merger.names) + 1)], pa.string())

    def pieces(self, text: str) -> list[str]:
        """Lower-cased runs without white space and special tokens, these after a space, in order."""
        if not any(token in text for token in self.merger.special):
            return self._plain(text)
        out = []
        for i, part in enumerate(self.parts.split(text)):
            out.extend([" " + part] if i % 2 else self._plain(part))
        return out

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return text.split() if _SEPARATORS.search(text) is None else _RUNS.findall(text)

    def _words(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all pieces, in order, and the place of the piece that each belongs to."""
        usual = pc.extract_regex(pieces, _USUAL)
        letters, marks = pc.struct_field(usual, "letters"), pc.struct_field(usual, "marks")
        other = np.flatnonzero(usual.is_null().to_numpy(zero_copy_only=False))
        split = [[p] if p[0] == " " else _SPLIT.findall(p) for p in pieces.take(pa.array(other)).to_pylist()]
        owners, words = [np.repeat(other, [len(x) for x in split])], [pa.array(chain.from_iterable(split), pa.string())]
        for part in (letters, marks):
            held = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(part), 0), False).to_numpy(zero_copy_only=False))
            owners.append(held)
            words.append(part.take(pa.array(held)))
        owner = np.concatenate(owners).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        return pa.concat_arrays(words).take(pa.array(order)), owner[order]

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each word's begin and how many they are."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        text = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        begin, length = offsets[:-1], np.diff(offsets)
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        special = np.flatnonzero(pc.starts_with(words, " ").to_numpy(zero_copy_only=False))
        pool = [np.array([self.merger.special[w[1:]] for w in words.take(pa.array(special)).to_pylist()], np.int32)]
        start[special], size[special] = np.arange(len(special)), 1
        used = len(special)
        if self.lexicon:
            place = self.lexicon.ordinals(text, begin, length)
            known = np.flatnonzero(place >= 0)
            start[known] = self.lexicon.offsets[place[known]] + used
            size[known] = self.lexicon.offsets[place[known] + 1] - self.lexicon.offsets[place[known]]
            pool.append(self.lexicon.ids.astype(np.int32))
            used += len(self.lexicon.ids)
        rest = np.flatnonzero(size == 0)
        ids, size[rest] = self.merger.ids_of_all(text, begin[rest], length[rest])
        start[rest] = np.cumsum(size[rest]) - size[rest] + used
        return np.concatenate([*pool, ids]), start, size

    def learn(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The packed ids and the decoded text of each piece."""
        words, owner = self._words(pieces)
        words = words.dictionary_encode()
        pool, start, size = self._ids(words.dictionary)
        word = words.indices.to_numpy()
        ids = pool[places(start[word], size[word])]
        count = np.bincount(owner, size[word], len(pieces)).astype(np.int64)
        packed = pa.Array.from_buffers(pa.binary(), len(pieces), [None, bounds(4 * count).buffers()[1], pa.py_buffer(ids.astype("<u4"))])
        return packed, pc.binary_join(pa.ListArray.from_arrays(bounds(count), self.names.take(pa.array(ids))), " ")

    def encode(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        lists = [self.pieces(t) for t in texts]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        pieces = pa.array(chain.from_iterable(lists), pa.string()).dictionary_encode()
        packed, shown = self.learn(pieces.dictionary)
        return tuple(pc.binary_join(pa.ListArray.from_arrays(bounds(size), values.take(pieces.indices)), between) for values, between in ((packed, b""), (shown, " ")))


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch of about so many characters, with their texts; null is the empty text."""
    texts, start, size = [], 0, 0
    for i, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= most:
            yield batch.slice(start, i + 1 - start), texts
            texts, start, size = [], i + 1, 0
    if texts:
        yield batch.slice(start), texts


def broken(text: str) -> pa.Array:
    """Lower-cased words, each with the space after it, cut at ASCII characters other than letters; some are but the space."""
    raw = text.lower().encode("utf-8", "replace").translate(_BREAKS) + b" "
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32) + 1
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, bounds(np.diff(ends, prepend=0)).buffers()[1], pa.py_buffer(raw)])


def frequent_words(docs: DataFrame, text: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, lower-cased; at most ``most`` reach the driver.

    Words are cut at ASCII characters other than letters; what else they hold costs only time.
    """

    def most_frequent(parts: list[pa.Table], n: int) -> pa.Table:
        whole = pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})
        return whole if len(whole) <= n else whole.take(pc.select_k_unstable(whole, n, [("n", "descending")]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})]
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                found = broken(" ".join(texts)).value_counts()
                seen.append(pa.table({"word": found.field(0), "n": found.field(1)}))
                if sum(map(len, seen)) > 16 * PARTITION_WORDS:
                    seen = [most_frequent(seen, 4 * PARTITION_WORDS)]
        top = most_frequent(seen, PARTITION_WORDS)
        words = pc.binary_slice(top["word"], 0, -1).cast(pa.string())  # without the space
        yield from pa.table({"word": words, "n": top["n"]}).filter(pc.not_equal(words, "")).to_batches()

    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r["word"] for r in top.collect()]


def build_lexicon(spark: SparkSession, words: Iterable[str], vocabulary: str) -> str:
    """Compile words with their ids and ship the file to the executors; returns its name there."""
    merger = merger_of(vocabulary)
    entries = sorted((w.encode("utf-8"), merger.ids(w)) for w in set(words) if w and len(w) <= 64)
    handle, path = tempfile.mkstemp(suffix=".lexicon")
    os.close(handle)
    compile_lexicon(entries, path)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(docs: DataFrame, vocabulary: str, lexicon: str | None, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the token ids (packed little-endian unsigned 32-bit integers) and the decoded text.

    ``vocabulary`` is the path of a word-end BPE file that every executor can open; ``lexicon``
    a name from ``build_lexicon`` or None. Special tokens in a text are encoded as such. A null
    or empty text has no ids and decodes to the empty text. Repeated rows stay; all other
    columns stay; columns named like the two outputs are replaced. An empty table gives an
    empty result.
    """
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("binary").alias(ids), F.lit(None).cast("string").alias(decoded)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merger_of(vocabulary), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
        gc.collect()
        gc.freeze()  # the tables stay; the collector need not walk them again and again
        for batch in batches:
            for part, texts in chunks(batch, "__text"):
                packed, shown = encoder.encode(texts)
                columns = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, packed, shown], names=[*kept, ids, decoded])

    return given.mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document through ``encode`` with the public word-end vocabulary."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon = build_lexicon(spark, frequent_words(docs), vocabulary)
    coded = encode(docs, vocabulary, lexicon)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
