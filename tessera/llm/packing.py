"""Operator 1: packing by lexical retrieval over sharded BM25 indexes.

Texts are encoded once, in the scan. A document's full windows are sequences of
their own; what is left of it (fewer ids than a window) is indexed. How many
remainders hold an id, and their mean length, are counted over all of them; a
vocabulary is bounded, so these counts are what the driver sends to the tasks.

Shards are lexically coherent: a remainder has a sketch, its three heaviest ids
by frequency within it and rarity (ids of merged vocabularies run from common to
rare), and remainders are range-partitioned by sketch, a frequent sketch by a
hash as well, and cut into shards of ``shard_docs`` to twice as many. A shard
has an inverted index: for each id the documents that hold it with their BM25
weight. The longest unused remainder is the seed of a window; the index ranks
all unused neighbours by all ids of the seed (or its ``query_terms`` rarest),
and those fill the window greedily, whole where they fit. Room that no neighbour
fits is filled by the head of the best one, whose tail seeds the next window. So
all windows of a shard but its last are full. A last window of a power of two
stays as it is. There is a task for at most 256 shards, however many rows.

Nulls count as empty texts, which have the end id alone. Very long texts are
full windows but for their end. Equally ranked neighbours come in the order of
the shard. Repeated rows are packed as often as they occur; two rows of one id
share a window only where a shard has nothing else. Null ids pass through. Extra
columns are not read. An empty table gives no pieces. Rows are sorted within
their task, so a lost task packs the same windows again, as long as no two rows
agree in id and text (such rows are alike).
"""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_arrow, written

WINDOW = 2048
SHARD_DOCS = 1024
TASK_SHARDS = 256
VOCABULARY = 1 << 16
K1, B = 1.2, 0.75
MEMO_WORDS, MEMO_BYTES = 400_000, 40
_MARKS = b".,!?;:*#$%&|"

_loaded: dict[str, WordIds] = {}


class WordIds:
    """Ids of words as little-endian 16-bit strings, memoised.

    For a tokenizer that drops white space, lower-cases and marks word ends;
    such words do not depend on one another, and final marks after a letter are
    a run of their own. Unknown words of letters are encoded many at a time,
    blank-separated, and told apart by the end marks.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        vocabulary = self.encoder.get_vocab(with_added_tokens=True)
        if max(vocabulary.values()) > 0xFFFF:
            raise ValueError("ids of more than 16 bits")
        self.ends = np.zeros(VOCABULARY, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        #: What was used lately, and what was before that.
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, wanted: list[bytes]) -> dict[bytes, bytes]:
        memo, marked, new = self.memo, [], []
        for w in wanted:
            if w and w[-1] in _MARKS:
                stem = w.rstrip(_MARKS)
                if stem and 97 <= stem[-1] <= 122:
                    marked.append((w, stem, w[len(stem) :]))
                    continue
            new.append(w)
        new += {x for _, *parts in marked for x in parts if x not in memo}.difference(new)
        texts = b"\n".join(new).decode("utf-8", "replace").split("\n")  # no word has a line end
        plain = [k for k, t in enumerate(texts) if t.isalpha()]
        found: dict[bytes, bytes] = {}
        chunks = [plain[at : at + 500] for at in range(0, len(plain), 500)]
        for chunk, data in zip(chunks, self._encode([" ".join([texts[k] for k in chunk]) for chunk in chunks]), strict=True):
            cuts = (2 * (np.flatnonzero(self.ends[np.frombuffer(data, "<u2")]) + 1)).tolist()
            if len(cuts) == len(chunk):
                found.update(zip([new[k] for k in chunk], map(data.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))
        rest = [k for k, x in enumerate(new) if x not in found]
        found.update(zip([new[k] for k in rest], self._encode([texts[k] for k in rest]), strict=True))
        for w, *parts in marked:
            found[w] = b"".join([found[x] if x in found else memo[x] for x in parts])
        memo.update({k: v for k, v in found.items() if len(k) <= MEMO_BYTES})
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow column of texts, one text after the other, and where each begins and ends.

        Words are split and made distinct in Arrow, so Python sees each word of
        a column once; their ids are then put in place by one gather.
        """
        texts = pc.fill_null(texts, "")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        distinct = split.flatten().dictionary_encode()
        words = distinct.dictionary.cast(pa.binary()).to_pylist()
        memo, older = self.memo, self.older
        got = list(map(memo.get, words))
        unknown = []
        for k, x in enumerate(got):
            if x is None:
                got[k] = x = older.get(words[k])
                if x is None:
                    unknown.append(k)
                else:
                    memo[words[k]] = x
        if unknown:
            extra = self.learn([words[k] for k in unknown])
            for k in unknown:
                got[k] = extra[words[k]]
        if len(memo) > MEMO_WORDS:
            self.memo, self.older = {}, memo
        flat, size = np.frombuffer(b"".join(got), "<u2"), np.fromiter(map(len, got), np.int64, len(got)) // 2
        first, which = np.cumsum(size) - size, distinct.indices.to_numpy()
        sizes = size[which]
        ends = np.cumsum(sizes)
        at = np.repeat(first[which] - ends + sizes, sizes)
        at += np.arange(len(at))
        words_upto = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        return flat[at], np.concatenate([[0], ends])[words_upto]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def sketch(terms: np.ndarray, tf: np.ndarray) -> int:
    """The three heaviest ids of a remainder, in one number; the heaviest first."""
    weight = tf / (tf + K1) * np.log(terms + 2.0)
    best = np.argpartition(weight, -3)[-3:] if len(weight) > 3 else np.arange(len(weight))
    top = terms[best[np.lexsort((-terms[best], -weight[best]))]].tolist() + [0, 0, 0]
    return (top[0] << 32) + (top[1] << 16) + top[2]


def encoded(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """``doc_id, n, full, rest, sketch``: ids in all, checksums of the full windows, ids that are left, and their sketch. No shuffle.

    At the end of a task one row more, with a null ``n``, tells ``ids`` and in
    how many remainders each was, ``held``, with the number of remainders and
    of their ids in ``full``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds.of(tokenizer_path), np.array([end_id], "<u2")
        gc.collect()
        gc.freeze()  # the vocabulary need not be walked again; nothing here makes cycles
        held, rows, rests, tokens, types = np.zeros(VOCABULARY, np.int64), 0, 0, 0, None
        for b in batches:
            types = [b.column(0).type, pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                n, full, rest, sketches = [], [], [], []
                every, bounds = words.ids(part.column(1))
                for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = np.concatenate([every[first:last], end])
                    whole = len(ids) // window * window
                    n.append(len(ids))
                    full.append([crc(ids[i : i + window]) for i in range(0, whole, window)])
                    left = ids[whole:]
                    rest.append(left.tobytes())
                    terms, tf = np.unique(left, return_counts=True)
                    held[terms] += 1
                    sketches.append(sketch(terms.astype(np.int64), tf))
                    rests += len(left) > 0
                    tokens += len(left)
                rows += len(n)
                none = pa.nulls(len(n))
                yield pa.RecordBatch.from_arrays([x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip([part.column(0), n, full, rest, sketches, none, none], types, strict=True)], ENCODED)
        if types:
            ids = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([None, None, [rows, rests, tokens], b"", 0, ids.tolist(), held[ids].tolist()], types, strict=True)], ENCODED)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(in_arrow, run, f"doc_id {kind}, n long, full array<long>, rest binary, sketch long, ids array<int>, held array<long>")


ENCODED = ["doc_id", "n", "full", "rest", "sketch", "ids", "held"]


def statistics(rows: DataFrame) -> tuple[int, int, float, np.ndarray]:
    """Number of rows, of remainders, their mean length, and the rarity (idf) of each id among them; a vocabulary's worth of rows reaches the driver."""
    told = rows.where("n IS NULL")
    total = told.agg(*(F.coalesce(F.sum(F.col("full")[k]), F.lit(0)).alias(x) for k, x in enumerate(("rows", "n", "tokens")))).first()
    held = np.zeros(VOCABULARY)
    for r in told.select(F.inline(F.arrays_zip("ids", "held"))).groupBy("ids").agg(F.sum("held").alias("held")).collect():
        held[r.ids] = r.held
    return total.rows, total.n, total.tokens / max(total.n, 1), np.log1p((total.n - held + 0.5) / (held + 0.5))


class Index:
    """BM25 postings of one shard, by the rarity of ids and the mean length in the whole corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.n, self.idf = len(docs), idf
        lengths = np.array([len(d) for d in docs], float)
        owner = np.repeat(np.arange(self.n), [len(d) for d in docs])
        pair, tf = np.unique(np.concatenate(docs).astype(np.int64) * self.n + owner, return_counts=True)
        term, self.doc = np.divmod(pair, self.n)
        self.at = np.searchsorted(term, np.arange(VOCABULARY + 1))
        self.terms = term[np.argsort(self.doc, kind="stable")]  # of each document, in order
        self.first = np.searchsorted(np.sort(self.doc), np.arange(self.n + 1))
        norm = K1 * (1 - B + B * lengths / max(mean, 1e-9))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        # Ids that many documents of the shard hold have a whole row of weights.
        many = np.flatnonzero(np.diff(self.at) > max(16, self.n // 8))
        self.row = np.full(VOCABULARY, -1)
        self.row[many] = np.arange(len(many))
        self.rows = np.zeros((len(many), self.n))
        dense = self.row[term] >= 0
        self.rows[self.row[term[dense]], self.doc[dense]] = self.weight[dense]

    def neighbours(self, seed: int, used: np.ndarray, terms: int | None = None) -> np.ndarray:
        """All unused documents that share an id with ``seed`` (or one of its ``terms`` rarest), best first; ties by place."""
        q = self.terms[self.first[seed] : self.first[seed + 1]]
        if terms is not None and len(q) > terms:
            q = q[np.lexsort((q, -self.idf[q]))[:terms]]
        row = self.row[q]
        score = self.rows[row[row >= 0]].sum(0)
        few = q[row < 0]
        start, size = self.at[few], self.at[few + 1] - self.at[few]
        ends = np.cumsum(size)
        if len(ends):
            places = np.repeat(start - ends + size, size) + np.arange(ends[-1])
            score += np.bincount(self.doc[places], self.weight[places], self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def _filled(others: np.ndarray, room: int, lengths: np.ndarray, codes: np.ndarray, code: int) -> tuple[list[int], int, np.ndarray]:
    """Of ranked documents those that are taken whole, one after the other as they fit; the room left; and the others, best first.

    ``code`` and those of what is taken name ids that a window has already.
    """
    taken = []
    others = others[codes[others] != code]
    while room:
        fits = np.flatnonzero(lengths[others] <= room)
        if not len(fits):
            break
        d = int(others[fits[0]])
        taken.append(d)
        room -= int(lengths[d])
        others = others[codes[others] != codes[d]]
    return taken, room, others


def pack_shard(ids: list, rests: list[np.ndarray], window: int, idf: np.ndarray, mean: float, query_terms: int | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (document, first id, ids) over the remainders of a shard."""
    lengths = np.array([len(r) for r in rests])
    used = lengths == 0
    if used.all():
        return
    index = Index(rests, idf, mean)
    known: dict = {}
    codes = np.array([known.setdefault(x, len(known)) for x in ids])
    order = np.lexsort((np.arange(len(rests)), -lengths))
    next_seed, carry = 0, None
    spare = len(order) - 1  # shortest first, where the index has nothing to offer
    while True:
        if carry is None:
            while next_seed < len(order) and used[order[next_seed]]:
                next_seed += 1
            if next_seed == len(order):
                return
            carry = (int(order[next_seed]), 0)
            used[carry[0]] = True
        seed, start = carry
        pieces, room, carry = [(seed, start, int(lengths[seed] - start))], window - int(lengths[seed] - start), None
        if room:
            taken, room, others = _filled(index.neighbours(seed, used, query_terms), room, lengths, codes, codes[seed])
            pieces += [(d, 0, int(lengths[d])) for d in taken]
            used[taken] = True
            partial = int(others[0]) if room and len(others) else None
            if room and partial is None:
                while spare >= 0 and room:
                    d = int(order[spare])
                    if used[d]:
                        spare -= 1
                    elif lengths[d] <= room:
                        pieces.append((d, 0, int(lengths[d])))
                        room -= int(lengths[d])
                        used[d] = True
                    else:
                        partial = d
                        break
            if room and partial is not None:
                pieces.append((partial, 0, room))
                used[partial] = True
                carry = (partial, room)
        yield pieces


PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 1, shard_docs: int = SHARD_DOCS, query_terms: int | None = None) -> DataFrame:
    """One row per piece: the columns of :data:`PIECES`. One shuffle, of the remainders' ids."""
    rows = written(encoded(docs, tokenizer_path, window, end_id), "encoded")
    total, _, mean, idf = statistics(rows)
    shards = -(-total // shard_docs)
    parts = max(1, min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // TASK_SHARDS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32

        def packed(number: int, block: list[tuple]) -> tuple[pa.RecordBatch, int]:
            """The pieces of one shard; sequences are numbered from ``number`` on."""
            out = []
            for doc, n, full, _ in block:
                for k, c in enumerate(full):
                    out.append((doc, k * window, window, c, n, first + number, 0))
                    number += 1
            rests = [np.frombuffer(r[3], "<u2") for r in block]
            for pieces in pack_shard([r[0] for r in block], rests, window, idf, mean, query_terms):
                offset = 0
                for d, start, length in pieces:
                    n = block[d][1]
                    out.append((block[d][0], n // window * window + start, length, crc(rests[d][start : start + length]), n, first + number, offset))
                    offset += length
                number += 1
            arrays = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, PIECES), number

        types, number, block = None, 0, []
        for b in batches:
            types = [b.column(0).type, *[pa.int64()] * 6]
            block += zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)
            while len(block) >= 2 * shard_docs:
                batch, number = packed(number, block[:shard_docs])
                block = block[shard_docs:]
                yield batch
        if block:
            yield packed(number, block)[0]

    kind = docs.schema["doc_id"].dataType.simpleString()
    place = F.xxhash64("doc_id", "n", "sketch")
    dealt = rows.where("n IS NOT NULL").withColumn("place", place).repartitionByRange(parts, "sketch", "place").sortWithinPartitions("sketch", "place", "doc_id", "n", F.crc32("rest"))
    return dealt.select("doc_id", "n", "full", "rest").transform(in_arrow, run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
