"""Operator 9: exact token counts at every prefix of a text, by dynamic programming.

``P[i]`` is the number of tokens that the tokenizer gives for the first ``i``
characters. A text falls into segments, a run of white space with the run of
other characters behind it; no token spans a segment border and no segment's
tokens depend on its neighbours, so with ``s`` the start of the segment of ``i``

    P[i] = P[s] + P_segment[i - s]

Inside a word the merges of a byte-level tokenizer admit one last token for
each prefix: the token ``t`` that ends there and stands beside the last token
of the prefix before it, which merges leave as two. So

    P_word[i] = P_word[i - len(t)] + 1

which one pass over the word finds, however long it is, with a memo of the
pairs that merges leave alone. Words of Latin letters, and all long ones, are
counted so; every prefix of another short segment is counted by the library
once. Segments are remembered by their counts, so a text is split, looked up
and joined, never encoded as a whole and never a second time.

:func:`prefix_table` stores ``P`` as its step at each character, with ``P`` and
its least value for each block of characters. Totals, limits, truncation to a
budget (:func:`cut_at`) and the count of any prefix (:func:`tokens_before`) are
read from that table in the JVM.

Nulls count as empty; an empty text has 0 bytes and 0 tokens; null ids pass
through; repeated rows give one result each; very long texts, words and runs of
white space take time in proportion to their length; an empty table gives an
empty result; columns besides the two named are not read, so clashing names are
harmless.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_arrow, utf8

#: White space beyond ASCII: fixed values of the Unicode standard.
_ODD = "\x85\xa0  -     　"
ODD_SPACE = re.compile(f"[{_ODD}]")
BLANKS = re.compile(f"[ \t-\r{_ODD}]*")
ODD_SEGMENT = re.compile(f"[ \t-\r{_ODD}]*[^ \t-\r{_ODD}]+|[ \t-\r{_ODD}]+")
#: In UTF-8: Latin letters up to U+024F, marks, white space.
_LETTERS, _MARKS, _SPACE = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+", rb"[!-/:-@\[-`{-~]", rb"[ \t-\r]"
_END = rb"(?=" + _SPACE + rb"|\Z)"
#: A blank and letters up to white space or marks before it, such marks, or any segment.
SEGMENT = re.compile(rb"(?<![ \t-\r]) " + _LETTERS + rb"(?:" + _END + rb"|(?=" + _MARKS + rb"+" + _END + rb"))|(?<=[A-Za-z\x80-\xbf])" + _MARKS + rb"+" + _END + rb"|[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
WORD = re.compile(rb" " + _LETTERS + rb"|" + _MARKS + rb"+").fullmatch
#: A segment of a line end, letters and final marks, which are a word of their own.
PLAIN = re.compile(rb"(\n?)(" + _LETTERS + rb")(" + _MARKS + rb"*)").fullmatch
MEMO_ENTRIES, MEMO_BYTES, MEMO_PAIRS, SHORT, BLOCK = 250_000, 48, 500_000, 64, 256

_loaded: dict[str, PrefixCosts] = {}


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, all others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """A byte-level vocabulary with its merges, counted prefix by prefix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        data = lambda token: bytes(alphabet[c] for c in token)
        self.ids = {data(t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        self.longest = max(map(len, self.ids))
        #: Every end of a token, with the token's number or -1.
        self.ended = {t[k:]: -1 for t in self.ids for k in range(1, len(t))} | self.ids
        #: The longest token that a token ends in besides itself, with its length.
        self.shorter = {i: next(((self.ids[t[k:]], len(t) - k) for k in range(1, len(t)) if t[k:] in self.ids), None) for t, i in self.ids.items()}
        self.bytes_of = {i: t for t, i in self.ids.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(self.ids[data(a)], self.ids[data(b)]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = {(a, b): self.ids[self.bytes_of[a] + self.bytes_of[b]] for a, b in self.ranks}
        self.parts = {t: pair for pair, t in self.merged.items()}
        #: Whether numbers follow the order of merges, so that a larger token was made later.
        self.in_order = list(self.merged.values()) == sorted(set(self.merged.values())) and min(self.parts, default=0) > max((i for t, i in self.ids.items() if len(t) == 1), default=-1)
        self.pairs: dict[int, bool] = {}
        self.word, self.count, self.last, self.step = b"", [0], [-1], []

    def encode(self, word: bytes) -> list[int]:
        """The merges as they are defined, for short words."""
        parts = [self.ids[word[k : k + 1]] for k in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [self.merged[parts[at], parts[at + 1]]]
        return parts

    def _stands(self, before: int, token: int) -> bool:
        """Whether merges leave two tokens as they are; ``before`` is -1 at the start of a word.

        The merges are undone from the last one on: what then stands on either
        side of the border must not be merged before it was used up.
        """
        if before < 0:
            return self.encode(self.bytes_of[token]) == [token]
        if not self.in_order:
            return self.encode(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        until = 1 << 60
        while True:
            if self.merged.get((before, token), until) < until:
                return False
            if before > token:
                if before not in self.parts:
                    return True
                until, before = before, self.parts[before][1]
            else:
                if token not in self.parts:
                    return True
                until, token = token + 1, self.parts[token][0]  # of equal merges the left one comes first

    def _read(self, word: bytes) -> None:
        """``count``, ``last`` and ``step`` of a word, for each of its bytes.

        What the word before has in common with this one is kept: sorted words
        are read from where they part.
        """
        ended, shorter, pairs, count, last, step = self.ended.get, self.shorter, self.pairs, self.count, self.last, self.step
        if len(pairs) > MEMO_PAIRS:
            pairs.clear()
        same = 0
        for a, b in zip(word, self.word, strict=False):
            if a != b:
                break
            same += 1
        del count[same + 1 :], last[same + 1 :], step[same:]
        for i in range(same + 1, len(word) + 1):
            k = i - 1
            while k >= 0 and (found := ended(word[k:i])) is not None:
                if found >= 0:
                    j, token = k, found  # the longest one so far that ends here
                k -= 1
            while True:
                before = last[j]
                key = (before << 24) + token
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self._stands(before, token)
                if fits:
                    break
                token, size = shorter[token]
                j = i - size
            n = count[j] + 1
            step.append((n - count[-1]) & 255)
            count.append(n)
            last.append(token)
        self.word = word

    def prefixes(self, word: bytes) -> list[int]:
        """Tokens of ``word[:i]`` for each ``i`` from 0 on."""
        self._read(word)
        return list(self.count)

    def steps(self, word: bytes) -> bytes:
        """What each character adds to them, in one signed byte."""
        self._read(word)
        if word.isascii():
            return bytes(self.step)
        ends = [k for k in range(1, len(word)) if word[k] & 0xC0 != 0x80]
        return _steps([self.count[k] for k in (0, *ends, len(word))])


def _steps(counts: list[int]) -> bytes:
    """Differences in one signed byte each."""
    return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)])


class PrefixCosts:
    """A tokenizer with remembered prefix counts of segments, as the step at each character."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.merges = Merges(path)
        if self.merges.longest > 128:
            raise ValueError("tokens of more than 128 bytes: a step may not fit in one byte")
        self.added = re.compile("(" + "|".join(re.escape(t.content) for t in self.encoder.get_added_tokens_decoder().values()) + ")")
        #: What was used lately, and what was before that.
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> PrefixCosts:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def segments(text: bytes) -> list[bytes]:
        if not text.isascii() and ODD_SPACE.search(known := text.decode("utf-8", "replace")):
            return [s.encode() for s in ODD_SEGMENT.findall(known)]
        return SEGMENT.findall(text)

    def _word(self, word: str) -> list[int]:
        """Counts at each character of a piece that the tokenizer's pattern does not split, nor any prefix of it."""
        data = word.encode()
        counts = self.merges.prefixes(data)
        return counts if len(data) == len(word) else [counts[k] for k in [0, *np.cumsum([len(c.encode()) for c in word]).tolist()]]

    def _long(self, text: str) -> list[int]:
        """Counts at each character of any segment, piece by piece."""
        counts, at, total, piece = [0], 0, 0, (0, 0)
        for k, chunk in enumerate(self.added.split(text)):
            if k % 2:  # an added token: until its last character it is ordinary text behind the piece before
                first, before = piece
                counts += [before + n for n in self.encoded([text[first : at + j] for j in range(1, len(chunk))])]
                total += 1
                counts.append(total)
                at += len(chunk)
                piece = (at, total)
                continue
            blank = BLANKS.match(chunk).end()
            run = self._word(chunk[:blank])
            for _, (a, b) in self.encoder.pre_tokenizer.pre_tokenize_str(chunk):
                word, piece = chunk[a:b], (at + a, total)
                inside = self._word(word) if len(word) > 8 else [0, *self.encoded([word[:j] for j in range(1, len(word) + 1)])]
                # A prefix that ends in white space has its whole run as one piece.
                counts += [run[a + j] + counts[at] if a + j <= blank else total + inside[j] for j in range(1, len(word) + 1)]
                total += inside[-1]
            at += len(chunk)
        return counts

    def learn(self, wanted: set[bytes]) -> dict[bytes, bytes]:
        """Steps of segments; new words are read in sorted order."""
        memo, older, out, words, plain, whole = self.memo, self.older, {}, set(), [], []
        for seg in wanted:
            steps = older.get(seg)
            if steps is not None:
                out[seg] = steps
            elif WORD(seg):
                words.add(seg)
            elif found := PLAIN(seg):
                line, *parts = found.groups()
                plain.append((seg, line, parts))
                words.update(parts)
            else:
                text = seg.decode("utf-8", "replace")
                if len(text) > SHORT:
                    out[seg] = _steps(self._long(text))
                else:
                    whole.append((seg, text))
        words = [w for w in words if w not in memo]
        words.sort()
        out.update(zip(words, map(self.merges.steps, words), strict=True))
        for seg, line, parts in plain:
            out[seg] = b"\1" * len(line) + b"".join([memo[w] if w in memo else out[w] for w in parts])
        found = self.encoded([text[:j] for _, text in whole for j in range(1, len(text) + 1)])
        at = 0
        for seg, text in whole:
            out[seg] = _steps([0, *found[at : at + len(text)]])
            at += len(text)
        out.pop(b"", None)
        if len(memo) > MEMO_ENTRIES:
            self.memo, self.older = {}, memo
        self.memo.update((k, v) for k, v in out.items() if len(k) <= MEMO_BYTES)
        return out

    def steps(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The steps of all characters of the texts, one text after the other, and the characters of each text."""
        split = list(map(self.segments, texts))
        flat = list(chain.from_iterable(split))
        found = list(map(self.memo.get, flat))
        missing = [k for k, x in enumerate(found) if x is None]
        if missing:
            extra = self.learn({flat[k] for k in missing})
            for k in missing:
                found[k] = extra[flat[k]]
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        borders = np.concatenate([[0], np.cumsum([len(segs) for segs in split])]).astype(np.int64)
        return np.frombuffer(b"".join(found), np.int8), np.diff(upto[borders])


TABLE = "n_bytes long, n_chars long, n_tokens long, starts array<int>, lows array<int>, steps array<tinyint>"


def prefix_table(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``P`` of every text, stored: ``doc_id, n_bytes, n_chars, n_tokens, starts, lows, steps``.

    ``steps`` has ``P[i + 1] - P[i]`` for each character, ``starts`` and ``lows``
    have the first and the least ``P`` of each block of 256 prefixes. A narrow
    plan: one scan of two columns and no shuffle. A task holds one Arrow batch
    and a memo of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = PrefixCosts.of(tokenizer_path)
        gc.collect()
        gc.freeze()  # the vocabulary need not be walked again; nothing here makes cycles
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                texts = utf8(part.column(1))
                steps, chars = costs.steps(texts)
                ends = np.cumsum(chars)
                # P of all texts, each from 0 on: a text has one prefix more than characters.
                one_more = np.insert(steps.astype(np.int32), ends - chars, 0)
                first = ends - chars + np.arange(len(chars))
                p = np.cumsum(one_more, dtype=np.int64)
                p -= np.repeat(p[first], chars + 1)
                blocks = chars // BLOCK + 1
                block = np.repeat(first - BLOCK * (np.cumsum(blocks) - blocks), blocks) + BLOCK * np.arange(blocks.sum())
                lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(chars), pa.array(p[first + chars]), lists(pa.array(p[block].astype(np.int32)), blocks), lists(pa.array(np.minimum.reduceat(p, block).astype(np.int32)), blocks), lists(pa.array(steps), chars)],
                    ["doc_id", "n_bytes", "n_chars", "n_tokens", "starts", "lows", "steps"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.transform(in_arrow, run, f"doc_id {kind}, {TABLE}")


def _sum(steps: Column, start: Column) -> Column:
    return F.aggregate(steps, start.cast("int"), lambda p, d: p + d.cast("int"))


def tokens_before(chars: int) -> Column:
    """``P`` at a number of characters (or at the end, where the text is shorter), from the columns of :func:`prefix_table`."""
    at = F.least(F.lit(chars), F.col("n_chars")).cast("int")
    block = F.floor(at / BLOCK).cast("int")
    return _sum(F.slice("steps", block * BLOCK + 1, at - block * BLOCK), F.get("starts", block)).cast("long")


def cut_at(table: DataFrame, budget: int, *more: str) -> DataFrame:
    """``doc_id, cut_chars, cut_tokens`` and ``more`` columns: the longest prefix of no more than ``budget`` tokens. No text is read."""
    if budget < 0:
        raise ValueError(f"budget: {budget}")
    block = F.array_max(F.filter(F.sequence(F.lit(0), F.size("lows") - 1), lambda k: F.get("lows", k) <= budget))
    rows = table.withColumn("_block", block)
    state = lambda at, p, cut, tokens: F.struct(at.alias("at"), p.alias("p"), cut.alias("cut"), tokens.alias("tokens"))
    none, first, start = F.lit(None).cast("int"), F.col("_block") * BLOCK, F.get("starts", F.col("_block"))

    def step(s: Column, d: Column) -> Column:
        p = s["p"] + d.cast("int")
        return state(s["at"] + 1, p, F.when(p <= budget, s["at"] + 1).otherwise(s["cut"]), F.when(p <= budget, p).otherwise(s["tokens"]))

    began = state(first, start, F.when(start <= budget, first).otherwise(none), F.when(start <= budget, start).otherwise(none))
    found = rows.withColumn("_found", F.aggregate(F.slice("steps", first + 1, F.lit(BLOCK - 1)), began, step))
    return found.select("doc_id", *more, F.col("_found.cut").alias("cut_chars"), F.col("_found.tokens").alias("cut_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, from :func:`prefix_table`: bytes, tokens, whether they exceed ``limit``, and the longest prefix within it.

    The last, as ``cut_chars, cut_tokens``, is where to truncate a text.
    """
    table = prefix_table(docs, tokenizer_path, id_col, text_col)
    over = (F.col("n_tokens") > limit).alias("over_limit")
    cut = cut_at(table, limit, "n_bytes", "n_tokens")
    return cut.select("doc_id", "n_bytes", "n_tokens", over, "cut_chars", "cut_tokens")
