"""Operator 4: personal data by fixed patterns and a semi-Markov CRF.

The base finds e-mail addresses, IP addresses, card numbers and telephone
numbers by pattern, leftmost and non-overlapping for each kind, over whole
texts; matches that fail their test are dropped. The CRF adds spans the
patterns miss (numbers without ``+``, addresses that spell out their marks).
It scores whole segments of up to five blank-separated tokens by features of
the segment (shape, digits, marks, checks, neighbours) and sums over all
segmentations of a window in training; decoding picks the best joint choice of
borders and kinds. Only tokens with a digit, ``@`` or a spelt-out mark can be
part of an entity, so windows around those tokens hold every decision. A window
has any length, as the dynamic program is linear in it, and windows are
disjoint, so added spans never overlap one another. A segment's scores depend
on its own text and the shapes beside it, and are remembered under just these:
results do not depend on what was read before.

Weights come from a bounded sample: windows of at most ``most_docs`` distinct
texts with the base's own spans as truth (``most_windows`` of them, which is
all that reaches the driver), and generated variants. Added spans never overlap
base spans, and every base span stays. Offsets count code points, ends are
exclusive. Of equally good segmentations the one with the earliest start of its
last segment wins, and the first kind. Nulls count as empty, very long texts
are read whole, repeated rows give one result each, null ids pass through, an
empty table gives an empty result, extra columns are not read. No shuffle of texts.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_arrow

KINDS = ["email", "ip", "card", "phone"]
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _is_card(text: str) -> bool:
    digits = _NOT_DIGITS.sub("", text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_ip(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_phone(text: str) -> bool:
    return 9 <= len(_NOT_DIGITS.sub("", text)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base, by kind and then start."""
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = m.start()
            while at > last and text[at - 1] in _LOCAL:
                at -= 1
            if at < m.start():
                out.append((0, at, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _is_ip(m.group())]
        out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _is_card(m.group())]
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if _is_phone(m.group())]
    return out


# The CRF. Kinds are numbered as in KINDS; 4 is "other", which segments of one token may have.
OTHER, LONGEST, CONTEXT = 4, 5, 3
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_ANCHOR = re.compile(r"[0-9@]|[(\[]at[)\]]")
_TRIM_LEFT, _TRIM_RIGHT = "\"'<[{", "\"'>]},;:!?.*#$%&|"


def _core(token: str) -> tuple[int, int]:
    """The part of a token without quotes and closing marks."""
    a, b = 0, len(token)
    while a < b and token[a] in _TRIM_LEFT:
        a += 1
    while b > a and token[b - 1] in _TRIM_RIGHT:
        b -= 1
    return a, b


def _shape(token: str) -> str:
    """What features see of a token: its marks, lengths of digit runs, and whether letters stand among digits."""
    low = token.lower()
    if low in ("at", "dot", "(at)", "[at]", "(dot)", "[dot]"):
        return low.strip("()[]").upper()
    if not _DIGIT.search(low) and "@" not in low:
        return "w" if low.isalpha() else "w."
    out = re.sub("[^\x00-\x7f]+|[a-z]+", "a", low)
    return re.sub("[0-9]+", lambda m: str(min(len(m.group()), 9)) if len(m.group()) < 10 else f"N{min(len(m.group()), 20)}", out)[:60]


def _segment_features(text: str, shapes: tuple[str, ...], before: str, after: str) -> list[str]:
    """Features of a whole segment; its text is what stands between the cores of its first and last token."""
    digits = _NOT_DIGITS.sub("", text)
    n, k = len(digits), len(shapes)
    letters = any(c.isalpha() for c in text)
    out = [f"k{k}", f"n{min(n, 20)}", f"s{' '.join(shapes)}" if k <= LONGEST else "", f"b{before}", f"a{after}", f"l{letters}"]
    out.append(f"d{'9-15' if 9 <= n <= 15 else '13-19' if 13 <= n <= 19 else '7-8' if 7 <= n <= 8 else 'no'}:{letters}")
    if "@" in text:
        host = text.rpartition("@")[2]
        out.append(f"at{'.' in host.strip('.')}:{k}")
    if "AT" in shapes[1:-1]:
        out.append(f"AT:{'DOT' in shapes[shapes.index('AT') :] or '.' in text}")
    if not letters:
        dots = text.count(".")
        if dots == 3 and k == 1:
            out.append(f"ip{_is_ip(text) if re.fullmatch('[0-9]+([.][0-9]+){3}', text) else False}")
        if 13 <= n <= 19:
            out.append(f"luhn{luhn(digits)}")
        groups = re.findall("[0-9]+", text)
        if 9 <= n <= 15 and len(groups) >= 3 and dots != 3:
            out.append(f"groups{len(groups[-1]) == 4}{len(groups[-2]) == 3}{text[0] in '+('}")
    return [f for f in out if f]


class Window:
    """Tokens around anchors: texts, shapes and the segments that may be entities."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]) -> None:
        self.cores, self.shapes = [], []
        for a, b in tokens:
            x, y = _core(text[a:b])
            self.cores.append((a + x, a + y))
            self.shapes.append(_shape(text[a + x : a + y]))
        self.text = text

    def segment(self, i: int, j: int) -> tuple[str, str, str] | None:
        """All that features see of a segment, its text between cores and the shapes beside it; None where it can be no segment."""
        part = self.shapes[i:j]
        if j - i > 1 and any(x[0] == "w" for x in part):  # words join an entity around a spelt-out mark only, and before a dot
            at = part.index("AT") if "AT" in part[1:-1] else 0
            if not at or ("DOT" not in part[at + 1 : -1] and "." not in self.text[slice(*self.cores[j - 1])]):
                return None
        before = self.shapes[i - 1][:1] if i else "^"
        after = self.shapes[j][:1] if j < len(self.shapes) else "$"
        return self.text[self.cores[i][0] : self.cores[j - 1][1]], before, after

    def segments(self) -> dict[tuple[int, int], list[str]]:
        n, out = len(self.shapes), {}
        for i in range(n):
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                if seen := self.segment(i, j):
                    out[i, j] = _segment_features(seen[0], tuple(self.shapes[i:j]), *seen[1:])
        return out


def windows(text: str) -> Iterator[Window]:
    """Windows of tokens within :data:`CONTEXT` of an anchor, merged where they touch."""
    if not _ANCHOR.search(text) and ("at" not in text or "dot" not in text):
        return
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    marks = [i for i, (a, b) in enumerate(tokens) if _ANCHOR.search(text, a, b) or text[a:b] in ("at", "dot") and 0 < i < len(tokens) - 1 and _spelt(text, tokens, i)]
    at = 0
    while at < len(marks):
        first = last = marks[at]
        while at + 1 < len(marks) and marks[at + 1] - last <= 2 * CONTEXT:
            at += 1
            last = marks[at]
        at += 1
        yield Window(text, tokens[max(0, first - CONTEXT) : last + CONTEXT + 1])


def _spelt(text: str, tokens: list[tuple[int, int]], i: int) -> bool:
    """``at`` with ``dot`` two tokens on, or the other way round."""
    other = {"at": i + 2, "dot": i - 2}[text[slice(*tokens[i])]]
    return 0 <= other < len(tokens) and text[slice(*tokens[other])].strip(".,") in ("dot", "at")


class SemiCrf:
    def __init__(self, weights: dict[str, list[float]] | None = None) -> None:
        self.weights = weights or {}
        self.memo: dict[tuple[str, str, str], list[float]] = {}

    def scores(self, features: list[str]) -> list[float]:
        total = [0.0] * 5
        for f in features:
            w = self.weights.get(f)
            if w:
                for y in range(5):
                    total[y] += w[y]
        return total

    def _allowed(self, i: int, j: int) -> range:
        return range(5) if j == i + 1 else range(4)

    def _segment_scores(self, window: Window, i: int, j: int) -> list[float] | None:
        seen = window.segment(i, j)
        if seen is None:
            return None
        found = self.memo.get(seen)
        if found is None:
            found = self.scores(_segment_features(seen[0], tuple(window.shapes[i:j]), *seen[1:]))
            if len(seen[0]) <= 80:
                if len(self.memo) > 200_000:
                    self.memo.clear()
                self.memo[seen] = found
        return found

    def decode(self, window: Window) -> list[tuple[int, int, int]]:
        """Best segmentation: (kind, first token, end token) of its entities."""
        n = len(window.shapes)
        best: list[tuple[float, tuple[int, int] | None]] = [(0.0, None)] + [(-1e300, None)] * n
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST), j):
                s = self._segment_scores(window, i, j)
                if s is not None:
                    for y in self._allowed(i, j):
                        if best[i][0] + s[y] > best[j][0]:
                            best[j] = (best[i][0] + s[y], (i, y))
        out, j = [], n
        while j:
            i, y = best[j][1]
            if y != OTHER:
                out.append((y, i, j))
            j = i
        return out[::-1]

    def train(self, examples: list[tuple[Window, set[tuple[int, int, int]]]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-4, seed: int = 3) -> SemiCrf:
        """Stochastic gradient on the conditional log-likelihood, by forward and backward sums over segmentations."""
        rng = random.Random(seed)
        prepared = []
        for window, gold in examples:
            segs = window.segments()
            covered = {k for _, i, j in gold for k in range(i, j)}
            true = {(i, j): y for y, i, j in gold} | {(k, k + 1): OTHER for k in range(len(window.shapes)) if k not in covered}
            if all(s in segs for s in true):
                prepared.append((len(window.shapes), segs, true))
        for epoch in range(epochs):
            rng.shuffle(prepared)
            step = rate / (1 + epoch)
            for n, segs, true in prepared:
                s = {k: self.scores(f) for k, f in segs.items()}
                forward, backward = [-1e300] * (n + 1), [-1e300] * (n + 1)
                forward[0] = backward[n] = 0.0
                total = {k: _logsum([v[y] for y in self._allowed(*k)]) for k, v in s.items()}
                for j in range(1, n + 1):
                    forward[j] = _logsum([forward[i] + total[i, j] for i in range(max(0, j - LONGEST), j) if (i, j) in s])
                for i in range(n - 1, -1, -1):
                    backward[i] = _logsum([backward[j] + total[i, j] for j in range(i + 1, min(n, i + LONGEST) + 1) if (i, j) in s])
                for (i, j), v in s.items():
                    for y in self._allowed(i, j):
                        p = exp(min(0.0, forward[i] + v[y] + backward[j] - forward[n]))
                        g = (true.get((i, j)) == y) - p
                        if abs(g) > 1e-3:
                            for f in segs[i, j]:
                                w = self.weights.setdefault(f, [0.0] * 5)
                                w[y] += step * (g - l2 * w[y])
        return self


def _logsum(xs: list[float]) -> float:
    if not xs:
        return -1e300
    m = max(xs)
    return m + log(sum(exp(x - m) for x in xs))


def variants(seed: int = 9, each: int = 60) -> list[tuple[str, list[tuple[int, str]]]]:
    """Generated lines with the entities they hold, in their order: forms that the patterns miss, lists of them, and look-alikes that are none."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    year = lambda: f"{rng.choice(['19', '20'])}{d(2)}"
    number = lambda: rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(4)}"])
    for _ in range(each):
        phone = number()
        mail = rng.choice([f"{word()} at {word()} dot com", f"{word()} (at) {word()} (dot) org", f"{word()}.{d(2)} [at] {word()}.net"])
        plain = rng.choice([f"{word()}.{d(2)}@{word()}{d(1)}.{word()}.com", f"{word()}@{word()}.org"])
        ip = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        for kind, text in ((3, phone), (0, mail), (0, plain), (1, ip), (3, f"+1 ({d(3)}) {d(3)}-{d(4)}")):
            out.append((f"{word()} {word()} {text}{rng.choice(['', ',', '.'])} {word()} {word()}", [(kind, text)]))
        several = [number() for _ in range(rng.randint(2, 5))]
        out.append((f"{word()} {', '.join(several)} {word()}", [(3, x) for x in several]))
        nones = [
            d(rng.randint(1, 8)), f"{d(1)}.{d(1)}.", f"{d(4)}-{d(2)}-{d(2)}", f"{rng.randint(256, 999)}.{d(2)}.{d(2)}.{d(2)}", f'"{"".join(rng.choice("0123456789abcdef") for _ in range(32))}"',
            f"{d(3)} {d(2)} {d(1)}", f"{word()} at {word()}", f"{d(2)}:{d(2)}", d(rng.randint(9, 12)), " ".join(year() for _ in range(rng.randint(2, 4))), f"{d(2)} {d(2)} {year()} {d(4)}",
            ", ".join(d(rng.randint(1, 4)) for _ in range(rng.randint(3, 6))), " ".join(d(rng.randint(2, 4)) for _ in range(rng.randint(3, 5))), f"{d(2)}/{d(2)}/{year()} {d(2)}:{d(2)}:{d(2)}", f"{d(3)}.{d(2)} {d(4)}.{d(2)} {d(2)}",
        ]
        bad = next(x for x in iter(lambda: d(16), "") if not luhn(x))
        good = next(x for x in iter(lambda: d(16), "") if luhn(x))
        out += [(f"{word()} {word()} {none} {word()} {word()}", []) for none in rng.sample(nones, 4)]
        out += [(f"{word()} {bad} {word()}", []), (f"{word()} {good} {word()}", [(2, good)])]
    return out


def placed(line: str, entities: list[tuple[int, str]]) -> list[tuple[int, int, int]]:
    """The spans of a line of :func:`variants`."""
    out, at = [], 0
    for kind, text in entities:
        at = line.index(text, at)
        out.append((kind, at, at + len(text)))
        at += len(text)
    return out


def _labelled(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[Window, set[tuple[int, int, int]]]]:
    out = []
    for w in windows(text):
        gold, fits = set(), True
        for kind, a, b in spans:
            inside = [k for k, (x, y) in enumerate(w.cores) if x < b and a < y]
            if inside:
                if w.cores[inside[0]][0] == a and w.cores[inside[-1]][1] == b and len(inside) <= LONGEST:
                    gold.add((kind, inside[0], inside[-1] + 1))
                else:
                    fits = False
        if fits and not any(g != h and g[1] < h[2] and h[1] < g[2] for g in gold for h in gold):
            out.append((w, gold))
    return out


def _window_lines(most: int):
    """``h, k, line, spans`` of the first windows of each text, from ``h, text``: all that the fit needs of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base = base_spans(text)
                for k, w in zip(range(most), windows(text), strict=False):
                    at, end = w.cores[0][0], w.cores[-1][1]
                    rows.append((h, k, text[at:end], [[kind, x - at, y - at] for kind, x, y in base if x < end and at < y]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, _LINE.types, strict=True)], schema=_LINE)

    return run


_LINE = pa.schema([("h", pa.int64()), ("k", pa.int32()), ("line", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))])


def fit(docs: DataFrame, most_docs: int = 300, most_windows: int = 400) -> SemiCrf:
    """A CRF from windows of a bounded sample of distinct texts, under the base's spans, and from generated variants.

    Hashes of texts are drawn first, then the windows of the texts that have
    them, so the driver gets ``most_docs`` numbers and ``most_windows`` lines.
    """
    some = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text").alias("h"), "text")
    chosen = [r.h for r in some.select("h").distinct().orderBy("h").limit(most_docs).collect()]
    lines = some.where(F.col("h").isin(chosen)).transform(in_arrow, _window_lines(most_windows), "h long, k int, line string, spans array<array<int>>").dropDuplicates(["h", "k"]).orderBy("h", "k").limit(most_windows)
    examples = [e for r in lines.collect() for e in _labelled(r.line, [tuple(x) for x in r.spans])] if chosen else []
    for line, entities in variants():
        examples += _labelled(line, placed(line, entities))
    return SemiCrf().train(examples)


def all_spans(text: str, base: list[tuple[int, int, int]], crf: SemiCrf) -> list[tuple[int, int, int]]:
    """Base spans and the CRF's, which give way where they overlap."""
    added = []
    for w in windows(text):
        for kind, i, j in crf.decode(w):
            a, b = w.cores[i][0], w.cores[j - 1][1]
            if a < b and not any(a < y and x < b for _, x, y in base):
                added.append((kind, a, b))
    return sorted({*base, *added})


def find(docs: DataFrame, crf: SemiCrf) -> DataFrame:
    """One row per document: counts and digest of the base, and all spans."""
    weights = crf.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = SemiCrf(weights), ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
        join = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, rows = b.slice(at, 512), []
                for text in part.column(1).to_pylist():
                    base = base_spans(text or "")
                    counts = [sum(k == x[0] for x in base) for k in range(4)]
                    rows.append((*counts, hashlib.sha256(join(base).encode()).hexdigest(), join(all_spans(text or "", base, model))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(zip(*rows, strict=True)))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(in_arrow, run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
