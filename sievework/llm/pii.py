"""Personal data by a skip-chain conditional random field (operator 13).

Patterns find e-mail addresses, IP addresses, card and phone numbers. What they drop or cannot match is left to a random
field over the tokens of a document that have a digit or ``@`` (no other token can be part of such a value, so the
field falls apart there). Neighbouring tokens share a transition potential; each token also shares a potential with the
one before it in the document that repeats it, and with the one before it that ends in the same digits, however far
away. Loopy message passing makes the labels of a document agree: a number that is a phone number in one place is one
in another. Tokens within a pattern's finding are clamped to it.

The field is trained on what the patterns find in a bounded sample of documents, and on copies of these with their
findings written as the patterns miss them: behind other digits, twice in a row, without the country code.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import arrays
from sievework.llm.shared import distinct_names

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind (its place in KINDS), end

# ---- patterns ----

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The part behind a local part; a local part reaches back over all characters it can have, to the last finding at most.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Runs of digits are taken whole (a match cannot begin or end within one), so that no run is read more than once a part.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_ip(s: str) -> bool:
    """Four numbers of at most 255."""
    parts = [p.lstrip("0") for p in s.split(".")]
    return len(parts) == 4 and all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def is_card(s: str) -> bool:
    """14 to 19 digits that pass Luhn's check."""
    d = _digits(s)
    return 14 <= len(d) <= 19 and (sum(map(int, d[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in d[-2::-2])) % 10 == 0


def found_by_patterns(text: str) -> tuple[list[Span], bool]:
    """The findings in order of start and kind, and whether a match failed its check and was dropped."""
    out: list[Span] = []
    end, dropped = 0, False
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            end = m.end()
            out.append((start, 0, end))
    for kind, pattern, good in ((1, _IP, is_ip), (2, _CARD, is_card), (3, _PHONE, lambda s: 10 <= len(_digits(s)) <= 15)):
        for m in pattern.finditer(text):
            if good(m.group()):
                out.append((m.start(), kind, m.end()))
            elif kind == 3 or kind == 2 and m.end() - m.start() >= 14:
                dropped = True
    return sorted(out), dropped


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# ---- tokens, features and the graph ----

#: Labels: none, e-mail, IP, card and its further parts, phone and its further parts; and the kind of each.
NONE, EMAIL, IP, CARD, CARD_MORE, PHONE, PHONE_MORE = range(7)
LABELS = 7
KIND_OF = (None, 0, 1, 2, 2, 3, 3)
_MARK = re.compile(r"[0-9@]+")
_REST = re.compile(r"[A-Za-z0-9@._%+-]*+")
_TOKEN = _LOCAL | {"@"}
_NEAR = re.compile(r"[\x20().,/:-]{1,3}")
_WORD = re.compile(r"([^\W\d_]{1,16})\W{0,3}$")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_COUNTS = [0, 1, 2, 3, 4, 5, 7, 8, 10, 11, 12, 14, 16, 17, 20]
WORD_CELLS = 64
FEATURES = len(_COUNTS) + 16 + WORD_CELLS
IMPOSSIBLE = -1e4
#: Kinds of edges: neighbours, repeated tokens, tokens of the same last digits.
CHAIN, REPEATED, SIMILAR = range(3)
SAME_DIGITS = 7


@dataclass
class Graph:
    """The tokens of a text: spans, features (indices that are on), possible labels, edges (left, right, kind)."""

    spans: list[tuple[int, int]]
    on: list[list[int]]
    possible: list[tuple[int, ...]]
    edges: list[tuple[int, int, int]]


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs of token characters that have a digit or ``@``, without the marks at their ends."""
    out, end = [], 0
    for m in _MARK.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and text[start - 1] in _TOKEN:
            start -= 1
        end = _REST.match(text, m.end()).end()
        whole = text[start:end]
        s, e = start + len(whole) - len(whole.lstrip("._%-")), end - len(whole) + len(whole.rstrip("._%+-"))
        if s < e:
            out.append((s, e))
    return out


def graph(text: str) -> Graph:
    spans = tokens(text)
    on, possible, edges = [], [], []
    last: dict[str, int] = {}
    ends: dict[str, int] = {}
    for i, (s, e) in enumerate(spans):
        t = text[s:e]
        d = _digits(t)
        letters = any(c.isalpha() for c in t)
        plain = not letters and "@" not in t and "_" not in t and "%" not in t
        four = plain and t.count(".") == 3 and t.strip("+-") == t and all(p.isdigit() for p in t.split("."))
        base = len(_COUNTS)
        f = [max(k for k, c in enumerate(_COUNTS) if len(d) >= c)]
        before, after = text[s - 1 : s], text[e : e + 1]
        marks = (
            True, "@" in t, _MAIL.fullmatch(t) is not None, four, four and is_ip(t), plain and "." not in t and is_card(t), t[0] == "+", before == "(", after == ")",
            t.count("-") == 1, t.count("-") == 2, t.count("-") > 2, letters, d == t, t.count(".") in (1, 2), len(d) == 16 and plain,
        )
        f += [base + k for k, x in enumerate(marks) if x]
        word = _WORD.search(text, max(0, s - 24), s)
        if word:
            f.append(base + 16 + crc32(word[1].lower().encode()) % WORD_CELLS)
        on.append(f)
        near = i > 0 and _NEAR.fullmatch(text, spans[i - 1][1], s) is not None
        can = [NONE]
        if "@" in t:
            can.append(EMAIL)
        if four:
            can.append(IP)
        if plain and d and "." not in t and "+" not in t and len(d) <= 19:
            can += [CARD, CARD_MORE] if near else [CARD]
        if plain and d and len(d) <= 15:
            can += [PHONE, PHONE_MORE] if near else [PHONE]
        possible.append(tuple(can))
        if near:
            edges.append((i - 1, i, CHAIN))
        key = t.lower()
        if len(key) >= 6:
            j = last.get(key)
            if j is not None:
                edges.append((j, i, REPEATED))
            last[key] = i
        if SAME_DIGITS <= len(d) <= 15 and not letters:
            j = ends.get(d[-SAME_DIGITS:])
            if j is not None and text[spans[j][0] : spans[j][1]].lower() != key:
                edges.append((j, i, SIMILAR))
            ends[d[-SAME_DIGITS:]] = i
    return Graph(spans, on, possible, edges)


def clamped(g: Graph, found: list[Span]) -> list[int | None]:
    """The label of each token that overlaps a finding, None for the others."""
    out: list[int | None] = [None] * len(g.spans)
    ends = [e for _, e in g.spans]
    for s, kind, e in found:
        first = True
        for i in range(bisect_right(ends, s), len(g.spans)):
            if g.spans[i][0] >= e:
                break
            if out[i] is None:
                out[i] = (EMAIL, IP, CARD if first else CARD_MORE, PHONE if first else PHONE_MORE)[kind]
            first = False
    return out


@dataclass
class Batch:
    """The graphs of several texts as one."""

    rows: np.ndarray  # of on features
    columns: np.ndarray
    mask: np.ndarray  # IMPOSSIBLE or 0, by token and label
    edges: np.ndarray
    heads: np.ndarray

    @staticmethod
    def of(graphs: list[Graph], known: list[list[int | None]]) -> Batch:
        heads = np.cumsum([0, *(len(g.spans) for g in graphs)])
        n = int(heads[-1])
        count = [len(f) for g in graphs for f in g.on]
        columns = np.fromiter((x for g in graphs for f in g.on for x in f), np.int64, sum(count))
        mask = np.full((n, LABELS), IMPOSSIBLE)
        for h, g, k in zip(heads, graphs, known, strict=False):
            for i, can in enumerate(g.possible):
                mask[h + i, list(can) if k[i] is None else k[i]] = 0
        edges = np.array([(h + a, h + b, kind) for h, g in zip(heads, graphs, strict=False) for a, b, kind in g.edges], np.int64).reshape(-1, 3)
        return Batch(np.repeat(np.arange(n), count), columns, mask, edges, heads)

    def unary(self, weights: np.ndarray) -> np.ndarray:
        w = weights[self.columns]
        return self.mask + np.stack([np.bincount(self.rows, w[:, k], len(self.mask)) for k in range(LABELS)], 1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def pass_messages(unary: np.ndarray, edges: np.ndarray, tables: np.ndarray, rounds: int = 12, damping: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Loopy sum-product: log marginals of tokens (n x labels), and of edges (edges x labels x labels).

    All messages are renewed at once, ``rounds`` times; without damping this is exact on trees of a diameter up to that.
    """
    n, labels = unary.shape
    m = len(edges)
    if not m:
        return unary - _log_sum(unary, 1)[:, None], np.zeros((0, labels, labels))
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    kind = edges[:, 2]
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    message = np.zeros((2 * m, labels))

    def belief() -> np.ndarray:
        return unary + np.stack([np.bincount(dst, message[:, k], n) for k in range(labels)], 1)

    for _ in range(rounds):
        out = belief()[src] - message[back]
        new = np.empty_like(message)
        for k in range(labels):
            new[:m, k] = _log_sum(out[:m] + tables[kind, :, k], 1)
            new[m:, k] = _log_sum(out[m:] + tables[kind, k, :], 1)
        new -= _log_sum(new, 1)[:, None]
        message = damping * message + (1 - damping) * new
    all_ = belief()
    out = all_[src] - message[back]
    joint = out[:m, :, None] + tables[kind] + out[m:, None, :]
    joint -= _log_sum(joint.reshape(m, -1), 1)[:, None, None]
    return all_ - _log_sum(all_, 1)[:, None], joint


@dataclass
class Field:
    """Weights of features (features x labels) and potentials of edges (kinds x labels x labels)."""

    weights: np.ndarray
    tables: np.ndarray

    def marginals(self, batch: Batch) -> np.ndarray:
        return np.exp(pass_messages(batch.unary(self.weights), batch.edges, self.tables)[0])


def fit(graphs: list[Graph], labels: list[list[int]], known: list[list[int | None]], steps: int = 150, rate: float = 0.1, decay: float = 2e-3) -> Field:
    """Maximum likelihood of the labels given those that are known, by Adam on gradients of passed messages, with a squared penalty."""
    batch = Batch.of(graphs, known)
    y = np.array([x for one in labels for x in one], np.int64)
    n = max(1, len(y))
    ones = np.eye(LABELS)[y]
    p = [np.zeros((FEATURES, LABELS)), np.zeros((3, LABELS, LABELS))]
    moment = [(np.zeros_like(x), np.zeros_like(x)) for x in p]
    kind = batch.edges[:, 2]
    pair = np.zeros((len(kind), LABELS, LABELS))
    pair[np.arange(len(kind)), y[batch.edges[:, 0]], y[batch.edges[:, 1]]] = 1
    for step in range(1, steps + 1):
        token, edge = pass_messages(batch.unary(p[0]), batch.edges, p[1], rounds=6)
        gap = ones - np.exp(token)
        g = np.zeros_like(p[0])
        np.add.at(g, batch.columns, gap[batch.rows])
        h = np.zeros_like(p[1])
        np.add.at(h, kind, pair - np.exp(edge))
        for k in (REPEATED, SIMILAR):  # neither end comes first
            h[k] = (h[k] + h[k].T) / 2
        for x, grad, (m, v) in zip(p, (g / n - decay * p[0], h / n - decay * p[1]), moment, strict=True):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(*p)


# ---- training texts ----


def _rewritten(text: str, found: list[Span], r: random.Random) -> tuple[str, list[Span]]:
    """A copy of a text with its findings, and numbers that are none, written as the patterns may miss or mistake them; and the true spans."""
    phones, cards = ([text[s:e] for s, k, e in found if k == kind] for kind in (3, 2))
    out: list[str] = []
    spans: list[Span] = []
    size = 0

    def put(s: str, kind: int | None = None) -> None:
        nonlocal size
        if kind is not None:
            spans.append((size, kind, size + len(s)))
        out.append(s)
        size += len(s)

    at = 0
    for s, kind, e in found:
        if s < at:
            continue
        put(text[at:s])
        one = text[s:e]
        if kind == 2 and r.random() < 0.5:
            if r.random() < 0.5:
                put(str(r.randrange(1, 2000)) + " ")
            else:
                put(one, 2)
                put(" ")
        put(one, kind)
        if kind == 3 and r.random() < 0.5:
            put(" ")
            if cards and r.random() < 0.7:
                put(r.choice(cards), 2)
            else:
                put(str(r.randrange(10**6, 10**12)))
        at = e
    put(text[at:])
    words = [w for w in text.split() if w.isalpha()] or ["and"]

    def filler() -> None:
        put(" " + " ".join(r.choice(words) for _ in range(r.randint(2, 12))) + " ")

    for phone in phones:
        d = _digits(phone)
        if len(d) >= 10 and r.random() < 0.8:
            filler()
            a, b, c = d[-10:-7], d[-7:-4], d[-4:]
            put(r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", a + b + c)), 3)
    for _ in range(r.randint(1, 4)):
        filler()
        n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
        decoy = r.choice((f"{n(3)}-{n(3)}-{n(4)}", n(16), n(10), n(7), f"{n(3)}-{n(4)}", f"20{n(2)}-{n(2)}-{n(2)}", f"{n(1)}.{n(1)}.{n(2)}", f"9{n(2)}.7{n(2)}.{n(2)}.{n(2)}", f"({n(3)})", f"{n(4)} {n(4)}", f"{n(4)}-{n(6)}-{n(5)}"))
        put(decoy)
        if r.random() < 0.3:
            filler()
            put(decoy)
    filler()
    return "".join(out), spans


def examples(texts: list[str], seed: int = 5) -> tuple[list[Graph], list[list[int]], list[list[int | None]]]:
    """Graphs, labels and the labels that are given at prediction, of texts in which no match was dropped and of rewritten copies.

    In the texts themselves all labels are to be predicted; in the copies what the patterns find is given.
    """
    r = random.Random(seed)
    graphs, labels, known = [], [], []
    for text in texts:
        found, dropped = found_by_patterns(text)
        if dropped:
            continue
        g = graph(text)
        graphs.append(g)
        labels.append([x or NONE for x in clamped(g, found)])
        known.append([None] * len(g.spans))
        if not found:
            continue
        text, true = _rewritten(text, found, r)
        g = graph(text)
        graphs.append(g)
        given = clamped(g, found_by_patterns(text)[0])
        labels.append([x if k is None else k for x, k in zip([x or NONE for x in clamped(g, sorted(true))], given, strict=True)])
        known.append(given)
    for one, g, k in zip(labels, graphs, known, strict=True):  # what a token cannot be, it is not
        for i, x in enumerate(one):
            if k[i] is None and x not in g.possible[i]:
                one[i] = NONE
    return graphs, labels, known


def train(docs: DataFrame, text_col: str = "text", max_docs: int = 1000, max_chars: int = 20_000, seed: int = 5) -> Field | None:
    """The field, from at most ``max_docs`` distinct texts of at most ``max_chars`` characters that have a digit or ``@``, first by hash.

    None where they have no finding: then nothing can be learned, and ``find`` returns what the patterns find.
    """
    text = F.col(f"`{text_col}`").cast("string")
    some = docs.select(text.alias("text")).where((F.length("text") <= max_chars) & F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    n = some.agg(F.approx_count_distinct("h")).first()[0]
    if 2 * max_docs < n:  # about twice as many texts as are taken leave the executors, whatever the size of the table
        some = some.where(F.pmod("h", F.lit(1 << 40)) < int((1 << 40) * 2 * max_docs / n))
    texts = [r[0] for r in some.groupBy("h").agg(F.min("text").alias("text")).orderBy(F.pmod("h", F.lit(1 << 40)), "h").limit(max_docs).select("text").collect()]
    graphs, labels, known = examples(texts, seed)
    return fit(graphs, labels, known) if any(x for one in labels for x in one) else None


# ---- finding ----


def decode(text: str, g: Graph, given: list[int | None], label: np.ndarray) -> list[Span]:
    """The spans of tokens that are labelled by the field and could be such values. Each finding of the patterns has a token that is given, so none is overlapped."""
    out: list[Span] = []
    i = 0
    while i < len(g.spans):
        k = KIND_OF[label[i]]
        if k is None or given[i] is not None:
            i += 1
            continue
        j = i + 1
        while k >= 2 and j < len(g.spans) and given[j] is None and label[j] == (CARD_MORE if k == 2 else PHONE_MORE) and _NEAR.fullmatch(text, g.spans[j - 1][1], g.spans[j][0]):
            j += 1
        s, e = g.spans[i][0], g.spans[j - 1][1]
        if k == 3 and text[s - 1 : s] == "(" and ")" in text[s:e]:
            s -= 1
        whole = text[s:e]
        good = (lambda: _MAIL.fullmatch(whole), lambda: is_ip(whole), lambda: is_card(whole), lambda: 7 <= len(_digits(whole)) <= 15)[k]()
        if good:
            out.append((s, k, e))
        i = j
    return out


def find_in(texts: list[str], field: Field | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text what the patterns find, and all spans."""
    base = [found_by_patterns(t)[0] for t in texts]
    if field is None:
        return [(b, b) for b in base]
    graphs = [graph(t) for t in texts]
    given = [clamped(g, b) for g, b in zip(graphs, base, strict=True)]
    open_ = [i for i, (g, k) in enumerate(zip(graphs, given, strict=True)) if any(len(c) > 1 and x is None for c, x in zip(g.possible, k, strict=True))]
    out = [(b, b) for b in base]
    if not open_:
        return out
    batch = Batch.of([graphs[i] for i in open_], [given[i] for i in open_])
    label = field.marginals(batch).argmax(1)
    for k, i in enumerate(open_):
        more = decode(texts[i], graphs[i], given[i], label[batch.heads[k] : batch.heads[k + 1]])
        out[i] = (base[i], sorted(base[i] + more))
    return out


#: Characters of the texts whose field is worked on at once.
AT_ONCE = 1 << 20


def find(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: the id, n_email, n_ip, n_card and n_phone (findings of the patterns), base_sha256 and spans.

    ``spans`` lists the findings of the patterns and those the field adds as ``kind:start:end`` (code points, end
    exclusive) by start, then kind; ``base_sha256`` is the SHA-256 of the patterns' own list. Null and empty texts have
    none; texts of any length are read whole; repeated rows are each read; an empty table gives no rows; other columns
    are not read. An id column of the name of another column of the result is an error.
    """
    counts = [f"n_{k}" for k in KINDS]
    distinct_names(id_col, *counts, "base_sha256", "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros((4, len(batch)), np.int64)
            digest, spans = [empty] * len(batch), [""] * len(batch)
            some = np.flatnonzero(np.asarray(pc.match_substring_regex(batch.column(1), "[0-9@]").fill_null(False)))
            texts: list[str] = []
            rows: list[int] = []

            def work(rows: list[int], texts: list[str], n=n, digest=digest, spans=spans) -> None:
                for i, (base, all_) in zip(rows, find_in(texts, field), strict=True):
                    if base:
                        np.add.at(n[:, i], [k for _, k, _ in base], 1)
                        digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[i] = joined(all_)

            for i in some.tolist():
                rows.append(i)
                texts.append(batch.column(1)[i].as_py())
                if sum(map(len, texts)) >= AT_ONCE:
                    work(rows, texts)
                    rows, texts = [], []
            work(rows, texts)
            arrays.trim()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, n), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["id", *counts, "base_sha256", "spans"])

    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return given.mapInArrow(run, f"id {kind}, {', '.join(f'{c} bigint' for c in counts)}, base_sha256 string, spans string").withColumnRenamed("id", id_col)
