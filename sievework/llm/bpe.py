"""BPE encoding and decoding (operator 10) and encoding for packing.

Encoding by merges keeps the symbols of a piece in a doubly linked list and the
possible merges in a priority queue ordered by rank, then place. An entry whose
two symbols have changed since it was queued is stale and is skipped. Decoding
joins the vocabulary strings of the ids, with one space between two tokens where
the vocabulary file names no decoder.

Results for single chunks are kept in a bounded table per worker, which only
saves time: a chunk that is not kept is encoded again.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The Unicode property White_Space, as a character class.
WHITE = r"\t-\r \x85\xa0  -     　"
OTHER_WHITE = r"\t-\r\x85\xa0  -     　"
#: Chunks whose result a worker keeps at most.
KEPT = 600_000
#: Marks that close a chunk; each run of them is one pre-token in either vocabulary.
CLOSING = ".,;:!?*#$%&|"


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: visible Latin-1 characters stand for themselves, the others for U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in visible}
    rest = [b for b in range(256) if b not in table]
    return table | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeEncoder:
    """Encodes one pre-token at a time with a tokenizer file's vocabulary and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.decoder: dict | None = spec.get("decoder")
        #: rank of a pair by left id * width + right id, and the id that each rank makes; a pair and its rank fix each other
        self.width = 1 << 20
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.ids[a] * self.width + self.ids[b]] = rank
            self.made.append(self.ids[a + b])
        chars = byte_chars()
        self.inner = [self.ids[chars[b]] for b in range(256)]
        self.last = [self.ids[chars[b] + self.suffix] for b in range(256)]

    def encode(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        n = len(data)
        inner, rank_of, width = self.inner, self.ranks.get, self.width
        symbols = [inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        if n == 1:
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # an entry is rank * 2**32 + place of the left symbol; a symbol that went into its left neighbour is -1
        queue = []
        for i in range(n - 1):
            if (rank := rank_of(symbols[i] * width + symbols[i + 1])) is not None:
                queue.append(rank << 32 | i)
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            left = entry & 0xFFFFFFFF
            right = after[left]
            if right >= n or symbols[left] < 0 or rank_of(symbols[left] * width + symbols[right]) != entry >> 32:
                continue  # stale
            made = symbols[left] = self.made[entry >> 32]
            symbols[right] = -1
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                if (rank := rank_of(made * width + symbols[following])) is not None:
                    push(queue, rank << 32 | left)
            if (previous := before[left]) >= 0 and (rank := rank_of(symbols[previous] * width + made)) is not None:
                push(queue, rank << 32 | previous)
        return [x for x in symbols if x >= 0]


def by_special(text: str, pattern) -> list[str]:
    """The text's parts, special tokens apart (odd places)."""
    return pattern.split(text) if pattern.search(text) else [text]


class WordTokenizer:
    """The word vocabulary: NFC, white space to spaces, lower case; pieces end in ``</w>``."""

    def __init__(self, path: str):
        import regex

        self.bpe = MergeEncoder(path)
        if self.bpe.decoder is not None:
            raise ValueError("the vocabulary names a decoder; only those without one, whose strings are joined by spaces, are decoded")
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.bpe.special)) + ")")
        self.other_white = regex.compile(f"[{OTHER_WHITE}]")
        self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
        outer = self

        class Kept(dict):
            def __missing__(self, chunk: str) -> tuple[str, str]:
                body = chunk.rstrip(CLOSING)
                if len(body) < len(chunk) and body.isalpha():
                    (a, b), (c, d) = self[body], self[chunk[len(body) :]]
                    value = f"{a} {c}", f"{b} {d}"
                    if len(self) < KEPT // 2:
                        self[chunk] = value
                    return value
                ids = [i for piece in ([chunk] if chunk.isalpha() else outer.pieces.findall(chunk)) for i in outer.bpe.encode(piece)]
                value = outer.told(ids)
                if len(self) < KEPT:
                    self[chunk] = value
                return value

        self.kept = Kept()

    def told(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.bpe.strings[i] for i in ids])

    def chunks(self, part: str) -> list[str]:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part)
        part = self.other_white.sub(" ", part)
        part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
        return [c for c in part.split(" ") if c]

    def encode(self, text: str) -> tuple[str, str, int]:
        """The ids in decimal with one space between, the decoded text, and the number of ids."""
        ids: list[str] = []
        said: list[str] = []
        for k, part in enumerate(by_special(text, self.special)):
            if k % 2:
                ids.append(str(self.bpe.special[part]))
                said.append(part)
                continue
            found = list(map(self.kept.__getitem__, self.chunks(part)))
            ids += [x[0] for x in found]
            said += [x[1] for x in found]
        line = " ".join(ids)
        return line, " ".join(said), line.count(" ") + 1 if line else 0


class ByteTokenizer:
    """The byte-level vocabulary, through the tokenizers library; ids come as little-endian unsigned 32-bit bytes.

    Text is cut at single spaces. A chunk that starts or ends in white space or is empty stands beside a longer run
    of white space; its text is cut by the vocabulary's own pattern instead.
    """

    def __init__(self, path: str):
        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.added = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")")
        self.pattern = regex.compile(rf" ?\p{{L}}+| ?\p{{N}}+|'(?:s|t|re|ve|m|ll|d)| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.white = frozenset(chr(i) for i in range(0x3001) if regex.match(f"[{WHITE}]", chr(i)))
        self.model = self.tokenizer.model
        outer = self

        class Kept(dict):
            def __missing__(self, chunk: str) -> bytes | None:
                if chunk[-1] in outer.white or chunk[:2].lstrip(" ")[:1] in outer.white:
                    return None
                body = chunk.rstrip(CLOSING)
                if not body[body[:1] == " " :].isalpha():
                    value = outer.cut(chunk)
                    if len(self) < KEPT // 2 and "\n" not in chunk:
                        self[chunk] = value
                elif len(body) < len(chunk):
                    value = self[body] + self[chunk[len(body) :]]
                    if len(self) < KEPT // 2:
                        self[chunk] = value
                else:
                    value = outer.piece(chunk)
                    if len(self) < KEPT:
                        self[chunk] = value
                return value

        self.kept = Kept()
        self.space = byte_chars()[32]
        self.chars = byte_chars()
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def piece(self, piece: str) -> bytes:
        piece = piece.replace(" ", self.space) if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(self.chars)
        ids = self.id_bytes
        return b"".join([ids[t.id] for t in self.model.tokenize(piece)])

    def cut(self, text: str) -> bytes:
        known = self.kept
        return b"".join([known[p] if p.isalpha() else known.get(p) or self.piece(p) for p in self.pattern.findall(text)])

    def part(self, text: str) -> bytes:
        if not text:
            return b""
        chunks = text.split(" ")
        chunks[1:] = [" " + c for c in chunks[1:]]
        if not chunks[0]:
            del chunks[0]
        found = list(map(self.kept.__getitem__, chunks))
        return self.cut(text) if None in found else b"".join(found)

    def encode(self, text: str) -> bytes:
        return b"".join([self.added[p] if k % 2 else self.part(p) for k, p in enumerate(by_special(text, self.special))])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_texts: bool = True) -> DataFrame:
    """Encodes every whole text with the word vocabulary at ``path`` and decodes the ids again.

    Returns the id column, n_tokens, ids (decimal, one space between) and decoded, or with ``with_texts=False`` the
    SHA-256 of both instead. A null or empty text has no ids and an empty decoded text. Repeated rows give repeated
    rows; an empty table gives none; other columns of ``docs`` are not read. Texts of any length are encoded whole, chunk by
    chunk. Each row is worked on alone, so nothing is shuffled. ValueError for a vocabulary that names a decoder.
    """
    key = docs.schema[id_col].dataType.simpleString()
    kind = "string" if with_texts else None
    schema = f"`{id_col}` {key}, n_tokens bigint, " + (f"ids {kind}, decoded {kind}" if kind else "ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [tokenizer.encode(x.as_py() or "") for x in part.column(1)]
                ids, decoded = [x[0] for x in found], [x[1] for x in found]
                if not with_texts:
                    ids, decoded = list(map(sha, ids)), list(map(sha, decoded))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[2] for x in found], pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=[id_col, "n_tokens", *(("ids", "decoded") if with_texts else ("ids_sha256", "decoded_sha256"))])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)
