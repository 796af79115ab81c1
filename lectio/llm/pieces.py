"""SentencePiece encoding and decoding as shortest paths in a weighted finite-state transducer.

``Transducer`` compiles a model file: the normaliser (dummy prefix, white-space escapes), the pieces
as an automaton of arcs from characters to piece ids, and byte fallback as arcs from any other character to
the ids of its UTF-8 bytes. A text is composed with it part by part, and the tropical-semiring
shortest path gives the ids. States are (position, last piece):

* for a unigram model an arc weighs minus the piece's score, and the last piece does not matter;
* for a BPE model an arc weighs 0 if merging the two neighbouring pieces' characters in rank order
  gives those two pieces back, and infinity if not. A sequence of pieces is what BPE makes of a text
  exactly when each two neighbours pass, so the one path of finite weight is the BPE encoding.

No piece has an escaped space after another character, so a text falls apart before each run of
spaces; what is composed is kept for the parts that recur.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import kept, map_arrow, with_text

MODEL = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"
SPACE = "▁"
#: Parts and neighbour tests that a task remembers.
MEMORY = 500_000
PARTS = re.compile(" *[^ ]+| +")
PACK = [struct.Struct(f"<{n}i").pack for n in range(41)]
#: Of a character without a piece, in a unigram model.
UNKNOWN_SCORE = -100.0


def _fields(data: bytes) -> list[tuple[int, bytes | int]]:
    """The (number, value) fields of one protocol-buffer message."""
    out, i = [], 0

    def number(i: int) -> tuple[int, int]:
        shift = value = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    while i < len(data):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        else:
            n, i = number(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = data[i : i + n], i + n
        out.append((key >> 3, value))
    return out


class Transducer:
    """A compiled model; see the module's docstring."""

    def __init__(self, model: bytes) -> None:
        pieces, kind, norm = [], 1, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0, f.get(3, 1)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                norm = dict(_fields(value))
        if norm.get(2):
            raise ValueError("only models with the identity normaliser are compiled")
        self.bpe, self.prefix, self.squeeze = kind == 2, norm.get(3, 1), norm.get(4, 1)
        self.pieces = [p for p, _, _ in pieces]
        self.scores = [s for _, s, _ in pieces]
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (1, 4)}
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == 6}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.special = {i for i, (_, _, t) in enumerate(pieces) if t in (2, 3)}
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == 2), 0)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that go on after a space can't be composed part by part")
        self.arcs = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.arcs.add_word(p, (len(p), i))
        self.arcs.make_automaton()
        self.single = {p for p in self.ids if len(p) == 1}
        self.known = Parts(self)
        self.fits: dict[int, bool] = {}

    def parts(self, text: str) -> list[str]:
        """The normalised text, escapes not yet written, cut before each run of spaces."""
        text = text.replace(SPACE, " ")
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return PARTS.findall((" " if self.prefix else "") + text) if text else []

    def merged(self, text: str) -> list[str]:
        """What merging neighbours by best score, leftmost first, makes of a short text."""
        parts = list(text)
        while True:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def fit(self, last: int, piece: int) -> bool:
        """Whether BPE leaves two neighbouring pieces as they are: an arc of weight 0, else infinity."""
        if len(self.fits) >= MEMORY:
            self.fits.clear()
        a, b = self.pieces[last], self.pieces[piece]
        ok = self.fits[last << 20 | piece] = self.merged(a + b) == [a, b]
        return ok

    def shortest(self, part: str) -> list[int]:
        """The piece ids on the shortest path through a part; a character without a piece gives -1.

        Arcs come in order of their ends, so a position's state is final when arcs leave it. For BPE
        only one piece can reach a position at a finite weight, so a state is its last piece.
        """
        n = len(part)
        came = [-2] * (n + 1)  # the last piece
        came[0] = -3
        if self.bpe:
            fits, at = self.fits, 0
            get = fits.get
            if not self.single.issuperset(part):
                return self._around_unknown(part)
            for end, (length, piece) in self.arcs.iter(part):
                last = came[end + 1 - length]
                if last == -2 or came[end + 1] != -2:
                    continue
                if last != -3:
                    ok = get(last << 20 | piece)
                    if not (self.fit(last, piece) if ok is None else ok):
                        continue
                came[end + 1] = piece
            out, at = [], n
            while at:
                out.append(came[at])
                at -= len(self.pieces[came[at]])
            return out[::-1]
        cost = [0.0] + [float("inf")] * n
        arcs = sorted([(end + 1, end + 1 - length, piece) for end, (length, piece) in self.arcs.iter(part)] + [(i + 1, i, -1) for i, c in enumerate(part) if c not in self.single])
        for end, start, piece in arcs:
            if (total := cost[start] - (self.scores[piece] if piece >= 0 else UNKNOWN_SCORE)) < cost[end]:
                cost[end], came[end] = total, piece
        out, at = [], n
        while at:
            out.append(came[at])
            at -= len(self.pieces[came[at]]) if came[at] >= 0 else 1
        return out[::-1]

    def _around_unknown(self, part: str) -> list[int]:
        """Nothing merges with a character that no piece has, so the runs between them are separate."""
        out: list[int] = []
        run: list[str] = []
        for c in [*part, ""]:
            if c in self.single:
                run.append(c)
                continue
            if run:
                out += self.shortest("".join(run))
                run.clear()
            if c:
                out.append(-1)
        return out

    def part_ids(self, part: str) -> bytes:
        """Ids of a part as little-endian 32-bit integers, with byte fallback."""
        part = part.replace(" ", SPACE)
        path = self.shortest(part)
        if -1 in path:
            ids, at = [], 0
            for piece in path:
                if piece >= 0:
                    ids.append(piece)
                    at += len(self.pieces[piece])
                else:
                    ids += [self.byte[b] for b in part[at].encode("utf-8", "replace")] if self.byte else [self.unknown]
                    at += 1
            path = ids
        return np.array(path, "<i4").tobytes() if len(path) > 40 else PACK[len(path)](*path)

    def encode_bytes(self, text: str | None) -> bytes:
        return b"".join([self.known[part] for part in self.parts(text or "")])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, runs of byte pieces read as UTF-8, escapes undone and the dummy prefix dropped."""
        if self.byte_of.keys().isdisjoint(ids) and self.special.isdisjoint(ids):
            text = "".join([self.pieces[i] for i in ids])
        else:
            out: list[str] = []
            run = bytearray()
            for i in [*ids, -1]:
                if (b := self.byte_of.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                if i >= 0 and i not in self.special:
                    out.append(self.pieces[i])
            text = "".join(out)
        return (text[1:] if self.prefix and text.startswith(SPACE) else text).replace(SPACE, " ")


class Parts(dict):
    """Ids of the parts met lately; long parts aren't kept, and others go once MEMORY / 2 more have been met without them."""

    def __init__(self, transducer: Transducer) -> None:
        self.transducer = transducer
        self.before: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        got = self.before.get(part)
        if got is None:
            got = self.transducer.part_ids(part)
        if len(part) <= 64:
            if len(self) >= MEMORY // 2:
                self.before = dict(self)
                self.clear()
            self[part] = got
        return got


def compiled(model: bytes) -> Transducer:
    """One transducer for each worker process, as long as the worker encodes by that model."""
    return kept(("pieces", hash(model)), lambda: Transducer(model))


def read_model(path: str) -> bytes:
    """The model file, which is small and fixed; the driver reads it and the tasks get its bytes."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str = MODEL, keep: str = "*", ids: str = "tokens", decoded: str = "decoded") -> DataFrame:
    """Add tokens (array<int>) and decoded (the text that the tokens give back), under these or given names, to documents.

    ``keep``: "*" keeps all columns, whatever their names (existing ones of the new names are replaced).
    Null and empty texts have no tokens and decode to an empty text. A text with a real U+2581, which
    the model can't tell from a space, decodes to a space there; any other text comes back unchanged.
    Repeated rows get equal results; an empty table gives an empty one. Texts are encoded whole; a
    part without any space is composed whole too, at a cost in proportion to its length.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))
    own_columns = [c for c in docs.columns if c not in (ids, decoded)] if keep == "*" else [keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own_columns) + f", `{ids}` array<int>, `{decoded}` string"
    rows, at = with_text(docs, own_columns)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = compiled(model.value)
        tokens = [t.encode_bytes(x) for x in batch.column(at).to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in tokens]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(tokens), "<i4")))
        texts = pa.array([t.decode(np.frombuffer(x, "<i4").tolist()) for x in tokens], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[: len(own_columns)], lists, texts], [*own_columns, ids, decoded])

    return map_arrow(rows, run, schema, rows=500)


def digest(tokens: list[int]) -> str:
    """SHA-256 of the ids as little-endian 32-bit integers."""
    return hashlib.sha256(np.asarray(tokens, "<i4").tobytes()).hexdigest()


def digests(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_chars, n_tokens, n_bytes (byte-fallback tokens), ids_sha256, decoded_sha256, round_trip for each document.

    A null text counts as empty; repeated rows come out as often as they went in; other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    coded = encode(rows, path)
    model = Transducer(read_model(path))
    low, high = (min(model.byte_of), max(model.byte_of)) if model.byte_of else (-1, -1)
    ids = F.array_join("tokens", ",")
    return coded.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.size(F.filter("tokens", lambda i: i.between(low, high))).cast("bigint").alias("n_bytes"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
