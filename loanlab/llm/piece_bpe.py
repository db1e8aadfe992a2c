"""SentencePiece BPE encoding and decoding that keeps every piece's place in the source text.

Normalisation walks the text by the longest prefix that the model's compiled character map
holds (a double-array trie over bytes); a character without an entry stands for itself.
Every normalised character records how many source bytes it covers, so each piece is
projected to its byte span of the original text: spans of neighbours touch, the sign that is
put in front of the text covers nothing, and of the byte pieces of an unknown character the
last one covers it.

Merges take the best-scored adjacent pair, leftmost among equals, from a heap over a linked
list: n log n in the length of a segment. No merge can cross a place where no piece of the
vocabulary has the two neighbouring characters side by side. Where that is proven for a sign
before a space, texts are cut in front of their spaces and recurring words come from a
bounded memo; other texts and models are merged whole.

Models: BPE with scores, with or without byte fallback, any compiled character map. User
symbols, unused pieces and space as a suffix raise ``ValueError``. The model file is read on
the driver; its size bounds the broadcast.

Defined results: a null or empty text has no pieces and decodes to the empty string; repeated
rows come out as they came in; an empty table gives no rows; other columns are ignored unless
kept, and a kept column with the name of a result column gives way to it. Decoding raises
on ids outside the vocabulary; null ids decode to the empty string.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlab.llm.common import Shared, col, kept, map_texts, ship, worker_slot
from loanlab.llm.pretokens import MEMO_KEY, Memo

ship(__name__)

SPACE = "▁"         # what models write for a space
MEMO_WORDS = 250_000     # per generation: about 75 MB
MEMO_RUNS = 50_000       # words with more than one space before them
MOST_PIECES = 1_000_000  # bounds the broadcast model
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in the file format


class CharMap:
    """A compiled character map: source bytes to replacement, longest entry first."""

    def __init__(self, blob: bytes):
        self.units, self.texts = [], b""
        if blob:
            size, = struct.unpack_from("<I", blob)
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.texts = blob[4 + size:]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, str | None]:
        """(source bytes, replacement) of the longest entry that starts here; (0, None) without one."""
        units, length, found = self.units, 0, None
        if units:
            node = self._offset(units[0])
            for i in range(at, len(data)):
                node ^= data[i]
                if node >= len(units) or units[node] & 0x800000FF != data[i]:
                    break
                unit = units[node]
                node ^= self._offset(unit)
                if unit >> 8 & 1:
                    length, found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return 0, None
        return length, self.texts[found:self.texts.index(b"\0", found)].decode()

    def space_inside(self) -> bool:
        """Whether an entry has a space after its first byte: then texts must not be cut at spaces."""
        units, labels = np.array(self.units, np.int64), np.arange(1, 256)
        offsets = (units >> 10) << ((units & 0x200) >> 6)
        front, inside = offsets[:1], False
        while front.size:  # all nodes of one depth at a time
            nodes = front[:, None] ^ labels
            there = nodes < units.size
            there &= units[np.where(there, nodes, 0)] & 0x800000FF == labels
            if inside and there[:, 0x20 - 1].any():
                return True
            nodes, inside = nodes[there], True
            front = nodes ^ offsets[nodes]
        return False


class Model:
    """What encoding and decoding need of a model file."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2 as format_of
        spec = format_of.ModelProto()
        spec.ParseFromString(blob)
        train, norm = spec.trainer_spec, spec.normalizer_spec
        kinds = {p.type for p in spec.pieces}
        if train.model_type != 2 or kinds & {USER, UNUSED} or train.treat_whitespace_as_suffix:
            raise ValueError("only plain BPE models are read")
        if len(spec.pieces) > MOST_PIECES:
            raise ValueError(f"more than {MOST_PIECES} pieces")
        self.digest = hashlib.sha256(blob).hexdigest()
        self.charmap = norm.precompiled_charsmap
        self.prefix, self.escape = norm.add_dummy_prefix, norm.escape_whitespaces
        self.tidy = norm.remove_extra_whitespaces
        self.kinds = bytes(p.type for p in spec.pieces)
        self.pieces = [p.piece for p in spec.pieces]
        order = {s: i for i, s in enumerate(sorted({p.score for p in spec.pieces if p.type == NORMAL}, reverse=True))}
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.ranks = {p.piece: order[p.score] for p in spec.pieces if p.type == NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = train.unk_surface
        self.bytes = None
        if train.byte_fallback:
            place = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == BYTE}
            self.bytes = [place[f"<0x{b:02X}>"] for b in range(256)]
        self.joined = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        # no piece has another sign before a space: merges never cross the front of a space
        self.cuts = self.escape and not any(j[1] == SPACE != j[0] for j in self.joined)
        self.by_word = self.cuts and not self.tidy and not CharMap(self.charmap).space_inside()


def read_model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


class _Uncut(Exception):
    """A word that must not be taken apart from its neighbours."""


class Stems(Memo):
    """Values of words. The last signs that no piece joins to the ones before are put together, not remembered."""

    def __init__(self, work, joined: set[str], tails: Memo):
        super().__init__(work, MEMO_WORDS)
        self.joined, self.tails = joined, tails

    def __missing__(self, word):
        at = len(word)
        while at > 1 and word[at - 2:at] not in self.joined:
            at -= 1
        if at < len(word):  # a loop: such signs can be thousands
            return b"".join((self[word[:at]], *map(self.tails.__getitem__, word[at:])))
        return super().__missing__(word)


def merge_few(signs: list[str], ranks: dict[str, int]) -> list[str]:
    """The pieces that ``merge`` gives, by a plain search for the best pair: faster for single words."""
    parts, none = list(signs), len(ranks)
    ranked = [ranks.get(p, none) for p in map("".join, zip(parts, parts[1:]))]
    while ranked:
        best = min(ranked)
        if best == none:
            break
        i = ranked.index(best)
        parts[i] += parts.pop(i + 1)
        del ranked[i]
        if i:
            ranked[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(ranked):
            ranked[i] = ranks.get(parts[i] + parts[i + 1], none)
    return parts


def merge(signs: list[str], ranks: dict[str, int]) -> list[tuple[str, int]]:
    """(piece, signs in it) after all merges: best rank first, leftmost among equals."""
    n = len(signs)
    parts, after, before, size = list(signs), list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    heap = [(ranks[p], i, 2) for i, p in enumerate(map("".join, zip(parts, parts[1:]))) if p in ranks]
    heapify(heap)
    while heap:
        _, i, width = heappop(heap)
        j = after[i]
        if not size[i] or j >= n or size[i] + size[j] != width:
            continue  # an old entry
        parts[i] += parts[j]
        size[i], size[j] = width, 0
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get(parts[i] + parts[k])
            if rank is not None:
                heappush(heap, (rank, i, width + size[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get(parts[h] + parts[i])
            if rank is not None:
                heappush(heap, (rank, h, size[h] + width))
    return [(p, s) for p, s in zip(parts, size) if s]


class Encoder:
    """Texts to (id, source bytes) pairs and back."""

    def __init__(self, model: Model):
        self.model, self.map = model, CharMap(model.charmap)
        if self.map.units or not model.bytes:
            self.spaced = Memo(lambda word: self._word(" " + word), MEMO_WORDS)
        else:
            self.spaced = Stems(self._plain_word, model.joined, Memo(self._tail, MEMO_RUNS))
        self.known = {p: (i, len(p.encode())) for p, i in model.ids.items()}
        self.runs = Memo(self._word, MEMO_RUNS)
        self.heads = Memo(lambda word: self._word(word, True), MEMO_RUNS)
        self.rough = re.compile(" *[^ ]+| +").findall
        signs = [p.replace(SPACE, " ").encode() for p in model.pieces]
        for i, kind in enumerate(model.kinds):
            if kind == BYTE:
                signs[i] = bytes([int(model.pieces[i][3:-1], 16)])
            elif kind in (CONTROL, UNKNOWN):
                signs[i] = b"" if kind == CONTROL else model.unknown_text.encode()
        self.signs = signs
        # a sign that stands for nothing still parts byte pieces: no valid text while it is joined
        self.quick = [s if s or kind != CONTROL else b"\xff" for s, kind in zip(signs, model.kinds)]

    # ---- normalisation

    def segments(self, text: str, head: bool = True) -> Iterator[tuple[list[str], list[int], int]]:
        """(normalised signs, source bytes that each covers, source bytes before) of parts that merge alone."""
        model, signs, covers, start, at = self.model, [], [], 0, 0
        data, plain = text.encode(), not self.map.units
        space = SPACE if model.escape else " "
        if head and model.tidy:  # spaces in front go
            while at < len(data):
                length, value = self._next(data, at)
                if value != " ":
                    break
                at += length
        if at == len(data):
            return
        start = at
        if head and model.prefix:
            signs.append(space)
            covers.append(0)
        after_space = model.tidy
        steps = ((len(c.encode()), c) for c in text) if plain and not at else self._steps(data, at)
        for length, value in steps:
            if after_space:
                value = value.lstrip(" ")
            for sign in value:
                sign = SPACE if sign == " " and model.escape else sign
                if sign == SPACE and model.cuts and signs and signs[-1] != SPACE:
                    yield signs, covers, start
                    start += sum(covers)
                    signs, covers = [], []
                signs.append(sign)
                covers.append(0)
            if value:
                after_space = model.tidy and value[-1] == " "
            if covers:
                covers[-1] += length
            else:
                start += length
        while model.tidy and signs and signs[-1] == space:  # spaces at the end go
            signs.pop()
            covers.pop()
        if signs:
            yield signs, covers, start

    def _next(self, data: bytes, at: int) -> tuple[int, str]:
        length, value = self.map.longest(data, at)
        if value is None:
            first = data[at]
            length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            value = data[at:at + length].decode()
        return length, value

    def _steps(self, data: bytes, at: int) -> Iterator[tuple[int, str]]:
        while at < len(data):
            length, value = self._next(data, at)
            yield length, value
            at += length

    # ---- encoding

    def _pieces(self, signs: list[str], covers: list[int], out: array) -> None:
        """Appends (id, source bytes) of one segment."""
        model, at = self.model, 0
        for piece, size in merge(signs, model.ranks):
            length = sum(covers[at:at + size])
            at += size
            known = model.ids.get(piece)
            if known is not None:
                out.extend((known, length))
            elif model.bytes:
                for b in piece.encode():
                    out.extend((model.bytes[b], 0))
                out[-1] = length
            elif out and out[-2] == model.unknown:  # neighbours that are unknown become one piece
                out[-1] += length
            else:
                out.extend((model.unknown, length))

    def _tail(self, sign: str) -> bytes:
        """A sign that merges with nothing before it."""
        out = array("I")
        self._pieces([sign], [len(sign.encode())], out)
        return out.tobytes()

    def _plain_word(self, word: str) -> bytes:
        """A space and a word of at most some dozens of signs, for models without a map."""
        if len(word) > MEMO_KEY:
            return self._word(" " + word)
        out, known = array("I"), self.known
        for piece in merge_few([SPACE, *word], self.model.ranks):
            place = known.get(piece)
            if place is None:
                self._pieces([piece], [len(piece.encode())], out)
            else:
                out.extend(place)
        out[1] -= 2  # the sign for the space is three bytes long, the space one
        return out.tobytes()

    def _word(self, word: str, head: bool = False) -> bytes:
        out, parts = array("I"), list(self.segments(word, head))
        if len(parts) != 1 or parts[0][2] or (parts[0][0][-1] == SPACE and word.strip(" ")):
            raise _Uncut
        self._pieces(*parts[0][:2], out)
        if not self.model.bytes and self.model.unknown in out[::2]:
            raise _Uncut
        return out.tobytes()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids and the byte of the source text that each piece ends at.

        A piece starts where the one before ends, the first one after the spaces that
        normalisation removes in front.
        """
        if not text:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        start = 0
        try:
            if not self.model.by_word or SPACE in text:
                raise _Uncut
            if "  " in text or text[0] == " " or text[-1] == " ":
                first, *rest = self.rough(text)
                packed = [self.heads[first], *map(self.runs.__getitem__, rest)]
            else:
                first, *rest = text.split(" ")
                packed = [self.heads[first], *map(self.spaced.__getitem__, rest)]
            pairs = np.frombuffer(b"".join(packed), np.uint32)
        except _Uncut:
            out, start = array("I"), -1
            for signs, covers, begin in self.segments(text):
                start = begin if start < 0 else start
                self._pieces(signs, covers, out)
            pairs = np.frombuffer(out, np.uint32) if out else np.empty(0, np.uint32)
        return pairs[::2].astype(np.int32), max(start, 0) + pairs[1::2].cumsum(dtype=np.int64)

    # ---- decoding

    def decode(self, ids) -> str:
        """The text that the ids stand for; bytes that form no character become U+FFFD."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        if not ids:
            return ""
        if min(ids) < 0:
            raise IndexError("ids must not be negative")
        model, kinds = self.model, self.model.kinds
        if kinds[ids[0]] == NORMAL and not model.tidy:
            joined = b"".join(map(self.quick.__getitem__, ids))
            try:
                text = joined.decode()
                return text[1:] if model.prefix and model.pieces[ids[0]][0] == SPACE else text
            except UnicodeDecodeError:
                pass
        out, run, seen, size = [], bytearray(), False, 0
        for i in ids:
            if kinds[i] == BYTE:
                run += self.signs[i]
                continue
            if run:
                out.append(_characters(run))
                size, run = size + 1, bytearray()
            text = self.signs[i].decode()
            if kinds[i] == NORMAL and not seen and not size and (model.prefix or model.tidy) and text[:1] == " ":
                text, seen = text[1:], not model.tidy
            size += len(text)
            out.append(text)
        return "".join(out) + _characters(run)


def _characters(run: bytes) -> str:
    """A run of byte pieces as text: each byte that starts no whole character is U+FFFD."""
    out, at = [], 0
    while at < len(run):
        first = run[at]
        size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        try:
            out.append(run[at:at + size].decode())
        except UnicodeDecodeError:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


def _encoder(shared, digest: str) -> Encoder:
    """The worker's encoder: made once, with its memos, for one model."""
    return worker_slot(("piece_bpe", digest), lambda: Encoder(shared.value))


def encode_and_decode(docs: DataFrame, model: Model, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """Kept columns, ``ids``, ``ends`` (source byte that each piece ends at) and ``decoded``."""
    shared, digest = Shared(docs.sparkSession, model), model.digest

    def start():
        encoder = _encoder(shared, digest)

        def work(texts):
            ids, ends = zip(*map(encoder.encode, texts)) if texts else ((), ())
            return [ids, ends, [encoder.decode(i) for i in ids]]
        return work
    return map_texts(docs, text, keep, "ids array<int>, ends array<bigint>, decoded string", start)


def encode(docs: DataFrame, model: Model, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """Kept columns, ``ids`` and ``ends``."""
    shared, digest = Shared(docs.sparkSession, model), model.digest

    def start():
        encoder = _encoder(shared, digest)
        return lambda texts: list(zip(*map(encoder.encode, texts))) if texts else [[], []]
    return map_texts(docs, text, keep, "ids array<int>, ends array<bigint>", start)


def decode(rows: DataFrame, model: Model, ids: str = "ids", keep: tuple = ("doc_id",)) -> DataFrame:
    """Kept columns and ``decoded``: the text of an id list."""
    shared, digest = Shared(rows.sparkSession, model), model.digest
    names = kept(keep, ("decoded",))
    listed = rows.select(*[col(k) for k in names],
                         F.array_join(col(ids).cast("array<string>"), ",").alias("_ids"))

    def start():
        encoder = _encoder(shared, digest)
        return lambda lists: [[encoder.decode([int(i) for i in t.split(",") if i]) for t in lists]]
    return map_texts(listed, "_ids", names, "decoded string", start)
