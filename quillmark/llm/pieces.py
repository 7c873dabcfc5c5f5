"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is escaped as the vocabulary asks, cut where no piece of the vocabulary can reach
across, and each cut part is merged by an agenda: adjacent symbol pairs that spell a piece
wait in a queue by score, the best one (the leftmost of equals) is merged, and the pairs
that the merge creates join the queue. Characters outside the vocabulary fall back to
bytes. Merges never reach over a cut, so the distinct words of some texts are merged side
by side: each has its agenda as a row of pair ranks, the first least of which is its next
entry, and one entry of every agenda is taken at a time. Long words have a heap of their
own. Every Arrow batch is held against the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import held

_SPACE = "▁"
#: Longer words have a heap of their own; so many shorter ones are merged side by side.
_WORD_CHARS, _ROWS = 32, 1 << 14
_NEVER = 1 << 30
#: Bits of a position in an agenda entry.
_AT = 40
_LOW = (1 << _AT) - 1


class Pieces:
    """A merge-type vocabulary."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        kinds, norm = proto.ModelProto.SentencePiece, spec.normalizer_spec
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("the vocabulary is not of the merge type")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.denormalizer_spec.precompiled_charsmap or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the vocabulary rewrites texts; only escaped spaces and a leading one are handled")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("the vocabulary has user-defined or unused pieces, which are not handled")
        self.prefix = _SPACE if norm.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        worth = {s: n for n, s in enumerate(sorted({p.score for p in spec.pieces}, reverse=True))}
        self.rank = {p.piece: worth[p.score] for p in spec.pieces if p.type == kinds.NORMAL and len(p.piece) > 1}
        self.unk = next(i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN)
        named = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.bytes = [named[f"<0x{b:02X}>"] for b in range(256)] if spec.trainer_spec.byte_fallback else None
        self.byte_of = {named[f"<0x{b:02X}>"]: b for b in range(256)} if named else {}
        self.raw = [b"" if p.type == kinds.CONTROL else p.piece.replace(_SPACE, " ").encode() for p in spec.pieces]
        self.raw[self.unk] = spec.trainer_spec.unk_surface.encode()
        for i, b in self.byte_of.items():
            self.raw[i] = bytes([b])
        self.leads = [p.type == kinds.NORMAL and p.piece.startswith(_SPACE) and bool(self.prefix) for p in spec.pieces]
        self.silent = {i for i, p in enumerate(spec.pieces) if p.type == kinds.CONTROL}
        self.cuts = self._cuts()
        self._tabulate()

    def _cuts(self) -> re.Pattern[str] | None:
        """Parts that no piece reaches across: a run of spaces begins one. None where a piece has a space after another character."""
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in self.ids):
            return None
        return re.compile(" *[^ ]+| +")

    def _tabulate(self) -> None:
        """Symbols as numbers: piece ids, one for none, and those of characters that are no piece; the piece that two of them spell, and its rank."""
        self.none = len(self.raw)
        self.symbol = np.arange(self.none + 1, self.none + 1 + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.base = self.none + 1 + 0x110000
        spelt = {p: i for p, i in self.ids.items() if len(p) > 1} | {chr(c): int(self.symbol[c]) for p in self.ids for c in map(ord, p)}
        splits = sorted({(a * self.base + b, i) for p, i in self.ids.items() for k in range(1, len(p)) if (a := spelt.get(p[:k])) is not None and (b := spelt.get(p[k:])) is not None})
        self.pair = np.array([k for k, _ in splits] + [np.iinfo(np.int64).max])
        self.made = np.array([i for _, i in splits] + [self.none], np.int32)
        self.likely = np.zeros(1 << 22, bool)  # by a hash of the pair; most pairs that spell nothing are told by it alone
        self.likely[_slot(*np.divmod(self.pair[:-1], self.base))] = True
        self.order = np.full(self.none + 1, _NEVER, np.int32)
        for p, r in self.rank.items():
            self.order[self.ids[p]] = r

        # pairs of common characters, with which every word begins, are looked up at once
        common = self.symbol[[*range(128), ord(_SPACE)]]
        self.small = np.full(self.base, len(common), np.uint8)
        self.small[common] = np.arange(len(common))
        self.first = np.full((len(common) + 1, len(common) + 1), self.none, np.int32)
        self.first[:-1, :-1] = self._spell(*np.broadcast_arrays(common[:, None], common[None, :]))

    def _spell_characters(self, row: np.ndarray) -> np.ndarray:
        """What neighbouring characters of each row spell."""
        small = self.small[row]
        out = self.first[small[:, :-1], small[:, 1:]]
        rare = (small == len(self.first) - 1) & (row != self.none)
        at = np.nonzero((rare[:, :-1] | rare[:, 1:]) & (row[:, 1:] != self.none))
        out[at] = self._spell(row[:, :-1][at], row[:, 1:][at])
        return out

    def _spell(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols spells, or none."""
        out = np.full(left.shape, self.none, np.int32)
        maybe = self.likely[_slot(left, right)]
        key = left[maybe].astype(np.int64) * self.base + right[maybe]
        at = np.searchsorted(self.pair, key)
        out[maybe] = np.where(self.pair[at] == key, self.made[at], self.none)
        return out

    def _side_by_side(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols in a row, how many of each word) of a space and each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        width, row = int(sizes.max()), np.arange(len(words))
        codes = np.frombuffer((" " + " ".join(words)).replace(" ", _SPACE).encode("utf-32-le"), np.uint32)
        out = np.full((len(words), width + 1), self.none, np.int32)
        out[np.arange(width + 1) < sizes[:, None]] = self.symbol[codes]
        todo, now = row, out
        rank = self.order[self._spell_characters(now)]
        while len(todo):
            best = rank.argmin(axis=1)  # the first of equals is the leftmost
            on = rank[row[: len(todo)], best] < _NEVER
            if not on.all():
                done = todo[~on]
                out[done, : now.shape[1]], out[done, now.shape[1] :] = now[~on], self.none
                todo, now, rank, best = todo[on], now[on], rank[on], best[on]
            at = row[: len(todo)]
            piece = self._spell(now[at, best], now[at, best + 1])
            # the right symbol of the pair goes and what follows moves up, so all rows that go on lose a column
            before = np.arange(rank.shape[1]) <= best[:, None]
            now = np.where(before, now[:, :-1], now[:, 1:])
            rank = np.where(before[:, :-1], rank[:, :-1], rank[:, 1:])
            now[at, best] = piece
            has = np.flatnonzero(best < rank.shape[1])
            rank[has, best[has]] = self.order[self._spell(piece[has], now[has, best[has] + 1])]
            has = np.flatnonzero(best > 0)
            rank[has, best[has] - 1] = self.order[self._spell(now[has, best[has] - 1], piece[has])]
        filled = out != self.none
        return out[filled], filled.sum(axis=1)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, how many of each word) of a space and each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        short = order[size[order] <= _WORD_CHARS]
        flat, counts = [np.zeros(0, np.int32)], np.zeros(len(words), np.int64)
        for at in range(0, len(short), _ROWS):
            mine = short[at : at + _ROWS]
            symbols, n = self._side_by_side([words[i] for i in mine.tolist()])
            odd = symbols > self.none
            if odd.any():  # each as the bytes of its character
                expanded = [[self.bytes[b] for b in chr(c - self.none - 1).encode()] for c in symbols[odd].tolist()]
                width = np.ones(len(symbols), np.int64)
                width[odd] = [len(x) for x in expanded]
                n = np.add.reduceat(width, np.cumsum(n) - n)
                symbols, into = np.repeat(symbols, width), np.repeat(odd, width)
                symbols[into] = list(chain.from_iterable(expanded))
            flat.append(symbols)
            counts[mine] = n
        for i in order[len(short) :].tolist():
            flat.append(np.array(self.merge(_SPACE + words[i].replace(" ", _SPACE)), np.int32))
            counts[i] = len(flat[-1])
        # back from the order of sizes to that of the words
        joined, starts = np.concatenate(flat), np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return _gather(joined, starts, counts), counts

    def merge(self, part: str) -> list[int]:
        """The ids of a part by the agenda of adjacent pairs, each entry (rank of the piece, left, right) as one number."""
        rank, text, end = self.rank, list(part), len(part)
        agenda = [(r << _AT | i) << _AT | i + 1 for i in range(end - 1) if (r := rank.get(part[i : i + 2])) is not None]
        if agenda:
            heapq.heapify(agenda)
            after, before = list(range(1, end + 1)), list(range(-1, end - 1))
            while agenda:
                top = heapq.heappop(agenda)
                right, left = top & _LOW, top >> _AT & _LOW
                merged = text[left] + text[right]
                if not text[left] or after[left] != right or rank.get(merged) != top >> 2 * _AT:
                    continue  # one of the two has been merged since
                text[left] = merged
                text[right] = ""
                nxt = after[left] = after[right]
                prev = before[left]
                if nxt < end:
                    before[nxt] = left
                    if (r := rank.get(merged + text[nxt])) is not None:
                        heapq.heappush(agenda, (r << _AT | left) << _AT | nxt)
                if prev >= 0 and (r := rank.get(text[prev] + merged)) is not None:
                    heapq.heappush(agenda, (r << _AT | prev) << _AT | left)
        ids, out = self.ids, []
        for symbol in text:
            if symbol:
                if (found := ids.get(symbol)) is not None:
                    out.append(found)
                elif self.bytes:
                    out += [self.bytes[b] for b in symbol.encode()]
                else:
                    out.append(self.unk)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, where each text's begin and the last one's end)."""
        if not (self.cuts and self.prefix and self.bytes):
            ids = [self._whole(t) for t in texts]
            return np.array(list(chain.from_iterable(ids)), np.int32), np.cumsum([0, *map(len, ids)])
        place: dict[str, int] = defaultdict(count().__next__)
        codes: list[int] = []
        held = [0]
        for t in texts:
            codes += map(place.__getitem__, self._split(t))
            held.append(len(codes))
        flat, counts = self._words(list(place))
        starts, at = np.cumsum(counts) - counts, np.array(codes, np.int64)
        total = np.concatenate([[0], np.cumsum(counts[at])])
        return _gather(flat, starts[at], counts[at]).astype(np.int32), total[held]

    def _split(self, text: str) -> list[str]:
        """The words of a text, each without the space before it; further spaces stay with the word that follows them."""
        if not text:
            return []
        text = text.replace(_SPACE, " ")
        words = text.split(" ")
        return words if "" not in words else [w[1:] for w in self.cuts.findall(f" {text}")]

    def _whole(self, text: str) -> list[int]:
        if not text:
            return []
        out = self.merge(self.prefix + text.replace(" ", _SPACE))
        # a run of unknown characters is one id
        return out if self.bytes else [i for n, i in enumerate(out) if i != self.unk or n == 0 or out[n - 1] != self.unk]

    def decode(self, ids: list[int], encoded: bool = False) -> str:
        """The text of some ids; of ``encoded`` ones it is known that none is a begin or an end."""
        try:
            if not encoded and not self.silent.isdisjoint(ids):
                raise ValueError
            out = b"".join(map(self.raw.__getitem__, ids)).decode()
        except ValueError:  # a run of bytes is decoded by itself; one that begins no character becomes one replacement character
            runs = [(byte, list(run)) for byte, run in groupby(ids, lambda i: i in self.byte_of)]
            out = "".join(_lenient(bytes(self.byte_of[i] for i in run)) if byte else b"".join(self.raw[i] for i in run).decode() for byte, run in runs)
        first = next((i for i in ids if i not in self.silent), None)
        return out[1:] if first is not None and self.leads[first] else out


def _slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.int64) * 0x9E3779B1 ^ right.astype(np.int64) * 0x85EBCA77) >> 9 & (1 << 22) - 1


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[start : start + count] of each, in a row."""
    first = np.cumsum(counts) - counts
    return flat[np.repeat(starts - first, counts) + np.arange(int(counts.sum()))]


def _lenient(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for size in range(1, 5):
            try:
                out.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _portions(texts: list[str], most: int = 1 << 22) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``most`` characters; a longer text is a list of its own."""
    now, size = [], 0
    for t in texts:
        if now and size + len(t) > most:
            yield now
            now, size = [], 0
        now.append(t)
        size += len(t)
    if now:
        yield now


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """Rows ``(id, ids, decoded, agrees)``, one for each row of ``docs``: the ids of the whole text, without begin or end, and what they decode to.

    The model file is read by the driver and sent to the tasks (a vocabulary, not data;
    64 MiB at most). A null text is an empty one: no ids, an empty text. ``agrees`` tells
    whether ids and decoded text are those of the sentencepiece library, null without
    ``check``. Repeated rows are encoded each for itself; other columns are ignored. Texts
    are taken about four million characters at a time, a longer one by itself. Narrow: no shuffle.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    if len(model) > 64 << 20:
        raise ValueError("the model file has over 64 MiB")
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    key = hashlib.sha256(model).hexdigest()
    kind = dict(docs.dtypes)[id_col]

    def library():
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_proto=shipped.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held(f"pieces-{key}", lambda: Pieces(shipped.value), 4)
        theirs = held(f"library-{key}", library, 4) if check else None
        for batch in batches:
            at = 0
            for texts in _portions([t or "" for t in batch.column("text").to_pylist()]):
                flat, ends = pieces.encode(texts)
                ids = [flat[a:b].tolist() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                decoded = [pieces.decode(i, True) for i in ids]
                same = [a == b and c == d for a, b, c, d in zip(ids, theirs.encode(texts, num_threads=1), decoded, theirs.decode(ids, num_threads=1), strict=True)] if check else [None] * len(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), lists, pa.array(decoded, pa.string()), pa.array(same, pa.bool_())], ["id", "ids", "decoded", "agrees"])
                at += len(texts)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string, agrees boolean").withColumnRenamed("id", id_col)


def digest(encoded: DataFrame) -> DataFrame:
    """The query's digest columns from the ids and decoded texts."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")
