"""Streaming Viterbi segmentation into the pieces of a SentencePiece vocabulary, and back.

A lattice over the text has a node a position and an edge a piece. A path's score is
the sum of its pieces' scores; in a merged vocabulary (BPE) an edge may follow
another only if the merges, best score first and leftmost among equals, would leave
just these two pieces of their joined surface. With that, one path alone reaches a
position, and its pieces are those that merging the whole text leaves. The decoder
keeps scores and backpointers for a window of a few times the longest piece; when
the paths to all positions that can still be extended pass through one boundary,
everything before it is committed and forgotten.

Spaces stand for the vocabulary's space mark and one is put before the text, as the
library does for a model whose normaliser changes nothing else; others are refused.
No piece but runs of spaces has a space after its start, so parts between spaces are
segmented on their own; they repeat a lot and are kept in a bounded cache. Spaces that
no part takes in merge among themselves.

Ids equal the library's on every text without the mark itself. That character and all
without a piece become their bytes, so that decoding gives every text back exactly.

Defined results: null and empty texts have no ids, and decode to the empty text.
Other columns pass through unless they share a result's name, which then
replaces them. Rows stay as they are, ties and repeats included.
"""

from __future__ import annotations

import array
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Parts longer than this are not cached; the cache is emptied at this many parts, the pairs' at so many.
CACHED_CHARS, CACHED_PARTS, CACHED_PAIRS = 64, 400_000, 2_000_000


def merged(scores: dict[str, float], text: str, joins: list | None = None) -> list[str]:
    """What merging leaves of a short text: the pair of best score first, the leftmost among equals; ``joins`` gets each pair."""
    parts = list(text)
    while True:
        pairs = [(scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]
        if not pairs:
            return parts
        i = -max(pairs)[1]
        if joins is not None:
            joins.append((parts[i], parts[i + 1]))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


class Pieces:
    """A vocabulary: ids and scores by surface string, surfaces by id, and a tree of the surfaces.

    With ``merges`` its pieces follow each other as merging leaves them; without, in
    any order. Scores below ``floor``, which mark pieces outside the ranking, count as the
    least score above it where paths are compared.
    """

    def __init__(self, surfaces: dict[str, tuple[int, float]], byte_ids: list[int], floor: float = -1e8, merges: bool = False):
        low = min((score for _, score in surfaces.values() if score > floor), default=0.0)
        self.merges, self.scores = merges, {s: score for s, (_, score) in surfaces.items()}
        #: The two pieces that a piece was last merged from. One that merging does not arrive at is in no segmentation.
        self.joined: dict[str, tuple[str, str]] = {}
        reached = dict(surfaces)
        for s in surfaces if merges else ():
            joins: list = []
            if len(s) > 1 and merged(self.scores, s, joins) == [s]:
                self.joined[s] = joins[-1]
            elif len(s) > 1 and s.strip(" "):
                del reached[s]
        self.pieces = {s: (i, max(score, low)) for s, (i, score) in reached.items()}
        self.byte_ids, self.unknown = byte_ids, low - 10.0
        self.longest = max(map(len, surfaces), default=1)
        self.surface = {i: s.encode() for s, (i, _) in surfaces.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.text = {i: s for s, (i, _) in surfaces.items()}
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self.runs: dict[int, list[int]] = {}
        self.longest_run = max((len(s) for s in surfaces if not s.strip(" ")), default=1)
        self.tree: dict = {}
        for s, found in self.pieces.items():
            if s.strip(" ") or len(s) == 1:
                node = self.tree
                for c in s:
                    node = node.setdefault(c, {})
                node[0] = found

    @classmethod
    def from_file(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " \u00c5 \uff21\t a  b "
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model's normaliser changes more than spaces")
        surfaces, byte_ids = {}, [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
            elif piece and not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                surfaces[piece.replace(MARK, " ")] = (i, model.get_score(i))
        if any(" " in s[1:] and s.strip(" ") for s in surfaces):
            raise ValueError("the model has pieces with a space inside")
        # Scores of a merged vocabulary are falling whole numbers.
        merges = all(float(score).is_integer() for _, score in surfaces.values())
        return cls(surfaces, byte_ids, merges=merges)

    def followers(self, before: int | None) -> dict[int, bool] | None:
        """What is known of the pieces after one, for ``follows``; None if any may follow: bytes take part in no merge."""
        return None if before is None or not self.merges else self.pairs.setdefault(before, {})

    def follows(self, before: int, piece: int) -> bool:
        """Whether merging leaves the two pieces as they are."""
        if self.n_pairs >= CACHED_PAIRS:
            self.pairs, self.n_pairs = {}, 0
        self.n_pairs += 1
        known = self.pairs.setdefault(before, {})[piece] = self._stay(self.text[before], self.text[piece])
        return known

    def _stay(self, a: str, b: str) -> bool:
        """Undo the merges of both pieces from the last one on, and see whether a merge across their border came before any.

        Of merges of one score the leftmost came first: those within a, one across, those within b.
        """
        latest, ties = -float("inf"), False
        while True:
            across = self.scores.get(a + b)
            if across is not None and (across > latest or ties and across == latest):
                return False
            in_a, in_b = self.joined.get(a), self.joined.get(b)
            if in_a is None and in_b is None:
                return True
            if in_a is None or in_b is not None and self.scores[b] <= self.scores[a]:
                latest, ties, b = self.scores[b], True, in_b[0]
            else:
                latest, ties, a = self.scores[a], False, in_a[1]

    def spaces(self, n: int) -> list[int]:
        """Ids of n spaces that no part takes in."""
        most = self.longest_run
        if n not in self.runs:
            # Merges go on from the left: runs of the greatest length, and what merging leaves of the rest.
            parts = [most] * (n // most) + [len(p) for p in merged(self.scores, " " * (n % most))]
            ids = [i for k in parts for i in ([self.pieces[" " * k][0]] if " " * k in self.pieces else [self.byte_ids[32]] * k)]
            if n > 4 * most:
                return ids
            self.runs[n] = ids
        return self.runs[n]


def viterbi_stream(vocabulary: Pieces, text: str) -> Iterator[int]:
    """Ids of ``text`` in order, committed as soon as they are known to be certain.

    Once the uncommitted part is four times as long as the longest piece, and again
    after each further such piece, the paths to the positions that can still be
    extended are followed back to the last boundary that they share.
    """
    tree, unknown, longest, follows = vocabulary.tree, vocabulary.unknown, vocabulary.longest, vocabulary.follows
    done, n = 0, len(text)
    #: By position after ``done``: best score, position before, id (None: bytes).
    size = min(n, 6 * longest) + 1
    best, back, ids = [None] * size, [0] * size, [None] * size
    best[0] = 0.0
    look = 4 * longest
    for i in range(n):
        at = i - done
        score = best[at]
        if score is None:
            continue
        before = ids[at]
        allowed = vocabulary.followers(before) if i else None
        node, to = tree, at
        for c in text[i : i + longest]:
            node = node.get(c)
            if node is None:
                break
            to += 1
            found = node.get(0)
            if found is None:
                continue
            piece, value = found
            if allowed is not None:
                fits = allowed.get(piece)
                if not (follows(before, piece) if fits is None else fits):
                    continue
            value += score
            if best[to] is None or value > best[to]:
                best[to], back[to], ids[to] = value, i, piece
        if 0 not in tree.get(text[i], tree):
            to, value = at + 1, score + unknown
            if best[to] is None or value > best[to]:
                best[to], back[to], ids[to] = value, i, None
        if at + 1 >= look:
            paths = {p + done for p in range(at + 1, min(size, at + 1 + longest)) if best[p] is not None}
            while len(paths) > 1:
                last = max(paths)
                paths.remove(last)
                paths.add(back[last - done])
            shared = paths.pop()
            if shared > done:
                yield from _path(vocabulary, text, done, shared, back, ids)
                best, back, ids = (x[shared - done :] + [y] * (shared - done) for x, y in ((best, None), (back, 0), (ids, None)))
                done = shared
            look = max(4 * longest, i + 1 - done + longest)
            if look + longest >= size:
                best, back, ids = best + [None] * size, back + [0] * size, ids + [None] * size
                size *= 2
    yield from _path(vocabulary, text, done, n, back, ids)


def _path(vocabulary: Pieces, text: str, done: int, end: int, back: list, ids: list) -> list[int]:
    """Ids from ``done`` to ``end`` by the backpointers."""
    out: list[int] = []
    while end > done:
        piece, before = ids[end - done], back[end - done]
        if piece is None:
            out += [vocabulary.byte_ids[x] for x in reversed(text[before:end].encode("utf-8", "surrogatepass"))]
        else:
            out.append(piece)
        end = before
    return out[::-1]


class Codec:
    """Encodes and decodes texts, with a cache of the parts between spaces."""

    def __init__(self, path: str):
        self.vocabulary = Pieces.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.lengths = array.array("i"), array.array("q"), array.array("q")

    def _add(self, part: str) -> None:
        ids = list(viterbi_stream(self.vocabulary, " " + part))
        self.index[part] = len(self.starts)
        self.starts.append(len(self.flat))
        self.lengths.append(len(ids))
        self.flat.extend(ids)

    def part(self, part: str) -> np.ndarray:
        if len(part) > CACHED_CHARS:
            return np.fromiter(viterbi_stream(self.vocabulary, " " + part), np.int32)
        if part not in self.index:
            self._add(part)
        at = self.index[part]
        return np.array(self.flat[self.starts[at] : self.starts[at] + self.lengths[at]], np.int32)

    def with_runs(self, parts: list[str]) -> np.ndarray:
        """Of parts some of which are empty: a space that its part does not take in joins those before it."""
        out, waiting, alone = [], 0, self.vocabulary.pieces.get(" ", (None,))[0]
        for part in parts:
            if not part:
                waiting += 1
                continue
            ids = self.part(part)
            if waiting:
                bare = ids[0] == alone
                out.append(np.array(self.vocabulary.spaces(waiting + bool(bare)), np.int32))
                ids, waiting = ids[1:] if bare else ids, 0
            out.append(ids)
        out.append(np.array(self.vocabulary.spaces(waiting), np.int32))
        return np.concatenate(out)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if len(self.starts) > CACHED_PARTS:
            self.clear()
        parts = text.split(" ")
        sizes = list(map(len, parts))
        if min(sizes) == 0:
            return self.with_runs(parts)
        if max(sizes) > CACHED_CHARS:
            return np.concatenate([self.part(p) for p in parts])
        for part in parts:
            if part not in self.index:
                self._add(part)
        codes = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        starts, lengths = np.frombuffer(self.starts, np.int64)[codes], np.frombuffer(self.lengths, np.int64)[codes]
        ends = np.cumsum(lengths)
        return np.frombuffer(self.flat, np.int32)[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.surface.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


_CODECS: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Replace the text by ``ids``, ``n_ids``, ``ids_crc32`` (little-endian u32) and ``round_trip``."""
    made = ("ids", "n_ids", "ids_crc32", "round_trip")
    kept = [c for c in docs.columns if c not in made and c != text]
    rows = docs.select(*kept, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)
        for batch in batches:
            column = batch.column(len(kept))
            for first in range(0, len(column), 256):
                part = batch.slice(first, 256)
                texts = [x or "" for x in part.column(len(kept)).to_pylist()]
                ids = [codec.encode(t) for t in texts]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                arrays = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array([codec.decode(x) == t for x, t in zip(ids, texts)]),
                ]
                yield pa.record_batch([*part.columns[: len(kept)], *arrays], names=[*kept, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(kept)]]
    return rows.mapInArrow(run, ", ".join([*fields, "ids array<int>, n_ids long, ids_crc32 long, round_trip boolean"]))


def decode(rows: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text of each array of ids; null ids decode to the empty text."""
    kept = [c for c in rows.columns if c != text]
    source = rows.select(*kept, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)
        for batch in batches:
            texts = [codec.decode(np.array(x, np.int64)) for x in batch.column(len(kept)).to_pylist()]
            yield pa.record_batch([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, text])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(kept)]]
    return source.mapInArrow(run, ", ".join([*fields, f"`{text}` string"]))


def op6_piece_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
