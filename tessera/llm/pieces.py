"""SentencePiece encoding and decoding with the n best segmentations.

The lattice of a text is cut where no piece of the vocabulary reaches across: before the spaces that
begin a word and around line feeds. In each part, forward Viterbi scores are exact heuristics for a
backward A* search, so segmentations leave the queue in order of their score. The best ones of the
whole text are put together from the parts'.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_arrow, key_runs, texts_of

SPACE = "▁"
#: Bytes that a task spends on parts that it remembers. Longer parts than ``LONGEST`` are searched one by one.
REMEMBERED_BYTES, LONGEST = 64_000_000, 64
#: Rows and characters of texts that are encoded at once; a longer text is encoded alone.
ROWS, CHARACTERS = 512, 2_000_000
#: A character without a piece costs so much more than the rarest piece; it is then spelled in bytes.
UNKNOWN_COST = 10.0
#: Stands for the space mark where a text has that character itself: no valid text has a lone surrogate.
LITERAL = "\ud800"
_PARTS = re.compile(r" *[^ \n]+| +|\n")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Pieces and scores of a vocabulary, and the searches over a part of a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.spelled = {}  # byte: id
        self.text_of = [b""] * size
        self.trie: list = [{}, -1, 0.0]  # children by character, id of the piece that ends here or -1, its score
        known = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.spelled[int(piece[1:-1], 16)] = i
                self.text_of[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                known[piece] = (i, float(model.get_score(i)))
                self.text_of[i] = piece.replace(SPACE, " ").encode()
        # a space piece that is out of proportion is a marker, not a score: the rarest one counts for it
        floor = min((s for _, s in known.values() if s > -1e8), default=0.0)
        self.unknown = floor - UNKNOWN_COST
        for piece, (i, s) in known.items():
            node = self.trie
            for c in piece:
                node = node[0].setdefault(c, [{}, -1, 0.0])
            node[1:] = i, s
        self.longest = max(map(len, known), default=1)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in known):
            raise ValueError("the vocabulary has pieces across words or lines")

    def edges(self, part: str) -> tuple[list[float], list[tuple]]:
        """Best score of each prefix, and the pieces (begin, end, id, score), by begin; id -1 stands for a spelled character."""
        n, trie, unknown = len(part), self.trie, self.unknown
        best = [0.0] + [-math.inf] * n
        found = []
        for i in range(n):
            at, single, node, j = best[i], False, trie, i
            for c in part[i : i + self.longest]:
                node = node[0].get(c)
                if node is None:
                    break
                j += 1
                if node[1] >= 0:
                    if j == i + 1:
                        single = True
                    score = node[2]
                    found.append((i, j, node[1], score))
                    if at + score > best[j]:
                        best[j] = at + score
            if not single:
                found.append((i, i + 1, -1, unknown))
                if at + unknown > best[i + 1]:
                    best[i + 1] = at + unknown
        return best, found

    def ids_of(self, piece: int, part: str, begin: int) -> list[int]:
        return [piece] if piece >= 0 else [self.spelled[b] for b in part[begin].replace(LITERAL, SPACE).encode()]

    def best_of(self, parts: list[str]) -> Iterator[tuple[float, list[int], float]]:
        """For each of the sorted ``parts``: score and ids of the best segmentation, and its lead over the second best.

        One forward pass that keeps the two best sums of every prefix. What a part shares with the one
        before it, from its beginning on, is not gone through again.
        """
        trie, unknown, low = self.trie[0], self.unknown, -math.inf
        # by position: best and second best sum, (begin, piece) of the best, and the begun pieces (begin, children)
        best, second, back, begun = [0.0], [low], [(0, -1)], [[]]
        before = ""
        for part in parts:
            n, p, m = len(part), 0, min(len(part), len(before))
            while p < m and part[p] == before[p]:
                p += 1
            del best[p + 1 :], second[p + 1 :], back[p + 1 :], begun[p + 1 :]
            for j in range(p, n):
                c, top, next_, way, going = part[j], low, low, None, []
                for i, children in begun[j]:
                    node = children.get(c)
                    if node is not None:
                        if node[0]:
                            going.append((i, node[0]))
                        if node[1] >= 0:
                            v = best[i] + node[2]
                            if v > top:
                                top, next_, way = v, max(top, second[i] + node[2]), (i, node[1])
                            elif v > next_:
                                next_ = v
                node = trie.get(c)
                if node is not None and node[0]:
                    going.append((j, node[0]))
                piece, score = (node[1], node[2]) if node is not None and node[1] >= 0 else (-1, unknown)
                v = best[j] + score
                if v > top:
                    top, next_, way = v, max(top, second[j] + score), (j, piece)
                else:
                    next_ = max(next_, v)
                best.append(top)
                second.append(next_)
                back.append(way)
                begun.append(going)
            before, ids, at = part, [], n
            while at:
                begin, piece = back[at]
                ids += [piece] if piece >= 0 else self.ids_of(-1, part, begin)[::-1]
                at = begin
            ids.reverse()
            yield best[n], ids, best[n] - second[n]

    def n_best(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations (score, ids) of a part, best first; fewer if it has fewer.

        Among equal sums the search goes on with the path that it looked at last, so ties cost nothing.
        """
        best, found = self.edges(part)
        into: list[list[tuple]] = [[] for _ in best]
        for edge in found:
            into[edge[1]].append(edge)
        queue: list[tuple] = [(-best[-1], 0, len(part), 0.0, None)]
        out, count = [], 0
        while queue and len(out) < n:
            cost, _, at, behind, path = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids += self.ids_of(path[0], part, path[1])
                    path = path[2]
                out.append((-cost, tuple(ids)))
                continue
            for begin, _, piece, score in into[at]:
                count += 1
                heapq.heappush(queue, (-(best[begin] + score + behind), -count, begin, behind + score, (piece, begin, path)))
        return out


class Trie:
    """The pieces as one array of transitions: the children of a node stand at its base plus their character's number."""

    def __init__(self, root: list):
        nodes, at, inner = [root], 0, []
        while at < len(nodes):  # numbered in breadth
            if nodes[at][0]:
                inner.append((at, list(nodes[at][0]), range(len(nodes), len(nodes) + len(nodes[at][0]))))
                nodes += nodes[at][0].values()
            at += 1
        alphabet = sorted({c for _, chars, _ in inner for c in chars})
        #: The number of each code point: 1 for those that no piece has; 0 is what stands behind a word.
        self.code_of = np.ones(0x110000, np.int32)
        self.code_of[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)
        number = {c: k + 2 for k, c in enumerate(alphabet)}
        self.piece = np.array([n[1] for n in nodes], np.int32)
        self.score = np.array([n[2] for n in nodes], np.float64)
        self.base = np.zeros(len(nodes), np.int64)
        draw = np.random.default_rng(0)
        room = 4 * len(nodes)
        self.node = np.zeros(room + len(alphabet) + 2, np.int32)  # the child that stands at a place, 0 for none
        self.owner = np.full(len(self.node), -1, np.int32)
        for of, chars, children in sorted(inner, key=lambda x: -len(x[1])):
            codes = np.array([number[c] for c in chars])
            base = int(draw.integers(room))
            while (self.owner[base + codes] >= 0).any():
                base = int(draw.integers(room))
            self.base[of], self.owner[base + codes], self.node[base + codes] = base, of, children

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each node under a character's number, 0 for none."""
        at = self.base[nodes] + codes
        return np.where(self.owner[at] == nodes, self.node[at], 0)


class Viterbi:
    """Best segmentation of many words at once, and its lead over the second best, by one forward pass over all their lattices."""

    def __init__(self, lattice: Lattice):
        self.lattice, self.trie = lattice, Trie(lattice.trie)

    def run(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores, leads, numbers of ids, and all ids in a row. Ties go to the longest last piece, as in :meth:`Lattice.best_of`."""
        trie, low = self.trie, -math.inf
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        # a slot for each boundary of each word, which also holds the character behind it
        first = np.concatenate([[0], np.cumsum(lengths + 1)])
        chars = np.arange(len(points)) + np.repeat(np.arange(len(words)), lengths)
        codes = np.zeros(first[-1], np.int64)
        codes[chars] = trie.code_of[points]
        place = (np.arange(first[-1]) - np.repeat(first[:-1], lengths + 1)).astype(np.int32)
        ends, depths, pieces, scores = self._edges(codes, chars)
        order = np.argsort((place[ends].astype(np.int64) << 8) - depths, kind="stable")
        ends, depths, pieces, scores = ends[order], depths[order], pieces[order], scores[order]
        wide = np.ones(len(ends), np.int64)
        spelled = pieces < 0
        if spelled.any():
            point = np.zeros(first[-1], np.uint32)
            point[chars] = points
            said = [self.lattice.ids_of(-1, chr(c), 0) for c in point[ends[spelled] - 1].tolist()]
            wide[spelled] = list(map(len, said))
            said = dict(zip((ends[spelled] - 1).tolist(), said))
        best, second = np.full(first[-1], low), np.full(first[-1], low)
        back, by, n = np.zeros(first[-1], np.int32), np.zeros(first[-1], np.int32), np.zeros(first[-1], np.int64)
        best[first[:-1]] = 0.0
        groups = (place[ends].astype(np.int64) << 8) - depths
        bounds = key_runs(groups)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):  # a place and a length of pieces: no end twice
            at, depth = ends[a:b], int(depths[a])
            begin, was = at - depth, best[at]
            value = best[begin] + scores[a:b]
            second[at] = np.maximum(np.maximum(second[at], np.minimum(value, was)), second[begin] + scores[a:b])
            better = value > was
            won = at[better]
            best[won], back[won], by[won], n[won] = value[better], depth, pieces[a:b][better], n[begin[better]] + wide[a:b][better]
        last = first[1:] - 1
        starts = np.concatenate([[0], np.cumsum(n[last])])
        ids = np.empty(starts[-1], "<u4")
        at, base = last[lengths > 0], starts[:-1][lengths > 0]
        while len(at):
            begin, piece = at - back[at], by[at]
            known = piece >= 0
            ids[(base + n[begin])[known]] = piece[known]
            for k in np.flatnonzero(~known).tolist():
                here, letters = base[k] + n[begin[k]], said[int(begin[k])]
                ids[here : here + len(letters)] = letters
            on = place[begin] > 0
            at, base = begin[on], base[on]
        return best[last], best[last] - second[last], n[last], ids

    def _edges(self, codes: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, ...]:
        """(end, length, piece, score) of all pieces in the words; -1 spells a character that is no piece."""
        trie, begins = self.trie, chars
        nodes, alone, out = np.zeros(len(chars), np.int64), np.zeros(len(codes), bool), []
        for depth in range(1, self.lattice.longest + 1):
            nodes = trie.step(nodes, codes[begins + depth - 1])
            alive = nodes > 0
            begins, nodes = begins[alive], nodes[alive]
            if not len(begins):
                break
            ended = trie.piece[nodes] >= 0
            out.append((begins[ended] + depth, np.full(ended.sum(), depth), trie.piece[nodes[ended]], trie.score[nodes[ended]]))
            if depth == 1:
                alone[begins[ended]] = True
        rest = chars[~alone[chars]]
        out.append((rest + 1, np.ones(len(rest), np.int64), np.full(len(rest), -1, np.int32), np.full(len(rest), self.lattice.unknown)))
        return tuple(np.concatenate(x) for x in zip(*out))


class Encoder:
    """Encodes batches of whole texts; one per task, with a memory of parts that is bounded by bytes.

    A part is named by a key: a word behind one space by the word, a line feed and the word that follows
    it by both. What is known of a part is its score, its lead and where its ids stand in one array.
    """

    def __init__(self, lattice: Lattice, n: int):
        self.lattice, self.n, self.viterbi = lattice, n, viterbi_of(lattice)
        self.feed = lattice.spelled[10]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.others: dict[str, list] = {}
        self.bytes = 0
        self.scores = self.leads = np.zeros(0)
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _learn(self, keys: set[str]) -> None:
        """Work out the parts that aren't known yet, all at once."""
        new = sorted(keys.difference(self.known))
        if not new:
            return
        long = [k for k in new if len(k) > LONGEST]
        new = [k for k in new if len(k) <= LONGEST] + long
        words = [k[1:] if k[:1] == "\n" else SPACE + k for k in new]
        scores, leads, counts, ids = self.viterbi.run(words[: len(words) - len(long)])
        if long:  # place by place, these would be steps with a word each
            found = list(self.lattice.best_of(words[len(words) - len(long) :]))
            scores, leads = np.concatenate([scores, [f[0] for f in found]]), np.concatenate([leads, [f[2] for f in found]])
            counts, ids = np.concatenate([counts, [len(f[1]) for f in found]]), np.concatenate([ids, *[np.array(f[1], "<u4") for f in found]])
        fed = np.fromiter((k[:1] == "\n" for k in new), bool, len(new))
        if fed.any():
            ids = np.insert(ids, (np.cumsum(counts) - counts)[fed], self.feed)
            counts = counts + fed
            scores = scores + np.where(fed, self.lattice.unknown, 0.0)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.scores, self.leads, self.counts, self.ids = (np.concatenate(x) for x in (
            (self.scores, scores), (self.leads, leads), (self.counts, counts), (self.ids, ids),
        ))
        self.bytes += 200 * len(new) + 4 * sum(map(len, new))

    @staticmethod
    def _keys(text: str) -> list[str]:
        """The keys of a text's parts, in order; none for no text."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, LITERAL)
        if "  " in text or " \n" in text or text[-1] == " " or text[0] == " ":
            return Encoder._odd_keys(text)
        if "\n" not in text:
            return text.split(" ")
        keys = text.replace("\n", " \n").split(" ")
        return keys  # a text that begins with a line feed begins with the space before it: the empty key

    @staticmethod
    def _odd_keys(text: str) -> list[str]:
        """Keys of a text with runs of spaces: each run goes with the word behind it."""
        out: list[str] = []
        fed = False
        for k, m in enumerate(_PARTS.findall(text)):
            if m == "\n":
                out += [""] * (k == 0) + ["\n"]
            elif fed and m[0] != " ":
                out[-1] += m
            else:
                word = m.replace(" ", SPACE)
                out.append(word if k == 0 else word[1:])
            fed = m == "\n"
        return out

    def encode(self, texts: list[str]) -> list[list[tuple[float, bytes, bool]]]:
        """For each text its n best (score, packed little-endian 32-bit ids, whether they decode to the text), best first.

        Decoding puts pieces together, so what differs from the best segmentation in some parts decodes to
        the text if the best does and these parts decode alike.
        """
        if self.bytes > REMEMBERED_BYTES:
            self._forget()
        keys = [self._keys(t) for t in texts]
        self._learn(set().union(*keys))
        bounds = np.concatenate([[0], np.cumsum(list(map(len, keys)))])
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(keys)), np.int64, bounds[-1])
        scores, leads, counts = self.scores[which], self.leads[which], self.counts[which]
        places = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(self.starts[which] - places[:-1], counts) + np.arange(places[-1])]
        out = []
        for text, of, a, b in zip(texts, keys, bounds[:-1].tolist(), bounds[1:].tolist()):
            whole, total = ids[places[a] : places[b]].tobytes(), float(scores[a:b].sum())
            exact = decode(self.lattice, whole) == text
            ranked = [(total, whole, exact)]
            for lead, changes in self._combine(leads[a:b], of)[1:]:
                parts, at, same = [], int(places[a]), exact
                for i in sorted(changes):
                    begin, end = int(places[a + i]), int(places[a + i + 1])
                    parts += [ids[at:begin].tobytes(), changes[i]]
                    same &= self._bytes(ids[begin:end]) == self._bytes(np.frombuffer(changes[i], "<u4"))
                    at = end
                ranked.append((total - lead, b"".join([*parts, ids[at : places[b]].tobytes()]), same))
            out.append(ranked)
        return out

    def _bytes(self, ids: np.ndarray) -> bytes:
        return b"".join([self.lattice.text_of[i] for i in ids.tolist()])

    def _others(self, key: str) -> list[tuple[float, bytes]]:
        """(lead, ids) of the next best segmentations of a part, from the A* search."""
        if (found := self.others.get(key)) is None:
            k = self.known[key]
            packed = self.ids[self.starts[k] : self.starts[k] + self.counts[k]].tobytes()
            head, word = (np.array([self.feed], "<u4").tobytes(), key[1:]) if key[:1] == "\n" else (b"", SPACE + key)
            base = self.scores[k] - (self.lattice.unknown if head else 0.0)
            ranked = [(float(base - s), head + array("I", ids).tobytes()) for s, ids in self.lattice.n_best(word, self.n)]
            found = self.others[key] = [x for x in ranked if x[1] != packed][: self.n - 1]
            self.bytes += 300 + 16 * len(key)
        return found

    def _combine(self, leads: np.ndarray, keys: list[str]) -> list[tuple[float, dict[int, bytes]]]:
        """The n least sums of leads, one a part. All but n - 1 parts with the least leads stay at their best."""
        k = min(self.n - 1, len(leads))
        near = np.argsort(leads, kind="stable")[:k] if len(leads) <= 64 else np.sort(np.argpartition(leads, k - 1)[:k]) if k else []
        sums: list[tuple[float, dict[int, bytes]]] = [(0.0, {})]
        for i in [int(i) for i in near if leads[i] < math.inf]:
            more = [(s + lead, c | {i: ids}) for s, c in sums for lead, ids in self._others(keys[i])]
            sums = sorted(sums + more, key=lambda x: x[0])[: self.n]
        return sums


def decode(lattice: Lattice, packed: bytes) -> str:
    """The text of packed ids: pieces put together, less the space that precedes every text."""
    text = lattice.text_of
    return b"".join([text[i] for i in np.frombuffer(packed, "<u4").tolist()])[1:].decode("utf-8", "replace")


_LOADED: dict[str, Lattice] = {}
_VITERBI: dict[int, Viterbi] = {}


def lattice_of(path: str) -> Lattice:
    """One lattice per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Lattice(path)
    return _LOADED[path]


def viterbi_of(lattice: Lattice) -> Viterbi:
    if id(lattice) not in _VITERBI:
        _VITERBI[id(lattice)] = Viterbi(lattice)  # which keeps the lattice
    return _VITERBI[id(lattice)]


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[pa.Array, list]]:
    """The first column and the n best of the second's texts, some rows at a time."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            n = max(1, min(ROWS, int(np.searchsorted(sizes, before + CHARACTERS, "right")) - at))
            part = batch.slice(at, n)
            yield part.column(0), encoder.encode(texts_of(part.column(1)))
            at += n


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = 3, model: str | None = None) -> DataFrame:
    """``doc_id, rank, score, ids`` (binary): the n best segmentations of each whole text, ranks from 1.

    Scores are sums of piece scores, and a character without a piece counts as one beyond the rarest.
    Texts with fewer segmentations have fewer rows; a null text is empty, and an empty one has one empty
    segmentation. Segmentations of equal score come in the order of the search, which is the same each
    time. Rows are encoded each for itself, repeated ones too; no rows give no rows.
    """
    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ranked in _encoded(batches, Encoder(lattice_of(path), n)):
            which = np.repeat(np.arange(len(ranked)), [len(r) for r in ranked])
            rows = [x for r in ranked for x in r]
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.take(pa.array(which)), pa.array([k + 1 for r in ranked for k in range(len(r))], pa.int32()),
                    pa.array([x[0] for x in rows], pa.float64()), pa.array([x[1] for x in rows], pa.binary()),
                ],
                names=["doc_id", "rank", "score", "ids"],
            )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.transform(in_arrow, run, "doc_id long, rank int, score double, ids binary")


def decode_column(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, rank, text`` of the output of :func:`encode`; null ids give a null text."""
    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattice_of(path)
        for batch in batches:
            texts = [None if p is None else decode(lattice, p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "rank", "text"])

    return encoded.select("doc_id", "rank", "ids").transform(in_arrow, run, "doc_id long, rank int, text string")


def digests(docs: DataFrame, n: int = 3, model: str | None = None) -> DataFrame:
    """A row per document: ``doc_id, n_pieces, scores, ids_crc32`` of its n best, and whether each decodes to the text."""
    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ranked in _encoded(batches, Encoder(lattice_of(path), n)):
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids, pa.array([len(r[0][1]) // 4 for r in ranked], pa.int64()), pa.array([[x[0] for x in r] for r in ranked], pa.list_(pa.float64())),
                    pa.array(
                        [[zlib.crc32(x[1]) for x in r] for r in ranked], pa.list_(pa.int64()),
                    ), pa.array([all(x[2] for x in r) for r in ranked], pa.bool_()),
                ],
                names=["doc_id", "n_pieces", "scores", "ids_crc32", "exact"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(in_arrow, run, "doc_id long, n_pieces long, scores array<double>, ids_crc32 array<long>, exact boolean")
