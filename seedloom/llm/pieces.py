"""N-best segmentation over a SentencePiece vocabulary.

The lattice of a text has an edge for every piece that matches at a position, and, for a
character that is no piece, an edge of byte pieces.  A forward Viterbi pass gives the
best score of every prefix.  It is the exact heuristic of an A* search that runs backward
from the end: partial paths leave the queue in the order of their best completion, so the
first N complete ones are the N best.

No piece holds a space mark behind another character, so no edge crosses the border in
front of a run of marks.  A text is cut there, and each distinct chunk is searched once
per worker.  The N best of a text combine the alternatives of its chunks by the same
backward search; a combination among the N best can only change one of the N - 1 chunks
whose second path loses least, so the others stay at their best.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Searched chunks a worker remembers; when full it starts anew, which costs time only.
REMEMBERED = 600_000
#: Characters of the texts whose chunks are searched together, which bounds the lattice in memory.
LEARNED_AT_ONCE = 1 << 18
#: Longer chunks are searched one by one.
SHORT = 48
NONE = float("-inf")
#: Of a text without pieces.
EMPTY_HASH = xxhash.xxh64_hexdigest(b"")


class Vocabulary:
    """Pieces and scores, taken from a model file or given; scores add up along a path.

    The scores are used as the file has them (in a BPE model the negative rank).  A
    character without a piece costs more than the worst piece and becomes byte pieces.
    """

    def __init__(self, path: str | None = None, pieces: dict[str, float] | None = None):
        if path is not None:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
            self.byte = [names.index(f"<0x{b:02X}>") for b in range(256)]
            special = {i for i in range(len(names)) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)}
            self.piece = {p: (i, model.get_score(i), (i,)) for i, p in enumerate(names) if i not in special}
        else:
            names = [f"<0x{b:02X}>" for b in range(256)] + list(pieces)
            self.byte = list(range(256))
            self.piece = {p: (256 + i, float(s), (256 + i,)) for i, (p, s) in enumerate(pieces.items())}
        if any(SPACE in p.lstrip(SPACE) for p in self.piece):
            raise ValueError("a piece continues behind a space mark; texts can't be cut there")
        self.raw = [x.replace(SPACE, " ").encode() for x in names]
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes((b,))
        self.longest = max(map(len, self.piece))
        self.unknown = min((s for _, s, _ in self.piece.values() if s > -1e8), default=0.0) - 10
        #: Character by character: (the piece that ends here or None, what may follow).
        self.trie: dict[str, list] = {}
        for p, hit in self.piece.items():
            below = self.trie
            for char in p:
                node = below.setdefault(char, [None, {}])
                below = node[1]
            node[0] = hit
        self._number_nodes()

    def bytes_of(self, char: str) -> tuple[int, ...]:
        """Byte pieces of a character."""
        char = " " if char == SPACE else char
        return tuple(self.byte[b] for b in char.encode("utf-8", "surrogatepass"))

    def _number_nodes(self) -> None:
        """The trie as arrays for ``best_of_many``: children by (node, character), piece and score by node."""
        keys, piece, score, level = [], [-1], [NONE], [(0, self.trie)]
        for node, below in level:
            for char, (hit, more) in below.items():
                keys.append(node << 21 | ord(char))
                level.append((len(piece), more))
                piece.append(-1 if hit is None else hit[0])
                score.append(NONE if hit is None else hit[1])
        # a level is numbered as its keys are listed, so the n-th key leads to node n + 1
        order = np.argsort(np.array(keys, np.int64))
        self._keys, self._child = np.array(keys, np.int64)[order], (order + 1).astype(np.int64)
        self._piece, self._score = np.array(piece, np.int32), np.array(score)

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each node by its character, or -1."""
        key = node << 21 | char
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._child[at], -1)

    def edges(self, chunk: str) -> list[tuple[int, int, float, tuple[int, ...]]]:
        """The lattice: edges (start, end, score, ids) in the order of their starts."""
        n = len(chunk)
        out = []
        for i in range(n):
            below = self.trie
            alone = True
            j = i
            for char in chunk[i : i + self.longest]:
                node = below.get(char)
                if node is None:
                    break
                j += 1
                hit, below = node
                if hit is not None:
                    out.append((i, j, hit[1], hit[2]))
                    if j == i + 1:
                        alone = False
            if alone:
                char = " " if chunk[i] == SPACE else chunk[i]
                out.append((i, i + 1, self.unknown, tuple(self.byte[b] for b in char.encode("utf-8", "surrogatepass"))))
        return out

    @staticmethod
    def forward(edges: list, n: int) -> tuple[list[float], list]:
        """Best score of every prefix, and the edge that gives it (the first of equal ones)."""
        best: list[float] = [0.0] + [NONE] * n
        by: list = [None] * (n + 1)
        for e in edges:
            s = best[e[0]] + e[2]
            if s > best[e[1]]:
                best[e[1]] = s
                by[e[1]] = e
        return best, by

    def best(self, chunk: str) -> tuple[float, float, list[int]]:
        """Best score, loss of the second path (infinite if there is none), best ids.

        One forward pass keeps the best and the second score of every prefix while it walks
        the lattice; it takes the same edges in the same order as ``forward``.
        """
        n, longest, trie = len(chunk), self.longest, self.trie
        best, second = [0.0] + [NONE] * n, [NONE] * (n + 1)
        by: list = [None] * (n + 1)
        for i in range(n):
            here, next_best = best[i], second[i]
            below = trie
            alone = True
            j = i
            for char in chunk[i : i + longest]:
                node = below.get(char)
                if node is None:
                    break
                j += 1
                hit, below = node
                if hit is not None:
                    if j == i + 1:
                        alone = False
                    s = here + hit[1]
                    old = best[j]
                    if s > old:
                        other = next_best + hit[1]
                        second[j] = old if old > other else other
                        best[j] = s
                        by[j] = (i, hit[2])
                    elif s > second[j]:
                        second[j] = s
            if alone:
                j, cost = i + 1, self.unknown
                char = " " if chunk[i] == SPACE else chunk[i]
                ids = tuple(self.byte[b] for b in char.encode("utf-8", "surrogatepass"))
                s, old = here + cost, best[j]
                if s > old:
                    other = next_best + cost
                    second[j] = old if old > other else other
                    best[j] = s
                    by[j] = (i, ids)
                elif s > second[j]:
                    second[j] = s
        parts = []
        at = n
        while at:
            at, ids = by[at]
            parts.append(ids)
        return best[n], best[n] - second[n], [i for ids in reversed(parts) for i in ids]

    def best_of_many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """``best`` of every chunk, ids as int32 bytes: all chunks walk the lattice together.

        Edges are taken in the order of their starts within the chunk, as ``best`` does; those of one start have
        different ends.
        """
        size = np.array([len(c) for c in chunks])
        first = np.cumsum(size) - size
        of = np.repeat(np.arange(len(chunks)), size)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        start = np.arange(len(codes))
        stop, slot = (first + size)[of], start + of  # a chunk of n characters has n + 1 prefixes
        node, at, depth = self._step(np.zeros(len(codes), np.int64), codes), start, 1
        found: list[tuple[np.ndarray, ...]] = []
        alone = np.ones(len(codes), bool)
        while True:
            at, node = at[node >= 0], node[node >= 0]
            if not len(at):
                break
            hit = self._piece[node] >= 0
            if depth == 1:
                alone[at[hit]] = False
            found.append((at[hit], np.full(hit.sum(), depth), self._score[node[hit]], self._piece[node[hit]]))
            inside = at + depth < stop[at]
            at, node = at[inside], node[inside]
            node = self._step(node, codes[at + depth])
            depth += 1
        at = start[alone]
        found.append((at, np.ones(len(at), np.int64), np.full(len(at), float(self.unknown)), np.full(len(at), -1, np.int32)))
        begin, length, cost, piece = (np.concatenate(x) for x in zip(*found))
        step = begin - first[of[begin]]
        order = np.argsort(step, kind="stable")
        begin, length, cost, piece = begin[order], length[order], cost[order], piece[order]
        source = slot[begin]
        target = source + length
        best, second = np.full(len(codes) + len(chunks), NONE), np.full(len(codes) + len(chunks), NONE)
        by = np.zeros(len(best), np.int64)
        zero = first + np.arange(len(chunks))
        best[zero] = 0.0
        cuts = np.searchsorted(step[order], np.arange(size.max() + 1)).tolist()
        for a, b in zip(cuts, cuts[1:]):
            s, t = source[a:b], target[a:b]
            here, other, old, low = best[s] + cost[a:b], second[s] + cost[a:b], best[t], second[t]
            better = here > old
            second[t] = np.where(better, np.maximum(old, other), np.maximum(low, here))
            best[t] = np.where(better, here, old)
            by[t] = np.where(better, np.arange(a, b), by[t])
        # walked back together, the last edges first
        end = zero + size
        who, at, taken = np.arange(len(chunks)), end, []
        while len(who):
            e = by[at]
            taken.append((who, e))
            more = source[e] != zero[who]
            who, at = who[more], source[e][more]
        who, e = (np.concatenate(x[::-1]) for x in zip(*taken))
        e = e[np.argsort(who, kind="stable")]
        ids, count = piece[e], np.bincount(who, minlength=len(chunks))
        raw, cut = ids.tobytes(), (4 * np.concatenate([[0], np.cumsum(count)])).tolist()
        out = [raw[a:b] for a, b in zip(cut, cut[1:])]
        for k in np.unique(of[begin[e[ids < 0]]]).tolist():  # with characters without a piece
            a, b = cut[k] // 4, cut[k + 1] // 4
            whole: list[int] = []
            for i, x in zip(ids[a:b].tolist(), (begin[e[a:b]] - first[k]).tolist()):
                whole += (i,) if i >= 0 else self.bytes_of(chunks[k][x])
            out[k] = array("i", whole).tobytes()
        return best[end], best[end] - second[end], out

    def n_best(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best (score, ids), best first; fewer if there are fewer paths."""
        edges = self.edges(chunk)
        best, _ = self.forward(edges, len(chunk))
        into: list[list] = [[] for _ in best]
        for e in edges:
            into[e[1]].append(e)
        queue = [(-best[-1], 0, len(chunk), 0.0, None)]
        order, out = 0, []
        while queue and len(out) < n:
            _, _, at, done, path = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((done, ids))
                continue
            for i, _, s, piece in into[at]:
                order += 1
                heapq.heappush(queue, (-(best[i] + s + done), order, i, s + done, (piece, path)))
        return out

    def decode(self, ids) -> str:
        """Text of piece ids; the space in front that encoding added is taken off."""
        return self.decode_part(ids).removeprefix(" ")

    def decode_part(self, ids) -> str:
        """Text of the piece ids of one chunk; the ids of a text decode to its chunks' texts, joined."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")


def chunks_of(text: str) -> list[str | None]:
    """The text, a space in front, cut where no piece can cross; None is a literal mark."""
    if not text:
        return []
    if SPACE not in text:
        return CHUNK.findall(SPACE + text.replace(" ", SPACE))
    out: list[str | None] = []
    for i, part in enumerate((" " + text).split(SPACE)):
        out += [None] * (i > 0) + CHUNK.findall(part.replace(" ", SPACE))
    return out


class Encoder:
    """Texts to their N best segmentations, remembering the chunks it has seen."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.v, self.n = vocabulary, n
        self.forget()

    def forget(self) -> None:
        mark = [self.v.byte[b] for b in SPACE.encode()]
        self.at: dict[str | None, int] = {None: 0}
        self.score, self.loss = np.zeros(1024), np.full(1024, np.inf)
        self.score[0] = self.v.unknown
        self.ids = [np.array(mark, np.int32).tobytes()]
        self.back = [SPACE]
        self.more: dict[str, list] = {}

    def learn(self, chunks: list[str]) -> None:
        """Search chunks that are not known yet; short ones together."""
        short = [c for c in chunks if len(c) <= SHORT]
        found = list(zip(short, *self.v.best_of_many(short))) if short else []
        for c in chunks:
            if len(c) > SHORT:
                score, loss, ids = self.v.best(c)
                found.append((c, score, loss, array("i", ids).tobytes()))
        k, n = len(self.ids), len(self.ids) + len(found)
        if n > len(self.score):
            room = np.zeros(max(n, 2 * len(self.score)) - len(self.score))
            self.score, self.loss = np.concatenate([self.score, room]), np.concatenate([self.loss, room])
        for i, (c, score, loss, ids) in enumerate(found, k):
            self.score[i], self.loss[i], self.at[c] = score, loss, i
            self.ids.append(ids)
            self.back.append(self.v.decode_part(array("i", ids)))

    def prepare(self, texts: list[str]) -> list[list]:
        """The chunks of several texts; unknown ones are learned at once, which is faster than one by one."""
        if len(self.at) > REMEMBERED:
            self.forget()
        cut = [chunks_of(t) for t in texts]
        self.learn(list(set().union(*cut).difference(self.at)))
        return cut

    def _best(self, chunks: list) -> tuple[list[int], list[float], list[dict[int, list[int]]]]:
        """Numbers of the chunks; the N best scores; for each, which chunks differ and their ids."""
        at = list(map(self.at.__getitem__, chunks))
        index = np.array(at)
        loss = self.loss[index]
        weak = np.arange(len(loss)) if len(loss) < self.n else np.argpartition(loss, self.n - 2)[: self.n - 1] if self.n > 1 else []
        return at, *self._combine(float(self.score[index].sum()), sorted(int(k) for k in weak if loss[k] < np.inf), chunks)

    def encode(self, text: str) -> tuple[np.ndarray, list[float], list[dict[int, list[int]]], list]:
        """Best ids; the N best scores; for each, which chunks differ and their ids; chunks."""
        chunks = self.prepare([text])[0]
        if not chunks:
            return np.zeros(0, np.int32), [], [], []
        at, scores, changes = self._best(chunks)
        return np.frombuffer(b"".join([self.ids[i] for i in at]), np.int32), scores, changes, chunks

    def _alternatives(self, chunk: str) -> list:
        if chunk not in self.more:
            self.more[chunk] = self.v.n_best(chunk, self.n)
        return self.more[chunk]

    def _combine(self, total: float, weak: list[int], chunks: list) -> tuple[list[float], list[dict]]:
        """Backward search over the weak chunks; all other chunks keep their best path."""
        options = [self._alternatives(chunks[k]) for k in weak]
        queue = [(-total, 0, len(weak), {})]
        scores: list[float] = []
        changes: list[dict] = []
        order = 0
        while queue and len(scores) < self.n:
            cost, _, left, changed = heapq.heappop(queue)
            if left == 0:
                scores.append(-cost)
                changes.append(changed)
                continue
            for rank, (s, ids) in enumerate(options[left - 1]):
                order += 1
                heapq.heappush(queue, (cost + options[left - 1][0][0] - s, order, left - 1, changed | {weak[left - 1]: ids} if rank else changed))
        return scores, changes

    def n_best(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a whole text, written out."""
        _, scores, changes, chunks = self.encode(text)
        best = [np.frombuffer(self.ids[self.at[c]], np.int32).tolist() for c in chunks]
        return [(s, [i for k, part in enumerate(best) for i in changed.get(k, part)]) for s, changed in zip(scores, changes)]


    def digests(self, chunks: list) -> tuple[list[float], list[tuple[str, int, str]]]:
        """Of a text, cut by ``prepare``: the N best scores; for each segmentation the xxHash64 of its ids
        (int32, little-endian), its number of pieces and the text decoded from them.

        Every segmentation is written out whole.  A chunk's best ids are decoded when it is first seen.
        """
        if not chunks:
            return [], []
        at, scores, changes = self._best(chunks)
        ids, back = list(map(self.ids.__getitem__, at)), list(map(self.back.__getitem__, at))
        out = []
        for changed in changes:
            for k, other in changed.items():
                ids[k], back[k] = array("i", other).tobytes(), self.v.decode_part(other)
            raw = b"".join(ids)
            out.append((xxhash.xxh64_hexdigest(raw), len(raw) // 4, "".join(back).removeprefix(" ")))
            for k in changed:
                ids[k], back[k] = self.ids[at[k]], self.back[at[k]]
        return scores, out


_CODERS: dict[tuple[str, int], Encoder] = {}


def _coder(model_file: str, n: int) -> Encoder:
    """The encoder of this worker process; its tasks share the model and the chunks it remembers."""
    if (model_file, n) not in _CODERS:
        _CODERS[model_file, n] = Encoder(Vocabulary(model_file), n)
    return _CODERS[model_file, n]


def encode(text: str, model_file: str, n: int = 1) -> Column:
    """array<struct<score, ids>>: the ``n`` best segmentations of a text column, best first."""

    @F.pandas_udf("array<struct<score:double,ids:array<int>>>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Encoder(Vocabulary(model_file), n)
        for texts in batches:
            yield pd.Series([[{"score": s, "ids": ids} for s, ids in coder.n_best(t or "")] for t in texts])

    return apply(F.col(text))


def decode(ids: str, model_file: str) -> Column:
    """The text of a column of piece ids; null gives an empty text."""

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(model_file)
        for rows in batches:
            yield pd.Series([vocabulary.decode(x) if x is not None else "" for x in rows])

    return apply(F.col(ids))


DIGEST = (
    "n_pieces long, best_score double, scores array<double>, ids_xxh64 string, n_chars_back long, round_trip boolean, "
    "all_n_pieces array<long>, all_ids_xxh64 array<string>"
)


def segmentation_digest(docs: DataFrame, model_file: str, n: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of pieces, the N best scores, a hash of the best ids (int32,
    little-endian), the length of the text decoded from them, whether the text decoded from each of the N
    segmentations is the text, and the number of pieces and the hash of ids of each, best first.

    Null and empty texts have no pieces and no scores (``best_score`` null).  Equal scores
    are listed as often as there are paths.  Repeated rows are encoded each on its own, an
    empty table gives an empty result, and other columns are not read.
    """

    @F.pandas_udf(DIGEST)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _coder(model_file, n)
        names = [x.split()[0] for x in DIGEST.split(", ")]
        for texts in batches:
            rows, ahead = [], 0
            texts = [t or "" for t in texts]
            while ahead < len(texts):
                begin, held = ahead, 0
                while ahead < len(texts) and held < LEARNED_AT_ONCE:
                    held += len(texts[ahead])
                    ahead += 1
                for t, chunks in zip(texts[begin:ahead], coder.prepare(texts[begin:ahead])):
                    scores, every = coder.digests(chunks)
                    if not every:
                        rows.append((0, None, [], EMPTY_HASH, 0, t == "", [], []))
                        continue
                    hashes, sizes, backs = (list(x) for x in zip(*every))
                    same = all(back == t for back in backs)
                    rows.append((sizes[0], scores[0], scores, hashes[0], len(backs[0]), same, sizes, hashes))
            yield pd.DataFrame(rows, columns=names)

    return docs.select(F.col(doc_id), apply(F.col(text)).alias("_s")).select(doc_id, "_s.*")
