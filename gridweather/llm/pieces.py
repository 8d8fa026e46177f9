"""SentencePiece encoding and decoding by weighted finite-state transducers.

The model file is compiled into three machines: the normaliser (blank to the piece mark, mark before the text), the lexicon of
pieces with byte fallback, and, for models of the merging kind, a two-piece filter that lets a piece follow another only if
merging their joined text gives back just these two. Composing them with an input leaves a lattice; the cheapest path in the
tropical semiring (sums along a path, the least over paths) is the encoding. For unigram models the weights alone decide; for
merging models the filter leaves one path, the one that merging itself would give.

The input is composed stretch by stretch: no piece has the mark after another character, and a character that no piece holds
is always spelled in bytes, so paths never cross those places. Stretches repeat, so those of a slice of texts are composed
once each and all at a time, in arrays: the lexicon's walks from every place, then place by place the arcs that the filter lets
follow the one arc that is left at their start. A stretch where that leaves two arcs or none is searched by itself, and so is a
very long one. Of merging models, stretches that begin with two or more blanks are not composed but merged outright.

Null text gives null; empty text no ids. Decoding gives the text back exactly, unless the text itself holds the mark, which is
read as a blank. Every row is encoded by itself, so repeated rows and other columns do not matter.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gridweather.llm.common import doc_rows, handed_back, held

# Fixed values of the format.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
#: Pairs that a worker keeps, by search and by their hash, and characters it encodes at a time; bound memory, change no result.
KEEP = 100_000
KEEP_BITS = 19
SLICE = 300_000
#: Rows of a batch whose texts and ids are worked on together; what is kept of a portion are Arrow's flat arrays.
ROWS = 1_000
#: Longer stretches are composed by themselves.
LONG = 256
NEVER = float("inf")
SCHEMA = "struct<ids:array<int>,n_bytes:bigint,exact:boolean>"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes):
    """(number, value) of the fields of one message: whole numbers, floats or bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


#: A stretch begins at a mark that follows anything else.
BORDER = re.compile(f"[^{MARK}](?={MARK})")


class Tables:
    """The lexicon and the filter of a merging model as arrays, to compose many stretches with them at a time."""

    def __init__(self, model: Transducer):
        self.many = len(model.text)
        self.size = np.array([len(t) for t in model.text])
        lexicon = {t: i for t, i in model.ids.items() if t in model.score and model.known.issuperset(t) and not t.startswith(MARK * 2)}
        self._walks(lexicon)
        sides: tuple[list, list] = ([], [])
        for piece, t in enumerate(model.text):
            rows = list(model.merging(t)) if t in lexicon else []
            for side, end in ((0, 0), (1, -1)):
                sides[side].append([(model.ids[p], -model.score[p]) for p in dict.fromkeys(row[end] for row in rows)])
        self.grown = []
        for edges in sides:
            ends = np.concatenate([[0], np.cumsum([len(e) for e in edges])])
            flat = [x for e in edges for x in e]
            self.grown.append((ends, np.array([i for i, _ in flat], np.int64), np.array([c for _, c in flat] + [NEVER])))
        across = {model.ids[t[:i]] * self.many + model.ids[t[i:]]: -w for t, w in model.score.items() for i in range(1, len(t)) if t[:i] in model.score and t[i:] in model.score}
        order = np.argsort(keys := np.array([*across, 1 << 62], np.int64))
        self.across, self.cost = keys[order], np.array([*across.values(), NEVER])[order]
        self.held, self.fits = np.full(1 << KEEP_BITS, -1, np.int64), np.zeros(1 << KEEP_BITS, bool)

    def _walks(self, lexicon: dict[str, int]) -> None:
        """The lexicon's tree in three arrays: a child lies at its node's base plus the number of its character and names its node."""
        counts = Counter(c for t in lexicon for c in t)
        self.number = np.zeros(0x110000, np.int32)
        letters = {c: i for i, (c, _) in enumerate(counts.most_common(), 1)}
        self.number[[ord(c) for c in letters]] = list(letters.values())
        tree: dict = {}
        for t, i in lexicon.items():
            node = tree
            for c in t:
                node = node.setdefault(letters[c], {})
            node[0] = i
        top = len(letters) + 1
        base, owner, piece, taken, free = [0], [0], [-1], bytearray(b"\1"), 0
        nodes = [(0, tree)]
        for place, node in nodes:  # parents first
            children = sorted(c for c in node if c)
            if not children:
                continue
            at, tries = (free if place else 1), 0
            while True:
                at = taken.find(0, max(at, children[0]))
                if at < 0 or tries > 100:
                    at = max(len(taken), children[0])
                start, tries = at - children[0], tries + 1
                if place == 0 or all(start + c >= len(taken) or not taken[start + c] for c in children):
                    break
                at += 1
            start = 0 if place == 0 else start
            grow = start + children[-1] + 1 - len(taken)
            if grow > 0:
                taken.extend(bytes(grow)), base.extend([0] * grow), owner.extend([-1] * grow), piece.extend([-1] * grow)
            base[place] = start
            for c in children:
                taken[start + c], owner[start + c], piece[start + c] = 1, place, node[c].get(0, -1)
                nodes.append((start + c, node[c]))
            free = len(taken) if (free := taken.find(0, free)) < 0 else free
        self.base = np.array(base + [0] * top, np.int32)
        self.owner = np.array(owner + [-1] * top, np.int32)
        self.owner[0] = -1
        self.piece = np.array(piece + [-1] * top, np.int32)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``Transducer.follows`` for arrays of pairs."""
        (ends, right_id, right_cost), (starts, left_id, left_cost) = self.grown[1], self.grown[0]
        i, j, last_i, last_j = ends[a], starts[b], ends[a + 1] - 1, starts[b + 1] - 1
        out, open_ = np.zeros(len(a), bool), np.arange(len(a))
        while len(open_):
            keys = right_id[i] * self.many + left_id[j]
            at = np.searchsorted(self.across, keys)
            across = np.where(self.across[at] == keys, self.cost[at], NEVER)
            grow_left = np.where(i < last_i, right_cost[i + 1], NEVER)
            grow_right = np.where(j < last_j, left_cost[j + 1], NEVER)
            lost = (across < grow_left) & (across <= grow_right) & (across < NEVER)
            done = (grow_left == NEVER) & (grow_right == NEVER)
            out[open_[done & ~lost]] = True
            on, lefts = ~(done | lost), grow_left <= grow_right
            i, j = np.where(lefts, i + 1, i)[on], np.where(lefts, j, j + 1)[on]
            open_, last_i, last_j = open_[on], last_i[on], last_j[on]
        return out

    def let(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same by a table of pairs met before, each at the place of its hash."""
        keys = a.astype(np.int64) * self.many + b
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KEEP_BITS)).astype(np.int64)
        out = self.fits[slots]
        missed = np.flatnonzero(self.held[slots] != keys)
        if len(missed):
            fresh, back = np.unique(keys[missed], return_inverse=True)
            found = self.follows(fresh // self.many, fresh % self.many)
            out[missed] = found[back]
            # Of keys with one place the same one must lie in both arrays.
            places, first = np.unique(slots[missed], return_index=True)
            self.held[places], self.fits[places] = keys[missed][first], out[missed][first]
        return out

    def compose(self, stretches: list[str]):
        """(stretch, place from the end, id) of all paths' pieces, and the stretches without just one arc left at a place."""
        sizes = np.array([len(t) for t in stretches])
        tails = np.cumsum(sizes)
        heads = tails - sizes
        letters = self.number[np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)]
        head, tail = np.repeat(heads, sizes), np.repeat(tails, sizes)
        at, node, depth, arcs = np.arange(len(letters)), np.zeros(len(letters), np.int32), 0, []
        while len(at):
            step = self.base[node] + letters[at + depth]
            fits = self.owner[step] == (node if depth else 0)
            at, node, depth = at[fits], step[fits], depth + 1
            whole = self.piece[node] >= 0
            arcs.append((at[whole], self.piece[node[whole]]))
            more = at + depth < tail[at]
            at, node = at[more], node[more]
        start, ids = (np.concatenate(x) for x in zip(*arcs))
        away = start + self.size[ids] - head[start]
        order = np.argsort(away.astype(np.int16), kind="stable")
        start, ids, ends = start[order], ids[order], np.concatenate([[0], np.cumsum(np.bincount(away))])
        # The id of the one arc that is left at each place, by its last character.
        left, winner, double = np.full(len(letters), -1, np.int32), np.zeros(len(letters), np.int64), []
        for k in range(1, len(ends) - 1):
            s, piece = start[ends[k] : ends[k + 1]], ids[ends[k] : ends[k + 1]]
            fits = s == head[s]
            asked = np.flatnonzero(~fits & (left[s - 1] >= 0))
            fits[asked] = self.let(left[s[asked] - 1], piece[asked])
            s, piece = s[fits], piece[fits]
            last = s + self.size[piece] - 1
            left[last], winner[last] = piece, np.arange(len(s))
            double.append(last[winner[last] != np.arange(len(s))])
        failed = left[tails - 1] < 0
        failed[np.searchsorted(tails, np.concatenate([np.empty(0, np.int64), *double]), side="right")] = True
        owner, rank, path = [], [], []
        now, turn = np.flatnonzero(~failed), 0
        place = tails[now] - 1
        while len(now):
            piece = left[place]
            owner.append(now), rank.append(np.full(len(now), turn)), path.append(piece)
            place = place - self.size[piece]
            more = place >= heads[now]
            now, place, turn = now[more], place[more], turn + 1
        none = [np.empty(0, np.int64)]
        return np.concatenate(owner or none), np.concatenate(rank or none), np.concatenate(path or none), np.flatnonzero(failed)


class Transducer:
    """One compiled model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(fields(f.read()))
        pieces = [{1: b"", 2: 0.0, 3: NORMAL} | dict(fields(v)) for k, v in message if k == 1]
        trainer = dict(fields(next((v for k, v in message if k == 2), b"")))
        normal = dict(fields(next((v for k, v in message if k == 3), b"")))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, MERGES) or not trainer.get(35, 0) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError(f"{path}: only unigram or merging models with byte fallback, escaped blanks and an identity normaliser are compiled")
        self.prefix = bool(normal.get(3, 1))
        self.text = [p[1].decode() for p in pieces]
        self.ids = {t: i for i, t in enumerate(self.text) if pieces[i][3] in (NORMAL, USER)}
        self.score = {t: pieces[i][2] for t, i in self.ids.items()}
        self.byte = {int(self.text[i][3:5], 16): i for i, p in enumerate(pieces) if p[3] == BYTE}
        self.raw = {i: b for b, i in self.byte.items()}
        self.hidden = {i for i, p in enumerate(pieces) if p[3] in (CONTROL, UNKNOWN)}
        chars = {c for t in self.ids for c in t}
        self.known = frozenset(c for c in chars if c in self.ids or self.kind == UNIGRAM)
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError(f"{path}: a piece has the mark after another character")
        inside = "".join(re.escape(c) for c in sorted(self.known - {MARK}))
        self.cut = re.compile(f"{MARK}+[{inside}]*|[{inside}]+|[^{inside}{MARK}]+")
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        if self.kind == MERGES:  # a piece that merging its own characters does not give can never come out
            self.score = {t: w for t, w in self.score.items() if len(t) == 1 or set(t) == {MARK} or self.merged(t) == [t]}
        self.tree: dict = {}
        for piece in self.score:
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = self.ids[piece]
        self.touching = {t[i : i + 2] for t in self.score for i in range(len(t) - 1)}
        self.tables = Tables(self) if self.kind == MERGES else None
        self.spelled = [bytes([self.raw[i]]) if i in self.raw else b"" if i in self.hidden else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        self.spelled_bytes = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.spelled_ends = np.concatenate([[0], np.cumsum([len(b) for b in self.spelled])])
        self.is_byte = np.array([i in self.raw for i in range(len(self.text))])
        self.kinds = np.zeros(0x110000, np.uint8)
        self.kinds[[ord(c) for c in self.known]] = 1
        self.kinds[ord(MARK)] = 2

    def merging(self, text: str):
        """Rows of pieces while the best-scored neighbours, the leftmost of equals, are merged until none is a piece."""
        row = list(text)
        yield list(row)
        while len(row) > 1:
            options = [(-self.score[p], i) for i in range(len(row) - 1) if (p := row[i] + row[i + 1]) in self.score]
            if not options:
                return
            i = min(options)[1]
            row[i : i + 2] = [row[i] + row[i + 1]]
            yield list(row)

    def merged(self, text: str) -> list[str]:
        """The last row of ``merging``, with a queue of the merges at hand in place of the rows: n log n steps, n places held."""
        part: list[str | None] = list(text)
        size, score = len(part), self.score
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        # A merge's places and its piece say whether it is still at hand.
        queue = [(-score[p], i, i + 1, p) for i in range(size - 1) if (p := part[i] + part[i + 1]) in score]
        heapify(queue)
        while queue:
            _, i, j, piece = heappop(queue)
            if part[i] is None or after[i] != j or part[i] + part[j] != piece:
                continue
            part[i], part[j] = piece, None
            after[i] = end = after[j]
            if end < size:
                before[end] = i
                if (p := piece + part[end]) in score:
                    heappush(queue, (-score[p], i, end, p))
            if (start := before[i]) >= 0 and (p := part[start] + piece) in score:
                heappush(queue, (-score[p], start, i, p))
        return [p for p in part if p is not None]

    def edge(self, piece: int, side: int) -> list[tuple[str, float]]:
        """What stands at the left (0) or right (1) end of a piece while it is merged, from one character up, with its cost."""
        found = self.edges[side].get(piece)
        if found is None:
            grown = dict.fromkeys(row[0 if side == 0 else -1] for row in self.merging(self.text[piece]))
            found = self.edges[side][piece] = [(p, -self.score.get(p, 0.0)) for p in grown]
        return found

    def follows(self, a: int, b: int) -> bool:
        """The filter: whether merging leaves the border between two pieces alone.

        Merges happen cheapest first, the leftmost of equals. At the border compete the growth of the left side, that of the
        right side and the merge across; the last must never be first.
        """
        left, right, i, j = self.edge(a, 1), self.edge(b, 0), 0, 0
        while True:
            across = self.score.get(left[i][0] + right[j][0])
            grow_left = left[i + 1][1] if i + 1 < len(left) else NEVER
            grow_right = right[j + 1][1] if j + 1 < len(right) else NEVER
            if across is not None and -across < grow_left and -across <= grow_right:
                found = False
                break
            if grow_left == grow_right == NEVER:
                found = True
                break
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1
        if len(self.pairs) >= KEEP:
            self.pairs.clear()
        self.pairs[a * len(self.text) + b] = found
        return found

    def arcs(self, text: str, start: int) -> list[tuple[int, int]]:
        """(end, id) of the pieces that begin at a place, the shortest first: one walk down the lexicon's tree."""
        out, node = [], self.tree
        for end in range(start, len(text)):
            node = node.get(text[end])
            if node is None:
                break
            piece = node.get("")
            if piece is not None:
                out.append((end + 1, piece))
        return out

    def only_path(self, text: str) -> list[int]:
        """The one path that the filter leaves, found depth first, long pieces first; a dead state is not entered twice."""
        size, pairs, many = len(text), self.pairs, len(self.text)
        path: list[int] = []
        left = [self.arcs(text, 0)]
        entered: set[tuple[int, int]] = set()
        while left:
            options = left[-1]
            if not options:
                left.pop()
                if path:
                    path.pop()
                continue
            state = options.pop()
            end, piece = state
            if path:
                fits = pairs.get(path[-1] * many + piece)
                if fits is None:
                    fits = self.follows(path[-1], piece)
                if not fits:
                    continue
            if end == size:
                path.append(piece)
                return path
            if state in entered:
                continue
            entered.add(state)
            path.append(piece)
            left.append(self.arcs(text, end))
        raise ValueError(f"no path for {text!r}")

    def cheapest_path(self, text: str) -> list[int]:
        """Forward sweep in the tropical semiring, one state per place, the earliest found among equals."""
        states: list[tuple[float, int, int] | None] = [(0.0, -1, -1)] + [None] * len(text)
        for start in range(len(text)):
            if states[start] is not None:
                for end, piece in self.arcs(text, start):
                    cost = states[start][0] - self.score[self.text[piece]]
                    if states[end] is None or cost < states[end][0]:
                        states[end] = (cost, start, piece)
        place, path = len(text), []
        while place:
            _, place, piece = states[place]
            path.append(piece)
        return path[::-1]

    def shortest(self, text: str) -> list[int]:
        if self.kind == UNIGRAM:
            return self.cheapest_path(text)
        if text.startswith(MARK * 2):
            # Pieces of marks alone share one score; the order of their merges is by place, which no pair shows.
            return [self.ids[p] for p in self.merged(text)]
        if text in self.score:  # the longest arc of the first state reaches the end
            return [self.ids[text]]
        return self.only_path(text)

    def solve(self, text: str) -> list[int]:
        """Ids of one stretch, or of any longer part, by itself."""
        out: list[int] = []
        for part in self.cut.findall(text):
            if part[0] not in self.known and part[0] != MARK:
                out += [self.byte[b] for b in part.encode("utf-8", "replace")]
                continue
            # No path crosses two neighbours that no piece holds.
            joined = list(map(self.touching.__contains__, map(add, part, part[1:])))
            cuts = [] if all(joined) else [i + 1 for i, together in enumerate(joined) if not together]
            for at, end in zip([0, *cuts], [*cuts, len(part)]):
                out += self.shortest(part[at:end])
        return out

    def solve_all(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different stretches, one after the other, and where each begins and the last ends."""
        alone = self.tables is None
        apart = np.array([alone or len(t) > LONG or t.startswith(MARK * 2) or (t[0] not in self.known and t[0] != MARK) for t in stretches], bool)
        left = np.flatnonzero(apart).tolist()
        counts = np.zeros(len(stretches), np.int64)
        if not apart.all():
            together = np.flatnonzero(~apart)
            owner, rank, ids, failed = self.tables.compose([stretches[i] for i in together])
            left += together[failed].tolist()
            owner = together[owner]
            counts += np.bincount(owner, minlength=len(stretches))
        found = {i: self.solve(stretches[i]) for i in left}
        for i, path in found.items():
            counts[i] = len(path)
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(ends[-1], np.int32)
        if not apart.all():
            flat[ends[owner + 1] - 1 - rank] = ids
        for i, path in found.items():
            flat[ends[i] : ends[i + 1]] = path
        return flat, ends

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's parts, and how many each has; equal stretches are solved once."""
        joined = "".join(parts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[codes]
        begins = np.concatenate([[0], np.cumsum([len(t) for t in parts])])
        new = np.ones(len(codes), bool)
        new[1:] = (kinds[1:] != kinds[:-1]) & ~((kinds[1:] == 1) & (kinds[:-1] == 2))
        new[begins[:-1]] = True
        starts = np.flatnonzero(new)
        sizes = 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
        sizes[(codes >= 0xD800) & (codes < 0xE000)] = 1
        places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)[np.append(starts, len(codes))]
        same = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(joined.encode("utf-8", "replace"))).dictionary_encode()
        flat, ends = self.solve_all(same.dictionary.to_pylist())
        which = same.indices.to_numpy()
        counts = np.diff(ends)[which]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = flat[np.repeat(ends[which] - upto[:-1], counts) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(starts, begins)])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each begins and the last ends; long texts are cut before a blank."""
        ids, counts = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64)
        owners: list[int] = []
        parts: list[str] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if parts:
                found, sizes = self.encode_parts(parts)
                ids.append(found)
                np.add.at(counts, owners, sizes)
            owners.clear(), parts.clear()
            held = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            text, at = (MARK if self.prefix else "") + text.replace(" ", MARK), 0
            while at < len(text):
                border = BORDER.search(text, at + SLICE) if len(text) - at > SLICE else None
                end = border.end() if border else len(text)
                if held and held + end - at > SLICE:
                    flush()
                owners.append(i), parts.append(text[at:end])
                held, at = held + end - at, end
        flush()
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)])

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def gives_back(self, ids: np.ndarray, ends: np.ndarray, texts: list[str | None]) -> list[bool | None]:
        """Whether decoding gives each text back; null for null. Spelled bytes that are those of the text need no decoding."""
        out: list[bool | None] = []
        for i, text in enumerate(texts):
            own = ids[ends[i] : ends[i + 1]]
            sizes = self.spelled_ends[own + 1] - self.spelled_ends[own]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            spelled = self.spelled_bytes[np.repeat(self.spelled_ends[own] - upto[:-1], sizes) + np.arange(upto[-1])].tobytes()
            same = bool(text) and spelled == ((" " if self.prefix else "") + text).encode("utf-8", "replace")
            out.append(None if text is None else same or self.decode(own.tolist()) == text)
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def compiled(path: str) -> Transducer:
    loaded = held("pieces", dict)
    if path not in loaded:
        loaded.clear()
        loaded[path] = Transducer(path)
    return loaded[path]


def encoded(text: Column, path: str | None = None) -> Column:
    """Struct of ids, how many of them are bytes, and whether decoding gives the text back."""
    path = path or default_model()

    @F.arrow_udf(SCHEMA)
    def of(texts: pa.Array) -> pa.Array:
        return in_portions(compiled(path), texts)

    return of(text)


def in_portions(model: Transducer, texts: pa.Array) -> pa.Array:
    """``SCHEMA`` of every text, a portion of the rows at a time, however many rows the session puts into a batch."""

    def portion(rows: list[str | None]) -> pa.Array:
        values, ends = model.encode_all([t or "" for t in rows])
        exact = model.gives_back(values, ends, rows)
        upto = np.concatenate([[0], np.cumsum(model.is_byte[values])])[ends]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        null = pa.array([x is None for x in exact], pa.bool_())
        return pa.StructArray.from_arrays([lists, pa.array(np.diff(upto), pa.int64()), pa.array(exact, pa.bool_())], ["ids", "n_bytes", "exact"], mask=null)

    parts = [portion(texts[at : at + ROWS].to_pylist()) for at in range(0, max(1, len(texts)), ROWS)]
    whole = pa.concat_arrays(parts)
    parts.clear()
    handed_back()
    return whole


def decoded(ids: Column, path: str | None = None) -> Column:
    """Text of an array of ids; null stays null."""
    path = path or default_model()

    @F.arrow_udf("string")
    def of(rows: pa.Array) -> pa.Array:
        model = compiled(path)
        return pa.array([None if r.as_py() is None else model.decode(r.as_py()) for r in rows], pa.string())

    return of(ids)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_ids, n_bytes and exact for every document; all but the id are null for null text."""
    rows = doc_rows(docs).select("doc_id", encoded(F.col("text"), path).alias("e")).select("doc_id", "e.*")
    return rows.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_ids"), "n_bytes", "exact").withColumn("n_ids", F.when(F.col("ids").isNotNull(), F.col("n_ids")))
