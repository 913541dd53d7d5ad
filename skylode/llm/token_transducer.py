"""Token counts by a compiled finite-state transducer.

A pair-merging tokenizer is compiled, lazily, into a deterministic transducer:
reading a character moves between states and emits the change in the number of
tokens. The last token of a prefix is the only token that ends there and is
compatible with the last token before it (two tokens are compatible if encoding
their concatenation gives the two again), so a state needs only

* the longest suffix read that begins some token,
* the last token at each position of that suffix, and
* the token counts there, relative to the end.

Where two adjacent characters stand together in no token, every state goes to
one and the same state: there the text's history ends. Texts are cut into
chunks that all advance together. The state map of a chunk with such a place is
constant from there on. Of a chunk without one the map is made over the states
that can enter it, those that the chunk before leads to; maps that are closed in
this way compose by a parallel prefix scan (``_compose``).
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylode.llm.common import column, text_slices, texts_of

#: Transitions are compiled as texts need them; beyond this many states the
#: table is dropped and starts anew, which bounds memory and changes no result.
MAX_STATES = 150_000
#: Characters in a chunk, and in one scan; a longer text carries its state from scan to scan.
CHUNK, SCAN = 256, 1 << 20
#: Times that maps of chunks are widened by states of the chunk before. What isn't closed by
#: then is walked chunk after chunk.
ROUNDS = 12

_UNKNOWN, _NEVER = "\0", ""
#: Up to so many longer pieces, states are merged by which of them can follow.
NARROW = 16


class Transducer:
    """The compiled tokenizer: pieces with scores, byte fallback, a leading space mark."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, train = proto.normalizer_spec, proto.trainer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (spec.add_dummy_prefix and spec.escape_whitespaces) or not train.byte_fallback or train.model_type != 2 or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a space mark in front")
        if any(p.type not in (1, 2, 3, 6) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        # Merge order: higher score first, then the leftmost.
        self.score = {p.piece: -p.score for p in proto.pieces if p.type == 1}
        # The longer pieces that begin with a string, for each string with any.
        self.longer: dict[str, list[str]] = defaultdict(list)
        together = set()
        for piece in self.score:
            for i in range(1, len(piece)):
                self.longer[piece[:i]].append(piece)
            together.update(zip(piece, piece[1:]))
        self.longest = max(map(len, self.score))
        # A class for each character that pieces hold; the others by their bytes.
        chars = sorted({c for piece in self.score for c in piece})
        self.class_of = np.zeros(0x110000, np.int16)
        sizes = np.searchsorted([0x80, 0x800, 0x10000], np.arange(0x110000), side="right") + 1
        self.class_of[:] = sizes - 1
        self.chars = [*([_UNKNOWN] * 4), *chars]
        codes = np.array([ord(c) for c in chars])
        self.class_of[codes] = np.arange(4, len(self.chars))
        self.class_of[ord(" ")] = self.class_of[ord("\u2581")]
        self.mark = int(self.class_of[ord(" ")])
        number = {c: i for i, c in enumerate(self.chars) if i >= 4}
        self.previous = 0
        # Single characters that are no piece of their own count as their bytes.
        self.alone = np.array([1, 2, 3, 4, *(1 if c in self.score else len(c.encode()) for c in chars)], np.int32)
        self.joined = np.zeros((len(self.chars), len(self.chars)), bool)
        for a, b in together:
            self.joined[number[a], number[b]] = True
        self.same: dict[tuple, str] = {}
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self._relevant = functools.lru_cache(maxsize=500_000)(lambda last, read: self._narrow(last, read) if read else last)
        self._compatible = functools.lru_cache(maxsize=500_000)(self._check)
        self.clear()

    def clear(self) -> None:
        # A column for each class that has followed a class, numbered for each of those alone.
        self.columns = np.full((len(self.chars), len(self.chars)), -1, np.int16)
        self.followers = np.zeros(len(self.chars), np.int16)
        self.states: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.next = np.full((1024, 64), -1, np.int32)
        self.emit = np.zeros((1024, 64), np.int8)
        self.first = np.array([self._state(self._fresh(c)) for c in range(len(self.chars))], np.int32)

    def _fresh(self, c: int) -> tuple:
        """The state after character class c, where no token reaches over from before."""
        char = self.chars[c]
        if c < 4:
            return ("", (None,), (0,))
        last = char if char in self.score else None
        return (char, (None, last), (-int(self.alone[c]), 0))

    def _state(self, key: tuple) -> int:
        number = self.known.get(key)
        if number is None:
            number = self.known[key] = len(self.states)
            self.states.append(key)
            if number == len(self.next):
                self.next = np.concatenate((self.next, np.full_like(self.next, -1)))
                self.emit = np.concatenate((self.emit, np.zeros_like(self.emit)))
        return number

    def encode(self, text: str) -> list[str]:
        """Plain merging of one string of known characters, for compatibility and tests."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(s, i, a + b) for i, (a, b) in enumerate(zip(text, text[1:])) if (s := self.score.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != len(whole):
                continue
            parts[i], parts[j] = whole, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := self.score.get(whole + parts[k])) is not None:
                    heapq.heappush(heap, (s, i, whole + parts[k]))
            h = before[i]
            if h >= 0 and (s := self.score.get(parts[h] + whole)) is not None:
                heapq.heappush(heap, (s, h, parts[h] + whole))
        return [p for p in parts if p is not None]

    def _parts(self, piece: str) -> tuple[str, str] | None:
        """What a piece is merged from in the end; None for a single character."""
        if len(piece) == 1:
            return None
        if piece not in self.parts:
            # Merging stops short of the piece itself.
            own = self.score.pop(piece)
            try:
                left = self.encode(piece)
            finally:
                self.score[piece] = own
            self.parts[piece] = (left[0], left[1]) if len(left) == 2 else None
        return self.parts[piece]

    def _spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """A piece, its last (side 1) or first part, that one's, and so on to a character,
        each with the rank of the merge that makes it."""
        known = self.spines[side].get(piece)
        if known is None:
            known, at = [], piece
            while (parts := self._parts(at)) is not None:
                known.append((at, self.score[at]))
                at = parts[side]
            known.append((at, -math.inf))
            self.spines[side][piece] = known
        return known

    def _check(self, left: str, right: str) -> bool:
        """Whether encoding the two together gives the two again.

        Merges inside them go on until one across their border comes first: what ends
        the left and what begins the right are undone, latest merge first, and what meets
        across must not be a merge that was due before.
        """
        if not left:  # _NEVER
            return False
        lefts, rights, find = self._spine(left, 1), self._spine(right, 0), self.score.get
        i, j, last_i, last_j = 0, 0, len(lefts) - 1, len(rights) - 1
        limit, strict = math.inf, True
        while True:
            a, rank_a = lefts[i]
            b, rank_b = rights[j]
            across = find(a + b)
            if across is not None and (across < limit or (across == limit and not strict)):
                return False
            if rank_a > rank_b:
                # The left merge at an equal rank comes before one further right.
                limit, strict, i = rank_a, True, i + 1
            elif j < last_j:
                limit, strict, j = rank_b, False, j + 1
            elif i < last_i:
                limit, strict, i = rank_a, True, i + 1
            else:
                return True

    def _step(self, state: int, c: int) -> tuple[int, int]:
        """(next state, change in the number of tokens); c is joined to what was read."""
        suffix, lasts, counts = self.states[state]
        text = suffix + self.chars[c]
        n = len(text)
        token, count = None, counts[-1] + int(self.alone[c])
        for k in range(max(0, n - self.longest), n):
            piece = text[k:]
            if piece in self.score and lasts[k] is not _NEVER and (lasts[k] is None or self._compatible(lasts[k], piece)):
                token, count = piece, counts[k] + 1
                break
        lasts, counts = (*lasts, token), (*counts, count)
        k = next(k for k in range(n + 1) if k == n or text[k:] in self.longer)
        kept = [self._relevant(x, text[k + i :]) for i, x in enumerate(lasts[k:])]
        counts = tuple(0 if x is _NEVER else y - count for x, y in zip(kept, counts[k:]))
        return self._state((text[k:], tuple(kept), counts)), count

    def _narrow(self, last: str | None, read: str) -> str | None:
        """What of ``last`` matters before ``read``: _NEVER if no longer piece can
        begin there, None if all can, else a token that excludes the same ones."""
        longer = self.longer.get(read, ())
        if len(longer) > NARROW:
            return last
        barred = tuple(p for p in longer if last is not None and not self._compatible(last, p))
        if len(barred) == len(longer):
            return _NEVER
        return self.same.setdefault((read, barred), last) if barred else None

    def _columns(self, classes: np.ndarray, cut: np.ndarray, carried: bool = False) -> np.ndarray:
        """Each character's column in the table; 0 where the history ends."""
        inner = np.flatnonzero(~cut)
        before, now = classes[inner - 1], classes[inner]
        if carried and len(inner) and inner[0] == 0:
            before[0] = self.previous
        unmet = self.columns[before, now] < 0
        for a, b in {*zip(before[unmet].tolist(), now[unmet].tolist())}:
            self.columns[a, b] = col = self.followers[a]
            self.followers[a] += 1
            if col == self.next.shape[1]:
                self.next = np.concatenate((self.next, np.full_like(self.next, -1)), axis=1)
                self.emit = np.concatenate((self.emit, np.zeros_like(self.emit)), axis=1)
        out = np.zeros(len(classes), np.int16)
        out[inner] = self.columns[before, now]
        return out

    def _advance(self, states: np.ndarray, classes: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = self.next[states, cols]
        for i in np.flatnonzero(new < 0).tolist():
            s, c, col = int(states[i]), int(classes[i]), int(cols[i])
            if self.next[s, col] < 0:
                to, count = self._step(s, c)
                self.next[s, col], self.emit[s, col] = to, count
            new[i] = self.next[s, col]
        return new, self.emit[states, cols]

    def _scan(self, classes: np.ndarray, cut: np.ndarray, entry: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(tokens emitted at each character, tokens emitted in chunks as a whole, exit state).

        cut: where the history ends; ``entry`` is the state before the first character
        unless it ends there. A chunk's state map is a partial function up to its first
        cut and constant from there on. Pass one runs every chunk from its first cut to
        its end, all chunks together; pass two runs what comes before the first cuts, from
        the exit of the chunk before. Chunks without a cut get their entry by composition.
        """
        n = len(classes)
        chunks = -(-n // CHUNK)
        emitted, whole = np.zeros(chunks * CHUNK, np.int8), np.zeros(chunks, np.int64)
        pad = chunks * CHUNK - n
        cls = np.concatenate((classes, np.zeros(pad, classes.dtype))).reshape(chunks, CHUNK).T.copy()
        cuts = np.concatenate((cut, np.ones(pad, bool))).reshape(chunks, CHUNK).T.copy()
        if pad:
            cuts[-pad:, -1] = False  # padding changes no state
        cols = np.concatenate((self._columns(classes, cut, entry is not None), np.zeros(pad, np.int16))).reshape(chunks, CHUNK).T.copy()
        out = emitted.reshape(chunks, CHUNK).T
        size = np.full(chunks, CHUNK)
        size[-1] -= pad
        has = cuts.any(axis=0)
        begin = np.where(has, cuts.argmax(axis=0), size)
        state = np.zeros(chunks, np.int32)

        def walk(t: int, lanes: np.ndarray) -> None:
            lanes = lanes[size[lanes] > t]
            fresh = lanes[cuts[t, lanes]]
            state[fresh] = self.first[cls[t, fresh]]
            out[t, fresh] = self.alone[cls[t, fresh]]
            going = lanes[~cuts[t, lanes]]
            if len(going):
                state[going], out[t, going] = self._advance(state[going], cls[t, going], cols[t, going])

        order = np.argsort(begin, kind="stable")
        started = np.searchsorted(begin[order], np.arange(CHUNK), side="right")
        for t in range(CHUNK):
            if started[t]:
                walk(t, order[: started[t]])
        # One place to the right: the exit of the chunk before, if that is known.
        exits = np.concatenate(([0 if entry is None else entry], state)).astype(np.int32)
        known = np.concatenate(([True], has))
        for lanes in (np.flatnonzero((begin > 0) & known[:-1]), None):
            if lanes is None:
                deep = np.flatnonzero(~has & ~known[:-1])
                if len(deep):
                    self._compose(deep, cls, cols, size, exits, whole)
                lanes = np.flatnonzero(has & (begin > 0) & ~known[:-1])
            state[lanes] = exits[lanes]
            for t in range(int(begin[lanes].max(initial=0))):
                walk(t, lanes[begin[lanes] > t])
            full = lanes[~has[lanes]]
            exits[full + 1] = state[full]
        return emitted[:n], whole, int(exits[-1])

    def _walked(self, chunk: np.ndarray, states: np.ndarray, cls: np.ndarray, cols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exit states, tokens emitted) of whole chunks, each from a state."""
        states, totals = states.copy(), np.zeros(len(chunk), np.int64)
        for t in range(int(size[chunk].max(initial=0))):
            on = np.flatnonzero(size[chunk] > t)
            at = chunk[on]
            states[on], emitted = self._advance(states[on], cls[t, at], cols[t, at])
            totals[on] += emitted
        return states, totals

    def _compose(self, deep: np.ndarray, cls: np.ndarray, cols: np.ndarray, size: np.ndarray, exits: np.ndarray, whole: np.ndarray) -> None:
        """Exits and totals of chunks without a cut that follow others without one.

        Lanes are (text of a chunk, state that enters it). A first guess of what enters is
        what the chunk before leads to from a fresh start; then every chunk takes in what
        the lanes of the chunk before lead to, until all maps are closed. A lane's successor
        is the lane that its exit enters next; successors of successors reach 2, 4, 8 ...
        chunks on, so all states that truly enter are found in logarithmically many steps.
        """
        text = {}
        kind = np.array([text.setdefault((cls[:, i].tobytes(), cols[:, i].tobytes(), int(size[i])), i) for i in deep.tolist()])
        runs_on = np.concatenate(([False], deep[1:] == deep[:-1] + 1))  # follows another deep chunk
        lanes: dict[tuple[int, int], int] = {}
        result: list[tuple[int, int]] = []

        def add(wanted: set[tuple[int, int]]) -> None:
            new = sorted(wanted - lanes.keys())
            if new:
                chunk, state = (np.array(x) for x in zip(*new))
                for key, to, total in zip(new, *(x.tolist() for x in self._walked(chunk, state.astype(np.int32), cls, cols, size))):
                    lanes[key] = len(result)
                    result.append((to, total))

        # The guess: fresh at the first character of the chunk before.
        inner = np.flatnonzero(runs_on)
        before = np.unique(kind[inner - 1])
        guess = dict(zip(before.tolist(), self._fresh_exits(before, cls, cols, size).tolist()))
        true = [(int(k), int(exits[i])) for k, i, r in zip(kind, deep, runs_on) if not r]
        add({*true, *((int(kind[j]), guess[int(kind[j - 1])]) for j in inner.tolist())})
        follows = {(int(kind[j - 1]), int(kind[j])) for j in inner.tolist()}
        after: dict[int, list[int]] = defaultdict(list)
        for a, b in follows:
            after[a].append(b)
        fresh = set(lanes)
        for _ in range(ROUNDS):
            wanted = {(b, result[lanes[a, s]][0]) for a, s in fresh for b in after[a]}
            fresh = wanted - lanes.keys()
            if not fresh:
                break
            add(fresh)
        if fresh:
            self._one_by_one(deep, kind, runs_on, lanes, result, cls, cols, size, exits, whole)
            return
        # Each chunk's lanes by number: place in ``deep`` times lanes a chunk, states by rank.
        of_kind: dict[int, list[int]] = defaultdict(list)
        for k, s in lanes:
            of_kind[k].append(s)
        rank = {(k, s): i for k, own in of_kind.items() for i, s in enumerate(own)}
        counts = np.array([len(of_kind[int(k)]) for k in kind])
        first = np.cumsum(counts) - counts
        succ = np.full(int(counts.sum()), -1)
        for (a, b) in follows:
            move = np.array([rank[b, result[lanes[a, s]][0]] for s in of_kind[a]])
            at = inner[(kind[inner - 1] == a) & (kind[inner] == b)]
            succ[first[at - 1][:, None] + np.arange(len(move))] = first[at][:, None] + move
        entered = np.zeros(len(succ), bool)
        entered[[first[j] + rank[key] for j, key in zip(np.flatnonzero(~runs_on).tolist(), true)]] = True
        while (succ >= 0).any():
            on = np.flatnonzero(entered & (succ >= 0))
            entered[succ[on]] = True
            succ = np.where(succ >= 0, succ[succ], -1)
        at = np.flatnonzero(entered)
        place = np.searchsorted(first, at, side="right") - 1
        for j, i in zip(place.tolist(), (at - first[place]).tolist()):
            k = int(kind[j])
            exits[deep[j] + 1], whole[deep[j]] = result[lanes[k, of_kind[k][i]]]

    def _fresh_exits(self, chunk: np.ndarray, cls: np.ndarray, cols: np.ndarray, size: np.ndarray) -> np.ndarray:
        states = self.first[cls[0, chunk]].astype(np.int32)
        for t in range(1, int(size[chunk].max(initial=0))):
            on = np.flatnonzero(size[chunk] > t)
            states[on], _ = self._advance(states[on], cls[t, chunk[on]], cols[t, chunk[on]])
        return states

    def _one_by_one(self, deep, kind, runs_on, lanes, result, cls, cols, size, exits, whole) -> None:
        """The same without closed maps, chunk after chunk; lanes that are known are used."""
        for j, i in enumerate(deep.tolist()):
            key = (int(kind[j]), int(exits[i]))
            if key not in lanes:
                state, total = key[1], 0
                for c, col in zip(cls[: size[i], i].tolist(), cols[: size[i], i].tolist()):
                    to = int(self.next[state, col])
                    if to < 0:
                        to, count = self._step(state, c)
                        self.next[state, col], self.emit[state, col] = to, count
                    total += int(self.emit[state, col])
                    state = to
                lanes[key] = len(result)
                result.append((state, total))
            exits[i + 1], whole[i] = result[lanes[key]]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, as the library counts them."""
        counts = np.zeros(len(texts), np.int64)
        some, size = [], 0
        for i, text in enumerate(texts):
            if len(text) > SCAN:
                counts[i] = self._count_long(text)
            elif text:
                if size + len(text) > 2 * SCAN:
                    counts[some] = self._count_some([texts[j] for j in some])
                    some, size = [], 0
                some.append(i)
                size += len(text)
        if some:
            counts[some] = self._count_some([texts[j] for j in some])
        return counts

    def _bounded(self, state: int | None = None) -> int | None:
        """Starts a table anew that has grown too large; the number of ``state`` in it."""
        if len(self.states) <= MAX_STATES:
            return state
        key = None if state is None else self.states[state]
        self.clear()
        return None if key is None else self._state(key)

    def _count_some(self, texts: list[str]) -> np.ndarray:
        self._bounded()
        # A space mark stands before each text, and no token reaches over to the next text.
        codes = np.frombuffer((" " + " ".join(texts)).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) + 1 for t in texts])
        starts = np.cumsum(lengths) - lengths
        classes = self.class_of[codes]
        cut = np.ones(len(classes), bool)
        cut[1:] = ~self.joined[classes[:-1], classes[1:]]
        cut[starts] = True
        emitted, whole, _ = self._scan(classes, cut)
        counts = np.add.reduceat(emitted.astype(np.int64), starts)
        chunks = np.flatnonzero(whole)
        np.add.at(counts, np.searchsorted(starts, chunks * CHUNK, side="right") - 1, whole[chunks])
        return counts

    def _count_long(self, text: str) -> int:
        """A long text scan by scan, each from the exit state of the one before."""
        total, state, last = 0, None, None
        for at in range(0, len(text), SCAN):
            state = self._bounded(state)
            part = text[at : at + SCAN] if at else " " + text[:SCAN]
            classes = self.class_of[np.frombuffer(part.encode("utf-32-le"), np.uint32)]
            cut = np.ones(len(classes), bool)
            cut[1:] = ~self.joined[classes[:-1], classes[1:]]
            if last is not None:
                cut[0] = not self.joined[last, classes[0]]
            self.previous = last
            emitted, whole, state = self._scan(classes, cut, state)
            total += int(emitted.sum(dtype=np.int64)) + int(whole.sum())
            last = classes[-1]
        return total


@functools.lru_cache(maxsize=2)
def _transducer(model: bytes) -> Transducer:
    return Transducer(model)


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes`` (UTF-8), ``n_tokens, over_limit`` (more than ``limit`` tokens).

    Whole texts are counted, without begin, end or other special tokens; long ones
    scan by scan. A null or empty text has no bytes and no tokens. Rows are
    independent: repeated rows give repeated results, null ids are passed on, no rows
    give none, other columns of ``df`` are not read.
    """
    with open(model_path, "rb") as file:
        model = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _transducer(model.value)
        for part in text_slices(batches):
            tokens = machine.count(texts_of(part))
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "n_bytes"), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
