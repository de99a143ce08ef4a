"""Token counts by a compiled finite-state tokenizer (operator 3).

The tokenizer is byte-level BPE behind a splitter. Both are run as finite-state machines:

* *Splitter.* Whether a piece starts at a character depends on the classes (letter, digit, space, other white space, other)
  of few neighbours; numpy evaluates that for all characters of a batch at once.
* *BPE transducer.* A BPE encoding is the one sequence of tokens in which every pair of neighbours is itself an encoding.
  So the last token of a prefix of a piece is the one token that ends there and whose left neighbour, the last token of what
  is before it, agrees with it. A state holds the longest suffix that may still grow into a token, with the last token and
  the token count at each of its places; reading a byte leads to one next state and emits the change of the count. States
  are compiled when they are first reached and kept in a table of bounded size.
* *Chunks.* Every text is cut into chunks. A state is the splitter's and the transducer's; a chunk's state map gives, for the
  state it is entered in, the state it is left in and the tokens emitted. Behind the first character that starts a piece in
  every state, all entries agree, so only the few characters before it are run once more for the one entry state that occurs.
  Maps compose in any bracketing, and a text's count is their pairwise scan, so chunks need not know what is before them. A
  text within one chunk is the case of one map, whose entry is the start.

Special tokens' strings inside texts are that one token each, as the library does by default.

Defined results: a null text counts as empty (no bytes, no tokens); repeated rows are counted one by one; very long texts are
counted whole, chunk by chunk; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import free_names, mix, numbered, slices, span_hash

LETTER, DIGIT, SPACE, WHITE, OTHER = range(5)
#: Further states of the splitter: before a piece, in white space, behind an apostrophe that starts a piece.
BEGIN, BLANK, QUOTE = 5, 6, 7
#: Characters with the White_Space property, and the splitter's contractions.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
PAIRS = {w[0]: w[1] for w in CONTRACTIONS if len(w) == 2}
#: The state before a text: no piece is open, nothing waits, and the transducer has read nothing.
START = (BEGIN, "", (b"", (), ()))
MOST_STATES = 400_000
MOST_PIECES = 1_000_000
CHUNK = 1 << 14


def classes() -> np.ndarray:
    """Class of every code point."""
    kind = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kind[c] = LETTER
        elif k == "N":
            kind[c] = DIGIT
    kind[list(WHITE_SPACE)] = WHITE
    kind[32] = SPACE
    return kind


def piece_starts(cp: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each character; ``begins`` marks the first characters of texts."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    c = kind[cp]
    white = (c == SPACE) | (c == WHITE)
    group = np.where(white, SPACE, c)
    before = np.r_[OTHER + 1, group[:-1]]
    change = begins | (group != before)
    ends = np.r_[begins[1:], True]  # last characters of texts
    last_white = white & ~ends & ~np.r_[white[1:], False]  # white space before something else of its text
    attached = last_white & (c == SPACE)
    start = change | last_white
    after_attached = np.r_[False, attached[:-1]]
    start &= ~after_attached | begins
    # contractions: an apostrophe that starts a piece, with its letters
    quote = np.flatnonzero((cp == 39) & start & ~np.r_[False, attached[:-1]])
    if len(quote):
        left = np.searchsorted(np.flatnonzero(ends), quote)
        room = np.flatnonzero(ends)[left] - quote  # characters of the text behind the apostrophe
        done = np.zeros(len(quote), bool)
        for word in CONTRACTIONS:
            ok = ~done & (room >= len(word))
            for k, letter in enumerate(word):
                at = np.minimum(quote + 1 + k, n - 1)
                ok &= cp[at] == ord(letter)
            q = quote[ok]
            start[q + 1] = False
            if len(word) == 2:
                start[q + 2] = False
            behind = q + 1 + len(word)
            behind = behind[behind < n]
            # letters go on as a piece of their own; a space there may be attached to what follows it, so it starts one anyhow
            start[behind] = True
            done |= ok
    return start


class Machine:
    """The BPE transducer, compiled as it is used."""

    def __init__(self, merges: list[tuple[bytes, bytes]], tokens: set[bytes]):
        self.rank = {m: i for i, m in enumerate(merges)}
        self.tokens = tokens
        self.prefixes = {t[:k] for t in tokens for k in range(1, len(t))}  # what may still grow into a token
        self.split = {a + b: (a, b, i) for (a, b), i in reversed(self.rank.items())}
        self.spines: dict[tuple, list] = {}
        self.valid: dict[tuple, bool] = {}
        self.pieces: dict[bytes, int] = {}
        self.clear()

    def clear(self):
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: dict[tuple[int, int], tuple[int, int]] = {}
        self.valid.clear()
        self.start = self._state((b"", (), ()))

    def _state(self, key) -> int:
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def spine(self, token: bytes, right: bool) -> list[tuple[bytes, float]]:
        """The tokens at one edge of a token while it is built, the last first, and the rank of the merge that ends each."""
        key = (token, right)
        if key not in self.spines:
            out = [(token, float("inf"))]
            while token in self.split:
                *halves, rank = self.split[token]
                token = halves[right]
                out.append((token, rank))
            self.spines[key] = out
        return self.spines[key]

    def crossed(self, a: bytes, b: bytes, apart: bool) -> bool:
        """Whether a merge joins the right edge of a with the left edge of b before both are built (or, if they have to
        stay apart, ever). Merges run in the order of their ranks, and from the left within a rank."""
        rank = self.rank
        for x, x_ends in self.spine(a, True):
            for y, y_ends in self.spine(b, False):
                r = rank.get((x, y))
                if r is not None and r < x_ends and r <= y_ends and (apart or x_ends != y_ends):
                    return True
        return False

    def agrees(self, *tokens: bytes) -> bool:
        """Whether a token, or two side by side, is its own encoding."""
        known = self.valid.get(tokens)
        if known is None:
            if len(tokens) == 2:
                known = not self.crossed(*tokens, True)
            elif len(tokens[0]) == 1:
                known = True
            else:
                a, b, _ = self.split.get(tokens[0], (b"", b"", 0))
                known = bool(a) and self.agrees(a) and self.agrees(b) and not self.crossed(a, b, False)
            self.valid[tokens] = known
        return known

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and the change of the token count.

        A state's places run back from the end: last[k] is the last token, and back[k] the count less the count there, of what
        is k bytes before the end; b"" for the piece's start.
        """
        known = self.next.get((state, byte))
        if known:
            return known
        suffix, last, back = self.states[state]
        grown = suffix + bytes((byte,))
        last = last or (b"",)
        back = back or (0,)
        for k in range(len(grown)):
            token = grown[k:]
            if token not in self.tokens:
                continue
            place = len(token) - 1  # bytes back from the old end
            left = last[place]
            if self.agrees(token) if left == b"" else self.agrees(left, token):
                delta = 1 - back[place]
                break
        else:
            raise ValueError(f"no token ends at {grown!r}")
        prefixes = self.prefixes
        while grown and grown not in prefixes:
            grown = grown[1:]
        # places from which no token can go on do not tell states apart
        lasts, backs, n = [token], [0], len(grown)
        for k in range(1, n + 1):
            useful = grown[n - k :] in prefixes
            lasts.append(last[k - 1] if useful else None)
            backs.append(delta + back[k - 1] if useful else 0)
        lasts, backs = tuple(lasts), tuple(backs)
        out = self.next[state, byte] = (self._state((grown, lasts, backs)), delta)
        return out

    def count(self, piece: bytes) -> int:
        state, total, table = self.start, 0, self.next
        for byte in piece:
            state, delta = table.get((state, byte)) or self.step(state, byte)
            total += delta
        if len(self.states) > MOST_STATES:
            self.clear()
        return total


def load(path: str) -> dict:
    """What the machine is compiled from; plain values, so that it can be broadcast (its size is the vocabulary's)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
    raw = lambda s: bytes(of[c] for c in s)
    special = [t["content"] for t in spec["added_tokens"]]
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    return {
        "merges": [(raw(a), raw(b)) for a, b in merges],
        "tokens": {raw(t) for t in spec["model"]["vocab"] if t not in special},
        "special": special,
    }


class StateMap:
    """A chunk's map from the state it is entered in to the state it is left in and the tokens emitted between.

    ``head`` holds the characters before the first place where a piece starts in every state: on them the map depends on the
    entry, so it is evaluated for the states that occur, one a seam. From there on all entries agree: ``count`` tokens, and
    ``exit``, the state at the end. A chunk without such a place has no ``exit``; its map is its head.
    """

    def __init__(self, head: str, count: int = 0, exit: tuple | None = None):
        self.head, self.count, self.exit = head, count, exit

    def after(self, state: tuple, walk) -> tuple[tuple, int]:
        """Exit state and emitted count of an entry state."""
        state, n = walk(state, self.head, self.exit is not None)
        return self.exit or state, n + self.count

    def then(self, other: "StateMap", walk) -> "StateMap":
        """This map and the one behind it as one: maps compose in any bracketing."""
        if self.exit is None:
            return StateMap(self.head + other.head, other.count, other.exit)
        state, n = other.after(self.exit, walk)
        return StateMap(self.head, self.count + n, state)


class Counter:
    def __init__(self, spec: dict):
        self.kind = classes()
        self.machine = Machine(spec["merges"], spec["tokens"])
        self.special = spec["special"]
        self.codes = mix(np.arange(1, 0x110001, dtype=np.uint64))

    def plain(self, texts: list[str]) -> np.ndarray:
        """Token counts of texts without special tokens."""
        lengths = np.array([len(t) for t in texts], np.int64)
        out = np.zeros(len(texts), np.int64)
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if not len(cp):
            return out
        begin = np.r_[0, np.cumsum(lengths)]
        begins = np.zeros(len(cp), bool)
        begins[begin[:-1][lengths > 0]] = True
        s = np.flatnonzero(piece_starts(cp, self.kind, begins))
        e = np.r_[s[1:], len(cp)]
        h = span_hash(self.codes, cp, s, e)
        first, inverse = numbered(cp, s, e, h)
        pieces = self.machine.pieces
        if len(pieces) > MOST_PIECES:
            pieces.clear()
        counts = np.empty(len(first), np.int64)
        for i, at in enumerate(first.tolist()):
            piece = cp[s[at] : e[at]].tobytes()
            n = pieces.get(piece)
            if n is None:
                n = self.machine.count(piece.decode("utf-32-le").encode())
                if len(piece) <= 256:  # long ones are rare and would fill the table's memory
                    pieces[piece] = n
            counts[i] = n
        sums = np.r_[0, np.cumsum(counts[inverse])]
        edge = np.searchsorted(s, begin)
        return sums[edge[1:]] - sums[edge[:-1]]

    def certain_starts(self, chunk: str) -> tuple[int, int]:
        """First and last character that starts a piece whatever is before the chunk or behind it; -1 without one.

        Where the class changes a piece starts, unless white space may be attached or an apostrophe may take letters.
        """
        c = self.kind[np.frombuffer(chunk.encode("utf-32-le"), np.uint32)]
        c = np.where(c == WHITE, SPACE, c)
        sure = np.flatnonzero((c[1:] != c[:-1]) & (c[:-1] != SPACE) & ((c[:-1] != OTHER) | (c[1:] != LETTER))) + 1
        return (int(sure[0]), int(sure[-1])) if len(sure) else (-1, -1)

    def walk(self, state: tuple, text: str, end: bool = False) -> tuple[tuple, int]:
        """Runs splitter and transducer over characters: the state after them and the tokens emitted; ``end`` closes the piece.

        A state is the splitter's (the open piece's class, BEGIN, BLANK or QUOTE), the character that waits for what follows
        it (the last of white space; the first letter of a contraction of two), and the transducer's.
        """
        mode, waits, key = state
        machine, kind, total = self.machine, self.kind, 0
        if len(machine.states) > MOST_STATES:
            machine.clear()
        s = machine._state(key)

        def feed(ch: str):
            nonlocal s, total
            for byte in ch.encode():
                s, delta = machine.next.get((s, byte)) or machine.step(s, byte)
                total += delta

        for ch in text:
            k = int(kind[ord(ch)])
            white = k in (SPACE, WHITE)
            attached = False
            if mode == BLANK:
                if white:
                    feed(waits)
                    waits = ch
                    continue
                s = machine.start
                feed(waits)
                attached, mode, waits = waits == " ", BEGIN, ""
            elif mode == QUOTE:
                if waits and ch == PAIRS[waits]:
                    feed(waits + ch)
                    mode, waits = BEGIN, ""
                    continue
                if waits:  # no contraction: the apostrophe was a piece, and the letter starts one
                    s = machine.start
                    feed(waits)
                    mode, waits = LETTER, ""
                elif ch in PAIRS:
                    waits = ch
                    continue
                elif ch in CONTRACTIONS:
                    feed(ch)
                    mode = BEGIN
                    continue
                else:
                    mode = OTHER
            if white:
                s, mode, waits = machine.start, BLANK, ch
                continue
            if k != mode:
                if not attached:
                    s = machine.start
                mode = QUOTE if ch == "'" and not attached else k
            feed(ch)
        if end:
            if mode == QUOTE and waits:
                s = machine.start
            feed(waits)
            return START, total
        return (mode, waits, machine.states[s]), total

    def state_map(self, chunk: str, opens: bool, closes: bool) -> tuple[StateMap, str]:
        """A chunk's map without the count of its middle, and that middle: the characters between certain starts.

        A text's first character and its end are certain, so a text of one chunk is all middle.
        """
        first, last = (0, len(chunk)) if opens and closes else self.certain_starts(chunk)
        if first < 0:
            if not opens:
                return StateMap(chunk, 0, START if closes else None), ""
            first = last = 0
        first, last = 0 if opens else first, len(chunk) if closes else last
        exit, n = self.walk(START, chunk[last:], closes)
        return StateMap(chunk[:first], n, exit), chunk[first:last]

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts: each text's chunks become state maps, which a pairwise scan composes in order."""
        total, owner, maps, middles = [0] * len(texts), [], [], []
        for i, t in enumerate(texts):
            parts = [t]
            for special in self.special:
                cut = [p.split(special) for p in parts]
                total[i] += sum(len(p) - 1 for p in cut)
                parts = [x for p in cut for x in p]
            for p in parts:
                owner.append(i)
                maps.append([])
                for a in range(0, max(len(p), 1), CHUNK):
                    m, middle = self.state_map(p[a : a + CHUNK], a == 0, a + CHUNK >= len(p))
                    maps[-1].append(m)
                    middles.append((m, middle))
        for (m, _), n in zip(middles, self.plain([x for _, x in middles]).tolist()):
            m.count += n
        for i, chain in zip(owner, maps):
            while len(chain) > 1:
                chain = [chain[j].then(chain[j + 1], self.walk) if j + 1 < len(chain) else chain[j] for j in range(0, len(chain), 2)]
            total[i] += chain[0].count
        return total


def _count(shared, names: list[str], names_out: list[str]):
    def run(batches):
        spec = shared.value  # one object a worker process: the compiled machine stays with it
        if "counter" not in spec:
            spec["counter"] = Counter(spec)
        for batch in batches:
            for part in slices(batch, 8 << 20):
                counts = spec["counter"].counts([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(counts, pa.int64())], names=names_out)

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs`` with ``__tc_tokens``, the number of tokens of ``text``, as last column (with an underscore more for every column of
    ``docs`` that is in its way)."""
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(*free_names(names, "__tc_tokens"), T.LongType())])
    return docs.mapInArrow(_count(docs.sparkSession.sparkContext.broadcast(load(tokenizer_path)), names, schema.names), schema)


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("__tc_tokens").alias("n_tokens"), (F.col("__tc_tokens") > 1024).alias("over_limit"))
