"""SentencePiece encoding by a max-plus scan, and decoding.

A text's best segmentation maximises the sum of its pieces' scores. The best score V of each position is a linear recurrence in max-plus
algebra over the last ``reach`` positions (the longest piece), so a stretch of text is a reach-by-reach transfer matrix from the scores
before it to the scores at its end, and matrices combine associatively. A document of more than ``CHUNK`` characters is cut into chunks; each gives
its matrix, blocks of matrices are multiplied up, and each chunk gets the scores at its start. From these a chunk knows, for each
position at which the last piece over its end may begin, where its own first piece begins; these maps combine from the last chunk to the
first, and each chunk is then backtraced by itself. Its ids are counted, checked and digested by themselves, too; the digests of a document's chunks combine,
so that its ids never meet in one place (unless they are asked for). Texts are read once, for the matrices and for all of the backtrace that doesn't
depend on where a chunk is entered; what does is a few characters a chunk. Other documents are one chunk.

No piece has a word mark inside, so every path passes every start of a word. Scores between two word starts are therefore sums of best scores of
words, which are remembered, and only the characters before a chunk's first and behind its last word start need the full matrix; what lies between
adds the same to all its entries, and is added once at the end. The words of many texts are segmented together, in array steps.
Ties go to the longer last piece, as in the library. Scores are added in double precision.

The given vocabulary is a merge (BPE) model. Its merges are no sum of scores, so the scan can't give the library's ids for it: the scan gives the ids
of the library's unigram decoder over the same pieces and scores. ``Lattice.library_count`` counts what the merges give; both are in the query.

Characters outside the vocabulary become byte pieces. Null and empty texts have no ids. Repeated rows each get their line; an
empty table gives no rows; other columns are carried.
"""

from __future__ import annotations

import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import steps, table, tokenizer_path, written

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Characters of a chunk; longer documents are cut.
CHUNK = 8_192
#: Chunks whose words are made together.
AHEAD = 128
#: Chunks whose matrices one task multiplies.
BLOCK = 64
REMEMBERED = 500_000
#: New words are made together, up to so many at a time; longer words and small numbers of words one by one.
TOGETHER, SHORT, FEW = 16_384, 40, 64
NEVER = -np.inf
#: What an unknown character costs beyond the lowest score.
UNKNOWN = 10.0


class Lattice:
    """Pieces and scores of a model, and the best segmentations of words."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.piece = {lib.id_to_piece(i): (i, float(lib.get_score(i))) for i in plain if set(lib.id_to_piece(i)) != {MARK} or lib.id_to_piece(i) == MARK}
        self.byte = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        self.reach = max(map(len, self.piece))
        #: The pieces as a tree of characters: of each the branches behind it, and (id, score) where a piece ends.
        self.tree: dict[str, tuple[dict, tuple[int, float] | None]] = {}
        for p in sorted(self.piece):
            at = self.tree
            for k, c in enumerate(p, 1):
                at = at.setdefault(c, ({}, self.piece.get(p[:k])))[0]
        self.plain = [lib.id_to_piece(i).replace(MARK, " ") for i in range(n)]
        self.byte_ids = frozenset(self.byte.values())
        self.unknown = min(s for _, s in self.piece.values()) - UNKNOWN
        self.known: dict[str, tuple[float, bytes, bool, int]] = {}
        self.recent: dict[str, tuple[float, bytes, bool, int]] = {}
        self._as_arrays()
        self.known_runs: dict[str, int] = {}

    @classmethod
    def of_process(cls, path: str) -> Lattice:
        """One for all tasks that this Python process runs, so that what it remembers lasts."""
        held = sys.__dict__.setdefault("_ampliq_lattices", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def arcs(self, text: str, end: int, least: int):
        """(start, id or None, score) of the pieces that end at ``end``, longest first; None: an unknown character."""
        get, single = self.piece.get, False
        for start in range(max(least, end - self.reach), end):
            found = get(text[start:end])
            if found:
                single |= start == end - 1
                yield start, found[0], found[1]
        if not single and end - 1 >= least:
            yield end - 1, None, self.unknown

    def ids(self, text: str, start: int, end: int, number) -> list[int]:
        return [number] if number is not None else [self.byte[b] for b in text[start:end].encode()]

    def word(self, word: str) -> tuple[float, list[int]]:
        """Best score and ids of a word. Pieces are tried from each start on, starts in order: of equals the longer last piece stays."""
        n, piece = len(word), self.piece
        best, back = [0.0] + [NEVER] * n, [None] * (n + 1)
        for start in range(n):
            so_far, branches, end = best[start], self.tree, start
            for c in word[start:]:
                found = branches.get(c)
                if found is None:
                    break
                branches, hit = found
                end += 1
                if hit:
                    score = so_far + hit[1]
                    if score > best[end]:
                        best[end], back[end] = score, (start, hit[0])
            if word[start] not in piece and so_far + self.unknown > best[start + 1]:
                best[start + 1], back[start + 1] = so_far + self.unknown, (start, None)
        out, end = [], n
        while end:
            start, number = back[end]
            if number is None:
                out += reversed(self.ids(word, start, end, None))
            else:
                out.append(number)
            end = start
        out.reverse()
        return best[-1], out

    def _as_arrays(self) -> None:
        """The tree as arrays, for many words at once: edges (node and character as one number, sorted) with the node they lead to, and of each node its piece."""
        edges, piece, todo = [], [(-1, NEVER)], [(0, self.tree)]
        while todo:
            node, branches = todo.pop()
            for c, (below, hit) in branches.items():
                edges.append((node << 21 | ord(c), len(piece)))
                todo.append((len(piece), below))
                piece.append(hit or (-1, NEVER))
        edges.sort()
        self.edges, self.leads = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        self.node_id, self.node_score = np.array([i for i, _ in piece], np.int64), np.array([x for _, x in piece])
        #: The byte pieces of ASCII characters, by code, and what each piece shows alone.
        self.ascii = np.array([self.byte.get(b, -1) for b in range(128)], np.int64)
        self.shown = list(self.plain)
        for b, i in self.byte.items():
            self.shown[i] = chr(b) if b < 128 else self.plain[i]
        self.shown_length = np.array([len(p) for p in self.shown], np.int64)

    def _words(self, words: list[str]) -> list[tuple[float, bytes, bool]]:
        """``word`` for many short words at once: the same sums in the same order, one array step for each start and length of a piece."""
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))  # so that the words which are long enough come first
        laid = [MARK + words[k] for k in order]
        size = np.array(list(map(len, laid)))
        n, width = len(laid), int(size[0])
        codes = np.frombuffer("".join([w.ljust(width, "\0") for w in laid]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, width).astype(np.int64)
        best = np.full((width + 1, n), NEVER)
        start_of, number = np.zeros((width + 1, n), np.int64), np.full((width + 1, n), -1, np.int64)
        best[0] = 0.0
        enough = [int(np.searchsorted(-size, -k, "left")) for k in range(width + 1)]  # words of more than k characters
        for start in range(width):
            rows = np.arange(enough[start])
            node, single = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
            for end in range(start + 1, min(width, start + self.reach) + 1):
                inside = rows < enough[end - 1]
                rows, node = rows[inside], node[inside]
                key = node << 21 | codes[rows, end - 1]
                at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
                on = self.edges[at] == key
                rows, node = rows[on], self.leads[at[on]]
                if not len(rows):
                    break
                if end == start + 1:
                    single[rows] = self.node_id[node] >= 0
                score = best[start, rows] + self.node_score[node]
                better = score > best[end, rows]
                won = rows[better]
                best[end, won], start_of[end, won], number[end, won] = score[better], start, self.node_id[node[better]]
            lone = np.flatnonzero(~single)
            score = best[start, lone] + self.unknown
            better = score > best[start + 1, lone]
            won = lone[better]
            best[start + 1, won], start_of[start + 1, won] = score[better], start
            code = codes[won, start]
            number[start + 1, won] = np.where(code < 128, self.ascii[np.minimum(code, 127)], -1)
        every = np.arange(n)
        at, steps_back, unknown = size.copy(), [], np.zeros(n, bool)
        while at.any():
            going = at > 0
            piece = np.where(going, number[at, every], -2)
            unknown |= piece == -1
            steps_back.append(piece)
            at = np.where(going, start_of[at, every], 0)
        ids = np.stack(steps_back[::-1], axis=1)
        taken = ids >= 0
        held, length = ids[taken].astype("<u4").tobytes(), taken.sum(axis=1)
        stops = 4 * np.cumsum(length)
        fits = np.where(taken, self.shown_length[np.where(taken, ids, 0)], 0).sum(axis=1) == size
        same = bool((fits | unknown).all()) and "".join(map(self.shown.__getitem__, ids[taken & ~unknown[:, None]].tolist())) == "".join([" " + w[1:] for w, odd in zip(laid, unknown.tolist(), strict=True) if not odd])
        out: list = [None] * n
        for k, word, score, stop, count, odd in zip(order, laid, best[size, every].tolist(), stops.tolist(), length.tolist(), unknown.tolist(), strict=True):
            if odd:  # a character outside the vocabulary of several bytes
                score, own = self.word(word)
                out[k] = score, struct.pack(f"<{len(own)}I", *own), decode(own, self) == word[1:]
            else:
                own = held[stop - 4 * count : stop]
                out[k] = score, own, same or decode(unpacked(own), self) == word[1:]
        return out

    def _made(self, new: list[str]) -> dict[str, tuple[float, bytes, bool, int]]:
        """The entries of words that aren't known yet."""
        made: dict[str, tuple[float, bytes, bool, int]] = {}
        for k in range(0, len(new), TOGETHER):
            some = new[k : k + TOGETHER]
            counted = list(map(len, self.library.encode(some, num_threads=1)))
            short = [w for w in some if len(w) <= SHORT and "\0" not in w] if len(some) > FEW else []
            many = dict(zip(short, self._words(short), strict=True)) if short else {}
            for w, n in zip(some, counted, strict=True):
                found = many.get(w)
                if found is None:
                    score, ids = self.word(MARK + w)
                    found = score, struct.pack(f"<{len(ids)}I", *ids), decode(ids, self) == w
                made[w] = *found, n
        if len(self.known) < REMEMBERED:
            self.known.update(made)
        return made

    def ahead(self, texts: list[str]) -> None:
        """Makes the entries of all words of some texts, so that those of each text are at hand."""
        self.recent = self._made([w for w in dict.fromkeys(" ".join(texts).split(" ")) if w not in self.known])

    def entries(self, words: list[str]) -> list[tuple[float, bytes, bool, int]]:
        """For each word, given without its mark: best score, ids, whether these decode to it, and how many ids the library gives."""
        found = list(map(self.known.get, words))
        if None in found:
            found = [f or self.recent.get(w) for w, f in zip(words, found, strict=True)]
            if None in found:
                made = self._made(list(dict.fromkeys(w for w, f in zip(words, found, strict=True) if f is None)))
                found = [f or made[w] for w, f in zip(words, found, strict=True)]
        return found

    def whole(self, marked: str) -> tuple[float, bytes]:
        """Best score and ids of a text that begins with a mark, or is empty."""
        found = self.entries(marked[1:].split(MARK)) if marked else []
        return sum([f[0] for f in found]), b"".join([f[1] for f in found])

    def digest(self, text: str) -> tuple[bytes, float, int, bool]:
        """Ids, score, the library's number of ids, and whether the ids decode to the text. Words decode one by one: each begins with a piece."""
        words = text.split(" ")
        if MARK not in text and "" not in words:
            scores, ids, same, counts = zip(*self.entries(words), strict=True)
            joined = b"".join(ids)
            return joined, sum(scores), sum(counts), all(same) or decode(unpacked(joined), self) == text
        score, joined = self.whole(marked(text.encode()))
        return joined, score, self.library_count(text), decode(unpacked(joined), self) == text

    def library_count(self, text: str) -> int:
        """How many ids the library gives, word by word: a merge never crosses a word start behind a character of another word."""
        # a run of spaces may merge, so it stays with the word behind it
        words, runs, held = [], [], ""
        for w in text.split(" "):
            if not w:
                held += " "
            elif held or MARK in w:
                runs.append(held + w)
                held = ""
            else:
                words.append(w)
        lone = held == " "  # one space at the end is a mark alone
        if held and not lone:
            runs.append(held[:-1])
        counts = list(map(self.known_runs.get, runs))
        if None in counts:
            new = list(dict.fromkeys(w for w, n in zip(runs, counts, strict=True) if n is None))
            found = dict(zip(new, map(len, self.library.encode(new, num_threads=1)), strict=True))
            counts = [found[w] if n is None else n for w, n in zip(runs, counts, strict=True)]
            if len(self.known_runs) < REMEMBERED:
                self.known_runs.update(found)
        return sum(f[3] for f in self.entries(words)) + sum(counts) + lone if text else 0

    def advance(self, text: str, first: int, scores: np.ndarray) -> tuple[np.ndarray, list]:
        """From scores (reach, k) at positions first - reach + 1 to first: scores at the last ``reach`` positions of ``text``, and for every position
        the arc that each of the k columns took."""
        v, back = np.full((len(text) + 1, scores.shape[1]), NEVER), [None] * (len(text) + 1)
        low = first - self.reach + 1
        v[max(0, low) : first + 1] = scores[max(0, -low) :]
        for end in range(first + 1, len(text) + 1):
            arcs = list(self.arcs(text, end, max(0, low)))
            options = np.stack([v[s] + x for s, _, x in arcs])
            pick = options.argmax(axis=0)  # the first of equals: the longest piece
            v[end], back[end] = options[pick, np.arange(scores.shape[1])], (arcs, pick)
        tail = v[-self.reach :]
        return tail if len(tail) == self.reach else np.concatenate([np.full((self.reach - len(tail), scores.shape[1]), NEVER), tail]), back

    def gates(self, text: str, first: int) -> list[int]:
        """Positions from ``first`` on at which a word starts: every path passes them."""
        return [i for i in range(max(first, 1), len(text)) if text[i] == MARK]

    def before_gate(self, text: str, first: int) -> np.ndarray:
        """The scores from each state at the start of a chunk (behind ``first`` characters of context) to the word start at the end of ``text``."""
        unit = np.full((self.reach, self.reach), NEVER)
        np.fill_diagonal(unit, 0.0)
        return self.advance(text, first, unit)[0]

    def behind_gate(self, text: str) -> tuple[np.ndarray, list]:
        """The scores of the last ``reach`` positions of a text that begins at a word start, and the arcs taken; positions before it can't be reached."""
        at = np.full((self.reach, 1), NEVER)
        at[-1] = 0.0
        leave, back = self.advance(text, 0, at)
        leave = leave[:, 0].copy()
        if len(text) < self.reach:
            leave[: self.reach - len(text) - 1] = NEVER
        return leave, back

    def traced(self, text: str, back: list, end: int, least: int) -> tuple[int, bytes]:
        """Where the path that ends at ``end`` starts at or before ``least``, and its ids."""
        out = []
        while end > least:
            arcs, pick = back[end]
            start, number, _ = arcs[int(pick[0])]
            out.append(self.ids(text, start, end, number))
            end = start
        ids = [x for p in reversed(out) for x in p]
        return end, struct.pack(f"<{len(ids)}I", *ids)

    def between(self, text: str) -> tuple[float, bytes, bool, int]:
        """Score and ids of whole words in a row, each with its mark, whether the ids decode to them, and the library's number of ids."""
        words = text[1:].split(MARK)
        scores, ids, same, counts = zip(*self.entries(words), strict=True)
        return sum(scores), b"".join(ids), all(same), sum(counts) if "" not in words else int(text == MARK) or self.library_count(" ".join(words))


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices: first ``b``, then ``a``."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def joined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two texts in a row, from theirs and the second one's bytes: the first is shifted by as many bytes, as a polynomial modulo the CRC's."""

    def times(a: int, b: int) -> int:
        out = 0
        for k in range(31, -1, -1):  # the highest bit is the lowest power
            out ^= b if a >> k & 1 else 0
            b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
        return out

    shift, power = 1 << 31, 1 << 23  # 1, and the polynomial of one byte
    while length:
        shift = times(shift, power) if length & 1 else shift
        power, length = times(power, power), length >> 1
    return times(shift, first) ^ second


def marked(text: bytes) -> str:
    t = text.decode()
    return MARK + t.replace(" ", MARK) if t else ""


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def decode(ids: list[int], lattice: Lattice) -> str:
    """The text of a row of ids."""
    if lattice.byte_ids.isdisjoint(ids):
        return "".join(map(lattice.plain.__getitem__, ids))[1:]
    out, held = [], bytearray()
    for i in ids:
        if i in lattice.byte_ids:
            held.append(int(lattice.library.id_to_piece(i)[1:-1], 16))
            continue
        if held:
            out.append(held.decode(errors="replace"))
            held = bytearray()
        out.append(lattice.plain[i])
    out.append(held.decode(errors="replace"))
    return "".join(out)[1:]


_DIGEST = "n_ids long, ids_crc32 long, score double, n_library long, decoded boolean"
_NAMES = ["n_ids", "ids_crc32", "score", "n_library", "decoded"]


def _digest(rows: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()), strict=True)]


def encode_documents(docs: DataFrame, path: str, chunk: int = CHUNK, keep_ids: bool = False) -> DataFrame:
    """``docs`` without its text, with n_ids, ids_crc32, score, n_library and decoded (and with ``keep_ids`` the ids as bytes)."""
    kept = [c for c in docs.columns if c not in ("text", "ids", *_NAMES)]
    types = dict(docs.dtypes)
    columns = "".join(f"`{c}` {types[c]}, " for c in kept)

    def one_chunk(batches):
        lattice = Lattice.of_process(path)
        for part, texts in steps(batches, most=1 << 20):
            rows, held = [], []
            texts = [t.decode() for t in texts]
            lattice.ahead(texts)
            for t in texts:
                ids, score, counted, same = lattice.digest(t)
                rows.append((len(ids) // 4, zlib.crc32(ids), float(score), counted, same))
                held.append(ids)
            yield pa.record_batch([*(part.column(part.schema.get_field_index(c)) for c in kept), *_digest(rows), *([pa.array(held, pa.binary())] if keep_ids else [])], [*kept, *_NAMES, *["ids"] * keep_ids])

    is_giant = F.length(F.coalesce("text", F.lit(""))) > chunk
    small = docs.where(~is_giant).select(*kept, "text").mapInArrow(one_chunk, columns + _DIGEST + ", ids binary" * keep_ids)
    return small.unionByName(_giants(docs.where(is_giant).select(*kept, "text"), path, chunk, kept, columns, keep_ids))


def _giants(docs: DataFrame, path: str, chunk: int, kept: list[str], columns: str, keep_ids: bool) -> DataFrame:
    """The same for documents of many chunks, by matrices, boundary scores, maps and backtraces of chunks."""
    spark = docs.sparkSession
    of_row = ["_row", "chunk"]
    cut_names = [*(f"_kept_{c}" for c in kept), *of_row, "block", "first", "piece", "odd"]
    types = dict(docs.dtypes)
    cut_types = "".join(f"`_kept_{c}` {types[c]}, " for c in kept) + "_row long, chunk int, block int, first int, piece string, odd boolean"

    def cut(batches):
        from pyspark import TaskContext

        lattice, row = Lattice.of_process(path), TaskContext.get().partitionId() << 33
        for part, texts in steps(batches):
            for k, t in enumerate(texts):
                m, row = marked(t), row + 1
                odd = MARK in t.decode()  # marks of the text's own, which ids can't tell from spaces
                starts = list(range(0, len(m), chunk))
                for j in range(0, len(starts), 1000):
                    some = starts[j : j + 1000]
                    firsts, n = [min(x, lattice.reach - 1) for x in some], len(some)
                    own = [part.column(part.schema.get_field_index(c)).slice(k, 1) for c in kept]  # with the first chunk only
                    held = [pa.concat_arrays([c, pa.nulls(n - 1, c.type)]) if j == 0 else pa.nulls(n, c.type) for c in own]
                    numbers = [x // chunk for x in some]
                    pieces = [m[x - f : x + chunk] for x, f in zip(some, firsts, strict=True)]
                    yield pa.record_batch([*held, pa.array([row] * n), pa.array(numbers, pa.int32()), pa.array([x // BLOCK for x in numbers], pa.int32()), pa.array(firsts, pa.int32()), pa.array(pieces), pa.array([odd] * n)], cut_names)

    chunks = docs.select(*kept, "text").mapInArrow(cut, cut_types).repartition("_row", "block", "chunk")

    def parts(batches):
        """Of each chunk: its matrix, by the scores to its first word start and from its last one (or whole, where it has none); ids and counts of the words
        between; ids behind the last word start for each state that the chunk may be left in; and the few characters whose path depends on where it is entered."""
        lattice = Lattice.of_process(path)
        reach = lattice.reach
        for b in batches:
            if not b.num_rows:
                continue
            at = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in ("first", "piece", "odd")}
            rows = []
            for k, (text, first, odd) in enumerate(zip(at["piece"], at["first"], at["odd"], strict=True)):
                if k % AHEAD == 0:
                    lattice.ahead([p.replace(MARK, " ") for p in at["piece"][k : k + AHEAD]])
                gates = lattice.gates(text, first)
                # whole words from one run of marks to another are counted here; what is before and behind them meets the neighbours' words
                clean = [g for g in gates if text[g - 1] != MARK]
                over, tail_text = (text[first : clean[0]], text[clean[-1] :]) if clean else (text[first:], None)
                if not gates:
                    rows.append((text, None, lattice.before_gate(text, first).tobytes(), None, 0.0, b"", None, over, tail_text, 0, not odd))
                    continue
                a, g = gates[0], gates[-1]
                inner, middle, same, counted = lattice.between(text[a:g]) if g > a else (0.0, b"", True, 0)
                if not clean or clean[-1] == clean[0]:
                    same, counted = True, 0
                elif (clean[0], clean[-1]) != (a, g):
                    _, _, same, counted = lattice.between(text[clean[0] : clean[-1]])
                leave, back = lattice.behind_gate(text[g:])
                # the path is cut s characters before the end of the chunk
                ends = [lattice.traced(text[g:], back, len(text) - g - s, 0)[1] if len(text) - g >= s and leave[reach - 1 - s] > NEVER else None for s in range(reach)]
                rows.append((text[:a], lattice.before_gate(text[:a], first)[-1].tobytes(), None, leave.tobytes(), float(inner), middle, ends, over, tail_text, counted, same and not odd))
            kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.string(), pa.string(), pa.int64(), pa.bool_()]
            found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            if not keep_ids:
                found[5] = pa.array([struct.pack("<QI", len(r[5]), zlib.crc32(r[5])) for r in rows], pa.binary())
                found[6] = pa.array([None if r[6] is None else [None if x is None else struct.pack("<QI", len(x), zlib.crc32(x)) for x in r[6]] for r in rows], pa.list_(pa.binary()))
            yield pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in (*cut_names[: len(kept)], *of_row, "block", "first")), *found], part_names)

    part_names = [*cut_names[: len(kept)], *of_row, "block", "first", "head", "entry", "whole", "leave", "inner", "middle", "ends", "over", "tail", "counted", "same"]
    part_types = "".join(f"`_kept_{c}` {types[c]}, " for c in kept) + "_row long, chunk int, block int, first int, head string, entry binary, whole binary, leave binary, inner double, middle binary, ends array<binary>, over string, tail string, counted long, same boolean"
    held = written(chunks.mapInArrow(parts, part_types), spark, "chunks")
    one = held.select("_row", "chunk", "block", "entry", "whole", "leave")

    def square(r: dict) -> np.ndarray:
        """The matrix (state at the end, state at the start) of a chunk or of a block of chunks."""
        if r["whole"] is None:
            return np.frombuffer(r["leave"])[:, None] + np.frombuffer(r["entry"])[None, :]
        return np.frombuffer(r["whole"]).reshape(int(np.sqrt(len(r["whole"]) // 8)), -1)

    def product(t: pa.Table) -> pa.Table:  # at most BLOCK matrices
        found = [square(r) for r in sorted(t.to_pylist(), key=lambda r: r["chunk"])]
        out = found[0]
        for m in found[1:]:
            out = plus(m, out)
        return pa.table([t.column("_row").slice(0, 1), t.column("block").slice(0, 1), pa.array([out.tobytes()])], ["_row", "block", "whole"])

    def along(found: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
        out = [at]
        for m in found[:-1]:
            out.append(plus(m, out[-1][:, None])[:, 0])
        return out

    def block_starts(t: pa.Table) -> pa.Table:  # a matrix for each BLOCK chunks of one document
        found = sorted(t.to_pylist(), key=lambda r: r["block"])
        at = np.full(len(square(found[0])), NEVER)
        at[-1] = 0.0
        out = along([square(r) for r in found], at)
        return pa.table([pa.array([r["_row"] for r in found]), pa.array([r["block"] for r in found], pa.int32()), pa.array([x.tobytes() for x in out])], ["_row", "block", "before"])

    def chunk_starts(t: pa.Table, before: pa.Table) -> pa.Table:
        found = sorted(t.to_pylist(), key=lambda r: r["chunk"])
        out = along([square(r) for r in found], np.frombuffer(before.column("before")[0].as_py()))
        return pa.table([pa.array([r["_row"] for r in found]), pa.array([r["chunk"] for r in found], pa.int32()), pa.array([x.tobytes() for x in out])], [*of_row, "before"])

    blocks = one.groupBy("_row", "block").applyInArrow(product, "_row long, block int, whole binary")
    starts = blocks.groupBy("_row").applyInArrow(block_starts, "_row long, block int, before binary")
    entries = one.groupBy("_row", "block").cogroup(starts.groupBy("_row", "block")).applyInArrow(chunk_starts, "_row long, chunk int, before binary")

    def heads(batches):
        """For each state a chunk may be left in: the state it is entered in, and the ids up to its first word start (or all, where it has none)."""
        lattice = Lattice.of_process(path)
        reach = lattice.reach
        for b in batches:
            if not b.num_rows:
                continue
            rows = []
            for r in b.to_pylist():
                text, first = r["head"], r["first"]
                scores, back = lattice.advance(text, first, np.frombuffer(r["before"])[:, None])
                if r["whole"] is None:
                    end, ids = lattice.traced(text, back, len(text), first)
                    rows.append((r["_row"], r["chunk"], [first - end] * reach, [ids] * reach, float(scores[-1, 0] + np.frombuffer(r["leave"])[-1])))
                    continue
                found = [lattice.traced(text, back, len(text) - s, first) if len(text) - s >= first and scores[reach - 1 - s, 0] > NEVER else None for s in range(reach)]
                rows.append((r["_row"], r["chunk"], [-1 if x is None else first - x[0] for x in found], [None if x is None else x[1] for x in found], float(scores[-1, 0])))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*of_row, "entered", "heads", "end_score"])

    met = held.select(*of_row, "first", "head", "whole", "leave").join(entries, of_row)
    traced = written(met.mapInArrow(heads, "_row long, chunk int, entered array<int>, heads array<binary>, end_score double"), spark, "traces")

    def states(t: pa.Table) -> pa.Table:  # a few small numbers for each chunk of one document
        found = sorted(t.to_pylist(), key=lambda r: -r["chunk"])
        state, out = 0, []
        for r in found:
            out.append(state)
            state = r["entered"][state]
        return pa.table([pa.array([r["_row"] for r in found]), pa.array([r["chunk"] for r in found], pa.int32()), pa.array(out, pa.int32())], [*of_row, "state"])

    left = traced.select(*of_row, "entered").groupBy("_row").applyInArrow(states, "_row long, chunk int, state int")
    picked = held.select(*of_row, "inner", "middle", "ends", "over", "tail", "counted", "same").join(traced.drop("entered"), of_row).join(left, of_row)
    at_state = F.col("state") + 1
    picked = picked.select(*of_row, "inner", "middle", F.element_at("ends", at_state).alias("end"), F.element_at("heads", at_state).alias("head"), "end_score", "over", "tail", "counted", "same")

    def folded(t: pa.Table) -> pa.Table:  # a few numbers for each chunk of one document, and the words over its ends
        lattice = Lattice.of_process(path)
        found = sorted(t.to_pylist(), key=lambda r: r["chunk"])
        crc, size, counted, same, over = 0, 0, 0, True, ""

        def word(w):
            return lattice.between(w)[2:] if w else (True, 0)

        for r in found:
            middle, end = ((x and struct.unpack("<QI", x)) if not keep_ids else (x and (len(x), zlib.crc32(x))) for x in (r["middle"], r["end"]))
            for n, c in ((len(r["head"]), zlib.crc32(r["head"])), middle or (0, 0), end or (0, 0)):
                crc, size = joined_crc(crc, c, n), size + n
            over += r["over"]
            if r["tail"] is not None:
                fits, n = word(over)
                same, counted, over = same and fits, counted + n + r["counted"], r["tail"]
            same = same and r["same"]
        fits, n = word(over)
        score = found[-1]["end_score"] + sum(r["inner"] for r in found)
        columns = [pa.array([found[0]["_row"]]), *_digest([(size // 4, crc, score, counted + n, same and fits)])]
        ids = [pa.array([b"".join(x for r in found for x in (r["head"], r["middle"], r["end"]) if x)], pa.binary())] if keep_ids else []
        return pa.table([*columns, *ids], ["_row", *_NAMES, *["ids"] * keep_ids])

    digests = picked.groupBy("_row").applyInArrow(folded, "_row long, " + _DIGEST + ", ids binary" * keep_ids)
    first = held.where("chunk = 0").select("_row", *[F.col(f"_kept_{c}").alias(c) for c in kept])
    return first.join(digests, "_row").select(*kept, *_NAMES, *["ids"] * keep_ids)


def op10_max_plus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(VOCABULARY))
