"""SentencePiece encoding and decoding by a streaming Viterbi pass over a given model.

The model file is a path parameter; it is never trained or copied. For a BPE model the ids
are those of its merges: of all pieces that end at a position, exactly one continues the
path of the prefix before it, the one whose seam the merges would leave alone. So each
position has one surviving backpointer, candidates reach back at most the longest piece,
and ids are committed as soon as the paths of all positions in that window run through one
boundary. All text takes this pass. No piece crosses from a non-space to a space or touches a line break (which no
piece contains), so paths always converge there. The stretches between such boundaries are found for some megabytes of
texts at once, each different one is encoded once for all places where it stands, and up to a bounded number their ids are remembered
beyond that; the frequent ones outlive the rare. Texts that begin with a blank, or hold two in a row or U+2581, are cut one by one.

Defined results: a null text is empty; an empty text has no ids. Repeated rows are encoded
alike. Characters outside the vocabulary become byte pieces. U+2581 in a text is a space
to the model, so a text that holds it does not come back unchanged (round_trip is false).
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import fresh
from folio.llm.words import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stretches, seams, and beginnings of stretches that a task remembers (none of more than COMMIT_AT characters, so as many pieces); bytes of text encoded at once.
MEMO, SEAMS, BEGINNINGS, COMMIT_AT, AT_ONCE = 40_000, 1_000_000, 100_000, 64, 1_000_000
#: Words of at most so many characters pass through the window together.
WIDTHS = (8, 12, 20, COMMIT_AT)
_BASE, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_CHUNK = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class Vocabulary:
    """Pieces, scores and byte ids of a model, plain enough to be sent to tasks."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte_of = {i: int(self.pieces[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if i not in special and i not in self.byte_of}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.whole: frozenset[str] = frozenset()  # pieces that the merges can build
        self.cut: dict[str, int] = {}  # where their last merge puts them together
        self.special = special


class Memo(dict):
    """Ids of stretches that begin with ``lead``; when full, only those asked for again stay for another round."""

    def __init__(self, codec: Codec, lead: str):
        super().__init__()
        self.codec, self.lead, self.older = codec, lead, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.codec.stream(self.lead + word)
            if len(word) >= COMMIT_AT:
                return ids
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.width = max(map(len, vocabulary.id_of))
        self.byte_id = {b: i for i, b in vocabulary.byte_of.items()}
        self.seams: dict[int, bool] = {}
        self.edges: dict[tuple[str, bool], list[tuple[str, float]]] = {}
        lengths: dict[str, set[int]] = {}
        for p in vocabulary.id_of:
            if len(p) > 2:
                lengths.setdefault(p[-3:], {1, 2}).add(len(p))
        self.reach = {end: tuple(sorted(found, reverse=True)) for end, found in lengths.items()}  # last three characters -> how long pieces are that end in them
        self.ends: dict[str, tuple[int, tuple[int, ...]]] = {}  # beginning of a stretch -> the piece that ends there, all ids up to there
        # Pieces by number: those of the model, then characters that it lacks, as they come up.
        self.names, self.number = list(vocabulary.pieces), dict(vocabulary.id_of)
        self.out = [(i,) for i in range(len(self.names))]
        self.built = frozenset(vocabulary.id_of[p] for p in vocabulary.whole)
        self.inner, self.bare = Memo(self, SPACE), Memo(self, "")
        self.text_of = ["" if i in vocabulary.special else p.replace(SPACE, " ") for i, p in enumerate(vocabulary.pieces)]
        for i, b in vocabulary.byte_of.items():
            self.text_of[i] = chr(b) if b < 128 else None  # other bytes need their neighbours

    def merged(self, text: str, last: list[int] | None = None) -> list[str]:
        """The merges themselves, for single pieces; ``last`` gets where the seams were that they took, in order."""
        parts, score = list(text), self.v.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            if last is not None:
                last.append(len("".join(parts[: at + 1])))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, piece: str, right: bool) -> list[tuple[str, float]]:
        """The parts of a piece that lie at one of its ends while it is merged, each with the score of the merge that takes it in."""
        found = self.edges.get((piece, right))
        if found is None:
            found, part, taken = [], piece, float("-inf")
            while True:
                found.append((part, taken))
                cut = self.v.cut.get(part)
                if cut is None:
                    break
                taken, part = self.v.score[part], part[cut:] if right else part[:cut]
            self.edges[piece, right] = found
        return found

    def holds(self, left: int, right: int) -> bool:
        """Whether the merges keep the seam between two pieces.

        They don't if two parts that lie at the seam at one time make a piece of a better score than the merges that
        take them in; of equal scores the merge to the left comes first.
        """
        if len(self.seams) >= MEMO:
            self.seams.clear()
        score, other, known = self.v.score, self.edge(self.names[right], False), True
        for a, taken in self.edge(self.names[left], True):
            for b, taken_b in other:
                s = score.get(a + b)
                if s is not None and s > taken and s >= taken_b:
                    known = False
                    break
            if not known:
                break
        self.seams[left << 24 | right] = known
        return known

    def _char(self, c: str) -> int:
        """The number of a character that is no piece; its ids are its bytes."""
        i = self.number[c] = len(self.names)
        self.names.append(c)
        self.out.append(tuple(self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")))
        return i

    def _begin(self, chunk: str, end: int) -> None:
        """Puts the pieces that end at each place up to ``end`` of a stretch into ``ends``; beginnings that were seen before are there."""
        number, seams, reach, ends = self.number, self.seams, self.reach, self.ends
        m = end
        while m and chunk[:m] not in ends:
            m -= 1
        for m in range(m + 1, end + 1):
            for k in reach.get(chunk[m - 3 : m], (2, 1)) if m > 2 else (2, 1):
                if k > m:
                    continue
                i = number.get(chunk[m - k : m])
                if i is None:
                    if k > 1:
                        continue
                    i = self._char(chunk[m - 1])
                if m == k:
                    if k == 1 or i in self.built:
                        ends[chunk[:m]] = i, self.out[i]
                        break
                    continue
                left, before = ends[chunk[: m - k]]
                kept = seams.get(left << 24 | i)
                if self.holds(left, i) if kept is None else kept:
                    ends[chunk[:m]] = i, before + self.out[i]
                    break
            else:
                raise LookupError(chunk)

    def stream(self, chunk: str) -> tuple[int, ...]:
        """Ids of a stretch; those before a boundary are committed as soon as all paths of the window run through it."""
        if len(self.ends) >= BEGINNINGS:
            self.ends.clear()
        try:
            return self._stream(chunk)
        except LookupError:  # no vocabulary of merges gets here; the merges still give the ids
            return tuple(i for p in self.merged(chunk) for i in (self.out[self.number[p]] if p in self.number else self.out[self._char(p)]))

    def _stream(self, chunk: str) -> tuple[int, ...]:
        first = min(len(chunk), COMMIT_AT)
        self._begin(chunk, first)
        if len(chunk) == first:
            return self.ends[chunk][1] if chunk else ()
        last = [0, *(self.ends[chunk[:m]][0] for m in range(1, first + 1))]  # last[i]: the piece that ends at base + i
        out: list[int] = []
        base = self._commit(last, out)
        for m in range(first + 1, len(chunk) + 1):
            for k in self.reach.get(chunk[m - 3 : m], (2, 1)):
                i = self.number.get(chunk[m - k : m])
                if i is None and k == 1:
                    i = self._char(chunk[m - 1])
                if i is None or k > m - base:
                    continue
                if m == k:
                    kept = k == 1 or i in self.built
                else:
                    kept = self.seams.get(last[m - k - base] << 24 | i)
                    if kept is None:
                        kept = self.holds(last[m - k - base], i)
                if kept:
                    last.append(i)
                    break
            else:
                raise LookupError(chunk)
            if m - base >= COMMIT_AT:
                base += self._commit(last, out)
        return tuple(out + self._path(last, len(last) - 1))

    def _commit(self, last: list[int], out: list[int]) -> int:
        """Moves what lies before the boundary at which the window's paths meet from the window to the ids; how many characters."""
        cut = self._met(last)
        out += self._path(last, cut)
        del last[:cut]
        return cut

    def _met(self, last: list[int]) -> int:
        """The boundary at which the paths of all positions meet that the next pieces can reach back to."""
        n = len(last) - 1
        at = {n - k for k in range(min(self.width, n))}
        while len(at) > 1:  # step the latest position back until the paths meet
            j = max(at)
            at.remove(j)
            at.add(j - len(self.names[last[j]]))
        return at.pop()

    def _path(self, last: list[int], end: int) -> list[int]:
        found = []
        while end > 0:
            found.append(last[end])
            end -= len(self.names[last[end]])
        return [i for p in reversed(found) for i in self.out[p]]

    def encode(self, text: str) -> array:
        if not text:
            return array("i")
        if text[0] == " " or "  " in text or SPACE in text:
            chunks = _CHUNK.findall(SPACE + text.replace(" ", SPACE))
            return array("i", chain.from_iterable(map(self.bare.__getitem__, chunks)))
        inner, bare, parts = self.inner.__getitem__, self.bare, []
        for line in text.split("\n"):
            words = line.split(" ")
            if parts:
                parts += (bare["\n"], bare[words[0]])
                words = words[1:]
            parts += map(inner, words)
        return array("i", chain.from_iterable(parts))

    def decode(self, ids) -> str:
        """Text of ids; runs of byte pieces that are no UTF-8 become replacement characters."""
        text_of, byte_of = self.text_of, self.v.byte_of
        parts = [text_of[i] for i in ids]
        if None not in parts:
            text = "".join(parts)
            return text[1:] if text.startswith(" ") else text
        parts, run = [], bytearray()
        for i in ids:
            b = byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            parts.append(text_of[i])
        if run:
            parts.append(run.decode("utf-8", "replace"))
        text = "".join(parts)
        return text[1:] if text.startswith(" ") else text


def vocabulary(path: str = MODEL) -> Vocabulary:
    """Reads a model file on the driver; its contents go to the tasks with the code."""
    with open(path, "rb") as f:
        v = Vocabulary(f.read())
    merged, seams = Codec(v).merged, {}
    v.whole = frozenset(p for p in v.id_of if merged(p, seams.setdefault(p, [])) == [p])
    v.cut = {p: seams[p][-1] for p in v.whole if len(p) > 1}
    return v


def _picked(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[start : start + size] of each, one after another."""
    upto = np.cumsum(sizes)
    return pool[np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]


class Together:
    """The same pass over many words at once: all words step on by one character together.

    A piece is found by a number of its characters (a polynomial modulo 2^64, whose value for a part of a word follows from those of two beginnings). What was encoded is
    decoded and compared byte by byte, so that a chance likeness of numbers would show.
    """

    def __init__(self, codec: Codec):
        self.codec, self.size = codec, -1
        self.seam_keys, self.seam_kept = np.empty(0, np.int64), np.empty(0, bool)
        self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(COMMIT_AT + 1, _BASE))])

    def _tables(self) -> None:
        """By number of a piece: its length, ids, bytes; and pieces by the number of their characters."""
        c = self.codec
        if self.size == len(c.names):
            return
        self.size = len(c.names)
        found: dict[int, int] = {}
        for name, i in c.number.items():
            h = 0
            for x in name:
                h = (h * int(_BASE) + ord(x)) & (2**64 - 1)
            found[h] = i
        self.keys = np.array(sorted(found), np.uint64)
        self.of = np.array([found[k] for k in self.keys.tolist()], np.int64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys * _ODD) >> np.uint64(44)] = True
        self.widest = min(c.width, COMMIT_AT)
        self.length = np.array([len(n) for n in c.names])
        self.built = np.zeros(self.size, bool)
        self.built[list(c.built)] = True
        self.n_ids = np.array([len(x) for x in c.out])
        self.ids = np.fromiter(chain.from_iterable(c.out), np.int32)
        self.first_id = np.cumsum(self.n_ids) - self.n_ids
        raw = [bytes([c.v.byte_of[i]]) if i in c.v.byte_of else (t or "").encode("utf-8", "surrogatepass") for i, t in enumerate(c.text_of)]
        self.n_raw = np.array([len(x) for x in raw])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.first_raw = np.cumsum(self.n_raw) - self.n_raw

    def _kept(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges keep the seam of each pair of pieces."""
        key = left << 24 | right
        at = np.searchsorted(self.seam_keys, key)
        new = np.ones(len(key), bool)
        inside = at < len(self.seam_keys)
        new[inside] = self.seam_keys[at[inside]] != key[inside]
        if new.any():
            unseen = np.unique(key[new])
            kept = np.array([self.codec.holds(k >> 24, k & 0xFFFFFF) for k in unseen.tolist()], bool)
            if len(self.seam_keys) + len(unseen) > SEAMS:
                known = np.isin(self.seam_keys, key)  # those in use stay
                self.seam_keys, self.seam_kept = self.seam_keys[known], self.seam_kept[known]
            to = np.searchsorted(self.seam_keys, unseen)
            self.seam_keys, self.seam_kept = np.insert(self.seam_keys, to, unseen), np.insert(self.seam_kept, to, kept)
            at = np.searchsorted(self.seam_keys, key)
        return self.seam_kept[at]

    def _last(self, points: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """last[i, m]: the piece that ends at character m of word i; and the words that got stuck."""
        n, width = points.shape
        h = np.zeros((width + 1, n), np.uint64)
        for j in range(width):
            h[j + 1] = h[j] * _BASE + points[:, j]
        last, stuck = np.zeros((width + 1, n), np.int64), np.zeros(n, bool)
        for m in range(1, width + 1):
            left = np.flatnonzero(length >= m)
            for k in range(min(m, self.widest), 0, -1):
                number = h[m, left] - h[m - k, left] * self.powers[k]
                maybe = np.flatnonzero(self.seen[(number * _ODD) >> np.uint64(44)])
                at = np.minimum(np.searchsorted(self.keys, number[maybe]), len(self.keys) - 1)
                there = self.keys[at] == number[maybe]
                maybe, piece = maybe[there], self.of[at[there]]
                if not len(maybe):
                    continue
                if m == k:
                    good = self.built[piece] if k > 1 else np.ones(len(piece), bool)
                else:
                    good = self._kept(last[m - k, left[maybe]], piece)
                last[m, left[maybe[good]]] = piece[good]
                left = np.delete(left, maybe[good])
                if not len(left):
                    break
            stuck[left] = True
            length = np.where(stuck, 0, length)
        return last.T, stuck

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many of each word, whether they decode to it) of words that begin with SPACE or nothing."""
        c, n = self.codec, len(words)
        for x in set("".join(words)).difference(c.number):
            c._char(x)
        self._tables()
        size = np.fromiter(map(len, words), np.int64, n)
        count, parts = np.zeros(n, np.int64), []  # parts: word, place in its ids, id
        low = 0
        for width in WIDTHS:
            own = np.flatnonzero((size > low) & (size <= width))
            low = width
            if not len(own):
                continue
            points = np.array([words[i] for i in own.tolist()], f"<U{width}").view(np.uint32).reshape(len(own), width).astype(np.uint64)
            last, stuck = self._last(points, size[own])
            at, back = np.where(stuck, 0, size[own]), []
            while len(going := np.flatnonzero(at)):
                piece = last[going, at[going]]
                back.append((going, piece))
                at[going] -= self.length[piece]
            steps = np.zeros(len(own), np.int64)
            for going, _ in back:
                steps[going] += 1
            ends = np.cumsum(steps)
            path = np.empty(int(ends[-1]), np.int64)
            for k, (going, piece) in enumerate(back):
                path[ends[going] - 1 - k] = piece
            each = self.n_ids[path]
            upto = np.concatenate([[0], np.cumsum(each)])
            count[own] = upto[ends] - upto[ends - steps]
            parts.append((own, _picked(self.ids, self.first_id[path], each)))
            if stuck.any():
                size[own[stuck]] = COMMIT_AT + 1  # left to the stream
        alone = [c.stream(words[i]) for i in np.flatnonzero(size > COMMIT_AT).tolist()]
        if alone:
            own = np.flatnonzero(size > COMMIT_AT)
            count[own] = [len(x) for x in alone]
            parts.append((own, np.fromiter(chain.from_iterable(alone), np.int32)))
        starts = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int32)
        for own, found in parts:
            own = own[count[own] > 0] if not alone or own is not parts[-1][0] else own
            held = count[own]
            ids[np.repeat(starts[own] - (np.cumsum(held) - held), held) + np.arange(len(found))] = found
        return ids, count, self._same(words, ids, starts, count)

    def _same(self, words: list[str], ids: np.ndarray, starts: np.ndarray, count: np.ndarray) -> np.ndarray:
        want = [w.replace(SPACE, " ").encode("utf-8", "surrogatepass") for w in words]
        upto = np.concatenate([[0], np.cumsum(self.n_raw[ids])])
        size = upto[starts + count] - upto[starts]
        same = size == np.fromiter(map(len, want), np.int64, len(want))
        made = _picked(self.raw, self.first_raw[ids], self.n_raw[ids])
        if same.all():
            wrong = np.concatenate([[0], np.cumsum(made != np.frombuffer(b"".join(want), np.uint8))])
            return wrong[upto[starts + count]] == wrong[upto[starts]]
        return np.array([made[upto[a] : upto[a + n]].tobytes() == w for a, n, w in zip(starts.tolist(), count.tolist(), want, strict=True)])


def _plain(together: Together, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """Ids of texts, none of them empty, in which a blank only stands alone and between words; and whether they decode to the text.

    A text is cut at blanks and line ends over the bytes of all texts at once. A word is encoded with the blank in front of it, once for all the places where it
    stands; ids are put together by position. Every word decodes by itself, so a text does if its words do.
    """
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    blank = (data == 32) | (data == 10)
    cut = np.flatnonzero(blank)
    of = np.searchsorted(offsets, cut, "right") - 1
    seen = np.searchsorted(cut, offsets)
    first = np.arange(n) + seen[:-1]  # the first word of each text, and the last
    last = first + np.diff(seen)
    at = np.arange(len(cut)) + of  # the word that a cut ends
    starts, ends, line = np.empty(n + len(cut), np.int64), np.empty(n + len(cut), np.int64), np.zeros(n + len(cut), bool)
    starts[first], starts[at + 1], ends[at], ends[last] = offsets[:-1], cut + 1, cut, offsets[1:]
    line[at + 1] = data[cut] == 10
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[~blank])).dictionary_encode()
    key = words.indices.to_numpy().astype(np.int64) * 2 + line
    there = np.zeros(2 * len(words.dictionary), bool)
    there[key] = True
    part, names = (np.cumsum(there) - 1)[key], words.dictionary.to_pylist()
    ids, sizes, same = together([names[k >> 1] if k & 1 else SPACE + names[k >> 1] for k in np.flatnonzero(there).tolist()])
    # A line end in front of a word is one more part, with ids of its own.
    end_ids = np.array(together.codec.bare["\n"], np.int32)
    pool = np.concatenate([ids, end_ids])
    parts = np.arange(len(part)) + np.cumsum(line)  # where the words go when line ends are among them
    begins, counts = np.full(int(parts[-1]) + 1, len(ids)), np.full(int(parts[-1]) + 1, len(end_ids))
    begins[parts], counts[parts] = (np.cumsum(sizes) - sizes)[part], sizes[part]
    upto = np.cumsum(counts)[parts[last]]
    ok = np.logical_and.reduceat(same[part], first)
    if together.codec.decode(end_ids.tolist()) != "\n":
        ok &= ~np.logical_or.reduceat(line, first)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]), pa.int32()), pa.array(_picked(pool, begins, counts))), ok


def encode_all(together: Together, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """Ids of each text (null: none) and whether they decode to it."""
    texts = pc.fill_null(texts, "")
    odd = pc.or_(pc.or_(pc.equal(texts, ""), pc.starts_with(texts, " ")), pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SPACE)))
    odd = odd.to_numpy(zero_copy_only=False)
    plain = np.flatnonzero(~odd)
    lists, same = _plain(together, texts.take(pa.array(plain))) if len(plain) else (pa.array([], pa.list_(pa.int32())), np.empty(0, bool))
    if len(plain) == len(texts):
        return lists, same
    codec, flat, ends, more = together.codec, array("i"), array("i", [0]), []
    for t in texts.take(pa.array(np.flatnonzero(odd))).to_pylist():
        ids = codec.encode(t)
        flat.extend(ids)
        ends.append(len(flat))
        more.append(codec.decode(ids) == t)
    both = pa.concat_arrays([lists, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))])
    order = np.empty(len(texts), np.int64)
    order[np.concatenate([plain, np.flatnonzero(odd)])] = np.arange(len(texts))
    return both.take(pa.array(order)), np.concatenate([same, np.array(more, bool)])[order]


def encode(docs: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_ids, ids and whether they decode to the very text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model))

    def run(batches):
        fresh()
        together = Together(Codec(shared.value))
        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                ids, same = encode_all(together, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pc.cast(pc.list_value_length(ids), pa.int64()), ids, pa.array(same)], ["doc_id", "n_ids", "ids", "round_trip"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_ids long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: doc_id and the text of the ids (null ids: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(model))

    def run(batches):
        codec = Codec(shared.value)
        for batch in batches:
            out = [codec.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
