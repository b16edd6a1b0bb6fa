"""Sentence pieces: texts to ids by vectorised merge rounds, and ids back to texts.

A text is one space before it and spaces as their sign, cut into words (blanks and what follows them); a model whose pieces
hold the sign at their beginning only never joins across such a cut. The words that a worker doesn't know yet are merged together, as flat
arrays of symbols: each round finds every word's best pair, merges its occurrences from the left at the same time, and closes
the gaps; words without a pair are done. Nothing is shuffled: a row goes in, its result comes out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.llm.common import table

MODEL = "piece_bpe_32k.model"
SIGN = "▁"
#: Bytes of text coded at once, and characters of new words merged at once.
BATCH_BYTES, TOGETHER = 1 << 22, 1 << 20
#: Words that a worker remembers, of at most LONGEST characters each.
CACHED, LONGEST = 400_000, 48
NEVER = np.int64(1 << 40)
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A model's tables. It must be a pair-merging model with bytes for unknown characters, and leave texts as they are but for a blank in front."""

    def __init__(self, path: str, cached: int = CACHED):
        from sentencepiece import sentencepiece_model_pb2

        model, self.cached = sentencepiece_model_pb2.ModelProto(), cached
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        names, kinds, scores = [p.piece for p in model.pieces], np.array([p.type for p in model.pieces]), np.array([p.score for p in model.pieces])
        to, normal = model.trainer_spec, {p: i for i, p in enumerate(names) if kinds[i] == NORMAL}
        blanks = [i for p, i in normal.items() if len(p) > 1 and set(p) == {SIGN}]
        worst = min((scores[i] for p, i in normal.items() if len(p) > 1 and set(p) != {SIGN}), default=0)
        fits = (
            to.model_type == to.BPE and to.byte_fallback and not to.treat_whitespace_as_suffix and not model.normalizer_spec.precompiled_charsmap and model.normalizer_spec.add_dummy_prefix
            and not model.normalizer_spec.remove_extra_whitespaces and model.normalizer_spec.escape_whitespaces and not ({USER, UNUSED} & set(kinds.tolist()))
            and all(SIGN not in p[1:] for p in normal if set(p) != {SIGN}) and all(scores[i] < worst for i in blanks) and SIGN in normal
        )
        if not fits:
            raise ValueError(f"{path}: not a pair-merging model with byte pieces, a blank in front and blanks only there")
        self.size, self.normal, self.scores = len(names), normal, scores
        self.unknown = " ⁇ " if not to.unk_surface else to.unk_surface
        # What an id stands for in a decoded text.
        shown = [p.replace(SIGN, " ").encode() if kinds[i] == NORMAL else bytes([int(p[3:5], 16)]) if kinds[i] == BYTE else self.unknown.encode() if kinds[i] == UNKNOWN else b"" for i, p in enumerate(names)]
        self.shown, self.shown_at = _flat(shown)
        self.byte, self.is_byte = np.zeros(256, np.int64), kinds == BYTE
        for i in np.flatnonzero(self.is_byte).tolist():
            self.byte[int(names[i][3:5], 16)] = i
        self.control, self.blank_first = kinds == CONTROL, {i for p, i in normal.items() if p[0] == SIGN}
        # Characters to symbols: a piece, or beyond all pieces the character itself.
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size
        linked = set()
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
            linked.update(ord(a) << 21 | ord(b) for a, b in zip(p, p[1:], strict=False))
        # Characters that stand together in no piece are never joined; blanks are joined last of all, on their own.
        linked.discard(ord(SIGN) << 21 | ord(SIGN))
        self.linked = np.array(sorted(linked), np.int64)
        # Pairs of pieces that make a piece. A lower rank is merged first; equal scores have one rank.
        ranks = {s: r for r, s in enumerate(sorted({float(scores[i]) for i in normal.values()}, reverse=True))}
        pairs = {}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                if (a := normal.get(p[:cut])) is not None and (b := normal.get(p[cut:])) is not None:
                    pairs[a * self.size + b] = (ranks[float(scores[i])], i)
        keys = sorted(pairs)
        self.pair = np.array([*keys, self.size**2], np.int64)
        self.rank = np.array([*(pairs[k][0] for k in keys), NEVER], np.int64)
        self.made = np.array([*(pairs[k][1] for k in keys), -1], np.int64)
        self.runs = lru_cache(maxsize=1024)(self._run)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.starts = np.empty(1 << 16, np.int32), np.zeros(1 << 12, np.int64)
        self.words = 0

    def _run(self, n: int) -> tuple[int, ...]:
        """Ids of n blanks that nothing else joins: the best pair first, from the left."""
        own = [self.normal[SIGN]] * n
        width, after, before = [1] * n, [*range(1, n), -1], [-1, *range(n - 1)]

        def pair(i: int) -> tuple[float, int, int, int] | None:
            j = after[i]
            made = self.normal.get(SIGN * (width[i] + width[j])) if j >= 0 else None
            return None if made is None else (-self.scores[made], i, width[i], width[j])

        open_ = [p for i in range(n - 1) if (p := pair(i))]
        heapify(open_)
        while open_:
            _, i, a, b = heappop(open_)
            j = after[i]
            if width[i] != a or j < 0 or width[j] != b:
                continue
            width[i], width[j], after[i] = a + b, 0, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            own[i] = self.normal[SIGN * width[i]]
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heappush(open_, p)
        return tuple(o for o, w in zip(own, width, strict=True) if w)

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, made piece) of pairs of symbols; NEVER if they make none."""
        keys = np.where((a < self.size) & (b < self.size), a * self.size + b, self.size**2)
        at = np.searchsorted(self.pair, keys)
        hit = self.pair[at] == keys
        return np.where(hit, self.rank[at], NEVER), self.made[at]

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words one after another, how many are each one's) after all merges but those of blanks."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        key = chars[:-1] << 21 | chars[1:]
        at = np.minimum(np.searchsorted(self.linked, key), len(self.linked) - 1)
        split = np.ones(len(chars), bool)  # a part begins here
        split[1:] = (self.linked[at] != key) | (word[1:] != word[:-1])
        symbols, place = self.symbol[chars], np.arange(len(chars))
        done_symbols, done_places = [], []
        rank = np.full(len(chars), NEVER)
        made = np.full(len(chars), -1, np.int64)
        inside = np.flatnonzero(~split[1:])
        rank[inside], made[inside] = self._ranked(symbols[inside], symbols[inside + 1])
        starts = np.flatnonzero(split)
        while len(symbols):
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(starts, append=len(symbols))
            alive = np.repeat(least < NEVER, lengths)
            if not alive.all():  # parts without a pair leave
                done_symbols.append(symbols[~alive])
                done_places.append(place[~alive])
                symbols, place, rank, made = symbols[alive], place[alive], rank[alive], made[alive]
                least, lengths = least[least < NEVER], lengths[least < NEVER]
                starts = np.cumsum(lengths) - lengths
                if not len(symbols):
                    break
            part = np.repeat(np.arange(len(starts)), lengths)
            at = np.flatnonzero(rank == least[part])
            # From the left, an occurrence that overlaps a merged one is passed over.
            new_run = np.diff(at, prepend=-2) != 1
            first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            # Where a merge makes a pair that comes no later than this one, the part's merges behind it wait.
            made_at, own = made[at], part[at]
            last = starts + lengths - 1
            right = np.minimum(at + 2, len(symbols) - 1)
            next_rank = np.where(at + 2 <= last[own], self._ranked(made_at, symbols[right])[0], NEVER)
            left = np.maximum(at - 1, 0)
            touching = np.diff(at, prepend=-3) == 2
            before = np.where(touching, np.roll(made_at, 1), symbols[left])
            prior_rank = np.where(at > starts[own], self._ranked(before, made_at)[0], NEVER)
            soon = np.minimum(next_rank, prior_rank) <= least[own]
            if soon.any():
                stop = np.full(len(starts), len(symbols))
                np.minimum.at(stop, own[soon], at[soon])
                keep = at <= stop[own]
                at, made_at = at[keep], made_at[keep]
            symbols[at] = made_at
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            gone = np.bincount(part[at], minlength=len(starts))
            now = np.cumsum(stay) - 1
            symbols, place, rank, made = symbols[stay], place[stay], rank[stay], made[stay]
            lengths = lengths - gone
            starts = np.cumsum(lengths) - lengths
            # Only pairs beside a merge are new.
            ends = np.zeros(len(symbols), bool)
            ends[starts + lengths - 1] = True
            beside = np.zeros(len(symbols) + 1, bool)  # the last stands for what is before the first
            beside[now[at]] = beside[now[at] - 1] = True
            fresh = np.flatnonzero(beside[:-1])
            rank[fresh[ends[fresh]]] = NEVER
            fresh = fresh[~ends[fresh]]
            rank[fresh], made[fresh] = self._ranked(symbols[fresh], symbols[fresh + 1])
        symbols, place = np.concatenate([symbols, *done_symbols]), np.concatenate([place, *done_places])
        order = np.argsort(place, kind="stable")
        return symbols[order], np.bincount(word[place], minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        """Put the ids of each word at the end of the flat array, which doubles when it is full."""
        symbols, counts = self.merged(words)
        # Unknown characters become the bytes they are made of.
        odd = np.flatnonzero(symbols >= self.size)
        if len(odd):
            code, width = symbols[odd] - self.size, np.ones(len(symbols), np.int64)
            width[odd] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            counts = np.add.reduceat(width, np.cumsum(counts) - counts)
            begins = np.cumsum(width) - width
            symbols = np.repeat(symbols, width)
            flat, at = _flat([chr(c).encode("utf-8", "surrogatepass") for c in code.tolist()])
            symbols[np.arange(len(flat)) + np.repeat(begins[odd] - at[:-1], width[odd])] = self.byte[flat]
        # Blanks in front that nothing joined.
        starts = np.cumsum(counts) - counts
        blank = self.normal[SIGN]
        runs = np.flatnonzero((counts > 1) & (symbols[starts] == blank) & (symbols[np.minimum(starts + 1, len(symbols) - 1)] == blank))
        if len(runs):
            parts = np.split(symbols, starts[1:])
            for i in runs.tolist():
                n = int(np.argmax(parts[i] != blank)) if (parts[i] != blank).any() else len(parts[i])
                parts[i] = np.concatenate([np.array(self.runs(n), np.int64), parts[i][n:]])
            symbols, at = _flat(parts)
            counts = np.diff(at)
        at, n = int(self.starts[self.words]), len(words)
        while at + len(symbols) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.words + n >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[at : at + len(symbols)] = symbols
        self.starts[self.words + 1 : self.words + n + 1] = at + np.cumsum(counts)
        self.words += n

    def _slots(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words in the flat array; long ones are not remembered."""
        found = list(map(self.slot.get, words))
        new = [i for i, s in enumerate(found) if s is None]
        at, size = 0, 0
        for end, i in enumerate(new, 1):
            size += len(words[i])
            if size >= TOGETHER or end == len(new):
                first = self.words
                self._learn([words[k].replace(" ", SIGN) for k in new[at:end]])
                for j, k in enumerate(new[at:end], first):
                    found[k] = j
                at, size = end, 0
        self.slot.update((w, found[i]) for i in new if len(w := words[i]) <= LONGEST)
        return np.array(found, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many are each one's); texts without nulls. An empty text has none."""
        if len(self.slot) > self.cached or self.words > 2 * self.cached:
            self.forget()
        texts = pc.replace_substring(texts.cast(pa.large_string()), SIGN, " ")
        n, (_, offsets, data) = len(texts), texts.buffers()
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        full = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][full], 32)  # the blank in front
        ends = offsets[1:] + np.cumsum(full)
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        begins[0] = begins[-1] = True
        begins[ends] = True
        edges = np.flatnonzero(begins)
        if len(edges) == 1:
            return np.empty(0, np.int64), np.zeros(n, np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        slots, word = self._slots(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        first = self.starts[slots]
        count = (self.starts[slots + 1] - first)[word]
        total = np.concatenate([[0], np.cumsum(count)])
        return _gathered(self.ids, first[word], count), np.diff(total[np.searchsorted(edges, ends)], prepend=0)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Texts in UTF-8 of lists of ids one after another: one blank in front goes, bytes that are no character become U+FFFD, controls nothing."""
        ends = np.cumsum(counts)
        flat = _gathered(self.shown, self.shown_at[ids], self.shown_at[ids + 1] - self.shown_at[ids]).tobytes()
        at = np.concatenate([[0], np.cumsum(self.shown_at[ids + 1] - self.shown_at[ids])])
        out, controlled = [], self.control[ids]
        for begin, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            text = flat[at[begin] : at[end]]
            if text[:1] == b" " and ids[begin] in self.blank_first:
                text = text[1:]
            try:
                text.decode()
                plain = not controlled[begin:end].any()
            except UnicodeDecodeError:
                plain = False
            out.append(text if plain else self._mended(ids[begin:end]))
        return out

    def _mended(self, ids: np.ndarray) -> bytes:
        """As decode(), for one text with controls, or runs of bytes that are no UTF-8: each byte that begins no character is U+FFFD."""
        out, run, first = b"", b"", True
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.shown[self.shown_at[i] : self.shown_at[i + 1]].tobytes()
                continue
            at = 0
            while at < len(run):
                lead = run[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                try:
                    out += run[at : at + n].decode().encode()
                    at += n
                except UnicodeDecodeError:
                    out += "�".encode()
                    at += 1
            first, run = first and not at, b""
            if i < 0:
                break
            if not self.control[i]:
                text = self.shown[self.shown_at[i] : self.shown_at[i + 1]].tobytes()
                out += text[1:] if first and i in self.blank_first else text
                first = False
        return out


def _flat(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings or arrays one after another, and where each begins."""
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]).astype(np.int64)
    if parts and isinstance(parts[0], bytes):
        return np.frombuffer(b"".join(parts), np.uint8), at
    return np.concatenate(parts) if parts else np.empty(0, np.int64), at


def _gathered(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[first : first + count] of each, one after another."""
    before = np.cumsum(count) - count
    return flat[np.arange(int(count.sum())) + np.repeat(first - before, count)]


@lru_cache(maxsize=1)
def pieces(path: str, cached: int = CACHED) -> Pieces:
    """One for each Python worker, which keeps it for its next tasks."""
    return Pieces(path, cached)


def _slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of about BATCH_BYTES; null texts are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, at = len(column), 0
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1)
        yield at, column.slice(at, min(stop, n) - at)
        at = min(stop, n)


def _added(docs: DataFrame, run, new: str) -> DataFrame:
    """docs with what run makes of each batch behind its columns; columns of these names are replaced."""
    names = {n.lower() for n in (x.split()[0] for x in new.split(", "))}
    kept = [c for c in docs.columns if c.lower() not in names]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col("`text`").cast("string").alias("__piece_text"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _slices(b.column(b.num_columns - 1)):
                own = b.slice(at, len(texts))
                arrays = run(texts)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *arrays.values()], [*own.schema.names[:-1], *arrays])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), new])
    return rows.mapInArrow(mapped, schema)


def encode(docs: DataFrame, model: str | None = None, cached: int = CACHED) -> DataFrame:
    """docs with ids array<int>: the pieces of each text, without begin and end ids. Null and empty texts have none; a column ids is replaced.

    Rows that repeat are coded each for itself, and an empty table stays empty.
    """
    path = model or model_path()

    def run(texts: pa.Array) -> dict[str, pa.Array]:
        ids, counts = pieces(path, cached).encode(texts)
        return {"ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))}

    return _added(docs, run, "ids array<int>")


def decode(coded: DataFrame, model: str | None = None) -> DataFrame:
    """coded (ids array<int>) with decoded string, the text that the ids stand for; null ids give null. Ids must be the model's; null elements are skipped."""
    path = model or model_path()
    kept = [c for c in coded.columns if c.lower() not in ("decoded", "ids")]
    rows = coded.select(*(F.col(f"`{c}`") for c in kept), F.col("ids").cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for b in batches:
            lists = [None if x is None else [i for i in x if i is not None] for x in b.column(b.num_columns - 1).to_pylist()]
            ids = np.array([i for x in lists if x for i in x], np.int64)
            texts = own.decode(ids, np.array([len(x or ()) for x in lists], np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else t.decode() for x, t in zip(lists, texts, strict=True)], pa.string())], [*b.schema.names, "decoded"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "decoded string"])
    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str | None = None, cached: int = CACHED) -> DataFrame:
    """docs' columns but its text, with n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of what they decode to."""
    path = model or model_path()

    def run(texts: pa.Array) -> dict[str, pa.Array]:
        own = pieces(path, cached)
        if not hasattr(own, "decimals"):
            own.decimals = _flat([f"{i},".encode() for i in range(own.size)])
        ids, counts = own.encode(texts)
        names, at = own.decimals
        width = at[ids + 1] - at[ids]
        line = _gathered(names, at[ids], width).tobytes()
        ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        hashes = [hashlib.sha256(memoryview(line)[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
        back = [hashlib.sha256(t).hexdigest() for t in own.decode(ids, counts)]
        return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()), "decoded_sha256": pa.array(back, pa.string())}

    return _added(docs, run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string").drop("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
