"""Substring dedup by a common-prefix-aware distributed merge sort of suffixes.

A byte goes when it is covered by a string of ``length`` bytes that also starts
earlier.  Equal strings are neighbours among the sorted suffixes, so suffixes
are sorted, but only those that can repeat, and only as far as tells:

1.  The anchor of a string is its ``gram``-byte piece of least hash: equal
    strings have equal anchors.  Tasks send the anchors' hashes out to be counted;
    strings whose anchor occurs once in the corpus are unique and stay behind.
2.  Consecutive strings of one anchor are one suffix, cut where the last of them
    ends.  A chunk's suffixes are sorted into a run, equal ones collapse to the
    earliest, and the run travels front-coded: for each suffix the length of the
    prefix that it shares with the one before, and the rest of its bytes.
3.  Ranges of the sorted order are merged by a loser tree.  A suffix that meets
    another is known to share a prefix with the last winner; unequal prefix
    lengths decide at once, equal ones let the comparison start behind them, so
    no byte of a known prefix is compared again.  Suffixes equal to the one
    before them are repeats.
4.  What is left are distinct suffixes.  Those whose anchor is in another one too
    may still share some of their strings: they go the same way as texts of their
    own, with longer anchors and so shorter suffixes, at last each string alone.

All comparisons are of bytes; hashes only leave out what cannot repeat.
"""

from __future__ import annotations

import gc
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequor.llm.chunks import CHUNK_BYTES, Chunks, opened
from sequor.llm.hashing import mix64, trim
from sequor.llm.packing import packed, unpacked
from sequor.operators.storage import materialize, release

#: Bytes of text that hashes are made for at a time, few enough for a core's cache.
SEGMENT_BYTES = 48 << 10
#: Anchors that a task counts; suffixes of a front-coded piece, and of a range of the order.
BUCKET_MARKS = 2_000_000
PIECE_ROWS = 512
RANGE_ROWS = 200_000
#: Runs that one loser tree merges; more are merged in groups first.
FAN_IN = 512
#: Suffixes sampled to place the borders of ranges (64 bytes each); the sample decides on balance alone.
SAMPLE_ROWS = 20_000
#: Anchors (8 bytes each) that several distinct suffixes have, up to which they may be broadcast.
BROADCAST_ROWS = 1_000_000
_POSITION = 20
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)


def grams(length: int) -> list[int]:
    """Bytes of the anchors of each level: a power of two within a third of a string, then nearer to all of it, then all."""
    first = 1 << max(0, (length // 3).bit_length() - 1)
    return sorted({min(first, length), length - (length - first) // 4, length})


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` bytes: each power of two mixed from two halves, other sizes from two that overlap."""
    h = _BYTES[data]
    span = 1
    with np.errstate(over="ignore"):
        while span < size:
            step = min(span, size - span)
            h = h[:-step] * _A + h[step:]
            h ^= h >> np.uint64(32)
            h *= _B
            span += step
    return h


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (width - span)], v[width - span :]) if span < width else v


def _suffixes(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(first, count, mark)`` of the runs of strings that share an anchor, for segments of ``data`` that start at ``at``."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n <= 0:
        return none
    h = _gram_hashes(data, gram)
    place = np.arange(len(h), dtype=np.uint64)
    low = np.uint64((1 << _POSITION) - 1)
    # among equal hashes the leftmost is least, wherever the string stands
    anchor = (_least((h & ~low) | place, length - gram + 1) & low).astype(np.int64)
    ends = np.append(at[1:], len(data))
    inside = np.zeros(n + 1, dtype=np.int32)
    some = ends - at >= length
    np.add.at(inside, at[some], 1)
    np.add.at(inside, ends[some] - length + 1, -1)
    valid = np.cumsum(inside[:n]) > 0
    cut = valid.copy()
    cut[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    cut[at[some]] = True
    first = np.flatnonzero(cut)
    # a run goes on to the next cut or to where its segment has no more strings
    stop = np.minimum(np.append(first[1:], n), ends[np.searchsorted(at, first, side="right") - 1] - length + 1)
    return first, stop - first, mix64(~h[anchor[first]]) >> np.uint64(16)


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Groups of segments ``(row, offset)`` and their bytes; long texts are cut so that no string is lost."""
    who, parts, held = [], [], 0
    for row, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - length + 1), SEGMENT_BYTES):
            part = text[offset : offset + SEGMENT_BYTES + length - 1]
            if held and held + len(part) > 2 * SEGMENT_BYTES:
                yield who, parts
                who, parts, held = [], [], 0
            who.append((row, offset))
            parts.append(part)
            held += len(part)
    if parts:
        yield who, parts


def _all_suffixes(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(row, start, count, mark)`` of all runs of strings of some texts."""
    out: list[tuple] = []
    for who, parts in _segments(texts, length):
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
        keep = np.array([len(p) > 0 for p in parts])
        where, at = np.array(who, dtype=np.int64)[keep], at[keep]
        if len(at):
            first, count, mark = _suffixes(np.frombuffer(b"".join(parts), np.uint8), at, length, gram)
            seg = np.searchsorted(at, first, side="right") - 1
            out.append((where[seg, 0], where[seg, 1] + first - at[seg], count, mark))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def lcp(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, of which the first ``at`` bytes are known."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    while a[at : at + 8] == b[at : at + 8]:
        at += 8
    while a[at] == b[at]:
        at += 1
    return at


class LoserTree:
    """Merge of sorted runs of ``(suffix, prefix shared with the one before, ...)``.

    ``shared[r]`` is what the head of run ``r`` shares with the last suffix that
    left the tree; the head with more of it is the lesser.  Only heads that share
    equally much are compared, and only behind that.
    """

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.shared = [-1 if x is None else 0 for x in self.heads]
        self.losers = [0] * self.size
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        self.losers[node] = b
        return self._meet(node, a)

    def _meet(self, node: int, run: int) -> int:
        """The lesser of ``run`` and the loser at ``node``; the other stays there."""
        other, shared = self.losers[node], self.shared
        mine, its = shared[run], shared[other]
        if mine > its:
            return run
        if mine == its:
            if mine < 0:
                return run
            a, b = self.heads[run][0], self.heads[other][0]
            both = lcp(a, b, mine)
            if both == len(a) or (both < len(b) and a[both] < b[both]):
                shared[other] = both
                return run
            shared[run] = both
        self.losers[node] = run
        return other

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        """Each suffix in order, with the length of the prefix that it shares with the one before."""
        heads, shared, losers, runs, winner = self.heads, self.shared, self.losers, self.runs, self.winner
        while shared[winner] >= 0:
            yield heads[winner], shared[winner]
            head = heads[winner] = next(runs[winner], None)
            mine = shared[winner] = -1 if head is None else head[1]
            # as _meet, from the leaf up
            run, node = winner, (winner + self.size) >> 1
            while node:
                other = losers[node]
                its = shared[other]
                if mine < its:
                    losers[node], run, mine = run, other, its
                elif mine == its and mine >= 0:
                    a, b = heads[run][0], heads[other][0]
                    both = lcp(a, b, mine)
                    if both == len(a) or (both < len(b) and a[both] < b[both]):
                        shared[other] = both
                    else:
                        shared[run] = both
                        losers[node], run = run, other
                node >>= 1
            winner = run


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Bytes and tuples make no cycles, and looking for them takes a fifth of the time of sorting and merging."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class Run:
    """Suffixes of one task: equal ones collapse to the earliest, the rest is sorted and front-coded.

    A place is ``(null, id, row, start)`` and orders documents and strings; its
    chunk and anchor go along.
    """

    def __init__(self) -> None:
        self.earliest: dict[bytes, tuple] = {}
        self.cuts: list[tuple[int, int, int, int]] = []

    def add(self, suffix: bytes, place: tuple) -> None:
        old = self.earliest.get(suffix)
        if old is None:
            self.earliest[suffix] = place
            return
        if place < old:
            self.earliest[suffix], place = place, old
        self.cuts.append((place[4], place[2], place[3], len(suffix)))


_KINDS = (np.uint8, np.int64, np.int64, np.int64, np.int64, np.int64)


def _piece(suffixes: list[bytes], places: list[tuple]) -> bytes:
    shared = [0, *map(lcp, suffixes, suffixes[1:])]
    rest = b"".join(s[k:] for s, k in zip(suffixes, shared))
    columns = [np.array(x, dtype=k) for x, k in zip(zip(*places), _KINDS)]
    return packed(np.array(shared, np.uint32), np.array([len(s) for s in suffixes], np.uint32), np.frombuffer(rest, np.uint8), *columns)


def _opened(pieces: list[bytes]) -> Iterator[tuple]:
    """``(suffix, prefix shared with the one before, place)`` of a run's pieces, one unpacked at a time."""
    last = b""
    for blob in pieces:
        shared, size, rest, *places = unpacked(blob)
        raw, at, s = rest.tobytes(), 0, b""
        for k, n, place in zip(shared.tolist(), size.tolist(), zip(*(p.tolist() for p in places))):
            s = s[:k] + raw[at : at + n - k]
            at += n - k
            # a piece starts with a whole suffix
            yield s, k or lcp(last, s), place
            last = s


_DEALT = pa.schema([("part", pa.int32()), ("team", pa.int32()), ("run", pa.string()), ("first", pa.binary()), ("blob", pa.binary()), ("chunk", pa.int64())])
_DEALT_SQL = "part int, team int, run string, first binary, blob binary, chunk long"
_MERGED = pa.schema([("chunk", pa.int64()), ("cuts", pa.binary()), ("s", pa.binary()), ("null", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("mark", pa.int64())])
_MERGED_SQL = "chunk long, cuts binary, s binary, null int, doc_id long, row long, start long, mark long"


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _sent(name: str, ordered: list[tuple[bytes, tuple]], cuts: list[tuple], borders: list[bytes], teams: int) -> pa.RecordBatch:
    """A sorted run by range, in pieces, and what it has cut by itself (parts below 0)."""
    team, rows, at = zlib.crc32(name.encode()) % teams, [], 0
    keys = [s for s, _ in ordered]
    while at < len(keys):
        part = bisect_right(borders, keys[at])
        end = bisect_right(keys, borders[part], lo=at) if part < len(borders) else len(keys)
        # a suffix equal to a border belongs behind it
        while end > at and part < len(borders) and keys[end - 1] == borders[part]:
            end -= 1
        for i in range(at, end, PIECE_ROWS):
            some = ordered[i : min(end, i + PIECE_ROWS)]
            rows.append((part, team, name, some[0][0], _piece([s for s, _ in some], [p for _, p in some]), None))
        at = end
    rows += [(-1 - chunk % (len(borders) + 1), 0, None, None, blob, chunk) for chunk, blob in _cut_rows(cuts)]
    return _rows(_DEALT, rows)


def _cut_rows(cuts: list[tuple[int, int, int, int]]) -> list[tuple[int, bytes]]:
    """Cuts ``(chunk, row, start, bytes)`` by chunk, as maximal spans."""
    if not cuts:
        return []
    c, r, s, n = np.array(cuts, dtype=np.int64).T
    order = np.argsort(c, kind="stable")
    c, r, s, e = c[order], (r - c)[order], s[order], (s + n)[order]
    edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    return [(int(c[i]), packed(*_spans(r[i:j], s[i:j], e[i:j]))) for i, j in zip(edge, np.append(edge[1:], len(c)))]


def _spans(r: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal spans of intervals, by row and start."""
    order = np.lexsort((s, r))
    r, s, e = r[order], s[order], e[order]
    # rows are kept apart by a step that no text reaches
    step = np.int64(1) << np.int64(32)
    reach = np.maximum.accumulate(r * step + e) if len(r) else e
    new = np.ones(len(r), dtype=bool)
    new[1:] = r[1:] * step + s[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(r)) - 1 if len(r) else first
    return r[first], s[first], reach[last] - r[first] * step


def _merged(borders: list[bytes], teams: int, last_level: bool):
    """One range of the order: repeats as cuts, and each distinct suffix where it starts first (as a run, while teams remain)."""

    def merged(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            cuts = [(c, b) for c, b in zip(table.column("chunk").to_pylist(), table.column("blob").to_pylist())]
            if teams > 1:
                return table
            return pa.Table.from_batches([_rows(_MERGED, [(c, b, *[None] * 6) for c, b in cuts])])
        part, team = table.column("part")[0].as_py(), table.column("team")[0].as_py()
        table = table.sort_by([("run", "ascending"), ("first", "ascending")])
        runs: dict[str, list[bytes]] = {}
        for name, blob in zip(table.column("run").to_pylist(), table.column("blob").to_pylist()):
            runs.setdefault(name, []).append(blob)
        del table
        cuts, kept, last, best = [], [], None, None
        for (s, _, place), shared in LoserTree([_opened(p) for p in runs.values()]):
            if last is not None and shared == len(s) == len(last):
                if place < best:
                    best, place = place, best
                cuts.append((place[4], place[2], place[3], len(s)))
                continue
            if last is not None:
                kept.append((last, best))
            last, best = s, place
        if last is not None:
            kept.append((last, best))
        if teams > 1:
            return pa.Table.from_batches([_sent(f"{part}-{team}", kept, cuts, borders, 1)])
        rows = [(c, b, *[None] * 6) for c, b in _cut_rows(cuts)]
        if not last_level:
            rows += [(p[4], None, s, p[0], p[1], p[2], p[3], p[5]) for s, p in kept]
        out = pa.Table.from_batches([_rows(_MERGED, rows)])
        trim()
        return out

    def run(table: pa.Table) -> pa.Table:
        with _no_cycles():
            return merged(table)

    return run


def _edges(marks: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of sorted 48-bit marks starts and ends."""
    return np.searchsorted(marks, np.array([-(-(b << 48) // buckets) for b in range(buckets + 1)], dtype=np.uint64))


_COUNTED_SQL = "bucket int, chunk long, marks binary, keys array<long>, heads array<binary>"
_COUNTED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("marks", pa.binary()), ("keys", pa.list_(pa.int64())), ("heads", pa.list_(pa.binary()))])


def _counted(length: int, gram: int, buckets: int, every: int):
    """A chunk's distinct anchors by bucket, which of them it has several times, and of some the suffix's head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                texts = opened(batch.column(1)[at].as_py()).texts
                row, start, _, mark = _all_suffixes(texts, length, gram)
                marks, first, n = np.unique(mark, return_index=True, return_counts=True)
                cut, rows = _edges(marks, buckets), []
                for b, (i, j) in enumerate(zip(cut, cut[1:])):
                    if j > i:
                        own = i + np.flatnonzero(marks[i:j] % np.uint64(every) == 0)
                        heads = [texts[row[k]][start[k] : start[k] + 64] for k in first[own].tolist()]
                        rows.append((b, batch.column(0)[at].as_py(), packed(np.diff(marks[i:j], prepend=np.uint64(0)), np.packbits(n[i:j] > 1)), marks[own].astype(np.int64).tolist(), heads))
                yield _rows(_COUNTED, rows)
        trim()

    return run


_FLAGS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary()), ("n", pa.int64()), ("heads", pa.list_(pa.binary()))])


def _repeated(table: pa.Table) -> pa.Table:
    """For each chunk of a bucket, a bit for each of its anchors in order: does it occur twice at least?"""
    chunks, marks, many = table.column("chunk").to_pylist(), [], []
    for blob in table.column("marks").to_pylist():
        gaps, bits = unpacked(blob)
        marks.append(np.cumsum(gaps, dtype=np.uint64))
        many.append(np.unpackbits(bits, count=len(gaps)).astype(bool))
    ends = np.cumsum([len(m) for m in marks])
    every, flags = np.concatenate(marks), np.concatenate(many)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    bucket = table.column("bucket")[0].as_py()
    out = []
    for c, m, e, keys, heads in zip(chunks, marks, ends, table.column("keys").to_pylist(), table.column("heads").to_pylist()):
        own = flags[e - len(m) : e]
        told = [h for k, h in zip(keys, heads) if own[np.searchsorted(m, np.uint64(k))]]
        out.append((c, bucket, np.packbits(own).tobytes(), int(own.sum()), told))
    del every, flags, order
    trim()
    return pa.Table.from_batches([_rows(_FLAGS, out)])


def _runs(length: int, gram: int, buckets: int, borders: list[bytes], teams: int):
    """A chunk's run of suffixes whose anchors occur twice at least."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                chunk, rows = batch.column(0)[at].as_py(), opened(batch.column(1)[at].as_py())
                row, start, count, mark = _all_suffixes(rows.texts, length, gram)
                marks, which = np.unique(mark, return_inverse=True)
                cut, flags = _edges(marks, buckets), np.zeros(len(marks), dtype=bool)
                for x in batch.column(2)[at].as_py() or []:
                    i, j = cut[x["bucket"]], cut[x["bucket"] + 1]
                    flags[i:j] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=j - i)
                keep = np.flatnonzero(flags[which])
                # a document starts at 0 and is at home in its chunk; a suffix brings its own
                n = len(rows.texts)
                lines, begins, homes = rows.more or (chunk + np.arange(n), np.zeros(n, np.int64), np.full(n, chunk))
                own, nulls, docs, texts, lines, begins, homes = Run(), rows.null.tolist(), rows.ids.tolist(), rows.texts, lines.tolist(), begins.tolist(), homes.tolist()
                for r, s, n, m in zip(row[keep].tolist(), start[keep].tolist(), count[keep].tolist(), mark[keep].tolist()):
                    own.add(texts[r][s : s + n + length - 1], (nulls[r], docs[r], lines[r], begins[r] + s, homes[r], m))
                yield _sent(str(chunk), sorted(own.earliest.items()), own.cuts, borders, teams)
        trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _no_cycles():
            yield from runs(batches)

    return run


def _borders(heads: DataFrame, n: int, parts: int) -> list[bytes]:
    """Borders of ``parts`` ranges, from about ``SAMPLE_ROWS`` of ``n`` rows of ``heads(h)``."""
    if parts < 2:
        return []
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    some = heads.where(F.rand(17) < share) if share < 1 else heads
    found = sorted(bytes(r.h) for r in some.collect())
    return sorted({found[k * len(found) // parts] for k in range(1, parts)}) if found else []


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of a chunk's texts."""
    for batch in batches:
        for at in range(batch.num_rows):
            rows = opened(batch.column(1)[at].as_py())
            cuts = [unpacked(x["cuts"]) for x in batch.column(2)[at].as_py() or []]
            r, s, e = _spans(*(np.concatenate(x) for x in zip(*cuts))) if cuts else (np.zeros(0, np.int64),) * 3
            edge = np.searchsorted(r, np.arange(len(rows.texts) + 1))
            s, e = s.tolist(), e.tolist()
            size, gone, spans, kept = [], [], [], []
            for text, i, j in zip(rows.texts, edge.tolist(), edge[1:].tolist()):
                begins = [0, *e[i:j]]
                kept.append(b"".join(text[a:b] for a, b in zip(begins, [*s[i:j], len(text)])))
                size.append(len(text))
                gone.append(len(text) - len(kept[-1]))
                spans.append(j - i)
            ids = pa.array(rows.ids, mask=rows.null.astype(bool))
            for i in range(0, len(size), 1000):
                j = slice(i, i + 1000)
                yield pa.RecordBatch.from_arrays([ids[j], pa.array(size[j], pa.int64()), pa.array(gone[j], pa.int64()), pa.array(spans[j], pa.int64()), pa.array(kept[j], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    trim()


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN, bucket_marks: int = BUCKET_MARKS) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` of every row: its UTF-8 bytes less those covered by a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller id, or the same document and an earlier start; a null
    id comes last, and rows that share an id are documents of their own, in the
    order of the table.  Strings are judged on the input and never cross
    documents.  ``kept`` is binary, as a cut may fall within a character.
    Null and empty texts, and those shorter than ``length``, lose nothing; very
    long texts are hashed in segments and lose what they should.  Other columns
    are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = now = Chunks(docs, "bytes", chunk_bytes)
    levels = []
    for gram in grams(length):
        levels.append(_level(now, length, gram, range_rows, fan_in, bucket_marks))
        if now is not chunks:
            now.release()
        distinct = levels[-1].where("s is not null")
        shared = materialize(distinct.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "shared")
        few = shared.count()
        if not few:
            break
        again = distinct.join(F.broadcast(shared) if few <= BROADCAST_ROWS else shared, "mark", "left_semi")
        again = again.select(F.when(F.col("null") == 0, F.col("doc_id")).alias("doc_id"), F.col("s").alias("text"), "row", "start", "chunk")
        now = Chunks(again, "suffixes", chunk_bytes, ("row", "start", "chunk"))
        release(shared)
    cuts = levels[0]
    for more in levels[1:]:
        cuts = cuts.union(more)
    return chunks.joined(cuts.where("cuts is not null").select("chunk", "cuts"), "cuts").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _level(chunks: Chunks, length: int, gram: int, range_rows: int, fan_in: int, bucket_marks: int) -> DataFrame:
    """Repeats among the suffixes of one level as cuts by chunk, and, but for the last level, its distinct suffixes."""
    last = gram == length
    strings = max(0, chunks.bytes - chunks.rows * (length - 1)) if chunks.rows and chunks.bytes // chunks.rows < 4 * length else chunks.bytes
    # an anchor stands for half its window's strings, about
    n_marks = 2 * strings // (length - gram + 2) + chunks.rows
    buckets = max(4, -(-n_marks // bucket_marks))
    every = max(1, n_marks // (8 * SAMPLE_ROWS))
    counted = chunks.table.mapInArrow(_counted(length, gram, buckets, every), _COUNTED_SQL)
    flags = counted.groupBy("bucket").applyInArrow(_repeated, "chunk long, bucket int, bits binary, n long, heads array<binary>")
    flags = materialize(flags, "flags")
    n, n_heads, n_chunks = flags.agg(F.sum("n"), F.sum(F.size("heads")), F.count_distinct("chunk")).first()
    borders = _borders(flags.select(F.explode("heads").alias("h")), n_heads or 0, -(-(n or 0) // range_rows))
    teams = -(-(n_chunks or 1) // fan_in)
    sent = chunks.joined(flags.where("n > 0").select("chunk", "bucket", "bits"), "bits").mapInArrow(_runs(length, gram, buckets, borders, teams), _DEALT_SQL)
    if teams > 1:
        sent = sent.groupBy("part", "team").applyInArrow(_merged(borders, teams, last), _DEALT_SQL)
    out = materialize(sent.groupBy("part", "team").applyInArrow(_merged(borders, 1, last), _MERGED_SQL), "level", "zstd")
    release(flags)
    return out
