"""Amino-acid and nucleotide sequences as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from sequor.functions.text import _col, digest, fold_missing

# Alphabets, signature parameters, conservative residue groups and codons.
CANONICAL = "ACDEFGHIKLMNPQRSTVWY"
AMBIGUOUS = "*BJOUXZ"
# members of a character class: residues before upper-casing, with the dotless i and the long s, whose capitals are I and S
SINGLE = "A-Za-z\u0131\u017f*"
KMER = 5
SIGNATURE_SIZE = 32
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
GROUPS = ("STA", "NEQK", "NHQK", "NDEQ", "QHRK", "MILV", "MILF", "HY", "FYW")
CODONS = {
    "human": {
        "A": "GCC", "C": "TGC", "D": "GAC", "E": "GAG", "F": "TTC", "G": "GGC", "H": "CAC", "I": "ATC", "K": "AAG", "L": "CTG",
        "M": "ATG", "N": "AAC", "P": "CCC", "Q": "CAG", "R": "AGA", "S": "AGC", "T": "ACC", "V": "GTG", "W": "TGG", "Y": "TAC",
    },
    "ecoli": {
        "A": "GCG", "C": "TGC", "D": "GAT", "E": "GAA", "F": "TTT", "G": "GGC", "H": "CAT", "I": "ATT", "K": "AAA", "L": "CTG",
        "M": "ATG", "N": "AAC", "P": "CCG", "Q": "CAG", "R": "CGT", "S": "AGC", "T": "ACC", "V": "GTG", "W": "TGG", "Y": "TAT",
    },
}
RESIDUE_CLASSES = {"hydrophobic": "AVILMC", "aromatic": "FWY", "positive": "KRH", "negative": "DE", "polar": "STNQ", "special": "GP"}


def squeeze(c: Column | str) -> Column:
    """Folded text without white space, in upper case."""
    return F.upper(F.regexp_replace(fold_missing(c), r"\s+", ""))


def residues(c: Column | str) -> Column:
    """A normalised amino-acid sequence, or null where a character is outside ``A-Z*``."""
    s = squeeze(c)
    return F.when(~s.rlike("[^A-Z*]"), s)


def has_only_residues(c: Column | str) -> Column:
    """Whether a text has only letters that have one letter of ``A-Z`` as capital, ``*`` and white space: no sharp s, no ligature."""
    return ~F.coalesce(_col(c).cast("string"), F.lit("")).rlike(rf"[^{SINGLE}\s]")


def strict_residues(c: Column | str) -> Column:
    """A normalised amino-acid sequence; one with another character fails the query and names its characters."""
    bad = F.array_sort(F.array_distinct(F.regexp_extract_all(_col(c), F.lit(rf"[^{SINGLE}\s]"), F.lit(0))))
    held = F.when(fold_missing(c) == "", F.lit("")).when(has_only_residues(c), residues(c))
    return F.coalesce(held, F.raise_error(F.concat(F.lit("not an amino-acid sequence, it has "), F.array_join(bad, " "))).cast("string"))


def nucleotides(c: Column | str) -> Column:
    """A normalised nucleotide sequence (U read as T), or null outside the IUPAC alphabet."""
    s = F.translate(squeeze(c), "U", "T")
    return F.when(~s.rlike("[^ACGTRYSWKMBDHVN]"), s)


def bad_characters(c: Column | str, allowed: str = "A-Z*") -> Column:
    """Sorted distinct characters that a sequence may not have."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(squeeze(c), F.lit(f"[^{allowed}]"), F.lit(0))))


def is_single_domain(format_: Column | str, domain: Column | str, heavy: Column | str, light: Column | str) -> Column:
    """An explicit single-domain construct: by format or domain type, never by name, and with a heavy chain alone."""
    told = F.lower(F.concat_ws(" ", F.coalesce(_col(format_), F.lit("")), F.coalesce(_col(domain), F.lit(""))))
    return (F.coalesce(_col(heavy), F.lit("")) != "") & (F.coalesce(_col(light), F.lit("")) == "") & told.rlike(r"\bvhh\b|\bnb\b|nanob(?:ody|odies)|single[- ]domain|single[- ]chain\s+vhh")


def identity(source, record_id, name, heavy, light, single_domain: Column) -> Column:
    """Entity id: both chains; or a single domain's chain; or else the record itself."""
    h, li = F.coalesce(_col(heavy), F.lit("")), F.coalesce(_col(light), F.lit(""))
    kind = F.when(h != "", "heavy").when(li != "", "light").otherwise("unsequenced")
    return F.concat(
        F.lit("ab_"),
        F.when((h != "") & (li != ""), digest(h, li)).when(single_domain, digest(F.lit("vhh"), h)).otherwise(digest(F.lit("source_record"), source, record_id, kind, name)),
    )


def quality(heavy: Column | str, light: Column | str, single_domain: Column, quarantined: Column, nucleotide: Column) -> Column:
    """Struct of pairing, lengths, single domain, ambiguous residues, quarantine, completeness and nucleotides."""
    h, li = F.coalesce(_col(heavy), F.lit("")), F.coalesce(_col(light), F.lit(""))
    pairing = F.when((h != "") & (li != ""), "paired").when(h != "", "heavy_only").when(li != "", "light_only").otherwise("no_full_chain")
    doubtful = F.array_sort(F.array_distinct(F.regexp_extract_all(F.concat(h, li), F.lit(f"[{AMBIGUOUS}]"), F.lit(0))))
    return F.struct(
        pairing.alias("pairing"),
        F.length(h).alias("heavy_length"),
        F.length(li).alias("light_length"),
        single_domain.alias("explicit_vhh"),
        doubtful.alias("ambiguous_residues"),
        quarantined.alias("source_format_quarantined"),
        F.lit("unknown_not_inferred").alias("completeness"),
        nucleotide.alias("source_nucleotide_available"),
    )


def fnv1a(c: Column | str) -> Column:
    """32-bit FNV-1a of a text's code points, as a long."""
    codes = F.transform(F.split(_col(c), ""), lambda ch: F.when(ch != "", F.ascii(ch)))
    return F.aggregate(F.filter(codes, lambda x: x.isNotNull()), F.lit(FNV_OFFSET).cast("long"), lambda a, x: (a.bitwiseXOR(x.cast("long")) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


_CANONICAL = np.zeros(256, dtype=bool)
_CANONICAL[np.frombuffer(CANONICAL.encode(), np.uint8)] = True


def signature_of(sequence: str) -> np.ndarray:
    """The least ``SIGNATURE_SIZE`` distinct FNV-1a hashes of canonical k-mers."""
    raw = np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)
    n = len(raw) - KMER + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.full(n, FNV_OFFSET, dtype=np.uint64)
    ok = np.ones(n, dtype=bool)
    for j in range(KMER):
        part = raw[j : j + n]
        h = ((h ^ part.astype(np.uint64)) * np.uint64(FNV_PRIME)) & np.uint64(0xFFFFFFFF)
        ok &= _CANONICAL[part]
    return np.unique(h[ok])[:SIGNATURE_SIZE].astype(np.int64)


def signatures_of(sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`signature_of` of many sequences side by side: all hashes, and where those of each sequence start and end.

    A sequence's hashes are sorted behind its number, so one sort serves all.
    """
    raw = np.frombuffer("".join(f"{s}\0" for s in sequences).encode("ascii", "replace"), np.uint8)
    n = max(len(raw) - KMER + 1, 0)
    h, ok = np.full(n, FNV_OFFSET, dtype=np.uint32), np.ones(n, dtype=bool)
    for j in range(KMER):
        part = raw[j : j + n]
        h = (h ^ part) * np.uint32(FNV_PRIME)
        ok &= _CANONICAL[part]
    owner = np.repeat(np.arange(len(sequences), dtype=np.uint64), [len(s) + 1 for s in sequences])[:n]
    marks = np.sort((owner[ok] << np.uint64(32)) | h[ok])
    marks = marks[np.concatenate([[True], marks[1:] != marks[:-1]])] if len(marks) else marks
    ends = np.searchsorted(marks, np.arange(len(sequences) + 1, dtype=np.uint64) << np.uint64(32))
    kept = np.arange(len(marks)) - np.repeat(ends[:-1], np.diff(ends)) < SIGNATURE_SIZE
    return (marks[kept] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.concatenate([[0], np.cumsum(np.minimum(np.diff(ends), SIGNATURE_SIZE))])


#: Letters whose hashes are held at once.
SIGNED_LETTERS = 1 << 21


@F.arrow_udf(ArrayType(LongType()))
def signature(sequences: pa.Array) -> pa.Array:
    """Bottom-k signature of each sequence; null and short ones have none."""
    every, parts, letters, at = [s or "" for s in sequences.to_pylist()], [], 0, 0
    for i, s in enumerate(every):
        letters += len(s)
        if letters > SIGNED_LETTERS or i + 1 == len(every):
            hashes, offsets = signatures_of(every[at : i + 1])
            parts.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes, pa.int64())))
            letters, at = 0, i + 1
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))


#: Cells of a profile, and letters of the grams that are counted in them.
PROFILE_SIZE = 128
PROFILE_GRAM = 3


def profiles_of(sequences: list[str]) -> np.ndarray:
    """How many grams of each sequence fall in each cell by their hash, at most 255.

    An edit changes ``PROFILE_GRAM`` grams of either side at most, so profiles
    differ by no more than ``2 * PROFILE_GRAM`` for each edit.
    """
    raw = np.frombuffer("".join(f"{s}\0" for s in sequences).encode("ascii", "replace"), np.uint8)
    n = max(len(raw) - PROFILE_GRAM + 1, 0)
    h, ok = np.zeros(n, dtype=np.uint32), np.ones(n, dtype=bool)
    for j in range(PROFILE_GRAM):
        part = raw[j : j + n]
        h = h * np.uint32(31) + part
        ok &= part != 0
    cell = ((h * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(PROFILE_SIZE)
    owner = np.repeat(np.arange(len(sequences)), [len(s) + 1 for s in sequences])[:n]
    counts = np.bincount(owner[ok] * PROFILE_SIZE + cell[ok], minlength=len(sequences) * PROFILE_SIZE)
    return np.minimum(counts, 255).astype(np.uint8).reshape(len(sequences), PROFILE_SIZE)


@F.arrow_udf(BinaryType())
def profile(sequences: pa.Array) -> pa.Array:
    """:func:`profiles_of` of a column, as bytes."""
    every, out, letters, at = [s or "" for s in sequences.to_pylist()], [], 0, 0
    for i, s in enumerate(every):
        letters += len(s)
        if letters > SIGNED_LETTERS or i + 1 == len(every):
            out += [p.tobytes() for p in profiles_of(every[at : i + 1])]
            letters, at = 0, i + 1
    return pa.array(out, pa.binary())


def align_batch(references: list[str], queries: list[str]) -> np.ndarray:
    """Global alignments of twos: score, matches, columns and residue columns, all side by side.

    Match 2, conservative 1, mismatch -1, gap -2; ties prefer diagonal, then a
    gap in the query, then one in the reference.  Cells of an antidiagonal are
    computed at once for all twos and leave a byte of direction, which is then
    traced back for all at once; twos whose directions would take over
    ``TRACE_BYTES`` carry counts along instead.
    """
    m, n, b = max(map(len, references), default=0), max(map(len, queries), default=0), len(references)
    if (m + 1) * (n + 1) * b > 2 * TRACE_BYTES and b > 1:
        half = b // 2
        return np.concatenate([align_batch(references[:half], queries[:half]), align_batch(references[half:], queries[half:])])
    if (m + 1) * (n + 1) > 2 * TRACE_BYTES:
        return _align_long(references, queries)
    ref, que = (np.array([np.frombuffer(s.encode("ascii", "replace").ljust(w, b"\0"), np.uint8) for s in x], dtype=np.uint8).reshape(b, w).T for x, w in ((references, m), (queries, n)))
    ref, que = np.ascontiguousarray(ref), np.ascontiguousarray(que[::-1])
    ref_groups, que_groups = _GROUP_BITS[ref], _GROUP_BITS[que]
    rl, ql = np.array([len(s) for s in references], dtype=np.int64), np.array([len(s) for s in queries], dtype=np.int64)
    out = np.zeros((b, 4), dtype=np.int32)
    kind = np.int16 if 2 * (m + n) < 1 << 15 else np.int32
    scores = [np.zeros((m + 1, b), dtype=kind) for _ in range(3)]
    steps: list[np.ndarray | None] = []
    ends = rl + ql
    for d in range(m + n + 1):
        s2, s1, s0 = (scores[k % 3] for k in (d - 2, d - 1, d))
        if d <= n:
            s0[0] = -2 * d
        if d <= m:
            s0[d] = -2 * d
        lo, hi = max(1, d - n), min(m, d - 1)
        step = None
        if lo <= hi:
            at = slice(n - d + lo, n - d + hi + 1)
            same = ref[lo - 1 : hi] == que[at]
            near = (ref_groups[lo - 1 : hi] & que_groups[at]) != 0
            near |= same
            sub = near.view(np.int8) * np.int8(2) + same.view(np.int8)
            sub -= np.int8(1)
            diagonal = s2[lo - 1 : hi] + sub
            up, left = s1[lo - 1 : hi], s1[lo : hi + 1]
            gap = np.maximum(up, left) - kind(2)
            step = (diagonal < gap).view(np.uint8)
            step += step & (up < left).view(np.uint8)
            # what the trace counts: bit 2 tells a match on a diagonal
            step |= same.view(np.uint8) << np.uint8(2)
            np.maximum(diagonal, gap, out=s0[lo : hi + 1])
        steps.append(step)
        done = np.flatnonzero(ends == d)
        out[done, 0] = s0[rl[done], done]
    _trace(steps, rl.copy(), ends, n, out)
    return out


def _trace(steps: list[np.ndarray | None], i: np.ndarray, at: np.ndarray, n: int, out: np.ndarray) -> None:
    """Counts along the traced paths, of all twos that stand on an antidiagonal at once."""
    at = at.copy()
    for d in range(len(steps) - 1, 0, -1):
        here = np.flatnonzero(at == d)
        if not len(here):
            continue
        row = i[here]
        way = np.where(row == 0, 2, 1).astype(np.uint8)
        inner = np.flatnonzero((row > 0) & (row < d))
        if len(inner):
            way[inner] = steps[d][row[inner] - max(1, d - n), here[inner]]
        move = way & 3
        diagonal = move == 0
        out[here, 1] += diagonal & (way >= 4)
        out[here, 2] += 1
        out[here, 3] += diagonal
        i[here] -= move < 2
        at[here] -= 1 + diagonal


def common_letters(reference: str, query: str, masks: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, by bits of one integer: no alignment has more matches."""
    if masks is None:
        masks = letter_masks(reference)
    full = (1 << len(reference)) - 1
    v = full
    for ch in query:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(reference) - v.bit_count()


def letter_masks(text: str) -> dict[str, int]:
    """For each letter the places where it stands, as bits."""
    out: dict[str, int] = {}
    for i, ch in enumerate(text):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


@F.pandas_udf(IntegerType())
def most_matches(references: pd.Series, queries: pd.Series) -> pd.Series:
    """Matches that no alignment of the two can exceed."""
    known: dict[str, dict[str, int]] = {}
    out = []
    for r, q in zip(references.fillna(""), queries.fillna("")):
        if r not in known:
            known[r] = letter_masks(r)
        out.append(common_letters(r, q, known[r]))
    return pd.Series(out, dtype="int32")


def _align_long(references: list[str], queries: list[str]) -> np.ndarray:
    """As :func:`align_batch`, with what the traced path counts carried forward beside its pointer: memory grows with the length, not its square."""
    m, n, b = max(map(len, references), default=0), max(map(len, queries), default=0), len(references)
    ref, que = (np.array([np.frombuffer(s.encode("ascii", "replace").ljust(w, b"\0"), np.uint8) for s in x], dtype=np.uint8).reshape(b, w) for x, w in ((references, m), (queries, n)))
    rl, ql = np.array([len(s) for s in references]), np.array([len(s) for s in queries])
    out = np.zeros((b, 4), dtype=np.int32)
    # scores, and beside them matches, columns and residue columns packed in 21 bits each; every cell read was written
    scores = [np.empty((b, m + 1), dtype=np.int32) for _ in range(3)]
    counts = [np.empty((b, m + 1), dtype=np.int64) for _ in range(3)]
    for d in range(m + n + 1):
        (s2, c2), (s1, c1), (s0, c0) = ((scores[k % 3], counts[k % 3]) for k in (d - 2, d - 1, d))
        if d <= n:
            s0[:, 0], c0[:, 0] = -2 * d, d << 21
        if d <= m:
            s0[:, d], c0[:, d] = -2 * d, d << 21
        lo, hi = max(1, d - n), min(m, d - 1)
        if lo <= hi:
            a, q = ref[:, lo - 1 : hi], que[:, d - 1 - hi : d - lo][:, ::-1]
            diagonal = s2[:, lo - 1 : hi] + _SCORES[a, q]
            up, left = s1[:, lo - 1 : hi], s1[:, lo : hi + 1]
            gap = np.maximum(up, left) - 2
            is_d = diagonal >= gap
            c0[:, lo : hi + 1] = (1 << 21) + np.where(is_d, c2[:, lo - 1 : hi] + ((a == q) + _RESIDUE), np.where(up >= left, c1[:, lo - 1 : hi], c1[:, lo : hi + 1]))
            s0[:, lo : hi + 1] = np.maximum(diagonal, gap)
        done = np.flatnonzero(rl + ql == d)
        out[done, 0] = s0[done, rl[done]]
        packed = c0[done, rl[done]]
        for k in range(3):
            out[done, k + 1] = (packed >> (21 * k)) & ((1 << 21) - 1)
    return out


_RESIDUE = np.int64(1 << 42)


def _score_table() -> np.ndarray:
    t = np.full((256, 256), -1, dtype=np.int32)
    for g in GROUPS:
        for x in g.encode():
            t[x, np.frombuffer(g.encode(), np.uint8)] = 1
    np.fill_diagonal(t, 2)
    return t


_SCORES = _score_table()
#: Bytes of directions that one batch of alignments keeps.
TRACE_BYTES = 24 << 20


def _group_bits() -> np.ndarray:
    t = np.zeros(256, dtype=np.uint16)
    for k, g in enumerate(GROUPS):
        t[np.frombuffer(g.encode(), np.uint8)] |= np.uint16(1 << k)
    return t


_GROUP_BITS = _group_bits()


_ALIGNED = StructType([StructField(n, IntegerType()) for n in ("score", "matches", "columns", "residues", "reference_length")])


@F.pandas_udf(_ALIGNED)
def align(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Alignment counts of (reference, query) columns; those of like length are aligned side by side."""
    for refs, ques in batches:
        refs, ques = refs.fillna("").tolist(), ques.fillna("").tolist()
        order = sorted(range(len(refs)), key=lambda i: (len(refs[i]), len(ques[i])))
        out = np.zeros((len(refs), 4), dtype=np.int32)
        at = 0
        while at < len(order):
            # as many at a time as keep an antidiagonal in the cache
            part = order[at : at + max(1, 60_000 // (len(refs[order[at]]) + 1))]
            at += len(part)
            out[part] = align_batch([refs[i] for i in part], [ques[i] for i in part])
        yield pd.DataFrame({"score": out[:, 0], "matches": out[:, 1], "columns": out[:, 2], "residues": out[:, 3], "reference_length": [len(r) for r in refs]})


def strict_identity(a: Column) -> Column:
    """Matches over all alignment columns, in percent, to three places."""
    return F.when(a["columns"] > 0, F.round(100 * a["matches"] / a["columns"], 3)).otherwise(F.lit(0.0))


def loose_identity(a: Column) -> Column:
    """Matches over columns without a gap, in percent."""
    return F.when(a["residues"] > 0, 100 * a["matches"] / a["residues"]).otherwise(F.lit(0.0))


def reference_coverage(a: Column) -> Column:
    return F.when(a["reference_length"] > 0, 100 * a["residues"] / a["reference_length"]).otherwise(F.lit(0.0))


def like_lengths(left: Column, right: Column, least_coverage: int = 90) -> Column:
    """Whether chains of these lengths may have an edit identity."""
    return (F.least(left, right) > 0) & (100 * F.least(left, right) / F.greatest(left, right) + 1e-9 >= least_coverage)


def edit_identity(left: Column | str, right: Column | str, least: int = 90, least_coverage: int = 90) -> Column:
    """Edit identity in percent to four places; null under ``least``, or where lengths differ too much."""
    a, b = _col(left), _col(right)
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    budget = F.floor(longer * (100 - least) / 100 + 1e-9).cast("int")
    possible = like_lengths(F.length(a), F.length(b), least_coverage) & (longer - shorter <= budget)
    # the budget bounds the band that is computed; -1 tells that it was passed
    distance = F.call_function("levenshtein", a, b, budget)
    return F.when(possible & (distance >= 0), F.round(100 * (longer - distance) / longer, 4))


def near_threshold(length: Column) -> Column:
    """Edits allowed between short regions."""
    return F.when(length <= 8, 1).otherwise(2)


def back_translate(c: Column | str, preset: str = "human") -> Column:
    """One deterministic codon for each residue; null where a residue is not canonical."""
    table = F.create_map(*[F.lit(x) for pair in CODONS[preset].items() for x in pair])
    s = _col(c)
    codons = F.transform(F.filter(F.split(s, ""), lambda ch: ch != ""), lambda ch: F.try_element_at(table, ch))
    return F.when((s != "") & ~s.rlike(f"[^{CANONICAL}]"), F.array_join(codons, ""))


def composition(c: Column | str) -> Column:
    """Residues by class, and the rest."""
    s = F.coalesce(_col(c), F.lit(""))
    count = lambda chars: (F.length(s) - F.length(F.translate(s, chars, ""))).cast("long")
    known = "".join(RESIDUE_CLASSES.values())
    return F.struct(*[count(v).alias(k) for k, v in RESIDUE_CLASSES.items()], (F.length(s) - count(known)).cast("long").alias("other"))


def variant_of(sequence: str, identity_percent: int) -> str:
    """The sequence with evenly spaced substitutions, down to the identity asked for."""
    letters = np.frombuffer(sequence.encode("utf-32-le"), np.uint32).copy()
    n = len(letters)
    edits = round(n * (100 - identity_percent) / 100)
    # position i changes where floor(i * edits / n) steps up, that is, at the least i + 1 that brings k * n / edits
    at = -(-np.arange(1, edits + 1, dtype=np.int64) * n // max(edits, 1)) - 1
    letters[at] = np.where(letters[at] == ord("A"), ord("G"), ord("A"))
    return letters.tobytes().decode("utf-32-le")


@F.pandas_udf(StringType())
def _variants(sequences: pd.Series, levels: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else variant_of(s, p) for s, p in zip(sequences, levels)], dtype=object)


def variant(c: Column | str, identity_percent: Column | int) -> Column:
    """:func:`variant_of` of a column; the levels may be a column too."""
    return _variants(_col(c), identity_percent if isinstance(identity_percent, Column) else F.lit(identity_percent))


def region_position(region: Column | str, chain: Column | str) -> Column:
    """Where a region starts in its chain, from 0; -1 if it is not there or empty."""
    r = F.coalesce(_col(region), F.lit(""))
    return F.when(r == "", -1).otherwise(F.call_function("instr", F.coalesce(_col(chain), F.lit("")), r) - 1)


def aligned_texts(reference: str, query: str, width: int = 70) -> str:
    """The traced alignment in blocks of reference, match line (``|`` equal, ``:`` conservative) and query."""
    m, n = len(reference), len(query)
    ref, que = (np.frombuffer(s.encode("ascii", "replace"), np.uint8) for s in (reference, query))
    scores = np.zeros((m + 1, n + 1), dtype=np.int32)
    scores[:, 0], scores[0] = -2 * np.arange(m + 1), -2 * np.arange(n + 1)
    gap = 2 * np.arange(n + 1)
    for i in range(1, m + 1):
        best = scores[i].copy()
        best[1:] = np.maximum(scores[i - 1, :-1] + _SCORES[ref[i - 1], que], scores[i - 1, 1:] - 2)
        # gaps in the reference run along the row
        scores[i] = np.maximum.accumulate(best + gap) - gap
    rows: list[tuple[str, str, str]] = []
    i, j = m, n
    while i or j:
        if i and j and scores[i, j] == scores[i - 1, j - 1] + _SCORES[ref[i - 1], que[j - 1]]:
            a, b = reference[i - 1], query[j - 1]
            rows.append((a, "|" if a == b else ":" if _SCORES[ref[i - 1], que[j - 1]] == 1 else " ", b))
            i, j = i - 1, j - 1
        elif i and (not j or scores[i, j] == scores[i - 1, j] - 2):
            rows.append((reference[i - 1], " ", "-"))
            i -= 1
        else:
            rows.append(("-", " ", query[j - 1]))
            j -= 1
    lines = ["".join(x) for x in zip(*rows[::-1])] if rows else ["", "", ""]
    return "\n\n".join("\n".join(x[at : at + width] for x in lines) for at in range(0, max(1, len(lines[0])), width))


@F.pandas_udf(StringType())
def alignment_text(references: pd.Series, queries: pd.Series) -> pd.Series:
    return pd.Series([aligned_texts(r or "", q or "") for r, q in zip(references, queries)])
