"""Alignment of two versions of a text within a row: unified diffs of lines, whole-text similarity.

Both rest on bit-parallel dynamic programming: a column of the table is one large
integer, a step of it a few additions and bit operations, so that the cost is in
machine words (rows * columns / 64) and not in characters squared. Columns are worked in blocks
whose symbol masks stay within `MASK_BITS`; what passes from block to block is one
carry for each row. Common beginnings and ends are taken off first; this changes no result.

Everything is per row: no shuffle, whole texts, memory in proportion to the two texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK_BITS = 1 << 28


def blocks(b: np.ndarray) -> Iterator[tuple[int, dict[int, int]]]:
    """(width, masks) of each block of b: which of its places hold a symbol, as the bits of one integer."""
    width = max(4096, MASK_BITS // max(1, len(np.unique(b))))
    for at in range(0, len(b), width):
        part = b[at : at + width]
        order = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.r_[True, part[order][1:] != part[order][:-1]])
        masks = {}
        for places in np.split(order, starts[1:]):
            flags = np.zeros(len(part), np.uint8)
            flags[places] = 1
            masks[int(part[places[0]])] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        yield len(part), masks


def common_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each prefix of b (from the empty one) the length of its longest common subsequence with a."""
    symbols, carry, grows = a.tolist(), bytearray(len(a)), [np.zeros(1, np.uint8)]
    for width, masks in blocks(b):
        full = (1 << width) - 1
        v = full
        for i, x in enumerate(symbols):
            hit = v & masks.get(x, 0)
            total = v + hit + carry[i]
            carry[i] = total >> width
            v = (total | (v - hit)) & full
        bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-width // 8), "little"), np.uint8), count=width, bitorder="little")
        grows.append(1 - bits)
    return np.cumsum(np.concatenate(grows), dtype=np.int64)


def ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How long the common beginning is, and the common end of what is left."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    n -= head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    return head, int(differ[0]) if len(differ) else n


def aligned(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The places (i, j) of a longest common subsequence, in order; halves of a are aligned with the two parts of b that have most in common with them."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        i, i2, j, j2 = work.pop()
        head, tail = ends(a[i:i2], b[j:j2])
        out += [(i + k, j + k) for k in range(head)] + [(i2 - k - 1, j2 - k - 1) for k in range(tail)]
        i, i2, j, j2 = i + head, i2 - tail, j + head, j2 - tail
        if i2 - i == 1:
            at = np.flatnonzero(b[j:j2] == a[i])
            out += [(i, j + int(at[0]))] if len(at) else []
        elif i < i2 and j < j2:
            mid = (i + i2) // 2
            before, after = common_lengths(a[i:mid], b[j:j2]), common_lengths(a[mid:i2][::-1], b[j:j2][::-1])[::-1]
            cut = j + int(np.argmax(before + after))
            work += [(i, mid, j, cut), (mid, i2, cut, j2)]
    return sorted(out)


def edits(old: list[str], new: list[str]) -> list[tuple[str, int, int]]:
    """(sign, old line, new line) of every line in order: ' ' kept, '-' gone, '+' new; numbers from 0."""
    names: dict[str, int] = {}
    a, b = (np.array([names.setdefault(x, len(names)) for x in side], np.int64) for side in (old, new))
    out, i, j = [], 0, 0
    for p, q in [*aligned(a, b), (len(old), len(new))]:
        out += [("-", k, j) for k in range(i, p)] + [("+", p, k) for k in range(j, q)]
        if p < len(old):
            out.append((" ", p, q))
        i, j = p + 1, q + 1
    return out


def hunks(script: list[tuple[str, int, int]], context: int = 3) -> list[list[tuple[str, int, int]]]:
    """The script's changes with `context` kept lines around them; those with at most twice as many between them are one hunk."""
    out, last = [], None
    for k, (sign, _, _) in enumerate(script):
        if sign != " ":
            if last is None or k - last > 2 * context + 1:
                out.append([k, k])
            out[-1][1] = last = k
    return [script[max(0, x - context) : y + context + 1] for x, y in out]


HUNK = "array<struct<old_start:int,old_lines:int,new_start:int,new_lines:int,lines:array<struct<sign:string,line:string>>>>"


def _hunks_of(old: str | None, new: str | None, context: int) -> list[dict]:
    a, b = (old or "").split("\n"), (new or "").split("\n")
    out = []
    for h in hunks(edits(a, b), context):
        lines = [{"sign": s, "line": b[j] if s == "+" else a[i]} for s, i, j in h]
        out.append({"old_start": h[0][1], "old_lines": sum(s != "+" for s, _, _ in h), "new_start": h[0][2], "new_lines": sum(s != "-" for s, _, _ in h), "lines": lines})
    return out


def with_hunks(docs: DataFrame, old: str, new: str, context: int = 3, name: str = "hunks") -> DataFrame:
    """docs with the hunks that lead from column `old` to column `new` (null: empty), line by line; starts count from 0."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType.fromDDL(f"x {HUNK}")["x"].dataType)])
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("old_start", "old_lines", "new_start", "new_lines")] + [("lines", pa.list_(pa.struct([("sign", pa.string()), ("line", pa.string())])))]))

    def run(batches):
        for b in batches:
            x, y = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (old, new))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_hunks_of(p, q, context) for p, q in zip(x, y, strict=True)], kind)], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def patched(old: Column, found: Column) -> Column:
    """The old text with its hunks applied: the text they lead to."""
    a = F.split(old, "\n", -1)

    def pieces(lines: Column, h: Column) -> Column:
        end = lambda k: F.when(k > 0, F.element_at(h, F.greatest(k, F.lit(1)))["old_start"] + F.element_at(h, F.greatest(k, F.lit(1)))["old_lines"]).otherwise(0)
        new = lambda x: F.transform(F.filter(x["lines"], lambda e: e["sign"] != "-"), lambda e: e["line"])
        each = F.flatten(F.transform(h, lambda x, k: F.concat(F.slice(lines, end(k) + 1, x["old_start"] - end(k)), new(x))))
        return F.concat(each, F.slice(lines, end(F.size(h)) + 1, F.size(lines)))

    return F.array_join(F.transform(F.array(F.struct(a.alias("a"), found.alias("h"))), lambda s: pieces(s["a"], s["h"]))[0], "\n")


def unified(found: Column, old: str = "reference", new: str = "output") -> Column:
    """array<string>: the lines of a unified diff, head lines included; none without a difference."""
    place = lambda start, n: F.concat(F.when(n == 0, start).otherwise(start + 1).cast("string"), F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string"))))
    head = lambda h: F.concat(F.lit("@@ -"), place(h["old_start"], h["old_lines"]), F.lit(" +"), place(h["new_start"], h["new_lines"]), F.lit(" @@"))
    body = F.flatten(F.transform(found, lambda h: F.concat(F.array(head(h)), F.transform(h["lines"], lambda x: F.concat(x["sign"], x["line"])))))
    return F.when(F.size(found) > 0, F.concat(F.array(F.lit(f"--- {old}"), F.lit(f"+++ {new}")), body)).otherwise(F.array().cast("array<string>"))


def changes(found: Column) -> Column:
    """struct<hunks, added, removed>."""
    count = lambda sign: F.aggregate(found, F.lit(0), lambda n, h: n + F.size(F.filter(h["lines"], lambda x: x["sign"] == sign)))
    return F.struct(F.size(found).alias("hunks"), count("+").alias("added"), count("-").alias("removed"))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def common_length(x: str, y: str) -> int:
    """The length of the longest common subsequence of two texts."""
    a, b = code_points(x), code_points(y)
    head, tail = ends(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    return head + tail + (int(common_lengths(a, b)[-1]) if len(a) and len(b) else 0)


def edit_distance(x: str, y: str) -> int:
    """Inserted, deleted and replaced code points that lead from one text to the other, at least."""
    a, b = code_points(x), code_points(y)
    head, tail = ends(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    symbols, carry = a.tolist(), [1] * len(a)  # along the first row the distance grows by one
    for width, masks in blocks(b):
        full, top = (1 << width) - 1, 1 << (width - 1)
        up, down = full, 0
        for i, x in enumerate(symbols):
            same, came = masks.get(x, 0), carry[i]
            either = same | down
            if came < 0:
                same |= 1
            level = (((same & up) + up) ^ up) | same
            rise, fall = down | (full & ~(level | up)), up & level
            carry[i] = 1 if rise & top else -1 if fall & top else 0
            rise, fall = (rise << 1 | (came > 0)) & full, (fall << 1 | (came < 0)) & full
            up, down = fall | (full & ~(either | rise)), rise & either
    return len(b) + sum(carry)


def _by_pair(measure: Callable[[str, str], float]):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}  # equal pairs of a batch are measured once
        out = []
        for pair in zip(a, b, strict=True):
            pair = (pair[0] or "", pair[1] or "")
            if pair not in seen:
                seen[pair] = measure(*pair)
            out.append(seen[pair])
        return pd.Series(out, dtype=float)

    return run


def edit_share(x: str, y: str) -> float:
    n = max(len(x), len(y))
    return 1 - edit_distance(x, y) / n if n else 1.0


def common_share(x: str, y: str) -> float:
    n = len(x) + len(y)
    return 2 * common_length(x, y) / n if n else 1.0


#: Similarities of whole texts: 1 - edit distance / longer length, and twice the longest common subsequence over both lengths.
edit_similarity, common_similarity = _by_pair(edit_share), _by_pair(common_share)
