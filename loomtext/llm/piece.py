"""Exact SentencePiece (BPE) encoding by backtracking over Aho-Corasick matches, and decoding.

A merge-type model joins, again and again, the adjacent pair whose joined
piece has the highest score (the leftmost of equals). The encoding is the only
sequence of pieces in which every two neighbours, merged anew from their
characters, come out as these two. So: take the longest piece that starts
here; if it isn't compatible with the piece before it, or ends at a position
known to fail, take its longest proper prefix that is a piece; if none is left,
mark this position as failed in a bitfield and go back one piece. Every
position fails at most once.

Pieces of equal scores: the model's runs of spaces share one, the lowest. Its
leftmost pair first, a run of them grows piece by piece to the longest run that
is a piece with all lengths on the way (of 15 spaces, which are no piece, 14 and
1; of 16, 14 and 2 that join), while a letter has taken the last space before.
The longest match at each place, and its shorter prefixes where it isn't
compatible, give the same; the tests compare both for every length up to some
hundreds. A model with other pieces of equal scores is refused.

A text is cut into segments where no piece of the model reaches across. Segments
that were seen lately are kept in a table of bounded size.

Characters without a piece become their UTF-8 bytes' pieces.

Defined cases: a null text encodes like an empty one (begin and end ids only);
lone surrogates, which UTF-8 can't hold, are replaced by "?"; rows that repeat
stay apart; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

SPACE = "▁"
_LOADED: dict[bytes, PieceEncoder] = {}


class PieceEncoder:
    def __init__(self, model: bytes, kept: int = 160_000) -> None:
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size()
        special = lambda i: self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i)
        self.ids = {self.sp.id_to_piece(i): i for i in range(n) if not special(i)}
        self.score = {p: self.sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {b: self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        others = [x for p, x in self.score.items() if set(p) != {SPACE}]
        if len(set(others)) < len(others):
            raise ValueError("pieces of equal scores: not a model of merges in a fixed order")
        own = {p: i for p, i in self.ids.items() if self.merge(p) == [p]}  # others are never a result
        self.longest = ahocorasick.Automaton()
        for p, i in own.items():
            self.longest.add_word(p, i)
        self.longest.make_automaton()
        self.piece = [self.sp.id_to_piece(i) for i in range(n)]
        self.size = [len(p) for p in self.piece]
        self.prefix = [-1] * n  # the longest proper prefix that is a piece
        for p, i in own.items():
            self.prefix[i] = next((own[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in own), -1)
        self.coarse = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if "\n" not in "".join(own) and not self.reaches_over_space() else "(?s).+")
        self.fine = re.compile(self.segment_pattern())
        # Tables of what was worked out lately. A full one becomes the old one, whose entries come back when they are used.
        self.kept, self.segments, self.old_segments, self.pairs, self.old_pairs = kept, {}, {}, {}, {}

    def reaches_over_space(self) -> bool:
        return any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)

    def segment_pattern(self) -> str:
        """A pattern of segments between which no piece reaches: joined characters would have to be neighbours in a piece.

        Cut are: around characters that are in no piece; before spaces that
        follow another character; and before those characters that follow a
        letter in no piece (full stops and the like).
        """
        known = set().union(*self.ids) - {SPACE}
        if self.reaches_over_space():
            return "(?s).+"
        after_letter = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        starts = known - after_letter - {c for c in known if c.isalpha()}
        listed = lambda chars: "".join(map(re.escape, sorted(chars)))
        letter = r"[^\W\d_]"
        letters = f"(?:(?![^{listed(known)}]){letter})+"
        if all(not c.isalpha() or c in known for c in map(chr, range(128))):
            letters = f"(?:[A-Za-z]+|{letters})+"
        others = listed({c for c in known if not re.fullmatch(letter, c)})
        joining = listed({c for c in known - starts if not re.fullmatch(letter, c)})
        more = f"(?:[{joining}][{others}]*(?:{letters})?)*" if joining else ""
        return f"{SPACE}*[{others}]*{letters}{more}|{SPACE}*[{others}]+|{SPACE}+|[^{listed(known)}{SPACE}]"

    def merge(self, text: str) -> list[str]:
        """Direct merging: the best adjacent pair first, the leftmost of equals."""
        part = list(text)
        n = len(part)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (score := self.score.get(joined := part[i] + part[after[i]])) is not None:
                heapq.heappush(heap, (-score, i, joined))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if part[i] and j >= 0 and len(part[i]) + len(part[j]) == len(joined) and part[i] + part[j] == joined:
                part[i], part[j] = joined, ""
                after[i] = after[j]
                if after[j] >= 0:
                    before[after[j]] = i
                offer(before[i])
                offer(i)
        return [p for p in part if p]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two neighbouring pieces, merged anew from their characters, come out as themselves; kept in `pairs`."""
        key = left << 32 | right
        if (known := self.old_pairs.get(key)) is None:
            a, b = self.piece[left], self.piece[right]
            known = self.merge(a + b) == [a, b]
        if len(self.pairs) >= self.kept:
            self.old_pairs, self.pairs = self.pairs, {}
        self.pairs[key] = known
        return known

    def backtrack(self, text: str) -> list[int]:
        """Ids of the pieces of a text; -1 for a character without a piece."""
        n = len(text)
        longest, reach = [-1] * n, [0] * n
        size, prefix = self.size, self.prefix
        for end, i in self.longest.iter(text):
            start = end - size[i] + 1
            if size[i] > reach[start]:
                longest[start], reach[start] = i, size[i]
        failed = bytearray(n // 8 + 1)  # bit i: no encoding goes on from position i
        out: list[int] = []
        at, last, candidate = 0, -1, longest[0]
        while at < n:
            if reach[at]:
                while candidate >= 0:
                    end = at + size[candidate]
                    if not failed[end >> 3] >> (end & 7) & 1:
                        if last < 0:
                            break
                        fits = self.pairs.get(last << 32 | candidate)
                        if self.compatible(last, candidate) if fits is None else fits:
                            break
                    candidate = prefix[candidate]
                good = candidate >= 0
            else:  # a character without a piece goes with anything
                end, good = at + 1, not failed[(at + 1) >> 3] >> (at + 1 & 7) & 1
            if good:
                out.append(candidate)
                at, last = end, candidate
                candidate = longest[at] if at < n else -1
            while not good:  # no encoding goes on from here: the piece before gets shorter
                failed[at >> 3] |= 1 << (at & 7)
                gone = out.pop()
                at -= size[gone] if gone >= 0 else 1
                candidate, last = prefix[gone] if gone >= 0 else -1, out[-1] if out else -1
                good = candidate >= 0
        return out

    def segment(self, text: str) -> bytes:
        """The ids of one segment as little-endian unsigned 32-bit integers."""
        ids, at = [], 0
        for i in self.backtrack(text):
            ids += [i] if i >= 0 else [self.bytes[b] for b in text[at].encode("utf-8")]
            at += self.size[i] if i >= 0 else 1
        return struct.pack(f"<{len(ids)}I", *ids)

    def looked_up(self, text: str, parts: re.Pattern | None) -> bytes:
        """The ids of a segment from the table of segments, which may hold its finer parts (a word without its full stop)."""
        if (ids := self.segments.get(text)) is None:
            if (ids := self.old_segments.get(text)) is not None:
                pass
            elif parts and len(found := parts.findall(text)) > 1:
                ids = b"".join([self.looked_up(p, None) for p in found])
            else:
                ids = self.segment(text)
            if len(text) <= 64:
                if len(self.segments) >= self.kept:
                    self.old_segments, self.segments = self.segments, {}
                self.segments[text] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Begin id, the ids of the whole text, end id."""
        if text and not text.isascii():
            text = text.encode("utf-8", "replace").decode()
        out = [np.array([self.sp.bos_id()], "<u4").tobytes()]
        for part in self.coarse.findall(self.sp.normalize(text)) if text else []:
            out.append(self.segments.get(part) or self.looked_up(part, self.fine))
        out.append(np.array([self.sp.eos_id()], "<u4").tobytes())
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def encoder(model: bytes, kept: int = 160_000) -> PieceEncoder:
    """One encoder for each Python worker and model."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = PieceEncoder(model, kept)
    return _LOADED[key]


def encode_documents(docs: DataFrame, model: str, with_ids: bool = True, kept: int = 160_000, release: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every whole text; `model` is the file's path on the driver, `with_ids` False leaves out ids.

    A worker's tables hold up to twice `kept` segments and pairs. They stay for
    its next task, unless `release` says to give their memory back: for a job
    whose other stages share the executors.
    """
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches):
        e = encoder(shared.value, kept)
        for b in batches:
            counts, shas, decoded, all_ids = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = np.frombuffer(raw := e.encode(text), "<u4")
                counts.append(len(ids))
                shas.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(e.decode(ids.tolist()).encode("utf-8")).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []), names)
        if release:
            _LOADED.clear()
            del e
            gc.collect()
            pa.default_memory_pool().release_unused()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, schema)
