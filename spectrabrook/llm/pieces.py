"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

Texts split where no piece of the vocabulary can cross: before each run of
spaces, and around a line feed if no longer piece holds one. Words new to a
task are encoded together: one flat array of symbols, in each round the best
pair of every word by a segmented minimum of ranks, all its leftmost
occurrences merged at once, arrays compacted, until no pair is left. A word
whose merge makes a better pair than the round's is done one merge at a time,
as are ranks that pieces share, so results are exact for any vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrabrook.llm.common import small_batches

SPACE = "▁"
NONE = np.int64(2**62)


class PieceModel:
    """Tables of a BPE model with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or byte[i] for i in range(n)]
        self.byte_ids = [0] * 256
        for i in range(n):
            if byte[i]:
                self.byte_ids[int(names[i][3:5], 16)] = i
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.special, self.names = special, names
        self.id_of = {p: i for i, p in enumerate(names) if not special[i]}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece has a space after other characters; words can't be told apart")
        # Symbols: pieces by id, then characters that occur only inside pieces.
        chars = sorted({c for p in self.id_of for c in p} - set(self.id_of))
        self.symbols = dict(self.id_of) | {c: n + i for i, c in enumerate(chars)}
        self.n_symbols = n + len(chars) + 1
        #: Symbol of a character that no piece holds.
        self.odd = n + len(chars)
        score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        order = sorted(set(score.values()), reverse=True)
        rank_of = {s: r for r, s in enumerate(order)}
        seen: dict[float, int] = {}
        pairs = []
        for p, i in self.id_of.items():
            cuts = [(self.symbols[p[:k]], self.symbols[p[k:]]) for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols]
            if cuts:
                seen[score[p]] = seen.get(score[p], 0) + 1
            pairs += [(a * self.n_symbols + b, rank_of[score[p]], i) for a, b in cuts]
        pairs.sort()
        self.keys = np.array([x[0] for x in pairs], np.int64)
        self.ranks = np.array([x[1] for x in pairs], np.int64)
        self.made = np.array([x[2] for x in pairs], np.int64)
        self.pair = {k: (r, m) for k, r, m in pairs}
        shared = {rank_of[s] for s, k in seen.items() if k > 1}
        self.tied = np.zeros(len(order) + 1, bool)
        self.tied[list(shared)] = True
        blank = [score[p] for p in self.id_of if not p.strip(SPACE) and len(p) > 1]
        mixed = [s for p, s in score.items() if SPACE in p and p.strip(SPACE)]
        #: Runs of spaces merge after all else: a word's spaces before its last can be done apart.
        self.late_spaces = not blank or not mixed or max(blank) < min(mixed)
        self.lone_newline = not any("\n" in p and len(p) > 1 for p in self.id_of)

    def _ids(self, symbols: list[int], chars: list[str]) -> list[int]:
        """Vocabulary ids; a symbol that is no piece becomes its bytes."""
        out = []
        for s, c in zip(symbols, chars, strict=True):
            if s < len(self.names):
                out.append(s)
            else:
                out += [self.byte_ids[b] for b in c.encode("utf-8", "replace")]
        return out

    def merge_one(self, word: str) -> list[int]:
        """Ids of a word, one merge after another: best score first, then leftmost."""
        sym = [self.symbols.get(c, self.odd) for c in word]
        text = list(word)
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if i >= 0 and j < len(sym) and (hit := self.pair.get(sym[i] * self.n_symbols + sym[j])):
                heapq.heappush(heap, (hit[0], i, j, len(text[i]) + len(text[j]), hit[1]))

        for i in range(len(sym) - 1):
            offer(i)
        while heap:
            _, i, j, size, to = heapq.heappop(heap)
            if text[i] is None or j >= len(sym) or nxt[i] != j or text[j] is None or len(text[i]) + len(text[j]) != size:
                continue
            text[i], sym[i], text[j], nxt[i] = text[i] + text[j], to, None, nxt[j]
            if nxt[i] < len(sym):
                prv[nxt[i]] = i
            if prv[i] >= 0:
                offer(prv[i])
            offer(i)
        live = [i for i, t in enumerate(text) if t is not None]
        return self._ids([sym[i] for i in live], [text[i] for i in live])

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by vectorised rounds."""
        ids, edge = self.merge_flat(words)
        ids, edge = ids.tolist(), edge.tolist()
        return [ids[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)]

    def merge_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word's begin, with the end last."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        joined = "".join(words)
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        points, inverse = np.unique(code, return_inverse=True)
        table = np.array([self.symbols.get(chr(c), self.odd) for c in points.tolist()], np.int64)
        sym, word = table[inverse], np.repeat(np.arange(len(words)), [len(w) for w in words])
        at = np.arange(len(sym))  # where a symbol begins in joined
        out_sym, out_word, out_at, slow = [], [], [], set()
        rank, made = self._lookup(sym[:-1], sym[1:])
        rank = np.append(np.where(word[:-1] == word[1:], rank, NONE), NONE)
        made = np.append(made, 0)
        while len(sym):
            head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[head, len(word)])
            best = np.minimum.reduceat(rank, head)
            going = best < NONE
            if not going.all():
                done = np.repeat(~going, size)
                out_sym.append(sym[done])
                out_word.append(word[done])
                out_at.append(at[done])
                live = ~done
                sym, word, at, rank, made = sym[live], word[live], at[live], rank[live], made[live]
                if not len(sym):
                    break
                head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                best, size = best[going], size[going]
            low = np.repeat(best, size)
            pick = rank == low
            # Leftmost of overlapping occurrences: in each run of adjacent picks every second one.
            i = np.flatnonzero(pick)
            start = np.r_[True, i[1:] != i[:-1] + 1]
            run = np.maximum.accumulate(np.where(start, np.arange(len(i)), 0))
            i = i[(np.arange(len(i)) - run) % 2 == 0]
            tie = self.tied[low[i]]
            if tie.any():
                first = np.r_[True, word[i[1:]] != word[i[:-1]]]
                i = i[~tie | first]
            now = low[i]
            sym[i] = made[i]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, at, rank, made = sym[keep], word[keep], at[keep], rank[keep], made[keep]
            j = place[i]
            for k in (j, j - 1):
                ok = (k >= 0) & (k < len(sym) - 1)
                ok[ok] = word[k[ok]] == word[k[ok] + 1]
                end = k[~ok & (k >= 0)]
                rank[end] = NONE
                q = k[ok]
                r, m = self._lookup(sym[q], sym[q + 1])
                rank[q], made[q] = r, m
                # A better pair than this round's: with several merges in the word, order would have mattered.
                for w in np.unique(word[q[r < now[ok]]]).tolist():
                    if int((word[j] == w).sum()) > 1:
                        slow.add(w)
        sym, word, at = np.concatenate(out_sym), np.concatenate(out_word), np.concatenate(out_at)
        order = np.argsort(at)
        sym, word, at = sym[order], word[order], at[order]
        edge = np.searchsorted(word, np.arange(len(words) + 1))
        odd = np.flatnonzero(sym >= len(self.names))
        patch: dict[int, list[int]] = {}
        if len(odd):
            stop = np.append(at[1:], len(joined))
            for w in np.unique(word[odd]).tolist():
                i, j = int(edge[w]), int(edge[w + 1])
                patch[w] = self._ids(sym[i:j].tolist(), [joined[x:y] for x, y in zip(at[i:j].tolist(), stop[i:j].tolist(), strict=True)])
        for w in slow:
            patch[w] = self.merge_one(words[w])
        if not patch:
            return sym, edge
        size = np.diff(edge)
        parts, done = [], 0
        for w in sorted(patch):
            parts += [sym[done : edge[w]], np.array(patch[w], np.int64)]
            done, size[w] = int(edge[w + 1]), len(patch[w])
        return np.concatenate([*parts, sym[done:]]), np.r_[0, np.cumsum(size)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words, each a run of spaces and then other characters; long runs of spaces are done apart."""
        if not self.late_spaces:
            return self.merge_all(words)
        core = [w.lstrip(SPACE) for w in words]
        runs = [len(w) - len(c) for w, c in zip(words, core, strict=True)]
        ask = [(SPACE if k else "") + c if c else "" for k, c in zip(runs, core, strict=True)]
        need = [i for i, a in enumerate(ask) if a]
        found = dict(zip(need, self.merge_all([ask[i] for i in need]), strict=True))
        lone = self.id_of.get(SPACE, -1)
        out = []
        for i, k in enumerate(runs):
            ids = found.get(i, [])
            if i in found and k and ids[0] != lone:
                k -= 1
            elif i in found and k:
                ids = ids[1:]
            out.append((self.spaces(k) if k else []) + ids)
        return out

    def spaces(self, k: int) -> list[int]:
        """Ids of a run of k spaces: the longest blank piece as often as it fits, when it can't grow, then the rest."""
        if not hasattr(self, "_runs"):
            self._most = most = max((len(p) for p in self.id_of if not p.strip(SPACE)), default=1)
            self._runs = [self.merge_one(SPACE * i) if i else [] for i in range(3 * most + 1)]
            whole = self._runs[most]
            self._periodic = len(whole) == 1 and all(self._runs[i] == whole + self._runs[i - most] for i in range(most, 3 * most + 1))
        if k < len(self._runs):
            return self._runs[k]
        if self._periodic:
            return self._runs[self._most] * (k // self._most) + self._runs[k % self._most]
        return self.merge_one(SPACE * k)

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids as the library gives it; first: the dummy prefix is cut."""
        out: list[str] = []
        held = bytearray()

        def flush() -> None:
            while held:
                try:
                    out.append(held.decode("utf-8"))
                    held.clear()
                except UnicodeDecodeError as e:
                    out.append(held[: e.start].decode("utf-8") + "�")
                    del held[: e.start + 1]

        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                first = False
                continue
            flush()
            if i == self.unk:
                out.append(" ⁇ ")
                first = False
            elif not self.special[i]:
                p = self.names[i]
                out.append((p[1:] if first and p.startswith(SPACE) else p).replace(SPACE, " "))
                first = False
        flush()
        return "".join(out)


SPLIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def words_of(text: str, lone_newline: bool) -> list[str]:
    """Words of a text with spaces escaped and the dummy prefix; their joint ids are the text's.

    Empty strings may be among them and stand for nothing.
    """
    if not text:
        return []
    if lone_newline and text[0] != " " and "  " not in text and SPACE not in text:
        return (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")
    text = SPACE + text.replace(" ", SPACE)
    if not lone_newline:
        return SPLIT.findall(text)
    out: list[str] = []
    for i, line in enumerate(text.split("\n")):
        if i:
            out.append("\n")
        out += SPLIT.findall(line)
    return out


class Encoder:
    """Encodes texts with a cache of words, emptied when it holds most words."""

    def __init__(self, proto: bytes, most: int = 450_000):
        self.model, self.most = PieceModel(proto), most
        self.ids: dict[str, bytes] = {}
        self.text: dict[str, bytes] = {}
        m = self.model
        self.said = [bytes([m.byte_of[i]]) if i in m.byte_of else b"" if m.special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(m.names)]
        self.size = np.array([len(b) for b in self.said], np.int64)

    def _learn(self, new: list[str]) -> None:
        m, long = self.model, SPACE * 2
        plain = [w for w in new if not w.startswith(long)]
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            self._keep(part, *m.merge_flat(part))
        rest = [w for w in new if w.startswith(long)]
        if rest:
            ids = m.encode_words(rest)
            self._keep(rest, np.array([x for i in ids for x in i], np.int64), np.r_[0, np.cumsum([len(i) for i in ids])])

    def _keep(self, words: list[str], ids: np.ndarray, edge: np.ndarray) -> None:
        """Cache each word's ids and what they decode to, as slices of all words' bytes."""
        raw = ids.astype("<u4").tobytes()
        # Ids of a word hold whole characters, so their pieces' bytes are its decoded text.
        said = b"".join(map(self.said.__getitem__, ids.tolist()))
        place = np.r_[0, np.cumsum(self.size[ids])][edge].tolist()
        edge = (4 * edge).tolist()
        self.ids.update(zip(words, [raw[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)], strict=True))
        self.text.update(zip(words, [said[i:j] for i, j in zip(place[:-1], place[1:], strict=True)], strict=True))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """For each text the bytes of its ids (little-endian 32-bit, begin and end included), and the decoded text in UTF-8."""
        m = self.model
        begin, end = np.array([m.bos], "<u4").tobytes(), np.array([m.eos], "<u4").tobytes()
        words = [words_of(t or "", m.lone_newline) for t in texts]
        new = set().union(*words).difference(self.ids)
        if len(self.ids) + len(new) > self.most:
            self.ids, self.text = {}, {}
            new = set().union(*words)
        self.ids[""] = self.text[""] = b""
        self._learn([w for w in new if w])
        for w in words:
            # Only the first word can carry the dummy prefix; its escaped space decodes to one blank.
            yield begin + b"".join(map(self.ids.__getitem__, w)) + end, b"".join(map(self.text.__getitem__, w))[1:]


def encode_documents(docs: DataFrame, proto: bytes, text: str = "text", doc_id: str = "doc_id", tokens: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256; with tokens also ids and decoded.

    proto is the content of the model file; tasks get it from the driver, so
    the file need not exist on executors. A null text is empty: begin and end
    ids only; very long texts are encoded whole, a word at a time. Decoded text
    comes from the bytes that each word's ids decode to, which joined are what
    the whole sequence decodes to. Rows repeat as in docs; an empty table gives
    an empty result, and other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(proto)
        for b in batches:
            rows = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(s).hexdigest(), *((i, s) if tokens else ())) for i, s in encoder.encode(b.column(1).to_pylist())]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            arrays = [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if tokens:
                arrays += [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in cols[3]], pa.list_(pa.int32())), pa.array([s.decode() for s in cols[4]], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if tokens else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
